"""The one Python stage: entity unescaping and Unicode composition have no Spark built-in."""

from __future__ import annotations

import html
import re
import unicodedata
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import functions as F
from pyspark.sql import types as T

_TAG = re.compile(r"<[^>]+>")
#: Bytes of text that are Python strings at one time; a longer text is on its own.
_PIECE = 1 << 20


@F.arrow_udf(T.StringType())
def unescape_strip_compose(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
    """Apply ``html`` (unescape, tags to spaces) and/or ``nfc``. Callers pass null for easy rows.

    Texts become Python strings piece by piece, so a worker's memory follows neither the rows of a batch nor their length.
    """
    def repair(text: str, strip: bool, compose: bool) -> str:
        if strip:
            text = _TAG.sub(" ", html.unescape(text))
        return unicodedata.normalize("NFC", text) if compose else text

    for texts, steps in batches:
        step = steps[0].as_py() if len(steps) else ""
        strip, compose = "html" in step, "nfc" in step
        start, size = 0, 0
        for end, length in enumerate(pc.binary_length(texts).to_pylist(), 1):
            size += length or 0
            if size >= _PIECE or end == len(texts):
                piece = texts.slice(start, end - start).to_pylist()
                yield pa.array([t if t is None else repair(t, strip, compose) for t in piece], pa.string())
                start, size = end, 0
