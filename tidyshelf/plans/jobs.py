"""Whole jobs: the operators put together."""

from __future__ import annotations

import time
from collections.abc import Callable, Sequence
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidyshelf.config import PipelineConfig
from tidyshelf.functions.text import clean_column
from tidyshelf.operators.asking import Ledger
from tidyshelf.operators.canonical import postprocess
from tidyshelf.operators.columns import (
    TARGET,
    build_description,
    detect_description_columns,
    drop_empty,
    pick_description_column,
    resolve_columns,
    to_raw,
)
from tidyshelf.operators.dedup import dedup_exact
from tidyshelf.operators.ordering import assign_ids, head
from tidyshelf.operators.responses import (
    apply_extractor,
    build_prompts,
    default_template,
    join_replies,
    load_template,
    resolve_attempts,
)
from tidyshelf.operators.summary import run_summary
from tidyshelf.operators.validation import split, validate
from tidyshelf.sources.readers import ORDER, read_listings, require_rows
from tidyshelf.sources.writers import export_results
from tidyshelf.storage import Workspace, prepare_session


class Normalized(NamedTuple):
    clean: DataFrame
    errors: DataFrame
    summary: DataFrame
    tagged: DataFrame
    #: All rows after preprocessing, before any limit.
    preprocessed: DataFrame


def preprocess(
    df: DataFrame, order: str | Sequence[str] = ORDER, workspace: Workspace | None = None,
    scan_partitions: int | None = None, limit: int | None = None,
) -> DataFrame:
    """Drop empty texts, clean, keep the first of equal texts, number 1..n in input order.

    Two shuffles: by text and by order. The result is a written table, so what follows (such as a
    costly extractor) does not repeat the cleaning. ``scan_partitions`` deals the rows over so many
    tasks before cleaning, for inputs of a few files that cannot be split. With ``limit`` only the
    first rows are ordered and numbered.
    """
    rows = df.repartition(scan_partitions) if scan_partitions else df
    cleaned = clean_column(drop_empty(rows), TARGET)
    return assign_ids(head(dedup_exact(cleaned, TARGET, order), limit, order), order, workspace)


def _finish(
    raw: DataFrame, attempts: DataFrame, threshold: float, retry_limit: int,
    strict_compat: bool, work: Workspace, preprocessed: DataFrame | None = None, reply_key: str | None = None,
) -> Normalized:
    """Both outcomes and the summary read one written table, by the columns they need.

    Canonical values are written too: every chart table reads them.
    """
    replies = resolve_attempts(attempts, retry_limit)
    if reply_key:
        keys = raw.select("id", F.col(reply_key).alias("_key"))
        replies = keys.join(replies.withColumnRenamed("id", "_key"), "_key").drop("_key")
    answered = join_replies(to_raw(raw), replies)
    tagged = work.freeze(validate(answered, threshold, strict_compat), "tagged")
    clean, errors = split(tagged)
    canonical = work.freeze(postprocess(clean, workspace=work), "clean")
    return Normalized(canonical, errors, run_summary(tagged), tagged, raw if preprocessed is None else preprocessed)


def normalize_table(
    df: DataFrame,
    attempts: DataFrame | None = None,
    extractor: Callable | None = None,
    columns: str | Sequence[str] | None = None,
    limit: int | None = None,
    order: str | Sequence[str] = ORDER,
    threshold: float = 0.5,
    retry_limit: int = 3,
    template: str | None = None,
    strict_compat: bool = False,
    workspace: Workspace | None = None,
    scan_partitions: int | None = None,
    reply_key: str | None = None,
) -> Normalized:
    """Merge columns, preprocess, resolve the replies, validate, canonicalise, summarise.

    Replies come from ``extractor`` (see :func:`tidyshelf.operators.responses.apply_extractor`), or
    are a table of attempts whose ``id`` holds values of the column ``reply_key`` of ``df``. Of equal
    texts the first row's key counts. The ids 1..n are output only: a caller cannot know them.
    ``limit=None`` keeps every row.
    """
    if attempts is not None and reply_key is None:
        raise ValueError("name the column of the table that the attempts refer to (reply_key)")
    spark = prepare_session(df.sparkSession)
    work = workspace or Workspace(spark)
    order_names = [order] if isinstance(order, str) else list(order)
    if columns is None:
        body = df.select(*[c for c in df.columns if c not in (*order_names, reply_key)])
        columns = detect_description_columns(body)
    elif isinstance(columns, str):
        columns = resolve_columns(df, columns)
    keep = [reply_key] if reply_key and reply_key not in order_names else []
    merged = build_description(df, list(columns)).select(*order_names, TARGET, *keep)
    whole = preprocess(merged, order, work, scan_partitions)
    raw = whole.filter(F.col("id") <= F.lit(limit)) if limit else whole  # its ids are dense
    if attempts is None:
        if extractor is None:
            raise ValueError("pass a table of attempts or an extractor")
        prompts = build_prompts(to_raw(raw), template or default_template())
        attempts, reply_key = apply_extractor(prompts, extractor, workspace=work, retry_limit=retry_limit), None
    return _finish(raw, attempts, threshold, retry_limit, strict_compat, work, whole, reply_key)


def normalize_one(
    spark: SparkSession,
    text: str,
    product_id: int = 0,
    attempts: DataFrame | None = None,
    extractor: Callable | None = None,
    threshold: float = 0.5,
    retry_limit: int = 3,
    template: str | None = None,
    workspace: Workspace | None = None,
) -> Normalized:
    """One text through the same stages, with the caller's id; a blank text is an error."""
    prepare_session(spark)
    if not text.strip():
        raise ValueError("the description must not be empty")
    work = workspace or Workspace(spark)
    row = spark.createDataFrame([(product_id, text)], "id BIGINT, raw_description STRING")
    raw = clean_column(row, TARGET)
    if attempts is None:
        if extractor is None:
            raise ValueError("pass a table of attempts or an extractor")
        prompts = build_prompts(raw, template or default_template())
        attempts = apply_extractor(prompts, extractor, workspace=work, retry_limit=retry_limit)
    return _finish(raw, attempts, threshold, retry_limit, False, work)


def run_pipeline(spark: SparkSession, cfg: PipelineConfig, extractor: Callable) -> DataFrame:
    """Files in, clean and error tables out; returns the summary row.

    Stages that must not run twice are written tables of one workspace, dropped at the end.
    """
    started = time.perf_counter()
    prepare_session(spark)
    template = load_template(spark, cfg.template_path) if cfg.template_path else default_template()
    columns = list(cfg.columns) if cfg.columns else None
    source = require_rows(read_listings(spark, cfg.input_path, cfg.fmt, cfg.multiline, columns))
    with Workspace(spark) as work:
        picked = pick_description_column(source).select(TARGET, ORDER)
        raw = preprocess(picked, workspace=work, scan_partitions=cfg.scan_partitions, limit=cfg.limit)
        prompts = build_prompts(to_raw(raw), template)
        attempts = apply_extractor(
            prompts, extractor, cfg.extractor_partitions, work, cfg.retry_limit, cfg.waits,
            Ledger(cfg.ledger_path) if cfg.ledger_path else None, cfg.in_flight, cfg.calls_per_second)
        done = _finish(raw, attempts, cfg.confidence_threshold, cfg.retry_limit, cfg.strict_compat, work)
        result = export_results(
            done.clean, done.errors, cfg.output_path, cfg.error_path, cfg.output_format
        )
    seconds = round(time.perf_counter() - started, 2)
    row = (result.total, result.success, result.errors, result.success_rate, seconds)
    return spark.createDataFrame(
        [row],
        "total BIGINT, success BIGINT, errors BIGINT, success_rate DOUBLE, duration_seconds DOUBLE",
    )
