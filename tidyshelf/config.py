"""Run settings, passed explicitly to the jobs."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class PipelineConfig:
    """Parameters of :func:`tidyshelf.plans.jobs.run_pipeline`.

    ``limit`` of ``None`` or 0 means every row. ``extractor_partitions`` sets how many tasks call
    the extractor at once (``None`` keeps the partitions as they are). ``waits`` are the seconds
    before the second, third, ... attempt. ``multiline=False`` lets Spark split CSV files whose records
    do not span lines. ``columns`` names the input's columns in order, which saves JSON files a pass.
    ``scan_partitions`` deals the input over so many tasks before cleaning. ``ledger_path`` is a folder in
    which answers are recorded as they come, so that a job that is started again asks for the others only;
    ``in_flight`` calls are open per task, and ``calls_per_second`` may start in all.
    """

    input_path: str
    output_path: str = "clean_products"
    error_path: str = "errors"
    fmt: str | None = None
    limit: int | None = None
    retry_limit: int = 3
    confidence_threshold: float = 0.5
    template_path: str | None = None
    extractor_partitions: int | None = None
    output_format: str = "csv"
    strict_compat: bool = False
    waits: tuple[float, ...] = (1.0, 2.0)
    multiline: bool = True
    columns: tuple[str, ...] | None = None
    scan_partitions: int | None = None
    ledger_path: str | None = None
    in_flight: int = 1
    calls_per_second: float | None = None
