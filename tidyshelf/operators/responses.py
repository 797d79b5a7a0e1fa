"""Prompt tables, extraction attempts and their resolution to one reply per row."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Sequence
from importlib import resources

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidyshelf.functions.json_text import extract_json_object
from tidyshelf.functions.price import extract_price
from tidyshelf.operators.asking import LEDGER_SCHEMA, Ledger, Prompt, asking, key_of
from tidyshelf.schemas import ATTEMPT_SCHEMA
from tidyshelf.storage import Workspace, workspace_for

PLACEHOLDER = "{raw_description}"


def default_template() -> str:
    return (resources.files("tidyshelf") / "prompt_template.txt").read_text(encoding="utf-8")


def load_template(spark: SparkSession, path: str) -> str:
    """Read a prompt template anew on each call; a missing file raises ``FileNotFoundError``."""
    try:
        row = spark.read.text(path, wholetext=True).first()
    except AnalysisException as error:
        raise FileNotFoundError(f"prompt template not found: {path}") from error
    return row[0] if row else ""


def build_prompts(df: DataFrame, template: str, column: str = "raw_description") -> DataFrame:
    """Put each text into the template, literally."""
    prompt = F.replace(F.lit(template), F.lit(PLACEHOLDER), F.col(column))
    return df.withColumn("prompt", prompt)


def apply_extractor(
    prompts: DataFrame,
    extractor: Callable[[Prompt], str | None],
    partitions: int | None = None,
    workspace: Workspace | None = None,
    retry_limit: int = 3,
    waits: Sequence[float] = (1.0, 2.0),
    ledger: Ledger | None = None,
    in_flight: int = 1,
    rate: float | None = None,
) -> DataFrame:
    """Ask the caller's extractor for each row, up to ``retry_limit`` times, and freeze the answers.

    ``extractor`` gets a named tuple ``id, raw_description, prompt, attempt`` and returns a text, or
    None for a failed call. If it raises, that call counts as failed, for its row alone; an answer of
    another type is a mistake in the extractor and ends the job. Rows without a JSON object in their
    answer are asked again in the next round, after a wait once per task. Rounds are written: asking a
    model again could give other answers. Returns ``(id, attempt, raw_output)``.

    Each task keeps up to ``in_flight`` calls open, from threads of its own. ``rate`` is the calls that may
    start per second, in all tasks together: each of the round's tasks gets an equal share. With a ``ledger``
    answers are recorded while they come, prompts on record are not asked again, and equal prompts are asked
    once, under the smallest of their ids.
    """
    store = workspace_for(prompts, workspace)
    tasks = partitions or int(prompts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = partitions or rate or ledger
    todo, answered = prompts.select("id", "raw_description", "prompt"), None
    for attempt in range(1, retry_limit + 1):
        pause = waits[min(attempt - 2, len(waits) - 1)] if attempt > 1 and waits else 0.0
        share = rate / tasks if rate else None
        if ledger is None:
            spread = todo.repartition(tasks) if dealt else todo
            replies = store.freeze(spread.mapInPandas(asking(extractor, attempt, pause, in_flight, share), ATTEMPT_SCHEMA), "attempts")
        else:
            replies = _recorded(todo, ledger, attempt, tasks, store, lambda folder: asking(
                extractor, attempt, pause, in_flight, share, "key", folder, ledger.commit_rows))  # noqa: B023
        answered = replies if answered is None else answered.unionByName(replies)
        if attempt < retry_limit:
            failed = replies.filter(extract_json_object(F.col("raw_output")).isNull()).select("id")
            if failed.isEmpty():
                break
            todo = todo.join(failed, "id", "left_semi")
    return answered


def _recorded(todo: DataFrame, ledger: Ledger, attempt: int, tasks: int, store: Workspace, task: Callable) -> DataFrame:
    """One round with a ledger: answers on record, and the others by asking each distinct prompt once."""
    spark = todo.sparkSession
    told = ledger.answers(spark).filter(F.col("attempt") == attempt).select("key", "raw_output", F.lit(True).alias("_told"))
    looked_up = store.freeze(todo.withColumn("key", key_of()).join(told, "key", "left"), "told")
    open_ = looked_up.filter("_told IS NULL")
    asked = open_.groupBy("key").agg(F.min(F.struct("id", "raw_description", "prompt")).alias("_p")).select("key", "_p.*")
    folder = f"{ledger.qualified(spark)}/round-{uuid.uuid4().hex}"
    # a task that starts again gets the same keys, and its own record
    fresh = store.freeze(asked.repartition(tasks, "key").mapInPandas(task(folder), LEDGER_SCHEMA), "asked")
    columns = ["id", F.lit(attempt).cast("int").alias("attempt"), "raw_output"]
    return store.freeze(
        looked_up.filter("_told").select(*columns).unionByName(open_.select("id", "key").join(fresh, "key").select(*columns)), "attempts")


def resolve_attempts(attempts: DataFrame, limit: int = 3) -> DataFrame:
    """One reply per id: the first attempt that holds a JSON object.

    ``retry_count`` is the number of failures before it, or ``limit`` if all fail. The kept text is
    the winner's, else the last one that is not null. One shuffle: attempts are clustered and sorted
    by id, their texts parsed once to tell which hold an object, and the chosen one parsed again.
    """
    by_id = Window.partitionBy("id").orderBy("_rank")
    usable = F.col("raw_output").isNotNull()
    tried = attempts.filter(F.col("attempt").between(1, limit)).withColumn(
        "_ok", extract_json_object(F.col("raw_output")).isNotNull())
    # the first object, else the last text, else any
    rank = F.when(F.col("_ok"), F.col("attempt")).when(usable, 2 * limit - F.col("attempt") + 1).otherwise(3 * limit)
    chosen = tried.withColumn("_rank", rank).withColumn("_n", F.row_number().over(by_id)).filter("_n = 1")
    return chosen.select(
        "id", F.when(F.col("_ok"), extract_json_object(F.col("raw_output"))).alias("parsed"),
        F.when(F.col("_ok"), F.col("attempt") - 1).otherwise(F.lit(limit)).cast("int").alias("retry_count"),
        F.col("raw_output").alias("llm_raw_output"),
    )


def join_replies(raw: DataFrame, replies: DataFrame) -> DataFrame:
    """Raw rows with their replies, matched by ``id``; a row without a reply keeps nulls."""
    return raw.join(replies, "id", "left").withColumn(
        "retry_count", F.coalesce("retry_count", F.lit(0))
    )


def fill_price(price: Column, text: Column) -> Column:
    """The replied price (as text), or the one found in the description if there is none."""
    return F.coalesce(price, extract_price(text).cast("string"))
