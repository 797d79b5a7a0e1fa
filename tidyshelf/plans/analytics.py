"""Every table behind the charts of a run, from one pass over each input."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidyshelf import lexicon as lx
from tidyshelf.operators import distribution as d
from tidyshelf.operators import summary as s
from tidyshelf.operators.ordering import sorted_slices
from tidyshelf.operators.quantiles import exact_quantiles, wide_quantiles
from tidyshelf.storage import Workspace

#: Grouping sets of the clean table by the series they make: (columns, the number among them if there is one).
SERIES: dict[str, tuple[Sequence[str], str | None]] = {
    "category": (["category"], None), "availability": (["availability"], None), "brand": (["brand"], None),
    "currency": (["currency"], None), "price": (["category", "price"], "price"), "confidence": (["confidence"], "confidence"),
}
QUARTILES = {0.25: "q1", 0.5: "median", 0.75: "q3"}
BOXES = 8


def _long(df: DataFrame, **columns) -> DataFrame:
    """Rows of the facts table: series, label, whole number or value, and counts; what is not given is null."""
    kinds = {"series": "string", "label": "string", "number": "long", "value": "double", "n": "long", "distinct": "long"}
    return df.select(*[columns.get(c, F.lit(None)).cast(kind).alias(c) for c, kind in kinds.items()])


def clean_facts(clean: DataFrame) -> DataFrame:
    """Rows per value of each charted column, by grouping sets of one scan."""
    names = list(dict.fromkeys(c for columns, _ in SERIES.values() for c in columns))
    sets = [[F.col(c) for c in columns] for columns, _ in SERIES.values()]
    grouped = clean.groupingSets(sets, *names).agg(F.grouping_id().alias("_set"), F.count("*").alias("n"))
    series = label = number = value = None
    for name, (columns, measured) in SERIES.items():
        # a bit of the set's number is 1 if its column is not part of it, the first column leading
        own = F.col("_set") == sum(1 << (len(names) - 1 - i) for i, c in enumerate(names) if c not in columns)
        series = F.when(own, name) if series is None else series.when(own, name)
        if columns[0] != measured:
            label = F.when(own, F.col(columns[0])) if label is None else label.when(own, F.col(columns[0]))
        if measured == "price":
            number = F.when(own, F.col(measured))
        elif measured:
            value = F.when(own, F.col(measured))
    return _long(grouped, series=series, label=label, number=number, value=value, n=F.col("n"))


def facts(tagged: DataFrame, clean: DataFrame, raw: DataFrame | None, preprocessed: DataFrame | None, workspace: Workspace) -> DataFrame:
    """Counts that all charts are made of, written once: each input is read once, by the columns it needs."""
    outcome = tagged.groupBy("error_type").agg(F.count("*").alias("n"))
    out = clean_facts(clean).unionByName(_long(outcome, series=F.lit("outcome"), label=F.col("error_type"), n=F.col("n")))
    if raw is not None:
        # equal texts meet by their digest; what is kept of them is length and number
        texts = raw.select(F.sha2("raw_description", 256).alias("_digest"), F.char_length("raw_description").alias("length")).groupBy(
            "_digest", "length").agg(F.count("*").alias("n"))
        lengths = texts.groupBy("length").agg(F.sum("n").alias("n"), F.count("_digest").alias("texts"))
        out = out.unionByName(_long(lengths, series=F.lit("length"), number=F.col("length"), n=F.col("n"), distinct=F.col("texts")))
    if preprocessed is not None:
        out = out.unionByName(_long(preprocessed.agg(F.count("*").alias("n")), series=F.lit("preprocessed"), n=F.col("n")))
    return workspace.freeze(out, "facts")


def _quartiles(told: DataFrame, with_lengths: bool, workspace: Workspace) -> DataFrame:
    """Exact quartiles of the boxes (label: the category), of all prices and of the lengths, found together and written."""
    prices = told.filter("series = 'price' AND number IS NOT NULL")
    largest = s.top_k(told.filter("series = 'category'"), "label", BOXES, "n").select("label")  # a few rows
    boxes = prices.join(F.broadcast(largest), "label", "left_semi").select(F.lit("box").alias("series"), "label", "number", "n")
    pooled = told.filter("series IN ('price', 'length') AND number IS NOT NULL").groupBy("series", F.lit("").alias("label"), "number").agg(F.sum("n").alias("n"))
    kept = boxes.unionByName(pooled if with_lengths else pooled.filter("series = 'price'"))
    slices = sorted_slices(kept, ["series", "label", "number"], workspace)
    found = exact_quantiles(kept, "number", list(QUARTILES), ["series", "label"], slices=slices)
    return workspace.freeze(wide_quantiles(found, QUARTILES, ["series", "label"]), "quartiles")


def _conformance(told: DataFrame) -> DataFrame:
    """Share of the known values of each declared field that are among the declared ones."""
    inside = F.lit(False)
    for name, values in lx.DECLARED_VALUES.items():
        inside = inside | ((F.col("series") == name) & F.col("label").isin(values))
    known = told.filter(F.col("series").isin(list(lx.DECLARED_VALUES))).groupBy(F.col("series").alias("field")).agg(
        s.rows_where(F.col("label").isNotNull(), "n").alias("known"), s.rows_where(inside, "n").alias("inside"))
    fields = told.sparkSession.createDataFrame([(f,) for f in lx.DECLARED_VALUES], "field string")
    return fields.join(F.broadcast(known), "field", "left").select(
        "field", F.when(F.col("known") > 0, F.col("inside") / F.col("known")).otherwise(F.lit(0.0)).alias("share"))


def analytics(
    tagged: DataFrame,
    clean: DataFrame,
    raw: DataFrame | None = None,
    threshold: float = 0.5,
    approximate: bool = False,
    workspace: Workspace | None = None,
    preprocessed: DataFrame | None = None,
) -> dict[str, DataFrame]:
    """Chart tables by name. Each input is read once, into a written table of counts; charts read that.

    With ``raw`` (the table before cleaning) the length and duplicate reports are included, with
    ``preprocessed`` too (all rows before any limit) the counts of each stage. With ``approximate``
    quartiles come from sketches over the inputs instead of the sorted counts.
    """
    work = workspace or Workspace(clean.sparkSession)
    told = facts(tagged, clean, raw, preprocessed, work)

    def series(name: str, label: str | None = None, measure: str | None = None, kind: str = "number") -> DataFrame:
        kept = ([F.col("label").alias(label)] if label else []) + ([F.col(kind).alias(measure)] if measure else [])
        return told.filter(F.col("series") == name).select(*kept, "n")

    outcome, confidence = series("outcome", "error_type"), series("confidence", None, "confidence", "value")
    tables = {
        "run_summary": s.run_summary(outcome, "n"),
        "avg_confidence": s.average_confidence(confidence, "n"),
        "category_counts": s.value_counts(series("category", "category"), "category", "n"),
        "availability_counts": s.value_shares(series("availability", "availability"), "availability", "n"),
        "error_counts": s.value_counts(outcome.filter("error_type IS NOT NULL"), "error_type", "n"),
        "top_brands": s.top_k(series("brand", "brand"), "brand", 15, "n"),
        "success_failure": s.success_failure(outcome, "n"),
        "histogram_price": d.histogram(series("price", None, "price"), "price", 30, "n"),
        "histogram_confidence": d.histogram(confidence, "confidence", 20, "n"),
    }
    lengths = series("length", None, "length")
    if approximate:
        tables |= {"box_stats": d.box_stats(clean, approximate=True), "median_price": d.median(clean, "price", True)}
    else:
        quartiles = _quartiles(told, raw is not None, work)
        of = lambda name: quartiles.filter(F.col("series") == name)
        boxes = of("box").select(F.col("label").alias("category"), *QUARTILES.values())
        prices = series("price", "category", "price").filter("price IS NOT NULL")
        tables |= {
            "box_stats": d.box_numbers(d.fenced(prices, boxes, "category"), "category", "price"),
            "median_price": of("price").agg(F.max("median").alias("median")),
        }
    tables |= {
        "below_threshold": s.below_threshold(confidence, threshold, "n"),
        "enum_conformance": _conformance(told),
    }
    if raw is not None:
        missing = s.rows_where(F.col("number").isNull(), "n")
        report = told.filter("series = 'length'")
        tables |= {
            "histogram_length": d.histogram(lengths, "length", 40, "n"),
            "describe_length": d.describe(raw.select(F.char_length("raw_description").alias("length")), "length", True)
            if approximate else d.describe_counts(lengths, "length", "n", of("length")),
            "duplicates": report.agg(
                s.rows_where(weight="n").alias("total"), missing.alias("missing"),
                (s.rows_where(weight="n") - s.rows_where(weight="distinct") - F.least(missing, F.lit(1))).alias("duplicates")),
        }
    if raw is not None and preprocessed is not None:
        tables["stage_counts"] = _stages(told)
    return tables


def _stages(told: DataFrame) -> DataFrame:
    """Rows at each stage: raw, after preprocessing, clean, errors."""
    n = lambda name, more=F.lit(True): s.rows_where((F.col("series") == name) & more, "n")
    rows = {"raw": n("length"), "preprocessed": n("preprocessed"), "clean": n("outcome", F.col("label").isNull()),
            "errors": n("outcome", F.col("label").isNotNull())}
    stages = F.array(*[F.struct(F.lit(i).alias("position"), F.lit(name).alias("stage"), F.col(name).alias("rows")) for i, name in enumerate(rows, 1)])
    return told.agg(*[c.alias(name) for name, c in rows.items()]).select(F.inline(stages))
