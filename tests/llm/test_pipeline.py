from pyspark.sql import functions as F

import corpus_pipeline
from tests.conftest import SF
from tests.llm.test_decontaminate import plain as plain_hits
from tests.llm.test_ngram_join import plain_components
from tests.llm.test_suffix_dedup import plain as plain_repeats
from tidyshelf.llm.common import table
from tidyshelf.llm.decontaminate import clean_documents
from tidyshelf.llm.toxicity import score_toxicity


def test_stages_keep_their_promises(spark):
    """Each stage on what its predecessor kept, against brute force."""
    docs = table(spark, SF, "documents")
    columns = docs.columns
    stages = dict(corpus_pipeline.STAGES)
    clean = stages["toxicity"](spark, docs, SF).cache()
    toxic = {r["doc_id"] for r in score_toxicity(docs, table(spark, SF, "labels")).filter("predicted = 1").collect()}
    assert clean.columns == columns and {r["doc_id"] for r in clean.collect()} == {r["doc_id"] for r in docs.collect()} - toxic
    single = stages["ngram_join"](spark, clean, SF).cache()
    groups = plain_components([(r["doc_id"], r["text"]) for r in clean.collect()])
    assert single.columns == columns and sorted(r["doc_id"] for r in single.collect()) == sorted({g[2] for g in groups})
    rows = single.orderBy("doc_id").collect()
    cut = stages["suffix_dedup"](spark, single, SF).cache()
    found = cut.orderBy("doc_id").collect()
    assert cut.columns == columns and [r["doc_id"] for r in found] == [r["doc_id"] for r in rows]
    for r, (n_bytes, removed, _, _) in zip(found, plain_repeats([r["text"] for r in rows], 200), strict=True):
        assert n_bytes - removed - 6 <= len(r["text"].encode()) <= n_bytes - removed
    safe = stages["decontaminate"](spark, cut, SF).cache()
    items = [(r["item_id"], r["text"]) for r in table(spark, SF, "benchmark").collect()]
    texts = {r["doc_id"]: r["text"] for r in safe.collect()}
    for doc, n, hit, _, _, contaminated in plain_hits([(r["doc_id"], r["text"]) for r in found], items):
        before = next(r["text"] for r in found if r["doc_id"] == doc)
        assert (texts[doc] == before) == (not contaminated)
    assert safe.columns == columns
    packed = stages["packing"](spark, safe, SF)
    assert {r["doc_id"] for r in packed.collect()} == set(texts)


def test_null_and_repeated_ids(spark, odd):
    rows = odd.selectExpr("doc_id", "text", "'en' AS lang", "'s' AS source", "CAST(length(text) AS long) AS n_chars")
    for name, stage in corpus_pipeline.STAGES:
        for docs in (rows, rows.limit(0)):
            out = stage(spark, docs, SF)
            assert name == "packing" or out.columns == rows.columns
            out.count()


def test_columns_of_any_name(spark):
    """Columns under the names that a stage uses itself come through as they were."""
    rows = table(spark, SF, "documents").limit(60)
    names = ["text_to_score", "TEXT_TO_SCORE_", "place", "row_number", "n_words", "hit_spans", "__text", "__place", "__row", "id", "score", "node", "n"]
    odd = rows.select("*", *[(F.col("doc_id") * 7).alias(n) for n in names])
    benchmark = table(spark, SF, "benchmark")
    outs = [stage(spark, odd, SF) for _, stage in corpus_pipeline.STAGES[:-1]] + [clean_documents(odd, benchmark, block_words=2000)]
    for out in outs:
        assert out.columns == odd.columns
        assert all(r[n] == 7 * r["doc_id"] for r in out.collect() for n in names)
