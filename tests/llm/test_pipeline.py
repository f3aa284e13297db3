"""The pipeline's stages, one after another, against brute-force versions of what each keeps."""

import corpus_pipeline as P
from wavecohort.llm import tokens

from .test_neardup import components, sets_of
from .test_operators import brute_hits

DATA = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    bench = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{DATA}/benchmark.parquet").collect()]
    assert [f.__name__ for _, f in P.STAGES] == ["language", "near_duplicates", "decontamination", "mix_sources", "token_output"]
    one = P.language(spark, docs, DATA)
    assert one.columns == docs.columns
    got = {r["doc_id"]: r["text"] for r in one.collect()}
    assert set(got) == {r["doc_id"] for r in docs.collect() if any(c.isalpha() for c in r["text"] or "")}
    two = {r["doc_id"]: r["text"] for r in P.near_duplicates(spark, docs, DATA).collect()}
    rows = sorted((r["doc_id"], r["text"]) for r in docs.collect())
    root = components(sets_of([t for _, t in rows]))
    assert set(two) == {rows[i][0] for i in range(len(rows)) if root[i] == i}
    three = P.decontamination(spark, docs, DATA)
    assert {r["doc_id"] for r in three.collect()} == {i for i, t in rows if not brute_hits(t, bench)[1]}
    four = P.mix_sources(spark, docs, DATA)
    assert four.columns == docs.columns and 0 < four.count() < 3 * len(rows)
    five = P.token_output(spark, docs, DATA).collect()
    assert sum(r["n_tokens"] for r in five) == sum(len(tokens.encode(t, tokens.VOCABULARY)) + 1 for _, t in rows)


def test_run(spark):
    got = P.run(spark, DATA).collect()
    assert got and sum(r["n_sequences"] for r in got) > 0


def test_texts_are_not_sent_about(spark):
    """Language ID sends a text to Python once and gets a flag; near-dedup drops few ids without a shuffle of the texts."""
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    plan = P.language(spark, docs, DATA)._jdf.queryExecution().executedPlan().toString()
    assert "ArrowEvalPython" in plan and "MapInArrow" not in plan
    plan = P.near_duplicates(spark, docs, DATA)._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan
