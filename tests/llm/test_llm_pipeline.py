"""The pipeline's stages, each on its own input, and its whole."""

import zlib

from pyspark.sql import functions as F

import corpus_pipeline
from lodestar.llm import decontaminate, pii, simhash, toxicity
from lodestar.llm.common import read
from tests.llm.helpers import docs_frame, naive_components, naive_fingerprint, windows_hit


def rows_of(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_stages_keep_columns_and_take_effect(spark, sf):
    docs = read(spark, sf, "documents")
    by = dict(corpus_pipeline.STAGES)
    assert list(by) == ["toxicity", "dedup", "decontamination", "pii", "packing"]
    scored = toxicity.classify(docs, read(spark, sf, "labels"))
    toxic = {r["doc_id"] for r in scored.filter("predicted = 1").collect()}
    texts = {r["doc_id"]: r for r in docs.collect()}

    out = by["toxicity"](spark, docs, sf)
    assert out.schema == docs.schema and {r["doc_id"] for r in out.collect()} == set(texts) - toxic

    least = naive_components({d: naive_fingerprint(r["text"]) for d, r in texts.items()})
    out = by["dedup"](spark, docs, sf)
    assert out.columns == docs.columns and rows_of(out) == sorted((tuple(texts[d]) for d in set(least.values())), key=repr)

    items = [tuple(r) for r in read(spark, sf, "benchmark").select("item_id", "text").collect()]
    clean = [tuple(r) for r in texts.values() if not windows_hit(r["text"], items)[1]]
    assert 0 < len(clean) < len(texts)
    assert rows_of(by["decontamination"](spark, docs, sf)) == sorted(clean, key=repr)

    out = {r["doc_id"]: r for r in by["pii"](spark, docs, sf).collect()}
    assert all(out[d]["text"] == pii.masked(r["text"]) for d, r in texts.items())
    assert all(not [s for s in pii.spans(r["text"]) if s[0] == "email"] for r in out.values())
    assert any(out[d]["text"] != r["text"] for d, r in texts.items())


def test_run_equals_the_stages_in_turn(spark, sf):
    docs = read(spark, sf, "documents")
    for _, stage in corpus_pipeline.STAGES:
        docs = spark.createDataFrame((d := stage(spark, docs, sf)).collect(), d.schema).coalesce(1)
    got = corpus_pipeline.run(spark, sf).collect()
    pieces = lambda rows: {(r["doc_id"], r["doc_tokens"]) for r in rows}
    assert pieces(got) == pieces(docs.collect())


def test_stages_on_odd_documents(spark, sf):
    docs = docs_frame(spark, [None, "", "x", "x", "w " * 20_000, (None, "y"), (2, "again")])
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, sf)
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    assert corpus_pipeline.STAGES[-1][1](spark, docs, sf).count()
    extra = docs_frame(spark, [None, "x", "x", "y " * 50]).withColumns({c: F.lit(1) for c in ("text_key", "fp", "root", "kept_id", "hit_doc", "_listed_id", "toxic", "part", "score", "spans", "n")})
    columns = extra.columns
    for _, stage in corpus_pipeline.STAGES[:-1]:
        extra = stage(spark, extra, sf)
        assert extra.columns == columns
    assert {r["doc_id"] for r in corpus_pipeline.STAGES[-1][1](spark, extra, sf).collect()} == {0, 1, 3}
    empty = docs_frame(spark, [])
    for _, stage in corpus_pipeline.STAGES:
        empty = stage(spark, empty, sf)
    assert empty.count() == 0
