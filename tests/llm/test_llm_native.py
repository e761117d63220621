"""Decontamination and SimHash against brute force."""

import hashlib
import random

import numpy as np
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestar.llm import decontaminate, simhash
from tests.llm.helpers import docs_frame, naive_components, naive_fingerprint, texts_of, windows_hit

ITEM = T.StructType([T.StructField("item_id", T.LongType()), T.StructField("text", T.StringType())])


def check_hits(spark, docs, items):
    rows = decontaminate.decontaminate(docs_frame(spark, docs), spark.createDataFrame(items, ITEM)).collect()
    assert len(rows) == len(docs)
    given = {d[0] if isinstance(d, tuple) else i: d[1] if isinstance(d, tuple) else d for i, d in enumerate(docs)}
    for r in rows:
        n, hit, found = windows_hit(given[r["doc_id"]], items)
        assert (r["n_words"], r["n_hit"], r["n_items"], r["contaminated"]) == (n, hit, len(found), hit > 0), r
        assert r["items_sha256"] == hashlib.sha256(",".join(found).encode()).hexdigest()


def test_hits_random_small_vocabulary(spark):
    rng = random.Random(3)
    word = lambda: rng.choice(["a", "b", "C", "dé", "É", "7"])
    items = [(i, " ".join(word() for _ in range(rng.choice([3, 7, 9, 10, 11, 25])))) for i in range(12)]
    docs = [" ".join(word() for _ in range(rng.choice([0, 2, 9, 10, 40, 120]))) for _ in range(60)]
    docs += [f"{docs[0]} {t} tail" for _, t in items]
    check_hits(spark, docs, items)


def test_hits_edge_cases(spark):
    items = [(1, None), (2, ""), (3, "?!"), (4, "one two three"), (4, "x1 x2 x3 x4 x5 x6 x7 x8 x9 x10 x11"), (10, "one two three"), (9, "q " * 40)]
    docs = [None, "", " \n", "ONE, two\x00three", "x1 x2 x3 x4 x5 x6 x7 x8 x9", "y x2 x3 x4 x5 x6 x7 x8 x9 x10 x11 z", "q " * 500, "x " * 30000 + "one two three", "one two three one two three"]
    check_hits(spark, docs, items)


def test_hits_without_items_and_without_documents(spark):
    none = spark.createDataFrame([], ITEM)
    assert [r["n_hit"] for r in decontaminate.decontaminate(docs_frame(spark, ["a b c", None]), none).collect()] == [0, 0]
    assert decontaminate.decontaminate(docs_frame(spark, []), spark.createDataFrame([(1, "a b")], ITEM)).count() == 0


def test_hits_repeated_rows_null_ids_extra_columns(spark):
    docs = docs_frame(spark, [(1, "p q r"), (1, "p q r"), (1, "s"), (None, "p q r")]).withColumn("w", F.lit(1)).withColumn("win", F.lit("x")).withColumn("items", F.lit(0))
    items = spark.createDataFrame([(5, "p q"), (5, "p q"), (None, "q r")], ITEM).withColumn("fp", F.lit(1))
    rows = sorted((str(r["doc_id"]), r["n_words"], r["n_hit"], r["n_items"]) for r in decontaminate.decontaminate(docs, items).collect())
    assert rows == [("1", 1, 0, 0), ("1", 3, 3, 1), ("1", 3, 3, 1), ("None", 3, 3, 1)]
    kept = decontaminate.drop_contaminated(docs, items)
    assert kept.columns == docs.columns and [r["text"] for r in kept.collect()] == ["s"]


def test_large_benchmarks_take_the_shuffle_join(spark, monkeypatch):
    monkeypatch.setattr(decontaminate, "MAX_FINGERPRINTS", 0)
    monkeypatch.setattr(decontaminate, "MAX_WINDOWS", 0)
    items = [(i, " ".join(f"w{i}x{j}" for j in range(14))) for i in range(8)]
    check_hits(spark, [f"a {t} b" for _, t in items] + ["none of it"], items)


def test_fingerprint_matches_plain_version(spark, sf):
    texts = [*texts_of(spark, sf).values(), None, "", "one", "ONE two", "É x y z", "\x0b a\x00b  c d e"]
    assert [simhash.fingerprint(t) for t in texts] == [naive_fingerprint(t) for t in texts]
    assert simhash.fingerprint("w " * 70_000) == naive_fingerprint("w " * 70_000)


def test_components_on_documents(spark, sf):
    texts = texts_of(spark, sf)
    rows = simhash.near_duplicates(spark.read.parquet(f"{sf}/documents.parquet")).collect()
    want = naive_components({d: naive_fingerprint(t) for d, t in texts.items()})
    assert {r["doc_id"]: r["component_id"] for r in rows} == want
    assert all(int(r["fingerprint"], 16) == naive_fingerprint(texts[r["doc_id"]]) and len(r["fingerprint"]) == 16 for r in rows)


def grouped(spark, prints, cell):
    fps = spark.createDataFrame([(int(np.uint64(p).view(np.int64)),) for p in set(prints)], "fp long").repartition(4)
    got = {r["node"]: r["root"] for r in simhash.components(simhash.links(fps, cell=cell)).collect()}
    groups = {}
    for p in set(prints):
        s = int(np.uint64(p).view(np.int64))
        groups.setdefault(got.get(s, s), set()).add(p)
    return sorted(sorted(g) for g in groups.values())


def test_links_lose_nothing_at_any_grid(spark):
    rng = np.random.default_rng(5)
    centres = [int(x) for x in rng.integers(0, 1 << 63, 30, dtype=np.uint64)] + [0, (1 << 64) - 1]
    prints = set()
    for c in centres:
        for _ in range(40):
            x = c
            for b in rng.choice(64, rng.integers(0, 7), replace=False):
                x ^= 1 << int(b)
            prints.add(x)
    prints = sorted(prints)
    want = {}
    for i, least in naive_components(dict(enumerate(prints))).items():
        want.setdefault(least, []).append(prints[i])
    want = sorted(sorted(g) for g in want.values())
    for cell in (2048, 4, 1):  # all on the first grid; many cells refined; nearly all refined twice
        assert grouped(spark, prints, cell) == want


def test_components_of_a_long_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(200)], "a long, b long")
    assert {r["root"] for r in simhash.components(edges).collect()} == {0}
    assert simhash.components(edges.limit(0)).count() == 0


def test_hot_nodes_meet_their_neighbours_by_a_broadcast(spark):
    rng = random.Random(9)
    star = [(0, i) for i in range(1, 120)] + [(500, i) for i in range(100, 160)]
    loose = [(rng.randint(1000, 1100), rng.randint(1000, 1100)) for _ in range(90)]
    edges = [(min(e), max(e)) for e in star + loose if e[0] != e[1]]
    df = spark.createDataFrame(edges, "a long, b long")
    few, all_ = ({r["node"]: r["root"] for r in simhash.components(df, hot).collect()} for hot in (10, 10**6))
    root = {x: x for e in edges for x in e}
    for _ in range(len(root)):
        for a, b in edges:
            root[a] = root[b] = min(root[a], root[b])
    assert few == all_ and all(few.get(x, x) == r for x, r in root.items())


def test_long_lists_take_the_shuffle_join(spark, monkeypatch):
    from functools import partial

    from lodestar.llm import common

    texts = ["a b c d e", "a b c d e", "p q r s t u", None, "", "x y z v w k", "x y z v w k"]
    docs = docs_frame(spark, [*texts, (3, "twice here now"), (3, "twice here now"), (None, "p q r s t u")])
    items = spark.createDataFrame([(1, "q r s")], ITEM)
    rows = lambda df: sorted(map(str, df.collect()))
    want = rows(simhash.keep_first(docs)), rows(decontaminate.drop_contaminated(docs, items))
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan(decontaminate.drop_contaminated(docs, items))
    for module in (simhash, decontaminate):
        monkeypatch.setattr(module, "split_listed", partial(common.split_listed, limit=-1))
    assert (rows(simhash.keep_first(docs)), rows(decontaminate.drop_contaminated(docs, items))) == want


def test_near_duplicates_edge_cases(spark):
    docs = docs_frame(spark, [(7, None), (3, ""), (9, " \t"), (4, "a b c d"), (4, "a b c d"), (2, "A B C D"), (None, "a b c d"), (None, "lonely text of its own here")])
    found = simhash.near_duplicates(docs.withColumn("fp", F.lit(1)).withColumn("root", F.lit(2))).collect()
    rows = sorted((str(r["doc_id"]), str(r["component_id"])) for r in found)
    assert rows == [("2", "2"), ("3", "3"), ("4", "2"), ("4", "2"), ("7", "3"), ("9", "3"), ("None", "2"), ("None", "None")]
    assert simhash.near_duplicates(docs_frame(spark, [])).count() == 0
    kept = simhash.keep_first(docs)
    assert kept.columns == docs.columns
    assert sorted((str(r["doc_id"]), r["text"]) for r in kept.collect()) == [("2", "A B C D"), ("3", ""), ("None", "lonely text of its own here")]
    twice = simhash.keep_first(docs_frame(spark, [(1, "a b c"), (1, "a b c"), (5, "q r s t u v w")])).collect()
    assert sorted(r["doc_id"] for r in twice) == [1, 5]
