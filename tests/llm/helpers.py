"""Plain versions of the contracts, written for clearness and not for speed."""

import re

import numpy as np
from pyspark.sql import types as T

DOCS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType())])
UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def docs_frame(spark, texts, parts=3):
    """Documents numbered from 0 (or given as (id, text)), dealt over several partitions."""
    rows = [(t if isinstance(t, tuple) else (i, t)) for i, t in enumerate(texts)]
    return spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], DOCS).repartition(parts)


def texts_of(spark, sf):
    return {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}


def windows_hit(text, items):
    """n_words, hit words and item ids, by comparing every window with every word."""
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    w = word.findall((text or "").translate(UPPER))
    hit, found = set(), set()
    for item, t in items:
        v = word.findall((t or "").translate(UPPER))
        n = min(len(v), 10)
        for s in range(len(v) - n + 1 if v else 0):
            for i in range(len(w) - n + 1):
                if w[i : i + n] == v[s : s + n]:
                    hit |= set(range(i, i + n))
                    if item is not None:
                        found.add(item)
    return len(w), len(hit), sorted(map(str, found))


def naive_fingerprint(text):
    import xxhash

    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(UPPER))
    sh = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] if len(w) >= 3 else ([" ".join(w)] if w else [])
    h = [xxhash.xxh64_intdigest(s.encode(), seed=42) for s in sh]
    return sum(1 << b for b in range(64) if h and 2 * sum(x >> b & 1 for x in h) > len(h))


def naive_components(prints, bits=3):
    """Least id reachable over links, from all pairs of fingerprints; {id: fp} -> {id: least}."""
    ids = sorted(prints)
    x = np.array([prints[i] for i in ids], dtype=np.uint64)
    root = list(range(len(ids)))

    def find(i):
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    for i in range(len(ids)):
        for j in np.flatnonzero(np.bitwise_count(x ^ x[i]) <= bits):
            a, b = find(i), find(int(j))
            root[max(a, b)] = min(a, b)
    return {d: ids[find(i)] for i, d in enumerate(ids)}
