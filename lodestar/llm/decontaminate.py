"""Benchmark decontamination by winnowing, in DataFrame functions only.

Texts become arrays of 64-bit word hashes. A k-gram hash is kept wherever it is the least of a
window of ``window - k + 1`` k-grams (ties keep all), so that any ``window`` consecutive words
shared by a document and an item keep at least one common k-gram on both sides. A document's kept
k-grams carry the few word hashes around them; those that occur among the benchmark's fingerprints
are extended to every window that holds them, and the windows are joined with the benchmark's
distinct windows. Items of fewer words are looked for where a bitmap has their first word. No document
text is shuffled and no pairs of documents and items are made for each hit: a window brings the number of
its list of items, which a document meets once.

Defined results: null or empty text has no words and no hits; very long texts are searched whole. An empty
table of items hits nothing, one of documents gives no rows. Items without words match nothing;
items of fewer than ``window`` words match as a whole. Repeated benchmark rows count once per
item_id, items with a null id mark words but are not listed. Repeated documents each get a row;
rows of one doc_id with other texts are judged by their own text. Equal hashes in a window (ties) are all
kept. Extra columns are ignored, whatever their names, and kept by ``drop_contaminated``.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestar.llm.common import ascii_lower, hinted, materialize, split_listed, text_key

#: Java form of a run of characters that are in no word, after lower-casing A-Z.
NON_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Broadcast at most so many fingerprints (24 bytes each) and windows (about 150 bytes each).
MAX_FINGERPRINTS, MAX_WINDOWS = 1_000_000, 200_000


def words(text: Column) -> Column:
    """Lower-cased words; a null text has none."""
    return F.coalesce(F.array_remove(F.split(ascii_lower(text), NON_WORD), ""), F.array().cast("array<string>"))


def _steps(n: Column) -> Column:
    """0 .. n-1, empty unless n is positive."""
    return F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))


def _fingerprints(df: DataFrame, k: int, window: int) -> DataFrame:
    """Adds kg (hash of each k-gram) and least (of each window) to a frame with wh (word hashes).

    Each stays a column of its own: their uses in lambdas must read them, not compute them again.
    """
    span = window - k + 1
    df = df.withColumn("kg", F.transform(_steps(F.size("wh") - (k - 1)), lambda i: F.xxhash64(*[F.col("wh")[i + j] for j in range(k)])))
    return df.withColumn("least", F.transform(_steps(F.size("kg") - (span - 1)), lambda i: F.least(*[F.col("kg")[i + j] for j in range(span)])))


def _selected(window: int, span: int) -> Column:
    """The kept k-grams of a document by the windows they are least of: (fp, first, near).

    One entry stands where the least hash changes and serves the windows first .. first + 2 * span - 1,
    as a hash is least of at most span windows in a row unless it occurs again within them. Where it
    does, every span-th window gets an entry too. near holds the word hashes of all those windows.
    """
    m, i0 = F.col("least"), lambda i: F.greatest(i - 1, F.lit(0))
    again = lambda i: (i % span == 0) & (m[F.greatest(i - span, F.lit(0))] == m[i])
    kept = F.filter(_steps(F.size("least")), lambda i: (i == 0) | (m[i0(i)] != m[i]) | again(i))
    return F.transform(kept, lambda i: F.struct(m[i].alias("fp"), i.alias("first"), F.slice("wh", i + 1, window + 2 * span - 1).alias("near")))


#: 64-bit words of the bitmap of first words by which short items are looked for: 2**18 bits.
BITMAP = 4096


def _first_words(short: DataFrame) -> Column:
    """A bitmap of the hashes of the windows' first words, as an array of BITMAP longs."""
    h = F.col("win")[0]
    place, bit = F.shiftrightunsigned(h, 6).bitwiseAND(BITMAP - 1).cast("int"), h.bitwiseAND(63).cast("int")
    rows = short.select(place.alias("place"), bit.alias("bit")).groupBy("place").agg(F.bit_or(F.expr("shiftleft(1L, bit)")).alias("bits"))
    bits = np.zeros(BITMAP, dtype=np.int64)
    for r in rows.collect():  # at most BITMAP rows
        bits[r["place"]] = r["bits"]
    return F.lit(bits).cast("array<bigint>")


def _grams(n: int, bitmap: Column) -> Column:
    """(start, win) of a document's n-grams whose first word may begin a short item."""

    def may(i: Column) -> Column:
        h = F.col("wh")[i]
        word = F.get(bitmap, F.shiftrightunsigned(h, 6).bitwiseAND(BITMAP - 1).cast("int"))
        return F.call_function("shiftrightunsigned", word, h.bitwiseAND(63).cast("int")).bitwiseAND(1) == 1

    return F.transform(F.filter(_steps(F.size("wh") - (n - 1)), may), lambda i: F.struct(i.alias("start"), F.slice("wh", i + 1, n).alias("win")))


def benchmark_windows(items: DataFrame, window: int) -> DataFrame:
    """(win, items): each distinct window as word hashes, with the ids of the items that hold it."""
    rows = items.select(F.col("item_id").alias("item"), F.transform(words(F.col("text")), lambda x: F.xxhash64(x)).alias("wh")).filter(F.size("wh") > 0)
    starts = F.transform(_steps(F.greatest(F.size("wh") - (window - 1), F.lit(1))), lambda i: F.slice("wh", i + 1, window))
    return rows.select("item", F.explode(starts).alias("win")).groupBy("win").agg(F.collect_set("item").alias("items"))


def hits(docs: DataFrame, items: DataFrame, k: int = 5, window: int = 10) -> DataFrame:
    """(doc_id, text_key, spans, items): where windows of the benchmark occur in each document.

    spans is the sorted array of (start, len) in words, items the ids whose windows occur.
    """
    windows = materialize(benchmark_windows(items, window), "windows")
    lengths = {r["n"]: r["c"] for r in windows.groupBy(F.size("win").alias("n")).agg(F.count("*").alias("c")).collect()}  # at most `window` rows
    docs = docs.select("doc_id", text_key(docs).alias("text_key"), words(F.col("text")).alias("w"))
    docs = docs.select("doc_id", "text_key", F.transform("w", lambda x: F.xxhash64(x)).alias("wh"))
    found = []
    if lengths.get(window):
        own = _fingerprints(windows.filter(F.size("win") == window).withColumnRenamed("win", "wh"), k, window)
        prints = materialize(own.select(F.explode("least").alias("fp")).distinct(), "prints")
        span = window - k + 1
        near = _fingerprints(docs, k, window).select("doc_id", "text_key", F.explode(_selected(window, span)).alias("x")).select("doc_id", "text_key", "x.*")
        near = near.join(hinted(prints, prints.count(), MAX_FINGERPRINTS), "fp", "left_semi")
        near = near.select("doc_id", "text_key", "first", "near", F.explode(F.sequence(F.lit(0), F.size("near") - window)).alias("j"))
        found.append(near.select("doc_id", "text_key", (F.col("first") + F.col("j")).alias("start"), F.slice("near", F.col("j") + 1, window).alias("win")))
    for n in sorted(x for x in lengths if x < window):
        bitmap = _first_words(windows.filter(F.size("win") == n))
        some = docs.select("doc_id", "text_key", F.explode(_grams(n, bitmap)).alias("x"))
        found.append(some.select("doc_id", "text_key", "x.*"))
    if not found:
        found.append(docs.select("doc_id", "text_key", F.lit(0).alias("start"), F.col("wh").alias("win")).limit(0))
    every = found[0]
    for more in found[1:]:
        every = every.unionByName(more)
    named = windows.withColumn("held", F.xxhash64(F.array_sort("items")))  # windows of the same items
    every = every.join(hinted(named.select("win", "held"), sum(lengths.values()), MAX_WINDOWS), "win")
    every = every.groupBy("doc_id", "text_key", "held").agg(F.collect_set(F.struct("start", F.size("win").alias("len"))).alias("spans"))
    sets = named.groupBy("held").agg(F.first("items").alias("items"))  # no more than windows
    every = every.join(hinted(sets, sum(lengths.values()), MAX_WINDOWS), "held")
    return every.groupBy("doc_id", "text_key").agg(
        F.sort_array(F.array_distinct(F.flatten(F.collect_list("spans")))).alias("spans"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("items")
    )


def covered(spans: Column) -> Column:
    """Words inside at least one of the sorted (start, len) spans."""
    start = F.struct(F.lit(0).alias("end"), F.lit(0).alias("n"))

    def step(a: Column, x: Column) -> Column:
        end = x["start"] + x["len"]
        return F.struct(F.greatest(a["end"], end).alias("end"), (a["n"] + F.greatest(F.lit(0), end - F.greatest(a["end"], x["start"]))).alias("n"))

    return F.aggregate(spans, start, step)["n"]


def decontaminate(docs: DataFrame, items: DataFrame, k: int = 5, window: int = 10) -> DataFrame:
    """(doc_id, n_words, n_hit, n_items, items_sha256, contaminated, spans, items) per document."""
    found = hits(docs, items, k, window).withColumnsRenamed({"doc_id": "hit_doc", "text_key": "hit_key"})
    base = docs.select("doc_id", text_key(docs).alias("text_key"), F.size(words(F.col("text"))).cast("long").alias("n_words"))
    joined = base.join(found, base["doc_id"].eqNullSafe(found["hit_doc"]) & (base["text_key"] == found["hit_key"]), "left")
    ids = F.coalesce("items", F.array().cast(found.schema["items"].dataType))
    names = F.array_sort(F.transform(ids, lambda x: x.cast("string")))
    n_hit = F.coalesce(covered(F.col("spans")), F.lit(0)).cast("long")
    return joined.select(
        "doc_id",
        "n_words",
        n_hit.alias("n_hit"),
        F.size(ids).cast("long").alias("n_items"),
        F.sha2(F.array_join(names, ",").cast("binary"), 256).alias("items_sha256"),
        (n_hit > 0).alias("contaminated"),
        "spans",
        ids.alias("items"),
    )


def drop_contaminated(docs: DataFrame, items: DataFrame, k: int = 5, window: int = 10) -> DataFrame:
    """The documents without a hit, in their own columns; texts are shuffled only if the list of the
    others is too long to broadcast."""
    found = materialize(hits(docs, items, k, window).select("doc_id", "text_key"), "contaminated")
    return split_listed(docs, found)[1]
