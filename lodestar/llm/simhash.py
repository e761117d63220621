"""SimHash near-duplicates: fingerprints in Arrow batches, links by a segment-popcount grid join.

A fingerprint maps to the bit counts of its segments. The Manhattan distance of two such vectors is
a lower bound of the fingerprints' Hamming distance, so linked fingerprints lie within ``bits`` of
each other on the grid of counts. The segments are dealt into ``blocks`` blocks; of two points
within ``bits``, at least ``blocks - bits`` blocks agree in every coordinate. Each fingerprint is
thus filed in the grid cells of every choice of ``blocks - bits`` blocks, and only members of one
cell are compared: a range search on the total count, then the Manhattan bound, then the exact
distance. A cell with more than ``CELL`` members (near copies of one document) goes on to the next,
finer grid together with all members of such cells; the segments of the last grid are single bits,
which are their own counts, so that its cells hold at most 4096 distinct fingerprints by construction:
no cell grows with the data and no link is lost. A cell emits a forest of its links, not all its pairs.
Components come from alternating large-star and small-star steps over tables in the shared folder;
nodes with more than ``HOT`` links, of which there are at most twice the links over ``HOT``, meet their
neighbours by a broadcast.

Defined results: null or word-less text has fingerprint 0, which links like any other. Very long texts
are hashed whole, in memory in proportion to the longest one. Repeated rows share a component. Of equal
component members the least doc_id names the component. A null doc_id gets its group's component and
never names one, unless the group has no other id (component null). An empty table gives no rows. Extra
columns are ignored, whatever their names, and kept by ``keep_first``.
"""

from __future__ import annotations

import itertools
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestar.llm.common import LOWER, UPPER, map_texts, materialize, split_listed, text_key

WORD = re.compile(r"[^\x20\x09-\x0D]+")
#: Members above which a cell is refined on the next grid.
CELL = 2048
#: Shingles whose bits are unpacked at once.
CHUNK = 65_536
#: The later grids: (bits of a segment, blocks). 16 blocks of 4 bits leave at most 2**12 members.
FINER = ((2, 8), (1, 16))
#: Links of a node above which its neighbours are not shuffled to it.
HOT = 1_000_000


def fingerprint(text: str | None, shingle: int = 3, seed: int = 42) -> int:
    """64-bit SimHash of word shingles; a bit is set in over half of the shingles' hashes."""
    low = (text or "").translate(_TO_LOWER)
    w = [x.encode() for x in WORD.findall(low)]
    if not w:
        return 0
    digest, join = xxhash.xxh64_intdigest, b" ".join
    if len(w) < shingle:
        return digest(join(w), seed)  # one hash: its bits are the majority
    hashes = np.fromiter((digest(join(x), seed) for x in zip(*(w[i:] for i in range(shingle)), strict=False)), dtype="<u8", count=len(w) - shingle + 1)
    ones = np.zeros(64, dtype=np.int64)
    for at in range(0, len(hashes), CHUNK):
        ones += np.unpackbits(hashes[at : at + CHUNK].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<u8")[0])


_TO_LOWER = str.maketrans(UPPER, LOWER)


def fingerprints(docs: DataFrame, shingle: int = 3, seed: int = 42, keys: tuple[str, ...] | list[str] = ("doc_id",)) -> DataFrame:
    """The ``keys`` and fp: the fingerprint as a signed long."""

    def make():
        def run(texts: list) -> list:
            return [np.array([fingerprint(x, shingle, seed) for x in texts], dtype=np.uint64).view(np.int64)]

        return run

    return map_texts(docs, keys, "text", make, [T.StructField("fp", T.LongType())])


def blocks_for(n: int) -> int:
    """Blocks of the first grid: more as the distinct fingerprints grow, so that cells stay small."""
    return 6 if n <= 4_000_000 else 7 if n <= 100_000_000 else 8 if n <= 1_000_000_000 else 10


def _masks(width: int, blocks: int, bits: int) -> list[int]:
    """For each choice of blocks that agree, the bits of the packed counts that form the cell."""
    segments = 64 // width
    edges = [segments * i // blocks for i in range(blocks + 1)]
    of = [sum(((1 << width) - 1) << (width * s) for s in range(edges[b], edges[b + 1])) for b in range(blocks)]
    return [sum(of[b] for b in choice) for choice in itertools.combinations(range(blocks), blocks - bits)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def cells(fps: DataFrame, width: int, blocks: int, bits: int) -> DataFrame:
    """(fp, c, cell): the grid cells of each fingerprint, one for every choice of blocks."""
    # counts of all 2-bit segments at once, each in its own two bits; a 1-bit segment is its count
    half = F.shiftrightunsigned("fp", 1)
    even = F.lit(0x5555555555555555)
    both = F.shiftleft(F.col("fp").bitwiseAND(half).bitwiseAND(even), 1)
    counts = F.col("fp") if width == 1 else F.col("fp").bitwiseXOR(half).bitwiseAND(even).bitwiseOR(both)
    choices = F.array(*[F.struct(F.lit(i).alias("c"), F.lit(_signed(m)).alias("m")) for i, m in enumerate(_masks(width, blocks, bits))])
    every = fps.select("fp", counts.alias("counts")).select("fp", "counts", F.explode(choices).alias("x"))
    return every.select("fp", F.col("x.c").alias("c"), F.col("counts").bitwiseAND(F.col("x.m")).alias("cell"))


def _forest(x: np.ndarray, bits: int) -> list[tuple[int, int]]:
    """Links that connect the members of one cell just as all links within ``bits`` would."""
    total = np.bitwise_count(x).astype(np.int16)
    order = np.argsort(total, kind="stable")
    x, total = x[order], total[order]
    grid = np.stack([np.bitwise_count((x >> np.uint64(s)) & np.uint64(0xFFFF)) for s in range(0, 64, 16)], axis=1).astype(np.int16)
    low, high = np.searchsorted(total, total - bits), np.searchsorted(total, total + bits, side="right")
    open_, out = np.ones(len(x), dtype=bool), []
    for first in range(len(x)):
        if not open_[first]:
            continue
        open_[first] = False
        todo = [first]
        while todo:
            i = todo.pop()
            near = low[i] + np.flatnonzero(open_[low[i] : high[i]])
            near = near[np.abs(grid[near] - grid[i]).sum(axis=1) <= bits]  # the lower bound
            near = near[np.bitwise_count(x[near] ^ x[i]) <= bits]
            open_[near] = False
            out += [(i, j) for j in near.tolist()]
            todo += near.tolist()
    return [(int(x[i]), int(x[j])) for i, j in out]


def _links(bits: int):
    """For mapInArrow over (c, cell, fp) sorted by cell: the links of each cell."""

    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def pack(pairs: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], schema=schema)

    def solve(key: np.ndarray, fp: np.ndarray) -> Iterator[pa.RecordBatch]:
        cut = np.flatnonzero(np.any(key[1:] != key[:-1], axis=1)) + 1
        begin, end = np.concatenate([[0], cut]), np.concatenate([cut, [len(fp)]])
        size = end - begin
        two = begin[size == 2]
        a, b = fp[two], fp[two + 1]
        ok = np.bitwise_count((a ^ b).view(np.uint64)) <= bits
        out = [np.stack([np.minimum(a, b), np.maximum(a, b)], axis=1)[ok]]
        for i in np.flatnonzero(size > 2):
            part = fp[begin[i] : end[i]].view(np.uint64)
            if found := _forest(part, bits):
                out.append(np.sort(np.array(found, dtype=np.uint64).view(np.int64).reshape(-1, 2), axis=1))
        if len(pairs := np.unique(np.concatenate(out), axis=0)):
            yield pack(pairs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, fp = np.empty((0, 2), dtype=np.int64), np.empty(0, dtype=np.int64)
        for batch in batches:
            more = np.stack([batch.column(0).to_numpy().astype(np.int64), batch.column(1).to_numpy()], axis=1)
            key, fp = np.concatenate([key, more]), np.concatenate([fp, batch.column(2).to_numpy()])
            change = np.flatnonzero(np.any(key[1:] != key[:-1], axis=1))
            if len(change):  # the last cell may go on in the next batch
                at = change[-1] + 1
                yield from solve(key[:at], fp[:at])
                key, fp = key[at:], fp[at:]
        if len(fp):
            yield from solve(key, fp)

    return run


def links(fps: DataFrame, bits: int = 3, cell: int = CELL) -> DataFrame:
    """(a, b), a < b: links among distinct fingerprints, enough to give every component."""
    plans, out = ((2, blocks_for(fps.count())), *FINER), None
    for level, (width, blocks) in enumerate(plans):
        filed = cells(fps, width, blocks, bits)
        sizes = filed.groupBy("c", "cell").agg(F.count("*").alias("n")).filter("n > 1")
        sizes = materialize(sizes, "cells")
        last = level == len(plans) - 1
        fit = sizes if last else sizes.filter(F.col("n") <= cell)
        members = filed.join(fit.select("c", "cell"), ["c", "cell"])
        members = members.repartition("c", "cell").sortWithinPartitions("c", "cell")
        found = members.select("c", "cell", "fp").mapInArrow(_links(bits), "a long, b long")
        out = found if out is None else out.union(found)
        hot = sizes.filter(F.col("n") > cell).select("c", "cell")
        if last or hot.isEmpty():
            break
        fps = materialize(filed.join(hot, ["c", "cell"], "left_semi").select("fp").distinct(), "hot")
    return out.distinct()


def _with_least(pairs: DataFrame, least: DataFrame, n: int, hot: int) -> DataFrame:
    """``pairs`` joined with (u, m, n) on u, where ``n`` pairs at most may share one u."""
    if n <= hot:
        return pairs.join(least.select("u", "m"), "u")
    few = F.broadcast(materialize(least.filter(F.col("n") > hot).select("u", "m"), "hot"))  # at most 2 * n / hot rows
    rest = pairs.join(few, "u", "left_anti").join(least.filter(F.col("n") <= hot).select("u", "m"), "u")
    return pairs.join(few, "u").unionByName(rest)


def components(edges: DataFrame, hot: int = HOT) -> DataFrame:
    """(node, root) for every node with a link: root is the component's least node.

    Large-star joins each greater neighbour, small-star each lesser one, to the least neighbour;
    both keep connectivity, and the edges settle as stars in a logarithmic number of rounds.
    """
    edges = materialize(edges.select("a", "b"), "edges")

    def mark(df: DataFrame) -> tuple:
        """Number of edges and sums over them, which the edges of two rounds share only if none changed."""
        h = F.xxhash64("a", "b")
        return tuple(df.agg(F.count("*"), F.sum(h.cast("decimal(20,0)")), F.bit_xor(h), F.sum(F.col("a").cast("decimal(20,0)"))).first())

    seen = mark(edges)
    while seen[0]:
        n = 2 * seen[0]
        both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).union(edges.select("b", "a"))
        least = both.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")).select("u", F.least("u", "m").alias("m"), "n")
        large = _with_least(both.filter("v > u"), least, n, hot).select(F.col("m").alias("a"), F.col("v").alias("b")).distinct()
        large = materialize(large, "large") if n > hot else large
        least = large.groupBy(F.col("b").alias("u")).agg(F.min("a").alias("m"), F.count("*").alias("n"))
        small = _with_least(large.withColumnRenamed("b", "u"), least, n, hot)
        small = small.filter("a <> m").select("m", F.col("a").alias("n")).union(least.select("m", F.col("u").alias("n")))
        edges = materialize(small.select(F.col("m").alias("a"), F.col("n").alias("b")).distinct(), "edges")
        now = mark(edges)
        if now == seen:
            break
        seen = now
    return edges.select(F.col("b").alias("node"), F.col("a").alias("root"))


def _grouped(docs: DataFrame, bits: int, shingle: int, seed: int, cell: int) -> DataFrame:
    """(doc_id, text_key, fp, root, component_id): root is the component's least fingerprint."""
    keyed = docs.select("doc_id", text_key(docs).alias("text_key"), "text")
    printed = materialize(fingerprints(keyed, shingle, seed, ["doc_id", "text_key"]), "fingerprints")
    distinct = materialize(printed.groupBy("fp").agg(F.min("doc_id").alias("first")), "distinct")
    roots = components(links(distinct.select("fp"), bits, cell))
    rooted = distinct.join(roots, distinct["fp"] == roots["node"], "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    named = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    return printed.join(rooted.join(named, "root").select("fp", "root", "component_id"), "fp")


def near_duplicates(docs: DataFrame, bits: int = 3, shingle: int = 3, seed: int = 42, cell: int = CELL) -> DataFrame:
    """(doc_id, fingerprint, component_id) per document; component_id is the least doc_id reachable."""
    return _grouped(docs, bits, shingle, seed, cell).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_first(docs: DataFrame, bits: int = 3, shingle: int = 3, seed: int = 42, cell: int = CELL) -> DataFrame:
    """One document of each component, in the documents' own columns: the one that names it.

    Of rows that share its doc_id one text stays, and rows that repeat it come back once. What goes is
    listed by doc_id and text hash; texts are shuffled only if that list is too long to broadcast, or
    for the rows that repeat a kept one.
    """
    found = _grouped(docs, bits, shingle, seed, cell)
    pairs = materialize(found.groupBy("root", "doc_id", "text_key").agg(F.count("*").alias("n"), F.first("component_id").alias("component_id")), "pairs")
    kept = pairs.filter("component_id is null or doc_id = component_id").groupBy("root").agg(F.min(F.struct("doc_id", "text_key", "n")).alias("x"))
    kept = materialize(kept.select("x.*"), "kept").select(F.col("doc_id").alias("kept_id"), F.col("text_key").alias("kept_key"), F.col("n").alias("kept_n"))
    gone = pairs.join(kept, pairs["doc_id"].eqNullSafe(kept["kept_id"]) & (pairs["text_key"] == kept["kept_key"]), "left_anti")
    _, out = split_listed(docs, materialize(gone.select("doc_id", "text_key"), "gone"))
    again = kept.filter("kept_n > 1").select(F.col("kept_id").alias("doc_id"), F.col("kept_key").alias("text_key"))
    if again.isEmpty():
        return out
    repeated, once = split_listed(out, again)
    return once.unionByName(repeated.dropDuplicates(["doc_id", "text"]))
