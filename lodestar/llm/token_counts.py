"""Token counts by a map-side two-tier lookup, without any shuffle of pre-tokens.

Tier one is a broadcast table of frequent pre-tokens and their numbers of ids (``TABLE`` entries
from a sample of ``SAMPLE`` documents, chosen by a hash of doc_id). Tier two is a cache in each
worker that fills with the pre-tokens the table misses. Both only save time: every count is that of
the tokenizer, whatever the sample holds.

Defined results: null is the empty text: 0 bytes, 0 tokens. Very long texts are counted whole; those
with runs of one kind beyond ``bpe.LONG_RUN`` go to the library, as do added tokens. Repeated rows each
get a row; of rows that share an id, one is sampled. An empty table gives no rows. Columns beside doc_id
and text are ignored, whatever their names.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestar.llm.bpe import encoder, vocabulary
from lodestar.llm.common import SLICE_ROWS, hashed_sample, map_texts

SAMPLE, TABLE, CACHE = 2_000, 50_000, 400_000


class Lengths(dict):
    """Tier two over a copy of tier one; emptied to tier one when full."""

    def __init__(self, table: dict[str, int], path: str):
        super().__init__(table)
        self.table, self.encode = table, encoder(path).piece

    def __missing__(self, piece: str) -> int:
        if len(self) >= CACHE + len(self.table):
            self.clear()
            self.update(self.table)
        self[piece] = n = self.encode(piece)
        return n


def frequent(docs: DataFrame, path: str, sample: int = SAMPLE, size: int = TABLE) -> tuple[str, bytes]:
    """The compact table: frequent pre-tokens joined by NUL, and their numbers of ids as bytes.

    One task counts the sample's texts, at most ``sample`` of them: no pre-token is shuffled.
    """
    ids = hashed_sample(docs.select("doc_id").filter("doc_id is not null"), "doc_id", sample)
    some = docs.select("doc_id", "text").join(F.broadcast(ids.distinct()), "doc_id", "left_semi")  # at most `sample` ids
    some = some.groupBy("doc_id").agg(F.min("text").alias("text")).select("text").repartition(1)  # ids may repeat

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = encoder(path)
        c: Counter = Counter()
        for whole in batches:
            for at in range(0, whole.num_rows, SLICE_ROWS):
                for text in whole.slice(at, SLICE_ROWS).column(0).to_pylist():
                    c.update(e.pieces(text or "") or ())
                if len(c) > CACHE:
                    c = Counter({k: v for k, v in c.items() if v > 1})
        best = sorted((k for k, v in c.items() if v > 1 and len(k) < 64 and "\0" not in k), key=lambda k: (-c[k], k))[:size]
        yield pa.RecordBatch.from_arrays([pa.array(["\0".join(best)]), pa.array([bytes(map(e.piece, best))])], names=["pieces", "lens"])

    rows = some.mapInArrow(run, "pieces string, lens binary").collect()  # one row
    return (rows[0]["pieces"], bytes(rows[0]["lens"])) if rows else ("", b"")


def count_tokens(docs: DataFrame, path: str | None = None, limit: int = 1024, sample: int = SAMPLE) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) of every document."""
    path = path or vocabulary()
    shared = docs.sparkSession.sparkContext.broadcast(frequent(docs, path, sample))  # TABLE entries, under 64 bytes each

    def make():
        e = encoder(path)
        lengths = _lengths(shared, path)

        def count(text: str) -> int:
            pieces = e.pieces(text)
            return len(e.ids(text)) if pieces is None else sum(map(lengths.__getitem__, pieces))

        def run(texts: list) -> list:
            texts = [x or "" for x in texts]
            n = [count(x) for x in texts]
            return [[len(x.encode()) for x in texts], n, [x > limit for x in n]]

        return run

    fields = [T.StructField("n_bytes", T.LongType()), T.StructField("n_tokens", T.LongType()), T.StructField("over_limit", T.BooleanType())]
    return map_texts(docs, ["doc_id"], "text", make, fields)


_KEPT: dict = {}


def _lengths(shared, path: str) -> Lengths:
    """The worker's lookup, kept from task to task while the broadcast stays the same."""
    pieces, lens = shared.value
    key = (path, hash(pieces))
    if key not in _KEPT:
        _KEPT.clear()
        _KEPT[key] = Lengths(dict(zip(pieces.split("\0"), lens, strict=False)) if lens else {}, path)
    return _KEPT[key]
