"""Language identification by hyperdimensional profiles.

Each letter has a random vector of ``dim`` signs, drawn from its code point. An n-gram of three
letters (any run of other characters is one blank) binds its letters' vectors, each permuted by its
place, by multiplication. A text bundles the vectors of its n-grams; a language's prototype bundles
the normalised vectors of its documents. The prediction is the prototype of greatest cosine.

Prototypes are fitted on the labelled documents with a letter: on all of a language up to ``SAMPLE``
distinct ids, on about ``SAMPLE`` chosen by a hash of doc_id beyond. Each language is sampled by itself,
so that none is lost at any size.
Defined results: texts that are null or without a letter are ``und`` with score 0, as are all texts
if nothing was learned. Ties go to the language first in order. Null langs and ids teach nothing. Very
long texts are bundled whole, a slice at a time. Repeated rows each get a row and teach each on its own;
an empty table gives no rows. Columns beside doc_id, text and lang are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestar.llm.common import SLICE_ROWS, fold, map_texts

SAMPLE, DIM, SEED = 8_000, 1024, 2_654_435_769
#: N-grams that are bundled at once, characters of a text in a slice, n-gram vectors a worker keeps.
CHARS, SLICE_CHARS, KEPT = 2_000_000, 1_000_000, 16_384


def letter_bits(codes: np.ndarray, dim: int, seed: int) -> np.ndarray:
    """(len(codes), dim) random bits by a counter-based mix of code point, place and seed."""
    with np.errstate(over="ignore"):
        x = codes.astype(np.uint64)[:, None] * np.uint64(dim // 64) + np.arange(dim // 64, dtype=np.uint64)[None, :]
        x = (x + np.uint64(seed)) * np.uint64(0x9E3779B97F4A7C15)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        x = x ^ (x >> np.uint64(31))
    return np.unpackbits(x.view(np.uint8).reshape(len(codes), -1), axis=1)


class Profiler:
    """Bundled n-gram vectors of texts; keeps letters' numbers and n-grams' vectors between calls."""

    def __init__(self, dim: int = DIM, seed: int = SEED):
        self.dim, self.seed = dim, seed
        self.letter = np.fromiter((chr(i).isalpha() for i in range(0x110000)), dtype=bool, count=0x110000)
        self.kept: dict[int, int] = {}
        self.table = np.empty((KEPT, dim), dtype=np.int8)

    def bind(self, keys: np.ndarray) -> np.ndarray:
        """Vectors of n-grams, each key three code points of 21 bits."""
        parts = [letter_bits((keys >> s) & 0x1FFFFF, self.dim, self.seed) for s in (42, 21, 0)]
        bits = np.roll(parts[0], 2, axis=1) ^ np.roll(parts[1], 1, axis=1) ^ parts[2]
        return (1 - 2 * bits.astype(np.int8)).astype(np.int8)

    def vectors(self, keys: np.ndarray) -> np.ndarray:
        rows = np.fromiter((self.kept.get(k, -1) for k in keys.tolist()), dtype=np.int64, count=len(keys))
        new = np.flatnonzero(rows < 0)
        if len(self.kept) + len(new) > KEPT:
            if len(keys) > KEPT:
                return self.bind(keys).astype(np.float32)
            self.kept.clear()
            rows[:], new = -1, np.arange(len(keys))
        if len(new):
            at = np.arange(len(self.kept), len(self.kept) + len(new))
            self.table[at] = self.bind(keys[new])
            self.kept.update(zip(keys[new].tolist(), at.tolist(), strict=True))
            rows[new] = at
        return self.table[rows].astype(np.float32)

    def _grams(self, text: str) -> Iterator[np.ndarray]:
        """Keys of a text's n-grams, a slice of the text at a time; a text without a letter has none."""
        last = np.zeros(1, dtype=np.int64)  # the text begins and ends with a blank
        for at in range(0, len(text), SLICE_CHARS):
            c = np.frombuffer(text[at : at + SLICE_CHARS].lower().encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
            c = np.concatenate([last[-1:], np.where(self.letter[c], c, 0), np.zeros(int(at + SLICE_CHARS >= len(text)), dtype=np.int64)]).astype(np.int64)
            c = np.concatenate([last, c[1:][(c[1:] != 0) | (c[:-1] != 0)]])
            if len(c) > 2:
                yield (c[:-2] << 42) | (c[1:-1] << 21) | c[2:]
            last = c[-2:]

    def profile(self, texts: list[str | None]) -> np.ndarray:
        """(len(texts), dim) bundled vectors; zero where there is no letter."""
        out = np.zeros((len(texts), self.dim), dtype=np.float32)
        keys: list[np.ndarray] = []
        owner: list[int] = []
        held = 0
        for i, text in enumerate(texts):
            for some in self._grams(text or ""):
                keys.append(some)
                owner.append(i)
                held += len(some)
                if held >= CHARS:
                    self._bundle(out, keys, owner)
                    keys, owner, held = [], [], 0
        if keys:
            self._bundle(out, keys, owner)
        return out

    def _bundle(self, out: np.ndarray, keys: list[np.ndarray], owner: list[int]) -> None:
        low, rows = owner[0], owner[-1] - owner[0] + 1
        distinct, place = np.unique(np.concatenate(keys), return_inverse=True)
        row = np.repeat(np.array(owner, dtype=np.int64) - low, [len(k) for k in keys])
        for first in range(0, len(distinct), KEPT):  # many scripts at once come in parts
            some = (place >= first) & (place < first + KEPT)
            part = distinct[first : first + KEPT]
            counts = np.bincount(row[some] * len(part) + place[some] - first, minlength=rows * len(part))
            out[low : low + rows] += counts.reshape(rows, len(part)).astype(np.float32) @ self.vectors(part)


_PROFILER: dict = {}


def profiler(dim: int, seed: int) -> Profiler:
    """One for each worker process."""
    if (dim, seed) not in _PROFILER:
        _PROFILER.clear()
        _PROFILER[dim, seed] = Profiler(dim, seed)
    return _PROFILER[dim, seed]


def _unit(x: np.ndarray) -> np.ndarray:
    norm = np.linalg.norm(x, axis=1, keepdims=True)
    return np.divide(x, norm, out=np.zeros_like(x), where=norm > 0)


def fit(docs: DataFrame, train=None, sample: int = SAMPLE, dim: int = DIM, seed: int = SEED) -> tuple[list[str], np.ndarray]:
    """Languages in order and their unit prototypes, from rows with a lang that ``train`` admits."""
    rows = docs.select("doc_id", "text", "lang").filter("lang is not null and doc_id is not null").filter(F.col("text").rlike(r"\p{L}"))
    rows = rows if train is None else rows.filter(train)
    counts = rows.groupBy("lang").agg(F.countDistinct("doc_id").alias("n"))
    h = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 40))
    some = rows.join(F.broadcast(counts), "lang").filter((F.col("n") <= sample) | (h < (1 << 40) * sample / F.col("n")))  # a row per lang

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = profiler(dim, seed)
        sums: dict[str, np.ndarray] = {}
        for whole in batches:
            for at in range(0, whole.num_rows, SLICE_ROWS):
                part = whole.slice(at, SLICE_ROWS)
                vectors = _unit(p.profile(part.column(0).to_pylist()))
                for lang, v in zip(part.column(1).to_pylist(), vectors, strict=True):
                    sums[lang] = sums.get(lang, 0) + v
        if sums:
            task = TaskContext.get().partitionId()
            yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.string()), pa.array([task] * len(sums), pa.int64()), pa.array([v.astype("<f4").tobytes() for v in sums.values()], pa.binary())], names=["lang", "task", "v"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            for lang, v in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True):
                sums[lang] = sums.get(lang, 0) + np.frombuffer(v, dtype="<f4").astype(np.float64)
        if sums:
            yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.string()), pa.array([v.astype("<f4").tobytes() for v in sums.values()], pa.binary())], names=["lang", "v"])

    parts = some.select("text", "lang").mapInArrow(run, "lang string, task long, v binary")
    sums = parts.repartition("lang").sortWithinPartitions("lang", "task").mapInArrow(add, "lang string, v binary")
    total = {r["lang"]: np.frombuffer(r["v"], dtype="<f4") for r in sums.collect()}  # a vector per lang
    langs = sorted(k for k, v in total.items() if np.any(v))
    return langs, _unit(np.array([total[k] for k in langs], dtype=np.float32).reshape(len(langs), dim))


def identify(docs: DataFrame, model: tuple[list[str], np.ndarray], dim: int = DIM, seed: int = SEED) -> DataFrame:
    """(doc_id, lang_pred, score) of every document; score is the cosine, at least 0."""
    langs, prototypes = model

    def make():
        p = profiler(dim, seed)

        def run(texts: list) -> list:
            vectors = _unit(p.profile(texts))
            if not langs:
                return [["und"] * len(texts), [0.0] * len(texts)]
            cosine = vectors @ prototypes.T
            best = cosine.argmax(axis=1)
            known = vectors.any(axis=1)
            names = [langs[b] if k else "und" for b, k in zip(best, known, strict=True)]
            return [names, np.where(known, np.clip(cosine[np.arange(len(texts)), best], 0, 1), 0).astype(float)]

        return run

    return map_texts(docs, ["doc_id"], "text", make, [T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])


def held_out_languages(docs: DataFrame, mod: int = 3, held: int = 1) -> DataFrame:
    """(doc_id, held_out, lang_pred, score), learned from rows outside the held fold."""
    out = identify(docs, fit(docs, fold(F.col("doc_id"), mod) != held))
    return out.select("doc_id", F.coalesce(fold(F.col("doc_id"), mod) == held, F.lit(False)).alias("held_out"), "lang_pred", "score")
