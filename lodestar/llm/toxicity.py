"""Toxicity by maximum-scoring segments over token log-odds.

Fitting, on a bounded sample of labelled rows (``SAMPLE`` of each label, chosen by a hash of
doc_id): the occurrences of each token or prefix give its log-odds among all of them, under an
informative Dirichlet prior; its error comes from the documents that hold it, in which occurrences go
together. Entries whose lower confidence bound reaches ``BOUND`` form a lexicon of at most
``LEXICON``; the bound is their score. A token scores as its best entry, any other token costs ``GAP``.
Scoring, over whole texts: a linear scan finds all maximal-scoring segments. Under the null model a
segment of score s is expected K n exp(-lambda s) times among n tokens; lambda and K come from the
sample's clean documents. The normalised scores of the best segment and of all significant ones are
combined by a logistic calibration, fitted on all sampled rows, each scanned with a lexicon of the
``PARTS`` - 1 parts of the sample that it is not in.

Defined results: null and empty texts score as documents without tokens. Very long texts are scanned
whole. Labels that are null or neither 0 nor 1 are left out; of repeated labels of one doc_id the greater
holds, of rows that share a labelled id one teaches. Without labels of both kinds every score is 0. A null
doc_id is held out of nothing and never learned from. Of segments of equal score each counts, in order.
Repeated rows each get a row, an empty table gives none. Columns beside doc_id and text are ignored by
``classify`` and kept by ``drop_toxic``, whatever their names.
"""

from __future__ import annotations

import json
import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestar.llm.common import SLICE_ROWS, fold, hashed_sample, map_texts, materialize

WORD = re.compile(r"[^\W\d_]+")
#: Bounds of the fit: labelled rows of each label, lexicon entries, entries of a worker's memo.
SAMPLE, LEXICON, MEMO = 6_000, 20_000, 300_000
PREFIXES = (4, 5, 6, 7)
#: Least bound and least toxic documents of an entry, prior occurrences, cost of another token.
BOUND, LEAST, PRIOR, GAP = 2.0, 5, 10.0, 0.02
#: Standard errors between a log-odds and its bound; the greatest score of an entry.
ERRORS, MOST = 1.28, 10.0
#: Parts of the sample, by the ids' hash: each calibrates by what the others teach.
PARTS = 5


def features(word: str) -> list[str]:
    return [f"={word}", *(f"^{word[:k]}" for k in PREFIXES if len(word) >= k)]


class Memo(dict):
    """Word to its score, filled as words are met and emptied when it is full."""

    def __init__(self, lexicon: dict[str, float]):
        super().__init__()
        self.lexicon = lexicon

    def __missing__(self, word: str) -> float:
        if len(self) >= MEMO:
            self.clear()
        self[word] = value = max((self.lexicon[x] for x in features(word) if x in self.lexicon), default=0.0)
        return value


def segments(hits: list[tuple[int, float]], gap: float = GAP) -> list[tuple[int, int, float]]:
    """All maximal-scoring segments (first token, end, score) in linear time.

    ``hits`` are the tokens of positive score by position; every other token scores -gap. Each open
    candidate keeps the sums before and after it and the nearest earlier one of lesser first sum.
    """
    before: list[float] = []
    after: list[float] = []
    bounds: list[tuple[int, int]] = []
    prior: list[int] = []
    total, at = 0.0, 0
    for p, s in hits:
        low = total - gap * (p - at)
        total, at = low + s, p + 1
        high, first = total, p
        while True:
            j = len(before) - 1
            while j >= 0 and before[j] >= low:
                j = prior[j]
            if j < 0 or after[j] >= high:
                break
            low, first = before[j], bounds[j][0]
            del before[j:], after[j:], bounds[j:], prior[j:]
        before.append(low)
        after.append(high)
        bounds.append((first, p + 1))
        prior.append(j)
    return [(a, b, h - lo) for (a, b), lo, h in zip(bounds, before, after, strict=True)]


def scan(text: str | None, memo: Memo) -> tuple[int, list[tuple[int, int, float]]]:
    """Number of tokens and the maximal segments of a text."""
    words = WORD.findall((text or "").lower())
    scores = list(map(memo.__getitem__, words))
    return len(words), segments([(i, s) for i, s in enumerate(scores) if s])


def evidence(n: int, found: list[tuple[int, int, float]], lam: float, log_k: float) -> list[float]:
    """What the calibration sees: normalised best score, sum over segments, their number, the text's
    length, and the segments' scores by length and in all."""
    room = log_k + math.log(max(n, 1))
    normal = sorted((lam * s - room for _, _, s in found), reverse=True)
    best = normal[0] if normal else -room
    total = sum(s for _, _, s in found)
    return [
        1.0, max(-20.0, min(best, 20.0)), min(sum(x + room for x in normal), 60.0) / 10, math.log1p(len(normal)), 1.0 if normal else 0.0,
        math.log1p(n) / 5, math.log1p(100 * total / max(n, 20)), min(total, 60.0) / 10,
    ]


def _counts(df: DataFrame, only: frozenset | None) -> DataFrame:
    """(token, n_0, docs_0, n_1, ...): by part, occurrences of each feature and documents that hold it,
    summed by slices before the shuffle. The empty token counts the occurrences of all features, whatever
    ``only`` keeps."""
    shared = df.sparkSession.sparkContext.broadcast(only)  # at most 10 * LEXICON entries

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        only = shared.value
        for whole in batches:
            for at in range(0, whole.num_rows, SLICE_ROWS):
                some = whole.slice(at, SLICE_ROWS)
                n: Counter = Counter()
                docs: Counter = Counter()
                for text, part in zip(some.column(0).to_pylist(), some.column(1).to_pylist(), strict=True):
                    own: Counter = Counter()
                    for word, times in Counter(WORD.findall((text or "").lower())).items():
                        for x in features(word):
                            own[x] += times
                    n["", part] += own.total()
                    for x, times in own.items():
                        if only is None or x in only:
                            n[x, part] += times
                            docs[x, part] += 1
                yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in n], pa.string()), pa.array([k for _, k in n], pa.int64()), pa.array(list(n.values()), pa.int64()), pa.array([docs[x] for x in n], pa.int64())], names=["token", "part", "n", "docs"])

    sums = [F.coalesce(F.sum(F.when(F.col("part") == k, F.col(c))), F.lit(0)).alias(f"{c}_{k}") for k in range(PARTS) for c in ("n", "docs")]
    return df.select("text", "part").mapInArrow(run, "token string, part long, n long, docs long").groupBy("token").agg(*sums)


def _by_part(rows: DataFrame) -> dict[str, list[int]]:
    """Token to its occurrences and documents by part."""
    return {r[0]: list(r[1:]) for r in rows.collect()}


def _lexicon(tokens: list[str], toxic: np.ndarray, clean: np.ndarray, total: np.ndarray, parts: list[int]) -> dict[str, float]:
    """Entries and their scores, from the given parts of (token, part, occurrences or documents) counts and
    of the (label, part) occurrences of all features."""
    (y, y_docs), (m, m_docs) = (x[:, parts].sum(axis=1).T.astype(float) for x in (toxic, clean))
    none, every = total[:, parts].sum(axis=1).astype(float)
    a = np.maximum(0.5, PRIOR * (y + m) / max(none + every, 1))
    delta = np.log((y + a) / np.maximum(every - y + 1, 1)) - np.log((m + a) / np.maximum(none - m + 1, 1))
    bound = delta - ERRORS * np.sqrt(1 / (y_docs + 0.5) + 1 / (m_docs + 0.5))  # occurrences in a document go together
    keep = np.flatnonzero((y_docs >= LEAST) & (bound >= BOUND))
    scored = sorted(((min(float(bound[i]), MOST), tokens[i]) for i in keep), reverse=True)
    return {t: b for b, t in scored[:LEXICON]}


def _lambda(hits: list[float], tokens: int) -> float:
    """Root of the mean of exp(lambda score) = 1 over the clean documents' tokens."""
    s, rest = np.array(hits), max(tokens - len(hits), 0)

    def excess(lam: float) -> float:
        return (np.exp(lam * s).sum() + rest * math.exp(-lam * GAP)) / max(tokens, 1) - 1

    low, high = 1e-3, 4.0
    if not len(s) or excess(high) < 0:
        return 1.0
    if excess(low) > 0:  # scores rise on average: no positive root
        return low
    for _ in range(60):
        mid = (low + high) / 2
        low, high = (mid, high) if excess(mid) < 0 else (low, mid)
    return (low + high) / 2


def fit(docs: DataFrame, labels: DataFrame, train: F.Column | None = None, sample: int = SAMPLE) -> dict:
    """The model: lexicon, null-model constants and calibration. ``train`` limits the labels."""
    labels = labels.select("doc_id", F.col("toxic").cast("int").alias("toxic")).filter("toxic in (0, 1) and doc_id is not null")
    labels = (labels if train is None else labels.filter(train)).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    labels = materialize(labels, "labels")
    share = {r["toxic"]: r["n"] for r in labels.groupBy("toxic").agg(F.count("*").alias("n")).collect()}  # two rows
    if len(share) < 2:
        return {"lexicon": {}, "lam": 1.0, "log_k": 0.0, "weights": None}
    some = [hashed_sample(labels.filter(F.col("toxic") == k), "doc_id", sample, share[k]) for k in (0, 1)]
    rows = docs.select("doc_id", "text").join(F.broadcast(some[0].unionByName(some[1])), "doc_id")  # at most 2 * sample ids
    rows = rows.groupBy("doc_id", "toxic").agg(F.min("text").alias("text"))  # ids may repeat
    rows = materialize(rows.withColumn("part", F.pmod(F.xxhash64("doc_id", F.lit(7)), F.lit(PARTS))), "labelled")
    counts = materialize(_counts(rows.filter("toxic = 1"), None), "toxic-counts")
    docs_of = sum(F.col(f"docs_{k}") for k in range(PARTS))
    toxic = _by_part(counts.filter(docs_of >= LEAST).orderBy(docs_of.desc(), "token").limit(10 * LEXICON))
    clean = _by_part(_counts(rows.filter("toxic = 0"), frozenset(toxic)))  # no more tokens than toxic has
    none, every = [0] * 2 * PARTS, list(range(PARTS))
    total = np.array([found.get("", none) for found in (clean, _by_part(counts.filter("token = ''")))]).reshape(2, PARTS, 2)[:, :, 0]
    tokens = list(toxic)
    by = [np.array([x.get(t, none) for t in tokens]).reshape(len(tokens), PARTS, 2) for x in (toxic, clean)]
    lexicon = _lexicon(tokens, *by, total, every)
    # the others of each part, so that no document is judged by what it taught
    shared = docs.sparkSession.sparkContext.broadcast([_lexicon(tokens, *by, total, [x for x in every if x != k]) for k in every])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memos = [Memo(x) for x in shared.value]
        for whole in batches:
            for at in range(0, whole.num_rows, SLICE_ROWS):
                some = whole.slice(at, SLICE_ROWS)
                out: list[tuple] = []
                for label, part, text in zip(*(c.to_pylist() for c in some.columns), strict=True):
                    n, found = scan(text, memos[part])
                    hits = [s for s in map(memos[part].__getitem__, WORD.findall((text or "").lower())) if s]
                    out.append((label, n, [s for _, _, s in found], hits))
                kinds = (pa.int32(), pa.int64(), pa.list_(pa.float64()), pa.list_(pa.float64()))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], names=["toxic", "n", "s", "hits"])

    seen = rows.select("toxic", "part", "text").mapInArrow(run, "toxic int, n long, s array<double>, hits array<double>").collect()  # at most 2 * sample rows
    rows = {k: [r for r in seen if r["toxic"] == k] for k in (0, 1)}
    got = {k: [(r["n"], [(0, 0, s) for s in r["s"]]) for r in v] for k, v in rows.items()}
    lam = _lambda([s for r in rows[0] for s in r["hits"]], sum(n for n, _ in got[0]))
    tops = [lam * max(s for _, _, s in f) - math.log(max(n, 1)) for n, f in got[0] if f]
    # without segments the null model saw less than one in all clean tokens
    log_k = float(np.mean(tops)) - 0.5772 if len(tops) > 20 else -math.log(max(sum(n for n, _ in got[0]), 1)) + lam * 5
    log_k = max(min(log_k, 0.0), -12.0)
    x = np.array([evidence(n, f, lam, log_k) for k in (0, 1) for n, f in got[k]]).reshape(-1, 8)
    y = np.array([float(k) for k in (0, 1) for _ in got[k]])
    weight = np.where(y > 0, share[1] / max(len(got[1]), 1), share[0] / max(len(got[0]), 1))
    weights = logistic(x, y, weight / weight.mean()).tolist() if len(x) else None
    return {"lexicon": lexicon, "lam": lam, "log_k": log_k, "weights": weights}


def logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 1.0) -> np.ndarray:
    """Weighted logistic regression by Newton steps."""
    w = np.zeros(x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        grad = x.T @ (weight * (p - y)) + ridge * w
        step = np.linalg.solve((x * (weight * p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w)), grad)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return w


def score(docs: DataFrame, model: dict, significant: float = 0.05) -> DataFrame:
    """(doc_id, score, passages): passages are the segments expected less than ``significant`` times
    by chance, as character offsets with their scores, in JSON."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(model)  # at most LEXICON entries

    def make():
        m = shared.value
        memo, lam, log_k = Memo(m["lexicon"]), m["lam"], m["log_k"]
        w = None if m["weights"] is None else np.array(m["weights"])

        def run(texts: list) -> list:
            scores, passages = [], []
            for text in texts:
                n, found = scan(text, memo)
                scores.append(0.0 if w is None else 1 / (1 + math.exp(-max(-30.0, min(30.0, float(np.dot(evidence(n, found, lam, log_k), w)))))))
                keep = [x for x in found if log_k + math.log(n) - lam * x[2] <= math.log(significant)]
                if keep:
                    # lower() may change lengths, so the offsets are those in the lower-cased text
                    at = [m.span() for m in WORD.finditer(text.lower())]
                    keep = [[at[a][0], at[b - 1][1], round(s, 4)] for a, b, s in keep]
                passages.append(json.dumps(keep))
            return [scores, passages]

        return run

    return map_texts(docs, ["doc_id"], "text", make, [T.StructField("score", T.DoubleType()), T.StructField("passages", T.StringType())])


def classify(docs: DataFrame, labels: DataFrame, mod: int = 5, held: int = 0) -> DataFrame:
    """(doc_id, held_out, score, predicted, passages), learned from labels outside the held fold."""
    model = fit(docs, labels, fold(F.col("doc_id"), mod) != held)
    out = score(docs, model)
    held_out = F.coalesce(fold(F.col("doc_id"), mod) == held, F.lit(False))
    return out.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "passages")


def drop_toxic(docs: DataFrame, labels: DataFrame, mod: int = 5, held: int = 0) -> DataFrame:
    """The documents that score under 0.5, in their own columns: scored row by row, no join."""
    model = fit(docs, labels, fold(F.col("doc_id"), mod) != held)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        if m["weights"] is None:
            yield from batches
            return
        memo, w = Memo(m["lexicon"]), np.array(m["weights"])
        for whole in batches:
            for at in range(0, whole.num_rows, SLICE_ROWS):
                part = whole.slice(at, SLICE_ROWS)
                texts = part.column(part.schema.get_field_index("text")).to_pylist()
                clean = [float(np.dot(evidence(*scan(x, memo), m["lam"], m["log_k"]), w)) < 0 for x in texts]
                yield part.filter(pa.array(clean, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
