"""Quality rules: a decision list learned by sequential covering, applied as Spark conditions.

Statistics of each whole text come from Arrow batches. On at most ``SAMPLE`` labelled documents of each
label, which weigh as all of their label do, rules for low quality are grown condition by condition (information gain), pruned on rows kept
apart, and accepted while they stay precise; covered rows are removed before the next rule. The
ordered rules become one Spark CASE expression over the statistics: the first that holds decides.

Defined results: null text has no words and fails the base rules, as does any text under 10 words.
Labels that are null or neither 0 nor 1 teach nothing; without labels of both kinds the list is
empty and the base rules decide alone. Of repeated labels of one doc_id the lesser holds, of rows that
share a labelled id one teaches. Very long texts are counted whole, in flat arrays. Conditions include
their threshold, so ties fall on the rule's side; of rules of equal gain the first found is taken.
Repeated rows each get a row, an empty table gives none. Columns beside doc_id and text are ignored,
whatever their names.
"""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestar.llm.common import hashed_sample, map_texts, materialize

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SYMBOLS = "#*$%&|<>"
_NO_SYMBOL = str.maketrans("", "", SYMBOLS)
#: Words above which repeats are found in flat arrays, which hold a long text in less memory.
LONG = 50_000
SAMPLE, RULES, CONDITIONS, PRECISION = 6_000, 12, 3, 0.9
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_distinct", "n_upper", "n_marks")


def repeated_words(words: list[str]) -> int:
    """Words inside windows of five that occur more than once."""
    windows = list(zip(words, words[1:], words[2:], words[3:], words[4:], strict=False))
    if len(set(windows)) == len(windows):
        return 0
    often = {w for w, c in Counter(windows).items() if c > 1}
    repeat = end = 0
    for i, w in enumerate(windows):
        if w in often:
            repeat += i + 5 - max(i, end)
            end = i + 5
    return repeat


def repeated_words_long(words: list[str]) -> int:
    """The same in flat arrays: windows are numbered by pairs of numbered parts, without hashing."""
    ids: dict[str, int] = {}
    one = np.fromiter((ids.setdefault(w, len(ids)) for w in words), dtype=np.int64, count=len(words))

    def numbered(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return np.unique(a * len(words) + b, return_inverse=True)[1]

    two = numbered(one[:-1], one[1:])
    four = numbered(two[:-2], two[2:])
    five = numbered(four[:-1], one[4:])
    often = np.flatnonzero(np.bincount(five)[five] > 1)
    if not len(often):
        return 0
    return int(np.minimum(np.diff(often), 5).sum()) + 5


def statistics(text: str | None) -> tuple[int, ...]:
    """The COUNTS of a whole text."""
    text = text or ""
    words = WORD.findall(text)
    n = len(words)
    seen: set[str] = set()
    lines = dup = 0
    for line in text.split("\n"):
        if line in seen:
            lines, dup = lines + 1, dup + 1
        elif WORD.search(line):
            lines += 1
            seen.add(line)
    repeat = repeated_words(words) if n <= LONG else repeated_words_long(words)
    chars = sum(map(len, words))
    symbols = len(text) - len(text.translate(_NO_SYMBOL)) if any(c in text for c in SYMBOLS) else 0
    upper = sum(map(str.isupper, words))
    return n, chars, symbols, dup, repeat, lines, len(set(words)), upper, text.count("!") + text.count("?")


def counting():
    return lambda texts: [list(c) for c in zip(*map(statistics, texts), strict=True)] or [[] for _ in COUNTS]


def measure(docs: DataFrame) -> DataFrame:
    """(doc_id, COUNTS) of every document."""
    return map_texts(docs, ["doc_id"], "text", counting, [T.StructField(c, T.LongType()) for c in COUNTS])


def ratios() -> dict[str, Column]:
    """What the rules are made of, as columns over the counts."""
    words, lines = F.greatest(F.col("n_words"), F.lit(1)), F.greatest(F.col("n_lines"), F.lit(1))
    return {
        "n_words": F.col("n_words").cast("double"),
        "mean_word": F.col("word_chars") / words,
        "symbols": F.col("n_symbols") / words,
        "dup_lines": F.col("n_dup_lines") / lines,
        "repeats": F.col("n_repeat_words") / words,
        "distinct": F.col("n_distinct") / words,
        "upper": F.col("n_upper") / words,
        "marks": F.col("n_marks") / words,
    }


def _gain(p: float, n: float, p0: float, n0: float) -> float:
    return p * (np.log2(p / (p + n)) - np.log2(p0 / (p0 + n0))) if p else 0.0


def _cover(x: np.ndarray, rule: list[tuple[int, str, float]]) -> np.ndarray:
    ok = np.ones(len(x), dtype=bool)
    for j, op, t in rule:
        ok &= x[:, j] >= t if op == ">=" else x[:, j] <= t
    return ok


def _grow(x: np.ndarray, y: np.ndarray, weight: tuple[float, float]) -> list[tuple[int, str, float]]:
    """Conditions by greatest information gain, until no other row is mixed or none gains."""
    rule: list[tuple[int, str, float]] = []
    while len(rule) < CONDITIONS and len(x) and (n0 := weight[0] * float((~y).sum())) > 0:
        p0, best = weight[1] * float(y.sum()), (1e-6, None)
        for j in range(x.shape[1]):
            cuts = np.unique(np.quantile(x[:, j], np.linspace(0, 1, 65)))
            order = np.sort(x[y, j]), np.sort(x[~y, j])
            for op in (">=", "<="):
                side = "left" if op == ">=" else "right"
                p, n = (np.searchsorted(o, cuts, side=side) for o in order)
                if op == ">=":
                    p, n = len(order[0]) - p, len(order[1]) - n
                for t, a, b in zip(cuts, p, n, strict=True):
                    if (g := _gain(weight[1] * float(a), weight[0] * float(b), p0, n0)) > best[0]:
                        best = (g, (j, op, float(t)))
        if best[1] is None:
            break
        rule.append(best[1])
        ok = _cover(x, rule[-1:])
        x, y = x[ok], y[ok]
    return rule


def _share(y: np.ndarray, weight: tuple[float, float]) -> float:
    """Weighted share of the rows with y true."""
    p, n = weight[1] * y.sum(), weight[0] * (~y).sum()
    return float(p / (p + n)) if p + n else 0.0


def _prune(x: np.ndarray, y: np.ndarray, rule: list, weight: tuple[float, float]) -> list:
    """The prefix of the rule that is worth most on rows it was not grown on."""

    def worth(r: list) -> float:
        ok = _cover(x, r)
        return 2 * _share(y[ok], weight) - 1 if ok.any() else 0.0

    return max((rule[:k] for k in range(1, len(rule) + 1)), key=worth) if rule else rule


def learn(x: np.ndarray, y: np.ndarray, seed: int = 7, weight: tuple[float, float] = (1.0, 1.0)) -> list[list[tuple[int, str, float]]]:
    """Ordered rules for rows with y true: sequential covering with a fresh split for each rule.

    ``weight`` is what a row with y false, and one with y true, stands for.
    """
    rng, rules = np.random.default_rng(seed), []
    while len(rules) < RULES and y.sum() >= 10:
        keep = rng.random(len(x)) < 2 / 3
        rule = _prune(x[~keep], y[~keep], _grow(x[keep], y[keep], weight), weight)
        ok = _cover(x, rule)
        apart = ok & ~keep
        if not rule or (y & ok).sum() < 5 or _share(y[ok], weight) < PRECISION or (apart.any() and _share(y[apart], weight) < PRECISION):
            break
        rules.append(rule)
        x, y = x[~ok], y[~ok]
    return rules


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> list[list[tuple[str, str, float]]]:
    """Rules by name, from at most ``sample`` labelled documents of each label."""
    labels = labels.select("doc_id", F.col("quality").cast("int").alias("quality")).filter("quality in (0, 1) and doc_id is not null")
    labels = materialize(labels.groupBy("doc_id").agg(F.min("quality").alias("quality")), "labels")
    share = {r["quality"]: r["n"] for r in labels.groupBy("quality").agg(F.count("*").alias("n")).collect()}  # two rows
    if len(share) < 2:
        return []
    some = [hashed_sample(labels.filter(F.col("quality") == k), "doc_id", sample, share[k]) for k in (0, 1)]
    some = some[0].unionByName(some[1])
    rows = docs.select("doc_id", "text").join(F.broadcast(some), "doc_id")  # at most 2 * sample ids
    rows = rows.groupBy("doc_id", "quality").agg(F.min("text").alias("text"))  # ids may repeat
    named = ratios()
    got = map_texts(rows, ["doc_id", "quality"], "text", counting, [T.StructField(c, T.LongType()) for c in COUNTS]).orderBy("doc_id")
    data = np.array([list(r) for r in got.select("quality", *[c.alias(k) for k, c in named.items()]).collect()], dtype=float)
    if not len(data):
        return []
    names, low = list(named), data[:, 0] == 0
    weight = share[1] / max((~low).sum(), 1), share[0] / max(low.sum(), 1)
    return [[(names[j], op, t) for j, op, t in rule] for rule in learn(data[:, 1:], low, weight=tuple(w / max(weight) for w in weight))]


def verdict(rules: list[list[tuple[str, str, float]]]) -> Column:
    """The decision list as an ordered Spark conditional: true keeps the document."""
    named = ratios()
    out = None
    for rule in rules:
        held = F.lit(True)
        for name, op, t in rule:
            held = held & (named[name] >= t if op == ">=" else named[name] <= t)
        out = F.when(held, False) if out is None else out.when(held, False)
    return F.lit(True) if out is None else out.otherwise(True)


def judge(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, the five base counts, base_failed, kept) of every document."""
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    return measure(docs).select("doc_id", *COUNTS[:5], failed.alias("base_failed"), (~failed & verdict(fit(docs, labels))).alias("kept"))
