"""Language-model scores by masked pseudo-likelihood.

A small network predicts every token from the tokens on both its sides: embeddings of ``SIDE`` tokens
before and after it, one hidden layer, a softmax over ``CLASSES`` classes and another over the members
of the token's class. The most frequent ``ALONE`` words are classes alone; the others of the ``WORDS``
most frequent are dealt over the other classes by their endings and beginnings, so that the classes are
of near-equal size, and so are groups of all rarer tokens by ending and beginning. A token's probability is that of its class, times that of its member, times, in a group, its
own share of the group in the corpus. A document scores the sum of its tokens' conditional
log-probabilities.

What the model knows comes from all documents, whose texts are read once and become slices of numbered
tokens. Token counts are summed over the whole corpus; of tokens beyond the ``KNOWN`` most frequent each
group keeps the mass and the number of kinds, which share it evenly. The network trains in numpy: the
documents are dealt by a hash of id and text into logical shards of about ``SHARD`` tokens, in each of
``ROUNDS`` rounds every shard starts from the shared weights, takes each document's every ``STRIDE``-th
token as an example, in a fixed order, and hands its weights on; their average, by numbers of examples,
starts the next round. The rounds begin at different places, and as ``STRIDE`` is ``ROUNDS``, they make
an example of every token of the corpus, once. Shards, orders and sums do not depend on the number of
partitions, cores or files, nor do the weights. Weights are summed in blocks, streamed in a fixed
order, so the sum takes bounded memory whatever the number of shards.

Defined results: null, empty and token-less texts have no tokens, log-likelihood 0, mean 0 and
perplexity 1. Very long texts count like any other, in memory in proportion to the longest one. Repeated
rows each get a row, and each counts. Tokens of one count are ordered by their hash. A corpus without
tokens, or an empty table, trains nothing. Columns beside doc_id and text are ignored, whatever their
names.
"""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestar.llm.common import SLICE_ROWS, materialize

TOKEN = re.compile(r"\w+|[^\w\s]")
#: The same, and a mark that stands between runs, which hold no line ends.
MARKED = re.compile(rf"{TOKEN.pattern}|\n")
#: Tokens that are predicted one by one; the most frequent of them are classes alone.
WORDS, ALONE = 6144, 63
#: Endings and beginnings that make the groups; as many classes as endings share the other words.
ENDINGS, BEGINNINGS = 64, 16
GROUPS = ENDINGS * BEGINNINGS
CLASSES = ALONE + ENDINGS
#: Tokens that keep their own count at most, and steps of a doubling above EXACT counts in their choice.
KNOWN, EXACT, STEPS = 1_000_000, 1024, 16
#: Tokens on each side, and the widths of the layers; the last of the hidden one is always one.
SIDE, DIM, HIDDEN = 2, 8, 16
ROUNDS, STRIDE, BATCH, RATE = 2, 2, 8192, 0.3
#: Tokens of a shard on average, and runs between white space in a slice at most but for its last text.
SHARD, SLICE = 2_000_000, 200_000
#: Entries of a partial count; weights in a block; positions in one product, and scored at once.
COUNTS, BLOCK, POSITIONS, SCORED = 1_000_000, 4096, 1024, 32768


def tokens(text: str | None) -> list[str]:
    return TOKEN.findall((text or "").lower())


def code(token: str) -> int:
    """64 bits of a token: its hash above, its group (ending, then beginning) in the low bits."""
    group = zlib.crc32(token[-2:].encode()) % ENDINGS * BEGINNINGS + zlib.crc32(token[:2].encode()) % BEGINNINGS
    h = (xxhash.xxh64_intdigest(token.encode()) & -GROUPS) | group
    return h - (1 << 64) if h >> 63 else h


def strings(a: pa.Array) -> list[str]:
    """What to_pylist() gives for strings without nulls, sooner."""
    return a.to_numpy(zero_copy_only=False).tolist()


def codes_of(tokens: list[str] | pa.Array) -> np.ndarray:
    """The codes of many tokens."""
    if not isinstance(tokens, pa.Array):
        tokens = pa.array(tokens, pa.large_string())
    hashes = np.fromiter(map(xxhash.xxh64_intdigest, strings(tokens)), dtype=np.uint64, count=len(tokens)).view(np.int64)

    def sums(start: int, stop: int | None) -> np.ndarray:
        """The CRC-32 of a part of each, taken of the distinct ones."""
        parts = pc.utf8_slice_codeunits(tokens, start, stop).dictionary_encode()
        return np.array([zlib.crc32(x.encode()) for x in strings(parts.dictionary)], dtype=np.int64).take(parts.indices.to_numpy())

    return (hashes & -GROUPS) | (sums(-2, None) % ENDINGS * BEGINNINGS + sums(0, 2) % BEGINNINGS)


def taken_apart(runs: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray]:
    """The distinct tokens of runs between white space, all their tokens as places among those, in some order
    of runs, and where there each run begins and how many it has. What is ASCII letters and digits is one token
    and skips the pattern, which takes all others in one call."""
    whole = pc.ascii_is_alnum(runs)
    is_whole = whole.to_numpy(zero_copy_only=False)
    others = strings(runs.filter(pc.invert(whole)))
    found = pa.array(MARKED.findall("\n".join(["", *others, ""]) if others else "\n"), runs.type)
    kinds = pa.concat_arrays([found, runs.filter(whole)]).dictionary_encode()  # the mark is the first
    at = kinds.indices.to_numpy()
    length = np.ones(len(runs), dtype=np.int64)
    length[~is_whole] = np.diff(np.flatnonzero(at[: len(found)] == 0)) - 1
    inside = at[at > 0].astype("<u4") - np.uint32(1)
    begin = np.empty(len(runs), dtype=np.int64)
    many = length[~is_whole]
    begin[~is_whole] = np.cumsum(many) - many
    begin[is_whole] = int(many.sum()) + np.arange(len(runs) - len(many))
    return kinds.dictionary.slice(1), inside, begin, length


def slice_tokens(docs: DataFrame) -> DataFrame:
    """Slices of some documents: their ids and numbers of tokens, the codes of their distinct tokens, and all
    tokens as places among those, of 16 bits if they suffice, else 32; binaries of little-endian numbers."""
    kind = docs.schema["doc_id"].dataType
    schema = T.StructType([T.StructField("docs", T.ArrayType(kind)), *(T.StructField(c, T.BinaryType()) for c in ("sizes", "codes", "places"))])
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(schema, prefers_large_types=False)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids: list = []
        texts: list[pa.Array] = []  # lists of the runs between white space
        held = 0

        def cut() -> pa.RecordBatch:
            # no token spans white space, so each distinct run is taken apart once
            kinds = pa.concat_arrays([x.flatten() for x in texts]).dictionary_encode()
            runs = kinds.indices.to_numpy()
            distinct, inside, begin, length = taken_apart(kinds.dictionary)
            many = length.take(runs)
            end = np.cumsum(many)
            where = np.repeat(begin.take(runs) - (end - many), many)
            where += np.arange(len(where))
            flat = inside.take(where)
            size = np.concatenate([x.value_lengths().to_numpy() for x in texts])
            ends = np.concatenate([[0], end])[np.cumsum(size)]  # of the texts
            columns = [
                np.diff(ends, prepend=0).astype("<u4"),
                codes_of(distinct).astype("<i8"),
                flat.astype("<u2") if len(distinct) <= 1 << 16 else flat,
            ]
            return pa.RecordBatch.from_arrays([pa.array([ids], type=arrow.field(0).type), *(pa.array([c.tobytes()], pa.binary()) for c in columns)], schema=arrow)

        for whole in batches:
            for at in range(0, whole.num_rows, SLICE_ROWS):
                part = whole.slice(at, SLICE_ROWS)
                docs = part.column(0).to_pylist()
                # str.lower() knows special cases that Arrow's does not; runs may be empty, and then hold no token
                runs = pc.utf8_split_whitespace(pa.array([(x or "").lower() for x in part.column(1).to_pylist()], pa.large_string()))
                begin = 0
                for end, n in enumerate(runs.value_lengths().to_pylist(), 1):
                    held += n
                    if held >= SLICE or len(ids) + end - begin >= 4 * SLICE_ROWS:
                        ids += docs[begin:end]
                        texts.append(runs.slice(begin, end - begin))
                        yield cut()
                        ids, texts, held, begin = [], [], 0, end
                if begin < len(docs):
                    ids += docs[begin:]
                    texts.append(runs.slice(begin))
        if ids:
            yield cut()

    return docs.select("doc_id", F.col("text").cast("string")).mapInArrow(run, schema)


def placed(codes: bytes, places: bytes) -> tuple[np.ndarray, np.ndarray]:
    """A slice's codes, and its tokens as places among them."""
    c = np.frombuffer(codes, dtype="<i8")
    return c, np.frombuffer(places, dtype="<u2" if len(c) <= 1 << 16 else "<u4")


def count_tokens(slices: DataFrame) -> DataFrame:
    """(code, n) over all documents, summed in each task before the shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes, counts, held = [], [], 0

        def merged() -> tuple[np.ndarray, np.ndarray]:
            kinds, place = np.unique(np.concatenate(codes), return_inverse=True)
            return kinds, np.bincount(place, weights=np.concatenate(counts)).astype(np.int64)

        def batch(kinds: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(kinds), pa.array(n)], names=["code", "n"])

        for part in batches:
            for row in range(part.num_rows):
                c, places = placed(part.column(0)[row].as_py(), part.column(1)[row].as_py())
                codes.append(c)
                counts.append(np.bincount(places, minlength=len(c)))
                held += len(c)
                if held >= COUNTS:
                    kinds, total = merged()
                    codes, counts, held = [kinds], [total], len(kinds)
                    if held >= COUNTS // 2:
                        yield batch(kinds, total)
                        codes, counts, held = [], [], 0
        if held:
            yield batch(*merged())

    return slices.select("codes", "places").mapInArrow(run, "code long, n long").groupBy("code").agg(F.sum("n").alias("n"))


class Vocabulary:
    """Members and their classes, with the own shares of tokens within groups.

    ``codes`` and ``counts`` are the known tokens, ``rest`` by group the mass and the kinds of all others.
    The members of a class have numbers in a row; ``edge`` is one more, for what lies beyond a text.
    """

    def __init__(self, codes: np.ndarray, counts: np.ndarray, rest: dict[int, tuple[int, int]], words: int = WORDS):
        order = np.lexsort((codes, -counts))
        codes, counts = codes[order], counts[order].astype(np.float64)
        self.total = int(counts.sum()) + sum(n for n, _ in rest.values())
        top = min(words, len(codes))
        alone = min(ALONE, top)
        group = codes & (GROUPS - 1)
        mass, kinds = np.zeros(GROUPS), np.zeros(GROUPS)
        for g, (n, k) in rest.items():
            mass[g], kinds[g] = n, k
        even = mass / np.maximum(kinds, 1)
        mass += np.bincount(group[top:], weights=counts[top:], minlength=GROUPS)
        size = np.bincount(group[alone:top], minlength=GROUPS)
        holds, filled = np.zeros(GROUPS, dtype=np.int64), [0] * ENDINGS
        for g in np.argsort(-size, kind="stable").tolist():  # the classes get near-equal numbers of words
            holds[g] = c = filled.index(min(filled))
            filled[c] += int(size[g])
        cls = np.concatenate([np.arange(alone), ALONE + holds[group[alone:top]], ALONE + np.arange(GROUPS) // BEGINNINGS])
        size = np.concatenate([counts[:top], mass])
        by = np.argsort(cls, kind="stable")
        number = np.empty(len(by), dtype=np.int64)
        number[by] = np.arange(len(by))
        self.cls, size = cls[by], size[by] + 0.5
        self.edge = len(by)
        self.low = np.searchsorted(self.cls, np.arange(CLASSES + 1))
        whole = np.bincount(self.cls, weights=size, minlength=CLASSES)
        self.prior = np.log((whole + 0.5) / (whole.sum() + 0.5 * CLASSES)).astype(np.float32)
        self.within = np.log(size / whole[self.cls]).astype(np.float32)
        self.group_id = number[top:].astype(np.uint16)  # of each group
        with np.errstate(divide="ignore"):
            self.group_share = np.where(mass > 0, np.log(np.maximum(even, 1e-12) / np.maximum(mass, 1e-12)), 0.0)
        share = np.where(np.arange(len(codes)) < top, 0.0, np.log(np.maximum(counts, 1e-12)) - np.log(np.maximum(mass[group], 1e-12)))
        member = np.concatenate([number[:top], number[top:][group[top:]]])
        by = np.argsort(codes)
        self.codes, self.member, self.share = codes[by], member[by].astype(np.uint16), share[by]

    def look_up(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Members of codes, and the logs of their own shares within them."""
        group = codes & (GROUPS - 1)
        member, share = self.group_id[group], self.group_share[group]
        if len(self.codes):
            by = np.argsort(codes)  # in order, searches are near each other
            at = np.empty(len(codes), dtype=np.int64)
            at[by] = np.minimum(np.searchsorted(self.codes, codes[by]), len(self.codes) - 1)
            known = self.codes[at] == codes
            member, share = np.where(known, self.member[at], member), np.where(known, self.share[at], share)
        return member, share


def vocabulary(slices: DataFrame, words: int = WORDS, most: int = KNOWN) -> Vocabulary:
    counts = materialize(count_tokens(slices), "tokens")
    n = F.col("n")
    level = F.when(n < EXACT, n).otherwise(EXACT + F.floor(STEPS * F.log2(n / EXACT))).cast("int")
    sizes = counts.groupBy(level.alias("level")).agg(F.count("*").alias("kinds")).collect()  # EXACT rows and a few more
    least, room = 1 << 30, most
    for r in sorted(sizes, key=lambda r: -r["level"]):
        if r["kinds"] > room:
            break
        least, room = r["level"], room - r["kinds"]
    known = counts.filter(level >= least).toArrow()  # at most KNOWN rows
    rest = counts.filter(level < least).groupBy(F.col("code").bitwiseAND(GROUPS - 1).alias("g")).agg(F.sum("n").alias("n"), F.count("*").alias("kinds"))
    rest = {r["g"]: (r["n"], r["kinds"]) for r in rest.collect()}  # at most GROUPS rows
    return Vocabulary(known.column("code").to_numpy(), known.column("n").to_numpy(), rest, words)


def encode(slices: DataFrame, vocab: Vocabulary) -> DataFrame:
    """(doc_id, ids, own): each text's members as little-endian 16-bit numbers, and the sum of the logs of
    its tokens' own shares within them."""
    shared = slices.sparkSession.sparkContext.broadcast(vocab)  # at most KNOWN entries of 18 bytes
    kind = slices.schema["docs"].dataType.elementType
    schema = T.StructType([T.StructField("doc_id", kind), T.StructField("ids", T.BinaryType()), T.StructField("own", T.DoubleType())])
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(schema, prefers_large_types=False)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab = shared.value
        for some in batches:
            for row in range(some.num_rows):
                sizes = np.frombuffer(some.column("sizes")[row].as_py(), dtype="<u4")
                codes, places = placed(some.column("codes")[row].as_py(), some.column("places")[row].as_py())
                member, share = vocab.look_up(codes)
                ends = np.concatenate([[0], np.cumsum(sizes, dtype=np.int64)])
                ids = pa.Array.from_buffers(pa.binary(), len(sizes), [None, pa.py_buffer((2 * ends).astype("<i4").tobytes()), pa.py_buffer(member.astype("<u2").take(places).tobytes())])
                own = np.zeros(len(sizes))
                if len(places):  # a text without tokens has none of the sums
                    own[sizes > 0] = np.add.reduceat(share.take(places), ends[:-1][sizes > 0])
                yield pa.RecordBatch.from_arrays([some.column("docs")[row].values, ids, pa.array(own)], schema=arrow)

    return slices.select("docs", "sizes", "codes", "places").mapInArrow(run, schema)


# -- the network


def start(vocab: Vocabulary, seed: int = 3) -> dict[str, np.ndarray]:
    """Weights that predict each class, and each member in it, by its share of the corpus."""
    rng = np.random.default_rng(seed)
    return {
        "e": rng.normal(0, 0.3, (vocab.edge + 1, DIM)).astype(np.float32),
        # the last of the hidden layer gets nothing but a one, by which the biases below count
        "w": rng.normal(0, 1 / math.sqrt(2 * SIDE * DIM), (2 * SIDE * DIM, HIDDEN)).astype(np.float32) * (np.arange(HIDDEN) < HIDDEN - 1).astype(np.float32),
        "b": (np.arange(HIDDEN) == HIDDEN - 1).astype(np.float32),
        "u": np.concatenate([np.zeros((HIDDEN - 1, CLASSES), dtype=np.float32), vocab.prior[None]]),
        "v": np.concatenate([np.zeros((vocab.edge, HIDDEN - 1), dtype=np.float32), vocab.within[:, None]], axis=1),
    }


def joined(texts: list[np.ndarray], edge: int) -> tuple[np.ndarray, np.ndarray]:
    """Members of several texts in one array, edges around each; the place of each text's first."""
    size = np.array([len(x) for x in texts], dtype=np.int64)
    first = SIDE + np.concatenate([[0], np.cumsum(size[:-1] + SIDE)]) if len(size) else size
    out = np.full(int(size.sum()) + SIDE * (len(size) + 1), edge, dtype=np.int64)
    for x, at in zip(texts, first.tolist(), strict=True):
        out[at : at + len(x)] = x
    return out, first


def contexts(ids: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Members on both sides of the places ``at`` of a joined array."""
    return np.stack([ids.take(at + o) for o in range(-SIDE, SIDE + 1) if o], axis=1)


def exponents(h: np.ndarray, weights: np.ndarray, own: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray | None]:
    """Exponentials of ``h @ weights``, their row-wise sums and the sums' inverses, and the logits at ``own`` if
    it is given, all alike shifted where single precision does not reach. Overflows are the caller's to silence."""
    return exponents_of(lambda: h @ weights, own)


def exponents_of(make: Callable[[], np.ndarray], own: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray | None]:
    """The same of logits that ``make`` makes anew at each call."""
    logits = make()
    at = None if own is None else logits[np.arange(len(own)), own]
    np.exp(logits, out=logits)
    total = logits @ np.ones(logits.shape[1], dtype=logits.dtype)
    inverse = 1 / total
    if not float(total @ inverse) < len(total) + 1:  # one of them is zero or infinite
        logits = make()
        logits -= logits.max(axis=1)[:, None]
        at = None if own is None else logits[np.arange(len(own)), own]
        np.exp(logits, out=logits)
        total = logits.sum(axis=1)
        inverse = 1 / total
    return logits, total, inverse, at


class Room(dict):
    """Arrays that are used again: memory that is given back and taken anew costs its pages each time."""

    def __call__(self, name: str, shape: tuple[int, ...], kind: type | np.dtype) -> np.ndarray:
        """An array with whatever was in it; the next of its name takes its place."""
        size, kind = math.prod(shape), np.dtype(kind)
        if (name, kind) not in self or self[name, kind].size < size:
            self[name, kind] = np.empty(size, dtype=kind)
        return self[name, kind][:size].reshape(shape)


#: Of this process, whose steps and scores come one after another.
ROOM = Room()
#: What single precision does not reach is seen in the sums.
QUIET = {"over": "ignore", "under": "ignore", "divide": "ignore", "invalid": "ignore"}


def in_classes(cls: np.ndarray) -> tuple[np.ndarray, int, list[tuple[int, int, int]]]:
    """Rows in the order of their classes, the number of those in classes of one, which come first, and
    (class, from, to) among the others."""
    order = np.argsort(cls.astype(np.uint8), kind="stable")
    cut = np.concatenate([[0], np.cumsum(np.bincount(cls, minlength=CLASSES))])
    first = int(cut[ALONE])
    return order, first, [(c, int(cut[c]) - first, int(cut[c + 1]) - first) for c in range(ALONE, CLASSES) if cut[c] < cut[c + 1]]


def by_class(cls: np.ndarray) -> tuple[np.ndarray, list[tuple[int, int, int]]]:
    """Rows of classes with several members in order, and (class, from, to) among them."""
    order, first, parts = in_classes(cls)
    return order[first:], parts


def together(parts: list[tuple[int, int, int]]) -> Iterator[list[tuple[int, int, int]]]:
    """Parts of :func:`by_class` in groups of POSITIONS rows, but for the last part of each."""
    some: list = []
    for part in parts:
        some.append(part)
        if part[2] - some[0][1] >= POSITIONS:
            yield some
            some = []
    if some:
        yield some


def inner_logits(near: np.ndarray, v: np.ndarray, low: np.ndarray, parts: list[tuple[int, int, int]], room: Room | None = None) -> np.ndarray:
    """Logits of the members of each row's class, which begin its row; the others are minus infinity."""
    first = parts[0][1]
    shape = parts[-1][2] - first, max(int(low[c + 1] - low[c]) for c, _, _ in parts)
    out = np.empty(shape, dtype=near.dtype) if room is None else room("inner", shape, near.dtype)
    for c, a, b in parts:
        some = out[a - first : b - first]
        np.matmul(near[a:b], v[low[c] : low[c + 1]].T, out=some[:, : low[c + 1] - low[c]])
        some[:, low[c + 1] - low[c] :] = -np.inf
    return out


@np.errstate(**QUIET)
def step(p: dict[str, np.ndarray], state: dict[str, np.ndarray], x: np.ndarray, y: np.ndarray, vocab: Vocabulary, tell: bool = False) -> float:
    """One Adagrad step on a batch; the mean loss before it if ``tell``."""
    n, kind = len(y), vocab.cls.take(y)
    order, first, parts = in_classes(kind)
    x, y, kind = x.take(order, axis=0), y.take(order), kind.take(order)
    share = np.float32(1 / n) if p["e"].dtype == np.float32 else 1 / n
    room = lambda name, *shape: ROOM(name, shape, p["e"].dtype)
    emb = p["e"].take(x, axis=0, out=room("emb", n, 2 * SIDE, DIM), mode="clip").reshape(n, -1)
    hid = np.matmul(emb, p["w"], out=room("hid", n, HIDDEN))
    hid += p["b"]
    np.maximum(hid, 0, out=hid)
    # the constant of the hidden layer gets nothing back: in its place stands a one, by which a product sums
    classes, members = p["u"].T.copy(), room("members", *p["v"].shape)
    members[:, :-1] = p["v"][:, :-1]
    classes[:, -1] = members[:, -1] = 1
    grads = {"u": np.zeros_like(p["u"]), "v": room("v", *p["v"].shape)}
    grads["v"].fill(0)
    loss = 0.0

    def softmax(make: Callable[[], np.ndarray], own: np.ndarray, times: Callable[[np.ndarray, np.ndarray], None], back: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Gradients of the logits but for a factor of each row, and the factors; ``back`` gets the mean of
        the members' weights. ``times`` puts the product with them, and ones, where it is told."""
        nonlocal loss
        out = make()
        np.exp(out, out=out)
        times(out, back)
        total = back[:, -1].copy()
        inverse = 1 / total
        if tell or not float(total @ inverse) < len(total) + 1:  # or one of them is zero or infinite
            out, total, inverse, at = exponents_of(make, own)
            times(out, back)
            loss += float((np.log(total) - at).sum()) / n if tell else 0.0
        inverse *= share
        back *= inverse[:, None]
        flat, place = out.ravel(), np.arange(0, out.size, out.shape[1]) + own
        flat[place] = flat.take(place) - total
        return out, inverse[:, None]

    back = room("back", n, HIDDEN)
    for a in range(0, n, POSITIONS):  # the classes
        h = hid[a : a + POSITIONS]
        out, factor = softmax(lambda h=h: np.matmul(h, p["u"], out=room("outer", len(h), CLASSES)), kind[a : a + POSITIONS], lambda out, to: np.matmul(out, classes, out=to), back[a : a + POSITIONS])
        grads["u"] += (h * factor).T @ out
    back -= classes.take(kind, axis=0) * share
    near, member = hid[first:], y[first:]
    deep = room("deep", n - first, HIDDEN)
    own = member - vocab.low.take(kind[first:])
    for group in together(parts):  # the members of some classes
        begin, end = group[0][1], group[-1][2]

        def times(out: np.ndarray, to: np.ndarray, group=group, begin=begin) -> None:
            for c, a, b in group:
                low, high = vocab.low[c], vocab.low[c + 1]
                np.matmul(out[a - begin : b - begin, : high - low], members[low:high], out=to[a - begin : b - begin])

        out, factor = softmax(lambda group=group: inner_logits(near, p["v"], vocab.low, group, ROOM), own[begin:end], times, deep[begin:end])
        h = near[begin:end] * factor
        for c, a, b in group:
            low, high = vocab.low[c], vocab.low[c + 1]
            np.matmul(out[a - begin : b - begin, : high - low].T, h[a - begin : b - begin], out=grads["v"][low:high])
    deep -= members.take(member, axis=0) * share
    back[first:] += deep
    back *= hid > 0
    back[:, -1] = 0
    grads["w"], grads["b"] = emb.T @ back, np.ones(n, dtype=back.dtype) @ back
    wide = ROOM("wide", (DIM, 2 * SIDE, n), np.float64)  # by place of an embedding, then of its token
    wide[:] = np.matmul(p["w"], back.T, out=room("emb", 2 * SIDE * DIM, n)).reshape(2 * SIDE, DIM, n).transpose(1, 0, 2)
    flat = x.T.ravel()
    grads["e"] = np.stack([np.bincount(flat, weights=d.ravel(), minlength=len(p["e"])) for d in wide], axis=1).astype(emb.dtype)
    for k, g in grads.items():
        some = np.multiply(g, g, out=room("some", *g.shape))
        state[k] += some
        g *= RATE
        g /= np.sqrt(np.add(state[k], 1e-8, out=some), out=some)
        p[k] -= g
    return loss


def _flat(p: dict[str, np.ndarray]) -> np.ndarray:
    return np.concatenate([v.ravel() for v in p.values()])


def _shaped(flat: np.ndarray, like: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    out, at = {}, 0
    for k, v in like.items():
        out[k] = flat[at : at + v.size].reshape(v.shape).astype(np.float32)
        at += v.size
    return out


def train_round(encoded: DataFrame, p: dict[str, np.ndarray], vocab: Vocabulary, number: int, stride: int = STRIDE, shard: int = SHARD) -> dict[str, np.ndarray]:
    """Average of the weights that all shards reach from ``p``, by their numbers of examples."""
    shards = max(1, -(-vocab.total // shard))
    shared = encoded.sparkSession.sparkContext.broadcast((p, vocab))
    phase = number * stride // ROUNDS % stride

    def learner(shard: int):
        """A function that takes a text, and gives the weights when it takes None."""
        start, vocab = shared.value
        p = {k: v.copy() for k, v in start.items()}
        state = {k: np.zeros_like(v) for k, v in p.items()}
        texts, held, seen = [], 0, 0

        def learn() -> int:
            ids, first = joined(texts, vocab.edge)
            at = [np.arange(a + phase, a + len(x), stride) for a, x in zip(first.tolist(), texts, strict=True) if len(x)]
            if not at:
                return 0
            at = np.random.default_rng([shard, seen]).permutation(np.concatenate(at))
            for i in range(0, len(at), BATCH):
                some = at[i : i + BATCH]
                step(p, state, contexts(ids, some), ids[some], vocab)
            return len(at)

        def take(text: bytes | None):
            nonlocal texts, held, seen
            if text is not None:
                texts.append(np.frombuffer(text, dtype="<u2"))
                held += -(-len(texts[-1]) // stride)
            if text is None or held >= 16 * BATCH:  # some documents at once, mixed
                seen += learn()
                texts, held = [], 0
            return p, seen

        return take

    def reached(shard: int, p: dict[str, np.ndarray], seen: int) -> pa.RecordBatch:
        flat = _flat(p).astype("<f4")
        blocks = [flat[i : i + BLOCK].tobytes() for i in range(0, len(flat), BLOCK)]
        n = len(blocks) if seen else 0
        return pa.RecordBatch.from_arrays([pa.array(range(n), pa.int32()), pa.array([shard] * n, pa.int64()), pa.array([seen] * n, pa.int64()), pa.array(blocks[:n], pa.binary())], names=["block", "shard", "n", "w"])

    def train(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, take = None, None
        for batch in batches:
            for shard, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if shard != now:
                    if take:
                        yield reached(now, *take(None))
                    now, take = shard, learner(shard)
                take(raw)
        if take:
            yield reached(now, *take(None))

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, list] = {}  # a block at a time is in sight, and all blocks are bounded
        for batch in batches:
            for block, n, w in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                s = sums.setdefault(block, [0, 0.0])
                s[0], s[1] = s[0] + n, s[1] + n * np.frombuffer(w, dtype="<f4").astype(np.float64)
        if sums:
            yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array([(x / n).astype("<f4").tobytes() for n, x in sums.values()], pa.binary())], names=["block", "w"])

    key = F.xxhash64("doc_id", "ids")
    dealt = encoded.select(F.pmod(key, F.lit(shards)).cast("int").alias("shard"), "ids", key.alias("key"))
    dealt = dealt.repartitionById(shards, "shard").sortWithinPartitions("shard", "key", "ids").select("shard", "ids")
    sums = dealt.mapInArrow(train, "block int, shard long, n long, w binary")
    sums = sums.repartition("block").sortWithinPartitions("block", "shard").mapInArrow(add, "block int, w binary")
    got = {r["block"]: np.frombuffer(r["w"], dtype="<f4") for r in sums.collect()}  # the weights, once
    return _shaped(np.concatenate([got[i] for i in sorted(got)]), p) if got else p


class Scorer:
    """Conditional log-probabilities of members; the first layer is summed from tables of embedded ones."""

    def __init__(self, p: dict[str, np.ndarray], vocab: Vocabulary):
        self.tables = [p["e"] @ p["w"][i * DIM : (i + 1) * DIM] for i in range(2 * SIDE)]
        self.tables[0] += p["b"]
        self.p, self.vocab = p, vocab

    @np.errstate(**QUIET)
    def log_probabilities(self, texts: list[np.ndarray]) -> list[np.ndarray]:
        """For each text's members, their log-probabilities."""
        ids, first = joined(texts, self.vocab.edge)
        size = [len(x) for x in texts]
        place = np.concatenate([np.arange(a, a + n) for a, n in zip(first.tolist(), size, strict=True)]) if texts else first
        out = np.empty(len(place), dtype=np.float32)

        def log(make: Callable[[], np.ndarray], own: np.ndarray) -> np.ndarray:
            _, total, _, at = exponents_of(make, own)
            return at - np.log(total)

        for begin in range(0, len(place), SCORED):
            at = place[begin : begin + SCORED]
            order, first, parts = in_classes(self.vocab.cls.take(ids.take(at)))
            at = at.take(order)
            y = ids.take(at)
            kind, got = self.vocab.cls.take(y), np.empty(len(at), dtype=np.float32)
            hid, some = (ROOM(name, (len(at), HIDDEN), np.float32) for name in ("hid", "back"))
            self.tables[0].take(ids.take(at - SIDE), axis=0, out=hid, mode="clip")
            for i, o in enumerate([o for o in range(-SIDE, SIDE + 1) if o][1:], 1):
                hid += self.tables[i].take(ids.take(at + o), axis=0, out=some, mode="clip")
            np.maximum(hid, 0, out=hid)
            for a in range(0, len(at), POSITIONS):
                got[a : a + POSITIONS] = log(lambda h=hid[a : a + POSITIONS]: np.matmul(h, self.p["u"], out=ROOM("outer", (len(h), CLASSES), np.float32)), kind[a : a + POSITIONS])
            near, more = hid[first:], got[first:]
            own = y[first:] - self.vocab.low.take(kind[first:])
            for group in together(parts):
                a, b = group[0][1], group[-1][2]
                more[a:b] += log(lambda group=group: inner_logits(near, self.p["v"], self.vocab.low, group, ROOM), own[a:b])
            out[begin + order] = got
        return np.split(out, np.cumsum(size)[:-1]) if texts else []


def fit(docs: DataFrame, rounds: int = ROUNDS, stride: int = STRIDE, shard: int = SHARD) -> tuple[Vocabulary, dict[str, np.ndarray], DataFrame]:
    """(vocabulary, weights, encoded documents), from all documents."""
    slices = materialize(slice_tokens(docs), "slices")
    vocab = vocabulary(slices)
    encoded = materialize(encode(slices, vocab), "encoded")
    p = start(vocab)
    for r in range(rounds):
        p = train_round(encoded, p, vocab, r, stride, shard)
    return vocab, p, encoded


def score(encoded: DataFrame, vocab: Vocabulary, p: dict[str, np.ndarray]) -> DataFrame:
    """(doc_id, n_tokens, log_likelihood, mean_log_prob, perplexity) of encoded documents."""
    shared = encoded.sparkSession.sparkContext.broadcast((p, vocab))  # of bounded size
    kind = encoded.schema["doc_id"]
    schema = T.StructType([kind, T.StructField("n_tokens", T.LongType()), *(T.StructField(c, T.DoubleType()) for c in ("log_likelihood", "mean_log_prob", "perplexity"))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(*shared.value)
        for whole in batches:
            for at in range(0, whole.num_rows, SLICE_ROWS):
                batch = whole.slice(at, SLICE_ROWS)
                texts = [np.frombuffer(raw, dtype="<u2") for raw in batch.column(1).to_pylist()]
                n = [len(x) for x in texts]
                total = [float(x.sum(dtype=np.float64)) + own if len(x) else 0.0 for x, own in zip(scorer.log_probabilities(texts), batch.column(2).to_pylist(), strict=True)]
                mean = [t / max(k, 1) for t, k in zip(total, n, strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(total, pa.float64()), pa.array(mean, pa.float64()), pa.array([math.exp(min(-m, 700.0)) for m in mean], pa.float64())], names=schema.names)

    return encoded.select("doc_id", "ids", "own").mapInArrow(run, schema)


def pseudo_likelihood(docs: DataFrame) -> DataFrame:
    """Train on all documents, then score each of them."""
    vocab, p, encoded = fit(docs)
    return score(encoded, vocab, p)
