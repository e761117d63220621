"""Pseudo-likelihood: the network against plain arithmetic, and what it learns."""

import math
import random
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from lodestar.llm import lm_score
from lodestar.llm.common import read
from tests.llm.helpers import docs_frame


def toy(n=3000, kinds=400):
    words = [f"w{i}{'abcdefgh'[i % 8]}" for i in range(kinds)]
    codes = np.array([lm_score.code(w) for w in words])
    vocab = lm_score.Vocabulary(codes, np.arange(kinds, 0, -1) * 3, {3: (10, 4)}, words=300)
    rng = np.random.default_rng(1)
    p = lm_score.start(vocab)
    p["u"][:-1] = rng.normal(size=p["u"][:-1].shape)
    p["v"][:, :-1] = rng.normal(size=p["v"][:, :-1].shape)
    return vocab, p, rng.integers(0, vocab.edge, n)


def plain(vocab, p, ids, i):
    side = [ids[j] if 0 <= j < len(ids) else vocab.edge for j in (i - 2, i - 1, i + 1, i + 2)]
    hid = np.maximum(np.concatenate([p["e"][s] for s in side]) @ p["w"] + p["b"], 0)
    assert hid[-1] == 1
    cls = vocab.cls[ids[i]]
    out = (hid @ p["u"]).astype(float)
    members = np.flatnonzero(vocab.cls == cls)
    within = (hid @ p["v"][members].T).astype(float)
    own = within[members.tolist().index(ids[i])]
    return out[cls] - math.log(np.exp(out).sum()) + own - math.log(np.exp(within).sum())


def test_probabilities_match_plain_arithmetic():
    vocab, p, ids = toy(18_000)  # more than are scored at once
    scorer = lm_score.Scorer(p, vocab)
    got = scorer.log_probabilities([ids[:7], ids, ids[:0]])[1]
    assert np.allclose(got, scorer.log_probabilities([ids])[0], atol=1e-3) and scorer.log_probabilities([]) == []
    for i in (0, 1, 2, 500, 1023, 1024, 8191, 8192, 17_998, 17_999):
        assert abs(got[i] - plain(vocab, p, ids, i)) < 1e-3
    far = np.array([[500.0, 1.0], [-500.0, -501.0], [0.0, -90.0]], dtype=np.float32)
    with np.errstate(**lm_score.QUIET):
        _, total, inverse, at = lm_score.exponents(far, np.eye(2, dtype=np.float32), np.array([0, 0, 1]))
    assert np.allclose(total * inverse, 1)
    assert np.allclose(at - np.log(total), [0.0, -math.log(1 + math.exp(-1)), -90.0])


def test_gradient_steps_match_finite_differences():
    vocab, p, ids = toy()
    p = {k: v.astype(np.float64) for k, v in p.items()}
    x, y = lm_score.contexts(ids, np.arange(2, 2500)), ids[2:2500]
    loss = lambda q: lm_score.step({k: v.copy() for k, v in q.items()}, {k: np.zeros_like(v) for k, v in q.items()}, x, y, vocab, True)
    state = {k: np.zeros_like(v) for k, v in p.items()}
    lm_score.step({k: v.copy() for k, v in p.items()}, state, x, y, vocab)
    assert not state["b"][-1] and not state["w"][:, -1].any()  # the one stays one
    inner = int(vocab.low[lm_score.ALONE + int(np.argmax(np.diff(vocab.low)[lm_score.ALONE :]))])
    for k, at in (("u", (3, 5)), ("u", (-1, 7)), ("w", (9, 4)), ("b", (2,)), ("e", (int(x[0, 1]), 6)), ("v", (inner, 4)), ("v", (inner, -1))):
        up, down = ({n: v.copy() for n, v in p.items()} for _ in range(2))
        up[k][at] += 1e-5
        down[k][at] -= 1e-5
        slope = (loss(up) - loss(down)) / 2e-5
        # state holds the squared gradient of the one step
        assert abs(abs(slope) - math.sqrt(state[k][at])) < 1e-5 + 2e-2 * abs(slope), k


def test_slices_hold_every_token_in_order(spark, monkeypatch):
    rng = random.Random(2)
    odd = "aB1_é漢.,-'\u00a0\u2003 \t\n\x1c\x85ßİ\u0301🙂"
    texts = [None, "", " ", "x", *("".join(rng.choice(odd) for _ in range(rng.randint(0, 60))) for _ in range(300)), "w, " * 3000]
    monkeypatch.setattr(lm_score, "SLICE", 500)
    got, kinds = {}, 0
    for r in lm_score.slice_tokens(docs_frame(spark, texts)).collect():
        codes, places = lm_score.placed(r["codes"], r["places"])
        assert len(set(codes.tolist())) == len(codes)
        cut, kinds = np.cumsum(np.frombuffer(r["sizes"], dtype="<u4")), kinds + 1
        got |= {d: codes[x].tolist() for d, x in zip(r["docs"], np.split(places, cut[:-1]), strict=True)}
    assert kinds > 3 and got == {i: [lm_score.code(w) for w in lm_score.tokens(t)] for i, t in enumerate(texts)}


def test_every_token_has_its_own_share(spark):
    """Counts, members and shares against a plain count; those of a class sum to one."""
    texts = ["the cat sat on the mat", "a dog ate the bone the cat saw", "zebra quagga okapi zebra", None, "okapi"]
    docs = docs_frame(spark, texts)
    want = Counter(t for x in texts for t in lm_score.tokens(x))
    slices = lm_score.slice_tokens(docs)
    assert {r["code"]: r["n"] for r in lm_score.count_tokens(slices).collect()} == {lm_score.code(t): n for t, n in want.items()}
    for most in (1000, 4):  # beyond 4, the rest of a group shares evenly
        vocab = lm_score.vocabulary(slices, words=5, most=most)
        assert vocab.total == sum(want.values())
        member, share = vocab.look_up(np.array([lm_score.code(t) for t in want]))
        mass = Counter()
        for m, s in zip(member.tolist(), share.tolist(), strict=True):
            mass[m] += math.exp(s)
        assert all(abs(x - 1) < 1e-6 for x in mass.values())
        if most == 1000:
            group = lambda t: lm_score.code(t) & (lm_score.GROUPS - 1)
            for t, m, s in zip(want, member.tolist(), share.tolist(), strict=True):
                peers = [u for u, k in zip(want, member.tolist(), strict=True) if k == m]
                assert len({group(u) for u in peers}) == 1
                assert abs(math.exp(s) - want[t] / sum(want[u] for u in peers)) < 1e-6
        assert abs(np.exp(vocab.prior).sum() - 1) < 1e-4
        for c in range(lm_score.CLASSES):
            part = vocab.within[vocab.low[c] : vocab.low[c + 1]]
            assert not len(part) or abs(np.exp(part).sum() - 1) < 1e-4


def test_context_helps_and_order_matters(spark):
    rng = random.Random(4)
    pairs = [(f"left{i}", f"mid{i}", f"right{i}") for i in range(30)]
    text = lambda: " ".join(" ".join(rng.choice(pairs)) for _ in range(80))
    docs = docs_frame(spark, [text() for _ in range(300)], 2)
    vocab, p, encoded = lm_score.fit(docs, rounds=6)

    def mean(model, df):
        r = lm_score.score(df, vocab, model).agg(F.sum("log_likelihood"), F.sum("n_tokens")).first()
        return r[0] / r[1]

    assert mean(p, encoded) > mean(lm_score.start(vocab), encoded) + 0.5
    shuffled = []
    for _ in range(50):
        w = text().split()
        rng.shuffle(w)
        shuffled.append(" ".join(w))
    assert mean(p, lm_score.encode(lm_score.slice_tokens(docs_frame(spark, shuffled)), vocab)) < mean(p, encoded) - 0.5


def test_context_chooses_within_a_class():
    """Two words of one class cost more where the other belongs."""
    vocab, _, _ = toy()
    p = lm_score.start(vocab)
    cls = lm_score.ALONE + int(np.argmax(np.diff(vocab.low)[lm_score.ALONE :]))
    a, b = int(vocab.low[cls]), int(vocab.low[cls]) + 1
    rng = np.random.default_rng(6)
    text = lambda swap=False: np.concatenate([[1, b if swap else a, 2] if x else [3, a if swap else b, 4] for x in rng.integers(0, 2, 4000)])
    state = {k: np.zeros_like(v) for k, v in p.items()}
    for _ in range(30):
        ids, first = lm_score.joined([text()], vocab.edge)
        at = first[0] + np.arange(12_000)
        lm_score.step(p, state, lm_score.contexts(ids, at), ids[at], vocab)
    scorer = lm_score.Scorer(p, vocab)
    right, wrong = (scorer.log_probabilities([text(s)])[0][1::3].mean() for s in (False, True))
    assert right > wrong + 1


def test_documents_beat_the_unigram_model(spark):
    docs = read(spark, "/root/testdata/sf0.01", "documents").repartition(4)
    vocab, p, encoded = lm_score.fit(docs)
    total = lambda model: lm_score.score(encoded, vocab, model).agg(F.sum("log_likelihood"), F.sum("n_tokens")).first()
    a, b = total(p), total(lm_score.start(vocab))
    assert a[1] == b[1] and a[0] / a[1] > b[0] / b[1] + 0.5


def test_edge_cases(spark):
    docs = docs_frame(spark, [None, "", " \n", "one", "one", "ß漢🙂 x!", "w " * 60_000, (None, "two")]).withColumn("ids", F.lit(1)).withColumn("token", F.lit("t")).withColumn("docs", F.lit(2)).withColumn("shard", F.lit(3))
    rows = lm_score.pseudo_likelihood(docs).collect()
    assert len(rows) == 8
    for r in rows:
        if not r["n_tokens"]:
            assert (r["log_likelihood"], r["mean_log_prob"], r["perplexity"]) == (0.0, 0.0, 1.0)
        else:
            assert r["log_likelihood"] < 0 and math.isclose(r["mean_log_prob"], r["log_likelihood"] / r["n_tokens"]) and math.isfinite(r["perplexity"])
    assert sorted(r["n_tokens"] for r in rows) == [0, 0, 0, 1, 1, 1, 4, 60_000]
    assert lm_score.pseudo_likelihood(docs.limit(0)).count() == 0
    assert [r["n_tokens"] for r in lm_score.pseudo_likelihood(docs_frame(spark, [None, " "])).collect()] == [0, 0]


def test_scores_do_not_depend_on_partitions(spark):
    """Several shards, dealt over 2 and 8 partitions, in two orders of rows."""
    docs = read(spark, "/root/testdata/sf0.01", "documents")

    def scores(df):
        vocab, p, encoded = lm_score.fit(df, shard=100_000)
        assert vocab.total > 300_000
        return {r["doc_id"]: (r["n_tokens"], r["log_likelihood"]) for r in lm_score.score(encoded, vocab, p).collect()}

    a, b = scores(docs.repartition(2)), scores(docs.orderBy(F.desc("doc_id")).repartition(8))
    assert a.keys() == b.keys() and all(a[k][0] == b[k][0] and math.isclose(a[k][1], b[k][1], rel_tol=1e-5, abs_tol=1e-3) for k in a)


def test_runs_repeat_exactly(spark, sf):
    docs = read(spark, sf, "documents").repartition(3)
    a, b = (sorted(map(tuple, lm_score.pseudo_likelihood(docs).collect())) for _ in range(2))
    assert a == b


def test_every_token_is_a_target_once(spark, tmp_path, monkeypatch):
    """Places are told apart by their members: text i has the numbers 1000 i + 1, 1000 i + 2, ..."""
    seen = tmp_path / "seen"

    def noted(p, state, x, y, vocab):
        with open(seen, "a") as f:
            f.write("".join(f"{i}\n" for i in y.tolist()))

    monkeypatch.setattr(lm_score, "step", noted)
    vocab = lm_score.Vocabulary(np.array([lm_score.code("a")]), np.array([3]), {})
    texts = [np.arange(1, n + 1) + 1000 * i for i, n in enumerate((1, 2, 3, 16, 17, 100, 999))]
    encoded = spark.createDataFrame([(i, x.astype("<u2").tobytes(), 0.0) for i, x in enumerate(texts)], "doc_id long, ids binary, own double").repartition(2)
    p = lm_score.start(vocab)
    for r in range(lm_score.ROUNDS):
        p = lm_score.train_round(encoded, p, vocab, r)
    assert sorted(map(int, seen.read_text().split())) == sorted(np.concatenate(texts).tolist())


def test_classes_share_products_and_codes_are_made_at_once(monkeypatch):
    """A step and a score call for exponents by groups of classes, not one by one; numbers are as before."""
    vocab, p, ids = toy(8000)
    calls = []
    whole = lm_score.exponents_of
    monkeypatch.setattr(lm_score, "exponents_of", lambda make, own=None: calls.append(1) or whole(make, own))
    at = np.arange(2, 7002)
    lm_score.step({k: v.copy() for k, v in p.items()}, {k: np.zeros_like(v) for k, v in p.items()}, lm_score.contexts(ids, at), ids[at], vocab)
    assert len(calls) <= 2 * -(-7000 // lm_score.POSITIONS)
    calls.clear()
    lm_score.Scorer(p, vocab).log_probabilities([ids])
    assert len(calls) <= 2 * -(-8000 // lm_score.POSITIONS)
    order, parts = lm_score.by_class(vocab.cls[ids])
    assert [x for some in lm_score.together(parts) for x in some] == parts
    near = np.random.default_rng(3).normal(size=(len(order), lm_score.HIDDEN)).astype(np.float32)
    got = lm_score.inner_logits(near, p["v"], vocab.low, parts)
    for c, a, b in parts:
        low, high = vocab.low[c], vocab.low[c + 1]
        assert np.allclose(got[a:b, : high - low], near[a:b] @ p["v"][low:high].T, atol=1e-4) and np.isneginf(got[a:b, high - low :]).all()
    tokens = ["", "a", "é", "the", "'", "🙂漢x", "i̇stanbul"]
    assert lm_score.codes_of(tokens).tolist() == [lm_score.code(t) for t in tokens] and not len(lm_score.codes_of([]))


def test_runs_are_taken_apart_at_once(monkeypatch):
    """One call of the pattern for all distinct runs that are not one token by sight; memory is used again."""

    class Counted:
        calls = 0

        def findall(self, text):
            Counted.calls += 1
            return pattern.findall(text)

    pattern = lm_score.MARKED
    monkeypatch.setattr(lm_score, "MARKED", Counted())
    for runs in ([], [""], ["abc", "1"], ["", "a,b", "é", "x_y", "..", "a", "b!", "漢字", "don't", "a,b,a"], ["🙂", "ß", "́"]):
        Counted.calls = 0
        kinds, inside, begin, length = lm_score.taken_apart(pa.array(runs, pa.large_string()))
        kinds = kinds.to_pylist()
        assert Counted.calls == 1 and len(set(kinds)) == len(kinds)
        assert [[kinds[i] for i in inside[b : b + n]] for b, n in zip(begin.tolist(), length.tolist(), strict=True)] == [lm_score.TOKEN.findall(x) for x in runs]
    vocab, p, ids = toy()
    rows, parts = lm_score.by_class(vocab.cls[ids])
    near, room = np.ones((len(rows), lm_score.HIDDEN), dtype=np.float32), lm_score.Room()
    a, b = (lm_score.inner_logits(near, p["v"], vocab.low, parts, room) for _ in "ab")
    assert np.shares_memory(a, b) and (b == lm_score.inner_logits(near, p["v"], vocab.low, parts)).all()
    assert room("inner", (2, 3), np.float64).dtype == np.float64 and room("inner", (10**6, 2), np.float32).shape == (10**6, 2)


def test_rows_of_a_batch_may_come_in_any_order():
    """Steps sort them by class; the loss and the squared gradients do not change."""
    vocab, p, ids = toy()
    p = {k: v.astype(np.float64) for k, v in p.items()}
    at = np.arange(2, 2500)
    got = []
    for order in (at, at[::-1], np.random.default_rng(8).permutation(at)):
        state = {k: np.zeros_like(v) for k, v in p.items()}
        q = {k: v.copy() for k, v in p.items()}
        q["u"][:, 70] *= 400  # beyond exponentials, even in double precision
        got.append((lm_score.step(q, state, lm_score.contexts(ids, order), ids[order], vocab, True), state))
    for loss, state in got:
        assert math.isfinite(loss) and math.isclose(loss, got[0][0], rel_tol=1e-9)
        assert all(np.isfinite(v).all() and np.allclose(v, got[0][1][k], rtol=1e-6, atol=1e-12) for k, v in state.items())
