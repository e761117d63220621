"""The other operators against brute force, exact round trips and held-out accuracy."""

import base64
import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestar.llm import bpe, language, packing, pii, quality, token_counts, toxicity, warc
from lodestar.llm.common import read
from tests.llm.helpers import docs_frame, texts_of

ODD = [None, "", " ", "a", "é", "<|endoftext|>", "x<|endoftext|> <|endoftext|>y", "a" * 5000, " " * 5000, "\n" * 3000 + "x", "²½ ٣ 漢字 🙂🙂 é", "don't we'll 'S", "1234567" * 900, "wörter " * 3000, "\0\x01 a b", "<|endoftext"]


# ---- toxicity


def brute_segments(scores):
    """All maximal segments by the definition: no proper part scores less or equal before its end."""
    cum = np.concatenate([[0.0], np.cumsum(scores)])
    n = len(scores)

    def split(lo, hi):
        best = None
        for i in range(lo, hi):
            for j in range(i + 1, hi + 1):
                s = cum[j] - cum[i]
                if s > 0 and (best is None or s > best[0] + 1e-12 or (abs(s - best[0]) <= 1e-12 and (j - i) < best[2] - best[1])):
                    best = (s, i, j)
        if best is None:
            return []
        s, i, j = best
        return split(lo, i) + [(i, j, s)] + split(j, hi)

    return split(0, n)


def test_segments_match_recursive_definition():
    rng = random.Random(1)
    for _ in range(200):
        scores = [rng.choice([1.37, 2.11, 0.53]) if rng.random() < 0.3 else -0.25 for _ in range(rng.randint(0, 25))]
        got = toxicity.segments([(i, s) for i, s in enumerate(scores) if s > 0], 0.25)
        want = brute_segments(scores)
        assert [(a, b) for a, b, _ in got] == [(a, b) for a, b, _ in want]
        assert np.allclose([s for _, _, s in got], [s for _, _, s in want])


def test_toxicity_held_out(spark):
    sf = "/root/testdata/sf0.1"
    rows = toxicity.classify(read(spark, sf, "documents"), read(spark, sf, "labels")).join(read(spark, sf, "labels"), "doc_id").filter("held_out").collect()
    assert all(zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0 for r in rows)
    toxic = [r for r in rows if r["toxic"] == 1]
    clean = [r for r in rows if r["toxic"] == 0]
    assert sum(r["predicted"] for r in toxic) >= 0.92 * len(toxic)
    assert sum(r["predicted"] for r in clean) <= 0.01 * len(clean)
    lang = {r["doc_id"]: r["lang"] for r in read(spark, sf, "documents").select("doc_id", "lang").collect()}
    for name in set(lang.values()):
        own = [r["predicted"] for r in toxic if lang[r["doc_id"]] == name]
        assert len(own) < 5 or sum(own) >= 0.9 * len(own), name


def test_toxicity_scores_match_a_plain_version(spark):
    """Counts, bounds, segments, evidence and the logistic score, each by its definition."""
    import math

    rng = random.Random(21)
    words = [f"q{chr(97 + i)}{chr(97 + j)}" for i in range(12) for j in range(12)]
    text = lambda bad: " ".join(rng.choice(["vilest", "vileness", "nasty"]) if bad and rng.random() < 0.2 else rng.choice(words) for _ in range(rng.randint(5, 40)))
    labels = [(i, int(i % 4 == 0)) for i in range(400)]
    docs = docs_frame(spark, [text(i % 4 == 0) for i in range(440)])
    model = toxicity.fit(docs, spark.createDataFrame(labels, "doc_id long, toxic int"))
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    counts = {k: (Counter(), Counter()) for k in (0, 1)}
    for i, label in labels:
        own = Counter(x for w in texts[i].split() for x in toxicity.features(w))
        counts[label][0].update(own)
        counts[label][1].update(own.keys())
    total = {k: counts[k][0].total() for k in (0, 1)}
    want = {}
    for x, y in counts[1][0].items():
        m, yd, md = counts[0][0][x], counts[1][1][x], counts[0][1][x]
        a = max(0.5, toxicity.PRIOR * (y + m) / sum(total.values()))
        bound = math.log((y + a) / (total[1] - y + 1)) - math.log((m + a) / (total[0] - m + 1)) - toxicity.ERRORS * math.sqrt(1 / (yd + 0.5) + 1 / (md + 0.5))
        if yd >= toxicity.LEAST and bound >= toxicity.BOUND:
            want[x] = min(bound, toxicity.MOST)
    assert model["lexicon"].keys() == want.keys() and all(math.isclose(model["lexicon"][x], want[x]) for x in want) and "^vile" in want
    for r in toxicity.score(docs, model).collect():
        tokens = texts[r["doc_id"]].lower().split()
        scores = [max((want.get(x, 0.0) for x in toxicity.features(w)), default=0.0) or -toxicity.GAP for w in tokens]
        found = brute_segments(scores)
        z = sum(a * b for a, b in zip(toxicity.evidence(len(tokens), found, model["lam"], model["log_k"]), model["weights"], strict=True))
        assert abs(r["score"] - 1 / (1 + math.exp(-z))) < 1e-6, texts[r["doc_id"]]


def test_rows_that_share_a_labelled_id_teach_once(spark):
    labels = spark.createDataFrame([(1, 1), (2, 0)], "doc_id long, toxic int")
    docs = docs_frame(spark, [(1, f"bad{i}") for i in range(50)] + [(2, "good")])
    assert toxicity.classify(docs, labels).count() == 51
    assert quality.judge(docs, labels.withColumnRenamed("toxic", "quality")).count() == 51


def test_toxicity_edge_cases(spark, sf):
    labels = spark.createDataFrame([(1, 1), (2, None), (3, 0), (None, 1), (3, 0)], "doc_id long, toxic int")
    docs = docs_frame(spark, [(1, "bad words"), (2, None), (3, ""), (None, "x"), (3, "again"), (4, "w " * 50_000)]).withColumn("toxic", F.lit(1)).withColumn("part", F.lit(1))
    rows = toxicity.classify(docs, labels).collect()
    assert len(rows) == 6 and all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5) for r in rows)
    assert {r["score"] for r in toxicity.classify(docs, labels.limit(0)).collect()} == {0.0}
    assert toxicity.classify(docs.limit(0), labels).count() == 0
    kept = toxicity.drop_toxic(docs, labels)
    assert kept.columns == docs.columns


def test_passages_point_at_toxic_words(spark):
    words = [f"w{chr(97 + i)}{chr(97 + j)}" for i in range(20) for j in range(20)]
    rng = random.Random(2)
    texts, labels = [], []
    for i in range(600):
        t = [rng.choice(words) for _ in range(60)]
        if i % 3 == 0:
            t[20:23] = ["vileword", "Vileword", "nasty"]
        texts.append(" ".join(t))
        labels.append((i, int(i % 3 == 0)))
    import json

    rows = toxicity.classify(docs_frame(spark, texts), spark.createDataFrame(labels, "doc_id long, toxic int")).collect()
    for r in rows:
        assert r["predicted"] == int(r["doc_id"] % 3 == 0)
        found = json.loads(r["passages"])
        if r["predicted"]:
            a, b, _ = found[0]
            assert texts[r["doc_id"]][a:b].lower() == "vileword vileword nasty"


# ---- WARC


PAGE = T.StructType([T.StructField("page_id", T.LongType()), T.StructField("url", T.StringType()), T.StructField("html", T.StringType())])


def test_warc_round_trip(spark):
    pages = [(5, "http://a/", "same"), (2, "http://b/", "same"), (9, None, None), (1, "x\r\ny", ""), (3, "http://c/", "é" * 10), (3, "http://c/", "é" * 10), (None, "http://d/", "same"), (None, None, "alone"), (8, "u", "WARC/1.1\r\n\r\n" * 50), (10, "v", "z" * 300_000), (11, "w", "é<p>" * 2_000_000)]
    df = spark.createDataFrame(pages, PAGE).withColumn("digest", F.lit(1)).withColumn("first", F.lit(2)).repartition(3)
    rows = warc.round_trip(df).collect()
    assert len(rows) == len(pages)
    least = defaultdict(list)
    for p, _, h in pages:
        least[h or ""].append(p)
    want = []
    for p, _, h in pages:
        raw = (h or "").encode()
        first = min((x for x in least[h or ""] if x is not None), default=None)
        kind = "response" if first is None or p == first else "revisit"
        want.append((p, len(raw), base64.b32encode(hashlib.sha1(raw).digest()).decode(), kind, first if kind == "revisit" else None))
    assert Counter(map(tuple, rows)) == Counter(want)
    assert warc.round_trip(df.limit(0)).count() == 0


def test_many_repeated_payloads_are_joined(spark):
    """Beyond the broadcast list, frequent payloads still meet their response by one."""
    pages = [(i, f"u{i}", "often" if i % 3 else f"text {i % 40}") for i in range(200)] + [(None, None, "often"), (7, None, ""), (8, None, "")]
    df = spark.createDataFrame(pages, PAGE).repartition(3)
    rows = lambda **k: sorted(map(repr, warc.resolved(df, **k).collect()))
    assert rows() == rows(limit=0, hot=20) == rows(limit=0) and len(rows()) == len(pages)


def test_dictionary_samples_are_records_spread_over_their_whole_length(spark):
    raw = bytes(range(256)) * 1000
    part = warc.spread_parts(raw)
    assert len(part) == warc.PART and part[:100] == raw[:100] and part[-100:] == raw[-100:] and warc.spread_parts(b"short") == b"short"
    df = spark.createDataFrame([(1, "u", "same"), (2, "v", "same"), (3, "w", "x" * 50_000)], PAGE)
    got = warc.sampled_records(warc.resolved(df), df.select("page_id"), warc.DATE)
    assert sorted(b"revisit" in x for x in got) == [False, False, True] and all(x.startswith(b"WARC/1.1") for x in got)


def test_warc_files_have_one_frame_per_record(spark, tmp_path, sf):
    import struct

    import zstandard

    pages = spark.read.parquet(f"{sf}/pages.parquet")
    uri = f"file://{tmp_path}/archives"
    manifest = warc.write_archives(pages, uri)
    got = warc.read_archives(spark, manifest, uri, payloads=True)
    assert {r["page_id"]: r["payload"].decode() for r in got.filter("record_type = 'response'").collect()}.items() <= {r["page_id"]: r["html"] for r in pages.collect()}.items()
    for r in manifest.collect():
        data = open(r["path"], "rb").read()
        magic, size = struct.unpack("<II", data[:8])
        assert magic == 0x184D2A5D
        unpack, at, n = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(data[8 : 8 + size])), 8 + size, 0
        while at < len(data):
            one = unpack.decompressobj()
            assert one.decompress(data[at:]).startswith(b"WARC/1.1\r\n")
            at, n = len(data) - len(one.unused_data), n + 1
        assert n == r["n_records"]


# ---- personal data


def naive_spans(text):
    text = text or ""
    found = [("email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    found += [("ip", *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(x) <= 255 for x in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        d = re.sub("[^0-9]", "", m[0])
        if 14 <= len(d) <= 19 and sum(int(c) if i % 2 == 0 else sum(map(int, str(2 * int(c)))) for i, c in enumerate(reversed(d))) % 10 == 0:
            found.append(("card", *m.span()))
    found += [("phone", *m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 10 <= len(re.sub("[^0-9]", "", m[0])) <= 15]
    return sorted(found, key=lambda x: (x[1], ["email", "ip", "card", "phone"].index(x[0])))


def test_pii_base_spans_match_plain_patterns(spark, sf):
    rng = random.Random(4)
    texts = list(texts_of(spark, "/root/testdata/sf0.01").values())
    texts += ["".join(rng.choice("a.@-+1 9%(0") for _ in range(rng.randint(0, 60))) for _ in range(4000)]
    texts += ["a@b@c.de", "x@y.z@w.uv", "a@b..c d@e.f.", "1.2.3.4.5.6.7.8", "256.1.1.1 01.002.3.255", "+1 (234) 567-8901x", "4111 1111 1111 1111", "é@b.co"]
    for t in texts:
        assert [s[:3] for s in pii.spans(t) if s[0] in pii.BASE] == naive_spans(t), t


def test_pii_long_texts_take_linear_time():
    for t in ("a" * 2_000_000, "1" * 1_000_000, "a@" * 300_000, "1." * 500_000, "+1" * 300_000, "+1" + "(" * 500_000, "1-" * 300_000, "AB12 " * 200_000):
        pii.spans(t)


def test_pii_added_kinds_query_and_mask(spark):
    texts = [None, "", "IBAN GB82 WEST 1234 5698 7654 32 ok", "ssn 123-45-6789", "part 123-45-6789", "mail a.b@c.org, +44 20 7946 0958 end"]
    rows = {r["doc_id"]: r for r in pii.find(docs_frame(spark, texts).withColumn("spans", F.lit(1))).collect()}
    assert rows[0]["spans"] == rows[1]["spans"] == rows[4]["spans"] == "" and rows[2]["spans"] == "iban:5:32" and rows[3]["spans"] == "ssn:4:15"
    assert rows[5]["spans"] == "email:5:14,phone:16:32" and (rows[5]["n_email"], rows[5]["n_phone"]) == (1, 1)
    assert rows[5]["base_sha256"] == hashlib.sha256(b"email:5:14,phone:16:32").hexdigest()
    masked = {r["doc_id"]: r for r in pii.mask(docs_frame(spark, texts)).collect()}
    assert masked[5]["text"] == "mail [EMAIL], [PHONE] end" and masked[5]["n_chars"] == 25 and masked[0]["text"] is None and masked[4]["text"] == texts[4]
    assert pii.find(docs_frame(spark, [])).count() == 0


# ---- quality


def naive_counts(text):
    text = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = text.split("\n")
    dup = sum(1 for i, x in enumerate(lines) if re.search(r"[^\x20\x09-\x0D]", x) and x in lines[:i])
    hit = set()
    seen = Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
    for i in range(len(w) - 4):
        if seen[tuple(w[i : i + 5])] > 1:
            hit |= set(range(i, i + 5))
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(hit)


def test_quality_counts(spark, sf):
    rng = random.Random(6)
    texts = [*texts_of(spark, sf).values(), *ODD, *("".join(rng.choice("ab #\n\n") for _ in range(rng.randint(0, 200))) for _ in range(500)), "a b c d e f " * 2, "x y z v w x y z v w x"]
    for t in texts:
        assert quality.statistics(t)[:5] == naive_counts(t), t


def test_repeated_words_in_flat_arrays():
    rng = random.Random(7)
    for _ in range(400):
        words = [rng.choice("abc") for _ in range(rng.randint(5, 60))]
        assert quality.repeated_words_long(words) == quality.repeated_words(words)
    words = "the quick brown fox jumps".split() * 20_000
    assert quality.statistics(" ".join(words))[4] == len(words) > quality.LONG


def test_quality_rules(spark):
    sf = "/root/testdata/sf0.1"
    labels = read(spark, sf, "labels")
    out = quality.judge(read(spark, sf, "documents"), labels)
    assert not out.filter("base_failed and kept").count()
    assert not out.filter("base_failed <> (n_words < 10 or 100 * n_repeat_words > 20 * n_words)").count()
    seen = {(r["quality"], r["kept"]): r["count"] for r in out.join(labels, "doc_id").groupBy("quality", "kept").count().collect()}
    assert seen[(1, True)] >= 0.97 * (seen[(1, True)] + seen.get((1, False), 0))
    assert seen[(0, False)] >= 0.8 * (seen[(0, False)] + seen.get((0, True), 0))


def test_verdicts_match_a_plain_version(spark):
    """The rules that were learned, applied one by one to plainly counted statistics."""
    sf = "/root/testdata/sf0.01"
    docs, labels = read(spark, sf, "documents"), read(spark, sf, "labels")
    rules = quality.fit(docs, labels)
    assert rules and all(1 <= len(r) <= quality.CONDITIONS for r in rules)
    texts = texts_of(spark, sf)

    def kept(text):
        n, chars, symbols, dup, repeat = naive_counts(text)
        w, lines = re.findall(r"[^\x20\x09-\x0D]+", text or ""), [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        per = max(n, 1)
        named = {
            "n_words": float(n), "mean_word": chars / per, "symbols": symbols / per, "dup_lines": dup / max(len(lines), 1), "repeats": repeat / per, "distinct": len(set(w)) / per,
            "upper": sum(x.isupper() for x in w) / per, "marks": ((text or "").count("!") + (text or "").count("?")) / per,
        }
        if n < 10 or 100 * repeat > 20 * n:
            return False
        return not any(all(named[name] >= t if op == ">=" else named[name] <= t for name, op, t in rule) for rule in rules)

    assert {r["doc_id"]: r["kept"] for r in quality.judge(docs, labels).collect()} == {d: kept(t) for d, t in texts.items()}


def test_rare_labels_are_learned():
    """A label that is one in a thousand is sampled by itself and weighed back."""
    rng = np.random.default_rng(5)
    x = rng.random((4000, 3))
    y = np.zeros(4000, dtype=bool)
    y[:400] = True
    x[:400, 1] += 2
    rules = quality.learn(x, y, weight=(1.0, 0.001))
    assert rules and rules[0][0][0] == 1 and rules[0][0][1] == ">="
    mixed = x.copy()
    mixed[400:800, 1] += 2  # as many others look the same, and each stands for a thousand
    assert quality.learn(mixed, y, weight=(1.0, 0.001)) == []


def test_quality_edge_cases(spark):
    docs = docs_frame(spark, [None, "", "a b c d e f g h i j k", (None, "x")]).withColumn("quality", F.lit(1)).withColumn("n_words", F.lit(5))
    labels = spark.createDataFrame([(0, 0), (2, 1), (2, None), (None, 0)], "doc_id long, quality int")
    rows = {r["doc_id"]: (r["base_failed"], r["kept"]) for r in quality.judge(docs, labels).collect()}
    assert rows == {0: (True, False), 1: (True, False), 2: (False, True), None: (True, False)}
    assert quality.judge(docs.limit(0), labels.limit(0)).count() == 0


# ---- languages


def test_language_held_out(spark):
    docs = read(spark, "/root/testdata/sf0.01", "documents")
    rows = language.held_out_languages(docs).join(docs.select("doc_id", "lang"), "doc_id").collect()
    held = [r for r in rows if r["held_out"]]
    assert all((zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) == r["held_out"] for r in rows)
    assert sum(r["lang_pred"] == r["lang"] for r in held) >= 0.97 * len(held)
    assert all(0 <= r["score"] <= 1 for r in rows)


def test_language_edge_cases(spark, monkeypatch):
    docs = docs_frame(spark, [None, "", "12 ?!", "a", "漢字", "ab " * 40_000, (None, "hello"), *((i, "plain words") for i in range(20, 30))]).withColumn("v", F.lit(1))
    rows = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in language.held_out_languages(docs).collect()}
    assert rows[0] == rows[1] == rows[2] == ("und", 0.0) and rows[3][0] == rows[4][0] == "en"
    assert {r["lang_pred"] for r in language.held_out_languages(docs.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}
    assert language.held_out_languages(docs.limit(0)).count() == 0
    texts = ["some words here", "漢字かな交じり文", "другой текст", "x"]
    want = language.Profiler(256).profile(texts)
    monkeypatch.setattr(language, "KEPT", 5)
    assert np.array_equal(language.Profiler(256).profile(texts), want)
    monkeypatch.setattr(language, "SLICE_CHARS", 3)
    monkeypatch.setattr(language, "CHARS", 4)
    assert np.array_equal(language.Profiler(256).profile(texts), want)
    assert not language.Profiler(256).profile(["", "1 2 3 4 5 6", None]).any()


def test_predictions_match_a_plain_version(spark):
    """Prototypes, cosines and the best language, by sums over each text's letters."""
    dim = 256
    rng = random.Random(31)
    texts = ["".join(rng.choice(a) for _ in range(rng.randint(0, 60))) for a in ("abcé  1", "cdef  .", "xyzß  漢") for _ in range(30)]
    langs = ["aa"] * 30 + ["bb"] * 30 + ["cc"] * 30
    docs = docs_frame(spark, texts).withColumn("lang", F.element_at(F.array(*map(F.lit, langs)), F.col("doc_id").cast("int") + 1))
    sign = {}

    def letter(c):
        if c not in sign:
            sign[c] = 1 - 2 * language.letter_bits(np.array([0 if c == " " else ord(c)]), dim, language.SEED)[0].astype(int)
        return sign[c]

    def profile(text):
        chars = "".join(c if c.isalpha() else " " for c in text.lower())
        chars = re.sub(" +", " ", f" {chars} ")
        out = np.zeros(dim)
        if chars.strip():
            for a, b, c in zip(chars, chars[1:], chars[2:]):
                out += np.roll(letter(a), 2) * np.roll(letter(b), 1) * letter(c)
        return out

    unit = lambda v: v / max(np.linalg.norm(v), 1e-12)
    sums = {}
    for t, lang in zip(texts, langs, strict=True):
        sums[lang] = sums.get(lang, 0) + unit(profile(t))
    prototypes = {k: unit(v) for k, v in sorted(sums.items())}
    for r in language.identify(docs, language.fit(docs, dim=dim), dim).collect():
        v = profile(texts[r["doc_id"]])
        if not v.any():
            assert (r["lang_pred"], r["score"]) == ("und", 0.0)
            continue
        cosine = {k: float(unit(v) @ p) for k, p in prototypes.items()}
        best = max(cosine, key=cosine.get)
        assert r["lang_pred"] == best or abs(cosine[r["lang_pred"]] - cosine[best]) < 1e-4
        assert abs(r["score"] - max(0, cosine[r["lang_pred"]])) < 1e-4


def test_rare_languages_are_learned(spark):
    texts = [f"the house and the garden {i}" for i in range(400)] + ["1 2 3"] * 300 + ["das Haus und der Garten"] * 2
    docs = docs_frame(spark, texts).withColumn("lang", F.when(F.col("doc_id") < 400, "en").otherwise("de"))
    langs, prototypes = language.fit(docs, sample=5)
    assert langs == ["de", "en"] and np.allclose(np.linalg.norm(prototypes, axis=1), 1)


def test_profile_binds_and_bundles():
    p = language.Profiler(256)
    bits = {c: language.letter_bits(np.array([0 if c == " " else ord(c)]), 256, language.SEED)[0].astype(int) for c in " ab"}
    sign = {c: 1 - 2 * b for c, b in bits.items()}
    want = sum(np.roll(sign[x], 2) * np.roll(sign[y], 1) * sign[z] for x, y, z in (" ab", "ab ", "b b", " b "))
    assert np.array_equal(p.profile(["AB, 1 b"])[0], want)


# ---- tokens


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(bpe.vocabulary())


def test_token_counts(spark, sf, library):
    texts = {**texts_of(spark, sf), **{10**6 + i: t for i, t in enumerate(ODD)}}
    docs = docs_frame(spark, list(texts.items()) + [(None, "a b")]).withColumn("piece", F.lit(1)).withColumn("n", F.lit(1))
    for sample in (2000, 0):  # the table changes no count
        rows = token_counts.count_tokens(docs, sample=sample).collect()
        assert len(rows) == len(texts) + 1
        for r in rows:
            t = texts.get(r["doc_id"], "a b") or ""
            n = len(library.encode(t, add_special_tokens=False).ids)
            assert (r["n_bytes"], r["n_tokens"], r["over_limit"]) == (len(t.encode()), n, n > 1024), t[:50]
    assert token_counts.count_tokens(docs.limit(0)).count() == 0


def test_counts_of_characters_that_unicode_versions_class_otherwise(spark, library):
    rng = random.Random(12)
    planes = [(0x20, 0x2FF), (0x300, 0xFFF), (0x1000, 0xD7FF), (0xE000, 0xFFFF), (0x10000, 0x1FFFF), (0x20000, 0x3FFFF), (0xE0000, 0x10FFFF)]
    char = lambda: chr(rng.randint(*rng.choice(planes))) if rng.random() < 0.6 else rng.choice("ab1 !\n\u9c30\u00e9")
    texts = ["\U0003e79a\u9c30", "\U0003d3c8\u8258", "a\u0558b", "x\u088f1"] + ["".join(char() for _ in range(rng.randint(1, 9))) for _ in range(20_000)]
    rows = token_counts.count_tokens(docs_frame(spark, texts)).collect()
    assert all(r["n_tokens"] == len(library.encode(texts[r["doc_id"]], add_special_tokens=False).ids) for r in rows) and len(rows) == len(texts)
    assert all(bpe.encoder(bpe.vocabulary()).ids(t).tolist() == library.encode(t, add_special_tokens=False).ids for t in texts)


def test_settled_characters_split_as_in_the_library(library):
    """Every code point of the blocks that may be cut into pre-tokens here, in all surroundings."""
    e = bpe.encoder(bpe.vocabulary())
    known = [c for c in map(chr, [*range(0xD800), *range(0xE000, 0x20000)]) if not e.unsettled(c)]
    assert len(known) > 30_000
    for c in known:
        text = f"a{c}a 1{c}1 !{c}! x{c}{c}x {c} {c}"
        want = [text[a:b] for _, (a, b) in library.pre_tokenizer.pre_tokenize_str(text)]
        assert e.split(text) == want, hex(ord(c))


def test_rows_that_share_an_id_stay_one_in_the_sample(spark, library):
    docs = docs_frame(spark, [(1, f"word{i} again") for i in range(300)] + [(2, "again")])
    pieces, lens = token_counts.frequent(docs, bpe.vocabulary(), 10)
    assert len(pieces.split("\0")) == len(lens) or not lens
    assert token_counts.count_tokens(docs).count() == 301


def test_small_caches_change_no_count(monkeypatch):
    monkeypatch.setattr(token_counts, "CACHE", 2)
    lengths = token_counts.Lengths({" the": 1}, bpe.vocabulary())
    assert [lengths[x] for x in (" the", "zq", " zzq", "qqqz", " the", "zq")] == [bpe.encoder(bpe.vocabulary()).piece(x) for x in (" the", "zq", " zzq", "qqqz", " the", "zq")]


# ---- packing


def check_packed(rows, ids_of, capacity=1024):
    """Pieces cover their documents, sequences are gapless; the padding they need."""
    by_doc, by_seq = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r["doc_id"]].append(r)
        by_seq[r["sequence_id"]].append(r)
    assert set(by_doc) == set(ids_of)
    for d, pieces in by_doc.items():
        ids, at = ids_of[d], 0
        for p in sorted(pieces, key=lambda r: r["start"]):
            assert p["start"] == at and p["doc_tokens"] == len(ids) and p["length"] > 0
            assert p["ids_crc32"] == zlib.crc32(np.array(ids[at : at + p["length"]], dtype="<u4").tobytes())
            at += p["length"]
        assert at == len(ids)
    pad = total = 0
    for pieces in by_seq.values():
        at = 0
        for p in sorted(pieces, key=lambda r: r["offset"]):
            assert p["offset"] == at
            at += p["length"]
        assert at <= capacity
        total += at
        pad += 0 if at & (at - 1) == 0 else capacity - at
    return pad, total


def test_packing(spark, library):
    texts = {**texts_of(spark, "/root/testdata/sf0.01"), **{10**6 + i: t for i, t in enumerate(ODD)}}
    ids = {d: [*library.encode(t or "", add_special_tokens=False).ids, 0] for d, t in texts.items()}
    rows = packing.pack(docs_frame(spark, list(texts.items()), 2).withColumn("ids", F.lit(1))).collect()
    pad, total = check_packed(rows, ids)
    assert pad < 0.01 * total
    again = packing.pack(docs_frame(spark, list(texts.items()), 2), with_ids=True)
    assert all(zlib.crc32(r["ids"]) == r["ids_crc32"] for r in again.collect())
    assert packing.pack(docs_frame(spark, [])).count() == 0
    assert packing.pack(docs_frame(spark, [(1, "a"), (1, "a"), (None, None)])).count() == 3


def test_differencing_is_near_equal_and_never_over_capacity():
    rng = random.Random(8)
    for _ in range(60):
        sizes = [rng.randint(1, 256) for _ in range(rng.randint(1, 400))]
        k = rng.randint(1, 40)
        groups = packing.differencing(sizes, k)
        assert sorted(i for g in groups for i in g) == list(range(len(sizes))) and len(groups) <= k
        groups = packing.windows(sizes, 256)
        assert sorted(i for g in groups for i in g) == list(range(len(sizes)))
        assert all(sum(sizes[i] for i in g) <= 256 for g in groups)
    assert packing.differencing([8, 7, 6, 5, 4], 2) and packing.windows([], 10) == []
    sums = [sum([8, 7, 6, 5, 4][i] for i in g) for g in packing.differencing([8, 7, 6, 5, 4], 2)]
    assert sorted(sums) == [14, 16]
