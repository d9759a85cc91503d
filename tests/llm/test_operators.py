"""Operators against plain code on small tables with nulls, empty and long texts, repeated rows and clashing columns."""

import collections
import hashlib
import math
import re
import tracemalloc
import zlib
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tests.compare import connect, rows_of
from tidelog.llm import gru_lm, jaccard_join, mixing, pii, quality, queries, suffix_dedup, toxicity, vp_tree

SF = "/root/testdata/sf0.001"
PASSAGE = " ".join(f"shared{i}" for i in range(70))
BASE = [f"word{i} and the rest of it" for i in range(60)]
ROWS = [
    (1, None, "a", None), (2, "", None, 0), (3, "One two", "a", 1), (3, "One two", "a", 1), (4, " \t\n ", "b", 0),
    (5, "start " + PASSAGE + " end of five", "b", 1), (6, "other " + PASSAGE + " finish", None, 0),
    (7, " ".join(BASE), "c", 1), (8, " ".join(BASE[:-1] + ["changed it"]), "c", 0), (9, "x" * 5000, "a", 1),
    (None, "no id here", "a", 1), (10, "mail me.you@host.example.org at 10.0.0.256 or 10.0.0.25, +1 (234) 555-7777 "
     "card 4539 1488 0343 6467 and 4539148803436468", "d", 1), (11, "é ñ " + PASSAGE.upper(), "a", 0),
]


@pytest.fixture(scope="module")
def docs(spark):
    """With columns named like those the operators make."""
    rows = [(i, t, s, n, "x", 1, 2.0) for i, t, s, n in ROWS]
    return spark.createDataFrame(
        rows, "doc_id long, text string, source string, n_chars long, spans string, size int, target double")


def brute_removed(texts, n=suffix_dedup.LENGTH):
    raw = [(t or "").encode() for t in texts]
    seen = collections.Counter(b[i:i + n] for b in raw for i in range(len(b) - n + 1))
    out = []
    for b in raw:
        gone = np.zeros(len(b), dtype=bool)
        for i in range(len(b) - n + 1):
            if seen[b[i:i + n]] > 1:
                gone[i:i + n] = True
        spans = int((gone & ~np.concatenate([[False], gone[:-1]])).sum()) if len(b) else 0
        kept = bytes(c for c, g in zip(b, gone) if not g)
        out.append((len(b), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest()))
    return out


def test_suffix_dedup(docs):
    got = suffix_dedup.remove(docs).select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256)).collect()
    want = [(i, *r) for (i, *_), r in zip(ROWS, brute_removed([r[1] for r in ROWS]))]
    assert sorted(map(tuple, got), key=repr) == sorted(want, key=repr)
    assert sum(r[2] for r in want) > 1000


def test_frequent_anchors_are_not_joined_in_one_task(spark, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "OFTEN", 20)
    rows = spark.range(4000, numPartitions=4).selectExpr("id", "IF(id % 2 = 0, -1, IF(id < 100, 1, IF(id < 200, id % 40, id))) AS h")
    got = suffix_dedup._again(rows, "h").withColumn("task", F.spark_partition_id()).collect()
    want = collections.Counter(r["h"] for r in rows.collect())
    assert sorted((r["id"], r["h"]) for r in got) == sorted((r["id"], r["h"]) for r in rows.collect() if want[r["h"]] > 1)
    assert max(collections.Counter(r["task"] for r in got if r["h"] == -1).values()) <= 500


def test_frequent_line_in_texts(spark, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "OFTEN", 20)
    draw = np.random.default_rng(12)
    text = lambda n: "".join(map(chr, draw.integers(97, 123, n)))
    short, long, line, few = text(390), text(1000), text(150), text(500)
    texts = [text(int(draw.integers(0, 500))) + (short, long, line, "is on. " * 90)[i % 4] + text(int(draw.integers(0, 500)))
             for i in range(160)] + [few + text(300), text(200) + few, long[:430], long[30:], None, "", "é" * 450]
    # Cut at places that share between 399 and 401 bytes around the same anchor.
    texts += [text(250) + long[300 - k:700] + text(250) for k in (-1, 0, 1)]
    docs = spark.createDataFrame(list(enumerate(texts + texts[:3])), "doc_id long, text string").repartition(3)
    got = suffix_dedup.remove(docs).select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256)).collect()
    assert sorted(map(tuple, got)) == [(i, *r) for i, r in enumerate(brute_removed(texts + texts[:3]))]


def test_members_of_a_group_take_little_memory():
    draw = np.random.default_rng(13)
    members = [(draw.bytes(400), draw.bytes(300), i, 300) for i in range(3000)]
    members.append((*members[0][:2], -1, 300))
    tracemalloc.start()
    try:
        out = suffix_dedup._stretches(members, np.zeros(len(members), dtype=np.uint64))
        most = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert sorted(out) == [(-1, 0, 700), (0, 0, 700)]
    assert most < 3000 * len(members)


def test_loser_tree_merges_runs():
    draw = np.random.default_rng(2)
    words = sorted(bytes(draw.integers(97, 99, draw.integers(0, 12))) for _ in range(300))
    runs = [suffix_dedup.front_code([(w, b"", 0, i) for i, w in enumerate(words) if i % 5 == k]) for k in range(5)]
    out = list(suffix_dedup.LoserTree(runs))
    assert [x[0] for x in out] == words
    for a, b in zip(out, out[1:]):
        n = 0
        while n < min(len(a[0]), len(b[0])) and a[0][n] == b[0][n]:
            n += 1
        assert b[1] == n


def test_nearest_vectors(spark):
    draw = np.random.default_rng(4)
    rows = [(i, [float(x) for x in draw.normal(size=6)]) for i in range(400)]
    rows += [(400 + i, rows[0][1]) for i in range(40)] + [(500, None), (501, [0.0] * 6), (502, [1.0, None] * 3),
             (503, [float("nan")] * 6), (None, [1.0] * 6), (504, [1.0, 2.0]), (7, rows[7][1])]
    table = spark.createDataFrame([(i, v, 1, 1) for i, v in rows], "vec_id long, embedding array<double>, rank int, q int")
    got = collections.defaultdict(list)
    for r in vp_tree.search(table, F.col("vec_id") % 50 == 0, shard_rows=100, block=6).collect():
        got[r["query_id"]].append((r["rank"], r["vec_id"], r["score"]))
    good = {i: np.array(v) for i, v in rows if i is not None and v and None not in v and np.isfinite(v).all() and any(v)}
    for q in [i for i in good if i % 50 == 0]:
        near = sorted((-float((v * good[q]).sum() / np.sqrt((v * v).sum()) / np.sqrt((good[q] ** 2).sum())), i)
                      for i, v in good.items() if i != q and len(v) == len(good[q]))
        near = sorted((round(s, 12), i) for s, i in near)[:5]
        assert [i for _, i in near] == [v for _, v, _ in sorted(got[q])]
    assert set(got) == {i for i in good if i % 50 == 0}


def plain_nearest(rows, q, k=5):
    """Exact: cosines by whole squares, ties to the smaller id."""
    own = [Fraction(x) for x in dict(rows)[q]]

    def order(v):
        v = [Fraction(x) for x in v]
        dot = sum(a * b for a, b in zip(v, own))
        return -dot * abs(dot) / sum(a * a for a in v)

    return [i for _, i in sorted((order(v), i) for i, v in rows if i != q)[:k]]


@pytest.mark.parametrize("kind", ["multiples", "mirrored multiples", "one-hot", "signs"])
def test_nearest_vectors_with_ties(spark, kind):
    """Many different vectors at one cosine: the smaller ids win, in one shard and over several."""
    draw = np.random.default_rng(8)
    base = draw.integers(1, 9, 8).astype(float)
    rows = {
        "multiples": [(60 - i, base * (i + 1)) for i in range(30)],
        "mirrored multiples": [(60 - i, np.roll(base, i % 2 * 4) * (i // 2 + 3)) for i in range(30)],
        "one-hot": [(300 - i, np.eye(150)[i] * (1 + i % 7)) for i in range(150)],
        "signs": [(700 - i, v) for i, v in enumerate(draw.integers(0, 2, (400, 8)) * 1.0) if v.any()]}[kind]
    rows = [(i, [float(x) for x in v]) for i, v in rows + [(50 * (i + 20), draw.integers(0, 3, len(rows[0][1])) + base[0])
                                                           for i in range(3)] + [(0, rows[3][1])]]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    for shard_rows in (100_000, 40):
        got = collections.defaultdict(list)
        for r in vp_tree.search(table, F.col("vec_id") % 50 == 0, shard_rows=shard_rows).orderBy("query_id", "rank").collect():
            got[r["query_id"]].append(r["vec_id"])
        assert set(got) == {i for i, _ in rows if i % 50 == 0}
        for q, found in got.items():
            assert found == plain_nearest(rows, q), (q, shard_rows)


def test_mix(docs):
    got = mixing.mix(docs).collect()
    assert len(got) == len(ROWS)
    by_source = collections.defaultdict(lambda: [0, 0, 0.0])
    for r in got:
        by_source[r["source"]][0] += r["size"]
        by_source[r["source"]][1] += r["taken"]
        by_source[r["source"]][2] = r["target"]
        assert 0 <= r["taken"] <= 3 * r["size"] and r["source_size"] >= r["size"]
    total = sum(v[0] for v in by_source.values())
    assert math.isclose(sum(v[2] for v in by_source.values()), total)
    largest = max(r["size"] for r in got)
    assert all(abs(v[1] - v[2]) <= largest and v[2] <= 3 * v[0] + 1e-9 for v in by_source.values())
    again = mixing.mix(docs).collect()
    assert sorted(map(repr, got)) == sorted(map(repr, again))
    rows = collections.Counter(r["doc_id"] for r in mixing.mixed(docs).collect())
    assert rows == collections.Counter({i: n for i, n in collections.Counter(
        x for r in got for x in [r["doc_id"]] * r["copies"]).items() if n})


def test_mix_probabilities(spark):
    """Scales against bisection, with lengths that become certain and without, with nothing left, and with empty texts."""
    lengths = {"a": {10: 50, 200: 3, 20000: 1}, "b": {5: 7, 0: 3}, "c": {100: 2, 7: 9}, "d": {0: 4}}
    rest = {"a": 21050.0, "b": 20.0, "c": 0.0, "d": 0.0}
    got = {r["skey"]: r["scale"] for r in mixing.scales(
        spark.createDataFrame([(k, s, n) for k, v in lengths.items() for s, n in v.items()], "skey string, size long, n long"),
        spark.createDataFrame(list(rest.items()), "skey string, rest double")).collect()}
    assert set(got) == {"a", "b", "c"}
    for k, scale in got.items():
        def expected(c, k=k):
            return sum(min(1.0, c * (1 + math.log(1 + s))) * s * n for s, n in lengths[k].items())
        low, high = 0.0, 1.0
        for _ in range(200):
            middle = (low + high) / 2
            low, high = (middle, high) if expected(middle) < rest[k] else (low, middle)
        assert math.isclose(scale, high, abs_tol=1e-9) and math.isclose(expected(scale), rest[k], abs_tol=1e-6)
    assert got["a"] * (1 + math.log(20001)) > 1


def test_mixed_keeps_clashing_columns(spark, docs):
    clashing = docs.withColumns({n: F.lit("own") for n in ("skey", "u", "v", "copies", "cut", "rest", "row", "scale", "__v")})
    out = mixing.mixed(clashing)
    assert out.columns == clashing.columns
    assert out.select("skey", "copies", "row").distinct().collect() == [("own", "own", "own")]
    assert out.count() == mixing.mixed(docs).count()


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def plain_spans(text):
    out = []
    for kind, pattern in (("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
                          ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"), ("card", r"[0-9]([\x20-]?[0-9])+"),
                          ("phone", r"\+[0-9][\x20().0-9-]+[0-9]")):
        for m in re.finditer(pattern, text or ""):
            digits = re.sub("[^0-9]", "", m[0])
            if (kind == "ip" and any(int(x) > 255 for x in m[0].split("."))
                    or kind == "card" and not (13 <= len(digits) <= 19 and luhn(digits))
                    or kind == "phone" and not 9 <= len(digits) <= 15):
                continue
            out.append((kind, m.start(), m.end()))
    return out


ODD = ["a@b.c_d@e.f", "a@b", "x..y@h-.i.j@k.l", "1.2.3.4.5.6.7.8", "001.002.003.004", "+1 2 3 4 5 6 7 8 9", "é +12345678901 ",
       "1" * 3000, "a" * 3000 + "@b.c", "4539-1488 0343-6467", "+1(((((", "@@a@b.cc..d", "%%a%b@c.d.e."]


def test_personal_data(spark, docs):
    table = docs.unionByName(spark.createDataFrame([(100 + i, t) for i, t in enumerate(ODD)], "doc_id long, text string"),
                             allowMissingColumns=True)
    texts = {i: t for i, t, *_ in ROWS} | {100 + i: t for i, t in enumerate(ODD)}
    for r in pii.find(table).collect():
        assert [tuple(s) for s in r["base"]] == plain_spans(texts[r["doc_id"]]), texts[r["doc_id"]]
        assert set(map(tuple, r["base"])) <= set(map(tuple, r["spans"]))
    clean = {r["doc_id"]: r["text"] for r in pii.redact(table).collect()}
    assert clean[10] == "mail [email] at 10.0.0.256 or [ip], [phone] card [card] and 4539148803436468"
    assert clean[1] is None and clean[7] == texts[7]


def test_learned_patterns(spark):
    rows = [(i, f"please write to user{i}@mail.example.com soon") for i in range(20)] + [
        (50, "please write to someone@localhost soon"), (51, "nothing to someone@elsewhere")]
    found = {r["doc_id"]: r for r in pii.digest(pii.find(spark.createDataFrame(rows, "doc_id long, text string"))).collect()}
    assert found[0]["n_email"] == 1
    assert found[50]["n_email"] == 0
    seeds = [(i, f"badge id: {i % 10}{i}00.{i}.1.9 ok") for i in range(20)]
    seeds = [(i, f"host ip: 10.1.2.{i} ok") for i in range(20)] + [(60, "host ip: 10.1.2.999 ok"), (61, "see 10.1.2.999")]
    found = {r["doc_id"]: r["spans"] for r in pii.digest(pii.find(
        spark.createDataFrame(seeds, "doc_id long, text string"))).collect()}
    assert found[60] == "ip:9:19" and found[61] == ""


def learned(spark, texts):
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return [sorted(set(map(tuple, r["spans"])) - set(map(tuple, r["base"])))
            for r in pii.find(rows).orderBy("doc_id").collect()]


def test_contexts_reach_over_candidates_and_groups(spark):
    lists = [f"ips: 10.1.2.{i} 10.1.3.{i}" for i in range(20)] + ["ips: 10.1.2.3 10.1.2.999"]
    assert learned(spark, lists)[20] == [("ip", 14, 24)]
    groups = [f"call: +49 30 {1000000 + i}." for i in range(20)] + ["call: +49 30 123, then", "see +49 30 123"]
    assert learned(spark, groups)[20:] == [[("phone", 6, 16)], []]
    far = "y" * 500 + ":"
    assert learned(spark, [f"{far} 10.1.2.{i}" for i in range(20)] + [f"{far} 10.1.2.999", f"z{far} 1.2.3.999"])[20:] == [
        [("ip", 502, 512)], []]


def test_rare_words_share_a_pattern(spark):
    words = ["".join(chr(97 + int(d)) for d in str(1000 + i)) for i in range(20)]
    texts = [f"{w}: 10.1.2.{100 + i}" for i, w in enumerate(words)] + ["other: 10.1.2.999", "see 10.1.2.999"]
    assert learned(spark, texts)[20:] == [[("ip", 7, 17)], []]


def test_no_pattern_confirms_itself(spark):
    """Where hardly more than half of a pattern's candidates are cards, rounds do not raise it to all of them."""
    numbers = [str(4539148803430000 + i) for i in range(400)]
    texts = [f"the {n} here" for n in numbers if luhn(n)] + [f"the {n} here" for n in [n for n in numbers if not luhn(n)][:30]]
    assert not any(learned(spark, texts))


def test_redact_keeps_clashing_columns(spark, docs):
    clashing = docs.withColumns({n: F.lit("own") for n in ("__key", "__spans", "row", "row_key", "clean", "base", "more")})
    out = pii.redact(clashing)
    assert out.columns == clashing.columns and out.count() == docs.count()
    assert out.select("row", "clean", "spans").distinct().collect() == [("own", "own", "x")]


def test_toxicity(spark):
    clean = [(i, "some plain words about number" + chr(97 + i % 26) + " and rivers", 0) for i in range(120)]
    bad = [(1000 + i, "some plain vile words and vilest rivers" if i % 2 else "you are vile today", 1) for i in range(60)]
    docs = spark.createDataFrame(clean + bad + [(5000, None, 0), (5001, "", 0)], "doc_id long, text string, toxic int")
    model = toxicity.train(docs.select("doc_id", "text"), docs.select("doc_id", "toxic"))
    rows = {r["doc_id"]: r for r in toxicity.tag(docs, model).collect()}
    assert all(rows[i]["score"] < toxicity.CUT for i, _, _ in clean) and rows[5000]["score"] < toxicity.CUT
    assert all(rows[i]["score"] >= toxicity.CUT for i, _, _ in bad)
    text, spans = bad[0][1], rows[1000]["offsets"]
    assert "vile" in [text[s["start"]:s["stop"]] for s in spans]
    none = toxicity.train(docs.select("doc_id", "text"), docs.select("doc_id", "toxic").limit(0))
    assert toxicity.tag(docs, none).filter("score > 0.01").count() == 0


def test_chain_marginals_over_gaps():
    draw = np.random.default_rng(0)
    chain = toxicity.Chain(3)
    chain.word[:], chain.near[:], chain.move[:] = draw.normal(size=4), draw.normal(size=2), draw.normal(size=(2, 2))
    for n in (1, 2, 40, 300):
        ids = draw.integers(0, 4, n) * (draw.random(n) < 0.2)
        whole, _ = chain.marginals(ids[None, :], np.array([n]))
        (places, p), = chain.events([ids])
        assert np.allclose(whole[0, places], p)


def test_quality_keep(docs):
    kept = [r["doc_id"] for r in quality.keep(docs).collect()]
    assert kept == [r["doc_id"] for r in quality.measure(docs).filter("kept").collect()]
    assert quality.keep(docs).columns == docs.columns


def plain_counts(rows):
    counts = collections.Counter()
    for i, t in rows:
        if zlib.crc32(("" if i is None else str(i)).encode()) % 7 != 2:
            counts.update([*(t or "").encode().lower().split(), b""])
    return counts


def test_language_model(docs):
    counts = plain_counts([(r[0], r[1]) for r in ROWS])
    n, v = sum(counts.values()), len(counts)
    texts = {(r[0], r[1]) for r in ROWS}
    got = gru_lm.score(docs).join(docs.select("doc_id", "text").distinct().withColumnRenamed("doc_id", "d"),
                                  F.col("doc_id").eqNullSafe(F.col("d"))).collect()
    assert len(got) == len(ROWS)
    for r in got:
        assert (r["doc_id"], r["text"]) in texts
        tokens = [*(r["text"] or "").encode().lower().split(), b""]
        base = sum(math.log10((counts[t] + 1) / (n + v + 1)) for t in tokens)
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (len(tokens), sum(counts[t] > 0 for t in tokens), n)
        assert math.isclose(r["base_score"], base, rel_tol=1e-9) and r["score"] < 0


def test_network_gradient():
    v = gru_lm.Vocabulary([(f"w{i}", 1000 - i) for i in range(900)] + [("", 50)], 500_000, 950)
    draw = np.random.default_rng(1)
    trainer = gru_lm.Trainer(gru_lm.start_weights(v))
    trainer.w = {k: x.astype(np.float64) + 0.1 * draw.normal(size=x.shape) * (x > -50) for k, x in trainer.w.items()}
    doc = np.append(draw.integers(1, v.n_in, 20), 0)
    seen = {}
    trainer._update = lambda grad, n: seen.update(grad)
    trainer.fit([doc])
    for k in ("W", "U", "b", "C", "D"):
        at = np.unravel_index(np.abs(seen[k]).argmax(), seen[k].shape)
        old, losses = trainer.w[k][at], []
        for step in (1e-3, -1e-3):
            trainer.w[k][at] = old + step
            losses.append(-gru_lm.score_docs(trainer.w, [doc])[0])
        trainer.w[k][at] = old
        assert math.isclose((losses[0] - losses[1]) / 2e-3, seen[k][at], rel_tol=2e-2), k


def plain_components(rows, n_words, percent):
    sets, parent = {}, {}
    for i, t in rows:
        w = (t or "").encode().lower().split()
        n = min(n_words, len(w))
        sets[i] = frozenset(tuple(w[k:k + n]) for k in range(len(w) - n + 1)) if w else frozenset()
        parent[i] = i

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            x = len(sets[a] & sets[b])
            if a < b and sets[a] and sets[b] and 100 * x >= percent * len(sets[a] | sets[b]):
                parent[max(find(a), find(b))] = min(find(a), find(b))
    return {i: (len(sets[i]), find(i)) for i in ids}


@pytest.mark.parametrize("n_words,percent", [(3, 90), (5, 80), (1, 50)])
def test_jaccard_join(spark, docs, n_words, percent):
    draw = np.random.default_rng(n_words)
    extra = []
    for g in range(6):
        base = [f"t{x}" for x in draw.integers(0, 400, 60)]
        for k in range(12):
            w = list(base)
            for at in draw.integers(0, 60, k % 4):
                w[at] = f"n{draw.integers(0, 400)}"
            extra.append((1000 + 20 * g + k, " ".join(w)))
    table = docs.filter("doc_id is not null").select("doc_id", "text").unionByName(
        spark.createDataFrame(extra, "doc_id long, text string"))
    rows = [(r["doc_id"], r["text"]) for r in table.collect()]
    want = plain_components(rows, n_words, percent)
    got = jaccard_join.components(table, n_words=n_words, percent=percent).collect()
    assert len(got) == len(rows)
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got} == want
    kept = sorted(r["doc_id"] for r in jaccard_join.keep_one(table, n_words=n_words, percent=percent).collect())
    assert kept == sorted({c for n, c in want.values() if n} | {i for i, (n, _) in want.items() if not n})


def test_suffix_filter_of_very_long_sets(spark):
    """Counts that do not fit their type must not rule a pair out; counts that fit still do."""
    def entry(ranges, n):
        return (n, 0, None if ranges is None else [int(x) for x in ranges])

    def allowed(a, b):
        kind = "struct<n:bigint,pos:bigint,ranges:array<smallint>>"
        pair = spark.createDataFrame([(a, b)], f"x {kind}, y {kind}")
        return pair.filter(jaccard_join._may_be_similar("x", "y", 90)).count() == 1

    n = 3_000_000
    long = entry(jaccard_join._ranges(np.arange(n, dtype=np.int64) * ((1 << 63) // n)), n)
    fits = entry([30_000] * 64, 64 * 30_000)
    assert allowed(long, long) and allowed(long, entry(None, n - 1000)) and allowed(fits, fits)
    assert allowed(entry([32_767] * 64, 64 * 32_767), entry(None, 64 * 32_768))
    assert not allowed(fits, entry([30_000] * 50 + [0] * 14, 64 * 30_000))
    assert not allowed(long, entry(None, n // 2))


def test_join_with_common_passages(spark, monkeypatch):
    """Long passages in most texts, sizes at the edge of a bucket, and common tokens that are joined by broadcast."""
    monkeypatch.setattr(jaccard_join, "COMMON", 40)
    draw = np.random.default_rng(11)
    passage = [f"p{i}" for i in range(40)]
    rows = []
    for i in range(120):
        own = [f"w{x}" for x in draw.integers(0, 3000, int(draw.integers(5, 60)))]
        rows.append((i, " ".join((passage if i % 3 else []) + own)))
    rows += [(200 + n, " ".join(f"s{i}" for i in range(n))) for n in range(60, 101)]  # each a prefix of the next
    table = spark.createDataFrame(rows, "doc_id long, text string")
    for n_words, percent in [(1, 80), (3, 90), (2, 100)]:
        got = {r["doc_id"]: (r["n_shingles"], r["component_id"])
               for r in jaccard_join.components(table, n_words=n_words, percent=percent).collect()}
        assert got == plain_components(rows, n_words, percent)


def test_rarest_tokens_come_first(spark, monkeypatch):
    """Positions follow the frequency among all classes, whichever tokens are joined by broadcast."""
    sets = {1: [10, 20, 30, 40], 2: [20, 30, 40, 50], 3: [30, 40, 60, 61], 4: [40, 70, 71, 72]}
    table = spark.createDataFrame([(c, len(t), t, [0] * 64) for c, t in sets.items()],
                                  "c long, n long, tokens array<long>, ranges array<smallint>")
    for common in (1, 3, 1 << 16):
        monkeypatch.setattr(jaccard_join, "COMMON", common)
        scratch = jaccard_join.Scratch(spark, "test")
        got = sorted((r["c"], r["pos"], r["h"]) for r in jaccard_join._index(table, 1, scratch).collect())
        assert got == [(1, 1, 20), (1, 2, 30), (1, 3, 40), (2, 1, 20), (2, 2, 30), (2, 3, 40), (3, 2, 30), (3, 3, 40),
                       (4, 3, 40)]
        scratch.close()


def test_null_ids_in_join(docs):
    rows = {(r["doc_id"], r["component_id"]) for r in jaccard_join.components(docs).collect()}
    assert (None, None) in rows and len(jaccard_join.keep_one(docs).collect()) == 9  # 3, 5 and 7 have copies


def test_empty_tables(docs):
    none = docs.limit(0)
    assert suffix_dedup.remove(none).count() == 0
    assert mixing.mix(none).count() == 0 and mixing.mixed(none).count() == 0
    assert pii.find(none).count() == 0 and pii.redact(none).count() == 0
    assert quality.measure(none).count() == 0
    assert gru_lm.score(none).count() == 0
    assert jaccard_join.components(none).count() == 0 and jaccard_join.keep_one(none).count() == 0
    vectors = none.selectExpr("doc_id AS vec_id", "array(1.0) AS embedding")
    assert vp_tree.search(vectors, F.col("vec_id") % 50 == 0).count() == 0


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_same_rows_as_sql(spark, name):
    frame = queries.QUERIES[name](spark, SF)
    got = rows_of(frame.columns, [tuple(r) for r in frame.collect()])
    result = connect(SF).execute(queries.ORACLES[name])
    assert got == rows_of([d[0] for d in result.description], result.fetchall())


def test_pipeline(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, SF).columns == docs.columns
    kept = {r["doc_id"] for r in quality.measure(docs).filter("kept").collect()}
    texts = [(r["doc_id"], r["text"]) for r in docs.collect() if r["doc_id"] in kept]
    groups = plain_components(texts, 5, 80)
    stay = {i for i, (n, c) in groups.items() if i == c}
    rows = corpus_pipeline.run(spark, SF).collect()
    assert rows and {r["doc_id"] for r in rows} <= stay
    copies = collections.Counter(r["doc_id"] for r in rows)
    assert max(copies.values()) <= 3
