"""Work in proportion to the length of one long token, item or shard; the same results as plain versions."""

import itertools
import random
import re
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from markbook.llm import decontam, eliasfano, pii, tokenbin

SECRET = rf"(?i){pii.SECRET}\s*([:=])\s*(\S{{6,}})$"


def test_names_of_secrets_as_the_pattern_finds_them():
    rng = random.Random(3)
    bits = ["key", "Token", "pass", "word", "pwd", "secret", "api-key", "_", "a", "1", ":", "=", " ", "é", '"', "abcdef"]
    for _ in range(20_000):
        s = "".join(rng.choice(bits) for _ in range(rng.randrange(1, 9))).strip()
        m = re.search(SECRET, s)
        assert pii.assigned(s) == (m.start(1) if m else None), s
        text = s + "="
        want = re.search(rf"(?i){pii.SECRET}[\s:=]*$", s) is not None
        assert pii.after_name(text, 0, len(s)) == want, s


@pytest.mark.parametrize("unit", ["key1", "key", "token=", "key.", "a@", "1.", "+1(", "4 ", "key: "])
def test_pii_of_long_tokens_in_proportion(unit):
    field = pii.trained()

    def seconds(n):
        text = unit * (n // len(unit))
        began = time.perf_counter()
        pii.find(text, field)
        return time.perf_counter() - began

    small = max(min(seconds(16_000) for _ in range(2)), 0.02)
    assert seconds(128_000) < 8 * 4 * small


def brute_overlap(doc, item, shift, share):
    equal = [0 <= j + shift < len(doc) and doc[j + shift] == x for j, x in enumerate(item)]
    found = [(sum(equal[a:b]), a - b, -a - shift, -a) for a, b in itertools.combinations(range(len(item) + 1), 2) if equal[a] and equal[b - 1] and 1000 * sum(equal[a:b]) >= round(share * 1000) * (b - a)]
    return max(found, default=None)


@pytest.mark.parametrize("share", [0.8, 0.5, 1.0, 0.35])
def test_overlaps_against_brute_force(spark, share):
    rng = random.Random(int(share * 100))
    data = []
    for i in range(250):
        item = [rng.randrange(3) for _ in range(rng.randrange(1, 18))]
        doc = [rng.randrange(3) if rng.random() < 0.3 else x for x in item] + [rng.randrange(3)] * 3
        data.append((i, doc, item, rng.randrange(-4, 5) if rng.random() < 0.5 else 0))
    df = spark.createDataFrame(data, "i int, doc array<long>, item array<long>, shift int")
    places = decontam.equal_places(F.col("doc"), F.col("item"), F.col("shift"))
    got = {r.i: tuple(r.m) for r in df.select("i", decontam.bound(places, lambda p: decontam.overlap(p, F.col("shift"), share)).alias("m")).collect()}
    assert got == {i: brute_overlap(d, x, s, share) or (None,) * 4 for i, d, x, s in data}


def test_long_items_and_repetitive_texts(spark):
    words = [f"w{i}" for i in range(20_000)]
    changed = [w if i % 5 else "other" for i, w in enumerate(words)]
    repeated = " ".join(["same"] * 3000)
    docs = spark.createDataFrame([(1, " ".join(changed)), (2, repeated), (3, "nothing here")], "doc_id long, text string")
    items = spark.createDataFrame([(1, " ".join(words)), (2, " ".join(["same"] * 40))], "item_id long, text string")
    began = time.perf_counter()
    got = {(r.doc_id, r.item_id): (r.n_tokens, r.n_equal, r.doc_token) for r in decontam.contaminated(docs, items).collect()}
    assert got == {(1, 1): (19_999, 16_000, 1), (2, 2): (40, 40, 0)} and time.perf_counter() - began < 60


def test_selects_of_runs():
    rng = np.random.default_rng(4)
    for values in (np.cumsum(rng.integers(0, 50, 5000)), np.cumsum(rng.integers(0, 2, 3000)) + 10**12, np.concatenate([np.zeros(700), np.full(700, 10**9)]), np.array([5]), np.array([0])):
        values = values.astype(np.uint64)
        r = eliasfano.Reader(eliasfano.encode(values))
        for _ in range(60):
            lo = int(rng.integers(0, len(values) + 1))
            hi = int(rng.integers(lo, len(values) + 1))
            assert np.array_equal(r.run(lo, hi), values[lo:hi])
        assert [r.select(i) for i in range(0, len(values), 101)] == values[::101].tolist()
        with pytest.raises(IndexError):
            r.select(len(values))


def test_texts_are_encoded_in_runs_of_bytes():
    texts = [b"a" * n for n in (10, 2000, 5, 5, 900, 0, 0, 1)]
    parts = list(tokenbin.balanced(texts, 1000))
    assert [t for p in parts for t in p] == texts and all(len(p) == 1 or sum(map(len, p)) <= 1000 for p in parts)


def test_no_link_of_a_large_bucket_is_left_out(spark):
    """Members of one bucket, each like one other only: whichever lead, all are linked; where all are alike no pair beside the leader's is judged."""
    from markbook.llm import buckets
    from markbook.llm.storage import Counted

    keys = spark.range(600).select("id", F.lit(7).cast("long").alias("band"))
    asked = []

    def judge(ok):
        def run(pairs, ids):
            asked.append(pairs.n)
            return Counted(pairs.df.withColumn("ok", F.expr(ok)), "pairs")

        return run

    for rounds in (1, 2):
        got = {(r.u, r.v) for r in buckets.links(keys, judge("u - v = 300"), rounds).collect()}
        assert got == {(i + 300, i) for i in range(300)}
    asked.clear()
    assert buckets.links(keys, judge("true"), 1).count() == 599 and sum(asked) == 599


def test_sketches_rule_out_no_alike_sets(spark):
    """Of sets with every likeness none that has the least is ruled out, and of unlike ones most are."""
    from markbook.llm import buckets

    rng = np.random.default_rng(5)
    sets = []
    for _ in range(400):
        n = int(rng.integers(1, 400))
        a = rng.integers(0, 1 << 63, n, dtype=np.uint64)
        b = np.concatenate([a[: n - int(rng.integers(0, n // 3 + 1))], rng.integers(0, 1 << 63, int(rng.integers(0, n // 4 + 1)), dtype=np.uint64)])
        sets += [np.concatenate([a, a[:3]]), b]
    n, bits = buckets.sketches(np.concatenate(sets), np.array([len(x) for x in sets]))
    assert n.to_pylist() == [len(set(x.tolist())) for x in sets]
    rows = [(i, (n[2 * i].as_py(), bits[2 * i].as_py()), (n[2 * i + 1].as_py(), bits[2 * i + 1].as_py())) for i in range(len(sets) // 2)]
    df = spark.createDataFrame(rows, f"i int, a struct<{buckets.SKETCH}>, b struct<{buckets.SKETCH}>")
    got = {r.i: r.ok for r in df.select("i", buckets.may_be_alike(F.col("a"), F.col("b"), 0.8).alias("ok")).collect()}
    like = [len(set(a.tolist()) & set(b.tolist())) / len(set(a.tolist()) | set(b.tolist())) for a, b in zip(sets[::2], sets[1::2])]
    assert all(got[i] for i, x in enumerate(like) if x >= 0.8) and sum(x >= 0.8 for x in like) > 50
    assert sum(got[i] for i, x in enumerate(like) if x < 0.65) < 0.1 * sum(x < 0.65 for x in like)


def test_unlike_lines_of_large_buckets_are_not_judged(spark, monkeypatch):
    """Lines that share buckets by a phrase only: pairs of them are not verified one by one, and the alike ones among them are linked."""
    from markbook.llm import linededup

    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(6))
    lines = [f"{word()} and with {word()}" for _ in range(300)]
    long = " ".join(word() for _ in range(40))
    lines += [long, long + " end", "the " + long]
    asked = []
    spread = linededup.spread
    monkeypatch.setattr(linededup, "spread", lambda pairs: asked.append(pairs.n) or spread(pairs))
    docs = spark.createDataFrame([(i, x) for i, x in enumerate(lines)], "doc_id long, text string")
    got = {r.doc_id for r in linededup.line_report(docs).where("n_kept = 0").collect()}
    assert got == {301, 302} and sum(asked) < 300


def test_only_lines_of_buckets_are_shuffled_as_texts(spark):
    """Lines that are in no bucket are left out by a bitmap before the shuffle, and copies of a line are combined."""
    from markbook.llm import linededup

    lines = spark.range(4000).selectExpr("concat('line ', id % 2000) line").selectExpr("xxhash64(line) id", "line")
    ids = lines.where("id % 50 = 0").select("id").distinct()
    got = linededup._texts_of(lines, ids)
    want = {(r.id, r.line) for r in lines.where("id % 50 = 0").collect()}
    assert want and sorted(map(tuple, got.collect())) == sorted(want)
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "LeftSemi" not in plan and plan.index("Aggregate [id") < plan.index("getbit") < plan.index("bitmap_construct_agg")
