"""Mixing against a plain solver, and the pipeline's stages against plain versions over whole documents."""

import collections
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from markbook.llm import decontam, langid, mixing, queries
from test_growth import brute_overlap

SF = "/root/testdata/sf0.001"


def test_rates_against_a_plain_solver(spark):
    got = queries.op2_mixing(spark, SF).collect()
    names = sorted(mixing.TARGETS)
    n, p = np.array([r.n_tokens for r in got], float), np.array([[r[f"p_{d}"] for d in names] for r in got])
    share = np.array([mixing.TARGETS[d] for d in names])
    first = n @ p
    target = share / share.sum() * mixing.HEADROOM * first[share.argmax()] / (share / share.sum())[share.argmax()]
    loss = lambda r: float((((r * n) @ p - target) ** 2 / first).sum())
    scaled = p / np.sqrt(first)  # rates in the metric of tokens: each document's gradient over its tokens
    top = np.linalg.eigvalsh((scaled * n[:, None]).T @ scaled).max()
    rate = np.ones(len(n))
    for _ in range(3000):
        rate = np.maximum(0, rate - p @ (((rate * n) @ p - target) / first) / top)
    fitted = np.array([r.rate for r in got])
    assert fitted.min() >= 0 and np.abs((fitted * n) @ p - (rate * n) @ p).max() < 4e-3 * target.sum()
    assert loss(fitted) <= loss(rate) + 1e-4 * loss(np.ones(len(n)))
    assert all(abs(r.copies - r.rate) < 1 for r in got)


def shingle_set(text):
    words = (text or "").encode().lower().split()
    return {tuple(words)} if 0 < len(words) <= 5 else {tuple(words[i : i + 5]) for i in range(len(words) - 4)}


def kept_of_near_copies(rows):
    sets = [shingle_set(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            a, b = sets[i], sets[j]
            both = len(a & b)
            if both >= 0.8 * (len(a) + len(b) - both):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    first = {}
    for i, (d, _) in enumerate(rows):
        r = find(i)
        first[r] = min(first.get(r, d), d)
    return sorted(first.values())


def overlapping(spark, rows, items):
    """Ids of documents that hold an item, over every shift with enough equal tokens."""
    kind = "id long, text string"
    toks = lambda xs: {r.id: r.t for r in spark.createDataFrame(xs, kind).select("id", decontam.tokens(decontam.F.col("text")).alias("t")).collect()}
    docs, items, out = toks(rows), toks(items), set()
    for item in items.values():
        least, places = min(13, len(item)), collections.defaultdict(list)
        for j, x in enumerate(item):
            places[x].append(j)
        for d, doc in docs.items():
            shifts = collections.Counter(i - j for i, x in enumerate(doc) for j in places.get(x, ()))
            for shift, k in shifts.items():
                best = brute_overlap(doc, item, shift, 0.8) if item and k >= least else None
                if best and best[0] >= least:
                    out.add(d)
    return out


@pytest.fixture(scope="module")
def stages(spark):
    """Rows (doc_id, text) after each stage, and the last stage's rows."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = [docs]
    for name, stage in corpus_pipeline.STAGES:
        out.append(corpus_pipeline.storage.written(stage(spark, out[-1], SF), "whole"))
    return [x.collect() for x in out]


def plain(rows):
    return [(r.doc_id, r.text) for r in rows]


def test_language_stage(spark, stages):
    model = langid.train(spark.read.parquet(f"{SF}/documents.parquet"))
    names, scores = model.predict([r.text for r in stages[0]])
    want = [r.doc_id for r, k, s in zip(stages[0], names, scores) if s >= 0.1 or (k != "und" and len(r.text) < 20)]
    assert sorted(r.doc_id for r in stages[1]) == sorted(want)


def test_near_dedup_stage(stages):
    assert sorted(r.doc_id for r in stages[2]) == kept_of_near_copies(plain(stages[1]))


def test_decontamination_stage(spark, stages):
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    bad = overlapping(spark, plain(stages[2]), items)
    gone = {r.doc_id for r in stages[2]} - {r.doc_id for r in stages[3]}
    assert gone <= bad and len(gone) >= 0.97 * len(bad) and bad


def test_mixing_stage(spark, stages):
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    before, after = (collections.Counter(r.doc_id for r in stages[i]) for i in (3, 4))
    assert set(after) <= set(before)
    assert all(after[d] >= 1 for d in before if labels.get(d) == 0)


def test_token_stage(stages):
    tok = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want = collections.Counter()
    for d, text in plain(stages[4]):
        ids = [*tok.encode(text or "", add_special_tokens=False).ids, 1]
        want[d, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())] += 1
    got = stages[5]
    assert collections.Counter((r.doc_id, r.n_tokens, r.ids_crc32) for r in got) == want
    at = 0
    for r in sorted(got, key=lambda r: r.start):
        assert r.start == at
        at += r.n_tokens
