"""Spelling variants against brute force, and the parts of the index."""

import collections
import random
import re
import zlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from markbook.llm import queries, spelling

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string"
FOLD = str.maketrans(spelling.CAPITALS, spelling.SMALL)


def edited(w, letters):
    """Every text one edit away."""
    out = {w[:i] + w[i + 1 :] for i in range(len(w))}
    out |= {w[:i] + c + w[i + 1 :] for i in range(len(w)) for c in letters} | {w[:i] + c + w[i:] for i in range(len(w) + 1) for c in letters}
    return out - {w}


def brute(docs, least_length=7, least_n=2, ratio=10):
    n = collections.Counter()
    for d, t in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            run = run.translate(FOLD)
            h = zlib.crc32(f"{'' if d is None else d}:{run}".encode())
            if h % 31 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            n[run] += len(run) >= least_length
    n = {w: k for w, k in n.items() if k >= least_n}
    letters = {c for w in n for c in w}
    near = {w: [x for x in edited(w, letters) if x in n] for w in n}
    best = {w: min(x, key=lambda y: (-n[y], y)) for w, x in near.items() if x}
    form = {w: x for w, x in best.items() if n[x] >= ratio * n[w]}
    root = lambda w: root(form[w]) if w in form else w
    return sorted(((w, form.get(w), root(w), n[w], len(near[w]), n.get(form.get(w))) for w in n), key=repr)


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


@pytest.fixture(scope="module")
def documents(spark):
    return [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]


def test_every_word_of_documents(spark, documents):
    got = queries.op11_spelling(spark, SF)
    assert got.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    want = brute(documents)
    assert rows_of(got) == want and any(r[1] for r in want)


def crowd(seed, stem, alphabet, n, lengths):
    """Words that share a stem, so their postings are large."""
    rng = random.Random(seed)
    out = {stem + "".join(rng.choice(alphabet) for _ in range(rng.choice(lengths))) for _ in range(n)}
    return sorted(out)


@pytest.mark.parametrize("paired,most", [(64, 512), (2, 512), (1, 3), (4, 20)])
def test_large_postings_lose_no_pair(spark, paired, most):
    """Also with bounds so low that postings are merged by the heap and split by further grams."""
    some = crowd(1, "shared", "ab", 60, (2, 3, 4)) + crowd(2, "", "xyz", 150, (7, 8)) + crowd(3, "aaaaaaa", "aé", 20, (1, 2, 3)) + ["long" * 40, "long" * 40 + "x", "long" * 30 + "lonk" + "long" * 9]
    table = spark.createDataFrame([(w, i + 2) for i, w in enumerate(sorted(set(some)))], "word string, n long")
    got = [(r.a, r.b) for r in spelling.near_pairs(table, paired, most).collect()]
    letters = {c for w in some for c in w}
    want = {tuple(sorted((w, x), key=lambda y: (len(y), y))) for w in some for x in edited(w, letters) if x in set(some)}
    assert len(got) == len(set(got)) and set(got) == want and len(want) > 100


@given(st.text(alphabet="abc", min_size=7, max_size=10), st.text(alphabet="abc", min_size=7, max_size=10), st.integers(0, 30), st.sampled_from("abcd"), st.integers(0, 2))
@settings(max_examples=300, deadline=None)
def test_verification(a, other, at, letter, kind):
    i = at % len(a)
    b = (a[:i] + letter + a[i + 1 :], a[:i] + letter + a[i:], other)[kind]
    if not 0 <= len(b) - len(a) <= 1:
        return
    want = b in edited(a, "abcd")
    assert spelling.one_edit(a, b) == want
    assert bool(spelling.near(spelling.letters([a], len(a)), spelling.letters([b], len(b)))[0]) == want
    if a != b:
        sides = [spelling.SAME] * 2 if len(a) == len(b) else [spelling.SHORT, spelling.LONG]
        assert [(0, 1)] * want == [tuple(sorted(p)) for p in spelling.heap_pairs([a, b], sides)]


@given(st.lists(st.lists(st.integers(0, 9), unique=True).map(sorted), min_size=1, max_size=7), st.integers(1, 5))
@settings(max_examples=300, deadline=None)
def test_merge_counts(lists, least):
    tally = collections.Counter(x for own in lists for x in own)
    assert spelling.merged(list(lists), least) == sorted(x for x, k in tally.items() if k >= least)


def test_edges(spark):
    long = "z" * 3000
    some = [(1, None), (2, ""), (3, "Wonderful wonderful WONDERFUL"), (3, "Wonderful wonderful WONDERFUL"), (None, "wonderfol wonderfol Étésétés"), (4, f"{long} {long} {long}y {long}y {long}"), (5, "Étésétés étésétés"), (6, " ".join(["wonderfully"] * 9))]
    docs = spark.createDataFrame(some, DOCS).withColumns({c: F.lit("x") for c in ("word", "n", "key", "own", "run", "h")})
    assert rows_of(spelling.variants(docs, ratio=2)) == brute(some, ratio=2)
    assert spelling.variants(docs.limit(0)).count() == 0
    assert spelling.variants(docs.where("doc_id < 3")).count() == 0


def test_forms_lead_to_roots(spark):
    text = " ".join(["abcdefgh"] * 1300 + ["abcdefg"] * 110 + ["abcdefgx"] * 20 + ["abcdexgx"] * 2)
    got = {r.word: r for r in spelling.variants(spark.createDataFrame([(10, text), (11, "abcdxxgx abcdxxgx")], DOCS)).collect()}
    want = {r[0]: r for r in brute([(10, text), (11, "abcdxxgx abcdxxgx")])}
    assert {w: tuple(r) for w, r in got.items()} == want
