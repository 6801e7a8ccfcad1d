"""Fill-in-middle and token counts: brute force over whole documents, exact round trips, edge cases."""

import hashlib
import random

import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from markbook.llm import fim, queries, tokencount

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string"
LONG = " ".join(f"word{i % 991}" for i in range(200_000))
EDGES = [(1, None), (2, ""), (3, " "), (4, "a <M> b"), (5, "<P"), (6, LONG), (6, LONG), (None, "null id"), (7, "é中 𝒳\r\n\n x"), (8, "<|endoftext|> a<|endoftext|>b"), (9, "x" * 300_000)]


@pytest.fixture(scope="module")
def texts(spark):
    return {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}


@pytest.fixture(scope="module")
def edges(spark):
    clash = ["n", "form", "output", "digest", "h1", "plain", "n_tokens", "n_bytes", "over_limit"]
    return spark.createDataFrame(EDGES, DOCS).withColumns({c: F.lit("x") for c in clash})


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def fim_brute(doc_id, text):
    d = sha(f"1:{'' if doc_id is None else doc_id}")
    h = [int(d[i : i + 8], 16) for i in range(0, 32, 8)]
    n = len(text)
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        return n, "plain", None, None, sha(text), sha(text)
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    form = "spm" if h[3] % 100 < 20 else "psm"
    p, m, s = text[:a], text[a:b], text[b:]
    out = f"<S>{s}<P>{p}<M>{m}" if form == "spm" else f"<P>{p}<S>{s}<M>{m}"
    return n, form, a, b - a, sha(out), sha(text)


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_fim_of_every_document(spark, texts):
    got = queries.op12_fim(spark, SF)
    assert got.columns == ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output_sha256", "restored_sha256"]
    assert rows_of(got) == sorted(((d, *fim_brute(d, t)) for d, t in texts.items()), key=repr)
    assert {r.form for r in got.collect()} == {"plain", "psm", "spm"}


def test_fim_edges(spark, edges):
    assert rows_of(fim.digest(fim.fill_in_middle(edges))) == sorted(((d, *fim_brute(d, t or "")) for d, t in EDGES), key=repr)
    assert fim.fill_in_middle(edges.limit(0)).count() == 0


@given(st.text(alphabet="ab<PSM>\né\U0001d4b3", max_size=700), st.integers(0, 2**32 - 1), st.integers(0, 2**32 - 1))
@settings(max_examples=150, deadline=None)
def test_offsets_are_those_of_code_points(text, h1, h2):
    at = fim.Offsets(text)
    assert at.n == len(text) and at[at.n] == len(text)
    assert all(at[i] == i for i in {h1 % (at.n + 1), h2 % (at.n + 1)})


def test_offsets_over_blocks():
    text = "aé\U0001d4b3\n" * (fim.BLOCK // 2 + 5)
    at = fim.Offsets(text)
    assert at.n == len(text) and all(at[i] == i for i in (0, fim.RUN, fim.BLOCK - 1, fim.BLOCK, fim.BLOCK + 1, at.n - 1, at.n))


def test_texts_that_end_in_parts_of_markers_come_back(spark):
    rng = random.Random(3)
    some = [(i, "".join(rng.choice(["<", "<P", "<S", "<M", ">", "x", "\n", "$1", "\\"]) for _ in range(rng.randrange(12)))) for i in range(400)]
    formed = fim.fill_in_middle(spark.createDataFrame(some, DOCS), formed_pct=100, spm_pct=50)
    got = {r.doc_id: (r.form, r.t) for r in formed.select("doc_id", "form", fim.restored(F.col("output"), F.col("form")).alias("t")).collect()}
    assert {d: t for d, (_, t) in got.items()} == dict(some) and {f for f, _ in got.values()} == {"plain", "psm", "spm"}


@pytest.fixture(scope="module")
def byte_bpe():
    return Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


def test_counts_of_every_document(spark, texts, byte_bpe):
    got = queries.op13_tokencount(spark, SF)
    assert got.columns == ["doc_id", "n_bytes", "n_tokens", "over_limit"]
    n = {d: len(byte_bpe.encode(t, add_special_tokens=False)) for d, t in texts.items()}
    assert rows_of(got) == sorted(((d, len(t.encode()), n[d], n[d] > 1024) for d, t in texts.items()), key=repr)


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json", "piece_bpe_32k.model"])
def test_count_edges(spark, edges, name):
    path = public_tokenizers.path(name)
    if name.endswith(".json"):
        encode = lambda t: len(Tokenizer.from_file(path).encode(t, add_special_tokens=False))
    else:
        import sentencepiece

        encode = lambda t: len(sentencepiece.SentencePieceProcessor(model_file=path).encode(t))
    want = sorted(((d, len((t or "").encode()), encode(t or "")) for d, t in EDGES), key=repr)
    assert rows_of(tokencount.token_counts(edges, path).drop("over_limit")) == want
    assert tokencount.token_counts(edges.limit(0), path).count() == 0


@given(st.lists(st.sampled_from([*"ab1.'", "'s", " ", "  ", "\n", "\t", "\x1c", "\x85", "\xa0", " ", "　", "​", "中", "é", "<|endoftext|>", "<|end", "oftext|>"]), max_size=60))
@settings(max_examples=300, deadline=None)
def test_boundaries_are_safe(byte_bpe, found):
    text = "".join(found)
    whole = len(byte_bpe.encode(text, add_special_tokens=False))
    count = tokencount.counter(public_tokenizers.path("byte_bpe_50k.json"))
    assert count.safe and count.count([text]) == [whole] and count.count([text, text]) == [whole, whole]
    assert sum(len(byte_bpe.encode(p, add_special_tokens=False)) for p in tokencount.parts(text, 3)) == whole


def test_table_of_pieces_is_bounded(monkeypatch, byte_bpe):
    monkeypatch.setattr(tokencount, "KEPT_PIECES", 50)
    count = tokencount.Counter(public_tokenizers.path("byte_bpe_50k.json"))
    texts = [" ".join(f"w{i}x{j}" for j in range(40)) for i in range(30)]
    assert count.count(texts[:15]) + count.count(texts[15:]) == [len(byte_bpe.encode(t)) for t in texts]
    count.count(["y" * 5000, "z"])
    assert all(len(p) <= tokencount.KEPT_LENGTH for p in count.known) and len(count.known) < 700
