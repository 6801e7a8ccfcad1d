"""Nulls, empty and long texts, ties, repeated rows, empty tables and clashing extra columns, for every operator and stage."""

import public_tokenizers
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from markbook.llm import chat, decontam, imatch, langid, linededup, mixing, pii, ppm, simhash, tokenbin

WORDS = "the cat sat on a mat while rain fell over grey hills and nobody came to see it".split()
LONG = " ".join(WORDS[i % len(WORDS)] + str(i % 97) for i in range(30_000))
DOCS = "doc_id long, text string, lang string, source string, n_chars long"
ROWS = [(1, "The cat sat on the mat. It was warm.", "en", "a", 3), (2, "Le chat est sur la table, et il dort.", "fr", None, None), (2, "Le chat est sur la table, et il dort.", "fr", None, None), (3, None, "en", "a", 0), (4, "", None, "b", 0), (5, "12 34 !!", "en", "a", 8), (None, "The dog sat on the mat. It was cold.", "en", "a", 1), (6, LONG, "en", "a", 9), (7, "é中 𝒳", None, "x", 2)]
TOK = public_tokenizers.path("word_bpe_49k.json")
#: Names that clash with those the operators use inside.
EXTRA = ["score", "fp", "p", "rate", "term", "key", "id", "line", "root", "bucket", "n_tokens", "held_out", "row", "bad_doc", "of_doc", "gone_lines", "at", "none", "first", "n"]

OPERATORS = {
    "langid": langid.identify,
    "simhash": simhash.near_duplicates,
    "pii": lambda d: pii.digest(pii.detect(d)),
    "imatch": imatch.fingerprint_table,
    "tokens": lambda d: tokenbin.token_table(d, TOK),
    "ppm": ppm.score,
    "lines": linededup.line_report,
    "mixing": lambda d: mixing.mixture(d, d.sparkSession.createDataFrame([(1, 1, 0), (2, 0, 0), (6, 1, 1), (6, None, 0)], "doc_id long, quality int, toxic int")),
}
FILTERS = {
    "langid": langid.accepted,
    "simhash": simhash.one_of_each,
    "decontam": lambda d: decontam.decontaminated(d, d.sparkSession.createDataFrame([(1, "zz")], "item_id long, text string")),
    "lines": linededup.without_dropped,
    "mixing": lambda d: mixing.mixed(d, d.sparkSession.createDataFrame([(1, 1, 0), (2, 0, 0)], "doc_id long, quality int, toxic int")),
}


#: What stays of ROWS: no document but those without letters goes in language ID; of two rows of one text, one; copies of lines go, not documents.
KEPT = {
    "langid": [None, 1, 2, 2, 6, 7],
    "simhash": [None, 1, 2, 3, 5, 6, 7],
    "decontam": [None, 1, 2, 2, 3, 4, 5, 6, 7],
    "lines": [None, 1, 2, 2, 3, 4, 5, 6, 7],
}


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, DOCS).withColumns({c: F.lit("x") for c in EXTRA})


@pytest.mark.parametrize("name", OPERATORS)
def test_every_row_has_its_result(docs, name):
    got = OPERATORS[name](docs)
    key = lambda x: (x is not None, x or 0)
    assert sorted((r.doc_id for r in got.collect()), key=key) == sorted((r[0] for r in ROWS), key=key)


@pytest.mark.parametrize("name", OPERATORS)
def test_empty_table(spark, name):
    assert OPERATORS[name](spark.createDataFrame([], DOCS)).count() == 0


@pytest.mark.parametrize("name", FILTERS)
def test_filters_keep_columns(spark, docs, name):
    got = FILTERS[name](docs)
    assert got.columns == docs.columns
    kept, key = [r.doc_id for r in got.collect()], lambda x: (x is not None, x or 0)
    if name in KEPT:
        assert sorted(kept, key=key) == KEPT[name]
    assert FILTERS[name](spark.createDataFrame([], DOCS)).count() == 0


def test_conversations(spark):
    kind = "conv_id long, turn long, role string, text string, whole string, chain int"
    data = [(1, 0, "user", "a"), (1, 1, "assistant", "b"), (2, 0, "user", "a"), (3, 0, "user", "a"), (3, 1, "assistant", "b"), (3, 2, "user", None), (4, 0, None, None), (4, 0, None, None), (5, None, "user", "z"), (None, 0, "user", "q"), (6, 0, "user", "z")]
    got = {r.conv_id: r for r in chat.format_chats(spark.createDataFrame([(*d, "w", 1) for d in data], kind)).collect()}
    assert set(got) == {None, 3, 4, 5}
    assert (got[5].n_copies, got[3].n_turns, got[4].n_turns) == (2, 3, 2)
    assert got[3].text == "<|im_start|>user\na<|im_end|>\n<|im_start|>assistant\nb<|im_end|>\n<|im_start|>user\n<|im_end|>\n"
    assert chat.format_chats(spark.createDataFrame([], kind)).count() == 0


def test_hash_parts_cannot_be_shifted(spark):
    kind = "conv_id long, turn long, role string, text string"
    got = chat.format_chats(spark.createDataFrame([(1, 0, "ab", "c"), (2, 0, "a", "bc")], kind))
    assert got.count() == 2


def test_decontamination_edges(spark, docs):
    items = spark.createDataFrame([(1, None), (2, ""), (3, "cat sat on"), (4, "Le chat est sur la table, et il dort."), (4, "Le chat est sur la table, et il dort."), (None, "the dog sat on the mat")], "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in decontam.contaminated(docs, items).collect()}
    assert got == {(1, 3), (2, 4), (None, None)}
    assert decontam.contaminated(docs, items.limit(0)).count() == 0
    assert decontam.contaminated(docs.limit(0), items).count() == 0
    assert {r.doc_id for r in decontam.decontaminated(docs, items).collect()} == {3, 4, 5, 6, 7}


def test_pipeline_on_nulls(spark, tmp_path):
    spark.createDataFrame(ROWS, DOCS).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, 1, 0), (2, 0, 0)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(1, "nobody came to see it")], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert got and [n for n, _ in corpus_pipeline.STAGES][0] == "language ID"
    assert all(r.n_tokens >= 1 for r in got)


def test_stages_return_the_columns_of_documents(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    kept = {r.doc_id for r in docs.collect()}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, sf)
        assert out.columns == docs.columns, name
        assert {r.doc_id for r in out.select("doc_id").collect()} <= kept

