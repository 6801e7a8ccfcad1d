"""From raw documents to token shards: five stages, each an operator of ``markbook.llm``.

Each stage takes (spark, docs, sf_dir), works on all that its predecessor kept and returns the columns of ``documents``,
the last one the token table. ``run`` writes each result in the shared folder and rereads it.

* language ID: documents that read as no learned language go (no letters, or hardly any likeness to one);
* SimHash near-dedup: of each component of near copies (five-word likeness of 0.8 or more) the smallest doc_id stays, null
  last; documents of one doc_id but different texts are different documents;
* benchmark decontamination: documents that hold a passage of a benchmark item go;
* mixing: every document stands as often as its fitted rate says, by domains of the labelled table;
* token-ID output: ids in shards with Elias-Fano boundaries, read back as doc_id, start, n_tokens, ids_crc32.

Of the documents, the columns of ``COLUMNS`` go through the stages; others are left out by the first one.
A document that mixing repeats has as many rows in the last result. Empty tables pass through; nulls are as each
operator's docstring says.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from markbook.llm import decontam, langid, mixing, simhash, storage, tokenbin
from markbook.llm.queries import table

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return langid.accepted(docs.select(*COLUMNS))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.one_of_each(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontam.decontaminated(docs, table(spark, sf_dir, "benchmark"))


def mixing_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mixed(docs, table(spark, sf_dir, "labels"))


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return tokenbin.token_table(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES: list[tuple[str, Stage]] = [
    ("language ID", language_id),
    ("SimHash near-dedup", near_dedup),
    ("benchmark decontamination", decontamination),
    ("mixing sources", mixing_sources),
    ("token-ID output", token_ids),
]

#: The first stage has no form in SQL. Tests hold near-dedup and decontamination against brute force, token output against an
#: exact round trip, language ID against held-out accuracy and mixing against its targets.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = storage.written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {"pipeline": run}


def oracle_sql() -> dict[str, str]:
    return {} if ORACLE_SQL is None else {"pipeline": ORACLE_SQL}
