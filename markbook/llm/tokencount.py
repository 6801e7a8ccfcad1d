"""Token counts: batch encoding in Arrow functions that return lengths only.

A text over ``PART_BYTES`` is first split at safe boundaries, so that no step holds more than a part of it. A place is safe
where the tokenizer's own splitter always parts the text, whatever stands before or after: for byte-level tokenizers,
before white space that follows anything else. Parts are split further at every such place, and pieces seen lately come
from a bounded table; the others go to the library once each, in batches of about ``BATCH_BYTES`` bytes (counted in characters). Where nothing is
known about a tokenizer's boundaries (``safe`` is false), whole texts are encoded, in batches of bytes as well. Only
the number of ids leaves the workers.

Special strings inside a text count as the library takes them by default; no begin, end or added special token, no
truncation and no padding.

Defined cases: a null or empty text has 0 bytes and 0 tokens; repeated rows each get a row; a null doc_id stays; a piece
without a boundary, however long, is encoded whole; an empty table gives an empty table; other columns are ignored.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from markbook.llm.arrowtools import pieces

PART_BYTES, BATCH_BYTES = 1 << 20, 1 << 18
KEPT_PIECES, KEPT_LENGTH = 400_000, 48
LIMIT = 1024

# The white space of byte-level splitters (that of Unicode).
SPACE = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
PIECE = re.compile(f"[{SPACE}]*[^{SPACE}]+|[{SPACE}]+")
BOUNDARY = re.compile(f"[^{SPACE}][{SPACE}]")


def parts(text: str, most: int) -> Iterator[str]:
    """``text`` cut at boundaries after every ``most`` characters or more."""
    start = 0
    while len(text) - start > most:
        cut = BOUNDARY.search(text, start + most)
        if cut is None:
            break
        yield text[start : cut.start() + 1]
        start = cut.start() + 1
    yield text[start:] if start else text


def batches_of(texts: list[str], most: int) -> Iterator[list[str]]:
    """``texts`` in lists of about ``most`` characters, one text at least."""
    batch, held = [], 0
    for x in texts:
        if batch and held + len(x) > most:
            yield batch
            batch, held = [], 0
        batch.append(x)
        held += len(x)
    if batch:
        yield batch


class Counter:
    """Numbers of tokens of whole texts, by the library that a tokenizer's file is for."""

    def __init__(self, tokenizer: str):
        self.known: dict[str, int] = {}
        self.lengths, self.safe = _library(tokenizer)

    def count(self, texts: list[str]) -> list[int]:
        """Numbers of tokens of ``texts``, which together hold about ``PART_BYTES``, or of one text of any length."""
        if not self.safe:
            return [n for batch in batches_of(texts, BATCH_BYTES) for n in self.lengths(batch)]
        if len(texts) == 1:
            return [sum(self._sums([PIECE.findall(part)])[0] for part in parts(texts[0], PART_BYTES))]
        return self._sums([PIECE.findall(x) for x in texts])

    def _sums(self, found: list[list[str]]) -> list[int]:
        known = self.known
        if len(known) > KEPT_PIECES:
            known.clear()
        fresh = list(set().union(*found).difference(known))
        for batch in batches_of(fresh, BATCH_BYTES):
            known.update(zip(batch, self.lengths(batch)))
        sums = [sum([known[p] for p in own]) for own in found]
        for p in fresh:
            if len(p) > KEPT_LENGTH:
                del known[p]
        return sums


def _library(tokenizer: str) -> tuple[Callable[[list[str]], list[int]], bool]:
    """What counts the tokens of a batch, and whether its boundaries are those of ``PIECE``."""
    if tokenizer.endswith(".model"):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=tokenizer)
        return lambda batch: [len(x) for x in model.encode(batch, num_threads=1)], False
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(tokenizer)
    tok.no_truncation()
    tok.no_padding()
    return lambda batch: [len(e) for e in tok.encode_batch_fast(batch, add_special_tokens=False)], parts_at_space(json.loads(tok.to_str()))


def parts_at_space(plain: dict) -> bool:
    """Whether a tokenizer (as parsed JSON) always parts a text before white space that follows anything else."""
    split = plain.get("pre_tokenizer") or {}
    by_words = split.get("type") == "ByteLevel" and split.get("use_regex") and not split.get("add_prefix_space")
    whole = [t for t in plain.get("added_tokens", []) if t["lstrip"] or t["rstrip"] or t["single_word"] or BOUNDARY.search(t["content"])]
    return bool(by_words and not whole and plain.get("normalizer") is None and not plain["model"].get("dropout"))


_COUNTERS: dict[str, Counter] = {}


def counter(tokenizer: str) -> Counter:
    """One counter a worker process, kept between tasks."""
    if tokenizer not in _COUNTERS:
        _COUNTERS[tokenizer] = Counter(tokenizer)
    return _COUNTERS[tokenizer]


def _worker(tokenizer: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = counter(tokenizer)
        for batch in batches:
            for part in pieces(batch, 2, PART_BYTES):
                texts = part.column(2).to_pylist()
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(count.count(texts), pa.int64())], names=["doc_id", "n_bytes", "n_tokens"])

    return run


def token_counts(docs: DataFrame, tokenizer: str, limit: int = LIMIT, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_bytes (UTF-8), n_tokens, over_limit (more than ``limit`` tokens) of every row."""
    whole = F.coalesce(F.col(text).cast("string"), F.lit(""))
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.octet_length(whole).cast("long").alias("n_bytes"), whole.alias("text"))
    counted = rows.mapInArrow(_worker(tokenizer), "doc_id long, n_bytes long, n_tokens long")
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)
