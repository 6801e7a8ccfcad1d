"""Token-ID / binary output: one concatenated id array a shard, with Elias-Fano document boundaries.

``write_tokens`` deals documents by range of doc_id, sorts each range and writes one shard a task, so shards in
order are the corpus in ascending doc_id. A shard file is

    ids (uint16 where the vocabulary fits, else uint32, little-endian) | boundaries | doc ids | footer

where boundaries are the Elias-Fano code of the end of every document, and doc ids that of doc_id less its
smallest. Files get names of their own for each attempt, and only those of attempts that Spark committed are in
the manifest, so a lost executor or a repeated task leaves no trace in what is read. Files go to the shared
folder through ``pyarrow.fs``.

Texts are encoded word by word: the vocabulary drops white space and never joins two words, so a text's ids are
those of its words (split at ASCII white space), and ids of words seen lately come from a bounded table.

Defined cases: a null text is empty and has the end id alone; null doc ids come first; equal doc ids are
ordered by text; an empty table writes no shard and returns no row; other columns are ignored.
"""

from __future__ import annotations

import json
import os
import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from markbook.llm import eliasfano
from markbook.llm.arrowtools import as_bytes
from markbook.llm.storage import new_folder, written

MAGIC = b"MKBTOK01"
FOOT = "<BQQQqQQ8s"  # id width, documents, ids, null doc ids, smallest doc id, bytes of boundaries and of doc ids
KEPT_WORDS = 600_000
MARKS = b".,!|;:?"
MANIFEST = "shard int, path string, n_docs long, n_tokens long"


class WordEncoder:
    """ids of whole texts, as bytes of ``width`` an id.

    Words go through the tokenizer whole, but for Latin words with or without marks after them: there the
    normaliser only folds case and the splitter parts letters from marks, so the letters go to the same merges
    without those two steps, many at a time.
    """

    def __init__(self, tokenizer: str, keep: int = KEPT_WORDS):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(tokenizer)
        plain = json.loads(self.tok.to_str())
        self.direct = None
        if folds_words(plain):
            self.direct = Tokenizer.from_str(json.dumps(plain | {"normalizer": None, "pre_tokenizer": {"type": "WhitespaceSplit"}, "added_tokens": []}))
            suffix = plain["model"]["end_of_word_suffix"]
            self.last = np.zeros(self.tok.get_vocab_size(), bool)
            self.last[[i for t, i in self.tok.get_vocab().items() if t.endswith(suffix)]] = True
        self.width = 2 if self.tok.get_vocab_size() <= 1 << 16 else 4
        self.kind, self.keep = f"<u{self.width}", keep
        self.known: dict[bytes, bytes] = {}
        self.stems: dict[str, bytes] = {}
        self.marks: dict[bytes, bytes] = {}

    def _whole(self, words: list[bytes]) -> list[bytes]:
        return [np.array(e.ids, self.kind).tobytes() for e in self.tok.encode_batch_fast([w.decode() for w in words], add_special_tokens=False)]

    def _stems(self, stems: list[str]) -> None:
        for i in range(0, len(stems), 512):
            part = stems[i : i + 512]
            e = self.direct.encode_batch_fast([" ".join(s if s.isascii() else byte_letters(s) for s in part)], add_special_tokens=False)[0]
            ids = np.array(e.ids, self.kind)
            ends = ((np.flatnonzero(self.last[ids]) + 1) * self.width).tolist()  # the last piece of a word has the suffix
            data = ids.tobytes()
            self.stems.update((s, data[b:e]) for s, b, e in zip(part, [0, *ends], ends, strict=False))

    def _learn(self, fresh: list[bytes]) -> None:
        other, parted = [], []
        for w in fresh:
            body = w.rstrip(MARKS)
            stem = body.decode().lower()
            if self.direct is not None and stem.isalpha() and (stem.isascii() or latin(body.decode(), stem)):
                parted.append((w, stem, w[len(body) :]))
            else:
                other.append(w)
        if len(self.stems) > self.keep:
            self.stems.clear()
        self._stems(list({s for _, s, _ in parted if s not in self.stems}))
        new = [m for m in {m for _, _, m in parted} if m not in self.marks]
        if len(self.marks) > self.keep:
            self.marks.clear()
            new = list({m for _, _, m in parted})
        self.marks.update(zip(new, self._whole(new)))
        self.known.update((w, self.stems[s] + self.marks[m]) for w, s, m in parted)
        self.known.update(zip(other, self._whole(other)))

    def encode(self, texts: list[bytes]) -> list[bytes]:
        words = [t.split() for t in texts]
        if len(self.known) > self.keep:
            self.known.clear()
        known = self.known
        self._learn(list(set().union(*words).difference(known)))
        return [b"".join([known[w] for w in ws]) for ws in words]


def folds_words(plain: dict) -> bool:
    """Whether a tokenizer (as parsed JSON) only composes, folds and splits words before byte-level merges."""
    steps = [x["type"] for x in (plain.get("normalizer") or {}).get("normalizers", [])]
    model = plain["model"]
    if not model.get("end_of_word_suffix") or model.get("byte_fallback") or model.get("dropout"):
        return False
    return steps == ["NFC", "Replace", "Lowercase"] and [x["type"] for x in (plain.get("pre_tokenizer") or {}).get("pretokenizers", [])] == ["Split", "ByteLevel"]


def latin(word: str, folded: str) -> bool:
    """Letters below U+0250 that fold one to one; those are composed as they stand."""
    return max(word) < "\u0250" and len(word) == len(folded)


def byte_letters(text: str) -> str:
    """The letters by which byte-level merges name the bytes of ``text``: printable Latin-1 stands for itself."""
    if not _LETTERS:
        own = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
        rest = [b for b in range(256) if b not in set(own)]
        _LETTERS.update({b: b for b in own} | {b: 256 + i for i, b in enumerate(rest)})
    return text.encode().decode("latin-1").translate(_LETTERS)


_LETTERS: dict[int, int] = {}
_ENCODERS: dict[str, WordEncoder] = {}


def encoder(tokenizer: str) -> WordEncoder:
    """One encoder a worker process, kept between tasks."""
    if tokenizer not in _ENCODERS:
        _ENCODERS[tokenizer] = WordEncoder(tokenizer)
    return _ENCODERS[tokenizer]


def balanced(texts: list[bytes], most: int = 1 << 20) -> Iterator[list[bytes]]:
    """Lists of texts that together hold about ``most`` bytes, one text at least."""
    part, held = [], 0
    for t in texts:
        if part and held + len(t) > most:
            yield part
            part, held = [], 0
        part.append(t)
        held += len(t)
    if part:
        yield part


def _open(uri: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(uri if "://" in uri or not uri.startswith("file:") else "file://" + uri[5:])


def _writer(folder: str, tokenizer: str, end_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        shard, enc, out = TaskContext.get().partitionId(), encoder(tokenizer), None
        end = np.array([end_id], enc.kind).tobytes()
        sizes: list[int] = []
        ids: list[np.ndarray] = []
        nulls = 0
        for batch in batches:
            if not batch.num_rows:
                continue
            if out is None:
                where, root = _open(folder)
                where.create_dir(root, recursive=True)
                name = f"shard-{shard:06d}-{uuid.uuid4().hex}.tok"
                out = where.open_output_stream(f"{root}/{name}")
            own = batch.column(0)
            nulls += own.null_count
            ids.append(own.drop_null().to_numpy(zero_copy_only=False).astype(np.int64))
            texts = as_bytes(batch.column(1))
            for own_texts in balanced(texts):
                coded = enc.encode(own_texts)
                sizes += [len(x) // enc.width + 1 for x in coded]
                out.write(b"".join(y for x in coded for y in (x, end)))
        if out is None:
            return
        ends = np.cumsum(np.array(sizes, np.uint64))
        docs = np.concatenate(ids)
        base = int(docs[0]) if len(docs) else 0
        bounds, names = eliasfano.encode(ends), eliasfano.encode((docs - base).astype(np.uint64))
        out.write(bounds + names + struct.pack(FOOT, enc.width, len(sizes), int(ends[-1]), nulls, base, len(bounds), len(names), MAGIC))
        out.close()
        yield pa.RecordBatch.from_pydict(
            {"shard": pa.array([shard], pa.int32()), "path": [f"{folder}/{name}"], "n_docs": pa.array([len(sizes)], pa.int64()), "n_tokens": pa.array([int(ends[-1])], pa.int64())}
        )

    return run


def write_tokens(docs: DataFrame, tokenizer: str, end_id: int, doc_id: str = "doc_id", text: str = "text", shards: int | None = None) -> DataFrame:
    """Writes the shards and returns their manifest: shard, path, n_docs, n_tokens, start (ids of all shards before)."""
    spark = docs.sparkSession
    folder = new_folder(spark, "tokens")
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    n = shards or int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows.repartitionByRange(n, F.col("doc_id").asc_nulls_first()).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "text")
    manifest = written(dealt.mapInArrow(_writer(folder, tokenizer, end_id), MANIFEST), "manifest").orderBy("shard").collect()  # one row a shard
    start, out = 0, []
    for m in manifest:
        out.append((m.shard, m.path, m.n_docs, m.n_tokens, start))
        start += m.n_tokens
    return spark.createDataFrame(out, MANIFEST + ", start long")


class Shard:
    """A shard file: its documents by number."""

    def __init__(self, path: str):
        where, name = _open(path)
        self.file = where.open_input_file(name)
        size = self.file.size()
        body = size - struct.calcsize(FOOT)
        foot = self.file.read_at(size - body, body)
        self.width, self.n_docs, self.n_tokens, self.nulls, self.base, nb, nn, magic = struct.unpack(FOOT, foot)
        if magic != MAGIC:
            raise ValueError(f"not a token shard: {path}")
        self.ends = eliasfano.Reader(self.file.read_at(nb, body - nn - nb))
        self.names = eliasfano.Reader(self.file.read_at(nn, body - nn))

    def span(self, i: int) -> tuple[int, int]:
        """First id and end of document i, by select."""
        return (self.ends.select(i - 1) if i else 0), self.ends.select(i)

    def doc_id(self, i: int) -> int | None:
        return None if i < self.nulls else self.base + self.names.select(i - self.nulls)

    def doc_ids(self, lo: int, hi: int) -> list[int | None]:
        """Those of documents lo to hi - 1; null ones come first."""
        none = max(0, min(hi, self.nulls) - lo)
        own = self.names.run(max(lo - self.nulls, 0), max(hi - self.nulls, 0)).astype(np.int64) + self.base
        return [None] * none + own.tolist()

    def tokens(self, start: int, end: int) -> np.ndarray:
        return np.frombuffer(self.file.read_at((end - start) * self.width, start * self.width), f"<u{self.width}")


def _reader(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row in batch.to_pylist():
            shard = Shard(row["path"])
            for lo in range(0, shard.n_docs, 1024):
                hi = min(lo + 1024, shard.n_docs)
                bounds = np.concatenate([[0] if lo == 0 else [], shard.ends.run(max(0, lo - 1), hi)]).astype(np.int64)  # of these documents, by select
                names = shard.doc_ids(lo, hi)
                first = int(bounds[0])
                ids = shard.tokens(first, int(bounds[-1]))
                crc = [zlib.crc32(ids[b - first : e - first].astype("<u4").tobytes()) for b, e in zip(bounds, bounds[1:])]
                yield pa.RecordBatch.from_pydict(
                    {"doc_id": pa.array(names, pa.int64()), "start": pa.array(bounds[:-1] + row["start"], pa.int64()), "n_tokens": pa.array(np.diff(bounds), pa.int64()), "ids_crc32": pa.array(crc, pa.int64())}
                )


def read_tokens(manifest: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document, from the shard files; a task reads a few shards."""
    n = max(1, int(manifest.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return manifest.repartition(n).mapInArrow(_reader, "doc_id long, start long, n_tokens long, ids_crc32 long")


def token_table(docs: DataFrame, tokenizer: str, end_id: int = 1, **names) -> DataFrame:
    """Writes the corpus as shards and reads every document back from them."""
    return read_tokens(write_tokens(docs, tokenizer, end_id, **names))
