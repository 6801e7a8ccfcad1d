"""Language ID by hyperdimensional profiles.

Every letter, folded to lower case, has a random vector of +1 and -1, made from its code point when it is needed, so letters
of all scripts have vectors of their own and no table of them is kept. An n-gram (here a trigram) is the elementwise product
of its letters' vectors, each permuted once for every place it stands from the end; a text is the sum of its trigrams'
vectors; a language's prototype is the sum over its training texts. A text gets the language whose prototype has the
largest cosine with it.

Sums are linear, so a text's vector is (counts of its distinct trigrams) x (vectors of those trigrams), and a
batch of texts is one matrix product. Training sums vectors by language on the executors: whole numbers, so in any order the
same. DIM numbers a language come to the driver, however large the corpus or the alphabet is.

Trigrams are centred on letters; signs that combine with letters (vowel signs, accents) count as neighbours, and every run of
other characters is one boundary.

Defined cases: a text that is null or has no letter gets ``und`` and score 0; so does every text when nothing
was learned; equal cosines go to the alphabetically first language; training rows with a null language or text
teach nothing; an empty table gives an empty table; other columns are ignored.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from markbook.llm.arrowtools import pieces

DIM, N = 512, 3
BITS = 21
MOST_CELLS, SLICE, MOST_CODES = 4_000_000, 16_384, 1 << 23
UNDETERMINED = "und"
_ODD = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB)]
_TABLE: dict[str, np.ndarray] = {}


def _tables() -> dict[str, np.ndarray]:
    if not _TABLE:
        every = [chr(cp) for cp in range(0x110000)]
        letter = np.fromiter(map(str.isalpha, every), bool, len(every))
        fold = np.zeros(len(every), np.int32)
        at = np.flatnonzero(letter)
        fold[at] = [ord(low) if len(low := every[cp].lower()) == 1 else cp for cp in at]
        signs = [cp for cp in range(0x300, len(every)) if not letter[cp] and unicodedata.category(every[cp])[0] == "M"]
        fold[signs] = signs
        _TABLE.update(fold=fold, letter=letter)
    return _TABLE


def classes() -> np.ndarray:
    """class by code point: that of the folded letter or of a combining sign; 0 is a boundary."""
    return _tables()["fold"]


class Letters:
    """``letters[place][class]``: vectors of +1 and -1, permuted ``place`` times; for a class or an array of them."""

    def __init__(self, dim: int = DIM, seed: int = 7):
        self.dim, self.seed = dim, seed
        order, self.orders = np.random.default_rng(seed).permutation(dim), [np.arange(dim)]
        for _ in range(N - 1):
            self.orders.append(self.orders[-1][order])

    def plain(self, of: np.ndarray) -> np.ndarray:
        words = (self.dim + 63) // 64
        x = (of.astype(np.uint64)[:, None] * np.uint64(words) + np.arange(words, dtype=np.uint64) + np.uint64(self.seed << 32)) * _ODD[0]
        x = (x ^ (x >> np.uint64(30))) * _ODD[1]
        x = (x ^ (x >> np.uint64(27))) * _ODD[2]
        x ^= x >> np.uint64(31)
        return np.unpackbits(x.view(np.uint8), axis=1)[:, : self.dim].astype(np.int8) * 2 - 1

    def __getitem__(self, place: int) -> _Place:
        return _Place(self, place)


class _Place:
    def __init__(self, letters: Letters, place: int):
        self.letters, self.order = letters, letters.orders[place]

    def __getitem__(self, of: int | np.ndarray) -> np.ndarray:
        own, number = np.unique(np.asarray(of), return_inverse=True)
        return self.letters.plain(own)[:, self.order][number.reshape(np.shape(of))]


def letter_vectors(dim: int = DIM, seed: int = 7) -> Letters:
    return Letters(dim, seed)


def grams(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Trigram codes of all texts one after another, and the text each belongs to."""
    joined = np.frombuffer("\n".join(t or "" for t in texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    sizes = np.fromiter((len(t or "") + 1 for t in texts), np.int64, len(texts))
    owner = np.repeat(np.arange(len(texts), dtype=np.int32), sizes)[: len(joined)]
    c = classes()[joined]
    keep = np.ones(len(c), bool)
    keep[1:] = (c[1:] != 0) | (c[:-1] != 0) | (owner[1:] != owner[:-1])
    c, owner, letters = c[keep].astype(np.int64), owner[keep], _tables()["letter"][joined[keep]]
    # a boundary before and after each text: the separator's class is 0, and trigrams across two texts are dropped
    before = np.zeros_like(c)
    before[1:] = np.where(owner[1:] == owner[:-1], c[:-1], 0)
    after = np.zeros_like(c)
    after[:-1] = np.where(owner[1:] == owner[:-1], c[1:], 0)
    return ((before << 2 * BITS) | (c << BITS) | after)[letters], owner[letters]


def parts_of(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The three classes of trigrams."""
    low = (1 << BITS) - 1
    return codes >> 2 * BITS, codes >> BITS & low, codes & low


def distinct(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct codes, in order, and the number of each code among them."""
    parts = parts_of(codes)
    there = np.zeros(0x110000, bool)
    for p in parts:
        there[p] = True
    own = np.flatnonzero(there)
    k = len(own)
    if k**3 > MOST_CODES:
        return np.unique(codes, return_inverse=True)
    small = np.zeros(0x110000, np.int32)
    small[own] = np.arange(k, dtype=np.int32)
    dense = (small[parts[0]] * k + small[parts[1]]) * k + small[parts[2]]
    met = np.zeros(k**3, bool)
    met[dense] = True
    present = np.flatnonzero(met)
    number = np.empty(k**3, np.int32)
    number[present] = np.arange(len(present), dtype=np.int32)
    return (own[present // (k * k)] << 2 * BITS) | (own[present // k % k] << BITS) | own[present % k], number[dense]


def gram_vectors(codes: np.ndarray, letters: Letters) -> np.ndarray:
    a, b, c = parts_of(codes)
    return letters[2][a] * letters[1][b] * letters[0][c]


@dataclass(frozen=True)
class Model:
    """Unit prototypes by language, in alphabetical order."""

    langs: tuple[str, ...]
    prototypes: np.ndarray
    letters: Letters

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        n = len(texts)
        names, scores = [UNDETERMINED] * n, np.zeros(n)
        codes, owner = grams(texts)
        if not len(codes) or not self.langs:
            return names, scores
        vectors = self.vectors(codes, owner, n)
        norm = np.linalg.norm(vectors, axis=1)
        cosine = (vectors @ self.prototypes.T) / np.where(norm > 0, norm, 1)[:, None]
        best = cosine.argmax(axis=1)
        for i in np.unique(owner):
            names[i], scores[i] = self.langs[best[i]], min(1.0, max(0.0, float(cosine[i, best[i]])))
        return names, scores

    def vectors(self, codes: np.ndarray, owner: np.ndarray, n: int) -> np.ndarray:
        """The vectors of ``n`` texts: (counts of distinct trigrams) x (their vectors), over runs of texts and slices of
        trigrams, so that no table has more than MOST_CELLS cells."""
        present, number = distinct(codes)
        out = np.zeros((n, self.letters.dim), np.float32)
        if n > 1 and n * len(present) > MOST_CELLS:
            half = n // 2
            cut = int(np.searchsorted(owner, half))
            out[:half] = self.vectors(codes[:cut], owner[:cut], half)
            out[half:] = self.vectors(codes[cut:], owner[cut:] - half, n - half)
            return out
        counts = np.bincount(owner.astype(np.int64) * len(present) + number, minlength=n * len(present)).reshape(n, -1)
        for i in range(0, len(present), SLICE):
            out += counts[:, i : i + SLICE].astype(np.float32) @ gram_vectors(present[i : i + SLICE], self.letters).astype(np.float32)
        return out


def _summer(letters: Letters):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[str, np.ndarray] = {}
        for batch in batches:
            for part in pieces(batch, 1, 2 << 20):
                by: dict[str, list[str]] = {}
                for lang, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                    by.setdefault(lang, []).append(text)
                for lang, texts in by.items():
                    codes = grams(texts)[0]
                    if len(codes):
                        total[lang] = total.get(lang, 0) + summed(codes, letters)
        names = list(total)
        yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array([total[x].tolist() for x in names], pa.list_(pa.int64()))], names=["lang", "v"])

    return run


def summed(codes: np.ndarray, letters: Letters) -> np.ndarray:
    """The sum of the trigrams' vectors, in whole numbers."""
    present, number = distinct(codes)
    n, out = np.bincount(number, minlength=len(present)).astype(np.float64), np.zeros(letters.dim)
    for i in range(0, len(present), SLICE):
        out += n[i : i + SLICE] @ gram_vectors(present[i : i + SLICE], letters).astype(np.float64)
    return out.astype(np.int64)


def train(rows: DataFrame, text: str = "text", lang: str = "lang", dim: int = DIM, seed: int = 7) -> Model:
    """Learns from every row with a language and a text."""
    labelled = rows.select(F.col(lang).cast("string").alias("lang"), F.col(text).alias("text")).where("lang is not null and text is not null")
    letters = letter_vectors(dim, seed)
    sums = labelled.mapInArrow(_summer(letters), "lang string, v array<long>").select("lang", F.posexplode("v").alias("i", "x")).groupBy("lang", "i").agg(F.sum("x").alias("x"))
    got = sums.toArrow().to_pydict()  # dim numbers a language
    langs = tuple(sorted(set(got["lang"])))
    prototypes = np.zeros((len(langs), dim))
    for x, i, v in zip(got["lang"], got["i"], got["x"]):
        prototypes[langs.index(x), i] = v
    norm = np.linalg.norm(prototypes, axis=1, keepdims=True)
    return Model(langs, (prototypes / np.where(norm > 0, norm, 1)).astype(np.float32), letters)


def _predictor(model: Model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch, batch.num_columns - 1, 1 << 19):
                names, scores = model.predict(part.column(part.num_columns - 1).to_pylist())
                yield pa.RecordBatch.from_arrays(
                    [*part.columns[:-1], pa.array(names, pa.string()), pa.array(scores, pa.float64())], names=[*part.schema.names[:-1], "lang_pred", "score"]
                )

    return run


def predict(rows: DataFrame, model: Model, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Columns ``keep`` with lang_pred and score of every row."""
    picked = rows.select(*keep, F.col(text).cast("string").alias("__text"))
    return picked.mapInArrow(_predictor(model), StructType([*picked.schema[:-1], StructField("lang_pred", StringType()), StructField("score", DoubleType())]))


def fold(doc_id: Column, parts: int) -> Column:
    """Fold of a document: crc32 of its id as text."""
    return F.crc32(doc_id.cast("string").cast("binary")) % parts


def identify(docs: DataFrame, parts: int = 3, held: int = 1) -> DataFrame:
    """doc_id, held_out, lang_pred, score; documents of fold ``held`` (and those without an id) teach nothing."""
    docs = docs.select(F.col("doc_id").alias("doc_id"), "text", "lang").withColumn("held_out", fold(F.col("doc_id"), parts) == held)
    model = train(docs.where("not held_out"))
    return predict(docs, model, keep=("doc_id", "held_out"))


def accepted(docs: DataFrame, least: float = 0.1, few: int = 20) -> DataFrame:
    """The documents that read as some learned language: their score is ``least`` or more. All columns stay.

    A text under ``few`` characters tells too little to be refused for its score; it goes only if it has no letter.
    """
    model = train(docs)
    rows = docs.select(F.struct(*(f"`{c}`" for c in docs.columns)).alias("row"), "text")
    short = (F.col("lang_pred") != UNDETERMINED) & (F.length("row.text") < few)
    return predict(rows, model, keep=("row",)).where((F.col("score") >= least) | short).select("row.*")
