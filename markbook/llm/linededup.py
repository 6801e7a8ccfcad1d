"""Line dedup: fuzzy lines by MinHash, keeping one line of each component.

Lines are known by their 64-bit hash (XXH64, seed 42, as Spark's ``xxhash64``). A line is signed by one-permutation MinHash:
all its character shingles are hashed, the hash range is cut into BINS, and the smallest hash of each bin stays. Bands of
ROWS bins are keys, and lines that share a key are in one bucket.

Lines of one bucket are linked through leaders (``buckets``), verified by the exact Jaccard likeness of their full shingle
sets, where the sketches of these don't rule it out. Linked lines are joined by distributed union-find, and the first line of a component stays: that of the smallest
doc_id, then of the smallest line number there.

A link is missed only if no band is shared (at a likeness of 0.8: three in a thousand); of lines that share one, all pairs of
different components are judged, however large the bucket, each in the first of the buckets that they share. ``deepest`` is
the number of rounds of leaders before that.

Signing, sketching and verifying run over Arrow batches, vectorised; all else is DataFrame expressions.

Defined cases: a null text has no line; blank lines always stay; a line shorter than a shingle is like none but its
copies; rows of one doc_id are one document, and each gets its row; a null doc_id is a document that comes first; an empty
table gives an empty table; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from markbook.llm.arrowtools import pieces
from markbook.llm.buckets import ROUNDS, SKETCH, links, may_be_alike, sketches
from markbook.llm.components import components
from markbook.llm.storage import Counted, spread, unused, written

SIZE, SEED = 8, 42
BINS, ROWS = 24, 3
BANDS = [f"band{i}" for i in range(BINS // ROWS)]
LEAST = 0.8
FIRST = -(1 << 63)
NONE = np.uint64((1 << 64) - 1)
#: Bytes of text that a kernel takes at once: its arrays of 64-bit numbers stay in the processor's cache.
PIECE = 1 << 18
#: Cells of the bitmap of lines in buckets: 16 MB at most.
CELLS = 1 << 27
_ODD = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0xD6E8FEB86659FD93)]


def lines_of(text: Column) -> Column:
    return F.split(text, "\n")


def _lines(docs: DataFrame) -> DataFrame:
    """doc_id, no, line, id of every line that isn't blank."""
    every = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.posexplode(lines_of(F.col("text"))).alias("no", "line"))
    return every.where(r"line rlike '\\S'").withColumn("id", F.xxhash64("line"))


def mixed(x: np.ndarray) -> np.ndarray:
    """64-bit numbers with their bits stirred."""
    x = (x ^ (x >> np.uint64(31))) * _ODD[1]
    x = (x ^ (x >> np.uint64(29))) * _ODD[2]
    return x ^ (x >> np.uint64(32))


def shingle_hashes(lines: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hash of the shingle at every place of every line (repeats included), and the number of them of each line."""
    sizes = np.fromiter(map(len, lines), np.int64, len(lines))
    h = np.frombuffer("".join(lines).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64) + np.uint64(1)
    h = mixed(h * _ODD[0])
    step = 1
    while step < SIZE:  # the hash of 2, 4, 8 characters from those of 1, 2, 4
        h = h[:-step] * _ODD[3] + h[step:] if len(h) > step else h[:0]
        h ^= h >> np.uint64(28)
        step *= 2
    counts = np.maximum(sizes - SIZE + 1, 0)
    ends = np.cumsum(counts)
    starts = np.cumsum(sizes) - sizes
    at = np.arange(int(ends[-1]) if len(ends) else 0, dtype=np.int64) + np.repeat(starts - (ends - counts), counts)
    return mixed(h[at] * _ODD[0]), counts


def band_keys(lines: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """[line, band] keys of all lines, and which of them are there (a band is there if one of its bins has a hash)."""
    h, counts = shingle_hashes(lines)
    slot = ((h >> np.uint64(32)) * np.uint64(BINS) >> np.uint64(32)).astype(np.int64)
    low = np.full(len(lines) * BINS, NONE, np.uint64)
    np.minimum.at(low, np.repeat(np.arange(len(lines)) * BINS, counts) + slot, h)
    low = low.reshape(len(lines), BINS // ROWS, ROWS)
    key = np.broadcast_to(np.arange(1, BINS // ROWS + 1, dtype=np.uint64), low.shape[:2])
    for i in range(ROWS):
        key = mixed((key ^ low[:, :, i]) * _ODD[0])
    return key, (low != NONE).any(axis=2)


def _signer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    digest = xxhash.xxh64_intdigest
    for batch in batches:
        for part in pieces(batch, 1, PIECE):
            docs, lines = [], []
            for d, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                own = [x for x in (text or "").split("\n") if x.strip(" \t\x0b\f\r")]
                docs += [d] * len(own)
                lines += own
            key, there = band_keys(lines)
            ids = np.array([digest(x.encode("utf-8", "surrogatepass"), SEED) for x in lines], np.uint64)
            keys = np.ascontiguousarray(key.T).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(ids.view(np.int64)), pa.array(docs, pa.int64()), *(pa.array(k, mask=~t) for k, t in zip(keys, there.T))], names=["id", "first", *BANDS])


def signed(docs: DataFrame) -> DataFrame:
    """id, first (doc_id), band0, band1, ... (keys; null where a band isn't there) of every line that isn't blank."""
    own = F.coalesce(F.col("doc_id").cast("long"), F.lit(FIRST))
    return docs.select(own.alias("first"), F.col("text").alias("text")).mapInArrow(_signer, ", ".join(f"{x} long" for x in ("id", "first", *BANDS)))


def alike(a: list[str], b: list[str], least: float) -> list[bool]:
    """Whether the shingle sets of a[i] and b[i] have a Jaccard likeness of ``least``."""
    place: dict[str, int] = {}
    for x in (*a, *b):
        place.setdefault(x, len(place))
    h, counts = shingle_hashes(list(place))
    ends = np.cumsum(counts)
    sets = [np.unique(h[e - n : e]) for e, n in zip(ends, counts)]
    out = []
    for x, y in zip(a, b):
        x, y = sets[place[x]], sets[place[y]]
        if min(len(x), len(y)) < least * max(len(x), len(y)) or not len(x):
            out.append(False)
            continue
        both = np.sort(np.concatenate([x, y]))
        k = int((both[1:] == both[:-1]).sum())
        out.append(k >= least * (len(x) + len(y) - k))
    return out


def _verifier(least: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch, 2, PIECE):
                ok = alike(part.column(2).to_pylist(), part.column(3).to_pylist(), least)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(ok, pa.bool_())], names=["u", "v", "ok"])

    return run


def _sketcher(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in pieces(batch, 1, PIECE):
            sizes, bits = sketches(*shingle_hashes(part.column(1).to_pylist()))
            yield pa.RecordBatch.from_arrays([part.column(0), sizes, bits, part.column(2)], names=["id", "n", "bits", "bands"])


def _texts_of(lines: DataFrame, ids: DataFrame) -> DataFrame:
    """id, line, once each, of those of ``lines`` whose id is in ``ids`` (distinct).

    A bitmap of the ids' cells, broadcast, leaves most other lines out before the shuffle, and copies are combined before it.
    """
    cell = F.pmod("id", F.lit(CELLS))
    bitmaps = ids.groupBy(F.bitmap_bucket_number(cell).alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(cell)).alias("bitmap"))
    place = lines.withColumns({"bucket": F.bitmap_bucket_number(cell), "place": F.bitmap_bit_position(cell).cast("int")})
    byte = F.conv(F.hex(F.substring("bitmap", F.shiftright("place", 3) + 1, F.lit(1))), 16, 10).cast("int")
    maybe = place.join(F.broadcast(bitmaps), "bucket").where(F.getbit(byte, F.col("place").bitwiseAND(F.lit(7))) == 1)
    return maybe.groupBy("id").agg(F.first("line").alias("line")).join(ids, "id")  # a semi-join would be moved below the bitmap


class _Judge:
    """Judges pairs of lines: by their sketches, then by their shingles. The lines of buckets are put in a table once."""

    def __init__(self, docs: DataFrame, lines: DataFrame, least: float):
        self.docs, self.lines, self.least = docs, lines, least
        self.texts = self.facts = None

    def likely(self, a: Column, b: Column, band: Column) -> Column:
        return may_be_alike(a, b, self.least) & (F.array_min(F.array_intersect(a["bands"], b["bands"])) == band)

    def __call__(self, pairs: Counted, ids: Counted) -> Counted:
        if self.texts is None:
            self.texts = written(_texts_of(_lines(self.docs).select("id", "line"), ids.df), "texts")
            self.facts = written(self.texts.join(self.lines.select("id", "bands"), "id").mapInArrow(_sketcher, f"id long, {SKETCH}, bands array<long>"), "sketches")
        own = F.struct("n", "bits")
        a, b = (self.facts.select(F.col("id").alias(x), own.alias(y)) for x, y in (("u", "a"), ("v", "b")))
        likely = pairs.df.join(a, "u").join(b, "v").where(may_be_alike(F.col("a"), F.col("b"), self.least))
        asked = Counted(likely.select("u", "v"), "retained")
        a, b = (self.texts.select(F.col("id").alias(x), F.col("line").alias(y)) for x, y in (("u", "a"), ("v", "b")))
        met = asked.df.join(a, "u").join(b, "v").select("u", "v", "a", "b").repartition(spread(asked))
        return Counted(met.mapInArrow(_verifier(self.least), "u long, v long, ok boolean"), "pairs")


def dropped_lines(docs: DataFrame, least: float = LEAST, deepest: int = ROUNDS) -> DataFrame:
    """doc_id, dropped: the sorted numbers (from 0) of the lines that go, for every document with any."""
    every = _lines(docs)
    signs = signed(docs).groupBy("id").agg(F.min("first").alias("first"), F.count("*").alias("n"), *(F.first(x).alias(x) for x in BANDS))  # numbers, so that no rows are sorted
    lines = written(signs.select("id", "first", "n", F.array(*BANDS).alias("bands")), "lines")
    judge = _Judge(docs, lines, least)
    keys = lines.select("id", F.explode("bands").alias("band")).where("band is not null").withColumn("n", F.count("*").over(Window.partitionBy("band")))
    roots = components(links(keys, judge, deepest, judge.likely, lambda: judge.facts))
    tied = roots.select(F.col("node").alias("id"), "root").union(roots.select(F.col("root").alias("id"), "root").distinct())
    known = lines.select("id", "first", "n").join(tied, "id", "left").where("n > 1 or root is not null").select("id", "first", F.coalesce("root", "id").alias("root"))
    kept = known.groupBy("root").agg(F.min("first").alias("home"))
    named = Counted(known.join(kept, "root").select("id", "root", "home"), "classes")
    own = F.coalesce("doc_id", F.lit(FIRST))
    met = every.select("doc_id", "no", "id").join(named.df, "id")
    by_class = met.groupBy("doc_id", "root").agg(F.sort_array(F.collect_set("no")).alias("at"), F.max(F.when(own == F.col("home"), 1).otherwise(0)).alias("here"))
    gone = by_class.select("doc_id", F.expr("slice(at, 1 + here, greatest(size(at) - here, 0))").alias("gone")).where("size(gone) > 0")
    return gone.groupBy("doc_id").agg(F.sort_array(F.flatten(F.collect_list("gone"))).alias("dropped"))


def line_report(docs: DataFrame, **options) -> DataFrame:
    """doc_id, n_lines, n_kept, dropped (numbers, comma-joined) of every row."""
    gone = dropped_lines(docs, **options).withColumnRenamed("doc_id", "of")
    counted = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.size(lines_of(F.col("text"))), F.lit(0)).alias("n"))
    counted = counted.withColumn("n", F.greatest("n", F.lit(0)))
    return counted.join(gone, F.col("doc_id").eqNullSafe(F.col("of")), "left").select(
        "doc_id",
        F.col("n").cast("long").alias("n_lines"),
        (F.col("n") - F.coalesce(F.size("dropped"), F.lit(0))).cast("long").alias("n_kept"),
        F.coalesce(F.array_join("dropped", ","), F.lit("")).alias("dropped"),
    )


def without_dropped(docs: DataFrame, **options) -> DataFrame:
    """The documents with the lines that go taken out of their text; all columns stay."""
    of, at = unused(docs, "of_doc"), unused(docs, "gone_lines")
    gone = written(dropped_lines(docs, **options).select(F.col("doc_id").alias(of), F.col("dropped").alias(at)), "gone")
    kept = F.array_join(F.filter(lines_of(F.col("text")), lambda x, i: ~F.array_contains(at, i)), "\n")
    joined = docs.join(gone, docs["doc_id"].cast("long").eqNullSafe(gone[of]), "left")
    return joined.withColumn("text", F.when(F.col(at).isNull(), F.col("text")).otherwise(kept)).select(*(f"`{c}`" for c in docs.columns))
