"""SimHash near-duplicates through a byte-position inverted index with count filtering.

A fingerprint has a bit set where over half of the text's shingle hashes have it. Like texts share positional bytes: the
index has postings of documents by what stands at several byte positions, pairs that meet in one are tallied by all the
positional bytes they share, those that reach the guaranteed minimum are verified. Postings are of several positions at once,
since one byte value at one position holds 1/256 of a corpus.

``near_duplicates`` links fingerprints of 64 bits that differ in at most ``most_bits`` (b), exactly. These differ in at most
b of eight bytes, so 8 - b shared ones are the guaranteed minimum. The bytes are split into b + 2 blocks and any two of
them may be the ones left whole: each pair within b bits meets in a posting of two whole blocks. Only distinct
fingerprints are indexed, so copies cost one entry. A posting with more than ``long_posting`` members isn't paired off: its
members are linked through their one-bit neighbours instead (two fingerprints share such a neighbour exactly if they
differ in two bits at most), which needs 65 rows a member and no pair, and gives the same links.

``near_copies`` links texts whose sets of five-word shingles have a Jaccard likeness of ``least`` (0.8). 64 bits can't tell
that (about ten differ), so it has fingerprints of POSITIONS bytes over the distinct two-word shingles, which an edit changes
less: like texts share about 30 of 64 bytes, others one in 256 each. Postings are of three positions, 64 of them chosen so
that no two have two positions in common; they are linked through leaders, then all pairs of different components in
them (``buckets``); a pair goes on with LEAST_SHARED shared bytes and sketches of its shingles that don't rule it out, and the
exact likeness of the texts verifies it. Recall is that of the index, measured in the tests.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import MapType

from markbook.llm import buckets
from markbook.llm.arrowtools import as_bytes, pieces
from markbook.llm.components import components
from markbook.llm.storage import Counted, spread, written

SEED, BYTES = 42, 8
LONG_POSTING = 64
POSITIONS, OFFSETS = 64, (0, 1, 3)
SIZE, LEAST, PRINT_SIZE, LEAST_SHARED = 5, 0.8, 2, 12
_ODD = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB)]


def shingles(text: bytes, size: int) -> list[int]:
    """XXH64 of the word shingles of ``text`` (A-Z folded, words between ASCII white space), repeats included.

    Fewer words are one shingle; a text without words has none.
    """
    words = text.lower().split()
    digest = xxhash.xxh64_intdigest
    if len(words) <= size:
        return [digest(b" ".join(words), SEED)] if words else []
    return [digest(b" ".join(s), SEED) for s in zip(*(words[i:] for i in range(size)))]


def majority(hashes: np.ndarray) -> np.ndarray:
    """Bytes of the fingerprint of unsigned 64-bit ``hashes`` ([hash, word]): a bit is set if in over half of them."""
    ones = np.zeros(64 * hashes.shape[1], np.int64)
    raw = np.ascontiguousarray(hashes).view(np.uint8)
    for i in range(0, len(raw), 255):
        ones += np.unpackbits(raw[i : i + 255], axis=1, bitorder="little").sum(axis=0, dtype=np.uint8)
    return np.packbits(ones * 2 > len(raw), bitorder="little")


def fingerprint(text: bytes, size: int = 3) -> int:
    """Signed 64-bit SimHash of the word shingles of ``text``; zero without words."""
    got = shingles(text, size)
    return int(majority(np.array(got, np.uint64)[:, None]).view("<i8")[0]) if got else 0


def long_fingerprint(text: bytes, size: int = PRINT_SIZE, positions: int = POSITIONS) -> np.ndarray:
    """SimHash of ``positions`` bytes of the distinct word shingles of ``text``, as signed 64-bit numbers."""
    got = np.fromiter(set(shingles(text, size)), np.uint64)
    words = np.arange(positions // 8, dtype=np.uint64)
    with np.errstate(over="ignore"):
        h = (got[:, None] ^ (got[:, None] >> np.uint64(31))) * (_ODD[0] + np.uint64(2) * words)  # of each hash as many as there are words
        h = (h ^ (h >> np.uint64(29))) * _ODD[1]
        h = (h ^ (h >> np.uint64(27))) * _ODD[2]
    return majority(h ^ (h >> np.uint64(32))).view("<i8") if len(got) else np.zeros(positions // 8, "<i8")


def _fingerprinter(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch, 1, 4 << 20):
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([fingerprint(t, size) for t in as_bytes(part.column(1))], pa.int64())], names=["doc_id", "fp"])

    return run


def fingerprints(docs: DataFrame, size: int = 3, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, fp (64 bits as a signed long) of every row; a null text is empty."""
    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(_fingerprinter(size), "doc_id long, fp long")


def _mask(blocks: tuple[tuple[int, ...], ...]) -> int:
    value = sum(0xFF << (8 * b) for block in blocks for b in block)
    return value - (1 << 64) if value >= 1 << 63 else value


def masks(most_bits: int) -> list[int]:
    """One mask for every two of the b + 2 blocks of bytes."""
    n = min(BYTES, most_bits + 2)
    blocks = [tuple(range(BYTES * i // n, BYTES * (i + 1) // n)) for i in range(n)]
    return [_mask(two) for two in combinations(blocks, 2)]


def shared_bytes(a: Column, b: Column) -> Column:
    """Number of byte positions at which two numbers agree."""
    fold = lambda x, n, mask: x.bitwiseOR(F.shiftrightunsigned(x, n)).bitwiseAND(F.lit(mask * 0x0101010101010101))
    return BYTES - F.bit_count(fold(fold(fold(a.bitwiseXOR(b), 4, 15), 2, 3), 1, 1))  # a set bit for each byte that differs


def links(points: DataFrame, most_bits: int = 2, long_posting: int = LONG_POSTING) -> DataFrame:
    """Links (u, v) between distinct fingerprints ``fp`` that connect all pairs within ``most_bits`` (0 to 2)."""
    if not 0 <= most_bits <= 2:
        raise ValueError("most_bits is 0, 1 or 2")
    entry = F.explode(F.array(*(F.struct(F.lit(i).alias("part"), F.col("fp").bitwiseAND(F.lit(m)).alias("bytes")) for i, m in enumerate(masks(most_bits)))))
    index = points.select("fp", entry.alias("e")).select("fp", "e.part", "e.bytes")
    sizes = index.groupBy("part", "bytes").agg(F.count("*").alias("n")).where("n > 1")
    shared = written(index.join(sizes, ["part", "bytes"]), "postings")
    short = shared.where(F.col("n") <= long_posting)
    a, b = short.select("part", "bytes", F.col("fp").alias("u")), short.select("part", "bytes", F.col("fp").alias("v"))
    u, v = F.col("u"), F.col("v")
    tallied = a.join(b, ["part", "bytes"]).where(u > v).select("u", "v", shared_bytes(u, v).alias("shared"))
    met = tallied.where(F.col("shared") >= BYTES - most_bits).where(F.bit_count(u.bitwiseXOR(v)) <= most_bits).select("u", "v")
    dense = shared.where(F.col("n") > long_posting).select("fp").distinct()
    bits = [1 << i for i in range(63)] + [-(1 << 63)]
    near = F.explode(F.array(F.col("fp"), *(F.col("fp").bitwiseXOR(F.lit(x)) for x in bits if most_bits)))
    spread = dense.select("fp", near.alias("near"))
    stars = spread.groupBy("near").agg(F.min("fp").alias("v"), F.count("*").alias("n")).where("n > 1")
    starred = spread.join(stars, "near").where("fp <> v")
    if most_bits == 1:
        starred = starred.where(F.bit_count(F.col("fp").bitwiseXOR(F.col("v"))) <= 1)
    return met.union(starred.select(F.col("fp").alias("u"), "v")).distinct()


def near_duplicates(docs: DataFrame, size: int = 3, most_bits: int = 2, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id (smallest doc_id reachable) of every row.

    Defined cases: a null or empty text has fingerprint zero and links like any other; a text of fewer words than
    a shingle is one shingle; repeated rows each get a row; a null doc_id stays and names a component only if
    that has no other; an empty table gives an empty table; other columns are ignored.
    """
    prints = written(fingerprints(docs, size, doc_id, text), "fingerprints")
    points = prints.groupBy("fp").agg(F.min("doc_id").alias("first"))
    roots = components(links(points.select("fp"), most_bits))
    rooted = points.join(roots, F.col("fp") == F.col("node"), "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    first = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    named = rooted.select("fp", "root").join(first, "root").select("fp", "component_id")
    return prints.join(named, "fp").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def postings(prints: DataFrame) -> DataFrame:
    """id, band of a table (id, fp: array<long>): the bytes at three positions, for every place of the first."""
    at = lambda p: F.shiftright(F.get("fp", F.lit(p // 8)), 8 * (p % 8)).bitwiseAND(F.lit(255))
    three = lambda i: [F.shiftleft(at((i + o) % POSITIONS), 8 * k) for k, o in enumerate(OFFSETS)]
    keys = [F.lit(i << 24) + sum(three(i)[1:], three(i)[0]) for i in range(POSITIONS)]
    return prints.select("id", F.explode(F.array(*keys)).alias("band"))


def alike(a: list[bytes], b: list[bytes], size: int, least: float) -> list[bool]:
    """Whether the sets of word shingles of a[i] and b[i] have a Jaccard likeness of ``least``; two empty ones have."""
    known: dict[bytes, np.ndarray] = {}
    for x in (*a, *b):
        if x not in known:
            known[x] = np.unique(np.array(shingles(x, size), np.uint64))
    out = []
    for x, y in zip(a, b):
        x, y = known[x], known[y]
        both = np.sort(np.concatenate([x, y]))
        k = int((both[1:] == both[:-1]).sum())
        out.append(k >= least * (len(x) + len(y) - k))
    return out


def _verifier(size: int, least: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch, 2, 4 << 20):
                ok = alike(as_bytes(part.column(2)), as_bytes(part.column(3)), size, least)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(ok, pa.bool_())], names=["u", "v", "ok"])

    return run


def _printer(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch, 2, 4 << 20):
                texts = as_bytes(part.column(2))
                fp = [long_fingerprint(t) for t in texts]
                offsets = pa.array(np.arange(len(fp) + 1) * (POSITIONS // 8), pa.int32())
                got = [shingles(t, size) for t in texts]
                hashes, counts = np.fromiter((h for x in got for h in x), np.uint64), np.fromiter(map(len, got), np.int64)
                columns = [part.column(0), part.column(1), pa.ListArray.from_arrays(offsets, pa.array(np.concatenate(fp), pa.int64())), *buckets.sketches(hashes, counts)]
                yield pa.RecordBatch.from_arrays(columns, names=["id", "doc_id", "fp", "n", "bits"])

    return run


def _likely(least: float):
    """Whether two texts of ``prints`` (structs) share enough bytes and their sketches don't rule a likeness of ``least`` out."""

    def condition(a: Column, b: Column, band: Column | None = None) -> Column:
        shared = sum((shared_bytes(F.get(a["fp"], F.lit(i)), F.get(b["fp"], F.lit(i))) for i in range(1, POSITIONS // 8)), shared_bytes(F.get(a["fp"], F.lit(0)), F.get(b["fp"], F.lit(0))))
        return buckets.may_be_alike(a, b, least) & (shared >= LEAST_SHARED)

    return condition


def _judge(rows: DataFrame, prints: DataFrame, size: int, least: float):
    """Judges pairs of texts: by the bytes that their fingerprints share and their sketches, then by their shingles."""
    held: list[DataFrame] = []  # tables of texts (id, text), of different ids

    def run(pairs: Counted, ids: Counted) -> Counted:
        own = F.struct("fp", "n", "bits")
        a, b = (prints.select(F.col("id").alias(x), own.alias(y)) for x, y in (("u", "a"), ("v", "b")))
        tallied = Counted(pairs.df.join(a, "u").join(b, "v").select("u", "v", _likely(least)(F.col("a"), F.col("b")).alias("ok")), "tallied")
        asked = Counted(tallied.df.where("ok").select("u", "v"), "retained")
        if not asked.n:
            return tallied
        wanted = asked.df.select(F.col("u").alias("id")).union(asked.df.select("v")).distinct()
        for known in held:
            wanted = wanted.join(known.select("id"), "id", "left_anti")
        new = Counted(wanted, "wanted")
        if new.n:
            held.append(written(rows.select("id", "text").join(new.side(), "id", "left_semi").groupBy("id").agg(F.first("text").alias("text")), "texts"))
        texts = held[0]
        for known in held[1:]:
            texts = texts.union(known)
        a, b = (texts.select(F.col("id").alias(x), F.col("text").alias(y)) for x, y in (("u", "a"), ("v", "b")))
        met = asked.df.join(a, "u").join(b, "v").select("u", "v", "a", "b").repartition(spread(asked, 500))
        judged = met.mapInArrow(_verifier(size, least), "u long, v long, ok boolean")
        return Counted(tallied.df.where("not ok").union(judged), "pairs")

    return run


def _rows(docs: DataFrame) -> DataFrame:
    """id (64-bit hash of the text), doc_id, text of every row; a null text is empty."""
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.select(F.xxhash64(text).alias("id"), F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"))


def near_copies(docs: DataFrame, size: int = SIZE, least: float = LEAST) -> DataFrame:
    """id, first (smallest doc_id), stays of every distinct text: whether it is the first of its component.

    Texts are known by their 64-bit hash. The first of a component is that of the smallest doc_id, null last, then of the
    smallest hash. An empty table gives an empty table; other columns are ignored.
    """
    rows = _rows(docs)
    prints = rows.mapInArrow(_printer(size), f"id long, doc_id long, fp array<long>, {buckets.SKETCH}")
    prints = written(prints.groupBy("id").agg(F.min("doc_id").alias("first"), *(F.first(c).alias(c) for c in ("fp", "n", "bits"))), "fingerprints")
    facts = prints.select("id", "fp", "n", "bits")
    roots = components(buckets.links(postings(prints), _judge(rows, prints, size, least), 1, _likely(least), lambda: facts))  # with 64 keys a text, one round: leaders differ by posting
    rooted = prints.join(roots, F.col("id") == F.col("node"), "left").select("id", "first", F.coalesce("root", "id").alias("root"))
    place = F.struct(F.col("first").isNull(), "first", "id")
    best = rooted.groupBy("root").agg(F.min(place).alias("best"))
    return rooted.join(best, "root").select("id", "first", (F.col("id") == F.col("best.id")).alias("stays"))


def one_of_each(docs: DataFrame, size: int = SIZE, least: float = LEAST) -> DataFrame:
    """One document of each component of near copies, with all its columns.

    That of the smallest doc_id stays (null last; of several rows of one doc_id and text, one). Documents of one doc_id but
    different texts are different documents, and a null doc_id is one like any other.
    """
    kept = near_copies(docs, size, least).where("stays").select("id", F.coalesce("first", F.lit(0)).alias("at"), F.col("first").isNull().alias("none"))
    text, own = F.coalesce(F.col("text"), F.lit("")), F.col("doc_id").cast("long")
    rows = docs.select(F.struct(*(f"`{c}`" for c in docs.columns)).alias("row"), F.xxhash64(text).alias("id"), F.coalesce(own, F.lit(0)).alias("at"), own.isNull().alias("none"))
    plain = [f"row.`{f.name}`" for f in docs.schema if not isinstance(f.dataType, MapType)]
    order = Window.partitionBy("id", "at", "none").orderBy(F.xxhash64(*plain))
    return rows.join(kept, ["id", "at", "none"], "left_semi").withColumn("n", F.row_number().over(order)).where("n = 1").select("row.*")
