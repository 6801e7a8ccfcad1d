"""LM scoring by prediction by partial matching (PPM) over bytes, beside an additive unigram base.

The byte-context trie is a table of grams: a context of up to ORDER bytes and the byte after it, with counts.
Escape is estimated by method D (a context with n counts of q distinct bytes escapes with q / 2n, and a byte
counted c times has (c - 1/2) / n) and the
bytes of a longer context are excluded in the shorter ones. All bytes seen after a context are seen after its
suffixes too, so the excluded set is always that of the next longer context, and every step of a code length is
a ratio of sums kept with the context: no trie is walked, a text's score is a few table look-ups a byte.

Training counts grams and words of all training texts on the executors and sums them by shuffle. No count is dropped:
the trie is a written table of every context with its next bytes. Only what is broadcast is bounded: the longest grams
with ``least_share`` of the training bytes or more, at most 1 / least_share of them, with their final code lengths. All
other grams of a text are joined with the trie by shuffle: one seen in training has its code length there, the
distinct unseen ones go down the contexts, one join an order. Where every gram is broadcast (a small corpus), the whole
trie is, and no join is needed. Words get the same treatment for the base score: those with ``least_share`` of the
tokens or more are broadcast, and the tokens of all others are joined with the exact counts by shuffle.

The model codes the words of a text, A-Z folded, joined by one space and ended by a line feed.

Defined cases: null text is empty (one end token); without training texts the base is uniform over one unseen
token and every byte costs log10 of 1/256; repeated rows each get a row; a null doc_id trains nothing and is not
held out; an empty table gives an empty table; other columns are ignored.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from markbook.llm.arrowtools import as_bytes, pieces
from markbook.llm.storage import written

ORDER = 5
LEAST_SHARE = 5e-7
ALPHA = 0.1
END = b"\n"
_GOLD = 0x9E3779B97F4A7C15


def grams(data: np.ndarray, order: int = ORDER) -> np.ndarray:
    """For every byte of ``data`` after the first ``order``: that many bytes of context and the byte, in one integer."""
    n = len(data) - order
    code = np.zeros(max(0, n), np.uint64)
    for i in range(order + 1):
        code = (code << np.uint64(8)) | data[i : i + n]
    return code


def coded(words: list[bytes]) -> bytes:
    return b" ".join(words) + END


def stream(texts: list[list[bytes]], order: int = ORDER) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts, each after ``order`` ends as its first context, and the number of bytes of each."""
    parts = [coded(w) for w in texts]
    sizes = np.array([len(p) for p in parts], np.int64)
    return np.frombuffer(b"".join(END * order + p for p in parts), np.uint8), sizes


def text_grams(texts: list[list[bytes]], order: int = ORDER) -> tuple[np.ndarray, np.ndarray]:
    """Grams of all texts, and the end of each text's run."""
    data, sizes = stream(texts, order)
    ends = np.cumsum(sizes)
    code = grams(data, order)
    keep = np.ones(len(code), bool)
    at = ends[:-1] + np.arange(len(sizes) - 1) * order  # first gram that spans into the next text
    for i in range(order):
        keep[at + i] = False
    return code[keep], ends


class Table:
    """Open-addressing hash table from unsigned 64-bit keys to their index."""

    def __init__(self, keys: np.ndarray):
        self.bits = max(4, int(2 * max(1, len(keys)) - 1).bit_length())
        self.slot = np.full(1 << self.bits, -1, np.int32)
        self.keys = np.ascontiguousarray(keys, np.uint64)
        left, at = np.arange(len(keys), dtype=np.int32), self._at(self.keys)
        while len(left):
            free = self.slot[at] < 0
            self.slot[at[free]] = left[free]  # of several, one stays
            lost = self.slot[at] != left
            left, at = left[lost], (at[lost] + 1) & ((1 << self.bits) - 1)
        self.slot_keys = np.zeros(len(self.slot), np.uint64)
        if len(keys):
            self.slot_keys = self.keys[self.slot]

    def _at(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * np.uint64(_GOLD)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Index of each key, -1 where it isn't there."""
        at = self._at(keys)
        out = self.slot[at]
        wrong = np.flatnonzero((out >= 0) & (self.slot_keys[at] != keys))
        while len(wrong):
            at[wrong] = (at[wrong] + 1) & ((1 << self.bits) - 1)
            out[wrong] = self.slot[at[wrong]]
            wrong = wrong[(out[wrong] >= 0) & (self.slot_keys[at[wrong]] != keys[wrong])]
        return out


@dataclass
class Level:
    """Grams and contexts of one order, sorted; logs in base 10."""

    gram: np.ndarray
    count: np.ndarray  # log of (the gram's count - 1/2)
    context: np.ndarray
    total: np.ndarray  # log n
    escape: np.ndarray  # log(q / 2)
    below: np.ndarray  # log of what is left of the next shorter context's n, without this context's bytes
    escape_below: np.ndarray  # log of half of what is left of its q; -inf: none


class Model:
    """Tables of all orders, from the grams of each: [(codes, counts)] by order 0, 1, ..."""

    def __init__(self, orders: list[tuple[np.ndarray, np.ndarray]]):
        self.levels: list[Level] = []
        with np.errstate(divide="ignore"):
            before = None
            for k, (code, n) in enumerate(orders):
                by = np.argsort(code)
                code, n = code[by].astype(np.uint64), n[by].astype(np.float64)
                context, first = np.unique(code >> np.uint64(8), return_index=True)
                n_all = np.add.reduceat(n, first) if len(first) else np.zeros(0)
                q = np.diff(np.append(first, len(code))).astype(float)
                below = escape_below = np.zeros(len(context))
                if k and len(context):
                    short = np.searchsorted(before[2], context & np.uint64((1 << (8 * (k - 1))) - 1) if k > 1 else np.zeros(len(context), np.uint64))
                    same = np.searchsorted(before[0], code & np.uint64((1 << (8 * k)) - 1))
                    gone = np.add.reduceat(before[1][same], first)
                    left_n, left_q = before[3][short] - gone, before[4][short] - q
                    below, escape_below = np.log10(left_n), np.log10(left_q / 2)
                self.levels.append(Level(code, np.log10(n - 0.5).astype(np.float32), context, np.log10(n_all), np.log10(q / 2), below, escape_below))
                before = (code, n, context, n_all, q)
        self.tables: list[tuple[Table, Table]] | None = None
        top = self.levels[-1]
        owner = np.searchsorted(top.context, top.gram >> np.uint64(8))
        self.direct = (top.count - top.total[owner]).astype(np.float32) if len(top.gram) else np.zeros(0, np.float32)

    def ready(self) -> Model:
        if self.tables is None:
            self.tables = [(Table(x.gram), Table(x.context)) for x in self.levels]
        return self

    def logs(self, code: np.ndarray) -> np.ndarray:
        """log10 of the probability of the last byte of every gram (contexts of the model's order)."""
        self.ready()
        order = len(self.levels) - 1
        hit = self.tables[order][0].find(code)
        out = np.where(hit >= 0, self.direct[hit] if len(self.direct) else 0.0, 0.0).astype(np.float64)
        todo = np.flatnonzero(hit < 0)
        left, den, esc = code[todo], np.zeros(len(todo)), np.zeros(len(todo))  # of the level at hand, as the longer context leaves it
        under = np.zeros(len(todo), bool)
        for k in range(order, -1, -1):
            if not len(todo):
                return out
            level, (by_gram, by_context) = self.levels[k], self.tables[k]
            here = left & np.uint64((1 << (8 * (k + 1))) - 1)
            at = by_context.find(here >> np.uint64(8))
            known = at >= 0
            d = np.where(under, den, level.total[at] if len(level.total) else 0.0)
            e = np.where(under, esc, level.escape[at] if len(level.escape) else 0.0)
            g = by_gram.find(here)
            done = known & (g >= 0)
            out[todo[done]] += level.count[g[done]] - d[done]
            some = known & ~done & np.isfinite(d)  # else nothing is left to escape from, at no cost
            out[todo[some]] += e[some] - d[some]
            stay = ~done
            if k and len(level.below):
                den, esc = level.below[at][stay], level.escape_below[at][stay]
            else:
                den, esc = den[stay], esc[stay]
            under = known[stay]
            todo, left = todo[stay], left[stay]
        seen = len(self.levels[0].gram)
        out[todo] -= math.log10(max(1, 256 - seen))
        return out

    def score(self, texts: list[list[bytes]]) -> np.ndarray:
        """log10 probability of each text, given as its words."""
        code, ends = text_grams(texts, len(self.levels) - 1)
        return np.add.reduceat(self.logs(code), np.concatenate([[0], ends[:-1]]))


class Frequent:
    """Code lengths (log10) of the longest grams that are broadcast."""

    def __init__(self, gram: np.ndarray, log: np.ndarray, order: int):
        self.gram, self.log, self.order = gram.astype(np.uint64), log.astype(np.float64), order
        self.table: Table | None = None

    def score(self, texts: list[list[bytes]]) -> tuple[np.ndarray, pa.Array]:
        """log10 probability of what is known of each text, and its other grams with their counts."""
        self.table = self.table or Table(self.gram)
        code, ends = text_grams(texts, self.order)
        starts = np.concatenate([[0], ends[:-1]])
        hit = self.table.find(code)
        logs = np.where(hit >= 0, self.log[hit] if len(self.log) else 0.0, 0.0)
        miss = np.flatnonzero(hit < 0)
        owner, code = np.searchsorted(ends, miss, side="right"), code[miss]
        by = np.lexsort((code, owner))
        owner, code = owner[by], code[by]
        first = np.flatnonzero(np.append(True, (owner[1:] != owner[:-1]) | (code[1:] != code[:-1]))[: len(code)])
        tf = np.diff(np.append(first, len(code)))
        offsets = np.searchsorted(owner[first], np.arange(len(texts) + 1)).astype(np.int32)
        pairs = pa.StructArray.from_arrays([pa.array(code[first].astype(np.int64)), pa.array(tf.astype(np.int64))], ["gram", "tf"])
        return np.add.reduceat(logs, starts), pa.ListArray.from_arrays(pa.array(offsets), pairs)


def _count(order: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words: Counter = Counter()
        held: list[np.ndarray] = []

        def flush():
            codes, n = np.unique(np.concatenate([c for c, _ in held]), return_inverse=True) if held else (np.zeros(0, np.uint64), np.zeros(0, np.int64))
            n = np.bincount(n, np.concatenate([m for _, m in held]), minlength=len(codes)) if held else n
            yield pa.RecordBatch.from_pydict({"word": pa.nulls(len(codes), pa.binary()), "gram": pa.array(codes.astype(np.int64), pa.int64()), "n": pa.array(n.astype(np.int64), pa.int64())})
            yield pa.RecordBatch.from_pydict({"word": pa.array(list(words), pa.binary()), "gram": pa.nulls(len(words), pa.int64()), "n": pa.array(list(words.values()), pa.int64())})
            held.clear()
            words.clear()

        for batch in batches:
            for part in pieces(batch, 0, 2 << 20):
                texts = [t.lower().split() for t in as_bytes(part.column(0))]
                for t in texts:
                    words.update(t)
                words[b""] += len(texts)  # the end token
                held.append(np.unique(text_grams(texts, order)[0], return_counts=True))
                if len(words) > 300_000 or sum(len(c) for c, _ in held) > 4_000_000:
                    yield from flush()
        yield from flush()

    return run


@dataclass
class Learned:
    """What training leaves: the trie, and of the words the exact counts (a table) and the frequent ones."""

    model: Model | Frequent  # a model of the whole trie, or the frequent grams
    trie: list[DataFrame]  # by order: context, next (array of byte, n), total; empty with a model of the whole
    rare: DataFrame | None  # gram, log of the longest grams that aren't broadcast
    words: DataFrame
    frequent: dict[bytes, int]
    tokens: int
    distinct: int


def _shorter(level: DataFrame, k: int) -> DataFrame:
    """Grams of order k - 1 from those of order k."""
    return level.groupBy(F.col("gram").bitwiseAND(F.lit((1 << (8 * k)) - 1)).alias("gram")).agg(F.sum("n").alias("n"))


def _contexts(level: DataFrame) -> DataFrame:
    follower = F.struct(F.col("gram").bitwiseAND(F.lit(255)).cast("int").alias("byte"), "n")
    return level.groupBy(F.shiftright("gram", 8).alias("context")).agg(F.collect_list(follower).alias("next"), F.sum("n").alias("total"))


def train(rows: DataFrame, order: int = ORDER, least_share: float = LEAST_SHARE) -> Learned:
    """Learns from every row of ``rows`` (text)."""
    counted = written(rows.select("text").mapInArrow(_count(order), "word binary, gram long, n long"), "counts")
    words = written(counted.where("word is not null").groupBy("word").agg(F.sum("n").alias("n")), "words")
    tokens, distinct = words.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    frequent = words.where(F.col("n") >= max(1, math.ceil(tokens * least_share))).toArrow()
    level = written(counted.where("gram is not null").groupBy("gram").agg(F.sum("n").alias("n")), "grams")
    n_bytes = level.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    least = max(1, math.ceil(n_bytes * least_share))
    trie, rare = [], None
    if least == 1:  # at most 1 / least_share grams
        orders = []
        for k in range(order, -1, -1):
            kept = level.toArrow()
            orders.append((kept.column("gram").to_numpy().astype(np.uint64), kept.column("n").to_numpy()))
            level = _shorter(level, k)
        model = Model(orders[::-1])
    else:
        for k in range(order, -1, -1):
            trie.append(written(_contexts(level), f"contexts-{k}"))
            if k:
                level = written(_shorter(level, k), f"grams-{k - 1}")
        trie.reverse()
        each = trie[order].select("context", "total", F.explode("next").alias("x"))
        longest = each.select(F.shiftleft("context", 8).bitwiseOR(F.col("x.byte").cast("long")).alias("gram"), F.col("x.n").alias("n"), F.log10((F.col("x.n") - 0.5) / F.col("total")).alias("log"))
        known = longest.where(F.col("n") >= least).select("gram", "log").toArrow()  # at most 1 / least_share rows
        model = Frequent(known.column("gram").to_numpy(), known.column("log").to_numpy(), order)
        rare = longest.where(F.col("n") < least).select("gram", "log")
    return Learned(model, trie, rare, words, dict(zip(frequent.column("word").to_pylist(), frequent.column("n").to_pylist())), tokens, distinct)


def escaped(grams: DataFrame, trie: list[DataFrame]) -> DataFrame:
    """gram, log (base 10) of the last byte's probability, of a table of distinct grams that training didn't see."""
    now = grams.select("gram", F.lit(0.0).alias("log"), F.array().cast("array<int>").alias("gone"), F.lit(False).alias("done"))
    out = None
    byte = F.col("gram").bitwiseAND(F.lit(255)).cast("int")
    for k in range(len(trie) - 1, -1, -1):
        context = F.shiftright("gram", 8).bitwiseAND(F.lit((1 << (8 * k)) - 1))
        side = F.broadcast(trie[k]) if k <= 2 else trie[k]  # at most 65,536 contexts of two bytes
        met = now.withColumn("context", context).join(side, "context", "left")
        left = F.coalesce(F.filter("next", lambda x: ~F.array_contains("gone", x["byte"])), F.array().cast("array<struct<byte:int,n:bigint>>"))
        met = met.withColumn("left", left).withColumn("n", F.aggregate("left", F.lit(0).cast("long"), lambda a, x: a + x["n"]))
        met = met.withColumn("own", F.get(F.filter("left", lambda x: x["byte"] == byte), F.lit(0))["n"])
        step = F.when(F.col("own").isNotNull(), F.log10((F.col("own") - 0.5) / F.col("n"))).when(F.size("left") > 0, F.log10(F.size("left") / 2 / F.col("n"))).otherwise(0.0)
        gone = F.coalesce(F.transform("next", lambda x: x["byte"]), "gone")  # the next bytes of a longer context are among them
        now = written(met.select("gram", (F.col("log") + step).alias("log"), gone.alias("gone"), F.col("own").isNotNull().alias("done")), "escaped")
        done = now.where("done").select("gram", "log")
        out = done if out is None else out.union(done)
        now = now.where("not done")
    return out.union(now.select("gram", F.col("log") - F.log10(256 - F.size("gone"))))


SCORED = "doc_id long, held_out boolean, n_tokens long, known long, base double, score double, rare array<struct<word: binary, tf: long>>, unmet array<struct<gram: long, tf: long>>"


def _scorer(shared, tokens: int, distinct: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, frequent = shared.value
        whole = math.log10(tokens + ALPHA * (distinct + 1))
        logs = {w: math.log10(n + ALPHA) for w, n in frequent.items()}
        kind = pa.list_(pa.struct([("word", pa.binary()), ("tf", pa.int64())]))
        other = pa.list_(pa.struct([("gram", pa.int64()), ("tf", pa.int64())]))
        for batch in batches:
            for part in pieces(batch, 2, 1 << 20):
                texts = [t.lower().split() for t in as_bytes(part.column(2))]
                base, known, rare = [], [], []
                for t in texts:
                    tf = Counter(t)
                    tf[b""] += 1
                    got = [(logs.get(w), n, w) for w, n in tf.items()]
                    base.append(sum(x * n for x, n, _ in got if x is not None) - whole * (len(t) + 1))
                    known.append(sum(n for x, n, _ in got if x is not None))
                    rare.append([{"word": w, "tf": n} for x, n, w in got if x is None])
                score, unmet = (model.score(texts), pa.array([[]] * len(texts), other)) if isinstance(model, Model) else model.score(texts)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), pa.array([len(t) + 1 for t in texts], pa.int64()), pa.array(known, pa.int64()), pa.array(base, pa.float64()), pa.array(score, pa.float64()), pa.array(rare, kind), unmet],
                    names=["doc_id", "held_out", "n_tokens", "known", "base", "score", "rare", "unmet"],
                )

    return run


def _unmet(scored: DataFrame, got: Learned) -> DataFrame:
    """row, rest: the log10 probability of the grams that weren't broadcast."""
    unmet = scored.select("row", (F.col("held_out") | F.col("doc_id").isNull()).alias("apart"), F.explode("unmet").alias("u")).select("row", "apart", "u.gram", "u.tf")
    own = unmet.where("not apart").join(got.rare, "gram").select("row", "tf", "log")  # training texts: all of them are in the trie
    met = written(unmet.where("apart").join(got.rare, "gram", "left").select("row", "gram", "tf", "log"), "met")
    new = met.where("log is null").select("row", "gram", "tf")
    late = new.join(escaped(new.select("gram").distinct(), got.trie), "gram").select("row", "tf", "log")
    every = own.union(met.where("log is not null").select("row", "tf", "log")).union(late)
    return every.groupBy("row").agg(F.sum(F.col("tf") * F.col("log")).alias("rest"))


def score(docs: DataFrame, parts: int = 10, held: int = 0, order: int = ORDER, least_share: float = LEAST_SHARE) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every row; fold ``held`` isn't learned from."""
    spark = docs.sparkSession
    fold = F.crc32(F.col("doc_id").cast("string").cast("binary")) % parts
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(fold == held, F.lit(False)).alias("held_out"), F.col("text").alias("text"))
    got = train(rows.where("doc_id is not null and not held_out"), order, least_share)
    shared = spark.sparkContext.broadcast((got.model, got.frequent))
    scored = written(rows.mapInArrow(_scorer(shared, got.tokens, got.distinct), SCORED).withColumn("row", F.monotonically_increasing_id()), "scored")
    tail = scored.select("row", F.explode("rare").alias("r")).select("row", "r.word", "r.tf")
    seen = tail.join(got.words.where(F.col("n") < max(1, math.ceil(got.tokens * least_share))), "word", "left")
    log = F.log10(F.coalesce("n", F.lit(0)) + ALPHA)
    late = seen.groupBy("row").agg(F.sum(F.col("tf") * log).alias("more"), F.sum(F.when(F.col("n").isNotNull(), F.col("tf")).otherwise(0)).alias("also"))
    full = F.col("score")
    out = scored.drop("rare", "unmet").join(late, "row", "left")
    if got.rare is not None:
        out, full = out.join(_unmet(scored, got), "row", "left"), full + F.coalesce("rest", F.lit(0.0))
    return out.select(
        "doc_id",
        "held_out",
        "n_tokens",
        (F.col("known") + F.coalesce("also", F.lit(0))).alias("n_known"),
        F.lit(got.tokens).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce("more", F.lit(0.0))).alias("base_score"),
        full.alias("score"),
    )
