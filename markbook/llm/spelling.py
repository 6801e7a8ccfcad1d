"""Spelling variants: words one edit apart, by a positional q-gram inverted index with a count filter.

Words are counted over all documents with DataFrame expressions. A word of L code points has L + Q - 1 padded Q-grams, each
with its place. One replaced code point takes Q grams of a word, one inserted or deleted takes Q of the longer word
and Q - 1 of the shorter, and moves the rest by at most one place; so two near words share all but Q grams of the longer.

Two near words therefore share one of the Q + 1 rarest grams of each (Q of a shorter word). Rarity is a gram's number among all
words, added up in COUNTS cells of a hash: any order gives the same pairs, as long as it is one order. The index has
postings by (length, gram, place) of these grams only, once for words of one length and once for a word against those one
code point longer; places and lengths out of reach never meet.

A posting is sorted into one task in a stream. Where it has up to PAIRED words, their shared grams are tallied place by
place in arrays; where it has more, the postings of all grams of its words are merged through a heap: the shortest lists
of a word are merged, as many as a near word can't miss, and the long ones are looked up. What reaches the bound is
verified. A posting of more than MOST words is split by the next rarest gram, again and again: near words share one of Q + 1
there as well. It ends where words share all grams that near words must share, and such words are few.

The form of a word is its near word with the largest count, if that is ``ratio`` times its own; forms lead to a root.

Defined cases: a null or empty text has no word; a null doc_id is an empty text in the hash; repeated rows count each; of near
words with equal counts the first in code-point order is the form; an empty table gives an empty table; other columns are
ignored. A word of any length is one row: its grams are arrays, not rows.
"""

from __future__ import annotations

import heapq
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from markbook.llm.linededup import mixed
from markbook.llm.storage import Counted, written

Q = 4
COUNTS = 1 << 18
PAIRED, MOST = 64, 512
WIDE = 64
SLICE = 200_000
#: A posting's row: words of one length; a word and those one longer.
SAME, SHORT, LONG = 0, 1, 2
ROW = "key long, side int, rank int, word string, n long"
PAIR = "a string, n_a long, b string, n_b long"
_ODD = np.uint64(0x9E3779B97F4A7C15)
# The letters of a run, and how often an occurrence loses a letter.
RUN = "[A-Za-z\\u00C0-\\u00FF]"
CAPITALS, SMALL = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
LOSES = 31


def words(docs: DataFrame, least_length: int = 7, least_n: int = 2, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """word, n of every word with ``least_length`` code points and ``least_n`` occurrences."""
    own = F.coalesce(F.col(doc_id).cast("string"), F.lit(""))
    runs = docs.select(own.alias("own"), F.explode(F.regexp_extract_all(F.col(text), F.lit(f"{RUN}{{{least_length},}}"), F.lit(0))).alias("run"))
    folded = F.when(F.col("run").rlike("[A-Z]"), F.translate("run", CAPITALS, SMALL)).otherwise(F.col("run"))
    hashed = runs.select(folded.alias("run"), F.crc32(F.concat("own", F.lit(":"), folded).cast("binary")).alias("h"))
    at = (F.col("h") % F.length("run")).cast("int")
    lost = F.concat(F.substring(F.col("run"), F.lit(1), at), F.substring(F.col("run"), at + 2, F.length("run")))
    seen = hashed.select(F.when(F.col("h") % LOSES == 0, lost).otherwise(F.col("run")).alias("word")).where(F.length("word") >= least_length)
    return seen.groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= least_n)


def letters(of: list[str], length: int) -> np.ndarray:
    """[word, place] code points of words of one length."""
    return np.array(of, f"U{length}").view(np.uint32).reshape(len(of), length)


def gram_hashes(codes: np.ndarray) -> np.ndarray:
    """[word, place] hashes of the padded grams."""
    n, length = codes.shape
    padded = np.zeros((n, length + 2 * Q - 2), np.uint64)
    padded[:, Q - 1 : Q - 1 + length] = codes
    out = np.zeros((n, length + Q - 1), np.uint64)
    for i in range(Q):
        out = out * _ODD + padded[:, i : i + length + Q - 1] + np.uint64(1)
    return mixed(out)


def cell(hashes: np.ndarray) -> np.ndarray:
    return (hashes % np.uint64(COUNTS)).astype(np.int64)


def by_length(of: list[str]) -> Iterator[tuple[int, np.ndarray]]:
    """Lengths, and the places in ``of`` of the words that have each."""
    lengths = np.fromiter(map(len, of), np.int64, len(of))
    for length in np.unique(lengths):
        at = np.flatnonzero(lengths == length)
        step = max(1, 4_000_000 // (int(length) + Q))
        for i in range(0, len(at), step):
            yield int(length), at[i : i + step]


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros(COUNTS, np.int64)
    for batch in batches:
        of = batch.column(0).to_pylist()
        for length, at in by_length(of):
            total += np.bincount(cell(gram_hashes(letters([of[i] for i in at], length))).ravel(), minlength=COUNTS)
    there = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(there, pa.int64()), pa.array(total[there])], names=["cell", "n"])


def gram_counts(table: DataFrame) -> np.ndarray:
    """Number of grams of ``table`` (word) in each of COUNTS cells."""
    got = table.select("word").mapInArrow(_count, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(COUNTS, np.int64)
    out[got.column("cell").to_numpy()] = got.column("n").to_numpy()
    return out


def _next_keys(counts, depth: int):
    """Rows of postings by one gram more: of rank ``rank`` + 1 up to what near words can't miss at this depth."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            side, rank = batch.column(1).to_numpy(), batch.column(2).to_numpy()
            of, key = batch.column(3).to_pylist(), batch.column(0).to_numpy().view(np.uint64)
            new, rows, ranks = [], [], []
            for length, at in by_length(of):
                h = gram_hashes(letters([of[i] for i in at], length))
                order = np.lexsort((np.broadcast_to(np.arange(h.shape[1]), h.shape), h, counts.value[cell(h)]), axis=1)
                most = min(h.shape[1], Q + depth)
                place = order[:, :most]
                grams = np.take_along_axis(h, place, 1)
                for i in range(most):
                    for kind in (SAME, SHORT, LONG):
                        some = np.flatnonzero((side[at] == kind) & (rank[at] < i))
                        if not len(some) or i >= Q + depth - (kind == SHORT):
                            continue
                        for shift in (0, 1) if kind == SHORT else (0,):
                            new.append(mixed((key[at[some]] ^ grams[some, i]) * _ODD + place[some, i].astype(np.uint64) + np.uint64(shift)))
                            rows.append(at[some])
                            ranks.append(np.full(len(some), i, np.int32))
            if new:
                taken = pa.array(np.concatenate(rows))
                keys, last = np.concatenate(new).view(np.int64), np.concatenate(ranks)
                yield pa.RecordBatch.from_arrays([pa.array(keys), batch.column(1).take(taken), pa.array(last), *(batch.column(c).take(taken) for c in (3, 4))], names=["key", "side", "rank", "word", "n"])

    return run


def first_rows(table: DataFrame) -> DataFrame:
    """Every word three times: among words of its length, and as the shorter or the longer one of a pair."""
    length = F.length("word")
    sides = F.explode(F.array(*(F.struct(F.lit(s).alias("side"), F.xxhash64(F.lit(min(s, 1)), length + int(s == SHORT)).alias("key")) for s in (SAME, SHORT, LONG)))).alias("x")
    return table.select("word", "n", sides).select("x.key", "x.side", F.lit(-1).alias("rank"), "word", "n")


def shared_grams(equal: np.ndarray) -> np.ndarray:
    """[pair, place] whether the gram at each place is equal, by the equality of letters; padding is equal."""
    n, length = equal.shape
    padded = np.ones((n, length + 2 * Q - 2), bool)
    padded[:, Q - 1 : Q - 1 + length] = equal
    out = padded[:, : length + Q - 1].copy()
    for i in range(1, Q):
        out &= padded[:, i : i + length + Q - 1]
    return out


def near(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Which pairs of a[i] and b[i] ([pair, place] letters, b as long as a or one longer) are one edit apart."""
    least = b.shape[1] - 1  # all grams of the longer word but Q
    ok = np.zeros(len(a), bool)
    front = a == b[:, : a.shape[1]]
    shared = shared_grams(front)
    if a.shape[1] == b.shape[1]:
        met = np.flatnonzero(shared.sum(axis=1) >= least)
        ok[met] = (~front[met]).sum(axis=1) == 1
        return ok
    back = a == b[:, 1:]
    met = np.flatnonzero((shared | shared_grams(back)).sum(axis=1) >= least)
    same = np.logical_and.accumulate(front[met], axis=1).sum(axis=1) + np.logical_and.accumulate(back[met][:, ::-1], axis=1).sum(axis=1)
    ok[met] = same >= a.shape[1]
    return ok


def one_edit(a: str, b: str) -> bool:
    """Whether ``a`` becomes ``b`` by one edit; b is as long as a or one longer."""
    i = next((k for k, (x, y) in enumerate(zip(a, b)) if x != y), len(a))
    return a[i + 1 :] == b[i + 1 :] and a != b if len(a) == len(b) else a[i:] == b[i + 1 :]


def merged(own: list[list[int]], least: int) -> list[int]:
    """Members of at least ``least`` of the sorted lists: the shortest are merged by a heap, the long ones looked up."""
    if len(own) < least:
        return []
    own.sort(key=len)
    cut = len(own) - least + 1
    out, last, tally = [], -1, 0
    for member in (*heapq.merge(*own[:cut]), -1):
        if member == last:
            tally += 1
            continue
        if last >= 0:
            missing = len(own) - cut
            for long in own[cut:]:
                k = bisect_left(long, last)
                tally += k < len(long) and long[k] == last
                missing -= 1
                if tally >= least or tally + missing < least:
                    break
            if tally >= least:
                out.append(last)
        last, tally = member, 1
    return out


def heap_pairs(of: list[str], side: list[int]) -> list[tuple[int, int]]:
    """Near pairs (shorter or first, longer or later) of one posting, by merging the postings of its words' grams."""
    index: dict[tuple[str, int], list[int]] = {}
    pad, out = "\0" * (Q - 1), []
    grams = lambda w: [(p[k : k + Q], k) for p in (pad + w + pad,) for k in range(len(w) + Q - 1)]
    for i, w in enumerate(of):
        if side[i] == LONG:
            for g in grams(w):
                index.setdefault(g, []).append(i)
    for i, w in enumerate(of):
        if side[i] == LONG:
            continue
        own, mine = [], grams(w)
        if side[i] == SAME:
            for g in mine:
                posting = index.get(g)
                if posting:
                    own.append(posting)
            found = merged(own, len(w) - 1)
            for g in mine:
                index.setdefault(g, []).append(i)
        else:
            for g, k in mine:  # a gram counts once, at its place or the next
                here, there = index.get((g, k)), index.get((g, k + 1))
                if here or there:
                    own.append(sorted({*here, *there}) if here and there else here or there)
            found = merged(own, len(w))
        out += [(j, i) if side[i] == SAME else (i, j) for j in found if one_edit(w, of[j])]
    return out


class _Posting:
    """The rows of whole postings, in order of their keys."""

    def __init__(self, table: pa.Table):
        self.table = table
        self.key, self.side = table.column(0).to_numpy(), table.column(1).to_numpy()
        starts = np.flatnonzero(np.concatenate([[True], self.key[1:] != self.key[:-1]]))
        sizes = np.diff(np.append(starts, len(self.key)))
        kinds = np.maximum.reduceat(self.side, starts) - np.minimum.reduceat(self.side, starts) + (np.minimum.reduceat(self.side, starts) == SAME)
        useful = (sizes > 1) & (kinds > 0)  # of a word and longer ones, both are there
        self.starts, self.sizes = starts[useful], sizes[useful]

    def pairs(self, paired: int) -> tuple[np.ndarray, np.ndarray]:
        """Row numbers of near pairs, the shorter or earlier word first."""
        if not len(self.starts):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        of = np.array(self.table.column(3).to_pylist(), object)
        lengths = np.fromiter(map(len, of), np.int64, len(of))
        a, b = self._met(paired)
        wide = np.flatnonzero(lengths[b] > WIDE)
        found = [np.array([(i, j) for i, j in zip(a[wide], b[wide]) if one_edit(of[i], of[j])], np.int64).reshape(-1, 2)]
        codes = letters([w if len(w) <= WIDE else "" for w in of], int(min(WIDE, lengths.max())))
        codes = codes.astype(np.uint8) if codes.max() < 256 else codes
        for la, lb in {(int(x), int(y)) for x in np.unique(lengths) for y in (x, x + 1) if y <= WIDE}:
            at = np.flatnonzero((lengths[a] == la) & (lengths[b] == lb))
            for i in range(0, len(at), SLICE):
                x, y = a[at[i : i + SLICE]], b[at[i : i + SLICE]]
                ok = near(codes[x, :la], codes[y, :lb])
                found.append(np.stack([x[ok], y[ok]], axis=1))
        for s, n in zip(self.starts, self.sizes):
            if n > paired:
                found.append(s + np.array(heap_pairs(of[s : s + n].tolist(), self.side[s : s + n].tolist()), np.int64).reshape(-1, 2))
        got = np.concatenate(found)
        return got[:, 0], got[:, 1]

    def _met(self, paired: int) -> tuple[np.ndarray, np.ndarray]:
        """Pairs of the rows of each posting of up to ``paired`` rows."""
        left, right = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for n in np.unique(self.sizes[self.sizes <= paired]):
            i, j = np.triu_indices(n, 1)
            s = self.starts[self.sizes == n][:, None]
            left.append((s + i).ravel())
            right.append((s + j).ravel())
        a, b = np.concatenate(left), np.concatenate(right)
        x, y = self.side[a], self.side[b]
        a, b = np.where(x > y, b, a), np.where(x > y, a, b)
        keep = (x == y) & (x == SAME) | (x + y == SHORT + LONG) & (x != y)
        return a[keep], b[keep]


def _matched(paired: int):
    def out(table: pa.Table) -> pa.RecordBatch:
        a, b = (pa.array(x) for x in _Posting(table).pairs(paired))
        word, n = table.column(3).combine_chunks(), table.column(4).combine_chunks()
        return pa.RecordBatch.from_arrays([word.take(a), n.take(a), word.take(b), n.take(b)], names=["a", "n_a", "b", "n_b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        rows = 0
        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(batch)
            rows += batch.num_rows
            if rows < SLICE // 4:
                continue
            table = pa.Table.from_batches(held)
            key = table.column(0).to_numpy()
            cut = int(np.searchsorted(key, key[-1]))  # the last posting may go on
            if cut:
                yield out(table.slice(0, cut))
            held = table.slice(cut).to_batches()
            rows -= cut
        if held:
            yield out(pa.Table.from_batches(held))

    return run


def near_pairs(table: DataFrame, paired: int = PAIRED, most: int = MOST) -> DataFrame:
    """(a, n_a, b, n_b) of near words, every pair once; a is the shorter one or the first in code-point order."""
    spark = table.sparkSession
    counts = spark.sparkContext.broadcast(gram_counts(table))
    rows, found, depth = first_rows(table), None, 1
    while rows is not None:
        keyed = written(rows.mapInArrow(_next_keys(counts, depth), ROW), "postings")
        sizes = keyed.groupBy("key").agg(F.count("*").alias("members"), F.max(F.length("word")).alias("length"))
        hot = Counted(sizes.where((F.col("members") > most) & (F.col("length") - 1 > depth)).select("key"), "hot")
        rows = keyed.join(hot.side(), "key", "left_semi").select("key", "side", "rank", "word", "n") if hot.n else None
        cold = keyed if rows is None else keyed.join(hot.side(), "key", "left_anti").select("key", "side", "rank", "word", "n")
        pairs = cold.repartition("key").sortWithinPartitions("key").mapInArrow(_matched(paired), PAIR)
        found = pairs if found is None else found.union(pairs)
        depth += 1
    turned = (F.length("a") == F.length("b")) & (F.col("a") > F.col("b"))
    ordered = found.select(*(F.when(turned, F.col(x)).otherwise(F.col(y)).alias(y) for x, y in (("b", "a"), ("n_b", "n_a"), ("a", "b"), ("n_a", "n_b"))))
    return ordered.distinct()


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) of every word of ``forms`` (word, form): the form that has none; each step doubles what is followed."""
    now = Counted(forms.select("word", F.col("form").alias("root")), "forms")
    while now.n:
        ahead = now.df.select(F.col("word").alias("root"), F.col("root").alias("next"))
        moved = Counted(now.df.join(ahead, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "forms")
        going = moved.df.where("moved").limit(1).count()
        moved.df = moved.df.drop("moved")
        now = moved
        if not going:
            break
    return now.df


def variants(docs: DataFrame, ratio: int = 10, **options) -> DataFrame:
    """word, form, root, n, n_near, form_n of every word."""
    table = written(words(docs, **options), "words")
    pairs = near_pairs(table)
    both = pairs.select(F.col("a").alias("word"), F.col("b").alias("of"), F.col("n_b").alias("n_of"), F.col("n_a").alias("own"))
    both = both.union(pairs.select("b", "a", "n_a", "n_b"))
    best = both.groupBy("word", "own").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("n_of")).alias("less"), F.col("of"))).alias("m"))
    enough = -F.col("m.less") >= ratio * F.col("own")
    best = written(best.select("word", "n_near", F.when(enough, F.col("m.of")).alias("form"), F.when(enough, -F.col("m.less")).alias("form_n")), "near-words")
    ends = roots(best.where("form is not null").select("word", "form"))
    out = table.join(best, "word", "left").join(ends, "word", "left")
    return out.select("word", "form", F.coalesce("root", "word").alias("root"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.col("form_n").cast("long").alias("form_n"))
