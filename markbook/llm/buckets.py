"""Links between members of buckets: all that join components, without the pairs that the components make needless.

A bucket of up to SMALL members is judged wholly: all its pairs. Pairing off a larger one costs its square, so it is linked
through leaders: its smallest member first (mostly the same one in all buckets of a group, so few pairs differ), then, as
the caller says, a few of those that remain, picked by a hash that differs by bucket. The members of the bucket are judged
against the leaders, and those that are alike are tied and don't remain.

The rest is judged exactly: in every bucket that still holds more than one component, all pairs of members of different ones.
So of two members that share a bucket and are alike, both are in one component in the end: a pair that isn't judged is in
one already. A bucket of one component, however large, costs its size; one whose members are all unlike costs its square, as
an exact answer does, in joins of BLOCK members against the bucket, so that no task holds it.

Where the caller has ``facts`` of the members and a condition ``likely`` on those of two, which all that are alike meet, the
join makes only pairs that meet it, and ``sketches`` are such facts: the number of a set's elements and the parities of how many
of them fall in each of BITS cells. As many parities differ, at most, as elements stand in one set only.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from markbook.llm.components import components
from markbook.llm.storage import Counted

LEADERS, ROUNDS, BLOCK, SMALL = 4, 2, 256, 6
BITS = 1024
SKETCH = "n int, bits array<long>"
Judge = Callable[[Counted, Counted], Counted]
Likely = Callable[[Column, Column, Column], Column]


def sketches(hashes: np.ndarray, counts: np.ndarray) -> list[pa.Array]:
    """n, bits of sets of 64-bit ``hashes``, of which each set has the next ``counts`` (repeats included)."""
    of = np.repeat(np.arange(len(counts)), counts)
    order = np.lexsort((hashes, of))
    h, of = hashes[order], of[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (of[1:] != of[:-1])
    h, of = h[new], of[new]
    words = BITS // 64
    cell = (h & np.uint64(BITS - 1)).astype(np.int64)
    bits = np.zeros(len(counts) * words, np.uint64)
    np.bitwise_xor.at(bits, of * words + (cell >> 6), np.uint64(1) << (cell & 63).astype(np.uint64))
    sizes = np.bincount(of, minlength=len(counts)).astype(np.int32)
    return [pa.array(sizes), pa.ListArray.from_arrays(pa.array(np.arange(len(counts) + 1) * words, pa.int32()), pa.array(bits.view(np.int64)))]


def may_be_alike(a: Column, b: Column, least: float) -> Column:
    """Whether sets of the sketches ``a`` and ``b`` (structs) may have a Jaccard likeness of ``least``; true of all that have."""
    differ = sum((F.bit_count(F.get(a["bits"], F.lit(i)).bitwiseXOR(F.get(b["bits"], F.lit(i)))) for i in range(1, BITS // 64)), F.bit_count(F.get(a["bits"], F.lit(0)).bitwiseXOR(F.get(b["bits"], F.lit(0)))))
    near = F.least(a["n"], b["n"]) >= F.greatest(a["n"], b["n"]) * F.lit(least) - F.lit(1e-6)
    return near & (differ * F.lit(1 + least) <= (a["n"] + b["n"]) * F.lit(1 - least) + F.lit(1e-6))


def _pair(a: str, b: str) -> list[Column]:
    return [F.greatest(a, b).alias("u"), F.least(a, b).alias("v")]


def _pairs_of(few: DataFrame) -> DataFrame:
    """(u, v) of all pairs of small buckets (band, id)."""
    packed = few.groupBy("band").agg(F.sort_array(F.collect_list("id")).alias("ids"))
    rest = lambda x, i: F.transform(F.slice("ids", i + 2, F.size("ids")), lambda y: F.struct(y.alias("u"), x.alias("v")))
    return packed.select(F.explode(F.flatten(F.transform("ids", rest))).alias("p")).select("p.u", "p.v").distinct()


def _leaders(rows: DataFrame, round_: int, most: int = LEADERS) -> DataFrame:
    """band, leader: the smallest member of each band in round 0, up to ``most`` of them later."""
    place = F.struct(*([F.xxhash64("id", "band", F.lit(round_))] if round_ else []), F.col("id").alias("leader"))
    slot = F.pmod(F.xxhash64("band", "id"), F.lit(most if round_ else 1)).alias("slot")
    return rows.groupBy("band", slot).agg(F.min(place).alias("m")).select("band", "m.leader")


class _Judged:
    """All judgements so far, and the judge."""

    def __init__(self, judge: Judge, ids: Counted):
        self.judge, self.ids = judge, ids
        self.parts: list[Counted] = []

    def ask(self, pairs: DataFrame) -> None:
        """Judges those of distinct ``pairs`` (u, v) that weren't yet."""
        for part in self.parts:
            pairs = pairs.join(part.side(part.df.select("u", "v")), ["u", "v"], "left_anti")
        asked = Counted(pairs, "asked")
        if asked.n:
            self.parts.append(self.judge(asked, self.ids))

    def links(self) -> DataFrame | None:
        out = None
        for part in self.parts:
            ok = part.df.where("ok").select("u", "v")
            out = ok if out is None else out.union(ok)
        return out

    def tied(self, stars: DataFrame) -> DataFrame:
        """band, id of the stars (band, id, u, v) whose pair is alike."""
        out = None
        for part in self.parts:
            met = stars.join(part.side(part.df.where("ok").select("u", "v")), ["u", "v"]).select("band", "id")
            out = met if out is None else out.union(met)
        return out


def links(keys: DataFrame, judge: Judge, rounds: int = ROUNDS, likely: Likely | None = None, facts: Callable[[], DataFrame] | None = None) -> DataFrame:
    """Links (u, v) of a table of distinct (id, band), or (id, band, n) with the number of rows of a band, after ``rounds`` of leaders.

    ``judge(pairs, ids)`` gives a table (u, v, ok) of all alike and any others of the pairs (u, v), all of whose members are in ``ids`` (id). ``likely(a, b, band)``
    is true of all pairs that are alike, at one band at least of those that they share, where a and b are rows (as structs) of
    the table (id, ...) that ``facts`` gives.
    """
    if "n" not in keys.columns:
        keys = keys.select("band", "id").join(keys.groupBy("band").agg(F.count("*").alias("n")), "band")
    every = Counted(keys.select("band", "id", "n").where("n > 1"), "buckets")
    members = Counted(every.df.where(F.col("n") > SMALL), "large")
    judged = _Judged(judge, Counted(every.df.select("id").distinct(), "members"))
    judged.ask(_pairs_of(every.df.where(F.col("n") <= SMALL)))
    left = members
    for n in range(rounds):
        if not left.n:
            break
        heads = Counted(_leaders(left.df, n), "leaders")
        stars = left.df.join(heads.side(), "band").where("id <> leader").select("band", "id", *_pair("id", "leader"))
        if n + 1 == rounds:
            judged.ask(stars.select("u", "v").distinct())
            break
        stars = Counted(stars, "stars")
        judged.ask(stars.df.select("u", "v").distinct())
        tied, first = judged.tied(stars.df), heads.df.select("band", F.col("leader").alias("id"))
        gone = Counted((first if tied is None else tied.union(first)).distinct(), "gone")
        left = Counted(left.df.join(gone.side(), ["band", "id"], "left_anti"), "left")
    if members.n:
        judged.ask(_across(members, Counted(components(judged.links()), "roots"), likely, facts and facts()))
    return judged.links() if judged.parts else members.df.select(F.col("id").alias("u"), F.col("id").alias("v")).limit(0)


def _across(members: Counted, roots: Counted, likely: Likely | None, facts: DataFrame | None) -> DataFrame:
    """Pairs (u, v) of all members of different components that are likely, in the buckets that hold several."""
    rooted = members.df.join(roots.side(), F.col("id") == F.col("node"), "left").select("band", "id", "n", F.coalesce("root", "id").alias("root"))
    rooted = Counted(rooted, "rooted")
    torn = rooted.df.groupBy("band").agg(F.min("root").alias("a"), F.max("root").alias("b")).where("a < b").select("band")
    rows = Counted(rooted.df.join(torn, "band").withColumn("k", F.ceil(F.col("n") / BLOCK).cast("int")), "torn").df
    rows = rows.withColumn("own", F.lit(None)) if facts is None else rows.join(facts.select("id", F.struct(*facts.columns).alias("own")), "id")
    one = rows.select("band", "id", "root", F.col("own").alias("x"), F.pmod(F.xxhash64("id", "band"), "k").cast("int").alias("block"))
    all_ = rows.select("band", F.col("id").alias("leader"), F.col("root").alias("other"), F.col("own").alias("y"), F.explode(F.sequence(F.lit(0), F.col("k") - 1)).alias("block"))
    met = one.join(all_, ["band", "block"]).where("root < other")
    met = met if likely is None or facts is None else met.where(likely(F.col("x"), F.col("y"), F.col("band")))
    return met.select(*_pair("id", "leader")).distinct()
