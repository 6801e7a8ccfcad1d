"""Benchmark decontamination by spaced-seed hashing.

A spaced seed is a mask over SPAN neighbouring tokens that reads some and ignores the rest, so two passages meet in a
seed although tokens at ignored places were replaced. Every window of every document and benchmark item is hashed under
every mask; equal hashes are hits. Around a hit the item is laid over the document at that offset, and of all stretches
with ``least_share`` equal tokens the one with the most equal tokens is the overlap. A document is contaminated by an item
if the overlap has ``least_equal`` equal tokens (or all of a shorter item).

Tokens are runs of letters and digits, folded, as 64-bit hashes. Items shorter than SPAN are looked for whole. The
item side of a join is broadcast after a check of its rows, else both sides are shuffled.

Defined cases: null texts and items are empty and match nothing; repeated rows of a document or item give the pair once;
of equal overlaps the first place counts; null ids stay; empty tables give an empty table; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from markbook.llm.storage import unused, written

# The masks, each over 12 tokens, reading 6; of 16 tokens with three replaced at most or 20 with four, this pair meets 98.8 % of all placements (counted).
MASKS = ("101001000111", "110001101001")
SPAN = 12
LEAST_EQUAL, LEAST_SHARE = 13, 0.8
MOST_BROADCAST = 1_000_000


def tokens(text: Column) -> Column:
    """array<long> of the tokens' hashes."""
    words = F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), "")
    return F.transform(words, lambda w: F.xxhash64(w))


def seeds(toks: Column, mask: str, salt: int) -> Column:
    """array<long>: at i the hash of the window that starts there, under ``mask``; empty for fewer tokens."""
    places = [i for i, c in enumerate(mask) if c == "1"]
    window = lambda i: F.xxhash64(F.lit(salt), *(F.get(toks, i + p) for p in places))
    n = F.size(toks) - len(mask)
    return F.when(n >= 0, F.transform(F.sequence(F.lit(0), n), window)).otherwise(F.array().cast("array<bigint>"))


def _windows(rows: DataFrame, masks: list[str], salt: int, keys: list[str]) -> DataFrame:
    """keys, hash, at of every window under each of ``masks``, which have one span. ``rows``: keys, toks."""
    every = F.concat(*(seeds(F.col("toks"), m, salt + k) for k, m in enumerate(masks)))
    laid = rows.select(*keys, (F.size("toks") - len(masks[0]) + 1).alias("n"), F.posexplode(every).alias("at", "hash"))
    return laid.select(*keys, "hash", F.pmod("at", "n").alias("at"))


def _sized(df: DataFrame, most: int) -> DataFrame:
    """``df`` with a broadcast hint if it has at most ``most`` rows."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


def hits(docs: DataFrame, items: DataFrame, most_broadcast: int) -> DataFrame:
    """doc_id, item_id, shift (place in the document less place in the item), once each. Both: id, toks."""
    short = sorted(r[0] for r in items.select(F.size("toks").alias("n")).where(f"n between 1 and {SPAN - 1}").distinct().collect())  # lengths below SPAN
    groups = [(list(MASKS), 0, items)] + [(["1" * n], 100 + n, items.where(F.size("toks") == n)) for n in short]
    out = None
    for masks, salt, some in groups:
        own = _windows(some, masks, salt, ["item_id"]).withColumnRenamed("at", "place").distinct()
        met = _windows(docs, masks, salt, ["doc_id"]).join(_sized(own, most_broadcast), "hash")
        met = met.select("doc_id", "item_id", (F.col("at") - F.col("place")).alias("shift"))
        out = met if out is None else out.union(met)
    return out.distinct()


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is computed once, however often it is used."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def equal_places(doc: Column, item: Column, shift: Column) -> Column:
    """array<int>: the item's places whose token equals the document's when the item lies at ``shift``."""
    return F.filter(F.sequence(F.lit(0), F.size(item) - 1), lambda j: F.coalesce(F.get(doc, j + shift) == F.get(item, j), F.lit(False)))


def overlap(places: Column, shift: Column, least_share: float) -> Column:
    """struct(n_equal, -n_tokens, -doc_token, -item_token) of the stretch with the most equal tokens of those with ``least_share`` equal.

    The k-th equal place p has the level 1000 k - S p (S: the share in thousandths). A stretch from the a-th to the b-th has the
    share if b's level is at most 1000 - S below a's. So starts and ends are sorted by level, ends moved up by that, and one
    pass keeps the first start met: the best one for each end. It takes n log n steps.
    """
    share = round(1000 * least_share)
    level = lambda p, k: k.cast("long") * 1000 - p * F.lit(share)
    starts = F.transform(places, lambda p, k: F.struct(level(p, k).alias("level"), F.lit(0).alias("end"), k.alias("k"), p.alias("p")))
    ends = F.transform(places, lambda p, k: F.struct((level(p, k) + (1000 - share)).alias("level"), F.lit(1).alias("end"), k.alias("k"), p.alias("p")))
    none = F.struct(*(F.lit(None).cast("int").alias(x) for x in ("n_equal", "less", "doc", "item")))
    state = F.struct(F.lit(None).cast("struct<k:int,p:int>").alias("first"), none.alias("best"))

    def step(s: Column, x: Column) -> Column:
        here = F.struct(x["k"].alias("k"), x["p"].alias("p"))
        found = F.struct((x["k"] - s["first"]["k"] + 1).alias("n_equal"), (s["first"]["p"] - x["p"] - 1).alias("less"), (-s["first"]["p"] - shift).alias("doc"), (-s["first"]["p"]).alias("item"))
        better = s["best"]["n_equal"].isNull() | (found > s["best"])
        return F.when(x["end"] == 0, F.struct(F.least(s["first"], here).alias("first"), s["best"].alias("best"))).otherwise(F.struct(s["first"].alias("first"), F.when(better, found).otherwise(s["best"]).alias("best")))

    return F.aggregate(F.array_sort(F.concat(starts, ends)), state, step, lambda s: s["best"])


def contaminated(
    docs: DataFrame, benchmark: DataFrame, least_equal: int = LEAST_EQUAL, least_share: float = LEAST_SHARE, most_broadcast: int = MOST_BROADCAST
) -> DataFrame:
    """doc_id, item_id, doc_token, item_token (where the overlap starts), n_tokens, n_equal for every contaminated pair.

    A document and an item are one row with all shifts at which they meet, so a repetitive text isn't copied for each.
    """
    texts = docs.select(F.col("doc_id").alias("doc_id"), tokens(F.col("text")).alias("toks"))
    items = written(benchmark.select(F.col("item_id").alias("item_id"), tokens(F.col("text")).alias("toks")), "items")
    found = written(hits(texts, items, most_broadcast).groupBy("doc_id", "item_id").agg(F.collect_list("shift").alias("shifts")), "hits")
    of_item = items.select(F.col("item_id").alias("item"), F.col("toks").alias("item_toks")).distinct()
    near = found.join(_sized(of_item, most_broadcast // 10), F.col("item_id").eqNullSafe(F.col("item")))
    near = near.select(F.col("doc_id").alias("hit_doc"), "item_id", "shifts", "item_toks")
    hinted = F.broadcast(near) if (found.select(F.sum(F.size("shifts"))).first()[0] or 0) <= most_broadcast // 10 else near
    laid = texts.join(hinted, F.col("doc_id").eqNullSafe(F.col("hit_doc")))
    least = F.least(F.lit(least_equal), F.size("item_toks"))
    one = lambda shift: bound(equal_places(F.col("toks"), F.col("item_toks"), shift), lambda p: F.when(F.size(p) >= least, overlap(p, shift, least_share)))
    kept = laid.select("doc_id", "item_id", least.alias("least"), F.array_max(F.transform("shifts", one)).alias("m")).where("m.n_equal >= least")
    best = kept.groupBy("doc_id", "item_id").agg(F.max("m").alias("m"))
    columns = {"doc_token": -F.col("m.doc"), "item_token": -F.col("m.item"), "n_tokens": -F.col("m.less"), "n_equal": F.col("m.n_equal")}
    return best.select("doc_id", "item_id", *(c.cast("long").alias(k) for k, c in columns.items()))


def decontaminated(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """The documents that no item contaminates, with all their columns."""
    name = unused(docs, "bad_doc")
    bad = written(contaminated(docs, benchmark, **options).select(F.col("doc_id").alias(name)).distinct(), "contaminated")
    return docs.join(_sized(bad, MOST_BROADCAST), docs["doc_id"].eqNullSafe(bad[name]), "left_anti")
