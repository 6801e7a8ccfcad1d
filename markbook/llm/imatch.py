"""Document fingerprints by I-Match.

Terms whose inverse document frequency lies in a band form the lexicon: too common ones say nothing of a text,
too rare ones change with every edit. A text keeps its sorted distinct lexicon terms; one signature is made of
all of them and one of those in each of several randomised subsets of the lexicon, so an edit spoils only the
subsets that hold a changed term. The likeness of two fingerprints is the share of subset signatures that agree,
among those that are not empty in both.

A signature is the exclusive-or of the terms' 64-bit hashes: it is that of the sorted distinct terms in any
order, so it combines on the map side and no list of terms is ever shuffled.

The lexicon is broadcast after a check of its size (``most_broadcast`` terms), else it is joined by shuffle. The
band bounds it too: at most (mean distinct terms a text) / ``least_share`` terms can have such a frequency.

Defined cases: null text is empty; a text without lexicon terms has the hash of its folded text as its first
signature and empty subsets; the next document of equal doc ids is by text, descending; null doc ids come
last; with one document it is its own next; an empty table gives an empty table; other columns are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from markbook.llm.storage import written

SUBSETS, RATE = 32, 64
LEAST_SHARE, MOST_SHARE = 0.0005, 0.2
MOST_BROADCAST = 2_000_000


def terms(text: Column) -> Column:
    """array<long>: the sorted distinct terms (runs of letters and digits, folded), each as its 64-bit hash."""
    words = F.array_remove(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), "")
    return F.sort_array(F.array_distinct(F.transform(words, lambda w: F.xxhash64(w))))


def lexicon(texts: DataFrame, text: str = "text", least_share: float = LEAST_SHARE, most_share: float = MOST_SHARE) -> DataFrame:
    """term, code, subsets (bit j: in subset j) of every term in the band; frequencies over all rows."""
    n = texts.count()
    low, high = math.log(1 / most_share), math.log(1 / least_share)
    df = texts.select(F.explode(terms(F.col(text))).alias("term")).groupBy("term").agg(F.count("*").alias("df"))
    idf = F.log(F.lit(float(max(n, 1))) / F.col("df"))
    member = [F.when(F.pmod(F.xxhash64("term", F.lit(j)), F.lit(RATE)) == 0, F.lit(1 << j)).otherwise(0) for j in range(SUBSETS)]
    subsets = member[0].cast("long")
    for m in member[1:]:
        subsets = subsets.bitwiseOR(m.cast("long"))
    return df.where(idf.between(low, high)).select("term", F.xxhash64("term", F.lit("code")).alias("code"), subsets.alias("subsets"))


def signatures(rows: DataFrame, keys: list[str], lex: DataFrame, most_broadcast: int = MOST_BROADCAST) -> DataFrame:
    """keys, whole, parts (array of SUBSETS signatures) of every row with a lexicon term; ``rows``: keys, text."""
    side = F.broadcast(lex) if lex.limit(most_broadcast + 1).count() <= most_broadcast else lex
    hits = rows.select(*keys, F.explode(terms(F.col("text"))).alias("term")).join(side, "term")
    part = [F.bit_xor(F.when(F.col("subsets").bitwiseAND(F.lit(1 << j)) != 0, F.col("code")).otherwise(F.lit(0))).alias(f"p{j}") for j in range(SUBSETS)]
    got = hits.groupBy(*keys).agg(F.bit_xor("code").alias("whole"), *part)
    return got.select(*keys, "whole", F.array(*(f"p{j}" for j in range(SUBSETS))).alias("parts"))


def shown(whole: Column, parts: Column) -> Column:
    """Hex of a fingerprint: 16 digits of the whole, 8 of each subset."""
    return F.concat(F.lpad(F.lower(F.hex(whole)), 16, "0"), F.array_join(F.transform(parts, lambda p: F.lower(F.right(F.lpad(F.hex(p), 16, "0"), F.lit(8)))), ""))


def likeness(a: Column, b: Column) -> Column:
    """0 to 1 for two fingerprints, each a struct (whole, parts)."""
    pairs = F.arrays_zip(a["parts"].alias("x"), b["parts"].alias("y"))
    used = F.size(F.filter(pairs, lambda p: (p["x"] != 0) | (p["y"] != 0)))
    same = F.size(F.filter(pairs, lambda p: (p["x"] == p["y"]) & (p["x"] != 0)))
    return F.when(a["whole"] == b["whole"], F.lit(1.0)).when(used == 0, F.lit(0.0)).otherwise(same / used)


def with_next(docs: DataFrame, buckets: int) -> DataFrame:
    """key, next_key, doc_id, text, next_text: every document with the next by descending doc_id.

    Documents are dealt to buckets by ranges of doc_id; into each comes a copy of the first document of the next
    bucket, so a window inside the bucket sees the follower of every document. No task sees the whole order.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    cuts = rows.agg(F.percentile_approx("doc_id", [i / buckets for i in range(1, buckets)], 10_000)).first()[0] or []
    bounds = F.array(*map(F.lit, sorted(set(cuts)))) if cuts else F.array().cast("array<bigint>")
    rows = rows.withColumn("bucket", F.when(F.col("doc_id").isNull(), -1).otherwise(F.size(F.filter(bounds, lambda b: b < F.col("doc_id")))))
    tops = rows.groupBy("bucket").agg(F.max("doc_id").alias("top"))
    heads = rows.join(F.broadcast(tops.withColumnRenamed("bucket", "b")), (F.col("bucket") == F.col("b")) & F.col("doc_id").eqNullSafe(F.col("top")))
    heads = heads.groupBy("bucket").agg(F.max("top").alias("doc_id"), F.max("text").alias("text"))
    line = Window.orderBy(F.col("bucket").desc())  # over the buckets, at most ``buckets`` + 1 rows
    turn = tops.select("bucket", F.lead("bucket").over(line).alias("after"), F.max("bucket").over(Window.partitionBy()).alias("last"))
    turn = turn.select(F.col("bucket").alias("into"), F.coalesce("after", "last").alias("bucket"))
    guests = turn.join(heads, "bucket").select("doc_id", "text", F.col("into").alias("bucket"), F.col("bucket").alias("home"))
    both = rows.select("doc_id", "text", "bucket", F.lit(None).cast("int").alias("home")).union(guests)
    w = Window.partitionBy("bucket").orderBy(F.col("home").asc_nulls_first(), F.col("doc_id").desc_nulls_last(), F.col("text").desc())
    key = lambda bucket, at: F.shiftleft(bucket.cast("long"), 40) + at
    placed = both.withColumns({"at": F.row_number().over(w), "next_home": F.lead("home").over(w), "next_text": F.lead("text").over(w)})
    return placed.where("home is null").select(
        key(F.col("bucket"), F.col("at")).alias("key"),
        F.when(F.col("next_home").isNull(), key(F.col("bucket"), F.col("at") + 1)).otherwise(key(F.col("next_home"), F.lit(1))).alias("next_key"),
        "doc_id",
        "text",
        "next_text",
    )


def edited(text: Column, other: Column) -> Column:
    """``text`` with its last floor(n/2) code points replaced by the first as many (or all) of ``other``."""
    half = F.floor(F.length(text) / 2).cast("int")
    return F.concat(F.substring(text, F.lit(1), F.length(text) - half), F.substring(other, F.lit(1), half))


def fingerprint_table(docs: DataFrame, buckets: int | None = None, least_share: float = LEAST_SHARE, most_share: float = MOST_SHARE) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next of every row."""
    buckets = buckets or 4 * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    lex = written(lexicon(docs.select("text"), "text", least_share, most_share), "lexicon")
    rows = with_next(docs, buckets).withColumn("changed", edited(F.col("text"), F.col("next_text")))
    plain = lambda c: F.xxhash64(F.lower(c))
    meta = rows.select("key", "next_key", "doc_id", F.length("text").cast("long").alias("n_chars"), F.sha2("changed", 256).alias("edited_sha256"), plain(F.col("text")).alias("h"), plain(F.col("changed")).alias("g"))
    versions = F.explode(F.array(F.struct(F.lit(0).alias("version"), F.col("text")), F.struct(F.lit(1).alias("version"), F.col("changed").alias("text"))))
    found = written(signatures(rows.select("key", versions.alias("v")).select("key", "v.version", "v.text"), ["key", "version"], lex), "signatures")
    none = F.array_repeat(F.lit(0).cast("long"), SUBSETS)
    print_of = lambda whole, parts, other: F.struct(F.coalesce(whole, other).alias("whole"), F.coalesce(parts, none).alias("parts"))
    own = found.where("version = 0").select("key", F.col("whole").alias("w0"), F.col("parts").alias("p0"))
    new = found.where("version = 1").select("key", F.col("whole").alias("w1"), F.col("parts").alias("p1"))
    full = meta.join(own, "key", "left").join(new, "key", "left")
    full = written(full.select("key", "next_key", "doc_id", "n_chars", "edited_sha256", print_of(F.col("w0"), F.col("p0"), F.col("h")).alias("a"), print_of(F.col("w1"), F.col("p1"), F.col("g")).alias("b")), "prints")
    following = full.select(F.col("key").alias("next_key"), F.col("a").alias("c"))
    a, b, c = F.col("a"), F.col("b"), F.col("c")
    return full.join(following, "next_key").select(
        "doc_id",
        "n_chars",
        "edited_sha256",
        shown(a["whole"], a["parts"]).alias("fingerprint"),
        shown(b["whole"], b["parts"]).alias("edited_fingerprint"),
        likeness(a, b).alias("near_edited"),
        likeness(a, c).alias("near_next"),
    )
