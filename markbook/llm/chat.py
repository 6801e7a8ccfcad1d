"""Chat formatting: snapshots of one conversation collapse into the longest, which is rendered.

A service that logs the whole history at each turn leaves many prefixes of the same conversation. A rolling
hash over (role, text) of the first k turns names each prefix; a conversation whose last hash is the hash of a
proper prefix of another is left out by an anti-join, and of identical ones the smallest id stays.

One conversation is one output row, so its turns are put together in one row too.

Defined cases: a null role or text counts as empty; turns sort by (turn, role, text), nulls first; repeated
rows are repeated turns; rows without a conversation id are one conversation with a null id; an empty table
gives an empty table; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

OPEN, CLOSE = "<|im_start|>", "<|im_end|>"


def rolling_hashes(turns: Column) -> Column:
    """array<string>: at k the hash of turns 1..k, each chained from the one before."""
    return F.aggregate(
        turns,
        F.array().cast("array<string>"),
        lambda seen, t: F.concat(
            seen,
            F.array(F.md5(F.concat(F.coalesce(F.try_element_at(seen, F.lit(-1)), F.lit("")), F.md5(t["role"]), F.md5(t["text"])))),
        ),
    )


def render(turns: Column) -> Column:
    """One text: each turn between the markers, its role on the first line."""
    return F.array_join(F.transform(turns, lambda t: F.concat(F.lit(OPEN), t["role"], F.lit("\n"), t["text"], F.lit(CLOSE + "\n"))), "")


def format_chats(conversations: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """conv_id, n_turns, n_copies (identical logs), text of every maximal conversation."""
    rows = conversations.select(
        F.col(conv).alias("conv_id"),
        F.struct(F.col(turn).alias("turn"), F.coalesce(F.col(role), F.lit("")).alias("role"), F.coalesce(F.col(text), F.lit("")).alias("text")).alias("t"),
    )
    logs = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("turns"))
    chained = logs.select("conv_id", rolling_hashes(F.col("turns")).alias("chain"))
    ends = chained.select("conv_id", F.element_at("chain", -1).alias("whole")).groupBy("whole").agg(F.min("conv_id").alias("kept_id"), F.count("*").alias("n_copies"))
    inner = chained.select(F.explode(F.slice("chain", F.lit(1), F.size("chain") - 1)).alias("whole")).distinct()
    kept = ends.join(inner, "whole", "left_anti")
    return kept.join(logs, F.col("kept_id").eqNullSafe(F.col("conv_id"))).select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), "n_copies", render(F.col("turns")).alias("text")
    )


ORACLE = """
WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS r, coalesce(text, '') AS x FROM conversations),
o AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, r, x) AS k,
             count(*) OVER (PARTITION BY conv_id) AS n FROM t),
p AS (SELECT conv_id, k, n, string_agg(md5(md5(r) || md5(x)), '') OVER (PARTITION BY conv_id ORDER BY k) AS pre FROM o),
e AS (SELECT conv_id, pre FROM p WHERE k = n),
m AS (SELECT pre, min(conv_id) AS kept_id, count(*) AS n_copies FROM e
      WHERE NOT EXISTS (SELECT 1 FROM p WHERE p.k < p.n AND p.pre = e.pre) GROUP BY pre)
SELECT o.conv_id, count(*) AS n_turns, max(m.n_copies) AS n_copies,
       string_agg('<|im_start|>' || r || chr(10) || x || '<|im_end|>' || chr(10), '' ORDER BY k) AS text
FROM m JOIN o ON o.conv_id = m.kept_id GROUP BY o.conv_id
"""
