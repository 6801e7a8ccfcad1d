"""Catalogue of the queries over the driver's tables: each binds operators to columns, with its DuckDB SQL beside it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from markbook.functions import dates as D
from markbook.functions import extract as E
from markbook.functions import numbers as N
from markbook.functions import text as X
from markbook.operators import aggregates as A
from markbook.operators import filters as P
from markbook.operators import graph as G
from markbook.operators import joins as J
from markbook.operators import reshape as R
from markbook.operators import schema as C
from markbook.operators import sets as U
from markbook.operators import windows as W
from markbook.session import checkpointing, importable

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a function (tables) -> DataFrame under its name, with its SQL."""

    def add(f: Callable[[Callable[[str], DataFrame], SparkSession], DataFrame]) -> Query:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            importable(spark)
            return f(lambda name: spark.read.parquet(f"{sf_dir}/{name}.parquet"), spark)

        run.__name__, run.__doc__ = f.__name__, f.__doc__
        _QUERIES[f.__name__] = run
        if sql is not None:
            _ORACLE[f.__name__] = sql
        return run

    return add


c = F.col


# Aggregates


@query("""SELECT l_returnflag, l_linestatus, CAST(count(*) AS BIGINT) AS total, CAST(count(*) FILTER (l_linestatus = 'F') AS BIGINT) AS completed,
 round(coalesce(100.0 * count(*) FILTER (l_linestatus = 'F') / nullif(count(*), 0), 0), 1) AS completion_pct FROM lineitem GROUP BY ALL""")
def completion_rollup(t, spark):
    """A1, A3."""
    return A.completion(t("lineitem"), ["l_returnflag", "l_linestatus"], F.lit(1), F.when(c("l_linestatus") == "F", 1).otherwise(0))


@query("""SELECT r_name, n_name, CAST(count(*) AS BIGINT) AS total, CAST(count(*) FILTER (o_orderstatus = 'F') AS BIGINT) AS completed,
 round(100.0 * count(*) FILTER (o_orderstatus = 'F') / count(*), 1) AS completion_pct
 FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY ALL""")
def completion_by_region(t, spark):
    """A1, A3, J5 over dimensions; the flagship."""
    names = t("nation").join(F.broadcast(t("region")), c("n_regionkey") == c("r_regionkey")).select("n_nationkey", "n_name", "r_name")  # fixed tables of 25 and 5 rows
    who = t("customer").select("c_custkey", "c_nationkey").join(F.broadcast(names), c("c_nationkey") == c("n_nationkey"))
    rows = t("orders").select("o_custkey", "o_orderstatus").join(who, c("o_custkey") == c("c_custkey"))
    return A.completion(rows, ["r_name", "n_name"], F.lit(1), F.when(c("o_orderstatus") == "F", 1).otherwise(0))


@query("""SELECT CAST(count(*) AS BIGINT) AS rows, CAST(count(*) FILTER (l_linestatus = 'O') AS BIGINT) AS open, CAST(count(*) FILTER (l_returnflag = 'R') AS BIGINT) AS returned,
 CAST(count(*) FILTER (l_discount > 0.05) AS BIGINT) AS discounted, CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS quantity,
 round(100.0 * count(*) FILTER (l_linestatus = 'F') / count(*), 1) AS progress_pct FROM lineitem""")
def kpi_global(t, spark):
    """One row of figures."""
    flag = lambda p: F.when(p, 1).otherwise(0)
    out = A.sums(
        t("lineitem"), [], {"rows": F.lit(1), "open": flag(c("l_linestatus") == "O"), "returned": flag(c("l_returnflag") == "R"), "discounted": flag(c("l_discount") > 0.05), "quantity": c("l_quantity").cast("long"), "done": flag(c("l_linestatus") == "F")}
    )
    return out.withColumn("progress_pct", N.percent(c("done"), c("rows"))).drop("done")


@query("""SELECT CAST(count(DISTINCT user_id) AS BIGINT) AS users, CAST(count(DISTINCT event_type) AS BIGINT) AS types, CAST(count(*) AS BIGINT) AS events FROM events""")
def distinct_counts(t, spark):
    """A4."""
    return t("events").agg(F.countDistinct("user_id").alias("users"), F.countDistinct("event_type").alias("types"), F.count("*").alias("events"))


@query("""WITH d AS (SELECT CAST(ts AS DATE) AS day, user_id, event_type FROM events), p AS (SELECT day, CAST(row_number() OVER (ORDER BY day) AS INT) AS n FROM (SELECT DISTINCT day FROM d))
SELECT 'Day ' || n AS period, CAST(count(DISTINCT user_id) AS BIGINT) AS users FROM d JOIN p USING (day) GROUP BY n""")
def distinct_per_period(t, spark):
    """Users by day, days relabelled in order."""
    days = W.distinct_rank(t("events").select(F.to_date("ts").alias("day"), "user_id"), "day", "n")
    return days.groupBy(F.concat(F.lit("Day "), c("n")).alias("period")).agg(F.countDistinct("user_id").alias("users"))


@query("""SELECT CAST(ts AS DATE) AS day, event_type, CAST(count(*) AS BIGINT) AS n FROM events GROUP BY ALL""")
def counts_by_two(t, spark):
    """A6."""
    return t("events").groupBy(F.to_date("ts").alias("day"), "event_type").agg(F.count("*").alias("n"))


@query("""SELECT event_type AS value, CAST(count(*) AS BIGINT) AS n FROM events WHERE event_type IS NOT NULL GROUP BY ALL""")
def frequency_table(t, spark):
    """A7, F31."""
    return A.frequency(t("events"), "event_type")


@query("""SELECT CASE WHEN grouping(c_mktsegment) = 1 THEN 'TOTAL' ELSE c_mktsegment END AS c_mktsegment, CAST(count(*) FILTER (c_acctbal < 0) AS BIGINT) AS negative,
 CAST(count(*) FILTER (c_acctbal >= 0) AS BIGINT) AS positive, CAST(count(*) AS BIGINT) AS total FROM customer GROUP BY ROLLUP (c_mktsegment)""")
def rollup_totals(t, spark):
    """A8, K4."""
    return A.with_total(t("customer"), "c_mktsegment", {"negative": F.count_if(c("c_acctbal") < 0), "positive": F.count_if(c("c_acctbal") >= 0), "total": F.count("*")})


@query("""SELECT l_returnflag, CAST(count(DISTINCT l_orderkey) AS BIGINT) AS n_entities, CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS total, CAST(max(l_quantity) AS BIGINT) AS largest, round(avg(l_quantity), 2) AS mean FROM lineitem GROUP BY ALL""")
def summary_stats(t, spark):
    """A9."""
    return A.summary(t("lineitem").withColumn("q", c("l_quantity").cast("long")), ["l_returnflag"], "l_orderkey", "q")


@query("""SELECT r_name, CAST(count(*) AS BIGINT) AS n, string_agg(n_name || ' (+' || n_nationkey || ')', ', ' ORDER BY n_nationkey) AS items FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY ALL""")
def listagg_detail(t, spark):
    """A10."""
    rows = t("nation").join(F.broadcast(t("region")), c("n_regionkey") == c("r_regionkey"))
    return A.listed(rows, ["r_name"], F.concat(c("n_name"), F.lit(" (+"), c("n_nationkey"), F.lit(")")), ["n_nationkey"])


@query("""SELECT l_returnflag, CAST(count(DISTINCT l_linestatus) AS BIGINT) AS n, string_agg(DISTINCT l_linestatus, ', ' ORDER BY l_linestatus) AS items FROM lineitem GROUP BY ALL""")
def listed_distinct(t, spark):
    """A13."""
    return A.listed(t("lineitem"), ["l_returnflag"], c("l_linestatus"), [], distinct=True)


@query("""SELECT o_orderpriority, CAST(min(o_orderdate) AS DATE) AS first_day, CAST(max(o_orderdate) AS DATE) AS last_day FROM orders GROUP BY ALL""")
def date_span(t, spark):
    """A11."""
    return t("orders").groupBy("o_orderpriority").agg(F.to_date(F.min("o_orderdate")).alias("first_day"), F.to_date(F.max("o_orderdate")).alias("last_day"))


@query("""SELECT round(avg(CAST(regexp_extract(p_brand, '([0-9]+)', 1) AS DOUBLE)), 2) AS mean, max(CAST(regexp_extract(p_brand, '([0-9]+)', 1) AS DOUBLE)) AS largest FROM part""")
def numeric_profile(t, spark):
    """A12, N1."""
    return A.numeric_profile(t("part").select(F.regexp_extract("p_brand", "([0-9]+)", 1).alias("n")), "n")


@query("""SELECT l_linestatus, CAST(coalesce(sum(l_quantity) FILTER (l_returnflag = 'A'), 0) AS BIGINT) AS A, CAST(coalesce(sum(l_quantity) FILTER (l_returnflag = 'N'), 0) AS BIGINT) AS N,
 CAST(coalesce(sum(l_quantity) FILTER (l_returnflag = 'R'), 0) AS BIGINT) AS R, CAST(coalesce(sum(l_quantity) FILTER (l_returnflag IN ('A', 'N', 'R')), 0) AS BIGINT) AS total FROM lineitem GROUP BY ALL""")
def crosstab_sum(t, spark):
    """A15, J15."""
    return R.crosstab_sum(t("lineitem").withColumn("q", c("l_quantity").cast("long")), ["l_linestatus"], "l_returnflag", ["A", "N", "R"], "q")


@query("""WITH b AS (SELECT n_regionkey, n_name, n_nationkey, CASE WHEN n_nationkey < 12 THEN 'low' ELSE 'high' END AS band FROM nation)
SELECT n_regionkey, coalesce(string_agg(n_name, ' / ' ORDER BY n_nationkey DESC) FILTER (band = 'low'), '--') AS low, coalesce(string_agg(n_name, ' / ' ORDER BY n_nationkey DESC) FILTER (band = 'high'), '--') AS high FROM b GROUP BY ALL""")
def crosstab_text(t, spark):
    """A16."""
    rows = t("nation").withColumn("band", F.when(c("n_nationkey") < 12, "low").otherwise("high"))
    return R.crosstab_text(rows, ["n_regionkey"], "band", ["low", "high"], c("n_name"), [-c("n_nationkey")])


@query("""SELECT l_returnflag, CAST(count(*) AS BIGINT) AS n, CAST(count(*) FILTER (l_discount > 0.05) AS BIGINT) AS hits, round(count(*) FILTER (l_discount > 0.05) / count(*), 6) AS share,
 count(*) FILTER (l_discount > 0.05) / count(*) > 0.5 AS eligible FROM lineitem GROUP BY ALL""")
def moderation_rule(t, spark):
    """A18, K17."""
    return A.rule_of_share(t("lineitem"), ["l_returnflag"], c("l_discount") > 0.05)


@query("""SELECT o_orderkey, CAST(sum(l_quantity) AS BIGINT) AS parts, CAST(max(o_orderkey % 100) AS BIGINT) * count(*) AS whole,
 abs(sum(l_quantity) - max(o_orderkey % 100) * count(*)) >= 0.01 AS mismatch FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY ALL""")
def check_totals(t, spark):
    """A19, N5."""
    rows = t("lineitem").select("l_orderkey", "l_quantity").join(t("orders").select("o_orderkey"), c("l_orderkey") == c("o_orderkey"))
    return A.check_totals(rows, ["o_orderkey"], c("l_quantity").cast("long"), c("o_orderkey") % 100)


@query("""SELECT l_returnflag, min(l_quantity) AS low, quantile_cont(l_quantity, 0.25) AS q1, quantile_cont(l_quantity, 0.5) AS median, quantile_cont(l_quantity, 0.75) AS q3, max(l_quantity) AS high FROM lineitem GROUP BY ALL""")
def box_quartiles(t, spark):
    """A20."""
    return A.quartiles(t("lineitem"), ["l_returnflag"], "l_quantity")


@query("""SELECT CAST(count(*) FILTER (pct = 100.0) AS BIGINT) AS completed, CAST(count(*) FILTER (pct <> 100.0) AS BIGINT) AS pending FROM (SELECT o_orderkey, round(100.0 * count(*) FILTER (l_linestatus = 'F') / count(*), 1) AS pct FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY ALL)""")
def completed_modules(t, spark):
    """A22, A23."""
    rows = t("lineitem").select("l_orderkey", "l_linestatus").join(t("orders").select("o_orderkey"), c("l_orderkey") == c("o_orderkey"), "left_semi")
    done = A.completion(rows, ["l_orderkey"], F.lit(1), F.when(c("l_linestatus") == "F", 1).otherwise(0))
    return done.agg(F.count_if(c("completion_pct") == 100.0).alias("completed"), F.count_if(c("completion_pct") != 100.0).alias("pending"))


@query("""SELECT c_mktsegment, CAST(count(*) AS BIGINT) AS n, CAST(greatest(1, floor(count(*) * 0.05 + 0.5)) AS BIGINT) AS quota FROM customer GROUP BY ALL""")
def segment_quota(t, spark):
    """A24, N7."""
    return A.quotas(t("customer"), "c_mktsegment")


@query("""SELECT split_part(p_name, ' ', 1) AS canon, CAST(count(DISTINCT p_name) AS BIGINT) AS spellings, CAST(count(DISTINCT p_brand) AS BIGINT) AS programmes, CAST(count(*) AS BIGINT) AS n,
 count(DISTINCT p_name) > 1 OR count(DISTINCT p_brand) > 1 OR count(*) > 1 AS is_common FROM part GROUP BY ALL""")
def common_modules(t, spark):
    """A14, A25, R8."""
    return A.common_groups(t("part").withColumn("canon", F.split_part("p_name", F.lit(" "), F.lit(1))), "canon", "p_name", "p_brand")


@query("""SELECT o_custkey, arg_min(o_orderstatus, o_orderkey) AS o_orderstatus FROM orders GROUP BY ALL""")
def first_value(t, spark):
    """A26, W5."""
    return A.first_value(t("orders"), ["o_custkey"], "o_orderstatus", ["o_orderkey"])


# Windows, sorting, duplicates


@query("""SELECT o_custkey, o_orderkey, o_orderstatus FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey) AS rn FROM orders) WHERE rn = 1""")
def latest_per_entity(t, spark):
    """W1, T6."""
    return W.latest(t("orders").select("o_custkey", "o_orderkey", "o_orderstatus", "o_orderdate"), "o_custkey", [F.desc("o_orderdate"), F.asc("o_orderkey")]).drop("o_orderdate")


@query("""SELECT doc_id, count(*) OVER (PARTITION BY text) > 1 AS is_duplicate FROM documents""")
def duplicate_flag(t, spark):
    """W2, R6; texts are compared whole."""
    return W.duplicate_flag(t("documents").select("doc_id", "text"), ["text"]).drop("text")


@query("""SELECT min(doc_id) AS doc_id FROM documents GROUP BY text""")
def dedup_first(t, spark):
    """W3."""
    return W.deduplicate(t("documents").select("doc_id", "text"), ["text"], [F.asc("doc_id")]).select("doc_id")


@query("""SELECT max(doc_id) AS doc_id FROM documents GROUP BY text""")
def dedup_last(t, spark):
    """W3."""
    return W.deduplicate(t("documents").select("doc_id", "text"), ["text"], [F.desc("doc_id")]).select("doc_id")


@query("""WITH d AS (SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY ALL HAVING count(*) > 1)
SELECT 'l_orderkey:' || l_orderkey || ' | l_linenumber:' || l_linenumber AS label, CAST(n AS BIGINT) AS n, CAST(dense_rank() OVER (ORDER BY l_orderkey) % 2 AS INT) AS band FROM d""")
def duplicate_groups(t, spark):
    """Groups of equal keys, banded by order."""
    groups = t("lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.count("*").alias("n")).where("n > 1")
    banded = W.distinct_rank(groups, "l_orderkey", "r")
    return banded.select(X.group_label(["l_orderkey", "l_linenumber"]).alias("label"), "n", (c("r") % 2).alias("band"))


@query("""SELECT c_mktsegment, c_custkey, CAST(rn AS INT) AS rn FROM (SELECT *, row_number() OVER (PARTITION BY c_mktsegment ORDER BY c_acctbal DESC, c_custkey) AS rn, count(*) OVER (PARTITION BY c_mktsegment) AS n FROM customer) WHERE rn <= greatest(1, floor(n * 0.05 + 0.5))""")
def top_percent_per_group(t, spark):
    """A24, W13, F24."""
    return W.top_share(t("customer"), "c_mktsegment", [F.desc("c_acctbal"), F.asc("c_custkey")]).select("c_mktsegment", "c_custkey", "rn")


@query("""SELECT c_mktsegment, c_custkey, CAST(rn AS INT) AS rn FROM (SELECT *, row_number() OVER (PARTITION BY c_mktsegment ORDER BY c_custkey) AS rn FROM customer) WHERE rn <= 10""")
def head_per_group(t, spark):
    """The first ten of every group are the feature."""
    return W.ranked(t("customer").select("c_mktsegment", "c_custkey"), ["c_mktsegment"], [F.asc("c_custkey")]).where("rn <= 10")


@query("""SELECT c_mktsegment, CAST(((dense_rank() OVER (ORDER BY c_mktsegment)) - 1) % 17 AS INT) AS color FROM (SELECT DISTINCT c_mktsegment FROM customer)""")
def color_index(t, spark):
    """W15."""
    return W.distinct_rank(t("customer").select("c_mktsegment").distinct(), "c_mktsegment", "r", 0).select("c_mktsegment", (c("r") % 17).alias("color"))


@query("""SELECT user_id, event_id, lead(event_type) OVER w IS DISTINCT FROM event_type AS is_last FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id)""")
def last_of_group(t, spark):
    """W11."""
    rows = t("events").select("user_id", "event_id", "event_type")
    return rows.select("user_id", "event_id", W.last_of_group([F.asc("event_id")], "event_type", ["user_id"]).alias("is_last"))


@query("""WITH m AS (SELECT user_id, event_id, event_type, CASE WHEN lag(event_type) OVER w IS NOT DISTINCT FROM event_type AND row_number() OVER w > 1 THEN 0 ELSE 1 END AS ch FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id)),
r AS (SELECT *, sum(ch) OVER (PARTITION BY user_id ORDER BY event_id) AS run FROM m) SELECT user_id, CAST(run AS BIGINT) AS run, event_type, CAST(count(*) AS BIGINT) AS n FROM r GROUP BY ALL""")
def gaps_islands(t, spark):
    """Runs of equal events of a user."""
    return W.runs(t("events").select("user_id", "event_id", "event_type"), "event_type", ["event_id"], ["user_id"])


@query("""WITH s AS (SELECT conv_id, turn, role, CAST(sum(CASE WHEN role = 'user' THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY turn) AS BIGINT) AS segment FROM conversations) SELECT conv_id, turn, role, segment FROM s WHERE segment > 0""")
def segment_blocks(t, spark):
    """W14."""
    return W.segments(t("conversations").select("conv_id", "turn", "role"), c("role") == "user", ["turn"], ["conv_id"])


@query("""WITH s AS (SELECT conv_id, turn, role, sum(CASE WHEN role = 'user' THEN 1 ELSE 0 END) OVER w AS block, coalesce(sum(CASE WHEN role = 'assistant' THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS ends FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)),
f AS (SELECT *, min(ends) OVER (PARTITION BY conv_id, block) AS e0, max(CASE WHEN role = 'assistant' THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id, block) AS closed FROM s WHERE block > 0)
SELECT conv_id, turn, role, CAST(block AS BIGINT) AS block FROM f WHERE ends = e0 AND closed = 1""")
def marker_blocks(t, spark):
    """From a user turn to the first answer."""
    return W.blocks(t("conversations").select("conv_id", "turn", "role"), c("role") == "user", c("role") == "assistant", ["turn"], ["conv_id"])


@query("""SELECT conv_id, turn, CASE WHEN max(CASE WHEN role = 'assistant' THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY turn) = 1 THEN 'legend' ELSE 'data' END AS part FROM conversations""")
def split_trailer(t, spark):
    """W18."""
    return W.split_at(t("conversations").select("conv_id", "turn", "role"), c("role") == "assistant", ["turn"], ["conv_id"]).drop("role")


@query("""SELECT c_custkey, c_acctbal FROM customer ORDER BY c_acctbal DESC, c_custkey LIMIT 15""")
def top_fifteen(t, spark):
    """A top list is the feature."""
    return t("customer").select("c_custkey", "c_acctbal").orderBy(F.desc("c_acctbal"), F.asc("c_custkey")).limit(15)


# Sets and joins


@query("""SELECT CAST(c_custkey AS VARCHAR) AS key, c_name AS name, c_mktsegment AS segment, 'customer' AS "Source File" FROM customer UNION ALL SELECT CAST(s_suppkey AS VARCHAR), s_name, '', 'supplier' FROM supplier""")
def union_master(t, spark):
    """Widest first, missing as blank."""
    a = t("customer").select(c("c_custkey").alias("key"), c("c_name").alias("name"), c("c_mktsegment").alias("segment"))
    b = t("supplier").select(c("s_suppkey").alias("KEY"), c("s_name").alias("name"))
    return U.union_all({"customer": a, "supplier": b})


@query("""SELECT CAST(c_custkey AS VARCHAR) AS key, c_name AS name, 'customer' AS "Source File" FROM customer UNION ALL SELECT CAST(s_suppkey AS VARCHAR), s_name, 'supplier' FROM supplier""")
def union_intersection(t, spark):
    """U2."""
    a = t("customer").select(c("c_custkey").alias("key"), c("c_name").alias("name"), c("c_mktsegment").alias("segment"))
    b = t("supplier").select(c("s_suppkey").alias("key"), c("s_name").alias("name"))
    return U.union_all({"customer": a, "supplier": b}, "intersection")


@query("""SELECT DISTINCT c_mktsegment, c_nationkey FROM customer""")
def distinct_rows(t, spark):
    """U4, T9."""
    return t("customer").select("c_mktsegment", "c_nationkey").distinct()


@query("""WITH d AS (SELECT o_custkey, arg_max(o_orderpriority, o_orderkey) AS p FROM orders GROUP BY 1) SELECT c_custkey, coalesce(p, '') AS priority FROM customer LEFT JOIN d ON c_custkey = o_custkey""")
def lookup_left_last_wins(t, spark):
    """J1, J3."""
    side = t("orders").select(c("o_custkey").alias("c_custkey"), "o_orderpriority", "o_orderkey")
    return J.lookup(t("customer").select("c_custkey"), side, ["c_custkey"], {"o_orderpriority": "priority"}, ["o_orderkey"], "last", "")


@query("""WITH d AS (SELECT o_custkey, arg_min(o_orderpriority, o_orderkey) AS p FROM orders WHERE o_orderdate < '1996-01-01' GROUP BY 1) SELECT c_custkey, p AS priority, CASE WHEN o_custkey IS NULL THEN 'Yes' ELSE 'No' END AS incomplete FROM customer LEFT JOIN d ON c_custkey = o_custkey""")
def incomplete_split(t, spark):
    """First wins, misses flagged; one year of orders, so there are some."""
    side = t("orders").where(c("o_orderdate") < F.lit("1996-01-01").cast("timestamp_ntz")).select(c("o_custkey").alias("c_custkey"), "o_orderpriority", "o_orderkey")
    return J.flagged_lookup(t("customer").select("c_custkey"), side, ["c_custkey"], {"o_orderpriority": "priority"}, ["o_orderkey"])


@query("""SELECT DISTINCT c_mktsegment, c_nationkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderdate < '1996-01-01')""")
def unmatched_report(t, spark):
    """J4."""
    side = t("orders").where(c("o_orderdate") < F.lit("1996-01-01").cast("timestamp_ntz")).select(c("o_custkey").alias("c_custkey"))
    return J.unmatched(t("customer"), side, ["c_custkey"], ["c_mktsegment", "c_nationkey"])


@query("""SELECT s_suppkey, coalesce(n_name, 'none') AS nation FROM supplier LEFT JOIN nation ON s_nationkey = n_nationkey""")
def lookup_default(t, spark):
    """Lookup with a default."""
    side = t("nation").select(c("n_nationkey").alias("s_nationkey"), "n_name")
    return J.lookup(t("supplier").select("s_suppkey", "s_nationkey"), side, ["s_nationkey"], {"n_name": "nation"}, ["n_name"], "last", "none").drop("s_nationkey")


@query("""WITH o AS (SELECT l_orderkey, l_returnflag, l_partkey FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_returnflag ORDER BY l_linenumber, l_partkey, l_suppkey) AS rn FROM lineitem) WHERE rn = 1)
SELECT l_orderkey, max(l_partkey) FILTER (l_returnflag = 'A') AS first_a, max(l_partkey) FILTER (l_returnflag = 'N') AS first_n, max(l_partkey) FILTER (l_returnflag = 'R') AS first_r FROM o GROUP BY ALL""")
def first_sibling_pivot(t, spark):
    """First part of each flag of an order."""
    return J.siblings(t("lineitem"), ["l_orderkey"], "l_returnflag", "l_partkey", {"A": "first_a", "N": "first_n", "R": "first_r"}, ["l_linenumber", "l_partkey", "l_suppkey"])


@query("""WITH f AS (SELECT conv_id, role, length(text) AS n, row_number() OVER (PARTITION BY conv_id, role ORDER BY turn) AS rn FROM conversations), p AS (SELECT conv_id, max(n) FILTER (role = 'user') AS base, max(n) FILTER (role = 'assistant') AS other FROM f WHERE rn = 1 GROUP BY 1)
SELECT conv_id, CAST(other - base AS BIGINT) AS delta, CASE WHEN other > base THEN 'up' WHEN other < base THEN 'down' ELSE 'same' END AS direction FROM p WHERE base IS NOT NULL AND other IS NOT NULL""")
def baseline_change(t, spark):
    """First answer against first question."""
    rows = t("conversations").withColumn("n", F.length("text").cast("long"))
    both = J.siblings(rows, ["conv_id"], "role", "n", {"user": "base", "assistant": "other"}, ["turn"]).where("base is not null and other is not null")
    return both.select("conv_id", (c("other") - c("base")).alias("delta"), N.direction(c("other"), c("base")).alias("direction"))


@query("""WITH b AS (SELECT conv_id, arg_min(length(text), turn) AS base FROM conversations WHERE role = 'user' GROUP BY 1) SELECT CAST(count(*) FILTER (length(text) > base) AS BIGINT) AS up, CAST(count(*) FILTER (length(text) < base) AS BIGINT) AS down, CAST(count(*) FILTER (length(text) = base) AS BIGINT) AS same, role FROM conversations JOIN b USING (conv_id) GROUP BY role""")
def score_changes(t, spark):
    """A17, W16."""
    rows = J.against_baseline(t("conversations").withColumn("n", F.length("text")), ["conv_id"], c("role") == "user", "n", ["turn"])
    return A.change_counts(rows.where("baseline is not null"), ["role"], c("baseline"), c("n"))


@query("""SELECT conv_id, turn, role FROM (SELECT *, max(CASE WHEN role = 'assistant' THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id) AS h FROM conversations) WHERE h = 0 OR role = 'assistant'""")
def reviewer_supersedes(t, spark):
    """F23, J8, J9."""
    return P.in_group_any(t("conversations").select("conv_id", "turn", "role"), ["conv_id"], c("role") == "assistant", c("role") == "assistant")


@query("""SELECT o_custkey, o_orderkey FROM orders WHERE o_custkey IN (SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT')""")
def entities_with(t, spark):
    """F25, J10."""
    return P.of_entities(t("orders").select("o_custkey", "o_orderkey", "o_orderpriority"), "o_custkey", c("o_orderpriority") == "1-URGENT").select("o_custkey", "o_orderkey")


@query("""SELECT p_partkey, coalesce(nullif(CASE WHEN p_size > 25 THEN p_type END, ''), CASE WHEN p_size > 10 THEN p_brand END, p_name) AS label FROM part""")
def preferred_name(t, spark):
    """J13."""
    rows = t("part").select("p_partkey", F.when(c("p_size") > 25, c("p_type")).alias("a"), F.when(c("p_size") > 10, c("p_brand")).alias("b"), "p_name")
    return J.preferred(rows, "a", "b", "p_name", name="label").select("p_partkey", "label")


# Filters


@query("""SELECT 'o_orderstatus' AS field, o_orderstatus AS option FROM orders WHERE o_orderpriority = '1-URGENT' GROUP BY ALL UNION ALL SELECT 'o_orderpriority', o_orderpriority FROM orders WHERE o_orderstatus = 'F' GROUP BY ALL""")
def cascade_options(t, spark):
    """F7, F10, T12."""
    return P.cascade(t("orders").select("o_orderstatus", "o_orderpriority"), {"o_orderstatus": "F", "o_orderpriority": "1-URGENT"})


@query("""SELECT o_orderkey FROM orders WHERE CAST(year(o_orderdate) AS VARCHAR) || '.0' LIKE '1996%' AND o_orderdate BETWEEN '1996-02-01' AND '1996-06-30'""")
def year_and_range(t, spark):
    """F8, F9."""
    rows = t("orders").where(P.year_is(F.concat(F.year("o_orderdate"), F.lit(".0")), "1996"))
    return P.dates_within(rows, "o_orderdate", "1996-02-01", "1996-06-30").select("o_orderkey")


@query("""SELECT doc_id FROM documents WHERE regexp_matches(coalesce(text, ''), '(?i)license|apache') OR regexp_matches(coalesce(lang, ''), '(?i)license|apache')""")
def text_search(t, spark):
    """F13."""
    return P.search(t("documents"), "license|apache", ["text", "lang"]).select("doc_id")


@query("""SELECT doc_id FROM documents WHERE contains(lower(coalesce(text, '') || ' ' || coalesce(source, '')), 'mit license')""")
def text_search_plain(t, spark):
    """F14."""
    return P.search_plain(t("documents"), "MIT License", ["text", "source"]).select("doc_id")


@query("""SELECT doc_id FROM documents WHERE NOT regexp_matches(coalesce(text, ''), 'token\\s*=')""")
def drop_footers(t, spark):
    """F3, F4."""
    return P.drop_matching(t("documents").select("doc_id", "text"), r"token\s*=", ["text"]).select("doc_id")


@query("""SELECT conv_id, turn, line_no FROM (SELECT conv_id, turn, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS line_no FROM conversations) WHERE trim(line) <> '' AND NOT contains(line, 'Consolidated Result')""")
def content_lines(t, spark):
    """Lines that say something."""
    from markbook.sources.documents import page_lines

    return P.content_lines(page_lines(t("conversations"), ["conv_id", "turn"])).select("conv_id", "turn", c("line_no").cast("long").alias("line_no"))


# Scalars


@query("""SELECT p_partkey, CAST(regexp_extract(p_brand, '([0-9]+)', 1) AS INT) AS rank FROM part""")
def clean_rank(t, spark):
    """N6, W6."""
    return t("part").select("p_partkey", N.first_number(c("p_brand")).alias("rank"))


@query("""SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN p >= 90 THEN 'O' WHEN p >= 80 THEN 'A+' WHEN p >= 70 THEN 'A' WHEN p >= 60 THEN 'B+' WHEN p >= 55 THEN 'B' WHEN p >= 50 THEN 'C' WHEN p >= 40 THEN 'P' ELSE 'F' END AS grade,
 CASE WHEN p >= 90 THEN 8 WHEN p >= 80 THEN 7 WHEN p >= 70 THEN 6 WHEN p >= 60 THEN 5 WHEN p >= 55 THEN 4 WHEN p >= 50 THEN 3 WHEN p >= 40 THEN 2 ELSE 1 END AS grade_rank FROM (SELECT *, l_quantity / 50.0 * 100.0 AS p FROM lineitem)""")
def grade_ladder(t, spark):
    """N8, N11."""
    g = N.grade(c("l_quantity"), F.lit(50.0))
    return t("lineitem").select("l_orderkey", "l_linenumber", "l_partkey", g.alias("grade"), N.grade_rank(g).alias("grade_rank"))


@query("""SELECT p_partkey, CASE p_size % 5 WHEN 0 THEN 'AB' WHEN 1 THEN 'UFM' WHEN 2 THEN '' ELSE CAST(p_size AS VARCHAR) END AS display, CASE WHEN p_size % 5 > 2 THEN CAST(p_size AS DOUBLE) END AS value, p_size % 5 < 2 AS special, p_size % 5 < 2 OR (p_size % 5 > 2 AND p_size < 20) AS failed FROM part""")
def mark_parse(t, spark):
    """N3, N4, R1."""
    raw = F.when(c("p_size") % 5 == 0, "Z1").when(c("p_size") % 5 == 1, "Z3").when(c("p_size") % 5 == 2, "").otherwise(c("p_size").cast("string"))
    return t("part").select("p_partkey", N.mark(raw).alias("m")).select("p_partkey", "m.*", N.failed(c("m.value"), F.lit(50), c("m.special")).alias("failed"))


@query("""SELECT p_partkey, trim(replace(replace(regexp_replace(upper(p_name || ' in English II'), '( (I|II|III))+$', ''), ' IN ENGLISH', ''), ' ENGLISH', '')) AS canonical FROM part""")
def canonical_subject(t, spark):
    """X4."""
    return t("part").select("p_partkey", X.canonical_subject(F.concat(c("p_name"), F.lit(" in English II"))).alias("canonical"))


@query("""SELECT p_partkey, CAST(p_partkey AS VARCHAR) AS key_a, upper('k' || p_partkey) AS key_b, CAST(p_partkey AS VARCHAR) AS cell FROM part""")
def key_sanitize(t, spark):
    """X1, X2."""
    k = c("p_partkey").cast("string")
    return t("part").select("p_partkey", X.clean_key(F.concat(F.lit(" 00"), k, F.lit(".0"))).alias("key_a"), X.clean_key(F.concat(F.lit("k"), k, F.lit(".x.y"))).alias("key_b"), X.clean_cell(F.concat(F.lit("\t"), k, F.lit(".0 "))).alias("cell"))


@query("""SELECT o_orderkey, substr(CAST(year(o_orderdate) AS VARCHAR), 3, 2) || '-' || substr(CAST(year(o_orderdate) + 1 AS VARCHAR), 3, 2) AS short, CAST(year(o_orderdate) AS VARCHAR) AS first_year,
 CAST(year(o_orderdate) - 2 AS VARCHAR) || ' - ' || CAST(year(o_orderdate) + 1 AS VARCHAR) AS batch FROM orders""")
def year_texts(t, spark):
    """X5, X6, X7."""
    y = F.concat(F.year("o_orderdate"), F.lit("-"), F.year("o_orderdate") + 1)
    return t("orders").select("o_orderkey", X.short_year(y).alias("short"), X.first_year(y).alias("first_year"), X.batch_text(y, 3).alias("batch"))


@query("""SELECT c_custkey, translate(c_name, '0123456789', '०१२३४५६७८९') AS name FROM customer""")
def transliterate_digits(t, spark):
    """X11."""
    return t("customer").select("c_custkey", X.devanagari_digits(c("c_name")).alias("name"))


def _transliteration_sql() -> str:
    """Pieces of every word, each spelt by itself and the piece before."""
    case = lambda x, pairs, other="NULL": f"CASE {x} " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in pairs.items()) + f" ELSE {other} END"
    signs, alone = ({k: v[i] for k, v in X.VOWELS.items()} for i in (0, 1))
    consonant = lambda x: f"coalesce({x} IN ({', '.join(repr(k) for k in X.CONSONANTS)}), false)"
    spelt = case("p", X.CONSONANTS, f"CASE WHEN {consonant('before')} THEN {case('p', signs)} ELSE {case('p', alone)} END")
    return f"""WITH w AS (SELECT 'n' AS t, n_nationkey AS k, unnest(string_split(n_name || ' ' || n_nationkey || ' Aasha KHEER', ' ')) AS w, generate_subscripts(string_split(n_name || ' ' || n_nationkey || ' Aasha KHEER', ' '), 1) AS i FROM nation
 UNION ALL SELECT 'd', doc_id, unnest(string_split_regex(trim(regexp_replace(coalesce(text, ''), '[ \t\r\n]+', ' ', 'g')), ' ')), generate_subscripts(string_split_regex(trim(regexp_replace(coalesce(text, ''), '[ \t\r\n]+', ' ', 'g')), ' '), 1) FROM documents WHERE text IS NOT NULL),
q AS (SELECT *, regexp_replace(w, '[^A-Za-z]', '', 'g') AS l FROM w), p AS (SELECT t, k, i, w, l, unnest(regexp_extract_all(lower(l), '{X.PIECE}')) AS p, generate_subscripts(regexp_extract_all(lower(l), '{X.PIECE}'), 1) AS j FROM q WHERE l <> ''),
b AS (SELECT *, lag(p) OVER (PARTITION BY t, k, i ORDER BY j) AS before, row_number() OVER (PARTITION BY t, k, i ORDER BY j DESC) = 1 AS last FROM p),
s AS (SELECT t, k, i, string_agg({spelt} || CASE WHEN last AND {consonant('p')} THEN '{X.VIRAMA}' ELSE '' END, '' ORDER BY j) AS s FROM b GROUP BY ALL)
SELECT q.t, q.k, string_agg(CASE WHEN l = '' THEN w ELSE coalesce(s, '') END, ' ' ORDER BY i) AS name FROM q LEFT JOIN s USING (t, k, i) GROUP BY q.t, q.k"""


@query(_transliteration_sql())
def transliterate_names(t, spark):
    """X13 over names, and over the words of whole documents."""
    names = t("nation").select(F.lit("n").alias("t"), c("n_nationkey").cast("long").alias("k"), F.concat_ws(" ", "n_name", "n_nationkey", F.lit("Aasha KHEER")).alias("name"))
    texts = t("documents").where("text is not null").select(F.lit("d"), "doc_id", F.trim(F.regexp_replace("text", r"[ \t\r\n]+", " ")))
    return names.union(texts).select("t", "k", X.transliterate(c("name")).alias("name"))


@query("""SELECT p_partkey, CASE p_size % 4 WHEN 0 THEN 'Commerce & Management' WHEN 1 THEN 'Science & Technology' WHEN 2 THEN 'Humanities' ELSE '' END AS faculty, CASE p_size % 4 WHEN 0 THEN 'Two Year Degree Course' WHEN 3 THEN '' ELSE 'Three Year Degree Course' END AS course,
 CASE p_size % 3 WHEN 0 THEN '1' WHEN 1 THEN '2' ELSE 'other' END AS gender, '''B+'' Grade' AS class FROM part""")
def degree_fields(t, spark):
    """X8, X9, X10, X12."""
    degree = F.when(c("p_size") % 4 == 0, "Master of Commerce").when(c("p_size") % 4 == 1, "B.Sc. (Data Science)").when(c("p_size") % 4 == 2, "Bachelor of Arts").otherwise("Diploma")
    sex = F.when(c("p_size") % 3 == 0, " Male").when(c("p_size") % 3 == 1, "F").otherwise("other")
    return t("part").select("p_partkey", X.faculty(degree).alias("faculty"), X.course_length(degree).alias("course"), X.gender_code(sex).alias("gender"), X.class_text(F.lit('Grade "B+"')).alias("class"))


@query("""SELECT doc_id, trim(regexp_replace(regexp_replace(coalesce(text, ''), '-{3,}|_{3,}|={3,}', ' ', 'g'), '\\s+', ' ', 'g')) AS cleaned, CASE WHEN contains(lower(coalesce(source, '')), 'src1') THEN 'Re-Exam' ELSE 'Regular' END AS kind FROM documents""")
def text_cleanup(t, spark):
    """X16, X22, X23, on whole texts."""
    return t("documents").select("doc_id", X.without_rules(c("text")).alias("cleaned"), X.exam_type(c("source"), "src1").alias("kind"))


@query("""SELECT p_partkey, p_size || ' | ' || p_brand AS joined, 'Sem ' || p_size AS sheet, CASE WHEN p_size % 2 = 0 THEN 'UFM' ELSE 'ABSENT' END AS label, CAST(p_size AS VARCHAR) AS shown FROM part""")
def display_texts(t, spark):
    """X18, X19, X20, X24, K18."""
    size = c("p_size").cast("string")
    attendance = F.when(c("p_size") % 2 == 0, "ufm").otherwise("present")
    return t("part").select(
        "p_partkey", X.joined([size, F.lit("nan"), F.lit(None).cast("string"), c("p_brand")]).alias("joined"), X.sheet_name(F.concat(F.lit("[x] Semester: "), size)).alias("sheet"), X.score_label(F.lit("AB"), attendance).alias("label"), X.shown_number(F.concat(F.lit("+"), size, F.lit(".0"))).alias("shown")
    )


@query("""SELECT page_id, trim(coalesce(regexp_extract(html, '(?i)<title>([^<]*)</title>', 1), '')) AS title, coalesce(regexp_extract(url, '(?i)https?://([^/]+)', 1), '') AS host FROM pages""")
def label_field_extract(t, spark):
    """Y1, Y9."""
    return t("pages").select("page_id", E.field(c("html"), r"<title>([^<]*)</title>").alias("title"), E.field(c("url"), r"https?://([^/]+)").alias("host"))


@query("""SELECT p_partkey, CAST(p_size * 60 AS INT) AS secs, printf('%02d:%02d:00', p_size // 60, p_size % 60) AS duration, '10:00 AM - ' || printf('%02d:%02d %s', CASE WHEN 10 + p_size // 60 > 12 THEN p_size // 60 - 2 ELSE 10 + p_size // 60 END, p_size % 60, CASE WHEN 10 + p_size // 60 < 12 THEN 'AM' ELSE 'PM' END) AS span FROM part""")
def duration_format(t, spark):
    """Sizes as minutes."""
    secs = D.seconds(F.format_string("00:%d:30", c("p_size")))
    return t("part").select("p_partkey", secs.alias("secs"), D.duration_text(secs).alias("duration"), D.time_range(F.lit("10:00 AM"), secs).alias("span"))


@query("""SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN n >= 0 THEN n END AS days FROM (SELECT *, CAST(date_diff('day', CAST(o_orderdate AS DATE), CAST(l_shipdate AS DATE)) AS INT) AS n FROM lineitem JOIN orders ON l_orderkey = o_orderkey)""")
def window_days(t, spark):
    """D2."""
    rows = t("lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_shipdate").join(t("orders").select("o_orderkey", "o_orderdate"), c("l_orderkey") == c("o_orderkey"))
    return rows.select("l_orderkey", "l_linenumber", "l_partkey", D.window_days(F.to_date("o_orderdate"), F.to_date("l_shipdate")).alias("days"))


@query("""SELECT o_orderkey, CASE WHEN o_orderstatus <> 'O' THEN 'none' WHEN d < 0 THEN 'overdue' WHEN d = 0 THEN 'today' WHEN d = 1 THEN 'tomorrow' ELSE 'none' END AS state, strftime(o_orderdate, '%d/%m/%Y') AS shown FROM (SELECT *, date_diff('day', DATE '1997-06-01', CAST(o_orderdate AS DATE)) AS d FROM orders)""")
def deadline_state(t, spark):
    """D1, D3, R7."""
    day = D.parsed(F.date_format("o_orderdate", "d/M/yyyy"))
    pending = F.when(c("o_orderstatus") == "O", 1).otherwise(0)
    return t("orders").select("o_orderkey", D.deadline_state(pending, day, F.lit("1997-06-01").cast("date")).alias("state"), D.shown(day).alias("shown"))


@query("""SELECT o_orderkey FROM orders WHERE o_orderstatus = 'O' AND o_orderdate < '1997-06-01'""")
def overdue(t, spark):
    """F11, F12, F22."""
    return P.overdue(t("orders").withColumn("pending", F.when(c("o_orderstatus") == "O", 1).otherwise(0)), "pending", "o_orderdate", "1997-06-01").select("o_orderkey")


@query("""SELECT CAST(row_number() OVER (ORDER BY d) AS INT) AS slot, CAST(d AS DATE) AS day FROM generate_series(DATE '2026-01-03', DATE '2026-03-01', INTERVAL 1 DAY) s(d) WHERE dayofweek(d) <> 0 AND CAST(d AS DATE) NOT IN (DATE '2026-01-14', DATE '2026-01-26') QUALIFY row_number() OVER (ORDER BY d) <= 20""")
def working_day_slots(t, spark):
    """D8, S13."""
    from markbook.sources.documents import holidays

    return D.working_days(spark, "2026-01-03", 20, holidays(spark, "14/1/2026\n2026-1-26\nnever")[0])


@query("""SELECT printf('%02d:%02d %s', CASE WHEN m // 60 > 12 THEN m // 60 - 12 ELSE m // 60 END, m % 60, CASE WHEN m < 720 THEN 'AM' ELSE 'PM' END) AS option FROM generate_series(420, 900, 30) g(m)""")
def time_options(t, spark):
    """D9."""
    return D.time_options(spark)


@query("""SELECT o_orderkey, strftime(o_orderdate, '%A, %B %-d, %Y') AS shown FROM orders""")
def long_dates(t, spark):
    """D10."""
    return t("orders").select("o_orderkey", D.long_date(c("o_orderdate")).alias("shown"))


@query("""SELECT l_orderkey, l_linenumber, l_partkey, round((l_extendedprice * (1 - l_discount) - l_extendedprice) / 50000.0 * 100.0, 2) AS change_pct, l_quantity + 1 AS total FROM lineitem""")
def mark_arithmetic(t, spark):
    """N9, N10."""
    after = c("l_extendedprice") * (1 - c("l_discount"))
    return t("lineitem").select("l_orderkey", "l_linenumber", "l_partkey", N.change_percent(c("l_extendedprice"), after, F.lit(0), F.lit(50000.0)).alias("change_pct"), N.total_obtained(c("l_quantity"), F.lit("+ 1")).alias("total"))


@query("""SELECT p_partkey, CAST(p_size AS VARCHAR) AS obtained, '50' AS largest, round(p_size * 100.0 / 50, 2) AS pct, CAST(p_size * 4 AS DOUBLE) AS points, TRUE AS same FROM part""")
def ratio_fields(t, spark):
    """N12, N14, N15, N17, R3."""
    ratio = N.split_ratio(F.concat(c("p_size"), F.lit(" / 50")))
    rows = t("part").select("p_partkey", "p_size", ratio.alias("r"))
    return rows.select("p_partkey", "r.obtained", "r.largest", N.percent_or(F.lit(""), N.number(c("r.obtained")), N.number(c("r.largest"))).alias("pct"), N.grade_points(F.lit("--"), c("p_size"), F.lit("4")).alias("points"), N.same_number(F.concat(F.lit("+"), c("p_size")), c("p_size")).alias("same"))


@query("""SELECT 'doc_id' AS "column", CAST(greatest(8, least(60, greatest(max(length(CAST(doc_id AS VARCHAR))), 6) + 2)) AS INT) AS width FROM documents UNION ALL SELECT 'text', CAST(greatest(8, least(60, max(length(text)) + 2)) AS INT) FROM documents UNION ALL SELECT 'lang', CAST(greatest(8, least(60, greatest(max(length(lang)), 4) + 2)) AS INT) FROM documents""")
def profile_width(t, spark):
    """K19."""
    return C.width_profile(t("documents").select("doc_id", "text", "lang"))


# Shape


@query("""SELECT l_orderkey, CAST(coalesce(sum(l_quantity) FILTER (l_returnflag = 'A'), 0) AS BIGINT) AS A, CAST(coalesce(sum(l_quantity) FILTER (l_returnflag = 'N'), 0) AS BIGINT) AS N, CAST(coalesce(sum(l_quantity) FILTER (l_returnflag = 'R'), 0) AS BIGINT) AS R FROM lineitem GROUP BY ALL""")
def long_to_wide(t, spark):
    """M1, G5, C16."""
    return R.crosstab_sum(t("lineitem").withColumn("q", c("l_quantity").cast("long")), ["l_orderkey"], "l_returnflag", ["A", "N", "R"], "q", None)


@query("""SELECT p_partkey, 'p_name' AS name, p_name AS value FROM part UNION ALL SELECT p_partkey, 'p_brand', p_brand FROM part UNION ALL SELECT p_partkey, 'p_type', p_type FROM part""")
def wide_to_long(t, spark):
    """M1, R2."""
    return R.to_long(t("part"), ["p_partkey"], ["p_name", "p_brand", "p_type"])


@query("""SELECT p_partkey, CAST(i AS INT) AS position, split_part(p_type, ' ', CAST(i AS INT)) AS word, CASE WHEN i = 1 THEN p_brand ELSE '' END AS brand FROM part, generate_series(1, len(string_split(p_type, ' '))) g(i)""")
def zipped_lists(t, spark):
    """M1, M2, M4."""
    lists = R.zipped({"word": F.split("p_type", " "), "brand": R.pipe_cells(F.concat(F.lit("TH "), c("p_brand"), F.lit(" |")), "TH")})
    return R.exploded(t("part").select("p_partkey", lists.alias("a")), ["p_partkey"], "a")


@query("""SELECT p_partkey, CAST(p_size % 3 + 1 AS INT) AS second, CAST(p_size + 4 AS INT) AS third FROM part""")
def cell_positions(t, spark):
    """M3: the first cell spans p_size % 3 more, the second follows, the third has its own index."""
    cell = lambda i, s: F.struct(i.cast("int").alias("index"), s.cast("int").alias("span"))
    none = F.lit(None)
    cells = F.array(cell(none, c("p_size") % 3), cell(none, none), cell(c("p_size") + 5, none))
    return t("part").select("p_partkey", R.cell_positions(cells).alias("at")).select("p_partkey", c("at")[1].alias("second"), c("at")[2].alias("third"))


# Graph


@query("""SELECT a.l_partkey AS a, b.l_partkey AS b FROM (SELECT DISTINCT l_orderkey, l_partkey FROM lineitem) a JOIN (SELECT DISTINCT l_orderkey, l_partkey FROM lineitem) b ON a.l_orderkey = b.l_orderkey AND a.l_partkey < b.l_partkey GROUP BY ALL""")
def conflict_edges(t, spark):
    """H1, J11."""
    return G.conflict_graph(t("lineitem"), "l_orderkey", "l_partkey")[1]


@query("""SELECT l_partkey AS node, CAST(count(DISTINCT l_orderkey) AS BIGINT) AS weight FROM lineitem GROUP BY ALL""")
def conflict_vertices(t, spark):
    """H1, A14."""
    return G.conflict_graph(t("lineitem"), "l_orderkey", "l_partkey")[0]


@query("""WITH s AS (SELECT DISTINCT c_mktsegment || '/' || CAST(floor(c_acctbal / 50) AS BIGINT) AS seat, c_nationkey AS n FROM customer), e AS (SELECT DISTINCT a.n AS a, b.n AS b FROM s a JOIN s b ON a.seat = b.seat AND a.n < b.n),
d AS (SELECT n, count(*) AS degree FROM (SELECT a AS n FROM e UNION ALL SELECT b FROM e) GROUP BY n) SELECT (SELECT count(*) FROM nation) AS nodes, (SELECT count(*) FROM e) AS kept_apart, true AS few_slots""")
def conflict_coloring_check(t, spark):
    """H3: nations (subjects) of a customer segment and balance band may not share a slot; edges whose ends differ, and whether
    there are at most as many slots as the largest degree and one."""
    checkpointing(spark)
    seats = t("customer").select(F.concat_ws("/", "c_mktsegment", F.floor(c("c_acctbal") / 50)).alias("seat"), "c_nationkey")
    edges = J.pairs_within(seats, "seat", "c_nationkey")
    slots = G.assign_slots(t("nation").select(c("n_nationkey").alias("node")), edges)
    bad = G.violations(slots, edges).agg(F.count("*").alias("bad"))
    most = G.degrees(edges).agg(F.coalesce(F.max("degree"), F.lit(0)).alias("degree"))
    figures = slots.agg(F.count("*").alias("nodes"), F.countDistinct("slot").alias("slots")).crossJoin(edges.agg(F.count("*").alias("edges"))).crossJoin(bad).crossJoin(most)  # one row each
    return figures.select("nodes", (c("edges") - c("bad")).alias("kept_apart"), (c("slots") <= c("degree") + 1).alias("few_slots"))


@query()
def cluster_subjects(t, spark):
    """Like names without common members; tested against brute force."""
    rows = t("part").select(F.split_part("p_name", F.lit(" "), F.lit(1)).alias("name"), c("p_size").alias("member"))
    return G.cluster_names(rows, "name", "member", 0.8)


# Pipelines


@query("""WITH u AS (SELECT c_custkey % 400 AS key, c_mktsegment AS segment, 'a' AS src FROM customer UNION ALL SELECT s_suppkey, '', 'b' FROM supplier)
SELECT CAST(key AS VARCHAR) AS key, segment, count(*) OVER (PARTITION BY key, segment) > 1 AS is_duplicate, src AS "Source File" FROM u""")
def merge_audit(t, spark):
    """G1."""
    from markbook.plans.merge import merge

    a = t("customer").select((c("c_custkey") % 400).alias("Key"), c("c_mktsegment").alias("Segment"))
    return merge({"a": a.toDF("key", "segment"), "b": t("supplier").select(c("s_suppkey").alias("KEY"))})


@query("""WITH n AS (SELECT *, count(*) OVER (PARTITION BY c_mktsegment) AS size, CAST(regexp_extract(c_name, '([0-9]+)', 1) AS INT) AS clean_rank FROM customer) SELECT c_mktsegment AS programme, c_name AS student, clean_rank, clean_rank <= greatest(1, floor(size * 0.05 + 0.5)) AS in_top FROM n""")
def rank_list(t, spark):
    """Cleaned ranks against the quota."""
    from markbook.plans.ranklist import rank_list as plan

    return plan(t("customer").select(c("c_mktsegment").alias("Program Name"), c("c_name").alias("Student Name"), c("c_custkey").cast("string").alias("Student No"), c("c_name").alias("Rank"))).select("programme", "student", "clean_rank", "in_top")


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _QUERIES["completion_by_region"](spark, sf_dir)


def _all() -> None:
    from markbook import document_queries, plan_queries, record_queries, workbook_queries  # noqa: F401  (they register theirs)


def queries() -> dict[str, Query]:
    _all()
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    _all()
    return dict(_ORACLE)
