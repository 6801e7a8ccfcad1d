"""Conflict graph of nodes that share a member, clustering of like names and slot assignment."""

from __future__ import annotations

from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from markbook.operators.joins import pairs_within
from markbook.session import written


def conflict_graph(df: DataFrame, member: str, node: str) -> tuple[DataFrame, DataFrame]:
    """H1: vertices (node, weight: distinct members) and edges (a, b), a < b."""
    vertices = df.where(F.col(node).isNotNull()).groupBy(node).agg(F.countDistinct(member).alias("weight"))
    return vertices.withColumnRenamed(node, "node"), pairs_within(df, member, node)


def degrees(edges: DataFrame) -> DataFrame:
    """(node, degree)."""
    return edges.select(F.explode(F.array("a", "b")).alias("node")).groupBy("node").agg(F.count("*").alias("degree"))


def similarity(a: str, b: str) -> float:
    """Matching-block ratio of two texts."""
    return SequenceMatcher(None, a, b).ratio()


def greedy_clusters(names: list[str], members: dict[str, set], threshold: float) -> dict[str, str]:
    """Each name, in sorted order, joins the likest representative at ``threshold`` or above that shares no member."""
    out: dict[str, str] = {}
    held: dict[str, set] = {}
    for name in sorted(names):
        own = members.get(name, set())
        likest = max(((similarity(name, r), r) for r, m in held.items() if threshold < 1 and not (m & own)), key=lambda x: x[0], default=(0.0, name))
        home = likest[1] if likest[0] >= threshold and threshold < 1 else name
        out[name] = home
        held[home] = held.get(home, set()) | own
    return out


def cluster_names(df: DataFrame, name: str, member: str, threshold: float) -> DataFrame:
    """H2 as (name, cluster). The kernel's input is one row a distinct name; it is sequential by definition."""
    per_name = df.groupBy(F.col(name).alias("name")).agg(F.collect_set(F.col(member).cast("string")).alias("members"))

    def kernel(pdf: pd.DataFrame) -> pd.DataFrame:
        got = greedy_clusters(list(pdf["name"]), {n: set(m) for n, m in zip(pdf["name"], pdf["members"])}, threshold)
        return pd.DataFrame({"name": list(got), "cluster": list(got.values())})

    return per_name.where("name is not null").groupBy().applyInPandas(kernel, "name string, cluster string")


def color(nodes: list, edges: list[tuple]) -> dict:
    """H3: proper colouring by saturation degree, colours from 1; ties by degree, then by node."""
    near: dict = {n: set() for n in nodes}
    for a, b in edges:
        near[a].add(b)
        near[b].add(a)
    out: dict = {}
    taken: dict = {n: set() for n in nodes}
    left = set(nodes)
    while left:
        n = min(left, key=lambda x: (-len(taken[x]), -len(near[x]), x))
        c = 1
        while c in taken[n]:
            c += 1
        out[n] = c
        left.remove(n)
        for m in near[n] & left:
            taken[m].add(c)
    return out


def label_components(vertices: DataFrame, edges: DataFrame, most_rounds: int = 50) -> DataFrame:
    """(node, component): the smallest node reachable; labels are lowered along edges, and halved to their labels' labels."""
    both = edges.select("a", "b").union(edges.select(F.col("b"), F.col("a")))
    label = vertices.select("node", F.col("node").alias("component"))
    for _ in range(most_rounds):
        low = both.join(label, both.a == label.node).groupBy(F.col("b").alias("n")).agg(F.min("component").alias("low"))
        new = label.join(low, label.node == low.n, "left").select("node", F.least("component", F.coalesce("low", "component")).alias("component"))
        jump = new.select(F.col("node").alias("j"), F.col("component").alias("further"))
        new = new.join(jump, new.component == jump.j).select("node", F.col("further").alias("component")).checkpoint()
        moved = new.join(label.withColumnRenamed("component", "was"), "node").where("component <> was").limit(1).count()
        label = new
        if not moved:
            return label
    raise RuntimeError(f"labels still move after {most_rounds} rounds")


#: Nodes and edges of a component up to which one kernel colours it, by saturation; larger ones are coloured in rounds.
MOST_NODES, MOST_EDGES = 20_000, 1_000_000


def color_rounds(vertices: DataFrame, edges: DataFrame, most_rounds: int = 200) -> DataFrame:
    """H3 as (node, slot) in rounds of joins, for graphs of any size: a proper colouring with one colour more than the largest degree at most.

    In a round every node without a colour picks one of the first that none of its neighbours has, by a hash, among as many
    as it has neighbours that still wait, and one more. Of neighbours that pick the same the first by another hash keeps it.
    """
    both = written(edges.select("a", "b").union(edges.select(F.col("b"), F.col("a"))), "edges")
    state = written(vertices.select("node", F.lit(None).cast("int").alias("slot")), "slots")
    for r in range(most_rounds):
        if not state.where("slot is null").limit(1).count():
            return state
        waits = state.where("slot is null").select(F.col("node").alias("a"))
        met = both.join(waits, "a").join(state.withColumnRenamed("node", "b"), "b")
        near = met.groupBy("a").agg(F.collect_set("slot").alias("taken"), F.sum(F.when(F.col("slot").isNull(), 1).otherwise(0)).cast("int").alias("waiting"))
        free = F.filter(F.sequence(F.lit(1), F.size("taken") + F.col("waiting") + 1), lambda c: ~F.array_contains("taken", c))
        pick = F.get(free, F.pmod(F.xxhash64("a", F.lit(r)), F.col("waiting") + 1).cast("int"))
        picked = written(waits.join(near, "a", "left").select("a", F.coalesce(pick, F.lit(1)).alias("pick")), "picks")
        rank = lambda n: F.struct(F.xxhash64(n, F.lit(-r - 1)), F.col(n))
        other = picked.select(F.col("a").alias("b"), F.col("pick").alias("same"))
        lost = both.join(picked, "a").join(other, "b").where((F.col("pick") == F.col("same")) & (rank("a") > rank("b"))).select("a").distinct()
        kept = picked.join(lost, "a", "left_anti").select(F.col("a").alias("node"), "pick")
        state = written(state.join(kept, "node", "left").select("node", F.coalesce("slot", "pick").alias("slot")), "slots")
    raise RuntimeError(f"nodes without a colour are left after {most_rounds} rounds")


def assign_slots(vertices: DataFrame, edges: DataFrame, most_nodes: int = MOST_NODES, most_edges: int = MOST_EDGES) -> DataFrame:
    """H3 as (node, slot): one kernel for a component of a bounded size, rounds of joins for larger ones; needs a checkpoint folder."""
    comp = label_components(vertices, edges)
    links = edges.join(comp, edges.a == comp.node).select("component", "a", "b")
    many = comp.groupBy("component").agg(F.count("*").alias("n")).where(F.col("n") > most_nodes).select("component")
    many = written(many.union(links.groupBy("component").agg(F.count("*").alias("n")).where(F.col("n") > most_edges).select("component")).distinct(), "large")
    kind = comp.schema["node"].dataType.simpleString()

    def kernel(pdf: pd.DataFrame) -> pd.DataFrame:
        single = pdf["b"].isna()
        cast = type(pdf["a"].iloc[0])
        got = color(list(pdf.loc[single, "a"]), [(a, cast(b)) for a, b in zip(pdf.loc[~single, "a"], pdf.loc[~single, "b"])])
        return pd.DataFrame({"node": list(got), "slot": list(got.values())})

    some = comp.join(many, "component", "left_anti")
    rows = some.select("component", F.col("node").alias("a"), F.lit(None).cast(comp.schema["node"].dataType).alias("b")).union(links.join(many, "component", "left_anti"))
    slots = rows.groupBy("component").applyInPandas(kernel, f"node {kind}, slot int")
    if not many.limit(1).count():
        return slots
    return slots.union(color_rounds(comp.join(many, "component", "left_semi").select("node"), links.join(many, "component", "left_semi").select("a", "b")))


def violations(slots: DataFrame, edges: DataFrame) -> DataFrame:
    """Edges whose ends have the same slot; a proper assignment has none."""
    a, b = slots.select(F.col("node").alias("a"), F.col("slot").alias("sa")), slots.select(F.col("node").alias("b"), F.col("slot").alias("sb"))
    return edges.join(a, "a").join(b, "b").where("sa = sb")


def waterfill(weights: dict[str, float], least: dict[str, float], width: float) -> dict[str, float]:
    """Each column its minimum, the rest by weight; minima are scaled if they exceed the width; the last takes the drift."""
    need = sum(least.values())
    if need >= width:
        out = {k: v * width / need for k, v in least.items()}
    else:
        out, open_, room = dict(least), set(weights), width
        while open_:
            share = sum(weights[k] for k in open_) or 1.0
            small = {k for k in open_ if weights[k] / share * room < least[k]}
            if not small:
                out |= {k: weights[k] / share * room for k in open_}
                break
            room -= sum(least[k] for k in small)
            open_ -= small
    last = list(out)[-1] if out else None
    if last is not None:
        out[last] += width - sum(out.values())
    return out


