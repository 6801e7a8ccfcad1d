"""Mixing sources to target weights by soft membership.

A classifier learned from the labelled table gives every document a posterior over the domains, so it belongs to each in
part. Rates r >= 0 (expected copies of a document) are fitted by projected gradient: with n tokens and posterior p, the
expected tokens of domain d are T_d = sum of r n p_d, and the sum of (T_d - target_d)^2 / T_d(r = 1) is brought down. In
the metric of the documents' tokens the gradient of a document is p . e for a vector e of one number a domain, so a
step needs only the domains' totals: each is one pass over a written table of (n, p), summed on the executors. Rates
are replayed from the list of steps, which every task gets.

Targets give shares; the whole is scaled so that the domain with the largest share keeps its tokens (times ``headroom``),
so mixing repeats documents and drops only those of domains whose share is to fall. Copies are floor(rate + u), with u from a hash.

The classifier is a softmax over hashed words, fitted on at most ``most_labelled`` labelled documents (all, if
there are fewer), picked by the hash of their id.

Defined cases: null text is empty; labels with a null in any column are not used; without labels, posteriors are equal;
repeated rows each get a rate and copies; of several labels of a document all count; a domain without a token keeps its
target unmet; an empty table gives an empty table; other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, LongType, StructField, StructType

from markbook.llm.arrowtools import as_bytes, pieces
from markbook.llm.storage import written

BUCKETS = 1 << 16
MOST_LABELLED = 12_000
TARGETS = {"good": 0.84, "plain": 0.15, "toxic": 0.01}
STEPS, CLOSE, HEADROOM = 60, 1e-3, 1.05


def domain(quality: Column, toxic: Column) -> Column:
    """The domain of a labelled document: toxic, good or plain."""
    return F.when(toxic == 1, "toxic").when(quality == 1, "good").otherwise("plain")


def shape(words: list[bytes], distinct: int) -> list[bytes]:
    """Pseudo-words for the form of a text; they hold a space, as no word does."""
    n = len(words)
    if not n:
        return [b" empty"]
    share = lambda x: b"%d" % int(5 * x / n)
    return [b" size %d" % n.bit_length(), b" new " + share(distinct), b" loud " + share(sum(w.endswith(b"!!") for w in words)), b" bars " + share(words.count(b"|"))]


def buckets(text: bytes) -> tuple[np.ndarray, int]:
    """Distinct hashed features of a text (words, their first five bytes, its form), and its number of words."""
    words = text.lower().split()
    kinds = {w.strip(b".,!|;:?") for w in words}
    crc = zlib.crc32
    stems = {b" " + w[:5] for w in kinds}
    return np.array(sorted({crc(w) % BUCKETS for x in (kinds, stems, shape(words, len(kinds))) for w in x}), np.int32), len(words)


def fit(rows: list[tuple[np.ndarray, int]], n_domains: int, epochs: int = 4, rate: float = 1.0, decay: float = 1e-4) -> np.ndarray:
    """Weights [BUCKETS + 1, domains] of a softmax by Adagrad over ``rows`` (features, domain); the last row is the bias."""
    w, seen = np.zeros((BUCKETS + 1, n_domains)), np.full((BUCKETS + 1, n_domains), 1e-2)
    rng = np.random.default_rng(3)
    for _ in range(epochs):
        for i in rng.permutation(len(rows)):
            x, y = rows[i]
            x = np.append(x, BUCKETS)
            z = w[x].sum(axis=0)
            p = np.exp(z - z.max())
            p /= p.sum()
            p[y] -= 1
            g = p + decay * w[x]
            seen[x] += g * g
            w[x] -= rate * g / np.sqrt(seen[x]) / np.sqrt(len(x))
    return w.astype(np.float32)


def posterior(w: np.ndarray, x: np.ndarray) -> np.ndarray:
    z = w[x].sum(axis=0, dtype=np.float64) + w[BUCKETS]
    p = np.exp(z - z.max())
    return p / p.sum()


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in pieces(batch, 2, 4 << 20):
            x = [buckets(t)[0] for t in as_bytes(part.column(2))]
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(x, pa.list_(pa.int32()))], names=["place", "domain", "x"])


def classifier(docs: DataFrame, labelled: DataFrame, domains: list[str], most_labelled: int = MOST_LABELLED) -> np.ndarray:
    """Softmax weights from ``labelled`` (doc_id, domain)."""
    picked = labelled.where("doc_id is not null and domain is not null").orderBy(F.xxhash64("doc_id"), "doc_id", "domain").limit(most_labelled)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").alias("text"))
    rows = texts.join(F.broadcast(picked.select(F.col("doc_id").cast("long").alias("doc_id"), "domain")), "doc_id")  # at most most_labelled rows
    got = rows.select(F.xxhash64("doc_id").alias("place"), "domain", "text").mapInArrow(_features, "place long, domain string, x array<int>").toArrow()
    order = np.argsort(got.column("place").to_numpy(), kind="stable")
    x = got.column("x").combine_chunks()
    at, flat = x.offsets.to_numpy(), x.values.to_numpy()
    names, place = got.column("domain").to_pylist(), {d: i for i, d in enumerate(domains)}
    return fit([(flat[at[i] : at[i + 1]], place[names[i]]) for i in order if names[i] in place], len(domains))


def _predictor(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = shared.value
        for batch in batches:
            last = batch.num_columns - 1
            for part in pieces(batch, last, 4 << 20):
                got = [buckets(t) for t in as_bytes(part.column(last))]
                p = [posterior(w, x).tolist() for x, _ in got]
                columns = [*part.columns[:-1], pa.array([n for _, n in got], pa.int64()), pa.array(p, pa.list_(pa.float64()))]
                yield pa.RecordBatch.from_arrays(columns, names=[*part.schema.names[:-1], "n_tokens", "p"])

    return run


def memberships(rows: DataFrame, weights: np.ndarray, keep: list[str]) -> DataFrame:
    """``keep``, n_tokens, p (posterior by domain) of every row."""
    shared = rows.sparkSession.sparkContext.broadcast(weights)
    picked = rows.select(*keep, F.col("text").alias("__text"))
    return picked.mapInArrow(_predictor(shared), StructType([*picked.schema[:-1], StructField("n_tokens", LongType()), StructField("p", ArrayType(DoubleType()))]))


def replay(p: np.ndarray, steps: list[np.ndarray]) -> np.ndarray:
    """Rates of documents with posteriors ``p`` after the projected steps."""
    r = np.ones(len(p))
    for s in steps:
        r = np.maximum(0.0, r - p @ s)
    return r


def _posteriors(batch: pa.RecordBatch, at: int, k: int) -> np.ndarray:
    return batch.column(at).flatten().to_numpy(zero_copy_only=False).reshape(-1, k)


def _totals(steps: list[np.ndarray], k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, cross = np.zeros(k), np.zeros((k, k))
        for b in batches:
            n, p = b.column(0).to_numpy().astype(float), _posteriors(b, 1, k)
            total += (replay(p, steps) * n) @ p
            cross += (p * n[:, None]).T @ p
        yield pa.RecordBatch.from_pydict({"v": pa.array([total.tolist() + cross.ravel().tolist()], pa.list_(pa.float64()))})

    return run


def totals(members: DataFrame, steps: list[np.ndarray], k: int) -> tuple[np.ndarray, np.ndarray]:
    """Expected tokens by domain at the rates of ``steps``, and the domains' cross table; summed over tasks by shuffle."""
    per_task = members.select("n_tokens", "p").mapInArrow(_totals(steps, k), "v array<double>")
    sums = per_task.select(F.posexplode("v").alias("i", "x")).groupBy("i").agg(F.sum("x").alias("x")).collect()  # k + k * k numbers
    v = np.zeros(k + k * k)
    for row in sums:
        v[row.i] = row.x
    return v[:k], v[k:].reshape(k, k)


def solve(members: DataFrame, shares: np.ndarray, most_steps: int = STEPS, close: float = CLOSE, headroom: float = HEADROOM) -> list[np.ndarray]:
    """The projected-gradient steps (by domain) that bring the expected totals to the targets."""
    k = len(shares)
    first, cross = totals(members, [], k)
    scale = np.where(first > 0, first, 1.0)
    main = int(shares.argmax())
    target = shares * headroom * first[main] / shares[main]
    root = 1 / np.sqrt(scale)
    top = float(np.linalg.eigvalsh(root[:, None] * cross * root[None, :]).max())
    steps: list[np.ndarray] = []
    if top <= 0:
        return steps
    now = first
    while len(steps) < most_steps and np.abs(now - target).max() > close * target.sum():
        steps.append((now - target) / scale / top)
        now, _ = totals(members, steps, k)
    return steps


def _rater(steps: list[np.ndarray], k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            r = replay(_posteriors(b, b.num_columns - 1, k), steps)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(r, pa.float64())], names=[*b.schema.names, "rate"])

    return run


def rated(members: DataFrame, steps: list[np.ndarray], k: int) -> DataFrame:
    """``members`` with ``rate``; the posterior is its last column."""
    return members.mapInArrow(_rater(steps, k), StructType([*members.schema, StructField("rate", DoubleType())]))


def copies(rate: Column, *seed: Column) -> Column:
    """floor(rate + u), u in [0, 1) from a hash of ``seed``."""
    u = F.shiftrightunsigned(F.xxhash64(F.lit("copies"), *seed), 11) / F.lit(float(1 << 53))
    return F.floor(rate + u).cast("long")


def _domains(labels: DataFrame) -> DataFrame:
    return labels.where("quality is not null and toxic is not null").select(F.col("doc_id").alias("doc_id"), domain(F.col("quality"), F.col("toxic")).alias("domain"))


def _rates(docs: DataFrame, labels: DataFrame, keep: list[str], targets: dict[str, float], **options) -> tuple[DataFrame, list[str]]:
    names = sorted(targets)
    weights = classifier(docs, _domains(labels), names)
    members = written(memberships(docs, weights, keep), "members")
    steps = solve(members, np.array([targets[d] for d in names]) / sum(targets.values()), **options)
    return rated(members, steps, len(names)), names


def mixture(docs: DataFrame, labels: DataFrame, targets: dict[str, float] = TARGETS, **options) -> DataFrame:
    """doc_id, n_tokens, p_<domain>, rate, copies of every row."""
    rates, names = _rates(docs.withColumn("__seed", F.xxhash64("doc_id", "text")), labels, ["doc_id", "__seed"], targets, **options)
    return rates.select("doc_id", "n_tokens", *(F.get("p", F.lit(i)).alias(f"p_{d}") for i, d in enumerate(names)), "rate", copies(F.col("rate"), F.col("__seed")).alias("copies"))


def mixed(docs: DataFrame, labels: DataFrame, targets: dict[str, float] = TARGETS, **options) -> DataFrame:
    """Every document as often as its copies say; the columns of ``docs``."""
    rows = docs.select(F.struct(*(f"`{c}`" for c in docs.columns)).alias("row"), "doc_id", "text")
    rates, _ = _rates(rows, labels, ["row"], targets, **options)
    times = copies(F.col("rate"), F.col("row.doc_id"), F.col("row.text")).cast("int")
    return rates.withColumn("copy", F.explode(F.array_repeat(F.lit(1), times))).select("row.*")
