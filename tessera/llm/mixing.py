"""Mixing documents to target domain weights with soft membership.

Domains come from a labelled table (here low quality, toxic, and clean).  A logistic
regression over hashed words and word shapes, fitted on at most `sample_rows` labelled rows, gives every
document a posterior over the domains.  Nonnegative rates r then minimise

    sum over domains k of (sum over documents of r * tokens * p_k  -  target_k)^2 / current_k

by projected gradient with momentum: each round is one distributed sum over the documents (a few numbers come back),
and r = max(0, r' - step * sum_k p_k * residual_k / current_k) is evaluated where the document is (r' is r and the
momentum).  Rounds go on until the targets are met to 1e-5 or nothing moves any more; running out of rounds is an error.
Rates depend on posteriors alone, so nothing but those sums meets in one place.  The targets are shares; the total
is that at which the largest target keeps all its tokens and `boost` percent more, so that a document whose
posterior is all that domain has a rate over 1 and stays (one with a mixed posterior may have less).  A rate
becomes whole copies: its floor, plus one with the odds of its rest, drawn from a hash of the row.

Defined cases: a null or empty text has no tokens and the intercepts' posterior; label rows with nulls
are not used, contradicting labels of an id count as the worse one, and of several texts of one id the least is
learned from; without labels all domains are
equally likely; repeated rows get equal rates and copies; a domain without mass keeps its target
unmet (least squares); an empty table gives no rows; other columns are left behind unless carried.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .cluster import carried, carried_type, small_batches, written
from .neighbour_quality import _CLASS, held_out
from .text import Words, batches, mix

DOMAINS = ("clean", "low", "toxic")
#: Target shares of the tokens, in the order of DOMAINS.
TARGETS = (0.92, 0.05, 0.03)
BUCKETS = 1 << 16


def domain_of() -> Column:
    return F.when(F.col("quality") == 0, 1).when(F.col("toxic") == 1, 2).when((F.col("quality") == 1) & (F.col("toxic") == 0), 0)


def features(w: Words) -> tuple[np.ndarray, np.ndarray]:
    """(document, bucket) of the distinct words and word shapes of each document."""
    h, doc = w.hashes(), w.doc_of_word().astype(np.int64)
    raw = w.raw
    size = np.minimum(w.ends - w.starts, 12).astype(np.uint64)
    shape = (_CLASS[raw[w.starts]].astype(np.uint64) << np.uint64(16)) | (_CLASS[raw[w.ends - 1]].astype(np.uint64) << np.uint64(8)) | size
    repeat = np.zeros(len(h), np.uint64)
    if len(h) > 1:
        repeat[1:] = (h[1:] == h[:-1]) & (doc[1:] == doc[:-1])
    shape = mix(shape | (repeat << np.uint64(32)) | np.uint64(1 << 40))
    code = np.concatenate([doc * BUCKETS + (x >> np.uint64(48)).astype(np.int64) for x in (h, shape)])
    code = np.unique(code)
    return code // BUCKETS, code % BUCKETS


def fit(docs: DataFrame, labels: DataFrame, sample_rows: int = 8000, n_features: int = 600) -> np.ndarray:
    """Weights of the features: a row for each domain, the intercept in its last column.

    At most `sample_rows` labelled rows are used.  Of the features, those that tell a domain from the rest
    most surely (by standard deviations from their overall share) enter a logistic regression.
    """
    k = len(DOMAINS)
    known = labels.select(F.col("doc_id").try_cast("long").alias("doc_id"), domain_of().alias("domain")).where(F.col("doc_id").isNotNull() & F.col("domain").isNotNull() & ~held_out())
    known = known.groupBy("doc_id").agg(F.max("domain").alias("domain")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_rows)
    texts = docs.select(F.col("doc_id").try_cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).join(F.broadcast(known), "doc_id")
    texts = written(texts.groupBy("doc_id").agg(F.max("domain").alias("domain"), F.min("text").alias("text")).select("domain", "text"), "labelled")

    def count(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, n = np.zeros((k, BUCKETS), np.int64), np.zeros(k, np.int64)
        for batch in batches(stream):
            domain = batch.column(0).to_numpy().astype(np.int64)
            doc, bucket = features(Words(batch.column(1)))
            own += np.bincount(domain[doc] * BUCKETS + bucket, minlength=k * BUCKETS).reshape(k, BUCKETS)
            n += np.bincount(domain, minlength=k)
        for i in range(k):
            some = np.flatnonzero(own[i])
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(some) + 1, i, np.int32)), pa.array(np.append(some, BUCKETS).astype(np.int32)), pa.array(np.append(own[i][some], n[i]))], ["domain", "bucket", "n"])

    # BUCKETS + 1 sums for each domain come back, whatever the sample
    rows = texts.mapInArrow(count, "domain int, bucket int, n long").groupBy("domain", "bucket").agg(F.sum("n").alias("n")).toArrow()
    c = np.zeros((k, BUCKETS + 1))
    c[rows.column("domain").to_numpy(), rows.column("bucket").to_numpy()] = rows.column("n").to_numpy()
    n, c = c[:, -1], c[:, :-1]
    rate = (c.sum(0) + 0.5) / (n.sum() + 1.0)
    z = (c - n[:, None] * rate) / np.sqrt(n[:, None] * rate * (1 - rate) + 0.5)
    chosen = np.unique(np.argsort(-np.abs(z), axis=1, kind="stable")[:, : n_features // k])

    def presence(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches(stream):
            doc, bucket = features(Words(batch.column(1)))
            x = np.zeros((batch.num_rows, len(chosen)), np.uint8)
            at = np.minimum(np.searchsorted(chosen, bucket), len(chosen) - 1)
            same = chosen[at] == bucket
            x[doc[same], at[same]] = 1
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([r.tobytes() for r in np.packbits(x, axis=1)], pa.binary())], ["domain", "x"])

    rows = texts.mapInArrow(presence, "domain int, x binary").orderBy("domain", "x").toArrow()
    weights = np.zeros((k, BUCKETS + 1), np.float32)
    if rows.num_rows:
        x = np.unpackbits(np.frombuffer(b"".join(rows.column("x").to_pylist()), np.uint8).reshape(rows.num_rows, -1), axis=1)[:, : len(chosen)]
        w = logistic(x.astype(np.float32), rows.column("domain").to_numpy(), k)
        weights[:, chosen], weights[:, -1] = w[:, :-1], w[:, -1]
    return weights


def logistic(x: np.ndarray, y: np.ndarray, k: int, rounds: int = 400, ridge: float = 3.0) -> np.ndarray:
    """Multinomial logistic regression by accelerated gradient steps; the intercept is the last column."""
    x = np.concatenate([x, np.ones((len(x), 1), np.float32)], axis=1)
    own = np.eye(k, dtype=np.float32)[y]
    shrink = np.full(x.shape[1], ridge / len(x), np.float32)
    shrink[-1] = 1e-4
    w = ahead = np.zeros((k, x.shape[1]), np.float32)
    probe = np.ones(x.shape[1], np.float32)
    for _ in range(20):  # the largest eigenvalue bounds the step
        probe = x.T @ (x @ probe)
        probe /= np.linalg.norm(probe)
    step = 1 / (0.5 * float(np.linalg.norm(x.T @ (x @ probe))) / len(x) + float(shrink.max()))
    for i in range(rounds):
        p = x @ ahead.T
        p = np.exp(p - p.max(1, keepdims=True))
        p /= p.sum(1, keepdims=True)
        new = ahead - step * ((p - own).T @ x / len(x) + shrink * ahead)
        ahead = new + i / (i + 3) * (new - w)
        w = new
    return w


def posteriors(docs: DataFrame, model: np.ndarray, carry: Sequence[str] = ()) -> DataFrame:
    """doc_id, text, carried, n_tokens (words), p_<domain> for every row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    names = [f"p_{d}" for d in DOMAINS]

    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, prior = shared.value[:, :-1], shared.value[:, -1].astype(np.float64)
        for batch in batches(stream):
            w = Words(batch.column(1))
            doc, bucket = features(w)
            score = np.stack([np.bincount(doc, weights=row[bucket].astype(np.float64), minlength=w.n_docs) for row in weights], axis=1) + prior
            p = np.exp(score - score.max(1, keepdims=True))
            p /= p.sum(1, keepdims=True)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(w.counts.astype(np.int64)), *(pa.array(p[:, i].copy()) for i in range(len(names)))], ["doc_id", "text", "carried", "n_tokens", *names])

    rows = docs.select(F.col("doc_id").try_cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), carried(docs, carry))
    return rows.mapInArrow(run, f"doc_id long, text string, carried {carried_type(docs, carry)}, n_tokens long, " + ", ".join(f"{x} double" for x in names))


def fit_rates(members: DataFrame, targets: Sequence[float], boost: int = 15, rounds: int = 300, tolerance: float = 1e-5) -> tuple[list[list[float]], np.ndarray, np.ndarray]:
    """The steps of all rounds (the rate is their fold), the totals met, and the targets.

    A step is a gradient and a momentum; momentum starts anew where it points uphill.  The descent ends when every
    target is met to `tolerance`, or when a step moves no total any more (then the least squares leave a rest).
    """
    names = [f"p_{d}" for d in DOMAINS]
    k, tokens = len(names), F.col("n_tokens")
    sums = members.agg(*(F.sum(tokens * F.col(x)).alias(x) for x in names), *(F.sum(tokens * F.col(a) * F.col(b)).alias(f"{a}_{b}") for a in names for b in names)).first()
    current = np.array([sums[x] or 0.0 for x in names])
    goal = np.asarray(targets, float) / sum(targets)
    if not current.sum():
        return [], current, current
    some = current > 1e-9 * current.sum()
    goal = goal * (1 + boost / 100) * max(current[some] / goal[some] * (goal[some] == goal[some].max()))
    scale = 1 / np.maximum(current, 1e-9 * current.sum())
    gram = np.array([[sums[f"{a}_{b}"] for b in names] for a in names])
    step = 1 / np.linalg.eigvalsh(np.sqrt(scale)[:, None] * gram * np.sqrt(scale)[None, :]).max()
    one = F.lit(1.0)
    state, base = written(members.select("n_tokens", *names, F.struct(one.alias("rate"), one.alias("ahead")).alias("r")), "rates"), 0
    steps: list[list[float]] = []
    met, ahead, age = current, current, 0
    for _ in range(rounds):
        # the momentum of a step is known only after it, so it is that of the step before
        steps.append([*(float(x) for x in step * (ahead - goal) * scale), 0.0])
        if len(steps) - base > 10:  # keeps the fold short
            state, base = written(state.select("n_tokens", *names, folded(F.col("r"), steps[base:-1]).alias("r")), "rates"), len(steps) - 1
        row = state.select("n_tokens", *names, folded(F.col("r"), steps[base:])["rate"].alias("rate")).agg(*(F.sum(tokens * F.col(x) * F.col("rate")).alias(x) for x in names)).first()
        new = np.array([row[x] for x in names])
        miss = float(np.abs(new[some] / goal[some] - 1).max())
        if miss < tolerance or float((np.abs(new - ahead) * scale)[some].max()) < 1e-9:
            return steps, new, goal
        if ((new - met) * (ahead - goal) * scale).sum() > 0:
            age = 0
        steps[-1][-1] = age / (age + 3)
        ahead, met, age = new + steps[-1][-1] * (new - met), new, age + 1
    raise RuntimeError(f"rates did not meet the targets in {rounds} rounds: {miss} off")


def folded(start: Column, steps: list[list[float]]) -> Column:
    """(rate, ahead) after the given projected steps: rate = max(0, ahead - gradient), then on by the momentum."""
    p = [F.col(f"p_{d}") for d in DOMAINS]

    def turn(r: Column, g: Column) -> Column:
        rate = F.greatest(F.lit(0.0), r["ahead"] - sum((x * g[i] for i, x in enumerate(p)), F.lit(0.0)))
        return F.struct(rate.alias("rate"), (rate + g[len(p)] * (rate - r["rate"])).alias("ahead"))

    return F.aggregate(F.array(*(F.array(*(F.lit(x) for x in g)) for g in steps)), start, turn) if steps else start


def rate_steps(members: DataFrame, steps: list[list[float]]) -> DataFrame:
    """`members` with the final rate, as a fold over the array of steps."""
    one = F.lit(1.0)
    return members.withColumn("rate", folded(F.struct(one.alias("rate"), one.alias("ahead")), steps)["rate"])


def mix_to_targets(docs: DataFrame, labels: DataFrame, targets: Sequence[float] = TARGETS, carry: Sequence[str] = (), sample_rows: int = 8000, boost: int = 15) -> DataFrame:
    """doc_id, text, carried, n_tokens, p_<domain>, rate, copies for every row, and the domains' token totals that were
    aimed at and that the rates expect (`goal`, `met`: the same arrays in every row, in the order of DOMAINS)."""
    small_batches(docs.sparkSession)
    model = fit(docs, labels, sample_rows)
    rows = posteriors(docs, model, carry)
    names = [f"p_{d}" for d in DOMAINS]
    members = written(rows.select("n_tokens", *names), "posteriors")
    gradients, met, goal = fit_rates(members, targets, boost)
    totals = {name: F.array(*(F.lit(float(x)) for x in values)) for name, values in (("goal", goal), ("met", met))}
    chance = F.pmod(F.xxhash64("doc_id", "text"), F.lit(1_000_000)) / 1_000_000
    return rate_steps(rows, gradients).withColumn("copies", F.floor(F.col("rate") + chance).cast("long")).withColumns(totals)
