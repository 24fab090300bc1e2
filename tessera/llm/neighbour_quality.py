"""Quality by nearest-neighbour voting in a latent-semantic space.

A text's terms are its words (hashed to WORDS buckets), the forms of its words (classes of the first and last
byte, and length; hashed to FORMS buckets) and three terms for repetition.  Counts become square roots of shares,
each group of terms weighted by inverse document frequency and brought to length 1, and a truncated singular value
decomposition of a bounded sample of labelled rows gives the latent space.  The sample's latent vectors and labels (at most
`sample_rows` rows of `rank` numbers: a fixed bound) are broadcast; every document's exact cosine to all of
them is computed in blocks, and its `k` nearest labels vote with their similarity as weight.

Defined cases: an empty or null text has no direction and scores the sample's mean label; repeated
rows score alike; a label row with a null is not used, of contradicting labels of one id the
lower counts, and of several texts of one id the least is the sample's; without any labels the score is 0.5; ids,
sources, languages and labels are never terms; other columns are left behind.  Texts are never cut.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .cluster import own_names, small_batches
from .quality_rules import per_doc
from .text import Words, batches, mix, shingles

_CLASS = np.full(256, 6, np.uint8)
_CLASS[0x61:0x7B], _CLASS[0x41:0x5B], _CLASS[0x30:0x3A] = 0, 1, 2
_CLASS[0x80:0xC0] = 7
_CLASS[0x20], _CLASS[0x0A] = 3, 4
_CLASS[[9, 11, 12, 13]] = 5
_MARKS = [*range(0x21, 0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x7F)]
_CLASS[_MARKS] = np.arange(8, 8 + len(_MARKS), dtype=np.uint8)
WORDS, FORMS, REPEATS = 4096, 512, 3
GROUPS = (slice(0, WORDS), slice(WORDS, WORDS + FORMS), slice(WORDS + FORMS, WORDS + FORMS + REPEATS))
TERMS = WORDS + FORMS + REPEATS


def forms(w: Words) -> np.ndarray:
    """A hash of the form of each word."""
    size = np.minimum(w.ends - w.starts, 12).astype(np.uint64)
    return mix((_CLASS[w.raw[w.starts]].astype(np.uint64) << np.uint64(16)) | (_CLASS[w.raw[w.ends - 1]].astype(np.uint64) << np.uint64(8)) | size | np.uint64(1 << 40))


def terms(column: pa.Array) -> np.ndarray:
    """A row of TERMS weights for each text: square roots of shares."""
    w = Words(column)
    docs, h, of = w.n_docs, w.hashes(), w.doc_of_word()
    place = of.astype(np.int64) * TERMS
    out = np.bincount(np.concatenate([place + (h % np.uint64(WORDS)).astype(np.int64), place + WORDS + (forms(w) % np.uint64(FORMS)).astype(np.int64)]), minlength=docs * TERMS).reshape(docs, TERMS).astype(np.float32)
    out /= np.maximum(w.counts, 1)[:, None]
    for j in range(1, REPEATS + 1):  # words that equal the word before, and pairs and triples that equal the one before them
        run = shingles(h, j)
        same = np.zeros(len(h), bool)
        if len(run) > j:
            same[2 * j - 1 : 2 * j - 1 + len(run) - j] = (run[j:] == run[:-j]) & (of[: len(run) - j] == of[2 * j - 1 : 2 * j - 1 + len(run) - j])
        out[:, TERMS - j] = per_doc(same, w.first) / np.maximum(w.counts, 1)
    return np.sqrt(out)


def latent_space(x: np.ndarray, rank: int) -> np.ndarray:
    """The leading right singular vectors of x, by subspace iteration from a fixed start."""
    v = np.random.default_rng(7).standard_normal((x.shape[1], rank + 16)).astype(np.float32)
    for _ in range(12 if len(x) else 0):
        v, _ = np.linalg.qr(x.T @ (x @ v))
    if len(x):
        _, _, turn = np.linalg.svd(x @ v, full_matrices=False)
        v = v @ turn.T
    return np.ascontiguousarray(v[:, :rank])


@dataclass
class Neighbours:
    weights: np.ndarray
    space: np.ndarray
    vectors: np.ndarray
    labels: np.ndarray
    k: int
    block: int = 256

    def weighted(self, x: np.ndarray) -> np.ndarray:
        x = x * self.weights
        for g in GROUPS[:2]:
            x[:, g] /= np.maximum(np.linalg.norm(x[:, g], axis=1, keepdims=True), 1e-6)
        return x

    def project(self, x: np.ndarray) -> np.ndarray:
        v = self.weighted(x) @ self.space
        return v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-12)

    def score(self, x: np.ndarray, empty: np.ndarray) -> np.ndarray:
        mean = float(self.labels.mean()) if len(self.labels) else 0.5
        out = np.full(len(x), mean)
        k = min(self.k, len(self.labels))
        for i in range(0, len(x) if k else 0, self.block):
            cos = self.project(x[i : i + self.block]) @ self.vectors.T
            near = np.argpartition(cos, -k, axis=1)[:, -k:]
            w = np.maximum(np.take_along_axis(cos, near, 1), 1e-6).astype(np.float64)
            out[i : i + self.block] = (w * self.labels[near]).sum(1) / w.sum(1)
        out[empty] = mean
        return np.clip(out, 0.0, 1.0)


def held_out(doc_id: str = "doc_id", folds: int = 5) -> F.Column:
    return F.crc32(F.col(doc_id).cast("string")) % folds == 0


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", sample_rows: int = 4000, rank: int = 64, k: int = 15) -> Neighbours:
    """Fits the space on at most `sample_rows` labelled rows outside the held-out fold."""
    known = labels.select(F.col("doc_id").try_cast("long").alias("doc_id"), F.col(label).cast("int").alias("label")).where(F.col("doc_id").isNotNull() & F.col("label").isNotNull() & ~held_out())
    known = known.groupBy("doc_id").agg(F.min("label").alias("label")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_rows)

    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches(stream):
            for part in (batch.slice(i, 256) for i in range(0, batch.num_rows, 256)):
                x = terms(part.column(2)).astype(np.float16)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array([r.tobytes() for r in x], pa.binary())], ["doc_id", "label", "x"])

    texts = own_names(docs, {"doc_id": "long", "text": "string"}).join(F.broadcast(known), "doc_id").groupBy("doc_id").agg(F.min("label").alias("label"), F.min("text").alias("text"))
    rows = texts.mapInArrow(run, "doc_id long, label int, x binary").orderBy("doc_id").toArrow()
    y = rows.column("label").to_numpy().astype(np.float64)
    x = np.frombuffer(b"".join(rows.column("x").to_pylist()), np.float16).reshape(-1, TERMS).astype(np.float32)
    weights = (1 + np.log((1 + len(x)) / (1 + (x > 0).sum(0)))).astype(np.float32)
    model = Neighbours(weights, np.zeros((TERMS, rank), np.float32), np.zeros((0, rank), np.float32), y, k)
    model.space = latent_space(model.weighted(x), rank)
    model.vectors = model.project(x) if len(x) else model.vectors
    return model


def neighbour_quality(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, **params) -> DataFrame:
    """doc_id, held_out, score (0 to 1), predicted (1 if score >= threshold) for every row."""
    model = small_batches(docs.sparkSession).sparkContext.broadcast(fit(docs, labels, **params))

    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches(stream):
            text = batch.column(1)
            empty = np.array([not x for x in text.to_pylist()], bool)
            score = np.concatenate([model.value.score(terms(part), e) for part, e in ((text.slice(i, 256), empty[i : i + 256]) for i in range(0, len(text), 256))])
            out = [None if i is None else zlib.crc32(str(i).encode()) % 5 == 0 for i in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.bool_()), pa.array(score), pa.array((score >= threshold).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    return own_names(docs, {"doc_id": "long", "text": "string"}).mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")
