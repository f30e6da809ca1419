"""Quality classifier: hashed word n-gram logistic regression.

Features are hashed words and pairs of neighbouring words, letter case kept;
weights are learned with follow-the-regularised-leader updates on a bounded
sample of labelled rows, and a text's score is a sparse dot product.

Defined results: null and empty texts get the score of the bias alone; without
labelled rows every score is the prior 0.5; a text of any length counts as a
whole, alone in its block; repeated rows are scored alone, and learned from
once; an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import sample, shared, texts

BITS = 18
SAMPLE_ROWS = 12_000
SAMPLE_BYTES = 48 << 20
EPOCHS = 3
#: The pair of any word with itself, so that repetition is one feature.
AGAIN = np.uint64(0x5EED)
ALPHA, BETA, L1, L2 = 0.5, 1.0, 0.05, 0.5


def features(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashed features of all rows in order, and where each row's begin."""
    start, end = texts.runs(texts.IS_PLAIN_WORD[data], off)
    h = texts.span_hash(texts.prefix_hash(texts.table(8)[data]), start, end)
    first = texts.per_row(start, off)
    pair = np.zeros(len(h), np.uint64)
    pair[1:] = texts.mix(h[:-1] * np.uint64(3) + h[1:])
    pair[1:][h[1:] == h[:-1]] = AGAIN
    opens = np.zeros(len(h), bool)
    opens[first[:-1][first[:-1] < len(h)]] = True
    both = np.empty(2 * len(h), np.int64)
    mask = np.uint64((1 << BITS) - 1)
    both[0::2], both[1::2] = (h & mask).astype(np.int64), (pair & mask).astype(np.int64)
    keep = np.ones(2 * len(h), bool)
    keep[1::2] = ~opens
    place = np.zeros(2 * len(h) + 1, np.int64)
    np.cumsum(keep, out=place[1:])
    return both[keep], place[2 * first]


def fit(rows: list[tuple[str, int]], epochs: int = EPOCHS) -> tuple[np.ndarray, float]:
    """Weights and bias by FTRL-proximal, one text at a time in the given order."""
    z, n = np.zeros(1 << BITS), np.zeros(1 << BITS)
    zb = nb = 0.0
    prepared = []
    for text, label in rows:
        data = np.frombuffer(text.encode(), np.uint8)
        got, _ = features(data, np.array([0, len(data)]))
        at, count = np.unique(got, return_counts=True)
        prepared.append((at, count / np.sqrt(max(1, len(got))), label))
    weight = lambda z, n: np.where(np.abs(z) <= L1, 0.0, -(z - np.sign(z) * L1) / ((BETA + np.sqrt(n)) / ALPHA + L2))
    for _ in range(epochs):
        for at, x, label in prepared:
            w = weight(z[at], n[at])
            b = -zb / ((BETA + np.sqrt(nb)) / ALPHA)
            p = 1 / (1 + np.exp(-np.clip(w @ x + b, -35, 35)))
            g = (p - label) * x
            z[at] += g - (np.sqrt(n[at] + g * g) - np.sqrt(n[at])) / ALPHA * w
            n[at] += g * g
            gb = p - label
            zb += gb - (np.sqrt(nb + gb * gb) - np.sqrt(nb)) / ALPHA * b
            nb += gb * gb
    return weight(z, n), float(-zb / ((BETA + np.sqrt(nb)) / ALPHA))


def scores(data: np.ndarray, off: np.ndarray, weights: np.ndarray, bias: float) -> np.ndarray:
    got, first = features(data, off)
    total = np.zeros(len(got) + 1)
    np.cumsum(weights[got], out=total[1:])
    raw = (total[first[1:]] - total[first[:-1]]) / np.sqrt(np.maximum(1, np.diff(first))) + bias
    return 1 / (1 + np.exp(-np.clip(raw, -35, 35)))


def score_quality(docs: DataFrame, labels: DataFrame, held_out: int | None = 0, modulus: int = 5, sample_rows: int = SAMPLE_ROWS, sample_bytes: int = SAMPLE_BYTES, doc_id: str = "doc_id", text: str = "text", label: str = "quality") -> DataFrame:
    """One row per document: doc_id, score.

    Learns from at most `sample_rows` labelled rows with about `sample_bytes` of
    text, none of the remainder `held_out`; the model is 2 MB whatever the input.
    """
    rows = sample.labelled(docs, labels, label, held_out, modulus, sample_rows, sample_bytes, doc_id, text)
    model = shared.ship(docs.sparkSession, fit(rows))
    frame = shared.pick(docs, doc_id=doc_id, text=text)
    schema = T.StructType([frame.schema["doc_id"], T.StructField("score", T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece, data, off in texts.blocks(batch, "text"):
                yield pa.RecordBatch.from_arrays([piece.column(0), pa.array(scores(data, off, *model.value))], names=["doc_id", "score"])

    return frame.mapInArrow(run, schema)


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = score_quality(shared.documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return scored.select("doc_id", (shared.remainder("doc_id", 5) == 0).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))
