"""Toxicity: subword-bag embeddings averaged into a linear softmax.

A word is its own vector and those of its character n-grams; a text is the
average over its words, and a linear softmax on that average gives the score.
Embeddings and softmax are trained jointly in numpy on a bounded sample of
labelled rows, by one task of an executor, so that the driver holds the model
and no texts.  A misspelt word still shares most of its n-grams' vectors.

Defined results: null and wordless texts get the score of the bias alone;
without labelled rows every score is the prior 0.5; a text of any length counts
as a whole, alone in its block; repeated rows are scored alone, and learned from
once; an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import sample, shared, texts

BITS = 18
SIZE = 8
LEAST_GRAM, MOST_GRAM = 3, 5
SAMPLE_ROWS = 12_000
SAMPLE_BYTES = 32 << 20
#: Updates at least; a small sample is gone through more often.
STEPS = 800
BATCH = 64
RATE = 0.3
#: Adagrad's sum of squares starts here.
FLOOR = 0.1
#: A bucket met in fewer words of sampled texts than this has no vector: too
#: little to learn from, and it would only let the model remember single texts.
#: 1 gives every bucket one.
LEAST_MET = 5
#: Words whose sums a worker keeps; beyond it the store starts anew.
STORE_ENTRIES = 600_000

#: White space and the punctuation that stands around words.
IS_WORD = texts.IS_PLAIN_WORD.copy()
IS_WORD[list(b".,;:!?()[]{}\"'|")] = False


def words(data: np.ndarray, off: np.ndarray):
    """Lower-cased bytes, starts, ends, hashes, and each row's first word."""
    low = texts.ASCII_LOWER[data]
    start, end = texts.runs(IS_WORD[low], off)
    return low, start, end, texts.span_hash(texts.prefix_hash(texts.table(6)[low]), start, end), texts.per_row(start, off)


def grams(low: np.ndarray, start: np.ndarray, end: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the words' own vectors and character n-grams, with lengths."""
    size = end - start + 2
    word, place = texts.ragged(size)
    padded = np.full(len(word), 0x3C, np.uint8)
    inner = (place > 0) & (place < size[word] - 1)
    padded[inner] = low[(start[word] + place - 1)[inner]]
    padded[place == size[word] - 1] = 0x3E
    lead = np.flatnonzero((padded & 0xC0) != 0x80)
    owner = word[lead]
    edge = np.append(lead, len(padded))
    running = texts.prefix_hash(texts.table(66)[padded])
    found, owners = [h], [np.arange(len(h))]
    for n in range(LEAST_GRAM, MOST_GRAM + 1):
        k = np.arange(max(0, len(lead) - n + 1))
        k = k[owner[k] == owner[k + n - 1]]
        found.append(texts.span_hash(running, edge[k], edge[k + n]))
        owners.append(owner[k])
    buckets = (np.concatenate(found) >> np.uint64(64 - BITS)).astype(np.int32)
    owner = np.concatenate(owners)
    order = np.argsort(owner, kind="stable")
    return buckets[order], np.bincount(owner, minlength=len(h))


def fit(rows: list[tuple[str, int]], epochs: int | None = None, seed: int = 6, steps: int = STEPS, least_met: int = LEAST_MET) -> tuple[np.ndarray, float]:
    """Each bucket's share of the logit, and the bias.

    The logit is the text's average embedding times the difference of the two
    softmax columns, so after training one number a bucket is all that scoring
    needs.  Updates are Adagrad's, over batches of texts, from a
    floor that keeps n-grams of single texts from learning as fast as others.
    """
    if not rows:
        return np.zeros(1 << BITS), 0.0
    epochs = epochs or max(4, -(-steps * BATCH // len(rows)))
    label = np.array([y for _, y in rows], float)
    # texts are taken a few MB at a time; what stays is each text's distinct
    # words with their counts, and each word's n-grams
    known_words, parts = texts.HashIndex(np.zeros(0, np.uint64)), []
    place_of, buckets, sizes = np.zeros(0, np.int64), [], []
    for _, data, off in texts.blocks(pa.record_batch({"t": pa.array([t for t, _ in rows], pa.large_string())}), "t"):
        low, start, end, h, first = words(data, off)
        new = np.flatnonzero(known_words.find(h) < 0)
        keys, where = np.unique(h[new], return_index=True)
        bucket, size = grams(low, start[new][where], end[new][where], keys)
        order = np.argsort(np.concatenate([known_words.keys, keys]), kind="stable")
        place_of = np.concatenate([place_of, len(place_of) + np.arange(len(keys))])[order]
        known_words = texts.HashIndex(np.concatenate([known_words.keys, keys])[order])
        buckets.append(bucket)
        sizes.append(size.astype(np.int32))
        parts.append((place_of[known_words.find(h)].astype(np.int32), np.diff(first)))
    whole = np.concatenate(sizes)
    word = np.concatenate([w for w, _ in parts])
    first = np.concatenate([[0], np.cumsum(np.concatenate([n for _, n in parts]))])
    total = len(whole)
    of = np.zeros(total, np.int64)  # how many texts have each word
    for k in range(len(rows)):
        of[np.unique(word[first[k] : first[k + 1]])] += 1
    met, low = np.zeros(1 << BITS), 0
    for bucket, size in zip(buckets, sizes):
        met += np.bincount(bucket, weights=np.repeat(of[low : low + len(size)], size), minlength=1 << BITS)
        low += len(size)
    known = met >= least_met
    for k, (bucket, size) in enumerate(zip(buckets, sizes)):
        keep = known[bucket]
        sizes[k] = np.bincount(np.repeat(np.arange(len(size)), size)[keep], minlength=len(size)).astype(np.int32)
        buckets[k] = bucket[keep]
    bucket, size = np.concatenate(buckets), np.concatenate(sizes)
    del buckets, sizes, parts, known_words
    begin = np.cumsum(size) - size
    rng = np.random.default_rng(seed)
    table = rng.normal(0, 0.1, (1 << BITS, SIZE)).astype(np.float32)
    column = rng.normal(0, 0.5, SIZE)
    bias = float(np.log((label.sum() + 1) / (len(label) - label.sum() + 1)))
    seen, seen_column, seen_bias = np.full((1 << BITS, SIZE), FLOOR, np.float32), np.full(SIZE, 1.0), 1.0
    for epoch in range(epochs):
        order = rng.permutation(len(rows))
        rate = RATE * (1 - epoch / epochs)
        for k in range(0, len(order), BATCH):
            part = order[k : k + BATCH]
            count = first[part + 1] - first[part]
            text, place = texts.ragged(count)
            w = word[first[part][text] + place]
            n = size[w]
            item, inner = texts.ragged(n)
            b = bucket[begin[w][item] + inner]
            share = (1.0 / (np.maximum(1, count)[text] * whole[w]))[item]  # an average of averages
            owner = text[item]
            value = table @ column.astype(np.float32)  # of each bucket; cheaper than gathering vectors
            logit = np.bincount(owner, weights=value[b] * share, minlength=len(part)) * SCALE + bias
            g = 1 / (1 + np.exp(-np.clip(logit, -35, 35))) - label[part]
            pull = np.bincount(b, weights=g[owner] * share * SCALE, minlength=1 << BITS)
            hit = np.flatnonzero(pull)
            step = np.outer(pull[hit], column).astype(np.float32)
            step_column = table[hit].T @ pull[hit]
            seen[hit] += step * step
            table[hit] -= rate * step / np.sqrt(seen[hit])
            seen_column += step_column**2
            column -= rate * step_column / np.sqrt(seen_column)
            seen_bias += g.sum() ** 2
            bias -= rate * g.sum() / np.sqrt(seen_bias)
    return np.where(known, (table @ column).astype(np.float64) * SCALE, 0.0), bias


#: Averages over hundreds of words are small; the softmax sees them times this.
SCALE = 100.0


class Scorer:
    """Scores blocks; keeps the sums of words it has met."""

    def __init__(self, share: np.ndarray, bias: float):
        self.share, self.bias = share, bias
        self._empty()

    def _empty(self):
        self.index, self.value = texts.HashIndex(np.zeros(0, np.uint64)), np.zeros(0)

    def __call__(self, data: np.ndarray, off: np.ndarray) -> np.ndarray:
        low, start, end, h, first = words(data, off)
        at = self.index.find(h)
        new = np.flatnonzero(at < 0)
        if len(new):
            if len(self.value) > STORE_ENTRIES:
                self._empty()
                new = np.arange(len(h))
            keys, where = np.unique(h[new], return_index=True)
            bucket, size = grams(low, start[new][where], end[new][where], keys)
            begin = np.cumsum(size) - size
            value = np.add.reduceat(self.share[bucket], begin) / size if len(keys) else np.zeros(0)
            keys, self.value = texts.merged(self.index.keys, self.value, keys, value)
            self.index = texts.HashIndex(keys)
            at = self.index.find(h)
        total = np.zeros(len(h) + 1)
        np.cumsum(self.value[at], out=total[1:])
        self.wordless = np.diff(first) == 0
        raw = (total[first[1:]] - total[first[:-1]]) / np.maximum(1, np.diff(first)) + self.bias
        return 1 / (1 + np.exp(-np.clip(raw, -35, 35)))


def learn(rows: DataFrame | None, steps: int = STEPS, least_met: int = LEAST_MET) -> tuple[np.ndarray, float] | None:
    """`fit` of a sample's rows in one task; only the model comes to the driver.
    None if there are no rows."""
    if rows is None:
        return None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        texts.hold("toxicity_fit")
        found = [batch.to_pandas() for batch in batches]
        if found:
            sampled = sample.ordered(pd.concat(found))
            found.clear()
            share, bias = fit(sampled, steps=steps, least_met=least_met)
            del sampled
            texts.release()
            yield pa.RecordBatch.from_arrays([pa.array([share.tobytes()], pa.binary()), pa.array([bias])], names=["share", "bias"])

    got = rows.repartition(1).mapInArrow(run, "share binary, bias double").first()
    return (np.frombuffer(bytes(got["share"])), got["bias"]) if got else None


def score_toxicity(docs: DataFrame, labels: DataFrame, held_out: int | None = 0, modulus: int = 5, sample_rows: int = SAMPLE_ROWS, sample_bytes: int = SAMPLE_BYTES, doc_id: str = "doc_id", text: str = "text", label: str = "toxic", judged: str | None = None, steps: int = STEPS, least_met: int = LEAST_MET) -> DataFrame:
    """The documents' own columns with `toxicity_score` appended, and, under the
    name `judged`, whether a model and a word of the text stand behind it.

    Learns from at most `sample_rows` labelled rows with about `sample_bytes` of
    text, none of the remainder `held_out`; the model is 2 MB whatever the input.
    The sample is gone through four times, or more often until `steps` updates
    are done; n-grams met in fewer than `least_met` words have no vector.
    A column of that name that exists already is replaced.
    """
    fitted = learn(sample.picked(docs, labels, label, held_out, modulus, sample_rows, sample_bytes, doc_id, text), steps, least_met)
    learned = fitted is not None
    model = shared.ship(docs.sparkSession, fitted if learned else fit([]))
    shared.small_batches(docs.sparkSession)
    frame = docs.drop("toxicity_score", *([judged] if judged else []))
    schema = T.StructType([*frame.schema.fields, T.StructField("toxicity_score", T.DoubleType()), *([T.StructField(judged, T.BooleanType())] if judged else [])])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        texts.hold("toxicity")
        scorer = Scorer(*model.value)
        for batch in batches:
            for piece, data, off in texts.blocks(batch, text, texts.STORE_BLOCK_BYTES):
                found = [pa.array(scorer(data, off))]
                if judged:
                    found.append(pa.array(~scorer.wordless & learned))
                yield pa.RecordBatch.from_arrays([*piece.columns, *found], names=schema.names)

    return frame.mapInArrow(run, schema)


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = shared.pick(shared.documents(spark, sf_dir), doc_id="doc_id", text="text")
    scored = score_toxicity(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return scored.select("doc_id", (shared.remainder("doc_id", 5) == 0).alias("held_out"), F.col("toxicity_score").alias("score"), (F.col("toxicity_score") >= 0.5).cast("int").alias("predicted"))
