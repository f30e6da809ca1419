"""Language identification with interpolated Kneser-Ney character models.

Each language has a model over letters (lower-cased) and word gaps.  The grams
of all languages share sorted hash arrays, one an order, with the languages'
log probabilities side by side; a gram that no language has seen takes the
interpolation weight of its context and goes one order down.  The language of
the lowest cross-entropy a character wins.  A calibrated limit of cross-entropy
a language, found on sampled rows that its model did not see, marks texts that
look like none: their score is lowered.

Defined results: a null text or one without letters is `und` with score 0, as
is every text if nothing can be learned; of equal cross-entropies the first
language in order of name wins; a very long text is judged by all its letters,
alone in its block; repeated rows are judged alone, and learned from once; an
empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import shared, texts

ORDER = 4
SAMPLE_ROWS = 12_000
SAMPLE_BYTES = 8 << 20
#: One sampled row in this many is kept for the limits.
CALIBRATION = 10
#: Share of a language's own rows that may lie beyond its limit.
BEYOND = 0.005
#: Characters that count towards certainty.
CERTAIN = 40
UNKNOWN = "und"
GAP = 0x20


@cache
def _tables() -> tuple[np.ndarray, np.ndarray]:
    """By code point: lower-cased letter, or the gap; and its hash value."""
    lower = np.full(0x110000, GAP, np.uint32)
    for point in range(0x110000):
        c = chr(point)
        if c.isalpha():
            low = c.lower()
            lower[point] = ord(low) if len(low) == 1 else point
    return lower, texts.mix(np.arange(0x110000, dtype=np.uint64) + np.uint64(0x9E3779B97F4A7C15))


def symbols(data: np.ndarray, off: np.ndarray):
    """Symbols of all rows, each after ORDER-1 gaps; rows' lengths; any letter.

    Gaps in a row come singly and never first.
    """
    lower, _ = _tables()
    rows = len(off) - 1
    size = texts.code_points(data, off)
    point = np.frombuffer(data.tobytes().decode().encode("utf-32-le"), "<u4")
    row = np.repeat(np.arange(rows), size)
    symbol = lower[point]
    gap = symbol == GAP
    keep = np.ones(len(symbol), bool)
    if len(symbol):
        keep[1:] = ~(gap[1:] & gap[:-1])
        at = np.cumsum(size) - size
        at = at[size > 0]
        keep[at] = ~gap[at]
    symbol, row = symbol[keep], row[keep]
    # a row that begins with several gaps keeps none of them
    length = np.bincount(row, minlength=rows)
    letters = np.bincount(row, weights=symbol != GAP, minlength=rows) > 0
    out = np.full(len(symbol) + rows * (ORDER - 1), GAP, np.uint32)
    place = np.arange(len(symbol)) + (row + 1) * (ORDER - 1)
    out[place] = symbol
    return out, place, length, letters


def _hashes(out: np.ndarray) -> np.ndarray:
    return texts.prefix_hash(_tables()[1][out])


class Model:
    """The languages' models in shared sorted hash arrays, one an order."""

    def __init__(self, names: list[str], rows: list[tuple[str, int]]):
        self.names = names
        count = len(names)
        # the types of each order with their counts by language, gathered over
        # small blocks so that only types, not positions, stay in memory
        found: list[list[tuple]] = [[] for _ in range(ORDER)]
        sampled = pa.record_batch({"text": pa.array([t for t, _ in rows], pa.large_string()), "lang": pa.array([k for _, k in rows], pa.int64())})
        for part, data, off in texts.blocks(sampled, "text", 1 << 20):
            out, place, length, _ = symbols(data, off)
            tongue = np.repeat(part.column(1).to_numpy(), length)
            running = _hashes(out)
            for n in range(1, ORDER + 1):
                h = texts.span_hash(running, place - n + 1, place + 1)
                keys, first, back = np.unique(h, return_index=True, return_inverse=True)
                end = place[first]
                context = texts.span_hash(running, end - n + 1, end) if n > 1 else np.zeros(len(keys), np.uint64)
                suffix = texts.span_hash(running, end - n + 2, end + 1) if n > 1 else np.zeros(len(keys), np.uint64)
                seen = np.bincount(back * count + tongue, minlength=len(keys) * count).reshape(-1, count)
                found[n - 1].append((keys, seen.astype(np.float32), context, suffix))
        kinds: list[tuple] = []
        for parts in found:
            keys, first, back = np.unique(np.concatenate([p[0] for p in parts]), return_index=True, return_inverse=True)
            counts = np.concatenate([p[1] for p in parts])
            seen = np.stack([np.bincount(back, weights=counts[:, k], minlength=len(keys)) for k in range(count)], axis=1)
            kinds.append((keys, seen, np.concatenate([p[2] for p in parts])[first], np.concatenate([p[3] for p in parts])[first]))
            parts.clear()
        for n in range(ORDER - 1):  # lower orders count the kinds of what stands before
            keys, seen, context, suffix = kinds[n]
            above = kinds[n + 1]
            at = np.searchsorted(keys, above[3])
            new = np.zeros_like(seen)
            for k in range(count):
                new[:, k] = np.bincount(at, weights=above[1][:, k] > 0, minlength=len(keys))
            kinds[n] = (keys, np.where(seen > 0, np.maximum(new, 1), 0), context, suffix)
        self.grams, self.contexts = [], []
        alphabet = len(kinds[0][0]) + 1
        keys, seen, _, _ = kinds[0]
        total = np.maximum(seen.sum(0), 1)
        floor = 1.0 / alphabet
        types = (seen > 0).sum(0)
        p = np.maximum(seen - self._discount(seen), 0) / total + self._discount(seen) * types / total * floor
        p = np.where(total > 1, p, floor)
        self.unseen = np.log(np.where(total > 1, np.maximum(self._discount(seen) * types / total * floor, 1e-12), floor)).astype(np.float32)
        self.grams.append((texts.HashIndex(keys), np.log(np.maximum(p, 1e-12)).astype(np.float32)))
        below = p
        for n in range(1, ORDER):
            keys, seen, context, suffix = kinds[n]
            cut = self._discount(seen)
            heads, back = np.unique(context, return_inverse=True)
            total = np.zeros((len(heads), count))
            kinds_after = np.zeros((len(heads), count))
            for k in range(count):
                total[:, k] = np.bincount(back, weights=seen[:, k], minlength=len(heads))
                kinds_after[:, k] = np.bincount(back, weights=seen[:, k] > 0, minlength=len(heads))
            spare = np.where(total > 0, cut * kinds_after / np.maximum(total, 1), 1.0)
            lower = below[np.searchsorted(kinds[n - 1][0], suffix)]
            p = np.maximum(seen - cut, 0) / np.maximum(total[back], 1) + spare[back] * lower
            self.grams.append((texts.HashIndex(keys), np.log(np.maximum(p, 1e-12)).astype(np.float32)))
            self.contexts.append((texts.HashIndex(heads), np.log(spare).astype(np.float32)))
            below = p
        self.limits = np.full(count, np.inf)

    @staticmethod
    def _discount(seen: np.ndarray) -> np.ndarray:
        once, twice = (seen == 1).sum(0), (seen == 2).sum(0)
        return np.where(once > 0, once / np.maximum(once + 2 * twice, 1), 0.5).clip(0.1, 0.95)

    def entropies(self, data: np.ndarray, off: np.ndarray):
        """Cross-entropy a symbol of each row under each language; symbols; any letter."""
        out, place, length, letters = symbols(data, off)
        running = _hashes(out)
        got = np.zeros((len(place), len(self.names)), np.float32)
        left = np.arange(len(place))
        for n in range(ORDER, 0, -1):
            end = place[left]
            index, value = self.grams[n - 1]
            at = index.find(texts.span_hash(running, end - n + 1, end + 1))
            hit = at >= 0
            got[left[hit]] += value[at[hit]]
            left, end = left[~hit], end[~hit]
            if n > 1 and len(left):
                index, value = self.contexts[n - 2]
                at = index.find(texts.span_hash(running, end - n + 1, end))
                known = at >= 0
                got[left[known]] += value[at[known]]
        got[left] += self.unseen
        edge = np.concatenate([[0], np.cumsum(length)])
        mean = np.zeros((len(length), len(self.names)))
        full = np.flatnonzero(length > 0)
        if len(full):
            mean[full] = np.add.reduceat(got, edge[full], axis=0, dtype=np.float64)
        return -mean / np.maximum(length, 1)[:, None], length, letters

    def calibrate(self, rows: list[tuple[str, int]]) -> None:
        parts = [self.entropies(data, off) for _, data, off in texts.blocks(pa.record_batch({"text": pa.array([t for t, _ in rows], pa.large_string())}), "text", 1 << 20)]
        found, letters = np.concatenate([p[0] for p in parts]), np.concatenate([p[2] for p in parts])
        own = np.array([k for _, k in rows])
        for k in range(len(self.names)):
            mine = found[(own == k) & letters, k]
            if len(mine) >= 20:
                self.limits[k] = np.quantile(mine, 1 - BEYOND) * 1.05

    def predict(self, data: np.ndarray, off: np.ndarray):
        """Language index (-1: none), score, and whether beyond the limit."""
        entropy, length, letters = self.entropies(data, off)
        best = entropy.argmin(1)
        least = entropy[np.arange(len(best)), best]
        weight = np.exp(-(entropy - least[:, None]) * np.minimum(length, CERTAIN)[:, None])
        score = 1 / weight.sum(1)
        limit = self.limits[best]
        beyond = least > limit
        lowered = np.exp(-(least - limit), where=beyond, out=np.ones(len(least)))
        score = np.where(beyond, score * 0.5 * lowered, score)
        return np.where(letters, best, -1), np.where(letters, score, 0.0), beyond & letters


def learn(docs: DataFrame, held_out: int | None, modulus: int, sample_rows: int, sample_bytes: int, doc_id: str, text: str, lang: str) -> Model | None:
    """Fit on a sample of equal bounds a language, picked by a hash of the id.

    Of each language the rows come in the order of the hash until its share of
    the rows or of the bytes is full.  The first row with a letter always
    counts, whatever its size, so that every language has a model; a text is cut
    to its language's share of the bytes, and rows of one id count once.
    """
    spark = docs.sparkSession
    rows = shared.pick(docs, doc_id=doc_id, text=text, lang=lang).where("text is not null and lang is not null")
    if held_out is not None:
        rows = rows.where(shared.remainder("doc_id", modulus) != held_out)
    span = 1 << 40
    rows = rows.withColumn("place", F.pmod(F.xxhash64(F.coalesce(F.col("doc_id").cast("string"), "text"), F.lit(10)), F.lit(span)))
    first = F.min(F.when(F.col("text").rlike(r"\p{L}"), F.col("place")))
    size = F.least(F.octet_length("text"), F.lit(sample_bytes)).cast("long")
    # rows of one id, however many, take one place
    counted = rows.groupBy("lang").agg(F.approx_count_distinct("place").alias("n"), F.avg(size).alias("mean"), first.alias("first")).collect()
    if not counted:
        return None
    share = len(counted)
    most_rows, most_bytes = max(1, sample_rows // share), max(1, sample_bytes // share)
    # twice what should fill a share, or as far as the first row
    quota = [(r["lang"], r["first"], max(r["first"] or 0, int(span * min(1.0, 2 * most_rows / r["n"], 2 * most_bytes / max(1, r["n"] * r["mean"]))))) for r in counted]
    limits = spark.createDataFrame(quota, "lang string, first long, most long")
    cut = F.when(F.octet_length("text") > most_bytes, F.substring("text", F.lit(1), F.ceil(F.char_length("text") * (most_bytes / F.octet_length("text"))).cast("int"))).otherwise(F.col("text"))
    near = rows.join(F.broadcast(limits), "lang").where("place <= most").groupBy("lang", "place", "first").agg(F.min(cut).alias("text"))
    in_turn = Window.partitionBy("lang").orderBy("place").rowsBetween(Window.unboundedPreceding, -1)
    before = near.select("*", F.count(F.lit(1)).over(in_turn).alias("rows"), F.coalesce(F.sum(F.octet_length("text")).over(in_turn), F.lit(0)).alias("bytes"))
    picked = before.where((F.col("place") == F.col("first")) | ((F.col("rows") < most_rows) & (F.col("bytes") < most_bytes)))
    got = picked.select("lang", "place", "text").limit(sample_rows + 2 * share).toPandas().sort_values(["lang", "place", "text"], kind="stable")
    names = sorted(set(got["lang"]))
    if not names:
        return None
    number = {k: i for i, k in enumerate(names)}
    sampled = [(t, number[k]) for t, k in zip(got["text"], got["lang"])]
    # what is a language's only row to learn from isn't set aside
    alone = {k for k, n in got["lang"].value_counts().items() if n < CALIBRATION}
    apart = [len(sampled) >= 20 * CALIBRATION and i % CALIBRATION == 0 and names[x[1]] not in alone for i, x in enumerate(sampled)]
    aside = [x for x, out in zip(sampled, apart) if out]
    model = Model(names, [x for x, out in zip(sampled, apart) if not out])
    if aside:
        model.calibrate(aside)
    return model


def identify(docs: DataFrame, held_out: int | None = 1, modulus: int = 3, sample_rows: int = SAMPLE_ROWS, sample_bytes: int = SAMPLE_BYTES, doc_id: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """One row per document: doc_id, lang_pred, score, beyond.

    Learns from about `sample_rows` rows and `sample_bytes` of text, shared
    equally by the languages; every row is judged, without a shuffle.
    """
    model = shared.ship(docs.sparkSession, learn(docs, held_out, modulus, sample_rows, sample_bytes, doc_id, text, lang))
    frame = shared.pick(docs, doc_id=doc_id, text=text)
    schema = T.StructType([frame.schema["doc_id"], T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("beyond", T.BooleanType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fitted = model.value
        for batch in batches:
            for piece, data, off in texts.blocks(batch, "text"):
                rows = len(off) - 1
                at, score, beyond = fitted.predict(data, off) if fitted else (np.full(rows, -1), np.zeros(rows), np.zeros(rows, bool))
                yield pa.RecordBatch.from_arrays([piece.column(0), pa.array([fitted.names[k] if k >= 0 else UNKNOWN for k in at]), pa.array(score), pa.array(beyond)], names=schema.names)

    return frame.mapInArrow(run, schema)


def op10_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = identify(shared.documents(spark, sf_dir))
    return found.select("doc_id", (shared.remainder("doc_id", 3) == 1).alias("held_out"), "lang_pred", "score", "beyond")
