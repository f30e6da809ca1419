"""Document fingerprints: a quartile bucket digest of hashed byte triplets.

Every position gives one triplet, of the bytes at 0, 5 and 11, hashed into one
of 512 buckets.  The digest holds two bits a bucket (which quartile its count
reaches within the document) and the length's logarithm.  Digests are compared
bucket by bucket; past a text's end a byte counts as 0.  The difference is bounded by what two unrelated digests, or
two with no bucket in common, come to, so likeness is from 0 to 1.

Wide triplets tell documents of one language apart, where close ones mostly
count its common syllables.

Defined results: null and empty texts have the digest of the empty text; equal
texts have equal digests and likeness 1; a text of any length is digested whole,
alone in its block; documents are ordered by descending id of any type, null ids
last, equal ids by text; a lone document is its own next; an empty table gives
no rows; further columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import shared, texts

BUCKETS = 512
GAPS = (5, 11)
#: Cost of a bucket whose quartiles differ by 0 to 3.
COST = np.array([0, 1, 2, 6], np.int64)
#: Mean cost of a bucket in unrelated digests.
UNRELATED = 1.625
#: At most this share of BUCKETS is added for lengths that differ.
LENGTH_SHARE = 0.2
LENGTH_STEPS = 16
#: Characters of a text by which rows of one id part into ranges.
TIE_CHARS = 32


def digests(data: np.ndarray, off: np.ndarray) -> np.ndarray:
    """A row of bytes for each text: the quartiles, then the length."""
    rows, last = len(off) - 1, GAPS[1]
    bits = BUCKETS.bit_length() - 1
    counts = np.zeros((rows, BUCKETS), np.int64)
    if len(data):
        row = np.repeat(np.arange(rows, dtype=np.int32), np.diff(off))
        n = len(data)
        beyond = np.full(last, -1, np.int32)
        wide, owner = np.concatenate([data, np.zeros(last, np.uint8)]).astype(np.uint32), np.concatenate([row, beyond])
        h = wide[:n].copy()
        for gap, shift in zip(GAPS, (8, 16)):  # past the end of its text a byte counts as 0
            h |= np.where(owner[gap : gap + n] == row, wide[gap : gap + n], 0) << np.uint32(shift)
        h = h * np.uint32(0x9E3779B1)
        h ^= h >> np.uint32(15)
        h = (h * np.uint32(0x85EBCA77)) >> np.uint32(32 - bits)
        counts = np.bincount(row.astype(np.int64) * BUCKETS + h, minlength=rows * BUCKETS).reshape(rows, BUCKETS)
    quarter = BUCKETS // 4
    ranked = np.sort(counts, axis=1)
    code = sum((counts > ranked[:, k * quarter - 1 : k * quarter]) for k in (1, 2, 3)).astype(np.uint8)
    packed = code[:, 0::4] | code[:, 1::4] << 2 | code[:, 2::4] << 4 | code[:, 3::4] << 6
    size = np.floor(np.log(np.diff(off) + 1.0) / np.log(1.1)).astype(np.uint8)
    return np.concatenate([packed, size[:, None]], axis=1)


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Row by row, from 0 (unrelated) to 1 (equal digests)."""
    spread = lambda d: np.stack([d[:, :-1] >> s & 3 for s in (0, 2, 4, 6)], axis=2).reshape(len(d), -1)
    u, v = spread(a).astype(np.int64), spread(b).astype(np.int64)
    cost = COST[np.abs(u - v)].sum(1)
    worst = COST[np.maximum(u, v)].sum(1)
    step = np.minimum(np.abs(a[:, -1].astype(np.int64) - b[:, -1]), LENGTH_STEPS) / LENGTH_STEPS
    bound = np.minimum(UNRELATED * BUCKETS, worst)
    apart = np.where(bound > 0, np.divide(cost, bound, where=bound > 0, out=np.zeros(len(cost))), 0.0)
    return np.clip(1.0 - apart - LENGTH_SHARE * step / UNRELATED, 0.0, 1.0)


def _digest_texts(values: list[str]) -> np.ndarray:
    found = [digests(data, off) for _, data, off in texts.blocks(pa.record_batch({"t": pa.array(values, pa.large_string())}), "t")]
    return np.concatenate(found) if found else np.zeros((0, BUCKETS // 4 + 1), np.uint8)


def fingerprint(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: doc_id, fingerprint (hex).  Nothing is shuffled."""
    frame = shared.pick(docs, doc_id=doc_id, text=text)
    schema = T.StructType([frame.schema["doc_id"], T.StructField("fingerprint", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece, data, off in texts.blocks(batch, "text"):
                yield pa.RecordBatch.from_arrays([piece.column(0), pa.array([d.tobytes().hex() for d in digests(data, off)])], names=["doc_id", "fingerprint"])

    return frame.mapInArrow(run, schema)


def in_order(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """doc_id, text by ranges of descending id and, of equal ids, ascending text;
    a range is a partition.  Rows of one id (or of none) part by their text's
    beginning, so that no id's rows need to fit in one range."""
    spark = docs.sparkSession
    frame = shared.pick(docs, doc_id=doc_id, text=text)
    n = max(shared.partitions(spark), frame.rdd.getNumPartitions())
    begin = F.substring(F.coalesce("text", F.lit("")), 1, TIE_CHARS)
    dealt = frame.withColumn("begin", begin).repartitionByRange(n, F.col("doc_id").desc_nulls_last(), F.col("begin"))
    return dealt.sortWithinPartitions(F.col("doc_id").desc_nulls_last(), "text").select("doc_id", "text")


_DONE, _HEAD, _TAIL = 0, 1, 2


def compare_edited(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Each document's digest against its edited text's and the next document's.

    The edited text ends with the first third of the next one.  One shuffle, by
    ranges of ids, in any number of partitions.  A range's last document waits
    for the first one of the next range: of each range only these two texts are
    written beside the results, and met in a second step.
    """
    spark = docs.sparkSession
    ordered = in_order(docs, doc_id, text)
    id_field = T.StructField("doc_id", ordered.schema["doc_id"].dataType)
    results = [id_field, T.StructField("n_chars", T.LongType())]
    results += [T.StructField(k, T.StringType()) for k in ("edited_sha256", "fingerprint", "edited_fingerprint")]
    results += [T.StructField(k, T.DoubleType()) for k in ("near_edited", "near_next")]
    names = [f.name for f in results]
    staged = T.StructType([*results, T.StructField("kind", T.IntegerType()), T.StructField("range", T.IntegerType()), T.StructField("text", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        place = TaskContext.get().partitionId()
        held = None  # the last row so far: its next one has not come
        for batch in batches:
            for piece, _, _ in texts.blocks(batch, "text"):
                ids, values = piece.column(0), [x or "" for x in piece.column(1).to_pylist()]
                own = _digest_texts(values)
                if held:
                    ids, values, own = pa.concat_arrays([held[0], ids]), [held[1], *values], np.concatenate([held[2], own])
                else:
                    yield waiting(ids[:1], values[0], _HEAD, place)
                if len(values) > 1:
                    yield with_kind(results_of(ids[:-1], values[:-1], values[1:], own[:-1], own[1:]))
                held = (ids[-1:], values[-1], own[-1:])
        if held:
            yield waiting(held[0], held[1], _TAIL, place)

    def results_of(ids, values, nexts, own, next_own) -> list[pa.Array]:
        edited = [a[: len(a) - len(a) // 3] + b[: len(a) // 3] for a, b in zip(values, nexts)]
        changed = _digest_texts(edited)
        return [
            ids,
            pa.array([len(x) for x in values], pa.int64()),
            pa.array([hashlib.sha256(x.encode()).hexdigest() for x in edited]),
            pa.array([d.tobytes().hex() for d in own]),
            pa.array([d.tobytes().hex() for d in changed]),
            pa.array(likeness(own, changed)),
            pa.array(likeness(own, next_own)),
        ]

    def with_kind(columns: list[pa.Array]) -> pa.RecordBatch:
        n = len(columns[0])
        return pa.RecordBatch.from_arrays([*columns, pa.array([_DONE] * n, pa.int32()), pa.nulls(n, pa.int32()), pa.nulls(n, pa.string())], names=staged.names)

    def waiting(ids: pa.Array, value: str, kind: int, place: int) -> pa.RecordBatch:
        empty = [pa.nulls(1, pa.int64()), *[pa.nulls(1, pa.string())] * 3, *[pa.nulls(1, pa.float64())] * 2]
        return pa.RecordBatch.from_arrays([ids, *empty, pa.array([kind], pa.int32()), pa.array([place], pa.int32()), pa.array([value])], names=staged.names)

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                mine, other = batch.column(1)[k].as_py(), batch.column(2)[k].as_py()
                yield pa.RecordBatch.from_arrays(results_of(batch.column(0)[k : k + 1], [mine], [other], _digest_texts([mine]), _digest_texts([other])), names=names)

    made = shared.Stage(spark, "digests").write(ordered.mapInArrow(run, staged))
    ends = made.where(F.col("kind") != _DONE)
    # ranges that hold a row, in order; two numbers of each go to the driver
    ranges = sorted(r["range"] for r in ends.where(F.col("kind") == _HEAD).select("range").collect())
    follow = spark.createDataFrame(list(zip(ranges, ranges[1:] + ranges[:1])), "range int, next int")
    heads = ends.where(F.col("kind") == _HEAD).select(F.col("range").alias("next"), F.col("text").alias("other"))
    pairs = ends.where(F.col("kind") == _TAIL).select("doc_id", "text", "range").join(follow, "range").join(heads, "next").select("doc_id", "text", "other")
    return made.where(F.col("kind") == _DONE).select(*names).unionByName(pairs.mapInArrow(meet, T.StructType(results)))


def op1_quartile_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compare_edited(shared.documents(spark, sf_dir))
