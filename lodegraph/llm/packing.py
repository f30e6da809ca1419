"""Best-fit packing with bounds that certify it.

Documents become pieces of at most a sequence's tokens.  Pieces are dealt into
groups of bounded size, and each group is packed by best-fit decreasing.  Dual
feasible functions give a lower bound of each group's sequences: a group that
meets it is certified and lets go of its emptiest sequence only; a group with a
gap lets go of every sequence that isn't full.  What was let go is dealt anew,
by whole sequences, among fewer groups and packed again; a new packing is taken
only if it needs fewer sequences.

Defined results: a null or empty text is one piece, the end token alone; a text
of any length is cut into as many pieces as it takes, its ids held in one task;
repeated rows are pieces of their own, dealt and packed as any others; an empty
table gives no rows; further columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import shared, texts
from .tokens import LETTER, NUMBER, OTHER, SPACE, classes, vocabulary_path

CAPACITY = 4096
VOCABULARY = "word_bpe_49k.json"
END = 1
#: Pieces that one task packs.
GROUP = 50_000
ROUNDS = 4
#: Low bits of a sequence's number that are its own in its group; a group is one
#: Arrow table, which can't be larger.  The group has 32 bits, the round 3.
BIN_BITS = 28
#: Distinct pre-tokens a worker keeps; beyond it the store starts anew.
STORE_ENTRIES = 600_000

#: Code points below this are looked up; others go through the library.
PLAIN = 0x250


@cache
def _library(path: str):
    import os

    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core
    from tokenizers import Tokenizer

    made = Tokenizer.from_file(path)
    made.no_padding()
    made.no_truncation()
    return made


@cache
def _plain(path: str) -> tuple[np.ndarray, np.ndarray]:
    """By code point: its normal form, and whether that is all there is to it."""
    made = _library(path)
    low, ok = np.arange(PLAIN, dtype=np.uint32), np.ones(PLAIN, bool)
    for point in range(PLAIN):
        form = made.normalizer.normalize_str(f"a{chr(point)}a")[1:-1]
        if len(form) == 1 and (ord(form) < PLAIN):
            low[point] = ord(form)
        else:
            ok[point] = False
    return low, ok


class Encoder:
    """Ids of texts, as the library gives them.

    Texts of plain code points are cut into pre-tokens with array operations,
    and the library sees each distinct pre-token once; other texts it gets whole.
    """

    def __init__(self, path: str):
        self.library = _library(path)
        self.low, self.ok = _plain(path)
        self.special = [t.content for t in self.library.get_added_tokens_decoder().values()]
        self._empty()

    def _empty(self):
        self.index = texts.HashIndex(np.zeros(0, np.uint64))
        self.begin, self.size = np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.ids = np.zeros(0, np.uint32)

    def __call__(self, data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all rows in order, and where each row's begin."""
        rows = len(off) - 1
        count = texts.code_points(data, off)
        cut = np.concatenate([[0], np.cumsum(count)])
        whole = data.tobytes().decode()
        point = np.frombuffer(whole.encode("utf-32-le"), "<u4")
        strange = point >= PLAIN
        strange |= ~self.ok[np.minimum(point, PLAIN - 1)]
        total = np.concatenate([[0], np.cumsum(strange)])
        odd = total[cut[1:]] > total[cut[:-1]]
        for mark in self.special:
            at = whole.find(mark)
            while at >= 0:
                odd[np.searchsorted(cut, at, "right") - 1] = True
                at = whole.find(mark, at + 1)
        low = self.low[np.minimum(point, PLAIN - 1)]
        start, end = self._cuts(low, cut)
        row = np.searchsorted(cut, start, "right") - 1
        usual = ~odd[row]
        start, end, row = start[usual], end[usual], row[usual]
        at = self._known(low, start, end)
        size = self.size[at]
        item, place = texts.ragged(size)
        ids = self.ids[self.begin[at][item] + place]
        length = np.bincount(row, weights=size, minlength=rows).astype(np.int64)
        if odd.any():
            extra = np.flatnonzero(odd)
            coded = [np.array(e.ids, np.uint32) for e in self.library.encode_batch([whole[cut[r] : cut[r + 1]] for r in extra], add_special_tokens=False)]
            parts, edge, done = [], np.concatenate([[0], np.cumsum(length)]), 0
            for r, got in zip(extra, coded):
                parts += [ids[done : edge[r]], got]
                done = edge[r]
                length[r] = len(got)
            ids = np.concatenate([*parts, ids[done:]])
        return ids, np.concatenate([[0], np.cumsum(length)])

    @staticmethod
    def _cuts(low: np.ndarray, cut: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        n = len(low)
        if not n:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        kind = classes()[:PLAIN][low]
        start = np.ones(n, bool)
        start[1:] = (kind[1:] != kind[:-1]) | (kind[1:] == NUMBER)
        start[cut[:-1][cut[:-1] < n]] = True
        q = np.flatnonzero((low == 0x27) & start & (kind == OTHER))
        if len(q):
            wide = np.concatenate([low, np.zeros(2, low.dtype)])
            bound = cut[np.searchsorted(cut, q, "right")]
            one, two = wide[q + 1], wide[q + 2]
            short = np.isin(one, list(b"stmd"))
            long = ((one == 0x72) & (two == 0x65)) | ((one == 0x76) & (two == 0x65)) | ((one == 0x6C) & (two == 0x6C))
            size = np.where(short, 2, np.where(long, 3, 0))
            ok = (size > 0) & (q + size <= bound)
            q, size, bound = q[ok], size[ok], bound[ok]
            start[q + 1] = False
            more = q + size < bound
            start[(q + size)[more]] = True
        s = np.flatnonzero(start)
        e = np.append(s[1:], n)
        solid = kind[s] != SPACE
        return s[solid], e[solid]

    def _known(self, low, start, end) -> np.ndarray:
        running = texts.prefix_hash(texts.mix(np.arange(PLAIN, dtype=np.uint64) + np.uint64(77))[low])
        h = texts.span_hash(running, start, end)
        at = self.index.find(h)
        new = np.flatnonzero(at < 0)
        if len(new):
            if len(self.size) > STORE_ENTRIES:
                self._empty()
                new = np.arange(len(h))
            keys, where = np.unique(h[new], return_index=True)
            text = low.astype("<u4").tobytes().decode("utf-32-le")
            words = [text[a:b] for a, b in zip(start[new][where].tolist(), end[new][where].tolist())]
            coded = [e.ids for k in range(0, len(words), 4096) for e in self.library.encode_batch(words[k : k + 4096], add_special_tokens=False)]
            size = np.array([len(c) for c in coded], np.int64)
            begin = len(self.ids) + np.cumsum(size) - size
            self.ids = np.concatenate([self.ids, np.fromiter((i for c in coded for i in c), np.uint32, int(size.sum()))])
            order = np.argsort(both := np.concatenate([self.index.keys, keys]), kind="stable")
            self.index = texts.HashIndex(both[order])
            self.begin, self.size = np.concatenate([self.begin, begin])[order], np.concatenate([self.size, size])[order]
            at = self.index.find(h)
        return at


def pieces(docs: DataFrame, capacity: int = CAPACITY, vocabulary: str = VOCABULARY, end: int = END, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 of every document's pieces."""
    frame = shared.pick(docs, doc_id=doc_id, text=text)
    schema = T.StructType([frame.schema["doc_id"]] + [T.StructField(k, T.IntegerType() if k == "piece" else T.LongType()) for k in ("piece", "start", "length", "ids_crc32")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        path = vocabulary_path(vocabulary)
        encoder = texts.hold(("ids", path), lambda: Encoder(path))  # what it knows serves later tasks
        for batch in batches:
            for part, data, off in texts.blocks(batch, "text"):
                ids, edge = encoder(data, off)
                total = np.diff(edge) + 1
                row, piece = texts.ragged(-(-total // capacity))
                start = piece * capacity
                length = np.minimum(capacity, total[row] - start)
                crc = np.empty(len(row), np.int64)
                last = np.array([end], "<u4").tobytes()
                for k, (r, s, n) in enumerate(zip(row.tolist(), start.tolist(), length.tolist())):
                    low = int(edge[r]) + s
                    code = zlib.crc32(ids[low : min(low + n, int(edge[r + 1]))].astype("<u4", copy=False))
                    crc[k] = zlib.crc32(last, code) if s + n == total[r] else code
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(row)), pa.array(piece, pa.int32()), pa.array(start), pa.array(length), pa.array(crc)], names=schema.names)

    return frame.mapInArrow(run, schema)


def best_fit(lengths: np.ndarray, capacity: int = CAPACITY) -> tuple[np.ndarray, np.ndarray, int]:
    """Bin and offset of each item by best-fit decreasing, and the bins used."""
    order = np.argsort(-lengths, kind="stable")
    bins, offsets = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
    open_: list[list[int]] = [[] for _ in range(capacity + 1)]  # by room left
    rooms, used = 0, 0  # a bit for each room that some bin has
    for k, n in zip(order.tolist(), lengths[order].tolist()):
        fits = rooms >> n
        if fits:
            room = n + (fits & -fits).bit_length() - 1
            bin_ = open_[room].pop()
            if not open_[room]:
                rooms ^= 1 << room
        else:
            room, bin_ = capacity, used
            used += 1
        bins[k], offsets[k] = bin_, capacity - room
        left = room - n
        if left:
            open_[left].append(bin_)
            rooms |= 1 << left
    return bins, offsets, used


def lower_bound(lengths: np.ndarray, capacity: int = CAPACITY) -> int:
    """The largest bound that the dual feasible functions give.

    Items above capacity - t count whole and those below t nothing, for every
    t; and lengths rounded to multiples of capacity / k, for k up to 20.
    """
    if not len(lengths):
        return 0
    count = np.bincount(lengths, minlength=capacity + 1).astype(np.float64)
    size = np.arange(capacity + 1)
    many, weight = np.concatenate([[0], np.cumsum(count)]), np.concatenate([[0], np.cumsum(count * size)])
    t = np.arange(1, capacity // 2 + 1)
    whole = many[-1] - many[capacity - t + 1]
    inside = weight[capacity - t + 1] - weight[t]
    best = max(weight[-1] / capacity, float((whole + inside / capacity).max()))
    for k in range(1, 21):
        scaled = (k + 1) * size
        value = np.where(scaled % capacity == 0, size / capacity, (scaled // capacity) / k)
        best = max(best, float((value * count).sum()))
    return int(np.ceil(best - 1e-9))


def pack(docs: DataFrame, capacity: int = CAPACITY, vocabulary: str = VOCABULARY, end: int = END, group: int = GROUP, rounds: int = ROUNDS, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Every piece with its sequence_id and offset.

    Pieces are written to the shared folder once; each round moves only what
    the round before let go.  A task holds at most about `group` pieces.
    """
    spark = docs.sparkSession
    stage = shared.Stage(spark, "packing")
    # pieces are dealt by a number of their own, so that equal rows part too
    made = stage.write(pieces(docs, capacity, vocabulary, end, doc_id, text).withColumn("row", F.monotonically_increasing_id()))
    count = made.count()
    groups = max(1, -(-count // group))
    state = made.select("*", F.lit(0).cast("long").alias("sequence_id"), F.lit(0).cast("long").alias("offset"), F.lit(True).alias("free"))
    state = state.withColumn("group", F.pmod(F.xxhash64("row"), F.lit(groups)).cast("long"))
    kept = []
    for turn in range(rounds):
        done = stage.write(state.groupBy("group").applyInArrow(_packer(turn, capacity, turn == rounds - 1), state.schema))
        kept.append(done.where("not free"))
        loose = done.where("free")
        found = loose.agg(F.count(F.lit(1)).alias("n"), F.countDistinct("sequence_id").alias("bins"), F.sum("length").alias("tokens")).first()
        if not found["n"] or turn == rounds - 1:
            break
        # nothing to gain: the sequences let go hold too much for one fewer
        if found["bins"] <= -(-found["tokens"] // capacity) or (turn and groups == 1):
            kept.append(loose)
            break
        groups = max(1, min(groups - 1, -(-found["n"] // group)))
        state = loose.withColumn("group", F.pmod(F.xxhash64("sequence_id", F.lit(turn)), F.lit(groups)).cast("long"))
    out = kept[0]
    for more in kept[1:]:
        out = out.unionByName(more)
    return out.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def _packer(turn: int, capacity: int, last: bool):
    def run(table: pa.Table) -> pa.Table:
        get = lambda k: table.column(k).combine_chunks().to_numpy(zero_copy_only=False)
        length = get("length").astype(np.int64)
        bins, offsets, used = best_fit(length, capacity)
        if used > 1 << BIN_BITS:
            raise ValueError(f"a group of {used} sequences; 'group' must be smaller")
        number = (turn << 60) + (int(get("group")[0]) << BIN_BITS) + bins
        if turn:
            held = get("sequence_id")
            names, old = np.unique(held, return_inverse=True)
            if len(names) <= used:  # not better than what was
                bins, offsets, used, number = old, get("offset"), len(names), held
        fill = np.bincount(bins, weights=length, minlength=used)
        free = np.zeros(used, bool)
        if not last:
            if used > lower_bound(length, capacity):
                free = fill < capacity
            else:
                free[fill.argmin()] = fill.min() < capacity
        out = table
        for name, value in (("sequence_id", pa.array(number, pa.int64())), ("offset", pa.array(offsets, pa.int64())), ("free", pa.array(free[bins]))):
            out = out.set_column(out.schema.get_field_index(name), name, value)
        return out

    return run


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(shared.documents(spark, sf_dir))
