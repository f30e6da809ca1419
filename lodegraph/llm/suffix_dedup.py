"""Removal of repeated passages by distributed prefix doubling, thinned out.

A byte goes if it is covered by a string of 50 bytes that also starts in a
document with a smaller id.  Plain prefix doubling ranks every position by its
first 1, 2, 4, ... bytes, round after round.  Here a round ranks only positions
that can still matter:

1.  Of each window of 50 bytes one 24-byte string stands for it, that with the
    least hash.  Equal windows have the same, so ranking those strings alone
    (one position in 14) is enough.  A string that no second document has is
    unique, and so are the windows it stands for: they are done.
2.  The others are ranked by the pair of that rank and the rank of all that
    their windows cover, 50 to 76 bytes.  Where the pair is equal, all the
    windows are, and those of all but the first document go.
3.  Where one string has several surroundings, at the borders of repeated
    passages and where texts meet by chance, its windows stay open.  If many do,
    1 and 2 come again for these alone, with strings of 37 bytes.
4.  Windows that are open still are ranked themselves at the full 50 bytes.

How often strings meet by chance grows with the table, and an open window takes
as much of a shuffle as half an anchor; hence strings longer than 16 bytes, of
which most of 10 GB of text are repeated.

Spark deals the rank pairs to buckets, where they are sorted and equal
neighbours share a rank.  Within a task equal pairs are settled first, so a
passage that very many documents hold reaches a bucket once a task.

Texts are dealt out once by row, into a bucketed table that the later rounds
join without moving them again.

Equality is that of hashes: 80 bits and the bucket (of 16 bits at most) for a
pair, 88 and the bucket for a window.  The chance that any two of N differing
strings pass for equal is below N^2 / 2^81 over the number of buckets: 10^-8 for
30 GB in 200 buckets, 10^-3 for 100 TB in 65,536.

Defined results: a null or empty text has nothing to remove; a text of any
length (Spark's limit is 2 GB) is ranked and cut whole, alone in its block, in
some 60 times its size of memory; documents of equal id don't remove from each other; rows of
a null id neither lose bytes nor make others lose them; repeated rows lose alike;
an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import shared, texts

LENGTH = 50
GRAM = 24
#: Of the second round, for windows that are open after the first.
SECOND = 37
#: The second round comes if more than one anchor in so many is open.
SPARSE = 16
#: Anchors a task holds before it deals them out.
HELD_ANCHORS = 800_000
#: Window names a task holds before it deals them out.
HELD_WINDOWS = 800_000
#: Bits of a place within a text; none is longer than 2 GB.
PLACE_BITS = 31


def anchors(data: np.ndarray, off: np.ndarray, length: int = LENGTH, gram: int = GRAM):
    """What stands for the windows of each row, in order of position.

    Returns row, position, first and last start of the windows it stands for,
    the gram's name and the name of all that the windows cover; also the
    running hash of the bytes.
    """
    running = texts.prefix_hash(texts.table(7)[data])
    empty = np.zeros(0, np.int64)
    size = np.diff(off)
    long = np.flatnonzero(size >= length)
    if not len(long):
        return empty, empty, empty, empty, empty.view(np.uint64), empty.view(np.uint64), running
    n = len(data) - gram + 1
    place = np.arange(n)
    h = texts.span_hash(running, place, place + gram)
    bits = np.uint64(PLACE_BITS)
    key = (h >> bits << bits) | place.astype(np.uint64)  # of equal hashes the first
    span = length - gram + 1
    width = 1
    while 2 * width <= span:
        key = np.minimum(key[:-width], key[width:])
        width *= 2
    if width < span:
        key = np.minimum(key[: len(key) - (span - width)], key[span - width :])
    row, start = texts.ragged(size[long] - length + 1)
    row = long[row]
    start = start + off[row]
    least = (key[start] & np.uint64((1 << PLACE_BITS) - 1)).astype(np.int64)
    opens = np.ones(len(start), bool)
    opens[1:] = (least[1:] != least[:-1]) | (row[1:] != row[:-1])
    at = np.flatnonzero(opens)
    low, position, row = start[at], least[at], row[at]
    high = start[np.append(at[1:], len(start)) - 1]
    around = texts.mix(texts.span_hash(running, low, high + length) + (position - low).astype(np.uint64))
    return row, position, low, high, h[position], around, running


def _words(values: np.ndarray) -> tuple[bytes, bytes]:
    """Bits 8 to 47 of the names in five bytes each."""
    return (values >> np.uint64(8)).astype(np.uint32).tobytes(), (values >> np.uint64(40)).astype(np.uint8).tobytes()


def _values(low: bytes, high: bytes) -> np.ndarray:
    return np.frombuffer(low, np.uint32).astype(np.uint64) << np.uint64(8) | np.frombuffer(high, np.uint8).astype(np.uint64) << np.uint64(40)


def _signed(blob) -> np.ndarray:
    return texts.numbers(blob).view(np.int64)


_ANCHORED = "bucket int, low binary, high binary, around_low binary, around_high binary, number binary, rids binary, ids binary, counts binary"
_ANCHOR_NAMES = [x.split()[0] for x in _ANCHORED.split(", ")]


def _blob(*columns) -> pa.RecordBatch:
    names, values = columns[0], columns[1:]
    return pa.RecordBatch.from_arrays([pa.array([v], pa.int32() if isinstance(v, int) else pa.binary()) for v in values], names=names)


def _runs_of(owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First places and lengths of runs of equal values."""
    first = np.flatnonzero(np.append(True, owner[1:] != owner[:-1])) if len(owner) else np.zeros(0, np.int64)
    return first, np.diff(np.append(first, len(owner)))


def _open_only(piece, data: np.ndarray, off: np.ndarray, low: np.ndarray, high: np.ndarray, length: int, gram: int) -> np.ndarray:
    """Which anchors stand for a window that the round of `gram` left open."""
    row, _, first, last, *_ = anchors(data, off, length, gram)
    at = _numbered(piece, "open", row)
    change = np.zeros(len(data) + 2, np.int32)
    change[first[at]] += 1  # no two anchors begin or end at one place
    change[last[at] + 1] -= 1
    before = np.concatenate([[0], np.cumsum(np.cumsum(change) > 0)])
    return before[high + 1] > before[low]


def _deal_anchors(buckets: int, length: int, gram: int, after: int = 0):
    """Rank pairs by bucket; what a smaller document of the task settles goes to
    the bucket below zero of its row instead.  With `after`, the gram of the
    round before, only of windows that it left open."""

    def hand_on(held):
        rid, doc, number, name, around = (np.concatenate([x[k] for x in held]) for k in range(5))
        order = np.lexsort((doc, around, name))
        rid, doc, number, name, around = rid[order], doc[order], number[order], name[order], around[order]
        opens = np.ones(len(name), bool)
        opens[1:] = (name[1:] != name[:-1]) | (around[1:] != around[:-1])
        first = doc[np.flatnonzero(opens)][np.cumsum(opens) - 1]
        settled = doc > first
        where = np.where(settled, -1 - _home(rid, buckets), (name >> np.uint64(48)).astype(np.int64) % buckets)
        order = np.lexsort((number, rid, where))
        rid, doc, number, name, around, where = rid[order], doc[order], number[order], name[order], around[order], where[order]
        first, counts = _runs_of(where)
        for a, n in zip(first.tolist(), counts.tolist()):
            part = slice(a, a + n)
            own, count = _runs_of(rid[part])
            pairs = (b"", b"", b"", b"") if where[a] < 0 else (*_words(name[part]), *_words(around[part]))
            yield _blob(_ANCHOR_NAMES, int(where[a]), *pairs, texts.planes(number[part]), texts.planes(rid[part][own]), texts.planes(doc[part][own]), texts.planes(count))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        texts.hold("suffix")
        held, total = [], 0
        for batch in batches:
            for piece, data, off in texts.blocks(batch, "text"):
                row, _, low, high, name, around, _ = anchors(data, off, length, gram)
                if not len(row):
                    continue
                rid, doc = piece.column("rid").to_numpy(), piece.column("doc_id").to_numpy()
                number = np.arange(len(row)) - np.searchsorted(row, row)
                if after:
                    keep = _open_only(piece, data, off, low, high, length, after)
                    row, number, name, around = row[keep], number[keep], name[keep], around[keep]
                held.append((rid[row], doc[row], number, name, around))
                total += len(row)
                if total > HELD_ANCHORS:
                    yield from hand_on(held)
                    held, total = [], 0
        if total:
            yield from hand_on(held)

    return run


def _home(rid: np.ndarray, buckets: int) -> np.ndarray:
    return (texts.mix(rid.astype(np.uint64)) >> np.uint64(33)).astype(np.int64) % buckets


_SETTLED = "home int, done boolean, rids binary, numbers binary"


def _settled(rid, number, done, buckets):
    """Rows (home, done, rids, numbers) of what was found out."""
    home = _home(rid, buckets) * 2 + done
    order = np.lexsort((number, rid, home))
    rid, number, home = rid[order], number[order], home[order]
    first, counts = _runs_of(home)
    rows = [(int(home[a]) // 2, bool(home[a] % 2), texts.planes(rid[a : a + n]), texts.planes(number[a : a + n])) for a, n in zip(first.tolist(), counts.tolist())]
    columns = list(zip(*rows)) if rows else [()] * 4
    return pa.table([pa.array(columns[0], pa.int32()), pa.array(columns[1], pa.bool_()), pa.array(columns[2], pa.binary()), pa.array(columns[3], pa.binary())], names=["home", "done", "rids", "numbers"])


def _rank(buckets: int):
    """Rank a bucket's pairs: which anchors are covered, and which stay open."""

    def run(table: pa.Table) -> pa.Table:
        column = lambda k: table.column(k).to_pylist()
        rid, doc = [], []
        for r, d, c in zip(column("rids"), column("ids"), column("counts")):
            n = _signed(c)
            rid.append(np.repeat(_signed(r), n))
            doc.append(np.repeat(_signed(d), n))
        rid, doc = np.concatenate(rid), np.concatenate(doc)
        number = np.concatenate([_signed(x) for x in column("number")])
        if column("bucket")[0] < 0:
            return _settled(rid, number, np.ones(len(rid), bool), buckets)
        name = np.concatenate([_values(a, b) for a, b in zip(column("low"), column("high"))])
        around = np.concatenate([_values(a, b) for a, b in zip(column("around_low"), column("around_high"))])
        order = np.argsort(name, kind="stable")  # unique ones leave at once
        ranked = name[order]
        twin = np.zeros(len(ranked), bool)
        twin[1:] = ranked[1:] == ranked[:-1]
        twin[:-1] |= twin[1:]
        order = order[twin]
        rid, doc, number, name, around = rid[order], doc[order], number[order], name[order], around[order]
        order = np.lexsort((doc, around, name))
        rid, doc, number, name, around = rid[order], doc[order], number[order], name[order], around[order]
        opens = np.ones(len(name), bool)
        opens[1:] = name[1:] != name[:-1]
        pair = opens.copy()
        pair[1:] |= around[1:] != around[:-1]
        kind = np.cumsum(opens) - 1
        first = doc[pair][np.cumsum(pair) - 1]  # of the pair, its least document
        covered = doc > first
        if len(name):
            least = np.minimum.reduceat(doc, np.flatnonzero(opens))
            most = np.maximum.reduceat(doc, np.flatnonzero(opens))
            several = np.bincount(kind, weights=pair, minlength=len(least)) > 1
            still = (several & (most > least))[kind] & ~covered
        else:
            still = covered
        keep = covered | still
        return _settled(rid[keep], number[keep], covered[keep], buckets)

    return run


_BY_ROW = "rid long, done binary, open binary"


def _by_row(table: pa.Table) -> pa.Table:
    """One row for each text: its covered and its open numbers."""
    rid, number, done = [], [], []
    for d, r, n in zip(*(table.column(k).to_pylist() for k in ("done", "rids", "numbers"))):
        rid.append(_signed(r))
        number.append(texts.numbers(n).astype(np.uint32))
        done.append(np.full(len(rid[-1]), d))
    rid, number, done = np.concatenate(rid), np.concatenate(number), np.concatenate(done)
    order = np.lexsort((number, rid))
    rid, number, done = rid[order], number[order], done[order]
    first, counts = _runs_of(rid)
    parts = [(number[a : a + n], done[a : a + n]) for a, n in zip(first.tolist(), counts.tolist())]
    return pa.table([pa.array(rid[first]), pa.array([n[d].tobytes() for n, d in parts], pa.binary()), pa.array([n[~d].tobytes() for n, d in parts], pa.binary())], names=["rid", "done", "open"])


_WINDOWED = "bucket int, low binary, high binary, windows_low binary, windows_high binary, starts binary, counts binary, rids binary, ids binary"
_WINDOW_NAMES = [x.split()[0] for x in _WINDOWED.split(", ")]


def _numbered(piece, column: str, row: np.ndarray) -> np.ndarray:
    """Places in the block's anchors of the numbers that a column lists by row."""
    lists = [np.frombuffer(x or b"", np.uint32) for x in piece.column(column).to_pylist()]
    if not lists:
        return np.zeros(0, np.int64)
    begin = np.searchsorted(row, np.arange(len(lists)))
    return np.concatenate([x.astype(np.int64) + b for x, b in zip(lists, begin)])


def _deal_windows(buckets: int, length: int, gram: int):
    """The names of open anchors' windows, dealt by what stands for them, so that
    an anchor's windows stay together: its first start tells the others'.  Of
    equal windows of a task only the smallest document's are dealt; the others go
    to the bucket below zero of their row."""

    def hand_on(held):
        name, start, count, rid, doc = (np.concatenate([x[k] for x in held]) for k in range(5))
        windows = np.concatenate([x[5] for x in held]) & np.uint64((1 << 48) - 1)
        # what a smaller document of the task settles need not be dealt
        item, place = texts.ragged(count)
        order = np.lexsort((doc[item], windows, name[item]))
        stand, window, owner = name[item][order], windows[order], doc[item][order]
        opens = np.ones(len(order), bool)
        opens[1:] = (stand[1:] != stand[:-1]) | (window[1:] != window[:-1])
        settled = np.zeros(len(order), bool)
        settled[order] = owner > owner[np.flatnonzero(opens)][np.cumsum(opens) - 1]
        del order, stand, window, owner, opens
        # both kinds as runs of neighbouring starts of one anchor
        begins = np.ones(len(item), bool)
        begins[1:] = (item[1:] != item[:-1]) | (settled[1:] != settled[:-1])
        first = np.flatnonzero(begins)
        count = np.diff(np.append(first, len(item)))
        of, told = item[first], settled[first]
        start, name, rid, doc = start[of] + place[first], name[of], rid[of], doc[of]
        where = np.where(told, -1 - _home(rid, buckets), (name >> np.uint64(48)).astype(np.int64) % buckets)
        order = np.argsort(where, kind="stable")
        for a, n in zip(*(x.tolist() for x in _runs_of(where[order]))):
            part = order[a : a + n]
            known = texts.planes(start[part]), texts.planes(count[part]), texts.planes(rid[part])
            if told[part[0]]:
                yield _blob(_WINDOW_NAMES, int(where[part[0]]), b"", b"", b"", b"", *known, b"")
                continue
            inner, place_ = texts.ragged(count[part])
            mine = windows[first[part][inner] + place_]
            pairs = (mine.astype(np.uint32).tobytes(), (mine >> np.uint64(32)).astype(np.uint16).tobytes())
            yield _blob(_WINDOW_NAMES, int(where[part[0]]), *_words(name[part]), *pairs, *known, texts.planes(doc[part]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        texts.hold("suffix")
        held, total = [], 0
        for batch in batches:
            for piece, data, off in texts.blocks(batch, "text"):
                row, _, low, high, name, _, running = anchors(data, off, length, gram)
                at = _numbered(piece, "open", row)
                if not len(at):
                    continue
                count = (high - low + 1)[at]
                item, place = texts.ragged(count)
                start = low[at][item] + place
                own = row[at]
                rid, doc = piece.column("rid").to_numpy(), piece.column("doc_id").to_numpy()
                held.append((name[at], low[at] - off[own], count, rid[own], doc[own], texts.span_hash(running, start, start + length)))
                total += len(item)
                if total > HELD_WINDOWS:
                    yield from hand_on(held)
                    held, total = [], 0
        if total:
            yield from hand_on(held)

    return run


def _rank_windows(buckets: int):
    """Windows are equal if their names are, of 48 bits, and what stands for them
    is, of 40 bits; those of smaller documents win."""

    def run(table: pa.Table) -> pa.Table:
        column = lambda k: table.column(k).to_pylist()
        join = lambda k, f: np.concatenate([f(x) for x in column(k)])
        count = join("counts", _signed)
        item, place = texts.ragged(count)
        start = join("starts", _signed)[item] + place
        rid = join("rids", _signed)[item]
        if column("bucket")[0] < 0:
            return _settled(rid, start, np.ones(len(rid), bool), buckets)
        doc = join("ids", _signed)[item]
        stand = np.concatenate([_values(a, b) for a, b in zip(column("low"), column("high"))])[item]
        name = join("windows_low", lambda x: np.frombuffer(x, np.uint32)).astype(np.uint64)
        name |= join("windows_high", lambda x: np.frombuffer(x, np.uint16)).astype(np.uint64) << np.uint64(32)
        order = np.lexsort((doc, name, stand))
        opens = np.ones(len(order), bool)
        opens[1:] = (name[order][1:] != name[order][:-1]) | (stand[order][1:] != stand[order][:-1])
        least = np.empty(len(order), np.int64)
        least[order] = doc[order][np.flatnonzero(opens)][np.cumsum(opens) - 1]
        covered = doc > least
        return _settled(rid[covered], start[covered], np.ones(int(covered.sum()), bool), buckets)

    return run


def _cut(length: int, grams: dict[str, int], decode: bool, schema_names):
    """`grams`: by column of covered numbers, the gram of its round."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece, data, off in texts.blocks(batch, "text"):
                change = np.zeros(len(data) + 1, np.int32)
                for column, gram in grams.items():
                    if piece.column(column).null_count < len(piece):
                        row, _, low, high, *_ = anchors(data, off, length, gram)
                        at = _numbered(piece, column, row)
                        np.add.at(change, low[at], 1)
                        np.add.at(change, high[at] + length, -1)
                if piece.column("starts").null_count < len(piece):
                    lists = [np.frombuffer(x or b"", np.uint32).astype(np.int64) for x in piece.column("starts").to_pylist()]
                    more = np.concatenate([x + o for x, o in zip(lists, off)])
                    np.add.at(change, more, 1)
                    np.add.at(change, more + length, -1)
                gone = np.cumsum(change[:-1]) > 0
                kept = data[~gone]
                left = np.concatenate([[0], np.cumsum(~gone)])[off]
                start, end = texts.runs(gone, off)
                edge = texts.per_row(start, off)
                spans = [[{"start": int(a - off[r]), "end": int(b - off[r])} for a, b in zip(start[edge[r] : edge[r + 1]], end[edge[r] : edge[r + 1]])] for r in range(len(off) - 1)]
                rows = [kept[left[r] : left[r + 1]].tobytes() for r in range(len(off) - 1)]
                size = np.diff(off)
                cleaned = pa.nulls(len(rows), pa.string())
                if decode:
                    lost = np.diff(left) < size
                    cleaned = pa.array([k.decode("utf-8", "ignore") if x else None for k, x in zip(rows, lost.tolist())], pa.string())
                    cleaned = pc.if_else(pa.array(lost), cleaned, piece.column("text").cast(pa.string()))
                yield pa.RecordBatch.from_arrays(
                    [piece.column("doc_id"), piece.column("carried"), pa.array(size), pa.array(size - np.diff(left)), pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))), pa.nulls(len(rows), pa.binary()) if decode else pa.array(rows, pa.binary()), cleaned],
                    names=schema_names,
                )

    return run


def remove_repeats(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, second: int = SECOND, sparse: int = SPARSE, doc_id: str = "doc_id", text: str = "text", carry: tuple[str, ...] = (), decode: bool = False) -> DataFrame:
    """One row per document: doc_id, carried, n_bytes, n_removed, spans, kept.

    ``spans`` are the maximal runs of removed bytes and ``kept`` the bytes that
    remain, which may begin or end within a character; ``carried`` is a struct
    of the columns named by `carry`, which needn't have the text.  With `decode`,
    ``cleaned`` takes the place of ``kept``: the text as it is if it lost nothing,
    null if it is, else its remaining characters.
    """
    spark = docs.sparkSession
    stage = shared.Stage(spark, "suffix")
    buckets = max(1, min(65536, shared.partitions(spark)))
    shared.small_batches(spark)
    carried = F.struct(*[F.col(f"`{c}`") for c in carry]) if carry else F.struct(F.lit(0).alias("none"))
    frame = docs.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), F.col(f"`{text}`").alias("text"), carried.alias("carried"))
    known = frame.where("doc_id is not null").withColumn("rid", F.monotonically_increasing_id())
    name = f"lodegraph_texts_{uuid.uuid4().hex[:12]}"
    with shared.shuffles_freed(spark):
        known.repartition(buckets, "rid").write.option("compression", "zstd").bucketBy(buckets, "rid").option("path", f"{stage.root}/texts").saveAsTable(name)
    dealt = spark.table(name)
    # the catalogue is not needed once the files and their buckets are known; the
    # files go with the stage
    spark.sql(f"DROP TABLE {name}")

    def ranked(frame: DataFrame, *round_: int) -> DataFrame:
        pairs = frame.mapInArrow(_deal_anchors(buckets, length, *round_), _ANCHORED).groupBy("bucket").applyInArrow(_rank(buckets), _SETTLED)
        return stage.write(pairs.groupBy("home").applyInArrow(_by_row, _BY_ROW))

    def opened(found: DataFrame) -> DataFrame:
        return dealt.join(found.where("octet_length(open) > 0").select("rid", "open"), "rid").select("rid", "doc_id", "text", "open")

    found = ranked(dealt.select("rid", "doc_id", "text"), gram)
    told, grams = found.where("octet_length(done) > 0").select("rid", "done"), {"done": gram}
    left = found.agg(F.sum(F.octet_length("open"))).first()[0] or 0  # four bytes an anchor
    every = (dealt.agg(F.sum(F.octet_length("text"))).first()[0] or 0) * 2 // (length - gram + 2)
    if left // 4 * sparse > every:
        found = ranked(opened(found), second, gram)
        told = told.join(found.where("octet_length(done) > 0").select("rid", F.col("done").alias("again")), "rid", "full")
        grams["again"] = gram = second
    windows = opened(found).mapInArrow(_deal_windows(buckets, length, gram), _WINDOWED).groupBy("bucket").applyInArrow(_rank_windows(buckets), _SETTLED)
    starts = stage.write(windows.groupBy("home").applyInArrow(_by_row, _BY_ROW).select("rid", F.col("done").alias("starts")))
    told = told.join(starts, "rid", "full")
    joined = dealt.join(told, "rid", "left").select("doc_id", "carried", "text", *grams, "starts")
    spans = "array<struct<start:bigint,end:bigint>>"
    schema = f"doc_id long, carried {frame.schema['carried'].dataType.simpleString()}, n_bytes long, n_removed long, spans {spans}, kept binary, cleaned string"
    out = joined.mapInArrow(_cut(length, grams, decode, ["doc_id", "carried", "n_bytes", "n_removed", "spans", "kept", "cleaned"]), schema)
    size = F.coalesce(F.octet_length("text"), F.lit(0)).cast("long")
    unknown = frame.where("doc_id is null").select("doc_id", "carried", size.alias("n_bytes"), F.lit(0).cast("long").alias("n_removed"), F.array().cast(spans).alias("spans"), F.coalesce("text", F.lit("")).cast("binary").alias("kept"), F.col("text").alias("cleaned"))
    return out.unionByName(unknown).drop("kept" if decode else "cleaned")


def covered_by_doubling(docs: DataFrame, length: int = LENGTH, first: int = 16, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, start) of the windows that a smaller document has, by prefix
    doubling over every position: a row a position, ranked by its first bytes,
    then by pairs of ranks at offsets that double up to `length`.

    The form to hold `remove_repeats` against on small tables; it shuffles some
    twenty times the text (README.md has figures).
    """
    known = shared.pick(docs, doc_id=doc_id, text=text).where("doc_id is not null").withColumn("raw", F.col("text").cast("binary"))
    at = F.explode(F.sequence(F.lit(0), F.octet_length("raw") - first)).alias("start")
    rows = known.where(F.octet_length("raw") >= length).select(F.monotonically_increasing_id().alias("rid"), "doc_id", "raw").select("rid", "doc_id", F.octet_length("raw").alias("n"), at, "raw")
    open_ = rows.select("rid", "doc_id", "n", "start", F.xxhash64(F.substring("raw", F.col("start") + 1, F.lit(first))).alias("rank"))
    span, stage = first, shared.Stage(docs.sparkSession, "doubling")
    while True:
        shared_ranks = open_.groupBy("rank").agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("most")).where("least < most")
        open_ = stage.write(open_.join(shared_ranks.select("rank", "least"), "rank"))  # unique ones leave
        if span == length:
            return open_.where("doc_id > least").select("doc_id", "start").distinct()
        step = min(span, length - span)
        beyond = open_.select("rid", (F.col("start") - step).alias("start"), F.col("rank").alias("next"))
        span += step
        open_ = open_.drop("least").join(beyond, ["rid", "start"]).where(F.col("start") + span <= F.col("n")).select("rid", "doc_id", "n", "start", F.xxhash64("rank", "next").alias("rank"))


def op7_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = remove_repeats(shared.documents(spark, sf_dir))
    return found.select("doc_id", "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


ORACLE_SQL = """
WITH b AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h, octet_length(encode(coalesce(text, ''))) AS n FROM documents),
w AS (SELECT doc_id, k, substr(h, 2 * k + 1, 100) AS g FROM (SELECT doc_id, h, unnest(generate_series(0, n - 50)) AS k FROM b WHERE n >= 50)),
f AS (SELECT g, min(doc_id) AS first FROM w GROUP BY g),
c AS (SELECT doc_id, k, lag(k) OVER (PARTITION BY doc_id ORDER BY k) AS prev FROM w JOIN f USING (g) WHERE first < doc_id),
i AS (SELECT doc_id, k, sum(CASE WHEN prev IS NULL OR k > prev + 50 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY k) AS run FROM c),
r AS (SELECT doc_id, min(k) AS a, max(k) + 50 AS z FROM i GROUP BY doc_id, run),
t AS (SELECT doc_id, count(*) AS n_spans, sum(z - a) AS n_removed FROM r GROUP BY doc_id),
p AS (SELECT doc_id, coalesce(lag(z) OVER (PARTITION BY doc_id ORDER BY a), 0) AS s, a AS e FROM r
      UNION ALL SELECT b.doc_id, coalesce(max(z), 0), max(n) FROM b LEFT JOIN r USING (doc_id) GROUP BY b.doc_id),
k AS (SELECT doc_id, string_agg(substr(h, 2 * s + 1, 2 * (e - s)), '' ORDER BY s) AS h FROM p JOIN b USING (doc_id) GROUP BY doc_id)
SELECT b.doc_id, CAST(n AS BIGINT) AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, CAST(coalesce(n_spans, 0) AS BIGINT) AS n_spans, sha256(unhex(k.h)) AS kept_sha256
FROM b JOIN k USING (doc_id) LEFT JOIN t USING (doc_id)
"""
