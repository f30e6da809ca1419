"""CSV import: every field is read as text and parsed by rules of our own.

A row that fails carries its reason in a column; nothing is collected but a few
reasons.  Files are split among tasks unless a quoted field of theirs spans lines.
"""

from __future__ import annotations

import csv as text_csv
import threading
import time
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import StorageError, ValidationError
from ..types import GraphType
from .files import Files


@dataclass
class CsvImportConfig:
    delimiter: str = ","
    quote: str = '"'
    escape: str = '"'
    has_header: bool = True
    skip_rows: int = 0
    ignore_errors: bool = False
    batch_size: int = 2048
    parallel: bool = True
    num_threads: int | None = None
    block_size: int = 256 * 1024
    use_mmap: bool = True
    mmap_threshold: int = 100 * 1024 * 1024
    intern_strings: bool = False
    #: None: look whether a quoted field spans lines.
    multiline: bool | None = None

    def validate(self) -> None:
        if self.num_threads is not None and self.num_threads < 1:
            raise ValidationError("num_threads must be at least 1")
        if not 64 * 1024 <= self.block_size <= 16 * 1024 * 1024:
            raise ValidationError("block_size must be from 64 KB to 16 MB")
        if not 1 <= self.batch_size <= 10_000_000:
            raise ValidationError("batch_size must be from 1 to 10,000,000")
        if self.mmap_threshold < 1024 * 1024:
            raise ValidationError("mmap_threshold must be at least 1 MB")
        if len(self.delimiter) != 1:
            raise ValidationError("the delimiter is one character")


#: Reasons in `ImportResult.errors`.
PREVIEW = 100


@dataclass
class ImportResult:
    """`errors` previews the first PREVIEW bad rows; `bad_rows` (row, reason) has
    all of them, None if there are none."""

    rows_imported: int
    rows_failed: int
    bytes_processed: int = 0
    errors: list[str] = field(default_factory=list)
    bad_rows: DataFrame | None = None

    @property
    def is_success(self) -> bool:
        return self.rows_failed == 0


@dataclass
class ImportProgress:
    """What a progress callback is told: at the start, while tasks finish, and at
    the end, when the rows are counted."""

    rows_processed: int = 0
    rows_failed: int = 0
    bytes_read: int = 0
    total_bytes: int = 0
    seconds: float = 0.0
    #: Bytes a second, smoothed: the latest ones count most.
    rate: float = 0.0

    @property
    def percent(self) -> float:
        return 100.0 * self.bytes_read / self.total_bytes if self.total_bytes else 100.0

    @property
    def throughput(self) -> float:
        return self.rows_processed / self.seconds if self.seconds else 0.0

    @property
    def seconds_left(self) -> float | None:
        """An estimate; None while there is nothing to go by."""
        return (self.total_bytes - self.bytes_read) / self.rate if self.rate else None


ProgressCallback = Callable[[ImportProgress], None]


class Watch:
    """Tells a callback how far an import's jobs are, from Spark's own count of
    finished tasks; without a callback it only knows the size of the input."""

    INTERVAL = 0.5
    SMOOTHING = 0.3

    def __init__(self, spark: SparkSession, path: str | None, tell: ProgressCallback | None):
        self.tell, self.began = tell, time.time()
        self.context = spark.sparkContext
        self.total_bytes = Files(spark, path).size() if path else 0
        self.read, self.rate = 0, 0.0
        self._over = threading.Event()
        self._thread = None

    def __enter__(self) -> Watch:
        if self.tell:
            self.tell(ImportProgress(total_bytes=self.total_bytes))
            self._thread = threading.Thread(target=self._follow, daemon=True)
            self._thread.start()
        return self

    def __exit__(self, *_) -> None:
        self._over.set()
        if self._thread:
            self._thread.join()

    def _follow(self) -> None:
        tracker, last = self.context.statusTracker(), time.time()
        while not self._over.wait(self.INTERVAL):
            stages = [tracker.getStageInfo(k) for k in tracker.getActiveStageIds()]
            tasks = sum(s.numTasks for s in stages if s)
            if not tasks:
                continue
            now, done = time.time(), sum(s.numCompletedTasks for s in stages if s) / tasks
            # never back, and not at the end before the rows are counted
            read = max(self.read, int(0.99 * self.total_bytes * done))
            rate = (read - self.read) / max(now - last, 1e-3)
            self.rate = rate if not self.rate else self.SMOOTHING * rate + (1 - self.SMOOTHING) * self.rate
            self.read, last = read, now
            self.tell(ImportProgress(0, 0, read, self.total_bytes, now - self.began, self.rate))

    def done(self, rows: int, failed: int) -> None:
        self.__exit__()
        if self.tell:
            self.tell(ImportProgress(rows, failed, self.total_bytes, self.total_bytes, time.time() - self.began, self.rate))


#: Accepted spellings of numbers; Spark's casts accept more.
INTEGER = r"^[+-]?[0-9]+$"
FLOAT = r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"
ORDINAL = "__ordinal"
CORRUPT = "__corrupt"
TRUE_WORDS = {"node": ("true",), "rel": ("true", "1", "yes", "t")}
FALSE_WORDS = {"node": ("false",), "rel": ("false", "0", "no", "f")}


def header(spark: SparkSession, path: str, config: CsvImportConfig) -> list[str]:
    """The fields of the first line."""
    first = spark.read.text(path).first()
    if first is None:
        raise StorageError(f"'{path}' is empty")
    return next(text_csv.reader([first["value"]], delimiter=config.delimiter, quotechar=config.quote))


def _spanning(spark: SparkSession, path: str, config: CsvImportConfig) -> list[str]:
    """The files in which a quoted field may span lines: those with a line of an
    odd number of quotes."""
    quotes = F.length("value") - F.length(F.replace("value", F.lit(config.quote), F.lit("")))
    odd = spark.read.text(path).where(quotes % 2 == 1)
    return sorted(r[0] for r in odd.select(F.input_file_name()).distinct().collect())


def read(spark: SparkSession, path: str, names: list[str], config: CsvImportConfig) -> DataFrame:
    """All fields as text under positional names f0, f1, ..., with ORDINAL, a
    number that rises in file order, and CORRUPT, set on rows of another width.

    Only files with a field that spans lines are read by one task each.
    """
    fields = [T.StructField(f"f{k}", T.StringType()) for k in range(len(names))]
    schema = T.StructType([*fields, T.StructField(CORRUPT, T.StringType())])
    reader = (
        spark.read.schema(schema)
        .option("sep", config.delimiter)
        .option("quote", config.quote)
        .option("escape", config.escape)
        .option("header", config.has_header)
        .option("enforceSchema", True)
        .option("mode", "PERMISSIVE")
        .option("columnNameOfCorruptRecord", CORRUPT)
        .option("ignoreLeadingWhiteSpace", False)
        .option("ignoreTrailingWhiteSpace", False)
    )
    if config.multiline is None:
        whole = _spanning(spark, path, config)
        every = [f for f in spark.read.text(path).inputFiles()] if whole else []
        rest = sorted(set(every) - set(whole))
        if len(rest) + len(whole) != len(every):  # named otherwise here: all whole
            whole, rest = [path], []
    else:
        whole, rest = ([path], []) if config.multiline else ([], [])
    if not whole:
        got = reader.option("multiLine", False).csv(path)
    else:
        got = reader.option("multiLine", True).csv(whole)
        if rest:
            got = reader.option("multiLine", False).csv(rest).unionByName(got)
    return got.withColumn(ORDINAL, F.monotonically_increasing_id())


def numbered(frame: DataFrame) -> DataFrame:
    """With `__row`, the place from 0 of each row, from counts by partition."""
    spark = frame.sparkSession
    part = F.shiftright(ORDINAL, 33)
    counts = frame.groupBy(part.alias("part")).agg(F.count(F.lit(1)).alias("n")).orderBy("part").collect()
    base, rows = 0, []
    for r in counts:
        rows.append((r["part"], base))
        base += r["n"]
    starts = spark.createDataFrame(rows, "part long, base long")
    placed = frame.withColumn("part", part).join(F.broadcast(starts), "part")
    return placed.withColumn("__row", F.col("base") + F.col(ORDINAL).bitwiseAND((1 << 33) - 1)).drop("part", "base")


def parsed(raw: Column, kind: GraphType, loader: str) -> Column:
    """The typed value, or null where the field is empty or can't be parsed."""
    if kind is GraphType.STRING:
        return raw
    if kind is GraphType.INT64:
        return F.when(raw.rlike(INTEGER), raw.try_cast("bigint"))
    if kind.is_float:
        value = F.when(raw.rlike(FLOAT), raw.try_cast(kind.spark))
        return F.when(F.abs(value) < F.lit(float("inf")).cast(kind.spark), value)
    if kind is GraphType.BOOL:
        low = F.lower(raw)
        return F.when(low.isin(*TRUE_WORDS[loader]), True).when(low.isin(*FALSE_WORDS[loader]), False)
    if kind is GraphType.TIMESTAMP:  # microseconds since the epoch, without a zone
        micros = F.when(raw.rlike(INTEGER), raw.try_cast("bigint"))
        return F.timestamp_micros(micros).cast(kind.spark)
    return raw.try_cast(kind.spark)


def failure(raw: Column, value: Column, kind: GraphType, name: str) -> Column:
    """Why a field can't be used, or null."""
    text = F.concat(F.lit(f"column '{name}': Invalid {kind.value}: "), raw)
    return F.when(raw.isNotNull() & value.isNull(), text)


def first_of(reasons: list[Column]) -> Column:
    return F.coalesce(*reasons, F.lit(None).cast("string"))
