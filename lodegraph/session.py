"""The engine's front door: tables, statements, imports and persistence."""

from __future__ import annotations

import json
import time
import uuid
from functools import reduce

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import parser as ast
from .catalog import Catalog, Column, NodeTable, RelTable
from .errors import BindError, ConstraintViolation, ExecutionError, ImportFailed, ReadOnlyError, SchemaError, StorageError, TypeMismatch
from .plans.binder import Binder, explain_text
from .plans.optimizer import Planner
from .sources import csv
from .sources.csv import CsvImportConfig, ImportProgress, ImportResult, ProgressCallback
from .sources.files import Files, shared_folder
from .types import GraphType, fits, literal_type

#: Ids of rows that statements create start here; imported ones lie below.
CREATED = 1 << 62


def _manifest(version: int) -> str:
    return f"manifest/{version:012d}.json"


def _versions(files: Files) -> list[int]:
    return sorted(int(n.removesuffix(".json")) for n in files.names("manifest") if n.endswith(".json"))


class _Table:
    """One table's rows: written parts, and created rows not yet written."""

    def __init__(self, schema: T.StructType):
        self.schema = schema
        self.parts: list[DataFrame] = []
        self.paths: list[str] = []
        self.created: list[tuple] = []
        self.whole = True  # no relationship without both its nodes
        self.keyed = False  # the key serves as the id
        self._cached: tuple[int, DataFrame] | None = None

    def frame(self, spark: SparkSession) -> DataFrame:
        frames = list(self.parts)
        if self.created or not frames:
            if self._cached is None or self._cached[0] != len(self.created):
                self._cached = len(self.created), spark.createDataFrame(list(self.created), self.schema)
            frames.append(self._cached[1])
        return reduce(DataFrame.unionByName, frames)


class GraphSession:
    """A property graph on Spark, in memory or in a folder.

    ``execute`` gives a lazy DataFrame.  In a folder every statement that
    succeeds is committed before it returns; a checkpoint folds the log of
    created rows into Parquet.
    """

    def __init__(self, spark: SparkSession, path: str | None = None, read_only: bool = False, **_ignored):
        self.spark = spark
        self.catalog = Catalog()
        self.planner = Planner()
        self.read_only = read_only
        self.path = path
        self._tables: dict[str, _Table] = {}
        self._keys: dict[str, set] = {}
        self._next = CREATED
        self._imports = 0
        self._log = 0
        self._epochs: dict[str, int] = {}  # of streams, the last one taken in
        self._files = Files(spark, path) if path else None
        if path:
            self._load()

    @classmethod
    def open(cls, spark: SparkSession, path: str, read_only: bool = False, **ignored) -> GraphSession:
        return cls(spark, path, read_only, **ignored)

    def __enter__(self):
        return self

    def __exit__(self, *_):
        self.close()

    def close(self) -> None:
        if self._files and not self.read_only and self._log:
            self.checkpoint()

    # what plans read
    def nodes(self, name: str) -> DataFrame:
        self.catalog.node(name)
        return self._tables[name].frame(self.spark)

    def rels(self, name: str) -> DataFrame:
        self.catalog.rel(name)
        return self._tables[name].frame(self.spark)

    def is_whole(self, name: str) -> bool:
        """Does every relationship of the table have both its nodes?"""
        return self._tables[name].whole

    def key_is_id(self, name: str) -> bool:
        """Is the primary key of every node its id?"""
        table = self._tables[name]
        return table.keyed and len(table.parts) == 1 and not table.created

    # schemas
    def _add(self, table: NodeTable | RelTable) -> None:
        self.catalog.add(table)
        hidden = ["_id"] if isinstance(table, NodeTable) else ["_id", "_src", "_dst"]
        fields = [T.StructField(k, T.LongType()) for k in hidden] + [T.StructField(c.name, c.type.spark) for c in table.columns]
        self._tables[table.name] = _Table(T.StructType(fields))

    def _writable(self) -> None:
        if self.read_only:
            raise ReadOnlyError("the graph was opened read-only")

    def register_nodes(self, name: str, frame: DataFrame, primary_key: str | tuple[str, ...], columns: dict[str, GraphType] | None = None) -> None:
        """Use a DataFrame as a node table, without copying it.

        A single integer key serves as the nodes' id; other keys need ids of
        their own, for which the rows are written once.
        """
        self._writable()
        keys = (primary_key,) if isinstance(primary_key, str) else tuple(primary_key)
        kinds = columns or {f.name: GraphType.of(f.dataType) for f in frame.schema.fields}
        table = NodeTable(name, tuple(Column(c, k) for c, k in kinds.items()), keys)
        typed = frame.select(*[F.col(f"`{c}`").cast(k.spark).alias(c) for c, k in kinds.items()])
        self._add(table)
        if len(keys) == 1 and kinds[keys[0]] is GraphType.INT64:
            part = typed.select(F.col(f"`{keys[0]}`").alias("_id"), "*")
            self._tables[name].keyed = True
        else:
            part = self._written(typed.select(F.monotonically_increasing_id().alias("_id"), "*"), name)
        self._tables[name].parts.append(part)

    def register_relationships(self, name: str, frame: DataFrame, source: str, target: str, source_key: str, target_key: str, columns: dict[str, GraphType] | None = None, whole: bool = False) -> None:
        """Use a DataFrame as a relationship table between registered nodes.

        ``whole`` promises that every row's ends exist; pattern ends of which
        nothing is read are then not joined.
        """
        self._writable()
        self.catalog.node(source), self.catalog.node(target)
        kinds = columns if columns is not None else {f.name: GraphType.of(f.dataType) for f in frame.schema.fields if f.name not in (source_key, target_key)}
        rest = [F.col(f"`{c}`").cast(k.spark).alias(c) for c, k in kinds.items()]
        made = frame.select(F.monotonically_increasing_id().alias("_id"), F.col(f"`{source_key}`").alias("_src"), F.col(f"`{target_key}`").alias("_dst"), *rest)
        for end, label in (("_src", source), ("_dst", target)):
            table = self.catalog.node(label)
            kind = table.column(table.primary_key[0]).type
            if len(table.primary_key) == 1 and kind is GraphType.INT64:
                made = made.withColumn(end, F.col(end).cast("long"))
            else:
                ids = self.nodes(label).select(F.col("_id").alias("__to"), F.col(f"`{table.primary_key[0]}`").alias("__key"))
                made = made.join(ids, made[end] == ids["__key"]).withColumn(end, F.col("__to")).drop("__to", "__key")
        self._add(RelTable(name, source, target, tuple(Column(c, k) for c, k in kinds.items())))
        self._tables[name].parts.append(made.select("_id", "_src", "_dst", *kinds))
        self._tables[name].whole = whole

    # statements
    def execute(self, query: str) -> DataFrame:
        """Run one statement; queries give a lazy DataFrame of `var.property`s."""
        tree = ast.parse(query)
        if isinstance(tree, (ast.Match, ast.Union)):
            return self.plan(query, tree).frame(self)
        if isinstance(tree, ast.Explain):
            return self.spark.createDataFrame([(self.explain(tree.match, tree.verbose),)], "plan string")
        self._writable()
        if isinstance(tree, ast.CreateNodeTable):
            self._add(NodeTable(tree.name, tuple(Column(*c) for c in tree.columns), tree.primary_key))
            self._commit()
        elif isinstance(tree, ast.CreateRelTable):
            self._add(RelTable(tree.name, tree.source, tree.target, tuple(Column(*c) for c in tree.columns)))
            self._commit()
        elif isinstance(tree, ast.CreateNode):
            self._create_node(tree)
        elif isinstance(tree, ast.MatchCreate):
            self._match_create(tree)
        elif isinstance(tree, ast.Copy):
            return self._copy(tree)
        return self.spark.createDataFrame([], T.StructType([]))

    def collect(self, query: str) -> list:
        """The rows, with failures while running told as ExecutionError."""
        try:
            return self.execute(query).collect()
        except PySparkException as e:
            raise ExecutionError(str(e).splitlines()[0]) from e

    def plan(self, query: str, tree=None):
        """The optimised logical plan of a query."""
        return self.planner.optimize(Binder(self.catalog).query(tree or ast.parse(query)))

    def explain(self, query, verbose: bool = False) -> str:
        tree = ast.parse(query) if isinstance(query, str) else query
        tree = tree.match if isinstance(tree, ast.Explain) else tree
        bound = Binder(self.catalog).query(tree)
        if not verbose:
            return explain_text(tree)
        plan, rules = self.planner.optimize_with_tracking(bound)
        schema = ", ".join(f"{k}: {t.value}" for k, t in plan.schema.items())
        spark = plan.frame(self)._jdf.queryExecution().simpleString()
        return f"Logical plan:\n{bound.tree()}Optimised plan:\n{plan.tree()}Rules applied: {', '.join(rules) or 'none'}\nSchema: {schema}\n{spark}"

    # changes
    def _typed(self, table, values: tuple, all_of: bool) -> list:
        given = dict(values)
        if len(given) != len(values):
            raise SchemaError(f"a property is given twice for '{table.name}'")
        for name in given:
            if table.column(name) is None:
                raise SchemaError(f"'{table.name}' has no property '{name}'")
        missing = [c.name for c in table.columns if c.name not in given]
        if missing and all_of:
            raise SchemaError(f"missing property '{missing[0]}' of '{table.name}'")
        out = []
        for c in table.columns:
            value = given.get(c.name)
            if not fits(value, c.type):
                raise TypeMismatch(c.type.value, literal_type(value).value, f"property '{c.name}'")
            out.append(float(value) if c.type.is_float and value is not None else value)
        return out

    def _create_node(self, tree: ast.CreateNode) -> None:
        table = self.catalog.node(tree.label)
        row = self._typed(table, tree.values, True)
        key = tuple(v for c, v in zip(table.columns, row) if c.name in table.primary_key)
        state = self._tables[table.name]
        known = self._keys.setdefault(table.name, {tuple(v for c, v in zip(table.columns, r[1:]) if c.name in table.primary_key) for r in state.created})
        taken = key in known
        if not taken and state.parts:
            same = reduce(lambda a, b: a & b, [F.col(f"`{c.name}`").eqNullSafe(F.lit(v)) for c, v in zip([c for c in table.columns if c.name in table.primary_key], key)])
            taken = any(not p.where(same).isEmpty() for p in state.parts)
        if taken:
            raise ConstraintViolation(f"a '{table.name}' with primary key {key} exists already")
        self._record(table.name, (self._next, *row))
        known.add(key)

    def _match_create(self, tree: ast.MatchCreate) -> None:
        binder = Binder(self.catalog)
        rel = binder.relationship(tree.table)
        labels = {}
        for n in tree.nodes:
            labels[n.var] = binder.node(n.var, n.label)
        for var in (tree.source, tree.target):
            if var not in labels:
                raise BindError("undefined_variable", f"variable '{var}' is not defined")
        if (labels[tree.source].name, labels[tree.target].name) != (rel.source, rel.target):
            raise BindError("type_mismatch", f"'{rel.name}' leads from '{rel.source}' to '{rel.target}'")
        row = self._typed(rel, tree.values, True)
        ends = {}
        for n in tree.nodes:
            if not n.filters:
                return  # nothing is looked up, so nothing is created
            conditions = binder.filters(n)
            from .plans.logical import NodeScan

            found = NodeScan(labels[n.var], n.var, conditions, ()).frame(self).orderBy(f"`{n.var}._id`").limit(1).collect()
            if not found:
                return
            ends[n.var] = found[0][0]
        self._record(rel.name, (self._next, ends[tree.source], ends[tree.target], *row))

    def _record(self, table: str, row: tuple) -> None:
        if self._files:
            self._log += 1
            self._files.write(f"log/{self._log:012d}.json", json.dumps([table, list(row)]))
        self._tables[table].created.append(row)
        self._next += 1

    # imports
    def _remove(self, staged: DataFrame) -> None:
        """Rows of an import that failed."""
        Files(self.spark, staged._lodegraph_path).delete(".")

    def _copy(self, tree: ast.Copy) -> DataFrame:
        o = tree.options
        config = CsvImportConfig(delimiter=o.get("delim", ","), has_header=o.get("header", True), skip_rows=max(0, o.get("skip", 0)), ignore_errors=o.get("ignore_errors", False))
        table = self.catalog.tables.get(tree.table)
        if table is None:
            raise SchemaError(f"table '{tree.table}' does not exist")
        load = self.import_nodes if isinstance(table, NodeTable) else self.import_relationships
        got = load(tree.table, tree.path, config)
        return self.spark.createDataFrame([(got.rows_imported, got.rows_failed)], "rows_imported long, rows_failed long")

    def _written(self, frame: DataFrame, name: str) -> DataFrame:
        """Rows written once, so that ids stay as they are."""
        self._imports += 1
        if self.path:
            where = f"{self.path.rstrip('/')}/data/{name}-{uuid.uuid4().hex[:12]}"
        else:
            where = f"{shared_folder(self.spark)}/lodegraph-{name}-{uuid.uuid4().hex[:12]}"
        frame.write.parquet(where)
        out = self.spark.read.schema(frame.schema).parquet(where)
        out._lodegraph_path = where
        return out

    def _fields(self, path: str, config: CsvImportConfig, wanted: list[str], any_case: tuple[str, ...] = ()):
        """The raw table and, for each wanted column, its field."""
        try:
            names = csv.header(self.spark, path, config)
        except PySparkException as e:
            raise StorageError(f"cannot read '{path}': {str(e).splitlines()[0]}") from e
        if config.has_header:
            places = {}
            for w in wanted:
                match = [k for k, n in enumerate(names) if n == w] or [k for k, n in enumerate(names) if w in any_case and n.lower() == w.lower()]
                if not match:
                    raise StorageError(f"CSV missing required column '{w}'")
                places[w] = match[0]
        else:
            if len(names) < len(wanted):
                raise StorageError(f"CSV missing required column '{wanted[len(names)]}'")
            places = {w: k for k, w in enumerate(wanted)}
        raw = csv.read(self.spark, path, names, config)
        if config.skip_rows:
            raw = csv.numbered(raw).where(F.col("__row") >= config.skip_rows).drop("__row")
        return raw, {w: F.col(f"f{k}") for w, k in places.items()}

    def _settle(self, staged: DataFrame, counts: dict, config: CsvImportConfig) -> tuple[DataFrame, int, int, list[str], DataFrame | None]:
        """Good rows, and the account of bad ones: the first reasons, and all as a
        table; without ignore_errors any ends it."""
        total, failed = counts["n"], counts["bad"]
        reasons: list[str] = []
        bad = None
        if failed:
            place = csv.numbered(staged.select(csv.ORDINAL, "__error")) if not config.skip_rows else staged.withColumn("__row", F.col(csv.ORDINAL))
            bad = place.where("__error is not null").select((F.col("__row") + 1 + int(config.has_header)).alias("row"), F.col("__error").alias("reason"))
            reasons = [f"Row {r['row']}, {r['reason']}" for r in bad.orderBy("row").limit(csv.PREVIEW).collect()]
            if not config.ignore_errors:
                raise ImportFailed(reasons[0])
        return staged.where("__error is null"), total - failed, failed, reasons, bad

    def import_nodes(self, table: str, path: str, config: CsvImportConfig | None = None, progress: ProgressCallback | None = None) -> ImportResult:
        """Append a CSV file's rows; all or none unless errors are ignored.

        A primary key that occurs twice, in the file or in the table, ends the
        import in either mode.
        """
        self._writable()
        config = config or CsvImportConfig()
        config.validate()
        schema = self.catalog.node(table)
        raw, at = self._fields(path, config, [c.name for c in schema.columns])
        with csv.Watch(self.spark, path, progress) as watch:
            return self._take_nodes(schema, raw, at, config, watch)

    def _take_nodes(self, schema: NodeTable, raw: DataFrame, at: dict, config: CsvImportConfig, watch: csv.Watch) -> ImportResult:
        """Parse, check and append rows whose fields `at` are text."""
        values = [csv.parsed(at[c.name], c.type, "node").cast(c.type.spark) for c in schema.columns]
        reasons = [csv.failure(at[c.name], v, c.type, c.name) for c, v in zip(schema.columns, values)]
        if not config.ignore_errors:
            reasons.insert(0, F.when(F.col(csv.CORRUPT).isNotNull(), F.lit("wrong number of fields")))
        base = F.lit(self._imports << 50)
        typed = raw.select((base + F.col(csv.ORDINAL)).alias("_id"), F.col(csv.ORDINAL), *[v.alias(c.name) for c, v in zip(schema.columns, values)], csv.first_of(reasons).alias("__error"))
        return self._take(schema.name, typed, config, watch, lambda rows: self._check_keys(schema, rows))

    def _take(self, table: str, typed: DataFrame, config: CsvImportConfig, watch: csv.Watch, check) -> ImportResult:
        """Write rows once, check them and append them; a failure leaves nothing."""
        counts = Observation()  # taken while the rows are written
        staged = self._written(typed.observe(counts, F.count(F.lit(1)).alias("n"), F.count("__error").alias("bad")), table)
        try:
            good, imported, failed, errors, bad = self._settle(staged, counts.get, config)
            rows = good.drop("__error", csv.ORDINAL)
            check(rows)
            self._append(table, staged, rows)
        except Exception:
            self._remove(staged)
            raise
        watch.done(imported + failed, failed)
        return ImportResult(imported, failed, watch.total_bytes, errors, bad)

    def _check_keys(self, schema: NodeTable, rows: DataFrame) -> None:
        keys = [F.col(f"`{k}`") for k in schema.primary_key]
        twice = rows.groupBy(*keys).count().where("count > 1").limit(1).collect()
        if twice:
            raise ConstraintViolation(f"primary key {tuple(twice[0])[:-1]} of '{schema.name}' occurs more than once")
        state = self._tables[schema.name]
        if state.parts or state.created:
            old = state.frame(self.spark).select(*[k.alias(f"__k{i}") for i, k in enumerate(keys)])
            same = reduce(lambda a, b: a & b, [k.eqNullSafe(F.col(f"__k{i}")) for i, k in enumerate(keys)])
            clash = rows.join(old, same, "left_semi").limit(1).collect()
            if clash:
                raise ConstraintViolation(f"a '{schema.name}' with that primary key exists already: {tuple(clash[0][k] for k in schema.primary_key)}")

    def create_nodes(self, table: str, frame: DataFrame) -> int:
        """CREATE for many nodes at once: every row of a DataFrame whose columns
        are the table's, in one commit; gives their number."""
        self._writable()
        schema = self.catalog.node(table)
        if missing := [c.name for c in schema.columns if c.name not in frame.columns]:
            raise SchemaError(f"missing property '{missing[0]}' of '{table}'")
        for name in frame.columns:
            column = schema.column(name)
            if column is None:
                raise SchemaError(f"'{table}' has no property '{name}'")
            kind = GraphType.of(frame.schema[name].dataType)
            if kind is not column.type and not (column.type.is_float and kind.is_numeric):
                raise TypeMismatch(column.type.value, kind.value, f"property '{name}'")
        ordinal = F.monotonically_increasing_id()
        typed = frame.select((F.lit(self._imports << 50) + ordinal).alias("_id"), ordinal.alias(csv.ORDINAL), *[F.col(f"`{c.name}`").cast(c.type.spark).alias(c.name) for c in schema.columns], F.lit(None).cast("string").alias("__error"))
        return self._take(table, typed, CsvImportConfig(), csv.Watch(self.spark, None, None), lambda rows: self._check_keys(schema, rows)).rows_imported

    def import_relationships(self, table: str, path: str, config: CsvImportConfig | None = None, progress: ProgressCallback | None = None) -> ImportResult:
        """Append a CSV file of FROM, TO and properties; keys are looked up in
        the end tables, and unknown ones count as errors."""
        self._writable()
        config = config or CsvImportConfig()
        config.validate()
        schema = self.catalog.rel(table)
        raw, at = self._fields(path, config, ["FROM", "TO", *(c.name for c in schema.columns)], ("FROM", "TO"))
        with csv.Watch(self.spark, path, progress) as watch:
            return self._take_relationships(schema, raw, at, config, watch)

    def _take_relationships(self, schema: RelTable, raw: DataFrame, at: dict, config: CsvImportConfig, watch: csv.Watch) -> ImportResult:
        values = [csv.parsed(at[c.name], c.type, "rel").cast(c.type.spark) for c in schema.columns]
        reasons = [csv.failure(at[c.name], v, c.type, c.name) for c, v in zip(schema.columns, values)]
        empty = [F.when(at[k].isNull(), F.lit(f"{k} key cannot be empty")) for k in ("FROM", "TO")]
        if not config.ignore_errors:
            empty.insert(0, F.when(F.col(csv.CORRUPT).isNotNull(), F.lit("wrong number of fields")))
        typed = raw.select(F.col(csv.ORDINAL), at["FROM"].alias("__from"), at["TO"].alias("__to"), *[v.alias(c.name) for c, v in zip(schema.columns, values)], csv.first_of(empty + reasons).alias("__error"))
        for key, label, end, word in (("__from", schema.source, "_src", "Source"), ("__to", schema.target, "_dst", "Destination")):
            nodes = self.catalog.node(label)
            first = nodes.column(nodes.primary_key[0])
            ids = self.nodes(label).select(F.col("_id").alias(end), F.col(f"`{first.name}`").alias("__key"))
            if len(nodes.primary_key) > 1:  # the first row that matches one column
                ids = ids.groupBy("__key").agg(F.min(end).alias(end))
            typed = typed.join(ids, csv.parsed(typed[key], first.type, "node") == ids["__key"], "left").drop("__key")
            gone = F.when(F.col(end).isNull(), F.concat(F.lit(f"{word} node with key '"), F.col(key), F.lit("' not found")))
            typed = typed.withColumn("__error", F.coalesce("__error", gone))
        base = F.lit(self._imports << 50)
        names = [c.name for c in schema.columns]
        return self._take(schema.name, typed.select((base + F.col(csv.ORDINAL)).alias("_id"), "_src", "_dst", *names, csv.ORDINAL, "__error"), config, watch, lambda rows: None)

    def _append(self, table: str, staged: DataFrame, rows: DataFrame) -> None:
        state = self._tables[table]
        state.parts.append(rows.select(*state.schema.names))
        state.paths.append(staged._lodegraph_path)
        self._commit()

    # persistence
    def _commit(self) -> None:
        """Name the tables and their files in the next manifest.

        Manifests are numbered and never replaced: the newest one counts, so a
        failure at any point leaves the graph as before or as after."""
        if not self._files:
            return
        root = f"{self.path.rstrip('/')}/"
        data = {name: [p.removeprefix(root) for p in t.paths] for name, t in self._tables.items()}
        saved = {"format": 2, "catalog": self.catalog.to_json(), "data": data, "imports": self._imports, "next": self._next, "log": self._folded, "epochs": self._epochs}
        self._files.write(_manifest(self._version + 1), json.dumps(saved))
        self._version += 1
        for old in _versions(self._files):
            if old < self._version - 1:
                self._files.delete(_manifest(old))

    _folded = 0
    _version = 0

    def _load(self) -> None:
        files = self._files
        versions = _versions(files)
        if not versions:
            if self.read_only:
                raise StorageError(f"'{self.path}' is not a graph")
            if files.names("data") or files.names("log"):
                raise StorageError(f"'{self.path}' holds a graph's data but no manifest")
            self._commit()
            return
        saved = None
        for version in reversed(versions):
            try:
                saved = json.loads(files.read(_manifest(version)))
                break
            except ValueError:  # cut short; the one before is whole
                continue
        if saved is None:
            raise StorageError(f"the manifest of '{self.path}' is damaged")
        self._version = versions[-1]
        for table in Catalog.from_json(saved["catalog"]).tables.values():
            self._add(table)
        self._imports, self._next, self._folded = saved["imports"], saved["next"], saved["log"]
        self._epochs = saved.get("epochs", {})
        self._log = self._folded
        for name, paths in saved["data"].items():
            state = self._tables[name]
            for p in paths:
                frame = self.spark.read.parquet(files.at(p))
                if "__error" in frame.columns:
                    frame = frame.where("__error is null")
                state.parts.append(frame.select(*state.schema.names))
                state.paths.append(files.at(p))
        for entry in files.names("log"):
            number = entry.removesuffix(".json")
            if not entry.endswith(".json") or int(number) <= self._folded:
                continue
            table, row = json.loads(files.read(f"log/{entry}"))
            kinds = [f.dataType for f in self._tables[table].schema.fields]
            self._tables[table].created.append(tuple(float(v) if isinstance(k, (T.DoubleType, T.FloatType)) and v is not None else v for v, k in zip(row, kinds)))
            self._log, self._next = int(number), max(self._next, row[0] + 1)

    def checkpoint(self) -> None:
        """Fold created rows into Parquet and empty the log."""
        self._writable()
        if not self._files:
            return
        for name, state in self._tables.items():
            if state.created:
                part = self._written(self.spark.createDataFrame(list(state.created), state.schema), name)
                state.parts.append(part)
                state.paths.append(part._lodegraph_path)
                state.created.clear()
                state._cached = None
        self._folded = self._log
        self._commit()
        for entry in self._files.names("log"):
            if entry.endswith(".json") and int(entry.removesuffix(".json")) <= self._folded:
                self._files.delete(f"log/{entry}")


__all__ = ["CsvImportConfig", "GraphSession", "ImportProgress", "ImportResult"]
