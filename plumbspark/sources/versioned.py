"""Tables of Parquet files under a log of versions: snapshot reads, all-or-nothing writes, few files rewritten.

A store is a folder that all executors share. ``data/<table>/load=<id>/`` holds files that are never changed. Each
``log/<version>.json`` names every table's schema, keys, layout and the Parquet lists of its files: added ones with
rows, bytes, partition label, least and greatest first key and a Bloom filter of all keys, and removed ones. A write
stages new files and becomes a version by one rename, which fails if another writer took the number.

Deletes, updates, replaces and upserts find the files they touch, rewrite those and carry the others over.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Mapping, Sequence
from urllib.parse import unquote

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbspark.functions.columns import all_set, quoted
from plumbspark.functions.shared_dir import hadoop, names_in, remove
from plumbspark.functions.sizes import is_small
from plumbspark.operators import writes as W
from plumbspark.operators.checks import duplicate_keys, violation_count
from plumbspark.plans.publish import RejectedWrite

ROWS_PER_FILE = 1_000_000
#: Words of a filter before it is folded to its keys: 16 bits for each of ROWS_PER_FILE.
FILTER_WORDS = 1 << 18
MARKS = 4
#: Lists of files that a version may name before a commit merges them.
LISTS = 24


class Conflict(RuntimeError):
    """Another writer changed a table that this transaction read and rewrote."""


class Touched:
    """What a transaction did to files, for tests and logs."""

    def __init__(self):
        self.rewritten = self.added = self.searched = 0


# --- files of any store that Hadoop reads ------------------------------------------------


def _read_text(spark: SparkSession, path: str) -> str:
    at, fs = hadoop(spark, path)
    stream = fs.open(at)
    try:
        return spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def _publish_text(spark: SparkSession, path: str, text: str) -> bool:
    """The text appears under ``path`` as a whole, or not at all if there is a file already."""
    jvm = spark._jvm
    draft, fs = hadoop(spark, f"{path.rpartition('/')[0]}/.{uuid.uuid4().hex}")
    out = fs.create(draft, False)
    out.write(bytearray(text.encode()))
    out.close()
    rename = getattr(jvm.org.apache.hadoop.fs, "Options$Rename")
    options = spark.sparkContext._gateway.new_array(rename, 1)
    options[0] = rename.NONE
    files = jvm.org.apache.hadoop.fs.FileContext.getFileContext(draft.toUri(), spark._jsc.hadoopConfiguration())
    try:
        files.rename(draft, jvm.org.apache.hadoop.fs.Path(path), options)
        return True
    except Py4JJavaError as e:
        if "FileAlreadyExists" not in str(e.java_exception):
            raise
        fs.delete(draft, False)
        return False


# --- Bloom filters over 64-bit key hashes -----------------------------------------------


def _words(h: np.ndarray, size: int) -> np.ndarray:
    return (h & np.uint64(size - 1)).astype(np.int64)


def _marks(h: np.ndarray) -> np.ndarray:
    out = np.zeros(len(h), np.uint64)
    for j in range(MARKS):
        out |= np.uint64(1) << ((h >> np.uint64(40 + 6 * j)) & np.uint64(63))
    return out


def _folded(words: np.ndarray) -> np.ndarray:
    """Half as long while at most an eighth of the bits would be set; a word's place is the hash modulo the length."""
    while len(words) > 1 and int(np.bitwise_count(words).sum()) <= 4 * len(words):
        words = words[: len(words) // 2] | words[len(words) // 2 :]
    return words


def _key_filters(keys: DataFrame) -> DataFrame:
    """(path, filter) of ``keys`` (path, h): a filter a task and file, then one a file."""

    def mark(batches):
        held: dict[str, np.ndarray] = {}
        for b in batches:
            paths = b.column("path").dictionary_encode()
            code, h = paths.indices.to_numpy(zero_copy_only=False), b.column("h").to_numpy().view(np.uint64)
            for i, path in enumerate(paths.dictionary.to_pylist()):
                words = held.setdefault(path, np.zeros(FILTER_WORDS, np.uint64))
                own = h[code == i]
                np.bitwise_or.at(words, _words(own, FILTER_WORDS), _marks(own))
            while len(held) > 4:  # a task reads its files one after another
                path = next(iter(held))
                yield _filter_batch(path, held.pop(path))
        for path, words in held.items():
            yield _filter_batch(path, words)

    def merge(table: pa.Table) -> pa.Table:
        parts = [np.frombuffer(raw, np.uint64) for raw in table.column("filter").to_pylist()]
        words = np.zeros(max(map(len, parts)), np.uint64)
        for part in parts:
            words |= np.tile(part, len(words) // len(part))
        return pa.Table.from_batches([_filter_batch(table.column("path")[0].as_py(), words)])

    return keys.mapInArrow(mark, "path string, filter binary").groupBy("path").applyInArrow(merge, "path string, filter binary")


def _filter_batch(path: str, words: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([path]), pa.array([_folded(words).tobytes()], pa.binary())], ["path", "filter"])


def _hash(keys: Sequence[str]) -> Column:
    return F.xxhash64(*[quoted(k) for k in keys])


class Store:
    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")
        log, fs = hadoop(spark, f"{self.folder}/log")
        fs.mkdirs(log)

    def versions(self) -> list[int]:
        names = names_in(self.spark, f"{self.folder}/log")
        return sorted(int(n.removesuffix(".json")) for n in names if n.endswith(".json") and not n.startswith("."))

    def version(self) -> int:
        return max(self.versions(), default=0)

    def manifest(self, version: int) -> dict:
        return json.loads(_read_text(self.spark, f"{self.folder}/log/{version:012d}.json")) if version else {"tables": {}}

    def read(self, table: str, version: int | None = None) -> DataFrame:
        """A table as of a version: the files it named then, whatever was written since."""
        return Transaction(self, self.version() if version is None else version).read(table)

    def begin(self) -> Transaction:
        return Transaction(self, self.version())

    def entries(self, table: str, version: int | None = None) -> DataFrame:
        """(path, n, bytes, label, low, high, filter) of a table's files."""
        return Transaction(self, self.version() if version is None else version)._entries(table)

    def partitions(self, table: str) -> DataFrame:
        """Rows, files and bytes of each partition, from the lists of files alone."""
        return self.entries(table).groupBy(F.col("label").alias("partition_name")).agg(
            F.sum("n").alias("row_count"), F.count(F.lit(1)).alias("files"), F.sum("bytes").alias("bytes")
        )

    def duplicates(self, table: str, batch: DataFrame, keys: Sequence[str] | None = None) -> DataFrame:
        """Keys of ``batch`` that the batch repeats or the table holds: (*keys, count). Only files whose key range
        and filter admit a key of the batch are read, and of those the key columns."""
        t = self.begin()
        keys = list(keys or t._meta(table)["keys"])
        complete = batch.where(all_set(keys)).select(*keys)
        held = t._scan(table, t._candidates(table, complete)).select(*keys)
        mine = complete.groupBy(*keys).agg(F.count(F.lit(1)).alias("mine"))
        near = held.join(F.broadcast(mine) if is_small(complete) else mine, keys, "left_semi")
        stored = near.groupBy(*keys).agg(F.count(F.lit(1)).alias("stored"))
        count = F.col("mine") + F.coalesce("stored", F.lit(0))
        return mine.join(stored, keys, "left").select(*keys, count.alias("count")).where("count > 1")


class Transaction:
    """Writes on a snapshot; nothing shows until ``commit``. Later steps see what earlier ones staged."""

    def __init__(self, store: Store, base: int):
        self.store, self.spark, self.base = store, store.spark, base
        self.tables: dict[str, dict] = store.manifest(base)["tables"]
        self._files: dict[str, list[str]] = {}
        self._staged: dict[str, set[str]] = {}
        self._folders: list[str] = []
        self._gone: dict[str, set[str]] = {}
        self._created: set[str] = set()
        self._rewrote: set[str] = set()
        self.touched = Touched()

    # --- reading -----------------------------------------------------------------------

    def _meta(self, table: str) -> dict:
        if table not in self.tables:
            raise KeyError(f"no table {table}")
        return self.tables[table]

    def _schema(self, table: str) -> T.StructType:
        return T.StructType.fromJson(self._meta(table)["schema"])

    def _base(self, table: str) -> str:
        return f"{self.store.folder}/data/{table}"

    def _listed(self, table: str) -> DataFrame:
        meta = self._meta(table)
        low = self._schema(table)[meta["keys"][0]].dataType.simpleString() if meta["keys"] else "string"
        schema = f"path string, n bigint, bytes bigint, label string, low {low}, high {low}, filter binary"
        if not meta["added"]:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*meta["added"])

    def _entries(self, table: str) -> DataFrame:
        removed = self._meta(table)["removed"]
        if not removed:
            return self._listed(table)
        return self._listed(table).join(self.spark.read.schema("path string").parquet(*removed), "path", "left_anti")

    def files(self, table: str) -> list[str]:
        if table not in self._files:
            self._files[table] = [r.path for r in self._entries(table).select("path").collect()]
        return self._files[table]

    def _raw(self, table: str, files: Sequence[str]) -> DataFrame:
        """``files`` as the scan names them, that is URL-encoded."""
        reader = self.spark.read.schema(self._schema(table)).option("basePath", self._base(table))
        return reader.parquet(*map(unquote, files))

    def _scan(self, table: str, files: Sequence[str], *more: Column) -> DataFrame:
        schema = self._schema(table)
        if not files:
            empty = self.spark.createDataFrame([], schema)
            return empty.withColumns({f"__{i}": F.lit(None).cast("string") for i in range(len(more))}) if more else empty
        return self._raw(table, files).select(*[quoted(c) for c in schema.names], *[c.alias(f"__{i}") for i, c in enumerate(more)])

    def read(self, table: str) -> DataFrame:
        return self._scan(table, self.files(table))

    def _paths(self, rows: DataFrame) -> list[str]:
        """The files that hold ``rows`` of a scan with its path as ``__0``."""
        return sorted(r[0] for r in rows.select("__0").distinct().collect())

    def _candidates(self, table: str, keys: DataFrame) -> list[str]:
        """Files that may hold one of the complete ``keys``: by range and filter if the keys are few, else by range."""
        names = keys.columns
        if names != self._meta(table)["keys"]:
            return self.files(table)
        schema = self._schema(table)
        keys = keys.select(*[F.col(quoted(k)).cast(schema[k].dataType).alias(k) for k in names])  # else hashes differ
        first = F.col(quoted(names[0]))
        ends = keys.agg(F.min(first).alias("low"), F.max(first).alias("high")).first()
        if ends.low is None:
            return []
        kind = schema[names[0]].dataType
        live, staged = set(self.files(table)), self._staged.get(table, set())
        near = self._listed(table).where((F.col("low") <= F.lit(ends.high).cast(kind)) & (F.col("high") >= F.lit(ends.low).cast(kind)))
        if is_small(keys):
            sent = keys.select(first.alias("k"), _hash(names).alias("h")).toArrow()
            order = pc.sort_indices(sent.column("k"))
            k, h = sent.column("k").take(order), sent.column("h").take(order).to_numpy().view(np.uint64)
            given = self.spark.sparkContext.broadcast((_plain(k), h))
            near = near.select("path", "low", "high", "filter").mapInArrow(_admitted(given), "path string")
        found = {r.path for r in near.select("path").collect()}
        return sorted((found & live) | staged)

    def _holding(self, table: str, keys: DataFrame) -> list[str]:
        """The files that hold a key: the candidates' key columns are read and joined."""
        complete = keys.where(all_set(keys.columns))
        candidates = self._candidates(table, complete)
        self.touched.searched += len(candidates)
        if not candidates:
            return []
        wanted = complete.distinct()
        wanted = F.broadcast(wanted) if is_small(complete) else wanted
        return self._paths(self._scan(table, candidates, F.col("_metadata.file_path")).join(wanted, keys.columns, "left_semi"))

    # --- writing -----------------------------------------------------------------------

    def _stage(self, table: str, rows: DataFrame, layout: Callable[[DataFrame], DataFrame] | None = None) -> None:
        meta = self._meta(table)
        folder = f"{self._base(table)}/load={uuid.uuid4().hex}"
        rows = rows.select(*[quoted(c) for c in self._schema(table).names])
        rows = layout(rows) if layout else rows.hint("rebalance", *meta["partition"]) if meta["partition"] else rows
        rows.write.option("maxRecordsPerFile", ROWS_PER_FILE).partitionBy(*meta["partition"]).parquet(folder)
        self._folders.append(folder)
        new = [r.path for r in self._raw(table, [folder]).select(F.col("_metadata.file_path").alias("path")).distinct().collect()]
        self.files(table).extend(new)
        self._staged.setdefault(table, set()).update(new)
        self.touched.added += len(new)

    def _drop(self, table: str, files: Sequence[str]) -> None:
        gone = set(files)
        self._files[table] = [f for f in self.files(table) if f not in gone]
        self._gone.setdefault(table, set()).update(gone - self._staged.get(table, set()))
        self._staged.get(table, set()).difference_update(gone)
        self._rewrote.add(table)
        self.touched.rewritten += len(gone)

    def _rewrite(self, table: str, files: Sequence[str], change: Callable[[DataFrame], DataFrame]) -> None:
        """The rows of ``files`` become what ``change`` makes of them; the other files stay."""
        self._rewrote.add(table)
        self._stage(table, change(self._scan(table, files)))
        self._drop(table, files)

    def create(
        self, table: str, rows: DataFrame, keys: Sequence[str] = (), partition_by: Sequence[str] = (), files: int | None = None
    ) -> None:
        """A new table with rows: by ranges of the key if it has one, a folder for each partition value."""
        if table in self.tables:
            raise ValueError(f"table {table} exists")
        self.tables[table] = {
            "schema": rows.schema.jsonValue(), "keys": list(keys), "partition": list(partition_by), "added": [], "removed": [],
        }
        self._files[table] = []
        self._created.add(table)
        ranged = keys and not partition_by
        self._stage(table, rows, (lambda r: r.repartitionByRange(files, *keys) if files else r.repartitionByRange(*keys)) if ranged else None)

    def insert(self, table: str, batch: DataFrame) -> None:
        self._stage(table, W.insert(self._scan(table, []), batch))

    def replace(self, table: str, batch: DataFrame) -> None:
        """Rows with a key of the batch go, all batch rows come."""
        keys = self._meta(table)["keys"]
        self._rewrite(table, self._holding(table, batch.select(*keys)), lambda rows: W.replace(rows, batch, keys))

    def upsert(self, table: str, batch: DataFrame, update_columns: Sequence[str] | None = None) -> None:
        keys = self._meta(table)["keys"]
        self._rewrite(table, self._holding(table, batch.select(*keys)), lambda rows: W.upsert(rows, batch, keys, update_columns))

    def delete_keys(self, table: str, batch: DataFrame) -> None:
        keys = self._meta(table)["keys"]
        self._rewrite(table, self._holding(table, batch.select(*keys)), lambda rows: W.without_keys_of(rows, batch, keys))

    def _where(self, table: str, predicate: str | Column) -> list[str]:
        condition = F.expr(predicate) if isinstance(predicate, str) else predicate
        rows = self._scan(table, self.files(table), F.col("_metadata.file_path")) if self.files(table) else None
        return [] if rows is None else self._paths(rows.where(condition))

    def delete(self, table: str, predicate: str | Column) -> None:
        self._rewrite(table, self._where(table, predicate), lambda rows: W.delete_where(rows, predicate))

    def update(self, table: str, predicate: str | Column, assignments: Mapping[str, str | Column]) -> None:
        self._rewrite(table, self._where(table, predicate), lambda rows: W.update_where(rows, predicate, assignments))

    def truncate(self, table: str) -> None:
        self._drop(table, self.files(table))

    def drop_partitions(self, table: str, below: str, border: str | Column | None = None) -> None:
        """Partitions whose label is less than ``below`` go without being read; of the partition ``below`` itself the
        rows for which ``border`` is true go, so that it alone is rewritten. Files without a label stay."""
        labels = {r.path: r.label for r in self._entries(table).select("path", "label").collect()}
        now = set(self.files(table))
        self._drop(table, [p for p, label in labels.items() if p in now and label is not None and label < below])
        edge = [p for p, label in labels.items() if p in now and label == below]
        if border is not None and edge:
            condition = F.expr(border) if isinstance(border, str) else border
            holding = self._paths(self._scan(table, edge, F.col("_metadata.file_path")).where(condition))
            self._rewrite(table, holding, lambda rows: W.delete_where(rows, border))

    def apply(self, operations: Sequence[W.Operation]) -> None:
        """Operations of ``plumbspark.operators.writes`` in order, on stored tables."""
        for op in operations:
            if isinstance(op, W.CreateTable):
                if op.table not in self.tables:
                    self.create(op.table, W.create_table(self.spark, op.ddl))
            elif isinstance(op, W.Insert):
                self.insert(op.table, op.rows)
            elif isinstance(op, W.Delete):
                self.delete(op.table, op.predicate)
            elif isinstance(op, W.Update):
                self.update(op.table, op.predicate, op.assignments)
            elif isinstance(op, W.Truncate):
                self.truncate(op.table)
            else:
                raise ValueError(f"unknown operation: {op!r}")

    # --- committing --------------------------------------------------------------------

    def _index(self, table: str, files: Sequence[str]) -> DataFrame:
        """The list rows of staged files: two passes over their key columns."""
        meta = self._meta(table)
        path = F.col("_metadata.file_path")
        label = F.col(quoted(meta["partition"][0])).cast("string") if meta["partition"] else F.lit(None).cast("string")
        key = F.col(quoted(meta["keys"][0])) if meta["keys"] else F.lit(None).cast("string")
        scan = self._raw(table, files)
        facts = scan.groupBy(path.alias("path")).agg(
            F.count(F.lit(1)).alias("n"), F.max("_metadata.file_size").alias("bytes"), F.max(label).alias("label"),
            F.min(key).alias("low"), F.max(key).alias("high"),
        )
        if not meta["keys"]:
            return facts.withColumn("filter", F.lit(None).cast("binary"))
        hashed = scan.where(all_set(meta["keys"])).select(path.alias("path"), _hash(meta["keys"]).alias("h"))
        return facts.join(_key_filters(hashed), "path", "left")

    def _violations(self, constraints: Mapping[str, Mapping[str, str | Column]], unique: Mapping[str, Sequence[Sequence[str]]]) -> list[str]:
        broken = []
        for table, rules in constraints.items():
            staged = sorted(self._staged.get(table, ()))
            if staged and rules:
                counts = self._scan(table, staged).agg(*[violation_count(c).alias(f"v{i}") for i, c in enumerate(rules.values())]).first()
                broken += [f"{table}.{name}: {counts[i]} rows" for i, name in enumerate(rules) if counts[i]]
        for table, sets in unique.items():
            staged = sorted(self._staged.get(table, ()))
            for keys in sets if staged else ():
                new = self._scan(table, staged).where(all_set(list(keys))).select(*keys)
                near = sorted({*self._candidates(table, new), *staged})
                held = self._scan(table, near).select(*keys).join(new.distinct(), list(keys), "left_semi")
                if duplicate_keys(held, keys).select(F.lit(1)).head(1):
                    broken.append(f"{table}: duplicate {list(keys)}")
        return broken

    def rollback(self) -> None:
        """The staged files go; the snapshot that readers see was never touched."""
        for folder in self._folders:
            remove(self.spark, folder)
        self._folders = []

    def commit(
        self, constraints: Mapping[str, Mapping[str, str | Column]] | None = None, unique: Mapping[str, Sequence[Sequence[str]]] | None = None
    ) -> int:
        """The new version, or ``RejectedWrite`` if a staged row breaks a constraint or a staged key is not unique, or
        ``Conflict`` if a table that was rewritten has changed since; both leave the tables as they were.

        Mere insertions into a table that others changed meanwhile are carried over to its new state.
        """
        broken = self._violations(constraints or {}, unique or {})
        if broken:
            self.rollback()
            raise RejectedWrite("; ".join(broken))
        changes = {}
        for table in sorted({*self._staged, *self._gone, *self._created}):
            lists = {"added": [], "removed": []}
            for kind, rows in (("added", self._staged.get(table)), ("removed", self._gone.get(table))):
                if rows:
                    lists[kind] = [f"{self.store.folder}/lists/{table}/{kind}-{uuid.uuid4().hex}"]
                    frame = (
                        self._index(table, sorted(rows)) if kind == "added" else self.spark.createDataFrame([(p,) for p in sorted(rows)], "path string")
                    )
                    frame.write.parquet(lists[kind][0])
            changes[table] = lists
        strict = self._rewrote | set(unique or ())
        base = self.store.manifest(self.base)["tables"]
        while True:
            latest = self.store.version()
            tables = self.store.manifest(latest)["tables"]
            for table, lists in changes.items():
                before, now = base.get(table), tables.get(table)
                if before != now and (table in strict or table in self._created):
                    self.rollback()
                    raise Conflict(f"{table} changed in version {latest}")
                held = now or {**self.tables[table], "added": [], "removed": []}
                tables[table] = {**held, "added": held["added"] + lists["added"], "removed": held["removed"] + lists["removed"]}
                if len(tables[table]["added"]) + len(tables[table]["removed"]) > LISTS:
                    tables[table] = self._merged(table, tables[table])
            text = json.dumps({"version": latest + 1, "tables": tables})
            if _publish_text(self.spark, f"{self.store.folder}/log/{latest + 1:012d}.json", text):
                return latest + 1

    def _merged(self, table: str, meta: dict) -> dict:
        """The live entries of many lists as one list."""
        t = Transaction(self.store, 0)
        t.tables = {table: meta}
        path = f"{self.store.folder}/lists/{table}/added-{uuid.uuid4().hex}"
        t._entries(table).write.parquet(path)
        return {**meta, "added": [path], "removed": []}


def _plain(k: pa.ChunkedArray) -> np.ndarray:
    if pa.types.is_temporal(k.type):
        k = k.cast(pa.int32()).cast(pa.int64()) if pa.types.is_date32(k.type) else k.cast(pa.int64())
    return k.to_numpy() if pa.types.is_integer(k.type) or pa.types.is_floating(k.type) else np.array(k.to_pylist(), object)


def _admitted(given):
    """Of files (path, low, high, filter) those whose filter holds a given key within their range."""

    def run(batches):
        k, h = given.value
        for b in batches:
            low, high = (_plain(pa.chunked_array([b.column(c)])) for c in ("low", "high"))
            keep = []
            for i, raw in enumerate(b.column("filter").to_pylist()):
                own = h[np.searchsorted(k, low[i], "left") : np.searchsorted(k, high[i], "right")]
                if raw is None or not len(own):
                    keep.append(raw is None)
                    continue
                words, marks = np.frombuffer(raw, np.uint64), _marks(own)
                keep.append(bool(((words[_words(own, len(words))] & marks) == marks).any()))
            yield pa.RecordBatch.from_arrays([b.column("path").filter(pa.array(keep, pa.bool_()))], ["path"])

    return run
