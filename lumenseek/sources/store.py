"""A versioned store of tables in a folder.

A table is a list of segments. An update appends segments with the new rows of some paths and a list of the paths whose
older rows are gone; readers leave those out. Every commit writes the next state file, which must not exist yet, so all
of an update becomes visible at once, and of two writers one finds its number taken and starts from what the other has
written; opening and reading a store write nothing. Tables: files, chunks, forward (a unit's terms), blocks (a term's
units), terms, norms, vectors, and key-value metadata. `terms` and `norms` hold signed numbers that are added when read.
"""

from __future__ import annotations

import atexit
import hashlib
import json
import os
import shutil
import tempfile
import uuid
import weakref
from collections.abc import Callable
from functools import reduce

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

SCHEMA_VERSION = "3"
#: Segments of a table from which an update rewrites it as one, and state files that vacuum() keeps.
MAX_SEGMENTS, KEPT_STATES = 32, 8
#: Rows of a page, the least that a look-up reads of a column.
PAGE_ROWS = 1000
_UNIT = "path string, start_line int, end_line int"
TABLES = {
    "files": "path string, content string, hash string, size long, mtime timestamp, language string",
    "chunks": f"{_UNIT}, symbol_name string, chunk_type string, text string, tokens array<string>, metadata variant",
    "forward": f"{_UNIT}, doc_len long, terms array<struct<term: string, raw_freq: bigint>>",
    "blocks": "term string, block int, n int, bound double, docs array<struct<path: string, start_line: int, end_line: int, raw_freq: bigint, doc_len: bigint>>",
    "terms": "term string, df long",
    "norms": f"{_UNIT}, s0 double, s1 double, s2 double",
    "vectors": "id string, vector array<float>, type string, language string, content string, category string, path string, metadata_json string",
    "failures": "id string, path string, error string",
}
#: Tables in the order of a column, so that look-ups by it skip most of a segment, and sums by key.
SORTED = {"files": "path", "chunks": "path", "terms": "term"}
SUMMED = {"terms": ["term"], "norms": ["path", "start_line", "end_line"]}


class Conflict(RuntimeError):
    """Rows have been committed since the state that a change was made from."""


def data_dir(root: str, base: str | None = None) -> str:
    """The folder of a project: the first 16 digits of its absolute path's SHA-256."""
    name = hashlib.sha256(os.path.abspath(root).encode()).hexdigest()[:16]
    return os.path.join(base or os.path.join(os.path.expanduser("~"), ".lumenseek"), "projects", name)


_own: list[str] = []


def temporary_folder(spark: SparkSession, name: str) -> str:
    """A new folder below spark.checkpoint.dir, which driver and executors share; where that is unset and everything runs
    in one process, one that goes when the process ends."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared is None:
        master = spark.sparkContext.master
        if not (master == "local" or master.startswith("local[")):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        if not _own:
            _own.append(tempfile.mkdtemp(prefix="lumenseek-"))
            atexit.register(shutil.rmtree, _own[0], ignore_errors=True)
        shared = _own[0]
    return f"{shared}/lumenseek-stores/{uuid.uuid4().hex}-{name}"


def migrated(state: dict) -> dict:
    """A state of an older schema in the present one. Version 1 had one folder per table; before 3 the inverted index had
    one row per posting and there was no forward index, so the next index() builds anew."""
    version = state.setdefault("schema_version", SCHEMA_VERSION)
    if version == "1":
        state |= {"tables": {t: [[folder, 1]] for t, folder in state["tables"].items()}, "gone": [], "seq": 1}
    if version in ("1", "2"):
        state |= {"schema_version": SCHEMA_VERSION, "tables": {t: x for t, x in state["tables"].items() if t in ("files", "terms", "vectors")}}
        state["metadata"].pop("root", None)
    if state["schema_version"] != SCHEMA_VERSION:
        raise ValueError(f"the store has schema {state['schema_version']}, not {SCHEMA_VERSION}")
    return state


def scratch(df: DataFrame, name: str) -> DataFrame:
    """df written to a temporary_folder() and read back, for rows that a query reads several times."""
    folder = temporary_folder(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


class Folder:
    """Small files in a folder of any file system that Spark can write to."""

    def __init__(self, spark: SparkSession, path: str):
        self.fs_package = spark._jvm.org.apache.hadoop.fs
        self.io = spark._jvm.org.apache.commons.io.IOUtils
        self.configuration, self.gateway = spark._jsc.hadoopConfiguration(), spark.sparkContext._gateway
        self.path = self.fs_package.Path(path if "://" in path else f"file://{os.path.abspath(path)}")
        self.fs = self.path.getFileSystem(self.configuration)
        self.fs.mkdirs(self.path)

    def at(self, name: str):
        return self.fs_package.Path(self.path, name)

    def read(self, name: str) -> str | None:
        if not self.fs.exists(self.at(name)):
            return None
        stream = self.fs.open(self.at(name))
        try:
            return self.io.toString(stream, "UTF-8")
        finally:
            stream.close()

    def create(self, name: str, text: str) -> bool:
        """A new file with all of its text, or False where one of that name exists already."""
        temporary = self.at(f"{os.path.dirname(name) or '.'}/.{uuid.uuid4().hex}")
        stream = self.fs.create(temporary, True)
        try:
            stream.write(bytearray(text.encode()))
        finally:
            stream.close()
        try:
            if self.fs.getUri().getScheme() == "file":  # whose rename would replace the other
                os.link(temporary.toUri().getPath(), self.at(name).toUri().getPath())
            else:
                self.fs_package.FileContext.getFileContext(self.path.toUri(), self.configuration).rename(temporary, self.at(name), self.gateway.new_array(self.fs_package.Options.Rename, 0))
        except FileExistsError:
            return False
        except Py4JJavaError as e:
            if "FileAlreadyExists" not in str(e.java_exception):
                raise
            return False
        finally:
            self.fs.delete(temporary, False)
        return True

    def names(self, folder: str = ".") -> list[str]:
        at = self.at(folder)
        return [x.getPath().getName() for x in self.fs.listStatus(at)] if self.fs.exists(at) else []

    def remove(self, name: str) -> None:
        self.fs.delete(self.at(name), True)


class Store:
    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")
        self._files = Folder(spark, folder)
        self._staged: weakref.WeakKeyDictionary[DataFrame, str] = weakref.WeakKeyDictionary()
        self.state()

    # states

    def state(self) -> dict:
        """The newest state. Reads that take it see one version of all tables."""
        for attempt in range(3):
            numbers = [int(x[:-5]) for x in self._files.names("states") if x[:-5].isdigit() and x.endswith(".json")]
            # vacuum() may take a state away between the listing and the look
            text = self._files.read(f"states/{max(numbers):012d}.json") if numbers else self._files.read("state.json")
            if text or not numbers:
                break
        else:
            raise OSError(f"no state can be read in {self.folder}")
        state = migrated(json.loads(text)) if text else {"schema_version": SCHEMA_VERSION, "tables": {}, "gone": [], "seq": 0, "metadata": {}}
        return state | {"version": max(numbers, default=0)}

    def _save(self, state: dict) -> bool:
        """False where the next version has been written by another."""
        version = state.get("version", 0) + 1
        return self._files.create(f"states/{version:012d}.json", json.dumps({k: v for k, v in state.items() if k != "version"}, indent=1, sort_keys=True))

    def _change(self, change: Callable[[dict], None], since: dict | None = None) -> None:
        """Applies a change to the newest state, again where another writer came first. since: the state that it was made
        from; rows committed after that raise Conflict."""
        for attempt in range(100):
            state = self.state()
            if since is not None and state["seq"] != since["seq"]:
                raise Conflict(f"rows came after version {since['version']} of {self.folder}")
            change(state)
            if self._save(state):
                return
        raise Conflict(f"too many writers in {self.folder}")

    def _at(self, name: str) -> str:
        return str(self._files.at(name).toString())

    # tables

    def _schema(self, table: str) -> str:
        return "path string" if table == "gone" else TABLES[table]

    def _segments(self, table: str, segments: list, where: Column | None = None) -> DataFrame:
        """Rows of segments with their number _seq; where is tested in the scan of each."""
        read = lambda folder, seq: self.spark.read.schema(self._schema(table)).parquet(self._at(folder)).withColumn("_seq", F.lit(seq))
        return reduce(DataFrame.unionByName, (x if where is None else x.where(where) for x in (read(*y) for y in segments)))

    def _alive(self, rows: DataFrame, state: dict, since: int, table: str) -> DataFrame:
        """rows (path, _seq) of a table without those of paths that went later, and without _seq."""
        gone = [x[:2] for x in state["gone"] if x[1] > since and x[2:] in ([], [table])]
        if gone:
            dead = self._segments("gone", gone).groupBy("path").agg(F.max("_seq").alias("_dead"))
            rows = rows.join(dead, "path", "left").where("_dead IS NULL OR _seq >= _dead").select([c for c in rows.columns])
        return rows.drop("_seq")

    def read(self, table: str, where: Column | None = None, state: dict | None = None) -> DataFrame:
        """The rows of a table; where is tested in the scan of every segment. Rows of `blocks` still list units that are
        gone: postings() does not."""
        state = state or self.state()
        segments = state["tables"].get(table)
        if not segments:
            return self.spark.createDataFrame([], self._schema(table))
        rows = self._segments(table, segments, where)
        rows = self._alive(rows, state, segments[0][1], table) if "path" in rows.columns else rows.drop("_seq")
        if by := SUMMED.get(table):
            rows = rows.groupBy(*by).agg(*(F.sum(c).alias(c) for c in rows.columns if c not in by))
            rows = rows.where("df > 0") if table == "terms" else rows
        return rows

    def stage(self, table: str, df: DataFrame, seen: Observation | None = None, counts: dict[str, Column] | None = None, ordered: bool = False) -> DataFrame:
        """df written as a segment that no reader sees before commit(); returns its rows. seen: what is told of the rows
        as they are written, namely counts. ordered: rows lie in the table's order already and are not dealt anew."""
        folder = f"{table}-{uuid.uuid4().hex}"
        schema = self.spark.createDataFrame([], self._schema(table)).schema
        rows = df.select(*((F.col(f.name).cast(f.dataType) if f.name in df.columns else F.lit(None).cast(f.dataType)).alias(f.name) for f in schema.fields))
        if (by := SORTED.get(table)) and not ordered:
            rows = rows.repartitionByRange(by).sortWithinPartitions(by)
        if seen is not None:
            rows = rows.observe(seen, *(c.alias(n) for n, c in counts.items()))
        rows.write.option("parquet.page.row.count.limit", PAGE_ROWS).option("compression", "zstd").parquet(self._at(folder))
        out = self.spark.read.schema(schema).parquet(self._at(folder))
        self._staged[out] = folder
        return out

    def commit(self, *, replace: dict[str, DataFrame] | None = None, append: dict[str, DataFrame] | None = None, gone: DataFrame | None = None, only: str | None = None, metadata: dict | None = None, add: dict[str, int] | None = None, since: dict | None = None) -> None:
        """Tables are replaced or get another segment; older rows of the paths in gone go, of one table or of all; numbers of `add` join those of
        the metadata. One new state file makes all of it visible; what is replaced stays on disk until vacuum(). since:
        the state that these rows were made from; a commit in between raises Conflict."""
        folder = lambda table, df: self._staged.get(df) or self._staged[self.stage(table, df)]
        new = {t: (folder(t, df), False) for t, df in (append or {}).items()} | {t: (folder(t, df), True) for t, df in (replace or {}).items()}
        tombstones = folder("gone", gone.select("path").distinct()) if gone is not None else None

        def change(state: dict) -> None:
            state["seq"] += 1
            for table, (name, whole) in new.items():
                state["tables"][table] = [*([] if whole else state["tables"].get(table, [])), [name, state["seq"]]]
            if tombstones:
                state["gone"].append([tombstones, state["seq"], *([only] if only else [])])
            state["metadata"] |= metadata or {}
            for key, n in (add or {}).items():
                state["metadata"][key] = state["metadata"].get(key, 0) + n

        self._change(change, since)

    def write(self, table: str, df: DataFrame, since: dict | None = None) -> None:
        """Replaces a table; df may read its old rows."""
        self.commit(replace={table: df}, since=since)

    def compact(self) -> None:
        """Every table in one segment, and no list of what is gone. Raises Conflict where rows come meanwhile."""
        state = self.state()
        rows = {t: self.postings_as_blocks(state) if t == "blocks" else self.read(t, state=state) for t in state["tables"]}
        folders = {t: self._staged[self.stage(t, df)] for t, df in rows.items()}

        def change(now: dict) -> None:
            now["seq"] += 1
            now |= {"tables": {t: [[folder, now["seq"]]] for t, folder in folders.items()}, "gone": []}

        self._change(change, state)

    def describe(self, root: str, created: str) -> None:
        """A small file beside the tables that says whose index this is."""
        self._files.create("metadata.json", json.dumps({"projectRoot": root, "createdAt": created, "schemaVersion": SCHEMA_VERSION}, indent=1))

    def check_root(self, root: str) -> None:
        """Raises where this is the index of another folder."""
        if (stored := self.get_metadata("root")) not in (None, root):
            raise ValueError(f"{self.folder} is the index of {stored}, not of {root}")

    def segments(self) -> int:
        return max(map(len, self.state()["tables"].values()), default=0)

    def upsert(self, table: str, rows: DataFrame, key: str = "path") -> None:
        """Rows of the same key are replaced; of equal keys in rows one stays, the last by hash of its columns."""
        one = rows.withColumn("_r", F.row_number().over(W.partitionBy(key).orderBy(F.xxhash64(*rows.columns)))).where("_r = 1").drop("_r")
        self.replace_keys(table, one, one, key)

    def replace_keys(self, table: str, keys: DataFrame, rows: DataFrame, key: str = "path") -> None:
        """All rows of keys go, rows come: for tables with several rows per key. By path this writes the new rows and a list
        of paths; other tables are written anew."""
        if key == "path" and table != "blocks" and "path" in self._schema(table):
            self.commit(append={table: rows}, gone=keys, only=table)
        else:
            self._rewrite(table, lambda old: old.join(keys.select(key).distinct(), key, "left_anti").unionByName(rows, allowMissingColumns=True))

    def store_chunks(self, rows: DataFrame) -> DataFrame:
        """All chunks of the rows' paths go, rows (columns of the table chunks) come; returns id, path, start_line,
        end_line of what came. Raises where a path is no file of the store."""
        missing = rows.join(self.read("files").select("path"), "path", "left_anti").select("path").head()
        if missing:
            raise ValueError(f"{missing.path} is not a file of the store")
        self.replace_keys("chunks", rows.select("path"), rows)
        return rows.select(F.format_string("chunk://%s:%d-%d", "path", "start_line", "end_line").alias("id"), "path", "start_line", "end_line")

    def delete(self, table: str, keys: DataFrame, key: str = "path") -> None:
        self.replace_keys(table, keys, self.spark.createDataFrame([], self._schema(table)), key)

    def _rewrite(self, table: str, change: Callable[[DataFrame], DataFrame]) -> None:
        """Replaces a table by a change of its rows, made again from the newer rows where another writer came first."""
        for attempt in range(5):
            state = self.state()
            try:
                return self.write(table, change(self.read(table, state=state)), since=state)
            except Conflict:
                if attempt == 4:
                    raise

    def delete_files(self, paths: DataFrame) -> None:
        """Files with all that was made from them. Engine.update() also takes them out of counts."""
        self.commit(gone=paths)

    def clear(self) -> None:
        self._change(lambda state: state.update(tables={}, gone=[], metadata={}, seq=state["seq"] + 1))

    def vacuum(self) -> None:
        """Removes folders that the newest state does not name, and older states but the last few."""
        state = self.state()
        used = {x[0] for segments in [*state["tables"].values(), state["gone"]] for x in segments}
        for name in self._files.names():
            if name.split("-")[0] in (*TABLES, "gone", "postings", "scratch") and name not in used:
                self._files.remove(name)
        for name in self._files.names("states"):
            if name[:-5].isdigit() and int(name[:-5]) <= state["version"] - KEPT_STATES:
                self._files.remove(f"states/{name}")

    # look-ups

    def get(self, table: str, value: str, key: str = "path") -> DataFrame:
        return self.read(table, F.col(key) == value)

    def exists(self, table: str, value: str, key: str = "path") -> bool:
        return self.get(table, value, key).head() is not None

    def count(self, table: str) -> int:
        return self.read(table).count()

    def file_metadata(self) -> DataFrame:
        return self.read("files").select("path", "mtime", "hash")

    def terms(self, terms: list[str] | None = None, state: dict | None = None) -> DataFrame:
        return self.read("terms", None if terms is None else F.col("term").isin(terms), state)

    def postings(self, where: Column | None = None, state: dict | None = None, paths: Column | None = None) -> DataFrame:
        """path, start_line, end_line, term, raw_freq, doc_len of the blocks for which where holds (term, block, bound),
        without units that are gone. where is tested in the scan, which skips what cannot hold such terms; paths is a
        condition on path."""
        state = state or self.state()
        segments = state["tables"].get("blocks")
        if not segments:
            return self.spark.createDataFrame([], f"{_UNIT}, term string, raw_freq long, doc_len long")
        rows = self._segments("blocks", segments, where).select("term", "_seq", F.inline("docs"))
        rows = self._alive(rows if paths is None else rows.where(paths), state, segments[0][1], "blocks")
        return rows.select("path", "start_line", "end_line", "term", "raw_freq", "doc_len")

    def postings_of_terms(self, terms: DataFrame, state: dict) -> DataFrame:
        """postings() of the terms of a table (term), whose blocks are found before they are opened."""
        segments = state["tables"].get("blocks")
        if not segments:
            return self.postings(state=state)
        rows = self._segments("blocks", segments).join(terms, "term", "left_semi").select("term", "_seq", F.inline("docs"))
        return self._alive(rows, state, segments[0][1], "blocks").select("path", "start_line", "end_line", "term", "raw_freq", "doc_len")

    def stage_scratch(self, df: DataFrame, name: str) -> DataFrame:
        """df written and read back, for rows that several tables are made from; vacuum() takes it away."""
        folder = f"scratch-{uuid.uuid4().hex}-{name}"
        df.write.parquet(self._at(folder))
        return self.spark.read.schema(df.schema).parquet(self._at(folder))

    def postings_as_blocks(self, state: dict) -> DataFrame:
        """Blocks of one segment instead of many, without units that are gone."""
        from lumenseek.operators.inverted import blocks_of

        return blocks_of(self.postings(state=state), ["path", "start_line", "end_line"], state["metadata"].get("mean_len", 1.0))

    def terms_of(self, paths: DataFrame) -> DataFrame:
        """Distinct terms of some files, from the forward index."""
        rows = self.read("forward").join(paths.select("path").distinct(), "path", "left_semi")
        return rows.select(F.explode("terms.term").alias("term")).distinct()

    def set_metadata(self, key: str, value) -> None:
        self._change(lambda state: state["metadata"].update({key: value}))

    def get_metadata(self, key: str, default=None):
        return self.state()["metadata"].get(key, default)


class MemoryStore:
    """Files of one session, by path, without a folder: puts and deletes replace a cached table."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.files = spark.createDataFrame([], TABLES["files"])

    def _keep(self, files: DataFrame) -> None:
        old, self.files = self.files, files.persist()
        self.files.count()
        old.unpersist()

    def store(self, rows: DataFrame) -> None:
        """Rows of the same path are replaced."""
        self._keep(self.files.join(rows.select("path"), "path", "left_anti").unionByName(rows, allowMissingColumns=True))

    def delete(self, path: str) -> bool:
        found = self.exists(path)
        if found:
            self._keep(self.files.where(F.col("path") != path))
        return found

    def get(self, path: str) -> DataFrame:
        return self.files.where(F.col("path") == path)

    def exists(self, path: str) -> bool:
        return self.get(path).head() is not None

    def count(self) -> int:
        return self.files.count()

    def clear(self) -> None:
        self._keep(self.spark.createDataFrame([], TABLES["files"]))


class VectorStore:
    """Dense vectors of one dimension in a store."""

    def __init__(self, store: Store, dimensions: int):
        self.store, self.dimensions = store, dimensions

    def _checked(self, rows: DataFrame) -> DataFrame:
        if bad := rows.where((F.size("vector") != self.dimensions) | F.col("vector").isNull() | F.col("id").isNull()).count():
            raise ValueError(f"{bad} vectors have no id or not {self.dimensions} dimensions")
        return rows

    def add(self, rows: DataFrame) -> None:
        rows = self._checked(rows)
        state = self.store.state()
        known = self.store.read("vectors", state=state)
        if rows.join(known.select("id"), "id", "left_semi").head() or rows.groupBy("id").count().where("count > 1").head():
            raise ValueError("ids exist already or repeat")
        self.store.commit(append={"vectors": rows}, since=state)

    def update(self, rows: DataFrame) -> None:
        self.store.upsert("vectors", self._checked(rows), "id")

    def delete(self, doc_id: str) -> bool:
        found = self.store.exists("vectors", doc_id, "id")
        if found:
            self.store.delete("vectors", self.store.get("vectors", doc_id, "id").select("id"), "id")
        return found

    def delete_path(self, path: str) -> None:
        self.store.delete("vectors", self.store.spark.createDataFrame([(path,)], "path string"))

    def get(self, doc_id: str) -> DataFrame:
        return self.store.get("vectors", doc_id, "id")

    def rows(self) -> DataFrame:
        return self.store.read("vectors")

    def stats(self) -> dict:
        return {"count": self.store.count("vectors"), "dimensions": self.dimensions}
