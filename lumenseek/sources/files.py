"""File trees as tables.

`scan` uses Spark's binary reader, in parallel and with size filters pushed into it; it does not see names that start
with a dot or underscore. The `codetree` data source sees them all. Folders are its partitions: the driver lists the upper
ones only, until there are a few per partition, and tasks list what is below. Conditions on path, size and time are tested
before a file is opened, named paths are looked at without a listing, and contents are read only if the schema asks for
them.
"""

from __future__ import annotations

import datetime
import os
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import datasource as D
from pyspark.sql.types import StructType

from lumenseek.functions.paths import MAX_FILE_BYTES, display_language, has_skipped_segment, is_indexable, is_text_file
from lumenseek.sources.ignore import Ignore

SCHEMA = "path string, size long, mtime timestamp, content binary"
METADATA = "path string, size long, mtime timestamp"
#: Folders per partition from which the driver lists no further.
SPREAD = 4


def load_ignore(root: str) -> Ignore:
    """The default patterns and those of the root's own .gitignore."""
    try:
        with open(os.path.join(root, ".gitignore"), encoding="utf-8", errors="replace") as f:
            return Ignore(f.read().splitlines())
    except OSError:
        return Ignore()


def scan(spark: SparkSession, root: str, max_bytes: int = MAX_FILE_BYTES) -> DataFrame:
    """path (relative), size, mtime, content (string, empty where it is not UTF-8), hash, language of text files."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root).where(F.col("length") <= max_bytes)
    start = root.rstrip("/").removeprefix("file://") + "/"
    relative = F.element_at(F.split("path", start.replace("\\", "\\\\").replace(".", "\\."), 2), 2)
    files = raw.select(relative.alias("path"), F.col("length").alias("size"), F.col("modificationTime").alias("mtime"), "content")
    return described(files.where(is_text_file(F.col("path"))))


def described(files: DataFrame) -> DataFrame:
    text = F.coalesce(F.try_validate_utf8(F.decode("content", "UTF-8")) if hasattr(F, "try_validate_utf8") else F.decode("content", "UTF-8"), F.lit(""))
    return files.select("path", "size", "mtime", text.alias("content"), F.sha2("content", 256).alias("hash"), display_language(F.col("path")).alias("language"))


def covered(path: Column) -> Column:
    """Whether the strict code index covers a path."""
    return is_indexable(path) & ~has_skipped_segment(path)


def inventory(files: DataFrame) -> DataFrame:
    """path, hash of the files that the strict code index covers."""
    return files.where(covered(F.col("path"))).select("path", "hash")


@dataclass(frozen=True)
class _Folders(D.InputPartition):
    """Folders (relative, "" for the root) with all below them, folders without what is below, and named files."""

    whole: list[str] = field(default_factory=list)
    flat: list[str] = field(default_factory=list)
    named: list[str] = field(default_factory=list)


def _test(column: str, f: D.Filter) -> Callable[[object], bool] | None:
    """A condition on one column of a file that can be tested without its contents."""
    same = lambda x: x
    kinds = {D.EqualTo: lambda x, v: x == v, D.LessThan: lambda x, v: x < v, D.LessThanOrEqual: lambda x, v: x <= v, D.GreaterThan: lambda x, v: x > v, D.GreaterThanOrEqual: lambda x, v: x >= v}
    if column == "path":
        kinds |= {D.In: lambda x, v: x in v, D.StringStartsWith: lambda x, v: x.startswith(v), D.StringEndsWith: lambda x, v: x.endswith(v), D.StringContains: lambda x, v: v in x}
    elif column == "mtime":
        same = lambda v: v.timestamp()
    elif column != "size":
        return None
    if isinstance(f, D.IsNotNull):
        return lambda x: True
    test = kinds.get(type(f))
    if test is None:
        return None
    value = frozenset(f.value) if isinstance(f, D.In) else same(f.value)
    return lambda x: test(x, value)


class _TreeReader(D.DataSourceReader):
    def __init__(self, options: dict, schema: StructType):
        self.root, self.max_bytes = options["path"].removeprefix("file://"), int(options.get("maxbytes", MAX_FILE_BYTES))
        self.parts, self.columns = int(options.get("partitions", 8)), schema.fieldNames()
        self.tests: list[tuple[str, D.Filter]] = []

    def pushFilters(self, filters: list[D.Filter]) -> Iterable[D.Filter]:
        for f in filters:
            column = ".".join(f.attribute) if hasattr(f, "attribute") else ""
            if _test(column, f):
                self.tests.append((column, f))
            else:
                yield f

    def _named(self) -> list[str] | None:
        """The paths that conditions leave, if they name them."""
        sets = [frozenset(f.value) if isinstance(f, D.In) else {f.value} for c, f in self.tests if c == "path" and isinstance(f, (D.In, D.EqualTo))]
        return sorted(p for p in frozenset.intersection(*map(frozenset, sets)) if p) if sets else None

    def partitions(self) -> list[_Folders]:
        if (named := self._named()) is not None:
            return [_Folders(named=named[i :: self.parts]) for i in range(min(self.parts, len(named)) or 1)]
        ignore, flat, whole = load_ignore(self.root), [], [""]
        while whole and len(whole) < SPREAD * self.parts:
            flat += whole
            whole = sorted(d for folder in whole for d, is_folder, _ in _listed(self.root, folder, ignore) if is_folder)
            if not whole:
                break
        return [_Folders(whole[i :: self.parts], flat[i :: self.parts]) for i in range(min(self.parts, len(whole) + len(flat)) or 1)]

    def read(self, partition: _Folders) -> Iterator[tuple]:
        ignore = load_ignore(self.root)
        tests = [(c, _test(c, f)) for c, f in self.tests]
        for path, stat in self._files(partition, ignore):
            told = {"path": path, "size": stat.st_size, "mtime": stat.st_mtime}
            if stat.st_size > self.max_bytes or not all(t(told[c]) for c, t in tests):
                continue
            told["mtime"] = datetime.datetime.fromtimestamp(stat.st_mtime, datetime.UTC)
            if "content" in self.columns:
                try:
                    with open(os.path.join(self.root, path), "rb") as f:
                        told["content"] = f.read()
                except OSError:
                    continue
            yield tuple(told[c] for c in self.columns)

    def _files(self, partition: _Folders, ignore: Ignore) -> Iterator[tuple[str, os.stat_result]]:
        for path in partition.named:
            try:
                stat = os.stat(os.path.join(self.root, path))
            except OSError:
                continue
            if os.path.isfile(os.path.join(self.root, path)) and not ignore(path):
                yield path, stat
        todo = [(d, True) for d in partition.whole] + [(d, False) for d in partition.flat]
        while todo:
            folder, below = todo.pop()
            for path, is_folder, stat in _listed(self.root, folder, ignore):
                if not is_folder:
                    yield path, stat
                elif below:
                    todo.append((path, True))


def _listed(root: str, folder: str, ignore: Ignore) -> Iterator[tuple[str, bool, os.stat_result | None]]:
    """path, whether it is a folder, and a file's status, of what is in a folder and not ignored. Links to folders are not
    followed."""
    try:
        entries = os.scandir(os.path.join(root, folder))
    except OSError:
        return
    with entries:
        for e in entries:
            path = f"{folder}/{e.name}" if folder else e.name
            try:
                if e.is_dir(follow_symlinks=False):
                    if not ignore(path) and not ignore(path + "/x"):
                        yield path, True, None
                elif e.is_file() and not ignore(path):
                    yield path, False, e.stat()
            except OSError:
                continue


class CodeTree(D.DataSource):
    """spark.read.format("codetree").load(root); with .schema(METADATA) no file is opened."""

    @classmethod
    def name(cls) -> str:
        return "codetree"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> D.DataSourceReader:
        return _TreeReader(dict(self.options), schema)


def _tree(spark: SparkSession, root: str, schema: str, max_bytes: int, parts: int | None) -> DataFrame:
    spark.dataSource.register(CodeTree)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")  # without it, a source that takes filters is refused
    parts = parts or spark.sparkContext.defaultParallelism
    return spark.read.format("codetree").schema(schema).option("maxbytes", max_bytes).option("partitions", parts).load(root)


def tree_metadata(spark: SparkSession, root: str, max_bytes: int = MAX_FILE_BYTES, parts: int | None = None) -> DataFrame:
    """path, size, mtime of the files of a tree that are not ignored."""
    return _tree(spark, root, METADATA, max_bytes, parts)


def read_tree(spark: SparkSession, root: str, max_bytes: int = MAX_FILE_BYTES, text_only: bool = True, only: list[str] | None = None, parts: int | None = None) -> DataFrame:
    """Like scan(), with hidden files, by the codetree source; only: paths to read, where nothing is listed."""
    files = _tree(spark, root, SCHEMA, max_bytes, parts)
    if only is not None:
        files = files.where(F.col("path").isin(only) if only else F.lit(False))
    return described(files.where(is_text_file(F.col("path"))) if text_only else files)


def written_tree(files: DataFrame, root: str) -> None:
    """Writes path, content (string) as files below root, which all executors must share, and removes those whose content
    is null; other files stay."""

    def write(rows: Iterator) -> None:
        for r in rows:
            at = os.path.join(root, r.path)
            if r.content is None:
                if os.path.exists(at):
                    os.remove(at)
                continue
            os.makedirs(os.path.dirname(at), exist_ok=True)
            with open(f"{at}.part", "w", encoding="utf-8", newline="") as f:
                f.write(r.content)
            os.replace(f"{at}.part", at)

    os.makedirs(root, exist_ok=True)
    files.select("path", "content").foreachPartition(write)
