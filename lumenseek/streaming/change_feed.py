"""What changes in a folder, as a log that streams read.

A poll lists the folder in parallel, compares the listing with that of the version before (a join), and writes what
differs as the next version of a log. A stream reads the log with the file source, so its offsets are numbers, whatever
the size of the folder, and `maxFilesPerTrigger` admits a bounded part of a backlog per batch. A version is claimed by a
file that must not exist yet; its changes appear as a whole, and after a crash the next poll finishes what was claimed.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenseek.operators.changes import stale_files
from lumenseek.sources.files import METADATA, tree_metadata
from lumenseek.sources.store import Folder

CHANGES = "type string, path string, ts timestamp, version long"
KINDS = {"added": "add", "changed": "change", "deleted": "unlink"}


class ChangeFeed:
    """The log of a folder `root` in another folder."""

    def __init__(self, spark: SparkSession, root: str, folder: str):
        self.spark, self.root = spark, root
        self.files = Folder(spark, folder)
        self.files.fs.mkdirs(self.files.at("changes"))

    def _versions(self) -> list[int]:
        return sorted(int(x[:-5]) for x in self.files.names("versions") if x[:-5].isdigit())

    def _latest(self) -> tuple[int, dict]:
        versions = self._versions()
        return (versions[-1], json.loads(self.files.read(f"versions/{versions[-1]:012d}.json"))) if versions else (0, {})

    def _shown(self, version: int, told: dict) -> None:
        """The changes of a claimed version move to where streams look."""
        if told.get("changes") and self.files.fs.exists(self.files.at(f"staged/{told['changes']}")):
            self.files.fs.rename(self.files.at(f"staged/{told['changes']}"), self.files.at(f"changes/v{version:012d}"))

    def poll(self) -> int:
        """The number of changes since the last poll, which are then in the log; at first every file is one. Of two polls
        at once one claims the version and the other finds 0."""
        version, told = self._latest()
        self._shown(version, told)
        name = uuid.uuid4().hex
        at = lambda folder: str(self.files.at(folder).toString())
        tree_metadata(self.spark, self.root).write.parquet(at(f"manifests/{name}"))
        now = self.spark.read.schema(METADATA).parquet(at(f"manifests/{name}"))
        before = self.spark.read.schema(METADATA).parquet(at(f"manifests/{told['manifest']}")) if told else self.spark.createDataFrame([], METADATA)
        kinds = F.create_map(*(F.lit(x) for pair in KINDS.items() for x in pair))
        differ = stale_files(before, now).where("change_type <> 'unchanged'")
        rows = differ.select(F.try_element_at(kinds, F.col("change_type")).alias("type"), "path", F.current_timestamp().alias("ts"), F.lit(version + 1).cast("long").alias("version"))
        rows.write.parquet(at(f"staged/{name}"))
        n = self.spark.read.schema(CHANGES).parquet(at(f"staged/{name}")).count()  # footers only
        if not n or not self.files.create(f"versions/{version + 1:012d}.json", json.dumps({"manifest": name, "changes": name, "n": n})):
            self.files.remove(f"staged/{name}")
            self.files.remove(f"manifests/{name}")
            return 0
        self._shown(version + 1, {"changes": name})
        if told:
            self.files.remove(f"manifests/{told['manifest']}")
        return n

    def stream(self, max_files: int = 64) -> DataFrame:
        """type (add, change, unlink), path, ts, version; of a backlog at most max_files files of the log per batch."""
        reader = self.spark.readStream.schema(CHANGES).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", max_files)
        return reader.parquet(str(self.files.at("changes").toString()))
