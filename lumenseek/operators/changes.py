"""Differences of snapshots, and index statistics kept current by signed counts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from lumenseek.operators.statistics import frequencies

#: Differences of modification times up to this many milliseconds are none.
MTIME_SLACK_MS = 1000
#: An update of more than this part of the units, or with more new terms, is rebuilt in full.
REBUILD_SHARE, REBUILD_TERMS = 0.2, 1000


def snapshot_diff(old: DataFrame, new: DataFrame, *, key: str = "path", by: str = "hash") -> DataFrame:
    """key, change_type (added, changed, deleted, unchanged). by: `hash` compares hashes, `mtime` times in milliseconds."""
    a, b = old.select(key, F.col(by).alias("_old"), F.lit(True).alias("_in_old")), new.select(key, F.col(by).alias("_new"), F.lit(True).alias("_in_new"))
    differs = ~F.col("_old").eqNullSafe(F.col("_new")) if by == "hash" else F.abs(F.col("_old") - F.col("_new")) > MTIME_SLACK_MS
    kind = F.when(F.col("_in_old").isNull(), "added").when(F.col("_in_new").isNull(), "deleted").when(differs, "changed").otherwise("unchanged")
    return a.join(b, key, "full_outer").select(key, kind.alias("change_type"))


def stale_files(known: DataFrame, found: DataFrame) -> DataFrame:
    """path, change_type of known and found files (path, size, mtime) without a look at contents: changed where sizes
    differ or times do by more than the slack, or where a time is missing."""
    a = known.select("path", F.col("size").alias("_size"), F.unix_millis("mtime").alias("_old"), F.lit(True).alias("_known"))
    b = found.select("path", "size", F.unix_millis("mtime").alias("_new"), F.lit(True).alias("_found"))
    same = (F.col("_size") == F.col("size")) & (F.abs(F.col("_old") - F.col("_new")) <= MTIME_SLACK_MS)
    kind = F.when(F.col("_known").isNull(), "added").when(F.col("_found").isNull(), "deleted").when(F.coalesce(same, F.lit(False)), "unchanged").otherwise("changed")
    return a.join(b, "path", "full_outer").select("path", kind.alias("change_type"))


def refresh_mode(diff: DataFrame, has_index: bool) -> str:
    """full without an index, cache_hit without changes, else incremental."""
    if not has_index:
        return "full"
    return "incremental" if diff.where("change_type <> 'unchanged'").head() else "cache_hit"


def apply_changes(chunks: DataFrame, changed: DataFrame, rechunked: DataFrame, key: str = "path") -> DataFrame:
    """chunks without those of changed keys, and the new ones of them."""
    return chunks.join(changed.select(key).distinct(), key, "left_anti").unionByName(rechunked)


def latest_changes(events: DataFrame, key: str, order: list[str]) -> DataFrame:
    """The last event of each key."""
    return events.withColumn("_r", F.row_number().over(W.partitionBy(key).orderBy(*(F.col(c).desc() for c in order)))).where("_r = 1").drop("_r")


def debounce(events: DataFrame, key: str, time: str, gap: str, kind: str) -> DataFrame:
    """key, first_at, last_at, kind, n: one event for each run of a key's events without a pause of `gap`; the last
    kind counts. In a stream, give events a watermark first."""
    return events.groupBy(key, F.session_window(time, gap).alias("w")).agg(F.min(time).alias("first_at"), F.max(time).alias("last_at"), F.max_by(kind, time).alias(kind), F.count(F.lit(1)).alias("n")).drop("w")


def updated_frequencies(df: DataFrame, removed: DataFrame, added: DataFrame) -> DataFrame:
    """term, df after units (tokens) went and came: signed counts, added to what was known."""
    gone = frequencies(removed).select("term", (-F.col("df")).alias("df"))
    come = frequencies(added)
    return df.select("term", "df").unionByName(gone).unionByName(come).groupBy("term").agg(F.sum("df").alias("df")).where("df > 0")


def affected_terms(removed: DataFrame, added: DataFrame) -> DataFrame:
    return removed.select(F.explode("tokens").alias("term")).union(added.select(F.explode("tokens").alias("term"))).distinct()


def rebuild_statistics(df: DataFrame, updates: DataFrame, n_units: int) -> DataFrame:
    """One row: n_updates, new_terms, full_rebuild, for updates with tokens."""
    fresh = updates.select(F.explode("tokens").alias("term")).distinct().join(df.select("term"), "term", "left_anti").agg(F.count(F.lit(1)).alias("new_terms"))
    counted = updates.agg(F.count(F.lit(1)).alias("n_updates"))
    rows = counted.join(F.broadcast(fresh))
    over = (F.col("n_updates") / F.lit(float(max(n_units, 1))) > REBUILD_SHARE) | (F.col("new_terms") > REBUILD_TERMS)
    return rows.withColumn("full_rebuild", over)


def fold_status(probes: DataFrame, status: str = "status", by: list[str] | None = None) -> DataFrame:
    """One row, or one per group: ready, degraded (any warn) or unavailable (any fail), and the exit code."""
    worst = probes.groupBy(*(by or [])).agg(F.coalesce(F.bool_or(F.col(status) == "fail"), F.lit(False)).alias("f"), F.coalesce(F.bool_or(F.col(status) == "warn"), F.lit(False)).alias("w"))
    return worst.select(*(by or []), F.when(F.col("f"), "unavailable").when(F.col("w"), "degraded").otherwise("ready").alias("status"), F.col("f").cast("int").alias("exit_code"))
