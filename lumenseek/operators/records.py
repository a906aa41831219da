"""Records at the edges: vector metadata, results, evidence, index statistics and probes."""

from __future__ import annotations

import hashlib
import hmac

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenseek.operators.changes import affected_terms

#: Metadata that has a column of its own.
FIELDS = ("type", "language", "category", "path")
METADATA = "map<string,string>"


def flattened(docs: DataFrame, metadata: str = "metadata") -> DataFrame:
    """docs with a map of metadata as columns FIELDS (an empty string where one is missing) and metadata_json (the rest)."""
    rest = F.map_filter(metadata, lambda k, _: ~k.isin(*FIELDS))
    return docs.select(*(c for c in docs.columns if c != metadata), *(F.coalesce(F.try_element_at(F.col(metadata), F.lit(f)), F.lit("")).alias(f) for f in FIELDS), F.to_json(F.coalesce(rest, F.create_map().cast(METADATA))).alias("metadata_json"))


def unflattened(records: DataFrame, metadata: str = "metadata") -> DataFrame:
    """The inverse of flattened(): empty strings are missing values."""
    pairs = F.array(*(F.struct(F.lit(f).alias("key"), F.nullif(F.col(f), F.lit("")).alias("value")) for f in FIELDS))
    own = F.map_from_entries(F.filter(pairs, lambda p: p.value.isNotNull()))
    rest = F.coalesce(F.from_json("metadata_json", METADATA), F.create_map().cast(METADATA))
    return records.select(*(c for c in records.columns if c not in (*FIELDS, "metadata_json")), F.map_concat(own, rest).alias(metadata))


def mapped_hits(hits: DataFrame, route: str) -> DataFrame:
    """Ranked hits (path, start_line, end_line, score, matched_terms) as results of a route; a missing list is empty."""
    place = F.struct(F.col("path"), F.col("start_line").alias("startLine"), F.col("end_line").alias("endLine"))
    return hits.select("path", "score", F.coalesce("matched_terms", F.array().cast("array<string>")).alias("matchedTerms"), place.alias("locator"), F.lit(route).alias("route"))


def retrieval_evidence(lexical: int, semantic: int, merged: int) -> dict:
    """Which engines contributed to a merged result, and how much."""
    used = [name for name, n in (("lexical", lexical), ("semantic", semantic)) if n]
    return {"engines": used, "mode": "hybrid" if len(used) == 2 else used[0] if used else "none", "counts": {"lexical": lexical, "semantic": semantic, "merged": merged}}


def incremental_statistics(before: DataFrame, removed: DataFrame, added: DataFrame, keys: list[str]) -> DataFrame:
    """One row: affected_units, affected_terms, total_units, for units (keys, tokens) that left and came: a unit that came
    in place of one that left has the same keys in both. Affected are units that came, and all that stayed and hold a term
    of one that left or came."""
    terms = affected_terms(removed, added)
    stayed = before.join(removed.select(*keys), keys, "left_anti").join(added.select(*keys), keys, "left_anti")
    held = stayed.select(*keys, F.explode(F.array_distinct("tokens")).alias("term")).join(terms, "term", "left_semi").select(*keys).distinct()
    one = lambda df, name: F.broadcast(df.agg(F.count(F.lit(1)).alias(name)))
    row = one(held, "held").join(one(added, "came")).join(one(terms, "affected_terms")).join(one(stayed, "stayed"))
    return row.select((F.col("held") + F.col("came")).alias("affected_units"), "affected_terms", (F.col("stayed") + F.col("came")).alias("total_units"))


def fallback_chunks(windows: DataFrame, keys: list[str]) -> DataFrame:
    """Character windows (keys, chunk_index, chunk) as chunks of type text, at no lines, marked as a fallback."""
    zero = F.lit(0)
    return windows.select(*keys, F.col("chunk").alias("content"), F.lit("text").alias("type"), zero.alias("start_line"), zero.alias("end_line"), F.lit(True).alias("fallback"), F.col("chunk_index").alias("index"))


def iso_time(time: Column) -> Column:
    """A time without a zone, read as UTC, with milliseconds."""
    return F.date_format(time, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")


def index_probes(status: dict, needs_vectors: bool = False) -> list[tuple[str, str]]:
    """(probe, ok / warn / fail) of an engine's status(), to be folded by changes.fold_status()."""
    return [
        ("index", "ok" if status.get("chunks") else "fail"),
        ("files", "ok" if status.get("files") else "fail"),
        ("segments", "ok" if status.get("segments", 0) <= 16 else "warn"),
        ("vectors", "ok" if not needs_vectors or status.get("vectors") else "warn"),
    ]


def is_key_valid(given: str, expected: str) -> bool:
    """Whether two keys are equal, in a time that does not depend on where they differ."""
    digest = lambda x: hashlib.sha256(x.encode()).digest()
    return hmac.compare_digest(digest(given), digest(expected))
