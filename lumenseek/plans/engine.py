"""The search engine: builds, refreshes and searches an index in a store."""

from __future__ import annotations

import datetime
import json
import sys
import time
from collections import OrderedDict

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from lumenseek.functions.embedding import EmbeddingConfig, embed, embed_rows
from lumenseek.functions.paths import chunk_id, is_indexable, parse_chunk_id, path_matches
from lumenseek.operators import inverted, ranking
from lumenseek.operators.changes import REBUILD_SHARE, REBUILD_TERMS, stale_files
from lumenseek.operators.chunking import chunk_symbols
from lumenseek.operators.common import SMALL_ROWS
from lumenseek.operators.hybrid import merge_hybrid
from lumenseek.operators.snippets import snippet
from lumenseek.operators.threshold import Query, best_units
from lumenseek.operators.vector_search import nearest
from lumenseek.sources.files import covered, read_tree, tree_metadata
from lumenseek.sources.store import MAX_SEGMENTS, TABLES, Conflict, Store

KEYS = ["path", "start_line", "end_line"]
#: Paths up to which a look-up names them, so that scans skip rows by their order; more are joined.
NAMED_PATHS = 1000
#: How often an update is made again when another writer came first.
RETRIES = 5


class Cache:
    """Results by key: the least recently used goes first, and all go when the index changes or after ttl seconds."""

    def __init__(self, size: int = 100, ttl: float = 300.0):
        self.size, self.ttl, self.hits, self.misses = size, ttl, 0, 0
        self.entries: OrderedDict[str, tuple[float, object]] = OrderedDict()

    def get(self, key: str):
        found = self.entries.get(key)
        if found and time.monotonic() - found[0] <= self.ttl:
            self.entries[key] = (time.monotonic(), found[1])
            self.entries.move_to_end(key)
            self.hits += 1
            return found[1]
        self.entries.pop(key, None)
        self.misses += 1
        return None

    def set(self, key: str, value) -> None:
        self.entries[key] = (time.monotonic(), value)
        self.entries.move_to_end(key)
        while len(self.entries) > self.size:
            self.entries.popitem(last=False)

    def clear(self) -> None:
        self.entries.clear()

    def cleanup(self) -> None:
        now = time.monotonic()
        for key in [k for k, (at, _) in self.entries.items() if now - at > self.ttl]:
            del self.entries[key]

    def stats(self) -> dict:
        total = self.hits + self.misses
        return {"size": len(self.entries), "hits": self.hits, "misses": self.misses, "hit_rate": self.hits / total if total else 0.0}


def cache_key(query: str, **options) -> str:
    """Every option counts, lists in sorted order."""
    plain = {k: sorted(v) if isinstance(v, list) else v for k, v in options.items()}
    return json.dumps([query.lower().strip(), plain], sort_keys=True)


class Engine:
    """An index of symbol chunks in a store, with dense vectors if an embedding is configured."""

    def __init__(self, spark: SparkSession, store: Store, embedding: EmbeddingConfig | None = None):
        self.spark, self.store, self.embedding, self.cache = spark, store, embedding, Cache()
        self.warnings: list[str] = []

    # building

    def index(self, root: str) -> dict:
        """Builds, refreshes or keeps the index of a folder: mode full, incremental or cache_hit, and counts.

        A refresh compares times and sizes first, which opens no file, and reads only files where these differ; of those
        whose contents hash as before nothing changes. Counts are told by the writes and the comparison itself."""
        began = time.monotonic()
        state = self.store.state()
        metadata = tree_metadata(self.spark, root).where(covered(F.col("path")))
        has_index = state["metadata"].get("root") == root
        seen = Observation()
        told = {"changed": 0, "removed": 0}
        if not has_index:
            mode = "full"
            told |= self.build(read_tree(self.spark, root).where(covered(F.col("path"))), root)
            told["changed"] = n = told.pop("files")
        else:
            # sizes and times of the scan against those of the index, with counts of every kind
            kinds = {k: F.count_if(F.col("change_type") == k).alias(k) for k in ("added", "changed", "deleted", "unchanged")}
            stale = stale_files(self.store.read("files", state=state), metadata).observe(seen, *kinds.values())
            stale = self.store.stage_scratch(stale.where("change_type <> 'unchanged'").select("path", "change_type"), "stale")
            fresh = self._fresh(root, stale.where("change_type <> 'deleted'").select("path"), state)
            gone = stale.where("change_type = 'deleted'").select("path")
            told["changed"], told["removed"] = fresh.count(), gone.count()  # of rows just written: their footers
            mode = "incremental" if told["changed"] or told["removed"] else "cache_hit"
            if mode == "incremental":
                told |= self.update(fresh, gone)
            n = sum(v for k, v in seen.get.items() if k != "deleted")
        return {"mode": mode, "files_scanned": n, "chunks": self.store.get_metadata("n_chunks", 0), **told, "elapsed_ms": int(1000 * (time.monotonic() - began))}

    def _fresh(self, root: str, some: DataFrame, state: dict) -> DataFrame:
        """Files of some paths whose contents are not those of the index."""
        named = [r.path for r in some.limit(NAMED_PATHS + 1).collect()]
        files = read_tree(self.spark, root, only=named) if len(named) <= NAMED_PATHS else read_tree(self.spark, root).join(some, "path", "left_semi")
        known = self.rows_of("files", some, named, state).select("path", F.col("hash").alias("_hash"))
        changed = files.join(known, "path", "left").where(~F.col("hash").eqNullSafe(F.col("_hash"))).drop("_hash")
        return self.store.stage_scratch(changed, "fresh")

    def update(self, files: DataFrame, gone: DataFrame) -> dict:
        """New contents of some files, and paths of files that are gone; returns counts. What changed paths said before is
        read from their own rows of the forward index, and of the inverted index only terms are read whose document
        frequency has moved. Counts, weights and lengths equal those of a full build."""
        files = self.store.stage("files", files.where(is_indexable(F.col("path"))))
        changed = files.select("path").unionByName(gone.select("path")).distinct().persist()
        paths = [r.path for r in changed.limit(NAMED_PATHS + 1).collect()]
        rows, counts = self._rows(files, self.store.state()["metadata"].get("mean_len", 1.0))
        try:
            for attempt in range(RETRIES):
                try:
                    out = self._apply(files, rows, counts, changed, paths)
                    break
                except Conflict:
                    if attempt == RETRIES - 1:
                        raise
        finally:
            changed.unpersist()
        # large updates are rewritten as one segment sooner: most of what older ones hold is gone
        if self.store.segments() > (MAX_SEGMENTS // 4 if out["rebuild_advised"] else MAX_SEGMENTS):
            try:  # nothing is lost where another writer comes first: it will find as many segments
                self.store.compact()
            except Conflict:
                pass
        self.cache.clear()
        return out

    def _apply(self, files: DataFrame, rows: dict[str, DataFrame], counts: dict, changed: DataFrame, paths: list[str]) -> dict:
        """The differences that an update makes to the newest state, and its commit; Conflict if that state has moved."""
        state = self.store.state()
        n_before = state["metadata"].get("n_chunks", 0)
        seen = Observation()
        before = self.rows_of("forward", changed, paths, state).observe(seen, F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("doc_len"), F.lit(0)).alias("total_len"))
        signed = before.select(F.explode("terms.term").alias("term"), F.lit(-1).alias("df"), F.lit(0).alias("come"))
        signed = signed.unionByName(rows["forward"].select(F.explode("terms.term").alias("term"), F.lit(1).alias("df"), F.lit(1).alias("come")))
        moved = signed.groupBy("term").agg(F.sum("df").cast("long").alias("df"), F.max("come").alias("come"))
        known = self.store.terms(state=state)
        # the known frequency beside each term of an update: 0 where it is new
        moved = moved.withColumnRenamed("df", "by").join(known, "term", "left").na.fill(0, ["df"])
        moved = moved.select("term", "df", (F.col("df") + F.col("by")).alias("df_new"), "come")
        told = Observation()
        fresh = (F.col("df") == 0) & (F.col("come") == 1)
        moved = self.store.stage_scratch(moved.observe(told, F.count(F.lit(1)).alias("affected_terms"), F.count_if(fresh).alias("new_terms")), "moved")
        went, terms = seen.get, told.get
        # units of other paths that hold a term whose frequency has moved: few terms are looked up in their blocks, for
        # many all units are read, whose terms lie together
        shifted = moved.where("df <> df_new AND df > 0").select("term", "df", "df_new")
        if terms["affected_terms"] <= SMALL_ROWS:
            held = self.store.postings_of_terms(F.broadcast(shifted.select("term")), state).join(changed, "path", "left_anti")
            deltas = inverted.posting_changes(held, shifted, KEYS)
        else:
            held = self.store.read("forward", state=state).join(changed, "path", "left_anti")
            deltas = inverted.norm_changes(held, shifted, KEYS, self._sums)
        own = inverted.norm_rows(rows["forward"], moved.select("term", F.col("df_new").alias("df")), KEYS, self._sums)
        delta = moved.where("df <> df_new").select("term", (F.col("df_new") - F.col("df")).alias("df"))
        come = Observation()
        norms = self.store.stage("norms", own.unionByName(deltas), come, {"n": F.count(F.lit(1))})
        add = {"n_chunks": counts["n"] - went["n"], "total_len": counts["total_len"] - went["total_len"]}
        self.store.commit(append=rows | {"files": files, "terms": self.store.stage("terms", delta), "norms": norms}, gone=changed, add=add, since=state)
        rebuild = max(counts["n"], went["n"]) > REBUILD_SHARE * max(n_before, 1) or terms["new_terms"] > REBUILD_TERMS
        return {"affected_units": come.get["n"], "affected_terms": terms["affected_terms"], "total_units": n_before + add["n_chunks"], "rebuild_advised": rebuild}

    def rows_of(self, table: str, some: DataFrame, paths: list[str], state: dict | None = None) -> DataFrame:
        """Rows of some paths. A list of all of them lets the scan skip the others by their order."""
        if len(paths) <= NAMED_PATHS:
            return self.store.read(table, F.col("path").isin(paths) if paths else F.lit(False), state)
        return self.store.read(table, None, state).join(some, "path", "left_semi")

    def build(self, files: DataFrame, root: str) -> dict:
        """A new index of files (the columns of the table files); returns counts. Whatever the store held goes."""
        seen = Observation()
        files = self.store.stage("files", files, seen, {"n": F.count(F.lit(1))})
        rows, counts = self._rows(files, None)
        terms = self.store.stage("terms", inverted.frequencies(rows["blocks"]))
        norms = self.store.stage("norms", inverted.norm_rows(rows["forward"], terms, KEYS, self._sums))
        metadata = {"root": root, "n_chunks": counts["n"], "total_len": counts["total_len"], "mean_len": counts["mean_len"]}
        self.store.commit(replace=rows | {"files": files, "terms": terms, "norms": norms}, metadata=metadata)
        self.store.describe(root, datetime.datetime.now(datetime.UTC).isoformat(timespec="seconds"))
        self.cache.clear()
        return {"files": seen.get["n"], "chunks": counts["n"], "failed": counts["failed"]}

    def _rows(self, files: DataFrame, mean: float | None) -> tuple[dict[str, DataFrame], dict]:
        """Staged rows made from files, and counts that writing them has told. mean: the length at which impacts order
        postings, by default that of these units; one index keeps the same."""
        about = F.to_variant_object(F.struct(F.col("language"), (F.col("end_line") - F.col("start_line") + 1).alias("lines"), F.size("tokens").alias("tokens"), F.col("symbol_name").alias("symbol")))
        # files lie in the order of paths, and so do chunks that are made where they lie
        chunks = self.store.stage("chunks", chunk_symbols(files, keep=("language",)).withColumn("metadata", about), ordered=True)
        seen = Observation()
        forward = self.store.stage("forward", inverted.forward_rows(chunks, KEYS), seen, {"n": F.count(F.lit(1)), "total_len": F.coalesce(F.sum("doc_len"), F.lit(0))})
        counts = dict(seen.get) | {"failed": 0}
        counts["mean_len"] = mean or max(counts["total_len"] / max(counts["n"], 1), 1.0)
        out = {"chunks": chunks, "forward": forward, "blocks": self.store.stage("blocks", inverted.packs_of(forward, KEYS, counts["mean_len"]))}
        if self.embedding:
            named = chunks.select(chunk_id(*map(F.col, KEYS)).alias("id"), "path", F.col("text").alias("content"), F.lit("code").alias("type"), F.variant_get("metadata", "$.language", "string").alias("language"), F.to_json(F.struct(F.col("chunk_type").alias("chunkType"))).alias("metadata_json"))
            made = self.store.stage_scratch(embed_rows(named, self.embedding, text_col="content"), "embedded")
            failed = Observation()
            out["vectors"] = self.store.stage("vectors", made.where("vector IS NOT NULL"))
            out["failures"] = self.store.stage("failures", made.where("vector IS NULL"), failed, {"n": F.count(F.lit(1))})
            counts["failed"] = failed.get["n"]
        return out, counts

    # weights

    def _sums(self, rows: DataFrame) -> DataFrame:
        return self.store.stage_scratch(rows, "sums")

    def vectors_of(self, paths: list[str] | None = None) -> DataFrame:
        """KEYS, term, tf, tfidf, raw_freq, magnitude, token_count of the units of some paths, or of all: weights from the
        forward index and stored frequencies, lengths from stored sums."""
        state = self.store.state()
        n = state["metadata"].get("n_chunks", 0)
        where = None if paths is None else F.col("path").isin(paths)
        lengths = self.store.read("norms", where, state).select(*KEYS, inverted.magnitude(n).alias("magnitude"))
        # a unit gets its length before its terms become rows
        units = self.store.read("forward", where, state).join(lengths.hint("shuffle_hash"), KEYS)
        posted = units.select(*KEYS, "doc_len", "magnitude", F.inline("terms"))
        return inverted.weighted(posted, self.store.terms(state=state), n).withColumnRenamed("doc_len", "token_count")

    def magnitudes(self) -> DataFrame:
        """KEYS, magnitude, token_count of all units; 0 for those without tokens."""
        state = self.store.state()
        lengths = self.store.read("norms", state=state).select(*KEYS, inverted.magnitude(state["metadata"].get("n_chunks", 0)).alias("magnitude"))
        rows = self.store.read("forward", state=state).select(*KEYS, F.col("doc_len").alias("token_count"))
        return rows.join(lengths, KEYS, "left").na.fill(0.0, ["magnitude"])

    # searching

    def search(self, query: str, *, limit: int = 10, min_score: float | None = None, extensions: list[str] | None = None, contains: str | None = None, excludes: list[str] | None = None, content: bool = True) -> list[dict]:
        """Ranked chunks. Filters hold before the limit, while statistics are those of the whole index."""
        key = cache_key(query, limit=limit, min_score=min_score, extensions=extensions or [], contains=contains, excludes=excludes or [], content=content)
        if (found := self.cache.get(key)) is not None:
            return found
        where = path_matches(F.col("path"), extensions=extensions, contains=contains, excludes=excludes) if extensions or contains or excludes else None
        state = self.store.state()
        best = self.ranked(query, limit=limit, min_score=min_score, where=where, state=state)
        found = self._described(best, content, state)
        self.cache.set(key, found)
        return found

    def _described(self, best: list[dict], content: bool, state: dict) -> list[dict]:
        """Ranked units with what their chunks say; these lie in the order of paths, so few are read."""
        if not best:
            return []
        lines = sorted({r["start_line"] for r in best})
        chunks = self.store.read("chunks", F.col("path").isin(sorted({r["path"] for r in best})) & F.col("start_line").isin(lines), state)
        about = chunks.select(*KEYS, "symbol_name", "chunk_type", F.variant_get("metadata", "$.language", "string").alias("language"), *(["text"] if content else []))
        if content:
            terms = self.spark.createDataFrame([[*(r[c] for c in KEYS), r["matched_terms"]] for r in best], "path string, start_line int, end_line int, matched_terms array<string>")
            about = about.join(F.broadcast(terms), KEYS).withColumn("snippet", snippet(F.col("text"), F.col("matched_terms"))).drop("text", "matched_terms")
        by_place = {tuple(r[c] for c in KEYS): r.asDict() for r in about.collect()}
        return [r | by_place[tuple(r[c] for c in KEYS)] for r in best]

    def ranked(self, query: str, *, limit: int = 10, min_score: float | None = None, where=None, state: dict | None = None, seen: dict | None = None) -> list[dict]:
        """KEYS, score, matched_terms, score_components and rank of the best chunks. seen is filled with how many blocks
        the query's terms have and how many could not be left out."""
        asked = Query(self.spark, query, ranking.SYMBOL)
        return best_units(self.store, asked, limit, min_score, where, state or self.store.state(), seen)

    def by_terms(self, terms: list[str], limit: int = 100) -> DataFrame:
        """Chunks with most of some terms: KEYS, matches, matched_terms, weights (array of term, tfidf, raw_freq in the order
        of terms), magnitude, token_count, chunk_type, content. Only blocks of these terms and rows of these chunks are
        read."""
        state = self.store.state()
        n = state["metadata"].get("n_chunks", 0)
        posted = self.store.postings(F.col("term").isin(terms), state)
        hits = ranking.candidates_of(posted, KEYS, terms, limit)
        paths = [r.path for r in hits.select("path").distinct().collect()]
        some = F.col("path").isin(paths) if paths else F.lit(False)
        place = F.array_position(F.array(*map(F.lit, terms)), F.col("term"))
        parts = inverted.weighted(posted.where(some), self.store.terms(terms, state), n)
        parts = parts.groupBy(*KEYS).agg(F.transform(F.sort_array(F.collect_set(F.struct(place.alias("at"), "term", "tfidf", "raw_freq"))), lambda x: F.struct(x.term.alias("term"), x.tfidf.alias("tfidf"), x.raw_freq.alias("raw_freq"))).alias("weights"), F.max("doc_len").alias("token_count"))
        lengths = self.store.read("norms", some, state).select(*KEYS, inverted.magnitude(n).alias("magnitude"))
        chunks = self.store.read("chunks", some, state).select(*KEYS, "chunk_type", F.col("text").alias("content"))
        return F.broadcast(hits).join(parts, KEYS).join(lengths, KEYS).join(chunks, KEYS).orderBy(F.desc("matches"), *KEYS)

    def status(self) -> dict:
        """What is indexed."""
        return {"root": self.store.get_metadata("root"), "files": self.store.count("files"), "chunks": self.store.get_metadata("n_chunks", 0), "vectors": "vectors" in self.store.state()["tables"], "segments": self.store.segments(), "cache": self.cache.stats()}

    def content(self, path: str) -> str | None:
        """The indexed content of a file."""
        row = self.store.get("files", path).select("content").first()
        return row.content if row else None

    def semantic(self, query: str, *, limit: int = 10, min_score: float = 0.0, carry: tuple[str, ...] = (), **filters) -> DataFrame:
        if not self.embedding:
            raise ValueError("no embedding is configured")
        vector = query_vector(self.spark, query, self.embedding)
        return nearest(self.store.read("vectors"), vector, limit, where=path_matches(F.col("path"), **filters), min_score=min_score, carry=carry)

    def hybrid(self, query: str, *, limit: int = 10, min_score: float = 0.01, weight: float = 0.7, content: bool = False, **filters) -> list[dict]:
        """path, start_line, end_line, score, method (vector, lexical or hybrid), similarity, matched_terms, content,
        language, chunk_type of the best chunks of both searches, each scaled by its best score.

        weight 0.99 and more searches vectors only, 0.01 and less terms only, and so does a missing embedding. Where the
        provider fails, terms answer alone, and self.warnings says why. content: the snippet of a chunk that terms found;
        a chunk that only its vector found has the text beside that."""
        self.warnings = []
        if weight > 0.01 and self.embedding:
            try:
                return self._blended(query, limit, min_score, weight, content, filters)
            except Exception as e:  # noqa: BLE001  whatever a provider raises
                self.warnings.append(f"vectors did not answer: {type(e).__name__}: {e}")
        return [self._result(h, None, h["score"], "lexical") for h in self.search(query, limit=limit, content=content, **filters)]

    def _blended(self, query: str, limit: int, min_score: float, weight: float, content: bool, filters: dict) -> list[dict]:
        only = weight >= 0.99
        found = self.semantic(query, limit=limit if only else 2 * limit, min_score=min_score if only else 0.0, carry=("content", "language", "metadata_json"), **filters)
        at = parse_chunk_id(F.col("id"))
        kind = F.get_json_object("metadata_json", "$.chunkType")
        rows = found.select(at.alias("at"), "score", "content", "language", kind.alias("chunk_type")).select("at.*", "score", "content", "language", "chunk_type").collect()
        place = lambda r: tuple(r[c] for c in KEYS)
        near = {place(r): r.asDict() for r in rows}
        if only:
            return [self._result(None, r, r["score"], "vector") for r in near.values()]
        hits = {place(h): h for h in self.search(query, limit=2 * limit, content=content, **filters)}
        lists = [self.spark.createDataFrame([(k, r["score"]) for k, r in x.items()], "key struct<path: string, start_line: int, end_line: int>, score double") for x in (near, hits)]
        merged = merge_hybrid(*lists, weight, min_score=min_score, limit=limit).orderBy(F.col("score").desc(), "key").collect()
        return [self._result(hits.get(tuple(m.key)), near.get(tuple(m.key)), m.score, m.method) for m in merged]

    @staticmethod
    def _result(hit: dict | None, beside: dict | None, score: float, method: str) -> dict:
        """A result from what terms found and what stands beside a vector; where both know something, terms say it."""
        first = lambda c: next((x[c] for x in (hit, beside) if x and x.get(c) is not None), None)
        text = hit.get("snippet") if hit else beside["content"]
        return {**{c: first(c) for c in KEYS}, "score": score, "method": method, "similarity": beside["score"] if beside else None, "matched_terms": hit["matched_terms"] if hit else [], "content": text, "language": first("language"), "chunk_type": first("chunk_type")}


def query_vector(spark: SparkSession, query: str, config: EmbeddingConfig) -> list[float]:
    """The vector of one text; raises what its provider raises."""
    row = embed_rows(spark.range(1).select(F.lit(query).alias("text")), config).first()
    if row.error:
        raise ValueError(row.error)
    return list(row.vector)


def envelope(query: str, results: list[dict], *, route: str = "lexical", indexed_files: int = 0, stale: bool = False, warnings: list[str] | None = None) -> dict:
    """A result document."""
    found = [
        {"path": r["path"], "locator": {"path": r["path"], "startLine": r.get("start_line"), "endLine": r.get("end_line")}, "score": r["score"], "matchedTerms": r.get("matched_terms") or [], "scoreComponents": r.get("score_components") or [], "route": route, "confidence": "deterministic", "snippet": r.get("snippet"), "chunkType": r.get("chunk_type")}
        for r in results
    ]
    return {"status": "ok", "subject": "codebase_search", "query": query, "route": route, "freshness": {"indexedFiles": indexed_files, "stale": stale}, "results": found, "warnings": warnings or []}


def handle(spark: SparkSession, request: dict) -> dict:
    """{"tool": index or search, "input": {root, folder, query, limit}} to a result document; errors are one too."""
    try:
        given = request["input"]
        engine = Engine(spark, Store(spark, given["folder"]))
        if request["tool"] == "index":
            return {"status": "ok", "subject": "index"} | engine.index(given["root"])
        if request["tool"] == "search":
            if given.get("root"):
                engine.index(given["root"])
            return envelope(given["query"], engine.search(given["query"], limit=given.get("limit", 10)), indexed_files=engine.store.count("files"))
        raise ValueError(f"unknown tool {request['tool']!r}")
    except Exception as e:  # noqa: BLE001  an envelope for every request
        return {"status": "error", "error": f"{type(e).__name__}: {e}"}


def main() -> None:
    """A request as JSON on standard input, its result on standard output."""
    print(json.dumps(handle(SparkSession.builder.getOrCreate(), json.load(sys.stdin))))


if __name__ == "__main__":
    main()
