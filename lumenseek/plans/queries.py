"""Driver queries over the test tables, and the DuckDB SQL with the same rows.

documents play the corpus, benchmark the query set, embeddings the vectors, events the change feed, pages the markup.
Floating-point results are rounded to six places on both sides, since sums may run in another order.
"""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenseek.functions import numeric, paths
from lumenseek.functions.tokenize import identifier_tokens, idf_probabilistic, idf_smoothed, plain_tokens
from lumenseek.functions.embedding import EmbeddingConfig, embed_rows, register_provider
from lumenseek.operators import changes, chunking, hybrid, ranking, records, snippets, statistics, structure, vector_clusters, vector_search
from lumenseek.plans.engine import Engine
from lumenseek.sources.files import tree_metadata, written_tree
from lumenseek.sources.store import Store, VectorStore, temporary_folder
from lumenseek.streaming import index_stream
from lumenseek.streaming.change_feed import ChangeFeed
from lumenseek.streaming.timers import debounced_by_timers


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

QUERY = "the thing and that tion"
KEYS = ["doc_id"]

PLAIN = "list_transform(regexp_extract_all(coalesce({0}, ''), '[A-Za-z0-9_]{{2,}}'), lambda x: lower(x))"
IDENTIFIER = (
    "list_filter(regexp_split_to_array(lower(regexp_replace(array_to_string(regexp_extract_all(coalesce({0}, ''), '[A-Za-z_][A-Za-z0-9_]*|[0-9]+'), ' '), "
    r"'([a-z0-9])([A-Z])', '\1 \2', 'g')), '[_\s]+'), lambda t: length(t) >= 2)"
)
SMOOTHED = "ln((CAST(n AS DOUBLE) + 1.0e0) / (CAST(df AS DOUBLE) + 1.0e0)) + 1.0e0"
PROBABILISTIC = "ln((CAST(n AS DOUBLE) - df + 0.5e0) / (df + 0.5e0) + 1.0e0)"


def query(sql: str | None = None):
    """Registers a function under its name, with its oracle."""

    def register(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """df dealt over all cores if it lies in fewer files than there are cores; larger tables are read as they lie."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    # by key, since rows that are dealt round robin are sorted before
    return df.repartition(cores, "doc_id") if len(df.inputFiles()) < cores else df


def units(spark: SparkSession, sf_dir: str, tokens: Callable[[Column], Column] = plain_tokens) -> DataFrame:
    return spread(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", tokens(F.col("text")).alias("tokens"))


def r6(c: Column | str) -> Column:
    return F.round(c, 6)


def _units_sql(tokens: str = PLAIN) -> str:
    return f"u AS (SELECT doc_id, {tokens.format('text')} AS tokens FROM documents)"


_POSTINGS = "p AS (SELECT doc_id, term, count(*) AS raw_freq, any_value(len(tokens)) AS doc_len FROM u, unnest(tokens) AS t(term) GROUP BY doc_id, term)"
_DF = "d AS (SELECT term, count(*) AS df FROM p GROUP BY term), c AS (SELECT count(*) AS n, avg(CAST(len(tokens) AS DOUBLE)) AS avgdl FROM u)"


# tokens and statistics


@query(f"WITH {_units_sql()} SELECT doc_id, CAST(len(tokens) AS BIGINT) AS n_tokens, md5(array_to_string(tokens, ' ')) AS digest FROM u")
def tokenize_plain(spark, sf_dir):
    return units(spark, sf_dir).select("doc_id", F.size("tokens").cast("long").alias("n_tokens"), F.md5(F.array_join("tokens", " ")).alias("digest"))


@query(f"WITH {_units_sql(IDENTIFIER)} SELECT doc_id, CAST(len(tokens) AS BIGINT) AS n_tokens, md5(array_to_string(tokens, ' ')) AS digest FROM u")
def tokenize_identifier(spark, sf_dir):
    return units(spark, sf_dir, identifier_tokens).select("doc_id", F.size("tokens").cast("long").alias("n_tokens"), F.md5(F.array_join("tokens", " ")).alias("digest"))


@query(f"WITH {_units_sql()}, {_POSTINGS} SELECT doc_id, term, CAST(raw_freq AS BIGINT) AS raw_freq, round(raw_freq / CAST(doc_len AS DOUBLE), 6) AS tf FROM p")
def term_freq(spark, sf_dir):
    return statistics.term_frequencies(units(spark, sf_dir), KEYS).select("doc_id", "term", "raw_freq", r6("tf").alias("tf"))


@query(f"WITH {_units_sql()} SELECT doc_id, CAST(len(tokens) AS BIGINT) AS doc_len FROM u")
def doc_len(spark, sf_dir):
    return units(spark, sf_dir).select("doc_id", F.size("tokens").cast("long").alias("doc_len"))


@query(f"WITH {_units_sql()}, {_POSTINGS}, {_DF} SELECT term, CAST(df AS BIGINT) AS df FROM d")
def doc_freq(spark, sf_dir):
    return statistics.frequencies(units(spark, sf_dir))


def _idf(spark, sf_dir, tokens, idf):
    rows = units(spark, sf_dir, tokens)
    df = statistics.frequencies(rows)
    return df.select("term", r6(idf(F.lit(rows.count()), F.col("df"))).alias("idf"))


@query(f"WITH {_units_sql(IDENTIFIER)}, {_POSTINGS}, {_DF} SELECT term, round({SMOOTHED}, 6) AS idf FROM d, c")
def idf_smooth(spark, sf_dir):
    return _idf(spark, sf_dir, identifier_tokens, idf_smoothed)


@query(f"WITH {_units_sql()}, {_POSTINGS}, {_DF} SELECT term, round({PROBABILISTIC}, 6) AS idf FROM d, c")
def idf_bm25(spark, sf_dir):
    return _idf(spark, sf_dir, plain_tokens, idf_probabilistic)


_TFIDF = f"WITH {_units_sql(IDENTIFIER)}, {_POSTINGS}, {_DF}, w AS (SELECT doc_id, term, raw_freq, raw_freq / CAST(doc_len AS DOUBLE) * ({SMOOTHED}) AS tfidf, {SMOOTHED} AS idf FROM p JOIN d USING (term), c)"


@query(f"{_TFIDF} SELECT doc_id, term, round(tfidf, 6) AS tfidf FROM w")
def tfidf(spark, sf_dir):
    return statistics.tfidf(units(spark, sf_dir, identifier_tokens), KEYS).select("doc_id", "term", r6("tfidf").alias("tfidf"))


@query(f"{_TFIDF} SELECT u.doc_id, round(coalesce(sqrt(sum(tfidf * tfidf)), 0), 6) AS magnitude FROM u LEFT JOIN w USING (doc_id) GROUP BY u.doc_id")
def magnitude(spark, sf_dir):
    rows = units(spark, sf_dir, identifier_tokens)
    return statistics.magnitudes(rows, statistics.tfidf(rows, KEYS), KEYS).select("doc_id", r6("magnitude").alias("magnitude"))


@query(f"WITH {_units_sql()}, {_POSTINGS}, {_DF} SELECT CAST(n AS BIGINT) AS n, round(avgdl, 6) AS avgdl FROM c")
def avgdl(spark, sf_dir):
    return statistics.corpus_statistics(units(spark, sf_dir)).select("n", r6("avgdl").alias("avgdl"))


@query(f"{_TFIDF} SELECT doc_id, CAST(count(*) AS BIGINT) AS n_terms, md5(string_agg(term || ' ' || raw_freq || ' ' || printf('%.4f', round(tfidf, 4)), ',' ORDER BY term)) AS digest FROM w GROUP BY doc_id")
def document_vectors(spark, sf_dir):
    rows = statistics.document_vectors(statistics.tfidf(units(spark, sf_dir, identifier_tokens), KEYS), KEYS)
    # both maps hold a unit's terms in order: looking each up in them would cost the square of their number
    entry = F.zip_with(F.map_entries("terms"), F.map_values("raw_terms"), lambda e, raw: F.concat_ws(" ", e.key, raw.cast("string"), F.format_string("%.4f", F.round(e.value, 4))))
    return rows.select("doc_id", F.size("terms").cast("long").alias("n_terms"), F.md5(F.array_join(entry, ",")).alias("digest"))


# ranking


def _ranked_sql(tokens: str, idf: str, queries: str, least: str = "0.0e0", units_sql: str | None = None, key: str = "doc_id") -> str:
    """CTEs up to s: query_id, key, score, terms, parts. queries: SQL with query_id, pos, term."""
    return f"""WITH {units_sql or _units_sql(tokens)}, q AS ({queries}),
c AS (SELECT count(*) AS n, greatest(avg(CAST(len(tokens) AS DOUBLE)), {least}) AS avgdl FROM u),
h AS (SELECT {key}, term, count(*) AS tf, any_value(len(tokens)) AS dl FROM u, unnest(tokens) AS t(term) WHERE term IN (SELECT term FROM q) GROUP BY {key}, term),
d AS (SELECT term, count(*) AS df FROM h GROUP BY term),
b AS (SELECT query_id, pos, {key}, term, tf, df, {idf} AS idf,
      ({idf}) * CAST(tf AS DOUBLE) * 2.2e0 / (CAST(tf AS DOUBLE) + 1.2e0 * (0.25e0 + 0.75e0 * CAST(dl AS DOUBLE) / avgdl)) AS bm25
      FROM h JOIN d USING (term) JOIN q USING (term), c),
s AS (SELECT query_id, {key}, sum(bm25 ORDER BY pos) AS score, list_distinct(list(term)) AS terms, count(*) AS n_parts FROM b GROUP BY query_id, {key}),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, {key}) AS rank FROM s WHERE score > 0)
"""


def _terms_sql(tokens: str, distinct: bool) -> str:
    inner = f"SELECT 'q' AS query_id, CAST(i - 1 AS INTEGER) AS pos, ts[i] AS term FROM (SELECT {tokens.format(chr(39) + QUERY + chr(39))} AS ts), unnest(range(1, len(ts) + 1)) AS t(i)"
    return f"SELECT query_id, min(pos) AS pos, term FROM ({inner}) GROUP BY query_id, term" if distinct else inner


def _top(rows: DataFrame) -> DataFrame:
    return rows.select("doc_id", r6("score").alias("score"), F.col("rank").cast("long").alias("rank"))


@query(_ranked_sql(PLAIN, PROBABILISTIC, _terms_sql(PLAIN, False), "1.0e0") + "SELECT doc_id, round(score, 6) AS score, rank FROM r WHERE rank <= 10")
def bm25_topk(spark, sf_dir):
    return _top(ranking.search(units(spark, sf_dir), KEYS, {"q": QUERY}, ranking.SYMBOL))


@query(_ranked_sql(IDENTIFIER, SMOOTHED, _terms_sql(IDENTIFIER, True)) + "SELECT doc_id, round(score, 6) AS score, rank FROM r WHERE rank <= 10")
def bm25_file_topk(spark, sf_dir):
    return _top(ranking.search(units(spark, sf_dir, identifier_tokens), KEYS, {"q": QUERY}, ranking.FILE))


@query(_ranked_sql(IDENTIFIER, SMOOTHED, _terms_sql(IDENTIFIER, True)) + "SELECT doc_id, round(score, 6) AS score FROM r WHERE score >= 2.5e0")
def bm25_min_score(spark, sf_dir):
    return ranking.search(units(spark, sf_dir, identifier_tokens), KEYS, {"q": QUERY}, ranking.FILE, limit=None, min_score=2.5).select("doc_id", r6("score").alias("score"))


_BATCH = f"SELECT query_id, min(pos) AS pos, term FROM (SELECT item_id AS query_id, CAST(i - 1 AS INTEGER) AS pos, ts[i] AS term FROM (SELECT item_id, {PLAIN.format('text')} AS ts FROM benchmark), unnest(range(1, len(ts) + 1)) AS t(i)) GROUP BY query_id, term"


@query(_ranked_sql(PLAIN, PROBABILISTIC, _BATCH, "1.0e0") + "SELECT query_id, doc_id, round(score, 6) AS score, rank FROM r WHERE rank <= 10")
def bm25_batch(spark, sf_dir):
    terms = plain_tokens(F.col("text"))
    queries = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.posexplode(terms).alias("pos", "term")).groupBy("query_id", "term").agg(F.min("pos").alias("pos"))
    return ranking.search_batch(units(spark, sf_dir), KEYS, queries, ranking.SYMBOL).select("query_id", "doc_id", r6("score").alias("score"), F.col("rank").cast("long").alias("rank"))


@query(_ranked_sql(PLAIN, PROBABILISTIC, _terms_sql(PLAIN, False), "1.0e0") + "SELECT b.doc_id, pos, term, CAST(tf AS DOUBLE) AS tf, CAST(df AS DOUBLE) AS df, round(idf, 6) AS idf, round(bm25, 6) AS bm25 FROM b JOIN r ON b.doc_id = r.doc_id WHERE rank <= 10")
def bm25_components(spark, sf_dir):
    best = ranking.search(units(spark, sf_dir), KEYS, {"q": QUERY}, ranking.SYMBOL, components=True)
    rows = best.select("doc_id", "matched_terms", F.posexplode("score_components").alias("i", "x"))
    asked = spark.createDataFrame([(i, t) for i, t in enumerate(QUERY.split())], "pos int, term string")
    rows = rows.select("doc_id", F.col("x.term").alias("term"), F.col("x.term_frequency").alias("tf"), F.col("x.document_frequency").alias("df"), r6("x.idf").alias("idf"), r6("x.bm25").alias("bm25"))
    return rows.join(F.broadcast(asked), "term").select("doc_id", "pos", "term", "tf", "df", "idf", "bm25")


@query(_ranked_sql(PLAIN, PROBABILISTIC, _terms_sql(PLAIN, False), "1.0e0") + "SELECT doc_id, string_agg(term, ' ' ORDER BY pos) AS terms, CAST(count(*) AS BIGINT) AS n FROM (SELECT doc_id, term, min(pos) AS pos FROM b GROUP BY doc_id, term) GROUP BY doc_id")
def matched_terms(spark, sf_dir):
    rows = ranking.search(units(spark, sf_dir), KEYS, {"q": QUERY}, ranking.SYMBOL, limit=None)
    return rows.select("doc_id", F.array_join("matched_terms", " ").alias("terms"), F.size("matched_terms").cast("long").alias("n"))


_PATH = "source || '/' || lang || '/' || doc_id || '.md'"


@query(_ranked_sql(PLAIN, PROBABILISTIC, _terms_sql(PLAIN, False), "1.0e0") + f"SELECT doc_id, round(score, 6) AS score FROM (SELECT r.*, row_number() OVER (ORDER BY round(score, 9) DESC, doc_id) AS k FROM r JOIN (SELECT doc_id, {_PATH} AS path FROM documents) USING (doc_id) WHERE ends_with(path, '.md') AND contains(path, '/en/') AND NOT contains(path, 'src1/')) WHERE k <= 10")
def bm25_filtered(spark, sf_dir):
    named = table(spark, sf_dir, "documents").select("doc_id", F.concat("source", F.lit("/"), "lang", F.lit("/"), F.col("doc_id").cast("string"), F.lit(".md")).alias("path"))
    named = named.where(paths.path_matches(F.col("path"), extensions=[".md"], contains="/en/", excludes=["src1/"]))
    scored = ranking.scored_terms(units(spark, sf_dir), KEYS, ranking.query_rows(spark, {"q": QUERY}, ranking.SYMBOL), ranking.SYMBOL)
    return ranking.rank(scored.join(named, "doc_id", "left_semi"), KEYS).select("doc_id", r6("score").alias("score"))


@query(f"WITH {_units_sql(IDENTIFIER)} SELECT doc_id, CAST(len(list_intersect(list_distinct(tokens), ['the', 'thing', 'and', 'that', 'tion'])) AS BIGINT) AS matches FROM u WHERE matches > 0 ORDER BY matches DESC, doc_id LIMIT 60")
def candidate_prune(spark, sf_dir):
    return ranking.candidates(units(spark, sf_dir, identifier_tokens), KEYS, QUERY.split(), 60)


@query(f"{_TFIDF}, q AS (SELECT DISTINCT term, idf AS qi FROM w WHERE term IN ('the', 'thing', 'and', 'that', 'tion')), ql AS (SELECT sqrt(sum(qi * qi)) AS ql FROM q), m AS (SELECT doc_id, sqrt(sum(tfidf * tfidf)) AS m FROM w GROUP BY doc_id), k AS (SELECT doc_id, sum(tfidf * qi) AS dot FROM w JOIN q USING (term) GROUP BY doc_id) SELECT doc_id, round(dot / (m * ql), 6) AS score FROM k JOIN m USING (doc_id), ql WHERE m > 0")
def sparse_cosine(spark, sf_dir):
    weighted = statistics.tfidf(units(spark, sf_dir, identifier_tokens), KEYS)
    return ranking.sparse_cosine(weighted, KEYS, QUERY).select("doc_id", r6("score").alias("score"))


# chunks


_WINDOWS = "SELECT doc_id, CAST(i AS INTEGER) AS chunk_index, substring(text, CAST(i * 900 + 1 AS BIGINT), 1000) AS chunk FROM documents, unnest(range(0, CAST(greatest(0, ceil((length(text) - 1000) / 900.0e0)) AS BIGINT) + 1)) AS t(i) WHERE length(text) > 0"


@query(f"SELECT doc_id, chunk_index, md5(chunk) AS digest FROM ({_WINDOWS})")
def chunk_windows(spark, sf_dir):
    return chunking.chunk_text(table(spark, sf_dir, "documents"), KEYS).select("doc_id", "chunk_index", F.md5("chunk").alias("digest"))


@query(_ranked_sql(IDENTIFIER, SMOOTHED, _terms_sql(IDENTIFIER, True), units_sql=f"u AS (SELECT doc_id, chunk_index, {IDENTIFIER.format('chunk')} AS tokens FROM ({_WINDOWS}))", key="doc_id, chunk_index") + "SELECT doc_id, chunk_index, round(score, 6) AS score, rank FROM r WHERE rank <= 20")
def chunk_bm25(spark, sf_dir):
    rows = ranking.with_tokens(chunking.chunk_text(spread(table(spark, sf_dir, "documents").select("doc_id", "text")), KEYS), ranking.CHUNK, "chunk")
    best = ranking.search(rows, ["doc_id", "chunk_index"], {"q": QUERY}, ranking.CHUNK, limit=20)
    return best.select("doc_id", "chunk_index", r6("score").alias("score"), F.col("rank").cast("long").alias("rank"))


@query("SELECT doc_id, md5(array_to_string(list_transform(string_split(text, chr(10)), lambda x, i: i || ': ' || x), chr(10))) AS digest FROM documents")
def line_numbers(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(chunking.numbered(F.split("text", "\n"), F.lit(1))).alias("digest"))


_TERMS = ["thing", "tion"]
_HITS = "h AS (SELECT doc_id, i - 1 AS ln, len(ls) AS n, list_filter(['thing', 'tion'], lambda t: contains(lower(ls[i]), t)) AS found FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents), unnest(range(1, len(ls) + 1)) AS t(i)), g AS (SELECT *, CASE WHEN ln - lag(ln) OVER (PARTITION BY doc_id ORDER BY ln) > 7 THEN 1 ELSE 0 END AS apart FROM h WHERE len(found) > 0), k AS (SELECT *, sum(apart) OVER (PARTITION BY doc_id ORDER BY ln) AS block FROM g)"
_BLOCKS = f"WITH {_HITS}, b AS (SELECT doc_id, block, greatest(min(ln) - 3, 0) + 1 AS first, least(max(ln) + 3, max(n) - 1) + 1 AS last, len(list_distinct(flatten(list(found)))) AS n_terms FROM k GROUP BY doc_id, block)"


@query(f"{_BLOCKS} SELECT doc_id, CAST(block AS BIGINT) AS block, CAST(first AS BIGINT) AS first, CAST(last AS BIGINT) AS last, CAST(n_terms AS BIGINT) AS n_terms FROM b")
def snippet_blocks(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").withColumn("terms", F.array(*map(F.lit, _TERMS)))
    rows = snippets.snippet_blocks(docs, KEYS, text_col="text", terms_col="terms")
    return rows.select("doc_id", *(F.col(c).cast("long").alias(c) for c in ("block", "first", "last", "n_terms")))


@query(
    f"{_BLOCKS}, o AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY n_terms DESC, n_terms / CAST(last - first + 1 AS DOUBLE) DESC, first) AS r FROM b), "
    "e AS (SELECT doc_id, first, array_to_string(list_transform(string_split(text, chr(10))[first:last], lambda x, i: (first + i - 1) || ': ' || x), chr(10)) AS body FROM o JOIN documents USING (doc_id) WHERE r <= 4), "
    "f AS (SELECT *, sum(length(body)) OVER (PARTITION BY doc_id ORDER BY first) AS upto, row_number() OVER (PARTITION BY doc_id ORDER BY first) AS nth FROM e), "
    "s AS (SELECT doc_id, string_agg(body, chr(10) || '...' || chr(10) ORDER BY first) AS snippet FROM f WHERE upto <= 2000 OR nth = 1 GROUP BY doc_id) "
    "SELECT doc_id, md5(coalesce(snippet, array_to_string(string_split(text, chr(10))[1:5], chr(10)))) AS digest FROM documents LEFT JOIN s USING (doc_id)"
)
def snippet_text(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").withColumn("terms", F.array(*map(F.lit, _TERMS)))
    return snippets.snippets(docs, KEYS, text_col="text", terms_col="terms").select("doc_id", F.md5("snippet").alias("digest"))


def _values(rows) -> str:
    return ", ".join("(" + ", ".join("NULL" if v is None else repr(v) for v in row) + ")" for row in rows)


def _code(spark, sf_dir) -> DataFrame:
    """Documents as files: before every third line stands a function, before every other third a class."""
    content = F.expr("array_join(transform(split(text, '\\n'), (x, i) -> CASE i % 3 WHEN 0 THEN concat('export function f', i, '(a) {\\n', x) WHEN 1 THEN concat('class C', i, '\\n', x) ELSE x END), '\\n')")
    path = F.concat(F.col("doc_id").cast("string"), F.lit(".ts"))
    return table(spark, sf_dir, "documents").select(path.alias("path"), F.when(F.expr("doc_id % 4 = 0"), F.col("text")).otherwise(content).alias("content"))


_CODE_SQL = (
    "code AS (SELECT doc_id || '.ts' AS path, CASE WHEN doc_id % 4 = 0 THEN text ELSE array_to_string(list_transform(string_split(text, chr(10)), "
    "lambda x, i: CASE (i - 1) % 3 WHEN 0 THEN 'export function f' || (i - 1) || '(a) {' || chr(10) || x WHEN 1 THEN 'class C' || (i - 1) || chr(10) || x ELSE x END), chr(10)) END AS content FROM documents), "
    "ls AS (SELECT path, content, CASE WHEN ls[-1] = '' THEN ls[:-2] ELSE ls END AS ls FROM (SELECT path, content, regexp_split_to_array(content, '\\r?\\n') AS ls FROM code)), "
    "marks(k, pattern, kind) AS (VALUES (0, '^export\\s+(?:async\\s+)?function\\s+([A-Za-z_][A-Za-z0-9_]*)', 'function'), (1, '^export\\s+class\\s+([A-Za-z_][A-Za-z0-9_]*)', 'class'), "
    "(2, '^export\\s+const\\s+([A-Za-z_][A-Za-z0-9_]*)\\s*=', 'const'), (3, '^(?:async\\s+)?function\\s+([A-Za-z_][A-Za-z0-9_]*)', 'function'), (4, '^def\\s+([A-Za-z_][A-Za-z0-9_]*)\\s*\\(', 'function'), (5, '^class\\s+([A-Za-z_][A-Za-z0-9_]*)', 'class')), "
    "found AS (SELECT path, CAST(i AS INTEGER) AS start_line, k, regexp_extract(ls[i], pattern, 1) AS symbol_name, kind AS chunk_type FROM ls, unnest(range(1, len(ls) + 1)) AS t(i), marks WHERE regexp_matches(ls[i], pattern)), "
    "spans AS (SELECT path, start_line, symbol_name, chunk_type, min(k) AS k FROM found GROUP BY ALL)"
)


@query(f"WITH {_CODE_SQL} SELECT path, start_line, symbol_name, chunk_type FROM spans")
def symbol_spans(spark, sf_dir):
    return chunking.symbol_spans(_code(spark, sf_dir)).drop("pattern")


@query(
    f"WITH {_CODE_SQL}, w AS (SELECT *, lead(start_line) OVER (PARTITION BY path ORDER BY start_line, k) AS following, min(start_line) OVER (PARTITION BY path) AS top FROM spans), "
    "j AS (SELECT path, content, ls, len(ls) AS n, symbol_name, chunk_type, top, start_line AS s, greatest(coalesce(following - 1, len(ls)), start_line) AS e FROM ls LEFT JOIN w USING (path)) "
    "SELECT path, coalesce(s, 1) AS start_line, CAST(CASE WHEN s IS NULL THEN greatest(n, 1) ELSE e END AS INTEGER) AS end_line, symbol_name, coalesce(chunk_type, 'file') AS chunk_type, "
    "md5(CASE WHEN s IS NULL THEN content WHEN array_to_string(ls[1:top - 1], chr(10)) = '' OR top = 1 THEN array_to_string(ls[s:e], chr(10)) ELSE array_to_string(ls[1:top - 1], chr(10)) || chr(10) || array_to_string(ls[s:e], chr(10)) END) AS digest FROM j"
)
def symbol_chunks(spark, sf_dir):
    return chunking.chunk_symbols(_code(spark, sf_dir)).select("path", "start_line", "end_line", "symbol_name", "chunk_type", F.md5("text").alias("digest"))


@query()
def markup_chunks(spark, sf_dir):
    pages = table(spark, sf_dir, "pages").select(F.concat("page_id", F.lit(".html")).alias("path"), F.col("html").alias("content"))
    return structure.chunk_structure(pages).groupBy("path", "type").agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("content")).alias("n_chars"))


# vectors


_V0 = "(SELECT CAST(embedding AS DOUBLE[]) AS q FROM embeddings WHERE vec_id = 0)"
_L2 = "sqrt(list_sum(list_transform(list_zip({0}, {1}), lambda z: (z[1] - z[2]) * (z[1] - z[2]))))"


def _vector(spark, sf_dir, vec_id: int) -> list[float]:
    return table(spark, sf_dir, "embeddings").where(F.col("vec_id") == vec_id).first().embedding


@query(f"SELECT vec_id, round({_L2.format('CAST(embedding AS DOUBLE[])', 'q')}, 6) AS distance FROM embeddings, {_V0} ORDER BY {_L2.format('CAST(embedding AS DOUBLE[])', 'q')}, vec_id LIMIT 10")
def knn_l2(spark, sf_dir):
    rows = vector_search.nearest(table(spark, sf_dir, "embeddings"), _vector(spark, sf_dir, 0), 10, id_col="vec_id", vector_col="embedding")
    return rows.select("vec_id", r6("distance").alias("distance"))


@query(f"SELECT vec_id, round(1.0e0 / (1.0e0 + {_L2.format('CAST(embedding AS DOUBLE[])', 'q')}), 6) AS score FROM embeddings, {_V0} WHERE label = 1 AND score >= 0.3e0 ORDER BY score DESC, vec_id LIMIT 10")
def knn_filtered(spark, sf_dir):
    rows = vector_search.nearest(table(spark, sf_dir, "embeddings"), _vector(spark, sf_dir, 0), 10, id_col="vec_id", vector_col="embedding", where=F.col("label") == 1, min_score=0.3)
    return rows.select("vec_id", r6("score").alias("score"))


@query(f"SELECT query_id, vec_id, round(distance, 6) AS distance, rank FROM (SELECT query_id, vec_id, distance, row_number() OVER (PARTITION BY query_id ORDER BY distance, vec_id) AS rank FROM (SELECT a.vec_id AS query_id, b.vec_id, {_L2.format('CAST(b.embedding AS DOUBLE[])', 'CAST(a.embedding AS DOUBLE[])')} AS distance FROM embeddings a, embeddings b WHERE a.vec_id % 20 = 0)) WHERE rank <= 5")
def knn_batch(spark, sf_dir):
    vectors = table(spark, sf_dir, "embeddings")
    asked = vectors.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query_vector"))
    index = vector_clusters.VectorIndex(spark, temporary_folder(spark, "vectors"), "vec_id")
    index.build(vectors, vector_col="embedding")
    return index.search_batch(asked, 5).select("query_id", "vec_id", r6("distance").alias("distance"), F.col("rank").cast("long").alias("rank"))


@query(f"SELECT vec_id, round({_L2.format('CAST(embedding AS DOUBLE[])', 'q')}, 6) AS distance FROM embeddings, (SELECT CAST(embedding AS DOUBLE[]) AS q FROM embeddings WHERE vec_id = 7) WHERE label <> 3 ORDER BY {_L2.format('CAST(embedding AS DOUBLE[])', 'q')}, vec_id LIMIT 12")
def knn_clusters(spark, sf_dir):
    index = vector_clusters.VectorIndex(spark, temporary_folder(spark, "vectors"), "vec_id")
    index.build(table(spark, sf_dir, "embeddings"), vector_col="embedding", keep=("label",))
    return index.search(_vector(spark, sf_dir, 7), 12, F.col("label") != 3).select("vec_id", r6("distance").alias("distance"))


@query(f"SELECT vec_id, round(list_cosine_similarity(CAST(embedding AS DOUBLE[]), q), 6) AS cosine FROM embeddings, {_V0}")
def dense_cosine(spark, sf_dir):
    q = F.array(*(F.lit(float(x)) for x in _vector(spark, sf_dir, 0)))
    return table(spark, sf_dir, "embeddings").select("vec_id", r6(numeric.cosine(F.col("embedding"), q)).alias("cosine"))


def _printed(vector: Column) -> Column:
    return F.array_join(F.transform(vector, lambda x: F.format_string("%.5f", F.round(x, 5) + F.lit(0.0))), " ")


@query("SELECT vec_id, array_to_string(list_transform(CAST(embedding AS DOUBLE[]), lambda x: printf('%.5f', round(x / sqrt(list_sum(list_transform(CAST(embedding AS DOUBLE[]), lambda y: y * y))), 5) + 0e0)), ' ') AS v FROM embeddings")
def normalize_vectors(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").select("vec_id", _printed(numeric.normalized(F.col("embedding"))).alias("v"))


_UNITS = "flatten(list_transform(regexp_extract_all(text, '(?s).'), lambda c: CASE WHEN unicode(c) > 65535 THEN [CAST(55232 + (unicode(c) >> 10) AS BIGINT), CAST(56320 + (unicode(c) & 1023) AS BIGINT)] ELSE [CAST(unicode(c) AS BIGINT)] END))"
_HASH = _UNITS.join(("list_reduce(", ", lambda a, c: CASE WHEN ((a * 31 + c) & 4294967295) >= 2147483648 THEN ((a * 31 + c) & 4294967295) - 4294967296 ELSE (a * 31 + c) & 4294967295 END, CAST(0 AS BIGINT))"))


@query(f"SELECT doc_id, h, CASE WHEN h < 0 THEN '-' ELSE '' END || lower(to_base(abs(h), 36)) AS digits FROM (SELECT doc_id, {_HASH} AS h FROM documents)")
def poly_hash(spark, sf_dir):
    rows = spread(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return rows.select("doc_id", numeric.poly_hash32(F.col("text")).alias("h"), numeric.poly_hash(F.col("text")).alias("digits"))


@query(f"WITH k AS MATERIALIZED (SELECT doc_id, {_HASH} AS h FROM documents), r AS MATERIALIZED (SELECT doc_id, i, (sin(CAST(h AS DOUBLE) + i) + cos((CAST(h AS DOUBLE) + i) / 2.0e0)) / 2.0e0 AS x FROM k, range(0, 16) AS t(i)) SELECT doc_id, string_agg(printf('%.5f', round(x / n, 5) + 0e0), ' ' ORDER BY i) AS v FROM r JOIN (SELECT doc_id, sqrt(sum(x * x)) AS n FROM r GROUP BY doc_id) USING (doc_id) GROUP BY doc_id")
def mock_embedding(spark, sf_dir):
    v = numeric.mock_embedding(F.col("text"), 16)
    return table(spark, sf_dir, "documents").select("doc_id", F.when(F.col("text").isNotNull(), _printed(v)).alias("v"))


# blending


def _lists(spark, sf_dir):
    """The best 50 by BM25 and the 50 vectors nearest to the first, under one key."""
    lexical = ranking.search(units(spark, sf_dir), KEYS, {"q": QUERY}, ranking.SYMBOL, limit=50)
    vector = vector_search.nearest(table(spark, sf_dir, "embeddings"), _vector(spark, sf_dir, 0), 50, id_col="vec_id", vector_col="embedding")
    return vector.select(F.col("vec_id").alias("key"), "score"), lexical.select(F.col("doc_id").alias("key"), "score", "matched_terms")


_LISTS = (
    _ranked_sql(PLAIN, PROBABILISTIC, _terms_sql(PLAIN, False), "1.0e0")
    + f", v AS (SELECT vec_id AS key, 1.0e0 / (1.0e0 + {_L2.format('CAST(embedding AS DOUBLE[])', 'q')}) AS score FROM embeddings, {_V0} ORDER BY {_L2.format('CAST(embedding AS DOUBLE[])', 'q')}, vec_id LIMIT 50), x AS (SELECT doc_id AS key, score, "
    + "array_to_string(list_transform(list_sort((SELECT list({'pos': pos, 'term': term}) FROM (SELECT min(pos) AS pos, term FROM b WHERE b.doc_id = r.doc_id GROUP BY term))), lambda y: y.term), ' ') AS terms FROM r WHERE rank <= 50)"
)


@query(f"{_LISTS} SELECT key, round(coalesce(v.score / vm, 0) * 0.7e0 + coalesce(x.score / xm, 0) * 0.3e0, 6) AS score, CASE WHEN v.score IS NULL THEN 'lexical' WHEN x.score IS NULL THEN 'vector' ELSE 'hybrid' END AS method FROM v FULL JOIN x USING (key), (SELECT greatest(max(score), 0.01e0) AS vm FROM v), (SELECT greatest(max(score), 0.01e0) AS xm FROM x) ORDER BY coalesce(v.score / vm, 0) * 0.7e0 + coalesce(x.score / xm, 0) * 0.3e0 DESC, key LIMIT 30")
def hybrid_merge(spark, sf_dir):
    vector, lexical = _lists(spark, sf_dir)
    return hybrid.merge_hybrid(vector, lexical.select("key", "score"), 0.7, limit=30).select("key", r6("score").alias("score"), "method")


_BLENDED = "CASE WHEN v.score IS NOT NULL AND x.score IS NOT NULL THEN 0.7e0 * v.score + 0.3e0 * x.score ELSE coalesce(0.85e0 * v.score, 0.35e0 * x.score) END"


@query(f"{_LISTS} SELECT 'p' || lpad(CAST(key AS VARCHAR), 9, '0') AS path, round({_BLENDED}, 6) AS score, concat_ws(' ', CASE WHEN v.score IS NOT NULL THEN 'semantic' END, x.terms) AS terms FROM v FULL JOIN x USING (key) ORDER BY {_BLENDED} DESC, path LIMIT 30")
def coordinator_merge(spark, sf_dir):
    path = F.format_string("p%09d", "key").alias("path")
    vector, lexical = _lists(spark, sf_dir)
    vector, lexical = (df.select(path, F.lit(1).alias("start_line"), F.lit(2).alias("end_line"), "score", terms.alias("matched_terms")) for df, terms in ((vector, F.array(F.lit("semantic"))), (lexical, F.col("matched_terms"))))
    return hybrid.merge_coordinated(lexical, vector, 30).select("path", r6("score").alias("score"), F.array_join("matched_terms", " ").alias("terms"))


# changes


def _snapshots(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    old = docs.where("doc_id % 10 <> 3").select("doc_id", F.sha2("text", 256).alias("hash"))
    new = docs.where("doc_id % 7 <> 2").select("doc_id", F.sha2(F.when(F.expr("doc_id % 5 = 1"), F.concat("text", F.lit("x"))).otherwise(F.col("text")), 256).alias("hash"))
    return old, new


_SNAPSHOTS = "o AS (SELECT doc_id, sha256(text) AS h FROM documents WHERE doc_id % 10 <> 3), n AS (SELECT doc_id, sha256(CASE WHEN doc_id % 5 = 1 THEN text || 'x' ELSE text END) AS h FROM documents WHERE doc_id % 7 <> 2)"


@query(f"WITH {_SNAPSHOTS} SELECT doc_id, CASE WHEN o.h IS NULL THEN 'added' WHEN n.h IS NULL THEN 'deleted' WHEN o.h <> n.h THEN 'changed' ELSE 'unchanged' END AS change_type FROM o FULL JOIN n USING (doc_id)")
def snapshot_diff(spark, sf_dir):
    return changes.snapshot_diff(*_snapshots(spark, sf_dir), key="doc_id")


@query(f"WITH {_SNAPSHOTS} SELECT doc_id FROM o WHERE doc_id NOT IN (SELECT doc_id FROM n)")
def anti_join_deleted(spark, sf_dir):
    old, new = _snapshots(spark, sf_dir)
    return old.join(new.select("doc_id"), "doc_id", "left_anti").select("doc_id")


@query(f"WITH {_SNAPSHOTS}, k AS (SELECT doc_id FROM o FULL JOIN n USING (doc_id) WHERE o.h IS DISTINCT FROM n.h) SELECT doc_id, h AS hash FROM o WHERE doc_id NOT IN (SELECT doc_id FROM k) UNION ALL SELECT doc_id, h FROM n WHERE doc_id IN (SELECT doc_id FROM k)")
def retain_unaffected(spark, sf_dir):
    old, new = _snapshots(spark, sf_dir)
    changed = changes.snapshot_diff(old, new, key="doc_id").where("change_type <> 'unchanged'")
    return changes.apply_changes(old, changed, new.join(changed.select("doc_id"), "doc_id", "left_semi"), "doc_id")


@query(f"WITH {_units_sql()}, p AS (SELECT DISTINCT doc_id, term FROM u, unnest(tokens) AS t(term)) SELECT term, CAST(count(*) AS BIGINT) AS df FROM p WHERE doc_id % 10 <> 3 GROUP BY term")
def delta_df(spark, sf_dir):
    rows = units(spark, sf_dir)
    before = statistics.frequencies(rows.where("doc_id % 5 <> 0"))
    return changes.updated_frequencies(before, rows.where("doc_id % 5 <> 0 AND doc_id % 10 = 3"), rows.where("doc_id % 5 = 0"))


@query(f"WITH {_units_sql()}, p AS (SELECT DISTINCT doc_id, term FROM u, unnest(tokens) AS t(term)), f AS (SELECT count(DISTINCT term) AS k FROM p WHERE doc_id % 10 = 0 AND term NOT IN (SELECT term FROM p WHERE doc_id % 10 <> 0)) SELECT CAST(m AS BIGINT) AS n_updates, CAST(k AS BIGINT) AS new_terms, m / CAST(n AS DOUBLE) > 0.2e0 OR k > 1000 AS full_rebuild FROM f, (SELECT count(*) FILTER (doc_id % 10 = 0) AS m, count(*) FILTER (doc_id % 10 <> 0) AS n FROM documents)")
def rebuild_decision(spark, sf_dir):
    rows = units(spark, sf_dir)
    known = rows.where("doc_id % 10 <> 0")
    df = statistics.frequencies(known)
    return changes.rebuild_statistics(df, rows.where("doc_id % 10 = 0"), known.count())


@query("WITH g AS (SELECT *, CASE WHEN ts - lag(ts) OVER w >= INTERVAL 1 HOUR THEN 1 ELSE 0 END AS apart FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)), k AS (SELECT *, sum(apart) OVER (PARTITION BY user_id ORDER BY ts) AS burst FROM g) SELECT user_id, min(ts) AS first_at, max(ts) AS last_at, CAST(count(*) AS BIGINT) AS n FROM k GROUP BY user_id, burst")
def debounce_events(spark, sf_dir):
    return changes.debounce(table(spark, sf_dir, "events"), "user_id", "ts", "1 hour", "event_type").select("user_id", "first_at", "last_at", "n")


@query("SELECT user_id, event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r FROM events) WHERE r = 1")
def change_log_latest(spark, sf_dir):
    return changes.latest_changes(table(spark, sf_dir, "events"), "user_id", ["ts", "event_id"]).select("user_id", "event_id", "event_type")


@query("SELECT time_bucket(INTERVAL 1 DAY, ts) AS day, event_type, CAST(count(*) AS BIGINT) AS n FROM events GROUP BY ALL")
def windowed_events(spark, sf_dir):
    rows = table(spark, sf_dir, "events").groupBy(F.window("ts", "1 day").alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"))
    return rows.select(F.col("w.start").alias("day"), "event_type", "n")


# other


@query(_ranked_sql(PLAIN, PROBABILISTIC, _terms_sql(PLAIN, False), "1.0e0") + "SELECT quality, CAST(count(*) AS BIGINT) AS n, round(avg(score), 6) AS score FROM r JOIN labels USING (doc_id) GROUP BY quality")
def retrieval_eval(spark, sf_dir):
    hits = ranking.search(units(spark, sf_dir), KEYS, {"q": QUERY}, ranking.SYMBOL, limit=None)
    return hits.join(table(spark, sf_dir, "labels"), "doc_id").groupBy("quality").agg(F.count(F.lit(1)).alias("n"), r6(F.avg("score")).alias("score"))


@query("SELECT sha256(text) AS hash, CAST(count(*) AS BIGINT) AS n, min(doc_id) AS first_id FROM documents GROUP BY 1")
def dedupe_hash(spark, sf_dir):
    return table(spark, sf_dir, "documents").groupBy(F.sha2("text", 256).alias("hash")).agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("first_id"))


def _probes(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "documents").select("source", "lang", F.expr("CASE WHEN n_chars > 25000 THEN 'fail' WHEN n_chars < 20 THEN 'warn' ELSE 'ok' END").alias("status"))


@query("SELECT source, CASE WHEN bool_or(s = 'fail') THEN 'unavailable' WHEN bool_or(s = 'warn') THEN 'degraded' ELSE 'ready' END AS status FROM (SELECT source, CASE WHEN n_chars > 25000 THEN 'fail' WHEN n_chars < 20 THEN 'warn' ELSE 'ok' END AS s FROM documents) GROUP BY source")
def status_fold(spark, sf_dir):
    return changes.fold_status(_probes(spark, sf_dir), by=["source"]).select("source", "status")


@query("SELECT CASE WHEN bool_or(n_chars > 25000) THEN 'unavailable' WHEN bool_or(n_chars < 20) THEN 'degraded' ELSE 'ready' END AS status, CAST(bool_or(n_chars > 25000) AS INTEGER) AS exit_code FROM documents")
def doctor_fold(spark, sf_dir):
    return changes.fold_status(_probes(spark, sf_dir))


#: Endings of the paths that documents get, by doc_id.
_NAMES = ("{}.TS", "Dockerfile", "node_modules/{}.js", ".env.{}", "{}.png", "t/{}.rs", "a-b.{}.Py", "Makefile", "dist/x{}.tsx", "{}.d.md", ".gitignore", "{}.config", "no{}")
_NAMED = "source || '/' || CASE doc_id % {} {} END".format(len(_NAMES), " ".join(f"WHEN {i} THEN " + " || ".join(f"'{x}'" if x != "{}" else "CAST(doc_id AS VARCHAR)" for x in n.replace("{}", "\0{}\0").split("\0") if x) for i, n in enumerate(_NAMES)))
_SETS = {n: ", ".join(f"'{x}'" for x in v) for n, v in {"text": paths.TEXT_EXTENSIONS, "names": paths.TEXT_NAMES, "skipped": paths.SKIPPED_SEGMENTS}.items()}
_SUFFIXES = " OR ".join(f"ends_with(path, '{x}')" for x in paths.INDEX_EXTENSIONS)
_LANGUAGES = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in paths.DISPLAY_LANGUAGES.items())


@query(
    f"WITH p AS (SELECT doc_id, {_NAMED} AS path FROM documents), b AS (SELECT *, string_split(path, '/')[-1] AS base FROM p), e AS (SELECT *, lower(regexp_extract(base, '^.+(\\.[^.]*)$', 1)) AS ext FROM b) "
    f"SELECT doc_id, path, base, ext, CASE ext {_LANGUAGES} END AS language, ext IN ({_SETS['text']}) OR lower(base) IN ({_SETS['names']}) OR starts_with(lower(base), '.env') AS is_text, "
    f"{_SUFFIXES} AS indexable, len(list_intersect(string_split(path, '/'), [{_SETS['skipped']}])) > 0 AS skipped, translate(path, '/.-', '   ') AS words FROM e"
)
def path_functions(spark, sf_dir):
    number, n = F.col("doc_id").cast("string"), F.lit(len(_NAMES))
    ends = F.element_at(F.array(*(F.replace(F.lit(x), F.lit("{}"), number) for x in _NAMES)), (F.col("doc_id") % n + 1).cast("int"))
    p = F.col("path")
    rows = table(spark, sf_dir, "documents").select("doc_id", F.concat("source", F.lit("/"), ends).alias("path"))
    return rows.select("doc_id", "path", paths.basename(p).alias("base"), paths.extension(p).alias("ext"), paths.display_language(p).alias("language"), paths.is_text_file(p).alias("is_text"), paths.is_indexable(p).alias("indexable"), paths.has_skipped_segment(p).alias("skipped"), paths.path_words(p).alias("words"))


@query("SELECT source || '/' || doc_id || '.ts' AS path, CASE WHEN doc_id % 3 = 0 THEN NULL ELSE CAST(doc_id AS INTEGER) END AS start_line, CASE WHEN doc_id % 3 = 0 THEN NULL ELSE CAST(doc_id + n_chars AS INTEGER) END AS end_line FROM documents")
def chunk_ids(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", F.concat("source", F.lit("/"), F.col("doc_id").cast("string"), F.lit(".ts")).alias("path"), F.expr("doc_id + n_chars").alias("end"))
    key = F.when(F.expr("doc_id % 3 = 0"), F.concat(F.lit("file://"), F.col("path"))).otherwise(F.format_string("chunk://%s:%d-%d", "path", "doc_id", "end"))
    return docs.select(paths.parse_chunk_id(key).alias("k")).select("k.*")


# records


@query("SELECT doc_id, coalesce(source, '') AS type, coalesce(lang, '') AS language, '' AS category, '' AS path, '{\"n_chars\":\"' || n_chars || '\"}' AS metadata_json FROM documents")
def flatten_metadata(spark, sf_dir):
    meta = F.create_map(F.lit("type"), F.col("source"), F.lit("language"), F.col("lang"), F.lit("n_chars"), F.col("n_chars").cast("string"))
    return records.flattened(table(spark, sf_dir, "documents").select("doc_id", meta.alias("metadata")))


@query("SELECT doc_id, coalesce(source, '-') AS source, coalesce(lang, '-') AS lang, CAST(n_chars AS VARCHAR) AS n_chars, CAST(1 + (coalesce(source, '') <> '')::INT + (coalesce(lang, '') <> '')::INT AS INTEGER) AS n FROM documents")
def unflatten_metadata(spark, sf_dir):
    back = records.unflattened(flatten_metadata(spark, sf_dir))
    value = lambda k: F.coalesce(F.try_element_at("metadata", F.lit(k)), F.lit("-"))
    return back.select("doc_id", value("type").alias("source"), value("language").alias("lang"), value("n_chars").alias("n_chars"), F.size("metadata").alias("n"))


@query(
    f"WITH {_units_sql()}, x AS (SELECT doc_id, term FROM u, unnest(tokens) AS t(term)), f AS (SELECT DISTINCT term FROM x WHERE doc_id % 10 = 3 OR doc_id % 5 = 0) "
    "SELECT (SELECT count(DISTINCT doc_id) FROM x WHERE doc_id % 10 <> 3 AND doc_id % 5 <> 0 AND term IN (SELECT term FROM f)) + count(*) FILTER (doc_id % 5 = 0) AS affected_units, "
    "(SELECT count(*) FROM f) AS affected_terms, count(*) FILTER (doc_id % 10 <> 3) AS total_units FROM u"
)
def incremental_stats(spark, sf_dir):
    rows = units(spark, sf_dir)
    return records.incremental_statistics(rows.where("doc_id % 5 <> 0"), rows.where("doc_id % 10 = 3"), rows.where("doc_id % 5 = 0"), KEYS)


@query(f"SELECT doc_id, md5(chunk) AS digest, 'text' AS type, 0 AS start_line, 0 AS end_line, true AS fallback, chunk_index AS index FROM ({_WINDOWS})")
def fallback_chunks(spark, sf_dir):
    rows = records.fallback_chunks(chunking.chunk_text(table(spark, sf_dir, "documents"), KEYS), KEYS)
    return rows.select("doc_id", F.md5("content").alias("digest"), "type", "start_line", "end_line", "fallback", "index")


@query("SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%S.%gZ') AS iso FROM events")
def iso_times(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", records.iso_time(F.col("ts")).alias("iso"))


# the index in a store, and streams


def document_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spread(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return docs.select("doc_id", F.format_string("d%09d.md", "doc_id").alias("path"), F.col("text").alias("content"), F.sha2("text", 256).alias("hash"), F.octet_length("text").alias("size"), F.lit(None).cast("timestamp").alias("mtime"), F.lit("Markdown").alias("language"))


def built_index(spark: SparkSession, files: DataFrame, embedding: EmbeddingConfig | None = None) -> Engine:
    """A new index of files in a folder of its own."""
    engine = Engine(spark, Store(spark, temporary_folder(spark, "index")), embedding)
    engine.build(files.drop("doc_id"), "documents")
    return engine


#: Indexes of this session by name and data: queries that only read one share it.
_shared: dict[tuple, Engine] = {}


def _once(spark: SparkSession, sf_dir: str, name: str, make: Callable[[], Engine]) -> Engine:
    key = (spark.sparkContext.applicationId, sf_dir, name)
    if key not in _shared:
        _shared[key] = make()
    return _shared[key]


def _built(spark: SparkSession, sf_dir: str) -> Engine:
    return _once(spark, sf_dir, "all", lambda: built_index(spark, document_files(spark, sf_dir)))


def _updated(spark: SparkSession, sf_dir: str) -> Engine:
    return _once(spark, sf_dir, "updated", lambda: _make_updated(spark, sf_dir))


def _make_updated(spark, sf_dir) -> Engine:
    """An index of some documents after the others came, some changed and some went, in two updates."""
    files = document_files(spark, sf_dir)
    engine = built_index(spark, files.where("doc_id % 10 <> 3"))
    changed = files.where("doc_id % 5 = 1").withColumn("content", F.concat("content", F.lit(" thing and that"))).withColumn("hash", F.sha2("content", 256))
    engine.update(files.where("doc_id % 10 = 3").drop("doc_id"), files.where("doc_id % 7 = 2").limit(0).select("path"))
    engine.update(changed.drop("doc_id"), files.where("doc_id % 7 = 2 AND doc_id % 5 <> 1").select("path"))
    return engine


def _hits(spark, engine: Engine) -> DataFrame:
    rows = [(h["path"], round(h["score"], 6), h["rank"], " ".join(h["matched_terms"])) for h in engine.search(QUERY, content=False)]
    return spark.createDataFrame(rows, "path string, score double, rank long, terms string")


_MARKDOWN = PLAIN.format("'d' || lpad(CAST(doc_id AS VARCHAR), 9, '0') || ' md ' || text")
_INDEXED = f"u AS (SELECT 'd' || lpad(CAST(doc_id AS VARCHAR), 9, '0') || '.md' AS path, {_MARKDOWN} AS tokens FROM documents)"
_FINAL = f"u AS (SELECT 'd' || lpad(CAST(doc_id AS VARCHAR), 9, '0') || '.md' AS path, {_MARKDOWN} AS tokens FROM (SELECT doc_id, CASE WHEN doc_id % 5 = 1 THEN text || ' thing and that' ELSE text END AS text FROM documents WHERE NOT (doc_id % 7 = 2 AND doc_id % 5 <> 1)))"
_FOUND = "SELECT path, round(score, 6) AS score, rank, (SELECT string_agg(term, ' ' ORDER BY pos) FROM (SELECT min(pos) AS pos, term FROM b WHERE b.path = r.path GROUP BY term)) AS terms FROM r WHERE rank <= 10"


@query(_ranked_sql(PLAIN, PROBABILISTIC, _terms_sql(PLAIN, False), "1.0e0", units_sql=_INDEXED, key="path") + _FOUND)
def indexed_search(spark, sf_dir):
    return _hits(spark, _built(spark, sf_dir))


@query(_ranked_sql(PLAIN, PROBABILISTIC, _terms_sql(PLAIN, False), "1.0e0", units_sql=_FINAL, key="path") + _FOUND)
def incremental_search(spark, sf_dir):
    return _hits(spark, _updated(spark, sf_dir))


@query(f"WITH {_FINAL} SELECT term, CAST(count(DISTINCT path) AS BIGINT) AS df FROM u, unnest(tokens) AS t(term) GROUP BY term")
def incremental_equals_full(spark, sf_dir):
    return _updated(spark, sf_dir).store.terms()


@query("SELECT 'd' || lpad(CAST(doc_id AS VARCHAR), 9, '0') || '.md' AS path, sha256(CASE WHEN doc_id % 5 = 1 THEN text || ' thing and that' ELSE text END) AS hash FROM documents WHERE NOT (doc_id % 7 = 2 AND doc_id % 5 <> 1)")
def store_file_metadata(spark, sf_dir):
    return _updated(spark, sf_dir).store.file_metadata().select("path", "hash")


@query(f"WITH {_INDEXED} SELECT path, CAST(count(DISTINCT term) AS BIGINT) AS matches, string_agg(DISTINCT term, ' ' ORDER BY term) AS terms FROM u, unnest(tokens) AS t(term) WHERE term IN ('that', 'thing', 'tion') GROUP BY path ORDER BY matches DESC, path LIMIT 40")
def search_by_terms(spark, sf_dir):
    return _built(spark, sf_dir).by_terms(["that", "thing", "tion"], 40).select("path", "matches", F.array_join("matched_terms", " ").alias("terms"))


@query(f"WITH {_INDEXED}, p AS (SELECT DISTINCT path, term FROM u, unnest(tokens) AS t(term)) SELECT term, round(ln((n - count(*) + 0.5e0) / (count(*) + 0.5e0) + 1.0e0), 6) AS idf FROM p, (SELECT CAST(count(*) AS DOUBLE) AS n FROM u) WHERE term IN ('that', 'thing', 'none') GROUP BY term, n")
def stored_idf(spark, sf_dir):
    store = _built(spark, sf_dir).store
    return store.terms(["that", "thing", "none"]).select("term", r6(idf_probabilistic(F.lit(store.get_metadata("n_chunks")), F.col("df"))).alias("idf"))


@query(f"WITH {_INDEXED} SELECT DISTINCT term FROM u, unnest(tokens) AS t(term) WHERE path IN (SELECT 'd' || lpad(CAST(doc_id AS VARCHAR), 9, '0') || '.md' FROM labels WHERE toxic = 1)")
def terms_for_files(spark, sf_dir):
    toxic = table(spark, sf_dir, "labels").where("toxic = 1").select(F.format_string("d%09d.md", "doc_id").alias("path"))
    return _built(spark, sf_dir).store.terms_of(toxic)


_WEIGHTED = (
    ", w AS (SELECT path, term, count(*) AS raw_freq, any_value(len(tokens)) AS token_count FROM u, unnest(tokens) AS t(term) GROUP BY path, term), d AS (SELECT term, count(*) AS df FROM w GROUP BY term), c AS (SELECT count(*) AS n FROM u), "
    f"v AS (SELECT path, term, raw_freq, token_count, raw_freq / CAST(token_count AS DOUBLE) AS tf, raw_freq / CAST(token_count AS DOUBLE) * ({SMOOTHED}) AS tfidf FROM w JOIN d USING (term), c), m AS (SELECT path, sqrt(sum(tfidf * tfidf)) AS magnitude FROM v GROUP BY path)"
)
_WEIGHTS = "SELECT path, term, raw_freq, token_count, round(tf, 6) AS tf, round(tfidf, 6) AS tfidf, round(magnitude, 6) AS magnitude FROM v JOIN m USING (path)"


def _weights(rows: DataFrame) -> DataFrame:
    return rows.select("path", "term", "raw_freq", "token_count", r6("tf").alias("tf"), r6("tfidf").alias("tfidf"), r6("magnitude").alias("magnitude"))


@query(f"WITH {_INDEXED}{_WEIGHTED} {_WEIGHTS}")
def stored_vectors(spark, sf_dir):
    return _weights(_built(spark, sf_dir).vectors_of())


@query(f"WITH {_FINAL}{_WEIGHTED} {_WEIGHTS}")
def incremental_weights(spark, sf_dir):
    return _weights(_updated(spark, sf_dir).vectors_of())


@query(f"WITH {_FINAL}{_WEIGHTED} SELECT u.path, CAST(len(tokens) AS BIGINT) AS token_count, round(coalesce(magnitude, 0), 6) AS magnitude FROM u LEFT JOIN m ON m.path = u.path")
def incremental_magnitudes(spark, sf_dir):
    return _updated(spark, sf_dir).magnitudes().select("path", "token_count", r6("magnitude").alias("magnitude"))


#: Queries with rare and with common terms, for which searches leave out blocks of postings.
_ASKED = {"q1": "the thing and that tion", "q2": "the of and to", "q3": "md d000000007 the", "q4": "thing thing unquestionable", "q5": "tion heat whan of the"}
_ASKED_TERMS = " UNION ALL ".join(f"SELECT '{k}' AS query_id, CAST(i - 1 AS INTEGER) AS pos, ts[i] AS term FROM (SELECT {PLAIN.format(chr(39) + v + chr(39))} AS ts), unnest(range(1, len(ts) + 1)) AS t(i)" for k, v in _ASKED.items())


@query(_ranked_sql(PLAIN, PROBABILISTIC, _ASKED_TERMS, "1.0e0", units_sql=_FINAL, key="path") + "SELECT query_id, path, round(score, 6) AS score, rank FROM r WHERE rank <= 7")
def threshold_search(spark, sf_dir):
    engine = _updated(spark, sf_dir)
    rows = [(k, r["path"], round(r["score"], 6), r["rank"]) for k, text in _ASKED.items() for r in engine.ranked(text, limit=7)]
    return spark.createDataFrame(rows, "query_id string, path string, score double, rank long")


@query(f"WITH {_INDEXED}{_WEIGHTED}, h AS (SELECT path, count(*) AS matches, string_agg(term || ' ' || raw_freq || ' ' || printf('%.5f', round(tfidf, 5)), ', ' ORDER BY list_position(['that', 'thing', 'tion'], term)) AS weights FROM v WHERE term IN ('that', 'thing', 'tion') GROUP BY path ORDER BY matches DESC, path LIMIT 40) SELECT h.path, matches, weights, round(magnitude, 6) AS magnitude, CAST(len(tokens) AS BIGINT) AS token_count FROM h JOIN m USING (path) JOIN u USING (path)")
def search_by_terms_weights(spark, sf_dir):
    rows = _built(spark, sf_dir).by_terms(["that", "thing", "tion"], 40)
    weights = F.array_join(F.transform("weights", lambda x: F.concat_ws(" ", x.term, x.raw_freq.cast("string"), F.format_string("%.5f", F.round(x.tfidf, 5)))), ", ")
    return rows.select("path", "matches", weights.alias("weights"), r6("magnitude").alias("magnitude"), "token_count")


@query(
    f"WITH {_INDEXED}{_WEIGHTED}, h AS (SELECT path, count(*) AS matches FROM v WHERE term IN ('that', 'thing', 'tion') GROUP BY path ORDER BY matches DESC, path LIMIT 40), "
    f"k AS (SELECT path, term, raw_freq, token_count FROM v JOIN h USING (path) WHERE term IN ('that', 'thing', 'tion')), a AS (SELECT greatest(avg(dl), 1e0) AS mean FROM (SELECT path, any_value(CAST(token_count AS DOUBLE)) AS dl FROM k GROUP BY path)), "
    f"i AS (SELECT term, {SMOOTHED} AS idf FROM d, c WHERE term IN ('that', 'thing')), "
    "s AS (SELECT path, sum(coalesce(idf, 0e0) * raw_freq * 2.2e0 / (raw_freq + 1.2e0 * (0.25e0 + 0.75e0 * token_count / mean)) ORDER BY list_position(['that', 'thing', 'tion'], k.term)) AS score, "
    "string_agg(k.term, ' ' ORDER BY list_position(['that', 'thing', 'tion'], k.term)) AS terms FROM k LEFT JOIN i ON i.term = k.term, a GROUP BY path) "
    "SELECT path, round(score, 6) AS score, terms, row_number() OVER (ORDER BY round(score, 9) DESC, path) AS rank FROM s WHERE score >= 0.5e0 QUALIFY rank <= 8"
)
def rank_candidates(spark, sf_dir):
    """A term without a stored frequency counts 0, and the candidates' mean length stands in for the corpus's."""
    engine = _built(spark, sf_dir)
    n = F.lit(engine.store.get_metadata("n_chunks"))
    idf = engine.store.terms(["that", "thing"]).select("term", idf_smoothed(n, F.col("df")).alias("idf"))
    best = ranking.rank_candidates(engine.by_terms(["that", "thing", "tion"], 40), ["path"], ["that", "thing", "tion"], idf, limit=8, min_score=0.5)
    return best.select("path", r6("score").alias("score"), F.array_join("matched_terms", " ").alias("terms"), F.col("rank").cast("long").alias("rank"))


@query(f"WITH {_INDEXED} SELECT u.path, 'Markdown' AS language, CAST(len(ls) AS INTEGER) AS lines, CAST(len(tokens) AS INTEGER) AS n_tokens FROM u JOIN (SELECT 'd' || lpad(CAST(doc_id AS VARCHAR), 9, '0') || '.md' AS path, CASE WHEN ls[-1] = '' AND len(ls) > 1 THEN ls[:-2] ELSE ls END AS ls FROM (SELECT doc_id, regexp_split_to_array(text, '\\r?\\n') AS ls FROM documents)) USING (path) WHERE len(tokens) >= 40")
def chunk_metadata(spark, sf_dir):
    field = lambda name, kind: F.variant_get("metadata", f"$.{name}", kind)
    rows = _built(spark, sf_dir).store.read("chunks", field("tokens", "int") >= 40)
    return rows.select("path", field("language", "string").alias("language"), field("lines", "int").alias("lines"), field("tokens", "int").alias("n_tokens"))


_MOCK = (
    f"m AS MATERIALIZED (SELECT path, {_HASH} AS h FROM (SELECT 'd' || lpad(CAST(doc_id AS VARCHAR), 9, '0') || '.md' AS path, text FROM documents UNION ALL SELECT '?', '{QUERY}')), "
    "y AS MATERIALIZED (SELECT path, list_transform(range(0, 16), lambda i: (sin(CAST(h AS DOUBLE) + i) + cos((CAST(h AS DOUBLE) + i) / 2.0e0)) / 2.0e0) AS y FROM m), "
    "e AS MATERIALIZED (SELECT path, CAST(CAST(list_transform(y, lambda v: v / sqrt(list_sum(list_transform(y, lambda z: z * z)))) AS FLOAT[]) AS DOUBLE[]) AS e FROM y), "
    f"n AS (SELECT path, 1.0e0 / (1.0e0 + distance) AS score FROM (SELECT a.path, {_L2.format('a.e', 'q.e')} AS distance FROM e a, e q WHERE q.path = '?' AND a.path <> '?') ORDER BY round(distance, 9), path LIMIT 20)"
)


@query(
    _ranked_sql(PLAIN, PROBABILISTIC, _terms_sql(PLAIN, False), "1.0e0", units_sql=_INDEXED, key="path")
    + f", {_MOCK}, x AS (SELECT path, score FROM r WHERE rank <= 20) SELECT path, round(s, 6) AS score, method, round(similarity, 6) AS similarity, language, n_terms FROM (SELECT path, coalesce(n.score / nm, 0e0) * 0.7e0 + coalesce(x.score / xm, 0e0) * 0.3e0 AS s, "
    "CASE WHEN n.score IS NULL THEN 'lexical' WHEN x.score IS NULL THEN 'vector' ELSE 'hybrid' END AS method, n.score AS similarity, 'Markdown' AS language, coalesce(len(terms), 0) AS n_terms "
    "FROM n FULL JOIN (SELECT x.path, x.score, terms FROM x JOIN r ON r.path = x.path) x USING (path), (SELECT greatest(max(score), 0.01e0) AS nm FROM n), (SELECT greatest(max(score), 0.01e0) AS xm FROM x)) WHERE s >= 0.01e0 ORDER BY round(s, 9) DESC, path LIMIT 10"
)
def hybrid_search(spark, sf_dir):
    engine = _once(spark, sf_dir, "embedded", lambda: built_index(spark, document_files(spark, sf_dir), EmbeddingConfig(dimensions=16)))
    rows = [(r["path"], round(r["score"], 6), r["method"], r["similarity"] and round(r["similarity"], 6), r["language"], len(r["matched_terms"])) for r in engine.hybrid(QUERY)]
    return spark.createDataFrame(rows, "path string, score double, method string, similarity double, language string, n_terms long")


def _flaky(texts: list[str], config: EmbeddingConfig) -> list[list[float]]:
    """A provider that fails for a whole batch if a text starts with a capital letter A to C: a stated rule."""
    if any(t[:1] in ("A", "B", "C") for t in texts):
        raise ConnectionError("no vector")
    return [[float(len(t)), float(t.count(" "))] for t in texts]


@query("SELECT doc_id, substring(coalesce(text, ''), 1, 1) IN ('A', 'B', 'C') AS failed, CASE WHEN failed THEN NULL ELSE length(text) END AS x, CASE WHEN failed THEN NULL ELSE length(text) - length(replace(text, ' ', '')) END AS y, CASE WHEN failed THEN 'ConnectionError: no vector' END AS error FROM documents")
def embedding_failures(spark, sf_dir):
    register_provider("flaky", _flaky)
    rows = embed_rows(spread(table(spark, sf_dir, "documents").select("doc_id", "text")), EmbeddingConfig("flaky", 2))
    return rows.select("doc_id", F.col("vector").isNull().alias("failed"), F.col("vector")[0].cast("long").alias("x"), F.col("vector")[1].cast("long").alias("y"), "error")


@query("SELECT 'd' || lpad(CAST(doc_id AS VARCHAR), 9, '0') || '.md' AS path, sha256(CASE WHEN doc_id % 3 = 0 THEN text || ' again' ELSE text END) AS hash, CASE WHEN doc_id % 3 = 0 THEN 1 ELSE 2 END AS n_chunks FROM documents WHERE doc_id % 4 <> 1")
def store_upserts(spark, sf_dir):
    """Files and chunks put, put again and deleted in a store; what is replaced is never rewritten."""
    store, files = Store(spark, temporary_folder(spark, "upserts")), document_files(spark, sf_dir)
    chunks = lambda rows, n: rows.select("path", F.explode(F.sequence(F.lit(1), F.lit(n))).alias("start_line")).withColumn("end_line", F.col("start_line"))
    store.upsert("files", files.where("doc_id % 5 <> 0"))
    store.upsert("files", files.where("doc_id % 5 = 0"))
    store.store_chunks(chunks(files, 2))
    again = files.where("doc_id % 3 = 0").withColumn("hash", F.sha2(F.concat("content", F.lit(" again")), 256))
    store.upsert("files", again)
    store.store_chunks(chunks(again, 1))
    store.delete_files(files.where("doc_id % 4 = 1").select("path"))
    counted = store.read("chunks").groupBy("path").agg(F.count(F.lit(1)).cast("int").alias("n_chunks"))
    return store.file_metadata().select("path", "hash").join(counted, "path")


@query(f"WITH v AS (SELECT vec_id, list_transform(CAST(embedding AS DOUBLE[]), lambda x: CASE WHEN vec_id % 6 = 2 THEN 0 - x ELSE x END) AS e FROM embeddings WHERE vec_id % 5 <> 3 AND vec_id <> 4) SELECT 'v' || vec_id AS id, round(1.0e0 / (1.0e0 + {_L2.format('e', 'q')}), 6) AS score FROM v, {_V0} ORDER BY {_L2.format('e', 'q')}, 'v' || vec_id LIMIT 15")
def vector_store(spark, sf_dir):
    """Vectors added, updated, and deleted by id and by path."""
    rows = table(spark, sf_dir, "embeddings").select("vec_id", F.concat(F.lit("v"), F.col("vec_id").cast("string")).alias("id"), F.col("embedding").cast("array<float>").alias("vector"), F.concat(F.lit("p"), (F.col("vec_id") % 5).cast("string")).alias("path"))
    made = VectorStore(Store(spark, temporary_folder(spark, "vectors")), 64)
    made.add(rows.where("vec_id % 2 = 0").drop("vec_id"))
    made.add(rows.where("vec_id % 2 = 1").drop("vec_id"))
    made.update(rows.where("vec_id % 6 = 2").withColumn("vector", F.transform("vector", lambda x: -x)).drop("vec_id"))
    made.delete_path("p3")
    made.delete("v4")
    return vector_search.nearest(made.rows(), _vector(spark, sf_dir, 0), 15).select("id", r6("score").alias("score"))


_TREE = "'s' || (doc_id % 7) || '/t' || (doc_id % 3) || '/d' || doc_id || '.md'"


def _tree_files(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.expr("concat('s', doc_id % 7, '/t', doc_id % 3, '/d', doc_id, '.md')").alias("path"), F.col("text").alias("content"))


def _tree_folder(spark) -> str:
    folder = temporary_folder(spark, "tree")
    if "://" in folder and not folder.startswith("file://"):
        raise ValueError("trees are written to and listed in folders of a file system that all executors mount")
    return folder.removeprefix("file://")


@query(f"SELECT {_TREE} AS path, CAST(octet_length(encode(text)) AS BIGINT) AS size FROM documents WHERE octet_length(encode(text)) BETWEEN 200 AND 20000 AND doc_id % 7 <> 0")
def file_inventory(spark, sf_dir):
    root = _tree_folder(spark)
    written_tree(_tree_files(spark, sf_dir).where("content IS NOT NULL"), root)
    files = tree_metadata(spark, root).where((F.col("size") >= 200) & (F.col("size") <= 20000))
    return files.where(~F.col("path").startswith("s0/")).select("path", "size")


@query(f"SELECT {_TREE} AS path, CASE WHEN doc_id % 10 = 3 THEN 'add' WHEN doc_id % 10 = 4 THEN 'unlink' ELSE 'change' END AS type, CASE WHEN doc_id % 10 IN (3, 4, 5) THEN 2 ELSE 1 END AS version FROM documents WHERE doc_id % 10 IN (3, 4, 5) UNION ALL SELECT {_TREE}, 'add', 1 FROM documents WHERE doc_id % 10 <> 3")
def change_feed(spark, sf_dir):
    root, files = _tree_folder(spark), _tree_files(spark, sf_dir)
    feed = ChangeFeed(spark, root, temporary_folder(spark, "feed"))
    written_tree(files.where("doc_id % 10 <> 3"), root)
    feed.poll()
    later = F.when(F.expr("doc_id % 10 <> 4"), F.concat("content", F.lit(" and more")))
    written_tree(files.where("doc_id % 10 IN (3, 4, 5)").withColumn("content", later), root)
    feed.poll()
    out = temporary_folder(spark, "changes")
    feed.stream(max_files=2).writeStream.format("parquet").option("path", f"{out}/rows").option("checkpointLocation", f"{out}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema("type string, path string, version long").parquet(f"{out}/rows").select("path", "type", F.col("version").cast("int").alias("version"))


@query("SELECT doc_id AS path, CASE WHEN o.s IS NULL THEN 'added' WHEN n.s IS NULL THEN 'deleted' WHEN o.s <> n.s OR abs(o.m - n.m) > 1000 THEN 'changed' ELSE 'unchanged' END AS change_type FROM (SELECT doc_id, n_chars AS s, doc_id * 1000 AS m FROM documents WHERE doc_id % 10 <> 3) o FULL JOIN (SELECT doc_id, n_chars + CAST(doc_id % 4 = 1 AS INTEGER) AS s, doc_id * 1000 + (doc_id % 3) * 600 AS m FROM documents WHERE doc_id % 7 <> 2) n USING (doc_id)")
def stale_files(spark, sf_dir):
    at = lambda ms: F.timestamp_millis(F.expr(ms)).alias("mtime")
    docs = table(spark, sf_dir, "documents")
    known = docs.where("doc_id % 10 <> 3").select(F.col("doc_id").alias("path"), F.col("n_chars").alias("size"), at("doc_id * 1000"))
    found = docs.where("doc_id % 7 <> 2").select(F.col("doc_id").alias("path"), F.expr("n_chars + CAST(doc_id % 4 = 1 AS INT)").alias("size"), at("doc_id * 1000 + (doc_id % 3) * 600"))
    return changes.stale_files(known, found)


def _plain_time(name: str) -> Column:
    return F.expr(f"convert_timezone(current_timezone(), 'UTC', CAST({name} AS TIMESTAMP_NTZ))").alias(name)


def _streamed(spark, sf_dir, name: str, plan: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """All events read as a stream and what the stream has closed when they end."""
    rows = table(spark, sf_dir, "events")
    source = spark.readStream.schema(rows.schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)
    if rows.schema["ts"].dataType.typeName() == "timestamp_ntz":  # watermarks need instants: times without a zone are read as UTC
        source = source.withColumn("ts", F.expr("CAST(convert_timezone('UTC', current_timezone(), ts) AS TIMESTAMP)"))
    folder = temporary_folder(spark, name)
    out = plan(source)
    out.writeStream.format("parquet").option("path", f"{folder}/rows").option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(out.schema).parquet(f"{folder}/rows")


@query("WITH g AS (SELECT *, CASE WHEN ts - lag(ts) OVER w >= INTERVAL 1 HOUR THEN 1 ELSE 0 END AS apart FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)), k AS (SELECT *, sum(apart) OVER (PARTITION BY user_id ORDER BY ts) AS burst FROM g) SELECT user_id, min(ts) AS first_at, max(ts) AS last_at, CAST(count(*) AS BIGINT) AS n FROM k GROUP BY user_id, burst HAVING max(ts) + INTERVAL 1 HOUR <= (SELECT date_trunc('millisecond', max(ts)) - INTERVAL 2 HOUR FROM events)")
def stream_debounce(spark, sf_dir):
    rows = _streamed(spark, sf_dir, "debounce", lambda df: index_stream.debounced_stream(df, "user_id", "ts", "1 hour", "event_type", "2 hours"))
    return rows.select("user_id", _plain_time("first_at"), _plain_time("last_at"), "n")


@query(
    "WITH e AS (SELECT user_id, epoch_us(ts) // 1000 AS ms, event_type FROM events), g AS (SELECT *, CASE WHEN ms - lag(ms) OVER w >= 3600000 THEN 1 ELSE 0 END AS apart FROM e WINDOW w AS (PARTITION BY user_id ORDER BY ms, event_type)), "
    "k AS (SELECT *, sum(apart) OVER (PARTITION BY user_id ORDER BY ms, event_type ROWS UNBOUNDED PRECEDING) AS burst FROM g), "
    "b AS (SELECT user_id, burst, min(ms) AS first_ms, max(ms) AS last_ms, last(event_type ORDER BY ms, event_type) AS event_type, CAST(count(*) AS BIGINT) AS n FROM k GROUP BY user_id, burst) "
    "SELECT user_id, first_ms, last_ms, event_type, n FROM (SELECT *, max(burst) OVER (PARTITION BY user_id) AS newest FROM b) WHERE burst < newest OR last_ms + 3600000 < (SELECT max(ms) - 7200000 FROM e)"
)
def timer_debounce(spark, sf_dir):
    rows = _streamed(spark, sf_dir, "timers", lambda df: debounced_by_timers(df, "user_id", "ts", "event_type", gap_ms=3_600_000, clock="event", delay="2 hours"))
    return rows.select("user_id", F.unix_millis("first_at").alias("first_ms"), F.unix_millis("last_at").alias("last_ms"), "event_type", "n")


@query("SELECT * FROM (SELECT time_bucket(INTERVAL 1 DAY, ts) AS day, event_type, CAST(count(*) AS BIGINT) AS n FROM events GROUP BY ALL) WHERE day + INTERVAL 1 DAY <= (SELECT date_trunc('millisecond', max(ts)) - INTERVAL 10 MINUTE FROM events)")
def stream_windows(spark, sf_dir):
    rows = _streamed(spark, sf_dir, "windows", lambda df: index_stream.windowed_counts(df, size="1 day"))
    return rows.select(_plain_time("window.start").alias("day"), "event_type", "n")


@query("SELECT event_type, quantile_disc(value, 0.5) AS p50 FROM events GROUP BY event_type")
def percentile(spark, sf_dir):
    return table(spark, sf_dir, "events").groupBy("event_type").agg(F.expr("percentile_disc(0.5) WITHIN GROUP (ORDER BY value)").alias("p50"))
