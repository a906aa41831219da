"""The queries of this subpackage: each applies one operator to its whole table and derives its digest columns."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenseek.llm.balanced_packing import pack_balanced
from lumenseek.llm.embedding_dedup import embedding_classes
from lumenseek.llm.fill_in_middle import fill_in_middle, restored
from lumenseek.llm.html_text import extract_text
from lumenseek.llm.jaccard_join import jaccard_classes
from lumenseek.llm.mixing import mix_sources
from lumenseek.llm.packing import pack_documents
from lumenseek.llm import quality_classifier
from lumenseek.llm.pii import pseudonymise
from lumenseek.llm.quality_rules import judge_documents, with_text_stats
from lumenseek.llm.scratch import stored
from lumenseek.llm.source_audit import divergence_audit
from lumenseek.llm.substring_dedup import remove_repeated_windows
from lumenseek.llm.suffix_dedup import remove_repeated_strings


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = remove_repeated_windows(_table(spark, sf_dir, "documents"), window=13)
    return kept.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


OP1_SQL = r"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
win AS (SELECT doc_id, i, array_to_string(ws[i:i + 12], ' ') AS g FROM w, unnest(range(1, len(ws) - 11)) AS t(i)),
least AS (SELECT g, min(doc_id) AS owner FROM win GROUP BY g),
gone AS (SELECT DISTINCT win.doc_id, i + k AS p FROM win JOIN least USING (g), range(0, 13) AS r(k) WHERE win.doc_id > owner),
word AS (SELECT w.doc_id, p, ws[p] AS word, gone.p IS NULL AS stays
         FROM w CROSS JOIN unnest(range(1, len(ws) + 1)) AS t(p) LEFT JOIN gone USING (doc_id, p)),
done AS (SELECT doc_id, count(*) FILTER (NOT stays) AS n_removed,
                string_agg(word, ' ' ORDER BY p) FILTER (stays) AS kept FROM word GROUP BY doc_id)
SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed,
       sha256(coalesce(kept, '')) AS kept_sha256
FROM w LEFT JOIN done USING (doc_id)
"""

def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = remove_repeated_strings(_table(spark, sf_dir, "documents"), length=100)
    return kept.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    stats = with_text_stats(docs)
    stats = stored(stats.withColumn("row", F.struct("row.doc_id", "row.lang")), "text-stats")
    judged = judge_documents(docs, _table(spark, sf_dir, "labels"), stats=stats)
    return judged.select("row.doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op8_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(_table(spark, sf_dir, "documents"), str(tokenizer_path()), capacity=4096, end_id=1, carry={"ids_crc32": F.crc32("ids")})


def op4_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    mixed = mix_sources(docs, entropy_share=0.95)
    return mixed.select("row.doc_id", "row.source", "n_tokens", "epoch", "block", "block_order", "place")


def _held_out():
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 3 == 1, F.lit(False))


def op5_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    weights = quality_classifier.fit(docs, _table(spark, sf_dir, "labels"), learn=~_held_out())
    scored = quality_classifier.score(docs, weights)
    return scored.select("doc_id", _held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op7_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_classes(_table(spark, sf_dir, "embeddings"), cosine=0.98)


def op10_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_text(_table(spark, sf_dir, "pages")).withColumn("n_chars", F.length("text").cast("long"))


def op6_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_classes(_table(spark, sf_dir, "documents"), shingle=4, percent=85)


#: Key of the pseudonyms in queries and the pipeline; a real run passes its own.
PII_KEY = "lumenseek0"


def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return pseudonymise(docs, PII_KEY, found_col="kinds").withColumn("n_found", F.size("kinds").cast("long"))


def op11_balanced_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    packed = pack_balanced(_table(spark, sf_dir, "documents"), str(tokenizer_path("byte_bpe_50k.json")), capacity=2048, end_id=1)
    return packed.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op12_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = fill_in_middle(_table(spark, sf_dir, "documents"), seed="1", percent=90, spm_percent=20)
    digest = lambda c: F.sha2(c.cast("binary"), 256)
    return made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", digest(F.col("output")).alias("output_sha256"), digest(restored()).alias("restored_sha256"))


def op13_source_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence_audit(_table(spark, sf_dir, "documents"), min_docs=30, top=50)


OP12_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]') AS us,
                  sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
h AS (SELECT *, len(us) AS n, CAST('0x' || h[1:8] AS BIGINT) AS h1, CAST('0x' || h[9:16] AS BIGINT) AS h2,
             CAST('0x' || h[17:24] AS BIGINT) AS h3, CAST('0x' || h[25:32] AS BIGINT) AS h4 FROM d),
c AS (SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
             CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= 90 THEN 'plain'
                  WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM h),
p AS (SELECT *, array_to_string(us[1:a], '') AS prefix, array_to_string(us[a + 1:b], '') AS middle, array_to_string(us[b + 1:n], '') AS suffix FROM c)
SELECT doc_id, CAST(n AS BIGINT) AS n, form, CASE WHEN form <> 'plain' THEN CAST(length(prefix) AS BIGINT) END AS prefix_chars,
       CASE WHEN form <> 'plain' THEN CAST(length(middle) AS BIGINT) END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle
              ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
       sha256(text) AS restored_sha256
FROM p
"""

OP13_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source, coalesce(text, '') AS text FROM documents),
t AS (SELECT r, lang, source, translate(unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')),
             'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS term FROM d),
v AS (SELECT lang, term FROM t GROUP BY ALL HAVING count(DISTINCT r) >= 30),
k AS (SELECT lang, source, term, count(*) AS n FROM t JOIN v USING (lang, term) GROUP BY ALL),
s AS (SELECT DISTINCT lang, source FROM d),
nv AS (SELECT lang, count(*) AS v FROM v GROUP BY lang),
dense AS (SELECT s.lang, s.source, v.term, coalesce(n, 0) AS n, sum(coalesce(n, 0)) OVER (PARTITION BY s.lang, s.source) AS total, nv.v
          FROM s JOIN v ON s.lang = v.lang JOIN nv ON nv.lang = s.lang LEFT JOIN k ON k.lang = s.lang AND k.source = s.source AND k.term = v.term),
p AS (SELECT lang, source, term, n, 1 + (1000000000 * CAST(n + 5 AS HUGEINT)) // CAST(total + 5 * v AS HUGEINT) AS p FROM dense),
l AS (SELECT lang, term, sum(n) AS n, sum(sum(n)) OVER (PARTITION BY lang) AS total, any_value(v) AS v FROM dense GROUP BY lang, term),
q AS (SELECT lang, term, 1 + (1000000000 * CAST(n + 5 AS HUGEINT)) // CAST(total + 5 * v AS HUGEINT) AS q FROM l),
apart AS (SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
parts AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(value, 0) AS value
          FROM s a JOIN s b ON a.lang = b.lang AND a.source <> b.source
          LEFT JOIN apart ON apart.lang = a.lang AND apart.source = a.source AND apart.item = b.source
          UNION ALL SELECT lang, source, 'term', term, p - q FROM p JOIN q USING (lang, term) WHERE n > 0 AND p > q),
r AS (SELECT lang, source, part, item, CAST(value AS BIGINT) AS value,
             CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank FROM parts)
SELECT * FROM r WHERE part = 'pair' OR rank <= 50
"""

OP2_SQL = """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h, octet_length(encode(coalesce(text, ''))) AS n FROM documents),
s AS (SELECT doc_id, i AS p, md5(substring(h, 2 * i + 1, 200)) AS g FROM d, unnest(range(0, n - 99)) AS t(i)),
f AS (SELECT doc_id, p, row_number() OVER (PARTITION BY g ORDER BY doc_id, p) > 1 AS again FROM s),
a AS (SELECT doc_id, p, CASE WHEN p > lag(p) OVER (PARTITION BY doc_id ORDER BY p) + 100 THEN 1 ELSE 0 END AS apart FROM f WHERE again),
i AS (SELECT *, sum(apart) OVER (PARTITION BY doc_id ORDER BY p) AS island FROM a),
r AS (SELECT doc_id, min(p) AS a, max(p) + 100 AS b FROM i GROUP BY doc_id, island),
k AS (SELECT doc_id, b AS x, coalesce(lead(a) OVER (PARTITION BY doc_id ORDER BY a), n) AS y FROM r JOIN d USING (doc_id)
      UNION ALL SELECT doc_id, 0, coalesce(min(a), any_value(n)) FROM d LEFT JOIN r USING (doc_id) GROUP BY doc_id),
kept AS (SELECT doc_id, string_agg(substring(h, 2 * x + 1, 2 * (y - x)), '' ORDER BY x) AS h FROM k JOIN d USING (doc_id) GROUP BY doc_id),
c AS (SELECT doc_id, sum(b - a) AS n_removed, count(*) AS n_spans FROM r GROUP BY doc_id)
SELECT d.doc_id, CAST(n AS BIGINT) AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed,
       CAST(coalesce(n_spans, 0) AS BIGINT) AS n_spans, sha256(unhex(kept.h)) AS kept_sha256
FROM d LEFT JOIN c USING (doc_id) JOIN kept USING (doc_id)
"""


def _op3_sql() -> str:
    """Counts by explosion, cutoffs by the binomial tail from log-factorials."""
    from lumenseek.llm.quality_rules import ALPHA, DELTA, GRID

    shares = {
        "symbol_share": ("n_symbols", "word_chars"),
        "dup_line_share": ("n_dup_lines", "n_lines"),
        "repeat_share": ("n_repeat_words", "n_words"),
        "capital_share": ("n_capitals", "word_chars"),
        "bang_share": ("n_bangs", "word_chars"),
    }
    long = " UNION ALL ".join(f"SELECT doc_id, lang, '{r}' AS rule, CASE WHEN {b} > 0 THEN CAST({a} AS DOUBLE) / {b} ELSE 0e0 END AS share FROM m" for r, (a, b) in shares.items())
    grid = ", ".join(f"('{r}', {i}, {c!r}e0)" for r, g in GRID.items() for i, c in enumerate(g))
    return rf"""
WITH w AS (SELECT doc_id, lang, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
g AS (SELECT doc_id, i, md5(ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2]) AS g FROM w, unnest(range(1, len(ws) - 1)) AS t(i)),
again AS (SELECT doc_id, i FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, g) AS c FROM g) WHERE c > 1),
rep AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM again, range(0, 3) AS r(k) GROUP BY doc_id),
l AS (SELECT doc_id, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM w),
m AS (SELECT w.doc_id, lang, len(ws) AS n_words, length(array_to_string(ws, '')) AS word_chars,
      len(regexp_extract_all(text, '[#*$%&|<>]')) AS n_symbols, len(ls) AS n_lines, len(ls) - len(list_distinct(ls)) AS n_dup_lines,
      coalesce(rep.n, 0) AS n_repeat_words, len(regexp_extract_all(text, '\p{{Lu}}')) AS n_capitals, len(regexp_extract_all(text, '!')) AS n_bangs
      FROM w JOIN l USING (doc_id) LEFT JOIN rep USING (doc_id)),
b AS (SELECT doc_id, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM m),
shares AS ({long}),
good AS (SELECT doc_id FROM labels WHERE quality IS NOT NULL GROUP BY doc_id HAVING min(quality) = 1),
one AS (SELECT min(doc_id) AS doc_id FROM m JOIN b USING (doc_id) JOIN good USING (doc_id) WHERE NOT base_failed
        GROUP BY lang, n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words, n_capitals, n_bangs),
hold AS (SELECT s.* FROM shares s JOIN one USING (doc_id)),
grid(rule, step, cutoff) AS (VALUES {grid}),
k AS (SELECT lang, rule, step, cutoff, count(*) AS n, count(*) FILTER (share > cutoff) AS k FROM hold JOIN grid USING (rule) GROUP BY ALL),
strata AS (SELECT greatest(1, count(DISTINCT coalesce(lang, chr(0)))) AS strata FROM hold),
t AS (SELECT *, CASE WHEN k >= {ALPHA!r}e0 * n THEN 1e0 ELSE list_sum(list_transform(range(0, k + 1),
      lambda j: exp(lgamma(n + 1) - lgamma(j + 1) - lgamma(n - j + 1) + j * ln({ALPHA!r}e0) + (n - j) * ln({1 - ALPHA!r}e0)))) END AS p FROM k),
bad AS (SELECT lang, rule, min(step) FILTER (p > {DELTA!r}e0 / ({len(GRID)} * strata)) AS bad FROM t, strata GROUP BY lang, rule),
cut AS (SELECT t.lang, t.rule, min(cutoff) AS cutoff FROM t JOIN bad ON t.lang IS NOT DISTINCT FROM bad.lang AND t.rule = bad.rule
        WHERE bad IS NULL OR step < bad GROUP BY t.lang, t.rule),
fired AS (SELECT DISTINCT doc_id FROM shares s JOIN cut ON s.lang IS NOT DISTINCT FROM cut.lang AND s.rule = cut.rule WHERE share > cutoff)
SELECT m.doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars, CAST(n_symbols AS BIGINT) AS n_symbols,
       CAST(n_dup_lines AS BIGINT) AS n_dup_lines, CAST(n_repeat_words AS BIGINT) AS n_repeat_words, base_failed,
       NOT base_failed AND fired.doc_id IS NULL AS kept
FROM m JOIN b USING (doc_id) LEFT JOIN fired USING (doc_id)
"""


OP4_SQL = r"""
WITH RECURSIVE r AS (SELECT doc_id, source, coalesce('=' || source, 'null') AS s, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS n_tokens,
       md5('0|' || doc_id) AS place, substring(md5('0|' || doc_id), 1, 3) AS block FROM documents),
b AS (SELECT s, block, sum(n_tokens) AS tokens FROM r GROUP BY ALL),
src AS (SELECT s, sum(tokens) AS tokens FROM b GROUP BY s HAVING sum(tokens) > 0),
ps AS (SELECT list(tokens / CAST(total AS DOUBLE)) AS ps, any_value(total) AS total FROM src, (SELECT sum(tokens) AS total FROM src)),
half AS (SELECT 0 AS k, 0e0 AS lo, 1e0 AS hi
         UNION ALL SELECT k + 1, CASE WHEN ok THEN mid ELSE lo END, CASE WHEN ok THEN hi ELSE mid END FROM (
           SELECT k, lo, hi, mid, ln(z) - mid * zl / z >= 0.95e0 * ln(CAST(n AS DOUBLE)) - 1e-12 AS ok FROM (
             SELECT k, lo, hi, (lo + hi) / 2 AS mid, len(ps) AS n, list_sum(list_transform(ps, lambda p: pow(p, (lo + hi) / 2))) AS z,
                    list_sum(list_transform(ps, lambda p: pow(p, (lo + hi) / 2) * ln(p))) AS zl FROM half, ps WHERE k < 45))),
x AS (SELECT least(1e0, round(max(lo), 6)) AS x FROM half),
raw AS (SELECT s, tokens, pow(tokens / CAST(total AS DOUBLE), x) AS raw, CAST(total AS DOUBLE) AS total FROM src, ps, x),
reads AS (SELECT s, tokens, raw / (SELECT sum(raw) FROM raw) * total / tokens AS reads FROM raw),
plan AS (SELECT s, tokens, CAST(floor(reads + 1e-9) AS INTEGER) AS epochs, CAST(greatest(floor((reads - floor(reads + 1e-9)) * tokens), 0) AS BIGINT) AS rest FROM reads),
o AS (SELECT s, block, b.tokens, epochs, rest, md5('0|' || epochs || '|' || s || '|' || block) AS o FROM b JOIN plan USING (s)),
u AS (SELECT *, sum(tokens) OVER (PARTITION BY s ORDER BY o, block) AS upto FROM o),
cut AS (SELECT s, block, o, rest - upto + tokens AS room FROM u WHERE upto > rest QUALIFY row_number() OVER (PARTITION BY s ORDER BY o, block) = 1),
inner_ AS (SELECT s, place, room, sum(sum(n_tokens)) OVER (PARTITION BY s ORDER BY place) AS upto FROM r JOIN cut USING (s, block) GROUP BY s, place, room),
last AS (SELECT s, max(place) FILTER (upto <= room) AS last_place FROM inner_ GROUP BY s),
n AS (SELECT r.*, plan.epochs AS full_, coalesce(plan.epochs, 1) + CASE WHEN plan.epochs IS NULL THEN 0
        WHEN md5('0|' || plan.epochs || '|' || r.s || '|' || r.block) < cut.o THEN 1
        WHEN md5('0|' || plan.epochs || '|' || r.s || '|' || r.block) = cut.o AND r.place <= last_place THEN 1 ELSE 0 END AS n
      FROM r LEFT JOIN plan USING (s) LEFT JOIN cut ON cut.s = r.s LEFT JOIN last ON last.s = r.s)
SELECT doc_id, source, n_tokens, CAST(e AS INTEGER) AS epoch, block, md5('0|' || e || '|' || s || '|' || block) AS block_order, place
FROM n, unnest(range(0, n)) AS t(e)
"""

OP6_SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, list_transform(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'),
        lambda x: translate(x, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, md5(array_to_string(ws[i:i + 3], ' ')) AS g
      FROM w, unnest(range(1, greatest(len(ws) - 2, CASE WHEN len(ws) > 0 THEN 2 ELSE 1 END))) AS t(i)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
met AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
links AS (SELECT a, b FROM met JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * c >= 85 * (na.n + nb.n - c)),
sym AS (SELECT a, b FROM links UNION SELECT b, a FROM links),
reach AS (SELECT a AS node, a AS least FROM sym UNION SELECT l.b, r.least FROM reach r JOIN sym l ON l.a = r.node AND r.least < l.b),
least AS (SELECT node, min(least) AS least FROM reach GROUP BY node)
SELECT w.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, coalesce(least, w.doc_id) AS component_id
FROM w LEFT JOIN n USING (doc_id) LEFT JOIN least ON node = w.doc_id
"""

OP7_SQL = """
WITH RECURSIVE v AS (
    SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
    WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
      AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0
      AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
links AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
          WHERE list_cosine_similarity(a.e, b.e) >= 0.98),
reach AS (SELECT a AS node, a AS least FROM links UNION SELECT l.b, r.least FROM reach r JOIN links l ON l.a = r.node AND r.least < l.b),
least AS (SELECT node, min(least) AS least FROM reach GROUP BY node),
counted AS (SELECT a, count(*) AS n FROM links GROUP BY a)
SELECT vec_id, CAST(coalesce(n, 0) AS BIGINT) AS n_links, coalesce(least, vec_id) AS component_id, vec_id = coalesce(least, vec_id) AS kept
FROM embeddings LEFT JOIN least ON node = vec_id LEFT JOIN counted ON counted.a = vec_id
"""

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_substring_dedup": op1_substring_dedup,
    "op2_suffix_dedup": op2_suffix_dedup,
    "op3_quality_rules": op3_quality_rules,
    "op4_source_mixing": op4_source_mixing,
    "op5_quality_classifier": op5_quality_classifier,
    "op6_jaccard_join": op6_jaccard_join,
    "op7_embedding_dedup": op7_embedding_dedup,
    "op8_best_fit_packing": op8_best_fit_packing,
    "op9_pii": op9_pii,
    "op10_html_extraction": op10_html_extraction,
    "op11_balanced_packing": op11_balanced_packing,
    "op12_fill_in_middle": op12_fill_in_middle,
    "op13_source_audit": op13_source_audit,
}

ORACLES: dict[str, str] = {
    "op1_substring_dedup": OP1_SQL,
    "op2_suffix_dedup": OP2_SQL,
    "op3_quality_rules": _op3_sql(),
    "op4_source_mixing": OP4_SQL,
    "op6_jaccard_join": OP6_SQL,
    "op7_embedding_dedup": OP7_SQL,
    "op12_fill_in_middle": OP12_SQL,
    "op13_source_audit": OP13_SQL,
}
