"""Tokenizers, chunkers, ranking, snippets, vectors, store, engine, streams."""

import json
import math
import os
import random
import re

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lumenseek.functions import numeric, paths
from lumenseek.functions.embedding import EmbeddingConfig, embed, register_provider, registered_providers
from lumenseek.functions.tokenize import bpe_tokens, identifier_tokens, plain_tokens, query_terms
from lumenseek.operators import changes, chunking, hybrid, ranking, records, snippets, statistics, structure, vector_search
from lumenseek.plans import queries
from lumenseek.plans.engine import Cache, Engine, cache_key, envelope, handle
from lumenseek.sources.files import read_tree, scan
from lumenseek.sources.ignore import Ignore
from lumenseek.sources.store import MemoryStore, Store, VectorStore, data_dir
from lumenseek.streaming.change_feed import ChangeFeed
from lumenseek.streaming.index_stream import watch


def one(spark, column, value, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(column(F.col("x")).alias("y")).first().y


def test_tokenizers(spark):
    text = "getUserData authenticate_user login2 a HTTPServer 12ab KELVIN\u212a"
    assert one(spark, plain_tokens, text) == ["getuserdata", "authenticate_user", "login2", "httpserver", "12ab", "kelvin"]
    assert one(spark, identifier_tokens, text) == ["get", "user", "data", "authenticate", "user", "login2", "httpserver", "12", "ab", "kelvin"]
    assert one(spark, query_terms, "user User name") == ["user", "name"]
    assert one(spark, plain_tokens, None) == [] and one(spark, identifier_tokens, "") == []


def test_paths(spark):
    assert one(spark, paths.display_language, "a/B.Py") == "Python" and one(spark, paths.display_language, ".env") is None
    assert one(spark, paths.is_text_file, "x/Makefile") and not one(spark, paths.is_text_file, "a.png")
    assert one(spark, lambda c: paths.merge_key(c, F.lit(0), F.lit(0)), "p") == "p"
    assert one(spark, lambda c: paths.result_key(c, F.lit(None).cast("int"), F.lit(2)), "p") == "p:0:2"
    ignore = Ignore(["*.tmp", "!keep.tmp", "docs/*.txt", "/only", "logs/"])
    assert [ignore(p) for p in ("a/node_modules/x.js", "a.tmp", "keep.tmp", "docs/a.txt", "x/docs/a.txt", "only", "a/only", "src/a.ts", "logs/x", "logs", "")] == [True, True, False, True, False, True, False, False, True, False, True]


def test_hash_and_vectors(spark):
    def plain(text):
        h = 0
        for c in text:
            h = (h * 31 + ord(c)) & 0xFFFFFFFF
        return h - (1 << 32) if h >= 1 << 31 else h

    for text in ("", "a", "hello world", "été and more than a few words to wrap it"):
        assert one(spark, numeric.poly_hash32, text) == plain(text)
    v = one(spark, lambda c: numeric.mock_embedding(c, 16), "hello")
    assert abs(sum(x * x for x in v) - 1) < 1e-9
    assert one(spark, lambda c: numeric.cosine(c, c), [0.0, 0.0], "array<double>") == 0.0
    with pytest.raises(Exception, match="different dimensions"):
        one(spark, lambda c: numeric.cosine(c, F.array(F.lit(1.0))), [1.0, 2.0], "array<double>")


@pytest.mark.parametrize(("size", "overlap"), [(10, 3), (5, 5), (4, 9), (1000, 100)])
def test_windows(spark, size, overlap):
    step = size - overlap if overlap < size else size
    for n in (0, 1, size - 1, size, size + 1, 5 * size + 2):
        text, want, at = "abcdefghij" * 600, [], 0
        text = text[:n]
        while text:
            want.append(text[at : at + size])
            if at + size >= len(text):
                break
            at += step
        assert one(spark, lambda c: chunking.text_windows(c, size, overlap), text) == want


def test_structural_chunks():
    code = "import os\n\n\n@deco\ndef f():\n    return 1\n\n\nclass A:\n    x = 1\n"
    found = structure.structural_chunks(code, "a.py")
    assert [(c["type"], c["start_line"], c["end_line"]) for c in found] == [("function", 4, 6), ("class", 9, 10)]
    assert found[0]["content"].startswith("import os\n\n@deco")
    assert structure.structural_chunks("def (:", "a.py")[0]["type"] == "unknown"
    assert structure.structural_chunks("", "a.py") == []
    md = structure.structural_chunks("# T\n\ntext\n\n```python\ndef g(): pass\n```\n", "a.md")
    assert [(c["type"], c["embedded_in"]) for c in md] == [("heading", None), ("paragraph", None), ("code", None), ("function", "markdown")]
    long = structure.structural_chunks("def f():\n" + "".join(f"    x{i} = {i}\n" for i in range(300)), "a.py", max_size=200)
    assert len(long) > 5 and all(len(c["content"]) <= 200 for c in long) and long[0]["start_line"] == 1
    small = [{"content": "a", "type": "f[0]", "split": True, "end_line": 1}, {"content": "b", "type": "f[1]", "split": True, "end_line": 2}, {"content": "c", "type": "g", "end_line": 3}]
    assert [c["type"] for c in structure.merge_small(small, 10)] == ["f[0]+f[1]", "g"]


def test_ranking_counts_repeats_by_dialect(spark):
    docs = spark.createDataFrame([(1, "alpha beta beta"), (2, "alpha"), (3, "gamma gamma"), (4, "")], "id int, text string")
    plain = ranking.with_tokens(docs, ranking.SYMBOL)
    once = ranking.search(plain, ["id"], {"q": "beta"}, ranking.SYMBOL).first()
    twice = ranking.search(plain, ["id"], {"q": "beta beta"}, ranking.SYMBOL).first()
    assert abs(twice.score - 2 * once.score) < 1e-12 and twice.matched_terms == ["beta"]
    file = ranking.with_tokens(docs, ranking.FILE)
    assert ranking.search(file, ["id"], {"q": "beta beta"}, ranking.FILE).first().score == ranking.search(file, ["id"], {"q": "beta"}, ranking.FILE).first().score
    assert ranking.search(plain, ["id"], {"q": "nothing here"}, ranking.SYMBOL).collect() == []
    assert ranking.search(plain.limit(0), ["id"], {"q": "alpha"}, ranking.SYMBOL).collect() == []
    both = ranking.search(plain, ["id"], {"a": "alpha", "g": "gamma"}, ranking.SYMBOL, limit=1).collect()
    assert {(r.query_id, r.id) for r in both} == {("a", 2), ("g", 3)}


def test_search_tokenises_units_once(spark):
    docs = spark.createDataFrame([(1, "alpha beta beta"), (2, "alpha t7"), (3, "t1 t2"), (4, ""), (5, None)], "id int, text string")
    for asked in ("alpha beta", "alpha beta " + " ".join(f"t{i}" for i in range(ranking.FEW_TERMS))):
        seen = spark.sparkContext.accumulator(0)

        def tokens(text, seen=seen):
            seen.add(1)
            return (text or "").split()

        units = docs.select("id", F.udf(tokens, "array<string>")("text").alias("tokens"))
        got = ranking.search(units, ["id"], {"q": asked}, ranking.FILE, limit=None, components=True).collect()
        assert seen.value == 5
        parts = {(r.id, x.term): (x.term_frequency, x.document_frequency) for r in got for x in r.score_components}
        want = {(1, "alpha"): (1, 2), (1, "beta"): (2, 1), (2, "alpha"): (1, 2)}
        assert parts == (want if len(asked) < 20 else want | {(2, "t7"): (1, 1), (3, "t1"): (1, 1), (3, "t2"): (1, 1)})


def test_snippets(spark):
    text = "\n".join("needle" if i in (3, 30) else f"line {i}" for i in range(40))
    units = spark.createDataFrame([("p", text, ["needle"]), ("q", "a\nb\nc\nd\ne\nf", ["zzz"])], "path string, content string, matched_terms array<string>")
    got = {r.path: r.snippet for r in snippets.snippets(units, ["path"], context=1).collect()}
    assert got["p"] == "3: line 2\n4: needle\n5: line 4\n...\n30: line 29\n31: needle\n32: line 31"
    assert got["q"] == "a\nb\nc\nd\ne"


def test_incremental_equals_full(spark):
    rows = spark.createDataFrame([(i, [f"t{i % 3}", f"u{i}"]) for i in range(12)], "id int, tokens array<string>")
    full = lambda df: {tuple(r) for r in statistics.document_frequencies(statistics.postings(df, ["id"])).collect()}
    before = statistics.document_frequencies(statistics.postings(rows.where("id < 8"), ["id"]))
    after = changes.updated_frequencies(before, rows.where("id < 2"), rows.where("id >= 8"))
    assert {tuple(r) for r in after.collect()} == full(rows.where("id >= 2"))


def test_merges(spark):
    a = spark.createDataFrame([("x", 1.0), ("y", 0.5)], "key string, score double")
    b = spark.createDataFrame([("y", 4.0), ("z", 2.0)], "key string, score double")
    got = {r.key: (round(r.score, 6), r.method) for r in hybrid.merge_hybrid(a, b, 0.7).collect()}
    assert got == {"x": (0.7, "vector"), "y": (0.65, "hybrid"), "z": (0.15, "lexical")}
    status = lambda *s: changes.fold_status(spark.createDataFrame([(x,) for x in s], "status string")).first()
    assert status("ok").status == "ready" and status("ok", "warn").status == "degraded" and status("warn", "fail").exit_code == 1


@pytest.fixture
def tree(tmp_path):
    root = tmp_path / "code"
    for path, text in {"src/auth.ts": 'import x from "y"\n\nexport function login(user) {\n  return check(user)\n}\n\nexport class Session {\n  user = 1\n}\n', "src/pool.ts": "export class Pool {\n  connect() {}\n}\n", "README.md": "# Words about login\n", ".env": "A=1\n", "node_modules/z.ts": "login\n", "bin.png": "x"}.items():
        (root / path).parent.mkdir(parents=True, exist_ok=True)
        (root / path).write_text(text)
    return str(root)


def test_sources(spark, tree):
    assert {r.path for r in read_tree(spark, tree).collect()} == {"src/auth.ts", "src/pool.ts", "README.md", ".env"}
    assert {r.path for r in scan(spark, tree).collect()} == {"src/auth.ts", "src/pool.ts", "README.md", "node_modules/z.ts"}
    assert data_dir(tree, "/base").startswith("/base/projects/") and len(os.path.basename(data_dir(tree))) == 16


def test_engine(spark, tree, tmp_path):
    engine = Engine(spark, Store(spark, str(tmp_path / "index")), EmbeddingConfig(dimensions=16))
    first = engine.index(tree)
    assert (first["mode"], first["files_scanned"], first["chunks"]) == ("full", 3, 4)
    assert engine.index(tree)["mode"] == "cache_hit"
    hits = engine.search("login user")
    assert (hits[0]["path"], hits[0]["symbol_name"], hits[0]["rank"]) == ("src/auth.ts", "login", 1) and "1: import" in hits[0]["snippet"]
    assert engine.search("login user") is hits and engine.cache.stats()["hits"] == 1
    assert {h["path"] for h in engine.search("login", extensions=[".md"])} == {"README.md"}
    assert engine.hybrid("login user", weight=0.5)[0]["path"]
    with open(os.path.join(tree, "src/new.ts"), "w") as f:
        f.write("export const login = 1\n")
    os.remove(os.path.join(tree, "README.md"))
    again = engine.index(tree)
    assert (again["mode"], again["changed"], again["removed"]) == ("incremental", 1, 1)
    kept = {tuple(r) for r in engine.store.read("terms").collect()}
    fresh = Engine(spark, Store(spark, str(tmp_path / "other")))
    fresh.index(tree)
    assert kept == {tuple(r) for r in fresh.store.read("terms").collect()}
    found = envelope("login", engine.search("login"))
    assert found["status"] == "ok" and json.dumps(found)
    answer = handle(spark, {"tool": "search", "input": {"folder": str(tmp_path / "index"), "query": "pool", "limit": 1}})
    assert answer["results"][0]["path"] == "src/pool.ts" and handle(spark, {"tool": "x", "input": {"folder": str(tmp_path / "index")}})["status"] == "error"


def test_increments_equal_a_full_build(spark, tree, tmp_path):
    engine = Engine(spark, Store(spark, str(tmp_path / "index")), EmbeddingConfig(dimensions=8))
    engine.index(tree)
    written = lambda name: {folder for folder, _ in engine.store.state()["tables"][name]}
    for k in range(2):
        before = written("blocks")
        with open(os.path.join(tree, "src/auth.ts"), "a") as f:
            f.write(f"export function extra{k}(login) {{\n  return {k}\n}}\n")
        if k == 1:
            os.remove(os.path.join(tree, "src/pool.ts"))
        assert engine.index(tree)["mode"] == "incremental"
        assert before < written("blocks")  # what was there has not been rewritten
        fresh = Engine(spark, Store(spark, str(tmp_path / f"fresh{k}")), EmbeddingConfig(dimensions=8))
        fresh.index(tree)
        for t in ("chunks", "forward", "terms", "vectors"):
            rows = [sorted(map(str, x.store.read(t).collect())) for x in (engine, fresh)]
            assert rows[0] == rows[1], t
        assert sorted(map(tuple, engine.store.postings().collect())) == sorted(map(tuple, fresh.store.postings().collect()))
        assert [engine.store.get_metadata(x) for x in ("n_chunks", "total_len")] == [fresh.store.get_metadata(x) for x in ("n_chunks", "total_len")]
        assert engine.search("extra0 login") == fresh.search("extra0 login")
    engine.store.compact()
    engine.store.vacuum()
    engine.cache.clear()
    assert engine.store.segments() == 1 and engine.search("extra0 login") == fresh.search("extra0 login")
    best = engine.by_terms(["extra1", "login"], 5).first()
    assert (best.path, best.matches, best.matched_terms) == ("src/auth.ts", 2, ["extra1", "login"])
    assert {r.term for r in engine.store.terms_of(spark.createDataFrame([("README.md",)], "path string")).collect()} == {"words", "about", "login", "readme", "md"}
    assert engine.status()["files"] == 2 and "extra1" in engine.content("src/auth.ts") and engine.content("src/pool.ts") is None
    # the index answers a search: no chunk is tokenised again, and the scan is given the terms
    plan = engine.store.postings(F.col("term") == "login")._jdf.queryExecution().toString()
    assert "PushedFilters" in plan and "login" in plan.split("PushedFilters")[1]


def test_rankings_of_a_corpus(spark, tmp_path):
    """Rankings over a small code base equal plain BM25 over its chunks, for several queries."""
    root = tmp_path / "code"
    areas = {"auth": ["login", "logout", "session", "token"], "db": ["pool", "connection", "query", "migration"], "api": ["router", "handler", "limit", "client"]}
    for area, names in areas.items():
        for k, name in enumerate(names):
            path = root / "src" / area / f"{name}.ts"
            path.parent.mkdir(parents=True, exist_ok=True)
            others = names[k - 1 :] + names[: k - 1]
            path.write_text(f"import {{ {others[0]} }} from './{others[0]}'\n\nexport function {name}User(user) {{\n  return {others[1]}(user, '{area}')\n}}\n\nexport class {name.title()} {{\n  {name} = {k}\n  {area} {name} {name}\n}}\n")
    engine = Engine(spark, Store(spark, str(tmp_path / "index")))
    engine.index(str(root))
    chunks = engine.store.read("chunks").collect()
    mean = sum(len(c.tokens) for c in chunks) / len(chunks)
    assert len(chunks) == 24
    for query in ("user login session", "connection pool db", "rate limit handler client", "import", "nothing of this"):
        scores = {}
        for c in chunks:
            for t in plain(query):
                n, tf = sum(t in x.tokens for x in chunks), c.tokens.count(t)
                if tf:
                    at = (c.path, c.start_line, c.end_line)
                    scores[at] = scores.get(at, 0) + math.log((len(chunks) - n + 0.5) / (n + 0.5) + 1) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(c.tokens) / mean))
        want = sorted(scores.items(), key=lambda x: (-round(x[1], 9), x[0]))[:5]
        got = engine.search(query, limit=5)
        assert [((h["path"], h["start_line"], h["end_line"]), h["score"]) for h in got] == [(at, pytest.approx(x, abs=1e-9)) for at, x in want]


def test_watch_reads_changed_paths_only(spark, tree, tmp_path):
    engine = Engine(spark, Store(spark, str(tmp_path / "index")))
    engine.index(tree)
    query = watch(spark, tree, engine, str(tmp_path / "checkpoint"))
    try:
        query.processAllAvailable()
        with open(os.path.join(tree, "src/late.ts"), "w") as f:
            f.write("export const lateness = 2\n")
        os.remove(os.path.join(tree, "src/pool.ts"))
        query.processAllAvailable()
    finally:
        query.stop()
    assert {r.path for r in engine.store.read("files").collect()} == {"src/auth.ts", "README.md", "src/late.ts"}
    assert engine.search("lateness")[0]["path"] == "src/late.ts" and engine.index(tree)["mode"] == "cache_hit"
    assert {r.path for r in read_tree(spark, tree, only=["src/late.ts", "node_modules/z.ts", "none"]).collect()} == {"src/late.ts"}


def test_records(spark, tmp_path):
    docs = spark.createDataFrame([(1, {"type": "code", "language": "", "x": "1"}), (2, {}), (3, None)], "id int, metadata map<string,string>")
    flat = {r.id: r for r in records.flattened(docs).collect()}
    assert (flat[1].type, flat[1].language, flat[1].metadata_json) == ("code", "", '{"x":"1"}') and flat[3].metadata_json == "{}"
    assert {r.id: r.metadata for r in records.unflattened(records.flattened(docs)).collect()} == {1: {"type": "code", "x": "1"}, 2: {}, 3: {}}
    hits = spark.createDataFrame([("a", 1, 2, 0.5, None)], "path string, start_line int, end_line int, score double, matched_terms array<string>")
    row = records.mapped_hits(hits, "lexical").first()
    assert (row.matchedTerms, row.locator.startLine, row.route) == ([], 1, "lexical")
    assert records.retrieval_evidence(2, 0, 2)["mode"] == "lexical" and records.retrieval_evidence(1, 1, 2)["mode"] == "hybrid" and records.retrieval_evidence(0, 0, 0)["engines"] == []
    assert records.is_key_valid("k", "k") and not records.is_key_valid("k", "l")
    engine = Engine(spark, Store(spark, str(tmp_path / "none")))
    assert changes.fold_status(spark.createDataFrame(records.index_probes(engine.status()), "probe string, status string")).first().status == "unavailable"
    engine.store.describe("/code", "2024-01-01")
    assert json.loads((tmp_path / "none" / "metadata.json").read_text())["projectRoot"] == "/code"
    memory = MemoryStore(spark)
    memory.store(spark.createDataFrame([("a", "1"), ("b", "2")], "path string, content string"))
    memory.store(spark.createDataFrame([("a", "3")], "path string, content string"))
    assert memory.count() == 2 and memory.get("a").first().content == "3" and memory.delete("b") and not memory.delete("b") and not memory.exists("b")
    memory.clear()
    assert memory.count() == 0


def test_bpe_backend(spark):
    tokenizers = pytest.importorskip("tokenizers")
    path = str(pytest.importorskip("public_tokenizers").path("word_bpe_49k.json"))
    texts = ["The quick getUserData walks", "", None]
    got = [r.t for r in spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, text string").orderBy("i").select(bpe_tokens("text", path).alias("t")).collect()]
    plainly = [x.replace("</w>", "").replace("Ġ", "").strip().lower() for x in tokenizers.Tokenizer.from_file(path).encode(texts[0], add_special_tokens=False).tokens]
    assert got == [[x for x in plainly if len(x) > 1], [], []] and got[0][:2] == ["the", "quick"]


def test_old_stores_are_migrated(spark, tmp_path):
    store = Store(spark, str(tmp_path / "s"))
    store.write("terms", spark.createDataFrame([("a", 2)], "term string, df long"))
    state = store.state()
    store._save({"version": state["version"], "schema_version": "1", "tables": {t: x[0][0] for t, x in state["tables"].items()}, "metadata": {"k": 1}})
    again = Store(spark, str(tmp_path / "s"))
    assert [tuple(r) for r in again.read("terms").collect()] == [("a", 2)] and again.get_metadata("k") == 1 and again.state()["schema_version"] == "3"
    store._save({"version": state["version"] + 1, "schema_version": "9", "tables": {}, "metadata": {}})
    with pytest.raises(ValueError):
        Store(spark, str(tmp_path / "s"))


def test_stores(spark, tmp_path):
    store = Store(spark, str(tmp_path / "s"))
    files = lambda *rows: spark.createDataFrame(list(rows), "path string, content string, hash string")
    store.upsert("files", files(("a", "1", "h1"), ("b", "2", "h2")))
    store.upsert("files", files(("a", "3", "h3")))
    assert {(r.path, r.content) for r in store.read("files").collect()} == {("a", "3"), ("b", "2")}
    store.delete_files(files(("b", "", "")))
    assert store.count("files") == 1 and store.exists("files", "a") and not store.exists("files", "b")
    store.set_metadata("k", 1)
    assert Store(spark, str(tmp_path / "s")).get_metadata("k") == 1
    store.vacuum()
    assert store.count("files") == 1
    vectors = VectorStore(store, 2)
    row = lambda i, v: spark.createDataFrame([(i, v)], "id string, vector array<float>")
    vectors.add(row("x", [1.0, 0.0]))
    vectors.add(row("y", [0.0, 1.0]))
    with pytest.raises(ValueError, match="exist"):
        vectors.add(row("x", [1.0, 0.0]))
    with pytest.raises(ValueError, match="dimensions"):
        vectors.add(row("z", [1.0]))
    assert [r.id for r in vector_search.nearest(vectors.rows(), [0.9, 0.1], 1).collect()] == ["x"]
    assert vectors.delete("x") and not vectors.delete("x") and vectors.stats()["count"] == 1
    store.clear()
    assert store.count("files") == 0


def test_cache_and_providers(spark):
    cache = Cache(size=2)
    for k in "abc":
        cache.set(k, k)
    assert cache.get("a") is None and cache.get("c") == "c" and cache.stats()["hit_rate"] == 0.5
    assert cache_key(" Q ", a=["y", "x"]) == cache_key("q", a=["x", "y"]) != cache_key("q", a=["x"])
    register_provider("ones", lambda texts, config: [[1.0] * config.dimensions for _ in texts])
    assert "ones" in registered_providers()
    assert one(spark, lambda c: embed(c, EmbeddingConfig("ones", 3)), "x") == [1.0, 1.0, 1.0]
    with pytest.raises(ValueError, match="no provider"):
        embed(F.lit("x"), EmbeddingConfig("none"))


def test_queries_above_a_block(spark, monkeypatch):
    rows = spark.createDataFrame([(i, [float(i % 7), float(i)]) for i in range(60)], "id int, vector array<double>")
    asked = rows.select(F.col("id").alias("query_id"), F.col("vector").alias("query_vector"))
    found = lambda: sorted(map(tuple, vector_search.nearest_batch(rows, asked, 3).collect()))
    whole = found()
    monkeypatch.setattr(vector_search, "MAX_QUERIES", 25)
    assert found() == whole and len(whole) == 180


def test_change_stream(spark, tree, tmp_path):
    got = []
    feed = ChangeFeed(spark, tree, str(tmp_path / "feed"))
    assert feed.poll() == 5 and feed.poll() == 0
    query = feed.stream().writeStream.foreachBatch(lambda df, i: got.append(sorted((r.type, r.path) for r in df.collect()))).option("checkpointLocation", str(tmp_path / "c")).start()
    try:
        query.processAllAvailable()
        os.remove(os.path.join(tree, "README.md"))
        assert feed.poll() == 1
        query.processAllAvailable()
    finally:
        query.stop()
    assert ("add", "src/auth.ts") in got[0] and [("unlink", "README.md")] in got


def plain(text):
    return [t.lower() for t in re.findall("[A-Za-z0-9_]{2,}", text)]


def saved(spark, folder, **tables):
    for name, (rows, schema) in tables.items():
        spark.createDataFrame(rows, schema).write.parquet(f"{folder}/{name}.parquet")
    return str(folder)


def test_batch_uses_all_terms(spark, tmp_path):
    texts = ["one two three four five six seven eight nine ten", "nine nine ten words", "eleven one", "ten", "words alone here"]
    asked = "one two three four five six seven eight nine ten eleven nine"
    folder = saved(spark, tmp_path, documents=(list(enumerate(texts)), "doc_id int, text string"), benchmark=([(7, asked)], "item_id int, text string"))
    words = [t.split() for t in texts]
    mean, want = sum(map(len, words)) / len(words), {}
    for i, w in enumerate(words):
        for t in set(asked.split()) & set(w):
            n, tf = sum(t in x for x in words), w.count(t)
            want[i] = want.get(i, 0) + math.log((len(words) - n + 0.5) / (n + 0.5) + 1) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(w) / mean))
    assert {r.doc_id: r.score for r in queries.bm25_batch(spark, folder).collect()} == {i: pytest.approx(x, abs=1e-6) for i, x in want.items()} and len(want) == 4


def test_hashes_read_whole_documents(spark, tmp_path):
    texts = ["a" * 40 + "b", "a" * 40 + "c", "été " * 500, "", None]
    folder = saved(spark, tmp_path, documents=(list(enumerate(texts)), "doc_id int, text string"))

    def plain(text):
        h = 0
        for c in text:
            h = (h * 31 + ord(c)) & 0xFFFFFFFF
        return h - (1 << 32) if h >= 1 << 31 else h

    def vector(h):
        v = [(math.sin(h + i) + math.cos((h + i) / 2)) / 2 for i in range(16)]
        return " ".join(f"{x / math.sqrt(sum(y * y for y in v)):.5f}" for x in v)

    want = {i: None if t is None else plain(t) for i, t in enumerate(texts)}
    assert {r.doc_id: r.h for r in queries.poly_hash(spark, folder).collect()} == want and want[0] != want[1]
    assert {r.doc_id: r.v for r in queries.mock_embedding(spark, folder).collect()} == {i: None if h is None else vector(h) for i, h in want.items()}


def test_merges_of_searches(spark, tmp_path):
    docs = [(i, "the thing " * (i + 1) + "word " * 3, "en", "src2") for i in range(8)] + [(8, "the", "en", "src1"), (9, "the", "de", "src2")]
    folder = saved(spark, tmp_path, documents=(docs, "doc_id int, text string, lang string, source string"), embeddings=([(i, [float(i)]) for i in [0, *range(6, 14)]], "vec_id int, embedding array<float>"))
    v = {i: 1 / (1 + i) for i in [0, *range(6, 14)]}
    hits = {r.doc_id: (r.score, r.matched_terms) for r in ranking.search(queries.units(spark, folder), ["doc_id"], {"q": queries.QUERY}, limit=50).collect()}
    most = max(x for x, _ in hits.values())
    want = {i: (pytest.approx(0.7 * v.get(i, 0) + 0.3 * hits.get(i, (0,))[0] / most, abs=1e-6), "hybrid" if i in v and i in hits else "vector" if i in v else "lexical") for i in {*v, *hits}}
    assert len(hits) == 10 and {r.key: (r.score, r.method) for r in queries.hybrid_merge(spark, folder).collect()} == want
    terms = {r.path: r.terms for r in queries.coordinator_merge(spark, folder).collect()}
    assert terms["p000000000"] == "semantic the thing" and terms["p000000013"] == "semantic" and terms["p000000009"] == "semantic the" and terms["p000000001"] == "the thing"
    assert {r.doc_id for r in queries.bm25_filtered(spark, folder).collect()} == set(range(8))


def test_entry_and_oracles():
    import __spark_entry__

    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_many_queries_are_ranked_where_units_lie(spark, monkeypatch):
    """A task hands on its best of each query, whatever the number of pairs; slices of a task make no difference."""
    rng = random.Random(5)
    words = [f"w{i}" for i in range(60)] * 2 + ["the"] * 40
    docs = [(i, [rng.choice(words) for _ in range(rng.randrange(0, 60))] if i % 9 else None) for i in range(200)]
    docs += [(1000 + i, docs[i % 20][1]) for i in range(100)]
    rows = spark.createDataFrame(docs, "doc_id long, tokens array<string>").repartition(3)
    asked = [(f"q{q}", p, t) for q in range(25) for p, t in enumerate(dict.fromkeys(rng.choice(words) for _ in range(8)))] + [("none", 0, "absent")]
    asked += [("many", p, f"w{p}") for p in range(60)] + [("rare", p, f"x{p}") for p in range(20)]
    queries = spark.createDataFrame(asked, "query_id string, pos int, term string")
    known = [(i, t) for i, t in docs if t]
    n, mean = len(docs), max(sum(len(t or []) for _, t in docs) / len(docs), 1.0)
    df = {t: sum(t in x for _, x in known) for _, _, t in asked}
    idf = {t: math.log((n - d + 0.5) / (d + 0.5) + 1) for t, d in df.items() if d}
    want = {}
    for q in {q for q, _, _ in asked}:
        scores = []
        for i, t in known:
            s = sum(idf[w] * t.count(w) * 2.2 / (t.count(w) + 1.2 * (0.25 + 0.75 * len(t) / mean)) for x, _, w in asked if x == q and w in t)
            scores += [(-round(s, 9), i)] if s > 0 else []
        want |= {(q, k + 1): i for k, (_, i) in enumerate(sorted(scores)[:7])}
    def got(queries):
        return {(r.query_id, r["rank"]): r.doc_id for r in ranking.search_batch(rows, ["doc_id"], queries, ranking.SYMBOL, 7).collect()}
    assert got(queries) == want
    monkeypatch.setattr(ranking, "SMALL_ROWS", 5)
    assert got(queries) == want
    # small slices, in this process
    monkeypatch.setattr(ranking, "PAIRS", 1)
    weights = pa.table({"query_id": ["a", "a", "b"], "pos": pa.array([0, 1, 0], pa.int32()), "term": ["w1", "the", "the"], "idf": [1.0, 0.5, 0.5]})
    batch = pa.RecordBatch.from_pydict({"doc_id": [i for i, _ in docs], "tokens": pa.array([t for _, t in docs], pa.list_(pa.string()))})
    few = pa.concat_tables(pa.Table.from_batches([b]) for b in ranking._best_in_task(iter([batch]), weights, mean, 7)).to_pydict()
    assert few["query"].count(0) == few["query"].count(1) == 7
    best = sorted((-round(0.5 * t.count("the") * 2.2 / (t.count("the") + 1.2 * (0.25 + 0.75 * len(t) / mean)), 9), i) for i, t in known if "the" in t)[:7]
    assert [i for q, i in zip(few["query"], few["doc_id"], strict=True) if q == 1] == [i for _, i in best]
