"""The stored index and its upkeep, threshold search, file source, change feed, timers, clustered vectors, embeddings."""

import json
import math
import os
import random
import re
import threading
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lumenseek.functions import numeric
from lumenseek.functions.embedding import EmbeddingConfig, compose, embed_rows, register_provider
from lumenseek.operators import changes, chunking, common, inverted, snippets, statistics, threshold, vector_clusters
from lumenseek.plans.engine import KEYS, Engine
from lumenseek.sources import files as sources
from lumenseek.sources import store
from lumenseek.sources.files import METADATA, _TreeReader, read_tree, tree_metadata, written_tree
from lumenseek.sources.store import Conflict, Store
from lumenseek.streaming.change_feed import ChangeFeed
from lumenseek.streaming.index_stream import watch
from lumenseek.streaming.timers import debounced_by_timers

FILES = "path string, content string, hash string, size long, mtime timestamp, language string"


def rows_of(spark, texts):
    return spark.createDataFrame([(p, t, str(hash(t)), len(t), None, "Markdown") for p, t in texts.items()], FILES)


def engine_at(spark, folder, **options):
    return Engine(spark, Store(spark, str(folder)), **options)


def tokens(text):
    return [t.lower() for t in re.findall("[A-Za-z0-9_]{2,}", text)]


def corpus(seed, n):
    rng = random.Random(seed)
    words = ["the", "of", "and"] * 12 + [f"w{i}" for i in range(40)] + [f"rare{i}" for i in range(60)]
    return {f"d{i:03}.md": " ".join(rng.choices(words, k=rng.choice([0, 1, 5, 40, 120]))) for i in range(n)}


def plainly(texts):
    """path -> tokens of its one chunk, document frequencies, mean length."""
    units = {p: tokens(f"{re.sub('[/.-]', ' ', p)} {t}") for p, t in texts.items()}
    df = {}
    for ts in units.values():
        for t in set(ts):
            df[t] = df.get(t, 0) + 1
    return units, df, sum(map(len, units.values())) / len(units)


def ranked_plainly(texts, query, limit):
    units, df, mean = plainly(texts)
    n, scores = len(units), {}
    for p, ts in units.items():
        for t in tokens(query):
            if tf := ts.count(t):
                scores[p] = scores.get(p, 0.0) + math.log((n - df[t] + 0.5) / (df[t] + 0.5) + 1) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(ts) / max(mean, 1)))
    return sorted(((p, round(x, 9)) for p, x in scores.items()), key=lambda x: (-x[1], x[0]))[:limit]


QUERIES = ("the of and", "rare1 the", "rare1 rare2 rare3 of", "w1 w2 w3 w4 w5", "d001 md", "nothing", "the the rare7", "md")


@pytest.fixture(scope="module")
def updated(spark, tmp_path_factory):
    """An index after three updates, and the texts it should hold."""
    texts = corpus(1, 90)
    engine = engine_at(spark, tmp_path_factory.mktemp("updated"))
    engine.build(rows_of(spark, texts), "r")
    for step in range(3):
        rng = random.Random(step)
        fresh = {p: t for p, t in corpus(10 + step, 100).items() if rng.random() < 0.2}
        gone = [p for p in texts if p not in fresh and rng.random() < 0.1] + ["never.md"]
        told = engine.update(rows_of(spark, fresh), spark.createDataFrame([(p,) for p in gone], "path string"))
        texts = {p: t for p, t in texts.items() if p not in gone} | fresh
        assert told["total_units"] == len(texts)
    return engine, texts


def test_weights_after_updates_equal_a_full_build(updated):
    engine, texts = updated
    units, df, _ = plainly(texts)
    weight = lambda p, t: units[p].count(t) / len(units[p]) * (math.log((len(units) + 1) / (df[t] + 1)) + 1)
    length = {p: math.sqrt(sum(weight(p, t) ** 2 for t in set(ts))) for p, ts in units.items()}
    got = {(r.path, r.term): (r.raw_freq, r.token_count, r.tfidf, r.magnitude) for r in engine.vectors_of().collect()}
    assert got == {(p, t): (ts.count(t), len(ts), pytest.approx(weight(p, t), abs=1e-9), pytest.approx(length[p], abs=1e-9)) for p, ts in units.items() for t in set(ts)}
    assert {r.path: (r.token_count, r.magnitude) for r in engine.magnitudes().collect()} == {p: (len(ts), pytest.approx(length[p], abs=1e-9)) for p, ts in units.items()}
    assert {r.term: r.df for r in engine.store.terms().collect()} == df
    some = engine.vectors_of(["d001.md", "none.md"])
    assert {r.path for r in some.collect()} <= {"d001.md"}


@pytest.mark.parametrize("block,limit,looked_up", [(128, 5, 500), (4, 4, 500), (4, 4, 0), (1, 1000, 500)])
def test_threshold_search_equals_full_scoring(spark, updated, tmp_path, monkeypatch, block, limit, looked_up):
    engine, texts = updated
    monkeypatch.setattr(inverted, "BLOCK", block)
    monkeypatch.setattr(threshold, "BLOCK", block)
    if block != 128:
        engine = engine_at(spark, tmp_path / "small")
        engine.build(rows_of(spark, texts), "r")
    monkeypatch.setattr(threshold, "LOOKED_UP", looked_up)
    for query in QUERIES:
        want = ranked_plainly(texts, query, limit)
        got = engine.ranked(query, limit=limit)
        assert [(r["path"], round(r["score"], 9)) for r in got] == want, query
        assert [r["rank"] for r in got] == list(range(1, len(got) + 1))
    for query in QUERIES[:2]:
        want = ranked_plainly(texts, query, limit)
        least = want[len(want) // 2][1] if want else 0.1
        assert {r["path"] for r in engine.ranked(query, limit=limit, min_score=least - 1e-6)} == {p for p, x in want if x >= least - 1e-6}
        some = engine.ranked(query, limit=limit, where=F.col("path").endswith("1.md"))
        assert [r["path"] for r in some] == [p for p, _ in ranked_plainly(texts, query, 10**6) if p.endswith("1.md")][:limit]


def test_search_leaves_blocks_out(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(inverted, "BLOCK", 4)
    monkeypatch.setattr(threshold, "BLOCK", 4)
    engine = engine_at(spark, tmp_path / "s")
    texts = corpus(5, 300)
    engine.build(rows_of(spark, texts), "r")
    seen = {}
    got = engine.ranked("the", limit=3, seen=seen)
    assert [(r["path"], round(r["score"], 9)) for r in got] == ranked_plainly(texts, "the", 3)
    assert seen["read"] * 4 < seen["blocks"] and seen["postings_read"] < seen["postings"]
    for b in engine.store.read("blocks").collect():
        held = [d.raw_freq / (d.raw_freq + 1.2 * (0.25 + 0.75 * d.doc_len / engine.store.get_metadata("mean_len"))) for d in b.docs]
        assert b.n == len(b.docs) <= 4 and max(held) == pytest.approx(b.bound) and held == sorted(held, reverse=True)


def test_results_say_what_chunks_say(updated):
    engine, texts = updated
    hit = engine.search("rare1 the", limit=2)[0]
    assert hit["language"] == "Markdown" and hit["chunk_type"] == "file" and hit["snippet"].startswith("1: ") and hit["score_components"][0]["bm25"] > 0
    best = engine.by_terms(["rare1", "the"], 3).first()
    units, df, _ = plainly(texts)
    assert [w.term for w in best.weights] == [t for t in ("rare1", "the") if t in units[best.path]] and best.token_count == len(units[best.path]) and best.content == texts[best.path]


def test_an_update_reads_its_own_rows(spark, tmp_path, monkeypatch):
    """Of the forward index, only pages that may hold a changed path are read."""
    monkeypatch.setattr(store, "PAGE_ROWS", 20)
    engine = engine_at(spark, tmp_path / "s")
    engine.build(rows_of(spark, corpus(7, 400)).repartition(4), "r")
    rows = engine.rows_of("forward", spark.createDataFrame([("d007.md",)], "path string"), ["d007.md"])
    assert [r.path for r in rows.collect()] == ["d007.md"]
    plan = rows._jdf.queryExecution().executedPlan()
    scans = plan.collectLeaves()
    read = sum(scans.apply(i).metrics().get("numOutputRows").get().value() for i in range(scans.size()))
    assert "path" in plan.toString().split("PushedFilters")[1] and 0 < read <= 100  # a page has no fewer rows


def test_forward_rows_equal_counting(spark):
    rows = [("a", ["x", "y", "x", "é"]), ("b", []), ("c", None), ("d", ["y"])]
    got = inverted.forward_rows(spark.createDataFrame(rows, "path string, tokens array<string>"), ["path"]).collect()
    assert [(r.path, r.doc_len, [tuple(t) for t in r.terms]) for r in got] == [("a", 4, [("x", 2), ("y", 1), ("é", 1)]), ("b", 0, []), ("c", 0, []), ("d", 1, [("y", 1)])]


# the store


def test_opening_and_reading_write_nothing(spark, tmp_path):
    writer = Store(spark, str(tmp_path / "s"))
    writer.write("terms", spark.createDataFrame([("a", 1)], "term string, df long"))
    before = sorted(os.listdir(tmp_path / "s" / "states"))
    state = writer.state()
    reader = Store(spark, str(tmp_path / "s"))
    writer.commit(append={"terms": spark.createDataFrame([("a", 2), ("b", 1)], "term string, df long")})
    Store(spark, str(tmp_path / "s"))
    assert {tuple(r) for r in reader.read("terms").collect()} == {("a", 3), ("b", 1)}
    assert {tuple(r) for r in reader.read("terms", state=state).collect()} == {("a", 1)}  # a state is a version of all tables
    assert sorted(os.listdir(tmp_path / "s" / "states")) == before + [f"{len(before) + 1:012d}.json"]


def test_two_writers_lose_nothing(spark, tmp_path):
    stores = [Store(spark, str(tmp_path / "s")) for _ in range(2)]
    rows = [[s.stage("terms", spark.createDataFrame([(f"t{k}{i}", 1)], "term string, df long")) for i in range(6)] for k, s in enumerate(stores)]
    work = lambda k: [stores[k].commit(append={"terms": r}, add={"n_chunks": 1}) for r in rows[k]]
    threads = [threading.Thread(target=work, args=(k,)) for k in range(2)]
    [t.start() for t in threads]
    [t.join() for t in threads]
    assert {r.term for r in stores[0].terms().collect()} == {f"t{k}{i}" for k in range(2) for i in range(6)} and stores[1].get_metadata("n_chunks") == 12
    old = stores[0].state()
    stores[1].write("terms", spark.createDataFrame([("z", 1)], "term string, df long"))
    with pytest.raises(Conflict):
        stores[0].write("terms", spark.createDataFrame([("y", 1)], "term string, df long"), since=old)
    assert [r.term for r in stores[0].terms().collect()] == ["z"]


def test_an_update_is_made_again_after_another(spark, tmp_path, monkeypatch):
    texts = corpus(2, 20)
    one, two = (engine_at(spark, tmp_path / "s") for _ in range(2))
    one.build(rows_of(spark, texts), "r")
    commit, raced = one.store.commit, []

    def slow(**parts):
        if not raced:
            raced.append(two.update(rows_of(spark, {"d001.md": "the first writer", "d002.md": "the first"}), spark.createDataFrame([("d003.md",)], "path string")))
        commit(**parts)

    monkeypatch.setattr(one.store, "commit", slow)
    one.update(rows_of(spark, {"d001.md": "the second writer"}), spark.createDataFrame([("d004.md",)], "path string"))
    want = texts | {"d001.md": "the second writer", "d002.md": "the first"}
    want = {p: t for p, t in want.items() if p not in ("d003.md", "d004.md")}
    units, df, _ = plainly(want)
    assert raced and {r.term: r.df for r in one.store.terms().collect()} == df and one.store.get_metadata("n_chunks") == len(want)
    fresh = engine_at(spark, tmp_path / "fresh")
    fresh.build(rows_of(spark, want), "r")
    near = lambda e: {r.path: pytest.approx(r.magnitude, abs=1e-9) for r in e.magnitudes().collect()}
    assert {r.path: r.magnitude for r in one.magnitudes().collect()} == near(fresh)
    with pytest.raises(ValueError):
        one.store.check_root("elsewhere")


def test_chunks_need_their_file(spark, tmp_path):
    at = Store(spark, str(tmp_path / "s"))
    at.write("files", rows_of(spark, {"a.md": "x"}))
    chunk = lambda *r: spark.createDataFrame(list(r), "path string, start_line int, end_line int, text string")
    assert [r.id for r in at.store_chunks(chunk(("a.md", 1, 2, "x"))).collect()] == ["chunk://a.md:1-2"]
    with pytest.raises(ValueError, match="b.md"):
        at.store_chunks(chunk(("a.md", 1, 1, "y"), ("b.md", 1, 1, "z")))
    assert [r.text for r in at.read("chunks").collect()] == ["x"]


# files and changes


@pytest.fixture
def tree(spark, tmp_path):
    root = str(tmp_path / "tree")
    paths = {f"a{i % 5}/b{i % 3}/f{i}.md": "x" * (10 * i) for i in range(60)} | {"top.md": "1", "node_modules/n.js": "2", "a1/.hidden.md": "3"}
    written_tree(spark.createDataFrame(list(paths.items()), "path string, content string"), root)
    return root, {p: t for p, t in paths.items() if not p.startswith("node_modules")}


def test_listing_is_dealt_and_filters_are_pushed(spark, tree, monkeypatch):
    root, paths = tree
    size = F.col("size")
    assert {r.path: r["size"] for r in tree_metadata(spark, root, parts=2).collect()} == {p: len(t) for p, t in paths.items()}
    found = tree_metadata(spark, root, parts=3).where((size > 100) & (size <= 300) & F.col("path").startswith("a2/") & F.col("path").contains("b1"))
    assert {r.path for r in found.collect()} == {p for p, t in paths.items() if 100 < len(t) <= 300 and p.startswith("a2/") and "b1" in p}
    assert tree_metadata(spark, root).where(F.col("mtime") > F.lit("2100-01-01").cast("timestamp")).count() == 0
    assert {r.path: r.content for r in read_tree(spark, root, only=["top.md", "a1/.hidden.md", "none.md", "a1"]).collect()} == {"top.md": "1", "a1/.hidden.md": "3"}
    assert read_tree(spark, root, only=[]).count() == 0
    # the driver lists upper folders only: with 2 partitions, the root and its five folders
    listed, real = [], sources._listed
    monkeypatch.setattr(sources, "_listed", lambda r, folder, ignore: (listed.append(folder), real(r, folder, ignore))[1])
    reader = _TreeReader({"path": root, "partitions": "1"}, spark.createDataFrame([], METADATA).schema)
    parts = reader.partitions()
    assert listed == [""] and sorted(parts[0].whole) == [f"a{i}" for i in range(5)] and parts[0].flat == [""]
    opened = []
    monkeypatch.setattr("builtins.open", lambda *a, **k: opened.append(a))
    monkeypatch.setattr(sources, "load_ignore", lambda r: sources.Ignore())
    assert len(list(reader.read(parts[0]))) == len(paths) and not opened


def test_refresh_compares_times_first(spark, tree, tmp_path, monkeypatch):
    root, paths = tree
    engine = engine_at(spark, tmp_path / "i")
    assert engine.index(root)["mode"] == "full"
    read = []
    monkeypatch.setattr("lumenseek.plans.engine.read_tree", lambda s, r, only=None: (read.append(only), read_tree(s, r, only=only))[1])
    assert engine.index(root)["mode"] == "cache_hit" and read == [[]]
    os.utime(os.path.join(root, "top.md"), (1, 1))
    told = engine.index(root)
    assert told["mode"] == "cache_hit" and told["files_scanned"] == len(paths) and read[-1] == ["top.md"]
    with open(os.path.join(root, "top.md"), "w") as f:
        f.write("changed words")
    os.remove(os.path.join(root, "a1/.hidden.md"))
    told = engine.index(root)
    assert (told["mode"], told["changed"], told["removed"]) == ("incremental", 1, 1) and engine.search("changed")[0]["path"] == "top.md"


def test_feed_offsets_do_not_grow_with_the_folder(spark, tmp_path):
    sizes = {}
    for n in (20, 200):
        root = str(tmp_path / f"t{n}")
        written_tree(spark.createDataFrame([(f"d{i % 7}/{i}.md", "x") for i in range(n)], "path string, content string"), root)
        feed = ChangeFeed(spark, root, str(tmp_path / f"feed{n}"))
        assert feed.poll() == n and feed.poll() == 0
        out = str(tmp_path / f"out{n}")
        run = lambda: feed.stream(1).writeStream.format("parquet").option("path", out).option("checkpointLocation", f"{out}-c").trigger(availableNow=True).start().awaitTermination()
        os.remove(os.path.join(root, "d0/0.md"))
        with open(os.path.join(root, "d1/1.md"), "w") as f:
            f.write("longer")
        assert ChangeFeed(spark, root, str(tmp_path / f"feed{n}")).poll() == 2
        run()
        run()
        rows = spark.read.parquet(out)
        assert rows.count() == n + 2 and {tuple(r) for r in rows.where("version = 2").select("type", "path").collect()} == {("unlink", "d0/0.md"), ("change", "d1/1.md")}
        offsets = sorted(x for x in os.listdir(f"{out}-c/offsets") if x.isdigit())
        assert len(offsets) == len([x for f in os.walk(str(tmp_path / f"feed{n}" / "changes")) for x in f[2] if x.endswith(".parquet")]) > 1  # one file of the log per batch
        sizes[n] = max(len(open(f"{out}-c/offsets/{x}").read().splitlines()[-1]) for x in offsets)
        assert json.loads(open(f"{out}-c/offsets/{offsets[0]}").read().splitlines()[-1]).keys() == {"logOffset"}
    assert abs(sizes[20] - sizes[200]) <= 1


def test_a_claimed_version_is_finished_after_a_crash(spark, tmp_path, monkeypatch):
    root = str(tmp_path / "t")
    written_tree(spark.createDataFrame([("a.md", "x"), ("b.md", "y")], "path string, content string"), root)
    feed = ChangeFeed(spark, root, str(tmp_path / "feed"))
    monkeypatch.setattr(feed, "_shown", lambda *a: (_ for _ in ()).throw(RuntimeError("lost")) if a[1].get("changes") else None)
    with pytest.raises(RuntimeError):
        feed.poll()
    again = ChangeFeed(spark, root, str(tmp_path / "feed"))
    assert again.poll() == 0
    assert {r.path for r in spark.read.option("recursiveFileLookup", "true").parquet(str(tmp_path / "feed" / "changes")).collect()} == {"a.md", "b.md"}


def test_watch_tells_of_progress_and_goes_on(spark, tree, tmp_path):
    root, _ = tree
    engine, told, changed = engine_at(spark, tmp_path / "i"), [], []
    engine.index(root)
    for k in range(2):
        running = watch(spark, root, engine, str(tmp_path / "w"), on_change=lambda df: changed.append(df.count()), every=3600, on_progress=told.append)
        try:
            with open(os.path.join(root, f"new{k}.md"), "w") as f:
                f.write(f"freshness{k}")
            running.processAllAvailable()
        finally:
            running.stop()
        assert engine.search(f"freshness{k}")[0]["path"] == f"new{k}.md"
    assert changed[-1] == 1 and any(x["rows"] for x in told) and {"batch", "rows", "ms"} == set(told[0])


# timers


def test_pending_timers_survive_a_restart(spark, tmp_path):
    events = str(tmp_path / "events")
    at = lambda s: f"2024-01-01 00:00:{s:06.3f}"
    write = lambda rows: spark.createDataFrame(rows, "path string, ts string, type string").withColumn("ts", F.col("ts").cast("timestamp")).coalesce(1).write.mode("append").parquet(events)

    def run():
        source = spark.readStream.schema("path string, ts timestamp, type string").parquet(events)
        made = debounced_by_timers(source, gap_ms=500, clock="event", delay="0 seconds")
        made.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start().awaitTermination()
        return sorted((r.path, r.type, r.n, (r.last_at - r.first_at).total_seconds()) for r in spark.read.parquet(str(tmp_path / "out")).where("path IS NOT NULL").collect())

    write([("a", at(0), "add"), ("a", at(0.3), "change"), ("b", at(0.1), "add"), ("a", at(0.9), "unlink"), (None, at(0.2), "add")])
    first = run()
    assert ("a", "change", 2, 0.3) in first and not any(t == "unlink" for _, t, _, _ in first)
    write([("c", at(5), "add")])
    second = run()
    assert ("a", "unlink", 1, 0.0) in second and ("b", "add", 1, 0.0) in second and not any(p == "c" for p, *_ in second)
    with pytest.raises(ValueError):
        debounced_by_timers(spark.readStream.schema("path string, ts timestamp, type string").parquet(events), clock="wall")


# vectors


@pytest.mark.parametrize("n,k", [(400, 5), (3, 5), (0, 2)])
def test_clusters_give_exact_neighbours(spark, tmp_path, monkeypatch, n, k):
    monkeypatch.setattr(vector_clusters, "TILE", 16)
    rng = np.random.default_rng(4)
    middle = rng.normal(size=(12, 6)) * 5
    rows = [(i, (middle[i % 12] + rng.normal(size=6) * 0.2).tolist(), i % 2) for i in range(n)]
    rows += [(n + i, rows[i][1], 0) for i in range(min(n, 20))]  # ties
    odd = [(9001, None, 0), (9002, [1.0, 2.0], 0), (9003, [float("nan")] * 6, 0), (9004, [None] * 6, 1), (9005, [float("inf")] * 6, 1)] if n else []
    table = spark.createDataFrame(rows + odd, "id int, vector array<double>, label int").repartition(3)
    index = vector_clusters.VectorIndex(spark, str(tmp_path / "v"))
    index.build(table, keep=("label",), count=24)
    held = np.array([v for _, v, _ in rows]).reshape(len(rows), 6)
    ids, labels = np.array([i for i, _, _ in rows]), np.array([x for _, _, x in rows])

    def plain(q, mask):
        d = np.sqrt(((held - np.array(q)) ** 2).sum(axis=1))
        return [(int(i), pytest.approx(float(x), abs=1e-9)) for x, i in sorted(zip(d[mask], ids[mask], strict=True))[:k]]

    every = np.ones(len(rows), bool)
    asked = [(f"q{i}", (middle[i % 12] + rng.normal(size=6)).tolist()) for i in range(10)] + [("far", [1000.0] * 6), ("short", [1.0]), ("none", None)]
    if n:
        for _, q in asked[:3]:
            seen = {}
            assert [tuple(r) for r in index.search(q, k, seen=seen).collect()] == plain(q, every)
            assert [tuple(r) for r in index.search(q, k, F.col("label") == 1).collect()] == plain(q, labels == 1)
            assert seen["vectors"] == len(rows) and (n < 100 or seen["visited"] < len(rows) / 3)
    got = {}
    for r in index.search_batch(spark.createDataFrame(asked, "query_id string, query_vector array<double>"), k).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.id, r.distance))
    assert {q: [(i, d) for _, i, d in sorted(x)] for q, x in got.items()} == ({name: plain(q, every) for name, q in asked if q and len(q) == 6} if n else {})


def test_embedding_batches_may_fail(spark, tmp_path):
    calls = []

    def provider(texts, config):
        if any("bad" in t for t in texts):
            raise TimeoutError("no answer")
        return [[float("nan")] * 2 if t == "nan" else [float(len(t)), 1.0] for t in texts]

    register_provider("partly", provider)
    texts = ["one", "bad two", None, "three", "nan", "four bad"] + [f"t{i}" for i in range(50)]
    rows = embed_rows(spark.createDataFrame(list(enumerate(texts)), "id int, text string"), EmbeddingConfig("partly", 2), batch=8).collect()
    assert {r.id for r in rows if r.vector is None} == {1, 4, 5} and all((r.vector is None) != (r.error is None) for r in rows)
    assert {r.id: r.error for r in rows}[1] == "TimeoutError: no answer" and list(rows[2].vector) == [0.0, 1.0] and len(rows) == 56
    engine = engine_at(spark, tmp_path / "i", embedding=EmbeddingConfig("partly", 2))
    told = engine.build(rows_of(spark, {"a.md": "fine words", "b.md": "bad words", "c.md": "more fine words"}), "r")
    assert told["failed"] == 1 and {r.path for r in engine.store.read("vectors").collect()} == {"a.md", "c.md"}
    assert [(r.path, r.error) for r in engine.store.read("failures").collect()] == [("b.md", "TimeoutError: no answer")]
    engine.update(rows_of(spark, {"b.md": "good words"}), spark.createDataFrame([], "path string"))
    assert {r.path for r in engine.store.read("vectors").collect()} == {"a.md", "b.md", "c.md"} and engine.store.count("failures") == 0
    both = compose(provider, lambda texts, config: [[0.0, 0.0] for _ in texts])
    assert both(["bad"], EmbeddingConfig("x", 2)) == [[0.0, 0.0]] and not calls


def test_hybrid_end_to_end(spark, tmp_path):
    def provider(texts, config):
        if any(t == "down" for t in texts):
            raise ConnectionError("unreachable")
        return [[float(t.count("pool")), float(t.count("login")), 1.0] for t in texts]

    register_provider("counts", provider)
    engine = engine_at(spark, tmp_path / "i", embedding=EmbeddingConfig("counts", 3))
    texts = {"a.md": "login login page\nand words", "b.md": "pool of things", "c.md": "pool login", "d.md": "other words"}
    engine.build(rows_of(spark, texts), "r")
    lexical = {h["path"]: h for h in engine.search("login", limit=20)}
    near = {p: 1 / (1 + math.dist(provider([t], None)[0], provider(["login"], None)[0])) for p, t in texts.items()}
    most, best = max(h["score"] for h in lexical.values()), max(near.values())
    got = engine.hybrid("login", limit=10, content=True)
    assert {r["path"]: (round(r["score"], 6), r["method"]) for r in got} == {p: (round(0.7 * near[p] / best + 0.3 * (lexical[p]["score"] / most if p in lexical else 0), 6), "hybrid" if p in lexical else "vector") for p in texts}
    by = {r["path"]: r for r in got}
    assert by["a.md"]["matched_terms"] == ["login"] and by["a.md"]["content"].startswith("1: login") and by["b.md"]["content"] == texts["b.md"]
    assert all(r["language"] == "Markdown" and r["chunk_type"] == "file" and r["start_line"] == 1 for r in got) and not engine.warnings
    assert [r["method"] for r in engine.hybrid("login", weight=1.0, limit=2)] == ["vector"] * 2
    assert {r["method"] for r in engine.hybrid("login", weight=0.0)} == {"lexical"}
    fallen = engine.hybrid("down", limit=2)
    assert fallen == [] and "unreachable" in engine.warnings[0]
    assert {r["path"] for r in engine.hybrid("login", extensions=[".ts"])} == set()


# expressions


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.text(alphabet="abTé \n", max_size=60), st.lists(st.sampled_from(["a", "T", "é", "zz"]), max_size=3)), min_size=1, max_size=4), st.integers(0, 2), st.integers(5, 60))
def test_snippets_equal_a_plain_version(spark, rows, context, most):
    def plain(text, terms):
        lines = text.split("\n")
        blocks = []
        for i, line in enumerate(lines):
            found = [t for t in terms if t.lower() in line.lower()]
            if found and blocks and i - blocks[-1][1] <= 2 * context + 1:
                blocks[-1] = (blocks[-1][0], i, blocks[-1][2] | set(found))
            elif found:
                blocks.append((i, i, set(found)))
        blocks = [(max(a - context, 0) + 1, min(b + context, len(lines) - 1) + 1, len(t)) for a, b, t in blocks]
        best = sorted(sorted(blocks, key=lambda b: (-b[2], -b[2] / (b[1] - b[0] + 1), b[0]))[:4])
        out, size = [], 0
        for i, (a, b, _) in enumerate(best):
            body = "\n".join(f"{k}: {lines[k - 1]}" for k in range(a, b + 1))
            size += len(body)
            if i == 0 or size <= most:
                out.append(body)
        return "\n...\n".join(out) if out else "\n".join(lines[:5])

    table = spark.createDataFrame([(i, t, ts) for i, (t, ts) in enumerate(rows)], "id int, content string, matched_terms array<string>")
    got = {r.id: r.snippet for r in snippets.snippets(table, ["id"], context=context, max_chars=most).collect()}
    assert got == {i: plain(t, ts) for i, (t, ts) in enumerate(rows)}


def test_hashes_count_utf16_units(spark):
    def plain(text):
        h, units = 0, np.frombuffer(text.encode("utf-16-be"), ">u2")
        for c in units.tolist():
            h = (h * 31 + c) & 0xFFFFFFFF
        h -= (1 << 32) if h >= 1 << 31 else 0
        digits, n = "", abs(h)
        while n:
            digits, n = "0123456789abcdefghijklmnopqrstuvwxyz"[n % 36] + digits, n // 36
        return h, ("-" if h < 0 else "") + (digits or "0")

    texts = ["", "a", "\U0001f600 grin", "x\U00010000\U0010ffff", "é" * 300, "hello world"]
    got = spark.createDataFrame([(t,) for t in texts], "t string").select("t", numeric.poly_hash32(F.col("t")), numeric.poly_hash(F.col("t"))).collect()
    assert {r.t: (r[1], r[2]) for r in got} == {t: plain(t) for t in texts}


def test_stale_files(spark):
    schema = "path string, size long, mtime timestamp"
    at = lambda rows: spark.createDataFrame(rows, "path string, size long, ms long").select("path", "size", F.timestamp_millis("ms").alias("mtime"))
    old, new = at([("a", 1, 0), ("b", 1, 0), ("c", 1, 0), ("d", 1, 0), ("e", 1, None)]), at([("a", 1, 1000), ("b", 1, 1001), ("c", 2, 0), ("e", 1, 0), ("f", 1, 0)])
    assert {r.path: r.change_type for r in changes.stale_files(old, new).collect()} == {"a": "unchanged", "b": "changed", "c": "changed", "d": "deleted", "e": "changed", "f": "added"}
    assert changes.stale_files(spark.createDataFrame([], schema), spark.createDataFrame([], schema)).count() == 0


assert KEYS == threshold.KEYS


def test_bursts_of_a_key_are_rows_not_frames():
    """A frame per burst took most of the time where keys have many bursts."""
    from pyspark.sql import Row

    from lumenseek.streaming.timers import _Debounce

    class Value:
        held = None

        def get(self):
            return self.held

        def update(self, value):
            self.held = value

    made = _Debounce(["path", "first_ms", "last_ms", "kind", "n"], 500, True, "string")
    made.burst, timers = Value(), []
    made._timer = timers.append
    rows = [Row(event_ms=ms, event_kind=kind, event_order=kind) for ms, kind in [(9000, None), (0, "b"), (0, "a"), (9000, "c"), (400, "d"), (2000, "e")]]
    out = list(made.handleInputRows(("p",), iter(rows), None))
    assert [tuple(r) for r in out] == [("p", 0, 400, "d", 3), ("p", 2000, 2000, "e", 1)] and out[0].first_ms == 0
    assert made.burst.held == (9000, 9000, None, 2) and timers == [9500]


def test_visits_are_written_out_in_small_batches():
    """Queries of a batch with a copy for each cluster that they visit were one batch of vectors."""
    middle = np.arange(256, dtype=np.float64)[:, None] * np.ones((1, 4))
    batch = pa.RecordBatch.from_arrays([pa.array(range(1000)), pa.array([[float(i % 256)] * 4 for i in range(1000)]), pa.array([None] * 1000, pa.float64())], ["query_id", "q", "beat"])
    out = list(vector_clusters._others(iter([batch]), middle, np.ones(256), np.arange(256), ["query_id", "q", "cluster"]))
    assert sum(map(len, out)) == 1000 * 255 and max(map(len, out)) <= 64 * 256


def test_tokens_are_counted_in_slices():
    """What a task holds at once does not grow with the rows of a batch."""
    rng = random.Random(3)
    rows = [[f"t{rng.randrange(40)}" for _ in range(n)] if n else None for n in [0, 1, inverted.SLICE + 9, 3, 0, *[1000] * 600]]
    batch = pa.RecordBatch.from_pydict({"k": list(range(len(rows))), "tokens": pa.array(rows, pa.list_(pa.string()))})
    out = list(inverted.counted(iter([batch, batch.slice(0, 0), batch.slice(2, 2)])))
    assert max(sum(b.column(1).to_pylist()) for b in out if len(b) > 1) <= inverted.SLICE and len(out) > 4
    got = [r for b in out for r in b.to_pylist()]
    assert [r["k"] for r in got] == [*range(len(rows)), 2, 3]
    for r in got:
        assert {x["term"]: x["raw_freq"] for x in r["terms"]} == Counter(rows[r["k"]] or []) and r["doc_len"] == len(rows[r["k"]] or [])


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_postings_are_packed_where_units_lie(spark):
    rng = random.Random(8)
    units = spark.createDataFrame([(f"p{i:03d}", [f"t{min(rng.randrange(30), rng.randrange(30))}" for _ in range(rng.randrange(0, 40))]) for i in range(120)], "path string, tokens array<string>").repartition(2)
    forward = inverted.forward_rows(units, ["path"])
    blocks = inverted.packs_of(forward.localCheckpoint(), ["path"], 12.0)
    assert "Exchange" not in plan_of(blocks)
    batch = pa.RecordBatch.from_pylist([r.asDict(True) for r in forward.orderBy("path").collect()], schema=pa.schema([("path", pa.string()), ("doc_len", pa.int64()), ("terms", pa.list_(pa.struct([("term", pa.string()), ("raw_freq", pa.int64())])))]))
    for size, pack in ((4, 200), (128, 10**6), (1, 1)):
        out = [r for b in inverted._packs(iter([batch]), size, pack, 12.0) for r in b.to_pylist()]
        got = sorted((r["term"], d["path"], d["raw_freq"], d["doc_len"]) for r in out for d in r["docs"])
        assert got == sorted((x["term"], r["path"], x["raw_freq"], r["doc_len"]) for r in batch.to_pylist() for x in r["terms"])
        for r in out:
            held = [d["raw_freq"] / (d["raw_freq"] + 1.2 * (0.25 + 0.75 * d["doc_len"] / 12.0)) for d in r["docs"]]
            assert r["n"] == len(held) <= size and held == sorted(held, reverse=True) and held[0] == pytest.approx(r["bound"])
    assert {(r.term, r.n) for r in blocks.groupBy("term").agg(F.sum("n").alias("n")).collect()} == {(r.term, r.n) for r in forward.select(F.explode("terms.term").alias("term")).groupBy("term").agg(F.count("*").alias("n")).collect()}


@pytest.mark.parametrize("most", [0, 7, 10**6])
def test_counts_of_frequent_terms_go_to_the_rows(spark, monkeypatch, most):
    monkeypatch.setattr(common, "FREQUENT", most)
    rows = spark.createDataFrame([(i, f"t{i % k}") for i in range(60) for k in (3, 17, 50)], "u long, term string")
    counts = rows.groupBy("term").agg(F.count(F.lit(1)).alias("df")).where("term <> 't2'").localCheckpoint()
    got = common.with_counts(rows, counts)
    assert sorted(map(tuple, got.select("u", "term", "df").collect())) == sorted(map(tuple, rows.join(counts, "term").select("u", "term", "df").collect()))
    if most > 1000:
        assert "SortMergeJoin" not in plan_of(got) and "hashpartitioning" not in plan_of(got)


@pytest.mark.parametrize("most", [0, 7, 10**6])
def test_norms_are_added_up_in_one_pass_over_units(spark, monkeypatch, most):
    monkeypatch.setattr(common, "FREQUENT", most)
    docs = {i: [f"t{i % k}" for k in (1, 2, 3, 17, 50)] * (1 + i % 2) for i in range(60)} | {60: []}
    read = spark.sparkContext.accumulator(0)

    def told(batches, read=read):
        for batch in batches:
            read.add(batch.num_rows)
            yield batch

    units = spark.createDataFrame(list(docs.items()), "path long, tokens array<string>")
    forward = inverted.forward_rows(units, ["path"])
    df = inverted.postings_of(forward, ["path"]).groupBy("term").agg(F.count(F.lit(1)).alias("df")).where("term <> 't2'").localCheckpoint()
    counts = {r.term: r.df for r in df.collect()}
    share = {(i, t): x.count(t) / len(x) for i, x in docs.items() for t in set(x) if t in counts}
    kept = []
    got = inverted.norm_rows(forward.mapInArrow(told, forward.schema), df, ["path"], lambda rows: kept.append(rows.localCheckpoint()) or kept[-1]).collect()
    assert read.value == 61 and len(kept) == (most < 50)
    for level, column in enumerate(("s0", "s1", "s2")):
        want = {}
        for (i, t), x in share.items():
            want[i] = want.get(i, 0) + x * x * math.log1p(counts[t]) ** level
        assert {r.path: r[column] for r in got} == {i: pytest.approx(x) for i, x in want.items()} and len(got) == len(want)
    moved = df.withColumn("df_new", F.col("df") + 1)
    a = inverted.norm_changes(forward, moved, ["path"], lambda rows: rows.localCheckpoint()).collect()
    b = {r.path: r for r in inverted.posting_changes(inverted.postings_of(forward, ["path"]), moved, ["path"]).collect()}
    assert len(a) == len(b) and all(tuple(r) == pytest.approx(tuple(b[r.path])) for r in a)


def test_chunks_are_cut_where_files_lie(spark):
    files = spark.createDataFrame([("a.ts", "x\nexport function f() {\n}\nclass A\nclass A\n", "TS"), ("b.ts", "", "TS"), ("c.ts", None, None), ("d.py", "def g():\n  1", "PY")], "path string, content string, language string")
    chunks = chunking.chunk_symbols(files, keep=("language",))
    assert "Exchange" not in plan_of(chunks)
    got = sorted((r.path, r.start_line, r.end_line, r.symbol_name, r.chunk_type, r.text, r.language) for r in chunks.collect())
    assert got == [
        ("a.ts", 2, 3, "f", "function", "x\nexport function f() {\n}", "TS"), ("a.ts", 4, 4, "A", "class", "x\nclass A", "TS"), ("a.ts", 5, 5, "A", "class", "x\nclass A", "TS"),
        ("b.ts", 1, 1, None, "file", "", "TS"), ("c.ts", 1, 1, None, "file", "", None), ("d.py", 1, 2, "g", "function", "def g():\n  1", "PY"),
    ]


def test_large_updates_read_units_and_small_ones_blocks(spark, tmp_path, monkeypatch):
    from lumenseek.plans import engine as plans

    texts, later = corpus(3, 40), {p: t for p, t in corpus(4, 40).items() if p.endswith(("1.md", "4.md"))}
    norms = []
    for most in (0, 10**6):
        monkeypatch.setattr(plans, "SMALL_ROWS", most)
        engine = engine_at(spark, tmp_path / f"s{most}")
        engine.build(rows_of(spark, texts), "r")
        engine.update(rows_of(spark, later), spark.createDataFrame([], "path string"))
        norms.append({r.path: pytest.approx(r.magnitude, abs=1e-9) for r in engine.magnitudes().collect()})
    assert norms[0] == norms[1]


def test_tfidf_tokenises_a_unit_once(spark):
    told = spark.sparkContext.accumulator(0)

    def tokens(text):
        told.add(1)
        return text.split()

    docs = spark.createDataFrame([(i, "a b" if i % 2 else "a c c") for i in range(8)], "doc_id long, text string")
    weighted = statistics.tfidf(docs.select("doc_id", F.udf(tokens, "array<string>")("text").alias("tokens")), ["doc_id"])
    assert weighted.count() == 16 and len(weighted.collect()) == 16
    assert told.value == 8
    from lumenseek.operators.ranking import sparse_cosine

    assert "SortMergeJoin" not in plan_of(sparse_cosine(weighted, ["doc_id"], "aa bb"))
