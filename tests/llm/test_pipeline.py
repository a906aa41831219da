"""The pipeline's stages on a small folder: columns, nulls, planted copies, and packing against the tokenizer."""

import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from lumenseek.llm.queries import tokenizer_path


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    at = str(tmp_path_factory.mktemp("tables"))
    clean = [" ".join(f"w{k}x{i}" for i in range(80)) for k in range(20)]
    near = clean[0].replace("w0x5 ", "w0x99 ", 1)
    rows = [(i, t, "en", f"s{i % 3}", len(t)) for i, t in enumerate(clean)] + [(100, clean[0], "en", "s1", 1), (101, near, None, None, 1), (102, "too short", "en", "s0", 1), (103, None, "en", "s0", 1), (104, clean[3] + " mail joe.7@x.org", "en", "s0", 1), (None, clean[4] + " tail", "en", "s0", 1)]
    rows = [(*r, i, None, -i, "x") for i, r in enumerate(rows)]
    # columns that clash with names that operators use inside
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, row int, key string, _id long, _match string").write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame([(0, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{at}/labels.parquet")
    return at


def test_stages(spark, folder):
    import corpus_pipeline
    from tokenizers import Tokenizer

    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns = docs.columns
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        docs = spark.createDataFrame(stage(spark, docs, folder).collect(), stage(spark, docs, folder).schema)
        seen[name] = docs
        if name != "packing":
            assert docs.columns == columns
    ids = lambda name: {r.doc_id for r in seen[name].collect()}
    assert not ids("quality_rules") & {102, 103} and set(range(20)) <= ids("quality_rules")
    assert not ids("near_duplicates") & {100, 101, 104} and None in ids("near_duplicates")
    assert ids("pii") == ids("near_duplicates") == ids("source_mixing") == ids("packing")
    tokenizer = Tokenizer.from_file(str(tokenizer_path()))
    text = {r.doc_id: r.text for r in seen["source_mixing"].collect()}
    for r in seen["packing"].collect():
        want = np.array([*tokenizer.encode(text[r.doc_id], add_special_tokens=False).ids, 1], "<u4")
        assert r.length == len(want) and r.ids_crc32 == zlib.crc32(want.tobytes())
    assert sum(1 for _ in seen["packing"].collect()) == seen["source_mixing"].count()


def test_run_and_empty_tables(spark, folder):
    import corpus_pipeline

    assert {r.doc_id for r in corpus_pipeline.run(spark, folder).collect()} >= set(range(20))
    docs = spark.read.parquet(f"{folder}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, folder).count() == 0


def test_run_equals_a_plain_pipeline(spark, tmp_path):
    """All documents of the smallest table: what should be kept by plain Python, and what became of it."""
    import corpus_pipeline
    from tokenizers import Tokenizer

    folder = "/root/testdata/sf0.001"
    rows = {r.doc_id: r for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}

    def passes(text):
        w = re.findall(r"[^\x20\x09-\x0d]+", text or "")
        at = defaultdict(list)
        for i in range(len(w) - 2):
            at[tuple(w[i : i + 3])].append(i)
        repeated = {i + k for places in at.values() if len(places) > 1 for i in places for k in range(3)}
        return len(w) >= 50 and 100 * len(repeated) <= 50 * len(w)

    # labels are too few for a cutoff here, so the base rules decide
    kept = sorted(i for i, r in rows.items() if passes(r.text))
    lower = lambda t: re.findall(r"[^\x20\x09-\x0d]+", t.translate({c: c + 32 for c in range(65, 91)}))
    sets = {i: {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} for i in kept for w in [lower(rows[i].text)]}
    owner = {i: i for i in kept}

    def find(i):
        while owner[i] != i:
            i = owner[i]
        return i

    by_shingle = defaultdict(set)
    for i, s in sets.items():
        for x in s:
            by_shingle[x].add(i)
    for i, s in sets.items():
        for j in {j for x in s for j in by_shingle[x] if j > i}:
            if 100 * len(s & sets[j]) >= 80 * len(s | sets[j]):
                a, b = sorted((find(i), find(j)))
                owner[b] = a
    stays = {i for i in kept if find(i) == i}
    got = corpus_pipeline.run(spark, folder).collect()
    assert {r.doc_id for r in got} == stays and 50 < len(stays) < len(kept)

    # texts without a trace of a value are packed as they are, each once or twice
    tokenizer = Tokenizer.from_file(str(tokenizer_path()))
    pieces, sequences = defaultdict(Counter), defaultdict(list)
    for r in got:
        pieces[r.doc_id][r.start, r.length, r.ids_crc32] += 1
        sequences[r.sequence_id].append((r.offset, r.length))
    for i in stays:
        assert len(set(pieces[i].values())) == 1 and 1 <= max(pieces[i].values()) <= 2
        if not re.search(r"[@\d]|(?i:token|secret|passw|pwd|key|bearer)", rows[i].text):
            ids = np.array([*tokenizer.encode(rows[i].text, add_special_tokens=False).ids, 1], "<u4")
            assert set(pieces[i]) == {(a, len(ids[a : a + 4096]), zlib.crc32(ids[a : a + 4096].tobytes())) for a in range(0, len(ids), 4096)}
    total = 0
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 4096
        total += at
    assert len(sequences) <= -(-total // 4096) * 1.01 + 1
