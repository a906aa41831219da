"""Cost-balanced packing, fill-in-middle and the audit of sources against plain versions, on rows with nulls, repeats and ties."""

import functools
import hashlib
import json
import random
import re
import zlib
from collections import Counter, defaultdict
from fractions import Fraction

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer, models

from lumenseek.llm.balanced_packing import LINEAR, QUADRATIC, Packer, TextIds, balance, byte_characters, pack_balanced
from lumenseek.llm.fill_in_middle import count_units, fill_in_middle, restored, unit_ends
from lumenseek.llm.queries import tokenizer_path
from lumenseek.llm.source_audit import divergence_audit, share, term_counts

BYTES = "byte_bpe_50k.json"
SCHEMA = "doc_id long, text string, lang string, source string, id long, start int, term string, n string, h1 string, output int, salt int, value string, rank long"


def table(spark, rows):
    """doc_id, text, lang, source and columns whose names clash with inner ones."""
    return spark.createDataFrame([(*r, 9, 9, "x", "y", "z", 1, 2, "v", 3) for r in rows], SCHEMA)


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(3)
    vocabulary = ["the", "The", "été", "Été", "naïve", "über", "don't", "x_y", "a1b", "末", "\U0001f600", "QED", "to", "of"]
    out = []
    for i in range(240):
        text = "".join(rng.choice(vocabulary) + rng.choice([" ", " ", "  ", "\n", "\n\n", "\t", ", ", "  ", "\x1c "]) for _ in range(rng.choice([0, 1, 2, 30, 200])))
        out.append((i, text, rng.choice(["en", "de", None]), rng.choice(["s1", "s1", "s2", None])))
    out += [(500, None, "en", "s1"), (501, "", None, None), (502, "the " * 9000, "en", "s2"), (503, "ab", "fr", "only"), (504, "", "fr", "none"), (505, "12 <> 3", "xx", "one")]
    out += [(506, "before <P> after", "en", "s1"), (507, "a<", "de", "s2"), (508, "<S", "de", "s2"), (509, "x<|endoftext|> y  <|endoftext|>", "en", "s1"), (510, "q" * 30_000, "en", "s1")]
    out += [out[5], out[5], (None, "no id here", "de", "s1"), (None, None, None, None)]
    return out


# cost-balanced packing


@pytest.mark.parametrize("name", [BYTES, "word_bpe_49k.json"])
def test_ids_equal_the_tokenizers(rows, name, monkeypatch):
    monkeypatch.setattr("lumenseek.llm.balanced_packing.SEGMENT", 50)
    ids, plain = TextIds(tokenizer_path(name)), Tokenizer.from_file(tokenizer_path(name))
    assert bool(ids.ranked) == (name == BYTES)
    for text in [*(r[1] for r in rows), " " * 40_000, "\n" * 40_000 + "a", "é" * 40_000 + " b"]:
        assert ids.encode(text or "").tolist() == plain.encode(text or "", add_special_tokens=False).ids


def test_every_token_is_its_own_encoding():
    """Then merging by ranks and merging by pairs agree on all texts: before a token is made, its bytes are merged as they
    are when they stand alone."""
    plain = Tokenizer.from_file(tokenizer_path(BYTES))
    byte = {c: b for b, c in enumerate(byte_characters())}
    vocab = {t: i for t, i in plain.get_vocab(with_added_tokens=False).items() if t != "<|endoftext|>"}
    alone = Tokenizer(models.BPE(vocab=vocab, merges=[tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in json.loads(plain.to_str())["model"]["merges"]]))
    assert all(e.ids == [i] for e, i in zip(alone.encode_batch(list(vocab)), vocab.values(), strict=True))
    assert len(byte) == 256 and all(c in byte for t in vocab for c in t)


def test_other_files_are_left_to_the_tokenizer():
    with open(tokenizer_path(BYTES), encoding="utf-8") as file:
        told = json.load(file)
    assert TextIds._ranked(told)
    for change in ({"normalizer": {"type": "Lowercase"}}, {"pre_tokenizer": {"type": "Whitespace"}}, {"model": told["model"] | {"merges": told["model"]["merges"][::-1]}}, {"model": told["model"] | {"merges": told["model"]["merges"][1:]}}):
        assert TextIds._ranked(told | change) is None


@functools.cache
def encoders():
    return TextIds(tokenizer_path(BYTES)), Tokenizer.from_file(tokenizer_path(BYTES))


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet=" \t\n\r\x0b\x0c\x1c\x1f\x85\xa0 　​ab1'.é<|", max_size=40))
def test_cuts_before_white_space_keep_ids(text):
    ids, plain = encoders()
    assert ids.encode(text).tolist() == plain.encode(text, add_special_tokens=False).ids


def plainly(items, capacities):
    """balance() by looking at all sequences for each item."""
    items = sorted((-n, d, s) for n, d, s in items)
    room, cost, out = list(capacities), [0.0] * len(capacities), []
    while items and any(room):
        n, d, s = -items[0][0], *items.pop(0)[1:]
        fit = [k for k in range(len(room)) if room[k] >= n]
        k = min(fit, key=lambda k: (cost[k], k)) if fit else max(range(len(room)), key=lambda k: (room[k], -k))
        take = min(n, room[k])
        out.append((d, s, take, k, capacities[k] - room[k]))
        room[k] -= take
        cost[k] += LINEAR * take + QUADRATIC * take * take
        if take < n:
            items = sorted([*items, (take - n, d, s + take)])
    return out, [(-n, d, s) for n, d, s in items]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(1, 16), max_size=40), st.integers(0, 12))
def test_balance_equals_a_plain_search(sizes, n_sequences):
    items = [(n, d, 0) for d, n in enumerate(sizes)]
    assert balance(items, [16] * n_sequences) == plainly(items, [16] * n_sequences)


def test_costs_are_balanced():
    """Against best fit, longest first, of the same items into as many sequences."""
    rng = random.Random(1)
    sizes = [min(2047, int(rng.lognormvariate(5.5, 1))) + 1 for _ in range(4000)]
    items = [(n, d, 0) for d, n in enumerate(sizes)]
    capacities = [2048] * (sum(sizes) // 2048)
    work = lambda n: LINEAR * n + QUADRATIC * n * n
    room, best = list(capacities), [0.0] * len(capacities)
    for n in sorted(sizes, reverse=True):
        while n and any(room):
            k = min((k for k in range(len(room)) if room[k] >= n), key=lambda k: room[k], default=None)
            k = max(range(len(room)), key=lambda k: room[k]) if k is None else k
            take = min(n, room[k])
            room[k], n, best[k] = room[k] - take, n - take, best[k] + work(take)
    cost = [0.0] * len(capacities)
    placed, _ = balance(items, capacities)
    for _, _, n, k, _ in placed:
        cost[k] += work(n)
    assert np.std(cost) < 0.9 * np.std(best) and len(placed) < len(items) + len(capacities)


@pytest.mark.parametrize("group", [1 << 22, 3000])
def test_each_id_lies_in_one_piece_and_nothing_is_padded(spark, rows, group):
    path = tokenizer_path(BYTES)
    plain = Tokenizer.from_file(path)
    want = Counter()
    for key, text, *_ in rows:
        want[key, np.array([*plain.encode(text or "", add_special_tokens=False).ids, 1], "<u4").tobytes()] += 1
    got = pack_balanced(table(spark, rows).repartition(3), path, capacity=256, group_tokens=group).collect()
    sequences, docs = defaultdict(list), defaultdict(list)
    for r in got:
        assert r.length == len(r.ids) // 4 > 0
        sequences[r.sequence_id].append((r.offset, r.length))
        docs[r.doc_id].append(r)
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 256 and at & (at - 1) == 0
    assert sum(v for k, v in Counter(sum(n for _, n in p) for p in sequences.values()).items() if k < 256) <= 3 * 8
    seen = Counter()
    for key, parts in docs.items():
        times = {b: n for (k, b), n in want.items() if k == key}
        if sum(times.values()) == 1:
            body = b"".join(bytes(r.ids) for r in sorted(parts, key=lambda r: r.start))
            starts = np.cumsum([0, *(r.length for r in sorted(parts, key=lambda r: r.start))])
            assert [r.start for r in sorted(parts, key=lambda r: r.start)] == starts[:-1].tolist() and {r.doc_tokens for r in parts} == {starts[-1]}
            seen[key, body] += 1
        else:  # rows that share an id: all their ids are there
            assert sum(r.length for r in parts) == sum(len(b) // 4 * n for b, n in times.items())
            assert Counter(x for r in parts for x in np.frombuffer(r.ids, "<u4").tolist()) == sum((Counter({x: c * n for x, c in Counter(np.frombuffer(b, "<u4").tolist()).items()}) for b, n in times.items()), Counter())
            seen += Counter({(key, b): n for b, n in times.items()})
    assert seen == want


def test_packing_of_nothing(spark):
    assert pack_balanced(table(spark, []), tokenizer_path(BYTES)).collect() == []
    only = pack_balanced(table(spark, [(1, None, None, None)]), tokenizer_path(BYTES)).collect()
    assert [(r.doc_id, r.start, r.length, zlib.crc32(r.ids), r.doc_tokens, r.offset) for r in only] == [(1, 0, 1, zlib.crc32(b"\1\0\0\0"), 1, 0)]
    assert pack_balanced(table(spark, [(1, "", None, None)]), tokenizer_path(BYTES), end_id=None).collect() == []
    with pytest.raises(ValueError):
        pack_balanced(table(spark, []), tokenizer_path(BYTES), capacity=1000)


# fill-in-middle


def test_fill_in_middle_equals_a_plain_version(spark, rows):
    made = fill_in_middle(table(spark, rows).repartition(3)).withColumn("back", restored())
    got = Counter(tuple(r) for r in made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", "output", "back").collect())
    want = Counter()
    for key, text, *_ in rows:
        text = text or ""
        units = re.findall(r"[A-Za-z]+|[^A-Za-z]", text)
        digest = hashlib.sha256(f"1:{'' if key is None else key}".encode()).hexdigest()
        h1, h2, h3, h4 = (int(digest[k : k + 8], 16) for k in (0, 8, 16, 24))
        n = len(units)
        if not text or re.search("<[PSM]>", text) or h3 % 100 >= 90:
            want[key, n, "plain", None, None, text, text] += 1
            continue
        a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
        p, m, s = ("".join(x) for x in (units[:a], units[a:b], units[b:]))
        form = "spm" if h4 % 100 < 20 else "psm"
        out = f"<S>{s}<P>{p}<M>{m}" if form == "spm" else f"<P>{p}<S>{s}<M>{m}"
        want[key, n, form, len(p), len(m), out, text] += 1
    assert got == want
    assert {f for _, _, f, *_ in want} == {"plain", "psm", "spm"}


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="ab<>PSM \né\U0001f600", max_size=25), st.integers(0, 30), st.integers(0, 30))
def test_units_are_found_without_holding_them(text, i, j):
    units = re.findall(r"[A-Za-z]+|[^A-Za-z]", text)
    assert count_units(text) == len(units)
    a, b = sorted((i % (len(units) + 1), j % (len(units) + 1)))
    assert unit_ends(text, a, b) == (len("".join(units[:a])), len("".join(units[:b])))


def test_marks_beside_broken_marks_are_told_apart(spark):
    parts = ["<", "<P", "<S", "<M", ">", "P>", "S>", "M>", "a", "", "<<", "><"]
    outs = [(p + m + s, f"<P>{p}<S>{s}<M>{m}", "psm") for p in parts for m in parts for s in parts] + [(p + m + s, f"<S>{s}<P>{p}<M>{m}", "spm") for p in parts for m in parts for s in parts]
    outs = [o for o in outs if not re.search("<[PSM]>", o[0]) and len(re.findall("<[PSM]>", o[1])) == 3]
    frame = spark.createDataFrame(outs, "text string, output string, form string")
    assert len(outs) > 1000 and frame.where(restored() != F.col("text")).count() == 0


def test_fill_in_middle_of_nothing_and_of_string_ids(spark):
    assert fill_in_middle(table(spark, [])).collect() == []
    made = fill_in_middle(spark.createDataFrame([("k", "some text here")], "doc_id string, text string"), percent=100).first()
    assert made.doc_id == "k" and made.form in ("psm", "spm")


# divergence of sources


def audit_plainly(rows, min_docs, top):
    of = [((lang or ""), (source or ""), re.findall(r"[^\x00-\x40\x5b-\x60\x7b-\x7f]+", text or "")) for _, text, lang, source in rows]
    lower = lambda x: x.translate({c: c + 32 for c in range(65, 91)})
    of = [(lang, source, [lower(x) for x in terms]) for lang, source, terms in of]
    out = []
    for lang in {x[0] for x in of}:
        docs = Counter(t for a, _, terms in of if a == lang for t in set(terms))
        kept = sorted(t for t, n in docs.items() if n >= min_docs)
        count = {s: Counter(t for a, b, terms in of if (a, b) == (lang, s) for t in terms if t in set(kept)) for s in {b for a, b, _ in of if a == lang}}
        whole = sum(count.values(), Counter())
        p = lambda c: {t: 1 + int(Fraction(10**9 * (c[t] + 5), sum(c.values()) + 5 * len(kept))) for t in kept}
        shares, q = {s: p(c) for s, c in count.items()}, p(whole)
        for s in shares:
            pairs = [(-sum(abs(shares[s][t] - shares[o][t]) for t in kept), o.encode()) for o in shares if o != s]
            terms = [(q[t] - shares[s][t], t.encode()) for t in kept if count[s][t] and shares[s][t] > q[t]]
            for part, found in (("pair", sorted(pairs)), ("term", sorted(terms)[:top])):
                out += [(lang, s, part, item.decode(), -value, k) for k, (value, item) in enumerate(found, 1)]
    return out


@pytest.mark.parametrize("min_docs,top", [(3, 4), (1, 50), (10_000, 5)])
def test_audit_equals_a_plain_version(spark, rows, min_docs, top):
    got = divergence_audit(table(spark, rows).repartition(3), min_docs=min_docs, top=top)
    assert got.columns == ["lang", "source", "part", "item", "value", "rank"]
    assert Counter(map(tuple, got.collect())) == Counter(audit_plainly(rows, min_docs, top))


def test_terms_are_counted_by_row_and_by_occurrence(spark):
    rows = [(1, "B b a É é", "en", "s"), (2, "a A-a", "en", "s"), (3, None, "en", "s")]
    assert sorted(map(tuple, term_counts(table(spark, rows)).collect())) == [("en", "s", "a", 4, 2), ("en", "s", "b", 2, 1), ("en", "s", "É", 1, 1), ("en", "s", "é", 1, 1)]


def test_shares_are_exact_for_large_counts(spark):
    rng = random.Random(2)
    cases = [(c, c + rng.randrange(10**k + 1), v) for k in range(14) for v in (1, 7, 10**7) for c in (0, 1, 10**k // 3, 9 * 10**12)]
    cases = [c for c in cases if c[1] + 5 * c[2] < 9 * 10**13]
    got = spark.createDataFrame(cases, "c long, t long, v long").select("c", "t", "v", share(F.col("c"), F.col("t"), F.col("v"))).collect()
    assert [r[3] for r in got] == [1 + 10**9 * (c + 5) // (t + 5 * v) for c, t, v, _ in got]


def test_audit_of_nothing(spark):
    assert divergence_audit(table(spark, [])).collect() == []
