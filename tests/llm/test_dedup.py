"""Exact, suffix-array and near-duplicate dedup against brute force and on edge cases."""

import hashlib
import random
import re
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from atlaskb.llm import exact_dedup, minhash_dedup, registry, suffix_dedup
from atlaskb.llm.common import Scratch

from ..oracle import DATA, expected, rows_of

DOC = "doc_id long, text string, lang string, source string, n_chars long"


def table(spark, texts, kind=DOC):
    rows = [(i, t, "en", "s", len(t or "")) for i, t in texts]
    return spark.createDataFrame(rows, kind)


@pytest.mark.parametrize("name", sorted(registry.SQL))
def test_queries_against_sql(spark, name):
    assert rows_of(registry.QUERIES[name](spark, DATA)) == expected(registry.SQL[name])


def test_exact_edge_cases(spark):
    docs = table(spark, [(1, "a b"), (2, "ab "), (3, "a  b"), (4, None), (5, ""), (6, "A b"), (None, " "), (7, "x\x0by"), (8, "xy"), (8, "xy"), (9, " q"), (10, "q")])
    docs = docs.withColumn("digest", docs.text).withColumn("run", docs.doc_id)  # clashing names
    got = {}
    for r in exact_dedup.mark(docs).collect():
        got.setdefault(r.doc_id, []).append(r)
    # Of equal texts the longest original stays, then the smallest id.
    assert {i: got[i][0].keep_id for i in (1, 2, 3)} == {1: 3, 2: 3, 3: 3} and got[1][0].group_size == 3
    assert got[4][0].group_size == 3 and got[4][0].keep_id is None and got[None][0].kept
    assert got[7][0].kept and not any(r.kept for r in got[8]) and got[6][0].group_size == 1
    assert got[9][0].kept and got[10][0].kept  # a no-break space isn't deleted
    assert got[4][0].text_sha256 == hashlib.sha256(b"").hexdigest()
    kept = exact_dedup.dedup(docs)
    assert kept.columns == docs.columns and sorted((r.doc_id is None, r.doc_id) for r in kept.collect()) == [(False, 3), (False, 6), (False, 7), (False, 9), (False, 10), (True, None)]
    assert exact_dedup.dedup(table(spark, [(1, "z"), (1, "z"), (2, "z")])).count() == 1
    assert exact_dedup.mark(docs.limit(0)).count() == 0


def test_exact_keeps_a_large_group_whole(spark):
    docs = table(spark, [(i, "same") for i in range(3000)] + [(9000, "other")])
    rows = exact_dedup.mark(docs).collect()
    assert len(rows) == 3001 and sum(r.kept for r in rows) == 2 and {r.group_size for r in rows if r.doc_id < 9000} == {3000}


def test_exact_runs_merge_in_binomial_rounds(spark):
    level = spark.range(400).selectExpr(
        "id % 8 AS run", "unhex(lpad(hex(id % 50), 4, '0')) AS digest", "1 AS norm_chars", "2L AS checksum",
        "named_struct('n', -1, 'none', false, 'doc_id', id, 'row', id) AS best", "1L AS rows",
    )
    level = level.groupBy("run", *exact_dedup._KEY).agg(F.min("best").alias("best"), F.sum("rows").alias("rows"))
    for step, runs in ((1, {0, 2, 4, 6}), (2, {0, 4}), (4, {0})):
        level = exact_dedup.merge_runs(level, step)
        assert "SortMergeJoin" in level._jdf.queryExecution().executedPlan().toString()
        assert {r.run for r in level.select("run").distinct().collect()} == runs
    assert sorted((int(r.digest.hex(), 16), r.best.doc_id, r.rows) for r in level.collect()) == [(i, i, 8) for i in range(50)]


# Suffix arrays

def brute_spans(texts, length, keep):
    """(index, covered flags) by comparing all windows."""
    seen = defaultdict(list)
    data = [(i, (t or "").encode()) for i, t in texts]
    for n, (i, b) in enumerate(data):
        for p in range(len(b) - length + 1):
            seen[b[p : p + length]].append((i, n, p))
    flags = [bytearray(len(b)) for _, b in data]
    for places in seen.values():
        places.sort()
        for _, n, p in places[1:] if keep == "first" else places if len(places) > 1 else []:
            flags[n][p : p + length] = b"\x01" * length
    return flags


def check_suffix(spark, texts, length, keep):
    got = {r.doc_id: r for r in suffix_dedup.digest(table(spark, texts), length, keep).collect()}
    for (i, t), flags in zip(texts, brute_spans(texts, length, keep), strict=True):
        data = (t or "").encode()
        left = bytes(c for c, f in zip(data, flags, strict=True) if not f)
        assert (got[i].n_bytes, got[i].n_removed, got[i].n_spans, bytes(got[i].kept)) == (len(data), sum(flags), len(re.findall(b"\x01+", bytes(flags))), left), (i, length, keep)


def messy_texts(seed, n=40):
    rnd = random.Random(seed)
    word = lambda: "".join(rnd.choice("abcdeé") for _ in range(rnd.randint(1, 6)))
    shared = [" ".join(word() for _ in range(30)) for _ in range(4)]
    texts = []
    for i in range(n):
        parts = [" ".join(word() for _ in range(rnd.randint(0, 40))) for _ in range(3)]
        parts.insert(rnd.randint(0, 3), rnd.choice(shared)[rnd.randint(0, 20) :])
        texts.append((i, rnd.choice([" ".join(parts), "ab" * rnd.randint(0, 80), rnd.choice(shared), None, "x" * rnd.randint(0, 90)])))
    return texts


@pytest.mark.parametrize("keep", ["none", "first"])
@pytest.mark.parametrize("length", [10, 40])
def test_suffix_against_brute_force(spark, keep, length):
    check_suffix(spark, messy_texts(length), length, keep)


@pytest.mark.parametrize("keep", ["none", "first"])
def test_large_keys_are_cut_and_stay_exact(spark, monkeypatch, keep):
    """Periodic texts of many lengths among them, whose windows are all alike."""
    monkeypatch.setattr(suffix_dedup, "GROUP_BYTES", 120)
    periodic = [(100 + i, t) for i, t in enumerate(["x" * 60, "y" + "x" * 45, "ab" * 30, "cab" + "ab" * 20 + "d", "abc" * 25, "x" * 24, "q" * 24, "z" * 30])]
    check_suffix(spark, messy_texts(7, 30) + periodic, 24, keep)


def test_periods_of_a_run_are_certain():
    rnd = random.Random(3)
    for _ in range(300):
        unit = "".join(rnd.choice("abc") for _ in range(rnd.randint(1, 9)))
        data = ("".join(rnd.choice("abcd") for _ in range(rnd.randint(0, 12))) + unit * rnd.randint(1, 12) + "".join(rnd.choice("abcd") for _ in range(rnd.randint(0, 12)))).encode()
        length = 12
        n = len(data) - length + 1
        if n < 3:
            continue
        windows = [data[i : i + length] for i in range(n)]
        at = np.cumsum([0, *(rnd.choice([len(unit), len(unit), 1]) for _ in range(6))])
        for first in (True, False):
            parts = suffix_dedup.without_periods(data, at, n, length, first)
            kept = [i for a, m, _, certain in parts if not certain for i in range(a, a + m)]
            sure = [i for a, m, _, certain in parts if certain for i in range(a, a + m)]
            assert len(set(kept)) == len(kept) and set(kept) | set(sure) == set(range(n))
            for i in sure:
                assert windows[i] in windows[:i] if first else windows.count(windows[i]) > 1
            assert {windows[i] for i in kept} == set(windows)
            for a, m, repeated, certain in parts:
                assert not repeated or not first and all(windows.count(windows[i]) > 1 for i in range(a, a + m))


def test_periodic_text_is_few_runs():
    def runs(text):
        return len(suffix_dedup.minimizer_runs(np.frombuffer(text.encode(), dtype=np.uint8), 400)[0])

    assert runs("x" * 20_000) == 1 and runs("a line of 20 letters" * 1000) == 1
    rnd = random.Random(1)
    assert 50 < runs("".join(rnd.choice("abcdef ") for _ in range(20_000))) < 250


def test_long_texts_span_segments(spark, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "SEGMENT", 50)
    check_suffix(spark, messy_texts(9, 20), 20, "none")


def test_longest_factors_by_definition():
    rnd = np.random.default_rng(1)
    for text in (rnd.integers(97, 99, 200), np.full(60, 97), np.tile([97, 98, 99], 40), np.concatenate([np.tile([97, 98], 30), rnd.integers(97, 99, 60)])):
        text = text.astype(np.uint8)
        for length in (1, 3, 8, 9, 20, 33):
            starts = np.arange(len(text) - length + 1)
            windows = [bytes(text[i : i + length]) for i in starts]
            shared = [[next((k for k in range(length) if a[k] != b[k]), length) for b in windows] for a in windows]
            order, common = suffix_dedup.suffix_order(text, starts, length)
            assert order.tolist() == sorted(starts.tolist(), key=lambda i: (windows[i], i))
            assert common.tolist() == [0] + [shared[a][b] for a, b in zip(order[:-1].tolist(), order[1:].tolist(), strict=True)]
            assert suffix_dedup.longest_factors(order, common, length).tolist() == [max(shared[i][:i], default=0) for i in starts]
            assert suffix_dedup.longest_factors(order, common, length, later=True).tolist() == [max(shared[i][i + 1 :], default=0) for i in starts]


def test_suffix_query_against_brute_force(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text").collect()]
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in registry.QUERIES["op2_suffix_dedup"](spark, DATA).collect()}
    seen, flags = {}, [bytearray(len((t or "").encode())) for _, t in docs]
    for n, (_, t) in enumerate(docs):
        data = (t or "").encode()
        for p in range(len(data) - 399):
            m, q = seen.setdefault(data[p : p + 400], (n, p))
            if (m, q) != (n, p):
                flags[n][p : p + 400] = flags[m][q : q + 400] = b"\x01" * 400
    assert any(map(any, flags)) and len(got) == len(docs)
    for (i, t), f in zip(docs, flags, strict=True):
        data = (t or "").encode()
        left = bytes(c for c, x in zip(data, f, strict=True) if not x)
        assert got[i] == (len(data), sum(f), len(re.findall(b"\x01+", bytes(f))), hashlib.sha256(left).hexdigest())


def test_suffix_clean_keeps_columns_and_characters(spark):
    passage = "é" * 30
    docs = table(spark, [(1, "a" + passage + "b"), (2, "c" + passage + "d"), (3, None), (4, "")]).withColumnRenamed("source", "cuts_")
    got = suffix_dedup.clean(docs, 21, "first")
    assert got.columns == docs.columns
    texts = {r.doc_id: r.text for r in got.collect()}
    assert texts[3] is None and texts[4] == "" and texts[2] == "cd" and texts[1].startswith("a") and texts[1].endswith("b")
    assert suffix_dedup.clean(docs.limit(0), 21).count() == 0


# Near duplicates

def brute_components(texts, words, percent):
    sets = {}
    for i, t in texts:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets[i] = {tuple(w[j : j + words]) for j in range(len(w) - words + 1)} if len(w) >= words else {tuple(w)} if w else set()
    parent = {i: i for i in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for n, a in enumerate(ids):
        for b in ids[:n]:
            if 100 * min(len(sets[a]), len(sets[b])) < percent * max(len(sets[a]), len(sets[b])):
                continue
            both = len(sets[a] & sets[b])
            if both and 100 * both >= percent * len(sets[a] | sets[b]):
                x, y = root(a), root(b)
                parent[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), root(i)) for i in ids}


def near_texts(seed, n=120):
    rnd = random.Random(seed)
    word = lambda: "".join(rnd.choice("abcdefgh") for _ in range(4))
    bases = [[word() for _ in range(rnd.choice([2, 8, 60, 200]))] for _ in range(12)]
    texts = []
    for i in range(n):
        w = list(rnd.choice(bases))
        for _ in range(rnd.choice([0, 0, 1, 2, 5, 12])):
            w[rnd.randrange(len(w))] = word()
        texts.append((i, rnd.choice([" ", "\n", "\t "]).join(w).upper() if rnd.random() < 0.3 else " ".join(w)))
    return [*texts, (n, None), (n + 1, ""), (n + 2, " \n"), (n + 3, "One"), (n + 4, "oNE")]


@pytest.mark.parametrize(("words", "percent", "part"), [(3, 85, 3), (5, 80, 512)])
def test_near_against_brute_force(spark, monkeypatch, words, percent, part):
    monkeypatch.setattr(minhash_dedup, "PART", part)
    monkeypatch.setattr(minhash_dedup, "BLOCK", 300 * part)
    texts = near_texts(words)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in minhash_dedup.components(table(spark, texts), words, percent).collect()}
    assert got == brute_components(texts, words, percent)


def test_near_query_against_brute_force(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text").collect()
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in registry.QUERIES["op5_minhash_dedup"](spark, DATA).collect()}
    want = brute_components([(r.doc_id, r.text) for r in docs], 3, 85)
    assert got == {i: (n, c, i == c) for i, (n, c) in want.items()}


def test_near_repeats_nulls_and_clashing_columns(spark):
    long = " ".join(f"w{i}" for i in range(50))
    docs = table(spark, [(5, long), (5, long), (None, long), (7, long + " end"), (8, None)]).withColumn("row", F.lit(1)).withColumn("near_id_", F.lit(2))
    kept = minhash_dedup.dedup(docs)
    assert kept.columns == docs.columns and sorted(str(r.doc_id) for r in kept.collect()) == ["5", "5", "8"]
    assert minhash_dedup.dedup(docs.limit(0)).count() == 0


def test_superminhash_estimates_similarity():
    rnd = np.random.default_rng(3)
    for shared in (50, 200, 350):
        common = rnd.integers(0, 2**63, shared).astype(np.uint64)
        own = [rnd.integers(0, 2**63, 400 - shared).astype(np.uint64) for _ in range(2)]
        a, b = minhash_dedup.signatures([np.unique(np.concatenate((common, x))) for x in own])
        assert abs((a == b).mean() - shared / (800 - shared)) < 0.15
    one = minhash_dedup.signatures([np.array([1], dtype=np.uint64), np.array([1, 2], dtype=np.uint64)])
    assert (one < 2**63).all() and sorted((one[0] >> np.uint64(56)).tolist()) == list(range(minhash_dedup.SLOTS))  # a permutation
    assert (one[1] <= one[0]).all()


@pytest.mark.parametrize("links", [9, 10**6])
def test_connected_components(spark, monkeypatch, links):
    monkeypatch.setattr(minhash_dedup, "LINKS", links)
    rnd = random.Random(5)
    edges = [(i, i + 1) for i in range(0, 60) if i % 20 != 19] + [(rnd.randrange(100, 200), rnd.randrange(100, 200)) for _ in range(80)]
    got = {r.node: r.label for r in minhash_dedup.connected(spark.createDataFrame(edges, "a long, b long").repartition(7), Scratch(spark, "test")).collect()}
    parent = {x: x for e in edges for x in e}
    for _ in parent:
        for a, b in edges:
            parent[a] = parent[b] = min(parent[a], parent[b])
    assert got == {x: p for x, p in parent.items() if x != p}


def test_connected_ends_when_no_two_links_meet(spark, monkeypatch):
    """A path whose links are each in a task of its own, so that only the rounds join them."""
    monkeypatch.setattr(minhash_dedup, "LINKS", 1)
    calls = []

    class Counted(Scratch):
        def put(self, df, name):
            calls.append(name)
            assert len(calls) < 60, "rounds don't end"
            return super().put(df, name)

    held = {"spark.sql.adaptive.coalescePartitions.enabled": "false", "spark.sql.shuffle.partitions": "64", "spark.sql.files.openCostInBytes": "128m"}
    before = {k: spark.conf.get(k, None) for k in held}
    try:
        for k, v in held.items():
            spark.conf.set(k, v)
        edges = [(i + 1, i) for i in range(1, 9)] + [(20, 21), (22, 21), (22, 23)]
        frame = spark.createDataFrame(spark.sparkContext.parallelize(edges, len(edges)), "a long, b long")
        got = {r.node: r.label for r in minhash_dedup.connected(frame, Counted(spark, "test")).collect()}
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    assert got == {i: 1 for i in range(2, 10)} | {i: 20 for i in (21, 22, 23)}


@pytest.mark.parametrize("widest", [500, 1 << 20])
def test_large_families_meet_in_few_blocks_or_in_rounds(spark, monkeypatch, widest):
    """64 sets of 500 elements, blocks of 500: all pairs of 64 blocks send 64 times the family."""
    monkeypatch.setattr(minhash_dedup, "BLOCK", 500)
    monkeypatch.setattr(minhash_dedup, "WIDEST", widest, raising=False)
    monkeypatch.setattr(minhash_dedup, "ROUND", 1, raising=False)
    most, put = [], Scratch.put

    def noted(self, df, name):
        done = put(self, df, name)
        if name == "met":
            most.append(name)
        elif name == "block-pairs":
            most.append(done.count())
        return done

    monkeypatch.setattr(Scratch, "put", noted)
    # Each set shares 470 elements with the one of its couple, none with others.
    sets = {i: [i // 2 * 1000 + j for j in range(470)] + [10**6 + i * 1000 + j for j in range(30)] for i in range(64)}
    frame = spark.createDataFrame(list(sets.items()), "node long, elements array<long>")
    open_ = frame.selectExpr("node", "node AS label", "0L AS family", "500L AS size")
    links = {(r.a, r.b) for r in minhash_dedup._in_blocks(open_, frame, 85, Scratch(spark, "blocks")).collect()}
    assert links == {(i + 1, i) for i in range(0, 64, 2)}
    pairs, rounds = most[0], most.count("met")
    assert rounds >= 8 if widest == 500 else pairs <= minhash_dedup.FEW * (minhash_dedup.FEW + 1) / 2
