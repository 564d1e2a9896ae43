"""Language ID, toxicity, search, HTML extraction and chat formatting."""

import json
import math
import random
import tracemalloc
import zlib
from collections import Counter

import numpy as np
import pytest
import regex
from pyspark.sql import functions as F

from atlaskb.llm import chat_format, html_extract, language_id, registry, search, toxicity
from atlaskb.llm.common import Scratch

from ..oracle import DATA


# Language ID

def test_language_query_on_held_out_rows(spark):
    langs = {r.doc_id: r.lang for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()}
    rows = registry.QUERIES["op7_language_id"](spark, "/root/testdata/sf0.01").collect()
    assert len(rows) == len(langs) and all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows)
    held = [r for r in rows if r.held_out]
    assert sum(r.lang_pred == langs[r.doc_id] for r in held) / len(held) > 0.95 and all(0 <= r.score <= 1 for r in rows)


def test_language_counts_and_distance_by_definition():
    text = "Été à la mer, l'été!"
    want = Counter()
    for w in regex.findall(r"\p{L}+", text.lower()):
        padded = f"_{w}_"
        want.update(padded[i : i + n] for n in (1, 2, 3) for i in range(len(padded) - n + 1) if padded[i : i + n] != "_")
    pack = lambda g: sum(ord(c) << 21 * (len(g) - 1 - i) for i, c in enumerate(g))
    codes = language_id.marked_letters(text)
    for found in (language_id.counted(language_id.grams(codes)), language_id.counted_by_table(codes)):
        assert dict(zip(*(x.tolist() for x in found), strict=True)) == {pack(g): n for g, n in want.items()}
    profiles = {"xx": [pack(g) for g in ("é", "_l", "t")], "yy": [pack("z")]}
    mine = sorted(want, key=lambda g: (-want[g], pack(g)))
    distance = sum(min(abs(mine.index(g) - k), language_id.TOP) for k, g in enumerate(("é", "_l", "t"))) + language_id.TOP * (len(mine) - 3)
    lang, score = language_id.Ranker(profiles)(text)
    assert lang == "xx" and score == pytest.approx(1 - distance / language_id.TOP / len(mine))


def test_language_edge_cases(spark):
    docs = spark.createDataFrame([(1, "la casa", "it"), (2, None, "it"), (3, "12 !", None), (None, "the house", "en"), (5, "the the the", None), (5, "", "en")], "doc_id long, text string, lang string").withColumn("score", F.lit(0))
    profiles = language_id.train(docs)
    assert set(profiles) == {"it", "en"}
    got = {(r.doc_id, r.lang_pred, r.score > 0) for r in language_id.predict(docs, profiles).collect()}
    assert {(2, "und", False), (3, "und", False), (5, "und", False), (5, "en", True), (1, "it", True), (None, "en", True)} == got
    assert {r.lang_pred for r in language_id.predict(docs, {}).collect()} == {"und"}
    assert language_id.predict(docs.limit(0), profiles).count() == 0
    kept = language_id.filter_rejects(docs, 0.2)
    assert kept.columns == docs.columns and kept.count() == 3


# Toxicity

def toxic_tables(spark, n=400):
    rnd = random.Random(2)
    word = lambda: "".join(rnd.choice("abcdefg") for _ in range(5))
    bad = ["zorkish", "zorking", "flup"]
    rows, labels = [], []
    for i in range(n):
        words, toxic = [word() for _ in range(30)], i % 5 == 0
        if toxic:
            words += [rnd.choice(bad) for _ in range(rnd.choice([1, 4]))]
        rows.append((i, " ".join(words)))
        labels.append((i, int(toxic), 1))
    return spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int, quality int")


def test_toxicity_held_out(spark):
    docs, labels = toxic_tables(spark)
    model = toxicity.train(docs, labels.where("doc_id % 2 = 0"))
    got = {r.doc_id: r for r in toxicity.score(docs, model).collect()}
    assert all(got[i].toxic == (i % 5 == 0) for i in got if i % 2)
    more = spark.createDataFrame([(1, "zorkified here"), (2, None), (3, ""), (None, "flup flup")], "doc_id long, text string").withColumn("toxic", F.lit("x"))
    assert {r.doc_id: r.toxic for r in toxicity.score(more, model).collect()} == {1: True, 2: False, 3: False, None: True}  # by its stem
    assert list(model.thresholds) == sorted(model.thresholds) and len(model.thresholds) == 2


def test_toxicity_without_labels(spark):
    docs, labels = toxic_tables(spark, 20)
    for none in (labels.limit(0), labels.withColumn("toxic", F.lit(None).cast("int")), labels.withColumn("toxic", F.lit(0))):
        rows = toxicity.score(docs, toxicity.train(docs, none)).collect()
        assert len(rows) == 20 and not any(r.toxic for r in rows)
    assert toxicity.score(docs.limit(0), toxicity.train(docs, labels)).count() == 0


def test_ordinal_fit_recovers_an_order():
    rnd = np.random.default_rng(0)
    grades = rnd.integers(0, 3, 600)
    flat = np.concatenate([np.repeat(1, int(g)) if g else np.array([2]) for g in grades]).astype(np.uint64)
    owner = np.concatenate([np.full(max(int(g), 1), i) for i, g in enumerate(grades)])
    model = toxicity.fit(flat, owner, grades)
    weight = dict(zip(model.features.tolist(), model.weights.tolist(), strict=True))
    expected = [model.at_least(weight.get(2, 0) if g == 0 else g * weight[1]).sum() for g in (0, 1, 2)]
    assert expected[0] < 0.3 and 0.7 < expected[1] < 1.3 and expected[2] > 1.7


# Search

def brute_search(docs, queries, k):
    terms = {i: Counter(regex.findall(r"[\p{L}\p{N}]+", (t or "").lower())) for i, t in docs}
    n, mean = len(docs), sum(sum(c.values()) for c in terms.values()) / len(docs)
    df = Counter(t for c in terms.values() for t in c)
    out = {}
    for q in queries:
        scores = []
        for i, c in terms.items():
            shared = set(terms[q]) & set(c)
            if shared:
                length = sum(c.values())
                s = sum(math.log1p((n - df[t] + 0.5) / (df[t] + 0.5)) * c[t] * 2.2 / (c[t] + 1.2 * (0.25 + 0.75 * length / mean)) for t in shared)
                scores.append((-round(s, 6), i))
        out[q] = [(i, -s) for s, i in sorted(scores)[:k]]
    return out


@pytest.mark.parametrize("shard", [7, 100_000])
def test_search_is_exact(spark, monkeypatch, shard):
    monkeypatch.setattr(search, "SHARD_DOCS", shard)
    monkeypatch.setattr(search, "BLOCK", 4)
    rnd = random.Random(shard)
    docs = [(i, " ".join(rnd.choice("abcdefghijklmnop") * rnd.randint(1, 3) for _ in range(rnd.randint(0, 40)))) for i in range(80)] + [(80, None), (81, "a a b"), (82, "a a b")]
    frame = spark.createDataFrame(docs, "doc_id long, text string").withColumn("terms", F.lit(1))
    queries = frame.where("doc_id % 4 = 0 OR doc_id > 79")
    got = {}
    for r in search.top_k(frame, queries, 5).orderBy("rank").collect():
        got.setdefault(r.query_id, []).append((r.doc_id, r.score))
    want = {q: x for q, x in brute_search(docs, [i for i, _ in docs if i % 4 == 0 or i > 79], 5).items() if x}
    assert got.keys() == want.keys()
    for q in want:
        assert [i for i, _ in got[q]] == [i for i, _ in want[q]] and np.allclose([s for _, s in got[q]], [s for _, s in want[q]], atol=2e-6)
    assert search.top_k(frame.limit(0), queries.limit(0)).count() == 0


def test_search_multiplies_frequent_terms_once_for_many_queries(spark, monkeypatch):
    monkeypatch.setattr(search, "BLOCK", 4)
    monkeypatch.setattr(search, "FIRST_BLOCKS", 1)
    rng = random.Random(8)
    words = [f"w{i}" for i in range(40)]
    docs = [(i, " ".join(rng.choices(words, [1 / (j + 1) for j in range(40)], k=rng.randint(1, 30)))) for i in range(120)]
    told = [search.Terms()(t) for _, t in docs]
    sizes, lengths = np.array([len(h) for h, _ in told]), np.array([int(c.sum()) for _, c in told])
    shard = search.Shard(np.concatenate([h for h, _ in told]), np.concatenate([c for _, c in told]), sizes, lengths, lengths.mean())
    df = Counter(h for terms, _ in told for h in terms.tolist())
    asked = [shard.held(h, np.log1p([(120 - df[x] + 0.5) / (df[x] + 0.5) for x in h.tolist()])) for h, _ in told]
    base = shard.frequent(asked)
    assert base.shape == (120, shard.blocks, 4) and len(shard.dense) > 5
    for (i, want), held, mine in zip(brute_search(docs, range(120), 3).items(), asked, base, strict=True):
        found, scores = shard.traverse(*held, mine, 3)
        assert sorted(zip((-np.round(scores, 6)).tolist(), found.tolist(), strict=True))[:3] == [(pytest.approx(-s, abs=2e-6), d) for d, s in want], i


def test_search_sends_queries_in_rounds(spark, monkeypatch):
    """12 shards and a query for each document: all copies at once would be 12 times the documents."""
    monkeypatch.setattr(search, "SHARD_DOCS", 5)
    monkeypatch.setattr(search, "SENT", 1, raising=False)
    rounds, put = [], search.Scratch.put
    monkeypatch.setattr(search.Scratch, "put", lambda self, df, name: (rounds.append(name), put(self, df, name))[1])
    docs = [(i, " ".join(random.Random(i).choices("abcdefghijkl", k=9))) for i in range(60)]
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    got = {}
    for r in search.top_k(frame, frame, 3).orderBy("rank").collect():
        got.setdefault(r.query_id, []).append(r.doc_id)
    assert got == {q: [i for i, _ in x] for q, x in brute_search(docs, range(60), 3).items()}
    assert rounds.count("ranked") >= 24


def test_search_gives_later_shards_the_best_of_the_first(spark, monkeypatch):
    monkeypatch.setattr(search, "SHARD_DOCS", 10)
    put, floors = search.Scratch.put, []
    monkeypatch.setattr(search.Scratch, "put", lambda self, df, name: (table := put(self, df, name), floors.extend(table.collect() if name == "floors" else ()))[0])
    docs = [(i, " ".join(random.Random(i).choices("abcdefghijkl", k=9))) for i in range(90)]
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    got = {}
    for r in search.top_k(frame, frame, 3).orderBy("rank").collect():
        got.setdefault(r.query_id, []).append((r.doc_id, r.score))
    want = brute_search(docs, range(90), 3)
    assert {q: [i for i, _ in x] for q, x in got.items()} == {q: [i for i, _ in x] for q, x in want.items()}
    assert sum(r.floor is not None for r in floors) > 60 and all(r.floor <= want[r.id][2][1] + 2e-6 for r in floors if r.floor is not None)


def test_search_with_a_floor_scores_only_what_reaches_it():
    rng = random.Random(9)
    words = [f"w{i}" for i in range(60)]
    docs = [(i, " ".join(rng.choices(words, [1 / (j + 1) for j in range(60)], k=rng.randint(1, 30)))) for i in range(400)]
    told = [search.Terms()(t) for _, t in docs]
    sizes, lengths = np.array([len(h) for h, _ in told]), np.array([int(c.sum()) for _, c in told])
    shard = search.Shard(np.concatenate([h for h, _ in told]), np.concatenate([c for _, c in told]), sizes, lengths, lengths.mean())
    assert len(shard.dense) and len(shard.postings)  # some terms by document, others by posting
    df = Counter(h for terms, _ in told for h in terms.tolist())
    scored, exact = [], shard.exact
    shard.exact = lambda places, *query: (scored.append(len(places)), exact(places, *query))[1]
    for i, want in brute_search(docs, range(0, 400, 7), 400).items():
        held = shard.held(told[i][0], np.log1p([(400 - df[x] + 0.5) / (df[x] + 0.5) for x in told[i][0].tolist()]))
        base, floor = shard.frequent([held])[0], want[min(4, len(want) - 1)][1]
        found, scores = shard.traverse(*held, base, 5, floor)
        assert sorted(zip((-np.round(scores, 6)).tolist(), found.tolist(), strict=True)) == [(pytest.approx(-s, abs=2e-6), d) for d, s in want if s >= floor], i
        assert scored.pop() <= len(found) + 2
        assert not len(shard.traverse(*held, base, 5, want[0][1] + 1)[0])


def test_search_builds_an_index_in_little_memory(monkeypatch):
    monkeypatch.setattr(search, "PART", 1 << 14, raising=False)
    rng = np.random.default_rng(4)
    vocabulary = rng.integers(-(1 << 63), (1 << 63) - 1, 30_000)
    told = [np.unique(vocabulary[(30_000 * rng.random(400) ** 3).astype(np.int64)]) for _ in range(1500)]
    terms, sizes = np.concatenate(told), np.array([len(x) for x in told])
    counts, lengths = rng.integers(1, 40, len(terms), dtype=np.int32), sizes + 7
    tracemalloc.start()
    try:
        shard = search.Shard(terms, counts, sizes, lengths, 300.0)
        kept, most = tracemalloc.get_traced_memory()
    finally:
        tracemalloc.stop()
    assert len(shard.dense) and len(shard.postings)
    assert most - shard.dense.nbytes < 34 * len(terms) and kept - shard.dense.nbytes < 16 * len(terms)


def test_search_builds_the_same_index_from_pieces(monkeypatch):
    monkeypatch.setattr(search, "PART", 50)
    monkeypatch.setattr(search, "BLOCK", 4)
    rng = np.random.default_rng(5)
    told = [np.unique(rng.integers(-90, 90, n) << 56) for n in rng.integers(0, 40, 200)]
    counts = [rng.integers(1, 300, len(x), dtype=np.int32) for x in told]
    sizes, lengths = np.array([len(x) for x in told]), np.array([int(c.sum()) for c in counts])
    edges = [0, 0, 1, 70, 200]
    pieces = [(np.concatenate([*told[a:b], told[0][:0]]), np.concatenate([*counts[a:b], counts[0][:0]]), sizes[a:b], lengths[a:b]) for a, b in zip(edges, edges[1:])]
    one, other = search.Shard(np.concatenate(told), np.concatenate(counts), sizes, lengths, 50.0), search.Shard.of(pieces, 50.0)
    assert pieces == [] and len(one.dense)
    for name, value in vars(one).items():
        if isinstance(value, np.ndarray):
            assert np.array_equal(value, getattr(other, name)), name
    assert np.array_equal(one.terms, np.unique(np.concatenate(told)))
    for i in range(0, 200, 9):
        found, scores = other.search(told[i], np.full(sizes[i], 2.0), 5)
        impact = [c * 2.2 / (c + 1.2 * (0.25 + 0.75 * n / 50)) for c, n in zip(counts, lengths, strict=True)]
        want = sorted((round(2 * float(x[np.isin(t, told[i])].sum()), 6) for t, x in zip(told, impact, strict=True)), reverse=True)[:5]
        assert sorted(scores.tolist(), reverse=True)[:5] == pytest.approx([s for s in want if s], abs=2e-6)


def test_search_sorts_terms_that_differ_in_low_bits_only():
    terms = np.array([5 << 40 | 1, 5 << 40, 7, -3, 5 << 40 | 1, 5 << 40, 6, -3], dtype=np.int64)
    assert search._by_term(terms).tolist() == np.argsort(terms, kind="stable").tolist()
    assert search._by_term(terms[:0]).tolist() == []
    assert search.Terms()("Straße ÉTÉ a_b x² \u0558\u4e00 z")[1].sum() == len(regex.findall(r"[\p{L}\p{N}]+", "straße été a_b x² \u0558\u4e00 z"))


# HTML

@pytest.mark.parametrize(
    ("page", "text"),
    [
        (None, ""), ("", ""), ("<nav><a href=x>menu</a></nav>", ""), ("plain", "plain"),
        ("<p>One &amp; two&nbsp;three<p>four <b>five</b> six</p>", "One & two three\nfour five six"),
        ("<header>site</header><nav>n</nav><article><h1>T</h1><p>a, b, c<br>d</p><aside>x</aside><form>f</form></article><footer>f</footer>", "T\na, b, c d"),
        ('<div class="ad">buy</div><div id="content"><p>Text, with commas, here.</p><ul><li>i</li><li>j</li></ul></div><div class="comments"><p>first!, really, first</p></div>', "Text, with commas, here.\ni\nj"),
        ("<article><p>a</p><script>var p='</p>';</script><style>x{}</style><!-- c --><p>b</p></article>", "a\nb"),
        ("<article><p>unclosed <b>bold<p>next <i>one</article><footer>f</footer>", "unclosed bold\nnext one"),
        ("<article><table><tr><td>a</td><td>b</td></tr><tr><td>c</td></tr></table></article>", "a b\nc"),
        ('<div hidden>h</div><div style="display: none">h</div><p>seen</p>', "seen"),
        ("<main><section><p>first part, long enough</p></section><section><p>second part</p></section></main>", "first part, long enough\nsecond part"),
        ("<p>a &lt;tag&gt; &#233; &bogus; &", "a <tag> é &bogus; &"),
        ('<p title="a > b">quoted</p>', "quoted"), ("<p title='open>broken</p>", "broken"), ("a < b and c > d", "a < b and c > d"),
    ],
)
def test_html(page, text):
    assert html_extract.extract(page) == text


def test_html_links_lose_to_prose():
    links = "".join(f'<p><a href="x">some link, with, commas {i}</a></p>' for i in range(30))
    page = f"<div><div>{links}</div><div><p>Prose that says something, and goes on, as articles do.</p><p>More of it, here.</p></div></div>"
    assert html_extract.extract(page) == "Prose that says something, and goes on, as articles do.\nMore of it, here."


def test_html_of_large_and_deep_pages():
    assert html_extract.extract("<div>" * 30_000 + "x") == "x"
    assert html_extract.extract("<p '" * 20_000 + ">y") is not None
    assert html_extract.extract("<p>" + "w " * 200_000).count("w") == 200_000


def test_html_query(spark):
    """Against an independent cut of the article element, which all fixture pages have."""
    import html as H
    import re

    pages = {r.page_id: r.html for r in spark.read.parquet(f"{DATA}/pages.parquet").collect()}
    rows = registry.QUERIES["op10_html_extract"](spark, DATA).collect()
    assert len(rows) == len(pages)
    for r in rows:
        body = re.search(r"<article>(.*?)(</article>|<footer>|$)", pages[r.page_id], re.S)[1]
        blocks = (" ".join(H.unescape(re.sub("<br>", " ", re.sub("</?b>", "", b))).split()) for b in re.split("</?(?:p|h1)>", body))
        assert r.text == "\n".join(b for b in blocks if b) and r.n_chars == len(r.text)


def test_html_nulls(spark):
    pages = spark.createDataFrame([(1, None, None), (None, "u", "<p>x"), (None, "u", "<p>x")], "page_id long, url string, html string").withColumn("text", F.lit(1))
    assert sorted(r.text for r in html_extract.main_text(pages).collect()) == ["", "x", "x"]
    assert html_extract.main_text(pages.limit(0)).count() == 0


# Chats

TALK = "conv_id long, turn long, role string, text string"


def chats(spark, rows, schemas=()):
    found = chat_format.format_chats(spark.createDataFrame(rows, TALK), spark.createDataFrame([*chat_format.ASK, *schemas], chat_format.SCHEMA))
    return sorted(found.collect(), key=lambda r: (str(r.conv_id), r.turn is None, r.turn or 0, r.call_id or ""))


def test_chat_tool_calls(spark):
    call = {"tool_calls": [
        {"id": "b", "name": "get", "arguments": {"z": 1, "a": {"y": 2, "x": [1, 2]}}, "depends_on": ["a", "none"]},
        {"id": "a", "name": "get", "arguments": '{"z": "text"}'},
        {"id": "c", "name": "get", "arguments": {"z": 2, "more": 1}, "depends_on": ["b"]},
        {"id": "d", "name": "other", "arguments": {}, "depends_on": ["e"]}, {"id": "e", "name": "get", "arguments": {}, "depends_on": ["d"]},
    ]}
    rows = chats(
        spark,
        [(1, 0, "assistant", json.dumps(call)), (1, 1, "tool", '{"tool_call_id": "a", "content": {"k": 1, "b": 2}}'), (1, 2, "tool", '{"tool_call_id": "zz", "content": "lost"}')],
        [("get", "z", "BIGINT", True), ("get", "a", "OBJECT<x: ARRAY<BIGINT>, y: BIGINT>", False)],
    )
    got = {r.call_id: r for r in rows if r.kind == "call"}
    assert {k: r.level for k, r in got.items()} == {"a": 0, "b": 1, "c": 2, "d": None, "e": None}
    assert {k: r.valid for k, r in got.items()} == {"a": False, "b": True, "c": False, "d": None, "e": False}
    assert {k: r.linked for k, r in got.items()} == {"a": True, "b": False, "c": False, "d": False, "e": False}
    assert got["b"].json == '{"arguments":{"a":{"x":[1,2],"y":2},"z":1},"call_id":"b","name":"get","role":"assistant","turn":0}'
    assert {r.call_id: (r.linked, r.linked_turn) for r in rows if r.kind == "result"} == {"a": (True, 0), "zz": (False, None)}
    assert got["a"].linked_turn == 1 and json.loads(got["a"].json)["result"] == '{"b":2,"k":1}' and got["b"].linked_turn is None
    assert json.loads(next(r.json for r in rows if r.kind == "result" and r.call_id == "a"))["content"] == '{"b":2,"k":1}'


def test_chat_content_beside_tool_calls_is_kept(spark):
    called = lambda **more: json.dumps({"tool_calls": [{"id": "a", "name": "get", "arguments": {}}, {"id": "b", "name": "get", "arguments": {}}], **more})
    rows = chats(spark, [(i, 0, "assistant", called(**more)) for i, more in enumerate([{"content": "Let me look."}, {"content": None}, {}, {"content": ""}, {"content": [{"text": "x"}]}])])
    assert len([r for r in rows if r.kind == "call"]) == 10
    said = {r.conv_id: r for r in rows if r.kind == "message"}
    assert sorted(said) == [0, 4] and said[0].json == '{"content":"Let me look.","role":"assistant","turn":0}' and not said[0].linked
    assert json.loads(said[4].json)["content"] == '[{"text":"x"}]'


def test_chat_edge_cases(spark):
    rows = chats(spark, [(1, 0, "system", "s"), (1, 1, "user", None), (1, 2, "assistant", "{not json"), (1, 4, "assistant", "x"), (2, 0, "user", ""), (2, 0, "user", ""), (None, 0, "user", "q"), (3, None, "user", "q"), (4, 0, None, "n")])
    assert len(rows) == 9
    by = {(r.conv_id, r.turn): r for r in rows}
    assert (by[1, 1].valid, by[1, 1].linked, by[1, 1].position) == (False, True, 1)
    assert (by[1, 2].kind, by[1, 2].linked, by[1, 2].position) == ("result", True, 2)
    assert (by[1, 4].linked, by[1, 4].position) == (False, 0)
    assert by[2, 0].valid and not by[2, 0].linked and by[None, 0].position is None and by[3, None].position is None and by[4, 0].kind == "message"
    assert by[1, 0].json == '{"content":"s","role":"system","turn":0}'
    assert chats(spark, []) == []


def test_chat_positions_of_a_long_conversation(spark):
    turns = spark.createDataFrame([(1, i) for i in range(700) if i != 300] + [(2, 5)], "conv_id long, turn long")
    got = {(r.conv_id, r.turn): r.position for r in chat_format.positions(turns, Scratch(spark, "test")).collect()}
    assert all(got[1, i] == (i if i < 300 else i - 301) for i in range(700) if i != 300) and got[2, 5] == 0


def test_chat_results_meet_calls_in_a_hash_join(spark):
    frame = spark.createDataFrame([(1, 0, "user", "q"), (1, 1, "assistant", "a")], TALK)
    plan = chat_format.linked(chat_format.nodes(frame))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ShuffledHashJoin") >= 2


def brute_levels(deps):
    """The longest path below each call; None on and above circles."""
    level = {c: 0 for c, d in deps.items() if not d}
    while more := {c: 1 + max(level[x] for x in d) for c, d in deps.items() if c not in level and all(x in level for x in d)}:
        level |= more
    return {c: level.get(c) for c in deps}


def test_chat_levels_of_chains_joints_and_circles(spark):
    rnd = random.Random(4)
    deps = {f"c{i}": [f"c{i - 1}"] if i else [] for i in range(1000)}
    deps |= {f"d{i}": rnd.sample([f"d{j}" for j in range(i)], min(i, rnd.choice([0, 1, 1, 2, 3]))) for i in range(60)}
    deps |= {"x": ["y"], "y": ["z"], "z": ["x"], "above": ["x"], "joint": ["above", "c5"], "self": ["self"], "top": ["joint"]}
    calls = spark.createDataFrame([(1, c, d) for c, d in deps.items()] + [(2, "c1", ["c0", "gone"]), (2, "c0", None)], "conv_id long, call_id string, depends_on array<string>")
    puts = []

    class Counted(Scratch):
        def put(self, df, name):
            puts.append(name)
            return super().put(df, name)

    got = {(r.conv_id, r.call_id): r.level for r in chat_format.levels(calls, Counted(spark, "test")).collect()}
    assert got == {(1, c): n for c, n in brute_levels(deps).items()} | {(2, "c0"): 0, (2, "c1"): 1}
    assert puts.count("jumps") <= 12
