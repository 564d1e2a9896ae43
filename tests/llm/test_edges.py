"""Queries against plain Python where SQL can't express them, and rows that are long, repeated or oddly named."""

import json
import math
import re
import zlib
from collections import Counter, defaultdict

import corpus_pipeline
import numpy as np
import public_tokenizers as P
import pytest
import regex
import xxhash
from pyspark.sql import functions as F

from atlaskb.llm import byte_bpe, chat_format, exact_dedup, html_extract, language_id, minhash_dedup, packing, registry, search, suffix_dedup, toxicity

from ..oracle import DATA
from .test_dedup import brute_components, table

LARGER = "/root/testdata/sf0.01"
LONG = "The council met, once more, and nothing came of it. " * 40_000


def rows_by_id(df, *columns):
    return {r.doc_id: tuple(r[c] for c in columns) for r in df.collect()}


def documents(spark, folder=DATA):
    return spark.read.parquet(f"{folder}/documents.parquet")


# The registered queries

def test_toxicity_query_against_plain_python(spark):
    docs, labels = documents(spark), spark.read.parquet(f"{DATA}/labels.parquet")
    model = toxicity.train(docs, labels)
    weight = dict(zip(model.features.tolist(), model.weights.tolist(), strict=True))
    got = rows_by_id(registry.QUERIES["op6_toxicity"](spark, DATA), "probability", "expected_grade", "toxic")
    texts = {r.doc_id: r.text for r in docs.collect()}
    assert got.keys() == texts.keys() and any(g[2] for g in got.values()) and not all(g[2] for g in got.values())
    for i, text in texts.items():
        words = set(regex.findall(r"[\p{L}\p{N}']+", (text or "").lower()))
        features = Counter(f for w in words for f in [w, *(w[:n] + "\t" for n in (4, 5) if len(w) > n)])
        score = sum(n * weight.get(xxhash.xxh3_64_intdigest(f), 0.0) for f, n in features.items())
        # Grades at most k have the share sigmoid(threshold_k - score), with one score for all thresholds.
        at_most = [1 / (1 + math.exp(-max(-60, min(60, t - score)))) for t in model.thresholds]
        shares = [b - a for a, b in zip([0.0, *at_most], [*at_most, 1.0], strict=True)]
        assert got[i][1] == pytest.approx(sum(k * s for k, s in enumerate(shares)), abs=1e-9)
        assert got[i][0] == pytest.approx(1 - at_most[0], abs=1e-9) and got[i][2] == (bool(text) and got[i][0] >= 0.5)


def test_toxicity_on_labels_it_was_not_trained_on(spark):
    docs, labels = documents(spark, LARGER), spark.read.parquet(f"{LARGER}/labels.parquet")
    model = toxicity.train(docs, labels.where("doc_id % 3 <> 0"))
    got = rows_by_id(toxicity.score(docs, model), "toxic")
    held = [(got[r.doc_id][0], r.toxic == 1) for r in labels.where("doc_id % 3 = 0").collect()]
    toxic, clean = [g for g, t in held if t], [g for g, t in held if not t]
    assert sum(toxic) >= 0.9 * len(toxic) and sum(clean) <= 0.02 * len(clean)


def test_language_query_against_plain_python(spark):
    rows = documents(spark).select("doc_id", "text", "lang").collect()
    pack = lambda g: sum(ord(c) << 21 * (len(g) - 1 - i) for i, c in enumerate(g))

    def ranked(texts):
        counts = Counter()
        for text in texts:
            for w in regex.findall(r"\p{L}+", (text or "").lower()):
                padded = f"_{w}_"
                counts.update(padded[i : i + n] for n in (1, 2, 3) for i in range(len(padded) - n + 1) if padded[i : i + n] != "_")
        return sorted(counts, key=lambda g: (-counts[g], pack(g)))[: language_id.TOP]

    held = {r.doc_id: zlib.crc32(str(r.doc_id).encode()) % 5 == 0 for r in rows}
    by_lang = defaultdict(list)
    for r in rows:
        if not held[r.doc_id] and r.lang is not None:
            by_lang[r.lang].append(r.text)
    profiles = {lang: {g: i for i, g in enumerate(ranked(texts))} for lang, texts in by_lang.items()}
    got = rows_by_id(registry.QUERIES["op7_language_id"](spark, DATA), "held_out", "lang_pred", "score")
    assert got.keys() == held.keys()
    for r in rows:
        mine = ranked([r.text])
        distance = {lang: sum(min(abs(p[g] - i), language_id.TOP) if g in p else language_id.TOP for i, g in enumerate(mine)) for lang, p in profiles.items()}
        best = min(sorted(distance), key=distance.get)
        want = (best, 1 - distance[best] / (language_id.TOP * len(mine))) if mine else ("und", 0.0)
        assert got[r.doc_id][:2] == (held[r.doc_id], want[0]) and got[r.doc_id][2] == pytest.approx(want[1])


def test_near_duplicates_lose_no_link(spark):
    """Every link at the limit or above among all pairs of a thousand documents, those near the limit too."""
    texts = [(r.doc_id, r.text) for r in documents(spark, LARGER).collect()]
    for words, percent in ((3, 85), (5, 80)):
        want = brute_components(texts, words, percent)
        got = {r.doc_id: (r.n_shingles, r.component_id) for r in minhash_dedup.components(documents(spark, LARGER), words, percent).collect()}
        assert got == want and len({c for _, c in want.values()}) < len(want)


# Very long texts

def test_very_long_texts(spark):
    docs = table(spark, [(1, LONG), (2, LONG + " "), (3, LONG[: len(LONG) // 2]), (4, "short")])
    got = rows_by_id(exact_dedup.mark(docs), "keep_id", "group_size")
    assert got == {1: (2, 2), 2: (2, 2), 3: (3, 1), 4: (4, 1)}
    near = rows_by_id(minhash_dedup.components(docs, 3, 85), "component_id")
    assert near == {1: (1,), 2: (1,), 3: (1,), 4: (4,)}
    cut = rows_by_id(suffix_dedup.digest(docs), "n_bytes", "n_removed")
    # Of the second, the blank that only it ends with stays.
    assert cut[1] == (len(LONG), len(LONG)) and cut[2] == (len(LONG) + 1, len(LONG)) and cut[3][0] == cut[3][1] and cut[4] == (5, 0)
    profiles = language_id.train(docs)
    assert rows_by_id(language_id.predict(docs, profiles), "lang_pred")[1] == ("en",)
    model = toxicity.train(docs, spark.createDataFrame([(1, 0), (4, 1)], "doc_id long, toxic int"))
    assert rows_by_id(toxicity.score(docs, model), "toxic").keys() == {1, 2, 3, 4}
    found = search.top_k(docs, docs.where("doc_id = 1"), 2).orderBy("rank").collect()
    assert [r.doc_id for r in found] == [1, 2]
    rows = packing.pack(docs.where("doc_id IN (1, 4)"), P.path("word_bpe_49k.json")).collect()
    assert sum(r.length for r in rows) == sum({r.doc_id: r.doc_tokens for r in rows}.values()) > 400_000
    coded = byte_bpe.encode(docs.where("doc_id = 1"), P.path("byte_bpe_50k.tiktoken")).first()
    assert bytes(coded.decoded) == LONG.encode()


def test_very_long_turns_and_pages(spark):
    talk = spark.createDataFrame([(1, 0, "user", LONG), (1, 1, "assistant", LONG)], "conv_id long, turn long, role string, text string")
    rows = {r.turn: r for r in chat_format.format_chats(talk, spark.createDataFrame(chat_format.ASK, chat_format.SCHEMA)).collect()}
    call = json.loads(rows[0].json)
    assert rows[0].linked and rows[0].valid and rows[0].linked_turn == 1 and call["arguments"]["text"] == call["result"] == LONG
    page = html_extract.extract(f"<nav>x</nav><div>{''.join(f'<p>{LONG[:400]}</p>' for _ in range(3000))}</div>")
    assert page.count("\n") == 2999


# Clashing names, repeated rows, ties

def test_chat_with_clashing_columns_and_repeats(spark):
    rows = [(1, 0, "user", "q"), (1, 0, "user", "q"), (1, 1, "assistant", "a"), (1, 1, "assistant", "b"), (1, 1, "assistant", "a")]
    talk = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    for name in ("kind", "call_id", "json", "level", "position", "calls", "result", "to", "valid", "linked"):
        talk = talk.withColumn(name, F.lit("x"))
    got = chat_format.format_chats(talk, spark.createDataFrame(chat_format.ASK, chat_format.SCHEMA)).collect()
    assert len(got) == 5 and all(r.linked for r in got) and {json.loads(r.json).get("result") for r in got if r.kind == "call"} == {"a"}


def test_operators_with_clashing_columns_and_repeats(spark):
    docs = table(spark, [(5, "one two three four five six"), (5, "one two three four five six"), (6, None), (None, "")])
    for name in ("row", "text_hash", "key", "shard", "query", "tokens", "score", "lang_pred", "probability", "digest", "best", "bands", "node", "runs", "cuts", "text_"):
        docs = docs.withColumn(name, F.lit(1))
    model = toxicity.train(docs, spark.createDataFrame([(5, 1)], "doc_id long, toxic int"))
    assert toxicity.score(docs, model).count() == 4
    assert language_id.predict(docs, language_id.train(docs)).count() == 4 and language_id.filter_rejects(docs, 0.1).columns == docs.columns
    assert len(search.top_k(docs, docs, 3).collect()) == 4  # two queries find two rows each
    packed = packing.pack(docs, P.path("word_bpe_49k.json")).collect()
    tokens = {r.doc_id: r.doc_tokens for r in packed}
    assert sum(r.length for r in packed) == 2 * tokens[5] + tokens[6] + tokens[None] and tokens[6] == tokens[None] == 1
    assert byte_bpe.encode(docs, P.path("byte_bpe_50k.tiktoken")).count() == 4
    assert suffix_dedup.clean(docs, 10).columns == docs.columns and minhash_dedup.dedup(docs).columns == docs.columns and exact_dedup.dedup(docs).columns == docs.columns


def test_html_ties_go_to_the_first(spark):
    block = "<p>One sentence, of some length, that says as much as the other one does.</p>"
    assert html_extract.extract(f"<table><tr><td><div><p>First, {block[3:]}</div></td><td><div><p>Other, {block[3:]}</div></td></tr></table>").startswith("First, ")


def test_stages_carry_further_columns(spark):
    english = "the of and to in that is was for with as on be at by this had not are but from".split()
    texts = [(i, " ".join(english[(i * 7 + j * (i + 3)) % len(english)] + ["", "s", "ing"][(i + j) % 3] for j in range(60))) for i in range(12)]
    docs = table(spark, [*texts, texts[0], (90, LONG), (91, None)])
    for name in ("digest_", "dropped_", "near_id_", "near_hash_", "cuts_", "row", "key", "kept", "component_id"):
        docs = docs.withColumn(name, F.lit(name))
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        path = f"{spark.conf.get('spark.checkpoint.dir')}/carried-{name}"
        stage(spark, docs, "").write.parquet(path)
        docs = spark.read.parquet(path)
        assert docs.columns == columns and not docs.isEmpty(), name
    assert docs.where("near_id_ <> 'near_id_' OR cuts_ <> 'cuts_'").isEmpty()
    left = {r.doc_id: r.text for r in docs.collect()}
    # Of the repetitive text the first round of its passage stays, which is shorter than a passage.
    assert 91 not in left and all(i in left for i, _ in texts) and (90 not in left or len(left[90]) < len(LONG))
    assert corpus_pipeline.STAGES[-1][1](spark, docs, "").count() >= len(left)


def test_stages_do_not_need_n_chars(spark):
    docs = table(spark, [(1, "a" * 600), (2, "b " + "a" * 600), (3, re.sub("x", "", "left"))]).drop("n_chars")
    got = rows_by_id(dict(corpus_pipeline.STAGES)["suffix_dedup"](spark, docs, ""), "text")
    assert got[3] == ("left",) and got[2] == ("b ",)


def test_search_scores_do_not_depend_on_blocks(spark, monkeypatch):
    """Documents of several kinds, so that whole blocks are skipped."""
    rng = np.random.default_rng(7)
    words = [[f"{kind}{i}" for i in range(300)] for kind in "abc"]
    docs = [(i, " ".join(rng.choice(words[i % 3], size=40, p=(w := 1 / np.arange(1, 301)) / w.sum()))) for i in range(900)]
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    found = {}
    for block, growth in ((8, 1), (64, 5)):
        monkeypatch.setattr(search, "BLOCK", block)
        monkeypatch.setattr(search, "GROWTH", growth)
        found[block] = sorted((r.query_id, r["rank"], r.doc_id, r.score) for r in search.top_k(frame, frame.where("doc_id % 50 = 0"), 10).collect())
    assert found[8] == found[64] and len(found[8]) == 18 * 10


def test_search_skips_blocks():
    rng = np.random.default_rng(1)
    terms, counts, sizes = [], [], []
    for i in range(2000):
        own = np.unique(rng.integers(0, 40, 30) + 1000 * (i % 4))
        terms.append(own)
        counts.append(np.where(own == own[0], 9, rng.integers(1, 4, len(own))))
        sizes.append(len(own))
    shard = search.Shard(np.concatenate(terms), np.concatenate(counts), np.array(sizes), np.array([c.sum() for c in counts]), 60.0)
    seen = []
    gather = shard._add
    shard._add = lambda t, w, chosen, out: (seen.extend(chosen.tolist()), gather(t, w, chosen, out))
    docs, scores = shard.search(terms[5], np.full(sizes[5], 2.0), 5)
    assert len(set(seen)) < shard.blocks / 2
    weight = dict.fromkeys(terms[5].tolist(), 2.0)
    want = np.array([sum(weight.get(t, 0) * c * 2.2 / (c + 1.2 * (0.25 + 0.75 * n.sum() / 60.0)) for t, c in zip(x.tolist(), n.tolist(), strict=True)) for x, n in zip(terms, counts, strict=True)])
    assert np.allclose(np.sort(scores)[-5:], np.sort(want)[-5:]) and np.allclose(want[docs], scores)
