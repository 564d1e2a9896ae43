from datetime import datetime, timedelta

import pytest

from atlaskb.operators import crawl, embedding, evaluation, store, telemetry
from atlaskb.plans import log_queries

ROW = "chunk_id string, source string, title string, doc_type string, chunk_index int, text string, embedding array<float>"


def rows(spark, *found):
    return spark.createDataFrame([(i, s, t, "html", k, t, [3.0, 4.0]) for i, s, t, k in found], ROW)


def test_upsert_is_idempotent_and_the_last_of_a_batch_wins(spark):
    old = rows(spark, ("a", "s", "old", 0), ("b", "s", "keep", 1))
    batch = rows(spark, ("a", "s", "new", 0), ("c", "s", "one", 0), ("c", "s", "two", 1))
    once = store.upsert(old, batch)
    got = {r.chunk_id: r for r in once.collect()}
    assert {k: r.title for k, r in got.items()} == {"a": "new", "b": "keep", "c": "two"}
    assert [round(x, 4) for x in got["a"].embedding] == [0.6, 0.8]
    assert sorted(map(str, store.upsert(once, batch).collect())) == sorted(map(str, once.collect()))
    assert tuple(store.inserted(old, batch).first()) == (1, 1)


def test_sources(spark):
    held = rows(spark, ("a", "u1", "x", 0), ("b", "u1", "y", 1), ("c", "u2.PDF", "z", 0))
    assert [r.source for r in store.stale_sources(held, spark.createDataFrame([("u3",)], "url string")).collect()] == ["u1"]
    assert store.remove_sources(held, spark.createDataFrame([("u1",)], "source string")).count() == 1
    shrunk = store.replace_sources(held, rows(spark, ("a", "u1", "x", 0)))
    assert sorted(r.chunk_id for r in shrunk.collect()) == ["a", "c"]
    assert store.top_source(held, "chunk_id").first().asDict() == {"source": "u1", "title": "x", "chunks": 2}


def test_crawl_state(spark):
    state = spark.createDataFrame([("a", "1", "t0", "A", "fa", True), ("b", "2", "t0", "B", "fb", True), ("gone", "3", "t0", "C", "fc", False)], "url string, hash string, last_crawled string, title string, file string, changed boolean")
    found = spark.createDataFrame([("a", "1", "A2", "fa2"), ("b", "9", "B2", "fb2"), ("n", "5", "N", "fn")], "url string, hash string, title string, file string")
    got = {r.url: r for r in crawl.merge_state(state, found, "t1").collect()}
    assert set(got) == {"a", "b", "n"}
    assert (got["a"].changed, got["a"].last_crawled, got["a"].title) == (False, "t0", "A")
    assert (got["b"].changed, got["b"].last_crawled, got["b"].title) == (True, "t1", "B2")
    assert [r.url for r in crawl.removed(state, found).collect()] == ["gone"]


def test_closure_stops_on_circles_and_limits(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("c", "d"), ("x", "y")], "src string, dst string")
    seeds = spark.createDataFrame([("a",)], "url string")
    depths = lambda **k: {r.url: r.depth for r in crawl.closure(edges, seeds, **k).collect()}
    assert depths() == {"a": 0, "b": 1, "c": 2, "d": 3}
    assert depths(max_depth=1) == {"a": 0, "b": 1}
    assert depths(max_pages=3) == {"a": 0, "b": 1, "c": 2}


def test_embedding_survives_a_failing_service(spark):
    def shaky(texts):
        if len(texts) > 1 or "bad" in texts[0]:
            raise OSError("refused")
        return [[float(len(t)), 0.0] for t in texts]

    df = spark.createDataFrame([("ab",), ("bad",), (None,)], "text string")
    got = {r.text: list(r.embedding) for r in embedding.embed(df, shaky, 2).collect()}
    assert got == {"ab": [2.0, 0.0], "bad": [0.0, 0.0], None: [0.0, 0.0]}
    v = embedding.hashing_embedder(16)(["a b", ""])
    assert abs(sum(x * x for x in v[0]) - 1) < 1e-9 and not any(v[1])


def test_evaluation(spark):
    cases = spark.createDataFrame([(1, ["one", "two"], 1), (2, [], 1)], "query_id long, expected_keywords array<string>, min_chunks int")
    hits = spark.createDataFrame([(1, "s"), (1, "s"), (1, "t")], "query_id long, source string")
    answers = spark.createDataFrame([(1, "Only ONE", 10), (2, "x", 30)], "query_id long, answer string, elapsed_ms int")
    found = evaluation.results(cases, hits, answers)
    got = {r.query_id: r for r in found.collect()}
    assert (got[1].chunks, got[1].keyword_score, got[1].passed) == (2, 0.5, True)
    assert (got[2].retrieval_ok, got[2].keyword_score) == (False, 1.0)
    assert evaluation.summary(found).first().asDict() == {"retrieval_ok": 1, "cases": 2, "mean_keyword_score": 0.75, "mean_elapsed_ms": 20.0}


def test_lru_cache():
    assert telemetry.lru_hits(["a", "b", "a", "c", "b", "a"], 2) == [False, False, True, False, False, False]


def test_crawl_history(spark):
    lines = ["=== Crawl x ===", "2024-01-02 03:04:05,678 [INFO] Vector store caricato: 1200 chunk", "2024-01-02 03:05:05,678 [INFO] [HTML 2/2] u", "2024-01-02 03:06:05,678 [INFO] Vector store caricato: 1200 chunk", "2024-01-02 03:07:05,678 [INFO] [PDF 1/4] u", "=== Crawl y ==="]
    log = spark.createDataFrame(list(enumerate(lines)), "line_no long, line string")
    assert [(r.ts, r.type, r.label) for r in telemetry.crawl_history(log).collect()] == [
        ("", "crawl_end", "Crawl HTML completato"), ("2024-01-02 03:04", "vs_loaded", "Vector store: 1,200 chunk"),
        ("2024-01-02 03:05", "html_done", "HTML: 2 pagine completate"), ("2024-01-02 03:07", "crawl_end", "Crawl HTML completato"),
    ]
    assert {(r.kind, r.current, r.total) for r in telemetry.crawl_progress(log).collect()} == {("html", 2, 2), ("pdf", 1, 4)}


def test_crawl_queries_read_the_whole_log(spark, tmp_path, monkeypatch):
    """More than 2,000 events, against a sequential pass."""
    monkeypatch.setattr(telemetry, "RANGE", 7, raising=False)
    spark.range(2600).selectExpr("id AS event_id", "timestamp_seconds(1704067200 + id * 60) AS ts").write.parquet(f"{tmp_path}/events.parquet")
    ts, met, shown, seen = "", set(), [], {}
    for i in range(2600):
        if i % 5 != 1:
            ts = (datetime(2024, 1, 1) + timedelta(minutes=i)).strftime("%Y-%m-%d %H:%M")
        if i % 5 == 0 and i % 70 * 100 not in met:
            met.add(i % 70 * 100)
            shown.append((i, ts, "vs_loaded", f"Vector store: {i % 70 * 100:,} chunk"))
        elif i % 5 == 1:
            shown.append((i, ts, "crawl_end", "Crawl HTML completato"))
        elif i % 10 == 2:
            shown.append((i, ts, "html_done", f"HTML: {i:,} pagine completate"))
        if i % 5 in (2, 3):
            seen["pdf" if i % 5 == 3 else "html"] = (ts, i, i if i % 10 == 2 else 99999)
    assert [tuple(r) for r in log_queries.crawl_history(spark, str(tmp_path)).collect()] == shown[-20:]
    assert {r.kind: (r.ts, r.current, r.total) for r in log_queries.crawl_progress(spark, str(tmp_path)).collect()} == seen


def test_stamps_are_carried_over_ranges_without_any(spark, monkeypatch):
    monkeypatch.setattr(telemetry, "RANGE", 10, raising=False)
    stamp = "2024-01-01 0{}:00:00,000 [INFO] [PDF 1/2]"
    log = spark.createDataFrame([(1, "=== Crawl"), (4, stamp.format(1)), (37, "=== Crawl"), (58, "=== Crawl"), (59, stamp.format(2)), (60, "=== Crawl")], "line_no long, line string")
    assert sorted((r.line_no, r.ts) for r in telemetry.crawl_events(log).collect()) == [(1, ""), (4, "2024-01-01 01:00"), (37, "2024-01-01 01:00"), (58, "2024-01-01 01:00"), (59, "2024-01-01 02:00"), (60, "2024-01-01 02:00")]
    # A line without a marker is no event, and its stamp doesn't count.
    noise = spark.createDataFrame([(1, "2024-01-01 05:00:00,000 [INFO] nothing"), (2, "=== Crawl")], "line_no long, line string")
    assert [(r.line_no, r.ts) for r in telemetry.crawl_events(noise).collect()] == [(2, "")]


def test_questions_are_counted_and_cached_whole(spark, tmp_path):
    said = [
        (1, 1, "user", "How do I reach the office?"), (1, 2, "assistant", "By bus."), (1, 3, "user", "how do I  reach the office"), (2, 1, "user", "How do I reach the bank?"),
        (3, 1, "user", " how do I reach the bank? "), (4, 1, "user", "How do I reach the office?"), (5, 1, "user", "How do I pay?"),
    ]
    spark.createDataFrame(said, "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    assert [tuple(r) for r in log_queries.query_freq(spark, str(tmp_path)).collect()] == [("how do i reach the office", 3), ("how do i reach the bank", 2), ("how do i pay", 1)]
    assert tuple(log_queries.cache_hits(spark, str(tmp_path)).first()) == (6, 2)


def test_upsert_refuses_another_dimension(spark):
    old = rows(spark, ("a", "s", "old", 0))
    assert store.upsert(old, old, dim=2).count() == 1
    with pytest.raises(Exception, match="dimension"):
        store.upsert(old, old, dim=3).collect()
