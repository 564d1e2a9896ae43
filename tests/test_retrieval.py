import math

from atlaskb.config import Settings
from atlaskb.operators import retrieval, search

CHUNKS = [("c1", "alpha beta beta", "Alpha", "s1", "pagina", [1.0, 0.0]), ("c2", "alpha gamma", "Gamma", "s1", "servizio", [0.8, 0.6]), ("c3", "delta", "Delta", "s2", "pagina", [0.0, 1.0]), ("c4", " delta ", "Delta", "s3", "pagina", [0.0, 1.0])]


def tables(spark, *asked):
    chunks = spark.createDataFrame(CHUNKS, "chunk_id string, text string, title string, source string, category string, embedding array<float>")
    return chunks, spark.createDataFrame(list(asked), "query_id long, question string, vector array<float>")


def model_bm25(question: str) -> dict[str, float]:
    """BM25 in plain Python."""
    docs = {c[0]: c[1].split() for c in CHUNKS}
    n, mean = len(docs), sum(map(len, docs.values())) / len(docs)
    df = {t: sum(t in d for d in docs.values()) for d in docs.values() for t in d}
    raw = {t: math.log(n - k + 0.5) - math.log(k + 0.5) for t, k in df.items()}
    idf = {t: v if v >= 0 else 0.25 * sum(raw.values()) / len(raw) for t, v in raw.items()}
    out = {}
    for c, d in docs.items():
        hit = [t for t in question.split() if t in d]
        if hit:
            out[c] = sum(idf[t] * d.count(t) * 2.5 / (d.count(t) + 1.5 * (0.25 + 0.75 * len(d) / mean)) for t in hit)
    return out


def test_bm25_counts_repeated_query_terms(spark):
    chunks, queries = tables(spark, (1, "alpha beta beta nowhere", [1.0, 0.0]))
    got = {r.chunk_id: r.score for r in search.bm25(search.build_index(chunks), queries, Settings()).collect()}
    want = model_bm25("alpha beta beta nowhere")
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-6 for k in got)


def test_hybrid_ranks_by_fused_rank_and_returns_the_cosine(spark):
    chunks, queries = tables(spark, (1, "gamma", [1.0, 0.0]), (2, "123", [0.0, 1.0]))
    got = {(r.query_id, r["rank"]): r for r in search.hybrid(chunks, queries, Settings(), 3).collect()}
    # Cosine order c1 c2 c3 c4; BM25 order c2 c1 c3 c4.
    assert [got[1, i].chunk_id for i in (1, 2, 3)] == ["c2", "c1", "c3"]
    assert abs(got[1, 1].rrf - (0.4 / 62 + 0.6 / 61)) < 1e-8 and abs(got[1, 1].score - 0.8) < 1e-6
    # A question without tokens has no BM25 part.
    assert [got[2, i].chunk_id for i in (1, 2, 3)] == ["c3", "c4", "c2"] and abs(got[2, 1].rrf - 0.4 / 61) < 1e-8


def test_retrieve_dedups_filters_and_reranks(spark):
    chunks, queries = tables(spark, (1, "alpha gamma", [0.9, 0.5]))
    got = retrieval.retrieve(chunks, queries, Settings(top_k=3)).orderBy("position").collect()
    # c4 repeats c3's text but for white space; the best stays first.
    assert [r.title for r in got] == ["Gamma", "Alpha", "Delta"] and got[2].source == "s2"


def test_known_facts_come_first_and_hide_their_source(spark):
    chunks, queries = tables(spark, (1, "alpha here", [1.0, 0.0]))
    facts = spark.createDataFrame([(0, ["alpha", "x"], ["here"], "fact text", "Fact", "s1", "pagina"), (1, ["alpha"], ["zzz"], "no", "No", "", "pagina")], "ord int, keywords array<string>, require_any array<string>, text string, title string, source string, category string")
    got = retrieval.retrieve(chunks, queries, Settings(), facts=facts).orderBy("position").collect()
    assert got[0].title == "Fact" and got[0].score == 1.0 and all(r.source != "s1" for r in got[1:])


def test_zero_vectors_fall_back(spark):
    chunks, queries = tables(spark, (1, "delta", [0.0] * 2))
    assert [r.title for r in retrieval.retrieve(chunks, queries, Settings()).orderBy("position").collect()][0] == "Delta"
    assert retrieval.retrieve(chunks, queries, Settings(), known_bug=True).count() == 0


def test_rerank_penalises_repeats_and_keeps_ties(spark):
    hits = spark.createDataFrame([(1, 1, 0.5, "t", "s", "p"), (1, 2, 0.5, "t", "s", "p"), (1, 3, 0.5, "x", "r", "servizio"), (1, 4, 0.5, "t", "q", "p")], "query_id long, rank int, score double, title string, source string, category string")
    queries = spark.createDataFrame([(1, "hello", [1.0])], "query_id long, question string, vector array<float>")
    got = retrieval.rerank(hits, queries, Settings()).orderBy("position").collect()
    assert [r["rank"] for r in got] == [3, 1, 4, 2] and abs(got[3].rscore - 0.45) < 1e-9


def test_context_and_prompt(spark):
    hits = spark.createDataFrame([(1, 2, "b", "T2", "s2", "", "2024-01-01"), (1, 1, "a", "T1", "s1", "servizio", None)], "query_id long, position int, text string, title string, source string, category string, date string")
    text = retrieval.context_block(hits).first().context
    assert text == "[Fonte 1: T1 — tipo=servizio — s1]\na\n\n---\n\n[Fonte 2: T2 — aggiornato=2024-01-01 — s2]\nb"
    queries = spark.createDataFrame([(1, "where is the office", None), (2, "dove", None)], "query_id long, question string, vector array<float>")
    offices = spark.createDataFrame([(1, ["dove"], "Second", "/2"), (0, ["dov"], "First", "/1")], "ord int, keywords array<string>, name string, url string")
    history = spark.createDataFrame([(1, i, "user", str(i)) for i in range(8)] + [(1, 99, "system", "no")], "query_id long, turn int, role string, content string")
    got = {r.query_id: r.messages for r in retrieval.prompts(queries, retrieval.context_block(hits), offices, history, "IT", "EN", Settings()).collect()}
    assert [m.content for m in got[1]][:-1] == ["EN", "2", "3", "4", "5", "6", "7"] and "DOMANDA: where" in got[1][-1].content
    assert got[2][0].content == "IT" and "**First** — /1" in got[2][1].content
