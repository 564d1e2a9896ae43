"""Queries on search and retrieval over documents and their vectors."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import ENGLISH, ITALIAN, TOKEN_LETTERS, Settings
from ..functions import text as T
from ..functions.vectors import starts_with_zeros
from ..operators import evaluation, retrieval, search

S = Settings(site_url="https://www.example.org")
#: query_id, question, the vector's vec_id
ASKED = [
    (1, "what are the opening hours of the office and where", 7),
    (2, "Dove posso chiedere la carta identità? the of and", 21),
    (3, "de la que en el cion", 35),
    (4, "der die und ein lich keit", 49),
    (5, "Quando apre il municipio? thing tion er the in", 63),
]
SYNONYMS = [(0, "carta identità", ["documento identità", "CIE"]), (1, "cie", ["carta identità"]), (2, "orari", ["orario", "apertura"]), (3, "office", ["desk", "the counter"]), (4, "municipio", ["comune", "sede"])]
OFFICES = [(0, ["residenza", "carta identità"], "Registry", "https://www.example.org/registry"), (1, ["hours", "office", "que"], "Front desk", "https://www.example.org/desk"), (2, ["municipio", "dove"], "Town hall", "https://www.example.org/hall")]
FACTS = [
    (0, ["office", "opening", "hours", "where"], ["where", "hours"], "Open from nine to one.", "Opening hours", "src7/en", "pagina"),
    (1, ["municipio", "quando", "dove"], ["municipio"], "Piazza Grande 1.", "Address", "https://www.example.org/hall", "pagina"),
]


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/embeddings.parquet")


def doc_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents(spark, sf_dir).select(F.col("doc_id").alias("chunk_id"), "text")


def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with a vector as chunks."""
    docs = documents(spark, sf_dir).select(
        F.col("doc_id").alias("chunk_id"), "text", F.concat_ws("/", "source", "lang").alias("source"), F.substring("text", 1, 40).alias("title"),
        F.when(F.col("doc_id") % 3 == 0, "servizio").otherwise("pagina").alias("category"),
    )
    return docs.join(embeddings(spark, sf_dir).select(F.col("vec_id").alias("chunk_id"), "embedding"), "chunk_id")


def asked(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.createDataFrame(ASKED, "query_id long, question string, vec_id long")
    return rows.join(embeddings(spark, sf_dir).select("vec_id", F.col("embedding").alias("vector")), "vec_id").drop("vec_id")


def synonyms(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(SYNONYMS, "ord int, term string, synonyms array<string>")


def offices(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(OFFICES, "ord int, keywords array<string>, name string, url string")


def facts(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(FACTS, "ord int, keywords array<string>, require_any array<string>, text string, title string, source string, category string")


def bm25_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = search.bm25(search.build_index(doc_chunks(spark, sf_dir)), spark.createDataFrame(ASKED, "query_id long, question string, vec_id long"), S)
    return search.top(found, 10).select("query_id", F.col("rank").cast("long").alias("rank"), "chunk_id", "score")


def bm25_stored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same ranking from an index that was written before."""
    from ..operators.crawl import scratch

    root = scratch(spark, "index")
    search.save_index(search.build_index(doc_chunks(spark, sf_dir)), root)
    found = search.bm25(search.load_index(spark, root), spark.createDataFrame(ASKED, "query_id long, question string, vec_id long"), S)
    return search.top(found, 10).select("query_id", F.col("rank").cast("long").alias("rank"), "chunk_id", "score")


def bm25_corpus_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    tok = search.tokenized(doc_chunks(spark, sf_dir))
    terms = search.term_stats(tok).agg(F.count(F.lit(1)).alias("n_terms"), F.sum("df").alias("postings"), F.max("df").alias("max_df"))
    return search.corpus_stats(tok).select("n_docs", F.round("avgdl", 6).alias("avgdl")).crossJoin(F.broadcast(terms))


def term_df_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = search.build_index(doc_chunks(spark, sf_dir))
    weighed = search.weighed(index.terms, index.corpus, S)
    return weighed.orderBy(F.desc("df"), "term").limit(50).select("term", "df", F.round("idf", 6).alias("idf"))


def vector_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    store = embeddings(spark, sf_dir).select(F.col("vec_id").alias("chunk_id"), "embedding")
    one = asked(spark, sf_dir).where("query_id = 1")
    return search.cosines(store, one).orderBy(F.desc("score"), "chunk_id").limit(7).select("chunk_id", "score")


def vector_topk_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    store = embeddings(spark, sf_dir).select(F.col("vec_id").alias("chunk_id"), "embedding")
    return search.top(search.cosines(store, asked(spark, sf_dir)), 10).select("query_id", F.col("rank").cast("long").alias("rank"), "chunk_id", "score")


def hybrid_rrf(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = search.hybrid(chunks(spark, sf_dir), asked(spark, sf_dir), S, 21)
    return found.select("query_id", F.col("rank").cast("long").alias("rank"), "chunk_id", "rrf", "score")


def _hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = search.hybrid(chunks(spark, sf_dir), asked(spark, sf_dir), S, 21)
    return chunks(spark, sf_dir).drop("embedding").join(found, "chunk_id")


def rerank_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = retrieval.rerank(_hits(spark, sf_dir), asked(spark, sf_dir), S)
    return scored.select("query_id", F.col("position").cast("long").alias("position"), "chunk_id", "rscore")


def retrieve_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = retrieval.retrieve(chunks(spark, sf_dir), asked(spark, sf_dir), S, synonyms(spark), facts(spark))
    return found.select("query_id", F.col("position").cast("long").alias("position"), "title", "source", "category", "score")


def context_block(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = retrieval.retrieve(chunks(spark, sf_dir), asked(spark, sf_dir), S, synonyms(spark), facts(spark))
    return retrieval.context_block(found).select("query_id", F.md5("context").alias("context_md5"), F.length("context").cast("long").alias("n_chars"))


def zero_vector_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    blind = asked(spark, sf_dir).withColumn("vector", F.transform("vector", lambda x: (x * 0).cast("float")))
    found = retrieval.retrieve(chunks(spark, sf_dir), blind, S)
    return found.select("query_id", F.col("position").cast("long").alias("position"), "title", "source", "score")


def zero_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embeddings(spark, sf_dir).groupBy(starts_with_zeros(F.col("embedding")).alias("zero")).agg(F.count(F.lit(1)).alias("n"))


def dedup_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = documents(spark, sf_dir).select(F.lit(0).alias("query_id"), "text", F.col("doc_id").alias("rank"))
    return retrieval.dedup(hits).select(F.col("rank").alias("doc_id"), F.length("text").cast("long").alias("n_chars"))


def unique_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = documents(spark, sf_dir).select("source", F.col("doc_id").alias("rank"), F.substring("text", 1, 40).alias("title"))
    return retrieval.first_by(hits, ["source"], "rank").select("source", F.col("rank").alias("first_id"), "title")


def expand_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retrieval.expand(asked(spark, sf_dir), synonyms(spark)).select("query_id", "expanded")


def suggest_office(spark: SparkSession, sf_dir: str) -> DataFrame:
    talk = spark.read.parquet(f"{sf_dir}/conversations.parquet").where("role = 'user'").select((F.col("conv_id") * 1000 + F.col("turn")).alias("query_id"), F.col("text").alias("question"))
    return retrieval.suggest_office(talk, offices(spark)).groupBy("name", "url").agg(F.count(F.lit(1)).alias("n"))


def known_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retrieval.known_facts(asked(spark, sf_dir), facts(spark)).select("query_id", F.col("ord").cast("long").alias("ord"), "title", "source")


def detect_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents(spark, sf_dir).groupBy("lang", T.detect_language(F.col("text")).alias("detected")).agg(F.count(F.lit(1)).alias("n"))


def eval_retrieval(spark: SparkSession, sf_dir: str) -> DataFrame:
    cases = spark.createDataFrame([(i, q.split()[:3], i % 3) for i, q, _ in ASKED], "query_id long, expected_keywords array<string>, min_chunks int")
    hits = retrieval.retrieve(chunks(spark, sf_dir), asked(spark, sf_dir), S)
    answers = hits.where("position = 1").select("query_id", F.col("title").alias("answer"), F.lit(10).alias("elapsed_ms"))
    found = evaluation.results(cases, hits, answers)
    return found.select("query_id", "chunks", "retrieval_ok", F.size("keywords_hit").cast("long").alias("keywords_hit"), F.round("keyword_score", 6).alias("keyword_score"), "passed")


QUERIES = {
    f.__name__: f
    for f in (
        bm25_topk, bm25_stored, bm25_corpus_stats, term_df_topk, vector_topk, vector_topk_batch, hybrid_rrf, rerank_scores, retrieve_context, context_block,
        zero_vector_fallback, zero_vectors, dedup_text, unique_sources, expand_query, suggest_office, known_facts, detect_language, eval_retrieval,
    )
}


def _text(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _list(values: list[str]) -> str:
    return f"[{', '.join(map(_text, values))}]"


_Q = "asked(query_id, question, vec_id) AS (VALUES " + ", ".join(f"({i}::BIGINT, {_text(q)}, {v}::BIGINT)" for i, q, v in ASKED) + ")"
_QV = f"{_Q}, q AS (SELECT query_id, question, embedding::DOUBLE[] AS vector FROM asked JOIN embeddings USING (vec_id))"
_SYN = "syn(ord, term, synonyms) AS (VALUES " + ", ".join(f"({o}, {_text(t)}, {_list(s)})" for o, t, s in SYNONYMS) + ")"
_OFF = "off(ord, keywords, name, url) AS (VALUES " + ", ".join(f"({o}, {_list(k)}, {_text(n)}, {_text(u)})" for o, k, n, u in OFFICES) + ")"
_FACT = "fact(ord, keywords, require_any, text, title, source, category) AS (VALUES " + ", ".join(f"({o}, {_list(k)}, {_list(r)}, {_text(x)}, {_text(t)}, {_text(s)}, {_text(c)})" for o, k, r, x, t, s, c in FACTS) + ")"
_CHUNKS = """chunks AS (
  SELECT doc_id AS chunk_id, text, source || '/' || lang AS source, substr(text, 1, 40) AS title,
         CASE WHEN doc_id % 3 = 0 THEN 'servizio' ELSE 'pagina' END AS category, embedding::DOUBLE[] AS v
  FROM documents JOIN embeddings ON vec_id = doc_id)"""


def _bm25(corpus: str, questions: str) -> str:
    """CTEs up to bm25(query_id, chunk_id, score) over corpus(chunk_id, text) and questions(query_id, question)."""
    return f"""tok AS (SELECT chunk_id, regexp_extract_all(lower(text), '[{TOKEN_LETTERS}]+') AS tokens FROM {corpus}),
corpus_stats AS (SELECT count(*) AS n_docs, avg(len(tokens)) AS avgdl FROM tok),
words AS (SELECT chunk_id, len(tokens) AS dl, unnest(tokens) AS term FROM tok),
tf AS (SELECT chunk_id, dl, term, count(*) AS tf FROM words GROUP BY ALL),
dfs AS (SELECT term, count(*) AS df FROM tf GROUP BY ALL),
raw AS (SELECT term, df, ln(n_docs - df + 0.5::DOUBLE) - ln(df + 0.5::DOUBLE) AS raw FROM dfs, corpus_stats),
idf AS (SELECT term, df, CASE WHEN raw < 0 THEN 0.25::DOUBLE * (SELECT avg(raw) FROM raw) ELSE raw END AS idf FROM raw),
qterm AS (SELECT query_id, term, count(*) AS qtf FROM (SELECT query_id, unnest(regexp_extract_all(lower(question), '[{TOKEN_LETTERS}]+')) AS term FROM {questions}) GROUP BY ALL),
bm25 AS (
  SELECT query_id, chunk_id, round(sum(qtf * idf * tf * 2.5::DOUBLE / (tf + 1.5::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * dl / avgdl))), 6) AS score
  FROM tf JOIN idf USING (term) JOIN qterm USING (term), corpus_stats GROUP BY ALL)"""


def _hybrid(questions: str, vw: float = 0.4, bw: float = 0.6) -> str:
    """CTEs up to hits(query_id, chunk_id, rrf, rank, score), 21 a query, over chunks and q."""
    return f"""{_bm25("chunks", questions)},
cosine AS (
  SELECT query_id, chunk_id, round(CASE WHEN list_inner_product(v, v) > 0 AND list_inner_product(vector, vector) > 0
         THEN list_inner_product(v, vector) / (sqrt(list_inner_product(v, v)) * sqrt(list_inner_product(vector, vector))) ELSE 0 END, 9) AS score
  FROM chunks, q),
near AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM cosine),
every AS (SELECT query_id, chunk_id, coalesce(score, 0) AS score FROM (SELECT query_id, chunk_id FROM (SELECT DISTINCT query_id FROM qterm), chunks) LEFT JOIN bm25 USING (query_id, chunk_id)),
worded AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM every),
fused AS (
  SELECT query_id, chunk_id, round(sum(part), 9) AS rrf FROM (
    SELECT query_id, chunk_id, {vw}::DOUBLE / (60 + rank) AS part FROM near WHERE rank <= 420
    UNION ALL SELECT query_id, chunk_id, {bw}::DOUBLE / (60 + rank) FROM worded WHERE rank <= 420) GROUP BY ALL),
ordered AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rrf DESC, chunk_id) AS rank FROM fused),
hits AS (SELECT o.query_id, o.chunk_id, o.rrf, o.rank, c.score FROM ordered o JOIN cosine c USING (query_id, chunk_id) WHERE o.rank <= 21)"""


def _rerank(hits: str) -> str:
    """CTE reranked over hits joined with their fields and q."""
    words = lambda c: f"list_distinct(regexp_extract_all(lower({c}), '[\\p{{L}}\\p{{N}}_]+'))"
    return f"""rscored AS (
  SELECT h.*, round(h.score + len(list_intersect({words("question")}, {words("h.title")})) * 0.02::DOUBLE
         + CASE WHEN h.category = 'servizio' THEN 0.01::DOUBLE ELSE 0 END
         - (row_number() OVER (PARTITION BY h.query_id, h.source ORDER BY h.rank) - 1) * 0.05::DOUBLE, 9) AS rscore
  FROM {hits} h JOIN q USING (query_id)),
reranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rscore DESC, rank) AS position FROM rscored)"""


_EXPANDED = """expanded AS (
  SELECT query_id, question, CASE WHEN len(words) > 0 THEN question || ' ' || array_to_string(words, ' ') ELSE question END AS expanded
  FROM asked LEFT JOIN (SELECT query_id, flatten(list(synonyms ORDER BY ord)) AS words FROM asked JOIN syn ON contains(lower(question), term) GROUP BY query_id) USING (query_id))"""
_FIRST = """fields AS (SELECT h.*, c.text, c.title, c.source, c.category FROM hits h JOIN chunks c USING (chunk_id)),
passed AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id, regexp_replace(text, '^\\s+|\\s+$', '', 'g') ORDER BY rank) AS copy FROM fields)
  WHERE copy = 1 AND {score})"""
_KNOWN = """asked_words AS (SELECT query_id, regexp_extract_all(lower(question), '[\\p{L}\\p{N}_]+') AS words FROM asked),
known AS (SELECT query_id, fact.* FROM asked_words JOIN fact ON list_has_any(words, keywords) AND list_has_any(words, require_any))"""
_RETRIEVED = f"""WITH {_QV}, {_SYN}, {_FACT}, {_CHUNKS}, {_EXPANDED}, expanded_q AS (SELECT query_id, expanded AS question FROM expanded),
{_hybrid("expanded_q")}, {_FIRST.format(score="score >= 0.38")}, {_rerank("passed")}, {_KNOWN},
merged AS (
  SELECT query_id, 0 AS part, ord AS place, text, title, source, category, 1.0::DOUBLE AS score FROM known
  UNION ALL SELECT query_id, 1, position, text, title, source, category, score FROM reranked r
  WHERE NOT EXISTS (SELECT 1 FROM known k WHERE k.query_id = r.query_id AND k.source = r.source)),
final AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY part, place) AS position FROM merged) WHERE position <= 7)
"""
_DOCS = "docs AS (SELECT doc_id AS chunk_id, text FROM documents)"

SQL = {
    "bm25_topk": f"WITH {_Q}, {_DOCS}, {_bm25('docs', 'asked')} SELECT query_id, rank, chunk_id, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM bm25) WHERE rank <= 10",
    "bm25_corpus_stats": f"WITH {_Q}, {_DOCS}, {_bm25('docs', 'asked')} SELECT n_docs, round(avgdl, 6) AS avgdl, n_terms, postings, max_df FROM corpus_stats, (SELECT count(*) AS n_terms, sum(df)::BIGINT AS postings, max(df) AS max_df FROM dfs)",
    "term_df_topk": f"WITH {_Q}, {_DOCS}, {_bm25('docs', 'asked')} SELECT term, df, round(idf, 6) AS idf FROM idf ORDER BY df DESC, term LIMIT 50",
    "vector_topk": f"WITH {_QV}, e AS (SELECT vec_id AS chunk_id, embedding::DOUBLE[] AS v FROM embeddings) SELECT chunk_id, round(list_inner_product(v, vector) / (sqrt(list_inner_product(v, v)) * sqrt(list_inner_product(vector, vector))), 9) AS score FROM e, q WHERE query_id = 1 ORDER BY score DESC, chunk_id LIMIT 7",
    "vector_topk_batch": f"WITH {_QV}, e AS (SELECT vec_id AS chunk_id, embedding::DOUBLE[] AS v FROM embeddings), s AS (SELECT query_id, chunk_id, round(list_inner_product(v, vector) / (sqrt(list_inner_product(v, v)) * sqrt(list_inner_product(vector, vector))), 9) AS score FROM e, q) SELECT query_id, rank, chunk_id, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM s) WHERE rank <= 10",
    "hybrid_rrf": f"WITH {_QV}, {_CHUNKS}, {_hybrid('asked')} SELECT query_id, rank, chunk_id, rrf, score FROM hits",
    "rerank_scores": f"WITH {_QV}, {_CHUNKS}, {_hybrid('asked')}, fields AS (SELECT h.*, c.title, c.source, c.category FROM hits h JOIN chunks c USING (chunk_id)), {_rerank('fields')} SELECT query_id, position, chunk_id, rscore FROM reranked",
    "retrieve_context": f"{_RETRIEVED} SELECT query_id, position, title, source, category, score FROM final",
    "context_block": f"{_RETRIEVED}, blocks AS (SELECT query_id, string_agg('[Fonte ' || position || ': ' || title || ' — tipo=' || category || ' — ' || source || ']' || chr(10) || text, chr(10) || chr(10) || '---' || chr(10) || chr(10) ORDER BY position) AS context FROM final GROUP BY query_id) SELECT query_id, md5(context) AS context_md5, length(context) AS n_chars FROM blocks",
    "zero_vector_fallback": f"WITH {_Q}, q AS (SELECT query_id, question, list_transform(embedding, lambda x: 0::DOUBLE) AS vector FROM asked JOIN embeddings USING (vec_id)), {_CHUNKS}, {_hybrid('asked', 0.0, 1.0)}, {_FIRST.format(score='rrf >= 0.005')}, {_rerank('passed')} SELECT query_id, position, title, source, score FROM reranked WHERE position <= 7",
    "zero_vectors": "SELECT list_sum(list_transform(embedding[1:10], lambda x: abs(x))) = 0 AS zero, count(*) AS n FROM embeddings GROUP BY 1",
    "dedup_text": "SELECT min(doc_id) AS doc_id, arg_min(length(text), doc_id) AS n_chars FROM documents WHERE regexp_replace(text, '^\\s+|\\s+$', '', 'g') <> '' GROUP BY regexp_replace(text, '^\\s+|\\s+$', '', 'g')",
    "unique_sources": "SELECT source, min(doc_id) AS first_id, arg_min(substr(text, 1, 40), doc_id) AS title FROM documents GROUP BY source",
    "expand_query": f"WITH {_Q}, {_SYN}, {_EXPANDED} SELECT query_id, expanded FROM expanded",
    "suggest_office": f"WITH {_OFF}, talk AS (SELECT conv_id * 1000 + turn AS query_id, lower(text) AS t FROM conversations WHERE role = 'user'), best AS (SELECT query_id, min(ord) AS ord FROM talk JOIN off ON len(list_filter(keywords, lambda k: contains(t, k))) > 0 GROUP BY query_id) SELECT name, url, count(*) AS n FROM talk LEFT JOIN best USING (query_id) LEFT JOIN off USING (ord) GROUP BY name, url",
    "known_facts": f"WITH {_Q}, {_FACT}, {_KNOWN} SELECT query_id, ord::BIGINT AS ord, title, source FROM known",
    "detect_language": "WITH w AS (SELECT lang, list_distinct(regexp_split_to_array(lower(regexp_replace(text, '^\\s+|\\s+$', '', 'g')), '\\s+')) AS words FROM documents) SELECT lang, CASE WHEN len(list_intersect(words, {en})) > len(list_intersect(words, {it})) THEN 'en' ELSE 'it' END AS detected, count(*) AS n FROM w GROUP BY ALL",
    "eval_retrieval": f"WITH {_QV}, {_CHUNKS}, {_hybrid('asked')}, {_FIRST.format(score='score >= 0.38')}, {_rerank('passed')}, found AS (SELECT query_id, count(DISTINCT source) AS chunks, max(CASE WHEN position = 1 THEN lower(title) END) AS answer FROM reranked WHERE position <= 7 GROUP BY query_id), k AS (SELECT query_id, string_split(question, ' ')[1:3] AS keywords, query_id % 3 AS min_chunks, coalesce(chunks, 0) AS chunks, coalesce(answer, '') AS answer FROM asked LEFT JOIN found USING (query_id)), s AS (SELECT *, len(list_filter(keywords, lambda w: contains(answer, w))) AS hit FROM k) SELECT query_id, chunks, chunks >= min_chunks AS retrieval_ok, hit AS keywords_hit, round(hit / len(keywords), 6) AS keyword_score, chunks >= min_chunks AND hit / len(keywords) >= 0.5 AS passed FROM s",
}
SQL["bm25_stored"] = SQL["bm25_topk"]
SQL["detect_language"] = SQL["detect_language"].replace("{en}", _list(list(ENGLISH))).replace("{it}", _list(list(ITALIAN)))
