"""Queries on chunking and the chunk store."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import CHUNK_NOISE
from ..functions import text as T
from ..operators import chunking, store


def docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as sources for chunks."""
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select(
        "text", F.concat(F.lit("doc/"), F.col("doc_id").cast("string")).alias("source"), F.substring("text", 1, 30).alias("title"),
        F.element_at(F.array(F.lit(""), F.lit("pdf"), F.lit("document"), F.lit("html")), (F.col("doc_id") % 4 + 1).cast("int")).alias("doc_type"),
    )


def chunk_short_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents that need no split, which SQL can express; chunk_all has all of them."""
    found = chunking.chunk(docs(spark, sf_dir).where(F.length("text") <= 1200))
    return found.select("source", F.col("chunk_index").cast("long").alias("chunk_index"), F.col("chunk_total").cast("long").alias("chunk_total"), F.md5("text").alias("text_md5"))


def chunk_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunking.chunk(docs(spark, sf_dir)).select("source", "chunk_id")


def chunk_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunking.chunk(docs(spark, sf_dir)).select("source", "chunk_index", "chunk_total", "chunk_id", F.length("text").alias("n_chars"))


def clean_pdf_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = F.concat(F.lit("\x07[Pagina 1]\n\n\n\n"), F.replace(F.col("text"), F.lit(" "), F.lit(" \t ")), F.lit("\n***\n"), F.repeat(F.lit("x"), 250))
    text = T.clean_pdf(raw)
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", F.md5(text).alias("text_md5"), F.length(text).cast("long").alias("n_chars"))


def clean_chunk_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = F.concat(F.lit("  Download \n3/10\nabc\n  "), F.col("text"), F.lit("\nAltro"))
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", F.md5(T.clean_chunk(raw)).alias("text_md5"))


def _store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A store of one chunk a document with its vector."""
    d = spark.read.parquet(f"{sf_dir}/documents.parquet").select(
        F.col("doc_id").cast("string").alias("chunk_id"), F.concat_ws("/", "source", "lang").alias("source"), F.substring("text", 1, 20).alias("title"),
        F.element_at(F.array(F.lit(""), F.lit("pdf"), F.lit("document"), F.lit("html")), (F.col("doc_id") % 4 + 1).cast("int")).alias("doc_type"), F.col("doc_id").alias("chunk_index"), "text",
    )
    e = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select(F.col("vec_id").cast("string").alias("chunk_id"), "embedding")
    return d.join(e, "chunk_id")


def upsert_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    all_ = _store(spark, sf_dir)
    old = all_.where("chunk_index % 2 = 0")
    batch = all_.where("chunk_index % 2 = 1 OR chunk_index % 3 = 0").withColumn("title", F.concat(F.lit("new "), "title"))
    return store.upsert(old, batch).select("chunk_id", "title", "source")


def upsert_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    all_ = _store(spark, sf_dir)
    return store.inserted(all_.where("chunk_index % 2 = 0"), all_)


def remove_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    all_ = _store(spark, sf_dir)
    return store.remove_sources(all_, all_.where("source LIKE '%/fr'").select("source")).groupBy("source").agg(F.count(F.lit(1)).alias("n"))


def replace_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    all_ = _store(spark, sf_dir)
    batch = all_.where("source LIKE '%/de' AND chunk_index % 2 = 0").withColumn("title", F.lit("again"))
    return store.replace_sources(all_, batch).groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("title") == "again").alias("replaced"))


def store_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store.stats(_store(spark, sf_dir))


def doc_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store.chunks_by_kind(_store(spark, sf_dir))


def top_doc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store.top_source(_store(spark, sf_dir), "chunk_index")


def unit_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..functions.vectors import norm, normalised

    e = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    twice = F.transform("embedding", lambda x: x * 2)
    return e.select("vec_id", F.round(norm(normalised(twice)), 6).alias("norm"), F.round(norm(twice), 4).alias("before"))


def inbox_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as inbox texts with sidecars for some of them."""
    from ..sources.readers import with_sidecars

    d = spark.read.parquet(f"{sf_dir}/documents.parquet")
    stem = F.col("doc_id").cast("string")
    texts = d.select(stem.alias("stem"), F.concat(stem, F.lit(".txt")).alias("file"), F.lit("txt").alias("ext"), "text")
    sidecars = d.where("doc_id % 3 = 0").select(stem.alias("stem"), F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("T"), stem)).alias("title"), F.lit("").alias("source_url"), F.lit("avviso").alias("category"))
    return with_sidecars(texts, sidecars).select("filename", "title", "source", "category", "doc_type")


QUERIES = {
    f.__name__: f
    for f in (
        chunk_short_docs, chunk_ids, chunk_all, clean_pdf_text, clean_chunk_text, upsert_merge, upsert_counts, remove_sources, replace_sources, store_stats,
        doc_types, top_doc, unit_vectors, inbox_documents,
    )
}

_NOISE = T.noise_pattern(CHUNK_NOISE).replace("'", "''")


def _clean(c: str) -> str:
    return f"array_to_string(list_filter(list_transform(regexp_split_to_array({c}, '\\r\\n|[\\n\\r]'), lambda x: regexp_replace(x, '^\\s+|\\s+$', '', 'g')), lambda x: length(x) >= 4 AND NOT regexp_matches(x, '{_NOISE}')), chr(10))"


_SHORT = f"""short AS (
  SELECT 'doc/' || doc_id AS source, substr(text, 1, 30) AS title, regexp_split_to_array(regexp_replace(text, '^\\s+|\\s+$', '', 'g'), '\\n\\n+') AS parts FROM documents WHERE length(text) <= 1200),
piece AS (SELECT source, title, len(parts) AS chunk_total, unnest(parts) AS part, generate_subscripts(parts, 1) - 1 AS chunk_index FROM short),
chunk AS (SELECT source, chunk_index, chunk_total, CASE WHEN title <> '' THEN title || chr(10) || chr(10) || body ELSE body END AS text FROM (SELECT *, {_clean("part")} AS body FROM piece) WHERE length(body) >= 80)"""
_STORE = "store AS (SELECT doc_id, doc_id::VARCHAR AS chunk_id, source || '/' || lang AS source, lang, substr(text, 1, 20) AS title, ['', 'pdf', 'document', 'html'][doc_id % 4 + 1] AS doc_type FROM documents JOIN embeddings ON vec_id = doc_id)"
_V = "sqrt(list_inner_product(v, v))"

SQL = {
    "chunk_short_docs": f"WITH {_SHORT} SELECT source, chunk_index::BIGINT AS chunk_index, chunk_total::BIGINT AS chunk_total, md5(text) AS text_md5 FROM chunk",
    "clean_pdf_text": "WITH a AS (SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(chr(7) || '[Pagina 1]' || repeat(chr(10), 4) || replace(text, ' ', ' ' || chr(9) || ' ') || chr(10) || '***' || chr(10) || repeat('x', 250), '[\\x00-\\x08\\x0b\\x0c\\x0e-\\x1f\\x7f]', '', 'g'), '\\S{200,}', '', 'g'), '[ \\t]+', ' ', 'g'), '\\n{3,}', chr(10) || chr(10), 'g') AS t FROM documents), b AS (SELECT doc_id, regexp_replace(array_to_string(list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[a-zA-ZÀ-ÿ0-9]')), chr(10)), '^\\s+|\\s+$', '', 'g') AS t FROM a) SELECT doc_id, md5(t) AS text_md5, length(t) AS n_chars FROM b",
    "clean_chunk_text": f"SELECT doc_id, md5({_clean('t')}) AS text_md5 FROM (SELECT doc_id, '  Download ' || chr(10) || '3/10' || chr(10) || 'abc' || chr(10) || '  ' || text || chr(10) || 'Altro' AS t FROM documents)",
    "upsert_merge": f"WITH {_STORE} SELECT chunk_id, CASE WHEN doc_id % 2 = 1 OR doc_id % 3 = 0 THEN 'new ' ELSE '' END || title AS title, source FROM store",
    "upsert_counts": f"WITH {_STORE} SELECT count(*) FILTER (doc_id % 2 <> 0) AS inserted, count(*) FILTER (doc_id % 2 = 0) AS updated FROM store",
    "remove_sources": f"WITH {_STORE} SELECT source, count(*) AS n FROM store WHERE lang <> 'fr' GROUP BY source",
    "replace_sources": f"WITH {_STORE}, g AS (SELECT source, count(*) AS n, count(*) FILTER (lang = 'de' AND doc_id % 2 = 0) AS m FROM store GROUP BY source) SELECT source, CASE WHEN m > 0 THEN m ELSE n END AS n, m AS replaced FROM g",
    "store_stats": f"WITH {_STORE} SELECT count(*) AS chunks, count(DISTINCT source) AS sources FROM store",
    "doc_types": f"WITH {_STORE} SELECT CASE doc_type WHEN '' THEN 'html' WHEN 'document' THEN 'pdf' ELSE doc_type END AS kind, count(*) AS chunks FROM store GROUP BY 1",
    "top_doc": f"WITH {_STORE} SELECT source, arg_min(title, doc_id) AS title, count(*) AS chunks FROM store GROUP BY source ORDER BY chunks DESC, min(doc_id) LIMIT 1",
    "unit_vectors": f"SELECT vec_id, CASE WHEN {_V} > 0 THEN 1.0::DOUBLE ELSE 0.0 END AS norm, round({_V}, 4) AS before FROM (SELECT vec_id, list_transform(embedding::DOUBLE[], lambda x: x * 2) AS v FROM embeddings)",
    "inbox_documents": "SELECT doc_id || '.txt' AS filename, CASE WHEN doc_id % 6 = 0 THEN 'T' ELSE '' END || doc_id AS title, 'file://' || doc_id || '.txt' AS source, CASE WHEN doc_id % 3 = 0 THEN 'avviso' ELSE 'documento' END AS category, 'document' AS doc_type FROM documents WHERE length(regexp_replace(text, '^\\s+|\\s+$', '', 'g')) >= 100",
}
