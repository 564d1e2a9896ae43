"""Queries on whole jobs: crawls into the index, syncs into the store, the inbox, clean-ups and the health row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import jobs
from ..config import Settings
from ..functions import urls as U
from ..operators import crawl, html, store
from ..operators.embedding import hashing_embedder

S = Settings(site_url="https://www.example.org", allowed_domains=("example.com", "example.org"), embedding_dim=16, domain_max_path_depth={"m.": 1})


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/pages.parquet")


def _url() -> Column:
    return F.concat(F.lit("https://www.example.org/p/"), F.col("page_id").cast("string"))


def _fetched(found: DataFrame, version) -> DataFrame:
    """Pages as a crawl brings them: some too short, some no page at all."""
    n = F.col("page_id").cast("string")
    said = F.concat(F.lit("Version "), version.cast("string"), F.lit(" of page "), n, F.lit(". "))
    body = F.concat(F.lit("<html><head><title>T"), n, F.lit("</title></head><body><main><p>"), F.expr("repeat(said, cast(1 + page_id % 8 AS int))"), F.lit("</p></main></body></html>"))
    kind = F.when(F.col("page_id") % 13 == 0, "image/png").otherwise("Text/HTML; charset=utf-8")
    return found.withColumn("said", said).select(_url().alias("url"), F.lit(200).alias("status"), kind.alias("content_type"), F.encode(body, "UTF-8").alias("body"), F.lit(None).cast("string").alias("error"))


def _base(spark: SparkSession) -> jobs.Base:
    return jobs.Base(spark, crawl.scratch(spark, "base"), S, hashing_embedder(S.embedding_dim), "2024-02-01T00:00:00")


def _second(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A later crawl: a fifth of the pages is gone, a third has another text."""
    return _fetched(pages(spark, sf_dir).where("page_id % 5 <> 0"), F.when(F.col("page_id") % 3 == 0, 2).otherwise(1))


def sync_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The store after a full and an incremental sync."""
    base = _base(spark)
    jobs.sync(base, "full", _fetched(pages(spark, sf_dir), F.lit(1)))
    jobs.sync(base, "incremental", _second(spark, sf_dir))
    return base.read("store").select("source", "title", F.col("chunk_index").cast("long").alias("chunk_index"), F.md5("text").alias("text_md5"), F.size("embedding").cast("long").alias("dim"))


def sync_crawl(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the second of two crawls says of each URL."""
    base = _base(spark)
    jobs.run_crawl(base, _fetched(pages(spark, sf_dir), F.lit(1)))
    return jobs.run_crawl(base, _second(spark, sf_dir), incremental=True)


def stream_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The crawl state that a stream of two whole crawls leaves."""
    from .. import schemas
    from ..sources import readers
    from ..streaming import streams

    source, root, checkpoint = (crawl.scratch(spark, name) for name in ("crawls", "state", "checkpoint"))
    found = pages(spark, sf_dir).select("page_id", _url().alias("url"), "html", F.lit("t").alias("title"), F.lit("f").alias("file"))
    second = found.where("page_id % 5 <> 0").withColumn("html", F.when(F.col("page_id") % 3 == 0, F.concat("html", F.lit("!"))).otherwise(F.col("html")))
    for n, one in enumerate((found, second)):
        one.drop("page_id").write.mode("append").parquet(source)
        stream = spark.readStream.schema(one.drop("page_id").schema).parquet(source)
        streams.run_crawl_state(stream, root, lambda fresh: fresh.count(), checkpoint, lambda n=n: str(n), whole=True).awaitTermination()
    return readers.read_snapshot(spark, root, schemas.STATE).select("url", "hash", "last_crawled", "changed")


def page_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dates and service states of pages with meta elements, by their trees."""
    n = F.col("page_id")
    day = F.concat(F.lit("2024-01-"), F.format_string("%02d", n % 28 + 1))
    head = F.when(n % 4 == 0, F.concat(F.lit('<meta property="article:modified_time" content="'), day, F.lit('T10:00:00">'))).when(n % 4 == 1, F.concat(F.lit('<meta name="date" content="'), day, F.lit('">'))).otherwise("")
    body = F.when(n % 4 == 2, F.concat(F.lit('<time datetime="'), day, F.lit('T09:00">day</time>'))).otherwise("")
    said = F.element_at(F.array(F.lit("Servizio attivo"), F.lit("servizio SOSPESO"), F.lit("altro testo")), (n % 3 + 1).cast("int"))
    made = pages(spark, sf_dir).select(F.concat(F.lit("https://www.example.org/services/"), n.cast("string")).alias("url"), F.concat(F.lit("<head>"), head, F.lit("</head><main>"), body, F.lit("<p>"), said, F.lit("</p></main>")).alias("html"))
    return html.clean_pages(made).select("url", "date", "service_status", "category")


def content_routes(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = F.element_at(F.array(F.lit("text/html"), F.lit("TEXT/HTML; charset=x"), F.lit("application/pdf"), F.lit(None), F.lit("image/png")), (F.col("page_id") % 5 + 1).cast("int"))
    found = pages(spark, sf_dir).select("url", said.alias("content_type"), F.col("html").alias("body"), F.when(F.col("page_id") % 7 == 0, "refused").alias("error"))
    return crawl.routed(found).groupBy("kind").agg(F.count(F.lit(1)).alias("n"))


def long_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pages(spark, sf_dir).select("page_id", html.article_text(F.col("html")).alias("text"))
    return crawl.long_enough(found, S).select("page_id")


def new_pdfs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """PDFs that pages link to and the index lacks; each page has a link of its own and one that others share."""
    n = F.col("page_id")
    link = lambda name: F.concat(F.lit('<a href="/d/'), name, F.lit('.PDF">x</a>'))
    found = pages(spark, sf_dir).select(F.concat(F.lit("https://www.example.org/p/"), n.cast("string")).alias("url"), F.concat(link(n.cast("string")), link((n % 10).cast("string")), F.lit('<a href="https://elsewhere.net/x.pdf">y</a>')).alias("html"))
    known = pages(spark, sf_dir).where("page_id % 3 = 0").select(F.concat(F.lit("https://www.example.org/d/"), n.cast("string"), F.lit(".PDF")).alias("url"))
    return crawl.unknown_pdfs(html.pdf_links(found, S), known)


def index_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents given and indexed and chunks of one kind of source, of a store that has some already."""
    base = _base(spark)
    jobs.run_crawl(base, _fetched(pages(spark, sf_dir), F.lit(1)))
    docs = jobs.page_documents(base.read("pages"))
    jobs.index_documents(base, docs.where("title LIKE '%5'"))
    mixed = docs.withColumn("doc_type", F.when(F.col("title").like("%7"), "document").otherwise(""))
    return jobs.index_documents(base, mixed, skip_existing=True, source_type="html")


def cleanup_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = crawl.clean_up(
        pages(spark, sf_dir).select("url", F.col("page_id").cast("string").alias("file")),
        pages(spark, sf_dir).select(F.concat("url", F.lit("/a/b/a")).alias("url"), F.lit("").alias("file")),
        pages(spark, sf_dir).select(F.concat(F.lit("https://a@"), F.substring("url", 9, 1000)).alias("url")),
        lambda url: U.should_skip(url, S),
    )
    files = found["files"].agg(F.count(F.lit(1)).alias("n")).select(F.lit("files").alias("part"), F.lit(None).cast("long").alias("kept"), F.col("n").alias("dropped"))
    return found["counts"].unionByName(files)


def cleanup_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    none = pages(spark, sf_dir).select("url", F.lit("").alias("file"))
    return crawl.clean_up(none.withColumn("url", F.concat("url", F.lit("/feed/"))), none.limit(0), none.limit(0), lambda url: U.should_skip(url, S))["sample"]


def inbox_tallies(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return jobs.inbox_tallies(docs.select((F.length("text") >= 100).alias("ok")))


def health(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import log_queries, store_queries

    talk = spark.read.parquet(f"{sf_dir}/conversations.parquet").where("role = 'user'")
    gaps = talk.select(F.format_string("%012d", F.col("conv_id") * 1000 + F.col("turn")).alias("ts"), F.substring("text", 1, 200).alias("query"), (F.col("turn") % 3).alias("chunks")).where("chunks = 0")
    row = store.health(store_queries._store(spark, sf_dir), gaps, log_queries.ratings(spark, sf_dir), log_queries.events(spark, sf_dir))
    return row.select(
        "status", "indexed_chunks", "unique_sources", "hybrid_search", F.col("doc_types")["html"].alias("html_chunks"), F.col("doc_types")["pdf"].alias("pdf_chunks"),
        "gaps_total", F.element_at("gaps_recent", -1)["ts"].alias("last_gap"), "positive", "negative", F.element_at("activity", 13).alias("at_noon"), F.col("top_doc")["chunks"].alias("top_chunks"),
    )


QUERIES = {
    f.__name__: f
    for f in (sync_store, sync_crawl, stream_state, page_metadata, content_routes, long_pages, new_pdfs, index_totals, cleanup_tables, cleanup_sample, inbox_tallies, health)
}


def _sql() -> dict[str, str]:
    from . import log_queries, page_queries, store_queries

    body = "rtrim(repeat('Version ' || v || ' of page ' || page_id || '. ', (1 + page_id % 8)::INT))"
    versions = "t AS (SELECT page_id, v, " + body + " AS body FROM (SELECT page_id, unnest([1, 2]) AS v FROM pages WHERE page_id % 13 <> 0))"
    text = page_queries.SQL["page_text"].replace("SELECT page_id, md5(text) AS text_md5, length(text) AS n_chars FROM t", "")
    reason = lambda table: page_queries._reason(table)
    return {
        "sync_store": f"WITH {versions} SELECT 'https://www.example.org/p/' || page_id AS source, 'T' || page_id AS title, 0::BIGINT AS chunk_index, md5('T' || page_id || chr(10) || chr(10) || body) AS text_md5, 16::BIGINT AS dim FROM t WHERE length(body) >= 100 AND page_id % 5 <> 0 AND (v = 1 OR page_id % 3 = 0)",
        "sync_crawl": f"WITH {versions} SELECT 'https://www.example.org/p/' || page_id AS url, CASE WHEN page_id % 13 = 0 THEN 'other' WHEN page_id % 5 = 0 THEN 'removed' WHEN n < 100 THEN 'short' WHEN page_id % 3 = 0 THEN 'changed' ELSE 'unchanged' END AS status FROM pages LEFT JOIN (SELECT page_id, length(body) AS n FROM t WHERE v = 1) USING (page_id) WHERE page_id % 5 <> 0 OR n >= 100",
        "stream_state": "SELECT 'https://www.example.org/p/' || page_id AS url, md5(html || CASE WHEN page_id % 3 = 0 THEN '!' ELSE '' END) AS hash, CASE WHEN page_id % 3 = 0 THEN '1' ELSE '0' END AS last_crawled, page_id % 3 = 0 AS changed FROM pages WHERE page_id % 5 <> 0",
        "page_metadata": "SELECT 'https://www.example.org/services/' || page_id AS url, CASE WHEN page_id % 4 < 3 THEN '2024-01-' || format('{:02d}', page_id % 28 + 1) END AS date, CASE page_id % 3 WHEN 0 THEN 'attivo' WHEN 1 THEN 'non attivo' END AS service_status, 'servizio' AS category FROM pages",
        "content_routes": "SELECT CASE WHEN page_id % 7 = 0 THEN 'error' WHEN page_id % 5 < 2 THEN 'html' WHEN page_id % 5 = 2 THEN 'pdf' ELSE 'other' END AS kind, count(*) AS n FROM pages GROUP BY 1",
        "long_pages": text + " SELECT page_id FROM t WHERE length(text) >= 100",
        "new_pdfs": "SELECT DISTINCT 'https://www.example.org/d/' || n || '.PDF' AS url FROM (SELECT unnest([page_id, page_id % 10]) AS n FROM pages) WHERE n % 3 <> 0 OR n NOT IN (SELECT page_id FROM pages)",
        "index_totals": f"WITH {versions}, d AS (SELECT page_id FROM t WHERE v = 1 AND length(body) >= 100 AND page_id % 10 NOT IN (5, 7)) SELECT count(*) AS documents, count(*) AS indexed, count(*) AS chunks FROM d",
        "cleanup_tables": f"SELECT part, count(*) FILTER (reason = '') AS kept, count(*) FILTER (reason <> '') AS dropped FROM (SELECT 'pages' AS part, reason FROM ({reason('pages')}) UNION ALL SELECT 'pdfs', reason FROM ({reason('(SELECT page_id, url || chr(47) || chr(97) || chr(47) || chr(98) || chr(47) || chr(97) AS url FROM pages)')}) UNION ALL SELECT 'state', 'address' FROM pages) GROUP BY part UNION ALL SELECT 'files', NULL, count(*) FILTER (reason <> '') FROM ({reason('pages')})",
        "cleanup_sample": f"WITH u AS (SELECT page_id, url || '/feed/' AS url FROM pages) SELECT 'pages' AS part, url FROM ({reason('u')}) WHERE reason <> '' ORDER BY url LIMIT 5",
        "inbox_tallies": "SELECT count(*) FILTER (length(text) >= 100) AS ok, count(*) FILTER (length(text) < 100) AS errors FROM documents",
        "health": f"WITH {store_queries._STORE}, {log_queries._RATE}, g AS (SELECT conv_id * 1000 + turn AS ts FROM conversations WHERE role = 'user' AND turn % 3 = 0) SELECT 'ok' AS status, (SELECT count(*) FROM store) AS indexed_chunks, (SELECT count(DISTINCT source) FROM store) AS unique_sources, (SELECT count(*) > 0 FROM store) AS hybrid_search, (SELECT count(*) FROM store WHERE doc_type IN ('', 'html')) AS html_chunks, (SELECT count(*) FROM store WHERE doc_type IN ('pdf', 'document')) AS pdf_chunks, (SELECT count(*) FROM g) AS gaps_total, (SELECT format('{{:012d}}', max(ts)) FROM g) AS last_gap, (SELECT count(*) FROM r WHERE rating = 1) AS positive, (SELECT count(*) FROM r WHERE rating = -1) AS negative, (SELECT count(*) FROM events WHERE hour(ts) = 12) AS at_noon, (SELECT max(n) FROM (SELECT count(*) AS n FROM store GROUP BY source)) AS top_chunks",
    }


SQL = _sql()
