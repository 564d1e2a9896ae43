"""Jobs that string the operators together: crawl, index, sync, inbox, clean-up, evaluation.

A knowledge base is a folder of versioned tables: `pages` (the cleaned pages), `pdfs` (url, file), `state` (url, hash, ...),
`store` (chunks with vectors) and `index` (postings). A job reads the newest versions and writes the next ones, so a
failed job leaves the last versions whole, and a second run of the same job changes nothing more.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import schemas
from .config import Settings
from .functions import urls as U
from .operators import chunking, crawl, evaluation, html, retrieval, search, store
from .operators.embedding import Embedder, embed, hashing_embedder
from .sources import readers

MODES = ("full", "incremental", "inbox", "full-index")
PAGES = f"{schemas.PAGE}, file string"
PDFS = "url string, file string"
NO_TIME = "1970-01-01T00:00:00"


@dataclass(frozen=True)
class Base:
    """A knowledge base: where it lies and what it is run with."""

    spark: SparkSession
    root: str
    settings: Settings = field(default_factory=Settings)
    embedder: Embedder | None = None
    now: str = NO_TIME

    def read(self, table: str) -> DataFrame:
        return readers.read_snapshot(self.spark, f"{self.root}/{table}", {"pages": PAGES, "pdfs": PDFS, "state": schemas.STATE, "store": schemas.STORE}[table])

    def write(self, table: str, df: DataFrame) -> DataFrame:
        readers.write_snapshot(df, f"{self.root}/{table}")
        return self.read(table)

    def index(self) -> search.Index:
        return search.load_index(self.spark, f"{self.root}/index")


def run_crawl(base: Base, fetched: DataFrame, incremental: bool = False) -> DataFrame:
    """Take in a crawl's fetched resources (url, status, content_type, body, error): pages are cleaned, PDFs are written to the
    base's folder, and both enter the index and the state. Returns (url, status) with new, changed, unchanged, short,
    removed, pdf, other or error. An incremental crawl skips what has its old hash; URLs that a crawl didn't see are dropped."""
    spark, old = base.spark, base.read("state")
    seen = crawl.routed(fetched).withColumn("hash", F.md5("body"))
    seen = crawl.kept_table(seen, "fetched")
    known = seen.where("kind IN ('html', 'pdf')").join(old.select("url", F.col("hash").alias("old")), "url", "left")
    same = F.coalesce(F.col("hash") == F.col("old"), F.lit(False))
    known = known.withColumn("status", F.when(F.col("old").isNull(), "new").when(same, "unchanged").otherwise("changed"))
    taken = known.where("status <> 'unchanged'") if incremental else known
    raw = taken.where("kind = 'html'").select("url", F.decode("body", "UTF-8").alias("html"))
    cleaned = crawl.kept_table(html.clean_pages(raw).withColumn("file", F.concat(U.file_name(F.col("url")), F.lit(".json"))), "cleaned")
    entries = crawl.long_enough(cleaned, base.settings)
    files = crawl.kept_table(taken.where("kind = 'pdf'").select("url", F.concat(U.file_name(F.col("url")), F.lit(".pdf")).alias("file"), "body"), "pdfs")
    write_pdfs(files, f"{base.root}/documents")

    found = entries.select("url", "title", "file").unionByName(files.select("url", F.lit("").alias("title"), "file")).join(seen.select("url", "hash"), "url")
    fresh = found.select("url", "hash", F.lit(base.now).alias("last_crawled"), "title", "file", F.lit(True).alias("changed"))
    state = crawl.merge_index(old.withColumn("changed", F.lit(False)), fresh)
    # A whole crawl starts from an empty index.
    held = {t: base.read(t) if incremental else base.read(t).limit(0) for t in ("pages", "pdfs")}
    pages = crawl.merge_index(held["pages"], entries.select(held["pages"].columns))
    pdfs = crawl.merge_index(held["pdfs"], files.select("url", "file"))
    gone = crawl.kept_table(crawl.removed(old, seen).select("url"), "gone")
    for table, df in (("state", state), ("pages", pages), ("pdfs", pdfs)):
        base.write(table, df.join(gone, "url", "left_anti").select(base.read(table).columns))

    short = cleaned.select("url").join(entries.select("url"), "url", "left_anti").withColumn("short", F.lit(True))
    told = seen.select("url", "kind").join(known.select("url", "status"), "url", "left").join(short, "url", "left")
    kind = F.when(F.col("short"), "short").when(F.col("kind") == "html", F.col("status")).otherwise(F.col("kind"))
    return told.select("url", kind.alias("status")).unionByName(gone.withColumn("status", F.lit("removed")))


def write_pdfs(files: DataFrame, folder: str) -> None:
    """Keep the bytes of PDFs (url, file, body), a row each, in a table that PDF extraction reads."""
    files.write.mode("append").parquet(folder)


def page_documents(pages: DataFrame) -> DataFrame:
    return pages.where(F.trim(F.coalesce("text", F.lit(""))) != "").select(
        "text", F.col("url").alias("source"), F.coalesce("title", F.lit("")).alias("title"), F.lit("html").alias("doc_type"), "category", "section", "date", "service_status"
    )


def pdf_documents(base: Base, pdfs: DataFrame) -> DataFrame:
    """The text of the index's PDFs; those without any are left out."""
    held = base.spark.read.schema("url string, file string, body binary").parquet(f"{base.root}/documents")
    latest = held.groupBy("url").agg(F.max_by("body", F.monotonically_increasing_id()).alias("content"))
    files = latest.join(pdfs.select("url", "file"), "url").select(F.col("file").alias("path"), "url", "content")
    texts = readers.inbox_texts(files.select("path", "content")).join(files.select("path", "url"), "path")
    return texts.where(F.trim(F.coalesce("text", F.lit(""))) != "").select("text", F.col("url").alias("source"), F.col("stem").alias("title"), F.lit("pdf").alias("doc_type"))


def index_documents(base: Base, docs: DataFrame, skip_existing: bool = False, source_type: str | None = None) -> DataFrame:
    """Chunk, embed and upsert documents; returns one row: documents given, indexed, and chunks. source_type takes only html or
    only pdf; skip_existing leaves out sources that the store has."""
    if source_type:
        docs = docs.where(store.kind(F.col("doc_type")) == source_type)
    held = base.read("store")
    if skip_existing:
        docs = docs.join(held.select("source").distinct(), "source", "left_anti").select(docs.columns)
    chunks = chunking.chunk(docs, base.settings)
    wanted = [c for c in held.columns if c != "embedding"]
    chunks = chunks.select(*((F.col(c) if c in chunks.columns else F.lit(None).cast(held.schema[c].dataType).alias(c)) for c in wanted))
    dim = base.settings.embedding_dim
    batch = crawl.kept_table(embed(chunks, base.embedder or hashing_embedder(dim), dim, batch=base.settings.embed_batch, chars=base.settings.embed_chars), "batch")
    base.write("store", store.upsert(held, batch, dim=dim))
    return run_totals(docs, batch)


def run_totals(docs: DataFrame, chunks: DataFrame) -> DataFrame:
    """One row: documents given, documents that gave a chunk, and chunks."""
    given = docs.agg(F.count(F.lit(1)).alias("documents"))
    made = chunks.agg(F.count_distinct("source").alias("indexed"), F.count(F.lit(1)).alias("chunks"))
    return given.crossJoin(F.broadcast(made))


def reindex(base: Base) -> None:
    """The postings of the store as it is now."""
    search.save_index(search.build_index(base.read("store")), f"{base.root}/index")


def has_documents(base: Base) -> bool:
    return not base.read("pdfs").isEmpty()


def sync(base: Base, mode: str, fetched: DataFrame | None = None, inbox: str | None = None) -> DataFrame:
    """Run a whole sync and return one row: the mode and the size of the store.

    full crawls and indexes everything anew; incremental indexes what changed and removes pages that are gone; full-index
    indexes anew without a crawl; inbox takes in new documents only. All but `inbox` take the inbox in at the end."""
    if mode not in MODES:
        raise ValueError(f"mode is one of {', '.join(MODES)}")
    if mode in ("full", "incremental"):
        run_crawl(base, fetched, incremental=mode == "incremental")
    if mode in ("full", "full-index"):
        base.write("store", base.read("store").limit(0))
    pages, pdfs = base.read("pages"), base.read("pdfs")
    if mode == "incremental":
        changed = base.read("state").where("changed").select("url")
        pages, pdfs = pages.join(changed, "url", "left_semi"), pdfs.join(changed, "url", "left_semi")
    if mode != "inbox":
        index_documents(base, page_documents(pages))
        if not pdfs.isEmpty():
            index_documents(base, pdf_documents(base, pdfs))
    if mode == "incremental":
        held = base.read("store")
        base.write("store", store.remove_sources(held, store.stale_sources(held, base.read("pages"))))
    if inbox:
        take_inbox(base, inbox)
    reindex(base)
    return base.read("store").agg(F.lit(mode).alias("mode"), F.count(F.lit(1)).alias("chunks"))


def take_inbox(base: Base, folder: str) -> DataFrame:
    """Index a folder's documents, then move each with its sidecar to processed/ or errors/. Returns (file, ok) by name."""
    files = readers.list_inbox(base.spark, folder)
    texts = crawl.kept_table(readers.inbox_texts(files), "inbox")
    docs = crawl.kept_table(readers.with_sidecars(texts, readers.read_sidecars(base.spark, folder)), "inbox-documents")
    index_documents(base, docs)
    made = base.read("store").select(F.col("filename").alias("file")).distinct().withColumn("ok", F.lit(True))
    told = texts.select("path", "file").join(made, "file", "left").select("path", "file", F.coalesce("ok", F.lit(False)).alias("ok"))
    told = crawl.kept_table(told, "inbox-told")
    # Moves are work of the file system's names, one entry a file of the folder.
    for row in told.toLocalIterator():
        readers.move_with_sidecar(base.spark, row.path, f"{folder}/{'processed' if row.ok else 'errors'}")
    return told.select("file", "ok").orderBy("file")


def inbox_tallies(told: DataFrame) -> DataFrame:
    return told.agg(F.count_if("ok").alias("ok"), F.count_if(~F.col("ok")).alias("errors"))


def clean_up(base: Base, dry_run: bool = False) -> dict[str, DataFrame]:
    """Drop what the rules exclude by now from the index and the state; returns what crawl.clean_up does."""
    found = crawl.clean_up(base.read("pages"), base.read("pdfs"), base.read("state"), lambda url: U.should_skip(url, base.settings))
    if not dry_run:
        found = {name: crawl.kept_table(t, f"clean-{name}") for name, t in found.items()}
        for table in ("pages", "pdfs", "state"):
            base.write(table, found[table])
    return found


@dataclass(frozen=True)
class Rules:
    """The rule tables that answers go by, and the system prompts."""

    synonyms: DataFrame
    offices: DataFrame
    facts: DataFrame
    system_it: str = ""
    system_en: str = ""


def answer(base: Base, questions: DataFrame, rules: Rules, history: DataFrame) -> DataFrame:
    """A batch of questions (query_id, question) up to the model's door: (query_id, question, messages, sources). Questions
    become vectors by the base's embedder, with their synonyms; the index of the last run is what BM25 reads."""
    embedder = base.embedder or hashing_embedder(base.settings.embedding_dim)
    asked = retrieval.expand(questions.select("query_id", "question"), rules.synonyms)
    asked = embed(asked, embedder, base.settings.embedding_dim, "expanded", base.settings.embed_batch, base.settings.embed_chars)
    asked = crawl.kept_table(asked.drop("expanded").withColumnRenamed("embedding", "vector"), "asked")
    hits = retrieval.retrieve(base.read("store"), asked, base.settings, rules.synonyms, rules.facts, index=base.index())
    hits = crawl.kept_table(hits, "hits")
    messages = retrieval.prompts(asked, retrieval.context_block(hits), rules.offices, history, rules.system_it, rules.system_en, base.settings)
    sources = hits.groupBy("query_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("position", "source", "title"))), lambda x: F.struct(x["source"].alias("source"), x["title"].alias("title"))).alias("sources"))
    return questions.select("query_id", "question").join(messages, "query_id").join(sources, "query_id", "left")


def evaluate(base: Base, cases: DataFrame, rules: Rules, answers: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Retrieval (and, with answers, keywords) of cases (query_id, question, expected_keywords, min_chunks): the results,
    which are kept as the next version of the base's `eval` table, and their summary."""
    none = base.spark.createDataFrame([], "query_id long, turn int, role string, content string")
    found = answer(base, cases, rules, none).select("query_id", F.explode("sources").alias("s")).select("query_id", "s.source")
    path = readers.write_snapshot(evaluation.results(cases, found, answers), f"{base.root}/eval")
    results = base.spark.read.parquet(path)
    return results, evaluation.summary(results)
