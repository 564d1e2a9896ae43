"""Readers and writers: page indexes, crawl state, JSON-line logs, the sync log, inbox documents, rule files,
and versioned snapshots of tables."""

from __future__ import annotations

import io
import uuid
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import schemas
from ..config import Settings
from ..functions.text import clean_pdf, strip
from ..operators.telemetry import marked

_WORD = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
EXTENSIONS = ("pdf", "txt", "docx")


def read_index(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """A page index in one JSON file as tables of pages and of PDFs."""
    index = spark.read.schema(schemas.INDEX).json(path, multiLine=True)
    return index.select(F.explode("pages").alias("p")).select("p.*"), index.select(F.explode("pdfs").alias("p")).select("p.*")


def read_pages(spark: SparkSession, path: str, index: DataFrame | None = None) -> DataFrame:
    """Page documents (one JSON file each), only those in the index if one is given."""
    pages = spark.read.schema(schemas.PAGE).json(path, multiLine=True)
    return pages if index is None else pages.join(index.select("url"), "url", "left_semi")


def read_state(spark: SparkSession, path: str) -> DataFrame:
    """The crawl state, a JSON object by URL, as rows; a file that can't be parsed gives none."""
    text = spark.read.text(path, wholetext=True)
    entries = text.select(F.explode(F.map_entries(F.from_json("value", schemas.STATE_MAP))).alias("e"))
    return entries.select(F.col("e.key").alias("url"), "e.value.*")


def read_log(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A log of JSON lines without its malformed lines."""
    # Parsed from text, as a reader of JSON files refuses queries on the corrupt column alone.
    parsed = F.from_json("value", f"{schema}, _corrupt string", {"columnNameOfCorruptRecord": "_corrupt"})
    lines = spark.read.text(path).where(F.trim("value") != "").select(parsed.alias("p"))
    return lines.where("p._corrupt IS NULL").select("p.*").drop("_corrupt")


def append_log(rows: DataFrame, path: str) -> None:
    rows.write.mode("append").json(path)


def read_sync_log(spark: SparkSession, path: str) -> DataFrame:
    """Lines of the sync log that hold a marker, numbered from 0 by file name, then by their place in the file; lines
    without a marker count."""
    block = ["file", "block"]
    lines = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("row"), F.col("value").alias("line"))
    # Within a block of a file the rows ascend by one. A table of one row a block says how many lines lie before it.
    counts = lines.groupBy(*block).agg(F.min("row").alias("first"), F.count(F.lit(1)).alias("n"))
    before = F.coalesce(F.sum("n").over(Window.orderBy(*block).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ahead = counts.select(*block, (before - F.col("first")).alias("ahead"))
    return marked(lines).join(ahead, block).select((F.col("row") + F.col("ahead")).alias("line_no"), "line")


def read_offices(spark: SparkSession, path: str, settings: Settings) -> DataFrame:
    """Office rules in their order: (ord, keywords, name, url)."""
    text = spark.read.text(path, wholetext=True)
    rules = text.select(F.posexplode(F.from_json("value", f"array<struct<{_colons(schemas.OFFICE)}>>")).alias("ord", "o"))
    site = F.lit(settings.site_url.rstrip("/"))
    return rules.select("ord", "o.keywords", "o.name", F.when(F.col("o.path").isNotNull(), F.concat(site, "o.path")).otherwise(F.coalesce("o.url", F.lit(""))).alias("url"))


def read_synonyms(spark: SparkSession, path: str) -> DataFrame:
    """Synonyms in their order: (ord, term, synonyms)."""
    text = spark.read.text(path, wholetext=True)
    return text.select(F.posexplode(F.map_entries(F.from_json("value", "map<string,array<string>>"))).alias("ord", "e")).select("ord", F.col("e.key").alias("term"), F.col("e.value").alias("synonyms"))


def read_facts(spark: SparkSession, path: str, settings: Settings) -> DataFrame:
    """Known facts in their order. A fact with a source keeps it; one with a path only gets the site's address."""
    text = spark.read.text(path, wholetext=True)
    facts = text.select(F.posexplode(F.from_json("value", f"array<struct<{_colons(schemas.FACT)}>>")).alias("ord", "f")).select("ord", "f.*")
    site = F.lit(settings.site_url.rstrip("/"))
    return facts.select(
        "ord", "keywords", F.coalesce("require_any", "keywords").alias("require_any"), "text", "title",
        F.coalesce(F.nullif(F.col("source"), F.lit("")), F.concat(site, "source_path"), F.lit("")).alias("source"),
        F.coalesce("category", F.lit("pagina")).alias("category"),
    )


def _colons(schema: str) -> str:
    return ", ".join(f"{name}:{kind}" for name, kind in (f.strip().split(" ", 1) for f in schema.split(", ")))


# Inbox documents

def list_inbox(spark: SparkSession, path: str) -> DataFrame:
    """Supported files of a folder as (path, modificationTime, length, content), sorted by path."""
    files = spark.read.format("binaryFile").load(path)
    return files.where(F.lower("path").rlike(rf"\.({'|'.join(EXTENSIONS)})$")).orderBy("path")


def docx_text(content: bytes) -> str:
    """Paragraphs of a word-processor file that aren't blank, with an empty line between."""
    with zipfile.ZipFile(io.BytesIO(content)) as archive, archive.open("word/document.xml") as part:
        root = ElementTree.parse(part).getroot()
    found = ("".join(t.text or "" for t in p.iter(f"{_WORD}t")) for p in root.iter(f"{_WORD}p"))
    return "\n\n".join(p for p in found if p.strip())


def pdf_text(content: bytes) -> str:
    """Text of a PDF by page, each under its heading; needs the optional pypdf."""
    from pypdf import PdfReader

    pages = ((n, (page.extract_text() or "").strip()) for n, page in enumerate(PdfReader(io.BytesIO(content)).pages, 1))
    return "\n\n".join(f"[Pagina {n}]\n{text}" for n, text in pages if text)


def pdf_metadata(content: bytes, stem: str) -> tuple[str, str, int]:
    """Title (the file's stem if it has none), author and number of pages; of a broken file, the stem."""
    try:
        from pypdf import PdfReader

        reader = PdfReader(io.BytesIO(content))
        said = lambda v: v.decode("utf-8", "replace").strip() if isinstance(v, bytes) else str(v or "").strip()
        meta = reader.metadata or {}
        return said(meta.get("/Title")) or stem, said(meta.get("/Author")), len(reader.pages)
    except Exception:  # noqa: BLE001  a file that can't be read has no metadata
        return stem, "", 0


def inbox_texts(files: DataFrame) -> DataFrame:
    """(path, file, stem, ext, text, error): plain text natively, other formats by their extractors; a file that can't
    be read has its error and a null text."""
    name = F.regexp_extract("path", "([^/]+)$", 1)
    ext = F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1))
    named = files.select("path", name.alias("file"), F.regexp_replace(name, r"\.[^.]+$", "").alias("stem"), ext.alias("ext"), "content")
    plain = F.when(F.expr("is_valid_utf8(content)"), F.decode("content", "UTF-8")).otherwise(F.decode("content", "ISO-8859-1"))
    texts = named.where("ext = 'txt'").select("path", "file", "stem", "ext", plain.alias("text"), F.lit(None).cast("string").alias("error"))

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found, errors = [], []
            for kind, content in zip(batch["ext"].to_pylist(), batch["content"].to_pylist(), strict=True):
                try:
                    found.append({"docx": docx_text, "pdf": pdf_text}[kind](content))
                    errors.append(None)
                except Exception as e:  # noqa: BLE001  reported in the row
                    found.append(None)
                    errors.append(f"{type(e).__name__}: {e}")
            columns = [*(batch[c] for c in ("path", "file", "stem", "ext")), pa.array(found, pa.string()), pa.array(errors, pa.string())]
            yield pa.RecordBatch.from_arrays(columns, ["path", "file", "stem", "ext", "text", "error"])

    others = named.where("ext <> 'txt'").mapInArrow(extract, "path string, file string, stem string, ext string, text string, error string")
    return texts.unionByName(others.withColumn("text", F.when(F.col("ext") == "pdf", clean_pdf(F.col("text"))).otherwise(F.col("text"))))


def read_sidecars(spark: SparkSession, path: str) -> DataFrame:
    """(stem, title, source_url, category) of a folder's JSON files; one that can't be parsed gives nulls."""
    files = spark.read.option("pathGlobFilter", "*.json").text(path, wholetext=True)
    stem = F.regexp_extract(F.col("_metadata.file_name"), r"^(.*)\.[^.]+$", 1)
    return files.select(stem.alias("stem"), F.from_json("value", schemas.SIDECAR).alias("m")).select("stem", "m.*")


def with_sidecars(texts: DataFrame, sidecars: DataFrame) -> DataFrame:
    """Texts of at least 100 characters with title, source and category of the sidecar of the same stem, or defaults."""
    found = texts.where(F.length(strip(F.coalesce("text", F.lit("")))) >= 100).join(sidecars, "stem", "left")
    return found.select(
        F.col("text"),
        F.coalesce(F.nullif("title", F.lit("")), "stem").alias("title"),
        F.coalesce(F.nullif("source_url", F.lit("")), F.concat(F.lit("file://"), "file")).alias("source"),
        F.coalesce("category", F.lit("documento")).alias("category"),
        F.when(F.col("ext") == "pdf", "pdf").otherwise("document").alias("doc_type"),
        F.col("file").alias("filename"),
    )


def move_with_sidecar(spark: SparkSession, path: str, folder: str) -> None:
    """Move a file, and the JSON file of its stem if there is one, into a folder."""
    jvm = spark.sparkContext._jvm
    source, target = jvm.org.apache.hadoop.fs.Path(path), jvm.org.apache.hadoop.fs.Path(folder)
    fs = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    fs.mkdirs(target)
    sidecar = jvm.org.apache.hadoop.fs.Path(source.getParent(), source.getName().rpartition(".")[0] + ".json")
    for one in (source, sidecar):
        if fs.exists(one):
            fs.rename(one, jvm.org.apache.hadoop.fs.Path(target, one.getName()))


# Snapshots: each write makes a new version, and readers see the newest that is complete

def write_snapshot(df: DataFrame, root: str, keep: int = 7) -> str:
    """Write df as the next version of a table, which may be what df reads; versions beyond `keep` go."""
    spark = df.sparkSession
    jvm = spark.sparkContext._jvm
    base = jvm.org.apache.hadoop.fs.Path(root)
    fs = base.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    versions = snapshot_versions(spark, root)
    name = f"v{(versions[-1] if versions else 0) + 1:012d}"
    temporary = f"{root}/.{name}-{uuid.uuid4().hex}"
    df.write.parquet(temporary)
    fs.rename(jvm.org.apache.hadoop.fs.Path(temporary), jvm.org.apache.hadoop.fs.Path(f"{root}/{name}"))
    for old in [*versions, int(name[1:])][:-keep]:
        fs.delete(jvm.org.apache.hadoop.fs.Path(f"{root}/v{old:012d}"), True)
    return f"{root}/{name}"


def snapshot_versions(spark: SparkSession, root: str) -> list[int]:
    jvm = spark.sparkContext._jvm
    base = jvm.org.apache.hadoop.fs.Path(root)
    fs = base.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(base):
        return []
    names = (s.getPath().getName() for s in fs.listStatus(base))
    return sorted(int(n[1:]) for n in names if n.startswith("v") and n[1:].isdigit())


def read_snapshot(spark: SparkSession, root: str, schema: str) -> DataFrame:
    """The newest version of a table; an empty one if there is none."""
    versions = snapshot_versions(spark, root)
    if not versions:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(f"{root}/v{versions[-1]:012d}")
