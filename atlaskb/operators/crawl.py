"""Crawling as joins: change detection against the stored state, removed pages, index merges, the link closure."""

from __future__ import annotations

import atexit
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import Settings


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder: the session's spark.checkpoint.dir, or, only where that is unset, the
    context's checkpoint folder or the warehouse."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    root = root or spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_scratch"
    path = f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"
    _made.append((spark, path))
    return path


#: What scratch() gave out and drop() hasn't deleted; it goes when the driver ends.
_made: list[tuple[SparkSession, str]] = []


def drop(spark: SparkSession, path: str) -> None:
    context = spark.sparkContext
    target = context._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(context._jsc.hadoopConfiguration()).delete(target, True)
    _made.remove((spark, path))


@atexit.register
def _sweep() -> None:
    for spark, path in list(_made):
        if spark.sparkContext._jsc is not None:
            try:
                drop(spark, path)
            except Exception:  # noqa: BLE001  the JVM may be gone at exit; the folder is scratch
                return


def kept_table(df: DataFrame, name: str) -> DataFrame:
    """df as a table in the shared folder, so that what is made from it has a short lineage."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def diff(pages: DataFrame, state: DataFrame, *carried: str) -> DataFrame:
    """(url, hash, status): new, changed or unchanged against the state's hash; pages has url and html, and the columns `carried` along."""
    seen = pages.select("url", F.md5("html").alias("hash"), *carried).join(state.select("url", F.col("hash").alias("old"), F.lit(True).alias("known")), "url", "left")
    status = F.when(F.col("known").isNull(), "new").when(F.col("hash").eqNullSafe(F.col("old")), "unchanged").otherwise("changed")
    return seen.select("url", "hash", status.alias("status"), *carried)


def removed(state: DataFrame, seen: DataFrame) -> DataFrame:
    return state.join(seen.select("url"), "url", "left_anti")


def merge_state(state: DataFrame, found: DataFrame, now: str) -> DataFrame:
    """The state after a crawl that saw `found` (url, hash, title, file): unseen URLs go, changed ones are marked."""
    old = state.select("url", F.col("hash").alias("old_hash"), F.col("last_crawled").alias("old_time"), F.col("title").alias("old_title"), F.col("file").alias("old_file"), F.lit(True).alias("known"))
    same = F.col("known").isNotNull() & F.col("hash").eqNullSafe(F.col("old_hash"))
    either = lambda old, new: F.when(same, F.col(old)).otherwise(new)
    return found.join(old, "url", "left").select(
        "url", "hash", either("old_time", F.lit(now)).alias("last_crawled"), either("old_title", F.col("title")).alias("title"),
        either("old_file", F.col("file")).alias("file"), (~same).alias("changed"),
    )


def merge_index(old: DataFrame, new: DataFrame, key: str = "url") -> DataFrame:
    """old with the rows of new in place of those with the same key, and the others added."""
    mine, theirs = old.alias("o"), new.alias("n")
    columns = [F.when(F.col(f"n.{key}").isNotNull(), F.col(f"n.{c}")).otherwise(F.col(f"o.{c}")).alias(c) for c in old.columns]
    return mine.join(theirs, F.col(f"o.{key}") == F.col(f"n.{key}"), "full").select(*columns)


def not_indexed(pages: DataFrame, chunks: DataFrame, key: str = "url") -> DataFrame:
    """The pages whose key is the source of no chunk."""
    return pages.join(chunks.select(F.col("source").alias(key)).distinct(), key, "left_anti")


def closure(edges: DataFrame, seeds: DataFrame, max_depth: int | None = None, max_pages: int = 0) -> DataFrame:
    """(url, depth) of all URLs that links reach from the seeds, breadth first; edges are (src, dst). Each level joins
    only its frontier, and each frontier is a table of its own, so the plan grows by a scan a level."""
    frontier = kept_table(seeds.select("url").distinct().withColumn("depth", F.lit(0)), "frontier")
    visited, depth, n = frontier, 0, frontier.count() if max_pages else 0
    while max_depth is None or depth < max_depth:
        depth += 1
        reached = edges.join(frontier.select(F.col("url").alias("src")), "src", "left_semi").select(F.col("dst").alias("url")).distinct()
        fresh = reached.join(visited, "url", "left_anti").withColumn("depth", F.lit(depth))
        if max_pages:
            fresh = fresh.orderBy("url").limit(max(max_pages - n, 0))
        frontier = kept_table(fresh, "frontier")
        if frontier.isEmpty():
            break
        n += frontier.count() if max_pages else 0
        visited = visited.unionByName(frontier)
    return visited


def routed(fetched: DataFrame) -> DataFrame:
    """Fetched resources (url, content_type, body, error) with their kind: html, pdf, other or error."""
    said = F.lower(F.coalesce("content_type", F.lit("")))
    kind = F.when(F.col("error").isNotNull(), "error").when(said.contains("text/html"), "html").when(said.contains("application/pdf"), "pdf").otherwise("other")
    return fetched.withColumn("kind", kind)


def unknown_pdfs(links: DataFrame, known: DataFrame) -> DataFrame:
    """(url) of linked PDFs that the index doesn't have."""
    return links.select(F.col("link").alias("url")).distinct().join(known.select("url"), "url", "left_anti")


def long_enough(pages: DataFrame, settings: Settings) -> DataFrame:
    """Pages whose cleaned text is worth an entry of the index."""
    return pages.where(F.length(F.coalesce("text", F.lit(""))) >= settings.least_page_chars)


def clean_up(pages: DataFrame, pdfs: DataFrame, state: DataFrame, skip, sample: int = 5) -> dict[str, DataFrame]:
    """What a clean-up of an index would do: the tables kept, counts by table (part, kept, dropped), the files to delete,
    pages before PDFs, and the first dropped URLs of each table."""
    parts = {"pages": pages, "pdfs": pdfs, "state": state}
    flagged = {name: keep_or_drop(t, skip(F.col("url"))) for name, t in parts.items()}
    found = {name: t.where("NOT dropped").drop("dropped") for name, t in flagged.items()}
    counts, files, samples = [], [], []
    for place, (name, t) in enumerate(flagged.items()):
        counts.append(t.agg(F.lit(name).alias("part"), F.count_if(~F.col("dropped")).alias("kept"), F.count_if("dropped").alias("dropped")))
        if name != "state":
            files.append(t.where("dropped AND coalesce(file, '') <> ''").select(F.lit(place).alias("place"), "url", "file"))
            samples.append(t.where("dropped").orderBy("url").limit(sample).select(F.lit(name).alias("part"), "url"))
    union = lambda ts: ts[0] if len(ts) == 1 else ts[0].unionByName(union(ts[1:]))
    return found | {"counts": union(counts), "files": union(files), "sample": union(samples)}


def keep_or_drop(index: DataFrame, skip) -> DataFrame:
    """index with a column `dropped`, for a clean-up that lists both sides."""
    return index.withColumn("dropped", skip)
