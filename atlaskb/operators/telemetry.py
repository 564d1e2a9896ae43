"""Usage, cost, feedback and crawl history from append-only logs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import LOG_MARKERS, Settings
from ..functions.text import cache_key, normalised_query


def gap_rows(queries: DataFrame) -> DataFrame:
    """Log rows of questions that found few chunks: ts, the question's first 200 characters, chunks."""
    return queries.select("ts", F.substring("question", 1, 200).alias("query"), "chunks")


def feedback_rows(rows: DataFrame) -> DataFrame:
    return rows.where(F.col("rating").between(-1, 1)).select("ts", "rating", F.substring("question", 1, 200).alias("question"), F.substring("answer", 1, 100).alias("answer_preview"))


def feedback_summary(feedback: DataFrame) -> DataFrame:
    """One row: positive, negative, their total (neutral ratings aside) and all."""
    p, n = F.count_if(F.col("rating") == 1), F.count_if(F.col("rating") == -1)
    return feedback.agg(p.alias("positive"), n.alias("negative"), (p + n).alias("total"), F.count(F.lit(1)).alias("entries"))


def tail(rows: DataFrame, n: int, order: list[str]) -> DataFrame:
    """The last n rows, oldest first: the cut is a top-k, not a sort of all."""
    return rows.orderBy(*(F.desc(c) for c in order)).limit(n).orderBy(*order)


def query_frequency(log: DataFrame, k: int, question: str = "question", order: str = "seq") -> DataFrame:
    """The k most frequent normalised questions; equals by first appearance."""
    counts = log.groupBy(normalised_query(F.col(question)).alias("query")).agg(F.count(F.lit(1)).alias("n"), F.min(order).alias("first_"))
    return counts.orderBy(F.desc("n"), "first_", "query").limit(k).select("query", "n")


def hour_histogram(log: DataFrame, ts: str = "ts") -> DataFrame:
    """(hour, n) for all 24 hours."""
    counts = log.groupBy(F.hour(ts).alias("hour")).agg(F.count(F.lit(1)).alias("n"))
    hours = log.sparkSession.range(24).select(F.col("id").cast("int").alias("hour"))
    return hours.join(counts, "hour", "left").select("hour", F.coalesce("n", F.lit(0)).alias("n"))


def mean_response_ms(log: DataFrame, n: int = 100, seconds: str = "seconds", order: str = "seq") -> DataFrame:
    """The mean of the last n response times in whole milliseconds."""
    return log.orderBy(F.desc(order)).limit(n).agg(F.floor(F.avg(seconds) * 1000).alias("avg_response_ms"))


def rolling_mean(log: DataFrame, value: str, order: str, key: str, n: int = 100) -> DataFrame:
    """log with `rolling`: the mean of the last n values of the row's key."""
    w = Window.partitionBy(key).orderBy(order).rowsBetween(-(n - 1), 0)
    return log.withColumn("rolling", F.avg(value).over(w))


def cost(tokens_in: Column, tokens_out: Column, model: Column, settings: Settings) -> Column:
    """US dollars by the first price whose prefix the model's name has; 0 without one."""
    out = F.lit(0.0)
    for prefix, price_in, price_out in reversed(settings.prices):
        out = F.when(model.startswith(prefix), (tokens_in * price_in + tokens_out * price_out) / 1_000_000).otherwise(out)
    return out


def token_totals(records: DataFrame, settings: Settings) -> DataFrame:
    priced = records.withColumn("cost", cost(F.col("in"), F.col("out"), F.col("model"), settings))
    return priced.agg(
        F.sum("in").alias("token_in_total"), F.sum("out").alias("token_out_total"), F.round(F.sum("cost"), 4).alias("token_cost_total"),
        F.floor(F.avg("in")).alias("token_avg_in"), F.floor(F.avg("out")).alias("token_avg_out"),
    )


def rate_limited(log: DataFrame, per_hour: int, key: str, ts: str = "ts", order: str = "seq") -> DataFrame:
    """log with `allowed`: the first per_hour requests of a key in each clock hour."""
    w = Window.partitionBy(key, F.date_trunc("hour", ts)).orderBy(ts, order)
    return log.withColumn("allowed", F.row_number().over(w) <= per_hour)


def cache_hits(log: DataFrame, question: str = "question", order: str = "seq") -> DataFrame:
    """log with its cache key and whether an equal question came before (a cache without a size limit)."""
    key = cache_key(F.col(question))
    first = log.groupBy(key.alias("key")).agg(F.min(order).alias("first_"))
    return log.withColumn("key", key).join(first, "key").withColumn("hit", F.col(order) > F.col("first_")).drop("first_")


def lru_hits(keys: list[str], entries: int = 200) -> list[bool]:
    """Which requests an LRU cache of that many entries answers; the sequential rule that a state store applies."""
    held: dict[str, None] = {}
    out = []
    for key in keys:
        out.append(key in held)
        held.pop(key, None)
        held[key] = None
        if len(held) > entries:
            del held[next(iter(held))]
    return out


#: Line numbers of a range, in which a window carries time stamps forward; between ranges only the last stamps go on.
RANGE = 10_000


def _carried(lines: DataFrame, own: Column) -> DataFrame:
    """lines with `ts`: the stamp of the line or of the last one before it that had any, else an empty text."""
    ranged = lines.withColumn("own_", F.nullif(own, F.lit(""))).withColumn("range_", F.expr(f"line_no DIV {RANGE}"))
    last = ranged.groupBy("range_").agg(F.max_by("own_", F.when(F.col("own_").isNotNull(), F.col("line_no"))).alias("last_"))
    # One row a range, so one partition orders them.
    before = F.last("last_", ignorenulls=True).over(Window.orderBy("range_").rowsBetween(Window.unboundedPreceding, -1))
    within = F.last("own_", ignorenulls=True).over(Window.partitionBy("range_").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0))
    filled = ranged.withColumn("within_", within).join(last.select("range_", before.alias("before_")), "range_", "left")
    return filled.withColumn("ts", F.coalesce("within_", "before_", F.lit(""))).drop("own_", "range_", "within_", "before_")


def marked(lines: DataFrame) -> DataFrame:
    """Lines that hold a marker; all others are noise, whose time stamps don't count either."""
    return lines.where(F.exists(F.array(*map(F.lit, LOG_MARKERS)), lambda m: F.contains(F.col("line"), m)))


def crawl_events(lines: DataFrame, first_only: bool = True) -> DataFrame:
    """Events of the sync log's lines (line_no, line): type, label, chunks or pages, with the time of the line or of the
    last marked one that had any. A store size is reported the first time it is met only, if first_only.
    Markers and labels are fixed wording."""
    lines = marked(lines)
    stamp = r"^(\d{4}-\d{2}-\d{2} \d{2}:\d{2}):\d{2},\d+ \[INFO\] (.+)$"
    own = F.regexp_extract("line", stamp, 1)
    text = F.trim(F.when(own != "", F.regexp_extract("line", stamp, 2)).otherwise(F.col("line")))
    number = lambda pattern, i=1: F.expr("null").cast("long") if pattern is None else F.nullif(F.regexp_extract(text, pattern, i), F.lit("")).cast("long")
    current, total = number(r"\[HTML (\d+)/(\d+)\]"), number(r"\[HTML (\d+)/(\d+)\]", 2)
    kind = (
        F.when(text.contains("Crawl incrementale completato") | text.contains("=== Crawl"), "crawl_end")
        .when(text.contains("Vector store caricato:"), F.when(number(r"(\d+) chunk").isNotNull(), "vs_loaded"))
        .when(current.isNotNull(), F.when(current == total, "html_done").otherwise("html"))
        .when(number(r"\[PDF (\d+)/(\d+)\]").isNotNull(), "pdf")
    )
    events = _carried(lines, own).select(
        "line_no", "ts", kind.alias("type"),
        F.when(kind == "vs_loaded", number(r"(\d+) chunk")).alias("chunks"),
        F.when(kind.isin("html", "html_done"), current).when(kind == "pdf", number(r"\[PDF (\d+)/(\d+)\]")).alias("current"),
        F.when(kind.isin("html", "html_done"), total).when(kind == "pdf", number(r"\[PDF (\d+)/(\d+)\]", 2)).alias("total"),
    ).where("type IS NOT NULL")
    label = (
        F.when(F.col("type") == "crawl_end", "Crawl HTML completato")
        .when(F.col("type") == "vs_loaded", F.concat(F.lit("Vector store: "), F.format_number("chunks", 0), F.lit(" chunk")))
        .when(F.col("type") == "html_done", F.concat(F.lit("HTML: "), F.format_number("total", 0), F.lit(" pagine completate")))
    )
    if not first_only:
        return events.withColumn("label", label)
    met = events.where("type = 'vs_loaded'").groupBy("chunks").agg(F.min_by(F.struct(*events.columns), "line_no").alias("e")).select("e.*")
    return events.where("type <> 'vs_loaded'").union(met).withColumn("label", label)


def crawl_history(lines: DataFrame, n: int = 20) -> DataFrame:
    """The last n events for display."""
    return tail(crawl_events(lines).where("label IS NOT NULL"), n, ["line_no"])


def crawl_progress(lines: DataFrame) -> DataFrame:
    """The last seen progress of pages and of PDFs."""
    seen = crawl_events(lines).where("type IN ('html', 'html_done', 'pdf')")
    return seen.groupBy(F.when(F.col("type") == "pdf", "pdf").otherwise("html").alias("kind")).agg(F.max_by(F.struct("ts", "current", "total"), "line_no").alias("p")).select("kind", "p.*")
