"""Queries on logs: questions, answers, ratings, tokens, rate limits, the sync log and streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import ENGLISH, ITALIAN, Settings
from ..functions import text as T
from ..operators import retrieval, telemetry

S = Settings(prices=(("large", 15.0, 75.0), ("medium", 3.0, 15.0), ("small", 0.8, 4.0)))


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/events.parquet")


def talk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users' questions in sequence."""
    return spark.read.parquet(f"{sf_dir}/conversations.parquet").where("role = 'user'").select((F.col("conv_id") * 1000 + F.col("turn")).alias("seq"), F.col("text").alias("question"))


def query_freq(spark: SparkSession, sf_dir: str) -> DataFrame:
    return telemetry.query_frequency(talk(spark, sf_dir), 100)


def hour_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = telemetry.hour_histogram(events(spark, sf_dir))
    return found.select(F.col("hour").cast("long").alias("hour"), "n")


def mean_response(spark: SparkSession, sf_dir: str) -> DataFrame:
    return telemetry.mean_response_ms(events(spark, sf_dir).where("event_type = 'click'"), 100, "value", "event_id")


def rolling_avg(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = telemetry.rolling_mean(events(spark, sf_dir), "value", "event_id", "user_id")
    return found.select("event_id", F.round("rolling", 8).alias("rolling"))


def last_n(spark: SparkSession, sf_dir: str) -> DataFrame:
    return telemetry.tail(events(spark, sf_dir).select("event_id", "event_type", "user_id"), 50, ["event_id"])


def ratings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", F.when(F.col("toxic") == 1, -1).when(F.col("quality") == 1, 1).otherwise(0).alias("rating"))


def feedback_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return telemetry.feedback_summary(ratings(spark, sf_dir))


def negative_tail(spark: SparkSession, sf_dir: str) -> DataFrame:
    texts = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", F.substring("text", 1, 200).alias("question"))
    last = telemetry.tail(ratings(spark, sf_dir).where("rating = -1"), 20, ["doc_id"])
    return last.join(texts, "doc_id").select("doc_id", "question")


def gap_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet").where("role = 'user'").select((F.col("conv_id") * 1000 + F.col("turn")).cast("string").alias("ts"), F.col("text").alias("question"), (F.col("turn") % 3).alias("chunks"))
    found = telemetry.gap_rows(rows.where("chunks = 0"))
    return found.agg(F.count(F.lit(1)).alias("gaps"), F.max(F.length("query")).cast("long").alias("longest"))


def _tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = F.element_at(F.array(F.lit("large-2"), F.lit("medium-1"), F.lit("small"), F.lit("other")), (F.col("conv_id") % 4 + 1).cast("int"))
    return spark.read.parquet(f"{sf_dir}/conversations.parquet").where("role = 'assistant'").select(F.length("text").cast("long").alias("in"), (F.length("text") * 2).cast("long").alias("out"), model.alias("model"))


def token_cost(spark: SparkSession, sf_dir: str) -> DataFrame:
    return telemetry.token_totals(_tokens(spark, sf_dir), S)


def token_cost_by_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    priced = _tokens(spark, sf_dir).withColumn("cost", telemetry.cost(F.col("in"), F.col("out"), F.col("model"), S))
    return priced.groupBy("model").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("cost"), 6).alias("cost"))


def rate_limit(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = telemetry.rate_limited(events(spark, sf_dir), 1, "user_id", "ts", "event_id")
    return found.groupBy("user_id").agg(F.count_if("allowed").alias("allowed"), F.count_if(~F.col("allowed")).alias("refused"))


def cache_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = telemetry.cache_hits(talk(spark, sf_dir))
    return found.agg(F.count(F.lit(1)).alias("requests"), F.count_if("hit").alias("hits"))


def _log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A sync log made of events."""
    stamp = F.concat(F.date_format("ts", "yyyy-MM-dd HH:mm:ss"), F.lit(",000 [INFO] "))
    k, n = F.col("event_id") % 5, F.col("event_id").cast("string")
    line = (
        F.when(k == 0, F.concat(stamp, F.lit("Vector store caricato: "), (F.col("event_id") % 70 * 100).cast("string"), F.lit(" chunk")))
        .when(k == 1, F.lit("=== Crawl completato ==="))
        .when(k == 2, F.concat(stamp, F.lit("[HTML "), n, F.lit("/"), F.when(F.col("event_id") % 2 == 0, n).otherwise("99999"), F.lit("]")))
        .when(k == 3, F.concat(stamp, F.lit("[PDF "), n, F.lit("/99999]")))
        .otherwise(F.concat(stamp, F.lit("nothing")))
    )
    return events(spark, sf_dir).select(F.col("event_id").alias("line_no"), line.alias("line"))


def crawl_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = telemetry.crawl_history(_log(spark, sf_dir))
    return found.select("line_no", "ts", "type", "label")


def crawl_progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    return telemetry.crawl_progress(_log(spark, sf_dir))


def prompt_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    messages = spark.read.parquet(f"{sf_dir}/conversations.parquet").where("role <> 'system'")
    last = retrieval.last_messages(messages, 6)
    return last.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n"), F.min("turn").alias("first_turn"), F.max("turn").alias("last_turn"))


def prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A prompt for each conversation's last question, without context, so that the hint is used."""
    c = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    last = c.where("role = 'user'").groupBy("conv_id").agg(F.max_by("text", "turn").alias("question"))
    queries = last.select(F.col("conv_id").alias("query_id"), "question")
    offices = spark.createDataFrame([(0, ["that"], "Desk", "/d")], "ord int, keywords array<string>, name string, url string")
    none = spark.createDataFrame([], "query_id long, context string")
    history = c.select(F.col("conv_id").alias("query_id"), "turn", "role", F.col("text").alias("content"))
    found = retrieval.prompts(queries, none, offices, history, "it", "en", S)
    user = F.element_at("messages", -1)["content"]
    return found.select("query_id", F.size("messages").cast("long").alias("n_messages"), F.element_at("messages", 1)["content"].alias("system"), F.md5(user).alias("user_md5"))


def valid_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    requests = c.select(F.when(F.col("turn") == 1, F.lit("  ")).otherwise(F.col("text")).alias("question"), F.array(F.struct(F.col("role").alias("role"), F.lit("x").alias("content"))).alias("history"))
    return retrieval.valid_requests(requests).groupBy(F.coalesce("error", F.lit("")).alias("error")).agg(F.count(F.lit(1)).alias("n"))


def format_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = F.concat(F.lit('**bold** & <b> [site](https://a.example/x?y=1&z=2) mail a.b@c.example "q"\n'), "text")
    out = T.format_text(raw)
    return spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", F.md5(out).alias("html_md5"), F.length(out).cast("long").alias("n_chars"))


def hourly_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..streaming import streams

    return streams.hourly_counts(events(spark, sf_dir)).groupBy("event_type").agg(F.count(F.lit(1)).alias("hours"), F.max("n").alias("busiest"))


def stream_hourly(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The hourly counts of a stream of the events, drained into a table in memory."""
    import uuid

    from ..streaming import streams

    # A glob of folders or files: the table may be either.
    source = spark.readStream.schema(events(spark, sf_dir).schema).parquet(f"{sf_dir}/events.parquet*")
    name = f"hourly_{uuid.uuid4().hex}"
    query = streams.running_counts(source, "event_type").writeStream.format("memory").queryName(name).outputMode("complete").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.table(name)


def stream_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The hours that the watermark closes in a stream of the events, drained into a table in memory."""
    import uuid

    from ..streaming import streams

    source = spark.readStream.schema(events(spark, sf_dir).schema).parquet(f"{sf_dir}/events.parquet*")
    name = f"windows_{uuid.uuid4().hex}"
    query = streams.hourly_counts(source.withColumn("ts", F.col("ts").cast("timestamp"))).writeStream.format("memory").queryName(name).outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.table(name).withColumn("hour", F.col("hour").cast("timestamp_ntz"))


def stream_over_limit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users with more requests in an hour than allowed, in the hours that the watermark closes."""
    import uuid

    from ..streaming import streams

    source = spark.readStream.schema(events(spark, sf_dir).schema).parquet(f"{sf_dir}/events.parquet*").withColumn("ts", F.col("ts").cast("timestamp"))
    name = f"over_{uuid.uuid4().hex}"
    streams.over_limit(source, 1).writeStream.format("memory").queryName(name).outputMode("append").trigger(availableNow=True).start().awaitTermination()
    return spark.table(name).withColumn("hour", F.col("hour").cast("timestamp_ntz"))


def stream_append(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Feedback of a stream, appended to a log of JSON lines and read back."""
    from .. import schemas
    from ..operators import crawl
    from ..sources import readers
    from ..streaming import streams

    schema = spark.read.parquet(f"{sf_dir}/conversations.parquet").schema
    source = spark.readStream.schema(schema).parquet(f"{sf_dir}/conversations.parquet*")
    rows = source.select(F.col("conv_id").cast("string").alias("ts"), (F.col("turn") % 4 - 1).cast("int").alias("rating"), F.col("text").alias("question"), F.col("text").alias("answer"))
    path = crawl.scratch(spark, "feedback")
    streams.append_stream(telemetry.feedback_rows(rows), path, crawl.scratch(spark, "checkpoint")).awaitTermination()
    found = readers.read_log(spark, path, schemas.FEEDBACK)
    return found.groupBy("rating").agg(F.count(F.lit(1)).alias("n"), F.max(F.length("question")).cast("long").alias("longest"), F.max(F.length("answer_preview")).cast("long").alias("longest_answer"))


def log_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A log of JSON lines, some blank, some malformed, read without those."""
    from .. import schemas
    from ..operators import crawl
    from ..sources import readers

    e = events(spark, sf_dir)
    k, json = F.col("event_id") % 5, F.to_json(F.struct(F.col("event_id").cast("string").alias("ts"), F.col("event_type").alias("query"), (F.col("event_id") % 3).cast("int").alias("chunks")))
    line = F.when(k == 0, "").when(k == 1, "   ").when(k == 2, F.concat(F.lit("not json "), json)).otherwise(json)
    path = crawl.scratch(spark, "gaps")
    e.select(line.alias("line")).write.text(path)
    return readers.read_log(spark, path, schemas.GAP).groupBy("query", F.col("chunks").cast("long").alias("chunks")).agg(F.count(F.lit(1)).alias("n"), F.max("ts").alias("last"))


def keyword_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The share of expected keywords in answers."""
    from ..operators import evaluation

    keywords = F.when(F.col("turn") % 5 == 0, F.array().cast("array<string>")).otherwise(F.array(F.lit("the"), F.lit("que"), F.lit("und")))
    answers = spark.read.parquet(f"{sf_dir}/conversations.parquet").where("role = 'assistant'")
    return answers.select("conv_id", "turn", F.round(evaluation.keyword_score(F.col("text"), keywords), 6).alias("score"))


def sync_log_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole log written as text files and read back in order, without lines that have no marker."""
    from ..operators import crawl
    from ..sources import readers

    path = crawl.scratch(spark, "sync-log")
    _log(spark, sf_dir).repartitionByRange(3, "line_no").sortWithinPartitions("line_no").select("line").write.text(path)
    # The events' numbers come back as the order of the lines.
    lines = readers.read_sync_log(spark, path)
    numbered = telemetry.crawl_events(lines, first_only=False).select("line_no", "type")
    ids = _log(spark, sf_dir).agg(F.min("line_no").alias("low"))
    return numbered.crossJoin(F.broadcast(ids)).select((F.col("line_no") + F.col("low")).alias("line_no"), "type")


QUERIES = {
    f.__name__: f
    for f in (
        query_freq, hour_histogram, mean_response, rolling_avg, last_n, feedback_summary, negative_tail, gap_log, token_cost, token_cost_by_model, rate_limit,
        cache_hits, crawl_history, crawl_progress, prompt_history, prompts, valid_requests, format_text, hourly_events, stream_hourly, stream_windows, sync_log_lines, stream_over_limit, stream_append, log_lines, keyword_scores,
    )
}

_TALK = "talk AS (SELECT conv_id * 1000 + turn AS seq, text AS question FROM conversations WHERE role = 'user')"
_RATE = "r AS (SELECT doc_id, CASE WHEN toxic = 1 THEN -1 WHEN quality = 1 THEN 1 ELSE 0 END AS rating FROM labels)"
_TOK = "t AS (SELECT length(text) AS i, length(text) * 2 AS o, ['large-2', 'medium-1', 'small', 'other'][conv_id % 4 + 1] AS model FROM conversations WHERE role = 'assistant'), c AS (SELECT *, CASE WHEN starts_with(model, 'large') THEN (i * 15.0::DOUBLE + o * 75.0::DOUBLE) / 1000000 WHEN starts_with(model, 'medium') THEN (i * 3.0::DOUBLE + o * 15.0::DOUBLE) / 1000000 WHEN starts_with(model, 'small') THEN (i * 0.8::DOUBLE + o * 4.0::DOUBLE) / 1000000 ELSE 0 END AS cost FROM t)"
_LOG = """log AS (SELECT event_id AS line_no, event_id % 5 AS k, CASE WHEN event_id % 5 <> 1 THEN strftime(ts, '%Y-%m-%d %H:%M') END AS own, event_id % 70 * 100 AS chunks FROM events WHERE event_id % 5 <> 4),
filled AS (SELECT *, coalesce(last_value(own IGNORE NULLS) OVER (ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), '') AS ts FROM log),
ev AS (SELECT *, CASE k WHEN 0 THEN 'vs_loaded' WHEN 1 THEN 'crawl_end' WHEN 2 THEN CASE WHEN line_no % 2 = 0 THEN 'html_done' ELSE 'html' END ELSE 'pdf' END AS type,
  row_number() OVER (PARTITION BY k, CASE WHEN k = 0 THEN chunks ELSE line_no END ORDER BY line_no) AS seen FROM filled)"""
_LINK = 'target="_blank" rel="noopener" style="color:inherit;text-decoration:underline"'
_FORMAT = "replace(replace(replace(replace('**bold** & <b> [site](https://a.example/x?y=1&z=2) mail a.b@c.example \"q\"' || chr(10) || text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;')"
for _old, _new in (
    (r"&quot;\s+(?:target|rel|style|class)=[^\n<]*", ""),
    (r"\*\*(.+?)\*\*", r"<strong>\1</strong>"),
    (r"\[([^\]]+)\]\((https?://[^\s)]+)\)", rf'<a href="\2" {_LINK}>\1</a>'),
    (r"\[(https?://[^\]\s]+)\]", rf'<a href="\1" {_LINK}>\1</a>'),
    (r'(https?://(?:[^\s<>"&]|&amp;)+)', rf'<a href="\1" {_LINK}>\1</a>'),
    (r"([a-zA-Z0-9._%+\-]+@[a-zA-Z0-9.\-]+\.[a-zA-Z]{2,})", r'<a href="mailto:\1" style="color:inherit">\1</a>'),
    (r"\n", "<br>"),
):
    _FORMAT = f"regexp_replace({_FORMAT}, '{_old}', '{_new}', 'g')"
_STRIP = "regexp_replace({}, '^\\s+|\\s+$', '', 'g')"

SQL = {
    "query_freq": f"WITH {_TALK} SELECT query, n FROM (SELECT regexp_replace(regexp_replace(lower(question), '\\s+', ' ', 'g'), '^[?! ]+|[?! ]+$', '', 'g') AS query, count(*) AS n, min(seq) AS f FROM talk GROUP BY 1) ORDER BY n DESC, f, query LIMIT 100",
    "hour_histogram": "SELECT h AS hour, count(event_id) AS n FROM range(24) r(h) LEFT JOIN events ON hour(ts) = h GROUP BY h",
    "mean_response": "SELECT floor(avg(value) * 1000)::BIGINT AS avg_response_ms FROM (SELECT value FROM events WHERE event_type = 'click' ORDER BY event_id DESC LIMIT 100)",
    "rolling_avg": "SELECT event_id, round(avg(value) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN 99 PRECEDING AND CURRENT ROW), 8) AS rolling FROM events",
    "last_n": "SELECT event_id, event_type, user_id FROM events ORDER BY event_id DESC LIMIT 50",
    "feedback_summary": f"WITH {_RATE} SELECT count(*) FILTER (rating = 1) AS positive, count(*) FILTER (rating = -1) AS negative, count(*) FILTER (rating <> 0) AS total, count(*) AS entries FROM r",
    "negative_tail": f"WITH {_RATE} SELECT doc_id, substr(text, 1, 200) AS question FROM (SELECT doc_id FROM r WHERE rating = -1 ORDER BY doc_id DESC LIMIT 20) JOIN documents USING (doc_id)",
    "gap_log": "SELECT count(*) AS gaps, max(length(substr(text, 1, 200))) AS longest FROM conversations WHERE role = 'user' AND turn % 3 = 0",
    "token_cost": f"WITH {_TOK} SELECT sum(i)::BIGINT AS token_in_total, sum(o)::BIGINT AS token_out_total, round(sum(cost), 4) AS token_cost_total, floor(avg(i))::BIGINT AS token_avg_in, floor(avg(o))::BIGINT AS token_avg_out FROM c",
    "token_cost_by_model": f"WITH {_TOK} SELECT model, count(*) AS n, round(sum(cost), 6) AS cost FROM c GROUP BY model",
    "rate_limit": "SELECT user_id, count(*) FILTER (rn <= 1) AS allowed, count(*) FILTER (rn > 1) AS refused FROM (SELECT user_id, row_number() OVER (PARTITION BY user_id, date_trunc('hour', ts) ORDER BY ts, event_id) AS rn FROM events) GROUP BY user_id",
    "cache_hits": "WITH t AS (SELECT conv_id * 1000 + turn AS seq, " + _STRIP.format("lower(text)") + " AS k FROM conversations WHERE role = 'user') SELECT count(*) AS requests, count(*) - count(DISTINCT k) AS hits FROM t",
    "crawl_history": f"WITH {_LOG} SELECT line_no, ts, type, CASE type WHEN 'crawl_end' THEN 'Crawl HTML completato' WHEN 'vs_loaded' THEN 'Vector store: ' || format('{{:,}}', chunks) || ' chunk' ELSE 'HTML: ' || format('{{:,}}', line_no) || ' pagine completate' END AS label FROM ev WHERE type IN ('crawl_end', 'html_done') OR type = 'vs_loaded' AND seen = 1 ORDER BY line_no DESC LIMIT 20",
    "crawl_progress": f"WITH {_LOG} SELECT CASE WHEN k = 3 THEN 'pdf' ELSE 'html' END AS kind, arg_max(ts, line_no) AS ts, max(line_no) AS current, arg_max(CASE WHEN type = 'html_done' THEN line_no ELSE 99999 END, line_no) AS total FROM ev WHERE k IN (2, 3) GROUP BY 1",
    "prompt_history": "SELECT conv_id, count(*) AS n, min(turn) AS first_turn, max(turn) AS last_turn FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS b FROM conversations WHERE role <> 'system') WHERE b <= 6 GROUP BY conv_id",
    "prompts": "WITH q AS (SELECT conv_id AS query_id, arg_max(text, turn) AS question FROM conversations WHERE role = 'user' GROUP BY conv_id), h AS (SELECT conv_id AS query_id, least(count(*) FILTER (role <> 'system'), 6) AS n FROM conversations GROUP BY conv_id), w AS (SELECT query_id, list_distinct(regexp_split_to_array(lower(" + _STRIP.format("question") + "), '\\s+')) AS words FROM q) SELECT query_id, n + 2 AS n_messages, CASE WHEN len(list_intersect(words, {en})) > len(list_intersect(words, {it})) THEN 'en' ELSE 'it' END AS system, md5('DOMANDA: ' || question || chr(10) || chr(10) || '(Non ho trovato nella base di conoscenza informazioni specifiche su questo argomento. Dillo chiaramente all''utente.' || CASE WHEN contains(lower(question), 'that') THEN chr(10) || chr(10) || 'Per questo argomento puoi contattare: **Desk** — /d' ELSE '' END || ')') AS user_md5 FROM q JOIN h USING (query_id) JOIN w USING (query_id)",
    "valid_requests": "SELECT CASE WHEN length(q) > 1000 THEN 'question length' WHEN role NOT IN ('user', 'assistant') THEN 'history message' WHEN " + _STRIP.format("q") + " = '' THEN 'empty question' ELSE '' END AS error, count(*) AS n FROM (SELECT CASE WHEN turn = 1 THEN '  ' ELSE text END AS q, role FROM conversations) GROUP BY 1",
    "format_text": f"SELECT conv_id, turn, md5(t) AS html_md5, length(t) AS n_chars FROM (SELECT conv_id, turn, {_FORMAT} AS t FROM conversations)",
    "hourly_events": "SELECT event_type, count(*) AS hours, max(n) AS busiest FROM (SELECT event_type, date_trunc('hour', ts) AS h, count(*) AS n FROM events GROUP BY ALL) GROUP BY event_type",
    "stream_hourly": "SELECT event_type, count(*) AS n FROM events GROUP BY event_type",
    "stream_windows": "SELECT h AS hour, event_type, n FROM (SELECT date_trunc('hour', ts) AS h, event_type, count(*) AS n FROM events GROUP BY ALL) WHERE h + INTERVAL 1 HOUR <= (SELECT max(ts) - INTERVAL 2 HOUR FROM events)",
    "stream_over_limit": "SELECT h AS hour, user_id, n FROM (SELECT date_trunc('hour', ts) AS h, user_id, count(*) AS n FROM events GROUP BY ALL) WHERE n > 1 AND h + INTERVAL 1 HOUR <= (SELECT max(ts) - INTERVAL 2 HOUR FROM events)",
    "stream_append": "SELECT rating, count(*) AS n, max(length(substr(text, 1, 200))) AS longest, max(length(substr(text, 1, 100))) AS longest_answer FROM (SELECT turn % 4 - 1 AS rating, text FROM conversations) WHERE rating BETWEEN -1 AND 1 GROUP BY rating",
    "log_lines": "SELECT event_type AS query, event_id % 3 AS chunks, count(*) AS n, max(event_id::VARCHAR) AS last FROM events WHERE event_id % 5 > 2 GROUP BY ALL",
    "keyword_scores": "SELECT conv_id, turn, CASE WHEN turn % 5 = 0 THEN 1.0::DOUBLE ELSE round(len(list_filter(['the', 'que', 'und'], lambda k: contains(lower(text), k))) / 3, 6) END AS score FROM conversations WHERE role = 'assistant'",
    "sync_log_lines": f"WITH {_LOG} SELECT line_no, type FROM ev",
}


def _words(values: tuple[str, ...]) -> str:
    return "[" + ", ".join(f"'{v}'" for v in values) + "]"


SQL["prompts"] = SQL["prompts"].replace("{en}", _words(ENGLISH)).replace("{it}", _words(ITALIAN))
