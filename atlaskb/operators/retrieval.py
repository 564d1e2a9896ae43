"""From a question to context and prompt, for a batch of queries (query_id, question, vector)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import Settings
from ..functions.text import strip, word_set
from ..functions.vectors import starts_with_zeros
from .search import DIGITS, Index, hybrid


def expand(queries: DataFrame, synonyms: DataFrame) -> DataFrame:
    """queries with `expanded`: the question and the synonyms of all terms that it contains, in the rules' order.
    The rules (ord, term, synonyms) are a small dimension; each question meets them once."""
    hits = queries.select("query_id", "question").join(F.broadcast(synonyms), F.contains(F.lower("question"), F.col("term")))
    words = hits.groupBy("query_id").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("ord", "synonyms"))), lambda x: x["synonyms"])).alias("words"))
    more = F.when(F.size("words") > 0, F.concat(F.col("question"), F.lit(" "), F.array_join("words", " "))).otherwise(F.col("question"))
    return queries.join(words, "query_id", "left").withColumn("expanded", more).drop("words")


def suggest_office(queries: DataFrame, offices: DataFrame) -> DataFrame:
    """(query_id, name, url) of the first rule (ord, keywords, name, url) any of whose keywords the question contains."""
    low = F.lower("question")
    hits = queries.select("query_id", "question").join(F.broadcast(offices), F.exists("keywords", lambda k: F.contains(low, k)))
    best = hits.groupBy("query_id").agg(F.min_by(F.struct("name", "url"), "ord").alias("o"))
    return queries.select("query_id").join(best, "query_id", "left").select("query_id", "o.name", "o.url")


def known_facts(queries: DataFrame, facts: DataFrame) -> DataFrame:
    """(query_id, ord, text, title, source, category) of facts whose keywords and required words both meet the question."""
    asked = queries.select("query_id", word_set(F.col("question")).alias("words"))
    meets = F.arrays_overlap("words", "keywords") & F.arrays_overlap("words", "require_any")
    return asked.join(F.broadcast(facts), meets).select("query_id", "ord", "text", "title", "source", "category")


def first_by(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The first row of each key; a partial aggregate, not a sort."""
    rest = [c for c in rows.columns if c not in keys]
    return rows.groupBy(*keys).agg(F.min_by(F.struct(*rest), order).alias("r")).select(*keys, "r.*")


def dedup(hits: DataFrame) -> DataFrame:
    """Hits without empty texts and texts met before (by rank), white space at the ends aside."""
    keyed = hits.withColumn("text_key", F.md5(strip(F.coalesce("text", F.lit(""))))).where(strip(F.coalesce("text", F.lit(""))) != "")
    return first_by(keyed, ["query_id", "text_key"], "rank").drop("text_key").select(*hits.columns)


def rerank(hits: DataFrame, queries: DataFrame, settings: Settings) -> DataFrame:
    """hits with `rscore` and `position`: title words and the favoured category lift a hit, earlier hits of its source
    lower it; equals keep their order."""
    asked = queries.select("query_id", word_set(F.col("question")).alias("words"))
    earlier = F.row_number().over(Window.partitionBy("query_id", F.coalesce("source", F.lit(""))).orderBy("rank")) - 1
    overlap = F.size(F.array_intersect("words", word_set(F.coalesce("title", F.lit("")))))
    score = (
        F.col("score")
        + overlap * settings.title_boost
        + F.when(F.col("category") == settings.boosted_category, settings.category_boost).otherwise(0.0)
        - earlier * settings.repeat_penalty
    )
    scored = hits.join(asked, "query_id").withColumn("rscore", F.round(score, DIGITS)).drop("words")
    return scored.withColumn("position", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("rscore"), "rank")))


def retrieve(chunks: DataFrame, queries: DataFrame, settings: Settings, synonyms: DataFrame | None = None, facts: DataFrame | None = None, known_bug: bool = False, index: Index | None = None) -> DataFrame:
    """(query_id, position, text, title, source, category, score): known facts, then the best chunks, top_k in all.
    Chunks have chunk_id, text, title, source, category and embedding. Queries whose vector starts with zeros are
    ranked by BM25 alone and filtered by their fused score; known_bug filters them by their cosine, which is 0."""
    expanded = expand(queries, synonyms) if synonyms is not None else queries.withColumn("expanded", F.col("question"))
    blind = starts_with_zeros(F.col("vector"))
    asked = expanded.select("query_id", F.col("expanded").alias("question"), "vector", blind.alias("blind"))
    # One ranking for both kinds of query, by weights of their own.
    weight = lambda value, blind: F.when(F.col("blind"), float(blind)).otherwise(float(value))
    asked = asked.withColumns({"vector_weight": weight(settings.vector_weight, 0.0), "bm25_weight": weight(settings.bm25_weight, 1.0)})
    found = hybrid(chunks, asked, settings, settings.top_k * settings.fetch_factor, index).join(asked.select("query_id", "blind"), "query_id")
    fallback = (F.col("score") if known_bug else F.col("rrf")) >= settings.least_fallback
    found = found.withColumn("passes", F.when(F.col("blind"), fallback).otherwise(F.col("score") >= settings.least_similarity)).drop("blind")
    fields = ["text", "title", "source", "category"]
    # Texts are fetched for the fused top only, which is k rows a query.
    hits = chunks.select("chunk_id", *fields).join(found, "chunk_id")
    ranked = rerank(dedup(hits).where("passes"), queries, settings)
    if facts is None:
        return ranked.where(F.col("position") <= settings.top_k).select("query_id", "position", *fields, "score")
    known = known_facts(queries, facts)
    others = ranked.join(known.select("query_id", "source").distinct(), ["query_id", "source"], "left_anti")
    merged = known.select("query_id", F.lit(0).alias("part"), F.col("ord").alias("place"), *fields, F.lit(1.0).alias("score")).unionByName(
        others.select("query_id", F.lit(1).alias("part"), F.col("position").alias("place"), *fields, "score")
    )
    order = Window.partitionBy("query_id").orderBy("part", "place")
    return merged.withColumn("position", F.row_number().over(order)).where(F.col("position") <= settings.top_k).select("query_id", "position", *fields, "score")


def context_block(hits: DataFrame) -> DataFrame:
    """(query_id, context): the hits (position, title, category, source, text, and service_status and date if there) with
    their labels, in order."""
    optional = lambda c, label: F.when(F.coalesce(F.col(c), F.lit("")) != "", F.concat(F.lit(label), F.col(c))) if c in hits.columns else F.lit(None)
    label = F.concat_ws(
        " — ", F.concat(F.lit("Fonte "), F.col("position").cast("string"), F.lit(": "), F.coalesce("title", F.lit(""))),
        optional("category", "tipo="), optional("service_status", "stato="), optional("date", "aggiornato="), F.coalesce("source", F.lit("")),
    )
    block = F.concat(F.lit("["), label, F.lit("]\n"), F.coalesce("text", F.lit("")))
    parts = hits.select("query_id", "position", block.alias("block")).groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("position", "block"))).alias("b"))
    return parts.select("query_id", F.array_join(F.transform("b", lambda x: x["block"]), "\n\n---\n\n").alias("context"))


def last_messages(messages: DataFrame, n: int, key: str = "conv_id", order: str = "turn") -> DataFrame:
    """The last n messages of each conversation."""
    at = Window.partitionBy(key).orderBy(F.desc(order))
    return messages.withColumn("back", F.row_number().over(at)).where(F.col("back") <= n).drop("back")


def user_content(question: Column, context: Column, office: Column) -> Column:
    """The user's message of a prompt. Fixed wording."""
    with_context = F.concat(
        F.lit("CONTESTO (estratto dalla base di conoscenza — usa SOLO queste informazioni):\n\n"), context, F.lit("\n\n---\n\nDOMANDA: "), question
    )
    without = F.concat(
        F.lit("DOMANDA: "), question,
        F.lit("\n\n(Non ho trovato nella base di conoscenza informazioni specifiche su questo argomento. Dillo chiaramente all'utente."),
        F.coalesce(F.concat(F.lit("\n\n"), office), F.lit("")), F.lit(")"),
    )
    return F.when(F.coalesce(context, F.lit("")) != "", with_context).otherwise(without)


def office_hint(name: Column, url: Column) -> Column:
    return F.concat(F.lit("Per questo argomento puoi contattare: **"), name, F.lit("** — "), url)


def prompts(queries: DataFrame, contexts: DataFrame, offices: DataFrame, history: DataFrame, system_it: str, system_en: str, settings: Settings) -> DataFrame:
    """(query_id, messages): the system prompt in the question's language, the last messages of its conversation
    (query_id, turn, role, content; system messages aside), and the question with its context or a hint."""
    from ..functions.text import detect_language

    past = last_messages(history.where("role <> 'system'"), settings.history, "query_id")
    past = past.groupBy("query_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("turn", "role", "content"))), lambda m: F.struct(m["role"].alias("role"), m["content"].alias("content"))).alias("past"))
    hint = suggest_office(queries, offices)
    full = queries.select("query_id", "question").join(contexts, "query_id", "left").join(hint, "query_id", "left").join(past, "query_id", "left")
    message = lambda role, content: F.array(F.struct(F.lit(role).alias("role"), content.alias("content")))
    system = F.when(detect_language(F.col("question")) == "it", system_it).otherwise(system_en)
    user = user_content(F.col("question"), F.col("context"), office_hint(F.col("name"), F.col("url")))
    empty = F.array().cast("array<struct<role:string,content:string>>")
    return full.select("query_id", F.concat(message("system", system), F.coalesce("past", empty), message("user", user)).alias("messages"))


def valid_requests(requests: DataFrame) -> DataFrame:
    """requests (question, history array<struct<role,content>>) with `error`, null for those that keep the limits."""
    q = F.length(F.col("question"))
    bad_role = F.exists("history", lambda m: ~m["role"].isin("user", "assistant") | (F.length(m["content"]) > 2000))
    return requests.withColumn(
        "error",
        F.when(F.col("question").isNull() | (q < 1) | (q > 1000), "question length")
        .when(F.size("history") > 6, "history length")
        .when(F.coalesce(bad_role, F.lit(False)), "history message")
        .when(strip(F.col("question")) == "", "empty question"),
    )
