"""Documents into overlapping chunks."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import Settings
from ..functions.text import clean_chunk, strip

SEPARATORS = (". ", ", ", " ", "")


def split_text(text: str, size: int = 1200, overlap: int = 150, separators: tuple[str, ...] = SEPARATORS) -> list[str]:
    """Pieces of at most `size` characters that overlap by up to `overlap`, cut at the first separator that occurs;
    parts that are still too long are cut at the next ones. A separator stays at the head of the part after it."""
    at = next(i for i, s in enumerate(separators) if not s or s in text)
    separator, rest = separators[at], separators[at + 1 :]
    if separator:
        head, *tail = text.split(separator)
        parts = [p for p in (head, *(separator + t for t in tail)) if p]
    else:
        parts = list(text)
    out: list[str] = []
    short: list[str] = []
    for part in parts:
        if len(part) < size:
            short.append(part)
            continue
        out += _windows(short, size, overlap)
        short = []
        out += split_text(part, size, overlap, rest) if rest else [part]
    return out + _windows(short, size, overlap)


def _windows(parts: list[str], size: int, overlap: int) -> list[str]:
    """Consecutive parts joined to up to `size`; each window starts with the last parts of the one before, up to `overlap`."""
    out: list[str] = []
    start = length = 0
    for i, part in enumerate(parts):
        if length + len(part) > size and i > start:
            out.append("".join(parts[start:i]).strip())
            while length > overlap or length and length + len(part) > size:
                length -= len(parts[start])
                start += 1
        length += len(part)
    out.append("".join(parts[start:]).strip())
    return [x for x in out if x]


def chunk_id(source: Column, index: Column, text: Column) -> Column:
    return F.md5(F.concat_ws("::", source, index.cast("string"), F.substring(text, 1, 64)))


def _pieces(settings: Settings):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pieces = [
                [x for p in found or () for x in ([p] if len(p) <= settings.paragraph_chars else split_text(p, settings.paragraph_chars, settings.overlap_chars))]
                for found in batch.column(batch.num_columns - 1).to_pylist()
            ]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(pieces, pa.list_(pa.string()))], [*batch.schema.names[:-1], "pieces"])

    return rows


def chunk(docs: DataFrame, settings: Settings | None = None) -> DataFrame:
    """Chunks of documents (text, source, title, doc_type and any further columns, which are carried): chunk_index
    and chunk_total count the pieces before short ones go; the title stands before each text."""
    settings = settings or Settings()
    others = [c for c in docs.columns if c != "text"]
    paragraphs = F.filter(F.transform(F.split(strip(F.coalesce("text", F.lit(""))), r"\n{2,}"), strip), lambda p: p != "")
    split = docs.select(*others, paragraphs.alias("pieces"))
    whole = F.forall("pieces", lambda p: F.length(p) <= settings.paragraph_chars)
    schema = split.schema
    # Only documents with a long paragraph go through Python.
    pieces = split.where(whole).unionByName(split.where(~whole).mapInArrow(_pieces(settings), schema))
    each = pieces.select(*others, F.size("pieces").alias("chunk_total"), F.posexplode("pieces").alias("chunk_index", "piece"))
    kept = each.withColumn("piece", clean_chunk(F.col("piece"))).where(F.length("piece") >= settings.least_chunk_chars)
    titled = F.when(F.coalesce("title", F.lit("")) != "", F.concat("title", F.lit("\n\n"), "piece")).otherwise(F.col("piece"))
    texts = kept.select(*others, "chunk_index", "chunk_total", titled.alias("text"))
    return texts.withColumn("chunk_id", chunk_id(F.col("source"), F.col("chunk_index"), F.col("text")))
