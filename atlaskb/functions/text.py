"""Column builders for text: stripping, tokens, noise lines, languages, document clean-up and display."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..config import CHUNK_NOISE, ENGLISH, ITALIAN, PAGE_NOISE, TOKEN_LETTERS


def strip(c: Column) -> Column:
    """Without white space at either end (not only spaces, as trim has it)."""
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def tokens(c: Column) -> Column:
    """Search tokens: runs of the known letters in the lower-cased text; other characters split."""
    return F.regexp_extract_all(F.lower(c), F.lit(f"([{TOKEN_LETTERS}]+)"), 1)


def word_set(c: Column) -> Column:
    """Distinct words of letters, digits and underscores in the lower-cased text."""
    return F.array_distinct(F.regexp_extract_all(F.lower(c), F.lit(r"([\p{L}\p{N}_]+)"), 1))


def noise_pattern(lines: tuple[str, ...]) -> str:
    return f"(?i)^({'|'.join(lines)})$"


def clean_lines(c: Column, noise: tuple[str, ...], least: int = 4) -> Column:
    """Stripped lines of at least `least` characters that aren't noise, joined by line feeds."""
    lines = F.transform(F.split(c, r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85  ]"), strip)
    return F.array_join(F.filter(lines, lambda x: (F.length(x) >= least) & ~x.rlike(noise_pattern(noise))), "\n")


def clean_page(c: Column) -> Column:
    return clean_lines(c, PAGE_NOISE)


def clean_chunk(c: Column) -> Column:
    return clean_lines(c, CHUNK_NOISE)


def clean_pdf(c: Column) -> Column:
    """Text of a PDF without control characters, replacement characters, endless words and lines without letters."""
    c = F.regexp_replace(c, r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]", "")
    c = F.regexp_replace(c, "[�￾￿]", "")
    c = F.regexp_replace(c, r"\S{200,}", "")
    c = F.regexp_replace(c, r"[ \t]+", " ")
    c = F.regexp_replace(c, r"\n{3,}", "\n\n")
    return strip(F.array_join(F.filter(F.split(c, r"\r\n|\n|\r"), lambda x: x.rlike("[a-zA-ZÀ-ÿ0-9]")), "\n"))


def detect_language(c: Column) -> Column:
    """en if strictly more of its words are met than of Italian, else it; punctuation sticks to words."""
    words = F.split(F.lower(strip(c)), r"\s+")
    score = lambda known: F.size(F.array_intersect(words, F.array(*map(F.lit, known))))
    return F.when(score(ENGLISH) > score(ITALIAN), "en").otherwise("it")


def normalised_query(c: Column) -> Column:
    """The form under which questions are counted: lower case, one space, no question marks at the ends."""
    return F.regexp_replace(F.regexp_replace(F.lower(c), r"\s+", " "), r"^[?! ]+|[?! ]+$", "")


def cache_key(c: Column) -> Column:
    return F.md5(strip(F.lower(c)))


_LINK = 'target="_blank" rel="noopener" style="color:inherit;text-decoration:underline"'


def format_text(c: Column) -> Column:
    """A chat answer as HTML: escaped, with bold text, links, mail addresses and line breaks. Fixed patterns."""
    for old, new in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        c = F.replace(c, F.lit(old), F.lit(new))
    for old, new in (
        (r"&quot;\s+(?:target|rel|style|class)=[^\n<]*", ""),
        (r"\*\*(.+?)\*\*", "<strong>$1</strong>"),
        (r"\[([^\]]+)\]\((https?://[^\s)]+)\)", f'<a href="$2" {_LINK}>$1</a>'),
        (r"\[(https?://[^\]\s]+)\]", f'<a href="$1" {_LINK}>$1</a>'),
        (r'(https?://(?:[^\s<>"&]|&amp;)+)', f'<a href="$1" {_LINK}>$1</a>'),
        (r"([a-zA-Z0-9._%+\-]+@[a-zA-Z0-9.\-]+\.[a-zA-Z]{2,})", '<a href="mailto:$1" style="color:inherit">$1</a>'),
        (r"\n", "<br>"),
    ):
        c = F.regexp_replace(c, old, new)
    return c
