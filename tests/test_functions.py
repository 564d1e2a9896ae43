from urllib.parse import urldefrag, urljoin

import pytest
from pyspark.sql import functions as F

from atlaskb.config import Settings
from atlaskb.functions import text as T
from atlaskb.functions import urls as U
from atlaskb.functions import vectors as V

S = Settings(allowed_domains=("site.example",), domain_max_path_depth={"deep.": 2})


def value(spark, column, **inputs):
    kinds = ", ".join(f"{k} {'array<float>' if isinstance(v, list) else 'string'}" for k, v in inputs.items())
    return spark.createDataFrame([tuple(inputs.values())], kinds).select(column).first()[0]


@pytest.mark.parametrize(
    ("url", "reason"),
    [
        ("https://www.site.example/a/b", None),
        ("ftp://site.example/a", "scheme"),
        ("https://me@site.example/", "address"),
        ("https://other.example/", "domain"),
        ("https://site.example/x.json", "pattern"),
        ("https://site.example/n?a=1&page=2", None),
        ("https://site.example/n?page=2", "pattern"),
        ("https://deep.site.example/a/b/c", "depth"),
        ("https://site.example/" + "/".join("abcdefghijk"), "depth"),
        ("https://site.example/a/1/1/b/a", "loop"),
        ("https://site.example/a/1/1", None),
    ],
)
def test_skip_reason(spark, url, reason):
    assert value(spark, U.skip_reason(F.col("u"), S), u=url) == reason


def test_no_allowed_domain_rejects_all(spark):
    assert value(spark, U.skip_reason(F.col("u"), Settings()), u="https://site.example/") == "domain"


@pytest.mark.parametrize("href", ["b", "/b/c", "../x", "./y?z=1", "//h.example/p", "https://o.example/", "?q=1", "#top", "", "a/../b", "../../../up", "b#c"])
def test_join_is_as_in_the_standard_library(spark, href):
    base = "https://site.example/d/e/f?x=1"
    got = value(spark, U.defragmented(U.join(F.col("b"), F.col("h"))), b=base, h=href)
    assert got == urldefrag(urljoin(base, href))[0]


@pytest.mark.parametrize(("url", "kind", "section"), [("https://a.example/services/1", "servizio", "sito_principale"), ("https://servizi.a.example/NEWS/1", "notizia", "servizi_online"), ("https://suap.a.example/faq", "faq", "suap"), ("https://x/documents/1", "documento", "sito_principale"), ("https://x/topics/1", "argomento", "sito_principale"), ("https://x/", "pagina", "sito_principale")])
def test_category_and_section(spark, url, kind, section):
    assert value(spark, U.category(F.col("u")), u=url) == kind
    assert value(spark, U.section(F.col("u")), u=url) == section


def test_file_name(spark):
    assert value(spark, U.file_name(F.col("u")), u="https://a.example/x/y/").startswith("x_y_")
    assert len(value(spark, U.file_name(F.col("u")), u="https://a.example/")) == 12


def test_tokens_split_at_unknown_letters(spark):
    assert value(spark, T.tokens(F.col("t")), t="Città façade x2y über") == ["città", "fa", "ade", "x", "y", "über"]
    assert value(spark, T.word_set(F.col("t")), t="A_1 a_1 é!") == ["a_1", "é"]


def test_clean_text(spark):
    assert value(spark, T.clean_page(F.col("t")), t="  Home \nabc\n 12/30\nReal line \r\nTORNA ALL'INIZIO\nend.") == "Real line\nend."
    assert value(spark, T.clean_pdf(F.col("t")), t="a\x07b\t\tc\n***\n\n\n\n" + "y" * 200 + "\nd�") == "ab c\nd"


def test_language_needs_strictly_more_english(spark):
    for text, lang in (("where is the office", "en"), ("dove where", "it"), ("", "it"), ("office?", "it")):
        assert value(spark, T.detect_language(F.col("t")), t=text) == lang


def test_format_text(spark):
    out = value(spark, T.format_text(F.col("t")), t='**a** <b>\n[x](https://e.example/?a=1&b=2) m@e.example')
    assert "<strong>a</strong> &lt;b&gt;<br>" in out and 'href="mailto:m@e.example"' in out and "a=1&amp;b=2" in out


def test_vectors(spark):
    assert value(spark, V.cosine(F.col("a"), F.col("b")), a=[3.0, 4.0], b=[4.0, 3.0]) == pytest.approx(0.96)
    assert value(spark, V.cosine(F.col("a"), F.col("b")), a=[0.0, 0.0], b=[4.0, 3.0]) == 0
    assert value(spark, V.normalised(F.col("a")), a=[3.0, 4.0]) == pytest.approx([0.6, 0.8])
    assert value(spark, V.starts_with_zeros(F.col("a")), a=[0.0] * 10 + [1.0])


def test_settings():
    s = Settings.from_env({"CRAWL_ALLOWED_DOMAINS": "a.example, b.example,", "SITE_URL": "https://a.example"})
    assert s.allowed_domains == ("a.example", "b.example")
    t = s.with_overrides('{"exclude_patterns": ["/x"], "domain_max_path_depth": {"a": 3}, "top_k": 5}')
    assert t.exclude_patterns[-1] == "/x" and t.domain_max_path_depth == {"a": 3} and t.top_k == 5
    assert s.with_overrides("not json") == s
