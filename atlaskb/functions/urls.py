"""Column builders for URLs: parts, the rules that skip a link, categories, sections, file names, joining."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..config import Settings


def scheme(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, r"^([A-Za-z][A-Za-z0-9+.\-]*):", 1))


def netloc(url: Column) -> Column:
    return F.regexp_extract(url, r"^(?:[A-Za-z][A-Za-z0-9+.\-]*:)?//([^/?#]*)", 1)


def path(url: Column) -> Column:
    return F.regexp_extract(url, r"^(?:[A-Za-z][A-Za-z0-9+.\-]*:)?(?://[^/?#]*)?([^?#]*)", 1)


def query(url: Column) -> Column:
    return F.regexp_extract(url, r"^[^?#]*\?([^#]*)", 1)


def defragmented(url: Column) -> Column:
    return F.regexp_replace(url, r"#.*$", "")


def segments(url: Column) -> Column:
    return F.filter(F.split(path(url), "/"), lambda s: s != "")


def _any_in(values: tuple[str, ...], text: Column) -> Column:
    return F.exists(F.array(*map(F.lit, values)), lambda v: F.contains(text, v)) if values else F.lit(False)


def allowed_domain(url: Column, settings: Settings) -> Column:
    """Whether the host contains an allowed domain; without any, none is allowed."""
    return _any_in(settings.allowed_domains, netloc(url))


def max_depth(host: Column, settings: Settings) -> Column:
    """The depth of the first domain that the host contains, else the general one."""
    out = F.lit(settings.max_path_depth)
    for domain, depth in reversed(settings.domain_max_path_depth.items()):
        out = F.when(host.contains(domain), F.lit(depth)).otherwise(out)
    return out


def skip_reason(url: Column, settings: Settings) -> Column:
    """The first rule that excludes a URL, or null."""
    host, parts = netloc(url), segments(url)
    full = F.concat(path(url), F.when(query(url) != "", F.concat(F.lit("?"), query(url))).otherwise(""))
    words = F.filter(parts, lambda s: ~s.rlike("^[0-9]+$"))
    return (
        F.when(~scheme(url).isin("http", "https"), "scheme")
        .when(host.contains("@"), "address")
        .when(~allowed_domain(url, settings), "domain")
        .when(_any_in(settings.exclude_patterns, full), "pattern")
        .when(F.size(parts) > max_depth(host, settings), "depth")
        .when(F.size(words) != F.size(F.array_distinct(words)), "loop")
    )


def should_skip(url: Column, settings: Settings) -> Column:
    return skip_reason(url, settings).isNotNull()


def unusable_href(href: Column) -> Column:
    return href.rlike("^(mailto:|tel:|webcal:|javascript:|#)")


def category(url: Column) -> Column:
    """The kind of a page by its path; fixed rules in order of precedence."""
    p = F.lower(path(url))
    has = lambda *parts: F.exists(F.array(*map(F.lit, parts)), lambda x: F.contains(p, x))
    return (
        F.when(has("/services/", "/service/"), "servizio")
        .when(has("/news/", "/news-category/", "/notizie/"), "notizia")
        .when(has("/faq"), "faq")
        .when(has("/public_documents/", "/documents/"), "documento")
        .when(has("/topics/"), "argomento")
        .otherwise("pagina")
    )


def section(url: Column) -> Column:
    """The part of the site by its host; fixed rules in order of precedence."""
    host = F.lower(netloc(url))
    return (
        F.when(host.contains("amministrazionetrasparente"), "trasparenza")
        .when(host.contains("sportellounico") | host.contains("suap"), "suap")
        .when(host.contains("ambitosociale"), "ambito_sociale")
        .when(host.contains("servizi."), "servizi_online")
        .otherwise("sito_principale")
    )


def file_name(url: Column) -> Column:
    p = F.substring(F.replace(F.regexp_replace(path(url), "^/+|/+$", ""), F.lit("/"), F.lit("_")), 1, 60)
    h = F.substring(F.md5(url), 1, 12)
    return F.when(p != "", F.concat_ws("_", p, h)).otherwise(h)


def remove_dots(p: Column) -> Column:
    """A path without . and .. segments."""
    kept = F.aggregate(
        F.split(p, "/"),
        F.array().cast("array<string>"),
        lambda acc, s: F.when(s == "..", F.when(F.size(acc) > 1, F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0)))).otherwise(acc)).when(s == ".", acc).otherwise(F.array_append(acc, s)),
    )
    tail = F.when(p.rlike(r"/\.{1,2}$"), "/").otherwise("")
    return F.concat(F.array_join(kept, "/"), tail)


def join(base: Column, href: Column) -> Column:
    """href resolved against base, as browsers do."""
    root = F.concat(scheme(base), F.lit("://"), netloc(base))
    clean, rest = F.regexp_extract(href, "^([^?#]*)", 1), F.regexp_extract(href, "([?#].*)$", 1)
    folder = F.regexp_replace(path(base), "[^/]*$", "")
    return (
        F.when(href.rlike(r"^[A-Za-z][A-Za-z0-9+.\-]*:"), href)
        .when(href.startswith("//"), F.concat(scheme(base), F.lit(":"), href))
        .when(href.startswith("/"), F.concat(root, remove_dots(clean), rest))
        .when(href == "", base)
        .when(href.startswith("?"), F.concat(root, path(base), href))
        .when(href.startswith("#"), F.concat(defragmented(base), href))
        .otherwise(F.concat(root, remove_dots(F.concat(F.when(folder == "", "/").otherwise(folder), clean)), rest))
    )
