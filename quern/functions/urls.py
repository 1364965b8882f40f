"""URL functions; a text that is no URL gives null, never an error."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import fold, has_word

# Words by which an offer is relevant.
KEYWORDS = "jawa cz babetta pionyr perak kyvacka panelka stadion mustang jawetta cezeta velorex babeta s11 s22 s23".split()
RELEVANT = "|".join(KEYWORDS)
#: Fixed value: path segments that no product has.
NOT_PRODUCT = (
    r"(?i)/(?:blog|clanek|clanky|novinky|news|kategorie|category|kontakt|o-nas|doprava(?:-a-)?platba|obchodni-podminky|reklamace|gdpr|cookies|"
    r"sitemap|strana|page|kosik|cart|prihlaseni|login|registrace)(?:/|$|\?|-)"
)
#: What a product's path and query look like on a shop platform.
PRODUCT_PATHS = {
    "opencart": r"(?i)route=product/product",
    "prestashop": r"(?i)-p-?\d+\.html|/\d+-[a-z0-9-]+\.html",
    "woocommerce": r"(?i)/(?:produkt|product)/",
    "upgates": r"(?i)/[a-z0-9-]+/?$",
    "eshop-rychle": r"(?i)/[a-z0-9-]+/?$",
}


def part(url: Column, name: str) -> Column:
    return F.try_parse_url(url, F.lit(name))


def path(url: Column) -> Column:
    """The path of an absolute URL, "/" if it is empty; null for anything else."""
    found = part(url, "PATH")
    return F.when(part(url, "HOST").isNotNull(), F.when(found == "", "/").otherwise(found))


def slug_text(url: Column) -> Column:
    """The decoded path without its ending, separators as spaces; '' if the text is no URL.  A broken %-code stays as it is."""
    p = path(url)
    plus = F.regexp_replace(p, r"\+", "%2B")
    decoded = F.coalesce(F.try_url_decode(plus), p)
    return F.coalesce(F.regexp_replace(F.regexp_replace(decoded, r"(?i)\.(?:html?|php)$", ""), r"[-_/.+]+", " "), F.lit(""))


def relevant_text(c: Column) -> Column:
    return has_word(fold(c), RELEVANT)


def relevant_slug(url: Column) -> Column:
    return relevant_text(slug_text(url))


def segments(url: Column) -> Column:
    return F.filter(F.split(path(url), "/"), lambda x: x != "")


def likely_product(url: Column, platform: Column) -> Column:
    """Whether a URL may be a product's page: no blog, cart or contact page, and of the platform's shape if that is known."""
    p = path(url)
    full = F.concat(p, F.coalesce(F.concat(F.lit("?"), part(url, "QUERY")), F.lit("")))
    shape = F.lit(True)
    for name, pattern in PRODUCT_PATHS.items():
        shape = F.when(platform == name, full.rlike(pattern)).otherwise(shape)
    return F.when(p.isNull() | (p == "/") | p.rlike(NOT_PRODUCT), False).otherwise(shape)


def host_path_key(url: Column) -> Column:
    """Host without www and path without its last slash, in lower case: equal for URLs of one page."""
    host = F.regexp_replace(F.lower(part(url, "HOST")), r"^www\.", "")
    return F.concat(host, F.lower(F.regexp_replace(path(url), "/$", "")))


def path_key(url: Column) -> Column:
    return F.lower(F.regexp_replace(path(url), "/$", ""))


def slug_tokens(url: Column) -> Column:
    """Distinct words of a slug, their runs of letters and of digits, and both halves of six digits."""
    words = F.filter(F.split(fold(slug_text(url)), "[^a-z0-9]+"), lambda x: x != "")
    runs = F.flatten(F.transform(words, lambda w: F.regexp_extract_all(w, F.lit("[a-z]+|[0-9]+"), 0)))
    halves = F.flatten(F.transform(F.filter(words, lambda w: w.rlike("^[0-9]{6}$")), lambda w: F.array(F.substring(w, 1, 3), F.substring(w, 4, 3))))
    return F.array_distinct(F.concat(words, runs, halves))
