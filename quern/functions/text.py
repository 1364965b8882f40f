"""Text functions as Column expressions, all inside whole-stage code."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

# The letters that price search folds.
FOLD_FROM = "áäčďéěëíňóöřšťúůüýžľĺŕ"
FOLD_TO = "aacdeeeinoorstuuuyzllr"


def _accents() -> tuple[str, str]:
    """Lower-case letters of the Latin blocks whose canonical decomposition starts with an ASCII letter, and those letters."""
    pairs = []
    for code in [*range(0x00C0, 0x0250), *range(0x1E00, 0x1F00)]:
        letter = chr(code)
        base = unicodedata.normalize("NFD", letter)[0]
        if base.isascii() and base.isalpha() and letter == letter.lower():
            pairs.append((letter, base))
    return "".join(a for a, _ in pairs), "".join(b for _, b in pairs)


ACCENTED, PLAIN = _accents()


def fold_search(c: Column) -> Column:
    """Lower case without Czech and Slovak accents; null becomes ''."""
    return F.translate(F.lower(F.coalesce(c, F.lit(""))), FOLD_FROM, FOLD_TO)


def fold(c: Column) -> Column:
    """Lower case without accents: of every Latin letter that decomposes, and combining marks are dropped."""
    return F.regexp_replace(F.translate(F.lower(c), ACCENTED, PLAIN), r"[̀-ͯ]", "")


def whole_word(pattern: str) -> str:
    """A regular expression for pattern between ASCII word boundaries (Java's own \\b takes all letters for word characters)."""
    return rf"(?<![A-Za-z0-9_])(?:{pattern})(?![A-Za-z0-9_])"


def has_word(c: Column, pattern: str) -> Column:
    return c.rlike(whole_word(pattern))


def round_half_up(c: Column) -> Column:
    """To the nearest integer, halves upwards; null for a value that is no finite number."""
    ok = c.isNotNull() & ~F.isnan(c.cast("double")) & (F.abs(c.cast("double")) < F.lit(9.0e18))
    return F.when(ok, F.floor(c.cast("double") + 0.5)).cast("long")


def number_prefix(c: Column) -> Column:
    """The number that a text begins with ("12 dni" is 12); null if it begins with none.  A comma is a decimal point."""
    text = F.regexp_replace(F.trim(c), ",", ".")
    return F.regexp_extract(text, r"^[+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?", 0).try_cast("double")


def price_text(c: Column) -> Column:
    """A price without its white space ("1 290,00" is 1290.0)."""
    return number_prefix(F.regexp_replace(c, r"[\s ]+", ""))


def money_with_currency(c: Column) -> Column:
    """struct(amount, currency, ambiguous) of "1 290,00 CZK".

    A text with both separators ("1,290.00") has no amount and is marked ambiguous.
    """
    text = F.trim(c)
    currency = F.nullif(F.regexp_extract(text, r"([A-Z]{3})\s*$", 1), F.lit(""))
    digits = F.regexp_replace(text, r"[A-Z]{3}\s*$", "")
    ambiguous = digits.contains(",") & digits.contains(".")
    return F.struct(F.when(~ambiguous, price_text(digits)).alias("amount"), currency.alias("currency"), F.coalesce(ambiguous, F.lit(False)).alias("ambiguous"))


def availability_feed(c: Column) -> Column:
    """Stock text of a merchant feed: true, false or null; "out of stock" wins."""
    t = F.regexp_replace(F.lower(F.trim(c)), r"[\s_]+", "_")
    return F.when(t.rlike("out_of_stock|discontinued"), False).when(t.rlike("in_stock|preorder|backorder"), True)


def availability_schema(c: Column, offline_words: bool = True) -> Column:
    """A schema.org availability URL or name; JSON-LD knows a few more words than microdata."""
    t = F.lower(F.element_at(F.split(c, "/"), -1))
    yes = "instock|limitedavailability" + ("|onlineonly|presale" if offline_words else "")
    no = "outofstock|soldout" + ("|discontinued" if offline_words else "")
    return F.when(t.rlike(yes), True).when(t.rlike(no), False)


def decode_entities(c: Column) -> Column:
    """The few character references that shops use; the ampersand last, so that nothing is decoded twice."""
    for pattern, char in (("(?i)&nbsp;", " "), ("(?i)&quot;", '"'), ("(?i)&#0?39;|&apos;", "'"), ("(?i)&lt;", "<"), ("(?i)&gt;", ">"), ("(?i)&amp;", "&")):
        c = F.regexp_replace(c, pattern, char)
    return c


def html_to_text(c: Column) -> Column:
    return F.trim(F.regexp_replace(decode_entities(F.regexp_replace(c, r"<[^>]+>", " ")), r"\s+", " "))


def compare_key(c: Column) -> Column:
    """Folded, dots and white space as one space."""
    return F.trim(F.regexp_replace(fold(c), r"[.\s]+", " "))


def category_levels(c: Column) -> Column:
    return F.transform(F.split(c, ">"), lambda x: F.trim(x))


def number_set(c: Column) -> Column:
    """The sorted distinct numbers in a text; units are ignored."""
    return F.array_sort(F.array_distinct(F.transform(F.regexp_extract_all(c, F.lit(r"\d+(?:\.\d+)?"), 0), lambda x: x.cast("double"))))


def token_set(c: Column) -> Column:
    return F.array_sort(F.array_distinct(F.split(c, " ")))


def percent(part: Column, total: Column) -> Column:
    """With one decimal; 0 of nothing."""
    return F.when(total == 0, F.lit(0.0)).otherwise(F.round(100 * part / F.nullif(total, F.lit(0)), 1))


def slugify(c: Column, size: int = 80) -> Column:
    dashed = F.regexp_replace(F.regexp_replace(fold(c), "[^a-z0-9]+", "-"), "^-+|-+$", "")
    return F.regexp_replace(F.substring(dashed, 1, size), "-+$", "")


def fnv1a(c: Column) -> Column:
    """32-bit FNV-1a of the UTF-16 code units, as 8 hex digits (characters beyond the basic plane count as one unit)."""
    codes = F.transform(F.filter(F.split(c, ""), lambda x: x != ""), lambda x: F.conv(F.hex(F.encode(x, "UTF-16BE")), 16, 10).cast("long"))
    mask = F.lit(0xFFFFFFFF).cast("long")
    step = lambda h, x: (h.bitwiseXOR(x) * F.lit(0x01000193).cast("long")).bitwiseAND(mask)
    return F.lpad(F.lower(F.hex(F.aggregate(codes, F.lit(0x811C9DC5).cast("long"), step))), 8, "0")


def strip_shop_markers(c: Column) -> Column:
    """A name without "*M" and ",,CZ" marks and the dashes and commas that are left at its ends."""
    for pattern, by in ((r"\*\S*", " "), (r",,\S*", " "), (r"\s+", " "), (r"^[\s\-–,.]+|[\s\-–,]+$", "")):
        c = F.regexp_replace(c, pattern, by)
    return F.trim(c)


# Fixed values of the stemming rule.
ENDINGS = "ovych ovymi ovym ovou ovem ovi ymi ych ich ami emi ach ove ova ovy ovo eho iho emu ymu imu ym im ou em um ho mu".split()
ABBREVIATIONS = {"karb": "karburator", "bow": "bowden"}
SHORT_FORMS = {"osa": "os", "osy": "os", "ose": "os", "osu": "os", "kolo": "kol", "kola": "kol", "kole": "kol", "kolu": "kol", "sady": "sada", "sade": "sada", "sadu": "sada"}
SYNONYMS = {"lank": "bowden", "samolepk": "nalepk", "simerink": "gufer", "pistn": "pist", "volnobezn": "volnobeh"}


def _mapped(c: Column, table: dict[str, str]) -> Column:
    pairs = F.create_map(*(F.lit(x) for kv in table.items() for x in kv))
    return F.coalesce(pairs[c], c)


def stem(word: Column) -> Column:
    """A light stem of a folded Czech word: the first ending of the list that leaves three letters goes, else a last vowel."""
    full = _mapped(word, ABBREVIATIONS)
    cut = F.when(F.length(full) <= 4, _mapped(full, SHORT_FORMS))
    for e in ENDINGS:
        cut = cut.when(full.endswith(e) & (F.length(full) - len(e) >= 3), F.substring(full, F.lit(1), F.length(full) - len(e)))
    cut = cut.otherwise(F.regexp_replace(full, r"(?<=^.{3,40})[aeiouy]$", ""))
    short = F.length(full) <= 4
    joined = F.when(~short & (F.length(cut) >= 5), F.regexp_replace(cut, "ek$", "k")).otherwise(cut)
    return _mapped(joined, SYNONYMS)
