"""Filters and grades of shops, offers and URLs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import category_levels, fold, has_word, round_half_up
from ..functions.urls import KEYWORDS, relevant_text
from ..sources.seed import MODELS

PRICE_LIMIT = 30_000
PRICE_REVIEW = 15_000
# Fixed values of the grading rules.
REASONS = ["price_invalid", "price_over_limit", "excluded_category", "vehicle_name", "brand_name", "merch", "simson_only"]
BRAND_TOKENS = "cz jawa twn hun tha ckr original moto spol s r o".split()
MERCH = r"tricko|tricka|triko|mikina|mikiny|mikinu|cokolad\w*|plakat\w*|hrnek|hrnku|hrnky|klicenk\w*|privesek|privesku|privesky"
VOUCHER = r"darkov\w*\s+(?:poukaz|poukazy|poukazka|poukazku|certifikat|karta|karty|kupon)\w*|voucher|gift ?card"
VEHICLE = r"^(?:motocykl(?![A-Za-z0-9_])|motor (?:bez|kompletni)(?![A-Za-z0-9_]))"
MODERN = r"cl 42|forty ?two|rvm|adventure|300 cl|350 ?ohc"
TOP_CATEGORIES = ["modely motocyklu, automobilu"]
EMAIL = r"^[^\s@]+@[^\s@]+\.[^\s@]+$"
PLATFORMS = [
    ("shoptet", r'(?i)cdn\.myshoptet\.com|shoptet-scripts|data-shoptet|"generator"\s*content="Shoptet|shoptet-livechat|window\.shoptet'),
    ("upgates", r'(?i)cdn\.upgates\.com|data-upgates|"generator"\s*content="Upgates|window\.UPGATES'),
    ("eshop-rychle", r'(?i)eshop-rychle\.cz|"generator"\s*content="Eshop.?Rychle'),
    ("prestashop", r"""(?i)content=["']PrestaShop|/modules/prestashop|var\s+prestashop\s*=|id=["']prestashop["']|/themes/[^"']+/assets/cache"""),
    ("opencart", r"(?i)index\.php\?route=product|catalog/view/theme|Powered By OpenCart|catalog/view/javascript/common"),
    ("woocommerce", r"""(?i)wp-content/plugins/woocommerce|class="[^"]*\bwoocommerce\b|content=["']WooCommerce|wp-content/themes/"""),
]


def _own_words() -> list[str]:
    """Keywords and the aliases of all models, without "typ N"."""
    import re
    import unicodedata

    plain = lambda s: "".join(c for c in unicodedata.normalize("NFD", s.lower()) if not unicodedata.combining(c))
    aliases = [plain(a).replace(".", "").strip() for m in MODELS for a in m[5].split(", ")]
    return sorted({w for w in [*KEYWORDS, "stella", "star", *aliases] if w and not re.fullmatch(r"typ \d+", w)})


OWN_WORDS = _own_words()


def active_feed_shops(shops: DataFrame) -> DataFrame:
    return shops.where("source_type = 'feed' and feed_permission and feed_url is not null")


def active_crawl_shops(shops: DataFrame) -> DataFrame:
    return shops.where("source_type = 'crawl' and crawl_enabled and base_url is not null")


def internal_shops(shops: DataFrame) -> DataFrame:
    """Shops synchronised for internal use that have the source of their type."""
    return shops.where("internal_sync and case source_type when 'feed' then feed_url else base_url end is not null")


def probe_shops(shops: DataFrame, only: str | None = None, excluded: tuple[str, ...] = ()) -> DataFrame:
    """Shops with a base address: one by its id, or all but the excluded ones."""
    there = shops.where("base_url is not null")
    return there.where(F.col("shop_id") == only) if only else there.where(~F.col("shop_id").isin(list(excluded)))


def import_gate(shops: DataFrame, enforce: bool = True) -> DataFrame:
    """shop_id, allowed, problem: whether an import may start; without enforcing, only the address is needed."""
    feed = F.col("source_type") == "feed"
    address = F.when(feed, F.col("feed_url")).otherwise(F.col("base_url"))
    permitted = F.when(feed, F.col("feed_permission")).otherwise(F.col("crawl_enabled")) if enforce else F.lit(True)
    problem = F.when(address.isNull(), "no address").when(~F.coalesce(permitted, F.lit(False)), "not permitted")
    return shops.select("shop_id", problem.isNull().alias("allowed"), problem.alias("problem"))


def relevant_offers(offers: DataFrame, name: str = "name", category: str | None = None) -> DataFrame:
    text = F.col(name) if category is None else F.concat_ws(" ", name, category)
    return offers.where(relevant_text(text))


def brand_like(name: Column) -> Column:
    """Whether a name is made of brand and origin words alone."""
    tokens = F.filter(F.split(fold(name), "[^a-z0-9]+"), lambda x: x != "")
    return (F.size(tokens) > 0) & F.forall(tokens, lambda x: x.isin(BRAND_TOKENS))


def own_brand(name: Column) -> Column:
    return has_word(fold(name), "|".join(OWN_WORDS))


def name_exclusion(name: Column) -> Column:
    text = fold(name)
    return F.when(has_word(text, MERCH), "merch").when(has_word(text, "simson") & ~own_brand(name), "simson_only")


def auto_ignored(name: Column) -> Column:
    """'voucher' for offers that are stored, but at once ignored."""
    return F.when(has_word(fold(name), VOUCHER), "voucher")


def assessed(items: DataFrame, name: str = "name", price: str = "price", category: str | None = None) -> DataFrame:
    """items with exclusion (the first rule that holds, or null) and flags (of items that are kept)."""
    whole = round_half_up(F.col(price))
    text = F.trim(fold(F.col(name)))
    top = fold(F.get(category_levels(F.col(category)), F.lit(0))) if category else F.lit(None).cast("string")
    exclusion = (
        F.when(whole.isNull() | (whole <= 0), "price_invalid")
        .when(whole > PRICE_LIMIT, "price_over_limit")
        .when(brand_like(F.col(name)), "brand_name")
        .when(top.isin(TOP_CATEGORIES), "excluded_category")
        .when(text.rlike(VEHICLE), "vehicle_name")
        .otherwise(name_exclusion(F.col(name)))
    )
    flags = F.array_compact(F.array(F.when(whole >= PRICE_REVIEW, "price_review"), F.when(has_word(text, MODERN), "modern_jawa")))
    graded = items.withColumn("exclusion", exclusion)
    return graded.withColumn("flags", F.when(F.col("exclusion").isNull(), flags).otherwise(F.array().cast("array<string>")))


def platform(html: Column) -> Column:
    """The shop platform whose signature a page has; the first of the list wins."""
    found = F.lit("unknown")
    for name, pattern in reversed(PLATFORMS):
        found = F.when(html.rlike(pattern), name).otherwise(found)
    return found


def valid_email(c: Column) -> Column:
    t = F.lower(F.trim(c))
    return (F.length(t) >= 1) & (F.length(t) <= 254) & t.rlike(EMAIL)


def reachability(status: Column, error: Column) -> Column:
    """ok, http_error, timeout or dns; other network errors count as timeout."""
    return F.when(status < 400, "ok").when(status >= 400, "http_error").when(error == "dns", "dns").otherwise("timeout")


def error_class(name: Column, code: Column) -> Column:
    """timeout, dns or other: class of a failed request by the error's name and code."""
    return F.when(name == "AbortError", "timeout").when(code.isin("ENOTFOUND", "EAI_AGAIN"), "dns").when(code.isin("ETIMEDOUT", "ECONNRESET", "ECONNREFUSED"), "timeout").otherwise("other")


# Fixed values of the slug prefilters.
OWN_PREFIXES = "jaw babet pionyr perak kyvack panelk stadion jawett cezet velorex mustang sportk californian mototechn".split()
OWN_TOKENS = "cz bab pio per kyv pan bct bd s11 s22 s23 jikov".split()
FOREIGN_TOKENS = (
    "simson mz mza etz ts tatran korado sr50 sr80 bvf skoda s50 s51 s53 s60 s70 s85 schwalbe star duo kr51 sperber habicht mzt zundapp "
    "kreidler honda yamaha suzuki kawasaki minsk iz ural dnepr peugeot piaggio vespa puch mokick enduro pitbike"
).split()
FOREIGN_PREFIXES = "simson korado tatran ruda".split()


def prefilters(slug: Column, tokens: Column) -> dict[str, Column]:
    """Four ways to choose URLs by their slug: own words; also abbreviations, forms and types; all but foreign; foreign unless own."""
    types = sorted({t for m in MODELS for t in m[4].split(", ") if len(t) == 3 and t.isdigit()})
    zero = relevant_text(slug)
    a = zero | F.exists(tokens, lambda x: x.isin(OWN_TOKENS) | x.rlike("^(?:" + "|".join(OWN_PREFIXES) + r")|^j\d{3}$|^b2\d\d$|^cz\d{3}") | x.isin(types))
    foreign = F.exists(tokens, lambda x: x.isin(FOREIGN_TOKENS) | x.rlike("^(?:" + "|".join(FOREIGN_PREFIXES) + ")"))
    return {"pass_0": zero, "pass_a": a, "pass_b1": ~foreign, "pass_b2": ~foreign | a}


def product_urls(urls: DataFrame, key: str = "url") -> DataFrame:
    """URLs of one path segment that is not the first segment of any deeper URL of the same host."""
    from ..functions.urls import part, segments

    cut = urls.withColumn("__host", F.lower(part(F.col(key), "HOST"))).withColumn("__first", F.lower(F.get(segments(F.col(key)), F.lit(0)))).withColumn("__depth", F.size(segments(F.col(key))))
    parents = cut.where("__depth >= 2").select("__host", "__first").distinct()
    return cut.where("__depth = 1").join(parents, ["__host", "__first"], "left_anti").select(*urls.columns)
