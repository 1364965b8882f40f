"""Keyword price search over offers, shops, models and links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import fold_search

# Words that say nothing about a part.
STOP_WORDS = "sada set komplet kompletni pro par kus nova novy nove original originalni jawa motocykl motorka".split()
LIMIT = 40


def _folded(text: str | None) -> str:
    from ..functions.text import FOLD_FROM, FOLD_TO

    return (text or "").lower().translate(str.maketrans(FOLD_FROM, FOLD_TO))


def stems(query: str | None, brand: str | None) -> list[str]:
    """Patterns of the query's words: a word with a digit anywhere, a long word by its first four letters, a short one whole."""
    import re

    found = set()
    for w in re.split(r"[^a-z0-9,.]+", _folded((query or "")[:200])):
        if len(w) < 3 or w in STOP_WORDS or w == brand:
            continue
        if re.search("[0-9]", w):
            found.add(w.replace(".", r"\."))
        elif len(w) >= 5:
            found.add(r"(?<![a-z0-9_])" + w[:4].replace(".", r"\."))
        else:
            found.add(r"(?<![a-z0-9_])" + w.replace(".", r"\.") + r"(?![a-z0-9_])")
    return sorted(found)


def price_search(
    offers: DataFrame, shops: DataFrame, models: DataFrame, links: DataFrame, query: str, brand: str | None = None, model: str | None = None, type_number: str | None = None, limit: int = LIMIT
) -> DataFrame:
    """The cheapest offers whose names match most of the query's words: those of the vehicle's model first, then of its brand.

    links: (part_key, model_id).  No usable word in the query: no rows.  Equal prices are ordered by name, shop and URL.
    The words' matches are counted inside one scan of offers; models and links are small dimensions, and Spark broadcasts them
    while they are.
    """
    brand_n = _folded(brand).split(" ")[0] or None
    model_n = _folded(model).strip() or None
    type_n = (type_number or "").strip() or None
    patterns = stems(query, brand_n)
    has_brand = lambda c: fold_search(c).contains(brand_n) if brand_n else F.lit(False)
    if type_n:
        own = F.lit(True) if len(type_n) >= 3 or not brand_n else has_brand(F.col("brand"))
        target = models.where(F.array_contains("type_numbers", type_n) & own)
    elif brand_n and model_n:
        named = fold_search(F.col("name")).contains(model_n) | F.exists("aliases", lambda a: fold_search(a) == model_n)
        target = models.where(has_brand(F.col("brand")) & named)
    else:
        target = models.where(F.lit(False))
    fitting = links.join(F.broadcast(target.select(F.col("id").alias("model_id"))), "model_id", "left_semi").select("part_key").distinct().withColumn("fit_model", F.lit(True))
    hits = F.lit(0)
    for p in patterns:
        hits = hits + fold_search(F.col("name")).rlike(p).cast("int")
    scored = offers.where("price > 0").select("shop_id", "part_key", "name", "price", "url", "in_stock", "last_seen_at", hits.alias("hits")).where(F.col("hits") >= max(1, -(-len(patterns) * 6 // 10)))
    scored = scored if patterns else scored.where(F.lit(False))
    best = scored.agg(F.max("hits").alias("best"))
    top = scored.join(F.broadcast(best), F.col("hits") == F.col("best"))
    full = top.join(fitting, "part_key", "left").join(shops.select("shop_id", F.col("name").alias("shop")), "shop_id")
    fit = F.when(F.coalesce("fit_model", F.lit(False)), "model").when(has_brand(F.col("name")), "brand").otherwise("other")
    order = [F.coalesce("fit_model", F.lit(False)).desc(), has_brand(F.col("name")).desc(), F.col("price"), F.col("name"), F.col("shop"), F.col("url"), F.col("last_seen_at")]
    return full.orderBy(*order).limit(limit).select("shop", "name", "price", "url", "in_stock", fit.alias("fit"), "last_seen_at")
