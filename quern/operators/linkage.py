"""Record linkage of offers across shops: blocking, Jaccard, attribute compatibility, price ratio, ambiguity, clusters.

An item is a row (id, shop_id, name, price, part_type, note, model_ids, fit_generic, and one string column for each attribute).
Part types repeat far more than offers do, so similarities are computed once for each pair of distinct types (by a prefix-filtered
equi-join on their words); offers are then joined on (bucket, similar type), and every row of that join is a pair that counts.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import number_set, token_set
from .components import connected_components

# The attributes that are compared, in the order in which they are reported.
ATTRIBUTES = ["dimension", "voltage", "side", "position", "finish", "color", "material", "teeth", "pack", "size", "ref", "code", "with", "version"]
MIN_JACCARD = 0.5
MAX_RATIO = 2.5


def fit_key(fit: Column) -> Column:
    """Sorted "brand|displacement" of a generic fit; null and empty give ''."""
    each = F.transform(fit, lambda x: F.concat(x["brand"], F.lit("|"), F.coalesce(x["displacement"].cast("string"), F.lit(""))))
    return F.coalesce(F.array_join(F.array_sort(each), ";"), F.lit(""))


def bucket_keys(models: Column, fit: Column) -> Column:
    """One key for each distinct model, or without models a single key of the generic fit."""
    return F.when(F.size(models) > 0, F.transform(F.array_distinct(models), lambda m: F.concat(F.lit("model|"), m))).otherwise(F.array(F.concat(F.lit("fit|"), fit_key(fit))))


def words(part_type: Column) -> Column:
    return F.array_distinct(F.filter(F.split(part_type, " "), lambda w: w != ""))


def jaccard(a: Column, b: Column) -> Column:
    both = F.size(F.array_intersect(a, b))
    total = F.size(F.array_union(a, b))
    return F.when(total == 0, F.lit(0.0)).otherwise(both / F.nullif(total, F.lit(0)))


def _comparable(name: str) -> Callable[[Column], Column]:
    """What of an attribute is compared: numbers of a dimension, tokens of references, codes and accessories."""
    if name == "dimension":
        return lambda c: number_set(c).cast("string")
    if name in ("ref", "code", "with"):
        return lambda c: token_set(c).cast("string")
    return lambda c: c


def compared(a: Callable[[str], Column], b: Callable[[str], Column]) -> tuple[Column, Column]:
    """conflicts and one_sided: attributes that differ, and those that only one side has (a code on one side is no matter)."""
    conflicts = F.array_compact(F.array(*(F.when(a(k).isNotNull() & b(k).isNotNull() & (_comparable(k)(a(k)) != _comparable(k)(b(k))), F.lit(k)) for k in ATTRIBUTES)))
    one = F.array_compact(F.array(*(F.when(a(k).isNull() != b(k).isNull(), F.lit(k)) for k in ATTRIBUTES if k != "code")))
    return conflicts, one


def price_ratio(a: Column, b: Column) -> Column:
    return F.when((a > 0) & (b > 0), F.greatest(a, b) / F.nullif(F.least(a, b), F.lit(0)))


def rounded(x: Column, digits: int = 6) -> Column:
    """``F.round`` of a number that isn't negative, which takes the way through a decimal's text only close to where it turns."""
    up = F.lit(10.0**digits)
    at = x * up
    near = (F.abs(at - F.floor(at) - 0.5) < 0.001) | (at >= 1e12)
    return F.when(near, F.round(x, digits)).otherwise(F.floor(at + 0.5) / up)


def similar_types(types: DataFrame, min_jaccard: float = MIN_JACCARD) -> DataFrame:
    """x, y and jaccard of all ordered pairs of types (sorted words, joined by spaces) that are similar, equal ones included.

    types: type.  Of words in one order, two sets with a Jaccard similarity of j share one of the first n - ceil(j n) + 1.
    """
    n = F.size("w")
    cut = (n - F.ceil(F.lit(min_jaccard) * n) + 1).cast("int")
    t = types.where("type <> ''").distinct().withColumn("w", F.split("type", " ")).withColumn("word", F.explode(F.slice("w", F.lit(1), cut)))
    x, y = (t.select(F.col("type").alias(k), F.col("w").alias(f"w{k}"), "word") for k in "xy")
    sizes = F.least(F.size("wx"), F.size("wy")) >= F.lit(min_jaccard) * F.greatest(F.size("wx"), F.size("wy"))
    near = x.join(y, "word").where(sizes).withColumn("jaccard", jaccard(F.col("wx"), F.col("wy"))).where(F.col("jaccard") >= min_jaccard)
    return near.select("x", "y", "jaccard").distinct()


def candidates(items: DataFrame, min_jaccard: float = MIN_JACCARD) -> DataFrame:
    """Pairs (a, b) of ids with a < b: one bucket, different shops, similar part types; each pair once."""
    kind = F.array_join(F.array_sort(words(F.col("part_type"))), " ")
    side = items.select("id", "shop_id", kind.alias("type"), F.explode(bucket_keys(F.col("model_ids"), F.col("fit_generic"))).alias("bucket")).where("type <> ''")
    near = similar_types(side.select("type"), min_jaccard)
    left = side.select(F.col("id").alias("a"), F.col("shop_id").alias("shop_a"), F.col("type").alias("x"), "bucket").join(near, "x")
    right = side.select(F.col("id").alias("b"), F.col("shop_id").alias("shop_b"), F.col("type").alias("y"), "bucket")
    met = left.join(right, ["bucket", "y"]).where((F.col("a") < F.col("b")) & (F.col("shop_a") != F.col("shop_b")))
    return met.select("a", "b", "jaccard").distinct()


def classified(items: DataFrame, min_jaccard: float = MIN_JACCARD, max_ratio: float = MAX_RATIO) -> DataFrame:
    """Candidates with class: A (the same part), B (to be checked, with reasons) or dropped (with conflicts)."""
    cols = ["id", "shop_id", "name", "price", "part_type", "note", "model_ids", "fit_generic", *ATTRIBUTES]
    of = lambda x: items.select(F.col("id").alias(x), F.struct(*[F.col(c) for c in cols]).alias(f"i{x}"))
    pairs = candidates(items, min_jaccard).join(of("a"), "a").join(of("b"), "b")
    conflicts, one = compared(lambda k: F.col("ia")[k].cast("string"), lambda k: F.col("ib")[k].cast("string"))
    pairs = pairs.withColumns({"conflicts": conflicts, "one_sided": one, "price_ratio": price_ratio(F.col("ia.price"), F.col("ib.price"))})
    same = F.col("ia.part_type") == F.col("ib.part_type")
    ratio = F.col("price_ratio")
    is_a = same & (F.size("one_sided") == 0) & F.coalesce(ratio <= max_ratio, F.lit(False))
    reasons = F.array_compact(
        F.array(
            F.when(~same, F.concat(F.lit("jaccard "), F.format_number("jaccard", 2))),
            F.when(F.size("one_sided") > 0, F.concat(F.lit("missing: "), F.array_join("one_sided", ","))),
            F.when(ratio.isNull(), F.lit("no price")).when(ratio > max_ratio, F.concat(F.lit("price x"), F.format_number(ratio, 1))),
        )
    )
    by_model = F.size("ia.model_ids") > 0
    key = fit_key(F.col("ia.fit_generic"))
    return pairs.select(
        "a",
        "b",
        F.col("ia.shop_id").alias("shop_a"),
        F.col("ib.shop_id").alias("shop_b"),
        F.col("ia.name").alias("name_a"),
        F.when(F.size("conflicts") > 0, "dropped").when(is_a, "A").otherwise("B").alias("class"),
        F.when(by_model, "model").when(key == "", "no_fit").otherwise("fit_generic").alias("basis"),
        F.when(by_model, F.array_sort(F.array_intersect("ia.model_ids", "ib.model_ids"))).otherwise(F.array(key)).alias("shared"),
        same.alias("same_type"),
        "jaccard",
        "price_ratio",
        F.when(F.size("conflicts") > 0, F.array().cast("array<string>")).otherwise(reasons).alias("reasons"),
        "conflicts",
    )


def offer_signature(df: DataFrame) -> Column:
    """Equal for offers that are the same but for their code: type, attributes, note and models."""
    parts = [_comparable(k)(F.col(k).cast("string")) for k in ATTRIBUTES if k != "code"]
    fit = F.when(F.size("model_ids") > 0, F.lit("")).otherwise(fit_key(F.col("fit_generic")))
    return F.struct(F.col("part_type"), F.col("note"), *[p.alias(f"a{i}") for i, p in enumerate(parts)], F.array_sort(F.array_distinct("model_ids")).alias("models"), fit.alias("fit"))


def ambiguous_offers(items: DataFrame, pairs: DataFrame) -> DataFrame:
    """id of offers with A partners in one other shop that are not all the same offer.

    Two partners are the same if their signatures are equal and their codes don't differ (a missing code differs from none), so a group
    of partners differs just when it has two signatures or two codes.
    """
    a = pairs.where("class = 'A'")
    ends = a.select(F.col("a").alias("id"), F.col("b").alias("partner"), F.col("shop_b").alias("shop")).unionByName(a.select(F.col("b").alias("id"), F.col("a").alias("partner"), F.col("shop_a").alias("shop")))
    marks = items.select(F.col("id").alias("partner"), F.xxhash64(offer_signature(items)).alias("sig"), token_set(F.col("code")).cast("string").alias("code"))
    met = ends.join(marks, "partner").groupBy("id", "shop").agg(F.min("sig").alias("s0"), F.max("sig").alias("s1"), F.min("code").alias("c0"), F.max("code").alias("c1"))
    return met.where("s0 <> s1 or c0 <> c1").select("id").distinct()


def demoted(items: DataFrame, pairs: DataFrame) -> DataFrame:
    """pairs in which every A pair of an ambiguous offer is B, with the reason "ambiguous"."""
    bad = ambiguous_offers(items, pairs).withColumn("hit", F.lit(True))
    of = lambda x: bad.select(F.col("id").alias(x), F.col("hit").alias(f"hit_{x}"))
    met = pairs.join(of("a"), "a", "left").join(of("b"), "b", "left")
    down = (F.col("class") == "A") & F.coalesce("hit_a", "hit_b", F.lit(False))
    return met.withColumns({"class": F.when(down, "B").otherwise(F.col("class")), "reasons": F.when(down, F.concat("reasons", F.array(F.lit("ambiguous")))).otherwise(F.col("reasons"))}).select(*pairs.columns)


def clusters(pairs: DataFrame, keep: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """id and cluster (the least id of the component) of all offers with an A pair; ids are strings.

    keep: writes a table that all executors can read and returns it.
    """
    a = keep(pairs.where("class = 'A'").select("a", "b"))
    ids = keep(a.select(F.col("a").alias("id")).unionByName(a.select(F.col("b").alias("id"))).distinct().select("id", F.xxhash64("id").alias("v")))
    of = lambda x: ids.select(F.col("id").alias(x), F.col("v").alias(f"v{x}"))
    edges = a.join(of("a"), "a").join(of("b"), "b").select(F.col("va").alias("a"), F.col("vb").alias("b"))
    found = connected_components(edges, keep)
    full = ids.join(found, ids.v == found.vertex, "left").select("id", F.coalesce("component", "v").alias("component"))
    return full.join(full.groupBy("component").agg(F.min("id").alias("cluster")), "component").select("id", "cluster")


def pair_counts(pairs: DataFrame) -> DataFrame:
    """basis, class and pairs."""
    return pairs.groupBy("basis", "class").agg(F.count(F.lit(1)).alias("pairs"))


def conflict_counts(pairs: DataFrame) -> DataFrame:
    return pairs.where("class = 'dropped'").select(F.explode("conflicts").alias("attribute")).groupBy("attribute").agg(F.count(F.lit(1)).alias("pairs"))


def shop_pair_counts(pairs: DataFrame) -> DataFrame:
    """Pairs without any fit by pair of shops and class."""
    two = F.array_sort(F.array("shop_a", "shop_b"))
    return pairs.where("basis = 'no_fit' and class <> 'dropped'").groupBy(F.array_join(two, " x ").alias("shops"), "class").agg(F.count(F.lit(1)).alias("pairs"))


def ranked_b(pairs: DataFrame, k: int = 200) -> DataFrame:
    """The k B pairs most likely to be the same part."""
    order = [F.col("same_type").desc(), F.col("jaccard").desc(), F.size("reasons"), F.col("price_ratio").asc_nulls_last(), F.col("name_a"), F.col("a"), F.col("b")]
    return pairs.where("class = 'B'").orderBy(*order).limit(k)


def near_types(types: DataFrame) -> DataFrame:
    """Pairs (x, y) of part types that differ by one word: one has a word more, or one word is replaced by another.

    types: part_type.  Every type is joined on what is left without one of its words (and on its whole), so no types are compared
    all against all.
    """
    each = types.select("part_type").distinct().select("part_type", F.array_sort(words(F.col("part_type"))).alias("w")).where(F.size("w") > 0)
    less = each.select("part_type", F.explode(F.transform("w", lambda x: F.array_join(F.array_remove(F.col("w"), x), " "))).alias("key"), F.lit(1).alias("cut"))
    whole = each.select("part_type", F.array_join("w", " ").alias("key"), F.lit(0).alias("cut"))
    keyed = less.unionByName(whole).where("key <> ''")
    x = keyed.select(F.col("part_type").alias("x"), "key", F.col("cut").alias("cx"))
    y = keyed.select(F.col("part_type").alias("y"), "key", F.col("cut").alias("cy"))
    return x.join(y, "key").where((F.col("x") < F.col("y")) & (F.col("cx") + F.col("cy") > 0)).select("x", "y").distinct()
