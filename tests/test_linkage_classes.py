"""Linkage by classes against the pairs themselves."""

import random

import pytest
from pyspark.sql import functions as F

from quern.operators import linkage as L
from quern.operators.linkage_classes import Classes
from quern.store import kept

SCHEMA = "id string, shop_id string, name string, price long, part_type string, note string, model_ids array<string>, fit_generic array<struct<brand:string,displacement:int>>, " + ", ".join(f"`{a}` string" for a in L.ATTRIBUTES)
SCHEMA_COLUMNS = [c.split()[0].strip("`") for c in SCHEMA.replace("array<struct<brand:string,displacement:int>>", "fits").split(", ")]


def _items(spark, seed, n):
    rng = random.Random(seed)
    pick = lambda *xs: rng.choice(xs)
    rows = []
    for k in range(n):
        attributes = {"dimension": pick(None, None, "10x30", "30 x 10", "5"), "side": pick(None, None, "left"), "code": pick(None, None, "k1", "k2", "k1 k2"), "color": pick(None, None, None, "red")}
        models = pick([], [], ["m1"], ["m1", "m2"], ["m2", "m1", "m1"], ["m3"])
        rows.append((
            f"o{k:04d}", pick("s1", "s1", "s2", "s3"), f"n{k}", pick(None, 0, 100, 100, 249, 250, 251, rng.randint(1, 2000)), pick("kryt motor", "kryt motor", "motor kryt", "kryt", "", "kryt motor levy"),
            pick(None, None, "note"), models, pick([], [{"brand": "j", "displacement": 350}]), *(attributes.get(a) for a in L.ATTRIBUTES),
        ))
    return spark.createDataFrame(rows, SCHEMA)


@pytest.mark.parametrize(("seed", "n"), [(1, 250), (2, 40), (3, 0)])
def test_same_as_pairs(spark, seed, n):
    items = kept(_items(spark, seed, n))
    pairs = kept(L.classified(items))
    rows = lambda df: sorted(tuple(r) for r in df.collect())
    classes = Classes(items, kept)
    assert rows(classes.pair_counts()) == rows(L.pair_counts(pairs))
    assert rows(classes.conflict_counts()) == rows(L.conflict_counts(pairs))
    assert rows(classes.shop_pair_counts()) == rows(L.shop_pair_counts(pairs))
    assert rows(classes.ambiguous_offers()) == rows(L.ambiguous_offers(items, pairs))
    assert rows(classes.clusters()) == rows(L.clusters(kept(L.demoted(items, pairs)), kept))
    if n > 100:
        assert {r[1] for r in rows(L.pair_counts(pairs))} == {"A", "B", "dropped"} and rows(classes.clusters()) and rows(classes.ambiguous_offers())


@pytest.mark.parametrize(("seed", "n"), [(4, 120), (5, 0)])
def test_listed_as_pairs(spark, seed, n):
    """Pairs as rows of the last join, against joined pairs: each once, nothing shuffled behind the join."""
    items = kept(_items(spark, seed, n))
    pairs = kept(L.classified(items))
    classes = Classes(items, kept)
    rows = lambda df: sorted(tuple(map(str, r)) for r in df.collect())
    same = ["a", "b", "shop_a", "shop_b", "name_a", "class", "basis", "shared", "same_type", "jaccard", "price_ratio", "conflicts"]
    assert rows(classes.met().select("a", "b", "jaccard")) == rows(L.candidates(items))
    assert rows(classes.listed().select(*same)) == rows(pairs.select(*same))
    demoted = L.demoted(items, pairs)
    ranked = lambda df: [(r.a, r.b) for r in df.collect()]
    assert ranked(classes.ranked_b(50)) == ranked(L.ranked_b(demoted, 50))
    met = classes.met()._jdf.queryExecution().optimizedPlan().toString()
    assert not met.lstrip().startswith(("Aggregate", "Distinct", "Repartition"))


def test_many_attributes_of_one_type(spark):
    """3,000 profiles of one type in one bucket: 4.5 million pairs of profiles, none of which is written."""
    written = []

    def keep(df):
        written.append(kept(df).count())
        return kept(df)

    k, none = F.col("id"), F.lit(None).cast("string")
    items = spark.range(3000).select(
        k.cast("string").alias("id"), F.concat(F.lit("s"), (k % 3).cast("string")).alias("shop_id"), F.lit("n").alias("name"), F.lit(100).cast("long").alias("price"), F.lit("kryt motor").alias("part_type"), none.alias("note"),
        F.array().cast("array<string>").alias("model_ids"), F.array().cast("array<struct<brand:string,displacement:int>>").alias("fit_generic"), *((k.cast("string") if a == "size" else none).alias(a) for a in L.ATTRIBUTES),
    )
    assert [tuple(r) for r in Classes(items, keep).conflict_counts().collect()] == [("size", 3 * 1000 * 1000)]
    assert max(written) <= 3000


def test_one_type_with_half_of_all_offers(spark):
    """100,000 offers of one type in 50 shops: 5 billion pairs, none of them listed."""
    k = F.col("id")
    items = spark.range(100_000).select(
        k.cast("string").alias("id"), F.concat(F.lit("s"), (k % 50).cast("string")).alias("shop_id"), F.lit("n").alias("name"), (k % 997 + 1000).cast("long").alias("price"), F.lit("kryt motor").alias("part_type"),
        F.lit(None).cast("string").alias("note"), F.array().cast("array<string>").alias("model_ids"), F.array().cast("array<struct<brand:string,displacement:int>>").alias("fit_generic"),
        *(F.lit(None).cast("string").alias(a) for a in L.ATTRIBUTES),
    )
    classes = Classes(items, kept)
    n, shops = 100_000, 50
    assert [tuple(r) for r in classes.pair_counts().collect()] == [("no_fit", "A", (n * n - shops * (n // shops) ** 2) // 2)]
    assert classes.edges().count() <= 2 * classes.points.count()
    assert {r.cluster for r in classes.clusters().select("cluster").distinct().collect()} == {"0"}


def test_points_of_one_profile_are_connected_by_one_edge_each(spark):
    items = _items(spark, 5, 1).select(*(c for c in SCHEMA_COLUMNS if c not in ("id", "shop_id", "price"))).crossJoin(spark.range(300).select("id"))
    k = F.col("id")
    items = items.select(k.cast("string").alias("id"), F.concat(F.lit("s"), (F.floor(k / 10) % 7).cast("string")).alias("shop_id"), (k + 1000).alias("price"), *(c for c in SCHEMA_COLUMNS if c not in ("id", "shop_id", "price")))
    classes = Classes(items, kept)
    edges = classes.edges()
    assert edges.count() <= 299 + edges.rdd.getNumPartitions()
    assert classes.clusters().select("cluster").distinct().count() == 1


def test_pairs_of_one_class_are_dealt(spark, monkeypatch):
    """600 offers of one type in three shops: all their pairs, in no one task."""
    from quern.operators import linkage_classes

    monkeypatch.setattr(linkage_classes, "PAIRS_A_TASK", 5000, raising=False)
    k, none = F.col("id"), F.lit(None).cast("string")
    items = spark.range(600).select(
        k.cast("string").alias("id"), F.concat(F.lit("s"), (k % 3).cast("string")).alias("shop_id"), F.lit("n").alias("name"), (k % 9 + 100).alias("price"), F.lit("kryt motor").alias("part_type"), none.alias("note"),
        F.array().cast("array<string>").alias("model_ids"), F.array().cast("array<struct<brand:string,displacement:int>>").alias("fit_generic"), *(none.alias(a) for a in L.ATTRIBUTES),
    )
    pairs = Classes(items, kept).listed().select("a", "b", F.spark_partition_id().alias("task"))
    tasks = [r[1] for r in pairs.groupBy("task").count().collect()]
    assert sum(tasks) == pairs.select("a", "b").distinct().count() == 3 * 200 * 200 and max(tasks) < sum(tasks) / 3


def test_rounded_as_round(spark):
    rng = random.Random(7)
    values = [rng.choice([1, 10, 1e3, 1e7, 1e13]) * rng.random() for _ in range(5000)] + [(rng.randrange(10**8) + 0.5) / 10**6 for _ in range(5000)] + [a / b for a in range(1, 60) for b in range(1, 60)] + [None, 0.0]
    df = spark.createDataFrame([(v,) for v in values], "x double")
    assert df.where(~L.rounded(F.col("x")).eqNullSafe(F.round("x", 6))).count() == 0


@pytest.mark.parametrize(("seed", "n", "k"), [(8, 400, 60), (9, 400, 335)])
def test_ranked_without_all_pairs(spark, monkeypatch, seed, n, k):
    """The first pairs are found without a list of all: those of equal prices, or up to some ratio."""
    items = kept(_items(spark, seed, n).withColumn("name", F.concat(F.lit("n"), F.when(F.substring("id", -1, 1) > "1", F.substring("id", -1, 1)))))
    want = [(r.a, r.b) for r in L.ranked_b(L.demoted(items, kept(L.classified(items))), k).collect()]

    def listed(*_, **__):
        raise AssertionError("all pairs were listed")

    monkeypatch.setattr(Classes, "listed", listed)
    assert [(r.a, r.b) for r in Classes(items, kept).ranked_b(k).collect()] == want and len(want) == k
