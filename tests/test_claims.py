"""Plans that claim parts, checked tables and seeded samples, each against the plain way."""

import os
import random

import pytest
from pyspark.sql import functions as F

from quern.operators import constraints as K
from quern.operators import parts as P
from quern.operators import samples
from quern.store import kept

WISH = "cluster_key string, part_id string, via string, place int"


def walked(wishes):
    """One plan after the other."""
    taken, got = set(), {}
    for key, part, _, _ in sorted(wishes, key=lambda w: (w[0], w[3])):
        if key not in got and part not in taken:
            got[key] = part
            taken.add(part)
    return got


@pytest.mark.parametrize("together", [500_000, 150])
def test_claims_as_one_walk(spark, together):
    rng = random.Random(together)
    wishes = []
    for k in range(400):
        group = rng.choice([0, 0, rng.randrange(1, 40)])  # one large component and many small ones
        wishes += [(f"k{k:04}", f"g{group}-{p}", "part_id", n) for n, p in enumerate(rng.sample(range(120 if group == 0 else 4), rng.randrange(1, 4)))]
    got = P.claimed(spark.createDataFrame(wishes, WISH).repartition(5), kept, together)
    assert {r.cluster_key: r.part_id for r in got.collect()} == walked(wishes)


def test_claims_along_a_chain(spark):
    """Each plan's wish depends on what the one before got."""
    n, tables = 10_000, []

    def keep(df):
        tables.append(1)
        return kept(df)

    wishes = spark.range(n).select(F.format_string("k%06d", "id").alias("cluster_key"), F.explode(F.array("id", F.col("id") + 1)).alias("p"))
    wishes = wishes.select("cluster_key", F.concat(F.lit("p"), "p").alias("part_id"), F.lit("part_id").alias("via"), F.row_number().over(P.Window.partitionBy("cluster_key").orderBy(F.desc("p"))).alias("place"))
    got = {r.cluster_key: r.part_id for r in P.claimed(wishes, keep).collect()}
    assert got == {f"k{k:06}": f"p{k + 1}" for k in range(n)} and len(tables) < 40


def test_claims_of_few_parts_by_many_plans(spark):
    """90,000 wishes for 40 parts: nearly all of them are hopeless, and aren't walked through stretch by stretch."""
    rng, tables = random.Random(3), []

    def keep(df):
        tables.append(1)
        return kept(df)

    wishes = [(f"k{k:05}", f"p{p}", "part_id", n) for k in range(6000) for n, p in enumerate(rng.sample(range(40), 15))]
    got = {r.cluster_key: r.part_id for r in P.claimed(spark.createDataFrame(wishes, WISH).repartition(5), keep, 2000).collect()}
    assert got == walked(wishes) and len(got) == 40 and len(tables) < 20


def test_claims_of_nothing(spark):
    assert P.claimed(spark.createDataFrame([], WISH), kept).count() == 0


def shuffled(n, seed, used):
    a = list(range(n))
    number = used
    for i in range(n - 1, 0, -1):
        number += 1
        j = int(samples.drawn(seed, number) / 2**32 * (i + 1))
        a[i], a[j] = a[j], a[i]
    return a


@pytest.mark.parametrize(("n", "size", "used", "local"), [(0, 5, 0, 1), (1, 5, 0, 1), (40, 50, 3, 1), (900, 12, 7, 1), (900, 12, 7, 1 << 16), (900, 30, 0, 100)])
def test_sample_as_the_shuffle_gives_it(spark, n, size, used, local):
    assert samples.shuffled_places(spark, n, size, 20260930, used, local) == shuffled(n, 20260930, used)[:size]


def test_draws_of_columns(spark):
    # fixed values: the generator's first numbers for the seed 1
    assert [samples.drawn(1, k) for k in (1, 2)] == [2693262067, 11749833]
    got = spark.range(1, 2000).select("id", samples.draws(20260930, F.col("id")).alias("d")).collect()
    assert all(r.d == samples.drawn(20260930, r.id) for r in got)


def test_seeded_sample_of_rows(spark):
    df = spark.range(200).select((F.col("id") * 7 % 200).alias("k"), F.lit("x").alias("spent2"))
    got = {r.place: r.k for r in samples.seeded_sample(df, ["k"], 10, 5, kept).collect()}
    assert got == dict(enumerate(shuffled(200, 5, 0)[:10]))


def test_checked_table(spark, tmp_path):
    shops = spark.createDataFrame([("a",), ("b",), ("b",)], "id string")
    rules = K.Rules(required=("item",), allowed={"status": ("pending", "auto")}, unique=(("shop", "item"),), references={"shop": (shops, "id")})
    columns = "shop string, item string, status string"
    table = K.CheckedTable(spark, str(tmp_path))
    good = [("a", "1", None), ("a", "2", "auto"), (None, "1", "pending"), (None, "1", "pending")]
    assert table.read() is None and table.replace(spark.createDataFrame(good, columns), rules) == 4
    for row, rule in ((("a", None, None), "required item"), (("a", "9", "odd"), "allowed status"), (("b", "1", None), None), (("a", "2", None), "unique shop, item"), (("z", "3", None), "references shop")):
        rows = spark.createDataFrame([*good, row], columns)
        if rule is None:
            assert table.replace(rows, rules) == 5
            continue
        before = sorted(map(str, table.read().collect()))
        with pytest.raises(K.Refused) as e:
            table.replace(rows, rules)
        assert e.value.broken == {rule: 1}
        assert sorted(map(str, table.read().collect())) == before
    with pytest.raises(K.Refused, match="empty: 5"):
        table.replace(spark.createDataFrame(good, columns), rules, only_if_empty=True)
    assert len(os.listdir(tmp_path / "data")) == 2
    assert table.replace(spark.createDataFrame([], columns), rules) == 0 and table.replace(spark.createDataFrame(good, columns), rules, only_if_empty=True) == 4


def test_cascaded(spark):
    parents = spark.createDataFrame([(1,), (2,)], "id int")
    children = spark.createDataFrame([(1, "x"), (3, "y"), (None, "z")], "parent int, v string")
    assert sorted(r.v for r in K.cascaded(children, "parent", parents, "id").collect()) == ["x", "z"]


def test_checked_write_sorts_offers_once(spark, sf_dir, monkeypatch):
    """Rows that are one for each key aren't shuffled whole a second time for their ids, which hold the key."""
    from quern.operators import merging
    from quern.plans import queries

    calls, real = [], merging.last_wins
    monkeypatch.setattr(merging, "last_wins", lambda *a: calls.append(a[1]) or real(*a))
    got = {(r.attempt, r.rule): r.rows for r in queries.k15_checked_write(spark, sf_dir).collect()}
    assert calls == [merging.KEY] and got["mended", "accepted"] == got["read", "rows"] > 0
