"""The bucketed state: what a change writes, failures, and ageing."""

import os

from pyspark.sql import functions as F

from quern.operators.merging import KEY, diff, last_wins, stale_marked, upserted
from quern.streaming.imports import OFFER, OfferImport
from quern.streaming.state import STATE


def offers(spark, rows):
    import datetime

    return spark.createDataFrame([(s, str(i), f"n{i}", float(p), "u", stock, datetime.datetime(2020, 1, d)) for s, i, p, stock, d in rows], OFFER)


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def size(path):
    return {os.path.join(d, f): os.path.getmtime(os.path.join(d, f)) for d, _, fs in os.walk(path) for f in fs if f.startswith("part-")}


def test_same_as_merging_the_whole_state(spark, tmp_path):
    run = OfferImport(spark, str(tmp_path), 8)
    batches = [[("a", k, k, None, 1) for k in range(50)], [("a", 3, 99, False, 2), ("b", 1, 5, True, 2), ("a", 3, 98, False, 1)], [], [("a", k, 7, True, 3) for k in range(0, 50, 5)]]
    whole, history = spark.createDataFrame([], STATE), 0
    for number, b in enumerate(batches):
        incoming = last_wins(offers(spark, b), KEY, [F.col("last_seen_at")])
        history += diff(incoming, whole).where("change <> 'same'").count()
        whole = spark.createDataFrame(upserted(whole, incoming).collect(), STATE)
        run.write_batch(offers(spark, b), number)
        assert rows(run.state()) == rows(whole)
    assert run.history().count() == history


def test_a_batch_writes_its_own_buckets_only(spark, tmp_path):
    run = OfferImport(spark, str(tmp_path), 16)
    run.write_batch(offers(spark, [("a", k, k, None, 1) for k in range(2000)]), 0)
    before = size(f"{tmp_path}/state/data")
    run.write_batch(offers(spark, [("a", 5, 6, None, 2)]), 1)
    after = size(f"{tmp_path}/state/data")
    assert before.items() <= after.items() and len(after) == len(before) + 1
    assert sum(e[2] for e in run.table.entries(run.table.latest()).values()) == 2000


def test_a_batch_that_failed_or_runs_again(spark, tmp_path):
    run = OfferImport(spark, str(tmp_path), 4)
    run.write_batch(offers(spark, [("a", k, k, None, 1) for k in range(20)]), 0)
    first, batch = rows(run.state()), offers(spark, [("a", k, 50, None, 2) for k in range(10)])
    run.write_batch(batch, 1)
    done = rows(run.state())
    os.remove(f"{tmp_path}/state/manifest/00000001/_SUCCESS")  # as if the job had ended before its commit
    assert rows(OfferImport(spark, str(tmp_path)).state()) == first
    again = OfferImport(spark, str(tmp_path), 99)  # the number of buckets is the table's own
    again.write_batch(batch, 1)
    again.write_batch(batch, 1)
    assert rows(again.state()) == done and again.table.buckets == 4 and again.history().count() == 30


def test_ageing(spark, tmp_path):
    run = OfferImport(spark, str(tmp_path), 8)
    assert run.age("2020-02-01", spark.createDataFrame([("a",)], "shop_id string")) == 0
    data = [("a", k, 1, k % 3 > 0, 1 + k % 20) for k in range(60)] + [("b", 1, 1, True, 1)] + [("a", "none", 1, None, 1)]
    run.write_batch(offers(spark, data), 0)
    state = run.state()
    shops = spark.createDataFrame([("a",), ("a",), ("c",)], "shop_id string")
    want = {(r.shop_id, r.item_id): r.in_stock for r in stale_marked(state, F.lit("2020-01-15").cast("timestamp")).collect() if r.shop_id == "a"}
    hits = sum(r.in_stock and not want.get((r.shop_id, r.item_id), True) for r in state.collect())
    assert run.age("2020-01-15", shops) == hits > 0
    assert {(r.shop_id, r.item_id): r.in_stock for r in run.state().collect()} == {**want, ("b", "1"): True}
    written = size(f"{tmp_path}/state/data")
    assert run.age("2020-01-15", shops) == 0 and run.age("2020-01-04", shops) == 0 and size(f"{tmp_path}/state/data") == written
    assert run.age("2020-03-01", spark.createDataFrame([], "shop_id string")) == 0
    run.write_batch(offers(spark, [("a", 0, 1, True, 20)]), 1)
    assert {r.in_stock for r in run.state().where("shop_id = 'a' and item_id = '0'").collect()} == {True}


def exchanges(df):
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[-1].count("Exchange hashpartitioning")


def test_upsert_shuffles_once(spark):
    """What the merge writes by bucket isn't shuffled by key before; ageing has no join with the state itself."""
    from quern.operators.merging import upserted_in

    state = spark.createDataFrame([("a", str(k), f"n{k}", k, "u", True, None, "auto" if k % 2 else None, "p") for k in range(40)], STATE).withColumn("bucket", F.lit(1))
    new = offers(spark, [("a", k, k + 0.5, None, 2) for k in range(30, 50)])
    merged = upserted_in("bucket", state, new.withColumn("bucket", F.lit(1)))
    assert rows(merged.drop("bucket")) == rows(upserted(state.drop("bucket"), new))
    assert exchanges(merged) == 1


def test_landed_offers_are_shuffled_once(spark, sf_dir):
    from quern.plans.queries import _landed_offers

    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "64m")
    try:
        found = _landed_offers(spark, sf_dir)
        assert exchanges(found) == 1 and found.count() == found.select(*KEY).distinct().count()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_new_keys_are_added_without_rewriting(spark, tmp_path, monkeypatch):
    """A batch of new keys writes its own rows only; a bucket of many folders is made one again."""
    from quern.streaming import state

    run = OfferImport(spark, str(tmp_path), 2)
    run.write_batch(offers(spark, [("a", k, k, None, 1 + k % 20) for k in range(200)]), 0)
    run.write_batch(offers(spark, [("b", k, k, None, 3) for k in range(10)] + [("b", 3, 77, False, 4)]), 1)
    written = lambda v: spark.read.parquet(f"{tmp_path}/state/data/{v:08d}").count()
    entries = run.table.entries(run.table.latest()).values()
    assert written(1) == 10 and run.state().count() == 210 == sum(e[2] for e in entries) and {e[3].day for e in entries} == {1}
    assert rows(run.state().where("shop_id = 'b' and item_id = '3'").select("price", "in_stock")) == [(77, False)] and run.history().count() == 210
    monkeypatch.setattr(state, "FOLDERS", 2)
    run.write_batch(offers(spark, [("c", k, k, None, 3) for k in range(10)]), 2)
    assert written(2) == 220 == run.state().count() and run.history().count() == 220
    shops = spark.createDataFrame([("a",), ("b",), ("c",)], "shop_id string")
    assert run.age("2020-03-01", shops) == 219 and run.state().where("in_stock").count() == 0


def test_a_large_bucket_is_dealt(spark, tmp_path, monkeypatch):
    from quern.streaming import imports

    monkeypatch.setattr(imports, "ROWS_A_TASK", 100, raising=False)
    run = OfferImport(spark, str(tmp_path), 1)
    for number in (0, 1):
        run.write_batch(offers(spark, [("a", k, k + number * (k % 2), None, 1 + number) for k in range(1000)] + [("a", 5, 9, True, 9)]), number)
    files = [f for f in size(f"{tmp_path}/state/data") if "00000001" in f]
    assert len(files) > 2 and run.state().count() == 1000 and run.history().count() == 1000 + 499


def test_landed_offers_are_shuffled_as_narrow_as_stored(spark, sf_dir):
    from quern.plans.queries import _landed_offers

    plan = _landed_offers(spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
    below = plan.split("RepartitionByExpression")[1]
    assert "concat" not in below
