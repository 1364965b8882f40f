"""Merging incoming offers into a current-state table, with price history and ageing.

State tables are plain DataFrames: each function returns the new state, which the caller writes.  Keys are deduplicated before any
join, the last row winning, so joins stay one to one; inputs are joined on the natural key, and Spark splits skewed partitions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import round_half_up
from .grading import valid_email

KEY = ["shop_id", "item_id"]
#: Columns that an import overwrites; the others of a stored row stay.
OVERWRITTEN = ("name", "price", "url", "in_stock", "last_seen_at")
STALE_DAYS = 3


def last_wins(df: DataFrame, key: list[str], order: list[Column]) -> DataFrame:
    """One row for each key: the last in the given order."""
    latest = F.row_number().over(Window.partitionBy(*key).orderBy(*[c.desc_nulls_last() for c in order]))
    return df.withColumn("__n", latest).where("__n = 1").drop("__n")


def diff(incoming: DataFrame, existing: DataFrame) -> DataFrame:
    """incoming with change: new, changed (another whole price) or same.  Both sides have one row for each key."""
    old = existing.select(*KEY, F.col("price").alias("__old"), F.lit(True).alias("__there"))
    change = F.when(F.col("__there").isNull(), "new").when(~F.col("__old").eqNullSafe(round_half_up(F.col("price"))), "changed").otherwise("same")
    return incoming.join(old, KEY, "left").withColumn("change", change).drop("__old", "__there")


def upserted(existing: DataFrame, incoming: DataFrame, kept: tuple[str, ...] = ("match_status", "part_id")) -> DataFrame:
    """The state after an import: incoming values win; match status, part and the like are left alone.

    A new row starts as pending without a part; unknown stock counts as in stock.
    """
    new = incoming.select(*KEY, *(F.col(c).alias(f"__{c}") for c in OVERWRITTEN), F.lit(True).alias("__seen"))
    both = existing.withColumn("__was", F.lit(True)).join(new, KEY, "full")
    value = {"price": round_half_up(F.col("__price")), "in_stock": F.coalesce("__in_stock", F.lit(True))}
    cols = [F.when(F.col("__seen"), value.get(c, F.col(f"__{c}"))).otherwise(F.col(c)).alias(c) for c in OVERWRITTEN]
    status = {"match_status": F.when(F.col("__was").isNull(), "pending").otherwise(F.col("match_status"))}
    return both.select(*KEY, *cols, *(status.get(c, F.col(c)).alias(c) for c in kept))


def upserted_in(by: str, existing: DataFrame, incoming: DataFrame, kept: tuple[str, ...] = ("match_status", "part_id"), dealt: tuple[int, int] = (1, 1), captured: bool = False) -> DataFrame:
    """``upserted``, with a column ``by`` that follows from the key: rows are shuffled once, by it, and stay where they are.

    Of equal keys in ``incoming`` the last row wins, as ``last_wins`` has it by time, name, price and url.  captured: with a column of
    that name: of new rows and of those with another price, the stock as it came in, for the price history; else null.  dealt: by
    how many parts of one value of ``by``, and among how many tasks.
    """
    # what a side doesn't have isn't shuffled with it: a new row comes with its price as it is, and nothing that is kept
    none = F.when(F.lit(False), F.struct(*(F.lit(None).cast(existing.schema[c].dataType).alias(c) for c in kept)))
    stored = existing.select(by, *KEY, F.lit(0).alias("__new"), *OVERWRITTEN, F.lit(None).cast("double").alias("__raw"), F.struct(*kept).alias("__kept"))
    fresh = incoming.select(by, *KEY, F.lit(1).alias("__new"), *(F.lit(None).cast("long").alias(c) if c == "price" else F.col(c) for c in OVERWRITTEN), F.col("price").cast("double").alias("__raw"), none.alias("__kept"))
    both = stored.unionByName(fresh)
    parts, tasks = dealt
    both = both.withColumn("__part", F.pmod(F.hash(*KEY), F.lit(parts)))
    both = both.repartition(tasks, by, "__part") if parts > 1 else both.repartition(by)
    last = F.max_by(F.struct("__new", "__raw", *OVERWRITTEN), F.struct("__new", "last_seen_at", "name", "__raw", "url")).alias("__row")
    was = F.max(F.when(F.col("__new") == 0, F.struct("price", "__kept"))).alias("__was")
    one = both.groupBy(by, "__part", *KEY).agg(last, was)
    new, there = F.col("__row.__new") == 1, F.col("__was").isNotNull()
    price = F.when(new, round_half_up(F.col("__row.__raw"))).otherwise(F.col("__row.price"))
    value = {"price": price, "in_stock": F.when(new, F.coalesce("__row.in_stock", F.lit(True))).otherwise(F.col("__row.in_stock"))}
    first = {"match_status": F.when(there, F.col("__was.__kept.match_status")).otherwise(F.lit("pending"))}
    noted = new & ~(there & F.col("__was.price").eqNullSafe(price))
    more = [F.when(noted, F.struct(F.col("__row.in_stock").alias("in_stock"))).alias("captured")] if captured else []
    return one.select(
        *KEY, *(value.get(c, F.col(f"__row.{c}")).alias(c) for c in OVERWRITTEN), *(first.get(c, F.col(f"__was.__kept.{c}")).alias(c) for c in kept), by, *more
    )


def price_history_rows(changes: DataFrame, at: Column) -> DataFrame:
    """Rows to append to the price history: of new offers and of changed prices; a change of stock alone writes nothing."""
    return changes.where("change <> 'same'").select(*KEY, round_half_up(F.col("price")).alias("price"), "in_stock", at.alias("captured_at"))


def price_changes(history: DataFrame, key: list[str], order: list[Column]) -> DataFrame:
    """Of a series of observations, the first and those whose price differs from the one before."""
    before = F.lag("price").over(Window.partitionBy(*key).orderBy(*order))
    return history.withColumn("previous", before).where(~F.col("previous").eqNullSafe(F.col("price")))


def stale_marked(state: DataFrame, now: Column, days: int = STALE_DAYS, source_was_empty: bool = False) -> DataFrame:
    """Offers not seen for more than ``days`` are out of stock, and stale is true; nothing is marked after an empty source."""
    stale = F.lit(False) if source_was_empty else F.coalesce(F.col("last_seen_at") < now - F.expr(f"INTERVAL {days} DAYS"), F.lit(False))
    return state.withColumn("stale", stale).withColumn("in_stock", F.when(F.col("stale"), F.lit(False)).otherwise(F.col("in_stock")))


def ignored_where(state: DataFrame, condition: Column) -> DataFrame:
    """Pending offers without a part that meet the condition become ignored."""
    free = (F.col("match_status") == "pending") & F.col("part_id").isNull()
    return state.withColumn("match_status", F.when(free & F.coalesce(condition, F.lit(False)), "ignored").otherwise(F.col("match_status")))


def links_rewritten(links: DataFrame, fresh: DataFrame) -> DataFrame:
    """Links (offer_id, model_id, source) after a run: those by name of the offers in ``fresh`` are replaced, by description stay.

    fresh: one row for each link, and rows with a null model_id for offers that were parsed without a link.
    """
    parsed = fresh.select("offer_id").distinct()
    stay = links.where("source <> 'name'").unionByName(links.where("source = 'name'").join(parsed, "offer_id", "left_anti"))
    return stay.unionByName(fresh.where("model_id is not null").select("offer_id", "model_id", F.lit("name").alias("source"))).distinct()


def product_summaries(products: DataFrame, plan: DataFrame, at: Column) -> DataFrame:
    """products with model_match_level, fit_generic and models_parsed_at of the offers in the plan; the others stay.

    plan: offer_id, level, fit_generic (one row for each offer).
    """
    new = plan.select("offer_id", F.col("level").alias("__level"), F.col("fit_generic").alias("__fit"), F.lit(True).alias("__parsed"))
    both = products.join(new, "offer_id", "left")
    take = lambda there, c: F.when(F.col("__parsed"), there).otherwise(F.col(c)).alias(c)
    changed = {"model_match_level": F.col("__level"), "fit_generic": F.col("__fit"), "models_parsed_at": at}
    return both.select(*(take(changed[c], c) if c in changed else F.col(c) for c in products.columns))


def missing_keys(rows: DataFrame, key: str, dimension: DataFrame, dimension_key: str) -> DataFrame:
    """Values of key that the dimension does not have; a write is refused unless this is empty."""
    return rows.select(F.col(key).alias("missing")).where("missing is not null").join(dimension.select(F.col(dimension_key).alias("missing")), "missing", "left_anti").distinct()


def duplicated_keys(rows: DataFrame, key: list[str]) -> DataFrame:
    return rows.groupBy(*key).agg(F.count(F.lit(1)).alias("rows")).where("rows > 1")


def invalid_values(rows: DataFrame, column: str, allowed: list[str]) -> DataFrame:
    """Rows whose value is none of the allowed ones; null is allowed."""
    return rows.where(F.col(column).isNotNull() & ~F.col(column).isin(allowed))


def subscribed(existing: DataFrame, requests: DataFrame) -> DataFrame:
    """Requests to append to the waiting list: valid addresses, folded, one of each, that are not on it yet.

    A filled trap field is passed over in silence; of equal addresses the first request counts.
    """
    clean = requests.where(F.coalesce(F.trim("trap"), F.lit("")) == "").withColumn("email", F.lower(F.trim("email"))).where(valid_email(F.col("email")))
    first = F.row_number().over(Window.partitionBy("email").orderBy("created_at", "request_id"))
    return clean.withColumn("__n", first).where("__n = 1").drop("__n", "trap").join(existing.select(F.lower("email").alias("email")), "email", "left_anti")


def dimension_merged(existing: DataFrame, seed: DataFrame, key: str, update: tuple[str, ...] = ()) -> DataFrame:
    """A dimension with the seed's new rows; of rows that were there, only the columns of ``update`` are overwritten."""
    new = seed.select(F.col(key), *(F.col(c).alias(f"__{c}") for c in seed.columns if c != key), F.lit(True).alias("__seed"))
    both = existing.withColumn("__there", F.lit(True)).join(new, key, "full")
    take = lambda c: F.when(F.col("__there").isNull() | (F.col("__seed") & F.lit(c in update)), F.col(f"__{c}")).otherwise(F.col(c)).alias(c)
    return both.select(key, *(take(c) if c in seed.columns else F.col(c) for c in existing.columns if c != key))


def shops_updated(shops: DataFrame, ids: list[str], feed_path: str = "/google.xml") -> DataFrame:
    """The listed crawled shops become feed shops at a path of their base address, and take part in internal synchronisation."""
    hit = F.col("shop_id").isin(ids) & F.col("base_url").isNotNull()
    changed = {
        "source_type": F.when(hit, "feed").otherwise(F.col("source_type")),
        "feed_url": F.when(hit, F.concat("base_url", F.lit(feed_path))).otherwise(F.col("feed_url")),
        "internal_sync": F.when(hit, True).otherwise(F.col("internal_sync")),
    }
    return shops.withColumns(changed)


def delta(current: DataFrame, wanted: DataFrame) -> DataFrame:
    """Rows to delete and to insert so that current becomes wanted: its columns and action."""
    gone = current.distinct().join(wanted.distinct(), current.columns, "left_anti").withColumn("action", F.lit("delete"))
    return gone.unionByName(wanted.distinct().join(current.distinct(), current.columns, "left_anti").withColumn("action", F.lit("insert")))


def probe_rows(results: DataFrame, at: Column) -> DataFrame:
    """One JSON row for each shop, to append to the probes."""
    return results.select("shop_id", at.alias("probed_at"), F.to_json(F.struct(*[c for c in results.columns if c != "shop_id"])).alias("result"))
