"""Aggregates and reports.  Every one is a combination of partial aggregates; margins come from rollup or grouping sets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import percent
from .grading import REASONS

LEVELS = ["type", "nickname", "displacement", "brand", "none"]
#: Seconds between two requests to one host.
SECONDS_PER_REQUEST = 3


def availability(rows: DataFrame) -> DataFrame:
    one = lambda c: F.count_if(c)
    return rows.agg(one(F.col("in_stock")).alias("in_stock"), one(~F.col("in_stock")).alias("out_of_stock"), one(F.col("in_stock").isNull()).alias("unknown"))


def prices(rows: DataFrame) -> DataFrame:
    return rows.agg(F.count(F.lit(1)).alias("items"), F.min("price").alias("min_price"), F.max("price").alias("max_price"), F.round(F.avg("price"), 2).alias("avg_price"))


def variant_groups(rows: DataFrame, key: str = "item_group_id") -> DataFrame:
    """Rows with and without a group id ('' counts as none), groups, groups of more than one row, and rows in those."""
    named = rows.groupBy(F.nullif(F.col(key), F.lit("")).alias("g")).agg(F.count(F.lit(1)).alias("n"))
    n, there = F.col("n"), F.col("g").isNotNull()
    total = lambda c, v: F.coalesce(F.sum(F.when(c, v)), F.lit(0))
    return named.agg(
        total(there, n).alias("with_group"),
        total(~there, n).alias("without_group"),
        F.count_if(there).alias("groups"),
        F.count_if(there & (n > 1)).alias("multi_groups"),
        total(there & (n > 1), n).alias("in_multi_groups"),
    )


def exclusion_counts(graded: DataFrame) -> DataFrame:
    """reason and items, zero for reasons that never hold."""
    every = graded.sparkSession.createDataFrame([(r,) for r in REASONS], "reason string")
    return every.join(graded.where("exclusion is not null").groupBy(F.col("exclusion").alias("reason")).agg(F.count(F.lit(1)).alias("n")), "reason", "left").select("reason", F.coalesce("n", F.lit(0)).alias("items"))


def import_summary(graded: DataFrame) -> DataFrame:
    """One row: total, relevant, stored, excluded, flagged, new, changed, vouchers.  graded has relevant, exclusion, flags, change, ignored."""
    kept = F.col("relevant") & F.col("exclusion").isNull()
    c = F.count_if
    return graded.agg(
        F.count(F.lit(1)).alias("total"),
        c(F.col("relevant")).alias("relevant"),
        c(kept).alias("stored"),
        c(F.col("relevant") & F.col("exclusion").isNotNull()).alias("excluded"),
        c(kept & (F.size("flags") > 0)).alias("flagged"),
        c(kept & (F.col("change") == "new")).alias("new"),
        c(kept & (F.col("change") == "changed")).alias("changed"),
        c(kept & F.col("ignored").isNotNull()).alias("vouchers"),
    )


def refresh_summary(outcomes: DataFrame) -> DataFrame:
    """kind and pages, zero for kinds that don't occur."""
    kinds = outcomes.sparkSession.createDataFrame([(k,) for k in ("item", "not_found", "no_product", "error", "disallowed")], "kind string")
    return kinds.join(outcomes.groupBy("kind").agg(F.count(F.lit(1)).alias("n")), "kind", "left").select("kind", F.coalesce("n", F.lit(0)).alias("pages"))


def levels_by_shop(rows: DataFrame, weight: Column | None = None) -> DataFrame:
    """shop_id (null: all shops) and the weighted rows of each match level, and their total."""
    w = F.lit(1) if weight is None else weight
    level = F.coalesce("level", F.lit("none"))
    cols = [F.coalesce(F.sum(F.when(level == x, w)), F.lit(0)).alias(x) for x in LEVELS]
    return rows.rollup("shop_id").agg(*cols, F.coalesce(F.sum(w), F.lit(0)).alias("total"))


def status_by_shop(rows: DataFrame) -> DataFrame:
    """shop_id (null: all shops), match_status ('null' for none) and rows."""
    named = rows.select("shop_id", F.coalesce("match_status", F.lit("null")).alias("match_status"))
    margin = named.withColumn("shop_id", F.lit(None).cast("string"))
    return named.groupBy("shop_id", "match_status").agg(F.count(F.lit(1)).alias("rows")).unionByName(margin.groupBy("shop_id", "match_status").agg(F.count(F.lit(1)).alias("rows")))


def attribute_coverage(rows: DataFrame, attributes: list[str]) -> DataFrame:
    """shop_id (null: all shops), rows, and for each attribute the rows that have it."""
    return rows.rollup("shop_id").agg(F.count(F.lit(1)).alias("rows"), *(F.count(a).alias(a) for a in attributes))


def top_values(rows: DataFrame, value: Column, k: int) -> DataFrame:
    """The k most frequent values of an array column, with their rows; ties by value."""
    each = rows.select(F.explode(value).alias("value")).where("value <> ''")
    return each.groupBy("value").agg(F.count(F.lit(1)).alias("rows")).orderBy(F.desc("rows"), "value").limit(k)


def unresolved_tokens(rows: DataFrame) -> DataFrame:
    """rows: unresolved array<struct<kind, brand, token>> and count.  Sums by token, most frequent first."""
    each = rows.select(F.inline("unresolved"), "count")
    return each.groupBy("brand", "kind", "token").agg(F.sum("count").alias("rows")).orderBy(F.desc("rows"), "token", "brand", "kind")


def document_frequency(rows: DataFrame, tokens: Column, k: int = 80) -> DataFrame:
    """In how many rows each token of two characters or more, not a number, occurs: the k most frequent."""
    each = rows.select(F.explode(F.array_distinct(tokens)).alias("token")).where("length(token) > 1 and not token rlike '^[0-9]+$'")
    return each.groupBy("token").agg(F.count(F.lit(1)).alias("rows")).orderBy(F.desc("rows"), "token").limit(k)


def depth_histogram(rows: DataFrame, depth: Column) -> DataFrame:
    return rows.groupBy(depth.cast("long").alias("depth")).agg(F.count(F.lit(1)).alias("urls"))


def recall(rows: DataFrame, passes: dict[str, Column], wanted: Column) -> DataFrame:
    """One row for each prefilter: rows, passed, percent passed, wanted rows, of them kept, percent kept, hours of crawling."""
    flags = rows.select(wanted.alias("wanted"), *(c.alias(n) for n, c in passes.items()))
    one = flags.agg(
        F.count(F.lit(1)).alias("rows"),
        F.count_if(F.col("wanted")).alias("wanted"),
        *(F.count_if(F.col(n)).alias(f"p_{n}") for n in passes),
        *(F.count_if(F.col(n) & F.col("wanted")).alias(f"k_{n}") for n in passes),
    )
    each = F.array(*(F.struct(F.lit(n).alias("prefilter"), F.col(f"p_{n}").alias("passed"), F.col(f"k_{n}").alias("kept")) for n in passes))
    long = one.select("rows", "wanted", F.inline(each))
    return long.select(
        "prefilter", "rows", "passed", percent(F.col("passed"), F.col("rows")).alias("passed_percent"), "wanted", "kept", percent(F.col("kept"), F.col("wanted")).alias("kept_percent"), crawl_hours(F.col("passed")).alias("hours")
    )


def crawl_hours(requests: Column) -> Column:
    return F.round(requests * SECONDS_PER_REQUEST / 3600, 1)


def compacted(rows: DataFrame) -> DataFrame:
    """Equal names of a shop as one row with their count; parsers run on these."""
    return rows.groupBy("shop_id", "name").agg(F.count(F.lit(1)).alias("count"))


def special_counts(parsed: DataFrame) -> DataFrame:
    """parsed: models (array of struct with family), generic (array of struct brand, displacement), name tokens, count."""
    families = F.array_distinct(F.transform("models", lambda m: m["family"]))
    by_brand = F.array_distinct(F.transform(F.filter("generic", lambda g: g["displacement"].isNotNull()), lambda g: F.struct(g["brand"].alias("b"), g["displacement"].alias("d"))))
    several = F.exists(by_brand, lambda x: F.exists(by_brand, lambda y: (x["b"] == y["b"]) & (x["d"] != y["d"])))
    return parsed.agg(
        F.coalesce(F.sum(F.when(F.size(families) > 1, F.col("count"))), F.lit(0)).alias("several_families"),
        F.coalesce(F.sum(F.when(several, F.col("count"))), F.lit(0)).alias("several_displacements"),
        F.coalesce(F.sum(F.when(F.size("models") > 6, F.col("count"))), F.lit(0)).alias("suspicious"),
    )


def hash_sample(rows: DataFrame, key: str, n: int, seed: int) -> DataFrame:
    """A repeatable sample of n rows: those with the least hash of key and seed."""
    return rows.orderBy(F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(key).cast("string"))), key).limit(n)


def random_sample(rows: DataFrame, n: int) -> DataFrame:
    return rows.orderBy(F.rand()).limit(n)


def first_rows(rows: DataFrame, order: list[str], n: int = 10) -> DataFrame:
    return rows.orderBy(*order).limit(n)


def per_group_first(rows: DataFrame, by: list[str], order: list[Column]) -> DataFrame:
    """The first row of each group in the given order."""
    n = F.row_number().over(Window.partitionBy(*by).orderBy(*order))
    return rows.withColumn("__n", n).where("__n = 1").drop("__n")


def markdown(df: DataFrame, limit: int = 200) -> str:
    """A small report table as Markdown; only so many rows come to the driver."""
    rows = df.limit(limit).collect()
    text = lambda v: "" if v is None else str(v).replace("|", r"\|")
    head = "| " + " | ".join(df.columns) + " |\n|" + " --- |" * len(df.columns)
    return "\n".join([head, *("| " + " | ".join(text(v) for v in r) + " |" for r in rows)])
