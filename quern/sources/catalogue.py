"""Shops, offers, models, links and price history as views over star-schema tables.

shops are suppliers, offers are order lines with their part.  The last words of an offer's name come from ``SUFFIXES``, by the part's
key, so that names carry vehicle models; a link joins an offer to the models that its suffix names.
Readers take only the columns they need, so Parquet scans stay narrow.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .seed import MODELS, models  # noqa: F401

#: What stands at the end of an offer's name, and the ids of the models that it is linked to.
SUFFIXES = [
    ("Jawa 350 typ 634", ["jawa-350-634"]),
    ("ČZ 175 typ 477", ["cz-175-477"]),
    ("Pionýr 20, 21", ["pionyr-20", "pionyr-21"]),
    ("Babetta 210", ["babetta-210"]),
    ("Stadion S11", ["stadion-s11"]),
    ("Jawa 250 Panelka", ["panelka-250-559", "panelka-250-592"]),
    ("Simson S51", []),
    ("tričko Jawa", []),
    ("dárkový poukaz", []),
    ("motocykl", []),
    ("Jawa RVM", []),
    ("(sada) ČZ", []),
]
#: The columns that name an order line.
LINE = ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
STATUSES = ("pending", "auto", "manual", "rejected", "ignored", None, "pending")


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shops(spark: SparkSession, sf_dir: str) -> DataFrame:
    s, key = read(spark, sf_dir, "supplier"), F.col("s_suppkey")
    url = F.concat(F.lit("https://shop"), key.cast("string"), F.lit(".example.com"))
    return s.select(
        F.concat(F.lit("S"), key.cast("string")).alias("shop_id"),
        F.col("s_name").alias("name"),
        F.when(key % 2 == 0, "feed").otherwise("crawl").alias("source_type"),
        F.when((key % 2 == 0) & (key % 5 != 0), F.concat(url, F.lit("/feed.xml"))).alias("feed_url"),
        (F.col("s_acctbal") > 3000).alias("feed_permission"),
        F.when(key % 7 != 0, url).alias("base_url"),
        (F.col("s_acctbal") > 2000).alias("crawl_enabled"),
        (F.col("s_acctbal") > 6000).alias("internal_sync"),
    )


def part_name(key: str = "p_partkey") -> Column:
    suffix = F.element_at(F.array(*(F.lit(s[0]) for s in SUFFIXES)), (F.col(key) % len(SUFFIXES) + 1).cast("int"))
    return F.concat_ws(" ", "p_name", F.lower("p_type"), suffix)


def parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """part_key, base (part words), name (with its suffix), suffix number, brand, part_type, size."""
    return read(spark, sf_dir, "part").select(*part_columns())


def part_columns() -> list[Column]:
    """A part's columns from those of its row."""
    n = len(SUFFIXES)
    return [
        F.col("p_partkey").alias("part_key"),
        F.concat_ws(" ", "p_name", F.lower("p_type")).alias("base"),
        part_name().alias("name"),
        (F.col("p_partkey") % n).cast("int").alias("suffix"),
        F.col("p_brand").alias("brand"),
        F.col("p_type").alias("part_type"),
        F.col("p_size").alias("size"),
        F.col("p_retailprice").alias("retail"),
    ]


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "lineitem").select(*LINE, "l_quantity", "l_extendedprice", "l_returnflag", "l_linestatus", "l_shipdate", "l_tax")


def offer_texts() -> dict[str, Column]:
    """Texts of an offer that follow from the keys of its order line and part."""
    return {
        "offer_id": F.concat_ws("-", *(F.col(c).cast("string") for c in LINE)),
        "shop_id": F.concat(F.lit("S"), F.col("l_suppkey").cast("string")),
        "item_id": F.concat_ws("-", F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string")),
        "url": F.concat(F.lit("https://shop"), F.col("l_suppkey").cast("string"), F.lit(".example.com/p/"), F.col("part_key").cast("string")),
    }


def offer_values() -> dict[str, Column]:
    return {
        "price": F.floor(F.col("l_extendedprice") / F.col("l_quantity") + 0.5).cast("long"),
        "in_stock": F.when(F.col("l_linestatus") == "F", F.col("l_returnflag") != "R").when(F.col("l_returnflag") != "N", F.lit(True)),
        "last_seen_at": F.col("l_shipdate"),
    }


def offers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """offer_id, shop_id, item_id (not unique), name, price (whole crowns), url, in_stock, last_seen_at and more."""
    li = lines(spark, sf_dir)
    joined = li.join(parts(spark, sf_dir), li.l_partkey == F.col("part_key"))
    status = F.get(F.array(*(F.lit(s) for s in STATUSES)), (F.col("l_orderkey") % len(STATUSES)).cast("int"))
    own = {k: c.alias(k) for k, c in (offer_texts() | offer_values()).items()}
    return joined.select(
        own["offer_id"],
        own["shop_id"],
        own["item_id"],
        "part_key",
        "name",
        "base",
        "suffix",
        "brand",
        own["price"],
        own["url"],
        own["in_stock"],
        own["last_seen_at"],
        status.alias("match_status"),
        F.when(F.col("l_orderkey") % 3 == 0, F.concat(F.lit("P"), F.col("part_key").cast("string"))).alias("part_id"),
    )


def links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(part_key, model_id): the models of a part's suffix; offers share their part's links."""
    listed = spark.createDataFrame([(i, m) for i, (_, ms) in enumerate(SUFFIXES) for m in ms], "suffix int, model_id string")
    return parts(spark, sf_dir).select("part_key", "suffix").join(F.broadcast(listed), "suffix").select("part_key", "model_id")


# --- the same views in SQL --------------------------------------------------------------------------------------------


def _lit(x: object) -> str:
    return "NULL" if x is None else str(x) if isinstance(x, int | bool) else "'" + str(x).replace("'", "''") + "'"


def _values(rows: list[tuple]) -> str:
    return ", ".join("(" + ", ".join(_lit(x) for x in r) + ")" for r in rows)


SHOPS_SQL = """shops AS (SELECT 'S' || s_suppkey AS shop_id, s_name AS name, CASE WHEN s_suppkey % 2 = 0 THEN 'feed' ELSE 'crawl' END AS source_type,
  CASE WHEN s_suppkey % 2 = 0 AND s_suppkey % 5 <> 0 THEN 'https://shop' || s_suppkey || '.example.com/feed.xml' END AS feed_url,
  s_acctbal > 3000 AS feed_permission, CASE WHEN s_suppkey % 7 <> 0 THEN 'https://shop' || s_suppkey || '.example.com' END AS base_url,
  s_acctbal > 2000 AS crawl_enabled, s_acctbal > 6000 AS internal_sync FROM supplier)"""
_LIST = "[" + ", ".join(_lit(s[0]) for s in SUFFIXES) + "]"
PARTS_SQL = f"""parts AS (SELECT p_partkey AS part_key, p_name || ' ' || lower(p_type) AS base,
  p_name || ' ' || lower(p_type) || ' ' || {_LIST}[p_partkey % {len(SUFFIXES)} + 1] AS name, (p_partkey % {len(SUFFIXES)})::INT AS suffix,
  p_brand AS brand, p_type AS part_type, p_size AS size, p_retailprice AS retail FROM part)"""
_STATUS = "[" + ", ".join(_lit(s) for s in STATUSES) + "]"
OFFERS_SQL = f"""{PARTS_SQL}, offers AS (SELECT l_orderkey || '-' || l_linenumber || '-' || l_partkey || '-' || l_suppkey AS offer_id, 'S' || l_suppkey AS shop_id,
  l_orderkey || '-' || l_linenumber AS item_id, part_key, name, base, suffix, brand, floor(l_extendedprice / l_quantity + 0.5)::BIGINT AS price,
  'https://shop' || l_suppkey || '.example.com/p/' || part_key AS url,
  CASE WHEN l_linestatus = 'F' THEN l_returnflag <> 'R' WHEN l_returnflag <> 'N' THEN true END AS in_stock, l_shipdate AS last_seen_at,
  {_STATUS}[l_orderkey % {len(STATUSES)} + 1] AS match_status, CASE WHEN l_orderkey % 3 = 0 THEN 'P' || part_key END AS part_id
  FROM lineitem JOIN parts ON l_partkey = part_key)"""
LINKS_SQL = f"""links AS (SELECT part_key, model_id FROM parts JOIN (VALUES {_values([(i, m) for i, (_, ms) in enumerate(SUFFIXES) for m in ms])}) v(suffix, model_id) USING (suffix))"""
MODELS_SQL = f"""models AS (SELECT id, brand, concat_ws(' ', family, displacement::VARCHAR, CASE WHEN types = '' THEN NULL ELSE split_part(types, ', ', 1) END) AS name, family, displacement,
  list_filter(string_split(types, ', '), lambda x: x <> '') AS type_numbers, list_filter(string_split(nicknames, ', '), lambda x: x <> '') AS aliases, needs_verification
  FROM (VALUES {_values(MODELS)}) v(id, brand, family, displacement, types, nicknames, needs_verification))"""
