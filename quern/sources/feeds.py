"""Shop feeds: two XML dialects as one table of offers, read in byte ranges.

A feed is read as text whose records end with ">", so that a large document is split like any text file and no tag is cut.
Each task puts the records of its range together to items; what a range has before its first item and after its last one is a
fragment, and a document's fragments, two for each range, are joined in order.  Elements are matched without regard to case
(and in merchant feeds to prefixes); of repeated elements the last that says something counts.  A row without id, name, price
or URL is left out, and ``rejected`` tells why.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import availability_feed, money_with_currency, number_prefix, round_half_up

COLUMNS = ["item_id", "name", "price", "currency", "url", "image_url", "ean", "mpn", "delivery_days", "category_text", "description", "in_stock", "item_group_id"]
# Element names of the two dialects.
HEUREKA = {"item_id": "ITEM_ID", "name": "PRODUCTNAME", "price": "PRICE_VAT", "url": "URL", "image_url": "IMGURL", "ean": "EAN", "delivery_days": "DELIVERY_DATE", "category_text": "CATEGORYTEXT", "description": "DESCRIPTION"}
GOOGLE = {
    "item_id": "id", "name": "title", "price": "price", "url": "link", "image_url": "image_link", "ean": "gtin", "mpn": "mpn", "category_text": "product_type",
    "description": "description", "item_group_id": "item_group_id", "availability": "availability",
}


def _items(spark: SparkSession, path: str, tags: str, prefix: str) -> DataFrame:
    """text: the items of all documents, each from its start tag to its end tag.  tags, prefix: patterns of tag names and of what may stand before them."""
    opens, closes = (re.compile(rf"<{slash}{prefix}(?:{tags})(?:\s[^<]*)?$", re.IGNORECASE) for slash in ("", "/"))
    names = ["file", "block", "part", "text"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple[str, int, int, str]] = []
        at, held, opened, quoted = None, [], False, False

        def leave() -> None:
            """The end of a range: what is held is its tail, or all of it, if no item begins in it."""
            if at is not None:
                rows.append((*at, 2 if opened else 1, "".join(held)))

        for batch in batches:
            for value, file, block in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if at != (file, block):
                    leave()
                    at, held, opened, quoted = (file, block), [], False, False
                if quoted:
                    quoted = not value.endswith("]]")
                else:
                    cdata = value.rfind("<![CDATA[")
                    quoted = cdata >= 0 and not value.endswith("]]")
                    if cdata < 0 and not value.endswith("/") and opens.search(value):
                        if not opened:
                            rows.append((*at, 1, "".join(held)))
                        opened, held, value = True, [], value[opens.search(value).start() :]
                    elif opened and held and closes.search(value):
                        rows.append((*at, 0, "".join([*held, value, ">"])))
                        held = []
                        continue
                if held or not opened or opens.search(value):
                    held += [value, ">"]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.string(), pa.int64(), pa.int32(), pa.string()), strict=True)], names)
                rows.clear()
        leave()
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.string(), pa.int64(), pa.int32(), pa.string()), strict=True)], names)

    records = spark.read.option("lineSep", ">").text(path).select("value", "_metadata.file_path", "_metadata.file_block_start")
    found = records.mapInArrow(run, "file string, block long, part int, text string")
    order = Window.partitionBy("file").orderBy("block", "part").rowsBetween(Window.unboundedPreceding, 0)
    pieces = found.where("part > 0").withColumn("item", F.sum((F.col("part") == 2).cast("int")).over(order))
    joined = pieces.groupBy("file", "item").agg(F.array_sort(F.collect_list(F.struct("block", "part", "text"))).alias("pieces"))
    whole = joined.select(F.array_join(F.col("pieces.text"), "").alias("text")).where(F.col("text").rlike(rf"(?is)^<{prefix}(?:{tags})[\s>].*</{prefix}(?:{tags})\s*>"))
    return found.where("part = 0").select("text").unionByName(whole)


def _texts(name: str, prefix: str, attribute: str = "") -> Column:
    """What an element's occurrences in an item say, in order, trimmed, blank ones left out; without a text, the attribute's value."""
    start, end = rf"<{prefix}{name}(\s[^>]*?)?", rf"</{prefix}{name}\s*>"
    each = F.regexp_extract_all("text", F.lit(rf"(?is){start}(?:/>|(?<!/)>.*?{end})"), 0)

    def said(x: Column) -> Column:
        inner = F.regexp_replace(F.regexp_extract(x, rf"(?is)^{start}(?<!/)>(.*){end}$", 2), r"(?s)<!--.*?-->", "")
        raw = F.regexp_extract_all(inner, F.lit(r"(?s)<!\[CDATA\[(.*?)\]\]>"), 1)
        plain = F.transform(F.split(inner, r"(?s)<!\[CDATA\[.*?\]\]>"), _decoded)
        value = F.nullif(F.trim(F.array_join(F.flatten(F.transform(F.arrays_zip(plain.alias("p"), raw.alias("r")), lambda z: F.array(z["p"], z["r"]))), ""), F.lit(" \t\r\n")), F.lit(""))
        if not attribute:
            return value
        held = F.regexp_extract(x, rf"""(?is)^<[^>]*?\s{attribute}\s*=\s*(?:"([^"]*)"|'([^']*)')""", 1)
        other = F.regexp_extract(x, rf"""(?is)^<[^>]*?\s{attribute}\s*=\s*'([^']*)'""", 1)
        return F.coalesce(value, F.nullif(F.trim(_decoded(held)), F.lit("")), F.nullif(F.trim(_decoded(other)), F.lit("")))

    return F.array_compact(F.transform(each, said))


def _decoded(c: Column) -> Column:
    """XML's own character references."""
    for name, char in (("lt", "<"), ("gt", ">"), ("quot", '"'), ("apos", "'")):
        c = F.replace(c, F.lit(f"&{name};"), F.lit(char))
    parts, marks = F.split(c, "&#[0-9]{1,7};"), F.regexp_extract_all(c, F.lit("&#([0-9]{1,7});"), 1)
    numbered = F.array_join(F.flatten(F.transform(F.arrays_zip(parts.alias("p"), marks.alias("m")), lambda z: F.array(z["p"], F.decode(F.unhex(F.lpad(F.hex(z["m"].cast("int")), 8, "0")), "UTF-32")))), "")
    return F.replace(F.when(c.contains("&#"), numbered).otherwise(c), F.lit("&amp;"), F.lit("&"))


def _last(texts: Column) -> Column:
    return F.get(texts, F.size(texts) - 1)


def _elements(items: DataFrame, elements: dict[str, str], prefix: str, attributes: dict[str, str] | None = None) -> DataFrame:
    """Each wanted element's texts as an array."""
    return items.select(*(_texts(e, prefix, (attributes or {}).get(e, "")).alias(name) for name, e in elements.items()))


def _texts_last(df: DataFrame, *but: str) -> DataFrame:
    return df.select(*(F.col(c) if c in but else _last(F.col(c)).alias(c) for c in df.columns))


def _finished(df: DataFrame) -> DataFrame:
    return df.select(*(F.col(c) if c in df.columns else F.lit(None).cast("string").alias(c) for c in COLUMNS))


def complete(df: DataFrame) -> DataFrame:
    """Offers that have an id, a name, a price and a URL."""
    return df.where("item_id is not null and name is not null and price is not null and url is not null")


def rejected(df: DataFrame) -> DataFrame:
    """The other rows, with the fields that they lack."""
    missing = F.array_compact(F.array(*(F.when(F.col(c).isNull(), F.lit(c)) for c in ("item_id", "name", "price", "url"))))
    return df.withColumn("missing", missing).where(F.size("missing") > 0)


def heureka_items(spark: SparkSession, path: str) -> DataFrame:
    """All rows of a Heureka feed, complete or not."""
    raw = _texts_last(_elements(_items(spark, path, "SHOPITEM", ""), HEUREKA, ""), "price", "delivery_days")
    number = lambda c: _last(F.array_compact(F.transform(c, number_prefix)))
    days = round_half_up(number("delivery_days")).cast("int")
    return _finished(raw.withColumns({"price": number("price"), "delivery_days": days, "in_stock": F.lit(None).cast("boolean")}))


def google_items(spark: SparkSession, path: str) -> DataFrame:
    """All rows of a merchant feed, RSS items and Atom entries; prices like "1 290,00 CZK"."""
    prefix = r"(?:[\w.-]+:)?"
    raw = _texts_last(_elements(_items(spark, path, "ITEM|ENTRY", prefix), GOOGLE, prefix, {"link": "href"}), "price", "availability")
    money = lambda part: _last(F.array_compact(F.transform("price", lambda x: money_with_currency(x)[part])))
    stock = _last(F.array_compact(F.transform("availability", availability_feed)))
    return _finished(raw.withColumns({"price": money("amount"), "currency": money("currency"), "delivery_days": F.lit(None).cast("int"), "in_stock": stock}))


def feed_items(spark: SparkSession, path: str, dialect: str) -> DataFrame:
    """Complete offers of a landed feed; dialect: heureka or google."""
    if dialect not in ("heureka", "google"):
        raise ValueError(f"unknown feed dialect {dialect}")
    return complete(heureka_items(spark, path) if dialect == "heureka" else google_items(spark, path))


def delimited(spark: SparkSession, path: str, names: list[str], delimiter: str = "~~") -> DataFrame:
    """Lines of fields; the last field may hold the delimiter.  Empty lines are left out."""
    lines = spark.read.text(path).where("trim(value) <> ''")
    cut = F.split("value", "\\Q" + delimiter + "\\E", len(names))
    return lines.select(*(F.get(cut, F.lit(i)).alias(n) for i, n in enumerate(names)))
