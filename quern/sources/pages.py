"""Products in landed web pages: JSON-LD, microdata and Open Graph, as column expressions over (url, html).

Elements are cut out of a page by small functions over its tags, in Arrow batches: as folds in SQL they took a hundred times as long.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import availability_schema, compare_key, decode_entities, html_to_text, price_text
from ..functions.urls import path
from ..operators.grading import brand_like
from ..store import kept

_SCRIPT = r"""(?is)<script[^>]*type=["']application/ld\+json["'][^>]*>(.*?)</script>"""
PRODUCT = ["name", "price", "currency", "in_stock", "url", "sku", "mpn", "ean", "image_url", "description"]


#: Levels of a block that one round opens.
LEVELS = 4


def _members(v: Column) -> Column:
    """The array that takes the place of a value: its members, or those of its ``@graph``; null if it is a node or no object at all."""
    return F.coalesce(F.try_variant_get(v, "$", "array<variant>"), F.try_variant_get(v, '$["@graph"]', "array<variant>"))


def _once(df: DataFrame, name: str, c: Column) -> DataFrame:
    """df with a column that is computed once for each row: a plain one is computed again in each filter that Spark moves below it."""
    return df.select("*", F.explode(F.array(c)).alias(name))


def _placed_nodes(pages: DataFrame) -> DataFrame:
    """url, at (places, from the block inwards, which sort as the document does) and v: every object of the pages' JSON-LD blocks."""

    def opened(df: DataFrame, values: Column) -> DataFrame:
        """Objects and arrays ``LEVELS`` further in, each with the members that are to take its place, if any are left."""
        for _ in range(LEVELS):
            values = F.flatten(F.transform(values, lambda x: F.coalesce(_members(x), F.array(x))))
        rows = df.select("url", "at", F.posexplode(values).alias("i", "value")).select("url", F.concat("at", F.array("i")).alias("at"), "value")
        marked = _once(rows, "members", _members(F.col("value"))).where(F.col("members").isNotNull() | F.try_variant_get("value", "$", "map<string,variant>").isNotNull())
        return kept(marked.select("url", "at", F.when(F.col("members").isNull(), F.col("value")).alias("v"), "members"))

    blocks = pages.select("url", F.posexplode(F.regexp_extract_all("html", F.lit(_SCRIPT), 1)).alias("block", "text"))
    # in brackets, so that a value followed by anything is no JSON
    parsed = _once(blocks, "l", F.expr("try_variant_get(try_parse_json('[' || trim(text) || ']'), '$', 'array<variant>')"))
    level = opened(parsed.where("size(l) = 1").select("url", F.array("block").alias("at"), "l"), F.col("l"))
    found = None
    while True:
        nodes = level.where("members is null").select("url", "at", "v")
        found = nodes if found is None else found.unionByName(nodes)
        inner = level.where("members is not null")
        if inner.isEmpty():
            return found
        level = opened(inner, F.col("members"))


def jsonld_nodes(pages: DataFrame) -> DataFrame:
    """url, position and node (variant): every object of the pages' JSON-LD blocks, in the order of the document.

    Members take the place of the array that holds them, and those of an ``@graph`` array that of its object, at any depth:
    what is still to be opened is a table that each round reads and writes anew, until it holds nothing more to open.  A
    block that is no JSON is passed over.  A round opens ``LEVELS`` levels; most pages need one.
    """
    return _placed_nodes(pages).withColumn("position", F.row_number().over(Window.partitionBy("url").orderBy("at"))).select("url", "position", F.col("v").alias("node"))


def _is(kind: str, v: str) -> str:
    """SQL: whether a variant is of a kind, by the first character of its JSON."""
    return f"coalesce(to_json({v}) like '{kind}%', false)"


def _text(*values: str) -> Column:
    """The first of the values' texts that isn't blank: a text itself, the first text of a list, or that of an object's url, however deep.

    values: SQL of variants.
    """
    out = []
    for v in values:
        # names of lambdas stand for values that are used more than once
        urls = """greatest(size(regexp_extract_all(to_json(x), '"url"', 0)), 1)"""  # an object in it more has a url more
        inner = f"""aggregate(sequence(1, {urls}), x, (acc, i) -> if({_is("{", "acc")}, try_variant_get(acc, '$.url', 'variant'), acc))"""
        end = f"""(case when {_is("{", "x")} then {inner} else x end)"""
        listed = f"""get(filter(transform(filter(try_variant_get(e, '$', 'array<variant>'), y -> {_is('"', "y")}), y -> cast(y as string)), y -> trim(y) <> ''), 0)"""
        text = f"""trim(case when {_is('"', "e")} then cast(e as string) else {listed} end)"""
        out.append(F.expr(f"get(filter(transform(transform(filter(array({v}), x -> x is not null), x -> {end}), e -> {text}), t -> t <> ''), 0)"))
    return F.coalesce(*out)


def _given(*values: str) -> str:
    """SQL: the first of variants that is neither missing nor JSON's null."""
    return "coalesce(" + ", ".join(f"if(is_variant_null({v}), null, {v})" for v in values) + ")"


def jsonld_products(pages: DataFrame) -> DataFrame:
    """page_url and the first node of it that is a product with a name and a price."""
    at = lambda node, key: f"try_variant_get({node}, '$.{key}', 'variant')"
    kind = """try_variant_get(node, '$["@type"]', 'variant')"""
    kinds = f"""coalesce(try_variant_get({kind}, '$', 'array<variant>'), array({kind}))"""
    is_product = F.expr(f"""exists({kinds}, x -> {_is('"', "x")} and lower(cast(x as string)) = 'product')""")
    listed = f"""get(filter({at("node", "offers")}::array<variant>, x -> {_is("{", "x")} or {_is("[", "x")}), 0)"""
    offer = f"""case when {_is("[", at("node", "offers"))} then {listed} when {_is("{", at("node", "offers"))} then {at("node", "offers")} end"""
    n = _placed_nodes(pages).withColumnRenamed("v", "node").where(is_product).withColumn("offer", F.expr(offer)).withColumn("price", F.expr(_given(at("offer", "price"), at("node", "price"))))
    # numbers and texts only
    price = F.when(F.expr("""to_json(price) rlike '^["0-9-]'"""), price_text(F.expr("try_variant_get(price, '$', 'string')")))
    n = _once(_once(n, "amount", price).where("amount is not null"), "title", _text(at("node", "name"))).where("title is not null and url is not null")
    mapped = n.select(
        F.col("url").alias("page_url"),
        "at",
        F.col("title").alias("name"),
        F.col("amount").alias("price"),
        _text(at("offer", "priceCurrency")).alias("currency"),
        availability_schema(_text(at("offer", "availability"))).alias("in_stock"),
        F.coalesce(_text(at("offer", "url"), at("node", "url")), F.col("url")).alias("url"),
        _text(at("node", "sku")).alias("sku"),
        _text(at("node", "mpn")).alias("mpn"),
        _text(_given(*(at("node", k) for k in ("gtin13", "gtin", "gtin8", "gtin12", "ean")))).alias("ean"),
        _text(at("node", "image")).alias("image_url"),
        _text(at("node", "description")).alias("description"),
    )
    first = Window.partitionBy("page_url").orderBy("at")
    return mapped.withColumn("n", F.row_number().over(first)).where("n = 1").drop("n", "at")


def _inside(html: str, name: str, at: int) -> str:
    """The HTML from ``at`` to the end tag that closes an element of that name, by depth of tags of the name; without one, to the end."""
    depth = 1
    for m in re.finditer(rf"<(?ai:/?{name})\b[^>]*>", html[at:]):
        mark = m[0]
        if not mark.endswith("/>"):
            depth += -1 if mark[1] == "/" else 1
            if depth <= 0:
                return html[at : at + m.start()]
    return html[at:]


_OPEN = r"""(?i)<([a-zA-Z][a-zA-Z0-9-]*)\b[^>]*\b{attr}[^>]*>"""
_ITEM = r"""itemtype=["'][^"']*schema\.org/Product["']"""


def _opened(attribute: str) -> tuple[re.Pattern[str], re.Pattern[str]]:
    """The attribute alone, which is found sooner, and ``_OPEN`` as Java reads it: letters of all alphabets are part of words, but only A-Z have two cases."""
    return re.compile(rf"(?ai){attribute}"), re.compile(rf"<([a-zA-Z][a-zA-Z0-9-]*)\b[^>]*\b(?ai:{attribute})[^>]*>")


_ITEM_TAG, _NAME_TAG, _BRAND_TAG = (_opened(a) for a in (_ITEM, r"""itemprop=["']name["']""", r"""itemprop=["'](?:brand|manufacturer)["']"""))


def _scope(html: str, opened: tuple[re.Pattern[str], re.Pattern[str]]) -> tuple[str | None, str | None]:
    """The first tag with an attribute, and what stands inside its element."""
    alone, whole = opened
    m = whole.search(html) if alone.search(html) else None
    return (m[0], _inside(html, m[1].lower(), m.end())) if m else (None, None)


def _with_properties(df: DataFrame, scope: str, names: list[str]) -> DataFrame:
    """df with a column for each property: its content, value, href or src, or the text after its tag.

    In steps of columns, since within one expression Spark would search the element anew for each use of what it finds.
    """
    found = df.withColumns({f"__{n}": F.regexp_extract(scope, rf"""(?i)<[^>]+itemprop=["']{n}["'][^>]*>[^<]*""", 0) for n in names})
    ways = ("content|value", "href", "src")
    steps = {}
    for n in names:
        tag = F.substring_index(f"__{n}", ">", 1)  # of tag and text: a tag holds no other ">"
        steps |= {f"__{n}{k}": F.trim(F.regexp_extract(tag, rf"""(?i)\b(?:{a})=["']([^"']+)["']""", 1)) for k, a in enumerate(ways)}
        steps[f"__{n}{len(ways)}"] = F.trim(F.expr(f"substr(`__{n}`, length(substring_index(`__{n}`, '>', 1)) + 2)"))
    found = found.withColumns(steps)
    first = {n: F.coalesce(*(F.when(F.col(f"__{n}{k}") != "", F.col(f"__{n}{k}")) for k in range(len(ways) + 1))) for n in names}
    return found.select(*(F.col(c) for c in df.columns), *(c.alias(f"own_{n}") for n, c in first.items()))


_TAG = re.compile(r"</?([a-zA-Z][a-zA-Z0-9-]*)\b[^>]*>")
_SCOPED = re.compile(r"(?ai)<[a-z][^>]*?\sitemscope(?=[\s=>/])")
_VOID = ("meta", "link", "img", "br", "hr", "input", "source")


def _own_html(inner: str | None) -> str | None:
    """HTML of an element without the elements in it that have a scope of their own, however many and however deep.

    One pass over the tags: outside, a tag with a scope opens a gap; inside, only tags of its name count, up or down, until
    it is closed.  A scope that is never closed reaches to the end; of a void or self-closed one only the tag goes.
    """
    if inner is None:
        return None
    out, at, name, depth = [], 0, "", 0
    for m in _TAG.finditer(inner):
        mark, tag = m[0], m[1].lower()
        if name:
            if (tag == name or tag.startswith(name + "-")) and not mark.endswith("/>"):
                depth += -1 if mark[1] == "/" else 1
                if depth <= 0:
                    name, at = "", m.end()
        elif _SCOPED.match(mark):
            out.append(inner[at : m.start()])
            at = m.end()
            if tag not in _VOID and not mark.endswith("/>"):
                name, depth = tag, 1
    return "".join([*out, "" if name else inner[at:]])


def _without_nested(inner: Column) -> Column:
    return F.udf(_own_html, "string", useArrow=True)(inner)


def _product_scope(html: str | None) -> tuple | None:
    """The first product's element (its tag, what is inside), the tag of its own name and what is in that, and what is in its brand."""
    tag, inner = _scope(html or "", _ITEM_TAG)
    if tag is None:
        return None
    return (tag, inner, *_scope(_own_html(inner), _NAME_TAG), _scope(tag + inner, _BRAND_TAG)[1])


def microdata_products(pages: DataFrame) -> DataFrame:
    """page_url and the properties of the first schema.org Product of a page that has a price.

    The name is the product's own, not that of a brand or offer in it; a name that is only a brand is replaced by the page's heading
    or its og:title.
    """
    # not deterministic for Spark: it would take the column for cheap, and compute it for each of its uses
    found = F.udf(_product_scope, "tag string, inner string, name_tag string, name_inner string, brand_inner string", useArrow=True).asNondeterministic()
    p = pages.where(F.col("html").rlike(_OPEN.format(attr=_ITEM))).select(F.col("url").alias("page_url"), "html", found("html").alias("found"))
    p = _with_properties(p.withColumn("scope", F.concat("found.tag", "found.inner")), "scope", ["price"])
    p = _once(p, "price", price_text(F.col("own_price"))).where("price is not null")
    p = _with_properties(p, "scope", ["priceCurrency", "availability", "url", "sku", "mpn", "gtin13", "gtin", "image", "description"])
    name_tag, name_inner, brand_inner = (F.col(f"found.{c}") for c in ("name_tag", "name_inner", "brand_inner"))
    void = name_tag.rlike(r"(?i)^<(?:meta|link|img|br|hr|input|source)\b")
    brand = F.regexp_extract(brand_inner, r"""(?is)<[^>]+itemprop=["']name["'][^>]*content=["']([^"']+)["']""", 1)
    p = p.withColumns({"content": F.trim(F.regexp_extract(name_tag, r"""(?i)(?:content|value)=["']([^"']+)["']""", 1)), "text": F.when(~void, html_to_text(name_inner)), "brand": F.trim(decode_entities(brand))})
    own_name = F.coalesce(F.when(F.col("content") != "", decode_entities(F.col("content"))), F.when(F.col("text") != "", F.col("text")))
    p = p.withColumns({"own_name": own_name, "brand": F.when(F.col("brand") != "", F.col("brand"))})
    bad = F.col("own_name").isNull() | brand_like(F.col("own_name")) | F.coalesce(compare_key(F.col("own_name")) == compare_key(F.col("brand")), F.lit(False))
    return p.select(
        "page_url",
        F.when(~bad, F.col("own_name")).otherwise(F.coalesce(heading(F.col("html")), og_title(F.col("html")))).alias("name"),
        "price",
        F.col("own_priceCurrency").alias("currency"),
        availability_schema(F.col("own_availability"), offline_words=False).alias("in_stock"),
        F.coalesce("own_url", "page_url").alias("url"),
        F.col("own_sku").alias("sku"),
        F.col("own_mpn").alias("mpn"),
        F.coalesce("own_gtin13", "own_gtin").alias("ean"),
        F.col("own_image").alias("image_url"),
        F.col("own_description").alias("description"),
    )


def heading(html: Column) -> Column:
    return F.nullif(html_to_text(F.regexp_extract(html, r"(?is)<h1\b[^>]*>(.*?)</h1>", 1)), F.lit(""))


def title(html: Column) -> Column:
    return F.nullif(html_to_text(F.regexp_extract(html, r"(?is)<title\b[^>]*>(.*?)</title>", 1)), F.lit(""))


def og_title(html: Column) -> Column:
    """og:title without " :: SHOP" at its end."""
    tag = F.regexp_extract(html, r"""(?i)<meta[^>]+property=["']og:title["'][^>]*>""", 0)
    text = decode_entities(F.regexp_extract(tag, r"""(?i)content=["']([^"']*)["']""", 1))
    return F.nullif(F.trim(F.regexp_replace(text, r"\s+::\s+[^:]+$", "")), F.lit(""))


def has_product_type(html: Column) -> Column:
    return html.rlike(r"""(?i)<meta[^>]+(?:property|name)=["']og:type["'][^>]+content=["']product["']""") | html.rlike(r"""(?i)<meta[^>]+content=["']product["'][^>]+(?:property|name)=["']og:type["']""")


def product_evidence(pages: DataFrame) -> DataFrame:
    """page_url, evidence (jsonld, microdata, og_type_only or null) and the product's fields.  pages: url (unique), html."""
    both = [(kind, df.select("page_url", F.struct(*PRODUCT).alias(kind))) for kind, df in (("jsonld", jsonld_products(pages)), ("microdata", microdata_products(pages)))]
    out = pages.select(F.col("url").alias("page_url"), has_product_type(F.col("html")).alias("og"))
    for _, df in both:
        out = out.join(df, "page_url", "left")
    kind = F.when(F.col("jsonld").isNotNull(), "jsonld").when(F.col("microdata").isNotNull(), "microdata").when(F.col("og"), "og_type_only")
    return out.withColumn("product", F.coalesce("jsonld", "microdata")).select("page_url", kind.alias("evidence"), "product.*")


def refreshed(known: DataFrame, pages: DataFrame) -> DataFrame:
    """item_id, url and kind (disallowed, error, not_found, no_product, item) of each known URL, with the product's new fields.

    known: item_id, url, allowed (by robots); pages: url, status (null: no response), html.  An item keeps its stored id and URL.
    """
    found = product_evidence(pages.where("status < 400 and html is not null").select("url", "html").dropDuplicates(["url"]))
    state = known.join(pages.select("url", "status").dropDuplicates(["url"]), "url", "left")
    joined = state.join(found.select(F.col("page_url").alias("url"), "name", "price", "in_stock"), "url", "left")
    kind = (
        F.when(~F.coalesce("allowed", F.lit(True)), "disallowed")
        .when(F.col("status").isin(404, 410), "not_found")
        .when(F.col("status").isNull() | (F.col("status") >= 400), "error")
        .when(F.col("name").isNull() | F.col("price").isNull(), "no_product")
        .otherwise("item")
    )
    k = joined.withColumn("kind", kind)
    only = lambda c: F.when(F.col("kind") == "item", F.col(c)).alias(c)
    return k.select("item_id", "url", "kind", only("name"), only("price"), only("in_stock"))


def crawled_items(pages: DataFrame) -> DataFrame:
    """Landed pages of shops as offers, as ``crawl`` selects them: id is the SKU or else the path."""
    e = product_evidence(pages).where("name is not null and price is not null")
    return e.select(F.coalesce("sku", path(F.col("page_url"))).alias("item_id"), "name", "price", "currency", F.coalesce("url", "page_url").alias("url"), "image_url", "ean", "mpn", "description", "in_stock", "evidence")
