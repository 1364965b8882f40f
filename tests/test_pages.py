"""Products in pages, against a plain walk over the parsed page."""

import json
import random
import re

import pytest

from quern.sources import pages


def block(*values):
    return "".join(f'<script type="application/ld+json">{v if isinstance(v, str) else json.dumps(v)}</script>' for v in values)


def jsonld(spark, *htmls):
    df = spark.createDataFrame([(str(k), h) for k, h in enumerate(htmls)], "url string, html string")
    return {r.page_url: r for r in pages.jsonld_products(df).collect()}


def nodes(value):
    """Objects in the order of the document; members stand for arrays and for objects with a graph."""
    if isinstance(value, list):
        return [n for v in value for n in nodes(v)]
    if isinstance(value, dict):
        return nodes(value["@graph"]) if isinstance(value.get("@graph"), list) else [value]
    return []


def random_value(rng, depth, count):
    kind = rng.randrange(5)
    if depth == 0 or kind == 0:
        count[0] += 1
        return rng.choice([{"n": count[0]}, {"n": count[0], "@graph": "no list"}, 5, "x", None])
    members = [random_value(rng, depth - 1, count) for _ in range(rng.randrange(4))]
    return members if kind < 3 else {"n": -1, "@graph": members}


def test_nodes_at_any_depth(spark):
    rng = random.Random(4)
    values = [[random_value(rng, 7, [0]) for _ in range(rng.randint(1, 3))] for _ in range(60)]
    df = spark.createDataFrame([(str(k), block(*v)) for k, v in enumerate(values)], "url string, html string")
    got = {}
    for r in pages.jsonld_nodes(df).selectExpr("url", "position", "to_json(node) AS node").orderBy("position").collect():
        got.setdefault(r.url, []).append(json.loads(r.node))
    want = {str(k): [n for x in v for n in nodes(x)] for k, v in enumerate(values)}
    assert got == {k: v for k, v in want.items() if v}


def test_products_in_graphs_in_arrays(spark):
    product = {"@type": "Product", "name": "deep", "offers": {"price": 5}}
    five = [[{"@graph": [[{"@graph": [{"@type": "Thing"}, product]}]]}]]
    holder = {"@type": "Product", "name": "holder", "offers": {"price": 1}, "@graph": [product]}
    second = {"@type": ["x", "PRODUCT"], "name": "second", "offers": {"price": 2}}
    got = jsonld(spark, block(five, second), block(second, five), block(holder), block({"@graph": {"@type": "Product", "name": "no list"}}), block([], 5, "{oops", five))
    assert {k: r.name for k, r in got.items()} == {"0": "deep", "1": "second", "2": "deep", "4": "deep"}


def test_fields_take_texts_only(spark):
    def product(**more):
        return block({"@type": "Product", "name": "n", "offers": {"price": 1}} | more)

    got = jsonld(
        spark, product(image=[5, " ", " i "]), product(image={"url": {"url": {"url": ["", "deep"]}}}), product(gtin13=None, gtin="g"), product(gtin13=4006381333931, gtin="g"),
        product(offers=["x", {"price": "1 200,50 Kč", "url": {"url": "o"}}]), product(offers={"price": "on request"}, price=7), product(offers={"price": None}, price=7), product(offers={"price": [5]}),
        product(offers={"price": True}), product(name={"url": "from url"}), product(sku=5), product(url="own", offers={"price": "3", "url": "  "}),
    )
    row = {int(k): r for k, r in got.items()}
    assert (row[0].image_url, row[1].image_url, row[2].ean, row[3].ean) == ("i", "deep", "g", None)
    assert (row[4].price, row[4].url, row[6].price, row[9].name, row[10].sku, row[11].url) == (1200.5, "o", 7, "from url", None, "own")
    assert not {5, 7, 8} & set(row)


def own_html(inner):
    """The element without nested scopes, by removing one after the other."""
    scope = re.compile(r"(?i)<([a-zA-Z][a-zA-Z0-9-]*)\b[^>]*?\sitemscope(?=[\s=>/])[^>]*>")
    while m := scope.search(inner):
        end = m.end()
        if m[1].lower() not in pages._VOID and not m[0].endswith("/>"):
            depth, end = 1, len(inner)
            for t in re.finditer(rf"(?i)<(/?){m[1]}\b[^>]*?(/?)>", inner[m.end() :]):
                depth += 0 if t[2] else -1 if t[1] else 1
                if not depth:
                    end = m.end() + t.end()
                    break
        inner = inner[: m.start()] + inner[end:]
    return inner


def test_nested_scopes(spark):
    rng = random.Random(9)
    bits = ['<div itemscope itemprop="x">', "<div>", "</div>", "<span itemscope>", "</span>", "<span>", "<meta itemscope>", "<link/>", "<b itemscope/>", "<div-x>", "é text", "<p>", "</p>", "a < b", '<DIV class="itemscope">', "\n"]
    made = ["".join(rng.choice(bits) for _ in range(rng.randrange(40))) for _ in range(400)]
    made += ["".join(f'<div itemscope>{k}<div>in</div></div><i>{k}</i>' for k in range(300)), "<div itemscope>" * 50 + "x" + "</div>" * 50 + "own", "", "<div itemscope>open"]
    df = spark.createDataFrame([(k, h) for k, h in enumerate(made)], "k int, h string")
    from pyspark.sql import functions as F

    got = {r.k: r.own for r in df.select("k", pages._without_nested(F.col("h")).alias("own")).collect()}
    assert got == {k: own_html(h) for k, h in enumerate(made)}


@pytest.mark.parametrize("nested", [0, 1, 20])
def test_product_name_behind_nested_scopes(spark, nested):
    inner = "".join(f'<div itemprop="isRelatedTo" itemscope><div><b itemprop="name">other {k}</b></div></div>' for k in range(nested))
    html = f'<div itemscope itemtype="https://schema.org/Product">{inner}<div><h2 itemprop="name">own <i>name</i></h2></div><meta itemprop="price" content="5"></div>'
    assert [(r.name, r.price) for r in pages.microdata_products(spark.createDataFrame([("u", html)], "url string, html string")).collect()] == [("own name", 5.0)]


def test_nine_levels_take_few_rounds(spark, monkeypatch):
    rounds = []
    monkeypatch.setattr(pages, "kept", lambda df, keep=pages.kept: rounds.append(df) or keep(df))
    value = {"n": 1}
    for _ in range(9):
        value = [5, {"@graph": [value]}]
    df = spark.createDataFrame([("u", block(value))], "url string, html string")
    assert [json.loads(r.node) for r in pages.jsonld_nodes(df).selectExpr("to_json(node) AS node").collect()] == [{"n": 1}]
    assert len(rounds) <= 5  # 18 levels


def test_what_a_page_is_searched_for_is_searched_once(spark):
    df = spark.createDataFrame([("u", "x")], "url string, html string")
    plan = pages.microdata_products(df)._jdf.queryExecution().optimizedPlan().toString()
    for name in ("price", "sku", "availability"):
        assert len(re.findall(rf"""itemprop=\["'\]{name}\["'\]""", plan)) == 1, name


def test_evidence_of_each_kind(spark):
    micro = '<div itemscope itemtype="https://schema.org/Product"><b itemprop="name">m</b><meta itemprop="price" content="5"></div>'
    og = '<meta property="og:type" content="product">'
    ld = block({"@type": "Product", "name": "j", "offers": {"price": 4}})
    htmls = [ld + micro + og, micro + og, og, "<p>none</p>", block({"@type": "Product", "name": "no price"}) + og, '<meta content="product" name="og:type">']
    df = spark.createDataFrame([(str(k), h) for k, h in enumerate(htmls)], "url string, html string")
    got = {r.page_url: (r.evidence, r.name) for r in pages.product_evidence(df).collect()}
    assert got == {"0": ("jsonld", "j"), "1": ("microdata", "m"), "2": ("og_type_only", None), "3": (None, None), "4": ("og_type_only", None), "5": ("og_type_only", None)}


def test_pages_of_many_scopes_in_little_time(spark):
    """2,000 pages with 400 tags each, from one small file: over all cores, and in one pass over the tags."""
    import time

    html = '<div itemscope itemtype="https://schema.org/Product"><meta itemprop="price" content="5">' + '<div itemscope><b itemprop="name">other</b></div>' * 100 + '<b itemprop="name">own</b></div>'
    from pyspark.sql import functions as F

    df = spark.range(2000).select(F.col("id").cast("string").alias("url"), F.concat(F.lit(html), F.col("id").cast("string")).alias("html"))
    found = pages.microdata_products(df)
    assert found.where("name = 'own' and price = 5").count() == 2000  # also starts the workers
    began = time.perf_counter()
    assert found.where("name = 'own'").count() == 2000
    assert time.perf_counter() - began < 5


def test_spread_over_all_cores(spark):
    from quern.store import spread

    n = 2 * spark.sparkContext.defaultParallelism
    assert spread(spark.range(10, numPartitions=1)).rdd.getNumPartitions() >= n and spread(spark.range(10), "id").rdd.getNumPartitions() >= n
