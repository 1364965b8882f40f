"""Semantics that the queries don't reach: rules one by one, idempotence, and graphs against a union-find."""

import random

import pytest
from pyspark.sql import functions as F

from quern.functions import text as T
from quern.functions import urls as U
from quern.operators import grading as G
from quern.operators import linkage as L
from quern.operators import merging as M
from quern.operators import parts as P
from quern.operators import summaries as S
from quern.operators.components import connected_components
from quern.sources import crawl, feeds, pages
from quern.store import kept


def one(spark, column, **values):
    df = spark.range(1)
    for k, v in values.items():
        df = df.withColumn(k, F.lit(v))
    return df.select(column.alias("x")).first().x


@pytest.mark.parametrize("name, relevant", [("Kryt S11", True), ("Kryt S110", False), ("S11W", False), ("MS11", False), ("ČZ kolo", True), ("øcz", True), ("pionýrský", False)])
def test_relevance(spark, name, relevant):
    assert one(spark, U.relevant_text(F.col("n")), n=name) is relevant


@pytest.mark.parametrize(
    "text, amount, currency", [("1 290,00 CZK", 1290.0, "CZK"), ("1290.00 CZK", 1290.0, "CZK"), ("590", 590.0, None), ("abc", None, None), ("1,290.00 CZK", None, "CZK")]
)
def test_money(spark, text, amount, currency):
    r = one(spark, T.money_with_currency(F.col("t")), t=text)
    assert (r.amount, r.currency) == (amount, currency)


def test_hash_and_slug(spark):
    assert one(spark, T.fnv1a(F.col("t")), t="abc") == "1a47e90b"
    assert one(spark, T.slugify(F.col("t")), t="Řetěz ČZ 175 (sada)") == "retez-cz-175-sada"


@pytest.mark.parametrize("word, stem", [("kolena", "kolen"), ("paprsek", "paprsk"), ("paprsky", "paprsk"), ("osy", "os"), ("karb", "karburator"), ("lanka", "bowden"), ("pneu", "pneu"), ("pistni", "pist")])
def test_stem(spark, word, stem):
    assert one(spark, T.stem(F.col("w")), w=word) == stem


def test_grades(spark):
    rows = [("a", "Jawa kryt", 0.4, "price_invalid"), ("b", "Jawa", 31000.0, "price_over_limit"), ("c", "CZ / HUN", 10.0, "brand_name"), ("d", "Motocykl Jawa", 10.0, "vehicle_name"), ("e", "Motocyklový kryt", 10.0, None), ("f", "Simson sedlo", 10.0, "simson_only"), ("g", "Simson / Jawa sedlo", 10.0, None), ("h", "Tričko", 10.0, "merch"), ("i", "x", float("nan"), "price_invalid")]
    df = spark.createDataFrame(rows, "id string, name string, price double, want string")
    got = {r.id: r.exclusion for r in G.assessed(df).collect()}
    assert got == {r[0]: r[3] for r in rows}


def test_variant_groups(spark):
    df = spark.createDataFrame([("A",), ("A",), ("B",), (None,)], "item_group_id string")
    assert S.variant_groups(df).first().asDict() == {"with_group": 3, "without_group": 1, "groups": 2, "multi_groups": 1, "in_multi_groups": 2}


def test_average_price(spark):
    assert S.prices(spark.createDataFrame([(10,), (10,), (11,)], "price long")).first().avg_price == 10.33


def test_upsert_is_idempotent(spark):
    row = "shop_id string, item_id string, name string, price double, url string, in_stock boolean, last_seen_at timestamp"
    new = spark.createDataFrame([("s", "1", "n", 10.4, "u", None, None), ("s", "2", "m", 5.0, "u", False, None)], row)
    old = spark.createDataFrame([("s", "1", "o", 9, "u", True, None, "manual", "P1")], "shop_id string, item_id string, name string, price long, url string, in_stock boolean, last_seen_at timestamp, match_status string, part_id string")
    first = M.upserted(old, new)
    assert {r.item_id: (r.name, r.price, r.in_stock, r.match_status, r.part_id) for r in first.collect()} == {"1": ("n", 10, True, "manual", "P1"), "2": ("m", 5, False, "pending", None)}
    assert sorted(map(str, M.upserted(first, new).collect())) == sorted(map(str, first.collect()))
    assert {r.change for r in M.diff(new, first).collect()} == {"same"}


def test_empty_source_ages_nothing(spark):
    df = spark.sql("SELECT timestamp'2020-01-01' AS last_seen_at, true AS in_stock")
    assert M.stale_marked(df, F.lit("2020-02-01").cast("timestamp"), source_was_empty=True).first().in_stock is True
    assert M.stale_marked(df, F.lit("2020-02-01").cast("timestamp")).first().in_stock is False
    assert M.stale_marked(df, F.lit("2020-01-04").cast("timestamp")).first().in_stock is True


def test_robots(spark):
    text = "User-agent: a\nDisallow:\nUser-agent: quernbot\nDisallow: /x\nAllow: /x/y\nDisallow: /x/y\n\nUser-agent: *\nDisallow: /"
    rules = crawl.robots_rules(spark.createDataFrame([("h", text), ("e", "")], "host string, text string"), "quernbot")
    urls = spark.createDataFrame([(u,) for u in ("http://h/x", "http://h/x/y", "http://h/z", "http://e/x", "http://none/x")], "url string")
    assert {r.url: r.allowed for r in crawl.allowed_paths(urls, rules).collect()} == {"http://h/x": False, "http://h/x/y": False, "http://h/z": True, "http://e/x": True, "http://none/x": True}


def test_feeds(spark, tmp_path):
    (tmp_path / "h.xml").write_text("<SHOP><SHOPITEM><ITEM_ID>1</ITEM_ID><PRODUCTNAME>a</PRODUCTNAME><PRICE_VAT>12,5</PRICE_VAT><URL>u</URL><DELIVERY_DATE>2.5</DELIVERY_DATE></SHOPITEM><SHOPITEM><ITEM_ID>2</ITEM_ID></SHOPITEM></SHOP>")
    got = feeds.feed_items(spark, str(tmp_path / "h.xml"), "heureka").collect()
    assert [(r.item_id, r.price, r.delivery_days) for r in got] == [("1", 12.5, 3)]
    assert feeds.rejected(feeds.heureka_items(spark, str(tmp_path / "h.xml"))).first().missing == ["name", "price", "url"]


def test_microdata_name_is_not_the_brand(spark):
    html = '<h1>Head</h1><div itemscope itemtype="https://schema.org/Product"><span itemprop="brand" itemscope><meta itemprop="name" content="ACME"></span><b itemprop="name">{}</b><meta itemprop="price" content="1 290,50"></div>'
    df = spark.createDataFrame([("a", html.format("Kryt")), ("b", html.format("Acme")), ("c", "<p>no</p>")], "url string, html string")
    assert {r.page_url: (r.name, r.price) for r in pages.microdata_products(df).collect()} == {"a": ("Kryt", 1290.5), "b": ("Head", 1290.5)}


def test_jsonld_broken_block_is_passed_over(spark):
    block = lambda t: f'<script type="application/ld+json">{t}</script>'
    html = block("{oops") + block('{"@graph": [{"@type": "Thing"}, {"@type": ["product"], "name": " ", "offers": {"price": 1}}, {"@type": "Product", "name": "x", "offers": [{"price": "1 200,5", "availability": "x/OutOfStock"}]}]}')
    r = pages.jsonld_products(spark.createDataFrame([("u", html)], "url string, html string")).collect()
    assert [(x.name, x.price, x.in_stock, x.url) for x in r] == [("x", 1200.5, False, "u")]


def _items(spark, rows):
    schema = "id string, shop_id string, name string, price long, part_type string, note string, model_ids array<string>, fit_generic array<struct<brand:string,displacement:int>>, " + ", ".join(f"{a} string" for a in L.ATTRIBUTES)
    full = [(i, shop, i, price, ptype, None, models, [], *(attrs.get(a) for a in L.ATTRIBUTES)) for i, shop, price, ptype, models, attrs in rows]
    return spark.createDataFrame(full, schema.replace(" with string", " `with` string"))


def test_pair_classes(spark):
    rows = [
        ("a", "s1", 100, "kryt motor", ["m"], {"dimension": "10 x 30"}),
        ("b", "s2", 250, "kryt motor", ["m"], {"dimension": "30x10"}),
        ("c", "s3", 251, "kryt motor", ["m"], {"dimension": "10x30", "position": "front"}),
        ("d", "s4", 100, "kryt motor", ["m"], {"dimension": "10x30", "code": "k1"}),
        ("e", "s5", 100, "kryt motor", ["m"], {"dimension": "10x30", "code": "k2"}),
        ("f", "s6", 100, "kryt", ["n"], {}),
        ("g", "s1", 100, "", ["m"], {}),
    ]
    got = {(r.a, r.b): r["class"] for r in L.classified(_items(spark, rows)).collect()}
    assert got[("a", "b")] == "A" and got[("a", "c")] == "B" and got[("a", "d")] == "A" and got[("d", "e")] == "dropped"
    assert not any("f" in k or "g" in k for k in got)


def test_candidates_against_all_pairs(spark):
    rng = random.Random(3)
    rows = [(f"i{k}", f"s{rng.randrange(4)}", 10, " ".join(sorted(rng.sample("abcdefgh", rng.randint(1, 5)))), rng.sample(["m1", "m2", "m3"], rng.randint(0, 2)), {}) for k in range(120)]
    want = set()
    for x in rows:
        for y in rows:
            if x[0] < y[0] and x[1] != y[1] and (set(x[4]) & set(y[4]) or not (x[4] or y[4])):
                p, q = set(x[3].split()), set(y[3].split())
                if 2 * len(p & q) >= len(p | q):
                    want.add((x[0], y[0]))
    assert {(r.a, r.b) for r in L.candidates(_items(spark, rows)).collect()} == want


def test_two_partners_in_one_shop(spark):
    rows = [("a", "s1", 10, "kryt", ["m"], {"code": None}), ("b", "s2", 10, "kryt", ["m"], {"code": "k1"}), ("c", "s2", 10, "kryt", ["m"], {"code": "k2"}), ("d", "s3", 10, "kryt", ["m"], {})]
    items = _items(spark, rows)
    assert {r.id for r in L.ambiguous_offers(items, L.classified(items)).collect()} == {"a", "d"}


def test_components_against_union_find(spark):
    rng = random.Random(5)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(180)] + [(k, k + 1) for k in range(1000, 1100)]
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        x, y = sorted((find(a), find(b)))
        parent[y] = x
    want = {v: find(v) for v in parent if find(v) != v}
    got = connected_components(spark.createDataFrame(edges, "a long, b long").repartition(5), kept)
    assert {r.vertex: r.component for r in got.collect()} == want
    assert connected_components(spark.createDataFrame([], "a long, b long"), kept).count() == 0


def test_second_apply_changes_nothing(spark):
    plans = spark.createDataFrame(
        [("k1", "t", "n", "n-1", "c", ["m1"], ["o1", "o2"]), ("k2", "t", "n", "n-2", "c", ["m2"], ["o3", "o4"]), ("k3", "t", "n", "n-3", "c", [], ["o5"])],
        "cluster_key string, part_type string, name string, slug string, category string, models array<string>, offer_ids array<string>",
    )
    offers = spark.createDataFrame([("o1", "P1", "auto"), ("o2", "P1", "auto"), ("o3", "P1", "auto"), ("o4", None, "pending"), ("o5", "P2", "auto")], "offer_id string, part_id string, match_status string")
    parts = spark.createDataFrame([("P1", "k9", "x", "slug", "c", "t", True, "auto"), ("P2", "k8", "y", "s2", "c", "t", True, "manual")], "id string, cluster_key string, name string, slug string, category string, part_type string, is_public boolean, source string")
    links = spark.createDataFrame([("P1", "old"), ("P2", "stay")], "part_id string, model_id string")
    one = P.applied(plans, offers, parts, links, kept)
    acts = {r.cluster_key: (r.action, r.part_id) for r in one["actions"].collect()}
    assert acts["k1"] == ("update", "P1") and acts["k2"][0] == "insert" and acts["k3"] == ("skip", "P2")
    assert {r.id: r.slug for r in one["parts"].collect()}["P1"] == "slug"
    assert {(r.part_id, r.model_id) for r in one["part_models"].collect()} == {("P1", "m1"), (acts["k2"][1], "m2"), ("P2", "stay")}
    assert {r.offer_id: r.part_id for r in one["offers"].collect()} == {"o1": "P1", "o2": "P1", "o3": acts["k2"][1], "o4": acts["k2"][1], "o5": "P2"}
    two = P.applied(plans, *(kept(one[k]) for k in ("offers", "parts", "part_models")), kept)
    for k in ("offers", "parts", "part_models"):
        assert sorted(map(str, two[k].select(*sorted(one[k].columns)).collect())) == sorted(map(str, one[k].select(*sorted(one[k].columns)).collect()))


def test_sitemaps(spark):
    maps = spark.createDataFrame([("i", "<?xml version='1.0'?><sitemapindex><sitemap><loc>a</loc></sitemap><sitemap><loc>product-b</loc></sitemap><sitemap><loc>i</loc></sitemap></sitemapindex>"), ("a", "<urlset><url><loc> u1 </loc></url><url><x:loc>no</x:loc></url></urlset>"), ("product-b", "<ns:urlset><url><loc>u2</loc></url><url><loc>u1</loc></url></ns:urlset>"), ("z", "<html/>")], "url string, xml string")
    start = spark.createDataFrame([("s", "i")], "site string, url string")
    assert {r.url for r in crawl.sitemap_urls(start, maps, kept).collect()} == {"u1", "u2"}
    assert {r.url for r in crawl.sitemap_urls(start, maps, kept, documents=2).collect()} == {"u1", "u2"}
    assert [r.url for r in crawl.sitemap_urls(start, maps, kept, urls=1).collect()] == ["u2"]
