"""Crawls of sites that list more than the crawler's usual limits."""

import random

from pyspark.sql import functions as F

from quern.sources import crawl
from quern.store import kept

LISTED = 5200


def _site(spark):
    site = spark.createDataFrame([("s", "s.example.com", 200, None, "<html></html>")], "site string, host string, status int, error string, home string")
    robots = spark.createDataFrame([("s.example.com", 200, "User-agent: *\nDisallow: /private\n")], "host string, status int, text string")
    urls = [f"https://s.example.com/p/{k}" for k in range(LISTED)]
    xml = "<urlset>" + "".join(f"<url><loc>{u}</loc></url>" for u in urls) + "</urlset>"
    maps = spark.createDataFrame([("https://s.example.com/sitemap.xml", xml)], "url string, xml string")
    html = '<script type="application/ld+json">{"@type":"Product","name":"n","offers":{"price":"10.00","priceCurrency":"CZK"}}</script>'
    pages = spark.createDataFrame([(u, 200, html) for u in urls], "url string, status int, html string")
    return site, robots, maps, pages


def test_crawl_without_limits_gives_every_listed_page(spark):
    keep = lambda df: df
    assert crawl.crawled(*_site(spark), "quernbot", keep, most=10**9, documents=None, urls=None).count() == LISTED
    report = crawl.probe_report(*_site(spark), "quernbot", keep, documents=None, urls=None).first()
    assert (report.sitemap_urls, report.products) == (LISTED, 3)


def test_sitemaps_nested_deeper_than_any_limit(spark):
    index = lambda *u: "<sitemapindex>" + "".join(f"<sitemap><loc>{x}</loc></sitemap>" for x in u) + "</sitemapindex>"
    maps = [(f"i{k}", index(f"i{k + 1}", "i0")) for k in range(15)] + [("i15", "<urlset><url><loc>deep</loc></url></urlset>")]
    df = spark.createDataFrame(maps, "url string, xml string")
    start = spark.createDataFrame([("s", "i0"), ("none", "nowhere")], "site string, url string")
    assert [tuple(r) for r in crawl.sitemap_urls(start, df, kept, None, None).collect()] == [("s", "deep")]


def test_running_sums_split_a_hot_group(spark):
    rng = random.Random(5)
    rows = [("hot" if rng.random() < 0.9 else rng.choice(["a", None, "b"]), k, rng.randint(0, 5)) for k in range(4000)]
    rng.shuffle(rows)
    sums, want = {}, set()
    for site, k, cost in sorted(rows, key=lambda r: r[1]):
        sums[site] = sums.get(site, 0) + cost
        want.add((site, k, cost, sums[site]))
    df = spark.createDataFrame(rows, "site string, k int, cost int")
    done = crawl.running_sums(df, "site", ["k"], F.col("cost"), kept, ranges=16)
    assert {tuple(r) for r in done.collect()} == want and done.columns == ["site", "k", "cost", "spent"]
    within = crawl.within_budget(df, "site", ["k"], 100, kept, reserve=10, cost="cost")
    assert {tuple(r) for r in within.collect()} == {w for w in want if w[3] <= 90}
    assert crawl.running_sums(df.limit(0), "site", ["k"], F.col("cost"), kept).count() == 0


def test_ranges_are_even_where_one_site_has_nearly_all(spark):
    seen = []

    def keep(df):
        out = kept(df)
        if "__range" in df.columns:
            seen.append({r["__range"]: r["count"] for r in out.groupBy("__range").count().collect()})
        return out

    df = spark.range(20_000).select(F.when(F.col("id") % 20 == 0, "x").otherwise("hot").alias("site"), "id")
    crawl.running_sums(df, "site", ["id"], F.lit(1), keep, ranges=20)
    assert len(seen[0]) == 20 and max(seen[0].values()) < 3 * 1000
