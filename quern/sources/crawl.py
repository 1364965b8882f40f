"""Robots rules, sitemaps, budgets and probes over landed documents; nothing here fetches anything.

Landed tables: robots (host, status, text), sitemaps (url, status, xml), pages (url, status, html).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.urls import likely_product, part, path
from ..operators.grading import platform, reachability
from ..operators.ranges import running_sums
from .pages import product_evidence

SITEMAPS = 20
SITEMAP_URLS = 5000
BUDGET = 300
#: Requests that a probe keeps for what comes after its sitemaps.
RESERVE = 5
# Where feeds are looked for.
FEED_PATHS = {
    "upgates": ["/feed/heureka/", "/feed/google/", "/export/heureka.xml", "/export/google.xml"],
    "eshop-rychle": ["/heureka-feed.xml", "/feeds/heureka.txt", "/feeds/google.xml"],
    "prestashop": ["/modules/heurekacz/heureka.xml", "/modules/googleshopping/google.xml", "/module/heurekafeed/export"],
    "opencart": ["/index.php?route=extension/feed/google_sitemap", "/index.php?route=feed/heureka", "/index.php?route=feed/google_base/sitemap"],
    "woocommerce": ["/?feed=heureka", "/?feed=google_product_feed", "/wp-content/uploads/heureka.xml"],
}


def robots_lines(robots: DataFrame) -> DataFrame:
    """host, pos, field and value of every line of robots files that has a field; comments are cut."""
    lines = robots.where("text is not null").select("host", F.posexplode(F.split("text", r"\r?\n")).alias("pos", "line"))
    bare = F.trim(F.regexp_replace("line", "#.*$", ""))
    field = F.lower(F.trim(F.regexp_extract(bare, "^([^:]*):", 1)))
    return lines.where(bare.contains(":")).select("host", "pos", field.alias("field"), F.trim(F.regexp_replace(bare, "^[^:]*:", "")).alias("value"))


def robots_groups(lines: DataFrame) -> DataFrame:
    """lines with grp: a group begins with a user agent after any rule; empty Disallow lines are no rules and end nothing.

    Sitemap lines belong to no group.
    """
    rule = ((F.col("field").isin("disallow", "allow")) & (F.col("value") != "")) | ((F.col("field") == "crawl-delay") & F.col("value").rlike(r"^[+-]?\.?\d"))
    kind = F.when(F.col("field") == "user-agent", "a").when(rule, "r")
    marked = lines.where("field <> 'sitemap'").withColumn("mark", kind).where("mark is not null")
    order = Window.partitionBy("host").orderBy("pos")
    starts = (F.col("mark") == "a") & F.coalesce(F.lag("mark").over(order) == "r", F.lit(True))
    return marked.withColumn("grp", F.sum(starts.cast("int")).over(order)).where("grp > 0").drop("mark")


def robots_rules(robots: DataFrame, bot: str) -> DataFrame:
    """host, path and allowed: rules of the first group for the bot, or else of the first group for all.

    A group is the bot's if an agent's name is part of the bot's name or the other way round.
    """
    g = robots_groups(robots_lines(robots))
    agent = F.lower("value")
    own = F.lit(bot.lower()).contains(agent) | agent.contains(bot.lower())
    agents = g.where("field = 'user-agent'").groupBy("host", "grp").agg(F.max(own).alias("own"), F.max(F.col("value") == "*").alias("all"))
    chosen = agents.groupBy("host").agg(F.coalesce(F.min(F.when(F.col("own"), F.col("grp"))), F.min(F.when(F.col("all"), F.col("grp")))).alias("grp"))
    rules = g.where("field in ('disallow', 'allow')").join(chosen, ["host", "grp"], "left_semi")
    return rules.select("host", F.col("value").alias("path"), (F.col("field") == "allow").alias("allowed"))


def robots_sitemaps(robots: DataFrame) -> DataFrame:
    """host and url of the sitemaps that robots files name, or else the usual place."""
    named = robots_lines(robots).where("field = 'sitemap' and value <> ''").select("host", F.col("value").alias("url"))
    usual = robots.select("host").distinct().join(named, "host", "left_anti").select("host", F.concat(F.lit("https://"), "host", F.lit("/sitemap.xml")).alias("url"))
    return named.unionByName(usual)


def robots_state(status: Column) -> Column:
    """found, not_found, or unknown (server errors and no answer)."""
    return F.when(status < 400, "found").when((status >= 400) & (status < 500), "not_found").otherwise("unknown")


def allowed_paths(urls: DataFrame, rules: DataFrame, url: str = "url") -> DataFrame:
    """urls with allowed: the longest rule that the path begins with decides; a tie forbids, no rule allows.

    Rules of a host are a short list, so each host's list is joined to its URLs and the longest match is taken in place: no row for
    each URL and rule is made.
    """
    lists = rules.groupBy("host").agg(F.collect_set(F.struct(F.length("path").alias("n"), (~F.col("allowed")).alias("deny"), "path")).alias("__rules"))
    hit = F.filter("__rules", lambda r: F.coalesce(path(F.col(url)), F.lit("/")).startswith(r["path"]))
    joined = urls.withColumn("__host", part(F.col(url), "HOST")).join(lists.withColumnRenamed("host", "__host"), "__host", "left")
    return joined.withColumn("allowed", F.coalesce(~F.array_max(hit)["deny"], F.lit(True))).drop("__host", "__rules")


def sitemap_entries(sitemaps: DataFrame) -> DataFrame:
    """url of the document, is_index, position and loc.  The root's local name decides; prefixed loc elements don't count."""
    root = F.lower(F.regexp_extract("xml", r"(?s)^\s*(?:<\?.*?\?>|<!--.*?-->|<![^>]*>|\s)*<(?:[\w.-]+:)?([\w.-]+)", 1))
    locs = F.filter(F.transform(F.regexp_extract_all("xml", F.lit(r"(?i)<loc(?:\s[^>]*)?>([^<]*)</loc\s*>"), 1), lambda x: F.trim(x)), lambda x: x != "")
    return sitemaps.where("xml is not null").select("url", (root == "sitemapindex").alias("is_index"), F.posexplode(locs).alias("position", "loc")).where(root.isin("sitemapindex", "urlset")).withColumn("loc", _xml_text(F.col("loc")))


def _xml_text(c: Column) -> Column:
    for a, b in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;", "'"), ("&amp;", "&")):
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def sitemap_score(url: Column) -> Column:
    """0 for sitemaps of products, 2 for those of images, blogs and pages, else 1."""
    u = F.lower(url)
    return F.when(u.rlike("produ[ck]t|zbozi|goods|item"), 0).when(u.rlike("image|blog|clan|page|post|news|categor"), 2).otherwise(1)


def sitemap_urls(start: DataFrame, sitemaps: DataFrame, keep: Callable[[DataFrame], DataFrame], documents: int | None = SITEMAPS, urls: int | None = SITEMAP_URLS) -> DataFrame:
    """site and url of the pages that a site's sitemaps list, through indexes however deep they are nested, no document twice.

    start: site, url.  documents, urls: the most documents read and URLs returned of one site (None: all); breadth first, product
    sitemaps before others.
    """
    entries = keep(sitemap_entries(sitemaps))
    level = start.select("site", "url", F.sequence(F.lit(0), F.lit(0)).alias("order")).dropDuplicates(["site", "url"])
    seen, k = None, 0
    while True:
        level = keep(level.withColumn("level", F.lit(k)))
        if level.isEmpty():
            break
        seen, k = level if seen is None else seen.unionByName(level), k + 1
        inner = level.join(entries.where("is_index"), "url").select("site", F.col("loc").alias("url"), F.concat("order", F.array(sitemap_score(F.col("loc")), F.col("position"))).alias("order"))
        first = Window.partitionBy("site", "url").orderBy("order")
        level = inner.withColumn("n", F.row_number().over(first)).where("n = 1").drop("n").join(seen.select("site", "url"), ["site", "url"], "left_anti")
    seen = level if seen is None else seen
    read = seen.join(entries.select("url").distinct(), "url", "left_semi")
    if documents:
        read = within_budget(read, "site", ["level", "order", "url"], documents, keep)
    listed = read.join(entries.where("not is_index"), "url").select("site", F.col("loc").alias("url"), "level", "order", "position")
    once = Window.partitionBy("site", "url").orderBy("level", "order", "position")
    listed = listed.withColumn("n", F.row_number().over(once)).where("n = 1")
    if urls:
        listed = within_budget(listed, "site", ["level", "order", "position", "url"], urls, keep)
    return listed.select("site", "url")


def within_budget(requests: DataFrame, by: str, order: list[str], most: int, keep: Callable[[DataFrame], DataFrame], reserve: int = 0, cost: str | None = None) -> DataFrame:
    """The requests of each group that fit in its budget, in order, less a reserve, with spent: what the group has used with each."""
    return running_sums(requests, by, order, F.lit(1) if cost is None else F.col(cost), keep).where(F.col("spent") <= most - reserve)


def crawled(sites: DataFrame, robots: DataFrame, sitemaps: DataFrame, pages: DataFrame, bot: str, keep: Callable[[DataFrame], DataFrame], most: int = BUDGET, documents: int | None = SITEMAPS, urls: int | None = SITEMAP_URLS) -> DataFrame:
    """Products of the sites' pages: site, page_url, evidence and the product's fields.

    sites: site, host, home (landed HTML).  A site whose robots forbid "/" is left out.  URLs that may be products are read, or all
    if none may; those that robots forbid are not; at most ``most`` of a site, in the order of a hash.  documents, urls: as in ``sitemap_urls``.
    """
    rules = keep(robots_rules(robots.where("status < 400"), bot))
    roots = sites.select("site", "host", platform(F.coalesce("home", F.lit(""))).alias("platform"), F.concat(F.lit("https://"), "host", F.lit("/")).alias("root"))
    open_sites = allowed_paths(roots, rules, "root").where("allowed").drop("allowed")
    # a site without a landed robots file uses the usual sitemap
    named = open_sites.join(robots_sitemaps(robots), "host", "left").select("site", F.coalesce("url", F.concat(F.lit("https://"), "host", F.lit("/sitemap.xml"))).alias("url"))
    found = sitemap_urls(named, sitemaps, keep, documents, urls).join(open_sites.select("site", "platform"), "site")
    marked = found.withColumn("likely", likely_product(F.col("url"), F.col("platform")))
    wanted = marked.join(marked.groupBy("site").agg(F.max("likely").alias("any")), "site").where("likely or not any")
    permitted = allowed_paths(wanted, rules).where("allowed").withColumn("h", F.xxhash64("url"))
    chosen = within_budget(permitted, "site", ["h", "url"], most, keep).select("site", "url")
    got = chosen.join(pages.where("status < 400").select("url", "html").dropDuplicates(["url"]), "url")
    evidence = product_evidence(got.select("url", "html").dropDuplicates(["url"])).where("name is not null and price is not null")
    return got.select("site", F.col("url").alias("page_url")).join(evidence, "page_url")


def probe_report(sites: DataFrame, robots: DataFrame, sitemaps: DataFrame, pages: DataFrame, bot: str, keep: Callable[[DataFrame], DataFrame], products: int = 3, documents: int | None = SITEMAPS, urls: int | None = SITEMAP_URLS) -> DataFrame:
    """One row for each site: reachability, robots, platform, sitemap URLs, feed guesses that are XML, products found.

    sites: site, host, status, error, home.  Feed guesses are landed pages at the usual paths.  documents, urls: as in
    ``sitemap_urls``.
    """
    base = sites.select("site", "host", reachability(F.col("status"), F.col("error")).alias("reachable"), platform(F.coalesce("home", F.lit(""))).alias("platform"))
    state = robots.select("host", robots_state(F.col("status")).alias("robots")).dropDuplicates(["host"])
    starts = sites.join(robots_sitemaps(robots), "host").select("site", "url")
    listed = keep(sitemap_urls(starts, sitemaps, keep, documents, urls))
    guesses = base.sparkSession.createDataFrame([(p, x) for p, xs in FEED_PATHS.items() for x in xs], "platform string, feed_path string")
    tried = base.join(F.broadcast(guesses), "platform").select("site", F.concat(F.lit("https://"), "host", "feed_path").alias("url"))
    feeds = tried.join(pages.where("status < 400").select("url", "html"), "url").where(F.col("html").rlike(r"^\s*<\?xml|^\s*<(?:rss|feed|SHOP)\b")).groupBy("site").agg(F.sort_array(F.collect_set("url")).alias("feeds"))
    counts = listed.groupBy("site").agg(F.count(F.lit(1)).alias("sitemap_urls"))
    found = crawled(sites, robots, sitemaps, pages, bot, keep, 40 - RESERVE, documents, urls).groupBy("site").agg(F.count(F.lit(1)).alias("n"))
    full = base.join(state, "host", "left").join(counts, "site", "left").join(feeds, "site", "left").join(found, "site", "left")
    zero = lambda c: F.coalesce(c, F.lit(0))
    return full.select("site", "reachable", F.coalesce("robots", F.lit("unknown")).alias("robots"), "platform", zero("sitemap_urls").alias("sitemap_urls"), F.coalesce("feeds", F.array().cast("array<string>")).alias("feeds"), F.least(zero("n"), F.lit(products)).alias("products"))
