"""One query for each operator over the star-schema tables; names begin with the operators' ids."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import urls as U
from ..operators import grading as G
from ..operators import linkage as L
from ..operators.constraints import CheckedTable, Refused, Rules
from ..operators.linkage_classes import Classes
from ..operators import merging as M
from ..operators import model_names as N
from ..operators import offer_names as O
from ..operators import parts as P
from ..operators import samples
from ..operators import summaries as S
from ..operators.search import price_search
from ..sources import catalogue as C
from ..sources import crawl, feeds, pages, seed
from ..store import kept, shared_dir, spread
from .name_cases import MODEL_CASES, OFFER_CASES

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
#: The day that splits order lines into what is stored and what comes in.
SPLIT = "1996-07-01"
NOW = "1998-06-01"
#: Order lines that one task sorts, about.
LINES_A_TASK = 1_000_000


def query(f: Query) -> Query:
    QUERIES[f.__name__] = f
    return f


@query
def c18_price_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return price_search(C.offers(spark, sf_dir), C.shops(spark, sf_dir), seed.models(spark), C.links(spark, sf_dir), "red widget 634", "Jawa", "350", "634")


# --- shops and offers -------------------------------------------------------------------------------------------------


@query
def f1_active_feed_shops(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.active_feed_shops(C.shops(spark, sf_dir)).select("shop_id", "feed_url")


@query
def f2_active_crawl_shops(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.active_crawl_shops(C.shops(spark, sf_dir)).select("shop_id", "base_url")


@query
def f3_internal_shops(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.internal_shops(C.shops(spark, sf_dir)).select("shop_id", "source_type")


@query
def f4_import_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.import_gate(C.shops(spark, sf_dir))


@query
def f20_probe_shops(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.probe_shops(C.shops(spark, sf_dir), excluded=("S1", "S2", "S3")).select("shop_id", "base_url")


@query
def f5_relevant_offers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.relevant_offers(C.parts(spark, sf_dir)).select("part_key", "name")


def _platform_of(key: Column) -> Column:
    return F.element_at(F.array(F.lit("prestashop"), F.lit("woocommerce"), F.lit("upgates"), F.lit("unknown")), (key % 4 + 1).cast("int"))


@query
def f6_slug_relevance(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = C.read(spark, sf_dir, "pages")
    return p.select("page_id", U.slug_text(F.col("url")).alias("slug"), U.relevant_slug(F.col("url")).alias("relevant"))


@query
def f7_product_like_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.read(spark, sf_dir, "pages").select("page_id", U.likely_product(F.col("url"), _platform_of(F.col("page_id"))).alias("likely"))


@query
def f8_platform(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages with a platform's signature added to some of them."""
    marks = ['<link href="https://cdn.myshoptet.com/a.css">', "window.UPGATES", '<meta name="generator" content="PrestaShop">', "catalog/view/theme", "wp-content/plugins/woocommerce", ""]
    mark = F.element_at(F.array(*(F.lit(m) for m in marks)), (F.col("page_id") % len(marks) + 1).cast("int"))
    return C.read(spark, sf_dir, "pages").select("page_id", G.platform(F.concat(F.coalesce("html", F.lit("")), mark)).alias("platform"))


def _brandish(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = ["CZ / HUN", "JAWA Moto spol s r. o.", "CZ (Original)", "Jawa 350", "---", "Moto díly"]
    return C.parts(spark, sf_dir).select("part_key", F.element_at(F.array(*(F.lit(n) for n in names)), (F.col("part_key") % len(names) + 1).cast("int")).alias("name"))


@query
def f9_brand_like_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _brandish(spark, sf_dir).select("part_key", "name", G.brand_like(F.col("name")).alias("brand_like"))


def _items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as incoming offers whose prices reach all limits and whose names meet all rules."""
    p = C.parts(spark, sf_dir)
    price = F.round(F.col("retail") * (F.col("part_key") % 40), 2)
    name = F.when(F.col("suffix") == 9, F.concat(F.lit("Motocykl "), "base")).when(F.col("part_key") % 31 == 3, F.lit("CZ / HUN")).otherwise(F.col("name"))
    category = F.when(F.col("part_key") % 37 == 5, "Modely motocyklů, automobilů > Jawa").otherwise("Díly > Motor")
    return p.select("part_key", name.alias("name"), price.alias("price"), category.alias("category"))


def _assessed(spark: SparkSession, sf_dir: str) -> DataFrame:
    graded = G.assessed(_items(spark, sf_dir), category="category")
    return graded.withColumns({"ignored": G.auto_ignored(F.col("name")), "relevant": U.relevant_text(F.concat_ws(" ", "name", "category"))})


@query
def f10_assess_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The exclusion, flags as text, voucher rule and own brand of each item."""
    df = _assessed(spark, sf_dir)
    return df.select("part_key", "exclusion", F.array_join("flags", ",").alias("flags"), "ignored", G.own_brand(F.col("name")).alias("own_brand"))


@query
def a4_exclusion_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.exclusion_counts(_assessed(spark, sf_dir))


@query
def a4_import_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    change = F.element_at(F.array(F.lit("new"), F.lit("changed"), F.lit("same")), (F.col("part_key") % 3 + 1).cast("int"))
    return S.import_summary(_assessed(spark, sf_dir).withColumn("change", change))


@query
def a6_dry_run_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.first_rows(_assessed(spark, sf_dir).where("relevant and exclusion is null"), ["part_key"]).select("part_key", "name")


@query
def f16_prefilters(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _slugged(spark, sf_dir)
    return p.select("page_id", *(c.alias(n) for n, c in G.prefilters(F.col("slug"), F.col("tokens")).items()))


def _slugged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages with a slug that names a vehicle now and then."""
    more = ["-jawa-350", "-simson-s51", "-cz125", "-kyvacky", "-634638", "", "-honda", "-jawa-simson"]
    add = F.element_at(F.array(*(F.lit(m) for m in more)), (F.col("page_id") % len(more) + 1).cast("int"))
    url = F.concat(F.regexp_replace("url", r"[?#].*$", ""), add)
    p = C.read(spark, sf_dir, "pages").select("page_id", url.alias("url"))
    return p.select("page_id", "url", T.fold(U.slug_text(F.col("url"))).alias("slug"), U.slug_tokens(F.col("url")).alias("tokens"))


@query
def a17_prefilter_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _slugged(spark, sf_dir)
    return S.recall(p, G.prefilters(F.col("slug"), F.col("tokens")), F.col("page_id") % 3 == 0)


@query
def f17_product_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = F.regexp_replace("url", r"[?#].*$", "")
    flat = F.when(F.col("page_id") % 3 == 0, F.regexp_replace(cut, r"/[^/]*/?$", "")).otherwise(cut)
    return G.product_urls(C.read(spark, sf_dir, "pages").select("page_id", flat.alias("url"))).select("page_id", "url")


@query
def f18_url_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = C.read(spark, sf_dir, "pages")
    return p.select("page_id", U.host_path_key(F.col("url")).alias("host_path"), U.path_key(F.col("url")).alias("path"))


@query
def j12_urls_in_sitemap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored URLs that a sitemap lists too (semi), and those it doesn't (anti), by normalised key."""
    p = C.read(spark, sf_dir, "pages").select("page_id", "url", U.host_path_key(F.col("url")).alias("key"))
    listed = p.where("page_id % 3 = 0").select("key").distinct()
    both = p.join(listed, "key", "left_semi").withColumn("listed", F.lit(True))
    return both.unionByName(p.join(listed, "key", "left_anti").withColumn("listed", F.lit(False))).select("page_id", "listed")


@query
def a16_url_depth(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.depth_histogram(C.read(spark, sf_dir, "pages"), F.size(U.segments(F.col("url"))))


@query
def a18_token_frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.document_frequency(_slugged(spark, sf_dir), F.col("tokens"))


@query
def f21_reachability(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statuses and errors derived from events."""
    e = C.read(spark, sf_dir, "events")
    status = F.when(F.col("event_id") % 5 != 0, F.lit(200) + (F.col("event_id") % 7) * 50).cast("int")
    error = F.when(status.isNull(), F.element_at(F.array(F.lit("dns"), F.lit("timeout"), F.lit("other")), (F.col("event_id") % 3 + 1).cast("int")))
    return e.select(G.reachability(status, error).alias("label")).groupBy("label").agg(F.count(F.lit(1)).alias("events"))


@query
def t19_error_class(spark: SparkSession, sf_dir: str) -> DataFrame:
    codes = ["ENOTFOUND", "EAI_AGAIN", "ETIMEDOUT", "ECONNRESET", "ECONNREFUSED", "EPIPE"]
    e = C.read(spark, sf_dir, "events").select(F.element_at(F.array(*(F.lit(c) for c in codes)), (F.col("event_id") % 6 + 1).cast("int")).alias("code"), F.when(F.col("event_id") % 11 == 0, "AbortError").otherwise("Error").alias("name"))
    return e.groupBy(G.error_class(F.col("name"), F.col("code")).alias("kind")).agg(F.count(F.lit(1)).alias("events"))


# --- import -----------------------------------------------------------------------------------------------------------


def _lines(spark: SparkSession, sf_dir: str, new: bool) -> DataFrame:
    """Order lines before or from SPLIT on; one row for each key, the last."""
    o = C.offers(spark, sf_dir).where(F.col("last_seen_at") >= SPLIT if new else F.col("last_seen_at") < SPLIT)
    return M.last_wins(o, M.KEY, [F.col("last_seen_at"), F.col("price"), F.col("offer_id")])


@query
def j1_import_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.diff(_lines(spark, sf_dir, True), _lines(spark, sf_dir, False)).select("shop_id", "item_id", "price", "change")


@query
def k1_upsert_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.upserted(_lines(spark, sf_dir, False), _lines(spark, sf_dir, True))


@query
def k2_price_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    changes = M.diff(_lines(spark, sf_dir, True), _lines(spark, sf_dir, False))
    return M.price_history_rows(changes, F.col("last_seen_at"))


@query
def w6_price_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = C.offers(spark, sf_dir).select("shop_id", "part_key", "price", "last_seen_at", "offer_id")
    changed = M.price_changes(o, ["shop_id", "part_key"], [F.col("last_seen_at"), F.col("offer_id")])
    return changed.select("shop_id", "part_key", "offer_id", "price", "previous")


@query
def w7_last_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.last_wins(C.offers(spark, sf_dir), M.KEY, [F.col("last_seen_at"), F.col("price"), F.col("offer_id")]).select("shop_id", "item_id", "offer_id", "price")


@query
def k3_stale_marking(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = M.stale_marked(C.offers(spark, sf_dir), F.lit(NOW).cast("timestamp"))
    return o.groupBy("shop_id").agg(F.count_if(F.col("stale")).alias("stale"), F.count_if(F.col("in_stock")).alias("in_stock"))


@query
def k4_conditional_ignore(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = M.ignored_where(C.offers(spark, sf_dir), G.auto_ignored(F.col("name")).isNotNull())
    return o.groupBy("match_status").agg(F.count(F.lit(1)).alias("offers"))


@query
def k5_links_rewritten(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored links of some parts by name, of others by description; fresh ones for every second part."""
    links = C.links(spark, sf_dir).withColumn("offer_id", F.col("part_key").cast("string"))
    stored = links.select("offer_id", F.concat("model_id", F.lit("-old")).alias("model_id"), F.when(F.col("part_key") % 3 == 0, "description").otherwise("name").alias("source"))
    fresh = C.parts(spark, sf_dir).where("part_key % 2 = 0").select("part_key").join(links, "part_key", "left").select(F.col("part_key").cast("string").alias("offer_id"), "model_id")
    return M.links_rewritten(stored, fresh)


@query
def k9_waitlist(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, key = C.read(spark, sf_dir, "customer"), F.col("c_custkey")
    email = F.when(key % 9 == 0, "no address").otherwise(F.concat(F.lit(" User"), (key % 700).cast("string"), F.lit("@Example.com ")))
    requests = c.select(key.alias("request_id"), email.alias("email"), F.when(key % 13 == 0, "bot").alias("trap"), (key % 50).alias("created_at"))
    existing = spark.range(0, 100).select(F.concat(F.lit("user"), F.col("id").cast("string"), F.lit("@example.com")).alias("email"))
    return M.subscribed(existing, requests).select("request_id", "email")


@query
def k10_probe_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = C.shops(spark, sf_dir).select("shop_id", "source_type", "crawl_enabled")
    return M.probe_rows(s, F.lit(NOW).cast("timestamp")).select("shop_id", "result")


@query
def k13_shops_updated(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.shops_updated(C.shops(spark, sf_dir), [f"S{i}" for i in range(1, 20)]).select("shop_id", "source_type", "feed_url", "internal_sync")


@query
def k14_dimension_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = C.shops(spark, sf_dir).select("shop_id", "name", "source_type")
    old = s.where(F.substring("name", -1, 1) < "6").select("shop_id", F.lower("name").alias("name"), F.lit("crawl").alias("source_type"))
    return M.dimension_merged(old, s, "shop_id", update=("name",))


@query
def k15_duplicated_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.duplicated_keys(C.offers(spark, sf_dir), M.KEY)


@query
def k15_invalid_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.invalid_values(C.offers(spark, sf_dir), "match_status", ["pending", "auto", "manual"]).groupBy("match_status").agg(F.count(F.lit(1)).alias("offers"))


@query
def k15_checked_write(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Offers as they come, which are refused by rule; mended ones, which are accepted; and a write for an empty table, which then isn't."""
    import uuid

    table = CheckedTable(spark, f"{shared_dir(spark)}/checked-{uuid.uuid4().hex}")
    offers = C.offers(spark, sf_dir).select("offer_id", *M.KEY, "name", "price", "url", "in_stock", "last_seen_at", "match_status")
    shops = kept(C.shops(spark, sf_dir).where("base_url is not null").select("shop_id"))
    rules = Rules(
        required=(*M.KEY, "name", "price", "in_stock"), allowed={"match_status": ("pending", "auto", "manual")}, unique=(tuple(M.KEY), ("offer_id",)), references={"shop_id": (shops, "shop_id")}
    )
    once = M.last_wins(offers, M.KEY, [F.col("last_seen_at"), F.col("price"), F.col("offer_id")]).withColumn("in_stock", F.coalesce("in_stock", F.lit(True)))
    # an offer's id holds its key, so that one row for each key is one for each id: the rule checks it
    mended = once.where("match_status is null or match_status in ('pending', 'auto', 'manual')").join(shops, "shop_id", "left_semi")
    result = []
    for attempt, rows, empty in (("raw", offers, False), ("mended", mended, False), ("again", mended, True)):
        try:
            result.append((attempt, "accepted", table.replace(rows, rules, only_if_empty=empty)))
        except Refused as e:
            result += [(attempt, k, n) for k, n in e.broken.items()]
    return spark.createDataFrame([*result, ("read", "rows", table.read().count())], "attempt string, rule string, rows long")


# --- summaries --------------------------------------------------------------------------------------------------------


@query
def a1_availability(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.availability(C.offers(spark, sf_dir))


@query
def a2_prices(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.prices(C.offers(spark, sf_dir))


@query
def a3_variant_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Group ids from JSON (S24); every tenth is empty."""
    e = C.read(spark, sf_dir, "events")
    key = F.concat(F.get_json_object("props", "$.k"), F.lit("-"), (F.col("event_id") % 400).cast("string"))
    return S.variant_groups(e.select(F.when(F.col("event_id") % 10 == 0, "").otherwise(key).alias("item_group_id")))


@query
def a5_refresh_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    kinds = ["item", "not_found", "error", "disallowed"]
    e = C.read(spark, sf_dir, "events").select(F.element_at(F.array(*(F.lit(k) for k in kinds)), (F.col("event_id") % 4 + 1).cast("int")).alias("kind"))
    return S.refresh_summary(e)


def _levelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    level = F.element_at(F.array(*(F.lit(x) for x in ("type", "type", "type", "type", "nickname", "nickname", None, "brand", None, None, "brand", "brand"))), F.col("suffix") + 1)
    return C.offers(spark, sf_dir).select("shop_id", "name", level.alias("level"), "match_status")


@query
def a7_levels_by_shop(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.levels_by_shop(_levelled(spark, sf_dir))


@query
def a8_levels_after_exclusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.levels_by_shop(_levelled(spark, sf_dir).where(G.name_exclusion(F.col("name")).isNull()))


@query
def a15_status_by_shop(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.status_by_shop(C.offers(spark, sf_dir))


@query
def a20_compacted_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.compacted(C.offers(spark, sf_dir))


@query
def a9_unresolved_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of names, weighted by how often a shop lists the name."""
    names = S.compacted(C.offers(spark, sf_dir))
    token = lambda x: F.struct(F.lit("").alias("brand"), F.when(x.rlike("^[0-9]+$"), "number").otherwise("word").alias("kind"), x.alias("token"))
    return S.unresolved_tokens(names.select(F.transform(F.split("name", " "), token).alias("unresolved"), "count"))


@query
def t6_text_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """T1-T14 on texts made from parts: price text, availability, markers, slug, hash, stem, category, percent."""
    p = C.parts(spark, sf_dir)
    price = F.concat((F.col("part_key") % 9 + 1).cast("string"), F.lit(" "), F.lpad((F.col("part_key") % 1000).cast("string"), 3, "0"), F.lit(",50 CZK"))
    stock = F.element_at(F.array(F.lit("in stock"), F.lit("Out_of stock"), F.lit("preorder"), F.lit("?")), (F.col("part_key") % 4 + 1).cast("int"))
    money = T.money_with_currency(price)
    return p.select(
        "part_key",
        money["amount"].alias("amount"),
        money["currency"].alias("currency"),
        T.availability_feed(stock).alias("in_stock"),
        T.strip_shop_markers(F.concat("name", F.lit(" *M ,,CZ -"))).alias("clean"),
        T.slugify(F.col("name")).alias("slug"),
        T.fnv1a(F.col("base")).alias("hash"),
        T.fold_search(F.col("name")).alias("folded"),
        T.round_half_up(F.col("retail") / 7).alias("rounded"),
        T.percent(F.col("part_key") % 7, F.col("part_key") % 5).alias("percent"),
    )


@query
def t5_stems(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = ["kolena", "koleno", "paprsky", "paprsek", "osy", "karb", "lanka", "simerink", "ocelovych", "pistni", "kryt", "volnobezny", "samolepky"]
    return spark.createDataFrame([(w,) for w in words], "word string").select("word", T.stem(F.col("word")).alias("stem"))


# --- linkage ----------------------------------------------------------------------------------------------------------


def _linked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as items of seven shops, with attributes from key and size."""
    k, size = F.col("part_key"), F.col("size")
    fit_type = "array<struct<brand:string,displacement:int>>"
    own = {
        "color": F.when(size % 3 == 1, "red").when(size % 3 == 2, "blue"),
        "size": F.when(k % 5 == 0, "large"),
        "dimension": F.when(size % 4 == 1, F.concat((size % 6).cast("string"), F.lit(" x 30"))).when(size % 4 == 2, F.concat(F.lit("30x"), (size % 6).cast("string"))),
        "code": F.when(k % 6 == 0, F.concat(F.lit("c"), (size % 2).cast("string"))),
    }
    none = F.lit(None).cast("string")
    fit = F.when((k % 4 == 0) & (k % 8 != 0), F.array(F.struct(F.col("brand").alias("brand"), (size % 2 * 50).cast("int").alias("displacement")))).otherwise(F.array().cast(fit_type))
    return spread(C.parts(spark, sf_dir)).select(
        F.concat(F.lit("p"), k.cast("string")).alias("id"),
        F.when(k % 7 == 0, "motomax").otherwise(F.concat(F.lit("S"), (k % 7).cast("string"))).alias("shop_id"),
        "name",
        T.round_half_up(F.col("retail")).alias("price"),
        F.array_join(F.array_sort(F.array_distinct(F.split("base", " "))), " ").alias("part_type"),
        none.alias("note"),
        F.when(k % 4 != 0, F.array("brand")).otherwise(F.array().cast("array<string>")).alias("model_ids"),
        fit.alias("fit_generic"),
        *(own.get(a, none).alias(a) for a in L.ATTRIBUTES),
        F.when(k % 11 != 0, F.when(k % 2 == 0, "pending").otherwise("auto")).otherwise("manual").alias("match_status"),
        F.when(k % 3 == 0, "type").otherwise("nickname").alias("model_level"),
        F.concat(F.lit("Díly > "), F.element_at(F.array(F.lit("Akce"), F.lit("Motor"), F.lit("Rám")), (size % 3 + 1).cast("int"))).alias("category_text"),
        F.when(k % 5 == 0, F.concat(F.lit("P"), (k % 10).cast("string"))).alias("part_id"),
    )


@query
def c3_bucket_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Classes(_linked(spark, sf_dir), kept).met().select("a", "b", F.round("jaccard", 6).alias("jaccard"))


@query
def c7_classified_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = Classes(_linked(spark, sf_dir), kept).listed()
    return p.select("a", "b", "class", "basis", F.col("shared_text").alias("shared"), L.rounded(F.col("price_ratio")).alias("price_ratio"), F.col("conflicts_text").alias("conflicts"))


@query
def a13_pair_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Classes(_linked(spark, sf_dir), kept).pair_counts()


@query
def a13_conflict_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Classes(_linked(spark, sf_dir), kept).conflict_counts()


@query
def a13_shop_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Classes(_linked(spark, sf_dir), kept).shop_pair_counts()


@query
def c9_ambiguous_offers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Classes(_linked(spark, sf_dir), kept).ambiguous_offers()


def _clustered(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    items = kept(_linked(spark, sf_dir))
    return items, Classes(items, kept).clusters()


@query
def c10_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _clustered(spark, sf_dir)[1]


def _planned(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    items, found = _clustered(spark, sf_dir)
    return items, P.part_plans(items.join(found, "id"))


@query
def c11_part_plans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Key, name, slug, category and models of each planned part."""
    p = _planned(spark, sf_dir)[1]
    return p.select("cluster", "cluster_key", "part_type", "name", "slug", "category", F.array_join("models", ",").alias("models"), F.size("offer_ids").cast("long").alias("offers"))


@query
def c14_applied_plans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What applying the plans does to parts that are there and to new ones."""
    items, plans = _planned(spark, sf_dir)
    plans = kept(plans)
    existing = spark.createDataFrame([(f"P{i}", f"old-{i}", f"part {i}", f"part-{i}", "x", "x", i % 2 == 0, "manual" if i == 5 else "auto") for i in range(10)], "id string, cluster_key string, name string, slug string, category string, part_type string, is_public boolean, source string")
    links = spark.createDataFrame([(f"P{i}", "Brand#1") for i in range(10)], "part_id string, model_id string")
    done = P.applied(plans, items.select(F.col("id").alias("offer_id"), "part_id", "match_status"), existing, links, kept)
    return done["actions"].select("cluster_key", "action", F.when(F.col("action") != "insert", F.col("part_id")).alias("part_id"), "via")


@query
def c14_claimed_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """C14: customers as plans, their order lines as offers of parts by brand and size: nearly all plans touch one another through parts."""
    parts = C.read(spark, sf_dir, "part").select("p_partkey", F.concat_ws("|", "p_brand", "p_size").alias("id"))
    plan_key = lambda c: F.concat(F.lit("c"), F.lpad(F.col(c).cast("string"), 12, "0"))
    lines = (
        C.read(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey").join(C.read(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey"))
        .join(parts, F.col("l_partkey") == F.col("p_partkey")).select(plan_key("o_custkey").alias("cluster_key"), F.col("id").alias("part_id"))
    )
    offers = kept(lines.withColumn("offer_id", F.monotonically_increasing_id()))
    existing = parts.groupBy("id").agg(F.min("p_partkey").alias("first")).select("id", plan_key("first").alias("cluster_key"), F.when(F.col("first") % 10 == 0, "manual").otherwise("auto").alias("source"))
    plans = offers.groupBy("cluster_key").agg(F.collect_list("offer_id").alias("offer_ids"))
    return P.resolved(plans, offers.select("offer_id", "part_id"), kept(existing), kept)


@query
def j7_stale_auto(spark: SparkSession, sf_dir: str) -> DataFrame:
    items, plans = _planned(spark, sf_dir)
    return P.stale_auto(items.select(F.col("id").alias("offer_id"), "match_status", "part_id"), plans).select("offer_id")


@query
def j8_missing_models(spark: SparkSession, sf_dir: str) -> DataFrame:
    wanted = C.links(spark, sf_dir).select(F.when(F.col("part_key") % 50 == 0, F.concat("model_id", F.lit("?"))).otherwise(F.col("model_id")).alias("model_id"))
    return M.missing_keys(wanted, "model_id", seed.models(spark), "id")


@query
def j9_part_models_delta(spark: SparkSession, sf_dir: str) -> DataFrame:
    links = C.links(spark, sf_dir).select(F.col("part_key").alias("part_id"), "model_id")
    return M.delta(links.where("part_id % 3 <> 0"), links.where("part_id % 5 <> 0"))


@query
def j11_near_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.near_types(C.parts(spark, sf_dir).select(F.col("base").alias("part_type")))


@query
def j15_type_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranges = C.read(spark, sf_dir, "part").select(F.lit("Jawa 250/350/500").alias("family"), (F.col("p_size") * 10 + 100).cast("int").alias("lo"), (F.col("p_size") * 12 + 250).cast("int").alias("hi")).distinct()
    return N.type_ranges(ranges, seed.models(spark))


@query
def t3_ranked_b(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Classes(_linked(spark, sf_dir), kept).ranked_b(200).select("a", "b")


@query
def a11_attribute_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.attribute_coverage(_linked(spark, sf_dir), ["color", "size", "dimension", "code", "part_type"])


@query
def a12_top_part_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.top_values(_linked(spark, sf_dir), F.array("part_type"), 150)


@query
def t6_hash_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A sampling operator: 50 documents by hash."""
    return S.hash_sample(C.read(spark, sf_dir, "documents").select("doc_id", "lang"), "doc_id", 50, 20260930)


@query
def t6_seeded_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """T-6: 30 parts whose name has a match, then 20 of the others, from one run of the generator, as a shuffle in order of keys gives them."""
    p = C.parts(spark, sf_dir).select("part_key", "suffix")
    other = F.col("suffix").isin(6, 8, 9)
    matched = kept(p.where(~other))
    one = samples.seeded_sample(matched, ["part_key"], 30, 20260930, kept)
    two = samples.seeded_sample(p.where(other), ["part_key"], 20, 20260930, kept, used=max(matched.count() - 1, 0))
    return one.select(F.lit("matched").alias("kind"), "place", "part_key").unionByName(two.select(F.lit("other").alias("kind"), "place", "part_key"))


@query
def s19_request_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = C.read(spark, sf_dir, "events").select("event_id", "user_id", (F.col("event_id") % 3 + 1).alias("cost"))
    return crawl.within_budget(e, "user_id", ["event_id"], 40, kept, reserve=crawl.RESERVE, cost="cost").select("event_id", "spent")


@query
def s19_hot_site_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is spent with each request where nine of ten requests are for one site."""
    site = F.when(F.col("event_id") % 10 == 0, F.col("user_id").cast("string")).otherwise("hot")
    e = C.read(spark, sf_dir, "events").select("event_id", site.alias("site"), (F.col("event_id") % 3 + 1).alias("cost"))
    return crawl.running_sums(e, "site", ["event_id"], F.col("cost"), kept).select("event_id", "site", "spent")


# --- pages and feeds --------------------------------------------------------------------------------------------------


def _product_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages made from parts: JSON-LD as an object, a list or a graph, some broken, some of another type."""
    p = spread(C.parts(spark, sf_dir))
    k = F.col("part_key")
    url = F.concat(F.lit("https://shop.example.com/p/"), k.cast("string"))
    offer = F.struct(F.format_string("%.2f", F.col("retail")).alias("price"), F.lit("CZK").alias("priceCurrency"), F.when(k % 2 == 0, "https://schema.org/InStock").otherwise("https://schema.org/OutOfStock").alias("availability"))
    kind = F.when(k % 5 == 4, "Article").otherwise("Product")
    node = F.to_json(F.struct(kind.alias("@type"), F.col("base").alias("name"), F.concat(F.lit("SKU"), k.cast("string")).alias("sku"), F.lit("4006381333931").alias("gtin13"), offer.alias("offers")))
    body = F.when(k % 4 == 0, node).when(k % 4 == 1, F.concat(F.lit('[{"@type":"WebSite","name":"x"},'), node, F.lit("]"))).when(k % 4 == 2, F.concat(F.lit('{"@graph":['), node, F.lit("]}"))).otherwise(F.concat(node, F.when(k % 8 == 3, "}").otherwise("")))
    html = F.concat(F.lit('<html><head><script type="application/ld+json">'), body, F.lit("</script></head><body><h1>"), "base", F.lit("</h1></body></html>"))
    return p.select("part_key", url.alias("url"), html.alias("html"), "base", "retail")


@query
def s4_jsonld_products(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pages.jsonld_products(_product_pages(spark, sf_dir).select("url", "html"))
    return found.select("page_url", "name", "price", "currency", "in_stock", "url", "sku", "ean")


@query
def s6_microdata_products(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = spread(C.parts(spark, sf_dir))
    k = F.col("part_key").cast("string")
    brand = F.lit('<span itemprop="brand" itemscope itemtype="https://schema.org/Brand"><meta itemprop="name" content="CZ"></span>')
    name = F.when(F.col("part_key") % 3 == 0, F.lit('<b itemprop="name">CZ</b>')).otherwise(F.concat(F.lit('<h2 itemprop="name"><span>'), "base", F.lit(" &amp; co</span></h2>")))
    price = F.concat(F.lit('<div itemprop="offers" itemscope><meta itemprop="price" content="'), F.format_string("%.2f", F.col("retail")), F.lit('"><link itemprop="availability" href="http://schema.org/InStock"></div>'))
    html = F.concat(F.lit("<html><h1>Page "), k, F.lit('</h1><div class="a" itemscope itemtype="http://schema.org/Product"><div>'), brand, name, price, F.lit('</div></div><p itemprop="name">other</p></html>'))
    found = pages.microdata_products(p.select(F.concat(F.lit("https://shop.example.com/"), k).alias("url"), html.alias("html")))
    return found.select("page_url", "name", "price", "in_stock")


@query
def s8_page_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = C.read(spark, sf_dir, "pages").select(F.col("page_id").cast("string").alias("url"), "html")
    return pages.product_evidence(p).select("page_url", "evidence", "name")


@query
def s4_jsonld_nested(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each part's node five to nine levels deep in arrays and graphs, behind a node of another type and before one that comes too late."""
    p = spread(C.parts(spark, sf_dir))
    k = F.col("part_key")
    node = F.to_json(F.struct(F.lit("Product").alias("@type"), F.col("base").alias("name"), F.struct(F.struct(F.concat(F.lit("i"), k.cast("string")).alias("url")).alias("url")).alias("image"), F.struct(F.col("retail").alias("price")).alias("offers")))
    levels = (k % 3 + 2).cast("int")
    opened = F.concat(F.lit('[{"@type":"WebPage"},'), F.repeat(F.lit('{"@graph":[5,['), levels), node, F.repeat(F.lit("]]}"), levels), F.lit(',{"@type":"Product","name":"late","offers":{"price":1}}]'))
    html = F.concat(F.lit("<script type='application/ld+json'>"), opened, F.lit("</script>"))
    found = pages.jsonld_products(p.select(k.cast("string").alias("url"), html.alias("html")))
    return found.select("page_url", "name", "price", "image_url")


@query
def s6_nested_scopes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts behind as many related products as the last two digits of their key say, each a scope with tags of the same name in it."""
    p = spread(C.parts(spark, sf_dir))
    k = F.col("part_key")
    other = F.lit('<div itemscope itemprop="isRelatedTo"><div><b itemprop="name">other</b></div><meta itemscope itemprop="x"></div>')
    html = F.concat(
        F.lit('<div itemscope itemtype="https://schema.org/Product"><meta itemprop="price" content="'), F.format_string("%.2f", F.col("retail")), F.lit('">'),
        F.repeat(other, (k % 100).cast("int")), F.lit('<div><b itemprop="name">'), "base", F.lit("</b></div></div>"),
    )
    return pages.microdata_products(p.select(k.cast("string").alias("url"), html.alias("html"))).select("page_url", "name", "price")


@query
def s8_evidence_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as pages that hold JSON-LD, microdata, an og:type alone, or nothing."""
    p = spread(C.parts(spark, sf_dir))
    k = F.col("part_key")
    price = F.format_string("%.2f", F.col("retail"))
    ld = F.concat(F.lit("<script type='application/ld+json'>"), F.to_json(F.struct(F.when(k % 3 == 0, "Offer").otherwise("Product").alias("@type"), F.col("base").alias("name"), F.struct(price.alias("price")).alias("offers"))), F.lit("</script>"))
    micro = F.concat(F.lit('<div itemscope itemtype="https://schema.org/Product"><b itemprop="name">'), "part_type", F.lit('</b><meta itemprop="price" content="'), price, F.lit('"></div>'))
    part = lambda c, n: F.when(k % n == 0, c).otherwise("")
    html = F.concat(part(ld, 2), part(micro, 5), part(F.lit('<meta property="og:type" content="product">'), 7))
    return pages.product_evidence(p.select(k.cast("string").alias("url"), html.alias("html"))).select("page_url", "evidence", "name", "price")


@query
def t9_page_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = F.col("html")
    return C.read(spark, sf_dir, "pages").select("page_id", pages.title(h).alias("title"), pages.has_product_type(h).alias("og_product"))


ROBOTS = "User-agent: other\nDisallow: /\n\nUser-agent: quernbot # us\nDisallow: /en/\nAllow: /en/6\nDisallow: /fr\nAllow: /fr\nDisallow:\nCrawl-delay: 3\n\nUser-agent: *\nDisallow: /private\nSitemap: https://x.example.com/s.xml\n"


@query
def s14_robots_allowed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages against rules; the same robots file on every host."""
    p = C.read(spark, sf_dir, "pages").select("page_id", "url")
    robots = p.select(U.part(F.col("url"), "HOST").alias("host")).distinct().withColumn("text", F.lit(ROBOTS))
    return crawl.allowed_paths(p, crawl.robots_rules(robots, "QuernBot")).select("page_id", "allowed")


def _sitemaps(spark: SparkSession, urls: DataFrame, root: str, most: int = 10_000) -> DataFrame:
    """url and xml of sitemaps that list the URLs, each about ``most`` of them, and of the index that names them.  urls: loc."""
    n = urls.count() // most + 1
    at = lambda k: F.concat(F.lit(f"{root}s"), k.cast("string"), F.lit(".xml"))
    listed = F.array_join(F.sort_array(F.collect_list(F.concat(F.lit("<url><loc> "), "loc", F.lit(" </loc></url>")))), "")
    maps = urls.groupBy(F.pmod(F.xxhash64("loc"), F.lit(n)).alias("k")).agg(F.concat(F.lit('<?xml version="1.0"?><urlset>'), listed, F.lit("</urlset>")).alias("xml"))
    # a document that isn't there, and one that is named twice
    named = spark.range(n + 1).select(at(F.col("id")).alias("loc")).unionByName(spark.range(1).select(at(F.col("id")).alias("loc")))
    index = named.agg(F.concat(F.lit("<sitemapindex>"), F.array_join(F.collect_list(F.concat(F.lit("<sitemap><loc>"), "loc", F.lit("</loc></sitemap>"))), ""), F.lit("</sitemapindex>")).alias("xml"))
    return maps.select(at(F.col("k")).alias("url"), "xml").unionByName(index.select(F.lit(f"{root}sitemap.xml").alias("url"), "xml"))


@query
def s10_sitemap_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages in sitemaps under an index, which twelve further indexes lead to."""
    p = C.read(spark, sf_dir, "pages").select(F.concat(F.lit("https://x.example.com/p/"), F.col("page_id").cast("string")).alias("loc"))
    root = "https://x.example.com/"
    chain = [(f"{root}i{k}.xml", f"<sitemapindex><sitemap><loc>{root}{f'i{k + 1}' if k < 11 else 'sitemap'}.xml</loc></sitemap><sitemap><loc>{root}i0.xml</loc></sitemap></sitemapindex>") for k in range(12)]
    start = spark.createDataFrame([("x", f"{root}i0.xml")], "site string, url string")
    return crawl.sitemap_urls(start, spark.createDataFrame(chain, "url string, xml string").unionByName(_sitemaps(spark, p, root, 100)), kept, documents=None, urls=None)


def _site_tables(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """A landed crawl of one shop whose sitemaps list the product pages."""
    product = _product_pages(spark, sf_dir).select("url", F.lit(200).alias("status"), "html")
    site = spark.createDataFrame([("shop", "shop.example.com", 200, None, "<html>data-shoptet</html>")], "site string, host string, status int, error string, home string")
    robots = spark.createDataFrame([("shop.example.com", 200, "User-agent: *\nDisallow: /p/1\nAllow: /p/10\n")], "host string, status int, text string")
    return site, robots, _sitemaps(spark, product.select(F.col("url").alias("loc")), "https://shop.example.com/"), product


@query
def s16_crawled_products(spark: SparkSession, sf_dir: str) -> DataFrame:
    site, robots, maps, product = _site_tables(spark, sf_dir)
    found = crawl.crawled(site, robots, maps, product, "quernbot", kept, most=10**9, documents=None, urls=None)
    return found.select("page_url", "name", "price", "evidence")


@query
def s20_probe_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    site, robots, maps, product = _site_tables(spark, sf_dir)
    return crawl.probe_report(site, robots, maps, product, "quernbot", kept, documents=None, urls=None)


@query
def s17_refresh_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _product_pages(spark, sf_dir)
    k = F.col("part_key")
    known = p.select(k.cast("string").alias("item_id"), "url", (k % 13 != 0).alias("allowed"))
    status = F.when(k % 7 == 1, 404).when(k % 7 == 2, 500).when(k % 7 != 3, 200)
    found = pages.refreshed(known, p.select("url", status.cast("int").alias("status"), F.when(status == 200, F.col("html")).alias("html")))
    return found.select("item_id", "kind", "price")


def _landed(df: DataFrame, name: str) -> str:
    """Texts written to the shared folder, a line each, as a feed that was fetched."""
    import uuid

    path = f"{shared_dir(df.sparkSession)}/feed-{name}-{uuid.uuid4().hex}"
    df.write.text(path)
    return path


@query
def s2_heureka_feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = C.parts(spark, sf_dir)
    tag = lambda t, c: F.concat(F.lit(f"<{t}>"), c, F.lit(f"</{t}>"))
    price = F.translate(F.format_string("%.2f", F.col("retail")), ".", ",")
    item = F.concat(
        F.lit("<SHOPITEM>"), tag("ITEM_ID", F.col("part_key").cast("string")), tag("PRODUCTNAME", F.lit("old")), tag("PRODUCTNAME", F.col("base")),
        F.when(F.col("part_key") % 10 != 0, tag("PRICE_VAT", price)).otherwise(F.lit("")), tag("URL", F.concat(F.lit("https://shop.example.com/"), F.col("part_key").cast("string"))),
        tag("DELIVERY_DATE", (F.col("part_key") % 5).cast("string")), F.lit("</SHOPITEM>"),
    )
    return feeds.feed_items(spark, _landed(p.select(item.alias("line")), "heureka"), "heureka").select("item_id", "name", "price", "url", "delivery_days")


@query
def s2_mixed_case_feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Element names in any case, marked sections and references in texts, a later price that is no number."""
    p = C.parts(spark, sf_dir)
    k = F.col("part_key")

    def tag(name: str, c: Column) -> Column:
        low, mixed = name.lower(), name.title()
        spelled = lambda n: F.concat(F.lit(f"<{n}>"), c, F.lit(f"</{n}>"))
        return F.when(k % 3 == 0, spelled(name)).when(k % 3 == 1, spelled(low)).otherwise(spelled(mixed))

    text = F.when(k % 2 == 0, F.concat(F.lit("<![CDATA["), "base", F.lit(" <b> & co]]>"))).otherwise(F.concat("base", F.lit(" &lt;b&gt; &amp; co")))
    item = tag("SHOPITEM", F.concat(
        tag("ITEM_ID", k.cast("string")), tag("PRODUCTNAME", text), tag("PRICE_VAT", F.format_string("%.2f", F.col("retail"))), tag("PRICE_VAT", F.lit("on request")), tag("URL", F.concat(F.lit("https://x/"), k.cast("string"))), F.lit("<other>y</other>"),
    ))
    return feeds.feed_items(spark, _landed(p.select(item.alias("line")), "mixed"), "heureka").select("item_id", "name", "price", "url")


@query
def s3_google_feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = C.parts(spark, sf_dir)
    tag = lambda t, c: F.concat(F.lit(f"<{t}>"), c, F.lit(f"</{t}>"))
    root = F.when(F.col("part_key") % 2 == 0, "item").otherwise("entry")
    stock = F.element_at(F.array(F.lit("in stock"), F.lit("out of stock"), F.lit("preorder")), (F.col("part_key") % 3 + 1).cast("int"))
    link = F.when(F.col("part_key") % 2 == 0, F.concat(F.lit("<link>https://shop.example.com/"), F.col("part_key").cast("string"), F.lit("</link>"))).otherwise(F.concat(F.lit('<link href="https://shop.example.com/'), F.col("part_key").cast("string"), F.lit('"/>')))
    item = F.concat(
        F.lit("<"), root, F.lit(' xmlns:g="http://base.google.com/ns/1.0">'), tag("g:id", F.col("part_key").cast("string")), tag("title", F.col("base")), link,
        tag("g:price", F.concat(F.translate(F.format_string("%.2f", F.col("retail")), ".", ","), F.lit(" CZK"))), tag("g:availability", stock), F.lit("</"), root, F.lit(">"),
    )
    return feeds.feed_items(spark, _landed(p.select(item.alias("line")), "google"), "google").select("item_id", "name", "price", "currency", "url", "in_stock")


@query
def s21_delimited_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = C.parts(spark, sf_dir)
    line = F.concat_ws("~~", F.col("part_key").cast("string"), "brand", F.concat_ws("~~", "base", "part_type"))
    return feeds.delimited(spark, _landed(p.select(line), "lines"), ["count", "shop", "name"])


# --- names ------------------------------------------------------------------------------------------------------------


def _names(spark: SparkSession, sf_dir: str) -> DataFrame:
    distinct = C.parts(spark, sf_dir).select("name").distinct()
    return kept(distinct.select(F.xxhash64("name").alias("key"), F.lit("x").alias("shop_id"), "name"))


@query
def m_parse_models(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M1-M20 over all distinct part names."""
    names = _names(spark, sf_dir)
    found = N.parsed_models(names, N.seed_dictionary(spark), kept).join(names.select("key", "name"), "key")
    return found.select("name", "level", F.array_join(F.transform("models", lambda m: m["id"]), ",").alias("models"), F.size("generic").alias("generic"))


@query
def o_parse_offers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """O1-O15 over all distinct part names."""
    names = _names(spark, sf_dir)
    found = O.parsed_offers(names, N.seed_dictionary(spark), kept).join(names.select("key", "name"), "key")
    return found.select("name", "part_type", F.to_json("variant").alias("variant"), F.array_join("quality_tags", ",").alias("tags"))


def _cased(spark: SparkSession, sf_dir: str, cases: list[str], words: bool) -> DataFrame:
    """part_key, key, shop_id and name: a case for each part, by its key; behind the part's own words if these say nothing to the parser."""
    p = C.parts(spark, sf_dir)
    case = F.element_at(F.array(*(F.lit(c) for c in cases)), (F.col("part_key") % len(cases) + 1).cast("int"))
    named = p.select("part_key", F.lit("x").alias("shop_id"), (F.concat_ws(" ", "base", case) if words else case).alias("name"))
    return kept(named.withColumn("key", F.xxhash64("name")))


@query
def m_model_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M1-M20, rule by rule: what each case's name gives behind the words of the parts."""
    named = _cased(spark, sf_dir, [c[0] for c in MODEL_CASES], True)
    names = kept(named.select("key", "shop_id", "name").distinct())
    found = N.parsed_models(names, N.seed_dictionary(spark), kept)
    return named.join(found.select("key", "level", F.array_join(F.transform("models", lambda m: m["id"]), ",").alias("models")), "key").select("part_key", "level", "models")


@query
def o_offer_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """O1-O15, rule by rule: the attributes and tags of the name that each part gets; equal names are parsed once."""
    named = _cased(spark, sf_dir, [c[0] for c in OFFER_CASES], False)
    names = kept(named.select("key", "shop_id", "name").distinct())
    found = O.parsed_offers(names, N.seed_dictionary(spark), kept)
    own = F.filter(F.array(*(F.concat(F.lit(f"{k}="), F.col(f"variant.{k}").cast("string")) for k in sorted(O.VARIANT))), lambda x: x.isNotNull())
    return named.join(found.select("key", F.array_join(own, ";").alias("attributes"), F.array_join("quality_tags", ",").alias("tags")), "key").select("part_key", "attributes", "tags")


@query
def c17_write_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What writing the parsed names would change, by level."""
    names = _names(spark, sf_dir)
    parsed = N.parsed_models(names, N.seed_dictionary(spark), kept)
    offers = C.offers(spark, sf_dir).select("offer_id", F.xxhash64("name").alias("key"), "name")
    plan = N.write_plan(offers, parsed)
    return plan.groupBy("level").agg(F.count(F.lit(1)).alias("offers"), F.sum(F.size("links")).alias("links"), F.count_if(F.size("fit_generic") > 0).alias("with_generic"))


def _parsed_names(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    names = _names(spark, sf_dir)
    return names, kept(N.parsed_models(names, N.seed_dictionary(spark), kept))


@query
def k6_product_summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Levels of stored parts after a write plan that leaves excluded names as they were."""
    _, parsed = _parsed_names(spark, sf_dir)
    p = C.parts(spark, sf_dir).select(F.col("part_key").cast("string").alias("offer_id"), F.xxhash64("name").alias("key"), "name")
    fit = "array<struct<brand:string,displacement:int>>"
    stored = p.select("offer_id", F.lit("old").alias("model_match_level"), F.array().cast(fit).alias("fit_generic"), F.lit(None).cast("timestamp").alias("models_parsed_at"))
    new = M.product_summaries(stored, N.write_plan(p, parsed), F.lit(NOW).cast("timestamp"))
    return new.groupBy("model_match_level", F.col("models_parsed_at").isNotNull().alias("parsed")).agg(F.count(F.lit(1)).alias("offers"))


def _with_families(spark: SparkSession, parsed: DataFrame) -> DataFrame:
    """key, models (with their families) and generic of parsed names."""
    families = seed.models(spark).select("id", "family")
    each = parsed.select("key", F.explode_outer("models.id").alias("id")).join(F.broadcast(families), "id", "left")
    listed = each.groupBy("key").agg(F.collect_list(F.struct("id", "family")).alias("models"))
    return listed.join(parsed.select("key", "generic"), "key")


@query
def a10_special_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Offers whose names are of several families or displacements, or of suspiciously many models."""
    names, parsed = _parsed_names(spark, sf_dir)
    weight = C.parts(spark, sf_dir).groupBy(F.xxhash64("name").alias("key")).agg(F.count(F.lit(1)).alias("count"))
    return S.special_counts(_with_families(spark, parsed).join(weight, "key"))


def _two_ends(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names made from two name endings each: key, shop_id, name, count (parts with the first ending)."""
    end = F.regexp_extract("name", r"^\S+ \S+ \S+ (.*)$", 1).alias("end")
    p = C.parts(spark, sf_dir).groupBy("suffix", end).agg(F.count(F.lit(1)).alias("count"))
    later = p.select(F.col("end").alias("e"), F.col("count").alias("c"), F.explode(F.sequence(F.col("suffix") + 1, F.lit(len(C.SUFFIXES)))).alias("suffix"))
    two = later.join(p, "suffix").select(F.concat_ws(" díl ", "e", "end").alias("name"), F.col("c").alias("count"))
    return kept(two.select(F.xxhash64("name").alias("key"), F.lit("x").alias("shop_id"), "name", "count"))


@query
def c15_family_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names with models of more than one family; made from two names each, so that there are some."""
    names, d = _two_ends(spark, sf_dir), N.seed_dictionary(spark)
    return N.conflicts(N.parsed_models(names.drop("count"), d, kept), d.models).join(names, "key").select("name", F.array_join("families", ",").alias("families"))


@query
def a10_special_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A10, C16 where they are met: the counts over names made from two names each."""
    names = _two_ends(spark, sf_dir)
    parsed = kept(N.parsed_models(names.drop("count"), N.seed_dictionary(spark), kept))
    return S.special_counts(_with_families(spark, parsed).join(names.select("key", "count"), "key"))


def _landed_offers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order lines as they land, one for each key, in at least as many files as there are cores; they are shuffled once, as narrow as they are stored."""
    li = C.lines(spark, sf_dir)
    # one number for each item_id, which leaves nulls out
    two = F.col("l_orderkey").isNotNull() & F.col("l_linenumber").isNotNull()
    item = {"l_orderkey": F.coalesce("l_orderkey", F.col("l_linenumber").cast("long")), "l_linenumber": F.when(two, F.col("l_linenumber"))}
    narrow = li.withColumns(item | C.offer_values()).select(*C.LINE, *C.offer_values())
    named = C.read(spark, sf_dir, "part").select("p_partkey", "p_name", "p_type")
    dealt = spread(narrow.join(named, narrow.l_partkey == named.p_partkey).drop("p_partkey"), "l_orderkey", least=li.count() // LINES_A_TASK)
    key = ["l_suppkey", "l_orderkey", "l_linenumber"]
    o = dealt.withColumn("part_key", F.col("l_partkey")).withColumns(C.offer_texts() | {"name": C.part_name("part_key")})
    o = M.last_wins(o, key, [F.col("last_seen_at"), F.col("price"), F.col("offer_id")])
    return o.select("shop_id", "item_id", "name", F.col("price").cast("double").alias("price"), "url", "in_stock", "last_seen_at")


@query
def stream_import(spark: SparkSession, sf_dir: str) -> DataFrame:
    """§2.13: order lines as landed files, merged by an available-now stream in four batches; the state afterwards."""
    import uuid

    from ..streaming.imports import OfferImport

    root = f"{shared_dir(spark)}/import-{uuid.uuid4().hex}"
    _landed_offers(spark, sf_dir).write.option("compression", "zstd").parquet(f"{root}/in")
    run = OfferImport(spark, root)
    run.run(f"{root}/in", files_per_batch=-(-len(spark.read.parquet(f"{root}/in").inputFiles()) // 4))
    return run.state()


@query
def stream_aged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two runs of the stream, with ageing after each: shops whose source was empty keep their stock, and late rows bring theirs back."""
    import uuid

    from ..streaming.imports import OfferImport

    root = f"{shared_dir(spark)}/import-{uuid.uuid4().hex}"
    _landed_offers(spark, sf_dir).write.option("compression", "zstd").parquet(f"{root}/in/first")
    landed = spark.read.parquet(f"{root}/in/first")
    run = OfferImport(spark, root, 8)
    run.run(f"{root}/in/*")
    run.age(SPLIT, landed.where(F.col("shop_id") != "S1").select("shop_id"))
    late = landed.where(F.col("item_id").endswith("-2")).withColumn("in_stock", F.lit(True))
    late.write.option("compression", "zstd").parquet(f"{root}/in/second")
    run.run(f"{root}/in/*")
    run.age(NOW, landed.where(F.col("shop_id") == "S2").select("shop_id"))
    return run.state().select("shop_id", "item_id", "in_stock", "last_seen_at")
