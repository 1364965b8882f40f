"""The queries of ``queries`` in SQL, over the same tables, for those that SQL can express."""

from __future__ import annotations

import re

from ..functions.text import FOLD_FROM, FOLD_TO
from ..functions.urls import NOT_PRODUCT, PRODUCT_PATHS, RELEVANT
from ..operators import grading as G
from ..operators.linkage import ATTRIBUTES
from .name_cases import MODEL_CASES, OFFER_CASES
from ..sources.catalogue import LINKS_SQL, MODELS_SQL, OFFERS_SQL, PARTS_SQL, SHOPS_SQL
from ..sources.seed import MODELS
from .queries import NOW, ROBOTS, SPLIT

SQL: dict[str, str] = {}


def _q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _fold(c: str) -> str:
    return f"strip_accents(lower({c}))"


def _word(c: str, pattern: str) -> str:
    return f"regexp_matches({c}, {_q(chr(92) + 'b(?:' + pattern + ')' + chr(92) + 'b')})"


_N = f"translate(lower(name), '{FOLD_FROM}', '{FOLD_TO}')"
SQL["c18_price_search"] = f"""
WITH {SHOPS_SQL}, {OFFERS_SQL}, {LINKS_SQL}, {MODELS_SQL},
target AS (SELECT id FROM models WHERE list_contains(type_numbers, '634')),
c AS (SELECT o.*, s.name AS shop, regexp_matches({_N.replace('name', 'o.name')}, '\\bred\\b')::INT + regexp_matches({_N.replace('name', 'o.name')}, '\\bwidg')::INT
    + regexp_matches({_N.replace('name', 'o.name')}, '634')::INT AS hits, part_key IN (SELECT part_key FROM links JOIN target ON model_id = id) AS fit_model,
    contains({_N.replace('name', 'o.name')}, 'jawa') AS by_brand
  FROM offers o JOIN shops s USING (shop_id) WHERE price > 0)
SELECT shop, name, price, url, in_stock, CASE WHEN fit_model THEN 'model' WHEN by_brand THEN 'brand' ELSE 'other' END AS fit, last_seen_at
FROM c WHERE hits = (SELECT max(hits) FROM c) AND hits >= 2
ORDER BY fit_model DESC, by_brand DESC, price, name, shop, url, last_seen_at LIMIT 40"""

SQL["f1_active_feed_shops"] = f"WITH {SHOPS_SQL} SELECT shop_id, feed_url FROM shops WHERE source_type = 'feed' AND feed_permission AND feed_url IS NOT NULL"
SQL["f2_active_crawl_shops"] = f"WITH {SHOPS_SQL} SELECT shop_id, base_url FROM shops WHERE source_type = 'crawl' AND crawl_enabled AND base_url IS NOT NULL"
SQL["f3_internal_shops"] = f"WITH {SHOPS_SQL} SELECT shop_id, source_type FROM shops WHERE internal_sync AND CASE source_type WHEN 'feed' THEN feed_url ELSE base_url END IS NOT NULL"
SQL["f4_import_gate"] = f"""WITH {SHOPS_SQL}, g AS (SELECT shop_id, CASE WHEN CASE source_type WHEN 'feed' THEN feed_url ELSE base_url END IS NULL THEN 'no address'
  WHEN NOT CASE source_type WHEN 'feed' THEN feed_permission ELSE crawl_enabled END THEN 'not permitted' END AS problem FROM shops)
SELECT shop_id, problem IS NULL AS allowed, problem FROM g"""
SQL["f20_probe_shops"] = f"WITH {SHOPS_SQL} SELECT shop_id, base_url FROM shops WHERE base_url IS NOT NULL AND shop_id NOT IN ('S1', 'S2', 'S3')"
SQL["f5_relevant_offers"] = f"WITH {PARTS_SQL} SELECT part_key, name FROM parts WHERE {_word(_fold('name'), RELEVANT)}"

_PATH = "CASE WHEN regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1) = '' THEN '/' ELSE regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1) END"
_HOST = "lower(regexp_extract(url, '^[a-z]+://([^/?#]*)', 1))"
_QUERY = "regexp_extract(url, '^[^?#]*([?][^#]*)?', 1)"


def _slug(path: str) -> str:
    return f"regexp_replace(regexp_replace({path}, '\\.(html?|php)$', '', 'i'), '[-_/.+]+', ' ', 'g')"


SQL["f6_slug_relevance"] = f"SELECT page_id, {_slug(_PATH)} AS slug, {_word(_fold(_slug(_PATH)), RELEVANT)} AS relevant FROM pages"
_SHAPES = " ".join(f"WHEN platform = '{p}' THEN regexp_matches(path || query, {_q(x)})" for p, x in PRODUCT_PATHS.items())
SQL["f7_product_like_urls"] = f"""WITH p AS (SELECT page_id, {_PATH} AS path, {_QUERY} AS query, ['prestashop', 'woocommerce', 'upgates', 'unknown'][page_id % 4 + 1] AS platform FROM pages)
SELECT page_id, CASE WHEN path = '/' OR regexp_matches(path, {_q(NOT_PRODUCT)}) THEN false {_SHAPES} ELSE true END AS likely FROM p"""
_MARKS = ['<link href="https://cdn.myshoptet.com/a.css">', "window.UPGATES", '<meta name="generator" content="PrestaShop">', "catalog/view/theme", "wp-content/plugins/woocommerce", ""]
SQL["f8_platform"] = f"""WITH p AS (SELECT page_id, coalesce(html, '') || [{', '.join(map(_q, _MARKS))}][page_id % 6 + 1] AS h FROM pages)
SELECT page_id, CASE {' '.join(f"WHEN regexp_matches(h, {_q(x)}) THEN '{n}'" for n, x in G.PLATFORMS)} ELSE 'unknown' END AS platform FROM p"""


def _brandish(c: str) -> str:
    tokens = f"list_filter(regexp_split_to_array({_fold(c)}, '[^a-z0-9]+'), lambda x: x <> '')"
    return f"(len({tokens}) > 0 AND len(list_filter({tokens}, lambda x: NOT list_contains({G.BRAND_TOKENS}, x))) = 0)"


SQL["f9_brand_like_names"] = f"""WITH n AS (SELECT p_partkey AS part_key, ['CZ / HUN', 'JAWA Moto spol s r. o.', 'CZ (Original)', 'Jawa 350', '---', 'Moto díly'][p_partkey % 6 + 1] AS name FROM part)
SELECT part_key, name, {_brandish('name')} AS brand_like FROM n"""

_MERCH = _word("t", G.MERCH)
_VEHICLE = "regexp_matches(t, '^(?:motocykl\\b|motor (?:bez|kompletni)\\b)')"
_EXCLUDED = f"CASE WHEN {_MERCH} THEN 'merch' WHEN {_word('t', 'simson')} AND NOT {_word('t', '|'.join(re.escape(w) for w in G.OWN_WORDS))} THEN 'simson_only' END"
_ITEMS = f"""{PARTS_SQL}, items AS (SELECT part_key, CASE WHEN suffix = 9 THEN 'Motocykl ' || base WHEN part_key % 31 = 3 THEN 'CZ / HUN' ELSE name END AS name,
  round(retail * (part_key % 40), 2) AS price, CASE WHEN part_key % 37 = 5 THEN 'Modely motocyklů, automobilů > Jawa' ELSE 'Díly > Motor' END AS category FROM parts),
folded AS (SELECT *, trim({_fold('name')}) AS t, floor(price + 0.5)::BIGINT AS whole, trim({_fold("string_split(category, '>')[1]")}) AS top FROM items),
graded AS (SELECT *, CASE WHEN whole <= 0 THEN 'price_invalid' WHEN whole > {G.PRICE_LIMIT} THEN 'price_over_limit' WHEN {_brandish('name')} THEN 'brand_name'
    WHEN top = 'modely motocyklu, automobilu' THEN 'excluded_category' WHEN {_VEHICLE} THEN 'vehicle_name' ELSE {_EXCLUDED} END AS exclusion,
  concat_ws(',', CASE WHEN whole >= {G.PRICE_REVIEW} THEN 'price_review' END, CASE WHEN {_word('t', G.MODERN)} THEN 'modern_jawa' END) AS marks,
  CASE WHEN {_word('t', G.VOUCHER)} THEN 'voucher' END AS ignored, {_word(_fold("name || ' ' || category"), RELEVANT)} AS relevant,
  {_word('t', '|'.join(re.escape(w) for w in G.OWN_WORDS))} AS own_brand FROM folded)"""
SQL["f10_assess_items"] = f"WITH {_ITEMS} SELECT part_key, exclusion, CASE WHEN exclusion IS NULL THEN marks ELSE '' END AS flags, ignored, own_brand FROM graded"
SQL["a4_exclusion_counts"] = f"""WITH {_ITEMS} SELECT reason, (SELECT count(*) FROM graded WHERE exclusion = reason) AS items
FROM (SELECT unnest([{', '.join(map(_q, G.REASONS))}]) AS reason)"""
SQL["a4_import_summary"] = f"""WITH {_ITEMS}, k AS (SELECT *, relevant AND exclusion IS NULL AS kept, ['new', 'changed', 'same'][part_key % 3 + 1] AS change FROM graded)
SELECT count(*) AS total, count_if(relevant) AS relevant, count_if(kept) AS stored, count_if(relevant AND exclusion IS NOT NULL) AS excluded, count_if(kept AND marks <> '') AS flagged,
  count_if(kept AND change = 'new') AS new, count_if(kept AND change = 'changed') AS changed, count_if(kept AND ignored IS NOT NULL) AS vouchers FROM k"""
SQL["a6_dry_run_first"] = f"WITH {_ITEMS} SELECT part_key, name FROM graded WHERE relevant AND exclusion IS NULL ORDER BY part_key LIMIT 10"

_TYPES = sorted({t for m in MODELS for t in m[4].split(", ") if len(t) == 3 and t.isdigit()})
_SLUGGED = f"""cut AS (SELECT page_id, regexp_replace(url, '[?#].*$', '') || ['-jawa-350', '-simson-s51', '-cz125', '-kyvacky', '-634638', '', '-honda', '-jawa-simson'][page_id % 8 + 1] AS url FROM pages),
slugged AS (SELECT page_id, url, {_fold(_slug(_PATH))} AS slug FROM cut),
words AS (SELECT *, list_filter(regexp_split_to_array(slug, '[^a-z0-9]+'), lambda x: x <> '') AS ws FROM slugged),
toks AS (SELECT page_id, slug, list_distinct(ws || flatten(list_transform(ws, lambda w: regexp_extract_all(w, '[a-z]+|[0-9]+')))
  || flatten(list_transform(list_filter(ws, lambda w: regexp_matches(w, '^[0-9]{{6}}$')), lambda w: [w[1:3], w[4:6]]))) AS tokens FROM words)"""
_OWN = "^(?:" + "|".join(G.OWN_PREFIXES) + r")|^j\d{3}$|^b2\d\d$|^cz\d{3}"
_PASSES = f"""flags AS (SELECT page_id, {_word('slug', RELEVANT)} AS pass_0,
  len(list_filter(tokens, lambda x: list_contains({G.OWN_TOKENS}, x) OR regexp_matches(x, {_q(_OWN)}) OR list_contains({_TYPES}, x))) > 0 AS own,
  len(list_filter(tokens, lambda x: list_contains({G.FOREIGN_TOKENS}, x) OR regexp_matches(x, '^(?:{"|".join(G.FOREIGN_PREFIXES)})'))) > 0 AS alien FROM toks),
passes AS (SELECT page_id, pass_0, pass_0 OR own AS pass_a, NOT alien AS pass_b1, NOT alien OR pass_0 OR own AS pass_b2 FROM flags)"""
SQL["f16_prefilters"] = f"WITH {_SLUGGED}, {_PASSES} SELECT * FROM passes"
_RECALL = " UNION ALL ".join(
    f"SELECT '{p}' AS prefilter, count(*) AS rows, count_if({p}) AS passed, round(100 * count_if({p}) / count(*), 1) AS passed_percent, count_if(page_id % 3 = 0) AS wanted, "
    f"count_if({p} AND page_id % 3 = 0) AS kept, round(100 * count_if({p} AND page_id % 3 = 0) / count_if(page_id % 3 = 0), 1) AS kept_percent, round(count_if({p}) * 3 / 3600, 1) AS hours FROM passes"
    for p in ("pass_0", "pass_a", "pass_b1", "pass_b2")
)
SQL["a17_prefilter_recall"] = f"WITH {_SLUGGED}, {_PASSES} {_RECALL}"
_SEGMENTS = f"list_filter(string_split({_PATH}, '/'), lambda x: x <> '')"
SQL["f17_product_urls"] = f"""WITH p AS (SELECT page_id, CASE WHEN page_id % 3 = 0 THEN regexp_replace(regexp_replace(url, '[?#].*$', ''), '/[^/]*/?$', '') ELSE regexp_replace(url, '[?#].*$', '') END AS url FROM pages),
s AS (SELECT page_id, url, {_HOST} AS host, {_SEGMENTS} AS seg FROM p)
SELECT page_id, url FROM s WHERE len(seg) = 1 AND NOT EXISTS (SELECT 1 FROM s d WHERE d.host = s.host AND len(d.seg) >= 2 AND lower(d.seg[1]) = lower(s.seg[1]))"""
_PKEY = f"lower(regexp_replace({_PATH}, '/$', ''))"
_HKEY = f"regexp_replace({_HOST}, '^www\\.', '') || {_PKEY}"
SQL["f18_url_keys"] = f"SELECT page_id, {_HKEY} AS host_path, {_PKEY} AS path FROM pages"
SQL["j12_urls_in_sitemap"] = f"""WITH p AS (SELECT page_id, {_HKEY} AS key FROM pages)
SELECT page_id, key IN (SELECT key FROM p WHERE page_id % 3 = 0) AS listed FROM p"""
SQL["a16_url_depth"] = f"SELECT len({_SEGMENTS})::BIGINT AS depth, count(*) AS urls FROM pages GROUP BY 1"
SQL["a18_token_frequency"] = f"""WITH {_SLUGGED}, e AS (SELECT unnest(tokens) AS token FROM toks)
SELECT token, count(*) AS rows FROM e WHERE length(token) > 1 AND NOT regexp_matches(token, '^[0-9]+$') GROUP BY token ORDER BY rows DESC, token LIMIT 80"""
SQL["f21_reachability"] = """WITH e AS (SELECT event_id, CASE WHEN event_id % 5 <> 0 THEN 200 + event_id % 7 * 50 END AS status FROM events)
SELECT CASE WHEN status < 400 THEN 'ok' WHEN status >= 400 THEN 'http_error' WHEN event_id % 3 = 0 THEN 'dns' ELSE 'timeout' END AS label, count(*) AS events FROM e GROUP BY 1"""
SQL["t19_error_class"] = """SELECT CASE WHEN event_id % 11 = 0 THEN 'timeout' WHEN event_id % 6 < 2 THEN 'dns' WHEN event_id % 6 < 5 THEN 'timeout' ELSE 'other' END AS kind, count(*) AS events FROM events GROUP BY 1"""

# --- import -----------------------------------------------------------------------------------------------------------
_LATEST = "row_number() OVER (PARTITION BY shop_id, item_id ORDER BY last_seen_at DESC, price DESC, offer_id DESC) = 1"
_STORED = f"""{OFFERS_SQL}, stored AS (SELECT * FROM offers WHERE last_seen_at < TIMESTAMP '{SPLIT}' QUALIFY {_LATEST}),
incoming AS (SELECT * FROM offers WHERE last_seen_at >= TIMESTAMP '{SPLIT}' QUALIFY {_LATEST}),
changes AS (SELECT i.*, CASE WHEN s.shop_id IS NULL THEN 'new' WHEN s.price IS DISTINCT FROM i.price THEN 'changed' ELSE 'same' END AS change FROM incoming i LEFT JOIN stored s USING (shop_id, item_id))"""
SQL["j1_import_diff"] = f"WITH {_STORED} SELECT shop_id, item_id, price, change FROM changes"
SQL["k1_upsert_state"] = f"""WITH {_STORED} SELECT shop_id, item_id, coalesce(i.name, s.name) AS name, coalesce(i.price, s.price) AS price, coalesce(i.url, s.url) AS url,
  CASE WHEN i.shop_id IS NOT NULL THEN coalesce(i.in_stock, true) ELSE s.in_stock END AS in_stock, coalesce(i.last_seen_at, s.last_seen_at) AS last_seen_at,
  CASE WHEN s.shop_id IS NULL THEN 'pending' ELSE s.match_status END AS match_status, s.part_id AS part_id FROM stored s FULL JOIN incoming i USING (shop_id, item_id)"""
SQL["k2_price_history"] = f"WITH {_STORED} SELECT shop_id, item_id, price, in_stock, last_seen_at AS captured_at FROM changes WHERE change <> 'same'"
SQL["w6_price_changes"] = f"""WITH {OFFERS_SQL}, l AS (SELECT shop_id, part_key, offer_id, price, lag(price) OVER (PARTITION BY shop_id, part_key ORDER BY last_seen_at, offer_id) AS previous FROM offers)
SELECT * FROM l WHERE previous IS DISTINCT FROM price"""
SQL["w7_last_wins"] = f"WITH {OFFERS_SQL} SELECT shop_id, item_id, offer_id, price FROM offers QUALIFY {_LATEST}"
SQL["k3_stale_marking"] = f"""WITH {OFFERS_SQL}, s AS (SELECT shop_id, in_stock, last_seen_at < TIMESTAMP '{NOW}' - INTERVAL 3 DAY AS stale FROM offers)
SELECT shop_id, count_if(stale) AS stale, count_if(in_stock AND NOT stale) AS in_stock FROM s GROUP BY shop_id"""
SQL["k4_conditional_ignore"] = f"""WITH {OFFERS_SQL} SELECT CASE WHEN match_status = 'pending' AND part_id IS NULL AND {_word(_fold('name'), G.VOUCHER)} THEN 'ignored' ELSE match_status END AS match_status,
  count(*) AS offers FROM offers GROUP BY 1"""
SQL["k5_links_rewritten"] = f"""WITH {PARTS_SQL}, {LINKS_SQL}, stored AS (SELECT part_key, model_id || '-old' AS model_id, CASE WHEN part_key % 3 = 0 THEN 'description' ELSE 'name' END AS source FROM links)
SELECT part_key::VARCHAR AS offer_id, model_id, source FROM stored WHERE source <> 'name' OR part_key % 2 <> 0
UNION SELECT part_key::VARCHAR, model_id, 'name' FROM links WHERE part_key % 2 = 0"""
SQL["k9_waitlist"] = """WITH r AS (SELECT c_custkey AS request_id, 'user' || (c_custkey % 700) || '@example.com' AS email, c_custkey % 50 AS created_at FROM customer WHERE c_custkey % 9 <> 0 AND c_custkey % 13 <> 0)
SELECT request_id, email FROM r WHERE regexp_extract(email, '[0-9]+')::INT >= 100 QUALIFY row_number() OVER (PARTITION BY email ORDER BY created_at, request_id) = 1"""
SQL["k10_probe_rows"] = f"""WITH {SHOPS_SQL} SELECT shop_id, '{{"source_type":"' || source_type || '","crawl_enabled":' || crawl_enabled || '}}' AS result FROM shops"""
SQL["k13_shops_updated"] = f"""WITH {SHOPS_SQL}, h AS (SELECT *, substring(shop_id, 2)::INT BETWEEN 1 AND 19 AND base_url IS NOT NULL AS hit FROM shops)
SELECT shop_id, CASE WHEN hit THEN 'feed' ELSE source_type END AS source_type, CASE WHEN hit THEN base_url || '/google.xml' ELSE feed_url END AS feed_url, hit OR internal_sync AS internal_sync FROM h"""
SQL["k14_dimension_merge"] = f"""WITH {SHOPS_SQL} SELECT shop_id, name, CASE WHEN right(name, 1) < '6' THEN 'crawl' ELSE source_type END AS source_type FROM shops"""
SQL["k15_duplicated_keys"] = f"WITH {OFFERS_SQL} SELECT shop_id, item_id, count(*) AS rows FROM offers GROUP BY ALL HAVING count(*) > 1"
SQL["k15_invalid_status"] = f"WITH {OFFERS_SQL} SELECT match_status, count(*) AS offers FROM offers WHERE match_status NOT IN ('pending', 'auto', 'manual') GROUP BY 1"

_MENDED = """once AS (SELECT *, coalesce(in_stock, true) AS stock FROM offers QUALIFY row_number() OVER (PARTITION BY shop_id, item_id ORDER BY last_seen_at DESC, price DESC, offer_id DESC) = 1),
mended AS (SELECT * FROM once WHERE (match_status IS NULL OR match_status IN ('pending', 'auto', 'manual')) AND shop_id IN (SELECT shop_id FROM shops WHERE base_url IS NOT NULL))"""
SQL["k15_checked_write"] = f"""WITH {SHOPS_SQL}, {OFFERS_SQL}, {_MENDED}, r AS (
SELECT 'raw' AS attempt, 'required in_stock' AS rule, count_if(in_stock IS NULL) AS rows FROM offers UNION ALL
SELECT 'raw', 'allowed match_status', count_if(match_status IN ('rejected', 'ignored')) FROM offers UNION ALL
SELECT 'raw', 'references shop_id', count_if(shop_id NOT IN (SELECT shop_id FROM shops WHERE base_url IS NOT NULL)) FROM offers UNION ALL
SELECT 'raw', 'unique shop_id, item_id', count(*) - count(DISTINCT shop_id || ' ' || item_id) FROM offers UNION ALL
SELECT 'raw', 'unique offer_id', count(*) - count(DISTINCT offer_id) FROM offers UNION ALL
SELECT unnest(['mended', 'again', 'read']), unnest(['accepted', 'empty', 'rows']), count(*) FROM mended) SELECT * FROM r WHERE rows > 0"""

# --- summaries --------------------------------------------------------------------------------------------------------
SQL["a1_availability"] = f"WITH {OFFERS_SQL} SELECT count_if(in_stock) AS in_stock, count_if(NOT in_stock) AS out_of_stock, count_if(in_stock IS NULL) AS unknown FROM offers"
SQL["a2_prices"] = f"WITH {OFFERS_SQL} SELECT count(*) AS items, min(price) AS min_price, max(price) AS max_price, round(avg(price), 2) AS avg_price FROM offers"
SQL["a3_variant_groups"] = """WITH e AS (SELECT CASE WHEN event_id % 10 <> 0 THEN json_extract_string(props, '$.k') || '-' || (event_id % 400) END AS g FROM events), n AS (SELECT g, count(*) AS n FROM e GROUP BY g)
SELECT coalesce(sum(n) FILTER (g IS NOT NULL), 0)::BIGINT AS with_group, coalesce(sum(n) FILTER (g IS NULL), 0)::BIGINT AS without_group, count_if(g IS NOT NULL) AS groups,
  count_if(g IS NOT NULL AND n > 1) AS multi_groups, coalesce(sum(n) FILTER (g IS NOT NULL AND n > 1), 0)::BIGINT AS in_multi_groups FROM n"""
SQL["a5_refresh_summary"] = """SELECT kind, (SELECT count(*) FROM events WHERE ['item', 'not_found', 'error', 'disallowed'][event_id % 4 + 1] = kind) AS pages
FROM (SELECT unnest(['item', 'not_found', 'no_product', 'error', 'disallowed']) AS kind)"""
_LEVELS = "['type', 'type', 'type', 'type', 'nickname', 'nickname', NULL, 'brand', NULL, NULL, 'brand', 'brand'][suffix + 1]"


def _levels(where: str) -> str:
    cols = ", ".join(f"count_if(level = '{x}') AS {x}" for x in ("type", "nickname", "displacement", "brand", "none"))
    return f"WITH {OFFERS_SQL}, l AS (SELECT shop_id, coalesce({_LEVELS}, 'none') AS level FROM offers WHERE {where}) SELECT shop_id, {cols}, count(*) AS total FROM l GROUP BY ROLLUP (shop_id)"


SQL["a7_levels_by_shop"] = _levels("true")
SQL["a8_levels_after_exclusion"] = _levels(f"({_EXCLUDED.replace('(t,', '(' + _fold('name') + ',')}) IS NULL")
SQL["a15_status_by_shop"] = f"""WITH {OFFERS_SQL}, s AS (SELECT shop_id, coalesce(match_status, 'null') AS match_status FROM offers)
SELECT shop_id, match_status, count(*) AS rows FROM s GROUP BY GROUPING SETS ((shop_id, match_status), (match_status))"""
SQL["a20_compacted_names"] = f"WITH {OFFERS_SQL} SELECT shop_id, name, count(*) AS count FROM offers GROUP BY ALL"
SQL["a9_unresolved_tokens"] = f"""WITH {OFFERS_SQL}, t AS (SELECT unnest(string_split(name, ' ')) AS token FROM offers)
SELECT '' AS brand, CASE WHEN regexp_matches(token, '^[0-9]+$') THEN 'number' ELSE 'word' END AS kind, token, count(*) AS rows FROM t GROUP BY ALL"""


def _hash(c: str) -> str:
    step = "lambda h, x: (xor(h, x) * 16777619) & 4294967295"
    return f"lpad(lower(to_hex(list_reduce(list_transform(string_split({c}, ''), lambda x: unicode(x)::BIGINT), {step}, 2166136261::BIGINT))), 8, '0')"


def _slugify(c: str) -> str:
    return f"regexp_replace(left(regexp_replace(regexp_replace({_fold(c)}, '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g'), 80), '-+$', '')"


SQL["t6_text_functions"] = f"""WITH {PARTS_SQL} SELECT part_key, ((part_key % 9 + 1) || lpad((part_key % 1000)::VARCHAR, 3, '0') || '.50')::DOUBLE AS amount, 'CZK' AS currency,
  [true, false, true, NULL][part_key % 4 + 1] AS in_stock, name AS clean, {_slugify('name')} AS slug, {_hash('base')} AS hash, {_N} AS folded, floor(retail / 7 + 0.5)::BIGINT AS rounded,
  CASE WHEN part_key % 5 = 0 THEN 0.0 ELSE round(100 * (part_key % 7) / (part_key % 5), 1) END AS percent FROM parts"""
SQL["s19_hot_site_budget"] = """WITH e AS (SELECT event_id, CASE WHEN event_id % 10 = 0 THEN user_id::VARCHAR ELSE 'hot' END AS site, event_id % 3 + 1 AS cost FROM events)
SELECT event_id, site, sum(cost) OVER (PARTITION BY site ORDER BY event_id)::BIGINT AS spent FROM e"""
SQL["s19_request_budget"] = "WITH e AS (SELECT event_id, sum(event_id % 3 + 1) OVER (PARTITION BY user_id ORDER BY event_id)::BIGINT AS spent FROM events) SELECT * FROM e WHERE spent <= 35"

# --- linkage ----------------------------------------------------------------------------------------------------------
_FIT = "CASE WHEN part_key % 4 = 0 AND part_key % 8 <> 0 THEN brand || '|' || (size % 2 * 50) ELSE '' END"
_OWN_ATTR = {
    "color": "CASE size % 3 WHEN 1 THEN 'red' WHEN 2 THEN 'blue' END",
    "size": "CASE WHEN part_key % 5 = 0 THEN 'large' END",
    "dimension": "CASE size % 4 WHEN 1 THEN (size % 6) || ' x 30' WHEN 2 THEN '30x' || (size % 6) END",
    "code": "CASE WHEN part_key % 6 = 0 THEN 'c' || (size % 2) END",
}
_NUMS = "list_sort(list_distinct(list_transform(regexp_extract_all({}, '\\d+(?:\\.\\d+)?'), lambda x: x::DOUBLE)))"
_LINKED = f"""{PARTS_SQL}, items AS (SELECT 'p' || part_key AS id, CASE WHEN part_key % 7 = 0 THEN 'motomax' ELSE 'S' || (part_key % 7) END AS shop_id, name, floor(retail + 0.5)::BIGINT AS price,
  list_sort(list_distinct(string_split(base, ' '))) AS w, array_to_string(list_sort(list_distinct(string_split(base, ' '))), ' ') AS part_type, CASE WHEN part_key % 4 <> 0 THEN brand END AS model, {_FIT} AS fit,
  {', '.join(f'{v} AS x_{k}' for k, v in _OWN_ATTR.items())}, CASE WHEN part_key % 11 <> 0 THEN CASE WHEN part_key % 2 = 0 THEN 'pending' ELSE 'auto' END ELSE 'manual' END AS match_status,
  CASE WHEN part_key % 3 = 0 THEN 'type' ELSE 'nickname' END AS model_level, ['Akce', 'Motor', 'Rám'][size % 3 + 1] AS category, CASE WHEN part_key % 5 = 0 THEN 'P' || (part_key % 10) END AS part_id FROM parts),
keyed AS (SELECT *, coalesce('model|' || model, 'fit|' || fit) AS bucket, {_NUMS.format('x_dimension')} AS nums FROM items),
met AS (SELECT a.id AS a, b.id AS b, a.shop_id AS shop_a, b.shop_id AS shop_b, a.name AS name_a, len(list_intersect(a.w, b.w)) / (len(a.w) + len(b.w) - len(list_intersect(a.w, b.w))) AS jaccard,
    CASE WHEN a.model IS NOT NULL THEN 'model' WHEN a.fit = '' THEN 'no_fit' ELSE 'fit_generic' END AS basis, coalesce(a.model, a.fit) AS shared, a.part_type = b.part_type AS same_type,
    greatest(a.price, b.price) / least(a.price, b.price) AS price_ratio,
    concat_ws(',', CASE WHEN a.nums <> b.nums THEN 'dimension' END, CASE WHEN a.x_color <> b.x_color THEN 'color' END, CASE WHEN a.x_size <> b.x_size THEN 'size' END, CASE WHEN a.x_code <> b.x_code THEN 'code' END) AS conflicts,
    (a.x_dimension IS NULL) <> (b.x_dimension IS NULL) AS o1, (a.x_color IS NULL) <> (b.x_color IS NULL) AS o2, (a.x_size IS NULL) <> (b.x_size IS NULL) AS o3
  FROM keyed a JOIN keyed b ON a.bucket = b.bucket AND a.id < b.id AND a.shop_id <> b.shop_id
  WHERE 2 * len(list_intersect(a.w, b.w)) >= len(a.w) + len(b.w) - len(list_intersect(a.w, b.w))),
pairs AS (SELECT *, CASE WHEN conflicts <> '' THEN 'dropped' WHEN same_type AND NOT (o1 OR o2 OR o3) AND price_ratio <= 2.5 THEN 'A' ELSE 'B' END AS class,
  (NOT same_type)::INT + (o1 OR o2 OR o3)::INT + (price_ratio > 2.5)::INT AS reasons FROM met),
ends AS (SELECT a AS id, b AS partner, shop_b AS shop FROM pairs WHERE class = 'A' UNION ALL SELECT b, a, shop_a FROM pairs WHERE class = 'A'),
marked AS (SELECT ends.id, shop, concat_ws('/', part_type, coalesce(nums::VARCHAR, '-'), coalesce(x_color, '-'), coalesce(x_size, '-'), coalesce(model, '-'), fit) AS sig, x_code FROM ends JOIN keyed ON partner = keyed.id),
ambiguous AS (SELECT DISTINCT id FROM (SELECT id, shop FROM marked GROUP BY ALL HAVING count(DISTINCT sig) > 1 OR count(DISTINCT x_code) > 1)),
final AS (SELECT *, CASE WHEN class = 'A' AND (a IN (SELECT id FROM ambiguous) OR b IN (SELECT id FROM ambiguous)) THEN 'B' ELSE class END AS last_class FROM pairs)"""
SQL["c3_bucket_pairs"] = f"WITH {_LINKED} SELECT a, b, round(jaccard, 6) AS jaccard FROM met"
SQL["c7_classified_pairs"] = f"""WITH {_LINKED} SELECT a, b, class, basis, shared, round(price_ratio, 6) AS price_ratio, conflicts FROM pairs"""
assert [a for a in ATTRIBUTES if a in _OWN_ATTR] == ["dimension", "color", "size", "code"]
SQL["a13_pair_counts"] = f"WITH {_LINKED} SELECT basis, class, count(*) AS pairs FROM pairs GROUP BY ALL"
SQL["a13_conflict_counts"] = f"WITH {_LINKED} SELECT attribute, count(*) AS pairs FROM (SELECT unnest(string_split(conflicts, ',')) AS attribute FROM pairs WHERE conflicts <> '') GROUP BY 1"
SQL["a13_shop_pairs"] = f"WITH {_LINKED} SELECT least(shop_a, shop_b) || ' x ' || greatest(shop_a, shop_b) AS shops, class, count(*) AS pairs FROM pairs WHERE basis = 'no_fit' AND class <> 'dropped' GROUP BY ALL"
SQL["c9_ambiguous_offers"] = f"WITH {_LINKED} SELECT id FROM ambiguous"
_REACH = f"""{_LINKED}, link AS (SELECT a AS x, b AS y FROM final WHERE last_class = 'A' UNION ALL SELECT b, a FROM final WHERE last_class = 'A'),
reach(x, y) AS (SELECT x, x FROM link UNION SELECT reach.x, link.y FROM reach JOIN link ON reach.y = link.x), clusters AS (SELECT x AS id, min(y) AS cluster FROM reach GROUP BY x)"""
SQL["c10_clusters"] = f"WITH RECURSIVE {_REACH} SELECT id, cluster FROM clusters"
_PLANS = f"""{_REACH}, members AS (SELECT cluster, keyed.* FROM keyed JOIN clusters USING (id) WHERE match_status IN ('pending', 'auto')),
sized AS (SELECT *, count(*) OVER c AS offers, count(x_code) OVER c AS coded, count_if(model_level = 'type') OVER c AS typed, row_number() OVER (PARTITION BY cluster ORDER BY shop_id, name, id) AS nth,
    row_number() OVER (PARTITION BY cluster ORDER BY length(name), name) AS by_name FROM members WINDOW c AS (PARTITION BY cluster)),
votes AS (SELECT cluster, category, row_number() OVER (PARTITION BY cluster ORDER BY count(*) DESC, category) AS r FROM sized WHERE shop_id = 'motomax' AND category <> 'Akce' GROUP BY cluster, category),
plans AS (SELECT cluster, max(offers) AS offers, max(part_type) FILTER (nth = 1) AS part_type, max(name) FILTER (by_name = 1) AS name,
    array_to_string(list_sort(list(DISTINCT model) FILTER (model IS NOT NULL AND (typed = 0 OR model_level = 'type'))), ',') AS models, array_to_string(list_sort(list(DISTINCT fit)), '+') AS fits, list(id) AS ids,
    max(concat_ws(';', CASE WHEN coded = offers THEN 'code=' || x_code END, 'color=' || x_color, 'dimension=' || array_to_string(list_transform(nums, lambda x: x::INT), ','), 'size=' || x_size)) FILTER (nth = 1) AS variant
  FROM sized WHERE offers >= 2 GROUP BY cluster),
planned AS (SELECT *, part_type || '|' || variant || '|' || CASE WHEN coalesce(models, '') <> '' THEN models ELSE 'fit:' || fits END AS cluster_key FROM plans)"""
SQL["c11_part_plans"] = f"""WITH RECURSIVE {_PLANS} SELECT cluster, cluster_key, part_type, name, {_slugify('name')} || '-' || {_hash('cluster_key')} AS slug, coalesce(category, 'Nezařazeno') AS category,
  coalesce(models, '') AS models, offers FROM planned LEFT JOIN (SELECT cluster, category FROM votes WHERE r = 1) USING (cluster)"""
# plans are walked through one by one, with the parts that are taken
_WALK = """listed AS (SELECT cluster_key, row_number() OVER (ORDER BY cluster_key) AS n, list(part_id ORDER BY by_key, votes DESC, part_id) AS ids, list(by_key ORDER BY by_key, votes DESC, part_id) AS keyed FROM wish GROUP BY cluster_key),
walk(n, taken, nth) AS (SELECT 0::BIGINT, []::VARCHAR[], 0::BIGINT UNION ALL SELECT n, CASE WHEN nth IS NULL THEN taken ELSE list_append(taken, ids[nth]) END, nth FROM (
  SELECT l.n, taken, ids, list_position(list_transform(ids, lambda x: list_contains(taken, x)), false)::BIGINT AS nth FROM walk w JOIN listed l ON l.n = w.n + 1)),
got AS (SELECT cluster_key, ids[nth] AS part_id, CASE WHEN keyed[nth] THEN 'cluster_key' ELSE 'part_id' END AS via FROM walk JOIN listed USING (n) WHERE nth IS NOT NULL)"""
SQL["c14_claimed_parts"] = f"""WITH RECURSIVE cat AS (SELECT p_partkey, p_brand || '|' || p_size AS part_id FROM part),
existing AS (SELECT part_id, 'c' || lpad(min(p_partkey)::VARCHAR, 12, '0') AS cluster_key, CASE WHEN min(p_partkey) % 10 = 0 THEN 'manual' ELSE 'auto' END AS source FROM cat GROUP BY 1),
votes AS (SELECT 'c' || lpad(o_custkey::VARCHAR, 12, '0') AS cluster_key, part_id, count(*) AS votes FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN cat ON l_partkey = p_partkey GROUP BY 1, 2),
wish AS (SELECT *, false AS by_key FROM votes UNION ALL SELECT cluster_key, part_id, 0, true FROM existing WHERE cluster_key IN (SELECT cluster_key FROM votes)), {_WALK}
SELECT g.cluster_key, g.part_id, via, e.source, coalesce(o.part_id <> g.part_id, false) AS key_conflict FROM got g JOIN existing e ON e.part_id = g.part_id LEFT JOIN existing o ON o.cluster_key = g.cluster_key"""
SQL["c14_applied_plans"] = f"""WITH RECURSIVE {_PLANS}, planned_offers AS (SELECT cluster_key, unnest(ids) AS id FROM planned),
wish AS (SELECT cluster_key, part_id, count(*) AS votes, false AS by_key FROM planned_offers JOIN items USING (id) WHERE part_id IS NOT NULL GROUP BY 1, 2), {_WALK}
SELECT cluster_key, CASE WHEN part_id IS NULL THEN 'insert' WHEN part_id = 'P5' THEN 'skip' ELSE 'update' END AS action, part_id, via FROM planned LEFT JOIN got USING (cluster_key)"""
SQL["j7_stale_auto"] = f"""WITH RECURSIVE {_PLANS} SELECT id AS offer_id FROM items WHERE match_status = 'auto' AND part_id IS NOT NULL AND id NOT IN (SELECT unnest(ids) FROM plans)"""
SQL["t3_ranked_b"] = f"""WITH {_LINKED} SELECT a, b FROM final WHERE last_class = 'B' ORDER BY same_type DESC, jaccard DESC, reasons + (class = 'A')::INT, price_ratio NULLS LAST, name_a, a, b LIMIT 200"""
SQL["a11_attribute_coverage"] = f"""WITH {_LINKED} SELECT shop_id, count(*) AS rows, count(x_color) AS color, count(x_size) AS size, count(x_dimension) AS dimension, count(x_code) AS code, count(part_type) AS part_type
FROM items GROUP BY ROLLUP (shop_id)"""
SQL["a12_top_part_types"] = f"WITH {_LINKED} SELECT part_type AS value, count(*) AS rows FROM items GROUP BY 1 ORDER BY rows DESC, value LIMIT 150"
SQL["j8_missing_models"] = f"""WITH {PARTS_SQL}, {LINKS_SQL}, {MODELS_SQL} SELECT DISTINCT CASE WHEN part_key % 50 = 0 THEN model_id || '?' ELSE model_id END AS missing FROM links WHERE missing NOT IN (SELECT id FROM models)"""
SQL["j9_part_models_delta"] = f"""WITH {PARTS_SQL}, {LINKS_SQL} SELECT part_key AS part_id, model_id, CASE WHEN part_key % 5 = 0 THEN 'delete' ELSE 'insert' END AS action FROM links
WHERE (part_key % 3 <> 0) <> (part_key % 5 <> 0)"""
SQL["j11_near_types"] = f"""WITH {PARTS_SQL}, t AS (SELECT DISTINCT base, list_distinct(string_split(base, ' ')) AS w FROM parts), v AS (SELECT base, w, len(w) AS n, unnest(w) AS word FROM t),
c AS (SELECT x.base AS x, y.base AS y, any_value(x.n) AS nx, any_value(y.n) AS ny, count(*) AS c FROM v x JOIN v y ON x.word = y.word AND x.base < y.base GROUP BY 1, 2)
SELECT x, y FROM c WHERE (nx = ny AND c = nx - 1) OR (abs(nx - ny) = 1 AND c = least(nx, ny)) OR (nx = ny AND c = nx)"""
SQL["j15_type_ranges"] = f"""WITH {MODELS_SQL}, r AS (SELECT DISTINCT 'Jawa 250/350/500' AS family, (p_size * 10 + 100)::INT AS lo, (p_size * 12 + 250)::INT AS hi FROM part),
t AS (SELECT id, family, unnest(type_numbers) AS type FROM models WHERE NOT list_contains(aliases, 'bizon'))
SELECT r.family, lo, hi, id, type FROM r JOIN t ON r.family = t.family AND try_cast(type AS INT) > lo AND try_cast(type AS INT) < hi"""

# --- pages and feeds --------------------------------------------------------------------------------------------------
SQL["s4_jsonld_products"] = f"""WITH {PARTS_SQL} SELECT 'https://shop.example.com/p/' || part_key AS page_url, base AS name, round(retail, 2) AS price, 'CZK' AS currency, part_key % 2 = 0 AS in_stock,
  'https://shop.example.com/p/' || part_key AS url, 'SKU' || part_key AS sku, '4006381333931' AS ean FROM parts WHERE part_key % 5 <> 4 AND part_key % 8 <> 3"""
SQL["s6_microdata_products"] = f"""WITH {PARTS_SQL} SELECT 'https://shop.example.com/' || part_key AS page_url, CASE WHEN part_key % 3 = 0 THEN 'Page ' || part_key ELSE base || ' & co' END AS name, round(retail, 2) AS price, true AS in_stock FROM parts"""
SQL["s4_jsonld_nested"] = f"WITH {PARTS_SQL} SELECT part_key::VARCHAR AS page_url, base AS name, retail AS price, 'i' || part_key AS image_url FROM parts"
SQL["s6_nested_scopes"] = f"WITH {PARTS_SQL} SELECT part_key::VARCHAR AS page_url, base AS name, round(retail, 2) AS price FROM parts"
SQL["s8_evidence_kinds"] = f"""WITH {PARTS_SQL}, k AS (SELECT *, part_key % 2 = 0 AND part_key % 3 <> 0 AS ld, part_key % 5 = 0 AS micro FROM parts)
SELECT part_key::VARCHAR AS page_url, CASE WHEN ld THEN 'jsonld' WHEN micro THEN 'microdata' WHEN part_key % 7 = 0 THEN 'og_type_only' END AS evidence,
  CASE WHEN ld THEN base WHEN micro THEN part_type END AS name, CASE WHEN ld OR micro THEN round(retail, 2) END AS price FROM k"""
SQL["s8_page_evidence"] = "SELECT page_id::VARCHAR AS page_url, NULL::VARCHAR AS evidence, NULL::VARCHAR AS name FROM pages"
_PATHS = [("/en/", False), ("/en/6", True), ("/fr", False), ("/fr", True)]
assert all(f"llow: {p}\n" in ROBOTS for p, _ in _PATHS)
SQL["s14_robots_allowed"] = f"""WITH r(path, allowed) AS (VALUES {', '.join(f"('{p}', {a})" for p, a in _PATHS)}), p AS (SELECT page_id, {_PATH} AS path FROM pages),
m AS (SELECT page_id, r.allowed, row_number() OVER (PARTITION BY page_id ORDER BY length(r.path) DESC, r.allowed) AS n FROM p JOIN r ON starts_with(p.path, r.path))
SELECT page_id, coalesce(m.allowed, true) AS allowed FROM p LEFT JOIN (SELECT * FROM m WHERE n = 1) m USING (page_id)"""
SQL["s10_sitemap_urls"] = "SELECT 'x' AS site, 'https://x.example.com/p/' || page_id AS url FROM pages"
_CRAWLABLE = "NOT starts_with(part_key::VARCHAR, '1') OR starts_with(part_key::VARCHAR, '10')"
SQL["s16_crawled_products"] = f"""WITH {PARTS_SQL} SELECT 'https://shop.example.com/p/' || part_key AS page_url, base AS name, round(retail, 2) AS price, 'jsonld' AS evidence FROM parts
WHERE part_key % 5 <> 4 AND part_key % 8 <> 3 AND ({_CRAWLABLE})"""
SQL["s20_probe_report"] = f"""WITH {PARTS_SQL} SELECT 'shop' AS site, 'ok' AS reachable, 'found' AS robots, 'shoptet' AS platform, count(*) AS sitemap_urls, []::VARCHAR[] AS feeds,
  least(count_if(part_key % 5 <> 4 AND part_key % 8 <> 3 AND ({_CRAWLABLE})), 3)::INT AS products FROM parts"""
SQL["s17_refresh_outcomes"] = f"""WITH {PARTS_SQL}, k AS (SELECT part_key::VARCHAR AS item_id, retail, CASE WHEN part_key % 13 = 0 THEN 'disallowed' WHEN part_key % 7 = 1 THEN 'not_found' WHEN part_key % 7 IN (2, 3) THEN 'error'
  WHEN part_key % 5 = 4 OR part_key % 8 = 3 THEN 'no_product' ELSE 'item' END AS kind FROM parts) SELECT item_id, kind, CASE WHEN kind = 'item' THEN round(retail, 2) END AS price FROM k"""
SQL["s2_heureka_feed"] = f"""WITH {PARTS_SQL} SELECT part_key::VARCHAR AS item_id, base AS name, round(retail, 2) AS price, 'https://shop.example.com/' || part_key AS url, (part_key % 5)::INT AS delivery_days FROM parts WHERE part_key % 10 <> 0"""
SQL["s2_mixed_case_feed"] = f"""WITH {PARTS_SQL} SELECT part_key::VARCHAR AS item_id, base || ' <b> & co' AS name, round(retail, 2) AS price, 'https://x/' || part_key AS url FROM parts"""
SQL["s3_google_feed"] = f"""WITH {PARTS_SQL} SELECT part_key::VARCHAR AS item_id, base AS name, round(retail, 2) AS price, 'CZK' AS currency, 'https://shop.example.com/' || part_key AS url, part_key % 3 <> 1 AS in_stock FROM parts"""
SQL["s21_delimited_text"] = f"WITH {PARTS_SQL} SELECT part_key::VARCHAR AS count, brand AS shop, base || '~~' || part_type AS name FROM parts"
SQL["stream_aged"] = f"""WITH {OFFERS_SQL}, one AS (SELECT shop_id, item_id, coalesce(in_stock, true) AS in_stock, last_seen_at FROM offers QUALIFY {_LATEST}),
first AS (SELECT *, in_stock AND NOT (shop_id <> 'S1' AND last_seen_at < TIMESTAMP '{SPLIT}' - INTERVAL 3 DAY) AS aged FROM one),
second AS (SELECT *, CASE WHEN ends_with(item_id, '-2') THEN true ELSE aged END AS back FROM first)
SELECT shop_id, item_id, back AND NOT (shop_id = 'S2' AND last_seen_at < TIMESTAMP '{NOW}' - INTERVAL 3 DAY) AS in_stock, last_seen_at FROM second"""
SQL["stream_import"] = f"""WITH {OFFERS_SQL} SELECT shop_id, item_id, name, price, url, coalesce(in_stock, true) AS in_stock, last_seen_at, 'pending' AS match_status, NULL::VARCHAR AS part_id FROM offers QUALIFY {_LATEST}"""

# --- names: what the last words of a part's name say ------------------------------------------------------------------
_ENDS = [
    ("type", "jawa-350-634", 2), ("type", "cz-175-477", 2), ("type", "pionyr-20,pionyr-21", 0), ("type", "babetta-210", 1), ("nickname", "stadion-s11", 0),
    ("nickname", "panelka-250-559,panelka-250-592", 2), (None, "", 0), ("brand", "", 1), (None, "", 0), (None, "", 0), ("brand", "", 1), ("brand", "", 1),
]
_ENDS_SQL = "ends(suffix, level, models, generic) AS (VALUES " + ", ".join(f"({i}, {_q(a) if a else 'NULL'}, {_q(m)}, {g})" for i, (a, m, g) in enumerate(_ENDS)) + ")"
SQL["m_parse_models"] = f"WITH {PARTS_SQL}, {_ENDS_SQL} SELECT DISTINCT name, level, models, generic FROM parts JOIN ends USING (suffix)"
SQL["c17_write_plan"] = f"""WITH {OFFERS_SQL}, {_ENDS_SQL} SELECT coalesce(level, 'none') AS level, count(*) AS offers, sum(CASE WHEN models = '' THEN 0 ELSE len(string_split(models, ',')) END)::BIGINT AS links,
  count_if(generic > 0) AS with_generic FROM offers JOIN ends USING (suffix) WHERE suffix NOT IN (6, 7) GROUP BY 1"""
SQL["k6_product_summaries"] = f"""WITH {PARTS_SQL}, {_ENDS_SQL} SELECT CASE WHEN suffix IN (6, 7) THEN 'old' ELSE coalesce(level, 'none') END AS model_match_level, suffix NOT IN (6, 7) AS parsed, count(*) AS offers
FROM parts JOIN ends USING (suffix) GROUP BY ALL"""
_TWO = f"""{PARTS_SQL}, {MODELS_SQL}, {_ENDS_SQL}, p AS (SELECT suffix, regexp_extract(name, '^\\S+ \\S+ \\S+ (.*)$', 1) AS e, count(*) AS parts FROM parts GROUP BY ALL),
two AS (SELECT a.suffix AS sa, b.suffix AS sb, a.e || ' díl ' || b.e AS name, a.parts AS count FROM p a JOIN p b ON a.suffix < b.suffix),
named AS (SELECT suffix, unnest(string_split(ends.models, ',')) AS id FROM ends), fam AS (SELECT DISTINCT suffix, family FROM named JOIN models USING (id)),
split AS (SELECT name, any_value(count) AS count, array_to_string(list_sort(list(DISTINCT family)), ',') AS families, count(DISTINCT family) AS n FROM two JOIN fam ON fam.suffix IN (sa, sb) GROUP BY name)"""
SQL["a10_special_pairs"] = f"""WITH {_TWO} SELECT (SELECT coalesce(sum(count), 0)::BIGINT FROM split WHERE n > 1) AS several_families,
  coalesce(sum(CASE WHEN sa = 0 AND sb = 5 THEN count END), 0)::BIGINT AS several_displacements, 0::BIGINT AS suspicious FROM two"""
SQL["a10_special_counts"] = f"""WITH {PARTS_SQL}, {MODELS_SQL}, {_ENDS_SQL}, named AS (SELECT suffix, unnest(string_split(ends.models, ',')) AS id FROM ends), fam AS (SELECT suffix, count(DISTINCT family) AS f, count(*) AS n FROM named JOIN models USING (id) GROUP BY 1)
SELECT count_if(f > 1) AS several_families, 0::BIGINT AS several_displacements, count_if(n > 6) AS suspicious FROM parts LEFT JOIN fam USING (suffix)"""
SQL["c15_family_conflicts"] = f"WITH {_TWO} SELECT name, families FROM split WHERE n > 1"


def _case_list(values: list) -> str:
    return "[" + ", ".join("NULL" if v is None else _q(v) for v in values) + "][part_key % " + str(len(values)) + " + 1]"


SQL["m_model_cases"] = f"WITH {PARTS_SQL} SELECT part_key, {_case_list([c[1] for c in MODEL_CASES])} AS level, {_case_list([c[2] for c in MODEL_CASES])} AS models FROM parts"
SQL["o_offer_cases"] = f"WITH {PARTS_SQL} SELECT part_key, {_case_list([c[1] for c in OFFER_CASES])} AS attributes, {_case_list([c[2] for c in OFFER_CASES])} AS tags FROM parts"
_STEMS = "kolena kolen koleno kolen paprsky paprsk paprsek paprsk osy os karb karburator lanka bowden simerink gufer ocelovych ocel pistni pist kryt kryt volnobezny volnobeh samolepky nalepk".split()
SQL["t5_stems"] = "SELECT * FROM (VALUES " + ", ".join(f"({_q(w)}, {_q(s)})" for w, s in zip(_STEMS[::2], _STEMS[1::2], strict=True)) + ") v(word, stem)"


def _text(c: str) -> str:
    for pattern, char in (("<[^>]+>", " "), ("(?i)&nbsp;", " "), ("(?i)&quot;", '"'), ("(?i)&#0?39;|&apos;", "'"), ("(?i)&lt;", "<"), ("(?i)&gt;", ">"), ("(?i)&amp;", "&"), (r"\s+", " ")):
        c = f"regexp_replace({c}, {_q(pattern)}, {_q(char)}, 'g')"
    return f"trim({c})"


SQL["t9_page_titles"] = f"""SELECT page_id, nullif({_text("regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1)")}, '') AS title, regexp_matches(html, '(?i)og:type') AS og_product FROM pages"""
SQL["t6_hash_sample"] = "SELECT doc_id, lang FROM documents ORDER BY md5('20260930:' || doc_id), doc_id LIMIT 50"
_TIMES = "((({0})::HUGEINT * ({1})) % 4294967296)::BIGINT"
_DRAWN = f"""d1 AS (SELECT kind, n, i, (20260930 + (used + n - i) * 1831565813) % 4294967296 AS t FROM (SELECT *, unnest(range(1, n)) AS i FROM sizes)),
d2 AS (SELECT kind, n, i, {_TIMES.format('xor(t, t >> 15)', 't | 1')} AS t FROM d1),
d3 AS (SELECT kind, n, i, xor(t, (t + {_TIMES.format('xor(t, t >> 7)', 't | 61')}) % 4294967296) AS t FROM d2),
swap AS (SELECT kind, n, i, floor(xor(t, t >> 14) / 4294967296.0::DOUBLE * (i + 1))::BIGINT AS j FROM d3)"""
# the shuffle's swaps, undone one by one, for the places of both samples
SQL["t6_seeded_samples"] = f"""WITH RECURSIVE {PARTS_SQL}, r AS (SELECT CASE WHEN suffix IN (6, 8, 9) THEN 'other' ELSE 'matched' END AS kind, part_key FROM parts),
ranked AS (SELECT kind, part_key, row_number() OVER (PARTITION BY kind ORDER BY part_key) - 1 AS pos FROM r), both_n AS (SELECT count_if(kind = 'matched')::BIGINT AS m, count_if(kind = 'other')::BIGINT AS o FROM r),
sizes AS (SELECT 'matched' AS kind, m AS n, 0 AS used, least(m, 30) AS size FROM both_n UNION ALL SELECT 'other', o, greatest(m - 1, 0), least(o, 20) FROM both_n), {_DRAWN},
walk(kind, i, n, places) AS (SELECT kind, 0::BIGINT, n, range(0, size) FROM sizes
  UNION ALL SELECT w.kind, s.i, w.n, list_transform(w.places, lambda x: CASE WHEN x = s.i THEN s.j WHEN x = s.j THEN s.i ELSE x END) FROM walk w JOIN swap s ON s.kind = w.kind AND s.i = w.i + 1),
done AS (SELECT kind, unnest(places) AS pos, unnest(range(0, len(places))) AS place FROM walk WHERE i = greatest(n - 1, 0))
SELECT kind, place::INT AS place, part_key FROM done JOIN ranked USING (kind, pos)"""
