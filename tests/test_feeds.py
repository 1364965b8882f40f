"""Feeds read in byte ranges, with element names in any case."""

import random

import pytest

from quern.sources import feeds


@pytest.fixture
def small_ranges(spark):
    keys = {"spark.sql.files.maxPartitionBytes": "700", "spark.sql.files.openCostInBytes": "1"}
    old = {k: spark.conf.get(k) for k in keys}
    for k, v in keys.items():
        spark.conf.set(k, v)
    yield
    for k, v in old.items():
        spark.conf.set(k, v)


def spelled(rng, name):
    return rng.choice([name, name.lower(), name.title(), "".join(rng.choice((c.lower(), c.upper())) for c in name)])


def element(rng, name, value):
    start, end = spelled(rng, name), spelled(rng, name)
    raw = rng.random() < 0.3
    text = f"<![CDATA[{value}]]>" if raw else value.replace("&", "&amp;").replace("<", "&lt;").replace(">", "&gt;")
    return f"<{start}{rng.choice(['', ' a="b"'])}> {text}\n</{end}>"


def test_heureka_in_ranges(spark, tmp_path, small_ranges):
    rng = random.Random(12)
    want = []
    for f in range(3):
        text = "<?xml version='1.0'?>\n<SHOP>"
        for k in range(60):
            i, name = f"{f}-{k}", rng.choice(["plain", "a < b & c > d", "<SHOPITEM> quoted", "é" * rng.randint(1, 900)])
            parts = [element(rng, "ITEM_ID", i), element(rng, "PRODUCTNAME", "old"), element(rng, "PRODUCTNAME", name), element(rng, "PRICE_VAT", "12,5"), element(rng, "URL", f"u{i}"), "<nested><x>1</x></nested>", "<URL/>", "<PRODUCTNAME> </PRODUCTNAME>", "<PRICE_VAT>none</PRICE_VAT>"]
            if k % 7 == 0:
                parts.pop(0)
            else:
                want.append((i, name, 12.5, f"u{i}"))
            text += f"<{spelled(rng, 'SHOPITEM')}>{rng.choice(['', chr(10)])}{''.join(parts)}</{spelled(rng, 'SHOPITEM')}>{rng.choice(['', ' ', chr(10)])}"
        (tmp_path / f"{f}.xml").write_text(text + "</SHOP>\n")
    df = feeds.feed_items(spark, str(tmp_path), "heureka")
    assert sorted((r.item_id, r.name, r.price, r.url) for r in df.collect()) == sorted(want)
    assert spark.read.option("lineSep", ">").text(str(tmp_path)).rdd.getNumPartitions() > 50


def test_an_item_longer_than_many_ranges(spark, tmp_path, small_ranges):
    long = "x <b>y</b> " * 2000
    text = f"<shop><shopitem><item_id>1</item_id><productname>a</productname><price_vat>1</price_vat><url>u</url><description><![CDATA[{long}]]></description></shopitem><ShopItem><item_id>2</item_id></ShopItem><shopitem><item_id>cut"
    (tmp_path / "a.xml").write_text(text)
    got = feeds.heureka_items(spark, str(tmp_path)).collect()
    assert sorted((r.item_id, r.description) for r in got) == sorted([("1", long.strip()), ("2", None)], key=str)


def test_merchant_feed(spark, tmp_path):
    (tmp_path / "g.xml").write_text(
        """<rss><channel><title>shop</title><ITEM><g:ID>1</g:ID><Title>a &#269; &quot;b&quot;</Title><g:Price>1 290,00 CZK</g:Price><link>u1</link><g:availability>out_of_stock</g:availability></ITEM>
        <Entry><id>2</id><title>t</title><x:price>5.50</x:price><LINK HREF='h&amp;2'/><g:price>later EUR</g:price><availability>in stock</availability><availability>unknown</availability></Entry>
        <item><id>3</id><title>t</title><g:price>5 CZK</g:price><link href="h3">text</link></item><item><id>4</id><title>no price</title><link>u</link></item></channel></rss>"""
    )
    got = {r.item_id: (r.name, r.price, r.currency, r.url, r.in_stock) for r in feeds.feed_items(spark, str(tmp_path), "google").collect()}
    assert got == {"1": ('a č "b"', 1290.0, "CZK", "u1", False), "2": ("t", 5.5, "EUR", "h&2", True), "3": ("t", 5.0, "CZK", "text", None)}
