"""Golden tables for vehicle models and part names."""

import pytest
from pyspark.sql import functions as F

from quern.operators import model_names as N
from quern.operators import offer_names as O
from quern.store import kept

MODELS = {
    "Píst Jawa 350 typ 634": ("type", ["jawa-350-634"]),
    "Válec ČZ 175 typ 477": ("type", ["cz-175-477"]),
    "Sedlo Pionýr 20, 21": ("type", ["pionyr-20", "pionyr-21"]),
    "Guma Babetta 210": ("type", ["babetta-210"]),
    "Lanko Stadion S 11/22": ("nickname", ["stadion-s11", "stadion-s22"]),
    "Kryt Jawa 250 Panelka": ("nickname", ["panelka-250-559", "panelka-250-592"]),
    "Kolo ČZ 125/150 C": ("type", ["cz-125-c", "cz-150-c"]),
    "Řetěz Jawa 638-640": ("type", ["jawa-350-638", "jawa-350-639", "jawa-350-640"]),
    "Tlumič Kývačka": ("nickname", ["kyvacka-250", "kyvacka-350"]),
    "Tlumič Kývačka 175": ("nickname", ["jawa-cz-175-356"]),
    "Jawa 350 OHC": ("displacement", []),
    "Čezeta 175": ("brand", []),
    "Spojka (CZ) Jawa 350": ("displacement", []),
    "Pérák 11, 18": ("type", ["perak-250", "perak-350"]),
    "Pérák 250/11": ("type", ["perak-250"]),
    "Jawa90 roadster": ("nickname", ["jawa-90-roadster"]),
    "jawa350": ("displacement", []),
    "Jawetta sport sedlo": ("nickname", ["jawetta-sport"]),
    "Píst Jawa 58,25 mm": ("brand", []),
    "Simson S51": (None, []),
    "Jawa 354/06": ("type", ["kyvacka-350", "panelka-350-360"]),
    "Jawa 999": ("brand", []),
    "": (None, []),
}
OFFERS = {
    "Píst Jawa 350 typ 634 58,25 mm": ("pist", {"dimension": "58.25mm"}, []),
    "Lanko spojky Pionýr 20, 21 (sada) *JIKOV": ("bowden spojk", {"pack": "sada", "ref": "jikov"}, []),
    "Žárovka 6V 15W Ba15d": ("zarovk", {"dimension": "15w ba15d", "voltage": "6v"}, []),
    "Blatník přední chrom levý Jawa 250 ,,CZ": ("blatnik", {"side": "left", "position": "front", "finish": "chrome"}, ["origin-cz"]),
    "Šroub M6x90 zinek 10 ks": ("sroub", {"dimension": "m6x90", "finish": "zinc", "pack": "10ks"}, []),
    "Karburátor 2926 *JIKOV Jawa 350": ("karburator", {"ref": "jikov", "code": "2926"}, []),
    "Guma nádrže Babetta 210": ("guma nadrz", {}, []),
    "Krytka plast (černá)": ("krytk", {"color": "black", "material": "plastic"}, []),
    "Pneumatika 3,00 - 12 Mitas": ("pneumatik", {"dimension": "3.00-12"}, ["mfr:mitas"]),
    "Ložisko 6202 2RS": ("lozisk", {"dimension": "6202-2rs"}, []),
    "Brzda s pákou bez držáku Jawa 50": ("brzd", {"with": "bez:drzak s:pak"}, []),
}


def _frame(spark, names):
    return spark.createDataFrame([(i, "x", n) for i, n in enumerate(names)], "key long, shop_id string, name string")


@pytest.fixture(scope="module")
def dictionary(spark):
    return N.seed_dictionary(spark)


def test_models(spark, dictionary):
    names = list(MODELS)
    found = {r.key: (r.level, [m.id for m in r.models]) for r in N.parsed_models(_frame(spark, names), dictionary, kept).collect()}
    assert {n: found[i] for i, n in enumerate(names)} == MODELS


def test_unresolved_numbers(spark, dictionary):
    r = N.parsed_models(_frame(spark, ["Jawa 999"]), dictionary, kept).first()
    assert [(u.kind, u.brand, u.token) for u in r.unresolved] == [("number", "Jawa", "999")]


def test_scope_of_one_shop(spark, dictionary):
    df = spark.createDataFrame([(1, "motojelinek", "Jawa 350 kryt - ČZ 175"), (2, "other", "Jawa 350 kryt - ČZ 175")], "key long, shop_id string, name string")
    found = {r.key: {g.brand for g in r.generic} for r in N.parsed_models(df, dictionary, kept).collect()}
    assert found == {1: {"ČZ"}, 2: {"Jawa", "ČZ"}}


def test_offers(spark, dictionary):
    names = list(OFFERS)
    found = {}
    for r in O.parsed_offers(_frame(spark, names), dictionary, kept).collect():
        found[names[r.key]] = (r.part_type, {k: v for k, v in r.variant.asDict().items() if v is not None}, r.quality_tags)
    assert found == OFFERS


def test_word_order_does_not_matter(spark, dictionary):
    df = _frame(spark, ["Páka brzdy zadní", "Zadní páka brzdy"])
    assert O.parsed_offers(df, dictionary, kept).select("part_type", F.to_json("variant")).distinct().count() == 1
