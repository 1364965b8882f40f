"""The canonical vehicle models, a small dimension."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import fold

# Id, brand, family, displacement, type numbers, aliases, whether a person should verify the row.
MODELS = [
    ("pionyr-550", "Jawa", "Jawa 50", 50, "550", "pařez, typ 550", False),
    ("pionyr-555", "Jawa", "Jawa 50", 50, "555", "pařez, typ 555", False),
    ("pionyr-05", "Jawa", "Jawa 50", 50, "05", "pionýr", False),
    ("pionyr-20", "Jawa", "Jawa 50", 50, "20", "pionýr", False),
    ("pionyr-21", "Jawa", "Jawa 50", 50, "21", "pionýr", False),
    ("mustang-23", "Jawa", "Jawa 50", 50, "23", "mustang", False),
    ("jawetta", "Jawa", "Jawetta", 50, "551", "jawetta, jaweta", False),
    ("jawetta-sport", "Jawa", "Jawetta", 50, "551", "jawetta sport, jaweta sport", False),
    ("stadion-s11", "Stadion", "Stadion", 50, "552", "stadion, s11", False),
    ("stadion-s22", "Stadion", "Stadion", 50, "552", "stadion, s22", False),
    ("stadion-s23", "Stadion", "Stadion", 50, "552", "stadion, s23", False),
    ("jawa-90-cross-trail", "Jawa", "Jawa 90", None, "30, 36", "jawa 90, jawa 90 cross, trail", True),
    ("jawa-90-roadster", "Jawa", "Jawa 90", None, "31, 37", "jawa 90, roadster", True),
    ("perak-250", "Jawa", "Jawa 250/350/500", 250, "11", "pérák", False),
    ("perak-350", "Jawa", "Jawa 250/350/500", 350, "12, 18", "pérák, ogar", False),
    ("ohc-500", "Jawa", "Jawa 250/350/500", 500, "15", "ohc", False),
    ("kyvacka-250", "Jawa", "Jawa 250/350/500", 250, "353", "kývačka, kýv., kejvačka", False),
    ("kyvacka-350", "Jawa", "Jawa 250/350/500", 350, "354", "kývačka, kýv., kejvačka", False),
    ("panelka-250-559", "Jawa", "Jawa 250/350/500", 250, "559", "panelka", False),
    ("panelka-250-592", "Jawa", "Jawa 250/350/500", 250, "592", "panelka", False),
    ("panelka-350-360", "Jawa", "Jawa 250/350/500", 350, "360", "panelka", False),
    ("sport-250-590", "Jawa", "Jawa 250/350/500", 250, "590", "sportka, californian", False),
    ("sport-350-361", "Jawa", "Jawa 250/350/500", 350, "361", "sportka, californian", False),
    ("californian-362", "Jawa", "Jawa 250/350/500", 350, "362", "californian", False),
    ("jawa-350-634", "Jawa", "Jawa 250/350/500", 350, "634", "", False),
    ("jawa-350-638", "Jawa", "Jawa 250/350/500", 350, "638", "", False),
    ("jawa-350-639", "Jawa", "Jawa 250/350/500", 350, "639", "", False),
    ("jawa-350-640", "Jawa", "Jawa 250/350/500", 350, "640", "", False),
    ("jawa-350-632", "Jawa", "Jawa 250/350/500", 350, "632", "", False),
    ("jawa-250-623", "Jawa", "Jawa 250/350/500", 250, "623", "bizon", False),
    ("jawa-350-633", "Jawa", "Jawa 250/350/500", 350, "633", "bizon", False),
    ("velorex-350", "Velorex", "Velorex", 350, "", "velorex", False),
    ("jawa-cz-125-355", "Jawa", "Jawa-ČZ", 125, "355", "", False),
    ("jawa-cz-125-351", "Jawa", "Jawa-ČZ", 125, "351", "", False),
    ("jawa-cz-175-356", "Jawa", "Jawa-ČZ", 175, "356", "kývačka, kývačka 175, malá kývačka", False),
    ("jawa-cz-150-352", "Jawa", "Jawa-ČZ", 150, "352", "", False),
    ("cz-125-a", "ČZ", "ČZ", 125, "A", "", False),
    ("cz-125-b", "ČZ", "ČZ", 125, "B", "", False),
    ("cz-125-t", "ČZ", "ČZ", 125, "T", "", False),
    ("cz-125-c", "ČZ", "ČZ", 125, "C", "", False),
    ("cz-150-c", "ČZ", "ČZ", 150, "C", "", False),
    ("cz-150-miss", "ČZ", "ČZ", 150, "", "miss", False),
    ("cz-125-453", "ČZ", "ČZ", 125, "453", "", False),
    ("cz-125-473", "ČZ", "ČZ", 125, "473", "", False),
    ("cz-175-450", "ČZ", "ČZ", 175, "450", "", False),
    ("cz-175-470", "ČZ", "ČZ", 175, "470", "", False),
    ("cz-250-455", "ČZ", "ČZ", 250, "455", "", False),
    ("cz-250-475", "ČZ", "ČZ", 250, "475", "", False),
    ("cz-125-476", "ČZ", "ČZ", 125, "476", "", False),
    ("cz-175-477", "ČZ", "ČZ", 175, "477", "", False),
    ("cz-125-488", "ČZ", "ČZ", 125, "488", "", False),
    ("cz-175-487", "ČZ", "ČZ", 175, "487, 180", "", False),
    ("cz-250-471", "ČZ", "ČZ", 250, "471", "", False),
    ("cz-350-472", "ČZ", "ČZ", 350, "472", "", False),
    ("cezeta-501", "ČZ", "Čezeta", 175, "501", "čezeta, cezeta, čezetu, čezety, čezet", False),
    ("cezeta-502", "ČZ", "Čezeta", 175, "502", "čezeta, cezeta, čezetu, čezety, čezet", False),
    ("babetta-206", "Babetta", "Babetta", 50, "206", "", False),
    ("babetta-207", "Babetta", "Babetta", 50, "207", "", False),
    ("babetta-210", "Babetta", "Babetta", 50, "210", "", False),
    ("babetta-215", "Babetta", "Babetta", 50, "215", "", True),
    ("babetta-225", "Babetta", "Babetta", 50, "225", "", False),
    ("babetta-228", "Babetta", "Babetta", 50, "228", "", False),
    ("babetta-134", "Babetta", "Babetta", 50, "134", "stella, star, star 134", False),
]


def models(spark: SparkSession) -> DataFrame:
    """id, brand, name, family, displacement, type_numbers, aliases, needs_verification."""
    df = spark.createDataFrame(MODELS, "id string, brand string, family string, displacement int, types string, nicknames string, needs_verification boolean")
    listed = lambda c: F.filter(F.split(c, ", "), lambda x: x != "")
    name = F.concat_ws(" ", "family", F.col("displacement").cast("string"), F.get(listed("types"), F.lit(0)))
    return df.select("id", "brand", name.alias("name"), "family", "displacement", listed("types").alias("type_numbers"), listed("nicknames").alias("aliases"), "needs_verification")


def alias_key(c):
    """An alias as it is looked up: folded, without dots, single spaces."""
    return F.trim(F.regexp_replace(F.regexp_replace(fold(c), r"\.", ""), r"\s+", " "))
