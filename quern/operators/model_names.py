"""Vehicle models in free-text names: dictionary joins and windows over tokens.

A name is cut into tokens with the separators before them.  A brand or nickname opens a context, numbers chained to it are types or
displacements, any other word closes it.  What the grammar has to know about neighbours (the anchor a number belongs to, the numbers
before and after a nickname) comes from windows over one name's tokens and over its groups (an anchor with the numbers chained to it); the
dictionary is a handful of rows and is broadcast.  Names are made distinct first, and one name's tokens are the largest thing a task holds
together.

Matched texts are given as folded words.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import fold
from ..sources.seed import alias_key

# Fixed values of the grammar.
BRANDS = {"jawa": "Jawa", "cz": "ČZ", "babetta": "Babetta", "babeta": "Babetta"}
GLUED = "jawa cz babetta babeta pionyr stella perak kyvacka panelka mustang jawetta cezeta velorex stadion".split()
FILLERS = "typ typy cislo cisla model a sport".split()
UNRESOLVED = ["calif", "libenak"]
ORIGINS = "twn tw tur ind it sk original org".split()
SCOPED_SHOP = "motojelinek"
CONTEXT_ALIAS = ("ogar", "jawa")
NO_RANGE = "bizon"
EXTRA = ("354", "06", "panelka-350-360")
LEVELS = {"type": 4, "nickname": 3, "displacement": 2, "brand": 1}

_B, _E = r"(?<![a-z0-9_])", r"(?![a-z0-9_])"
_CHAIN = r"^[\s,/\-.]*$"


def model_scope(name: Column, shop: Column) -> Column:
    """Where models stand in a name: for one shop, after the last " - "."""
    last = F.trim(F.regexp_replace(name, r"^.* - ", ""))
    return F.when((shop == SCOPED_SHOP) & name.contains(" - "), last).otherwise(name)


@dataclass
class Dictionary:
    """Aliases and types of a table of models, as broadcast tables."""

    models: DataFrame
    aliases: DataFrame
    types: DataFrame
    displacements: DataFrame
    multi: list[str]

    @staticmethod
    def of(models: DataFrame) -> Dictionary:
        """models: a dimension of at most a few thousand rows."""
        m = models.select("id", "brand", "family", "displacement", "type_numbers", "aliases")
        keyed = m.select("id", "brand", "family", "displacement", F.explode("aliases").alias("alias")).withColumn("key", alias_key(F.col("alias")))
        bare = keyed.select("id", F.regexp_extract("key", r"^(.*) \d+$", 1).alias("key")).where("key <> ''").withColumn("own_displacement", F.lit(True)).distinct()
        aliases = keyed.join(bare, ["id", "key"], "left").select("id", "brand", "family", "displacement", F.translate("key", " ", "_").alias("key"), F.coalesce("own_displacement", F.lit(False)).alias("own_displacement")).distinct()
        types = m.select("id", "brand", "family", F.explode("type_numbers").alias("type"), F.exists("aliases", lambda a: alias_key(a) == NO_RANGE).alias("no_range"))
        multi = sorted((r.key for r in keyed.where(F.col("key").contains(" ")).select("key").distinct().toLocalIterator()), key=lambda k: (-k.count(" "), k))
        return Dictionary(m, aliases, types, m.where("displacement is not null").select("brand", F.col("displacement").cast("string").alias("num")).distinct(), multi)


def prepared(text: Column, multi: list[str]) -> Column:
    """The folded text, with marks and quotes blanked and compound words made one token."""
    t = F.regexp_replace(text, r"\*\S*", " ")
    t = F.regexp_replace(t, r",,(?!(?:CZ|ČZ)\s+\S)[A-Za-zČčŽž]{1,3}(?![A-Za-zČčŽž0-9])", " ")
    t = F.regexp_replace(F.translate(fold(t), "_", "|"), "[„“”\"']", " ")
    brands, origins = "|".join(BRANDS), "|".join(ORIGINS)
    only = rf"\([^a-z0-9()]*(?:{brands})(?:[^a-z0-9()]+(?:{brands}))*[^a-z0-9()]*\)"
    mixed = rf"\((?=[^()]*{_B}(?:{brands}){_E})[^a-z0-9()]*(?:{brands}|{origins})(?:[^a-z0-9()]+(?:{brands}|{origins}))*[^a-z0-9()]*\)"
    t = F.regexp_replace(F.regexp_replace(t, only, " | "), mixed, " | twn | ")
    t = F.regexp_replace(t, rf"{_B}({'|'.join(GLUED)})(\d{{2,3}}){_E}", "$1-$2")
    t = F.regexp_replace(t, rf"{_B}(\d{{3}})([abtc]){_E}", "$1-$2")
    for key in multi:
        t = F.regexp_replace(t, _B + r"\s+".join(key.split(" ")) + _E, key.replace(" ", "_"))
    t = F.regexp_replace(t, rf"{_B}s\s+(11|22|23){_E}", "s$1")
    for _ in range(3):
        t = F.regexp_replace(t, rf"{_B}(stadion|s11|s22|s23)(\s*/?\s*)(11|22|23){_E}", "$1$2s$3")
    return t


def tokens(names: DataFrame, dictionary: Dictionary) -> DataFrame:
    """names (key, shop_id, name) as tokens: key, pos, token, sep, kind (NUM, BRAND, NICK, WORD), context, grp and more."""
    text = prepared(model_scope(F.col("name"), F.col("shop_id")), dictionary.multi)
    cut = names.select("key", text.alias("text")).select("key", F.regexp_extract_all("text", F.lit("[a-z0-9_]+"), 0).alias("ts"), F.split("text", "[a-z0-9_]+").alias("ss"))
    each = cut.select("key", F.posexplode(F.arrays_zip("ts", "ss"))).where("col.ts is not null").select("key", "pos", F.col("col.ts").alias("token"), F.coalesce("col.ss", F.lit("")).alias("sep"))
    nick = dictionary.aliases.groupBy(F.col("key").alias("token")).agg(F.collect_set("brand").alias("nick_brands"))
    brand = F.create_map(*(F.lit(x) for kv in BRANDS.items() for x in kv))
    t = each.join(F.broadcast(nick), "token", "left")
    order = Window.partitionBy("key").orderBy("pos")
    kind = F.when(F.col("token").rlike("^[0-9]+$"), "NUM").when(F.col("token").isin(list(BRANDS)), "BRAND").when(F.col("nick_brands").isNotNull(), "NICK").otherwise("WORD")
    t = t.withColumns({"kind": kind, "brand": brand[F.col("token")], "chain": F.col("sep").rlike(_CHAIN), "spaced": F.col("sep").rlike(r"^\s+$")})
    seen = lambda c: F.max(c).over(order.rowsBetween(Window.unboundedPreceding, -1))
    t = t.withColumns(
        {
            "prev_kind": F.lag("kind").over(order),
            "prev_token": F.lag("token").over(order),
            "next_kind": F.lead("kind").over(order),
            "next_token": F.lead("token").over(order),
            "next_sep": F.lead("sep").over(order),
            "last_brand": F.last(F.when(F.col("kind") == "BRAND", F.col("token")), ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, -1)),
            "cz_before": F.coalesce(seen((F.col("brand") == "ČZ") | F.array_contains(F.coalesce("nick_brands", F.array().cast("array<string>")), "ČZ")), F.lit(False)),
        }
    )
    t = t.withColumn("kind", F.when((F.col("token") == CONTEXT_ALIAS[0]) & ~F.coalesce(F.col("last_brand") == CONTEXT_ALIAS[1], F.lit(False)), "WORD").otherwise(F.col("kind")))
    word = F.col("kind") == "WORD"
    letter = word & F.col("token").rlike("^[abtc]$") & F.col("cz_before") & F.col("chain") & (F.col("prev_kind").isin("NUM") | F.col("prev_token").rlike("^[abtc]$")) & ~((F.col("token") == "a") & F.coalesce(F.col("next_kind") == "NUM", F.lit(False)))
    passing = F.coalesce(letter, F.lit(False)) | (F.col("token").isin(FILLERS) & F.col("chain")) | F.col("token").isin(UNRESOLVED)
    t = t.withColumns({"letter": F.coalesce(letter, F.lit(False)), "breaks": word & ~passing})
    # The last token before this one that is no filler: only a brand right after brands joins their context.
    anchor = F.when(F.col("breaks"), "X").when(F.col("kind").isin("BRAND", "NICK", "NUM"), F.col("kind"))
    before = F.last(anchor, ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, -1))
    t = t.withColumn("before", before)
    opens = (
        F.col("breaks")
        | ((F.col("kind") == "BRAND") & ~(F.col("chain") & F.coalesce(F.col("before") == "BRAND", F.lit(False))))
        | ((F.col("kind") == "NICK") & (~F.col("chain") | F.coalesce(F.col("before") == "X", F.lit(True))))
    )
    t = t.withColumn("context", F.sum(opens.cast("int")).over(order))
    starts = F.col("breaks") | F.col("kind").isin("BRAND", "NICK") | ((F.col("kind") == "NUM") & ~F.col("chain"))
    t = t.withColumn("grp", F.sum(starts.cast("int")).over(order))
    inside = Window.partitionBy("key", "context").orderBy("pos")
    t = t.withColumn("head", F.first("kind").over(inside))
    brands = F.array_distinct(F.flatten(F.collect_list(F.when(F.col("kind") == "BRAND", F.array("brand")).when(F.col("kind") == "NICK", F.col("nick_brands"))).over(inside)))
    t = t.withColumns({"brands": brands, "live": F.col("head").isin("BRAND", "NICK")})
    own = Window.partitionBy("key", "grp").orderBy("pos")
    t = t.withColumn("typ", F.coalesce(F.max(F.col("token").isin("typ", "typy")).over(own), F.lit(False)))
    return t.withColumns({"group_kind": F.first("kind").over(own), "group_token": F.first("token").over(own), "licensed": (F.col("kind") == "NUM") & F.col("chain") & F.col("live")})


def _numbers(t: DataFrame, d: Dictionary) -> DataFrame:
    """Licensed numbers with what they mean: types (ids), families, displacement brands; decimals are left out."""
    types = d.types.groupBy(F.col("type").alias("token")).agg(F.collect_set(F.struct("id", "family")).alias("type_models"))
    sizes = d.displacements.groupBy(F.col("num").alias("token")).agg(F.collect_set("brand").alias("size_brands"))
    n = t.where("licensed").join(F.broadcast(types), "token", "left").join(F.broadcast(sizes), "token", "left")
    n = n.withColumn("sizes", F.array_intersect(F.coalesce("size_brands", F.array().cast("array<string>")), F.col("brands")))
    n = n.withColumn("valid", F.col("type_models").isNotNull() | (F.size("sizes") > 0))
    order = Window.partitionBy("key").orderBy("pos")
    decimal = ~F.col("valid") & F.coalesce((F.col("next_kind") == "NUM") & (F.col("next_sep") == ",") & (F.length("next_token") <= 2), F.lit(False))
    n = n.withColumn("decimal", decimal)
    fraction = F.coalesce(F.lag("decimal").over(order) & (F.lag("pos").over(order) == F.col("pos") - 1), F.lit(False)) & (F.col("sep") == ",")
    n = n.withColumn("fraction", fraction).where("not decimal and not fraction")
    n = n.withColumns({"before_pos": F.lag("pos").over(order), "before_token": F.lag("token").over(order), "before_sizes": F.lag("sizes").over(order), "nth": F.row_number().over(Window.partitionBy("key", "grp").orderBy("pos"))})
    n = n.withColumn("first_spaced", F.first("spaced").over(Window.partitionBy("key", "grp").orderBy("pos")))
    after_perak = (F.col("group_token") == "perak") & F.col("first_spaced")
    slashed = F.coalesce((F.col("sep") == "/") & (F.size("before_sizes") > 0), F.lit(False))
    all_perak = F.forall("type_models", lambda m: m["id"].startswith("perak-"))
    weak = F.col("type_models").isNotNull() & (F.length("token") <= 2) & F.forall("type_models", lambda m: m["family"] != "Jawa 50") & ~F.col("typ") & ~(all_perak & (after_perak | slashed))
    n = n.withColumn("weak", F.coalesce(weak, F.lit(False)))
    return n.withColumn("meaning", F.when(F.col("weak"), "none").when(F.col("type_models").isNotNull(), "type").when(F.size("sizes") > 0, "displacement").when(F.length("token") >= 3, "unresolved").otherwise("none"))


def parsed_models(names: DataFrame, dictionary: Dictionary, keep) -> DataFrame:
    """key, level, models (array of id, level, matched_text), generic (level, brand, displacement), unresolved (kind, brand, token).

    names: key (unique), shop_id, name.  keep: writes a table that executors can read and returns it.
    """
    d = dictionary
    t = keep(tokens(names, d))
    n = keep(_numbers(t, d))
    span = n.where("meaning = 'type'").select("key", "pos", "grp", F.concat_ws(" ", "group_token", "token").alias("text"), F.explode("type_models").alias("m"))
    by_type = span.select("key", F.col("m.id").alias("id"), "text")
    # ranges of types of one family
    ends = n.where("meaning = 'type' and before_token <> '180' and before_pos = pos - 1").where(F.col("sep").rlike(r"^\s*-\s*$"))
    first = d.types.groupBy(F.col("type").alias("before_token")).agg(F.min("family").alias("low_family"))
    ends = ends.join(F.broadcast(first), "before_token").where(F.exists("type_models", lambda m: m["family"] == F.col("low_family")))
    ranged = ends.select("key", F.col("low_family").alias("family"), F.col("before_token").cast("int").alias("lo"), F.col("token").cast("int").alias("hi"), F.concat_ws("-", "before_token", "token").alias("text")).where("lo < hi")
    numbered = d.types.where("not no_range").select("id", F.col("family").alias("f"), F.col("type").try_cast("int").alias("value"))
    between = ranged.join(F.broadcast(numbered), (F.col("family") == F.col("f")) & (F.col("value") > F.col("lo")) & (F.col("value") < F.col("hi"))).select("key", "id", "text")
    combo = n.where((F.col("token") == EXTRA[0]) & (F.col("next_token") == EXTRA[1]) & (F.col("next_sep") == "/")).select("key", F.lit(EXTRA[2]).alias("id"), F.lit("/".join(EXTRA[:2])).alias("text"))
    # displacements since the last letter before these letters
    lettered = t.where("letter and live and array_contains(brands, 'ČZ')").select("key", "grp", F.col("pos").alias("at"), F.upper("token").alias("letter"))
    blocks = Window.partitionBy("key", "grp").orderBy("at")
    # letters side by side are one block: where the letter before the block is
    before = F.coalesce(F.lag("at").over(blocks), F.lit(-1))
    lettered = lettered.withColumn("before", before).withColumn("since", F.last(F.when(F.col("before") != F.col("at") - 1, F.col("before")), True).over(blocks))
    sized = n.where("meaning = 'displacement'").select("key", "grp", "pos", F.col("token").alias("size"))
    by_letter = lettered.join(sized, ["key", "grp"]).where("pos < at and pos > since")
    of_letter = d.types.where("type in ('A', 'B', 'T', 'C')").join(d.models.select("id", "displacement"), "id").select("id", F.col("type").alias("letter"), F.col("displacement").cast("string").alias("size"))
    letter_hits = by_letter.join(F.broadcast(of_letter), ["letter", "size"]).select("key", "id", F.concat_ws(" ", "size", "letter").alias("text"))
    type_hits = by_type.unionByName(between).unionByName(combo).unionByName(letter_hits).select("key", "id", F.lit("type").alias("level"), "text")

    # groups: an anchor and the numbers chained to it
    sizes = F.collect_set(F.when(F.col("meaning") == "displacement", F.col("token")))
    ids = F.array_distinct(F.flatten(F.collect_list(F.when(F.col("meaning") == "type", F.transform("type_models", lambda m: m["id"])))))
    families = F.array_distinct(F.flatten(F.collect_list(F.when(F.col("meaning") == "type", F.transform("type_models", lambda m: m["family"])))))
    content = n.groupBy("key", "grp").agg(sizes.alias("sizes"), ids.alias("types"), families.alias("families"), F.first("first_spaced").alias("close"))
    heads = t.groupBy("key", "grp").agg(
        F.min_by(F.struct("kind", "token", "spaced", "context", "pos", "live", "prev_kind", "prev_token"), "pos").alias("h"), F.max_by(F.struct("kind", "letter", "licensed"), "pos").alias("z")
    )
    by_group = Window.partitionBy("key").orderBy("grp")
    g = heads.join(content, ["key", "grp"], "left").withColumns(
        {
            "before_sizes": F.lag("sizes").over(by_group),
            "before_types": F.lag("types").over(by_group),
            "before_end": F.lag("z").over(by_group),
            "next_head": F.lead("h").over(by_group),
        }
    )
    scoped = F.flatten(F.collect_list("sizes").over(Window.partitionBy("key", "h.context").orderBy("grp").rowsBetween(Window.unboundedPreceding, -1)))
    nicks = g.withColumn("scoped", scoped).where("h.kind = 'NICK'")
    none = F.array().cast("array<string>")
    joined = F.coalesce(F.col("h.spaced") & (F.col("before_end.licensed") | F.col("before_end.letter")), F.lit(False))
    loose = F.when(F.col("h.spaced") & (F.col("h.prev_kind") == "NUM") & ~F.coalesce(F.col("before_end.licensed"), F.lit(False)) & ~F.col("h.prev_token").startswith("0"), F.array("h.prev_token")).otherwise(none)
    nicks = nicks.select(
        "key",
        "grp",
        F.col("h.token").alias("nick"),
        F.array_distinct(F.concat(F.when(joined, F.coalesce("before_sizes", none)).otherwise(none), F.when(F.col("close"), F.coalesce("sizes", none)).otherwise(none))).alias("near"),
        loose.alias("loose"),
        F.when(joined, F.coalesce("before_types", none)).otherwise(none).alias("narrow"),
        F.coalesce("scoped", none).alias("scoped"),
        F.when(F.col("close"), F.coalesce("types", none)).otherwise(none).alias("types"),
        F.when(F.col("close"), F.coalesce("families", none)).otherwise(none).alias("families"),
        F.when((F.col("next_head.kind") == "NICK") & F.col("next_head.spaced"), F.col("next_head.token")).alias("next_nick"),
    )
    listed = d.aliases.groupBy(F.col("key").alias("nick")).agg(F.collect_list(F.struct("id", "brand", "family", F.col("displacement").cast("string").alias("size"), "own_displacement")).alias("all"))
    following = listed.select(F.col("nick").alias("next_nick"), F.transform("all", lambda m: m["id"]).alias("next_ids"))
    m = nicks.join(F.broadcast(listed), "nick").join(F.broadcast(following), "next_nick", "left")
    own = F.transform("all", lambda x: x["id"])
    small = F.forall("all", lambda x: x["family"] == "Jawa 50")
    suppressed = (F.size(F.array_intersect("types", own)) > 0) | (small & (F.size("families") > 0) & F.forall("families", lambda f: f == "Jawa 50"))
    specific = F.col("next_ids").isNotNull() & (F.size(F.array_except("next_ids", own)) == 0)
    adjacent = F.array_distinct(F.concat("near", F.filter("loose", lambda x: F.exists("all", lambda y: y["size"] == x))))
    m = m.where(~suppressed & ~F.coalesce(specific, F.lit(False))).withColumn("adjacent", adjacent)
    scooter = F.forall("all", lambda x: x["family"] == "Čezeta") & (F.size("adjacent") > 0)
    m = keep(m.withColumn("scooter", scooter))
    strict = F.size("adjacent") > 0
    wanted = F.when(strict, F.col("adjacent")).otherwise(F.col("scoped"))
    c = m.where("not scooter").withColumns({"strict": strict, "wanted": wanted})
    c = c.withColumn("chosen", F.filter("all", lambda x: x["size"].isNull() | F.array_contains("wanted", x["size"])))
    c = c.withColumn("chosen", F.when((F.size("wanted") > 0) & ((F.size("chosen") > 0) | F.col("strict")), F.col("chosen")).otherwise(F.col("all")))
    c = c.withColumn("narrowed", F.filter("chosen", lambda x: F.array_contains("narrow", x["id"])))
    c = c.withColumn("chosen", F.when(F.size("narrowed") > 0, F.col("narrowed")).otherwise(F.col("chosen")))
    c = c.withColumn("general", F.filter("chosen", lambda x: ~x["own_displacement"]))
    c = c.withColumn("chosen", F.when((F.size("wanted") == 0) & (F.size("general") > 0), F.col("general")).otherwise(F.col("chosen")))
    nick_hits = c.select("key", F.explode("chosen.id").alias("id"), F.lit("nickname").alias("level"), F.translate("nick", "_", " ").alias("text"))
    hits = type_hits.unionByName(nick_hits)
    best = hits.groupBy("key", "id").agg(F.max_by(F.struct("level", "text"), F.struct((F.col("level") == "type").cast("int"), "text")).alias("x"))
    models = best.groupBy("key").agg(F.array_sort(F.collect_list(F.struct("id", F.col("x.level").alias("level"), F.col("x.text").alias("matched_text")))).alias("models"))

    dropped = m.where("scooter").select("key", "grp")
    sizes_hit = n.where("meaning = 'displacement'").join(dropped, ["key", "grp"], "left_anti").select("key", F.explode("sizes").alias("brand"), F.col("token").cast("int").alias("displacement"), F.lit("displacement").alias("level"))
    none_size = F.lit(None).cast("int").alias("displacement")
    brand_hit = t.where("kind = 'BRAND'").select("key", "brand", none_size, F.lit("brand").alias("level")).unionByName(m.where("scooter").select("key", F.lit("ČZ").alias("brand"), none_size, F.lit("brand").alias("level")))
    generic = sizes_hit.unionByName(brand_hit).distinct().groupBy("key").agg(F.array_sort(F.collect_list(F.struct("level", "brand", "displacement"))).alias("generic"))
    label = F.array_join(F.when(F.col("live"), F.col("brands")).otherwise(none), "/")
    open_numbers = n.where("meaning = 'unresolved'").select("key", F.lit("number").alias("kind"), label.alias("brand"), "token")
    open_nicks = t.where(F.col("token").isin(UNRESOLVED)).select("key", F.lit("nickname").alias("kind"), label.alias("brand"), "token")
    unresolved = open_numbers.unionByName(open_nicks).groupBy("key").agg(F.array_sort(F.collect_list(F.struct("kind", "brand", "token"))).alias("unresolved"))
    full = names.select("key").join(models, "key", "left").join(generic, "key", "left").join(unresolved, "key", "left")
    has = lambda col, lev: F.exists(F.coalesce(F.col(col), F.array()), lambda x: x["level"] == lev)
    level = F.when(has("models", "type"), "type").when(has("models", "nickname"), "nickname").when(has("generic", "displacement"), "displacement").when(has("generic", "brand"), "brand")
    return full.select(
        "key",
        level.alias("level"),
        F.coalesce("models", F.array().cast("array<struct<id:string,level:string,matched_text:string>>")).alias("models"),
        F.coalesce("generic", F.array().cast("array<struct<level:string,brand:string,displacement:int>>")).alias("generic"),
        F.coalesce("unresolved", F.array().cast("array<struct<kind:string,brand:string,token:string>>")).alias("unresolved"),
    )


def without_models(t: DataFrame) -> DataFrame:
    """key and rest: the names' texts without brands, nicknames and the numbers and fillers chained to them.

    A piston's size behind them ("38,75 / 14,1") stays.
    """
    order = Window.partitionBy("key").orderBy("pos")
    size = F.col("token").rlike(r"^[3-9]\d$") & F.coalesce(F.col("next_sep").isin(",", ".") & F.col("next_token").rlike(r"^\d{2}$"), F.lit(False))
    t = t.withColumn("size_head", size).withColumn("size_tail", F.coalesce(F.lag("size_head").over(order), F.lit(False)))
    second = F.coalesce(F.lag("size_tail").over(order), F.lit(False)) & F.col("sep").rlike(r"^\s*/\s*$") & F.coalesce(F.col("next_sep").isin(",", "."), F.lit(False))
    t = t.withColumn("second_head", second).withColumn("second_tail", F.coalesce(F.lag("second_head").over(order), F.lit(False)))
    sized = F.col("size_head") | F.col("size_tail") | F.col("second_head") | F.col("second_tail")
    used = F.col("kind").isin("BRAND", "NICK") | F.col("licensed") | (F.col("letter") & F.col("live")) | (F.col("token").isin(FILLERS) & F.col("live") & F.col("chain") & F.coalesce(F.col("next_kind") == "NUM", F.lit(False)))
    used = used & ~((F.col("kind") == "NUM") & sized)
    piece = F.concat("sep", F.when(used, F.lit(" ")).otherwise(F.translate("token", "_", " ")))
    return t.groupBy("key").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", piece.alias("piece")))), lambda x: x["piece"]), "").alias("rest"))


def write_plan(products: DataFrame, parsed: DataFrame) -> DataFrame:
    """offer_id, level ('none' without one), links and fit_generic of offers that no name rule excludes.

    products: offer_id, key, name; parsed: by key.
    """
    from .grading import name_exclusion

    kept = products.where(name_exclusion(F.col("name")).isNull())
    fit = F.transform("generic", lambda g: F.struct(g["brand"].alias("brand"), g["displacement"].alias("displacement")))
    return kept.join(parsed, "key").select("offer_id", F.coalesce("level", F.lit("none")).alias("level"), F.transform("models", lambda x: F.struct(x["id"].alias("model_id"), x["level"].alias("match_level"))).alias("links"), F.array_distinct(fit).alias("fit_generic"))


def conflicts(parsed: DataFrame, models: DataFrame) -> DataFrame:
    """key and the sorted families of names whose models are of more than one."""
    each = parsed.select("key", F.explode("models.id").alias("id")).join(F.broadcast(models.select("id", "family")), "id")
    return each.groupBy("key").agg(F.array_sort(F.collect_set("family")).alias("families")).where(F.size("families") > 1)


def type_ranges(ranges: DataFrame, models: DataFrame) -> DataFrame:
    """Models of a family with a type strictly between two others: a range join on the small dimension.  ranges: family, lo, hi."""
    typed = models.where(~F.exists("aliases", lambda a: alias_key(a) == NO_RANGE)).select("id", F.col("family").alias("f"), F.explode("type_numbers").alias("type")).withColumn("value", F.col("type").try_cast("int"))
    return ranges.join(F.broadcast(typed), (F.col("family") == F.col("f")) & (F.col("value") > F.col("lo")) & (F.col("value") < F.col("hi"))).select("family", "lo", "hi", "id", "type")


def seed_dictionary(spark: SparkSession) -> Dictionary:
    from ..sources.seed import models

    return Dictionary.of(models(spark))
