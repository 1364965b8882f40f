"""Part type, variant and quality tags in free-text offer names, as column expressions.

The text without vehicle models (``model_names``) goes through ``EXTRACTION``, a table of rules in order of precedence; one fold applies them, so that
each rule sees what those before it have left.
What is left are words, which word classes sort into side, position, finish and the like; the stems of the others are the part type.
Every step is a projection, so a whole parse is one stage without Python.
"""

from __future__ import annotations

from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import fold, stem
from .model_names import Dictionary, tokens, without_models

# Fixed values of the grammar: word lists and patterns.
VEHICLES = (
    "jawa cz babetta babeta simson pionyr perak kyvacka panelka stadion jawetta mustang stella pares ogar bizon calif libenak velorex cezeta skutr "
    "roadster cross trail ohc sport parez dvoupaka jikov mz tatran manet betka korado star pav dkw"
).split()
STOP_WORDS = (
    "a i s se pro na do od z ze v k ke o u po pod bez vc vcetne apod typ typy cislo cisla model cena tmave svetle ks mm ml cm m x ii pl kc hz ccm kg ah cl km ba pvc za"
).split()
REF_BRANDS = "jikov dellorto domino pal bosch vape".split()
PLAIN_BRANDS = "zvl almet mitroc hiflofiltro skf koyo ngk brisk tesla ntn ybn ckr elta fortune mitas rubena mototechna duells".split()
LEFT = r"^(?:l|lev(?:y|a|e|ou|eho|ych)|levostran\w*)$"
RIGHT = r"^(?:p|prav(?:y|a|e|ou|eho|ych)|pravostran\w*)$"
POSITIONS = [("^(?:predn|prd$)", "front"), ("^(?:zadn|zad$)", "rear"), ("^bocn", "side"), ("^horn", "upper"), ("^doln", "lower"), ("^vnitrn", "inner"), ("^venkovn", "outer")]
FINISHES = [
    ("^chrom", "chrome"),
    ("^(?:zinek|zinkovan|pozinkovan|zn)$|^(?:zinkovan|pozinkovan)", "zinc"),
    ("^nerez", "stainless"),
    ("^nikl", "nickel"),
    ("^lesten", "polished"),
    (r"^(?:lak|lakovan\w*)$", "painted"),
    ("^surov", "raw"),
    ("^eloxovan", "anodized"),
    ("^cernen", "blackened"),
]
COLORS = [
    ("cern", "black"), ("bezov", "beige"), ("rud", "red"), ("tyrkys", "turquoise"), ("sed", "grey"), ("bil", "white"), ("cerven", "red"), ("modr", "blue"),
    ("zelen", "green"), ("zlut", "yellow"), ("hned", "brown"), ("oranzov", "orange"), ("stribrn", "silver"), ("zlat", "gold"), ("ruzov", "pink"), ("fialov", "purple"),
]
COLOR_ENDINGS = "(?:y|a|e|ou|ych|eho|ym)$"
MATERIALS = [
    (r"^(?:alu|aluminium|aluminiovy|hlinik\w*|slitin\w*)$", "aluminium"), (r"^plast\w*$", "plastic"), (r"^bronz\w*$", "bronze"), (r"^(?:guma|gumov\w*)$", "rubber"),
    (r"^ocel\w*$", "steel"), (r"^(?:kuze|kozen\w*)$", "leather"), (r"^mosaz\w*$", "brass"), (r"^bakelit\w*$", "bakelite"), (r"^carbon$", "carbon"),
    (r"^laminat\w*$", "laminate"), (r"^textil\w*$", "textile"),
]
SIZES = [("^velk(?:y|a|e|ou|ych)$", "large"), ("^mal(?:y|a|e|ou|ych)$", "small"), ("^dlouh(?:y|a|e|ou|ych)$", "long"), ("^kratk(?:y|a|e|ou|ych)$", "short")]
ORIGINS = {
    "cz": "origin-cz", "cr": "origin-cz", "sk": "origin-sk", "tw": "origin-tw", "twn": "origin-tw", "it": "origin-it", "ind": "origin-in", "indie": "origin-in",
    "tur": "origin-tr", "tr": "origin-tr", "cina": "origin-cn", "cn": "origin-cn",
}
TAGS = [
    ("^(?:original|orig|org)$", "original"), ("^nahrada$", "replacement"), ("^(?:repasovan|renovovan|regenerovan)", "refurbished"), ("^(?:novy|nova|nove)$", "new"),
    (r"^dovoz\w*$", "import"), (r"^(?:jakost|kvalitn\w*)$", "quality"), ("^top$", "top"), ("^zesilen", "reinforced"), ("^(?:cr|cesk[yae]|ceska)$", "origin-cz"),
    ("^(?:sk|slovensk[yae]|slovenska)$", "origin-sk"), ("^(?:indie|ind)$", "origin-in"), ("^(?:twn|tw|tajwan|taiwan)$", "origin-tw"),
]
NUM = r"\d+(?:[.,]\d+)?"
NB = r"(?<![a-z\d])"
NE = r"(?![a-z\d])"
#: Units: what follows the number, the number itself, and how the unit is written in a dimension.
UNITS = [
    (rf"\s*w{NE}", NUM, "w"), (rf"\s*km/h{NE}", NUM, "kmh"), (rf"\s*hz{NE}", NUM, "hz"), (rf"\s*ccm{NE}", NUM, "ccm"), (rf"\s*kc{NE}", NUM, "kc"), (rf"\s*pl{NE}\.?", r"\d+", "pl"),
    (rf"\s*cl{NE}\.?", r"\d+", "cl"), (rf"\s*ah{NE}", NUM, "ah"), (rf"\s*kg{NE}", NUM, "kg"), (rf"\s*ml{NE}", NUM, "ml"), (rf"\s*l{NE}", r"\d{1,2}(?:[.,]\d+)?", "l"),
    (rf"\s*mm2{NE}", NUM, "mm2"), (rf"a{NE}", NUM, "a"), (r"\s*clank\w*", r"\d+", "cl"),
]
#: Shapes of dimensions that are taken as they are written, in order: of bearings white space becomes a hyphen, of diameters and lengths signs go.
SHAPES = [
    (rf"{NB}\d+/\d+\s*[x×]\s*(?:\d+/\d+|{NUM})", "close"),
    (rf"{NB}m\d+(?:[.,]\d+)?(?:\s*[x×]\s*{NUM}){{1,2}}(?:\s*mm)?", "close"),
    (rf"{NB}m\d+(?:[.,]\d+)?-\d+{NE}", "close"),
    (rf"{NB}m\d{{1,2}}(?:[.,]\d+)?(?:\s*mm)?{NE}", "close"),
    (rf"{NB}[dl]\s*[=-]\s*{NUM}(?:\s*mm)?{NE}", "bare"),
    (rf'{NUM}\s*["”″]?\s*[x×]\s*{NUM}\s*["”″]?(?:\s*[x×]\s*{NUM})?(?:\s*mm)?', "close"),
    (rf"{NB}\d[.,]\d{{2}}\s*-\s*\d{{2}}{NE}", "close"),
    (rf'{NB}{NUM}\s*["”″]', "close"),
    (rf"(?:ø\s*)?{NB}{NUM}\s*mm{NE}", "close"),
    (rf"{NB}(?:6\d{{3}}(?:\s*(?:2rs|rs|zz|2z))?|\d{{4}}\s*(?:2rs|rs|zz|2z)){NE}", "hyphen"),
    (rf"{NB}\d+[.,]\d+\s*/\s*\d+[.,]\d+{NE}", "close"),
    (rf"{NB}\d+[.,]\d{{2}}{NE}", "close"),
]
SOCKETS = rf"{NB}(?:(?:bay?|bax)\d{{1,2}}[a-z]?{NE}|p\d{{2}}[st]{NE}|e\d{{2}}{NE}|h\d(?![a-z\d-]))"
JET = rf"{NB}m\d+(?:[.,]\d+)?(?:\s*[x×]\s*{NUM}){{1,2}}(?:\s*mm)?(?:\s*-\s*\d{{2,3}}(?![a-z\d.,]))?"
CHAIN = rf"{NB}s?(?:41\d|42\d|52\d|53\d)[hs]?{NE}"
CODE = r"[a-z0-9]+(?:[-.][a-z0-9]+)*"
#: Marks in the whole name: after a star, after two commas, and a grade in quotes at its end.
STAR_MARK = r"\*([^\s*,;()/]*)"
COMMA_MARK = r',,([^\s,"”″]*)'
GRADE_MARK = r'\s"([a-z0-9]{1,3})\s*$'
E_MARK = r"(?:^|\s)-e-(?=\s|$)"
#: What is written apart though it belongs to the number behind it.
SERIES = r"(?<![a-z])(phbg|sha)\s+(?=\d)"
NOT_A_CODE = (
    r"^(?:(?:cena|za)?\d{1,3}(?:\.\d{1,2})?(?:a|m|cm|mm|t|d|l|ml|kg|hr|klic|kus|typ|kont|valec|rychl)|\d{1,3}g|\d+x[a-z]*|\d+\.[a-z]+|a\d|[dl]\d+(?:mm)?|m\d{3}|mz\d+|"
    r"s(?:11|22|23)|sv\d|bab?-?\d{3}|\d+-[a-z]+)$"
)
WITH = rf"{NB}(?:s|se|vc|vcetne|bez)[. ]\s*(?:(?:jedn\w*|dv\w*|tri|tremi|ctyr\w*)\s+){{0,2}}[a-z]{{3,}}"

VARIANT = ["dimension", "voltage", "side", "position", "finish", "color", "material", "teeth", "pack", "size", "ref", "with", "version", "note", "code"]


class Rule(NamedTuple):
    """All matches of a pattern leave the text; a group of each, tidied and with its unit, joins a field."""

    field: str
    pattern: str
    group: int = 0
    tidy: str = ""
    unit: str = ""
    beside: str = ""  # only in texts that also hold this
    first: bool = False  # only while the field is empty


#: Replacements of each way to tidy, in order.
TIDY = {
    "": [],
    "close": [(",", "."), ("×", "x"), ("[”″]", '"'), (r"\s+", ""), ("^ø", "")],
    "bare": [(",", "."), (r"[\s=-]+", "")],
    "hyphen": [(r"\s+", "-")],
}
EXTRACTION = [
    Rule("version", r"(?<![\d.,])(\d)\s*\.?\s*typ(?![a-z])", 1),
    Rule("untreated", r"bez povrchove upravy"),
    Rule("both", rf"{NB}[lp]\s*[+/]\s*[lp]{NE}"),
    Rule("volts", rf"{NB}({NUM})\s*v{NE}", 1, "close", "v"),
    *(Rule("dims", rf"{NB}({number}){tail}", 1, "close", unit) for tail, number, unit in UNITS),
    Rule("dims", SOCKETS),
    Rule("teeth", rf"{NB}(\d+)\s*(?:z{NE}|zubu)\.?", 1),
    Rule("pieces", rf"(?<!\d)(\d+)\s*(?:ks|kus\w*){NE}", 1, "", "ks"),
    Rule("pieces", rf"{NB}kus{NE}", first=True),
    Rule("dims", CHAIN, beside=r"(?<![a-z])(?:retez\w*|spon\w*)"),
    Rule("dims", JET, tidy="close", beside=r"(?<![a-z])trys\w*"),
    *(Rule("dims", shape, tidy=tidy) for shape, tidy in SHAPES),
]


def _first_of(word: Column, table: list[tuple[str, str]]) -> Column:
    """The value of the first pattern that the word matches, or null."""
    found = F.lit(None).cast("string")
    for pattern, value in reversed(table):
        found = F.when(word.rlike(pattern), value).otherwise(found)
    return found


_COLOR_TABLE = [("^cerno$", "black"), *((f"^{s}{COLOR_ENDINGS}", c) for s, c in COLORS)]


def _variant_word(w: Column) -> Column:
    known = w.isin(["l", "p", "sada", "sady", "set", "standard", "motomax", *REF_BRANDS, *PLAIN_BRANDS]) | w.rlike(LEFT) | w.rlike(RIGHT) | w.rlike(r"^(?:kompletni|upl\w*)$")
    for table in (_COLOR_TABLE, SIZES, POSITIONS, FINISHES, TAGS):
        known = known | w.rlike("|".join(f"(?:{p})" for p, _ in table))
    return known


def _tidied(c: Column, way: str) -> Column:
    return reduce(lambda x, change: F.regexp_replace(x, *change), TIDY[way], c)


def _sorted_text(c: Column, sep: str) -> Column:
    return F.when(F.size(c) > 0, F.array_join(F.array_sort(F.array_distinct(c)), sep))


def parsed_offers(names: DataFrame, dictionary: Dictionary, keep) -> DataFrame:
    """key, part_type, variant (a struct of VARIANT, all strings but teeth) and quality_tags.

    names: key (unique), shop_id, name.  keep: writes a table that executors can read and returns it.
    """
    # the model parser blanks all quotes but this one
    inches = names.withColumn("name", F.regexp_replace("name", r'(?<=\d)\s*["”″]', "″"))
    rest = without_models(tokens(inches, dictionary).transform(keep)).withColumn("rest", F.regexp_replace("rest", r"¦", " "))
    return keep(names.join(rest, "key", "left").transform(_parsed))


def _applied(df: DataFrame, rule: Rule) -> DataFrame:
    """One step of the fold over the rules: df with the rule's matches moved from ``text`` to its field."""
    none = F.array().cast("array<string>")
    found = F.transform(F.regexp_extract_all("text", F.lit(rule.pattern), rule.group), lambda x: F.concat(_tidied(x, rule.tidy), F.lit(rule.unit)))
    left = F.regexp_replace("text", rule.pattern, " ")
    limits = [F.col("text").rlike(rule.beside)] * bool(rule.beside) + [F.size(rule.field) == 0] * rule.first
    for holds in limits:
        found, left = F.when(holds, found).otherwise(none), F.when(holds, left).otherwise(F.col("text"))
    return df.withColumns({rule.field: F.concat(rule.field, found), "text": left})


def _marked(named: DataFrame) -> DataFrame:
    """The folded name, the marks in it, and the text to extract from with empty fields."""
    plain = lambda c: F.filter(F.transform(c, lambda x: F.regexp_replace(x, "[^a-z0-9]", "")), lambda x: x != "")
    df = named.withColumn("raw", F.translate(fold(F.col("name")), "„“'", "   "))
    every = lambda pattern: F.regexp_extract_all("raw", F.lit(pattern), 1)
    marks = {"stars": plain(every(STAR_MARK)), "commas": plain(every(COMMA_MARK)), "grade": F.get(every(GRADE_MARK), F.lit(0)), "emark": F.col("raw").rlike(E_MARK)}
    text = F.regexp_replace(F.regexp_replace(F.coalesce("rest", F.lit("")), E_MARK, " "), SERIES, "$1")
    return df.withColumns({**marks, "text": text, **{r.field: F.array().cast("array<string>") for r in EXTRACTION}})


def _parsed(named: DataFrame) -> DataFrame:
    df = reduce(_applied, EXTRACTION, _marked(named))
    usable = lambda x: x.rlike(r"\d") & (x.rlike("[a-z]") | x.rlike(r"^\d{4,}$")) & ~x.rlike(NOT_A_CODE)
    df = df.withColumn("codes", F.transform(F.filter(F.regexp_extract_all("text", F.lit(CODE), 0), usable), lambda x: F.regexp_replace(x, r"\.", "")))

    # what comes with the part or without it
    found = F.regexp_extract_all("text", F.lit(WITH), 0)
    noun = lambda x: F.element_at(F.split(x, r"[^a-z]+"), -1)
    plain = lambda x: ~noun(x).isin([*STOP_WORDS, *VEHICLES, *REF_BRANDS, *PLAIN_BRANDS])
    df = df.withColumn("with_found", F.filter(found, plain))
    preposition = lambda x: F.when(x.startswith("bez"), "bez:").otherwise("s:")
    df = df.withColumn("with_tokens", F.transform("with_found", lambda x: F.concat(preposition(x), stem(noun(x)))))
    df = df.withColumn("text", F.aggregate("with_found", F.col("text"), lambda t, x: F.replace(t, x, F.lit(" , "))))

    word_list = lambda c: F.filter(F.regexp_extract_all(c, F.lit("[a-z0-9]+"), 0), lambda x: ~x.rlike(r"\d"))
    trailing = F.col("text").rlike(rf"(?:\s[-–—]\s).*{NB}(?:sada|sady|set){NE}|\([^)]*{NB}(?:sada|sady|set){NE}")
    in_parens = F.array_join(F.regexp_extract_all("text", F.lit(r"\(([^)]*)"), 1), " , ")
    df = df.withColumns({"outer": word_list(F.regexp_replace("text", r"\([^)]*\)?", " ")), "inner": word_list(in_parens), "trailing": trailing})
    material = lambda w: _first_of(w, MATERIALS)
    state = F.struct(F.lit(True).alias("tail"), F.array().cast("array<string>").alias("words"))

    def step(s: Column, w: Column) -> Column:
        skipped = (F.length(w) < 2) | w.isin([*STOP_WORDS, *VEHICLES])
        is_material = material(w).isNotNull()
        return (
            F.when(skipped, s)
            .when(s["tail"] & is_material, F.struct(s["tail"].alias("tail"), F.concat(s["words"], F.array(w)).alias("words")))
            .otherwise(F.struct((s["tail"] & _variant_word(w)).alias("tail"), s["words"].alias("words")))
        )

    df = df.withColumn("tail_materials", F.aggregate(F.reverse("outer"), state, step)["words"])
    df = df.withColumn("material_words", F.concat("tail_materials", F.filter("inner", lambda w: material(w).isNotNull())))
    set_word = lambda w: w.isin("sada", "sady", "set")
    df = df.withColumn("all_words", F.concat("outer", "inner"))
    open_word = lambda w: ~(_variant_word(w) & ~set_word(w)) & ~(set_word(w) & F.col("trailing")) & ~F.array_contains("material_words", w)
    usable_word = lambda w: (F.length(w) >= 2) & ~w.isin([*STOP_WORDS, *VEHICLES]) & open_word(w)
    of = lambda table: F.array_compact(F.transform("all_words", lambda w: _first_of(w, table)))
    df = df.withColumns(
        {
            "left": F.exists("all_words", lambda w: w.rlike(LEFT)),
            "right": F.exists("all_words", lambda w: w.rlike(RIGHT)),
            "positions": of(POSITIONS),
            "finishes": of([(p, v) for p, v in FINISHES]),
            "colors": of(_COLOR_TABLE),
            "sizes": of(SIZES),
            "tags": of(TAGS),
            "type_words": F.transform(F.filter("outer", usable_word), stem),
            "note_words": F.concat(F.filter("inner", usable_word), F.filter("all_words", lambda w: w == "standard")),
            "complete": F.exists("all_words", lambda w: w.rlike(r"^(?:kompletni|upl\w*)$")),
        }
    )
    brand_words = F.concat("stars", F.filter("commas", lambda x: x.isin([*REF_BRANDS, *PLAIN_BRANDS])), F.filter("all_words", lambda x: x.isin([*REF_BRANDS, *PLAIN_BRANDS])))
    refs = F.filter(brand_words, lambda x: x.isin(REF_BRANDS))
    makers = F.transform(
        F.filter(brand_words, lambda x: ~x.isin(REF_BRANDS)), lambda x: F.when(x == "m", "mfr:motomax").when(x.startswith("origi"), "original").otherwise(F.concat(F.lit("mfr:"), x))
    )
    maker_word = F.when(F.exists("all_words", lambda w: w == "motomax"), F.array(F.lit("mfr:motomax"))).otherwise(F.array().cast("array<string>"))
    origin = F.create_map(*(F.lit(x) for kv in ORIGINS.items() for x in kv))
    origins = F.array_compact(F.transform("commas", lambda x: origin[x]))
    extra = F.array_compact(F.array(F.concat(F.lit("grade:"), "grade"), F.when(F.col("emark"), F.lit("e-mark"))))
    side = F.when((F.size("both") > 0) | (F.col("left") & F.col("right")), "both").when(F.col("left"), "left").when(F.col("right"), "right")
    position = F.array_join(F.filter(F.array(*(F.when(F.array_contains("positions", v), v) for _, v in POSITIONS)), lambda x: x.isNotNull()), "+")
    pack = F.coalesce(F.when(F.get("pieces", F.lit(0)) == "kus", "1ks").otherwise(F.get("pieces", F.lit(0))), F.when(F.col("trailing"), "sada"), F.when(F.col("complete"), "complete"))
    dims = F.array_distinct("dims")
    variant = {
        "dimension": F.nullif(F.array_join(dims, " "), F.lit("")),
        "voltage": F.get("volts", F.lit(0)),
        "side": side,
        "position": F.nullif(position, F.lit("")),
        "finish": F.coalesce(F.when(F.size("untreated") > 0, "raw"), F.get("finishes", F.lit(0))),
        "color": _sorted_text(F.col("colors"), "+"),
        "material": _sorted_text(F.transform("material_words", material), "+"),
        "teeth": F.get("teeth", F.lit(0)).try_cast("int"),
        "pack": pack,
        "size": F.get("sizes", F.lit(0)),
        "ref": _sorted_text(refs, " "),
        "with": _sorted_text(F.col("with_tokens"), " "),
        "version": F.get("version", F.lit(0)),
        "note": F.nullif(F.array_join(F.array_distinct("note_words"), " "), F.lit("")),
        "code": _sorted_text(F.col("codes"), " "),
    }
    return df.select(
        "key",
        F.array_join(F.array_sort(F.array_distinct("type_words")), " ").alias("part_type"),
        F.struct(*(v.alias(k) for k, v in variant.items())).alias("variant"),
        F.array_sort(F.array_distinct(F.concat("tags", makers, maker_word, origins, extra))).alias("quality_tags"),
    )


def linkage_items(offers: DataFrame, offers_parsed: DataFrame, models_parsed: DataFrame) -> DataFrame:
    """Items for ``linkage``: offers (offer_id, key, shop_id, name, price) with what their names say."""
    fit = F.array_distinct(F.transform("generic", lambda g: F.struct(g["brand"].alias("brand"), g["displacement"].alias("displacement"))))
    joined = offers.join(offers_parsed, "key").join(models_parsed, "key")
    variant = [F.col(f"variant.{k}").cast("string").alias(k) for k in VARIANT]
    rest = [c for c in offers.columns if c not in ("offer_id", "key", "shop_id", "name", "price", "part_type", "note", "code", "size")]
    return joined.select(F.col("offer_id").alias("id"), "shop_id", "name", "price", "part_type", F.col("models.id").alias("model_ids"), fit.alias("fit_generic"), F.col("level").alias("model_level"), *variant, *rest)
