"""Canonical parts from clusters of offers, and their idempotent materialisation."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import fnv1a, fold, number_set, slugify, strip_shop_markers, token_set
from .components import connected_components
from .linkage import ATTRIBUTES, fit_key
from .ranges import running_sums

#: Wishes of plans for parts that a task walks through at once, of one component.
TOGETHER = 500_000

WRITABLE = ("pending", "auto")
UNCATEGORISED = "Nezařazeno"
# The shop whose categories count, and categories that say nothing.
CATEGORY_SHOP = "motomax"
STOP_CATEGORIES = ["nove naskladneno", "akce", "vyprodej"]


def last_category(c: Column) -> Column:
    """The last level of "A > B > C"; null for empty ones and for those that are no category of parts."""
    last = F.trim(F.element_at(F.split(c, ">"), -1))
    return F.when((last != "") & ~fold(last).isin(STOP_CATEGORIES), last)


def clean_name(c: Column) -> Column:
    """The name without shop marks, or the name itself if nothing else is in it."""
    return F.coalesce(F.nullif(strip_shop_markers(c), F.lit("")), c)


def variant_map(row: Column) -> Column:
    """The attributes that a variant has, in a form that doesn't depend on spelling, as a map."""
    def text(k: str) -> Column:
        v = row[k].cast("string")
        if k == "dimension":
            return F.array_join(F.transform(number_set(v), lambda x: F.regexp_replace(x.cast("string"), r"\.0$", "")), ",")
        return F.array_join(token_set(v), " ") if k in ("ref", "code", "with") else v

    return F.map_from_entries(F.filter(F.array(*(F.struct(F.lit(k).alias("key"), text(k).alias("value")) for k in ATTRIBUTES)), lambda e: e["value"].isNotNull()))


def cluster_key(part_type: Column, variant: Column, models: Column, fits: Column) -> Column:
    """Type, variant as sorted k=v, then the models or else the generic fits, joined by pipes."""
    pairs = F.array_sort(F.transform(F.map_entries(variant), lambda e: F.concat(e["key"], F.lit("="), e["value"])))
    fit = F.when(F.size(models) > 0, F.array_join(models, ",")).otherwise(F.concat(F.lit("fit:"), F.array_join(fits, "+")))
    return F.concat_ws("|", part_type, F.array_join(pairs, ";"), fit)


def part_plans(members: DataFrame) -> DataFrame:
    """One row for each part to be made: key, name, slug, category, part_type, variant, models, fits, offers.

    members: items with cluster, category_text, match_status, model_level.  Only writable offers take part, two at least.  Models come from
    the offers that name a type, if there are any.  The code is no part of the variant unless every offer has one.
    """
    ok = members.where(F.coalesce("match_status", F.lit("pending")).isin(*WRITABLE))
    typed = F.col("model_level") == "type"
    flat = lambda c: F.array_sort(F.array_distinct(F.flatten(F.collect_list(c))))
    name = clean_name(F.col("name"))
    grouped = ok.groupBy("cluster").agg(
        F.count(F.lit(1)).alias("offers"),
        F.count("code").alias("coded"),
        flat(F.when(typed, F.col("model_ids"))).alias("typed_models"),
        F.count_if(typed).alias("typed"),
        flat("model_ids").alias("all_models"),
        F.array_sort(F.collect_set(fit_key(F.col("fit_generic")))).alias("fits"),
        F.min_by(F.struct("part_type", variant_map(F.struct(*ATTRIBUTES)).alias("variant")), F.struct("shop_id", "name", "id")).alias("first"),
        F.min(F.struct(F.length(name).alias("n"), name.alias("name"))).getField("name").alias("name"),
        F.array_sort(F.collect_list("id")).alias("offer_ids"),
    )
    votes = ok.where(F.col("shop_id") == CATEGORY_SHOP).select("cluster", last_category(F.col("category_text")).alias("category")).where("category is not null").groupBy("cluster", "category").agg(F.count(F.lit(1)).alias("n"))
    best = votes.groupBy("cluster").agg(F.min_by("category", F.struct(-F.col("n"), "category")).alias("category"))
    models = F.when(F.col("typed") > 0, F.col("typed_models")).otherwise(F.col("all_models"))
    uncoded = F.map_filter("first.variant", lambda k, v: k != "code")
    variant = F.when(F.col("coded") < F.col("offers"), uncoded).otherwise(F.col("first.variant"))
    planned = grouped.where("offers >= 2").join(best, "cluster", "left").withColumns({"models": models, "variant": variant, "part_type": F.col("first.part_type"), "category": F.coalesce("category", F.lit(UNCATEGORISED))})
    keyed = planned.withColumn("cluster_key", cluster_key(F.col("part_type"), F.col("variant"), F.col("models"), F.col("fits")))
    slug = F.concat(slugify(F.col("name")), F.lit("-"), fnv1a(F.col("cluster_key")))
    return keyed.select("cluster", "cluster_key", "part_type", "variant", "name", slug.alias("slug"), "category", "models", "fits", "offer_ids")


def stale_auto(offers: DataFrame, plans: DataFrame) -> DataFrame:
    """Offers assigned by an earlier run that are in no plan now; they stay as they are and are only counted."""
    planned = plans.select(F.explode("offer_ids").alias("offer_id"))
    return offers.where("match_status = 'auto' and part_id is not null").join(planned, "offer_id", "left_anti")


def _walked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The wishes that come true, of rows in order of component, plan and place: each plan's first whose part is still free."""
    component = settled = None
    taken: set[str] = set()
    for batch in batches:
        won = []
        for k, (c, plan, part) in enumerate(zip(*(batch.column(x).to_pylist() for x in ("component", "cluster_key", "part_id")), strict=True)):
            if c != component:
                component, settled, taken = c, None, set()
            if plan != settled and part not in taken:
                settled = plan
                taken.add(part)
                won.append(k)
        yield batch.take(pa.array(won, pa.int64()))


def claimed(wishes: DataFrame, keep: Callable[[DataFrame], DataFrame], together: int = TOGETHER) -> DataFrame:
    """cluster_key, part_id and via of each plan's first wish, by place, whose part no earlier plan, by cluster_key, has got.

    wishes: cluster_key, part_id, via and place.  Plans that share no part, not even through others, don't touch one another: a task
    walks through the plans of its components in order, and remembers the parts of one component at a time.  Before that, wishes go that
    can't come true: a part is gone, at the latest, with the first plan that wants it most.  So where many plans want few parts, what
    is walked grows with the parts.  A component of more than
    ``together`` wishes is cut into stretches of its walk, by running counts; the stretches of all such components are walked in turn, each
    without the plans and the parts of those before.
    """
    wishes = keep(wishes.select("cluster_key", "part_id", "via", "place"))
    most = wishes.groupBy("cluster_key").agg(F.min(F.struct("place", "part_id")).getField("part_id").alias("part_id"))
    gone = most.groupBy("part_id").agg(F.min("cluster_key").alias("last"))
    wishes = keep(wishes.join(gone, "part_id", "left").where("last is null or cluster_key <= last").drop("last"))
    plan, part = F.xxhash64(F.lit("plan"), F.col("cluster_key")), F.xxhash64(F.lit("part"), F.col("part_id"))
    # vertices of one hash put components together, which changes nothing but their size
    found = connected_components(wishes.select(plan.alias("a"), part.alias("b")), keep)
    rows = wishes.withColumn("vertex", plan).join(found, "vertex", "left").withColumn("component", F.coalesce("component", "vertex")).drop("vertex")
    rows = keep(rows)
    large = keep(rows.groupBy("component").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > together).select("component"))

    def walk(some: DataFrame) -> DataFrame:
        order = ["component", "cluster_key", "place", "part_id"]
        sorted_rows = some.select(*order, "via").repartition("component").sortWithinPartitions(*order)
        return keep(sorted_rows.mapInArrow(_walked, sorted_rows.schema).select("cluster_key", "part_id", "via"))

    done = walk(rows.join(large, "component", "left_anti"))
    if large.isEmpty():
        return done
    counted = running_sums(rows.join(large, "component", "left_semi"), "component", ["cluster_key", "place", "part_id"], F.lit(1), keep)
    cut = keep(counted.withColumn("stretch", F.floor((F.col("spent") - 1) / together)).drop("spent"))
    for stretch in range(cut.agg(F.max("stretch")).first()[0] + 1):
        left = cut.where(F.col("stretch") == stretch)
        for c in ("cluster_key", "part_id") if stretch else ():
            # of what is done, only what this stretch names
            left = left.join(done.join(left.select(c).distinct(), c, "left_semi").select(c), c, "left_anti")
        done = done.unionByName(walk(left))
    return done


def resolved(plans: DataFrame, offers: DataFrame, existing: DataFrame, keep: Callable[[DataFrame], DataFrame], together: int = TOGETHER) -> DataFrame:
    """cluster_key, part_id, via (part_id or cluster_key), source and key_conflict of the plans that have a part already.

    A plan takes the part that most of its offers are in, of those that no plan before it (by key) took, else the part with its key.
    keep: writes a table that executors can read and returns it.
    """
    of = offers.where("part_id is not null").select("offer_id", "part_id").join(existing.select(F.col("id").alias("part_id")), "part_id", "left_semi")
    votes = plans.select("cluster_key", F.explode("offer_ids").alias("offer_id")).join(of, "offer_id").groupBy("cluster_key", "part_id").agg(F.count(F.lit(1)).alias("votes"))
    by_key = plans.select("cluster_key").join(existing.where("cluster_key is not null").select("cluster_key", F.col("id").alias("part_id")), "cluster_key").withColumn("votes", F.lit(0).cast("long"))
    wish = votes.withColumn("via", F.lit("part_id")).unionByName(by_key.withColumn("via", F.lit("cluster_key")))
    place = F.row_number().over(Window.partitionBy("cluster_key").orderBy((F.col("via") == "cluster_key").cast("int"), F.desc("votes"), "part_id"))
    done = claimed(wish.withColumn("place", place).drop("votes"), keep, together)
    owners = existing.where("cluster_key is not null").select("cluster_key", F.col("id").alias("owner"))
    source = existing.select(F.col("id").alias("part_id"), "source")
    return done.join(owners, "cluster_key", "left").join(source, "part_id").select("cluster_key", "part_id", "via", "source", F.coalesce(F.col("owner") != F.col("part_id"), F.lit(False)).alias("key_conflict"))


def applied(plans: DataFrame, offers: DataFrame, existing: DataFrame, part_models: DataFrame, keep) -> dict[str, DataFrame]:
    """The tables after a run: parts, part_models, offers, and actions (what was done to each plan's part).

    A second run on its own results changes nothing.  Parts of source manual and their offers are left alone; a new part's id is made
    from its key; a part keeps its slug, visibility and source, and also its key if another part has the plan's one.
    """
    found = resolved(plans, offers, existing, keep)
    full = plans.join(found, "cluster_key", "left")
    action = F.when(F.col("part_id").isNull(), "insert").when(F.col("source") == "manual", "skip").otherwise("update")
    full = keep(full.withColumns({"action": action, "target": F.coalesce("part_id", F.concat(F.lit("auto-"), F.sha2("cluster_key", 256).substr(1, 16)))}))
    live = full.where("action <> 'skip'")
    new = live.select(F.col("target").alias("id"), F.col("cluster_key").alias("__key"), F.col("name").alias("__name"), F.col("slug").alias("__slug"), F.col("category").alias("__category"), F.col("part_type").alias("__type"), F.coalesce("key_conflict", F.lit(False)).alias("__conflict"))
    both = existing.join(new, "id", "full")
    fresh = F.col("source").isNull()
    parts = both.select(
        "id",
        F.when(F.col("__key").isNull() | F.col("__conflict"), F.col("cluster_key")).otherwise(F.col("__key")).alias("cluster_key"),
        F.coalesce("__name", "name").alias("name"),
        F.when(fresh, F.col("__slug")).otherwise(F.col("slug")).alias("slug"),
        F.coalesce("__category", "category").alias("category"),
        F.coalesce("__type", "part_type").alias("part_type"),
        F.when(fresh, F.lit(False)).otherwise(F.col("is_public")).alias("is_public"),
        F.coalesce("source", F.lit("auto")).alias("source"),
    )
    wanted = live.select(F.col("target").alias("part_id"), F.explode("models").alias("model_id")).distinct()
    models = part_models.join(live.select(F.col("target").alias("part_id")), "part_id", "left_anti").unionByName(wanted)
    mine = live.select(F.col("target").alias("__part"), F.explode("offer_ids").alias("offer_id"))
    joined = offers.join(mine, "offer_id", "left")
    take = F.col("__part").isNotNull() & F.coalesce("match_status", F.lit("pending")).isin(*WRITABLE)
    changed = joined.withColumns({"part_id": F.when(take, F.col("__part")).otherwise(F.col("part_id")), "match_status": F.when(take, "auto").otherwise(F.col("match_status"))}).select(*offers.columns)
    return {"parts": parts, "part_models": models, "offers": changed, "actions": full.select("cluster_key", "action", F.col("target").alias("part_id"), "via", "key_conflict")}
