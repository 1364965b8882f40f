"""Similarity self-join on word shingles by parity sketches in size bands.

The sketch of a set toggles (XOR) one bit for each shingle hash; folded to a power of two of bits, its Hamming distance to
another sketch is at most the symmetric difference of the sets.  Bits are ordered by rarity, so that a sketch begins with what few
others have.  By the pigeonhole principle two sets whose intersection is 75 % of their union have one of their first
``n - ceil(0.75 n) + 1`` bits in common, and at the first bit they share each still has enough bits left for the whole overlap: a
set of n bits of which r are left meets sets of at most ``r * 175 / 75 - n`` bits there.  Sketches are joined on those bits, within a size
band where a bit is frequent: a band's sets meet each other and those of the band above, whose sizes may still fit.

Equal sets are one node from the start, whatever the number of copies.  Of each group (bit and band) every node is first compared with
the one whose sketch begins there (hub).  Where a group is then still in several components, its nodes outside the largest one are
compared with all nodes of other components that the bounds above allow, under the sketches' distance inside the join, so that pairs too far
apart never become rows.  What is left is verified on the whole texts.  No pair is skipped for any other reason, so no link is lost.

The chunks of the pigeonhole are single bits.  Equal-width chunks of several bits would ask for some 0.7 n keys for each document
instead of 0.25 n (two size bands, and spare chunks for those empty in both), and a passage that many documents share would put
them all into the same chunks; ordered by rarity it is at the sketches' end, where the bound on r excludes it.

Hashes have 61 bits or more; pairs are verified with hashes of their own, independent of those that found them.

Cases with a defined result: null, empty and blank texts have no shingles, are linked with nothing and are their own component;
with fewer words than a shingle the whole sequence is one shingle; each row is a document, so a repeated id is in
the component of each of its rows; a null id gets the least id of what it is linked with; an empty table gives an empty result;
further columns are ignored by ``components`` and kept by ``keep_one_of_each``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.components import connected_components
from . import _text as X
from ._store import discard, small_batches, written

WORDS = 5
PERCENT = 75
#: Most bits of a folded sketch; a set of n shingles has the least power of two from 2 n.
FOLD = 1 << 16
#: Words of 64 bits of the sketch that is compared inside a join.
NARROW = 4
#: A frequent bit's rows are dealt to so many tasks.
SALTS = 64
#: Nodes are compared with further hubs while all pairs of open groups are more than so many for each row; only speed depends on it.
PAIRS = 32
#: So many of the most frequent shingles are put last in the order of bits; only speed depends on it.
FREQUENT = 1 << 18
#: Pairs, up to which the ids of their documents (two of 20 bytes each) are broadcast to the texts; beyond that the texts are shuffled.
BROADCAST_PAIRS = 300_000
_BUFFER = 2_000_000
_NO_BAND = -1


def _sets(c: X.Chunk, words: int, seed: int = 0) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text of the chunk."""
    buf = X.LOWER[c.buf]
    s, e, first = X.word_bounds(buf, c.offs)
    sums = X.item_sums(X.bytes_hash(buf, s, e, seed))
    at = np.arange(max(len(s) - words + 1, 0))
    grams = X.span_hash(sums, at, at + words)
    out = []
    for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        if b - a >= words:
            g = np.sort(grams[a : b - words + 1])
            out.append(g[np.concatenate(([True], g[1:] != g[:-1]))])
        elif b > a:
            out.append(X.span_hash(sums, np.array([a]), np.array([b])))
        else:
            out.append(grams[:0])
    return out


def _node(u: np.ndarray) -> np.int64:
    """Identity of a set."""
    return X.mix(np.array([X.mix(u ^ X.U(0xA5A5A5A5A5A5A5A5)).sum(dtype=X.U) + X.U(len(u))], X.U)).view(np.int64)[0]


def _fold(u: np.ndarray) -> np.ndarray:
    """The sketch, folded by XOR to a power of two of bits; the sketch folded once more is that of half the bits."""
    size = min(max(64, 1 << int(2 * len(u) - 1).bit_length()), FOLD) if len(u) else 64
    bits = (np.bincount((u & X.U(size - 1)).astype(np.int64), minlength=size) & 1).astype(np.uint8)
    return np.packbits(bits, bitorder="little").view(np.int64)


def _sketch_mapper(words: int):
    """A row for each document (node, n, folded sketch), and rows (bit, n) for the bits that a task meets repeatedly."""
    names = ["doc_id", "tag", "node", "n", "fold", "bit"]

    def repeated(sets: list[np.ndarray]) -> pa.RecordBatch:
        bit, n = np.unique(np.concatenate(sets), return_counts=True)
        bit, n = bit[n > 2], n[n > 2]
        none = pa.nulls(len(bit), pa.int64())
        return pa.RecordBatch.from_arrays([none, pa.nulls(len(bit), pa.int32()), none, pa.array(n.astype(np.int32)), pa.nulls(len(bit), pa.list_(pa.int64())), pa.array(bit.view(np.int64))], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, seen = [], 0, set()
        for b in batches:
            for c in X.chunks(b.column(2)):
                sets = _sets(c, words)
                n = np.array([len(u) for u in sets], np.int32)
                none = n == 0
                node = np.array([_node(u) for u in sets], np.int64)
                fold = [_fold(u) for u in sets]
                cut = np.concatenate(([0], np.cumsum([len(f) for f in fold]))).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [
                        b.column(0)[c.lo : c.hi],
                        b.column(1)[c.lo : c.hi],
                        pa.array(node, mask=none),
                        pa.array(n),
                        pa.ListArray.from_arrays(pa.array(cut), pa.array(np.concatenate(fold))),
                        pa.nulls(len(c), pa.int64()),
                    ],
                    names,
                )
                for u, k in zip(sets, node.tolist(), strict=True):
                    if k not in seen and len(u):
                        seen.add(k)
                        held.append(u)
                        size += len(u)
                if size > _BUFFER:
                    yield repeated(held)
                    held, size, seen = [], 0, set()
        if held:
            yield repeated(held)

    return run


def _edges(percent: int, most: int) -> np.ndarray:
    """The least size of each band: whatever fits a size of a band is in the same band or in the one below or above."""
    out = [1]
    while out[-1] <= most:
        out.append(out[-1] * 100 // percent + 1)
    return np.array(out, np.int64)


def _prefix_mapper(words: int, percent: int, frequent: np.ndarray, rank: np.ndarray):
    """The first bits of each sketch, as many as the pigeonhole principle asks for; a frequent one for each band it is looked for in."""
    names = ["bit", "band", "node", "n", "most", "home"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        edges = _edges(percent, 1 << 20)
        for b in batches:
            for c in X.chunks(b.column(0)):
                bits, ranks, nodes, sizes, places = [], [], [], [], []
                for u in _sets(c, words):
                    n = len(u)
                    if not n or (k := int(_node(u))) in seen:
                        continue
                    seen.add(k)
                    p = n - -(-percent * n // 100) + 1
                    rk = np.zeros(n, np.int32)
                    if len(frequent):
                        at = np.minimum(np.searchsorted(frequent, u), len(frequent) - 1)
                        rk = np.where(frequent[at] == u, rank[at] + 1, 0).astype(np.int32)
                        order = np.argsort(rk, kind="stable")
                        u, rk = u[order], rk[order]
                    bits.append(u[:p])
                    ranks.append(rk[:p])
                    nodes.append(np.full(p, k, np.int64))
                    sizes.append(np.full(p, n, np.int64))
                    places.append(np.arange(p))
                if bits:
                    bit, rk, node, n, place = (np.concatenate(x) for x in (bits, ranks, nodes, sizes, places))
                    most = (n - place) * (100 + percent) // percent - n
                    if n.max() >= edges[-1]:
                        edges = _edges(percent, int(n.max()))
                    band = np.where(rk > 0, np.searchsorted(edges, n, "right"), _NO_BAND)
                    below = np.flatnonzero((band > 1) & (-(-percent * n // 100) < edges[np.maximum(band, 1) - 1]))
                    all_ = np.concatenate((np.arange(len(bit)), below))
                    band = np.concatenate((band, band[below] - 1))
                    home = np.arange(len(all_)) < len(bit)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(bit[all_].view(np.int64)), pa.array(band.astype(np.int32)), pa.array(node[all_]), pa.array(n[all_].astype(np.int32)), pa.array(most[all_].astype(np.int32)), pa.array(home)], names
                    )
                if len(seen) > 500_000:
                    seen.clear()

    return run


def _verify_mapper(words: int, percent: int):
    """Pairs (a, b, text of a, text of b) whose shingle sets are similar enough."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = [u for c in X.chunks(b.column(2)) for u in _sets(c, words, 1)]
            y = [u for c in X.chunks(b.column(3)) for u in _sets(c, words, 1)]
            ok = []
            for u, v in zip(x, y, strict=True):
                both = len(np.intersect1d(u, v, assume_unique=True))
                ok.append(100 * both >= percent * (len(u) + len(v) - both))
            yield b.select([0, 1]).filter(pa.array(ok, pa.bool_()))

    return run


def _narrow(fold: Column) -> list[Column]:
    """The sketch folded to NARROW words of 64 bits; one of fewer words is no bound there and gives nulls."""
    return [F.when(F.size(fold) >= NARROW, F.aggregate(F.filter(fold, lambda x, i: i % NARROW == k), F.lit(0).cast("long"), lambda s, x: s.bitwiseXOR(x))) for k in range(NARROW)]


def _classes(docs: DataFrame, words: int, percent: int) -> tuple[DataFrame, DataFrame]:
    """Rows (doc_id, node, n) of all documents, and (node, component_id) of nodes with a link to another node."""
    small_batches(docs.sparkSession, 250)
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.hash("text").alias("tag"), F.col("text").alias("text"))
    sketched = written(own.mapInArrow(_sketch_mapper(words), "doc_id long, tag int, node long, n int, fold array<long>, bit long"), "sketches")
    rows = sketched.where("bit is null").select("doc_id", "tag", "node", "n", "fold")
    common = sketched.where("bit is not null").groupBy("bit").agg(F.sum("n").alias("n")).where("n > 8").orderBy(F.desc("n"), "bit").limit(FREQUENT).toPandas()
    frequent = np.sort(common["bit"].to_numpy().view(np.uint64))
    rank = np.zeros(len(frequent), np.int32)
    rank[np.searchsorted(frequent, common["bit"].to_numpy().view(np.uint64))] = np.arange(len(frequent), 0, -1)

    nodes = rows.where("node is not null").groupBy("node").agg(F.min("doc_id").alias("doc"), F.min(F.struct("doc_id", "tag")).alias("row"), F.first("fold").alias("fold"), F.first("n").alias("n"))
    nodes = written(nodes, "nodes")
    bits = own.select("text").where("text is not null").mapInArrow(_prefix_mapper(words, percent, frequent, rank), "bit long, band int, node long, n int, most int, home boolean")
    # A group without a band is small, since its bit is rare: its hub is found here, and rows that no other row of it fits go.
    # Frequent bits are dealt out, and their hubs are found by aggregation.
    salt = F.when(F.col("band") == _NO_BAND, 0).otherwise(F.pmod(F.col("node"), F.lit(SALTS)))
    whole = Window.partitionBy("bit", "band", "salt")
    near = whole.orderBy("n", "node")
    before = near.rowsBetween(Window.unboundedPreceding, -1)
    rare = F.col("band") == _NO_BAND
    smaller = F.coalesce((F.max("most").over(before) >= F.col("n")) & (F.first("n").over(near) <= F.col("most")), F.lit(False))
    larger = F.coalesce(F.lead("n").over(near) <= F.col("most"), F.lit(False))
    met = (
        bits.withColumn("salt", salt)
        .withColumn("before", F.lag("node").over(near))
        .where("before is null or before <> node")  # the same set may come from several tasks
        .withColumns({"some": ~rare | smaller | larger, "hub": F.when(rare, F.max(_hub()).over(whole))})
        .where("some")
        .select("bit", "band", *_MEMBER, *(F.col(f"hub.{c}").alias(f"_{c}") for c in _MEMBER))
        .select("bit", "band", *_MEMBER, F.when(_fits(), F.col("_node")).alias("star"))
    )
    met = written(met, "met")
    group = ["bit", "band"]

    def similar(pairs: DataFrame) -> DataFrame:
        """Of the candidate pairs (a, b), those that hold; nodes are compared by the text of their first document."""
        ends = [nodes.select(F.col("node").alias(x), *(F.col(k).alias(k + x) for k in ("row", "fold", "n"))) for x in "ab"]
        xa, xb = (F.when(F.size(x) > F.size(y), _halved(F.col(x))).otherwise(F.col(x)) for x, y in (("folda", "foldb"), ("foldb", "folda")))
        apart = F.aggregate(F.zip_with(xa, xb, lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda s, x: s + x)
        apart = F.coalesce(apart, F.lit(0))  # sketches of sizes too different for each other: nothing is known
        close = _near(apart, F.col("na") + F.col("nb"), percent)
        left = written(pairs.distinct().join(ends[0], "a").join(ends[1], "b").where(close).select("a", "b", "rowa", "rowb"), "pairs")
        wanted = left.select(F.col("a").alias("node"), "rowa.*").unionByName(left.select(F.col("b").alias("node"), "rowb.*")).distinct()
        if left.count() <= BROADCAST_PAIRS:
            wanted = F.broadcast(wanted)
        same = own["doc_id"].eqNullSafe(wanted["doc_id"]) & (own["tag"] == wanted["tag"])
        texts = written(own.join(wanted, same).select("node", "text"), "texts")
        one = texts.dropDuplicates(["node"])
        full = left.join(one.select(F.col("node").alias("a"), F.col("text").alias("ta")), "a").join(one.select(F.col("node").alias("b"), F.col("text").alias("tb")), "b")
        found = written(full.select("a", "b", "ta", "tb").mapInArrow(_verify_mapper(words, percent), "a long, b long"), "links")
        discard(left, texts)
        return found

    def linked(now: DataFrame | None, links: DataFrame) -> DataFrame:
        edges = links if now is None else now.select(F.col("vertex").alias("a"), F.col("component").alias("b")).unionByName(links)
        return connected_components(edges, lambda df: written(df, "edges"))

    def hubs(members: DataFrame, *salts: Column) -> DataFrame:
        """The hub of each group (and salt)."""
        best = members.withColumns({f"salt{k}": c for k, c in enumerate(salts)})
        best = best.groupBy(*group, *(f"salt{k}" for k in range(len(salts)))).agg(F.max(_hub()).alias("hub"))
        return best.select(*group, *(F.col(f"hub.{c}").alias(f"_{c}") for c in _MEMBER))

    dealt = met.where(~rare)
    star = met.where("star is not null").select("node", F.col("star").alias("other")).distinct()
    links = similar(_ordered(star.unionByName(dealt.join(hubs(dealt), group).where(_fits()).select("node", F.col("_node").alias("other")))))
    parts = linked(None, links)
    discard(links)
    salts = 16
    while True:
        # Of any two nodes of different components one is outside the group's largest component: only those look for others.
        # Two nodes whose bit before this one is the same have met there, with more left of both.
        prior = F.lag("bit").over(Window.partitionBy("node", "home").orderBy(F.desc("most"), "bit", "band"))
        member = met.drop("star").join(parts.withColumnRenamed("vertex", "node"), "node", "left").withColumns({"part": F.coalesce("component", "node"), "prior": prior}).drop("component")
        of_part = member.groupBy(*group, "part").agg(F.count(F.lit(1)).alias("size"), F.min("n").alias("least"), F.max("most").alias("most"))
        open_ = of_part.groupBy(*group).agg(F.count(F.lit(1)).alias("parts"), F.max(F.struct("size", "part")).alias("largest"), F.sum("size").alias("all"), F.min("least").alias("least"), F.max("most").alias("farthest"))
        open_ = open_.where("parts > 1").select(*group, F.col("largest.part").alias("largest"), "all", "least", "farthest")
        todo = member.join(open_, group).where("most >= least and n <= farthest").withColumn("outside", F.col("part") != F.col("largest")).drop("largest", "least", "farthest")
        todo = written(todo.join(nodes.select("node", *(c.alias(f"s{k}") for k, c in enumerate(_narrow(F.col("fold"))))), "node"), "open")
        outside, tests, size = todo.agg(F.count_if("outside"), F.coalesce(F.sum(F.when(F.col("outside"), F.col("all"))), F.lit(0)), F.count(F.lit(1))).first()
        if not outside:
            discard(todo)
            break
        mine = todo.where("outside")
        last = tests <= PAIRS * size or salts > 1 << 12
        if last:
            names = [*_MEMBER, "part", "prior", "outside", *(f"s{k}" for k in range(NARROW))]
            other = todo.select(*group, *(F.col(c).alias(f"_{c}") for c in names))
            apart = sum((F.bit_count(F.col(f"s{k}").bitwiseXOR(F.col(f"_s{k}"))) for k in range(NARROW)), F.lit(0))
            close = F.coalesce(_near(apart, F.col("n") + F.col("_n"), percent), F.lit(True))
            once = (~F.col("_outside") | (F.col("node") < F.col("_node"))) & ~F.coalesce(F.col("prior") == F.col("_prior"), F.lit(False))
            pairs = mine.join(other, group).where(_fits() & (F.col("part") != F.col("_part")) & once & close)
        else:
            pairs = mine.join(hubs(todo, F.pmod(F.xxhash64("node"), F.lit(salts))), group).where(_fits())
        more = similar(_ordered(pairs.select("node", F.col("_node").alias("other"))))
        discard(todo)
        old, parts = parts, linked(parts, more)
        discard(old, more)
        if last:  # all pairs of different components have been compared
            break
        salts *= 16
    discard(met)
    least = parts.select("vertex", "component").unionByName(parts.select(F.col("component").alias("vertex"), "component").distinct())
    named = least.join(nodes.select(F.col("node").alias("vertex"), "doc"), "vertex")
    of = named.join(named.groupBy("component").agg(F.min("doc").alias("component_id")), "component")
    return rows.select("doc_id", "tag", "node", "n"), of.select(F.col("vertex").alias("node"), "component_id")


def _near(apart: Column, sizes: Column, percent: int) -> Column:
    """Whether sketches so far apart can be of similar sets: |A xor B| <= (|A| + |B|) (100 - percent) / (100 + percent)."""
    return (100 + percent) * apart <= (100 - percent) * sizes


_MEMBER = ["node", "n", "most", "home"]


def _hub() -> Column:
    """Of a group's members the largest is the one whose sketch begins there, or nearest to there."""
    return F.struct((F.col("most") / F.col("n")).alias("begin"), F.xxhash64("node").alias("h"), *_MEMBER)


def _fits() -> Column:
    """Whether two members of a group can be similar, by what each has left from there on."""
    return (F.col("node") != F.col("_node")) & (F.col("n") <= F.col("_most")) & (F.col("_n") <= F.col("most")) & (F.col("home") | F.col("_home"))


def _halved(fold: Column) -> Column:
    half = (F.size(fold) / 2).cast("int")
    return F.zip_with(F.slice(fold, 1, half), F.slice(fold, half + 1, half), lambda x, y: x.bitwiseXOR(y))


def _ordered(pairs: DataFrame) -> DataFrame:
    return pairs.where("other is not null and node <> other").select(F.least("node", "other").alias("a"), F.greatest("node", "other").alias("b"))


def _labelled(docs: DataFrame, words: int, percent: int) -> DataFrame:
    """doc_id, tag, node, n and component_id of each row."""
    rows, linked = _classes(docs, words, percent)
    copies = rows.where("node is not null").groupBy("node").agg(F.min("doc_id").alias("first_doc"))
    joined = rows.join(copies, "node", "left").join(linked, "node", "left")
    return joined.select("doc_id", "tag", "node", "n", F.coalesce("component_id", "first_doc", "doc_id").alias("component_id"))


def components(docs: DataFrame, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """Per row: doc_id, n_shingles, component_id (the least doc_id reachable by links)."""
    return _labelled(docs, words, percent).select("doc_id", F.col("n").cast("long").alias("n_shingles"), "component_id")


def keep_one_of_each(docs: DataFrame, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """The documents, all columns: of each component the row with the least doc_id.

    Rows without shingles all stay, as do rows with a null id that nothing is linked with.  Of several rows with the same id
    and the same set, one stays.
    """
    labelled = _labelled(docs, words, percent).where("doc_id <=> component_id")
    kept = labelled.groupBy(F.col("doc_id").alias("__doc"), F.col("tag").alias("__tag")).agg(F.count(F.lit(1)).alias("__copies"), F.first("n").alias("__n"))
    keyed = docs.withColumn("__of", F.col("doc_id").cast("long")).withColumn("__hash", F.hash("text"))
    joined = keyed.join(kept, F.col("__of").eqNullSafe(F.col("__doc")) & (F.col("__hash") == F.col("__tag")))
    cols = [F.col(f"`{c}`") for c in docs.columns]
    once = joined.where("__copies = 1 or __n = 0 or __doc is null").select(*cols)
    again = joined.where("__copies > 1 and __n > 0 and __doc is not null").dropDuplicates(["__of", "__hash"]).select(*cols)
    return once.unionByName(again)
