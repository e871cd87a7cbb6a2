"""Mixing sources to target weights by a splitting tree [native].

A keyed hash of its id puts every document at a place of its source's permutation; the leading bits of the
place are its block, so blocks are random, disjoint and of known words. A source's quota is a number of blocks: as many
whole passes over its blocks as its target asks for, and those of one more pass up to the block in which the target is
reached (the last of the quota). Of that block the mix takes documents, in their order, up to the first that is
too large for what is left, and then fills the rest with a document or two of each of many sizes, the large ones first, and,
while others could still fit, in rounds of documents no larger than what is left. So no document that isn't
taken would fit, and a source misses its target by less than the smallest of them (or by less than a word).

The quotas are dealt to the output shards by a tree. A node holds an urn of blocks of all sources; it draws half of them,
without replacement, for its left child, which is a multivariate hypergeometric draw of the sources' quotas, and
leaves exact sums at every node. Halving one random order of all blocks, again and again, is that draw at every node
at once, so one distributed ranking grows the whole tree. A shard's quota of a source then takes the next run of the
source's permuted blocks, and every shard shuffles its own rows by another keyed hash.

The numbers of blocks and shards go with the data: PER_BLOCK documents a block up to 256 blocks of a source, then
blocks of at most WIDE; SHARD_WORDS words a shard, eight shards at least.

Sources are ordered by code point, null last; a row per source meets in one task, never a row per document. Null and empty texts
have size 0; a very long text counts whole and is taken whole. Documents of one id are at one place and
are taken alike, but where a rest is filled in rounds by size: there each of them counts by itself. Reruns of a mix agree. An empty table gives an empty mix. Other columns, whatever their names,
are kept by mix_documents() and ignored by mix_report().
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lectern.operators.ordering import global_index
from lectern.shared import broadcast_if_small, materialise

#: Documents in a block, about: as few as that while a source has up to 2^FINE blocks, as many as that beyond.
PER_BLOCK, WIDE, FINE = 16, 1024, 8
SHARD_WORDS, LEAST_LEVELS = 1 << 27, 3
_PLACE_BITS = 63
#: Parts in which an octave of sizes is cut for the documents that fill a rest.
_PARTS = 8
_DRAWS = "array<struct<pass:int,shard:long>>"


def words(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(r"[^\x20\x09-\x0D]+")).cast("long")


def _place(id: Column, seed: int) -> Column:
    return F.shiftrightunsigned(F.xxhash64(F.lit(seed), id), 1)


def targets(sizes: DataFrame, weights: tuple[int, ...] = (1, 2, 3), most: int = 3) -> DataFrame:
    """sizes(source, source_size, docs) with weight and target.

    Targets share the sum of all sizes by weight, stop at `most` times a source's size, and the excess is
    shared again until none is above: target = least(most * size, level * weight) for one level, which
    the order of the sources' size to weight gives directly.
    """
    n = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last()))
    w = sizes.withColumn("weight", F.element_at(F.array(*[F.lit(float(x)) for x in weights]), F.pmod(n - 1, F.lit(len(weights))) + 1))
    ahead = Window.orderBy(F.col("source_size") / F.col("weight"), F.col("source").asc_nulls_last())
    whole = ahead.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    before = ahead.rowsBetween(Window.unboundedPreceding, -1)
    left = F.sum("source_size").over(whole) - most * F.coalesce(F.sum("source_size").over(before), F.lit(0))
    share = F.sum("weight").over(whole) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))
    w = w.withColumn("level", left / share)
    free = F.col("level") <= most * F.col("source_size") / F.col("weight")
    level = F.first(F.when(free, F.col("level")), ignorenulls=True).over(whole)
    cap = (most * F.col("source_size")).cast("double")
    return w.withColumn("target", F.least(cap, F.coalesce(level * F.col("weight"), cap))).drop("level")


def _of(column: str, other: str) -> Column:
    """A join on a source, which may be null."""
    return F.col(column).eqNullSafe(F.col(other))


def _reach(sums: DataFrame, rows: DataFrame, asked: DataFrame) -> DataFrame:
    """asked(source, left) -> (source, block, rank, cut, left): the place at which left is used up, and what is left there.

    sums(source, block, size): words of the blocks of rows(source, block, place, size). Sources whose rows are no more than what is left have no result.
    A source's blocks meet in a task, and the documents of one block; places are summed before, so rows of one id are one.
    """
    along = Window.partitionBy("source").orderBy("block")
    run = sums.withColumns({"rank": F.row_number().over(along) - 1, "upto": F.sum("size").over(along)})
    a = asked.select(F.col("source").alias("a_source"), "left")
    over = run.join(broadcast_if_small(a), _of("source", "a_source")).where("upto > left").groupBy("source")
    over = over.agg(F.min(F.struct("rank", "block", (F.col("left") - F.col("upto") + F.col("size")).alias("left"))).alias("r"))
    over = materialise(over.select(F.col("source").alias("o_source"), "r.*").withColumnRenamed("block", "o_block"), "mix-over")
    inside = rows.join(broadcast_if_small(over), _of("source", "o_source") & (F.col("block") == F.col("o_block")))
    places = inside.groupBy("source", "block", "rank", "left", "place").agg(F.sum("size").alias("size"))
    upto = places.withColumn("upto", F.sum("size").over(Window.partitionBy("source").orderBy("place"))).where("upto > left")
    cut = upto.groupBy("source", "block", "rank").agg(F.min(F.struct("place", (F.col("left") - F.col("upto") + F.col("size")).alias("left"))).alias("c"))
    return materialise(cut.select("source", "block", "rank", F.col("c.place").alias("cut"), "c.left"), "mix-cut")


def _fill(candidates: DataFrame) -> DataFrame:
    """candidates(source, left, size, place) -> (source, extras, left, more): places whose documents fill what is left.

    Of each part of an octave of sizes the smallest and the largest document (the first of equals) are looked at, from large
    to small; one that fits is taken. `more`: a document that wasn't looked at may fit still. If none can, the smallest
    that was passed over is taken where that misses by less than to leave it.
    """
    part = F.floor(_PARTS * F.log2(F.greatest("size", F.lit(1))))
    first, last = F.min(F.struct("size", "place")), F.max(F.struct("size", (-F.col("place")).alias("place")))
    few = candidates.where("size > 0").groupBy("source", "left", part.alias("part")).agg(first.alias("a"), last.alias("z"), F.count("*").alias("n"))
    both = F.array_distinct(F.array("a", F.struct(F.col("z.size").alias("size"), (-F.col("z.place")).alias("place"))))
    least = F.min(F.when(F.col("n") > 2, F.col("a.size"))).alias("unseen")
    listed = few.groupBy("source", "left").agg(F.flatten(F.collect_list(both)).alias("docs"), least)
    fold = """aggregate(reverse(array_sort(docs)), struct(left as left, cast(array() as array<bigint>) as taken, cast(null as struct<size:bigint,place:bigint>) as over),
        (s, d) -> if(d.size <= s.left, struct(s.left - d.size as left, concat(s.taken, array(d.place)) as taken, s.over as over), struct(s.left as left, s.taken as taken, least(s.over, d) as over)))"""
    done = listed.select("source", F.expr(fold).alias("s"), "unseen").withColumn("more", F.coalesce(F.col("unseen") <= F.col("s.left"), F.lit(False)))
    extras = F.expr("if(not more and s.over.size - s.left < s.left, concat(s.taken, array(s.over.place)), s.taken)")
    return done.select("source", extras.alias("extras"), "s.left", "more")


def split_quotas(quotas: DataFrame, levels: Column, seed: int) -> DataFrame:
    """quotas(source, blocks) dealt to 2^levels shards: (shard, source, blocks), sums exact at every node of the tree.

    A node's urn is a stretch of one random order of all blocks, and its children are the halves of the stretch.
    """
    parts = quotas.select("source", "blocks", F.explode(F.expr("sequence(0L, (blocks - 1) div 4096)")).alias("part"))
    urn = parts.select("source", F.explode(F.expr("sequence(part * 4096, least(part * 4096 + 4095, blocks - 1))")).alias("ball"))
    drawn = global_index(urn.withColumn("key", F.xxhash64(F.lit(seed), "source", "ball")), "key", "source", "ball", name="rank")
    total, depth = quotas.agg(F.coalesce(F.sum("blocks"), F.lit(1)), F.coalesce(F.first(levels), F.lit(0))).first()
    shard = F.expr(f"cast(rank as decimal(38,0)) * {1 << depth} div {total}")
    return drawn.select(shard.alias("shard"), "source").groupBy("shard", "source").agg(F.count("*").alias("blocks"))


class Mixture:
    """The plan of a mix: sources (with targets, cuts and what fills the rest) and draws (source, block, when and for which shards)."""

    def __init__(self, spark: SparkSession, docs: DataFrame, seed: int = 17, levels: int | None = None, id: str = "doc_id", source: str = "source", text: str = "text", weights: tuple[int, ...] = (1, 2, 3), most: int = 3):
        self.seed, self.id, self.source = seed, id, source
        rows = docs.select(F.col(id).alias("id"), F.col(source).alias("source"), words(F.col(text)).alias("size"))
        self.sizes = materialise(rows.withColumn("place", _place(F.col("id"), seed)), "mix-sizes")
        self.sources = self._sources(weights, most, levels)
        placed = self._blocks(self.sizes.select("source", "size", "place"))
        sums = materialise(placed.groupBy("source", "block").agg(F.sum("size").alias("size")), "mix-blocks")
        own = self.sources.select(F.col("source").alias("s_source"), "passes", "rest", "levels")
        self.cuts = self._cuts(sums, placed)
        known = own.join(self.cuts.select(F.col("source").alias("c_source"), (F.col("rank") + 1).alias("last")), _of("s_source", "c_source"), "left")
        quotas = sums.groupBy("source").agg(F.count("*").alias("n")).join(known, _of("source", "s_source"))
        quotas = materialise(quotas.select("source", "n", "levels", (F.col("n") * F.col("passes") + F.coalesce("last", F.lit(0))).alias("blocks")).where("blocks > 0"), "mix-quotas")
        self.leaves = materialise(split_quotas(quotas, F.col("levels"), seed), "mix-leaves")
        self.draws = materialise(self._drawn(sums, quotas), "mix-draws")

    def _sources(self, weights: tuple[int, ...], most: int, levels: int | None) -> DataFrame:
        """(source, source_size, docs, weight, target, bits, passes, rest, levels)."""
        sums = self.sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("docs"))
        need = lambda n: F.greatest(F.lit(0), F.ceil(F.log2(F.greatest(F.lit(1), n)))).cast("int")
        bits = F.least(need(F.col("docs") / PER_BLOCK), F.greatest(F.lit(FINE), need(F.col("docs") / WIDE)))
        passes = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("int")
        every = F.sum("source_size").over(Window.partitionBy())
        deep = F.greatest(F.lit(LEAST_LEVELS), need(every / SHARD_WORDS)) if levels is None else F.lit(levels)
        found = targets(sums, weights, most).withColumns({"bits": bits, "passes": passes, "levels": deep})
        return materialise(found.withColumn("rest", F.col("target") - F.col("passes") * F.col("source_size")), "mix-sources")

    def _blocks(self, rows: DataFrame) -> DataFrame:
        s = self.sources.select(F.col("source").alias("b_source"), "bits")
        return rows.join(broadcast_if_small(s), _of("source", "b_source")).withColumn("block", F.expr("shiftright(place, 63 - bits)")).drop("b_source", "bits")

    def _cuts(self, sums: DataFrame, placed: DataFrame) -> DataFrame:
        """(source, block, rank, cut, extras, fills): the last block of each source's quota, of which documents at places below
        the cut are taken; of those from the cut on, the ones at the places `extras`, and in each stretch of fills all up to its limit."""
        reached = _reach(sums, placed, self.sources.where("rest > 0").select("source", F.col("rest").alias("left")))
        asked = reached.select(F.col("source").alias("q_source"), F.col("block").alias("q_block"), "cut", "left")
        behind = placed.join(broadcast_if_small(asked), _of("source", "q_source")).where("block >= q_block and place >= cut and left >= 0.5")
        filled = materialise(_fill(behind.groupBy("source", "place", "left").agg(F.sum("size").alias("size"))), "mix-filled")
        fills = []
        left = filled.where("more").select(F.col("source").alias("f_source"), "extras", "left", F.lit(0).cast("long").alias("low"))
        while not left.isEmpty():  # each round's documents are smaller than what the one before left
            open_ = behind.drop("left").join(broadcast_if_small(left), _of("source", "f_source")).where("place >= low and size <= left and not array_contains(extras, place)")
            open_ = materialise(open_.select("source", "block", "place", "size", "left", "low", "extras"), "mix-open")
            cut = _reach(open_.groupBy("source", "block").agg(F.sum("size").alias("size")), open_.select("source", "block", "place", "size"), left.select(F.col("f_source").alias("source"), "left"))
            cut = cut.select(F.col("source").alias("c_source"), F.col("cut").alias("to"), F.col("left").alias("rest"))
            round_ = open_.select("source", "low", "extras", "left").distinct().join(cut, _of("source", "c_source"), "left")
            round_ = materialise(round_.withColumn("to", F.coalesce("to", F.lit((1 << _PLACE_BITS) - 1))), "mix-round")
            fills.append(round_.select("source", F.struct("low", "to", F.floor("left").cast("long").alias("limit")).alias("f")))
            left = round_.where("rest >= 1").select(F.col("source").alias("f_source"), "extras", F.col("rest").alias("left"), F.col("to").alias("low"))
        found = reached.drop("left").join(filled.select(F.col("source").alias("e_source"), "extras"), _of("source", "e_source"), "left")
        kind = "array<struct<low:bigint,to:bigint,limit:bigint>>"
        if fills:
            every = fills[0]
            for df in fills[1:]:
                every = every.union(df)
            listed = every.groupBy(F.col("source").alias("l_source")).agg(F.collect_list("f").cast(kind).alias("fills"))
            found = found.join(listed, _of("source", "l_source"), "left")
        else:
            found = found.withColumn("fills", F.lit(None).cast(kind))
        none = F.array()
        return materialise(found.select("source", "block", "rank", "cut", F.coalesce("extras", none.cast("array<bigint>")).alias("extras"), F.coalesce("fills", none.cast(kind)).alias("fills")), "mix-cuts")

    def _drawn(self, sums: DataFrame, quotas: DataFrame) -> DataFrame:
        """(source, block, draws): each shard takes, of each source, the next run of its quota's blocks; a pass is as many as the source has."""
        order = Window.partitionBy("source").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
        runs = self.leaves.withColumn("begin", F.coalesce(F.sum("blocks").over(order), F.lit(0)))
        sizes = quotas.select(F.col("source").alias("q_source"), "n")
        parts = runs.join(broadcast_if_small(sizes), _of("source", "q_source")).select("source", "shard", "n", F.explode(F.expr("sequence(0L, (blocks - 1) div 4096)")).alias("part"), "begin", "blocks")
        units = parts.select("source", "shard", "n", F.explode(F.expr("sequence(begin + part * 4096, begin + least(part * 4096 + 4095, blocks - 1))")).alias("j"))
        drawn = units.groupBy("source", F.expr("j % n").alias("rank")).agg(F.sort_array(F.collect_list(F.struct(F.expr("cast(j div n as int)").alias("pass"), "shard"))).alias("draws"))
        drawn = drawn.select(F.col("source").alias("d_source"), F.col("rank").alias("d_rank"), "draws")
        ranked = sums.withColumn("rank", F.row_number().over(Window.partitionBy("source").orderBy("block")) - 1)
        return ranked.join(drawn, _of("source", "d_source") & (F.col("rank") == F.col("d_rank"))).select("source", "block", "draws")

    def taken(self, rows: DataFrame) -> DataFrame:
        """rows(source, place, size, ...) with source_size, target and draws: array<struct<pass,shard>>, one entry for each time the row is taken."""
        c = self.cuts.select(F.col("source").alias("c_source"), F.col("block").alias("cut_block"), "cut", "extras", "fills")
        last = self.draws.join(c, _of("source", "c_source")).where("block = cut_block").select(F.col("source").alias("l_source"), F.element_at("draws", -1).alias("last"), "cut_block", "cut", "extras", "fills")
        s = self.sources.select(F.col("source").alias("t_source"), "source_size", "target", "bits")
        s = materialise(s.join(last, _of("t_source", "l_source"), "left").drop("l_source"), "mix-takes")
        d = self.draws.select(F.col("source").alias("r_source"), F.col("block").alias("r_block"), "draws")
        found = rows.withColumnRenamed("size", "own_size").join(broadcast_if_small(s), _of("source", "t_source")).withColumn("block", F.expr("shiftright(place, 63 - bits)"))
        found = found.join(broadcast_if_small(d), _of("source", "r_source") & (F.col("block") == F.col("r_block")), "left")
        # the last block is drawn in part: its documents from the cut on aren't, but for those that fill the rest
        none = F.array().cast(_DRAWS)
        whole = F.coalesce("draws", none)
        whole = F.when((F.col("block") == F.col("cut_block")) & (F.col("place") >= F.col("cut")), F.filter(whole, lambda x: x["pass"] < F.col("last.pass"))).otherwise(whole)
        fills = F.expr("place >= cut and (array_contains(extras, place) or exists(fills, f -> place >= f.low and place < f.to and own_size <= f.limit))")
        return found.select(*[F.col("own_size").alias("size") if c == "size" else c for c in rows.columns], "source_size", "target", F.concat(whole, F.when(fills, F.array("last")).otherwise(none)).cast(_DRAWS).alias("draws"))


def mix_report(spark: SparkSession, docs: DataFrame, id: str = "doc_id", source: str = "source", text: str = "text", seed: int = 17) -> DataFrame:
    """(id, size, source_size, target, taken, draws) of each row; draws: pass:shard of each time that it is taken, comma-joined."""
    mix = Mixture(spark, docs, seed, id=id, source=source, text=text)
    rows = mix.taken(mix.sizes)
    told = F.array_join(F.transform("draws", lambda d: F.concat_ws(":", d["pass"].cast("string"), d["shard"].cast("string"))), ",")
    return rows.select(F.col("id").alias(id), "size", "source_size", "target", (F.col("size") * F.size("draws")).cast("long").alias("taken"), told.alias("draws"))


def mix_documents(spark: SparkSession, docs: DataFrame, id: str = "doc_id", source: str = "source", text: str = "text", seed: int = 17) -> DataFrame:
    """The mix itself: docs' rows, each as often as it is taken, shard after shard, shuffled within each. All columns stay."""
    mix = Mixture(spark, docs, seed, id=id, source=source, text=text)
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col(source).alias("source"), words(F.col(text)).alias("size"), _place(F.col(id), seed).alias("place"))
    copies = mix.taken(rows).select("row", "place", F.explode("draws").alias("d")).select("row", F.col("d.shard").alias("shard"), F.xxhash64(F.lit(seed + 2), "place", "d.pass").alias("order"))
    return copies.repartitionByRange("shard", "order").sortWithinPartitions("shard", "order").select("row.*")
