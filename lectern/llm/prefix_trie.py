"""The trie of conversations' prefixes, by prefix-doubling naming.

Every turn gets a dense name, equal turns the same. Aligned blocks of 2, 4, 8, ... turns are named by the names of their halves,
one join round for each power of two. Every prefix is then a sequence of blocks, by the binary digits of its length: with
P(k, j) the name of the first j * 2^k turns and B(k, i) that of the i-th block of 2^k turns,

    P(k, j) = P(k+1, j/2) for even j,    the name of the pair (P(k+1, (j-1)/2), B(k, j-1)) for odd j,

again a join round for each power of two, from the largest down. Rows halve from level to level, so all rounds together
handle about four rows a turn, whatever the conversations' lengths are. For one length, prefixes have equal names exactly
if they are equal, so nodes are groups of (depth, name): no prefix is ever written out.

Sums over subtrees need no walk either: each node is counted on the path of its smallest member, in a running sum from the
path's end, and a node adds up what its members carry at its depth.

Rows of a null conversation id belong to no conversation and are left out. Null role or text is empty, a null turn comes first, and turns of
one number are in the order of role and text, so rows that repeat are turns of their own. An empty table has no nodes, not even a root. Other
columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lectern.operators.ordering import Ranged
from lectern.shared import broadcast_if_small, discard, materialise

_PART = 33  # monotonically_increasing_id() has the partition above this bit and the row's place in it below


def dense_names(rows: DataFrame, keys: list[str], name: str) -> DataFrame:
    """A table of the distinct keys, numbered 0, 1, 2, ... as `name`."""
    made = materialise(rows.select(*keys).distinct().withColumn("__at", F.monotonically_increasing_id()), "trie-distinct")
    part = F.shiftright("__at", _PART)
    sizes = made.groupBy(part.alias("__part")).agg(F.count("*").alias("__n"))
    before = F.sum("__n").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1))  # a row for each partition
    starts = F.broadcast(sizes.select("__part", F.coalesce(before, F.lit(0)).alias("__start")))
    numbered = made.withColumn("__part", part).join(starts, "__part")
    out = materialise(numbered.select(*keys, (F.col("__start") + F.col("__at").bitwiseAND((1 << _PART) - 1)).alias(name)), "trie-names")
    discard(made)
    return out


def _named(rows: DataFrame, keys: list[str], name: str) -> DataFrame:
    """rows with the dense name of their keys in place of them, as a table."""
    names = dense_names(rows, keys, name)
    out = materialise(rows.join(broadcast_if_small(names), keys).drop(*keys), "trie-named")
    discard(names)
    return out


def prefix_names(turns: DataFrame, conv: str = "conv_id", pos: str = "pos", keys: tuple[str, ...] = ("role", "text")) -> DataFrame:
    """turns(conv, 0-based pos without gaps, keys) -> a table (conv, depth, name), depth >= 1: of prefixes of one depth those with equal names, and only those, are equal."""
    rows = turns.select(F.col(conv).alias("c"), F.col(pos).cast("long").alias("i"), *[F.col(k).alias(f"k{n}") for n, k in enumerate(keys)])
    level = _named(rows, [f"k{n}" for n in range(len(keys))], "b")
    blocks = [level]
    longest = level.agg(F.max("i")).first()[0]
    for _ in range((0 if longest is None else longest + 1).bit_length() - 1):
        half = F.floor(F.col("i") / 2).cast("long")
        # both halves come to the row of their block by one shuffle; an odd one at the end is no block
        both = level.groupBy("c", half.alias("i")).agg(F.max(F.when(F.col("i") % 2 == 0, F.col("b"))).alias("b0"), F.max(F.when(F.col("i") % 2 == 1, F.col("b"))).alias("b1"))
        level = _named(both.where("b1 is not null"), ["b0", "b1"], "b")
        blocks.append(level)
    above = None
    for level in reversed(blocks):
        odd = level.where("i % 2 = 0").select("c", (F.col("i") + 1).alias("j"), "b")  # block j-1 ends a prefix of j blocks, j odd
        first = odd.where("j = 1").select("c", "j", F.col("b").alias("name"))  # a block alone: P(k, 1) = B(k, 0)
        if above is None:
            now = materialise(first, "trie-prefixes")
        else:
            longer = odd.where("j > 1").withColumn("h", F.expr("(j - 1) div 2")).join(above.select("c", F.col("j").alias("h"), F.col("name").alias("p")), ["c", "h"]).select("c", "j", "p", "b")
            named = _named(longer, ["p", "b"], "name")
            now = materialise(above.select("c", (F.col("j") * 2).alias("j"), "name").union(first).union(named.select("c", "j", "name")), "trie-prefixes")
            discard(above, named)
        above = now
    discard(*blocks)
    return above.select(F.col("c").alias(conv), F.col("j").alias("depth"), "name")


def _ends(members: DataFrame) -> DataFrame:
    """members(depth, name, conv_id) -> (depth, name, ends_sha256) over each group's ids in order. Rows stream through the hash; no group is held."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, digest = None, None
        for batch in batches:
            done = []
            for depth, name, c in zip(*(x.to_pylist() for x in batch.columns), strict=True):
                if (depth, name) != key:
                    if key is not None:
                        done.append((*key, digest.hexdigest()))
                    key, digest = (depth, name), hashlib.sha256(str(c).encode())
                else:
                    digest.update(f",{c}".encode())
            if done:
                yield _ended(done)
        if key is not None:
            yield _ended([(*key, digest.hexdigest())])

    return members.select("depth", "name", "conv_id").repartition("depth", "name").sortWithinPartitions("depth", "name", "conv_id").mapInArrow(of, "depth long, name long, ends_sha256 string")


def _ended(rows: list[tuple[int, int, str]]) -> pa.RecordBatch:
    d, n, s = zip(*rows, strict=True)
    return pa.RecordBatch.from_arrays([pa.array(d, pa.int64()), pa.array(n, pa.int64()), pa.array(s, pa.string())], names=["depth", "name", "ends_sha256"])


def trie(spark: SparkSession, convs: DataFrame, turns: DataFrame) -> DataFrame:
    """The nodes of convs(conv_id, n_turns) with turns(conv_id, pos, role, text), each conversation's turns 0 .. n_turns-1.

    (conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256), a row a node; the root has depth 0.
    """
    named = prefix_names(turns)
    last = turns.select("conv_id", (F.col("pos") + 1).alias("depth"), F.length("text").cast("long").alias("size"))
    zero = F.lit(0).cast("long")
    root = convs.select("conv_id", zero.alias("depth"), zero.alias("name"), zero.alias("size"))
    paths = materialise(named.join(last, ["conv_id", "depth"]).select("conv_id", "depth", "name", "size").union(root), "trie-paths")
    nodes = materialise(paths.groupBy("depth", "name").agg(F.min("conv_id").alias("first"), F.count("*").alias("n_convs"), F.min("size").alias("size")), "trie-nodes")
    # of a node's path, the member that comes first in it knows the parent: its own prefix that is a turn shorter
    up = nodes.where("depth > 0").select(F.col("first").alias("conv_id"), (F.col("depth") - 1).alias("depth"), F.col("name").alias("child"))
    parents = materialise(up.join(paths.select("conv_id", "depth", F.col("name").alias("parent")), ["conv_id", "depth"]), "trie-parents")
    n_children = parents.groupBy("depth", F.col("parent").alias("name")).agg(F.count("*").alias("n_children"))
    counted = materialise(nodes.join(n_children, ["depth", "name"], "left").select("depth", "name", "first", "n_convs", F.coalesce("n_children", zero).alias("n_children"), ((F.col("n_convs") - 1) * F.col("size")).alias("saved")), "trie-counted")
    # each node on the path of its first member; sums from the path's end
    own = counted.select(F.col("first").alias("conv_id"), "depth", F.col("saved"), (F.col("n_children") == 0).cast("long").alias("leaf"))
    told = paths.join(own, ["conv_id", "depth"], "left").select("conv_id", "depth", (-F.col("depth")).alias("back"), "name", F.coalesce("saved", zero).alias("saved"), F.coalesce("leaf", zero).alias("leaf"))
    told = told.withColumn("w", F.struct("saved", "leaf"))
    ranged = Ranged(told, "conv_id", "back")
    below = _running(ranged)
    sums = materialise(below.groupBy("depth", "name").agg(F.sum("saved_below").alias("saved_tokens"), F.sum("leaves_below").alias("n_leaves")), "trie-sums")
    ends = paths.join(convs.select("conv_id", F.col("n_turns").alias("depth")), ["conv_id", "depth"], "left_semi")
    hashed = materialise(_ends(ends), "trie-ends")
    named_parents = parents.select((F.col("depth") + 1).alias("depth"), F.col("child").alias("name"), F.col("depth").alias("d0"), "parent").join(nodes.select(F.col("depth").alias("d0"), F.col("name").alias("parent"), F.col("first").alias("parent_conv_id")), ["d0", "parent"]).select("depth", "name", "parent_conv_id")
    out = counted.join(sums, ["depth", "name"]).join(materialise(named_parents, "trie-up"), ["depth", "name"], "left").join(hashed, ["depth", "name"], "left")
    nothing = hashlib.sha256(b"").hexdigest()
    return out.select(F.col("first").alias("conv_id"), "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.lit(nothing)).alias("ends_sha256"))


def _running(ranged: Ranged) -> DataFrame:
    """ranged rows with saved_below and leaves_below: sums up to and with each row."""
    parts = ranged.rows.groupBy("conv_id", "__part").agg(F.sum("saved").alias("s"), F.sum("leaf").alias("l"))
    before = Window.partitionBy("conv_id").orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    carried = parts.withColumn("__carry", F.struct(F.coalesce(F.sum("s").over(before), F.lit(0)).alias("s"), F.coalesce(F.sum("l").over(before), F.lit(0)).alias("l")))
    own = Window.partitionBy("conv_id", "__part").orderBy("back").rowsBetween(Window.unboundedPreceding, 0)
    found = ranged._with(carried)
    return found.select("depth", "name", (F.sum("saved").over(own) + F.col("__carry.s")).alias("saved_below"), (F.sum("leaf").over(own) + F.col("__carry.l")).alias("leaves_below"))


def in_order(conversations: DataFrame) -> DataFrame:
    """conversations as a table (conv_id, pos, role, text): turns in their order, numbered from 0."""
    blank = lambda c: F.coalesce(F.col(c), F.lit("")).alias(c)
    rows = conversations.where("conv_id is not null").select(F.col("conv_id").cast("long").alias("conv_id"), "turn", blank("role"), blank("text"))
    return materialise(Ranged(rows, "conv_id", "turn", "role", "text").number("pos").drop("turn"), "trie-turns")


def branched(turns: DataFrame, every: int = 100, heads: int = 6) -> tuple[DataFrame, DataFrame]:
    """Tables (convs, turns): each conversation c with the first h turns of conversation c - c % every in place of its own first h; h = crc32(c) % heads."""
    c = F.col("conv_id")
    base = c - c % every
    h = F.pmod(F.crc32(c.cast("string").cast("binary")), F.lit(heads)).cast("long")
    sizes = materialise(turns.groupBy("conv_id").agg(F.count("*").alias("n")), "trie-sizes")
    heads_of = turns.where(F.col("pos") < heads - 1)
    of_base = sizes.select(F.col("conv_id").alias("base"), F.col("n").alias("base_n"))
    plan = sizes.select("conv_id", "n", base.alias("base"), h.alias("h")).join(of_base, "base", "left").withColumn("taken", F.least("h", F.coalesce("base_n", F.lit(0).cast("long"))))
    plan = materialise(plan, "trie-plan")
    first = plan.where("taken > 0").select("conv_id", "base", "taken").join(heads_of.withColumnRenamed("conv_id", "base"), "base").where("pos < taken").select("conv_id", "pos", "role", "text")
    rest = turns.join(plan.select("conv_id", "h", "taken"), "conv_id").where("pos >= h").select("conv_id", (F.col("pos") - F.col("h") + F.col("taken")).alias("pos"), "role", "text")
    convs = plan.select("conv_id", (F.col("taken") + F.greatest(F.col("n") - F.col("h"), F.lit(0).cast("long"))).alias("n_turns"))
    return convs, materialise(first.union(rest), "trie-rebuilt")
