"""Navigation trees as adjacency lists, flattened in reading order."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lectern.functions import paths
from lectern.operators.lookups import fallback_lookup
from lectern.shared import discard, materialise


#: Paths of trees up to so many levels are kept whole; deeper ones are ranked by their tours.
SHALLOW = 64


def flatten(nav: DataFrame, book: str = "book_id", shallow: int = SHALLOW) -> DataFrame:
    """nav(book, node_id, parent_id, sibling_ord, title, page_index) in pre-order: (book, position, title, page_index, level).

    A node without a page is dropped, and its children keep their level. Every node jumps to the ancestor of its ancestor, so a tree of n levels
    takes log2(n) rounds. Trees of up to `shallow` levels are then put in the order of their nodes' paths, deeper ones by the ranks of an
    Euler tour, again by jumping. Nodes in a circle or below one, nodes whose parent isn't there, and numbers that two nodes of a book have raise an error that names them.
    """
    rows = nav.select(F.col(book).alias("b"), F.col("node_id").alias("v"), F.col("parent_id").alias("p"), F.col("sibling_ord").alias("o"), "title", "page_index")
    rows = materialise(rows, "toc-nodes")
    _refuse(rows.groupBy("b", "v").count().where("count > 1"), "several nodes have one number")
    _refuse(rows.where("p is not null").join(rows.select("b", F.col("v").alias("p")), ["b", "p"], "left_anti"), "nodes without their parent")
    most = rows.groupBy("b").count().agg(F.max("count")).first()[0] or 0
    state = rows.select("b", "v", F.col("p").alias("up"), F.lit(1).cast("long").alias("n"), F.array(F.struct("o", "v")).alias("path"))
    short, reach = True, 1
    while not state.where("up is not null").isEmpty():
        if reach > most:
            _refuse(state.where("up is not null"), "nodes in a circle, or below one")
        reach *= 2
        short = short and reach <= shallow
        above = state.select("b", F.col("v").alias("up"), F.col("up").alias("next"), F.col("n").alias("more"), F.col("path").alias("before"))
        path = F.when(F.col("before").isNull(), F.col("path")).otherwise(F.concat("before", "path")) if short else F.array().cast(state.schema["path"].dataType)
        made = state.join(above, ["b", "up"], "left").select("b", "v", F.col("next").alias("up"), (F.col("n") + F.coalesce("more", F.lit(0))).alias("n"), path.alias("path"))
        old, state = state, materialise(made, "toc-jumps")
        if hasattr(old, "_shared_path"):
            discard(old)
    level = (F.col("n") - 1).cast("int").alias("level")
    ordered = state.select("b", "v", level, F.col("path").alias("at")) if short else tour_ranks(rows).join(state.select("b", "v", level), ["b", "v"])
    shown = rows.where("page_index is not null").join(ordered, ["b", "v"])
    n = F.row_number().over(Window.partitionBy("b").orderBy("at")) - 1
    return shown.select(F.col("b").alias(book), n.alias("position"), "title", "page_index", "level")


def tour_ranks(rows: DataFrame) -> DataFrame:
    """rows(b, v, p, o), trees without circles -> (b, v, at): `at` rises in pre-order.

    The tour of a book enters and leaves every node; a step's rank is how many steps follow it, which pointer jumping finds in log2(steps) rounds
    of one row a step, whatever the trees' depth is.
    """
    among = Window.partitionBy("b", "p").orderBy("o", "v")
    placed = rows.select("b", "v", "p", F.lead("v").over(among).alias("sibling"), (F.row_number().over(among) == 1).alias("is_first"))
    child = placed.where("is_first and p is not null").select("b", F.col("p").alias("v"), F.col("v").alias("child"))
    known = materialise(placed.join(child, ["b", "v"], "left"), "toc-tour")
    step = lambda node, leaving: F.struct(node.alias("v"), F.lit(leaving).alias("leaving"))
    v, c, s, p = (F.col(x) for x in ("v", "child", "sibling", "p"))
    enter = known.select("b", step(v, False).alias("s"), F.when(c.isNotNull(), step(c, False)).otherwise(step(v, True)).alias("next"))
    leave = known.select("b", step(v, True).alias("s"), F.when(s.isNotNull(), step(s, False)).when(p.isNotNull(), step(p, True)).alias("next"))
    state = enter.union(leave).withColumn("rank", F.when(F.col("next").isNull(), 0).otherwise(1).cast("long"))
    while not state.where("next is not null").isEmpty():
        ahead = state.select("b", F.col("s").alias("next"), F.col("next").alias("then"), F.col("rank").alias("more"))
        made = state.join(ahead, ["b", "next"], "left").select("b", "s", F.col("then").alias("next"), (F.col("rank") + F.coalesce("more", F.lit(0))).alias("rank"))
        old, state = state, materialise(made, "toc-ranks")
        if hasattr(old, "_shared_path"):
            discard(old)
    return state.where("not s.leaving").select("b", F.col("s.v").alias("v"), (-F.col("rank")).alias("at"))


def _refuse(found: DataFrame, what: str) -> None:
    some = found.select("b", "v").orderBy("b", "v").limit(6).collect()
    if some:
        named = ", ".join(f"{r.v} of {r.b}" for r in some[:5])
        raise ValueError(f"{what}: {named}{' and more' if len(some) > 5 else ''}")


def with_fallback(entries: DataFrame, chapters: DataFrame, book: str = "book_id") -> DataFrame:
    """entries; for books that have none, an entry of level 0 for each chapter(book, ord, chapter_id, page_index) that has a page."""
    bare = chapters.where("page_index is not null").join(entries.select(book).distinct(), book, "left_anti")
    n = F.row_number().over(Window.partitionBy(book).orderBy("ord")) - 1
    return entries.unionByName(bare.select(book, n.alias("position"), F.col("chapter_id").cast("string").alias("title"), "page_index", F.lit(0).alias("level")))


def chapter_of_targets(targets: DataFrame, chapters: DataFrame, path: str = "path", by: tuple[str, ...] = ()) -> DataFrame:
    """targets with the chapter whose path it is: exactly, else in lower case, else decoded, else both; the last chapter wins. by: columns that tell books apart, as paths hold in one book."""
    p, q = F.col(path), F.col("xhtml_path")
    ways = lambda c: [c, F.lower(c), paths.percent_decode(c), F.lower(paths.percent_decode(c))]
    return fallback_lookup(targets, chapters, ways(p), ways(q), "chapter_id", "ord", "chapter_id", by)
