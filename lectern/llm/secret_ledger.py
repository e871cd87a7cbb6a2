"""Secret scans by an incremental blob ledger [native].

Every version of every path is addressed by the SHA-256 of its text. The ledger has a row for each
(blob, rule, rule version) that was ever scanned; a run scans a blob, once, for just the rules that the
ledger lacks, appends what it found (nothing found is a row too), and joins findings back to all paths.

Spans come from built-in expressions: split() gives the text between matches and regexp_extract_all()
the matches; the running sum of their lengths is where each begins (code points, end exclusive).

Null text counts as empty. Rows that repeat give repeated rows. Empty tables give empty results. Very long texts
are scanned whole; their spans of one rule are one array. Columns
other than the two that are named in the call are ignored, whatever they are called.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.shared import materialise, new_path


@dataclass(frozen=True)
class Rule:
    """A match counts if its group has at least `least` characters. `quick` must match wherever a counted match is."""

    kind: str
    version: int
    pattern: str
    group: int = 0
    least: int = 1
    quick: str | None = None


# The contract's three kinds, in its order.
_ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?"""
BASE_RULES = (
    Rule("assign", 1, _ASSIGN + r"([A-Za-z0-9+/_.=-]+)", 2, 6, _ASSIGN + r"[A-Za-z0-9+/_.=-]{6}"),
    Rule("access", 1, r"AKIA[A-Z0-9]{16,}"),
    Rule("hex", 1, r"[0-9a-f]{24,}"),
)
#: Further kinds, with formats so narrow that prose can't have them.
EXTRA_RULES = (
    Rule("pem", 1, r"-----BEGIN (?:[A-Z]+ )*PRIVATE KEY-----"),
    Rule("forge", 1, r"\bgh[opusr]_[A-Za-z0-9]{36,}"),
    Rule("webtoken", 1, r"\beyJ[A-Za-z0-9_-]{10,}\.eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}"),
)
RULES = BASE_RULES + EXTRA_RULES

_SPANS = "array<struct<start:int,end:int>>"


def find_spans(text: Column, rule: Rule) -> Column:
    """array<struct<start,end>> of the rule's counted matches, leftmost and non-overlapping."""
    gaps = F.split(text, rule.pattern, -1)
    whole = F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(0))
    part = F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(rule.group))
    sizes = F.zip_with(
        F.zip_with(F.slice(gaps, 1, F.size(whole)), whole, lambda g, w: F.struct(F.length(g).alias("gap"), F.length(w).alias("len"))),
        part,
        lambda s, p: F.struct(s["gap"].alias("gap"), s["len"].alias("len"), F.length(p).alias("part")),
    )
    start = F.struct(F.lit(0).alias("at"), F.array().cast(_SPANS).alias("spans"))

    def step(acc: Column, x: Column) -> Column:
        begin, end = acc["at"] + x["gap"], acc["at"] + x["gap"] + x["len"]
        found = F.array(F.struct(begin.alias("start"), end.alias("end")))
        return F.struct(end.alias("at"), F.when(x["part"] >= rule.least, F.concat(acc["spans"], found)).otherwise(acc["spans"]).alias("spans"))

    spans = F.aggregate(sizes, start, step, lambda acc: acc["spans"])
    return F.when(text.rlike(rule.quick or rule.pattern), spans).otherwise(F.array().cast(_SPANS))


def _tagged(spans: Column, rank: int, kind: str) -> Column:
    """Spans as findings, ordered by start, then rank."""
    return F.transform(F.coalesce(spans, F.array().cast(_SPANS)), lambda s: F.struct(s["start"].alias("start"), F.lit(rank).alias("rank"), s["end"].alias("end"), F.lit(kind).alias("kind")))


def of_kind(findings: Column, kind: str) -> Column:
    return F.filter(findings, lambda s: s["kind"] == kind)


def scan(
    spark: SparkSession, versions: DataFrame, ledger: str | None = None, rules: tuple[Rule, ...] = RULES, path: str = "doc_id", text: str = "text"
) -> DataFrame:
    """(path column, blob, findings) for each row of versions; findings: array<struct<start,end,kind,rank>> by start, then rule order.

    ledger: a folder that keeps the ledger between runs; None starts an empty one. A second run over the
    same blobs and rules scans no text at all; a rule of a new version is scanned for alone.
    """
    rows = versions.select(F.col(path).alias("path"), F.coalesce(F.col(text), F.lit("")).alias("text")).withColumn("blob", F.sha2("text", 256))
    paths = materialise(rows.select("path", "blob"), "secret-paths")
    ledger = ledger or new_path(spark, "secret-ledger")
    schema = f"blob string, kind string, version int, spans {_SPANS}"
    spark.createDataFrame([], schema).write.mode("append").parquet(ledger)

    def seen() -> DataFrame:
        known = spark.createDataFrame([(r.kind, r.version) for r in rules], "kind string, version int")
        return spark.read.schema(schema).parquet(ledger).join(F.broadcast(known), ["kind", "version"])

    wanted = F.explode(F.array(*[F.struct(F.lit(r.kind).alias("kind"), F.lit(r.version).alias("version")) for r in rules]))
    owner = paths.groupBy("blob").agg(F.min("path").alias("path"))
    unseen = materialise(
        owner.select("blob", "path", wanted.alias("w")).select("blob", "path", "w.*").join(seen().select("blob", "kind", "version"), ["blob", "kind", "version"], "left_anti")
        .groupBy("blob", "path").agg(F.collect_set("kind").alias("kinds")),
        "secret-unseen",
    )
    todo = rows.join(unseen, (rows["blob"] == unseen["blob"]) & rows["path"].eqNullSafe(unseen["path"])).select(rows["blob"], "text", "kinds")
    each = [
        F.when(F.array_contains("kinds", r.kind), F.struct(F.lit(r.kind).alias("kind"), F.lit(r.version).alias("version"), find_spans(F.col("text"), r).alias("spans")))
        for r in rules
    ]
    found = todo.select("blob", F.explode(F.array_compact(F.array(*each))).alias("f")).select("blob", "f.*")
    found.write.mode("append").parquet(ledger)

    pick = [F.max(F.when(F.col("kind") == r.kind, F.col("spans"))).alias(f"k{i}") for i, r in enumerate(rules)]
    tagged = [_tagged(F.col(f"k{i}"), i, r.kind) for i, r in enumerate(rules)]
    by_blob = materialise(seen().groupBy("blob").agg(*pick).select("blob", F.array_sort(F.concat(*tagged)).alias("findings")), "secret-findings")
    return paths.join(by_blob, "blob", "left").select(F.col("path").alias(path), "blob", "findings")


def as_text(findings: Column) -> Column:
    """kind:start:end, comma-joined."""
    return F.array_join(F.transform(findings, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
