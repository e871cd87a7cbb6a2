"""The queries of this subpackage and, where SQL can express them, their oracles."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_secret_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets in every text: base kinds counted and digested, and all spans."""
    from lectern.llm import secret_ledger as S

    found = S.scan(spark, _table(spark, sf_dir, "documents"))
    base = F.filter("findings", lambda s: s["rank"] < len(S.BASE_RULES))
    count = [F.size(S.of_kind(F.col("findings"), r.kind)).cast("long").alias(f"n_{r.kind}") for r in S.BASE_RULES]
    return found.select("doc_id", *count, F.sha2(S.as_text(base), 256).alias("base_sha256"), S.as_text(F.col("findings")).alias("spans"))


# The contract's three kinds as it words them (kind, pattern, group, least characters), and the formats of the further ones.
_SECRETS = (
    ("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    ("access", "AKIA[A-Z0-9]+", 0, 20),
    ("hex", "[0-9a-f]+", 0, 24),
    ("pem", "-----BEGIN (?:[A-Z]+ )*PRIVATE KEY-----", 0, 1),
    ("forge", r"\bgh[opusr]_[A-Za-z0-9]{36,}", 0, 1),
    ("webtoken", r"\beyJ[A-Za-z0-9_-]{10,}\.eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}", 0, 1),
)


def _op1_sql() -> str:
    part = """
SELECT doc_id, {i} AS rank, '{kind}' AS kind, {least} AS least, string_split_regex(t, '{p}') AS gaps,
       regexp_extract_all(t, '{p}', 0) AS wholes, regexp_extract_all(t, '{p}', {g}) AS parts FROM d"""
    parts = " UNION ALL ".join(part.format(i=i, kind=kind, least=least, g=g, p=pattern.replace("'", "''")) for i, (kind, pattern, g, least) in enumerate(_SECRETS))
    return f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents), k AS ({parts}),
i AS (SELECT *, unnest(range(1, len(wholes) + 1)) AS i FROM k),
s AS (SELECT doc_id, rank, kind, list_sum(list_transform(gaps[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(wholes[1:i-1], lambda x: length(x))), 0) AS b,
             length(wholes[i]) AS n FROM i WHERE length(parts[i]) >= least),
t AS (SELECT *, kind || ':' || CAST(b AS BIGINT) || ':' || CAST(b + n AS BIGINT) AS span FROM s)
SELECT d.doc_id, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access, count(*) FILTER (kind = 'hex') AS n_hex,
       sha256(coalesce(string_agg(span, ',' ORDER BY b, rank) FILTER (rank < 3), '')) AS base_sha256,
       coalesce(string_agg(span, ',' ORDER BY b, rank), '') AS spans
FROM d LEFT JOIN t ON d.doc_id = t.doc_id GROUP BY d.doc_id"""


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SimHash of every document and its component over links of two bits."""
    from lectern.llm.simhash import near_duplicates

    found = near_duplicates(spark, _table(spark, sf_dir, "documents"), radius=2, shingle=3)
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op3_merge_dropout(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text in pieces, with seeded merge-dropout, and whether decoding gives it back."""
    from lectern.llm.merge_dropout import encode_rows

    made = encode_rows(spark, _table(spark, sf_dir, "documents").select("doc_id", "text"))
    return made.select("doc_id", F.size("__ids").cast("long").alias("n_pieces"), F.col("__lossless").alias("lossless"), F.col("__ids").alias("ids"))


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines that many documents share stay in the largest of them only."""
    from lectern.llm.line_index import dedup_lines

    kept = dedup_lines(spark, _table(spark, sf_dir, "documents").select("doc_id", "text"), least=40, min_docs=5)
    return kept.select("doc_id", F.col("__n_lines").alias("n_lines"), F.col("__n_dropped").alias("n_dropped"), F.sha2("text", 256).alias("kept_sha256"))


_OP4_SQL = r"""
WITH l AS (SELECT doc_id, i, lines[i] AS line FROM (
  SELECT doc_id, lines, unnest(range(1, len(lines) + 1)) AS i FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents))),
k AS (SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
c AS (SELECT key, max(doc_id) AS last FROM k WHERE length(key) >= 40 GROUP BY key HAVING count(DISTINCT doc_id) >= 5),
m AS (SELECT k.*, c.key IS NOT NULL AND c.last <> k.doc_id AS gone FROM k LEFT JOIN c ON k.key = c.key)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '')) AS kept_sha256
FROM m GROUP BY doc_id"""


def op5_exact_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Canonical exact digests of every text and of its edit, with their likeness."""
    from lectern.llm.exact_digest import edited_likeness

    return edited_likeness(spark, _table(spark, sf_dir, "documents"))


def _held_out(of: int, at: int) -> Column:
    return F.pmod(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")), F.lit(of)) == at


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every text, learned from the labels of rows that aren't held out."""
    from lectern.llm import toxicity as T

    docs, labels = _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels")
    out = _held_out(5, 0)
    model = T.train(docs.where(~out), labels.where(~out).select("doc_id", "toxic"))
    score = T.scores(spark, model, F.col("text"))
    return docs.select("doc_id", out.alias("held_out"), score.alias("score")).withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def op7_media_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text stored as a chunked wave file, read back and measured."""
    from lectern.llm.media_chunks import media_features

    return media_features(spark, _table(spark, sf_dir, "documents"))


def op8_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the mix of all sources takes of every document."""
    from lectern.llm.mixture import mix_report

    return mix_report(spark, _table(spark, sf_dir, "documents"))


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every text, learned from rows that aren't held out."""
    from lectern.llm import language_id as L

    docs = _table(spark, sf_dir, "documents")
    out = _held_out(4, 2)
    model = L.train(docs.where(~out).select("text", "lang"))
    found = docs.select("doc_id", out.alias("held_out"), L.identify(spark, model, F.col("text")).alias("f"))
    return found.select("doc_id", "held_out", F.col("f.lang").alias("lang_pred"), F.col("f.score").alias("score"), F.col("f.ambiguous").alias("ambiguous"))


def op10_warc_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page archived, and read back by the index."""
    from lectern.llm.warc_index import archive_report

    found = archive_report(spark, _table(spark, sf_dir, "pages"))
    return found.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


_OP10_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages), q AS (SELECT page_id, strlen(h) AS payload_bytes, sha256(h) AS payload_digest FROM p),
f AS (SELECT payload_digest, min(page_id) AS first FROM q WHERE payload_bytes >= 100 GROUP BY 1)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN first <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN first <> page_id THEN first END AS refers_to FROM q LEFT JOIN f USING (payload_digest)"""


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The trie of all conversations, those of a hundred beginning alike."""
    from lectern.llm import prefix_trie as P

    return P.trie(spark, *P.branched(P.in_order(_table(spark, sf_dir, "conversations"))))


_OP11_SQL = """
WITH t AS (SELECT conv_id AS c, list({'r': coalesce(role, ''), 't': coalesce(text, '')} ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS l
           FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id),
h AS (SELECT c, l, list_reduce(list_concat([4294967295::BIGINT], list_transform(range(1, len(CAST(c AS VARCHAR)) + 1), lambda i: ascii(CAST(c AS VARCHAR)[i])::BIGINT)),
        lambda crc, b: list_reduce(list_concat([xor(crc, b)], [0::BIGINT, 0, 0, 0, 0, 0, 0, 0]), lambda x, z: xor(x >> 1, (x & 1) * 3988292384))) AS inverse FROM t),
q AS (SELECT c, l, xor(inverse, 4294967295) % 6 AS h FROM h),
r AS (SELECT q.c, list_concat(coalesce(list_slice(b.l, 1, q.h), []), list_slice(q.l, q.h + 1, len(q.l))) AS l FROM q LEFT JOIN t b ON b.c = q.c - q.c % 100),
o AS (SELECT c, l, unnest(range(0, len(l) + 1)) AS depth FROM r),
p AS (SELECT c, depth, list_slice(l, 1, depth) AS k, len(l) = depth AS ends FROM o),
n AS (SELECT depth, k, min(c) AS c, count(*) AS n_convs, coalesce(string_agg(c::VARCHAR, ',' ORDER BY c) FILTER (ends), '') AS members FROM p GROUP BY depth, k),
f AS (SELECT n.*, u.c AS parent, CASE WHEN n.depth = 0 THEN 0 ELSE (n_convs - 1) * length(n.k[n.depth].t) END AS saved
      FROM n LEFT JOIN (SELECT depth, k, c FROM n) u ON u.depth = n.depth - 1 AND u.k = list_slice(n.k, 1, n.depth - 1)),
m AS (SELECT depth - 1 AS depth, list_slice(k, 1, depth - 1) AS k, count(*) AS n_children FROM n WHERE depth > 0 GROUP BY 1, 2),
g AS (SELECT f.depth, f.k, f.c, f.n_convs, f.members, f.parent, f.saved, coalesce(m.n_children, 0) AS n_children FROM f LEFT JOIN m ON m.depth = f.depth AND m.k = f.k),
s AS (SELECT d AS depth, list_slice(k, 1, d) AS k, sum(saved) AS saved, count(*) FILTER (n_children = 0) AS leaves FROM (SELECT k, saved, n_children, unnest(range(0, depth + 1)) AS d FROM g) GROUP BY 1, 2)
SELECT g.c AS conv_id, g.depth, g.parent AS parent_conv_id, g.n_convs, g.n_children, s.leaves AS n_leaves, s.saved::BIGINT AS saved_tokens, sha256(g.members) AS ends_sha256
FROM g JOIN s ON s.depth = g.depth AND s.k = g.k"""


def op12_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two tokenizers' tokens of every text, linked where they share a group of bytes."""
    from lectern.llm.token_alignment import alignment_report

    return alignment_report(spark, _table(spark, sf_dir, "documents"))


def op13_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of documents whose sets of five-word shingles have a Jaccard index of 0.8 or more."""
    from lectern.llm.jaccard_join import jaccard_components

    return jaccard_components(spark, _table(spark, sf_dir, "documents"), shingle=5, percent=80)


_OP13_SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[ 	-
]+'), lambda x: x <> '') AS w FROM documents),
s AS (SELECT doc_id, list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
             ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(list_slice(w, i, i + 4), ' ')) END) AS s FROM w),
c AS (SELECT s, len(s) AS n, min(doc_id) AS first FROM (SELECT doc_id, list_sort(s) AS s FROM s) GROUP BY s),
e AS (SELECT first, n, unnest(s) AS x FROM c),
p AS (SELECT a.first AS u, b.first AS v FROM e a JOIN e b ON a.x = b.x AND a.first < b.first AND 100 * least(a.n, b.n) >= 80 * greatest(a.n, b.n)
      GROUP BY a.first, b.first, a.n, b.n HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))),
g AS (SELECT u, v FROM p UNION ALL SELECT v, u FROM p),
r AS (SELECT DISTINCT u AS node, u AS root FROM g UNION SELECT g.v, r.root FROM r JOIN g ON g.u = r.node),
m AS (SELECT node, min(root) AS root FROM r GROUP BY node)
SELECT d.doc_id, len(d.s) AS n_shingles, CASE WHEN len(d.s) = 0 THEN d.doc_id ELSE coalesce(m.root, c.first) END AS component_id
FROM s d JOIN c ON c.s = list_sort(d.s) LEFT JOIN m ON m.node = c.first"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {"op1_secret_ledger": op1_secret_ledger, "op2_simhash": op2_simhash, "op3_merge_dropout": op3_merge_dropout, "op4_line_dedup": op4_line_dedup, "op5_exact_digest": op5_exact_digest, "op6_toxicity": op6_toxicity, "op7_media_chunks": op7_media_chunks, "op8_mixture": op8_mixture, "op9_language_id": op9_language_id, "op10_warc_index": op10_warc_index, "op11_prefix_trie": op11_prefix_trie, "op12_token_alignment": op12_token_alignment, "op13_jaccard_join": op13_jaccard_join}


def oracle_sql() -> dict[str, str]:
    return {"op1_secret_ledger": _op1_sql(), "op4_line_dedup": _OP4_SQL, "op10_warc_index": _OP10_SQL, "op11_prefix_trie": _OP11_SQL, "op13_jaccard_join": _OP13_SQL}
