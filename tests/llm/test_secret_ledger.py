import random
import re

from pyspark.sql import functions as F

from lectern.llm import secret_ledger as S


def brute(text):
    out = []
    for rank, r in enumerate(S.RULES):
        for m in re.finditer(r.pattern, text, re.ASCII):
            if len(m[r.group]) >= r.least:
                out.append((m.start(), rank, m.end(), r.kind))
    return sorted(out)


TEXTS = [
    None, "", "password=short", "secret=token:abcdefgh", "PassWord: 'hunter22' token = \"abc.def-123\"", "é" * 5 + "api_key:ABCDEF", "AKIA" + "A" * 15, "AKIA" + "A" * 16 + "AKIA",
    "0" * 23, "0" * 24 + "g" + "a1" * 20, "x" * 50000 + " passwd=abcdefg", "-----BEGIN RSA PRIVATE KEY-----", "token=aaaaaa token=bbbbbb secret=cccccc", "password=password=secret", "ghp_" + "a" * 36,
]


def frame(spark, texts, extra=False):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    return df.withColumns({"blob": F.lit("x"), "path": F.lit(1), "kind": F.lit("k")}) if extra else df


def test_spans_match_a_plain_scan(spark):
    rng = random.Random(5)
    words = ["password", "=", ":", " ", "'", "secret", "token", "abcdef", "AKIA", "0f" * 13, "A1B2" * 5, "é", "\n", "api", "_", "key"]
    texts = TEXTS + ["".join(rng.choice(words) for _ in range(rng.randint(0, 40))) for _ in range(150)] + TEXTS
    got = {r.doc_id: [tuple(f) for f in r.findings] for r in S.scan(spark, frame(spark, texts, extra=True)).collect()}
    assert got == {i: brute(t or "") for i, t in enumerate(texts)}


def test_second_run_scans_only_what_is_new(spark, tmp_path):
    at = str(tmp_path / "ledger")
    S.scan(spark, frame(spark, ["password=abcdef", "b", "b"]), at).collect()
    before = spark.read.parquet(at).count()
    assert before == 2 * len(S.RULES)
    again = S.scan(spark, frame(spark, ["b", "password=abcdef", "token=uvwxyz"]), at)
    assert [len(r.findings) for r in again.orderBy("doc_id").collect()] == [0, 1, 1]
    assert spark.read.parquet(at).count() == before + len(S.RULES)
    newer = (S.Rule("assign", 2, r"(b)", 1),) + S.RULES[1:]
    got = S.scan(spark, frame(spark, ["b"]), at, newer).first()
    assert [f.kind for f in got.findings] == ["assign"]
    assert spark.read.parquet(at).count() == before + len(S.RULES) + 1


def test_no_rows_and_repeated_rows(spark):
    assert S.scan(spark, frame(spark, [])).count() == 0
    twice = frame(spark, ["secret=abcdef"]).union(frame(spark, ["secret=abcdef"]))
    assert [len(r.findings) for r in S.scan(spark, twice).collect()] == [1, 1]
    nulls = spark.createDataFrame([(None, "secret=abcdef"), (None, None), (3, "secret=abcdef")], "doc_id long, text string")
    assert sorted(len(r.findings) for r in S.scan(spark, nulls).collect()) == [0, 1, 1]
