"""The contract queries on the smallest tables: columns and types, oracles where there are some, brute force elsewhere."""

import hashlib

import duckdb
import pytest

from lectern.llm import queries

from .test_exact_digest import canon
from .test_media_chunks import check as check_media
from .test_mixture import brute_draws, brute_targets, place_of
from .test_simhash import brute_components, brute_print
from .test_token_alignment import brute as brute_alignment

COLUMNS = {
    "op1_secret_ledger": "doc_id bigint, n_assign bigint, n_access bigint, n_hex bigint, base_sha256 string, spans string",
    "op2_simhash": "doc_id bigint, fingerprint string, component_id bigint",
    "op4_line_dedup": "doc_id bigint, n_lines bigint, n_dropped bigint, kept_sha256 string",
    "op5_exact_digest": "doc_id bigint, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double",
    "op6_toxicity": "doc_id bigint, held_out boolean, score double, predicted int",
    "op7_media_chunks": "doc_id bigint, n_bytes bigint, payload_bytes bigint, payload_sha256 string, tail_crc32 bigint, media_bytes bigint, media_sha256 string, feature string",
    "op8_mixture": "doc_id bigint, size bigint, source_size bigint, target double, taken bigint",
    "op9_language_id": "doc_id bigint, held_out boolean, lang_pred string, score double",
    "op10_warc_index": "page_id bigint, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint",
    "op11_prefix_trie": "conv_id bigint, depth bigint, parent_conv_id bigint, n_convs bigint, n_children bigint, n_leaves bigint, saved_tokens bigint, ends_sha256 string",
    "op12_token_alignment": "doc_id bigint, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, n_best bigint, count_sum bigint, groups_sha256 string",
    "op13_jaccard_join": "doc_id bigint, n_shingles bigint, component_id bigint",
}


@pytest.fixture(scope="module")
def found(spark, sf_dir):
    return {name: queries.queries()[name](spark, sf_dir).cache() for name in COLUMNS}


@pytest.fixture(scope="module")
def docs(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet").orderBy("doc_id").collect()


@pytest.mark.parametrize("name", COLUMNS)
def test_columns_and_rows(found, docs, spark, sf_dir, name):
    types = dict(found[name].dtypes)
    assert {c: types.get(c) for c in (x.split()[0] for x in COLUMNS[name].split(", "))} == dict(x.split() for x in COLUMNS[name].split(", "))
    assert list(types)[: len(COLUMNS[name].split(", "))] == [x.split()[0] for x in COLUMNS[name].split(", ")]
    if name != "op11_prefix_trie":  # a row a node
        assert found[name].count() == (spark.read.parquet(f"{sf_dir}/pages.parquet").count() if name.startswith("op10") else len(docs))


@pytest.mark.parametrize("name", queries.oracle_sql())
def test_oracles(found, sf_dir, name):
    con = duckdb.connect()
    for t in ("documents", "pages", "conversations"):
        con.sql(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    want = con.sql(queries.oracle_sql()[name])
    order = sorted(want.columns)
    assert sorted((tuple(r[c] for c in order) for r in found[name].collect()), key=str) == sorted(want.select(*order).fetchall(), key=str)


def test_op2(found, docs):
    prints = [brute_print(d.text) for d in docs]
    roots = brute_components(prints, 2)
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in found["op2_simhash"].collect()}
    assert got == {d.doc_id: (f"{p:016x}", docs[r].doc_id) for d, p, r in zip(docs, prints, roots, strict=True)}


def test_op5(found, docs):
    got = {r.doc_id: r for r in found["op5_exact_digest"].collect()}
    for at, d in enumerate(docs):  # the next document is the one before in ascending order
        after, k = docs[at - 1].text, len(d.text) // 3
        edit, r = d.text[: len(d.text) - k] + after[:k], got[d.doc_id]
        assert r.edited_sha256 == hashlib.sha256(edit.encode()).hexdigest() and r.n_chars == len(d.text)
        assert (r.near_edited, r.near_next) == (float(canon(edit) == canon(d.text)), float(canon(after) == canon(d.text)))


def test_op7(found, docs):
    check_media([(d.doc_id, d.text) for d in docs], found["op7_media_chunks"].collect())


def test_op8(found, docs, spark):
    got = {r.doc_id: r for r in found["op8_mixture"].collect()}
    size = {d.doc_id: len((d.text or "").encode().split()) for d in docs}
    sizes = {}
    for d in docs:
        sizes[d.source] = sizes.get(d.source, 0) + size[d.doc_id]
    want = brute_targets(sizes)
    passes, _ = brute_draws([(d.doc_id, d.source, d.text) for d in docs], place_of(spark, size), {d.source: got[d.doc_id].target for d in docs}, size)
    for d in docs:
        r = got[d.doc_id]
        assert (r.size, r.source_size, r.taken) == (size[d.doc_id], sizes[d.source], size[d.doc_id] * len(passes[d.doc_id])) and r.target == pytest.approx(want[d.source])


def test_op12(found, docs):
    got = sorted(tuple(r) for r in found["op12_token_alignment"].collect())
    assert got == sorted(brute_alignment([(d.doc_id, d.text) for d in docs]))
