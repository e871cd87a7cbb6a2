"""Token alignment against a plain walk over whole encodings."""

import hashlib
import re
from collections import Counter, defaultdict

import sentencepiece
from tokenizers import Tokenizer

from lectern.llm import token_alignment as T


def _vocab(a):
    plain = {i + 0x100: b for i, b in enumerate(b for b in range(256) if not (0x21 <= b <= 0x7E or 0xA1 <= b <= 0xAC or 0xAE <= b <= 0xFF))}
    return {i: bytes(plain.get(ord(c), ord(c)) for c in t) for t, i in a.get_vocab().items() if t != "<|endoftext|>"}


def brute(rows):
    """Whole texts encoded at once, one walk over both cuts of each."""
    a, b = Tokenizer.from_file(T.MODEL_A), sentencepiece.SentencePieceProcessor(model_file=T.MODEL_B)
    a.encode_special_tokens = True
    of_a = _vocab(a)
    of_b = lambda i: bytes.fromhex(m[1]) if (m := re.fullmatch("<0x(..)>", b.id_to_piece(i))) else b.id_to_piece(i).replace("▁", " ").encode()
    docs, holding = [], Counter()
    for key, text in rows:
        groups, links = [], Counter()
        ia = a.encode(" " + text, add_special_tokens=False).ids if text else []
        ib = b.encode(text) if text else []
        if text and b"".join(of_a[i] for i in ia) == (" " + text).encode() == b"".join(map(of_b, ib)):
            left, right = ([], 0), ([], 0)
            rest = iter(ib)
            ends_a = at = 0
            ga, gb = [], []
            for i in ia:
                ends_a += len(of_a[i])
                ga.append(i)
                while at < ends_a:
                    j = next(rest)
                    at += len(of_b(j))
                    gb.append(j)
                if at == ends_a:
                    groups.append((ga, gb))
                    ga, gb = [], []
            for ga, gb in groups:
                links.update((x, y) for x in ga for y in gb)
        else:
            ia, ib = [], []
        holding.update(links.keys())
        docs.append((key, ia, ib, groups, links))
    most = defaultdict(int)
    for (x, _), n in holding.items():
        most[x] = max(most[x], n)
    out = []
    for key, ia, ib, groups, links in docs:
        text = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in groups)
        out.append((key, len(ia), len(ib), len(groups), sum(links.values()), sum(n for p, n in links.items() if holding[p] == most[p[0]]), sum(n * holding[p] for p, n in links.items()), hashlib.sha256(text.encode()).hexdigest() if ia else ""))
    return out


TEXTS = [
    None, "", " ", "  ", "a", " a ", "a  b", "a\n  b", "a \n b\t\tc ", "x   y", "　z  w", "<|endoftext|> and <s> </s> <unk>", "▁ mark▁x", "naïve café — déjà  vu", "数字 と 漢字。 次", "é ẛ̣ ﬁ", "🙂🙃 smile 🙂 .",
    "don't we'll   I'm", "tab\tand\r\nline", "a" * 3000, "1234567 89.10 , ,, ;;", "The thing, then; the thing.\n\nThe end. ", "word " * 50, "\x00\x01 ctl", "ends with spaces   ",
]


def test_odd_texts(spark):
    rows = [(i, t) for i, t in enumerate(TEXTS)] + [(3, "a  b"), (None, "The thing, then")]
    docs = spark.createDataFrame([(t, i, "x") for i, t in rows], "text string, doc_id long, row string").repartition(3)
    got = [tuple(r) for r in T.alignment_report(spark, docs).collect()]
    assert sorted(got, key=str) == sorted(brute(rows), key=str)


def test_little_memory_gives_the_same(spark):
    rows = [(i, " ".join(f"w{(i * k) % 37}or{k % 11}" for k in range(40))) for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(2)
    made = T.aligned(docs, remembered=50, partial=20, chars=300).cache()
    whole = T.aligned(docs).cache()
    keys = lambda d: sorted((r.doc_id, r.n_links, r.groups_sha256, tuple(r.a), tuple(r.b), tuple(r.n)) for r in d.where("row is not null").collect())
    assert keys(made) == keys(whole)
    assert sorted(T.pair_counts(made).collect()) == sorted(T.pair_counts(whole).collect())
    assert made.where("row is null").count() > whole.where("row is null").count()


def test_nothing(spark):
    assert T.alignment_report(spark, spark.createDataFrame([], "doc_id long, text string")).collect() == []
