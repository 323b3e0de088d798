"""Tokenizer alignment: against interval overlap by brute force, and the tokenizers' own libraries."""

import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from panelflow.llm import alignment as L
from tests.conftest import SF


def brute(end_a, end_b):
    start_a, start_b = [0, *end_a][:-1], [0, *end_b][:-1]
    return [(i, j) for i, (s, e) in enumerate(zip(start_a, end_a, strict=True))
            for j, (u, v) in enumerate(zip(start_b, end_b, strict=True)) if max(s, u) < min(e, v)]


@pytest.mark.parametrize("lane", [1, 2, 7, 64])
def test_lockstep_against_overlaps(lane):
    rnd = random.Random(lane)
    for _ in range(40):
        docs, ends = rnd.randrange(0, 5), [0]
        a, b, first = [], [], [0]
        for _ in range(docs):
            size = rnd.choice([0, 1, 5, 60])
            lo = ends[-1]
            a += sorted(rnd.sample(range(lo + 1, lo + size), min(max(0, size - 1), rnd.randrange(20)))) + [lo + size] * (size > 0)
            b += sorted(rnd.sample(range(lo + 1, lo + size), min(max(0, size - 1), rnd.randrange(20)))) + [lo + size] * (size > 0)
            first.append(len(a))
            ends.append(lo + size)
        la, lb, ca, cb = L.lockstep(np.array(a, np.int64), np.array(b, np.int64), np.array(first), lane)
        assert list(zip(la.tolist(), lb.tolist(), strict=True)) == brute(a, b)
        both = set(a) & set(b)
        assert [bool(x) for x in ca] == [x in both for x in a] and [bool(x) for x in cb] == [x in both for x in b]


TEXTS = ["Hello world, it's  a\ttest\n\n  of 123 tokens<|endoftext|> <s></s> <unk>", None, "", " ", "  lead and trail  ", "naïve Ωmega 漢字かな 🙂🙂 ▁x",
         "漢字かな 🙂🙂 é   　 \x00 \x85 ﻿", "a" * 3000, "x y " * 2000, "\r\n\t\x0b\x0c", "Grüße " * 300, "ﬁ Å ① ſ"]


def expected(texts):
    """The contract, text by text, with the libraries that own the files."""
    import sentencepiece
    from tokenizers import Tokenizer
    t = Tokenizer.from_file(f"{L.TOKENIZERS}/{L.FILE_A}")
    t.encode_special_tokens = True
    sp = sentencepiece.SentencePieceProcessor(model_file=f"{L.TOKENIZERS}/{L.FILE_B}")
    letters = L._byte_letters()
    rows, pairs, links = [], Counter(), []
    for text in texts:
        a, b, ab, bb = [], [], [], []
        if text:
            a = t.encode(" " + text, add_special_tokens=False).ids
            b = sp.encode(text)
            ab = [bytes(letters[c] for c in t.id_to_token(x)) for x in a]
            bb = [bytes([int(sp.id_to_piece(x)[1:-1], 16)]) if sp.is_byte(x) else sp.id_to_piece(x).replace("▁", " ").encode() for x in b]
            if b"".join(ab) != (" " + text).encode() or b"".join(bb) != (" " + text).encode():
                a, b, ab, bb = [], [], [], []
        ea, eb = np.cumsum([len(x) for x in ab]).tolist(), np.cumsum([len(x) for x in bb]).tolist()
        own, lo_a, lo_b, groups = [], 0, 0, []
        i = j = 0
        while i < len(a):
            own.append((a[i], b[j]))
            x, y = ea[i], eb[j]
            i, j = i + (x <= y), j + (y <= x)
            if x == y:
                groups.append(",".join(map(str, a[lo_a:i])) + "|" + ",".join(map(str, b[lo_b:j])))
                lo_a, lo_b = i, j
        links.append(own)
        pairs.update(set(own))
        rows.append((len(a), len(b), len(groups), len(own), hashlib.sha256(";".join(groups).encode()).hexdigest() if groups else ""))
    top = Counter()
    for (x, _), n in pairs.items():
        top[x] = max(top[x], n)
    return [(*r[:4], sum(pairs[p] == top[p[0]] for p in own), sum(pairs[p] for p in own), r[4]) for r, own in zip(rows, links, strict=True)]


def got(df):
    return {r.doc_id: tuple(r)[1:] for r in df.collect()}


def test_texts_of_all_kinds(spark):
    df = spark.createDataFrame([(i, t, 1, "x") for i, t in enumerate(TEXTS)], "doc_id long, text string, batch int, pos string").repartition(3)
    assert got(L.link_digests(df)) == dict(enumerate(expected(TEXTS)))


def test_tables_without_tokens(spark):
    df = spark.createDataFrame([(1, None), (2, ""), (2, "")], "doc_id long, text string")
    assert sorted(tuple(r) for r in L.link_digests(df).collect()) == [(1, 0, 0, 0, 0, 0, 0, ""), (2, 0, 0, 0, 0, 0, 0, ""), (2, 0, 0, 0, 0, 0, 0, "")]
    assert L.link_digests(df.limit(0)).collect() == []
    odd = spark.createDataFrame([(None, "a b"), (None, "a b"), (2**60 + 1, "")], "doc_id long, text string")
    # two links, each in two rows; large ids stay exact beside null ones
    assert sorted(((r.doc_id or 0, r.count_sum) for r in L.link_digests(odd).collect())) == [(0, 4), (0, 4), (2**60 + 1, 0)]


def test_alignments_are_what_the_digests_hash(spark):
    df = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string")
    want = dict(enumerate(expected(TEXTS)))
    for r in L.alignments(df).collect():
        n_a, n_b, n_groups, n_links, _, _, sha = want[r.doc_id]
        text = ";".join(",".join(map(str, g.a)) + "|" + ",".join(map(str, g.b)) for g in r.groups)
        assert (len(r.groups), len(r.links)) == (n_groups, n_links)
        assert (hashlib.sha256(text.encode()).hexdigest() if text else "") == sha
        assert sum(len(g.a) for g in r.groups) == n_a and sum(len(g.b) for g in r.groups) == n_b


def test_byte_pairs_equal_the_files_own_library():
    """The split pattern and the ranks give the ids of the file's own library for every character, by itself and beside others."""
    from tokenizers import Tokenizer
    t = Tokenizer.from_file(f"{L.TOKENIZERS}/{L.FILE_A}")
    t.encode_special_tokens = True
    encode, _ = L.byte_pairs(L.TOKENIZERS)
    for lo in range(0, 0x30000, 0x4000):
        texts = [f" x{chr(c)}y {chr(c)}{chr(c)} 1{chr(c)}2  {chr(c)} \n{chr(c)}'s{chr(c)}" for c in range(lo, lo + 0x4000) if not 0xD800 <= c < 0xE000]
        for s, e in zip(texts, t.encode_batch(texts, add_special_tokens=False), strict=True):
            assert encode(s) == e.ids, s


def test_query(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    want = dict(zip([r.doc_id for r in docs], expected([r.text for r in docs]), strict=True))
    assert got(L.op13_alignment(spark, SF)) == want
