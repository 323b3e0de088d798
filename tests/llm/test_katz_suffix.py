"""LM scoring and suffix-array dedup against brute force."""

import hashlib
import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from panelflow.llm import katz as K
from panelflow.llm import suffix as X

DOCS = "doc_id long, text string"


def tokens(text):
    return [*(text or "").encode().lower().split(), "</s>"]


class SlowKatz:
    """The model in dictionaries."""

    def __init__(self, docs):
        train = [tokens(t) for d, t in docs if zlib.crc32(str(d).encode()) % 10]
        self.uni = Counter(w for t in train for w in t)
        self.bi = Counter(p for t in train for p in zip(["<s>", *t], t))
        self.n, self.v = sum(self.uni.values()), len(self.uni)
        of = lambda c: [0] + [sum(x == r for x in c.values()) for r in range(1, K.CUTOFF + 2)]
        self.small, self.small2 = K.discounted(of(self.uni)), K.discounted(of(self.bi))
        self.disc = lambda c, s: s[c] if c <= K.CUTOFF else c - K.SLACK
        self.unknown = 1 - sum(self.disc(c, self.small) for c in self.uni.values()) / self.n
        self.after = defaultdict(dict)
        for (h, w), c in self.bi.items():
            self.after[h][w] = c

    def word(self, w):
        return self.disc(self.uni[w], self.small) / self.n if w in self.uni else self.unknown

    def given(self, w, h):
        seen = self.after.get(h)
        if not seen:
            return self.word(w)
        total = sum(seen.values())
        if w in seen:
            return self.disc(seen[w], self.small2) / total
        left = 1 - sum(self.disc(c, self.small2) for c in seen.values()) / total
        return left / (1 - sum(self.word(x) for x in seen)) * self.word(w)


def corpus(n=300, seed=5):
    rnd = random.Random(seed)
    vocab = [f"w{int(rnd.paretovariate(0.7))}" for _ in range(400)]
    return [(i, " ".join(rnd.choice(vocab) for _ in range(rnd.randint(0, 60)))) for i in range(n)]


def test_katz_against_dictionaries(spark):
    docs = corpus()
    docs[7] = (7, docs[7][1].upper() + " Éé \t new\x0bword")
    m = SlowKatz(docs)
    for h in [*list(m.after)[:40], "nothing", "<s>"]:  # exactly normalised over the vocabulary and the unknown word
        assert abs(sum(m.given(w, h) for w in [*m.uni, "?"]) - 1) < 1e-9
    got = {r.doc_id: r for r in K.score(spark.createDataFrame(docs, DOCS)).collect()}
    held = []
    for d, text in docs:
        t = tokens(text)
        r = got[d]
        assert r.held_out == (zlib.crc32(str(d).encode()) % 10 == 0)
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(t), sum(w in m.uni for w in t), m.n)
        base = sum(math.log10((m.uni[w] + 0.1) / (m.n + 0.1 * (m.v + 1))) for w in t)
        want = sum(math.log10(m.given(w, h)) for h, w in zip(["<s>", *t], t))
        assert abs(r.base_score - base) < 1e-5 and abs(r.score - want) < 1e-5
        held.append(r.held_out)
    assert any(held) and not all(held)


def test_katz_edges(spark):
    rows = [(1, None, 1), (None, "a b", 1), (2, "a b a", 1), (2, "a b a", 1), (3, "", 2), (10, "x " * 200_000, 3)]
    df = spark.createDataFrame(rows, "doc_id long, text string, key int").withColumn("train", F.lit(0)).withColumn("n", F.lit(0))
    got = K.score(df).collect()
    assert len(got) == 6 and all(math.isfinite(r.score) and math.isfinite(r.base_score) for r in got)
    assert {r.n_tokens for r in got if r.doc_id == 2} == {4}
    assert [r.held_out for r in got if r.doc_id is None] == [True]
    assert K.score(df.where("false")).count() == 0
    none = K.score(spark.createDataFrame([(None, "a b")], DOCS)).first()
    assert (none.train_tokens, none.n_known, none.score) == (0, 0, 0.0)


@pytest.mark.parametrize("of", [[0, 0, 0, 0, 0, 0, 0], [0, 1000, 300, 150, 90, 60, 40], [0, 5, 0, 9, 1, 1, 1]])
def test_discounts_fall(of):
    d = K.discounted(of)
    assert d[0] == 0 and all(0 < d[r] < r for r in range(1, K.CUTOFF + 1))


def slow_dedup(docs):
    where = {}
    for d, t in docs:
        raw = (t or "").encode()
        for i in range(len(raw) - 49):
            s = raw[i:i + 50]
            where[s] = min(where.get(s, d), d)
    out = {}
    for d, t in docs:
        raw = (t or "").encode()
        gone = np.zeros(len(raw), bool)
        for i in range(len(raw) - 49):
            if where[raw[i:i + 50]] < d:
                gone[i:i + 50] = True
        kept = bytes(b for b, g in zip(raw, gone) if not g)
        out[d] = (len(raw), int(gone.sum()), int((np.diff(gone.astype(int), prepend=0) == 1).sum()),
                  hashlib.sha256(kept).hexdigest())
    return out


def repetitive(seed):
    rnd = random.Random(seed)
    pool = ["".join(rnd.choice("abcd éß\n") for _ in range(rnd.randint(20, 160))) for _ in range(12)]
    docs = [(i, "".join(rnd.choice([rnd.choice(pool), rnd.choice(pool)[5:90], "".join(rnd.choice("xyzab ") for _ in range(rnd.randint(0, 60)))])
                        for _ in range(rnd.randint(0, 6)))) for i in range(60)]
    docs += [(100, "a" * 500), (101, "b" + "a" * 300 + "c"), (102, "a" * 49), (103, "ab" * 200), (104, "ba" * 120), (105, None), (106, "")]
    docs += [(200 + i, docs[3][1] + docs[5][1]) for i in range(30)]
    return docs


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_suffix_dedup_against_all_windows(spark, seed):
    docs = repetitive(seed)
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256)
           for r in X.dedup_repeats(spark.createDataFrame(docs, DOCS).repartition(7)).collect()}
    assert got == slow_dedup(docs)


def test_suffix_edges_and_text(spark):
    p = "A passage of fifty bytes and a little more, as it were, here."
    rows = [(1, p), (1, p), (None, "before " + p), (None, p), (2, "x" + p + "y" + p), (3, "é" * 40)]
    df = spark.createDataFrame(rows, DOCS).withColumn("id", F.lit(1)).withColumn("th", F.lit(1)).withColumn("spans", F.lit(1))
    got = sorted(((r.doc_id, bytes(r.kept).decode(), r.n_spans) for r in X.dedup_repeats(df, with_text=True).collect()), key=repr)
    assert got == sorted([(1, p, 0), (1, p, 0), (None, "before ", 1), (None, "", 1), (2, "xy", 2), (3, "é" * 40, 0)], key=repr)
    assert X.dedup_repeats(df.where("false")).count() == 0


def test_repeat_groups_are_maximal_and_complete(spark):
    p = "".join(random.Random(1).choice("abcdefgh ") for _ in range(64))
    docs = [(1, "one " + p + " end"), (2, "two " + p + " eve"), (3, "tie" + p), (4, "unrelated text of some length that nobody repeats at all")]
    rows = X.repeat_groups(spark.createDataFrame(docs, DOCS)).collect()
    groups = defaultdict(set)
    for r in rows:
        groups[r.repeat, r.length].add((r.doc_id, r.position))
    text = {d: t.encode() for d, t in docs}
    for (name, length), occ in groups.items():
        strings = {text[d][i:i + length] for d, i in occ}
        assert len(strings) == 1 and hashlib.sha256(strings.pop()).hexdigest() == name and length >= 50
        s = text[min(occ)[0]][min(occ)[1]:][:length]
        assert occ == {(d, i) for d, t in text.items() for i in range(len(t)) if t.startswith(s, i)}
    assert (1, 4) in set().union(*groups.values()) or any(i <= 4 for occ in groups.values() for d, i in occ if d == 1)


def test_long_and_inner_repeats_are_whole(spark):
    """Repeats of 300 and 5,000 bytes, a part of one that stands elsewhere too, and one within one document."""
    rnd = random.Random(6)
    fresh = lambda n: "".join(rnd.choice("abcdefgh ") for _ in range(n))
    p, q, r, s = fresh(300), fresh(5000), fresh(90), fresh(75)
    docs = [(1, "A" + p + "B" + fresh(200)), (2, fresh(90) + "C" + p + "D"), (3, "E" + p), (4, "F" + p[40:200] + "G" + fresh(60)),
            (5, "H" + q + "I"), (6, fresh(70) + "J" + q), (7, "K" + r + "L" + r + "M"), (8, s + "N"), (9, s + "O"), (9, s + "O")]
    want = {}
    for x in (p, p[40:200], q, r, s):
        want[hashlib.sha256(x.encode()).hexdigest(), len(x)] = {(d, i) for d, t in docs for i in range(len(t)) if t.startswith(x, i)}
    got = defaultdict(set)
    for row in X.repeat_groups(spark.createDataFrame(docs, DOCS)).collect():
        got[row.repeat, row.length].add((row.doc_id, row.position))
    assert got == want


def test_stack_scan_finds_every_maximal_repeat():
    rnd = random.Random(4)
    for _ in range(60):
        n = rnd.randint(2, 9)
        ctx = list({("".join(rnd.choice("ab") for _ in range(rnd.randint(0, 6))).encode(),
                     b"K" + "".join(rnd.choice("ab") for _ in range(rnd.randint(0, 6))).encode()) for _ in range(n)})
        left, right = [c[0] for c in ctx], [c[1] for c in ctx]
        got = {(l, r, frozenset(m)) for l, r, m in X.maximal_repeats(left, right, 4)}
        want = set()
        for i in range(len(ctx)):
            for j in range(i + 1, len(ctx)):
                l, r = X.common(left[i], left[j]), X.common(right[i], right[j])  # noqa: E741
                if l + r >= 4:
                    want.add((l, r, frozenset(k for k in range(len(ctx)) if X.common(left[k], left[i]) >= l and X.common(right[k], right[i]) >= r)))
        assert got == want


@pytest.mark.parametrize("parts", [8, 400])
def test_anchor_rows_cost_the_same_in_many_buckets(spark, parts):
    """What a document costs per bucket: one key, not its id and its text's hash; short hashes come back as they were."""
    rnd = random.Random(3)
    text = lambda: " ".join(f"w{rnd.randrange(10**6)}" for _ in range(250))
    docs = [(i, text()) for i in range(600)]
    docs += [(1000 + i, docs[i][1][:700] + text()) for i in range(0, 600, 3)]
    rows = X._keyed(spark.createDataFrame(docs, DOCS)).coalesce(1)
    found = {r.key: X.unpacked(bytes(r.hashes)) for r in X._repeated(rows, 1).collect()}
    key = {r.id: r.key for r in rows.collect()}
    assert set(found) >= {key[i] for i in range(0, 600, 3)} | {key[1000 + i] for i in range(0, 600, 3)} and len(found) < 420
    t = X.Texts([docs[0][1], docs[600][1]], fold=False)
    at, h = X.anchors(t)
    both = set(h[at < t.end[0]].tolist()) & set(h[at >= t.begin[1]].tolist())
    assert both and set(X.shorten(np.array(sorted(both), np.uint64)).tolist()) <= set(found[key[0]].tolist())
    n = sum(map(len, (X.anchors(X.Texts([d[1]], fold=False))[1] for d in docs)))
    blobs = X._repeated(rows, parts)._jdf.queryExecution()   # what the shuffle carries
    assert "th" not in blobs.analyzed().output().toString()
    size = _gathered(rows, parts)
    assert size < 14 * n


def _gathered(rows, parts):
    """Bytes that _repeated shuffles."""
    kept = []

    class Rows:
        def select(self, *c):
            return self

        def mapInPandas(self, run, schema):
            kept.extend(len(b) for out in run(iter([rows.toPandas()])) for b in out["blob"])
            return self

        def groupBy(self, *c):
            return self

        def applyInPandas(self, *a):
            return self

    X._repeated(Rows(), parts)
    return sum(kept)


def test_katz_bucket_rows_do_not_grow_with_the_slices(spark):
    """A bucket gives one row per kind and target bucket; the model's figures are held by the tests above."""
    parts, rows = 6, K._keyed(spark.createDataFrame(corpus(), DOCS)).coalesce(1)
    stats = K.unigrams(rows, parts)
    blobs = rows.select("key", "train", "text").mapInPandas(K._gather(parts, stats["words"]), "p int, blob binary").toPandas()
    for _, pdf in blobs.groupby("p"):
        got = K._bucket(parts, stats, K.discounted(stats["types"]))(pdf)
        assert len(got) <= 3 * parts + 1 and not got.duplicated(["kind", "q"]).any()
        assert (got["kind"] == "types").sum() == parts and sum(map(len, got["blobs"])) > len(got)


def test_suffix_bucket_rows_do_not_grow_with_the_documents(spark):
    """A bucket of anchors gives one row per bucket of documents; each document's runs come in one row."""
    rnd = random.Random(7)
    text = lambda n: " ".join(f"w{rnd.randrange(10**6)}" for _ in range(n))
    shared = [text(12) for _ in range(40)]
    docs = [(i, " ".join(rnd.choice([rnd.choice(shared), text(5)]) for _ in range(8))) for i in range(400)]
    _, _, marked, _ = X._prepared(spark.createDataFrame(docs, DOCS))
    blobs = X._contexts(marked, 3).toPandas()
    steps = []

    class Blobs:
        sparkSession = spark

        def groupBy(self, *c):
            return self

        def applyInPandas(self, run, schema):
            steps.append(run)
            return self

        def select(self, *c):
            return self

    X._spans(Blobs())
    dealt = [steps[0](pdf) for _, pdf in blobs.groupby("p")]
    assert all(len(d) <= X.partitions(spark) and d["q"].is_unique for d in dealt)
    spans = pd.concat([steps[1](pdf) for _, pdf in pd.concat(dealt).groupby("q")])
    assert 300 < len(spans) < 400 and not spans.duplicated(["id", "th"]).any()
    want = {d: (gone, n) for d, (_, gone, n, _) in slow_dedup(docs).items() if n}
    got = {}
    for i, raw in zip(spans["id"], spans["spans"], strict=True):
        start, stop = np.frombuffer(raw, "<u4").astype(int).reshape(-1, 2).T
        assert (start[1:] > stop[:-1]).all()
        got[i] = (int((stop - start).sum()), len(start))
    assert got == want


def test_suffix_repeated_anchors_come_in_one_row_a_document(spark):
    """However many hash buckets a document's anchors lie in; a bucket gives one row per bucket of documents."""
    rnd = random.Random(8)
    text = lambda n: " ".join(f"w{rnd.randrange(10**6)}" for _ in range(n))
    shared = [text(12) for _ in range(40)]
    docs = [(i, " ".join(rnd.choice([rnd.choice(shared), text(5)]) for _ in range(8))) for i in range(300)] + [(300, text(30)), (301, None)]
    rows = X._keyed(spark.createDataFrame(docs, DOCS)).repartition(2, "key")
    held = defaultdict(set)
    for key, t in rows.select("key", "text").collect():
        for h in X.shorten(X.anchors(X.Texts([t], fold=False))[1]).tolist():
            held[h].add(key)
    want = defaultdict(set)
    for h, keys in held.items():
        if len(keys) > 1:
            for key in keys:
                want[key].add(h)
    found = X._repeated(rows, 7, to=3)
    got = [(r.key, X.unpacked(bytes(r.hashes)).tolist()) for r in found.collect()]
    assert len({k for k, _ in got}) == len(got) > 200
    assert {k: set(v) for k, v in got} == dict(want) and all(len(set(v)) == len(v) for _, v in got)
