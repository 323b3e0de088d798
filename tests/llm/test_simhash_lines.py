"""SimHash near-dedup and fuzzy line dedup against brute force."""

import os
import random

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from panelflow.llm import graph as G
from panelflow.llm import lines as L
from panelflow.llm import simhash as S
from tests.conftest import SF

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def slow_fingerprint(text):
    words = (text or "").encode().lower().split()
    grams = [b" ".join(words[i:i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    hs = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def slow_components(items, linked):
    root = {k: k for k in items}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    keys = list(items)
    for i, a in enumerate(keys):
        for b in keys[i + 1:]:
            if linked(items[a], items[b]):
                ra, rb = sorted((find(a), find(b)))
                root[rb] = ra
    return {k: find(k) for k in keys}


def test_fingerprint_and_spark_hash_agree(spark):
    text = "The  quick\tBROWN fox\x0b jumps Éà over\x1f the lazy dog"
    assert S.fingerprint(text) == slow_fingerprint(text)
    assert S.fingerprint(None) == S.fingerprint(" \n") == 0
    assert S.fingerprint("one two") == xxhash.xxh64_intdigest(b"one two", 42)
    h = spark.range(1).select(F.xxhash64(F.lit("one two"))).first()[0]
    assert h % (1 << 64) == xxhash.xxh64_intdigest(b"one two", 42)


@pytest.mark.parametrize("wide", [2, 128])
def test_links_give_the_components_of_all_pairs(spark, monkeypatch, wide):
    """Dense clusters, chains at distance 3, copies; through balls (wide = 2) and plain joins."""
    monkeypatch.setattr(S, "WIDE", wide)
    rnd = random.Random(7)
    fps = {0, (1 << 64) - 1}
    for _ in range(12):
        c = rnd.getrandbits(64)
        for _ in range(9):
            fps.add(c)
            for _ in range(rnd.randint(1, 4)):
                c ^= 1 << rnd.randrange(64)
    items = {i: f for i, f in enumerate(sorted(fps))}
    want = slow_components(items, lambda a, b: (a ^ b).bit_count() <= 3)
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    df = spark.createDataFrame([(signed(f),) for f in items.values()], "fp long")
    got_links = S.links(df).collect()
    assert all(((r.a ^ r.b) & (2**64 - 1)).bit_count() <= 3 for r in got_links)
    number = {signed(f): i for i, f in items.items()}
    from panelflow.llm.graph import components
    roots = {r.node: r.root for r in components(S.links(df)).collect()}
    groups = {}
    for fp, i in number.items():
        groups.setdefault(roots.get(fp, fp), set()).add(i)
    expect = {}
    for i, r in want.items():
        expect.setdefault(r, set()).add(i)
    assert sorted(map(sorted, groups.values())) == sorted(map(sorted, expect.values()))


def test_no_table_of_fingerprints_is_broadcast(spark, monkeypatch):
    """Tables that grow with the input stay out of the driver, however small Spark takes them to be."""
    from panelflow.llm import graph as G
    plans = []
    for module in (S, G):
        monkeypatch.setattr(module, "cut", lambda df, *a, real=module.cut: plans.append(df._jdf.queryExecution().toString()) or real(df, *a))
    rows = [(i, f"w{i % 40} is one of {i % 40} words", "en", "s", 0) for i in range(400)]
    out = S.representatives(spark.createDataFrame(rows, DOCS))
    plans.append(out._jdf.queryExecution().toString())
    assert out.count() and len(plans) > 5
    assert any("SortMergeJoin" in p for p in plans) and not any("Broadcast" in p for p in plans)


def test_near_dedup_edges(spark):
    rows = [(5, None, "en", "s", 0), (7, "", "en", "s", 0), (3, "a b c d", None, None, None), (9, "A b  C d", "x", "s", 1),
            (9, "A b  C d", "x", "s", 1), (None, "a b c d", "x", "s", 1), (None, "zzz", "x", "s", 1),
            (20, "word " * 100_000, "x", "s", 1)]
    df = spark.createDataFrame(rows, DOCS).withColumn("fp", F.lit(1)).withColumn("component_id", F.lit(2))
    got = sorted(((r.doc_id, r.component_id) for r in S.near_dedup(df).collect()), key=repr)
    assert got == sorted([(5, 5), (7, 5), (3, 3), (9, 3), (9, 3), (None, 3), (None, None), (20, 20)], key=repr)
    kept = S.representatives(df)
    assert kept.columns == df.columns
    assert sorted((r.doc_id for r in kept.collect()), key=repr) == sorted([5, 3, None, None, 20], key=repr)
    assert S.near_dedup(df.where("false")).count() == 0


def edit(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


@pytest.mark.parametrize("n", [0, 1, 2, 5, 254, 255, 256, 700])
def test_line_simhashes(n):
    rng = np.random.default_rng(n)
    h = rng.integers(0, 2**64, n + 40, dtype=np.uint64)
    got = L.simhashes(h, np.array([0, n, n, n + 3, n + 40]))
    for g, (lo, hi) in zip(got.tolist(), [(0, n), (n, n), (n, n + 3), (n + 3, n + 40)], strict=True):
        assert g == sum(1 << b for b in range(64) if 2 * sum(int(x) >> b & 1 for x in h[lo:hi]) > hi - lo)


def test_within_is_the_edit_distance():
    rnd = random.Random(1)
    for _ in range(1500):
        a = "".join(rnd.choice("abé") for _ in range(rnd.randrange(14)))
        b = list(a if rnd.random() < 0.6 else "".join(rnd.choice("abé") for _ in range(rnd.randrange(14))))
        for _ in range(rnd.randrange(4) if b else 0):
            b[rnd.randrange(len(b))] = rnd.choice(["a", "x", "", "bb"])
        b = "".join(b)
        d = edit(a, b)
        assert [L.within(a, b, m) for m in range(9)] == [d <= m for m in range(9)]


@pytest.mark.parametrize(("letters", "longest"), [("ab ", 30), ("abcdé ", 90), ("ab\U0001f600漢 ", 60)])
def test_tables_side_by_side_are_the_edit_distance(letters, longest):
    rnd, pairs = random.Random(longest), []
    for _ in range(700):
        a = [rnd.choice(letters) for _ in range(rnd.randrange(longest))]
        b = list(a) if rnd.random() < 0.8 else [rnd.choice(letters) for _ in range(rnd.randrange(longest))]
        for _ in range(rnd.randrange(1 + len(b) // 3)):
            b[rnd.randrange(len(b))] = rnd.choice(["a", "x", "", "bb"])
        pairs.append(("".join(a), "".join(b)))
    for least in (0.8, 0.5):
        got = L.alike([a for a, _ in pairs], [b for _, b in pairs], least)
        want = [edit(a, b) <= int(max(len(a), len(b)) * (1 - least) + 1e-9) for a, b in pairs]
        assert got.tolist() == want and any(want) and not all(want)


@pytest.mark.parametrize("pieces", [1, 2])
def test_second_comparison_gives_no_more_links_than_lines(pieces):
    """A block of lines that are all near and alike: a tree of links, not every pair; copies in another block give none."""
    n = 120
    x = {"block": np.repeat([16, 32], n), "piece": np.repeat([0, 0], n), "node": np.tile(np.arange(n), 2), "own": np.tile(np.arange(n) % pieces, 2), "sub": np.zeros(2 * n, np.int64),
         "root": np.tile(np.arange(n), 2), "bits": np.full(2 * n, 64), "n_chars": np.full(2 * n, 30),
         "sh": np.zeros(2 * n, np.uint64), "sg": np.zeros(2 * n, np.uint64)}
    x["text"] = np.array([f"one line of many alike, nr {i:03}" for i in x["node"]], object)
    x["blocks"] = np.empty(2 * n, object)
    x["blocks"][:] = [[32, 16]] * (2 * n)
    links = L._linked(0.8)(x, np.array([0, n]))
    groups = {i: i for i in range(n)}
    for _ in range(n):
        for a, b in links:
            groups[a] = groups[b] = min(groups[a], groups[b])
    assert len(links) == n - 1 and set(groups.values()) == {0}


def alike(a, b):
    """The rule alone."""
    return len(a) and 1 - edit(a, b) / max(len(a), len(b)) >= 0.8


def reworded(rnd, words, vocab, least, most):
    """A line of edit similarity in [least, most) to another, by replaced, dropped and added words."""
    line = " ".join(words)
    while True:
        ws = list(words)
        for _ in range(rnd.randint(1, max(1, len(ws) // 4))):
            i, kind = rnd.randrange(len(ws)), rnd.random()
            ws[i:i + 1] = [rnd.choice(vocab)] if kind < 0.7 else [] if kind < 0.85 and len(ws) > 1 else [ws[i], rnd.choice(vocab)]
        s = 1 - edit(line, " ".join(ws)) / max(len(line), len(" ".join(ws)))
        if least <= s < most:
            return ws


@pytest.mark.parametrize(("low", "high"), [(4, 10), (11, 20), (21, 40), (41, 80), (81, 120)])
def test_recall_of_candidates_by_length(spark, low, high):
    """At least 0.9 of the pairs of similarity 0.8 and more are compared, at each length, hard pairs (below 0.9) alone too."""
    rnd = random.Random(low)
    vocab = ["".join(rnd.choice("abcdefghij") for _ in range(rnd.randint(2, 8))) for _ in range(400)]
    found = {}
    for least, most, n in ((0.8, 0.9, 60), (0.9, 1.0, 60)):
        hit = 0
        for _ in range(n):
            a = [rnd.choice(vocab) for _ in range(rnd.randint(low, high))]
            both = L._signatures([" ".join(a), " ".join(reworded(rnd, a, vocab, least, most))])
            x = {c: both[c].to_numpy() for c in L._KNOWN}
            x |= {c: x[c].view(np.uint64) for c in ("sh", "sg")}
            hit += bool(set(both["blocks"][0]) & set(both["blocks"][1])) and bool(L._alike(x, x)[0, 1])
        found[least] = hit / n
    assert min(found.values()) >= 0.9, found


@pytest.mark.parametrize("piece", [3, 50_000])
def test_lines_against_all_pairs(spark, monkeypatch, piece):
    """Groups by the similarity rule alone, all pairs of lines compared."""
    monkeypatch.setattr(L, "PIECE", piece)
    rnd = random.Random(3)
    vocab = ["".join(rnd.choice("abcdefghij") for _ in range(rnd.randint(2, 8))) for _ in range(200)]
    base = [[rnd.choice(vocab) for _ in range(n)] for n in (3, 8, 15, 25, 40, 60)]
    docs = []
    for d in range(40):
        out = []
        for _ in range(rnd.randint(1, 4)):
            ws = rnd.choice(base)
            if rnd.random() < 0.7:
                ws = reworded(rnd, ws, vocab, 0.7, 1.01)
            line = " ".join(ws)
            out.append(rnd.choice([line, line.upper(), "  " + line, "", line]))
        docs.append((d, "\n".join(out), "en", "s", 0))
    df = spark.createDataFrame(docs, DOCS).repartition(3)
    seen = {}
    for d, text, *_ in docs:
        for p, line in enumerate(text.split("\n")):
            if line.split():
                seen.setdefault(" ".join(line.lower().split()), (d, p))
    items = {place: norm for norm, place in sorted(seen.items(), key=lambda x: x[1])}
    roots = slow_components(items, alike)
    first = {norm: roots[place] for norm, place in seen.items()}
    want = {(d, p): first[" ".join(line.lower().split())] == (d, p) for d, text, *_ in docs
            for p, line in enumerate(text.split("\n")) if line.split()}
    assert {(r.doc_id, r.pos): r.keep for r in L.line_groups(df).collect()} == want
    out = {r.doc_id: r for r in L.dedup_lines(df).collect()}
    for d, text, *_ in docs:
        keep = [x for p, x in enumerate(text.split("\n")) if want.get((d, p), True)]
        assert out[d].text == "\n".join(keep)
        assert out[d].n_removed == sum(not want.get((d, p), True) for p in range(len(text.split("\n"))))


@pytest.mark.parametrize("unit", [2, 500])
def test_second_comparison_is_whole_in_small_units(spark, monkeypatch, unit):
    """Lines around the bar, most of them not alike: the groups are those of all pairs, however a block is dealt."""
    monkeypatch.setattr(L, "UNIT", unit)
    rnd = random.Random(9)
    vocab = ["".join(rnd.choice("abcdefghij") for _ in range(rnd.randint(2, 8))) for _ in range(200)]
    base = [[rnd.choice(vocab) for _ in range(n)] for n in (12, 20, 30)]
    lines = sorted({" ".join(reworded(rnd, base[i % 3], vocab, 0.78, 0.9)) for i in range(45)})
    roots = slow_components(dict(enumerate(lines)), alike)
    df = spark.createDataFrame([(d, x, "en", "s", 0) for d, x in enumerate(lines)], DOCS)
    got = {r.doc_id: r.keep for r in L.line_groups(df).collect()}
    assert got == {d: roots[d] == d for d in range(len(lines))} and 0 < sum(got.values()) < len(lines)


def test_recall_on_the_drivers_lines(spark):
    """Of all pairs of lines of the documents that the rule links, at least 0.9 end in one group (all pairs tried)."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    norms = {}
    for r in docs.select("doc_id", "text").collect():
        for p, line in enumerate((r.text or "").split("\n")):
            if line.split():
                norms.setdefault(L.normal(line), (r.doc_id, p))
    lines = sorted(norms, key=len)
    grams = [{x[i:i + 3] for i in range(len(x) - 2)} for x in lines]
    pairs = []
    for i, a in enumerate(lines):
        for j in range(i + 1, len(lines)):
            n = len(lines[j])
            if len(a) < 0.8 * n:
                break
            # an edit destroys at most three 3-grams: fewer in common can't be near
            if len(grams[j]) - len(grams[j] & grams[i]) <= 3 * int(0.2 * n + 1e-9) and L.within(a, lines[j], int(0.2 * n + 1e-9)):
                pairs.append((a, lines[j]))
    occ = L.occurrences(docs)
    node = {(r.doc_id, r.pos): (r.h1, r.h2) for r in occ.collect()}
    sign = {(r.h1, r.h2): r for r in occ.where("blocks IS NOT NULL").collect()}
    hit = 0
    for a, b in pairs:
        x, y = sign[node[norms[a]]], sign[node[norms[b]]]
        u, v = ({c: np.array([r[c]], np.uint64 if c in ("sh", "sg") else int) for c in L._KNOWN}
                for r in ({**r.asDict(), "sh": r.sh % 2**64, "sg": r.sg % 2**64} for r in (x, y)))
        hit += bool(set(x.blocks) & set(y.blocks)) and bool(L._near(u, v)[0])
    assert len(pairs) > 20 and hit >= 0.9 * len(pairs), (hit, len(pairs))


def test_line_edges(spark):
    long = "\n".join(f"line number {i} of many {i * 7919 % 10007}" for i in range(3000))
    rows = [(1, "x y z\n\n\nx  Y z", "en", "s", 0), (2, None, None, None, None), (3, "", "en", "s", 0), (1, "x y z\n\n\nx  Y z", "en", "s", 0),
            (None, "x y z\nother", "en", "s", 0), (4, long, "en", "s", 0), (5, "X Y Z", "en", "s", 0)]
    df = spark.createDataFrame(rows, DOCS).withColumns({c: F.lit(1) for c in ("node", "th", "_d", "_t", "_th", "_row", "_flags")})
    got = sorted(((r.doc_id, r.text if r.doc_id != 4 else r.n_lines, r.n_removed) for r in L.dedup_lines(df).collect()), key=repr)
    assert got == sorted([(1, "x y z\n\n", 1), (1, "x y z\n\n", 1), (2, None, 0), (3, "", 0), (None, "other", 1), (4, 3000, got[[g[0] for g in got].index(4)][2]), (5, "", 1)], key=repr)
    assert L.dedup_lines(df.where("false")).count() == 0


def test_line_counts_of_the_documents_stay(spark):
    df = spark.createDataFrame([(1, "a b c\nA b  c", "mine", 7.5)], "doc_id long, text string, n_lines string, n_removed double")
    got = L.dedup_lines(df)
    assert got.columns == df.columns and [tuple(r) for r in got.collect()] == [(1, "a b c", "mine", 7.5)]


def test_representatives_keep_columns_of_any_name(spark):
    df = spark.createDataFrame([(1, "a b c", 7, 3, "x"), (2, "a b c", 8, 4, "y")], "doc_id long, text string, _n int, _row int, component_id string")
    got = S.representatives(df)
    assert got.columns == df.columns and [tuple(r) for r in got.collect()] == [(1, "a b c", 7, 3, "x")]


def test_component_tables_shrink_from_round_to_round(spark, monkeypatch):
    """A path in order, a star and scattered pairs: right roots, and all rounds' tables together in proportion to the nodes."""
    rnd = random.Random(5)
    links = [(i, i + 1) for i in range(1000)] + [(5000, 5001 + i) for i in range(300)]
    links += [(rnd.getrandbits(62), -rnd.getrandbits(62)) for _ in range(300)] + [(7, 7), (9000, 9000), (None, 3)]
    up = {}

    def top(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for a, b in links[:-1]:
        a, b = sorted((top(a), top(b)))
        up[b] = a
    made, real = [], G.cut

    def counted(df):
        out = real(df)
        made.append(out.count())
        return out

    monkeypatch.setattr(G, "cut", counted)
    got = G.components(spark.createDataFrame(links, "a long, b long"))
    assert {r.node: r.root for r in got.collect()} == {x: top(x) for x in list(up)} and got.count() == len(up)
    assert sum(made) < 7 * len(up)
    assert G.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_blocks_are_shuffled_without_signatures(spark, monkeypatch):
    """Most blocks are one line's; signatures are joined to the others."""
    monkeypatch.setattr(L, "cut", lambda df: df)
    lines = spark.createDataFrame([(n, [1, 10 + n] if n < 3 else [100 + n], n, -n, 3, 20) for n in range(6)],
                                  "node long, blocks array<long>, sh long, sg long, bits int, n_chars int")
    rows = L.shared_blocks(lines)
    assert sorted(tuple(r) for r in rows.select("block", "piece", "node", "sh", "sg").collect()) == [(1, 0, n, n, -n) for n in range(3)]

    def nodes(plan):
        yield plan
        for i in range(plan.children().size()):
            yield from nodes(plan.children().apply(i))

    windows = [p for p in nodes(rows._jdf.queryExecution().optimizedPlan()) if p.nodeName() == "Window"]
    assert windows and not any("sh#" in p.output().toString() for p in windows)


def test_lines_of_one_hash_are_numbered_apart(spark):
    rows = [(8, 1), (8, 2), (32, 3), (64, 4)]
    table = lambda some: L.cut(spark.createDataFrame(some, "h1 long, h2 long"))
    assert sorted((r.h1, r.h2, r.node) for r in L._numbered(table(rows)).collect()) == [(8, 1, 8), (8, 2, 9), (32, 3, 32), (64, 4, 64)]
    alone = L._numbered(table(rows[1:]))
    assert sorted((r.h2, r.node) for r in alone.collect()) == [(2, 8), (3, 32), (4, 64)]
    assert "Exchange" not in alone._jdf.queryExecution().executedPlan().toString()


def test_hashes_added_as_words_give_the_same_bits():
    rnd = np.random.default_rng(5)
    for sizes in ([0, 1, 14, 15, 16, 0, 253, 254, 255, 256, 270, 3900, 0], [1, 2, 3, 0, 4], [300], []):
        first = np.concatenate(([0], np.cumsum(sizes))).astype(np.int64)
        h = rnd.integers(0, 2**63, first[-1], dtype=np.uint64) * np.uint64(2) + rnd.integers(0, 2, first[-1], dtype=np.uint64)
        slow = [sum(1 << b for b in range(64) if 2 * sum(int(x) >> b & 1 for x in h[i:j]) > j - i) for i, j in zip(first[:-1], first[1:], strict=True)]
        assert L.simhashes(h, first).tolist() == slow


def test_forests_of_small_runs_are_those_of_one_run():
    rnd = np.random.default_rng(6)
    size = np.array([3, 64, 5, 40, 3, 17, 64, 9])
    start = np.concatenate(([0], np.cumsum(size)[:-1]))
    n = size.sum()
    word = rnd.integers(0, 2**64, 4, dtype=np.uint64)[rnd.integers(0, 4, n)]
    flip = lambda bits: np.bitwise_or.reduce(np.uint64(1) << rnd.integers(0, 64, (n, bits), dtype=np.uint64), axis=1)
    x = {"node": np.sort(rnd.integers(-2**62, 2**62, n)), "sh": word ^ flip(12), "sg": word ^ flip(11), "bits": np.full(n, 18, np.int32), "n_chars": rnd.integers(80, 110, n).astype(np.int32)}
    for small in (1, 5000, 1 << 30):
        L.SMALL, was = small, L.SMALL
        got = L._small_forests(x, start, size)
        L.SMALL = was
        assert len(got) > n // 4
        assert sorted(got) == sorted(e for i, k in zip(start, size, strict=True) for e in L._forest({c: v[i:i + k] for c, v in x.items()}))
    assert L._small_forests(x, start[:0], size[:0]) == []


def signed(rnd, n, words=4):
    """``n`` lines in two pieces whose signatures are near one of ``words`` others, in four components."""
    word = rnd.integers(0, 2**64, words, dtype=np.uint64)[rnd.integers(0, words, n)]
    flip = lambda bits: np.bitwise_or.reduce(np.uint64(1) << rnd.integers(0, 64, (n, bits), dtype=np.uint64), axis=1)
    return {"block": np.full(n, 32), "piece": np.repeat(np.arange(3), -(-n // 3))[:n], "own": rnd.integers(0, 2, n).astype(np.int32),
            "node": np.arange(n), "root": rnd.integers(0, 4, n), "sh": word ^ flip(9), "sg": word ^ flip(10),
            "bits": np.full(n, 18, np.int32), "n_chars": rnd.integers(80, 140, n).astype(np.int32)}


@pytest.mark.parametrize("words", [60, 150])
def test_open_lines_are_those_of_all_pairs(words):
    """Taken in order of length, no line near one of another component is missed and none is kept beside these."""
    rnd = np.random.default_rng(words)
    x = signed(rnd, 300, words)
    x["own"][:100] = 1                  # the first unit is one piece: its lines are compared with each other
    got = L._open_lines(x, np.array([0, 100, 200]))
    want = []
    for lo in (0, 100, 200):
        y = {c: v[lo:lo + 100] for c, v in x.items()}
        near = L._alike(y, y) & (y["root"][:, None] != y["root"][None, :])
        if lo:
            near &= y["own"][:, None] != y["own"][None, :]
        want += y["node"][near.any(axis=1)].tolist()
    assert sorted(got["node"]) == want and 20 < len(want) < 300
    assert got["sh"].tolist() == x["sh"].view(np.int64)[got["node"].to_numpy()].tolist()


def test_second_comparison_shuffles_texts_of_near_lines_alone(spark):
    """Lines that share a block with a thousand lines far from them are not dealt again, whatever the block's size."""
    rnd = np.random.default_rng(9)
    x = signed(rnd, 1200)
    x["piece"][:], x["own"][:], x["root"] = 0, 0, x["node"]
    x["sh"], x["sg"] = rnd.integers(0, 2**64, (2, 1200), dtype=np.uint64)
    for c in ("sh", "sg", "n_chars"):
        x[c][7] = x[c][900]             # the only two lines near each other
    rows = [(32, 0, 0, i, i, int(a), int(b), 18, int(n)) for i, a, b, n in
            zip(range(1200), x["sh"].view(np.int64), x["sg"].view(np.int64), x["n_chars"], strict=True)]
    far = spark.createDataFrame(rows, "block long, piece int, own int, node long, root long, sh long, sg long, bits int, n_chars int")
    assert sorted(r.node for r in L._compared(far).collect()) == [7, 900]


def test_texts_in_turn_are_those_at_once(spark):
    docs = spark.createDataFrame([(i if i % 5 else None, f"first  Line {i}\n\nthird of {i % 3}", None, None, None) for i in range(30)], DOCS)
    places = docs.select("doc_id", F.xxhash64("text").alias("th"), F.explode(F.array(F.lit(0), F.lit(2))).alias("pos")).withColumn("node", F.monotonically_increasing_id())
    places = L.cut(places)
    once = sorted(map(tuple, L._line_texts(docs, places).collect()))
    parts = L.cut_in_turn(spark, (L._line_texts(docs, places, i, 3) for i in range(3)))
    assert sorted(map(tuple, parts.collect())) == once and len(once) == 60
    L.discard(parts, places)
    assert not parts.inputFiles() or not any(map(os.path.exists, (f.removeprefix("file://") for f in parts.inputFiles())))
