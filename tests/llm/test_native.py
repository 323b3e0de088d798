"""Mixing, chat formatting, fixity audit and url filters: edge cases and brute force."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from panelflow.llm import chat as C
from panelflow.llm import mixing as M
from panelflow.llm import urls as U
from panelflow.llm import warc as R
from panelflow.llm.graph import components
from panelflow.llm.prefix import prefix_sums


def test_components(spark):
    rnd = random.Random(2)
    links = [(i, i + 1) for i in range(60)] + [(1000, 1000 + i) for i in range(1, 50)] + [
        (rnd.randrange(200, 400), rnd.randrange(200, 400)) for _ in range(150)] + [(7, 7)]
    got = {r.node: r.root for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    root = {x: x for p in links for x in p}
    for _ in range(200):
        for a, b in links:
            root[a] = root[b] = min(root[a], root[b])
    assert got == root
    none = spark.createDataFrame([(None, 1)], "a long, b long")
    assert components(none).count() == 0


def test_prefix_sums(spark):
    rnd = random.Random(1)
    rows = [(rnd.choice(["a", "b", None]), rnd.randrange(4), rnd.randrange(3), rnd.randrange(5), rnd.randrange(1, 9)) for _ in range(300)]
    df = spark.createDataFrame(rows, "g string, x int, t int, r int, v int")
    got = sorted((tuple(r) for r in prefix_sums(df, ["g"], ["x", "t"], ["r", "v"], F.col("v")).collect()), key=repr)
    want = []
    for g in {r[0] for r in rows}:
        total = 0
        for r in sorted(r for r in rows if r[0] == g) if g else sorted((r[1:] for r in rows if r[0] is None)):
            r = r if g else (None, *r)
            want.append((*r, total))
            total += r[4]
    assert got == sorted(want, key=repr)


def targets(spark, sizes, **k):
    df = spark.createDataFrame(sizes, "source string, source_size long")
    return {r.source: r.target for r in M.source_targets(df, **k).collect()}


def test_targets(spark):
    assert targets(spark, [("a", 100), ("b", 100), ("c", 100), ("d", 100)]) == pytest.approx(
        {"a": 400 * 5 / 13, "b": 400 * 2 / 13, "c": 400 / 13, "d": 400 * 5 / 13})
    got = targets(spark, [("a", 10), ("b", 1000), ("c", 0), (None, 90)])  # weights 5 2 1 5
    # a stops at 30, c at 0, null at 270; b takes the rest
    assert got == pytest.approx({"a": 30, "b": 800, "c": 0, None: 270})
    assert targets(spark, [("a", 0)]) == {"a": 0}


def test_mix(spark):
    rnd = random.Random(3)
    rows = [(i, "w " * rnd.randint(0, 40), rnd.choice(["a", "b", "c", None]), 1) for i in range(2000)]
    rows += [(5000, "x y z", "b", 1)] * 3 + [(None, "x y", "a", 1), (None, None, None, 1), (6000, "long " * 200_000, "big", 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, size int").withColumn("target", F.lit(0)).withColumn("_tie", F.lit(0))
    got = M.mix(df).collect()
    assert len(got) == len(rows)
    taken, size = {}, {}
    for r in got:
        assert 0 <= r.copies <= 3 and r.copies in (int(r.target / max(r.source_size, 1)), int(r.target / max(r.source_size, 1)) + 1, 3)
        taken[r.source] = taken.get(r.source, 0) + r.copies * r.size
        size[r.source] = (r.source_size, r.target)
    for s in ("a", "b", "c", None):
        assert abs(taken[s] - size[s][1]) <= 120  # three of the largest documents
    key = lambda rs: sorted(map(repr, rs))
    assert key(M.mix(df.repartition(5)).collect()) == key(got)
    mixed = M.mixed_documents(df)
    assert mixed.columns == df.columns and mixed.count() == sum(r.copies for r in got)
    assert M.mix(df.where("false")).count() == 0


def test_chat_round_trip(spark):
    texts = ["", None, "plain", "<|im_start|>user\nhi<|im_end|>\n", "\\p \\s \\ <| <\\p |", "a<", "|b", "<|im_next|>", "é\n\n", "x" * 100_000]
    roles = ["user", "assistant", "assistant", "system", None, "odd\nrole <|\\"]
    rnd = random.Random(5)
    rows = [(c, t, rnd.choice(roles), rnd.choice(texts)) for c in [1, 2, 3, None] for t in [0, 1, 1, 2, 3, 4, 5, None]]
    rows += [rows[0]] * 2
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("turns", F.lit(1)).withColumn("segments", F.lit(1))
    out = C.format_chats(df)
    got = {r.conv_id: r for r in out.withColumn("back", C.read_turns(F.col("formatted"))).withColumn("loss", C.masked_text(F.col("segments"))).collect()}
    assert set(got) == {1, 2, 3, None}
    for c, r in got.items():
        mine = sorted(((t is None, t or 0, role or "", text or "") for cc, t, role, text in rows if cc == c))
        assert [(x.role, x.text) for x in r.back] == [x[2:] for x in mine]
        assert r.loss == "".join(x[3] for x in mine if x[2] == "assistant")
        assert "".join(s.text for s in r.segments) == r.formatted
        runs = sum(1 for i, x in enumerate(mine) if i == 0 or mine[i - 1][2] != x[2])
        assert r.formatted.count("<|im_start|>") == runs == r.formatted.count("<|im_end|>")
    assert C.format_chats(df.where("false")).count() == 0


def slow_judge(url, rules):
    host = path = ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        cut = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
        host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in rest[:cut])
        path = rest[cut:].split("?")[0].split("#")[0]
    best = None
    for verdict, h, p in rules:
        if (host == h or host.endswith("." + h)) and path.startswith(p):
            best = max(best or (-1,), (len(h + p), len(h), h + p, verdict))
    return host, path, best[2] if best else None, best[3] if best else "allow"


@pytest.mark.parametrize("many", [False, True])
def test_url_rules(spark, many):
    rnd = random.Random(8)
    labels, parts = ["a", "b", "example", "net", "org", "com", "", "x-y"], ["/", "/en", "/en/", "/en/x", "/de/", "", "/é", "/EN/"]
    rules = list(U.RULES)
    if many:
        rules = list({(h, p): (rnd.choice(["allow", "block"]), h, p) for h, p in {
            (".".join(rnd.choice(labels[:6]) for _ in range(rnd.randint(1, 3))), rnd.choice(parts)) for _ in range(60)}}.values())
    urls = [rnd.choice(["http://", "https://", "", "HTTP://"]) + ".".join(rnd.choice(labels).upper() if rnd.random() < .2 else rnd.choice(labels) for _ in range(rnd.randint(1, 5)))
            + rnd.choice(parts) + rnd.choice(["", "?q=/en/", "#/de/", "/en/"]) for _ in range(400)]
    urls += [None, "", "://", "http://", "http://net", "http://net/", "http://NET/#a", "http://a://b/", "http://" + "a." * 3000 + "net/x" * 3000] + urls[:20]
    rows = [(i if i % 50 else None, u, "h") for i, u in enumerate(urls)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("host", F.lit("z")).withColumn("rule", F.lit("z"))
    got = sorted(map(repr, map(tuple, U.filter_urls(df, U.rule_table(spark, rules)).collect())))
    assert got == sorted(repr((i, *slow_judge(u, rules))) for i, u, _ in rows)
    assert U.filter_urls(df.where("false"), U.rule_table(spark, rules)).count() == 0
    no = U.filter_urls(df, U.rule_table(spark, rules).where("false")).collect()
    assert len(no) == len(rows) and all(r.rule is None and r.verdict == "allow" for r in no)


def test_fixity_audit(spark, monkeypatch):
    rnd = random.Random(6)
    rows = [(i, f"http://x/{i}", "b" * rnd.randint(0, 3000)) for i in range(700)]
    rows += [(700, None, None), (701, "u", ""), (702, "u", "long" * 100_000), (None, "n", "x"), (703, "t", "t"), (703, "t", "t"), (703, "t", "s")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("file", F.lit(9)).withColumn("digest", F.lit("d"))
    a = R.archive(df)
    recs = sorted(((r.file, r.page_id, r.record_offset, r.length, r.digest) for r in a.collect()), key=repr)
    assert len(recs) == len(rows)
    for f in {r[0] for r in recs}:
        mine = sorted((r[2], r[3]) for r in recs if r[0] == f)
        assert [m[0] for m in mine] == [sum(x[1] for x in mine[:i]) for i in range(len(mine))]
    by_id = {p: (u, h) for p, u, h in rows}
    for f, p, _, n, d in recs:
        if p in (5, 700, 702):
            u, h = by_id[p]
            rec = f"WARC/1.1\r\nWARC-Type: response\r\nWARC-Target-URI: {u or ''}\r\nContent-Length: {len(h or '')}\r\n\r\n{h or ''}\r\n\r\n".encode()
            assert (n, d) == (len(rec), hashlib.sha256(rec).hexdigest())
    assert R.audit(a, a).count() == 0
    bad = {5: "changed", 300: "missing", 702: "changed", None: "missing"}
    worse = a.where("page_id IS NOT NULL AND page_id <> 300").withColumn(
        "digest", F.when(F.col("page_id").isin(5, 702), "0").otherwise(F.col("digest")))
    got = {r.page_id: (r.file, r.record_offset, r.length, r.problem) for r in R.audit(a, worse).collect()}
    assert got == {p: next((f, o, n, bad[p]) for f, q, o, n, _ in recs if q == p) for p in bad}
    assert {r.page_id: r.problem for r in R.audit(worse, a).collect()} == {
        p: {"missing": "extra"}.get(x, x) for p, x in bad.items()}
    one_leaf = {r.page_id for r in R.audit(a, worse, leaf_bytes=1 << 40).collect()}
    assert one_leaf == set(bad)
    assert R.audit(a.where("false"), a.where("false")).count() == 0


def test_second_replica_is_hashed_from_its_bytes(spark):
    pages = spark.createDataFrame([(i, f"u{i}", "é" * i) for i in range(210)] + [(None, None, None)], "page_id long, url string, html string")
    left, right = ({r.page_id: r for r in x.collect()} for x in (R.archive(pages), R.damaged(pages)))
    assert set(left) - set(right) == {7, 200}
    for i, r in right.items():
        url, body = (f"u{i}", "é" * i) if i is not None else ("", "")
        size = len(body.encode())
        raw = f"WARC/1.1\r\nWARC-Type: response\r\nWARC-Target-URI: {url}\r\nContent-Length: {size}\r\n\r\n{body}\r\n\r\n".encode()
        if i in (5, 102, 199):
            raw = raw[:5] + bytes([raw[5] ^ 1]) + raw[6:]
        assert r.digest == hashlib.sha256(raw).hexdigest()
        assert (r.record_offset, r.length) == (left[i].record_offset, len(raw))
    got = {r.page_id: r.problem for r in R.audit(R.archive(pages), R.damaged(pages)).collect()}
    assert got == {7: "missing", 200: "missing", 5: "changed", 102: "changed", 199: "changed"}


def test_records_of_one_page_stand_in_order_of_digest(spark):
    """Repeated page_ids with different bytes: offsets follow the digests."""
    df = spark.createDataFrame([(1, "http://a/", f"page {i}") for i in range(40)] + [(1, "http://a/", "page 3")], "page_id long, url string, html string")
    rows = sorted(R.archive(df).collect(), key=lambda r: (r.record_offset, r.digest))
    assert [r.digest for r in rows] == sorted(r.digest for r in rows)
    end = 0
    for r in rows:
        assert r.record_offset == end
        end += r.length


def test_mixed_documents_keep_columns_of_any_name(spark):
    df = spark.createDataFrame([(i, "a b c", "s", 7, 8, 9) for i in range(5)], "doc_id long, text string, source string, _n int, _size int, copies int")
    got = M.mixed_documents(df)
    assert got.columns == df.columns and {(r._n, r._size, r.copies) for r in got.collect()} == {(7, 8, 9)}
