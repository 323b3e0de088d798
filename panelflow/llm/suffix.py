"""Operator 4: suffix-array dedup of repeats of 50 bytes and more."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelflow.llm.packed import falls, pack, rises, unpack
from panelflow.llm.store import cut, discard, partitions
from panelflow.llm.words import Texts, batches, mix, prefix_hash, span_hash

#: Least length of a repeat and length of an anchor, in bytes.
LEAST, ANCHOR = 50, 20
_LAST = (1 << 63) - 1
#: Characters of text after which a task passes on the anchors, or the surroundings, that it has gathered.
_GATHER, _GATHER_CONTEXTS = 16_000_000, 8_000_000
#: Parts in which a task works off a hash bucket, one after the other.
SLICES = 8
#: Bytes of text whose anchors make a hash bucket.
BUCKET = 16_000_000
#: Bytes of an anchor's hash by which documents that share it are found; its surroundings are compared in full.
SHORT = 5


def anchors(t: Texts) -> tuple[np.ndarray, np.ndarray]:
    """(position, hash) of the anchors: in each window of LEAST bytes of a text the ANCHOR bytes of least hash.

    The leftmost wins a tie.  Equal windows have their anchor at the same
    offset, so every repeat of LEAST bytes holds an anchor of each of its
    occurrences, wherever they are.
    """
    n, width = len(t.buf), LEAST - ANCHOR + 1
    if n < LEAST + 1:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    start = np.arange(n - ANCHOR + 1)
    h = span_hash(prefix_hash(t.buf), start, start + ANCHOR)
    least = h & np.uint64(0xFFFFFFFF00000000) | start.astype(np.uint64)
    have = 1
    while have < width:
        step = min(have, width - have)
        least = np.minimum(least[:-step], least[step:])
        have += step
    inside = np.zeros(len(least) + 1, np.int32)
    long = t.end - t.begin >= LEAST
    np.add.at(inside, t.begin[long], 1)
    np.add.at(inside, t.end[long] - LEAST + 1, -1)
    at = (least[np.cumsum(inside[:-1]) > 0] & np.uint64(0xFFFFFFFF)).astype(np.int64)
    at = at[np.concatenate(([True], at[1:] != at[:-1]))] if len(at) else at
    return at, h[at]


def _keyed(docs: DataFrame) -> DataFrame:
    """(id, th, key, text): a greatest id for null ones, a hash of the text, one of both."""
    rows = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(_LAST)).alias("id"), F.xxhash64("text").alias("th"), "text")
    return rows.select("id", "th", F.xxhash64("id", "th").alias("key"), "text")


def shorten(h: np.ndarray) -> np.ndarray:
    """The leading SHORT bytes of hashes, as numbers."""
    return h >> np.uint64(64 - 8 * SHORT)


def packed(short: np.ndarray) -> np.ndarray:
    """Short hashes as rows of SHORT bytes."""
    return np.ascontiguousarray(short.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :SHORT])


def unpacked(raw: bytes) -> np.ndarray:
    out = np.zeros((len(raw) // SHORT, 8), np.uint8)
    out[:, :SHORT] = np.frombuffer(raw, np.uint8).reshape(-1, SHORT)
    return out.view("<u8").ravel().astype(np.uint64)


def _within(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The places of spans, one span after the other."""
    return np.arange(int(size.sum())) + np.repeat(start - (np.cumsum(size) - size), size)


def _surroundings(prefix: np.ndarray, begin: np.ndarray, at: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A hash of what stands before and behind the starts of anchors."""
    return mix(span_hash(prefix, begin, at) * np.uint64(0x9E3779B97F4A7C15) + span_hash(prefix, at, end))


def _deal(parts: int, h: np.ndarray) -> np.ndarray:
    return (mix(h) % np.uint64(parts)).astype(np.int64)


def _repeated(rows: DataFrame, parts: int, within: bool = False, to: int = 1) -> DataFrame:
    """(key, hashes): per document the short hashes of the anchors that another document holds too; one row a document.

    ``within``: also those that stand twice in one document.  What a
    document costs in each bucket decides how this grows with the buckets:
    one key, as its step from the next smaller one.  A hash bucket gives one
    row to each of the ``to`` buckets of documents, not one per document that it has an anchor of.
    """

    def gather(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hashes, owners, keys, base, size = [], [], [], 0, 0

        def out():
            h, key = np.concatenate(hashes), np.concatenate(keys).view(np.uint64)
            by_key, rank = np.unique(key, return_inverse=True)      # repeated rows are one document
            d = rank[np.concatenate(owners)]
            p = _deal(parts, h)
            order = np.lexsort((d, h, p))
            h, d, p = h[order], d[order], p[order]
            new = np.concatenate(([True], (h[1:] != h[:-1]) | (d[1:] != d[:-1]) | within)) if len(h) else np.zeros(0, bool)
            h, d, p = h[new], d[new], p[new]
            edge = np.flatnonzero(np.concatenate(([True], p[1:] != p[:-1], [True]))) if len(p) else []
            for a, z in zip(edge[:-1], edge[1:], strict=True):
                own, local = np.unique(d[a:z], return_inverse=True)
                yield int(p[a]), pack(rises(h[a:z]), local.astype(np.uint32), rises(by_key[own]))

        def flush():
            got = list(out())
            for lo in range(0, len(got), 64):
                yield pd.DataFrame(got[lo:lo + 64], columns=["p", "blob"])

        for pdf in batches(frames):
            t = Texts(pdf["text"], fold=False)
            at, h = anchors(t)
            hashes.append(shorten(h))
            owners.append(np.searchsorted(t.end, at, side="right") + base)
            keys.append(pdf["key"].to_numpy(np.int64))
            base, size = base + t.n, size + len(t.buf)
            if size > _GATHER:
                yield from flush()
                hashes, owners, keys, base, size = [], [], [], 0, 0
        if hashes:
            yield from flush()

    def meet(pdf: pd.DataFrame) -> pd.DataFrame:
        h, d, keys, base = [], [], [], 0
        for blob in pdf["blob"]:
            step, local, key = unpack(blob)
            h.append(falls(step))
            d.append(local.astype(np.int64) + base)
            keys.append(falls(key))
            base += len(key)
        h, d, keys = map(np.concatenate, (h, d, keys))
        order = np.argsort(h, kind="stable")
        h, d = h[order], d[order]
        first = np.flatnonzero(np.concatenate(([True], h[1:] != h[:-1])))
        size = np.diff(np.append(first, len(h)))
        own = keys[d]
        shared = size > 1 if within else np.minimum.reduceat(own, first) != np.maximum.reduceat(own, first)
        take = np.repeat(shared, size)
        h, key = h[take], own[take]
        q, out = _deal(to, key), []
        order = np.lexsort((key, q))
        h, key, q = h[order], key[order], q[order]
        edge = np.flatnonzero(np.concatenate(([True], q[1:] != q[:-1], [True]))) if len(q) else []
        for a, z in zip(edge[:-1], edge[1:], strict=True):
            mine, size = np.unique(key[a:z], return_counts=True)
            out.append((int(q[a]), pack(rises(mine), size.astype(np.uint32), packed(h[a:z]).ravel())))
        return pd.DataFrame(out, columns=["q", "blob"])

    def together(pdf: pd.DataFrame) -> pd.DataFrame:
        key, raw = [], []
        for blob in pdf["blob"]:
            step, size, short = unpack(blob)
            key.append(np.repeat(falls(step), size))
            raw.append(short.reshape(-1, SHORT))
        key = np.concatenate(key)
        order = np.argsort(key, kind="stable")
        key, raw = key[order], np.concatenate(raw)[order]
        first = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
        return pd.DataFrame({"key": key[first].view(np.int64),
                             "hashes": [raw[a:z].tobytes() for a, z in zip(first, np.append(first[1:], len(key)), strict=True)]})

    # all columns, so that the texts' one shuffle serves this too
    blobs = rows.select("id", "th", "key", "text").mapInPandas(gather, "p int, blob binary")
    dealt = blobs.groupBy("p").applyInPandas(meet, "q int, blob binary")
    return dealt.groupBy("q").applyInPandas(together, "key long, hashes binary")


def common(a: bytes, b: bytes) -> int:
    """Length of the common prefix."""
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n
    lo, hi = 0, n  # a[:lo] == b[:lo], a[:hi] != b[:hi]
    while hi - lo > 1:
        mid = (lo + hi) // 2
        if a[lo:mid] == b[lo:mid]:
            lo = mid
        else:
            hi = mid
    return lo


def intervals(lcp: list[int], least: int) -> Iterator[tuple[int, int, int]]:
    """(depth, first, last) of the common-prefix intervals of a sorted list, by a stack scan.

    ``lcp[i]`` is the common prefix of entries i and i + 1.  Only intervals
    of at least ``least``; inner ones before those around them.
    """
    stack: list[tuple[int, int]] = []  # (depth, first), depths rising
    for i, depth in enumerate([*lcp, -1]):
        first = i
        while stack and stack[-1][0] > depth:
            d, first = stack.pop()
            if d >= least:
                yield d, first, i
        if not stack or stack[-1][0] < depth:
            stack.append((depth, first))


def maximal_repeats(left: list[bytes], right: list[bytes], least: int = LEAST) -> Iterator[tuple[int, int, list[int]]]:
    """(l, r, members): the maximal repeats of at least ``least`` bytes around an anchor that all entries share.

    ``right`` holds the suffixes from the anchor on, ``left`` the bytes
    before it, reversed.  The suffixes are sorted and their common-prefix
    interval tree is scanned with a stack: an interval's suffixes share
    ``r`` bytes and differ after them.  Within an interval the left
    extensions are scanned the same way: a class that shares ``l`` bytes and
    is diverse before them is a repeat of l + r bytes, and all its members
    are given, unless they all lie in one inner interval (then they share
    more than r bytes and have been given there).
    """
    order = sorted(range(len(right)), key=right.__getitem__)
    rank = {x: k for k, x in enumerate(order)}
    lcp = [common(right[a], right[b]) for a, b in zip(order, order[1:])]
    for r, first, last in intervals(lcp, 1):
        here = sorted(order[first:last + 1], key=left.__getitem__)
        llcp = [common(left[a], left[b]) for a, b in zip(here, here[1:])]
        for l, lo, hi in intervals(llcp, max(0, least - r)):  # noqa: E741
            members = here[lo:hi + 1]
            ends = [rank[x] for x in members]
            if common(right[order[min(ends)]], right[order[max(ends)]]) == r:
                yield l, r, members


def _contexts(rows: DataFrame, parts: int, reach: int = LEAST) -> DataFrame:
    """(p, blob): for each repeated anchor its surroundings, and where they occur.

    They end ``reach`` bytes behind the anchor's start and before its end.
    """
    length = np.uint8 if reach < 256 else np.uint32

    def gather(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        # distinct surroundings: (anchor, hash, bytes before, from the anchor on), bytes; occurrences: (surrounding, document, place)
        held, texts, occurrences, ids, ths, base, seen, size = [], [], [], [], [], 0, 0, 0

        def flush():
            h, name, ll, rl = (np.concatenate(x) for x in zip(*held, strict=True))
            text = np.concatenate(texts)
            c, d, pos = (np.concatenate(x) for x in zip(*occurrences, strict=True))
            begin = np.cumsum(ll + rl) - ll - rl
            _, first, turn = np.unique(name, return_index=True, return_inverse=True)
            order = np.lexsort((h[first], _deal(parts, h[first])))     # surroundings of an anchor stand together
            first = first[order]
            place = np.empty(len(first), np.int64)
            place[order] = np.arange(len(first))
            c = place[turn[c]]
            by_id = np.lexsort((np.concatenate(ths), np.concatenate(ids).view(np.uint64)))
            id_, th = np.concatenate(ids).view(np.uint64)[by_id], np.concatenate(ths)[by_id]
            rank = np.empty(len(by_id), np.int64)
            rank[by_id] = np.arange(len(by_id))
            order = np.argsort(c, kind="stable")
            c, d, pos = c[order], rank[d[order]], pos[order]
            p, part = _deal(parts, h[first]), []
            edge = np.flatnonzero(np.concatenate(([True], p[1:] != p[:-1], [True])))
            for a, z in zip(edge[:-1], edge[1:], strict=True):
                mine, (lo, hi) = first[a:z], np.searchsorted(c, (a, z))
                own, local = np.unique(d[lo:hi], return_inverse=True)
                part.append((int(p[a]), pack(ll[mine].astype(length), rl[mine].astype(length), text[_within(begin[mine], (ll + rl)[mine])],
                                             (c[lo:hi] - a).astype(np.uint32), local.astype(np.uint32), pos[lo:hi].astype(np.uint32),
                                             rises(id_[own]), th[own])))
            for lo in range(0, len(part), 64):
                yield pd.DataFrame(part[lo:lo + 64], columns=["p", "blob"])

        for pdf in batches(frames):
            t = Texts(pdf["text"], fold=False)
            at, h = anchors(t)
            doc = np.searchsorted(t.end, at, side="right")
            wanted = [unpacked(b"".join(x)) for x in pdf["hashes"]]
            keys = np.concatenate([np.zeros(0, np.uint64), *[mix(w ^ np.uint64(i * 2 + 1)) for i, w in enumerate(wanted)]])
            take = np.isin(mix(shorten(h) ^ (doc * 2 + 1).astype(np.uint64)), keys)
            at, h, doc = at[take], h[take], doc[take]
            begin, end = np.maximum(t.begin[doc], at - reach + ANCHOR), np.minimum(t.end[doc], at + reach)
            name, first, turn = np.unique(_surroundings(prefix_hash(t.buf), begin, at, end), return_index=True, return_inverse=True)
            if len(at):
                held.append((h[first], name, (at - begin)[first], (end - at)[first]))
                texts.append(t.buf[_within(begin[first], (end - begin)[first])])
                occurrences.append((turn + seen, doc + base, at - t.begin[doc]))
            seen += len(name)
            ids.append(pdf["id"].to_numpy(np.int64))
            ths.append(pdf["th"].to_numpy(np.int64))
            base += t.n
            size += len(t.buf) + (int((end - begin)[first].sum()) if reach > LEAST else 0)
            if size > _GATHER_CONTEXTS:
                if held:
                    yield from flush()
                held, texts, occurrences, ids, ths, base, seen, size = [], [], [], [], [], 0, 0, 0
        if held:
            yield from flush()

    return rows.mapInPandas(gather, "p int, blob binary")


class _Bucket:
    """One slice of the repeated anchors of a hash bucket, decoded and grouped."""

    def __init__(self, blobs, slice_: int, within: bool = False):
        self.within = within
        held, texts, ctx, doc, pos, ids, ths, base, seen = [], [], [], [], [], [], [], 0, 0
        for blob in blobs:
            ll, rl, text, c, d, p, id_, th = unpack(blob)
            ll, rl, prefix = ll.astype(np.int64), rl.astype(np.int64), prefix_hash(text)
            begin = np.cumsum(ll + rl) - ll - rl
            h = span_hash(prefix, begin + ll, begin + ll + ANCHOR)
            mine = mix(h + np.uint64(1)) % np.uint64(SLICES) == slice_
            here = mine[c]
            ctx.append((np.cumsum(mine) - 1)[c[here]] + seen)
            doc.append(d[here].astype(np.int64) + base)
            pos.append(p[here].astype(np.int64))
            ids.append(falls(id_).view(np.int64))
            ths.append(th)
            begin, ll, rl = begin[mine], ll[mine], rl[mine]
            held.append((h[mine], _surroundings(prefix, begin, begin + ll, begin + ll + rl), ll, rl))
            texts.append(text[_within(begin, ll + rl)])
            base, seen = base + len(id_), seen + len(ll)
        ctx, self.doc, self.pos, self.ids, self.ths = map(np.concatenate, (ctx, doc, pos, ids, ths))
        h, name, ll, rl = (np.concatenate(x) for x in zip(*held, strict=True))
        _, first, turn = np.unique(name, return_index=True, return_inverse=True)
        self.text = np.concatenate(texts)
        self.begin = (np.cumsum(ll + rl) - ll - rl)[first]
        self.hash, self.ll, self.rl, self.ctx = h[first], ll[first], rl[first], turn[ctx]
        if within:  # repeated rows are one document
            once = np.unique(np.stack([self.ths[self.doc], self.pos, self.ctx]), axis=1, return_index=True)[1]
            self.ctx, self.doc, self.pos = self.ctx[once], self.doc[once], self.pos[once]
        own = self.ids[self.doc]
        order = np.argsort(self.ctx, kind="stable")
        self.ctx, self.doc, self.pos = self.ctx[order], self.doc[order], self.pos[order]
        self.first = np.searchsorted(self.ctx, np.arange(len(self.hash) + 1))
        own = own[order]
        self.low = np.minimum.reduceat(own, self.first[:-1]) if len(own) else own
        self.high = np.maximum.reduceat(own, self.first[:-1]) if len(own) else own

    def sides(self, c: int) -> tuple[bytes, bytes]:
        """What stands before the anchor of a surrounding, reversed, and what stands from it on."""
        a, m = int(self.begin[c]), int(self.begin[c] + self.ll[c])
        return self.text[a:m][::-1].tobytes(), self.text[m:m + int(self.rl[c])].tobytes()

    def whole(self) -> np.ndarray:
        """The surroundings that repeat as a whole: in documents of more than one id, or ``within`` one too."""
        again = np.diff(self.first) > 1 if self.within else self.low != self.high
        return np.flatnonzero(again & (self.ll + self.rl >= LEAST))

    def shared(self) -> Iterator[tuple[int, int, list[int]]]:
        """(l, r, surroundings) of the maximal repeats across the surroundings of an anchor."""
        order = np.argsort(self.hash, kind="stable")
        edge = np.flatnonzero(np.concatenate(([True], np.diff(self.hash[order]) != 0, [True]))) if len(order) else []
        for a, z in zip(edge[:-1], edge[1:], strict=True):
            if z - a > 1:
                same = order[a:z].tolist()
                left, right = zip(*[self.sides(i) for i in same], strict=True)
                for l, r, members in maximal_repeats(left, right):  # noqa: E741
                    mine = [same[m] for m in members]
                    if self.within or self.low[mine].min() != self.high[mine].max():
                        yield l, r, mine

    def groups(self) -> Iterator[tuple[int, int, list[int]]]:
        """(l, r, surroundings) of the maximal repeats in documents of more than one id, or ``within`` one too.

        A repeat that goes on beyond the surroundings is given as far as they go.
        """
        for c in self.whole().tolist():
            yield int(self.ll[c]), int(self.rl[c]), [c]
        yield from self.shared()


def _prepared(docs: DataFrame, within: bool = False) -> tuple[DataFrame, DataFrame, DataFrame, int]:
    """(rows, copies, marked, parts): keyed rows, the keys of later copies of a whole text, texts with their
    repeated anchors, hash buckets.

    The rows are dealt by key once; every later use of the texts reads that
    shuffle.  Buckets are as many as the texts' bytes fill.  Whole copies are known from their hashes and need no
    anchors: the text's first document stands for them.
    """
    spark = docs.sparkSession
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = max(1, -(-partitions(spark) * 3 // 5), -(-size // BUCKET))
    keys = _keyed(docs).select("id", "th", "key")
    firsts = keys.groupBy("th").agg(F.min("id").alias("first"))
    copies = keys.join(firsts.hint("merge"), "th").where("id > first").select("key", F.lit(True).alias("copy")).distinct()
    copies = cut(copies).hint("merge")     # no hash table in the driver
    rows = _keyed(docs).repartition(partitions(spark), "key")
    # not an anti join, which would go below the shuffle and give the uses different ones
    texts = rows.join(copies, "key", "left").where("copy IS NULL").drop("copy")
    found = _repeated(texts, parts, within, partitions(spark)).select("key", F.array("hashes").alias("hashes"))
    marked = texts.join(found.hint("merge"), "key").select("id", "th", "text", "hashes")
    return rows, copies, marked, parts


def repeat_groups(docs: DataFrame) -> DataFrame:
    """(repeat, length, doc_id, position): maximal repeats of any length with all their occurrences.

    ``repeat`` names the byte string; positions are bytes.  Occurrences may
    lie in one document.  Rounds with surroundings of twice the length go on
    for the anchors of which a repeat reaches the surroundings' end, until
    every repeat ends within them: a repeat that is diverse on both sides
    there is maximal, and all its occurrences hold the same anchor.
    """
    _, _, marked, parts = _prepared(docs, within=True)
    marked, reach, got = cut(marked), LEAST, None
    columns = ["repeat", "length", "id", "th", "position", "hashes"]

    def finder(reach: int):
        def out(pdf: pd.DataFrame) -> pd.DataFrame:
            rows: list[tuple] = []
            for b in (_Bucket(pdf["blob"], i, within=True) for i in range(SLICES)):
                going_on: set[int] = set()
                for l, r, members in b.groups():  # noqa: E741
                    left, right = b.sides(members[0])
                    if l >= reach - ANCHOR or r >= reach:
                        going_on.add(int(b.hash[members[0]]))
                        continue
                    name = hashlib.sha256(left[:l][::-1] + right[:r]).hexdigest()
                    for c in members:
                        for k in range(b.first[c], b.first[c + 1]):
                            rows.append((name, l + r, None, int(b.ths[b.doc[k]]), int(b.pos[k]) - l, None))
                wider: dict[tuple[int, int], set[int]] = {}
                for c, h in enumerate(b.hash.tolist()):
                    if h in going_on:
                        for k in range(b.first[c], b.first[c + 1]):
                            wider.setdefault((int(b.ids[b.doc[k]]), int(b.ths[b.doc[k]])), set()).add(h)
                rows.extend((None, None, i, th, None, packed(shorten(np.array(sorted(h), np.uint64))).tobytes()) for (i, th), h in wider.items())
            return pd.DataFrame(rows, columns=columns).astype({"length": "Int64", "id": "Int64", "th": "Int64", "position": "Int64"})

        return out

    while True:
        found = cut(_contexts(marked, parts, reach).groupBy("p").applyInPandas(
            finder(reach), "repeat string, length long, id long, th long, position long, hashes binary"))
        ended = found.where("repeat IS NOT NULL").select("repeat", "length", "th", "position")
        got = ended if got is None else got.unionByName(ended)
        wider = found.where("repeat IS NULL").groupBy("id", "th").agg(F.collect_list("hashes").alias("hashes"))
        if wider.isEmpty():
            break
        before, reach = marked, 2 * reach
        marked = cut(marked.drop("hashes").distinct().join(wider, ["id", "th"]))
        discard(before)
    discard(marked)
    got = got.distinct()
    keyed = _keyed(docs)
    owners = keyed.select("id", "th").distinct()
    whole = keyed.select("id", "th", F.sha2("text", 256).alias("repeat"), F.octet_length("text").cast("long").alias("length"))
    whole = whole.where(F.col("length") >= LEAST).distinct()
    again = whole.groupBy("th").agg(F.count("*").alias("n")).where("n > 1").select("th")
    whole = whole.join(again, "th").select("repeat", "length", "id", F.lit(0).cast("long").alias("position"))
    got = got.join(owners, "th").select("repeat", "length", "id", "position").unionByName(whole).distinct()
    return got.select("repeat", "length", F.when(F.col("id") < _LAST, F.col("id")).alias("doc_id"), "position")


def _spans(blobs: DataFrame) -> DataFrame:
    """(key, spans): of each repeat's occurrences, those in documents behind its first one; one row a document.

    A hash bucket gives one row per bucket of documents, not one per
    document that it has a repeat of.
    """
    to = partitions(blobs.sparkSession)

    def out(pdf: pd.DataFrame) -> pd.DataFrame:
        found = [spread(_Bucket(pdf["blob"], i)) for i in range(SLICES)]
        ids, ths, start, stop = (np.concatenate(x) for x in zip(*found, strict=True))
        (ids, ths), first, size, start, stop = _runs((ids, ths), start, stop)
        q = _deal(to, mix(ids.view(np.uint64)) ^ ths.view(np.uint64))
        rows = []
        for k in np.unique(q).tolist():
            own = np.flatnonzero(q == k)
            at = _within(first[own], size[own])
            rows.append((k, pack(ids[own], ths[own], size[own].astype(np.uint32), start[at].astype(np.uint32), stop[at].astype(np.uint32))))
        return pd.DataFrame(rows, columns=["q", "blob"])

    def together(pdf: pd.DataFrame) -> pd.DataFrame:
        ids, ths, size, start, stop = (np.concatenate(x) for x in zip(*map(unpack, pdf["blob"]), strict=True))
        ids, ths = np.repeat(ids, size), np.repeat(ths, size)
        (ids, ths), first, size, start, stop = _runs((ids, ths), start.astype(np.int64), stop.astype(np.int64))
        runs = np.stack([start, stop], 1).astype("<u4")
        return pd.DataFrame({"id": ids, "th": ths, "spans": [runs[a:a + n].tobytes() for a, n in zip(first, size, strict=True)]})

    def spread(b: _Bucket) -> tuple:
        """(id, th, start, stop): of each occurrence what its repeats cover together; all of them hold its anchor."""
        whole = b.whole()
        found = [(whole, b.ll[whole], b.rl[whole], b.low[whole])]
        for l, r, members in b.shared():  # noqa: E741
            n = len(members)
            found.append((np.array(members), np.full(n, l), np.full(n, r), np.full(n, b.low[members].min())))
        c, l, r, low = (np.concatenate(x) for x in zip(*found, strict=True))  # noqa: E741
        # a surrounding's repeats by their first document: what those up to there reach on either side
        order = np.lexsort((low, c))
        c, l, r, low = c[order], l[order], r[order], low[order]  # noqa: E741
        l, r = (np.maximum.accumulate(x + (c << 33)) - (c << 33) for x in (l, r))  # noqa: E741
        own = b.ids[b.doc]
        known = np.unique(low)
        rank = lambda x: np.searchsorted(known, x)
        at = np.searchsorted(c * (len(known) + 1) + rank(low), b.ctx * (len(known) + 1) + rank(own)) - 1
        gone = at >= 0
        gone[gone] = c[at[gone]] == b.ctx[gone]
        at, doc, pos = at[gone], b.doc[gone], b.pos[gone]
        return own[gone], b.ths[doc], pos - l[at], pos + r[at]

    dealt = blobs.groupBy("p").applyInPandas(out, "q int, blob binary")
    spans = dealt.groupBy("q").applyInPandas(together, "id long, th long, spans binary")
    return spans.select(F.xxhash64("id", "th").alias("key"), "spans")


def _runs(of: tuple[np.ndarray, np.ndarray], start: np.ndarray, stop: np.ndarray) -> tuple:
    """Maximal runs by document, the two columns ``of``: (documents, each one's first run, their number, start, stop)."""
    order = np.lexsort((start, *of[::-1]))
    (a, b), start, stop = (x[order] for x in of), start[order], stop[order]
    first = np.flatnonzero(np.concatenate(([True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])))) if len(a) else np.zeros(0, np.int64)
    # documents far apart, so that their runs are found at once
    doc = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(a))))
    start, stop = _union(start + (doc << 33), stop + (doc << 33))
    doc = start >> 33
    edge = np.searchsorted(doc, np.arange(len(first) + 1))
    return (a[first], b[first]), edge[:-1], np.diff(edge), start - (doc << 33), stop - (doc << 33)


def _union(start: np.ndarray, stop: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Maximal runs of the spans, which are sorted by start; touching spans are one run."""
    reach = np.maximum.accumulate(stop)
    new = np.concatenate(([True], start[1:] > reach[:-1])) if len(start) else np.zeros(0, bool)
    first = np.flatnonzero(new)
    return start[first], reach[np.append(first[1:], len(start)) - 1] if len(first) else reach


def dedup_repeats(docs: DataFrame, with_text: bool = False) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256[, kept]), one row per row of ``docs``.

    Every byte goes that lies in a string of 50 bytes which also starts in a
    document of a smaller doc_id, judged on the texts as given; matches lie
    within one text.  ``kept`` holds the other bytes.

    Later copies of a whole text go as a whole.  Of the others only anchors
    are indexed: the least-hashed 20 bytes of every window of
    50.  First their hashes alone are shuffled, to find those that documents
    of more than one id hold; then the surroundings of these (30 bytes
    before, 50 from the anchor on) are, with each distinct surrounding once per task.
    In each hash bucket the suffixes at an anchor are sorted, their
    common-prefix interval tree is stack-scanned and the maximal repeats
    across documents follow with all occurrences.

    Null text: empty.  Texts under 50 bytes: nothing is removed.  Rows of
    one doc_id are never each other's original; null doc_id counts as
    greater than all.  Empty table: empty result.  Other columns are ignored.
    """
    rows, copies, marked, parts = _prepared(docs)
    spans = _spans(_contexts(marked, parts))
    joined = rows.join(spans.hint("merge"), "key", "left").join(copies, "key", "left")
    kind = docs.schema["doc_id"].dataType.simpleString()
    joined = joined.select(F.when(F.col("id") < _LAST, F.col("id")).cast(kind).alias("doc_id"), "th", "text", "spans",
                           F.coalesce("copy", F.lit(False)).alias("copy"))

    def apply(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            out = []
            for text, spans, copy in zip(pdf["text"], pdf["spans"], pdf["copy"], strict=True):
                raw = (text or "").encode("utf-8", "surrogatepass")
                kept, gone, runs = raw, 0, 0
                if copy and len(raw) >= LEAST:
                    kept, gone, runs = b"", len(raw), 1
                elif spans is not None and len(spans):
                    start, stop = np.frombuffer(spans, "<u4").astype(np.int64).reshape(-1, 2).T
                    edge = [0, *np.stack([start, stop], 1).ravel().tolist(), len(raw)]
                    kept = b"".join(raw[a:z] for a, z in zip(edge[0::2], edge[1::2], strict=True))
                    gone, runs = len(raw) - len(kept), len(start)
                row = (len(raw), gone, runs, hashlib.sha256(kept).hexdigest())
                out.append((*row, kept) if with_text else row)
            columns = ["n_bytes", "n_removed", "n_spans", "kept_sha256", *["kept"] * with_text]
            res = pd.DataFrame(out, columns=columns)
            res.insert(0, "doc_id", pdf["doc_id"].to_numpy())
            yield res

    return joined.mapInPandas(apply, f"doc_id {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string"
                              + ", kept binary" * with_text)


def op4_suffix(spark, sf_dir: str) -> DataFrame:
    """What is left of every document without its repeats of earlier ones."""
    return dedup_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
