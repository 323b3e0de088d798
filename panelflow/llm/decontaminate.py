"""Operator 7: benchmark decontamination by latent semantic retrieval."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelflow.llm.store import cut, whole_row
from panelflow.llm.words import Texts, batches

#: Hash bits of a term, and of a word's place where items' words are looked up before texts are compared.
TERM_BITS, SLOT_BITS = 18, 20
#: Words of a passage window and of its step; latent dimensions, spare ones, power iterations.
WINDOW, STEP, RANK, SPARE, POWER = 32, 16, 128, 16, 2
#: Least cosine of a window and a passage in the latent space for the window to be retrieved.
RETRIEVED = 0.85
#: Least common-subsequence share of a leak, and the lower one that holds where the answer's words are there too.
LEAK, LEAK_WITH_ANSWER = 0.8, 0.6
#: An item's answer: its last words, of which this share must be found in order.
ANSWER_WORDS, ANSWER_SHARE = 5, 0.8
#: Benchmark items matched in one pass over the documents, and hash blocks of the term counts.
ITEMS_AT_ONCE, TERM_BLOCKS = 4096, 16
SEED = 17
_EDGE = np.zeros(256, bool)
_EDGE[list(b".,;:!?\"'()[]")] = True


class Terms(Texts):
    """Lower-case words without punctuation at their end; ``term`` is each one's hashed number."""

    def __init__(self, texts):
        super().__init__([(t or "").lower() for t in texts], fold=False)
        stop = self.stop.copy()
        for _ in range(3):
            cut_ = (stop - 1 > self.start) & _EDGE[self.buf[stop - 1]]
            stop -= cut_
        self.stop = stop
        self.hash = self.word_hash()
        self.term = (self.hash >> np.uint64(64 - TERM_BITS)).astype(np.int64)


def document_frequency(docs: DataFrame) -> tuple[np.ndarray, int]:
    """(documents that hold each hashed term, documents), over all of ``docs``.

    Each task counts into a vector of fixed size and the vectors are summed
    by blocks in Spark; only the one sum reaches the driver.
    """
    block = (1 << TERM_BITS) // TERM_BLOCKS

    def count(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        df, n = np.zeros(1 << TERM_BITS, np.int64), 0
        for pdf in batches(frames):
            t = Terms(pdf["text"])
            seen = np.unique(t.doc.astype(np.int64) << TERM_BITS | t.term)
            df += np.bincount(seen & ((1 << TERM_BITS) - 1), minlength=1 << TERM_BITS)
            n += t.n
        if n:
            yield pd.DataFrame({"b": range(TERM_BLOCKS), "n": n, "v": [
                df[i * block:(i + 1) * block].tobytes() for i in range(TERM_BLOCKS)]})

    def add(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total, n = {}, 0
        for pdf in frames:
            for b, m, v in zip(pdf["b"], pdf["n"], pdf["v"], strict=True):
                v = np.frombuffer(v, np.int64)
                total[b] = total[b] + v if b in total else v.copy()
                n += m if b == 0 else 0
        if total:
            yield pd.DataFrame({"b": list(total), "n": [n if b == 0 else 0 for b in total],
                                "v": [v.tobytes() for v in total.values()]})

    schema = "b int, n long, v binary"
    parts = docs.select("text").mapInPandas(count, schema)
    rows = parts.repartition(TERM_BLOCKS, "b").mapInPandas(add, schema).collect()
    df = np.zeros(1 << TERM_BITS, np.int64)
    for r in rows:
        df[r.b * block:(r.b + 1) * block] = np.frombuffer(r.v, np.int64)
    return df, sum(r.n for r in rows)


def term_weights(df: np.ndarray, n: int) -> np.ndarray:
    """Smoothed inverse document frequency: at least 1, so words of widely quoted items count too."""
    return (1 + np.log((1 + n) / (1.0 + df))).astype(np.float32)


def _passages(t: Terms, weight: np.ndarray) -> list[tuple[int, np.ndarray, np.ndarray]]:
    """(text, terms, TF-IDF) of each window of each text."""
    out = []
    for i in range(t.n):
        terms = t.term[t.first[i]:t.first[i + 1]]
        for at in range(0, max(1, len(terms) - STEP), STEP):
            u, c = np.unique(terms[at:at + WINDOW], return_counts=True)
            out.append((i, u, c * weight[u]))
    return out


def latent_space(benchmark: DataFrame, weight: np.ndarray, rank: int = RANK) -> tuple[np.ndarray, np.ndarray]:
    """(terms, vectors): right singular vectors of the benchmark's TF-IDF passages by distributed randomised SVD.

    A is passages x terms.  Each pass multiplies A'A with a thin matrix:
    tasks form it for their passages and emit it by term, Spark sums the
    rows of a term, and the driver orthonormalises the thin matrix, whose
    size is bounded by 2**TERM_BITS x (RANK + SPARE) and not by any table.
    """
    spark = benchmark.sparkSession
    wide = rank + SPARE
    sc_weight = spark.sparkContext.broadcast(weight)

    def product(thin: np.ndarray | None, terms: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
        held = spark.sparkContext.broadcast((thin, terms))

        def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            thin_, terms_ = held.value
            for pdf in frames:
                sums: dict[int, np.ndarray] = {}
                for _, u, x in _passages(Terms(pdf["text"]), sc_weight.value):
                    if thin_ is None:  # a fixed Gaussian row per term
                        rows = np.stack([np.random.default_rng((SEED, int(k))).standard_normal(wide) for k in u]) if len(u) else np.zeros((0, wide))
                    else:
                        rows = thin_[np.searchsorted(terms_, u)]
                    y = x @ rows
                    for k, v in zip(u.tolist(), x.tolist(), strict=True):
                        sums[k] = sums.get(k, 0.0) + v * y
                if sums:
                    yield pd.DataFrame({"term": list(sums), "v": list(sums.values())})

        parts = benchmark.select("text").mapInPandas(run, "term long, v array<double>")
        summed = parts.select("term", F.posexplode("v").alias("i", "x")).groupBy("term", "i").agg(F.sum("x").alias("x"))
        summed = summed.groupBy("term").agg(F.array_sort(F.collect_list(F.struct("i", "x"))).alias("v")).select("term", "v.x")
        rows = sorted((r[0], r[1]) for r in summed.collect())
        if not rows:
            return np.zeros(0, np.int64), np.zeros((0, wide))
        return np.array([r[0] for r in rows]), np.array([r[1] for r in rows])

    terms, y = product(None, None)
    for _ in range(POWER):
        q = np.linalg.qr(y)[0] if len(y) else y
        terms, y = product(q, terms)
    if not len(y):
        return terms, y[:, :rank].astype(np.float32)
    # y = A'A q: q'y is the small Gram matrix whose eigenvectors turn q into singular vectors
    gram = q.T @ y
    value, turn = np.linalg.eigh((gram + gram.T) / 2)
    best = np.argsort(-value)[:rank]
    best = best[value[best] > 1e-9 * max(value.max(), 1e-30)]
    return terms, (q @ turn[:, best]).astype(np.float32)


def common_subsequence(a: list, b: list) -> int:
    """Length of the longest common subsequence, a word of ``b`` at a time over a bit set of ``a``."""
    where: dict = {}
    for i, w in enumerate(a):
        where[w] = where.get(w, 0) | 1 << i
    full = (1 << len(a)) - 1
    v = full
    for w in b:
        u = v & where.get(w, 0)
        if u:
            v = ((v + u) | (v - u)) & full
    return len(a) - v.bit_count()


def leaks(docs: DataFrame, benchmark: DataFrame, rank: int = RANK, exact: bool = True) -> DataFrame:
    """(doc_id, item_id, cosine, lcs, answer): documents that hold a benchmark item or a paraphrase of it.

    Term weights come from all documents.  Items are cut into passages of up
    to 32 words and folded into the latent space of their SVD.  A window is
    32 words of a document, 16 words apart from the next.  Every window is
    folded in as well and searched against all passages: those near one there
    (``_Latent``) are retrieved.  Words replaced or put between an item's own
    can lower any cosine, so with ``exact`` the windows that this leaves are
    searched again by a bound that loses none which the rule below accepts
    (``_Rarest``).
    An item's words and those around the window (as many as the item has, on
    either side) are compared in full: ``lcs`` is the longest common
    subsequence over the item's length, ``answer`` says whether the item's
    last 5 words are there in order.  A leak has lcs >= 0.8, or >= 0.6 with
    the answer.  ``cosine`` is the window's with the item's best passage in
    the latent space, in units of an exact copy's.

    Null or empty texts and items without words: no leak.  Repeated rows:
    one result row each; items alike: each is reported.  Null ids: carried
    along.  Empty tables: empty result.  Other columns are ignored.
    """
    df, n = document_frequency(docs)
    weight = term_weights(df, n)
    benchmark = cut(benchmark.select("item_id", "text").repartition(8))
    terms, vectors = latent_space(benchmark, weight, rank)
    spark = docs.sparkSession
    ids = {f.name: f.dataType.simpleString() for f in [docs.schema["doc_id"], benchmark.schema["item_id"]]}
    schema = f"doc_id {ids['doc_id']}, item_id {ids['item_id']}, cosine double, lcs double, answer boolean"
    blocks = max(1, -(-benchmark.count() // ITEMS_AT_ONCE))
    out = None
    for b in range(blocks):
        part = benchmark.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == b) if blocks > 1 else benchmark
        items = part.collect()  # a block of the query set
        state = spark.sparkContext.broadcast((weight, terms, vectors, [(r.item_id, r.text) for r in items], exact))
        found = docs.select("doc_id", "text").mapInPandas(_matcher(state), schema)
        out = found if out is None else out.unionByName(found)
    return out


class _Windows:
    """The windows of a batch of texts: blocks of STEP words within each text; a window is a block and those after it."""

    def __init__(self, t: Terms):
        n_blocks = -(-(t.first[1:] - t.first[:-1]) // STEP)
        self.first = np.concatenate(([0], np.cumsum(n_blocks)))
        self.n = int(self.first[-1])
        self.doc = np.repeat(np.arange(t.n), n_blocks)
        self.at = t.first[self.doc] + (np.arange(self.n) - self.first[self.doc]) * STEP
        self.until = np.minimum(self.at + WINDOW, t.first[self.doc + 1])


class _Latent:
    """Retrieval in the latent space: every window against every passage of the items.

    A word's vector is its term's, weighted; a window's is the sum over its
    words that the benchmark has.  Their cosine is taken within the latent
    space, where words that no item has don't count.
    """

    def __init__(self, bench: Terms, weight: np.ndarray, terms: np.ndarray, vectors: np.ndarray):
        self.row = np.full(1 << TERM_BITS, -1, np.int32)
        self.row[terms] = np.arange(len(terms))
        self.known = np.unique(bench.hash)
        self.vectors = vectors * weight[terms][:, None]     # of a word, its weight included
        owner, q = [], []
        for i, u, x in _passages(bench, weight):
            if not len(u):
                continue
            z, norm = x @ vectors[self.row[u]], float(np.linalg.norm(x))
            own = float(z @ z)
            if norm > 0 and own > 1e-6 * norm * norm:
                owner.append(i)
                q.append(z * (norm / own))  # a copy of the passage scores 1
        self.owner = np.array(owner, np.int64)
        self.q = np.array(q, np.float32).reshape(len(q), vectors.shape[1]).T
        self.unit = self.q / np.maximum(np.linalg.norm(self.q, axis=0), 1e-30)
        self.passages: dict[int, list[int]] = {}
        for k, i in enumerate(owner):
            self.passages.setdefault(i, []).append(k)

    def rows(self, t: Terms) -> np.ndarray:
        """The row of each word's vector; -1 for words that the benchmark hasn't."""
        row = self.row[t.term]
        shared = np.flatnonzero(row >= 0)   # by bucket; now by word
        at = np.minimum(np.searchsorted(self.known, t.hash[shared]), len(self.known) - 1)
        row[shared[self.known[at] != t.hash[shared]]] = -1
        return row

    def folded(self, row: np.ndarray, w: _Windows) -> np.ndarray:
        """The vector of each window."""
        hits = np.flatnonzero(row >= 0)
        block = np.searchsorted(w.at, hits, side="right") - 1
        out = np.zeros((w.n, self.vectors.shape[1]), np.float32)
        edge = np.flatnonzero(np.diff(block, prepend=-1))
        size, row = np.diff(np.append(edge, len(hits))), row[hits]
        order = np.argsort(-size, kind="stable")    # those of most words first: what still has a k-th one stands in front
        edge, size = edge[order], size[order]
        for lo in range(0, len(edge), 1024):    # some blocks at a time
            mine, many = edge[lo:lo + 1024], size[lo:lo + 1024]
            total = self.vectors[row[mine]]
            for k in range(1, many[0]):
                n = int(np.searchsorted(-many, -k))
                total[:n] += self.vectors[row[mine[:n] + k]]
            out[block[mine]] = total
        whole = out.copy()
        for k in range(1, WINDOW // STEP):
            here = np.flatnonzero(w.doc[k:] == w.doc[:-k])
            whole[here] += out[here + k]
        return whole

    def windows(self, fold: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(window, item) where the window is near one of the item's passages."""
        found = [np.zeros(0, np.int64)]
        n, step = int(self.owner.max(initial=-1)) + 1, max(1, 4_000_000 // max(1, len(self.owner)))
        for lo in range(0, len(fold) if n else 0, step):
            some = fold[lo:lo + step]
            size = np.linalg.norm(some, axis=1)
            near = (some @ self.unit >= RETRIEVED * size[:, None]) & (size > 0)[:, None]
            window, passage = np.nonzero(near)
            found.append(np.unique((window + lo) * n + self.owner[passage]))
        found = np.concatenate(found)
        return found // max(n, 1), found % max(n, 1)

    def cosine(self, row: np.ndarray, w: _Windows, norm2: np.ndarray, window: np.ndarray, item: np.ndarray) -> np.ndarray:
        """Cosine of each window with the item's best passage, in units of an exact copy's."""
        out, hits = np.zeros(len(window)), np.flatnonzero(row >= 0)
        for lo in range(0, len(window), 8192):
            here, line = np.unique(window[lo:lo + 8192], return_inverse=True)
            a, z = np.searchsorted(hits, w.at[here]), np.searchsorted(hits, w.until[here])
            some, size = z > a, (z - a)[z > a]
            cos = np.zeros((len(here), self.q.shape[1]), np.float32)
            if some.any():
                start = np.cumsum(size) - size
                take = hits[np.arange(int(size.sum())) - np.repeat(start - a[some], size)]
                fold = np.add.reduceat(self.vectors[row[take]], start, axis=0)
                cos[some] = (fold @ self.q) / np.sqrt(np.maximum(norm2[here[some]], 1e-12))[:, None]
            out[lo:lo + 8192] = [max((float(cos[x, k]) for k in self.passages.get(i, [])), default=0.0)
                                 for x, i in zip(line.tolist(), item[lo:lo + 8192].tolist(), strict=True)]
        return out


def _slot(h: np.ndarray, item: np.ndarray | None = None) -> np.ndarray:
    """A word's place, or a word's and an item's, in a table of bits."""
    h = h if item is None else h ^ (item.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    return (h >> np.uint64(64 - SLOT_BITS)).astype(np.int64)


class _Rarest:
    """Exact candidates: where enough of an item's rarest words stand near each other.

    An lcs of 0.6 leaves out at most L - t of an item's L words, t being the
    least count that reaches 0.6.  So of its L - t + k rarest words at least
    k stand among the words around a window, for any k and any order of
    rarity; k = t / 3 is taken.  Only where that holds is more compared.
    """

    def __init__(self, words: list[list[int]], rarity: list[np.ndarray]):
        self.words = words
        self.least = np.array([next((c for c in range(1, len(w) + 1) if c / len(w) >= LEAK_WITH_ANSWER), 1) for w in words], np.int64)
        self.need = np.maximum(1, self.least // 3)
        self.span = np.array([WINDOW + 2 * len(w) for w in words], np.int64)
        posted: dict[tuple[int, int], int] = {}
        for i, w in enumerate(words):
            rare = np.argsort(-rarity[i], kind="stable")[:len(w) - int(self.least[i]) + int(self.need[i])]
            for j in rare.tolist():
                posted[w[j], i] = posted.get((w[j], i), 0) + 1
        keys = sorted(posted)
        self.word, self.first = np.unique(np.array([h for h, _ in keys], np.uint64), return_index=True)
        self.first = np.append(self.first, len(keys))
        self.item, self.times = np.array([i for _, i in keys], np.int64), np.array([posted[k] for k in keys], np.int64)
        self.where = []
        for w in words:
            bits: dict[int, int] = {}
            for j, h in enumerate(w):
                bits[h] = bits.get(h, 0) | 1 << j
            self.where.append(bits)
        # the items' words; by slot: words of any item, and words of an item; bits of an item's word, for items of up to 64
        self.known = np.unique(np.array([h for w in words for h in w], np.uint64))
        self.rare = np.full(len(self.known), -1, np.int64)
        self.rare[np.searchsorted(self.known, self.word)] = np.arange(len(self.word))
        self.any, self.held = np.zeros(1 << SLOT_BITS, bool), np.zeros(1 << SLOT_BITS, bool)
        pairs = sorted((i * len(self.known) + k, b) for i, bits in enumerate(self.where) if len(words[i]) <= 64
                       for k, b in zip(np.searchsorted(self.known, np.array(list(bits), np.uint64)).tolist(), bits.values(), strict=True))
        self.pair, self.bits = np.array([k for k, _ in pairs], np.int64), np.array([b for _, b in pairs], np.uint64)
        own = self.known[self.pair % max(1, len(self.known))]
        self.any[_slot(self.known)] = True
        self.held[_slot(own, self.pair // max(1, len(self.known)))] = True
        self.long = np.array([len(w) for w in words], np.int64)

    def places(self, t: Terms) -> tuple[np.ndarray, np.ndarray]:
        """(place, number) of the words that some item has."""
        at = np.flatnonzero(self.any[_slot(t.hash)])
        number = np.minimum(np.searchsorted(self.known, t.hash[at]), max(0, len(self.known) - 1))
        same = self.known[number] == t.hash[at] if len(at) else np.zeros(0, bool)
        return at[same], number[same]

    def windows(self, t: Terms, places: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(document, first word, item) of the windows that may hold 0.6 of an item."""
        none = (np.zeros(0, np.int64),) * 3
        if not len(self.word) or not len(t.hash):
            return none
        near = self.rare[places[1]]
        at, near = places[0][near >= 0], near[near >= 0]
        size = self.first[near + 1] - self.first[near]
        row = np.arange(int(size.sum())) + np.repeat(self.first[near] - (np.cumsum(size) - size), size)
        gap = int(self.span.max()) + 1
        item, place = self.item[row], np.repeat(at + t.doc[at] * gap, size)  # texts stand apart
        order = np.lexsort((place, item))
        item, place, times = item[order], place[order], self.times[row][order]
        key = item * (len(t.hash) + (t.n + 2) * gap) + place
        upto = np.concatenate(([0], np.cumsum(times)))
        span = self.span[item]
        ok = np.flatnonzero(upto[np.searchsorted(key, key + span)] - upto[:-1] >= self.need[item])
        if not len(ok):
            return none
        key, item, place, span = key[ok], item[ok], place[ok], span[ok]
        new = np.concatenate(([True], key[1:] - key[:-1] > span[1:]))
        new[1:] |= item[1:] != item[:-1]
        edge = np.flatnonzero(np.append(new, True))
        out: list[tuple[int, int, int]] = []
        first, last = edge[:-1], edge[1:] - 1
        doc = t.doc[at[np.searchsorted(t.doc[at] * gap + at, place[first])]]
        item, span, low, high = item[first], span[first], place[first] - doc * gap, place[last] - doc * gap  # first words of dense spans
        begin, end = t.first[doc], t.first[doc + 1]
        # every window whose surroundings begin up to its span before low and hold one of these words
        shared = self.shared(t, places, np.maximum(begin, low - span), np.minimum(end, high + span), item)
        for k in np.flatnonzero(shared >= self.least[item]).tolist():
            i, d, lo, hi, a, z = (int(x[k]) for x in (item, doc, low, high, begin, end))
            long = len(self.words[i])
            from_ = max(0, -(-(lo - WINDOW - long - a) // STEP))
            to = min(-(-(z - a) // STEP) - 1, (hi + long - a) // STEP)
            out.extend((d, a + b * STEP, i) for b in range(from_, to + 1))
        return tuple(np.array(x, np.int64) for x in zip(*sorted(set(out)), strict=True)) if out else none

    def enough(self, t: Terms, places: tuple[np.ndarray, np.ndarray], w: _Windows, window: np.ndarray, item: np.ndarray) -> np.ndarray:
        """Whether the words around each window share 0.6 of the item in order."""
        doc, long = w.doc[window], self.long[item]
        first, last = np.maximum(t.first[doc], w.at[window] - long), np.minimum(t.first[doc + 1], w.until[window] + long)
        return self.shared(t, places, first, last, item) >= self.least[item]

    def shared(self, t: Terms, places: tuple[np.ndarray, np.ndarray], first: np.ndarray, last: np.ndarray, item: np.ndarray) -> np.ndarray:
        """Longest common subsequence of each item and the words from ``first`` to ``last``.

        Over bit sets, the k-th words of many windows at once; items of more than 64 words one by one.
        """
        out, (hits, number) = np.zeros(len(item), np.int64), places
        words = t.hash[hits]
        for k in np.flatnonzero(self.long[item] > 64).tolist():
            out[k] = self._shared(int(item[k]), t.hash[first[k]:last[k]])
        short = np.flatnonzero(self.long[item] <= 64)
        begin, size = np.searchsorted(hits, first[short]), np.searchsorted(hits, last[short])
        size -= begin
        upto, lo = np.cumsum(size), 0
        while lo < len(short):
            hi = max(lo + 1, int(np.searchsorted(upto, upto[lo] - size[lo] + 500_000, side="right")))
            n, own = size[lo:hi], item[short[lo:hi]]
            line = np.repeat(np.arange(hi - lo), n)
            at = np.arange(len(line)) + np.repeat(begin[lo:hi] - (np.cumsum(n) - n), n)
            some = np.flatnonzero(self.held[_slot(words[at], own[line])])
            line, at = line[some], at[some]
            key = own[line] * len(self.known) + number[at]
            place = np.minimum(np.searchsorted(self.pair, key), max(0, len(self.pair) - 1))
            same = self.pair[place] == key if len(key) else np.zeros(0, bool)
            line, bits = line[same], self.bits[place[same]]
            n = np.bincount(line, minlength=hi - lo)
            order = np.argsort(-n, kind="stable")   # what still has a k-th word stands in front
            start, n = (np.cumsum(n) - n)[order], n[order]
            rest = np.uint64((1 << 64) - 1) >> (64 - self.long[own[order]]).astype(np.uint64)
            full = rest.copy()
            for k in range(int(n[0])):
                c = int(np.searchsorted(-n, -k))
                u = rest[:c] & bits[start[:c] + k]
                rest[:c] = ((rest[:c] + u) | (rest[:c] - u)) & full[:c]
            out[short[lo:hi][order]] = self.long[own[order]] - np.bitwise_count(rest)
            lo = hi
        return out

    def _shared(self, i: int, around: np.ndarray) -> int:
        """Longest common subsequence of an item and the words ``around``."""
        where, full = self.where[i], (1 << len(self.words[i])) - 1
        v = full
        for h in around.tolist():
            u = where.get(h)
            if u:
                u &= v
                v = ((v + u) | (v - u)) & full
        return len(self.words[i]) - v.bit_count()


def _matcher(state):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        weight, terms, vectors, items, exact = state.value
        bench = Terms([x[1] for x in items])
        words = [bench.hash[bench.first[i]:bench.first[i + 1]].tolist() for i in range(bench.n)]
        latent = _Latent(bench, weight, terms, vectors)
        rarest = _Rarest(words, [weight[bench.term[bench.first[i]:bench.first[i + 1]]] for i in range(bench.n)])
        for pdf in batches(frames):
            t = Terms(pdf["text"])
            w = _Windows(t)
            if not w.n or not len(latent.known):
                continue
            norm2 = np.concatenate(([0], np.cumsum(weight[t.term] ** 2, dtype=np.float64)))
            row = latent.rows(t)
            window, item = latent.windows(latent.folded(row, w))
            places = rarest.places(t)
            near = rarest.enough(t, places, w, window, item)
            window, item = window[near], item[near]
            if exact:   # what the retrieval has left
                doc, first, other = rarest.windows(t, places)
                rest = (w.first[doc] + (first - t.first[doc]) // STEP) * bench.n + other
                rest = np.setdiff1d(rest, window * bench.n + item)
                window, item = np.append(window, rest // bench.n), np.append(item, rest % bench.n)
            if len(window):
                cos = latent.cosine(row, w, norm2[w.until] - norm2[w.at], window, item)
                yield from _verified(pdf, t, w.at[window], w.until[window], w.doc[window], item, cos, items, words)

    def _verified(pdf, t, at, until, doc, item, cos, items, words) -> Iterator[pd.DataFrame]:
        best: dict[tuple[int, int], tuple] = {}
        for a, z, d, i, c in sorted(zip(at.tolist(), until.tolist(), doc.tolist(), item.tolist(), cos.tolist(), strict=True),
                                    key=lambda x: -x[4]):
            item_words = words[i]
            if best.get((d, i), (0, 0))[1] >= 1:
                continue
            lo = max(int(t.first[d]), a - len(item_words))
            hi = min(int(t.first[d + 1]), z + len(item_words))
            around = t.hash[lo:hi].tolist()
            share = common_subsequence(item_words, around) / len(item_words)
            if share < LEAK_WITH_ANSWER:
                continue
            answer = item_words[-ANSWER_WORDS:]
            has = common_subsequence(answer, around) >= ANSWER_SHARE * len(answer)
            if share >= LEAK or has:
                best[d, i] = max(best.get((d, i), (0.0, 0.0, False)), (c, share, has), key=lambda x: x[1])
        if best:
            yield pd.DataFrame({"doc_id": [pdf["doc_id"].iloc[d] for d, _ in best], "item_id": [items[i][0] for _, i in best],
                                "cosine": [float(v[0]) for v in best.values()], "lcs": [float(v[1]) for v in best.values()],
                                "answer": [bool(v[2]) for v in best.values()]})

    return run


def clean_documents(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``docs`` without those that hold a leak; rows without doc_id are judged by their own text."""
    key = F.struct(F.col("doc_id").alias("d"), F.xxhash64("text").alias("h"))
    marked = docs.select(key.alias("doc_id"), "text")
    found = leaks(marked, benchmark).select(F.col("doc_id.d").alias("_d"), F.col("doc_id.h").alias("_h")).distinct()
    j = docs.select(whole_row(docs).alias("_row"), F.xxhash64("text").alias("_th"))
    return j.join(found, F.col("_row.doc_id").eqNullSafe(F.col("_d")) & (F.col("_th") == F.col("_h")), "left_anti").select("_row.*")


def op7_decontaminate(spark, sf_dir: str) -> DataFrame:
    """Every (document, benchmark item) leak."""
    out = leaks(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return out.groupBy("doc_id", "item_id").agg(F.max("cosine").alias("cosine"), F.max("lcs").alias("lcs"),
                                                F.max("answer").alias("answer"))
