"""Operator 13: alignment of two tokenizers by lockstep merging of their token ends."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from panelflow.llm.packed import pack, unpack
from panelflow.llm.store import cut
from panelflow.llm.words import batches

#: Folder of the tokenizers' files on every machine.
TOKENIZERS = "/opt/tokenizers"
#: The two files.  A: byte-level pairs; B: pieces with byte fallback, which puts a space before the text itself.
FILE_A, FILE_B = "byte_bpe_50k.json", "piece_bpe_32k.model"
#: Fixed value: how A's file splits a text before merging ("ByteLevel" with its own pattern).
SPLIT_A = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Characters of text worked on together, and A tokens that one pointer pair passes.
CHARS, LANE = 1_000_000, 64


def _byte_letters() -> dict[str, int]:
    """The letters by which byte-level vocabularies write bytes: printable Latin-1 as such, the others from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    other = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(0x100 + i): b for i, b in enumerate(other)}


@lru_cache(maxsize=2)
def byte_pairs(folder: str):
    """(encode, bytes by id) of A.

    The file's merges run in their order of ids, so its vocabulary doubles as
    merge ranks; special tokens are left out, so their strings are plain text.
    """
    import tiktoken

    with open(f"{folder}/{FILE_A}", encoding="utf-8") as f:
        model = json.load(f)
    special = {t["id"] for t in model["added_tokens"]}
    letters = _byte_letters()
    ranks = {bytes(letters[c] for c in entry): i for entry, i in model["model"]["vocab"].items() if i not in special}
    table = [b""] * (max(ranks.values()) + 1)
    for entry, i in ranks.items():
        table[i] = entry
    return tiktoken.Encoding("a", pat_str=SPLIT_A, mergeable_ranks=ranks, special_tokens={}).encode_ordinary, table


@lru_cache(maxsize=2)
def pieces(folder: str):
    """(encode, bytes by id) of B."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=f"{folder}/{FILE_B}")
    table = []
    for i in range(model.get_piece_size()):
        piece = model.id_to_piece(i)
        table.append(bytes([int(piece[1:-1], 16)]) if model.is_byte(i) else piece.replace("▁", " ").encode("utf-8"))
    return (lambda text: model.encode(text, num_threads=1)), table


@dataclass
class Aligned:
    """A batch of texts, tokenised and aligned.

    ``a``/``b`` hold all token ids, ``first_a``/``first_b`` the index of each
    text's first one (one entry more than texts); ``cut_a``/``cut_b`` mark
    the tokens that end a group; link l joins tokens ``link_a[l]`` and
    ``link_b[l]``, in text order.
    """

    a: np.ndarray
    b: np.ndarray
    first_a: np.ndarray
    first_b: np.ndarray
    cut_a: np.ndarray
    cut_b: np.ndarray
    link_a: np.ndarray
    link_b: np.ndarray

    def links_until(self) -> np.ndarray:
        """Index of each text's first link, one entry more than texts."""
        return np.searchsorted(self.link_a, self.first_a)


def lockstep(end_a: np.ndarray, end_b: np.ndarray, first: np.ndarray, lane: int = LANE):
    """(link_a, link_b, cut_a, cut_b) of two rows of token ends (byte offsets) that reach the same end.

    ``first``: the A index at which each text starts, and the number of A
    tokens.  State is a vector of (A, B) pointers, one pair for each text;
    a text of more than ``lane`` A tokens is dealt to several pairs, each
    set down where its first A token starts.  Each step links all pairs'
    current tokens, marks a cut where both end together, moves the pointer
    that ends first (both at a cut) and compacts away the finished pairs.
    """
    sizes = np.diff(first)
    lanes = -(-sizes // lane)
    nth = np.arange(lanes.sum()) - np.repeat(np.cumsum(lanes) - lanes, lanes)
    i = np.repeat(first[:-1], lanes) + nth * lane
    last = np.minimum(i + lane, np.repeat(first[1:], lanes))
    start = np.where(i > 0, end_a[i - 1], 0) if len(i) else i
    j = np.searchsorted(end_b, start, side="right")
    linked, cuts = [(i[:0], j[:0])], [(i[:0], j[:0])]
    while len(i):
        linked.append((i, j))
        ea, eb = end_a[i], end_b[j]
        both = ea == eb
        cuts.append((i[both], j[both]))
        i, j = i + (ea <= eb), j + (eb <= ea)
        going = i < last
        if not going.all():
            i, j, last = i[going], j[going], last[going]
    link_a, link_b = (np.concatenate(x) for x in zip(*linked, strict=True))
    order = np.argsort(link_a.astype(np.int64) * (len(end_b) + 1) + link_b)
    marks = np.zeros(len(end_a), bool), np.zeros(len(end_b), bool)
    for mark, at in zip(marks, zip(*cuts, strict=True), strict=True):
        mark[np.concatenate(at)] = True
    return link_a[order], link_b[order], *marks


def align(texts: list[str | None], folder: str = TOKENIZERS, lane: int = LANE) -> Aligned:
    """Tokenise and align texts; null and empty ones, and those whose bytes a tokenizer changes, have no tokens."""
    (encode_a, bytes_a), (encode_b, bytes_b) = byte_pairs(folder), pieces(folder)
    size_a, size_b = (np.fromiter(map(len, t), np.int64, len(t)) for t in (bytes_a, bytes_b))
    ids: list[list[np.ndarray]] = [[], []]
    none = np.zeros(0, np.int32)
    for text in texts:
        pair = [none, none]
        if text:
            whole = " " + text
            raw = whole.encode("utf-8")
            a, b = encode_a(whole), encode_b(text)
            if b"".join([bytes_a[x] for x in a]) == raw and b"".join([bytes_b[x] for x in b]) == raw:
                pair = [np.array(a, np.int32), np.array(b, np.int32)]
        for side, x in zip(ids, pair, strict=True):
            side.append(x)
    a, b = (np.concatenate([none, *side]) for side in ids)
    first_a, first_b = (np.cumsum([0, *map(len, side)]) for side in ids)
    link_a, link_b, cut_a, cut_b = lockstep(np.cumsum(size_a[a]), np.cumsum(size_b[b]), first_a, lane)
    return Aligned(a, b, first_a, first_b, cut_a, cut_b, link_a, link_b)


@lru_cache(maxsize=4)
def _digits(top: int) -> tuple[np.ndarray, np.ndarray]:
    """Decimal digits of 0..top-1 and room for one more character, and their number."""
    text = [str(i).encode() for i in range(top)]
    size = np.fromiter(map(len, text), np.int64, top)
    table = np.zeros((top, len(text[-1]) + 1), np.uint8)
    for i, t in enumerate(text):
        table[i, :len(t)] = np.frombuffer(t, np.uint8)
    return table, size


def written_groups(x: Aligned) -> list[bytes]:
    """Each text's groups as ``a1,a2|b1;a3|b2,b3``: decimal ids, A tokens before B tokens."""
    n_a, n_b = len(x.a), len(x.b)
    group_a, group_b = np.cumsum(x.cut_a) - x.cut_a, np.cumsum(x.cut_b) - x.cut_b
    before_b = np.concatenate(([0], np.flatnonzero(x.cut_b) + 1))     # B tokens before each group
    before_a = np.concatenate(([0], np.flatnonzero(x.cut_a) + 1))
    place_a = np.arange(n_a) + before_b[group_a]
    place_b = np.arange(n_b) + before_a[group_b + 1]
    token, mark = np.zeros(n_a + n_b, np.int64), np.full(n_a + n_b, ord(","), np.uint8)
    token[place_a], token[place_b] = x.a, x.b
    mark[place_a[x.cut_a]], mark[place_b[x.cut_b]] = ord("|"), ord(";")
    table, size = _digits(int(token.max(initial=9)) + 1)
    length = size[token]
    chars = table[token]
    chars[np.arange(len(token)), length] = mark
    flat = chars[np.arange(table.shape[1]) <= length[:, None]]
    ends = np.concatenate(([0], np.cumsum(length + 1)))
    border = ends[x.first_a + x.first_b]
    return [flat[s:max(s, e - 1)].tobytes() for s, e in zip(border[:-1], border[1:], strict=True)]


def alignments(docs: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",), folder: str = TOKENIZERS) -> DataFrame:
    """``keep``, groups array<struct<a array<int>, b array<int>>>, links array<struct<a int, b int>> of each text.

    Links are token numbers (from 0) within the text whose byte ranges
    overlap.  Null and empty texts, and those whose joined token bytes differ
    from the space and the text, have empty arrays.  Repeated rows are kept;
    other columns of ``docs`` are not read.
    """
    fields = ", ".join(f"k{i} {docs.schema[c].dataType.simpleString()}" for i, c in enumerate(keep))

    def run(frames):
        for pdf in batches(frames, "text", CHARS):
            x = align(list(pdf["text"].where(pdf["text"].notna(), None)), folder)
            at, groups, links = x.links_until(), [], []
            for d in range(len(pdf)):
                (a0, a1), (b0, b1) = x.first_a[d:d + 2], x.first_b[d:d + 2]
                a = np.split(x.a[a0:a1], np.flatnonzero(x.cut_a[a0:a1]) + 1)[:-1]
                b = np.split(x.b[b0:b1], np.flatnonzero(x.cut_b[b0:b1]) + 1)[:-1]
                groups.append([{"a": u, "b": v} for u, v in zip(a, b, strict=True)])
                span = slice(at[d], at[d + 1])
                links.append([{"a": u, "b": v} for u, v in zip(x.link_a[span] - a0, x.link_b[span] - b0, strict=True)])
            yield pdf.drop(columns="text").assign(groups=groups, links=links)

    src = docs.select(*[F.col(f"`{c}`").alias(f"k{i}") for i, c in enumerate(keep)], F.col(f"`{text}`").alias("text"))
    out = src.mapInPandas(run, f"{fields}, groups array<struct<a:array<int>,b:array<int>>>, links array<struct<a:int,b:int>>")
    return out.withColumnsRenamed({f"k{i}": c for i, c in enumerate(keep)})


# --- corpus counts of linked id pairs ------------------------------------------------
_DOCS = "id array<string>, n_a array<long>, n_b array<long>, n_groups array<long>, n_links array<long>, groups_sha256 array<string>"
_PAIRS = "pair_a array<int>, pair_b array<int>, docs array<int>"


def _gathered(folder: str):
    """Per batch one row: the documents' own figures, its distinct id pairs, and which of them each document holds how often."""
    def run(frames):
        task, nth = TaskContext.get().partitionId(), 0
        for pdf in batches(frames, "text", CHARS):
            x = align(list(pdf["text"].where(pdf["text"].notna(), None)), folder)
            at, n = x.links_until(), len(pdf)
            pair = x.a[x.link_a].astype(np.int64) << 32 | x.b[x.link_b]
            doc = np.repeat(np.arange(n), np.diff(at))
            pairs, local = np.unique(pair, return_inverse=True)
            held, times = np.unique(doc * max(1, len(pairs)) + local, return_counts=True)
            own, index = held // max(1, len(pairs)), held % max(1, len(pairs))
            groups = np.concatenate(([0], np.cumsum(x.cut_a)))[x.first_a]
            sha = [hashlib.sha256(g).hexdigest() if g else "" for g in written_groups(x)]
            yield pd.DataFrame({
                "batch": [task << 32 | nth], "id": [list(pdf["id"].astype(object).where(pdf["id"].notna(), None))],
                "n_a": [np.diff(x.first_a)], "n_b": [np.diff(x.first_b)], "n_groups": [np.diff(groups)],
                "n_links": [np.diff(at)], "groups_sha256": [sha],
                "pair_a": [(pairs >> 32).astype(np.int32)], "pair_b": [(pairs & 0xFFFFFFFF).astype(np.int32)],
                "docs": [np.bincount(index, minlength=len(pairs)).astype(np.int32)],
                "held": [pack(np.searchsorted(own, np.arange(n + 1)), index.astype(np.uint32), times.astype(np.uint32))]})
            nth += 1
    return run


def _scored(key: tuple, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
    """Each document's sums over its links, from its batch's row and the counts of the batch's pairs."""
    row = left.iloc[0]
    first, index, times = unpack(row["held"])
    count, best = np.zeros(int(index.max(initial=0)) + 1, np.int64), np.zeros(int(index.max(initial=0)) + 1, np.int64)
    count[right["pos"].to_numpy()], best[right["pos"].to_numpy()] = right["count"].to_numpy(), right["best"].to_numpy()
    sums = [np.concatenate(([0], np.cumsum(v[index] * times.astype(np.int64)))) for v in (best, count)]
    out = {c: row[c] for c in ("id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256")}
    out |= {c: s[first[1:]] - s[first[:-1]] for c, s in zip(("n_best", "count_sum"), sums, strict=True)}
    return pd.DataFrame(out)


def pair_counts(gathered: DataFrame) -> DataFrame:
    """(a, b, count, best): in how many documents each id pair is linked; best: no pair of that A id has more."""
    pairs = gathered.select(F.explode(F.arrays_zip("pair_a", "pair_b", "docs")).alias("p"))
    pairs = pairs.groupBy(F.col("p.pair_a").alias("a"), F.col("p.pair_b").alias("b")).agg(F.sum("p.docs").alias("count"))
    return pairs.withColumn("best", F.col("count") == F.max("count").over(Window.partitionBy("a")))


def link_digests(docs: DataFrame, text: str = "text", key: str = "doc_id", folder: str = TOKENIZERS) -> DataFrame:
    """One row per row of ``docs``: its id, token, group and link numbers, sums over corpus counts of its links, group hash.

    A pair's count is the number of rows of ``docs`` that link it (repeated
    rows and null ids are rows like others).  Texts go to Python in batches
    bounded in characters (a longer text is a batch of its own); a batch
    sends each distinct pair once, so a pair of all documents meets as many
    rows as there are batches, and gets its count back once per batch.
    Null, empty and changed texts: zeros and an empty hash.  An empty table:
    no rows.  Columns other than ``key`` and ``text`` are not read.
    """
    kind = docs.select(f"`{key}`").schema[0].dataType
    src = docs.select(F.col(f"`{key}`").cast("string").alias("id"), F.col(f"`{text}`").alias("text"))   # pandas has no null long
    gathered = cut(src.mapInPandas(_gathered(folder), f"batch long, {_DOCS}, {_PAIRS}, held binary"))
    counts = pair_counts(gathered)
    asked = gathered.select(F.col("batch").alias("of"), F.posexplode(F.arrays_zip("pair_a", "pair_b")).alias("pos", "p"))
    asked = asked.select("of", "pos", F.col("p.pair_a").alias("a"), F.col("p.pair_b").alias("b"))
    told = asked.join(counts, ["a", "b"]).select("of", "pos", "count", F.col("best").cast("int").alias("best"))
    figures = gathered.drop("pair_a", "pair_b", "docs")
    schema = "id string, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"
    out = figures.groupBy("batch").cogroup(told.groupBy("of")).applyInPandas(_scored, schema)
    return out.withColumn("id", F.col("id").cast(kind)).withColumnRenamed("id", key)


def op13_alignment(spark, sf_dir: str) -> DataFrame:
    """Alignment figures of every document between the two tokenizers."""
    return link_digests(spark.read.parquet(f"{sf_dir}/documents.parquet"))
