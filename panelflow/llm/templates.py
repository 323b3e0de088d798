"""Operator 12: main text of pages by equivalence classes of tokens across a host's pages."""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from panelflow.llm.markup import ARTICLE, KEEP, LIKELY, MAIN, NEVER, PERHAPS, Page, parse, role
from panelflow.llm.store import cut, discard
from panelflow.llm.urls import host_path
from panelflow.llm.words import batches

#: Share of a host's pages that a template token stands on, and tokens that a class has at least.
SUPPORT, CLASS_SIZE = 0.5, 2
#: Pages of a host from which on repeated text can be template, and the most of the main text that it may be.
TEXT_PAGES, TEXT_SHARE = 8, 0.2
#: Least share of the text outside furniture that marked elements hold, and of an element's text that its heir holds.
MARKED_SHARE, HEIR_SHARE = 0.25, 0.6
#: Share of a host's text from which on an element holds the page, whatever its marks.
HELD_SHARE = 0.8
#: Elements into which the search for the main text goes down.
CONTAINERS = frozenset("html body div section main article center table tbody tr td form header".split())
CHARS = 2_000_000
_TAG, _TEXT = 0, 1
_NUMBER = re.compile(r"\d+")


def _parts(page_hash: int, count: int) -> tuple[int, int]:
    """A page's share in a token's occurrence vector, as two 32-bit sums."""
    h = xxhash.xxh64_intdigest(page_hash.to_bytes(8, "little") + count.to_bytes(8, "little"))
    return h & 0xFFFFFFFF, h >> 32


def run_role(at: int, text: str) -> int:
    """The role of a run of text: its words below its element, numbers alike."""
    return role(at, "=" + _NUMBER.sub("0", " ".join(text.split())))


def subtree_text(page: Page) -> tuple[list[int], list[int]]:
    """(characters of text, of these in links) in and below each element."""
    size, linked = [0] * len(page.elements), [0] * len(page.elements)
    for element, text, _, link in page.runs:
        n = len(text.strip())
        size[element] += n
        linked[element] += n * link
    for i in range(len(size) - 1, 0, -1):
        up = page.elements[i][0]
        size[up] += size[i]
        linked[up] += linked[i]
    return size, linked


def outside(page: Page, spared: set[int] | frozenset[int]) -> list[bool]:
    """Whether each element lies in furniture: in or below one that can't hold main text, unless its role is spared.

    A header inside an article is the article's own.
    """
    out, in_article = [False] * len(page.elements), [False] * len(page.elements)
    for i in range(1, len(out)):
        up, role_, name, fate, likely = page.elements[i]
        in_article[i] = in_article[up] or (likely in (ARTICLE, MAIN) and fate == KEEP)
        own = fate == NEVER or fate == PERHAPS and role_ not in spared and not (name == "header" and in_article[up])
        out[i] = out[up] or own
    return out


# --- tokens of all pages, by host ------------------------------------------------------
_COLUMNS = ["host", "role", "kind", "parent", "name", "fate", "likely", "pages", "total", "low", "high", "chars", "link_chars"]
_SCHEMA = ("host string, role long, kind int, parent long, name string, fate int, likely int, pages long, total long, "
           "low long, high long, chars long, link_chars long")


def _page_tokens(page: Page) -> Iterator[tuple[tuple, int, int, int]]:
    """((role, kind, parent, name, fate, likely), count, characters, link characters) of each distinct token of a page."""
    size, linked = subtree_text(page)
    drop = outside(page, frozenset())
    found: dict[tuple, list[int]] = {}
    for i, (up, role_, name, fate, likely) in enumerate(page.elements):
        have = found.setdefault((role_, _TAG, page.elements[up][1] if i else -1, name, fate, likely), [0, 0, 0])
        have[0] += 1
        have[1] += size[i]
        have[2] += linked[i]
    for element, text, _, _ in page.runs:
        if not drop[element] and text.strip():
            at = page.elements[element][1]
            have = found.setdefault((run_role(at, text), _TEXT, at, None, KEEP, 0), [0, 0, 0])
            have[0] += 1
            have[1] += len(text.strip())
    for key, (count, chars, link_chars) in found.items():
        yield key, count, chars, link_chars


def _tokens(frames: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Sums per host and token over a batch of pages."""
    for pdf in batches(frames, "html", CHARS):
        sums: dict[tuple, np.ndarray] = defaultdict(lambda: np.zeros(6, np.int64))
        for host, html in zip(pdf["host"], pdf["html"], strict=True):
            html = html if isinstance(html, str) else ""
            seen = xxhash.xxh64_intdigest(html.encode("utf-8", "surrogatepass"))
            shares: dict[int, tuple[int, int]] = {}
            for key, count, chars, link_chars in _page_tokens(parse(html)):
                if count not in shares:
                    shares[count] = _parts(seen, count)
                sums[host, *key] += (1, count, *shares[count], chars, link_chars)
        rows = [(*key, *map(int, v)) for key, v in sums.items()]
        yield pd.DataFrame(rows, columns=_COLUMNS).astype({"kind": "int32", "fate": "int32", "likely": "int32"})


def tokens(pages: DataFrame) -> DataFrame:
    """One row per host and token role: pages it stands on, occurrences, a hash of its occurrence vector, text it holds.

    ``pages`` is (host, html).  A token is an element by its path (names and
    class, id, role and itemprop words) or a run of text below one.  Its
    occurrence vector, how often each page of the host has it, is hashed as
    two sums of 32-bit hashes of (page, count), so the vector itself, one
    entry per page, never exists anywhere and batches are summed before the
    shuffle.
    """
    part = pages.select("host", "html").mapInPandas(_tokens, _SCHEMA)
    first = [F.max(c).alias(c) for c in ("parent", "name", "fate", "likely")]
    return part.groupBy("host", "role", "kind").agg(
        *first, *[F.sum(c).alias(c) for c in ("pages", "total", "low", "high", "chars", "link_chars")])


def valid_tokens(found: DataFrame) -> DataFrame:
    """The tokens in valid equivalence classes, with their class and their host's number of pages.

    A class is all tokens of a host with the same occurrence vector; it is
    valid with at least CLASS_SIZE tokens on at least SUPPORT of the host's
    pages.  Text counts only where it stands on every page of a host of
    TEXT_PAGES pages or more.  What is left for a host is at most 1/SUPPORT
    times a page's tokens, however many pages it has.
    """
    root = found.where("role = 0").select(F.col("host").alias("_h"), F.col("pages").alias("host_pages"))
    often = found.where((F.col("kind") == _TAG) | (F.col("pages") >= TEXT_PAGES))
    d = often.join(root, F.col("host") == F.col("_h")).drop("_h")
    enough = F.when(F.col("kind") == _TEXT, F.col("pages") == F.col("host_pages")).otherwise(F.col("pages") >= F.col("host_pages") * SUPPORT)
    vector = ["host", "pages", "total", "low", "high"]
    d = d.where(enough).withColumn("size", F.count("*").over(Window.partitionBy(*vector)))
    return d.withColumn("class", F.xxhash64(*vector)).withColumn("valid", F.col("size") >= CLASS_SIZE)


# --- the template of a host --------------------------------------------------------------
def main_roles(nodes: dict[int, tuple[int, str, int, int, int, int]], spared: set[int]) -> list[int]:
    """The roles that hold the main text, of nested ``nodes``: role -> (parent, name, fate, likely, chars, link chars).

    Outermost marked elements outside furniture, the surest kind first, if
    they hold MARKED_SHARE of the text there; else down from the root as
    long as one container has HEIR_SHARE of the text that isn't in links.
    """
    below = defaultdict(list)
    for r, (parent, *_) in nodes.items():
        below[parent].append(r)
    alive, waiting = {}, [(0, False)]       # parents before children
    while waiting:
        r, inside = waiting.pop()
        _, name, fate, likely, _, _ = nodes[r]
        if r and (fate == NEVER or fate == PERHAPS and r not in spared and not (name == "header" and inside)):
            continue
        alive[r] = inside or (likely in (ARTICLE, MAIN) and fate == KEEP)
        waiting += [(c, alive[r]) for c in below[r]]
    own: dict[int, int] = {}                # text outside furniture
    for r in reversed(alive):
        own[r] = nodes[r][4] - sum(nodes[c][4] - own.get(c, 0) for c in below[r])
    for kind in (ARTICLE, MAIN, LIKELY):
        covered: dict[int, bool] = {}
        outer = []
        for r in alive:
            hit = nodes[r][3] == kind and r != 0
            covered[r] = hit or covered.get(nodes[r][0], False)
            if hit and not covered.get(nodes[r][0], False):
                outer.append(r)
        if outer and sum(own[r] for r in outer) >= MARKED_SHARE * own[0]:
            return sorted(outer)
    at = 0
    while True:
        plain = {c: max(0, own[c] - nodes[c][5]) for c in below[at] if c in alive and nodes[c][1] in CONTAINERS}
        best = max(plain, key=lambda c: (plain[c], -c), default=None)
        if best is None or not own[at] or plain[best] < HEIR_SHARE * own[at]:
            return [at]
        at = best


def spare(nodes: dict[int, tuple[int, str, int, int, int, int]]) -> set[int]:
    """Roles marked as furniture that hold HELD_SHARE of all text, where no marked main text stands outside furniture: they hold the page."""
    below = defaultdict(list)
    for r, (parent, *_) in nodes.items():
        below[parent].append(r)
    waiting, text = [0], nodes[0][4]
    while waiting:
        r = waiting.pop()
        if nodes[r][3] and nodes[r][4]:
            return set()
        text -= sum(nodes[c][4] for c in below[r] if nodes[c][2] == NEVER)
        waiting += [c for c in below[r] if nodes[c][2] == KEEP]
    return {r for r, v in nodes.items() if v[2] == PERHAPS and v[4] and v[4] >= HELD_SHARE * text}


def _template(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
    """(host, main, spared, constant) from a host's valid tokens: classes nested into a tree, and its slots that hold main text."""
    tags = rows[rows["kind"] == _TAG]
    below_any = defaultdict(list)
    for r, up in zip(tags["role"], tags["parent"], strict=True):
        below_any[int(up)].append(int(r))
    tags = tags[tags["valid"] | (tags["role"] == 0)]
    found = {int(r.role): (int(r.parent), r.name, int(r.fate), int(r.likely), int(r.chars), int(r.link_chars))
             for r in tags[["role", "parent", "name", "fate", "likely", "chars", "link_chars"]].itertuples(index=False, name="T")}
    nodes, waiting = {}, [0] if 0 in found else []
    below = defaultdict(list)
    for r, v in found.items():
        below[v[0]].append(r)
    while waiting:          # only what is nested in the classes above it
        r = waiting.pop()
        nodes[r] = found[r]
        waiting += below[r]
    spared = spare(nodes)
    main = main_roles(nodes, spared)
    inside, waiting = set(main), list(main)
    while waiting:
        more = [c for c in below_any[waiting.pop()] if c not in inside]
        inside.update(more)
        waiting += more
    body = rows[(rows["role"] == 0)].iloc[0]
    text = rows[(rows["kind"] == _TEXT) & rows["valid"] & rows["parent"].isin(inside)
                & (rows["low"] == body["low"]) & (rows["high"] == body["high"]) & (rows["total"] == body["total"])]
    whole = sum(nodes[r][4] for r in main)
    constant = [int(r) for r in text["role"]] if text["chars"].sum() <= TEXT_SHARE * whole else []
    return pd.DataFrame({"host": [key[0]], "main": [main], "spared": [sorted(spared)], "constant": [sorted(constant)]})


def templates(pages: DataFrame) -> DataFrame:
    """(host, main, spared, constant): the template of each host of ``pages`` (host, html).

    Valid classes nest by the paths of their elements; an element whose
    surroundings aren't valid is left out.  main: the elements whose slots
    hold the main text; spared: elements marked as furniture that hold most
    of the host's text; constant: text in the main slots that every page has
    once, as it has the root (never where that is more than TEXT_SHARE of
    the main text: copies of one article aren't a template).
    """
    found = cut(tokens(pages))     # read twice: all tokens, and each host's root
    out = cut(valid_tokens(found).groupBy("host").applyInPandas(
        _template, "host string, main array<long>, spared array<long>, constant array<long>"))
    discard(found)
    return out


# --- what is left in the slots -----------------------------------------------------------
def slot_text(page: Page, main: set[int], spared: set[int], constant: set[int]) -> str:
    """The blocks of the main slots, one per line; without the template's main elements the page's own choice."""
    roles = {e[1] for e in page.elements}
    if not main & roles:
        size, linked = subtree_text(page)
        sums = Counter()
        links = Counter()
        for i, e in enumerate(page.elements):
            sums[e[1]] += size[i]
            links[e[1]] += linked[i]
        nodes = {e[1]: (page.elements[e[0]][1] if i else -1, e[2], e[3], e[4], sums[e[1]], links[e[1]]) for i, e in enumerate(page.elements)}
        spared = spared | spare(nodes)
        main = set(main_roles(nodes, spared))
    drop, inside = outside(page, spared), [False] * len(page.elements)
    for i, e in enumerate(page.elements):
        inside[i] = e[1] in main or i > 0 and inside[e[0]]
    blocks: dict[int, list[str]] = {}
    for element, text, block, _ in page.runs:
        if inside[element] and not drop[element]:
            if not (constant and text.strip() and run_role(page.elements[element][1], text) in constant):
                blocks.setdefault(block, []).append(text)
    lines = (" ".join("".join(b).split()) for b in blocks.values())
    return "\n".join(line for line in lines if line)


def _extract(frames: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    sets: dict[bytes, frozenset[int]] = {}

    def as_set(v) -> frozenset[int]:
        if v is None or not len(v):
            return frozenset()
        v = np.asarray(v, np.int64)
        return sets.setdefault(v.tobytes(), frozenset(v.tolist()))

    for pdf in frames:
        pdf["text"] = [slot_text(parse(h if isinstance(h, str) else ""), as_set(m), as_set(s), as_set(c))
                       for h, m, s, c in zip(pdf["html"], pdf["main"], pdf["spared"], pdf["constant"], strict=True)]
        sets.clear()
        yield pdf.drop(columns=["html", "main", "spared", "constant"])


def main_texts(pages: DataFrame, keep: tuple[str, ...] = ("page_id", "url"), url: str = "url", html: str = "html") -> DataFrame:
    """``keep`` and text of every row of ``pages``: its main text, a line per block, empty if there is none.

    The host (see ``host_path``; null urls are one host) says which pages
    share a template.  Character references are decoded; white space inside
    a block, line breaks too, is one space.  Null html is an empty page;
    repeated rows and null ids are rows like others; an empty table gives no
    rows.  Other columns are not read.  The template table is written once;
    Spark joins it by its measured size, a hot host's pages are not grouped.
    """
    src = pages.select(*[F.col(f"`{c}`").alias(f"k{i}") for i, c in enumerate(keep)],
                       host_path(F.col(f"`{url}`"))[0].alias("host"), F.col(f"`{html}`").alias("html"))
    src = src.withColumn("host", F.coalesce("host", F.lit("")))
    known = templates(src).withColumnRenamed("host", "_h")
    j = src.join(known, F.col("host") == F.col("_h"), "left").drop("host", "_h")
    fields = [f"k{i} {src.schema[f'k{i}'].dataType.simpleString()}" for i in range(len(keep))]
    out = j.mapInPandas(_extract, ", ".join([*fields, "text string"]))
    return out.withColumnsRenamed({f"k{i}": c for i, c in enumerate(keep)})


def op12_templates(spark, sf_dir: str) -> DataFrame:
    """The main text of every page."""
    out = main_texts(spark.read.parquet(f"{sf_dir}/pages.parquet"))
    return out.withColumn("n_chars", F.length("text").cast("long"))
