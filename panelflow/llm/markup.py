"""HTML pages as nested elements and runs of text, as far as text extraction needs it."""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from functools import lru_cache
from html import unescape

import xxhash

_TOKEN = re.compile(
    r"<!--.*?(?:--!?>|\Z)|<[!?][^>]*(?:>|\Z)|</([a-zA-Z][^\s/>]*)[^>]*(?:>|\Z)"
    r"|<([a-zA-Z][^\s/>]*)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>|<([a-zA-Z][^\s/>]*)([^>]*)(?:>|\Z)", re.DOTALL)
_ATTRIBUTE = re.compile(r"(?:^|[\s\"'/])(class|id|role|itemprop|hidden|style)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+))?(?=[\s/]|$)", re.IGNORECASE)
_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")

#: Elements by what they do to the text around them: none, no inside, an inside that isn't markup, no block of their own.
SILENT = frozenset("script style noscript template".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style iframe noembed noframes noscript xmp textarea title".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp "
                   "small span strike strong sub sup time tt u var wbr img input".split())
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"},
          "option": {"option"}, "tbody": {"thead", "tbody", "tr", "td", "th"}, "body": {"head"}}
SCOPE = frozenset("table ul ol dl td th button article section aside main nav body html".split())

#: Elements that never hold main text, and those that do so only if they hold most of a site's text.
OUTSIDE = frozenset("head nav aside footer script style noscript template iframe noembed noframes svg button select "
                    "textarea title dialog menu object canvas audio video datalist".split())
DOUBTFUL = frozenset(("header", "form"))
#: Words of class, id and role that mark what isn't main text.  Of the first kind also where most of the text is.
OTHERS_TEXT = frozenset("comment comments disqus reply replies respond ad ads advert advertisement advertising adsense sponsor "
                        "sponsored promo related recommended teaser".split())
FURNITURE = frozenset("nav navbar navigation menu breadcrumb breadcrumbs pagination pager cookie cookies consent gdpr newsletter "
                      "subscribe subscription signup login share sharing social recommendations popup modal overlay widget header "
                      "masthead footer sidebar aside banner notice notices alert toolbar topbar form search contentinfo "
                      "complementary dialog".split())
#: Words that mark main text.
CONTENT = frozenset("content article story post entry".split())
_BODY = frozenset("body text content".split())

ARTICLE, MAIN, LIKELY = 1, 2, 3                 # how sure an element holds main text
KEEP, PERHAPS, NEVER = 0, 1, 2                  # whether it can hold main text at all


@lru_cache(maxsize=65536)
def label(name: str, attributes: str) -> tuple[str, int, int]:
    """(label, NEVER..KEEP, ARTICLE..0) of a start tag: its name and the words of its class, id, role and itemprop."""
    words, label_, hidden = set(), name, False
    if attributes.strip():
        for key, value in _ATTRIBUTE.findall(attributes):
            key, value = key.lower(), value.strip("\"'")
            if key == "hidden" or key == "style":
                hidden |= key == "hidden" or "display:none" in value.replace(" ", "").lower()
                continue
            own = [w.lower() for w in _WORD.findall(value)]
            words.update(own)
            label_ += f" {key}=" + "-".join(own)
    likely = ARTICLE if name == "article" or {"article", "body"} <= words else MAIN if name == "main" or "main" in words \
        else LIKELY if words & CONTENT and (words & _BODY or len(words) == 1) else 0
    if name in OUTSIDE or hidden:
        fate = NEVER
    elif name in ("html", "body"):
        fate = KEEP
    elif words & OTHERS_TEXT:
        fate = NEVER
    elif name in ("article", "main"):
        fate = KEEP
    else:
        fate = PERHAPS if name in DOUBTFUL or words & FURNITURE else KEEP
    return label_, fate, likely


@lru_cache(maxsize=262144)
def role(parent: int, what: str) -> int:
    """A 63-bit name of a token by its path from the root."""
    return xxhash.xxh64_intdigest(f"{parent} {what}".encode("utf-8", "surrogatepass")) >> 1


@dataclass
class Page:
    """Elements in page order (parent's index, role, name, fate, likely) and text runs (element, text, block, in a link).

    Element 0 is the root around everything.
    """

    elements: list[tuple[int, int, str, int, int]] = field(default_factory=lambda: [(-1, 0, "", KEEP, 0)])
    runs: list[tuple[int, str, int, bool]] = field(default_factory=list)


def parse(html: str | None) -> Page:
    """The elements and text of a page; null is an empty one.

    Tags needn't be closed: a block ends an open paragraph, an item the item
    before it, and an end tag closes what stands open inside its element.
    Comments, declarations and the insides of scripts and the like are left
    out.  Character references are decoded.
    """
    page, at, block = Page(), 0, 0
    html = html or ""
    elements, runs = page.elements, page.runs
    stack, links = [0], 0
    names = [""]

    def pop_to(depth: int):
        nonlocal links
        while len(stack) > depth:
            stack.pop()
            links -= names.pop() == "a"

    def text(piece: str):
        if piece:
            runs.append((stack[-1], unescape(piece) if "&" in piece else piece, block, links > 0))

    where = 0
    while True:
        m = _TOKEN.search(html, where)
        if m is None:
            text(html[at:])
            return page
        text(html[at:m.start()])
        at = where = m.end()
        end, name = m[1], m[2] or m[4]
        if end:
            end = end.lower()
            block += end not in INLINE and end not in SILENT
            for k in range(len(names) - 1, 0, -1):
                if names[k] == end:
                    pop_to(k)
                    break
                if end in INLINE and names[k] not in INLINE or end == "p" and names[k] in SCOPE:
                    break
        elif name:
            name = name.lower()
            attributes = m[3] if m[2] else m[5]
            if name == "br":
                text(" ")
            if name not in INLINE and name not in SILENT and name != "br":
                block += 1
                closes = CLOSES.get(name, ())
                for k in range(len(names) - 1, 0, -1):
                    if names[k] == "p" or names[k] in closes:
                        pop_to(k)
                        if not closes:
                            break
                    elif names[k] in SCOPE and names[k] not in closes:
                        break
            label_, fate, likely = label(name, attributes)
            parent = stack[-1]
            elements.append((parent, role(elements[parent][1], label_), name, fate, likely))
            if name in VOID or attributes.endswith("/") and name not in INLINE and name not in RAW and name not in ("div", "p"):
                continue
            if name in RAW:
                close = re.compile(rf"</{name}(?=[\s/>])", re.IGNORECASE).search(html, at)
                at = where = close.start() if close else len(html)
            stack.append(len(elements) - 1)
            names.append(name)
            links += name == "a"
