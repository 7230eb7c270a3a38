"""Main text of web pages by equivalence classes of structural tokens across the pages of a host.

A structural token is a container element by its path of tags and class words, or a block's text in such a container. Its
occurrence vector says how often each distinct page of the host has it; tokens with equal vectors form a class. A class
is valid if enough pages have it, and if its members nest: a block's text belongs to the class of a container on its own
path. Text of valid classes is the host's template, such as notices that every page repeats, or the label of a box that
stands wherever the box does; text that repeats on its own is not. Vectors are never built: sums of a hash of (page,
count) stand for each, so that hosts of any size aggregate in parts before the shuffle.

What is left fills the slots. Boilerplate among it goes by element names, roles and class words, unless it is a wrapper
of the page's content, and the main slot is the deepest element above all of the page's running text, so that sibling
containers and several articles are kept. A host of fewer than MIN_PAGES distinct pages has no template: there, only
names, roles, class words and the main slot decide.
"""

from __future__ import annotations

import hashlib
import html as entities
import re
from collections import Counter
from collections.abc import Collection, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import bounded, carried, released, table
from .sentencepiece_codec import _pieces

#: Share of a host's distinct pages, and how many of them at least, that a valid class needs.
SUPPORT, MIN_PAGES = 0.6, 10
#: Containers within containers that are told apart.
DEEPEST = 256
#: Hosts whose templates may be broadcast; more are joined by a shuffle.
BROADCAST_HOSTS = 50_000

# HTML element names by what they do.
RAW = frozenset("script style noscript template iframe svg textarea select title xmp noembed noframes".split())
TO_THE_END = frozenset("script style textarea title xmp".split())
CONTAINERS = frozenset("html head body div section article main nav aside header footer form ul ol dl table figure details dialog fieldset menu".split())
BLOCKS = CONTAINERS | frozenset("p h1 h2 h3 h4 h5 h6 li dt dd pre blockquote hr tr td th thead tbody tfoot caption figcaption address summary legend option hgroup search center".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BOILER_TAGS = frozenset("head nav aside footer menu dialog button header".split())
#: Boilerplate unless they wrap the page's content.
FORM_TAGS = frozenset("form fieldset".split())
BOILER_WORDS = frozenset(
    "ad ads advert adverts advertisement advertising adbox adslot sponsor sponsored promo promotion nav navbar navigation menu breadcrumb breadcrumbs header masthead topbar "
    "footer sidebar side aside widget widgets related recommended recommendations share sharing social cookie cookies consent gdpr notice notices alert banner popup modal overlay "
    "newsletter subscribe subscription signup login search comment comments commentlist disqus respond response responses replies reply discussion form hidden".split()
)
#: What readers say: dropped however much of the page's text it is.
READER_WORDS = frozenset("comment comments commentlist disqus respond response responses replies reply discussion".split())
#: Words that make a class name tell a state: "has-sidebar", "comments-open".
STATE_WORDS = frozenset("has no not non with without is js free open opened closed enabled disabled responsive on off hide only".split())
BOILER_ROLES = frozenset("navigation banner contentinfo complementary search form alert alertdialog dialog menu menubar toolbar".split())

_PATTERN = r"""<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']++|"[^"{0}]*+"|'[^'{0}]*+')*+)(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|\Z)"""
#: Tags with quoted values; where more than ODD_QUOTES tags of a page have an odd quote, no value reaches beyond the next tag.
_TOKEN, _SHORT, ODD_QUOTES = re.compile(_PATTERN.format(""), re.S), re.compile(_PATTERN.format("<"), re.S), 20
_ATTR = re.compile(r"""([a-zA-Z-]+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""")
_NAME = re.compile(r"[a-z]+")
_HUMP = re.compile(r"(?<=[a-z])(?=[A-Z])")


@dataclass
class Element:
    """A container on the page: its role (path), why it looks like boilerplate (0: it doesn't, 1: by a wrapper's name, 2: it
    is), its article rank, and whether it or one above is boilerplate for good."""

    tag: str
    role: str
    flag: int
    rank: int
    above: Element | None = field(repr=False, default=None)
    boiler: bool = False
    running: int = 0


def _open(tag: str, attrs: str, above: Element) -> Element:
    found = {k.lower(): entities.unescape((v or "").strip("\"'")) for k, v in _ATTR.findall(attrs)}
    names: set[str] = set()
    for a in ("id", "class"):
        for part in found.get(a, "").split():
            words = _NAME.findall(_HUMP.sub(" ", part).lower())
            names.update(words if STATE_WORDS.isdisjoint(words) else ())
    label = tag + "".join(f".{w}" for w in dict.fromkeys(_NAME.findall(found.get("class", "").lower()))) + (f"#{'-'.join(_NAME.findall(found['id'].lower()))}" if found.get("id") else "")
    in_article = above.rank == 2 or above.tag == "article"
    named = BOILER_WORDS & names - ({"header", "hidden"} if in_article else set()) if tag not in ("html", "body", "main") else set()
    if tag == "article":
        named &= READER_WORDS
    strict = (tag in BOILER_TAGS and not (tag == "header" and in_article)) or found.get("role", "").lower() in BOILER_ROLES - {"form"} or "hidden" in found or found.get("aria-hidden") == "true"
    flag = 2 if strict or named & READER_WORDS else 1 if named or tag in FORM_TAGS or found.get("role", "").lower() == "form" else 0
    rank = 2 if tag == "article" or "articlebody" in found.get("itemprop", "").lower() else 1 if tag == "main" or found.get("role") == "main" else 0
    return Element(tag, f"{above.role}/{label}", flag, rank, above)


def _settle(parts: list[tuple[Element, str, int]], seen: list[Element]) -> None:
    """Decide which elements are boilerplate: those flagged and all below, but for wrappers of the page's content.

    A wrapper is an element flagged by its name alone that holds the page's articles while none stands outside such
    elements, or that holds more than half of all running text where the page has no article.
    """
    for e, text, linked in parts:
        e.running += len(text) - linked
    for e in reversed(seen):
        if e.above:
            e.above.running += e.running
    hard = {id(None): False}
    for e in seen:
        hard[id(e)] = e.flag == 2 or hard[id(e.above)]
        e.boiler = bool(e.flag) or bool(e.above and e.above.boiler)
    articles = [e for e in seen if e.rank and e.running and not e.flag and not hard[id(e)]]
    if any(not e.boiler for e in articles):
        return
    best = max(articles, key=lambda e: e.running, default=None)
    wrappers = {id(x) for x in _path(best)} if best else {id(e) for e in seen if 2 * e.running > seen[0].running}
    for e in seen:
        e.flag = 0 if e.flag == 1 and id(e) in wrappers else e.flag
        e.boiler = bool(e.flag) or bool(e.above and e.above.boiler)


def blocks(page: str) -> tuple[list[tuple[Element, str, int]], list[Element]]:
    """(container, text, characters in links) of each block in page order, and all containers. Tag soup is fine."""
    root = Element("", "", 0, 0)
    seen, out = [root], []
    # Tags that are open and their elements; containers beyond DEEPEST stand for the one they are in.
    stack, opened = [("", root)], Counter()
    buf: list[str] = []
    linked, in_link = 0, False

    def flush() -> None:
        nonlocal linked
        if buf:
            text = " ".join("".join(buf).split())
            if text:
                out.append((stack[-1][1], text, linked))
        buf.clear()
        linked = 0

    at, end, odd = 0, len(page), 0
    unclosed: set[str] = set()
    while at < end:
        m = (_TOKEN if odd <= ODD_QUOTES else _SHORT).search(page, at)
        upto = m.start() if m else end
        if upto > at:
            text = entities.unescape(page[at:upto])
            buf.append(text)
            linked += len(text) * in_link
        if not m:
            break
        at = m.end()
        tag = (m[2] or m[5] or "").lower()
        closing, attrs = bool(m[1] or m[4]), m[3] if m[2] else m[6]
        odd += m[5] is not None
        if not tag:
            continue
        if tag in RAW and not closing:
            if tag not in unclosed and (tag in TO_THE_END or not (attrs or "").rstrip().endswith("/")):
                close = re.compile(rf"</{re.escape(tag)}\s*(?:>|\Z)", re.I).search(page, at)
                # Scripts and the like reach to the end without a closing tag; of others only the tag is left out.
                at = close.end() if close else end if tag in TO_THE_END else at
                if not close:
                    unclosed.add(tag)
            continue
        if tag == "br":
            buf.append(" ")
        elif tag == "a":
            in_link = not closing
        if tag in BLOCKS:
            flush()
            in_link = False if tag in CONTAINERS else in_link
        if tag in CONTAINERS and tag not in VOID:
            if not closing:
                deep = len(stack) > DEEPEST
                e = stack[-1][1] if deep else _open(tag, attrs or "", stack[-1][1])
                stack.append((tag, e))
                opened[tag] += 1
                seen += [] if deep else [e]
            while closing and opened[tag]:
                last = stack.pop()[0]
                opened[last] -= 1
                if last == tag:
                    break
        elif tag == "button" and not closing and tag not in unclosed:
            close = re.compile(r"</button\s*>", re.I).search(page, at)
            at = close.end() if close else at
            if not close:
                unclosed.add(tag)
    flush()
    _settle(out, seen)
    return out, seen


def main_text(page: str | None, template: Collection[int] = ()) -> str:
    """The main slot's blocks without boilerplate, joined by blank lines: the smallest element that holds all running text.

    Only what is boilerplate or the template's text, and blocks of nothing but links outside that element, are left out.
    A page of nothing but template text keeps it: there, nothing tells the template from the content.
    """
    kept = [part for part in blocks(page or "")[0] if not part[0].boiler]
    kept = [part for part in kept if _token(part[0].role, part[1]) not in template] or kept if template else kept
    shared: list[Element] | None = None
    for e, text, linked in kept:
        if len(text) > linked:
            path = _path(e)
            if shared is None:
                shared = path
            else:
                n = next((k for k, (x, y) in enumerate(zip(shared, path, strict=False)) if x is not y), min(len(shared), len(path)))
                del shared[n:]
    main = shared[-1] if shared else None
    return "\n\n".join(text for e, text, _ in kept if main is None or any(x is main for x in _path(e)))


def _token(role: str, text: str) -> int:
    """The number of a block's text in a container."""
    return int.from_bytes(hashlib.blake2b(f"{role}\0{text}".encode(errors="replace"), digest_size=8).digest(), "big", signed=True)


def _path(e: Element | None) -> list[Element]:
    """The elements from the page down to e."""
    up = []
    while e is not None:
        up.append(e)
        e = e.above
    return up[::-1]


def occurrences(pages: DataFrame, host: str, page: str) -> DataFrame:
    """(host, role, token, a, b, pages) of each container (token null) and block text of each host; (a, b) stands for its vector."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in _pieces(whole, 2):
                rows = []
                for h, k, p in zip(*(c.to_pylist() for c in b.columns), strict=True):
                    parts, seen = blocks(p or "")
                    found = Counter((e.role, None) for e in seen if not e.boiler)
                    found.update((e.role, _token(e.role, text)) for e, text, _ in parts if not e.boiler)
                    rows += [(h, role, token, k, n) for (role, token), n in found.items()]
                cols = list(zip(*rows, strict=True)) or [()] * 5
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, (pa.string(), pa.string(), pa.int64(), pa.int64(), pa.int64()), strict=True)], names=["host", "role", "token", "k", "n"])

    each = pages.select(F.col(host).alias("host"), F.xxhash64(page).alias("k"), F.col(page).alias("page")).mapInArrow(run, "host string, role string, token long, k long, n long")
    # Equal pages of a host count once.
    each = each.groupBy("host", "role", "token", "k").agg(F.max("n").alias("n"))
    half = lambda seed: F.sum(F.xxhash64("k", "n", F.lit(seed)).bitwiseAND(F.lit((1 << 31) - 1)))
    return each.groupBy("host", "role", "token").agg(half(1).alias("a"), half(2).alias("b"), F.count(F.lit(1)).alias("pages"))


def templates(found: DataFrame, support: float = SUPPORT, min_pages: int = MIN_PAGES) -> DataFrame:
    """(host, template): the tokens of block texts in valid classes.

    A class's containers nest by themselves: what is above a container has all of its pages, hence their support.
    """
    size = found.where("role = '' AND token IS NULL").select("host", F.col("pages").alias("of"))
    many = table(found.where(F.col("pages") >= min_pages).join(size, "host").where(F.col("pages") >= support * F.col("of")))
    frames = many.where("token IS NULL").select("host", "a", "b", "pages", F.col("role").alias("frame"))
    texts = many.where("token IS NOT NULL").join(frames, ["host", "a", "b", "pages"])
    return texts.where((F.col("role") == F.col("frame")) | F.startswith("role", F.concat("frame", F.lit("/")))).groupBy("host").agg(F.array_sort(F.collect_set("token")).alias("template"))


def extract(pages: DataFrame, page: str = "html", url: str = "url") -> DataFrame:
    """pages with `text`: the main text, "" if there is none. Null urls share the host ""; null or empty pages have no text.

    Pages are read whole, however long; equal pages of a host count once for its template, and of equal candidates for
    the wrapper the first holds. Repeated rows are extracted alike; a column already named text is replaced, any other
    name passes through; an empty table stays empty.
    """
    rows = carried(pages, page=F.col(page), host=F.coalesce(F.regexp_extract(F.lower(url), r"(?s)^.*?://([^/?#]*)", 1), F.lit("")))
    found = table(templates(table(occurrences(rows, "host", "page"))).select(F.col("host").alias("h"), "template"))
    joined = rows.join(bounded(found, BROADCAST_HOSTS), F.col("host") == F.col("h"), "left").select("row", "page", "template")
    schema = T.StructType([joined.schema["row"], T.StructField("text", T.StringType(), False)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in _pieces(whole, 1):
                texts = [main_text(p, frozenset(k or ())) for p, k in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True)]
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(texts, pa.string())], names=["row", "text"])

    return released(joined.mapInArrow(run, schema), text=F.col("text"))
