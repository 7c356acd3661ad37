"""Main text of web pages by template deduction: tokens that occur alike on a host's pages are its template."""

from __future__ import annotations

import html
import re
from collections import Counter, defaultdict
from dataclasses import dataclass, field
from functools import lru_cache

import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scanmill.llm.common import like, written

REPEATED = 3
"""A text that fewer different pages of a host share is no sign of a template."""
TEMPLATE_BYTES = 8 << 20
"""Templates of this size together go to every executor; beyond it they meet their pages in a shuffle."""
SALTS = 16

# HTML elements by role.
RAW = frozenset("script style noscript template textarea iframe svg title xmp".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr b bdi bdo big cite code data dfn em font i ins del kbd label mark q s samp small span strike strong sub sup time tt u var wbr br img".split())
BOILERPLATE = frozenset("head nav footer aside form button select dialog menu fieldset canvas audio video object".split())
ARTICLE = frozenset(["article", "main"])
TEXTUAL = frozenset("p h1 h2 h3 h4 h5 h6 li dt dd pre blockquote figcaption address td th caption summary".split())
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert menu menubar".split())
NAMES = frozenset(
    "ad ads advert adverts advertisement sponsor sponsored promo promotion banner sidebar menu nav navbar navigation breadcrumb breadcrumbs "
    "footer header masthead topbar cookie cookies consent gdpr notice notices notification alert popup modal overlay newsletter "
    "subscribe subscription signup login social share sharing related recommended recommendations widget comment comments reply replies "
    "discussion disqus respond toolbar pagination pager search copyright legal".split()
)
CLOSES = {"p": {"p"}, "li": {"li", "p"}, "dt": {"dt", "dd", "p"}, "dd": {"dt", "dd", "p"}, "tr": {"tr", "td", "th", "p"}, "td": {"td", "th", "p"}, "th": {"td", "th", "p"}, "option": {"option"}}
SCOPES = frozenset("ul ol dl table article main section div body html".split())

# A tag ends at its first > outside of quotes, or at the first > if quotes are left open; one that never ends is text up to the
# next <. No part looks further than the next < or the next quote of its kind, so markup of any kind is read in one pass.
_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<(/?)([A-Za-z][^\s/<>]*+)((?:[^<>\"']|\"[^\"]*\"|'[^']*')*+)>|<(/?)([A-Za-z][^\s/<>]*+)([^<>]*+)>|<[!?][^<>]*+>", re.S
)
_NAMED = re.compile(r"\b(class|id|role|hidden)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+))?", re.I)


@lru_cache(maxsize=4096)
def _label(tag: str, attributes: str) -> tuple[str, bool]:
    """The element's name in a path, with its class and id words, and whether it is boilerplate by name."""
    words, hidden = set(), False
    for key, value in _NAMED.findall(attributes):
        found = re.findall(r"[a-z]+", value.lower())
        if key.lower() == "role":
            hidden |= bool(ROLES & set(found))
        elif key.lower() == "hidden":
            hidden = True
        else:
            words.update(found)
    named = tag not in ("html", "body") and bool(words & NAMES)
    return ".".join([tag, *sorted(words)]), hidden or named or tag in BOILERPLATE


@dataclass
class Node:
    """An element in its page; `path` is a hash of its label under its parent's path."""

    tag: str
    path: int
    parent: int
    depth: int
    boilerplate: bool = False
    article: bool = False


@dataclass
class Block:
    """A run of text in one block element."""

    node: int
    boilerplate: bool
    article: bool
    parts: list[str] = field(default_factory=list)
    linked: int = 0

    def text(self) -> str:
        return " ".join("".join(self.parts).split())


def _hashed(parent: int, label: str) -> int:
    value = xxhash.xxh64_intdigest(label, parent & 0xFFFFFFFFFFFFFFFF)
    return value - (1 << 64) if value >> 63 else value


def blocks_of(page: str) -> tuple[list[Block], list[Node]]:
    """The text blocks of a page in order, and its block elements, parents first. The first node is the page itself."""
    nodes = [Node("", 0, -1, 0)]
    stack, within = [0], Counter()
    found: list[Block] = []
    links, fresh, at = 0, True, 0

    def say(text: str) -> None:
        nonlocal fresh
        if not text:
            return
        if fresh or not found:
            node = nodes[stack[-1]]
            found.append(Block(stack[-1], node.boilerplate, node.article))
            fresh = False
        text = html.unescape(text)
        found[-1].parts.append(text)
        found[-1].linked += links and len(text)

    def close(depth: int) -> None:
        while len(stack) > depth:
            within[nodes[stack.pop()].tag] -= 1

    while at < len(page):
        token = _TOKEN.search(page, at)
        if token is None:
            say(page[at:])
            break
        say(page[at : token.start()])
        at = token.end()
        slash, name, attributes = token.groups()[:3] if token[2] else token.groups()[3:]
        if name is None:
            continue
        tag, closing = name.lower(), bool(slash)
        if tag in RAW:
            if not closing and not attributes.rstrip().endswith("/"):
                end = re.compile(rf"</{re.escape(tag)}\b[^<>]*+>?", re.I).search(page, at)
                at = end.end() if end else len(page)
            continue
        if tag in INLINE:
            if tag == "a":
                links = 0 if closing else 1
            elif tag == "br":
                say(" ")
            continue
        fresh = True
        if tag in VOID:
            continue
        if closing:
            if within[tag] > 0:
                close(next(i for i in range(len(stack) - 1, 0, -1) if nodes[stack[i]].tag == tag))
            continue
        for i in range(len(stack) - 1, 0, -1):
            if nodes[stack[i]].tag in SCOPES:
                break
            if nodes[stack[i]].tag in CLOSES.get(tag, {"p"}):
                close(i)
                break
        label, named = _label(tag, attributes)
        above = nodes[stack[-1]]
        boilerplate = above.boilerplate or named or (tag == "header" and not above.article)
        article = (above.article or tag in ARTICLE) and not boilerplate
        nodes.append(Node(tag, _hashed(above.path, label), stack[-1], above.depth + 1, boilerplate, article))
        stack.append(len(nodes) - 1)
        within[tag] += 1
    return found, nodes


def tokens_of(page: str | None) -> list[dict]:
    """The page's tokens with their counts: element paths with the text right in them, and texts, each under its path."""
    found, nodes = blocks_of(page or "")
    opened, chars, linked = Counter(n.path for n in nodes[1:]), Counter(), Counter()
    said: Counter = Counter()
    for block in found:
        text, path = block.text(), nodes[block.node].path
        if text and not block.boilerplate:
            chars[path] += len(text)
            linked[path] += block.linked
            said[path, text] += 1
    first = {n.path: n for n in reversed(nodes[1:])}
    rows = [
        {"token": p, "parent": nodes[n.parent].path, "depth": n.depth, "kind": 1 + 2 * n.article + 4 * (n.tag in TEXTUAL), "n": opened[p],
         "chars": chars[p], "linked": linked[p]} for p, n in first.items()
    ]
    return rows + [
        {"token": _hashed(p, text), "parent": p, "depth": 0, "kind": 0, "n": n, "chars": n * len(text), "linked": 0} for (p, text), n in said.items()
    ]


_TOKENS = "token: long, parent: long, depth: int, kind: int, n: long, chars: long, linked: long"


class Template:
    """Equivalence classes of a host, nested by their paths, and the slot that holds the main text.

    `rows` are the tokens that stand on most of the host's pages. `kind` is 0 for a text, else an element's: 2 if it lies in an
    article, 4 if it is an element of running text."""

    def __init__(self, rows: list) -> None:
        classes = defaultdict(list)
        for r in rows:
            if r["kind"]:
                classes[r["class"]].append(r)
        # From outer to inner: a class belongs to the template if its paths stand in the slots of what is there already.
        slots = {0}
        for members in sorted(classes.values(), key=lambda c: (min(r["depth"] for r in c), min(r["token"] for r in c))):
            paths = {r["token"] for r in members}
            if all(r["parent"] in slots or r["parent"] in paths for r in members):
                slots |= paths
        self.slots = slots
        elements = {r["token"]: r for r in rows if r["kind"] and r["token"] in slots}
        mass: Counter = Counter()
        for path, r in elements.items():
            if r["chars"] and 2 * r["linked"] <= r["chars"]:
                mass[r["parent"] if r["kind"] & 4 else path] += r["chars"]
        main = max(mass, key=lambda p: (mass[p], p), default=0)
        above = main
        while above in elements:  # the article around it, if there is one, holds its headings and asides too
            if elements[above]["kind"] & 2:
                main = above
            above = elements[above]["parent"]
        self.main = main
        # Texts that fill their slot on nearly every page are the template's, not the page's. Where texts that most pages share
        # are much of the main slot, the pages are copies of each other, and nothing tells them from their template.
        shared = [r for r in rows if not r["kind"] and r["parent"] in elements]
        inside = {p for p in elements if self._under(p, elements)}
        held = sum(r["chars"] for p, r in elements.items() if p in inside)
        copies = 4 * sum(r["chars"] for r in shared if r["parent"] in inside) > held
        self.constant = {
            r["token"] for r in shared if 10 * r["n"] >= 9 * elements[r["parent"]]["n"] and not (copies and r["parent"] in inside)
        }

    def _under(self, path: int, elements: dict) -> bool:
        while path != self.main and path in elements:
            path = elements[path]["parent"]
        return path == self.main

    def text(self, page: str | None) -> str:
        """The page's main text: the blocks in the main slot without what the template repeats there. A page that has no text in
        that slot gives its article, and without one its unlinked blocks."""
        blocks, nodes = blocks_of(page or "")
        inside = [n.path == self.main for n in nodes]
        for i, n in enumerate(nodes[1:], 1):
            inside[i] |= inside[n.parent]
        found = [(b, b.text()) for b in blocks if not b.boilerplate]
        own = [(b, t) for b, t in found if t and _hashed(nodes[b.node].path, t) not in self.constant]
        kept = [t for b, t in own if inside[b.node]] if self.main else []
        kept = kept or [t for b, t in own if b.article] or [t for b, t in own if 2 * b.linked <= len(t)]
        return "\n".join(kept)


def page_tokens(pages: DataFrame) -> DataFrame:
    """(host, token, parent, depth, kind, n, chars, linked, page, print): the tokens of each page; page is a hash of its html,
    print one of page and count."""
    @F.pandas_udf(f"array<struct<{_TOKENS}>>")
    def read(texts: pd.Series) -> pd.Series:
        return pd.Series([tokens_of(t) for t in texts])

    page = F.xxhash64("html")
    return pages.select("host", page.alias("page"), F.explode(read("html")).alias("t")).select(
        "host", "t.*", "page", F.xxhash64("page", "t.n").alias("print")
    )


def _vectors(tokens: DataFrame) -> DataFrame:
    """(host, token, parent, depth, kind, pages, n, chars, linked, high, low): the occurrence vector of each token, as sums of
    hashes of (page, count). Equal vectors have equal sums; sums of parts add up, so no vector is ever gathered. Copies of a
    page count once in `pages`."""
    return tokens.groupBy("host", "token").agg(
        F.min("parent").alias("parent"), F.min("depth").alias("depth"), F.min("kind").alias("kind"),
        F.count_distinct("page").alias("pages"), F.sum("n").alias("n"), F.sum("chars").alias("chars"), F.sum("linked").alias("linked"),
        F.sum(F.shiftrightunsigned("print", 33)).alias("high"), F.sum(F.col("print").bitwiseAND(F.lit(0x7FFFFFFF).cast("long"))).alias("low"),
    )


def templates(pages: DataFrame) -> DataFrame:
    """(host, template): the element paths on at least half of a host's different pages, with their equivalence class, and the
    texts that nine of ten share. At most a few times as many as an average page has tokens, whatever the number of pages."""
    sizes = pages.groupBy("host").agg(F.count_distinct(F.xxhash64("html")).alias("size"))
    often = F.when(F.col("kind") > 0, 2 * F.col("pages") >= F.col("size")).otherwise(
        (F.col("pages") >= REPEATED) & (10 * F.col("pages") >= 9 * F.col("size"))
    )
    frequent = _vectors(page_tokens(pages)).join(sizes, "host").filter(often)
    members = F.struct(F.xxhash64("high", "low", "pages").alias("class"), "token", "parent", "depth", "kind", "pages", "n", "chars", "linked")
    return frequent.groupBy("host").agg(F.sort_array(F.collect_list(members)).alias("template"))


def main_texts(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars) of every row of `pages` (page_id, url, html).

    A page's tokens are its element paths (tags with class and id words) and its texts. Tokens with one occurrence vector
    over a host's pages form a class; frequent classes nest into the host's template, and texts stand in its slots. The main
    slot is the one around most unlinked text, with the article element around it where there is one; a page's main text is
    what stands in that slot. Slots of menus, headers, footers, sidebars, notices, adverts, forms, scripts, styles and comments
    are told by element, role, class or id, those that repeat one text on the host's pages by that.
    Character references are decoded, white space in a block is one space, blocks are joined by a line feed. Null or empty pages
    give an empty text; pages without url share one host; a host of one page has that page for its template; copies of a page
    tell no more than one; repeated rows count each. Broken markup of any depth and length is read in one pass. Templates are
    broadcast while they are under TEMPLATE_BYTES together; beyond it a host's pages are dealt into SALTS parts."""
    host = F.coalesce(F.lower(F.regexp_extract("url", r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1)), F.lit(""))
    rows = like(pages, ["page_id", "url", "html"]).withColumn("host", host)
    found = written(templates(rows))
    entries = found.agg(F.sum(F.size("template"))).first()[0] or 0
    if entries * 72 <= TEMPLATE_BYTES:
        joined = rows.join(F.broadcast(found), "host", "left")
    else:
        salted = found.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        salt = F.pmod(F.xxhash64("page_id", F.length("html")), F.lit(SALTS)).cast("int")
        joined = rows.withColumn("salt", salt).join(salted, ["host", "salt"], "left")

    @F.pandas_udf("string")
    def extract(texts: pd.Series, hosts: pd.Series, chosen: pd.Series) -> pd.Series:
        known: dict[str, Template] = {}
        out = []
        for text, at, template in zip(texts, hosts, chosen, strict=True):
            if at not in known:
                known[at] = Template([] if template is None else list(template))
            out.append(known[at].text(text))
        return pd.Series(out, dtype=object)

    return joined.select("page_id", "url", extract("html", "host", "template").alias("text")).select(
        "page_id", "url", "text", F.char_length("text").cast("long").alias("n_chars")
    )
