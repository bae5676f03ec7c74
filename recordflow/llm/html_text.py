"""Main text of web pages by two passes over their blocks.

A page is cut into blocks of text. The first pass decides what it can: blocks in menus, headers,
footers, forms and the like are bad, and so are those made of links; long blocks with many stop
words are good, long ones without are bad. The second pass hands short and undecided blocks the
label of the nearest decided neighbour, nearest in the tree of containers, then in page order. Where
the page marks its article, the blocks in there need not prove themselves.
"""

from __future__ import annotations

import html as references
import re
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recordflow.llm.common import whole

#: Blocks of at least so many code points are decided by their words.
LONG = 70
#: Least share of stop words in a good block, largest share of linked characters in any.
STOP_SHARE = 0.1
LINK_SHARE = 0.5

# Frequent words of English, German, French and Spanish.
STOP_WORDS = frozenset("""
a about all also an and are as at be been but by for from had has have he her his if in is it its
not of on only or our she that the their there they this to was we were when which who will with you
aber als am auch auf aus bei das dass dem den der des die ein eine einen einer er es für hat ich im
ist mit nach nicht noch nur oder sein sich sie sind so und von vor war wie wir zu zum zur
au aux avec ce cette dans de du elle en est et il je la le les mais ne nous ont ou où par pas plus
pour que qui sa se ses son sont sur un une vous
al como con del el era esta este lo los las más muy no o pero por si sin sobre su sus también y
""".split())

# Elements of HTML by what becomes of their text.
RAW = ("script", "style", "textarea", "title", "iframe", "noframes", "noembed", "xmp")
SKIPPED = frozenset("template noscript svg select object canvas video audio button".split())
BREAKS = frozenset("p h1 h2 h3 h4 h5 h6 pre hr dt dd option legend caption summary address "
                   "center figcaption tr td th li".split())
CONTAINERS = frozenset("html head body div section article main aside nav header footer form ul ol dl li "
                       "table thead tbody tfoot tr td th blockquote figure details dialog "
                       "fieldset menu search hgroup".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Containers whose text is none of the article's, and those only outside of an article.
FURNITURE = frozenset("nav aside footer form menu dialog search".split())
#: Items that end those open before them.
ENDED_BY = {"li": frozenset(("li",)), "td": frozenset(("td", "th")), "th": frozenset(("td", "th")),
            "tr": frozenset(("td", "th", "tr"))}
# Words in class, id and role that name such parts.
FURNITURE_NAMES = frozenset("""
ad ads adbox adslot advert adverts advertisement advertising alert banner breadcrumb breadcrumbs
captcha comment comments commentlist consent contentinfo cookie cookies copyright cta dialog
disclaimer discussion disqus footer gdpr legal login masthead menu modal nav navbar navigation
newsletter notice notices notification overlay pager pagination paywall popup promo promoted
promotion recommendations recommended related replies reply respond responses search share sharing
sidebar signin signup skip social sponsor sponsored subscribe subscription tagcloud teaser toolbar
topbar widget widgets
""".split())
HEADER_NAMES = frozenset(("header", "head"))
CONTENT_NAMES = frozenset("article body content entry main post story text".split())

_ATTRIBUTES = r"""(?:[^>"'=]++|=\s*+"[^"]*+"|=\s*+'[^']*+'|[="'])*+"""
#: Comments, declarations, elements without text of the article, tags, and text. What is not closed
#: goes to the end of the page, so every character is looked at a bounded number of times.
TOKEN = re.compile(
    r"<!--(?:-?>|.*?(?:--!?>|\Z))"
    r"|<[!?][^>]*+(?:>|\Z)"
    r"|</(?=[^a-zA-Z])[^>]*+(?:>|\Z)"
    rf"|<(?P<raw>{'|'.join(RAW)})(?=[\s/>])(?P<raw_with>{_ATTRIBUTES})(?:>.*?(?:</(?P=raw)(?=[\s/>])"
    r"[^>]*+(?:>|\Z)|\Z)|\Z)"
    rf"|<(?P<close>/?)(?P<tag>[a-zA-Z][^\s/>]*+)(?P<with>{_ATTRIBUTES})(?:>|\Z)"
    r"|(?P<text>(?:[^<]++|<(?![a-zA-Z/!?]))++|<)",
    re.S | re.I)
NAMED = re.compile(r"""\b(class|id|role|itemprop|aria-hidden|style|hidden)\b"""
                   r"""(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""", re.I)
WORD = re.compile(r"[^\W\d_]+")
CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")
MARKED = re.compile(r"""role\s*=\s*["']?main\b|\barticleBody\b""", re.I)
INVISIBLE = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)


@dataclass
class Block:
    """Text of one block and where it stands: ``depth`` of its container, ``low`` the least depth
    passed since the block before, ``level`` 2 in an article, 1 in a main part, else 0."""

    text: str
    linked: int
    heading: bool
    bad: bool
    depth: int
    low: int
    level: int
    label: int = 0


def _names_furniture(attributes: str, inside: bool) -> bool:
    """Whether class, id, role or style of an element says that its text is not the article's."""
    bad = False
    for m in NAMED.finditer(attributes):
        name, value = m[1].lower(), m[2] or m[3] or m[4] or ""
        if name == "hidden" and m[0].lower() == "hidden":
            return True
        if name == "aria-hidden" and value.lower() == "true":
            return True
        if name == "style" and INVISIBLE.search(value):
            return True
        if name in ("class", "id", "role"):
            for part in value.split():
                words = [w.lower() for w in WORD.findall(CAMEL.sub(" ", part))]
                if words and words[0] in ("with", "has", "no", "without"):
                    continue
                known = set(words)
                bad |= part.lower() == "hidden"
                bad |= bool(known & FURNITURE_NAMES)
                bad |= bool(known & HEADER_NAMES) and not (inside or known & CONTENT_NAMES)
    return bad


class _Cutter:
    """Cuts one page into blocks while its tokens go by."""

    def __init__(self, page: str):
        self.page = page
        self.blocks: list[Block] = []
        # Open containers: (tag, whether bad, level); how many of each tag are open.
        self.stack: list[tuple[str, bool, int]] = [("", False, 0)]
        self.opened: dict[str, int] = {}
        self.pieces: list[str] = []
        self.linked = self.low = self.breaks = 0
        #: Depth of the container in which a link was opened; 0 outside of links.
        self.link = 0
        self.heading = False
        #: A skipped element that is open, how deeply it is nested, and where each kind last closes.
        self.skipped, self.skips = "", 0
        self.last_close: dict[str, int] = {}

    def close_block(self) -> None:
        text = " ".join("".join(self.pieces).split())
        if text:
            _, bad, level = self.stack[-1]
            self.blocks.append(Block(text, self.linked, self.heading, bad, len(self.stack),
                                     self.low, level))
            self.low = len(self.stack)
        self.pieces.clear()
        self.linked = 0

    def leave(self) -> None:
        self.opened[self.stack.pop()[0]] -= 1
        self.low = min(self.low, len(self.stack))
        if self.link > len(self.stack):
            self.link = 0

    def leave_to(self, tag: str) -> None:
        """Close the innermost container of a kind, if there is one, and all within."""
        if self.opened.get(tag):
            while self.stack[-1][0] != tag:
                self.leave()
            self.leave()

    def enter(self, tag: str, attributes: str) -> None:
        while self.stack[-1][0] in ENDED_BY.get(tag, ()):
            self.leave()
        _, bad, level = self.stack[-1]
        if tag == "body":
            self.leave_to("head")
            bad = False
        elif tag != "html":
            bad = (bad or tag == "head" or tag in FURNITURE or (tag == "header" and not level)
                   or (tag != "main" and _names_furniture(attributes, level > 0)))
        if tag == "article" or (attributes and MARKED.search(attributes)):
            level = 2
        elif tag == "main":
            level = max(level, 1)
        self.stack.append((tag, bad, level))
        self.opened[tag] = self.opened.get(tag, 0) + 1

    def skip(self, tag: str, closes: bool, at: int) -> None:
        """Text of buttons, drawings and the like; one that is never closed hides nothing."""
        if self.skipped == tag:
            self.skips += -1 if closes else 1
            if not self.skips:
                self.skipped = ""
        elif not self.skipped and not closes:
            if tag not in self.last_close:
                ends = [m.start() for m in re.finditer(f"</{tag}", self.page, re.I)]
                self.last_close[tag] = ends[-1] if ends else -1
            if self.last_close[tag] > at:
                self.skipped, self.skips = tag, 1

    def text(self, text: str) -> None:
        text = references.unescape(text)
        self.pieces.append(text)
        if self.link:
            self.linked += len(text.strip())
        if not text.isspace():
            self.breaks = 0

    def tag(self, tag: str, attributes: str, closes: bool) -> None:
        if tag == "br":
            # One break is white space; two part blocks.
            self.breaks += 1
            self.pieces.append("\n")
            if self.breaks > 1:
                self.close_block()
            return
        if tag == "a":
            self.link = 0 if closes else len(self.stack)
            return
        if tag not in CONTAINERS and tag not in BREAKS:
            return
        self.breaks = 0
        self.close_block()
        if tag in BREAKS:
            self.heading = tag in HEADINGS and not closes
        if tag in CONTAINERS:
            if closes:
                self.leave_to(tag)
            else:
                self.enter(tag, attributes)


def blocks(page: str) -> list[Block]:
    """The blocks of a page that have text, in page order."""
    cutter = _Cutter(page)
    for m in TOKEN.finditer(page):
        if m["text"] is not None:
            if not cutter.skipped:
                cutter.text(m["text"])
        elif m["tag"]:
            tag, closes = m["tag"].lower(), bool(m["close"])
            if tag in SKIPPED:
                cutter.skip(tag, closes, m.start())
            elif not cutter.skipped:
                cutter.tag(tag, m["with"], closes)
    cutter.close_block()
    return cutter.blocks


def _stop_rich(text: str) -> bool:
    words = WORD.findall(text.lower())
    return sum(w in STOP_WORDS for w in words) >= STOP_SHARE * max(len(words), 1)


def _first_pass(found: list[Block]) -> int:
    """Label blocks by themselves: 1 good, -1 bad, 0 undecided. Returns the level from which on a
    block belongs to what the page marks as its article; 0 where no mark holds most of the text."""
    weight = [0, 0, 0]
    rich = []
    for b in found:
        by_links = b.linked > LINK_SHARE * len(b.text) and not b.heading
        rich.append(len(b.text) >= LONG and not b.bad and not by_links and _stop_rich(b.text))
        weight[b.level] += len(b.text) * rich[-1]
        if b.bad or by_links:
            b.label = -1
    marked = next((level for level in (2, 1) if any(b.level >= level and not b.bad for b in found)
                   and sum(weight[level:]) >= sum(weight[:level])), 0)
    for b, good in zip(found, rich):
        if b.level < marked or (not marked and len(b.text) < LONG and "\N{COPYRIGHT SIGN}" in b.text):
            b.label = -1
        elif not b.label and len(b.text) >= LONG:
            b.label = 1 if good else 0 if marked else -1
    return marked


def _second_pass(found: list[Block], marked: int) -> list[bool]:
    """Whether each block is kept; undecided ones go by the nearest decided neighbours."""

    def seen(order: list[int], step: int) -> list[tuple[int, int, int]]:
        """Per block, (tree distance, blocks between, label) of the decided one before it."""
        at: list[tuple[int, int, int]] = [(0, 0, 0)] * len(found)
        last, meet = None, 0
        for i in order:
            # ``low`` of the later block of two neighbours is the depth at which their paths part.
            if last is not None:
                meet = min(meet, found[i if step > 0 else i + 1].low)
                at[i] = (found[last].depth + found[i].depth - 2 * meet, abs(i - last),
                         found[last].label)
            if found[i].label:
                last, meet = i, found[i].depth
        return at

    n = len(found)
    before, after = seen(list(range(n)), 1), seen(list(range(n - 1, -1, -1)), -1)
    kept = []
    for i, b in enumerate(found):
        if b.label:
            kept.append(b.label > 0)
            continue
        # In a marked article what is around it says nothing; linked lists in it don't either.
        sides = [s for s in (before[i], after[i]) if s[2] and not (marked and s[2] < 0)]
        if not sides:
            kept.append(marked > 0)
            continue
        # Of equally near ones a heading goes with what follows, other blocks with the bad one.
        best = min(s[:2] for s in sides)
        equal = [s for s in sides if s[:2] == best]
        kept.append((equal[-1][2] if b.heading else min(s[2] for s in equal)) > 0)
    return kept


def main_text(page: str) -> str:
    """The blocks of the article of one page, joined by line feeds; '' where there are none."""
    found = blocks(page)
    kept = _second_pass(found, _first_pass(found))
    return "\n".join(b.text for b, keep in zip(found, kept) if keep)


def extract(pages: DataFrame, html: str = "html", out: str = "text") -> DataFrame:
    """``pages`` with ``out``: the main text of every page from its whole html.

    Character references are decoded, all Unicode white space inside a block becomes one space,
    blocks are trimmed and joined in page order by one line feed. Elements left open go to the end
    of the page, as do comments, scripts and tags. NULL and empty html, and pages without an
    article, give ''. Every row has its own result, repeated ones too; a column called ``out`` is
    replaced, all others stay. A page is worked through once, in time linear in its length.
    """

    @F.arrow_udf("string")
    def texts(column: pa.Array) -> pa.Array:
        return pa.array([main_text(p.as_py()) for p in column], pa.string())

    return pages.withColumn(out, texts(whole(F.col(f"`{html}`"))))
