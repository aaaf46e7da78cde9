"""Main text of web pages by two-pass block rules.

A page is cut into blocks at block tags. The first pass adds up a score for every block: stop-word density and
length of its unlinked words speak for main text, link density and a lack of stop words against it, and what
the block stands in (an article, a menu, an element named for adverts) shifts the score as a prior. A lack of stop
words only counts in a page whose text as a whole is in a language they are known of; else length speaks alone. Scores of
DECIDED or more are main text, those of minus DECIDED or less are not; ambiguous blocks, mostly short ones,
stay open. The second pass gives them the label of their nearest decided neighbours.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Frequent function words of the languages at hand.
STOP_WORDS = frozenset(
    """
    the a an and of to in is on by it was for with as at from this that are be or not but have has had you he she they we i
    his her its their were been which will would can there what who when where how all one more about into than then
    le la les un une des du de et en est que qui dans pour pas sur au aux par avec ce cette ces il elle ils nous vous
    je son sa ses leur mais ou où ne se plus comme tout on sont était être
    der die das und ist von mit den dem des ein eine einer einen zu zum zur im nicht auf für sich als auch es an
    er sie wir ihr aber oder wie nach bei nur noch so wenn sind war wird werden hat haben aus
    el los las y es del se lo con su al como pero sus este esta ya entre sin sobre ser son fue ha más muy también hasta
    """.split()
)
#: Characters of unlinked text that make a block very long, long or at least not short, and shares of stop words.
VERY_LONG, LONG, SHORT = 600, 140, 40
STOP_HIGH, STOP_LOW = 0.25, 0.12
#: Characters that a character of a script without spaces between words counts for.
UNSPACED = 3
#: Share of a block's text in links that speaks against it.
LINK_HIGH = 0.6
#: A score of so much, either way, decides a block.
DECIDED = 1.0
#: Evidence of the block itself: very long, long and middling prose, long text that is no prose, a heading, links, links
#: in a list, and a copyright mark.
MUCH_PROSE, PROSE, SOME_PROSE, NO_PROSE, HEADING, LINKED, LINKED_ITEM, RIGHTS = 4.0, 2.0, 0.5, -1.0, 0.5, -1.5, -2.0, -1.5
#: Priors of what it stands in: an article; text beside one; an element named for furniture; a text element named so;
#: furniture by its tag or role; such an element that is never closed.
ARTICLE, BESIDE, NAMED, NAMED_TEXT, FURNITURE, UNCLOSED = 0.75, -1.0, -3.0, -1.0, -5.5, -0.5

_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_RAW = "script|style|noscript|template|svg|iframe|object|canvas|textarea|select|math|title"
_BLOCK = frozenset(
    """address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure
    footer form h1 h2 h3 h4 h5 h6 header hr html legend li main menu nav ol p pre search section summary table tbody td tfoot
    th thead tr ul""".split()
)
#: Elements that hold no main text as a rule.
_BAD_TAGS = frozenset("nav footer aside form menu dialog button search fieldset".split())
_BAD_ROLES = frozenset("navigation banner contentinfo complementary search dialog alertdialog alert form menu menubar".split())
_GOOD_TAGS = frozenset("article main".split())
#: Elements that hold one run of text, and those that may well end a cut-off page unclosed.
_TEXT_TAGS = frozenset("p h1 h2 h3 h4 h5 h6 blockquote pre figcaption dt dd td th span b i em strong a".split())
_LAST_TAGS = frozenset("footer aside".split())
_HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: A class or id token marks what surrounds an article by its last word but for _SUFFIXES, unless it has one of _MODIFIERS.
_BAD_NAMES = re.compile(
    r"(?:ad|ads|adv|advert\w*|adsense|adslot|banner|sponsor\w*|promo\w*|cookie\w*|consent|gdpr|notice|popup|modal|overlay|nav\w*|menu\w*|"
    r"breadcrumb\w*|header|masthead|foot|footer|sidebar|widget\w*|comment\w*|reply|replies|disqus|respond|related|recommend\w*|"
    r"share|sharing|social|subscribe|newsletter|signup|login|search\w*|form|toolbar|pagination|pager|copyright|skip\w*|disclaimer|toc)",
    re.I,
)
_SUFFIXES = frozenset("area bar block bottom box button buttons container inner item items left link links list right section slot top unit wrap wrapper".split())
_MODIFIERS = frozenset("has no with without is open opened close closed collapsed expanded active enabled disabled fixed sticky entry post article title".split())
#: Names of what holds articles and prose other than the page's own.
_OTHERS = re.compile(r"\b(?:comment|repl|disqus|respond|related|recommend|promo|sponsor|ads?\b|widget|cookie|consent|gdpr|notice)", re.I)

# Attributes up to the end of a tag. A quoted value ends before white space, "/" or ">"; one that runs over a tag to the
# equals sign of another attribute has lost its closing quote, and the tag then ends at its first ">".
_QUOTED = r"\"(?![^\"]*<[^\"]*=\")[^\"]*\"(?=[\s/>])|'(?![^']*<[^']*=')[^']*'(?=[\s/>])"
_TOKEN = re.compile(
    rf"<!--.*?(?:-->|$)|<(?P<raw>{_RAW})\b[^<>]*+>(?:(?<=/>)|.*?(?:</(?P=raw)\s*>|$))"
    rf"|<(?P<close>/?)(?P<tag>[a-zA-Z][\w:-]*+)(?P<attrs>(?:[^\s\"'<>]++|\s++|{_QUOTED})*+)>"
    r"|<(?P<close2>/?)(?P<tag2>[a-zA-Z][\w:-]*+)(?P<attrs2>[^<>]*+)>"
    r"|<[a-zA-Z][\w:-]*+\s[^<>]*[\"'][^<>]*(?=<)|</?[a-zA-Z][^<>]*+$|<[!?][^<>]*+>|(?P<text>[^<]+|<)",
    re.S | re.I,
)
_ATTR = re.compile(r"""\b(class|id|role|hidden|style|aria-hidden)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s>]+))?""", re.I)
_WORD = re.compile(r"[^\W\d_]+")
#: Letters beyond the Latin script and its marks, and those of scripts that put no space between words.
_OTHER_SCRIPT = re.compile(r"[\u0370-\u1dff\u2c00-\u2c5f\u2c80-\ua71f\ua840-\uab2f\uab70-\ufaff\ufb13-\uffdc\U00010000-\U0001ffff\U00020000-\U0003ffff]")
_UNSPACED = re.compile(r"[\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u3040-\u30ff\u3400-\u9fff\uf900-\ufaff\U00020000-\U0003ffff]")
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)


class Node:
    """An element that text stands in; ``own`` is what its tag and names say: a prior and how far it reaches."""

    __slots__ = ("parent", "tag", "own", "closed", "context")

    def __init__(self, parent: Node | None, tag: str, own: str | None):
        self.parent, self.tag, self.own, self.closed, self.context = parent, tag, own, False, None


@dataclass
class Block:
    """A run of text between block tags, with what it stands in as a prior."""

    text: str
    #: Text outside links, and how many characters are inside them.
    unlinked: str
    linked: int
    heading: bool
    item: bool
    #: Inside an article; inside what is furniture by all it says.
    inside: bool = False
    furniture: bool = False
    prior: float = 0.0
    words: tuple[int, int] | None = None


def _marked(token: str) -> bool:
    words = [w for w in re.split("[-_]+", token.lower()) if w]
    if not _MODIFIERS.isdisjoint(words):
        return False
    if words == ["side"]:
        return True
    while len(words) > 1 and (words[-1] in _SUFFIXES or words[-1].isdigit()):
        words.pop()
    return bool(words) and _BAD_NAMES.fullmatch(words[-1]) is not None


def _says(tag: str, attrs: str) -> str | None:
    """What an element's tag and attributes say of its content: article, furniture, others, named, hidden or nothing."""
    said = "article" if tag in _GOOD_TAGS else "furniture" if tag in _BAD_TAGS else "header" if tag == "header" else None
    for name, value in _ATTR.findall(attrs) if attrs else ():
        value, name = value.strip("\"'"), name.lower()
        if name == "hidden" or (name == "aria-hidden" and value == "true") or (name == "style" and _HIDDEN.search(value)):
            return "hidden"
        if name == "role" and value.lower() in _BAD_ROLES:
            said = "furniture"
        if name in ("class", "id") and tag not in ("html", "body", "article", "main"):
            bad = [token for token in value.split() if _marked(token)]
            if any(_OTHERS.search(token.replace("_", "-")) for token in bad):
                said = "others" if said in (None, "named") else said
            elif bad and said is None:
                said = "named"
    return said


def _context(node: Node | None) -> tuple[float, bool, bool]:
    """(prior, inside an article, furniture for good) of what stands in ``node``; its parents are known already."""
    if node is None:
        return 0.0, False, False
    if node.context is None:
        prior, inside, fixed = _context(node.parent)
        own = node.own
        if fixed or own is None:
            pass
        elif own == "hidden":
            prior, fixed = FURNITURE, True
        elif own == "article":
            prior, inside = ARTICLE, True
        elif own == "furniture" and not node.closed and node.tag not in _LAST_TAGS:
            prior += UNCLOSED
        elif own in ("furniture", "others") or (own == "header" and not inside and node.closed):
            prior, fixed = FURNITURE, own != "others" or node.tag not in _TEXT_TAGS
            if not fixed:
                prior = NAMED_TEXT + (ARTICLE if inside else 0.0)
        elif own == "header":
            prior += 0.0 if inside else UNCLOSED
        elif own == "named" and node.tag in _TEXT_TAGS:
            prior += NAMED_TEXT
        elif own == "named":
            prior, fixed = NAMED, inside
        node.context = (prior, inside, fixed)
    return node.context


def blocks_of(page: str) -> list[Block]:
    """The non-empty blocks of ``page`` in order."""
    found: list[tuple[Block, Node | None]] = []
    nodes: list[Node] = []
    open_: list[Node] = []
    counts: Counter = Counter()
    parts: list[str] = []
    free: list[str] = []
    linked, anchors = 0, 0

    def flush() -> None:
        nonlocal linked
        text = " ".join(html.unescape("".join(parts)).split())
        if text:
            near = [n.tag for n in open_[-3:]]
            unlinked = text if not linked else " ".join(html.unescape("".join(free)).split())
            found.append((Block(text, unlinked, linked, not _HEADINGS.isdisjoint(near), "li" in near), open_[-1] if open_ else None))
        parts.clear()
        free.clear()
        linked = 0

    def start(tag: str, own: str | None) -> None:
        node = Node(open_[-1] if open_ else None, tag, own)
        nodes.append(node)
        open_.append(node)
        counts[tag] += 1

    def end(tag: str) -> None:
        while (node := open_.pop()).tag != tag:
            counts[node.tag] -= 1
        node.closed = True
        counts[tag] -= 1

    for m in _TOKEN.finditer(page):
        text = m["text"]
        if text is not None:
            parts.append(text)
            if anchors:
                linked += len(html.unescape(text).strip())
            else:
                free.append(text)
            continue
        tag, close, attrs = (m["tag"], m["close"], m["attrs"]) if m["tag"] else (m["tag2"], m["close2"], m["attrs2"])
        if not tag:
            continue
        tag = tag.lower()
        if tag == "br":
            parts.append(" ")
            free.append(" ")
        elif tag == "a":
            anchors = max(0, anchors - 1) if close else 1
        elif tag not in _BLOCK:
            if close:
                if counts[tag]:
                    flush()
                    end(tag)
            elif tag not in _VOID and (own := _says(tag, attrs)):
                flush()
                start(tag, own)
        else:
            flush()
            anchors = 0
            if close:
                if counts[tag]:
                    end(tag)
                continue
            if tag in _ENDS or tag in _HEADINGS:
                ends = _ENDS.get(tag, ("p",))
                while open_ and open_[-1].tag in ends:
                    node = open_.pop()
                    node.closed = True
                    counts[node.tag] -= 1
            if tag not in _VOID:
                start(tag, _says(tag, attrs))
    flush()
    for node in nodes:
        _context(node)
    has_article = False
    for block, node in found:
        block.prior, block.inside, fixed = _context(node)
        block.furniture = fixed or block.prior <= NAMED
        has_article |= block.inside and not block.furniture
    if has_article:
        for block, _ in found:
            if not block.inside and not block.furniture:
                block.prior += BESIDE
    return [block for block, _ in found]


#: Open paragraphs and items that a new element ends by itself.
_ENDS = {"p": ("p",), "li": ("p", "li"), "td": ("p", "td", "th"), "th": ("p", "td", "th"), "tr": ("p", "td", "th", "tr"), "dt": ("p", "dt", "dd"), "dd": ("p", "dt", "dd")}


def stop_words(block: Block) -> tuple[int, int]:
    """Words of the block's unlinked text, and how many of them are stop words; worked out once."""
    if block.words is None:
        words = _WORD.findall(block.unlinked.lower())
        block.words = len(words), sum(map(STOP_WORDS.__contains__, words))
    return block.words


def in_known_language(blocks: list[Block]) -> bool:
    """True if the unlinked text of all blocks but furniture has as many stop words as prose of a listed language."""
    counts = [stop_words(b) for b in blocks if not b.furniture]
    return sum(n for _, n in counts) >= STOP_HIGH * max(1, sum(n for n, _ in counts))


def score(block: Block, known: bool = True) -> float:
    """First pass: the prior of what the block stands in and the evidence of its own text.

    Where the page's language is not ``known``, and in a block of letters other than Latin ones, length is evidence by
    itself; a character of a script without spaces between words counts as several.
    """
    total = block.prior
    others = _OTHER_SCRIPT.search(block.unlinked) is not None if not block.unlinked.isascii() else False
    size = len(block.unlinked) + (UNSPACED - 1) * (len(_UNSPACED.findall(block.unlinked)) if others else 0)
    if size >= SHORT:
        words, stops = stop_words(block)
        share = stops / max(1, words)
        if not known or (others and 2 * len(_OTHER_SCRIPT.findall(block.unlinked)) > sum(map(len, _WORD.findall(block.unlinked)))):
            share = max(share, STOP_HIGH)
        if size >= LONG:
            total += NO_PROSE if share < STOP_LOW else 0.0 if share < STOP_HIGH else PROSE if size < VERY_LONG else MUCH_PROSE
        elif share >= STOP_HIGH:
            total += SOME_PROSE
    if block.heading:
        total += HEADING
    if block.linked > LINK_HIGH * len(block.text):
        total += LINKED_ITEM if block.item else LINKED
    if len(block.text) < LONG and ("©" in block.text or "(c)" in block.text.lower()):
        total += RIGHTS
    return total


def decide(block: Block, known: bool = True) -> bool | None:
    """True for main text, False for furniture, None where the score leaves the block open."""
    total = score(block, known)
    return True if total >= DECIDED else False if total <= -DECIDED else None


def spread(labels: list[bool | None], heads: list[bool], lean: bool = False) -> list[bool]:
    """Second pass: open blocks take the label of the nearest decided neighbours.

    Between two that differ the nearer counts; at equal distance the block is bad, unless it is a
    heading of good text below it. Without any decided block all are good. With ``lean``, as in an article, an open
    block is bad only between two bad ones.
    """
    n = len(labels)
    before, after = [None] * n, [None] * n
    last = None
    for i in range(n):
        before[i] = last
        if labels[i] is not None:
            last = i
    last = None
    for i in reversed(range(n)):
        after[i] = last
        if labels[i] is not None:
            last = i
    out = []
    for i, label in enumerate(labels):
        b, a = before[i], after[i]
        if label is not None:
            out.append(label)
        elif b is None and a is None:
            out.append(True)
        elif lean:
            out.append(b is None or a is None or bool(labels[a] or labels[b]))
        elif b is None or a is None:
            out.append(bool(labels[a if b is None else b]))
        elif labels[a] == labels[b]:
            out.append(bool(labels[a]))
        elif heads[i]:
            out.append(bool(labels[a]))
        else:
            out.append(bool(labels[a]) if a - i < i - b else bool(labels[b]) if i - b < a - i else False)
    return out


def label_blocks(blocks: list[Block]) -> list[bool]:
    """Both passes: whether each block is main text.

    Furniture says nothing about its neighbours. Blocks of an article look at each other first, so that a menu beside
    it takes none of its short paragraphs; then what is beside it looks at all.
    """
    known = in_known_language(blocks)
    labels = [decide(b, known) for b in blocks]
    heads = [b.heading for b in blocks]
    for at, lean in (([i for i, b in enumerate(blocks) if b.inside and not b.furniture], True), ([i for i, b in enumerate(blocks) if not b.furniture], False)):
        found = spread([labels[i] for i in at], [heads[i] for i in at], lean)
        for i, good in zip(at, found):
            labels[i] = good
    return [label is True for label in labels]


def main_text(page: str | None) -> str:
    """The main text of an html page, one line per block; empty for a null or blank page."""
    blocks = blocks_of(page or "")
    return "\n".join(b.text for b, good in zip(blocks, label_blocks(blocks)) if good)


def _extract(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        text = [main_text(x) for x in b["html"]]
        yield pd.DataFrame({"page_id": b["page_id"], "url": b["url"], "text": text, "n_chars": [len(t) for t in text]})


def extract_pages(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars) for every row of ``pages``; other columns are not carried.

    A null html is an empty page. Nothing is cut or capped; rows that repeat a page_id come back as often.
    An attribute that lacks its closing quote ends with its tag, an element that is never closed counts for
    little unless it is a footer or sidebar, and time grows with a page's length however deep its elements nest.
    """
    return pages.select("page_id", "url", F.col("html")).mapInPandas(
        _extract, "page_id long, url string, text string, n_chars long"
    )
