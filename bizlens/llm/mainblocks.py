"""Main text of HTML pages by minimum-cut labelling of their blocks.

A page is cut into blocks (runs of text between block-level tags) that know their chain of open
elements.  A linear classifier gives every block a log-odds score from its elements, their
class, id and role names, its link share, length and punctuation; the score is the block's
terminal capacity (to the content side if positive, to the boilerplate side if negative).  A name that
boilerplate and articles share (``search-results``, ``legal``, ``social-science``) decides nothing inside an article by
itself: there the element's text does, by its length, its links and its share of whole sentences.
Blocks next to each other, and blocks in turn under one parent, are joined by smoothness edges whose
capacity grows with the part of the element chain they share.  A maximum flow separates the two
sides; the blocks left on the content side are the main text.

Character references are decoded, white space in a block becomes one space, blocks are trimmed and
joined by two line feeds in page order.

Defined results: a null, empty or blank page and a page without content have an empty text; tags cut off at
the end of a page are dropped, unclosed elements end with their parents, a head at the latest where something
starts that cannot stand in one; the text of scripts and the like goes to their end tag or the page's end, that
of hidden elements (svg, select, video and the like) as far as the element, none if its end tag is nowhere; end tags without a start are
ignored; repeated rows stay; extra columns may have any name.
"""

from __future__ import annotations

import re
from collections import Counter, deque
from collections.abc import Iterator
from html import unescape

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from .common import map_frames, quoted, ready_python, unused

#: Elements of HTML by their part in a page.
RAW = {"script", "style", "iframe", "textarea", "title", "xmp", "noembed", "noframes"}
HIDDEN = {"noscript", "template", "svg", "select", "audio", "video"}
#: Elements in which a block cannot stand, with what may hold one or be one there.
NO_BLOCKS = {"svg": {"foreignobject", "desc"}, "select": {"option", "optgroup", "hr", "legend", "button"}}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
BLOCK = {"address", "article", "aside", "blockquote", "body", "button", "caption", "center", "dd", "details", "dialog",
         "dir", "div", "dl", "dt", "fieldset", "figcaption", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5",
         "h6", "head", "header", "hgroup", "hr", "html", "legend", "li", "main", "menu", "nav", "ol", "optgroup",
         "option", "p", "pre", "section", "summary", "table", "tbody", "td", "tfoot", "th", "thead", "tr", "ul"}
#: What may stand in a head; anything else, and text, ends an open one.
IN_HEAD = {"base", "basefont", "bgsound", "head", "html", "link", "meta", "noframes", "noscript", "script", "style", "template",
           "title"}
HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
#: Elements a start tag ends where they are open in the same parent.
ENDS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"},
        "th": {"td", "th"}, "option": {"option"}, "tbody": {"tr", "td", "th", "thead"}, "tfoot": {"tr", "td", "th", "tbody"}}
WALLS = {"table", "ul", "ol", "dl", "menu", "article", "section", "body", "html", "main", "nav", "aside", "footer", "header",
         "form", "div", "blockquote", "figure", "details", "dialog", "fieldset"}

#: Weights of the classifier (log-odds).
BIAS = 0.3
ELEMENT = {"nav": -6.0, "footer": -6.0, "aside": -6.0, "form": -6.0, "menu": -5.0, "dialog": -6.0, "button": -5.0,
           "fieldset": -5.0, "header": -2.5, "head": -8.0, "article": 4.0, "main": 2.5, "blockquote": 0.5, "pre": 0.5,
           "figcaption": 0.3, "address": -1.0, "p": 0.7}
ROLE = {"navigation": -6.0, "banner": -4.0, "contentinfo": -6.0, "complementary": -6.0, "search": -6.0, "dialog": -6.0,
        "alertdialog": -6.0, "form": -6.0, "menu": -6.0, "menubar": -6.0, "main": 2.5, "article": 3.0}
#: Words of class and id names.
AGAINST = set("""ad ads advert advertisement adverts advertising banner breadcrumb breadcrumbs byline comment comments
consent cookie cookies copyright disclaimer discussion disqus footer gdpr legal login masthead menu modal nav navbar navigation
newsletter notice notices notification overlay pager pagination paywall popup promo promoted promotion recommended related
replies reply respond responses search share sharing sidebar signup skip social sponsor sponsored subscribe subscription
teaser toc toolbar topbar widget widgets""".split())
FOR = set("article body content entry main post story text".split())
#: Words of AGAINST that articles use for their parts, too.
DOUBTFUL = set("""banner byline copyright disclaimer discussion legal login menu navigation notification overlay promotion recommended
responses search share sharing signup skip social subscription teaser toc toolbar widget widgets""".split())
#: Words that say the same in any name; the others do in names of nothing but such words and those of PLACES.
CERTAIN = set("""ad ads advert advertisement adverts advertising breadcrumb breadcrumbs comment comments consent cookie cookies disqus
footer gdpr newsletter paywall popup reply replies respond sidebar sponsor sponsored subscribe""".split())
PLACES = FOR | set("""area aside bar block bottom box button card center column container content footer global group head header
inner item items left link links list main nav outer page panel primary right row secondary section site slot top wrap
wrapper""".split())
WORD_AGAINST, WORD_FOR = -6.0, 1.5
DOUBT = -1.0                 # of a doubtful name whose element reads like an article
PROSE_WORDS, PROSE_SHARE, PROSE_LINKS = 25, 0.6, 0.25    # words, share of them in sentences, share in links of such an element
LINKED = -5.0                # times the share of the text inside links
LONG, LONG_WORDS = 2.5, 40   # full bonus from so many words on
SENTENCE, FRAGMENT, NOTICE = 0.7, -0.4, -4.0
HEADING = 1.0
STEP, SHARED = 0.4, 1.2      # smoothness: between neighbours; more the more of the chain they share

_TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>"']++|"[^"]*+"|'[^']*+')*+|[^>]*+)>|<[!?][^>]*+>""", re.S)
_COMMENT = re.compile(r"<!--.*", re.S)
_BROKEN = re.compile(r"<(?:[/!?]|[a-zA-Z])[^<>]*\Z")
_NAMES = re.compile(r"""(?:^|\s)(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.I)
_WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")
_NOTICE = re.compile(r"©|all rights reserved|we use cookies|accept (?:all )?cookies|enable javascript", re.I)


def name_weight(value: str, inside: bool) -> tuple[float, bool]:
    """Weight of a class or id value, and whether it is doubtful (weighed by the element's text); ``inside``: an article or
    main part holds the element."""
    good = doubtful = False
    for name in value.split():
        words = {w.lower() for w in _WORDS.findall(name)}
        against = words & AGAINST
        if not against:
            good |= bool(words & FOR)
        elif inside and not against & CERTAIN and (against <= DOUBTFUL or words - AGAINST - PLACES):
            doubtful = True
        else:
            return WORD_AGAINST, False
    return (0.0, True) if doubtful else (WORD_FOR if good else 0.0, False)


class Element:
    """An open element: its place in the tree and what it and those around it say of the text."""

    __slots__ = ("content", "depth", "doubt", "parent", "prose", "score", "stands", "tag")

    def __init__(self, tag: str, attributes: str, parent: Element | None):
        self.tag, self.parent = tag, parent
        self.depth: int = parent.depth + 1 if parent else 1
        #: the nearest block element, itself included
        self.stands: Element = self if parent is None or tag in BLOCK else parent.stands
        self.content: bool = parent is not None and (parent.content or parent.tag in ("article", "main"))
        self.prose: bool = parent is not None and (parent.prose or parent.tag == "p")
        self.doubt: Doubt | None = parent.doubt if parent else None
        above = parent.score if parent else 0.0
        weight = ELEMENT.get(tag, 0.0)
        if tag == "header" and self.content or tag == "p" and self.prose:
            weight = 0.0                       # the head of an article is part of it
        if attributes and "=" in attributes:
            for name, *values in _NAMES.findall(attributes):
                value = next((v for v in values if v), "")
                if name.lower() == "role":
                    weight += ROLE.get(value.strip().lower(), 0.0)
                else:
                    said, doubtful = name_weight(value, self.content or above >= WORD_FOR)
                    weight += said
                    if doubtful and (self.doubt is None or self.doubt.of is not self):
                        self.doubt = Doubt(self, self.doubt)
        # what an element says holds for all in it; a second voice of the same kind adds nothing
        self.score = min(above, weight) if weight < 0 and above < 0 else above + weight
        if weight < 0 <= above:
            self.score = weight


class Doubt:
    """An element of a doubtful name, with the sums over its text that decide."""

    __slots__ = ("around", "bad", "chars", "linked", "of", "sentences", "words")

    def __init__(self, of: Element, around: Doubt | None):
        self.of, self.around = of, around
        self.words = self.sentences = self.chars = self.linked = 0
        self.bad = False


class Block:
    __slots__ = ("linked", "parent", "shared", "text", "words")

    def __init__(self, text: str, linked: int, parent: Element, shared: int):
        self.text, self.linked, self.parent, self.shared = text, linked, parent, shared
        self.words = text.count(" ") + 1

    def link_share(self) -> float:
        return min(1.0, self.linked / max(1, len(self.text)))

    def ends_a_sentence(self) -> bool:
        return self.text.rstrip("\"'»”)").endswith((".", "!", "?", "…", "。"))


def settle(found: list[Block]) -> None:
    """Decide for every doubtful element: bad if its text, all in it included, does not read like an article's, or if one
    around it is bad."""
    doubts: dict[int, Doubt] = {}
    for b in found:
        d = b.parent.doubt
        if d is not None:
            d.words += b.words
            d.chars += len(b.text)
            d.linked += b.linked
            d.sentences += b.words if b.ends_a_sentence() and b.link_share() <= PROSE_LINKS else 0
            while d is not None and id(d) not in doubts:
                doubts[id(d)] = d
                d = d.around
    order = sorted(doubts.values(), key=lambda d: d.of.depth)
    for d in reversed(order):
        d.bad = d.words < PROSE_WORDS or d.sentences < PROSE_SHARE * d.words or d.linked > PROSE_LINKS * d.chars
        if d.around is not None:
            for name in ("words", "sentences", "chars", "linked"):
                setattr(d.around, name, getattr(d.around, name) + getattr(d, name))
    for d in order:
        d.bad |= d.around is not None and d.around.bad


def blocks(html: str) -> list[Block]:
    """The blocks of a page in page order."""
    root = Element("#page", "", None)
    stack = [root]
    found: list[Block] = []
    pieces: list[str] = []
    state = {"linked": 0, "links": 0, "hidden": 0}      # hidden: place in the stack of the outermost hidden element
    last_end: dict[str, int] = {}                        # where the last end tag of a hidden element stands
    opened: Counter[str] = Counter()                     # open elements by tag
    shallow = 0                                          # least height of the stack since the last block

    def flush() -> None:
        nonlocal shallow
        if state["hidden"]:
            close(state["hidden"])
        if pieces:
            text = " ".join("".join(pieces).split())
            if text:
                parent = stack[-1].stands
                both = min(shallow, parent.depth, found[-1].parent.depth) if found else 0
                found.append(Block(text, state["linked"], parent, both))
                shallow = len(stack)
            pieces.clear()
        state["linked"] = 0

    def say(raw: str) -> None:
        if raw and not state["hidden"]:
            if stack[-1].tag == "head" and raw.strip():
                leave_head()
            text = unescape(raw) if "&" in raw else raw
            pieces.append(text)
            if state["links"]:
                state["linked"] += len(text.strip())

    def push(element: Element) -> None:
        stack.append(element)
        opened[element.tag] += 1
        state["links"] += element.tag == "a"

    def close(at: int) -> None:
        nonlocal shallow
        for e in stack[at:]:
            opened[e.tag] -= 1
            state["links"] -= e.tag == "a"
        del stack[at:]
        shallow = min(shallow, at)
        if at <= state["hidden"]:
            state["hidden"] = 0

    def ends_later(tag: str) -> bool:
        if tag not in last_end:
            last_end[tag] = max((m.start() for m in re.finditer(rf"</{re.escape(tag)}\b", html, re.I)), default=-1)
        return last_end[tag] >= pos

    def leave_head() -> None:
        if opened["head"]:
            at = next(i for i, e in enumerate(stack) if e.tag == "head")
            flush()
            close(at)

    pos, end = 0, len(html)
    over = html.rfind(">") + 1                           # no tag ends behind it
    while True:
        m = _TAG.search(html, pos, over) if pos < over else None
        if m is None:
            say(_BROKEN.sub("", _COMMENT.sub("", html[pos:])))
            break
        say(html[pos:m.start()])
        pos = m.end()
        tag = (m[2] or "").lower()
        if not tag:
            if m[0].startswith("<!--") and not m[0].endswith("-->"):
                break                                    # a comment without an end
            continue
        if m[1]:
            if not opened[tag]:
                continue
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag == tag:
                    if not 0 < state["hidden"] <= i and (tag in BLOCK or any(e.tag in BLOCK for e in stack[i:])):
                        flush()
                    close(i)
                    break
                if stack[i].tag in WALLS and tag not in BLOCK and tag not in HIDDEN:
                    break
            continue
        if state["hidden"] and tag in BLOCK:
            outer = stack[state["hidden"]].tag
            holds = NO_BLOCKS.get(outer, {tag})
            if tag not in holds and not any(e.tag in holds - BLOCK for e in stack[state["hidden"] + 1:]):
                close(state["hidden"])
        if tag not in IN_HEAD and not state["hidden"]:
            leave_head()
        if tag in RAW:
            if not m[3].endswith("/"):
                ended = re.compile(rf"</{re.escape(tag)}\b[^>]*(?:>|\Z)", re.I).search(html, pos)
                pos = ended.end() if ended else end
            pieces.append(" ")
            continue
        if state["hidden"]:
            if tag not in VOID and (tag in BLOCK or not m[3].endswith("/")):
                push(Element(tag, "", stack[state["hidden"]]))
            continue
        if tag in HIDDEN:
            pieces.append(" ")
            if not m[3].endswith("/") and ends_later(tag):
                state["hidden"] = len(stack)
                push(Element(tag, "", stack[-1]))
            continue
        if tag in BLOCK:
            flush()
            # a block ends an open paragraph; list items, cells and the like end their own kind
            for i in range(len(stack) - 1, 0, -1) if opened["p"] else ():
                if stack[i].tag == "p":
                    close(i)
                    break
                if stack[i].tag in WALLS:
                    break
            for i in range(len(stack) - 1, 0, -1) if any(opened[t] for t in ENDS.get(tag, ())) else ():
                if stack[i].tag in ENDS[tag]:
                    close(i)
                elif stack[i].tag in WALLS:
                    break
        if tag in VOID:
            pieces.append(" ")
            continue
        if m[3].endswith("/") and tag not in BLOCK:
            continue
        push(Element(tag, m[3], stack[-1]))
    flush()
    settle(found)
    return found


def score(block: Block) -> float:
    """Log-odds that a block is content."""
    parent = block.parent
    around = parent.score
    if parent.doubt is not None:
        around = min(around, WORD_AGAINST) if parent.doubt.bad else around + DOUBT
    s = BIAS + around + LINKED * block.link_share() + LONG * min(1.0, block.words / LONG_WORDS)
    if parent.tag in HEADINGS or parent.parent is not None and parent.parent.tag in HEADINGS:
        s += HEADING
    elif block.ends_a_sentence():
        s += SENTENCE
    else:
        s += FRAGMENT
    if block.words < 40 and _NOTICE.search(block.text):
        s += NOTICE
    return s


def content_side(scores: list[float], edges: list[tuple[int, int, float]]) -> list[bool]:
    """Minimum cut: which nodes stay with the source.  ``scores``: capacity from the source
    (positive) or to the sink (negative); ``edges``: capacities in both directions."""
    n = len(scores)
    if all(s > 0 for s in scores) or all(s <= 0 for s in scores):
        return [s > 0 for s in scores]
    source, sink = n, n + 1
    head: list[list[int]] = [[] for _ in range(n + 2)]
    to: list[int] = []
    room: list[float] = []

    def join(a: int, b: int, there: float, back: float) -> None:
        head[a].append(len(to))
        to.append(b)
        room.append(there)
        head[b].append(len(to))
        to.append(a)
        room.append(back)

    for i, s in enumerate(scores):
        if s > 0:
            join(source, i, s, 0.0)
        elif s < 0:
            join(i, sink, -s, 0.0)
    for a, b, w in edges:
        join(a, b, w, w)
    least = 1e-9
    while True:
        level = [-1] * (n + 2)
        level[source] = 0
        queue = deque([source])
        while queue:
            x = queue.popleft()
            for e in head[x]:
                if room[e] > least and level[to[e]] < 0:
                    level[to[e]] = level[x] + 1
                    queue.append(to[e])
        if level[sink] < 0:
            return [v >= 0 for v in level[:n]]
        tried = [0] * (n + 2)
        path: list[int] = []
        x = source
        while True:
            if x == sink:
                flow = min(room[e] for e in path)
                for e in path:
                    room[e] -= flow
                    room[e ^ 1] += flow
                k = next(i for i, e in enumerate(path) if room[e] <= least)
                x = to[path[k] ^ 1]
                del path[k:]
            elif tried[x] < len(head[x]):
                e = head[x][tried[x]]
                if room[e] > least and level[to[e]] == level[x] + 1:
                    path.append(e)
                    x = to[e]
                else:
                    tried[x] += 1
            elif x == source:
                break
            else:
                e = path.pop()
                x = to[e ^ 1]
                tried[x] += 1


def main_text(html: str | None) -> str:
    found = blocks(html or "")
    if not found:
        return ""
    edges = []
    last_under: dict[int, int] = {}
    for i, b in enumerate(found):
        if i:
            # the more the larger the part of the two element chains that is the same
            same = b.shared / max(found[i - 1].parent.depth, b.parent.depth)
            edges.append((i - 1, i, STEP + SHARED * same))
        parent = id(b.parent.parent or b.parent)
        if last_under.get(parent, i - 1) != i - 1:
            edges.append((last_under[parent], i, SHARED))
        last_under[parent] = i
    side = content_side([score(b) for b in found], edges)
    return "\n\n".join(b.text for b, keep in zip(found, side) if keep)


def extract(pages: DataFrame, html: str = "html") -> DataFrame:
    """``pages`` with the html column replaced by text and n_chars (columns of these names, too)."""
    ready_python(pages.sparkSession)
    (inner,) = unused(pages, "_html")
    source = pages.select(*[F.col(quoted(c)) for c in pages.columns if c != html and c not in ("text", "n_chars")],
                          F.coalesce(F.col(quoted(html)), F.lit("")).alias(inner))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            texts = [main_text(h) for h in frame.pop(inner)]
            frame["text"], frame["n_chars"] = texts, [len(t) for t in texts]
            yield frame

    fields = [f for f in source.schema.fields if f.name != inner]
    return map_frames(source, run, StructType([*fields, StructField("text", StringType()), StructField("n_chars", LongType())]))
