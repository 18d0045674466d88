"""Main text of web pages by tree scoring.

Every paragraph scores by its length and its commas. Its points go to its parent in full, to the ancestors above in falling parts;
a container's points are discounted by the share of its text that stands in links. The article or main element around the best
container is kept whole; on a page without one, everything that is not mostly links. What a page says it is not by tag or role, or
by a class or id of adverts and reader comments, is cut off before the scoring, as are scripts and styles. Other words of a class or
id (menu, social, notice) and forms are hints that the text inside is weighed against.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenframe.llm.frames import extend
from lumenframe.llm.words import slices, trim

# Tags by the states of the HTML tokeniser: a quote opens a value only right after "="; everything consumed is consumed once.
_TOKEN = re.compile(
    r"""<!--(?:-?>|.*?(?:--!?>|\Z))            # a comment
      | <[!?][^>]*+(?:>|\Z)                    # a declaration
      | </(?![A-Za-z])[^>]*+(?:>|\Z)           # no end tag: skipped like a comment
      | <(/?)([A-Za-z][^\s/>]*+)               # a tag: name and attributes
        ((?:[\s/]++ | =?[^\s/>=]++ (?:\s*+=\s*+(?:"[^"]*+(?:"|\Z) | '[^']*+(?:'|\Z) | [^\s"'>][^\s>]*+)?+)?+ | =)*+)
        (?:>|\Z)""",
    re.S | re.X,
)
_ATTRIBUTE = re.compile(r"""(=?[^\s/>=]++)(?:\s*+=\s*+(?:"([^"]*+)"?|'([^']*+)'?|([^\s"'>][^\s>]*+))?+)?+""", re.S)
_SPACE = re.compile(r"\s+")

# Element kinds of HTML.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = set("script style noscript textarea title iframe xmp noembed noframes".split())
BLOCK = set(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
HEADINGS = set("h1 h2 h3 h4 h5 h6".split())
DROPPED = RAW | set("head nav header footer aside button select option input label svg canvas object embed audio video map menu dialog math datalist template".split())
DROPPED_ROLES = set("navigation banner contentinfo complementary search form dialog alertdialog menu menubar toolbar alert note tablist".split())
#: An end tag does not reach past a cell or table that began after its element.
SCOPE = set("table td th caption".split())
TABLE_PARTS = set("table caption thead tbody tfoot tr td th".split())
ENDED_BY = {
    "li": {"li"},
    "dt": {"dt", "dd"},
    "dd": {"dt", "dd"},
    "tr": {"tr", "td", "th"},
    "td": {"td", "th"},
    "th": {"td", "th"},
    "thead": {"tbody", "thead", "tfoot", "tr", "td", "th"},
    "tbody": {"tbody", "thead", "tfoot", "tr", "td", "th"},
    "tfoot": {"tbody", "thead", "tfoot", "tr", "td", "th"},
    "option": {"option"},
}
LIMITS = {"li": {"ul", "ol", "menu", "dir"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"table"}, "th": {"table"}, "thead": {"table"}, "tbody": {"table"}, "tfoot": {"table"}}
#: Words of a class or id (cut at everything but letters and digits). These tell what is never the article.
NEVER = set("ad ads adv advert adverts advertisement advertising adbox adsense sponsor sponsored sponsors comment comments commentlist disqus replies respond".split())
#: These hint at what is not the article. The text inside is weighed against them.
HINTS = set(
    """banner breadcrumb breadcrumbs consent cookie cookies disclaimer dropdown footer gdpr header hidden masthead menu menubar modal nav navbar navigation newsletter notice notices
    pager pagination popup promo promoted promotion related rss search share sharing shoutbox sidebar signup skip social subscribe subscription teaser toc toolbar widget widgets""".split()
)
#: Words that say nothing about the contents: beside hints only, they leave a name a plain statement.
NEUTRAL = set(
    """area bar bars block bottom box btn button buttons col column container fixed floating global group icon icons inner item items js layout left link links list main middle mobile
    outer overlay page panel primary right row secondary section site sticky text top ui wrap wrapper""".split()
)
#: Words that keep an element in spite of one of the above.
CONTENT = set("article body content entry main post story text".split())
PARAGRAPHS = set("p pre blockquote td dd dt li figcaption h1 h2 h3 h4 h5 h6 div section article main body".split())
_CUT = re.compile(r"[^A-Za-z0-9]+|(?<=[a-z])(?=[A-Z])")


class Node:
    __slots__ = ("tag", "parent", "children", "chars", "linked", "commas", "score", "scored", "hint", "blocks")

    def __init__(self, tag: str, parent: Node | None, hint: int = 0):
        self.tag, self.parent, self.hint = tag, parent, hint
        self.children: list = []  # nodes and strings (decoded), in order
        self.chars = self.linked = self.commas = 0
        self.score, self.scored, self.blocks = 0.0, False, False


#: What an element says of itself: nothing, a doubtful hint, a plain statement, or that it is not the article whatever it holds.
_NONE, _WEAK, _STRONG, _CUT_OFF = range(4)


def _hint(tag: str, attributes: str) -> int:
    if tag in DROPPED:
        return _CUT_OFF
    found = _STRONG if tag == "form" else _NONE
    if not attributes or not attributes.strip():
        return found
    for m in _ATTRIBUTE.finditer(attributes):
        name, value = m[1].lower(), m[2] or m[3] or m[4] or ""
        if name == "hidden" or name == "aria-hidden" and value.lower() == "true" or name == "style" and re.search(r"display\s*:\s*none", value, re.I):
            return _CUT_OFF
        if name == "role" and value.lower() in DROPPED_ROLES:
            return _CUT_OFF
        if name in ("class", "id") and tag not in ("html", "body", "article", "main"):
            words = {w.lower() for w in _CUT.split(html.unescape(value))} - {""}
            if words & CONTENT:
                continue
            if words & NEVER:
                return _CUT_OFF
            if words & HINTS:
                found = max(found, _WEAK if words - HINTS - NEUTRAL else _STRONG)
    return found


class _Open:
    """The stack of open elements, with the places of each tag in it, so that no question walks the stack."""

    def __init__(self, root: Node):
        self.stack = [root]
        self.places: dict[str, list[int]] = {}
        self.blocks: list[int] = []

    def push(self, node: Node) -> None:
        self.places.setdefault(node.tag, []).append(len(self.stack))
        if node.tag in BLOCK:
            self.blocks.append(len(self.stack))
        self.stack.append(node)

    def last(self, tags: Iterable[str]) -> int:
        """Place of the innermost open element of some tags, or 0."""
        return max((self.places[t][-1] for t in tags if self.places.get(t)), default=0)

    def close(self, place: int) -> None:
        """End the element at a place, and all inside it."""
        while len(self.stack) > place:
            node = self.stack.pop()
            self.places[node.tag].pop()
            if node.tag in BLOCK:
                self.blocks.pop()

    def end(self, tag: str) -> bool:
        """An end tag: whether it closed an element that was open."""
        place = self.last(HEADINGS if tag in HEADINGS else (tag,))
        if not place or tag not in TABLE_PARTS and self.last(SCOPE) > place:
            return False
        if tag not in BLOCK and self.blocks and self.blocks[-1] > place:
            return False  # a block goes on in spite of the inline element around it
        self.close(place)
        return True

    def begin(self, tag: str) -> None:
        """What a start tag ends."""
        if tag in BLOCK and (p := self.last(("p",))) > self.last(SCOPE):
            self.close(p)
        if tag in ENDED_BY and (place := self.last(ENDED_BY[tag])) > self.last(LIMITS.get(tag, ())):
            # The outermost of the parts that end: a row ends its cells, a group its rows.
            inside = self.last(LIMITS.get(tag, ()))
            self.close(min(p for t in ENDED_BY[tag] for p in self.places.get(t, ())[-1:] if p > inside) if tag in TABLE_PARTS else place)
        elif tag in HEADINGS and self.stack[-1].tag in HEADINGS or tag == "a" and (p := self.last(("a",))) and not (self.blocks and self.blocks[-1] > p):
            self.close(len(self.stack) - 1 if tag in HEADINGS else p)


def parse(page: str) -> Node:
    """The tree of a page without what is cut off, forgiving about missing end tags; in time linear in its length. The root is a body."""
    root = Node("body", None)
    now = _Open(root)
    gone: _Open | None = None  # what is open inside an element that is cut off
    i, n = 0, len(page)

    def text(a: int, b: int) -> None:
        if b > a and gone is None:
            piece = page[a:b]
            now.stack[-1].children.append(html.unescape(piece) if "&" in piece else piece)

    while i < n:
        m = _TOKEN.search(page, i)
        if not m:
            text(i, n)
            break
        text(i, m.start())
        i = m.end()
        if m[2] is None:
            continue
        tag = m[2].lower()
        empty = m[3].endswith("/")
        if m[1]:
            if gone is not None:
                if gone.end(tag):
                    gone = gone if len(gone.stack) > 1 else None
                    continue
                if tag not in BLOCK or not now.last((tag,)):
                    continue
                gone = None  # an outer element ends: so does what was left open inside
            if not now.end(tag):
                if tag == "br":
                    now.stack[-1].children.append("\n")
                elif tag == "p":
                    now.stack[-1].children.append(Node("hr", now.stack[-1]))
            continue
        if tag in RAW:
            if gone is not None and empty and gone.last(("svg", "math")):
                continue  # a drawing's empty element, not HTML's
            end = _RAW_END[tag].search(page, i)
            i = end.end() if end else n
            continue
        if gone is not None:
            if tag not in VOID and not empty:
                gone.begin(tag)
                gone.push(Node(tag, None))
            continue
        if tag in ("html", "body"):
            continue
        now.begin(tag)
        at = now.stack[-1]
        if tag in VOID:
            if tag not in ("input", "embed"):
                at.children.append("" if tag == "wbr" else "\n")
                if tag == "hr":
                    at.children.append(Node("hr", at))
            continue
        hint = _hint(tag, m[3])
        if hint == _CUT_OFF:
            if not empty:
                gone = _Open(root)
                gone.push(Node(tag, None))
            if tag in BLOCK:  # text before and after stays in different blocks
                at.children.append(Node("hr", at))
            continue
        node = Node(tag, at, hint)
        at.children.append(node)
        now.push(node)
    return root


_RAW_END = {tag: re.compile(rf"</{tag}(?=[\s/>])[^>]*+(?:>|\Z)", re.I) for tag in RAW}


def _measure(root: Node) -> list[Node]:
    """Characters, link characters and commas of every subtree, and whether a block is inside; the nodes, children before parents."""
    order, stack = [], [root]
    while stack:
        node = stack.pop()
        node.chars = node.linked = node.commas = 0
        node.blocks = False
        order.append(node)
        stack += [c for c in node.children if isinstance(c, Node)]
    order.reverse()
    for node in order:
        own = _SPACE.sub(" ", "".join(c for c in node.children if isinstance(c, str))).strip()
        node.chars += len(own)
        node.commas += sum(own.count(c) for c in ",،、，")
        if node.tag == "a":
            node.linked = node.chars
        if node.parent is not None:
            node.parent.chars += node.chars
            node.parent.linked += node.linked
            node.parent.commas += node.commas
            node.parent.blocks |= node.blocks or node.tag in BLOCK
    return order


def _density(node: Node) -> float:
    return node.linked / node.chars if node.chars else 0.0


_PRIOR = {"article": 10.0, "main": 10.0, "section": 3.0, "div": 3.0, "pre": 3.0, "td": 3.0, "blockquote": 3.0, "ul": -3.0, "ol": -3.0, "li": -3.0, "dl": -3.0, "dt": -3.0, "dd": -3.0, "address": -3.0}


def _points(node: Node) -> float:
    """What a paragraph scores; 0 for what is none."""
    if node.tag not in PARAGRAPHS or node.chars < 2:
        return 0.0
    if node.blocks and node.tag in ("div", "section", "article", "main", "body", "li", "td", "dd") and sum(len(c.strip()) for c in node.children if isinstance(c, str)) < 25:
        return 0.0
    return (1 + node.commas + min(node.chars // 100, 3)) * (1 - _density(node))


def _weigh_hints(root: Node, order: list[Node]) -> bool:
    """Take the hinted elements out whose text does not outweigh their hint; whether there were any.

    A doubtful hint is outweighed by prose: paragraphs of three points in all, with few links. A plain statement is outweighed if
    the page has no other paragraph and no article, and the element holds an article or two paragraphs of over 80 characters with few links.
    """
    suspects = [n for n in order if n.hint]
    if not suspects:
        return False
    inside: dict[int, Node | None] = {}  # the outermost hinted element around each node
    points: dict[int, list] = {id(s): [0.0, 0, False] for s in suspects}
    rest = 0.0
    for node in reversed(order):
        up = inside.get(id(node.parent)) if node.parent is not None else None
        inside[id(node)] = up if up is not None else node if node.hint else None
    plain = {id(n): 0 for n in suspects}
    for node in order:
        if inside[id(node)] is None:
            rest += _points(node) if node.chars >= 25 or node.tag in ("article", "main") else 0
            rest += node.tag in ("article", "main") and node.chars >= 2
    # Sums of the hinted elements, children before parents: each node adds to the next hinted element around it.
    total: dict[int, tuple[float, int, bool]] = {}
    for node in order:
        p, long, article = total.pop(id(node), (0.0, 0, False))
        own = _points(node)
        p, long, article = p + own, long + (node.tag == "p" and node.chars > 80 and _density(node) < 0.25), article or node.tag in ("article", "main")
        if node.hint:
            points[id(node)] = [p, long, article]
        if node.parent is not None:
            a, b, c = total.get(id(node.parent), (0.0, 0, False))
            total[id(node.parent)] = (a + p, b + long, c or article)
    for node in suspects:
        p, long, article = points[id(node)]
        if node.hint == _WEAK:
            plain[id(node)] = p >= 3 and _density(node) < 0.25
        else:
            plain[id(node)] = rest == 0 and _density(node) < 0.25 and (article or long >= 2)
    for node in suspects:
        if not plain[id(node)]:
            node.tag, node.children = "hr" if node.tag in BLOCK else "span", []
    return True


def main_nodes(root: Node) -> list[Node]:
    """The article or main element around the best container, with those siblings that score well or are prose. On a page without:
    the best container and all that stands beside it and its ancestors, but for blocks and bare text that are mostly links."""
    candidates: list[Node] = []
    order = _measure(root)
    if _weigh_hints(root, order):
        order = _measure(root)
    for node in order:
        points = _points(node)
        if not points:
            continue
        up, share = node.parent if node.tag != "body" else node, 1.0
        for level in range(5):
            if up is None:
                break
            if not up.scored:
                up.scored, up.score = True, up.score + _PRIOR.get(up.tag, 0.0)
                candidates.append(up)
            up.score += points * share
            up = up.parent
            share = 0.5 if level == 0 else 1 / (3 * (level + 1))
    if not candidates:
        return [root]
    value = lambda c: c.score * (1 - _density(c))
    best = top = max(candidates, key=value)
    up, article = best, False
    while up is not None:
        if up.tag in ("article", "main"):
            top, article = up, True
        up = up.parent
    least = max(10.0, 0.2 * value(best))
    kept, at = [top], top
    while at.parent is not None:
        before, after = [], []
        side, run = before, []

        def end() -> None:
            if run:
                side.extend(_bare(run, article))
                run.clear()

        for c in at.parent.children:
            if isinstance(c, str) or c is not at and c.tag not in BLOCK:
                run.append(c)
                continue
            end()
            if c is at:
                side = after
                continue
            prose = c.tag in ("p", "blockquote", "pre", "h1", "h2", "h3", "h4", "h5", "h6") and (c.chars > 80 and _density(c) < 0.25 or 0 < c.chars <= 80 and not c.linked)
            if c.scored and value(c) >= least or prose or not article and _density(c) <= 0.5:
                side.append(c)
        end()
        kept = [*before, *kept, *after]
        if article:  # it says itself where the text ends
            break
        at = at.parent
    return kept


def _bare(run: list, article: bool) -> list[Node]:
    """Text directly in a container, with its inline elements, as one block; none beside an article, or if it is mostly links."""
    block = Node("div", None)
    block.children = list(run)
    own = len("".join(c for c in run if isinstance(c, str)).strip())
    nodes = [c for c in run if isinstance(c, Node)]
    linked, chars = sum(c.linked for c in nodes), own + sum(c.chars for c in nodes)
    return [block] if chars and not article and linked <= 0.5 * chars else []


def _blocks(nodes: list[Node]) -> Iterator[str]:
    text: list[str] = []

    def done() -> Iterator[str]:
        line = "".join(text)
        text.clear()
        line = _SPACE.sub(" ", line).strip()
        if line:
            yield line

    for top in nodes:
        stack: list = [top]
        while stack:
            x = stack.pop()
            if isinstance(x, str):
                text.append(x)
            elif x is None:
                yield from done()
            elif x.tag in BLOCK:
                yield from done()
                stack.append(None)
                stack += reversed(x.children)
            else:
                stack += reversed(x.children)
        yield from done()


def extract(page: str | None) -> str:
    """Main text of a page: its blocks in order, joined by one newline. A null, an empty page and one without text give ''."""
    if not page:
        return ""
    return "\n".join(_blocks(main_nodes(parse(page))))


def _extract_batches(names: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "__html"):
                texts = [extract(p.as_py()) for p in part.column("__html")]
                yield pa.RecordBatch.from_arrays([*(part.column(n) for n in names), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=[*names, "text", "n_chars"])
        trim()

    return run


def extract_text(pages: DataFrame, keep: tuple[str, ...] = ("page_id", "url"), html_col: str = "html") -> DataFrame:
    """The columns of keep, text and n_chars (code points) of every page; a row for each row, whatever its nulls. No shuffle.

    A null, an empty page and one without text give an empty text. Pages are read whole: time and memory are linear in a page's
    length, however deep or unclosed its elements are, and a task holds one page's tree at a time. An empty table gives no rows;
    columns that are not kept are not looked at, whatever their names."""
    names = [f"__k{i}" for i in range(len(keep))]
    rows = pages.select(*[F.col(f"`{c}`").alias(n) for c, n in zip(keep, names, strict=True)], F.col(f"`{html_col}`").alias("__html"))
    out = rows.mapInArrow(_extract_batches(names), extend(rows.drop("__html").schema, "text string, n_chars long"))
    return out.withColumnsRenamed(dict(zip(names, keep, strict=True)))
