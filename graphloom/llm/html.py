"""Main-text extraction by composite text density.

A tolerant parse builds the DOM in time linear in the page, however deep it
nests. Every node gets its characters, tags, link characters and link tags;
its composite density is characters per tag, adjusted by how much of it is
links. The density of ``body`` on the way to the node of the largest density
sum sets the threshold, child densities are summed, and the subtrees with the
largest sums among the nodes above the threshold are the article. ``article``
and ``main`` are a feature of that choice, not a replacement for it: sums
inside of them weigh ``NAMED_WEIGHT`` times, and a choice inside of one is
widened to it.

Controls, scripts, styles and hidden elements are cut before anything is
counted. Menus, page headers, footers, asides and forms are cut as well unless
they turn out to wrap the page: they hold all its ``article`` and ``main``
elements, or nine tenths of its prose, or were never closed and swallowed what
followed; then only their link lists go. A class, id or role cuts an element
outright if its last telling word names furniture (``site-footer``, ``ad``);
a name that can belong to the article (``related-work``, ``discussion``) cuts
it only if the element isn't built like a section of prose.

Null html counts as empty; a page with no text left gives the empty string.
Repeated rows give equal rows, an empty table an empty one; of equally dense
nodes the first in page order is taken. Other columns, also ones called text,
don't matter: only ``keep`` and the html column are read.
"""

from __future__ import annotations

import math
import re
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.llm.common import table

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: What a reader operates.
CONTROLS = frozenset("button select textarea option input label legend datalist output progress meter".split())
#: Cut with all they hold, always.
DROPPED = CONTROLS | frozenset("head title script style noscript template iframe object embed svg canvas audio video map dialog".split())
#: Cut with all they hold, unless they wrap the page.
FURNITURE = frozenset("nav footer aside form fieldset menu".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Elements whose own text is prose; a text this long is prose in any element.
PROSE = HEADINGS | frozenset("p pre blockquote article section main li dd td figcaption".split())
LONG_TEXT = 40
BLOCKS = frozenset(
    "html body address article blockquote center dd details div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header "
    "hgroup hr li main nav ol p pre section summary table tbody td tfoot th thead tr ul aside caption".split()
)
#: Block elements that a link list is looked for in.
CONTAINERS = frozenset("div section nav form fieldset menu aside header footer center ul ol table tbody tr td".split())
#: An inline end tag doesn't reach over these.
WALLS = BLOCKS | DROPPED
#: Start tags that end an open paragraph.
ENDS_P = BLOCKS - {"html", "body", "caption", "td", "th", "tr", "tbody", "thead", "tfoot"}
#: End tags that may be left out.
OPTIONAL_END = frozenset("p li dt dd tr td th thead tbody tfoot option".split())
#: Start tags that end an open element of these names, up to the given border.
SIBLINGS = {
    "li": (frozenset({"li"}), frozenset({"ul", "ol", "menu"})),
    "dt": (frozenset({"dt", "dd"}), frozenset({"dl"})),
    "dd": (frozenset({"dt", "dd"}), frozenset({"dl"})),
    "tr": (frozenset({"tr", "td", "th"}), frozenset({"table", "tbody", "thead", "tfoot"})),
    "td": (frozenset({"td", "th"}), frozenset({"tr", "table"})),
    "th": (frozenset({"td", "th"}), frozenset({"tr", "table"})),
}
#: Words of a class, id or role that name what readers wrote.
REMARKS = frozenset("comment comments disqus".split())
#: Words of a class, id or role that name furniture.
HINTS = REMARKS | frozenset(
    "ad ads advert adverts advertisement advertising advertorial sponsor sponsored promo promoted cookie cookies consent gdpr notices "
    "popup modal overlay nav navbar breadcrumb breadcrumbs pagination pager sidebar footer masthead topbar toolbar newsletter signup "
    "paywall skip complementary contentinfo".split()
)
#: Words that name furniture or a subject.
DOUBTFUL = frozenset(
    "promotion banner notice notification alert navigation menu side aside rail reply replies respond discussion share sharing social related "
    "recommended recommendations subscribe subscription login widget copyright search dialog".split()
)
#: Words that say nothing about what an element holds; a name's telling word is the last other one.
NEUTRAL = frozenset(
    "box block section container wrapper wrap list bar area item items group holder inner outer top bottom left right content contents text "
    "links link buttons button icons icon post posts article articles form module panel region row col column thread site page main".split()
)
#: Times a density sum counts more inside of article and main.
NAMED_WEIGHT = 4
WORD = re.compile(r"[a-z]+")
CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")
SPACE = re.compile(r"\s+")
#: How an element's names judge it.
PLAIN, MAYBE, NAMED_OFF, REMARK, HIDDEN = range(5)


class Node:
    __slots__ = (
        "tag", "parent", "items", "name", "closed", "cut", "start", "end", "chars", "tags", "link_chars", "link_tags", "density", "total", "best",
        "raw", "raw_links", "prose", "controls", "headings", "marked",
    )

    def __init__(self, tag: str, parent: Node | None, name: int = PLAIN):
        self.tag, self.parent, self.name = tag, parent, name
        self.closed = self.cut = False
        self.items: list[Node | str] = []


def judged(attrs: list, tag: str) -> int:
    """What hidden, class, id and role say of an element."""
    worst = PLAIN
    for name, value in attrs:
        if name == "hidden" or (name == "aria-hidden" and value == "true") or (name == "style" and value and "display:none" in value.replace(" ", "").lower()):
            return HIDDEN
        if name not in ("class", "id", "role") or not value or tag in ("html", "body", "article", "main"):
            continue
        for token in value.split():
            words = WORD.findall(CAMEL.sub("-", token).lower())
            telling = [w for w in words if w not in NEUTRAL]
            if not telling:
                continue
            if telling[-1] in REMARKS:
                worst = max(worst, REMARK)
            elif telling[-1] in HINTS or telling == ["header"]:
                worst = max(worst, NAMED_OFF)
            elif not (HINTS.isdisjoint(telling) and DOUBTFUL.isdisjoint(telling)):
                worst = max(worst, MAYBE)
    return worst


class Builder(HTMLParser):
    """Tolerant DOM: paragraphs, list items and cells close themselves; stray end tags are ignored.

    The open elements are a stack; the places of each tag in it, of walls and of
    blocks are kept, so that a tag costs the elements that it closes and no more.
    """

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = Node("#root", None)
        self.stack = [self.root]
        self.places: dict[str, list[int]] = {}
        self.walls, self.blocks = [0], [0]
        self.seen = set()

    def _last(self, tag: str) -> int:
        places = self.places.get(tag)
        return places[-1] if places else 0

    def _close_to(self, place: int) -> None:
        """Takes the stack's elements from ``place`` on off."""
        while len(self.stack) > place:
            tag = self.stack.pop().tag
            self.places[tag].pop()
        for marks in (self.walls, self.blocks):
            while marks[-1] >= place:
                marks.pop()

    def handle_starttag(self, tag, attrs):
        if tag in ("html", "body"):
            if tag in self.seen:
                return
            self.seen.add(tag)
            if tag == "body" and (place := self._last("head")):
                self._close_to(place)
        if tag in ENDS_P and self.stack[self.blocks[-1]].tag == "p":
            self._close_to(self.blocks[-1])
        if tag in SIBLINGS:
            own, border = SIBLINGS[tag]
            floor = max(map(self._last, border))
            inside = [p for name in own if (p := self._after(name, floor))]
            if inside:
                self._close_to(min(inside))
        node = Node(tag, self.stack[-1], judged(attrs, tag) if attrs else PLAIN)
        self.stack[-1].items.append(node)
        if tag not in VOID:
            place = len(self.stack)
            self.stack.append(node)
            self.places.setdefault(tag, []).append(place)
            if tag in WALLS:
                self.walls.append(place)
            if tag in BLOCKS:
                self.blocks.append(place)

    def _after(self, tag: str, floor: int) -> int:
        """The first place of an open ``tag`` above ``floor``, 0 if none; all from there on are closed by the caller."""
        places = self.places.get(tag, [])
        at = len(places)
        while at and places[at - 1] > floor:
            at -= 1
        return places[at] if at < len(places) else 0

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.handle_endtag(tag)

    def handle_endtag(self, tag):
        place = self._last(tag)
        if place and (tag in WALLS or self.walls[-1] < place):
            self.stack[place].closed = True
            self._close_to(place)

    def handle_data(self, data):
        self.stack[-1].items.append(data)


def parse(html: str) -> Node:
    builder = Builder()
    builder.feed(html)
    builder.close()
    furnish(builder.root)
    return builder.root


def furnish(root: Node) -> None:
    """Marks what is cut: counts all text first, children before parents, then judges from the top."""
    nodes, stack = [], [root]
    while stack:
        node = stack.pop()
        node.cut = node.tag in DROPPED or node.name == HIDDEN
        nodes.append(node)
        if not node.cut:
            stack.extend(x for x in node.items if isinstance(x, Node))
    for node in reversed(nodes):
        node.raw = node.raw_links = node.prose = node.headings = node.marked = 0
        node.controls = int(node.tag in CONTROLS)
        if node.cut:
            continue
        own = operated = 0
        for x in node.items:
            if isinstance(x, str):
                size = len(SPACE.sub(" ", x).strip())
                node.raw += size
                if node.tag in PROSE or size >= LONG_TEXT:
                    own += size
            else:
                operated += x.tag in CONTROLS
                node.raw += x.raw
                node.raw_links += x.raw_links
                node.prose += x.prose
                node.controls += x.controls
                node.headings += x.headings
                node.marked += x.marked
        if node.tag == "a":
            node.raw_links, node.prose = node.raw, 0
        elif not operated:
            node.prose += own
        node.headings += node.tag in HEADINGS
        node.marked += node.tag in ("article", "main") and node.raw > 0
    todo = [(root, False, False)]
    while todo:
        node, inside, sieve = todo.pop()
        off = node.tag in FURNITURE or (node.tag == "header" and not inside) or (node.name == NAMED_OFF) or _doubted(node)
        if node.name == REMARK or (sieve and node.raw and 2 * node.raw_links > node.raw):
            node.cut = True
        elif off and not _wraps(node, root):
            node.cut = True
        if node.cut:
            continue
        inside = inside or node.tag in ("article", "main")
        sieve = off or (sieve and node.tag in CONTAINERS)
        todo.extend((x, inside, sieve) for x in node.items if isinstance(x, Node) and not x.cut)


def _doubted(node: Node) -> bool:
    """A doubtful name counts unless the element has the form of a section: a heading with text, or much prose, few links, nothing to operate."""
    if node.name != MAYBE:
        return False
    if node.controls or 3 * node.raw_links >= node.raw:
        return True
    return not (node.headings and node.prose or node.prose >= 4 * LONG_TEXT)


def _wraps(node: Node, root: Node) -> bool:
    """Whether furniture holds the page: all named articles, nine tenths of the prose, or what an element that nobody closed swallowed."""
    if root.marked:
        if node.marked == root.marked:
            return True
    elif node.prose and 10 * node.prose >= 9 * root.prose:
        return True
    if node.closed or node.tag in OPTIONAL_END:
        return False
    return node.prose > 0 and (node.tag in ("nav", "menu") or 4 * node.prose > root.prose)


def in_order(root: Node) -> list[Node]:
    """Kept nodes, parents first, numbered; a node's subtree is ``start`` to before ``end``. No recursion, however deep the page."""
    out, stack = [], [root]
    while stack:
        node = stack.pop()
        node.start = len(out)
        out.append(node)
        stack.extend(x for x in reversed(node.items) if isinstance(x, Node) and not x.cut)
    for node in reversed(out):
        node.end = max((x.end for x in node.items if isinstance(x, Node) and not x.cut), default=node.start + 1)
    return out


def measure(nodes: list[Node]) -> Node:
    """Density and density sum of each node, children first, and the best of its subtree; returns body."""
    for node in reversed(nodes):
        node.chars = node.tags = node.link_chars = node.link_tags = 0
        for x in node.items:
            if isinstance(x, str):
                node.chars += len(SPACE.sub(" ", x).strip())
            elif not x.cut:
                node.chars += x.chars
                node.tags += x.tags + 1
                node.link_chars += x.link_chars
                node.link_tags += x.link_tags + (x.tag == "a")
        if node.tag == "a":
            node.link_chars, node.link_tags = node.chars, node.tags
    body = next((n for n in nodes if n.tag == "body"), nodes[0])
    ratio = body.link_chars / max(body.chars, 1)
    for node in nodes:
        c, t, lc, lt = node.chars, max(node.tags, 1), node.link_chars, node.link_tags
        if not c:
            node.density = 0.0
            continue
        base = math.log(c / max(c - lc, 1) * lc + ratio * c + math.e)
        node.density = c / t * math.log(max(c / max(lc, 1) * t / max(lt, 1), 1.0)) / base
    named_to = 0
    for node in nodes:
        if node.tag in ("article", "main"):
            named_to = max(named_to, node.end)
        weight = NAMED_WEIGHT if node.start < named_to else 1
        node.total = weight * sum(x.density for x in node.items if isinstance(x, Node) and not x.cut)
    for node in reversed(nodes):
        node.best = node
        for x in node.items:
            if isinstance(x, Node) and not x.cut and (x.best.total, -x.best.start) > (node.best.total, -node.best.start):
                node.best = x.best
    return body


def select(root: Node) -> list[Node]:
    """The article's nodes in page order: the subtrees of largest density sum among those above the threshold, widened or narrowed to named elements."""
    nodes = in_order(root)
    body = measure(nodes)
    top = body.best
    threshold, node = math.inf, top
    while node is not None:
        if node.density:
            threshold = min(threshold, node.density)
        node = None if node is body else node.parent
    found: list[Node] = []
    stack = [body]
    while stack:
        node = stack.pop()
        if not node.chars or (found and found[-1].start <= node.start and node.end <= found[-1].end):
            continue
        if node.density >= threshold:
            # What lies beside the best of this subtree is looked at on its own.
            found.append(node.best)
        stack.extend(x for x in reversed(node.items) if isinstance(x, Node) and not x.cut)
    picked = sorted({id(n): n for n in found or [top]}.values(), key=lambda n: n.start)
    marked = [n for n in nodes if n.tag in ("article", "main") and n.chars]
    if marked:
        picked = _to_named(picked, top, marked, threshold)
    out: list[Node] = []
    for node in picked:
        if not out or node.start >= out[-1].end:
            out.append(node)
    return out


def _to_named(picked: list[Node], top: Node, marked: list[Node], threshold: float) -> list[Node]:
    """The named element around the densest choice, and those beside it that are as dense; without one, the named elements in the choice."""
    articles = [n for n in marked if n.tag == "article"]
    for kind in (articles, marked):
        around = next((n for n in kind if n.start <= top.start and top.end <= n.end), None)
        if around is not None:
            return [n for n in kind if n is around or (n.tag == around.tag and n.parent is around.parent and n.density >= threshold)]
    for kind in (articles, marked):
        within = [n for n in kind if top.start < n.start and n.end <= top.end]
        if within:
            best = max(within, key=lambda n: (n.total, n.density, -n.start))
            return [n for n in within if n is best or (n.tag == best.tag and n.parent is best.parent)]
    return picked


def blocks(root: Node) -> list[str]:
    """The text of each block in page order, white space folded."""
    out, now = [], []

    def cut():
        text = SPACE.sub(" ", "".join(now)).strip()
        if text:
            out.append(text)
        now.clear()

    stack: list = [root]
    while stack:
        x = stack.pop()
        if x is None:
            cut()
        elif isinstance(x, str):
            now.append(x)
        elif x.cut:
            continue
        elif x.tag == "br":
            now.append(" ")
        else:
            if x.tag in BLOCKS:
                cut()
                stack.append(None)
            stack.extend(reversed(x.items))
    cut()
    return out


def extract(html: str | None) -> str:
    root = parse(html or "")
    return "\n\n".join(b for node in select(root) for b in blocks(node))


def extract_pages(pages: DataFrame, html_col: str = "html", keep: tuple[str, ...] = ("page_id", "url")) -> DataFrame:
    """The ``keep`` columns, text, and n_chars (code points) for every row."""
    picked = pages.select(*keep, F.col(html_col).alias("_html"))
    schema = picked.drop("_html").schema.add("text", "string").add("n_chars", "long")

    def run(batches):
        for batch in batches:
            texts = [extract(x) for x in batch.column(batch.num_columns - 1).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(texts, pa.string()), pa.array(list(map(len, texts)), pa.int64())], [*batch.schema.names[:-1], "text", "n_chars"])

    return picked.mapInArrow(run, schema)


def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_pages(table(spark, sf_dir, "pages"))
