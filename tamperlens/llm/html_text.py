"""Main text of web pages by tree scoring.

A page is read into a small element tree. Each paragraph-like block passes points, for its
length and its commas, to its ancestors, less the further up; a container's points are
discounted by the share of its text that stands in links. The best container is kept with
those of its siblings that score well or are plain paragraphs, and inside them every block
that is not part of a menu, header, footer, side bar, notice, advert, form or comment.
Class names and ids tell clutter only where the element does not hold the page's articles
or most of its points, and not at all on a page that would have no text by them. Links
weigh in the choice of containers only. A heading of comments silences what follows it up
to the next heading of its level.

Pages are independent rows, read whole. A null page gives an empty text; so does a page
without text. Null ids and repeated rows pass through; an empty table gives no rows.
"""

from __future__ import annotations

import html
import re
from collections import defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from tamperlens.functions.columns import quoted

#: fixed values: element names by their part in a page
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = set("script style title textarea noscript iframe template xmp noembed noframes svg math".split())
BLOCKS = set(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption "
    "figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre "
    "section select summary table tbody td tfoot th thead tr ul".split()
)
CLUTTER = set(
    "nav footer aside form button select option dialog menu fieldset head label datalist object canvas audio video".split()
)
CLUTTER_ROLES = set("navigation banner contentinfo complementary search alert alertdialog dialog menu menubar form".split())
#: fixed values: parts of class names and ids
CLUTTER_NAMES = set(
    "ad ads adv advert adverts advertisement advertising adsense adslot banner sponsor sponsored promo promotion "
    "sidebar side aside rail nav navbar navigation menu menubar footer foot masthead topbar header breadcrumb "
    "breadcrumbs comment comments commentlist disqus reply replies respond responses discussion cookie cookies "
    "consent gdpr notice notices notification alert popup modal overlay newsletter subscribe subscription signup "
    "share sharing social related recommended recommendations pagination pager toolbar widget login search skip "
    "hidden copyright legal paywall outbrain taboola form".split()
)
#: of these, the ones of readers' texts, which can be longer than the article and hold articles of their own
COMMENT_NAMES = set(
    "comment comments commentlist disqus reply replies respond responses discussion".split()
)
GOOD_NAMES = set("article body content entry main post text story page blog hentry".split())
CLOSED_BY_BLOCK = "p"
LEAST_POINTS = 2  # about a paragraph of text
FARTHEST = 8  # points have faded to a twenty-fourth there
SAME_LEVEL = {
    "li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"),
    "th": ("td", "th"), "option": ("option",),
}
SCOPES = set("ul ol dl table select body html article section div td th".split())
COMMENT_HEADING = re.compile(
    r"^(?:\d+\s+)?(?:reader\s+)?(?:comments?|kommentare?|commentaires?|comentarios?|responses|replies|leave a reply)"
    r"\s*(?:\(\d+\)|:|\d+)?$", re.I
)
TAG = re.compile(
    r"<(?:!--.*?(?:-->|\Z)|[!?][^>]*+>|(/?)([a-zA-Z][a-zA-Z0-9:-]*+)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>)", re.S
)
#: what begins a tag; and tags of pages with a quote that no tag closes: a tag ends at the next ">"
MARK = re.compile(r"</?[a-zA-Z]|<[!?]")
LOOSE_TAG = re.compile(r"<(?:!--.*?(?:-->|\Z)|[!?][^>]*+>|(/?)([a-zA-Z][a-zA-Z0-9:-]*+)([^>]*+)>)", re.S)
ATTRIBUTE = re.compile(r"""([a-zA-Z_:-]+)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))|\b(hidden)\b""")
NAME_PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
TEXT = "page_id bigint, url string, text string"


class Node:
    __slots__ = (
        "parent", "tag", "clutter", "hard", "names", "weight", "points", "scored", "chars", "linked", "kids", "inside",
        "worth", "largest", "above", "at", "last",
    )

    def __init__(self, parent, tag, clutter, weight, hard=False, names=frozenset()):
        self.parent, self.tag, self.clutter, self.weight = parent, tag, clutter, weight
        self.hard, self.names = hard, names  # clutter by tag, role or style; own clutter names
        self.points, self.scored, self.chars, self.linked, self.kids = 0.0, False, 0, 0, []
        self.inside = False
        self.worth, self.largest, self.above = 0.0, 0.0, False
        self.at = self.last = 0  # own place among the nodes, and that of the last one below
        if parent is not None:
            parent.kids.append(self)


def _judged(tag: str, raw: str, parent: Node, inside: bool) -> tuple[bool, frozenset | set, float]:
    """(clutter by all but names, clutter names, class weight) of an element from its tag and attributes.

    ``inside``: an article or main is open (asked of headers only).
    """
    clutter, names = parent.hard or tag in CLUTTER or tag == "header" and not inside, frozenset()
    weight = 25.0 if tag in ("article", "main") else 0.0
    if "=" not in raw and "hidden" not in raw:
        return clutter, names, weight
    for name, a, b, c, bare in ATTRIBUTE.findall(raw):
        name, value = name.lower(), a or b or c
        if bare or (name == "aria-hidden" and value == "true"):
            clutter = True
        elif name == "role" and value.lower() in CLUTTER_ROLES:
            clutter = True
        elif name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I):
            clutter = True
        elif name in ("class", "id") and tag not in ("html", "body", "article", "main"):
            parts = {p.lower() for p in NAME_PART.findall(value)}
            if parts & GOOD_NAMES:
                weight += 25
            if parts & CLUTTER_NAMES and not ("header" in parts and parts & {"article", "post", "entry"}):
                names = names | parts & CLUTTER_NAMES
    return clutter, names, weight


class Page:
    """Blocks (owner, text, characters in links) of a page in order.

    Open elements are known by name and place, so a tag costs the same however deep it
    stands, and the work grows with the page's length on any input.
    """

    def __init__(self, source: str):
        self.root = Node(None, "#", False, 0.0)
        self.stack = [self.root]
        self.places: dict[str, list[int]] = defaultdict(list)  # depths of the open elements of a name
        self.block_at = [0]  # depth of the nearest block at or above each open element
        self.nodes = [self.root]  # parents before their children
        self.links = 0
        self.blocks: list[tuple[Node, str, int]] = []
        self.open: list[str] = []
        self.open_linked = 0
        self._read(source)

    def _flush(self) -> None:
        if self.open:
            text = " ".join(html.unescape("".join(self.open)).split())
            if text:
                self.blocks.append((self.stack[self.block_at[-1]], text, min(self.open_linked, len(text))))
            self.open, self.open_linked = [], 0

    def _text(self, text: str) -> None:
        self.open.append(text)
        if self.links:
            self.open_linked += len(text.strip())

    def _pop(self, depth: int) -> None:
        for node in reversed(self.stack[depth:]):
            self.places[node.tag].pop()
            if node.tag == "a":
                self.links -= 1
        del self.stack[depth:], self.block_at[depth:]

    def _nearest(self, names) -> int:
        """Depth of the nearest open element of these names; 0 if none is open."""
        return max((self.places[n][-1] for n in names if self.places.get(n)), default=0)

    def _close(self, names: tuple, scopes: set) -> None:
        """Close the nearest open element of ``names``, unless a scope comes first."""
        depth = self._nearest(names)
        if depth and depth > self._nearest(scopes):
            self._pop(depth)

    def _start(self, tag: str, raw: str) -> None:
        if tag in BLOCKS:
            self._flush()
            self._close((CLOSED_BY_BLOCK,), SCOPES)
            if tag in SAME_LEVEL:
                self._close(SAME_LEVEL[tag], SCOPES - set(SAME_LEVEL[tag]))
        if tag == "br":
            self.open.append(" ")
        if tag in VOID or raw.endswith("/") and tag not in BLOCKS:
            return
        parent = self.stack[-1]
        inside = tag == "header" and self._nearest(("article", "main")) > 0
        hard, names, weight = _judged(tag, raw, parent, inside)
        clutter = parent.clutter or hard or bool(names)
        if clutter != parent.clutter:
            self._flush()
        if tag == "a":
            self.links += 1
        self.places[tag].append(len(self.stack))
        self.block_at.append(len(self.stack) if tag in BLOCKS else self.block_at[-1])
        self.stack.append(Node(parent, tag, clutter, weight, hard, names))
        self.nodes.append(self.stack[-1])

    def _end(self, tag: str) -> None:
        if tag in BLOCKS:
            self._flush()
        depth = self._nearest((tag,))
        # a stray inline end tag closes no block
        if not depth or tag not in BLOCKS and depth < self.block_at[-1]:
            return
        if self.stack[depth].clutter != self.stack[depth - 1].clutter:
            self._flush()
        self._pop(depth)

    def _read(self, source: str) -> None:
        at, looked, last, tag_at = 0, 0, source.rfind(">"), TAG
        while True:
            begin = source.find("<", looked)
            found = tag_at.match(source, begin) if begin >= 0 else None
            if begin >= 0 and found is None and MARK.match(source, begin):
                if begin < last:  # a quote runs to the end of the page: from here on quotes count no more
                    tag_at = LOOSE_TAG
                    found = tag_at.match(source, begin)
                else:
                    begin = -1  # no tag ends any more
            if begin < 0:
                self._text(source[at:])
                break
            if found is None:
                looked = begin + 1
                continue
            if found.start() > at:
                self._text(source[at : found.start()])
            looked = found.end()
            at = found.end()
            if found[2] is None:
                continue
            tag = found[2].lower()
            if found[1]:
                self._end(tag)
            elif tag in RAW and not found[3].endswith("/"):
                end = re.compile(rf"</{re.escape(tag)}\b[^>]*>", re.I).search(source, at)
                at = looked = end.end() if end else len(source)
            else:
                self._start(tag, found[3])
        self._flush()


def _points(owner: Node, text: str) -> float:
    points = 1 + text.count(",") + min(len(text) / 100, 3)
    if owner.tag in ("h1", "h2", "h3", "h4", "h5", "h6", "li", "th", "dt"):
        points = min(points, 1) / 2
    return points


def _settle(page: Page, by_name: bool) -> None:
    """Decide what is clutter; a name alone does not cut what holds the content of the page.

    Readers' texts count as content only on a page with next to nothing else.
    """
    nodes = page.nodes
    for node in nodes[1:]:
        node.clutter = node.parent.clutter or node.hard
        node.above = node.parent.above or bool(node.parent.names & COMMENT_NAMES)
    if not by_name or not any(n.names for n in nodes):
        return
    visible = [(owner, _points(owner, text), linked / len(text)) for owner, text, linked in page.blocks if not owner.hard]
    for owner, points, links in visible:
        owner.worth += points * (1 - links)
    for node in reversed(nodes[1:]):
        node.parent.worth += node.worth
    for readers in (False, True):
        for node in nodes:
            content = node.tag == "main" or node.tag == "article" and (readers or not node.above)
            node.largest = node.worth if content and not node.hard else 0.0
        for node in reversed(nodes[1:]):
            node.parent.largest = max(node.parent.largest, node.largest)
        total, largest = page.root.worth, page.root.largest
        for node in nodes[1:]:
            holds = 0 < largest <= 2 * node.largest or node.worth > 0.5 * total
            if not readers and node.names & COMMENT_NAMES:
                holds = holds and node.largest > 0
            node.clutter = node.parent.clutter or node.hard or bool(node.names) and not holds
        if largest or sum(points for owner, points, _ in visible if points >= 1 and not owner.clutter) >= LEAST_POINTS:
            return


def _score(nodes: list[Node], blocks: list[tuple[Node, str, int]]) -> list[Node]:
    """Give points to ancestors and sum their text; returns the containers with points."""
    for owner, text, linked in blocks:
        owner.chars += len(text)
        owner.linked += linked
        points = _points(owner, text)
        # the block itself is a container only where text stands in it directly
        level = 1 if owner.tag in ("p", "pre", "li", "h1", "h2", "h3") else 0
        node = owner.parent if level else owner
        while node is not None and node.parent is not None and level <= FARTHEST:
            node.scored = True
            node.points += points / (level if 0 < level < 3 else max(3 * level, 1))
            node, level = node.parent, level + 1
    for node in reversed(nodes[1:]):
        node.parent.chars += node.chars
        node.parent.linked += node.linked
    for node in nodes[1:]:
        if node.scored:
            node.points += node.weight
    return [n for n in nodes if n.scored]


def _value(node: Node) -> float:
    return node.points * (1 - node.linked / node.chars) if node.chars else 0.0


def main_text(source: str | None) -> str:
    """Text blocks of the article of a page, joined by an empty line."""
    page = Page(source or "")
    _settle(page, by_name=True)
    if not any(not owner.clutter for owner, _, _ in page.blocks):
        _settle(page, by_name=False)
    blocks = [b for b in page.blocks if not b[0].clutter]
    if not blocks:
        return ""
    containers = _score(page.nodes, blocks)
    if not containers:
        return "\n\n".join(text for _, text, _ in blocks)
    best = max(containers, key=_value)  # the first of equals
    lift = best
    while lift is not None and lift.tag not in ("article", "main"):
        lift = lift.parent
    best = lift or best
    kept = {id(best)}
    for sibling in best.parent.kids if best.parent else ():
        if sibling.clutter or sibling is best:
            continue
        if best.tag == "main" or not sibling.chars:
            continue
        density = sibling.linked / sibling.chars
        plain = sibling.tag == "p" and density < 0.25 and (sibling.chars > 80 or density == 0)
        heading = sibling.tag in ("h1", "h2", "h3") and density == 0 and best.tag != "article"
        if plain or heading or (density < 0.5 and _value(sibling) >= max(10.0, 0.2 * _value(best))):
            kept.add(id(sibling))
    for at, node in enumerate(page.nodes):
        node.at = node.last = at
    for node in reversed(page.nodes[1:]):
        node.parent.last = max(node.parent.last, node.last)
    for node in page.nodes:
        node.inside = id(node) in kept or node.parent is not None and node.parent.inside
    out: list[str] = []
    silenced: dict[int, Node] = {}  # level of a heading of comments: its parent
    for owner, text, _ in blocks:
        if not owner.inside:
            continue
        level = int(owner.tag[1:]) if owner.tag[0] == "h" and owner.tag[1:].isdigit() else 0
        if level:
            silenced = {k: v for k, v in silenced.items() if k < level}
        if any(above.at <= owner.at <= above.last for above in silenced.values()):
            continue
        if level and COMMENT_HEADING.match(text):
            silenced[level] = owner.parent
            continue
        out.append(text)
    return "\n\n".join(out)


def extract_text(
    pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html"
) -> DataFrame:
    """Rows (page_id, url, text), one for each page."""

    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for frame in frames:
            texts = [main_text(x.as_py()) for x in frame.column(2)]
            yield pa.RecordBatch.from_arrays(
                [frame.column(0), frame.column(1), pa.array(texts, pa.string())], names=["page_id", "url", "text"]
            )

    return pages.selectExpr(
        f"CAST({quoted(id_col)} AS BIGINT) AS page_id",
        f"CAST({quoted(url_col)} AS STRING) AS url",
        f"CAST({quoted(html_col)} AS STRING) AS html",
    ).mapInArrow(run, TEXT)
