"""Tolerant page tree on the standard library's tokenizer, and the node rows taken from it."""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser

# Elements without content, elements whose text is not page text, headings, and date attributes.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr basefont bgsound command frame image isindex nextid spacer".split())
SILENT = frozenset(("script", "style", "template", "rp", "rt"))
HEADINGS = ("h2", "h3", "h4")
DATE_ATTRIBUTES = ("datetime", "data-date", "data-published", "data-published-at", "data-ga4-analytics-lead-click")
_DATES = (
    re.compile(r"\b20\d{2}[-/]\d{1,2}[-/]\d{1,2}\b"),
    re.compile(r"\b(?:Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec)[a-z]*\s+\d{1,2},\s+20\d{2}\b", re.IGNORECASE),
)
# the rules show this much of the surrounding text
SHOWN = 220
# A date with text behind it (mail form) has six words at most, any other must be the whole text and has three: the words
# which follow cannot change what is read.
_DATE_WORDS = 7


def date_in(text: str) -> str | None:
    for pattern in _DATES:
        found = pattern.search(text)
        if found:
            return found.group(0)
    return None


class Node:
    __slots__ = ("tag", "attrs", "parent", "children", "pos", "first_time", "_text", "_date", "_elements", "_at")

    def __init__(self, tag, attrs, parent, pos):
        self.tag, self.attrs, self.parent, self.pos = tag, attrs, parent, pos
        self.children: list = []
        self.first_time = self._text = self._date = self._elements = self._at = None

    def walk(self) -> Iterator["Node"]:
        """Elements below, in document order; no recursion, so depth is no limit."""
        stack = [c for c in reversed(self.children) if isinstance(c, Node)]
        while stack:
            node = stack.pop()
            yield node
            stack.extend(c for c in reversed(node.children) if isinstance(c, Node))

    def find(self, tag: str, test=None) -> "Node | None":
        return next((n for n in self.walk() if n.tag == tag and (test is None or test(n))), None)

    @property
    def text(self) -> str:
        if self._text is None:
            parts, stack = [], list(reversed(self.children))
            while stack:
                child = stack.pop()
                if isinstance(child, str):
                    piece = child.strip()
                    if piece:
                        parts.append(piece)
                elif child.tag not in SILENT:
                    stack.extend(reversed(child.children))
            self._text = " ".join(parts)
        return self._text

    @property
    def date(self) -> str | None:
        if self._date is None:
            self._date = (date_in(self.text),)
        return self._date[0]

    @property
    def elements(self) -> list["Node"]:
        if self._elements is None:
            self._elements = [c for c in self.children if isinstance(c, Node)]
            for i, child in enumerate(self._elements):
                child._at = i
        return self._elements

    def later_siblings(self, most: int) -> list["Node"]:
        siblings = self.parent.elements
        return siblings[self._at + 1 : self._at + 1 + most]


class _Builder(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = Node("[document]", {}, None, 0)
        self.open = [self.root]
        self.count = 0
        self.joinable = False
        self.nodes: list[Node] = []

    def updatepos(self, i, j):
        return j  # nobody asks for lines and columns

    def handle_starttag(self, tag, attrs):
        self.count += 1
        values: dict[str, str] = {}
        for name, value in attrs:
            values[name] = value or ""
        node = Node(tag, values, self.open[-1], self.count)
        self.open[-1].children.append(node)
        self.nodes.append(node)
        self.joinable = False
        if tag not in VOID:
            self.open.append(node)

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.open.pop()

    def handle_endtag(self, tag):
        self.joinable = False
        for depth in range(len(self.open) - 1, 0, -1):
            if self.open[depth].tag == tag:
                del self.open[depth:]
                return

    def handle_data(self, data):
        top = self.open[-1].children
        if self.joinable and top and isinstance(top[-1], str):
            top[-1] += data
        else:
            top.append(data)
        self.joinable = True

    def handle_comment(self, data):
        self.joinable = False


def build(html: str) -> Node:
    builder = _Builder()
    builder.feed(html)
    builder.close()
    # from the last element to the first: what is found earlier in the page replaces what was found later
    for node in reversed(builder.nodes):
        found = node if node.tag == "time" else node.first_time
        if found is not None:
            node.parent.first_time = found
    return builder.root


def _near(node: Node) -> list[tuple]:
    """Date candidates of a node and its next three ancestors."""
    out = []
    at: Node | None = node
    for _ in range(4):
        if at is None:
            break
        values = [at.attrs[a] for a in DATE_ATTRIBUTES if at.attrs.get(a)]
        for name, value in at.attrs.items():
            values.extend(value.split() if name == "class" else [value])
        time = at.first_time
        out.append((values, time.attrs.get("datetime") if time else None, time.text if time else None, at.date))
        at = at.parent
    return out


def _heading(node: Node, cache: dict[int, tuple]) -> tuple:
    if node.pos not in cache:
        dates = []
        for sibling in node.later_siblings(3):
            if sibling.tag in HEADINGS:
                break
            dates.append(sibling.date or " ".join(sibling.text.split(None, _DATE_WORDS)[:_DATE_WORDS]))
        cache[node.pos] = (node.pos, node.attrs.get("id"), node.text, dates)
    return cache[node.pos]


def _sections(root: Node) -> Iterator[tuple[Node, Node]]:
    """(heading, element) for the siblings which follow a heading up to the next one."""
    for parent in [root, *root.walk()]:
        heading = None
        for child in parent.children:
            if isinstance(child, Node):
                if child.tag in HEADINGS:
                    heading = child
                elif heading is not None:
                    yield heading, child


def _link(node: Node | None) -> str | None:
    found = node.find("a", lambda n: "href" in n.attrs) if node is not None else None
    return found.attrs["href"] if found is not None else None


def _card(grid: Node) -> tuple | None:
    parts = [c for c in grid.children if isinstance(c, Node) and c.tag == "div"]
    if len(parts) < 2:
        return None
    badge = parts[0].find("div", lambda n: n.attrs.get("data-variant") == "outline")
    content = parts[1]
    labels = [n.text for n in content.walk() if n.tag == "div" and n.attrs.get("data-variant") == "soft" and n.text]
    body = content.find("div", lambda n: "ChangelogMarkdown" in n.attrs.get("class", "")) or content
    return badge.text if badge else "", labels, body.text, _link(body)


def page_nodes(html: str, kinds: tuple[str, ...]) -> list[tuple]:
    """Rows (pos, kind, text, href, near, parent_text, previous_heading, heading, badge, tags) of one page."""
    root = build(html)
    rows: list[tuple] = []
    cache: dict[int, tuple] = {}
    if "page" in kinds:
        rows.append((0, "page", root.text, None, None, None, None, None, None, None))
    if "a" in kinds or "card" in kinds:
        previous = None
        for node in root.walk():
            if node.tag == "a" and "a" in kinds and "href" in node.attrs:
                before = previous.text if previous is not None else None
                rows.append((node.pos, "a", node.text, node.attrs["href"], _near(node), node.parent.text[:SHOWN], before, None, None, None))
            elif node.tag == "div" and "card" in kinds and "grid-cols-[3rem_1fr]" in node.attrs.get("class", ""):
                card = _card(node)
                if card:
                    rows.append((node.pos, "card", card[2], card[3], None, None, None, None, card[0], card[1]))
            if node.tag in HEADINGS:
                previous = node
    if "li" in kinds or "p" in kinds:
        for heading, element in _sections(root):
            if element.tag in ("ul", "ol") and "li" in kinds:
                for li in (n for n in element.walk() if n.tag == "li"):
                    rows.append((li.pos, "li", li.text, _link(li), None, None, None, _heading(heading, cache), None, None))
            elif element.tag == "p" and "p" in kinds:
                rows.append((element.pos, "p", element.text, None, None, None, None, _heading(heading, cache), None, None))
    return rows
