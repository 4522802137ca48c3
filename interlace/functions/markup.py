"""A tree from markup that may be malformed, selectors over it, tables as grids, and sections by heading."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from html.parser import HTMLParser

# Fixed values of the markup language: elements without content, whose text is no text, that stand on lines of their own,
# and elements that end when another of the given kind begins beside them.
VOID = set("area base br col embed hr img input link meta source track wbr".split())
UNSEEN = {"script", "style", "template"}
BLOCKS = set("address article aside body br dd div dl dt fieldset footer form h1 h2 h3 h4 h5 h6 header hr li main nav ol p pre section table tbody tfoot thead tr ul".split())
ENDED_BY = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "td": {"td", "th", "tr", "tbody"}, "th": {"td", "th", "tr", "tbody"}, "tr": {"tr", "tbody"}, "option": {"option"}, "p": BLOCKS - {"br"}}
#: Elements out of which an implied end never reaches.
WALLS = {"table", "ul", "ol", "dl", "body", "html", "article", "section", "div"}
HEADINGS = ("h1", "h2", "h3", "h4", "h5", "h6")
#: Greatest spans of a cell.
WIDEST, TALLEST = 1000, 65534


class Node:
    """An element: its tag, attributes, parent, and its texts and elements in order."""

    __slots__ = ("tag", "attrs", "parent", "items")

    def __init__(self, tag: str, attrs: dict[str, str], parent: Node | None) -> None:
        self.tag, self.attrs, self.parent, self.items = tag, attrs, parent, []

    def events(self) -> Iterator[tuple[str, Node | str]]:
        """("start", element), ("text", text) and ("end", element) for all below this one, in document order."""
        rest: list = list(reversed(self.items))
        while rest:
            item = rest.pop()
            if isinstance(item, str):
                yield "text", item
            elif isinstance(item, tuple):
                yield "end", item[0]
            else:
                yield "start", item
                rest.append((item,))
                rest.extend(reversed(item.items) if item.tag not in UNSEEN else ())

    def text(self) -> str:
        """The text inside: a line for each block, cells apart, blanks collapsed."""
        return lines_of(x if kind == "text" else edge(kind, x) for kind, x in self.events())

    def select(self, selector: str) -> list[Node]:
        """The elements below that the selector names, in document order."""
        ways = compiled(selector)
        return [n for kind, n in self.events() if kind == "start" and any(fits(n, way) for way in ways)]

    def closest(self, selector: str) -> Node | None:
        """This element or the nearest one around it that the selector names."""
        ways, node = compiled(selector), self
        while node is not None and not any(fits(node, way) for way in ways):
            node = node.parent
        return node


def edge(kind: str, node: Node) -> str:
    """What the beginning or end of an element is in the text around it."""
    return "\n" if node.tag in BLOCKS else " " if kind == "end" and node.tag in ("td", "th") else ""


def lines_of(parts: Iterator[str]) -> str:
    """The parts together, without empty lines and with single blanks."""
    return "\n".join(line for x in "".join(parts).split("\n") if (line := " ".join(x.split())))


class _Builder(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.root = self.at = Node("", {}, None)

    def handle_starttag(self, tag, attrs):
        node = self.at
        while node.parent is not None:  # what the new element ends, and all inside it
            if tag in ENDED_BY.get(node.tag, ()):
                self.at = node.parent
            if node.tag in WALLS:
                break
            node = node.parent
        new = Node(tag, {k: v or "" for k, v in attrs}, self.at)
        self.at.items.append(new)
        if tag not in VOID:
            self.at = new

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)

    def handle_endtag(self, tag):
        node = self.at
        while node.parent is not None and node.tag != tag:
            node = node.parent
        if node.parent is not None:  # an end without a beginning is ignored
            self.at = node.parent

    def handle_data(self, data):
        self.at.items.append(" ".join(data.split("\n")))  # a line of the source is no line of the text


def tree(markup: str | None) -> Node:
    """The tree of a text; elements that are never closed end with what is around them. Null has no elements."""
    builder = _Builder()
    builder.feed(markup or "")
    builder.close()
    return builder.root


_SIMPLE = re.compile(r"""([\w-]+|\*)|\.([\w-]+)|\[([\w-]+)(?:([*^$~]?=)["']?([^"'\]]*)["']?)?\]""")
_SELECTORS: dict[str, list] = {}


def compiled(selector: str) -> list[list[tuple[str, list]]]:
    """For each alternative between commas the steps from the last to the first: the sign before it, and its tests."""
    if selector not in _SELECTORS:
        ways = []
        for way in re.split(r",(?![^\[]*\])", selector):
            parts = re.findall(r"[>+~]|(?:[^\s>+~\[]|\[[^\]]*\])+", way)
            steps, sign = [], ""
            for part in parts:
                if part in (">", "+", "~"):
                    sign = part
                else:
                    steps.append((sign or " ", _SIMPLE.findall(part)))
                    sign = ""
            ways.append(steps[::-1])
        _SELECTORS[selector] = ways
    return _SELECTORS[selector]


def _is(node: Node, tests: list) -> bool:
    for tag, kind, name, sign, value in tests:
        if tag and tag not in ("*", node.tag) or kind and kind not in node.attrs.get("class", "").split():
            return False
        if name:
            own = node.attrs.get(name)
            if own is None:
                return False
            if sign and not {"=": own == value, "*=": value in own, "^=": own.startswith(value), "$=": own.endswith(value), "~=": value in own.split()}[sign]:
                return False
    return bool(node.tag)


def fits(node: Node, steps: list) -> bool:
    """Whether an element is the last step of a way whose other steps lie around or before it."""
    if not _is(node, steps[0][1]):
        return False
    if len(steps) == 1:
        return True
    sign, rest = steps[0][0], steps[1:]
    if sign in "+~":
        before = [n for n in node.parent.items if isinstance(n, Node)] if node.parent else []
        before = before[: next((i for i, n in enumerate(before) if n is node), 0)]
        return any(fits(n, rest) for n in (before[-1:] if sign == "+" else before))
    around = node.parent
    while around is not None:
        if fits(around, rest):
            return True
        if sign == ">":
            return False
        around = around.parent
    return False


def grid(table: Node) -> list[list[tuple[str, bool]]]:
    """The cells of a table by row and column, each its text and whether it is a heading; spans repeat a cell."""
    rows = [r for r in table.select("tr") if r.closest("table") is table]
    places: dict[tuple[int, int], tuple[str, bool]] = {}
    for i, row in enumerate(rows):
        j = 0
        for cell in (c for c in row.items if isinstance(c, Node) and c.tag in ("td", "th")):
            while (i, j) in places:
                j += 1
            span = lambda name, most: min(max(int(m.group()) if (m := re.match(r"\d{1,9}", cell.attrs.get(name, ""))) else 1, 1), most)  # noqa: B023, E731
            wide, tall = span("colspan", WIDEST), min(span("rowspan", TALLEST), len(rows) - i)
            what = (cell.text(), cell.tag == "th")
            places.update({(i + a, j + b): what for a in range(tall) for b in range(wide)})
            j += wide
    width = Counter()
    for i, j in places:
        width[i] = max(width[i], j + 1)
    return [[places.get((i, j), ("", False)) for j in range(width[i])] for i in range(len(rows))]


def table_map(table: Node) -> dict[str, str]:
    """A table as a map: the headings of a row (or its first cell) and what stands beside them. Under a first row of headings
    alone, several cells of a row are told apart by the headings of their columns. The first of equal keys stays."""
    rows, out = grid(table), {}
    above = [text for text, _ in rows.pop(0)] if len(rows) > 1 and rows[0] and all(h for _, h in rows[0]) else []
    joined = lambda texts: " ".join(dict.fromkeys(t for t in texts if t))
    for row in rows:
        labels = [j for j, (_, heading) in enumerate(row) if heading] or [0]
        values = [j for j in range(len(row)) if j not in labels]
        label = joined(row[j][0] for j in labels if j < len(row))
        if above and len(values) > 1:
            found = [(joined([label, *above[j : j + 1]]), row[j][0]) for j in values]
        else:
            found = [(label, joined(row[j][0] for j in values))]
        for key, value in found:
            if key and value:
                out.setdefault(key, value)
    return out


def sections(root: Node) -> dict[str, str]:
    """The text after each heading, up to the next heading of any level; equal headings share one entry."""
    out: dict[str, list[str]] = {}
    heading, open_ = None, None
    for kind, item in root.events():
        if open_ is not None:
            if kind == "end" and item is open_:
                heading, open_ = item.text(), None
                out.setdefault(heading, []).append("\n")
        elif kind == "start" and item.tag in HEADINGS:
            open_ = item
        elif heading is not None:
            out[heading].append(item if kind == "text" else edge(kind, item))
    return {h: lines_of(parts) for h, parts in out.items() if h}
