"""Visible text of web pages: a tree with implied tags, visibility rules, and a layout of blocks, lists and tables."""

from __future__ import annotations

import html
import re
from bisect import bisect_right

from pyspark.sql import DataFrame

from .common import map_rows

# Tag classes of the markup language.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
HIDDEN = frozenset("head script style template noscript title meta link base datalist iframe noembed noframes object svg canvas audio video".split())
BLOCK = frozenset("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre search section summary table tbody td tfoot th thead tr ul caption".split())
SPACED = frozenset("blockquote dl figure h1 h2 h3 h4 h5 h6 ol p pre table ul menu dir".split())
LISTS = frozenset("ul ol menu dir".split())
BOXES = frozenset("li dd blockquote td th caption".split())
# An opening tag ends open ones of these names, up to a tag that bounds the search.
ENDS = {
    "li": ({"li"}, LISTS), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "option": ({"option"}, {"select", "datalist"}), "optgroup": ({"option", "optgroup"}, {"select"}),
    "tr": ({"tr", "td", "th", "caption"}, {"table"}), "td": ({"td", "th"}, {"table", "tr"}), "th": ({"td", "th"}, {"table", "tr"}), "caption": ({"caption"}, {"table"}),
    "tbody": ({"tbody", "thead", "tfoot", "tr", "td", "th", "caption"}, {"table"}), "thead": ({"tbody", "thead", "tfoot", "tr", "td", "th", "caption"}, {"table"}), "tfoot": ({"tbody", "thead", "tfoot", "tr", "td", "th", "caption"}, {"table"}), "body": ({"head"}, {"html"}),
}
CLOSES_P = BLOCK - frozenset("html body tr td th tbody thead tfoot caption option optgroup legend".split())
HEAD_ONLY = frozenset("head title meta link base script style template noscript html".split())

NAME = re.compile(r"[a-zA-Z][^\s/>]*")
STOP = re.compile("[>\"']")
RAW_END = {tag: re.compile(f"</{tag}[\\s/>]", re.I) for tag in RAW}
DEPTH = 50  #: lists, quotes and cells nested deeper are laid out as plain blocks
ATTR = re.compile(r"([^\s=/>\"']+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")
CONCEALED = re.compile(r"display\s*:\s*none|visibility\s*:\s*(?:hidden|collapse)", re.I)
SPACE = re.compile(r"[ \t\n\r\f]+")


class Node:
    __slots__ = ("tag", "attrs", "kids")

    def __init__(self, tag: str, attrs: str = ""):
        self.tag, self.attrs, self.kids = tag, attrs, []

    def attr(self, name: str):
        for k, *v in ATTR.findall(self.attrs):
            if k.lower() == name:
                return html.unescape(v[0] or v[1] or v[2])
        return None


class Scanner:
    """Texts and tags of a page in order, in one scan; ``at`` is where it goes on."""

    def __init__(self, page: str):
        self.page, self.at, self.last = page, 0, page.rfind(">")
        self.quotes = {q: page.rfind(q) for q in "\"'"}

    def __iter__(self):
        """(text, None, None) or (None, name, attributes); the name of an end tag starts with a slash.

        A ``<`` that starts no tag, or after which no ``>`` comes, is text.
        """
        page, n = self.page, len(self.page)
        while self.at < n:
            at = self.at
            mark = page[at + 1 : at + 2]
            if page[at] != "<":
                end = page.find("<", at)
                self.at = n if end < 0 else end
                yield page[at : self.at], None, None
            elif page.startswith("<!--", at):
                end = page.find("-->", at + 4)
                self.at = n if end < 0 else end + 3
            elif mark in ("!", "?") and at < self.last:
                self.at = page.find(">", at) + 1
            elif at > self.last or (m := NAME.match(page, at + 1 + (mark == "/"))) is None or m.end() > self.last:
                self.at = at + 1
                yield "<", None, None
            else:
                end = self._end(m.end())
                self.at = end + 1
                yield None, ("/" if mark == "/" else "") + m[0].lower(), page[m.end() : end]

    def _end(self, start: int) -> int:
        """The ``>`` that ends a tag. A quoted value may hold others; if its quote or then the tag never closes, the tag ends at its first
        ``>``. A page that ends inside a tag has its quotes ignored from there on, so no part of it is scanned again and again."""
        page, spot = self.page, start
        while stop := STOP.search(page, spot):
            at, q = stop.start(), stop[0]
            if q == ">":
                return at
            before = at - 1
            while page[before].isspace():
                before -= 1
            if page[before] != "=":
                spot = at + 1
            elif self.quotes[q] > at:
                spot = page.find(q, at + 1) + 1
            else:
                return page.find(">", start)
        self.quotes = dict.fromkeys(self.quotes, -1)
        return page.find(">", start)


class Stack:
    """Open elements, with the places at which each tag is open."""

    def __init__(self, root: Node):
        self.nodes, self.at = [root], {}

    def top(self) -> Node:
        return self.nodes[-1]

    def push(self, node: Node):
        self.at.setdefault(node.tag, []).append(len(self.nodes))
        self.nodes.append(node)

    def cut(self, k: int):
        """Close all elements from place ``k`` on."""
        while len(self.nodes) > k:
            self.at[self.nodes.pop().tag].pop()

    def place(self, *tags: str) -> int:
        """The innermost place of any of the tags; 0 if none is open."""
        return max([places[-1] for t in tags if (places := self.at.get(t))], default=0)

    def first_after(self, k: int, tags) -> int | None:
        """The outermost place beyond ``k`` of any of the tags."""
        found = [places[i] for t in tags if (places := self.at.get(t)) and (i := bisect_right(places, k)) < len(places)]
        return min(found, default=None)


def parse(page: str) -> Node:
    """The tree of a page. Missing ends are implied, stray ends ignored, and an end never reaches out of a table cell."""
    root = Node("html")
    stack = Stack(root)
    scan = Scanner(page)
    for text, tag, attrs in scan:
        if tag is None:
            if stack.top().tag == "head" and text.strip():
                stack.cut(len(stack.nodes) - 1)
            stack.top().kids.append(html.unescape(text) if "&" in text else text)
            continue
        if tag[0] == "/":
            tag = tag[1:]
            k = stack.place(tag)
            if k:
                if tag in ("table", "tr", "td", "th", "tbody", "thead", "tfoot") or stack.place("td", "th") <= k:
                    stack.cut(k)
            elif tag == "br":
                stack.top().kids.append(Node("br"))
            continue
        if tag == "html":
            continue
        if stack.top().tag == "head" and tag not in HEAD_ONLY:
            stack.cut(len(stack.nodes) - 1)
        if tag in CLOSES_P and (k := stack.place("p")) and stack.place("td", "th", "table", "button") <= k:
            stack.cut(k)
        if tag in ENDS:
            ends, bound = ENDS[tag]
            k = stack.first_after(stack.place(*bound), ends)
            if k is not None:
                stack.cut(k)
        node = Node(tag, attrs)
        stack.top().kids.append(node)
        if tag in RAW:
            e = RAW_END[tag].search(page, scan.at)
            body = page[scan.at : e.start()] if e else page[scan.at :]
            node.kids.append(html.unescape(body) if tag in ("textarea", "title") else body)
            scan.at = page.find(">", e.start()) + 1 or len(page) if e else len(page)
        elif tag not in VOID and not attrs.endswith("/"):
            stack.push(node)
    return root


def visible(node: Node) -> bool:
    if node.tag in HIDDEN:
        return False
    a = node.attrs
    if not a:
        return True
    low = a.lower()
    if "hidden" in low and (node.attr("hidden") is not None or node.tag == "input"):
        return False
    return not ("style" in low and CONCEALED.search(node.attr("style") or ""))


class Sheet:
    """Lines under construction: pending blanks and line breaks collapse as in a browser's layout."""

    def __init__(self):
        self.lines, self.line, self.gap, self.blank = [], [], 0, False

    def text(self, s: str, literal: bool = False):
        if literal:
            for i, part in enumerate(s.split("\n")):
                if i:
                    self.end(1, force=True)
                if part:
                    self._start()
                    self.line.append(part)
            return
        s = SPACE.sub(" ", s)
        if s[:1] == " ":
            self.blank = bool(self.line)
            s = s[1:]
        if s:
            if s[-1] == " ":
                s, after = s[:-1], True
            else:
                after = False
            if s:
                self._start()
                self.line.append((" " if self.blank else "") + s)
            self.blank = after and bool(self.line)

    def _start(self):
        if not self.line and self.gap and self.lines:
            self.lines += [""] * (self.gap - 1)
        self.gap = 0

    def end(self, gap: int = 1, force: bool = False):
        if self.line or force:
            if force and not self.line:
                self._start()
            self.lines.append("".join(self.line))
            self.line = []
        self.gap, self.blank = max(self.gap, gap), False

    def put(self, lines: list[str], gap: int):
        """Finished lines as a block of their own."""
        self.end(gap)
        if lines:
            self._start()
            self.lines += lines
            self.gap = gap

    def done(self) -> list[str]:
        self.end(0)
        return self.lines


def _table(rows: list[list[tuple[list[str], int, int]]]) -> list[str]:
    """Cells as aligned columns, two blanks apart; a cell that spans columns widens none of them, and one that spans rows keeps
    its columns in them. A cell spans at most as many columns as the longest row has cells."""
    most = max(map(len, rows), default=1)
    taken: dict[int, int] = {}  # column -> rows for which a cell above still holds it
    grid, wide = [], []
    for row in rows:
        c, placed, held = 0, [], {k: n - 1 for k, n in taken.items() if n > 1}
        for lines, span, down in row:
            while c in taken:
                c += 1
            span = min(span, most)
            placed.append((c, lines, span))
            if down > 1:
                held |= dict.fromkeys(range(c, c + span), down - 1)
            wide += [0] * (c + span - len(wide))
            if span == 1:
                wide[c] = max(wide[c], *map(len, lines), 0) if lines else wide[c]
            c += span
        taken = held
        grid.append(placed)
    out = []
    for placed in grid:
        for k in range(max([1, *(len(lines) for _, lines, _ in placed)])):
            parts, at = [], 0
            for c, lines, span in placed:
                parts += ["".ljust(w) for w in wide[at:c]]
                parts.append((lines[k] if k < len(lines) else "").ljust(sum(wide[c : c + span]) + 2 * (span - 1)))
                at = c + span
            out.append("  ".join(parts).rstrip())
    return out


def render(root: Node) -> str:
    """The tree as text. Nested boxes (list items, cells, quotes) are laid out on sheets of their own; no recursion."""
    sheets, rows = [Sheet()], []
    pre, counters = 0, []
    work: list = [("in", root)]
    while work:
        step, node = work.pop()
        if isinstance(node, str):
            sheets[-1].text(node, pre > 0)
            continue
        tag = node.tag
        if step == "in":
            if not visible(node):
                continue
            s = sheets[-1]
            if tag in BOXES and len(sheets) > DEPTH:
                s.end(1)
                work += [("end", node)] + [("in", k) for k in reversed(node.kids)]
                continue
            if tag == "br":
                s.end(1, force=True)
                continue
            if tag == "hr":
                s.end(2)
                continue
            if tag in LISTS:
                counters.append(_number(node.attr("start"), 1) if tag == "ol" and node.attrs else (1 if tag == "ol" else None))
                s.end(1 if len(counters) > 1 else 2)
            elif tag == "table":
                s.end(2)
                rows.append([])
            elif tag == "tr":
                if rows:
                    rows[-1].append([])
            elif tag in BLOCK and tag not in ("li", "td", "th", "dd", "blockquote"):
                s.end(2 if tag in SPACED else 1)
            pre += tag in ("pre", "textarea")
            if tag in ("li", "dd", "blockquote") or (tag in ("td", "th", "caption") and rows):
                sheets.append(Sheet())
            work.append(("out", node))
            work += [("in", k) for k in reversed(node.kids)]
            continue
        if step == "end":
            sheets[-1].end(1)
            continue
        pre -= tag in ("pre", "textarea")
        if tag == "li":
            lines = sheets.pop().done()
            n = counters[-1] if counters else None
            if n is None:
                mark = "- "
            else:
                mark, counters[-1] = f"{n}. ", n + 1
            sheets[-1].put([mark + lines[0], *[x and " " * len(mark) + x for x in lines[1:]]] if lines else [], 1)
        elif tag in ("dd", "blockquote"):
            lines = sheets.pop().done()
            sheets[-1].put([x and "    " + x for x in lines], 2 if tag == "blockquote" else 1)
        elif tag in ("td", "th") and rows:
            if not rows[-1]:
                rows[-1].append([])
            span, down = (_number(node.attr(x) if node.attrs else None, 1) for x in ("colspan", "rowspan"))
            rows[-1][-1].append((sheets.pop().done(), max(1, span), down or 1 << 30))
        elif tag == "caption" and rows:
            lines = sheets.pop().done()
            sheets[-1].put(lines, 1)
        elif tag == "table":
            sheets[-1].put(_table([r for r in rows.pop() if r]), 2)
        elif tag in LISTS:
            counters.pop()
            sheets[-1].end(1 if counters else 2)
        elif tag in BLOCK:
            sheets[-1].end(2 if tag in SPACED else 1)
    return "\n".join(x.rstrip() for x in sheets[0].done()).strip("\n")


def _number(s, default: int) -> int:
    return int(s) if s and s.strip().isdigit() and len(s) < 9 else default


def extract(pages: DataFrame, html_col: str = "html", out: str = "text") -> DataFrame:
    """Every row with the visible text of its page in ``out``, which replaces a column of that name.

    Null and empty pages give an empty text; pages of any length are read whole, in time that grows with their length; broken markup
    is repaired, never refused; repeated rows give repeated texts; all other columns stay. Boxes nested deeper than
    ``DEPTH`` keep their text and lose their indentation.
    """

    def make():
        return lambda cells: [[render(parse(p)) if p else "" for p in cells.to_pylist()]]

    return map_rows(pages, [html_col], f"`{out}` string", make)
