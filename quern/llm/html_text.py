"""HTML extraction by layout: a tree with implied tags, visibility rules, and a renderer of blocks, lists and tables.

One pass over the source builds a tree; elements that need no end tag are closed
where HTML closes them. What a browser would not show is left out. The renderer
collapses white space within lines, breaks lines at blocks, sets blank lines
around paragraphs and the like, marks and indents list items, and pads the cells
of a table so that its columns stand in line.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

from quern.llm._spark import read, small_batches
from quern.llm._text import steps, with_columns

# What HTML says of elements (fixed values).
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = {"script", "style", "textarea", "title", "xmp", "noframes", "iframe", "noembed"}
HIDDEN = set("area base datalist head link meta noembed noframes noscript param rp script style template title iframe object audio video canvas svg".split())
SPACED = set("blockquote dl fieldset figure h1 h2 h3 h4 h5 h6 hr menu ol p pre table ul xmp".split())
BLOCKS = SPACED | set("address article aside body caption center dd details dialog dir div dt figcaption footer form header hgroup html legend li main nav optgroup option search section summary tbody td tfoot th thead tr".split())
CLOSES_P = BLOCKS - set("body html option optgroup caption td th tr tbody thead tfoot legend".split())
#: Opening the key closes an open element of the first set, unless one of the second stands between.
CLOSES = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "option": ({"option"}, {"select", "optgroup", "datalist"}),
    "optgroup": ({"option", "optgroup"}, {"select"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "tr": ({"tr", "td", "th"}, {"table"}),
    "tbody": ({"tbody", "thead", "tfoot", "tr", "td", "th", "caption", "colgroup"}, {"table"}),
    "thead": ({"tbody", "thead", "tfoot", "tr", "td", "th", "caption", "colgroup"}, {"table"}),
    "tfoot": ({"tbody", "thead", "tfoot", "tr", "td", "th", "caption", "colgroup"}, {"table"}),
    "body": ({"head"}, set()),
}
#: End tags of these reach no further out than the nearest table.
IN_TABLE = {"td", "th", "tr", "tbody", "thead", "tfoot", "caption"}

_SIMPLE = re.compile(r"<(/?)([a-zA-Z][^\s/><\"'=]*)([^<>\"']*)>")
_NAME = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)")
_ATTRIBUTE = re.compile(r"[\s/]*([^\s/>=\"'][^\s/>=]*)?(?:\s*=\s*)?")
_BARE = re.compile(r"[^\s>]*")
_SPACE = re.compile(r"[ \t\n\r\f]+")
#: The most columns and rows that HTML lets a cell span (fixed values).
MOST_COLUMNS, MOST_ROWS = 1000, 65534
#: A line of a cell that is longer does not widen its column; a line is padded by so many spaces at most, and indented by so many. Longer text is whole, but what stands beside it is not moved to its end.
WIDEST, PADDING, DEEPEST = 120, 400, 80


class Node:
    __slots__ = ("attributes", "children", "lines", "tag")

    def __init__(self, tag: str, attributes: dict[str, str]):
        self.tag, self.attributes, self.children = tag, attributes, []
        self.lines: list[str] = []  # of a table, once it is laid out


class Source:
    """Tokens of an HTML text, in time linear in its length."""

    def __init__(self, text: str):
        self.text, self.never = text, set()

    def find(self, what: str, at: int) -> int:
        """Like str.find, but a string that is not found is not sought again."""
        if what in self.never:
            return -1
        if (i := self.text.find(what, at)) < 0:
            self.never.add(what)
        return i

    def attributes(self, at: int) -> tuple[dict[str, str], int]:
        """From behind a tag's name: attributes, and the place behind the tag. An unclosed quote ends at the next '>'."""
        text, out = self.text, {}
        while at < len(text) and text[at] != ">":
            m = _ATTRIBUTE.match(text, at)
            name, after = (m[1] or "").lower(), m.end()
            value = ""
            if "=" in m[0][len(m[0].rstrip("= \t\n\r\f")) :]:
                quote = text[after : after + 1]
                if quote in ("'", '"') and quote:
                    stop = self.find(quote, after + 1)
                    if stop < 0:
                        stop = self.find(">", after)
                        stop = len(text) if stop < 0 else stop
                        value, after = text[after + 1 : stop], stop
                    else:
                        value, after = text[after + 1 : stop], stop + 1
                else:
                    bare = _BARE.match(text, after)
                    value, after = bare[0], bare.end()
            at = max(after, at + 1)
            if name:
                out.setdefault(name, html.unescape(value))
        return out, min(at + 1, len(text))

    def tokens(self) -> Iterator[tuple[str, str, dict[str, str]]]:
        """("text", ...), ("open", tag, attributes) or ("close", tag)."""
        text, at = self.text, 0
        while at < len(text):
            i = text.find("<", at)
            if i < 0:
                yield "text", text[at:], {}
                return
            if i > at:
                yield "text", text[at:i], {}
            if m := _SIMPLE.match(text, i):
                at, rest = m.end(), m[3].strip()
                found = self.attributes(m.end(2))[0] if rest and rest != "/" else {}
            elif m := _NAME.match(text, i):
                found, at = self.attributes(m.end())
            elif text.startswith("<!--", i):
                stop = self.find("-->", i + 4)
                at = len(text) if stop < 0 else stop + 3
                continue
            elif text[i + 1 : i + 2] in ("!", "?", "/") and i + 1 < len(text):
                stop = self.find(">", i)
                at = len(text) if stop < 0 else stop + 1
                continue
            else:
                yield "text", "<", {}
                at = i + 1
                continue
            tag = m[2].lower()
            if m[1]:
                yield "close", tag, {}
                continue
            yield "open", tag, found
            if tag in ("pre", "textarea", "listing"):  # a newline behind the tag does not count
                at += 2 if text.startswith("\r\n", at) else 1 if text.startswith("\n", at) else 0
            if tag in RAW:
                end = re.compile(rf"</{tag}(?=[\s/>])", re.I).search(text, at) if tag not in self.never else None
                if end is None:
                    self.never.add(tag)
                body = text[at : end.start() if end else len(text)]
                if tag == "textarea":
                    yield "text", body, {}
                at = end.start() if end else len(text)


def tree(text: str) -> Node:
    """The document as a tree. End tags without a start are passed over, but </p> and </br> stand for empty elements."""
    root = Node("html", {})
    open_nodes, opened = [root], {}

    def push(tag: str, attributes: dict[str, str]) -> None:
        node = Node(tag, attributes)
        open_nodes[-1].children.append(node)
        if tag not in VOID:
            open_nodes.append(node)
            opened[tag] = opened.get(tag, 0) + 1

    def pop_to(tags: set[str], barrier: set[str]) -> bool:
        """Closes the outermost open element of tags inside the barrier, with all within it."""
        if not any(opened.get(t) for t in tags):
            return False
        found = 0
        for i in range(len(open_nodes) - 1, 0, -1):
            if open_nodes[i].tag in barrier:
                break
            if open_nodes[i].tag in tags:
                found = i
                if len(tags) == 1:
                    break
        if not found:
            return False
        for node in open_nodes[found:]:
            opened[node.tag] -= 1
        del open_nodes[found:]
        return True

    for kind, what, attributes in Source(text).tokens():
        if kind == "text":
            open_nodes[-1].children.append(html.unescape(what))
        elif kind == "open":
            if what == "html" or what == "body" and opened.get("body"):
                open_nodes[0].attributes |= attributes if what == "html" else {}
                continue
            if what in CLOSES_P:
                pop_to({"p"}, {"table", "td", "th", "button", "caption"})
            if what in CLOSES:
                pop_to(*CLOSES[what])
            if what in ("td", "th") and open_nodes[-1].tag in ("table", "tbody", "thead", "tfoot"):
                push("tr", {})
            push(what, attributes)
        elif what == "br":
            push("br", {})
        elif what not in ("html", "body"):
            done = pop_to({what}, {"table"} - {what} if what in IN_TABLE else {"td", "th"} if what not in ("table", "tr", "tbody", "thead", "tfoot") else set())
            if what == "p" and not done:
                push("p", {})
                pop_to({"p"}, set())
    return root


def shown(node: Node, seen: bool) -> tuple[bool, bool]:
    """Whether an element takes part in the layout, and whether its text is visible."""
    a = node.attributes
    if node.tag in HIDDEN or "hidden" in a or node.tag == "input" and a.get("type", "").lower() not in ("submit", "button", "reset") or node.tag == "dialog" and "open" not in a:
        return False, False
    style = _SPACE.sub("", a.get("style", "").lower())
    if "display:none" in style:
        return False, False
    if "visibility:hidden" in style or "visibility:collapse" in style:
        seen = False
    elif "visibility:visible" in style:
        seen = True
    return True, seen


def children_of(node: Node) -> list:
    """What an element shows of its children: of closed details the first summary alone."""
    if node.tag == "details" and "open" not in node.attributes:
        return [c for c in node.children if isinstance(c, Node) and c.tag == "summary"][:1]
    return node.children


class Lines:
    """Finished lines and the parts of the line in the making."""

    def __init__(self):
        self.lines: list[str] = []
        self.line: list[str] = []
        self.gap, self.space, self.indent = 0, False, ""
        self.lead: str | None = None  # in place of the indent of the next line: the mark of a list item

    def text(self, s: str, as_is: bool) -> None:
        if as_is:
            for i, part in enumerate(s.replace("\r\n", "\n").split("\n")):
                if i:
                    self.end_line(True)
                self.add(part)
            return
        if not s:
            return
        core = s.strip(" \t\n\r\f")
        if s[0] in " \t\n\r\f":
            self.space = bool(self.line)
        if core:
            self.add((" " if self.space else "") + _SPACE.sub(" ", core))
            self.space = s[-1] in " \t\n\r\f"

    def add(self, s: str) -> None:
        if s:
            self.begin()
            self.line.append(s)
            self.space = False

    def begin(self) -> None:
        if not self.line:
            if self.lines:
                self.lines += [""] * self.gap
            self.gap = 0
            self.line, self.lead = [self.indent if self.lead is None else self.lead], None

    def end_line(self, forced: bool = False) -> None:
        line = "".join(self.line).rstrip()
        if line or forced:
            self.lines.append(line)
        self.line, self.space = [], False

    def block(self, gap: int) -> None:
        self.end_line()
        self.gap = max(self.gap, gap)

    def done(self) -> list[str]:
        self.end_line()
        while self.lines and not self.lines[-1]:
            self.lines.pop()
        return self.lines


def tables_of(nodes: list, seen: bool) -> list[tuple[Node, bool]]:
    """All tables that take part in the layout, outer before inner, with their visibility."""
    out, stack = [], [(n, seen) for n in reversed(nodes)]
    while stack:
        node, now = stack.pop()
        if isinstance(node, Node):
            here, now = shown(node, now)
            if here:
                if node.tag == "table":
                    out.append((node, now))
                stack += [(c, now) for c in reversed(children_of(node))]
    return out


def cells_of(table: Node, seen: bool) -> tuple[list[tuple[Node, bool]], list[list[tuple[Node, bool]]]]:
    """What stands beside the rows (captions and stray content), and the rows' cells, with their visibility."""
    beside, rows, stack = [], [], [(c, seen) for c in reversed(table.children)]
    while stack:
        node, now = stack.pop()
        if isinstance(node, str):
            if node.strip():
                wrap = Node("span", {})
                wrap.children = [node]
                beside.append((wrap, now))
            continue
        here, visible = shown(node, now)
        if not here:
            continue
        if node.tag in ("tbody", "thead", "tfoot"):
            stack += [(c, visible) for c in reversed(node.children)]
        elif node.tag == "tr":
            row = []
            for c in node.children:
                if isinstance(c, Node) and shown(c, visible)[0]:
                    row.append((c, visible))
                elif isinstance(c, str) and c.strip():
                    wrap = Node("td", {})
                    wrap.children = [c]
                    row.append((wrap, visible))
            rows.append(row)
        elif node.tag not in ("colgroup", "col"):
            beside.append((node, now))
    return beside, rows


def _span(node: Node, name: str, most: int) -> int:
    """How many columns or rows a cell spans; 0 (rows: all that follow) counts as the most."""
    value = node.attributes.get(name, "1").strip()
    if not (value.isascii() and value.isdigit()):
        return 1
    value = min(int(value[:9]), most)
    return value or (most if name == "rowspan" else 1)


def _joined(spans: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Sorted spans of columns, those that touch and end in the same row as one."""
    out = spans[:1]
    for a, b, row in spans[1:]:
        if a <= out[-1][1] and row == out[-1][2]:
            out[-1] = (out[-1][0], max(b, out[-1][1]), row)
        else:
            out.append((a, b, row))
    return out


def table_lines(table: Node, seen: bool) -> list[str]:
    """Rows as lines, columns padded to their widest line (up to WIDEST) and two spaces apart; a cell of several lines stays in its column.

    A cell that spans rows keeps its columns from the rows below. Blank lines stay
    within a row; rows without text go.
    """
    beside, rows = cells_of(table, seen)
    out = [line for node, now in beside for line in render([node], now)]
    laid, widths = [], {}
    taken: list[tuple[int, int, int]] = []  # columns from, to (past the last) and the row that may use them again: what cells above span
    for number, row in enumerate(rows):
        taken = [t for t in taken if t[2] > number]
        column, cells, spanned, ahead = 0, [], [], iter([*taken, (1 << 60, 1 << 60, 0)])
        first, last, _ = next(ahead)
        for node, now in row:
            while column >= first:
                column = max(column, last)
                first, last, _ = next(ahead)
            lines = render(children_of(node), shown(node, now)[1])
            span = _span(node, "colspan", MOST_COLUMNS)
            cells.append((column, lines))
            widths[column] = max([widths.get(column, 0), *(len(x) for x in lines if span == 1 and len(x) <= WIDEST)])
            # no cell reaches further down than the table does
            if (down := min(_span(node, "rowspan", MOST_ROWS), len(rows) - number)) > 1:
                spanned.append((column, column + span, number + down))
            column += span
        if spanned:
            taken = _joined(sorted([*taken, *spanned]))
        laid.append(cells)
    at, place = {}, 0
    for column in sorted(widths):
        at[column] = place
        place += widths[column] + (2 if widths[column] else 0)
    for cells in laid:
        height = max((len(lines) for _, lines in cells), default=0)
        for i in range(height):
            line, room = "", PADDING
            for column, lines in cells:
                if i < len(lines) and lines[i]:
                    led = len(lines[i]) - len(lines[i].lstrip(" "))  # by tables within
                    gap = max(2 if line else 0, min(at[column] - len(line), room, PADDING - led))
                    line += " " * gap + lines[i]
                    room -= gap
            out.append(line.rstrip())
    while out and not out[0]:
        out.pop(0)
    return out


def render(nodes: list, seen: bool) -> list[str]:
    """Lines of visible text; tables within are laid out already. The walk keeps its own stack, so nesting costs no recursion."""
    out = Lines()
    stack: list[tuple] = [("node", n, seen, False, 0) for n in reversed(nodes)]
    while stack:
        step = stack.pop()
        if step[0] == "end":
            _, gap, indent, item = step
            out.block(gap)
            out.indent = indent
            if item:
                out.lead = None
            continue
        _, node, now, as_is, lists = step
        if isinstance(node, str):
            if now:
                out.text(node, as_is)
            continue
        here, now = shown(node, now)
        if not here:
            continue
        tag = node.tag
        if tag == "br":
            out.end_line(True) if out.line else out.block(out.gap)
            continue
        if tag == "input":
            out.text(node.attributes.get("value", "") if now else "", False)
            continue
        if tag == "table":
            out.block(1)
            for line in node.lines:
                out.add(line)
                out.end_line(True)
            out.block(1)
            continue
        if tag in BLOCKS:
            gap = 1 if tag in SPACED and not (tag in ("ul", "ol", "menu") and lists) else 0
            out.block(gap)
            stack.append(("end", gap, out.indent, tag == "li"))
            if (tag == "blockquote" or tag == "dd") and len(out.indent) < DEEPEST:
                out.indent += "  "
        if tag in ("ul", "ol", "menu", "dir"):
            number = node.attributes.get("start", "1")
            number = int(number) if re.fullmatch(r"-?[0-9]{1,9}", number) else 1
            for c in node.children:
                if isinstance(c, Node) and c.tag == "li" and shown(c, True)[0]:
                    c.attributes["\0mark"] = f"{number}. " if tag == "ol" else "- "
                    number += 1
            lists += 1
        elif tag == "li":
            mark = node.attributes.get("\0mark", "- ")
            out.lead = (out.indent if out.lead is None else out.lead) + mark
            if len(out.indent) < DEEPEST:
                out.indent += " " * len(mark)
        keep = as_is or tag in ("pre", "textarea", "xmp")
        stack += [("node", c, now, keep, lists) for c in reversed(children_of(node))]
    return out.done()


def visible_text(source: str | None) -> str:
    """The visible text of an HTML document as lines; of null or empty, the empty text."""
    if not source:
        return ""
    root = tree(source)
    for table, seen in reversed(tables_of([root], True)):  # inner ones first
        table.lines = table_lines(table, seen)
    return "\n".join(render([root], True))


def extract(pages: DataFrame, column: str = "html") -> DataFrame:
    """pages with text string (in place of a column of that name): what a reader of the page would see. No shuffle."""

    def run(batches):
        for batch in batches:
            for part in steps(batch, column):
                yield with_columns(part, {"text": pa.array([visible_text(t) for t in part.column(part.schema.get_field_index(column)).to_pylist()], pa.string())})

    small_batches(pages.sparkSession)
    kept = StructType([f for f in pages.schema if f.name != "text"])
    return pages.mapInArrow(run, StructType(kept.fields + StructType.fromDDL("text string").fields))


def op10_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import functions as F

    done = extract(read(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return done.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"), F.size(F.split("text", "\n")).cast("long").alias("n_lines"))
