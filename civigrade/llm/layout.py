"""Layout-aware text of HTML pages.

Each page becomes a small tree, with the end tags that HTML implies (a paragraph ends where a block begins, a list item where the
next one begins, a cell where its row ends, the head where content begins). The tree is then laid out as text: everything that a
reader would see is kept, in order; what is hidden (head, scripts, templates, ``hidden``, ``display:none``, ``visibility:hidden``,
closed details but for their summary) is not.

Blocks begin on a new line, those with a margin after an empty one. List items get a bullet or number and an indent per level.
Preformatted text keeps its blanks. Tables get aligned columns: cells take their places in a grid, those that span rows keep their
columns in the rows below, and a cell of several lines makes its row as high. A cell longer than ``WIDEST_COLUMN`` is padded no
further and moves the rest of its own row only. Tables with a cell of several blocks (paragraphs, lists, further tables) only arrange
a page; there every cell is a block.

Only elements whose content is raw text end at their end tag alone. ``svg``, ``math`` and ``object`` are parsed like others and their
text is kept: each ``text`` of a drawing and each cell of a formula's table on a line of its own, the fallback of an object where it
stands. Titles, descriptions and metadata of drawings and annotations of formulas are never shown. Inside ``svg`` and ``math`` a tag
that ends in ``/>`` is closed by it, and a tag that cannot stand there ends them.

Pages are independent and each is rendered where it is read. Defined results: a null or empty page gives an empty text; text outside
of any tag is kept; an unfinished tag is text; elements nested deeper than ``MAX_DEPTH`` keep their content and lose their own
layout; repeated pages and null ids come back as they are; further columns are ignored.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from civigrade.llm.spans import sliced

MAX_DEPTH = 200
WIDEST_COLUMN = 48
MAX_SPAN, MOST_ROWS = 100, 65_534
GAP = "  "

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style template noscript iframe noembed noframes".split())
HIDDEN = frozenset("head title script style template noscript iframe noembed noframes datalist audio video canvas".split())
#: Parts of drawings and formulas that are never shown, and those on a line of their own.
FOREIGN_HIDDEN = {"svg": frozenset("desc metadata".split()), "math": frozenset("annotation annotation-xml".split())}
FOREIGN_BLOCK = frozenset("text mtr mtd".split())
#: Parts of drawings and formulas whose content is HTML again.
FOREIGN_HTML = frozenset("foreignobject desc title annotation-xml mi mo mn ms mtext".split())
#: Start tags that end the drawing or formula they stand in.
FOREIGN_ENDS = frozenset(
    "b big blockquote body br center code dd div dl dt em embed h1 h2 h3 h4 h5 h6 head hr i img li listing menu meta nobr ol p pre ruby s small span strong strike sub sup table tt u ul var".split()
)
HEAD_ONLY = frozenset("title meta link base style script noscript template".split())
SPACED = frozenset("p h1 h2 h3 h4 h5 h6 ul ol dl table blockquote pre figure hr menu".split())
BLOCK = SPACED | frozenset(
    "html body div section article aside header footer nav main address form fieldset details summary dialog figcaption li dt dd tr td th thead tbody tfoot caption option optgroup legend center hgroup search".split()
)
#: A start tag -> the open elements it ends, and the elements that keep those beyond them open.
ENDS = {
    "li": ({"li"}, {"ul", "ol", "menu", "table"}),
    "dt": ({"dt", "dd"}, {"dl", "table"}),
    "dd": ({"dt", "dd"}, {"dl", "table"}),
    "tr": ({"tr", "td", "th", "caption"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "thead": ({"thead", "tbody", "tfoot", "tr", "td", "th", "caption"}, {"table"}),
    "tbody": ({"thead", "tbody", "tfoot", "tr", "td", "th", "caption"}, {"table"}),
    "tfoot": ({"thead", "tbody", "tfoot", "tr", "td", "th", "caption"}, {"table"}),
    "option": ({"option"}, {"select", "datalist"}),
    "optgroup": ({"option", "optgroup"}, {"select"}),
}
#: Elements across which an end tag does not reach.
WALLS = frozenset("table td th caption body html".split())
TABLE_PARTS = frozenset("tr td th thead tbody tfoot caption table".split())

MARKUP = re.compile(
    r"""<!--.*?(?:-->|\Z)|<[!?][^>]*+>|<(?P<end>/?)(?P<name>[a-zA-Z][^\s/>]*+)(?P<rest>(?:[^>"']++|"[^"]*+"|'[^']*+')*+|[^>]*+)>""", re.S
)
ATTRIBUTE = re.compile(r"""([^\s=/"'>]+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""")
BLANKS = re.compile(r"[ \t\n\r\f\v]+")
CONCEALED = re.compile(r"display\s*:\s*none|visibility\s*:\s*(?:hidden|collapse)", re.I)


class Element:
    __slots__ = ("tag", "attributes", "content")

    def __init__(self, tag: str, attributes: dict[str, str]):
        self.tag, self.attributes, self.content = tag, attributes, []


def attributes_of(text: str) -> dict[str, str]:
    return {name.lower(): html.unescape(value.strip("\"'")) for name, value in ATTRIBUTE.findall(text)} if text.strip(" /\n\t\r") else {}


def closes_itself(rest: str) -> bool:
    """Whether a tag ends in a slash that is not part of an unquoted value."""
    if not rest.endswith("/"):
        return False
    before = rest[:-1].rsplit(None, 1)[-1:]
    return not before or rest[-2].isspace() or before[0][-1] in "\"'" or "=" not in before[0]


def foreign_depth(stack: list[Element]) -> int:
    """Where in the stack the drawing or formula begins whose own content comes next; 0 if that is HTML."""
    for depth in range(len(stack) - 1, 0, -1):
        if stack[depth].tag in ("svg", "math"):
            return depth
        if stack[depth].tag in FOREIGN_HTML:
            return 0
    return 0


def tree_of(page: str) -> Element:
    """The elements and texts of a page below one root."""
    root = Element("html", {})
    stack, at = [root], 0
    last = page.rfind(">") + 1  # beyond it no tag can end, and nothing is searched

    def end(names: set[str], walls: frozenset[str] | set[str]) -> None:
        """End the outermost open element of ``names`` that no wall separates, and all inside it."""
        found = 0
        for depth in range(len(stack) - 1, 0, -1):
            if stack[depth].tag in names:
                found = depth
            elif stack[depth].tag in walls:
                break
        if found:
            del stack[found:]

    def add_text(text: str) -> None:
        if text:
            if stack[-1].tag == "head" and not text.isspace():
                stack.pop()
            stack[-1].content.append(html.unescape(text) if "&" in text else text)

    while True:
        mark = MARKUP.search(page, at, last)
        if mark is None:
            add_text(page[at:])
            return root
        add_text(page[at : mark.start()])
        at, name = mark.end(), (mark["name"] or "").lower()
        if not name:
            continue
        if mark["end"]:
            if name not in VOID:
                for depth in range(len(stack) - 1, 0, -1):
                    if stack[depth].tag == name:
                        del stack[depth:]
                        break
                    if stack[depth].tag in WALLS and name not in TABLE_PARTS or stack[depth].tag == "table":
                        break
            continue
        inside = foreign_depth(stack)
        if inside and name in FOREIGN_ENDS:
            del stack[inside:]
            inside = 0
        if any(e.tag == "head" for e in stack[1:]) and name not in HEAD_ONLY and name != "head":
            end({"head"}, set())
        if name in ENDS:
            end(*ENDS[name])
        elif name in BLOCK:
            end({"p"}, WALLS)
        rest = mark["rest"] or ""
        element = Element(name, attributes_of(rest))
        closed = (inside or name in ("svg", "math")) and closes_itself(rest)
        if inside and name in FOREIGN_HIDDEN[stack[inside].tag]:
            element.attributes["hidden"] = ""
        if name in RAW:
            if closed:
                continue
            close = re.compile(rf"</{re.escape(name)}\s*>", re.I).search(page, at)
            at = close.end() if close else len(page)
            continue
        if name in ("html", "body"):
            continue
        stack[-1].content.append(element)
        if not closed and name not in VOID and len(stack) < MAX_DEPTH:
            stack.append(element)


def visible(element: Element) -> bool:
    own = element.attributes
    if element.tag in HIDDEN or "hidden" in own or CONCEALED.search(own.get("style", "")):
        return False
    return element.tag != "dialog" or "open" in own


class Page:
    """Lines of text while a tree is laid out; ``margin`` is the number of line ends that the next text needs before it."""

    def __init__(self) -> None:
        self.lines: list[str] = []
        self.line, self.margin, self.prefix, self.bullet = "", 0, "", ""

    def block(self, spaced: bool) -> None:
        if self.line.strip():
            self.lines.append((self.bullet or self.prefix) + self.line.strip())
            self.bullet = ""
        self.line = ""
        self.margin = max(self.margin, 2 if spaced else 1)

    def space(self) -> None:
        if self.margin == 2 and self.lines and self.lines[-1]:
            self.lines.append("")
        self.margin = 0

    def text(self, text: str) -> None:
        text = BLANKS.sub(" ", text)
        if not self.line:
            text = text.lstrip(" ")
            if not text:
                return
            self.space()
        elif self.line.endswith(" "):
            text = text.lstrip(" ")
        self.line += text

    def whole(self, lines: list[str]) -> None:
        """Lines that are laid out already."""
        if lines:
            self.block(False)
            self.space()
            for line in lines:
                self.lines.append(((self.bullet or self.prefix) + line).rstrip())
                self.bullet = ""

    def finished(self) -> list[str]:
        self.block(False)
        while self.lines and not self.lines[-1]:
            self.lines.pop()
        return self.lines


def lay_out(element: Element, page: Page) -> None:
    """Add all visible content of an element to the page."""
    shown = element.content
    if element.tag == "details" and "open" not in element.attributes:
        shown = [x for x in shown if isinstance(x, Element) and x.tag == "summary"][:1]
    number = 1
    if element.tag == "ol" and element.attributes.get("start", "").lstrip("-").isdigit():
        number = int(element.attributes["start"][:9])
    for part in shown:
        if isinstance(part, str):
            page.text(part)
            continue
        tag = part.tag
        if not visible(part):
            continue
        if tag == "br":
            had = bool(page.line.strip())
            page.block(False)
            if not had and page.lines:
                page.margin = 2
        elif tag == "pre":
            page.block(True)
            page.whole(raw_text(part).strip("\n").split("\n") if raw_text(part).strip() else [])
            page.block(True)
        elif tag == "table":
            page.block(True)
            page.whole(table_lines(part))
            page.block(True)
        elif tag == "li":
            page.block(False)
            mark = f"{number}. " if element.tag == "ol" else "- "
            number += element.tag == "ol"
            outer, bullet = page.prefix, page.bullet
            page.bullet, page.prefix = (bullet or outer) + mark, outer + " " * len(mark)
            lay_out(part, page)
            page.block(False)
            page.prefix, page.bullet = outer, ""
        elif tag in FOREIGN_BLOCK:
            page.block(False)
            lay_out(part, page)
            page.block(False)
        elif tag in BLOCK:
            nested = tag in ("ul", "ol", "menu") and page.prefix
            indent = "  " if tag in ("dd", "blockquote") else ""
            page.block(tag in SPACED and not nested)
            page.prefix += indent
            lay_out(part, page)
            page.block(tag in SPACED and not nested)
            page.prefix = page.prefix[: len(page.prefix) - len(indent)]
        else:
            lay_out(part, page)


def raw_text(element: Element) -> str:
    """All visible text of an element with its own blanks."""
    parts = []
    for part in element.content:
        if isinstance(part, str):
            parts.append(part)
        elif part.tag == "br":
            parts.append("\n")
        elif visible(part):
            parts.append(raw_text(part))
    return "".join(parts).replace("\r\n", "\n")


def lines_of(element: Element) -> list[str]:
    page = Page()
    lay_out(element, page)
    return page.finished()


def rows_of(element: Element) -> Iterator[tuple[Element, Element]]:
    """The visible rows of a table with the group they stand in, and whatever stands between them as rows of its own."""
    for part in element.content:
        if isinstance(part, str):
            if not part.isspace():
                stray = Element("tr", {})
                stray.content.append(part)
                yield element, stray
        elif visible(part):
            if part.tag in ("thead", "tbody", "tfoot"):
                yield from rows_of(part)
            elif part.tag == "tr":
                yield element, part
            elif part.tag not in VOID:
                stray = Element("tr", {})
                stray.content.append(part)
                yield element, stray


def span_of(cell: Element, name: str, most: int) -> int:
    text = cell.attributes.get(name, "1").strip()
    span = int(text) if text.isdigit() and len(text) < 9 else 1
    if span == 0:  # rows: all that are left in the group
        return most if name == "rowspan" else 1
    return min(span, most)


def holds_blocks(element: Element) -> bool:
    waiting = [element]
    while waiting:
        for part in waiting.pop().content:
            if isinstance(part, Element) and visible(part):
                if part.tag in BLOCK:
                    return True
                waiting.append(part)
    return False


@dataclass(frozen=True)
class Cell:
    """Lines of a visible cell, the columns it takes, and whether it arranges several blocks."""

    lines: list[str]
    column: int
    span: int
    arranges: bool


def cells_of(row: Element) -> Iterator[Element]:
    """The visible cells of a row; stray content is a cell."""
    for part in row.content:
        if isinstance(part, str) and part.isspace() or isinstance(part, Element) and not visible(part):
            continue
        if isinstance(part, Element) and part.tag in ("td", "th"):
            yield part
        else:
            cell = Element("td", {})
            cell.content.append(part)
            yield cell


def grid_of(table: Element) -> list[list[Cell]]:
    """The cells of every row at their columns; columns that a cell above still takes are passed over."""
    rows: list[list[Cell]] = []
    taken: dict[int, int] = {}  # column -> rows it is still taken for
    group = None
    for own_group, row in rows_of(table):
        if own_group is not group:
            group, taken = own_group, {}
        cells, column, new = [], 0, {}
        for element in cells_of(row):
            while column in taken:
                column += 1
            lines, span, down = lines_of(element), span_of(element, "colspan", MAX_SPAN), span_of(element, "rowspan", MOST_ROWS)
            cells.append(Cell(lines, column, span, len(lines) > 1 and holds_blocks(element)))
            if down > 1:
                new |= dict.fromkeys(range(column, column + span), down - 1)
            column += span
        taken = {c: n - 1 for c, n in taken.items() if n > 1} | new
        rows.append(cells)
    return rows


def table_lines(table: Element) -> list[str]:
    """Aligned columns, or the cells one after the other where the table only arranges blocks."""
    rows = [cells for cells in grid_of(table) if any(cell.lines for cell in cells)]
    if any(cell.arranges for cells in rows for cell in cells):
        return [line for cells in rows for cell in cells for line in cell.lines]
    widths: dict[int, int] = {}
    for cells in rows:
        for cell in cells:
            for column in range(cell.column, cell.column + cell.span):
                widths.setdefault(column, 0)
            if cell.span == 1:
                widths[cell.column] = max(widths[cell.column], *(min(len(line), WIDEST_COLUMN) for line in cell.lines or [""]))
    begins, edge = {}, 0
    for column in range(max(widths, default=-1) + 1):
        begins[column] = edge
        edge += widths.get(column, 0) + len(GAP)
    result = []
    for cells in rows:
        for number in range(max(len(cell.lines) for cell in cells)):
            line = ""
            for cell in cells:
                text = cell.lines[number] if number < len(cell.lines) else ""
                if text:
                    begin = begins[cell.column]
                    line = line + GAP + text if line and len(line) + len(GAP) > begin else line.ljust(begin) + text
            result.append(line.rstrip())
    return result


def rendered(page: str | None) -> str:
    """The visible text of a page."""
    return "\n".join(lines_of(tree_of(page))) if page else ""


def with_text(pages: DataFrame, keep: list[str], source: str = "html") -> DataFrame:
    """Columns ``keep`` and the laid-out ``text`` of every page."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, "page_source"):
            texts = [rendered(page) for page in batch.column("page_source").to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(texts, pa.string())], names=[*batch.schema.names[1:], "text"])

    rows = pages.select(F.make_valid_utf8(F.col(source)).alias("page_source"), *keep)
    return rows.mapInArrow(run, rows.drop("page_source").schema.add("text", "string"))
