"""All visible text of HTML pages, laid out as a page would show it.

Markup becomes a tree first: end tags that authors may leave out are implied, stray ones are
ignored. What a page does not show is left out. The rest is written in lines: blocks start new
ones, paragraphs, headings, lists and tables have an empty line around them, list items get a
bullet or a number and are indented by depth, preformatted text stays as it is, and the cells
of a table are padded so that its columns line up.

Hidden is what ``hidden`` attributes, ``style`` attributes and the page's own ``<style>`` rules
say with ``display`` and ``visibility``; the latter is inherited and a descendant may take it
back. Of the selectors, those of one element are followed (tags, classes, ids); rules in at-rules
and rules with combinators or states hide nothing.
"""

from __future__ import annotations

import html
import re
import unicodedata
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Fixed values of HTML: elements by how they are parsed and shown.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = set("script style textarea title xmp iframe noembed noframes".split())
UNSEEN = set(
    "head title script style template iframe noembed noframes noscript object audio video "
    "canvas svg math datalist area base link meta param source track".split()
)
BLOCK = set(
    "html body address article aside blockquote center dd details dialog dir div dl dt "
    "fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr legend li main "
    "menu nav ol optgroup option p pre section summary table ul xmp caption tr".split()
)
SPACED = set("p h1 h2 h3 h4 h5 h6 ul ol menu dir dl table blockquote pre xmp figure hr".split())
LISTS = {"ul", "ol", "menu", "dir"}
CELLS, GROUPS = {"td", "th"}, {"thead", "tbody", "tfoot"}
# An element that closes an open one when it starts: which ones, up to which others.
CLOSED_BY_START = {
    "li": ({"li"}, LISTS),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "option": ({"option"}, {"select", "datalist"}),
    "optgroup": ({"option", "optgroup"}, {"select"}),
    "tr": ({"tr", "td", "th", "caption"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    **{g: ({"tr", "td", "th", "caption", *GROUPS}, {"table"}) for g in GROUPS},
    "body": ({"head"}, set()),
}
# Starting one of these closes an open paragraph.
ENDS_PARAGRAPH = BLOCK - set("html body option optgroup tr caption legend summary".split())
SCOPE = {"table", "td", "th", "caption", "button", "html"}

# An attribute by HTML's states: a quote opens a value right after the equals sign alone. One
# that is never closed counts as a plain character, so that no text is lost to it.
_ATTRIBUTE = (
    r"{0}[^\s/>][^\s/>=]*+)(?:\s*+=\s*+{0}\"[^\"]*+\"|'[^']*+'|(?![\"'])[^\s>]*+))?+"
)
TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)"
    r"|<[!?][^>]*>?"
    r"|<(/?)([a-zA-Z][^\s/>]*+)((?:[\s/]++|" + _ATTRIBUTE.format("(?:") + r")*+)>"
    r"|<",
    re.S,
)
ATTRIBUTE = re.compile(_ATTRIBUTE.format("("))
DECLARED = re.compile(r"(?:\A|[;{\s])(display|visibility)\s*:\s*([a-z-]+)\s*(!\s*important)?", re.I)
COMMENT = re.compile(r"/\*.*?(?:\*/|\Z)", re.S)
SELECTOR = re.compile(r"([a-z][\w-]*|\*)?((?:[.#][\w-]+)*)\Z", re.I)
INSET = 96  # columns that lines are indented by at most, however deep they are nested
BLANKS = re.compile(r"[ \t\n\r\f]+")


class Node:
    __slots__ = ("tag", "attrs", "children")

    def __init__(self, tag: str, attrs: dict | None = None) -> None:
        self.tag, self.attrs, self.children = tag, attrs or {}, []


def attributes(raw: str) -> dict:
    found: dict = {}
    for name, value in ATTRIBUTE.findall(raw):
        value = value[1:-1] if value[:1] in ("'", '"') and len(value) > 1 else value
        found.setdefault(name.lower(), html.unescape(value))
    return found


class Open:
    """The open elements, innermost last, and where each tag is among them."""

    def __init__(self, root: Node) -> None:
        self.nodes = [root]
        self.places: dict[str, list[int]] = {}

    def last(self, tags: set) -> int:
        """The place of the innermost open element with one of the tags; 0 for none."""
        return max((self.places[t][-1] for t in tags if self.places.get(t)), default=0)

    def push(self, node: Node) -> None:
        self.places.setdefault(node.tag, []).append(len(self.nodes))
        self.nodes.append(node)

    def cut(self, place: int) -> None:
        while len(self.nodes) > place:
            self.places[self.nodes.pop().tag].pop()

    def close(self, tags: set, upto: set) -> bool:
        """Close all of these that no element of ``upto`` holds; say whether there was one."""
        bound, closed = self.last(upto), False
        while (place := self.last(tags)) > bound:
            self.cut(place)
            closed = True
        return closed


def tree(text: str) -> Node:
    """The elements of a page; children are elements and strings."""
    root = Node("#page")
    stack = Open(root)
    last_end = text.rfind(">")

    at = 0
    for token in iter(lambda: TOKEN.search(text, at), None):
        if token.start() > at:
            stack.nodes[-1].children.append(html.unescape(text[at : token.start()]))
        if token.start() > last_end:
            # No tag ends any more: what is left is text, up to an open comment.
            rest = re.split(r"<[!?]", text[token.start() :], maxsplit=1)[0]
            stack.nodes[-1].children.append(html.unescape(rest))
            return root
        at = token.end()
        ends, tag = token[1], token[2]
        if tag is None:
            if token[0] == "<":
                stack.nodes[-1].children.append("<")
            continue
        tag = tag.lower()
        if ends:
            if tag == "br":
                stack.nodes[-1].children.append(Node("br"))
                continue
            # A cell's end may not reach out of its table, nor another's out of its cell.
            upto = {"table"} if tag in CELLS | GROUPS | {"tr", "caption"} else SCOPE - {tag}
            upto = set() if tag in ("table", "html", "body") else upto
            place = stack.last({tag})
            if place > stack.last(upto):
                stack.cut(place)
            elif tag == "p":
                stack.nodes[-1].children.append(Node("p"))  # an empty one, as HTML has it
            continue
        if tag in CLOSED_BY_START:
            stack.close(*CLOSED_BY_START[tag])
        if tag in ENDS_PARAGRAPH:
            stack.close({"p"}, SCOPE)
        if tag in CELLS and stack.nodes[-1].tag in GROUPS | {"table"}:
            stack.push(_child(stack.nodes[-1], Node("tr")))
        node = _child(stack.nodes[-1], Node(tag, attributes(token[3])))
        if tag in VOID or token[3].endswith("/") and tag not in BLOCK | CELLS | RAW:
            continue
        if tag in RAW:
            end = re.compile(rf"</{re.escape(tag)}\s*>", re.I).search(text, at)
            raw = text[at : end.start() if end else len(text)]
            node.children.append(html.unescape(raw) if tag in ("textarea", "title") else raw)
            at = end.end() if end else len(text)
            continue
        stack.push(node)
    if at < len(text):
        stack.nodes[-1].children.append(html.unescape(text[at:]))
    return root


def _child(parent: Node, node: Node) -> Node:
    parent.children.append(node)
    return node


def declared(text: str) -> dict:
    """``display`` and ``visibility`` among declarations: name to (important, value)."""
    found: dict = {}
    for name, value, important in DECLARED.findall(COMMENT.sub(" ", text)):
        name, said = name.lower(), (bool(important), value.lower())
        if name not in found or said[0] >= found[name][0]:
            found[name] = said
    return found


class Sheet:
    """The rules of a page's ``<style>`` elements that bear on what is seen."""

    def __init__(self) -> None:
        self.rules: dict[str, list] = {}  # by one class, id or tag that the selector names
        self.count = 0

    def read(self, text: str) -> None:
        depth, begin, selectors = 0, 0, ""
        text = COMMENT.sub(" ", text)
        for brace in re.finditer(r"[{};]", text):
            if brace[0] == "{":
                if not depth:
                    selectors, begin = text[begin : brace.start()], brace.end()
                depth += 1
            elif brace[0] == "}" and depth:
                depth -= 1
                if not depth:
                    if "@" not in selectors:
                        self._rule(selectors, text[begin : brace.start()])
                    begin = brace.end()
            elif not depth:
                begin = brace.end()  # an at-rule without a block

    def _rule(self, selectors: str, body: str) -> None:
        said = declared(body)
        if not said:
            return
        for selector in selectors.split(","):
            match = SELECTOR.match(selector.strip())
            if not match or not match[0]:
                continue
            tag = (match[1] or "*").lower()
            names = frozenset(re.findall(r"[.#][\w-]+", match[2]))
            weight = (sum(n[0] == "#" for n in names), len(names), tag != "*")
            self.count += 1
            key = min(names, default=tag)
            self.rules.setdefault(key, []).append((weight, self.count, tag, names, said))

    def said_of(self, node: Node) -> dict:
        """What rules and the element itself say: by importance, weight, then order."""
        own = declared(node.attrs["style"]) if "style" in node.attrs else {}
        if not self.rules:
            return {name: value for name, (_, value) in own.items()}
        names = {"." + c for c in node.attrs.get("class", "").split()}
        if "id" in node.attrs:
            names.add("#" + node.attrs["id"].strip())
        best: dict = {}
        for key in (node.tag, "*", *names):
            for weight, nth, tag, needed, said in self.rules.get(key, ()):
                if tag in ("*", node.tag) and needed <= names:
                    for name, (important, value) in said.items():
                        rank = (important, False, weight, nth)
                        if name not in best or rank > best[name][0]:
                            best[name] = rank, value
        for name, (important, value) in own.items():
            rank = (important, True, (), 0)
            if name not in best or rank[:2] > best[name][0][:2]:
                best[name] = rank, value
        return {name: value for name, (_, value) in best.items()}


def sheet_of(page: Node) -> Sheet:
    sheet, todo = Sheet(), [page]
    while todo:
        node = todo.pop()
        if node.tag == "style":
            sheet.read("".join(c for c in node.children if isinstance(c, str)))
        elif node.tag not in RAW:
            todo += [c for c in reversed(node.children) if isinstance(c, Node)]
    return sheet


def seen(node: Node, sheet: Sheet, inherited: bool) -> tuple[bool, bool]:
    """Whether an element has a place on the page, and whether its text is visible."""
    if node.tag in UNSEEN or node.tag == "dialog" and "open" not in node.attrs:
        return False, False
    said = sheet.said_of(node)
    placed = said.get("display") != "none" if "display" in said else "hidden" not in node.attrs
    visibility = said.get("visibility", "inherit")
    if visibility in ("hidden", "collapse"):
        return placed, False
    return placed, inherited or visibility in ("visible", "initial")


def unfolded(node: Node) -> list:
    """The children that are open to view: of closed details the first summary alone."""
    if node.tag == "details" and "open" not in node.attrs:
        return [c for c in node.children if isinstance(c, Node) and c.tag == "summary"][:1]
    return node.children


def breadth(line: str) -> int:
    """Columns a line takes: wide characters two, combining ones none."""
    if line.isascii():
        return len(line)
    return sum(
        0 if unicodedata.combining(c) else 2 if unicodedata.east_asian_width(c) in "WF" else 1
        for c in line
    )


class Canvas:
    """Lines of a page, or of a cell of a table."""

    def __init__(self) -> None:
        self.lines: list[str] = []
        self.line: list[str] = []  # parts of the line being written
        self.gap = 0  # empty lines due before the next text
        self.blank = False  # whether a blank is due
        self.indent = [""]  # what lines begin with, by depth
        self.mark = ""  # bullet of an item that has no text yet

    def words(self, text: str) -> None:
        """Text in which runs of blanks count as one."""
        parts = BLANKS.split(text)
        for i, part in enumerate(parts):
            if i and (self.line or self.blank):
                self.blank = bool(self.line)
            if part:
                self._begin()
                self.line.append(" " + part if self.blank else part)
                self.blank = False

    def exactly(self, text: str) -> None:
        for i, part in enumerate(text.replace("\r\n", "\n").split("\n")):
            if i:
                self.end_line(keep=True)
            if part:
                self._begin()
                self.line.append(part)

    def deeper(self, columns: int) -> None:
        self.indent.append((self.indent[-1] + " " * columns)[:INSET])

    def _begin(self) -> None:
        if self.line:
            return
        if self.lines and self.gap:
            self.lines += [""] * self.gap
        self.gap, self.blank = 0, False
        inset = self.indent[-1]
        if self.mark:
            inset = inset[: max(0, len(inset) - len(self.mark))] + self.mark
            self.mark = ""
        if inset:
            self.line.append(inset)

    def end_line(self, keep: bool = False) -> None:
        line = "".join(self.line)
        if line.strip():
            self.lines.append(line.rstrip())
        elif keep and self.lines:
            self.gap = min(self.gap + 1, 2) if not line else self.gap
        self.line, self.blank = [], False

    def space(self) -> None:
        self.end_line()
        self.gap = max(self.gap, 1)

    def block(self, lines: list[str]) -> None:
        for line in lines:
            self.end_line()
            if line:
                self._begin()
                self.line.append(line)
                self.end_line()
            else:
                self.gap = 1

    def done(self) -> list[str]:
        self.end_line()
        return self.lines


class Table:
    """Rows of cells; a cell is its lines, and how many columns and rows it takes."""

    def __init__(self) -> None:
        self.rows: list[list[tuple[list[str], int, int]]] = []
        self.groups: set[int] = set()  # rows before each group of rows

    def placed(self) -> Iterator[list[tuple[int, list[str], int]]]:
        """Rows of (column, lines, columns taken); cells from rows above keep their columns."""
        until: dict[int, int] = {}  # the row from which a column is free
        for i, row in enumerate(self.rows):
            if i in self.groups:
                until = {}  # no cell reaches out of its group
            column, cells = 0, []
            for lines, across, down in row:
                while until.get(column, 0) > i:
                    column += 1
                cells.append((column, lines, across))
                if down != 1:
                    end = i + down if down else len(self.rows)
                    for k in range(column, column + across):
                        until[k] = max(until.get(k, 0), end)
                column += across
            yield cells

    def lines(self) -> list[str]:
        rows = [r for r in self.placed() if any(lines for _, lines, _ in r)]
        widths: dict[int, int] = {}
        for row in rows:
            for column, lines, across in row:
                if across == 1:
                    widest = max(map(breadth, lines), default=0)
                    widths[column] = max(widths.get(column, 0), widest)
        out = []
        for row in rows:
            for i in range(max(len(lines) for _, lines, _ in row)):
                line, column, place = "", 0, 0
                for start, lines, across in row:
                    place += sum(widths.get(k, 0) + 2 for k in range(column, start))
                    column = start
                    line += " " * (place - breadth(line))
                    line += lines[i] if i < len(lines) else ""
                    place += sum(widths.get(column + k, 0) + 2 for k in range(across))
                    # A cell over several columns may be wider than they are.
                    place = max(place, breadth(line) + 2)
                    column += across
                out.append(line.rstrip())
        return out


def _span(node: Node) -> int:
    raw = node.attrs.get("colspan", "1").strip()
    return min(max(int(raw), 1), 1000) if raw.isdecimal() and len(raw) < 5 else 1


def _rows(node: Node) -> int:
    """Rows that a cell takes; 0 for all that its group has left."""
    raw = node.attrs.get("rowspan", "1").strip()
    return min(int(raw), 65534) if raw.isdecimal() and len(raw) < 10 else 1


def render(text: str | None) -> str:
    """The visible text of a page; null, empty and markup-only pages give an empty text."""
    if not text:
        return ""
    canvases, tables, numbers = [Canvas()], [], []  # numbers: (next, step) of ordered lists
    exact = 0
    page = tree(text)
    sheet = sheet_of(page)
    todo: list = [(page, False, True)]
    while todo:
        node, leaving, visible = todo.pop()
        canvas = canvases[-1]
        if isinstance(node, str):
            if not visible:
                continue
            if exact:
                canvas.exactly(node)
            elif not (tables and len(canvases) == len(tables) and not node.strip()):
                canvas.words(node)
            continue
        tag = node.tag
        if not leaving:
            placed, visible = seen(node, sheet, visible)
            if not placed:
                continue
            if tag == "br":
                canvas.end_line(keep=True)
                continue
            if tag in SPACED:
                canvas.space()
            elif tag in BLOCK:
                canvas.end_line()
            if tag == "select":
                options = list(_options(node))
                picked = [c for c in options if "selected" in c.attrs] or options[:1]
                todo += [(c, False, visible) for p in picked[::-1] for c in p.children[::-1]]
                continue
            if tag in LISTS:
                if numbers:
                    canvas.gap = 0  # a list in a list is not set apart
                numbers.append(_numbering(node) if tag == "ol" else None)
            elif tag == "li":
                mark = "- "
                if numbers and numbers[-1] is not None:
                    number, step = numbers[-1]
                    number = _whole(node.attrs.get("value"), number)
                    numbers[-1] = number + step, step
                    mark = f"{number}. "
                canvas.mark = mark if visible else ""
                canvas.deeper(len(mark))
            elif tag in ("dd", "blockquote"):
                canvas.deeper(4 if tag == "dd" else 2)
            elif tag in ("pre", "xmp", "textarea"):
                exact += 1
            elif tag == "table":
                tables.append(Table())
                canvases.append(Canvas())  # text between rows and cells is shown before them
            elif tag in GROUPS and tables:
                tables[-1].groups.add(len(tables[-1].rows))
            elif tag == "tr" and tables:
                tables[-1].rows.append([])
            elif tag in CELLS and tables:
                canvases.append(Canvas())
                numbers.append(None)
            todo.append((node, True, visible))
            todo += [(c, False, visible) for c in reversed(unfolded(node))]
            continue
        if tag in LISTS:
            numbers.pop()
            canvas.end_line()
        elif tag == "li":
            canvas.end_line()
            canvas.indent.pop()
            canvas.mark = ""
        elif tag in ("dd", "blockquote"):
            canvas.end_line()
            canvas.indent.pop()
        elif tag in ("pre", "xmp", "textarea"):
            exact -= 1
        elif tag in CELLS and tables:
            numbers.pop()
            lines = canvases.pop().done()
            if not tables[-1].rows:
                tables[-1].rows.append([])
            tables[-1].rows[-1].append((lines, _span(node), _rows(node)))
            continue
        elif tag in GROUPS and tables:
            tables[-1].groups.add(len(tables[-1].rows))
        elif tag == "table":
            loose = canvases.pop().done()
            canvas = canvases[-1]
            canvas.block(loose + tables.pop().lines())
        if tag in SPACED and not (tag in LISTS and numbers):
            canvas.space()
        elif tag in BLOCK:
            canvas.end_line()
    return "\n".join(canvases[0].done())


def _whole(raw: str | None, otherwise: int) -> int:
    raw = (raw or "").strip()
    return int(raw) if re.fullmatch(r"-?[0-9]{1,9}", raw) else otherwise


def _numbering(node: Node) -> tuple[int, int]:
    """The number of the first item of an ordered list, and the step to the next."""
    if "reversed" not in node.attrs:
        return _whole(node.attrs.get("start"), 1), 1
    items = sum(isinstance(c, Node) and c.tag == "li" for c in node.children)
    return _whole(node.attrs.get("start"), items), -1


def _options(select: Node) -> Iterator[Node]:
    for child in select.children:
        if isinstance(child, Node):
            if child.tag == "option":
                yield child
            else:
                yield from (c for c in child.children if isinstance(c, Node) and c.tag == "option")


def page_texts(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """One row per page: page_id, text. Rows that repeat or lack an id are rendered like any
    other; a null page gives an empty text; no rows give no rows."""

    @F.arrow_udf("string")
    def text(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            yield pa.array([render(t.as_py()) for t in batch], pa.string())

    return pages.select(
        F.col(id_col).alias("page_id"), text(F.col(html_col).cast("string")).alias("text")
    )
