"""HTML extraction by layout-aware rendering.

A tokenizer cuts the source into tags, text, comments and raw text; a tree
builder supplies implied tags (a paragraph ends where a block begins, a cell
where the next one does, a row opens its table body); visibility rules leave out
what a browser does not show; and a renderer walks the tree and emits all
visible text: blocks on lines of their own with an empty line between
paragraphs, list items with markers and indents, preformatted text as it is, and
table cells padded to aligned columns.

Nothing visible is left out, be it navigation or a footer: what to keep of a
page is a later decision. What is marked aria-hidden is visible and stays; a
drop-down list shows one option; closed details are shown open, as a reader can
open them. Hidden is what the page's own style hides, in a style attribute or by
a rule of one name, class, id or several of these; rules with combinators,
pseudo-classes or conditions are not applied.

All loops are over the source or an explicit stack, so deep nesting and unclosed
tags cost time in proportion to the source. Cells that span rows or columns keep
later cells in their columns. Columns are aligned up to `ALIGNED` characters; a
table that would be mostly empty places is written without alignment, cell by
cell, so that its text is never much longer than its source.

Defined cases: null and empty sources give an empty text; repeated rows are
rendered as often as they come; null ids pass through; an empty table gives an
empty result; further columns are not read.
"""

from __future__ import annotations

import html
import re
import unicodedata
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import bounded, slices, text_of

#: Quotes count behind a = only, where a value begins; an unfinished tag ends at the next <.
TAG = re.compile(r"<(/?)([A-Za-z][^\s/><]*+)((?:[\s/]++|=?[^\s/><=]++(?:\s*+=\s*+(?:\"[^\"]*+\"|'[^']*+'|[^\s<>\"'][^\s<>]*+)?+)?+|=)*+)>")
ATTRIBUTE = re.compile(r"([^\s=/>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>\"'][^\s>]*)))?")
DECLARED = re.compile(r"(?:^|;)\s*(display|visibility)\s*:\s*([a-z-]+)\s*(!\s*important)?\s*(?=;|$)", re.IGNORECASE)
SELECTOR = re.compile(r"([A-Za-z][\w-]*|\*)?((?:[.#][\w-]+)*)")
SPACE = re.compile(r"[ \t\n\r\f]+")

#: Sets of element names by their part in HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes noscript template".split())
HIDDEN = frozenset("head script style template noscript iframe noembed noframes object audio video canvas datalist title meta link base".split())
#: Inside svg and math these aren't rendered.
UNDRAWN = {"svg": frozenset("defs desc metadata symbol clippath mask marker pattern".split()), "math": frozenset(("annotation", "annotation-xml"))}
BLOCKS = frozenset("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead tr ul caption".split())
SPACED = frozenset("p h1 h2 h3 h4 h5 h6 blockquote pre table ul ol dl figure menu dir".split())
LISTS = frozenset("ul ol menu dir".split())
CELLS = frozenset(("td", "th"))
#: An opening tag ends the nearest of these, unless one of the others stands between.
IMPLIED = {
    "li": ({"li"}, LISTS),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr"}, {"table"}),
    "td": ({"td", "th"}, {"table"}),
    "th": ({"td", "th"}, {"table"}),
    "option": ({"option"}, {"select", "datalist"}),
    "body": ({"head"}, set()),
}
#: Blocks that end an open paragraph.
ENDS_PARAGRAPH = BLOCKS - {"html", "body", "td", "th", "tr", "tbody", "thead", "tfoot", "caption", "option", "optgroup", "legend", "summary"}
#: A paragraph is looked for inside these only.
SCOPE = frozenset("html body table td th caption button object template".split())
#: Most columns and rows that a cell spans in HTML, the widest that a column is padded to, and empty places that any table may have.
COLSPAN, ROWSPAN, ALIGNED, EMPTY = 1000, 65534, 120, 100_000
ROW_GROUPS = frozenset(("thead", "tbody", "tfoot"))
#: In the head these may stand; anything else begins the body.
HEAD_ONLY = frozenset("base link meta script style title template noscript".split())


class Node:
    __slots__ = ("attributes", "children", "name")

    def __init__(self, name: str, attributes: dict[str, str]) -> None:
        self.name, self.attributes, self.children = name, attributes, []


def attributes_of(source: str) -> dict[str, str]:
    found: dict[str, str] = {}
    for m in ATTRIBUTE.finditer(source):
        found.setdefault(m[1].lower(), html.unescape(m[2] or m[3] or m[4] or ""))
    return found


def tokens(source: str) -> Iterator[tuple[str, str, str]]:
    """("text", text, ""), ("open", name, attributes) and ("close", name, "")."""
    at, end = 0, len(source)
    lowered = None
    while at < end:
        lt = source.find("<", at)
        if lt < 0:
            yield "text", html.unescape(source[at:]), ""
            return
        if lt > at:
            yield "text", html.unescape(source[at:lt]), ""
        if source.startswith("<!--", lt):
            close = source.find("-->", lt + 4)
            at = end if close < 0 else close + 3
        elif source.startswith(("<!", "<?"), lt):
            close = source.find(">", lt)
            at = end if close < 0 else close + 1
        elif m := TAG.match(source, lt):
            name, at = m[2].lower(), m.end()
            if m[1]:
                yield "close", name, ""
                continue
            yield "open", name, m[3]
            if name in RAW and name not in ("noscript", "template"):
                lowered = source.lower() if lowered is None else lowered
                # lower() may change the length of a text above ASCII; then each search lowers its own copy
                stop = lowered.find(f"</{name}", at) if len(lowered) == end else next((x.start() for x in re.compile(f"</{name}", re.IGNORECASE).finditer(source, at)), -1)
                stop = end if stop < 0 else stop
                yield "text", html.unescape(source[at:stop]) if name in ("title", "textarea") else source[at:stop], ""
                at = stop
        else:  # a < that begins no tag is text
            yield "text", "<", ""
            at = lt + 1


def tree(source: str) -> Node:
    """The tree of a source, with implied tags supplied."""
    top = Node("html", {})
    stack = [top]
    open_names: dict[str, list[int]] = {}  # where in the stack elements of a name are open

    def push(name: str, attributes: dict[str, str]) -> None:
        node = Node(name, attributes)
        stack[-1].children.append(node)
        open_names.setdefault(name, []).append(len(stack))
        stack.append(node)

    def nearest(names: set[str] | frozenset[str]) -> int:
        return max((places[-1] for n in names if (places := open_names.get(n))), default=0)

    def close(names: set[str], barriers: set[str] | frozenset[str]) -> None:
        """Ends the nearest open element of these names, if no barrier is nearer."""
        place = nearest(names)
        if place and place >= nearest(barriers):
            cut_back(place)

    def cut_back(place: int) -> None:
        while len(stack) > place:
            open_names[stack.pop().name].pop()

    for kind, name, rest in tokens(source):
        if kind == "text":
            if stack[-1].name == "head" and name.strip():
                close({"head"}, set())
            stack[-1].children.append(name)
        elif kind == "close":
            if name == "br":
                stack[-1].children.append(Node("br", {}))
            elif name == "p" and not open_names.get("p"):
                stack[-1].children.append(Node("p", {}))
            else:
                barriers = frozenset() if name in ("table", "body", "html") else {"table"} if name in ("tr", "tbody", "thead", "tfoot") else {"table", *CELLS} - {name}
                close({name}, barriers)
        else:
            if name == "html":
                top.attributes |= attributes_of(rest)
                continue
            if open_names.get("head") and name not in HEAD_ONLY and name != "head":
                close({"head"}, set())
            if name in ENDS_PARAGRAPH:
                close({"p"}, SCOPE)
            if name in IMPLIED:
                close(*IMPLIED[name])
            elif name in ROW_GROUPS and (table := nearest({"table"})):  # ends a row, a caption or another group of the table
                cut_back(table + 1)
            if name in CELLS and stack[-1].name in ("table", "tbody", "thead", "tfoot"):
                push("tr", {})
            attributes = attributes_of(rest) if rest.strip(" /") else {}
            foreign = [f for f in UNDRAWN if open_names.get(f)]
            if any(name in UNDRAWN[f] for f in foreign):
                attributes["-undrawn"] = "1"
            if name == "text" and "svg" in foreign:
                attributes["-apart"] = "1"
            if name in VOID or (foreign and rest.endswith("/")):
                stack[-1].children.append(Node(name, attributes))
            else:
                push(name, attributes)
    return top


def declared(block: str) -> Iterator[tuple[str, str, bool]]:
    """(property, value, important) of the display and visibility that a block sets."""
    for m in DECLARED.finditer(block):
        yield m[1].lower(), m[2].lower(), bool(m[3])


def blocks_of(style: str) -> Iterator[tuple[str, str]]:
    """(selectors, declarations) of a style sheet, without those under a condition."""
    above: list[bool] = []  # for each open block around, whether what is in it counts
    at, style = 0, re.sub(r"/\*.*?(?:\*/|$)", " ", style, flags=re.DOTALL)
    for m in re.finditer(r"[{};]", style):
        before = style[at : m.start()].strip()
        if m[0] == "{":
            if before.startswith("@"):
                above.append(all(above) and bool(re.fullmatch(r"@media\s+(?:all|screen)|@layer\b.*", before, re.IGNORECASE | re.DOTALL)))
            else:
                end = style.find("}", m.end())
                if all(above):
                    yield before, style[m.end() : end if end >= 0 else len(style)]
                above.append(False)
        elif m[0] == "}" and above:
            above.pop()
        at = m.end()


class Sheet:
    """What the rules of a page's style sheets say about display and visibility."""

    def __init__(self, styles: list[str]) -> None:
        # by the last class, id or name of a selector: (its name, classes and ids), rank, property, value
        self.rules: dict[str, list[tuple[str, frozenset[str], tuple, str, str]]] = {}
        order = 0
        for style in styles:
            for selectors, block in blocks_of(style):
                found = list(declared(block))
                for selector in selectors.split(",") if found else []:
                    m = SELECTOR.fullmatch(selector.strip())
                    if not m or not m[0]:
                        continue
                    order += 1
                    parts = re.findall(r"[.#][\w-]+", m[2])
                    name = (m[1] or "*").lower()
                    weight = (sum(p[0] == "#" for p in parts), len(parts), name != "*")
                    self.rules.setdefault(parts[-1] if parts else name, []).extend((name, frozenset(parts), (important, *weight, order), prop, value) for prop, value, important in found)

    def looks(self, node: Node) -> tuple[str | None, str | None]:
        """The display and the visibility that are set for an element, by rules or its style attribute."""
        a, best = node.attributes, {}
        if self.rules:
            own = {f".{c}" for c in a.get("class", "").split()} | ({f"#{a['id']}"} if a.get("id") else set())
            for key in (*own, node.name, "*"):
                for name, parts, rank, prop, value in self.rules.get(key, ()):
                    if name in ("*", node.name) and parts <= own and rank > best.get(prop, ((),))[0]:
                        best[prop] = rank, value
        if a.get("style"):
            for i, (prop, value, important) in enumerate(declared(a["style"])):
                rank = (important, float("inf"), i)
                if rank > best.get(prop, ((),))[0]:
                    best[prop] = rank, value
        return tuple(best[p][1] if p in best else None for p in ("display", "visibility"))  # type: ignore[return-value]


def displayed(node: Node, display: str | None, visibility: str | None = None) -> bool:
    """Whether an element has a place on the page, given what is set for it."""
    a = node.attributes
    if node.name in HIDDEN or "-undrawn" in a or (node.name == "input" and a.get("type", "").lower() == "hidden"):
        return False
    if visibility == "collapse" and (node.name == "tr" or node.name in ROW_GROUPS):
        return False
    if display:
        return display != "none"
    return not ("hidden" in a or (node.name == "dialog" and "open" not in a))


def drop_down(select: Node, sheet: Sheet) -> str | None:
    """The text that a drop-down list shows: its last selected option, or the first that can be chosen; None for a list box."""
    size = select.attributes.get("size", "").strip()
    if "multiple" in select.attributes or (size.isdecimal() and int(size) > 1):
        return None
    first = chosen = None
    todo = [(c, False) for c in reversed(select.children)]
    while todo:
        node, disabled = todo.pop()
        if isinstance(node, Node):
            disabled |= "disabled" in node.attributes
            if node.name == "option":
                chosen = node if "selected" in node.attributes else chosen
                first = node if first is None and not disabled else first
                disabled = False
            todo.extend((c, disabled) for c in reversed(node.children))
    shown = chosen or first
    if shown is None or shown.attributes.get("label"):
        return shown.attributes["label"] if shown else ""
    parts, inner = [], list(reversed(shown.children))
    while inner:
        node = inner.pop()
        if isinstance(node, str):
            parts.append(node)
        elif node.name not in ("option", "optgroup") and displayed(node, *sheet.looks(node)):
            inner.extend(reversed(node.children))
    return "".join(parts)


def width(text: str) -> int:
    """Columns on a fixed grid: wide characters take two, combining ones none."""
    if text.isascii():
        return len(text)
    return sum(0 if unicodedata.combining(c) else 2 if unicodedata.east_asian_width(c) in "WF" else 1 for c in text)


class Page:
    """Lines as they are laid out: inline text gathers in a line until a block ends it."""

    def __init__(self) -> None:
        self.lines: list[str] = []
        self.inline: list[str] = []
        self.blank = False

    def text(self, text: str) -> None:
        self.inline.append(text)

    def end_line(self, prefix: str = "") -> None:
        line = SPACE.sub(" ", "".join(self.inline)).strip(" ")
        self.inline.clear()
        if line:
            self.line(prefix + line)

    def line(self, line: str) -> None:
        if self.blank and self.lines:
            self.lines.append("")
        self.blank = False
        self.lines.append(line)

    def space(self) -> None:
        self.blank = True


class Table:
    """Rows of cells, each at its column behind the cells that span down from rows above."""

    def __init__(self) -> None:
        self.rows: list[list[tuple[int, str]]] = []
        self.column = 0
        #: (first column, column after, row after) of cells that span rows, by column.
        self.spans: list[tuple[int, int, float]] = []

    def row(self) -> None:
        self.rows.append([])
        self.column = 0
        self.spans = [s for s in self.spans if s[2] >= len(self.rows)]

    def cell(self, text: str, columns: int, rows: float) -> None:
        if not self.rows:
            self.row()
        i = 0
        while i < len(self.spans) and self.spans[i][0] <= self.column:
            self.column = max(self.column, self.spans[i][1])
            i += 1
        self.rows[-1].append((self.column, text))
        stop = self.column + columns
        if rows > 1:
            until = len(self.rows) + rows - 1
            if i and self.spans[i - 1][1:] == (self.column, until):
                self.spans[i - 1] = (self.spans[i - 1][0], stop, until)
            else:
                self.spans.insert(i, (self.column, stop, until))
        self.column = stop

    def lines(self) -> list[str]:
        """The columns aligned; the lines of a cell stay below each other."""
        starts = {c: i for i, c in enumerate(sorted({c for row in self.rows for c, _ in row}))}
        parts = [[(starts[c], text.split("\n")) for c, text in row] for row in self.rows]
        tall = [max((len(lines) for _, lines in row), default=0) for row in parts]
        filled = sum(len(lines) for row in parts for _, lines in row)
        if sum(h * (row[-1][0] + 1) for h, row in zip(tall, parts, strict=True) if row) > 4 * filled + EMPTY:
            return [line for row in parts for line in ([" | ".join(lines[0] for _, lines in row)] if max(map(lambda x: len(x[1]), row), default=0) == 1 else [x for _, lines in row for x in lines]) if line.strip(" |")]
        wide = [0] * len(starts)
        for row in parts:
            for i, lines in row:
                wide[i] = max(wide[i], max((w for line in lines if (w := width(line)) <= ALIGNED), default=0))
        found = []
        for height, row in zip(tall, parts, strict=True):
            for k in range(height):
                cells = [""] * (row[-1][0] + 1)
                for i, lines in row:
                    cells[i] = lines[k] if k < len(lines) else ""
                found.append(" | ".join(text + " " * (w - width(text)) for text, w in zip(cells, wide, strict=False)).rstrip())
        return [line for line in found if line.strip(" |")]


def span_of(node: Node, name: str, most: int) -> int:
    """A cell's span; of one that isn't a number, 1."""
    value = node.attributes.get(name, "1").strip()
    return min(int(value), most) if re.fullmatch(r"[0-9]{1,9}", value) else 1


def render(top: Node, styles: list[str]) -> str:
    """All visible text of a tree under its style sheets."""
    page, sheet, hidden = Page(), Sheet(styles), False
    pages = [page]
    lists: list[list] = []
    tables: list[Table] = []
    pre = 0
    prefix = ""
    # what is left to do: a text, a node to enter, or a node to leave
    todo: list[tuple] = [("enter", top)]

    def indent() -> str:
        return "  " * max(0, len(lists) - 1)

    def end_line() -> None:
        nonlocal prefix
        before = len(page.lines)
        page.end_line(prefix)
        if len(page.lines) > before and prefix:
            prefix = " " * width(prefix)

    while todo:
        what, it, *before = todo.pop()
        if isinstance(it, str):
            if hidden:
                page.text(" ")
            elif pre:
                first, *more = it.split("\n")
                page.text(first.replace(" ", " "))
                for line in more:
                    flush_pre(page)
                    page.text(line.replace(" ", " "))
            else:
                page.text(it)
            continue
        name = it.name
        if what == "enter":
            display, visibility = sheet.looks(it)
            if not displayed(it, display, visibility):
                continue
            was, hidden = hidden, visibility in ("hidden", "collapse") if visibility in ("hidden", "collapse", "visible") else hidden
            if hidden and name in ("img", "input", "select"):
                hidden = was
                continue
            if name == "br":
                flush_pre(page) if pre else end_line()
            elif name == "hr":
                end_line()
                page.space()
            elif name == "img":
                page.text(it.attributes.get("alt", ""))
            elif name == "input" and it.attributes.get("type", "").lower() in ("button", "submit", "reset"):
                page.text(f" {it.attributes.get('value', '')} ")
            if name in VOID:
                hidden = was
                continue
            if name == "select" and (shown := drop_down(it, sheet)) is not None:
                page.text(f" {shown} ")
                hidden = was
                continue
            if it.attributes.get("-apart"):
                page.text(" ")
            if name in BLOCKS:
                end_line()
                if name in SPACED and not (name in LISTS and lists):
                    page.space()
            if name in LISTS:
                lists.append([name, 0])
                if name == "ol" and re.fullmatch(r"-?[0-9]{1,9}", it.attributes.get("start", "")):
                    lists[-1][1] = int(it.attributes["start"]) - 1
            elif name == "li":
                if not lists:
                    lists.append(["ul", 0])
                    it.attributes["-own-list"] = "1"
                lists[-1][1] += 1
                prefix = "" if hidden else indent() + (f"{lists[-1][1]}. " if lists[-1][0] == "ol" else "- ")
            elif name == "dd":
                prefix = "  "
            elif name == "pre":
                pre += 1
            elif name == "table":
                tables.append(Table())
                it.attributes["-lists"], it.attributes["-prefix"] = lists, prefix
                lists, prefix = [], ""
            elif name == "tr" and tables:
                tables[-1].row()
            elif name in ROW_GROUPS and tables:
                tables[-1].spans.clear()
            elif name in CELLS and tables:
                page = Page()
                pages.append(page)
            todo.append(("leave", it, was))
            todo.extend(("enter", child) for child in reversed(it.children))
            continue
        if it.attributes.get("-apart"):
            page.text(" ")
        hidden = before[0]
        if name in BLOCKS:
            flush_pre(page) if pre and page.inline else end_line()
            if name in SPACED and not (name in LISTS and len(lists) > 1):
                page.space()
        if name in LISTS:
            lists.pop()
            prefix = ""
        elif name in ("li", "dd"):
            prefix = ""
            if it.attributes.get("-own-list"):
                lists.pop()
        elif name == "pre":
            pre -= 1
        elif name in CELLS and tables and len(pages) > 1:
            cell = "\n".join(pages.pop().lines)
            page = pages[-1]
            tables[-1].cell(cell, max(1, span_of(it, "colspan", COLSPAN)), span_of(it, "rowspan", ROWSPAN) or float("inf"))
        elif name in ROW_GROUPS and tables:
            tables[-1].spans.clear()
        elif name == "table" and tables:
            for line in tables.pop().lines():
                page.line(line)
            page.space()
            lists, prefix = it.attributes["-lists"], it.attributes["-prefix"]
    end_line()
    return "\n".join(page.lines).replace(" ", " ")


def flush_pre(page: Page) -> None:
    """Ends a preformatted line, which stays as it is, empty ones too."""
    page.line("".join(page.inline))
    page.inline.clear()


def extracted(source: str) -> tuple[str, str, int]:
    """(title, visible text, number of tables) of a source."""
    top = tree(source)
    title, tables, styles, todo = "", 0, [], [top]
    while todo:
        node = todo.pop()
        if node.name == "title" and not title:
            title = SPACE.sub(" ", "".join(c for c in node.children if isinstance(c, str))).strip()
        elif node.name == "style" and node.attributes.get("media", "all").strip().lower() in ("", "all", "screen"):
            styles.append("".join(c for c in node.children if isinstance(c, str)))
        tables += node.name == "table"
        todo.extend(c for c in reversed(node.children) if isinstance(c, Node))
    return title, render(top, styles), tables


def extract(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """(id, title, text, n_tables) of each page."""

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            found = [extracted(source) for source in batch.column(1).to_pylist()]
            title, text, tables = zip(*found, strict=True)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(title, pa.string()), pa.array(text, pa.string()), pa.array(tables, pa.int64())], names=[id_col, "title", "text", "n_tables"])

    narrow = pages.select(F.col(id_col), text_of(html_col).alias("html"))
    fields = [narrow.schema[id_col], T.StructField("title", T.StringType()), T.StructField("text", T.StringType()), T.StructField("n_tables", T.LongType())]
    return bounded(narrow).mapInArrow(kernel, T.StructType(fields))
