"""Visible text of HTML pages, laid out: blocks, lists, preformatted text and aligned table cells.

``parse`` builds a tree with the implied tags of HTML (a paragraph ends where a block starts, a cell where the next one does,
and so on), ``render`` walks it by visibility and display rules. Both are small helpers; pages are independent rows
and are rendered where they are read, without a shuffle.

Layout. Runs of white space are one space. Blocks start on a line of their own; paragraphs, headings, lists, tables and quotations
also have an empty line around. Items of lists have ``- `` or their number (``start``, ``reversed``, ``value``), and are indented by it. Cells of a table are padded
to the width of their column, in characters, and separated by two spaces; a spanning cell widens the last of its columns; what stands in a table but in no cell comes before it. All options of a
select are shown, the text of a textarea, the value of a field that shows it (its placeholder if there is none), of math, of svg (its text and
foreignObject elements), of map, and the fallback of object. Widths count East Asian wide characters twice and combining ones not at all.
Hidden: head, title, scripts, styles, templates, comments, noscript (scripts count as on), the fallback of iframe, audio, video, meter, progress
and canvas, noembed, noframes, datalist, annotations of math, definitions and descriptions of svg,
attributes ``hidden`` and ``aria-hidden="true"``, the style ``display:none``, closed ``details`` but for the summary,
closed dialogs, and form fields that are hidden. Text with ``visibility`` hidden or collapse isn't shown; that is inherited, and an element inside may be
visible again. Of several declarations of a style the last one counts, or the last that is important.
"""

from __future__ import annotations

import html
import re
import unicodedata

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import pick, ready

# Element names of HTML by their role.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = set("script style xmp iframe noembed noframes textarea title".split())
HIDDEN = set("head script style template noscript noembed noframes iframe audio video canvas meter progress datalist annotation annotation-xml title link meta base param source track area colgroup col".split())
#: Parts of an svg that aren't drawn where they stand.
UNDRAWN = set("defs symbol clippath mask pattern marker lineargradient radialgradient filter title desc metadata".split())
BLOCK = set("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre search section summary table caption tbody tfoot thead tr td th ul xmp".split())
SPACED = set("blockquote dl fieldset figure h1 h2 h3 h4 h5 h6 hr menu ol p pre table ul xmp".split())
ENDS_P = BLOCK - set("dd dt li body html option optgroup caption tbody tfoot thead tr td th legend".split()) | {"li", "dd", "dt"}
#: An element ends when one of these starts, unless one of the fences is nearer.
IMPLIED = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir", "table"}), "dd": ({"dd", "dt"}, {"dl", "table"}), "dt": ({"dd", "dt"}, {"dl", "table"}),
    "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "tr": ({"tr", "td", "th", "caption"}, {"tbody", "thead", "tfoot", "table"}),
    "tbody": ({"tbody", "thead", "tfoot", "tr", "td", "th", "caption"}, {"table"}), "option": ({"option"}, {"select", "datalist"}),
}
IMPLIED |= {"thead": IMPLIED["tbody"], "tfoot": IMPLIED["tbody"], "optgroup": ({"option", "optgroup"}, {"select"})}
TOKEN = re.compile(r"<!--.*?(?:-->|$)|<[!?][^>]*(?:>|$)|</([a-zA-Z][^\s/>]*)[^>]*(?:>|$)|<([a-zA-Z][^\s/>]*)((?:\"[^\"]*\"|'[^']*'|[^>])*)(?:>|$)", re.S)
ATTRIBUTE = re.compile(r"([^\s=/\"'>]+)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+))?")
DECLARATION = re.compile(r"([-\w]+)\s*:\s*((?:\"[^\"]*\"|'[^']*'|\([^)]*\)|[^;\"'(]|[\"'(])*)")
#: Kinds of fields that don't show their value as text.
NO_TEXT = set("hidden checkbox radio file image color range password".split())
DEEPEST = 150


class Node:
    """An element; ``drawn`` is whether its own text is to be seen, as far as visibility decides it."""

    __slots__ = ("tag", "attributes", "kids", "drawn")

    def __init__(self, tag: str, attributes: str = "", drawn: bool = True):
        self.tag, self.attributes, self.kids, self.drawn = tag, attributes, [], drawn
        if "style" in attributes:
            self.drawn = {"visible": True, "hidden": False, "collapse": False}.get(self.style("visibility"), drawn)

    def style(self, name: str) -> str:
        """The value of a declaration in the style attribute: the last one, or the last important one; empty if there is none."""
        found, sure = "", False
        for key, value in DECLARATION.findall(re.sub(r"/\*.*?(?:\*/|$)", " ", self.get("style") or "", flags=re.S)):
            value, important = re.subn(r"\s*!\s*important\s*$", "", value.strip().lower())
            if key.lower() == name and (important or not sure):
                found, sure = value.strip(), bool(important)
        return found

    def get(self, name: str) -> str | None:
        """An attribute, empty if it has no value; read only when asked for. The first of equal names counts."""
        if name not in self.attributes.lower():
            return None
        for key, value in ATTRIBUTE.findall(self.attributes):
            if key.lower() == name:
                return html.unescape(value[1:-1] if value[:1] in "\"'" and value[:1] else value)
        return None


def parse(page: str) -> Node:
    """The tree of a page. Elements deeper than DEEPEST become children of the one at that depth."""
    root = Node("html")
    stack, at, n = [root], 0, len(page)
    skipped: dict[str, int] = {}  # open elements below a hidden one at DEEPEST

    def close(names: set[str], fences: set[str]) -> None:
        for k in range(len(stack) - 1, 0, -1):
            if stack[k].tag in fences:
                return
            if stack[k].tag in names:
                del stack[k:]
                return

    while at < n:
        found = TOKEN.search(page, at)
        if not found:
            break
        if found.start() > at:
            stack[-1].kids.append(html.unescape(page[at : found.start()]))
        at = found.end()
        end, tag = found[1], found[2]
        if end:
            end = end.lower()
            if len(stack) <= DEEPEST:
                skipped.clear()
            if skipped.get(end):
                skipped[end] -= 1
            elif end == "br":
                stack[-1].kids.append(Node("br"))
            elif end == "p" and not any(x.tag == "p" for x in stack):
                stack[-1].kids.append(Node("p"))
            elif end not in ("html", "body"):
                close({end}, {"table"} if end != "table" and end not in ("tbody", "thead", "tfoot", "tr", "td", "th", "caption") else set())
        elif tag:
            tag, rest = tag.lower(), found[3] or ""
            if tag in ("html", "body"):
                if tag == "body":
                    close({"head"}, set())
                    root.attributes += " " + rest
                    root.drawn = Node("body", root.attributes).drawn
                continue
            if stack[-1].tag == "head" and tag not in HIDDEN:
                stack.pop()
            if tag in ENDS_P:
                close({"p"}, {"table", "td", "th", "button", "caption"})
            if tag in IMPLIED:
                names, fences = IMPLIED[tag]
                while any(x.tag in names for x in stack[max([0, *(k for k, x in enumerate(stack) if x.tag in fences)]) :]):
                    close(names, fences)
            node = Node(tag, rest, stack[min(len(stack), DEEPEST) - 1].drawn)
            alone = tag in VOID or rest.endswith("/") and (tag in ("svg", "math") or any(x.tag in ("svg", "math") for x in stack))
            if len(stack) <= DEEPEST:
                skipped.clear()
            below = len(stack) > DEEPEST and not visible(stack[-1])
            if below:
                stack[-1].kids.append(node)
            elif len(stack) <= DEEPEST or alone:
                stack[-1].kids.append(node)
            else:
                del stack[DEEPEST:]
                stack[-1].kids.append(node)
            if tag in RAW:
                stop = re.compile(rf"</{tag}(?=[\s/>])[^>]*>?", re.I).search(page, at)
                text = page[at : stop.start() if stop else n]
                node.kids.append(html.unescape(text) if tag in ("textarea", "title") else text)
                at = stop.end() if stop else n
            elif below:
                skipped[tag] = skipped.get(tag, 0) + (not alone)
            elif not alone:
                stack.append(node)
    if at < n:
        stack[-1].kids.append(html.unescape(page[at:]))
    return root


def visible(node: Node) -> bool:
    if node.tag in HIDDEN:
        return False
    if not node.attributes:
        return True
    if node.get("hidden") is not None or (node.get("aria-hidden") or "").lower() == "true" or node.style("display") == "none":
        return False
    return node.tag != "dialog" or node.get("open") is not None


class Flow:
    """Lines of a block: inline text is gathered and becomes lines when a block starts or ends."""

    def __init__(self):
        self.lines: list[str] = []
        self.inline: list[str] = []
        self.gap = False  # an empty line is due before the next one

    def flush(self) -> None:
        text = "".join(self.inline)
        self.inline = []
        for part in text.split("\0"):  # at line breaks
            self.add([re.sub(r"[ \t\n\f\r]+", " ", part).strip(" ")] if "\0" in text or part.strip(" \t\n\f\r") else [])

    def add(self, lines: list[str]) -> None:
        if any(lines):
            if self.gap and self.lines:
                self.lines.append("")
            self.gap = False
            self.lines += lines

    def block(self, lines: list[str], spaced: bool) -> None:
        self.flush()
        self.gap |= spaced
        self.add(lines)
        self.gap |= spaced


def _walk(node: Node, flow: Flow) -> None:
    for kid in node.kids:
        if isinstance(kid, str):
            if node.drawn:
                flow.inline.append(kid.replace("\0", ""))
        elif kid.tag == "br":
            flow.inline.append("\0")
        elif kid.tag == "wbr" or not visible(kid):
            continue
        elif kid.tag == "input":
            if kid.drawn and (kid.get("type") or "text").strip().lower() not in NO_TEXT:
                flow.inline.append((kid.get("value") or kid.get("placeholder") or "").replace("\0", ""))
        elif kid.tag == "textarea":
            if kid.drawn:
                flow.inline.append(("".join(kid.kids) or kid.get("placeholder") or "").replace("\0", "").replace("\r\n", "\n").removeprefix("\n").replace("\n", "\0"))
        elif kid.tag == "svg":
            _drawn(kid, flow)
        elif kid.tag == "optgroup":
            flow.block([(kid.get("label") or "") if kid.drawn else ""], False)
            flow.block(_lines(kid), False)
        elif kid.tag == "q":
            flow.inline.append("“" if kid.drawn else "")
            _walk(kid, flow)
            flow.inline.append("”" if kid.drawn else "")
        elif kid.tag in BLOCK:
            flow.block(_lines(kid), kid.tag in SPACED)
        else:
            _walk(kid, flow)


def _drawn(node: Node, flow: Flow) -> None:
    """The texts of an svg, apart from each other."""
    for kid in node.kids:
        if isinstance(kid, Node) and kid.tag not in UNDRAWN and visible(kid):
            if kid.tag in ("text", "foreignobject"):
                flow.inline.append(" ")
                _walk(kid, flow)
                flow.inline.append(" ")
            else:
                _drawn(kid, flow)


def _inside(node: Node) -> list[str]:
    flow = Flow()
    _walk(node, flow)
    flow.flush()
    return flow.lines


def _lines(node: Node) -> list[str]:
    tag = node.tag
    if tag == "hr":
        return ["---"] if node.drawn else []
    if tag in ("pre", "xmp"):
        return _plain(node).strip("\n").split("\n")
    if tag in ("ul", "ol", "menu", "dir"):
        return _list(node)
    if tag == "table":
        return _table(node)
    if tag == "blockquote":
        return [f"> {x}".rstrip() for x in _inside(node)]
    if tag == "dd":
        return [f"    {x}".rstrip() for x in _inside(node)]
    if tag == "details" and node.get("open") is None:
        node.kids = [x for x in node.kids if isinstance(x, Node) and x.tag == "summary"][:1]
    return _inside(node)


def _plain(node: Node) -> str:
    """Text with its own spaces and lines."""
    out = []
    for kid in node.kids:
        if isinstance(kid, str):
            out.append(kid.replace("\r\n", "\n") if node.drawn else "")
        elif kid.tag == "br":
            out.append("\n")
        elif kid.tag == "svg" and visible(kid):
            out.append("\n".join(_inside(_holder(kid, node))))
        elif visible(kid):
            out.append(_plain(kid))
    return "".join(out)


def _number(text: str | None, default: int) -> int:
    return int(text) if text and re.fullmatch(r"\s*-?\d{1,9}\s*", text) else default


def _list(node: Node) -> list[str]:
    back = node.tag == "ol" and node.get("reversed") is not None
    items = sum(isinstance(x, Node) and x.tag == "li" and visible(x) for x in node.kids)
    number = _number(node.get("start"), items if back else 1)
    loose, out = Flow(), []
    for kid in node.kids:
        if isinstance(kid, Node) and kid.tag == "li" and visible(kid):
            number = _number(kid.get("value"), number)
            mark = f"{number}. " if node.tag == "ol" else "- "
            number += -1 if back else 1
            lines = [x for x in _inside(kid)]
            if lines:
                out += [mark + lines[0], *[(" " * len(mark) + x).rstrip() for x in lines[1:]]]
        elif isinstance(kid, Node) and kid.tag in BLOCK and kid.tag != "li" and visible(kid):
            out += [("  " + x).rstrip() for x in _lines(kid)]
        elif isinstance(kid, Node) and kid.tag != "li" or isinstance(kid, str) and kid.strip():
            _walk(_holder(kid, node), loose)
            loose.flush()
            out += loose.lines
            loose.lines = []
    return out


def _holder(kid: Node | str, parent: Node) -> Node:
    holder = Node("div", "", parent.drawn)
    holder.kids = [kid]
    return holder


def _holds(node: Node, tags: tuple[str, ...]) -> bool:
    return any(isinstance(x, Node) and x.tag != "table" and visible(x) and (x.tag in tags or _holds(x, tags)) for x in node.kids)


def _cells(node: Node, heads: list[Node], row: list[Node]) -> None:
    """Cells of a row, also those inside other elements; what is in no cell stands before the table."""
    for kid in node.kids:
        if isinstance(kid, str):
            if kid.strip():
                heads.append(_holder(kid, node))
        elif kid.tag in ("td", "th"):
            if visible(kid):
                row.append(kid)
        elif visible(kid) and _holds(kid, ("td", "th")):
            _cells(kid, heads, row)
        elif visible(kid):
            heads.append(_holder(kid, node))


def _rows(node: Node, heads: list[Node], rows: list, feet: list, group: Node) -> None:
    """Rows as their group, across which no cell spans, and their cells."""
    for kid in node.kids:
        if isinstance(kid, Node) and visible(kid):
            if kid.tag == "caption":
                heads.append(kid)
            elif kid.tag == "tr":
                rows.append((group, []))
                _cells(kid, heads, rows[-1][1])
            elif kid.tag in ("td", "th"):
                rows.append((group, [kid]))
            elif kid.tag == "tfoot":
                _rows(kid, heads, feet, feet, kid)
            elif kid.tag in ("tbody", "thead", "table"):
                _rows(kid, heads, rows, feet, kid)
            elif _holds(kid, ("caption", "tr", "td", "th", "tbody", "thead", "tfoot")):
                _rows(kid, heads, rows, feet, group)
            else:
                heads.append(_holder(kid, node))
        elif isinstance(kid, str) and kid.strip():  # text that isn't in a cell stands before the table
            heads.append(_holder(kid, node))


def _span(cell: Node, name: str, least: int = 1) -> int:
    value = (cell.get(name) or "1").strip()
    return min(1000, max(least, int(value))) if re.fullmatch(r"\d{1,6}", value) else 1


def _wide(text: str) -> int:
    """How many columns a text takes: two for a wide character, none for a combining one."""
    return len(text) if text.isascii() else sum(2 if unicodedata.east_asian_width(c) in "WF" else not unicodedata.combining(c) for c in text)


def _table(node: Node) -> list[str]:
    heads, rows, feet = [], [], []
    _rows(node, heads, rows, feet, node)
    grid, busy, before = [], {}, None  # busy: columns that a cell above still fills, and for how many rows
    for group, row in [*rows, *feet]:
        if group is not before:
            busy, before = {}, group
        placed, column = {}, 0
        for cell in row:
            while busy.get(column, 0):
                column += 1
            wide, high = _span(cell, "colspan"), _span(cell, "rowspan", 0) or 1 << 30  # 0: to the end of the group
            placed[column] = (_inside(cell), wide)
            for c in range(column, column + wide):
                busy[c] = high
            column += wide
        busy = {c: k - 1 for c, k in busy.items() if k > 1}
        grid.append(placed)
    # columns in which no cell starts take no room
    starts = {c: k for k, c in enumerate(sorted({c for placed in grid for c in placed}))}
    grid = [{starts[c]: (lines, sum(c <= x < c + wide for x in starts)) if wide > 1 else (lines, 1) for c, (lines, wide) in placed.items()} for placed in grid]
    width: dict[int, int] = {}
    for placed in grid:
        for c, (lines, wide) in placed.items():
            if wide == 1:
                width[c] = max(width.get(c, 0), *(_wide(x) for x in lines), 0)
    for placed in grid:  # what a spanning cell needs beyond its columns goes to the last of them
        for c, (lines, wide) in placed.items():
            more = max((_wide(x) for x in lines), default=0) - sum(width.get(k, 0) for k in range(c, c + wide)) - 2 * (wide - 1)
            if wide > 1 and more > 0:
                width[c + wide - 1] = width.get(c + wide - 1, 0) + more
    out = [x for h in heads for x in _inside(h)]
    for placed in grid:
        for k in range(max((len(x) for x, _ in placed.values()), default=0)):
            line, at, edge = "", 0, 0
            last = max(placed)
            for c in range(last + 1):
                if c in placed:
                    lines, wide = placed[c]
                    line += " " * (edge - _wide(line)) + (lines[k] if k < len(lines) else "")
                edge += width.get(c, 0) + 2
                at = c
            out.append(line.rstrip() if at == last else line)
    return out


def render(page: str) -> str:
    root = parse(page)
    return "\n".join(_inside(root)) if visible(root) else ""


def _apply(batches):
    for batch in batches:
        text = [render(x.as_py() or "") for x in batch.column("html")]
        yield pa.RecordBatch.from_pydict({"page_id": batch.column("page_id"), "text": pa.array(text, pa.string())})


def html_text(pages: DataFrame) -> DataFrame:
    """page_id, text: the visible text of each whole page.

    Null or empty html: empty text. Pages of any length are taken whole; elements deeper than ``DEEPEST`` are laid out as children of the
    one at that depth, and lose no text. Broken markup never fails: a quote without an end is an ordinary character of its tag, what looks like no tag is text, and an open tag ends where the
    page does. Null and repeated ids pass through; empty table: no rows; other columns are ignored.
    """
    ready(pages)
    pages = pick(pages, page_id="page_id", html="html").select(F.col("page_id").cast("long"), F.col("html").cast("string"))
    return pages.mapInArrow(_apply, "page_id long, text string")
