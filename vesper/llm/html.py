"""HTML to visible text as a browser lays it out: tree, visibility, blocks, lists and aligned tables.

A tokenizer and a tree builder turn the page into open, text and close events in
which implied tags are closed and inserted; a renderer lays the events out. Both
work on explicit stacks, in time linear in the page.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import css
from .session import bound_batches

VOID = frozenset("area base br col embed hr img input link meta param source track wbr frame keygen basefont bgsound".split())
RAW = frozenset("script style xmp iframe noembed noframes".split())
RCDATA = frozenset("textarea title".split())
#: Elements that end an open paragraph.
BLOCK = frozenset("address article aside blockquote body center details dialog dir div dl dd dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre search section summary table ul caption tr thead tbody tfoot listing plaintext xmp".split())
#: Blocks with an empty line around them.
SPACED = frozenset("p h1 h2 h3 h4 h5 h6 ul ol dl pre blockquote table figure hr menu dir fieldset listing".split())
NEVER = frozenset("head script style title template noscript datalist iframe noembed noframes object video audio canvas rp param map area base link meta".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Elements that an end tag or an implied end tag doesn't reach through.
SCOPE = frozenset("table td th caption html template object marquee".split())
#: Tags that mean nothing outside of a table.
IN_TABLE = frozenset("caption colgroup col thead tbody tfoot tr td th".split())
ENDS_P = BLOCK - frozenset("body html dd dt li tr thead tbody tfoot caption legend optgroup option".split())
#: start tag: (elements that it ends, elements at which the search stops)
IMPLIED = {
    "li": (frozenset(["li"]), frozenset("ul ol menu dir".split()) | SCOPE),
    "dt": (frozenset(["dt", "dd"]), frozenset(["dl"]) | SCOPE),
    "dd": (frozenset(["dt", "dd"]), frozenset(["dl"]) | SCOPE),
    "option": (frozenset(["option"]), frozenset(["select", "optgroup", "datalist"]) | SCOPE),
    "optgroup": (frozenset(["option", "optgroup"]), frozenset(["select"]) | SCOPE),
    "rt": (frozenset(["rt", "rp"]), frozenset(["ruby"]) | SCOPE),
    "rp": (frozenset(["rt", "rp"]), frozenset(["ruby"]) | SCOPE),
    "tr": (frozenset("tr td th caption colgroup".split()), frozenset("table thead tbody tfoot html template".split())),
    "td": (frozenset("td th caption".split()), frozenset("table tr thead tbody tfoot html template".split())),
    "th": (frozenset("td th caption".split()), frozenset("table tr thead tbody tfoot html template".split())),
    **{t: (frozenset("thead tbody tfoot tr td th caption colgroup".split()), frozenset("table html template".split())) for t in ("thead", "tbody", "tfoot")},
}
#: Elements nested deeper are laid out in the element at this depth.
DEPTH = 512
#: Columns are padded to this width at most; longer cells reach over it.
WIDTH = 60
#: Rows or columns that one cell spans at most.
SPAN = 100

_TAG = re.compile(r"<(/?)([A-Za-z][^\s/>]*)")
_ATTRIBUTE = re.compile(r"[\s/]*(?:([^\s/>=][^\s/>=]*)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]*)))?|=)")
_SPACE = re.compile(r"[ \t\n\f\r]+")
_SHEET = re.compile(r"<!--.*?(?:-->|\Z)|<script\b.*?(?:</script|\Z)|<style\b(?P<head>[^<>]*)>(?P<sheet>.*?)(?:</style|\Z)", re.IGNORECASE | re.DOTALL)


def _attributes(page: str, at: int) -> tuple[dict[str, str] | None, int]:
    """Attributes from a tag's name on, and the place after its end; None if the page ends in the tag."""
    found: dict[str, str] = {}
    n = len(page)
    while True:
        while at < n and page[at] in " \t\n\f\r/":
            at += 1
        if at >= n:
            return None, n
        if page[at] == ">":
            return found, at + 1
        m = _ATTRIBUTE.match(page, at)
        if m is None or m.end() == at:
            at += 1
            continue
        if m[1]:
            value = m[2] if m[2] is not None else m[3] if m[3] is not None else m[4] or ""
            found.setdefault(m[1].lower(), unescape(value) if "&" in value else value)
        at = m.end()


def tokens(page: str) -> Iterator[tuple[str, str, dict[str, str] | None]]:
    """("text", text, None), ("open", tag, attributes) and ("close", tag, None); comments and declarations are left out."""
    at, n = 0, len(page)
    while at < n:
        lt = page.find("<", at)
        if lt < 0:
            yield "text", unescape(page[at:]), None
            return
        m = _TAG.match(page, lt)
        if m is None:
            if page.startswith("<!--", lt):
                end = page.find("-->", lt + 4)
                if page.startswith((">", "->"), lt + 4):
                    end, width = lt + 4, 1 if page[lt + 4] == ">" else 2
                else:
                    width = 3
                if lt > at:
                    yield "text", unescape(page[at:lt]), None
                at = n if end < 0 else end + width
            elif page.startswith(("<!", "<?", "</"), lt):
                if lt > at:
                    yield "text", unescape(page[at:lt]), None
                if page.startswith("<![CDATA[", lt) and (end := page.find("]]>", lt)) >= 0:
                    yield "text", page[lt + 9 : end], None
                    at = end + 3
                else:
                    end = page.find(">", lt)
                    at = n if end < 0 else end + 1
            else:
                yield "text", unescape(page[at : lt + 1]), None
                at = lt + 1
            continue
        if lt > at:
            yield "text", unescape(page[at:lt]), None
        tag = m[2].lower()
        attributes, at = _attributes(page, m.end())
        if attributes is None:
            return
        if m[1]:
            yield "close", tag, None
            continue
        yield "open", tag, attributes
        if tag in RAW or tag in RCDATA:
            end = re.compile(rf"</{re.escape(tag)}(?=[\s/>])", re.IGNORECASE).search(page, at)
            stop = end.start() if end else n
            if stop > at:
                yield "text", page[at:stop] if tag in RAW else unescape(page[at:stop]), None
            at = stop
            if end is None:
                yield "close", tag, None
        elif tag == "plaintext":
            yield "text", page[at:], None
            return


def tree(page: str) -> Iterator[tuple[str, str, dict[str, str] | None]]:
    """The tokens of a page as a tree: each open has its close, in order; implied tags are there."""
    stack: list[str] = []
    count: Counter = Counter()

    def pop_to(index: int) -> Iterator[tuple[str, str, None]]:
        while len(stack) > index:
            tag = stack.pop()
            count[tag] -= 1
            yield "close", tag, None

    def last(tags: frozenset[str], stops: frozenset[str]) -> int:
        """Place of the innermost element of tags, not looking beyond stops; -1 if there is none."""
        if any(count[t] for t in tags):
            for i in range(len(stack) - 1, -1, -1):
                if stack[i] in tags:
                    return i
                if stack[i] in stops:
                    break
        return -1

    for kind, name, attributes in tokens(page):
        if kind == "text":
            yield kind, name, None
        elif kind == "open":
            if name == "image":
                name = "img"
            if name in ("html", "body") and count[name] or name in IN_TABLE and not count["table"]:
                continue
            if name == "body" and count["head"]:
                yield from pop_to(stack.index("head"))
            if name in ENDS_P and (i := last(frozenset(["p"]), SCOPE | {"button"})) >= 0:
                yield from pop_to(i)
            if name in HEADINGS and stack and stack[-1] in HEADINGS:
                yield from pop_to(len(stack) - 1)
            if name in ("a", "button", "nobr", "form") and count[name] and (i := last(frozenset([name]), SCOPE)) >= 0 and name != "form":
                yield from pop_to(i)
            if name in IMPLIED:
                ends, stops = IMPLIED[name]
                # all that the tag ends, outermost first: a cell's end is its row's only for a new row
                while (i := last(ends, stops)) >= 0:
                    yield from pop_to(i)
            if name in ("td", "th") and count["table"]:
                if stack[-1] == "table":
                    stack.append("tbody")
                    count["tbody"] += 1
                    yield "open", "tbody", {}
                if stack[-1] in ("tbody", "thead", "tfoot"):
                    stack.append("tr")
                    count["tr"] += 1
                    yield "open", "tr", {}
            elif name == "tr" and stack and stack[-1] == "table":
                stack.append("tbody")
                count["tbody"] += 1
                yield "open", "tbody", {}
            if name in VOID:
                yield "open", name, attributes
                yield "close", name, None
            elif len(stack) < DEPTH:
                stack.append(name)
                count[name] += 1
                yield "open", name, attributes
        else:
            if name == "br":
                yield "open", "br", {}
                yield "close", "br", None
            elif name == "p" and not count["p"]:
                yield "open", "p", {}
                yield "close", "p", None
            elif count[name]:
                same = HEADINGS if name in HEADINGS else frozenset([name])
                stops = frozenset() if name in ("table", "body", "html", "template") else frozenset(["table", "template"]) if name in ("td", "th", "tr", "thead", "tbody", "tfoot", "caption") else SCOPE
                if (i := last(same, stops)) >= 0:
                    yield from pop_to(i)
    yield from pop_to(0)


class Lines:
    """Text under layout: white space collapses, blocks begin lines, empty lines come between spaced blocks."""

    def __init__(self, indent: str = ""):
        self.lines: list[str] = []
        self.now: list[str] = []
        self.gap = 0  # line ends that come before further text
        self.space = False
        self.indent = indent
        self.marker = ""

    def block(self, ends: int) -> None:
        self.gap = max(self.gap, ends)
        self.space = False

    def _begin(self) -> None:
        if self.gap:
            # a line break before the block has ended the line already
            if self.now:
                self.lines.append("".join(self.now))
            if self.lines:
                self.lines += [""] * (self.gap - 1)
            self.now, self.gap = [], 0
        if not self.now:
            self.now.append(self.indent + self.marker)
            if self.marker:
                self.marker = ""

    def text(self, text: str) -> None:
        pieces = _SPACE.split(text)
        if not pieces[0]:
            self.space = True
        words = [p for p in pieces if p]
        if not words:
            return
        fresh = self.gap > 0 or not self.now
        self._begin()
        if self.space and not fresh:
            self.now.append(" ")
        self.now.append(" ".join(words))
        self.space = not pieces[-1]

    def kept(self, text: str) -> None:
        """Text with its white space and line ends."""
        for i, line in enumerate(text.split("\n")):
            if i:
                self.newline()
            if line:
                between = " " if self.space and self.now and not self.gap else ""
                self._begin()
                self.now.append(between + line)
                self.space = False

    def newline(self) -> None:
        if not self.now or self.gap:
            self._begin()
        self.lines.append("".join(self.now))
        self.now, self.space = [], False

    def done(self) -> list[str]:
        lines = [*self.lines, "".join(self.now)] if self.now else [*self.lines]
        lines = [x.rstrip() for x in lines]
        while lines and not lines[-1]:
            lines.pop()
        while lines and not lines[0]:
            lines.pop(0)
        return lines


def width(text: str) -> int:
    """Columns of a line: wide characters take two, marks none."""
    if text.isascii():
        return len(text)
    return sum(0 if unicodedata.combining(c) else 2 if unicodedata.east_asian_width(c) in "WF" else 1 for c in text)


def grid(rows: list[list[tuple[list[str], int, int]]]) -> list[str]:
    """Lines of a table of cells (lines, columns, rows that they span); cells of a column are aligned."""
    placed: list[dict[int, list[str]]] = []
    wide: set[int] = set()  # cells of several columns, which don't widen the first
    taken: dict[int, int] = {}  # column: rows below that a cell reaches into
    for row in rows:
        here: dict[int, list[str]] = {}
        column = 0
        left = dict(taken)
        for lines, columns, down in row:
            while left.get(column, 0) > 0:
                column += 1
            here[column] = lines
            if columns > 1:
                wide.add(id(lines))
            for c in range(column, column + columns):
                if down > 1:
                    taken[c] = down
            column += columns
        taken = {c: n - 1 for c, n in taken.items() if n > 1}
        if here:
            placed.append(here)
    widths: dict[int, int] = {}
    used = {c for here in placed for c, lines in here.items() if lines}
    for here in placed:
        for c, lines in here.items():
            if id(lines) not in wide:
                widths[c] = max(widths.get(c, 0), *(min(WIDTH, width(x)) for x in lines), 0)
    out = []
    for here in placed:
        columns = [c for c in range(max(here) + 1) if c in used]
        for k in range(max((len(lines) for lines in here.values()), default=0)):
            cells = [(here[c][k] if c in here and k < len(here[c]) else "", widths.get(c, 0)) for c in columns]
            out.append("  ".join(text + " " * max(0, pad - width(text)) for text, pad in cells).rstrip())
    return out


def sheets_of(page: str) -> css.Sheets | None:
    """The page's own style sheets, those in comments and scripts left out; None if none of them hides anything."""
    low = page.lower()
    if "<style" not in low or "none" not in low and "hidden" not in low and "collapse" not in low:
        return None
    found = []
    for m in _SHEET.finditer(page):
        if m["sheet"] is not None:
            media = re.search(r"\bmedia\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", m["head"], re.IGNORECASE)
            found.append((next((g for g in media.groups() if g is not None), "") if media else "", m["sheet"]))
    sheets = css.Sheets(found)
    return sheets if sheets.by else None


def _number(text: str | None, default: int, least: int, most: int) -> int:
    m = re.match(r"\s*(-?\d{1,9})", text or "")
    return max(least, min(most, int(m[1]))) if m else default


def render(page: str | None) -> str:
    """All visible text of a page; "" for null, empty and textless pages.

    Blocks begin lines; paragraphs, headings, lists and the like have an empty line
    around them; list items have bullets or numbers and are indented by level;
    cells of a table's columns are aligned; pre keeps its white space; a list box
    shows all options, another select the chosen one. Left out: heads, scripts,
    styles, comments, what the cascade of style attributes, the page's own style
    sheets (selectors as in css) and the hidden attribute gives display: none or
    leaves invisible, closed details and dialogs, and contents that stand in for
    media.
    """
    if not page:
        return ""
    sheets = sheets_of(page)
    root = css.Element("html", {}, None)
    body = root.open("body", {})
    elements = [body]  # beside stack, where there are sheets
    out = Lines()
    contexts: list[tuple] = []  # what tables and cells put aside
    lists: list[list] = []  # [kind, next number]
    hidden = 0  # open elements inside something that takes no part in the layout
    invisible: list[bool] = [False]
    stack: list[tuple[str, bool, str]] = []  # tag, hidden, indent before
    pre = 0
    select: list[list] = []  # [whether one is chosen, now in an option that shows, its text, whether all show]
    details: list[bool] = []  # whether the contents show
    for kind, name, attributes in tree(page):
        if kind == "text":
            if hidden or invisible[-1] or details and not details[-1] and stack[-1][0] == "details":
                continue
            if select and not (select[-1][3] and select[-1][1]):
                if select[-1][1]:
                    select[-1][2].append(name)
                continue
            if contexts and contexts[-1][0] == "table" and not name.strip():
                continue
            if pre:
                out.kept(name.replace("\r\n", "\n").replace("\r", "\n"))
            else:
                out.text(name)
            continue
        if kind == "open":
            a = attributes or {}
            given: dict[str, str] = {}
            if sheets:
                if name in ("html", "body"):
                    one = root if name == "html" else body
                    one.attributes.update(a)
                    one.classes = frozenset(one.attributes.get("class", "").split())
                else:
                    one = (root if name == "head" else elements[-1]).open(name, a)
                if not hidden:
                    given = sheets.style(one)
                if name not in VOID:
                    elements.append(body if name in ("html", "body") else one)
            elif "style" in a:
                given = {p: value for p, (_, value) in css.declarations(a["style"]).items()}
            by_default = "hidden" in a and a["hidden"].lower() != "until-found" or name == "dialog" and "open" not in a
            display = given.get("display", "revert")
            hide = hidden > 0 or name in NEVER or name == "input" and a.get("type", "").lower() == "hidden" or display == "none" or by_default and display.startswith("revert") or given.get("content-visibility") == "hidden"
            visibility = given.get("visibility", "inherit")
            seen = visibility in ("hidden", "collapse") or invisible[-1] and visibility not in ("visible", "initial")
            if not hide and details and not details[-1] and name != "summary" and stack and stack[-1][0] == "details":
                hide = True
            if name not in VOID:
                stack.append((name, hide, out.indent))
                invisible.append(seen)
            if hide:
                hidden += name not in VOID
                continue
            if name == "br":
                if not seen:
                    out.newline()
            elif name == "hr":
                out.block(2)
            elif name == "details":
                details.append("open" in a)
                out.block(1)
            elif name in ("ul", "ol", "menu", "dir"):
                out.block(1 if lists else 2)
                lists.append([name, _number(a.get("start"), 1, -(10**9), 10**9)])
            elif name == "li":
                out.block(1)
                if lists and lists[-1][0] == "ol":
                    lists[-1][1] = _number(a.get("value"), lists[-1][1], -(10**9), 10**9)
                    marker = f"{lists[-1][1]}. "
                    lists[-1][1] += 1
                else:
                    marker = "• "
                depth = min(sum(1 for _ in lists), 20)
                out.indent = stack[-1][2] if depth < 2 else stack[-1][2] + "  "
                out.marker = marker
            elif name == "dd":
                out.block(1)
                out.indent = stack[-1][2] + "  "
            elif name == "blockquote":
                out.block(2)
                out.indent = stack[-1][2] + "  "
            elif name == "table":
                out.block(1)
                contexts.append(("table", out, [], lists, pre))
                out, lists, pre = Lines(), [], 0
            elif name in ("tr", "td", "th", "caption") and contexts:
                if name == "tr" and contexts[-1][0] == "table":
                    contexts[-1][2].append([])
                elif name in ("td", "th") and contexts[-1][0] == "table" and contexts[-1][2]:
                    contexts.append(("cell", out, a, lists, pre))
                    out, lists, pre = Lines(), [], 0
                elif name == "caption":
                    out.block(1)
            elif name in ("pre", "textarea", "listing", "xmp", "plaintext"):
                if name != "textarea":
                    out.block(2)
                pre += 1
            elif name == "select":
                every = "multiple" in a or _number(a.get("size"), 1, 0, 10**6) > 1
                if every:
                    out.block(1)
                select.append([None, False, [], every])
            elif name == "optgroup" and select and select[-1][3]:
                out.block(1)
                if not seen:
                    out.text(a.get("label", ""))
            elif name == "option" and select and select[-1][3]:
                out.block(1)
                select[-1][1] = True
            elif name == "option" and select:
                chosen = "selected" in a
                first = select[-1][0] is None
                select[-1][1] = chosen or first
                if chosen or first:
                    select[-1][0] = True
                    select[-1][2] = []
            elif name == "input":
                if a.get("type", "text").lower() in ("text", "submit", "button", "reset", "email", "search", "tel", "url", "number") and not seen:
                    out.text(f" {a.get('value') or a.get('placeholder') or ''} ")
            elif name in SPACED:
                out.block(2)
            elif name in BLOCK:
                out.block(1)
            continue
        # close
        if name in VOID or not stack:
            continue
        _, was_hidden, indent = stack.pop()
        invisible.pop()
        if sheets:
            elements.pop()
        if was_hidden:
            hidden -= 1
            continue
        if name == "details":
            details.pop()
            out.block(1)
        elif name in ("ul", "ol", "menu", "dir"):
            if lists:
                lists.pop()
            out.block(1 if lists else 2)
        elif name in ("li", "dd"):
            out.marker, out.indent = "", indent
            out.block(1)
        elif name == "blockquote":
            out.indent = indent
            out.block(2)
        elif name in ("td", "th") and contexts and contexts[-1][0] == "cell":
            cell = out.done()
            _, out, a, lists, pre = contexts.pop()
            contexts[-1][2][-1].append((cell, _number(a.get("colspan"), 1, 1, SPAN), _number(a.get("rowspan"), 1, 1, SPAN)))
        elif name == "table" and contexts and contexts[-1][0] == "table":
            above = out.done()  # the caption, and text between rows
            _, out, rows, lists, pre = contexts.pop()
            lines = above + grid(rows)
            out.block(2)
            if lines:
                out.kept("\n".join(out.indent + x if i else x for i, x in enumerate(lines)))
            out.block(2)
        elif name in ("pre", "textarea", "listing", "xmp", "plaintext"):
            pre -= 1
            if name != "textarea":
                out.block(2)
        elif name == "option" and select:
            select[-1][1] = False
            if select[-1][3]:
                out.block(1)
        elif name == "select" and select:
            _, _, text, every = select.pop()
            text = "".join(text)
            if every:
                out.block(1)
            elif not select and not invisible[-1]:
                out.text(f" {text} ")
        elif name in SPACED:
            out.block(2)
        elif name in BLOCK:
            out.block(1)
    return "\n".join(out.done()).replace("\xa0", " ")


def extract(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """id_col and text (the visible text of html_col) for each row of pages; other columns aren't read.

    A null, empty or textless page has the text "". Rows that repeat an id or have
    none keep a row each; an empty table has no rows.
    """
    bound_batches(pages.sparkSession)
    kind = pages.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                part = batch.slice(lo, 256)
                texts = [render(x.as_py()) for x in part.column(1)]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(texts, pa.string())], names=[id_col, "text"])

    return pages.select(id_col, F.col(html_col).cast("string")).mapInArrow(run, f"`{id_col}` {kind}, text string")
