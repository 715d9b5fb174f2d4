"""HTML extraction: all visible text of a page, laid out as a page shows it."""

from __future__ import annotations

import html
import re
import unicodedata
from bisect import bisect_right
from collections import defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from colweave.llm.common import map_batches, rows_of, table, type_of

#: What ends or changes a run of plain characters within a tag; where a tag's name ends; where a comment ends.
SPECIAL = re.compile(r"[>\"'=]")
NAME_ENDS = re.compile(r"[\s/>]")
COMMENT_ENDS = re.compile("--!?>")
ATTRIBUTE = re.compile(r"([^\s=/\"'>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")
SPACES = re.compile(r"[ \t\n\r\f]+")
DISPLAY = re.compile(r"(?:^|;)\s*display\s*:\s*([a-z-]+)", re.I)
VISIBILITY = re.compile(r"(?:^|;)\s*visibility\s*:\s*([a-z]+)", re.I)
STYLE = re.compile(r"<style\b[^<>]*>(.*?)(?:</style\s*>|\Z)", re.S | re.I)
SELECTOR = re.compile(r"([a-z][a-z0-9]*|\*)?((?:[.#][\w-]+)*)", re.I)
#: Characters that a page doesn't show where no line is broken.
UNSHOWN = {0xAD: None, 0x200B: None}

#: Columns that indents take at most, and that a cell keeps free for those beside it in other rows: else a few deep lists, or one long cell, would fill pages with spaces.
DEEPEST, WIDEST = 80, 400

# Fixed values of the HTML standard, by name.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = set("script style xmp iframe noembed noframes".split())
TEXT_ONLY = set("textarea title".split())
UNSEEN = set("head title script style template rp noscript iframe noembed noframes datalist object audio video canvas svg annotation annotation-xml area base link meta param source track".split())
SPACED = set("p h1 h2 h3 h4 h5 h6 ul ol menu dl blockquote pre listing plaintext xmp table figure fieldset form hr".split())
BLOCK = SPACED | set("html body div section article aside nav header footer main address details summary figcaption legend li dt dd center dir hgroup search option optgroup caption".split())
ENDS_P = (BLOCK - {"option", "optgroup", "legend", "caption", "html", "body"}) | {"hr"}
CELLS = {"td", "th"}
ROWS = {"tr"}
GROUPS = {"thead", "tbody", "tfoot"}
LISTS = {"ul", "ol", "menu", "dir"}
FOREIGN = {"svg", "math"}
RUBY = {"rt", "rp", "rb", "rtc"}
BUTTONS = {"submit", "reset", "button"}


def width(s: str) -> int:
    """Columns that a text takes: wide characters two, marks on others none."""
    if s.isascii():
        return len(s)
    return sum(0 if unicodedata.combining(c) else 2 if unicodedata.east_asian_width(c) in "WF" else 1 for c in s)


def styles(page: str) -> list[tuple[str, frozenset[str], str, str]]:
    """(tag or *, classes and ids, display, visibility) of the page's own rules that say how elements are shown, by single selectors without ancestors; rules for other media than screens are left out."""
    out = []
    for m in STYLE.finditer(page):
        css = re.sub(r"/\*.*?(?:\*/|\Z)", " ", m[1], flags=re.S)
        css = re.sub(r"@(?!media\s+(?:all|screen)\s*\{)[\w-]++[^{;@]*+(?:;|\{(?:[^{}]*+\{[^{}]*+\})*+[^{}]*+\})", " ", css)
        css = re.sub(r"@media\s+(?:all|screen)\s*\{((?:[^{}]*+\{[^{}]*+\})*+[^{}]*+)\}", r"\1", css, flags=re.I)
        for part in css.split("}")[:-1]:
            before, brace, body = part.rpartition("{")
            display, visibility = ((f.search(body) or ["", ""])[1].lower() for f in (DISPLAY, VISIBILITY)) if brace else ("", "")
            if display or visibility:
                for one in map(str.strip, before.rpartition("{")[2].split(",")):
                    parts = SELECTOR.fullmatch(one)
                    if one and parts:
                        out.append(((parts[1] or "*").lower(), frozenset(re.findall(r"[.#][\w-]+", parts[2])), display, visibility))
    return out


class Tags:
    """Comments and tags of a page, one after another: each character is looked at a bounded number of times, however broken the page is.

    A comment ends at `-->` or `--!>`, one that starts with `>` or `->` there; an open one goes to the page's end. A quote opens an attribute's value only behind `=`, and only if it is closed
    somewhere. What looks like a tag and never ends is text.
    """

    def __init__(self, page: str):
        self.page, self.last = page, page.rfind(">")
        self.plain = (0, -1)  # between these places the next special character is at the second
        self.unclosed: set[str] = set()  # quotes that don't come again
        self.dead: bytearray | None = None  # special characters behind which, outside quotes, no tag ends

    def special(self, at: int) -> int:
        lo, hi = self.plain
        if not lo <= at <= hi:
            found = SPECIAL.search(self.page, at)
            self.plain = (at, found.start() if found else len(self.page))
        return self.plain[1]

    def tag_end(self, at: int) -> int:
        """The place of the `>` that ends a tag whose attributes start here, or -1."""
        page, n, passed = self.page, len(self.page), []
        while True:
            at = self.special(at)
            if at >= n or self.dead is not None and self.dead[at]:
                self.dead = self.dead or bytearray(n)
                for i in passed:
                    self.dead[i] = 1
                return -1
            c = page[at]
            if c == ">":
                return at
            passed.append(at)
            at += 1
            if c == "=":
                while at < n and page[at].isspace():
                    at += 1
                if at < n and (quote := page[at]) in "\"'" and quote not in self.unclosed:
                    close = page.find(quote, at + 1)
                    if close < 0:
                        self.unclosed.add(quote)
                    at = close + 1 if close >= 0 else at + 1

    def next(self, at: int) -> tuple[int, int, str, str, str] | None:
        """(start, end, kind, name, attributes) of the next comment or tag: kind is `/` for an end tag, `<` for a start tag, `!` for anything that isn't shown."""
        page = self.page
        while (start := page.find("<", at)) >= 0 and start < self.last:
            c = page[start + 1]
            if page.startswith("<!--", start):
                if page.startswith((">", "->"), start + 4):
                    return start, page.index(">", start) + 1, "!", "", ""
                end = COMMENT_ENDS.search(page, start + 4)
                return start, end.end() if end else len(page), "!", "", ""
            if c in "!?" or c == "/" and not (page[start + 2].isascii() and page[start + 2].isalpha()):
                return start, page.index(">", start) + 1, "!", "", ""
            if c == "/":
                end = page.index(">", start)
                return start, end + 1, "/", page[start + 2 : NAME_ENDS.search(page, start + 2).start()].lower(), ""
            if c.isascii() and c.isalpha():
                named = NAME_ENDS.search(page, start + 1).start()
                end = self.tag_end(named)
                if end >= 0:
                    return start, end + 1, "<", page[start + 1 : named].lower(), page[named:end]
            at = start + 1
        if start >= 0 and (start := page.find("<!--", start)) >= 0:  # behind the last `>`: only an open comment ends the text
            return start, len(page), "!", "", ""
        return None


class Flow:
    """Lines of text: of the page, or of one table cell."""

    def __init__(self):
        self.lines: list[str] = []
        self.now: list[str] = []
        self.space = False  # white space seen behind what stands in the line
        self.gap = 0  # what has to stand before the next line: 1 a line's end, 2 an empty line
        self.indent = 0
        self.marker = ""

    def text(self, s: str) -> None:
        words = SPACES.split(s)
        if len(words) > 1 and not words[0]:
            self.space = True
        for w in words:
            if w:
                if self.now and self.space:
                    self.now.append(" ")
                self.now.append(w)
                self.space = True
        if words and words[-1]:
            self.space = False

    def verbatim(self, s: str) -> None:
        first, *rest = s.replace("\r\n", "\n").split("\n")
        if first:
            self.now.append(first)
        for line in rest:
            self.end(keep=True)
            if line:
                self.now.append(line)

    def end(self, keep: bool = False) -> None:
        """End the line; an empty one stands only with keep."""
        if self.now or keep or self.marker and self.gap < 0:
            if self.gap == 2 and self.lines:
                self.lines.append("")
            self.gap = 0
            lead = " " * max(0, min(self.indent, DEEPEST) - len(self.marker)) + self.marker if self.now else ""
            self.lines.append((lead + "".join(self.now)).rstrip())
            self.now, self.marker = [], self.marker if not lead and not self.now else ""
        self.space = False

    def part(self, gap: int) -> None:
        self.end()
        self.gap = max(self.gap, gap)

    def put(self, lines: list[str]) -> None:
        for line in lines:
            self.now = [line]
            self.end(keep=True)


class Table:
    def __init__(self):
        self.rows: list[list[tuple[int, int, list[str]]]] = []  # cells: columns, rows, lines
        self.caption: list[str] = []

    def placed(self) -> list[list[tuple[int, int, list[str]]]]:
        """For each row its cells (first column, columns, lines); a cell of several rows keeps its columns free in the rows below."""
        out, taken = [], {}  # column: rows it is taken for yet
        for row in self.rows:
            at, cells, below = 0, [], {}
            for columns, rows, lines in row:
                while taken.get(at, 0):
                    at += 1
                cells.append((at, columns, lines))
                if rows > 1:
                    below.update(dict.fromkeys(range(at, at + columns), rows))
                at += columns
            taken = {c: n - 1 for c, n in {**taken, **below}.items() if n > 1}
            out.append(cells)
        return out

    def lines(self) -> list[str]:
        """Rows with their cells side by side: a column is as wide as its widest cell, two spaces apart."""
        widths: list[int] = []
        rows = self.placed()
        for row in rows:
            for at, span, lines in row:
                widths += [0] * (at + span - len(widths))
                if span == 1:
                    widths[at] = max([widths[at], *map(width, lines)])
        starts = [0]
        for w in widths:
            starts.append(starts[-1] + min(w, WIDEST) + 2)
        out = list(self.caption)
        for row in rows:
            for i in range(max([len(lines) for _, _, lines in row], default=0)):
                line, end = "", 0
                for at, _, lines in row:
                    cell = lines[i] if i < len(lines) else ""
                    if cell:
                        line += " " * (max(starts[at], end + 2 if line else 0) - end) + cell
                        end = max(starts[at], end + 2 if end else 0) + width(cell)
                out.append(line.rstrip())
        return [x for x in out if x]


class Builder:
    """Opens and closes elements as the standard's tree construction does in the cases that matter for text, and lays them out while it does."""

    def __init__(self, rules: list[tuple[str, frozenset[str], str, str]] = ()):
        self.open: list[tuple[str, int, bool, object]] = []  # name, by how much it hides what is in it, whether text was shown before it, what its end needs
        self.places: dict[str, list[int]] = defaultdict(list)  # where in `open` the elements of a name are
        self.hidden, self.shown = 0, True  # elements that take no part in the layout; visibility, which an element inside may change
        self.rules: dict[str, list[tuple]] = defaultdict(list)  # by one of a rule's marks, or its tag
        for i, rule in enumerate(rules):
            self.rules[min(rule[1], default=rule[0])].append((i, *rule))
        self.fresh_pre = False
        self.flows = [Flow()]
        self.tables: list[Table] = []
        self.lists: list[int | None] = []
        self.pre = 0

    # elements

    def start(self, name: str, attributes: str) -> None:
        if name in ENDS_P and self.count("p"):
            self.close_to({"p"}, CELLS | {"table", "button", "object"})
        if name == "li":
            self.close_to({"li"}, LISTS | CELLS | {"table"})
        elif name in ("dt", "dd"):
            self.close_to({"dt", "dd"}, {"dl"} | CELLS | {"table"})
        elif name in RUBY:
            self.close_to(RUBY, {"ruby", "table"} | CELLS)
        elif name in ("option", "optgroup"):
            self.close_to({"option"} if name == "option" else {"option", "optgroup"}, {"select", "datalist", "table"})
        elif name in CELLS:
            if not self.tables:
                return self.flows[-1].part(1)  # a cell without a table is a break
            self.close_to(CELLS, ROWS | {"table"})
            if not self.inside("tr", {"table"}):
                self.start("tr", "")
        elif name == "tr":
            if not self.tables:
                return self.flows[-1].part(1)
            self.close_to(ROWS, GROUPS | {"table"})
        elif name in GROUPS or name in ("caption", "colgroup"):
            if not self.tables:
                return None
            self.close_to(GROUPS | {"caption", "colgroup"} | ROWS, {"table"})
        elif name == "body":
            self.close_to({"head"}, {"html"})
            if self.flows[0].now or self.flows[0].lines:
                return None  # text has opened the body
        elif self.count("head") and self.open[-1][0] == "head" and name not in UNSEEN and name not in ("html", "head"):
            self.close_to({"head"}, {"html"})
        values = dict_of(attributes) if attributes.strip(" /\t\n") else {}
        display, visibility = self.style(name, values)
        hides = name in UNSEEN or "hidden" in values and not display or display == "none" or name == "input" or name == "dialog" and "open" not in values
        if name in VOID:
            if not self.hidden and not hides and self.shown:
                self.void(name)
            elif name == "input" and not self.hidden and self.shown and "hidden" not in values and display != "none" and values.get("type", "").lower() in BUTTONS:
                self.flows[-1].text(values.get("value", ""))  # what a button says
            return None
        parent, shown = self.open[-1][0] if self.open else "", self.shown
        if self.count("svg") and name in ("text", "foreignobject") or name == "summary" and parent == "details" and self.open[-1][1]:
            hides = -1  # what is shown of a drawing, or of details that are closed
        laid = not self.hidden + min(0, int(hides)) and hides <= 0
        self.shown = {"visible": True, "hidden": False, "collapse": False}.get(visibility, shown)
        kept = self.begin(name, values) if laid else None
        if name == "details" and "open" not in values:
            hides = int(hides) + 1
        self.places[name].append(len(self.open))
        self.open.append((name, int(hides), shown, kept))
        self.hidden += int(hides)
        if attributes.endswith("/") and (name in FOREIGN or self.count("svg") or self.count("math")):
            self.pop()
        return None

    def style(self, name: str, values: dict[str, str]) -> tuple[str, str]:
        """display and visibility of an element by the page's rules, later ones first, and its own style before these."""
        display, visibility = "", ""
        if self.rules:
            marks = {f".{c}" for c in values.get("class", "").split()} | {f"#{values['id']}" for _ in "1" if "id" in values}
            for _, tag, needed, d, v in sorted((r for k in {"*", name, *marks} if k in self.rules for r in self.rules[k]), key=lambda r: r[0]):
                if tag in ("*", name) and needed <= marks:
                    display, visibility = d or display, v or visibility
        if "style" in values:
            d, v = ((f.findall(values["style"]) or [""])[-1].lower() for f in (DISPLAY, VISIBILITY))
            display, visibility = d or display, v or visibility
        return display, visibility

    def void(self, name: str) -> None:
        flow = self.flows[-1]
        if name == "br":
            flow.end(keep=True) if flow.now or not flow.gap else None
        elif name == "hr":
            flow.part(2)

    def begin(self, name: str, values: dict[str, str]):
        """The layout at an element's start; what it returns goes to finish()."""
        flow = self.flows[-1]
        if name in CELLS or name == "caption":
            self.flows.append(Flow())
            return max(1, min(1000, number(values.get("colspan"), 1))), max(1, min(65534, number(values.get("rowspan"), 1)))
        if name == "tr":
            self.tables[-1].rows.append([])
            return True
        if name in LISTS:
            flow.part(1 if self.lists else 2)
            back = "reversed" in values
            self.lists.append([number(values.get("start"), number(values.get("reversed"), 1) if back else 1), -1 if back else 1] if name == "ol" else None)
            flow.indent += 2
            return flow
        if name in SPACED:
            flow.part(2)
        elif name in BLOCK:
            flow.part(1)
        if name == "table":
            self.tables.append(Table())
        elif name == "li":
            own = self.lists[-1] if self.lists else None
            if own is not None:
                nth = number(values.get("value"), own[0])
                own[0] = nth + own[1]
            flow.marker = "- " if own is None else f"{nth}. "
        elif name in ("dd", "blockquote"):
            flow.indent += 2
        elif name in ("pre", "listing", "plaintext", "xmp"):
            self.pre += 1
            self.fresh_pre = name in ("pre", "listing")
        return flow

    def finish(self, name: str, kept) -> None:
        if name in CELLS or name == "caption":
            flow = self.flows.pop()
            flow.end()
            if name == "caption":
                self.tables[-1].caption = flow.lines
            else:
                rows = self.tables[-1].rows
                if not rows:
                    rows.append([])
                rows[-1].append((*kept, flow.lines))
            return
        if name == "tr":
            return
        flow = kept
        if name == "table":
            flow.end()
            flow.put(self.tables.pop().lines())
            flow.part(2)
        elif name in LISTS:
            self.lists.pop()
            flow.part(1 if self.lists else 2)
            flow.indent -= 2
        elif name in ("pre", "listing", "plaintext", "xmp"):
            flow.part(2)
            self.pre -= 1
        elif name in ("dd", "blockquote"):
            flow.part(2 if name == "blockquote" else 1)
            flow.indent -= 2
        elif name in SPACED:
            flow.part(2)
        elif name in BLOCK:
            flow.part(1)
            if name == "li":
                flow.marker = ""

    def pop(self) -> None:
        name, hides, self.shown, kept = self.open.pop()
        self.places[name].pop()
        self.hidden -= hides
        if kept is not None:
            self.finish(name, kept)

    def count(self, name: str) -> int:
        return len(self.places[name]) if name in self.places else 0

    def last(self, names: set[str]) -> int:
        """The place of the innermost open element of these names, or -1."""
        return max((self.places[n][-1] for n in names if self.places.get(n)), default=-1)

    def inside(self, name: str, limits: set[str]) -> bool:
        return self.last({name}) > self.last(limits - {name})

    def close_from(self, at: int) -> None:
        while len(self.open) > at:
            self.pop()

    def close_to(self, names: set[str], limits: set[str]) -> None:
        """Close the outermost open element of `names` inside the nearest of `limits`, and all in it."""
        if not any(self.count(n) for n in names):
            return
        limit = self.last(limits - names)
        inside = (own[i] for n in names if (own := self.places.get(n)) and (i := bisect_right(own, limit)) < len(own))
        at = min(inside, default=-1)
        if at >= 0:
            self.close_from(at)

    def end(self, name: str) -> None:
        if name == "br":
            return self.start("br", "")
        if not self.count(name):
            return None
        limits = set() if name in ("table", "body", "html") else {"table"} if name in CELLS | ROWS | GROUPS else CELLS | {"table", "caption"}
        if self.inside(name, limits):
            self.close_from(self.places[name][-1])
        return None

    def text(self, s: str) -> None:
        if self.open and self.open[-1][0] == "head" and s and not s.isspace():
            self.pop()  # text ends the head
        if self.hidden or not self.shown or not s:
            return
        if self.tables and not self.inside_cell():
            if s.isspace():
                return
        s = s if self.open and self.open[-1][0] in ("plaintext", "xmp") else html.unescape(s)
        s = s.translate(UNSHOWN) if not s.isascii() else s
        if self.fresh_pre:
            s, self.fresh_pre = s.removeprefix("\r").removeprefix("\n"), False
        if not self.pre:
            s = s.replace("\xa0", " ")
        if self.pre:
            self.flows[-1].verbatim(s)
        else:
            self.flows[-1].text(s)

    def inside_cell(self) -> bool:
        return self.last(CELLS | {"caption"}) >= self.last({"table"})


def number(s: str | None, default: int) -> int:
    return int(s) if s and re.fullmatch(r"\d{1,9}", s.strip()) else default


def dict_of(attributes: str) -> dict[str, str]:
    out: dict[str, str] = {}
    for m in ATTRIBUTE.finditer(attributes):
        out.setdefault(m[1].lower(), html.unescape(m[2] or m[3] or m[4] or ""))
    return out


def items_of_lists(page: str) -> dict[int, int]:
    """For each list, by the place where its tag ends, its items without those of lists inside it."""
    out: dict[int, int] = {}
    tags, at, lists = Tags(page), 0, []
    while (found := tags.next(at)) is not None:
        _, at, kind, name, _ = found
        if name in LISTS and kind == "<":
            lists.append(at)
            out[at] = 0
        elif name in LISTS and lists:
            lists.pop()
        elif kind == "<" and name == "li" and lists:
            out[lists[-1]] += 1
    return out


def render(page: str | None) -> str:
    """The visible text of a page."""
    if not page:
        return ""
    b, at, tags = Builder(styles(page) if "<style" in page.lower() else ()), 0, Tags(page)
    items = items_of_lists(page) if re.search(r"\breversed\b", page, re.I) else {}
    while True:
        found = tags.next(at)
        if found is None:
            b.text(page[at:])
            break
        start, end, kind, name, attributes = found
        b.text(page[at:start])
        at = end
        if kind == "<":
            if name == "ol" and re.search(r"\breversed\b", attributes, re.I):
                attributes = f'{re.sub(r"(?i)\breversed\b(?:\s*=\s*(?:[^\s>\'\"]+|\'[^\']*\'|\"[^\"]*\"))?", "", attributes)} reversed="{items.get(at, 0)}"'
            b.start(name, attributes)
            if name == "plaintext":
                b.text(page[at:])
                break
            if (name in RAW or name in TEXT_ONLY) and not (attributes.endswith("/") and (b.count("svg") or b.count("math"))):
                closing = re.compile(rf"</{name}(?=[\s/>])", re.I).search(page, at)
                stop = closing.start() if closing else len(page)
                if name in TEXT_ONLY or name == "xmp":
                    b.text(page[at:stop])
                at = stop
        elif kind == "/":
            b.end(name)
    while b.open:
        b.pop()
    flow = b.flows[0]
    flow.end()
    return "\n".join(flow.lines).strip("\n")


def extract(df: DataFrame, key: str = "page_id", html_column: str = "html") -> DataFrame:
    """(key, text) of every page: all its visible text, blocks apart, list items marked, table cells aligned.

    One pass over each whole page, without recursion, in time that grows with its length, however broken it is: neither length nor depth matters. Missing end tags, rows and bodies are
    implied; elements that never show, and those that their attributes or the page's own simple rules hide, are left out, as is what closed details hold but their summary. A cell of several rows or columns keeps its places.
    Rows are independent: nothing is shuffled. Null and empty pages give an empty text; a row gives a row, repeated or with a null key, of any type; other columns aren't looked at.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.record_batch([batch.column(0), pa.array([render(x) for x in rows_of(batch, "h")], pa.string())], ["k", "text"])

    return map_batches(df.select(F.col(key).alias("k"), F.col(html_column).alias("h")), run, f"k {type_of(df, key)}, text string").withColumnRenamed("k", key)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op5: all pages."""
    out = extract(table(spark, sf_dir, "pages"))
    return out.select("page_id", "text", F.length("text").cast("long").alias("n_chars"), F.when(F.col("text") == "", 0).otherwise(F.size(F.split("text", "\n"))).cast("long").alias("n_lines"))
