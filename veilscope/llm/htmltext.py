"""HTML extraction by layout-aware rendering: all visible text, laid out as lines.

A tokenizer feeds a tree builder that knows void elements, raw-text elements, optional end tags and implied parents
(``tbody``, ``tr``). Rendering leaves out what a browser would not show on a screen: the head, scripts, templates,
``hidden`` elements, closed ``details`` and ``dialog``, and elements that ``display: none`` or ``visibility: hidden``
hides. These come from style attributes and from the rules of style sheets for simple selectors (a tag, class or id, or
a tag with one of these), by importance, specificity and order; media queries are answered for a screen of ``SCREEN``
pixels. White space collapses as in a browser, except in ``pre``; blocks begin on new lines, with a blank line where
they have margins; list items get bullets or numbers and nested lists an indent; table cells are aligned in columns.
The text elements of ``svg`` and the text of ``math`` are shown like any other.

Cases: null or empty HTML gives an empty text; broken mark-up never fails, and its text is kept; nesting beyond
``MAX_DEPTH`` is rendered as plain lines, hidden elements left out there as well; cells of any width are aligned, unless
the blanks for that were more than ``MOST_BLANKS`` times the table's text; pages of any length are rendered whole; an
empty table gives an empty result; columns other than the key, the address and the HTML are not read. Complex selectors
and a visible element within an invisible one are not told apart from their surroundings.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .shared import map_slices

# Element names of HTML by what they mean for the layout.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes noscript".split())
UNSEEN = frozenset("head title script style template noscript iframe noembed noframes datalist object audio video canvas param source track area base link meta desc defs metadata annotation annotation-xml".split())
WITH_MARGIN = frozenset("p h1 h2 h3 h4 h5 h6 ul ol dl table blockquote pre hr figure fieldset menu dir xmp".split())
BLOCK = WITH_MARGIN | frozenset("html body div section article aside header footer nav main address center form li dt dd details summary dialog figcaption legend hgroup search caption optgroup option tr td th thead tbody tfoot".split())
#: A start tag closes open elements of these names, up to the nearest of the second group.
CLOSES = {
    "li": (("li",), ("ul", "ol", "menu", "dir")),
    "dt": (("dt", "dd"), ("dl",)),
    "dd": (("dt", "dd"), ("dl",)),
    "option": (("option",), ("select", "datalist", "optgroup")),
    "optgroup": (("option", "optgroup"), ("select",)),
    "td": (("td", "th"), ("tr", "table")),
    "th": (("td", "th"), ("tr", "table")),
    "tr": (("tr", "td", "th", "caption"), ("tbody", "thead", "tfoot", "table")),
    "tbody": (("tbody", "thead", "tfoot", "tr", "td", "th", "caption", "colgroup"), ("table",)),
    "thead": (("tbody", "thead", "tfoot", "tr", "td", "th", "caption", "colgroup"), ("table",)),
    "tfoot": (("tbody", "thead", "tfoot", "tr", "td", "th", "caption", "colgroup"), ("table",)),
    "caption": (("caption",), ("table",)),
}
CLOSES_P = BLOCK - frozenset("html body tr td th thead tbody tfoot caption option optgroup".split())
SCOPE = frozenset("table td th caption html body button object template".split())

#: Media features that hold on the screen that is assumed, besides lengths (fixed values).
FEATURES = frozenset(["orientation:landscape", "prefers-color-scheme:light", "prefers-reduced-motion:no-preference", "hover", "hover:hover", "pointer", "pointer:fine", "scripting:none", "color"])
SCREEN = {"width": 1280, "height": 800}
#: The widest span that HTML allows (a fixed value).
MAX_SPAN = 1000

MAX_DEPTH = 150
MOST_BLANKS = 16

_TAG = re.compile(r"""<(/?)([a-zA-Z][^\s/>]*+)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>|<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)>""")
_ATTRIBUTE = re.compile(r"""([^\s=/>"']+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+)))?""")
_GAP = re.compile(r"[ \t\n\r\f]+")
_DECLARATION = re.compile(r"(?:^|;)\s*(display|visibility)\s*:\s*([a-z-]+)[^;!]*(!\s*important)?", re.I)
_COMMENT = re.compile(r"/\*.*?(?:\*/|\Z)", re.S)
_EDGE = re.compile(r"[{};]")
_LENGTH = re.compile(r"(?:(min|max)-)?(width|height)\s*(:|[<>]=?)\s*([\d.]+)(px|em|rem)?")
_SIMPLE = re.compile(r"\s*([a-zA-Z][\w-]*)?([.#][\w-]+)?\s*")


class Element:
    __slots__ = ("attributes", "children", "tag")

    def __init__(self, tag: str, attributes: dict[str, str] | None = None):
        self.tag, self.attributes, self.children = tag, attributes or {}, []


def _attributes(raw: str) -> dict[str, str]:
    found: dict[str, str] = {}
    for name, a, b, c in _ATTRIBUTE.findall(raw):
        value = a or b or c
        found.setdefault(name.lower(), unescape(value) if "&" in value else value)
    return found


class TreeBuilder:
    """Builds the tree from start tags, end tags and text; ``names`` counts the open elements by tag."""

    def __init__(self):
        self.root = Element("html")
        self.open = [self.root]
        self.names: Counter[str] = Counter()

    def _pop_to(self, at: int) -> None:
        at = max(1, at)
        self.names.subtract(x.tag for x in self.open[at:])
        del self.open[at:]

    def _close(self, names: tuple[str, ...], until: tuple[str, ...] | frozenset[str]) -> None:
        """Close the outermost open element of ``names`` above the nearest one of ``until``."""
        found, left = 0, sum(self.names[x] for x in names)
        for i in range(len(self.open) - 1, 0, -1) if left else ():
            if self.open[i].tag in names:
                found, left = i, left - 1
                if not left:
                    break
            elif self.open[i].tag in until:
                break
        if found:
            self._pop_to(found)

    def _push(self, element: Element) -> None:
        self.open[-1].children.append(element)
        if element.tag not in VOID:
            self.open.append(element)
            self.names[element.tag] += 1

    def start(self, tag: str, attributes: dict[str, str]) -> None:
        if tag in ("html", "body"):
            own = self.root.attributes
            for name, value in attributes.items():
                own.setdefault(name, value)
            if tag == "body":
                self._close(("head",), ("body",))
            return
        if tag in CLOSES:
            self._close(*CLOSES[tag])
        if tag in CLOSES_P:
            self._close(("p",), SCOPE)
            if tag not in ("head",):
                self._close(("head",), ("template",)) if tag in BLOCK else None
        if tag in ("td", "th") and self.open[-1].tag in ("table", "tbody", "thead", "tfoot"):
            self.start("tr", {})
        if tag == "tr" and self.open[-1].tag == "table":
            self._push(Element("tbody"))
        self._push(Element(tag, attributes))

    def end(self, tag: str) -> None:
        if tag == "br":
            self._push(Element("br"))
            return
        wall = ("table",) if tag not in ("table", "html", "body") else ()
        for i in range(len(self.open) - 1, 0, -1) if self.names[tag] else ():
            if self.open[i].tag == tag:
                self._pop_to(i)
                return
            if self.open[i].tag in wall or (self.open[i].tag in ("td", "th", "caption") and tag not in CLOSES and tag not in wall and tag != "table"):
                break
        if tag == "p":
            self.start("p", {})
            self._pop_to(len(self.open) - 1)

    def text(self, data: str) -> None:
        self.open[-1].children.append(data)


def parse(html: str) -> tuple[Element, list[str]]:
    """The tree and the texts of its style sheets."""
    builder, styles, at, end = TreeBuilder(), [], 0, len(html)
    say = lambda raw: builder.text(unescape(raw) if "&" in raw else raw)
    while at < end:
        i = html.find("<", at)
        if i < 0:
            say(html[at:])
            break
        if i > at:
            say(html[at:i])
        if html.startswith("<!--", i):
            j = html.find("-->", i + 4)
            at = end if j < 0 else j + 3
            continue
        if html[i + 1 : i + 2] in ("!", "?"):
            j = html.find(">", i)
            at = end if j < 0 else j + 1
            continue
        m = _TAG.match(html, i)
        if not m:
            say("<")
            at = i + 1
            continue
        closing, tag, raw = m.group(1, 2, 3) if m.group(2) else m.group(4, 5, 6)
        tag, at = tag.lower(), m.end()
        if closing:
            builder.end(tag)
            continue
        builder.start(tag, _attributes(raw) if raw.strip(" /") else {})
        if tag in RAW:
            stop = re.compile(rf"</{tag}[\s/>]", re.I).search(html, at)
            inner = html[at : stop.start() if stop else end]
            if tag == "style":
                styles.append(inner)
            elif tag in ("textarea", "title"):
                say(inner)
            elif tag == "xmp":
                builder.text(inner)
            at = end if not stop else stop.start()
            if builder.open[-1].tag == tag:
                builder.end(tag)
            if stop:
                j = html.find(">", at)
                at = end if j < 0 else j + 1
        elif raw.endswith("/") and tag in ("svg", "math"):
            builder.end(tag)
    return builder.root, styles


def on_screen(query: str) -> bool:
    """Whether a media query holds on a screen of the assumed size."""

    def holds(part: str) -> bool:
        part = part.strip().removeprefix("only ").strip()
        if part.startswith("not "):
            return not holds(part[4:])
        if not part.startswith("("):
            return part in ("", "all", "screen")
        feature = part.strip("() ")
        if m := _LENGTH.fullmatch(feature):
            bound, name, sign, number, unit = m.groups()
            length, own = float(number) * (16 if unit in ("em", "rem") else 1), SCREEN[name]
            if bound == "min" or sign.startswith(">"):
                return own > length if sign == ">" else own >= length
            return own < length if sign == "<" else own <= length if bound == "max" or sign == "<=" else own == length
        return feature.replace(" ", "") in FEATURES

    def all_hold(one: str) -> bool:
        inverted = one.startswith("not ") and not one.startswith("not (")
        return inverted != all(map(holds, re.split(r"\s+and\s+", one[4:] if inverted else one)))

    return any(all_hold(one.strip()) for one in query.lower().split(","))


def declared(body: str) -> dict[str, tuple[bool, bool]]:
    """For ``display`` and ``visibility``, whether the last declaration is important and whether it hides."""
    found: dict[str, tuple[bool, bool]] = {}
    for name, value, important in _DECLARATION.findall(body):
        name, strong = name.lower(), bool(important)
        if strong >= found.get(name, (False, False))[0]:
            found[name] = (strong, value.lower() in ("none", "hidden", "collapse"))
    return found


def style_rules(styles: list[str]) -> dict[tuple[str, str], list[tuple[str, tuple[bool, int, int], bool]]]:
    """By (tag, .class or #id): property, rank (importance, specificity, order) and whether the rule hides."""
    found: dict[tuple[str, str], list] = {}
    order = 0
    for style in styles:
        css, at = _COMMENT.sub(" ", style), 0
        while edge := _EDGE.search(css, at):
            prelude, at = css[at : edge.start()].strip(), edge.end()
            if edge[0] != "{":  # the end of a group or of a statement
                continue
            if prelude.startswith("@"):
                name, _, condition = prelude[1:].partition(" ")
                name = name.lower()
                if name in ("supports", "layer", "scope") or (name.startswith("media") and on_screen(condition if name == "media" else prelude[6:])):
                    continue  # what is inside counts
            depth, begin = 1, at
            while depth and (edge := _EDGE.search(css, at)):
                depth, at = depth + {"{": 1, "}": -1, ";": 0}[edge[0]], edge.end()
            if prelude.startswith("@"):
                continue
            own = declared(css[begin : at - 1 if not depth else len(css)].partition("{")[0])
            if depth:
                at = len(css)
            order += 1
            for selector in prelude.split(",") if own else ():
                if (m := _SIMPLE.fullmatch(selector)) and (m[1] or m[2]):
                    weight = bool(m[1]) + {"": 0, ".": 10, "#": 100}[(m[2] or "")[:1]]
                    found.setdefault(((m[1] or "").lower(), m[2] or ""), []).extend((name, (strong, weight, order), hides) for name, (strong, hides) in own.items())
    return found


def _wide(text: str) -> int:
    """Columns that a text takes."""
    return len(text) if text.isascii() else sum(2 if unicodedata.east_asian_width(c) in "WF" else not unicodedata.combining(c) for c in text)


class _Flow:
    """Lines of one block: text runs together until a line ends, margins of neighbours collapse."""

    def __init__(self):
        self.lines: list[str] = []
        self.run: list[str] = []
        self.space, self.margin = False, 0

    def text(self, data: str, pre: bool) -> None:
        if pre:
            first, *rest = data.replace("\r\n", "\n").split("\n")
            self.run.append(first)
            for line in rest:
                self.newline(True)
                self.run.append(line)
            return
        data = _GAP.sub(" ", data)
        if data[:1] == " ":
            self.space, data = bool(self.run), data[1:]
        if data:
            if self.space:
                self.run.append(" ")
            self.space = data[-1] == " "
            self.run.append(data[:-1] if self.space else data)

    def _emit(self, lines: list[str]) -> None:
        if self.margin and self.lines:
            self.lines.append("")
        self.margin = 0
        self.lines += lines

    def newline(self, forced: bool) -> None:
        """End the line; an empty one only counts if it is forced."""
        line = "".join(self.run).replace("\xa0", " ").rstrip()
        if line or (forced and (self.run or self.lines)):
            self._emit([line])
        self.run, self.space = [], False

    def block(self, lines: list[str], margin: int) -> None:
        self.newline(False)
        self.margin = max(self.margin, margin)
        if lines:
            self._emit(lines)
            self.margin = margin


class Renderer:
    def __init__(self, rules: dict[tuple[str, str], list[tuple[str, tuple[bool, int, int], bool]]]):
        self.rules, self.depth = rules, 0

    def hidden(self, e: Element) -> bool:
        if e.tag in UNSEEN:
            return True
        a = e.attributes
        if not a and not self.rules:
            return e.tag == "dialog"
        if e.tag == "input" and a.get("type", "").lower() == "hidden":
            return True
        ranked = [("display", (False, -1, 0), "hidden" in a or (e.tag == "dialog" and "open" not in a))]
        if "style" in a:
            ranked += [(name, (strong, 1000, 0), hides) for name, (strong, hides) in declared(a["style"]).items()]
        if self.rules:
            marks = ["", *(f".{c}" for c in a.get("class", "").split()), *([f"#{a['id']}"] if a.get("id") else [])]
            for tag in (e.tag, ""):
                for mark in marks:
                    ranked += self.rules.get((tag, mark), ())
        return any(max((x[1:] for x in ranked if x[0] == name), default=(None, False))[1] for name in ("display", "visibility"))

    def lines(self, e: Element, pre: bool = False) -> list[str]:
        flow = _Flow()
        self.walk(e, flow, pre)
        flow.newline(False)
        return flow.lines

    def walk(self, e: Element, flow: _Flow, pre: bool) -> None:
        for child in e.children:
            if isinstance(child, str):
                flow.text(child, pre)
            elif not self.hidden(child):
                self.depth += 1
                if self.depth > MAX_DEPTH:
                    self.flat(child, flow, pre)
                else:
                    self.element(child, flow, pre, e.tag)
                self.depth -= 1

    def flat(self, e: Element, flow: _Flow, pre: bool) -> None:
        """What nests deeper than is laid out: each block on lines of its own, without recursion."""
        stack: list[tuple[Element | str, bool, bool]] = [(e, False, pre)]
        while stack:
            node, over, pre = stack.pop()
            if isinstance(node, str):
                flow.text(node, pre)
            elif over:
                flow.newline(False)
            elif node is e or not self.hidden(node):
                if node.tag in ("br", "input"):
                    self.element(node, flow, pre, "")
                    continue
                if node.tag in BLOCK:
                    flow.newline(False)
                    stack.append((node, True, pre))
                inner = node.children
                if node.tag == "svg":
                    inner = self.svg_texts(node)
                elif node.tag == "details" and "open" not in node.attributes:
                    inner = [c for c in inner if isinstance(c, Element) and c.tag == "summary"][:1]
                stack += [(c, False, pre or node.tag in ("pre", "xmp", "textarea")) for c in reversed(inner)]

    def svg_texts(self, e: Element) -> list[Element]:
        """The elements of a picture that hold text to be shown."""
        found, stack = [], [e]
        while stack:
            node = stack.pop()
            if node.tag in ("text", "foreignobject"):
                found.append(node)
            else:
                stack += [c for c in reversed(node.children) if isinstance(c, Element) and not self.hidden(c)]
        return found

    def element(self, e: Element, flow: _Flow, pre: bool, parent: str) -> None:
        tag = e.tag
        if tag == "br":
            flow.newline(True)
        elif tag == "hr":
            flow.block(["---"], 1)
        elif tag in ("ul", "ol", "menu", "dir"):
            flow.block(self.list(e, pre), int(parent != "li"))
        elif tag == "table":
            flow.block(self.table(e), 1)
        elif tag == "li":
            flow.block(_hang("- ", self.lines(e, pre)), 0)
        elif tag in ("dd", "blockquote"):
            flow.block(["  " + x if x else x for x in self.lines(e, pre)], int(tag == "blockquote"))
        elif tag in ("pre", "xmp", "textarea"):
            flow.block(self.lines(e, True), int(tag != "textarea"))
        elif tag == "details" and "open" not in e.attributes:
            for child in e.children:
                if isinstance(child, Element) and child.tag == "summary" and not self.hidden(child):
                    flow.block(self.lines(child, pre), 0)
                    break
        elif tag in BLOCK:
            flow.block(self.lines(e, pre), int(tag in WITH_MARGIN))
        elif tag == "svg":
            for part in self.svg_texts(e):
                flow.text(" ", pre)
                self.walk(part, flow, pre)
                flow.text(" ", pre)
        elif tag == "input":
            if e.attributes.get("type", "text").lower() in ("button", "submit", "reset", "text", "search", "email", "url", "tel", "number"):
                flow.text(e.attributes.get("value", ""), pre)
        else:
            self.walk(e, flow, pre)

    def list(self, e: Element, pre: bool) -> list[str]:
        out, number = [], 1
        if e.tag == "ol" and re.fullmatch(r"-?\d{1,9}", e.attributes.get("start", "")):
            number = int(e.attributes["start"])
        loose = Element("li")
        for child in [*e.children, None]:
            if isinstance(child, Element) and child.tag == "li" or child is None:
                out += ["  " + x if x else x for x in self.lines(loose, pre)]
                loose = Element("li")
            if child is None or (isinstance(child, Element) and self.hidden(child)):
                continue
            if isinstance(child, Element) and child.tag == "li":
                out += _hang(f"{number}. " if e.tag == "ol" else "- ", self.lines(child, pre))
                number += 1
            else:
                loose.children.append(child)
        return out

    def table(self, e: Element) -> list[str]:
        captions, rows, loose = [], [], []
        stack = [e]
        while stack:
            part = stack.pop()
            if part.tag == "tr":
                rows.append([c for c in part.children if isinstance(c, Element) and c.tag in ("td", "th") and not self.hidden(c)])
                loose += [c for c in part.children if not (isinstance(c, Element) and c.tag in ("td", "th"))]
                continue
            inner = []
            for c in part.children:
                if isinstance(c, Element) and c.tag in ("thead", "tbody", "tfoot", "tr"):
                    if not self.hidden(c):
                        inner.append(c)
                elif isinstance(c, Element) and c.tag == "caption":
                    if not self.hidden(c):
                        captions += self.lines(c)
                else:
                    loose.append(c)
            stack += inner[::-1]
        grid, widths = [], []
        for cells in rows:
            row, column = [], 0
            for cell in cells:
                lines = self.lines(cell)
                span = cell.attributes.get("colspan", "1")
                span = min(int(span), MAX_SPAN) if re.fullmatch(r"\d{1,4}", span) and int(span) else 1
                row.append((column, lines))
                if span == 1:
                    widths += [0] * (column + 1 - len(widths))
                    widths[column] = max(widths[column], max(map(_wide, lines), default=0))
                column += span
            grid.append(row)
        size, most = sum(len(x) for row in grid for _, lines in row for x in lines), max(widths, default=0)
        while True:
            starts = [0]
            for w in widths:
                starts.append(starts[-1] + min(w, most) + 2 * (w > 0))
            blanks = sum(starts[min(row[-1][0], len(starts) - 1)] * max(len(lines) for _, lines in row) for row in grid if row)
            if blanks <= MOST_BLANKS * (size + 1000) or most <= 1:
                break
            most //= 2
        out = list(captions)
        outside = Element("div")
        outside.children = loose  # text between cells is shown above its table
        out += self.lines(outside)
        for row in grid:
            for i in range(max((len(lines) for _, lines in row), default=0)):
                line, used = "", 0
                for column, lines in row:
                    if i < len(lines) and lines[i]:
                        gap = (starts[min(column, len(starts) - 1)] if column else 0) - used
                        gap = max(gap, 2 if line else 0)
                        line += " " * gap + lines[i]
                        used += gap + _wide(lines[i])
                out.append(line)
        return out


def _hang(mark: str, lines: list[str]) -> list[str]:
    indent = " " * len(mark)
    return [mark + lines[0], *(indent + x if x else x for x in lines[1:])] if lines else []


def render(html: str | None) -> str:
    """All visible text of a page."""
    if not html:
        return ""
    tree, styles = parse(html)
    return "\n".join(Renderer(style_rules(styles)).lines(tree)).strip("\n")


def extract(df: DataFrame, key: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """Key, address, visible ``text`` and its length ``n_chars``."""
    schema = pa.schema([("key", to_arrow_type(df.schema[key].dataType)), ("url", pa.string()), ("text", pa.string()), ("n_chars", pa.int64())])

    def run(rows: dict[str, list]) -> dict[str, list]:
        texts = [render(x) for x in rows["html"]]
        return {"key": rows["key"], "url": rows["url"], "text": texts, "n_chars": list(map(len, texts))}

    plain = df.select(F.col(key).alias("key"), F.col(url).cast("string").alias("url"), F.col(html).cast("string").alias("html"))
    return map_slices(plain, run, schema, 128).withColumnRenamed("key", key)
