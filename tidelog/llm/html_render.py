"""HTML extraction by rendering: all visible text, laid out as lines.

A tokenizer feeds a tree builder that supplies the tags that HTML lets authors omit (an
open p ends before a block, an li before the next li, a td before the next td or tr, and
so on); the renderer walks the tree with a stack of line buffers:
  - blocks start new lines, paragraphs, headings, lists and tables stand between blank lines;
  - white space collapses except in pre and textarea; br breaks a line;
  - list items get "- " or their number, and what they hold is indented under it;
  - table cells stand in columns that are padded to one width, spans included;
  - elements that a browser doesn't show are left out: head, script, style, template and
    the like, the hidden attribute, display:none, visibility:hidden (which a descendant may
    undo), closed details and dialog, hidden inputs; styles count inline and from style
    elements, by the cascade, and an element that a rule which can't be judged may show is shown.

Defined results: null or empty html gives an empty text; repeated rows are rendered each;
elements nested deeper than 512 count as children of the 512th, nothing is lost; unclosed
and stray tags never fail; columns wider than ``WIDE`` aren't padded; extra columns are
carried along and a column named like a result is replaced.
"""

from __future__ import annotations

import html
import math
import re
from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Fixed values of HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
UNSEEN = frozenset("head script style template title datalist iframe noembed noframes audio video canvas annotation annotation-xml".split())
#: What an svg draws as text, and what it only defines.
DRAWN, DEFINED = frozenset("text foreignobject".split()), frozenset("defs desc metadata symbol clippath mask pattern marker".split())
BLOCK = frozenset("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre section summary table ul".split())
SPACED = frozenset("blockquote dl fieldset figure h1 h2 h3 h4 h5 h6 hr ol p pre table ul menu dir".split())
ENDS_P = BLOCK - frozenset("body html option optgroup li dd dt legend".split()) | {"li", "dd", "dt"}
CELLS, SECTIONS = frozenset(("td", "th")), frozenset(("thead", "tbody", "tfoot"))
#: tag -> (tags whose open element it ends, tags that the search stops at)
IMPLIED = {
    "li": (frozenset(("li",)), frozenset("ul ol menu dir table td th".split())),
    "dt": (frozenset(("dt", "dd")), frozenset("dl table td th".split())),
    "dd": (frozenset(("dt", "dd")), frozenset("dl table td th".split())),
    "option": (frozenset(("option",)), frozenset(("select", "datalist", "optgroup"))),
    "optgroup": (frozenset(("option", "optgroup")), frozenset(("select",))),
    "tr": (CELLS | {"tr", "caption", "colgroup"}, frozenset(("table",))),
    "td": (CELLS | {"caption"}, frozenset(("table", "tr"))),
    "th": (CELLS | {"caption"}, frozenset(("table", "tr"))),
    **{t: (CELLS | SECTIONS | {"tr", "caption", "colgroup"}, frozenset(("table",))) for t in SECTIONS},
    "rp": (frozenset(("rp", "rt")), frozenset(("ruby",))),
    "rt": (frozenset(("rp", "rt")), frozenset(("ruby",))),
}
IN_HEAD = frozenset("base basefont bgsound link meta noframes script style template title noscript".split())
DEPTH, WIDE = 512, 60

TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)")
TAG_STOP = re.compile(r"[>\"']")
ATTRIBUTE = re.compile(r"([^\s=\"'/>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
SPACES = re.compile(r"[ \t\n\f\r]+")
SHEET_TOKEN = re.compile(r"\"(?:\\.|[^\"\\\n])*\"|'(?:\\.|[^'\\\n])*'|[{};]", re.DOTALL)
SELECTOR_COMMA = re.compile(r",(?![^(]*\))")
NAME = r"(?:[\w-]|[^\x00-\x7F]|\\.)+"
PART = re.compile(rf"(?P<space>\s+)|(?P<star>\*)|\.(?P<class>{NAME})|\#(?P<id>{NAME})|\[\s*(?P<has>{NAME})\s*\]|(?P<attribute>\x02)|(?P<element>::[\w-]+\x01?|:(?:before|after|first-line|first-letter)\b)|:(?P<pseudo>[\w-]+)\x01?|(?P<tag>{NAME})")


@dataclass
class Node:
    tag: str
    attributes: dict[str, str] = field(default_factory=dict)
    children: list[Node | str] = field(default_factory=list)


class Tags:
    """Finds a page's tags from left to right, in time that grows with its length: an end that
    isn't there is looked for once."""

    def __init__(self, source: str):
        self.source, self.last = source, source.rfind(">")
        self.quotes = True  # until a quote in a tag is never closed

    def next(self, at: int) -> tuple[int, int, str, str, str] | None:
        """(start, end, "/" of an end tag, name, what follows it) from ``at`` on; comments and
        declarations have no name."""
        s = self.source
        while (at := s.find("<", at)) >= 0:
            if s.startswith("<!--", at):
                end = s.find("-->", at + 4)
                return at, len(s) if end < 0 else end + 3, "", "", ""
            if s.startswith(("<!", "<?"), at):
                end = s.find(">", at)
                return at, len(s) if end < 0 else end + 1, "", "", ""
            m = TAG.match(s, at) if at < self.last else None
            if m and (end := self._end(m.end())) >= 0:
                return at, end + 1, m[1], m[2], s[m.end() : end]
            at += 1
        return None

    def _end(self, at: int) -> int:
        """The place of the tag's ">"; one between quotes isn't it."""
        here = at
        while self.quotes and (m := TAG_STOP.search(self.source, here)):
            if m[0] == ">":
                return m.start()
            here = self.source.find(m[0], m.end()) + 1
            if not here:
                self.quotes = False
        return self.source.find(">", at)


def parse(source: str) -> tuple[Node, list[str]]:
    """The tree of a page, and the texts of its style elements."""
    root = Node("html")
    body = Node("body")
    root.children.append(body)
    head = Node("head")
    stack, styles = [body], []
    at, n, in_head = 0, len(source), False

    def text(s: str) -> None:
        if s:
            stack[-1].children.append(html.unescape(s) if "&" in s else s)

    def close_to(k: int) -> None:
        del stack[max(k, 1) :]

    def end_p() -> None:
        for k in range(len(stack) - 1, 0, -1):
            if stack[k].tag == "p":
                return close_to(k)
            if stack[k].tag in ("table", "td", "th", "button", "caption"):
                return None
        return None

    tags = Tags(source)
    while at < n:
        found = tags.next(at)
        if not found:
            if not in_head:
                text(source[at:])
            break
        start, end, slash, name, more = found
        if start > at and not (in_head and not source[at:start].strip()):
            in_head = False
            text(source[at:start])
        at = end
        if not name:
            continue
        tag = name.lower()
        if slash:
            if tag == "head":
                in_head = False
            elif tag == "p" and not any(x.tag == "p" for x in stack):
                stack[-1].children.append(Node("p"))
            elif tag == "br":
                stack[-1].children.append(Node("br"))
            elif tag not in ("html", "body"):
                stop = ("table",) if tag not in CELLS | SECTIONS | {"tr", "table"} else ()
                for k in range(len(stack) - 1, 0, -1):
                    if stack[k].tag == tag:
                        close_to(k)
                        break
                    if stack[k].tag in stop or (tag in CELLS | SECTIONS | {"tr"} and stack[k].tag == "table"):
                        break
            continue
        attributes = {a[1].lower(): html.unescape(a[2] or a[3] or a[4] or "") for a in ATTRIBUTE.finditer(more)} if more else {}
        if tag == "head":
            in_head = True
            continue
        if tag in ("html", "body"):
            (root if tag == "html" else body).attributes.update(attributes)
            in_head = in_head and tag == "html"
            continue
        foreign = more.rstrip().endswith("/") and any(x.tag in ("svg", "math") for x in stack)  # svg and math elements may end themselves
        if foreign and tag in RAW:
            continue
        if tag in RAW:
            close = re.compile(rf"</{tag}(?=[\s/>]|\Z)[^>]*>?", re.IGNORECASE).search(source, at)
            inner = source[at : close.start() if close else n]
            at = close.end() if close else n
            if tag == "style":
                if (held := _holds(attributes.get("media", ""))) is not False and attributes.get("type", "text/css").lower() in ("", "text/css"):
                    styles.append(inner if held else f"@supports (x) {{{inner}")  # a condition that can't be judged
            elif tag == "textarea":
                stack[-1].children.append(Node(tag, attributes, [html.unescape(inner.removeprefix("\n"))]))
            elif tag == "xmp":
                stack[-1].children.append(Node("pre", attributes, [inner]))
            continue
        if in_head and tag not in IN_HEAD:
            in_head = False
        if in_head:
            head.children.append(Node(tag, attributes))
            continue
        if tag in ENDS_P:
            end_p()
        if tag in ("h1", "h2", "h3", "h4", "h5", "h6") and re.fullmatch("h[1-6]", stack[-1].tag):
            close_to(len(stack) - 1)
        if tag in IMPLIED:
            ended, stop = IMPLIED[tag]
            low = None
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].tag in stop:
                    break
                if stack[k].tag in ended:
                    low = k
            if low is not None:
                close_to(low)
            if tag in CELLS and stack[-1].tag in SECTIONS | {"table"}:
                stack[-1].children.append(row := Node("tr"))
                stack.append(row)
        node = Node(tag, attributes)
        stack[-1].children.append(node)
        if tag not in VOID and not foreign and len(stack) < DEPTH:
            stack.append(node)
    return root, styles


def _declarations(style: str) -> dict[str, tuple[bool, str]]:
    """Property -> (important, value), the last one of the more important."""
    out: dict[str, tuple[bool, str]] = {}
    for name, colon, value in (x.partition(":") for x in style.split(";")):
        name, value = name.strip().lower(), value.strip().lower()
        plain = re.sub(r"\s*!\s*important\Z", "", value)
        important = plain != value
        if colon and name in ("display", "visibility") and important >= out.get(name, (False, ""))[0]:
            out[name] = (important, plain)
    return out


def _holds(media: str) -> bool | None:
    """Whether a media query holds on a screen; None where that depends on more."""
    answers: list[bool | None] = []
    for query in media.lower().split(","):
        m = re.match(r"\s*(not\s+|only\s+)?([a-z-]*)\s*(.*)\Z", query, re.DOTALL)
        kind, more, turned = m[2], m[3], (m[1] or "").startswith("not")
        on = kind in ("", "all", "screen")
        answers.append(None if more and on else on != turned if not more else turned or False)
        if more and not on and turned:
            answers[-1] = True  # not (another medium and ...)
    return True if True in answers else None if None in answers else False


def rules(sheet: str) -> Iterator[tuple[int, str, str, bool]]:
    """(place, selectors, declarations, certain) of a style sheet.  Rules under a condition that
    doesn't hold are left out; under one that can't be judged, and nested ones, are uncertain."""
    sheet = re.sub(r"/\*.*?(?:\*/|\Z)", " ", sheet, flags=re.DOTALL).replace("<!--", "").replace("-->", "")
    open_: list[tuple[int, str | None, bool | None, list[str]]] = []  # place, selectors, condition, declarations
    start = 0
    for m in SHEET_TOKEN.finditer(sheet + "}" * (sheet.count("{") + 1)):
        if m[0] not in "{};":
            continue
        piece, start = (sheet[start : m.start()], m.end()) if m.start() <= len(sheet) else ("", m.end())
        _, selectors, held, declared = open_[-1] if open_ else (0, None, True, [])
        if m[0] == ";":
            declared.append(piece)
        elif m[0] == "{":
            piece = piece.strip()
            if piece.startswith("@"):
                name, _, rest = piece[1:].partition(" ")
                name, paren, tail = name.partition("(")
                name, rest = name.lower(), paren + tail + " " + rest
                now = _holds(rest) if name == "media" else None if name in ("supports", "layer", "container", "scope", "starting-style", "document") else False
            else:
                now, selectors = (True, piece) if selectors is None else (None, "&")  # a nested rule may hold for any element
            open_.append((m.start(), selectors, False if False in (held, now) else None if None in (held, now) else True, []))
        elif open_:
            place = open_.pop()[0]
            if selectors is not None and held is not False:
                yield place, selectors, ";".join([*declared, piece]), held is True


@dataclass
class Compound:
    """What one element has to have; ``sure`` where that is all that the selector asks."""

    tag: str = ""
    classes: set[str] = field(default_factory=set)
    ids: set[str] = field(default_factory=set)
    has: set[str] = field(default_factory=set)
    sure: bool = True

    def fits(self, node: Node, classes: set[str]) -> bool:
        return self.tag in ("", node.tag) and self.classes <= classes and (not self.ids or self.ids == {node.attributes.get("id")}) and self.has <= node.attributes.keys()


def selector(text: str) -> tuple[list[Compound], bool, tuple[float, ...]] | None:
    """(compounds, whether they can be judged, specificity); None if no element at rest fits."""
    text = re.sub(r"\[[^\]]*=[^\]]*\]", "\x02", text.strip())
    weight, sure = [0.0, 0.0, 0.0], not re.search(r"(?<!\\)[>+~|&]", text)  # tbody and the like may be implied, so children aren't judged
    while (inner := re.sub(r"\([^()]*\)", "\x01", text)) != text:
        text, weight[0] = inner, math.inf
    parts = [Compound()]
    at, text = 0, re.sub(r"\s*[>+~]\s*", " ", text)
    while at < len(text):
        m = PART.match(text, at)
        if m is None:
            return [Compound(sure=False)], False, (math.inf, 0.0, 0.0)
        at, kind, now = m.end(), m.lastgroup, parts[-1]
        value = re.sub(r"\\(.)", r"\1", m[kind])
        if kind == "space":
            parts.append(Compound())
        elif kind == "element" or (kind == "pseudo" and value in ("hover", "active", "focus", "focus-within", "focus-visible")):
            return None
        elif kind == "tag":
            now.tag = value.lower()
            sure = sure and now.tag not in ("tbody", "colgroup")
            weight[2] += 1
        elif kind == "id":
            now.ids.add(value)
            weight[0] += 1
        elif kind == "star":
            pass
        else:
            weight[1] += 1
            if kind in ("class", "has"):
                (now.classes if kind == "class" else now.has).add(value if kind == "class" else value.lower())
            else:
                sure = now.sure = False
    return parts, sure, tuple(weight)


HIDING = ("none", "hidden", "collapse")


def _stronger(kept: dict[str, tuple[tuple, str]], new: dict[str, tuple[tuple, str]]) -> None:
    """Takes up declarations that rank as high as those there are, or higher."""
    for name, own in new.items():
        if name not in kept or own[0] >= kept[name][0]:
            kept[name] = own


class Styles:
    """display and visibility from style elements and attributes, by importance, specificity and
    order.  Compound and descendant selectors are judged; what can't be (other combinators,
    pseudo-classes, conditions) never hides an element, and keeps a weaker rule from it."""

    def __init__(self, sheets: list[str]):
        # By what an element must have: selector -> its parts, whether it can be judged, and of each
        # property the strongest declaration.  Equal selectors are one, however often they are written.
        self.rules: dict[str, dict[tuple, tuple[list[Compound], bool, dict[str, tuple[tuple, str]]]]] = {}
        self.fitting: dict[tuple, tuple[dict, dict, list]] = {}
        for k, sheet in enumerate(sheets):
            for place, selectors, declared, certain in rules(sheet):
                own = _declarations(declared)
                for text in SELECTOR_COMMA.split(selectors) if own else ():
                    if found := selector(text):
                        parts, sure, weight = found
                        last, sure = parts[-1], sure and certain
                        key = "#" + min(last.ids) if last.ids else "." + min(last.classes) if last.classes else last.tag
                        name = (sure, *((p.tag, frozenset(p.classes), frozenset(p.ids), frozenset(p.has)) for p in parts))
                        kept = self.rules.setdefault(key, {}).setdefault(name, (parts, sure, {}))[2]
                        _stronger(kept, {n: ((important, False, *weight, k, place), value) for n, (important, value) in own.items() if sure or value not in HIDING})

    def _of_kind(self, node: Node) -> tuple[dict, dict, list]:
        """What the rules say of elements with this tag, class, id and these attributes: declarations that hold,
        ranks of those that may show it, and rules that ask for more above it."""
        a = node.attributes
        kind = (node.tag, a.get("class", ""), a.get("id"), frozenset(a))
        if kind not in self.fitting:
            classes = set(a.get("class", "").split())
            keys = ["", node.tag, *("." + c for c in classes), *(["#" + a["id"]] if "id" in a else [])]
            best: dict[str, tuple[tuple, str]] = {}
            shows: dict[str, tuple[tuple, str]] = {}
            above = []
            for parts, sure, declared in (r for key in keys for r in self.rules.get(key, {}).values()):
                if parts[-1].fits(node, classes):
                    if sure and len(parts) > 1:
                        above.append((parts[:-1], declared))
                    else:
                        _stronger(best if sure else shows, declared)
            self.fitting[kind] = best, shows, above
        return self.fitting[kind]

    def of(self, node: Node, path: list[Node], hidden: bool = False) -> dict[str, str]:
        """Of an element under those of ``path``; ``hidden`` where the browser hides it unless told otherwise."""
        best: dict[str, tuple[tuple, str]] = {"display": ((False, False, -1.0), "none")} if hidden else {}
        shows: dict[str, tuple[tuple, str]] = {}
        if self.rules:
            held, shows, above = self._of_kind(node)
            _stronger(best, held)
            for parts, declared in above:
                if self._under(parts, path):
                    _stronger(best, declared)
        for name, (important, value) in _declarations(node.attributes["style"]).items() if "style" in node.attributes else ():
            if name not in best or (important, True) >= best[name][0][:2]:
                best[name] = ((important, True), value)
        return {name: value for name, (rank, value) in best.items() if value not in HIDING or name not in shows or shows[name][0] < rank}

    @staticmethod
    def _under(parts: list[Compound], path: list[Node]) -> bool:
        left = len(parts)
        for node in reversed(path):
            if left and parts[left - 1].fits(node, set(node.attributes.get("class", "").split())):
                left -= 1
        return not left


class Lines:
    """A buffer of laid-out lines; blank lines stand only between lines with text."""

    def __init__(self) -> None:
        self.lines: list[str] = []
        self.now: list[str] = []
        self.gap = 0  # line breaks wanted before the next text
        self.space = False

    def add(self, text: str) -> None:
        """Inline text, its white space collapsed."""
        text = SPACES.sub(" ", text)
        if text.startswith(" "):
            self.space = True
            text = text[1:]
        if not text:
            return
        self._begin()
        if self.space and self.now:
            self.now.append(" ")
        self.space = text.endswith(" ")
        self.now.append(text[:-1] if self.space else text)

    def put(self, lines: list[str]) -> None:
        """Lines laid out already."""
        self.broken(1)
        if lines:
            self._begin()
            self.lines += lines
            self.gap = 1

    def _begin(self) -> None:
        if self.gap and self.lines:
            self.lines += [""] * (self.gap - 1)
        self.gap = 0

    def line_break(self) -> None:
        if self.now:
            self._flush()
        elif self.lines or self.gap:
            self.gap = min(2, max(self.gap, 1) + 1)

    def _flush(self) -> None:
        if self.now:
            self.lines.append("".join(self.now))
            self.now = []
            self.gap = max(self.gap, 1)
        self.space = False

    def broken(self, gap: int) -> None:
        """A block boundary: the next text stands ``gap`` lines further on."""
        self._flush()
        self.gap = max(self.gap, gap)

    def done(self) -> list[str]:
        self._flush()
        return self.lines


def lay_out(rows: list[list[tuple[list[str], int, int]]]) -> list[str]:
    """Rows of cells (lines, colspan, rowspan) as lines with padded columns.  A table that would be mostly
    padding (over 20 characters for each of its text, and 20,000), or whose spans take over 64 steps a cell to
    place, is written without: its cells' texts side by side.  So the time follows the page's length."""
    grid: list[list[tuple[int, int, list[str]]]] = []
    until: dict[int, int] = {}  # column -> the row from which it is free
    steps = 4096 + 64 * sum(map(len, rows))
    for r, row in enumerate(rows):
        at, placed = 0, []
        for lines, across, down in row:
            while until.get(at, 0) > r:
                at, steps = at + 1, steps - 1
            placed.append((at, across, lines))
            steps -= across
            if steps < 0:
                return _unpadded(rows)
            if down > 1:
                until.update(dict.fromkeys(range(at, at + across), r + down))
            at += across
        grid.append(placed)
    width: dict[int, int] = {}
    for placed in grid:
        for at, across, lines in placed:
            if across == 1:
                width[at] = max(width.get(at, 0), min(WIDE, max(map(len, lines), default=0)))
    order = sorted({at for placed in grid for at, _, lines in placed if any(lines)})
    before = [0]  # characters of the columns of ``order`` before each, with what parts them
    for at in order:
        before.append(before[-1] + width.get(at, 0) + 3)
    tall = [max((len(lines) for _, _, lines in placed), default=0) for placed in grid]
    if sum(tall) * before[-1] > 20_000 + 20 * sum(len(x) for row in rows for lines, _, _ in row for x in lines):
        return _unpadded(rows)
    out: list[str] = []
    for placed, n in zip(grid, tall, strict=True):
        cells = {at: (at + across, lines) for at, across, lines in placed}
        spans = []  # (lines, padded width) of what stands in each place
        k = 0
        while k < len(order):
            end, lines = cells.get(order[k], (order[k] + 1, []))
            first, k = k, bisect_left(order, end, k + 1)
            spans.append((lines, before[k] - before[first] - 3))
        for k in range(n):
            parts = [(lines[k] if k < len(lines) else "").ljust(size) for lines, size in spans]
            while parts and not parts[-1].strip():
                parts.pop()
            out.append(" | ".join(parts).rstrip(" "))
    return out


def _unpadded(rows: list[list[tuple[list[str], int, int]]]) -> list[str]:
    out: list[str] = []
    for row in rows:
        for k in range(max((len(lines) for lines, _, _ in row), default=0)):
            out.append(" | ".join(lines[k] for lines, _, _ in row if k < len(lines) and lines[k]))
    return out


def _number(text: str | None, default: int, most: int) -> int:
    m = re.match(r"\s*([+-]?\d{1,9})", text or "")
    return min(most, int(m[1])) if m else default


def render(source: str | None) -> str:
    """The visible text of a page."""
    if not source:
        return ""
    root, sheets = parse(source)
    styles = Styles(sheets)
    out = [Lines()]
    tables: list[list[list[tuple[list[str], int, int]]]] = []
    lists: list[tuple[bool, int]] = []  # (numbered, next number)
    path: list[Node] = []  # the open elements
    # (node, entering, visible, preformatted, drawn); an explicit stack, as trees may be deep
    todo: list[tuple[Node | str, bool, bool, bool, bool]] = [(root, True, True, False, True)]
    while todo:
        node, entering, seen, pre, drawn = todo.pop()
        if isinstance(node, str):
            if not drawn:
                continue
            if seen and pre:
                first, *more = node.replace("\r\n", "\n").split("\n")
                for k, line in enumerate([first, *more]):
                    if k:
                        out[-1].line_break()
                    if line:
                        out[-1]._begin()
                        out[-1].now.append(line)
            elif seen:
                out[-1].add(node)
            continue
        tag, a = node.tag, node.attributes
        if entering:
            if tag in UNSEEN or (tag in DEFINED and any(x.tag == "svg" for x in path)):
                continue
            style = styles.of(node, path, "hidden" in a or (tag == "dialog" and "open" not in a))
            if style.get("display") == "none":
                continue
            seen = style["visibility"] not in ("hidden", "collapse") if style.get("visibility") not in (None, "inherit") else seen
            if tag == "svg":
                drawn = False
            elif tag in DRAWN and not drawn:
                drawn = True
                out[-1].add(" ")
            if tag == "br":
                out[-1].line_break()
                continue
            if tag == "input":
                if seen and a.get("type", "text").lower() in ("text", "submit", "button", "reset", "search", "email", "url", "tel", "number"):
                    out[-1].add(f" {a.get('value', '')} ")
                continue
            if tag in BLOCK or style.get("display") in ("block", "flex", "grid", "table", "list-item"):
                out[-1].broken(1 + (tag in SPACED and not (tag in ("ul", "ol", "menu", "dir") and lists)))
            if tag in ("ul", "ol", "menu", "dir"):
                lists.append((tag == "ol", _number(a.get("start"), 1, 10**9)))
            elif tag == "li":
                out.append(Lines())
            elif tag == "table":
                tables.append([])
                out.append(Lines())  # for what stands outside of cells, the caption for one
            elif tag == "tr" and tables:
                tables[-1].append([])
            elif tag in CELLS and tables:
                if not tables[-1]:
                    tables[-1].append([])
                out.append(Lines())
            todo.append((node, False, seen, pre, drawn))
            path.append(node)
            children = node.children
            if tag == "details" and "open" not in a:
                children = [c for c in children if isinstance(c, Node) and c.tag == "summary"][:1]
            inner = pre or tag in ("pre", "textarea", "listing") or style.get("white-space", "").startswith("pre")
            todo.extend((c, True, seen, inner, drawn) for c in reversed(children))
            continue
        path.pop()
        if tag in DRAWN or tag == "svg":
            out[-1].add(" ")
        if tag in ("ul", "ol", "menu", "dir"):
            lists.pop()
        elif tag == "li":
            lines = out.pop().done()
            if lists and lists[-1][0]:
                number = _number(a.get("value"), lists[-1][1], 10**9)
                lists[-1] = (True, number + 1)
                mark = f"{number}. "
            else:
                mark = "- "
            if lines:
                out[-1].put([mark + lines[0], *(" " * len(mark) + x if x else "" for x in lines[1:])])
        elif tag in CELLS and tables:
            lines = out.pop().done()
            tables[-1][-1].append((lines, max(1, _number(a.get("colspan"), 1, 1000)), max(1, _number(a.get("rowspan"), 1, 65534))))
        elif tag == "table":
            around, rows = out.pop().done(), tables.pop()
            out[-1].put(around)
            out[-1].put(lay_out([r for r in rows if r]))
        elif tag in ("td", "th"):
            out[-1].add(" ")
        if tag in BLOCK:
            out[-1].broken(1 + (tag in SPACED and not (tag in ("ul", "ol", "menu", "dir") and lists)))
    return "\n".join(x.rstrip(" ") for x in out[0].done()).strip("\n")


def extract(pages: DataFrame, html_col: str = "html", text_col: str = "text") -> DataFrame:
    """``pages`` with ``text_col`` in place of ``html_col``: one narrow pass over whole pages."""
    kept = [f for f in pages.schema if f.name not in (html_col, text_col)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [render(x.as_py()) for x in batch.column(len(kept))]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(kept)], pa.array(texts, pa.string())], names=[*(f.name for f in kept), text_col])

    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in kept), f"`{text_col}` string"])
    return pages.select(*[F.col(f"`{f.name}`") for f in kept], F.col(f"`{html_col}`")).mapInArrow(run, schema)
