"""Text of HTML pages as a reader would see it.

A tokenizer feeds a tree builder that knows void and raw-text elements, implied end tags (p, li, dt/dd,
option, table parts) and unmatched end tags; the tree is then laid out: blocks on lines of their own with
blank lines where browsers leave margins, list items with markers and indents, table cells in aligned
columns, preformatted text as it stands.  Invisible is what a browser doesn't show: head, scripts, styles,
templates, noscript, hidden and display:none elements (inline or by plain rules in style elements), closed
details and dialogs.  What visibility hides is inherited: a visible part of a hidden element comes out, as all
visible text does.

Scanner, tree builder and layout take time in proportion to the page and use no recursion, so neither depth
nor broken markup can stop a task.  Of style rules with one selector only the winning one is kept, and an
element is asked only about rules whose rarest part it has.  A table inside a cell isn't aligned: its cells
follow each other with bars between them.  A cell of over ``WIDEST`` characters reaches beyond its column; the
other rows stay aligned.  Padding is bounded, so the text is in proportion to the page too: indents end at
``DEEPEST`` columns, and a cell, whatever it spans, is filled up to ``WIDEST`` characters at most.

Cases: null gives null text and empty an empty one; malformed markup never fails: a stray < is text, a tag
without an end is text with all that follows, an attribute's quote that never closes is an ordinary
character, numbers that aren't ASCII digits count as absent; repeated rows each get their row; an empty
table gives no rows.
"""

from __future__ import annotations

import html
import re
from bisect import bisect_left, bisect_right
from collections import Counter
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WIDEST, DEEPEST = 200, 40

#: Fixed values of the HTML standard.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style xmp iframe noembed noframes noscript".split())
RCDATA = frozenset("textarea title".split())
BLOCK = frozenset("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre search section summary table caption tbody td tfoot th thead tr ul xmp".split())
SPACED = frozenset("p h1 h2 h3 h4 h5 h6 ul ol dl menu dir blockquote pre table figure xmp hr fieldset".split())
CLOSES_P = BLOCK - frozenset("option optgroup legend caption tbody td tfoot th thead tr body html".split())
HIDDEN = frozenset("head script style template noembed noframes noscript iframe datalist title object audio video canvas param area annotation annotation-xml mphantom".split())

#: Which open elements a start tag ends, and the elements that such a search doesn't leave.
ENDS = {
    "li": (frozenset(["li"]), frozenset(["ul", "ol", "menu", "dir"])),
    "dt": (frozenset(["dt", "dd"]), frozenset(["dl"])),
    "dd": (frozenset(["dt", "dd"]), frozenset(["dl"])),
    "option": (frozenset(["option"]), frozenset(["select", "datalist"])),
    "optgroup": (frozenset(["option", "optgroup"]), frozenset(["select"])),
    "td": (frozenset(["td", "th"]), frozenset(["tr", "table"])),
    "th": (frozenset(["td", "th"]), frozenset(["tr", "table"])),
    "tr": (frozenset(["td", "th", "tr", "caption", "colgroup"]), frozenset(["table", "tbody", "thead", "tfoot"])),
    "tbody": (frozenset(["td", "th", "tr", "tbody", "thead", "tfoot", "caption", "colgroup"]), frozenset(["table"])),
    "thead": (frozenset(["td", "th", "tr", "tbody", "thead", "tfoot", "caption", "colgroup"]), frozenset(["table"])),
    "tfoot": (frozenset(["td", "th", "tr", "tbody", "thead", "tfoot", "caption", "colgroup"]), frozenset(["table"])),
    "rp": (frozenset(["rp", "rt"]), frozenset(["ruby"])),
    "rt": (frozenset(["rp", "rt"]), frozenset(["ruby"])),
    "body": (frozenset(["head"]), frozenset(["html"])),
}
_SCOPE = frozenset("table td th caption html button template".split())

_NAME = re.compile(r"[a-zA-Z][^\s/>]*+")
_REST = re.compile(r"(?:[^>\"'=]++|=\s*+(?:\"[^\"]*+\"|'[^']*+')?+|[\"'])*+>")
_ATTR = re.compile(r"([^\s=/\"'>]++)(?:\s*+=\s*+(?:\"([^\"]*+)\"|'([^']*+)'|([^\s\"'>]++)))?")
_NUMBER = re.compile(r"[ \t\n\f\r]*+([+-]?[0-9]{1,9})(?![0-9])")
_HIDES = re.compile(r"display\s*:\s*none|visibility\s*:\s*(?:hidden|collapse)", re.I)
_COMMENT = re.compile(r"/\*.*?(?:\*/|\Z)|<!--|-->", re.S)
_CSS = re.compile(r"\"(?:\\.|[^\"\\])*\"|'(?:\\.|[^'\\])*'|[{};]|[^\"'{};]+|.", re.S)
_PLAIN = re.compile(r"(\*|[\w-]+)?((?:[.#][\w-]+)*)")
_ALWAYS = frozenset(["", "all", "screen", "only all", "only screen", "not print"])
#: MathML elements whose parts stand apart, and SVG elements that draw nothing themselves.
APART = frozenset("mfrac msub msup msubsup munder mover munderover mroot mtr mtd".split())
UNDRAWN = frozenset("defs symbol clippath mask marker pattern desc metadata".split())
_SPACE = re.compile(r"[ \t\n\r\f]+")


class Node:
    __slots__ = ("tag", "attrs", "children")

    def __init__(self, tag: str, attrs: str = "", children: list | None = None):
        self.tag, self.attrs, self.children = tag, attrs, [] if children is None else children

    def attributes(self) -> dict[str, str]:
        if not self.attrs:
            return {}
        return {k.lower(): html.unescape(a or b or c) for k, a, b, c in reversed(_ATTR.findall(self.attrs))}


class Builder:
    """Open elements, and of each tag the places where it is open: every question about them is a look-up."""

    def __init__(self):
        self.root = Node("#root")
        self.open = [self.root]
        self.places: dict[str, list[int]] = {}

    def last(self, tags) -> int:
        """The innermost place of any of these tags, -1 if none is open."""
        return max((at[-1] for t in tags if (at := self.places.get(t))), default=-1)

    def push(self, node: Node) -> None:
        self.places.setdefault(node.tag, []).append(len(self.open))
        self.open.append(node)

    def cut(self, at: int) -> None:
        while len(self.open) > at:
            self.places[self.open.pop().tag].pop()

    def text(self, text: str) -> None:
        if text:
            self.open[-1].children.append(html.unescape(text) if "&" in text else text)

    def imply(self, tag: str) -> None:
        """Ends what a start tag ends without saying so."""
        if tag in CLOSES_P and (at := self.last(("p",))) > self.last(_SCOPE):
            self.cut(at)
        if rule := ENDS.get(tag):
            closes, edge = rule
            beyond = self.last(edge)
            firsts = [at[k] for t in closes if (at := self.places.get(t)) and (k := bisect_right(at, beyond)) < len(at)]
            if firsts:
                self.cut(min(firsts))

    def end(self, tag: str) -> None:
        """An unmatched end tag does nothing, and none reaches out of a cell but those of table parts."""
        at = self.last((tag,))
        wall = self.last(("table", "template") if tag in ("table", "tr", "tbody", "thead", "tfoot") else ("table", "template", "td", "th"))
        if at > 0 and at >= wall:
            self.cut(at)

    def foreign(self, tag: str) -> bool:
        """Inside svg or math, where a tag can end itself."""
        return tag in ("svg", "math") or self.last(("svg", "math")) > self.last(("foreignobject",))


def parse(source: str) -> tuple[Node, list[str]]:
    """The tree, and the texts of its style elements."""
    tree, styles, at, n = Builder(), [], 0, len(source)
    while (start := source.find("<", at)) >= 0:
        mark = source[start + 1 : start + 2]
        ends = mark == "/"
        name = _NAME.match(source, start + 1 + ends)
        if name is None:
            if mark not in ("!", "?", "/") or (ends and start + 2 >= n):
                tree.text(source[at : start + 1])  # a stray <
                at = start + 1
                continue
            tree.text(source[at:start])
            stop, skip = (source.find("-->", start + 4), 3) if source.startswith("<!--", start) else (source.find(">", start), 1)
            at = n if stop < 0 else stop + skip
            continue
        rest = _REST.match(source, name.end())
        if rest is None:  # no tag behind this one has an end either
            break
        tree.text(source[at:start])
        at, tag = rest.end(), name[0].lower()
        if ends:
            tree.end(tag)
            continue
        tree.imply(tag)
        node = Node(tag, source[name.end() : at - 1])
        tree.open[-1].children.append(node)
        if tag in RAW or tag in RCDATA:
            close = re.compile(rf"</{tag}(?=[\s/>])", re.I).search(source, at)
            stop = close.start() if close else n
            body = source[at:stop]
            node.children.append(html.unescape(body) if tag in RCDATA else body)
            if tag == "style":
                media = node.attributes().get("media", "")
                styles.append(f"@media {media}{{{body}}}" if media.strip() else body)
            shut = source.find(">", stop) if close else -1
            at = shut + 1 if shut >= 0 else n
        elif tag not in VOID and not (node.attrs.endswith("/") and tree.foreign(tag)):
            tree.push(node)
    tree.text(source[at:])
    return tree.root, styles


def whole_number(text: str, default: int) -> int:
    m = _NUMBER.match(text)
    return int(m[1]) if m else default


class Layout:
    """Lines of output; breaks collapse, so the largest gap asked for between two blocks wins."""

    def __init__(self, hidden: dict | None = None, in_cell: bool = False):
        self.lines: list[str] = []
        self.line: list[str] = []
        self.indent, self.gap, self.marker = 0, 0, ""
        self.space, self.hidden, self.in_cell = False, hidden or {}, in_cell

    def text(self, text: str) -> None:
        words = _SPACE.sub(" ", text)
        if not words:
            return
        if words[0] == " ":
            self.space, words = True, words[1:]
        if words:
            tail = words[-1] == " "
            if self.line and self.space:
                self.line.append(" ")
            self.line.append(words[:-1] if tail else words)
            self.space = tail

    def end_line(self) -> None:
        if self.line:
            if self.lines:
                self.lines.extend([""] * (self.gap > 1))
            self.gap = 0
            marker, self.marker = self.marker, ""
            self.lines.append(" " * max(0, min(self.indent, DEEPEST) - len(marker)) + marker + "".join(self.line))
            self.line = []
        self.space = False

    def block(self, gap: int) -> None:
        self.end_line()
        self.gap = max(self.gap, gap)

    def style(self, node: Node) -> tuple[bool, bool | None]:
        """Whether an element is laid out, and whether text of its own is hidden (None: as its parent's is)."""
        if node.tag in HIDDEN:
            return False, None
        if node.tag[0] == "#":
            return True, {"#muted": True, "#shown": False}.get(node.tag)
        if not node.attrs and not self.hidden:
            return True, None
        a = node.attributes()
        if node.tag == "input" or (node.tag == "dialog" and "open" not in a):
            return False, None
        won = {"display": ((False, (-1,)), "hidden" in a), "visibility": ((False, (-1,)), None)}
        own = {node.tag, "*", *(f"#{x}" for x in a.get("id", "").split()), *(f".{x}" for x in a.get("class", "").split())}
        found = [r[1:] for key in own for r in self.hidden.get(key, ()) if r[0] <= own] if self.hidden else []
        found += [((important, (9,)), name, hides) for name, hides, important in declarations(a.get("style", ""))]
        for weight, name, hides in found:
            if weight >= won[name][0]:
                won[name] = (weight, hides)
        return not won["display"][1], won["visibility"][1]

    def walk(self, node: Node, mute: bool = False) -> None:
        """Lays out what is inside a node; what follows an element's children waits on a stack."""
        todo = [(iter(node.children), node, None, mute)]
        numbers: dict[int, int] = {}
        while todo:
            children, parent, after, mute = todo[-1]
            for child in children:
                if isinstance(child, str):
                    if not mute:
                        self.text(child)
                elif (entered := self.enter(child, parent, numbers, mute)) is not None:
                    after, inside, mute = entered
                    todo.append((iter(child.children if inside is None else inside), child, after, mute))
                    break
            else:
                todo.pop()
                numbers.pop(id(parent), None)
                if after is not None:
                    after()

    def enter(self, child: Node, parent: Node, numbers: dict[int, int], mute: bool):
        """What stands before an element; None if its children need no walk, else (what comes after them, the children to walk if not all, whether their text is hidden)."""
        tag = child.tag
        if tag == "br":
            if self.line and not mute:
                self.end_line()
            elif not mute:
                self.gap = max(self.gap, 2)
            return None
        displayed, own = self.style(child)
        if not displayed:
            return None
        mute = mute if own is None else own
        if tag == "svg":
            self.space = True
            self.text("".join(self._strings(child, mute, drawing=True)))
            self.space = True
            return None
        if tag == "#rows":
            self.end_line()
            for line in child.children:
                self.line = [line]
                self.end_line()
            return None
        if tag not in BLOCK:
            self.space = self.space or parent.tag in APART
            return None, None, mute
        if self.in_cell and tag in ("td", "th"):
            nth = numbers[id(parent)] = numbers.get(id(parent), 0) + 1
            self.text(" | " if nth > 1 else "")
            return None, None, mute
        gap = 2 if tag in SPACED and not (tag in ("ul", "ol") and parent.tag == "li") else 1
        self.block(gap)
        if tag == "table" and not self.in_cell:
            return (lambda: self.block(gap)), [self.table(child, mute)], mute
        if tag in ("pre", "xmp"):
            self.preformatted(child, mute)
            self.block(gap)
            return None
        if tag == "li":
            mark = "- "
            if parent.tag == "ol":
                before = numbers.get(id(parent))
                numbers[id(parent)] = whole_number(parent.attributes().get("start", ""), 1) if before is None else before + 1
                mark = f"{numbers[id(parent)]}. "
            self.indent += len(mark)
            self.marker = "" if mute else mark

            def after():
                self.end_line()
                self.indent, self.marker = self.indent - len(mark), ""
                self.block(gap)

            return after, None, mute
        if tag in ("blockquote", "dd"):
            self.indent += 2

            def after():
                self.end_line()
                self.indent -= 2
                self.block(gap)

            return after, None, mute
        if tag == "details" and "open" not in child.attributes():
            return (lambda: self.block(gap)), [x for x in child.children if isinstance(x, Node) and x.tag == "summary"][:1], mute
        return (lambda: self.block(gap)), None, mute

    def preformatted(self, node: Node, mute: bool) -> None:
        text = "".join(self._strings(node, mute)).replace("\r\n", "\n")
        for line in text.removeprefix("\n").rstrip("\n").split("\n"):
            self.line = [line.rstrip()] if line.strip() else []
            if self.line:
                self.end_line()
            elif self.lines:
                self.gap = 2

    def _strings(self, node: Node, mute: bool, drawing: bool = False) -> list[str]:
        """Visible strings as they stand; in a drawing those of its text and foreignObject elements, set apart by spaces."""
        out: list[str] = []
        todo = [(x, drawing, mute) for x in reversed(node.children)]
        while todo:
            x, drawn, mute = todo.pop()
            if isinstance(x, str):
                out.append("" if drawn or mute else x)
            elif x.tag == "br":
                out.append("" if drawn or mute else "\n")
            elif x.tag not in UNDRAWN and (style := self.style(x))[0]:
                speaks = x.tag in ("text", "foreignobject")
                out.append(" " if drawing and (speaks or x.tag in BLOCK) else "")
                inner = not speaks and (drawn or x.tag == "svg")
                mute = mute if style[1] is None else style[1]
                todo += [(c, inner, mute) for c in reversed(x.children)]
        return out

    def _flat(self, node: Node, mute: bool) -> str:
        inner = Layout(self.hidden, in_cell=True)
        inner.walk(node, mute)
        return " ".join(_SPACE.sub(" ", line).strip() for line in inner.done().split("\n") if line.strip())

    def table(self, node: Node, mute: bool) -> Node:
        """Captions and what browsers move in front of the table, and the rows as lines of aligned cells."""
        rows: list[list[tuple[str, int]]] = []
        loose: list[Node | str] = []
        todo: list[tuple[Node | str, bool, bool]] = [(x, False, mute) for x in reversed(node.children)]
        while todo:
            x, in_row, muted = todo.pop()
            if isinstance(x, str) and not x.strip():
                continue
            displayed, own = (True, None) if isinstance(x, str) else self.style(x)
            if not displayed or (isinstance(x, Node) and x.tag in ("col", "colgroup")):
                continue
            inner = muted if own is None else own
            if isinstance(x, Node) and x.tag in ("td", "th"):
                if not in_row:
                    rows.append([])
                rows[-1].append((self._flat(x, inner), max(1, min(1000, whole_number(x.attributes().get("colspan", ""), 1)))))
            elif isinstance(x, Node) and x.tag in ("tr", "thead", "tbody", "tfoot") and not in_row:
                if x.tag == "tr":
                    rows.append([])
                todo += [(c, x.tag == "tr", inner) for c in reversed(x.children)]
            else:
                loose.append(x if muted == mute else Node("#muted" if muted else "#shown", children=[x]))
        width: dict[int, int] = {}
        for row in rows:
            at = 0
            for text, span in row:
                if span == 1 and len(text) <= WIDEST:
                    width[at] = max(width.get(at, 0), len(text))
                at += span
        columns = sorted(width)
        upto = [0, *accumulate(width[k] for k in columns)]
        last = max(width, default=-1) + 1
        lines = Node("#rows")
        for row in rows:
            at, cells = 0, []
            for text, span in row:
                end = max(at, min(at + span, last))
                fill = upto[bisect_left(columns, end)] - upto[bisect_left(columns, at)] + 3 * max(0, end - at - 1)
                cells.append(text.ljust(min(fill, WIDEST)))
                at += span
            if any(text for text, _ in row):
                lines.children.append(" | ".join(cells).rstrip())
        return Node("#table", children=[Node("#loose", children=loose), lines])

    def done(self) -> str:
        self.end_line()
        return "\n".join(self.lines)


def declarations(body: str) -> list[tuple[str, bool | None, bool]]:
    """display and visibility of a rule: name, whether it hides (None: as the parent), whether it is important."""
    out = []
    for d in body.split(";"):
        name, _, value = d.partition(":")
        name, value = name.strip().lower(), value.strip().lower()
        if name in ("display", "visibility") and value:
            inherits = name == "visibility" and value.startswith(("inherit", "unset", "revert"))
            out.append((name, None if inherits else bool(_HIDES.match(f"{name}:{value}")), "!" in value and value.endswith("important")))
    return out


def hidden_selectors(styles: list[str]) -> dict[str, list[tuple]]:
    """Rules on display and visibility with plain selectors (tag, .class, #id and these joined), by one of their parts.

    Rules with the same selector match the same elements, so only the one that wins is kept, under the part that
    the fewest selectors have.  Rules in @media hold only if the query is screen or all without conditions; nested rules are left out.
    """
    won: dict[tuple, tuple] = {}
    at = 0
    for style in styles:
        head, open_, body = "", [], ""  # open_: of each block, "in" (rules are read), "out" or the selectors of a rule
        for t in [*_CSS.findall(_COMMENT.sub(" ", style)), "}"]:
            if t == "{":
                h = head.strip().lower()
                if open_ and open_[-1] != "in":
                    open_.append("out")
                elif h.startswith("@media"):
                    open_.append("in" if any(" ".join(q.split()) in _ALWAYS for q in h[6:].split(",")) else "out")
                elif h.startswith("@"):
                    open_.append("in" if h.startswith("@layer") or (h.startswith("@supports") and " not" not in h) else "out")
                else:
                    open_.append(head)
                    body = ""
                head = ""
            elif t == "}":
                done = open_.pop() if open_ else "out"
                if done not in ("in", "out"):
                    body += head
                    for selector in done.split(","):
                        m = _PLAIN.fullmatch(selector.strip())
                        parts = [*([m[1].lower()] if m[1] else []), *re.findall(r"[.#][\w-]+", m[2])] if m else []
                        for name, hides, important in declarations(body) if parts else ():
                            at += 1
                            weight = (0, m[2].count("#"), m[2].count("."), int(m[1] not in (None, "*")), at)
                            key = (frozenset(parts), name)
                            if key not in won or (important, weight) >= won[key][0]:
                                won[key] = ((important, weight), hides)
                head = ""
            elif t == ";":
                if open_ and open_[-1] not in ("in", "out"):
                    body += head + ";"
                head = ""
            else:
                head += t
    rules = Counter(p for parts, _ in won for p in parts)
    found: dict[str, list[tuple]] = {}
    for (parts, name), (weight, hides) in won.items():
        found.setdefault(min(parts, key=lambda p: (rules[p], p)), []).append((parts, weight, name, hides))
    return found


def render(source: str) -> str:
    root, styles = parse(source)
    layout = Layout(hidden_selectors(styles) if any("display" in s or "visibility" in s for s in map(str.lower, styles)) else None)
    layout.walk(root)
    return layout.done()


def extract_text(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """The id, text, n_chars and n_lines of each page."""
    src = pages.select(F.col(id_col), F.col(html_col).cast("string").alias("__html"))
    kind = src.schema.fields[0].dataType.simpleString()

    def run(batches):
        for batch in batches:
            for k in range(0, len(batch), 256):
                part = batch.slice(k, 256)
                texts = [None if (s := x.as_py()) is None else render(s) for x in part.column(1)]
                n = [None if t is None else len(t) for t in texts]
                lines = [None if t is None else t.count("\n") + bool(t) for t in texts]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(texts, pa.string()), pa.array(n, pa.int64()), pa.array(lines, pa.int64())], names=[id_col, "text", "n_chars", "n_lines"])

    return src.mapInArrow(run, f"`{id_col}` {kind}, text string, n_chars long, n_lines long")
