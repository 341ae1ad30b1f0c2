"""Layout-aware rendering of web pages as text.

``events`` is the tree builder: it walks the markup once and yields elements
opening and closing in tree order, with the tags that authors may leave out
(``</p>``, ``</li>``, ``<tbody>``, ``<tr>`` ...) implied. ``render`` lays what
is visible out: blocks are apart by a line or by a blank line, list items have
their bullet or number and hang under it, table cells stand in columns,
preformatted text keeps its spaces, and everything else has its white space
collapsed. Nothing visible is dropped: menus, captions and notices stay, and so
do formulas, the labels of drawings, options and the text of text areas.

Invisible are scripts, styles, templates, document metadata, form controls
without text, what a drawing has besides labels, comments, elements with ``hidden`` or ``aria-hidden="true"``,
with an inline style of ``display: none`` or ``visibility: hidden``, and the
body of ``details`` that are not open.

Cases: a null page has a null text; an empty one, and one without visible
text, an empty text; broken markup never fails: a ``<`` that opens no tag is
text, open elements are closed at the end. Time and stack do not depend on how
deeply elements are nested.
"""

from __future__ import annotations

import hashlib
import html as entities
import re
from bisect import bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from recollect.llm.common import annotate, table

# Element kinds of the HTML standard.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
UNSEEN = frozenset("script style template head title meta link base noscript iframe object canvas audio video datalist noembed noframes annotation annotation-xml".split())
#: In a drawing text is shown in labels only, and not in those of parts that are only defined.
LABEL = frozenset("text foreignobject".split())
DEFINED = frozenset("defs symbol clippath mask pattern marker".split())
SPACED = frozenset("p h1 h2 h3 h4 h5 h6 ul ol dl pre blockquote figure table hr fieldset".split())
BLOCK = SPACED | frozenset("html body address article aside center details dialog dd div dir dt figcaption footer form header hgroup legend li main menu nav optgroup option search section select summary textarea caption thead tbody tfoot tr".split())
CLOSES_P = SPACED | frozenset("address article aside center details dialog dir div dl fieldset figcaption figure footer form header hgroup main menu nav search section summary".split())
#: What an opening tag closes, up to the elements that it may not reach across.
IMPLIED = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "option": ({"option"}, {"select", "datalist", "optgroup"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "tr": ({"tr", "td", "th", "caption", "colgroup"}, {"table", "tbody", "thead", "tfoot"}),
    "tbody": ({"tbody", "thead", "tfoot", "caption", "colgroup"}, {"table"}),
    "thead": ({"tbody", "thead", "tfoot", "caption", "colgroup"}, {"table"}),
    "tfoot": ({"tbody", "thead", "tfoot", "caption", "colgroup"}, {"table"}),
    "body": ({"head"}, {"html"}),
}
PARTS = frozenset("table tbody thead tfoot tr td th caption".split())
#: End tags that do reach across a table's border.
ACROSS = PARTS - {"caption"} | {"body", "html"}
#: Elements that an end tag or an implied end does not reach across.
SCOPE = frozenset("table td th caption html template".split())

_TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>")
_LOOSE = re.compile(r"<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)>")
_ATTRIBUTE = re.compile(r"([^\s=/\"'>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_NOT_SHOWN = re.compile(r"display\s*:\s*none|visibility\s*:\s*(?:hidden|collapse)", re.I)
_SPACE = re.compile(r"[ \t\n\r\f]+")


def attributes(raw: str) -> dict[str, str]:
    return {m[1].lower(): entities.unescape(m[2] or m[3] or m[4] or "") for m in _ATTRIBUTE.finditer(raw)} if raw.strip(" /\n\t") else {}


def _tokens(page: str) -> Iterator[tuple[str, str, str]]:
    """('text', text, ''), ('open', tag, attributes) and ('close', tag, '')."""
    at, n = 0, len(page)
    last = page.rfind(">")
    while at < n:
        lt = page.find("<", at)
        if lt < 0 or lt > last:
            yield "text", page[at:], ""
            return
        if lt > at:
            yield "text", page[at:lt], ""
        if page.startswith("<!--", lt):
            end = page.find("-->", lt + 4)
            at = n if end < 0 else end + 3
        elif page.startswith(("<!", "<?"), lt):
            at = page.find(">", lt) + 1
        elif m := (_TAG.match(page, lt) or _LOOSE.match(page, lt)):
            tag, at = m[2].lower(), m.end()
            yield ("close" if m[1] else "open"), tag, m[3]
            if not m[1] and tag in RAW:
                close = re.compile(rf"</{re.escape(tag)}(?=[\s/>])", re.I).search(page, at)
                end = close.start() if close else n
                yield "text", page[at:end], "raw"
                at = end
        else:
            yield "text", "<", ""
            at = lt + 1


def events(page: str) -> Iterator[tuple[str, str, str]]:
    """``_tokens`` in tree order: every 'open' of an element that is not void has its 'close'."""
    stack: list[str] = []
    # where in the stack the elements of each tag are, and its parts of tables: nothing is looked for element by element
    places: dict[str, list[int]] = {}
    parts: list[str] = []

    def push(tag: str) -> None:
        places.setdefault(tag, []).append(len(stack))
        stack.append(tag)
        if tag in PARTS:
            parts.append(tag)

    def pop() -> tuple[str, str, str]:
        tag = stack.pop()
        places[tag].pop()
        if tag in PARTS:
            parts.pop()
        return "close", tag, ""

    def reach(tags: set[str], stops) -> int:
        """How many elements must go for the outermost of ``tags`` inside ``stops`` to close; 0 if none is open."""
        held = [p for t in tags if (p := places.get(t))]
        if not held:
            return 0
        stop = innermost(places, (t for t in stops if t not in tags))
        inside = [p[at] for p in held if (at := bisect_right(p, stop)) < len(p)]
        return len(stack) - min(inside) if inside else 0

    for kind, tag, more in _tokens(page):
        if kind == "text":
            yield kind, tag, more
        elif kind == "open":
            close = 0
            if tag in CLOSES_P:
                close = reach({"p"}, SCOPE)
            if tag in IMPLIED:
                close = max(close, reach(*IMPLIED[tag]))
            for _ in range(close):
                yield pop()
            parent = parts[-1] if parts else ""
            if tag in ("tr", "td", "th") and parent == "table":
                push("tbody")
                yield "open", "tbody", ""
                parent = "tbody"
            if tag in ("td", "th") and parent in ("tbody", "thead", "tfoot"):
                push("tr")
                yield "open", "tr", ""
            yield kind, tag, more
            if tag in VOID:
                yield "close", tag, ""
            else:
                push(tag)
        elif tag not in VOID:
            for _ in range(reach_end(len(stack), places, tag)):
                yield pop()
        elif tag == "br":
            yield "open", "br", ""
            yield "close", "br", ""
    while stack:
        yield pop()


def innermost(places: dict[str, list[int]], tags) -> int:
    """Where the innermost of ``tags`` is, -1 if none is open."""
    return max((p[-1] for t in tags if (p := places.get(t))), default=-1)


def reach_end(depth: int, places: dict[str, list[int]], tag: str) -> int:
    """Elements that an end tag closes: up to the innermost of its kind, not across a table's border."""
    at = innermost(places, (tag,))
    border = -1 if tag in ACROSS else innermost(places, ("td", "th", "table"))
    return depth - at if at >= 0 and at > border else 0


class Flow:
    """Lines under construction."""

    def __init__(self) -> None:
        self.lines: list[str] = []
        self.run: list[str] = []
        self.gap = 0
        self.indents: list[str] = []
        self.bullet = ""
        self.open_space = False

    def text(self, s: str, kept: bool) -> None:
        if kept:
            for i, part in enumerate(s.replace("\r\n", "\n").split("\n")):
                if i:
                    self.flush(True)
                self.run.append(part)
            return
        s = _SPACE.sub(" ", s)
        if not self.run or self.open_space:
            s = s.removeprefix(" ")
        if s:
            self.run.append(s)
            self.open_space = s.endswith(" ")

    def flush(self, kept: bool = False) -> None:
        line = "".join(self.run)
        self.run, self.open_space = [], False
        line = line.rstrip() if kept else line.strip(" ")
        if line or kept:
            self.put(line)

    def put(self, line: str) -> None:
        if self.lines and self.gap:
            self.lines += [""] * self.gap
        self.gap = 0
        indent = "".join(self.indents)
        if self.bullet:
            indent, self.bullet = indent[: len(indent) - len(self.bullet)] + self.bullet, ""
        self.lines.append((indent + line.replace(" ", " ")).rstrip())

    def border(self, blank: bool) -> None:
        self.flush()
        self.gap = max(self.gap, int(blank))


#: Columns are padded up to this width; a longer cell pushes its own line only.
WIDEST = 40


def table_lines(rows: list[list[list[str]]]) -> list[str]:
    """Cells (lists of lines) as lines with the columns aligned."""
    columns = max(map(len, rows), default=0)
    widths = [min(WIDEST, max((len(line) for row in rows if i < len(row) for line in row[i]), default=0)) for i in range(columns)]
    out = []
    for row in rows:
        if not any(line for cell in row for line in cell):
            continue
        for i in range(max(map(len, row))):
            parts = [(cell[i] if i < len(cell) else "").ljust(w) for cell, w in zip(row, widths, strict=False)]
            out.append(" | ".join(parts).rstrip() if columns > 1 else parts[0].rstrip())
    return out


def _hidden(tag: str, raw: str) -> bool:
    if tag in UNSEEN:
        return True
    low = raw.lower()
    if "hidden" not in low and "display" not in low and "visibility" not in low and tag != "input":
        return False
    a = attributes(raw)
    return "hidden" in a or a.get("aria-hidden", "").lower() == "true" or bool(_NOT_SHOWN.search(a.get("style", "")))


def _number(value: str, default: int) -> int:
    return int(value) if re.fullmatch(r"-?[0-9]{1,9}", value or "") else default


def render(page: str) -> str:
    flow = Flow()
    flows: list[Flow] = []
    tables: list[list[list[list[str]]]] = []
    lists: list[int | None] = []
    opened: list[tuple[str, bool, int]] = []  # tag, hides, indents it added
    hidden = kept = closed_details = drawings = labels = 0
    for kind, tag, more in events(page):
        if kind == "text":
            if not hidden and not (opened and opened[-1][0] == "details-closed") and (labels or not drawings):
                area = opened and opened[-1][0] == "textarea"
                flow.text(entities.unescape(tag.replace("\r\n", "\n").removeprefix("\n")) if area else tag if more == "raw" else entities.unescape(tag), kept > 0)
            continue
        if kind == "open":
            hides = _hidden(tag, more) or (closed_details > 0 and opened and opened[-1][0] == "details-closed" and tag != "summary")
            if tag in VOID:
                if not (hidden or hides):
                    if tag == "br":
                        flow.flush(True) if flow.run else flow.put("") if flow.lines and not flow.gap else None
                    elif tag == "hr":
                        flow.border(True)
                    elif tag == "img" and (alt := attributes(more).get("alt", "").strip()):
                        flow.text(alt, False)
                continue
            name = tag
            if drawings and tag in LABEL | DEFINED and not more.rstrip().endswith("/"):
                name = "drawing-label" if tag in LABEL else tag
                hides = hides or tag in DEFINED
            drawings += tag == "svg"
            labels += name == "drawing-label"
            hidden += hides
            added = 0
            if not hidden:
                if tag in BLOCK or name == "drawing-label":
                    nested = tag in ("ul", "ol") and lists
                    flow.border(tag in SPACED and not nested)
                if tag in ("ul", "menu", "dir"):
                    lists.append(None)
                elif tag == "ol":
                    lists.append(_number(attributes(more).get("start", ""), 1))
                elif tag == "li":
                    flow.bullet = f"{lists[-1]}. " if lists and lists[-1] is not None else "- "
                    flow.indents.append(" " * len(flow.bullet))
                    added = 1
                    if lists and lists[-1] is not None:
                        lists[-1] += 1
                elif tag in ("dd", "blockquote"):
                    flow.indents.append("  ")
                    added = 1
                elif tag in ("pre", "textarea"):
                    kept += 1
                elif tag == "table":
                    tables.append([])
                elif tag == "tr" and tables:
                    tables[-1].append([])
                elif tag in ("td", "th") and tables:
                    if not tables[-1]:
                        tables[-1].append([])
                    flows.append(flow)
                    flow = Flow()
                    added = _number(attributes(more).get("colspan", ""), 1) if "colspan" in more else 1
                elif tag == "details" and "open" not in attributes(more):
                    name = "details-closed"
                    closed_details += 1
            opened.append((name, hides, added))
            continue
        if tag in VOID or not opened:
            continue
        name, hides, added = opened.pop()
        if not hidden:
            if name in ("td", "th") and tables and flows:
                flow.flush()
                cell, flow = flow.lines, flows.pop()
                tables[-1][-1] += [cell, *[[""]] * (min(max(added, 1), 100) - 1)]
            elif name == "table" and tables:
                rows = tables.pop()
                flow.border(True)
                for line in table_lines(rows):
                    flow.put(line)
                flow.border(True)
            else:
                if name in ("pre", "textarea") and flow.run:
                    flow.flush(True)
                if name in BLOCK or name in ("details-closed", "drawing-label"):
                    nested = name in ("ul", "ol") and len(lists) > 1
                    flow.border(name in SPACED and not nested)
                if name in ("ul", "menu", "dir", "ol") and lists:
                    lists.pop()
                elif name in ("pre", "textarea"):
                    kept -= 1
                if added and name in ("li", "dd", "blockquote"):
                    flow.indents.pop()
                    flow.bullet = ""
                if name == "details-closed":
                    closed_details -= 1
        hidden -= hides
        drawings -= name == "svg"
        labels -= name == "drawing-label"
    flow.flush()
    while flows:  # cells that an end of the page closed are closed by events; nothing is left here
        flow = flows.pop()
    return "\n".join(flow.lines).strip("\n")


FIELDS = [("text", T.StringType()), ("text_sha256", T.StringType()), ("n_lines", T.LongType()), ("n_chars", T.LongType())]


def extract_text(pages: DataFrame, html_col: str = "html", keep: list[str] | None = None) -> DataFrame:
    """``pages`` without the markup, with text, text_sha256, n_lines and n_chars."""
    names = [c for c in (pages.columns if keep is None else keep) if c != html_col]

    def make():
        def run(batch: pa.RecordBatch) -> list:
            texts = [None if p is None else render(p) for p in batch.column(html_col).to_pylist()]
            return [texts, [None if t is None else hashlib.sha256(t.encode("utf-8", "surrogatepass")).hexdigest() for t in texts], [None if t is None else t.count("\n") + bool(t) for t in texts], [None if t is None else len(t) for t in texts]]

        return run

    return annotate(pages, html_col, FIELDS, make, names, limit=1 << 20)


def op7_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_text(table(spark, sf_dir, "pages"), keep=["page_id"])
