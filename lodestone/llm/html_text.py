"""Layout-aware HTML rendering to plain text.

A tree builder with implied end tags drives a renderer by the elements it opens and closes. Blocks keep their
spacing, list items their markers and indent, table cells their columns, preformatted text its white space. Hidden
elements emit nothing. Both work on explicit stacks, and time and output grow with the page and not with its square:
the places of open elements are kept by name, indents end at ``MAX_INDENT`` levels, and a cell wider than ``ALIGN_TO``
columns doesn't widen its column. Spans are bounded as HTML bounds them, to 1,000 columns (of a row altogether) and 65,534 rows.
"""

from __future__ import annotations

import html
import re
import unicodedata
from bisect import bisect_right
from collections import defaultdict, deque

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bpe import slices
from .common import bounded_batches, extended, table

TAG = re.compile(r"<(/?)([A-Za-z][^\s/>]*+)")
#: An attribute and what goes before it: a name, or a sign that stands for one, and a value of three kinds.
ATTRIBUTE = re.compile(r"[\s/]*+(?:(>)|(=?[^\s=/>]*+)(?:\s*+=\s*+(?:\"([^\"]*+)(\")?|'([^']*+)(')?|([^\s>]*+)))?)")
MAX_COLUMNS, MAX_ROWS, MAX_INDENT, ALIGN_TO = 1000, 65534, 40, 120
#: Element classes of HTML.
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
INVISIBLE = frozenset("head script style template noscript title meta link iframe noembed noframes object audio video canvas datalist".split())
#: What svg and math don't show, and their lines; names are in lower case.
UNSHOWN = frozenset("desc metadata defs symbol clippath mask pattern marker annotation annotation-xml".split())
LINES = frozenset("text mtr mlabeledtr".split())
BLOCK = frozenset("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead tr ul caption xmp".split())
SPACED = frozenset("blockquote dl fieldset figure h1 h2 h3 h4 h5 h6 hr menu ol p pre table ul xmp".split())
CLOSES_P = BLOCK - frozenset("body html option optgroup td th tr tbody thead tfoot caption".split())
#: An opened element, the open elements it closes, and the elements that bound the search.
IMPLIED = {
    "li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"}), "optgroup": ({"option", "optgroup"}, {"select"}), "tbody": ({"tbody", "thead", "tfoot", "tr", "td", "th"}, {"table"}),
    "thead": ({"tbody", "thead", "tfoot", "tr", "td", "th"}, {"table"}), "tfoot": ({"tbody", "thead", "tfoot", "tr", "td", "th"}, {"table"}), "body": ({"head"}, set()),
}
SCOPE = frozenset("table td th caption html button object".split())
ROW_SCOPE = frozenset({"table"})
HIDDEN_STYLE = re.compile(r"display\s*:\s*none", re.I)
VISIBILITY = re.compile(r"visibility\s*:\s*(visible|initial|hidden|collapse)", re.I)
ROW_GROUPS = ("tbody", "thead", "tfoot")
ROW_PARTS = ("tr", *ROW_GROUPS)
INDENTED = ("li", "dd", "blockquote")


class Box:
    """Lines of one block context, with collapsing of white space and of vertical space."""

    def __init__(self, tag: str, attributes: dict):
        self.tag, self.attributes = tag, attributes
        self.lines: deque[str] = deque()
        self.inline: list[str] = []
        self.gap = 0
        self.space = False

    def text(self, data: str, pre: bool) -> None:
        if pre:
            first, *rest = data.split("\n")
            self.inline.append(first)
            for line in rest:
                self.newline()
                self.inline.append(line)
            return
        parts = data.split()
        if data[:1].isspace():
            self.space = True
        for k, p in enumerate(parts):
            if (k or self.space) and self.inline:
                self.inline.append(" ")
            self.inline.append(p)
            self.space = False
        if parts and data[-1:].isspace():
            self.space = True

    def newline(self) -> None:
        """Ends the line even where it is empty."""
        self._flush_gap()
        self.lines.append("".join(self.inline).rstrip())
        self.inline, self.space = [], False

    def _flush_gap(self) -> None:
        if self.lines and self.gap:
            self.lines.append("")
        self.gap = 0

    def block(self, gap: int = 0) -> None:
        """Ends the line where there is one; ``gap`` blank lines, at most one, before what follows."""
        if "".join(self.inline).strip():
            self.newline()
        self.inline, self.space = [], False
        self.gap = max(self.gap, gap)

    def add(self, lines: deque[str], gap: int) -> None:
        if lines:
            self.block(gap)
            self._flush_gap()
            if len(self.lines) < len(lines):  # the fewer move to the more, so that deep pages don't copy theirs at each level
                lines.extendleft(reversed(self.lines))
                self.lines = lines
            else:
                self.lines += lines

    def done(self) -> deque[str]:
        self.block()
        while self.lines and not self.lines[-1]:
            self.lines.pop()
        return self.lines


def width(s: str) -> int:
    return len(s) if s.isascii() else sum(0 if unicodedata.combining(c) else 2 if unicodedata.east_asian_width(c) in "WF" else 1 for c in s)


def aligned(rows: list[list]) -> deque[str]:
    """Rows of cells (lines each) with columns padded to their widest cell and set apart by `` | ``."""
    out: deque[str] = deque()
    if not rows:
        return out
    widest = [0] * max(map(len, rows))
    for r in rows:
        for k, c in enumerate(r):
            for x in c:
                w = width(x)
                if widest[k] < w <= ALIGN_TO:
                    widest[k] = w
    for r in rows:
        r = [list(c) for c in r]
        for j in range(max((len(c) for c in r), default=0)):
            cells = [c[j] if j < len(c) else "" for c in r]
            out.append(" | ".join(c + " " * (widest[k] - width(c)) for k, c in enumerate(cells)).rstrip())
    return out


def span(text: str, most: int) -> int:
    """A span of cells; 1 for what is no number."""
    text = text.strip()
    return min(int(text[:9]) if len(text) < 10 else most, most) if text.isdecimal() else 1


class Renderer:
    def __init__(self):
        self.open: list[tuple[str, dict]] = []
        self.places: defaultdict[str, list[int]] = defaultdict(list)  # of open elements, by name
        self.boxes = [Box("", {})]
        self.hidden = 0  # open elements from the outermost hidden one on
        self.seen = [True]  # the visibility of the open elements, which those inside may set anew
        self.foreign = 0  # open svg and math elements
        self.pre = 0
        self.indents = 0

    def last(self, names) -> int:
        """Where the innermost open element of these names is; -1 if none is."""
        return max((self.places[n][-1] for n in names if self.places.get(n)), default=-1)

    def start(self, tag: str, attributes: dict) -> None:
        if tag in IMPLIED:
            closed, bound = IMPLIED[tag]
            outside = self.last(bound)
            inner = (p[k] for n in closed if (p := self.places.get(n)) and (k := bisect_right(p, outside)) < len(p))
            first = min(inner, default=None)
            if first is not None:
                self.close_to(first)
        if tag in ("html", "body") and self.places.get(tag):
            return
        if tag not in INVISIBLE and tag not in ("html", "body", "base") and self.open and self.open[-1][0] == "head":
            self.close_to(len(self.open) - 1)  # content ends an unclosed head
        if tag in CLOSES_P and (at := self.last(("p",))) > self.last(SCOPE):
            self.close_to(at)
        if tag in ("td", "th") and self.last(("tr",)) <= self.last(ROW_SCOPE):
            self.start("tr", {})
        if tag in VOID:
            self.void(tag, attributes)
            return
        self.places[tag].append(len(self.open))
        self.open.append((tag, attributes))
        self.seen.append(self.visible(attributes))
        self.foreign += tag in ("svg", "math")
        if self.hidden or tag in INVISIBLE or self.gone(tag, attributes):
            self.hidden += 1
            return
        box = self.boxes[-1]
        if self.foreign and tag in LINES:
            box.block()
        elif self.foreign and tag == "mtd":
            box.space = True
        if tag in ROW_GROUPS and box.tag == "table":
            box.below.clear()
        if tag in BLOCK:
            nested = tag in ("ul", "ol", "menu") and box.tag == "li"
            box.block(1 if tag in SPACED and not nested else 0)
        if tag in ("li", "dd", "blockquote", "table", "tr", "td", "th", "ul", "ol", "menu"):
            new = Box(tag, attributes)
            if tag == "ol":
                new.count = int(attributes["start"]) if re.fullmatch(r"-?\d{1,9}", attributes.get("start", "")) else 1
            if tag in ("table", "tr"):
                new.rows = []
                new.below = {}  # columns that cells with a rowspan take, and in how many rows yet
            self.boxes.append(new)
            self.indents += tag in INDENTED
        if tag in ("pre", "textarea", "xmp"):
            self.pre += 1

    def visible(self, attributes: dict) -> bool:
        style = attributes.get("style", "")
        found = VISIBILITY.findall(style) if style else []
        if not found and self.foreign and "visibility" in attributes:
            found = VISIBILITY.findall(f"visibility:{attributes['visibility']}")
        return found[-1].lower() in ("visible", "initial") if found else self.seen[-1]

    def gone(self, tag: str, attributes: dict) -> bool:
        """Whether neither the element nor anything inside is laid out, besides elements of ``INVISIBLE``."""
        style = attributes.get("style", "")
        if "hidden" in attributes or style and HIDDEN_STYLE.search(style):
            return True
        if style and tag in ROW_PARTS and (found := VISIBILITY.findall(style)) and found[-1].lower() == "collapse":
            return True
        return self.foreign > 0 and (tag in UNSHOWN or attributes.get("display", "").strip().lower() == "none")

    def void(self, tag: str, attributes: dict) -> None:
        if self.hidden or self.gone(tag, attributes):
            return
        box = self.boxes[-1]
        if tag == "br":
            box.newline()
        elif not self.visible(attributes):
            return
        elif tag == "hr":
            box.add(deque(["---"]), 1)
            box.block(1)
        elif tag == "img" and attributes.get("alt"):
            box.text(attributes["alt"], False)
        elif tag == "input" and attributes.get("type", "text").lower() in ("submit", "button", "reset") and attributes.get("value"):
            box.text(attributes["value"], False)

    def end(self, tag: str) -> None:
        if tag == "br":
            self.void("br", {})
            return
        bound = SCOPE if tag not in SCOPE and tag not in ("tr", "tbody", "thead", "tfoot", "body") else ROW_SCOPE if tag != "table" and tag not in ("html", "body") else frozenset()
        at = self.last((tag,))
        if at >= 0 and at >= self.last(bound):
            self.close_to(at)
        elif tag == "p":  # a lone end tag is an empty paragraph
            self.start("p", {})
            self.end("p")

    def close_to(self, k: int) -> None:
        while len(self.open) > k:
            tag, attributes = self.open.pop()
            self.places[tag].pop()
            self.close(tag, attributes)
            self.seen.pop()

    def close(self, tag: str, attributes: dict) -> None:
        foreign = self.foreign
        self.foreign -= tag in ("svg", "math")
        if self.hidden:
            self.hidden -= 1
            return
        if tag in ("pre", "textarea", "xmp"):
            self.pre -= 1
        box = self.boxes[-1]
        if foreign and tag in LINES:
            box.block()
        if tag in ROW_GROUPS and box.tag == "table":
            box.below.clear()
        if box.tag == tag and box.attributes is attributes:
            self.boxes.pop()
            self.indents -= tag in INDENTED
            outer, lines = self.boxes[-1], box.done()
            if tag in ("td", "th"):
                if hasattr(outer, "rows"):
                    above = self.boxes[-2].below if self.boxes[-2].tag == "table" else {}
                    while len(outer.rows) < MAX_COLUMNS and len(outer.rows) in above:
                        outer.rows.append(())
                    first = len(outer.rows)
                    outer.rows += [lines] + [()] * min(span(attributes.get("colspan", ""), MAX_COLUMNS) - 1, MAX_COLUMNS - first - 1)
                    rows = span(attributes.get("rowspan", ""), MAX_ROWS)
                    if rows != 1:  # 0 stands for all rows that the group still has
                        outer.below.update(dict.fromkeys(range(first, len(outer.rows)), (rows or MAX_ROWS) - 1))
                    return
            elif tag == "tr":
                if hasattr(outer, "rows"):
                    if lines:
                        outer.rows.append([lines])
                    outer.rows.append(box.rows)
                    outer.below = {k: n - 1 for k, n in outer.below.items() if n > 1} | box.below
                    return
                lines += aligned([box.rows])
            elif tag == "table":
                lines += aligned([r for r in box.rows if any(r)])
            elif tag == "li":
                if outer.tag == "ol":
                    mark = f"{outer.count}. "
                    outer.count += 1
                else:
                    mark = "- "
                deep = self.indents >= MAX_INDENT
                if deep and lines:
                    lines[0] = mark + lines[0]
                elif not deep:
                    lines = deque((mark if j == 0 else " " * len(mark)) + x if x or j == 0 else x for j, x in enumerate(lines))
            elif tag in ("dd", "blockquote") and self.indents < MAX_INDENT:
                lines = deque(("    " if tag == "dd" else "> ") + x for x in lines)
            nested = tag in ("ul", "ol", "menu") and outer.tag == "li"
            gap = 1 if tag in SPACED and not nested else 0
            outer.add(lines, gap)
            outer.block(gap)
            return
        if tag in BLOCK:
            box.block(1 if tag in SPACED else 0)

    def text(self, data: str) -> None:
        if self.hidden:
            if self.open[-1][0] != "head" or not data.strip():
                return
            self.close_to(len(self.open) - 1)
        box = self.boxes[-1]
        if box.tag in ("table", "tr") and not data.strip():
            return
        if not self.seen[-1]:
            box.space = True
            return
        box.text(data, self.pre > 0)


def tag_end(source: str, at: int) -> tuple[dict, bool, int]:
    """(attributes, whether the tag closes itself, where it ends) from behind a tag's name; -1 where it never ends."""
    found: dict[str, str] = {}
    if source.startswith(">", at):
        return found, False, at + 1
    while at < len(source):
        m = ATTRIBUTE.match(source, at)
        if m[1]:
            return found, source[m.end() - 2] == "/" and not (m.end() - 1 == at), m.end()
        if m[3] is not None and m[4] is None or m[5] is not None and m[6] is None:
            break  # a quote that never closes
        if m.end() == at:
            break
        if m[2]:
            value = m[3] if m[3] is not None else m[5] if m[5] is not None else m[7] or ""
            found.setdefault(m[2].lower(), html.unescape(value))
        at = m.end()
    return found, False, -1


def render(source: str) -> str:
    """The visible text of one page."""
    r, at, n, done = Renderer(), 0, len(source), 0  # text up to ``done`` is rendered
    while at < n:
        at = source.find("<", at)
        if at < 0:
            break
        if (after := source[at + 1 : at + 2]) in ("!", "?"):
            comment = source.startswith("<!--", at)
            end = source.find("-->", at + 4) if comment else source.find(">", at + 2)
            end = n if end < 0 else end + (3 if comment else 1)
            if at > done:
                r.text(html.unescape(source[done:at]))
            at = done = end
            continue
        m = TAG.match(source, at) if after else None
        if m is None:
            at += 1
            continue
        if at > done:
            r.text(html.unescape(source[done:at]))
        attributes, closes, end = tag_end(source, m.end())
        if end < 0:
            done = n  # a tag that never ends holds the rest of the page
            break
        at = done = end
        tag = m[2].lower()
        if m[1]:
            r.end(tag)
            continue
        r.start(tag, attributes)
        if closes and (r.foreign or tag in ("svg", "math")):
            r.end(tag)
            continue
        if tag in RAW:
            last = re.compile(rf"</{tag}(?=[\s/>])", re.I).search(source, at)
            body = source[at : last.start() if last else n]
            if tag in ("textarea", "xmp"):
                r.text(html.unescape(body) if tag == "textarea" else body)
            r.end(tag)
            end = source.find(">", last.end()) if last else -1
            at = done = end + 1 if end >= 0 else n
    if done < n:
        r.text(html.unescape(source[done:]))
    r.close_to(0)
    return "\n".join(r.boxes[0].done())


def extract(pages: DataFrame, html_col: str = "html") -> DataFrame:
    """``pages`` with ``extracted``, the visible text of each page.

    Null html gives null, empty html the empty string. Rows are independent, so repeats, ties and empty tables need
    no rule. Very long pages take time in proportion to their length. A column named extracted is replaced; others stay.
    """
    pages = pages.drop("extracted")

    def run(batches):
        for batch in slices(batches, html_col):
            texts = pa.array([None if h is None else render(h) for h in batch[html_col].to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([*batch.columns, texts], names=[*batch.schema.names, "extracted"])

    return pages.mapInArrow(run, extended(pages, "extracted string"))


def op8_html_layout(spark: SparkSession, sf_dir: str) -> DataFrame:
    bounded_batches(spark)
    return extract(table(spark, sf_dir, "pages").select("page_id", "url", "html")).select("page_id", "url", F.length("extracted").cast("long").alias("n_chars"), F.col("extracted").alias("text"))
