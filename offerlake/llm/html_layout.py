"""Text of web pages by layout.

A page is read into a tree: tags that may be left out are implied (an open `p` ends where a block begins, `li`, `dt`, `tr`, `td`, `option` end
at the next of their kind), void elements take no children, stray end tags are passed over, what is open at the end is closed. What a
browser would not show is left out: scripts, styles, the head, templates, fallback content, `hidden`, inline styles and simple rules (a tag, a class or an id)
of the page's own style sheets that hide, closed details and dialogs. Rules count as they do on a screen: what is in a comment, for print or
under a condition (a width, @supports, nesting) hides nothing, and of the rules for an element the strongest decides, the later of
equals. All other text is written in order, formulas and the labels of drawings inline: blocks on lines of their own,
paragraphs and headings with an empty line around them, list items with their marker or number and indented by depth, `pre` as it is,
table cells in columns. A column is as wide as its widest cell up to `WIDE` characters, so padding stays in proportion to the text.

The tree is walked without recursion, so depth has no limit; time and memory are in proportion to the page.

Defined results: an empty table gives no rows and repeated rows have the same text; a null page has null text, an empty page or one with nothing visible has empty text; a page may be anything, text without tags comes out as one
paragraph; repeated rows come out alike; other columns are kept, except one named `text`, which is replaced.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from .catalog import query, table

WIDE = 40
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style title textarea xmp iframe noembed noframes noscript".split())
UNSEEN = frozenset("script style title head template iframe noembed noframes noscript datalist audio video canvas object param rp annotation annotation-xml mphantom".split())
# Of a drawing only labels and pages set in it are text; what these tags hold is drawn elsewhere or not at all.
LABELS = frozenset("text foreignobject".split())
UNDRAWN = frozenset("defs symbol clippath mask pattern marker desc metadata".split())
# Parts of a formula that do not touch.
SIDE_BY_SIDE = frozenset("mfrac mtable mtr mlabeledtr".split())
# A start tag that ends a drawing or formula left open, unless a part that may hold pages stands between.
ENDS_FOREIGN = frozenset("b big blockquote body br center code dd div dl dt em embed h1 h2 h3 h4 h5 h6 head hr i img li listing menu meta nobr ol p pre ruby s small span strong strike sub sup table tt u ul var".split())
HOLDS_PAGE = frozenset("foreignobject desc annotation-xml mi mo mn ms mtext".split())
SPACED = frozenset("p h1 h2 h3 h4 h5 h6 ul ol dl pre blockquote table figure menu dir".split())
BLOCK = SPACED | frozenset("html body div section article aside nav header footer main address form fieldset legend li dt dd figcaption details summary dialog hr center hgroup search optgroup option caption listing xmp".split())
ENDS_P = BLOCK - frozenset("html body li dt dd legend figcaption caption option optgroup summary".split()) | {"table", "summary"}
# A start tag ends an open tag of its own kind if no other tag named here stands between.
IMPLIED = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "option": ({"option"}, {"select", "datalist"}),
    "optgroup": ({"option", "optgroup"}, {"select"}), "tr": ({"tr", "td", "th", "caption", "colgroup"}, {"table"}), "td": ({"td", "th", "caption", "colgroup"}, {"tr", "table"}),
    "th": ({"td", "th", "caption", "colgroup"}, {"tr", "table"}), "tbody": ({"tbody", "thead", "tfoot", "tr", "td", "th", "caption", "colgroup"}, {"table"}), "rt": ({"rt", "rp"}, {"ruby"}), "rp": ({"rt", "rp"}, {"ruby"}),
}
IMPLIED["thead"] = IMPLIED["tfoot"] = IMPLIED["tbody"]
SCOPES = frozenset("table td th caption button object template html applet marquee".split())
TOKEN = re.compile(r"<!--.*?(?:--!?>|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*>?|</([a-zA-Z][^\s/>]*)[^>]*>?|<([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*|[^>]*)>", re.S)
LOOSE = re.compile(r"<!--.*?(?:--!?>|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*>?|</([a-zA-Z][^\s/>]*)[^>]*>?|((?!))((?!))", re.S)     # the same without start tags
ATTRIBUTE = re.compile(r"([^\s=/>\"']+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
HIDES = {"display": {"none"}, "visibility": {"hidden", "collapse"}, "content-visibility": {"hidden"}}
HIDING = re.compile("display|visibility", re.I)
CSS_NOISE = re.compile(r"/\*.*?(?:\*/|\Z)|(\"(?:[^\"\\\n]|\\.)*\"|'(?:[^'\\\n]|\\.)*')|<!--|-->", re.S)
SCREEN = re.compile(r"(?:only\s+)?(?:all|screen)|not\s+(?!all\b|screen\b)[\w-]+|", re.I)
AT_RULE = re.compile(r"@([\w-]+)")
SELF_CLOSED = re.compile(r"(?:^|[\s\"'])/\Z")
SIMPLE = re.compile(r"[.#]?-?[A-Za-z_][\w-]*")


class Node:
    __slots__ = ("tag", "attrs", "kids")

    def __init__(self, tag: str, attrs: str = ""):
        self.tag, self.attrs, self.kids = tag, attrs, []


def attributes(raw: str) -> dict[str, str]:
    out: dict[str, str] = {}
    for name, a, b, c in ATTRIBUTE.findall(raw):
        out.setdefault(name.lower(), html.unescape(a or b or c))
    return out


def for_screen(media: str) -> bool:
    """Whether a media query holds on every screen."""
    return any(SCREEN.fullmatch(q.strip()) for q in media.split(","))


def declared(body: str) -> dict[str, tuple[bool, bool]]:
    """Of each property in HIDES: whether it is important, and whether it hides."""
    out: dict[str, tuple[bool, bool]] = {}
    for one in body.split(";"):
        name, _, value = one.partition(":")
        name, (value, _, mark) = name.strip().lower(), value.lower().partition("!")
        if name in HIDES and value.strip() and value.strip() not in ("inherit", "unset"):
            important = mark.strip() == "important"
            if important or not out.get(name, (False,))[0]:
                out[name] = (important, value.strip() in HIDES[name])
    return out


def read_rules(css: str, rules: dict[str, dict[str, tuple]], offset: int) -> None:
    """Adds the simple rules of a style sheet that stands at `offset` of its page. For each selector and property: its weight (importance, not inline, layer, kind of selector,
    place) and whether it hides."""
    css = CSS_NOISE.sub(lambda m: '""' if m[1] else " ", css)
    at, open_ = 0, []       # of each open block: its selectors (None for a group of rules), whether its rules count, in a layer, its declarations
    for found in re.finditer(r"[{};]", css + "}" * css.count("{")):
        said, at, mark = css[at:found.start()].strip(), found.end(), found[0]
        if mark == "{":
            group, counts, layered = (None, True, False) if not open_ else open_[-1][:3]
            counts = counts and group is None
            if rule := AT_RULE.match(said):
                kind = rule[1].lower()
                counts = counts and (kind == "layer" or kind == "media" and for_screen(said[rule.end():]))
                open_.append((None, counts, layered or kind == "layer", []))
            else:
                open_.append((said, counts, layered, []))
            continue
        if open_ and open_[-1][0] is not None:
            open_[-1][3].append(said)
        if mark == "}" and open_:
            selectors, counts, layered, body = open_.pop()
            values = declared(";".join(body)) if selectors and counts else {}
            for one in selectors.split(",") if values else ():
                one = one.strip()
                if SIMPLE.fullmatch(one):
                    kind = {"#": 2, ".": 1}.get(one[0], 0)
                    mine = rules.setdefault(one if kind else one.lower(), {})
                    for name, (important, hides) in values.items():
                        weight = (important, False, important == layered, kind, offset + found.start())
                        if name not in mine or weight >= mine[name][0]:
                            mine[name] = (weight, hides)


def parse(page: str) -> tuple[Node, dict[str, dict[str, tuple]]]:
    """The tree, and what the page's style sheets say about simple selectors."""
    root, hidden, at, end = Node("html"), {}, 0, len(page)
    stack = [root]
    open_: dict[str, int] = {"html": 1}

    def pop_to(depth: int) -> None:
        for node in stack[depth:]:
            open_[node.tag] -= 1
        del stack[depth:]

    def close(kinds, stops) -> None:
        """Close the nearest open tag of these kinds, unless one of `stops` is nearer."""
        if not any(open_.get(k) for k in kinds):
            return
        for depth in range(len(stack) - 1, 0, -1):
            if stack[depth].tag in kinds:
                return pop_to(depth)
            if stack[depth].tag in stops:
                return

    last = page.rfind(">") + 1          # no start tag ends after it, so none is looked for there
    while at < end:
        found = TOKEN.search(page, at, last) if at < last else None
        if not found or found.end() == last and found[0].startswith(("<!--", "<![CDATA[")):
            found = LOOSE.match(page, found.start()) if found else LOOSE.search(page, at)
        start = found.start() if found else end
        if start > at:
            stack[-1].kids.append(html.unescape(page[at:start]))
        if not found:
            break
        at = found.end()
        foreign = open_.get("svg") or open_.get("math")
        if foreign and found[0].startswith("<![CDATA["):
            stack[-1].kids.append(found[0][9:].removesuffix("]]>"))
        elif found[1]:
            tag = found[1].lower()
            if tag == "br":
                stack[-1].kids.append(Node("br"))
            elif tag == "p" and not open_.get("p"):
                stack[-1].kids.append(Node("p"))
            elif tag not in ("html", "body"):
                close({tag}, SCOPES - {tag} if tag not in ("table", "tr", "tbody", "thead", "tfoot", "td", "th") else ({"table"} - {tag}))
        elif found[2]:
            tag = found[2].lower()
            if tag in ("html", "body"):
                continue
            if foreign and tag in ENDS_FOREIGN:
                while open_.get("svg") or open_.get("math"):
                    before = len(stack)
                    close({"svg", "math"}, HOLDS_PAGE)
                    if len(stack) == before:
                        break
                foreign = open_.get("svg") or open_.get("math")
            if tag in ENDS_P:
                close({"p"}, SCOPES)
            if tag[0] == "h" and tag[1:].isdigit():
                close({"h1", "h2", "h3", "h4", "h5", "h6"}, SCOPES | BLOCK - {"h1", "h2", "h3", "h4", "h5", "h6"})
            if tag in IMPLIED:
                kinds, stops = IMPLIED[tag]
                while True:
                    before = len(stack)
                    close(kinds, stops)
                    if len(stack) == before:
                        break
            if stack[-1].tag == "head" and tag not in ("title", "meta", "link", "style", "script", "base", "noscript", "template"):
                pop_to(len(stack) - 1)
            node = Node(tag, found[3] or "")
            stack[-1].kids.append(node)
            if (foreign or tag in ("svg", "math")) and SELF_CLOSED.search(node.attrs):
                continue
            if tag in RAW:
                close_at = re.compile(rf"</{re.escape(tag)}(?=[\s/>]|\Z)[^>]*>?", re.I).search(page, at)
                inner = page[at:close_at.start() if close_at else end]
                at = close_at.end() if close_at else end
                if tag == "style":
                    if HIDING.search(inner) and for_screen(attributes(node.attrs).get("media", "")):
                        read_rules(inner, hidden, start)
                else:
                    node.kids.append(html.unescape(inner) if tag in ("title", "textarea") else inner)
            elif tag not in VOID:
                stack.append(node)
                open_[tag] = open_.get(tag, 0) + 1
    return root, hidden


def is_hidden(node: Node, hidden: dict[str, dict[str, tuple]], drawn: bool) -> tuple[bool, bool | None]:
    """Whether the node and all in it are not there, and whether its own text is unseen; None: as its parent's, which is how `visibility` goes down.
    `drawn`: the node is in a drawing, where other tags hold no text and attributes may hide."""
    if node.tag in UNSEEN or drawn and node.tag in UNDRAWN:
        return True, None
    lower = node.attrs.lower()
    named = node.attrs and (hidden or drawn or "hidden" in lower or "style" in lower)
    if not (hidden or named or node.tag == "dialog"):
        return False, None
    attrs = attributes(node.attrs)
    if named and ("hidden" in attrs or node.tag == "input") or node.tag == "dialog" and "open" not in attrs:
        return True, None
    best: dict[str, tuple] = {}
    if drawn:
        best = {name: ((False,), attrs[name].strip().lower() in HIDES[name]) for name in ("display", "visibility") if name in attrs}
    if hidden:
        for selector in (node.tag, f"#{attrs.get('id', '')}", *(f".{c}" for c in attrs.get("class", "").split())):
            for name, rule in hidden.get(selector, {}).items():
                best[name] = max(best.get(name, rule), rule)
    for name, (important, hides) in declared(attrs.get("style", "")).items():
        best[name] = max(best.get(name, ((False,), False)), ((important, True), hides))
    seen = best.pop("visibility", (None, None))[1]
    return any(hides for _, hides in best.values()), seen


class Writer:
    """Collects lines: runs of blanks become one space, `gap` line ends are due before the next text."""

    def __init__(self):
        self.parts, self.gap, self.space, self.indent, self.marker, self.empty = [], 0, False, [], "", True

    def block(self, lines: int) -> None:
        self.gap, self.space = max(self.gap, lines), False

    def begin(self) -> None:
        if self.gap or self.empty:
            if not self.empty:
                self.parts.append("\n" * self.gap)
            lead = "".join(self.indent)
            if self.marker:
                lead = lead[:len(lead) - len(self.marker)] + self.marker
            self.parts.append(lead)
            self.gap, self.space, self.empty = 0, False, False
        elif self.marker:
            self.parts.append(self.marker)
        self.marker = ""

    def text(self, raw: str) -> None:
        words = raw.split()
        if not words:
            self.space = self.space or bool(raw)
            return
        lead = self.space or raw[0].isspace()
        fresh = self.gap or self.empty
        self.begin()
        self.parts.append((" " if lead and not fresh else "") + " ".join(words))
        self.space = raw[-1].isspace()

    def verbatim(self, raw: str) -> None:
        for i, line in enumerate(raw.expandtabs().split("\n")):
            if i:
                if self.empty or self.gap and not line.strip():
                    self.gap = self.gap and self.gap + 1
                    continue
                self.gap += 1
            if line.strip():
                self.begin()
                self.parts.append(line.rstrip())
        self.space = False

    def result(self) -> str:
        return "".join(self.parts)


class Table:
    """Rows of cells (first column, text); `held` has the columns that row spans still fill."""

    def __init__(self):
        self.rows, self.held, self.column = [], {}, 0

    def row(self) -> None:
        self.held = {c: n - 1 for c, n in self.held.items() if n > 1} if self.rows else {}
        self.rows.append([])
        self.column = 0

    def cell(self, text: str, attrs: dict[str, str]) -> None:
        if not self.rows:
            self.row()
        span = lambda k, most: min(most, max(1, int(m[0]))) if (m := re.match(r"\d{1,6}", attrs.get(k, "").strip())) else 1
        while self.column in self.held:
            self.column += 1
        width, height = span("colspan", 1000), span("rowspan", 65534)
        self.rows[-1].append((self.column, text))
        if height > 1:
            self.held.update({self.column + i: height for i in range(width)})
        self.column += width

    def lines(self) -> list[str]:
        wide: dict[int, int] = {}
        rows = [[(c, t.split("\n")) for c, t in row] for row in self.rows]
        for row in rows:
            for c, lines in row:
                wide[c] = max(wide.get(c, 0), *(min(WIDE, len(x)) for x in lines))
        out = []
        used = {c for row in rows for c, lines in row if any(lines)}
        order = [c for c in sorted(wide) if c in used]
        for row in rows:
            cells = {c: lines for c, lines in row if c in used}
            if not cells:
                continue
            last = max(cells)
            for k in range(max(map(len, cells.values()))):
                line = "  ".join((cells[c][k] if c in cells and k < len(cells[c]) else "").ljust(wide[c]) for c in order if c <= last)
                out.append(line.rstrip())
        return out


def whole(text: str | None, otherwise: int) -> int:
    return int(text) if text is not None and re.fullmatch(r"-?\d{1,9}", text.strip()) else otherwise


def render(page: str | None) -> str | None:
    """The visible text of a page."""
    if page is None:
        return None
    root, hidden = parse(page)
    writers, tables, lists, pre = [Writer()], [], [], 0
    drawn: list[str] = []       # the open drawings, and the labels and pages in them
    unseen = [False]            # of the open nodes, whether their own text is hidden
    todo: list[tuple[Node | str, bool]] = [(root, True)]
    while todo:
        node, enter = todo.pop()
        out = writers[-1]
        if isinstance(node, str):
            if not unseen[-1] and (not drawn or drawn[-1] != "svg"):
                out.verbatim(node) if pre else out.text(node)
            continue
        tag = node.tag
        if enter:
            gone, own = is_hidden(node, hidden, bool(drawn) and drawn[-1] != "foreignobject")
            if gone:
                continue
            if tag == "br":
                out.gap, out.space = out.gap + 1 if not out.empty else 0, False
                continue
            if tag in BLOCK:
                out.block(2 if tag in SPACED and not (tag in ("ul", "ol", "menu", "dir") and lists) else 1)
            if tag == "svg" or tag in LABELS and drawn:
                drawn.append(tag)
                out.space = out.space or tag != "svg"
            elif tag == "table":
                tables.append(Table())
            elif tag == "tr" and tables:
                tables[-1].row()
            elif tag in ("td", "th") and tables or tag == "caption":
                writers.append(Writer())
                lists.append(None)
            elif tag in ("ul", "ol", "menu", "dir"):
                attrs = attributes(node.attrs) if tag == "ol" else {}
                back = "reversed" in attrs
                n = sum(isinstance(k, Node) and k.tag == "li" for k in node.kids) if back else 1
                lists.append([whole(attrs.get("start"), n), -1 if back else 1] if tag == "ol" else [])
            elif tag == "li":
                counter = next((x for x in reversed(lists) if x is not None), None)
                if counter:
                    counter[0] = whole(attributes(node.attrs).get("value") if node.attrs else None, counter[0])
                marker = f"{counter[0]}. " if counter else "- "
                if counter:
                    counter[0] += counter[1]
                out.marker = "" if (unseen[-1] if own is None else own) else marker
                out.indent.append(" " * len(marker))
            elif tag in ("blockquote", "dd"):
                out.indent.append("  ")
            elif tag in ("pre", "listing", "xmp", "textarea"):
                pre += 1
            todo.append((node, False))
            unseen.append(unseen[-1] if own is None else own)
            kids = node.kids
            if tag == "details" and "open" not in attributes(node.attrs):
                kids = [k for k in kids if isinstance(k, Node) and k.tag == "summary"][:1]
            if tag in SIDE_BY_SIDE:
                kids = [x for k in kids for x in (" ", k)]
            todo.extend((k, True) for k in reversed(kids))
            continue
        unseen.pop()
        if tag in ("td", "th") and tables or tag == "caption":
            cell = writers.pop().result()
            lists.pop()
            if tag == "caption" or not tables:
                for line in filter(None, cell.split("\n")):
                    writers[-1].text(line)
                    writers[-1].block(1)
            else:
                tables[-1].cell(cell, attributes(node.attrs) if node.attrs else {})
        elif tag == "table":
            for line in tables.pop().lines():
                if line:
                    out.begin()
                    out.parts.append(line)
                out.block(1)
        elif tag in ("ul", "ol", "menu", "dir"):
            lists.pop()
        elif tag == "li":
            out.indent.pop()
            out.marker = ""
        elif tag in ("blockquote", "dd"):
            out.indent.pop()
        elif tag in ("pre", "listing", "xmp", "textarea"):
            pre -= 1
        elif tag == "svg" or tag in LABELS and drawn:
            drawn.pop()
            out.space = out.space or tag != "svg"
        if tag in BLOCK:
            out.block(2 if tag in SPACED and not (tag in ("ul", "ol", "menu", "dir") and lists) else 1)
    return writers[0].result()


def extract(pages: DataFrame, page: str = "html") -> DataFrame:
    """`pages` with `text`, the visible text of every page."""
    @pandas_udf("string")
    def rendered(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for part in parts:
            yield pd.Series([render(x) for x in part], dtype=object)
    return pages.withColumn("text", rendered(F.col(page)))


@query("op2_html_layout")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = extract(table(spark, sf_dir, "pages").select("page_id", "html"))
    return out.select("page_id", "text", F.length("text").cast("bigint").alias("n_chars"))
