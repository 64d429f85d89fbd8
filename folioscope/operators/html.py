"""HTML to main fragment, Markdown and visible text: a small tree over the standard parser, inside Arrow functions."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator, Sequence
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from folioscope.functions import text as X

# Fixed values of the format.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
DROPPED = {"script", "style", "noscript"}
CHROME = {"nav", "header", "footer"}
CHROME_ROLES = {"navigation", "banner", "contentinfo"}
# Parts of class names that mark page furniture.
CHROME_CLASSES = ["header2025_", "loggedOut_nav", "loggedOut_leftContainer", "loggedOut_hoverDiv", "dropdownUI_dropdownContainer", "footerContainer", "Footer_", "cookie", "Cookie", "consentBanner", "AppDownload", "bottomNavigation", "stickyTab", "notificationBar", "TrustSafety"]
INLINE = set("span strong em b i small a code sup sub label mark".split())
STATIC_LINES = ["We are hiring!", "Help", "Download App", "Open App"]
MAX_MARKDOWN = 200_000
_CLOSES = {"p": {"p"}, "li": {"li"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}


class Node:
    __slots__ = ("attrs", "children", "name", "parent")

    def __init__(self, name: str, attrs: dict[str, str], parent: Node | None) -> None:
        self.name, self.attrs, self.parent, self.children = name, attrs, parent, []

    def walk(self) -> Iterator[Node]:
        """Elements below in document order; without recursion, as pages can be nested deeply."""
        stack = [c for c in reversed(self.children) if isinstance(c, Node)]
        while stack:
            node = stack.pop()
            yield node
            stack += [c for c in reversed(node.children) if isinstance(c, Node)]

    def strings(self) -> Iterator[str]:
        stack: list[Node | str] = [self]
        while stack:
            x = stack.pop()
            if isinstance(x, str):
                if s := x.strip():
                    yield s
            elif x.name not in DROPPED:
                stack += reversed(x.children)

    def text(self, joiner: str = "\n") -> str:
        return joiner.join(self.strings())


class _Tree(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.root = self.at = Node("#document", {}, None)

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag in _CLOSES and self.at.name in _CLOSES[tag]:
            self.at = self.at.parent or self.root
        node = Node(tag, {k: v or "" for k, v in attrs}, self.at)
        self.at.children.append(node)
        if tag not in VOID:
            self.at = node

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.at.children.append(Node(tag, {k: v or "" for k, v in attrs}, self.at))

    def handle_endtag(self, tag: str) -> None:
        node = self.at
        while node.parent is not None and node.name != tag:
            node = node.parent
        if node.parent is not None:
            self.at = node.parent

    def handle_data(self, data: str) -> None:
        self.at.children.append(data)


def parse(html: str | None) -> Node:
    """Comments and declarations are left out."""
    tree = _Tree()
    tree.feed(html or "")
    tree.close()
    return tree.root


def _first(root: Node, test) -> Node | None:
    return next((n for n in root.walk() if test(n)), None)


def main_fragment(root: Node) -> tuple[Node, str]:
    """The element with the page's content and how it was found: #root with over 200 characters of text, main (or its role) or
    article with over 100, #__next, body.
    """
    found = _first(root, lambda n: n.attrs.get("id") == "root")
    if found and len(found.text()) > 200:
        return found, "#root"
    for test in (lambda n: n.name == "main", lambda n: n.attrs.get("role") == "main", lambda n: n.name == "article"):
        if main := _first(root, test):
            if len(main.text()) > 100:
                return main, main.name
            break
    if shell := _first(root, lambda n: n.attrs.get("id") == "__next"):
        return shell, "#__next"
    return _first(root, lambda n: n.name == "body") or root, "document"


def extract_status(text: str, html: str, scanned: int | None = None) -> str:
    """ok, partial or empty_shell, by how much text there is and whether the page is a challenge, by its text and so many characters of its source (None: all)."""
    low, raw, n = text.lower(), html[:scanned].lower(), len(text)
    if any(m in low or m in raw for m in X.TEXT_CHALLENGE):
        return "partial" if n >= 400 else "empty_shell"
    if n >= 6000 and ("expense" in low or "nav" in low or "₹" in text):
        return "ok"
    return "partial" if n >= 500 else "empty_shell"


def _is_chrome(n: Node) -> bool:
    if n.name in CHROME or n.attrs.get("role", "").lower() in CHROME_ROLES:
        return True
    return n.name in ("div", "section") and any(h in n.attrs.get("class", "") for h in CHROME_CLASSES)


_DEEP = 200  # nested elements beyond this depth give their text alone


def markdown(node: Node, depth: int = 0) -> str:
    if depth > _DEEP:
        return unicodedata.normalize("NFKC", node.text(" "))
    return "".join(_emit(c, depth + 1) for c in node.children)


def _inline(node: Node) -> str:
    return unicodedata.normalize("NFKC", node.text(" "))


def _emit(x: Node | str, depth: int) -> str:
    if isinstance(x, str):
        return unicodedata.normalize("NFKC", x) if x.strip() else ""
    if x.name in DROPPED or _is_chrome(x):
        return ""
    if x.name == "br":
        return "\n"
    if re.fullmatch("h[1-6]", x.name):
        title = _inline(x).strip()
        return f"{'#' * int(x.name[1])} {title}\n\n" if title else ""
    if x.name in ("ul", "ol"):
        items = [re.sub(r"\n+", " ", markdown(c, depth).strip()) for c in x.children if isinstance(c, Node) and c.name == "li"]
        lines = [f"{i}. {t}" if x.name == "ol" else f"- {t}" for i, t in enumerate(items, 1) if t]
        return "\n".join(lines) + "\n\n" if lines else ""
    if x.name == "table":
        return _table(x)
    if x.name in ("p", "blockquote"):
        inner = markdown(x, depth).strip()
        return inner + "\n\n" if inner else ""
    return markdown(x, depth)


def _table(table: Node) -> str:
    rows = []
    stack = [c for c in reversed(table.children) if isinstance(c, Node)]
    while stack:  # not into tables within
        node = stack.pop()
        if node.name == "tr":
            cells = [re.sub(r"\s+", " ", _inline(c)).strip() for c in node.children if isinstance(c, Node) and c.name in ("td", "th")]
            if any(cells):
                rows.append(cells)
        elif node.name != "table":
            stack += [c for c in reversed(node.children) if isinstance(c, Node)]
    if not rows:
        return ""
    line = lambda cells: "| " + " | ".join(cells) + " |"
    return "\n".join([line(rows[0]), line(["---"] * len(rows[0])), *map(line, rows[1:])]) + "\n\n"


def collapse(md: str) -> str:
    md = re.sub(r"\n{3,}", "\n\n", re.sub(r"[ \t]+\n", "\n", md)).strip()
    return md + "\n" if md else ""


def to_markdown(html: str | None, most: int | None = MAX_MARKDOWN) -> dict[str, object]:
    """Status, how the fragment was found, its text length, and Markdown without page furniture and static lines, cut to most characters (None: whole)."""
    root, how = main_fragment(parse(html))
    text = root.text()
    md = collapse(markdown(root))
    kept = [x for x in md.splitlines() if x.strip() not in STATIC_LINES]
    removed = len(md.splitlines()) - len(kept)
    md = collapse("\n".join(kept))
    cut = most is not None and len(md) > most
    if cut:
        md = md[:most] + "\n\n<!-- truncated -->\n"
    return {
        "extract_status": extract_status(text, html or ""), "selector": how, "text_length": len(text), "markdown": md,
        "normalize_status": "empty" if not md else "ok" if len(md) >= 800 else "partial", "char_count": len(md), "lines_removed": removed, "truncated": cut,
    }


MARKDOWN_SCHEMA = T.StructType([
    T.StructField("extract_status", T.StringType()), T.StructField("selector", T.StringType()), T.StructField("text_length", T.IntegerType()), T.StructField("markdown", T.StringType()),
    T.StructField("normalize_status", T.StringType()), T.StructField("char_count", T.IntegerType()), T.StructField("lines_removed", T.IntegerType()), T.StructField("truncated", T.BooleanType()),
])


def markdown_of(html: Column, most: int | None = MAX_MARKDOWN) -> Column:
    @F.pandas_udf(MARKDOWN_SCHEMA)
    def convert(pages: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([to_markdown(h, most) for h in pages], columns=MARKDOWN_SCHEMA.names)

    return convert(html)


@F.pandas_udf(T.StringType())
def visible_text(html: pd.Series) -> pd.Series:
    """All text but scripts and styles, one piece a line."""
    return html.map(lambda h: parse(h).text())


def html_to_markdown(df: DataFrame, id_col: str, html_col: str, most: int | None = MAX_MARKDOWN) -> DataFrame:
    """One row a page with the fields of MARKDOWN_SCHEMA; a null page counts as empty. most: characters of Markdown at most, None for whole pages."""
    return df.select(F.col(id_col), markdown_of(F.col(html_col), most).alias("m")).select(id_col, "m.*")


# -- boilerplate ----------------------------------------------------------------------------------------------------


def coverage_threshold(n_docs: Column) -> Column:
    """Documents that must have a line: 2 to 15, one less than all; 1 for a single document."""
    return F.when(n_docs <= 1, 1).otherwise(F.greatest(F.lit(2), F.least(F.lit(15), n_docs - 1)))


def boilerplate_lines(df: DataFrame, id_col: str, text_col: str, static: Sequence[str] = tuple(STATIC_LINES)) -> DataFrame:
    """(line, n_docs): short lines without figures that enough documents have. Counts are summed before the shuffle."""
    lines = F.array_distinct(F.transform(F.split(X.text_of(F.col(text_col)), "\n", -1), lambda s: F.trim(s)))
    good = F.filter(
        lines, lambda s: F.length(s).between(3, 120) & ~s.isin(*static) & ~s.rlike(r"[%₹]|[0-9]{3,}|[0-9]\.[0-9]")
    )
    counts = df.select(F.explode(good).alias("line")).groupBy("line").agg(F.count("*").alias("n_docs"))
    need = df.agg(coverage_threshold(F.count("*")).alias("need"))
    return counts.crossJoin(F.broadcast(need)).where("n_docs >= need").select("line", "n_docs")


def without_lines(df: DataFrame, id_col: str, text_col: str, block: DataFrame) -> DataFrame:
    """(id_col, text, lines_removed): lines whose trimmed form is in block(line) go, and blank lines collapse.

    Only (document, line number) pairs of such lines are shuffled, not the texts' lines.
    """
    lines = F.split(X.text_of(F.col(text_col)), "\n", -1)
    places = df.select(F.col(id_col), F.posexplode(lines).alias("pos", "raw")).withColumn("line", F.trim("raw"))
    gone = places.join(block.select("line"), "line", "left_semi").groupBy(id_col).agg(F.collect_set("pos").alias("gone"))
    kept = F.transform(F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.coalesce("gone", F.array().cast("array<int>"))), lambda i: F.get(lines, i))
    joined = df.join(gone.hint("shuffle_hash"), id_col, "left")
    return joined.select(id_col, X.collapse_blank_lines(F.array_join(kept, "\n")).alias("text"), F.coalesce(F.size("gone"), F.lit(0)).alias("lines_removed"))
