"""Pages of official law sites: numbered articles with the headings above them, by the way each site lays them out."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

ARTICLES = T.StructType(
    [
        T.StructField("articles", T.ArrayType(T.StructType([T.StructField("no", T.StringType()), T.StructField("text", T.StringType()), T.StructField("path", T.ArrayType(T.StringType()))]))),
        T.StructField("error", T.StringType()),
    ]
)
#: Numerals on these pages, how articles, points and headings are written, and the levels of headings.
CHARS = "0-9一二三四五六七八九十百千零〇兩ㄧ"
ARTICLE_NO = rf"第?[\s{CHARS}]+條(?:之[\s{CHARS}]+)?"
POINT_NO = rf"([{CHARS}]+)(?:之([{CHARS}]+))?(?:[、．.]|[ \t　\xa0]{{2,}})"
HEADING_LEVELS = "編章節款目"
HEADING = rf"第[\s　\xa0{CHARS}]+[{HEADING_LEVELS}](?:[ \t　\xa0]+[^\n]*)?"
#: Elements that begin a line, and those that never have content.
LINES = frozenset("p div br li ul ol tr table pre h1 h2 h3 h4 dd dt".split())
EMPTY = frozenset("br img hr input meta link col area base source wbr".split())
#: What a new element of one kind ends if it is still open.
ENDS = {"li": {"li"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "p": {"p"}}


class Node:
    def __init__(self, tag: str, attrs: dict[str, str]) -> None:
        self.tag, self.attrs, self.parts = tag, attrs, []

    @property
    def classes(self) -> list[str]:
        return (self.attrs.get("class") or "").split()

    def nodes(self) -> list[Node]:
        return [p for p in self.parts if isinstance(p, Node)]

    def walk(self) -> Iterator[Node]:
        yield self
        for n in self.nodes():
            yield from n.walk()

    def all(self, test: Callable[[Node], bool]) -> list[Node]:
        return [n for n in self.walk() if test(n)]

    def text(self) -> str:
        out = []
        for p in self.parts:
            if isinstance(p, str):
                out.append(p)
            elif p.tag not in ("script", "style"):
                out.append(("\n" if p.tag in LINES else "") + p.text() + ("\n" if p.tag in LINES and p.tag != "br" else ""))
        return "".join(out)


class Tree(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.root = Node("", {})
        self.open = [self.root]

    def handle_starttag(self, tag: str, attrs: list) -> None:
        while self.open[-1].tag in ENDS.get(tag, ()):
            self.open.pop()
        node = Node(tag, {k: v or "" for k, v in attrs})
        self.open[-1].parts.append(node)
        if tag not in EMPTY:
            self.open.append(node)

    def handle_endtag(self, tag: str) -> None:
        at = next((i for i in range(len(self.open) - 1, 0, -1) if self.open[i].tag == tag), 0)
        if at:
            del self.open[at:]

    def handle_data(self, data: str) -> None:
        self.open[-1].parts.append(data)


def tree_of(html: str) -> Node:
    reader = Tree()
    reader.feed(html)
    reader.close()
    return reader.root


def compact(text: str) -> str:
    return re.sub(r"\s+", " ", text).strip()


def block(text: str) -> str:
    """A text with its lines trimmed and no empty ones."""
    return "\n".join(x for x in (re.sub(r"[ \t\xa0]+", " ", y).strip() for y in text.split("\n")) if x)


class Headings:
    """The headings in force, each ending those of its level and below."""

    def __init__(self) -> None:
        self.now: list[tuple[int, str]] = []

    def take(self, label: str) -> None:
        level = next((HEADING_LEVELS.index(c) for c in label if c in HEADING_LEVELS), 1)
        self.now = [(n, x) for n, x in self.now if n < level] + [(level, label)]

    @property
    def path(self) -> list[str]:
        return [x for _, x in self.now]


Rows = list[tuple[str, str, list[str]]]


def as_point(number: str, inserted: str | None = None) -> str:
    return f"第{re.sub(r'\s', '', number)}{f'之{inserted}' if inserted else ''}點"


def by_rows(root: Node) -> Rows:
    """Rows of class ``row`` with a number and lines, headings of class ``char-N`` between them (the national site)."""
    out, headings = [], Headings()
    for box in root.all(lambda n: "law-reg-content" in n.classes):
        for row in box.nodes():
            if any(re.fullmatch(r"char-\d+", c) for c in row.classes):
                headings.take(compact(row.text()))
                continue
            no = row.all(lambda n: "col-no" in n.classes)
            body = row.all(lambda n: "law-article" in n.classes)
            if len(no) != 1 or len(body) != 1 or body[0].all(lambda n: n.tag in ("table", "img", "svg", "math", "iframe")):
                raise ValueError("incomplete article row")
            out.append((compact(no[0].text()), "\n".join(x for x in (block(n.text()) for n in body[0].nodes()) if x), headings.path))
    return out


def by_list(root: Node) -> Rows:
    """List items with a number and a text, or a text that begins with a point's number; items of class ``chapter...`` are headings."""
    out, path = [], []
    for item in [n for box in root.all(lambda n: n.tag == "ul" and "law-content" in n.classes) for n in box.nodes() if n.tag == "li"]:
        if any(c.startswith("chapter") for c in item.classes):
            path = [compact(item.text())]
            continue
        no, body = (item.all(lambda n, c=c: c in n.classes) for c in ("col-no", "law-articlepre"))
        text = block(body[0].text()) if body else ""
        if no and body:
            out.append((compact(no[0].text()), text, path))
        elif body:
            out.append((*numbered_point(text), path))
    return out


def numbered_point(text: str) -> tuple[str, str]:
    m = re.match(POINT_NO, text)
    if not m:
        raise ValueError(f"no number before: {text[:20]}")
    return as_point(m[1], m[2]), text[m.end() :].strip()


def by_columns(root: Node) -> Rows:
    """Table rows with a cell of class ``col-th`` and one of class ``col-td``; bare numbers are points."""
    out = []
    for row in root.all(lambda n: n.tag == "tr"):
        no, body = ([c for c in row.nodes() if k in c.classes] for k in ("col-th", "col-td"))
        if no and body:
            label = compact(no[0].text())
            out.append((f"第 {label} 點" if re.fullmatch(r"\d+", label) else label, block(body[0].text()), []))
    return out


def by_table(root: Node) -> Rows:
    """Rows of the table ``tableLawArticle``: one cell is a heading, more are a number and a text that may hold the number itself."""
    out, path = [], []
    for row in [r for t in root.all(lambda n: "tableLawArticle" in n.attrs.get("id", "")) for r in t.all(lambda n: n.tag == "tr")]:
        cells = [c for c in row.nodes() if c.tag in ("td", "th")]
        if len(cells) == 1 and re.search("第.*[章節編]", compact(cells[0].text())):
            path = [compact(cells[0].text())]
        elif len(cells) >= 2:
            no, text = compact(cells[0].text()), block(cells[-1].text())
            if bare := re.fullmatch(rf"([{CHARS}]+)(?:之([{CHARS}]+))?[、.．]?", no):
                no = as_point(bare[1], bare[2])
            elif not no and (m := re.match(rf"\s*({ARTICLE_NO})", text)):
                no, text = compact(m[1]), text[m.end() :].strip()
            elif not no and text:
                no, text = numbered_point(text)
            if text:
                out.append((no, text, path))
    return out


def pieces(text: str, pattern: str) -> Iterator[tuple[re.Match, str]]:
    """Each match with what stands between it and the next."""
    found = list(re.finditer(pattern, text))
    ends = [m.start() for m in found[1:]] + [len(text)]
    for m, end in zip(found, ends, strict=False):
        yield m, text[m.end() : end].strip()


def by_headings(root: Node) -> Rows:
    """One text with article numbers at the beginning of lines, white space behind them, and chapter headings on lines of their own; else points."""
    bodies = root.all(lambda n: "divLawContent08" in n.attrs.get("id", ""))
    if not bodies:
        raise ValueError("no container")
    text, out, path = block(bodies[0].text()), [], []
    pattern = rf"(?m)^[ \t　\xa0]*(?:(?P<article>{ARTICLE_NO})(?=[ \t　\xa0]|$)|(?P<chapter>{HEADING})$)"
    for m, body in pieces(text, pattern):
        if m["chapter"]:
            path = [compact(m["chapter"])]
        elif body:
            out.append((compact(m["article"]), body, path))
    return out or [(as_point(m[1], m[2]), body, []) for m, body in pieces(text, rf"(?m)^[ \t　\xa0]*{POINT_NO}") if body]


def by_bold(root: Node) -> Rows:
    """Article numbers in bold, each with the text up to the next."""
    out: list[list] = []

    def visit(node: Node) -> None:
        for p in node.parts:
            if isinstance(p, Node) and p.tag in ("strong", "b"):
                label = compact(p.text())
                if not re.fullmatch(ARTICLE_NO, label):
                    raise ValueError(f"bold text that is no heading: {label[:20]}")
                out.append([label, ""])
            elif isinstance(p, Node):
                if p.tag in LINES and out:
                    out[-1][1] += "\n"
                visit(p)
            elif out:
                out[-1][1] += p
            elif p.strip():
                raise ValueError("text before the first heading")

    for box in root.all(lambda n: "divLawContent08" in n.attrs.get("id", "")):
        visit(box)
    return [(no, block(text), []) for no, text in out]


def by_ordered_list(root: Node) -> Rows:
    """Items of an ordered list as numbered points, items of a list inside one as numbered lines."""
    lists = [n for box in root.all(lambda n: "divLawContent08" in n.attrs.get("id", "")) for n in box.all(lambda n: n.tag == "ol")][:1]
    if not lists:
        raise ValueError("no ordered list")
    out = []
    for i, item in enumerate((n for n in lists[0].nodes() if n.tag == "li"), 1):
        inner = [n for ol in item.nodes() if ol.tag == "ol" for n in ol.nodes() if n.tag == "li"]
        own = Node("li", {})
        own.parts = [p for p in item.parts if not (isinstance(p, Node) and p.tag == "ol")]
        out.append((f"第{i}點", "\n".join([block(own.text()), *[f"  {j}. {block(n.text())}" for j, n in enumerate(inner, 1)]]), []))
    return out


def by_attachments(root: Node) -> Rows:
    """Pages that hold nothing but links to their attachments: no articles."""
    if not root.all(lambda n: n.tag == "a" and re.search("Download|LawFileList|LawGetFile", n.attrs.get("href", ""))):
        raise ValueError("no attachments")
    return []


LAYOUTS = {
    "rows": by_rows, "list": by_list, "columns": by_columns, "table": by_table, "headings": by_headings,
    "bold-article-headings": by_bold, "decimal-dom-list": by_ordered_list, "attachment-only": by_attachments,
}


def read_page(html: str, layout: str) -> tuple[Rows | None, str | None]:
    """Articles of a page, or why it can't be read for certain: unknown parts, repeated numbers, nothing found."""
    try:
        rows = LAYOUTS[layout](tree_of(html))
    except (ValueError, KeyError) as e:
        return None, str(e)
    if len({re.sub(r"\s", "", no) for no, *_ in rows}) != len(rows):
        return None, "repeated number"
    return (None, "no articles") if not rows and layout != "attachment-only" else (rows, None)


@F.pandas_udf(ARTICLES)
def page_articles(html: pd.Series, layout: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([read_page(h or "", x or "") for h, x in zip(html, layout, strict=True)], columns=["articles", "error"])


def site_articles(pages: DataFrame, key: str, html: str, layout: Column) -> tuple[DataFrame, DataFrame]:
    """(key, ord, no, text, path) of pages that could be read for certain, and (key, error) of the others."""
    read = pages.select(key, page_articles(F.col(html), layout).alias("p"))
    good = read.where("p.error is null").select(key, F.posexplode("p.articles").alias("ord", "a")).select(key, "ord", "a.*")
    return good, read.where("p.error is not null").select(key, F.col("p.error").alias("error"))


@F.pandas_udf(T.ArrayType(T.StructType([T.StructField("title", T.StringType()), T.StructField("url", T.StringType())])))
def page_attachments(html: pd.Series) -> pd.Series:
    """Links to files that a page offers, each once."""

    def one(h: str | None) -> list[tuple[str, str]]:
        links = tree_of(h or "").all(lambda n: n.tag == "a" and bool(re.search("Download|LawFileList|LawGetFile", n.attrs.get("href", ""))))
        return list(dict.fromkeys((compact(n.text()) or "附件", n.attrs["href"]) for n in links))

    return html.map(one)


@F.pandas_udf(T.StringType())
def page_history(html: pd.Series) -> pd.Series:
    """A law's history as its page gives it, links left out; null if there is none."""

    def one(h: str | None) -> str | None:
        parts = [x for box in tree_of(h or "").all(lambda n: "law-history" in n.classes) for x in box.all(lambda n: "text-pre" in n.classes)]
        return "\n".join(block(x.text()) for x in parts) or None

    return html.map(one)


#: Elements kept by ``safe_html`` and their attributes; of others only the text stays, of these nothing.
SAFE = {"p": (), "br": (), "table": (), "thead": (), "tbody": (), "tr": (), "td": ("rowspan", "colspan"), "th": ("rowspan", "colspan"), "ul": (), "ol": (), "li": (), "b": (), "strong": (), "sup": (), "sub": (), "h1": (), "h2": (), "h3": ()}
DROPPED = ("script", "style", "iframe", "object", "form")


@F.pandas_udf(T.StringType())
def safe_html(html: pd.Series) -> pd.Series:
    """A page with plain elements only: no scripts, links, images or styles."""
    escape = lambda s: s.replace("&", "&amp;").replace("<", "&lt;").replace(">", "&gt;").replace('"', "&quot;")

    def show(node: Node) -> str:
        if node.tag in DROPPED:
            return ""
        inside = "".join(escape(p) if isinstance(p, str) else show(p) for p in node.parts)
        if node.tag not in SAFE:
            return inside
        attrs = "".join(f' {k}="{node.attrs[k]}"' for k in SAFE[node.tag] if re.fullmatch(r"\d+", node.attrs.get(k, "")))
        return f"<{node.tag}{attrs}>" + ("" if node.tag in EMPTY else f"{inside}</{node.tag}>")

    return html.map(lambda h: None if h is None else show(tree_of(h)))
