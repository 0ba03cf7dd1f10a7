"""Main text of web pages by host-wide consensus on where it stands."""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gapwright.llm.scratch import kept
from gapwright.llm.text import whole

SALTS = 16
# the text is looked for in a child that holds this share of it
SHARE = 0.6

# fixed values: kinds of elements
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = "script|style|noscript|template|svg|iframe|object|textarea|select|title"
BLOCK = frozenset(
    "address article aside blockquote body center dd details dialog div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 header hgroup hr html li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
CONTAINER = frozenset("article body div main section table tbody td tr center".split())
ASIDE = frozenset("aside button dialog footer form header menu nav".split())
MARKED = re.compile(
    r"(?:^|[\s_-])(?:nav|navbar|navigation|menu|header|masthead|footer|sidebar|aside|widget|ad|ads|advert|adverts|"
    r"advertisement|teaser|teasers|sponsor|sponsored|promo|banner|cookie|cookies|consent|gdpr|notice|notices|popup|modal|overlay|newsletter|"
    r"subscribe|signup|share|sharing|social|comment|comments|replies|respond|disqus|related|breadcrumb|breadcrumbs|"
    r"pagination|pager|toolbar|search|login|skip)(?:$|[\s_-])"
)
# classes that say what an element has or lacks, not what it is
SAYS = re.compile(r"(?<!\S)(?:no|has|with|without|is)[-_]\S+")
REMARK = re.compile(r"(?<!\S)comment(?![^\s_-])")
ROLES = frozenset("navigation banner contentinfo complementary search form alert alertdialog dialog menu menubar".split())

TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)"
    rf"|<({RAW})(?=[\s/>])(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+>.*?(?:</\1(?=[\s/>])[^>]*+>|\Z)"
    r"|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>"
    r"|</?[a-zA-Z!?][^>]*+(?:>|\Z)",
    re.S | re.I,
)
ATTRIBUTE = re.compile(r"([a-zA-Z-]+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))|(?<![\w-])(hidden)(?![\w-])")
DIGITS = re.compile(r"\d+")


class Page:
    """A page's elements and, in page order, its blocks of text."""

    __slots__ = ("tags", "paths", "parents", "aside", "blocks", "links")

    def __init__(self, source: str):
        self.tags, self.paths, self.parents, self.aside = ["html"], ["html"], [-1], [False]
        self.blocks: list[tuple[int, str]] = []  # (element, text)
        self.links: list[int] = []  # characters inside links
        self._read(source)

    def _read(self, source: str) -> None:
        stack, names = [0], ["html"]
        text: list[str] = []
        here, in_link, linked = 0, 0, 0

        def flush() -> None:
            nonlocal linked
            words = " ".join("".join(text).split())
            if words:
                self.blocks.append((here, words))
                self.links.append(linked)
            text.clear()
            linked = 0

        def close(name: str) -> None:
            nonlocal in_link
            while True:
                last = names.pop()
                stack.pop()
                in_link -= last == "a"
                if last == name:
                    return

        def add(piece: str) -> None:
            nonlocal here, linked
            if not text:
                here = stack[-1]
            text.append(piece)
            if in_link:
                linked += len(piece)

        at = 0
        for m in TOKEN.finditer(source):
            if m.start() > at:
                piece = source[at : m.start()]
                add(unescape(piece) if "&" in piece else piece)
            at = m.end()
            name = m[3]
            if name is None:
                if m[1] is not None:
                    add(" ")
                continue
            name = name.lower()
            if m[2]:
                if name in BLOCK:
                    flush()
                if name in names and name not in ("html", "body"):
                    close(name)
                continue
            if name in VOID:
                if name == "hr":
                    flush()
                elif name == "br":
                    add(" ")
                continue
            if name in ("html", "body") and name in names:
                continue
            if name in BLOCK:
                flush()
                if "p" in names:
                    close("p")
                if name == "li" and "li" in names and not {"ul", "ol", "menu"} & set(names[len(names) - names[::-1].index("li") :]):
                    close("li")
                elif name in ("td", "th", "tr") and name in names and "table" not in names[len(names) - names[::-1].index(name) :]:
                    close(name)
                elif name in ("dt", "dd"):
                    for other in ("dt", "dd"):
                        if other in names and "dl" not in names[len(names) - names[::-1].index(other) :]:
                            close(other)
            self._open(name, m[4], stack, names)
            in_link += name == "a"
        if at < len(source):
            piece = source[at:]
            add(unescape(piece) if "&" in piece else piece)
        flush()

    def _open(self, name: str, rest: str, stack: list[int], names: list[str]) -> None:
        parent = stack[-1]
        path, off = self.paths[parent], self.aside[parent]
        if name in BLOCK or name in ASIDE:
            found = {}
            if "=" in rest or "hidden" in rest:
                for a in ATTRIBUTE.finditer(rest):
                    found[(a[1] or a[5]).lower()] = a[2] or a[3] or a[4] or ""
            classes = found.get("class", "").lower()
            path += ">" + ".".join([name, *(sorted(DIGITS.sub("#", classes).split()) if name != "body" else [])])
            if name in ("article", "main"):
                # what holds the article is no menu, whatever its class says
                node = parent
                while node > 0 and self.aside[node] and self.tags[node] not in ASIDE:
                    self.aside[node] = False
                    node = self.parents[node]
                off = self.aside[parent]
            if not off and name not in ("body", "main"):
                off = (
                    (name in ASIDE and not (name == "header" and "article" in names))
                    or bool(REMARK.search(classes) if name == "article" else MARKED.search(SAYS.sub("", classes)) or MARKED.search(found.get("id", "").lower()))
                    or found.get("role", "").lower() in ROLES
                    or "hidden" in found
                    or found.get("aria-hidden") == "true"
                    or "display:none" in found.get("style", "").replace(" ", "").lower()
                )
        self.tags.append(name)
        self.paths.append(path)
        self.parents.append(parent)
        self.aside.append(bool(off))
        stack.append(len(self.tags) - 1)
        names.append(name)

    def container(self) -> tuple[int, int]:
        """(element, score): from the whole page down. An article or main
        element inside is gone on to while it holds most of the text outside
        links and side matter, any other container only while nothing but links
        and side matter stays outside it: an article may lie in several."""
        held = [0] * len(self.tags)
        for (node, words), linked in zip(self.blocks, self.links, strict=True):
            if not self.aside[node]:
                held[node] += max(0, len(words) - 2 * linked)
        children: dict[int, list[int]] = {}
        for node in range(len(held) - 1, 0, -1):
            held[self.parents[node]] += held[node]
            if held[node]:
                children.setdefault(self.parents[node], []).append(node)
        best = node = 0
        while children.get(node):
            node = max(children[node], key=held.__getitem__)
            if held[node] < SHARE * held[best]:
                break
            if self.tags[node] in ("article", "main"):
                best = node
                if not any(self.tags[c] in ("article", "main") for c in children.get(node, [])):
                    break
            elif self.tags[node] in CONTAINER and held[node] == held[best]:
                best = node
        return best, held[best]

    def text(self, path: str | None) -> str:
        """Blocks inside the elements at ``path``, or inside the page's own
        best container where it has none there."""
        inside = [p == path and not a for p, a in zip(self.paths, self.aside, strict=True)] if path else []
        if not any(inside):
            inside = [False] * len(self.tags)
            inside[self.container()[0]] = True
        for node in range(1, len(inside)):
            inside[node] = inside[node] or inside[self.parents[node]]
        return "\n".join(words for node, words in self.blocks if inside[node] and not self.aside[node])


def host_of(url: Column) -> Column:
    """Host name in lower case; empty where there is none."""
    return F.lower(F.coalesce(F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1), F.lit("")))


def _votes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        hosts, paths, scores = [], [], []
        for host, source in zip(batch["_host"].to_pylist(), batch["_html"], strict=True):
            page = Page(source.as_py())
            node, score = page.container()
            if score:
                hosts.append(host)
                paths.append(page.paths[node])
                scores.append(score)
        yield pa.RecordBatch.from_arrays([pa.array(hosts, pa.string()), pa.array(paths, pa.string()), pa.array(scores, pa.int64())], ["host", "path", "score"])


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = [Page(h.as_py()).text(p) for h, p in zip(batch["_html"], batch["_path"].to_pylist(), strict=True)]
        columns = [c for c in batch.schema.names if c not in ("_html", "_path")]
        yield pa.RecordBatch.from_arrays([*(batch[c] for c in columns), pa.array(texts, pa.string())], [*columns, "_text"])


def extract(pages: DataFrame, url_col: str = "url", html_col: str = "html", text_col: str = "text") -> DataFrame:
    """``pages`` without the html, with its main text.

    Each page's containers are scored by the text they hold outside links and
    side matter (menus, headers, footers, adverts, notices, forms, comments,
    known by element, class, id or role). The best one votes for its path of
    tags and classes, digits generalised, at the page's host. The path with
    most votes (then most text, then the smallest) wins the host, and every
    page of it is extracted again from the elements at that path; a page with
    nothing there is extracted from its own best container.

    Votes are counted per host and path before the shuffle. Winning paths meet
    pages on host and salt, so a host with a third of the pages lies in many
    tasks. Null html is an empty page and gives an empty text; a null or odd
    URL belongs to the nameless host. Repeated rows are pages of their own; an
    empty table gives no rows; other columns pass through, ``text_col`` is
    replaced (names that begin with an underscore are taken).
    """
    source = pages.withColumn("_host", host_of(F.col(url_col))).withColumn("_html", whole(html_col))
    votes = source.select("_host", "_html").mapInArrow(_votes, "host string, path string, score long")
    counted = votes.groupBy("host", "path").agg(F.count(F.lit(1)).alias("votes"), F.sum("score").alias("score"))
    order = F.struct(-F.col("votes"), -F.col("score"), "path")
    winners = kept(counted.groupBy("host").agg(F.min_by("path", order).alias("_path")), "paths")
    salted = winners.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))).withColumnRenamed("host", "_host")
    carried = [c for c in pages.columns if c not in (html_col, text_col)]
    dealt = source.select(*carried, "_host", "_html", F.pmod(F.xxhash64("_html"), F.lit(SALTS)).cast("int").alias("_salt"))
    joined = dealt.join(salted, ["_host", "_salt"], "left").select(*carried, "_html", "_path")
    schema = pages.select(*carried).withColumn("_text", F.lit("")).schema
    return joined.mapInArrow(_texts, schema).withColumnRenamed("_text", text_col)
