"""HTML pages as text: a cascade of extractors and a converter to Markdown."""

from __future__ import annotations

from html.parser import HTMLParser

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docquarry.functions.parts import of_text
from docquarry.shared_files import fresh_name, stored

MIN_LENGTH = 100
MAX_BYTES = 10 * 1024 * 1024
MIN_BLOCK = 25
#: Parts of class names and identifiers of elements that hold, or do not hold, the main content, and what they count.
GOOD_NAMES, BAD_NAMES, WEIGHT = ("article", "content", "post", "story", "entry"), ("comment", "sidebar", "footer", "menu", "promo", "related", "advert", "banner"), 25
_NOISE = "script style nav footer header aside".split()


def raw_text(html: Column) -> Column:
    """Text outside of noise elements, pieces joined by blank lines; by regular expressions alone."""
    text = F.coalesce(html, F.lit(""))
    for tag in _NOISE:
        text = F.regexp_replace(text, rf"(?is)<{tag}\b[^>]*>.*?</{tag}\s*>", "")
    text = F.regexp_replace(text, r"(?s)<!--.*?-->", "")
    text = F.regexp_replace(text, r"(?s)<[^>]*>", "\n\n")
    return F.regexp_replace(F.regexp_replace(text, r"\s*\n\s*\n\s*", "\n\n"), r"^\s+|\s+$", "")


class _Markdown(HTMLParser):
    """Headings, paragraphs, lists, quotes, code and tables; text outside of them is left out."""

    LEAVES = frozenset("p li blockquote dt dd h1 h2 h3 h4 h5 h6 pre".split())

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.lines: list[str] = []
        self.leaf: str | None = None
        self.parts: list[str] = []
        self.skip = 0
        self.lists: list[list] = []
        self.rows: list[list[str]] | None = None

    def handle_starttag(self, tag: str, attrs) -> None:
        if tag in ("script", "style", "head"):
            self.skip += 1
        elif tag == "table":
            self.flush()
            self.rows = []
        elif self.rows is not None:
            if tag == "tr":
                self.rows.append([])
            elif tag in ("td", "th"):
                self.rows = self.rows or [[]]
                self.rows[-1].append("")
        elif tag in ("ol", "ul"):
            self.flush()
            self.lists.append([tag, 0])
        elif tag in self.LEAVES:
            self.flush()
            self.leaf = tag
            if tag == "li" and self.lists:
                self.lists[-1][1] += 1
        elif tag == "br" and self.leaf:
            self.parts.append("\n" if self.leaf == "pre" else " ")

    def handle_endtag(self, tag: str) -> None:
        if tag in ("script", "style", "head"):
            self.skip = max(0, self.skip - 1)
        elif tag == "table" and self.rows is not None:
            rows = [r for r in self.rows if r]
            if rows:
                bar = lambda cells: "| " + " | ".join(" ".join(c.split()) for c in cells) + " |"
                self.lines += [bar(rows[0]), bar(["---"] * len(rows[0])), *map(bar, rows[1:]), ""]
            self.rows = None
        elif tag in ("ol", "ul"):
            self.flush()
            if self.lists:
                self.lists.pop()
        elif tag == self.leaf:
            self.flush()

    def handle_data(self, data: str) -> None:
        if self.skip:
            return
        if self.rows is not None:
            if self.rows and self.rows[-1]:
                self.rows[-1][-1] += data
        elif self.leaf:
            self.parts.append(data)

    def flush(self) -> None:
        tag, text = self.leaf, "".join(self.parts)
        self.leaf, self.parts = None, []
        if not tag or not text.strip():
            return
        if tag == "pre":
            self.lines += ["```", text.rstrip(), "```", ""]
            return
        prefix = "#" * int(tag[1]) + " " if tag[0] == "h" else "> " if tag == "blockquote" else ""
        if tag == "li":
            prefix = f"{self.lists[-1][1]}. " if self.lists and self.lists[-1][0] == "ol" else "- "
        self.lines += [prefix + " ".join(text.split()), ""]


def markdown_of(page: str | None) -> str:
    reader = _Markdown()
    reader.feed(page or "")
    reader.close()
    reader.flush()
    return "\n".join(reader.lines).strip()


def html_to_markdown(page: Column) -> Column:
    """Markdown of a page, in Arrow batches."""
    return of_text(markdown_of, "string")(page)


class _Blocks(HTMLParser):
    """Blocks of text with the two elements around them; elements are numbered in page order."""

    HEADS = frozenset(f"h{i}" for i in range(1, 7))
    SKIPPED = frozenset([*_NOISE, "form", "noscript", "template", "head"])
    INLINE = frozenset("a abbr b bdi bdo cite code data dfn em font i kbd mark q s samp small span strong sub sup time tt u var label".split())
    VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
    LEAVES = HEADS | frozenset("p li blockquote dt dd pre td th".split())

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.open: list[tuple[str, int]] = [("", 0)]
        self.n_open: dict[str, int] = {}
        self.last, self.weight = [0], [0]
        self.blocks: list[dict] = []
        self.parts: list[str] = []
        self.n_links = 0

    def handle_starttag(self, tag: str, attrs) -> None:
        if tag in self.VOID:
            if tag == "br":
                self.parts.append(" ")
            return
        if tag not in self.INLINE:
            self.flush()
            if self.open[-1][0] == "p" or (tag == "li" == self.open[-1][0]):
                self.close_to(self.open[-1][0])
        names = " ".join(v or "" for k, v in attrs if k in ("class", "id")).lower()
        good = tag in ("article", "main") or any(w in names for w in GOOD_NAMES)
        self.open.append((tag, len(self.last)))
        self.n_open[tag] = self.n_open.get(tag, 0) + 1
        self.last.append(len(self.last))
        self.weight.append(WEIGHT * (good - any(w in names for w in BAD_NAMES)))

    def handle_endtag(self, tag: str) -> None:
        if tag not in self.INLINE:
            self.flush()
        if self.n_open.get(tag):
            self.close_to(tag)

    def close_to(self, tag: str) -> None:
        while True:
            name, at = self.open.pop()
            self.n_open[name] -= 1
            self.last[at] = len(self.last) - 1
            if name == tag:
                return

    def handle_data(self, data: str) -> None:
        if not any(self.n_open.get(t) for t in self.SKIPPED):
            self.parts.append(data)
            self.n_links += len("".join(data.split())) if self.n_open.get("a") else 0

    def flush(self) -> None:
        text, links = " ".join("".join(self.parts).split()), self.n_links
        self.parts, self.n_links = [], 0
        if not text:
            return
        around = [(tag, at) for tag, at in self.open[-8:] if tag not in self.INLINE]
        leaf = around[-1][0] if around and around[-1][0] in self.LEAVES else ""
        parents = [at for tag, at in around if tag not in self.LEAVES] or [0]
        head = "#" * int(leaf[1]) + " " if leaf in self.HEADS else "- " if leaf == "li" else "> " if leaf == "blockquote" else ""
        solid = len("".join(text.split()))
        self.blocks.append({"text": head + text, "n_chars": solid, "n_links": links, "commas": text.count(","), "parent": parents[-1], "grand": parents[-2] if len(parents) > 1 else None})

    def done(self) -> list[dict]:
        self.flush()
        while len(self.open) > 1:
            self.close_to(self.open[-1][0])
        self.last[0] = len(self.last) - 1
        for block in self.blocks:
            for side in ("parent", "grand"):
                at = block[side]
                block[side] = None if at is None else {"at": at, "last": self.last[at], "weight": self.weight[at]}
        return self.blocks


_NODE = "struct<at:int,last:int,weight:int>"
BLOCKS = f"array<struct<text:string,n_chars:int,n_links:int,commas:int,parent:{_NODE},grand:{_NODE}>>"


def blocks_of(page: str | None) -> list[dict]:
    reader = _Blocks()
    reader.feed(page or "")
    reader.close()
    return reader.done()


def read_blocks():
    """A column function page -> its blocks."""
    return of_text(blocks_of, BLOCKS)


def with_main_content(pages: DataFrame, html_col: str = "html", name: str = "main") -> DataFrame:
    """``pages`` with the text of the element that holds the main content, as blocks; null if it has under 100 characters.

    Each block of 25 characters or more scores for its length and commas, in full for the element around it and by half
    for the next; an element's score is lessened by its share of links.  Scores are added up in Spark by page and
    element, so a page's rows are numbers; the text stays where it was written.  Null and empty pages give null; of elements
    with equal scores the first counts; columns of the same name are replaced.
    """
    row, blocks = fresh_name("row", pages), fresh_name("blocks", pages)
    numbered = pages.withColumns({row: F.monotonically_increasing_id(), blocks: read_blocks()(F.col(f"`{html_col}`"))})
    parsed = stored(numbered, "html-blocks")  # read twice: the numbers below, the text at the end
    counted = parsed.select(F.col(row).alias("row"), F.explode(blocks).alias("b")).select("row", "b.n_chars", "b.n_links", "b.commas", "b.parent", "b.grand")
    score = F.when(F.col("n_chars") >= MIN_BLOCK, 1 + F.col("commas") + F.least(F.col("n_chars") / 100, F.lit(3.0))).otherwise(0.0)
    sides = F.array(F.struct(F.col("parent").alias("node"), score.alias("score")), F.struct(F.col("grand").alias("node"), (score / 2).alias("score")))
    each = counted.select("row", "n_chars", "n_links", F.inline(sides)).filter("node IS NOT NULL")
    nodes = each.groupBy("row", "node").agg(F.round(F.sum("score"), 9).alias("score"), F.sum("n_chars").alias("chars"), F.sum("n_links").alias("links"))
    total = (F.col("score") + F.col("node.weight")) * (1 - F.least(F.col("links") / F.greatest("chars", F.lit(1)), F.lit(1.0)))
    best = nodes.filter("score > 0").groupBy("row").agg(F.max_by("node", F.struct(total, -F.col("node.at"))).alias("best"))
    best = best.select(F.col("row").alias(f"{row}_of"), F.col("best.at").alias(f"{row}_at"), F.col("best.last").alias(f"{row}_last"))
    inside = F.filter(blocks, lambda b: b["parent"]["at"].between(F.col(f"{row}_at"), F.col(f"{row}_last")))
    text = F.array_join(F.transform(inside, lambda b: b["text"]), "\n\n")
    joined = parsed.join(best, F.col(row) == F.col(f"{row}_of"), "left")
    kept = [F.col(f"`{c}`") for c in pages.columns if c.lower() != name.lower()]
    return joined.select(*kept, F.when(F.length(text) >= MIN_LENGTH, text).alias(name))


def html_text(html: Column, ocr: Column | None = None, main: Column | None = None, *, source: Column | None = None) -> Column:
    """The first tier that gives enough: OCR text, main content (``with_main_content``), Markdown, text outside noise; else null.

    With ``source``, a page without text is an error that names it.
    """
    enough = lambda c: F.when(F.length(c) > MIN_LENGTH, c)
    tiers = [enough(html_to_markdown(html)), enough(raw_text(html))]
    tiers = [F.nullif(c, F.lit("")) for c in (ocr,) if c is not None] + [enough(c) for c in (main,) if c is not None] + tiers
    if source is not None:
        tiers.append(F.raise_error(F.concat(F.lit("no text in the HTML page "), F.coalesce(source, F.lit("?")))).cast("string"))
    return F.coalesce(*tiers)


def looks_like_html(content: Column) -> Column:
    """By the first 8 KiB: a tag that pages begin with, and no PDF or ZIP signature."""
    head = F.lower(F.decode(F.substring(content, 1, 8192), "UTF-8"))
    return head.rlike(r"<(!doctype|html|head|body|div|p|h1|table)\b") & ~head.rlike(r"^(%pdf|pk)")


def read_html(spark, path: str) -> DataFrame:
    """source, html of files that look like HTML and are not too large; a byte order mark is dropped."""
    files = spark.read.format("binaryFile").load(path).filter(F.col("length") <= MAX_BYTES)
    text = F.regexp_replace(F.decode("content", "UTF-8"), "^﻿", "")
    return files.filter(looks_like_html(F.col("content"))).select(F.col("path").alias("source"), text.alias("html"))
