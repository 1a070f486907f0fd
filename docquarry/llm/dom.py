"""A small tolerant HTML reader: block elements as a tree, text in blocks, inline markup dissolved."""

from __future__ import annotations

import html as entities
import re
from bisect import bisect
from collections import Counter, defaultdict

_COMMENT = re.compile(r"<!--(?:>|->|.*?(?:--!?>|\Z))", re.S)
_TAG_NAME = re.compile(r"<(/?)([A-Za-z])")
_NAME_END = re.compile(r"[\s/>]")
#: What matters in a tag: its end, or the quote that begins a value.
_SPECIAL = re.compile(r">|=\s*[\"']")
#: A name, and its value if it has one.
_ATTRIBUTE = re.compile(r"([^\s=>/]++)(\s*+=\s*+(?:\"([^\"]*)\"|'([^']*)'|([^\s>]*)))?")
_SPACE = re.compile(r"\s+")
BLOCK = frozenset(
    "html body main article section div p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd table thead tbody tfoot tr td th caption"
    " pre blockquote figure figcaption nav aside header footer form fieldset address details summary center menu dialog hr".split()
)
DROPPED = frozenset("script style noscript template iframe svg annotation object canvas audio video head title textarea select button option datalist".split())
#: These end at the latest where a block begins or ends, as in a browser; the others at their end tag.
_BROKEN_OUT = frozenset("head svg annotation select option datalist".split())
RAW = frozenset("script style textarea title iframe noscript".split())
VOID = frozenset("br hr img input meta link area base col embed param source track wbr".split())
#: An element that opens ends these, up to the nearest of the elements that hold them.
_CLOSES = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"})}


class Node:
    __slots__ = ("tag", "parent", "names", "label", "n_text", "n_link", "last")

    def __init__(self, tag: str, parent: int, names: str, label: str) -> None:
        self.tag, self.parent, self.names, self.label = tag, parent, names, label
        self.n_text = self.n_link = 0
        self.last = ""


class Next:
    """Where the next match of a pattern begins, for places that are asked in rising order or close to it."""

    def __init__(self, page: str, pattern: re.Pattern[str]) -> None:
        self.page, self.pattern, self.since, self.match = page, pattern, len(page) + 1, None

    def __call__(self, at: int) -> re.Match[str] | None:
        if not (self.since <= at and (self.match is None or at <= self.match.start())):
            self.since, self.match = at, self.pattern.search(self.page, at)
        return self.match


class Tags:
    """Comments, declarations and tags of a page, in time that grows with its length alone.

    A quote counts in a tag only where a value begins, right after ``=``; one that nothing closes is an ordinary
    character.  A ``<`` whose tag no ``>`` ends is text: the places from which an end was sought in vain are kept,
    so no stretch of the page is searched again for each ``<``.
    """

    def __init__(self, page: str) -> None:
        self.page, self.last_end = page, page.rfind(">")
        self.last_quote = {q: page.rfind(q) for q in "\"'"}
        self.special, self.name_end, self.dead = Next(page, _SPECIAL), Next(page, _NAME_END), set()

    def after(self, at: int) -> tuple[int, int, bool, str, str] | None:
        """(from, to, whether it is an end tag, name, attributes) of the next one; no name for comments and declarations."""
        page, start = self.page, self.page.find("<", at)
        while start >= 0:
            tag = _TAG_NAME.match(page, start)
            if page.startswith("<!--", start):
                return start, _COMMENT.match(page, start).end(), False, "", ""
            if start > self.last_end:
                start = page.find("<!--", start)  # nothing else can end
                continue
            if tag:
                name_end = self.name_end(tag.start(2)).start()
                end = self.end_of(name_end)
                if end >= 0:
                    return start, end + 1, bool(tag[1]), page[tag.start(2) : name_end].lower(), page[name_end:end]
            elif page[start + 1 : start + 2] in ("!", "?", "/"):
                return start, page.find(">", start) + 1, False, "", ""
            start = page.find("<", start + 1)
        return None

    def end_of(self, at: int) -> int:
        """Where the ``>`` of the tag stands whose name ends at ``at``; -1 if nowhere."""
        page, seen = self.page, []
        while (m := self.special(at)) and m.start() not in self.dead:
            if m[0] == ">":
                return m.start()
            seen.append(m.start())
            at = page.find(m[0][-1], m.end()) + 1 if m.end() <= self.last_quote[m[0][-1]] else m.end()
        self.dead.update(seen)
        return -1


def read(page: str) -> tuple[list[Node], list[tuple[int, str]]]:
    """(nodes, parents before children; blocks as (node, text) in page order)."""
    nodes = [Node("html", -1, "", "")]
    blocks: list[tuple[int, str]] = []
    stack = [0]
    depths: defaultdict[str, list[int]] = defaultdict(list)  # of the open elements of a tag
    pieces: list[str] = []
    links = 0
    dropped: list[str] = []
    n_dropped: Counter[str] = Counter()

    def close_block() -> None:
        if pieces:
            text = _SPACE.sub(" ", entities.unescape("".join(pieces))).strip()
            pieces.clear()
            if text:
                node = nodes[stack[-1]]
                node.n_text += len(text)
                node.last = text[-1]
                blocks.append((stack[-1], text))

    def say(text: str) -> None:
        if text and not dropped:
            pieces.append(text)
            if links:
                nodes[stack[-1]].n_link += len(text)

    def close_to(depth: int) -> None:
        """All elements of the stack from ``depth`` on end."""
        for i in stack[depth:]:
            depths[nodes[i].tag].pop()
        del stack[depth:]

    def restore() -> None:
        n_dropped[dropped.pop()] -= 1

    end_tags: dict[str, Next] = {}

    def end_tag(tag: str, at: int) -> re.Match[str] | None:
        """The next end tag's beginning; an element without one is not there to be dropped."""
        if tag not in end_tags:
            end_tags[tag] = Next(page, re.compile(rf"</{tag}\b", re.I))
        return end_tags[tag](at)

    tags = Tags(page)
    at, n = 0, len(page)
    while at < n:
        m = tags.after(at)
        if not m:
            say(page[at:])
            break
        say(page[at : m[0]])
        _, at, closing, tag, rest = m
        if not tag:
            continue
        if dropped and tag in BLOCK and dropped[-1] in _BROKEN_OUT and not (closing and n_dropped[tag]):
            while dropped and dropped[-1] in _BROKEN_OUT:
                restore()
        if closing:
            if dropped:
                if dropped[-1] == tag:
                    restore()
                else:
                    while n_dropped[tag]:
                        restore()
            elif tag == "a":
                links = max(0, links - 1)
            elif tag in BLOCK and depths[tag]:
                close_block()
                close_to(depths[tag][-1])
                links = 0
            continue
        if tag in RAW:
            end = end_tag(tag, at)
            stop = page.find(">", end.end()) + 1 if end and end.end() <= tags.last_end else 0
            at = stop or (n if tag in ("script", "style") else at)
        elif tag == "br":
            say("\n")
        elif tag in DROPPED:
            if not (rest.endswith("/") and tag == "svg") and (tag in _BROKEN_OUT or end_tag(tag, at)):
                dropped.append(tag)
                n_dropped[tag] += 1
        elif tag == "body":
            dropped.clear()
            n_dropped.clear()
        elif dropped or tag == "html":
            continue
        elif tag == "a":
            links += 1
        elif tag in BLOCK:
            close_block()
            if tag not in ("hr",):
                if tag in _CLOSES:
                    ends, holders = _CLOSES[tag]
                    holder = max((depths[t][-1] for t in holders if depths[t]), default=0)
                    inside = [d for t in ends for d in depths[t][bisect(depths[t], holder) :][: 1 if len(ends) > 1 else None]]
                    if inside:
                        close_to(min(inside) if len(ends) > 1 else max(inside))
                if nodes[stack[-1]].tag == "p":
                    close_to(len(stack) - 1)
                attributes = {k.lower(): a or b or c for k, valued, a, b, c in _ATTRIBUTE.findall(rest) if valued} if rest else {}
                names = " ".join(attributes.get(k, "") for k in ("class", "id", "role", "itemprop")).strip()
                nodes.append(Node(tag, stack[-1], names.lower(), attributes.get("data-label", "")))
                stack.append(len(nodes) - 1)
                depths[tag].append(len(stack) - 1)
                links = 0
    close_block()
    return nodes, blocks
