"""Main text of web pages by a tree-structured graphical model over DOM nodes.

Each block element has a hidden state, inside the main content or not.  A parent's and a child's
state are tied by a potential (one for each kind of parent), a node's state and what the node looks like (tag, words of its class
and id, length of its own text, share of links, how the text ends) by others; all are estimated
from labelled pages with add-one smoothing.  Messages are passed once from the leaves to the root
and once back (sum-product, exact on a tree) and give each node's marginal.  The blocks of nodes
that are more likely inside than not are the main text.

Defined results: a null or empty page, or one without such a block, has an empty text; broken
markup is read as far as it goes; repeated rows get a row each.  Whole pages are read.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .dom import Node, read
from .training_pages import labelled_pages

#: Words of class and id attributes, by what they name.
HINTS = {
    "nav": "nav menu navbar breadcrumb breadcrumbs navigation tabs pagination pager toc",
    "header": "header masthead top topbar site",
    "footer": "footer copyright legal bottom colophon",
    "side": "sidebar aside rail widget widgets",
    "ad": "ad ads advert advertisement sponsored promo promoted banner adsbygoogle",
    "notice": "notice cookie cookies consent gdpr alert popup modal overlay message disclaimer",
    "form": "form newsletter subscribe signup login search register",
    "comment": "comment comments responses reply replies disqus discussion",
    "share": "share social sharing follow buttons",
    "related": "related recommended more recommendations trending popular",
    "content": "content article post entry story main body text prose",
}
_HINT = {w: k for k, words in HINTS.items() for w in words.split()}
_WORD = re.compile(r"[a-z]+")


def hints_of(node: Node) -> set[str]:
    return {_HINT[w] for w in _WORD.findall(node.names) if w in _HINT} if node.names else set()


def features(node: Node) -> list[tuple[str, str]]:
    hints = hints_of(node)
    length = next(k for k, most in (("0", 0), ("s", 25), ("m", 100), ("l", 400), ("x", 1 << 60)) if node.n_text <= most)
    share = node.n_link / node.n_text if node.n_text else 0
    links = next(k for k, most in (("0", 0), ("few", 0.4), ("many", 9e9)) if share <= most)
    end = "none" if not node.last else "stop" if node.last in ".!?…\"'»”:" else "open"
    out = [("tag", node.tag), ("text", f"{length} {end}"), ("links", links)]
    return out + ([("hint", h) for h in sorted(hints)] or [("hint", "-")])


#: Parents that have a potential of their own; all others share one, and so do those whose class or
#: id names something else than content.
PARENTS = frozenset("html div section article main ul".split())


class DomModel:
    def __init__(self, pages: list[str]) -> None:
        counts: list[Counter] = [Counter(), Counter()]
        edges = {k: np.ones((2, 2)) for k in [*sorted(PARENTS), "other", "marked"]}
        values: dict[str, set[str]] = {}
        for page in pages:
            nodes, _ = read(page)
            state: list[int] = []
            for node in nodes:
                above = state[node.parent] if node.parent >= 0 else 0
                here = {"content": 1, "other": 0}.get(node.label, above)
                state.append(here)
                if node.parent >= 0:
                    edges[self.kind(nodes[node.parent])][above, here] += 1
                for f in features(node):
                    counts[here][f] += 1
                    values.setdefault(f[0], set()).add(f[1])
        #: P(child's state | parent's state), and the log ratio of P(feature | inside) to P(feature | outside).
        self.edge = {k: (e / e.sum(1, keepdims=True)).tolist() for k, e in edges.items()}
        total = [Counter({k: sum(n for f, n in c.items() if f[0] == k) for k in values}) for c in counts]
        self.ratio = {}
        for kind, seen in values.items():
            for v in seen:
                p = [(counts[y][kind, v] + 1) / (total[y][kind] + len(seen)) for y in (0, 1)]
                self.ratio[kind, v] = p[1] / p[0]

    @staticmethod
    def kind(parent: Node) -> str:
        if hints_of(parent) - {"content"}:
            return "marked"
        return parent.tag if parent.tag in PARENTS else "other"

    def marginals(self, nodes: list[Node]) -> list[float]:
        """P(inside) of each node by one pass up and one pass down."""
        edges = [self.edge[self.kind(node)] for node in nodes]
        local = []
        for node in nodes:
            r = 1.0
            for f in features(node):
                r *= self.ratio.get(f, 1.0)
            local.append(min(max(r, 1e-12), 1e12))
        # Messages are kept as ratios inside : outside; a product of many is kept in range.
        up = local[:]
        message = [1.0] * len(nodes)
        for i in range(len(nodes) - 1, 0, -1):
            x, p = up[i], nodes[i].parent
            e = edges[p]
            m = (e[1][0] + e[1][1] * x) / (e[0][0] + e[0][1] * x)
            message[i] = m
            up[p] = min(max(up[p] * m, 1e-100), 1e100)
        belief = up[:]
        belief[0] = up[0] * 1e-6  # the root is outside
        for i in range(1, len(nodes)):
            e = edges[nodes[i].parent]
            x = belief[nodes[i].parent] / message[i]  # the parent without this child
            down = (e[0][1] + e[1][1] * x) / (e[0][0] + e[1][0] * x)
            belief[i] = up[i] * down
        return [b / (1 + b) for b in belief]

    def extract(self, page: str | None) -> str:
        if not page:
            return ""
        nodes, blocks = read(page)
        inside = self.marginals(nodes)
        return "\n\n".join(text for node, text in blocks if inside[node] > 0.5)


def extractor(spark, model: DomModel):
    """A column function html -> main text; the model is a table of a few hundred numbers."""
    held = spark.sparkContext.broadcast(model)

    @F.pandas_udf("string")
    def extract(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for pages in batches:
            yield pd.Series([held.value.extract(p) for p in pages], dtype=object)

    return extract


def main_text(pages: DataFrame, *, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", training: list[str] | None = None) -> DataFrame:
    """page_id, url, text, n_chars of every row; ``training`` are pages labelled as in training_pages."""
    extract = extractor(pages.sparkSession, DomModel(training or labelled_pages()))
    rows = pages.select(F.col(f"`{id_col}`").alias("page_id"), F.col(f"`{url_col}`").alias("url"), extract(F.col(f"`{html_col}`").cast("string")).alias("text"))
    return rows.withColumn("n_chars", F.length("text").cast("long"))
