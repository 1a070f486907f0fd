"""Labelled pages to train the main-text model on, made by rule.

A page is a skeleton of parts with invented words.  ``data-label`` tells where the main content
begins (``content``) and where something else begins inside it (``other``); the reader passes it
on as the label and the model never sees it.
"""

from __future__ import annotations

import random

_SYLLABLES = "ba ke li mo nu ra se ti vo za den for mal ner pos rin sta tur wel".split()
_BEFORE = ["header", "nav", "notice", "ad", "hero"]
_AFTER = ["related", "comments", "newsletter", "share", "footer", "sidebar", "ad"]
_WRAPPERS = [
    ("<article>", "</article>"), ("<article>", "</article>"), ("<article>", "</article>"), ("<article>", "</article>"), ('<article class="post">', "</article>"), ("<main>", "</main>"), ('<main role="main"><article>', "</article></main>"),
    ('<div class="content">', "</div>"), ('<div id="main-content">', "</div>"), ('<div class="entry-content">', "</div>"), ('<section class="story">', "</section>"),
    ('<div class="article-body">', "</div>"), ("<div>", "</div>"), ('<div id="post-12" class="post"><div class="body">', "</div></div>"),
]


class _Maker:
    def __init__(self, seed: int) -> None:
        self.random = random.Random(seed)

    def words(self, low: int, high: int) -> str:
        r = self.random
        return " ".join("".join(r.choice(_SYLLABLES) for _ in range(r.randint(1, 4))) for _ in range(r.randint(low, high)))

    def sentences(self, low: int, high: int) -> str:
        return " ".join(self.words(2, 16).capitalize() + self.random.choice([".", ".", ".", "!", "?"]) for _ in range(self.random.randint(low, high)))

    def prose(self, low: int, high: int) -> str:
        """Sentences, some with a link in them."""
        text = self.sentences(low, high)
        return f'{text} <a href="/x">{self.words(1, 2)}</a> {self.words(1, 6)}.' if self.random.random() < 0.2 else text

    def links(self, low: int, high: int) -> str:
        n = self.random.randint(low, high)
        return "<ul>" + "".join(f'<li><a href="/x">{self.words(1, 3)}</a></li>' for _ in range(n)) + "</ul>"

    def part(self, kind: str) -> str:
        r, w, s = self.random, self.words, self.sentences
        name = {
            "header": ["header", "site-header", "masthead", "top-bar"], "nav": ["nav", "menu", "navbar", "breadcrumb"], "notice": ["notice", "cookie-consent", "alert banner", "gdpr"],
            "ad": ["ad", "advert", "ads", "sponsored promo"], "hero": ["banner", "promo"], "related": ["related", "recommended", "more-stories"], "comments": ["comments", "reader-comments", "responses"],
            "newsletter": ["newsletter", "subscribe", "signup", "login"], "share": ["share", "social", "share-buttons"], "footer": ["footer", "site-footer", "copyright"], "sidebar": ["sidebar", "widget", "aside rail"],
        }[kind]
        cls = f' {r.choice(["class", "class", "id"])}="{r.choice(name)}"' if r.random() < 0.8 or kind in ("ad", "notice", "comments", "hero") else ""
        if kind == "header":
            return f"<header{cls}><h1>{w(1, 4)}</h1><p>{w(2, 8)}</p>{self.links(2, 6) if r.random() < 0.5 else ''}</header>"
        if kind == "nav":
            return f"<nav{cls}>{self.links(3, 9)}</nav>" if r.random() < 0.7 else f"<div class=\"{r.choice(name)}\">{self.links(3, 9)}</div>"
        if kind in ("notice", "ad", "hero"):
            tag = r.choice(["div", "div", "aside", "section"])
            inner = s(1, 3) if r.random() < 0.6 else f"<p>{s(1, 3)}</p>"
            return f"<{tag}{cls}>{inner}</{tag}>"
        if kind == "comments":
            one = lambda: f'<{t} class="comment"><p>{s(1, 4)}</p></{t}>'
            t = r.choice(["div", "div", "div", "li", "article"])
            return f"<section{cls}><h3>{w(1, 2)}</h3>{''.join(one() for _ in range(r.randint(1, 5)))}</section>"
        if kind == "newsletter":
            return f"<form{cls}><p>{s(1, 2)}</p><label>{w(1, 3)}</label><input></form>"
        if kind == "share":
            return f"<div{cls}>{self.links(2, 5)}</div>"
        if kind == "related":
            return f"<{'aside' if r.random() < 0.5 else 'div'}{cls}><h3>{w(1, 3)}</h3>{self.links(2, 6)}</{'aside' if r.random() < 0 else 'div'}>"
        if kind == "sidebar":
            return f"<aside{cls}><h4>{w(1, 3)}</h4><p>{s(1, 3)}</p>{self.links(2, 6)}</aside>"
        return f"<footer{cls}>{r.choice(['&copy; ', 'Copyright '])}{w(1, 6)}{r.choice(['', ' <a href=x>' + w(1, 2) + '</a>'])}</footer>"

    def content(self) -> str:
        r, out = self.random, []
        if r.random() < 0.85:
            out.append(f"<h1>{self.words(2, 12)}</h1>")
        for _ in range(r.choice([0, 1, 1, 2, 3, 5, 9, 14])):
            kind = r.random()
            if kind < 0.72:
                out.append(f"<p>{self.prose(1, 8)}</p>")
            elif kind < 0.8:
                out.append(f"<p>{self.words(1, 8)}</p>")
            elif kind < 0.87:
                tag = r.choice(["h2", "h2", "h3", "h3", "h4"])
                out.append(f"<{tag}>{self.words(1, 6)}</{tag}>")
            elif kind < 0.9:
                tag, item = r.choice(["ul", "ol"]), r.choice([lambda: self.words(3, 14), lambda: self.sentences(1, 2)])
                out.append(f"<{tag}>" + "".join(f"<li>{item()}</li>" for _ in range(r.randint(2, 5))) + f"</{tag}>")
            elif kind < 0.915:
                caption = r.choice([lambda: self.words(2, 9), lambda: self.sentences(1, 1)])
                out.append(f"<figure><img src=a><figcaption>{caption()}</figcaption></figure>")
            elif kind < 0.94:
                out.append(f"<blockquote><p>{self.sentences(1, 2)}</p></blockquote>")
            elif kind < 0.96:
                out.append(f"<pre>{self.words(3, 20)}</pre>")
            elif kind < 0.98:
                out.append("<table>" + "".join(f"<tr><td>{self.words(1, 3)}</td><td>{self.words(1, 3)}</td></tr>" for _ in range(3)) + "</table>")
            else:
                out.append(self.part(r.choice(["ad", "share", "newsletter", "related"])).replace(">", ' data-label="other">', 1))
        return "".join(out) or f"<p><b>{self.sentences(1, 1)}<br>"

    def page(self) -> str:
        r = self.random
        before = [self.part(k) for k in _BEFORE if r.random() < 0.5]
        after = [self.part(k) for k in _AFTER if r.random() < 0.4]
        opening, closing = r.choice(_WRAPPERS)
        marked = opening.replace(">", ' data-label="content">', 1)
        if r.random() < 0.3:
            before, after = ["<div>"] + before, after + ["</div>"]
        return "<html><body>" + "".join(before) + marked + self.content() + closing + "".join(after) + "</body></html>"


def labelled_pages(n: int = 600, seed: int = 11) -> list[str]:
    maker = _Maker(seed)
    return [maker.page() for _ in range(n)]
