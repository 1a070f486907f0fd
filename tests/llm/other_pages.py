"""Labelled pages of another make than the training pages: whole templates as sites have them.

``data-label`` marks the article (``content``) and what is no part of it inside (``other``).
"""

import random

NOUNS = "river engine market teacher winter garden signal harbour village council bridge theatre".split()
VERBS = "crossed repaired announced measured painted closed discovered carried opened followed".split()
REST = "slowly after the storm|with great care|for the third time|near the old mill|before anyone noticed|in spite of the rain".split("|")


class Site:
    def __init__(self, seed: int) -> None:
        self.r = random.Random(seed)

    def sentence(self) -> str:
        r = self.r
        return f"The {r.choice(NOUNS)} {r.choice(VERBS)} the {r.choice(NOUNS)} {r.choice(REST)}{r.choice('..!?')}"

    def text(self, low: int, high: int) -> str:
        return " ".join(self.sentence() for _ in range(self.r.randint(low, high)))

    def links(self, n: int, cls: str = "") -> str:
        return f"<ul{cls}>" + "".join(f'<li><a href="/{w}"><span>{w.title()}</span></a></li>' for w in self.r.sample(NOUNS, n)) + "</ul>"

    def body(self) -> str:
        out = []
        for k in range(self.r.randint(2, 7)):
            kind = self.r.random()
            if kind < 0.15 and k:
                out.append(f"<h3>{self.r.choice(NOUNS).title()} and {self.r.choice(NOUNS)}</h3>")
            elif kind < 0.22:
                out.append(f"<ol><li>{self.sentence()}</li><li>{self.sentence()}</li></ol>")
            elif kind < 0.28:
                out.append(f"<figure><img src=a.jpg><figcaption>{self.sentence()}</figcaption></figure>")
            elif kind < 0.33:
                out.append(f"<blockquote>{self.text(1, 2)}</blockquote>")
            else:
                out.append(f"<p>{self.text(2, 5)}</p>")
        return "".join(out)

    def blog(self) -> str:
        return (
            f'<html><body class="single"><div id="page"><div id="masthead" class="site-header"><a href="/">The Daily {self.r.choice(NOUNS)}</a></div>'
            f'<div class="menu-main">{self.links(5)}</div><div id="primary"><div class="hentry" data-label="content"><h1 class="entry-title">{self.sentence()}</h1>{self.body()}'
            f'<div class="sharedaddy social" data-label="other">{self.links(3)}</div></div><div id="comments"><h2>3 thoughts</h2><div class="comment-body"><p>{self.text(1, 3)}</p></div></div></div>'
            f'<div id="secondary" class="widget-area">{self.links(4)}</div><div id="colophon">Proudly made in {self.r.choice(NOUNS)}.</div></div></body></html>'
        )

    def news(self) -> str:
        return (
            f'<html><body><div class="cookie-bar"><p>We use cookies. {self.sentence()}</p><button>OK</button></div><header><nav>{self.links(6)}</nav></header>'
            f'<main><article data-label="content"><header><h1>{self.sentence()}</h1><p class="standfirst">{self.sentence()}</p></header>{self.body()}'
            f'<aside class="related-links" data-label="other"><h4>More</h4>{self.links(3)}</aside>{self.body()}</article></main><footer><p>&copy; 2024 {self.r.choice(NOUNS)} media.</p>{self.links(4)}</footer></body></html>'
        )

    def docs(self) -> str:
        return (
            f'<html><body><div class="topbar">{self.links(3)}</div><div class="container"><div class="toc">{self.links(7)}</div>'
            f'<section class="content" data-label="content"><h1>{self.r.choice(NOUNS).title()} guide</h1>{self.body()}<pre>make {self.r.choice(NOUNS)}</pre>'
            f'<table><tr><th>{self.r.choice(NOUNS)}</th><td>{self.sentence()}</td></tr></table>{self.body()}</section></div><footer>{self.links(2)}</footer></body></html>'
        )

    def plain(self) -> str:
        return f"<html><head><title>{self.sentence()}</title></head><body><h4>{self.r.choice(NOUNS)}</h4>{self.links(4)}<div data-label=content><h1>{self.sentence()}</h1>{self.body()}</div><hr><address>{self.r.choice(NOUNS)}@example.org</address></body></html>"


def other_pages(n: int, seed: int) -> list[str]:
    site = Site(seed)
    return [getattr(site, ("blog", "news", "docs", "plain")[k % 4])() for k in range(n)]
