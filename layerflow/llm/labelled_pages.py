"""Labelled pages to learn main text from: layouts as sites use them, with invented prose.

The pages are drawn from the vocabulary below by a seeded generator. Each block of main text
begins with the mark, which is taken off before learning.
"""

from __future__ import annotations

import random
from collections.abc import Iterator

MARK = ""
PAGES = 800
SEED = 20240501

#: Names that sites give to the parts of a page.
NAMES = {
    "header": "header site-header masthead page-header top topbar branding logo",
    "menu": "nav menu navbar navigation main-nav breadcrumb breadcrumbs submenu tabs site-nav toolbar",
    "notice": "cookie cookie-banner cookie-notice consent gdpr notice alert popup modal overlay privacy-notice paywall announcement",
    "advert": "ad ads advert advertisement ad-slot sponsored sponsor promo promotion banner banner-ad adsbygoogle partner",
    "side": "sidebar side widget rail right-column secondary related recommended more-stories read-next popular trending",
    "share": "share social sharing share-buttons social-links follow tags tag-list pagination pager",
    "form": "newsletter subscribe signup search-form login contact-form search",
    "comments": "comments comment-list commentlist responses discussion replies disqus",
    "comment": "comment reply comment-body comment-content response",
    "footer": "footer site-footer foot bottom copyright legal colophon credits",
    "main": "content post entry article article-body post-content entry-content story main-content body-text text page-content",
}
KINDS = ["header", "menu", "notice", "advert", "side", "share", "form"]


class Page:
    def __init__(self, rng: random.Random):
        self.rng = rng

    def words(self, low: int, high: int) -> str:
        one = lambda: "".join(self.rng.choice("abcdefghilmnoprstu") for _ in range(self.rng.randint(2, 8)))
        return " ".join(one() for _ in range(self.rng.randint(low, high)))

    def prose(self, low: int = 1, high: int = 6) -> str:
        out = []
        for _ in range(self.rng.randint(low, high)):
            parts = [self.words(1, 9) for _ in range(self.rng.randint(1, 3))]
            out.append(", ".join(parts).capitalize() + self.rng.choice("....?!"))
        return " ".join(out)

    def rough(self) -> str:
        """Text as it is found, without sentences: repeated words, signs, capitals, bars."""
        words = [self.words(1, 1) for _ in range(self.rng.randint(1, 40))]
        style = self.rng.randint(0, 3)
        if style == 0:
            return " ".join(w for w in words for _ in range(self.rng.randint(1, 9)))
        if style == 1:
            return " ".join(w + self.rng.choice(["%%%", "###", "&amp;&amp;&amp;", "***", "$$$"]) for w in words)
        return "!! ".join(words).upper() if style == 2 else " | ".join(words)

    def name(self, kind: str) -> str:
        return self.rng.choice(NAMES[kind].split())

    def inside(self, kind: str, body: str, tags: str) -> str:
        """``body`` in an element whose tag or name tells its kind."""
        tag = self.rng.choice(tags.split())
        known = tag not in ("div", "section", "span", "ul", "p", "ol")
        named = "" if known and self.rng.random() < 0.5 else f' {self.rng.choice(["class", "class", "id"])}="{self.name(kind)}"'
        return f"<{tag}{named}>{body}</{tag}>"

    def links(self) -> str:
        one = [f'<a href="/{i}">{self.words(1, 3)}</a>' for i in range(self.rng.randint(2, 7))]
        style = self.rng.random()
        return f"<ul>{''.join(f'<li>{x}</li>' for x in one)}</ul>" if style < 0.7 else " | ".join(one)

    def part(self, kind: str) -> str:
        prose = self.rng.choice([self.prose, self.prose, lambda: self.words(1, 12)])
        if kind == "menu":
            return self.inside(kind, self.links(), "nav nav div ul")
        if kind == "header":
            body = f"<a href='/'>{self.words(1, 3)}</a>" + self.rng.choice(["", f"<p>{self.words(2, 8)}</p>", self.links(), f"<h1>{self.words(1, 3)}</h1>"])
            return self.inside(kind, body, "header header div")
        if kind == "footer":
            body = self.rng.choice([f"&copy; {self.words(1, 4)}", f"<p>&copy; 2020 {self.words(2, 6)}</p>{self.links()}", f"{self.links()}<p>{self.prose(1, 2)}</p>"])
            return self.inside(kind, body, "footer footer div")
        if kind == "form":
            body = f"<label>{self.words(1, 3)}</label><input type='text'><button>{self.words(1, 2)}</button>"
            return self.inside(kind, f"<p>{prose()}</p>" * self.rng.randint(0, 1) + body, "form form div")
        if kind == "side":
            body = f"<h3>{self.words(1, 4)}</h3>" + self.rng.choice([self.links(), f"<p>{prose()}</p>", f"<p>{prose()}</p><p>{prose()}</p>"])
            return self.inside(kind, body, "aside aside div section")
        if kind == "share":
            return self.inside(kind, self.links(), "div ul p")
        if kind == "comments":
            one = lambda: self.inside("comment", f"<b>{self.words(1, 2)}</b>" + "".join(f"<p>{self.prose()}</p>" for _ in range(self.rng.randint(1, 3))), "div li div div div li div div div li article")
            body = f"<h3>{self.words(1, 3)}</h3>" * self.rng.randint(0, 1) + "".join(one() for _ in range(self.rng.randint(1, 4)))
            return self.inside(kind, body, "section div ol")
        body = self.rng.choice([prose(), f"<p>{prose()}</p>", f"<p>{prose()}</p><a href='#'>{self.words(1, 2)}</a>"])
        return self.inside(kind, body, "div div section aside" if kind == "advert" else "div div section p" if "<p" not in body else "div")

    def paragraph(self) -> str:
        r, m = self.rng.random(), MARK
        if r < 0.45:
            return f"<p>{m}{self.prose(1, 8)}</p>"
        if r < 0.55:
            return f"<p>{m}{self.rough()}</p>"
        if r < 0.63:
            return f"<p>{m}{self.words(1, 3).capitalize()}.</p>"
        if r < 0.68:
            return f"<p>{m}<b>{self.prose(1, 3)}<br>"
        if r < 0.74:
            return f"<p>{m}{self.words(2, 6)} <a href='/x'>{self.words(1, 4)}</a>, {self.prose(1, 3)}</p>"
        if r < 0.80:
            return f"<h2>{m}{self.words(1, 7)}</h2>"
        if r < 0.86:
            return "<ul>" + "".join(f"<li>{m}{self.words(1, 12)}</li>" for _ in range(self.rng.randint(2, 5))) + "</ul>"
        if r < 0.90:
            return f"<blockquote>{m}{self.prose(1, 4)}</blockquote>"
        if r < 0.93:
            return f"<pre>{m}{self.words(3, 20)}</pre>"
        if r < 0.96:
            return f"<table><tr><td>{m}{self.words(1, 4)}<td>{m}{self.words(1, 4)}</table>"
        return f"<figure><img src='x'><figcaption>{m}{self.words(3, 12)}</figcaption></figure>"

    def main(self) -> str:
        title = f"<h1>{MARK}{self.words(1, 9)}</h1>"
        if self.rng.random() < 0.15:
            title = f"<header>{title}</header>"
        body = title * (self.rng.random() < 0.85)
        for _ in range(self.rng.randint(1, 9)):
            body += self.paragraph()
            if self.rng.random() < 0.08:
                body += self.part(self.rng.choice(["advert", "share", "form", "side", "notice"]))
        if self.rng.random() < 0.15:
            body += self.part(self.rng.choice(["comments", "share", "footer"]))
        r = self.rng.random()
        if r < 0.40:
            return f"<article{self.rng.choice(['', f' class={self.name("main")}'])}>{body}</article>"
        if r < 0.60:
            return f"<main>{body}</main>"
        if r < 0.70:
            return f"<main><article>{body}</article></main>"
        if r < 0.95:
            return f'<div {self.rng.choice(["class", "id"])}="{self.name("main")}">{body}</div>'
        return body

    def page(self) -> str:
        odd = self.rng.random() < 0.2
        before = [self.part(self.rng.choice(KINDS)) for _ in range(self.rng.randint(0, 4))]
        after = [self.part(self.rng.choice(["side", "advert", "share", "form", "comments", "comments", "notice"])) for _ in range(self.rng.randint(0, 3))]
        after += [self.part("footer")] * (self.rng.random() < 0.8)
        body = "".join([*before, self.main(), *after])
        if odd:  # a page cut off, or with a comment and scripts between
            body = f"<!-- {self.words(1, 3)} --><script>var x = '</p>';</script>" + body
        if self.rng.random() < 0.3:
            body = f'<div class="{self.rng.choice(["wrapper", "container", "page", "row"])}">{body}</div>'
        return f"<!DOCTYPE html><html><head><title>{self.words(2, 6)}</title></head><body>{body}</body></html>"


def labelled_pages(pages: int = PAGES, seed: int = SEED) -> Iterator[str]:
    rng = random.Random(seed)
    for _ in range(pages):
        yield Page(rng).page()
