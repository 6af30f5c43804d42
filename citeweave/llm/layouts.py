"""Labelled web pages of many layouts, made by rule: (html, main text). The extraction model learns from them."""

from __future__ import annotations

import html as entities
import random
from collections.abc import Iterator

#: Names under which pages keep what isn't their article.
MENU = ["nav", "menu", "navigation", "navbar", "main-menu", "breadcrumbs", "breadcrumb", "pagination", "tabs", "skip-links", "toc-nav", "topnav", "languages"]
HEAD = ["header", "site-header", "masthead", "page-header", "topbar", "branding", "logo", "tagline", "headerbar"]
FOOT = ["footer", "site-footer", "page-footer", "copyright", "colophon", "legal", "imprint", "footerlinks", "bottom"]
SIDE = ["sidebar", "side", "widget", "related", "related-posts", "recommended", "popular", "trending", "more-stories", "tags", "archive", "aside", "rail", "side-bar", "author-box"]
NOTICE = ["notice", "cookie-notice", "cookie", "cookies", "consent", "gdpr", "alert", "popup", "modal", "overlay", "paywall", "banner", "announcement", "cookie-banner", "privacy-notice", "disclaimer", "warning", "message", "site-notice", "subscribe-box"]
ADVERT = ["ad", "ads", "advert", "advertisement", "sponsored", "sponsor", "promo", "promotion", "ad-top", "adsbygoogle", "ad-slot", "banner-ad", "partner", "commercial", "affiliate", "ad_box"]
FORM = ["form", "search", "search-form", "newsletter", "signup", "login", "contact-form", "subscribe", "comment-form", "poll", "survey"]
COMMENT = ["comments", "comment", "comment-list", "commentlist", "comment-body", "reader-comments", "replies", "reply", "discussion", "responses", "respond", "disqus_thread", "user-comments", "feedback"]
SHARE = ["share", "social", "social-links", "share-buttons", "sharing", "follow-us", "print-links"]
#: Names under which pages keep their article.
ARTICLE = ["article", "content", "post", "entry", "entry-content", "article-body", "story", "post-content", "main-content", "body-text", "text", "page-content", "single", "articleBody", "post-body", "blog-post", "hentry", "story-text", "prose"]
NEUTRAL = ["container", "wrapper", "wrap", "row", "col", "inner", "page", "box", "block", "grid", "layout", "section", "outer", "clearfix", "main"]
LETTERS = ["e", "n", "a", "t", "i", "o", "r", "s", "l", "d", "u", "c", "m", "h", "é", "ü", "ñ", "p", "g", "b", "и", "о", "ا", "ن", "的", "w", "k", "z"]


class _Page:
    def __init__(self, seed: int):
        self.r = random.Random(seed)
        self.lines: list[str] = []
        self.upper = self.r.random() < 0.05

    def word(self) -> str:
        return "".join(self.r.choices(LETTERS, range(len(LETTERS), 0, -1), k=self.r.choice([1, 2, 2, 3, 4, 5, 6, 7, 9, 12])))

    def words(self, n: int) -> str:
        return " ".join(self.word() for _ in range(n))

    def sentence(self) -> str:
        s = self.words(self.r.choice([1, 2, 4, 7, 10, 14, 20]))
        if self.r.random() < 0.4:
            s = s.replace(" ", ", ", 1)
        return (s[:1].upper() + s[1:]) + self.r.choice([".", ".", ".", ".", "!", "?", ""])

    def prose(self, most: int) -> str:
        glue = " | " if self.r.random() < 0.06 else " "
        return glue.join(self.sentence() for _ in range(self.r.randint(1, most)))

    def tag(self, name: str, inner: str, names: list[str] | None = None) -> str:
        r = self.r
        found = ""
        if names:
            picked = r.choice(names)
            found = f' class="{r.choice(["", "c1 ", "col-md-8 ", "js-x "])}{picked}"' if r.random() < 0.6 else f' id="{picked}"'
        return f"<{name}{found}>{inner}</{name}>" if not self.upper else f"<{name.upper()}{found}>{inner}</{name.upper()}>"

    def link(self, n: int = 3) -> str:
        return f'<a href="/{self.word()}">{self.words(self.r.randint(1, n))}</a>'

    def links(self) -> str:
        items = [self.link() for _ in range(self.r.randint(1, 9))]
        kind = self.r.random()
        if kind < 0.6:
            return "<ul>" + "".join(f"<li>{x}</li>" for x in items) + "</ul>"
        return self.r.choice([" ", " | ", " &middot; "]).join(items) if kind < 0.85 else "".join(f"<p>{x}</p>" for x in items)

    def named(self, tag: str, names: list[str], inner: str) -> str:
        """A part by its own tag, by a name, or by both."""
        r = self.r.random()
        return self.tag(tag, inner) if r < 0.35 and tag != "div" else self.tag(self.r.choice(["div", "div", "div", "section"]), inner, names) if r < 0.8 else self.tag(tag, inner, names)

    # --- parts that aren't the article ---

    def menu(self) -> str:
        return self.named("nav", MENU, self.links())

    def head(self) -> str:
        inner = self.r.choice([f"<h1>{self.words(2)}</h1>", f"<div>{self.link()}</div>", f"<p>{self.sentence()}</p>", f"<span>{self.words(3)}</span>", f"<h2>{self.words(4)}</h2><p>{self.prose(2)}</p>"])
        return self.named("header", HEAD, inner + (self.links() if self.r.random() < 0.4 else ""))

    def foot(self) -> str:
        parts = [f"&copy; {self.word()}.example &middot; {self.prose(3)}", f"<p>&copy; {self.r.randint(1990, 2030)} {self.words(3)}</p>", self.links(), f"<p>{self.prose(3)}</p>", f"<div>{self.sentence()} {self.link()}</div>"]
        return self.named("footer", FOOT, "".join(self.r.sample(parts, self.r.randint(1, 3))))

    def side(self) -> str:
        inner = self.r.choice([f"<h3>{self.words(2)}</h3>{self.links()}", f"<h2>{self.words(3)}</h2><p>{self.prose(3)}</p>", f"<p>{self.prose(4)}</p>", f"<div>{self.words(2)}</div><p>{self.prose(2)} {self.link()}</p>", self.links()])
        return self.named("aside", SIDE, inner)

    def notice(self) -> str:
        inner = self.r.choice([self.prose(3), f"<p>{self.prose(3)}</p><button>{self.word()}</button>", f"<p>{self.prose(2)} {self.link()}</p>", f"<strong>{self.words(2)}</strong> {self.prose(2)}"])
        return self.tag(self.r.choice(["div", "div", "section", "aside", "p"]) if not inner.startswith("<p") else "div", inner, NOTICE) if self.r.random() < 0.85 else f'<div role="{self.r.choice(["alert", "dialog", "status", "alertdialog"])}">{inner}</div>'

    def advert(self) -> str:
        inner = self.r.choice([self.prose(2), f"<p>{self.prose(3)}</p>", self.link(8), f"<h4>{self.words(4)}</h4><p>{self.prose(2)}</p>"])
        return self.tag(self.r.choice(["div", "div", "aside", "section", "ins"]), inner, ADVERT)

    def form(self) -> str:
        field = lambda: self.r.choice([f"<label>{self.words(2)}</label><input name='q'>", f"<p>{self.sentence()}</p>", f"<select><option>{self.word()}</option><option>{self.word()}</option></select>", f"<textarea>{self.words(3)}</textarea>", f"<button>{self.word()}</button>", f"<fieldset><legend>{self.words(2)}</legend>{self.sentence()}</fieldset>"])
        inner = f"<form action='/{self.word()}'>" + "".join(field() for _ in range(self.r.randint(1, 5))) + "</form>"
        return inner if self.r.random() < 0.5 else self.tag("div", (f"<h3>{self.words(3)}</h3>" if self.r.random() < 0.5 else "") + inner, FORM)

    def comments(self) -> str:
        r = self.r
        one = lambda: r.choice([f"<div class='{r.choice(COMMENT)}'><b>{self.words(2)}</b><p>{self.prose(5)}</p></div>", f"<li><cite>{self.word()}</cite><p>{self.prose(4)}</p></li>", f"<p>{self.prose(6)}</p>", f"<article class='comment'><p>{self.prose(4)}</p></article>", f"<blockquote>{self.prose(3)}</blockquote>"])
        inner = "".join(one() for _ in range(r.randint(1, 6)))
        return self.tag(r.choice(["div", "section", "ol", "ul", "div"]), (f"<h{r.choice('234')}>{self.words(2)}</h3>" if r.random() < 0.5 else "") + inner, COMMENT)

    def share(self) -> str:
        return self.tag(self.r.choice(["div", "ul", "p"]), " ".join(self.link(1) for _ in range(self.r.randint(2, 5))), SHARE)

    # --- the article ---

    def say(self, text: str) -> str:
        """Text of the article: noted as a line, written with references, line ends and inline tags."""
        r = self.r
        if r.random() < 0.1:
            text = text.replace(" ", r.choice([" & ", " < ", ' "', " — "]), 1)
        line = " ".join(text.split())
        if line:
            self.lines.append(line)
        written = entities.escape(text, quote=r.random() < 0.5)
        if r.random() < 0.15:
            written = written.replace(" ", "\n  ", 2)
        if r.random() < 0.2 and ";" not in written:
            a, _, b = written.partition(" ")
            kind = r.choice(["b", "em", "a", "span", "i", "strong", "code"])
            written = f"<{kind}{' href=x' if kind == 'a' else ''}>{a}</{kind}> {b}" if b else f"<{kind}>{a}</{kind}>"
        return written

    def paragraph(self) -> str:
        r, kind = self.r, self.r.random()
        if kind < 0.62:
            text = self.say(self.prose(r.choice([1, 3, 6, 10])))
            return r.choice([f"<p>{text}</p>", f"<p>{text}</p>", f"<p>{text}</p>\n", f"<p>{text}", f"<p><b>{text}<br>", f"<div>{text}</div>", f'<p class="{r.choice(["lead", "first", "p1", "intro"])}">{text}</p>'])
        if kind < 0.74:
            return (lambda h: f"<h{h}>{self.say(self.words(r.randint(1, 8)))}</h{h}>")(r.choice("2234"))
        if kind < 0.84:
            close = r.choice(["</li>", ""])
            return "<ul>" + "".join(f"<li>{self.say(self.sentence())}{close}" for _ in range(r.randint(1, 5))) + "</ul>"
        if kind < 0.9:
            return f"<blockquote><p>{self.say(self.prose(3))}</p></blockquote>"
        if kind < 0.94:
            return f"<pre>{self.say(self.prose(2))}</pre>"
        if kind < 0.97:
            return "<table>" + "".join(f"<tr><td>{self.say(self.words(2))}</td><td>{self.say(self.sentence())}</td></tr>" for _ in range(r.randint(1, 3))) + "</table>"
        return f"<figure><img src=x><figcaption>{self.say(self.sentence())}</figcaption></figure>"

    def article(self) -> str:
        r, parts = self.r, []
        if r.random() < 0.8:
            title = self.say(self.words(r.randint(1, 9)) + r.choice(["", "", "."]))
            parts.append(f"<h1>{title}</h1>" if r.random() < 0.8 else f"<header><h1>{title}</h1></header>" if r.random() < 0.4 else f"<h2>{title}</h2>")
        for _ in range(r.choice([0, 1, 2, 4, 6, 9, 14])):
            parts.append(self.paragraph())
            if r.random() < 0.07:
                parts.append(r.choice([self.advert, self.side, self.form, self.share, self.notice, self.menu])())
        if r.random() < 0.15:
            parts.append(r.choice([self.share, self.foot, self.comments, self.side])())
        inner = "".join(parts)
        kind = r.random()
        if kind < 0.4:
            return self.tag("article", inner, ARTICLE if r.random() < 0.4 else None)
        if kind < 0.55:
            return self.tag("main", inner, ARTICLE if r.random() < 0.5 else None)
        if kind < 0.65:
            return "<main>" + self.tag("article", self.tag("div", inner, ARTICLE) if r.random() < 0.5 else inner) + "</main>"
        return self.tag(r.choice(["div", "div", "section", "td"]), inner, ARTICLE) if kind < 0.95 else inner

    def page(self) -> str:
        r = self.r
        some = lambda f, p: [f()] if r.random() < p else []
        top = some(self.notice, 0.3) + some(self.head, 0.5) + some(self.menu, 0.75) + some(self.advert, 0.4) + some(self.form, 0.15) + some(self.notice, 0.15)
        r.shuffle(top)
        before = some(self.side, 0.2) + some(self.menu, 0.15)
        article = self.article()
        after = some(self.share, 0.2) + some(self.advert, 0.25) + some(self.side, 0.4) + some(self.comments, 0.4) + some(self.form, 0.2) + some(self.notice, 0.15)
        middle = "".join([*before, article, *after])
        for _ in range(r.choice([0, 0, 1, 2])):
            middle = self.tag("div", middle, NEUTRAL)
        noise = ["<!-- ad 0 -->", f'<script>var t="</p><p>{self.words(3)}";</script>', "<style>p{margin:0}</style>", f"<noscript><p>{self.sentence()}</p></noscript>", "\n", "<hr>", f"<!-- <p>{self.sentence()}</p> -->"]
        body = "".join(x for part in [*top, middle, *some(self.foot, 0.8), *some(self.notice, 0.1)] for x in (part, r.choice(["", "", *noise])))
        head = f'<head><meta charset="utf-8"><title>{self.words(4)}</title><style>a{{b:c}}</style></head>' if r.random() < 0.8 else ""
        return r.choice(["<!DOCTYPE html>", ""]) + f'<html lang="en">{head}<body>{body}' + r.choice(["</body></html>", ""])


def labelled_pages(n: int, first: int = 0) -> Iterator[tuple[str, str]]:
    """n pages with their main text; the same numbers give the same pages. `first` gives others, for measuring."""
    for seed in range(first, first + n):
        p = _Page(seed)
        html = p.page()
        yield html, "\n".join(p.lines)
