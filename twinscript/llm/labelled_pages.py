"""Labelled pages for the fit: drawn layouts around drawn text, each with its main text.

A page is a header, menus, notices, adverts, an article, side columns, forms, comments and a
footer in many markups, with or without semantic tags and telling class names. The words mean
nothing, so a model can only learn from structure and shape.
"""

import random

# Common element and class names by the part of a page that they mark.
PARTS = {
    "menu": (["nav", "ul", "div"], ["nav", "menu", "navbar", "main-menu", "breadcrumb", "topnav", "toc", "pagination"]),
    "header": (["header", "div"], ["header", "site-header", "masthead", "banner-top", "branding", "logo"]),
    "footer": (["footer", "div"], ["footer", "site-footer", "copyright", "bottom", "legal", "colophon"]),
    "side": (["aside", "div", "section"], ["sidebar", "side", "widget", "related", "recommended", "trending", "most-read", "rail"]),
    "notice": (["div", "section", "dialog"], ["cookie-notice", "notice", "consent", "gdpr", "alert", "popup", "modal", "newsletter", "disclaimer", "paywall"]),
    "advert": (["div", "aside", "section", "ins"], ["ad", "ads", "advert", "advertisement", "sponsored", "promo", "banner"]),
    "form": (["form", "div"], ["search", "search-form", "subscribe", "login", "signup", "contact-form"]),
    "comments": (["section", "div", "ol"], ["comments", "comment-list", "discussion", "replies", "disqus", "responses", "reader-comments"]),
    "share": (["div", "ul"], ["share", "social", "share-buttons", "tags", "follow"]),
}
ARTICLE = (["article", "main", "div", "section", "td"], ["article", "content", "post", "entry", "story", "article-body", "post-content", "main", "text", "body"])


class Drawer:
    def __init__(self, seed: int):
        self.r = random.Random(seed)
        letters = "abcdefghilmnoprstuväéñö"
        self.words = ["".join(self.r.choices(letters, k=self.r.randint(1, 9))) for _ in range(400)]

    def some(self, low: int, high: int) -> str:
        return " ".join(self.r.choices(self.words, k=self.r.randint(low, high)))

    def sentences(self, low: int, high: int) -> str:
        made = []
        for _ in range(self.r.randint(low, high)):
            s = self.some(1, 18).split(" ")
            made.append(" ".join(w + ("," if self.r.random() < 0.08 else "") for w in s[:-1]) + " " * (len(s) > 1) + s[-1] + ".")
        return " ".join(s[:1].upper() + s[1:] for s in made)

    def wrap(self, kind: tuple[list[str], list[str]], inside: str, plain: float = 0.25) -> str:
        tags, names = kind
        tag = self.r.choice(tags)
        semantic = tag in ("nav", "header", "footer", "aside", "form", "article", "main")
        key = ""
        if self.r.random() > (0.6 if semantic else plain * 0.4):
            key = f' {self.r.choice(["class", "id"])}="{self.r.choice(names)}"'
        return f"<{tag}{key}>{inside}</{tag}>"

    def links(self, low: int, high: int) -> str:
        item = lambda: f'<a href="/{self.some(1, 1)}">{self.some(1, 3)}</a>'
        items = [item() for _ in range(self.r.randint(low, high))]
        style = self.r.random()
        if style < 0.6:
            return "<ul>" + "".join(f"<li>{x}</li>" for x in items) + "</ul>"
        return (" | " if style < 0.8 else " ").join(items)

    def part(self, name: str) -> str:
        r = self.r
        short = lambda: self.r.choice([self.some(1, 8), self.sentences(1, 2), self.sentences(1, 1)])
        if name == "menu":
            inside = self.links(3, 9)
        elif name == "header":
            inside = r.choice([f"<h1>{self.some(1, 4)}</h1>", f"<a href='/'>{self.some(1, 2)}</a>", self.some(1, 5), f"<p>{self.sentences(1, 1)}</p>"])
        elif name == "footer":
            inside = r.choice(["&copy; ", "© ", "&copy; ", ""]) + r.choice([short(), f"{self.some(1, 2)} &middot; {self.sentences(1, 2)}", self.links(2, 5), f"<p>{short()}</p>"])
        elif name == "side":
            inside = f"<h3>{self.some(1, 4)}</h3>" * (r.random() < 0.7) + r.choice([self.links(2, 6), f"<p>{short()}</p>", f"<p>{self.sentences(1, 4)}</p>"])
        elif name == "form":
            inside = f"<label>{self.some(1, 3)}</label><input name=q>" + f"<button>{self.some(1, 2)}</button>" + f"<p>{short()}</p>" * (r.random() < 0.4)
        elif name == "comments":
            one = lambda: f"<{t}><b>{self.some(1, 2)}</b><p>{self.sentences(1, 4)}</p></{t}>"
            t = r.choice(["li", "div"])
            inside = f"<h3>{self.some(1, 3)}</h3>" * (r.random() < 0.6) + "".join(one() for _ in range(r.randint(1, 5)))
        else:
            inside = r.choice([short(), f"<p>{short()}</p>", f"<p>{self.sentences(1, 3)}</p>", short() + f" <button>{self.some(1, 2)}</button>"])
        return self.wrap(PARTS[name], inside)

    def article(self) -> tuple[str, list[str]]:
        r, lines, marked = self.r, [], []

        def add(tag: str, text: str, shown: str | None = None, close: bool = True) -> None:
            lines.append(text)
            marked.append(f"<{tag}>{shown or text}" + f"</{tag}>" * close)

        if r.random() < 0.85:
            add("h1", self.some(1, 9))
        for _ in range(r.randint(1, 12)):
            kind = r.random()
            if kind < 0.1:
                add(r.choice(["h2", "h3"]), self.some(1, 6))
            elif kind < 0.16:
                items = [self.sentences(1, 1) if r.random() < 0.5 else self.some(2, 10) for _ in range(r.randint(2, 5))]
                lines.extend(items)
                marked.append("<ul>" + "".join(f"<li>{x}</li>" for x in items) + "</ul>")
            elif kind < 0.2:
                add("blockquote", self.sentences(1, 2))
            elif kind < 0.3:
                a, b, c = self.some(1, 5), self.some(1, 3), self.sentences(1, 3)
                add("p", f"{a} {b} {c}", f"{a} <a href='/x'>{b}</a> {c}")
            elif kind < 0.45:
                add("p", self.sentences(1, 1) if r.random() < 0.5 else self.some(1, 3) + r.choice([".", "", "!"]))
            elif kind < 0.6:
                s = self.sentences(1, 3)
                add("p", s, f"<b>{s}<br>", r.random() < 0.5)
            else:
                add("p", self.sentences(2, 7), close=r.random() < 0.9)
        return "".join(marked), lines

    def page(self) -> tuple[str, str]:
        r = self.r
        body, lines = self.article()
        extra = ["advert", "share", "notice", "form"]
        inner = self.wrap(ARTICLE, body, plain=0.6) if r.random() < 0.95 else body
        if r.random() < 0.2:  # something that stands inside the article's own element
            tag = r.choice(["article", "main", "div"])
            before, after = [self.part(r.choice(extra + ["side"])) * (r.random() < 0.5) for _ in range(2)]
            inner = f"<{tag}>{before}{inner}{after}</{tag}>"
        top = [self.part(x) for x in r.sample(["header", "menu", "notice", "advert", "form", "side"], r.randint(1, 4))]
        end = [self.part(x) for x in r.sample(["comments", "side", "share", "advert", "notice", "form", "menu"], r.randint(0, 4))] + [self.part("footer")] * (r.random() < 0.9)
        wrapped = "".join(top) + inner + "".join(end)
        if r.random() < 0.3:
            wrapped = f'<div id="{r.choice(["page", "wrapper", "container"])}">{wrapped}</div>'
        return f"<html><head><title>{lines[0]}</title></head><body>{wrapped}</body></html>", "\n".join(lines)


def drawn_pages(n: int = 700, seed: int = 5) -> list[tuple[str, str]]:
    """``n`` pages as (html, main text)."""
    drawer = Drawer(seed)
    return [drawer.page() for _ in range(n)]
