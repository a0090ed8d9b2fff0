"""Labelled pages for the main-text model: made from a rule, with the label of each element in data-y."""

from __future__ import annotations

import random

_SYLLABLES = "ka lo mi ren ta shu vor en il dra pe nos qui ber um al".split()


class _Page:
    def __init__(self, rng: random.Random):
        self.r = rng

    def words(self, lo: int, hi: int) -> str:
        return " ".join("".join(self.r.choices(_SYLLABLES, k=self.r.randint(1, 3))) for _ in range(self.r.randint(lo, hi)))

    def sentence(self, long: bool = True) -> str:
        return self.words(*((12, 70) if long else (1, 9))).capitalize() + "."

    def el(self, tag: str, y: int, inner: str, attrs: str = "", close: bool = True) -> str:
        return f'<{tag} data-y="{y}"{" " + attrs if attrs else ""}>{inner}' + (f"</{tag}>" if close else "")

    def link(self, y: int, text: str | None = None) -> str:
        return self.el("a", y, text or self.words(1, 3), 'href="/x"')

    def cue(self, *names: str) -> str:
        kind = self.r.choice(["class", "class", "id"])
        return f'{kind}="{self.r.choice(names)}"'

    def menu(self) -> str:
        items = "".join(self.el("li", 0, self.link(0)) for _ in range(self.r.randint(3, 9)))
        listed = self.el("ul", 0, items)
        return self.r.choice([lambda: self.el("nav", 0, listed), lambda: self.el("div", 0, listed, self.cue("menu", "navbar", "nav", "breadcrumb", "topnav")), lambda: self.el("nav", 0, "".join(self.link(0) for _ in range(4)))])()

    def advert(self) -> str:
        text = self.sentence(self.r.random() < 0.6)
        return self.el(self.r.choice(["div", "div", "section", "aside"]), 0, self.r.choice([text, self.el("p", 0, text)]), self.cue("ad", "ads", "advert", "banner", "sponsored", "promo"))

    def notice(self) -> str:
        return self.el("div", 0, self.el("p", 0, self.sentence()) + self.el("button", 0, "Ok"), self.cue("cookie", "cookie-notice", "consent", "popup", "notice", "newsletter", "subscribe"))

    def side(self) -> str:
        body = "".join(self.el("p", 0, self.sentence(self.r.random() < 0.5)) for _ in range(self.r.randint(1, 3)))
        body = self.r.choice([body, self.el("h3", 0, self.words(1, 3)) + self.el("ul", 0, "".join(self.el("li", 0, self.link(0)) for _ in range(4)))])
        return self.r.choice([lambda: self.el("aside", 0, body), lambda: self.el("div", 0, body, self.cue("sidebar", "related", "widget", "share", "social"))])()

    def comments(self) -> str:
        one = [self.el("div", 0, self.el("p", 0, self.sentence(self.r.random() < 0.6)), self.cue("comment", "reply", "comment-body")) for _ in range(self.r.randint(1, 4))]
        return self.el(self.r.choice(["section", "div", "ol"]), 0, self.el("h3", 0, "Comments") + "".join(one), self.cue("comments", "reader-comments", "discussion", "responses"))

    def form(self) -> str:
        return self.el("form", 0, self.el("label", 0, self.words(1, 4)) + '<input data-y="0" type="text">' + self.el("select", 0, self.el("option", 0, "a") + self.el("option", 0, "b")) + self.el("button", 0, self.words(1, 2)) + self.el("textarea", 0, self.words(0, 5)))

    def code(self) -> str:
        return self.r.choice([self.el("script", 0, "var t='</p>';track(1);"), self.el("style", 0, "p{margin:0}"), self.el("noscript", 0, self.sentence()), self.el("iframe", 0, ""), self.el("svg", 0, self.el("title", 0, "icon"))])

    def inline(self, text: str) -> str:
        return self.r.choice([text, text, text, self.el("b", 1, text), text + " " + self.link(1) + " " + self.words(1, 9), self.el("em", 1, self.words(1, 3)) + " " + text, self.el("span", 1, text)])

    def paragraph(self) -> str:
        text = self.inline(self.sentence(self.r.random() < 0.65))
        kind = self.r.random()
        if kind < 0.12:
            return self.el("p", 1, f'<b data-y="1">{text}<br data-y="1">', close=False)
        if kind < 0.22:
            return self.el(self.r.choice(["h2", "h3"]), 1, self.words(2, 9))
        if kind < 0.32:
            return self.el(self.r.choice(["ul", "ol"]), 1, "".join(self.el("li", 1, self.inline(self.sentence(self.r.random() < 0.5))) for _ in range(self.r.randint(2, 5))))
        if kind < 0.37:
            return self.el("blockquote", 1, self.el("p", 1, text))
        if kind < 0.41:
            return self.el("table", 1, "".join(self.el("tr", 1, self.el("td", 1, self.words(1, 4)) + self.el("td", 1, self.words(1, 4))) for _ in range(3)))
        if kind < 0.44:
            return self.el("pre", 1, self.words(3, 20))
        if kind < 0.48:
            return self.el("figure", 1, '<img data-y="1" src="x">' + self.el("figcaption", 1, self.words(2, 8)))
        if kind < 0.54:
            return self.el("div", 1, text)
        return self.el("p", 1, text)

    def article(self) -> str:
        parts = [self.el("h1", 1, self.words(2, 12))] if self.r.random() < 0.85 else []
        for _ in range(self.r.choice([0, 1, 2, 4, 8, 14])):
            parts.append(self.paragraph())
            if self.r.random() < 0.06:
                parts.append(self.r.choice([self.advert, self.side, self.notice, self.form, self.code])())
        if not parts:
            parts.append(self.el("p", 1, self.sentence()))
        if self.r.random() < 0.12:
            parts.insert(0, self.el("header", 0, self.words(1, 5)))
        if self.r.random() < 0.15:
            parts.append(self.el("footer", 0, self.words(2, 12)))
        if self.r.random() < 0.15:
            parts.append(self.comments())
        body = "".join(parts)
        kind = self.r.random()
        if kind < 0.5:
            return self.el("article", 1, body, self.r.choice(["", "", self.cue("post", "entry", "story")]))
        if kind < 0.62:
            return self.el("main", 1, self.r.choice([body, self.el("article", 1, body), self.el("div", 1, body)]))
        if kind < 0.85:
            return self.el(self.r.choice(["div", "section"]), 1, self.r.choice([body, self.el("div", 1, body)]), self.cue("content", "article-body", "post", "entry-content", "main", "story"))
        if kind < 0.92:
            return self.el(self.r.choice(["div", "section"]), 1, body)
        return body

    def page(self) -> str:
        r, top, end = self.r, [], []
        for part, chance in ((self.menu, 0.8), (self.advert, 0.5), (self.notice, 0.25), (self.side, 0.2), (self.code, 0.3)):
            if r.random() < chance:
                top.append(part())
        if r.random() < 0.35:
            top.insert(0, self.el("header", 0, self.el("h1", 0, self.words(1, 4)) + self.menu()))
        for part, chance in ((self.comments, 0.3), (self.side, 0.35), (self.form, 0.25), (self.advert, 0.25), (self.code, 0.3)):
            if r.random() < chance:
                end.append(part())
        if r.random() < 0.8:
            text = "&copy; " + self.sentence(r.random() < 0.5)
            end.append(r.choice([self.el("footer", 0, text), self.el("footer", 0, self.el("p", 0, text) + self.link(0)), self.el("div", 0, text, self.cue("footer", "copyright", "legal"))]))
        body = "".join([*top, self.article(), *end])
        if r.random() < 0.25:
            body = self.el("div", 0, body, self.cue("wrapper", "page", "container", "site"))
        head = self.el("head", 0, '<meta data-y="0" charset="utf-8">' + self.el("title", 0, self.words(2, 9)) + self.el("style", 0, "p{}"))
        return "<!DOCTYPE html>" + self.el("html", 0, head + self.el("body", 0, body, close=r.random() < 0.9))


def labelled_pages(n: int = 500, seed: int = 3) -> list[str]:
    """n pages; an element with data-y="1" is main text, as are the texts directly inside it."""
    rng = random.Random(seed)
    return [_Page(rng).page() for _ in range(n)]
