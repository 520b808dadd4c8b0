"""Labelled pages to train on, made by rule: the layouts, containers and class names that public web pages use."""

from __future__ import annotations

import random

_SYLLABLES = "an be ca di el fo ga hi in jo ka le mo ni or pe qu ra se ti un ve wa xi yo zu th st ch".split()
#: How containers of a kind are written; {} holds their content.
KINDS = {
    "menu": ["<nav>{}</nav>", '<nav class="navbar">{}</nav>', '<div class="menu">{}</div>', '<div id="nav">{}</div>', '<div role="navigation">{}</div>', '<ul class="breadcrumbs">{}</ul>', '<div class="pagination">{}</div>', '<menu>{}</menu>', '<div class="toc">{}</div>'],
    "header": ["<header>{}</header>", '<div class="header">{}</div>', '<div id="masthead">{}</div>', '<div role="banner">{}</div>', '<header class="site-header">{}</header>'],
    "footer": ["<footer>{}</footer>", '<div class="footer">{}</div>', '<div id="footer">{}</div>', '<div role="contentinfo">{}</div>', '<div class="copyright">{}</div>'],
    "sidebar": ["<aside>{}</aside>", '<aside class="sidebar">{}</aside>', '<div class="sidebar">{}</div>', '<div id="sidebar">{}</div>', '<div class="widget">{}</div>', '<div class="related">{}</div>', '<div role="complementary">{}</div>', '<section class="recommended">{}</section>'],
    "notice": ['<div class="cookie-notice">{}</div>', '<div class="notice">{}</div>', '<div id="cookie-banner">{}</div>', '<div class="alert">{}</div>', '<dialog>{}</dialog>', '<div class="consent">{}</div>', '<div class="paywall">{}</div>', '<p class="disclaimer">{}</p>', '<div role="alert">{}</div>', '<div class="popup">{}</div>'],
    "advert": ['<div class="ad">{}</div>', '<div class="ads">{}</div>', '<div class="advert">{}</div>', '<div class="advertisement">{}</div>', '<div class="sponsored">{}</div>', '<div class="promo">{}</div>', '<aside class="ad">{}</aside>', '<div id="ad-1">{}</div>', '<section class="promo">{}</section>', '<p class="ad">{}</p>'],
    "form": ["<form>{}</form>", '<form class="newsletter">{}</form>', '<div class="subscribe">{}</div>', '<form id="search">{}</form>', '<div class="signup">{}</div>', "<fieldset>{}</fieldset>"],
    "share": ['<div class="share">{}</div>', '<ul class="social">{}</ul>', '<div class="tags">{}</div>'],
    "hidden": ["<div hidden>{}</div>", '<div style="display:none">{}</div>', '<section style="display: none;">{}</section>', '<p hidden="hidden">{}</p>', '<div class="text" hidden>{}</div>'],
    "comment": ['<div class="comments">{}</div>', '<section class="comments">{}</section>', '<section id="comments">{}</section>', '<div id="comments">{}</div>', '<div class="comment">{}</div>', '<ol class="commentlist">{}</ol>', '<div id="disqus">{}</div>', '<article class="comment">{}</article>', '<div class="replies">{}</div>'],
}
ARTICLES = ["<article>{}</article>", '<article class="post">{}</article>', "<main>{}</main>", "<main><article>{}</article></main>", '<div class="content">{}</div>', '<div id="content">{}</div>', '<div class="article-body">{}</div>', '<div class="entry-content">{}</div>', '<div class="post">{}</div>', '<section class="story">{}</section>', '<div role="main">{}</div>', '<div id="main"><div class="text">{}</div></div>', "<div><div>{}</div></div>", '<div itemprop="articleBody">{}</div>']


class Maker:
    def __init__(self, seed: int):
        self.r = random.Random(seed)

    def words(self, n: int) -> str:
        w = ["".join(self.r.choices(_SYLLABLES, k=self.r.choice((1, 1, 2, 2, 3)))) for _ in range(n)]
        return " ".join(w).capitalize()

    def sentences(self, most: int) -> str:
        return " ".join(self.words(self.r.randint(1, 14)) + self.r.choice((".", ".", ".", "?", "!", ":", "")) for _ in range(self.r.randint(1, most)))

    def marked(self, label: int, text: str) -> str:
        """The label stands before a block's text, as a character that no page has."""
        return "\ue001" * label + "\ue000" * (1 - label) + text

    def other(self, kind: str) -> str:
        r, mark = self.r, lambda t: self.marked(0, t)
        if kind in ("menu", "share") or kind in ("sidebar", "footer", "header") and r.random() < 0.5:
            inner = "".join(f'<li><a href="/x">{mark(self.words(r.randint(1, 4)))}</a></li>' for _ in range(r.randint(1, 8)))
            inner = inner if r.random() < 0.3 else f"<ul>{inner}</ul>"
        elif kind == "form":
            inner = f"<p>{mark(self.words(r.randint(1, 8)))}</p><input><label>{mark(self.words(2))}</label>"
        elif kind == "comment":
            inner = "".join(f"{r.choice(('<p>', '<li>', '<div>'))}{mark(self.sentences(4))}" for _ in range(r.randint(1, 4)))
        elif r.random() < 0.5:
            inner = mark(self.sentences(3))
        else:
            inner = "".join(f"<p>{mark(self.sentences(3))}</p>" for _ in range(r.randint(1, 3)))
        if kind == "footer" and r.random() < 0.7:
            inner = mark("&copy; " + self.words(r.randint(1, 10)))
        return r.choice(KINDS[kind]).format(inner)

    def body(self) -> str:
        r, mark, out = self.r, lambda t: self.marked(1, t), []
        if r.random() < 0.7:
            out.append(f"<h1>{mark(self.words(r.randint(1, 14)))}</h1>")
        for _ in range(r.randint(1, 12)):
            x = r.random()
            if x < 0.7:
                out.append(f"<p>{mark(self.sentences(r.choice((1, 2, 6, 12))))}</p>")
            elif x < 0.78:
                out.append(f"<h2>{mark(self.words(r.randint(1, 8)))}</h2>")
            elif x < 0.84:
                out.append("<ul>" + "".join(f"<li>{mark(self.sentences(1))}</li>" for _ in range(r.randint(1, 5))) + "</ul>")
            elif x < 0.88:
                out.append(f"<blockquote>{mark(self.sentences(3))}</blockquote>")
            elif x < 0.91:
                out.append(f"<table><tr><td>{mark(self.words(2))}</td><td>{mark('12')}</td></tr></table>")
            elif x < 0.94:
                out.append(f"<pre>{mark(self.words(6))}</pre>")
            elif x < 0.96:
                out.append(f"<figure><figcaption>{mark(self.words(6))}</figcaption></figure>")
            else:
                out.append(self.other(r.choice(("advert", "notice", "share", "sidebar", "form", "comment", "menu", "hidden", "hidden"))))
        if r.random() < 0.15:
            out.append(self.other("comment"))
        return r.choice(ARTICLES).format("".join(out))

    def page(self) -> str:
        r = self.r
        before = [self.other(k) for k in ("header", "menu", "notice", "advert", "sidebar", "form") if r.random() < 0.5]
        after = [self.other(k) for k in ("comment", "share", "sidebar", "advert", "form", "menu", "notice", "hidden") if r.random() < 0.4]
        r.shuffle(before)
        if r.random() < 0.85:
            after.append(self.other("footer"))
        article = self.body()
        inner = "".join([*before, article, *after])
        return f"<html><head><title>t</title></head><body>{inner}</body></html>" if r.random() < 0.7 else f'<html><body><div class="{r.choice(("page", "wrapper", "container"))}">{inner}</div></body></html>'


def labelled(pages: int = 600, seed: int = 7) -> list[str]:
    """Pages whose texts carry their labels in private-use characters; ``html_extract.train`` takes these out."""
    maker = Maker(seed)
    return [maker.page() for _ in range(pages)]
