"""Labelled pages for training: invented layouts whose main text is marked."""

from __future__ import annotations

import numpy as np

#: First character of every block of main text in a generated page.
MARK = "\ue000"
SYLLABLES = "an er in on re th ti es st en or te ou ing ed ha to it is al ar ve le me de ra ci la no se".split()
ARTICLE = ("<article>", '<article class="post">', "<main>", '<div class="content">', '<div id="article-body">', '<section class="entry">', '<div class="story text">')
MENU = ('<nav>{}</nav>', '<div class="menu">{}</div>', '<div id="navbar">{}</div>', '<ul class="nav">{}</ul>', '<div class="breadcrumb">{}</div>', '<div role="navigation">{}</div>')
HEADER = ('<header>{}</header>', '<div class="header">{}</div>', '<div id="masthead">{}</div>', '<div class="site-header top">{}</div>')
FOOTER = ('<footer>{}</footer>', '<div class="footer">{}</div>', '<div id="footer" class="bottom">{}</div>')
SIDE = ('<aside>{}</aside>', '<div class="sidebar">{}</div>', '<div id="right-sidebar">{}</div>', '<section class="related">{}</section>', '<div class="widget">{}</div>')
ADVERT = ('<div class="ad">{}</div>', '<div class="advert">{}</div>', '<aside class="ads">{}</aside>', '<div id="sponsored">{}</div>', '<div class="promo banner">{}</div>')
NOTICE = ('<div class="cookie">{}</div>', '<div class="notice">{}</div>', '<div id="cookie-banner">{}</div>', '<div class="consent popup">{}</div>', '<section class="alert">{}</section>', '<div class="newsletter subscribe">{}</div>')
COMMENTS = ('<section class="comments">{}</section>', '<div id="comments">{}</div>', '<div class="comment-list">{}</div>', '<section id="discussion" class="replies">{}</section>', '<ol class="comments">{}</ol>')
FORM = ('<form action="/s">{}</form>', '<form class="search"><label>{}</label><input name="q"></form>', '<form><fieldset>{}<button>{}</button></fieldset></form>')
SHARE = ('<div class="share">{}</div>', '<ul class="social">{}</ul>', '<div class="tags meta">{}</div>', '<div class="byline">{}</div>')


class _Writer:
    def __init__(self, rng: np.random.Generator):
        self.rng = rng

    def some(self, options):
        return options[int(self.rng.integers(len(options)))]

    def word(self) -> str:
        return "".join(self.rng.choice(SYLLABLES, int(self.rng.integers(1, 5))))

    def words(self, low: int, high: int) -> str:
        return " ".join(self.word() for _ in range(int(self.rng.integers(low, high + 1))))

    def sentences(self, low: int, high: int) -> str:
        return " ".join(self.words(2, 18).capitalize() + self.some([".", ".", ".", "!", "?"]) for _ in range(int(self.rng.integers(low, high + 1))))

    def links(self, low: int, high: int) -> str:
        n = int(self.rng.integers(low, high + 1))
        style = self.rng.random()
        made = [f'<a href="/{self.word()}">{self.words(1, 3)}</a>' for _ in range(n)]
        if style < 0.6:
            return "<ul>" + "".join(f"<li>{a}</li>" for a in made) + "</ul>"
        return self.some([" | ", " ", " &raquo; "]).join(made) if style < 0.8 else "".join(f"<p>{a}</p>" for a in made)

    def main(self) -> str:
        kind, text = self.rng.random(), self.sentences(1, 6)
        if kind < 0.15:
            text = self.words(1, 4) + self.some([".", ""])
        if kind > 0.85:
            text = text.replace(" ", f' <a href="#">{self.word()}</a> ', int(self.rng.integers(1, 4)))
        if kind < 0.7:
            return f"<p>{MARK}{text}" + self.some(["</p>", "</p>", ""])
        if kind < 0.76:
            return f"<h2>{MARK}{self.words(1, 6).capitalize()}</h2>"
        if kind < 0.82:
            return "<ul>" + "".join(f"<li>{MARK}{self.words(1, 10)}</li>" for _ in range(int(self.rng.integers(2, 6)))) + "</ul>"
        if kind < 0.86:
            return f"<blockquote>{MARK}{text}</blockquote>"
        if kind < 0.89:
            rows = "".join(f"<tr><td>{MARK}{self.words(1, 3)}</td><td>{MARK}{self.words(1, 3)}</td></tr>" for _ in range(3))
            return f"<table>{rows}</table>"
        if kind < 0.92:
            return f"<pre>{MARK}{self.words(3, 12)}</pre>"
        return f"<p>{MARK}<b>{text}" + self.some(["</b></p>", "<br>", ""])

    def boiler(self) -> str:
        kind = self.rng.random()
        if kind < 0.3:
            return self.some(ADVERT).format(self.some([self.sentences(1, 3), f"<p>{self.sentences(1, 2)}</p>"]))
        if kind < 0.5:
            return self.some(SIDE).format(self.some([self.links(2, 7), f"<h3>{self.words(1, 3)}</h3>{self.links(2, 5)}", f"<p>{self.sentences(1, 4)}</p>"]))
        if kind < 0.65:
            return self.some(NOTICE).format(self.some([self.sentences(1, 3), f"<p>{self.sentences(1, 2)}</p><button>{self.word()}</button>"]))
        if kind < 0.8:
            return self.some(FORM).format(self.words(1, 4), self.word())
        return self.some(SHARE).format(self.some([self.links(2, 4), f"<span>{self.words(2, 5)}</span>", f"<p>{self.words(2, 5)}</p>"]))

    def comments(self) -> str:
        made = ""
        for _ in range(int(self.rng.integers(1, 6))):
            said = self.sentences(1, 4)
            made += self.some([f"<p>{said}</p>", f'<div class="comment"><b>{self.word()}</b><p>{said}</p></div>', f"<li>{said}</li>", f"<article class=\"comment\"><p>{said}</p></article>"])
        return self.some(COMMENTS).format(f"<h3>{self.words(1, 2)}</h3>" + made)

    def page(self) -> str:
        chance = lambda p: self.rng.random() < p
        title = self.words(2, 12).capitalize()
        before = f"<head><title>{title}</title></head>" if chance(0.9) else ""
        if chance(0.5):
            before += self.some(HEADER).format(self.some([f"<h1>{self.words(1, 3)}</h1>", self.links(1, 4), f"<p>{self.words(2, 6)}</p>"]))
        if chance(0.8):
            before += self.some(MENU).format(self.links(2, 8))
        before += "".join(self.boiler() for _ in range(int(self.rng.integers(0, 3))))
        opening = self.some(ARTICLE)
        body = f"<h1>{MARK}{title}</h1>" if chance(0.85) else ""
        for _ in range(int(self.rng.integers(1, 14))):
            body += self.main()
            if chance(0.07):
                body += self.boiler()
        inside = self.comments() if chance(0.2) else ""
        closing = f"</{opening[1:].split()[0].rstrip('>')}>"
        after = "".join(self.boiler() for _ in range(int(self.rng.integers(0, 3))))
        if not inside and chance(0.35):
            after = self.comments() + after
        if chance(0.8):
            after += self.some(FOOTER).format(self.some([f"&copy; {self.word()}.com &middot; {self.sentences(1, 1)}", self.links(1, 6), f"<p>{self.words(3, 8)}</p><p>{self.sentences(1, 2)}</p>"]))
        page = before + opening + body + inside + closing + after
        return f"<html><body>{page}</body></html>" if chance(0.8) else page


def labelled_pages(n: int = 400, seed: int = 5) -> list[str]:
    """Pages of random layout; blocks of main text start with ``MARK``."""
    writer = _Writer(np.random.default_rng(seed))
    return [writer.page() for _ in range(n)]
