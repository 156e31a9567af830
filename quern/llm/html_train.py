"""Fits the block classifier on pages made for it: python -m quern.llm.html_train prints the weights for html_weights.py.

The pages are drawn from a grammar of layouts (menus, page headers, sidebars, notices, adverts, forms, comments and footers around
an article of headings, paragraphs, quotes and lists) with the label of every block known, so no outside data is needed.
"""

from __future__ import annotations

import random

import numpy as np

from quern.llm.html_blocks import FEATURES, blocks_of, features_of

VOWELS, CONSONANTS = "aeiou", "bcdfghlmnprstv"
KEEP, DROP = "⁠K", "⁠D"  # label marks, invisible to the features


class PageMaker:
    def __init__(self, seed: int):
        self.pick = random.Random(seed)

    def word(self) -> str:
        return "".join(self.pick.choice(CONSONANTS) + self.pick.choice(VOWELS) for _ in range(self.pick.randint(1, 4)))

    def words(self, low: int, high: int) -> str:
        return " ".join(self.word() for _ in range(self.pick.randint(low, high)))

    def sentences(self, low: int, high: int) -> str:
        return " ".join(self.words(3, 18).capitalize() + self.pick.choice("...!?") for _ in range(self.pick.randint(low, high)))

    def links(self, n: int) -> str:
        return "".join(f'<li><a href="/{self.word()}">{DROP}{self.words(1, 3)}</a></li>' for _ in range(n))

    def nested(self, inner: str) -> str:
        """inner within up to three more elements, whose names may be those that articles have, too."""
        for _ in range(self.pick.choice([0, 0, 0, 1, 2, 3])):
            inner = f'<div class="{self.pick.choice(["inner", "content", "body", "text", "x2", "comment-body", "row"])}">{inner}</div>'
        return inner

    def junk(self) -> str:
        p = self.pick
        if p.random() < 0.1:
            body = "".join(f'<article class="{p.choice(["comment", "comment depth-2", "reply"])}">' + self.nested(f"<p>{DROP}{self.sentences(1, 5)}</p>") + "</article>" for _ in range(p.randint(1, 4)))
            return f'<{p.choice(["section", "div"])} class="{p.choice(["comments", "comments-area", "replies"])}"><h2>{DROP}{self.words(1, 3)}</h2>{body}</div></section>'
        if p.random() < 0.15:
            name = p.choice(["sidebar", "ad", "related-posts", "widget", "cookie-notice", "promo", "share", "newsletter"])
            return f'<div class="{name}">' + self.nested(f"<p>{DROP}{self.sentences(1, 4)}</p>" + f"<ul>{self.links(p.randint(1, 4))}</ul>" * p.randint(0, 1)) + "</div>"
        if p.random() < 0.05:
            return f"<button>{self.words(1, 2)}" + "</button>" * p.randint(0, 1)
        text = self.pick, self.sentences(1, 3) if self.pick.random() < 0.6 else self.words(2, 8)
        kind = p.randrange(13)
        if kind == 0:
            return f"<nav><ul>{self.links(p.randint(3, 9))}</ul></nav>"
        if kind == 1:
            return f'<div class="{p.choice(["ad", "ads", "advert", "sponsored", "promo-box", "banner"])}">{DROP}{text}</div>'
        if kind == 2:
            return f'<aside>{f"<h3>{DROP}{self.words(1, 4)}</h3>" * p.randint(0, 1)}<p>{DROP}{text}</p></aside>'
        if kind == 3:
            return f'<div class="{p.choice(["cookie-notice", "notice", "consent", "popup", "newsletter"])}"><p>{DROP}{text}</p></div>'
        if kind == 4:
            return f'<form action="/s"><label>{DROP}{self.words(1, 4)}</label><input name="q"></form>'
        if kind == 5:
            return f'<section class="{p.choice(["comments", "comment-list", "replies"])}">' + "".join(f'<div class="comment"><p>{DROP}{self.sentences(1, 4)}</p></div>' for _ in range(p.randint(1, 4))) + "</section>"
        if kind == 6:
            return f'<div class="{p.choice(["sidebar", "related", "share", "widget"])}"><ul>{self.links(p.randint(2, 5))}</ul></div>'
        if kind == 7:
            return f"<header><p>{DROP}{text}</p></header>"
        if kind == 8:
            return f"<ul>{self.links(p.randint(4, 9))}</ul>"
        if kind == 9:
            return f'<div class="breadcrumbs"><a href="/">{DROP}{self.word()}</a></div>'
        if kind == 10:
            return f"<nav><p>{DROP}{text}</p></nav>"
        if kind == 11:
            return f"<dialog><p>{DROP}{text}</p></dialog>"
        return f"<footer><p>{DROP}&copy; {text}</p></footer>"

    def article(self) -> str:
        p, parts = self.pick, [f"<h1>{KEEP}{self.words(2, 12)}</h1>"]
        for _ in range(p.randint(1, 10)):
            draw = p.random()
            if draw < 0.06:
                link = f'<a href="/{self.word()}">{KEEP}{self.sentences(1, 2)}</a>'
                parts.append(f"<p>{link}</p>" if p.random() < 0.5 else f"<p>{self.words(1, 4).capitalize()} {link} {self.words(0, 3)}</p>")
            elif draw < 0.1:
                parts.append(p.choice(["<p>{} <math><mi>{}</mi></math> {}</p>", "<p>{} <svg><text>{}</text></svg> {}</p>", "<object><p>{} {} {}</p></object>", "<xmp>{} <b> {} {}</xmp>"]).format(KEEP + self.words(2, 8), self.word(), self.sentences(1, 3)))
            elif draw < 0.72:
                bold = "<b>" * (p.random() < 0.15)
                parts.append(f"<p>{bold}{KEEP}{self.sentences(1, 9) if p.random() < 0.85 else self.words(1, 4)}" + p.choice(["</p>", "</p>", "<br>"]))
            elif draw < 0.8:
                parts.append(f"<h2>{KEEP}{self.words(1, 7)}</h2>")
            elif draw < 0.87:
                parts.append(f"<blockquote>{KEEP}{self.sentences(1, 3)}</blockquote>")
            elif draw < 0.94:
                parts.append("<ul>" + "".join(f"<li>{KEEP}{self.words(2, 14)}</li>" for _ in range(p.randint(2, 5))) + "</ul>")
            else:
                parts.append(self.junk())
        draw = p.random()
        named = f' class="{p.choice(["post", "post category-tags has-comments", "hentry sticky comments", "with-share entry", "single ad-free"])}"' * p.randint(0, 1)
        if draw < 0.5:
            return f"<article{named}>{''.join(parts)}</article>"
        if draw < 0.7:
            return f"<main{named}>{''.join(parts)}</main>"
        return f'<div class="{p.choice(["content", "entry-content", "post", "story", "x1", "wrap"])}">{"".join(parts)}</div>'

    def page(self) -> str:
        p = self.pick
        above, below = "".join(self.junk() for _ in range(p.randint(1, 4))), "".join(self.junk() for _ in range(p.randint(1, 4)))
        names = f' class="{p.choice(["page right-sidebar", "has-sidebar", "home", "single comments-open", "with-ads menu-top"])}"' * p.randint(0, 1)
        content = f"{above}{self.article()}{below}"
        if p.random() < 0.3:
            content = f'<div class="{p.choice(["wrap", "container has-sidebar", "layout with-sidebar", "site", "right-sidebar", "page"])}">{content}</div>'
        if p.random() < 0.1:
            content = f'<form action="/all">{content}</form>'
        return f"<!DOCTYPE html><html><head><title>{self.word()}</title></head><body{names}>{content}</body></html>"


def labelled(seed: int, pages: int) -> tuple[np.ndarray, np.ndarray]:
    maker, rows, labels = PageMaker(seed), [], []
    for _ in range(pages):
        for block in blocks_of(maker.page()):
            labels.append(KEEP in block.text)
            block.text = block.text.replace(KEEP, "").replace(DROP, "") or "."
            rows.append(features_of(block))
    return np.array(rows, dtype=float), np.array(labels, dtype=float)


def fit(rows: np.ndarray, labels: np.ndarray, rounds: int = 60, ridge: float = 2.0) -> np.ndarray:
    """Logistic regression by Newton's method, the bias unpenalized."""
    weights, penalty = np.zeros(rows.shape[1]), np.full(rows.shape[1], ridge)
    penalty[0] = 0.0
    for _ in range(rounds):
        chance = 1 / (1 + np.exp(-rows @ weights))
        slope = rows.T @ (chance - labels) + penalty * weights
        curve = (rows * (chance * (1 - chance))[:, None]).T @ rows + np.diag(penalty + 1e-6)
        weights -= np.linalg.solve(curve, slope)
    return weights


def main() -> None:
    weights = fit(*labelled(1, 4000))
    rows, labels = labelled(2, 1000)
    print(f"# held-out accuracy {np.mean((rows @ weights > 0) == (labels > 0)):.4f}")
    for name, weight in zip(FEATURES, weights):
        print(f"    {weight:.3f},  # {name}")


if __name__ == "__main__":
    main()
