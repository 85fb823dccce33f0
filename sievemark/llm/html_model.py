"""The classifier of text blocks: features, made-up labelled pages, and a logistic regression fitted on them.

No labelled pages exist here, so the costs are learnt from pages that :func:`made_up_page` writes: articles in several
kinds of wrapping, with menus, notices, adverts, forms, comments and the like around and inside them, whose tags and
class names are drawn at random, also such names on blocks of the article itself.  A page is parsed like any other,
and its labels come from a mark that each piece of boilerplate carries in its text.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np

#: Names of the columns of :func:`features`.
FEATURES = (
    "bias", "bad_tag", "sure_outside", "sure_inside", "hint_outside", "hint_inside", "faint", "header", "inner_header", "article", "good",
    "outside_of_article", "length", "short", "links", "heading", "sentence", "hint_and_links", "hint_and_sentence", "listed_links",
)
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
PAGES = 400
_MARK = "⁣"  # an invisible character, in boilerplate of made-up pages only


def features(found: list) -> np.ndarray:
    """A row for each block of a page."""
    has_article = any(b.element.article and not b.element.bad for b in found)
    out = np.zeros((len(found), len(FEATURES)))
    for row, b in zip(out, found):
        e, n = b.element, len(b.text)
        inside = e.article or e.good
        heading, sentence = e.tag in HEADINGS, b.text[-1] in ".!?…:;。”\""
        hint = e.named == 2
        row[:] = (
            1, e.bad, e.named == 3 and not inside, e.named == 3 and inside, hint and not inside, hint and inside, e.named == 1, e.header == 1, e.header == 2 and not heading, e.article, e.good,
            has_article and not e.article, min(n, 200) / 200, n < 25 and not heading, b.link_share, heading, sentence, hint and b.link_share > 0.5, hint and sentence and n >= 40, e.tag == "li" and b.link_share > 0.8,
        )
    return out


def fit(rows: np.ndarray, labels: np.ndarray, ridge: float = 0.02, steps: int = 12) -> np.ndarray:
    """Weights of a logistic regression by Newton's method, with a penalty on their squares."""
    w = np.zeros(rows.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(rows @ w, -30, 30)))
        slope = rows.T @ (p - labels) / len(labels) + ridge / 10 * w
        curve = (rows * (p * (1 - p))[:, None]).T @ rows / len(labels) + ridge / 10 * np.eye(len(w))
        w -= np.linalg.solve(curve, slope)
    return w


# Made-up pages

_SYLLABLES = "ka lo mi tu ren sol ver dan pe sti on ar el ma".split()
_SURE = "ad advert sponsored promo banner cookie-notice notice popup sidebar menu navbar breadcrumbs footer comments comment-list newsletter subscribe social login widget pagination copyright".split()
_HINTS = "share related discussion reply tags legal form side".split()
_FAINT = "share-price discussion-paper form-of-words side-effects comment-culture tag-game legal-history notice-period social-democracy menu-of-the-day".split()
_NEUTRAL = ["", "", "", "lead", "intro", "par", "figure-text", "quote", "c12", "has-media"]


class _Writer:
    def __init__(self, rng: np.random.Generator):
        self.rng = rng

    def pick(self, of):
        return of[self.rng.integers(len(of))]

    def words(self, low: int, high: int) -> str:
        n = int(self.rng.integers(low, high))
        return " ".join("".join(self.pick(_SYLLABLES) for _ in range(self.rng.integers(1, 4))) for _ in range(n))

    def sentence(self, low: int, high: int) -> str:
        return self.words(low, high).capitalize() + self.pick([".", ".", ".", "!", "?", ":"])

    def open(self, tag: str, name: str = "") -> str:
        return f"<{tag}>" if not name else f'<{tag} {self.pick(["class", "class", "id"])}="{name}">'

    def links(self, n: int, mark: str) -> str:
        """Items of a menu; some are the current page, a date or the like, without a link."""
        return "".join(f"<li>{mark}{self.words(1, 4)}</li>" if self.rng.random() < 0.2 else f'<li><a href="/x">{mark}{self.words(1, 4)}</a></li>' for _ in range(n))

    def boilerplate(self, name: str, inside: bool) -> str:
        """One piece: a list of links, a teaser or notice, a form, or what readers say."""
        kind, tag = self.rng.integers(4), self.pick(["div", "div", "section", "ul"] if name else ["nav", "aside", "footer", "form"])
        if kind == 0 or tag in ("ul", "nav"):
            body = f"<ul>{self.links(int(self.rng.integers(2, 8)), _MARK)}</ul>" if tag != "ul" else self.links(4, _MARK)
        elif kind == 1:
            body = f"<p>{_MARK}{self.sentence(4, 30)}</p>"
        elif kind == 2:
            body = f"<label>{_MARK}{self.words(1, 5)}</label><button>{_MARK}{self.words(1, 3)}</button>"
        else:
            body = f"<h3>{_MARK}{self.words(1, 4)}</h3>" + "".join(f"<p>{_MARK}{self.sentence(3, 40)}</p>" for _ in range(self.rng.integers(1, 4)))
        return self.open(tag, name) + body + f"</{tag}>"

    def content(self) -> str:
        kind = self.rng.integers(11)
        name = self.pick(_FAINT + _HINTS) if self.rng.random() < 0.12 else self.pick(_NEUTRAL)
        if kind == 0:
            return f"<h2>{self.words(1, 7).capitalize()}</h2>"
        if kind == 1:
            return "<ul>" + "".join(f"<li>{self.pick([self.words, self.sentence])(2, 12)}</li>" for _ in range(self.rng.integers(2, 6))) + "</ul>"
        if kind == 2:
            return f"<p>{self.words(1, 6)}</p>"
        if kind == 3:
            return self.open("blockquote", name) + self.sentence(5, 30) + "</blockquote>"
        if kind == 4:
            return self.open("section", name) + f"<h3>{self.words(1, 4)}</h3>" + "".join(f"<p>{self.sentence(8, 40)}</p>" for _ in range(self.rng.integers(1, 4))) + "</section>"
        if kind == 5:
            return self.open("div", name) + self.pick([self.words(1, 5), self.sentence(6, 30)]) + "</div>"
        if kind == 10:
            # A source or a list of references: nothing but links.
            return self.pick([f'<p><a href="/y">{self.words(1, 6)}</a></p>', "<ul>" + "".join(f'<li><a href="/y">{self.words(2, 9)}</a></li>' for _ in range(2)) + "</ul>"])
        if kind == 6:
            return f'<p><a href="/y">{self.words(1, 5)}</a> {self.sentence(8, 40)}</p>'
        return self.open("p", self.pick(_NEUTRAL)) + " ".join(self.sentence(5, 25) for _ in range(self.rng.integers(1, 5))) + "</p>"


def made_up_page(rng: np.random.Generator) -> str:
    """A page with boilerplate marked in its text."""
    w = _Writer(rng)
    around = lambda: w.boilerplate("" if rng.random() < 0.4 else w.pick(_SURE + _HINTS), False)
    within = lambda: w.boilerplate("" if rng.random() < 0.2 else w.pick(_SURE + (_HINTS if rng.random() < 0.5 else [])), True)
    parts = [f"<h1>{w.words(2, 9).capitalize()}</h1>"] + [within() if rng.random() < 0.12 else w.content() for _ in range(rng.integers(3, 14))]
    before = [around() for _ in range(rng.integers(0, 4))]
    if rng.random() < 0.5:
        before.insert(0, f"<header><div>{_MARK}{w.words(1, 6)}</div><p>{_MARK}{w.sentence(2, 12)}</p></header>")
    # A menu that nothing names.
    if rng.random() < 0.4:
        before.append(f"<div><ul>{w.links(6, _MARK)}</ul></div>")
    after = [around() for _ in range(rng.integers(0, 4))]
    start, end = w.pick([("<article>", "</article>"), ("<article>", "</article>"), ("<main>", "</main>"), ('<div class="post-content">', "</div>"), ('<div id="story">', "</div>"), ("<div>", "</div>")])
    return f"<html><body>{''.join(before)}{start}{''.join(parts)}{end}{''.join(after)}</body></html>"


def labelled(pages: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Features and labels of the blocks of made-up pages."""
    from .html_extract import blocks

    rng, rows, labels = np.random.default_rng(seed), [], []
    for _ in range(pages):
        found = blocks(made_up_page(rng))
        labels += [_MARK not in b.text for b in found]
        for b in found:
            b.text = b.text.replace(_MARK, "") or " "
        rows.append(features(found))
    return np.concatenate(rows), np.array(labels)


@lru_cache(1)
def weights() -> tuple[float, ...]:
    """The fitted weights; the same in every process."""
    return tuple(fit(*labelled(PAGES, 17)).tolist())
