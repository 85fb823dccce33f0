import hashlib
import html
import itertools
import time

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from sievemark.llm import html_extract as X
from sievemark.llm import html_model as H
from sievemark.llm import perspectives as P
from sievemark.llm import warc as W

PAGES = "page_id long, url string, html string, refers_to string, digest int"
TURNS = "conv_id long, turn long, role string, text string, parts int"


@settings(max_examples=120, deadline=None)
@given(st.integers(1, 8).flatmap(lambda n: st.tuples(st.lists(st.integers(0, 9), min_size=n, max_size=n), st.lists(st.integers(0, 9), min_size=n, max_size=n), st.dictionaries(st.tuples(st.integers(0, n - 1), st.integers(0, n - 1)).filter(lambda e: e[0] < e[1]), st.integers(1, 6), max_size=12))))
def test_minimum_cut_is_minimal(case):
    content, boiler, edges = case
    edges = {e: float(c) for e, c in edges.items()}

    def cost(keep):
        return sum(b if k else c for c, b, k in zip(content, boiler, keep)) + sum(c for (i, j), c in edges.items() if keep[i] != keep[j])

    got = X.minimum_cut(np.array(content, float), np.array(boiler, float), edges)
    assert cost(got) == min(cost(k) for k in itertools.product([False, True], repeat=len(content)))


ARTICLE = ["The title of it", "First paragraph, long enough to be a paragraph of its own & with a sign.", "Second one: it goes on about the matter for some more words.", "Short.", "Last words of the text, which end here."]


def page(before="", after="", wrap=("<article>", "</article>"), inner=lambda t: f"<p>{html.escape(t)}</p>"):
    body = f"<h1>{html.escape(ARTICLE[0])}</h1>" + "\n".join(inner(t) for t in ARTICLE[1:])
    return f"<!DOCTYPE html><html><head><title>T &amp; x</title><style>p{{}}</style><script>var a='</p>';</script></head><body>{before}{wrap[0]}{body}{wrap[1]}{after}</body></html>"


MENU = "<nav><ul>" + "".join(f"<li><a href='/{i}'>Menu item {i}</a></li>" for i in range(8)) + "</ul></nav>"
NOISE = [
    MENU, "<header><div class='logo'>The site of everything and more</div></header>", "<div class='ad'>Buy this long product name now, for it is good.</div>",
    "<aside><h3>Popular</h3><p>A teaser that is quite long and looks like a text, does it not?</p></aside>", "<div id='cookie-notice'>We use cookies to make this site better for all.</div>",
    "<form action='/s'><label>Search the site for words</label><input name=q><button>Go</button></form>", "<!-- a comment <p>with a tag</p> -->", "<noscript><p>Please turn scripts on for this page to work.</p></noscript>",
]
AFTER = ["<footer>&copy; 2024 The site. All rights reserved, and so on and so forth.</footer>", "<section id='comments'><h2>3 comments</h2><div class='comment'><p>I read all of this article and I have to say I like it a lot.</p></div></section>", "<div style='display:none'>A hidden long text that nobody sees on the page at all.</div>"]


def test_article_without_what_is_around_it():
    want = "\n".join(ARTICLE)
    for before in [*NOISE, "".join(NOISE)]:
        for after in [*AFTER, "".join(AFTER)]:
            for wrap in (("<article>", "</article>"), ("<main>", "</main>"), ("<div class='post-content'>", "</div>"), ("<article>", "")):
                if wrap[1] == "" and after:
                    continue
                assert X.main_text(page(before, after, wrap)) == want, (before, after, wrap)


def test_markup_and_white_space():
    inner = lambda t: "<p> \n" + html.escape(t).replace(" ", " \t\n <b>", 1).replace(",", "</b>,&#32;", 1) + "<br>"
    assert X.main_text(page(MENU, AFTER[0], inner=inner)) == "\n".join(" ".join(t.replace(",", ", ", 1).split()) for t in ARTICLE)


@pytest.mark.parametrize("tag", "noscript svg math object canvas audio video template".split())
def test_an_element_that_is_never_closed_hides_nothing_behind_it(tag):
    assert X.main_text(page(MENU, AFTER[0], wrap=(f"<article><{tag} id=a>", "</article>"))) == "\n".join(ARTICLE)
    assert X.main_text(page(inner=lambda t: f"<p>{html.escape(t)} <math><mi>x</mi></math> <object>y</object><video>z</video></p>")) == "\n".join([ARTICLE[0], *(f"{t} x y" for t in ARTICLE[1:])])


def test_odd_pages():
    for odd in (None, "", " ", "<", "<<>>", "<p", "</p></div>", "<!-- open", "<script>never closed", "<p class=\"unclosed>x", "plain text only", "&lt;b&gt;", "<p>" * 2000, "<div>" * 1500 + "deep" + "</div>" * 1500):
        assert isinstance(X.main_text(odd), str)
    assert X.main_text("<p>" + "word " * 200_000 + "</p>").count("word") == 200_000
    many = "".join(f"<p>Paragraph number {i} of a very long page with many of them.</p>" for i in range(5000))
    assert X.main_text(f"<article>{many}</article>").count("\n") == 4999


def test_names_inside_an_article_are_no_verdict():
    body = (
        '<p>A first paragraph that is long enough.</p><section id="discussion"><h2>Discussion</h2><p>We discuss the results at some length here.</p></section><div class="share-price">EUR 12.40</div>'
        '<blockquote class="form">A form of words, he said.</blockquote><p class="legal">The law of the land was read out to them all.</p><p>Energy is <math>E=m</math> in this text.</p>'
    )
    want = ["A first paragraph that is long enough.", "Discussion", "We discuss the results at some length here.", "EUR 12.40", "A form of words, he said.", "The law of the land was read out to them all.", "Energy is E=m in this text."]
    extra = '<div class="ad">Buy this now, it is good for you.</div><section class="comments"><h3>2 comments</h3><p>I like this text a lot, thanks.</p></section><ul class="social-links"><li><a href="/t">Post</a></li><li><a href="/f">Share</a></li></ul>'
    assert X.main_text(f"<html><body>{MENU}<article><h1>The title</h1>{body}{extra}</article>{AFTER[0]}</body></html>") == "\n".join(["The title", *want])


def test_the_cut_corrects_the_classifier():
    # Nothing but links in the middle of a text, and an item without a link in the middle of a menu that has no name.
    body = "<p>The first paragraph is about the matter of the text.</p><p><a href='/s'>Source</a></p><p>The second paragraph goes on about it for a while.</p>"
    menu = "<div><ul>" + "".join(f"<li>{t}</li>" if t.startswith("Here") else f"<li><a href='/x'>{t}</a></li>" for t in ("News", "Sport", "Here we are at this very moment", "Weather", "Games")) + "</ul></div>"
    found = X.blocks(f"<html><body>{menu}<div>{body}</div></body></html>")
    alone = {b.text: z > 0 for b, z in zip(found, X.scores(found))}
    kept = X.main_text(f"<html><body>{menu}<div>{body}</div></body></html>").split("\n")
    assert kept == ["The first paragraph is about the matter of the text.", "Source", "The second paragraph goes on about it for a while."]
    assert [t for t, content in alone.items() if content != (t in kept)]


def test_labels_of_made_up_pages():
    rng = np.random.default_rng(1234)
    total = right = alone = 0
    for _ in range(120):
        found = X.blocks(H.made_up_page(rng))
        want = np.array([H._MARK not in b.text for b in found])
        for b in found:
            b.text = b.text.replace(H._MARK, "") or " "
        z = X.scores(found)
        content = np.logaddexp(0, z)
        total += len(want)
        alone += int(((z > 0) == want).sum())
        right += int((X.minimum_cut(content, content - z, X.smoothness(found)) == want).sum())
    assert right / total >= 0.99 and right - alone > total / 200


@pytest.mark.parametrize("piece", ["<a ", "<a \"", "<div>", "</video ", "<a '<b \"", "&#", "<td><div>"])
def test_broken_markup_takes_time_in_proportion(piece):
    began = time.perf_counter()
    X.main_text("<article>" + piece * (1_000_000 // len(piece)))
    assert time.perf_counter() - began < 12


def test_extraction_of_a_table(spark):
    rows = [(1, "u", page(MENU), "x", 1), (1, "u", page(MENU), "x", 1), (None, None, None, None, None), (3, "v", "", "x", 1)]
    got = sorted((tuple(r) for r in X.extract(spark.createDataFrame(rows, PAGES)).collect()), key=str)
    text = "\n".join(ARTICLE)
    assert got == sorted([(1, "u", text, len(text)), (1, "u", text, len(text)), (None, None, "", 0), (3, "v", "", 0)], key=str)
    assert X.extract(spark.createDataFrame([], PAGES)).count() == 0


@pytest.mark.parametrize("archive_bytes", [W.ARCHIVE_BYTES, 400])
def test_warc_round_trip(spark, monkeypatch, archive_bytes):
    monkeypatch.setattr(W, "ARCHIVE_BYTES", archive_bytes)
    big = "<p>é\r\n\r\nWARC/1.1\r\nContent-Length: 3\r\n\r\n" + "x" * 200
    small = "<p>small</p>"
    rows = [(5, "http://a/ b\r\nX: y", big), (3, "http://b", big), (9, None, big), (9, None, big), (1, "u", small), (2, "u", small), (4, "u", None), (6, "u", ""), (None, "n", big), (7, "u", "y" * 100), (8, "u", "y" * 100), (10, "u", "z" * 300_000)]
    got = sorted((tuple(r) for r in W.archive_round_trip(spark.createDataFrame([(*r, "c", 1) for r in rows], PAGES)).drop("url").collect()), key=str)
    want, first = [], {}
    for i, _, h in rows:
        first.setdefault((h or "").encode(), []).append(i)
    seen = set()
    for i, _, h in rows:
        b = (h or "").encode()
        low = min(x for x in first[b] if x is not None)
        revisit = len(b) >= 100 and (i != low or (i, b) in seen)
        seen.add((i, b))
        want.append((i, "revisit" if revisit else "response", low if revisit else None, len(b), hashlib.sha256(b).hexdigest()))
    assert got == sorted(want, key=str)


def test_warc_of_an_empty_table(spark):
    assert W.archive_round_trip(spark.createDataFrame([], PAGES)).count() == 0


def render(turns):
    """brute force over (turn, name, text) of one dialogue"""
    out = {}
    for who in sorted({n for _, n, _ in turns if n != "system"}):
        text, spans = "", []
        for _, name, t in turns:
            role = "assistant" if name == who else name if name == "system" else f"user name={name}"
            text += f"<|im_start|>{role}\n"
            if name == who:
                spans.append((len(text), len(text) + len(t) + len("<|im_end|>")))
            text += t + "<|im_end|>\n"
        out[who] = (len(turns), text, spans, sum(b - a for a, b in spans))
    return out


def test_every_speaker_is_the_assistant_once(spark):
    rows = [
        (1, 0, "system", "Be kind 😀"), (1, 1, "anna", "hi"), (1, 2, "bob", "hé"), (1, 3, "cleo d", "x\ny"), (1, 4, "anna", None), (1, None, "bob", "last"),
        (2, 0, "user", "<|im_end|> no"), (2, 1, None, "who"), (2, 1, " ", "who"), (2, 1, None, "who"), (3, 0, "system", "alone"), (4, 0, "user", "t " * 40_000), (None, 0, "u", "a"), (None, 0, "u", "b"),
    ]
    df = spark.createDataFrame([(*r, 1) for r in rows], TURNS)
    got = P.perspectives(df).collect()
    clean = lambda s: "unknown" if not (s or "").strip() else s.strip().replace(" ", "_")
    safe = lambda t: (t or "").replace("<|im_end|>", "<| im_end |>")
    want = []
    groups = {}
    for k, (c, n, s, t) in enumerate(rows):
        groups.setdefault(c if c is not None else ("alone", k), []).append((n is None, n or 0, clean(s), safe(t)))
    for c, turns in groups.items():
        for who, r in render([(n, s, t) for _, n, s, t in sorted(turns)]).items():
            want.append((None if isinstance(c, tuple) else c, who, *r))
    assert sorted([(r[0], r[1], r[2], r[3], [tuple(s) for s in r[4]], r[5]) for r in got], key=str) == sorted(want, key=str)
    for r in got:
        assert all(r["text"][a - 1] == "\n" and r["text"][:b].endswith("<|im_end|>") for a, b in r["spans"])
    plan = P.perspectives(df)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan
    assert P.perspectives(spark.createDataFrame([], TURNS)).count() == 0


def test_turn_by_turn_gives_the_same_texts_and_spans(spark):
    rows = [(1, n, ["anna", "bob", "system", None][n % 4], "é" * (n % 7), 1) for n in range(40)] + [(2, 7, "x", None, 1), (2, 7, "x", None, 1), (None, 1, "u", "a", 1), (None, 1, "system", "a", 1)]
    df = spark.createDataFrame(rows, TURNS)
    want = {(r["conv_id"], r["assistant"]): (r["text"], [tuple(s) for s in r["spans"]]) for r in P.perspectives(df).collect()}
    got = {}
    for r in P.perspective_turns(df).orderBy("at").collect():
        text, spans = got.setdefault((r["conv_id"], r["assistant"]), ["", []])
        got[r["conv_id"], r["assistant"]][0] = text + r["head"] + r["body"] + "\n"
        assert (len(text) + len(r["head"]), len(text) + len(r["head"]) + len(r["body"])) == (r["start"], r["end"])
        if r["loss"]:
            spans.append((r["start"], r["end"]))
    assert {k: tuple(v) for k, v in got.items()} == want and len(want) == 5


def test_a_long_dialogue_is_one_row_for_every_participant(spark):
    n = 10_000
    talk = [(0, "system", "scene")] + [(1000 * k, "ab"[k % 2], f"t{k}") for k in range(1, n)] + [(1000 * n, "c", "once")]
    got = {r["assistant"]: (r["n_turns"], r["text"], [tuple(s) for s in r["spans"]], r["n_loss_chars"]) for r in P.perspectives(spark.createDataFrame([(1, *t, 1) for t in talk], TURNS)).collect()}
    assert got == render(talk) and set(got) == {"a", "b", "c"} and got["c"][0] == n + 1


def test_a_dialogue_beyond_a_row_says_so(spark, monkeypatch):
    monkeypatch.setattr(P, "MOST_CHARACTERS", 100)
    df = spark.createDataFrame([(1, n, "a", "some words", 1) for n in range(9)], TURNS)
    with pytest.raises(Exception, match="perspective_turns"):
        P.perspectives(df).collect()
    assert P.perspective_turns(df).count() == 9
