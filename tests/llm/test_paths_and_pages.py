"""Language paths against a plain program over all switches; pages whose layout classes name what they lack; hostile pages in time."""

from __future__ import annotations

import time

import numpy as np
import pytest

from lectern.llm.html_main import Page, main_texts
from lectern.llm.langid import SWITCH, best_path


def value_of(scores, path, switch):
    return sum(scores[i][k] for i, k in enumerate(path)) - switch * sum(a != b for a, b in zip(path, path[1:], strict=False))


def best_value(scores, switch):
    total = list(scores[0])
    for row in scores[1:]:
        total = [x + max(t - (j != k) * switch for j, t in enumerate(total)) for k, x in enumerate(row)]
    return max(total)


def test_best_path_over_other_languages():
    assert best_path(np.array([[0, 10, -100], [0, -100, 10]], np.float32), 12).tolist() == [1, 2]


def test_best_path_is_best_with_the_default_penalty():
    rng = np.random.default_rng(3)
    for _ in range(5000):
        n, k = int(rng.integers(1, 30)), int(rng.integers(1, 6))
        scores = (rng.standard_normal((n, k)) * rng.choice([1, 4, 12])).astype(np.float32)
        scores -= scores.max(1, keepdims=True)
        assert abs(value_of(scores.tolist(), best_path(scores).tolist(), SWITCH) - best_value(scores.tolist(), SWITCH)) < 1e-2


def test_best_path_ties():
    """Equal languages: the first; equal paths: the language of the word before stays."""
    assert best_path(np.zeros((4, 3), np.float32)).tolist() == [0, 0, 0, 0]
    assert best_path(np.array([[0, -9], [-9, 0]], np.float32), 9).tolist() == [0, 0]


LAYOUTS = ["layout menu-open", "page-with-sidebar", "no-sidebar", "has-sidebar", "post-with-comments", "no-share", "col-ad-free", "search-results", "banner-less", "content-sidebar-wrap", "sidebar", "comments"]


@pytest.mark.parametrize("name", LAYOUTS)
@pytest.mark.parametrize("inner", ["<main><p>x y</p></main>", "<article><p>x y</p></article>", "<p>x y</p>"])
def test_no_layout_class_loses_the_article(name, inner):
    for kind in ("class", "id"):
        assert Page(f'<body><nav>a b c d</nav><div {kind}="{name}">{inner}</div><footer>f</footer></body>').main_text() == "x y"


def test_wrapping_forms_and_marks_beside_the_article(spark):
    assert Page('<form id="all"><div><p>the whole text of the page</p></div></form>').main_text() == "the whole text of the page"
    assert Page("<p>a text that is long enough to be the page</p><form>Name <input></form>").main_text() == "a text that is long enough to be the page"
    for mark in ("sidebar", "site-footer", "cookie-notice", "main-nav", "comments", "ad top"):
        assert Page(f'<div><p>the text is here and long enough</p></div><div class="{mark}"><p>other</p></div>').main_text() == "the text is here and long enough"
    assert Page('<div class="comments"><p>very many words by readers of the page</p></div><article><p>short</p></article>').main_text() == "short"
    rows = spark.createDataFrame([(i, f"http://h{i}.com/", f'<div class="{c}"><article><p>x</p></article></div>') for i, c in enumerate(LAYOUTS)], "page_id long, url string, html string")
    assert {r["text"] for r in main_texts(rows).collect()} == {"x"}


@pytest.mark.parametrize("source", ["<a " * 350_000, "<div>" * 100_000 + "</x>" * 125_000, "</x>" * 260_000, "<!--" * 260_000, "<span>" * 90_000 + "<p>" * 90_000, '<a "' * 260_000 + ">"])
def test_hostile_pages_of_a_megabyte(source):
    began = time.process_time()
    page = Page(source)
    page.main_text()
    page.keyed("host")
    assert time.process_time() - began < 20


def test_unfinished_comments_and_tags():
    assert Page("x <p>a</p> <!-- unclosed <b>d</b>").main_text() == "x a"
    assert Page("<!-- a > b <p>c").main_text() == ""
    assert Page("a<!-- b --> c <b").main_text() == "a c <b"
    assert Page("a <!-- never closed").main_text() == "a"
