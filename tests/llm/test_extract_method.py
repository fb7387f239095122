"""Extraction where words and links of a block and its neighbours decide."""

import time

import pytest

from leafspark.llm import extract

L = "The old bridge was opened in spring after two years of slow and careful work by the people of the town."


@pytest.mark.parametrize(("page", "wanted"), [
    (f"<article><p>{L}</p></article><nav><a href='/'>Home</a> <a href='/b'>Blog</a></nav>", L),
    (f"<div class='post'><p>{L}</p></div><div class='related'><a href='/x'>More</a></div>", L),
    (f"<main><h1>Title</h1><p>{L}<p>{L}</main><footer><a href='/'>home</a></footer>", f"Title\n\n{L}\n\n{L}"),
    (f"<article><p>{L}</p><p><a href='/x'>Read more here</a></p><p>{L}</p></article>", f"{L}\n\n{L}"),
    (f"<article class='comment-free'><p>{L}</p></article>", L), (f"<div class='main-content has-sidebar'><p>{L}</p></div>", L),
    (f"<body><ul><li><a href='/'>Home</a><li><a href='/n'>News</a></ul><p>{L}</p><p>{L}</p><ul><li><a href='/'>Home</a><li><a href='/n'>News</a></ul>", f"{L}\n\n{L}"),
])
def test_articles_beside_links(page, wanted):
    assert extract.main_text(page)[0] == wanted


def test_words_and_links_change_the_result():
    """The same containers: only the text and its links differ."""
    page = lambda block: f"<div><p>{block}</p></div><div><p>{L}</p></div>"
    assert extract.main_text(page(L))[1] == 2
    assert extract.main_text(page(f"<a href='/'>{L}</a>"))[1] == 1
    inside = lambda block: f"<article><p>{L}</p><p>{block}</p><p>{L}</p></article>"
    assert extract.main_text(inside("short words"))[1] == 3
    assert extract.main_text(inside("<a href='/'>short words</a>"))[1] == 2


def test_the_tree_uses_several_features():
    def used(tree):
        return set() if len(tree) == 1 else {extract.FEATURES[tree[0]]} | used(tree[2]) | used(tree[3])

    assert len(used(extract.default_tree()) & {"words", "before", "after", "links", "links_before", "links_after"}) >= 3


def test_deep_pages_with_stray_tags_are_linear():
    began = time.thread_time()
    extract.main_text("<div>" * 30_000 + "</section><li>x" * 30_000)
    assert time.thread_time() - began < 20


def test_clashing_columns(spark):
    rows = [(1, "u", f"<article>{L}</article>", "t", 5, "r"), (1, "u", f"<article>{L}</article>", "t", 5, "r")]
    got = extract.extract_pages(spark.createDataFrame(rows, "page_id long, url string, html string, text string, n_chars long, _r string")).collect()
    assert [(r.text, r.n_chars) for r in got] == [(L, len(L))] * 2
