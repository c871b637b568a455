"""What a left-out element of a page takes with it, and what it does not."""

import pytest

from tallywatch.llm.page_diff import page_lines


@pytest.mark.parametrize(
    "left_out",
    [
        '<img class="share-icon" src=x>',
        "<img aria-hidden=true>",
        "<hr class=ad>",
        "<input hidden>",
        "<p class=notice>gone",
        "<ul><li class=social>gone</ul>",
        "<table><tr><td class=sidebar>gone</table>",
        "<div><div class=ad>gone</div></div>",
        "<section><div class=ad>gone<div>gone</section>",
        "<dl><dt class=promo>gone</dl>",
        "<div><span hidden>gone</div>",
        "<form>gone<form>gone</form>",
    ],
)
def test_what_follows_stays(left_out):
    assert page_lines(f"<article><p>one{left_out}<p>two</p></article>") == (["one", "two"], True)
    assert page_lines(f"{left_out}<article><p>one<p>two</article>") == (["one", "two"], True)


def test_siblings_end_a_skip():
    assert page_lines("<p class=notice>gone<p>a<p>b") == (["a", "b"], False)
    assert page_lines("<ul><li class=social>gone<ul><li>gone</ul><li>a<li>b</ul>c")[0] == ["a", "b", "c"]
    assert page_lines("<table><tr><td class=sidebar>gone<td>a<tr><td>b</table>")[0] == ["a", "b"]
    assert page_lines("<table><tr hidden><td>gone<tr><td>b</table>")[0] == ["b"]


@pytest.mark.parametrize("name", ["content no-sidebar", "content sidebar", "has-comments", "notice"])
def test_wrappers_keep_their_article(name):
    page = f"<body><div class='{name}'><h2>x</h2><article><p>one</p></article></div><div>after</div>"
    assert page_lines(page) == (["one"], True)


def test_whole_names_of_containers():
    page = (
        '<article><h2 id="social-impact">Social</h2><section id="comments-on-x"><p>one</p></section>'
        '<p><span class="token comment">two</span></p><h3 class=related>three</h3>'
        '<div class="site-footer">gone</div><div id=comments>gone</div></article>'
    )
    assert page_lines(page)[0] == ["Social", "one", "two", "three"]
    assert page_lines('<div class="content no-sidebar"><p>one</div>')[0] == ["one"]


def test_articles_of_others_stay_out():
    page = (
        "<main><article>one<div class=comments><article>gone</article></div></article>"
        "<div class=related><article>gone</article></div><p>two</main>"
    )
    assert page_lines(page)[0] == ["one", "two"]
    assert page_lines("<aside><article>gone</article></aside><p>a")[0] == ["a"]
    assert page_lines("<p hidden>gone<article>a</article>")[0] == ["a"]
