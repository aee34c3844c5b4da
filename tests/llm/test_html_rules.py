"""Block rules of pages: what classes may say, comments as articles, what stands outside, and cost in nesting."""

import time

import pytest

from loomset.llm import htmltext

PROSE = "The price of the share rose on Monday after the board of the firm had said that it was to be sold to its founder."
MORE = "It was not the first time that this had been tried, and many of those who were there said so to us in the evening."


@pytest.mark.parametrize("name", ["article-widget", "share-price", "social-history", "menu-reform", "widget", "more-content", "shared-history promo-history"])
def test_prose_stays_whatever_its_class_may_mean(name):
    page = f'<article><div class="{name}"><h2>On it</h2><p>{PROSE}</p><p>{MORE}</p></div></article>'
    assert htmltext.main_text(page).endswith(f"{PROSE} {MORE}")


@pytest.mark.parametrize(
    "part",
    [
        '<article class="comment"><p>{}</p></article>',
        '<section id="responses"><article><p>{}</p></article></section>',
        '<div class="discussion"><p>{}</p></div>',
        '<div class="reader-feedback"><p>{}</p></div>',
        '<div class="teaser-list"><p>{}</p></div>',
        '<div class="more-stories"><p>{}</p></div>',
        '<div class="outbrain"><p>{}</p></div>',
        '<ul class="share"><li><a href=1>Share</a></li></ul>',
        '<div class="share-price"><a href=1>Quotes of today</a></div>',
    ],
)
def test_what_is_not_the_article_goes(part):
    article = f"<article><h1>Sold</h1><p>{PROSE}</p><p>{MORE}</p>"
    for page in (f"{article}</article>{part}", f"{article}{part}</article>", f"<main>{article}</article>{part}</main>"):
        assert htmltext.main_text(page.replace("{}", MORE.replace("It", "Reader"))) == f"Sold {PROSE} {MORE}", page


def test_sentences_outside_the_article():
    notice = "We use cookies to give you the best of the site, and you can say no to all of them."
    article = f"<p>{PROSE}</p><p>{MORE}</p>"
    for page in (f"<div>{notice}</div><article>{article}</article>", f"<article>{article}</article><div><p>{notice}</p></div>", f"<div>{notice}</div><div>{article}</div>"):
        assert htmltext.main_text(page) == f"{PROSE} {MORE}", page
    # an article element that holds less than the rest doesn't decide for it
    assert htmltext.main_text(f"<article><p>In short.</p></article><div>{article}</div>") == f"In short. {PROSE} {MORE}"


def test_the_first_article_is_not_judged_by_its_class():
    assert htmltext.main_text(f'<article class="related-story sponsored"><p>{PROSE}</p></article>') == PROSE


def test_short_blocks_of_doubtful_class_follow_their_neighbours():
    page = f'<article><div class="menu-reform"><p>{PROSE}</p><p>In short.</p><p>{MORE}</p></div></article>'
    assert htmltext.main_text(page) == f"{PROSE} In short. {MORE}"


@pytest.mark.parametrize("page", ["<div>" * 60_000 + "</p></b>" * 60_000, "<span hidden>" * 60_000 + "</b></span>" * 60_000, "<b hidden>x<div>" * 30_000 + "<span hidden>" * 30_000 + "</b>" * 60_000, "<p>a<p>b<li>" * 60_000, "<table><tr><td>x" * 40_000, "<!-- " * 60_000, '<a href="' * 60_000, "&amp;" * 200_000])
def test_cost_is_in_proportion(page):
    began = time.monotonic()
    htmltext.main_text(page)
    assert time.monotonic() - began < 8


def test_nested_elements_close_as_they_opened():
    inner = '<b class="ad">no<b>no</b>no<i>no</i></b>'
    assert htmltext.main_text(f"<article><p>one{inner}two</p></article>") == "onetwo"
    assert htmltext.main_text('<article><p>one<b class="ad">no<p>two</b>three') == "one twothree"
    assert htmltext.main_text("<article><div>a</section></b></div>b</article>c") == "a b"


def plain_second_pass(found, labels):
    """Nearest decided neighbours, looked up from each block for itself."""
    sizes = [len(b.text.split()) for b in found]
    out = []
    for i, label in enumerate(labels):
        sides = []
        for step in (-1, 1):
            j, far = i + step, 0
            while 0 <= j < len(found) and labels[j] == htmltext.OPEN:
                far, j = far + sizes[j], j + step
            if 0 <= j < len(found):
                sides.append((far, labels[j]))
        if label != htmltext.OPEN:
            out.append(label)
        elif not sides:
            out.append(htmltext.GOOD)
        else:
            near = min(far for far, _ in sides)
            nearest = {x for far, x in sides if far == near}
            out.append(nearest.pop() if len(nearest) == 1 else htmltext.GOOD)
    return out


def test_second_pass_against_a_plain_version():
    import random

    rng = random.Random(8)
    for _ in range(300):
        labels = [rng.choice([-1, -1, 0, 1]) for _ in range(rng.randint(0, 12))]
        found = [htmltext.Block(" ".join(["w"] * rng.randint(1, 3)), 0, htmltext.FREE, False, False) for _ in labels]
        assert htmltext.second_pass(found, labels) == plain_second_pass(found, labels)
