import random
import re
import time

import pytest

from lodestone.llm import html_text
from lodestone.llm.html_text import main_text, regions

LONG = ("A sentence that is long enough to be an article of its own kind. " * 8).strip()


def test_names_that_only_hold_a_mark_are_text():
    page = f'<div>{LONG}</div><p class="share-price">The share rose by three points today.</p><div class="search-results">Nine results were found in the end.</div>'
    assert main_text(page) == f"{LONG}\nThe share rose by three points today.\nNine results were found in the end."
    assert main_text(f'<div class="content related"><p>{LONG}</p></div>') == LONG


@pytest.mark.parametrize("name", ["ad", "ad-1", "cookie-notice", "site-header", "newsletter-signup", "related-posts", "post-comments", "social-share"])
def test_names_that_are_marks_are_removed(name):
    assert main_text(f'<p>{LONG}</p><div class="{name}">Some words that stand beside the text here.</div><p>The end.</p>') == f"{LONG}\nThe end."


def test_a_short_closing_paragraph_stays_after_adverts():
    adverts = "".join(f'<div><a href="/{i}">Buy number {i} now</a></div>' for i in range(3))
    tail = "And so the story ended for all of them."
    assert main_text(f"<div><p>{LONG}</p>{adverts}<p>{tail}</p></div>") == f"{LONG}\n{tail}"


def test_teasers_do_not_beat_the_text():
    teasers = "".join(f"<article><h2><a href=/{i}>Teaser {i}</a></h2><p>A few words on it.</p></article>" for i in range(2))
    assert main_text(f"{teasers}<div><h1>Title</h1><p>{LONG}</p><p>{LONG}</p></div>") == f"Title\n{LONG}\n{LONG}"
    assert main_text(f"<main>{teasers}<div><p>{LONG}</p></div></main>") == LONG


def test_article_is_no_switch():
    page = f"<article><p>Short.</p><ul><li><a href=a>A link</a></li></ul><p>{LONG}</p></article><div>Outside of it.</div>"
    assert main_text(page) == f"Short.\nA link\n{LONG}"


def test_nesting_costs_no_more_than_its_length():
    began = time.monotonic()
    assert main_text("<div>x" * 200_000).count("x") == 200_000
    assert main_text("<section><p>y</section></div></nav>" * 50_000).count("y") == 50_000
    assert time.monotonic() - began < 30


def brute_regions(weights, window, surge):
    """Kept line numbers, straight from the definition of the points."""
    n = len(weights)
    total = lambda i: sum(weights[j] for j in range(i, min(i + window, n)))
    least = min(surge, max(map(total, range(n)), default=0) / 2)
    kept, i = set(), 0
    while i < n:
        if total(i) > 0 and total(i) >= least:
            dive = next((j for j in range(i + 1, n) if total(j) == 0), n)
            kept |= set(range(i, dive))
            j = i - 1
            while j >= 0 and weights[j] > 0 and j not in kept:
                kept.add(j)
                j -= 1
            i = dive
        else:
            i += 1
    return kept


def test_points_against_brute_force():
    rng = random.Random(5)
    for _ in range(3000):
        weights = [rng.choice([0, 0, 0, 5, 20, 60, 300]) for _ in range(rng.randint(0, 25))]
        window, surge = rng.randint(1, 4), rng.choice([1, 40, 80, 500])
        assert {i for a, b in regions(weights, window, surge) for i in range(a, b)} == brute_regions(weights, window, surge), weights


def test_pages_without_article_tags_give_the_same_text():
    import pyarrow.parquet as pq

    for page in pq.read_table("/root/testdata/sf0.01/pages.parquet", columns=["html"]).column(0).to_pylist():
        assert main_text(re.sub("</?article>", "", page)) == main_text(page)
        own = [x for x in html_text.lines(page) if not x.dropped]
        kept = brute_regions([x.weight for x in own], html_text.WINDOW, html_text.SURGE)
        assert main_text(page) == "\n".join(own[i].text for i in sorted(kept))
