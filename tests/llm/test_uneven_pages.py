import math
import time

import numpy as np
import pytest

from strideforge.llm import html_text

LONG = "A long sentence with commas, points, and words; it goes on. " * 12
SHORT = "A short one, with a point."
PAGE = "<html><body><nav><ul><li><a href='/'>Home</a></li></ul></nav>{main}<footer><p>The owner, 2020.</p></footer></body></html>"


@pytest.mark.parametrize("main", [
    "<div class=post><h1>Title</h1><p>{s}</p><p>{l}</p><p>{s}</p></div>",
    "<div class=post><h1>Title</h1><p>{s}</p><blockquote>{l}</blockquote><p>{s}</p></div>",
    "<div class=post><h1>Title</h1><blockquote><p>{s}</p><p>{l}</p></blockquote><p>{s}</p></div>",
    "<div><h1>Title</h1><section><p>{s}</p></section><section><p>{l}</p></section><section><p>{s}</p></section></div>",
    "<h1>Title</h1><p>{s}</p><p>{l}</p><p>{s}</p>",
])
def test_uneven_text_without_article(main):
    page = PAGE.replace("{main}", main.format(s=SHORT, l=LONG))
    assert html_text.main_text(page) == f"Title {SHORT} {LONG}{SHORT}"


BODY = "This is a sentence, with some words; and it goes on. " * 4
TEXT = BODY.strip()


@pytest.mark.parametrize(
    "page, want",
    [
        (f"<div class='overflow-hidden'><h1>Title</h1><p>{BODY}</p><p>Short.</p></div>", f"Title {TEXT} Short."),
        (f"<div aria-hidden='false'><p>{BODY}</p></div><div aria-hidden='true'><p>{BODY}</p></div><p hidden>{BODY}</p>", TEXT),
        (f"<div class='elementor-widget elementor-widget-text-editor'><p>{BODY}</p></div>", TEXT),
        (f"<div class='side-by-side'><p>{BODY}</p></div>", TEXT),
        (f"<nav><a href=x>Home</a></nav><div><p>{BODY[:60]}</p></div><div><p>{BODY}</p><p>a, b.</p></div><footer>me</footer>", f"{BODY[:60].strip()} {TEXT} a, b."),
        ("<div>" * 500 + f"<p>one {BODY}</p>" + "</div>" * 500 + f"<p>two {BODY}</p>", f"one {TEXT} two {TEXT}"),
        (f"<p title=it's>{BODY}</p><p>Short, it's.</p>", f"{TEXT} Short, it's."),
        (f"<div class=comments><p>{BODY}</p></div>", TEXT),
        (f"<div class=post><h1>T</h1><p>{BODY}</p></div><div class=comments><p>{BODY * 3}</p></div><div id='cookie-notice'><p>{BODY}</p></div>", f"T {TEXT}"),
        (f"<p>{BODY}</p><a <b href='x'", TEXT),
        (f"<p>1 < 2 &lt; 3 &eacute;</p><!-- <p>no</p> --><!--><p>{BODY}</p>", f"1 < 2 < 3 é {TEXT}"),
    ],
)
def test_pages_of_other_makes(page, want):
    assert html_text.main_text(page) == want
    assert html_text.main_text(f"<html><head><title>x</title></head><body>{page}") == want


@pytest.mark.parametrize("part", ["<a ", '<a "', "<div>", "<p>a", "</x>", "<!--", "<title>", "<a =\"'", "<", "<a b='\">"])
def test_hostile_pages_take_linear_time(part):
    took = []
    for n in (100_000, 400_000):
        began = time.process_time()
        html_text.main_text(part * (n // len(part)))
        took.append(time.process_time() - began)
    assert took[1] < 10 * max(took[0], 0.02)


def test_ratios_equal_brute_force():
    rng = np.random.default_rng(4)
    for n in (1, 2, 7, 40):
        path, chars, marks = rng.integers(0, 5, n), rng.integers(1, 300, n).astype(float), rng.integers(0, 9, n).astype(float)
        linked, weight = np.minimum(chars, rng.integers(0, 50, n)), rng.choice([1.0, 0.1], n)
        mean = lambda x, p: sum(v for v, q in zip(x, path) if q == p) / sum(q == p for q in path)  # noqa: B023, E731
        k = [math.exp(-(d * d) / 2) for d in range(-2, 3)]

        def smoothed(x):
            out = []
            for i in range(n):
                near = [(k[d + 2], x[i + d]) for d in range(-2, 3) if 0 <= i + d < n]
                out.append(sum(a * b for a, b in near) / sum(a for a, _ in near))
            return out

        d, p = (smoothed([mean(x, q) for q in path]) for x in (chars, marks))
        fused = [a * (0.2 + b) * (1 - mean(linked, q) / max(1, mean(chars, q))) ** 2 * w for a, b, q, w in zip(d, p, path, weight)]
        assert np.allclose(html_text.fused_ratios(path, chars, marks, linked, weight), [mean(fused, q) for q in path])
