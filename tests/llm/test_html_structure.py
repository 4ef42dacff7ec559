"""The choice of blocks against a plain version of its rules, threads of comments by structure, forms, hidden parts, linear time."""

import math
import random
import time

import pytest

from strideforge.llm import html_text as ht

A = "<p>" + "Word one, two three. And four; five six. " * 6 + "</p>"


def plain_ratios(paths, chars, marks, linked, weight):
    def means(x):
        return [sum(x[j] for j in range(len(x)) if paths[j] == p) / sum(q == p for q in paths) for p in paths]

    def smooth(x):
        k = {d: math.exp(-(d * d) / 2) for d in range(-2, 3)}
        return [sum(k[d] * x[i + d] for d in k if 0 <= i + d < len(x)) / sum(k[d] for d in k if 0 <= i + d < len(x)) for i in range(len(x))]

    c, li = means(chars), means(linked)
    d, m = smooth(c), smooth(means(marks))
    return means([d[i] * (0.2 + m[i]) * (1 - li[i] / max(1, c[i])) ** 2 * weight[i] for i in range(len(paths))])


def plain_blocks(page):
    """The rules one by one, each element looked up by climbing and each subtree by looking at all elements."""
    up = lambda e: [e] + (up(page.parent[e]) if e > 0 else [])
    n = len(page.name)
    below = lambda a, e: a in up(e)
    shown = [b for b, e in enumerate(page.element) if page.chars[b] and not page.cut[e]]
    total = sum(page.chars[b] for b in shown)

    def form_ok(e):
        forms = [x for x in up(e) if page.name[x] == "form"]
        if not forms:
            return True
        f = forms[-1]
        inside = sum(page.chars[b] for b in shown if below(f, page.element[b]))
        return inside >= ht.WIDE * total or any(page.name[x] in ("article", "main") and below(f, x) for x in range(n))

    usable = [b for b in shown if form_ok(page.element[b])]
    if not usable:
        return []

    def entry(e):
        some = [x for x in range(1, n) if page.parent[x] == page.parent[e] and page.kind[x] == page.kind[e]]

        def good(x):
            field = any(page.fields[y] for y in range(n) if below(x, y))
            said = any(below(x, page.element[b]) and any(c in ht.PUNCTUATION for t in page.texts[b] for c in t) for b in usable)
            return field and said and not any(page.name[y] in ("h1", "h2") for y in range(n) if below(x, y))

        return len(some) > 1 and all(map(good, some))

    entries = {e for e in range(1, n) if entry(e)}
    weight = [min(page.weight[e], ht.LOW) if any(x in entries for x in up(e)) else page.weight[e] for e in range(n)]
    el = [page.element[b] for b in usable]
    chars = [page.chars[b] for b in usable]
    marks = [sum(t.count(c) for t in page.texts[b] for c in ht.PUNCTUATION) for b in usable]
    linked = [page.linked[b] for b in usable]
    ratio = plain_ratios([page.path[e] for e in el], chars, marks, linked, [weight[e] for e in el])
    mean = sum(r * c for r, c in zip(ratio, chars)) / sum(chars)
    content = [r >= ht.SHARE * mean * (1 - 1e-12) for r in ratio]
    article = lambda e: next((x for x in up(e) if page.name[x] in ("article", "main")), 0)
    inside = [article(e) > 0 for e in el]
    mass = lambda keep: sum(c * weight[e] for c, e, k in zip(chars, el, keep) if k)
    if mass(inside) >= ht.MOST * mass([a or b for a, b in zip(content, inside)]):
        both = [a and b for a, b in zip(content, inside)]
        top = max((weight[e] for e, i in zip(el, inside) if i), default=None)
        content = both if any(both) else [i and weight[e] == top for e, i in zip(el, inside)]
    holder = lambda e: next(x for x in up(e) if page.name[x] not in ht.PARAGRAPHS)
    holds = {holder(e) for e, c in zip(el, content) if c}
    last = lambda a: max((i for i, (e, c) in enumerate(zip(el, content)) if c and below(a, e)), default=-1)
    out = []
    for i, (b, e) in enumerate(zip(usable, el)):
        near = next((x for x in up(e) if x == 0 or last(x) >= 0), 0)
        own = weight[e] == weight[near]
        few_links = linked[i] <= 0.5 * chars[i]
        if content[i] or (own and article(near) and last(article(near)) >= 0) or (own and holder(near) in holds and few_links) or (own and page.name[e] in ht.HEADINGS and last(near) > i and few_links):
            out.append(b)
    return out


def random_page(rng, depth=0):
    texts = ["Short", "A sentence, with marks. Another one; yes!", "<a href=x>link text here</a>", "word " * 20, "One, two. " * 9, "<span class=author>Ann</span> wrote, and so on.", "<time>May</time> Fine."]
    names = ["div", "div class=item", "p", "p", "ul", "li", "section", "article", "main", "h2", "blockquote", "form", "div class=comments", "header", "table", "div class='x author'", "nav", "p hidden"]
    out = ""
    for _ in range(rng.randrange(1, 5)):
        if depth < 4 and rng.random() < 0.65:
            name = rng.choice(names)
            inner = random_page(rng, depth + 1)
            out += f"<{name}>{inner}</{name.split()[0]}>" * (rng.choice([1, 1, 2]))
        else:
            out += rng.choice(texts)
    return out


def test_blocks_equal_the_plain_rules():
    rng = random.Random(4)
    chosen = 0
    for _ in range(700):
        page = ht.parse(random_page(rng))
        if len(page.name) > 70:
            continue
        found = ht.content_blocks(page)
        assert found == plain_blocks(page)
        chosen += bool(found) and len(found) < len(page.element)
    assert chosen > 150


@pytest.mark.parametrize("around", ["{}", "<article>{}</article>", "<form action=x><input type=hidden>{}<button>Go</button></form>", "<form><main>{}</main></form>"])
def test_page_wide_forms(around):
    got = ht.main_text(f"<body><div class=page>{around.format('<h1>Title</h1>' + A + A)}</div></body>")
    assert got.startswith("Title Word one") and got.count("And four") == 12 and "Go" not in got


def test_forms_beside_the_article_go():
    form = "<form><label>Your name, please. Your address, too.</label></form>"
    assert "please" not in ht.main_text(f"<div>{A}{A}</div>{form}") and "please" not in ht.main_text(f"<article>{A}{A}{form}</article>")


def test_hidden_inline_elements():
    got = ht.main_text(f"<article>{A}<p>Shown <span style='display: none'>secret <span>deep</span> more</span> on <i hidden>no</i><b aria-hidden=true>x</b> end <u style='display:none'>gone</p><p>Next, then.</p></article>")
    assert got.endswith("Shown on end Next, then.")


def test_formulas_stay():
    got = ht.main_text(f"<article>{A}<p>So <math><mi>x</mi><mo>=</mo><mn>2</mn><semantics><annotation encoding=tex>\\x</annotation></semantics></math> holds.</p></article>")
    assert got.endswith("So x=2 holds.")


@pytest.mark.parametrize("name", ["user-feedback", "reactions", "q7"])
@pytest.mark.parametrize("field", ["<span class=author>Ann</span>", "<time>3 May</time>", "<div class=post-date>3 May</div>"])
def test_threads_are_told_by_structure(name, field):
    entries = "".join(f"<div class=e>{field}<p>I liked it a lot, thanks. Good work, all of you, number {k}, really.</p></div>" for k in range(4))
    for page in (f"<div class=story>{A}{A}</div><div class={name}>{entries}</div>", f"<div class=story>{A}{A}<div class={name}>{entries}</div></div>", f"<article>{A}{A}</article><section id={name}>{entries}</section>"):
        got = ht.main_text(page)
        assert got.count("And four") == 12 and "liked" not in got
    assert ht.main_text(f"<div class={name}>{entries}</div>").count("liked") == 4  # all that there is


def test_nested_lists_and_quotes_take_linear_time():
    for make in (lambda n: "<ul><li>word, text." * n, lambda n: "<blockquote>word, text." * n, lambda n: "<span hidden>" * n + "x", lambda n: "<div class=a><time>x</time>b, c.</div>" * n, lambda n: "<form>a." * n):
        took = []
        for n in (2000, 16_000):
            page = make(n)
            began = time.process_time()
            ht.main_text(page)
            took.append(time.process_time() - began)
        assert took[1] < 24 * took[0] + 0.3, (make(2), took)
