"""Main text of web pages by tag-path ratios.

A page is read once as tags and texts. Texts between two block tags form a block, which belongs to the path of block elements
from the root (inline elements are left out of the path). Per path the page's blocks are aggregated: characters, punctuation
marks, blocks, characters inside links. Two ratios, characters per block and punctuation per block, are smoothed over the
blocks in page order with a Gaussian window, fused by their product, lowered by the share of link characters and by a weight
for elements whose class or id names another part of a page; paths whose fused mean reaches a share of the page's mean are
content paths. The text is made of the blocks on content paths, and of the lesser blocks that belong to them: those beside them in
an element that holds content blocks itself or in an article or main element, and headings above them. Where article and
main elements hold most of the weighted content, only what is inside them counts.

Reader comments and the like are told by their structure, whatever their class: siblings of one kind, two or more, each of which holds
the name of an author or a date (``FIELDS``, ``time``) and text with punctuation but no main heading, are a thread; so named parts
and threads get the same low weight, so a page that is a thread keeps it.

Never content are scripts, styles, forms (but for one around an article or main element or ``WIDE`` of the page's text), navigation, asides, footers, hidden elements and the roles that name such parts. A
class or id counts only as a whole word (``comments``, ``cookie-notice``, ``related-posts``), as a weight: it can push a part
under the threshold, but where all that a page holds is so named, it is still found.

Character references are decoded, white space inside a block becomes one space, blocks are joined by one space in page
order. Null html counts as empty; a page without text gives the empty string, an empty table no rows; of ties all paths are
taken. Unclosed and misplaced tags are closed as HTML does for paragraphs and list items; a tag or comment that never ends
swallows the rest of the page. Pages are rows of their own: repeated rows and null ids are read alike. Other columns are
ignored. Pages of any length and depth are read whole, in time linear in the length.
"""

import html as entities
import re

from pyspark.sql import functions as F

from strideforge.llm.common import slices, table

# Fixed sets of element names and roles.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template textarea title svg iframe object canvas select annotation annotation-xml".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr "
    "math mi mn mo ms mtext mspace mrow mfrac msqrt mroot mstyle merror mpadded mphantom menclose msub msup msubsup munder mover munderover mmultiscripts mtable mtr mtd semantics".split()
)
CUT = frozenset("nav aside footer button dialog menu head select fieldset".split())
CUT_ROLES = frozenset("navigation complementary contentinfo search dialog alertdialog menu menubar".split())
#: Elements that end an open paragraph, and what each closes of its own kind.
CLOSES = {
    "li": {"li", "p"}, "dt": {"dt", "dd", "p"}, "dd": {"dt", "dd", "p"}, "tr": {"tr", "td", "th", "p"}, "td": {"td", "th", "p"},
    "th": {"td", "th", "p"}, "option": {"option"},
}
BLOCKS = frozenset(
    "address article aside blockquote body center details dialog dd div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Elements that are one block of a text, or a part of a list or table: what holds a content block is the element around them.
PARAGRAPHS = HEADINGS | frozenset("p pre blockquote hgroup header li ul ol dl dt dd figure figcaption address summary table thead tbody tfoot tr td th".split())
#: Words of a class or id that name what is not the article, and words that say nothing beside them.
OTHER_PARTS = frozenset(
    "ad ads advert adverts advertisement sponsor sponsored promo promotion banner cookie cookies consent notice alert popup modal newsletter subscribe signup paywall nav navbar navigation menu breadcrumb breadcrumbs pagination pager sidebar aside related recommended recommendations share sharing social comment comments disqus reply replies respond footer masthead topbar toolbar login search legal copyright".split()
)
PLAIN = frozenset(
    "area bar block body bottom box btn button buttons container content footer form global header icon icons inner item items left link links list main message outer page panel post posts primary right section site text thread title top widget wrap wrapper".split()
)
#: Words of a class or id (and the element time) that name the author or the date of what they stand in.
FIELDS = frozenset("author byline user username nickname avatar commenter date datetime posted published timestamp time ago".split())
#: The weight of an element that a class or id so names, or that is one of a thread of entries with authors or dates.
LOW = 0.002
#: Share of a page's characters that makes a form the page itself.
WIDE = 0.8
PUNCTUATION = ".,;:!?"
#: Share of the mean fused ratio that a content path needs, and of the content that makes article and main elements the page's text.
SHARE, MOST = 0.3, 0.5


TAG = re.compile(r"(/?)([A-Za-z][^\s/>]*)((?>[^>=]+|=\s*+(?>\"[^\"]*+\"|'[^']*+'|[^\s>\"'][^\s>]*+)?+)*+)>")
ATTRIBUTE = re.compile(r"([^\s\"'>/=][^\s>/=]*)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>\"'][^\s>]*)))?")
COMMENT = re.compile(r"!--(?:-?>|.*?--!?>)", re.S)


def named_otherwise(words):
    """Whether one of the words of a class or id, as a whole, names another part of a page."""
    for w in words:
        parts = [x for x in re.split(r"[-_]+", w) if x]
        if any(x in OTHER_PARTS for x in parts) and all(x in OTHER_PARTS or x in PLAIN for x in parts):
            return True
    return False


def is_hidden(own):
    """Whether an element's attributes keep it from being shown."""
    style = own.get("style", "").lower().replace(" ", "")
    return "hidden" in own or own.get("aria-hidden", "").lower() == "true" or "display:none" in style or "visibility:hidden" in style


def has_field(name, words):
    return name == "time" or any(x in FIELDS for w in words for x in re.split(r"[-_]+", w))


class Page:
    """Elements and blocks of a page, in page order."""

    def __init__(self):
        #: By element: name, number of the parent, path, whether it is cut, weight.
        self.name, self.parent, self.path, self.cut, self.weight = ["#"], [-1], [0], [False], [1.0]
        #: The innermost element around it, itself included, that is no paragraph; the outermost form; its kind; fields inside.
        self.holder, self.form, self.kind, self.fields = [0], [0], [""], [0]
        #: By block: element, texts, characters, characters in links.
        self.element, self.texts, self.chars, self.linked = [], [], [], []
        self.paths = {}
        #: Forms that hold an article or main element.
        self.wide = set()

    def open(self, parent, name, attributes, inside):
        own = {k.lower(): (a or b or c or "") for k, a, b, c in attributes}
        roles = own.get("role", "").lower().split()
        words = [w for key in ("class", "id") for w in own.get(key, "").lower().split()]
        hidden = is_hidden(own)
        top = not inside and (name == "header" or "banner" in roles)
        cut = self.cut[parent] or name in CUT or hidden or top or any(r in CUT_ROLES for r in roles)
        weight = self.weight[parent]
        if name not in ("html", "body", "main") and (named_otherwise(words) or (not inside and not {"header", "site-header", "page-header"}.isdisjoint(words))):
            weight = LOW
        self.name.append(name)
        self.parent.append(parent)
        label = name + ("." + min(words) if words else "")
        self.path.append(self.paths.setdefault((self.path[parent], label), len(self.paths) + 1))
        self.cut.append(cut)
        self.weight.append(weight)
        e = len(self.name) - 1
        self.holder.append(self.holder[parent] if name in PARAGRAPHS else e)
        self.form.append(self.form[parent] or (e if name == "form" else 0))
        self.kind.append(label)
        self.fields.append(int(has_field(name, words)))
        return e


def parse(html):
    """The page's elements and blocks."""
    page, stack, counts = Page(), [0], {}
    at, block, articles, link = 0, None, 0, 0  # link: the depth of the stack where the open link began, 0: none
    muted = None  # the hidden inline element that is open: name, how often that name is open in it, depth of the stack

    def pop():
        nonlocal articles, link, muted
        name = page.name[stack.pop()]
        counts[name] -= 1
        articles -= name in ("article", "main")
        if link > len(stack):
            link = 0
        if muted and muted[2] > len(stack):
            muted = None

    def text(s):
        nonlocal block
        if not s or muted:
            return
        if block is None:
            page.element.append(stack[-1])
            page.texts.append([])
            page.chars.append(0)
            page.linked.append(0)
            block = len(page.texts) - 1
        page.texts[block].append(entities.unescape(s))
        if not s.isspace():
            page.chars[block] += len(s)
            page.linked[block] += len(s) if link else 0

    end = len(html)
    while at < end:
        start = html.find("<", at)
        if start < 0:
            text(html[at:])
            break
        follow = html[start + 1 : start + 2]
        if not (follow.isascii() and follow.isalpha()) and follow not in ("/", "!", "?"):
            text(html[at : start + 1])  # a bare sign
            at = start + 1
            continue
        text(html[at:start])
        if html.startswith("!--", start + 1):
            m = COMMENT.match(html, start + 1)
            if not m:
                break
            at = m.end()
            continue
        name_at = html[start + 2 : start + 3]
        if follow in "!?" or (follow == "/" and not (name_at.isascii() and name_at.isalpha())):
            at = html.find(">", start) + 1
            if not at:
                break
            continue
        m = TAG.match(html, start + 1)
        if not m:
            break  # a tag that never ends
        at = m.end()
        close, name, rest = m[1], m[2].lower(), m[3]
        if name in RAW and not close:
            if rest.endswith("/") and name in ("svg", "math"):
                continue
            at = _after_raw(html, name, at)
            continue
        if name == "a":
            link = 0 if close else len(stack)
        if name == "br":
            text(" ")
        if name in INLINE or name in VOID:
            if name == "hr":
                block = None
            if name in INLINE and muted and name == muted[0]:
                muted[1] += -1 if close else not rest.endswith("/")
                if not muted[1]:
                    muted = None
            elif name in INLINE and rest and not close:
                own = {k.lower(): (a or b or c or "") for k, a, b, c in ATTRIBUTE.findall(rest)}
                words = [w for key in ("class", "id") for w in own.get(key, "").lower().split()]
                page.fields[stack[-1]] += has_field(name, words)
                if not muted and not rest.endswith("/") and name not in VOID and is_hidden(own):
                    muted = [name, 1, len(stack)]
            elif name == "time" and not close:
                page.fields[stack[-1]] += 1
            continue
        block = None
        if close:
            if counts.get(name):
                while page.name[stack[-1]] != name:
                    pop()
                pop()
            continue
        shut = CLOSES.get(name, {"p"} if name in BLOCKS else ())
        while len(stack) > 1 and (top := page.name[stack[-1]]) in shut:
            pop()
            if top == name:
                break
        stack.append(page.open(stack[-1], name, ATTRIBUTE.findall(rest), articles > 0))
        counts[name] = counts.get(name, 0) + 1
        if name in ("article", "main"):
            articles += 1
            page.wide.add(page.form[stack[-1]])
    return page


def _after_raw(html, name, at):
    """The place behind the end tag of an element whose content is no markup; the page's end where there is none."""
    end = re.compile(rf"</{name}(?![^\s/>])[^>]*>", re.I).search(html, at)
    return end.end() if end else len(html)


def smooth(x, width=2):
    """Gaussian window over neighbours, weights renormalised at the ends."""
    import numpy as np

    k = np.exp(-(np.arange(-width, width + 1) ** 2) / (2 * (width / 2) ** 2))
    return np.convolve(x, k)[width : width + len(x)] / np.convolve(np.ones(len(x)), k)[width : width + len(x)]


def fused_ratios(path, chars, marks, linked, weight):
    """The fused ratio of each block's path: arrays by block in page order."""
    import numpy as np

    _, path = np.unique(path, return_inverse=True)
    count = np.bincount(path)
    per = lambda x: (np.bincount(path, x) / count)[path]
    density, punctuation = smooth(per(chars)), smooth(per(marks))
    fused = density * (0.2 + punctuation) * (1 - per(linked) / np.maximum(1, per(chars))) ** 2 * weight
    return per(fused)


def threaded(page, usable):
    """Weights of the elements, with that of what lies in threads of entries lowered."""
    n = len(page.name)
    fields, told, heads = list(page.fields), [0] * n, [name in ("h1", "h2") for name in page.name]
    for b in usable:
        told[page.element[b]] += page.chars[b] if any(c in PUNCTUATION for t in page.texts[b] for c in t) else 0
    for e in range(n - 1, 0, -1):
        up = page.parent[e]
        fields[up] += fields[e]
        told[up] += told[e]
        heads[up] = heads[up] or heads[e]
    groups = {}
    for e in range(1, n):
        groups.setdefault((page.parent[e], page.kind[e]), []).append(e)
    entries = {e for some in groups.values() if len(some) > 1 and all(fields[e] and told[e] and not heads[e] for e in some) for e in some}
    weights = list(page.weight)
    for e in range(1, n):
        if e in entries or (weights[page.parent[e]] == LOW and page.weight[page.parent[e]] != LOW):
            weights[e] = min(weights[e], LOW)
    return weights


def content_blocks(page, share=SHARE, most=MOST):
    """Numbers of the blocks that make the text, in page order."""
    import numpy as np

    usable = [b for b, e in enumerate(page.element) if page.chars[b] and not page.cut[e]]
    forms = {}
    for b in usable:
        forms[page.form[page.element[b]]] = forms.get(page.form[page.element[b]], 0) + page.chars[b]
    shown = {0} | page.wide | {f for f, n in forms.items() if n >= WIDE * sum(forms.values())}
    usable = [b for b in usable if page.form[page.element[b]] in shown]
    if not usable:
        return []
    weights = threaded(page, usable)
    elements = [page.element[b] for b in usable]
    chars = np.array([page.chars[b] for b in usable], float)
    marks = np.array([sum(t.count(c) for t in page.texts[b] for c in PUNCTUATION) for b in usable], float)
    linked = np.array([page.linked[b] for b in usable], float)
    weight = np.array([weights[e] for e in elements])
    ratio = fused_ratios(np.array([page.path[e] for e in elements]), chars, marks, linked, weight)
    content = ratio >= share * (ratio @ chars) / chars.sum()
    # whether an element is inside an article or main element, and the innermost one
    article = [0] * len(page.name)
    for e in range(1, len(page.name)):
        article[e] = e if page.name[e] in ("article", "main") else article[page.parent[e]]
    inside = np.array([article[e] > 0 for e in elements])
    heavy = (chars * weight)[content | inside]
    if (chars * weight)[inside].sum() >= most * heavy.sum():
        content = content & inside if (content & inside).any() else inside & (weight == weight[inside].max())
    # elements with content below them: the last content block in each; and those that hold content blocks themselves
    last, holds = [-1] * len(page.name), [False] * len(page.name)
    for n in np.flatnonzero(content).tolist():
        e = elements[n]
        last[e] = n
        holds[page.holder[e]] = True
    for e in range(len(page.name) - 1, 0, -1):
        last[page.parent[e]] = max(last[page.parent[e]], last[e])
    # the innermost element around each one, itself included, that has content
    around = [0] * len(page.name)
    for e in range(1, len(page.name)):
        around[e] = e if last[e] >= 0 else around[page.parent[e]]
    out = []
    for n, (b, e) in enumerate(zip(usable, elements)):
        near = around[e]
        beside = page.holder[near]
        own = weights[e] == weights[near]
        if content[n]:
            out.append(b)
        elif own and article[near] and last[article[near]] >= 0:
            out.append(b)
        elif own and holds[beside] and linked[n] <= 0.5 * chars[n]:
            out.append(b)
        elif own and page.name[e] in HEADINGS and last[near] > n and linked[n] <= 0.5 * chars[n]:
            out.append(b)
    return out


def main_text(html, share=SHARE, most=MOST):
    """The article's text."""
    page = parse(html)
    blocks = (" ".join("".join(page.texts[b]).split()) for b in content_blocks(page, share, most))
    return " ".join(b for b in blocks if b)


def extract(pages):
    """page_id, url, text (the main text), n_chars of pages(page_id, url, html)."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for part in slices(batch, "html"):
                texts = [main_text(h or "") for h in part.column("html").to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column("page_id"), part.column("url"), pa.array(texts, pa.string())], ["page_id", "url", "text"])

    found = pages.select("page_id", "url", "html").mapInArrow(run, "page_id long, url string, text string")
    return found.withColumn("n_chars", F.length("text").cast("long"))


def op2_html_text(spark, sf_dir):
    return extract(table(spark, sf_dir, "pages"))


QUERIES = {"op2_html_text": op2_html_text}
ORACLE_SQL = {}
