"""Main-text extraction with a tree-structured graphical model.

A page becomes a tree of its block elements with its blocks of text as leaves.
Each node is content or not: a unary potential speaks for the node's own tag,
names and text, and a parent-child potential ties it to its parent. Sum-product
messages pass upward and then downward through the tree and leave each node's
exact marginal; the blocks that are more likely content are the text. What a name
says is learned, beside a list of names to begin with; a name that tells a box's
looks says less of a paragraph than of a part of the page. Reader comments are also
known by their structure: siblings alike that each hold a line of author and date.

The potentials maximise the likelihood of labelled pages: the gradient is what a
page's labels show less what its marginals expect. Pages that label themselves,
by ``article`` or ``main``, are the sample, and it is bounded. Altered copies, in which that tag
has another name or none, paragraphs are bare text or divs, and foreign parts are put between the
paragraphs, keep the model from leaning on that one tag.

Defined results: a null or empty page, or one without content, gives an empty
text; broken markup is read as far as it goes: unclosed elements end with the
page and stray end tags are passed over; a head needs no end tag, and of an
element without text whose end tag is missing only the start tag is passed over,
but for script and style, which end with the page; repeated rows give equal texts; an
empty table gives an empty result.
"""

from __future__ import annotations

import math
import random
import re
from collections.abc import Iterator
from functools import lru_cache
from html import unescape

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from massflow.llm.common import hash_sample, table

#: Pages to learn from, the longest of them in bytes, and how often each is seen.
TRAIN_PAGES, TRAIN_BYTES, EPOCHS = 200, 32768, 10

# How markup names things.
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
VOID = frozenset("hr".split())
#: Elements whose contents are no text.
RAW = "script|style|noscript|template|svg|math|iframe|object|title|select|textarea|button|canvas|audio|video"
#: An open element that a new one of the same group ends.
SIBLINGS = {"li": "li", "dt": "dt dd", "dd": "dt dd", "tr": "tr td th", "td": "td th", "th": "td th"}
#: What holds list items and cells, past which no sibling is ended.
HOLDERS = frozenset("ul ol menu dir dl table tbody thead tfoot".split())
CONTENT_NAMES = frozenset("article main content post entry story text body".split())
OTHER_NAMES = frozenset(
    """ad ads advert advertisement adverts alert aside banner bar breadcrumb breadcrumbs comment comments consent cookie cookies copyright discussion disqus footer form header legal livefyre login masthead menu meta
    modal nav navbar navigation newsletter notice notices notification pager pagination popup privacy promo promoted recommended related replies reply respond responses search share sharing sidebar sidenav
    signup social sponsor sponsored subscribe tags teaser thread toc toolbar topbar warning widget widgets""".split()
)
#: Names that tell a paragraph's looks.
LOOKS = frozenset("alert aside bar header teaser warning".split())
#: Elements that hold one block of text.
TEXTUAL = frozenset("p h1 h2 h3 h4 h5 h6 li blockquote pre figcaption dd dt td th".split())
#: Elements that are no single comment and no list of comments.
WHOLE = frozenset("page html body main article".split())
#: Elements around the parts of a page, which agree less with what holds them than parts of these.
OUTER = frozenset("page html body".split())
_DATE = r"(?:\d{1,2}[./-]\d{1,2}[./-]\d{2,4}|\d{4}-\d\d-\d\d|\d{1,2}\.? [^\W\d]{3,10}\.? \d{4}|[^\W\d]{3,10}\.? \d{1,2},? \d{4}|\d+ (?:second|minute|hour|day|week|month|year)s? ago|yesterday|vor \d+ \w+|il y a \d+ \w+|hace \d+ \w+)"
#: A line of author and date, of author and verb, or a button to answer.
_BYLINE = re.compile(rf"[^\w]*[^\W\d][^.!?]{{0,40}}?\b{_DATE}[^.!?]{{0,20}}\Z|[^\W\d][^.!?:]{{0,40}}\b(?:says|said|wrote|writes|commented|replied|schrieb|a écrit|escribió)\b[^.!?]{{0,30}}\Z|(?:reply|antworten|répondre|responder)\Z", re.I)
BYLINE_LENGTH = 80

_TOKEN = re.compile(
    rf"<!--.*?(?:-->|\Z)|<(?P<raw>{RAW})(?=[\s/>])(?P<inside>(?:\"[^\"]*\"|'[^']*'|[^>\"'])*)>|<(?P<end>/?)(?P<tag>[a-zA-Z][a-zA-Z0-9:-]*)(?P<attrs>(?:\"[^\"]*\"|'[^']*'|[^>\"'])*)>?|<[!?/][^>]*>?", re.S | re.I
)
_RAW_END = {raw: re.compile(rf"</{raw}(?=[\s/>])[^>]*>", re.I) for raw in RAW.split("|")}
#: Without an end tag, these last to the end of the page; of the others only the start tag is passed over.
TO_THE_END = frozenset("script style".split())
_NAMED = re.compile(r"""\b(class|id|role|data-label)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_WORDS = re.compile(r"[a-z]+")


class Node:
    """An element (tag, attrs) or, without a tag, a block of text."""

    __slots__ = ("attrs", "edge", "linked", "mass", "parent", "tag", "text", "thread")

    def __init__(self, parent: int, tag: str, attrs: str, text: str = "", linked: int = 0):
        self.parent, self.tag, self.attrs, self.text, self.linked = parent, tag, attrs, text, linked
        self.mass, self.edge, self.thread = 0, 0, False


def parse(html: str) -> list[Node]:
    """The tree of a page; parents stand before their children, blocks of text in page order."""
    nodes, stack, buffer = [Node(-1, "page", "")], [0], []
    links, linked = 0, 0

    def flush() -> None:
        nonlocal linked
        if buffer:
            raw = "".join(buffer)
            buffer.clear()
            text = " ".join((unescape(raw) if "&" in raw else raw).split())
            if text:
                nodes.append(Node(stack[-1], "", "", text, linked))
            linked = 0

    def close(tags: list[str], until: frozenset[str]) -> None:
        """Ends the innermost open element of ``tags``, with what is open in it."""
        for i in range(len(stack) - 1, 0, -1):
            tag = nodes[stack[i]].tag
            if tag in tags:
                del stack[i:]
                return
            if tag in until:
                return

    at, unclosed = 0, set()
    while m := _TOKEN.search(html, at):
        if m.start() > at:
            buffer.append(html[at : m.start()])
            linked += (m.start() - at) * (links > 0)
        at = m.end()
        tag = m["tag"]
        if tag is None:
            if m["raw"]:
                buffer.append(" ")
                raw = m["raw"].lower()
                if raw in ("svg", "math") and m["inside"].endswith("/"):
                    continue
                # where one is missing, it is missing for all that follow
                end = None if raw in unclosed else _RAW_END[raw].search(html, at)
                if end:
                    at = end.end()
                elif raw in TO_THE_END:
                    at = len(html)
                else:
                    unclosed.add(raw)
            continue
        tag = tag.lower()
        if tag not in BLOCKS:
            if tag == "a":
                links = 0 if m["end"] else 1
            elif tag in ("br", "img", "input", "wbr") and tag != "wbr":
                buffer.append(" ")
            continue
        flush()
        if m["end"]:
            if tag not in ("html", "body"):
                close([tag], frozenset())
            continue
        if tag in ("html", "body") and not (m["attrs"] or "").strip():
            continue
        close(["p"], frozenset(("td", "th", "li", "div", "section", "article")))
        if tag in SIBLINGS:
            close(SIBLINGS[tag].split(), HOLDERS)
        nodes.append(Node(stack[-1], tag, m["attrs"] or ""))
        if tag not in VOID and not (m["attrs"] or "").rstrip().endswith("/"):
            stack.append(len(nodes) - 1)
    if at < len(html):
        buffer.append(html[at:])
    flush()
    mark_threads(nodes)
    # the text of an element without links and without what is named otherwise in it
    for v in range(len(nodes) - 1, 0, -1):
        n = nodes[v]
        if not n.tag:
            n.edge, n.mass = 3, max(0, len(n.text) - n.linked)
        elif n.tag not in OUTER and nodes[n.parent].tag in OUTER:
            n.edge = 6
        if not n.tag or not other(n):
            nodes[n.parent].mass += n.mass
    # whether a part of the page is named as its content
    if any(n.tag and 5 * n.mass >= nodes[0].mass and (n.tag in ("article", "main") or "named content" in element_features(n.tag, n.attrs)) for n in nodes[1:]):
        nodes[0].attrs = "marked"
    return nodes


def mark_threads(nodes: list[Node]) -> None:
    """Marks comments: siblings of the same tag and names that each hold a byline and more; and what holds little else."""
    lines = [v for v, n in enumerate(nodes) if not n.tag and len(n.text) <= BYLINE_LENGTH and _BYLINE.match(n.text)]
    if len(lines) < 2:
        return
    texts, size = [0] * len(nodes), [0] * len(nodes)
    for v in range(len(nodes) - 1, 0, -1):
        if not nodes[v].tag:
            texts[v], size[v] = 1, len(nodes[v].text)
        texts[nodes[v].parent] += texts[v]
        size[nodes[v].parent] += size[v]
    alike: dict[tuple, set[int]] = {}
    for v in lines:
        a = nodes[v].parent
        while nodes[a].tag not in WHOLE:
            if texts[a] > 1:
                alike.setdefault((nodes[a].parent, nodes[a].tag, names(nodes[a].attrs)), set()).add(a)
            a = nodes[a].parent
    for (holder, *_), entries in alike.items():
        if len(entries) > 1:
            for a in entries:
                nodes[a].thread = True
            if nodes[holder].tag not in WHOLE and 2 * sum(size[a] for a in entries) > size[holder]:
                nodes[holder].thread = True


@lru_cache(maxsize=20_000)
def names(attrs: str) -> frozenset[str]:
    """The words of an element's class, id and role."""
    found: set[str] = set()
    for m in _NAMED.finditer(attrs) if attrs else ():
        if m[1].lower() != "data-label":
            found.update(_WORDS.findall((m[2] or m[3] or m[4] or "").lower()))
    return frozenset(found)


def other(n: Node) -> bool:
    """Whether an element is named as something else than content, or is a comment by its structure."""
    return n.thread or "named other" in element_features(n.tag, n.attrs)


@lru_cache(maxsize=20_000)
def element_features(tag: str, attrs: str) -> tuple[str, ...]:
    """What a unary potential sees of an element."""
    if tag == "page":
        return ("element", "tag=page", attrs or "unmarked")
    said = names(attrs) | ({tag} if tag in CONTENT_NAMES or tag in OTHER_NAMES else set())
    said -= {"body"} if tag == "body" else LOOKS if tag in TEXTUAL else set()
    found = ["element", f"tag={tag}", *sorted(f"name={x}" for x in names(attrs) & said)]
    if said & OTHER_NAMES:
        found.append("named other")
    elif said & CONTENT_NAMES:
        found.append("named content")
    return tuple(found)


def text_features(text: str, linked: int) -> tuple[str, ...]:
    """What a unary potential sees of a block of text."""
    n = len(text)
    share = min(1.0, linked / n)
    return ("text", f"length={min(6, n.bit_length() // 2)}", f"linked={0 if share < 0.1 else 1 if share < 0.6 else 2}", f"sentence={text[-1] in '.!?…'}")


def features(node: Node, page_mass: int) -> tuple[str, ...]:
    """``page_mass``: of the page's text, an element's share tells more than its length."""
    if not node.tag:
        return text_features(node.text, node.linked)
    share = node.mass / page_mass if page_mass else 0.0
    holder = node.tag in ("page", "html", "body", "p", "h1", "h2", "h3", "h4", "h5", "h6", "li")
    size = "small" if holder else f"share={0 if share < 0.1 else 1 if share < 0.4 else 2 if share < 0.7 else 3} long={min(5, node.mass.bit_length() // 2)}"
    return (*element_features(node.tag, node.attrs), size, *(("thread",) if node.thread else ()))


#: Where weights start and whither they are drawn: what the names say, and that parents and children agree.
PRIOR = {"named other": -6.0, "named content": 5.0, "thread": -8.0, "unmarked": 5.0, "linked=2": -2.0, "agree": 2.0, "text agree": 2.0, "page agree": 2.0}
#: Of an edge to an element, of one to a block of text, and of one from the page to a part of it; a node's ``edge`` is its first.
PAIR = ("parent", "child", "agree", "text parent", "text child", "text agree", "page parent", "page child", "page agree")


class Model:
    """Weights of features and of the parent-child potentials exp(parent * y + child * z + agree * y * z)."""

    def __init__(self, weights: dict[str, float]):
        self.weights = weights
        self.pair = tuple(weights.get(k, 0.0) for k in PAIR)
        self.known: dict[tuple[str, ...], float] = {}

    def unary(self, node: Node, page_mass: int) -> float:
        f = features(node, page_mass)
        u = self.known.get(f)
        if u is None:
            u = self.known[f] = sum(self.weights.get(x, 0.0) for x in f)
        return u

    def marginals(self, nodes: list[Node], unary: list[float] | None = None) -> tuple[list[float], list[float]]:
        """The log odds of each node's marginal, and what it hears from its parent's side."""
        kinds = {k: self.pair[k : k + 3] for k in range(0, len(PAIR), 3)}
        up = list(unary) if unary else [self.unary(n, nodes[0].mass) for n in nodes]
        sent, rest = [0.0] * len(nodes), [0.0] * len(nodes)
        for v in range(len(nodes) - 1, 0, -1):
            a, b, g = kinds[nodes[v].edge]
            sent[v] = a + _soft(up[v] + b + g) - _soft(up[v] + b)
            up[nodes[v].parent] += sent[v]
        for v in range(1, len(nodes)):
            a, b, g = kinds[nodes[v].edge]
            rest[v] = up[nodes[v].parent] - sent[v]
            up[v] += b + _soft(rest[v] + a + g) - _soft(rest[v] + a)
        return up, rest

    def extract(self, html: str | None) -> str:
        if not html:
            return ""
        nodes = parse(html)
        return "\n".join(n.text for n, odds in zip(nodes, self.marginals(nodes)[0], strict=True) if not n.tag and odds > 0)


def _soft(x: float) -> float:
    """log(1 + exp(x))"""
    return x if x > 30 else math.log1p(math.exp(x)) if x > -30 else 0.0


def labelled(nodes: list[Node], whole: int = 0) -> list[int] | None:
    """Labels of a page that tells where its article is, else None; ``whole``: what holds outside of all that tells.

    ``data-label``, which no feature sees, counts first; then article and main,
    without what is named otherwise inside.
    """
    labels, any_content = [whole] * len(nodes), False
    for v, n in enumerate(nodes):
        inherited = labels[n.parent] if v else whole
        told = next((m[2] for m in _NAMED.finditer(n.attrs) if m[1].lower() == "data-label"), None) if n.attrs else None
        if told is not None:
            labels[v] = int(told)
        elif n.tag in ("article", "main"):
            labels[v] = 1
        elif n.tag and other(n):
            labels[v] = 0
        else:
            labels[v] = inherited
        any_content |= labels[v] == 1
    return labels if any_content else None


def altered(html: str, rng: random.Random) -> str:
    """A page with its article under another name and foreign parts between its paragraphs."""
    name = rng.choice(["div", "section", 'div class="content"', 'div id="main"', "main", 'div class="post-body"'])
    html = re.sub(r"<article[^>]*>", f'<{name} data-label="1">', html)
    html = html.replace("</article>", f"</{name.split()[0]}>")
    foreign = ['section class="comments"', 'div id="disqus_thread"', 'aside class="sidebar"', 'div class="ad-banner"', "form", 'div class="notice"', "aside", "nav", 'div id="related"', 'div class="comment-list"']
    paragraphs = re.findall(r"<p>([^<]{20,})</p>", html)[:40] or ["A few words of a reader who liked this page and says so."]
    some = lambda: rng.choice(paragraphs)[: rng.choice([15, 60, 200, 100_000])]
    wrapped = lambda tag, n: "".join(f"<{tag}>{some()}</{tag}>" for _ in range(n))

    def between(m: re.Match) -> str:
        r = rng.random()
        if r > 0.4:
            return m[0]
        if r > 0.2:  # other forms of content
            n = rng.randint(1, 4)
            inner = rng.choice([f"<ul>{wrapped('li', n)}</ul>", f"<ol>{wrapped('li', n)}</ol>", wrapped("blockquote", 1), f"<blockquote>{wrapped('p', n)}</blockquote>", wrapped("h2", 1), wrapped("h3", 1), f'<p class="{rng.choice(sorted(LOOKS))}">{some()}</p>', wrapped("div", n), wrapped("pre", 1), f"<div>{wrapped('p', n)}</div>", f"<section>{wrapped('h2', 1)}{wrapped('p', n)}</section>", f"<table><tr>{wrapped('td', n)}</tr></table>", f"<figure>{wrapped('figcaption', 1)}</figure>"])
            return f"</p>{inner}<p>"
        if r < 0.05:  # comments without a name
            entry, when = rng.choice(["div", "li", "div class='x'"]), rng.choice(["3 May 2024", "2023-11-02", "2 days ago"])
            return f'</p><div data-label="0">' + "".join(f"<{entry}><b>{rng.choice(['Ann', 'Jo Li', 'reader'])}</b> {when}{wrapped('p', 1)}</{entry.split()[0]}>" for _ in range(rng.randint(2, 5))) + "</div><p>"
        part, n = rng.choice(foreign), rng.choice([1, 1, 2, 3, 12])
        inner = rng.choice([wrapped("p", n), wrapped("div", n), some(), f"<h2>{some()}</h2>{wrapped('p', n)}", f"<ul>{wrapped('li', n)}</ul>"])
        return f'</p><{part} data-label="0">{inner}</{part.split()[0]}><p>'

    html = re.sub(r"</p><p>", between, html)
    top = rng.choice(["", f"<header><h1>{some()}</h1></header>", f'<div class="menu">{wrapped("a", 4)}</div>', f'<div class="notice" data-label="0"><p>{some()}</p></div>', f"<div><p>{some()[:60]}</p></div>"])
    return html.replace("<nav>", top + "<nav>", 1)


def bare(html: str, rng: random.Random) -> str:
    """A page whose article has no element of its own: divs or bare text, with or without the parts around it."""
    html = re.sub(r"</?(?:article|main)(?:\s[^>]*)?>", "", html)
    if rng.random() < 0.5:
        html = re.sub(r"<(nav|footer|header)\b.*?</\1>", "", html, flags=re.S)
    if rng.random() < 0.5:  # a short page
        html = re.sub(r"(?:<p>[^<]*</p>\s*)+", lambda m: "".join(re.findall(r"<p>[^<]*</p>", m[0])[: rng.randint(1, 2)]), html)
    opened, closed = rng.choice([("<p>", "</p>"), ("<div>", "</div>"), ("<div><div>", "</div></div>"), ("<br>", "<br>")])
    return html.replace("<p>", opened).replace("</p>", closed)


def _odds(x: float) -> float:
    """The probability that log odds stand for."""
    return 1 / (1 + math.exp(-max(-30.0, min(30.0, x))))


def train(pages: list[str], epochs: int = EPOCHS, seed: int = 3) -> Model:
    """Stochastic gradient ascent on the likelihood of the labels, a page at a time."""
    rng, index, data = random.Random(seed), {k: i for i, k in enumerate(PAIR)}, []
    for html in pages:
        for copy, whole in ((html, 0), (altered(html, rng), 0), (altered(html, rng), 0), (bare(html, rng), 1)):
            nodes = parse(copy)
            if (y := labelled(nodes, whole)) is not None:
                data.append((nodes, y, [[index.setdefault(f, len(index)) for f in features(n, nodes[0].mass)] for n in nodes]))
    prior = np.array([PRIOR.get(f, 0.0) for f in index])
    w, squares = prior.copy(), np.full(len(index), 1e-2)
    for _ in range(epochs if data else 0):
        rng.shuffle(data)
        for nodes, y, of in data:
            model = Model({})
            pair = model.pair = tuple(w[: len(PAIR)].tolist())
            weight = w.tolist()
            unary = [sum(weight[f] for f in fs) for fs in of]
            belief, rest = model.marginals(nodes, unary)
            g = np.zeros(len(w))
            for v, n in enumerate(nodes):
                gap = y[v] - _odds(belief[v])
                for f in of[v]:
                    g[f] += gap
                if v:
                    # P(parent, node) = P(node) P(parent given node)
                    k = n.edge
                    both = _odds(belief[v]) * _odds(rest[v] + pair[k] + pair[k + 2])
                    g[k] += y[n.parent] - _odds(belief[n.parent])
                    g[k + 1] += gap
                    g[k + 2] += y[n.parent] * y[v] - both
            g = g / len(nodes) - 1e-3 * (w - prior)
            squares += g * g
            w += 0.3 * g / np.sqrt(squares)
    return Model(dict(PRIOR) | ({f: float(w[i]) for f, i in index.items()} if data else {}))


def fit(pages: DataFrame, train_pages: int = TRAIN_PAGES) -> Model:
    """Learns from the ``train_pages`` pages with the smallest hashes that label themselves."""
    told = pages.where(F.col("html").rlike("(?i)<(article|main)[ >]") & (F.octet_length("html") <= TRAIN_BYTES))
    rows = hash_sample(told.select("html"), "html", train_pages).collect()
    return train([r["html"] for r in rows])


def extracted(html: Column, shared) -> Column:
    @F.pandas_udf("string")
    def extract(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = shared.value
        for batch in batches:
            yield pd.Series([model.extract(h) for h in batch], dtype=object)

    return extract(html)


def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    shared = spark.sparkContext.broadcast(fit(pages.select("html")))
    return pages.select("page_id", "url", extracted(F.col("html"), shared).alias("text")).withColumn("n_chars", F.length("text").cast("long"))
