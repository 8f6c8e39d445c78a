"""The main text of web pages, from content marginals on the tree of their elements.

A page is read into a tree of block elements.  Every element is content or not; its
potential comes from its tag, the words of its class and id, how much text and how much
of it in links it holds, and potentials between parent and child say how far either
follows the other.  Messages passed from the leaves to the root and back (sum-product)
give every element its marginal, and the text of elements that are content at least as
likely as not is the page's text, block by block in page order.

Potentials are trained by gradient on labelled pages: pages built from lists of what
surrounds an article under which names, and about ``SAMPLE`` pages of the table that
mark their article themselves.

Defined results: null or empty html has an empty text, so has a page without content or
without blocks; repeated rows get the same answer; an element just as likely content as not
is content; an empty table gives no rows; other columns are not looked at.  A page is read
in one pass, whatever its length and however deep it nests, and in a second one if an element
that is left out is not closed; broken markup closes where its parent does.  Script, style
and what else is raw text to a browser run to the end of the page.
"""

from __future__ import annotations

import html as references
import itertools
import math
import random
import re
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flightlake.llm.common import ship

#: Pages of the table that the potentials are also trained on, about so many.
SAMPLE = 150
#: Characters a page may have to be among these; with ``SAMPLE`` it bounds what is gathered.
TAUGHT_CHARS = 200_000

# How HTML elements behave.
INLINE = frozenset(
    "a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark nobr q ruby rp rt s "
    "samp small span strike strong sub sup time tt u var wbr".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
SKIPPED = frozenset(
    "script style noscript template svg math iframe object canvas audio video title textarea select button "
    "datalist".split()
)
#: What is text to the browser up to its end tag, or to the end of the page.
RAW = frozenset("script style noscript template iframe title textarea".split())
ENDS_PARAGRAPH = frozenset(
    "address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 "
    "h3 h4 h5 h6 header hgroup hr main menu nav ol p pre search section summary table ul".split()
)
CLOSED_BY_NEXT = {
    "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"},
    "th": {"td", "th"}, "option": {"option"},
}
#: An element that is left out and has no end tag of its own is over where one of these begins.
RESUMES = ENDS_PARAGRAPH | frozenset(CLOSED_BY_NEXT) - {"option"}
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())

# Names under which pages place what is not their article, by role and tag.
SURROUNDINGS = {
    "nav": ("nav menu navbar navigation breadcrumb breadcrumbs topbar toc pagination pager", "nav div ul"),
    "header": ("header masthead banner site-header top branding logo", "header div"),
    "footer": ("footer copyright site-footer bottom colophon legal", "footer div"),
    "aside": ("sidebar aside related recommended widget popular trending more-stories", "aside div section"),
    "notice": ("notice cookie cookies consent gdpr alert popup modal overlay newsletter subscribe paywall", "div section"),
    "ad": ("ad ads advert advertisement sponsored sponsor promo promoted banner-ad adbox", "div aside"),
    "form": ("form search login signup contact subscribe-form", "form div"),
    "comments": ("comments comment reader-comments discussion replies reply respond disqus", "section div ol"),
    "share": ("share sharing social social-links follow tags meta-links", "div ul"),
}
ARTICLES = {
    "article": "", "main": "", "div": "article content main-content post-content entry-content story article-body text body",
    "section": "article content story post",
}

_NAME = re.compile(r"[a-zA-Z][^\s/>]*")
_NAMES = re.compile(r"""(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.IGNORECASE)
_PART = re.compile(r"[a-z]+")
_HIDDEN = re.compile(r"\bhidden\b|display\s*:\s*none", re.IGNORECASE)


@dataclass
class Node:
    tag: str
    parent: int
    names: str = ""
    text: int = 0
    linked: int = 0
    all_text: int = 0
    all_linked: int = 0
    stops: int = 0
    children: list[int] = field(default_factory=list)


@dataclass
class Tree:
    nodes: list[Node]
    #: Text of each block and the element it stands in, in page order.
    blocks: list[tuple[int, str]]


def _tag_end(page: str, at: int) -> int:
    """Where the tag that begins at ``at`` ends; a ``>`` between quotes does not end it."""
    stop = page.find(">", at)
    while stop >= 0:
        inside = page[at:stop]
        double, single = inside.count('"') % 2, inside.count("'") % 2
        if not (double or (single and "=" in inside and '"' not in inside)):
            return stop
        quote = page.find('"' if double else "'", stop + 1)
        after = page.find(">", quote + 1) if quote >= 0 else -1
        if after < 0:
            return stop
        at, stop = quote + 1, after
    return -1


def parse(page: str) -> Tree:
    """The block elements of a page and the text they hold."""
    tree, unclosed = _parse(page, frozenset())
    return _parse(page, unclosed)[0] if unclosed else tree


def _parse(page: str, open_ended: frozenset[int]) -> tuple[Tree, frozenset[int]]:
    """The tree, and where elements begin that are left out and have no end inside their parent.

    ``open_ended``: the same, as known before; of these only what comes before the next
    block is left out.
    """
    nodes, blocks = [Node("#page", -1)], []
    path, run, links = [0], [], 0
    #: How many elements of a tag are open, on the path and among what is left out: an end
    #: tag looks for its partner only where there is one, and what it passes it closes.
    on_path: Counter = Counter()
    left_out: Counter = Counter()
    at, n = 0, len(page)
    #: Open elements from the one that is left out on, and where each begins.
    skip: list[tuple[str, int]] = []
    unclosed: list[int] = []
    #: How deep the path was where an element without an end began; 0 if none has.
    muted = 0

    def flush() -> None:
        if run:
            text = " ".join(references.unescape("".join(run)).split())
            run.clear()
            if text:
                blocks.append((path[-1], text))
                nodes[path[-1]].text += len(text)
                nodes[path[-1]].stops += sum(map(text.count, ".!?,"))

    def close(upto: int) -> None:
        flush()
        on_path.subtract(nodes[i].tag for i in path[upto:])
        del path[upto:]

    while at < n:
        begin = page.find("<", at)
        if begin < 0:
            begin = n
        if begin > at and not skip and not muted:
            piece = page[at:begin]
            run.append(piece)
            if links:
                nodes[path[-1]].linked += len(piece.strip())
        if begin == n:
            break
        if page.startswith("<!--", begin):
            stop = page.find("-->", begin + 4)
            at = n if stop < 0 else stop + 3
            continue
        follows = page[begin + 1 : begin + 2]
        if follows in ("!", "?"):
            stop = page.find(">", begin)
            at = n if stop < 0 else stop + 1
            continue
        ending = follows == "/"
        name = _NAME.match(page, begin + 2 if ending else begin + 1)
        if not name:
            if ending:
                stop = page.find(">", begin)
                at = n if stop < 0 else stop + 1
            else:
                if not skip and not muted:
                    run.append("<")
                at = begin + 1
            continue
        tag = name.group().lower()
        stop = _tag_end(page, name.end())
        if stop < 0:
            break
        at = stop + 1
        if skip and tag not in RAW:
            if not ending:
                if tag not in INLINE and tag not in VOID and page[stop - 1] != "/":
                    skip.append((tag, begin))
                    left_out[tag] += 1
                continue
            if tag in INLINE:
                continue
            has_own = left_out[tag] > 0
            if not has_own and on_path[tag] <= 0:
                continue
            while skip and not (has_own and skip[-1][0] == tag):
                passed, where = skip.pop()
                left_out[passed] -= 1
                if passed in SKIPPED:
                    unclosed.append(where)
            if has_own:
                skip.pop()
                left_out[tag] -= 1
                continue
        if ending:
            if tag in INLINE:
                links = max(0, links - 1) if tag == "a" else links
                continue
            if on_path[tag] <= 0:
                continue
            for depth in range(len(path) - 1, 0, -1):
                if nodes[path[depth]].tag == tag:
                    close(depth)
                    muted = muted if depth >= muted else 0
                    links = 0
                    break
            continue
        if tag in SKIPPED:
            if begin in open_ended:
                muted = muted or len(path)
            elif page[stop - 1] != "/" and tag not in RAW:
                skip.append((tag, begin))
                left_out[tag] += 1
            elif page[stop - 1] != "/":
                closing = re.compile(rf"</{re.escape(tag)}\b[^>]*>?", re.IGNORECASE).search(page, at)
                at = closing.end() if closing else n
            run.append(" ")
            continue
        if tag in INLINE:
            if tag == "a":
                links += 1
            elif tag == "br":
                run.append(" ")
            continue
        flush()
        if tag in RESUMES:
            muted = 0
        if tag in ENDS_PARAGRAPH and nodes[path[-1]].tag == "p":
            close(len(path) - 1)
            links = 0
        closes = CLOSED_BY_NEXT.get(tag)
        if closes and nodes[path[-1]].tag in closes:
            close(len(path) - 1)
        if tag in VOID:
            continue
        attributes = page[name.end() : stop]
        names = " ".join(x for found in _NAMES.findall(attributes) for x in found if x) if attributes else ""
        if attributes and _HIDDEN.search(attributes):
            names += " hidden"
        nodes.append(Node(tag, path[-1], names.lower()))
        nodes[path[-1]].children.append(len(nodes) - 1)
        path.append(len(nodes) - 1)
        on_path[tag] += 1
    flush()
    unclosed += [where for name, where in skip if name in SKIPPED]
    for node in reversed(nodes):
        node.all_text += node.text
        node.all_linked += node.linked
        if node.parent >= 0:
            nodes[node.parent].all_text += node.all_text
            nodes[node.parent].all_linked += node.all_linked
    return Tree(nodes, blocks), frozenset(unclosed)


def _level(x: float, steps: tuple) -> int:
    return sum(x >= s for s in steps)


def features(node: Node) -> list[str]:
    share = node.all_linked / node.all_text if node.all_text else 0.0
    length = _level(node.all_text, (1, 30, 100, 300, 1000))
    found = [
        f"tag {node.tag}",
        f"length {length}",
        f"links {_level(share, (0.01, 0.2, 0.5, 0.9))}",
        f"own {_level(node.text, (1, 40, 120, 400))}",
        f"stops {_level(node.stops, (1, 3, 8))}",
    ]
    if node.names:
        found += [f"name {part}" for part in set(_PART.findall(node.names))]
    return found


def kind(node: Node) -> int:
    """Which table of parent-child potentials an element falls under."""
    if node.tag in HEADINGS:
        return 1
    if node.names or node.tag in ("nav", "aside", "footer", "header", "form", "section", "article", "main"):
        return 2
    return 0


@dataclass
class Model:
    weights: dict[str, float]
    #: By kind: log-potentials of (parent, child) being (0 0), (0 1), (1 0), (1 1).
    edges: list[list[float]]


def _passed(s: float, e: tuple[float, float, float, float]) -> float:
    """Log-odds that reach the other end; ``e``: (here, there) as 00, 01, 10, 11."""
    return _plus(e[1], e[3] + s) - _plus(e[0], e[2] + s)


def _plus(a: float, b: float) -> float:
    return (a if a > b else b) + math.log1p(math.exp(-abs(a - b)))


def beliefs(tree: Tree, model: Model, scores: list[float]) -> tuple[list[float], list[tuple[float, float]]]:
    """Log-odds of every element, and per edge what its two ends think without the other."""
    nodes = tree.nodes
    up = [0.0] * len(nodes)
    inner = list(scores)
    for i in range(len(nodes) - 1, 0, -1):
        e = model.edges[kind(nodes[i])]
        # From child to parent: the child's state is the near one.
        up[i] = _passed(inner[i], (e[0], e[2], e[1], e[3]))
        inner[nodes[i].parent] += up[i]
    total = list(inner)
    ends = [(0.0, 0.0)] * len(nodes)
    for i in range(1, len(nodes)):
        without = total[nodes[i].parent] - up[i]
        ends[i] = (without, inner[i])
        total[i] = inner[i] + _passed(without, tuple(model.edges[kind(nodes[i])]))
    return total, ends


def _logistic(x: float) -> float:
    return 1 / (1 + math.exp(-x)) if x > -700 else 0.0


def score(tree: Tree, model: Model) -> list[float]:
    get = model.weights.get
    return [get("", 0.0) + sum(get(f, 0.0) for f in features(node)) for node in tree.nodes]


def train(pages: list[tuple[Tree, list[int]]], epochs: int = 30, speed: float = 0.4) -> Model:
    """Potentials that make the labels of the pages likely; adaptive gradient steps."""
    model = Model(Counter(), [[1.0, -1.0, -1.0, 1.0] for _ in range(3)])
    seen: Counter = Counter()
    seen_edges = [[1e-6] * 4 for _ in range(3)]
    described = [[features(node) + [""] for node in tree.nodes] for tree, _ in pages]
    for _ in range(epochs):
        for (tree, labels), found in zip(pages, described, strict=True):
            scores = [sum(model.weights[f] for f in fs) for fs in found]
            total, ends = beliefs(tree, model, scores)
            slopes: Counter = Counter()
            for fs, s, y in zip(found, total, labels, strict=True):
                miss = y - _logistic(s)
                for f in fs:
                    slopes[f] += miss
            for f, g in slopes.items():
                g -= 0.002 * model.weights[f]
                seen[f] += g * g
                model.weights[f] += speed * g / math.sqrt(seen[f] + 1e-6)
            for i in range(1, len(tree.nodes)):
                k, (p, c) = kind(tree.nodes[i]), ends[i]
                e = model.edges[k]
                logs = (e[0], e[1] + c, e[2] + p, e[3] + p + c)
                top = max(logs)
                mass = [math.exp(x - top) for x in logs]
                whole = sum(mass)
                state = 2 * labels[tree.nodes[i].parent] + labels[i]
                for j in range(4):
                    g = (j == state) - mass[j] / whole
                    seen_edges[k][j] += g * g
                    e[j] += 0.1 * speed * g / math.sqrt(seen_edges[k][j])
    return model


def marked_labels(tree: Tree) -> list[int]:
    """Labels of a page that marks its article: what ``article`` or ``main`` holds, bar its surroundings."""
    outside = {w for names, _ in SURROUNDINGS.values() for w in names.split()}
    labels: list[int] = []
    for node in tree.nodes:
        inside = node.tag in ("article", "main") or (node.parent >= 0 and labels[node.parent] == 1)
        away = node.tag in ("nav", "aside", "footer", "form") or outside & set(node.names.split())
        labels.append(int(inside and not away))
    return labels


def _words(rng: random.Random, n: int) -> str:
    parts = ("la ne mi ta ro vi so den ka lu per il an to re").split()
    text = " ".join("".join(rng.choices(parts, k=rng.randint(1, 4))) for _ in range(n))
    return text.capitalize() + rng.choice((".", ".", "?", "!", ""))


def _prose(rng: random.Random, paragraphs: int) -> str:
    return "".join(
        f"<p>{' '.join(_words(rng, rng.randint(4, 15)) for _ in range(rng.randint(1, 5)))}</p>"
        for _ in range(paragraphs)
    )


def _surrounding(rng: random.Random, role: str, name: str, tag: str) -> str:
    """An element of a role, marked so that its label is known."""
    own = "" if tag in ("nav", "footer", "header", "aside", "form") and rng.random() < 0.4 else f' class="{name}"'
    links = "".join(f'<li><a href="#">{_words(rng, rng.randint(1, 3))}</a></li>' for _ in range(rng.randint(2, 6)))
    if role in ("nav", "share"):
        inner = links if tag == "ul" else f"<ul>{links}</ul>"
    elif role == "comments":
        item = "li" if tag == "ol" else "div"
        inner = "".join(f"<{item}><p>{_words(rng, rng.randint(3, 20))}</p></{item}>" for _ in range(rng.randint(1, 4)))
    elif role == "form":
        inner = f"<p>{_words(rng, 4)}</p><input name=q>"
    elif role == "header":
        inner = rng.choice((f"<p>{_words(rng, 3)}</p>", f"<h1>{_words(rng, 2)}</h1><ul>{links}</ul>"))
    elif role == "aside":
        inner = rng.choice((f"<h3>{_words(rng, 2)}</h3><ul>{links}</ul>", _prose(rng, 1)))
    else:
        inner = rng.choice((_words(rng, rng.randint(3, 14)), f"<p>{_words(rng, rng.randint(4, 20))}</p>"))
    return f'<{tag}{own} data-out="1">{inner}</{tag}>'


def built_pages(seed: int = 11, rounds: int = 6) -> Iterator[tuple[Tree, list[int]]]:
    """Labelled pages: an article among what may surround it, under every listed name."""
    rng = random.Random(seed)
    every = [
        (role, name, tag) for role, (names, tags) in SURROUNDINGS.items() for name in names.split() for tag in tags.split()
    ]
    # The tags that say what they are come as often as all names together.
    articles = [(tag, name) for tag, names in ARTICLES.items() for name in (names.split() or [""] * 6)]
    for _ in range(rounds):
        rng.shuffle(every)
        turn = itertools.cycle(rng.sample(articles, len(articles)))
        for a in range(0, len(every), 4):
            around = [_surrounding(rng, *x) for x in every[a : a + 4]]
            tag, name = next(turn)
            title = f"<h1>{_words(rng, rng.randint(2, 8))}</h1>"
            body = title + _prose(rng, rng.randint(1, 4)) + (around.pop() if rng.random() < 0.4 else "")
            body += rng.choice(("", f"<h2>{_words(rng, 3)}</h2>", f"<ul><li>{_words(rng, 9)}</li></ul>", f"<blockquote>{_prose(rng, 1)}</blockquote>"))
            body += _prose(rng, rng.randint(0, 4))
            own = f' class="{name}"' if name else ""
            cut = rng.randint(0, len(around))
            inside = f'<{tag}{own} data-in="1">{body}</{tag}>'
            middle = "".join(around[:cut]) + inside + "".join(around[cut:])
            if rng.random() < 0.5:
                middle = f'<div class="{rng.choice(("wrapper", "container", "page", "row"))}">{middle}</div>'
            yield _labelled(f"<html><head><title>x</title></head><body>{middle}</body></html>")


def _labelled(page: str) -> tuple[Tree, list[int]]:
    marked = re.sub(r'( class="([^"]*)")? data-(in|out)="1"', r' class="\2 mark\3"', page)
    tree = parse(marked)
    labels: list[int] = []
    for node in tree.nodes:
        names = node.names.split()
        label = 1 if "markin" in names else 0 if "markout" in names else labels[node.parent] if node.parent >= 0 else 0
        labels.append(label)
        node.names = " ".join(x for x in names if not x.startswith("mark"))
    return tree, labels


def learn(pages: DataFrame, sample: int = SAMPLE) -> Model:
    marked = pages.where((F.length("html") <= TAUGHT_CHARS) & F.col("html").rlike("(?i)<(article|main)[ >]"))
    million = 1_000_000
    share = min(million, -(-million * sample // max(1, marked.count())))
    rows = marked.where(F.pmod(F.xxhash64("html"), F.lit(million)) < share).select("html").collect()
    own = [(tree, marked_labels(tree)) for tree in (parse(r["html"]) for r in rows)]
    taught = [*built_pages(), *own]
    random.Random(3).shuffle(taught)
    return train(taught)


def main_text(page: str | None, model: Model) -> str:
    """The blocks of the page whose element is content at least as likely as not."""
    if not page:
        return ""
    tree = parse(page)
    total, _ = beliefs(tree, model, score(tree, model))
    return "\n".join(text for node, text in tree.blocks if total[node] >= 0)


def _extract(model: Model) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(page, model) for page in batch["html"].to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [
                    batch["page_id"],
                    batch["url"],
                    pa.array(texts, pa.string()),
                    pa.array([len(t) for t in texts], pa.int64()),
                ],
                ["page_id", "url", "text", "n_chars"],
            )

    return run


def extracted(pages: DataFrame) -> DataFrame:
    """``(page_id, url, text, n_chars)`` of every row."""
    ship(pages.sparkSession)
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html")
    model = learn(rows.select("html"))
    fixed = Model(dict(model.weights), model.edges)
    return rows.mapInArrow(_extract(fixed), "page_id long, url string, text string, n_chars long")
