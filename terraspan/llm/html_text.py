"""Main text of web pages by a tree-structured graphical model over the blocks of a page.

A page is read into a tree of block elements (inline elements belong to the block around
them). Every block is content or not; its own features and a table of parent-child
potentials score the labelling of the whole tree. Messages pass from the leaves up and
from the root down (sum-product), which gives each block's exact probability of being
content. All trees of a batch pass their messages together, one depth after another.

Weights are fitted by gradient ascent on labelled pages, around a prior that knows the
usual names. Labelled are the pages that mark their article by a semantic element: a
bounded sample of at most ``SAMPLE`` pages, chosen by a hash of the page id. Every sampled
page is also used rewritten: the article under other element and class names, and with
inserted menus, notices, adverts, forms, side columns and comments made of the page's own
sentences, so that names and structure are learned instead of one page layout.
"""

from __future__ import annotations

import html
import re
import zlib
from collections import Counter
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .batches import annotate

SAMPLE = 400
ITERATIONS = 80
FIELDS = T.StructType([T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())])

# Element names by role, and usual names of classes and ids.
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header "
    "hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
SILENT = ("script", "style", "noscript", "template", "title", "iframe", "svg", "math", "textarea", "select", "button", "object", "canvas", "head")
INSIDE = {"li": ("ul", "ol", "menu"), "dt": ("dl",), "dd": ("dl",), "tr": ("table",), "td": ("tr",), "th": ("tr",), "tbody": ("table",), "thead": ("table",), "tfoot": ("table",)}
SIBLINGS = {"dt": ("dt", "dd"), "dd": ("dt", "dd"), "td": ("td", "th"), "th": ("td", "th"), "tbody": ("tbody", "thead", "tfoot"), "thead": ("tbody", "thead"), "tfoot": ("tbody", "thead")}
BOILERPLATE = frozenset(
    "ad ads advert advertisement advertising adverts alert aside author banner bar bottom breadcrumb breadcrumbs button byline comment comments consent "
    "contact cookie cookies copyright cta disclaimer discussion disqus download dropdown feedback foot footer form gdpr head header legal links list login "
    "masthead menu menubar meta modal nav navbar navigation newsletter note notice notification overlay pager pagination popup popular privacy profile promo "
    "promoted promotion rating recommended register related reply respond responses review search share sharing shop sidebar sidenav signup site skip social "
    "sponsor sponsored subscribe tags teaser toc tool toolbar tools top topbar trending warning widget widgets".split()
)
CONTENT = frozenset("article articlebody body content entry main page paragraph post prose story text".split())

LANDMARKS = frozenset("nav footer aside form header article main".split())

_TOKEN = re.compile(
    r"<!--.*?(?:--!?>|\Z)|<!\[CDATA\[(?P<data>.*?)(?:\]\]>|\Z)|<[!?][^>]*>"
    r"|<(?P<close>/?)(?P<name>[A-Za-z][^\s/>]*)(?P<attrs>(?:[^>\"']++|\"[^\"]*\"|'[^']*')*+)>"
    r"|<(?P<close2>/?)(?P<name2>[A-Za-z][^\s/>]*)(?P<attrs2>[^>]*)>", re.S
)
_NAMES = re.compile(r"""(?:^|[\s"'])(class|id|role|itemprop|data-label)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
_SILENT_END = {name: re.compile(rf"</{name}(?![A-Za-z0-9-])[^>]*>", re.I) for name in SILENT}


@dataclass
class Page:
    """Blocks of a page in order of their start, and pieces of text with the block they belong to."""

    parent: list[int] = field(default_factory=lambda: [-1])
    tag: list[str] = field(default_factory=lambda: ["html"])
    depth: list[int] = field(default_factory=lambda: [0])
    names: list[tuple[str, ...]] = field(default_factory=lambda: [()])
    label: list[str | None] = field(default_factory=lambda: [None])
    pieces: list[tuple[int, str]] = field(default_factory=list)
    size: list[int] = field(default_factory=lambda: [0])
    linked: list[int] = field(default_factory=lambda: [0])
    ends: list[int] = field(default_factory=lambda: [0])  # signs that end sentences


def read_page(source: str) -> Page:
    """Read markup of any quality; nothing raises."""
    page = Page()
    stack: list[tuple[str, int]] = [("html", 0)]  # open elements with their block, -1 for inline ones
    block, links, words = 0, 0, []

    def flush() -> None:
        if words:
            value = " ".join("".join(words).split())
            words.clear()
            if value:
                page.pieces.append((block, value))
                page.size[block] += len(value)
                page.ends[block] += value.count(". ") + value.endswith((".", "!", "?", "…", ":"))

    def cut(depth: int) -> int:
        """Close all elements from ``depth`` on; returns the block that is then open."""
        nonlocal links
        flush()
        for name, _ in stack[depth:]:
            links -= name == "a"
        del stack[depth:]
        return next(b for _, b in reversed(stack) if b >= 0)

    at, token = 0, _TOKEN.search(source)
    while True:
        chunk = source[at : token.start() if token else len(source)]
        if chunk:
            value = html.unescape(chunk) if "&" in chunk else chunk
            words.append(value)
            if links:
                page.linked[block] += len(value)
        if token is None:
            break
        at = token.end()
        name = (token["name"] or token["name2"] or "").lower()
        if token["data"]:
            words.append(token["data"])
        if name and not (token["close"] or token["close2"]):
            attrs = token["attrs"] or token["attrs2"] or ""
            if name in _SILENT_END:
                # a head without an end would swallow the page, so only its own silent elements go
                end = _SILENT_END[name].search(source, at) if name != "head" else None
                if end:
                    at = end.end()
                elif name in ("script", "style"):
                    at = len(source)
            elif name in BLOCKS:
                if name != "html" or len(stack) > 1:
                    block = cut(_implied(stack, name))
                    words_of, label = _attributes(attrs) if "=" in attrs else ((), None)
                    page.parent.append(block)
                    page.tag.append(name)
                    page.depth.append(page.depth[block] + 1)
                    page.names.append(words_of)
                    page.label.append(label)
                    page.size.append(0)
                    page.linked.append(0)
                    page.ends.append(0)
                    if name not in VOID:
                        block = len(page.tag) - 1
                        stack.append((name, block))
            elif name in VOID:
                words.append(" ")
            elif not attrs.endswith("/"):
                stack.append((name, -1))
                links += name == "a"
        elif name:
            depth = next((i for i in range(len(stack) - 1, 0, -1) if stack[i][0] == name), 0)
            if depth and name in BLOCKS:
                block = cut(depth)
            elif depth and all(b < 0 for _, b in stack[depth:]):
                for gone, _ in stack[depth:]:
                    links -= gone == "a"
                del stack[depth:]
            elif depth:  # an inline element that was left open around blocks
                links -= name == "a"
                del stack[depth]
        token = _TOKEN.search(source, at)
    flush()
    return page


def _implied(stack: list[tuple[str, int]], name: str) -> int:
    """Number of open elements that stay when a block of this name starts."""
    if name in INSIDE:
        same = SIBLINGS.get(name, (name,))
        for i in range(len(stack) - 1, 0, -1):
            if stack[i][0] in same:
                return i
            if stack[i][0] in INSIDE[name]:
                break
    for i in range(len(stack) - 1, 0, -1):
        if stack[i][0] == "p":
            return i
        if stack[i][1] >= 0:
            break
    return len(stack)


def _attributes(attrs: str) -> tuple[tuple[str, ...], str | None]:
    found, label = [], None
    for m in _NAMES.finditer(attrs):
        value = m[2] or m[3] or m[4] or ""
        if m[1].lower() == "data-label":
            label = value
        else:
            found += [w.lower() for w in _WORD.findall(value)]
    return tuple(dict.fromkeys(found)), label


def _bucket(n: float) -> int:
    return int(n).bit_length()


def features(page: Page) -> list[list[str]]:
    """What is known of each block: names, own text, text below."""
    n = len(page.tag)
    below, links, kids = list(page.size), list(page.linked), [0] * n
    for i in range(n - 1, 0, -1):
        p = page.parent[i]
        below[p] += below[i]
        links[p] += links[i]
        kids[p] += 1
    out, around = [], [()] * n
    for i in range(n):
        if i:
            p = page.parent[i]
            around[i] = around[p] if page.tag[p] not in LANDMARKS else tuple(dict.fromkeys((*around[p], page.tag[p])))
        tag, up = page.tag[i], page.tag[page.parent[i]] if i else ""
        own = page.size[i]
        rows = ["bias", f"tag={tag}", f"under={up}>{tag}", f"own={_bucket(own)}", f"below={_bucket(below[i])}", f"kids={_bucket(kids[i])}"]
        if own:
            rows.append(f"linked={min(4, 4 * page.linked[i] // own)}")
            rows.append(f"ends={min(3, page.ends[i])}")
        if below[i]:
            rows.append(f"links={min(4, 4 * links[i] // below[i])}")
        rows += [f"inside={t}" for t in around[i]]
        for w in page.names[i]:
            rows.append(f"name={w}")
            if w in BOILERPLATE:
                rows.append("boilerplate")
            if w in CONTENT:
                rows.append("content")
        out.append(rows)
    return out


def _prior(feature: str) -> float:
    kind, _, value = feature.partition("=")
    if kind == "tag":
        return {"nav": -3.0, "footer": -3.0, "aside": -3.0, "form": -3.0, "menu": -3.0, "fieldset": -2.0, "html": -2.0, "body": -1.0, "article": 2.0, "main": 2.0, "p": 0.5}.get(value, 0.0)
    if kind == "inside":
        return {"nav": -2.5, "footer": -2.5, "aside": -2.5, "form": -2.5}.get(value, 0.0)
    return {"boilerplate": -2.5, "content": 1.5}.get(kind, 0.0)


EDGE_PRIOR = np.array([[1.5, -1.0], [-0.5, 1.0]])  # parent label, child label


class Forest:
    """Trees of several pages whose blocks pass messages together, depth by depth."""

    def __init__(self, pages: list[Page]):
        sizes = [len(p.tag) for p in pages]
        base = np.cumsum(sizes) - sizes
        self.parent = np.concatenate([np.array(p.parent) + b for p, b in zip(pages, base)]) if pages else np.zeros(0, np.int64)
        depth = np.concatenate([np.array(p.depth) for p in pages]) if pages else np.zeros(0, np.int64)
        self.n = len(depth)
        order = np.argsort(depth, kind="stable")
        cuts = np.flatnonzero(np.diff(depth[order])) + 1
        self.levels = np.split(order, cuts)

    def beliefs(self, unary: np.ndarray, edge: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Log beliefs of each block, and of each block with its parent (parent label first)."""
        up = unary.copy()
        sent = np.zeros((self.n, 2))
        for level in self.levels[:0:-1]:
            sent[level] = np.logaddexp(up[level, 0, None] + edge[None, :, 0], up[level, 1, None] + edge[None, :, 1])
            np.add.at(up, self.parent[level], sent[level])
        full, pairs = up.copy(), np.zeros((self.n, 2, 2))
        for level in self.levels[1:]:
            rest = full[self.parent[level]] - sent[level]
            pairs[level] = rest[:, :, None] + edge[None] + up[level][:, None, :]
            full[level] = np.logaddexp(pairs[level][:, 0], pairs[level][:, 1])
        return full, pairs


def _shares(logs: np.ndarray) -> np.ndarray:
    flat = logs.reshape(len(logs), -1)
    out = np.exp(flat - flat.max(axis=1, keepdims=True))
    return (out / out.sum(axis=1, keepdims=True)).reshape(logs.shape)


@dataclass
class Model:
    weights: dict[str, float]
    edge: np.ndarray

    def content(self, pages: list[Page]) -> np.ndarray:
        """Probability of being content for each block of the pages."""
        unary = np.zeros((sum(len(p.tag) for p in pages), 2))
        get = self.weights.get
        unary[:, 1] = [sum(get(f, 0.0) for f in row) for p in pages for row in features(p)]
        full, _ = Forest(pages).beliefs(unary, self.edge)
        return _shares(full)[:, 1] if len(full) else np.zeros(0)


def fit(pages: list[Page], labels: list[list[int]], iterations: int = ITERATIONS) -> Model:
    """Most probable weights given labelled blocks and the prior."""
    rows = [row for p in pages for row in features(p)]
    count = Counter(f for row in rows for f in row)
    known = sorted(f for f, n in count.items() if n >= 5 or _prior(f))
    prior = np.array([_prior(f) for f in known])
    common = {f"tag={t}": _prior(f"tag={t}") for t in BLOCKS} | {f"inside={t}": _prior(f"inside={t}") for t in LANDMARKS} | {"boilerplate": _prior("boilerplate"), "content": _prior("content")}
    weights, edge = prior.copy(), EDGE_PRIOR.copy()
    if pages:
        number = {f: i for i, f in enumerate(known)}
        at, f = map(np.array, zip(*[(i, number[x]) for i, row in enumerate(rows) for x in row if x in number]))
        truth = np.array([y for ys in labels for y in ys])
        forest = Forest(pages)
        child = np.setdiff1d(np.arange(forest.n), forest.levels[0])
        seen = np.zeros((2, 2))
        np.add.at(seen, (truth[forest.parent[child]], truth[child]), 1)
        scale = 1.0 / len(truth)
        first, second = [np.zeros_like(weights), np.zeros_like(edge)], [np.zeros_like(weights), np.zeros_like(edge)]
        for step in range(1, iterations + 1):
            unary = np.zeros((forest.n, 2))
            unary[:, 1] = np.bincount(at, weights=weights[f], minlength=forest.n)
            full, pairs = forest.beliefs(unary, edge)
            expected = _shares(full)[:, 1]
            slope = [
                np.bincount(f, weights=(truth - expected)[at], minlength=len(known)) * scale - 1e-3 * (weights - prior),
                (seen - _shares(pairs[child]).sum(axis=0)) * scale - 1e-3 * (edge - EDGE_PRIOR),
            ]
            for k, target in enumerate((weights, edge)):  # Adam steps
                first[k] = 0.9 * first[k] + 0.1 * slope[k]
                second[k] = 0.99 * second[k] + 0.01 * slope[k] ** 2
                target += 0.1 * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.99**step)) + 1e-8)
    return Model(common | dict(zip(known, weights.tolist())), edge)


_ARTICLE = re.compile(r"<(article|main)\b[^>]*>", re.I)
_SENTENCE = re.compile(r"[^<>.!?]{20,200}[.!?]")
_NOISE = (
    ("nav", "menu navigation", "list"), ("div", "{b} {b}", "list"), ("aside", "sidebar", "text"), ("div", "{b}", "text"), ("div", "{b}-{b}", "text"),
    ("section", "comments", "comment"), ("div", "comments-area discussion", "comment"), ("form", "search newsletter", "form"), ("div", "cookie notice", "text"),
    ("header", "site-header", "list"), ("footer", "site-footer", "text"), ("div", "ad", "text"), ("section", "related", "list"), ("ul", "share social", "list"),
    ("aside", "", "text"), ("form", "", "form"), ("section", "{b}", "comment"),
)
_FRAMES = (("div", "content"), ("div", "post entry"), ("main", ""), ("section", "article-body"), ("div", "story-text"), ("article", "post"), ("div", "main"), ("div", ""))


def _noise(pick: int, sentences: list[str]) -> str:
    tag, names, kind = _NOISE[pick % len(_NOISE)]
    words = sorted(BOILERPLATE)
    for k in range(2):
        names = names.replace("{b}", words[(pick // 7 + 31 * k) % len(words)], 1)
    said = [sentences[(pick + k) % len(sentences)] for k in range(1 + pick % 4)] if sentences else ["More."]
    if kind == "list":
        inner = "<ul>" + "".join(f'<li><a href="#">{" ".join(s.split()[:3])}</a></li>' for s in said * 2) + "</ul>"
    elif kind == "comment":
        inner = "<h3>" + " ".join(said[0].split()[:2]) + "</h3>" + "".join(f'<div class="comment"><b>{s.split()[0]}</b><p>{s}</p></div>' for s in said)
    elif kind == "form":
        inner = f"<label>{' '.join(said[0].split()[:4])}</label><input><p>{said[-1]}</p>"
    else:
        inner = "".join(f"<p>{s}</p>" for s in said)
    return f'<{tag} class="{names}" data-label="0">{inner}</{tag}>'


def labelled(source: str, pick: int) -> list[tuple[Page, list[int]]]:
    """A page that marks its article, as it is and rewritten, with the label of every block; none if it marks none."""
    start = _ARTICLE.search(source)
    end = source.lower().rfind(f"</{start[1].lower()}") if start else -1
    if end < 0 or start.end() > end:
        return []
    head, body, tail = source[: start.start()], source[start.end() : end], source[end:]
    tail = tail[tail.index(">") + 1 :] if ">" in tail else ""
    sentences = _SENTENCE.findall(re.sub(r"<[^>]*>", " ", body))[:50]
    variants = [f'{head}<{start[1]} data-label="1">{body}</{start[1]}>{tail}']
    frame, names = _FRAMES[pick % len(_FRAMES)]
    before, within, after = ("".join(_noise(pick // d + k, sentences) for k in range(1 + pick // (d + 1) % 3)) for d in (3, 5, 11))
    if pick % 3 == 1 and sentences:  # part of the article as a list, a quotation and a table
        said = [sentences[(pick + k) % len(sentences)] for k in range(6)]
        within = f"<h2>{' '.join(said[0].split()[:4])}</h2><ul><li>{said[1]}</li><li>{said[2].split()[0]}</li></ul><blockquote>{said[3]}</blockquote>{within}"
        within = f"<table><tr><td>{said[4].split()[0]}</td><td>{said[5]}</td></tr></table>{within}"
    variants.append(f'{head}{before}<{frame} class="{names}" data-label="1">{body}{within}</{frame}>{after}{tail}')
    if sentences:  # a very short article
        said = sentences[pick % len(sentences)]
        few = f"<h1>{' '.join(said.split()[:5])}</h1>" * (pick % 2) + f"<p>{' '.join(said.split()[: 2 + pick % 9])}.</p>"
        variants.append(f'{head}<{start[1]} data-label="1">{few}</{start[1]}>{tail}')
        variants.append(f'<body>{before * (pick % 2)}<{frame} class="{names}" data-label="1">{few}{_noise(pick // 13, sentences) * (pick % 3 == 0)}</{frame}>{after}</body>')
    out = []
    for variant in variants:
        page = read_page(variant)
        labels: list[int] = []
        for i, own in enumerate(page.label):
            out_of = labels[page.parent[i]] if i else 0
            labels.append(int(own) if own in ("0", "1") else 0 if page.tag[i] in ("nav", "aside", "form", "footer") else out_of)
        out.append((page, labels))
    return out


def train(pages: DataFrame, page_id: str = "page_id", source: str = "html", sample: int = SAMPLE) -> Model:
    """Fit on at most ``sample`` labelled pages."""
    marked = pages.filter(F.col(source).rlike(r"(?i)<(article|main)\b")).select(F.col(page_id).cast("string").alias("_id"), F.col(source).alias("_source"))
    # ids are drawn first, so that tasks send ids and not pages
    keyed = marked.withColumn("_key", F.xxhash64("_source"))
    drawn = keyed.select(F.col("_id").alias("_drawn"), F.col("_key").alias("_drawn_key")).distinct()
    drawn = drawn.orderBy(F.xxhash64("_drawn"), "_drawn", "_drawn_key").limit(sample)
    same = F.col("_id").eqNullSafe(F.col("_drawn")) & (F.col("_key") == F.col("_drawn_key"))
    rows = keyed.join(F.broadcast(drawn), same).select("_id", "_source").distinct().collect()
    cases = [case for r in sorted(map(tuple, rows), key=str) for case in labelled(r[1], zlib.crc32(str(r[0]).encode()))]
    return fit([p for p, _ in cases], [y for _, y in cases])


def extract(model: Model, sources: list[str | None]) -> list[str]:
    """Main text of each page: pieces of content blocks in page order, one a line."""
    pages = [read_page(s or "") for s in sources]
    chances = model.content(pages)
    out, base = [], 0
    for page in pages:
        out.append("\n".join(value for block, value in page.pieces if chances[base + block] > 0.5))
        base += len(page.tag)
    return out


def extract_text(pages: DataFrame, page_id: str = "page_id", source: str = "html", sample: int = SAMPLE) -> DataFrame:
    """``pages`` with ``text`` and ``n_chars`` (code points); every row is kept.

    A null or empty page, and one without content, has an empty text. Markup may be broken
    in any way. Repeated rows come out alike. Columns of ``pages`` that bear one of the
    added names are replaced. Without a labelled page the prior decides.
    """
    shared = pages.sparkSession.sparkContext.broadcast(train(pages, page_id, source, sample))

    def kernel(column: pa.Array) -> dict:
        sources = column.to_pylist()
        texts = [t for at in range(0, len(sources), 200) for t in extract(shared.value, sources[at : at + 200])]
        return {"text": texts, "n_chars": [len(t) for t in texts]}

    return annotate(pages, source, FIELDS, lambda: kernel)
