"""Main text of web pages by a tree-structured graphical model over the DOM.

Every element and every piece of text is a binary variable: does it hold main content? Its tag, its class names and its
text give a potential, and each parent and child share one. Sum-product messages go up and down the tree, for all pages
of a batch at once, and give each piece of text its exact marginal. The potentials are trained on labelled pages.
"""

from __future__ import annotations

import html as entities
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ragloom.llm.common import pieces
from ragloom.llm.html_pages import labelled_pages

PIECE_BYTES = 1 << 20
TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*+(?:>|\Z)"
    r"|<(?P<end>/?)(?P<tag>[a-zA-Z][^\s/>]*+)(?P<rest>(?:[^>\"']|\"[^\"]*+(?:\"|\Z)|'[^']*+(?:'|\Z))*+)(?:>|\Z)",
    re.S,
)
ATTRIBUTE = re.compile(r"([^\s=/\"'>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose content is no text of the page.
DROPPED = set("script style template title textarea iframe svg canvas audio video".split())
#: Those of them that hold no elements: they end at their first end tag.
RAW = set("script style title textarea iframe".split())
#: Those that HTML parsers leave at the start tags of LEAVES, or where an element around them ends, unless inside HOSTS.
FOREIGN = {"svg"}
HOSTS = set("foreignobject desc title annotation-xml mi mo mn ms mtext".split())
LEAVES = set(
    "b big blockquote body br center code dd div dl dt em embed h1 h2 h3 h4 h5 h6 head hr i img li listing menu meta nobr "
    "ol p pre ruby s small span strong strike sub sup table tt u ul var article section main header footer nav aside "
    "figure form".split()
)
INLINE = set(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span "
    "strike strong sub sup time tt u var button br img wbr input select option".split()
)
#: A start tag of the key closes an open element of the value, up to the nearest element that bounds the search.
CLOSES = {
    "li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}),
    "option": ({"option"}, {"select"}),
}
GROUPS = {
    tag: number
    for number, tags in enumerate(
        [
            "body html #root", "article", "main", "section", "div center td th tr table tbody thead tfoot", "p pre blockquote",
            "h1", "h2 h3 h4 h5 h6", "ul ol dl menu", "li dt dd", "nav", "header", "footer", "aside dialog",
            "form fieldset select option button input label textarea", "figure figcaption", "#text", "#inline", "head",
            "#inner-header",
        ]
    )
    for tag in tags.split()
}
OTHER = len(set(GROUPS.values()))
TEXT = GROUPS["#text"]
#: Class, id and role names by what they say about an element.
NAMES = [
    re.compile(p)
    for p in (
        r"\b(nav|navbar|navs|menus?|toc|pager|tabs?)\b|\b(navigation|breadcrumb|pagination|topnav|sitenav|mainmenu)",
        r"\b(footer|copyright|contentinfo|imprint|colophon|bottombar)|\blegal\b",
        r"\b(header|masthead|banner|topbar|branding)|\blogo\b",
        r"\b(sidebar|sidenav|widget|related|recommend|trending|teaser|complementary)|\b(aside|popular|rail)\b",
        r"\b(ads?|adsense|adbox|adslot)\b|\b(advert|promo|sponsor|commercial|doubleclick)",
        r"\b(cookie|consent|notice|notif|popup|modal|overlay|dialog|disclaimer|paywall|gdpr)|\balerts?\b",
        r"\b(comment|disqus|discussion|respond|response|feedback|guestbook|reply|replies)|\breviews?\b",
        r"\b(share|sharing|social|newsletter|subscri|signup|login|toolbar)|\b(follow|search|form|buttons?)\b",
        r"\b(content|articles?|posts?|entry|story|text|main|body|prose|hentry)\b",
    )
]
FEATURES = OTHER + 1 + len(NAMES) + 7


@dataclass
class Page:
    """A DOM in document order: parents come before children; texts are leaves with their block number."""

    parents: list[int] = field(default_factory=list)
    groups: list[int] = field(default_factory=list)
    names: list[str] = field(default_factory=list)
    labels: list[int] = field(default_factory=list)
    texts: list[list[str] | None] = field(default_factory=list)
    linked: list[int] = field(default_factory=list)
    blocks: list[int] = field(default_factory=list)

    def add(self, parent: int, group: int, names: str, label: int, block: int = -1) -> int:
        self.parents.append(parent)
        self.groups.append(group)
        self.names.append(names)
        self.labels.append(label)
        self.texts.append([] if block >= 0 else None)
        self.linked.append(0)
        self.blocks.append(block)
        return len(self.parents) - 1


def _attributes(rest: str) -> tuple[str, str, bool]:
    """Names in class, id and role; the training label; whether the element is hidden."""
    names, label, hidden = [], "", False
    for m in ATTRIBUTE.finditer(rest):
        key, value = m[1].lower(), m[2] or m[3] or m[4] or ""
        if key in ("class", "id", "role"):
            names.append(value)
        elif key == "y":
            label = value
        elif key == "hidden":
            hidden = True
    return re.sub(r"[^a-z]+", " ", re.sub(r"([a-z])([A-Z])", r"\1 \2", " ".join(names)).lower()), label, hidden


def _after(source: str, at: int, tag: str, around: set[str]) -> int:
    """Where the page goes on after a dropped element whose start tag ends at `at`, inside open elements `around`."""
    size = len(source)
    if tag in RAW:
        close = re.compile(rf"</{re.escape(tag)}\b[^>]*(?:>|\Z)", re.I).search(source, at)
        return close.end() if close else size
    inside, count = [tag], Counter([tag])
    while (start := source.find("<", at)) >= 0:
        m = TOKEN.match(source, start)
        at = m.end() if m else start + 1
        if m is None or m["tag"] is None:
            continue
        name = m["tag"].lower()
        foreign = tag in FOREIGN and not any(count[h] for h in HOSTS)
        if m["end"]:
            if count[name]:
                while (last := inside.pop()) != name:
                    count[last] -= 1
                count[name] -= 1
                if not inside:
                    return at
            elif foreign and name in around:
                return start
        elif foreign and name in LEAVES:
            return start
        elif m["rest"].endswith("/") or name in VOID:
            continue
        elif name in RAW and not foreign:
            at = _after(source, at, name, around)
        else:
            inside.append(name)
            count[name] += 1
    return size


def parse(source: str, labelled: bool = False) -> Page:
    """Build the tree; markup may be broken or cut anywhere. Only training pages are `labelled`, by an attribute `y`."""
    page = Page()
    root = page.add(-1, GROUPS["#root"], "", 0)
    stack: list[tuple[str, int, int]] = [("#root", root, 0)]  # tag, node, label
    opened: Counter[str] = Counter()  # how often each tag is in the stack
    leaves: dict[tuple[int, int], int] = {}
    block, links, at, size = 0, 0, 0, len(source)

    def text(raw: str) -> None:
        if not raw:
            return
        _, node, label = stack[-1]
        leaf = leaves.get((node, block))
        if leaf is None:
            leaf = leaves[node, block] = page.add(node, TEXT, "", label, block)
        value = entities.unescape(raw) if "&" in raw else raw
        page.texts[leaf].append(value)
        if links:
            page.linked[leaf] += len(value)

    def pop_to(depth: int) -> None:
        nonlocal links, block
        while len(stack) > depth:
            tag, _, _ = stack.pop()
            opened[tag] -= 1
            links -= tag == "a"
            block += tag not in INLINE

    while at < size:
        start = source.find("<", at)
        if start < 0:
            text(source[at:])
            break
        m = TOKEN.match(source, start)
        if m is None:
            text(source[at : start + 1])
            at = start + 1
            continue
        text(source[at:start])
        at = m.end()
        if m["tag"] is None:
            continue
        tag = m["tag"].lower()
        if m["end"]:
            if not opened[tag]:
                block += tag not in INLINE
                continue
            depth = len(stack) - 1
            while stack[depth][0] != tag:
                depth -= 1
            pop_to(depth)
            continue
        if tag in DROPPED:
            if not m["rest"].endswith("/"):
                at = _after(source, at, tag, {t for t, n in opened.items() if n} if tag in FOREIGN else set())
            continue
        if tag == "br":
            text(" ")
            continue
        if tag in VOID:
            block += tag not in INLINE
            continue
        if tag not in INLINE:
            block += 1
            shut, bounds = CLOSES.get(tag, ({"p"}, {"td", "th", "li", "div", "article", "section", "blockquote"}))
            for depth in range(len(stack) - 1, 0, -1) if any(opened[t] for t in shut) else ():
                if stack[depth][0] in shut:
                    pop_to(depth)
                    break
                if stack[depth][0] in bounds:
                    break
        elif tag == "a" and links:  # links don't nest
            for depth in range(len(stack) - 1, 0, -1):
                if stack[depth][0] == "a":
                    pop_to(depth)
                    break
        names, label_name, hidden = _attributes(m["rest"]) if m["rest"] else ("", "", False)
        if hidden:
            names += " notice"
        _, parent, label = stack[-1]
        if labelled and label_name:
            label = int(label_name)
        if tag in INLINE and not names.strip() and tag not in ("button", "label", "select", "option"):
            node = parent
        else:
            own = "#inline" if tag in INLINE and tag not in GROUPS else tag
            if tag == "header" and (opened["article"] or opened["main"]):
                own = "#inner-header"
            node = page.add(parent, GROUPS.get(own, OTHER), names, label)
        if not m["rest"].endswith("/"):
            stack.append((tag, node, label))
            opened[tag] += 1
            links += tag == "a"
    return page


def _features(pages: list[Page]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Features, parents (-1: root) and groups of all nodes of all pages."""
    rows = sum(len(p.parents) for p in pages)
    x, parents, groups = np.zeros((rows, FEATURES), np.float32), np.empty(rows, np.int64), np.empty(rows, np.int64)
    first = 0
    text_at = OTHER + 1 + len(NAMES)
    for page in pages:
        for n, (parent, group, names, texts) in enumerate(zip(page.parents, page.groups, page.names, page.texts, strict=True)):
            row = x[first + n]
            parents[first + n] = parent + first if parent >= 0 else -1
            groups[first + n] = group
            row[group] = 1
            if names:
                for k, pattern in enumerate(NAMES):
                    if pattern.search(names):
                        row[OTHER + 1 + k] = 1
            if texts is not None:
                value = "".join(texts)
                length = len(value.strip())
                row[text_at] = min(np.log1p(length) / 8, 1)
                row[text_at + 1] = page.linked[n] / max(len(value), 1)
                row[text_at + 2] = length < 25
                row[text_at + 3] = "\N{COPYRIGHT SIGN}" in value
                row[text_at + 4] = value.rstrip().endswith((".", "!", "?", ":", '"'))
                row[text_at + 5] = length > 120
            row[text_at + 6] = 1
        first += len(page.parents)
    return x, parents, groups


def _depths(parents: np.ndarray) -> list[np.ndarray]:
    """Node numbers by depth; parents come before children."""
    depth = np.zeros(len(parents), np.int64)
    for n, parent in enumerate(parents.tolist()):
        if parent >= 0:
            depth[n] = depth[parent] + 1
    order = np.argsort(depth, kind="stable")
    cuts = np.searchsorted(depth[order], np.arange(1, depth.max(initial=0) + 1))
    return np.split(order, cuts)


def marginals(unary: np.ndarray, pair: np.ndarray, parents: np.ndarray, groups: np.ndarray):
    """Sum-product on a forest. `unary` (nodes, 2) and `pair` (groups, parent label, child label) are log potentials.

    Returns the log marginals of nodes (nodes, 2) and of edges (nodes, parent label, child label; roots are unused).
    """
    levels = _depths(parents)
    belief, up = unary.copy(), np.zeros_like(unary)
    for nodes in reversed(levels[1:]):
        up[nodes] = np.logaddexp.reduce(pair[groups[nodes]] + belief[nodes][:, None, :], axis=2)
        np.add.at(belief, parents[nodes], up[nodes])
    down, edges = np.zeros_like(unary), np.zeros((len(unary), 2, 2))
    for nodes in levels[1:]:
        above = parents[nodes]
        outside = belief[above] + down[above] - up[nodes]
        joint = outside[:, :, None] + pair[groups[nodes]]
        down[nodes] = np.logaddexp.reduce(joint, axis=1)
        joint = joint + belief[nodes][:, None, :]
        edges[nodes] = joint - np.logaddexp.reduce(joint.reshape(len(nodes), 4), axis=1)[:, None, None]
    whole = belief + down
    return whole - np.logaddexp.reduce(whole, axis=1)[:, None], edges


@dataclass
class Model:
    weights: np.ndarray
    pair: np.ndarray


def _with_elements(page: Page) -> np.ndarray:
    """Training labels: a text has its own, an element is content where a text below it is."""
    labels = np.array([y if t is not None else 0 for y, t in zip(page.labels, page.texts, strict=True)])
    for n in range(len(labels) - 1, 0, -1):
        labels[page.parents[n]] |= labels[n]
    return labels


def train(sources: list[str] | None = None, steps: int = 300, decay: float = 1e-3) -> Model:
    """Fit all potentials to labelled pages by the gradient of the log likelihood: observed less expected counts."""
    pages = [parse(s, labelled=True) for s in (labelled_pages() if sources is None else sources)]
    x, parents, groups = _features(pages)
    y = np.concatenate([_with_elements(p) for p in pages])
    weights, pair = np.zeros(FEATURES), np.zeros((OTHER + 1, 2, 2))
    child = parents >= 0
    moments = [np.zeros_like(weights), np.zeros_like(weights), np.zeros_like(pair), np.zeros_like(pair)]
    observed = np.zeros_like(pair)
    np.add.at(observed, (groups[child], y[parents[child]], y[child]), 1)
    for step in range(1, steps + 1):
        unary = np.stack([np.zeros(len(y)), x @ weights], axis=1)
        nodes, edges = marginals(unary, pair, parents, groups)
        expected = np.zeros_like(pair)
        np.add.at(expected, groups[child], np.exp(edges[child]))
        grads = [x.T @ (y - np.exp(nodes[:, 1])) / len(pages) - decay * weights, (observed - expected) / len(pages) - decay * pair]
        for n, (p, g) in enumerate(zip((weights, pair), grads, strict=True)):
            m, v = moments[2 * n], moments[2 * n + 1]
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            p += 0.1 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    return Model(weights, pair)


def texts_of(model: Model, sources: list[str]) -> list[str]:
    """Main text of each page: blocks in page order, white space inside turned into one space, joined by one space."""
    pages = [parse(s) for s in sources]
    x, parents, groups = _features(pages)
    unary = np.stack([np.zeros(len(x)), x @ model.weights], axis=1)
    content = marginals(unary, model.pair, parents, groups)[0][:, 1] > np.log(0.5)
    out, first = [], 0
    for page in pages:
        blocks: dict[int, list[str]] = {}
        for n, (texts, block) in enumerate(zip(page.texts, page.blocks, strict=True)):
            if texts is not None and content[first + n]:
                blocks.setdefault(block, []).extend(texts)
        first += len(page.parents)
        found = (" ".join("".join(blocks[b]).split()) for b in sorted(blocks))
        out.append(" ".join(b for b in found if b))
    return out


def extract(
    pages: DataFrame, model: Model | None = None, id_column: str = "page_id", url: str = "url", html: str = "html"
) -> DataFrame:
    """(page_id, url, text, n_chars): the main text of every whole page.

    A null or empty page, and one without main content, gives the empty text. Markup that is broken or cut is read as
    far as it goes. Rows are independent, so repeated ones give the same text.
    """
    model = model or train()
    sent = pages.select(
        F.col(id_column).alias("page_id"), F.col(url).alias("url"), F.coalesce(F.col(html), F.lit("")).alias("html")
    )
    schema = T.StructType(
        [*sent.schema.fields[:2], T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in pieces(whole, "html", PIECE_BYTES):
                texts = texts_of(model, batch.column("html").to_pylist())
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                    ["page_id", "url", "text", "n_chars"],
                )

    return sent.mapInArrow(run, schema)
