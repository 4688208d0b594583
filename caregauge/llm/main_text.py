"""Main text of web pages: content marginals of a tree-structured graphical model over DOM nodes."""

from __future__ import annotations

import random
import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from caregauge.llm import page_layouts
from caregauge.llm.common import hash_sample, slices
from caregauge.llm.dom import Page, parse

#: Labelled pages that the model is fitted on, at most.
LABELLED_PAGES = 200
#: Steps of the fit, their size, and the weight that holds its figures small.
STEPS, RATE, DECAY = 150, 0.2, 1e-3
#: Nodes whose marginals are computed together, about.
BATCH_NODES = 20_000

# Names in class, id and role that tell what an element is for.
NAMES = {
    "content": "article articlebody body content entry main post primary prose story text",
    "menu": "breadcrumb breadcrumbs menu nav navbar navigation pager pagination tabs toc toolbar",
    "header": "header masthead topbar branding",
    "footer": "colophon copyright footer legal",
    "side": "aside complementary related recommended recommendations rail share sharing side sidebar social widget tags trending",
    "advert": "ad ads advert advertisement adverts adbox banner promo promotion sponsor sponsored",
    "notice": "alert banner consent cookie cookies gdpr modal newsletter notice notification overlay paywall popup subscribe subscription",
    "form": "form login search searchform signin signup",
    "comment": "comment comments commentlist discussion disqus reply replies respond responses",
}
# Elements by their part in a page.
TAGS = {
    "article": "article main",
    "paragraph": "p pre blockquote",
    "heading": "h1 h2 h3 h4 h5 h6 hgroup",
    "container": "div section body center",
    "list": "ul ol dl menu dir",
    "item": "li dd dt",
    "table": "table tbody thead tfoot tr",
    "cell": "td th caption",
    "menu": "nav",
    "header": "header",
    "footer": "footer address",
    "aside": "aside dialog details summary",
    "form": "form fieldset legend",
    "figure": "figure figcaption",
    "run": "#text",
}
_NAME_OF = {word: k for k, words in enumerate(NAMES.values()) for word in words.split()}
_TAG_OF = {tag: k for k, tags in enumerate(TAGS.values()) for tag in tags.split()}
_N_TAGS, _N_NAMES = len(TAGS), len(NAMES)
_WORD = re.compile(r"[a-z]+|[A-Z]+[a-z]*")
_LENGTHS, _LINKS, _SHARES = np.array([15, 60, 200, 800]), np.array([0.01, 0.33, 0.67]), np.array([0.1, 0.3, 0.6])
#: Ends of sentences.
ENDS = (".", "!", "?", "…", ":", ";", '"', "”", "»")
FEATURES = 1 + _N_TAGS + _N_NAMES + (len(_LENGTHS) + 1) + (len(_LINKS) + 1) + (len(_SHARES) + 1) + 4
#: Potentials between a node and its parent are those of the node's kind of tag.
EDGES = _N_TAGS


@dataclass
class Forest:
    """Nodes of several pages; a parent stands before its children, and -1 is the parent of a top."""

    parents: np.ndarray
    kinds: np.ndarray
    features: np.ndarray
    #: By depth: the nodes, their different parents, and where each parent's children begin.
    levels: list[tuple[np.ndarray, np.ndarray, np.ndarray]]


@dataclass
class Model:
    """``unary`` weighs the features of a node for being content; ``edges`` scores, for each kind of
    node, labels of parent and node together."""

    unary: np.ndarray
    edges: np.ndarray


def forest(pages: list[Page]) -> Forest:
    """Features of the nodes: what an element is, its names, and the text below it."""
    sizes = [len(p.tags) for p in pages]
    begins = np.cumsum([0, *sizes])
    n = int(begins[-1])
    parents, kinds, depths = np.empty(n, np.int64), np.empty(n, np.int64), np.empty(n, np.int64)
    features = np.zeros((n, FEATURES), np.float32)
    named, which = [], []
    for begin, page in zip(begins, pages):
        end = begin + len(page.tags)
        up = np.array(page.parents, np.int64)
        parents[begin:end] = np.where(up >= 0, up + begin, -1)
        kinds[begin:end] = [_TAG_OF[t] for t in page.tags]
        depths[begin:end] = page.depths
        for row, words in enumerate(page.words):
            if words:
                for word in _WORD.findall(words):
                    name = _NAME_OF.get(word.lower())
                    if name is not None:
                        named.append(begin + row)
                        which.append(name)
        own = np.array([len(t) for t in page.texts], float)
        ends = np.array([t.endswith(ENDS) for t in page.texts], float)
        signs = np.array(["©" in t for t in page.texts], float)
        stops, here = np.array(page.stops, np.int64), np.arange(len(page.tags))
        below = [(s := np.concatenate([[0.0], np.cumsum(x)]))[stops] - s[here] for x in (own, np.array(page.linked, float), ends, signs, own > 0)]
        at = 1 + _N_TAGS + _N_NAMES
        for values, steps in ((below[0], _LENGTHS), (below[1] / np.maximum(below[0], 1), _LINKS), (below[0] / max(own.sum(), 1), _SHARES)):
            features[begin + here, at + np.searchsorted(steps, values, side="right")] = 1
            at += len(steps) + 1
        features[begin:end, at] = below[2] / np.maximum(below[4], 1)
        features[begin:end, at + 1] = below[3] > 0
        # within an article element, or neither within nor around the ones that the page has
        article = np.array([t in ("article", "main") for t in page.tags], bool)
        tops = here[article]
        inside = np.zeros(len(here) + 1, np.int64)
        np.add.at(inside, tops, 1)
        np.add.at(inside, stops[tops], -1)
        inside = np.cumsum(inside)[:-1] > 0
        counted = np.concatenate([[0], np.cumsum(article)])
        features[begin:end, at + 2] = inside
        features[begin:end, at + 3] = article.any() & ~inside & (counted[stops] == counted[here])
    features[:, 0] = 1
    features[np.arange(n), 1 + kinds] = 1
    features[named, 1 + _N_TAGS + np.array(which, np.int64)] = 1
    order = np.argsort(depths, kind="stable")  # within a depth, children of one parent stand together
    levels = []
    for level in np.split(order, np.flatnonzero(np.diff(depths[order])) + 1) if n else []:
        up = parents[level]
        starts = np.flatnonzero(np.concatenate([[True], up[1:] != up[:-1]]))
        levels.append((level, up[starts], starts))
    return Forest(parents, kinds, features, levels)


def marginals(nodes: Forest, model: Model) -> tuple[np.ndarray, np.ndarray, float]:
    """Of each node P(content); of each node and its parent the joint probabilities (parent, node);
    and the logarithm of the sum over all labellings.

    Sum-product: messages go from the leaves to the tops and back, a level of the trees at a time.
    """
    n = len(nodes.parents)
    # odds of content; of labels (parent, node) only differences of scores matter
    edge = model.edges[nodes.kinds]
    upward = np.zeros((n, 2))  # a node's own score and what its children say
    upward[:, 1] = nodes.features @ model.unary.astype(np.float32)
    said = np.zeros((n, 2))  # a node to its parent
    for level, up, starts in reversed(nodes.levels[1:]):
        told = edge[level] + upward[level][:, None, :]
        said[level] = np.logaddexp(told[:, :, 0], told[:, :, 1])
        upward[up] += np.add.reduceat(said[level], starts, axis=0)
    tops = nodes.levels[0][0] if nodes.levels else np.empty(0, np.int64)
    log_sum = float(np.logaddexp(upward[tops, 0], upward[tops, 1]).sum())
    belief = upward.copy()
    joint = np.zeros((n, 2, 2))
    for level, _, _ in nodes.levels[1:]:
        heard = (belief[nodes.parents[level]] - said[level])[:, :, None] + edge[level]
        both = heard + upward[level][:, None, :]
        both -= both.max(axis=(1, 2), keepdims=True)
        both = np.exp(both)
        joint[level] = both / both.sum(axis=(1, 2), keepdims=True)
        belief[level] = upward[level] + np.logaddexp(heard[:, 0], heard[:, 1])
    content = 1 / (1 + np.exp(np.clip(belief[:, 0] - belief[:, 1], -60, 60)))
    return content, joint, log_sum


def fit_labels(nodes: Forest, labels: np.ndarray, steps: int = STEPS) -> Model:
    """The model under which given labels of all nodes are likeliest, by gradients from exact
    marginals (adaptive moments), with a small weight decay."""
    model = Model(np.zeros(FEATURES), np.zeros((EDGES, 2, 2)))
    below = nodes.parents >= 0
    of_kind = np.zeros((EDGES, int(below.sum())), np.float32)
    of_kind[nodes.kinds[below], np.arange(of_kind.shape[1])] = 1
    pairs = np.eye(4, dtype=np.float32)[2 * labels[nodes.parents[below]] + labels[below]]
    seen = (of_kind @ pairs).reshape(EDGES, 2, 2)
    seen_unary = nodes.features.T @ labels.astype(np.float32)
    moments = [[np.zeros_like(w), np.zeros_like(w)] for w in (model.unary, model.edges)]
    scale = 1 / max(len(labels), 1)
    for step in range(1, steps + 1):
        content, joint, _ = marginals(nodes, model)
        expected = (of_kind @ joint[below].reshape(-1, 4).astype(np.float32)).reshape(EDGES, 2, 2)
        gradients = (seen_unary - nodes.features.T @ content.astype(np.float32), seen - expected)
        for weights, gradient, moment in zip((model.unary, model.edges), gradients, moments):
            g = gradient * scale - DECAY * scale * weights
            moment[0] = 0.9 * moment[0] + 0.1 * g
            moment[1] = 0.99 * moment[1] + 0.01 * g * g
            weights += RATE * (moment[0] / (1 - 0.9**step)) / (np.sqrt(moment[1] / (1 - 0.99**step)) + 1e-8)
    return model


def markup_labels(page: Page) -> np.ndarray:
    """Labels of a page's runs by its own markup: within its article or main element, and there in
    nothing that is made or named for something else."""
    apart = {_TAG_OF[t] for t in ("nav", "footer", "aside", "form")}
    content = _NAME_OF["content"]
    label = np.zeros(len(page.tags), np.int64)
    state = [0] * len(page.tags)  # 1 within the article, -1 within something else there
    for k, (tag, up) in enumerate(zip(page.tags, page.parents)):
        above = state[up] if up >= 0 else 0
        names = {_NAME_OF.get(w.lower(), content) for w in _WORD.findall(page.words[k])}
        if tag in ("article", "main") and above == 0:
            state[k] = 1
        elif above == 1 and (_TAG_OF[tag] in apart or names - {content}):
            state[k] = -1
        else:
            state[k] = above
        label[k] = state[k] == 1
    return label


def mark_labels(page: Page) -> np.ndarray:
    """Labels by ``data-main`` marks, 1 or 0 for an element and what is below it."""
    label = np.zeros(len(page.tags), np.int64)
    for k, (mark, up) in enumerate(zip(page.marks, page.parents)):
        label[k] = int(mark == "1") if mark is not None else label[up] if up >= 0 else 0
    return label


def node_labels(page: Page, runs: np.ndarray) -> np.ndarray:
    """Labels of all nodes from those of runs: an element is content if most of its text is."""
    size = np.array([len(t) for t in page.texts], float)
    stops, here = np.array(page.stops, np.int64), np.arange(len(page.tags))
    total, good = (np.concatenate([[0.0], np.cumsum(x)]) for x in (size, size * runs))
    return np.where(size > 0, runs, 2 * (good[stops] - good[here]) > total[stops] - total[here]).astype(np.int64)


def fit(labelled: DataFrame, rows: int = LABELLED_PAGES, variants: int = 3) -> Model:
    """The model of a sample of pages (column ``html``) that have an article or main element.

    Their own markup labels their text. Each is also laid out anew ``variants`` times with other
    markup, names and surroundings around the same text (``page_layouts``), so that the model does
    not lean on one site's habits. The sample is by hash, at most ``rows`` pages, the same every time;
    without such pages the layouts alone, around made-up words, are learnt.
    """
    pages = labelled.select(F.coalesce("html", F.lit("")).alias("html"), F.xxhash64(*labelled.columns).alias("row_hash"))
    some = hash_sample(pages, 4 * rows, pages.count(), "row_hash")
    marked = some.where(F.lower("html").rlike("<(article|main)[\\s/>]")).orderBy(F.xxhash64("row_hash", F.lit(1)), "html").limit(rows)
    parsed, runs = [], []
    for row in marked.select("html").collect():
        page = parse(row["html"])
        label = markup_labels(page)
        if label.any():
            parsed.append(page)
            runs.append(label)
    blocks = [[t for t, y in zip(p.texts, r) if t and y] for p, r in zip(parsed, runs)]
    rest = [[t for t, y in zip(p.texts, r) if t and not y] for p, r in zip(parsed, runs)]
    if not blocks:
        blocks, rest = page_layouts.made_up(rows // 4, 1), [[]]
    chance = random.Random(1)
    for k in range(variants * len(blocks)):
        page = parse(page_layouts.layout(chance, blocks[k % len(blocks)], blocks, rest))
        parsed.append(page)
        runs.append(mark_labels(page))
    labels = [node_labels(p, r) for p, r in zip(parsed, runs)]
    return fit_labels(forest(parsed), np.concatenate(labels))


def main_texts(markups: Iterable[str], model: Model) -> Iterator[str]:
    """The main text of each page: runs that are rather content than not, one a line."""

    def told(pages: list[Page]) -> Iterator[str]:
        content, _, _ = marginals(forest(pages), model)
        begin = 0
        for page in pages:
            likely = content[begin : begin + len(page.tags)].tolist()
            begin += len(page.tags)
            yield "\n".join(t for t, p in zip(page.texts, likely) if t and p >= 0.5)

    held: list[Page] = []
    size = 0
    for markup in markups:
        held.append(parse(markup))
        size += len(held[-1].tags)
        if size >= BATCH_NODES:
            yield from told(held)
            held, size = [], 0
    yield from told(held)


def extract(pages: DataFrame, model: Model) -> DataFrame:
    """Rows (page_id, url, text, n_chars): the main text of each page's whole html.

    Blocks are joined by a line break, white space within one is one space. A null or empty html
    has an empty text; page_id and url stay as they are; extra columns are left out.
    """
    kinds = {c: pages.schema[c].dataType.simpleString() for c in ("page_id", "url")}

    def extracted(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 256):
            texts = list(main_texts(batch.column("html").to_pylist(), model))
            yield pa.RecordBatch.from_arrays(
                [batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())],
                names=["page_id", "url", "text", "n_chars"],
            )

    given = pages.select("page_id", "url", F.coalesce("html", F.lit("")).alias("html"))
    return given.mapInArrow(extracted, f"page_id {kinds['page_id']}, url {kinds['url']}, text string, n_chars long")
