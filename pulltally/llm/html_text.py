"""Main text of web pages: gradient-boosted trees over DOM nodes, decoded down the tree.

Every element is described by its own and its ancestors' names and attribute words, depth, text and link density of its
subtree, and by its siblings. A boosted-tree classifier learns from SAMPLE_PAGES pages (those with the smallest hash of
the page id) which nodes are content: where a page names its article and its menus, notices and so on, the names
are the labels. Each training row comes four times: as it is; with all names masked, so that the trees also learn shape
for pages without telling names; and twice with the shape of other nodes, so that names decide where they are there. A page is then decoded top-down for the best total: a node can only be kept if its parent is,
so an ancestor and a descendant never contradict each other, and a short paragraph goes with its article.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pulltally.llm.scratch import Scratch

#: Pages that the classifier learns from.
SAMPLE_PAGES = 600
TREES, DEPTH = 12, 4

# HTML's element names by their role.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
HIDDEN = frozenset("head script style noscript template svg math iframe object canvas audio video select option textarea button".split())
BLOCK = frozenset(
    "html body address article aside blockquote caption center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 header hr legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
#: Start tags that end an open paragraph, and those that end an open element of their own kind.
ENDS_P = BLOCK - frozenset("html body caption dd dt legend li summary tbody td tfoot th thead tr".split()) | {"dd", "dt", "li"}
ENDS_OWN = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
#: An end tag or implied end doesn't reach beyond these.
SCOPE = frozenset("html body table td th article aside nav section main footer header form ul ol dl".split())

CONTENT_NAMES = frozenset("article main post entry story articlebody blogposting newsarticle".split())
OTHER_NAMES = frozenset(
    "nav navigation menu navbar breadcrumb breadcrumbs header masthead banner footer foot copyright aside sidebar rail widget related recommended "
    "ad ads advert adverts advertisement sponsor sponsored promo promotion cookie cookies consent notice notices alert popup modal newsletter subscribe "
    "form search login signup comment comments reply replies disqus respond share sharing social toolbar tags pagination pager complementary contentinfo".split()
)
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
_NAME = re.compile(r"[a-z]+|[0-9]+")
_CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")
_MARKS = re.compile(r"[.,;:!?]")

FEATURES = (
    "content_self", "other_self", "content_above", "other_above", "paragraph", "heading", "item", "link", "block",  # the first NAMED come from names
    "depth", "own_chars", "chars", "words", "marks", "link_share", "density", "children", "siblings", "place_among", "same_siblings",
    "sibling_chars", "sibling_links", "share_of_page", "place_in_page", "under_link", "parent_chars", "parent_link_share",
)
NAMED = 4
#: From here on, features say nothing of names.
SHAPE = 9


class Dom(HTMLParser):
    """Elements in page order, as parallel lists; text is kept in (block, node, text) pieces."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.tag: list[str] = []
        self.names: list[frozenset[str]] = []
        self.parent: list[int] = []
        self.pieces: list[tuple[int, int, str]] = []
        self._open: list[int] = []
        self._at: dict[str, list[int]] = {}  # places of each tag among the open ones
        self._block = 0

    @classmethod
    def of(cls, html: str) -> Dom:
        dom = cls()
        dom._push("#page", [])
        unfinished = re.compile(r"<(?:[A-Za-z/!?]|$)").search(html, html.rfind(">") + 1)
        if unfinished:
            html = html[:unfinished.start()]  # a tag that the page ends within
        dom.feed(html)
        dom.close()
        return dom

    def _push(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        named = [v for k, v in attrs if v and k in ("class", "id", "role", "itemprop", "itemtype", "aria-label", "data-role")]
        self.names.append(frozenset([tag, *_NAME.findall(_CAMEL.sub(" ", " ".join(named)).lower())]) if named else frozenset((tag,)))
        self.parent.append(self._open[-1] if self._open else -1)
        self.tag.append(tag)
        self._at.setdefault(tag, []).append(len(self._open))
        self._open.append(len(self.tag) - 1)
        if tag in BLOCK:
            self._block += 1

    def _pop(self) -> None:
        tag = self.tag[self._open.pop()]
        self._at[tag].pop()
        if tag in BLOCK:
            self._block += 1

    def _nearest(self, tags: set[str] | frozenset[str]) -> int:
        """The place of the innermost open element of these tags; 0, that of the page, if there is none."""
        return max((self._at[t][-1] for t in tags if self._at.get(t)), default=0)

    def _end_nearest(self, tags: set[str] | frozenset[str], beyond: frozenset[str]) -> None:
        found = self._nearest(tags)
        if found and found > self._nearest(beyond):
            while len(self._open) > found:
                self._pop()

    def parse_comment(self, i: int, report: int = 1) -> int:
        """A comment that nothing ends takes the rest of the page."""
        end = super().parse_comment(i, report)
        return len(self.rawdata) if end < 0 else end

    def parse_marked_section(self, i: int, report: int = 1) -> int:
        """In a page, these are comments up to the next mark."""
        end = self.rawdata.find(">", i)
        return len(self.rawdata) if end < 0 else end + 1

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag in ENDS_P:
            self._end_nearest({"p"}, SCOPE)
        if tag in ENDS_OWN:
            self._end_nearest(ENDS_OWN[tag], SCOPE - ENDS_OWN[tag])
        if tag in HEADINGS and self.tag[self._open[-1]] in HEADINGS:
            self._pop()
        if tag == "body":
            self._end_nearest({"head"}, frozenset())
        self._push(tag, attrs)
        if tag in VOID:
            if tag == "br":
                self.pieces.append((self._block, self._open[-1], " "))
            self._pop()

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.handle_starttag(tag, attrs)  # the slash means nothing in HTML

    def handle_endtag(self, tag: str) -> None:
        if tag not in VOID:
            self._end_nearest({tag}, SCOPE - {tag} if tag not in SCOPE else frozenset())

    def handle_data(self, data: str) -> None:
        self.pieces.append((self._block, self._open[-1], data))


def _sums(parent: np.ndarray, own: np.ndarray) -> np.ndarray:
    """Subtree totals; parents come before their children."""
    total = own.copy()
    for i in range(len(parent) - 1, 0, -1):
        total[parent[i]] += total[i]
    return total


def describe(dom: Dom) -> tuple[np.ndarray, np.ndarray]:
    """The features of every node, and its label from names: 1 content, 0 other, -1 unknown."""
    n = len(dom.tag)
    parent = np.array(dom.parent)
    own = np.zeros((n, 3))  # characters, words, punctuation marks
    before = np.zeros(n)  # page text before the node
    seen, at = 0, 0
    hidden = np.zeros(n, bool)
    link = np.zeros(n, bool)
    above = np.zeros((n, 2))
    self_named = np.zeros((n, 2))
    depth = np.zeros(n)
    for i in range(n):
        p = parent[i]
        self_named[i] = bool(dom.names[i] & CONTENT_NAMES), bool(dom.names[i] & OTHER_NAMES)
        hidden[i], link[i] = dom.tag[i] in HIDDEN, dom.tag[i] == "a"
        if p >= 0:
            depth[i] = depth[p] + 1
            hidden[i] |= hidden[p]
            link[i] |= link[p]
            above[i] = np.maximum(above[p], self_named[p])
    for _, node, text in dom.pieces:
        if not hidden[node]:
            size = len(text)
            own[node] += size, text.count(" "), len(_MARKS.findall(text))
            while at <= node:
                before[at] = seen
                at += 1
            seen += size
    before[at:] = seen
    chars, words, marks = _sums(parent, own).T
    linked = _sums(parent, own[:, 0] * link)
    inner = _sums(parent, np.ones(n))
    up = np.maximum(parent, 0)
    children = np.bincount(up[1:], minlength=n).astype(float)
    place, same = np.zeros(n), np.zeros(n)
    count: dict[int, int] = {}
    kinds: dict[tuple[int, str], int] = {}
    for i in range(1, n):
        place[i] = count[parent[i]] = count.get(parent[i], 0) + 1
        kinds[parent[i], dom.tag[i]] = kinds.get((parent[i], dom.tag[i]), 0) + 1
    for i in range(1, n):
        same[i] = kinds[parent[i], dom.tag[i]]
    siblings = np.maximum(children[up] - 1, 0)
    others = np.maximum(siblings, 1)
    one = lambda tags: np.array([t in tags for t in dom.tag], float)
    share = linked / np.maximum(chars, 1)
    features = np.stack([
        self_named[:, 0], self_named[:, 1], above[:, 0], above[:, 1], one({"p"}), one(HEADINGS), one({"li", "dd", "dt"}), one({"a"}), one(BLOCK),
        depth, np.log1p(own[:, 0]), np.log1p(chars), np.log1p(words), marks / np.maximum(words, 1), share, np.log1p(chars / inner),
        np.log1p(children), np.log1p(siblings), place / (siblings + 1), same / (siblings + 1), np.log1p(np.maximum(chars[up] - own[up, 0] - chars, 0) / others),
        np.maximum(linked[up] - linked, 0) / np.maximum(chars[up] - chars, 1), chars / max(seen, 1), before / max(seen, 1), link.astype(float), np.log1p(chars[up]), share[up],
    ], axis=1)
    inside = np.maximum(above, self_named)
    label = np.where(hidden, -1, np.where(inside[:, 1] > 0, 0, np.where(inside[:, 0] > 0, 1, 0)))
    if not self_named[:, 0].any():
        label[:] = -1  # a page that doesn't name its article teaches nothing
    label[chars == 0] = -1
    label[[i for i in range(n) if dom.tag[i] in ("#page", "html", "body")]] = -1
    return features, label


class Trees:
    """A boosted-tree model as arrays: per tree feature (-1: leaf), threshold or value, left and right child."""

    def __init__(self, trees: list[list[tuple[int, float, int, int]]], weights: list[float]) -> None:
        self._trees = [(np.array([t[0] for t in x]), np.array([t[1] for t in x]), np.array([t[2] for t in x]), np.array([t[3] for t in x])) for x in trees]
        self._weights = weights

    def margins(self, features: np.ndarray) -> np.ndarray:
        total = np.zeros(len(features))
        rows = np.arange(len(features))
        for (feature, value, left, right), weight in zip(self._trees, self._weights, strict=True):
            at = np.zeros(len(features), np.int64)
            for _ in range(DEPTH):
                f = feature[at]
                at = np.where(f < 0, at, np.where(features[rows, np.maximum(f, 0)] <= value[at], left[at], right[at]))
            total += weight * value[at]
        return total


def _exported(model) -> Trees:
    def walk(node, out: list) -> int:
        at = len(out)
        out.append(None)
        if node.getClass().getSimpleName() == "InternalNode":
            split = node.split()
            left, right = walk(node.leftChild(), out), walk(node.rightChild(), out)
            out[at] = (split.featureIndex(), split.threshold(), left, right)
        else:
            out[at] = (-1, node.prediction(), at, at)
        return at

    trees = []
    for tree in model.trees:
        walk(tree._java_obj.rootNode(), nodes := [])
        trees.append(nodes)
    return Trees(trees, list(model.treeWeights))


def _training(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for html in batch.column("html"):
            features, label = describe(Dom.of(html.as_py() or ""))
            known = label >= 0
            plain = features[known]
            masked = plain.copy()
            masked[:, :NAMED] = 0
            dealt = []
            for seed in range(2):
                mixed = plain.copy()
                mixed[:, SHAPE:] = np.random.default_rng(seed).permutation(features)[: len(plain), SHAPE:]
                dealt.append(mixed)
            rows = np.concatenate([plain, masked, *dealt])
            yield pa.RecordBatch.from_arrays([pa.array(list(rows), pa.list_(pa.float64())), pa.array(np.tile(label[known], 4).astype(float))], ["features", "label"])


def fit(pages: DataFrame, sample_pages: int = SAMPLE_PAGES) -> Trees | None:
    """The classifier, from the pages with the smallest hashes of page_id; None if they name no article, or nothing else."""
    scratch = Scratch(pages.sparkSession, "html")
    html = F.col("html").cast("string")
    # Only hashes are sorted; then the chosen pages are taken from where they are.
    hashed = pages.select(F.xxhash64("page_id").alias("order"), F.xxhash64(html).alias("tie"), html.alias("html"))
    chosen = scratch.save(hashed.select("order", "tie").distinct().orderBy("order", "tie").limit(sample_pages), "chosen")
    sample = hashed.join(F.broadcast(chosen), ["order", "tie"]).groupBy("order", "tie").agg(F.min("html").alias("html")).select("html")
    rows = scratch.save(sample.mapInArrow(_training, "features array<double>, label double"), "training")
    if rows.select("label").distinct().count() < 2:
        return None
    training = rows.select(array_to_vector("features").alias("features"), "label")
    return _exported(GBTClassifier(maxIter=TREES, maxDepth=DEPTH, stepSize=0.3, seed=7, maxBins=64).fit(training))


def decode(parent: np.ndarray, gain: np.ndarray) -> np.ndarray:
    """The kept nodes: the set with the largest total gain in which every kept node's parent is kept too."""
    value = gain.copy()
    for i in range(len(parent) - 1, 0, -1):
        if value[i] > 0:
            value[parent[i]] += value[i]
    kept = value > 0
    kept[0] = True
    for i in range(1, len(parent)):
        kept[i] &= kept[parent[i]]
    return kept


def _gains(dom: Dom, features: np.ndarray, trees: Trees | None) -> np.ndarray:
    own = np.expm1(features[:, FEATURES.index("own_chars")])
    if trees is None:
        margin = np.where(features[:, FEATURES.index("link_share")] > 0.5, -1.0, 1.0)
    else:
        margin = trees.margins(features)
    gain = margin * (0.1 + np.log1p(own))
    root = np.array([t in ("#page", "html", "body") for t in dom.tag])
    gain[root] = np.where(own[root] > 0, gain[root], 0.0)
    gain[root] = np.maximum(gain[root], 1e-9)  # the page itself is always open to its parts
    gain[[i for i, t in enumerate(dom.tag) if t in HIDDEN]] = -np.inf
    return gain


def main_text(dom: Dom, kept: np.ndarray) -> str:
    """The kept text: white space in a block as one space, trimmed, blocks joined by line feeds."""
    blocks: list[str] = []
    last, parts = -1, []
    for block, node, text in [*dom.pieces, (-2, 0, "")]:
        if block != last:
            line = " ".join("".join(parts).split())
            if line:
                blocks.append(line)
            last, parts = block, []
        if kept[node]:
            parts.append(text)
    return "\n".join(blocks)


def _extractor(trees: Trees | None):
    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first in range(0, batch.num_rows, 64):
                part = batch.slice(first, 64)
                doms = [Dom.of(h or "") for h in part.column("html").to_pylist()]
                features = [describe(d)[0] for d in doms]
                texts = []
                for dom, f in zip(doms, features, strict=True):
                    kept = decode(np.array(dom.parent), _gains(dom, f, trees))
                    loose = {i for i, t in enumerate(dom.tag) if t in ("#page", "html", "body")}
                    named = f[:, 0].any()
                    # Text that stands in no element but the page itself counts only where nothing names the article.
                    kept_text = kept.copy()
                    if named:
                        kept_text[list(loose)] = False
                    texts.append(main_text(dom, kept_text))
                yield pa.RecordBatch.from_arrays([part.column("page_id"), part.column("url"), pa.array(texts, pa.string())], ["page_id", "url", "text"])

    return extract


def extract_text(pages: DataFrame, trees: Trees | None) -> DataFrame:
    """page_id, url and text of every row of pages (page_id, url, html; other columns are ignored).

    Null and empty html, and pages without content, give an empty text. Character references are decoded.
    Every row is read by itself; equal pages give equal texts.
    """
    rows = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.col("html").cast("string"))
    return rows.mapInArrow(_extractor(trees), "page_id long, url string, text string")
