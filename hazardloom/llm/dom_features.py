"""Pages as trees of blocks, and numbers that describe each node.

A node is a block element or a run of text directly inside one (a leaf). Inline elements belong to the
run around them. All lists of ``Nodes`` go on over the pages of a batch; parents come before children.
"""

from __future__ import annotations

import html
import re
from collections import Counter

import numpy as np

# Fixed values of HTML: which elements hold no text of the page, have no end tag, or form blocks.
UNSEEN = set("script style title textarea iframe noembed noframes xmp noscript template svg math object canvas audio video select button".split())
TAG_GROUPS = {
    "main": "article main",
    "menu": "nav menu",
    "header": "header hgroup",
    "footer": "footer address",
    "aside": "aside",
    "form": "form fieldset legend dialog label output",
    "heading": "h1 h2 h3 h4 h5 h6",
    "paragraph": "p blockquote pre figcaption figure",
    "list": "ul ol li dl dt dd dir",
    "table": "table caption thead tbody tfoot tr td th",
    "box": "div section center details summary search",
}
VOID_BLOCKS = {"hr"}
#: An opening tag ends open elements of the first set unless one of the second set stands between.
ENDS = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "tbody": ({"thead", "tbody", "tfoot", "tr", "td", "th", "caption"}, {"table"}),
    "tfoot": ({"thead", "tbody", "tfoot", "tr", "td", "th", "caption"}, {"table"}),
}
#: Fixed stems of class and id names; a name that contains a stem (or is a short word) has its property.
STEMS = {
    "body": "article content post entry story text body main prose",
    "menu": "nav menu breadcrumb pager pagination toc skip tabs",
    "header": "header masthead topbar logo branding tagline",
    "footer": "footer copyright colophon legal imprint",
    "side": "sidebar aside rail secondary widget related recommend popular trending teaser",
    "notice": "notice cookie consent alert warning message gdpr popup modal overlay toast privacy",
    "advert": "advert sponsor promo banner adbox adsbox adslot adsense dfp outbrain taboola affiliate",
    "form": "form login signup subscribe newsletter search register contact",
    "comment": "comment reply replies disqus respond discussion feedback",
    "share": "share sharing social follow tags meta byline author",
}
SHORT = {"ad": "advert", "ads": "advert", "adv": "advert", "nav": "menu", "foot": "footer", "head": "header", "side": "side"}

GROUP_OF = {tag: i for i, tags in enumerate(TAG_GROUPS.values()) for tag in tags.split()}
TOKEN_NAMES = list(STEMS)
N_GROUPS, N_TOKENS = len(TAG_GROUPS), len(STEMS)

_SPACED = r"[\s/]*+"
_TAG = re.compile(
    r"<!--.*?(?:--!?>|\Z)|<[!?][^>]*+(?:>|\Z)|</([a-zA-Z][^\s/>]*+)[^>]*+(?:>|\Z)"
    rf"|<([a-zA-Z][^\s/>]*+)((?:{_SPACED}[^\s/>=][^\s/>=]*+(?:\s*+=\s*+(?:\"[^\"]*+(?:\"|\Z)|'[^']*+(?:'|\Z)|[^\s>]*+))?)*+){_SPACED}=?+[^>]*+(?:>|\Z)",
    re.S,
)
_NAMES = re.compile(r"""(?:^|[\s/"'])(?:class|id|role|itemprop)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.I)
_PIECE = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")


class Nodes:
    """Columns of all nodes of a batch of pages."""

    def __init__(self):
        #: page, parent, depth, tag (empty: leaf), property bits, text (None: element), links, characters in links
        self.rows: list[tuple] = []
        self._known: dict[str, int] = {}

    def column(self, k: int) -> list:
        return [row[k] for row in self.rows]

    @property
    def text(self) -> list[str | None]:
        return self.column(5)

    @property
    def parent(self) -> np.ndarray:
        return np.array(self.column(1), np.int64)

    @property
    def depth(self) -> np.ndarray:
        return np.array(self.column(2), np.int64)

    def properties(self, tag: str, attributes: str) -> int:
        """Bits of the element's group and of the stems in its names."""
        bits = 1 << GROUP_OF[tag]
        if not attributes:
            return bits
        found = self._known.get(attributes)
        if found is None:
            found = 0
            for value in _NAMES.findall(attributes):
                for word in re.split(r"[\s_\-]+", "".join(value)):
                    pieces = {p.lower() for p in _PIECE.findall(word)}
                    for i, stems in enumerate(STEMS.values()):
                        if any(s in word.lower() for s in stems.split()) or any(SHORT.get(p) == TOKEN_NAMES[i] for p in pieces):
                            found |= 1 << (N_GROUPS + i)
            if len(self._known) < 10_000:
                self._known[attributes] = found
        return bits | found


def _end_of(name: str, cache={}):
    if name not in cache:
        cache[name] = re.compile(rf"</{name}(?=[\s/>])[^>]*+(?:>|\Z)", re.I)
    return cache[name]


def parse(page: int, source: str, nodes: Nodes) -> None:
    """Append the nodes of one page; character references are decoded, white space is one space."""
    rows = nodes.rows
    rows.append((page, -1, 0, "body", 0, None, 0, 0))
    # open elements: node, depth, tag, property bits
    stack, open_tags = [(len(rows) - 1, 0, "body", 0)], Counter()
    parts: list[str] = []
    links = link_chars = 0
    link_level = 0  # stack height at which a link is open

    def flush():
        nonlocal parts, links, link_chars
        if parts:
            text = " ".join("".join(parts).split())
            if text:
                top, depth, _, own = stack[-1]
                rows.append((page, top, depth + 1, "", own, text, links, link_chars))
        parts, links, link_chars = [], 0, 0

    def put(text: str):
        nonlocal link_chars
        if text:
            if "&" in text:
                text = html.unescape(text)
            parts.append(text)
            if link_level:
                link_chars += len(text)

    def close(to: int):
        nonlocal link_level
        flush()
        for element in stack[to:]:
            open_tags[element[2]] -= 1
        del stack[to:]
        if len(stack) < link_level:
            link_level = 0

    def close_within(ended: set, bounds: set):
        for k in range(len(stack) - 1, 0, -1):
            tag = stack[k][2]
            if tag in ended:
                close(k)
            elif tag in bounds:
                break

    at, size = 0, len(source)
    while at < size:
        start = source.find("<", at)
        if start < 0:
            put(source[at:])
            break
        put(source[at:start])
        found = _TAG.match(source, start)
        if not found:
            put("<")
            at = start + 1
            continue
        at = found.end()
        end, name = found[1], found[2]
        if name:
            name = name.lower()
            if name in UNSEEN:
                ending = _end_of(name).search(source, at)
                # without its end tag raw text goes on to the end of the page, other elements are passed over
                if ending:
                    at = ending.end()
                elif name in ("script", "style", "title", "textarea", "iframe", "xmp"):
                    at = size
            elif name in GROUP_OF:
                flush()
                if stack[-1][2] == "p":
                    close(len(stack) - 1)
                if name in ENDS and any(open_tags[t] for t in ENDS[name][0]):
                    close_within(*ENDS[name])
                top, depth, _, _ = stack[-1]
                own = nodes.properties(name, found[3])
                stack.append((len(rows), depth + 1, name, own))
                rows.append((page, top, depth + 1, name, own, None, 0, 0))
                open_tags[name] += 1
            elif name == "a":
                link_level = len(stack)
                links += 1
            elif name == "br":
                put(" ")
            elif name in VOID_BLOCKS:
                flush()
        elif end:
            end = end.lower()
            if end == "a":
                link_level = 0
            elif open_tags[end] > 0:
                k = len(stack) - 1
                while stack[k][2] != end:
                    k -= 1
                close(k)
    close(1)


FEATURES = (
    [f"own_{g}" for g in [*TAG_GROUPS, *(f"named_{t}" for t in STEMS)]]
    + [f"above_{g}" for g in [*TAG_GROUPS, *(f"named_{t}" for t in STEMS)]]
    + """leaf depth words link_share links words_per_leaf chars_per_word leaves_per_node punctuation headings
    paragraphs share before siblings place alike sibling_words previous_words next_words page_words lead_symbol""".split()
)


def levels(nodes_depth: np.ndarray) -> list[np.ndarray]:
    """Node numbers by depth, the root's first."""
    order = np.argsort(nodes_depth, kind="stable")
    return np.split(order, np.flatnonzero(np.diff(nodes_depth[order])) + 1) if len(order) else []


def measure(nodes: Nodes) -> np.ndarray:
    """One row of ``FEATURES`` per node: own and inherited properties, subtree density, depth, siblings."""
    n = len(nodes.rows)
    page, parent, depth, tags, own, texts, n_links, in_links = zip(*nodes.rows) if n else [()] * 8
    page, parent, depth, own = (np.array(x, np.int64) for x in (page, parent, depth, own))
    sums = np.zeros((9, n))
    chars, words, linked, links, marks, leaves, elements, headings, paragraphs = sums
    leaf = np.array([t is not None for t in texts], bool)
    there = [t for t in texts if t is not None]
    chars[leaf] = [len(t) for t in there]
    words[leaf] = [t.count(" ") + 1 for t in there]
    marks[leaf] = [t.count(".") + t.count(",") for t in there]
    symbol = np.zeros(n)
    symbol[leaf] = [not t[0].isalnum() for t in there]
    linked[:], links[:] = in_links, n_links
    leaves[leaf], elements[~leaf] = 1, 1
    is_heading = (own >> GROUP_OF["h1"]) & 1
    is_paragraph = (own >> GROUP_OF["p"]) & 1
    headings[leaf], paragraphs[leaf] = is_heading[leaf], is_paragraph[leaf]
    own_words = words.copy()
    by_level = levels(depth)
    for level in reversed(by_level[1:]):
        for column in sums:
            np.add.at(column, parent[level], column[level])
    above = np.zeros(n, np.int64)
    for level in by_level[1:]:
        up = parent[level]
        above[level] = above[up] | own[up]
    # siblings in page order: nodes with text, by parent
    siblings = np.flatnonzero((words > 0) & (parent >= 0))
    order = siblings[np.argsort(parent[siblings], kind="stable")]
    group = parent[order]
    first = np.flatnonzero(np.diff(group, prepend=-2)) if len(group) else np.zeros(0, np.int64)
    size = np.diff(np.append(first, len(group)))
    count, place, alike = np.ones(n), np.zeros(n), np.ones(n)
    count[order] = np.repeat(size, size)
    place[order] = (np.arange(len(group)) - np.repeat(first, size)) / np.maximum(count[order] - 1, 1)
    numbers_of = {t: i for i, t in enumerate(sorted(set(tags)))}
    kind = np.array([numbers_of[t] for t in tags], np.int64)
    pair = group * (kind.max(initial=0) + 1) + kind[order]
    _, inverse, times = np.unique(pair, return_inverse=True, return_counts=True)
    alike[order] = times[inverse] / count[order] if len(order) else 0
    previous, following = np.zeros(n), np.zeros(n)
    same = group[1:] == group[:-1]
    previous[order[1:][same]] = words[order[:-1][same]]
    following[order[:-1][same]] = words[order[1:][same]]
    others = np.zeros(n)
    others[order] = (words[group] - words[order]) / np.maximum(count[order] - 1, 1) * (count[order] > 1)
    # words of the page in front of the node
    roots = np.flatnonzero(parent < 0)
    total = words[roots][page - page[0]] if n else words
    before = np.cumsum(own_words) - own_words
    before -= before[roots][page - page[0]] if n else 0
    w, t = np.maximum(words, 1), np.maximum(total, 1)
    numbers = [
        leaf, np.minimum(depth, 30), np.log1p(words), linked / np.maximum(chars, 1), np.log1p(links),
        words / np.maximum(leaves, 1), chars / w, leaves / np.maximum(leaves + elements, 1), marks / w,
        np.minimum(headings, 5), np.log1p(paragraphs), words / t, before / t,
        np.log1p(count), place, alike, np.log1p(others), np.log1p(previous), np.log1p(following), np.log1p(total), symbol,
    ]
    bits = N_GROUPS + N_TOKENS
    found = np.empty((len(FEATURES), n))
    for k in range(bits):
        found[k], found[bits + k] = (own >> k) & 1, (above >> k) & 1
    found[2 * bits :] = numbers
    return found.T


def consistent(nodes: Nodes, chance: np.ndarray) -> np.ndarray:
    """The most likely choice of kept nodes in which no kept node has a dropped ancestor.

    Bottom up, a subtree's best value with its top kept (children as they like) and with its top
    dropped (all of it dropped); top down, a node is kept if its parent is and keeping is worth more.
    """
    parent, depth = nodes.parent, nodes.depth
    words = np.array([0 if t is None else 1 for t in nodes.text])
    by_level = levels(depth)
    for level in reversed(by_level[1:]):
        np.add.at(words, parent[level], words[level])
    p = np.clip(chance, 1e-6, 1 - 1e-6)
    keep, drop = np.where(words > 0, np.log(p), 0), np.where(words > 0, np.log1p(-p), 0)
    for level in reversed(by_level[1:]):
        np.add.at(keep, parent[level], np.maximum(keep[level], drop[level]))
        np.add.at(drop, parent[level], drop[level])
    kept = np.zeros(len(p), bool)
    if by_level:
        kept[by_level[0]] = True
    for level in by_level[1:]:
        kept[level] = kept[parent[level]] & (keep[level] >= drop[level])
    return kept
