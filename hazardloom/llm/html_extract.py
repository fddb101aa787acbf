"""Main text of web pages by gradient-boosted trees over DOM nodes, decoded along the tree.

Pages are parsed into block nodes (``dom_features``). Boosted trees give every node the chance that it
holds main text, from its own and its ancestors' tags and class or id tokens, subtree density (words,
links, leaves per node), depth and its siblings. The decoder then chooses the most likely set of kept
nodes in which no kept node lies below a dropped one; kept text runs in page order are the main text.

The labelled rows for fitting are written here: texts of a bounded sample of the given pages
(``SAMPLE_PAGES``, those with the smallest ids) are laid out, ``WRITTEN_PAGES`` in all, as pages with menus, headers,
footers, sidebars, notices, adverts, forms, sharing bars and reader comments around and inside an
article, so each run's label is known. The trees are fitted in one task on at most ``FIT_NODES`` of these nodes and go to
all tasks (at most ``TREES * 2 ** (DEPTH + 1)`` nodes). Every page is then read whole in one pass without a
shuffle; a task holds one Arrow batch and its nodes.

Null and empty pages, and pages without text, give an empty text. Very long pages are parsed in linear
time. Ties (keeping a node is worth as much as dropping it) keep the node. Repeated rows give repeated
results, an empty table an empty one; columns other than page_id, url and html are ignored.
"""

from __future__ import annotations

import html as entities
import random
import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..operators import boosting
from ..session import cut
from .dom_features import FEATURES, Nodes, consistent, measure, parse
from .shared import small_batches

SAMPLE_PAGES = 150
WRITTEN_PAGES = 1200
FIT_NODES = 100_000
TREES, DEPTH, STEP = 60, 6, 0.3
#: Marks main text in pages that are written for fitting; a private-use character.
MARK = "\ue000"

# How written pages name things: tags and class or id tokens by part.
NAMES = {
    "menu": (["nav", "div", "ul"], "nav navbar menu main-menu topnav site-navigation breadcrumb pagination toc"),
    "header": (["header", "div"], "header site-header masthead topbar branding page-head logo"),
    "footer": (["footer", "div"], "footer site-footer foot bottom-footer copyright colophon"),
    "sidebar": (["aside", "div"], "sidebar side-bar aside secondary widget right-rail widget-area"),
    "related": (["section", "div", "aside"], "related related-posts recommended trending teasers popular-stories"),
    "notice": (["div", "section", "p"], "notice cookie-notice cookie-banner consent alert site-message gdpr popup"),
    "advert": (["div", "aside", "p", "section"], "ad ads advert advertisement ad-slot sponsored banner promo adsbox"),
    "form": (["form", "div"], "newsletter-form login search-form subscribe contact-form signup"),
    "share": (["div", "ul"], "share social share-buttons follow-us tags post-tags byline author-box"),
    "comments": (["section", "div", "ol"], "comments comment-list reader-comments disqus_thread responses discussion"),
    "article": (["article", "main", "div", "section"], "article post content entry-content story-body main-content post-body text"),
    "wrapper": (["div", "section", "main"], "page wrapper container row col-8 layout inner site c1 x7 content main"),
}


class Writer:
    """Writes one page of known main text from a pool of words."""

    def __init__(self, pool: list[str], seed: int):
        self.r = random.Random(seed)
        self.pool = pool
        self.out: list[str] = []

    def words(self, least: int, most: int) -> str:
        start = self.r.randrange(len(self.pool))
        n = self.r.randint(least, most)
        found = [self.pool[(start + i) % len(self.pool)] for i in range(n)]
        return entities.escape(" ".join(found), quote=False)

    def length(self) -> tuple[int, int]:
        return self.r.choice([(1, 4), (5, 20), (20, 60), (20, 60), (40, 160)])

    def open(self, part: str, hint: float = 1.0, tags: list[str] | None = None) -> str:
        """The opening tag of a part; ``hint`` is the chance that an ambiguous tag has a telling name."""
        known, names = NAMES[part]
        tag = self.r.choice(tags or known)
        named = self.r.random() < (hint if tag in ("div", "section", "p", "ul", "ol") else 0.4)
        if named:
            name = self.r.choice(names.split())
            name = self.r.choice([name, name, f"{name} {self.r.choice(['block', 'clearfix', 'u-1', 'mt-2'])}", name.replace("-", "_")])
            self.out.append(f'<{tag} {self.r.choice(["class", "class", "id"])}="{name}">')
        else:
            self.out.append(f"<{tag}>" if self.r.random() < 0.7 else f'<{tag} class="c{self.r.randrange(99)}">')
        return f"</{tag}>"

    def put(self, tag: str, text: str, main: bool = False, link: bool = False) -> None:
        text = f'<a href="/{self.r.randrange(999)}">{text}</a>' if link else text
        self.out.append(f"<{tag}>{MARK if main else ''}{text}</{tag}>")

    def links(self, least: int, most: int) -> None:
        """A list of links, or links one after another."""
        n = self.r.randint(least, most)
        if self.r.random() < 0.75:
            self.out.append("<ul>")
            for _ in range(n):
                self.put("li", self.words(1, 6), link=True)
            self.out.append("</ul>")
        else:
            self.out.append(" | ".join(f'<a href="#">{self.words(1, 3)}</a>' for _ in range(n)))

    def sentences(self, least: int, most: int) -> None:
        text = self.words(least, most)
        if self.r.random() < 0.6:
            self.put("p", text)
        else:
            self.out.append(text)

    def part(self, part: str) -> None:
        """One piece of page furniture, without any main text."""
        r = self.r
        end = self.open(part, 0.8 if part in ("menu", "footer", "related") else 1.0)
        if end != "</p>" and r.random() < 0.3:  # anything can stand in any part
            if r.random() < 0.4:
                self.put(r.choice(["h2", "h3", "h4", "div"]), self.words(1, 5))
            for _ in range(r.choice([1, 1, 2, 4])):
                self.links(1, 6) if r.random() < 0.35 else self.sentences(1, 40)
        elif part == "menu":
            self.links(2, 12)
        elif part == "header":
            self.put(r.choice(["h1", "div", "p"]), self.words(1, 5), link=r.random() < 0.5)
            if r.random() < 0.5:
                self.sentences(2, 12)
            if r.random() < 0.5:
                self.links(2, 8)
        elif part == "footer":
            if r.random() < 0.6:
                self.links(2, 8)
            self.out.append(f"&copy; {r.choice(['example.org', '2024'])} &middot; {self.words(2, 25)}")
        elif part in ("sidebar", "related"):
            for _ in range(r.randint(1, 3)):
                self.put(r.choice(["h2", "h3", "h4"]), self.words(1, 4))
                self.links(2, 8) if r.random() < 0.6 else self.sentences(5, 50)
        elif part in ("notice", "advert"):
            self.out.append(self.words(2, 40)) if end == "</p>" else self.sentences(2, 40)
            if r.random() < 0.5:
                self.out.append(f'<a href="#">{self.words(1, 3)}</a>')
        elif part == "form":
            if r.random() < 0.6:
                self.put("p", self.words(2, 25))
            self.out.append(f'<label>{self.words(1, 3)}</label><input name="q"><button>{self.words(1, 2)}</button>')
        elif part == "share":
            self.links(2, 6) if r.random() < 0.7 else self.out.append(self.words(2, 8))
        else:
            self.put(r.choice(["h2", "h3"]), self.words(1, 3))
            for _ in range(r.randint(1, 6)):
                tag = r.choice(["div", "li", "article", "p"])
                self.out.append(f"<{tag} class=\"{r.choice(['comment', 'comment-body', 'reply', 'c', 'u'])}\">")
                if tag != "p":
                    self.put("div", self.words(1, 3))
                    self.put("p", self.words(3, 80))
                else:
                    self.out.append(self.words(3, 80))
                self.out.append(f"</{tag}>")
            if r.random() < 0.3:
                self.part("form")
        self.out.append(end)

    def some(self, *parts: str, chance: float = 0.4) -> None:
        for part in parts:
            if self.r.random() < chance:
                self.part(part)

    def main_block(self) -> None:
        r, kind = self.r, self.r.random()
        if kind < 0.72:
            self.put("p", self.words(*self.length()), main=True)
        elif kind < 0.78:
            self.out.append(f"<p><b>{MARK}{self.words(*self.length())}<br>")
        elif kind < 0.84:
            self.put(r.choice(["h2", "h3"]), self.words(1, 8), main=True)
        elif kind < 0.89:
            self.out.append(r.choice(["<ul>", "<ol>"]))
            for _ in range(r.randint(2, 6)):
                self.put("li", self.words(1, 25), main=True, link=r.random() < 0.15)
            self.out.append("</ul>")
        elif kind < 0.93:
            self.put("blockquote", f"<p>{MARK}{self.words(5, 40)}</p>")
        elif kind < 0.95:
            self.put("pre", self.words(3, 30), main=True)
        elif kind < 0.97:
            self.out.append("<table>" + "".join(f"<tr><td>{MARK}{self.words(1, 4)}</td><td>{MARK}{self.words(1, 4)}</td></tr>" for _ in range(r.randint(1, 5))) + "</table>")
        elif kind < 0.985:
            self.put("div", self.words(*self.length()), main=True)
        else:
            linked = f'{MARK}{self.words(3, 20)} <a href="/x">{self.words(1, 4)}</a> {self.words(3, 30)}'
            self.put("p", linked)

    def article(self, bare: bool) -> None:
        r = self.r
        ends = [] if bare else [self.open("article", 0.75) for _ in range(r.choice([1, 1, 1, 2]))]
        if r.random() < 0.8:
            head = r.random() < 0.15 and not bare
            self.out.append("<header>" if head else "")
            self.put("h1", self.words(1, 12), main=True)
            self.out.append("</header>" if head else "")
        inside = 0 if bare else 0.25
        self.some("share", chance=inside)
        for _ in range(r.choice([0, 1, 1, 2, 3, 5, 8, 20])):
            self.main_block()
            if r.random() < inside / 4:
                self.part(r.choice(["advert", "related", "form", "notice", "sidebar"]))
        if r.random() < 0.15 and not bare:
            self.out.append(f"{MARK}{self.words(3, 40)}")
        self.some("share", "related", "comments", chance=inside / 2)
        self.out += reversed(ends)

    def page(self) -> str:
        r, kind = self.r, self.r.random()
        self.out.append('<!DOCTYPE html><html><head><title>x</title><style>p{}</style></head><body>')
        if kind < 0.3:  # plain pages
            self.some("menu", "header", "advert", "notice", chance=0.6)
            end = self.open("article", tags=["article", "article", "main"])
            self.out.append("" if r.random() < 0.2 else f"<h1>{MARK}{self.words(1, 12)}</h1>")
            for _ in range(r.choice([0, 1, 1, 2, 3, 8, 20])):
                self.main_block()
            self.out.append(end)
            self.some("comments", "footer", chance=0.6)
        elif kind < 0.37:  # hardly any furniture
            self.some("menu", chance=0.4)
            self.article(bare=True)
            self.some("footer", chance=0.4)
        else:
            ends = [self.open("wrapper", 0.6) for _ in range(r.choice([0, 0, 1, 2]))]
            self.some("notice", "header", "menu", "advert", "form", chance=0.45)
            ends += [self.open("wrapper", 0.6) for _ in range(r.choice([0, 1, 1, 2]))]
            self.some("sidebar", "menu", "advert", chance=0.25)
            self.article(bare=False)
            self.some("share", "comments", "related", "sidebar", "advert", "form", chance=0.35)
            self.out += reversed(ends)
            self.some("advert", "footer", "menu", "notice", chance=0.45)
        self.out.append("</body></html>")
        return "".join(self.out)


def pool_of(page: str) -> list[str]:
    """Visible words of a page, and a few of our own where it has hardly any."""
    text = re.sub(r"(?s)<(script|style).*?</\1>|<[^>]*>", " ", page or "").replace(MARK, "")
    found = entities.unescape(text).split()[:5000]
    return found if len(found) >= 40 else found + [f"word{i}." if i % 7 == 0 else f"word{i}" for i in range(40)]


def labelled(pages: DataFrame, sample: int = SAMPLE_PAGES, written: int = WRITTEN_PAGES) -> DataFrame:
    """Feature rows of nodes with text, label 1 for those that hold main text, from written pages."""
    known = pages.select("page_id", "html").where(F.col("html").isNotNull())
    ends = known.select("page_id").orderBy(F.col("page_id").asc_nulls_last()).limit(sample)
    last = ends.agg(F.max("page_id")).first()[0]
    near = known.where(F.col("page_id") <= F.lit(last)) if last is not None else known
    few = near.orderBy(F.col("page_id").asc_nulls_last(), "html").limit(sample)
    layouts = -(-written // max(few.count(), 1))

    def lay_out(batches):
        for batch in batches:
            for source in batch.column(0):
                pool = pool_of(source.as_py())
                nodes = Nodes()
                for k in range(layouts):
                    parse(k, Writer(pool, zlib.crc32(source.as_py().encode()) + k).page(), nodes)
                main = [text is not None and MARK in text for text in nodes.text]
                nodes.rows = [(*r[:5], r[5] and (r[5].replace(MARK, "") or "x"), *r[6:]) for r in nodes.rows]
                for i in range(len(main) - 1, 0, -1):
                    if main[i] and nodes.rows[i][1] >= 0:
                        main[nodes.rows[i][1]] = True
                x = measure(nodes)
                used = x[:, FEATURES.index("words")] > 0
                rows = pa.array(list(x[used]), pa.list_(pa.float64()))
                label = pa.array(np.array(main, np.int32)[used])
                yield pa.RecordBatch.from_arrays([rows, label], names=["x", "label"])

    return few.repartition(16, "html").select("html").mapInArrow(lay_out, "x array<double>, label int")


def fit(pages: DataFrame, sample: int = SAMPLE_PAGES, written: int = WRITTEN_PAGES) -> boosting.Boosted | None:
    """Trees fitted on pages written from a bounded sample; None for a table without any page."""
    if not pages.select("html").where(F.col("html").isNotNull()).head(1):
        return None
    rows = cut(labelled(pages, sample, written))
    few = boosting.bounded_sample(rows, "x", "label", FIT_NODES)
    fitted = boosting.fit(few, "x", "y", TREES, DEPTH, STEP, classes=2, most=FIT_NODES)
    # of two classes the trees are the same with opposite values: those of main text are enough
    main = fitted.nodes[fitted.nodes["class"] == 1]
    return boosting.Boosted(1, fitted.width, main.assign(**{"class": 0}))


def blocks(sources: list[str | None], trees: boosting.Boosted) -> list[list[str]]:
    """The main text blocks of each page."""
    nodes = Nodes()
    for page, source in enumerate(sources):
        parse(page, source or "", nodes)
    found: list[list[str]] = [[] for _ in sources]
    chance = 1 / (1 + np.exp(-2 * trees.margins(measure(nodes))[:, 0]))
    kept = consistent(nodes, chance)
    for i in np.flatnonzero(kept):
        row = nodes.rows[i]
        if row[5] is not None:
            found[row[0]].append(row[5])
    return found


def extract(pages: DataFrame, trees: boosting.Boosted | None) -> DataFrame:
    """page_id, url and the blocks of main text of every page."""
    small_batches(pages.sparkSession, 4 << 20)
    kinds = dict(pages.dtypes)
    read = pages.select("page_id", "url", "html")

    def scan(batches):
        for batch in batches:
            sources = batch.column(2).to_pylist()
            found = blocks(sources, trees) if trees else [[] for _ in sources]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(found, pa.list_(pa.string()))],
                names=["page_id", "url", "blocks"],
            )

    return read.mapInArrow(scan, f"page_id {kinds['page_id']}, url {kinds['url']}, blocks array<string>")


def main_text(found: DataFrame) -> DataFrame:
    """page_id, url, text (blocks joined by an empty line) and its code points."""
    text = F.concat_ws("\n\n", "blocks")
    return found.select("page_id", "url", text.alias("text")).withColumn("n_chars", F.length("text").cast("long"))
