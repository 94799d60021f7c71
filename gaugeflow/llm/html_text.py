"""Main text of web pages: wrapper induction over pages of one host.

Pages of a host come from a few templates. Their trees are aligned by simple tree matching; slots
whose text stays the same from page to page belong to the template, varying ones are content.
What names itself a menu, advert, form, comment and so on is never content, unless it holds the article.
"""

from __future__ import annotations

import json
import re
import sys
from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gaugeflow.llm.common import staged, whole

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # tasks need no copy of this package

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements that begin and end a block of text.
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure "
    "footer form h1 h2 h3 h4 h5 h6 header hr html legend li main menu nav ol optgroup option p pre section summary "
    "table tbody td tfoot th thead tr ul".split()
)
#: Elements whose text is never part of an article.
APART = frozenset(
    "aside button canvas dialog fieldset footer form head iframe input label menu nav noscript object optgroup option "
    "script select style svg template textarea title video audio".split()
)
#: Classes, ids and roles that name such an element, alone or together with words of ``PLAIN_WORDS``.
APART_WORDS = frozenset(
    "ad ads adv advert advertisement advertising adsense banner sponsor sponsored promo promoted promotion "
    "nav navbar navigation menu menubar breadcrumb breadcrumbs pagination pager toc "
    "header masthead topbar footer bottombar contentinfo complementary "
    "sidebar side aside widget rail related recommended recommendations trending "
    "notice cookie cookies consent gdpr popup modal overlay alert toast paywall "
    "comment comments disqus reply replies respond discussion reactions "
    "share sharing social follow newsletter subscribe subscription signup login search".split()
)
#: Words that say nothing of the content beside one of ``APART_WORDS`` (as in ad-box, site-footer).
PLAIN_WORDS = frozenset(
    "area articles bar block bottom box button buttons container content form group holder icons inner item items left "
    "link links list main module outer panel posts primary right secondary section site slot stories top unit wrap "
    "wrapper".split()
)
#: Of ``APART_WORDS``, those that also name real parts of an article; they count only outside of one.
DOUBTFUL = frozenset("alert banner discussion follow header notice overlay rail search side toc widget".split())
HEADINGS = frozenset(("h1", "h2", "h3", "h4", "h5", "h6"))
#: Elements that stay whatever their class says.
ROOTS = frozenset(("html", "body", "article", "main"))
#: A start tag of these ends an open paragraph.
ENDS_P = BLOCK - {"caption", "td", "th", "tr", "tbody", "thead", "tfoot", "legend", "optgroup", "option", "html", "body"}
#: Start tags that end an open element of the same kind.
ENDS_OWN = {"li": ("ul", "ol", "menu"), "td": ("tr",), "th": ("tr",), "tr": ("table",), "option": ("select",), "dt": ("dl",), "dd": ("dl",)}
#: Deeper elements share the slot of their ancestor at this depth.
DEPTH = 64


def named_apart(attrs: dict[str, str], article: bool) -> bool:
    """Whether a whole class, id or role says menu, advert, comment and so on; no-sidebar, entry-header do not."""
    for token in f"{attrs.get('class', '')} {attrs.get('id', '')} {attrs.get('role', '')}".lower().split():
        found = set(re.findall(r"[^\W\d_]+", token))
        apart = found & APART_WORDS
        if apart and found <= APART_WORDS | PLAIN_WORDS and not (article and apart <= DOUBTFUL):
            return True
    return False


class Node:
    """An element of the shape tree: siblings with equal labels are one node."""

    __slots__ = ("label", "children", "number")

    def __init__(self, label: str, number: int):
        self.label, self.children, self.number = label, {}, number


#: Where a text stands; ``IN_NAMED`` is an article within an element whose name sets it apart.
OUTSIDE, IN_NAMED, IN_MAIN, IN_ARTICLE = range(4)


class Page(HTMLParser):
    """Blocks of text of a page with the number of the slot each stands in."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = Node("", 0)
        self.n_nodes = 1
        # per open element: tag, node, kept apart, kept apart for a name only, place (see below)
        self.stack = [("", self.root, False, False, OUTSIDE)]
        self.n_named = 0
        self.blocks: list[tuple[int, str, int]] = []
        self.text: list[str] = []
        self.place = (0, OUTSIDE)

    def _end_block(self) -> None:
        if self.text:
            found = " ".join("".join(self.text).split())
            if found:
                self.blocks.append((self.place[0], found, self.place[1]))
            self.text = []

    def _pop(self, at: int) -> None:
        if any(e[0] in BLOCK for e in self.stack[at:]):
            self._end_block()
        del self.stack[at:]

    def _close(self, tag: str, within: tuple[str, ...] = ()) -> None:
        for at in range(len(self.stack) - 1, 0, -1):
            if self.stack[at][0] == tag:
                self._pop(at)
                return
            if self.stack[at][0] in within:
                return

    def handle_starttag(self, tag, attrs):
        if tag in BLOCK:
            self._end_block()
        if tag in ENDS_P:
            self._close("p", ("table", "article", "main", "body"))
        if tag in ENDS_OWN:
            self._close(tag, ENDS_OWN[tag])
            if tag in ("dt", "dd"):
                self._close("dd" if tag == "dt" else "dt", ("dl",))
        if tag in VOID:
            if tag == "br" and self.text:
                self.text.append(" ")
            return
        _, parent, apart, named, place = self.stack[-1]
        attrs = {k: v or "" for k, v in attrs}
        words = sorted(set(re.findall("[a-z]+", f"{attrs.get('class', '')} {attrs.get('id', '')} {attrs.get('role', '')}".lower())))
        if tag not in ROOTS:
            hidden = "hidden" in attrs or "display:none" in attrs.get("style", "").replace(" ", "").lower()
            apart = apart or hidden or tag in APART or (tag == "header" and not place)
            if not (place and tag in HEADINGS):
                named = named or named_apart(attrs, bool(place))
        elif tag in ("article", "main") and place in (IN_NAMED, IN_ARTICLE) and named_apart(attrs, True):
            named = True  # a comment or teaser set as an article of its own within the article
        elif tag in ("article", "main") and place in (OUTSIDE, IN_MAIN):
            if named:  # the wrapper's name does not count where it holds the article
                place, named = IN_NAMED, False
                self.n_named += not apart
            elif tag == "article" and named_apart(attrs, True) and place:
                named = True
            else:
                place = IN_ARTICLE if tag == "article" else IN_MAIN
        node = parent
        if len(self.stack) <= DEPTH:
            label = " ".join([tag, *words])
            node = parent.children.get(label)
            if node is None:
                node = parent.children[label] = Node(label, self.n_nodes)
                self.n_nodes += 1
        self.stack.append((tag, node, apart, named, place))

    def handle_endtag(self, tag):
        if tag not in VOID:
            self._close(tag)

    def handle_data(self, data):
        _, node, apart, named, place = self.stack[-1]
        if apart or named:
            return
        if not self.text:
            block = next((e for e in reversed(self.stack) if e[0] in BLOCK), self.stack[0])
            self.place = (block[1].number, place)
        self.text.append(data)


def parse(html: str) -> Page:
    """The page's slots and blocks. A tag cut off by the end of the page is no text."""
    cut = html.rfind("<")
    if cut >= 0 and html.find(">", cut) < 0 and re.match(r"<[A-Za-z/!?]", html[cut : cut + 2]):
        html = html[:cut]
    page = Page()
    page.feed(html)
    page.close()
    page._end_block()
    return page


def main_blocks(page: Page) -> list[tuple[int, str]]:
    """Slots and texts inside the article or main element; of the whole body where there is none.

    An article within an element named menu, advert and so on counts where no other one holds text:
    it is the main text, or, beside text of the main element, a part of it if it is the only one.
    """
    places = {place for _, _, place in page.blocks}
    if IN_ARTICLE in places or (IN_MAIN in places and page.n_named > 1):
        use = {IN_MAIN, IN_ARTICLE}
    elif places & {IN_MAIN, IN_NAMED}:
        use = {IN_MAIN, IN_NAMED}
    else:
        use = {OUTSIDE}
    return [(slot, text) for slot, text, place in page.blocks if place in use]


def tree_of(node: Node) -> list:
    return [node.label, node.number, [tree_of(c) for c in node.children.values()]]


#: Elements that tell templates apart, down to the third level below the body.
FRAME = frozenset("article aside div footer header main nav section table tbody td tr".split())


def template_of(root: Node) -> str:
    """The upper levels of the shape tree, without order and without what stands within the article."""

    def frame(node: Node, depth: int) -> list:
        tag = node.label.split(" ")[0]
        if depth == 0 or tag in ("article", "main") or tag in APART:
            return [node.label]
        below = (c for c in node.children.values() if c.label.split(" ")[0] in FRAME)
        return [node.label, sorted(frame(c, depth - 1) for c in below)]

    tops, bodies = [root], []
    while tops:
        node = tops.pop()
        inner = [c for c in node.children.values() if c.label.split(" ")[0] in ("html", "body")]
        tops += inner
        bodies.append(frame(Node(node.label, 0), 0) + [frame(c, 2) for c in node.children.values() if c.label.split(" ")[0] in FRAME])
    return json.dumps(sorted([b[0], sorted(b[1:])] for b in bodies))


def paths(node: list, above: str = "") -> dict[int, str]:
    """The labels from the root to every slot."""
    here = f"{above}/{node[0]}"
    out = {node[1]: here}
    for child in node[2]:
        out |= paths(child, here)
    return out


def match(a: list, b: list) -> tuple[int, list[tuple[int, int]]]:
    """Simple tree matching: the most pairs of equal labels that keep order and descent.

    Returns their number and the pairs of slot numbers.
    """
    if a[0] != b[0]:
        return 0, []
    x, y = a[2], b[2]
    pairs = [[match(p, q) for q in y] for p in x]
    best = [[0] * (len(y) + 1) for _ in range(len(x) + 1)]
    for i in range(1, len(x) + 1):
        for j in range(1, len(y) + 1):
            best[i][j] = max(best[i - 1][j], best[i][j - 1], best[i - 1][j - 1] + pairs[i - 1][j - 1][0])
    out, i, j = [(a[1], b[1])], len(x), len(y)
    while i and j:
        if best[i][j] == best[i - 1][j]:
            i -= 1
        elif best[i][j] == best[i][j - 1]:
            j -= 1
        else:
            i, j = i - 1, j - 1
            out += pairs[i][j][1]
    return best[len(x)][len(y)] + 1, out


def host_of(url: Column) -> Column:
    return F.coalesce(F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1)), F.lit(""))


def constant_blocks(pages: DataFrame, ratio: float, min_pages: int) -> DataFrame:
    """``page_id, drop``: numbers of the blocks of a page that belong to a template of its host.

    ``pages`` has ``page_id, host, html``. A host's pages with equal upper levels of the shape tree
    share a template. Every page is aligned with the reference page of its template, and of its host
    where that has several templates (the one with text whose content hashes lowest), and counted
    under the reference's slots; a slot without match stands for itself, by its path. Counts are over
    all pages and combined map-side, so a hot host sends one row per block and task.
    """
    kind = pages.schema["page_id"].dataType.simpleString()

    def shape(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import xxhash

        for batch in batches:
            rows = []
            for key, host, html in zip(batch["page_id"], batch["host"], batch["html"]):
                page = parse(html)
                blocks = [(slot, xxhash.xxh3_64_intdigest(t) - 2**63) for slot, t in main_blocks(page)]
                content = xxhash.xxh3_64_intdigest(repr(blocks)) - 2**63
                template = xxhash.xxh3_64_intdigest(template_of(page.root)) - 2**63
                rows.append((key, host, template, json.dumps(tree_of(page.root)), content, [b[0] for b in blocks], [b[1] for b in blocks]))
            yield pd.DataFrame(rows, columns=["page_id", "host", "template", "tree", "content", "slots", "hashes"])

    shaped = staged(
        pages.mapInPandas(
            shape, f"page_id {kind}, host string, template long, tree string, content long, slots array<int>, hashes array<long>"
        ),
        "html-shapes",
    )
    # a page counts in its template, and in its host (template null) where that has several
    least = F.min(F.struct((F.size("slots") == 0).alias("empty"), "content", "tree"))
    own = staged(shaped.groupBy("host", "template").agg(least.alias("r")), "html-references")
    all_of = own.groupBy("host").agg(F.min("r").alias("r"), F.count("*").alias("n")).filter("n > 1")
    reference = own.select("host", F.struct("template").alias("level"), F.col("r.tree").alias("reference")).union(
        all_of.select("host", F.struct(F.lit(None).cast("long").alias("template")), "r.tree")
    )
    none = F.struct(F.lit(None).cast("long").alias("template"))
    levels = shaped.withColumn("level", F.explode(F.array(F.struct("template"), none))).drop("template")

    @F.pandas_udf("array<long>")
    def aligned(trees: pd.Series, references: pd.Series, slots: pd.Series) -> pd.Series:
        import xxhash

        known: dict = {}
        out = []
        for t, r, s in zip(trees, references, slots):
            if (t, r) not in known:
                tree = json.loads(t)
                alone = {x: -1 - (xxhash.xxh3_64_intdigest(p) >> 1) for x, p in paths(tree).items()}
                known[t, r] = alone | dict(match(tree, json.loads(r))[1])
            at = known[t, r]
            out.append([at[int(x)] for x in s])
        return pd.Series(out, dtype=object)

    placed = levels.join(reference, ["host", "level"]).select(
        "page_id", "host", "level", "content", F.arrays_zip(aligned("tree", "reference", "slots").alias("slot"), F.col("hashes").alias("hash")).alias("b")
    )
    placed = staged(placed.select("page_id", "host", "level", "content", F.posexplode("b").alias("at", "b")).select(
        "page_id", "host", "level", "content", "at", F.col("b.slot").alias("slot"), F.col("b.hash").alias("hash")
    ), "html-blocks")
    # pages with the same content are one page
    distinct = levels.select("host", "level", "content").distinct().groupBy("host", "level").agg(F.count("*").alias("pages"))
    block = ["host", "level", "slot", "hash"]
    seen = placed.select(*block, "content").distinct().groupBy(*block).agg(F.count("*").alias("n"))
    constant = (
        seen.filter(F.col("n") >= min_pages).join(distinct, ["host", "level"]).filter(F.col("n") >= ratio * F.col("pages"))
        .select(*block)
    )
    return placed.join(staged(constant, "html-template"), block).groupBy("page_id").agg(F.collect_set("at").alias("drop"))


def main_text(
    pages: DataFrame,
    html_col: str = "html",
    url_col: str = "url",
    id_col: str = "page_id",
    ratio: float = 0.5,
    min_pages: int = 3,
) -> DataFrame:
    """``page_id, url, text`` per page: the blocks of its main text, joined by line feeds.

    A block of the article is template, and dropped, when it stands in the same slot of at least
    ``ratio`` of the pages of its template (or of its host), and of ``min_pages`` (pages of equal content
    count once). Blocks
    outside the article, and those in menus, headers, footers, sidebars, notices, adverts, forms,
    scripts, styles and comments, are no content. Character references are decoded, white space in a
    block becomes one space. Missing html is empty and gives an empty text; a missing or odd url
    belongs to the host ``""``. Repeated rows each give a row (ids should tell pages apart). An
    empty table gives no rows.
    """
    numbered = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), whole(html_col).alias("html"))
    drop = staged(constant_blocks(numbered.select("page_id", host_of(F.col("url")).alias("host"), "html"), ratio, min_pages), "html-drop")
    drop = drop.select(F.col("page_id").alias("__id"), "drop")

    @F.pandas_udf("string")
    def extract(html: pd.Series, dropped: pd.Series) -> pd.Series:
        out = []
        for h, d in zip(html, dropped):
            gone = set() if d is None else set(d)
            out.append("\n".join(t for i, (_, t) in enumerate(main_blocks(parse(h))) if i not in gone))
        return pd.Series(out, dtype=object)

    joined = numbered.join(drop, numbered["page_id"] == F.col("__id"), "left")
    return joined.select("page_id", "url", extract("html", "drop").alias("text"))
