"""Main text of web pages through site style trees.

The pages of one host are merged into a style tree: a node is a path of
elements with their tags and classes; its contents are the texts that stand
there on the host's pages.  A node's importance is one minus the mean entropy
of its contents over the distinct pages that have the node, in logs to the base
of their number: texts that recur on page after page tell nothing, texts of one
page tell most.  Of a node of low importance the contents that stand on two or
more distinct pages are removed, never a text of one page.

Elements have presentations, too: which elements with text stand directly in a
node on a page.  A node's presentation importance is the entropy of its
presentations over its distinct pages.  The composite importance of a branch is
(1 - g^l) times that of its top plus g^l times the mean of its l parts, the
branches inside and the contents of the top itself; it is found from the leaves
up on a page's own elements, with the site's figures.  A branch is noise if it
and all branches inside it are of low importance.  Where a page marks its
article, only such whole branches inside it lose their repeated contents, and
the bound is stricter; on other pages contents count on their own.

Near copies are not distinct pages.  A page weighs the mean of 1 / n over its
characters, n being the pages of the host where the text they stand in occurs:
k copies weigh one page together, and a page of its own weighs one.  Where
most of a page stands on others, too, what is its own doesn't raise its weight,
so reposts under other headlines are still one page.

What elements say about themselves comes first: scripts, menus, footers, forms,
adverts, notices and comments are noise on any host, and where a page marks its
article, text is looked for inside it.  So hosts with one page work, too.  A class or id that names furniture is only a
hint: an element that holds most of the text is a wrapper whatever its name,
and so is one around the article.  Comments go whatever their share.

Pages are parsed once.  Counting is by host, node and text with partial counts
before the shuffle; what goes back to a page is only the list of its own noisy
contents.
"""

from __future__ import annotations

import re
from html import unescape

import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from faultline.llm.common import short_batches, stored

# least distinct pages of a host with a node before its importance counts
LEAST_PAGES = 4
# importance below which a node outside marked articles is noise
NOISE_OUTSIDE = 0.35
# composite importance below which a branch inside a marked article is noise
NOISE_INSIDE = 0.1
# weight g of what a branch holds against the presentation of its top
INNER = 0.9
# distinct pages from which on a noisy node's content is repeated
REPEATED = 2
# share of a page's characters that stand on other pages of the host, from which on it is a near copy
NEAR_COPY = 2 / 3

# Element names of HTML, and words that class, id and role use for page furniture.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q ruby rt rp s samp small span strike strong sub sup time tt u var wbr img".split()
)
SILENT = frozenset(
    "script style noscript template head title nav footer aside form button select textarea option input iframe object embed svg canvas audio video dialog menu map math".split()
)
CLOSES = {
    "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"},
    "thead": {"tr", "td", "th"}, "tbody": {"thead", "tr", "td", "th"}, "tfoot": {"tbody", "tr", "td", "th"}, "option": {"option"},
}
RAW = ("script", "style", "title", "textarea", "iframe", "xmp", "noembed", "noframes")
SCOPES = frozenset("html body table ul ol dl article main section div td th".split())
FURNITURE = frozenset(
    "ad ads advert adverts advertisement advertising adsense adslot banner sponsor sponsored promo promotion nav navbar navigation menu submenu sidebar breadcrumb "
    "breadcrumbs footer cookie cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe subscription signup share sharing social related "
    "recommended recommendations comments comment disqus respond reply replies feedback toolbar pagination pager login search widget widgets links tags".split()
)
ROLES = frozenset("navigation banner contentinfo complementary search form alert dialog menu menubar alertdialog".split())
ARTICLE_FURNITURE = FURNITURE - {"banner", "search", "widget", "widgets", "alert"}
COMMENTS = frozenset("comments comment disqus respond reply replies feedback".split())
# a name with one of these words tells a state of the element ("has-sidebar", "comments-open"), not what it is
STATES = frozenset("has no not with without open opened closed enabled disabled allow allowed allows".split())
# an element with a name of furniture is a wrapper if it holds more than this share of the text without comments; comments, often longer than what they are about, are never one
MOST = 0.5
OUTSIDE, INSIDE, MAYBE = 0, 1, 2
_WORDS = re.compile(r"[a-z]+")


# a tag to its end; quotes hide a > only as the value of an attribute
_TAG = re.compile(r"""</?([A-Za-z][^\s/>]*+)((?:[^>=]++|=\s*+(?:"[^"]*+"|'[^']*+'|[^\s>"'][^\s>]*+)?+)*+)>""")
_ATTRIBUTE = re.compile(r"""([^\s/=>"'][^\s/=>]*+)(?:\s*+=\s*+(?:"([^"]*+)"|'([^']*+)'|([^\s>]*+)))?+""")
_COMMENT_END = re.compile("--!?>")
_RAW_END = {tag: re.compile(f"</{tag}(?=[\\s/>])", re.IGNORECASE) for tag in RAW}


class _Page:
    """Text blocks of a page: (node, outside, inside or maybe inside an article, text, innermost element named like furniture).

    Reading takes linear time and memory, whatever the page: every search that
    ran to the end of the page in vain is not made again, and of the open
    elements the positions are kept by tag.
    """

    def __init__(self) -> None:
        self.blocks: list[tuple[int, int, str, int]] = []
        self.stack: list[tuple[str, int, bool, int, int]] = []  # tag, node, silent, inside an article, named
        self.above: dict[int, tuple[int, bool]] = {}  # of a node: its parent, and whether that is inside an article, too
        self.named: list[tuple[int, bool, bool]] = [(0, False, False)]  # of elements named like furniture: the next one around, inside an article, comments
        self.text: list[str] = []
        # positions in the stack: of each tag, of scopes, of elements that aren't inline
        self.opened: dict[str, list[int]] = {}
        self.scopes: list[int] = []
        self.outline: list[int] = []

    def read(self, source: str) -> None:
        """Feed the tags and texts of a page, in order.

        A mark of a comment, or a tag, that never ends is no reason to lose the
        text behind it: of the comment only the mark goes, a < without any >
        behind it is text, and a tag whose every > stands in quotes ends at the
        first, as do all tags behind it.
        """
        last = source.rfind(">")
        endless: set[str] = set()
        quotes = True

        def end_of(mark: re.Pattern, at: int) -> re.Match | None:
            found = None if mark.pattern in endless else mark.search(source, at)
            if not found:
                endless.add(mark.pattern)
            return found

        at = 0
        while (start := source.find("<", at)) >= 0:
            if start > at:
                self._data(source[at:start])
            sign = source[start + 1 : start + 3]
            if source.startswith("<!--", start):
                end = end_of(_COMMENT_END, start + 2)
                at = end.end() if end else start + 4
            elif start > last or not (sign[:1].isalpha() and sign[:1].isascii() or sign[:1] in ("!", "?", "/")):
                self._data("<")
                at = start + 1
            elif sign[0] in "!?" or (sign[0] == "/" and not (sign[1:].isalpha() and sign.isascii())):
                at = source.index(">", start) + 1
            else:
                tag = _TAG.match(source, start) if quotes else None
                if tag:
                    at, name, rest = tag.end(), tag[1].lower(), tag[2]
                else:
                    quotes = False
                    at = source.index(">", start) + 1
                    name, _, rest = source[start:at].strip("</>").partition(" ")
                    name = name.lower()
                if sign[0] == "/":
                    self._end(name)
                elif name in RAW:
                    end = end_of(_RAW_END[name], at)
                    at = end.start() if end else len(source) if name in ("script", "style") else at
                    if name not in INLINE:
                        self._flush()
                else:
                    self._start(name, rest)
        self._data(source[at:])
        self._flush()

    def _flush(self) -> None:
        if self.text:
            whole = " ".join("".join(self.text).split())
            self.text = []
            if whole:
                # the node of a block is its nearest element that isn't inline
                _, node, _, inside, _ = self.stack[self.outline[-1]] if self.outline else ("", 0, False, OUTSIDE, 0)
                self.blocks.append((node, inside, whole, self.stack[-1][4] if self.stack else 0))

    def _furniture(self, tag: str, attributes: dict[str, str], inside: int) -> bool:
        if tag in SILENT or (tag == "header" and not inside) or "hidden" in attributes or attributes.get("aria-hidden") == "true":
            return True
        if "display:none" in attributes.get("style", "").replace(" ", "").lower():
            return True
        return tag not in ("html", "body", "article", "main") and attributes.get("role", "").lower() in ROLES

    def _name(self, tag: str, attributes: dict[str, str], inside: int, above: int) -> int:
        """The element in ``named`` if its class or id names furniture, else the one around it."""
        if tag in ("html", "body", "article", "main"):
            return above
        words: set[str] = set()
        for name in f"{attributes.get('class', '')} {attributes.get('id', '')}".lower().split():
            parts = set(_WORDS.findall(name))
            if parts.isdisjoint(STATES):
                words |= parts
        if words.isdisjoint(ARTICLE_FURNITURE if inside else FURNITURE) and (inside or "header" not in words):
            return above
        self.named.append((above, bool(inside), not words.isdisjoint(COMMENTS)))
        return len(self.named) - 1

    def main_blocks(self) -> list[tuple[int, int, str, int]]:
        """Blocks of the article if one is marked, else of the page, without furniture."""
        for kind in (INSIDE, MAYBE):
            marked = self._without_furniture([b for b in self.blocks if b[1] == kind], True)
            # articles inside furniture may be teasers or comments beside an unmarked text
            if marked and (kind == INSIDE or _chars(marked) >= _chars([b for b in self.blocks if b[1] == OUTSIDE and not b[3]])):
                return marked
        return [(node, OUTSIDE, text, name) for node, _, text, name in self._without_furniture(self.blocks, False)]

    def _without_furniture(self, blocks: list[tuple[int, int, str, int]], article: bool) -> list[tuple[int, int, str, int]]:
        """``blocks`` outside comments and outside all other named elements that hold too little of the rest; for an article only names inside it count."""
        gone = [False] * len(self.named)
        for name in range(1, len(gone)):
            above, inside, comments = self.named[name]
            gone[name] = gone[above] or (comments and (inside or not article))
        blocks = [b for b in blocks if not gone[b[3]]]
        held = [0] * len(self.named)
        for _, _, text, name in blocks:
            held[name] += len(text)
        # elements come after those around them
        for name in range(len(held) - 1, 0, -1):
            held[self.named[name][0]] += held[name]
        for name in range(1, len(held)):
            above, inside, _ = self.named[name]
            gone[name] = gone[name] or gone[above] or ((inside or not article) and held[name] <= MOST * held[0])
        return [b for b in blocks if not gone[b[3]]]

    def elements(self, blocks: list[tuple[int, int, str, int]]) -> list[tuple[int, int, int]]:
        """(node, parent, presentation) of the elements around ``blocks``, parents first; of an article only those inside it, 0 being the top."""
        parents: dict[int, int] = {}
        parts: dict[int, set[int]] = {}
        for node, inside, _, _ in blocks:
            path = []
            here = node
            while here and here not in parts:
                parent, within = self.above[here]
                if inside and not within:
                    break
                parts[here] = set()
                path.append((here, parent))
                here = parent
            for at, parent in reversed(path):
                parents[at] = parent if parent in parents else 0
                parts.setdefault(parents[at], set()).add(at)
            if node in parents:
                parts[node].add(0)
        digest = lambda node: xxhash.xxh3_64_intdigest(",".join(f"{x:x}" for x in sorted(parts[node])))
        return [(node, parent, digest(node)) for node, parent in parents.items()]

    def _nearest(self, tags: frozenset[str]) -> int:
        """Position of the innermost open element of ``tags``, -1 without one."""
        return max((self.opened[t][-1] for t in tags if self.opened.get(t)), default=-1)

    def _open(self, tag: str, node: int, silent: bool, inside: int, name: int) -> None:
        at = len(self.stack)
        self.stack.append((tag, node, silent, inside, name))
        self.opened.setdefault(tag, []).append(at)
        if tag in SCOPES:
            self.scopes.append(at)
        if tag not in INLINE:
            self.outline.append(at)

    def _drop(self, at: int) -> None:
        while len(self.stack) > at:
            self.opened[self.stack.pop()[0]].pop()
        for positions in (self.scopes, self.outline):
            while positions and positions[-1] >= at:
                positions.pop()

    def _close(self, at: int) -> None:
        if (self.outline and self.outline[-1] >= at) or (self.stack and self.stack[-1][4] != (self.stack[at - 1][4] if at else 0)):
            self._flush()
        self._drop(at)

    def _start(self, tag: str, rest: str) -> None:
        if tag not in INLINE:
            self._flush()
            ends = CLOSES.get(tag)
            if ends:
                while (at := self._nearest(ends | {"p"})) > self._nearest(SCOPES - ends):
                    self._close(at)
            elif (at := self._nearest(frozenset({"p"}))) > (self.scopes[-1] if self.scopes else -1):
                self._close(at)
        if tag in VOID:
            return
        attributes: dict[str, str] = {}
        for key, *values in _ATTRIBUTE.findall(rest):
            attributes.setdefault(key.lower(), unescape("".join(values)))
        _, above, silent, inside, name = self.stack[-1] if self.stack else ("", 0, False, OUTSIDE, 0)
        silent = silent or self._furniture(tag, attributes, inside)
        role = attributes.get("role", "").lower()
        if not silent:
            if tag == "main" or role == "main":
                inside = INSIDE
            elif not inside and (tag == "article" or role == "article"):
                inside = MAYBE if name else INSIDE
        around, name = name, name if silent else self._name(tag, attributes, inside, name)
        if (silent or name != around) and self.text:
            self._flush()
        if tag not in INLINE:
            # a node is known by a running hash of its path, as long as its parent's
            style = "".join(f".{x}" for x in sorted(attributes.get("class", "").split()))
            parent, above = above, xxhash.xxh3_64_intdigest(f"{above:x}/{tag}{style}")
            within = bool(self.stack) and self.stack[-1][3] != OUTSIDE
            self.above.setdefault(above, (parent, within))
        self._open(tag, above, silent, inside, name)
        if tag in INLINE and rest.endswith("/"):
            self._drop(len(self.stack) - 1)

    def _end(self, tag: str) -> None:
        if not self.opened.get(tag):
            return
        at = self.opened[tag][-1]
        # inline elements end inside their block, paragraphs inside their scope
        bounds = self.outline if tag in INLINE else self.scopes if tag == "p" else ()
        if bounds and bounds[-1] > at:
            return
        if self.stack[at][2] and not (at and self.stack[at - 1][2]):
            self.text = []
        self._close(at)

    def _data(self, data: str) -> None:
        if data and not (self.stack and self.stack[-1][2]):
            self.text.append(unescape(data))


def _chars(blocks: list[tuple[int, int, str, int]]) -> int:
    return sum(len(b[2]) for b in blocks)


def _read(html: str | None) -> tuple[list[tuple[int, bool, str]], list[tuple[int, int, int]]]:
    """Blocks of the text of a page (node, inside an article, text) in page order, and the elements around them."""
    if not html:
        return [], []
    page = _Page()
    page.read(html)
    blocks = page.main_blocks()
    long = lambda node: node - (1 << 63)
    return (
        [(long(node), inside != OUTSIDE, text) for node, inside, text, _ in blocks],
        [(long(node), long(parent), long(presentation)) for node, parent, presentation in page.elements(blocks)],
    )


def page_blocks(html: str | None) -> list[tuple[int, bool, str]]:
    """(node hash, inside an article, text) in page order; furniture left out.

    If any part of the page is marked as its article, only blocks inside such parts are given.
    """
    return _read(html)[0]


def noisy_branches(elements: list[tuple[int, int]], presentation: dict[int, float], contents: dict[int, float], bound: float = NOISE_INSIDE) -> list[int]:
    """Tops of all branches whose composite importance, and that of all branches inside, is below ``bound``.

    ``elements`` are (node, parent) with parents first.  A node on too few pages
    to have figures is important.
    """
    parts: dict[int, list[float]] = {node: [contents[node]] if node in contents else [] for node, _ in elements}
    noise = dict.fromkeys(parts, True)
    for node, parent in reversed(elements):
        inner = parts[node]
        held = INNER ** len(inner)
        # a node without elements inside is what its contents are
        whole = node in contents and len(inner) == 1
        composite = inner[0] if whole else (1 - held) * presentation.get(node, 1.0) + held * sum(inner) / len(inner) if inner else 1.0
        noise[node] = noise[node] and composite < bound
        if parent in parts:
            parts[parent].append(composite)
            noise[parent] = noise[parent] and noise[node]
    return [node for node, _ in elements if noise[node]]


def host(url: Column) -> Column:
    return F.lower(F.coalesce(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1), F.lit("")))


def parsed(pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """Per page: __key, __url, __host, __inside (the text is a marked article), __nodes and __texts of its blocks, __elements, __page (stored).

    __page is the same for pages of the same text in the same nodes, whatever furniture stands around it.
    """
    short_batches(pages.sparkSession)

    @F.pandas_udf("inside boolean, nodes array<bigint>, texts array<string>, element array<bigint>, parent array<bigint>, presentation array<bigint>")
    def blocks_of(sources: pd.Series) -> pd.DataFrame:
        found = [_read(s if isinstance(s, str) else None) for s in sources]
        return pd.DataFrame({
            "inside": [any(inside for _, inside, _ in blocks) for blocks, _ in found],
            "nodes": [[node for node, _, _ in blocks] for blocks, _ in found],
            "texts": [[text for _, _, text in blocks] for blocks, _ in found],
            **{name: [[e[at] for e in elements] for _, elements in found] for at, name in enumerate(("element", "parent", "presentation"))},
        })

    rows = pages.select(F.col(key).alias("__key"), F.col(url).alias("__url"), host(F.col(url)).alias("__host"), blocks_of(F.col(html)).alias("b"))
    return stored(rows.select(
        "__key", "__url", "__host", F.col("b.inside").alias("__inside"), F.col("b.nodes").alias("__nodes"), F.col("b.texts").alias("__texts"),
        F.arrays_zip(F.col("b.element").alias("element"), F.col("b.parent").alias("parent"), F.col("b.presentation").alias("presentation")).alias("__elements"),
        F.xxhash64("b.inside", "b.nodes", "b.texts").alias("__page"),
    ), "pages-parsed")


def _same(*pairs: tuple[str, str]) -> Column:
    """Equality of the named columns, pair by pair."""
    on = F.lit(True)
    for a, b in pairs:
        on = on & (F.col(a) == F.col(b))
    return on


def page_weights(found: DataFrame) -> DataFrame:
    """(h, p, weight): how many distinct pages a page is, from rows (host, page, content, chars)."""
    texts = found.select("host", "page", "content", "chars").distinct()
    shared = texts.groupBy(F.col("host").alias("h"), F.col("content").alias("c")).agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    counted = texts.join(shared, _same(("host", "h"), ("content", "c")), "left").withColumn("n", F.coalesce("n", F.lit(1)))
    sums = counted.groupBy(F.col("host").alias("h"), F.col("page").alias("p")).agg(
        F.sum("chars").alias("all"), F.coalesce(F.sum(F.when(F.col("n") > 1, F.col("chars"))), F.lit(0)).alias("common"), F.sum(F.when(F.col("n") > 1, F.col("chars") / F.col("n")).otherwise(0.0)).alias("parts")
    )
    own = F.col("all") - F.col("common")
    weight = F.when(F.col("common") >= NEAR_COPY * F.col("all"), F.col("parts") / F.col("common")).otherwise((own + F.col("parts")) / F.col("all"))
    return sums.select("h", "p", weight.alias("weight"))


def content_importance(weighed: DataFrame) -> DataFrame:
    """(h, k, pages, importance) of the contents of each node, from rows (host, page, node, content, weight)."""
    contents = weighed.groupBy("host", "node", "content").agg(F.sum("weight").alias("n"))
    spread = contents.groupBy("host", "node").agg(F.avg(F.log(F.greatest("n", F.lit(1.0)))).alias("entropy"))
    sizes = weighed.select("host", "node", "page", "weight").distinct().groupBy(F.col("host").alias("h"), F.col("node").alias("k")).agg(F.sum("weight").alias("pages"))
    joined = spread.join(sizes, _same(("host", "h"), ("node", "k")))
    return joined.select("h", "k", "pages", F.when(F.col("pages") > 1, 1 - F.col("entropy") / F.log("pages")).otherwise(1.0).alias("importance"))


def presentation_importance(presented: DataFrame) -> DataFrame:
    """(h, k, pages, importance) of the presentations of each node, from rows (host, page, node, presentation, weight)."""
    kinds = presented.groupBy("host", "node", "presentation").agg(F.sum("weight").alias("n"))
    # sum of -n/m log(n/m) = log m - sum of n log n / m
    sums = kinds.groupBy(F.col("host").alias("h"), F.col("node").alias("k")).agg(F.sum("n").alias("pages"), F.sum(F.col("n") * F.log("n")).alias("logs"))
    entropy = (F.log("pages") - F.col("logs") / F.col("pages")) / F.log("pages")
    return sums.select("h", "k", "pages", F.when(F.col("pages") > 1, entropy).otherwise(1.0).alias("importance"))


def style_tree(rows: DataFrame, least_pages: int = LEAST_PAGES) -> DataFrame:
    """Noise of every host, from the rows of ``parsed``: (host, page, noise), noise being the page's (node, content) to remove."""
    hosted = rows.filter("__host <> ''").select(F.col("__host").alias("host"), F.col("__page").alias("page"), F.col("__inside").alias("inside"), "__nodes", "__texts", "__elements")
    blocks = hosted.select("host", "page", "inside", F.explode(F.arrays_zip("__nodes", "__texts")).alias("b"))
    found = blocks.select("host", "page", "inside", F.col("b.__nodes").alias("node"), F.xxhash64("b.__texts").alias("content"), F.length("b.__texts").alias("chars")).distinct()
    found = stored(found, "style-tree")
    weights = stored(page_weights(found), "style-tree-pages")
    weighed = found.join(weights, _same(("host", "h"), ("page", "p"))).select("host", "page", "inside", "node", "content", "weight")
    weighed = stored(weighed, "style-tree-weights")
    importance = content_importance(weighed).filter(F.col("pages") >= least_pages)
    importance = stored(importance.select("h", "k", "importance"), "style-tree-contents")
    noisy = importance.filter(F.col("importance") < NOISE_OUTSIDE)
    gone = weighed.groupBy("host", "node", "content").agg(F.sum("weight").alias("n")).filter(F.col("n") >= REPEATED).join(noisy, _same(("host", "h"), ("node", "k")), "left_semi")
    gone = gone.select(F.col("host").alias("h"), F.col("node").alias("k"), F.col("content").alias("c"))
    hits = weighed.join(gone, _same(("host", "h"), ("node", "k"), ("content", "c")), "left_semi")
    hits = stored(hits.groupBy("host", "page", "inside").agg(F.collect_list(F.struct("node", "content")).alias("noise")), "style-tree-hits")

    # marked articles: only whole branches inside them
    asked = hits.filter("inside").select(F.col("host").alias("h1"), F.col("page").alias("p1"), "noise")
    sites = asked.select("h1").distinct()
    elements = hosted.filter("inside").select("host", "page", "__elements").join(sites, F.col("host") == F.col("h1"), "left_semi").dropDuplicates(["host", "page"])
    each = elements.select("host", "page", F.explode("__elements").alias("e")).select("host", "page", F.col("e.element").alias("node"), F.col("e.presentation").alias("presentation"))
    each = stored(each.join(weights, _same(("host", "h"), ("page", "p"))).select("host", "page", "node", "presentation", "weight"), "style-tree-elements")
    styles = presentation_importance(each).filter(F.col("pages") >= least_pages).select(F.col("h").alias("h2"), F.col("k").alias("k2"), F.col("importance").alias("style"))
    figures = each.select("host", "page", "node").join(asked.select("h1", "p1"), _same(("host", "h1"), ("page", "p1")), "left_semi")
    figures = figures.join(styles, _same(("host", "h2"), ("node", "k2")), "left").join(importance, _same(("host", "h"), ("node", "k")), "left")
    figures = figures.groupBy(F.col("host").alias("h3"), F.col("page").alias("p3")).agg(F.collect_list(F.struct("node", "style", "importance")).alias("figures"))
    pages = elements.join(asked, _same(("host", "h1"), ("page", "p1"))).join(figures, _same(("host", "h3"), ("page", "p3")))

    @F.pandas_udf("array<bigint>")
    def branches(trees: pd.Series, owned: pd.Series, sites: pd.Series) -> pd.Series:
        out = []
        for tree, own, site in zip(trees, owned, sites, strict=True):
            style = {f["node"]: f["style"] for f in site if f["style"] is not None}
            contents = {f["node"]: f["importance"] for f in site if f["importance"] is not None}
            # contents of too few pages to have figures are important
            contents = {node: contents.get(node, 1.0) for node in own}
            out.append(noisy_branches([(e["element"], e["parent"]) for e in tree], style, contents))
        return pd.Series(out)

    owners = weighed.filter("inside").join(asked.select("h1", "p1"), _same(("host", "h1"), ("page", "p1")), "left_semi")
    owners = owners.groupBy(F.col("host").alias("h4"), F.col("page").alias("p4")).agg(F.collect_set("node").alias("own"))
    judged = pages.join(owners, _same(("host", "h4"), ("page", "p4"))).select("host", "page", "noise", branches("__elements", "own", "figures").alias("noisy"))
    within = judged.select("host", "page", F.filter("noise", lambda x: F.array_contains("noisy", x["node"])).alias("noise")).filter(F.size("noise") > 0)
    return hits.filter("NOT inside").select("host", "page", "noise").unionByName(within)


def main_text(html: str | None, noisy: set[int]) -> str:
    """The text of a page on its own, without the nodes ``noisy``."""
    return " ".join(text for node, _, text in page_blocks(html) if node not in noisy)


def extract(pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """Per page: key, url, text (empty if there is none), n_chars (code points).

    Null or empty html gives an empty text.  Pages whose url is null or has no
    host are read on their own: no style tree removes anything from them.
    Repeated rows give repeated results and count once in the tree; an empty
    table gives no rows; other columns take no part.  Text is never cut.
    """
    rows = parsed(pages, key, url, html)
    noise = stored(style_tree(rows), "style-tree-noise")
    apart = F.col("__host") == ""
    joined = rows.filter(~apart).join(noise, (F.col("__host") == F.col("host")) & (F.col("__page") == F.col("page")), "left")
    left = F.filter(F.arrays_zip("__nodes", "__texts"), lambda b: ~F.array_contains("noise", F.struct(b["__nodes"].alias("node"), F.xxhash64(b["__texts"]).alias("content"))))
    kept = F.when(F.col("noise").isNull(), F.col("__texts")).otherwise(F.transform(left, lambda b: b["__texts"]))
    done = joined.select("__key", "__url", kept.alias("__texts")).unionByName(rows.filter(apart).select("__key", "__url", "__texts"))
    done = done.select(F.col("__key").alias(key), F.col("__url").alias(url), F.array_join("__texts", " ").alias("text"))
    return done.withColumn("n_chars", F.length("text").cast("bigint"))
