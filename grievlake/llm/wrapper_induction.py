"""Main text of web pages by wrapper induction: the pages of each host are aligned by simple tree matching.

1. Pages become trees of labels (element and class words). Consecutive paragraphs, list items, rows and cells of one
   label are folded into one node, and so are consecutive like siblings of very long lists; the text that a node holds
   beside its blocks is a node, too.
2. Each host gets a template tree: of ``SAMPLE_PAGES`` different pages (drawn by hash) the one that matches the others
   best, grown by what the others have beside it, where their matched siblings put it.
3. Every page of the host is aligned to the template by simple tree matching: the most pairs of nodes with equal labels
   in order, level by level. A node's place is the template node it is matched to or, for nodes that the sample did not
   show, its label under the place of its parent. For each host and place Spark counts the pages that have it
   and those with the same text there. Pages whose texts are all equal count once: copies say nothing about a template.
4. Nodes that mostly keep their text are template and go, but never inside ``article`` or ``main``, where a passage that
   many articles share is still content. Nodes on enough pages that vary are slots and stay wherever they are. Nodes on
   too few pages stay inside articles, and anywhere if the page has none or nothing else is found.
5. Navigation, footers, side bars, adverts, notices, forms and comments go by their element names, classes, ids
   and roles even where they vary, as links and adverts do. Classes count as whole words only, not next to words for
   content, and never for what an article stands in. An article with such classes stays if it has slots,
   unless the page has another article and its classes say nothing else.

Lists of more than ``CELLS`` pairs of siblings are matched in order by label and count instead of by size. Trees are
walked with stacks of their own, as pages nest thousands of elements.

A null or empty html has an empty text. Pages without a host (also a null url) share one. Repeated rows are
extracted each. Unclosed and stray tags are mended as browsers do for the common cases. Other columns go.
"""

from __future__ import annotations

import html as entities
import re
from bisect import bisect_left
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from hashlib import blake2b

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources.storage import stage
from .scan import worker_cache

#: Pages a host's template tree is made of; all pages are aligned to it and counted.
SAMPLE_PAGES = 8
#: Lists of siblings are folded from so many on, and matched by order alone beyond so many pairs.
LONG_LIST, CELLS = 64, 10_000
#: Alignments a worker remembers, by template and layout.
REMEMBERED = 5_000
#: A place is template if at least so many pages have it and this share of them keeps its text.
LEAST_PAGES, TEMPLATE_SHARE = 3, 0.6
#: Mark of articles, among those of slots.
ARTICLE = 2
#: Wrappers up to so many bytes are broadcast; beyond, pages and wrappers meet in a shuffled join.
BROADCAST_BYTES = 32 << 20

# Element names of HTML by what they do.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template textarea title iframe svg math object xmp noembed noframes".split())
BLOCK = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 header hgroup hr html li main menu nav ol p pre search section summary table tbody td tfoot th "
    "thead tr ul caption legend option select button".split()
)
CLOSED_BY = {
    "li": frozenset(["li"]), "dt": frozenset(["dt", "dd"]), "dd": frozenset(["dt", "dd"]), "tr": frozenset(["tr", "td", "th"]),
    "td": frozenset(["td", "th"]), "th": frozenset(["td", "th"]), "option": frozenset(["option"]),
    "tbody": frozenset(["tbody", "thead", "tr", "td", "th"]), "tfoot": frozenset(["tbody", "thead", "tr", "td", "th"]),
}
NOT_CONTENT = frozenset(
    "nav footer aside form menu dialog select button input label fieldset head search datalist canvas audio video map".split()
)
FOLDED = frozenset("p li dt dd tr td th option a span b i em strong".split())
# Whole class names and ids of boilerplate, and those that speak for content.
NOT_CONTENT_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense ad-banner ad-box ad-container ad-slot ad-unit ad-wrapper "
    "banner banner-ad sponsor sponsored promo promotion nav navbar nav-bar navigation nav-menu main-nav site-nav top-nav menu "
    "main-menu breadcrumb breadcrumbs sidebar side-bar side aside rail footer site-footer page-footer cookie cookies "
    "cookie-banner cookie-notice cookie-consent consent gdpr notice notices notification alert popup modal overlay subscribe "
    "subscription newsletter newsletter-signup signup login share share-buttons share-bar sharing social social-links "
    "social-share related related-posts related-articles recommended recommendations comment comments comment-list "
    "comment-body comment-content comments-area comment-section user-comments reply replies respond disqus disqus_thread "
    "pagination pager toolbar masthead site-header page-header skip skip-link copyright widget widgets widget-area".split()
)
CONTENT_WORDS = frozenset("article content main story post entry body text article-body post-body entry-content post-content main-content".split())
NOT_CONTENT_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())

TAG = re.compile(
    r"""<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*+>|<(/?)([A-Za-z][^\s/>]*+)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>""", re.S
)
ATTRIBUTE = re.compile(r"""(?<![\w-])(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
WORDS = re.compile(r"[a-z]+")
SPACES = re.compile(r"\s+")


class Node:
    __slots__ = ("tag", "words", "names", "role", "kids", "dropped", "silent", "slot", "own_slot", "holds")

    def __init__(self, tag: str, words: tuple[str, ...] = (), names: tuple[str, ...] = (), role: str = ""):
        # words of letters tell layouts apart, whole names tell boilerplate
        self.tag, self.words, self.names, self.role, self.kids = tag, words, names, role, []
        self.dropped = self.silent = self.slot = self.own_slot = self.holds = False


def parse(page: str) -> Node:
    """The tree of a page. Contents of scripts, styles and the like are left out."""
    root = Node("html")
    open_nodes, at, low = [root], 0, None
    for match in iter(lambda: TAG.search(page, at), None):
        if match.start() > at:
            open_nodes[-1].kids.append(page[at: match.start()])
        at = match.end()
        name = match[2]
        if name is None:
            continue
        tag = name.lower()
        if match[1]:
            for k in range(len(open_nodes) - 1, 0, -1):
                if open_nodes[k].tag == tag:
                    del open_nodes[k:]
                    break
            continue
        if tag in RAW:
            if not match[3].endswith("/"):
                low = page.lower() if low is None else low
                low = low if len(low) == len(page) else re.sub("[A-Z]", lambda m: m[0].lower(), page)
                end = low.find("</" + tag, at)
                close = page.find(">", end) if end >= 0 else -1
                at = close + 1 if close >= 0 else len(page)
            continue
        if tag in ("html", "body"):
            continue
        close_implied(open_nodes, tag)
        words, names, role = (), (), ""
        if "=" in match[3]:
            for key, *value in ATTRIBUTE.findall(match[3]):
                text = next((v for v in value if v), "").lower()
                if key.lower() == "role":
                    role = text.strip()
                else:
                    words += tuple(WORDS.findall(text))
                    names += tuple(text.split())
        node = Node(tag, words, names, role)
        open_nodes[-1].kids.append(node)
        if tag not in VOID and not match[3].endswith("/"):
            open_nodes.append(node)
    if at < len(page):
        open_nodes[-1].kids.append(page[at:])
    return root


def close_implied(open_nodes: list[Node], tag: str) -> None:
    """End elements that the start of ``tag`` ends without saying so."""
    if tag in BLOCK:
        for k in range(len(open_nodes) - 1, 0, -1):
            if open_nodes[k].tag == "p":
                del open_nodes[k:]
                break
            if open_nodes[k].tag in BLOCK:
                break
    ends = CLOSED_BY.get(tag)
    if ends:
        for k in range(len(open_nodes) - 1, 0, -1):
            if open_nodes[k].tag in ends:
                del open_nodes[k:]
                if tag not in ("tr", "tbody", "tfoot"):
                    break
            elif open_nodes[k].tag in BLOCK and open_nodes[k].tag not in ends:
                break


def clean(text: str) -> str:
    return SPACES.sub(" ", entities.unescape(text) if "&" in text else text).strip()


def is_content(node: Node, inside_article: bool) -> bool:
    """Not boilerplate by name. Headers and bylines inside an article are part of it."""
    if node.tag in NOT_CONTENT or node.role in NOT_CONTENT_ROLES:
        return False
    if node.tag == "header" and not inside_article:
        return False
    if not node.names or any(n in CONTENT_WORDS for n in node.names):
        return True
    return not any(n in NOT_CONTENT_WORDS or (n == "header" and not inside_article) for n in node.names)


def is_article(node: Node) -> bool:
    return node.tag in ("article", "main") or node.role in ("main", "article")


def whole_text(node: Node) -> str:
    out: list[str] = []
    waiting = list(reversed(node.kids))
    while waiting:
        x = waiting.pop()
        if isinstance(x, str):
            out.append(x)
        else:
            if x.tag in BLOCK or x.tag == "br":
                out.append(" ")
            waiting += reversed(x.kids)
    return clean("".join(out))


def key64(*parts: object) -> int:
    """A 64-bit hash that every worker computes alike; never 0."""
    raw = "\0".join(map(str, parts)).encode("utf-8", "surrogatepass")
    return int.from_bytes(blake2b(raw, digest_size=8).digest(), "little", signed=True) or 1


def label_of(node: Node) -> str:
    return node.tag + "".join("." + n for n in node.words)


@dataclass(slots=True)
class Tree:
    """Labels of a folded tree in preorder, with the parent and the children of every node."""

    labels: list[str]
    parents: list[int]
    kids: list[list[int]]

    def add(self, label: str, parent: int) -> int:
        self.labels.append(label)
        self.parents.append(parent)
        self.kids.append([])
        if parent >= 0:
            self.kids[parent].append(len(self.labels) - 1)
        return len(self.labels) - 1

    def skeleton(self) -> str:
        """The tree as text: a line of depth and label per node, children in order."""
        out, waiting = [], [(0, 0)]
        while waiting:
            node, depth = waiting.pop()
            out.append(f"{depth} {self.labels[node]}")
            waiting += [(kid, depth + 1) for kid in reversed(self.kids[node])]
        return "\n".join(out)


def tree_of(skeleton: str) -> Tree:
    tree, above = Tree([], [], []), []
    for line in skeleton.split("\n"):
        depth, _, label = line.partition(" ")
        del above[int(depth):]
        above.append(tree.add(label, above[-1] if above else -1))
    return tree


@dataclass(slots=True)
class Leaf:
    """A leaf of the folded tree: a run of like siblings, or the text that a node holds beside its blocks."""

    at: int  # its node in the folded tree
    nodes: list[Node]
    own: bool
    text: str
    inside: bool  # an article stands around it


def folded(root: Node) -> tuple[Tree, list[Leaf]]:
    """The folded tree and its leaves with text, both in order of the page."""
    tree, leaves = Tree([], [], []), []
    waiting: list[tuple[list[Node], str, int, bool]] = [([root], label_of(root), -1, False)]
    while waiting:
        run, label, above, inside = waiting.pop()
        at, node = tree.add(label, above), run[0]
        inside = inside or is_article(node)
        if above >= 0 and not (len(run) == 1 and any(not isinstance(k, str) and k.tag in BLOCK for k in node.kids)):
            text = " ".join(whole_text(n) for n in run).strip()
            if text:
                leaves.append(Leaf(at, run, False, text, inside))
            continue
        own = clean(" ".join(k for k in node.kids if isinstance(k, str)))
        if own:
            leaves.append(Leaf(tree.add("#", at), [node], True, own, inside))
        kids = [k for k in node.kids if not isinstance(k, str) and k.tag not in VOID]
        runs: list[tuple[list[Node], str, int, bool]] = []
        for kid in kids:
            name = label_of(kid)
            if runs and runs[-1][1] == name and (kid.tag in FOLDED or len(kids) >= LONG_LIST):
                runs[-1][0].append(kid)
            else:
                runs.append(([kid], name, at, inside))
        waiting += reversed(runs)
    return tree, leaves


def in_order(x: list[str], y: list[str]) -> list[tuple[int, int]]:
    """Pairs of equal labels, the n-th of one list with the n-th of the other, as many as stand in one order."""
    places, seen = defaultdict(list), defaultdict(int)
    for j, label in enumerate(y):
        places[label].append(j)
    pairs = []
    for i, label in enumerate(x):
        n = seen[label]
        seen[label] += 1
        if n < len(places[label]):
            pairs.append((i, places[label][n]))
    tails, at, before = [], [], []  # longest rising run of the second numbers
    for k, (_, j) in enumerate(pairs):
        n = bisect_left(tails, j)
        tails[n:n + 1], at[n:n + 1] = [j], [k]
        before.append(at[n - 1] if n else -1)
    out, k = [], at[-1] if at else -1
    while k >= 0:
        out.append(pairs[k])
        k = before[k]
    return out[::-1]


def match_trees(a: Tree, b: Tree) -> list[tuple[int, int]]:
    """Simple tree matching: the most pairs of nodes with equal labels, in order and level by level."""
    if a.labels[0] != b.labels[0]:
        return []
    size: dict[tuple[int, int], int] = {}
    chosen: dict[tuple[int, int], list[tuple[int, int]]] = {}
    waiting = [(0, 0, False)]
    while waiting:
        i, j, ready = waiting.pop()
        if (i, j) in size:
            continue
        rows, columns = a.kids[i], b.kids[j]
        long = len(rows) * len(columns) > CELLS
        if not ready:
            waiting.append((i, j, True))
            if long:
                found = in_order([a.labels[x] for x in rows], [b.labels[y] for y in columns])
                chosen[i, j] = [(rows[x], columns[y]) for x, y in found]
                waiting += [(x, y, False) for x, y in chosen[i, j]]
            else:
                waiting += [(x, y, False) for x in rows for y in columns if a.labels[x] == b.labels[y]]
            continue
        if not long:
            best = [[0] * (len(columns) + 1) for _ in range(len(rows) + 1)]
            for r, x in enumerate(rows):
                above, here = best[r], best[r + 1]
                for c, y in enumerate(columns):
                    both = above[c] + size[x, y] if a.labels[x] == b.labels[y] else 0
                    here[c + 1] = max(above[c + 1], here[c], both)
            pairs, r, c = [], len(rows), len(columns)
            while r and c:
                if best[r][c] == best[r - 1][c]:
                    r -= 1
                elif best[r][c] == best[r][c - 1]:
                    c -= 1
                else:
                    r, c = r - 1, c - 1
                    pairs.append((rows[r], columns[c]))
            chosen[i, j] = pairs[::-1]
        size[i, j] = 1 + sum(size[p] for p in chosen[i, j])
    out, waiting = [], [(0, 0)]
    while waiting:
        pair = waiting.pop()
        out.append(pair)
        waiting += reversed(chosen[pair])
    return out


def grow(template: Tree, page: Tree) -> None:
    """Add to the template what a page has beside it, after the sibling that stands before it on the page."""
    at = {j: i for i, j in match_trees(template, page)}
    if not at:
        return
    waiting = [0]
    while waiting:
        j = waiting.pop()
        place = 0
        for kid in page.kids[j]:
            own = template.kids[at[j]]
            if kid in at:
                place = own.index(at[kid]) + 1
            else:
                at[kid] = template.add(page.labels[kid], at[j])
                own.insert(place, own.pop())
                place += 1
            waiting.append(kid)


def template_of(skeletons: list[str]) -> str:
    """The tree of the sample that matches the others best, grown by the others."""
    trees = [tree_of(s) for s in sorted(skeletons)]
    fit = [sum(len(match_trees(x, y)) for y in trees if y is not x) for x in trees]
    best = fit.index(max(fit))
    template = trees.pop(best)
    for tree in trees:
        grow(template, tree)
    return template.skeleton()


def places(template: str, page: Tree) -> list[int]:
    """The place of every node of a page's folded tree."""
    known = worker_cache().setdefault("alignments", {})
    key = (template, page.skeleton())
    if key not in known:
        if len(known) >= REMEMBERED:
            known.clear()
        matched = {j: i for i, j in match_trees(tree_of(template), page)} if template else {}
        out: list[int] = []
        for j, label in enumerate(page.labels):
            above = out[page.parents[j]] if j else 0
            out.append(key64("t", matched[j]) if j in matched else key64("u", above, label))
        known[key] = out
    return known[key]


#: What of a subtree counts as content: all, articles and slots, or articles alone.
ALL, SLOTS, ARTICLES = range(3)


def blocks(node: Node, out: list[list[str]], mode: int) -> None:
    """Texts of the blocks of a subtree, without what is dropped."""
    kids_of = lambda x, inside, mode: [(k, x, inside, mode) for k in reversed(x.kids)]
    waiting = kids_of(node, False, mode)
    while waiting:
        kid, parent, inside, mode = waiting.pop()
        if kid is None:
            out.append([])
        elif isinstance(kid, str):
            if not parent.silent and (mode == ALL or (mode == SLOTS and parent.own_slot)):
                out[-1].append(kid)
        elif kid.tag == "br":
            out[-1].append(" ")
        elif not kid.dropped:
            named = kid.slot != ARTICLE and not is_content(kid, inside)
            if named and not kid.holds:
                continue
            # of a side bar around an article the article alone counts
            below = ALL if kid.slot == ARTICLE else ARTICLES if named and mode != ALL else mode
            if below == SLOTS and kid.slot:
                below = ALL
            if kid.tag in BLOCK:
                out.append([])
                waiting.append((None, kid, inside, mode))
            waiting += kids_of(kid, inside or is_article(kid), below)


def mark_holders(root: Node) -> None:
    """Mark all nodes that an article stands in: their names say nothing about it."""
    nodes, above = [root], [-1]
    k = 0
    while k < len(nodes):
        for kid in nodes[k].kids:
            if not isinstance(kid, str):
                nodes.append(kid)
                above.append(k)
        k += 1
    for k, node in enumerate(nodes):
        if is_article(node) and is_content(node, False):
            k = above[k]
            while k >= 0 and not nodes[k].holds:
                nodes[k].holds = True
                k = above[k]


def articles(root: Node, vetoed: list[Node]) -> Iterator[Node]:
    """Outermost articles that are not boilerplate themselves; those that are so by class or id alone go to ``vetoed``."""
    waiting = [k for k in reversed(root.kids) if not isinstance(k, str)]
    while waiting:
        node = waiting.pop()
        if is_article(node) and is_content(node, False):
            yield node
        elif is_article(node) and node.role not in NOT_CONTENT_ROLES:
            vetoed.append(node)
        elif node.holds or is_content(node, False):
            waiting += [k for k in reversed(node.kids) if not isinstance(k, str)]


def align(root: Node, template: str, slots: frozenset[int], constants: frozenset[int]) -> None:
    """Mark the nodes of template and slots."""
    tree, leaves = folded(root)
    place = places(template, tree)
    for leaf in leaves:
        own = place[leaf.at]
        constant = key64(own, leaf.text) in constants
        for node in leaf.nodes:
            if leaf.own:
                node.silent, node.own_slot = constant and not leaf.inside, not constant and own in slots
            else:
                node.dropped, node.slot = constant and not leaf.inside, not constant and own in slots


def has_slot(node: Node) -> bool:
    waiting = [node]
    while waiting:
        x = waiting.pop()
        if x.slot or x.own_slot:
            return True
        waiting += [k for k in x.kids if not isinstance(k, str)]
    return False


def extract(page: str, template: str | None, slots: frozenset[int] = frozenset(), constants: frozenset[int] = frozenset()) -> str:
    root = parse(page)
    mark_holders(root)
    if template:
        align(root, template, slots, constants)
    vetoed: list[Node] = []
    found = list(articles(root, vetoed))
    # names of an article are a prior: slots overrule them, unless they say nothing else and there is another article
    found += [x for x in vetoed if has_slot(x) and (not found or not all(n in NOT_CONTENT_WORDS for n in x.names))]
    for part in found:
        part.slot = ARTICLE
    texts = texts_of(root, SLOTS if found else ALL)
    return "\n\n".join(texts or (texts_of(root, ALL) if found else ()))


def texts_of(root: Node, mode: int) -> list[str]:
    out: list[list[str]] = [[]]
    blocks(root, out, mode)
    return [t for t in (clean("".join(b)) for b in out) if t]


def skeletons(pages: pa.Array) -> pa.Array:
    return pa.array([folded(parse(p))[0].skeleton() for p in pages.to_pylist()], pa.string())


def templates(samples: pa.Array) -> pa.Array:
    return pa.array([template_of(s) for s in samples.to_pylist()], pa.string())


def count_places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For every page and place with text: the place (text 0), the place with its text, and the page by all its texts."""
    for batch in batches:
        rows = set()
        for host, template, page in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            tree, leaves = folded(parse(page))
            if not leaves:
                continue
            place = places(template or "", tree)
            whole = key64(*[leaf.text for leaf in leaves])
            for leaf in leaves:
                own = place[leaf.at]
                rows |= {(host, own, 0, whole), (host, own, key64(own, leaf.text), whole)}
        hosts, *numbers = zip(*rows, strict=True) if rows else ((), (), (), ())
        yield pa.RecordBatch.from_arrays(
            [pa.array(hosts, pa.string()), *(pa.array(n, pa.int64()) for n in numbers)], names=["host", "place", "text", "page"]
        )


def host_of(url: Column) -> Column:
    found = F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1)
    return F.lower(F.coalesce(found, F.lit("")))


def _meet(pages: DataFrame, by_host: DataFrame, size: Column) -> DataFrame:
    """Pages with what is known of their hosts: sent to all tasks if its bytes, counted first, are few."""
    total = by_host.agg(F.coalesce(F.sum(size), F.lit(0))).first()[0]
    return pages.join(F.broadcast(by_host) if total <= BROADCAST_BYTES else by_host, "host", "left")


def host_templates(plain: DataFrame) -> DataFrame:
    """host and template from a bounded sample of every host's different pages. ``plain`` has host and html."""
    hashed = plain.select("host", "html", F.xxhash64("html").alias("_hash"))
    least = lambda rows, *keys: rows.withColumn(
        "_rank", F.row_number().over(Window.partitionBy(*keys).orderBy("_hash"))
    ).filter(F.col("_rank") <= SAMPLE_PAGES).drop("_rank")
    # first within shares of a host, so that a busy one is ranked by several tasks
    shares = hashed.select("host", "_hash").distinct().withColumn("_share", F.pmod("_hash", F.lit(16)))
    chosen = least(least(shares, "host", "_share").drop("_share"), "host")
    drawn = hashed.join(chosen, ["host", "_hash"]).groupBy("host", "_hash").agg(F.min("html").alias("html"))
    trees = drawn.select("host", F.arrow_udf(skeletons, T.StringType())("html").alias("tree"))
    grown = trees.groupBy("host").agg(F.collect_list("tree").alias("trees"))
    return stage(grown.select("host", F.arrow_udf(templates, T.StringType())("trees").alias("template")), "templates")


def induce(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """A row per host: ``host``, ``template`` (its tree), ``slots`` (places on enough pages) and ``constants`` (hashes of
    place and text of what mostly stays the same)."""
    plain = pages.select(host_of(F.col(url_col)).alias("host"), F.col(html_col).alias("html")).filter(F.length("html") > 0)
    trees = host_templates(plain)
    met = _meet(plain, trees, F.octet_length("template")).select("host", "template", "html")
    counted = stage(
        met.mapInArrow(count_places, "host string, place bigint, text bigint, page bigint").distinct()
        .groupBy("host", "place", "text").agg(F.count(F.lit(1)).alias("same"))
        .filter(F.col("same") >= F.when(F.col("text") == 0, LEAST_PAGES).otherwise(LEAST_PAGES * TEMPLATE_SHARE)), "places"
    )
    totals = counted.filter("text = 0").select("host", "place", F.col("same").alias("pages"))
    constant = (
        counted.filter("text <> 0").join(totals, ["host", "place"])
        .filter(F.col("same") >= F.col("pages") * TEMPLATE_SHARE).select("host", "text")
    )
    known = (
        totals.select("host", "place", F.lit(None).cast("bigint").alias("text")).unionByName(constant, allowMissingColumns=True)
        .groupBy("host").agg(F.collect_set("place").alias("slots"), F.collect_set("text").alias("constants"))
    )
    return stage(trees.join(known, "host", "left"), "wrappers")


def main_text(
    pages: DataFrame, wrappers: DataFrame, keep: list[str], url_col: str = "url", html_col: str = "html",
) -> DataFrame:
    """The ``keep`` columns of every page and its ``text``, which stands in for a kept column of that name."""
    def run(some: pa.Array, host: pa.Array, template: pa.Array, slots: pa.Array, constants: pa.Array) -> pa.Array:
        sets, out = {}, []
        for k, (page, name) in enumerate(zip(some.to_pylist(), host.to_pylist(), strict=True)):
            if name not in sets:
                sets[name] = [template[k].as_py(), *(frozenset(x[k].as_py() or ()) for x in (slots, constants))]
            out.append(extract(page, *sets[name]) if page else "")
        return pa.array(out, pa.string())

    kept = [c for c in keep if c != "text"]
    plain = pages.select(F.struct(*kept).alias("_row"), host_of(F.col(url_col)).alias("host"), F.col(html_col).alias("_html"))
    text = F.arrow_udf(run, T.StringType())(*map(F.col, ("_html", "host", "template", "slots", "constants")))
    size = F.octet_length("template") + 8 * (F.coalesce(F.size("slots"), F.lit(0)) + F.coalesce(F.size("constants"), F.lit(0)))
    return _meet(plain, wrappers, size).select("_row", text.alias("text")).select(*[F.col("_row")[c].alias(c) for c in kept], "text")
