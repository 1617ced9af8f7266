"""Main text of web pages by removing what a site repeats.

Every page is parsed into its elements; the hashes of element subtrees are counted per host in Spark, and subtrees that recur across many distinct pages of a host in
different surroundings are its template, unless the pages are near copies of each other; so are places in a host's layout beside its articles, whatever they hold. A last pass takes the template out of each page first. Among what is left, elements that by name never hold an
article's text go, and where article or main elements hold at least half of the rest they are the article; its blocks are the text.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, KEY, materialise, row_key, settled

#: A subtree is template if it stands in at least so many different surroundings, and in this share of the host's pages or, on a large host, on so many pages.
MIN_SURROUNDINGS, MIN_SHARE, ENOUGH_PAGES = 3, 0.01, 10
#: From so many distinct pages of a host on, what half of them have is template even where it makes up most of a page, and also where it is prose inside of their articles.
COMMON_PAGES = 10

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template textarea iframe svg math title".split())
#: Elements that hold no article text.
DROPPED = frozenset("head nav aside footer form button select option label dialog menu object canvas audio video map".split()) | RAW
#: Elements that say that they hold the page's text.
TEXTS = ("article", "main")
#: Words in class, id or role that say the same.
HINTS = frozenset(
    "nav navbar navigation menu menus breadcrumb breadcrumbs footer sidebar sidebars ad ads advert adverts advertisement advertisements advertising sponsor sponsored promo promotion banner cookie cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe subscription signup login comment comments commentary disqus replies share sharing social related recommended pagination pager toolbar widget widgets search skip complementary contentinfo".split()
)
#: Hints that hold however much text an element has.
REMARKS = frozenset("comment comments commentary disqus replies".split())
#: Elements that start and end a block of text.
BLOCKS = frozenset("address article blockquote body center dd details div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html legend li main ol p pre section summary table tbody td tfoot th thead tr ul caption".split())
#: Blocks of prose: within an article they are its text even if some other pages repeat them.
PROSE = frozenset("p h1 h2 h3 h4 h5 h6 li ul ol dl dt dd blockquote pre table tbody thead tr td th figcaption figure caption".split())
CLOSED_BY_SAME = {"li": {"ul", "ol"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table", "tbody", "thead"}, "td": {"tr", "table"}, "th": {"tr", "table"}, "option": {"select"}}

TAG = re.compile(r"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>|<[!?/][^>]*>", re.S)
HINTED = re.compile(r"\b(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
SPLIT = re.compile(r"[^a-z0-9]+")
BLANK = re.compile(r"\s+")
WORDY = re.compile(r"\w")
#: The end of the attributes of a self-closing tag (in an unquoted value the slash belongs to the value).
CLOSED = re.compile(r"(?:^|[\s\"'])/\s*$")


class Node:
    """An element: what it holds, and what digest() and weigh() find: own and kids (length of its own texts, its elements), size and shown (length of all text, and of that which its tags do not drop),
    holds and inside (around or in an article or main), clear (no name or kind speaks against it or what is around it), around (shown of the article, main or page that it stands in), spared."""

    __slots__ = ("tag", "hint", "parent", "items", "digest", "size", "spared", "own", "kids", "shown", "holds", "inside", "clear", "around")

    def __init__(self, tag: str, hint: str, parent: Node | None) -> None:
        self.tag, self.hint, self.parent = tag, hint, parent
        self.items: list[Node | str] = []
        self.digest, self.size, self.spared = 0, 0, False
        self.own, self.kids = 0, []
        self.shown, self.around = 0, 0
        self.holds = self.inside = self.clear = False


def parse(page: str) -> Node:
    """A tree of elements and raw texts. Unclosed and misplaced tags are repaired the simple way: a block ends an open paragraph, an end tag closes what is open inside its
    element, one without a start is ignored. A self-closing svg or math is empty, and so is another raw element so written that has no end tag before the next of its kind; one
    without an end tag ends with the first element around it that has one."""
    lacking: set[str] = set()

    def end_of(tag: str, at: int) -> re.Match | None:
        if tag in lacking:
            return None
        end = re.compile(rf"</{re.escape(tag)}\b[^>]*>", re.I).search(page, at)
        if not end:
            lacking.add(tag)
        return end

    root = here = Node("#root", "", None)
    at, n = 0, len(page)
    while at < n:
        m = TAG.search(page, at)
        if not m:
            here.items.append(page[at:])
            break
        if m.start() > at:
            here.items.append(page[at : m.start()])
        at = m.end()
        if not m[2]:
            continue
        tag = m[2].lower()
        if m[1]:
            x = here
            while x is not root and x.tag != tag:
                x = x.parent
            if x is not root:
                here = x.parent
            elif tag == "p":
                here.items.append(Node("p", "", here))
            continue
        if tag in BLOCKS and tag != "html" and tag != "body":
            x = here
            while x is not root and (x.tag == "p" or x.tag not in BLOCKS):
                if x.tag == "p":
                    here = x.parent
                    break
                x = x.parent
        if stop := CLOSED_BY_SAME.get(tag):
            x = here
            while x is not root and x.tag not in stop:
                if x.tag == tag or (tag in ("dt", "dd") and x.tag in ("dt", "dd")) or (tag in ("td", "th") and x.tag in ("td", "th")):
                    here = x.parent
                    break
                x = x.parent
        attributes = m[3]
        hint = " ".join(a or b or c for a, b, c in HINTED.findall(attributes)).lower() if attributes and "=" in attributes else ""
        node = Node(tag, hint, here)
        here.items.append(node)
        if tag in RAW:
            closed = CLOSED.search(attributes)
            end = None if closed and tag in ("svg", "math") else end_of(tag, at)
            if closed and end and re.compile(rf"<{re.escape(tag)}\b", re.I).search(page, at, end.start()):
                end = None
            if end:
                at = end.end()
            elif not closed and tag != "title":
                x = here
                while x is not root and not (end := end_of(x.tag, at)):
                    x = x.parent
                at = end.start() if end else n
        elif tag not in VOID and not attributes.endswith("/"):
            here = node
    return root


def _in_order(root: Node) -> list[Node]:
    """All elements, parents before their children."""
    out, stack = [], [root]
    while stack:
        node = stack.pop()
        out.append(node)
        stack.extend(x for x in reversed(node.items) if isinstance(x, Node))
    return out


def digest(root: Node) -> list[Node]:
    """Give every element the hash of its subtree (names, classes, texts without white space at their ends) and the length of its text; the elements, parents first."""
    nodes = _in_order(root)
    for node in reversed(nodes):
        h = xxhash.xxh64(f"{node.tag}|{node.hint}".encode("utf-8", "surrogatepass"))
        own, kids = 0, node.kids
        for x in node.items:
            if x.__class__ is Node:
                h.update(x.digest.to_bytes(8, "little"))
                kids.append(x)
            elif t := x.strip():
                h.update(t.encode("utf-8", "surrogatepass"))
                own += len(t)
        node.own = own
        node.digest = h.intdigest()
    weigh(nodes, frozenset())
    return nodes


def weigh(nodes: list[Node], gone: frozenset[int] | set[int]) -> None:
    """Give every element the length of its text without the elements that are gone, and mark forms and hinted elements with most of the text of the page, or of an article or main around them,
    that is not in elements dropped by their tags: what their names say is not taken for their kind. Boxes of readers' remarks are not marked, and where an article or main stands in no element whose name or kind speaks
    against it a box beside it, neither around nor in it, is not marked: it is what it says, however short the article."""
    for node in reversed(nodes):
        size = shown = node.own
        holds = False
        for x in node.kids:
            size += x.size
            shown += x.shown
            holds = holds or x.holds
        if gone and id(node) in gone:
            size = shown = 0
        elif node.tag in DROPPED and node.tag != "form":
            shown = 0
        node.size, node.shown, node.holds = size, shown, holds or size > 0 and node.tag in TEXTS
    root, sure, named = nodes[0], set(), False
    root.clear, root.around = True, root.shown
    for node in nodes[1:]:
        tag = node.tag
        named = named or node.hint != "" or tag == "form"
        node.clear = node.parent.clear and tag not in DROPPED and not (gone and id(node) in gone) and (not node.hint or tag in ("html", "body", "main") or HINTS.isdisjoint(SPLIT.split(node.hint)))
        if tag in TEXTS and node.clear and node.size:
            sure.add(tag)
    if not named:
        return  # nothing that could be spared
    text = "article" if "article" in sure else "main"
    for node in nodes[1:]:
        within, tag = node.parent.around, node.tag
        node.inside = tag == text or node.parent.inside
        node.spared = (node.hint != "" or tag == "form") and 2 * node.shown > within and (not sure or node.holds or node.inside) and REMARKS.isdisjoint(SPLIT.split(node.hint))
        node.around = node.shown if tag in TEXTS else within


def hidden(node: Node, in_article: bool) -> bool:
    if node.tag in DROPPED and not (node.tag == "form" and node.spared):
        return True
    if node.tag == "header":
        return not in_article
    if not node.hint or node.spared and node.tag != "article" or node.tag in ("html", "body", "main"):
        return False
    if node.tag == "article":
        return "comment" in node.hint
    return not HINTS.isdisjoint(SPLIT.split(node.hint))


def article_of(nodes: list[Node]) -> Node | None:
    """The element that holds the article: of those that say so (article, main) and are not hidden themselves, the one with the most text; an article within main if it has half of main's text."""
    best = None
    for node in nodes:
        if node.tag in ("article", "main") and node.size and not hidden(node, False):
            x = node.parent
            while x and not hidden(x, False):
                x = x.parent
            if x is None and (best is None or node.size > best.size or (best.tag == "main" and 2 * node.size >= best.size and _within(node, best))):
                best = node
    return best


def articles_of(nodes: list[Node]) -> list[Node]:
    """The element that holds the article, and the other articles of the page that are not hidden, in the order of the page; those within another come with it."""
    best = article_of(nodes)
    out: list[Node] = []
    taken: set[int] = set()
    for node in nodes if best else ():
        if node is not best and (node.tag != "article" or not node.size or _within(best, node) or _within(node, best)):
            continue
        x = node
        while x and not hidden(x, False) and id(x) not in taken:
            x = x.parent
        if x is None:
            out.append(node)
            taken.add(id(node))
    return out


def _within(node: Node, other: Node) -> bool:
    while node and node is not other:
        node = node.parent
    return node is other


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _in_sentence(node: Node) -> bool:
    """Whether an inline element stands in prose, or in a block that has words of its own beside it."""
    x = node.parent
    while not any(isinstance(t, str) and WORDY.search(html.unescape(t)) for t in x.items):
        if x.parent is None or x.tag in BLOCKS:
            return x.tag in PROSE
        x = x.parent
    return True


#: Told apart by this: the hash of a subtree as prose inside of an article.
AS_PROSE = 0x9E3779B97F4A7C15


def removable(nodes: list[Node], articles: list[Node]) -> dict[int, tuple[Node, int, bool]]:
    """Elements that may be template, parents first, by their Python id: element, hash, and whether it is prose inside of the articles. Inline elements count only where they are no part of a sentence."""
    roots = {id(node) for node in articles}
    inside = set(roots)
    out = {}
    for node in nodes:
        if node.parent is not None and id(node.parent) in inside:
            inside.add(id(node))
        if not node.size or node.parent is None or id(node) in roots or node.tag in ("html", "head", "body"):
            continue
        if node.tag in BLOCKS or not _in_sentence(node):
            prose = id(node) in inside and node.tag in PROSE
            out[id(node)] = (node, _signed(node.digest ^ AS_PROSE if prose else node.digest), prose)
    return out


#: Told apart by this: the hash of a place in the layout.
AS_PLACE = 0xC2B2AE3D27D4EB4F


def places(nodes: list[Node], articles: list[Node]) -> dict[int, int]:
    """Hashes of the places of the outermost blocks with text that neither hold an article nor lie in one, by their Python id: names and classes from the root down, whatever the blocks hold. None on a page without articles."""
    roots = {id(node) for node in articles}
    above: set[int] = set()
    for node in articles:
        while node:
            above.add(id(node))
            node = node.parent
    out, path, stack = {}, {}, [nodes[0]] if articles else []
    while stack:
        node = stack.pop()
        path[id(node)] = xxhash.xxh64_intdigest(f"{path[id(node.parent)] if node.parent else 0}|{node.tag}|{node.hint}".encode("utf-8", "surrogatepass"))
        if id(node) in roots:
            continue
        if id(node) in above:
            stack.extend(node.kids)
        elif node.size and node.tag in BLOCKS and node.tag not in DROPPED:
            out[id(node)] = _signed(path[id(node)] ^ AS_PLACE)
    return out


def subtrees(page: str, evidence: bool = False) -> list[tuple[int, int, bool]]:
    """Hash of each element that may be template, that of its parent, and whether it takes half of a host's pages to make it template: prose inside of an article, and places in the layout. As evidence places count
    only on pages of which the articles have at least half, with what they hold in the parent's stead: a place that always holds the same is not one."""
    nodes = digest(parse(page))
    articles = articles_of(nodes)
    out = {(h, _signed(node.parent.digest), prose) for node, h, prose in removable(nodes, articles).values()}
    if not evidence or 2 * sum(node.size for node in articles) >= nodes[0].size:
        by = {id(node): node for node in nodes}
        out |= {(h, _signed(by[k].digest), True) for k, h in places(nodes, articles).items()}
    return sorted(out)


def near_copy(page: str, repeated: set[int]) -> bool:
    """Whether subtrees that other pages repeat make up more than half of a page that has no article element: then they are a copied text rather than template."""
    nodes = digest(parse(page))
    if article_of(nodes):
        return False
    may = removable(nodes, [])
    total = covered = 0
    stack = [(nodes[0], False)]
    while stack:
        node, within = stack.pop()
        if hidden(node, False):
            continue
        within = within or (id(node) in may and may[id(node)][1] in repeated)
        total += node.own
        covered += node.own if within else 0
        stack.extend((x, within) for x in node.kids)
    return 2 * covered > total


def _template(nodes: list[Node], template: set[int]) -> set[int]:
    """Python ids of the outermost elements of the page that are template; elements are weighed without them. Prose inside of the articles stays if it would take more than half of their text: then the pages are copies of a text."""
    articles = articles_of(nodes)
    may, place = removable(nodes, articles), places(nodes, articles)
    out, under, prose = set(), set(), []
    for node in nodes:
        if node.parent is not None and id(node.parent) in under:
            under.add(id(node))
        elif place.get(id(node)) in template:
            under.add(id(node))
            out.add(id(node))
        elif id(node) in may and may[id(node)][1] in template:
            under.add(id(node))
            out.add(id(node))
            if may[id(node)][2]:
                prose.append(node)
    if not out:
        return out
    own = {id(node) for node in prose}
    weigh(nodes, out - own)
    if own and 2 * sum(node.size for node in prose) > sum(node.size for node in articles):
        return out - own
    if own:
        weigh(nodes, out)
    return out


def _visible(node: Node, inside: bool, gone: set[int]) -> int:
    """Length of the text of the element that is not gone or hidden."""
    total, stack = 0, [(node, inside)]
    while stack:
        x, inside = stack.pop()
        total += x.own
        for y in x.kids:
            if id(y) not in gone and not hidden(y, inside):
                stack.append((y, inside or y.tag == "article"))
    return total


def cleaned(page: str, template: set[int]) -> tuple[str, int]:
    """The text of a page, its blocks one a line, and the number of subtrees that went as template before the article was looked for."""
    nodes = digest(parse(page))
    gone = _template(nodes, template) if template else set()
    articles = articles_of(nodes)
    # where they have half of all text, hidden or not, there is nothing to look at
    if articles and 2 * sum(node.size for node in articles) < nodes[0].size and 2 * sum(_visible(node, True, gone) for node in articles) < _visible(nodes[0], False, gone):
        articles = []
    roots = {id(node) for node in articles}
    blocks, line = [], []

    def flush() -> None:
        if line and (text := BLANK.sub(" ", html.unescape("".join(line))).strip()):
            blocks.append(text)
        line.clear()

    stack: list[tuple[object, bool]] = [(x, bool(articles)) for x in reversed(articles or nodes[:1])]
    while stack:
        item, inside = stack.pop()
        if item is None:
            flush()
        elif isinstance(item, str):
            line.append(item)
        elif item.tag == "br":
            line.append(" ")
        else:
            if id(item) not in roots and (id(item) in gone or hidden(item, inside)):
                if item.tag in BLOCKS:
                    flush()
                continue
            block = item.tag in BLOCKS
            if block:
                flush()
                stack.append((None, inside))
            stack.extend((x, inside) for x in reversed(item.items))
    flush()
    return "\n".join(blocks), len(gone)


def extract(page: str, template: set[int]) -> str:
    return cleaned(page, template)[0]


def _recurring(seen: DataFrame, min_surroundings: int) -> DataFrame:
    """seen: host, hash, page, lo, hi. The host, hash that stand in at least `min_surroundings` different parents with one parent a page taken, the least or the greatest: so on as many pages."""
    sides = seen.select("host", "hash", F.explode(F.array(F.struct(F.lit(0).alias("side"), F.col("lo").alias("parent")), F.struct(F.lit(1).alias("side"), F.col("hi").alias("parent")))).alias("s"))
    often = sides.select("host", "hash", "s.side", "s.parent").distinct().groupBy("host", "hash", "side").agg(F.count(F.lit(1)).alias("n"))
    return often.filter(F.col("n") >= min_surroundings).select("host", "hash").distinct()


def templates(pages: DataFrame, min_surroundings: int = MIN_SURROUNDINGS, min_share: float = MIN_SHARE) -> DataFrame:
    """pages: host, html. Rows of host, hash: subtrees found in at least `min_surroundings` different parents, each on a page of its own, and in that share of the
    host's distinct pages or on ENOUGH_PAGES of them; prose inside of articles only if at least COMMON_PAGES and half of the host's pages have it. A copied article repeats in equal surroundings, a template
    in different ones; pages that mostly repeat others (near_copy) do not count, but for subtrees that half of a host's pages have. Pages without a host have no template."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hosts, found, owners = [], [], []
            for host, page in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                html = page.as_py() or ""
                own = subtrees(html, evidence=True)
                found += own
                hosts += [host] * len(own)
                owners += [_page(html)] * len(own)
            columns = [pa.array([x[i] for x in found], t) for i, t in enumerate((pa.int64(), pa.int64(), pa.bool_()))]
            yield pa.RecordBatch.from_arrays([pa.array(hosts, pa.string()), *columns, pa.array(owners, pa.int64())], ["host", "hash", "parent", "prose", "page"])

    def copies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, repeated = None, set()
        for batch in batches:
            hosts, owners = [], []
            for host, page, template in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2), strict=True):
                html = page.as_py() or ""
                if shared is None:
                    repeated = set(template.values.to_pylist())
                elif host != last:
                    last, repeated = host, set(shared.value[host].tolist())
                if near_copy(html, repeated):
                    hosts.append(host)
                    owners.append(_page(html))
            yield pa.RecordBatch.from_arrays([pa.array(hosts, pa.string()), pa.array(owners, pa.int64())], ["host", "page"])

    known = pages.filter("host <> ''").select("host", "html")
    rows = known.mapInArrow(run, "host string, hash long, parent long, prose boolean, page long")
    seen = materialise(rows.groupBy("host", "hash", "page").agg(F.min("parent").alias("lo"), F.max("parent").alias("hi"), F.max("prose").alias("prose")), "seen")
    sizes = known.select("host", F.xxhash64("html")).distinct().groupBy("host").agg(F.count(F.lit(1)).alias("pages"))
    counts = seen.groupBy("host", "hash").agg(F.count(F.lit(1)).alias("n"), F.max("prose").alias("prose")).filter(F.col("n") >= min_surroundings)
    counts = materialise(counts.join(F.broadcast(sizes) if _few(sizes) else sizes, "host"), "counts")
    common = (F.col("pages") >= COMMON_PAGES) & (2 * F.col("n") >= F.col("pages"))
    enough = F.col("n") >= F.least(min_share * F.col("pages"), F.lit(float(ENOUGH_PAGES)))
    counts = counts.filter(enough & (~F.col("prose") | common)).select("host", "hash", common.alias("common"))
    often = materialise(_recurring(seen.join(counts, ["host", "hash"], "left_semi"), min_surroundings).join(counts, ["host", "hash"]), "often")
    rare = often.filter("not common").select("host", "hash")
    few = _few(rare)
    shared = _shared(rare) if few else None
    keyed = known.select("host", "html", *row_key("host", "html"))
    doubtful = known.join(F.broadcast(rare.select("host").distinct()), "host", "left_semi").withColumn("template", F.lit(None).cast("array<long>")) if few else keyed.join(_by_page(keyed, rare), KEY)
    near = materialise(doubtful.select("host", "html", "template").mapInArrow(copies, "host string, page long").distinct(), "near")
    whole = _recurring(seen.join(rare, ["host", "hash"], "left_semi").join(near, ["host", "page"], "left_anti"), min_surroundings)
    return often.filter("common").select("host", "hash").union(whole)


def _page(html: str) -> int:
    return _signed(xxhash.xxh64_intdigest(html.encode("utf-8", "surrogatepass")))


def _few(table: DataFrame) -> bool:
    return table.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS


def _shared(found: DataFrame):
    """The templates of every host as one broadcast dictionary of sorted hashes: for tables that are _few()."""
    rows = found.toArrow().to_pandas()
    by_host = {host: np.sort(own.to_numpy()) for host, own in rows.groupby("host")["hash"]}
    return found.sparkSession.sparkContext.broadcast(by_host)


def main_text(pages: DataFrame, min_surroundings: int = MIN_SURROUNDINGS, min_share: float = MIN_SHARE) -> DataFrame:
    """Main text of every row of pages: page_id, url, text (empty if there is none), n_chars (its code points), n_template (subtrees that went as template).

    A null or empty html gives an empty text; a null url has no host, so nothing of it is template; repeated rows are pages of their own; an empty table gives an
    empty result; other columns are not read, whatever their names. Where all templates are few, workers have them by host; else each page gets those that it has by a join."""
    host = F.lower(F.coalesce(F.regexp_extract("url", r"^[a-zA-Z][\w+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1), F.lit("")))
    keyed = pages.select("page_id", "url", "html", *row_key("page_id", "url", "html"), host.alias("host"))
    found = settled("templates", lambda: templates(keyed, min_surroundings, min_share))
    few = _few(found)
    shared = _shared(found) if few else None
    work = keyed.withColumn("template", F.lit(None).cast("array<long>")) if few else keyed.join(_by_page(keyed, found), KEY, "left")
    schema = pages.select("page_id", "url").withColumn("text", F.lit("")).withColumn("n_template", F.lit(0).cast("long")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sets: dict[str, set[int]] = {}
        for batch in batches:
            texts, removed = [], []
            for page, host, template in zip(batch.column(2), batch.column(3), batch.column(4), strict=True):
                name = host.as_py()
                if shared is None:
                    own = set(template.values.to_pylist()) if template.is_valid else set()
                elif (own := sets.get(name)) is None:
                    own = set(shared.value.get(name, np.zeros(0, np.int64)).tolist())
                    sets = {name: own, **dict(list(sets.items())[:31])}
                text, n = cleaned(page.as_py() or "", own)
                texts.append(text)
                removed.append(n)
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(texts, pa.string()), pa.array(removed, pa.int64())], schema.names)

    out = work.select("page_id", "url", "html", "host", "template").mapInArrow(run, schema)
    return out.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"), "n_template")


def _by_page(keyed: DataFrame, found: DataFrame) -> DataFrame:
    """keyed: k1, k2, host, html. k1, k2, template: the hashes of `found` that each page itself has."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, hosts, hashes = ([], []), [], []
            for k1, k2, host, page in zip(*(batch.column(i).to_pylist() for i in (0, 1, 2)), batch.column(3), strict=True):
                own = {h for h, _, _ in subtrees(page.as_py() or "")}
                hashes += own
                hosts += [host] * len(own)
                keys[0].extend([k1] * len(own))
                keys[1].extend([k2] * len(own))
            yield pa.RecordBatch.from_arrays([*(pa.array(k, pa.int64()) for k in keys), pa.array(hosts, pa.string()), pa.array(hashes, pa.int64())], [*KEY, "host", "hash"])

    own = keyed.select(*KEY, "host", "html").mapInArrow(run, "k1 long, k2 long, host string, hash long")
    return own.join(found, ["host", "hash"], "left_semi").distinct().groupBy(*KEY).agg(F.collect_list("hash").alias("template"))
