"""Main text of HTML pages by site template removal.

Each page is parsed into elements, and every element with text gets a hash of its subtree: tag, class, id,
text and children. Spark counts, for each host and hash, on how many pages with *different* main text the subtree
occurs, so copies of one article do not make a template of its parts. What recurs is the site's template and is
deleted from every page of the host; all that remains of the page, in page order, is its text.

How often a subtree must recur depends on where it is. A page's main container is its articles, or its main
elements, if they hold enough of its words, else the deepest element that holds most of them. Outside of it
``LEAST_PAGES`` pages and ``LEAST_SHARE`` of the host's are enough. Inside, boxes of links must recur on ``INSIDE_SHARE``
of the host's pages, and running text on as many and on ``LEAST_INSIDE`` pages too; headings and the items and cells of lists and tables
are deleted only with the whole they are part of, and nothing that recurs is deleted where it would be most of a page's main text.

Adverts and notices come with other words each time, so their subtrees never recur. Outside the main container an element goes
whose class or id names it as no main text, on every host alike, and so does a box of links alone (a menu). Inside, only adverts and reader comments
go by their name; whatever else is named so ("share", "notice") goes if its *frame*, the path of tags, classes and ids that leads to it,
recurs on the host. A name counts as a whole ("share-buttons", not "related-work"). No name deletes what is the page's text: an element that holds most of
the words stays, unless articles or main elements elsewhere have any. HTML's own elements for menus, footers, sidebars and forms are never main text; formulas are.
"""

from __future__ import annotations

import html as entities
import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomwright.llm.common import spread, written

LEAST_PAGES, LEAST_SHARE, LEAST_INSIDE, INSIDE_SHARE = 4, 0.005, 8, 0.5
#: Links of a box that has no other words, from which on it is a menu.
MENU_LINKS = 3
#: Of a page's words that its articles (or main elements) hold at least, and that an element must hold of its parent's to be taken for the main container.
NAMED_SHARE, MOST_OF = 0.25, 0.6
#: Template hashes that are broadcast at most, 8 bytes each.
MOST_BROADCAST = 1_000_000

#: Fixed values of the HTML standard.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp noembed noframes iframe".split())
FORMULA = frozenset("math mi mn mo ms mtext mrow mfrac msqrt mroot mstyle mpadded mphantom mfenced menclose msub msup msubsup munder mover munderover mmultiscripts mprescripts mspace mtable mtr mtd semantics".split())
INLINE = FORMULA | frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark nobr q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
CLOSES_P = frozenset("address article aside blockquote details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section table ul".split())
#: What an opening tag ends: names, and where the search for them stops.
SIBLINGS = {
    "li": (("li",), ("ul", "ol", "menu")), "dt": (("dt", "dd"), ("dl",)), "dd": (("dt", "dd"), ("dl",)),
    "tr": (("tr", "td", "th"), ("table",)), "td": (("td", "th"), ("tr", "table")), "th": (("td", "th"), ("tr", "table")),
    "option": (("option",), ("select",)), "body": (("head",), ()),
}

#: Marks of what is not main text.
DROPPED = frozenset("script style textarea title xmp noembed noframes iframe noscript template svg annotation annotation-xml canvas object audio video nav footer aside form button select dialog menu head".split())
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alertdialog alert menu menubar toolbar".split())
WORDS = frozenset(
    "ad ads adbox adslot advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments consent cookie cookies disqus"
    " footer gdpr login masthead menu modal nav navbar navigation newsletter notice notices overlay pager pagination popup promo promoted"
    " recommended related replies reply respond search share sharing sidebar signup skip social sponsor sponsored subscribe subscription toolbar widget".split()
)
#: Words that say what an element is for only together with one of the above, and those that are marks inside an article too.
HELPERS = frozenset("area bar block bottom box button buttons container count form group header icon icons inner item items left line link links list main outer page panel right row section site slot text thread title top unit wrap wrapper zone".split())
CERTAIN = frozenset("ad ads adbox adslot advert adverts advertisement advertising comments disqus sponsored".split())
#: Sharing is a topic too; with one of these words it is a row of controls.
SHARES, CONTROLS = frozenset("share sharing social".split()), frozenset("bar button buttons icon icons link links toolbar".split())
#: Parts that go only with what they are part of, and blocks that hold text rather than other blocks.
PARTS = frozenset("h1 h2 h3 h4 h5 h6 li dt dd td th tr tbody thead tfoot caption figcaption summary br".split())
TEXTS = frozenset("p h1 h2 h3 h4 h5 h6 li blockquote pre dd dt figcaption br".split())

_TOKEN = re.compile(r"""<!--(?:>|->|.*?(?:--!?>|\Z))|<[!?][^>]*(?:>|\Z)|</[^a-zA-Z][^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?>(?:[^>=]+|=\s*"[^"]*"|=\s*'[^']*'|=)*))>""", re.S)
_ATTRIBUTE = re.compile(r"""([^\s=/"'<>]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
_NAME = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|\d+")


class Node:
    """An element: children are nodes and texts in page order."""

    __slots__ = ("tag", "attributes", "children", "hash", "words", "links")

    def __init__(self, tag: str, attributes: dict[str, str]):
        self.tag, self.attributes, self.children, self.hash, self.words, self.links = tag, attributes, [], 0, 0, 0


def parse(page: str) -> Node:
    """The tree of a page, however broken: unclosed elements end with their parent or where the standard ends them."""
    root = Node("#root", {})
    stack, at, size = [root], 0, len(page)

    def text(a: int, b: int) -> None:
        if a < b:
            stack[-1].children.append(entities.unescape(page[a:b]) if "&" in page[a:b] else page[a:b])

    while at < size:
        found = _TOKEN.search(page, at)
        if not found:
            text(at, size)
            break
        text(at, found.start())
        at = found.end()
        tag = found[2]
        if not tag:
            continue
        tag = tag.lower()
        if found[1]:
            for n in range(len(stack) - 1, 0, -1):
                name = stack[n].tag
                if name == tag:
                    del stack[n:]
                    break
                if name in ("table", "td", "th") and tag not in ("table", "tr", "tbody", "thead", "tfoot", "body", "html") or tag in INLINE and name not in INLINE:
                    break
            continue
        if tag in CLOSES_P:
            for n in range(len(stack) - 1, 0, -1):
                if stack[n].tag == "p":
                    del stack[n:]
                    break
                if stack[n].tag not in INLINE:
                    break
        if tag in SIBLINGS:
            ended, stops = SIBLINGS[tag]
            for n in range(len(stack) - 1, 0, -1):
                if stack[n].tag in ended:
                    del stack[n:]
                    if tag != "tr":
                        break
                elif stack[n].tag in stops:
                    break
        raw = found[3]
        attributes = {}
        if raw and not raw.isspace():
            for m in _ATTRIBUTE.finditer(raw):
                attributes.setdefault(m[1].lower(), m[2] or m[3] or m[4] or "")
        node = Node(tag, attributes)
        stack[-1].children.append(node)
        if tag in RAW:
            end = re.compile(rf"</{tag}(?=[\s/>])[^>]*>", re.I).search(page, at)
            at = end.end() if end else size
        elif tag not in VOID:
            stack.append(node)
    return root


def hash_subtrees(root: Node) -> None:
    """Sets each element's hash: of tag, class, id, and the texts (white space as one space) and hashes below; 0 without any text. Also how many words stand outside links in it, and how many links have text."""
    order, stack = [], [root]
    while stack:
        node = stack.pop()
        order.append(node)
        stack.extend(c for c in node.children if type(c) is Node)
    for node in reversed(order):
        parts, worded, words, links = [node.tag, node.attributes.get("class", ""), node.attributes.get("id", "")], False, 0, 0
        for child in node.children:
            if type(child) is Node:
                if child.hash:
                    worded = True
                    words += child.words
                    links += child.links
                    parts.append(f"\x01{child.hash:x}")
            elif text := " ".join(child.split()):
                worded = True
                words += text.count(" ") + 1 if any(map(str.isalnum, text)) else 0
                parts.append(text)
        node.words = 0 if node.tag == "a" or node.tag in DROPPED else words
        node.links = 1 if node.tag == "a" and worded else links
        node.hash = xxhash.xxh64_intdigest("\x02".join(parts).encode("utf-8", "surrogatepass")) if worded else 0


def excluded(node: Node, in_main: bool) -> bool:
    """Whether the element is no main text by HTML's own means: its name, its role, or hidden."""
    if node.tag in DROPPED or node.tag == "header" and not in_main:
        return True
    a = node.attributes
    return bool(a) and node.tag not in ("html", "body") and ("hidden" in a or a.get("aria-hidden") == "true" or a.get("role", "").lower() in ROLES or "display:none" in a.get("style", "").replace(" ", "").lower())


def mark(node: Node) -> str:
    """``certain`` or ``named`` if a class or the id says that the element isn't main text, else empty."""
    a = node.attributes
    if not a or node.tag in ("html", "body", "main", "article", "#root"):
        return ""
    found = ""
    for name in (*a.get("class", "").split(), a.get("id", "")):
        parts = {w.lower() for w in _NAME.findall(name)}
        own = parts & WORDS or ("header" in parts and {"header"})
        if own and parts <= WORDS | HELPERS | {w for w in parts if w.isdigit()}:
            if own & CERTAIN or own & SHARES and parts & CONTROLS:
                return "certain"
            found = "named"
    return found


def main_containers(root: Node) -> list[Node]:
    """What holds the main text: articles or main elements, if enough words stand in them, else the deepest element with most of the words (the root if that is the whole page)."""
    found: dict[str, list[Node]] = {"article": [], "main": []}
    stack = [(root, False)]
    while stack:
        node, inside = stack.pop()
        main = node.tag == "main" or node.attributes.get("role") == "main"
        if excluded(node, False) or mark(node):
            continue
        if node.tag == "article":
            found["article"].append(node)
            continue
        if main and not inside:
            found["main"].append(node)
        stack.extend((c, inside or main) for c in reversed(node.children) if type(c) is Node)
    for some in found.values():
        if some and sum(n.words for n in some) >= NAMED_SHARE * root.words:
            return some
    at = root
    while True:
        inner = [c for c in at.children if type(c) is Node and c.tag not in TEXTS and c.tag not in INLINE and c.words >= MOST_OF * at.words and not excluded(c, False) and not mark(c)]
        if not at.words or not inner:
            return [root] if at.tag in ("#root", "html", "body") else [at]
        at = inner[0]


def text_hash(nodes: list[Node]) -> int:
    return xxhash.xxh64_intdigest(b"".join(n.hash.to_bytes(8, "little") for n in nodes))


#: What a hash stands for, in its last two bits: a subtree outside, a box of links inside, running text inside the main container; a frame.
OUTSIDE, LINKS, RUNNING, FRAME = range(4)


def template_hash(host: str, subtree: int, kind: int = OUTSIDE) -> int:
    """Signed 64 bits of a subtree or frame on a host, the last two of them its kind."""
    return (xxhash.xxh64_intdigest(host.encode("utf-8", "surrogatepass"), subtree) & ~3 | kind) - (1 << 63)


def frame_of(above: int, node: Node) -> int:
    """Hash of the path to an element; numbers in class and id don't count."""
    a = node.attributes
    names = "".join(c for c in f"{node.tag}\x01{a.get('class', '')}\x01{a.get('id', '')}" if not c.isdigit()) if a else node.tag
    return xxhash.xxh64_intdigest(names.encode("utf-8", "surrogatepass"), above)


class Page:
    """A parsed page, ready to be asked for its candidates and its text."""

    def __init__(self, page: str, url: str | None):
        self.root, self.host = parse(page), host_of(url)
        hash_subtrees(self.root)
        self.mains = main_containers(self.root)
        self.ids = {id(n) for n in self.mains}
        self.whole = self.mains == [self.root]
        self.holders = self._holders()
        self.kept = self._kept()

    def _holders(self) -> set[int]:
        """Elements that hold a main container, or are one."""
        order, stack = [], [self.root]
        while stack:
            node = stack.pop()
            order.append(node)
            stack.extend(c for c in node.children if type(c) is Node)
        out = set(self.ids)
        for node in reversed(order):
            if any(type(c) is Node and id(c) in out for c in node.children):
                out.add(id(node))
        return out

    def _kept(self) -> set[int]:
        """Elements that no name deletes: those with most of the page's words, if no article or main element has words outside of them."""
        chain, node = [], self.root
        while node.words and (node := next((c for c in node.children if type(c) is Node and 2 * c.words > self.root.words and not excluded(c, False)), None)):
            chain.append(node)
        if not any(mark(n) for n in chain):
            return set()
        above = {id(n): k for k, n in enumerate(chain)}
        found, stack = [], [(self.root, -1)]  # outermost articles and main elements, and how far down the chain they are
        while stack:
            node, depth = stack.pop()
            depth = above.get(id(node), depth)
            if node.tag in ("article", "main"):
                found.append((node, depth))
            else:
                stack.extend((c, depth) for c in node.children if type(c) is Node and not excluded(c, False))
        total, out = sum(n.words for n, _ in found), set()
        holder = next((above[id(n)] for n, _ in found if id(n) in above), len(chain))
        for k, node in enumerate(chain):
            inside = node.words if k > holder else sum(n.words for n, depth in found if depth >= k)
            if inside == total:
                out.add(id(node))
        return out

    def menu(self, node: Node) -> bool:
        """Whether the element is a box of links alone, on a page that has other words."""
        return not node.words and node.links >= MENU_LINKS and node.tag not in INLINE and node.tag not in PARTS and self.root.words > 0

    def kind(self, node: Node, inside: bool) -> int | None:
        """How an element's subtree is counted; None: not at all."""
        if not node.hash or id(node) in self.holders or node.tag in ("html", "body"):
            return None
        if not inside and not (self.whole and node.words):
            return OUTSIDE
        if node.tag in INLINE or node.tag in PARTS:
            return None
        return RUNNING if node.words else LINKS

    def candidates(self) -> set[int]:
        """Hashes of the subtrees and frames that may recur."""
        out: set[int] = set()
        stack = [(self.root, 0, False)]
        while stack:
            node, above, inside = stack.pop()
            inside = inside or id(node) in self.ids and not self.whole
            frame = frame_of(above, node)
            kind = self.kind(node, inside)
            if kind is not None:
                out.add(template_hash(self.host, node.hash, kind))
            if mark(node):
                out.add(template_hash(self.host, frame, FRAME))
            stack.extend((c, frame, inside) for c in node.children if type(c) is Node and not excluded(c, inside))
        return out

    def site(self) -> int:
        """Stands for the host itself, whose pages are counted with it."""
        return template_hash(self.host, 0, FRAME)

    def text(self, template) -> str:
        """The blocks that remain, joined by newlines."""
        recurs = lambda node, kind: template_hash(self.host, node.hash, kind) in template
        gone = 0
        if template:
            stack = list(self.mains)
            while stack:
                node = stack.pop()
                kind = self.kind(node, not self.whole)
                if kind == RUNNING and recurs(node, kind):
                    gone += node.words
                else:
                    stack.extend(c for c in node.children if type(c) is Node)
        most = 2 * gone > sum(n.words for n in self.mains)  # a near copy of other pages, not a page in a template
        out: list[str] = []
        line: list[str] = []

        def end() -> None:
            words = " ".join("".join(line).split())
            if words:
                out.append(words)
            line.clear()

        def deleted(node: Node, frame: int, inside: bool) -> bool:
            if excluded(node, inside):
                return True
            if id(node) in self.holders:
                return False
            named = mark(node)
            if named and id(node) not in self.kept and (not inside or named == "certain" or template_hash(self.host, frame, FRAME) in template):
                return True
            if not inside and self.menu(node):
                return True
            kind = self.kind(node, inside)
            return kind is not None and recurs(node, kind) and not (kind == RUNNING and most)

        todo: list = [(self.root, frame_of(0, self.root), False)]
        while todo:
            item = todo.pop()
            if item is None:
                end()
            elif type(item) is str:
                line.append(item)
            else:
                node, frame, inside = item
                inside = inside or id(node) in self.ids and not self.whole
                if node.tag not in INLINE:
                    end()
                    todo.append(None)
                for child in reversed(node.children):
                    if type(child) is not Node:
                        todo.append(child)
                    elif not deleted(child, below := frame_of(frame, child), inside):
                        todo.append((child, below, inside))
        end()
        return "\n".join(out)


def host_of(url: str | None) -> str:
    rest = (url or "").partition("://")[2]
    return re.split(r"[/?#]", rest, maxsplit=1)[0].lower()


def page_text(page: str | None, url: str | None, template: frozenset | set) -> str:
    """Main text of one page, given the template hashes of its host."""
    return Page(page, url).text(template) if page else ""


def subtree_rows(page: str | None, url: str | None) -> tuple[int, int, list[int]]:
    """Hashes of the page's main text, of its host, and of its candidates."""
    read = Page(page or "", url)
    return text_hash(read.mains) - (1 << 63), read.site(), list(read.candidates())


def site_templates(pages: DataFrame) -> DataFrame:
    """Hashes (``subtree``, host included) of the subtrees and frames that recur on a host."""

    def count(batches):
        for batch in batches:
            out: tuple[list, ...] = ([], [], [])
            for url, page in zip(batch["url"].to_pylist(), batch["html"].to_pylist(), strict=True):
                main, site, found = subtree_rows(page, url)
                out[0].extend([site] * (len(found) + 1))
                out[1].extend([*found, site])
                out[2].extend([main] * (len(found) + 1))
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in out], names=["site", "subtree", "main"])

    rows = spread(pages.select("url", "html")).mapInArrow(count, "site long, subtree long, main long")
    seen = rows.distinct().groupBy("site", "subtree").agg(F.count("*").alias("n"))
    seen = written(seen.filter((F.col("n") >= LEAST_PAGES) | (F.col("site") == F.col("subtree"))), "subtrees")
    sizes = seen.filter("site = subtree").select("site", F.col("n").alias("pages"))
    many = seen.filter((F.col("site") != F.col("subtree")) & (F.col("n") >= LEAST_PAGES)).join(sizes, "site")
    kind = F.pmod(F.col("subtree"), F.lit(4))  # signed hashes keep their last bits
    inside = kind.isin(LINKS, RUNNING)
    share = F.when(inside, INSIDE_SHARE).when(kind == OUTSIDE, LEAST_SHARE).otherwise(0.0)
    least = F.when(kind == RUNNING, LEAST_INSIDE).otherwise(LEAST_PAGES)
    recurring = many.filter((F.col("n") >= least) & (F.col("n") >= share * F.col("pages"))).select("subtree")
    return recurring


def extract(pages: DataFrame) -> DataFrame:
    """Every page's page_id, url, text and n_chars. Null and empty pages have empty text; null urls share one host. Rows with repeated or null page_ids are pages of their own."""
    templates = written(site_templates(pages), "templates")
    pages = pages.select(F.col("page_id").cast("long"), "url", "html")
    fields = ["page_id", "url", "text", "n_chars"]
    schema = "page_id long, url string, text string, n_chars long"

    def results(batch, texts):
        return pa.RecordBatch.from_arrays([batch["page_id"], batch["url"], pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=fields)

    if templates.count() <= MOST_BROADCAST:
        known = np.array([r[0] for r in templates.collect()], np.int64)
        shared = pages.sparkSession.sparkContext.broadcast(known)

        def read(batches):
            template = set(shared.value.tolist())
            for batch in batches:
                rows = zip(batch["html"].to_pylist(), batch["url"].to_pylist(), strict=True)
                yield results(batch, [page_text(page, url, template) for page, url in rows])

        return spread(pages).mapInArrow(read, schema)

    def pairs(batches):
        for batch in batches:
            out: tuple[list, ...] = ([], [])
            for key, url, page in zip(*(batch[c].to_pylist() for c in ("key", "url", "html")), strict=True):
                found = subtree_rows(page, url)[2]
                out[0].extend([key] * len(found))
                out[1].extend(found)
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in out], names=["key", "subtree"])

    pages = pages.withColumn("key", F.xxhash64("url", "html"))  # pages with one key have the same subtrees
    own = pages.mapInArrow(pairs, "key long, subtree long").join(templates, "subtree").groupBy("key").agg(F.collect_set("subtree").alias("template"))
    joined = pages.join(own, "key", "left").drop("key")

    def read_own(batches):
        for batch in batches:
            rows = zip(batch["html"].to_pylist(), batch["url"].to_pylist(), batch["template"].to_pylist(), strict=True)
            yield results(batch, [page_text(page, url, set(t or ())) for page, url, t in rows])

    return joined.mapInArrow(read_own, schema)
