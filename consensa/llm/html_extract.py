"""Main text of HTML pages by composite text density.

The markup becomes a tree.  Subtrees that their tag says are something else than the article (menus, headers,
footers, scripts, styles) are left out.  Those that a class, id or role marks so (sidebars, notices, adverts,
reader comments), and forms, are measured first: one with a whole name that says so goes unless it holds an
article or main element with most of the page's text, or all text there is; one with such a word within a name,
and a form, goes if it holds at most half of the text that is left, or if most of its text is in links.  Every node gets its link-adjusted characters per tag; a container's score is the sum over
its children.  The container of the highest score is the article.  The lowest density on its path to the
body is the threshold: subtrees beside that path which are denser belong to the text as well.  The text of
what is selected is given whole, block by block.

Defined cases: null or empty html gives an empty text, and so does a page without any text; repeated rows
give equal rows; a page cut off in a tag loses that tag, one cut off in a character reference keeps its
characters; an empty table gives an empty result.  Depth is not limited (no recursion).
"""

from __future__ import annotations

import html
import math
import re
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from consensa.llm.common import read

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)(>|\Z)|<(?=[a-zA-Z/])[^>]*(?:>|\Z)",
    re.S)
_ATTRIBUTE = re.compile(r"([^\s=\"'>/]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]*)))?")
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe xmp noembed noframes".split())
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer "
    "form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol option p pre section summary table tbody td "
    "tfoot th thead tr ul".split())
CONTAINERS = frozenset("body article main section div td center blockquote figure html #root".split())
#: An opening tag that ends an open one, as far as the nearest of the tags that hold it.
CLOSES = {"li": (("li",), ("ul", "ol", "menu")), "dt": (("dt", "dd"), ("dl",)), "dd": (("dt", "dd"), ("dl",)),
          "tr": (("tr", "td", "th"), ("table",)), "td": (("td", "th"), ("tr", "table")), "th": (("td", "th"), ("tr", "table")),
          "option": (("option",), ("select",)), "body": (("head",), ())}
#: Tags that are never part of an article.
BOILER_TAGS = frozenset(
    "head script style noscript template iframe nav footer aside button select textarea svg dialog menu object "
    "embed canvas audio video input".split())
#: Words of a class, id or role that say so.
BOILER_WORDS = frozenset(
    "ad ads advert adverts advertisement advertising adsense sponsor sponsored promo promotion nav navbar navigation menu "
    "menubar breadcrumb breadcrumbs sidebar sidebars footer banner cookie cookies consent gdpr notice notices alert popup "
    "modal overlay newsletter subscribe subscription signup login share sharing social related recommended recommendations "
    "comment comments disqus respond replies pagination pager widget widgets toolbar search complementary contentinfo "
    "skip masthead".split())


class Node:
    __slots__ = ("tag", "parent", "items", "mark", "chars", "link_chars", "tags", "link_tags", "density", "score")

    def __init__(self, tag: str, parent: Node | None, mark: str = ""):
        self.tag, self.parent, self.items, self.mark = tag, parent, [], mark
        self.chars = self.link_chars = self.tags = self.link_tags = 0
        self.density = self.score = 0.0


def _mark(tag: str, attributes: str, node: Node) -> str:
    """"drop" for what is never part of an article, "name" or "word" for what a whole name or a word in one says, or ""."""
    if tag in BOILER_TAGS:
        return "drop"
    inside = False
    if tag == "header":
        while node is not None and not inside:
            inside, node = node.tag in ("article", "main"), node.parent
        if not inside:
            return "drop"
    mark = "word" if tag == "form" else ""
    if not attributes.strip(" /\n\t"):
        return mark
    for m in _ATTRIBUTE.finditer(attributes):
        name, value = m[1].lower(), next((x for x in m.groups()[1:] if x is not None), "")
        if name in ("class", "id", "role") and tag not in ("body", "html", "article", "main"):
            if not BOILER_WORDS.isdisjoint(value.lower().split()):
                mark = "name"
            elif not mark and not BOILER_WORDS.isdisjoint(
                    re.split(r"[^a-z]+", re.sub(r"([a-z])([A-Z])", r"\1 \2", value).lower())):
                mark = "word"
        if name == "hidden" or name == "aria-hidden" and value == "true":
            return "drop"
        if name == "style" and re.search(r"display\s*:\s*none", value):
            return "drop"
    return mark


def parse(page: str) -> Node:
    """The tree without subtrees that never are part of an article; a node's items are texts and nodes."""
    root = node = Node("#root", None)
    skipped: list[str] = []  # open tags of the boilerplate subtree that is being passed over
    at, n = 0, len(page)
    for_raw = ""
    while at < n:
        if for_raw:  # the content of script and the like is no markup
            end = re.compile(rf"</{for_raw}(?=[\s/>]|\Z)", re.I).search(page, at)
            stop = end.start() if end else n
            if not skipped and for_raw not in BOILER_TAGS and for_raw != "title":
                node.items.append(html.unescape(page[at:stop]))
            at, for_raw = stop, ""
            continue
        m = _TOKEN.search(page, at)
        stop = m.start() if m else n
        if stop > at and not skipped:
            node.items.append(html.unescape(page[at:stop]))
        if not m:
            break
        at = m.end()
        if m[2] is None or not m[4]:  # comment, declaration, or cut off
            continue
        tag, closing, attributes = m[2].lower(), bool(m[1]), m[3]
        if skipped:
            if closing:
                if tag in skipped:
                    del skipped[len(skipped) - 1 - skipped[::-1].index(tag):]
                elif tag in ("body", "html", "article", "main") and skipped[0] != tag:
                    x = node
                    while x is not None and x.tag != tag:
                        x = x.parent
                    if x is not None and x.parent is not None:  # the subtree was left open
                        skipped, node = [], x.parent
            elif tag == "body" and skipped[0] == "head":
                skipped, node = [], Node("body", root)
                root.items.append(node)
            elif tag not in VOID and not attributes.endswith("/"):
                if tag in CLOSES and skipped[-1] in CLOSES[tag][0] and len(skipped) > 1:
                    skipped.pop()
                elif tag in ("p", *BLOCKS) and skipped[-1] == "p" and len(skipped) > 1:
                    skipped.pop()
                skipped.append(tag)
                if tag in RAW:
                    for_raw = tag
            continue
        if closing:
            x = node
            while x is not None and x.tag != tag:
                if tag not in BLOCKS and x.tag in BLOCKS:
                    x = None  # an inline end tag closes nothing beyond its block
                    break
                x = x.parent
            if x is not None and x.parent is not None:
                node = x.parent
            continue
        if tag in BLOCKS:  # a block ends an open paragraph
            x = node
            while x.parent is not None and x.tag != "p" and (x.tag not in BLOCKS):
                x = x.parent
            if x.tag == "p":
                node = x.parent
        ends, within = CLOSES.get(tag, ((), ()))
        x = node
        while ends and x.parent is not None and x.tag not in within:
            if x.tag in ends:
                node = x.parent
                break
            x = x.parent
        if tag == "br":
            node.items.append(" ")
        if tag in ("html",):
            continue
        alone = tag in VOID or attributes.endswith("/") and tag not in BLOCKS
        mark = "" if alone else _mark(tag, attributes, node)
        if mark == "drop":
            skipped = [tag]
            for_raw = tag if tag in RAW else ""
            continue
        child = Node(tag, node, mark)
        node.items.append(child)
        if not alone:
            node = child
            for_raw = tag if tag in RAW else ""
    return root


def in_order(root: Node) -> list[Node]:
    """Parents before children."""
    out, todo = [], [root]
    while todo:
        x = todo.pop()
        out.append(x)
        todo.extend(c for c in reversed(x.items) if isinstance(c, Node))
    return out


def _amounts(root: Node) -> tuple[dict, dict, dict]:
    """By a node's id the characters of its subtree, of those the ones in links, and the most that an article or main element in it holds."""
    chars, links, named = {}, {}, {}
    for x in reversed(in_order(root)):
        c = lc = most = 0
        for y in x.items:
            if isinstance(y, Node):
                c, most = c + chars[id(y)], max(most, named[id(y)])
                lc += chars[id(y)] if y.tag == "a" else links[id(y)]
            else:
                c += len(" ".join(y.split()))
        chars[id(x)], links[id(x)] = c, lc
        named[id(x)] = c if x.tag in ("article", "main") else most
    return chars, links, named


def prune(root: Node) -> Node:
    """The tree without the marked subtrees whose share of the text agrees with the mark."""
    for kind in ("name", "word"):  # the text that is left after the former is what the latter are measured by
        if not any(x.mark == kind for x in in_order(root)):
            continue
        chars, links, named = _amounts(root)
        total, todo, gone, cut = chars[id(root)], [root], 0, []
        while todo:
            x = todo.pop()
            for y in x.items:
                if not isinstance(y, Node):
                    continue
                c = chars[id(y)]
                if y.mark != kind:
                    goes = False
                elif kind == "name":
                    goes = 2 * named[id(y)] <= total
                else:
                    goes = 2 * c <= total or 2 * links[id(y)] > c
                if goes:
                    gone += c
                    cut.append((x, y))
                else:
                    todo.append(y)
        if gone == total:  # nothing else is there: the greatest stays
            most = max(cut, key=lambda pair: chars[id(pair[1])])
            cut = [pair for pair in cut if pair is not most]
        out = {id(y) for _, y in cut}
        for x in {id(x): x for x, _ in cut}.values():
            x.items = [z for z in x.items if id(z) not in out]
    return root


def measure(nodes: list[Node]) -> None:
    """Characters, tags and their shares in links of every subtree; then densities and scores."""
    for x in reversed(nodes):
        for c in x.items:
            if isinstance(c, Node):
                x.chars += c.chars
                x.tags += c.tags + 1
                x.link_chars += c.chars if c.tag == "a" else c.link_chars
                x.link_tags += c.link_tags + (c.tag == "a")
            else:
                x.chars += len(" ".join(c.split()))
    body = next((x for x in nodes if x.tag == "body"), nodes[0])
    share = body.link_chars / body.chars if body.chars else 0.0
    for x in nodes:
        c, t, lc, lt = x.chars, max(x.tags, 1), max(x.link_chars, 1), max(x.link_tags, 1)
        if c:
            base = math.log(c * lc / max(c - x.link_chars, 1) + share * c + math.e)
            x.density = max(0.0, c / t * math.log(max(c * t / (lc * lt), 1.0) + 1e-9) / base) if x.link_chars else c / t
    for x in nodes:
        x.score = sum(c.density for c in x.items if isinstance(c, Node))
        if any(not isinstance(c, Node) and c.strip() for c in x.items):  # text of its own counts as a child
            x.score += sum(len(" ".join(c.split())) for c in x.items if not isinstance(c, Node))


def select(nodes: list[Node]) -> list[Node]:
    """The subtrees to give, in page order."""
    inside = [x for x in nodes if x.tag in CONTAINERS]
    named = [x for x in inside if x.tag in ("article", "main") and x.chars]
    best = max(named or inside, key=lambda x: x.score)
    if not best.chars:
        return []
    path, x = [], best
    while x is not None:
        path.append(x)
        x = x.parent
    threshold = min(x.density for x in path if x.tag != "#root") if len(path) > 1 else best.density
    if any(x.tag in ("article", "main") for x in path):
        outer = [x for x in path if x.tag in ("article", "main")][-1]
        more = [x for x in named if x is not outer and x not in path and x.density >= threshold]
        top = {id(outer), *(id(x) for x in more)}
    else:
        on_path = {id(x) for x in path}
        top = {id(best)} | {id(c) for x in path[1:] for c in x.items
                            if isinstance(c, Node) and id(c) not in on_path and c.chars and c.density >= threshold}
    out, held = [], set()
    for x in nodes:
        if id(x.parent) in held:
            held.add(id(x))
        elif id(x) in top:
            held.add(id(x))
            out.append(x)
    return out


def blocks(roots: list[Node]) -> list[str]:
    out, now = [], []

    def close():
        text = " ".join("".join(now).split())
        now.clear()
        if text:
            out.append(text)

    for root in roots:
        todo: list = [root]
        while todo:
            x = todo.pop()
            if isinstance(x, str):
                now.append(x)
            elif x is None:
                close()
            else:
                if x.tag in BLOCKS:
                    close()
                    todo.append(None)
                todo.extend(reversed(x.items))
        close()
    return out


def main_text(page: str | None) -> str:
    nodes = in_order(prune(parse(page or "")))
    measure(nodes)
    return "\n".join(blocks(select(nodes)))


def extract(pages: DataFrame, column: str = "html", into: str = "text") -> DataFrame:
    """``pages`` with the main text of ``column`` as a further column (one of that name is replaced)."""
    others = [c for c in pages.columns if c != into]
    whole = pages.select(*[F.col(f"`{c}`") for c in others], F.coalesce(F.col(f"`{column}`").cast("string"), F.lit("")).alias(into))

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa
        for batch in batches:
            texts = pa.array([main_text(x.as_py()) for x in batch.columns[-1]], batch.schema.field(len(others)).type)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], texts], schema=batch.schema)

    return whole.mapInArrow(run, whole.schema)


def q_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = extract(read(spark, sf_dir, "pages").select("page_id", "url", "html")).drop("html")
    return out.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


QUERIES = {"op6_html_extract": q_html_extract}
ORACLE: dict[str, str] = {}
