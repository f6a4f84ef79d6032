"""HTML extraction with site template removal.

Every page is parsed into elements. Block elements outside the article are hashed bottom-up (tag, class and id, texts and
the hashes of what they hold) and counted per host in Spark; subtrees that recur on many pages of a host are its template
and are deleted. What is left of menus, headers, adverts and the like goes by its element or its class, then the article's
blocks are written out.

A subtree is template if ``LEAST_PAGES`` different pages of a host have it, however many pages the host has: menus and
notices of one section or language of a large host count too. The counts are combined before their shuffle, so a host with
very many pages never meets in one task. If all hosts' templates are few, counted before, each worker gets them; else each
page is dealt its own subtrees that are template.
Inside an article, template is only what holds no heading, paragraph, quotation, item or cell with words of its own beside
links, and has at most a quarter of the article's text, so that copies of an article under many URLs keep it. There, too,
class words and the like drop an element only as a whole, not as part of a longer name.

Defined cases: a null or empty page gives the empty text; a page without article or main element is taken whole; unclosed
and misplaced tags are closed where they must be; pages without a host share one template; rows may repeat, and equal
pages of a host count once; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, materialize
from .url_filter import url_parts

LEAST_PAGES = 5

#: Element kinds.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp noembed noframes".split())
BLOCK = frozenset("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol option p pre section summary table tbody td tfoot th thead tr ul".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
PROSE = HEADINGS | frozenset("p blockquote pre".split())
DROPPED = frozenset("head nav footer aside form script style noscript template iframe svg canvas button select option textarea input dialog menu object audio video title xmp noembed noframes map".split())
ENDS_P = BLOCK - frozenset("body html option tbody td tfoot th thead tr".split())
#: A start tag closes these open elements, up to the element that bounds them.
CLOSES = {
    "li": (frozenset(["li"]), frozenset(["ul", "ol", "menu", "dir"])),
    "dt": (frozenset(["dt", "dd"]), frozenset(["dl"])),
    "dd": (frozenset(["dt", "dd"]), frozenset(["dl"])),
    "option": (frozenset(["option"]), frozenset(["select"])),
    "tr": (frozenset(["tr", "td", "th"]), frozenset(["table"])),
    "td": (frozenset(["td", "th"]), frozenset(["tr", "table"])),
    "th": (frozenset(["td", "th"]), frozenset(["tr", "table"])),
    "tbody": (frozenset(["tbody", "thead", "tfoot"]), frozenset(["table"])),
    "tfoot": (frozenset(["tbody", "thead", "tfoot"]), frozenset(["table"])),
}
SCOPES = frozenset("table td th article main body html div section ul ol".split())
#: Words of classes, ids and roles that mark what is not the article.
MARKED = frozenset(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner sidebar aside menu nav navbar navigation breadcrumb breadcrumbs masthead topbar "
    "footer cookie cookies consent gdpr notice notices popup modal overlay newsletter subscribe subscription signup social share sharing related recommended recommendations "
    "comment comments commentlist disqus replies reply respond pagination pager toolbar widget widgets login search searchbox skip complementary contentinfo alert hidden".split()
)
#: Words that add nothing in names such as ``comment-list``, and ids of readers' comments.
NEUTRAL = frozenset("area bar block body box button buttons container content form group header heading icons inner item items link links list panel post posts section slot title wrap wrapper".split())
COMMENT_IDS = frozenset("comment comments commentlist disqus_thread replies respond".split())
#: Elements whose own words are prose of the article they stand in.
PROSE_ITEMS = PROSE | frozenset("li dt dd td th figcaption".split())
#: The largest part of an article's text that counts as template.
MOST_OF_ARTICLE = 0.25
QUOTE = re.compile(r"""=\s*(["'])""")
ATTRIBUTE = re.compile(r"""\b(class|id|role|hidden|style|aria-hidden)\b(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""", re.I)
NAME = re.compile(r"/?[a-zA-Z][^\s/>]*")
INVISIBLE = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)
TOKEN = re.compile(r"[a-z0-9]+")


class Node:
    __slots__ = ("tag", "marks", "named", "gone", "parts", "parent", "inside", "digest", "words", "prose")

    def __init__(self, tag: str, parent: Node | None, marks: frozenset[str], named: bool, gone: bool):
        self.tag, self.parent, self.marks, self.named, self.gone = tag, parent, marks, named, gone
        self.parts: list[Node | str] = []
        self.inside = parent is not None and (parent.inside or _is_article(parent))
        self.digest = self.words = 0
        self.prose = False


def _is_article(node: Node) -> bool:
    return node.tag in ("article", "main") or "main" in node.marks


def _is_named(name: str, value: str) -> bool:
    """Whether a class word, role or id says as a whole that its element is not the article."""
    if name == "id":
        return value in COMMENT_IDS
    tokens = TOKEN.findall(value)
    return any(t in MARKED for t in tokens) and all(t in MARKED or t in NEUTRAL for t in tokens)


def _attributes(text: str) -> tuple[frozenset[str], bool, bool]:
    """The tokens of class, id and role; whether one of their words counts as a whole; whether the element is invisible."""
    marks: set[str] = set()
    named = gone = False
    for m in ATTRIBUTE.finditer(text):
        name, value = m[1].lower(), (m[2] or "").strip("\"'").lower()
        if name in ("class", "id", "role"):
            marks.update(TOKEN.findall(value))
            named |= any(_is_named(name, word) for word in value.split())
        elif name == "style":
            gone |= bool(INVISIBLE.search(value))
        else:
            gone |= value != "false"
    return frozenset(marks), named, gone


def _tag_end(page: str, at: int) -> int:
    """Where the tag that starts before ``at`` ends; > inside a quoted value does not end it."""
    end = page.find(">", at)
    while end >= 0:
        quote = QUOTE.search(page, at, end)
        if not quote:
            return end
        close = page.find(quote[1], quote.end())
        if close < 0:
            return end
        at = close + 1
        if close > end:
            end = page.find(">", at)
    return end


def parse(page: str) -> Node:
    """The page's elements; forgiving about tags that are missing."""
    root = at_node = Node("#page", None, frozenset(), False, False)
    at, size = 0, len(page)
    lower = None
    while at < size:
        mark = page.find("<", at)
        if mark < 0:
            at_node.parts.append(page[at:])
            break
        if mark > at:
            at_node.parts.append(page[at:mark])
        if page.startswith("<!--", mark):
            end = page.find("-->", mark + 4)
            at = size if end < 0 else end + 3
            continue
        if page.startswith(("<!", "<?"), mark):
            end = page.find(">", mark)
            at = size if end < 0 else end + 1
            continue
        name = NAME.match(page, mark + 1)
        if not name:
            at_node.parts.append("<")
            at = mark + 1
            continue
        end = _tag_end(page, name.end())
        if end < 0:
            break
        tag, rest, at = name[0].lower(), page[name.end() : end], end + 1
        if tag[0] == "/":
            tag, open_node = tag[1:], at_node
            while open_node is not root and open_node.tag != tag:
                if open_node.tag in SCOPES and tag not in SCOPES:
                    open_node = root
                else:
                    open_node = open_node.parent
            if open_node is not root:
                at_node = open_node.parent
            continue
        if tag in ENDS_P:
            open_node = at_node
            while open_node.tag not in SCOPES and open_node is not root:
                if open_node.tag == "p":
                    at_node = open_node.parent
                    break
                open_node = open_node.parent
        if tag in CLOSES:
            closed, bound = CLOSES[tag]
            open_node = at_node
            while open_node is not root and open_node.tag not in bound:
                if open_node.tag in closed:
                    at_node = open_node.parent
                open_node = open_node.parent
        marks, named, gone = _attributes(rest) if "=" in rest or "hidden" in rest else (frozenset(), False, False)
        node = Node(tag, at_node, marks, named, gone)
        at_node.parts.append(node)
        if tag in RAW:
            lower = page.lower() if lower is None else lower
            close = lower.find("</" + tag, at) if len(lower) == size else page.find("</" + tag, at)
            if close < 0:
                break
            end = page.find(">", close)
            at = size if end < 0 else end + 1
        elif tag not in VOID and not rest.endswith("/"):
            at_node = node
    return root


def _walk(root: Node) -> list[Node]:
    """All elements, each after what it holds."""
    out, work = [], [root]
    while work:
        node = work.pop()
        out.append(node)
        work += [p for p in node.parts if isinstance(p, Node)]
    return out[::-1]


def _digest(root: Node) -> list[Node]:
    """All elements with their digests, the characters of text they hold, and whether prose is in them."""
    nodes = _walk(root)
    for node in nodes:
        seen = xxhash.xxh64(node.tag)
        seen.update(" ".join(sorted(node.marks)))
        own = node.tag in PROSE
        for part in node.parts:
            if isinstance(part, Node):
                seen.update(part.digest.to_bytes(8, "little"))
                node.words += part.words
                node.prose |= part.prose
                own |= part.words > 0 and part.tag not in BLOCK and part.tag != "a"
            else:
                text = " ".join(part.split())
                seen.update(text.encode("utf-8", "surrogatepass"))
                node.words += len(text)
                own |= bool(text)
        node.prose |= own and node.tag in PROSE_ITEMS
        node.digest = seen.intdigest()
    return nodes


def _counts_as_template(node: Node) -> bool:
    if node.tag not in BLOCK or node.tag in ("html", "body", "article", "main"):
        return False
    if not node.inside:
        return True
    if node.prose:
        return False
    article = node.parent
    while not _is_article(article):
        article = article.parent
    return node.words <= article.words * MOST_OF_ARTICLE


def subtree_hashes(page: str | None) -> list[int]:
    """Hashes, as signed integers, of the page's subtrees that may be template, each once."""
    found = {n.digest for n in _digest(parse(page or "")) if _counts_as_template(n) and n.parts}
    return [h - (1 << 64) if h >> 63 else h for h in found]


def _is_dropped(node: Node) -> bool:
    if node.gone or node.tag in DROPPED:
        return True
    if node.tag == "header":
        return not node.inside
    if node.tag in ("html", "body", "article", "main"):
        return False
    return node.named if node.inside or node.tag in PROSE else bool(node.marks & MARKED)


def _text_length(root: Node) -> int:
    total, work = 0, [root]
    while work:
        for part in work.pop().parts:
            if isinstance(part, str):
                total += len(part)
            elif not _is_dropped(part):
                work.append(part)
    return total


def _article(root: Node) -> Node:
    """The article with the most text, else the main element, else the page."""
    for wanted in ("article", "main"):
        found, work = [], [root]
        while work:
            node = work.pop()
            for part in node.parts:
                if isinstance(part, Node) and not _is_dropped(part):
                    if part.tag == wanted or wanted == "main" and "main" in part.marks:
                        if not part.named:
                            found.append(part)
                    else:
                        work.append(part)
        if found:
            return max(found, key=_text_length)
    return root


def extract_text(page: str | None, template: frozenset[int] | set[int] = frozenset()) -> str:
    """The article's text: a line a block. ``template``: hashes of subtrees to delete, as ``subtree_hashes`` has them."""
    root = parse(page or "")
    if template:
        for node in _digest(root):
            signed = node.digest - (1 << 64) if node.digest >> 63 else node.digest
            if signed in template and _counts_as_template(node):
                node.gone = True
    top = _article(root)
    lines: list[str] = []
    buffer: list[str] = []

    def flush() -> None:
        if buffer:
            line = " ".join(entities.unescape("".join(buffer)).split())
            if line:
                lines.append(line)
            buffer.clear()

    work: list[Node | str | None] = [top]  # None ends a block
    while work:
        part = work.pop()
        if part is None:
            flush()
        elif isinstance(part, str):
            buffer.append(part)
        elif part is not top and (_is_dropped(part) or part.tag == "article" and part.named):
            buffer.append(" ")
        else:
            if part.tag == "br":
                buffer.append(" ")
            block = part.tag in BLOCK
            if block:
                flush()
                work.append(None)
            held = part.parts
            if part.tag == "header":  # an article's header: its headings
                held = [p for p in held if isinstance(p, Node) and p.tag in HEADINGS]
            work += held[::-1]
    flush()
    return "\n".join(lines)


def site_templates(pages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(__host, __page, __h), each page's subtrees, and (__host, __h), those that are template on their host; from rows with
    __host, __page (a digest of the page) and __html."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hashes = [subtree_hashes(page) for page in batch.column(2).to_pylist()]
            sizes = [len(h) for h in hashes]
            at = pa.array([i for i, n in enumerate(sizes) for _ in range(n)], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at), pa.array([x for h in hashes for x in h], pa.int64())], ["__host", "__page", "__h"])

    held = pages.select("__host", "__page", "__html").mapInArrow(run, "__host string, __page binary, __h long")
    held = materialize(held.distinct(), "html-subtrees")  # copies of a page are one page
    often = held.groupBy("__host", "__h").agg(F.count("*").alias("__n")).where(f"__n >= {LEAST_PAGES}").select("__host", "__h")
    return held, materialize(often, "html-often")


def extract_pages(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One row per input row: ``id_col``, ``url_col`` and text."""
    host, _ = url_parts(F.col(url_col).cast("string"))
    html = F.col(html_col).cast("string")
    rows = pages.select(F.col(id_col).alias("__id"), F.col(url_col).alias("__url"), host.alias("__host"), F.unhex(F.md5(html)).alias("__page"), html.alias("__html"))
    held, often = site_templates(rows)
    by_host: dict[str | None, pa.Array] = {}
    if often.count() <= BROADCAST_ROWS:  # the workers get them all, so that pages are not shuffled
        for batch in often.toArrow().group_by("__host").aggregate([("__h", "list")]).to_batches():
            by_host.update(zip(batch.column("__host").to_pylist(), (pa.array(x) for x in batch.column("__h_list").to_pylist())))
        both = rows.select("__id", "__url", "__html", "__host", F.lit(None).cast("array<long>").alias("__template"))
    else:
        found = held.join(often, ["__host", "__h"]).groupBy("__host", "__page").agg(F.collect_list("__h").alias("__template"))
        both = rows.join(found, ["__host", "__page"], "left").select("__id", "__url", "__html", "__host", "__template")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sets: dict[str | None, frozenset[int]] = {}
        for batch in batches:
            texts = []
            for page, host, template in zip(*(batch.column(i).to_pylist() for i in (2, 3, 4))):
                if template is None and host in by_host and host not in sets:
                    sets[host] = frozenset(by_host[host].to_pylist())
                texts.append(extract_text(page, sets.get(host, frozenset()) if template is None else frozenset(template)))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string())], ["__id", "__url", "text"])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in both.schema.fields[:2])
    return both.mapInArrow(run, f"{kinds}, text string").withColumnsRenamed({"__id": id_col, "__url": url_col})
