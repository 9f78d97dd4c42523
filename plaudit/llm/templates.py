"""Main text of web pages: site templates are found by counting element subtrees per host."""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from plaudit.sources.shared import saved

# A subtree is a site's template from so many pages of a host on. On fewer it needs a large share of
# a small host, and where authors may repeat text a share of any host.
LEAST_PAGES = 10
LEAST_SHARE = 0.2
SMALL_PAGES = 4
SMALL_SHARE = 0.5

# Names of HTML elements and words in their classes.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes noscript template svg math".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span "
    "strike strong sub sup time tt u var wbr br img".split()
)
DROPPED = frozenset(
    "head nav footer aside form menu dialog button select option datalist fieldset input object embed applet canvas "
    "audio video map link meta".split()
) | RAW
TEXT_BLOCKS = frozenset("p h1 h2 h3 h4 h5 h6 li pre blockquote td th dt dd figcaption".split())
CLOSES_P = frozenset(
    "p div ul ol dl table section article aside header footer nav main form h1 h2 h3 h4 h5 h6 pre blockquote address "
    "figure hr fieldset details menu".split()
)
SIBLINGS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
SCOPES = frozenset("ul ol dl table article section div body html main tr tbody thead select".split())
CLUTTER = re.compile(
    r"(?:^|[\s_-])(?:ads?|advert\w*|adsense|sponsor\w*|promo\w*|banner|nav|navbar|navigation|menu|breadcrumbs?|sidebar|"
    r"side-bar|aside|footer|cookies?|consent|gdpr|notices?|alert|popup|modal|overlay|newsletter|subscribe|subscription|"
    r"signup|share|sharing|social|related|recommended|teaser|widget|comments?|commentlist|disqus|replies|respond|"
    r"pagination|pager|skip-link|masthead|toolbar|hidden)(?:$|[\s_-])",
    re.I,
)
# Words that clutter's names are made of, and those that stand beside them there.
CLUTTER_PART = re.compile(
    r"ads?|advert\w*|adsense|sponsor\w*|promo\w*|banner|nav|navbar|navigation|menu|breadcrumbs?|sidebar|aside|footer|"
    r"cookies?|consent|gdpr|notices?|alert|popup|modal|overlay|newsletter|subscribe|subscription|signup|share|sharing|social|"
    r"related|recommended|teaser|widget|comments?|commentlist|disqus|replies|reply|respond|pagination|pager|masthead|toolbar|hidden",
    re.I,
)
BESIDE = frozenset(
    "area articles bar block body box button buttons container content form inner item items link links list outer posts section slot "
    "stories thread unit wrap wrapper".split()
)
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
HEADERS = re.compile(r"(?:^|\s)(?:site-|page-|top-)?header(?:$|\s)", re.I)
ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog form menu menubar toolbar".split())

_TOKEN = re.compile(
    r"""<!--.*?(?:-->|$)|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']|"[^"]*"|'[^']*')*)>""", re.S
)
_ATTRIBUTE = re.compile(r"""([^\s=/"'<>]+)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""")


class Node:
    __slots__ = ("tag", "clutter", "inside", "children", "digest")

    def __init__(self, tag: str, clutter: bool, inside: bool):
        self.tag, self.clutter, self.inside = tag, clutter, inside
        self.children: list = []
        self.digest = 0


def _names_clutter(token: str) -> bool:
    """Whether a whole class or id says clutter: ``share-buttons`` does, ``related-work`` does not."""
    parts = [part for part in re.split(r"[_-]+", token.lower()) if part]
    known = [bool(CLUTTER_PART.fullmatch(part)) for part in parts]
    return any(known) and all(k or part in BESIDE for k, part in zip(known, parts, strict=True))


def _named_clutter(tag: str, value: str, inside: bool) -> bool:
    """Whether an element goes by the names in its class or id.

    Names of an article, of headings and of text inside articles are the author's. An article inside
    another, as comments are, goes if all its names say so; other elements inside by any one whole name.
    """
    if tag in ("html", "body", "main") or tag in HEADINGS or (tag == "article" and not inside) or (inside and tag in TEXT_BLOCKS):
        return False
    if not inside:
        return bool(CLUTTER.search(value) or HEADERS.search(value))
    tokens = value.split()
    return bool(tokens) and (all if tag == "article" else any)(map(_names_clutter, tokens))


def _is_clutter(tag: str, attributes: str, inside: bool) -> bool:
    if tag in DROPPED or (tag == "header" and not inside):
        return True
    if not attributes:
        return False
    if re.search(r"(?:^|\s)hidden(?:\s|$|/)", attributes):
        return True
    for name, *values in _ATTRIBUTE.findall(attributes):
        name, value = name.lower(), "".join(values)
        if name in ("class", "id"):
            if _named_clutter(tag, value, inside):
                return True
        elif name == "role":
            if value.lower() in ROLES:
                return True
        elif (name == "aria-hidden" and value == "true") or (name == "style" and re.search(r"display\s*:\s*none", value)):
            return True
    return False


def parse(page: str) -> Node:
    """The element tree; every element's digest covers its tag and all below it."""
    root = Node("", False, False)
    stack = [root]

    def close(to: int) -> None:
        while len(stack) > to:
            node = stack.pop()
            parts = [node.tag]
            for child in node.children:
                parts.append(" ".join(child.split()) if isinstance(child, str) else f"\0{child.digest}")
            node.digest = xxhash.xxh3_64_intdigest("\1".join(parts).encode("utf-8", "surrogatepass"))

    at, end = 0, len(page)
    while at < end:
        found = _TOKEN.search(page, at)
        if not found:
            stack[-1].children.append(page[at:])
            break
        if found.start() > at:
            stack[-1].children.append(page[at : found.start()])
        at = found.end()
        if not found[2]:
            continue
        tag = found[2].lower()
        if found[1]:
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag == tag:
                    close(i)
                    break
            continue
        if tag in CLOSES_P or tag in SIBLINGS:
            ends = SIBLINGS.get(tag, {"p"})
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag in ends:
                    close(i)
                    if tag != "tr":
                        break
                elif stack[i].tag in SCOPES:
                    break
        parent = stack[-1]
        inside = parent.inside or parent.tag in ("article", "main")
        node = Node(tag, _is_clutter(tag, found[3], inside), inside)
        parent.children.append(node)
        if tag in RAW:
            closing = re.compile(rf"</{re.escape(tag)}\s*>", re.I).search(page, at)
            at = closing.end() if closing else end
        if tag in VOID or tag in RAW or found[3].endswith("/"):
            stack.append(node)
            close(len(stack) - 1)
            continue
        stack.append(node)
    close(1)
    return root


def _walk(root: Node) -> Iterator[Node]:
    """Elements in page order, without what lies below clutter."""
    waiting = [root]
    while waiting:
        node = waiting.pop()
        if node.tag:
            yield node
        if not node.clutter:
            waiting.extend(child for child in reversed(node.children) if not isinstance(child, str))


def candidates(root: Node) -> dict[int, bool]:
    """Digests of the subtrees that may be a site's template, and whether they stand as a container outside articles.

    Text blocks of an article are not among them.
    """
    found: dict[int, bool] = {}
    for node in _walk(root):
        if (
            not node.clutter
            and node.tag not in INLINE
            and node.tag not in ("html", "body", "article", "main")
            and not (node.inside and node.tag in TEXT_BLOCKS)
            and node.children
        ):
            outside = not node.inside and node.tag not in TEXT_BLOCKS
            found[node.digest] = found.get(node.digest, False) or outside
    return found


def main_text(root: Node, template: frozenset[int] = frozenset(), outside: frozenset[int] = frozenset()) -> str:
    """Text of the articles, else of ``main``, else of the page, without clutter and template.

    ``outside`` is template outside articles only.
    """
    tops: list[Node] = []
    for wanted in ("article", "main", "body"):
        waiting = [root]
        while waiting:
            node = waiting.pop()
            if node.tag == wanted and not node.clutter:
                tops.append(node)
            elif not node.clutter:
                waiting.extend(c for c in reversed(node.children) if not isinstance(c, str))
        if tops:
            break
    blocks: list[str] = []
    block: list[str] = []

    def flush() -> None:
        if block:
            text = "".join(block)
            blocks.extend((html.unescape(text) if "&" in text else text).split())
            block.clear()

    waiting: list = [*reversed(tops or [root])]
    while waiting:
        node = waiting.pop()
        if node is None:
            flush()
        elif isinstance(node, str):
            block.append(node)
        elif node.tag == "br":
            block.append(" ")
        elif (
            not node.clutter
            and not (node.digest in template and not (node.inside and node.tag in TEXT_BLOCKS))
            and not (node.digest in outside and not node.inside)
        ):
            if node.tag not in INLINE:
                flush()
                waiting.append(None)
            waiting.extend(reversed(node.children))
        elif node.tag not in INLINE:
            flush()
    flush()
    return " ".join(blocks)


def main_texts(pages: DataFrame) -> DataFrame:
    """``page_id, url, text, n_chars`` for each row of ``pages(page_id, url, html)``.

    Every page gives the digests of its element subtrees, once each; Spark counts them per host.
    A container outside articles on at least ``LEAST_PAGES`` different pages is template and goes,
    on a host of any size; on fewer, from ``SMALL_PAGES`` on, if it is on ``SMALL_SHARE`` of the
    pages. Text blocks outside articles and containers inside, which authors may repeat, need
    ``LEAST_PAGES`` pages and ``LEAST_SHARE`` of the host's; text blocks of an article always stay.
    Equal pages are one different page. Menus, headers,
    footers and the like go by their tags, roles and classes. A host's template is a short list,
    joined to its pages; Spark broadcasts the lists only while they are small.

    A null or empty page has an empty text; a null url is a host of its own. Repeated rows stay,
    and count as pages. An empty table gives no rows. Other columns are ignored.
    """
    host = F.lower(F.coalesce(F.regexp_extract(F.col("url"), r"^(?:[a-zA-Z][\w+.-]*:)?//(?:[^/@?#]*@)?([^/:?#]*)", 1), F.lit("")))
    pages = pages.select("page_id", "url", "html", host.alias("host"))
    # Each of n equal pages counts as the nth part of a different one.
    marked = pages.select("host", "html", F.xxhash64("html").alias("mark"))
    copies = marked.groupBy("host", "mark").count().where("count > 1").withColumnRenamed("count", "copies")
    marked = marked.join(saved(copies), ["host", "mark"], "left").select("host", "html", (1 / F.coalesce("copies", F.lit(1))).alias("part"))

    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 500):
                part = batch.slice(start, 500)
                hosts, found, parts = [], [], []
                for name, page, share in zip(*(c.to_pylist() for c in part.columns), strict=True):
                    own = candidates(parse(page or ""))
                    hosts += [name] * (len(own) + 1)
                    found += [None, *(d - (1 << 64) if d >> 63 else d for d in own)]
                    parts += [share, *(share if outside else 0.0 for outside in own.values())]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(hosts, pa.string()), pa.array(found, pa.int64()), pa.array(parts, pa.float64())],
                    names=["host", "digest", "part"],
                )

    # A null digest stands for the page itself.
    counts = marked.mapInArrow(digests, "host string, digest long, part double").groupBy("host", "digest")
    counts = counts.agg(F.count("*").alias("count"), F.round(F.sum("part"), 3).alias("different"))
    counts = saved(counts.where((F.col("count") >= SMALL_PAGES) | F.col("digest").isNull()))
    sizes = counts.where("digest is null").select("host", F.col("count").alias("pages"), F.col("different").alias("all_different"))
    everywhere = (F.col("count") >= LEAST_PAGES) & (F.col("count") >= LEAST_SHARE * F.col("pages"))
    small = (F.col("different") >= SMALL_PAGES) & (F.col("different") >= SMALL_SHARE * F.col("all_different"))
    outside = (F.col("different") >= LEAST_PAGES) | small
    common = counts.where("digest is not null").join(sizes, "host").where(everywhere | outside)
    template = saved(
        common.groupBy("host").agg(
            F.collect_list(F.when(everywhere, F.col("digest"))).alias("template"),
            F.collect_list(F.when(outside & ~everywhere, F.col("digest"))).alias("outside"),
        )
    )

    def texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 500):
                part = batch.slice(start, 500)
                found = []
                for page, *own in zip(*(c.to_pylist() for c in part.columns[2:]), strict=True):
                    found.append(main_text(parse(page or ""), *(frozenset(d % (1 << 64) for d in x or ()) for x in own)))
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), pa.array(found, pa.string()), pa.array(map(len, found), pa.int64())],
                    names=["page_id", "url", "text", "n_chars"],
                )

    kind = dict(pages.dtypes)["page_id"]
    return (
        pages.join(template, "host", "left")
        .select("page_id", "url", "html", "template", "outside")
        .mapInArrow(texts, f"page_id {kind}, url string, text string, n_chars long")
    )
