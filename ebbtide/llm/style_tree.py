"""Main text of web pages by site style trees.

The pages of a host are merged into one tree of element labels. An element's presentation is the row of labels below
it, its content the texts of the blocks below it. Presentation that varies and content that seldom repeats have a high
entropy and are important; branches of low importance (the same notice, the same box on page after page) are removed
from each page. Menus, adverts and footers whose words change from page to page look important to any such tree, so
what the page itself names as one of these (its element, role, class or id) is left out first, on any host.
"""

import hashlib
import html
import re
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import from_arrow_schema

from ebbtide.llm.tables import with_size_checked
from ebbtide.session import materialized

#: A branch of less importance than this is removed.
LEAST_IMPORTANCE = 0.2
#: Different pages of a host that must have a branch before it can be removed.
LEAST_PAGES = 4
#: Weight of presentation against content: 1 - DECAY ** (number of styles).
DECAY = 0.9

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose content is no markup.
RAW = frozenset("script style title textarea iframe noscript noembed noframes xmp template".split())
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure "
    "footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre section summary table tbody "
    "td tfoot th thead tr ul".split()
)
#: An opening element of the key closes an open one of these, up to the nearest list, table or cell.
CLOSES = {
    "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"},
    "th": {"td", "th"}, "option": {"option"}, "tbody": {"tr", "td", "th", "thead", "tbody"},
}
SCOPES = {"ul", "ol", "dl", "table", "menu", "select", "article", "main", "body"}

LEFT_OUT = frozenset(
    "head nav footer aside form menu dialog button select object svg math canvas audio video map datalist "
    "applet frameset".split()
)
LEFT_OUT_ROLES = frozenset(
    "navigation banner contentinfo complementary search form menu menubar toolbar dialog alertdialog alert".split()
)
#: Parts of class names and ids that name what is no article.
LEFT_OUT_NAMES = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense adslot sponsor sponsored sponsors promo promoted "
    "promotion banner cookie cookies consent gdpr notice notices popup modal overlay newsletter subscribe subscription "
    "signup signin login nav navbar navigation menu menus breadcrumb breadcrumbs sidebar sidebars aside widget widgets "
    "related recommended recommendations share sharing sharebar social comment comments commentlist respond reply "
    "replies disqus footer footnav masthead topbar toolbar pagination pager copyright skip search searchbox".split()
)
#: Those of them that hold for an article element and its surroundings, too.
NEVER_ARTICLES = frozenset(
    "ad ads advert adverts advertisement advertising sponsored comment comments commentlist reply replies respond "
    "disqus related".split()
)
#: Before or behind such a part, a name tells how the page is laid out, not what the element is.
_LAYOUT = re.compile(r"^(?:has|with|without|no|not|is)[-_]|[-_](?:layout|page|open|closed|enabled|disabled)$")
#: Levels below which places of a page are no longer told apart.
DEEPEST = 200

_TAG = re.compile(
    r"<(?:!--.*?(?:--!?>|\Z)|(?P<end>/?)(?P<name>[a-zA-Z][^\s/>]*+)"
    r"(?P<rest>(?:[^>=]++|=\s*+(?:\"[^\"]*+\"|'[^']*+')?)*+)>|[!?/][^>]*+(?:>|\Z)|[a-zA-Z][^>]*+\Z)",
    re.S,
)
_ATTRIBUTE = re.compile(r"""([^\s=/"'>]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
_PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)

ARTICLE, MAIN, BODY = 2, 1, 0
KEPT, SOFT, HARD = 0, 1, 2  # left out by a name (an article inside may still count), left out for good


def _named(value, left_out):
    """HARD if a part of a class or id names what is never an article, SOFT if it is one of ``left_out``."""
    found = KEPT
    for name in value.split():
        if not _LAYOUT.search(name):
            parts = {p.lower() for p in _PART.findall(name)}
            if parts & NEVER_ARTICLES:
                return HARD
            if parts & left_out:
                found = SOFT
    return found


class Element:
    __slots__ = ("name", "path", "depth", "out", "where", "children")

    def __init__(self, name, path, depth, out, where):
        self.name, self.path, self.depth, self.out, self.where, self.children = name, path, depth, out, where, []


def _opened(name, rest, parent, by_name):
    """The element that a tag opens below ``parent``."""
    given = {a[0].lower(): a[1] or a[2] or a[3] for a in _ATTRIBUTE.findall(rest)} if rest.strip(" /\n\t") else {}
    classes, role = given.get("class", ""), given.get("role", "").lower()
    where, out = parent.where, parent.out
    if name == "article" or given.get("itemprop") == "articleBody":
        where = ARTICLE
    elif (name == "main" or role == "main") and where == BODY:
        where = MAIN
    if name in LEFT_OUT or role in LEFT_OUT_ROLES or "hidden" in given or given.get("aria-hidden") == "true":
        out = HARD
    elif name == "header" and where == BODY or _HIDDEN.search(given.get("style", "")):
        out = HARD
    elif name not in ("html", "body") and out != HARD:
        is_article = name in ("article", "main")
        left_out = LEFT_OUT_NAMES if by_name and not is_article else frozenset()
        named = max(_named(classes, left_out), _named(given.get("id", ""), left_out))
        out = named if is_article else max(out, named)
    if name not in BLOCKS or parent.depth >= DEEPEST:
        return Element(name, parent.path, parent.depth, out, where)
    label = re.sub(r"\d+", "0", f"{name}.{'.'.join(classes.split())}" if classes else name)
    return Element(name, f"{parent.path}/{label}", parent.depth + 1, out, where)


def page_blocks(text: str, by_name=True):
    """(blocks, styles) of a page without what it names as no article.

    A block is (path, text, ARTICLE or MAIN or BODY, characters in links); a style is (path, row of labels below).
    """
    stack, blocks, styles = [Element("", "", 0, KEPT, BODY)], [], []
    n_open = Counter()
    pieces, linked = [], 0

    def flush():
        nonlocal pieces, linked
        if pieces:
            words = " ".join("".join(pieces).split())
            if words:
                at = stack[-1]
                blocks.append((at.path, words, at.where, linked))
            pieces, linked = [], 0

    def close(depth):
        while len(stack) > depth:
            if stack[-1].name in BLOCKS:
                flush()
            gone = stack.pop()
            n_open[gone.name] -= 1
            if gone.children and gone.name in BLOCKS and not gone.out:
                styles.append((gone.path, " ".join(gone.children)))

    def add(raw):
        nonlocal linked
        if stack[-1].out == KEPT and raw:
            plain = html.unescape(raw)
            pieces.append(plain)
            if n_open["a"]:
                linked += len(plain)

    at = 0
    while True:
        tag = _TAG.search(text, at)
        add(text[at : tag.start() if tag else len(text)])
        if not tag:
            break
        at = tag.end()
        name = (tag["name"] or "").lower()
        if not name:
            continue
        if tag["end"]:
            if n_open[name]:
                close(next(i for i in range(len(stack) - 1, 0, -1) if stack[i].name == name))
            continue
        if name in RAW:
            ending = re.compile(f"</{re.escape(name)}(?=[\\s/>])[^>]*>?", re.I).search(text, at)
            at = ending.end() if ending else len(text)
            continue
        if name == "br":
            add(" ")
            continue
        if name in BLOCKS:
            flush()
            shut = {"p", *CLOSES.get(name, ())}
            i = len(stack) - 1
            while i and any(n_open[x] for x in shut):
                if stack[i].name in shut:
                    close(i)
                elif stack[i].name in SCOPES or stack[i].name in BLOCKS and len(shut) == 1:
                    break
                i -= 1
        if name in VOID:
            continue
        element = _opened(name, tag["rest"], stack[-1], by_name)
        if name in BLOCKS and not element.out:
            below = stack[-1].children
            label = element.path.rpartition("/")[2]
            if not below or below[-1] != label:
                below.append(label)
        if element.out and not stack[-1].out and name in BLOCKS:
            flush()
        stack.append(element)
        n_open[name] += 1
    close(1)
    flush()
    if not blocks and by_name:
        return page_blocks(text, by_name=False)
    return blocks, styles


def _is_menu(block):
    path, words, _, linked = block
    return linked >= 0.9 * len(words) and path.rpartition("/")[2].startswith("li")


def main_text(text: str, low=()):
    """The page's main text: its articles, or else its main part, or else all that is left of its body.

    ``low``: paths of branches without importance. A page that would lose half of its text or more with them keeps it:
    that much is no furniture, but a text that the host has many times.
    """
    blocks, _ = page_blocks(text)
    where = max((b[2] for b in blocks), default=BODY)
    blocks = [b for b in blocks if b[2] == where]
    if where == BODY:
        blocks = [b for b in blocks if not _is_menu(b)] or blocks
    if low:
        left = [b for b in blocks if not any(b[0] == p or b[0].startswith(p + "/") for p in low)]
        if 2 * sum(len(b[1]) for b in left) > sum(len(b[1]) for b in blocks):
            blocks = left
    return "\n\n".join(b[1] for b in blocks)


def _digest(text):
    return int.from_bytes(hashlib.blake2b(text.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little", signed=True)


_NODES = [("path", pa.string()), ("is_style", pa.bool_()), ("feature", pa.int64())]
_FOUND = [("digest", pa.int64()), ("nodes", pa.list_(pa.struct(_NODES)))]
_TEXT = [("text", pa.string()), ("n_chars", pa.int64())]


@F.arrow_udf(from_arrow_schema(pa.schema(_FOUND)))
def page_nodes(pages: pa.Array) -> pa.Array:
    """Digest of a page's texts, and each node of its tree with a hash of its content or of its presentation."""
    digests, ends, paths, kinds, features = [], [0], [], [], []
    for page in pages:
        blocks, styles = page_blocks(page.as_py())
        found = {(b[0], False, b[1]) for b in blocks} | {(p, True, s) for p, s in styles}
        for path, is_style, feature in found:
            paths.append(path)
            kinds.append(is_style)
            features.append(_digest(feature))
        ends.append(len(paths))
        digests.append(_digest("\n".join(b[1] for b in blocks)))
    columns = [pa.array(c, t) for c, (_, t) in zip((paths, kinds, features), _NODES)]
    rows = pa.StructArray.from_arrays(columns, [name for name, _ in _NODES])
    listed = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), rows)
    return pa.StructArray.from_arrays([pa.array(digests, pa.int64()), listed], ["digest", "nodes"])


@F.arrow_udf(from_arrow_schema(pa.schema(_TEXT)))
def page_text(pages: pa.Array, low: pa.Array) -> pa.Array:
    texts = [main_text(p.as_py(), low=paths.as_py() or ()) for p, paths in zip(pages, low)]
    return pa.StructArray.from_arrays(
        [pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["text", "n_chars"]
    )


def page_host(url="url"):
    """Host of an address in lower case; empty if there is none."""
    host = F.regexp_extract(F.col(url), r"^\s*(?:[A-Za-z][A-Za-z0-9+.\-]*:)?//(?:[^/?#@]*@)?([^/:?#]+)", 1)
    return F.coalesce(F.lower(host), F.lit(""))


def branch_importance(nodes: DataFrame) -> DataFrame:
    """``host, path, n_pages, importance`` of every branch of every host's style tree.

    ``nodes``: host, digest, path, is_style, feature. Pages of a host with the same texts count as one. A block's
    content is worth 1 - log_m(n) if n of the m pages that have its place repeat it; a branch's content is worth the mean
    over all blocks in it, its presentation the entropy of its styles to the base m. Both are joined as
    (1 - d) * presentation + d * content, d = DECAY ** number of styles.
    """
    once = nodes.select("host", "path", "is_style", "feature", "digest").distinct()
    times = once.groupBy("host", "path", "is_style", "feature").agg(F.count("*").alias("n"))
    # Summed before anything is joined, so that a place which very many pages have is one row of a task.
    n, place = F.col("n").cast("double"), ["host", "path", "is_style"]
    sums = times.groupBy(*place).agg(F.sum("n").alias("n"), F.sum(n * F.log(n)).alias("n_log"), F.count("*").alias("kinds"))
    pages = nodes.groupBy(*place).agg(F.count_distinct("digest").alias("m"))
    known = sums.join(pages, place).withColumn("log_m", F.log(F.col("m").cast("double")))
    worth = F.when(F.col("m") > 1, F.col("n") - F.col("n_log") / F.col("log_m")).otherwise(F.col("n"))
    leaves = known.where(~F.col("is_style")).select("host", "path", worth.alias("worth"), "n", "m")
    steps = F.split("path", "/")
    above = F.transform(
        F.sequence(F.lit(2), F.size(steps)), lambda i: F.array_join(F.slice(steps, 1, i), "/")
    )
    content = (
        leaves.where(F.col("path") != "").select("host", F.explode(above).alias("path"), "worth", "n", "m")
        .groupBy("host", "path")
        .agg((F.sum("worth") / F.sum("n")).alias("content"), F.max("m").alias("n_pages"))
    )
    entropy = F.log(F.col("n").cast("double")) - F.col("n_log") / F.col("n")
    presentation = known.where("is_style").select(
        "host",
        "path",
        F.when(F.col("m") > 1, entropy / F.col("log_m")).otherwise(1.0).alias("presentation"),
        F.col("kinds").alias("n_styles"),
    )
    decay = F.pow(F.lit(DECAY), F.coalesce("n_styles", F.lit(0)))
    return content.join(presentation, ["host", "path"], "left").select(
        "host",
        "path",
        "n_pages",
        ((1 - decay) * F.coalesce("presentation", F.lit(0.0)) + decay * F.col("content")).alias("importance"),
    )


def extracted(pages: DataFrame, least=LEAST_IMPORTANCE, least_pages=LEAST_PAGES) -> DataFrame:
    """``page_id, url, text, n_chars`` of every row of ``pages``.

    Reads ``page_id, url, html``; other columns may have any name. Blocks stand in page order with an empty line between
    them, white space inside a block is one space. A null html is empty, and an empty page has an empty text; pages
    without a host share the empty one; repeated rows each get their row, page_id may be null. An empty table gives no
    rows. Nothing is cut short: a page of any length is read whole.

    Pages are parsed twice: once for the nodes, once for the text. What is grouped by host is one row for each place
    and content, counted before it is moved, so a host of a third of all pages is spread out. Pages move (by a hash of
    the page) only if more pages have a branch to lose than may be broadcast.
    """
    key = F.xxhash64("page_id", "url", "html")
    whole = F.coalesce(F.col("html").cast("string"), F.lit(""))
    parsed = pages.select(key.alias("key"), page_host().alias("host"), page_nodes(whole).alias("found"))
    parsed = materialized(parsed.select("key", "host", "found.digest", "found.nodes"), "nodes")
    nodes = parsed.select("host", "digest", F.explode("nodes").alias("node")).select("host", "digest", "node.*")
    # An article is never furniture.
    may_go = (F.col("importance") < least) & (F.col("n_pages") >= least_pages)
    is_main = F.col("path").rlike(r"/(article|main|body|html)(\.[^/]*)?$")
    low = with_size_checked(branch_importance(nodes).where(may_go & ~is_main).select("host", "path"))
    steps = F.array_distinct(F.transform("nodes", lambda x: x["path"]))
    places = parsed.select("key", "host", F.explode(steps).alias("path")).distinct()
    losing = places.join(low, ["host", "path"]).groupBy("key").agg(F.collect_set("path").alias("low"))
    losing = with_size_checked(losing)
    found = pages.select("page_id", "url", whole.alias("html"), key.alias("key")).join(losing, "key", "left")
    return found.select("page_id", "url", page_text("html", "low").alias("found")).select("page_id", "url", "found.*")
