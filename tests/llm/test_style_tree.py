import html
import math
import re
import time
from collections import Counter, defaultdict

import pandas as pd
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from ebbtide.llm import style_tree

from .conftest import FOLDER

SCHEMA = "page_id long, url string, html string, key string, host string, text string, low string, path string"


def _table(spark, rows):
    return spark.createDataFrame([(*r, *["clash"] * 5) for r in rows], SCHEMA)


def _article(page):
    """Text of a page of the given layout, by cutting strings."""
    inside = (page or "").partition("<article>")[2].partition("</article>")[0]
    blocks = [re.sub("</?b>", "", b).replace("<br>", " ") for b in re.split("</?(?:p|h1)>", inside)]
    blocks = [" ".join(html.unescape(b).split()) for b in blocks]
    return "\n\n".join(b for b in blocks if b)


def test_whole_table(spark):
    found = style_tree.extracted(spark.read.parquet(f"{FOLDER}/pages.parquet")).collect()
    pages = pd.read_parquet(f"{FOLDER}/pages.parquet")
    expected = {r.page_id: (r.page_id, r.url, t := _article(r.html), len(t)) for r in pages.itertuples()}
    assert len(found) == len(pages) and {r["page_id"]: tuple(r) for r in found} == expected


def _story(i):
    return f"Story {i} tells of {i * 7919} things, and of some more that no other page has."


def _page(i, extra="", box="Read our newsletter every week, it is free.", story=None):
    story = story or _story(i)
    return (
        f"<html><body><div class=top>{extra}</div><div class=story{i}><h1>Title {i}</h1><p>{story}</p>"
        f"<div class=box><p>{box}</p></div></div></body></html>"
    )


def test_the_tree_removes_what_a_host_repeats(spark):
    rows = [(i, f"http://A.example/{i}", _page(i)) for i in range(6)]
    rows += [(10, "http://a.example:80/10", _page(10, box="Not what the others say in that place."))]
    rows += [(20 + i, f"http://few.example/{i}", _page(i)) for i in range(3)]  # too few pages to tell
    rows += [(30 + i, f"http://same.example/{i}", _page(1, story="One story, many times.")) for i in range(9)]
    rows += [(50 + i, f"http://ads.example/{i}", _page(i, f"{i * 31} ad", "again " * 40)) for i in range(5)]
    found = {r["page_id"]: r["text"] for r in style_tree.extracted(_table(spark, rows)).collect()}
    for i in range(6):
        assert found[i] == f"Title {i}\n\n{_story(i)}"
    for i in range(3):
        assert found[20 + i].endswith("it is free.")
    for i in range(9):
        assert found[30 + i] == "Title 1\n\nOne story, many times.\n\nRead our newsletter every week, it is free."
    for i in range(5):  # the branch holds most of the text
        assert found[50 + i].endswith("again again")


def test_importance_equals_brute_force(spark):
    import random

    rng = random.Random(3)
    rows = []
    for i in range(60):
        parts = [f"<div class={rng.choice('uvw')}><p>{rng.choice(['x', 'y', f'own {i}'])}</p></div>" for _ in range(3)]
        rows.append((i, f"http://h{i % 3}.example/", f"<body>{''.join(parts)}</body>"))
    nodes, seen = [], defaultdict(set)
    for _, url, page in rows:
        blocks, styles = style_tree.page_blocks(page)
        host, digest = url[7:-1], "\n".join(b[1] for b in blocks)
        for node in {(b[0], False, b[1]) for b in blocks} | {(p, True, s) for p, s in styles}:
            nodes.append((host, digest, *node))
            seen[host, *node].add(digest)
            seen[host, *node[:2]].add(digest)
    expected = {}
    for host in {n[0] for n in nodes}:
        for path in {"/".join(n[2].split("/")[:k]) for n in nodes for k in range(2, n[2].count("/") + 2)}:
            inside = [k for k in seen if len(k) == 4 and k[0] == host and not k[2] and f"{k[1]}/".startswith(path + "/")]
            worth, n_all, most = 0.0, 0, 0
            for k in inside:
                n, m = len(seen[k]), len(seen[k[:3]])
                worth += n * (1 - math.log(n) / math.log(m) if m > 1 else 1)
                n_all, most = n_all + n, max(most, m)
            if not n_all:
                continue
            styles = [len(seen[k]) for k in seen if len(k) == 4 and k[0] == host and k[2] and k[1] == path]
            m = len(seen[host, path, True])
            shares = [s / sum(styles) for s in styles]
            shown = (-sum(p * math.log(p) for p in shares) / math.log(m) if m > 1 else 1) if styles else 0
            d = style_tree.DECAY ** len(styles)
            expected[host, path] = (most, (1 - d) * shown + d * worth / n_all)
    table = spark.createDataFrame(
        [(h, hash(d), p, s, hash(f)) for h, d, p, s, f in nodes],
        "host string, digest long, path string, is_style boolean, feature long",
    )
    found = {(r["host"], r["path"]): (r["n_pages"], r["importance"]) for r in style_tree.branch_importance(table).collect()}
    assert found.keys() == expected.keys()
    for k, (m, value) in expected.items():
        assert found[k][0] == m and found[k][1] == pytest.approx(value, abs=1e-9)


@pytest.mark.parametrize(
    "page, text",
    [
        ("", ""),
        ("plain  text", "plain text"),
        ("<p>a<p>b &lt;i&gt; &amp;amp; 1 < 2<br>c</p>", "a\n\nb <i> &amp; 1 < 2 c"),
        ("<p>x&nbsp;&#160; y\n\t</p><!-- no --><p>z</p", "x y\n\nz"),
        ("<p>a<script>var b='</p>'</script>c</p><style>p{}</style><noscript>on</noscript>", "ac"),
        ("<p>start<script>never closed <p>x", "start"),
        ("<ul><li>one<li>two <b>three</b></ul><table><tr><td>a<td>b<tr><th>c</table>", "one\n\ntwo three\n\na\n\nb\n\nc"),
        ('<div class="page-header"><p>t</p></div><nav>n</nav><header>h</header><footer>f</footer><aside>a</aside>', "t"),
        ('<div class="cookie-notice">c</div><div id="sidebarLeft">s</div><form>f</form><div role=banner>r</div>x', "x"),
        ('<div class="comment">only readers</div>', ""),
        ('<body class="has-sidebar"><article class="post comments-open"><header><h1>T</h1></header>b</article></body>', "T\n\nb"),
        ('<main><p>in</p><div class="comments"><article><p>me too</p></article></div></main><p>out</p>', "in"),
        ('<div class="widget"><article>a</article><p>w</p></div><p>rest</p>', "a"),
        ('<div hidden>h</div><p style="display: none">n</p><p>v<span class="ad">buy</span>w</p>', "vw"),
        ("<article><p>cut off &amp", "cut off &"),
        ('<div><ul><li><a href="/">Home</a><li><a href="/b">B</a></ul><p>Text with <a href=x>a link</a>.</p></div>', "Text with a link."),
    ],
)
def test_pages(page, text):
    assert style_tree.main_text(page) == text


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from("<p> </p> <div> </div> <b> </b> <li> <ul> </ul> <td> <a </a> > < & &amp; é \n x y".split(" ")), max_size=30))
def test_words_outside_tags_stay(parts):
    page = " ".join(parts)
    blocks, _ = style_tree.page_blocks(page)
    kept = Counter(w for b in blocks for w in b[1].split() if w in ("x", "y", "é"))
    plain = re.sub(r"<(?:/?[a-z][^>]*(?:>|$))", " ", page)
    assert kept == Counter(w for w in plain.split() if w in ("x", "y", "é"))


def test_strange_pages_take_linear_time():
    start = time.time()
    for page in ("<div>" * 20_000, "<i>" * 20_000 + "</b>" * 20_000, "<i>" * 20_000 + "<p>x" * 5_000, '<a b="' * 50_000, "<" * 50_000):
        style_tree.main_text(page)
    assert style_tree.main_text("<div>" * 5_000 + "deep") == "deep"
    assert time.time() - start < 20


def test_odd_rows(spark):
    rows = [
        (1, "http://x.example/", None), (2, None, ""), (None, "no host", "<p>a</p>"), (None, None, "<p>a</p>"),
        (3, "//x.example/a", "<p>word " * 20_000), (3, "//x.example/a", "<p>twice</p>"), (3, "//x.example/a", "<p>twice</p>"),
    ]
    found = style_tree.extracted(_table(spark, rows))
    assert found.columns == ["page_id", "url", "text", "n_chars"]
    key = lambda r: tuple(map(str, r))
    expected = [(i, u, t := style_tree.main_text(h or ""), len(t)) for i, u, h in rows]
    assert sorted(map(tuple, found.collect()), key=key) == sorted(expected, key=key)
    assert style_tree.extracted(_table(spark, rows).limit(0)).count() == 0
