import json
import re
import random
import time

import pyarrow as pa
import pytest

from korpusa.llm import extract as X

PAGE = """<!DOCTYPE html><html><head><title>T &amp; x</title><style>p{{}}</style><script>var a="</p><article>";</script></head>
<body class="menu-open"><header>Site</header><nav><ul><li><a href=/>Home</a></ul></nav><div class="cookie-notice">We use cookies</div><!-- ad > -->
<div id="sidebar-left">Side</div><article class="post"><h1>{title}</h1><p>One&nbsp;&eacute;  two<br>three<p>Four <b>bold</b> five</p>
<div class="ad">Buy</div><ul><li>a<li>b</ul><form><input>Search</form><table><tr><td>x<td>y</table><p>{body}</article>
<section class="comments"><p>First!</p></section><aside>More</aside><footer>&copy; 2020</footer></body></html>"""


def test_article_without_chrome():
    want = "Ti tle\nOne é two three\nFour bold five\na\nb\nx\ny\nend <tag> &"
    assert X.main_text(PAGE.format(title="Ti\n tle", body="end &lt;tag&gt; &amp;")) == want


def test_odd_pages():
    assert X.main_text(None) == X.main_text("") == ""
    assert X.main_text("plain &lt; text") == "plain < text"
    assert X.main_text("<p>a<script>x") == "a" and X.main_text("<p>a<!-- b") == "a" and X.main_text("a < b <p>c") == "a < b\nc"
    assert X.main_text("<body><main><p hidden>n</p><p>y</p></main>") == "y"
    assert X.main_text("<div>" * 3000 + "deep" + "</div>" * 2000) == "deep"
    assert len(X.main_text("<p>" + "word " * 200_000)) == 999_999


def test_simple_tree_matching_counts_the_mapping():
    a, b = (X.trimmed(X.parse(h)) for h in ("<div><p>a</p><ul><li>1</li><li>2</li></ul></div>", "<div><p>b</p><h1>z</h1><ul><li>1</li></ul></div>"))
    assert X.simple_tree_match(a, b, {}) == 5


def test_template_finds_slot_and_constant_nodes():
    rng = random.Random(1)
    words = lambda n: " ".join(rng.choice(["alpha", "beta", "gamma", "delta"]) + str(rng.randrange(999)) for _ in range(n))
    pages = [f"<body><div class=top>Daily news</div><div class=wrap><div class=text><p>{words(40)}</p><p>{words(30)}</p></div><div class=foot>All rights</div></div></body>" for _ in range(8)]
    t = json.dumps(X.induce(pages))
    text = X.main_text(pages[0], t)
    assert "Daily" not in text and "rights" not in text and text.count("\n") == 1
    assert "Daily" in X.main_text(pages[0])
    same = [pages[0]] * 8  # copies of one page teach nothing
    assert X.induce(same) == {"constant": [], "slot": []}


def test_rows(spark):
    html = PAGE.format(title="t", body="b")
    rows = [(1, "http://a.x/1", html, "k"), (1, "http://a.x/1", html, "k"), (2, None, None, "k"), (3, "bad", "", None), (None, "http://a.x/2", "<p>q", "k")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, host string")
    got = sorted(((r.page_id, r.url, r.text) for r in X.extract(df).collect()), key=str)
    assert got == sorted([(i, u, X.main_text(h)) for i, u, h, _ in rows], key=str)
    assert X.extract(df.limit(0)).collect() == []


def test_shuffled_templates_give_the_same(spark, sf, monkeypatch):
    pages = spark.read.parquet(f"{sf}/pages.parquet")
    want = sorted(map(tuple, X.extract(pages).collect()))
    monkeypatch.setattr(X, "MOST_SHIPPED", -1)
    assert sorted(map(tuple, X.extract(pages).collect())) == want


    for (page, url, html) in pages.select("page_id", "url", "html").limit(50).collect():
        article = re.search(r"<article>(.*?)</article>", html, re.S)[1]
        cut = (X.clean(re.sub(r"<[^>]+>", " ", x)) for x in re.split(r"</?(?:p|h1)\b[^>]*>", article))
        assert dict((w[0], w[2]) for w in want)[page] == "\n".join(x for x in cut if x)


def headed(i, words=30):
    head = "Daily news of the whole wide world, every day at your service since 1920"
    rng = random.Random(i)
    return f"<body><div class=top>{head}</div><div class=text><p>{' '.join(str(rng.random()) for _ in range(words))}</p></div></body>"


def test_template_despite_long_header_copies_and_many_nodes(spark):
    t = json.dumps(X.induce([headed(i) for i in range(8)]))
    assert "Daily" not in X.main_text(headed(0), t) and X.main_text(headed(0), t)
    rows = [(i, f"http://h{g}.x/{i}", headed(0 if i < 40 else i)) for g in (1,) for i in range(50)]
    copies = {r.page_id: r.text for r in X.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert len(copies) == 50 and not any("Daily" in t for t in copies.values()) and all(copies.values())
    long = [p.replace("</body>", "".join(f"<p>{i} {k}" for k in range(X.MOST_NODES)) + "<div class=end><b>All rights</b></div></body>") for i, p in enumerate(map(headed, range(8)))]
    t = json.dumps(X.induce(long))
    assert "rights" not in X.main_text(long[0], t) and f"0 {X.MOST_NODES - 1}" in X.main_text(long[0], t)


def bare(html):
    """A page without its telling tags, classes and ids: only alignment can tell its parts apart."""
    html = re.sub(r"<(/?)(?:article|nav|footer|header|main|aside|section)\b[^>]*>", r"<\1div>", html)
    return re.sub(r"""\s(?:class|id|role)=(?:"[^"]*"|'[^']*'|[^\s>]+)""", "", html)


def test_alignment_alone_finds_the_content(spark, sf):
    rows = spark.read.parquet(f"{sf}/pages.parquet").where("html is not null").select("page_id", "html").collect()
    t = json.dumps(X.induce([bare(r.html) for r in rows[:24]]))
    assert len(json.loads(t)["slot"]) >= 2
    pairs = [(X.main_text(r.html), X.main_text(bare(r.html), t), X.main_text(bare(r.html))) for r in rows]
    right = sum(a == b for a, b, _ in pairs)
    assert right >= 0.9 * len(rows) and right > 2 * sum(a == c for a, _, c in pairs)


def test_slot_skips_what_varies_beside_it():
    page = lambda i: f"<body><div>{'menu ' * 5}{i}</div><div><h2>Title {i}</h2><p>{headed(i)[120:]}</p></div><div>foot {i * 7}</div></body>"
    t = json.dumps(X.induce([page(i) for i in range(8)]))
    assert "menu" not in X.main_text(page(3), t) and "foot" not in X.main_text(page(3), t) and "Title 3" in X.main_text(page(3), t)


def menu_page(i, entries):
    menu = "".join(f"<li>entry {k}</li>" for k in range(entries))
    side = f"<div>see also {i * 13 % 7} {i}</div>"
    return f"<body><ul>{menu}</ul><div><div><div><p>Story {i} {headed(i)[120:]}</p></div></div>{side}</div><div>all rights kept</div></body>"


@pytest.mark.parametrize("entries", [5, 100, 380, 600, 2000])
def test_a_longer_menu_changes_no_text(entries):
    few = json.dumps(X.induce([menu_page(i, 5) for i in range(10)]))
    many = json.dumps(X.induce([menu_page(i, entries) for i in range(10)]))
    got = X.main_text(menu_page(3, entries), many)
    assert got == X.main_text(menu_page(3, 5), few) and got.startswith("Story 3") and "see also" not in got and "entry" not in got


def test_the_order_of_pages_changes_nothing():
    odd = f"<body><p>{headed(99)[120:]}</p></body>"  # a page of the host without its wrapper
    pages = [f"<body><div>site head</div><div><div><p>{headed(i)[120:]}</p></div></div><div>site foot</div></body>" for i in range(9)]
    made = [X.induce(order) for order in ([odd, *pages], [*pages, odd], [*pages[4:], odd, *pages[:4]], [*reversed(pages), odd, pages[0]])]
    assert all(m == made[0] for m in made)
    text = X.main_text(pages[2], json.dumps(made[0]))
    assert "head" not in text and "foot" not in text and text


def test_headers_forms_and_words_inside_articles():
    assert X.main_text("<body><header>Site</header><article><header><h1>T</h1></header><p>x</p></article>") == "T\nx"
    assert X.main_text("<body><form action=/><p>all of the page is in a form</p><select><option>o</select></form>") == "all of the page is in a form"
    assert X.main_text("<body><p>text of the page here</p><form>Name <input></form>") == "text of the page here"
    assert X.main_text('<article><p class="market-share">a</p><p class="related-work">b</p><p class="share-buttons">c</p></article>') == "a\nb"
    assert X.main_text("<body><article>one</article><div class=comments><article class=comment-body>no</article></div><article>two</article>") == "one\ntwo"


def test_broken_and_deep_pages_take_linear_time():
    began = time.time()
    X.main_text('<a "' * 250_000)
    X.main_text("<a b='" * 150_000 + ">")
    X.main_text("<p " + "a" * 1_000_000 + ">x")
    deep = "<div>" * 100_000 + "x" + "</span>" * 100_000
    assert X.main_text(deep) == "x"
    X.induce([f"<p>{i}" + deep for i in range(4)])
    assert X.main_text("<p><button>" + "<div>" * 50_000 + "x") == ""
    assert time.time() - began < 40


def test_templates_learn_from_all_pages(spark):
    """A line on 80 % of a host's pages is template, on 70 % it is content, which a sample can't tell; equal to one process over all pages."""
    rng = random.Random(3)
    pages = [(f"h{g}.x", headed(1000 * g + i).replace("</div></body>", f"<p>{'shared line' if i % 10 < k else rng.random()}</p></div></body>")) for g, k in enumerate((7, *[8] * 24, 10)) for i in range(60)]
    pages += [("few.x", headed(i)) for i in range(3)] + [("h1.x", pages[70][1])] * 40 + [("none.x", None)]
    made = {r.host: r.template for r in X.templates(spark.createDataFrame(pages, "host string, html string")).collect()}
    assert made == {h: json.dumps(X.induce([p for x, p in pages if x == h])) for h, _ in pages if h != "none.x"}
    kept = ["shared line" in X.main_text(next(p for x, p in pages if x == f"h{g}.x" and "shared line" in p), made[f"h{g}.x"]) for g in range(26)]
    assert kept == [True] + [False] * 25


def test_keys_and_places_come_from_written_trees_without_rebuilding(monkeypatch):
    page = "<html><body><nav><a>x</a></nav>" + "<div class=c><p>one</p> <p>two</p><ul><li>3</li><li></li></ul></div>" * 4 + "<script>s</script></body></html>"
    root = X.measure(X.parse(page), digests=True)
    tree, keys, spots, work = X.flat(root), set(), {0}, [(root, 0)]
    while work:
        x, p = work.pop()
        for c, q in zip(x.children, X.child_paths(x, p), strict=True):
            if isinstance(c, X.Node) and c.tag not in X.RAW:
                spots.add(q)
                work.append((c, q))
                keys |= {X.key_of(c, q)} if c.digest and c.tag not in X.TOPS else set()
    monkeypatch.setattr(X, "grown", None)
    assert X.keys_of(tree) == keys and X.places(tree) == spots
    top = X.trimmed(root, keys)
    assert X.places(tree, keys) == {0, top.kids[0].path, top.kids[0].kids[0].path} | {k.path for k in top.kids[0].kids[0].kids}
    monkeypatch.setattr(X, "MOST_NODES", 5)
    assert len(X.places(tree)) == 5 and X.places(tree) <= spots


def test_no_text_is_numbered_and_no_noise_is_searched(monkeypatch):
    asked, root = [], X.measure(X.parse("<nav><a>x</a><a>y</a></nav>a<p>b</p>c<p>d</p>e"))
    plain = X.stable
    monkeypatch.setattr(X, "stable", lambda t: asked.append(t) or plain(t))
    found = X.content(root, ())
    X.places_of(root, [root.children[2]])
    assert found == [root] and len(asked) == 3  # the nav and both paragraphs


def test_rows_of_equal_to_pylist():
    kind = pa.list_(pa.int64())
    b = pa.RecordBatch.from_arrays([pa.array(["a", None, "b"]), pa.array([[1, -1], None, []], kind), pa.array([1, 2, 3])], ["host", "masses", "c"])
    assert list(X.rows_of(b)) == b.to_pylist() and list(X.rows_of(b.slice(1))) == b.slice(1).to_pylist()


def varied_page(i, entries):
    menu = "".join(f"<li>{k % 7}={i}</li>" for k in range(entries))
    return f"<body><ul>{menu}</ul><div><div><div><div><p>Story {i} {headed(i, 1500)[120:]}</p></div></div><div>see also {i * 13 % 7} {i}</div></div></div><div>all rights kept</div></body>"


@pytest.mark.parametrize("entries", [5, 150, 390, 1500])
def test_nodes_beyond_hundreds_that_vary_take_part_in_matching(entries):
    """Entries that are another on each page are no constant nodes; matching of 400 nodes never came to the content below them."""
    few, many = (json.dumps(X.induce([varied_page(i, n) for i in range(10)])) for n in (5, entries))
    assert json.loads(many) == json.loads(few) and len(json.loads(many)["slot"]) > 3
    got = X.main_text(varied_page(3, entries), many)
    assert got == X.main_text(varied_page(3, 5), few) and got.startswith("Story 3") and "see also" not in got and "=" not in got


def test_a_footer_behind_hundreds_of_varying_nodes_is_template():
    page = lambda i: "<body>" + "".join(f"<div><p>{i} {k}</p></div>" for k in range(450 + i % 2)) + "<div><h2>All rights</h2></div></body>"
    t = json.dumps(X.induce([page(i) for i in range(10)]))
    texts = [X.main_text(page(i), t) for i in range(10)]
    assert sum("rights" not in x for x in texts) == 5 and all(f"{i} 449" in x for i, x in enumerate(texts))  # the places of those like the reference


def test_templates_of_large_pages_are_those_of_one_process(spark):
    pages = [(f"h{g}.x", varied_page(i, 450 + i % g)) for g in (1, 3) for i in range(12)]
    made = {r.host: r.template for r in X.templates(spark.createDataFrame(pages, "host string, html string")).collect()}
    assert made == {f"h{g}.x": json.dumps(X.induce([p for x, p in pages if x == f"h{g}.x"])) for g in (1, 3)}


def plain_mapping(a, b):
    """Size and pairs of the largest mapping by the plain table over child lists."""
    if a.node.label != b.node.label:
        return 0, []
    rows = [[(0, [])] * (len(b.kids) + 1)]
    for x in a.kids:
        new = [(0, [])]
        for j, y in enumerate(b.kids):
            n, pairs = plain_mapping(x, y)
            both = rows[-1][j][0] + n, rows[-1][j][1] + pairs
            new.append(max((rows[-1][j + 1], new[j], both), key=lambda c: c[0]))  # the first of equal ones
        rows.append(new)
    n, pairs = rows[-1][-1]
    return n + 1, [(a, b), *pairs]


@pytest.mark.parametrize("wide, cells, kept", [(64, 1 << 20, 100_000), (0, 1, 2), (2, 8, 20)])
def test_matching_by_shape_against_the_plain_table(monkeypatch, wide, cells, kept):
    for name, value in (("WIDE", wide), ("MOST_CELLS", cells), ("MOST_KEPT", kept)):
        monkeypatch.setattr(X, name, value)
    rng = random.Random(wide)
    grow = lambda d: "".join(f"<{t}>{rng.choice('ab')}{grow(d - 1)}</{t}>" for t in rng.choices(["div", "b"], k=rng.randrange(6))) if d else ""
    for _ in range(60):
        a, b = (X.trimmed(X.measure(X.parse(grow(3)), digests=True)) for _ in range(2))
        shapes = X.Shapes()
        for top in (a, b):
            shapes.number(X.breadth_first(top))
        n, pairs = plain_mapping(a, b)
        got = list(X.aligned(a, b, shapes))
        assert n == len(got) == X.simple_tree_match(a, b, {}) == shapes.size(a.shape, b.shape)
        assert {(id(x), id(y)) for x, y in got} == {(id(x), id(y)) for x, y in pairs}


def test_matching_of_deep_and_wide_pages_is_bounded():
    began, rng = time.time(), random.Random(4)
    X.induce(["".join(f"<div>{rng.random()}" for _ in range(20_000)) for _ in range(4)])
    X.induce([f"<body>{'<b>z</b>' * i}" + "".join(f"<p>{rng.random()}</p>" for _ in range(4_000 + i)) for i in range(4)])
    assert time.time() - began < 40


def test_decoded_parts_are_kept_by_their_size(monkeypatch):
    monkeypatch.setattr(X, "MOST_CACHED", 10)
    made = []
    get = X.cached(lambda text: made.append(text) or len(text))
    assert [get("aaaa"), get("bbbb"), get("aaaa"), get("cccccc"), get("aaaa"), get("bbbb")] == [4, 4, 4, 6, 4, 4]
    assert made == ["aaaa", "bbbb", "cccccc", "bbbb"]
