import random
from collections import Counter

from plaudit.llm.templates import candidates, main_text, main_texts, parse

SCHEMA = "page_id long, url string, html string, host string, digest long, template string"


def text(page):
    return main_text(parse(page))


def test_clutter_and_blocks():
    page = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style></head><body>
    <header><h1>Site</h1></header><nav><ul><li>Menu</li></ul></nav><!-- <p>no</p> -->
    <article class="post"><h1>A  title &amp;amp; more</h1><p>One <b>bo</b>ld&nbsp;word<br>two<p>Three &lt;p&gt;
    <script>var x = "</p>";</script><div class="ad">Buy</div><aside>See</aside><form><p>Mail</p></form>
    <section id="comments"><article><p>First!</p></article></section><ul><li>x<li>y</ul></article>
    <div class="cookie-notice">Cookies</div><footer>&copy; us</footer></body></html>"""
    assert text(page) == "A title &amp; more One bold word two Three <p> x y"


def test_broken_and_odd_pages():
    assert text("") == "" and text("plain <i>words</i>") == "plain words"
    assert text("<p>a<p>b</div></p>c") == "a b c"
    assert text("<main><p>in</p></main><p>out</p>") == "in"
    assert text('<p title="a > b">q</p><p hidden>no</p><p style="display: none">no</p>') == "q"
    assert text("<article>open <b>end") == "open end"
    assert text("<div>" * 5000 + "deep" + "</div>" * 5000) == "deep"
    assert text("a < b &unknown; &#65;&#x42;") == "a < b &unknown; AB"
    assert text("<script>never closed <p>x</p>") == ""


def test_names_of_articles_and_their_text_are_the_authors():
    assert text('<div>Menu</div><article class="post share"><p>Story</p></article>') == "Story"
    assert text('<article class="post has-comments"><p>Story</p></article>') == "Story"
    assert text('<main><article class="post share"><p>Story</p></article></main>') == "Story"
    inside = '<h2 id="related-work">Work</h2><section id="social-media"><p>Media</p></section><p class="notice-text">Text</p><p id="alert">Alert</p>'
    assert text(f"<article>{inside}</article>") == "Work Media Text Alert"
    gone = '<div class="share-buttons">Share</div><div class="post ad">Buy</div><section id="comments">C</section><article class="comment-body"><p>R</p></article>'
    assert text(f'<article class="post"><p>Story</p>{gone}<ul class="social_links"><li>x</li></ul></article>') == "Story"
    assert text('<body><div class="cookie-notice">Cookies</div><h1 class="share">Title</h1><p>Story</p></body>') == "Title Story"


def test_templates_of_a_host(spark):
    share = "<div><span>Read more</span> of our stories</div>"
    rows = [(i, f"https://A.example:80/{i}", f"<body>{share}<p>Story {i}</p><div>Own {i}</div></body>", "", 0, "") for i in range(30)]
    rows += [(100 + i, f"//b.example/{i}", f"<body>{share}<p>Other {i}</p></body>", "", 0, "") for i in range(3)]
    # Authors may repeat a passage of an article on many pages.
    rows += [(200 + i, "http://c.example/", "<article><p>Same words</p></article>", "", 0, "") for i in range(30)]
    rows += [(300, None, None, None, None, None), (301, None, "", "", 0, ""), (0, *rows[0][1:]), (None, "x", "<p>y</p>", "", 0, "")]
    found = main_texts(spark.createDataFrame(rows, SCHEMA)).collect()
    assert len(found) == len(rows) and all(r.n_chars == len(r.text) for r in found)
    by_id = {r.page_id: r for r in found}
    assert by_id[4].text == "Story 4 Own 4" and by_id[4].url == "https://A.example:80/4"
    assert by_id[101].text == "Read more of our stories Other 1"
    assert by_id[210].text == "Same words" and by_id[300].text == by_id[301].text == "" and by_id[None].text == "y"


def test_templates_of_few_pages_of_a_hot_host(spark):
    def body(i):
        x = "<div class='x1'><p>Of one section</p></div>" * (i % 10 == 0) + "<div class='x2'>Rotating</div>" * (i % 100 == 1)
        yes = "<p>Yes</p>" * (i % 100 in (1, 10))
        return f"<body>{x}<div><p>Story {i}</p>{yes}</div></body>" if i % 100 < 90 else f"<article><div>Set words</div><p>Story {i}</p></article>"

    rows = [(i, "http://hot.example/", body(i), "", 0, "") for i in range(1200)]
    # One page stored many times is not a template; a small host has some.
    rows += [(2000 + i, "http://hot.example/", "<body><div><p>One page</p></div></body>", "", 0, "") for i in range(20)]
    rows += [(3000 + i, "http://small.example/", f"<body><div>About us</div><p>Small {i}</p></body>", "", 0, "") for i in range(5)]
    by_id = {r.page_id: r.text for r in main_texts(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert by_id[10] == "Story 10 Yes" and by_id[101] == "Story 101 Yes"
    assert by_id[95] == "Set words Story 95" and by_id[2003] == "One page" and by_id[3002] == "Small 2"


def by_the_rule(rows):
    """Texts by counting each host's subtrees page by page."""
    hosts = [url.split("/")[2] for _, url, *_ in rows]
    copies = Counter((host, r[2]) for host, r in zip(hosts, rows, strict=True))
    pages, different, count, parts = Counter(), Counter(), Counter(), Counter()
    for host, r in zip(hosts, rows, strict=True):
        share = 1 / copies[host, r[2]]
        pages[host] += 1
        different[host] += share
        for digest, container in candidates(parse(r[2])).items():
            count[host, digest] += 1
            parts[host, digest] += share * container
    out = []
    for host, r in zip(hosts, rows, strict=True):
        own = candidates(parse(r[2]))
        everywhere = {d for d in own if count[host, d] >= 10 and count[host, d] >= 0.2 * pages[host]}
        outside = {d for d in own if parts[host, d] > 9.999 or (parts[host, d] > 3.999 and parts[host, d] + 0.001 >= 0.5 * different[host])}
        out.append((r[0], main_text(parse(r[2]), frozenset(everywhere), frozenset(outside - everywhere))))
    return out


def test_templates_by_the_rule(spark):
    rng = random.Random(9)
    blocks = [f"<div>Block {k}</div>" for k in range(12)] + [f"<p>Line {k}</p>" for k in range(6)]
    rows = []
    for i in range(260):
        host = rng.choice(["a.example"] * 6 + ["b.example", "c.example"])
        own = [b for k, b in enumerate(blocks) if rng.random() < 0.5 / (k % 12 + 1)]
        inner = [b for k, b in enumerate(blocks) if rng.random() < 0.4 / (k % 12 + 1)]
        article = f"<article><p>Story {i % 200}</p>{''.join(inner)}</article>" if rng.random() < 0.5 else f"<p>Story {i % 200}</p>"
        rows.append((i, f"http://{host}/{i}", f"<body>{''.join(own)}{article}</body>", "", 0, ""))
    rows += [(1000 + i, rows[3][1], rows[3][2], "", 0, "") for i in range(15)]
    found = main_texts(spark.createDataFrame(rows, SCHEMA)).collect()
    assert sorted((r.page_id, r.text) for r in found) == sorted(by_the_rule(rows))


def test_empty_table(spark):
    assert main_texts(spark.createDataFrame([], SCHEMA)).count() == 0
