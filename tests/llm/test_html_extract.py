"""Pages written by hand, and the article of every given page."""

import html
import math
import random
import re

from faultline.llm import html_extract
from faultline.llm.queries import op8_html_extract

SF = "/root/testdata/sf0.01"


def text(source):
    return html_extract.main_text(source, set())


def test_furniture_goes_and_blocks_are_joined():
    assert text("<html><head><title>t</title><style>p{}</style></head><body><header>Top</header><nav>m</nav><main><h1>A &amp; B</h1><p>One <b>two</b>three<p>Four<br>five"
                "<ul><li>x<li>y</ul><div class='share-bar social'>s</div><section id=comments><p>c</p></section><aside>z</aside></main><form>f<input></form><footer>q</footer>") == "A & B One twothree Four five x y"  # fmt: skip
    assert text("<div>a<span>b</span>\n c</div><p>d<div>e</div>f<script>x<p></script>g<!-- n --><p hidden>h</p><div style='display: none'>i</div>") == "ab c d e f g"
    assert text("<div class=cookie-notice>n</div><table><tr><td>1<td>2</table>&lt;b&gt;&nbsp;&#233;") == "1 2 <b> é"
    assert text("plain & simple") == "plain & simple"
    assert text("<article>un<b>closed") == "unclosed"
    assert text("") == "" == text(None)
    long = "word " * 50_000
    assert text(f"<p>{long}</p>") == long.strip()


def test_names_of_furniture_on_wrappers():
    story = "<p>What the page is about, told at some length.</p>"
    for mark in ("class='layout has-sidebar'", "id=page class=no-sidebar", "class=header-fixed", "class=search-results", "class='post comments-open'"):
        for open_, end in (("", ""), ("<article>", "</article>"), ("<main>", "</main>")):
            page = f"<body><div {mark}><div class=sidebar>Latest</div>{open_}{story}<div class=ads>Buy</div>{end}<div class=comments>I</div></div></body>"
            assert text(page) == "What the page is about, told at some length.", page
    assert text(f"<main><h1>Title</h1><div class=has-sidebar>{story}</div></main>") == "Title What the page is about, told at some length."
    # articles of readers and teasers are no wrapped article, and long comments no text
    assert text(f"{story}<div class=related><article>Other</article></div>") == "What the page is about, told at some length."
    assert text(f"<main>{story}<div id=comments>{'<article>I agree with all of it</article>' * 5}</div></main>") == "What the page is about, told at some length."
    assert text(f"<div>{story}</div><div id=comments>{'<p>I agree with all of it</p>' * 5}</div>") == "What the page is about, told at some length."
    assert text(f"<p>a<span class=ad>b</span>c</p>{story}") == "a c What the page is about, told at some length."


def test_style_tree_removes_what_a_site_repeats(spark):
    page = "<div class=top>Welcome to the site</div><div class=body><p>Story {0} begins here</p><p>and goes on {0}</p></div><div class=end>Call us</div>"
    rows = [(i, f"https://site.example/{i}", page.format(i)) for i in range(8)] + [(100, "https://other.example/", page.format(100)), (101, None, page.format(101))]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string")
    got = {r.page_id: r.text for r in html_extract.extract(pages).collect()}
    assert all(got[i] == f"Story {i} begins here and goes on {i}" for i in range(8))
    for alone in (100, 101):
        assert got[alone] == f"Welcome to the site Story {alone} begins here and goes on {alone} Call us"
    # copies of one page are one page of the tree
    copies = spark.createDataFrame([(i, "https://copy.example/", page.format(0)) for i in range(9)], "page_id bigint, url string, html string")
    assert all("Story 0" in r.text for r in html_extract.extract(copies).collect())


def test_given_pages(spark):
    got = {r.page_id: r for r in op8_html_extract(spark, SF).collect()}
    for r in spark.read.parquet(f"{SF}/pages.parquet").collect():
        body = re.search(r"<article>(.*?)(</article>|$)", r.html, re.S)[1]
        parts = [" ".join(html.unescape(re.sub(r"</?b>", "", x)).split()) for x in re.split(r"</?(?:p|h1|br)\s*/?>", body)]
        want = " ".join(x for x in parts if x)
        assert got[r.page_id].text == want and got[r.page_id].n_chars == len(want)


def test_odd_rows(spark):
    rows = [(1, "http://a/", None, "x", 1), (None, None, "<p>a", "x", 1), (2, "nonsense", "", "x", 1), (2, "nonsense", "", "x", 1), (3, "http://a/", "<p>b", "x", 1)]
    table = spark.createDataFrame(rows, "page_id bigint, url string, html string, text string, n_chars int")
    assert sorted((str(r.page_id), r.text, r.n_chars) for r in html_extract.extract(table).collect()) == [("1", "", 0), ("2", "", 0), ("2", "", 0), ("3", "b", 1), ("None", "a", 1)]
    assert html_extract.extract(table.limit(0)).count() == 0


def test_reposts_and_near_copies_keep_their_text(spark):
    marked = "<div>menu</div><article><h1>Headline {0}</h1><p>The same first paragraph of the story.</p><p>And the same second one.</p></article>"
    rows = [(i, "https://marked.example/", marked.format(i)) for i in range(6)]
    bare = marked.replace("article", "div")
    rows += [(100 + i, "https://bare.example/", bare.format(i)) for i in range(30)]
    # near copies: one paragraph of ten differs
    near = ["".join(f"<p>Paragraph {j} as {i if j == i % 10 else 'ever'} before.</p>" for j in range(10)) for i in range(40)]
    rows += [(200 + i, "https://near.example/", x) for i, x in enumerate(near)]
    # a site with reposts: its own furniture goes, the reposted text stays, and so does a text of one page in a noisy node
    story = "<div class=top>Welcome</div><div class=top>Open all day</div><div class=top>Call us</div><div class=body><p>{0}</p></div>"
    rows += [(300 + i, "https://site.example/", story.format(f"Story {i} as it was told by writer {i} that day")) for i in range(12)]
    rows += [(400 + i, "https://site.example/", story.format(f"Take {i}</p><p>A story that was told before, at length and in full")) for i in range(5)]
    rows += [(500, "https://site.example/", story.format("A story under a greeting of its own, told once").replace("Welcome", "Good evening"))]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string")
    got = {r.page_id: r.text for r in html_extract.extract(pages).collect()}
    both = "The same first paragraph of the story. And the same second one."
    assert all(got[i] == f"Headline {i} {both}" for i in range(6)) and all(got[100 + i] == f"menu Headline {i} {both}" for i in range(30))
    assert all(got[200 + i] == text(x) for i, x in enumerate(near))
    assert all(got[300 + i] == f"Story {i} as it was told by writer {i} that day" for i in range(12))
    assert all(got[400 + i] == f"Take {i} A story that was told before, at length and in full" for i in range(5))
    assert got[500] == "Good evening A story under a greeting of its own, told once"


def test_comments_go_at_any_share():
    many = "<p>comment text</p>" * 50
    assert text(f"<article><p>Body one.</p><section class='comments'>{many}</section></article>") == "Body one."
    assert text(f"<div><p>Body one.</p></div><div class='user-feedback'>{many}</div>") == "Body one."
    assert text(f"<article><div id=disqus_thread>{many}</div></article>") == ""
    # a name that tells a state is none; short furniture beside long comments is still furniture
    assert text(f"<div class='post comments-open'><p>Body one.</p><div class=comments>{many}</div></div>") == "Body one."
    assert text(f"<div class=sidebar>Latest</div><p>Body one, told here.</p><div class=comments>{many}</div>") == "Body one, told here."
    assert text("<ul class=links><li>Home<li>About</ul><p>Body one, told here.</p><p class=tags>a b</p>") == "Body one, told here."


def test_marks_without_an_end_lose_no_text():
    assert text("<p>a<!-- b<p>c") == "a b c" and text("<p>a<!-- <p>b</p> -->c<!--d") == "acd"
    assert text("<!--><p>a<!---><p>b<!-- x --!>c") == "a bc"
    assert text("<p>a < b <1> <?x?>c<!x>d</>e</1>f") == "a < b <1> cdef"
    assert text("<p>a<b") == "a<b" and text('<p>a<i title="x>b</i> c') == "ab c" and text('<p>a<i t=">" <b u=">"') == 'a" "'
    assert text("<p title=it's>a</p><p data-x='a>b' title=\"c>d\">e</p>") == "a e"
    assert text("<title>x<y</title><p>a<textarea>x<b</textarea>b<title>c") == "a b c" and text("<p>a<script>x") == "a"


def test_broken_and_deep_pages_take_linear_time_and_memory():
    import time
    import tracemalloc

    marks = ["<!--", "<![CDATA[", "<!x ", "<?", "<a ", "<a href=\"", "<a b=\">\"", "</a ", "<title>", "<b></p>", "<b></i>", "<center>", "<li>", "<ul><li>", "<td><b>x<br>", "<", "&#"]
    for mark in marks:
        started = time.process_time()
        assert "story" in text("<p>story</p>" + mark * 100_000), mark
        assert time.process_time() - started < 20, mark
    tracemalloc.start()
    assert text("<div class=a>" * 100_000 + "story") == "story"
    assert tracemalloc.get_traced_memory()[1] < 200_000_000
    tracemalloc.stop()


def test_whole_branches_inside_articles(spark):
    # only the tree can tell the words behind every article from the article
    page = "<nav>m</nav><article><h1>Title {0}</h1><p>What happened on day {0}, told by {0} people.</p>{1}</article>"
    outro = "<div class=outro><p>Thanks for reading</p><p>Write to us</p></div>"
    mixed = "<div class=outro><p>Thanks for reading</p><p>Story {0} goes on</p></div>"
    rows = [(i, "https://tells.example/", page.format(i, outro)) for i in range(8)]
    # a sentence said again among others isn't a branch, nor is one with something of its own
    rows += [(100 + i, "https://says.example/", page.format(i, "<p>As ever, all is well.</p>")) for i in range(8)]
    rows += [(200 + i, "https://mixes.example/", page.format(i, mixed.format(i))) for i in range(8)]
    # too few distinct pages
    rows += [(300 + i, "https://few.example/", page.format(i, outro)) for i in range(3)]
    rows += [(400 + i, "https://copies.example/", page.format(7, outro)) for i in range(12)]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string")
    assert html_extract.style_tree(html_extract.parsed(pages)).count() == 8
    got = {r.page_id: r.text for r in html_extract.extract(pages).collect()}
    for i, _, source in rows:
        told = text(source)
        assert got[i] == (told.removesuffix(" Thanks for reading Write to us") if i < 100 else told)


def by_hand(sources):
    """The texts of one host's pages, by the stated rule, in plain loops."""
    read = [html_extract._read(x) for x in sources]
    distinct = {tuple(blocks): (blocks, elements) for blocks, elements in read if blocks}
    texts = {p: {t for _, _, t in blocks} for p, (blocks, _) in distinct.items()}
    weight = {}
    for p, own in texts.items():
        n = {t: sum(t in x for x in texts.values()) for t in own}
        size = {t: len(t) / n[t] for t in own}
        common = [t for t in own if n[t] > 1]
        if sum(map(len, common)) >= 2 / 3 * sum(map(len, own)):
            weight[p] = sum(size[t] for t in common) / sum(map(len, common))
        else:
            weight[p] = sum(size.values()) / sum(map(len, own))
    contents, shown, pages, elements_on = {}, {}, {}, {}
    for p, (blocks, elements) in distinct.items():
        for node, t in {(node, t) for node, _, t in blocks}:
            contents[node, t] = contents.get((node, t), 0) + weight[p]
        for node in {node for node, _, _ in blocks}:
            pages[node] = pages.get(node, 0) + weight[p]
        for node, _, kind in elements:
            if blocks[0][1]:
                shown[node, kind] = shown.get((node, kind), 0) + weight[p]
                elements_on[node] = elements_on.get(node, 0) + weight[p]
    important, style = {}, {}
    for node, m in pages.items():
        if m >= html_extract.LEAST_PAGES:
            logs = [math.log(max(w, 1)) for (k, _), w in contents.items() if k == node]
            important[node] = 1 - sum(logs) / len(logs) / math.log(m)
    for node, m in elements_on.items():
        if m >= html_extract.LEAST_PAGES:
            style[node] = -sum(w / m * math.log(w / m, m) for (k, _), w in shown.items() if k == node)
    out = []
    for blocks, elements in read:

        def composite(node):
            inner = [composite(k) for k, above, _ in elements if above == node]
            values = [c for c, _ in inner]
            if node in {k for k, _, _ in blocks}:
                values.append(important.get(node, 1))
                if not inner:
                    return values[0], values[0] < 0.1
            held = 0.9 ** len(values)
            c = (1 - held) * style.get(node, 1) + held * sum(values) / len(values)
            return c, c < 0.1 and all(noise for _, noise in inner)

        kept = []
        for node, inside, t in blocks:
            noise = important.get(node, 1) < 0.35 and contents[node, t] >= 2
            if not (noise and (not inside or composite(node)[1])):
                kept.append(t)
        out.append(" ".join(kept))
    return out


def test_importance_by_hand_on_small_hosts(spark):
    rng = random.Random(8)
    rows = []
    for site in range(24):
        tops = [f"<div class=t{i}>{'<p>said on every page</p>' * rng.randint(0, 1)}<b>notice {rng.randint(0, 2)}</b></div>" for i in range(rng.randint(1, 4))]
        mark = rng.choice(["article", "div"])
        for i in range(rng.randint(2, 14)):
            own = "".join(f"<p>{' '.join(str(rng.randint(0, 999)) for _ in range(rng.choice((2, 12, 40))))}</p>" for _ in range(rng.randint(site % 3, 3)))
            around = [rng.choice(tops) if rng.random() < 0.3 else top for top in tops if rng.random() < 0.95]
            inner = f"<section class=s>{rng.choice(['<p>read on</p>', '<ul><li>read on', '<p>read on</p><p>or not</p>'])}</section>" if rng.random() < 0.9 else ""
            rows.append((len(rows), f"https://{site}.example/", f"<{mark}>{own}{''.join(around)}{inner}</{mark}>"))
    got = {r.page_id: r.text for r in html_extract.extract(spark.createDataFrame(rows, "page_id bigint, url string, html string").repartition(5)).collect()}
    changed = {"<article>": 0, "<div>": 0}
    for site in {r[1] for r in rows}:
        mine = [r for r in rows if r[1] == site]
        for (i, _, source), want in zip(mine, by_hand([r[2] for r in mine]), strict=True):
            assert got[i] == want, (site, source)
            changed[source[: source.index(">") + 1]] += want != text(source)
    assert min(changed.values()) > 5
