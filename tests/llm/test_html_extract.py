import random
import time

from tidemark.llm.html_extract import SURGE, WINDOW, between_surge_and_dive, extract, lines_of, main_text

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{x}</style><script>var t="</p>";</script></head><body>
<nav><ul><li><a href="/x">menu</a></li></ul></nav><!-- ad <p>no</p> --><div class="ad">Buy a lot of things now.</div>
<article><h1>Head &amp; line</h1><p><b>First  para&shy;graph.<br><p>Second&nbsp;one</p><p>x</p><div class="comments"><p>Reader said</p></div>
<aside>side</aside><ul><li>item <a href="#">link</a></li></ul></article><footer>&copy; foot</footer></body></html>"""


def test_article():
    assert main_text(PAGE) == "Head & line First para\xadgraph. Second one x item link"


def test_without_article_the_distribution_decides():
    body = "".join(f"<p>{'long text here ' * 12}{i}</p>" for i in range(4))
    page = f'<div class="menu">a b c</div><p><a href="/">home</a></p><p><a>about</a></p><p><a>more</a></p><h2>Title</h2>{body}<div id="cookie-notice">accept all of these cookies please</div><form>search</form><p><a>next</a></p>'
    got = main_text(page)
    assert got.startswith("Title long text here") and got.endswith("here 3") and "cookies" not in got and "home" not in got
    assert main_text("<p>short</p>") == "short" and main_text("plain text") == "plain text"


def test_header_in_article_stays():
    assert main_text("<header>site</header><article><header><h1>Title</h1></header><p>text</p></article>") == "Title text"


def test_broken_markup():
    for page in ("<", "<p", "<!--", "<script>x", "<a href='", "</p></p>", "<p><p><p>", "a < b > c", "<b>" * 3000 + "x", "<p>" * 3000 + "x"):
        assert isinstance(main_text(page), str)
    assert main_text("<article><p>one<p>two") == "one two" and main_text("<b>" * 3000 + "x") == "x"


def test_rows(spark):
    rows = [(1, "u", PAGE), (2, None, None), (3, "v", ""), (3, "v", ""), (4, "w", "<article><p>" + "word " * 100_000 + "</p></article>")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r["page_id"]: r for r in extract(df).collect()}
    assert got[1]["n_chars"] == len(main_text(PAGE)) and got[2]["text"] == got[3]["text"] == "" and got[4]["n_chars"] == 499_999 and extract(df).count() == 5
    assert extract(df.limit(0)).count() == 0
    assert extract(df.withColumnRenamed("url", "text")).columns == ["page_id", "text", "n_chars"]


def brute_kept(weights):
    """Straight from the rule: surges, what leads to them, dives."""
    n = len(weights)
    total = lambda i: sum(w for k, w in enumerate(weights) if i <= k < i + WINDOW)
    least = min(SURGE, max((total(i) for i in range(n)), default=0))
    inside = set()
    for i in range(n):
        if total(i) >= least > 0:
            k = i
            while k < n and total(k) > 0:
                inside.add(k)
                k += 1
            k = i - 1
            while k >= 0 and weights[k] > 0:
                inside.add(k)
                k -= 1
    return [i in inside and weights[i] > 0 for i in range(n)]


def test_surge_and_dive_against_brute_force():
    r = random.Random(4)
    for _ in range(3000):
        weights = [r.choice([0, 0, 0, 1, 5, 30, 79, 80, 200]) for _ in range(r.randrange(0, 25))]
        assert between_surge_and_dive(weights) == brute_kept(weights), weights


def test_names_count_as_whole_tokens():
    for name in ('class="social-history"', 'class="sharing-economy"', 'id="comments-on-the-law"', 'class="addendum"'):
        assert main_text(f"<article><h1>T</h1><div {name}><p>Stays here.</p></div></article>") == "T Stays here."
    assert main_text('<article><h2 class="menu">Menu of the day</h2><p>Soup.</p></article>') == "Menu of the day Soup."
    for name in ('class="comment-list"', 'id="cookie-notice"', 'class="x ad-1"', 'class="site-nav"', 'role="navigation"'):
        assert main_text(f"<article><h1>T</h1><div {name}><p>Goes away.</p></div><p>Stays.</p></article>") == "T Stays."


def test_the_distribution_decides_inside_articles_too():
    links = "".join(f'<li><a href="/{i}">link {i}</a></li>' for i in range(5))
    assert main_text(f"<article><h1>T</h1><p>One.</p><ul>{links}</ul><p>Two.</p></article>") == "T One. Two."
    assert main_text('<article><p>One.</p><p><a href="/">source</a></p><p>Two.</p></article>') == "One. source Two."
    far = "long text outside " * 60
    assert main_text(f"<article><p>In.</p></article><p>Buy.</p><nav>n</nav><p>{far}</p>").endswith("outside") and "Buy" not in main_text(f"<article><p>In.</p></article><p>Buy.</p><nav>n</nav><p>{far}</p>")


def test_short_lines_before_the_surge_stay():
    body = "".join(f"<p>{'long text here ' * 12}{i}</p>" for i in range(3))
    assert main_text(f"<header>site</header><p>Short.</p><p>Also short.</p>{body}").startswith("Short. Also short. long")


def test_hostile_pages_are_linear():
    n = 200_000
    pages = ["<a " * n, "<a \"" * n + ">", "<a '>\"" * n, "<" * n, "<!--" * n, "<!" * n, "<i><div>" + "<b>" * n + "</i>" * n, "<div>" + "<b>" * n + "<p></p>" * n, "<script " * n + ">", "</x>" * n, "<div>" * n + "</p>" * n, "&amp" * n, "<p class='" + "ad " * n + "'>x"]
    for page in pages:
        began = time.time()
        assert isinstance(main_text(page), str)
        assert time.time() - began < 5, page[:20]


def test_surge_and_dive_end_and_begin_text_inside_articles():
    links = "".join(f'<li><a href="/{i}">link {i}</a></li>' for i in range(4))
    long = "<p>" + "A sentence of the article. " * 12 + "</p>"
    residue = main_text(f"<article>{long}<ul>{links}</ul><div>Print</div><ul>{links}</ul><p>The article goes on after the lists.</p></article>")
    assert residue.endswith("The article goes on after the lists.") and "Print" not in residue and "link" not in residue
    # Where the page names no article, the distribution alone finds it.
    div = main_text(f"<div>Skip</div><ul>{links}</ul><div><h1>T</h1>{long}<p>Short.</p>{long}</div><ul>{links}</ul><div>Imprint</div>")
    assert div.startswith("T A sentence") and "Short." in div and "Imprint" not in div and "Skip" not in div


def test_pages_whose_article_has_no_name(spark):
    """All pages with their article as a plain block: surge and dive find the same text on nearly all of them."""
    pages = [r["html"] for r in spark.read.parquet("/root/testdata/sf0.01/pages.parquet").collect() if r["html"]]
    plain = [p.replace("<article>", "<div>").replace("</article>", "</div>") for p in pages]
    changed = sum(a != b for a, b in zip(pages, plain, strict=True))
    same = sum(main_text(a) == main_text(b) for a, b in zip(pages, plain, strict=True))
    none = sum(not any(between_surge_and_dive([0] * len(lines_of(p)))) for p in plain)
    assert changed == none == len(pages) and same >= 0.95 * len(pages), (same, len(pages))


def test_comments_and_adverts_by_compound_names_go_and_linked_paragraphs_stay():
    for name in ('class="user-comment"', 'id="responses"', 'class="article-ad"', 'class="reader-comments"', 'class="story-comments"', 'id="ad-slot-1"', 'class="comment-list"', 'class="related-articles"'):
        assert main_text(f"<article><h1>Title</h1><p>The text stays here.</p><div {name}><p>Goes away now.</p></div></article>") == "Title The text stays here.", name
    for name in ('class="article-body"', 'class="story"', 'class="entry-content"', 'class="article-header"', 'class="post"', 'class="user-guide"', 'class="response-time"'):
        assert "Stays here." in main_text(f"<article><h1>Title</h1><div {name}><p>Stays here.</p></div></article>"), name
    linked = "".join(f'<p><a href="/{i}">A paragraph that is a link, number {i}.</a></p>' for i in range(4))
    assert main_text(f"<article><p>One.</p>{linked}<p>Two.</p></article>").count("number") == 4
    assert main_text("<article><p>Body of it.</p><p>Copyright 2024 Someone</p></article>") == "Body of it."
    assert main_text("<article><p>Body of it.</p><p>Copyright law changed.</p></article>").endswith("changed.")
