import html
import re
import time

from tessera.llm import html_text
from tessera.llm.html_text import extract, main_text


def article(page):
    inner = re.search(r"<article>(.*)</article>", page, re.S)[1]
    blocks = [re.sub(r"</?b>", "", b) for b in re.split(r"</?(?:p|h1)>", inner)]
    return "\n\n".join(x for x in (" ".join(html.unescape(re.sub(r"<[^>]*>", " ", b)).split()) for b in blocks) if x)


def test_every_page_gives_its_article(spark, sf_dir):
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    want = {r.page_id: article(r.html) for r in pages.collect()}
    got = {r.page_id: r for r in extract(pages.withColumn("text", pages.url)).collect()}
    assert {k: r.text for k, r in got.items()} == want
    assert all(r.n_chars == len(r.text) for r in got.values())


def test_odd_pages(spark):
    body = "".join(f"<p>Paragraph {i} has a good number of words in it.</p>" for i in range(4))
    text = "\n\n".join(f"Paragraph {i} has a good number of words in it." for i in range(4))
    cases = {
        None: "",
        "": "",
        "plain text only": "plain text only",
        "<html><body><nav><a href=x>Home</a></nav></body></html>": "",
        f"<div class='menu'><a href=1>One</a></div><div id=content>{body}</div><div class='sidebar'>{body}</div><footer>end</footer>": text,
        f"<header>Site</header><main>{body}<aside>aside</aside><p>&lt;Tail&gt;&nbsp;&amp;\n more</p></main><section class=comments><p>{'first! ' * 90}</p></section>": text + "\n\n<Tail> & more",
        f"<article><h1>T</h1>{body}<form><p>Your mail</p></form><div class='ad'>Buy</div><script>if (a<b) '</p>'</script><p>End.</p></article>": "T\n\n" + text + "\n\nEnd.",
        f"<p>unclosed <b>bold <article>{body}": text,
        "<<>> < a & b &amp; c <p": "<<>> < a & b & c <p",
    }
    for page, want in cases.items():
        assert main_text(page) == want, page
    frame = spark.createDataFrame([(i, "u", p, "t") for i, p in enumerate(cases)], "page_id long, url string, html string, text string")
    assert [r.text for r in extract(frame).orderBy("page_id").collect()] == list(cases.values())
    assert extract(frame.limit(0)).count() == 0


def test_long_page_is_kept_whole():
    page = "<article>" + "<p>word word word</p>" * 20_000 + "</article>"
    assert main_text(page).count("word word word") == 20_000


def test_page_without_a_main_element_keeps_the_text_around_adverts_and_links():
    parts = [f"Paragraph {i} has a good number of words in it." for i in range(4)]
    links = [f"Reference {i} of the list" for i in range(5)]
    p = [f"<p>{x}</p>" for x in parts]
    listed = "<ul>" + "".join(f"<li><a href=x>{x}</a></li>" for x in links) + "</ul>"
    for cut in ("<div class='ad'>Buy</div>", "<aside>Aside</aside>", "<form><p>Your mail</p></form>", "<div class=share>Share</div>"):
        for page in (
            f"<div id=content>{p[0]}{cut}{''.join(p[1:])}</div>",
            f"<body>{p[0]}{cut}{''.join(p[1:])}</body>",
            f"<body><div><div>{p[0]}</div>{cut}<div>{''.join(p[1:])}</div></div></body>",
            f"<div>{p[0]}{cut}{p[1]}{cut}{p[2]}{cut}{p[3]}</div>",
        ):
            assert main_text(page) == "\n\n".join(parts), page
    assert main_text(f"<div id=content>{p[0]}{p[1]}{listed}{p[2]}{p[3]}</div>") == "\n\n".join(parts[:2] + links + parts[2:])
    assert main_text(f"<body><div>{listed}</div><nav>Menu</nav><div id=content>{''.join(p)}</div><footer>End</footer></body>") == "\n\n".join(parts)


def test_wrappers_named_like_furniture_do_not_take_the_article_along():
    body = "".join(f"<p>Paragraph {i} has a good number of words in it.</p>" for i in range(4))
    text = "\n\n".join(f"Paragraph {i} has a good number of words in it." for i in range(4))
    for mark in ("id='content-sidebar-wrap'", "class='site no-sidebar'", "class='post has-comments'", "class='site sidebar'", "id=widget", "class='comments'"):
        assert main_text(f"<body><div {mark}><article>{body}</article><div class='menu side'>Side</div></div></body>") == text, mark
    for mark in ("id='content-sidebar-wrap'", "class='site no-sidebar'", "class='site sidebar'"):
        assert main_text(f"<body><div {mark}>{body}</div><div class='ad'>Buy</div></body>") == text, mark
    # Sections about the article still go, even where they hold articles or more text than it does.
    said = "<p>first! first! first!</p>" * 30
    assert main_text(f"<article>{body}<section class=related><article>Other</article></section></article>") == text
    assert main_text(f"<article>{body}</article><div class=comments><article class=comment>{said}</article></div>") == text
    assert main_text(f"<div id=content>{body}</div><div id=comments>{said}</div>") == text
    assert main_text(f"<article>{body}</article><div class=sidebar>{said}</div>") == text


BODY = [f"Paragraph {i} has a good number of words in it." for i in range(12)]
LONG = "".join(f"<p>{x}</p>" for x in BODY)
LONG_TEXT = "\n\n".join(BODY)


def test_all_articles_stay_and_teasers_made_of_links_go():
    one, two = f"<article>{LONG}</article>", f"<main>{LONG}</main>"
    teaser = "<article><h3><a href=x>Another one</a></h3><a href=x>Read more.</a></article>"
    assert main_text(f"<body>{one}<div>Between</div>{two}</body>") == LONG_TEXT + "\n\n" + LONG_TEXT
    assert main_text(f"<body>{one}<div>{teaser}{teaser}</div></body>") == LONG_TEXT
    assert main_text(f"<body>{one}<article><p>Short.</p></article></body>") == LONG_TEXT + "\n\nShort."
    assert main_text(f"<body><div>{LONG}</div><div><article><p>Read more.</p></article></div></body>") == LONG_TEXT + "\n\nRead more."
    assert main_text(f"<body>{teaser}</body>") == "Another one\n\nRead more."  # all that there is


def test_an_article_within_any_wrapper_stays():
    for name in ("form", "aside", "nav", "dialog", "header", "footer"):
        for mark in ("", " class=sidebar", " id=comments", " role=search"):
            assert main_text(f"<body><div>Menu</div><{name}{mark}><article>{LONG}</article></{name}><footer>End</footer></body>") == LONG_TEXT, (name, mark)
    assert main_text(f"<body><nav><a href=x>Home</a></nav><form id=aspnet><div>{LONG}</div></form></body>") == LONG_TEXT


def test_comments_adverts_and_sidebars_by_their_names():
    for mark in ("class=comment-list", "class=commentlist", "class=ad-slot", "class='sidebar-left wide'", "id=disqus_thread", "class=ad_box_2", "class=newsletter-form", "id=comments-section", "class=footer-nav"):
        said = f"<div {mark}><p>{'Something else that somebody said here. ' * 4}</p></div>"
        assert main_text(f"<article>{LONG}{said}</article>") == LONG_TEXT, mark
        assert main_text(f"<body><div id=content>{LONG}</div>{said}</body>") == LONG_TEXT, mark
    assert main_text(f"<body><div class=page-header>Site name and claim</div><div>{LONG}</div><div class=site-footer>Foot of the page</div></body>") == LONG_TEXT
    for mark in ("class=no-sidebar", "class=has-comments", "class=commentary", "class=additional", "class=headerless", "class=administration"):
        assert main_text(f"<article><div {mark}>{LONG}</div></article>") == LONG_TEXT, mark


def test_names_that_ordinary_sections_have_too():
    prose = "A section on how people live together, which is longer than a row of buttons would ever be."
    for mark in ("social", "related", "side", "share-block", "widget"):
        assert main_text(f"<article>{LONG}<section class={mark}><p>{prose}</p></section></article>") == LONG_TEXT + "\n\n" + prose, mark
        assert main_text(f"<article>{LONG}<p class={mark}>{prose}</p></article>") == LONG_TEXT + "\n\n" + prose, mark
        assert main_text(f"<article>{LONG}<div class={mark}><a href=x>{prose}</a><span>Share</span></div></article>") == LONG_TEXT, mark


def test_menus_in_cells_and_at_the_ends_of_articles():
    for menu in ("Home<br>About<br>Contact", "<p>Home</p><p>About</p><p>Contact</p>", "<a href=1>Home</a> <a href=2>About</a>"):
        assert main_text(f"<table><tr><td>{menu}</td><td>{LONG}</td></tr></table>") == LONG_TEXT, menu
        assert main_text(f"<table><tr><td>{LONG}</td><td>{menu}</td></tr></table>") == LONG_TEXT, menu
    links = "".join(f"<li><a href={i}>Link {i}</a></li>" for i in range(5))
    listed = "\n\n".join(f"Link {i}" for i in range(5))
    assert main_text(f"<article><ul>{links}</ul><h1><a href=x>Title</a></h1>{LONG}<ul>{links}</ul></article>") == "Title\n\n" + LONG_TEXT
    assert main_text(f"<article><h1>Title</h1>{LONG}<ul>{links}</ul>{LONG}</article>") == f"Title\n\n{LONG_TEXT}\n\n{listed}\n\n{LONG_TEXT}"
    assert main_text(f"<article>{LONG}<p><a href=x>Source</a></p></article>") == LONG_TEXT + "\n\nSource"


def test_without_names_the_distribution_finds_the_same_articles(spark, sf_dir, monkeypatch):
    pages = [r.html for r in spark.read.parquet(f"{sf_dir}/pages.parquet").collect()]
    bare = [re.sub("<(/?)(?:article|nav)>", r"<\1div>", p) for p in pages]
    assert [main_text(p) for p in bare] == [article(p) for p in pages]
    monkeypatch.setattr(html_text, "stretches", lambda weight: [(0, len(weight), sum(weight))])
    assert all(main_text(b) != article(p) for b, p in zip(bare, pages, strict=True))


def test_broken_markup_is_read_in_linear_time():
    begun = time.process_time()
    for piece in ("<a ", '<a "', "<title>", "<![CDATA[", "<!", "<!--", "</", '<a ">" ', "<svg><p>", "<div class=", "<p>x"):
        main_text(piece * (1_000_000 // len(piece)))
        main_text("<article><p>text</p>" + piece * 20_000 + "</article>")
    assert time.process_time() - begun < 120
    assert main_text('<article><p>one</p><a href="x>two</a><p>three</p></article>').startswith("one")
