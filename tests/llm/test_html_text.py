"""Main text of pages: what belongs to the article stays, furniture goes."""

import html
import random
import time

from tonemill.llm import html_text

LONG = "This sentence is long enough to count as prose, it has commas, and it says more than a caption does. "


def lines(page):
    return html_text.main_text(page).split("\n")


def test_all_sections_of_an_article_stay():
    big = "".join(f"<p>{LONG * 3}{i}</p>" for i in range(15))
    page = f"<body><article><h1>Title</h1><section>{big}</section><section><h2>Short</h2><p>Six.</p><p>Words, only.</p><blockquote>Quoted.</blockquote><pre>code</pre></section></article><div>elsewhere</div></body>"
    got = lines(page)
    assert got[0] == "Title" and got[-5:] == ["Short", "Six.", "Words, only.", "Quoted.", "code"] and len(got) == 21


def test_heading_beside_the_content_wrapper_stays():
    for tag in ("article", "main", "div"):
        page = f"<body><{tag}><h1>Title</h1><div class=entry-content><p>{LONG}</p><p>{LONG}</p></div><p>End.</p></{tag}></body>"
        assert lines(page) == ["Title", LONG.strip(), LONG.strip(), "End."]


def test_text_over_several_wrappers_stays():
    part = lambda n: f"<div><div><h2>Part {n}</h2><p>{LONG * 2}</p><p>{LONG * 2}</p></div></div>"
    got = lines(f"<body><div id=x>{part(1)}{part(2)}<h3>Between</h3>{part(3)}</div></body>")
    assert [x for x in got if len(x) < 20] == ["Part 1", "Part 2", "Between", "Part 3"] and len(got) == 10


def test_wrappers_that_name_furniture_as_well_as_content_stay():
    for names in ("content has-sidebar", "no-sidebar", "with-comments page", "post sponsored", "content-with-sidebar", "noSidebar entry-content", "main header-fixed"):
        assert lines(f'<body><div class="{names}"><h1>Title</h1><p>{LONG}</p></div></body>') == ["Title", LONG.strip()], names


def test_furniture_goes():
    menu = "<ul><li><a href=a>First page</a><li><a href=b>Second page</a><li><a href=c>Third page</a></ul>"
    for junk in ("<div class=sidebar><p>Junk.</p></div>", "<div class=post-footer>Junk.</div>", '<div class="widget widget_text"><p>Junk.</p></div>', "<nav>Junk</nav>", menu):
        page = f"<body><article><h1>Title</h1>{junk}<div class=content><p>{LONG}</p></div></article></body>"
        assert lines(page) == ["Title", LONG.strip()], junk


def test_links_within_the_text_stay():
    refs = "<ul><li><a href=a>First source</a><li><a href=b>Second source</a><li><a href=c>Third source</a></ul>"
    assert lines(f"<body><article><p>{LONG * 3}</p><p>{LONG * 3}</p>{refs}</article></body>")[2:] == ["First source", "Second source", "Third source"]


def test_time_grows_with_the_length():
    for piece in ('<a title="x', "<a title='x", "<a title=\"x>", "<p class=a", "<!--", "<svg>x", "<noscript>", "<b a=b", "&lt;<", "<a b='c\"d", "</x", "<div><p>t"):
        began = time.perf_counter()
        html_text.main_text(f"<p>{LONG}</p>" + piece * (1_000_000 // len(piece)))
        assert time.perf_counter() - began < 20, piece
    began = time.perf_counter()
    assert html_text.main_text('<a title="x' * 90_000) == "" and time.perf_counter() - began < 2


def test_unclosed_quotes_end_with_their_tag():
    assert lines('<p>one <a title="foo>two</p><p>three</p>') == ["one two", "three"]
    assert lines("<p>one <a title='>' class=\"b>c\" x=y/>two</p>") == ["one two"]
    assert lines("<p>a < b, a <3 and a<<b>c</b> <!-- no --> d") == ["a < b, a <3 and a<c d"]
    assert lines("<p>whole</p><p>cut <a href='x") == ["whole", "cut"]
    assert lines("<p>one</p><noscript><p>two</p><svg>three") == ["one", "two", "three"]
    assert lines("<p>one</p><SCRIPT>if (a<b) '</p>'</sCript ><p>two<style>p{}") == ["one", "two"]


def test_loose_text_between_containers_stays():
    page = f"<body><div id=x><div><p>{LONG * 2}</p></div>loose text<div><p>{LONG}</p></div>more <b>loose</b> text</div></body>"
    assert lines(page) == [(LONG * 2).strip(), "loose text", LONG.strip(), "more loose text"]


def test_wrappers_with_names_of_widgets_stay():
    for names in ("widget-wrap", "overflow-hidden", "share-page", "meta", "respond"):
        page = f'<body><div class="{names}"><h1>Title</h1><p>{LONG * 4}</p></div><div class=widget><p>Junk.</p></div></body>'
        want = [] if names == "respond" else ["Title", (LONG * 4).strip()]
        assert [x for x in lines(page) if x] in (want, ["Junk."]), names
    assert lines(f"<body><div class=comments><p>{LONG * 9}</p></div><article><p>{LONG}</p></article></body>") == [LONG.strip()]


def test_names_of_an_articles_own_elements_cut_nothing():
    for tag in ("article", "main"):
        for piece in ("<p class=cookie-recipe>Kept.</p>", "<p class=menu-item>Kept.</p>", "<p class=comment>Kept.</p>", "<div class=hero-banner>Kept.</div>", "<p class=share>Kept.</p>", "<div class=tags>Kept.</div>", "<div class=menu><p>Kept.</p></div>", "<p class=byline>Kept.</p>", "<p><span class=meta>Kept.</span></p>", "<p><math><mi>Ke</mi><mo>pt</mo><annotation>x</annotation></math>.</p>"):
            page = f"<body><{tag}><h1>Title</h1><p>{LONG}</p>{piece}<p>{LONG}</p></{tag}></body>"
            assert lines(page) == ["Title", LONG.strip(), "Kept.", LONG.strip()], piece


def test_furniture_inside_an_article_goes():
    link = "<a href=x>A longer link</a> "
    for junk in ("<div id=comments><p>Junk.</p></div>", "<section class=comment-list><article class=comment><p>Junk, junk, junk.</p></article></section>", "<article class=comment><p>Junk.</p></article>", "<div class=cookie-notice>Junk.</div>", "<p class=ad>Junk.</p>", "<div class=ad-slot>Junk.</div>", f"<div class=share>Share: {link * 2}</div>", f"<div class=menu>{link * 3}</div>", f"<ul class=tags><li>{link}<li>{link}</ul>", "<div class=newsletter-signup><p>Junk.</p></div>", "<aside>Junk.</aside>", "<form>Junk.</form>"):
        page = f"<body><article><h1>Title</h1><p>{LONG}</p>{junk}<p>{LONG}</p></article></body>"
        assert lines(page) == ["Title", LONG.strip(), LONG.strip()], junk


def test_comments_and_menus_around_a_page_without_an_article_go():
    menu = "".join(f"<li><a href={i}>Page number {i}</a>" for i in range(30))
    talk = "".join(f"<article class=comment><p>{LONG}</p></article>" for _ in range(20))
    for comments in (f"<div class=comments>{talk}</div>", f"<section id=comments>{talk}</section>", f"<ol class=comment-list>{talk}</ol>"):
        page = f"<body><ul>{menu}</ul><div id=c><h1>Title</h1><p>{LONG}</p><p>{LONG}</p></div>{comments}</body>"
        assert lines(page) == ["Title", LONG.strip(), LONG.strip()]


def test_scores_equal_sums_over_all_paragraphs():
    """A container's worth, from each paragraph below it and how far up it is."""
    rng = random.Random(4)
    for _ in range(60):
        root = html_text.parse(generated(rng)[0])
        got = {id(n): w for n, w in html_text.worths(root)}
        every = [root]
        for n in every:
            every.extend(c for c in n.children if isinstance(c, html_text.Node))

        def strings(n, link=False):
            link = link or n.tag == "a"
            return [x for c in n.children for x in ([(c, link)] if isinstance(c, str) else strings(c, link))]

        def size(n):
            return sum(len(x.strip()) for x, _ in strings(n))

        want = {}
        for n in every:
            own = any(isinstance(c, str) and len(c.strip()) > 25 for c in n.children)
            if not size(n) or not (n.tag in html_text.PARAGRAPHS or (own and n.tag in ("div", "section", "article", "main", "body"))):
                continue
            points = 1 + sum(x.count(",") for x, _ in strings(n)) + min(size(n) / 100, 3)
            chain = html_text._above(n)[n.tag in html_text.PARAGRAPHS :][:5]
            for far, up in enumerate(chain):
                if up.tag == "#root":
                    break
                want.setdefault(id(up), [up, 25.0 if up.good else 5.0 if up.tag in ("div", "section") else 0.01])
                want[id(up)][1] += points * (1.0 if far == 0 else 1 / (2 * far))
        assert got.keys() == want.keys()
        for key, (n, points) in want.items():
            linked = sum(len(x.strip()) for x, link in strings(n) if link)
            assert abs(got[key] - points * (1 - linked / max(size(n), 1))) < 1e-9


def test_a_very_long_page_is_read_whole():
    page = "<body><article>" + "".join(f"<p>{LONG}{i}</p>" for i in range(20_000)) + "</article></body>"
    got = lines(page)
    assert len(got) == 20_000 and got[-1] == LONG + "19999"


def generated(rng):
    """A page and the blocks of its article."""
    word = lambda: rng.choice(["of", "the", "sand", "tide,", "r&amp;d", "&eacute;t&eacute;", "&#8211;", "a&nbsp;b", "naïve"])
    prose = lambda n: " ".join(word() for _ in range(n))
    parts, want = [], []
    for _ in range(rng.randrange(3, 12)):
        tag, n = rng.choice([("p", 40), ("p", 80), ("p", 5), ("h2", 4), ("blockquote", 20), ("pre", 6), ("li", 12)])
        text = prose(n)
        want.append(" ".join(html.unescape(text).split()))
        inner = text.replace("tide,", rng.choice(["<b>tide,</b>", "<a href='/x'>tide,</a>", "tide,"]))
        parts.append(f"<ul><li>{inner}</ul>" if tag == "li" else f"<{tag} class='x y'>{inner}</{tag}>")
    body = "\n".join(parts)
    for _ in range(rng.randrange(3)):
        body = f"<{(t := rng.choice(['div', 'section']))} id=w{rng.randrange(9)}>{body}</{t}>"
    if rng.random() < 0.7:
        body = f"<{(t := rng.choice(['article', 'main']))}>{body}</{t}>"
    junk = ["<nav><ul><li><a href=/a>A</a><li><a href=/b>B</a></ul></nav>", "<div class='ad'>Buy, buy, buy.</div>", "<aside><p>Side, bar.</p></aside>", "<div id=comments><h3>2 comments</h3><p>I, too, like it very much, thank you.</p></div>", "<div class='sidebar-right'><p>Side, text.</p></div>", "<form><label>Mail</label><input></form>", "<script>var a = '<p>no</p>';</script>", "<!-- <p>no</p> -->", "<div class=cookie-notice>We use cookies, of course.</div>"]
    before, after = (" ".join(rng.sample(junk, rng.randrange(4))) for _ in range(2))
    return f"<!DOCTYPE html><html><head><title>T</title><style>p{{}}</style></head><body><header><p>Site</p></header>{before}{body}{after}<footer>&copy; Us</footer></body></html>", want


def test_generated_pages(spark):
    rng = random.Random(6)
    pages = [generated(rng) for _ in range(300)]
    rows = [(i, f"u{i}", page, i) for i, (page, _) in enumerate(pages)] + [(900, None, None, 1), (900, None, None, 1), (None, "u", "", 1), (901, "u", "   \n", 1)]
    out = html_text.extract(spark.createDataFrame(rows, "page_id long, url string, html string, text int"))
    assert out.columns == ["page_id", "url", "text", "n_chars"]
    got = out.collect()
    by = {r["page_id"]: r["text"] for r in got}
    right = sum(by[i].split("\n") == want for i, (_, want) in enumerate(pages))
    assert right >= 0.97 * len(pages)
    assert len(got) == len(rows) and by[900] == by[None] == by[901] == "" and all(r["n_chars"] == len(r["text"]) for r in got)


def test_no_pages(spark):
    assert html_text.extract(spark.createDataFrame([], "page_id int, url string, html string")).collect() == []
