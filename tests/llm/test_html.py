import random
import time

import numpy as np
import pytest

from gridloom.llm import html_text as ht

LONG = [f"Paragraph {i} with a good number of words so that it is content of the page." for i in range(6)]
BODY = "".join(f"<p>{t}</p>" for t in LONG)
MENU = "".join(f"<li><a href=/{w}>{w}</a></li>" for w in "home news sport shop about".split())

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var a="</p><p>no";</script></head><body>
<nav><ul><li><a href=/>Home</a><li>News</ul></nav><!-- c --><div class="ad">Buy now, a long advert with plenty of words in it, really.</div>
<div id="cookie-notice"><p>We use cookies and a long explanation of what they do for you on this site.</p></div>
<main><article><h1>Title &amp; more</h1><p>First   <b>paragraph
with</b> bold&nbsp;text &#233; and <a href=x>links</a>.<br>Next line<p>Is.<div class=share>Share this</div><ul><li>one<li>two</ul>
<form><p>Leave a reply</p><textarea>x</textarea></form><blockquote>Quote of some length to be kept.</blockquote></article>
<section class="comments"><p>Reader: a long comment that is not part of the article at all, however long it gets.</p></section></main>
<aside><p>Sidebar text of some length that isn't content.</p></aside><footer>&copy; me</footer></body></html>"""


def test_article_only():
    assert ht.main_text(PAGE).split("\n\n") == ["Title & more", "First paragraph with bold text é and links. Next line", "Is.", "one", "two", "Quote of some length to be kept."]


def test_cut_and_plain_pages():
    cut = PAGE[: PAGE.index("</article>")]
    assert ht.main_text(cut) == ht.main_text(PAGE)
    assert ht.main_text("just words") == "just words"
    assert ht.main_text("") == ht.main_text("<html><body></body></html>") == ht.main_text("<nav>x</nav>") == ""
    assert ht.main_text("<p>a &lt;b&gt; &unknown; &#x1F642;</p><p>c") == "a <b> &unknown; 🙂\n\nc"


def test_page_without_article_tag():
    body = "".join(f"<p>Paragraph {i} with a good number of words so that it is content.</p>" for i in range(6))
    page = f"<body><div class='nav'><a>a</a><a>b</a></div><div class='menu-bar'><ul><li>x</ul></div><div><h2>Head</h2>{body}</div><div class='footer'>foot</div></body>"
    assert ht.main_text(page).split("\n\n")[0] == "Head"
    assert len(ht.main_text(page).split("\n\n")) == 7


def test_nothing_beside_the_largest_region_is_lost():
    long = "".join(f"<p>Paragraph {i} with a good number of words so that it is content.</p>" for i in range(12))
    close = "A closing paragraph of words that belongs to the post as well as the rest."
    post = ht.main_text(f"<body><div class=post><h1>Title</h1><div class=entry>{long}</div><p>{close}</p></div></body>").split("\n\n")
    assert post[0] == "Title" and post[-1] == close and len(post) == 14
    lead = ht.main_text(f"<body><main><p>{close}</p><article>{long}</article></main></body>").split("\n\n")
    assert lead[0] == close and len(lead) == 13
    two = ht.main_text(f"<body><main><article>{long}</article><article><p>{close}</p></article></main></body>").split("\n\n")
    assert two[-1] == close and len(two) == 13


def test_frames(spark):
    rows = [(1, "u", PAGE), (1, "u", PAGE), (2, None, None), (None, "v", "")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "1 as text", "2 as extra")
    got = ht.extract(df).collect()
    assert sorted((r.page_id or 0, r.n_chars, r.extra) for r in got) == sorted([(1, len(ht.main_text(PAGE)), 2)] * 2 + [(2, 0, 2), (0, 0, 2)])
    assert ht.extract(df.limit(0)).count() == 0


def test_testdata_pages(spark, sf):
    for r in ht.op6_html_text(spark, sf).collect():
        assert r.n_chars == len(r.text) and "<" not in r.text.replace("< ", "")


@pytest.mark.parametrize("cls", ["page with-sidebar", "layout no-sidebar", "has-header", "sidebar-layout", "sidebar", "nav", "header-fixed wrap"])
def test_layout_classes_keep_the_article(cls):
    assert ht.main_text(f'<div class="{cls}"><article><h1>T</h1>{BODY}</article><div class=sidebar><p>other words here</p></div></div>').split("\n\n") == ["T", *LONG]
    assert ht.main_text(f'<body><div class="{cls}"><div><h1>T</h1>{BODY}</div></div></body>').split("\n\n") == ["T", *LONG]


def test_menus_forms_and_headers_around_an_article():
    assert ht.main_text(f"<nav><ul>{MENU}</ul><article>{BODY}</article>").split("\n\n") == LONG
    assert ht.main_text(f"<form action=/x><div><ul>{MENU}</ul>{BODY}</div></form>").split("\n\n") == LONG
    assert ht.main_text(f"<nav><ul>{MENU}</ul><div>{BODY}</div>").split("\n\n") == LONG
    assert ht.main_text(f"<header><h1>Site</h1></header><article><header><h1>T</h1></header>{BODY}<footer>tags</footer></article>").split("\n\n") == ["T", *LONG]
    assert ht.main_text(f"<aside>{BODY}</aside>").split("\n\n") == LONG


def test_comments_and_teasers_stay_hidden_however_long():
    comments = "".join(f"<article class=comment><p>Reader {i} has a long opinion about all of this and more.</p></article>" for i in range(40))
    assert ht.main_text(f"<article>{BODY}</article><section id=comments>{comments}</section>").split("\n\n") == LONG
    assert ht.main_text(f"<article><p>One short sentence.</p></article><footer>{BODY}</footer>") == "One short sentence."
    assert ht.main_text(f"<main>{BODY}</main><div class=related><article><p>Read this too</p></article></div>").split("\n\n") == LONG


def test_two_articles_of_one_size_stay():
    got = ht.main_text(f"<body><article>{BODY}</article><article>{BODY}</article></body>").split("\n\n")
    assert got == LONG * 2


def test_clusters_decide_about_links_without_a_name(monkeypatch):
    page = f"<body><div><ul>{MENU}</ul></div><div><h1>Head</h1>{BODY}<ul><li>plain item<li>another</ul></div><div>{MENU}</div></body>"
    want = ["Head", *LONG, "plain item", "another"]
    assert ht.main_text(page).split("\n\n") == want
    same = f"<body><div><ul>{MENU}</ul><h1>Head</h1>{BODY}<ul><li>plain item<li>another</ul></div></body>"
    assert ht.main_text(same).split("\n\n") == want
    references = f"<article>{BODY}<ul><li><a href=x>Reference one</a></ul></article>"
    assert ht.main_text(references).split("\n\n") == [*LONG, "Reference one"]
    monkeypatch.setattr(ht, "content_lines", lambda ratios: np.ones(len(ratios), bool))
    assert ht.main_text(page).split("\n\n") != want and ht.main_text(same).split("\n\n") != want


def test_clustering_by_definition():
    rng = random.Random(2)
    for _ in range(50):
        ratios = [rng.choice([1.0, 3.0, 40.0, 200.0]) * rng.random() for _ in range(rng.randrange(1, 30))]
        smooth = []
        for i in range(len(ratios)):
            near = [(np.exp(-0.5 * d * d), ratios[i + d]) for d in range(-3, 4) if 0 <= i + d < len(ratios)]
            smooth.append(sum(w * x for w, x in near) / sum(w for w, _ in near))
        cut = sum(smooth) / len(smooth)
        for _ in range(20):
            high, low = [x for x in smooth if x >= cut], [x for x in smooth if x < cut]
            if not low:
                break
            new = (sum(high) / len(high) + sum(low) / len(low)) / 2
            if abs(new - cut) < 1e-9:
                break
            cut = new
        got = ht.content_lines(np.array(ratios))
        assert all(g == (x >= cut) or abs(x - cut) < 1e-9 for g, x in zip(got.tolist(), smooth))


def test_malformed_markup():
    assert ht.main_text("<p>a</p><![foo[ x ]]><p>b</p>") == "a\n\nb"
    assert ht.main_text("<p>a</p><![CDATA[x]]><!-->b<!--->c<!-- d --><?php e ?><!ELEMENT f><p>g") == "a\n\nbc\n\ng"
    assert ht.main_text("<p>a</p><!-- never closed <p>b</p>") == "a"
    assert ht.main_text("<p>a < b && c</p><p>d</p><a href='x") == "a < b && c\n\nd"
    assert ht.main_text("<p>a &#xD800; &#0; &#x110000; &nosuch;</p>") is not None
    assert ht.main_text("</p></div>text</article>") == "text"


def test_cut_and_shuffled_pages_never_fail():
    rng = random.Random(1)
    tokens = ["<", ">", "<!", "<![", "<!--", "-->", "</", "<a href=", "'", '"', "<p", "<p>", "</p>", "<b>", "</b>", "<script>", "</script>", "<style>", "&#", "&amp", "text ", "<nav>", "<article>", "<?", "]]>", "\x00", "é🙂", "<svg/>", "<br/>", "<div class='with-sidebar'>", "</div>"]
    for k in range(0, len(PAGE), 7):
        ht.main_text(PAGE[:k])
        ht.main_text(PAGE[k:])
    for _ in range(3000):
        ht.main_text("".join(rng.choice(tokens) for _ in range(rng.randrange(1, 30))))


@pytest.mark.parametrize("part", ["<b>", "<b>x<p>y</p>", "<div>x", "<p><b>x</i>", "<!--", "<!", "</a", "<a b='", "<a <", "<![x[", "&", "<?", "<li>x", "<script>", "<span class=ad>", "<nav>x", "<article>x", "a&#", "<p>x<table>"])
def test_time_grows_with_the_length(part):
    took = []
    for n in (4_000, 32_000):
        began = time.process_time()
        ht.main_text(part * n)
        took.append(time.process_time() - began)
    assert took[1] < 30 * max(took[0], 0.02), took


@pytest.mark.parametrize(
    "part",
    ['<h2 id="related-work">Head</h2>', '<h2 id="share-prices">Head</h2>', '<h2 id="search" class="sidebar">Head</h2>']
    + [f'<{t} class="{c}"><p>{LONG[0]}</p></{t}>' for t, c in [("section", "social-history"), ("div", "ad-hoc"), ("div", "side-by-side"), ("div", "recipe cookies"), ("div", "search"), ("div", "shareholders"), ("div", "header-image-story")]]
    + [f'<p class="adrift notice-of-death">{LONG[0]}</p>', f'<p id="menu">{LONG[0]}</p>'],
)
def test_names_that_only_look_like_boilerplate(part):
    shown = ht.main_text(part).split("\n\n")[-1] if 'class="ad-hoc"' in part else "Head" if "Head" in part else LONG[0]
    assert ht.main_text(f"<article>{BODY}{part}</article>").split("\n\n") == [*LONG, shown]


@pytest.mark.parametrize("name", ["ad", "ad-slot", "google ads", "advertTop", "comments", "comment-list", "sponsored_box2"])
def test_adverts_and_comments_hide_in_an_article_at_any_length(name):
    assert ht.main_text(f"<article>{BODY}<div class='{name}'><p>{LONG[0]}</p></div></article>").split("\n\n") == LONG


@pytest.mark.parametrize("name", ["share", "share-buttons", "socialLinks", "related", "breadcrumbs", "newsletter", "pager2"])
def test_named_parts_of_an_article_go_if_they_hold_links_or_little(name):
    teaser = "".join(f"<li><a href=/{k}>{t} And on.</a></li>" for k, t in enumerate(LONG))
    for inner in ("Share this", f"<ul>{teaser}</ul>"):
        assert ht.main_text(f"<article>{BODY}<div class='{name}'>{inner}</div></article>").split("\n\n") == LONG


@pytest.mark.parametrize(
    "hidden",
    ["<button><p>Buy now</p></button>", "<template><p>Buy now</p></template>", "<iframe src=x><p>Buy now</p></iframe>", '<span style="display:none"><p>Buy now</p></span>']
    + ["<button><p>Buy now</button>", "<span hidden>Buy<p>now</span>", "<button><div>Buy</div><p>now</button>", "<select><option>Buy<option>now</select>", "<svg><title>Buy</title><p>now</p></svg>"],
)
def test_hidden_parts_of_a_line_leave_it_whole(hidden):
    assert ht.main_text(f"<article><p>one {hidden} two</p><p>three</p></article>").split("\n\n") == ["one two", "three"]


def test_clusters_decide_about_links_in_an_article(monkeypatch):
    share = "<p><a href=x>Share on X</a> <a href=f>Share on F</a></p>"
    other = "<ul>" + "".join(f"<li><a href=/{k}>Other story {k}</a></li>" for k in range(4)) + "</ul>"
    sources = "<ul>" + "".join(f"<li><a href=/{k}>A source with a long title, an author, a place and a year, 19{k}0</a></li>" for k in range(10, 14)) + "</ul>"
    page = f"<article><h1>T</h1>{share}{BODY}{other}<p>The end.</p></article>"
    assert ht.main_text(page).split("\n\n") == ["T", *LONG, "The end."]
    assert ht.main_text(f"<article>{BODY}{sources}</article>").count("A source") == 4
    assert ht.main_text(f"<article>{BODY}<p>See <a href=x>this</a> and <a href=y>that</a> for more of it.</p></article>").endswith("See this and that for more of it.")
    monkeypatch.setattr(ht, "content_lines", lambda ratios: np.ones(len(ratios), bool))
    assert ht.main_text(page).count("Other story") == 4


def test_generated_pages_by_construction():
    """Pages put together from parts that show and parts that don't; what shows is known from the start."""
    rng = random.Random(7)
    word = lambda: "".join(rng.choice("abdeginorstué") for _ in range(rng.randrange(1, 9)))
    words = lambda a, b: [word() for _ in range(rng.randrange(a, b))]

    def paragraph():
        own = words(15, 60)
        marked = [rng.choice(["{}", "{}", "{}", "<b>{}</b>", "<em>{}</em>", "<a href=/x>{}</a>", "{}<span hidden>no</span>", "{}<!-- c -->"]).format(w) for w in own]
        return " ".join(own), f"<p>{rng.choice([' ', chr(10), '  ']).join(marked)}" + rng.choice(["", "</p>"])

    def shown():
        kind = rng.randrange(5)
        if kind < 3:
            return paragraph()
        if kind == 3:
            own = " ".join(words(2, 6))
            return own, f"<h2 id='{rng.choice(['search', 'related-' + word(), word()])}'>{own}</h2>"
        own = [" ".join(words(2, 8)) for _ in range(3)]
        return "\n\n".join(own), "<ul>" + "".join(f"<li>{x}" for x in own) + "</ul>"

    def hidden():
        links = "".join(f"<li><a href=/{word()}>{word()}</a></li>" for _ in range(rng.randrange(3, 7)))
        text = paragraph()[1]
        return rng.choice(
            [f"<nav><ul>{links}</ul></nav>", f"<div class=ad>{text}</div>", f"<aside>{text}</aside>", f"<script>{text}</script>", f"<form>{text}<input></form>", f"<section id=comments>{text}{text}</section>"]
            + [f"<ul>{links}</ul>", f"<div class='share-links'>{links}</div>", f"<footer>{text}</footer>", f"<style>{text}</style>", f"<div class='cookie-notice'>{links}</div>", f"<div style='display:none'>{text}</div>"]
        )

    for _ in range(300):
        page, want = "", []
        for k in range(rng.randrange(4, 14)):
            text, html = paragraph() if k == 0 else shown()
            want.append(text)
            page += html
            if rng.random() < 0.3:
                page += hidden() + paragraph_break(want, page, rng, paragraph)
        outside = ["", "<nav><a href=/>home</a></nav>", "<header><h1>Site</h1></header>", "<div class=ad>buy</div>"]
        got = ht.main_text(f"<body>{rng.choice(outside)}<article>{page}</article>{rng.choice(outside)}</body>").split("\n\n")
        assert got == "\n\n".join(want).split("\n\n")


def paragraph_break(want, page, rng, paragraph):
    text, html = paragraph()
    want.append(text)
    return html
