import random
import time

import pytest

from graphloom.llm import html_text

PAGES = "page_id long, url string, html string, text string, path int"


def page(body, extra=""):
    return f'<!DOCTYPE html><html><head><title>Not this</title><script>var t="</p>";</script></head><body><header>Top</header><nav><ul><li><a href="/a">Menu</a></li></ul></nav>{body}{extra}<footer>&copy; end</footer></body></html>'


ARTICLE = '<article><h1>A  title &amp; more</h1><p>First <b>bo</b>ld, paragraph with some words.<br>line two, long enough to count, really.<p>Second, &lt;tag&gt; text&nbsp;here.</p></article>'
WANT = "A title & more First bold, paragraph with some words. line two, long enough to count, really. Second, <tag> text here."


def test_article_text():
    assert html_text.extract(page(ARTICLE), None) == WANT
    assert html_text.extract(page('<div class="ad">Buy, buy, buy, this very long advert text, now and here.</div>' + ARTICLE), None) == WANT
    assert html_text.extract(page('<div class="content-12">' + ARTICLE.replace("article", "section") + '<div id="comments"><p>A reader says, at great length, that this is wrong.</p></div></div>'), None) == WANT
    for broken in ("", "<", "<p", "</p></p>", "<!-- open", "<script>never closed", "<a<b>", "<p>plain"):
        html_text.extract(broken, None)
    assert html_text.extract("just, some text", None) == "just, some text"


def test_hosts_agree_and_odd_rows(spark):
    side = '<div class="side-box">' + "<p>Short, long, sidebar words that are many, many, many, many.</p>" * 3 + "</div>"
    rows = [(i, f"https://a.example.com/{i}", page(f'<div class="story-{i}"><p>Story {i}, with a good number, of words in it, for sure.</p><p>And more, so much more, of the same.</p></div>'), "c", 1) for i in range(20)]
    rows += [(100, "https://a.example.com/x", page('<div class="story-9"><p>Tiny story, here.</p></div>', side), "c", 1), (101, None, None, "c", 1), (102, "nonsense", "", "c", 1), (103, "http://b.example.com", page(ARTICLE), "c", 1), (103, "http://b.example.com", page(ARTICLE), "c", 1), (104, "http://c.example.com", "<p>" + "long text, " * 50_000, "c", 1)]
    pages = spark.createDataFrame(rows, PAGES).repartition(3)
    out = html_text.main_text(pages).collect()
    got = {r.page_id: r for r in out}
    assert len(out) == len(rows) and all(r.n_chars == len(r.text) for r in out)
    assert got[100].text == "Tiny story, here.", "the host's path wins over a longer sidebar"
    assert got[7].text.startswith("Story 7, with") and got[101].text == got[102].text == "" and got[103].text == WANT
    assert got[104].n_chars == 11 * 50_000 - 1
    html_text.BROADCAST_HOSTS, kept = 0, html_text.BROADCAST_HOSTS
    try:
        assert sorted(map(tuple, html_text.main_text(pages).collect()), key=str) == sorted(map(tuple, out), key=str)
    finally:
        html_text.BROADCAST_HOSTS = kept
    assert html_text.main_text(pages.limit(0)).count() == 0


KEPT_NAMES = ["related-work", "notice-period", "comments-on-law", "menu-theory", "social-history", "header-files", "lead", ""]
JUNK_NAMES = ["ad", "comments", "related-posts", "share-buttons", "cookie_banner", "newsletter-signup", "sidebar left", "comments-list-2"]


@pytest.mark.parametrize("seed", range(40))
def test_generated_pages_give_back_their_article(seed):
    """Brute force: the article's blocks are known, with names that hold listed words; junk lies between and around them."""
    rng = random.Random(seed)
    words = lambda n: " ".join(rng.choices(["alpha", "beta,", "gamma", "délta", "x &amp; y", "eta."], k=n))
    blocks, want = [], []
    for _ in range(rng.randint(3, 9)):
        text = words(rng.randint(4, 30))
        want.append(text.replace("&amp;", "&"))
        name = rng.choice(KEPT_NAMES)
        mark = f' {rng.choice(["class", "id"])}="{name}"' if name else ""
        tag = rng.choice(["p", "section", "h2", "div"])
        blocks.append(f"<{tag}{mark}>{text}</{tag}>")
        if rng.random() < 0.5:
            blocks.append(f'<div class="{rng.choice(JUNK_NAMES)}"><p>{words(9)}</p></div>')
        if rng.random() < 0.3:
            blocks.append(rng.choice(["<svg><path d='1'>", "<object data=x>", "<iframe src=y>", "<select><option>a", "<template>z", '<svg a="b>c">t</svg>', "<!-- x -->", "<script>var a='<p>';</script>"]))
    body = "<article>" + "".join(blocks) + "</article>"
    assert html_text.extract(page(body, f'<div class="sidebar">{words(40)}</div>'), None) == " ".join(" ".join(want).split())


COMMENT_NAMES = ["user-comments", "reader-comments", "fb-comments", "commentlist", "discussion", "responses", "respond", "article_comments-3", "site-comment"]


@pytest.mark.parametrize("name", COMMENT_NAMES)
@pytest.mark.parametrize("tag", ["div", "section", "ol"])
def test_longer_comments_never_take_the_articles_place(name, tag):
    talk = f'<{tag} class="{name}">' + "<p>A reader writes, with many words, many more, and still more, than the article has.</p>" * 6 + f"</{tag}>"
    assert html_text.extract(page(ARTICLE, talk), None) == WANT
    assert html_text.extract(page(talk + ARTICLE), None) == WANT
    if tag != "section" or name not in ("discussion", "responses", "respond"):  # those may be an article's own sections
        assert html_text.extract(page(ARTICLE.replace("</article>", talk + "</article>")), None) == WANT


def test_comments_on_every_page_of_a_host(spark):
    talk = '<div class="user-comments">' + "<p>A reader writes, with many words, many more, and still more.</p>" * 9 + "</div>"
    other = '<div class="zone-7">' + "<p>Words, beside it, nobody named, some of them.</p>" * 3 + "</div>"
    rows = [(i, f"https://a.example.com/{i}", page(ARTICLE.replace("Second", f"Second {i}"), talk + (other if i % 2 else "")), "", 0) for i in range(12)]
    got = html_text.main_text(spark.createDataFrame(rows, PAGES)).collect()
    assert all(r.text == WANT.replace("Second", f"Second {r.page_id}") for r in got)


@pytest.mark.parametrize("name", ["social-group", "related-links", "share-link", "newsletter-content", "comment-content", "discussion", "notice", "menu-list", "widget"])
@pytest.mark.parametrize("form", ['<section class="{}"><p>Kept, text.</p></section>', '<section id="{}">Kept, text.</section>', '<h2 id="{}">Kept, text.</h2>', '<p class="{}">Kept, text.</p>', '<blockquote class="{}">Kept, text.</blockquote>'])
def test_an_articles_own_elements_stay_whatever_their_names(name, form):
    assert html_text.extract(page(ARTICLE.replace("</article>", form.format(name) + "</article>")), None) == WANT + " Kept, text."


def test_a_page_that_is_all_discussion_is_read():
    assert html_text.extract('<html><body><div class="discussion"><p>All there is, on this page, of text.</p></div></body></html>', None) == "All there is, on this page, of text."


@pytest.mark.parametrize("unit", ['<a "', '<a ">"', "<a '\">", "<svg>", "<svg><p>", "<!", "<!--", "<a<a", "<div></section>", "</p>", "<div class='a", '<p class=" x="', "<script", "<title><", "< <a b=c d", "&amp"])
def test_a_malformed_megabyte_is_read_in_linear_time(unit):
    text = unit * (1_000_000 // len(unit))  # a megabyte
    began = time.process_time()
    html_text.parse(text)
    assert time.process_time() - began < 3, "quadratic time would be minutes"


def test_deep_paths_stay_apart():
    deep = "<div class=abcdefgh>" * 200
    boxes, _ = html_text.parse(deep + "<p>One text, in a box of its own, here it is.</p></div><div class=other><p>Another, text.</p>")
    assert len({b.path for b in boxes}) == len(boxes) and max(len(b.path) for b in boxes) <= html_text.MAX_PATH
