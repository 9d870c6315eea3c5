"""What words of class and id may decide on a page, and what only the neighbour's lines may."""

import pytest

from voxlake.llm import html_text


def text_of(page, shared=()):
    return html_text.main_text(html_text.blocks(page), set(shared))


@pytest.mark.parametrize(
    "page,want",
    [
        ('<article><header class="entry-header"><h1>Title</h1></header><p>Body</p></article>', "Title\n\nBody"),
        ('<main><div class="page-header"><h1>Title</h1></div><p>Body</p></main>', "Title\n\nBody"),
        ('<article><h2 id="search">Search trees</h2><p>a</p><h2 id="comments-on-kant">Kant</h2><p>b</p></article>', "Search trees\n\na\n\nKant\n\nb"),
        ('<article><p>a</p><section id="related-work"><h2>Related work</h2><p>b</p></section></article>', "a\n\nRelated work\n\nb"),
        ('<body><div id="header-wrap"><div class="main"><p>text</p></div></div></body>', "text"),
        ('<body><div class="header-wrap"><nav>menu</nav><article><p>text</p></article></div></body>', "text"),
        ('<article><p>a</p><div class="comments"><p>c</p></div><div id="comments"><p>c</p></div><div class="ad-slot">x</div><aside>y</aside><div class="share-buttons">z</div></article>', "a"),
        ('<div class="sidebar"><p>s</p></div><div class="notice">n</div><p>open</p><article class="comment"><p>c</p></article><article><p>text</p></article>', "open\n\ntext"),
        ('<article><p>a</p><div class="related-posts"><p>r</p></div><div class="newsletter">n</div><footer>f</footer></article>', "a"),
        ('<nav><div class="content">menu</div></nav><p>a</p>', "a"),
    ],
)
def test_words(page, want):
    assert text_of(page) == want


def test_a_doubtful_block_of_an_article_goes_if_the_neighbour_has_it(spark):
    page = lambda i: f'<html><body><article><h1>Title {i}</h1><div class="site-notice"><p>This site is closed on Mondays</p></div><p>Body of page {i}</p></article></body></html>'
    rows = [(i, f"https://a.example/p/{i}", page(i)) for i in range(4)] + [(9, "https://b.example/x", page(9))]
    got = {r["page_id"]: r["text"] for r in html_text.extract(spark.createDataFrame(rows, "page_id int, url string, html string")).collect()}
    assert got == {i: f"Title {i}\n\nBody of page {i}" for i in range(4)} | {9: "Title 9\n\nThis site is closed on Mondays\n\nBody of page 9"}  # b has no neighbour
