"""Page shapes with the text a reader would call the article."""

import html.parser
import time

import pytest

pytest.importorskip("palimpsest.llm.html_text")
from palimpsest.llm import html_text
from palimpsest.llm.html_text import main_text

A = "The river rose in the night, and the people of the town went up to the old church on the hill."
B = "It was said that the water had not been so high for a hundred years, and that it would not fall by the morning."
C = "In the end it was the miller who saw that the bridge would go, and he rang the bell for all of them to hear."
SHORT = "All was still."
TEXT = f"{A}\n{B}\n{C}"
P = f"<p>{A}</p><p>{B}</p><p>{C}</p>"
NAV = '<nav><ul><li><a href="/">Home</a></li><li><a href="/n">News of the day and the week</a></li></ul></nav>'
FOOT = "<footer>&copy; The owners of the site, and all of the rights that they have in it.</footer>"
AD = "<p>This is the best of the offers that we have for you and it is on sale to the end of the week.</p>"

SHAPES = {
    "plain": (P, TEXT),
    "article": (f"{NAV}<article>{P}</article>{FOOT}", TEXT),
    "main": (f"{NAV}<main>{P}</main>{FOOT}", TEXT),
    "role": (f"{NAV}<div role=main>{P}</div>{FOOT}", TEXT),
    "no marks": (f"{NAV}<div><div>{P}</div></div>{FOOT}", TEXT),
    "teaser before": (f'<div class="intro-text">What the river did.</div>{P}', f"What the river did.\n{TEXT}"),
    "long teaser before": (f'<div class="article-intro">{A}</div><p>{B}</p><p>{C}</p>', TEXT),
    "article teasers": (f"<article>{SHORT}</article>{P * 5}<article>{SHORT}</article>", "\n".join([SHORT, *[TEXT] * 5, SHORT])),
    "form around the page": (f'<form id="aspnetForm" method=post>{NAV}{P}{FOOT}</form>', TEXT),
    "form in the page": (f"{P}<form>{AD}<input name=q><button>Send it now</button></form>", TEXT),
    "share prices": (f'<article><p>{A}</p><div class="share-prices"><p>{B}</p></div><p>{C}</p></article>', TEXT),
    "notice of death": (f'<article><p>{A}</p><p class="notice-of-death">{B}</p><p>{C}</p></article>', TEXT),
    "recipe": (f'<article><p>{A}</p><p class="cookie-recipe">{B}</p><p>{C}</p></article>', TEXT),
    "advert": (f'<article><p>{A}</p><div class="ad">{AD}</div><p>{B}</p><p>{C}</p></article>', TEXT),
    "named adverts": (f'{P}<div id="ad-top-2">{AD}</div><div class="box advertisement">{AD}</div><div class="site-sponsored">{AD}</div>', TEXT),
    "comments": (f'<article>{P}</article><section id="comments"><p>{AD}</p><div class="comment-body">{AD}</div></section>', TEXT),
    "comments in the article": (f'<article>{P}<div class="reader-comments">{AD}{AD}{AD}</div></article>', TEXT),
    "more comments than text": (f'<p>{A}</p><div class="user-comments">{AD * 20}</div>', A),
    "cookie notice": (f'<div class="cookie-notice">{AD}</div>{P}<div id=gdpr-consent>{AD}</div>', TEXT),
    "sidebar": (f'<div class="td-main-content">{P}</div><div class="td-sidebar">{AD}{AD}</div>', TEXT),
    "aside": (f"<article><p>{A}</p><aside>{AD}</aside><p>{B}</p><p>{C}</p></article>", TEXT),
    "heading and short lines": (f"<article><h1>The flood</h1><p>{A}</p><p>{SHORT}</p><p>{B}</p></article>", f"The flood\n{A}\n{SHORT}\n{B}"),
    "heading before": (f'<div class="article-header"><h1>The flood</h1></div><p>{A}</p><p>{B}</p>', f"The flood\n{A}\n{B}"),
    "link list": (f'{P}<ul><li><a href=a>{A}</a></li><li><a href=b>{B}</a></li></ul>', TEXT),
    "hidden": (f'{P}<div style="display: none">{AD}</div><div hidden>{AD}</div>', TEXT),
    "script and style": (f'<script>if (a<b) document.write("<p>{AD}</p>")</script><style>p{{}}</style>{P}', TEXT),
    "references": (f"<p>{A} &amp; &#233;&eacute; &lt;b&gt;</p>", f"{A} & éé <b>"),
    "unclosed": (f"<article><p>{A}<p>{B}<p>{C}</article>", TEXT),
    "line break": (f"<p>{A}<br>{B}</p>", f"{A} {B}"),
    "names alone": (f'<div class="page-modal"><p>{A}</p></div>', A),
    "unknown tongue": ("<article><p>Joki nousi yöllä ja väki meni vanhalle kirkolle mäen päälle katsomaan vettä.</p></article>" + FOOT, "Joki nousi yöllä ja väki meni vanhalle kirkolle mäen päälle katsomaan vettä."),
    "nothing": (f"{NAV}{FOOT}", ""),
}


@pytest.mark.parametrize("name", SHAPES)
def test_shape(name):
    page, want = SHAPES[name]
    for html in (page, f"<!DOCTYPE html><html><head><title>T</title></head><body>{page}</body></html>"):
        assert main_text(html) == want


EN = "The people of the town met last week to talk about the new rules and what they are for in this region."
OTHERS = [
    "W ubiegłym tygodniu mieszkańcy miasteczka spotkali się, aby omówić nowe przepisy dotyczące ochrony lasów i rzek w całym regionie.",
    "На прошлой неделе жители города встретились, чтобы обсудить новые правила охраны лесов и рек во всём регионе этой страны.",
    "上周,该镇居民开会讨论了保护整个地区森林和河流的新规定,会议持续了三个小时。",
    "اجتمع سكان البلدة الأسبوع الماضي لمناقشة القواعد الجديدة لحماية الغابات والأنهار في المنطقة بأكملها",
    "Geçen hafta kasaba sakinleri, bölgedeki ormanların ve nehirlerin korunmasına ilişkin yeni kuralları görüşmek üzere toplandı.",
]


@pytest.mark.parametrize("text", [EN, *OTHERS])
def test_any_language_without_marks(text):
    menu = "<nav><a href='/'>Home</a> <a href='/a'>About</a></nav>"
    assert main_text(f"{menu}<div><p>{text}</p><p>{text}</p></div><footer>© 2020</footer>") == f"{text}\n{text}"


@pytest.mark.parametrize(
    "page",
    [
        '<div class="story" data-title="The hidden cost of rent"><p>%s</p></div>',
        '<section title="hidden treasures"><p>%s</p></section>',
        '<body data-page="Hidden valley"><p>%s</p></body>',
        '<article data-hidden="false"><p>%s</p></article>',
        '<article data-role="banner"><p>%s</p></article>',
        '<p title="hidden gem">%s</p>',
        '<a name="top"><p>%s</p>',
        '<p>%s</p><a href="x',
        "<p>%s</p></i></b></div>",
    ],
)
def test_attributes_by_name_and_anchors(page):
    assert main_text(page.replace("%s", EN)) == EN


@pytest.mark.parametrize("around", ['id="onetrust-banner-sdk"', 'id="cookie-law-info-bar"', 'id="comments-thread"', 'class="reader-responses"', 'style="visibility: hidden"'])
def test_notices_and_comments_by_name(around):
    assert main_text(f"<div><p>{EN}</p></div><div {around}><p>Other {EN}</p></div>") == EN


@pytest.mark.parametrize("page", ["<b>" * 150_000 + "</i>" * 150_000, "<a " * 350_000, "<article>" * 50_000 + "<p>x" * 50_000, "<a href='" * 100_000, "<p>" * 300_000, "<!--" * 250_000, "<script>" * 100_000, "&amp" * 250_000])
def test_malformed_pages_take_linear_time(page):
    began = time.perf_counter()
    main_text(page)
    assert time.perf_counter() - began < 10  # quadratic: minutes to hours


class Plain(html.parser.HTMLParser):
    """The blocks of a page by the standard library's parser."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.blocks, self.text, self.off = [], [], 0

    def turn(self):
        text = " ".join("".join(self.text).split())
        if text:
            self.blocks.append(text)
        self.text = []

    def handle_starttag(self, tag, attrs):
        if tag in html_text.BLOCKS:
            self.turn()
        self.off += tag in html_text.NOT_TEXT
        if tag == "br":
            self.text.append(" ")

    def handle_endtag(self, tag):
        if tag in html_text.BLOCKS:
            self.turn()
        self.off = max(0, self.off - (tag in html_text.NOT_TEXT))

    def handle_data(self, data):
        if not self.off:
            self.text.append(data)


def test_blocks_of_all_pages_against_the_standard_parser(spark):
    for row in spark.read.parquet("/root/testdata/sf0.01/pages.parquet").collect():
        plain = Plain()
        plain.feed(row.html or "")
        plain.close()
        plain.turn()
        assert [b.text for b in html_text.blocks_of(row.html or "")] == plain.blocks, row.page_id
