"""Main text of HTML pages by two passes of rules over blocks.

A page falls into blocks at block-level tags. The first pass decides blocks by link density, length and the
density of stop words, once those of menus, forms, adverts, comments and the like are set apart. The second lets
the blocks left open, mostly short ones, take the label of the nearest decided neighbours of their region.

What an element is called is evidence that has to hold against the text: a form that holds most of a page's
running text is the page, a marked article that holds little of it is a teaser, and names that would leave no
text at all do not count. So do stop words: where the lists of no language fit a page, length and link density decide.
"""

from __future__ import annotations

import html
import re
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import with_text_columns

# Frequent function words of some languages, element names and words of class names.
STOP_WORDS = frozenset(
    """the of and to in is was that it for on are with as be this by from or an at not he his they have
    der die und den von zu das mit sich des auf ist im dem nicht ein eine als auch es wir
    de la le et les en un du une que est pour qui dans par plus pas au sur des il
    el y a los se del las por con no su para al lo como o más una son
    di che e il per non sono da della i gli
    do da em os um uma não na""".split()
)
BLOCKS = frozenset("address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html legend li main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead tr ul".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
NOT_TEXT = frozenset("script style noscript template textarea select svg math iframe object canvas audio video head title".split())
AROUND = frozenset("nav footer aside menu button dialog".split())
#: What is around the text whatever else a class name says before it.
AROUND_LAST = frozenset(
    """ads advert adverts advertisement advertising sponsored sidebar menu nav navigation navbar breadcrumb breadcrumbs
    footer masthead comment comments disqus newsletter pagination popup modal toolbar tags""".split()
)
#: What is around the text if a class name says nothing else but a place or a shape.
AROUND_WORDS = AROUND_LAST | frozenset(
    """ad adsbygoogle sponsor promo promotion banner header reply replies discussion respond cookie cookies consent
    gdpr notice notices notification alert overlay subscribe signup login share sharing social related recommended
    recommendations widget pager copyright legal disclaimer skip hidden teaser onetrust cookiebot responses""".split()
)
PLACES = frozenset(
    """site page web top bottom left right main primary secondary global mobile desktop sticky fixed inline box block
    container wrapper wrap inner outer holder section area zone slot unit bar list item items links link row col column
    grid panel button buttons icon icons label title text body content message form field group article articles post
    posts entry story stories user users reader readers small large sdk law info policy thread""".split()
)
CONTENT_WORDS = frozenset("article post entry story page content".split())
AROUND_ROLES = frozenset("navigation banner contentinfo complementary search form menu menubar alert dialog".split())
MAIN_WORDS = frozenset("article content post entry main story".split())

_TOKEN = re.compile(
    r"<!--.*?(?:-->|(?P<open>\Z))"
    r"|<(?P<raw>script|style|noscript|template|textarea|select|svg|math|iframe|object|canvas|audio|video|title)\b(?:[^>\"']|\"[^\"]*\"|'[^']*')*+>.*?(?:</(?P=raw)\s*>|(?P<endless>\Z))"
    r"|<(?P<close>/?)(?P<name>[a-z][^\s/>]*)(?P<attrs>(?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>"
    r"|<[a-z/!?][^>]*>",
    re.I | re.S,
)
_ATTR = re.compile(r"""([^\s=/>"']+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""")
_TAG = re.compile("<[a-z/!?]", re.I)
#: Characters that stand for about three letters each.
_WIDE = re.compile("[\u2e80-\u9fff\uac00-\ud7af\uf900-\ufaff\U00020000-\U0003ffff]")
_WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")
_WORD = re.compile(r"\w+")


@dataclass(slots=True)
class Block:
    text: str
    link_chars: int
    around: bool  # in a menu, a footer and the like, or hidden
    named: bool  # in an element whose class or id says that it is around the text
    form: int  # number of the form it is in, 0 for none
    main: int  # 2 in an article or main element, 1 in an element called so, else 0
    heading: bool
    label: str = ""


def _named_around(value: str, in_main: bool) -> bool:
    """Whether a class or id attribute calls an element an advert, a menu, comments and the like."""
    for token in value.split():
        words = [w.lower() for w in _WORDS.findall(token)]
        for k, w in enumerate(words):
            if w not in AROUND_WORDS:
                continue
            others = set(words[:k] + words[k + 1 :])
            if w == "header" and (in_main or others & CONTENT_WORDS):
                continue
            if w in AROUND_LAST and k == len(words) - 1 or all(o in PLACES or o in AROUND_WORDS or len(o) <= 2 for o in others):
                return True
    return False


def _surroundings(name: str, attrs: str, in_main: bool) -> tuple[bool, bool, int]:
    """Whether an element is around the text, whether its names say so, and whether it holds the main text."""
    if name in AROUND or (name == "header" and not in_main):
        return True, False, 0
    main = 2 if name in ("article", "main") else 0
    named = False
    if not attrs or "=" not in attrs and "hidden" not in attrs:
        return False, False, main
    for key, value in _ATTR.findall(attrs):
        key, value = key.lower(), value.strip("\"'")
        if key == "style":
            value = "".join(value.lower().split())
        if key in ("class", "id"):
            if name not in ("html", "body", "main", "h1"):
                named |= _named_around(value, in_main)
            if name in ("div", "section") and any(w.lower() in MAIN_WORDS for w in _WORDS.findall(value)):
                main = max(main, 1)
        elif key == "role":
            if value.lower() in AROUND_ROLES:
                return True, named, 0
            if value.lower() in ("main", "article"):
                main = 2
        elif key == "hidden" or key == "aria-hidden" and value.lower() == "true" or key == "style" and ("display:none" in value or "visibility:hidden" in value):
            return True, named, 0
    return False, named, 0 if named else main


def blocks_of(page: str) -> list[Block]:
    """The blocks of a page in order, white space made single spaces; blocks without text are left out."""
    out: list[Block] = []
    stack: list[tuple] = []  # name, around, named, form, link, main
    held = [0, 0, 0, 0]  # open elements that are around the text, by name, forms and links
    mains = [0, 0, 0]  # open elements by how surely they hold the main text
    names: dict[str, int] = {}  # open elements by name: stray end tags are known without a look at the stack
    forms = 0
    parts: list[str] = []
    links: list[str] = []
    in_head = False
    heading = False

    def flush() -> None:
        nonlocal heading
        text = " ".join(html.unescape("".join(parts)).split())
        if text:
            out.append(Block(text, len(" ".join(html.unescape("".join(links)).split())), held[0] > 0, held[1] > 0, forms if held[2] else 0, 2 if mains[2] else 1 if mains[1] else 0, heading))
        parts.clear()
        links.clear()
        heading = False

    def close(gone: tuple) -> None:
        for i in range(4):
            held[i] -= gone[1 + i]
        mains[gone[5]] -= 1
        names[gone[0]] -= 1

    def end(name: str) -> None:
        if names.get(name):
            while True:
                gone = stack.pop()
                close(gone)
                if gone[0] == name:
                    return

    at = 0
    # a tag without an end is none: nothing is looked for beyond the last >
    last = page.rfind(">") + 1
    open_end = False
    for m in _TOKEN.finditer(page, 0, last):
        open_end = m["open"] is not None or m["endless"] is not None
        if m.start() > at and not in_head:
            piece = page[at : m.start()]
            parts.append(piece)
            if held[3]:
                links.append(piece)
        at = m.end()
        name = m["name"]
        if name is None:
            if m["raw"] and m["raw"].lower() in ("textarea", "select", "iframe", "object", "video", "audio"):
                parts.append(" ")
            continue
        name = name.lower()
        if name == "head":
            in_head = not m["close"]
            continue
        if name == "body":
            in_head = False
        if name == "a" and not m["close"]:
            end("a")  # links do not nest
        elif name == "br":
            parts.append(" ")
        if name in BLOCKS:
            flush()
            in_head = False
            heading = not m["close"] and len(name) == 2 and name[0] == "h" and name != "hr"
        if name in VOID:
            continue
        if not m["close"]:
            if name == "p" or name == "li" and stack and stack[-1][0] == "li":
                while stack and stack[-1][0] in ("p", "b", "i", "em", "strong", "span", "a", "u") and any(x[0] == "p" for x in stack[-8:]) or stack and stack[-1][0] == name == "li":
                    gone = stack.pop()
                    close(gone)
                    if gone[0] == name:
                        break
            if m["attrs"].endswith("/") and name not in BLOCKS:
                continue
            around, named, main = _surroundings(name, m["attrs"], mains[1] + mains[2] > 0)
            link = name == "a" and any(key.lower() == "href" for key, _ in _ATTR.findall(m["attrs"]))
            element = (name, around, named, name == "form", link, main)
            forms += name == "form" and not held[2]
            stack.append(element)
            for i in range(4):
                held[i] += element[1 + i]
            mains[main] += 1
            names[name] = names.get(name, 0) + 1
        else:
            end(name)
    if not in_head and not open_end:
        rest = page[at:last] + _TAG.split(page[last:], maxsplit=1)[0]
        parts.append(rest)
        if held[3]:
            links.append(rest)
    flush()
    return out


def _region(blocks: list[Block], apart: list[bool], linked: float) -> int:
    """From which mark on (2: article and main elements, 1: elements called so) a block is in the article; 0: no mark tells.

    Marks count where what they leave out is at most four times (for names: a third of) what they hold.
    """
    mass = [0, 0, 0]
    for b, out in zip(blocks, apart):
        if not out and b.link_chars <= linked * len(b.text):
            mass[b.main] += len(b.text)
    if mass[2] and mass[0] + mass[1] <= 4 * mass[2]:
        return 2
    return 1 if mass[1] and 3 * mass[0] <= mass[1] + mass[2] else 0


def decide(blocks: list[Block], long: int = 60, short: int = 25, dense: float = 0.12, linked: float = 0.5, names: bool = True) -> list[bool]:
    """Which blocks are main text.

    First pass: in surrounding elements or mostly links: no; at least ``long`` characters and a share of
    ``dense`` stop words: yes; else open. Where less than a quarter of the long text is dense, the page is in none
    of the languages listed, and the stop words of a block are not asked for. Second pass: an open block takes the label of the nearest decided
    blocks on either side within its region (inside the article, or outside); where they differ the nearer
    one's, on a tie that of the text below for a heading and inside an article that of main text.
    """
    full, sizes = [], []
    for b in blocks:
        sizes.append(len(b.text) + 2 * len(_WIDE.findall(b.text)))
        words = _WORD.findall(b.text.lower()) if sizes[-1] >= short else []
        full.append(bool(words) and sum(w in STOP_WORDS for w in words) >= dense * len(words) and b.link_chars <= linked * len(b.text))
    apart = [b.around or names and b.named for b in blocks]
    lengthy = [size >= long and not out and b.link_chars <= linked * len(b.text) for b, size, out in zip(blocks, sizes, apart)]
    mass = sum(size for size, yes in zip(sizes, lengthy) if yes)
    if 4 * sum(size for size, yes, ok in zip(sizes, lengthy, full) if yes and ok) < mass:
        full = [size >= short and b.link_chars <= linked * len(b.text) for b, size in zip(blocks, sizes)]
    # a form is around the text unless it holds most of it
    by_form: dict[int, int] = {}
    for b, ok, out in zip(blocks, full, apart):
        if ok and not out:
            by_form[b.form] = by_form.get(b.form, 0) + len(b.text)
    half = sum(by_form.values()) / 2
    apart = [out or b.form > 0 and by_form.get(b.form, 0) <= half for b, out in zip(blocks, apart)]
    region = _region(blocks, apart, linked)
    inside = [b.main >= region > 0 for b in blocks]
    for b, ok, out, mine, size in zip(blocks, full, apart, inside, sizes):
        if out or b.link_chars > linked * len(b.text):
            b.label = "no"
        else:
            b.label = "yes" if ok and (size >= long or mine) else ""
    n = len(blocks)
    left: list[tuple[int, str] | None] = [None] * n
    right: list[tuple[int, str] | None] = [None] * n
    for order, near in ((range(n), left), (range(n - 1, -1, -1), right)):
        last: dict[bool, tuple[int, str]] = {}
        for k in order:
            b = blocks[k]
            if b.label:
                # an advert or a menu inside the article says nothing about the text beside it
                if not (inside[k] and b.label == "no"):
                    last[inside[k]] = (k, b.label)
            else:
                near[k] = last.get(inside[k])
    out = []
    for k, b in enumerate(blocks):
        if b.label:
            out.append(b.label == "yes")
            continue
        x, y = left[k], right[k]
        if x is None and y is None:
            out.append(inside[k] or not region)
        elif x is None or y is None or x[1] == y[1]:
            out.append((x or y)[1] == "yes")
        else:
            dx, dy = k - x[0], y[0] - k
            out.append((x if dx < dy else y)[1] == "yes" if dx != dy else y[1] == "yes" if b.heading else inside[k])
    if region:  # text outside the article is not the article's
        out = [keep and mine for keep, mine in zip(out, inside)]
    if names and not any(out) and any(b.named for b in blocks):
        return decide(blocks, long, short, dense, linked, names=False)
    return out


def main_text(page: str) -> str:
    found = blocks_of(page)
    return "\n".join(b.text for b, keep in zip(found, decide(found)) if keep)


def extract(pages: DataFrame, html_col: str = "html", text_col: str = "text") -> DataFrame:
    """``pages`` with the main text of each whole page and n_chars, its code points.

    Null and empty pages, and pages without main text, give an empty text. Pages are read whole, however long,
    each on its own: repeated rows and null ids are treated like any other, an empty table gives an empty one.
    Other columns pass untouched, those of the added names are replaced.
    """

    def make():
        def compute(texts: list[str]):
            found = [main_text(t) for t in texts]
            return found, [len(t) for t in found]

        return compute

    return with_text_columns(pages, html_col, [(text_col, "string"), ("n_chars", "long")], make)


def extract_pages(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(id, url, text, n_chars) for each row."""
    rows = pages.select(F.col(id_col).alias(id_col), F.col(url_col).alias(url_col), F.col(html_col).alias("_html"))
    return extract(rows, "_html").select(id_col, url_col, "text", "n_chars")
