"""Main text of web pages by two passes of block rules.

A page is cut into blocks at block elements. Each block has its text, its words, the share of its
characters inside links, the share of its words that are stop words, and where it stands.

Pass 1 labels a block by itself. Inside menus, headers, footers, sidebars, notices, adverts, forms, comments and hidden elements, as far
as elements, roles and whole names of class and id tell, it is bad: names all of whose words are known, one of them for such a part
(`post-comments`, `story-ad`, `commentlist`, `more-stories`). Names that only may mean such a part shift the thresholds. Words that often stand for
something else (`widget`, `share`, `menu`) leave a block good only if it is prose: ten words, stop words among them, few links. A known word beside
unknown ones (`share-price`, `menu-reform`) makes prose good, links bad and short blocks undecided.
Elsewhere a block inside an article or main element is good, unless it consists of links and is no headline. The first article, main elements and
the page itself aren't judged by their own class; a later article is, as comments often are articles. Outside these elements a block is bad where they hold
most of the page's words. Else many link characters make it bad, and so does the word cookie in a short block; a long block with stop words is good, one
without is bad, the rest is undecided. Pages without any block in a language whose stop words are known have no block without stop words: there
length and links alone decide.
Pass 2 gives undecided blocks the label of their nearest decided neighbours: if both agree, theirs, else that of
the nearer one, counted in words between them; a tie, and a page without any decided block, is good.

The good blocks, in page order, joined by one space, are the text. Script, style and markup never are text, nor are inline elements
that are hidden or marked as what is not the article. Null or empty
html gives the empty text. Broken markup (elements that are never closed, a cut tag at the end, quotes that don't close) is read as
browsers read it, as far as the blocks are concerned. Each page is read alone, so repeated ids or rows need nothing; columns
other than page_id, url and html are not read. An empty table gives an empty table.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomset.llm.textarray import slices

MAX_LINK_DENSITY, ALL_LINKS = 0.4, 0.9
STOP_LOW, STOP_HIGH = 0.10, 0.20
SHORT_WORDS, LONG_WORDS = 10, 30

#: Frequent function words of English, German, French and Spanish.
STOP_WORDS = frozenset(
    """a about after all an and are as at be been but by can for from had has have he her his i if in into is it its more no not of on or
    other our she so some than that the their them there they this to was we were what when which who will with would you your
    aber als am an auch auf aus bei bin das dass dem den der des die du durch ein eine einem einen einer er es für hat ich ihr im ist
    kann mit nach nicht noch nur oder sich sie sind so um und uns vom von war was wenn wie wir zu zum zur über
    au aux avec ce ces cette dans de des du elle en est et il ils je la le les leur lui mais ne nous on ont ou par pas plus pour qu que qui
    sa se ses son sont sur un une vous y été être
    al algo como con cuando de del donde el ella ellos en entre era es esta este fue ha hay la las le lo los más me mi muy no nos o para
    pero por que se ser si sin sobre son su sus también un una uno y ya""".split()
)
#: Elements, roles and words of class or id that mark what is not the article.
BAD_ELEMENTS = frozenset("nav footer aside form dialog menu search".split())
BAD_ROLES = frozenset("alert alertdialog banner complementary contentinfo dialog form menu menubar navigation search".split())
BAD_WORDS = frozenset(
    """ad ads adsense advert adverts advertisement advertisements advertising banner breadcrumb breadcrumbs comment comments commenting consent
    cookie cookies disclaimer discussion discussions disqus feedback footer gdpr header login masthead menubar nav navbar navigation newsletter notice notices outbrain pager
    pagination popup promo promos promoted promotion recommended recommendations related replies reply respond response responses sidebar sidebars signup
    sponsor sponsored sponsors subscribe subscription taboola teaser teasers""".split()
)
#: Words that mark such parts less surely.
WEAK_WORDS = frozenset("menu menus modal more overlay share shares sharing social toolbar widget widgets".split())
#: Bad words that also count where they are joined to one of the words around them (commentlist, pagefooter).
_STEMS = "advert|banner|breadcrumb|comment|cookie|disqus|footer|masthead|navbar|navigation|newsletter|popup|promo|related|sidebar|sponsor|teaser"
_WEAK_STEMS = "menu|share|social|toolbar|widget"
_BEFORE = "article|blog|content|entry|fb|global|main|page|post|reader|side|site|story|sub|top|user|web"
_AFTER = "area|bar|block|body|box|button|buttons|container|content|count|form|holder|icon|icons|inner|item|items|links|list|section|text|thread|wrap|wrapper"
_JOINED, _WEAKLY_JOINED = (re.compile(rf"(?:{_BEFORE})?(?:{x})s?(?:{_AFTER})?") for x in (_STEMS, _WEAK_STEMS))
#: Words that say nothing of their own beside a bad one.
_PLAIN = frozenset(f"{_BEFORE}|{_AFTER}|bottom|col|column|desktop|fixed|full|group|id|js|large|left|level|mobile|module|new|panel|primary|right|row|secondary|small|sticky|title|v|widget|widgets|wide|zone".split("|"))
#: Two words that together mark a list of other articles.
_OTHERS = (frozenset("also latest more most other popular recent top trending".split()), frozenset("articles headlines news popular posts read stories viewed".split()))
#: Short blocks with one of these outside an article are notices.
_NOTICE = re.compile(r"\bcookies?\b", re.IGNORECASE)
#: Words that make the rest of a class say what an element has or lacks, not what it is.
_ABOUT = frozenset("has is no with without".split())
#: A header or title of these is part of the article.
GOOD_WORDS = frozenset("article content entry headline post story title".split())
CONTENT_ELEMENTS = frozenset("article main".split())
HEADLINES = frozenset("h1 h2 h3 h4 h5 h6".split())
BLOCK_ELEMENTS = frozenset(
    """address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6
    head header hgroup hr html legend li main menu nav ol optgroup option p pre search section summary table tbody td tfoot th thead tr ul""".split()
)
VOID_ELEMENTS = frozenset("area base br col embed hr img input link meta param source track wbr".split())

_RAW = "script|style|noscript|template|svg|math|iframe|object|canvas|audio|video|textarea|select|button|title"
_QUOTED = r"""(?:[^>"']|"[^"<]*"|'[^'<]*')*+>"""
_TOKEN = re.compile(
    rf"""<!--.*?(?:-->|\Z)|<(?P<raw>{_RAW})\b(?:{_QUOTED}|[^>]*>).*?(?:</(?P=raw)\b[^>]*>|\Z)|<(?:{_RAW})\b[^>]*\Z"""
    rf"""|</(?P<close>[a-z][a-z0-9:-]*)[^>]*(?:>|\Z)|<(?P<open>[a-z][a-z0-9:-]*)(?P<attributes>{_QUOTED}|[^>]*(?:>|\Z))|<[!?][^>]*(?:>|\Z)""",
    re.IGNORECASE | re.DOTALL,
)
_MARK = re.compile(r"""(?:^|\s)(class|id|role|style|hidden|aria-hidden)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))|(?=[\s>/]|\Z))""", re.IGNORECASE)
_HIDING = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden")
_HUMP = re.compile(r"(?<=[a-z])(?=[A-Z])")
_WORD = re.compile(r"[^\W\d_]+")
_APART = re.compile(r"[^a-z0-9]+")


#: How surely an element is not the article.
FREE, MAYBE, WEAK, CERTAIN = range(4)


@dataclass
class Block:
    text: str
    links: int  # characters inside links
    doubt: int
    content: bool
    headline: bool

    @property
    def link_density(self) -> float:
        return min(1.0, self.links / max(1, len(self.text)))


def _doubt(name: str, content: bool) -> int:
    """How surely one class or id marks what is not the article."""
    parts = {x for x in _APART.split(_HUMP.sub("-", name).lower()) if x and not x.isdigit()}
    if parts & _ABOUT:
        return FREE
    if parts & {"header"} and (content or parts & GOOD_WORDS):
        parts -= {"header"}
    bad = {x for x in parts if x in BAD_WORDS or _JOINED.fullmatch(x)}
    weak = {x for x in parts - bad if x in WEAK_WORDS or _WEAKLY_JOINED.fullmatch(x)}
    one, other = _OTHERS
    if parts <= one | other and parts & one and parts & other:
        return CERTAIN
    if not bad | weak:
        return FREE
    if parts - bad - weak - _PLAIN:
        return MAYBE
    return CERTAIN if bad else WEAK


def _marks(element: str, attributes: str, content: bool, later: bool) -> tuple[int, bool]:
    """(how surely not the article, whether the article) as far as the element itself says. later: an article stands before it."""
    doubt = CERTAIN if element in BAD_ELEMENTS or element == "header" and not content else FREE
    good = element in CONTENT_ELEMENTS
    named, hidden = FREE, False
    for name, *values in _MARK.findall(attributes):
        name, value = name.lower(), "".join(values)
        if name == "role":
            doubt = max(doubt, CERTAIN if value.strip().lower() in BAD_ROLES else FREE)
            good |= value.strip().lower() in CONTENT_ELEMENTS
        elif name == "hidden":
            hidden = True
        elif name == "aria-hidden":
            hidden |= value.strip().lower() == "true"
        elif name == "style":
            hidden |= bool(_HIDING.search(value.lower()))
        else:
            named = max([named, *(_doubt(one, content or good) for one in value.split())])
    if element in ("html", "body"):
        return doubt, good
    if hidden:
        return CERTAIN, good
    return doubt if good and not (later and element == "article") else max(doubt, named), good


class _Open:
    """The open elements: (name, doubt, content, headline); inline elements only from a bad one on. Each step costs what it closes."""

    def __init__(self) -> None:
        self.stack: list[tuple[str, int, bool, bool]] = []
        self.places: dict[str, list[int]] = {}
        self.blocks: list[int] = []

    def top(self) -> tuple[str, int, bool, bool]:
        return self.stack[-1] if self.stack else ("", FREE, False, False)

    def block(self) -> tuple[str, int, bool, bool]:
        """The innermost block element."""
        return self.stack[self.blocks[-1]] if self.blocks else ("", FREE, False, False)

    def push(self, name: str, doubt: int, content: bool, headline: bool) -> None:
        self.places.setdefault(name, []).append(len(self.stack))
        if name in BLOCK_ELEMENTS:
            self.blocks.append(len(self.stack))
        self.stack.append((name, doubt, content, headline))

    def close(self, name: str) -> bool:
        """Closes the innermost element of this name and all inside it; an inline one only if no block began since."""
        at = self.places.get(name)
        if not at or name not in BLOCK_ELEMENTS and self.blocks and self.blocks[-1] > at[-1]:
            return False
        place = at[-1]
        while len(self.stack) > place:
            last = self.stack.pop()[0]
            self.places[last].pop()
            if last in BLOCK_ELEMENTS:
                self.blocks.pop()
        return True

    def unsaid(self) -> bool:
        """Whether a bad inline element is open."""
        return len(self.stack) > len(self.blocks)


def blocks(page: str) -> list[Block]:
    """The blocks of one page that have text, in page order."""
    out: list[Block] = []
    open_ = _Open()
    held: list[str] = []
    links = inside = 0
    articles = 0

    def end() -> None:
        nonlocal links
        text = " ".join("".join(held).split())
        if text:
            out.append(Block(text, links, *open_.block()[1:]))
        held.clear()
        links = 0

    def say(piece: str) -> None:
        nonlocal links
        if piece and not open_.unsaid():
            piece = html.unescape(piece)
            held.append(piece)
            if inside:
                links += len(" ".join(piece.split()))

    at = 0
    for token in _TOKEN.finditer(page):
        say(page[at : token.start()])
        at = token.end()
        if name := token["open"]:
            name = name.lower()
            attributes = token["attributes"] or ""
            if name == "a":
                inside = 1
            if name == "br":
                held.append(" ")
            elif name in BLOCK_ELEMENTS:
                end()
                inside = 0
                top = open_.block()[0]
                if name in ("p", "li", "tr", "td", "th", "dt", "dd", "option") and top == name or top == "p":
                    open_.close(top)
                if name not in VOID_ELEMENTS:
                    _, doubt, content, headline = open_.top()
                    own, good = _marks(name, attributes, content, articles > 0)
                    articles += name == "article"
                    open_.push(name, max(doubt, own), content or good, headline or name in HEADLINES)
            elif name not in VOID_ELEMENTS and not attributes.endswith("/>"):
                _, doubt, content, headline = open_.top()
                if open_.unsaid() and open_.places.get(name) or attributes.strip("/> ") and _marks(name, attributes, content, articles > 0)[0] >= WEAK:
                    open_.push(name, CERTAIN, content, headline)
        elif name := token["close"]:
            name = name.lower()
            if name == "a":
                inside = 0
            if name in BLOCK_ELEMENTS:
                end()
            open_.close(name)
    say(page[at:])
    end()
    return out


GOOD, BAD, OPEN = 1, 0, -1


def stop_share(block: Block) -> tuple[int, float]:
    """(words, the share of stop words)."""
    words = _WORD.findall(block.text.lower())
    return len(words), sum(w in STOP_WORDS for w in words) / max(1, len(words))


def first_pass(block: Block, known: bool = True, elsewhere: bool = False) -> int:
    """known: whether the page is in a language whose stop words are known. elsewhere: whether articles hold most of the page's words."""
    if block.doubt == CERTAIN:
        return BAD
    if elsewhere and not block.content:
        return BAD
    n, stops = stop_share(block)
    if block.doubt != FREE:
        if block.link_density > MAX_LINK_DENSITY / 2:
            return BAD
        if n >= SHORT_WORDS and (stops >= STOP_LOW or not known):
            return GOOD
        return BAD if block.doubt == WEAK else OPEN
    if block.content:
        return BAD if block.link_density >= ALL_LINKS and not block.headline else GOOD
    if block.link_density > MAX_LINK_DENSITY or n < LONG_WORDS and _NOTICE.search(block.text):
        return BAD
    if n < SHORT_WORDS:
        return OPEN
    if stops >= STOP_HIGH or n >= LONG_WORDS and (stops >= STOP_LOW or not known):
        return GOOD
    return OPEN if stops >= STOP_LOW or not known else BAD


def in_articles(found: list[Block]) -> bool:
    """Whether articles and main elements hold most words of what may be the article, links aside."""
    words = {True: 0, False: 0}
    for b in found:
        if b.doubt != CERTAIN and b.link_density <= MAX_LINK_DENSITY:
            words[b.content] += len(b.text.split())
    return words[True] > words[False]


def knows_language(found: list[Block]) -> bool:
    """Whether some block has stop words as text of a known language has them."""
    shares = (stop_share(b) for b in found)
    return any(n >= SHORT_WORDS and stops >= STOP_LOW for n, stops in shares)


def second_pass(found: list[Block], labels: list[int]) -> list[int]:
    out = list(labels)
    sizes = [len(b.text.split()) for b in found]
    n = len(found)
    left: list[tuple[int, int]] = [(OPEN, 0)] * n  # label of the last decided block, words since
    label, words = OPEN, 0
    for i in range(n):
        left[i] = label, words
        label, words = (labels[i], 0) if labels[i] != OPEN else (label, words + sizes[i])
    label, words = OPEN, 0
    for i in range(n - 1, -1, -1):
        if labels[i] == OPEN:
            one, far = left[i]
            if label == OPEN or one == OPEN:
                out[i] = max(label, one) if max(label, one) != OPEN else GOOD
            else:
                out[i] = one if one == label or far < words else label if words < far else GOOD
        label, words = (labels[i], 0) if labels[i] != OPEN else (label, words + sizes[i])
    return out


def main_text(page: str | None) -> str:
    if not page:
        return ""
    found = blocks(page)
    known, elsewhere = knows_language(found), in_articles(found)
    labels = second_pass(found, [first_pass(b, known, elsewhere) for b in found])
    return " ".join(b.text for b, label in zip(found, labels, strict=True) if label == GOOD)


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars (code points) of every page."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows in slices(batch, "html"):
                texts = [main_text(x) for x in rows.column("html").to_pylist()]
                # a reference such as &#xD800; must not end the job: it is not a character
                texts = [t if t.isascii() else t.encode("utf-8", "replace").decode() for t in texts]
                yield pa.RecordBatch.from_arrays([rows.column("page_id"), rows.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    return rows.mapInArrow(run, "page_id long, url string, text string, n_chars long")
