"""HTML extraction: flat text blocks, classified by a decision tree over their and their neighbours' features.

A page is cut into flat blocks at block-level tags. A block has the number of its words, the share of them in links, the
same of the blocks before and after it, and three features of what encloses it: page furniture by tag or role, a class or id
that names such, an article. A name is no verdict: a marked element counts the less, the more of the page's words it holds,
unless an article lies outside it, so that a form or a "page-header-content" around everything is none. A decision
tree (Gini) over these features, grown here from the small labelled table below, tells main text from the rest. Each page
of the table is used with its marks and once more without any, as bare ``div``s, where word counts and links must do alone.

Reading a page takes time in proportion to its length, whatever it holds and however deep it is nested: marks are a chain from
each marked element to the next one around it, and what is in an element is summed up along the chain once, at the end.
"""

from __future__ import annotations

import functools
import html as entities
import random
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import tidy

TAG = re.compile(r"<(/?)([a-zA-Z][a-zA-Z0-9:-]*)")
#: The rest of a tag, up to its end: a quote matters after an equals sign only.
REST = re.compile(r"(?:[^>=]|=\s*+(?:\"[^\"]*+\"|'[^']*+')?+)*+>")
#: Elements whose content is no text of the page.
SILENT = frozenset("script style noscript template svg math iframe object head title select option textarea button datalist canvas audio video".split())
#: Those whose content is skipped up to their closing tag, and of them those without which the page ends (the others are then passed over).
RAW = frozenset("script style noscript template textarea title svg math iframe".split())
TO_THE_END = frozenset("script style textarea".split())
#: What a head may hold; anything else, and text, ends it.
OF_HEAD = frozenset("title meta link base script style noscript template".split())
FURNITURE = frozenset("nav header footer aside form dialog menu".split())
ARTICLE = frozenset("article main".split())
HOLDS = FURNITURE | ARTICLE | frozenset("div section ul ol dl table td th tr tbody thead figure details fieldset blockquote body".split())
BLOCK = HOLDS | frozenset("p h1 h2 h3 h4 h5 h6 li dt dd pre hr address caption figcaption html head summary center legend tfoot".split())
ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog form menu menubar".split())
#: Words of class and id names that mark what is not the article, and words that mark an article; the first of them in a name counts.
NAMES = frozenset(
    "ad ads adsbygoogle adbox adslot advert adverts advertisement advertising sponsor sponsored promo promotion banner cookie cookies consent gdpr notice notices popup modal overlay "
    "newsletter subscribe subscription sidebar aside rail nav navbar navigation menu breadcrumb breadcrumbs footer header masthead toolbar comment comments "
    "commentlist disqus replies respond discussion share sharing social related recommended widget pagination pager login signup search copyright "
    "werbung anzeige anzeigen hinweis hinweise kommentar kommentare fusszeile kopfzeile seitenleiste navigationsleiste brotkrumen teilen anmelden "
    "publicite publicites commentaire commentaires avis pied entete piedpage partager connexion barrelaterale filariane "
    "publicidad anuncio anuncios aviso avisos comentario comentarios cabecera encabezado piepagina barralateral compartir migas suscripcion".split()
)
MAIN_NAMES = frozenset("article content main post story entry body text".split())
#: Words after which a name says what an element has or lacks.
HAVING = frozenset("has with no without".split())
#: Names that say how a page is laid out: on a head line or a word in a line they mean nothing.
LAYOUTS = frozenset("banner notice notices sidebar aside rail nav navbar navigation menu footer header masthead toolbar login signup search".split())
#: Blocks that a following one of the same kind ends, and the lists in which they are.
ITEMS = {"li": (("li",), ("ul", "ol", "menu")), "dt": (("dt", "dd"), ("dl",)), "dd": (("dt", "dd"), ("dl",))}
#: Elements within a line; those with a mark are blocks of their own.
INLINE = frozenset("span a b strong em i u small label ins font sup sub".split())
TITLES = INLINE | frozenset("h1 h2 h3 h4 h5 h6".split())
WORDS_OF_NAME = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|\d+")
ATTRIBUTE = re.compile(r"([a-zA-Z-]+)\s*+=\s*+(?:\"([^\"]*+)\"|'([^']*+)'|([^\s\"'>]++))")
#: Styles by which an element is not shown.
UNSEEN = re.compile(r"(?:^|;)\s*+(?:display\s*+:\s*+none|visibility\s*+:\s*+(?:hidden|collapse))\b", re.I)
QUOTED = re.compile(r"=\s*+(?:\"[^\"]*+\"|'[^']*+'|[^\s\"'>]++)")
HIDDEN = re.compile(r"(?:^|\s)hidden(?=\s|/|$)", re.I)
FEATURES = ("words", "links", "words_before", "links_before", "words_after", "links_after", "furniture", "named", "article", "articles")


@dataclass
class Block:
    text: str
    words: int
    linked: int
    mark: int  # the innermost mark around it, -1: none
    article: bool
    silent: bool


@dataclass
class Page:
    """The blocks of a page, and of each mark the one around it (-1: none), whether it is a name, its words, and the articles in it."""

    blocks: list[Block]
    around: list[int]
    named: list[bool]
    words: list[int]
    held: list[int]
    articles: int


def _first_mark(name: str, layouts: bool) -> int:
    """-1 if the first telling word of a name marks what is not the article, 1 if it marks one, else 0."""
    before = ""
    for w in map(str.lower, WORDS_OF_NAME.findall(name)):
        if before not in HAVING:
            if w in NAMES and (layouts or w not in LAYOUTS):
                return -1
            if w in MAIN_NAMES:
                return 1
        before = w
    return 0


def _marks(tag: str, attributes: str) -> tuple[bool, bool]:
    """Whether a tag is page furniture by itself or its role, and whether its names mark it."""
    furniture, named = tag in FURNITURE, False
    if attributes:
        found = []
        for m in ATTRIBUTE.finditer(attributes):
            name, value = m[1].lower(), m[2] or m[3] or m[4] or ""
            if name == "role":
                furniture |= value.strip().lower() in ROLES
            elif name in ("class", "id"):
                found += [_first_mark(v, tag not in TITLES) for v in value.split()]
            elif name == "aria-hidden":
                named |= value == "true"
            elif name == "style":
                named |= UNSEEN.search(value) is not None
        named |= -1 in found and sum(found) < (0 if tag in ARTICLE else 1)
        named |= HIDDEN.search(QUOTED.sub("", attributes)) is not None
    return furniture, named


@functools.cache
def _closing(tag: str) -> re.Pattern:
    return re.compile(rf"</{tag}(?=[\s/>])[^>]*+>?", re.I)


def tokens(page: str) -> Iterator[tuple[str, str, str]]:
    """(kind, name, rest): text, start and end tags in order; comments and what is skipped are left out."""
    at, end = 0, len(page)
    quotes, absent = True, set()
    while at < end:
        start = page.find("<", at)
        if start < 0:
            yield "text", "", page[at:]
            return
        if start > at:
            yield "text", "", page[at:start]
        m = TAG.match(page, start)
        if m is None:
            if page.startswith("<!--", start):
                # An empty comment may end at once; one without an end goes to the end of the page.
                close = page.find(">", start) if page.startswith((">", "->"), start + 4) else page.find("-->", start + 4)
                at = end if close < 0 else page.index(">", close) + 1
            elif page.startswith(("<!", "<?", "</"), start):
                close = page.find(">", start)
                at = end if close < 0 else close + 1
            else:
                yield "text", "", "<"
                at = start + 1
            continue
        rest = REST.match(page, m.end()) if quotes else None
        if rest is None:
            # Without an end outside quotes the quotes are broken: from here on tags end at the next sign.
            quotes = False
            close = page.find(">", m.end())
            if close < 0:
                return  # the page ends within a tag
        else:
            close = rest.end() - 1
        tag, attributes = m[2].lower(), page[m.end() : close]
        at = close + 1
        if tag not in RAW:
            yield ("end" if m[1] else "start"), tag, attributes
        elif not m[1] and not attributes.endswith("/") and tag not in absent:
            found = _closing(tag).search(page, at)
            if found:
                yield "start", tag, attributes
                yield "end", tag, ""
                at = found.end()
            elif tag in TO_THE_END:
                return
            else:
                absent.add(tag)


class _Reader:
    """Flat blocks from tokens. An element on the stack is (tag, innermost mark, article, silent) as they hold inside it, and the place of the last one that is not inline."""

    def __init__(self):
        self.page = Page([], [], [], [], [], 0)
        self.stack: list[tuple[str, int, bool, bool, int]] = []
        self.open: dict[str, list[int]] = {}  # places on the stack by tags
        self.parts: list[str] = []
        self.linked = 0
        self.link = -1  # how many elements are around the open link, -1: none is open

    def inside(self) -> tuple[int, bool, bool]:
        return self.stack[-1][1:4] if self.stack else (-1, False, False)

    def end_block(self) -> None:
        if self.parts:
            words = entities.unescape("".join(self.parts)).split()
            if words:
                mark, article, silent = self.inside()
                self.page.blocks.append(Block(" ".join(words), len(words), min(self.linked, len(words)), mark, article, silent))
                if mark >= 0 and not silent:
                    self.page.words[mark] += len(words)
            self.parts.clear()
        self.linked = 0

    def leave(self, depth: int) -> None:
        """End the elements from that depth on."""
        while len(self.stack) > depth:
            self.open[self.stack.pop()[0]].pop()
        if self.link > len(self.stack):
            self.link = -1

    def text(self, piece: str) -> None:
        if self.stack and self.stack[-1][0] == "head" and not piece.isspace():
            self.leave(len(self.stack) - 1)
        self.parts.append(piece)
        if self.link >= 0:
            self.linked += len(piece.split())

    def _end_implied(self, tag: str) -> None:
        """End what an opening block ends without a tag: a head, a paragraph, and an item before the next one of its list."""
        if self.stack and self.stack[-1][0] == "head" and tag not in OF_HEAD:
            self.leave(len(self.stack) - 1)
        if self.open.get("p") and self.stack[-1][4] == self.open["p"][-1]:
            self.leave(self.open["p"][-1])
        ends, lists = ITEMS.get(tag, ((), ()))
        place = self.last_of(ends)
        if place > self.last_of(lists):
            self.leave(place)

    def last_of(self, tags) -> int:
        """The place of the innermost open element with one of the tags, -1 without any."""
        return max((self.open[t][-1] for t in tags if self.open.get(t)), default=-1)

    def tag(self, tag: str, attributes: str, closing: bool) -> None:
        if tag == "br":
            self.parts.append(" ")
        marked = None
        if tag not in BLOCK and tag not in SILENT:
            if tag not in INLINE:
                return
            # Unmarked ones only count within a marked one, whose end must be told from theirs.
            if not self.open.get(tag):
                marked = (False, False) if closing else _marks(tag, attributes)
                if not any(marked):
                    if tag == "a":
                        self.link = -1 if closing else len(self.stack)
                    return
        self.end_block()
        if not closing and (tag in BLOCK or tag in SILENT):
            self._end_implied(tag)
        if tag == "hr":
            return
        if closing:
            if self.open.get(tag):
                self.leave(self.open[tag][-1])
            if tag == "a":
                self.link = -1
            return
        furniture, named = marked or _marks(tag, attributes)
        mark, article, silent = self.inside()
        if tag == "header" and article:
            furniture = False  # an article's own header is a part of it
        for is_name in [False] * furniture + [True] * (named and tag not in ("html", "body", "main")):
            self.page.around.append(mark)
            self.page.named.append(is_name)
            self.page.words.append(0)
            self.page.held.append(0)
            mark = len(self.page.named) - 1
        if tag in ARTICLE and not silent:
            self.page.articles += 1
            if mark >= 0:
                self.page.held[mark] += 1
        place = len(self.stack)
        solid = place if tag not in INLINE else self.stack[-1][4] if self.stack else -1
        self.stack.append((tag, mark, article or tag in ARTICLE, silent or tag in SILENT, solid))
        self.open.setdefault(tag, []).append(place)
        if tag == "a":
            self.link = len(self.stack)


def read(page: str | None) -> Page:
    """The flat text blocks of a page in order; null counts as empty. Tags need not be balanced, nor be there at all."""
    reader = _Reader()
    for kind, name, rest in tokens(page or ""):
        if kind == "text":
            reader.text(rest)
        else:
            reader.tag(name, rest, kind == "end")
    reader.end_block()
    found = reader.page
    found.blocks = [b for b in found.blocks if not b.silent]
    # Marks inside come after those around them.
    for m in range(len(found.around) - 1, -1, -1):
        if found.around[m] >= 0:
            found.words[found.around[m]] += found.words[m]
            found.held[found.around[m]] += found.held[m]
    return found


def features(page: Page) -> np.ndarray:
    """One row for each block, by FEATURES; beyond the ends there are no words and no links.

    ``furniture`` and ``named`` are 0 outside marked elements, 1 in one that an article lies outside of, and else the share
    of the page's words that is outside it, half of it if it holds all of the page's articles. ``articles`` is the share of the page's words that articles hold.
    """
    found = page.blocks
    words = np.array([0, *(b.words for b in found), 0], float)
    share = np.array([0, *(b.linked / b.words for b in found), 0], float)
    total = max(1, sum(b.words for b in found))
    doubt = [1.0 if held < page.articles else (1 - n / total) / (2 if page.articles else 1) for n, held in zip(page.words, page.held)]
    strongest = [(0.0, 0.0)] * (len(doubt) + 1)  # by furniture and by name, of a mark and those around it; the last stands for none
    for m, (outer, is_name) in enumerate(zip(page.around, page.named)):
        by_kind = strongest[outer]
        strongest[m] = (by_kind[0], max(by_kind[1], doubt[m])) if is_name else (max(by_kind[0], doubt[m]), by_kind[1])
    flags = np.array([(*strongest[b.mark], b.article) for b in found], float).reshape(-1, 3)
    inside = np.full(len(found), sum(b.words for b in found if b.article) / total)
    return np.column_stack((words[1:-1], share[1:-1], words[:-2], share[:-2], words[2:], share[2:], flags, inside))


#: The labelled table: pages written for this purpose; blocks that start with "=" are main text (the mark is taken off).
LABELLED = (
    '<body><nav><ul><li><a href="/">home</a></li><li><a href="/n">news today</a></li></ul></nav><article><h1>=A river rises</h1><p>=The river rose by two metres over night and the old bridge was closed.</p><p>=Why?</p><p>=Nobody in the town could say how long it would last, and the rain went on.</p></article><footer>Printed by the town, all rights reserved, do not copy any of this.</footer></body>',
    '<body><div class="ad">Buy the best boots of the year now.</div><article><h1>=Boots</h1><p>=Boots were worn.</p><ul><li>=leather</li><li>=rubber</li></ul><p>=See <a href="/x">the old list of makers</a> for more.</p></article><div class="ad">Half price on all of our hats until the end of this week only.</div></body>',
    '<body><header><h2>The Daily Page</h2><p>News from the valley since the year of the flood.</p></header><div id="content"><h1>=On bread</h1><p>=Flour, water and salt are all that a good loaf needs, if there is time enough for it.</p><p>=Time is what bakers lack.</p></div><aside><h3>Most read</h3><ul><li><a href="/1">Ten pies to bake before the winter</a></li></ul></aside><footer><p>Contact us</p></footer></body>',
    '<body><div class="cookie-notice"><p>We use cookies to make this site work for you and our many partners.</p></div><main><h1>=The mill</h1><p>=The mill stood empty for a hundred years before anyone asked who owned it or why.</p><p>=It was sold.</p></main><section id="comments"><p>I remember the mill well, my aunt worked there for forty years of her life.</p><p>Nice!</p></section></body>',
    '<body><ul class="menu"><li><a href="/a">start</a></li><li><a href="/b">about us</a></li></ul><div><h2>=Winter</h2><p>=Snow fell on the third day and did not melt until the spring had come to the hills.</p><p>=Then it went.</p></div><form action="/s"><label>Your mail address</label><p>We never send more than one letter a week to you.</p></form><div class="sidebar"><p>About the author of these pages and the years spent on them.</p></div></body>',
    '<body><nav><a href="/">up</a> <a href="/2">next</a></nav><article><h1>=Night trains</h1><p>=They run again.</p><p>=From the capital to the coast takes nine hours, with a stop at the border for the papers.</p><aside><p>Tickets from nine, book early to be sure of a bed.</p></aside><p>=Sleep well.</p><div class="comments"><p>My train was late by three hours and nobody told us why that was.</p></div></article><footer>One two three.</footer></body>',
    '<body><div><a href="/1">one</a> <a href="/2">two</a> <a href="/3">three</a></div><div><p>=A page without an article tag has long paragraphs of plain words that are its text, as this one has.</p><p>=Short ones too.</p></div><div><a href="/t">terms of use</a> <a href="/p">privacy</a></div></body>',
    '<body><article><p>=The first line.</p><p>=The second line, with some more words than the first one had in it.</p></article><article><p>=The last line.</p></article><div><p>The site is run by friends.</p></div><div><a href="/m">more</a></div></body>',
    '<body><div class="page"><div class="top"><a href="/">The Valley Post</a> <a href="/w">Weather</a></div><div class="story"><h1>=Rain at last</h1><p>=After forty dry days the first rain fell on the valley in the night to Sunday, and it fell until noon.</p><p>=Farmers stood in it.</p><p>=More of it is to come in the week, as <a href="/f">the office of forecasts</a> said on Monday, though less than the fields would need.</p></div><div class="more"><a href="/1">Ten years of drought</a> <a href="/2">Where the water went</a></div></div></body>',
    '<body><form id="aspnetForm" action="/"><div class="nav"><a href="/">Start</a> <a href="/k">Contact</a></div><div><h1>=Old stairs</h1><p>=The stairs behind the church have two hundred steps, and nobody alive has seen them all repaired.</p><p>=Some are missing.</p><p>=The town has asked a mason from the south to look at what is left of the lower half before the winter.</p></div><div class="footer">Town of the old stairs</div></form></body>',
    '<head><title>Bees</title><body><ul><li><a href="/">Home</a></li><li><a href="/bees">Bees</a></li><li><a href="/honey">Honey</a></li></ul><div><h2>=Bees in May</h2><p>=In May the colony grows by a thousand bees a day, and the keeper looks for queens each week.</p><p>=Swarms leave at noon.</p><p>=A swarm that hangs in a low tree is easily caught in a box, if it is not windy and the box is dark.</p></div><ul><li><a href="/a">April</a></li><li><a href="/j">June</a></li></ul></body>',
    '<body><div class="page-header-content article-with-comments"><h1>=The clock</h1><p>=The clock in the tower has been four minutes late since the repair, which cost more than a new one.</p><p>=People like it.</p><p>=The council will not have it set, since half of the town has set its own clocks by it for so many years.</p><div class="comments"><p>Mine is five minutes late and I like it too.</p></div></div></body>',
    '<body><header><a href="/">The Beekeeper</a></header><nav><a href="/">Home</a> <a href="/all">All posts</a></nav><article><h1><a href="/honey">=Honey in the comb</a></h1><p>=Honey in the comb keeps for years if the wax is whole.</p><p>=Sources:</p><ul><li><a href="/s1">=The old book of bees</a></li><li><a href="/s2">=A letter on wax</a></li></ul><p>=Written down in May.</p></article><div><a href="/n">Next: the smoker</a></div><div>Written in a garden.</div></body>',
    '<body><nav><a href="/">Start page</a> <a href="/town">The town</a> <a href="/hours">Opening hours</a></nav><form action="/post" id="f"><article><h1>=The new well</h1><p>=The well on the square gives water again after ten years.</p><p>=Bring a jug.</p></article></form><footer>Office of the town, second floor, open on two days of the week.</footer></body>',
    '<body><div class="header"><a href="/">Salt and stone</a></div><div class="content"><h1>=How salt is dug</h1><p>=Salt lies in thick layers below the hills, left there by a sea that dried up long before there were people.</p><p>=It is dug with machines now.</p></div><div id="comments"><h3>Two answers</h3><article><p>My father dug salt by hand for thirty years in that mine.</p></article><article><p>Well told!</p></article></div></body>',
    '<body><nav><a href="/">Museum</a> <a href="/v">Visit</a> <a href="/c">Collection</a></nav><div class="page-header-content"><h1>=The blue cup</h1><p>=The blue cup was found in a garden, where a family had used it to water flowers for two generations.</p><p>=It is whole.</p><p>=Nobody knows who made it or for whom, but the glaze is that of the northern kilns.</p></div><footer><p>Closed on Mondays.</p></footer></body>',
    '<body><div class="sidebar-layout"><div class="sidebar"><p>Open from ten to six.</p><a href="/t">Tickets</a></div><div><h1>=Two paintings return</h1><p>=Two paintings that were lent to a museum abroad hang in the small hall again.</p><p>=They were missed.</p></div></div><footer>The friends of the museum</footer></body>',
    '<body><div class="layout has-sidebar"><article><h1>=The ferry</h1><p>=The ferry crosses four times a day, and once more on market days.</p><p class="advert">Rent a boat for the whole of the summer from our partners by the lake.</p><p>=Bring a coat.</p><ul><li>=bread</li><li class="comment">I took it twice and was sick both times, but the view is good.</li></ul><h3 class="related">More about boats</h3><p hidden>This text is not shown to anyone who reads the page.</p></article></div><footer>Two friends made this.</footer></body>',
)


BARE = re.compile(r"<(/?)(?:article|main|nav|header|footer|aside|section|form)\b[^>]*>|<(div|p|ul|li|h[1-6]|span)\b[^>]*>")


def bare(page: str) -> str:
    """A page without any marks: elements that mean something become plain ones, attributes go but those of links."""
    return BARE.sub(lambda m: f"<{m[2]}>" if m[2] else f"<{m[1]}div>", page)


def cropped(page: str) -> list[str]:
    """A page without what comes before its main text, without what comes after it, and without both."""
    first, last = re.search(r"<[^<>]*>(?=(?:<[^<>]*>)*=)", page).start(), page.rindex(">=")
    last = page.index("<", last + 2)
    return [page[first:], page[:last], page[first:last]]


def fragments(page: str) -> list[str]:
    """Pages that hold one to three of its main blocks, one after the other, and nothing else: what has no company is main text."""
    main = re.findall(r">(=[^<>]+)<", page)
    return ["".join(f"<p>{t}</p>" for t in main[i : i + n]) for n in (1, 2, 3) for i in range(len(main) - n + 1)]


#: Each page is used so often with marks, its texts cut or repeated to lengths at random: what encloses a text shall count for
#: more than its length where there is something.
VARIANTS = 24
LENGTHS = (1, 2, 3, 5, 8, 13, 21, 34)


def varied(page: str, seed: int) -> str:
    rng = random.Random(seed)

    def resized(m: re.Match) -> str:
        words, length = m[1].lstrip("=").split(), rng.choice(LENGTHS)
        return f">{'=' * m[1].startswith('=')}{' '.join((words * length)[:length])}<"

    return re.sub(r">([^<>]+)<", resized, page)


def labelled() -> tuple[np.ndarray, np.ndarray]:
    """Features and labels of all blocks of the labelled table, with marks in variants of length, and bare; whole and cropped."""
    rows, labels = [], []
    for page in LABELLED:
        parts = [page, *cropped(page)]
        made = [*parts, *map(bare, parts), *fragments(page), *(varied(parts[v % 4], v) for v in range(VARIANTS)), *(varied(f, v) for v, f in enumerate(fragments(page)))]
        for found in map(read, made):
            labels += [b.text.startswith("=") for b in found.blocks]
            rows.append(features(found))
    return np.vstack(rows), np.array(labels)


def grow(x: np.ndarray, y: np.ndarray, deepest: int = 9, least: int = 12):
    """A tree by Gini impurity: a float (the share of main text) or (feature, threshold, below or at, above)."""
    share = float(y.mean())
    if deepest == 0 or share in (0.0, 1.0) or len(y) < 2 * least:
        return share
    best = (share * (1 - share) * len(y) - 1e-12, None, None)
    for f in range(x.shape[1]):
        values = np.unique(x[:, f])
        for t in (values[:-1] + values[1:]) / 2:
            below = x[:, f] <= t
            a, b = y[below], y[~below]
            if min(len(a), len(b)) >= least and (cost := a.mean() * (1 - a.mean()) * len(a) + b.mean() * (1 - b.mean()) * len(b)) < best[0]:
                best = (cost, f, float(t))
    if best[1] is None:
        return share
    below = x[:, best[1]] <= best[2]
    return best[1], best[2], grow(x[below], y[below], deepest - 1, least), grow(x[~below], y[~below], deepest - 1, least)


def trained():
    return grow(*labelled())


def is_main(tree, row) -> bool:
    while isinstance(tree, tuple):
        tree = tree[2] if row[tree[0]] <= tree[1] else tree[3]
    return tree >= 0.5


def main_text(page: str | None, tree) -> str:
    """The blocks of main text in page order, one to a line; empty if there are none."""
    found = read(page)
    return "\n".join(b.text for b, row in zip(found.blocks, features(found).tolist()) if is_main(tree, row)) if found.blocks else ""


def extract(pages: DataFrame, html: str = "html", out: str = "text") -> DataFrame:
    """``pages`` without the html column, with ``out`` and ``n_chars`` (its code points); same names are replaced.

    Null, empty and broken html give what text there is, else the empty string. Every block of every page is classified,
    however long. Other columns, rows and repeated rows stay as they are; empty tables give empty ones.
    """
    from pyspark.sql.types import LongType, StringType, StructField, StructType

    tree = trained()
    kept = pages.select(*[F.col(f"`{c}`") for c in pages.columns if c not in (html, out, "n_chars")], F.col(html).cast("string").alias("_html"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            last = batch.num_columns - 1
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                texts = [main_text(p.as_py(), tree) for p in part.column(last)]
                yield pa.RecordBatch.from_arrays([*part.columns[:last], pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=[*batch.schema.names[:last], out, "n_chars"])
        tidy()

    return kept.mapInArrow(run, StructType([*kept.schema.fields[:-1], StructField(out, StringType()), StructField("n_chars", LongType())]))
