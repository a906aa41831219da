"""Main text of HTML pages by two-pass block rules.

A page is read once, tag by tag and in linear time, into blocks of text; of these only scripts, styles and the like are no
part. The first pass classifies every block by its density of stop words, its length and the share of its characters
inside links. Tags and names are features: an article element, a form, and a part whose name has a word like `related`
beside others, set how dense and long a block has to be. A part whose element or whole name says that it is a menu, an
advert, a notice or a comment is believed as long as dense text is found elsewhere; if it holds all of that (a layout
class on the page's frame, a menu that is never closed), its name says nothing. The second pass gives ambiguous and short
blocks the label of the nearest decided one.

Pages in a language without a list of stop words are measured by their sentence marks instead.
"""

from __future__ import annotations

import html
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

GOOD, BAD, SHORT, NEAR = "good", "bad", "short", "near"
#: Where a block stands: in an article element, in no such element, or in a part whose name contains a hint.
ARTICLE, PLAIN, HINTED = "article", "plain", "hinted"

#: Characters below which a block is short, and above which a dense one is good by itself.
SHORT_CHARS, LONG_CHARS = 70, 200
#: Shares of link characters, and of stop words for a good and a nearly good block.
LINKS, DENSE, SPARSE = 0.5, 0.30, 0.18
#: A page with a smaller share of stop words is in a language without a list; there a block is dense that has a sentence
#: mark for so many characters.
KNOWN, MARK_CHARS = 0.12, 250
#: Dense text that a part must hold for its name to be doubted: so many blocks, or characters.
DOUBT_BLOCKS, DOUBT_CHARS = 2, 400

# Elements whose content is not read as markup; elements never part of an article; elements that nest;
# elements that end a block; words of class, id and role names that mark other parts of a page; words that only say what holds such a part; common
# function words.
RAW = frozenset("script style textarea title noscript template iframe xmp noembed noframes svg math".split())
OUTSIDE = frozenset("nav footer aside button select dialog menu object audio video canvas map head".split())
CONTAINERS = frozenset("html head body nav header footer aside form button select dialog menu object audio video canvas map article main section div ul ol dl li table tbody thead tfoot tr td th figure figcaption blockquote details fieldset center".split())
BREAKS = CONTAINERS | frozenset("p h1 h2 h3 h4 h5 h6 pre hr dt dd address summary caption option legend".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
HINTS = frozenset(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner cookie cookies consent gdpr notice notices alert popup modal overlay "
    "sidebar widget widgets related recommended share sharing social comment comments disqus reply replies respond nav navbar navigation menu menubar breadcrumb breadcrumbs "
    "footer masthead newsletter subscribe subscription signup login search pagination pager toolbar skip copyright complementary contentinfo".split()
)
READERS = frozenset("comment comments disqus reply replies respond".split())  # of these, what readers wrote
HOLDERS = frozenset(
    "list box wrapper wrap container section block item items bar area inner outer slot unit button buttons link links post posts article articles content text title header head body form thread count "
    "top bottom left right main row col column group panel module message placeholder zone card cards icon icons tools tool site page global primary secondary".split()
)
STOP_WORDS = frozenset(
    "the of and to in a is that for it as was with be by on not he this are or his from at which but have an they you were her she there been one all we their has would will what if can when so no "
    "le la les de des du un une et est en que qui dans pour pas sur au aux par plus ne se ce il elle avec son sa ses mais ou nous vous leur "
    "der die das den dem des ein eine einer und ist in zu mit von auf für nicht sich es auch als an er sie wie aus bei nach wird sind oder aber vor zum zur "
    "el los las y del que en un una es por con para no se su al lo como más pero sus le ya o este sí porque muy sin sobre también me hasta hay donde".split()
)
_NAME = re.compile(r"(/?)([a-zA-Z][^\s/>]*)")
_OPENING = re.compile("<+")
_PLAIN_ATTRIBUTES = re.compile(r"[^>\"']*")
_NAMES = re.compile(r"\b(class|id|role|aria-hidden|hidden|style)\b\s*(?:=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.I)
_ENDS = {tag: re.compile(rf"</{tag}\b[^>]*>?", re.I) for tag in RAW}
_LETTERS = re.compile(r"[^\W\d_]+")
# Marks that end sentences or clauses, in any script; elements that a head may hold.
_MARKS = re.compile(r"[.!?,;:](?=\s|$)|[。、！？，；：．।۔؟،]")
IN_HEAD = frozenset("head html base link meta title style script noscript template".split())


@dataclass
class Block:
    text: str
    zone: str
    heading: bool
    link_chars: int
    parts: tuple[tuple[int, bool], ...] = ()  # number, and whether readers wrote it, of the parts named as other than article text that it lies in, from the outermost on
    label: str = ""
    density: float = 0.0

    def link_share(self) -> float:
        return self.link_chars / max(1, len(self.text))

    def stop_words(self) -> tuple[int, int]:
        """Stop words, and words."""
        words = [w.lower() for w in _LETTERS.findall(self.text)]
        return sum(w in STOP_WORDS for w in words), len(words)

    def dense(self) -> bool:
        """Text that could be an article's by itself."""
        return self.density >= SPARSE and len(self.text) >= SHORT_CHARS and self.link_share() <= LINKS


def measure(found: list[Block]) -> None:
    """The density of each block, by the page's language."""
    counts = [b.stop_words() for b in found]
    known = sum(n for n, _ in counts) >= KNOWN * sum(n for _, n in counts)
    for b, (stop, words) in zip(found, counts, strict=True):
        b.density = stop / max(1, words) if known else min(1.0, len(_MARKS.findall(b.text)) * MARK_CHARS / len(b.text) * DENSE)


def _named(attributes: str, in_article: bool) -> str:
    """GOOD, BAD for a part that is hidden or named as other than article text (every word of a name is a hint or says
    what holds it, as in ad-box), NEAR where a name has other words too (as in related-work)."""
    out = GOOD
    for m in _NAMES.finditer(attributes):
        name, value = m[1].lower(), (m[2] or m[3] or m[4] or "").lower()
        if name == "hidden" or name == "aria-hidden" and value == "true" or name == "style" and re.search(r"display\s*:\s*none", value):
            return BAD
        if name in ("class", "id", "role"):
            for token in re.sub(r"(?<=[a-z])(?=[A-Z])", "-", m[2] or m[3] or m[4] or "").lower().split():
                parts = set(re.split(r"[^a-z]+", token)) - {""}
                if parts & HINTS or not in_article and "header" in parts:
                    if parts <= HINTS | HOLDERS:
                        return BAD
                    out = NEAR
    return out


class _Tags:
    """Finds tags from left to right. A page without a `>`, a quote or an end further on is not searched for it again."""

    def __init__(self, page: str):
        self.page = page
        self.quotes = self.closed = True

    def end(self, at: int) -> int:
        """The place of the `>` that ends the tag whose name ends at `at`, outside quotes; -1 if there is none."""
        page, i = self.page, at
        while self.quotes:
            i = _PLAIN_ATTRIBUTES.match(page, i).end()
            if i == len(page):
                break
            if page[i] == ">":
                return i
            i = page.find(page[i], i + 1) + 1
            if not i:
                break
        self.quotes = False  # some quote is never closed before a tag's end: from here on they count as characters
        found = page.find(">", at) if self.closed else -1
        self.closed = found >= 0
        return found

    def after(self, at: int) -> tuple[int, str, bool, str]:
        """For a `<` at `at`: where reading goes on, and name, whether it closes, and attributes (no name: no element)."""
        page = self.page
        if page.startswith("<!--", at):
            end = page.find("-->", at + 4)
            return (end + 3 if end >= 0 else len(page)), "", False, ""
        m = _NAME.match(page, at + 1)
        if not m and page[at + 1 : at + 2] not in ("!", "?", "/"):
            return at, "", False, ""  # a character
        begin = m.end() if m else at + 2
        if m:
            end = self.end(begin)
        else:
            end = page.find(">", begin) if self.closed else -1
            self.closed = end >= 0
        if end < 0:  # broken off: up to the next tag
            following = page.find("<", begin)
            return (following if following >= 0 else len(page)), "", False, ""
        return end + 1, (m[2].lower() if m else ""), bool(m and m[1]), page[begin:end]


def blocks(page: str) -> list[Block]:
    """The page's blocks, in page order, decoded and with single spaces."""
    out: list[Block] = []
    stack: list[tuple[str, tuple[tuple[int, bool], ...], str]] = []  # element, the named parts it lies in or is, and the zone
    named_parts = 0
    open_ = Counter()
    parts: list[str] = []
    linked: list[str] = []
    links = breaks = at = 0
    heading = False
    tags = _Tags(page)

    def close() -> None:
        if parts:
            text = " ".join(html.unescape("".join(parts)).split())
            if text:
                anchor = " ".join(html.unescape("".join(linked)).split())
                out.append(Block(text, stack[-1][2] if stack else PLAIN, heading, len(anchor), stack[-1][1] if stack else ()))
            parts.clear()
            linked.clear()

    def add(text: str) -> None:
        if text:
            parts.append(text)
            if links:
                linked.append(text)

    while at < len(page):
        start = page.find("<", at)
        text = page[at:] if start < 0 else page[at:start]
        if text:
            if not text.isspace():
                breaks = 0
            add(text)
        if start < 0:
            break
        at, tag, closing, attributes = tags.after(start)
        if at == start:
            at = max(at + 1, _OPENING.match(page, at).end() - 1)
            add(page[start:at])
            continue
        if not tag:
            continue
        if tag in RAW:
            if not closing and not attributes.rstrip().endswith("/"):
                end = _ENDS[tag].search(page, at)
                at = end.end() if end else len(page)
            if tag not in ("svg", "math"):
                add(" ")
            continue
        if tag == "br":
            breaks += 1
            add(" ")
            if breaks > 1:
                close()
            continue
        if tag == "a":
            links = max(0, links + (-1 if closing else 1))
            continue
        if tag not in BREAKS:
            continue
        breaks = 0
        close()
        if stack and stack[-1][0] == "head" and not closing and tag not in IN_HEAD:
            stack.pop()  # its end tag may be left out
            open_["head"] -= 1
        if tag in CONTAINERS:
            if closing:
                while open_[tag]:
                    last = stack.pop()[0]
                    open_[last] -= 1
                    if last == tag:
                        break
                links = 0
            elif tag not in VOID:
                if tag == "li" and stack and stack[-1][0] == "li":
                    stack.pop()
                    open_["li"] -= 1
                around, zone = (stack[-1][1], stack[-1][2]) if stack else ((), PLAIN)
                named = GOOD if tag in ("html", "body") else _named(attributes, zone != PLAIN)
                if tag in OUTSIDE or tag == "header" and zone == PLAIN or named == BAD:
                    around = (*around, (named_parts, bool(READERS.intersection(re.split(r"[^a-z]+", attributes.lower())))))
                    named_parts += 1
                zone = HINTED if named == NEAR or tag == "form" and zone == PLAIN or zone == HINTED and tag not in ("article", "main") else ARTICLE if tag in ("article", "main") else zone
                stack.append((tag, around, zone))
                open_[tag] += 1
        else:
            heading = not closing and len(tag) == 2 and tag[0] == "h" and tag[1].isdigit()
            links = 0
    close()
    return out


def believed(found: list[Block]) -> set[tuple[int, bool]]:
    """The named parts that are what they are named. As long as all dense text lies in such parts, or all articles do with
    most of the dense text and no reader wrote them, the outermost of them that holds most is not."""
    out = {p for b in found for p in b.parts}
    dense = [b for b in found if b.dense()]
    total = sum(len(b.text) for b in dense)
    while out:
        inside: dict[tuple[int, bool], list[Block]] = {}
        free = [b for b in found if not out.intersection(b.parts)]
        for b in dense:
            if first := next((p for p in b.parts if p in out), None):
                inside.setdefault(first, []).append(b)
        if not inside:
            break
        most, held = max(inside.items(), key=lambda x: (not x[0][1], sum(len(b.text) for b in x[1]), -x[0][0]))
        size = sum(len(b.text) for b in held)
        enough = len(held) >= DOUBT_BLOCKS or size >= DOUBT_CHARS
        articles = any(b.zone == ARTICLE for b in held) and not any(b.zone == ARTICLE for b in free) and 2 * size >= total and not most[1]
        if not enough or any(b.dense() for b in free) and not articles:
            break
        out.remove(most)
    return out


def first_pass(b: Block, article: bool) -> str:
    """A block's label by itself; article: the page has an article element."""
    if b.link_share() > LINKS:
        # a sentence that is a link may belong to an article, a list of links does not
        return NEAR if b.zone == ARTICLE and b.density >= SPARSE else BAD
    if len(b.text) < SHORT_CHARS:
        return SHORT if b.zone == ARTICLE or not b.link_chars and not (article and b.zone == PLAIN) else BAD
    if b.zone == ARTICLE:
        return GOOD if b.density >= SPARSE else NEAR
    if b.density >= DENSE and len(b.text) > LONG_CHARS:
        return GOOD
    if article and b.zone == PLAIN:
        return BAD
    return NEAR if b.density >= SPARSE else BAD


def classify(found: list[Block]) -> None:
    """Labels each block good or bad: by itself, or else as the nearest decided block of its zone, or of any."""
    measure(found)
    names = believed(found)
    own = [b for b in found if not names.intersection(b.parts)]
    article = any(b.zone == ARTICLE for b in own)
    for b in found:
        b.label = BAD if names.intersection(b.parts) else first_pass(b, article)
    for b, label in [(b, label) for zone in (ARTICLE, PLAIN, HINTED) for b, label in _neighbours(own, zone)]:
        b.label = label
    if not any(b.label == GOOD for b in own):
        # an article of links only is an article
        for b in own:
            b.label = GOOD if b.zone == ARTICLE else b.label


def _neighbours(found: list[Block], zone: str) -> list[tuple[Block, str]]:
    """Ambiguous blocks of a zone and the labels they inherit."""
    own = [i for i, b in enumerate(found) if b.zone == zone]
    decided = [i for i in own if found[i].label in (GOOD, BAD)]
    if zone != ARTICLE or not decided:
        # what is in an article looks around there first
        decided = [i for i, b in enumerate(found) if b.label in (GOOD, BAD)] if zone != ARTICLE else []
    out = []
    for i in own:
        b = found[i]
        if b.label in (GOOD, BAD):
            continue
        k = bisect_left(decided, i)
        near = decided[max(0, k - 1) : k + 1]
        gap = min((abs(x - i) for x in near), default=0)
        labels = {found[x].label for x in near if abs(x - i) == gap}
        if len(labels) == 1:
            out.append((b, labels.pop()))
        else:
            out.append((b, GOOD if b.zone == ARTICLE or b.label == NEAR or labels and b.heading else BAD))
    return out


def main_text(page: str) -> str:
    """Good blocks, in page order, joined by two line feeds."""
    found = blocks(page)
    classify(found)
    return "\n\n".join(b.text for b in found if b.label == GOOD)


def extract_text(pages: DataFrame, *, html_col: str = "html", keep: tuple[str, ...] = ("page_id", "url"), text_col: str = "text") -> DataFrame:
    """The columns of keep and text_col string for every row of pages, from its whole html; a null or empty page gives
    an empty text. Other columns are not read; repeated rows give repeated rows; an empty table gives an empty table."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, 256):
                part = batch.slice(k, 256)
                texts = [main_text(x) if x else "" for x in part.column(part.num_columns - 1).to_pylist()]
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.array(texts, pa.string())], [*part.schema.names[:-1], "_text"])

    kept = pages.select(*keep, F.col(html_col).cast("string").alias("_text"))
    return kept.mapInArrow(run, kept.schema).withColumnRenamed("_text", text_col)
