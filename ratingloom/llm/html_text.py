"""Main text of web pages by two-pass block rules.

A page is cut into blocks at block-level tags. The first pass judges each
block by itself: link density, length and the share of stop words make it
good, bad, or - if it is too short to tell - open. In the second pass an open
block takes the label of its nearest decided neighbours: good between good
ones, and where they differ, that of the nearer one. Markup that says what it
holds (nav, footer, form, an advert's class ...) decides a block beforehand,
as does the inside of scripts and styles, which is no text at all. Names do not
decide over html, body, main and article, nor over what holds main or article.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame

# Frequent function words of English, German, French and Spanish.
STOP_WORDS = frozenset(
    """
    the of and to in a is that for it as was with be by on not he his but at are this have from or had an they which
    one you were all her she there would their we him been has when who will no more if out so up said what its about
    into than them can only other time new some could these two may first then do any like my now over such our
    der die und in den von zu das mit sich des auf für ist im dem nicht ein eine als auch es an werden aus er hat dass
    sie nach wird bei einer um am sind noch wie einem über so zum war haben nur oder aber vor zur bis mehr durch man
    le la les de des du un une et à en dans est que qui pour pas au sur ne se ce il sont plus par avec tout faire son
    nous vous mais ou si leur y dont aux elle cette entre être ont même ces
    el los las del y en un una por con para al lo como su más pero sus le ya o este sí porque esta entre cuando muy sin
    sobre también me hasta hay donde quien desde todo nos durante uno ni contra ese eso ante ellos esto son fue
    """.split()
)

# Element names by what they mean for the text.
RAW_TEXT = frozenset("script style iframe textarea title".split())
NO_TEXT = RAW_TEXT | frozenset("noscript template svg object select".split())
BLOCK = frozenset(
    """
    address article aside blockquote body br button canvas caption center col colgroup dd details dialog dir div dl dt
    fieldset figcaption figure footer form frame frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li link
    main menu meta nav ol optgroup option p pre section summary table tbody td tfoot th thead title tr ul video audio
    """.split()
)
ASIDE = frozenset("nav footer aside form menu dialog button fieldset head".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
HEADING = frozenset("h1 h2 h3 h4 h5 h6".split())

#: Elements that their class and id names never put beside the article, nor the elements around article and main.
NEVER_NAMED = frozenset("html body main article".split())

# Parts of class and id names, and roles, of what is not the article. All parts of a name must be such words or
# words for a place or a container.
ASIDE_WORDS = frozenset(
    """
    ad ads banner nav navbar navigation menu menus sidebar side footer foot masthead breadcrumb breadcrumbs cookie cookies
    consent notice popup modal overlay newsletter subscribe signup login share sharing social related comment comments reply
    replies disqus respond widget widgets toolbar pager pagination tag tags copyright legal
    """.split()
)
ASIDE_STARTS = ("advert", "sponsor", "promo", "recommend")
PLACE_WORDS = frozenset(
    """
    site page top bottom left right global main primary secondary list box bar link links button buttons posts articles
    body section container area wrapper wrap block item items user users thread inner outer holder slot unit panel row col
    column group module region zone content text author meta header title form count
    """.split()
)
HEADER_PLACES = frozenset("site page top global main".split())
_PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|[^\W\d_]+")
_ASIDE_ROLES = re.compile(r"navigation|banner|contentinfo|complementary|search|form|dialog|alert", re.IGNORECASE)

_TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*+)")
#: The rest of a tag, which quotes may carry over a sign that ends it.
_REST = re.compile(r"(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+>")
_ENDS = {name: re.compile(rf"</{name}(?:\s[^<>]*+|/)?>", re.IGNORECASE) for name in NO_TEXT}
_SAME = {name: re.compile(rf"<(/?){name}(?=[\s/>])[^<>]*+>", re.IGNORECASE) for name in NO_TEXT - RAW_TEXT}
#: A tag without its end, or with an open quote.
_UNFINISHED = re.compile(r"<[/!?]?[a-zA-Z][^<>]*+(?:>|\Z)")
_NAMES = re.compile(r"\b(?:class|id)\s*+=\s*+(?:\"([^\"]*+)\"|'([^']*+)'|([^\s>]++))", re.IGNORECASE)
_ROLE = re.compile(r"\brole\s*+=\s*+[\"']?([a-z]+)", re.IGNORECASE)
_SPACES = re.compile(r"\s+")
_EDGE = re.compile(r"^\W+|\W+$")
_SENTENCE = re.compile(r"[.!?\u2026\u3002\uff01\uff1f\u0964\u06d4][\"'\u201d\u2019\u00bb)\]]*$")


@dataclass(frozen=True)
class BlockParams:
    """A block is bad above ``max_links`` (share of its characters inside links). Up to
    ``short`` characters it is open; longer ones are good with ``good_stops`` of stop words, bad under
    ``bad_stops``, and in between good if longer than ``long`` characters, else open.
    Where the nearest decided blocks differ, one further than ``reach`` blocks away does not count.
    """

    max_links: float = 0.35
    short: int = 80
    long: int = 200
    good_stops: float = 0.25
    bad_stops: float = 0.05
    reach: int = 8


@dataclass
class Element:
    """An open block-level element; ``aside`` is whether it is beside the article, ``named`` whether its names say so."""

    name: str
    parent: Element | None
    aside: bool = False
    named: bool = False
    holds: bool = False
    beside: bool = False


@dataclass
class Block:
    text: str
    links: int
    heading: bool
    aside: bool
    main: bool
    label: str = ""
    paragraph: bool = False


class _Markup:
    """Comments, declarations and tags of a page, found from left to right.

    A search that fails is not made again, so the time is in proportion to the page: after the last
    sign that can end a tag there is none, and once quotes have run to the end of the page tags end at the next sign.
    """

    def __init__(self, page: str):
        self.page, self.last, self.broken = page, page.rfind(">"), False

    def next(self, at: int) -> tuple[int, int, bool, str | None, str] | None:
        """(start, end, whether it closes, name, attributes); no name for what is not a tag."""
        page = self.page
        while (start := page.find("<", at)) >= 0:
            if page.startswith("<!--", start):
                end = page.find("-->", start + 4)
                return start, len(page) if end < 0 else end + 3, False, None, ""
            if start > self.last:
                # only a comment without end may follow
                at = page.find("<!--", start)
                return None if at < 0 else (at, len(page), False, None, "")
            if page.startswith(("<!", "<?"), start):
                return start, page.find(">", start) + 1, False, None, ""
            if tag := _TAG.match(page, start):
                rest = None if self.broken else _REST.match(page, tag.end())
                self.broken = rest is None
                end = rest.end() if rest else page.find(">", tag.end()) + 1
                return start, end, bool(tag[1]), tag[2].lower(), page[tag.end() : end - 1]
            at = start + 1
        return None


class _Skips:
    """Where elements without text end. Elements of raw text without an end tag go on to the end of the page,
    of others only the tag is left out."""

    def __init__(self, page: str):
        self.page = page
        self.endless: set[str] = set()
        self.uneven: set[str] = set()

    def end(self, name: str, at: int) -> int:
        if name not in RAW_TEXT and name not in self.uneven:
            depth = 1
            for tag in _SAME[name].finditer(self.page, at):
                if tag[1]:
                    depth -= 1
                elif not tag[0].endswith("/>"):
                    depth += 1
                if not depth:
                    return tag.end()
            self.uneven.add(name)  # such a page is not searched for pairs again
        found = None if name in self.endless else _ENDS[name].search(self.page, at)
        if found:
            return found.end()
        self.endless.add(name)
        return len(self.page) if name in RAW_TEXT else at


def blocks_of(page: str) -> list[Block]:
    """Blocks of a page in order, white space joined to single spaces, empty ones left out."""
    found: list[Block] = []
    places: list[Element] = []  # innermost element of each block
    parts: list[str] = []
    state = {"links": 0, "heading": False}
    top = Element("", None)
    elements = [top]  # in the order in which they begin
    open_tags = [top]
    in_link, main = 0, 0
    skips, markup, depth = _Skips(page), _Markup(page), Counter()

    def flush() -> None:
        raw = "".join(parts)
        parts.clear()
        text = _SPACES.sub(" ", html.unescape(raw)).strip() if raw else ""
        if text:
            found.append(Block(text, state["links"], state["heading"], False, main > 0, paragraph=open_tags[-1].name == "p"))
            places.append(open_tags[-1])
        state["links"] = 0

    at = 0
    while found_tag := markup.next(at):
        start, end, closing, name, attributes = found_tag
        piece, at = page[at:start], end
        if piece:
            parts.append(piece)
            if in_link:
                state["links"] += len(html.unescape(piece).strip())
        if name is None:
            continue
        if name in NO_TEXT and not closing:
            if name != "svg" or not attributes.endswith("/"):
                at = skips.end(name, at)
            continue
        if name == "a":
            in_link = 0 if closing else 1
            continue
        if name not in BLOCK:
            continue
        flush()
        if name in HEADING:
            state["heading"] = not closing
        if name in VOID:
            continue
        if not closing:
            if name == "p":
                in_link = 0  # a link does not go on into the next paragraph
                if open_tags[-1].name == "p":
                    depth["p"] -= 1
                    open_tags.pop()  # a paragraph ends the one before
            aside = name in ASIDE or _has_aside_role(attributes) or (name == "header" and not main)
            element = Element(name, open_tags[-1], aside, name not in NEVER_NAMED and _has_aside_name(attributes))
            elements.append(element)
            open_tags.append(element)
            depth[name] += 1
            if name in ("article", "main"):
                main += 1
                holder = element
                while holder and not holder.holds:
                    holder.holds, holder = True, holder.parent
        elif depth[name]:
            while True:
                tag = open_tags.pop()
                depth[tag.name] -= 1
                main -= tag.name in ("article", "main")
                if tag.name == name:
                    break
    parts.append(_UNFINISHED.sub("", page[at:]))
    flush()
    for element in elements[1:]:
        element.beside = element.parent.beside or element.aside or (element.named and not element.holds)
    for block, place in zip(found, places):
        block.aside = place.beside
    return found


def _has_aside_name(attributes: str) -> bool:
    for match in _NAMES.finditer(attributes):
        if any(map(is_aside_name, (match[1] or match[2] or match[3] or "").split())):
            return True
    return False


def is_aside_name(name: str) -> bool:
    """Whether all parts of a class or id name are words of what stands beside an article, or of places for it."""
    parts = [part.lower() for part in _PART.findall(name)]
    aside = [part in ASIDE_WORDS or part.startswith(ASIDE_STARTS) for part in parts]
    if any(aside):
        return all(a or part in PLACE_WORDS for a, part in zip(aside, parts))
    return len(parts) == 2 and parts[0] in HEADER_PLACES and parts[1] == "header"


def _has_aside_role(attributes: str) -> bool:
    role = _ROLE.search(attributes)
    return bool(role and _ASIDE_ROLES.fullmatch(role[1]))


def judge(block: Block, params: BlockParams) -> str:
    """First pass: good, bad or open."""
    size = len(block.text)
    # a paragraph of an article may be made of links
    if block.aside or (block.links > params.max_links * size and not (block.main and block.paragraph)):
        return "bad"
    if size <= params.short or block.heading:
        return "open"
    words = block.text.lower().split(" ")
    stops = sum(_EDGE.sub("", w) in STOP_WORDS for w in words) / len(words)
    if stops >= params.good_stops:
        return "good"
    if stops < params.bad_stops and not block.main:
        return "bad"
    return "good" if size > params.long else "open"


def judge_all(blocks: list[Block], params: BlockParams) -> None:
    """First pass over a page. If its stop words are in no listed language, nothing is good by them: then blocks that are
    long and not made of links are good, or, where there are none, those that end as sentences do.
    """
    for block in blocks:
        block.label = judge(block, params)
    if any(b.label == "good" for b in blocks):
        return
    plain = [b for b in blocks if not b.aside and not b.heading and b.links <= params.max_links * len(b.text)]
    for block in [b for b in plain if len(b.text) > params.short] or [b for b in plain if _SENTENCE.search(b.text)]:
        block.label = "good"


def settle(blocks: list[Block], params: BlockParams) -> None:
    """Second pass: open blocks take the label of the nearest decided neighbours.

    A block inside an article element counts as decided good where its
    neighbours leave it open; a heading looks at what follows first.
    """
    labels = [b.label for b in blocks]
    ahead, behind = [None] * len(blocks), [None] * len(blocks)
    last = None
    for i, label in enumerate(labels):
        behind[i] = last
        if label != "open":
            last = i
    last = None
    for i in range(len(blocks) - 1, -1, -1):
        ahead[i] = last
        if labels[i] != "open":
            last = i
    for i, block in enumerate(blocks):
        if labels[i] != "open":
            continue
        # a neighbour from beside the article says nothing about what is inside it, and the other way round
        near = [j for j in (behind[i], ahead[i]) if j is not None and blocks[j].main == block.main]
        near = [j for j in near if abs(j - i) <= params.reach] or near
        kinds = {labels[j] for j in near}
        if block.main and "good" not in kinds:
            block.label = "good" if not kinds else "bad"
        elif len(kinds) == 1:
            block.label = kinds.pop()
        elif not kinds:
            block.label = "bad"
        elif block.heading:
            block.label = labels[ahead[i]] if ahead[i] in near else labels[near[0]]
        else:
            block.label = labels[min(near, key=lambda j: (abs(j - i), labels[j] == "bad"))]


def extract(page: str | None, params: BlockParams = BlockParams()) -> str:
    """The main text: blocks judged good, joined by empty lines; empty without any."""
    blocks = blocks_of(page or "")
    judge_all(blocks, params)
    settle(blocks, params)
    return "\n\n".join(b.text for b in blocks if b.label == "good")


def main_text(pages: DataFrame, params: BlockParams = BlockParams()) -> DataFrame:
    """``pages`` (page_id, url, html) as (page_id, url, text, n_chars).

    A null or empty html, and a page without main text, give an empty text of
    0 characters. Whole pages count; repeated rows are answered each time and
    other columns are not read. Unclosed elements end with their parent,
    unclosed comments and scripts with the page; an unfinished tag at the end of
    the page is left out.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [extract(x, params) for x in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())],
                ["page_id", "url", "text", "n_chars"],
            )

    kind = pages.schema["page_id"].dataType.simpleString()
    return pages.select("page_id", "url", "html").mapInArrow(run, f"page_id {kind}, url string, text string, n_chars long")
