"""HTML extraction by two passes of block rules.

A page is cut into blocks at block-level tags. Blocks inside elements that never hold the
article (navigation, forms, scripts, comments of readers and the like, by tag, role, or a
class or id that names such a part) are out. First pass: link density, length and stop-word density call the others
good, bad or ambiguous; where stop words say nothing, as in other scripts and languages, the
marks that end sentences do. Second pass: headings and short or ambiguous blocks take the label
of their nearest decided neighbours. An ``article`` or ``main`` element decides no block by
itself, it breaks ties: many links or few stop words inside one are ambiguous rather than bad,
and where neighbours disagree or none is decided, a block inside one is good. End tags are
matched at any depth, and those that HTML lets pages leave out (of paragraphs, list items, rows,
cells and the head) are implied; a slash ends an element only where it isn't part of a value.

Null and empty pages give the empty text; a page of any length is read whole. Rows stand alone,
so repeated ones get the same text; other columns pass unread. An empty table gives no row.
"""

from __future__ import annotations

import html as entities
import re

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Tags that end a block, tags that are skipped whole, void tags, words that name what surrounds an article.
BLOCK_TAGS = frozenset("address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead title tr ul".split())
SKIPPED_TAGS = frozenset("nav header footer aside form menu button select option textarea dialog iframe object canvas svg head template noscript".split())
RAW_TAGS = frozenset("script style textarea title noscript iframe template".split())
VOID_TAGS = frozenset("area base br col embed hr img input link meta param source track wbr".split())
CHROME = re.compile(r"(?:ads?|advert\w*|banners?|breadcrumbs?|comments?|cookies?|consent|disqus|footer|header|masthead|menu|modal|nav\w*|newsletter|notices?|popup|promo\w*|related|repl(?:y|ies)|share|sharing|sidebar|social|sponsor\w*|subscribe|toolbar|widgets?)")
#: What may stand behind such a word in a name, and what before it says that the part isn't there, or that another has it.
LAYOUT = frozenset("area bar block box bottom buttons col column container content footer form group header inline inner item items left links list main menu modal nav outer panel primary right secondary section slot thread top unit widget wrap wrapper".split())
ABSENT = frozenset("has hide hides no non not off with without".split())
#: What a start tag ends where the end tag was left out: items up to the next special element, rows and cells up to their table.
ITEMS = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd")}
CELLS = {"td": ("td", "th"), "th": ("td", "th"), "tr": ("tr", "td", "th")} | dict.fromkeys(("thead", "tbody", "tfoot"), ("thead", "tbody", "tfoot", "tr", "td", "th"))
SPECIAL = BLOCK_TAGS - {"address", "div", "p"}
ROLES = frozenset("navigation banner contentinfo complementary search dialog alert form menu".split())
STOP_WORDS = frozenset("a and are as at be by for from has have he in is it not of on or that the this to was were which with aber als auch auf das dem den der des die ein eine er es für im ist mit nicht sich sie und von zu con de del el en la las lo los no para por que se su un una y au aux ce dans des du elle est et il je le les ne pas plus pour qui sur une".split())
FEW_CHARS, MANY_CHARS, LOW_STOPS, HIGH_STOPS, MOST_LINKS = 70, 200, 0.1, 0.2, 0.33
#: Words of a sentence, on average, and a block's characters in scripts that take few.
LEAST_WORDS, MOST_WORDS, FEW_SIGNS = 4, 60, 20

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>", re.S)
_ATTR = re.compile(r"\b(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_WORD = re.compile(r"\w+")
_CLOSED = re.compile(r"(?:^|[\s\"'])/$")
_SENTENCE = re.compile(r"[.!?…](?=[\s\"'»”)]|$)|[。！？।؟۔]")
_SPACE = re.compile(r"\s+")


def _names_chrome(value: str) -> bool:
    """Whether a class or an id names a part around the article: by the word itself, behind other words, or before one of layout."""
    for name in value.lower().split():
        parts = re.split(r"[-_]+", name.strip("-_"))
        if ABSENT & set(parts):
            continue
        while len(parts) > 1 and (parts[-1] in LAYOUT or parts[-1].isdigit()) and not CHROME.fullmatch(parts[-1]):
            parts.pop()
        if CHROME.fullmatch(parts[-1]):
            return True
    return False


def _own_script(text: str) -> bool:
    """Whether most letters are of scripts that the stop words aren't written in."""
    if max(text, default="") <= "\u024f":
        return False
    letters = [c for c in text if c.isalpha()]
    return 2 * sum(ord(c) > 0x24F for c in letters) > len(letters)


def _prose(text: str, words: int, own_script: bool) -> bool:
    """Whether a block reads as sentences, whatever their language."""
    ends = len(_SENTENCE.findall(text))
    if own_script:
        return ends > 0 and len(text) >= FEW_SIGNS
    return ends >= 2 and len(text) > 2 * FEW_CHARS and LEAST_WORDS * ends <= words <= MOST_WORDS * ends


def _surrounds(tag: str, attrs: str) -> bool:
    if tag in SKIPPED_TAGS:
        return True
    if not attrs or tag in ("html", "body", "main"):
        return False
    for m in _ATTR.finditer(attrs):
        value = m[2] or m[3] or m[4] or ""
        if value.lower() in ROLES if m[1].lower() == "role" else _names_chrome(value):
            return True
    return "hidden" in attrs.lower().split()


def blocks(page: str) -> list[tuple[str, int, bool, int]]:
    """Text, characters in links, whether a heading, and the number of the article it is in, of each block outside the surroundings.

    Numbers count from 1; in a ``main`` without an article they are negative, and 0 is outside of both.
    """
    out: list[tuple[str, int, bool, int]] = []
    inside: list[int] = []  # the articles that are open
    met = 0
    parts: list[str] = []
    linked: list[str] = []
    stack: list[tuple[str, bool]] = []  # open elements and whether each starts surroundings
    places: dict[str, list[int]] = {}  # where in the stack the elements of a tag are
    special: list[int] = []  # where its special elements are
    skipping = links = 0
    heading = False
    at, n = 0, len(page)

    def decoded(pieces: list[str]) -> str:
        return _SPACE.sub(" ", entities.unescape("".join(pieces))).strip()

    def end_block() -> None:
        nonlocal heading
        text = decoded(parts)
        if text:
            number = next((x for x in reversed(inside) if x > 0), inside[-1] if inside else 0)
            out.append((text, len(decoded(linked)), heading, number))
        parts.clear()
        linked.clear()
        heading = False

    def text_until(stop: int) -> None:
        if stop > at and not skipping:
            parts.append(page[at:stop])
            if links:
                linked.append(page[at:stop])

    def close(place: int) -> None:
        nonlocal skipping, links
        while len(stack) > place:
            name, out_of = stack.pop()
            places[name].pop()
            if name in SPECIAL:
                special.pop()
            skipping -= out_of
            if name in ("article", "main"):
                inside.pop()
            links -= name == "a"

    for m in _TOKEN.finditer(page):
        if m.start() < at:
            continue
        text_until(m.start())
        at = m.end()
        if m[2] is None:
            continue
        tag = m[2].lower()
        if tag in BLOCK_TAGS:
            end_block()
        elif tag == "br" and not skipping:
            parts.append(" ")
        if m[1]:
            if places.get(tag):
                close(places[tag][-1])
            continue
        if tag in RAW_TAGS:
            shut = re.compile(rf"</{tag}\s*>", re.I).search(page, at)
            at = shut.end() if shut else n
            continue
        if tag in VOID_TAGS or _CLOSED.search(m[3]):
            continue
        if stack and (stack[-1][0] == "head" or (tag in BLOCK_TAGS and stack[-1][0] == "p")):
            close(len(stack) - 1)
        if tag in ITEMS and special and stack[special[-1]][0] in ITEMS[tag]:
            close(special[-1])
        elif tag in CELLS:
            outside = places["table"][-1] if places.get("table") else -1
            open_cells = [places[c][-1] for c in CELLS[tag] if places.get(c) and places[c][-1] > outside]
            if open_cells:
                close(min(open_cells))
        surrounds = _surrounds(tag, m[3]) and not (tag == "header" and inside)
        places.setdefault(tag, []).append(len(stack))
        if tag in SPECIAL:
            special.append(len(stack))
        stack.append((tag, surrounds))
        skipping += surrounds
        if tag in ("article", "main"):
            met += 1
            inside.append(met if tag == "article" else -met)
        links += tag == "a"
        heading = heading or tag in ("h1", "h2", "h3", "h4", "h5", "h6")
    text_until(n)
    end_block()
    return out


def _decided(labels: list[str], scopes: list[int]) -> list[str | None]:
    """For each block the label of the last decided one before it, in its article if it is in one."""
    out, last = [], {}
    for label, scope in zip(labels, scopes, strict=True):
        out.append(last.get(max(scope, 0)))
        if label in ("good", "bad"):
            last[0] = label
            if scope > 0:
                last[scope] = label
    return out


def main_text(page: str | None) -> str:
    found = blocks(page or "")
    labels: list[str] = []
    for text, linked, heading, inside in found:
        words = _WORD.findall(text.lower())
        stops = sum(w in STOP_WORDS for w in words) / max(1, len(words))
        own_script = _own_script(text)
        prose = _prose(text, len(words), own_script)
        if linked > MOST_LINKS * len(text):
            labels.append("linked")
        elif heading or (len(text) < FEW_CHARS and not (own_script and prose)):
            labels.append("short")
        elif stops >= HIGH_STOPS or (len(text) > MANY_CHARS and stops >= LOW_STOPS) or prose:
            labels.append("good")
        else:
            labels.append("near" if stops >= LOW_STOPS or inside else "bad")
    scopes = [b[3] for b in found]
    told = {scope for label, scope in zip(labels, scopes, strict=True) if label == "good"}
    # links in an article that tells something are part of it; elsewhere they lead away
    labels = [("near" if scope > 0 and scope in told else "bad") if label == "linked" else label for label, scope in zip(labels, scopes, strict=True)]
    before, after = _decided(labels, scopes), _decided(labels[::-1], scopes[::-1])[::-1]
    keep = []
    for k, (text, _, heading, inside) in enumerate(found):
        label, sides = labels[k], {before[k], after[k]} - {None}
        if heading and label == "short":
            sides = {after[k]} - {None}  # a heading belongs to what follows
        tie = inside != 0 and len(sides) != 1
        # an ambiguous block needs one good side, a short one no bad side either
        good = label == "good" or (label == "short" and (sides == {"good"} or tie)) or (label == "near" and ("good" in sides or tie))
        if good:
            keep.append(text)
    return "\n".join(keep)


def extract(page: Column) -> Column:
    """The main text of a page."""

    @F.arrow_udf("string")
    def extracted(pages: pa.Array) -> pa.Array:
        return pa.array([main_text(p.as_py()) for p in pages], pa.string())

    return extracted(page)
