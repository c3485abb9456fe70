"""Blocks of text of a web page: one scan from left to right, in time linear in the page's length.

Tags are read as browsers read them: names, bare and quoted attributes, so that a ``>`` in quotes ends
no tag and a stray quote begins no value. What is no tag stays text: a ``<`` before anything but a
letter, and one whose "tag" runs into the next ``<`` without looking like one (``a<b and c</p>``). A tag
that the page's end cuts off goes. Scripts, styles and the like run to their own closing tag. Open
paragraphs, list items and table cells end where a block or their next sibling begins; closing tags
without an open element in reach are ignored.
"""

from __future__ import annotations

import re
from functools import lru_cache
from html import unescape

_WS = " \t\r\n\f"
_MARK = re.compile(rf"<(?:(/?)([a-zA-Z][^{_WS}/<>]*+)|(!--)|[!?/])")
_BOGUS = re.compile(r"<[!?/][^<>]*+>")
#: The rest of a tag without angle brackets in its values and with quotes around values only.
_PLAIN = re.compile(rf"""(?:[^<>="']++|=[{_WS}]*+(?:"[^"<>]*+"|'[^'<>]*+')?+)*+>""")
_NAMES = re.compile(r"[^<>=]*+")
_SPACES = re.compile(rf"[{_WS}]*+")
_BARE = re.compile(rf"[^{_WS}<>]*+")
_ATTR = re.compile(rf"""([^{_WS}/=]++)(?:[{_WS}]*+=[{_WS}]*+("[^"]*"|'[^']*'|[^{_WS}]++))?+""")
_TELLING = re.compile(r"class|id|role|hidden|style", re.I)
_HIDDEN = re.compile(r"display\s*+:\s*+none|visibility\s*+:\s*+hidden", re.I)
_WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|\d+")

VOID = frozenset("area base basefont bgsound br col embed frame hr img input keygen link meta param source track wbr".split())
#: Elements whose content is no markup.
RAW = frozenset("script style textarea title iframe xmp noembed noframes".split())
_CLOSE = {tag: re.compile(rf"</{tag}(?=[{_WS}/>])", re.I) for tag in RAW}
#: Elements of a head; any other one ends a head that is left open.
HEAD = frozenset("title meta link base basefont bgsound style script noscript noframes template head html".split())
#: Elements that are no article text, whatever is in them.
DROPPED = frozenset("nav footer aside form button select option optgroup datalist menu dialog fieldset label head noscript template object svg canvas audio video annotation annotation-xml".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
BLOCK = HEADINGS | frozenset(
    "address article aside audio blockquote body button canvas caption center col colgroup datalist dd details dialog dir div dl dt fieldset figcaption figure footer form frameset head header hgroup hr html legend li listing main menu nav object ol optgroup option p plaintext pre search section select summary svg table tbody td template tfoot th thead tr ul video img input embed iframe textarea script style title noscript".split()
)
KNOWN = BLOCK | VOID | RAW | DROPPED | frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd mark nobr output picture q rp rt ruby s samp small span strike strong sub sup time tt u var".split())
#: Elements that a start tag ends if they are the nearest open block, one after the other.
ENDS = {tag: frozenset(["p"]) for tag in BLOCK - frozenset("img input embed iframe button select option optgroup audio video canvas object svg textarea script style title template noscript".split())} | {
    "li": frozenset(["p", "li"]),
    **dict.fromkeys(("dt", "dd"), frozenset(["p", "dt", "dd"])),
    **dict.fromkeys(("td", "th"), frozenset(["p", "td", "th"])),
    "tr": frozenset(["p", "td", "th", "tr", "caption", "colgroup"]),
    **dict.fromkeys(("tbody", "thead", "tfoot"), frozenset(["p", "td", "th", "tr", "tbody", "thead", "tfoot", "caption", "colgroup"])),
    "option": frozenset(["option"]),
    "optgroup": frozenset(["option", "optgroup"]),
}
#: Closing tags reach no further than the nearest of these, but for tables' own.
SCOPES = frozenset("td th caption table".split())
TABLE = SCOPES | frozenset("tr tbody thead tfoot html body".split())
ROOTS = frozenset(("article", "main"))
ROLES = frozenset("navigation banner contentinfo complementary search dialog alertdialog alert form menu menubar toolbar tablist note".split())
#: Last words of class and id names that mark what is no article.
NAMES = frozenset("ad ads advert adverts advertisement sponsored promo banner cookie cookies consent gdpr notice alert sidebar menu nav navbar navigation breadcrumb breadcrumbs footer masthead share sharing social related newsletter popup modal widget widgets pager pagination skip toolbar".split())
COMMENTS = frozenset("comment comments commentlist respond disqus".split())
#: Words behind such a last word that only tell of a part or a place.
PARTS = frozenset("area list section container wrapper wrap box inner outer left right top bottom main block bar item items link links button buttons group panel column col row posts thread slot unit".split())
#: Words by which a name tells of a layout instead, like ``has-sidebar`` or ``ad-free``.
LAYOUT = frozenset("no not has with without free".split())


def _tail(html: str, at: int, name: str, closing: bool) -> int:
    """Where the tag ends whose name ends at ``at``; -1 if it is text, the page's length if it has no end."""
    plain = _PLAIN.match(html, at)
    if plain:
        return plain.end()
    begun, n, quoted = at, len(html), False
    while True:
        at = _NAMES.match(html, at).end()
        if at >= n:
            return n if quoted or name in KNOWN else -1
        c = html[at]
        if c == ">":
            return at + 1
        if c == "<":
            if quoted:
                at += 1
                continue
            rest = html[begun:at]
            return at if name in KNOWN and (not rest.strip(_WS) or (not closing and "=" in rest)) else -1
        at = _SPACES.match(html, at + 1).end()
        if at >= n:
            return n
        if html[at] in "\"'" and (end := html.find(html[at], at + 1)) >= 0:
            at, quoted = end + 1, True
        else:
            at = _BARE.match(html, at).end()


def telling(name: str, marks: frozenset[str]) -> bool:
    """Whether a class or id name ends in one of the marks, like ``site-footer`` or ``adBox2``."""
    words = [w.lower() for w in _WORDS.findall(name)]
    if not words or any(w in LAYOUT for w in words):
        return False
    while len(words) > 1 and (words[-1] in PARTS or words[-1].isdigit()):
        words.pop()
    return words[-1] in marks


def _marked(tag: str, source: str) -> str:
    """What an element's attributes declare: "" nothing, "drop" no article text, "header" none outside articles."""
    found = {}
    for k, v in _ATTR.findall(source):
        found.setdefault(k.lower(), unescape(v[1:-1] if v[:1] in ("'", '"') and len(v) > 1 and v[-1] == v[0] else v))
    if "hidden" in found or found.get("aria-hidden", "").lower() == "true" or _HIDDEN.search(found.get("style", "")):
        return "drop"
    if tag in ("html", "body"):
        return ""
    if found.get("role", "").strip().lower() in ROLES:
        return "drop"
    if tag not in BLOCK or tag in HEADINGS or tag == "pre":
        return ""
    names = f"{found.get('class', '')} {found.get('id', '')}".split()
    marks = COMMENTS if tag in ROOTS else NAMES | COMMENTS
    if any(telling(x, marks) for x in names):
        return "drop"
    return "header" if tag not in ROOTS and any(x.lower() in ("header", "site-header", "page-header") for x in names) else ""


_marked_short = lru_cache(4096)(_marked)


class _Open:
    """An open element: what drops its text, whether it is in a root, places of the nearest block and scope."""

    __slots__ = ("tag", "dropped", "inside", "block", "scope")

    def __init__(self, tag: str, dropped: str, inside: bool, block: int, scope: int):
        self.tag, self.dropped, self.inside, self.block, self.scope = tag, dropped, inside, block, scope


def blocks_of(html: str | None) -> tuple[list[str], bool]:
    """(blocks of text in page order, whether they stand in declared articles)."""
    html = html or ""
    stack = [_Open("", "", False, 0, 0)]
    places: dict[str, list[int]] = {}  # places of the open elements by tag
    absent: set[str] = set()  # raw elements that aren't closed any more
    parts: list[str] = []
    blocks: list[tuple[str, bool]] = []
    top = stack[0]
    at = begun = 0

    def flush() -> None:
        if parts:
            text = " ".join("".join(parts).split())
            if text:
                blocks.append((text, top.inside))
            parts.clear()

    def close(place: int) -> _Open:
        for x in stack[place:]:
            places[x.tag].pop()
        del stack[place:]
        return stack[-1]

    def text(end: int) -> None:
        nonlocal top
        if end <= begun:
            return
        if top.dropped == "head" and top.tag == "head" and not html[begun:end].isspace():
            top = close(len(stack) - 1)
        if not top.dropped:
            piece = html[begun:end]
            parts.append(unescape(piece) if "&" in piece else piece)

    while (lt := html.find("<", at)) >= 0:
        mark = _MARK.match(html, lt)
        if not mark:
            at = lt + 1
            continue
        if not mark[2]:
            if mark[3]:
                end = html.find("-->", lt + 2)
                end = end + 3 if end >= 0 else len(html)
            else:
                bogus = _BOGUS.match(html, lt)
                if not bogus:
                    at = lt + 1
                    continue
                end = bogus.end()
            text(lt)
            at = begun = end
            continue
        tag = mark[2].lower()
        end = _tail(html, mark.end(), tag, bool(mark[1]))
        if end < 0:
            at = lt + 1
            continue
        text(lt)
        at = begun = end
        block = tag in BLOCK
        if top.tag == "head" and not mark[1] and tag not in HEAD:
            top = close(len(stack) - 1)
        if block:
            flush()
        if mark[1]:
            found = places.get(tag)
            # An inline element ends within its block only, a block within its table cell.
            if found and found[-1] > (0 if tag in TABLE else top.scope if block else top.block):
                top = close(found[-1])
            continue
        source = html[mark.end() : end - 1]
        if tag in RAW:
            shut = None if tag in absent else _CLOSE[tag].search(html, at)
            if shut:
                at = begun = shut.start()
            elif tag in ("script", "style") and not source.rstrip(_WS).endswith("/"):
                at = begun = len(html)
            else:
                absent.add(tag)
            continue
        if tag in ENDS:
            while stack[top.block].tag in ENDS[tag] and top.block:
                top = close(top.block)
        if tag in VOID:
            if tag == "br" and not top.dropped:
                parts.append(" ")
            continue
        if source.endswith("/") and (tag not in KNOWN or tag == "svg"):
            continue
        dropped, inside = top.dropped, top.inside
        if tag == "main" and dropped != "drop" or tag == "article" and dropped in ("nav", "header", "form"):
            dropped = ""  # an element left open, or a form around the whole page
        if not dropped:
            if tag in DROPPED or (tag == "header" and not inside):
                dropped = tag
            elif _TELLING.search(source):
                dropped = _marked_short(tag, source) if len(source) <= 256 else _marked(tag, source)
                dropped = "" if dropped == "header" and inside else dropped
        inside = inside or (tag in ROOTS and not dropped)
        if not block and dropped == top.dropped and not places.get(tag):
            continue  # nothing changes until its end, which no element waits for
        place = len(stack)
        top = _Open(tag, dropped, inside, place if block else top.block, place if tag in SCOPES else top.scope)
        stack.append(top)
        places.setdefault(tag, []).append(place)
    text(len(html))
    flush()
    declared = any(x for _, x in blocks)
    return [t for t, x in blocks if x or not declared], declared
