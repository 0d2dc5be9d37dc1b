"""Block tree of one HTML page.

Only what the extraction needs: block elements with a label and a mark, and the
text of each block in page order. Inline elements add their text to the block
around them; end tags that the page left out are supplied.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from html import unescape

INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: elements whose text isn't markup
RAW = frozenset(["script", "style"])
#: an element that ends when one of these begins beside it
ENDS = {
    "p": frozenset("address article aside blockquote details div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split()),
    "li": frozenset(["li"]), "dt": frozenset(["dt", "dd"]), "dd": frozenset(["dt", "dd"]), "tr": frozenset(["tr", "tbody", "tfoot"]),
    "td": frozenset(["td", "th", "tr"]), "th": frozenset(["td", "th", "tr"]), "option": frozenset(["option"]), "head": frozenset(["body"]),
}
#: elements that an end tag inside doesn't close
WALLS = frozenset(["table", "article", "main", "body"])

#: marks: of text, of a header (no text unless it heads an article), of noise by a class or id (which may also sit on a wrapper), of noise for sure
TEXT, HEADER, MAYBE, NOISE = 1, -1, -2, -3
NOISE_TAGS = frozenset("nav footer aside script style head noscript template iframe object svg canvas button select textarea dialog menu audio video".split())
#: words of a class or id that mark a branch as no part of the text
NOISE_WORDS = frozenset("""ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion banner cookie cookies consent gdpr notice notices
    notification alert popup modal overlay newsletter subscribe subscription signup sidebar aside menu nav navbar navigation breadcrumb breadcrumbs footer
    masthead topbar toolbar social share sharing widget widgets pagination pager copyright disclaimer login search skip""".split())
SURE_WORDS = frozenset("comment comments commentlist disqus respond reply replies discussion related recommended teaser".split())
HEADER_WORDS = frozenset(["header"])
NOISE_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert menu menubar toolbar".split())
TEXT_TAGS = ("article", "main")

TOKEN = re.compile(
    r"""<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*+(?:>|\Z)"""
    r"""|<(?P<end>/?)(?P<name>[A-Za-z][^\s/>]*+)(?P<rest>(?:[^>"']++|"[^"]*+"|'[^']*+')*+)>"""
    r"""|<(?P<end2>/?)(?P<name2>[A-Za-z][^\s/>]*+)(?P<rest2>[^>]*+)(?:>|\Z)""", re.S)
ATTRIBUTE = re.compile(r"""(?<![\w-])(class|id|role|itemprop|hidden|style)\s*(?:=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""", re.I)
WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])|[0-9]+")
DIGITS = re.compile(r"[0-9]+")


@dataclass(slots=True)
class Node:
    tag: str
    label: str
    #: TEXT, HEADER, MAYBE or NOISE; 0: not marked
    mark: int
    parent: Node | None
    #: elements, and texts of blocks as strings
    children: list = field(default_factory=list)


_seen: dict[tuple[str, str], tuple[str, int]] = {}


def described(tag: str, rest: str) -> tuple[str, int]:
    """Label (tag, class and id, digits as #) and mark of an element."""
    known = _seen.get((tag, rest))
    if known is None:
        if len(_seen) > 20_000:
            _seen.clear()
        known = _seen[tag, rest] = _described(tag, rest)
    return known


def _described(tag: str, rest: str) -> tuple[str, int]:
    at = {m[1].lower(): m[2] or m[3] or m[4] or "" for m in ATTRIBUTE.finditer(rest)} if "=" in rest or "hidden" in rest else {}
    own = f"{at.get('class', '')} {at.get('id', '')}"
    words = {w.lower() for w in WORD.findall(own)}
    role = at.get("role", "").lower()
    label = DIGITS.sub("#", f"{tag}.{'.'.join(own.split())}" if own.strip() else tag)
    hidden = "hidden" in at or "display:none" in at.get("style", "").replace(" ", "").lower()
    if tag in ("html", "body"):  # their classes tell of the whole page
        return label, 0
    if tag in NOISE_TAGS or words & SURE_WORDS or role in NOISE_ROLES or hidden:
        return label, NOISE
    if tag == "form" or words & NOISE_WORDS:
        return label, MAYBE
    if tag in TEXT_TAGS or role in TEXT_TAGS or at.get("itemprop", "") == "articleBody":
        return label, TEXT
    if tag == "header" or words & HEADER_WORDS:
        return label, HEADER
    return label, 0


def parse(html: str) -> Node:
    """Tree of the page's block elements and block texts."""
    root = node = Node("#", "#", 0, None)
    text: list[str] = []
    at = 0

    def flush() -> None:
        if text:
            block = " ".join("".join(text).split())
            text.clear()
            if block:
                node.children.append(block)

    size = len(html)
    while at < size:
        m = TOKEN.search(html, at)
        if m is None:
            text.append(unescape(html[at:]))
            break
        if m.start() > at:
            text.append(unescape(html[at:m.start()]))
        at = m.end()
        name = m["name"] or m["name2"]
        if name is None:
            continue
        name = name.lower()
        if name in INLINE:
            continue
        if m["end"] or m["end2"]:
            if name in VOID:
                continue
            flush()
            up = node
            while up.parent is not None and up.tag != name and not (up.tag in WALLS and name not in WALLS and name != "html"):
                up = up.parent
            if up.tag == name and up.parent is not None:
                node = up.parent
            continue
        rest = m["rest"] or m["rest2"] or ""
        if name in VOID:
            if name == "hr":
                flush()
            elif name == "br":
                text.append(" ")
            continue
        flush()
        while name in ENDS.get(node.tag, ()):
            node = node.parent
        label, mark = described(name, rest)
        child = Node(name, label, mark, node)
        node.children.append(child)
        if name in RAW:
            close = re.compile(f"</{name}", re.I).search(html, at)
            at = size if close is None else close.start()
            if close is not None:
                stop = html.find(">", at)
                at = size if stop < 0 else stop + 1
            continue
        if not rest.endswith("/"):
            node = child
    flush()
    return root
