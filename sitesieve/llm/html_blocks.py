"""Leaf blocks of a page: its text between block-level tags, with the tags, classes and links around it."""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from html import unescape

#: Fixed values of HTML: elements that break a line, that have no end tag, whose content is no text, and that an end
#: of their parent or a sibling closes.
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 "
    "head header hgroup hr html legend li main menu nav ol optgroup option p pre search section select summary table tbody td tfoot th thead title tr ul button textarea label".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
HIDDEN = frozenset("script style noscript template svg iframe head title object canvas audio video math select textarea datalist".split())
_CLOSES_P = BLOCKS - frozenset("body html head title option optgroup label button caption td th tr tbody thead tfoot legend".split())
_SAME = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "option": {"option"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}}
_BOUND = frozenset("ul ol menu dl table select article section main aside nav div body".split())
_INLINE = frozenset("a abbr b bdi bdo big cite code del dfn em font i ins kbd mark q s samp small span strike strong sub sup tt u var".split())

# Linear in the page: nothing is read twice. A quote counts only behind "=", and only if it is closed somewhere.
_TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*+)((?>[^>=]++|=\s*+(?:\"[^\"]*+\"|'[^']*+'|[^\s>]*+))*+)>")
_COMMENT_END = re.compile(r"--!?>")
_RAW_END = {t: re.compile(rf"</{t}\s*+>", re.I) for t in "script style textarea title noscript iframe template".split()}
_ATTR = re.compile(r"\b(class|id|role|hidden|aria-hidden|style|href|itemprop|aria-label)\b(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.I)
_NAME = re.compile(r"[A-Za-z][a-z]+|[A-Z]+(?![a-z])")


@dataclass
class Block:
    """A leaf block: its text, the tags and the name parts (of class, id and role) from the root down to it.

    ``parent`` is the same for blocks with the same path of tags above their own and the same names.
    """

    text: str
    tags: frozenset[str]
    names: frozenset[str]
    linked: int = 0
    own: str = ""
    parent: tuple[int, int] = (0, 0)


@dataclass(slots=True)
class _Open:
    """An open element; what it has in common with its parent is shared, not copied."""

    tag: str
    own_names: frozenset[str] = frozenset()
    hidden: bool = False
    block: int = 0  # place of the nearest block-level element, itself included
    blocks: int = 0  # block-level elements down to here
    path: int = 0  # number of the path of block-level tags
    above: int = 0  # number of the path without the last
    tags: frozenset[str] = frozenset()
    names: frozenset[str] = frozenset()
    print: int = 0  # fingerprint of all names down to here


def _attributes(attr: str) -> tuple[frozenset[str], bool]:
    names, hidden = [], False
    for m in _ATTR.finditer(attr):
        key, value = m[1].lower(), m[2] or m[3] or m[4] or ""
        if key in ("class", "id", "role", "aria-label", "itemprop"):
            names += [x.lower() for x in _NAME.findall(value)]
        elif key == "hidden" or key == "aria-hidden" and value == "true" or key == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I):
            hidden = True
    return frozenset(names), hidden


def _pieces(html: str) -> Iterator[tuple[str, str, str, str]]:
    """(text before, "/" of an end tag, tag, attributes) in order; the tag is empty for the text at the end."""
    at = begin = 0
    while (at := html.find("<", at)) >= 0:
        follows = html[at + 1 : at + 2]
        if follows.isalpha() and follows.isascii() or follows == "/" and html[at + 2 : at + 3].isalpha() and html[at + 2 : at + 3].isascii():
            if not (m := _TAG.match(html, at)):
                break  # never closed: nothing behind it counts, as in browsers
            tag = m[2].lower()
            yield html[begin:at], m[1], tag, m[3]
            at = m.end()
            if not m[1] and tag in _RAW_END:
                end = _RAW_END[tag].search(html, at)
                at = end.end() if end else len(html)
        elif html.startswith("!--", at + 1):
            yield html[begin:at], "", "!", ""
            short = next((n for n in (5, 6) if html.startswith(("<!-->", "<!--->")[n - 5], at)), 0)
            end = None if short else _COMMENT_END.search(html, at + 4)
            at = at + short if short else end.end() if end else len(html)
        elif follows and follows in "!?/":
            yield html[begin:at], "", "!", ""
            end = html.find(">", at)
            at = end + 1 if end >= 0 else len(html)
        else:
            at += 1
            continue
        begin = at
    yield html[begin : at if at >= 0 else len(html)], "", "", ""


def blocks(html: str | None, known: frozenset[str] | None = None) -> list[Block]:
    """Leaf blocks in page order. Markup that is broken is read as browsers do where it is simple to: open p, li, dt, dd,
    td, th, tr and option end before the next; an unclosed inline element ends with its block; a missing end tag lasts to the
    end of the parent; a tag that is never closed ends the page. Names are only kept if they are ``known`` (None: all), so
    time and memory grow with the page's length, however deep it is."""
    out: list[Block] = []
    stack = [_Open("#")]
    at: dict[str, list[int]] = defaultdict(list)  # places of the open elements of each tag
    paths: dict[tuple[int, str], int] = {}
    open_names: Counter[str] = Counter()
    words: list[str] = []
    linked = [0]

    def close_block() -> None:
        text = " ".join("".join(words).split())
        words.clear()
        if text:
            top = stack[-1]
            out.append(Block(text, top.tags, top.names, min(linked[0], len(text)), stack[top.block].tag if top.blocks else "", (top.above, top.print)))
        linked[0] = 0

    def add(text: str) -> None:
        if text and not stack[-1].hidden:
            words.append(text)
            if at["a"]:
                linked[0] += len(text.strip())

    def pop_to(k: int) -> None:
        for o in stack[k:]:
            at[o.tag].pop()
            if o.own_names and o.tag in BLOCKS:
                open_names.subtract(o.own_names)
        del stack[k:]

    def last(tags: Iterable[str]) -> int:
        return max((at[t][-1] for t in tags if t in at and at[t]), default=0)

    for text, end, tag, attr in _pieces(html or ""):
        add(unescape(text))
        if not tag or tag == "!":
            continue
        if tag in _RAW_END and not end:
            if tag in ("title", "textarea"):
                close_block()
            continue
        if end:
            k = last((tag,))
            if tag in BLOCKS:
                close_block()
            if k and (tag in BLOCKS or stack[-1].blocks == stack[k].blocks):
                pop_to(k)
            continue
        if tag == "br":
            add(" ")
            continue
        if tag in BLOCKS:
            close_block()
            if tag in _CLOSES_P and stack[k := stack[-1].block].tag == "p":
                pop_to(k)
            if same := _SAME.get(tag):
                k = last(same)
                if k > last(_BOUND - same):
                    pop_to(k)
            while stack[-1].tag in _INLINE and tag != "a":  # left open by the block before
                if stack[-1].tag == "a":
                    break
                pop_to(len(stack) - 1)
        if tag in VOID or attr.rstrip().endswith("/") and tag not in BLOCKS:
            continue
        top = stack[-1]
        names, hidden = _attributes(attr) if attr else (frozenset(), False)
        new = _Open(tag, names, top.hidden or hidden or tag in HIDDEN, top.block, top.blocks, top.path, top.above, top.tags, top.names, top.print)
        if tag in BLOCKS:
            new.block, new.blocks, new.above = len(stack), top.blocks + 1, top.path
            new.path = paths.setdefault((top.path, tag), len(paths) + 1)
            new.tags = top.tags if tag in top.tags else top.tags | {tag}
            for n in names:
                if open_names[n] <= 0:
                    new.print ^= hash(n)
            open_names.update(names)
            kept = names if known is None else names & known
            new.names = top.names if kept <= top.names else top.names | kept
        at[tag].append(len(stack))
        stack.append(new)
    close_block()
    return out
