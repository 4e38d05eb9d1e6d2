"""HTML into leaf blocks: runs of text between block-level tags, each with the tags and class names of all elements above it."""

from __future__ import annotations

import html
import re
from dataclasses import dataclass

TAG = re.compile(r"<(?:!--(?:>|->|.*?--!?>|.*)|[!?][^>]*+>?|(/?)([a-zA-Z][^\s/>]*+)((?:[^>=]++|=\s*+(?:\"[^\"]*+\"|'[^']*+')|=)*+)(>|$)|/(?=[^a-zA-Z])[^>]*+>?)", re.S)
ATTRIBUTE = re.compile(r"(?<![^\s\"'/])(class|id|role)\s*+=\s*+(?:\"([^\"]*+)\"|'([^']*+)'|([^\s\"'>]++))", re.I)
NAME = re.compile(r"[a-z]+")
# fixed values: element names of HTML
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style title textarea noscript iframe noembed noframes xmp template".split())
SKIPPED = frozenset("head svg math object audio video canvas select datalist button map applet".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark nobr output q rp rt ruby s samp small span strike strong sub sup time tt u var img wbr".split()
)
CLOSES_P = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre search section summary table ul".split())
IN_HEAD = frozenset("base link meta noscript script style template title head".split())
#: a start of the first closes an open element of the second, up to the nearest of the third
IMPLIED = {
    "li": (frozenset(["li"]), frozenset(["ul", "ol", "menu", "dir"])),
    "dt": (frozenset(["dt", "dd"]), frozenset(["dl"])),
    "dd": (frozenset(["dt", "dd"]), frozenset(["dl"])),
    "tr": (frozenset(["tr"]), frozenset(["table"])),
    "td": (frozenset(["td", "th"]), frozenset(["tr", "table"])),
    "th": (frozenset(["td", "th"]), frozenset(["tr", "table"])),
    "option": (frozenset(["option"]), frozenset(["select", "datalist"])),
    "optgroup": (frozenset(["option", "optgroup"]), frozenset(["select", "datalist"])),
    "body": (frozenset(["head"]), frozenset()),
}


@dataclass(slots=True)
class Block:
    """path: the different names of all open elements, those of the innermost last; text: white space collapsed; linked:
    characters inside links."""

    path: tuple[str, ...]
    text: str
    linked: int


def _names(tag: str, attributes: str) -> tuple[str, ...]:
    """An element's tag, and the words of its class, id and role."""
    out = [f"<{tag}"]
    if attributes:
        for m in ATTRIBUTE.finditer(attributes):
            out += [f".{w}" for w in NAME.findall((m[2] or m[3] or m[4] or "").lower())]
    return tuple(dict.fromkeys(out))


def _end_of(tag: str, page: str, at: int) -> int:
    """Where the end tag of a raw element starts; the page's end if there is none."""
    m = re.compile(rf"</{re.escape(tag)}(?=[\s/>])", re.I).search(page, at)
    return m.start() if m else len(page)


def blocks(page: str) -> list[Block]:
    """The leaf blocks of a page with text, in order.

    Ends that HTML lets authors leave out are implied; ends without a start are ignored. What no reader of the page sees as
    text (scripts, styles, the head, controls) is left out.
    """
    out: list[Block] = []
    stack: list[tuple[str, tuple[str, ...]]] = []
    named: dict[str, int] = {}  # how many open elements have a name
    path: tuple[str, ...] | None = ()
    places: dict[str, list[int]] = {}
    said: list[str] = []
    at = linked = links = skipped = 0
    end = len(page)

    def close() -> None:
        nonlocal linked, path
        if said:
            text = " ".join(html.unescape("".join(said)).split())
            if text:
                if path is None:
                    own = next((names for _, names in reversed(stack) if names), ())
                    path = (*(n for n in named if n not in own), *own)
                out.append(Block(path, text, linked))
            said.clear()
        linked = 0

    def push(tag: str, names: tuple[str, ...]) -> None:
        nonlocal path
        places.setdefault(tag, []).append(len(stack))
        stack.append((tag, names))
        for n in names:
            named[n] = named.get(n, 0) + 1
        path = None

    def last(*tags: str) -> int:
        """The place of the innermost open element of these; -1 if there is none."""
        return max((places[t][-1] for t in tags if places.get(t)), default=-1)

    def pop(wanted: frozenset[str], until: frozenset[str]) -> None:
        nonlocal skipped, path
        k = last(*wanted)
        if k > last(*until):
            for t, names in stack[k:]:
                places[t].pop()
                skipped -= t in SKIPPED
                for n in names:
                    named[n] -= 1
                    if not named[n]:
                        del named[n]
            del stack[k:]
            path = None

    while at < end:
        m = TAG.search(page, at)
        stop = m.start() if m else end
        if stop > at and not skipped:
            said.append(page[at:stop])
            if links:
                linked += stop - at
        if not m:
            break
        at = m.end()
        if not m[2]:
            continue
        if not m[4]:
            break  # the page ends inside a tag
        tag = m[2].lower()
        if tag in INLINE:
            if tag == "a":
                links = 0 if m[1] else 1
            continue
        if tag == "br":
            if not skipped:
                said.append(" ")
            continue
        if m[1]:
            if places.get(tag):
                close()
                pop(frozenset([tag]), frozenset())
                links = 0
            continue
        if skipped and tag not in IN_HEAD and stack[-1][0] == "head":
            pop(frozenset(["head"]), frozenset())
        if tag in RAW:
            at = _end_of(tag, page, at)
            continue
        if skipped and tag not in SKIPPED and tag not in IMPLIED:
            if tag not in VOID and not (m[3].endswith("/") and last("svg", "math") > last("foreignobject")):
                push(tag, ())
            continue
        close()
        if tag in CLOSES_P:
            pop(frozenset(["p"]), frozenset(["td", "th", "table", "button", "object"]))
        if tag in IMPLIED:
            pop(*IMPLIED[tag])
        if tag in VOID or m[3].endswith("/") and tag not in CLOSES_P and tag not in IMPLIED:
            continue
        push(tag, _names(tag, m[3]))
        skipped += tag in SKIPPED
    close()
    return out
