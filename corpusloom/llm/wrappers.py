"""HTML extraction by wrappers: union-free regular expressions inferred from pages of one host (after Crescenzi,
Mecca and Merialdo, 2001).

A page becomes a stream of block tags and text slots in which repeated neighbours are folded. Streams of a host are
aligned one after another with what has been inferred so far: what both share stays, what only one has becomes
optional, what repeats on either side becomes a repeated group, and texts that differ make a slot that varies. The
wrapper then tells where the article is: in an article element, or else in the part of the page in which most of the
text is that differs from page to page, without the slots that say the same on several pages. To be extracted, a page's
stream is aligned with its host's wrapper, and what falls into the article's slots is the main text.

Pages with the same stream are added up where they are read, and streams of a host are aligned in rounds of bounded
groups, so that a host with a third of all pages is neither shuffled nor gathered.
"""

from __future__ import annotations

import html
import json
import re
from collections import Counter, OrderedDict, defaultdict
from collections.abc import Iterable, Iterator
from math import isqrt
from typing import NamedTuple
from zlib import crc32

import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.common import cut, kept, small_batches, text_slices

# HTML elements by their role.
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre search section select summary table tbody td tfoot th thead title tr ul button textarea noscript template iframe object svg math canvas audio video".split()
)
RAW = ("script", "style", "textarea", "title", "noscript", "template", "iframe", "svg")
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
NEVER = frozenset("head title script style noscript template iframe svg math nav footer aside form button select textarea dialog menu search object canvas audio video".split())
MAIN = frozenset(("article", "main"))
#: Words of class and id that mark what is not the article.
NOT_MAIN = frozenset(
    "nav navbar navigation menu header footer sidebar aside ad ads adv advert adverts advertisement banner promo promotion sponsor sponsored notice notices cookie cookies consent gdpr alert form search share sharing social comment comments commentlist reply replies respond disqus related breadcrumb breadcrumbs subscribe newsletter popup modal login signup widget toolbar".split()
)
#: Elements that end an open element of the same group when they begin.
_CLOSES = {**{k: ("p",) for k in BLOCKS - {"button", "option", "optgroup", "td", "th", "tr", "title"}}, "li": ("p", "li"), "dt": ("p", "dt", "dd"), "dd": ("p", "dt", "dd"), "tr": ("p", "td", "th", "tr"), "td": ("p", "td", "th"), "th": ("p", "td", "th"), "option": ("option",)}
_SCOPE = {"li": ("ul", "ol", "menu"), "dt": ("dl",), "dd": ("dl",), "tr": ("table",), "td": ("table", "tr"), "th": ("table", "tr")}
# A quote opens a value only after an equals sign, and one that is never closed is a character like others; so the time
# is linear in the page.
_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*+(?:>|\Z)|<(/?)([A-Za-z][^\s/>]*+)((?:[^>=]++|=\s*+(?:\"[^\"]*+\"|'[^']*+')?+)*+)(?:>|\Z)", re.S)
_NAMED = re.compile(r"\b(class|id|role)\s*+=\s*+(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_RAW_END = {x: re.compile(rf"</{x}(?=[\s/>])", re.I) for x in RAW}
#: Elements that hold text themselves; the other block elements are containers.
TEXTUAL = frozenset("p li dt dd td th tr tbody thead tfoot table caption ul ol dl h1 h2 h3 h4 h5 h6 blockquote pre figure figcaption address details summary hgroup".split())
HEADINGS = frozenset(("h1", "h2", "h3"))
#: Open elements at most; what is opened deeper counts to the element there.
DEEPEST = 512


class Page(NamedTuple):
    """blocks: (path, text, whether most of it is links) of each block with text; paths: parent path and key of each
    path, whose number depends on its keys alone; 0 is the page itself."""

    blocks: list[tuple[int, str, bool]]
    paths: dict[int, tuple[int, str]]


def _key(name: str, attributes: str) -> str:
    """Element name with the words of its class, id and role; digits are left out."""
    if not attributes or attributes.isspace():
        return name
    words = sorted({w for m in _NAMED.finditer(attributes) for w in re.split(r"[^a-z]+", (m[2] or m[3] or m[4] or "").lower()) if w})
    return name + "".join(f".{w}" for w in words)


def _path(parent: int, key: str) -> int:
    return (xxhash.xxh3_64_intdigest(f"{parent}>{key}") >> 1) | 1


def blocks(source: str | None) -> Page:
    """The page's blocks: white space is one space, references decoded. A tag that is not closed at the end of the page,
    an unknown end tag and a lone < do not stop the rest."""
    found: list[tuple[int, str, bool]] = []
    paths: dict[int, tuple[int, str]] = {}
    stack: list[tuple[str, int]] = []  # name and path
    count: Counter[str] = Counter()
    text: list[str] = []
    inside, linked = 0, 0  # of links, and characters there
    source, at = source or "", 0

    def add(path: int, raw: str, links: int) -> None:
        if flat := " ".join(html.unescape(raw).split()):
            found.append((path, flat, 2 * links > len(raw)))

    def close() -> None:
        nonlocal linked
        if text:
            add(stack[-1][1] if stack else 0, "".join(text), linked)
            text.clear()
        linked = 0

    def cut_to(n: int) -> None:
        for name, _ in stack[n:]:
            count[name] -= 1
        del stack[n:]

    while m := _TOKEN.search(source, at):
        if m.start() > at:
            text.append(source[at : m.start()])
            linked += (m.start() - at) * bool(inside)
        at, name = m.end(), (m[2] or "").lower()
        if not name:
            continue
        if name == "br":
            text.append(" ")
        if name == "a":
            inside = 0 if m[1] else 1
        if name not in BLOCKS and name not in RAW:
            continue
        close()
        if m[1]:
            if count[name]:
                n = len(stack) - 1
                while stack[n][0] != name:
                    n -= 1
                cut_to(n)
            continue
        for old in _CLOSES.get(name, ()):
            if not count[old]:
                continue
            scope = _SCOPE.get(name, ())
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] == old:
                    cut_to(i)
                    break
                if stack[i][0] in scope or (old == "p" and stack[i][0] != "p"):
                    break
        parent = stack[-1][1] if stack else 0
        if name in RAW:
            end = _RAW_END[name].search(source, at)
            inner = source[at : end.start() if end else len(source)]
            at = end.start() if end else len(source)
            if name in ("title", "textarea"):
                paths[path := _path(parent, name)] = (parent, name)
                add(path, inner, 0)
            end_tag = source.find(">", at)
            at = end_tag + 1 if end and end_tag >= 0 else len(source) if end else at
            continue
        if name not in VOID and not m[3].endswith("/") and len(stack) < DEEPEST:
            key = _key(name, m[3])
            path = _path(parent, key)
            paths[path] = (parent, key)
            stack.append((name, path))
            count[name] += 1
    text.append(source[at:])
    linked += (len(source) - at) * bool(inside)
    close()
    return Page(found, paths)


def _chain(path: int, paths: dict[int, tuple[int, str]]) -> list[int]:
    """The path and those it lies in, outermost first."""
    out = []
    while path:
        out.append(path)
        path = paths[path][0]
    return out[::-1]


# A stream's entries are tuples: ("o", key) and ("c", key) for tags, ("t", path, slots) for texts, ("r", entries) for a
# repeated group. Slots are the numbers of the page's blocks that an entry stands for.


def _shape(entry: tuple) -> tuple:
    return entry[:2] if entry[0] == "t" else ("r", tuple(map(_shape, entry[1]))) if entry[0] == "r" else entry


def _join(a: tuple, b: tuple) -> tuple:
    """Two entries of one shape, with the slots of both."""
    if a[0] == "t":
        return ("t", a[1], a[2] + b[2])
    return ("r", tuple(map(_join, a[1], b[1]))) if a[0] == "r" else a


def _joined(turns: list[tuple]) -> tuple:
    """Entries of one shape as one, two by two, so that slots are copied few times."""
    while len(turns) > 1:
        turns = [_join(*turns[i : i + 2]) if i + 1 < len(turns) else turns[i] for i in range(0, len(turns), 2)]
    return turns[0]


def _fold(children: list[tuple]) -> list[tuple]:
    """Neighbouring equal groups of one to three children become one repeated group. A child is (shapes, entries)."""
    for period in (1, 2, 3):
        out: list[tuple] = []
        i = 0
        while i < len(children):
            n = 1
            first = [s for s, _ in children[i : i + period]]
            while [s for s, _ in children[i + n * period : i + (n + 1) * period]] == first and len(first) == period:
                n += 1
            if n > 1 and not (period == 1 and children[i][0][0][0] == "r"):
                turns = [[x for _, e in children[i + k * period : i + (k + 1) * period] for x in e] for k in range(n)]
                group = ("r", tuple(_joined(list(column)) for column in zip(*turns)))
                out.append(((_shape(group),), (group,)))
                i += n * period
            else:
                out.append(children[i])
                i += 1
        children = out
    return children


def stream(page: Page) -> tuple[tuple, tuple]:
    """The folded stream of a page, and its shape."""
    root: list = []
    open_: list[tuple[int, list]] = []

    def flat(children: list[tuple], *around: tuple) -> tuple[tuple, tuple]:
        inside = _fold(children)
        a, b = around[:1], around[1:]
        return (*a, *(x for s, _ in inside for x in s), *b), (*a, *(x for _, e in inside for x in e), *b)

    def end() -> None:
        path, children = open_.pop()
        key = page.paths[path][1]
        (open_[-1][1] if open_ else root).append(flat(children, ("o", key), ("c", key)))

    chains: dict[int, list[int]] = {}
    for slot, (path, _, _) in enumerate(page.blocks):
        chain = chains.get(path) or chains.setdefault(path, _chain(path, page.paths))
        same, above = 0, min(len(open_), len(chain)) + 1  # a path stands for all that it lies in, so halving finds it
        while above - same > 1:
            half = (same + above) // 2
            same, above = (half, above) if open_[half - 1][0] == chain[half - 1] else (same, half)
        if same == len(chain) and same == len(open_) and chain and open_[-1][1] and page.paths[path][1].split(".")[0] in TEXTUAL:
            same -= 1  # another element of the same kind, not more text of this one
        while len(open_) > same:
            end()
        for p in chain[same:]:
            open_.append((p, []))
        entry = ("t", path, (slot,))
        (open_[-1][1] if open_ else root).append(((entry[:2],), (entry,)))
    while open_:
        end()
    shape, entries = flat(root)
    return entries, shape


# A wrapper is a list of entries [kind, value, optional] with the key of a tag or, for "r", a wrapper as value, and
# ["t", path, optional, low, high, pages, chars, linked] for slots: low and high are the least and the largest checksum
# of a text, so the slot varies if they differ; so many pages have the slot, with so many characters, and most are links
# in so many.


def _checksum(text: str) -> int:
    return crc32(text.encode("utf-8", "surrogatepass"))


def from_stream(entries: Iterable[tuple], page: Page) -> list:
    out = []
    for e in entries:
        if e[0] == "t":
            sums = [_checksum(page.blocks[s][1]) for s in e[2]]
            sizes = [len(page.blocks[s][1]) for s in e[2]]
            out.append(["t", e[1], False, min(sums), max(sums), 1, sum(sizes), sum(n for n, s in zip(sizes, e[2]) if page.blocks[s][2])])
        else:
            out.append([e[0], from_stream(e[1], page) if e[0] == "r" else e[1], False])
    return out


def _same(a: list, b: list) -> bool:
    """Whether two wrappers have one shape, whatever is optional."""
    return len(a) == len(b) and all(x[0] == y[0] and (_same(x[1], y[1]) if x[0] == "r" else x[1] == y[1]) for x, y in zip(a, b))


def _raised(a: list, b: list) -> list:
    """a with what b knows as a repeated group and a has once turned into that group."""
    single = {(x[0], x[1]) for x in a if x[0] != "r"}
    for group in b:
        if group[0] != "r":
            continue
        n, i, out = len(group[1]), 0, []
        first = group[1][0][:2]
        if first[0] == "r" or tuple(first) not in single:
            continue  # a has nothing that it begins with
        while i < len(a):
            if a[i][0] != "r" and a[i][:2] == first and _same(a[i : i + n], group[1]):
                out.append(["r", [list(x) for x in a[i : i + n]], all(x[2] for x in a[i : i + n])])
                i += n
            else:
                out.append(a[i])
                i += 1
        a = out
    return a


def _signs(entries: list) -> list[tuple]:
    """What an entry can be aligned by: its kind and value, or the paths of a group's texts."""
    return [("r", frozenset(x[1] for x in e[1] if x[0] == "t")) if e[0] == "r" else (e[0], e[1]) for e in entries]


def _like(a: tuple, b: tuple) -> bool:
    return bool(a[1] & b[1]) if a[0] == b[0] == "r" else a == b


#: Bits of an alignment's rows that are held at once, if they are more than a row for each of their number's root.
BITS = 1 << 26
#: A sign at more places than one in so many has their bits kept; those of a rarer one are set when they are needed.
RARE = 1000


def _aligned(x: list[tuple], y: list[tuple]) -> Iterator[tuple[int | None, int | None]]:
    """A longest common alignment of signs, for any lengths: two that are alike go together, or else x's goes alone if
    the rest has as much in common without it, or else y's.

    The table of what x[i:] and y[j:] have in common is made row by row as bits (after Hyyro, 2004): bit n - 1 - i of
    row j is 0 if x[i:] has one sign more in common with y[j:] than x[i + 1:]. Some rows are held, and the ones between
    are made again from them, so that memory grows with the root of the rows only.
    """
    n, m = len(x), len(y)
    names = lambda s: [("r", p) for p in s[1]] if s[0] == "r" else [s]
    where: dict = defaultdict(list)
    for i, s in enumerate(x):
        for k in names(s):
            where[k].append(n - 1 - i)
    often: dict[tuple, int] = {}

    def alike(s: tuple) -> int:
        if s in often:
            return often[s]
        places = [at for k in names(s) for at in where.get(k, ())]
        bits = bytearray(n // 8 + 1)
        for at in places:
            bits[at >> 3] |= 1 << (at & 7)
        out = int.from_bytes(bits, "little")
        if len(places) * RARE > n:
            often[s] = out
        return out

    whole = (1 << n) - 1

    def above(row: int, match: int) -> int:
        both = row & match
        return ((row + both) | (row - both)) & whole

    step = max(isqrt(m) + 1, BITS // (n + 1))
    held, row = {}, whole
    for j in range(m - 1, step - 1, -1):
        if (j + 1) % step == 0 or j == m - 1:
            held[j + 1] = row
        row = above(row, alike(y[j]))
    held.setdefault(min(step, m), row)
    i = 0
    for first in range(0, m, step):
        last = min(first + step, m)
        row, rows = held.pop(last), []
        for j in range(last - 1, first - 1, -1):
            match = alike(y[j])
            row = above(row, match)
            rows.append((match, match | (row ^ whole)))  # where x goes with y[j], and where it does not go alone
        for j in range(first, last):
            match, stop = rows.pop()
            to = (stop & ((1 << (n - i)) - 1)).bit_length()
            for k in range(i, n - to):
                yield k, None
            i = n - to
            if to and match >> (to - 1) & 1:
                yield i, j
                i += 1
            else:
                yield None, j
    for k in range(i, n):
        yield k, None


def pairs(a: list, b: list) -> Iterator[tuple[int | None, int | None]]:
    """Aligned places of two wrappers' entries; None where one has nothing."""
    x, y = _signs(a), _signs(b)
    start = 0
    while start < min(len(a), len(b)) and _like(x[start], y[start]):
        yield start, start
        start += 1
    end = 0
    while end < min(len(a), len(b)) - start and _like(x[-1 - end], y[-1 - end]):
        end += 1
    for i, j in _aligned(x[start : len(a) - end], y[start : len(b) - end]):
        yield (None if i is None else start + i), (None if j is None else start + j)
    for k in range(end, 0, -1):
        yield len(a) - k, len(b) - k


def _turned(a: list, b: list) -> list:
    """Wrapper a of a group with the texts of b, one more turn of it, in the same slots; b's pages are a's, or new ones
    that are not counted."""
    out = []
    for x, y in zip(a, b):
        if x[0] == "t":
            out.append(["t", x[1], x[2], min(x[3], y[3]), max(x[4], y[4]), max(x[5], y[5]), x[6] + y[6], x[7] + y[7]])
        else:
            out.append([x[0], _turned(x[1], y[1]) if x[0] == "r" else x[1], x[2]])
    return out


def merged(a: list, b: list) -> list:
    """The wrapper of all pages of either: shared entries stay, the others are optional."""
    a, b = _raised(a, b), _raised(b, a)
    out: list = []
    for i, j in pairs(a, b):
        if i is None or j is None:
            e = a[i] if j is None else b[j]
            if e[0] == "r" and out and out[-1][0] == "r" and _same(e[1], out[-1][1]):
                out[-1] = ["r", _turned(out[-1][1], e[1]), out[-1][2]]  # one more turn of the group before
                continue
            out.append([e[0], e[1], True, *e[3:]])
            continue
        x, y = a[i], b[j]
        if x[0] == "t":
            out.append(["t", x[1], x[2] or y[2], min(x[3], y[3]), max(x[4], y[4]), x[5] + y[5], x[6] + y[6], x[7] + y[7]])
        else:
            out.append([x[0], merged(x[1], y[1]) if x[0] == "r" else x[1], x[2] or y[2]])
    return out


def expression(wrapper: list) -> str:
    """The wrapper as a regular expression, for people."""
    said = {"o": "<%s>", "c": "</%s>"}
    out = []
    for kind, value, optional, *texts in wrapper:
        x = f"({expression(value)})+" if kind == "r" else said[kind] % value if kind in said else "TEXT" if texts[0] != texts[1] else "text"
        out.append(f"({x})?" if optional else x)
    return "".join(out)


def slots(wrapper: list) -> Iterator[list]:
    """The entries of all text slots."""
    for e in wrapper:
        if e[0] == "r":
            yield from slots(e[1])
        elif e[0] == "t":
            yield e


class Known(NamedTuple):
    """What is inferred of a host: pages, wrapper, and its slots' paths with those they lie in."""

    pages: int
    wrapper: list
    paths: dict[int, tuple[int, str]]


def known(page: Page, entries: tuple | None = None) -> Known:
    """What one page tells; entries: its stream, if there is one."""
    entries = stream(page)[0] if entries is None else entries
    return Known(1, from_stream(entries, page), {p: page.paths[p] for path in {b[0] for b in page.blocks} for p in _chain(path, page.paths)})


def together(a: Known, b: Known) -> Known:
    return Known(a.pages + b.pages, merged(a.wrapper, b.wrapper), a.paths | b.paths)


def _more(a: Known, b: Known) -> Known:
    """The same of two pages of one stream, whose entries need no alignment."""
    return Known(a.pages + b.pages, _added(a.wrapper, b.wrapper), a.paths)


def _added(a: list, b: list) -> list:
    out = []
    for x, y in zip(a, b):
        if x[0] == "t":
            out.append(["t", x[1], False, min(x[3], y[3]), max(x[4], y[4]), x[5] + y[5], x[6] + y[6], x[7] + y[7]])
        else:
            out.append(["r", _added(x[1], y[1]), False] if x[0] == "r" else x)
    return out


def _to_json(k: Known) -> str:
    return json.dumps([k.pages, k.wrapper, [[p, *v] for p, v in k.paths.items()]], separators=(",", ":"))


def _from_json(said: str) -> Known:
    pages, wrapper, paths = json.loads(said)
    return Known(pages, wrapper, {p: (parent, key) for p, parent, key in paths})


def _names(path: int, paths: dict[int, tuple[int, str]]) -> list[str]:
    return [paths[p][1] for p in _chain(path, paths)]


def _barred(keys: list[str]) -> bool:
    """Whether a path leads through what is not the article. A header inside an article is the article's own."""
    inside = False
    for key in keys:
        name, *words = key.split(".")
        if name in NEVER or (name == "header" and not inside) or (name not in ("html", "body", *MAIN) and NOT_MAIN.intersection(words)):
            return True
        inside = inside or name in MAIN
    return False


#: Share of a container's text from which its largest part takes its place, and from which another part of it stays.
TAKES, STAYS = 0.6, 0.1


def _region(varying: list[list], paths: dict[int, tuple[int, str]]) -> tuple[int, frozenset[int]]:
    """The container that the article is in, by where the texts that vary are, and its parts with hardly any of them:
    from the page down, as long as one part has most of a container's text and the container has no heading of its own.
    Links do not count as text."""
    mass: Counter[int] = Counter()
    parts: dict[int, set[int]] = defaultdict(set)
    direct: Counter[int] = Counter()
    headed: set[int] = set()
    for e in varying:
        within, own = 0, max(0, e[6] - e[7])
        mass[0] += own
        for p in _chain(e[1], paths):
            name = paths[p][1].split(".")[0]
            if name in TEXTUAL:
                if name in HEADINGS and own:
                    headed.add(within)
                break
            parts[within].add(p)
            mass[p] += own
            within = p
        direct[within] += own
    at = 0
    while parts[at] and at not in headed:
        best = max(parts[at], key=lambda p: (mass[p], p))
        if mass[best] < TAKES * mass[at] or not mass[best]:
            break
        at = best
    return at, frozenset(p for p in parts[at] if mass[p] < STAYS * mass[at])


def _within(chain: list[int], region: int, but: frozenset[int]) -> bool:
    return (not region or region in chain) and not but.intersection(chain)


class Labels(NamedTuple):
    """wrapper: entries [kind, value] and ["t", path, whether it is main text on pages with an article, and on those
    without]; region: where the article is on pages without an article element, and its parts that are left out."""

    wrapper: list
    region: int
    but: frozenset[int]


def labels(k: Known) -> Labels:
    names = {e[1]: _names(e[1], k.paths) for e in slots(k.wrapper)}
    barred = {p: _barred(keys) for p, keys in names.items()}
    article = {p: any(key.split(".")[0] in MAIN for key in keys) for p, keys in names.items()}
    free = [e for e in slots(k.wrapper) if not barred[e[1]]]
    recurs = lambda e: e[5] > 1 and e[3] == e[4]  # noqa: E731  one text on several pages
    varying = [e for e in free if not recurs(e)]
    outside = [e for e in varying if not article[e[1]]]
    # Of one page alone nothing is known to vary, nor of pages that are all alike.
    at, but = _region(outside, k.paths) if k.pages > 1 and outside else (0, frozenset())

    def within(path: int) -> bool:
        return _within(_chain(path, k.paths), at, but)

    def said(entries: list) -> list:
        out: list = []
        for e in entries:
            if e[0] == "t":
                ok = not barred[e[1]]
                out.append(["t", e[1], int(ok and article[e[1]]), int(ok and within(e[1]) and not (varying and recurs(e)))])
            else:
                out.append([e[0], said(e[1]) if e[0] == "r" else e[1]])
        return out

    return Labels(said(k.wrapper), at, but)


def _to_text(x: Labels) -> str:
    """As JSON: what a page needs of its host."""
    return json.dumps([x.wrapper, x.region, sorted(x.but)], separators=(",", ":"))


def _from_text(said: str) -> Labels:
    wrapper, region, but = json.loads(said)
    return Labels(wrapper, region, frozenset(but))


def _flags(wrapper: list, shape: list) -> Iterator[tuple[int, tuple[int, int]]]:
    """(number of a text entry of the page, labels of the slot that it falls into)."""
    page = _raised(shape, wrapper)
    for i, j in pairs(wrapper, page):
        if i is None or j is None:
            continue
        if page[j][0] == "t":
            yield page[j][3], (wrapper[i][2], wrapper[i][3])
        elif page[j][0] == "r":
            yield from _flags(wrapper[i][1], page[j][1])


def _numbered(shape: tuple, counter: list[int]) -> list:
    """A shape as entries, its texts numbered."""
    out: list = []
    for e in shape:
        if e[0] == "t":
            out.append(["t", e[1], False, counter[0]])
            counter[0] += 1
        else:
            out.append([e[0], _numbered(e[1], counter) if e[0] == "r" else e[1], False])
    return out


#: Characters of hosts' labels that a worker holds, where an entry of a page's shape counts as SHAPE of them; the host
#: in use stays, whatever its size.
WORKER, SHAPE = 8_000_000, 50


class _Hosts:
    """The hosts a worker has met last: labels, and those of the text entries of their pages' shapes."""

    def __init__(self) -> None:
        self.held: OrderedDict[str, tuple[Labels, dict[tuple, dict[int, tuple[int, int]]], list[int]]] = OrderedDict()
        self.size = 0

    def of(self, said: str, shape: tuple) -> tuple[Labels, dict[int, tuple[int, int]]]:
        """Labels of the host, and of the page's text entries by aligning its stream with the wrapper."""
        if said in self.held:
            self.held.move_to_end(said)
        else:
            self.held[said] = _from_text(said), {}, [len(said)]
            self.size += len(said)
        own, shapes, size = self.held[said]
        found = shapes.get(shape)
        if found is None:
            found = shapes[shape] = dict(_flags(own.wrapper, _numbered(shape, [0])))
            size[0] += SHAPE * _entries(shape)
            self.size += SHAPE * _entries(shape)
        while self.size > WORKER and len(self.held) > 1:
            self.size -= self.held.popitem(last=False)[1][2][0]
        if self.size > WORKER and shapes:
            shapes.clear()
            self.size = size[0] = len(said)
        return own, found


_HOSTS = _Hosts()


def _entries(shape: tuple) -> int:
    return sum(1 + (_entries(e[1]) if e[0] == "r" else 0) for e in shape)


def _texts(entries: Iterable[tuple]) -> Iterator[tuple]:
    for e in entries:
        if e[0] == "r":
            yield from _texts(e[1])
        elif e[0] == "t":
            yield e


def main_text(page: Page, said: str) -> str:
    """The main text of a page by the labels of its host. A block for which the wrapper has no slot counts by where it
    is: in an article element, or else in the region, and in nothing that is barred."""
    entries, shape = stream(page)
    own, found = _HOSTS.of(said, shape)
    flags: list[tuple[int, int]] = [(0, 0)] * len(page.blocks)
    by_path: dict[int, tuple[int, int]] = {}
    for n, e in enumerate(_texts(entries)):
        flag = found.get(n)
        if flag is None:
            if e[1] not in by_path:
                keys = _names(e[1], page.paths)
                free = not _barred(keys)
                by_path[e[1]] = int(free and any(k.split(".")[0] in MAIN for k in keys)), int(free and _within(_chain(e[1], page.paths), own.region, own.but))
            flag = by_path[e[1]]
        for slot in e[2]:
            flags[slot] = flag
    tier = 0 if any(a for a, _ in flags) else 1
    return "\n".join(t for (_, t, _), f in zip(page.blocks, flags) if f[tier])


#: Bytes of labels up to which they are broadcast, wrappers that one task aligns, and pages' streams that it holds.
BROADCAST, TOGETHER, HELD = 16_000_000, 64, 1000
HOST = r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)"
_KNOWN = "host string, shape long, known string"


def _host(url_col: str):
    return F.lower(F.coalesce(F.regexp_extract(url_col, HOST, 1), F.lit(""))).alias("host")


def infer(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(host, known) of all pages, known as JSON. Pages without a host, a null url too, share the host ''."""
    rows = small_batches(pages).select(_host(url_col), F.col(html_col).cast("string").alias("html"))
    schema = pa.schema([("host", pa.string()), ("shape", pa.int64()), ("known", pa.string())])

    def seen(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """What is known by each host and stream among a task's pages."""
        held: dict[tuple[str, tuple], Known] = {}
        size = 0

        def out() -> pa.RecordBatch:
            rows = [(h, _path(0, repr(s)) >> 1, _to_json(k)) for (h, s), k in held.items()]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), schema.types)], schema=schema)

        for host, source in ((h, x) for batch in batches for at, texts in text_slices(batch.column(1)) for h, x in zip(batch.column(0).slice(at, len(texts)).to_pylist(), texts)):
            page = blocks(source)
            if not page.blocks:
                continue
            entries, shape = stream(page)
            key, own = (host, shape), known(page, entries)
            size += len(own.wrapper) * (key not in held)
            held[key] = _more(held[key], own) if key in held else own
            if len(held) >= HELD or size > 50 * HELD:
                yield out()
                held, size = {}, 0
        if held:
            yield out()

    def align(group: pd.DataFrame) -> pd.DataFrame:
        whole: Known | None = None
        for said in sorted(group["known"], key=lambda w: (-len(w), w)):  # the fullest first
            whole = _from_json(said) if whole is None else together(whole, _from_json(said))
        return pd.DataFrame({"host": [group["host"].iloc[0]], "shape": [group["shape"].min()], "known": [_to_json(whole)]})

    parts = kept(rows.mapInArrow(seen, _KNOWN), "streams")
    most = parts.groupBy("host").agg(F.count("*").alias("n")).agg(F.max("n").alias("n")).first().n or 1
    while True:
        groups = -(-most // TOGETHER)
        parts = parts.groupBy("host", F.pmod(F.xxhash64("shape"), F.lit(groups)).alias("_group")).applyInPandas(align, _KNOWN)
        if groups == 1:
            return parts.select("host", "known")
        most = groups


def _said(found: pd.Series) -> pd.Series:
    return found.map(lambda text: _to_text(labels(_from_json(text))))


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Per page: id, url, text, n_chars.

    text is the article, block by block (see main_text). Null and empty pages, and pages without main text, have the
    empty text; very long and very deep pages are read whole, in time in proportion to their size (what is nested deeper
    than DEEPEST counts to the element there), and aligned whole with their host's whole wrapper, in time that grows with
    the product of their lengths where they differ; rows with one id, null too, stay rows of their own; other columns
    are not read; an empty table gives an empty result.
    """
    rows = small_batches(pages).select(F.col(id_col).cast("long").alias("id"), F.col(url_col).alias("url"), _host(url_col), F.col(html_col).cast("string").alias("html"))
    said = cut(infer(pages, url_col, html_col).select("host", F.pandas_udf(_said, "string")("known").alias("said")))
    # Labels are a few hundred bytes a host. Up to BROADCAST bytes in all every task holds them and no page is
    # shuffled; beyond, pages are joined by host, where the engine splits a hot one.
    size = said.agg(F.coalesce(F.sum(F.octet_length("host") + F.octet_length("said")), F.lit(0)).alias("n")).first().n
    joined = rows.join(F.broadcast(said) if size <= BROADCAST else said, "host", "left").select("id", "url", "html", "said")
    schema = pa.schema([("id", pa.int64()), ("url", pa.string()), ("text", pa.string()), ("n_chars", pa.int64())])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, sources in text_slices(batch.column(2)):
                part = batch.slice(at, len(sources))
                texts = [main_text(blocks(h), w) if w else "" for h, w in zip(sources, part.column(3).to_pylist())]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], schema=schema)

    out = joined.mapInArrow(run, "id long, url string, text string, n_chars long")
    return out.select(F.col("id").alias(id_col), F.col("url").alias(url_col), "text", "n_chars")
