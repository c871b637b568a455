"""Main text of web pages: differencing against the nearest URLs, then the markup.

Pages are cut into lines, one per block, menus and all. Every page is paired
with its neighbours by URL path within the host and aligned with them by longest
common subsequence. Shared lines are the template and are deleted. The markup is
an exact check of what is left: menus, headers, footers, sidebars, notices,
adverts, forms and comments that it names go though they are the page's own, and
paragraphs of an article or main element, which is the main text if there is
one, come back though a neighbour has them too.

Differencing alone is not enough where menus and footers change from page to
page and neighbours share whole passages; see the README.
"""

from __future__ import annotations

import html
import re
from bisect import bisect_left
from collections import Counter, defaultdict
from collections.abc import Iterable, Sequence
from hashlib import blake2b
from os.path import commonprefix

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallywatch.functions.scale import written
from tallywatch.llm.common import col, map_rows
from tallywatch.llm.url_graph import host_of, path_of

# Above this share of its text a page loses only what the pages on both sides hold.
MOST_SHARED = 0.5
# Above this share the neighbour is a copy, and the next page beyond its copies is taken.
COPY_SHARED = 0.9

# What the markup says of a line: part of a menu or the like, nothing, in an article
# without being a paragraph, or article text.
OUT, LOOSE, BARE, PROSE = range(4)

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<(script|style|noscript|template|svg|textarea|select|iframe)\b.*?(?:</\1\s*>|\Z)"
    r"|<(/?)([a-z][a-z0-9:-]*)((?:\"[^\"]*\"|'[^']*'|[^>\"'])*+)>|<[/!?][^>]*>",
    re.S | re.I,
)
_ATTRIBUTE = re.compile(
    r"([a-z][a-z0-9_-]*)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.I
)
_SPACE = re.compile(r"\s+")
BLOCKS = frozenset(
    "address article aside blockquote body center dd details dialog div dl dt fieldset figcaption"
    " figure footer form h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav ol option p"
    " pre section summary table tbody tfoot thead title tr ul".split()
)
SPACED = frozenset("br td th img wbr".split())
SKIPPED = frozenset("head nav footer aside form menu button dialog".split())
SKIPPED_ROLES = frozenset(
    "navigation banner contentinfo complementary search form dialog alert alertdialog menu".split()
)
SKIPPED_NAMES = frozenset(
    "ad ads adv advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments"
    " consent cookie cookies discussion disqus footer gdpr masthead menu modal nav navbar navigation"
    " newsletter notice notices notification popup promo related replies reply share sharing sidebar"
    " signup social sponsor sponsored subscribe toolbar widget".split()
)
# Elements whose class or id can name a menu or advert: inline ones and headings are text.
CONTAINERS = frozenset(
    "aside center dd details div dl dt fieldset figure footer form header li menu nav ol p section"
    " table tbody td th tr ul".split()
)
# Beside a skipped name these leave a compound a menu or advert: site-footer, but not no-sidebar.
NEUTRAL_NAMES = frozenset(
    "area bar block bottom box buttons icons left links list main page right section site slot"
    " thread top unit".split()
)
# Blocks that hold articles of others.
OF_OTHERS = frozenset("comment comments discussion disqus related replies reply".split())
VOID = frozenset(
    "area base br col embed frame hr img input keygen link meta param source track wbr".split()
)
# Skipped elements that an article or main ends: these were never closed, or hold the whole page.
_OPEN_ENDED = frozenset("head nav header menu form".split())
_CELLS = frozenset("td th caption table".split())
_CLOSES_P = frozenset(
    "address article aside blockquote center dd details dialog div dl dt fieldset figcaption figure"
    " footer form h1 h2 h3 h4 h5 h6 header hr li main menu nav ol p pre section table ul".split()
)
_ROWS = frozenset("tbody thead tfoot".split())
# Start tag: the open elements it ends, and those beyond which it ends none.
_IMPLIED = {
    "li": (frozenset(["li"]), _CELLS | {"ul", "ol", "menu"}),
    "dt": (frozenset(["dt", "dd"]), _CELLS | {"dl"}),
    "dd": (frozenset(["dt", "dd"]), _CELLS | {"dl"}),
    "td": (frozenset(["td", "th"]), frozenset(["table", "tr"])),
    "th": (frozenset(["td", "th"]), frozenset(["table", "tr"])),
    "tr": (frozenset(["tr"]), frozenset(["table"])),
    "option": (frozenset(["option"]), _CELLS),
    "button": (frozenset(["button"]), _CELLS),
    "a": (frozenset(["a"]), _CELLS),
} | {t: (_ROWS, frozenset(["table"])) for t in _ROWS}
_P = (frozenset(["p"]), _CELLS | {"button"})
_TRACKED = BLOCKS | _CELLS
_PAGE = frozenset("html body article main".split())
# Within an article a line that only these hold is no paragraph.
_PLAIN = frozenset("center div section".split())
_PARAGRAPHS = tuple("p li dd dt td th pre blockquote figcaption caption h1 h2 h3 h4 h5 h6".split())


def _names_skipped(value: str) -> bool:
    """Whether a class or id names a menu, advert or the like, as a whole."""
    for name in value.split():
        words = set(re.split("[-_]+", name)) - {""}
        if not words.isdisjoint(SKIPPED_NAMES) and words <= SKIPPED_NAMES | NEUTRAL_NAMES:
            return True
    return False


def _left_out(tag: str, attributes: str, inside: bool) -> str:
    """Why an element is not part of the main text, or "". `inside`: within an article."""
    if tag in SKIPPED or tag == "header" and not inside:
        return "tag"
    if not attributes or attributes.isspace():
        return ""
    found = ""
    for m in _ATTRIBUTE.finditer(attributes):
        name, value = m[1].lower(), (m[2] or m[3] or m[4] or "").lower()
        if name == "hidden" or name == "aria-hidden" and value == "true":
            return "hidden"
        if name == "style" and re.search(r"display\s*:\s*none", value):
            return "hidden"
        if name == "role" and value.strip() in SKIPPED_ROLES:
            return "role"
        if name not in ("class", "id"):
            continue
        if tag == "article":
            if not {"comment", "comments", "reply", "replies"}.isdisjoint(value.split()):
                return "comment"
        # Within an article, the id of a paragraph or section is its slug.
        elif tag in CONTAINERS and (name == "class" or not inside or tag not in ("p", "section", "li")):
            if _names_skipped(value):
                of_others = not OF_OTHERS.isdisjoint(re.split(r"[-_\s]+", value))
                found = "others" if of_others else found or "name"
    return found


class _Open:
    """The open elements of a page, without inline ones."""

    def __init__(self):
        self.tags: list[str] = []
        self.count: dict[str, int] = defaultdict(int)

    def push(self, tag: str) -> None:
        self.tags.append(tag)
        self.count[tag] += 1

    def pop_through(self, targets: frozenset[str], stops: frozenset[str]) -> bool:
        """End the innermost of `targets` and all within it, if no stop lies between."""
        if not any(self.count[t] for t in targets):
            return False
        for at in range(len(self.tags) - 1, -1, -1):
            if self.tags[at] in targets:
                for tag in self.tags[at:]:
                    self.count[tag] -= 1
                del self.tags[at:]
                return True
            if self.tags[at] in stops:
                return False
        return False

    def start(self, tag: str) -> None:
        """End what a start tag ends without end tags."""
        if tag in _IMPLIED:
            self.pop_through(*_IMPLIED[tag])
        if tag in _CLOSES_P:
            self.pop_through(*_P)

    def end(self, tag: str) -> None:
        if tag in _PAGE:
            stops = frozenset()
        elif tag in _CELLS or tag in _ROWS or tag == "tr":
            stops = frozenset(["table"]) | _PAGE
        else:
            stops = _CELLS | _PAGE
            if tag == "li":
                stops |= {"ul", "ol", "menu"}
        self.pop_through(frozenset([tag]), stops)


def page_blocks(page: str | None) -> list[tuple[str, int]]:
    """All lines of the page, and what the markup says of each.

    An element that is left out ends with its end tag, with a start tag that
    implies it, or with its parent. Void elements hold nothing to leave out.
    An article or main element ends one that was left out by its name.
    """
    parts: list[str] = []
    lines: list[tuple[str, int]] = []
    inside, at, seen, plain = 0, 0, False, True
    opened = _Open()
    # The element left out: its tag, its place among the open ones, and why.
    skipped, place, why = "", 0, ""

    def add(text: str) -> None:
        nonlocal plain
        parts.append(text)
        if plain and inside and not text.isspace():
            plain = opened.tags[-1] in _PLAIN if opened.tags else False
            plain = plain and not any(opened.count[t] for t in _PARAGRAPHS)

    def flush() -> None:
        nonlocal plain
        if parts:
            line = _SPACE.sub(" ", html.unescape("".join(parts))).strip()
            if line:
                kind = OUT if skipped else LOOSE if not inside else BARE if plain else PROSE
                lines.append((line, kind))
            parts.clear()
        plain = True

    page = page or ""
    for m in _TOKEN.finditer(page):
        if m.start() > at:
            add(page[at : m.start()])
        at = m.end()
        if m[3] is None:
            continue
        tag, closing = m[3].lower(), bool(m[2])
        void = tag in VOID or not closing and m[4].endswith("/") and tag not in _PAGE
        if skipped:
            if closing:
                opened.end(tag)
            elif tag != "a" or skipped == "a":
                opened.start(tag)
            ends = False
            if len(opened.tags) <= place:
                ends = True
            elif not closing and tag in ("article", "main", "body") and not _left_out(tag, m[4], False):
                if skipped in _OPEN_ENDED or tag == "main" and why in ("name", "others"):
                    ends = True
                elif why == "name" and not opened.count["article"]:
                    ends = True
                elif why == "others" and not seen:
                    ends = True
            if ends or tag in BLOCKS:
                flush()
            elif tag in SPACED:
                parts.append(" ")
            if ends:
                own = closing and tag == skipped and len(opened.tags) <= place
                skipped = ""
                if own:
                    continue
            else:
                if not closing and not void and (tag in _TRACKED or tag == skipped):
                    if tag != "form" or not opened.count["form"]:
                        opened.push(tag)
                continue
        elif closing:
            opened.end(tag)
        elif tag != "a":
            opened.start(tag)
        reason = "" if closing or tag in VOID else _left_out(tag, m[4], inside > 0)
        if reason:
            flush()
            if not void:
                skipped, place, why = tag, len(opened.tags), reason
                opened.push(tag)
            continue
        if tag in BLOCKS:
            flush()
        elif tag in SPACED:
            parts.append(" ")
        if tag in ("article", "main"):
            inside = max(0, inside - 1) if closing else inside + 1
            seen = True
        if not closing and not void and tag in _TRACKED:
            opened.push(tag)
    if at < len(page):
        add(page[at:])
    flush()
    return lines


def main_kinds(blocks: list[tuple[str, int]]) -> tuple[int, ...]:
    """Kinds of the lines that can be main text: an article's if the page has one."""
    return (BARE, PROSE) if any(kind >= BARE for _, kind in blocks) else (LOOSE,)


def page_lines(page: str | None) -> tuple[list[str], bool]:
    """Lines that the markup alone leaves, and whether it says that these are the main text."""
    blocks = page_blocks(page)
    kinds = main_kinds(blocks)
    return [line for line, kind in blocks if kind in kinds], PROSE in kinds


def _aligned(a: Sequence, b: Sequence) -> Iterable[int]:
    """Places in `a` of a longest common subsequence, in steps as many as there are equal pairs."""
    where: dict[object, list[int]] = defaultdict(list)
    for j in range(len(b) - 1, -1, -1):
        where[b[j]].append(j)
    ends: list[int] = []
    links: list[tuple] = []
    for i, line in enumerate(a):
        for j in where.get(line, ()):
            k = bisect_left(ends, j)
            link = (i, links[k - 1] if k else None)
            if k == len(ends):
                ends.append(j)
                links.append(link)
            else:
                ends[k], links[k] = j, link
    link = links[-1] if links else None
    while link:
        yield link[0]
        link = link[1]


def _lengths(a: Sequence, b: Sequence) -> np.ndarray:
    """Length of a longest common subsequence of `a` and each prefix of `b`, by bit vectors."""
    masks: dict[object, int] = {}
    for j, line in enumerate(b):
        masks[line] = masks.get(line, 0) | 1 << j
    every = (1 << len(b)) - 1
    bits = every
    for line in a:
        if line in masks:
            both = bits & masks[line]
            bits = (bits + both | bits - both) & every
    raw = np.frombuffer(bits.to_bytes(len(b) // 8 + 1, "little"), dtype=np.uint8)
    unset = 1 - np.unpackbits(raw, bitorder="little")[: len(b)].astype(np.int64)
    return np.concatenate([[0], np.cumsum(unset)])


def shared_lines(a: Sequence, b: Sequence, pairs: int = 20_000) -> set[int]:
    """Places in `a` of a longest common subsequence of `a` and `b`.

    Lists with more equal pairs than `pairs` or four times their lines are halved
    where the two parts have the longest ones, so repeated lines cost no more
    than a bit per pair.
    """
    out: set[int] = set()
    parts = [(0, len(a), 0, len(b))]
    while parts:
        low, high, first, last = parts.pop()
        times = Counter(b[first:last])
        equal = sum(times[line] for line in a[low:high])
        if equal <= max(pairs, 4 * (high - low + last - first)) or high - low == 1:
            out.update(low + i for i in _aligned(a[low:high], b[first:last]))
            continue
        while low < high and first < last and a[low] == b[first]:
            out.add(low)
            low, first = low + 1, first + 1
        while low < high and first < last and a[high - 1] == b[last - 1]:
            high, last = high - 1, last - 1
            out.add(high)
        if high - low > 1:
            middle = (low + high) // 2
            ahead = _lengths(a[low:middle], b[first:last])
            behind = _lengths(a[middle:high][::-1], b[first:last][::-1])[::-1]
            cut = first + int(np.argmax(ahead + behind))
            parts += [(low, middle, first, cut), (middle, high, cut, last)]
        else:
            parts.append((low, high, first, last))
    return out


def outline(host: str, path: str, blocks: list[tuple[str, int]]) -> tuple[bytes, list[int], list[int]]:
    """What alignment needs of a page: its own key, and key and size of each line.

    Keys are hashes, of 64 bits for lines. Lines that the markup rules out have no size.
    """
    kinds = main_kinds(blocks)
    lines = [blake2b(line.encode(), digest_size=8).digest() for line, _ in blocks]
    sizes = [len(line) if kind in kinds else 0 for line, kind in blocks]
    page = blake2b(repr((host, path, sizes)).encode() + b"".join(lines), digest_size=16).digest()
    return page, [int.from_bytes(x, "big", signed=True) for x in lines], sizes


def compare(
    keys: list[int], sizes: list[int], path: str, other: list[int], other_path: str
) -> tuple[list[int], float, int]:
    """Lines shared with another page, their share of the text, and how near its URL is."""
    shared = sorted(shared_lines(keys, other))
    share = sum(sizes[i] for i in shared) / max(1, sum(sizes))
    return shared, share, len(commonprefix([path, other_path]))


def template(sides: list[tuple[int, float, list[int]]], most: float) -> tuple[set[int], set[int]]:
    """Places of a page's template lines, and of those that the pages on both sides hold.

    `sides` has (nearness, share, shared lines) for the page before and the page
    after, or one of them. The template is what the nearest one shares, or what
    both do if that would be most of the page.
    """
    sides = sorted(sides, key=lambda s: -s[0])
    both = set(sides[0][2]) & set(sides[1][2]) if len(sides) == 2 else set()
    return (set(sides[0][2]) if sides and sides[0][1] <= most else both), both


ORDER = ["host", "path", "page"]
_ALIGNED = "cut array<int>, share double, near int"


def neighbours(ordered: DataFrame) -> DataFrame:
    """`ordered` with the pages before and after each in its host, or null.

    `ordered` has host, path, page, keys and the number of the range of these
    that a row is in, so a host with most pages is spread out. What lies beyond
    the edge of a range comes from a table of one row per range.
    """
    place, value = F.struct(*ORDER), F.struct("host", "path", "page", "keys")
    edges = ordered.groupBy("range").agg(
        F.min_by(value, place).alias("first"), F.max_by(value, place).alias("last")
    )
    ranges = Window.orderBy(*[f"first.{c}" for c in ORDER])  # as many rows as ranges
    edges = edges.select(
        "range", F.lag("last").over(ranges).alias("beyond"), F.lead("first").over(ranges).alias("behind")
    )
    window = Window.partitionBy("range").orderBy(*ORDER)
    near = ordered.select(
        "*", F.lag(value).over(window).alias("before"), F.lead(value).over(window).alias("after")
    ).join(F.broadcast(edges), "range")
    for side, edge in (("before", "beyond"), ("after", "behind")):
        found = F.coalesce(side, edge)
        near = near.withColumn(side, F.when(found["host"] == F.col("host"), found))
    return near.drop("beyond", "behind")


def beyond_copies(aligned: DataFrame, copy: float) -> DataFrame:
    """(page, side, to) where the page beside one is a copy, sharing more than `copy`.

    The page to take is the one beyond all copies that follow each other on that
    side, up to the end of the host.
    """
    sides = ("before", "after")
    is_copy = {s: F.coalesce(F.col(f"{s}.share"), F.lit(0.0)) > copy for s in sides}
    # Where copies end: the page beside the last of them, null at the end of the host.
    stop = {s: F.when(~is_copy[s], F.struct(f"{s}.to")) for s in sides}
    pages = aligned.select(
        "range",
        F.struct(*ORDER).alias("place"),
        *[is_copy[s].alias(f"{s}_copy") for s in sides],
        *[stop[s].alias(f"{s}_stop") for s in sides],
    )
    ends = {s: F.when(F.col(f"{s}_stop").isNotNull(), F.col("place")) for s in sides}
    edges = pages.groupBy("range").agg(
        F.min("place").alias("first"),
        F.max_by("before_stop", ends["before"]).alias("before_stop"),
        F.min_by("after_stop", ends["after"]).alias("after_stop"),
    )

    def nearest(side: str, by: Window, upto: int):
        # A frame that reaches back; for the pages after, in the opposite order.
        order = F.col("first" if upto else "place")
        frame = by.orderBy(order if side == "before" else order.desc())
        return F.last(f"{side}_stop", ignorenulls=True).over(
            frame.rowsBetween(Window.unboundedPreceding, upto)
        )

    # As many rows as ranges.
    edges = edges.select(
        "range", *[nearest(s, Window.partitionBy(F.lit(0)), -1).alias(f"{s}_edge") for s in sides]
    )
    found = pages.select(
        "range",
        "place.page",
        *[f"{s}_copy" for s in sides],
        *[nearest(s, Window.partitionBy("range"), 0).alias(f"{s}_stop") for s in sides],
    ).join(F.broadcast(edges), "range")
    to = {s: F.coalesce(f"{s}_stop", f"{s}_edge")["to"].alias("to") for s in sides}
    copies = [F.struct(F.lit(s).alias("side"), to[s], F.col(f"{s}_copy").alias("copy")) for s in sides]
    return (
        found.where("before_copy or after_copy")
        .select("page", F.explode(F.array(*copies)).alias("found"))
        .where("found.copy and found.to is not null")
        .select("page", "found.side", "found.to")
    )


def differences(pages: DataFrame, copy: float = COPY_SHARED) -> DataFrame:
    """(page, sides) of all different pages that have a neighbour.

    `pages` has host, path and html; `page` is the key that `outline` gives, and
    `sides` are the lines shared with the page before and with the page after
    that are no copies.
    """

    def outlines(hosts, paths, texts) -> Iterable[tuple]:
        for host, path, text in zip(hosts, paths, texts):
            blocks = page_blocks(text)
            if blocks:
                yield host, path, *outline(host, path, blocks)

    different = map_rows(
        pages.where("host != ''"),
        "host string, path string, page binary, keys array<long>, sizes array<int>",
        ["host", "path", "html"],
        outlines,
    ).dropDuplicates(["page"])
    ranged = different.repartitionByRange(*ORDER).withColumn("range", F.spark_partition_id())
    ordered = written(ranged, "page-order")

    def beside(ranges, hosts, paths, wholes, lists, sizes, befores, afters) -> Iterable[tuple]:
        for number, host, path, whole, keys, size, *sides in zip(
            ranges, hosts, paths, wholes, lists, sizes, befores, afters
        ):
            yield number, host, path, whole, *[
                side and (*compare(keys, size, path, side["keys"], side["path"]), side["page"])
                for side in sides
            ]

    kind = f"struct<{_ALIGNED}, to binary>"
    aligned = map_rows(
        neighbours(ordered),
        f"range int, host string, path string, page binary, before {kind}, after {kind}",
        ["range", *ORDER, "keys", "sizes", "before", "after"],
        beside,
    )
    aligned = written(aligned, "page-aligned")

    other = ordered.select(
        F.col("page").alias("to"), F.col("path").alias("other_path"), F.col("keys").alias("other_keys")
    )
    pairs = beyond_copies(aligned, copy).join(ordered.select("page", "path", "keys", "sizes"), "page")

    def beyond(wholes, paths, sides, lists, sizes, other_paths, others) -> Iterable[tuple]:
        for whole, path, side, keys, size, other_path, found in zip(
            wholes, paths, sides, lists, sizes, other_paths, others
        ):
            yield whole, side, *compare(keys, size, path, found, other_path)

    sides = map_rows(
        pairs.join(other, "to"),
        f"page binary, side string, {_ALIGNED}",
        ["page", "path", "side", "keys", "sizes", "other_path", "other_keys"],
        beyond,
    )
    for side in ("before", "after"):
        near = aligned.where(F.col(side).isNotNull())
        sides = sides.unionAll(
            near.select("page", F.lit(side), *[f"{side}.{c}" for c in ("cut", "share", "near")])
        )
    # Of equally near pages the one before comes first.
    side = F.struct((F.col("side") == "after").alias("later"), "near", "share", "cut")
    return (
        sides.where(F.col("share") <= copy)
        .groupBy("page")
        .agg(F.array_sort(F.collect_list(side)).alias("sides"))
    )


def main_text(
    pages: DataFrame,
    id_col: str = "page_id",
    url_col: str = "url",
    html_col: str = "html",
    most: float = MOST_SHARED,
    copy: float = COPY_SHARED,
) -> DataFrame:
    """(page_id, url, text, n_cut) for every row of `pages`.

    `n_cut` counts the lines, menus and all, that differencing deleted. Null,
    empty and textless pages give an empty text. Pages without a host are not
    paired, nor are hosts with one page. Equal pages at one path of a host are
    one page, and each row gets its text.
    """
    base = pages.select(
        col(id_col).alias("page_id"),
        col(url_col).alias("url"),
        host_of(col(url_col)).alias("host"),
        path_of(col(url_col)).alias("path"),
        col(html_col).cast("string").alias("html"),
    )
    id_type = base.schema["page_id"].dataType.simpleString()

    def parsed(ids, urls, hosts, paths, texts) -> Iterable[tuple]:
        for page, url, host, path, text in zip(ids, urls, hosts, paths, texts):
            blocks = page_blocks(text)
            kinds = main_kinds(blocks)
            left = [(i, line, kind) for i, (line, kind) in enumerate(blocks) if kind in kinds]
            at, lines, marks = zip(*left, strict=True) if left else ((), (), ())
            yield page, url, outline(host, path, blocks)[0], at, "\n".join(lines), marks

    checked = map_rows(
        base,
        f"page_id {id_type}, url string, page binary, at array<int>, lines string, marks array<byte>",
        ["page_id", "url", "host", "path", "html"],
        parsed,
    ).join(differences(base, copy), "page", "left")

    def differ(ids, urls, places, texts, kinds, found) -> Iterable[tuple]:
        for page, url, at, lines, marks, sides in zip(ids, urls, places, texts, kinds, found):
            shared, both = template([(s["near"], s["share"], s["cut"]) for s in sides or ()], most)
            gone = {LOOSE: shared, BARE: both, PROSE: ()}
            keep = [i not in gone[mark] for i, mark in zip(at, marks)]
            back = sum(kept and i in shared for i, kept in zip(at, keep))
            text = "\n".join(x for x, kept in zip(lines.split("\n"), keep) if kept)
            yield page, url, text, len(shared) - back

    return map_rows(
        checked,
        f"page_id {id_type}, url string, text string, n_cut int",
        ["page_id", "url", "at", "lines", "marks", "sides"],
        differ,
    )
