"""HTML extraction by nearest-URL page differencing.

A page is cut into blocks of text. Pages of a host stand in order of their URL paths; each is aligned with the
nearest earlier page of another path (the first one with the next) by the longest common subsequence of
their blocks, and blocks that both share are deleted: menus, notices and footers that a site repeats.

What a page's own markup says goes before what a neighbour shares. Blocks in elements that are named as navigation,
footers, adverts, forms, comments and the like, by their element, role or class, are left out even where no
neighbour has them, and blocks in an ``article`` or ``main`` stay even where another article quotes them or is a
copy. Where a page marks no article, differencing alone decides among its other blocks.

Parsing takes time linear in a page, whatever stands in it.
"""

from __future__ import annotations

import html
import re
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Fixed values of HTML: elements that begin and end a block, those without content, and those with raw text.
BLOCKS = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre search section summary table tbody td tfoot th thead title tr ul".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
#: Elements that are never part of an article, and those that are so unless they stand in one.
OUTSIDE = frozenset("head nav footer aside form script style noscript template button select textarea iframe object svg math canvas audio video dialog menu search fieldset noembed noframes xmp title datalist".split())
#: Classes that name something else than the article, whole or as the last part of a class: ``main-nav``.
NAMES = frozenset(
    "nav navbar navigation menu menus submenu breadcrumb breadcrumbs masthead banner footer colophon sidebar aside widget widgets ad ads adv advert adverts advertisement advertisements advertising adsense sponsor sponsored promo promotion notice notices cookie cookies consent gdpr popup modal overlay newsletter comments respond disqus share sharing pagination pager toolbar".split()
)
#: Classes that do so where they stand whole only, and first parts that do: ``ad-slot``.
WHOLE = NAMES | frozenset("side complementary promoted alert dialog form search login signup subscribe comment reply replies social related recommended recommendations skip legal copyright".split())
FIRST = frozenset("nav navbar menu breadcrumb breadcrumbs ad ads advert cookie cookies consent sidebar footer share social related promo sponsor newsletter widget popup modal comment comments disqus".split())
#: Roles that do so, and those of the article.
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alertdialog alert menu menubar toolbar".split())
ARTICLE = frozenset("article main".split())

#: A tag without quoted values, and the name of any.
SIMPLE = re.compile(r"<(/?[a-zA-Z][^\s/>]*)((?:[\s/][^>\"']*)?)>")
NAME = re.compile(r"/?[a-zA-Z][^\s/>]*")
STOP = re.compile(r">|=\s*([\"'])")
NAMED = re.compile(r"(?:^|[\s\"'/])(class|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
PARTS = re.compile(r"[-_]+")
ENDS = {tag: re.compile(rf"</{tag}(?=[\s/>]|\Z)", re.I | re.A) for tag in RAW}

LEFT_OUT, PLAIN, IN_ARTICLE = 0, 1, 2
#: Pages in a part of the sorted pages, where there are more than the session's shuffle partitions hold.
PART = 10_000
#: Keys that are drawn for each border between parts.
DRAWN = 50


def other(name: str) -> bool:
    """Whether a class names something else than the article."""
    parts = PARTS.split(name)
    return name in WHOLE or parts[-1] in NAMES or parts[0] in FIRST


def standing(tag: str, attributes: str, now: int) -> int:
    """How blocks in an element stand, given how those in its parent do. A header stands as its article does, and
    is left out elsewhere. Ids say nothing, as headings have those of their words."""
    if now == LEFT_OUT or tag in OUTSIDE:
        return LEFT_OUT
    page = tag in ("html", "body")
    if "=" not in attributes:
        return LEFT_OUT if tag == "header" and now != IN_ARTICLE else IN_ARTICLE if tag in ARTICLE else now
    classes: list[str] = []
    roles: list[str] = []
    for m in NAMED.finditer(attributes):
        (classes if m[1].lower() == "class" else roles).extend((m[2] or m[3] or m[4] or "").lower().split())
    header = tag == "header" or any(PARTS.split(c)[-1] == "header" for c in classes)
    if not page and (header and now != IN_ARTICLE or not ROLES.isdisjoint(roles) or any(map(other, classes)) and tag != "main"):
        return LEFT_OUT
    return IN_ARTICLE if tag in ARTICLE or not page and not ARTICLE.isdisjoint(roles) else now


class Source:
    """A page's text, with finds that never look twice where there is nothing."""

    def __init__(self, page: str):
        self.page, self.none = page, {}

    def find(self, what: str, at: int) -> int:
        if self.none.get(what, len(self.page) + 1) <= at:
            return -1
        found = self.page.find(what, at)
        if found < 0:
            self.none[what] = at
        return found

    def tag_end(self, at: int) -> int:
        """The place after the tag that goes on here: a ``>`` outside of quoted values; -1 where there is none."""
        first = at
        while m := STOP.search(self.page, at):
            if not m[1]:
                return m.end()
            close = self.find(m[1], m.end())
            if close < 0:  # a value that never ends: the next > ends the tag
                close = self.find(">", m.end())
                return close + 1 if close >= 0 else -1
            at = close + 1
        close = self.find(">", first)
        return close + 1 if close >= 0 else -1

    def raw_end(self, tag: str, at: int) -> int:
        """Where the end tag of an element with raw text begins, or -1."""
        if tag in self.none:
            return -1
        m = ENDS[tag].search(self.page, at)
        if not m:
            self.none[tag] = at
        return m.start() if m else -1


def blocks(page: str | None) -> list[tuple[int, str]]:
    """(standing, text) of a page's blocks in order, without empty ones: references decoded, white space
    inside as one space. What is left out within a line does not part its block."""
    page = page or ""
    source = Source(page)
    out: list[tuple[int, str]] = []
    stack: list[tuple[str, int, bool]] = []  # tag, how its parent stands, whether it keeps the parent's block open
    open_tags: Counter[str] = Counter()
    parts: list[list[str]] = [[]]
    now, at = PLAIN, 0

    def flush() -> None:
        if parts[-1]:
            text = " ".join("".join(parts[-1]).split())
            if text:
                out.append((now, text))
            parts[-1].clear()

    def add(text: str) -> None:
        if text:
            parts[-1].append(html.unescape(text) if "&" in text else text)

    def pop() -> str:
        nonlocal now
        tag, before, inline = stack.pop()
        open_tags[tag] -= 1
        if inline or before != now:
            flush()
        if inline:
            parts.pop()
        now = before
        return tag

    while True:
        start = page.find("<", at)
        if start < 0:
            add(page[at:])
            break
        if start > at:
            add(page[at:start])
        if m := SIMPLE.match(page, start):
            name, attributes = m.groups()
            at = m.end()
        elif page.startswith("<!--", start):
            end = source.find("-->", start + 4)
            at = end + 3 if end >= 0 else len(page)
            continue
        elif page.startswith("<![CDATA[", start):
            end = source.find("]]>", start + 9)
            parts[-1].append(page[start + 9 : end if end >= 0 else len(page)])
            at = end + 3 if end >= 0 else len(page)
            continue
        elif page.startswith(("<!", "<?"), start):
            end = source.find(">", start)
            at = end + 1 if end >= 0 else len(page)
            continue
        elif m := NAME.match(page, start + 1):
            at = source.tag_end(m.end())
            if at < 0:  # a tag that the page's end cuts off
                break
            name, attributes = m[0], page[m.end() : at - 1]
        else:  # no tag
            parts[-1].append("<")
            at = start + 1
            continue
        closing, tag = name[0] == "/", name.lstrip("/").lower()
        if tag == "br":
            parts[-1].append(" ")
            continue
        if tag in BLOCKS and (not closing or open_tags[tag] or tag == "p"):
            flush()
        if closing:
            if open_tags[tag]:
                while pop() != tag:
                    pass
            continue
        if tag in BLOCKS and stack and stack[-1][0] == "p":  # a block ends an open paragraph
            pop()
        elif tag in ("li", "dt", "dd", "tr", "td", "th", "option") and stack and stack[-1][0] == tag:
            pop()
        if tag in VOID or attributes.endswith("/") and tag not in BLOCKS and tag not in RAW:
            continue
        new = standing(tag, attributes, now)
        inline = new != now and tag not in BLOCKS
        if inline:
            parts.append([])
        elif new != now:
            flush()
        stack.append((tag, now, inline))
        open_tags[tag] += 1
        now = new
        if tag in RAW:
            end = source.raw_end(tag, at)
            if tag in ("title", "textarea"):  # their text is text, without tags
                if end >= 0:
                    add(page[at:end])
                    at = end
            else:
                at = end if end >= 0 else len(page)
    while stack:
        pop()
    flush()
    return out


def place(url: str | None) -> tuple[str, str]:
    """(host, path) of a URL; the path without query, fragment, index names, endings and the last slash."""
    rest = re.sub(r"^[a-zA-Z][a-zA-Z0-9+.-]*:", "", (url or "").strip())
    rest = rest.removeprefix("//") if rest.startswith("//") else rest
    host, slash, path = re.split(r"[?#]", rest, maxsplit=1)[0].partition("/")
    path = re.sub(r"(?:/index)?(?:\.(?:html?|php|aspx?))?/*$", "", slash + path)
    return host.lower().rsplit("@", 1)[-1], path or "/"


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def lengths(a: list[int], b: list[int]) -> int:
    """The bit-parallel row of common subsequence lengths of all of ``a`` with prefixes of ``b``: the bits
    that are 0 among the first k number the length with the first k."""
    masks: dict[int, int] = {}
    for k, x in enumerate(b):
        masks[x] = masks.get(x, 0) | 1 << k
    full = (1 << len(b)) - 1
    row = full
    for x in a:
        hit = row & masks.get(x, 0)
        row = ((row + hit) | (row - hit)) & full
    return row


def prefix(row: int, n: int) -> list[int]:
    out, k = [0], 0
    for bit in reversed(bin(row | 1 << n)[3:]):
        k += bit == "0"
        out.append(k)
    return out


def common(a: list[int], b: list[int]) -> list[int]:
    """Places in ``a`` of a longest common subsequence with ``b``, in memory linear in both."""
    lo = 0
    while lo < len(a) and lo < len(b) and a[lo] == b[lo]:
        lo += 1
    ha, hb = len(a), len(b)
    while ha > lo and hb > lo and a[ha - 1] == b[hb - 1]:
        ha, hb = ha - 1, hb - 1
    ends = [*range(lo), *range(ha, len(a))]
    there, here = set(b[lo:hb]), set(a[lo:ha])
    mine = [k for k in range(lo, ha) if a[k] in there]
    other = [x for x in b[lo:hb] if x in here]
    if not mine:
        return sorted(ends)
    if len(mine) == 1:
        return sorted([*ends, mine[0]])
    half = len(mine) // 2
    left, right = [a[k] for k in mine[:half]], [a[k] for k in mine[half:]]
    up = prefix(lengths(left, other), len(other))
    down = prefix(lengths(right[::-1], other[::-1]), len(other))[::-1]
    cut = max(range(len(other) + 1), key=lambda k: up[k] + down[k])
    found = [mine[k] for k in common(left, other[:cut])] + [mine[half + k] for k in common(right, other[cut:])]
    return sorted([*ends, *found])


@dataclass
class Page:
    key: tuple[str, str]
    row: tuple
    standing: list[int]
    texts: list[str | None]
    marks: list[int]
    lent: bool = False  # stands here for its neighbours in another range only

    def text(self, mate: "Page | None") -> tuple[str, int, int]:
        """(main text, blocks in all, blocks shared with the mate)."""
        shared = set(common(self.marks, mate.marks)) if mate else set()
        marked = IN_ARTICLE in self.standing
        kept = [t for k, (s, t) in enumerate(zip(self.standing, self.texts)) if (s == IN_ARTICLE if marked else s == PLAIN and k not in shared)]
        return "\n".join(kept), len(self.texts), len(shared)


def paired(pages: Iterator[Page]) -> Iterator[tuple[Page, "Page | None"]]:
    """Each page with its mate, from pages in order of (host, path). Three pages are held at most."""
    first: Page | None = None  # the host's first page, while nothing else has come
    last: Page | None = None
    mate: Page | None = None
    for page in pages:
        if last is None or page.key[0] != last.key[0]:
            if first is not None:
                yield first, None
            first, last, mate = page, page, None
            continue
        if page.key[1] != last.key[1]:
            mate = last
        if first is not None:
            yield first, page if mate is not None else None
            first = None
        yield page, mate
        last = page
    if first is not None:
        yield first, None


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Per row ``id_col``, ``url_col``, ``text``, ``n_chars``, ``n_blocks`` and ``n_shared``.

    Null or empty html gives an empty text; a null URL counts as an empty one, all on one host. Pages of one
    path (repeated rows too) pair with the nearest other path, never with each other, and pairs are the same at
    every size and in any layout.
    Rows stay one to one; columns that are not named are not looked at; an empty table gives an empty result.

    Scale: pages are parsed where they are read, so that scripts and markup are not shuffled; blocks are
    shuffled once, to ranges of (host, path) that may begin and end within a host, and pairs are formed from the
    sorted stream in constant memory. The last page before a range and the first one after it go to the range too
    and give no row there. Borders come from a sample of the URLs, and no pair depends on them.
    """
    spark = pages.sparkSession
    id_type = pages.schema[id_col].dataType.simpleString()

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = [place(url) for url in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array([k[i] for k in keys], pa.string()) for i in range(2))], names=["url", "host", "path"])

    urls = pages.select(F.col(url_col).cast("string"))
    kinds = "url string, host string, path string"
    total = pages.count()
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), total // PART)
    drawn = sorted(place(r[0]) for r in urls.sample(min(1.0, DRAWN * n / max(total, 1)), seed=1).collect())
    borders = sorted({drawn[k * len(drawn) // n] for k in range(1, n)}) if drawn else []

    def ranged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in keyed(batches):
            at = [bisect_right(borders, k) for k in zip(*(batch.column(i).to_pylist() for i in (1, 2)))]
            yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), *batch.columns], names=["at", *batch.schema.names])

    # the ends of each range: at most two rows a range on the driver
    end = F.struct("host", "path", "url")
    ends = sorted(urls.mapInArrow(ranged, f"at int, {kinds}").groupBy("at").agg(F.min(end).alias("low"), F.max(end).alias("high")).collect())
    # (key, URL) of pages that other ranges need, and these ranges
    lent: dict[tuple, list[int]] = {}
    for one, two in zip(ends, ends[1:]):
        if one.high[0] == two.low[0]:
            lent.setdefault(tuple(one.high), []).append(two["at"])
            lent.setdefault(tuple(two.low), []).append(one["at"])

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, source = [], []
            for k, (url, page) in enumerate(zip(batch.column(1), batch.column(2))):
                own = place(url.as_py())
                found = blocks(page.as_py())
                # blocks that are left out anyway go on as marks only
                texts = [t if s != LEFT_OUT else None for s, t in found]
                stands, marks = [s for s, _ in found], [signed(xxhash.xxh64_intdigest(t)) for _, t in found]
                at = bisect_right(borders, own)
                for to in (at, *lent.get((*own, url.as_py()), ())):
                    rows.append((to, to != at, *own, stands, marks, texts))
                    source.append(k)
            kinds = [pa.int32(), pa.bool_(), pa.string(), pa.string(), pa.list_(pa.int8()), pa.list_(pa.int64()), pa.list_(pa.string())]
            columns = [pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)]
            source = pa.array(source, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(source), batch.column(1).take(source), *columns], names=["id", "url", "at", "lent", "host", "path", "standing", "marks", "texts"])

    slim = pages.select(F.col(id_col), F.col(url_col).cast("string"), F.col(html_col).cast("string"))
    parsed = slim.mapInArrow(parse, f"id {id_type}, url string, at int, lent boolean, host string, path string, standing array<byte>, marks array<long>, texts array<string>")
    ordered = parsed.repartitionById(len(borders) + 1, F.col("at")).drop("at").sortWithinPartitions("host", "path", "url", "id", "marks")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def stream() -> Iterator[Page]:
            for batch in batches:
                for r in zip(*(batch.column(k) for k in range(8))):
                    ident, url, only_lent, *own, stands, marks, texts = (c.as_py() for c in r)
                    yield Page(tuple(own), (ident, url), stands, texts, marks, only_lent)

        rows, size = [], 0
        for page, mate in paired(stream()):
            if page.lent:
                continue
            rows.append((*page.row, *page.text(mate)))
            size += len(rows[-1][2])
            if size > 1 << 22 or len(rows) >= 5000:
                yield made(rows)
                rows, size = [], 0
        if rows:
            yield made(rows)

    def made(rows: list[tuple]) -> pa.RecordBatch:
        kinds = [None, pa.string(), pa.string(), pa.int64(), pa.int64(), pa.int64()]
        cells = [[r[0], r[1], r[2], len(r[2]), r[3], r[4]] for r in rows]
        return pa.RecordBatch.from_arrays([pa.array([c[k] for c in cells], kind) for k, kind in enumerate(kinds)], names=[id_col, url_col, "text", "n_chars", "n_blocks", "n_shared"])

    return ordered.mapInArrow(run, f"`{id_col}` {id_type}, `{url_col}` string, text string, n_chars long, n_blocks long, n_shared long")
