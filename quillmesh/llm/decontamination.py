"""Benchmark decontamination by the q-gram lemma.

Texts and benchmark items are normalised (lower case, anything but letters and digits one space). An item is
leaked where a region of it, of half of its length or ``LEAST`` characters if that is more (but never more than
all of it) or longer, stands in a text with edits of at most a tenth of the region's length. An item of fewer than
ten characters, which allows no edit, is leaked where it stands in a text as whole words.

By the q-gram lemma a region of m characters with k edits shares at least m + 1 - q (k + 1) q-grams with its
copy, and these lie within k + 1 neighbouring diagonals (place in the text less place in the item). ``Q`` is 8 or,
for a short item, the most for which this bound is 1 or more, so that it always holds something. Hits
are counted per text, item and band of diagonals; bands overlap by half, so that any k + 1 neighbouring
diagonals lie within one. Bands that reach the bound are verified: along the best single diagonal first, then by
banded local alignment. A region of m characters with m / 10 edits scores m / 2 or more there, so what
scores less is no leak; the best span may be a leak itself; and else the rule itself decides: banded edit distances
from every start of a region.

The items are a stated query set: they are sent to the executors in blocks of at most ``BLOCK_CHARS``
characters, a pass over the texts for each block (of several blocks in one go where rows are only kept or left),
and every text is searched whole. Hits are expanded in steps of a bounded number.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .common import Scratch, unused

Q = 8
ERRORS = 0.1
LEAST = 64
COVER = 0.5
BLOCK_CHARS = 4_000_000
#: What an edit costs in the local alignment where an equal letter earns 1; a lost letter and four more make five.
EDIT = 4
#: Letters that a region needs for each edit in it.
PER_EDIT = round(1 / ERRORS)
#: Cells of a row that are worked on in one go.
CELLS = 1 << 20
#: Bytes of text that are looked at in one go.
CHUNK = 1 << 20
#: Candidates that are aligned together, at most.
TOGETHER = 64
#: Hits that are expanded in one go, pairs of text and item that are counted in one go, and blocks of items in one pass.
STEP, PAIRS, PER_PASS = 1 << 22, 1 << 22, 4
#: Bands that are verified as one stretch, at most.
STRETCH = 32

#: ASCII letters, digits and all bytes of other characters stay; anything else is a space.
TABLE = bytes(i if i >= 128 or chr(i).isalnum() else 32 for i in range(256))
MIX = np.uint64(0x9E3779B97F4A7C15)
BITS = 22


def lowered(text: str) -> bytes:
    """The text in lower case as UTF-8 where that keeps the places of its characters, else with A-Z lowered."""
    low = text.lower()
    return low.encode("utf-8", "surrogatepass") if len(low) == len(text) else text.encode("utf-8", "surrogatepass").lower()


def normal(text: str | None) -> bytes:
    return b" ".join(lowered(text or "").translate(TABLE).split())


def places(text: str) -> np.ndarray:
    """For each byte of the normalised text, and its end, the character of the text that it stands for."""
    raw = lowered(text)
    data = np.frombuffer(raw.translate(TABLE), np.uint8)
    space = data == 32
    kept = np.flatnonzero(~space | ~np.concatenate(([True], space[:-1])))
    if len(kept) and space[kept[-1]]:
        kept = kept[:-1]
    chars = np.cumsum((np.frombuffer(raw, np.uint8) & 0xC0) != 0x80) - 1
    return np.append(chars[kept], chars[kept[-1]] + 1 if len(kept) else 0)


def grams(data: np.ndarray, q: int) -> np.ndarray:
    """The q bytes from each place as one number."""
    padded = np.concatenate((data, np.zeros(8 - q, np.uint8)))
    whole = np.ndarray((max(0, len(data) - q + 1),), "<u8", padded, strides=(1,))
    return whole & np.uint64((1 << 8 * q) - 1)


class Part:
    """The q-grams of some items of a block, by one q; with ``whole`` only the first of each item."""

    def __init__(self, q: int, numbers: list[int], texts: list[bytes], whole: bool = False):
        self.q, self.numbers = q, np.array(numbers, np.int64)
        each = [grams(np.frombuffer(texts[i], np.uint8), q)[: 1 if whole else None] for i in numbers]
        every = np.concatenate(each)
        item = np.repeat(np.arange(len(each)), [len(g) for g in each])
        at = np.concatenate([np.arange(len(g)) for g in each])
        order = np.argsort(every, kind="stable")
        self.values, self.first, self.count = np.unique(every[order], return_index=True, return_counts=True)
        self.item, self.at = item[order], at[order]
        self.there = np.zeros(1 << BITS, bool)
        self.there[self.slot(self.values)] = True

    @staticmethod
    def slot(values: np.ndarray) -> np.ndarray:
        return (values * MIX >> np.uint64(64 - BITS)).astype(np.int64)

    def hits(self, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(place in the data, gram number) wherever a gram of some item stands."""
        at, number = [], []
        for lo in range(0, len(data), CHUNK):
            value = grams(data[lo : lo + CHUNK + self.q - 1], self.q)
            maybe = np.flatnonzero(self.there[self.slot(value)])
            value = value[maybe]
            near = np.searchsorted(self.values, value).clip(max=len(self.values) - 1)
            same = self.values[near] == value
            at.append(maybe[same] + lo)
            number.append(near[same])
        return (np.concatenate(at), np.concatenate(number)) if at else (np.empty(0, np.int64), np.empty(0, np.int64))

    def steps(self, number: np.ndarray) -> list[slice]:
        """Runs of hits with at most about ``STEP`` entries."""
        upto = np.cumsum(self.count[number])
        cuts = np.searchsorted(upto, np.arange(STEP, int(upto[-1]) + 1, STEP), "right") if len(upto) else np.empty(0, np.int64)
        edges = sorted({0, len(number), *cuts.tolist()})
        return [slice(a, b) for a, b in zip(edges, edges[1:])]

    def entries(self, at: np.ndarray, number: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(place in the data, item in this part, place in the item) of each hit with each item that has its gram."""
        many = self.count[number]
        entry = np.repeat(self.first[number] - np.cumsum(many) + many, many) + np.arange(many.sum())
        return np.repeat(at, many), self.item[entry], self.at[entry]


class Index:
    """The q-grams of a block of items. Items without a letter or digit match nothing."""

    def __init__(self, items: list[tuple[object, bytes]]):
        self.ids = [i for i, text in items if text]
        self.texts = [text for _, text in items if text]
        sizes = np.array([len(t) for t in self.texts], np.int64)
        self.region = np.minimum(sizes, np.maximum(np.ceil(sizes * COVER).astype(np.int64), LEAST))
        # the bound is least for one of ten lengths, as it falls where one more edit is allowed
        longer = np.minimum(self.region[:, None] + np.arange(PER_EDIT), sizes[:, None])
        edits = longer // PER_EDIT
        q = (longer // (edits + 1)).min(1, initial=Q)
        self.least = (longer + 1 - q[:, None] * (edits + 1)).min(1, initial=1 << 40)
        # edits of a region as long as the item, and one
        self.width = sizes // PER_EDIT + 1
        tiny = sizes < PER_EDIT
        self.parts = [Part(k, np.flatnonzero((q == k) & ~tiny).tolist(), self.texts) for k in sorted(set(q[~tiny].tolist()))]
        self.exact = [Part(k, np.flatnonzero((q == k) & tiny).tolist(), self.texts, True) for k in sorted(set(q[tiny].tolist()))]

    def candidates(self, part: Part, texts: list[bytes], number: int = 0) -> Iterator[tuple[int, int, int, int, int]]:
        """(text, item, lowest and highest diagonal, best diagonal or -1) of the bands that reach the bound."""
        n = len(part.numbers)
        if len(texts) * n > PAIRS and len(texts) > 1:
            half = len(texts) // 2
            yield from self.candidates(part, texts[:half], number)
            yield from self.candidates(part, texts[half:], number + half)
            return
        starts = np.cumsum([0] + [len(t) + Q for t in texts])
        at, gram = part.hits(np.frombuffer((b"\0" * Q).join(texts), np.uint8))
        steps = part.steps(gram)
        if not steps:
            return
        total, held = np.zeros(len(texts) * n, np.int64), None
        for step in steps:  # pairs with too few hits in all need no bands
            held = self.paired(part, starts, at[step], gram[step])
            total += np.bincount(held[0], minlength=len(total))
        good = np.flatnonzero(total >= np.tile(self.least[part.numbers], len(texts)))
        heavy = good[total[good] > STEP]
        for pair in heavy.tolist():  # one text and item with very many equal grams: every band is verified
            t, i = pair // n, int(part.numbers[pair % n])
            width = int(self.width[i])
            for lo in range(-len(self.texts[i]), len(texts[t]), STRETCH * width):
                yield number + t, i, lo, lo + (STRETCH + 1) * width - 1, -1
        good = good[total[good] <= STEP]
        group = np.cumsum(total[good]) // STEP
        for k in np.unique(group).tolist():
            wanted = np.zeros(len(total), bool)
            wanted[good[group == k]] = True
            some = []
            for step in steps:
                found = held if len(steps) == 1 else self.paired(part, starts, at[step], gram[step])
                stays = wanted[found[0]]
                some.append([x[stays] for x in found])
            for t, *rest in self.banded(*map(np.concatenate, zip(*some)), part):
                yield number + t, *rest

    def paired(self, part: Part, starts: np.ndarray, at: np.ndarray, gram: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(pair of text and item, place in the item, diagonal) of hits."""
        at, item, place = part.entries(at, gram)
        text = np.searchsorted(starts, at, "right") - 1
        return text * len(part.numbers) + item, place, at - starts[text] - place

    def banded(self, pair: np.ndarray, place: np.ndarray, diagonal: np.ndarray, part: Part) -> Iterator[tuple[int, int, int, int, int]]:
        order = np.lexsort((diagonal, pair))
        pair, diagonal, place = pair[order], diagonal[order], place[order]
        item = part.numbers[pair % len(part.numbers)]
        band = diagonal // self.width[item]
        low = int(band.min())
        span = int(band.max()) - low + 2
        key = pair * span + band - low
        heads = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
        ends = np.append(heads[1:], len(key))
        # the double band of b and b + 1; where b + 1 stands alone, b alone says as much
        last = ends.copy()
        twin = np.flatnonzero(key[heads[1:]] == key[heads[:-1]] + 1)
        last[twin] = ends[twin + 1]
        good = np.flatnonzero(last - heads >= self.least[item[heads]])
        out: list[list[int]] = []
        for a, own, b in zip(heads[good].tolist(), ends[good].tolist(), last[good].tolist()):
            i = int(item[a])
            if self.gathered(place[a:b], i, part.q):
                width = int(self.width[i])
                t, hi = int(pair[a]) // len(part.numbers), (int(band[a]) + 2) * width - 1
                # where b has enough hits alone, the region may lie in b - 1 and b, though b - 1 may have none
                lo = (int(band[a]) - (own - a >= self.least[i])) * width
                if out and out[-1][:2] == [t, i] and lo <= out[-1][3] and lo - out[-1][2] < STRETCH * width:
                    out[-1][3], out[-1][5] = hi, b
                else:
                    out.append([t, i, lo, hi, a, b])
        for t, i, lo, hi, a, b in out:
            values, counts = np.unique(diagonal[a:b], return_counts=True)
            yield t, i, lo, hi, int(values[counts.argmax()])

    def gathered(self, place: np.ndarray, i: int, q: int) -> bool:
        """Whether some region of the item has enough grams among those hit."""
        own = np.unique(place)
        region = int(self.region[i])
        within = np.searchsorted(own, own + region - q, "right") - np.arange(len(own))
        if within.max() >= self.least[i]:
            return True
        # a longer region of m characters has m + 1 - q (m / 10 + 1) grams or more, if not in any part of ``region``
        spare = PER_EDIT * np.arange(len(own)) - (PER_EDIT - q) * own
        first = np.searchsorted(own, own + q - region, "right") - 1
        long = np.flatnonzero(first >= 0)
        least = np.minimum.accumulate(spare)[first[long]]
        return bool(len(long) and (spare[long] - least).max() >= (PER_EDIT - q) * q - PER_EDIT * q)

    def whole_words(self, part: Part, texts: list[bytes]) -> Iterator[tuple[int, int, int, int, int, int, int]]:
        """Where the items of a part stand as whole words, without edits."""
        starts = np.cumsum([0] + [len(t) + Q for t in texts])
        at, gram = part.hits(np.frombuffer((b"\0" * Q).join(texts), np.uint8))
        for step in part.steps(gram):
            where, items, _ = part.entries(at[step], gram[step])
            owner = np.searchsorted(starts, where, "right") - 1
            for t, i, a in zip(owner.tolist(), part.numbers[items].tolist(), (where - starts[owner]).tolist()):
                text, b = texts[t], a + len(self.texts[i])
                if text[a:b] == self.texts[i] and text[a - 1 : a] in (b"", b" ") and text[b : b + 1] in (b"", b" "):
                    yield t, i, a, b, 0, b - a, 0

    def search(self, texts: list[bytes]) -> list[tuple[int, int, int, int, int, int, int]]:
        """(text, item, start and end in the text, start and end in the item, edits) of all leaks; one for
        each stretch of diagonals."""
        out, open_ones = set(), []
        for part in self.exact:
            out.update(self.whole_words(part, texts))
        for part in self.parts:
            for t, i, lo, hi, best in self.candidates(part, texts):
                n = len(self.texts[i])
                if best >= 0 and texts[t][best : best + n] == self.texts[i]:
                    out.add((t, i, best, best + n, 0, n, 0))
                else:
                    open_ones.append((hi - lo, t, i, lo, hi))
        open_ones.sort()
        while open_ones:
            many = max(1, min(TOGETHER, CELLS // (open_ones[min(TOGETHER, len(open_ones)) - 1][0] + 1)))
            some, open_ones = open_ones[:many], open_ones[many:]
            for (_, t, i, lo, hi), (score, *got) in zip(some, align([(self.texts[i], texts[t], lo, hi) for _, t, i, lo, hi in some])):
                least = int(self.region[i])
                if 2 * score < least:
                    continue
                if not (got[3] - got[2] >= least and got[4] <= ERRORS * (got[3] - got[2])):
                    got = region(self.texts[i], texts[t], lo, hi, least)
                if got:
                    out.add((t, i, *got))
        return sorted(out)


def align(pairs: list[tuple[bytes, bytes, int, int]]) -> list[tuple[int, int, int, int, int, int]]:
    """For each (item, text, lowest and highest diagonal) the best local alignment within these diagonals:
    (score, text start, end, item start, end, edits), of score 0 where no letter is equal.

    An equal letter earns 1 and an edit costs ``EDIT``. All pairs go together: a row is one letter of every
    item, its columns are the diagonals."""
    n, width, rows = len(pairs), max(hi - lo for _, _, lo, hi in pairs) + 1, max(len(item) for item, *_ in pairs)
    # the text's bytes that the bands reach; byte 0 stands outside of texts, where nothing is equal
    strip = np.zeros((n, rows + width), np.uint8)
    items = np.full((n, rows), 1, np.uint8)
    low = np.array([lo for _, _, lo, _ in pairs])
    for k, (item, text, lo, _) in enumerate(pairs):
        a, b = max(lo, 0), min(lo + rows + width, len(text))
        if a < b:
            strip[k, a - lo : b - lo] = np.frombuffer(text, np.uint8, b - a, a)
        items[k, : len(item)] = np.frombuffer(item, np.uint8)
    columns = np.arange(width)
    score = np.zeros((n, width), np.int64)
    begin_i, begin_t, edits = score.copy(), low[:, None] + columns, score.copy()
    last, best, who = np.full((n, 1), -1), np.zeros((n, 6), np.int64), np.arange(n)
    for i in range(rows):
        at = i + low[:, None] + columns
        here = strip[:, i : i + width]
        equal = here == items[:, i : i + 1]
        new = np.where(here > 0, score + np.where(equal, 1, -EDIT), -1)
        above = np.concatenate((score[:, 1:] - EDIT, last), 1)  # an item letter that the text lacks
        up = above > new
        new = np.where(up, above, new)
        bi = np.where(up, np.concatenate((begin_i[:, 1:], last), 1), begin_i)
        bt = np.where(up, np.concatenate((begin_t[:, 1:], last), 1), begin_t)
        ed = np.where(up, np.concatenate((edits[:, 1:] + 1, last), 1), edits + ~equal)
        slope = new + EDIT * columns  # text letters that the item lacks
        top = np.maximum.accumulate(slope, 1)
        source = np.maximum.accumulate(np.where(slope == top, columns, 0), 1)
        new = top - EDIT * columns
        bi, bt = np.take_along_axis(bi, source, 1), np.take_along_axis(bt, source, 1)
        ed = np.take_along_axis(ed, source, 1) + columns - source
        fresh = new <= 0
        score = np.where(fresh, 0, new)
        begin_i, begin_t, edits = np.where(fresh, i + 1, bi), np.where(fresh, at + 1, bt), np.where(fresh, 0, ed)
        k = score.argmax(1)
        better = np.flatnonzero(score[who, k] > best[:, 0])
        if len(better):
            c = k[better]
            best[better] = np.column_stack((score[better, c], begin_t[better, c], at[better, c] + 1, begin_i[better, c], np.full(len(c), i + 1), edits[better, c]))
    return [tuple(b.tolist()) for b in best]


def step(edits: np.ndarray, equal: np.ndarray, inside: np.ndarray, columns: np.ndarray) -> np.ndarray:
    """Least edits on each diagonal after one more item letter, from those before it."""
    new = np.where(inside, edits + ~equal, FAR)
    np.minimum(new[:, :-1], edits[:, 1:] + 1, out=new[:, :-1])  # an item letter that the text lacks
    new -= columns  # text letters that the item lacks
    np.minimum.accumulate(new, 1, out=new)
    new += columns
    return new


#: More edits than any region has.
FAR = np.int32(1 << 28)


def region(item: bytes, text: bytes, lo: int, hi: int, least: int) -> tuple[int, int, int, int, int] | None:
    """The (text start, end, item start, end, edits) of a region of ``least`` letters or more of the item that
    stands in the text, within these diagonals, with at most one edit for ``PER_EDIT`` letters; None where there is none.

    A region's worth is its letters less ``PER_EDIT`` for each edit, and must not be below 0. Edits are counted from
    every start up to ``least`` letters; from there on a path's start does not matter, so all go on as one."""
    n, width = len(item), hi - lo + 1
    strip = np.zeros(n + width, np.uint8)
    a, b = max(lo, 0), min(lo + n + width, len(text))
    if a >= b:
        return None
    strip[a - lo : b - lo] = np.frombuffer(text, np.uint8, b - a, a)
    reach = np.lib.stride_tricks.sliding_window_view(strip, width)[:n]
    equal, inside, columns = reach == np.frombuffer(item, np.uint8)[:, None], reach > 0, np.arange(width, dtype=np.int32)
    best, at, on = -1, None, None
    many = max(1, CELLS // width)
    for first in range(0, n - least + 1, many):
        starts = min(many, n - least + 1 - first)
        edits = np.zeros((starts, width), np.int32)
        for j in range(first, first + least):
            edits = step(edits, equal[j : j + starts], inside[j : j + starts], columns)
        for k in range(starts):
            end = first + k + least
            worth = least - PER_EDIT * edits[k].astype(np.int64)
            if on is not None:
                # the same step in worths
                go = np.where(inside[end - 1], on + 1 - PER_EDIT * ~equal[end - 1], -int(FAR))
                go[:-1] = np.maximum(go[:-1], on[1:] + 1 - PER_EDIT)
                worth = np.maximum(worth, np.maximum.accumulate(go + PER_EDIT * columns) - PER_EDIT * columns)
            on = worth
            top = int(on.argmax())
            if on[top] > best:
                best, at = int(on[top]), (end, top)
    if at is None:
        return None
    # back from the end of the best one to its start: the same steps over what is reversed
    end, column = at
    edits = np.full((1, width), FAR, np.int32)
    edits[0, width - 1 - column] = 0
    np.minimum(edits, edits[0, width - 1 - column] + np.where(columns > width - 1 - column, columns - (width - 1 - column), FAR), out=edits)
    for start in range(end - 1, -1, -1):
        edits = step(edits, equal[start : start + 1, ::-1], inside[start : start + 1, ::-1], columns)
        k = int(edits[0].argmin())
        if end - start >= least and end - start - PER_EDIT * int(edits[0, k]) >= best:
            return start + lo + width - 1 - k, end + lo + column, start, end, int(edits[0, k])
    raise AssertionError("a region has a start")


def blocks(benchmark: DataFrame, id_col: str, text_col: str, most: int = BLOCK_CHARS) -> Iterator[Index]:
    """Indexes of the items, at most about ``most`` characters each; one without items for an empty table."""
    text = F.col(text_col).cast("string")
    total = benchmark.agg(F.coalesce(F.sum(F.length(text)), F.lit(0))).first()[0]
    n = max(1, -(-total // most))
    for k in range(n):
        rows = benchmark.where(F.pmod(F.xxhash64(id_col, text), F.lit(n)) == k).select(id_col, text.alias("t")).collect()
        yield Index([(r[0], normal(r.t)) for r in rows])


def pieces(texts: list[str | None], most: int = 1 << 22) -> Iterator[tuple[int, list[bytes]]]:
    """Normalised texts in runs of about ``most`` bytes, with the number of the first."""
    run, size, first = [], 0, 0
    for k, t in enumerate(texts):
        run.append(normal(t))
        size += len(run[-1])
        if size >= most:
            yield first, run
            run, size, first = [], 0, k + 1
    if run:
        yield first, run


def leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """One row for each leak: ``id_col``, ``item_col``, ``start`` and ``end`` (characters of the text),
    ``item_start`` and ``item_end`` (bytes of the normalised item) and ``edits``.

    Ids are of any plain type and may be null. Where both tables have the same name for theirs, the item's gets an
    underscore in front. Documents without leaks, null and empty texts give no row; repeated rows give theirs each
    time. Columns that are not named are not looked at. An empty table on either side gives an empty result."""
    (named,) = unused([id_col, "start", "end", "item_start", "item_end", "edits"], item_col)
    kind = benchmark.schema[item_col].dataType
    own = to_arrow_type(kind)
    schema = f"`{id_col}` {docs.schema[id_col].dataType.simpleString()}, `{named}` {kind.simpleString()}, start long, end long, item_start long, item_end long, edits long"
    names = [id_col, named, "start", "end", "item_start", "item_end", "edits"]
    kinds = [own, *[pa.int64()] * 5]
    slim = docs.select(id_col, F.col(text_col).cast("string"))
    out = None
    for index in blocks(benchmark, item_col, item_text):
        shared = docs.sparkSession.sparkContext.broadcast(index)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                texts, rows, which = batch.column(1).to_pylist(), [], []
                for first, run_of in pieces(texts):
                    for t, i, a, b, c, d, e in shared.value.search(run_of):
                        at = places(texts[first + t])
                        which.append(first + t)
                        rows.append((shared.value.ids[i], int(at[a]), int(at[b - 1]) + 1, c, d, e))
                columns = [pa.array([r[k] for r in rows], kinds[k]) for k in range(6)]
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(which, pa.int64())), *columns], names=names)

        part = slim.mapInArrow(run, schema)
        out = part if out is None else out.unionByName(part)
    return out


def leaked(shared: Broadcast) -> Callable:
    """A function of a text column: whether an item of the broadcast index is leaked in it."""

    @F.pandas_udf("boolean")
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for part in parts:
            found = np.zeros(len(part), bool)
            for first, run_of in pieces([t if isinstance(t, str) else None for t in part]):
                found[[first + x[0] for x in shared.value.search(run_of)]] = True
            yield pd.Series(found)

    return run


def decontaminate(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text: str = "text", most: int = BLOCK_CHARS) -> DataFrame:
    """The rows of ``docs`` without any leak, with the columns of ``docs``; nothing is shuffled.

    Null and empty texts hold no leak and stay; repeated rows stay or go together; other columns, whatever
    their names, come along; an empty table on either side does no harm. ``PER_PASS`` blocks of items are searched
    in one pass; what they leave of a larger benchmark's first blocks is written once before the next pass, so that a
    worker never holds more blocks than that."""
    scratch = Scratch(docs.sparkSession, "decontamination")
    for k, index in enumerate(blocks(benchmark, item_col, item_text, most)):
        if k and k % PER_PASS == 0:
            docs = scratch.table(docs)
            scratch.release(docs)  # what it was made from
        shared = docs.sparkSession.sparkContext.broadcast(index)
        docs = docs.where(~leaked(shared)(F.col(text_col).cast("string")))
    return docs
