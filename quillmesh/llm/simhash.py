"""SimHash near-duplicates: fingerprints, a popcount embedding, a grid range-join and exact checks.

A fingerprint's 64 bits are cut into segments of two. The embedding is the vector of bits set per segment;
the Manhattan distance of two such vectors is never above the Hamming distance of the fingerprints, so it
bounds it from below. Counts are kept in unary (0: 00, 1: 01, 2: 11), whereby the Manhattan distance is the
popcount of the xor of two embeddings.

Range join: the segments form ``groups`` axes of a grid. Where the Manhattan distance is at most d, at
most d axes differ, so at least ``groups - d`` axes agree. Every fingerprint goes to one cell for each
choice of that many axes, keyed by its counts there; every pair within d shares a cell. No pairs are
written: a cell returns a spanning forest of its links, found by (1) the Manhattan bound, (2) the exact
Hamming distance. A cell of more than ``block`` fingerprints is dealt to pairs of blocks, each small
enough for one task, so no cell meets whole in a task and none of its links are lost.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, unused
from .components import components

SEED = 42
CHUNK = 1 << 15
#: Words in a shingle, bits that linked fingerprints may differ in, and axes of the grid, where nothing else is asked for.
SHINGLE, DISTANCE, GROUPS = 5, 6, 9
#: Cells of up to so many fingerprints are compared together.
SMALL = 32


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """The 64-bit fingerprint of one text: A-Z lower-cased, words split at ASCII white space, a bit is set
    where over half of the shingles' hashes have it. No words (null, empty, blank): zero."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    whole = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    starts = np.concatenate(([0], ends[:-1]))
    k = min(shingle, len(words))
    starts, ends = starts[: len(words) - k + 1], ends[k - 1 :] - 1
    n, counts, digest = len(starts), np.zeros(64, np.int64), xxhash.xxh64_digest
    for at in range(0, n, CHUNK):
        hashes = b"".join([digest(whole[s:e], SEED) for s, e in zip(starts[at : at + CHUNK].tolist(), ends[at : at + CHUNK].tolist())])
        counts += np.unpackbits(np.frombuffer(hashes, np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(counts * 2 > n).tobytes(), "big")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, carry: str | None = None) -> DataFrame:
    """``id_col`` and ``fp`` (the fingerprint as a signed long) of every row, and the column ``carry``."""
    more = [carry] if carry else []

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.fromiter((fingerprint(t.as_py(), shingle) for t in batch.column(1)), np.uint64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found.view(np.int64)), *batch.columns[2:]], names=[id_col, "fp", *more])

    slim = docs.select(id_col, F.col(text_col).cast("string"), *more)
    kinds = [f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in (id_col, *more)]
    return slim.mapInArrow(run, ", ".join([kinds[0], "fp long", *kinds[1:]]))


def axes(groups: int) -> list[int]:
    """Bit masks of the grid's axes: runs of two-bit segments, as even as can be."""
    cuts = [round(i * 32 / groups) * 2 for i in range(groups + 1)]
    return [((1 << hi) - 1) ^ ((1 << lo) - 1) for lo, hi in zip(cuts, cuts[1:])]


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


EVEN = 0x5555555555555555


def embed(fp: str = "fp"):
    """The unary bit counts per two-bit segment, as a column."""
    x, y = F.col(fp), F.shiftrightunsigned(F.col(fp), 1)
    return x.bitwiseOR(y).bitwiseAND(F.lit(EVEN)).bitwiseOR(F.shiftleft(x.bitwiseAND(y).bitwiseAND(F.lit(EVEN)), 1))


def unary(fp: np.ndarray) -> np.ndarray:
    """As :func:`embed`, for an array of uint64."""
    one, even = np.uint64(1), np.uint64(EVEN)
    return (fp | fp >> one) & even | (fp & fp >> one & even) << one


def forest(fps: np.ndarray, distance: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Links that span every component of one cell's fingerprints; at most one per fingerprint.

    From each seed a search spreads over those not reached yet, so tight clusters cost little more than
    one pass; the memory is a few arrays of the cell's length."""
    codes, rest, found = unary(fps), np.arange(len(fps)), []
    while len(rest) > 1:
        queue, rest = [int(rest[0])], rest[1:]
        while queue and len(rest):
            at = queue.pop()
            near = np.bitwise_count(codes[rest] ^ codes[at]) <= distance
            near[near] = np.bitwise_count(fps[rest[near]] ^ fps[at]) <= distance
            if near.any():
                got = rest[near]
                found.append((np.full(len(got), fps[at]), fps[got]))
                queue.extend(got.tolist())
                rest = rest[~near]
    return found


def cell_links(keys: np.ndarray, fps: np.ndarray, distance: int, small: int = SMALL) -> tuple[np.ndarray, np.ndarray]:
    """Spanning links of all cells; equal neighbours in ``keys`` (sorted runs) are one cell."""
    edge = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1], [True])))
    length = np.diff(edge)
    # for each row of a small cell the rows of its cell after it
    after = np.where(np.repeat(length, length) <= small, np.repeat(edge[1:], length) - 1 - np.arange(len(keys)), 0)
    codes, out, i = unary(fps), [(fps[:0], fps[:0])], np.flatnonzero(after)
    for k in range(1, small):
        i = i[after[i] >= k]
        if not len(i):
            break
        near = i[np.bitwise_count(codes[i] ^ codes[i + k]) <= distance]
        near = near[np.bitwise_count(fps[near] ^ fps[near + k]) <= distance]
        out.append((fps[near], fps[near + k]))
    for j in np.flatnonzero(length > small):
        out.extend(forest(fps[edge[j] : edge[j + 1]], distance))
    return np.concatenate([a for a, _ in out]), np.concatenate([b for _, b in out])


def links(fps: DataFrame, distance: int = DISTANCE, groups: int = GROUPS, block: int = 20_000) -> DataFrame:
    """Links ``a``, ``b`` that span the components of the distinct fingerprints in ``fp``.

    ``groups``: axes of the grid, over ``distance``. More axes make more but smaller cells: for a distance of 4, 6
    suits up to about 100 million distinct fingerprints, 7 or 8 more."""
    if groups <= distance:
        raise ValueError("the grid needs more axes than the distance")
    masks = [signed(sum(c)) for c in combinations(axes(groups), groups - distance)]
    cells = F.explode(F.array(*[F.struct(F.lit(i).alias("axes"), F.col("code").bitwiseAND(F.lit(m)).alias("cell")) for i, m in enumerate(masks)]))
    placed = fps.select("fp", embed().alias("code")).select("fp", cells.alias("at")).select("fp", "at.axes", "at.cell")
    large = placed.groupBy("axes", "cell").agg(F.count("*").alias("n")).where(F.col("n") > block).select("axes", "cell", F.ceil(F.col("n") / block).cast("int").alias("blocks"))
    # rows of ordinary cells get one part; rows of a large cell one part for each pair of blocks with theirs
    own = F.pmod(F.xxhash64("fp"), F.col("blocks")).cast("int")
    pairs = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda i: F.least(i, own) * F.col("blocks") + F.greatest(i, own))
    dealt = placed.join(large, ["axes", "cell"], "left").select("axes", "cell", "fp", F.explode(F.when(F.col("blocks").isNull(), F.array(F.lit(0))).otherwise(pairs)).alias("part"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        for batch in batches:
            now = np.column_stack([batch.column(i).to_numpy() for i in range(2)])
            if not len(now):
                continue
            now = np.concatenate([*held, now])
            cut = int(np.searchsorted(now[:, 0], now[-1, 0]))  # the last run may go on
            held = [now[cut:]]
            if cut:
                a, b = cell_links(now[:cut, 0], now[:cut, 1].view(np.uint64), distance)
                yield pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], names=["a", "b"])
        if held:
            now = held[0]
            a, b = cell_links(now[:, 0], now[:, 1].view(np.uint64), distance)
            yield pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], names=["a", "b"])

    keyed = dealt.select(F.xxhash64("axes", "cell", "part").alias("key"), "fp")
    return keyed.repartition("key").sortWithinPartitions("key").mapInArrow(run, "a long, b long")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, distance: int = DISTANCE, groups: int = GROUPS, block: int = 20_000, carry: str | None = None) -> DataFrame:
    """``id_col``, ``fp`` and ``component_id`` for every row of ``docs``, and the column ``carry``.

    Fingerprints within ``distance`` bits are linked; ``component_id`` is the smallest id reachable, itself
    included. Null, empty and blank texts have fingerprint zero and are linked like any other. Repeated
    rows stay. A row with a null id is linked too but never names a group; a group of null ids only has a
    null ``component_id``. Other columns are not looked at. An empty table gives an empty result.

    Scale: texts are read once and never shuffled; equal fingerprints are merged before the grid, so copies
    cost one row; everything after moves 16-byte rows.
    """
    scratch = Scratch(docs.sparkSession, "simhash")
    found = scratch.table(fingerprints(docs, id_col, text_col, shingle, carry))
    first = scratch.table(found.groupBy("fp").agg(F.min(id_col).alias("first")))
    linked, linked_at = scratch.keep(links(first, distance, groups, block))
    labels = components(linked, scratch)
    scratch.drop(linked_at)
    named = first.join(labels.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "first", F.coalesce("label", "fp").alias("label"))
    lowest = named.groupBy("label").agg(F.min("first").alias("component_id"))
    named = named.join(lowest, "label").select("fp", "component_id")
    return found.join(named, "fp").select(id_col, "fp", "component_id", *([carry] if carry else []))


def distinct(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options: int) -> DataFrame:
    """The rows of ``docs`` that stand for their near-duplicate group, with the columns of ``docs``.

    The row with the smallest id of a group stays; where several rows have that id, one of them: the one whose text has
    the smallest hash, and any one of equal rows. Rows with a null id cannot be told apart by it: they all stay, and
    stand for no group. Null and empty texts are a group like any other. Columns of any name come along, and an empty
    table gives an empty result.

    Scale: ids and hashes of the rows that go are joined to the documents, so that these are shuffled only where the
    planner finds that many go."""
    scratch = Scratch(docs.sparkSession, "simhash")
    sign, gone_id, gone_sign = unused(docs.columns, "_sign", "_gone", "_text")
    text = F.col(text_col).cast("string")
    signed_docs = docs.withColumn(sign, F.xxhash64(text))
    slim = docs.select(F.col(id_col).alias("id"), text.alias("text"), F.xxhash64(text).alias("sign"))
    groups = near_duplicates(slim, "id", "text", carry="sign", **options).where("id IS NOT NULL")
    rows = scratch.table(groups.groupBy("id", "sign").agg(F.count("*").alias("n"), F.min("component_id").alias("of")))
    lead = rows.where("id = of").groupBy("id").agg(F.min("sign").alias("kept"))
    gone = rows.join(lead, "id", "left").where("kept IS NULL OR sign <> kept")
    gone = scratch.table(gone.select(F.col("id").alias(gone_id), F.col("sign").alias(gone_sign)))
    again = scratch.table(rows.where("n > 1 AND id = of").select(F.col("id").alias(gone_id), F.col("sign").alias(gone_sign)))
    on = (F.col(id_col) == F.col(gone_id)) & (F.col(sign) == F.col(gone_sign))
    out = signed_docs.join(gone, on, "left_anti")
    if not again.isEmpty():
        once = out.join(again, on, "left_semi").dropDuplicates([id_col, sign])
        out = out.join(again, on, "left_anti").unionByName(once)
    return out.drop(sign)
