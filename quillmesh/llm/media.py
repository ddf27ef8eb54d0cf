"""Media columns: ISO base media containers written, walked and indexed without decoding payloads.

``pack`` wraps bytes in a container with one track of raw 8-bit samples. ``probe`` walks the nested boxes
of any such container, decodes the sample tables and those of movie fragments, and gives codec, duration and
the byte range of every keyframe of each track. ``read`` gathers a track's stored bytes by those tables.

Files may be hostile: boxes are walked without recursion to a fixed depth, and every count is held against the
box or the file before anything is made from it, so that memory is linear in the file.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

UNIT = 192
RATE = 48_000
#: Units between keyframes and units in a chunk of what ``pack`` writes.
KEY_EVERY, PER_CHUNK = 10, 16

#: Fixed values of the container format: the boxes that hold boxes.
CONTAINERS = {b"moov", b"trak", b"mdia", b"minf", b"stbl", b"dinf", b"edts", b"mvex", b"udta", b"moof", b"traf"}
#: Fixed values of the container format: bits of the flags of fragment headers, of runs, and of a sample that is no keyframe.
BASE, ENTRY, LASTS, SIZED, MARKED, ON_MOOF = 0x1, 0x2, 0x8, 0x10, 0x20, 0x20000
RUN_AT, RUN_FIRST, RUN_LASTS, RUN_SIZES, RUN_MARKS, RUN_SHIFTS = 0x1, 0x4, 0x100, 0x200, 0x400, 0x800
NOT_KEY = 0x10000
#: Boxes within boxes, at most.
DEPTH = 32
#: Fixed value of the container format: the unity matrix of a movie or track header.
UNITY = struct.pack(">9I", 0x10000, 0, 0, 0, 0x10000, 0, 0, 0, 0x40000000)


class Malformed(ValueError):
    """The bytes are not a whole container."""


def box(kind: bytes, *parts: bytes) -> bytes:
    size = 8 + sum(map(len, parts))
    head = struct.pack(">I4s", size, kind) if size < 1 << 32 else struct.pack(">I4sQ", 1, kind, size + 8)
    return b"".join((head, *parts))


def full(kind: bytes, *parts: bytes, version: int = 0, flags: int = 0) -> bytes:
    return box(kind, struct.pack(">I", version << 24 | flags), *parts)


def big(values: np.ndarray, kind: str = ">u4") -> bytes:
    return values.astype(kind).tobytes()


def pack(payload: bytes) -> bytes:
    """A container of the payload, whose length is a multiple of ``UNIT``: one track of raw 8-bit samples,
    one unit a table sample. Equal payloads give equal bytes."""
    n, rest = divmod(len(payload), UNIT)
    if rest:
        raise ValueError(f"the payload is not a multiple of {UNIT} bytes")
    chunks = -(-n // PER_CHUNK)
    last = n - (chunks - 1) * PER_CHUNK if chunks else 0
    runs = [(1, PER_CHUNK)] * (chunks > 1) + [(chunks, last)] * (chunks > 0 and (chunks == 1 or last != PER_CHUNK))
    long = len(payload) > 0xF0000000
    duration = n * UNIT
    times = struct.pack(">QQIQ", 0, 0, RATE, duration)
    entry = box(b"raw ", bytes(6), struct.pack(">HIIHHHHI", 1, 0, 0, 1, 8, 0, 0, RATE << 16 & 0xFFFFFFFF))

    def moov(first: int) -> bytes:
        at = first + np.arange(chunks, dtype=np.uint64) * np.uint64(UNIT * PER_CHUNK)
        stbl = box(
            b"stbl",
            full(b"stsd", struct.pack(">I", 1), entry),
            full(b"stts", struct.pack(">III", 1, n, UNIT) if n else struct.pack(">I", 0)),
            full(b"stsc", struct.pack(">I", len(runs)), *(struct.pack(">III", c, s, 1) for c, s in runs)),
            full(b"stsz", struct.pack(">II", UNIT, n)),
            full(b"co64", struct.pack(">I", chunks), big(at, ">u8")) if long else full(b"stco", struct.pack(">I", chunks), big(at)),
            full(b"stss", struct.pack(">I", -(-n // KEY_EVERY)), big(np.arange(1, n + 1, KEY_EVERY))),
        )
        minf = box(b"minf", full(b"smhd", bytes(4)), box(b"dinf", full(b"dref", struct.pack(">I", 1), full(b"url ", flags=1))), stbl)
        mdia = box(b"mdia", full(b"mdhd", times, struct.pack(">HH", 0x55C4, 0), version=1), full(b"hdlr", bytes(4), b"soun", bytes(12), b"\0"), minf)
        tkhd = full(b"tkhd", struct.pack(">QQIIQ", 0, 0, 1, 0, duration), bytes(8), struct.pack(">HHHH", 0, 0, 0x100, 0), UNITY, bytes(8), version=1, flags=7)
        mvhd = full(b"mvhd", times, struct.pack(">IH", 0x10000, 0x100), bytes(10), UNITY, bytes(24), struct.pack(">I", 2), version=1)
        return box(b"moov", mvhd, box(b"trak", tkhd, mdia))

    ftyp = box(b"ftyp", b"isom", struct.pack(">I", 0x200), b"isomiso2")
    head = 16 if len(payload) + 8 >= 1 << 32 else 8
    return b"".join((ftyp, moov(len(ftyp) + len(moov(0)) + head), box(b"mdat", payload)))


def boxes(data: memoryview, start: int, end: int, parent: bytes = b"") -> Iterator[tuple[bytes, int, int, int]]:
    """Kind, start, and start and end of the contents of the boxes in a range; a size of 0 runs to the range's end.
    User data may end with four bytes 0."""
    at = start
    while at < end:
        if end - at < 8:
            if parent == b"udta" and bytes(data[at:end]) == bytes(4):
                return
            raise Malformed("a box header is cut off")
        size, kind = struct.unpack_from(">I4s", data, at)
        head = 8
        if size == 1:
            if end - at < 16:
                raise Malformed("a long box header is cut off")
            size, head = struct.unpack_from(">Q", data, at + 8)[0], 16
        elif size == 0:
            if parent == b"udta":
                return
            size = end - at
        if size < head or at + size > end:
            raise Malformed(f"box {kind!r} does not fit its parent")
        yield kind, at, at + head, at + size
        at += size


@dataclass
class Track:
    """One track's tables: kind, codec, time scale, duration, and each sample's place, size and keyframe mark."""

    kind: str = ""
    codec: str = ""
    scale: int = 0
    duration: int = 0
    offsets: np.ndarray = field(default_factory=lambda: np.empty(0, np.int64))
    sizes: np.ndarray = field(default_factory=lambda: np.empty(0, np.int64))
    keys: np.ndarray = field(default_factory=lambda: np.empty(0, bool))

    @property
    def ranges(self) -> np.ndarray:
        """(offset, length) of each keyframe."""
        return np.column_stack((self.offsets, self.sizes))[self.keys]

    @property
    def seconds(self) -> float:
        return self.duration / self.scale if self.scale else 0.0


def column(data: memoryview, at: int, end: int, count: int, kind: str = ">u4", width: int = 1) -> np.ndarray:
    """``count`` rows of ``width`` numbers, no bytes of which may lie beyond ``end``."""
    if at + count * width * int(kind[-1]) > end:
        raise Malformed("a table is cut off")
    return np.frombuffer(data, kind, count * width, at).astype(np.int64).reshape(count, width) if count else np.empty((0, width), np.int64)


def numbers(data: memoryview, at: int, end: int, form: str) -> tuple:
    if at + struct.calcsize(form) > end:
        raise Malformed("a header is cut off")
    return struct.unpack_from(form, data, at)


def listed(data: memoryview, at: tuple[int, int], kind: str = ">u4", width: int = 1) -> np.ndarray:
    """A full box's table after its count."""
    lo, hi = at
    return column(data, lo + 8, hi, numbers(data, lo + 4, hi, ">I")[0], kind, width)


Places = dict[bytes, tuple[int, int]]


@dataclass
class Fragment:
    """One track's part of a movie fragment: its boxes, its runs, and where the fragment begins."""

    moof: int
    first: bool
    at: Places = field(default_factory=dict)
    runs: list[tuple[int, int]] = field(default_factory=list)


def walk(data: memoryview) -> tuple[list[Places], list[Fragment], list[tuple[int, int]]]:
    """The boxes of each track, the parts of fragments and the tracks' defaults for these, without recursion."""
    tracks: list[Places] = []
    parts: list[Fragment] = []
    defaults: list[tuple[int, int]] = []
    moof, first = 0, True
    stack: list[tuple[bytes, Places | None, Iterator]] = [(b"", None, boxes(data, 0, len(data)))]
    while stack:
        parent, into, rest = stack[-1]
        found = next(rest, None)
        if found is None:
            stack.pop()
            continue
        kind, start, lo, hi = found
        if kind in CONTAINERS:
            if len(stack) > DEPTH:
                raise Malformed("boxes lie too deep")
            if kind == b"trak":
                tracks.append({})
                into = tracks[-1]
            elif kind == b"moof":
                moof, first, into = start, True, None
            elif kind == b"traf":
                parts.append(Fragment(moof, first))
                first, into = False, parts[-1].at
            stack.append((kind, into, boxes(data, lo, hi, kind)))
        elif kind == b"trex":
            defaults.append((lo, hi))
        elif kind == b"trun" and parent == b"traf":
            parts[-1].runs.append((lo, hi))
        elif into is not None:
            into.setdefault(kind, (lo, hi))
    return tracks, parts, defaults


def sizes_of(data: memoryview, at: Places) -> np.ndarray | None:
    """The size of each sample by ``stsz`` or ``stz2``; no more bytes in all than the file has."""
    if b"stsz" in at:
        lo, hi = at[b"stsz"]
        same, n = numbers(data, lo + 4, hi, ">II")
        if same and n * same > len(data):
            raise Malformed("the samples are larger than the file")
        return np.full(n, same, np.int64) if same else column(data, lo + 12, hi, n)[:, 0]
    if b"stz2" not in at:
        return None
    lo, hi = at[b"stz2"]
    bits, n = (x & 0xFF if k == 0 else x for k, x in enumerate(numbers(data, lo + 4, hi, ">II")))
    if bits == 4:
        both = column(data, lo + 12, hi, (n + 1) // 2, ">u1")
        return np.column_stack((both >> 4, both & 15)).reshape(-1)[:n]
    if bits not in (8, 16):
        raise Malformed("sizes of an unknown width")
    return column(data, lo + 12, hi, n, f">u{bits // 8}")[:, 0]


def decode(data: memoryview, at: Places) -> Track:
    """A track by the tables of its movie header."""
    out = Track()
    if b"mdhd" in at:
        lo, hi = at[b"mdhd"]
        long = numbers(data, lo, hi, ">B")[0] == 1
        out.scale, out.duration = numbers(data, lo + (20 if long else 12), hi, ">IQ" if long else ">II")
        unknown = out.duration == (1 << (64 if long else 32)) - 1
        if unknown:
            out.duration = lasting(data, at)
    if b"hdlr" in at and at[b"hdlr"][1] - at[b"hdlr"][0] >= 12:
        out.kind = bytes(data[at[b"hdlr"][0] + 8 : at[b"hdlr"][0] + 12]).decode("latin-1")
    if b"stsd" in at and at[b"stsd"][1] - at[b"stsd"][0] >= 16:
        out.codec = bytes(data[at[b"stsd"][0] + 12 : at[b"stsd"][0] + 16]).decode("latin-1")
    sizes = sizes_of(data, at)
    if sizes is None or b"stsc" not in at or not at.keys() & {b"stco", b"co64"}:
        return out
    n = len(sizes)
    chunks = listed(data, at[b"co64"], ">u8")[:, 0] if b"co64" in at else listed(data, at[b"stco"])[:, 0]
    runs = listed(data, at[b"stsc"], width=3)
    firsts = runs[:, 0]
    if n and len(runs) and (firsts[0] != 1 or firsts[-1] > len(chunks) or (np.diff(firsts) <= 0).any()):
        raise Malformed("the chunk runs do not fit the chunks")
    per = np.repeat(runs[:, 1], np.diff(np.append(firsts, len(chunks) + 1))) if n and len(runs) else np.zeros(len(chunks), np.int64)
    if per.sum() != n:
        raise Malformed("the chunk table and the size table differ")
    chunk = np.repeat(np.arange(len(chunks)), per)
    before = np.cumsum(sizes) - sizes
    first = np.cumsum(per) - per
    offsets = chunks[chunk] + before - before[first[chunk]] if n else np.empty(0, np.int64)
    keys = np.ones(n, bool)
    if b"stss" in at:
        marks = listed(data, at[b"stss"])[:, 0]
        keys[:] = False
        keys[marks[(marks >= 1) & (marks <= n)] - 1] = True
    out.offsets, out.sizes, out.keys = within(data, offsets, sizes), sizes, keys
    return out


def within(data: memoryview, offsets: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The offsets, all samples of which must lie in the file and not be more than it."""
    if sizes.sum() > len(data):
        raise Malformed("the samples are larger than the file")
    if len(offsets) and (offsets.min() < 0 or offsets.max() > len(data) or (offsets + sizes).max() > len(data)):
        raise Malformed("a sample lies beyond the file")
    return offsets


def lasting(data: memoryview, at: Places) -> int:
    """The duration by the time table of the movie header."""
    if b"stts" not in at:
        return 0
    return sum(a * b for a, b in listed(data, at[b"stts"], width=2).tolist())


def track_id(data: memoryview, at: Places) -> int:
    if b"tkhd" not in at:
        return 0
    lo, hi = at[b"tkhd"]
    return numbers(data, lo + (20 if numbers(data, lo, hi, ">B")[0] == 1 else 12), hi, ">I")[0]


def add_fragments(data: memoryview, found: list[Places], tracks: list[Track], parts: list[Fragment], defaults: list[tuple[int, int]]) -> None:
    """Appends the samples of movie fragments to their tracks. Their durations come on top of the time table's,
    as the movie header's do not hold with fragments."""
    by_id = {track_id(data, at): (track, at) for at, track in reversed(list(zip(found, tracks)))}
    usual = {ident: rest for ident, _, *rest in (numbers(data, lo + 4, hi, ">5I") for lo, hi in defaults)}
    more: dict[int, list[tuple[np.ndarray, np.ndarray, np.ndarray]]] = {}
    lasts: dict[int, int] = {}
    end = 0
    for part in parts:
        if b"tfhd" not in part.at:
            raise Malformed("a fragment without a header")
        lo, hi = part.at[b"tfhd"]
        flags, ident = numbers(data, lo, hi, ">II")
        flags, at = flags & 0xFFFFFF, lo + 8
        base = part.moof if part.first or flags & ON_MOOF else end
        lasting_each, size, marks = usual.get(ident, (0, 0, 0))
        for bit, form in ((BASE, ">Q"), (ENTRY, ">I"), (LASTS, ">I"), (SIZED, ">I"), (MARKED, ">I")):
            if flags & bit:
                (value,) = numbers(data, at, hi, form)
                at += struct.calcsize(form)
                base = value if bit == BASE else base
                lasting_each = value if bit == LASTS else lasting_each
                size = value if bit == SIZED else size
                marks = value if bit == MARKED else marks
        place = base
        for lo, hi in part.runs:
            run, n = numbers(data, lo, hi, ">II")
            run, at, first = run & 0xFFFFFF, lo + 8, None
            if run & RUN_AT:
                place, at = base + numbers(data, at, hi, ">i")[0], at + 4
            if run & RUN_FIRST:
                first, at = numbers(data, at, hi, ">I")[0], at + 4
            fields = [bit for bit in (RUN_LASTS, RUN_SIZES, RUN_MARKS, RUN_SHIFTS) if run & bit]
            if n * max(1, size if RUN_SIZES not in fields else 0) > len(data):
                raise Malformed("the samples are larger than the file")
            table = column(data, at, hi, n, width=len(fields)) if fields else np.empty((n, 0), np.int64)
            sizes = table[:, fields.index(RUN_SIZES)] if RUN_SIZES in fields else np.full(n, size, np.int64)
            own = table[:, fields.index(RUN_MARKS)] if RUN_MARKS in fields else np.full(n, marks, np.int64)
            if first is not None and n:
                own = np.concatenate(([first], own[1:]))
            if place < 0 or place > len(data):
                raise Malformed("a sample lies beyond the file")
            offsets = within(data, place + np.cumsum(sizes) - sizes, sizes)
            place += int(sizes.sum())
            more.setdefault(ident, []).append((offsets, sizes, own & NOT_KEY == 0))
            lasts[ident] = lasts.get(ident, 0) + (int(table[:, fields.index(RUN_LASTS)].sum()) if RUN_LASTS in fields else n * lasting_each)
        end = place
    for ident, runs in more.items():
        if ident not in by_id:
            continue
        track, at = by_id[ident]
        track.offsets, track.sizes, track.keys = (np.concatenate((old, *(r[k] for r in runs))) for k, old in enumerate((track.offsets, track.sizes, track.keys)))
        within(data, track.offsets, track.sizes)
        track.duration = lasting(data, at) + lasts[ident]


def probe(data: bytes) -> list[Track]:
    """The tracks of a container. Raises :class:`Malformed` where boxes or tables do not hold together."""
    view = memoryview(data)
    found, parts, defaults = walk(view)
    tracks = [decode(view, at) for at in found]
    if parts:
        add_fragments(view, found, tracks, parts, defaults)
    return tracks


def read(data: bytes, track: Track) -> bytes:
    """The stored bytes of a track's samples, in table order."""
    view = memoryview(data)
    joined = np.flatnonzero(track.offsets[1:] != track.offsets[:-1] + track.sizes[:-1]) + 1
    cuts = [0, *joined.tolist(), len(track.offsets)] if len(track.offsets) else [0]
    return b"".join(view[int(track.offsets[a]) : int(track.offsets[b - 1] + track.sizes[b - 1])] for a, b in zip(cuts, cuts[1:]))


KEYFRAMES = "array<struct<offset:long,length:long>>"
INDEX = f"codec string, duration double, n_samples long, keyframes {KEYFRAMES}, tracks array<struct<kind:string,codec:string,duration:double,n_samples:long,keyframes:{KEYFRAMES}>>, error string"


def described(track: Track) -> dict:
    return {"codec": track.codec, "duration": track.seconds, "n_samples": len(track.sizes), "keyframes": [{"offset": o, "length": s} for o, s in track.ranges.tolist()]}


def index(media: DataFrame, id_col: str, media_col: str) -> DataFrame:
    """``id_col`` and, per row, codec, duration in seconds, number of samples and keyframe byte ranges of
    the first track, and the same with its kind for each of the ``tracks``. Null or empty media, or a file without
    tracks: an empty codec, zero duration and no ranges. Broken files: the same with the reason in ``error``.
    Rows are kept one to one, repeats too; columns that are not named are not looked at; an empty table gives an
    empty result."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for cell in batch.column(1):
                try:
                    tracks, error = probe(cell.as_py() or b""), None
                except Malformed as e:
                    tracks, error = [], str(e)
                each = [described(t) for t in tracks]
                rows.append({**(each[0] if each else described(Track())), "tracks": [{"kind": t.kind, **d} for t, d in zip(tracks, each)], "error": error})
            made = pa.Table.from_pylist(rows, schema=ARROW).columns
            yield from pa.table([pa.chunked_array([batch.column(0)]), *made], names=[id_col, *ARROW.names]).to_batches()

    return media.select(id_col, media_col).mapInArrow(run, f"`{id_col}` {media.schema[id_col].dataType.simpleString()}, {INDEX}")


FIELDS = [("codec", pa.string()), ("duration", pa.float64()), ("n_samples", pa.int64()), ("keyframes", pa.list_(pa.struct([("offset", pa.int64()), ("length", pa.int64())])))]
ARROW = pa.schema([*FIELDS, ("tracks", pa.list_(pa.struct([("kind", pa.string()), *FIELDS]))), ("error", pa.string())])


def padded(text: str | None) -> tuple[int, bytes]:
    """The number of UTF-8 bytes, and these bytes with spaces up to a positive multiple of ``UNIT``."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    return len(raw), raw.ljust(max(1, -(-len(raw) // UNIT)) * UNIT)


def text_media(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep_media: bool = True) -> DataFrame:
    """Every text as a container in a binary column ``media``, with figures of what is read back from it.

    ``n_bytes`` counts the unpadded text; ``payload_bytes``, ``payload_sha256`` and ``tail_crc32`` (the last
    16 bytes) come from the bytes read back through the sample tables; ``media_bytes``, ``media_sha256``
    from the container; ``codec``, ``duration``, ``n_samples``, ``n_keyframes`` and ``key_crc32`` (the keyframe
    ranges) from the walk. A null text counts as empty, which becomes one unit of spaces; rows stay one to
    one and equal texts give equal values. ``keep_media=False`` leaves the bytes themselves out.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple] = []
            for cell in batch.column(1):
                n, payload = padded(cell.as_py())
                data = pack(payload)
                track = probe(data)[0]
                back = read(data, track)
                rows.append((n, len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-16:]), len(data), hashlib.sha256(data).hexdigest(), track.codec, track.seconds, len(track.sizes), int(track.keys.sum()), zlib.crc32(track.ranges.tobytes()), *((data,) if keep_media else ())))
            columns = [pa.array(x, t) for x, t in zip(zip(*rows), types)] if rows else [pa.array([], t) for t in types]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], names=[id_col, *names])

    names = ["n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "codec", "duration", "n_samples", "n_keyframes", "key_crc32"] + ["media"] * keep_media
    types = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.float64(), pa.int64(), pa.int64(), pa.int64()] + [pa.binary()] * keep_media
    spark_types = {pa.int64(): "long", pa.string(): "string", pa.float64(): "double", pa.binary(): "binary"}
    schema = ", ".join([f"`{id_col}` {docs.schema[id_col].dataType.simpleString()}", *(f"{n} {spark_types[t]}" for n, t in zip(names, types))])
    return docs.select(id_col, F.col(text_col).cast("string")).mapInArrow(run, schema)
