import hashlib
import random
import resource
import struct
import zlib

import pytest

from quillmesh.llm import media


@pytest.mark.parametrize("text", [None, "", " ", "é" * 95, "x" * 192, "y" * 193, "z" * 192 * 16, "w" * 192 * 17, "long " * 40_000])
def test_round_trip(text):
    n, payload = media.padded(text)
    assert n == len((text or "").encode()) and len(payload) % 192 == 0 and payload.rstrip(b" ") == (text or "").encode().rstrip(b" ")
    data = media.pack(payload)
    (track,) = media.probe(data)
    assert media.read(data, track) == payload
    assert track.codec == "raw " and track.duration == len(payload) and track.scale == 48_000
    assert [tuple(r) for r in track.ranges.tolist()] == [(data.index(b"mdat") + 4 + i * 192, 192) for i in range(0, len(payload) // 192, 10)]


def test_general_tables():
    """Sizes that differ, several chunk runs, no stss, long sizes and boxes that end with the file."""
    sizes, payload = [5, 7, 11, 2], bytes(range(25))
    stbl = media.box(b"stbl", media.full(b"stsd", struct.pack(">I", 1), media.box(b"avc1", bytes(8))), media.full(b"stsz", struct.pack(">II4I", 0, 4, *sizes)), media.full(b"stsc", struct.pack(">I6I", 2, 1, 1, 1, 2, 3, 1)), media.full(b"co64", struct.pack(">IQQ", 2, 24, 29)))
    data = struct.pack(">I4sQ", 1, b"free", 16) + struct.pack(">I4s", 33, b"mdat") + payload + media.box(b"moov", media.box(b"trak", media.full(b"mdhd", struct.pack(">IIII", 0, 0, 10, 25)), stbl))
    (track,) = media.probe(data)
    assert (track.codec, track.duration / track.scale) == ("avc1", 2.5)
    assert track.offsets.tolist() == [24, 29, 36, 47] and track.sizes.tolist() == sizes and track.keys.all()
    assert media.read(data, track) == payload


def test_broken_files_do_not_crash(spark):
    whole = media.pack(b"a" * 192)
    rows = [(1, None), (2, b""), (3, whole), (4, whole[:100]), (5, b"\0\0\0\4junk"), (5, b"\0\0\0\4junk"), (6, media.box(b"free"))]
    got = sorted((r.doc_id, r.codec, r.n_samples, len(r.keyframes), r.error is None) for r in media.index(spark.createDataFrame(rows, "doc_id long, media binary"), "doc_id", "media").collect())
    assert got == [(1, "", 0, 0, True), (2, "", 0, 0, True), (3, "raw ", 1, 1, True), (4, "", 0, 0, False), (5, "", 0, 0, False), (5, "", 0, 0, False), (6, "", 0, 0, True)]


def test_text_media(spark):
    rows = [(1, "a b"), (2, None), (2, None), (None, "c" * 500)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS media", "'x' AS codec")
    got = {(r.doc_id, r.n_bytes): r for r in media.text_media(docs).collect()}
    assert len(got) == 3
    for doc_id, text in rows:
        r = got[doc_id, len(text or "")]
        payload = media.padded(text)[1]
        assert (r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]))
        assert (r.media_bytes, r.media_sha256) == (len(r.media), hashlib.sha256(bytes(r.media)).hexdigest())
    assert media.text_media(docs.where("false")).count() == 0


def u32(*x):
    return struct.pack(f">{len(x)}I", *x)


def fragmented():
    """Two tracks: one with a keyframe a run and sizes of its own, one with defaults only; and a second fragment."""
    def trak(ident, kind, codec):
        stbl = media.box(b"stbl", media.full(b"stsd", u32(1), media.box(codec, bytes(8))), media.full(b"stsz", u32(0, 0)), media.full(b"stsc", u32(0)), media.full(b"stco", u32(0)), media.full(b"stts", u32(0)))
        return media.box(b"trak", media.full(b"tkhd", u32(0, 0, ident), bytes(68), flags=7), media.box(b"mdia", media.full(b"mdhd", u32(0, 0, 10, 0), bytes(4)), media.full(b"hdlr", bytes(4), kind, bytes(13)), media.box(b"minf", stbl)))

    moov = media.box(b"moov", trak(1, b"vide", b"avc1"), trak(2, b"soun", b"mp4a"), media.box(b"mvex", media.full(b"trex", u32(1, 1, 3, 0, 0x10000)), media.full(b"trex", u32(2, 1, 5, 4, 0))), media.box(b"udta", media.box(b"name", b"x"), bytes(4)))

    def moof(at):
        run1 = media.full(b"trun", u32(3, at), u32(0), u32(7, 8, 9), flags=0x205)
        one = media.box(b"traf", media.full(b"tfhd", u32(1), flags=0x20000), run1)
        two = media.box(b"traf", media.full(b"tfhd", u32(2)), media.full(b"trun", u32(2)))
        return media.box(b"moof", media.full(b"mfhd", u32(1)), one, two)

    first = moof(len(moof(0)) + 8)
    start = len(moov) + len(first) + 8
    body = bytes(range(32))
    second = media.box(b"moof", media.full(b"mfhd", u32(2)), media.box(b"traf", media.full(b"tfhd", u32(1), struct.pack(">Q", start), u32(6), flags=0x9), media.full(b"trun", u32(1, 0x10000, 20), flags=0x600)))
    return moov + first + media.box(b"mdat", body) + second.replace(u32(1, 0x10000, 20), u32(1, 20, 0x10000)), start


def test_fragments():
    data, start = fragmented()
    video, sound = media.probe(data)
    assert (video.kind, video.codec, sound.kind, sound.codec) == ("vide", "avc1", "soun", "mp4a")
    assert video.offsets.tolist() == [start, start + 7, start + 15, start] and video.sizes.tolist() == [7, 8, 9, 20]
    assert video.keys.tolist() == [True, False, False, False] and video.seconds == (3 * 3 + 6) / 10
    assert sound.offsets.tolist() == [start + 24, start + 28] and sound.keys.all() and sound.seconds == 1.0
    assert media.read(data, sound) == bytes(range(24, 32))


@pytest.mark.parametrize("bits,n", [(4, 5), (8, 3), (16, 3)])
def test_compact_sizes(bits, n):
    sizes = [3, 1, 2, 4, 5][:n]
    packed = bytes([0x31, 0x24, 0x50]) if bits == 4 else b"".join(x.to_bytes(bits // 8, "big") for x in sizes)
    stbl = media.box(b"stbl", media.full(b"stz2", u32(bits, n), packed), media.full(b"stsc", u32(1, 1, n, 1)), media.full(b"stco", u32(1, 8)))
    (track,) = media.probe(media.box(b"mdat", bytes(20)) + media.box(b"moov", media.box(b"trak", stbl)))
    assert track.sizes.tolist() == sizes and track.offsets.tolist() == [8 + sum(sizes[:k]) for k in range(n)]


def table_file(*tables):
    return media.box(b"mdat", bytes(40)) + media.box(b"moov", media.box(b"trak", media.box(b"stbl", *tables)))


HOSTILE = {
    "deep": b"".join(struct.pack(">I4s", 8 * (2000 - k), b"udta") for k in range(2000)),
    "empty header at the end": media.box(b"moov", media.box(b"trak", media.box(b"mdhd"))),
    "many samples": table_file(media.full(b"stsz", u32(1, 20_000_000)), media.full(b"stsc", u32(1, 1, 1, 1)), media.full(b"stco", u32(1, 8))),
    "most samples": table_file(media.full(b"stsz", u32(1, 0xFFFFFFFF)), media.full(b"stsc", u32(1, 1, 0xFFFFFFFF, 1)), media.full(b"stco", u32(1, 8))),
    "far run": table_file(media.full(b"stsz", u32(1, 2)), media.full(b"stsc", u32(2, 1, 1, 1, 0xFFFFFFF0, 1, 1)), media.full(b"stco", u32(1, 8))),
    "many in a chunk": table_file(media.full(b"stsz", u32(1, 2)), media.full(b"stsc", u32(1, 1, 0xFFFFFFFF, 1)), media.full(b"stco", u32(1, 8))),
    "offset beyond": table_file(media.full(b"stsz", u32(1, 2)), media.full(b"stsc", u32(1, 1, 2, 1)), media.full(b"co64", u32(1), b"\xff" * 8)),
    "long run": media.box(b"moof", media.box(b"traf", media.full(b"tfhd", u32(1)), media.full(b"trun", u32(0xFFFFFFFF)))),
    "no fragment header": media.box(b"moof", media.box(b"traf")),
    "far back": media.box(b"moof", media.box(b"traf", media.full(b"tfhd", u32(1), u32(1), flags=0x10), media.full(b"trun", struct.pack(">Ii", 1, -5000), flags=1))),
    "cut": media.box(b"moov", media.box(b"trak", media.full(b"tkhd"), media.box(b"stbl", media.full(b"stsz")))),
}


@pytest.mark.parametrize("name", sorted(HOSTILE))
def test_hostile_files_cost_no_memory(name):
    before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
    with pytest.raises(media.Malformed):
        media.probe(HOSTILE[name])
    assert resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before < 50_000


def test_any_damage_is_malformed_or_read():
    """Bytes changed, cut out or put in anywhere: never anything but tracks or Malformed."""
    rng = random.Random(3)
    wholes = [media.pack(b"ab" * 96 * 40), fragmented()[0], table_file(media.full(b"stz2", u32(4, 3), b"\x12\x30"), media.full(b"stsc", u32(1, 1, 3, 1)), media.full(b"stco", u32(1, 8)))]
    for n in range(6000):
        data = bytearray(rng.choice(wholes))
        for _ in range(rng.randint(1, 4)):
            at = rng.randrange(len(data) if n % 2 else min(len(data), 900))
            kind = rng.randrange(4)
            if kind == 0:
                data[at] = rng.choice([0, 1, 255, rng.randrange(256)])
            elif kind == 1:
                data[at : at + 4] = rng.choice([b"\xff" * 4, bytes(4), bytes([0, 0, 0, 1])])
            elif kind == 2:
                del data[at : at + rng.randint(1, 9)]
            else:
                data[at:at] = bytes(rng.randint(1, 9))
        try:
            for track in media.probe(bytes(data)):
                assert len(track.offsets) == len(track.sizes) == len(track.keys) <= len(data)
                media.read(bytes(data), track)
        except media.Malformed:
            pass


def test_index_of_all_tracks(spark):
    data, start = fragmented()
    rows = [(1, data), *((10 + k, HOSTILE[name]) for k, name in enumerate(sorted(HOSTILE)))]
    got = {r.doc_id: r for r in media.index(spark.createDataFrame(rows, "doc_id long, media binary"), "doc_id", "media").collect()}
    assert len(got) == len(rows) and all(r.error and not r.tracks for i, r in got.items() if i != 1)
    assert [(t.kind, t.n_samples, [tuple(k) for k in t.keyframes]) for t in got[1].tracks] == [("vide", 4, [(start, 7)]), ("soun", 2, [(start + 24, 4), (start + 28, 4)])]
    assert got[1].codec == "avc1" and got[1].error is None


def test_query(spark):
    from quillmesh.llm import queries

    docs = {r.doc_id: r.text or "" for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()}
    rows = queries.op9_media(spark, "/root/testdata/sf0.001").collect()
    assert len(rows) == len(docs)
    for r in rows:
        n, payload = media.padded(docs[r.doc_id])
        samples = len(payload) // 192
        crc = zlib.crc32(media.probe(media.pack(payload))[0].ranges.tobytes())
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256) == (n, len(payload), hashlib.sha256(payload).hexdigest())
        assert r.feature == f"codec=raw  duration={len(payload) / 48000:.6f} samples={samples} keyframes={-(-samples // 10)} ranges={crc:08x}"
