import hashlib
import struct
import zlib

import numpy as np
import pytest

from tessera.llm import isomedia, media


def frames(n, seed=0):
    return np.random.default_rng(seed).integers(0, 256, n * 192, dtype=np.uint8).tobytes()


@pytest.mark.parametrize("n", [1, 2, 63, 64, 65, 128, 700])
def test_round_trip_and_tables(n):
    data = frames(n)
    file = isomedia.write(data)
    (track,) = isomedia.tracks(file)
    assert isomedia.payload(file, track) == data
    assert (track.codec, track.handler, track.timescale, track.duration) == ("raw ", "vide", 25, n)
    assert track.durations().sum() == n
    for (a, size), i in zip(track.keyframes().tolist(), range(0, n, 12)):
        assert file[a : a + size] == data[i * 192 : (i + 1) * 192]
    assert len(track.keyframes()) == -(-n // 12)


def box(kind, body):
    return struct.pack(">I4s", 8 + len(body), kind) + body


def test_odd_files_are_walked():
    """Variable sizes, co64, no stss, version-1 mdhd, unknown boxes, a 64-bit size and a box to the end."""
    samples = [b"a" * 5, b"bb", b"cccc"]
    head = box(b"free", b"xx")
    full = lambda kind, *ints, f=">I": box(kind, bytes(4) + b"".join(struct.pack(f, i) for i in ints))

    def moov(a, b):
        stbl = box(b"stbl", box(b"stsd", bytes(4) + struct.pack(">I", 1) + box(b"mp4a", bytes(20))) + full(b"stts", 1, 3, 10) + full(b"stsz", 0, 3, 5, 2, 4) + full(b"stsc", 2, 1, 2, 1, 2, 1, 1) + box(b"co64", bytes(4) + struct.pack(">IQQ", 2, a, b)))
        mdhd = box(b"mdhd", b"\1\0\0\0" + struct.pack(">QQIQI", 0, 0, 1000, 30, 0))
        return box(b"moov", box(b"trak", box(b"mdia", mdhd + box(b"hdlr", bytes(8) + b"soun" + bytes(13)) + box(b"minf", box(b"odd ", b"?") + stbl))))

    at = len(head) + len(moov(0, 0)) + 16
    body = samples[0] + samples[1] + b"gap" + samples[2]
    file = head + moov(at, at + 10) + struct.pack(">I4sQ", 1, b"mdat", 16 + len(body)) + body + struct.pack(">I4s", 0, b"free") + b"to the end"
    (t,) = isomedia.tracks(file)
    assert (t.codec, t.handler, t.seconds) == ("mp4a", "soun", 0.03)
    assert [file[a : a + n] for a, n in t.ranges().tolist()] == samples
    assert t.keyframes().tolist() == t.ranges().tolist()
    assert isomedia.payload(file, t) == b"".join(samples)


def test_broken_and_null_media(spark):
    good = isomedia.write(frames(2))
    rows = [(1, good, "x"), (2, None, "x"), (3, b"", "x"), (4, good[:100], "x"), (5, b"\0\0\0\4free", "x")]
    got = {r.doc_id: r for r in media.index_media(spark.createDataFrame(rows, "doc_id long, media binary, codec string")).collect()}
    assert got[1].codec == "raw " and len(got[1].keyframes) == 1 and got[1].error is None
    assert got[2].codec is None and got[2].error is None
    assert all(got[i].codec is None and got[i].error for i in (3, 4, 5))


def full(kind, flags, *parts):
    return box(kind, struct.pack(">I", flags) + b"".join(p if isinstance(p, bytes) else struct.pack(">I", p) for p in parts))


def empty_track(number, handler, codec, mdhd=(0, 600)):
    stbl = box(b"stbl", full(b"stsd", 0, 1, box(codec, bytes(8))) + full(b"stts", 0, 0) + full(b"stsc", 0, 0) + full(b"stsz", 0, 0, 0) + full(b"stco", 0, 0))
    return box(b"trak", full(b"tkhd", 3, 0, 0, number, 0, 0) + box(b"mdia", full(b"mdhd", 0, 0, 0, mdhd[1], mdhd[0], 0) + full(b"hdlr", 0, 0, handler, bytes(12)) + box(b"minf", stbl)))


def test_fragments_are_read():
    """Two tracks in two fragments: defaults of trex and tfhd, first-sample flags, bases of either kind, a run that follows another."""
    moov = box(b"moov", empty_track(1, b"vide", b"avc1") + empty_track(2, b"soun", b"mp4a", (0, 48000)) + box(b"mvex", full(b"trex", 0, 1, 1, 20, 7, 0x10000) + full(b"trex", 0, 2, 1, 1024, 4, 0)))
    video, audio = [b"v" * 7, b"w" * 7, b"x" * 3, b"y" * 5], [b"aaaa", b"bbbb", b"cc"]

    def one(at):
        def traf(offset):
            return box(b"traf", full(b"tfhd", 0x20000, 1) + full(b"trun", 0x5, 2, offset, 0)) + box(b"traf", full(b"tfhd", 0x20000 | 0x8, 2, 1000) + full(b"trun", 0x1, 2, offset + 14))

        return box(b"moof", full(b"mfhd", 0, 1) + traf(len(box(b"moof", full(b"mfhd", 0, 1) + traf(0))) + 8))

    def two(at):
        head = full(b"tfhd", 0x1 | 0x20, 1, struct.pack(">Q", at), 0x10000)
        runs = lambda o: full(b"trun", 0x1 | 0x300 | 0x400, 1, o, 33, 3, 0) + full(b"trun", 0x200, 1, 5)
        sound = full(b"tfhd", 0x20000, 2)
        body = lambda o: box(b"traf", head + runs(o)) + box(b"traf", sound + full(b"trun", 0x1 | 0x200, 1, o + 8, 2))
        return box(b"moof", body(len(box(b"moof", body(0))) + 8))

    file = moov + one(0) + box(b"mdat", video[0] + video[1] + audio[0] + audio[1])
    file += two(len(file)) + box(b"mdat", video[2] + video[3] + audio[2])
    v, a = isomedia.tracks(file)
    assert [file[o : o + n] for o, n in v.ranges().tolist()] == video and isomedia.payload(file, v) == b"".join(video)
    assert [file[o : o + n] for o, n in a.ranges().tolist()] == audio
    assert v.durations().tolist() == [20, 20, 33, 20] and v.duration == 93 and (v.codec, v.samples()) == ("avc1", 4)
    assert [file[o : o + n] for o, n in v.keyframes().tolist()] == [video[0], video[2]]
    assert a.duration == 1000 * 2 + 1024 and a.keyframes().tolist() == a.ranges().tolist()
    keys = media._index(file)
    assert keys[:4] == ("vide", "avc1", 600, 93) and keys[7] is None
    with pytest.raises(isomedia.BrokenMedia):
        isomedia.payload(file[:-4], a)
    assert media._index(moov.replace(struct.pack(">II", 0x600, 1), b"") + box(b"moof", box(b"traf", full(b"tfhd", 0, 9))))[7]


@pytest.mark.parametrize("width,raw", [(4, bytes([0x53, 0x20])), (8, bytes([5, 3, 2])), (16, struct.pack(">3H", 5, 3, 2))])
def test_compact_sizes(width, raw):
    track = isomedia.Track(tables={b"stz2": bytes(4) + bytes([0, 0, 0, width]) + struct.pack(">I", 3) + raw})
    assert track.sizes().tolist() == [5, 3, 2]


def test_digest(spark):
    texts = [(1, "été"), (2, None), (3, ""), (4, "x" * 192), (5, "y" * 193), (6, "word " * 40000), (7, "été"), (None, "no id")]
    docs = spark.createDataFrame([(*t, 0) for t in texts], "doc_id long, text string, media int")
    stored = media.texts_as_media(docs)
    got = {r.doc_id: r for r in media.media_digest(stored).collect()}
    lengths = {r.doc_id: r.n_bytes for r in stored.collect()}
    for doc_id, text in texts:
        raw = (text or "").encode()
        padded = raw + b" " * ((-len(raw)) % 192 or (0 if raw else 192))
        r = got[doc_id]
        assert (lengths[doc_id], r.payload_bytes) == (len(raw), len(padded))
        assert r.payload_sha256 == hashlib.sha256(padded).hexdigest() and r.tail_crc32 == zlib.crc32(padded[-16:])
        assert r.media_bytes == len(isomedia.write(padded)) and r.media_sha256 == hashlib.sha256(isomedia.write(padded)).hexdigest()
    assert got[1].asDict() | {"doc_id": 7} == got[7].asDict()
    assert media.media_digest(stored.limit(0)).collect() == []


def test_digest_of_null_and_broken_media(spark):
    good = isomedia.write(frames(2))
    got = {r.doc_id: r for r in media.media_digest(spark.createDataFrame([(1, good), (2, None), (3, good[:100]), (4, b"")], "doc_id long, media binary")).collect()}
    assert got[1].payload_bytes == 384 and got[2].media_bytes is None and got[2].feature is None
    assert got[3].media_bytes == 100 and got[3].payload_bytes is None and got[3].feature.startswith("error=") and got[4].feature == "error=no track"


def test_query_is_the_composition(spark, sf):
    stored = media.texts_as_media(spark.read.parquet(f"{sf}/documents.parquet"))
    want = stored.select("doc_id", "n_bytes").join(media.media_digest(stored), "doc_id")
    got = media.op8_media_columns(spark, sf)
    assert sorted(map(tuple, got.select(*want.columns).collect())) == sorted(map(tuple, want.collect()))
