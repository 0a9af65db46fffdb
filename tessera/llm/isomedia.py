"""ISO base media files: write raw-frame tracks, walk boxes, decode sample tables.

Only the public box layout of ISO/IEC 14496-12 is used. Payloads are never decoded: a track's codec,
timing and byte ranges come from its boxes alone.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np

CONTAINERS = {b"moov", b"trak", b"mdia", b"minf", b"stbl", b"dinf", b"edts", b"udta", b"mvex"}
UNIT = struct.pack(">9i", 0x10000, 0, 0, 0, 0x10000, 0, 0, 0, 0x40000000)


class BrokenMedia(ValueError):
    pass


#: Flags of a sample that is no sync sample; of a track fragment header; of a track run.
NON_SYNC = 0x10000
BASE, DESCRIPTION, FRAGMENT_DURATION, FRAGMENT_SIZE, FRAGMENT_FLAGS, BASE_IS_MOOF = 0x1, 0x2, 0x8, 0x10, 0x20, 0x20000
OFFSET, FIRST_FLAGS, DURATION, SIZE, FLAGS, COMPOSITION = 0x1, 0x4, 0x100, 0x200, 0x400, 0x800


@dataclass
class Run:
    """Samples of a track fragment: (offset, size), durations, and which are sync samples."""

    ranges: np.ndarray
    durations: np.ndarray
    sync: np.ndarray


@dataclass
class Track:
    """A track: what its boxes say, and the runs of its fragments. Edit lists are not applied: times are those of the media."""

    handler: str = ""
    codec: str = ""
    timescale: int = 0
    duration: int = 0
    tables: dict[bytes, bytes] = field(default_factory=dict)
    number: int = 0
    #: Of fragments: duration, size and flags of samples where nothing else is said.
    defaults: tuple[int, int, int] = (0, 0, 0)
    runs: list[Run] = field(default_factory=list)

    @property
    def seconds(self) -> float:
        return self.duration / self.timescale if self.timescale else 0.0

    def samples(self) -> int:
        return len(self.ranges())

    def sizes(self) -> np.ndarray:
        """Sizes of the samples that the sample table lists, from stsz or stz2."""
        if b"stsz" not in self.tables and b"stz2" in self.tables:
            raw = self._full(b"stz2")
            width, n = raw[3], struct.unpack_from(">I", raw, 4)[0]
            if width == 4:
                both = _ints(raw, 8, (n + 1) // 2, "u1")
                return np.stack([both >> 4, both & 15], axis=1).reshape(-1)[:n]
            if width not in (8, 16):
                raise BrokenMedia(f"stz2 with fields of {width} bits")
            return _ints(raw, 8, n, "u1" if width == 8 else ">u2")
        fixed, n = struct.unpack_from(">II", self._full(b"stsz"))
        if fixed:
            return np.full(n, fixed, np.int64)
        return _ints(self._full(b"stsz"), 8, n, ">u4")

    def durations(self) -> np.ndarray:
        t = _table(self._full(b"stts"), 2)
        return np.concatenate([np.repeat(t[:, 1], t[:, 0]), *(r.durations for r in self.runs)])

    def chunks(self) -> tuple[np.ndarray, np.ndarray]:
        """(file offset, samples) of each chunk, from stco or co64 and the runs of stsc."""
        wide = b"co64" in self.tables
        raw = self._full(b"co64" if wide else b"stco")
        offsets = _ints(raw, 4, struct.unpack_from(">I", raw)[0], ">u8" if wide else ">u4")
        runs = _table(self._full(b"stsc"), 3)
        per = np.zeros(len(offsets), np.int64)
        if len(offsets):
            if not len(runs) or runs[0, 0] != 1:
                raise BrokenMedia("stsc does not start at the first chunk")
            last = np.append(runs[1:, 0] - 1, len(offsets))
            per = np.repeat(runs[:, 1], last - (runs[:, 0] - 1))
        return offsets, per

    def ranges(self) -> np.ndarray:
        """(offset, size) of each sample, of the sample table and then of fragments."""
        return np.concatenate([self._listed(), *(r.ranges for r in self.runs)])

    def _listed(self) -> np.ndarray:
        sizes, (offsets, per) = self.sizes(), self.chunks()
        if per.sum() != len(sizes):
            raise BrokenMedia("stsc and stsz disagree")
        before = np.concatenate([[0], np.cumsum(sizes)])
        first = np.concatenate([[0], np.cumsum(per)])[:-1]
        start = np.repeat(offsets - before[first], per) + before[:-1]
        return np.stack([start, sizes], axis=1)

    def keyframes(self) -> np.ndarray:
        """(offset, size) of each sync sample; without stss every sample of the sample table is one."""
        listed = self._listed()
        if b"stss" in self.tables:
            raw = self._full(b"stss")
            at = _ints(raw, 4, struct.unpack_from(">I", raw)[0], ">u4") - 1
            if len(at) and (at.min() < 0 or at.max() >= len(listed)):
                raise BrokenMedia("stss names a sample that is not there")
            listed = listed[at]
        return np.concatenate([listed, *(r.ranges[r.sync] for r in self.runs)])

    def _full(self, kind: bytes) -> bytes:
        if kind not in self.tables:
            raise BrokenMedia(f"no {kind.decode()} box")
        return self.tables[kind][4:]


def _ints(raw: bytes, at: int, n: int, kind: str) -> np.ndarray:
    if len(raw) < at + n * np.dtype(kind).itemsize:
        raise BrokenMedia("a table ends early")
    return np.frombuffer(raw, kind, n, at).astype(np.int64)


def _table(raw: bytes, width: int) -> np.ndarray:
    n = struct.unpack_from(">I", raw)[0]
    return _ints(raw, 4, n * width, ">u4").reshape(-1, width)


def boxes(data: bytes, start: int, stop: int) -> Iterator[tuple[bytes, int, int]]:
    """(kind, body start, body stop) of the boxes of one level; 64-bit sizes and size 0 (to the end) too."""
    while start < stop:
        if stop - start < 8:
            raise BrokenMedia("a box header ends early")
        size, kind = struct.unpack_from(">I4s", data, start)
        head = 8
        if size == 1:
            if stop - start < 16:
                raise BrokenMedia("a box header ends early")
            size, head = struct.unpack_from(">Q", data, start + 8)[0], 16
        elif size == 0:
            size = stop - start
        if kind == b"uuid":
            head += 16
        if size < head or start + size > stop:
            raise BrokenMedia(f"box {kind!r} leaves its parent")
        yield kind, start + head, start + size
        start += size


def tracks(data: bytes) -> list[Track]:
    """The tracks of a file, with their fragments. Raises :class:`BrokenMedia` where boxes do not hold together."""
    found: list[Track] = []
    moof = 0

    def walk(start: int, stop: int) -> None:
        nonlocal moof
        for kind, a, b in boxes(data, start, stop):
            if kind == b"trak":
                found.append(Track())
            if kind == b"moof":
                moof = start_of(a)
                fragments(a, b)
            elif kind in CONTAINERS:
                walk(a, b)
            elif kind == b"trex":
                number, _, *defaults = struct.unpack_from(">5I", data, a + 4)
                trex[number] = tuple(defaults)
            elif not found:
                continue
            elif kind == b"tkhd":
                found[-1].number = struct.unpack_from(">I", data, a + (20 if data[a] == 1 else 12))[0]
            elif kind == b"mdhd":
                wide = data[a] == 1
                found[-1].timescale, found[-1].duration = struct.unpack_from(">IQ" if wide else ">II", data, a + (20 if wide else 12))
            elif kind == b"hdlr":
                found[-1].handler = data[a + 8 : a + 12].decode("latin-1")
            elif kind == b"stsd":
                found[-1].codec = data[a + 12 : a + 16].decode("latin-1")
            elif kind in (b"stts", b"stss", b"stsc", b"stsz", b"stz2", b"stco", b"co64"):
                found[-1].tables[kind] = bytes(data[a:b])

    def start_of(body: int) -> int:
        """Where the box whose body starts here starts: its header has 8 bytes, or 16 with a 64-bit size."""
        return body - 16 if body >= 16 and struct.unpack_from(">I4s", data, body - 16) == (1, b"moof") else body - 8

    def fragments(start: int, stop: int) -> None:
        end = moof
        for kind, a, b in boxes(data, start, stop):
            if kind != b"traf":
                continue
            inner = list(boxes(data, a, b))
            head = next((x for k, x, _ in inner if k == b"tfhd"), None)
            if head is None:
                raise BrokenMedia("a track fragment without a header")
            flags, number = struct.unpack_from(">II", data, head)
            flags &= 0xFFFFFF
            track = next((t for t in found if t.number == number), None)
            if track is None:
                raise BrokenMedia(f"a fragment of track {number}, which is not there")
            duration, size, sample = trex.get(number, track.defaults)
            at, base = head + 8, moof if flags & BASE_IS_MOOF else end
            if flags & BASE:
                base, at = struct.unpack_from(">Q", data, at)[0], at + 8
            at += 4 * bool(flags & DESCRIPTION)
            if flags & FRAGMENT_DURATION:
                duration, at = struct.unpack_from(">I", data, at)[0], at + 4
            if flags & FRAGMENT_SIZE:
                size, at = struct.unpack_from(">I", data, at)[0], at + 4
            if flags & FRAGMENT_FLAGS:
                sample = struct.unpack_from(">I", data, at)[0]
            end = base
            for k, x, y in inner:
                if k == b"trun":
                    run, end = track_run(data[x:y], base, end, (duration, size, sample))
                    track.runs.append(run)

    trex: dict[int, tuple[int, int, int]] = {}
    try:
        walk(0, len(data))
    except (struct.error, IndexError) as e:
        raise BrokenMedia(str(e)) from e
    for t in found:
        if t.runs:
            # The header of a fragmented file counts no more than its own samples, often none.
            t.duration = int(t.durations().sum())
    return found


def track_run(raw: bytes, base: int, end: int, defaults: tuple[int, int, int]) -> tuple[Run, int]:
    """The samples of a trun box and where their bytes end; without an offset of its own a run follows the one before."""
    flags, n = struct.unpack_from(">II", raw)
    flags &= 0xFFFFFF
    at, start = 8, end
    if flags & OFFSET:
        start, at = base + struct.unpack_from(">i", raw, at)[0], at + 4
    first = None
    if flags & FIRST_FLAGS:
        first, at = struct.unpack_from(">I", raw, at)[0], at + 4
    present = [f for f in (DURATION, SIZE, FLAGS, COMPOSITION) if flags & f]
    own = _ints(raw, at, n * len(present), ">u4").reshape(n, len(present))
    column = lambda f, default: own[:, present.index(f)] if f in present else np.full(n, default, np.int64)
    durations, sizes, samples = column(DURATION, defaults[0]), column(SIZE, defaults[1]), column(FLAGS, defaults[2]).copy()
    if first is not None and n:
        samples[0] = first
    starts = start + np.cumsum(sizes) - sizes
    return Run(np.stack([starts, sizes], axis=1), durations, (samples & NON_SYNC) == 0), int(start + sizes.sum())


def payload(data: bytes, track: Track) -> bytes:
    """The samples of a track in order; those that lie end to end are gathered at once."""
    ranges = track.ranges()
    if not len(ranges):
        return b""
    stops = ranges.sum(axis=1)
    if ranges.min() < 0 or stops.max() > len(data):
        raise BrokenMedia("a sample lies outside the file")
    heads = np.flatnonzero(np.concatenate([[True], ranges[1:, 0] != stops[:-1]]))
    tails = np.append(heads[1:], len(ranges)) - 1
    return b"".join(data[a:b] for a, b in zip(ranges[heads, 0].tolist(), stops[tails].tolist()))


def _box(kind: bytes, *parts: bytes) -> bytes:
    body = b"".join(parts)
    return struct.pack(">I4s", 8 + len(body), kind) + body


def _fullbox(kind: bytes, *parts: bytes, flags: int = 0) -> bytes:
    return _box(kind, struct.pack(">I", flags), *parts)


def write(frames: bytes, side: int = 8, rate: int = 25, key_every: int = 12, per_chunk: int = 64) -> bytes:
    """A file with one track of raw RGB frames of ``side`` x ``side`` 8-bit samples; payload after moov."""
    size = side * side * 3
    n, rest = divmod(len(frames), size)
    if rest:
        raise ValueError(f"the payload is no multiple of {size} bytes")
    ftyp = _box(b"ftyp", b"isom", struct.pack(">I", 512), b"isomiso2mp41")
    chunks = -(-n // per_chunk)
    wide = len(frames) > 0xF0000000
    entry = _box(b"raw ", bytes(6), struct.pack(">H", 1), bytes(16), struct.pack(">HHIIIH", side, side, 0x480000, 0x480000, 0, 1), bytes(32), struct.pack(">Hh", 24, -1))
    runs = [(1, min(per_chunk, n), 1)] if n else []
    if chunks > 1 and n % per_chunk:
        runs.append((chunks, n % per_chunk, 1))
    keys = np.arange(1, n + 1, key_every)

    def moov(base: int) -> bytes:
        at = base + np.arange(chunks, dtype=np.int64) * (size * per_chunk)
        offsets = _fullbox(b"co64" if wide else b"stco", struct.pack(">I", chunks), at.astype(">u8" if wide else ">u4").tobytes())
        stbl = _box(
            b"stbl",
            _fullbox(b"stsd", struct.pack(">I", 1), entry),
            _fullbox(b"stts", struct.pack(">III", 1, n, 1) if n else struct.pack(">I", 0)),
            _fullbox(b"stss", struct.pack(">I", len(keys)), keys.astype(">u4").tobytes()),
            _fullbox(b"stsc", struct.pack(">I", len(runs)), *(struct.pack(">III", *r) for r in runs)),
            _fullbox(b"stsz", struct.pack(">II", size, n)),
            offsets,
        )
        media = _box(
            b"mdia",
            _fullbox(b"mdhd", struct.pack(">IIIIHH", 0, 0, rate, n, 0x55C4, 0)),
            _fullbox(b"hdlr", bytes(4), b"vide", bytes(12), b"frames\0"),
            _box(b"minf", _fullbox(b"vmhd", bytes(8), flags=1), _box(b"dinf", _fullbox(b"dref", struct.pack(">I", 1), _fullbox(b"url ", flags=1))), stbl),
        )
        track = _box(b"trak", _fullbox(b"tkhd", struct.pack(">IIIII", 0, 0, 1, 0, n), bytes(16), UNIT, struct.pack(">II", side << 16, side << 16), flags=3), media)
        return _box(b"moov", _fullbox(b"mvhd", struct.pack(">IIIIIH", 0, 0, rate, n, 0x10000, 0x100), bytes(10), UNIT, bytes(24), struct.pack(">I", 2)), track)

    head = 16 if wide else 8
    index = moov(len(ftyp) + len(moov(0)) + head)
    mdat = struct.pack(">I4sQ", 1, b"mdat", 16 + len(frames)) if wide else struct.pack(">I4s", 8 + len(frames), b"mdat")
    return b"".join([ftyp, index, mdat, frames])
