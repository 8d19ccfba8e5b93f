"""What video files say about themselves: size in pixels, frames and frame rate, from container headers alone.

ISO base media (mp4, m4v, mov, 3gp), RIFF (avi) and Matroska (mkv, webm) headers are read by seeking from one to the
next; picture data is passed over, so a file costs some kilobytes whatever its length. Other containers, and headers
that are broken, give zeros.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from typing import BinaryIO, NamedTuple


class VideoInfo(NamedTuple):
    width: int = 0
    height: int = 0
    fps: float = 0.0
    frames: int = 0


#: A header with more parts than this, or parts nested deeper, is taken for broken.
MOST_PARTS = 100_000


def _read(file: BinaryIO, at: int, size: int) -> bytes:
    file.seek(at)
    raw = file.read(size)
    if len(raw) < size:
        raise ValueError("the file ends within a header")
    return raw


# ISO base media ---------------------------------------------------------------------------------------------------


def _boxes(file: BinaryIO, at: int, end: int) -> Iterator[tuple[bytes, int, int]]:
    """(kind, start, end) of the bodies of the boxes between two places."""
    for _ in range(MOST_PARTS):
        if at + 8 > end:
            return
        size, kind = struct.unpack(">I4s", _read(file, at, 8))
        head = 8
        if size == 1:
            size, head = struct.unpack(">Q", _read(file, at + 8, 8))[0], 16
        elif size == 0:
            size = end - at
        if size < head or (at + size > end and kind != b"mdat"):
            raise ValueError("a box doesn't end where it says")
        yield kind, at + head, min(at + size, end)
        at += size


def _inside(file: BinaryIO, span: tuple[int, int], *path: bytes) -> tuple[int, int] | None:
    """The body of the first box down a path of kinds."""
    for step in path:
        span = next(((a, b) for kind, a, b in _boxes(file, *span) if kind == step), None)
        if span is None:
            return None
    return span


def _iso(file: BinaryIO, size: int) -> VideoInfo:
    movie = _inside(file, (0, size), b"moov")
    if movie is None:
        return VideoInfo()
    for kind, a, b in _boxes(file, *movie):
        if kind != b"trak":
            continue
        handler = _inside(file, (a, b), b"mdia", b"hdlr")
        if handler is None or _read(file, handler[0] + 8, 4) != b"vide":
            continue
        clock, table, track = (_inside(file, (a, b), *p) for p in ((b"mdia", b"mdhd"), (b"mdia", b"minf", b"stbl"), (b"tkhd",)))
        if clock is None or table is None:
            return VideoInfo()
        if _read(file, clock[0], 1) == b"\1":
            scale, length = struct.unpack(">IQ", _read(file, clock[0] + 20, 12))
        else:
            scale, length = struct.unpack(">II", _read(file, clock[0] + 12, 8))
        counted = _inside(file, table, b"stsz") or _inside(file, table, b"stz2")
        frames = struct.unpack(">I", _read(file, counted[0] + 8, 4))[0] if counted else 0
        width = height = 0
        coded = _inside(file, table, b"stsd")
        if coded is not None and coded[1] - coded[0] >= 44:
            width, height = struct.unpack(">HH", _read(file, coded[0] + 40, 4))
        if not (width and height) and track is not None:
            width, height = (x >> 16 for x in struct.unpack(">II", _read(file, track[1] - 8, 8)))
        return VideoInfo(width, height, frames * scale / length if length else 0.0, frames)
    return VideoInfo()


# RIFF -------------------------------------------------------------------------------------------------------------


def _chunks(file: BinaryIO, at: int, end: int) -> Iterator[tuple[bytes, int, int]]:
    """(kind, start, end) of chunk bodies; a list's kind is that of what it lists."""
    for _ in range(MOST_PARTS):
        if at + 8 > end:
            return
        kind, size = struct.unpack("<4sI", _read(file, at, 8))
        start, stop = at + 8, min(at + 8 + size, end)
        if kind in (b"RIFF", b"LIST"):
            yield _read(file, start, 4), start + 4, stop
        else:
            yield kind, start, stop
        at += 8 + size + size % 2


def _avi(file: BinaryIO, size: int) -> VideoInfo:
    head = next(((a, b) for kind, a, b in _chunks(file, 12, size) if kind == b"hdrl"), None)
    if head is None:
        return VideoInfo()
    micro = frames = width = height = 0
    fps = 0.0
    for kind, a, b in _chunks(file, *head):
        if kind == b"avih":
            micro, frames, width, height = (struct.unpack("<I", _read(file, a + k, 4))[0] for k in (0, 16, 32, 36))
        elif kind == b"strl" and not fps:
            stream = next(((x, y) for k, x, y in _chunks(file, a, b) if k == b"strh"), None)
            if stream is not None and _read(file, stream[0], 4) == b"vids":
                scale, rate = struct.unpack("<II", _read(file, stream[0] + 20, 8))
                length = struct.unpack("<I", _read(file, stream[0] + 32, 4))[0]
                fps, frames = (rate / scale if scale else 0.0), length or frames
    return VideoInfo(width, height, fps or (1e6 / micro if micro else 0.0), frames)


# Matroska ---------------------------------------------------------------------------------------------------------

# The numbers of the elements that are read.
_SEGMENT, _CLUSTER, _INFO, _TRACKS, _TRACK = 0x18538067, 0x1F43B675, 0x1549A966, 0x1654AE6B, 0xAE
_SCALE, _DURATION, _TYPE, _FRAME_TIME, _VIDEO, _WIDTH, _HEIGHT = 0x2AD7B1, 0x4489, 0x83, 0x23E383, 0xE0, 0xB0, 0xBA


def _number(file: BinaryIO, at: int, keep_mark: bool) -> tuple[int, int]:
    """A number of variable length and the bytes it takes; an unknown size is -1."""
    first = _read(file, at, 1)[0]
    length = 9 - first.bit_length()
    if length > 8:
        raise ValueError("no element begins here")
    value = int.from_bytes(_read(file, at, length), "big")
    if keep_mark:
        return value, length
    value &= (1 << 7 * length) - 1
    return (-1 if value == (1 << 7 * length) - 1 else value), length


def _elements(file: BinaryIO, at: int, end: int) -> Iterator[tuple[int, int, int]]:
    """(number, start, end) of the bodies of the elements between two places."""
    for _ in range(MOST_PARTS):
        if at + 2 > end:
            return
        kind, a = _number(file, at, True)
        size, b = _number(file, at + a, False)
        start = at + a + b
        stop = end if size < 0 else min(start + size, end)
        yield kind, start, stop
        at = stop


def _whole(file: BinaryIO, a: int, b: int) -> int:
    return int.from_bytes(_read(file, a, b - a), "big")


def _matroska(file: BinaryIO, size: int) -> VideoInfo:
    segment = next(((a, b) for kind, a, b in _elements(file, 0, size) if kind == _SEGMENT), None)
    if segment is None:
        return VideoInfo()
    scale, length, video = 1_000_000, 0.0, None
    for kind, a, b in _elements(file, *segment):
        if kind == _INFO:
            for k, x, y in _elements(file, a, b):
                if k == _SCALE:
                    scale = _whole(file, x, y)
                elif k == _DURATION:
                    length = struct.unpack(">f" if y - x == 4 else ">d", _read(file, x, y - x))[0]
        elif kind == _TRACKS:
            for k, x, y in _elements(file, a, b):
                own = {n: (p, q) for n, p, q in _elements(file, x, y)} if k == _TRACK else {}
                if video is None and _TYPE in own and _whole(file, *own[_TYPE]) == 1:
                    video = own
        if (video and length) or kind == _CLUSTER:
            break
    if not video:
        return VideoInfo()
    pixels = {n: _whole(file, p, q) for n, p, q in _elements(file, *video[_VIDEO]) if n in (_WIDTH, _HEIGHT)} if _VIDEO in video else {}
    gap = _whole(file, *video[_FRAME_TIME]) if _FRAME_TIME in video else 0
    fps = 1e9 / gap if gap else 0.0
    return VideoInfo(pixels.get(_WIDTH, 0), pixels.get(_HEIGHT, 0), fps, round(length * scale / 1e9 * fps))


def video_info(file: BinaryIO, size: int) -> VideoInfo:
    """The first video track's width, height, frames a second and frames; zeros where they can't be had."""
    try:
        start = _read(file, 0, 12)
        if start[:4] == b"RIFF" and start[8:] == b"AVI ":
            return _avi(file, size)
        if start[:4] == b"\x1a\x45\xdf\xa3":
            return _matroska(file, size)
        if start[4:8] in (b"ftyp", b"moov", b"mdat", b"wide", b"free", b"skip"):
            return _iso(file, size)
    except (ValueError, struct.error, OSError, OverflowError):
        pass
    return VideoInfo()
