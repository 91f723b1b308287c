"""Metadata of JPEG, HEIF and WebP files as a flat dictionary."""

from __future__ import annotations

import re
import struct
from datetime import datetime, timedelta

MOST_BYTES = 16 << 20
#: Bytes of each field type.
TYPE_SIZES = {1: 1, 2: 1, 3: 2, 4: 4, 5: 8, 6: 1, 7: 1, 8: 2, 9: 4, 10: 8, 11: 4, 12: 8}


def jpeg_block(data: bytes) -> bytes | None:
    """The TIFF block of the first Exif segment before the scan."""
    at = 2
    while data[:2] == b"\xff\xd8" and at + 4 <= len(data) and data[at] == 0xFF:
        marker, size = data[at + 1], int.from_bytes(data[at + 2 : at + 4], "big")
        if marker in (0xDA, 0xD9) or size < 2:
            return None
        if marker == 0xE1 and data[at + 4 : at + 10] == b"Exif\0\0":
            return data[at + 10 : at + 2 + size]
        at += 2 + size
    return None


def webp_block(data: bytes) -> bytes | None:
    at = 12
    while data[:4] == b"RIFF" and data[8:12] == b"WEBP" and at + 8 <= len(data):
        size = int.from_bytes(data[at + 4 : at + 8], "little")
        if data[at : at + 4] == b"EXIF":
            return _tiff(data[at + 8 : at + 8 + min(size, MOST_BYTES)], 0, 16)
        at += 8 + size + size % 2
    return None


def _tiff(data: bytes, offset: int, reach: int) -> bytes | None:
    """From the TIFF header at an offset, or else within reach."""
    for at in (offset, *range(min(reach, len(data)))):
        if data[at : at + 4] in (b"II*\0", b"MM\0*"):
            return data[at:]
    return None


def _boxes(data: bytes) -> list[tuple[bytes, bytes]]:
    out, at = [], 0
    while at + 8 <= len(data):
        size, kind, head = int.from_bytes(data[at : at + 4], "big"), data[at + 4 : at + 8], 8
        if size == 1:
            size, head = int.from_bytes(data[at + 8 : at + 16], "big"), 16
        size = size or len(data) - at
        if size < head or at + size > len(data):
            break
        out.append((kind, data[at + head : at + size]))
        at += size
    return out


def heif_block(data: bytes) -> bytes | None:
    """The Exif item: its number from the item infos, its place from the item locations, in the file or in ``idat``."""
    meta = next((b for k, b in _boxes(data) if k == b"meta"), None)
    if meta is None:
        return None
    inner = dict(_boxes(meta[4:]))
    infos, places, idat = inner.get(b"iinf", b""), inner.get(b"iloc", b""), inner.get(b"idat", b"")
    wanted = set()
    for kind, b in _boxes(infos[6 if infos[:1] == b"\0" else 8 :]):
        if kind == b"infe" and b[0] >= 2:
            wide = 4 if b[0] == 3 else 2
            if b[4 + wide + 2 : 4 + wide + 6] == b"Exif":
                wanted.add(int.from_bytes(b[4 : 4 + wide], "big"))
    if len(places) < 8:
        return None
    version = places[0]
    size_o, size_l, size_b, size_i = places[4] >> 4, places[4] & 15, places[5] >> 4, places[5] & 15
    at = 6

    def take(n: int) -> int:
        nonlocal at
        if at + n > len(places):
            raise ValueError("cut off")
        v, at = int.from_bytes(places[at : at + n], "big"), at + n
        return v

    try:
        for _ in range(take(4 if version == 2 else 2)):
            item = take(4 if version == 2 else 2)
            method = take(2) & 15 if version else 0
            take(2)
            base = take(size_b)
            parts = []
            for _ in range(take(2)):
                if version and size_i:
                    take(size_i)
                lo = base + take(size_o)
                parts.append((idat if method == 1 else data)[lo : lo + min(take(size_l), MOST_BYTES)])
            if item in wanted and method in (0, 1):
                body = b"".join(parts)
                return _tiff(body[4:], int.from_bytes(body[:4], "big"), 64) if len(body) > 8 else None
    except ValueError:
        pass
    return None


def date(text: str | None) -> datetime | None:
    """``Y:M:D H:M:S``; parts beyond their range roll over, as in a lenient calendar."""
    m = re.fullmatch(r"(-?\d{1,5}):(-?\d{1,5}):(-?\d{1,5}) (-?\d{1,5}):(-?\d{1,5}):(-?\d{1,5})", text or "", re.ASCII)
    if not m:
        return None
    y, mo, d, h, mi, s = map(int, m.groups())
    try:
        return datetime(y + (mo - 1) // 12, (mo - 1) % 12 + 1, 1) + timedelta(days=d - 1, hours=h, minutes=mi, seconds=s)
    except (ValueError, OverflowError):
        return None


class Tiff:
    def __init__(self, block: bytes):
        self.b = block
        self.end = "<" if block[:2] == b"II" else ">"

    def number(self, fmt: str, at: int):
        try:
            return struct.unpack_from(self.end + fmt, self.b, at)[0]
        except struct.error:
            return None

    def fields(self, at: int | None) -> tuple[dict[int, tuple[int, int, bytes]], int]:
        """tag to (type, count, bytes) of a directory, and the place of the next one."""
        out: dict[int, tuple[int, int, bytes]] = {}
        n = self.number("H", at) if at else None
        for k in range(n or 0):
            e = at + 2 + 12 * k
            tag, kind, count = self.number("H", e), self.number("H", e + 2), self.number("I", e + 4)
            if count is None or kind not in TYPE_SIZES:
                continue
            size = TYPE_SIZES[kind] * count
            place = e + 8 if size <= 4 else self.number("I", e + 8)
            if place is not None and place + size <= len(self.b):
                out[tag] = (kind, count, self.b[place : place + size])
        return out, (self.number("I", at + 2 + 12 * n) or 0) if n is not None else 0

    def integer(self, f) -> int | None:
        fmt = {1: "B", 3: "H", 4: "I", 9: "i"}.get(f[0]) if f else None
        return struct.unpack_from(self.end + fmt, f[2])[0] if fmt and len(f[2]) >= struct.calcsize(fmt) else None

    def rationals(self, f) -> list[float] | None:
        """A numerator is read as signed, a zero denominator gives nothing."""
        if not f or f[0] not in (5, 10) or len(f[2]) < 8:
            return None
        pairs = [struct.unpack_from(self.end + "iI", f[2], k) for k in range(0, len(f[2]) - 7, 8)]
        return None if any(d == 0 for _, d in pairs) else [a / d for a, d in pairs]


def _text(f) -> str | None:
    if not f or f[0] != 2:
        return None
    return f[2].split(b"\0")[0].decode("utf-8", "replace") or None


def parse(block: bytes | None) -> dict | None:
    """The fields that the rules use; None without a TIFF header."""
    if not block or block[:4] not in (b"II*\0", b"MM\0*"):
        return None
    t = Tiff(block)
    main, following = t.fields(t.number("I", 4))
    sub, _ = t.fields(t.integer(main.get(0x8769)))
    gps, _ = t.fields(t.integer(main.get(0x8825)))
    second, _ = t.fields(following)
    out = {"make": _text(main.get(0x010F)), "model": _text(main.get(0x0110)), "software": _text(main.get(0x0131)), "lens": _text(sub.get(0xA434))}
    for name, f in (("modified", main.get(0x0132)), ("original", sub.get(0x9003)), ("digitized", sub.get(0x9004))):
        out[name] = date(_text(f))
    stamp, day = t.rationals(gps.get(7)), _text(gps.get(29))
    out["gps"] = date(f"{day} {':'.join(str(int(x)) for x in stamp)}") if stamp and len(stamp) == 3 and day else None
    altitude = t.rationals(gps.get(6))
    out |= {"has_gps": bool(gps), "altitude": altitude[0] if altitude else None, "altitude_ref": t.integer(gps.get(5))}
    start, size = t.integer(second.get(0x0201)), t.integer(second.get(0x0202))
    jpeg = block[start : start + size] if start and size and start + size <= len(block) else None
    out["thumbnail"] = {"compression": t.integer(second.get(0x0103)), "jpeg": jpeg} if second else None
    return out


def read(data: bytes, fmt: str | None) -> dict | None:
    return parse({"jpeg": jpeg_block, "webp": webp_block, "heif": heif_block}.get(fmt, lambda _: None)(data))
