"""Seeded images, encoders and containers for the tests."""

import struct

import numpy as np

from veritile.functions.kernels import dct, half_away, quantization, recompress, to_blocks
from veritile.sources.decode import ZIGZAG


def noise(n=128, channels=3, seed=42):
    return np.random.default_rng(seed).integers(0, 256, (n, n, channels)).astype(np.uint8)


def smooth(n=256, seed=1, channels=1):
    """Random texture, blurred twice and stretched to a deviation of 45 around 128."""
    p = np.random.default_rng(seed).normal(size=(n + 16, n + 16))
    for _ in range(2):
        for axis in (0, 1):
            p = sum(np.roll(p, k, axis) for k in range(-2, 3))
    p = p[8:-8, 8:-8]
    p = np.clip(np.round(128 + 45 * (p - p.mean()) / p.std()), 0, 255)
    return np.repeat(p[..., None], channels, 2).astype(np.uint8)


def scene(n=256, sigma=2.0, seed=3, channels=3):
    y, x = np.mgrid[:n, :n]
    base = 110 + 50 * np.sin(x / 37 + 0.4) + 30 * np.cos(y / 29 + x / 41 + 1.1)
    r = np.random.default_rng(seed)
    return np.clip(half_away(base[..., None] + r.normal(0, sigma, (n, n, channels))), 0, 255).astype(np.uint8)


def mosaic(n=256, seed=5, offset=0):
    """A scene sampled through an RGGB filter with noise, then interpolated bilinearly."""
    r = np.random.default_rng(seed)
    y, x = np.mgrid[:n, :n]
    out = []
    phase = ((y + offset) % 2) * 2 + x % 2
    for keep in ((0,), (1, 2), (3,)):
        full = 110 + 50 * np.sin(x / 37 + keep[0]) + 30 * np.cos(y / 29 + x / 41) + r.normal(0, 4, (n, n))
        mask = np.isin(phase, keep).astype(float)
        k = np.array([[0.25, 0.5, 0.25], [0.5, 1, 0.5], [0.25, 0.5, 0.25]])
        pad = lambda a: np.pad(a, 1, mode="reflect")
        conv = lambda a: sum(k[i, j] * pad(a)[i : i + n, j : j + n] for i in range(3) for j in range(3))
        out.append(np.where(mask > 0, full, conv(full * mask) / conv(mask)))
    return np.clip(half_away(np.stack(out, -1)), 0, 255).astype(np.uint8)


def jpeg(px, quality=90, exif=None, restart=0):
    """A baseline file with plain 4- and 8-bit codes; gray, or YCbCr at full resolution."""
    h, w, c = px.shape
    p = px.astype(float)
    planes = [p[..., 0]]
    if c == 3:
        r, g, b = p[..., 0], p[..., 1], p[..., 2]
        planes = [0.299 * r + 0.587 * g + 0.114 * b, 128 - 0.168736 * r - 0.331264 * g + 0.5 * b, 128 + 0.5 * r - 0.418688 * g - 0.081312 * b]
    table = np.array(quantization(quality), float)
    symbols = [0x00, 0xF0, *(run << 4 | size for run in range(16) for size in range(1, 11))]
    bits: list[str] = []
    data = b""
    coded = [half_away(dct(to_blocks(q) - 128) / table.reshape(8, 8)).reshape(-(-h // 8) * -(-w // 8), 64)[:, ZIGZAG].astype(int) for q in planes]

    def amount(v):
        n = abs(v).bit_length()
        return n, format(v if v > 0 else v + (1 << n) - 1, f"0{n}b") if n else ""

    def flush():
        s = "".join(bits)
        s += "1" * (-len(s) % 8)
        bits.clear()
        return bytes(int(s[k : k + 8], 2) for k in range(0, len(s), 8)).replace(b"\xff", b"\xff\0")

    last = [0] * len(planes)
    for k in range(len(coded[0])):
        if restart and k and k % restart == 0:
            data += flush() + bytes([0xFF, 0xD0 + (k // restart - 1) % 8])
            last = [0] * len(planes)
        for j, blocks in enumerate(coded):
            n, v = amount(int(blocks[k, 0]) - last[j])
            last[j] = int(blocks[k, 0])
            bits.append(format(n, "04b") + v)
            run = 0
            for value in blocks[k, 1:]:
                if not value:
                    run += 1
                    continue
                while run > 15:
                    bits.append(format(symbols.index(0xF0), "08b"))
                    run -= 16
                n, v = amount(int(value))
                bits.append(format(symbols.index(run << 4 | n), "08b") + v)
                run = 0
            if run:
                bits.append(format(symbols.index(0), "08b"))
    data += flush()
    seg = lambda m, body: bytes([0xFF, m]) + struct.pack(">H", len(body) + 2) + body
    codes = lambda kind, length, syms: bytes([kind]) + bytes(len(syms) if k == length else 0 for k in range(1, 17)) + bytes(syms)
    out = b"\xff\xd8"
    if exif is not None:
        out += seg(0xE1, b"Exif\0\0" + exif)
    out += seg(0xDB, b"\0" + bytes(int(table[k]) for k in ZIGZAG))
    out += seg(0xC0, struct.pack(">BHHB", 8, h, w, c) + b"".join(bytes([k + 1, 0x11, 0]) for k in range(c)))
    out += seg(0xC4, codes(0x00, 4, list(range(12))) + codes(0x10, 8, symbols))
    if restart:
        out += seg(0xDD, struct.pack(">H", restart))
    out += seg(0xDA, bytes([c]) + b"".join(bytes([k + 1, 0]) for k in range(c)) + b"\0\x3f\0")
    return out + data + b"\xff\xd9"


def tiff(make=None, model=None, software=None, modified=None, original=None, digitized=None, gps=None, altitude=None, ref=None, thumbnail=None, lens=None, end="<"):
    """An EXIF block with the given fields."""
    head = (b"II*\0" if end == "<" else b"MM\0*") + struct.pack(end + "I", 8)
    text = lambda s: (2, len(s) + 1, s.encode() + b"\0")
    rational = lambda *v: (5, len(v), b"".join(struct.pack(end + "iI", int(x * 100), 100) for x in v))
    main = {t: text(v) for t, v in ((0x10F, make), (0x110, model), (0x131, software), (0x132, modified)) if v is not None}
    sub = {t: text(v) for t, v in ((0x9003, original), (0x9004, digitized), (0xA434, lens)) if v is not None}
    place = {}
    if gps is not None:
        day, time = gps.split(" ")
        place |= {7: rational(*map(int, time.split(":"))), 29: text(day)}
    if altitude is not None:
        place[6] = rational(altitude)
    if ref is not None:
        place[5] = (1, 1, bytes([ref]))

    def directory(at, fields, more=0):
        """Bytes of a directory at a place, and where it ends."""
        extra_at = at + 2 + 12 * len(fields) + 4
        out, extra = struct.pack(end + "H", len(fields)), b""
        for tag, (kind, count, data) in sorted(fields.items()):
            if len(data) > 4:
                value = struct.pack(end + "I", extra_at + len(extra))
                extra += data
            else:
                value = data.ljust(4, b"\0")
            out += struct.pack(end + "HHI", tag, kind, count) + value
        return out + struct.pack(end + "I", more) + extra

    long = lambda v: (4, 1, struct.pack(end + "I", v))
    pointers = {t: long(0) for t, f in ((0x8769, sub), (0x8825, place)) if f}
    at = 8 + len(directory(8, main | pointers))
    parts = b""
    for t, f in ((0x8769, sub), (0x8825, place)):
        if f:
            pointers[t] = long(at + len(parts))
            parts += directory(at + len(parts), f)
    following = 0
    if thumbnail is not None:
        following = at + len(parts)
        fields = {0x103: (3, 1, struct.pack(end + "H", 6)), 0x201: long(0), 0x202: long(len(thumbnail))}
        size = len(directory(following, fields))
        fields[0x201] = long(following + size)
        parts += directory(following, fields) + thumbnail
    return head + directory(8, main | pointers, following) + parts


def webp(block):
    chunk = b"EXIF" + struct.pack("<I", len(block)) + block + b"\0" * (len(block) % 2)
    body = b"WEBPVP8X" + struct.pack("<I", 10) + b"\x08" + b"\0" * 9 + chunk
    return b"RIFF" + struct.pack("<I", len(body)) + body


def heif(block):
    box = lambda kind, body: struct.pack(">I", len(body) + 8) + kind + body
    item = struct.pack(">I", 0) + block
    infos = box(b"iinf", b"\0\0\0\0" + struct.pack(">H", 1) + box(b"infe", b"\x02\0\0\0" + struct.pack(">HH", 7, 0) + b"Exif\0"))
    top = box(b"ftyp", b"heic\0\0\0\0mif1heic")
    place = lambda at: box(b"iloc", b"\0\0\0\0\x44\0" + struct.pack(">HHHH", 1, 7, 0, 1) + struct.pack(">II", at, len(item)))
    meta = lambda at: box(b"meta", b"\0\0\0\0" + infos + place(at))
    return top + meta(len(top) + len(meta(0)) + 8) + box(b"mdat", item)


def composite():
    """A texture saved at 85 with a part saved at 60, saved again at 85."""
    host, other = (recompress(smooth(256, s)[..., 0], q) for s, q in ((1, 85), (2, 60)))
    host[64:128, 128:192] = other[:64, :64]
    return recompress(host, 85)[..., None].astype(np.uint8)
