"""Bytes to pixels: bitmaps, portable pixmaps and baseline JPEG; and back for the first two."""

from __future__ import annotations

import struct

import numpy as np

from veritile.functions.kernels import half_away, inverse_dct

MAX_SIDE, MAX_PIXELS = 20_000, 1 << 28


class DecodeError(ValueError):
    pass


def decode_bmp(data: bytes) -> np.ndarray:
    """(height, width, 3) of an uncompressed bitmap of 24 or 32 bits; alpha is dropped."""
    if len(data) < 54 or data[:2] != b"BM":
        raise DecodeError("no bitmap header")
    start, header, width, height, _, depth, packing = struct.unpack_from("<IIiiHHI", data, 10)
    if depth not in (24, 32) or packing or header < 40:
        raise DecodeError("only uncompressed bitmaps of 24 or 32 bits are read")
    rows = abs(height)
    if not (0 < width <= MAX_SIDE and 0 < rows <= MAX_SIDE):
        raise DecodeError("the size is out of range")
    step, each = (width * depth // 8 + 3) // 4 * 4, depth // 8
    if start + step * rows > len(data):
        raise DecodeError("the pixels are cut off")
    lines = np.frombuffer(data, np.uint8, step * rows, start).reshape(rows, step)[:, : width * each].reshape(rows, width, each)
    return np.ascontiguousarray((lines if height < 0 else lines[::-1])[..., 2::-1])


def encode_bmp(pixels: np.ndarray) -> bytes:
    h, w = pixels.shape[:2]
    rgb = pixels[..., :3] if pixels.shape[2] >= 3 else np.repeat(pixels[..., :1], 3, 2)
    lines = np.zeros((h, (w * 3 + 3) // 4 * 4), np.uint8)
    lines[:, : w * 3] = rgb[::-1, :, ::-1].reshape(h, w * 3)
    return b"BM" + struct.pack("<IHHI", 54 + lines.size, 0, 0, 54) + struct.pack("<IiiHHIIiiII", 40, w, h, 1, 24, 0, lines.size, 2835, 2835, 0, 0) + lines.tobytes()


def decode_pnm(data: bytes) -> np.ndarray:
    """(height, width, 3 or 1) of a binary pixmap or graymap of 8 bits; values are kept as they are."""
    if data[:2] not in (b"P5", b"P6"):
        raise DecodeError("no pixmap header")
    numbers, at = [], 2
    while len(numbers) < 3:
        while at < len(data) and (data[at : at + 1].isspace() or data[at : at + 1] == b"#"):
            at = (data.find(b"\n", at) + 1 or len(data)) if data[at : at + 1] == b"#" else at + 1
        end = at
        while end < len(data) and data[end : end + 1].isdigit():
            end += 1
        if end == at or end - at > 7:
            raise DecodeError("the header can not be read")
        numbers.append(int(data[at:end]))
        at = end
    width, height, most = numbers
    channels = 3 if data[:2] == b"P6" else 1
    if not (0 < width <= MAX_SIDE and 0 < height <= MAX_SIDE and 1 <= most <= 255):
        raise DecodeError("the size or depth is out of range")
    n = width * height * channels
    if at + 1 + n > len(data):
        raise DecodeError("the pixels are cut off")
    return np.frombuffer(data, np.uint8, n, at + 1).reshape(height, width, channels)


def encode_pnm(pixels: np.ndarray) -> bytes:
    h, w, c = pixels.shape
    return f"P{5 if c == 1 else 6}\n{w} {h}\n255\n".encode() + np.ascontiguousarray(pixels if c == 1 else pixels[..., :3]).tobytes()


# JPEG ------------------------------------------------------------------------------------------------------------------

#: Row and column of the coefficients in the order they are stored.
ZIGZAG = np.array(sorted(range(64), key=lambda k: (k // 8 + k % 8, k // 8 if (k // 8 + k % 8) % 2 else k % 8)))


#: Bytes of entropy-coded data that are looked up at once, and bytes that the longest block may take.
PART, LONGEST = 1 << 18, 512
#: What stands for 16 zeros and for the end of a block among the steps through a block.
ZEROS, END = 48, 64


class Huffman:
    """Codes of up to 16 bits: for each 16 bits that may come, the length of the code they begin with (0: none) and its symbol."""

    def __init__(self, counts: bytes, symbols: bytes):
        self.length, self.symbol = np.zeros(1 << 16, np.uint8), np.zeros(1 << 16, np.uint8)
        code, at = 0, 0
        for length, n in enumerate(counts, 1):
            if code + n > 1 << length:
                raise DecodeError("a code table is over-full")
            for s in symbols[at : at + n]:
                these = slice(code << (16 - length), (code + 1) << (16 - length))
                self.length[these], self.symbol[these] = length, s
                code += 1
            at += n
            code <<= 1
        n, size = self.length.astype(int), self.symbol & 15
        #: Bits that a code and its value take (0: no code), for means and for other coefficients, and how far the latter lead in the block.
        self.mean_step = np.where((n > 0) & (self.symbol <= 15), n + self.symbol, 0).astype(np.uint8)
        self.step = np.where(n > 0, n + size, 0).astype(np.uint8)
        self.far = np.where(size > 0, (self.symbol >> 4) + 1, np.where(self.symbol == 0xF0, ZEROS, END)).astype(np.uint8)


class _Window:
    """16 bits from every bit of a stretch of data on, and what codes begin there."""

    def __init__(self, data: bytes):
        a = np.frombuffer(data + bytes(LONGEST + 3), np.uint8).astype(np.uint32)
        wide = a[:-2] << 16 | a[1:-1] << 8 | a[2:]
        self.bits = ((wide[:, None] >> np.arange(8, 0, -1, np.uint32)) & 0xFFFF).astype(np.uint16).ravel()

    def values(self, codes: Huffman, at: list[int]) -> np.ndarray:
        """The signed values of the codes at these bits."""
        at = np.array(at, np.int64)
        begin = self.bits[at]
        size = (codes.symbol[begin] & 15).astype(np.int32)
        v = self.bits[at + codes.length[begin]].astype(np.int32) >> (16 - size)
        return np.where((v << 1) >> size > 0, v, v - (1 << size) + 1) * (size > 0)


def _read_blocks(data: bytes, total: int, order: list[int], codes: list[tuple[Huffman, Huffman]], kept: int, whole: bool) -> list[tuple]:
    """For each component: differences of the means, and (block, place, value) of the other coefficients if ``whole``.

    ``order``: the components of the blocks of a unit.  Only the first ``kept`` components are returned; the others are
    passed over, as the codes of all of them stand in one row.
    """
    data = data.replace(b"\xff\x00", b"\xff")
    dc_at: list[list[int]] = [[] for _ in codes]
    ac_at: list[list[int]] = [[] for _ in codes]
    ac_to: list[list[int]] = [[] for _ in codes]
    numbers = [0] * len(codes)
    parts: list[list[tuple]] = [[] for _ in codes]
    lo = pos = done = 0
    while done < total:
        window = _Window(data[lo : lo + PART + LONGEST])
        made = {id(t): t[window.bits].tobytes() for d, a in codes for t in (d.mean_step, a.step, a.far)}
        means = [made[id(d.mean_step)] for d, _ in codes]
        steps = [(made[id(a.step)], made[id(a.far)]) for _, a in codes]
        last = lo + PART >= len(data)
        limit, end = (1 << 62) if last else 8 * PART, 8 * (len(data) - lo)
        while done < total and pos < limit:
            c = order[done % len(order)]
            n = means[c][pos]
            if not n:
                raise DecodeError("an unknown code")
            dc_at[c].append(pos)
            pos += n
            step, far = steps[c]
            at, base = 1, 64 * numbers[c]
            found, to = ac_at[c], ac_to[c]
            while at < 64:
                n = step[pos]
                if not n:
                    raise DecodeError("an unknown code" if pos < end else "the scan is cut off")
                j = far[pos]
                if j <= 16:
                    at += j
                    if at > 64:
                        raise DecodeError("a block is over-full")
                    if whole:
                        found.append(pos)
                        to.append(base + at - 1)
                elif j == END:
                    pos += n
                    break
                else:
                    at += 16
                pos += n
            if pos > end:
                raise DecodeError("the scan is cut off")
            numbers[c] += 1
            done += 1
        for c in range(kept):
            parts[c].append((window.values(codes[c][0], dc_at[c]), np.array(ac_to[c], np.int64), window.values(codes[c][1], ac_at[c])))
        for lists in (dc_at, ac_at, ac_to):
            for x in lists:
                x.clear()
        lo, pos = lo + (pos >> 3), pos & 7
    return [tuple(np.concatenate(x) for x in zip(*p)) for p in parts[:kept]]


def jpeg_header(data: bytes) -> dict:
    """Tables, frame, restart interval, color transform and scan of a baseline file with one scan."""
    if data[:2] != b"\xff\xd8":
        raise DecodeError("no start of image")
    out: dict = {"quant": {}, "dc": {}, "ac": {}, "restart": 0, "adobe": None, "frame": None}
    at = 2
    while at + 4 <= len(data):
        if data[at] != 0xFF:
            raise DecodeError("a marker is missing")
        marker = data[at + 1]
        if marker == 0xFF:
            at += 1
            continue
        size = int.from_bytes(data[at + 2 : at + 4], "big")
        body = data[at + 4 : at + 2 + size]
        if size < 2 or len(body) != size - 2:
            raise DecodeError("a segment is cut off")
        at += 2 + size
        if marker == 0xDB:
            while body:
                wide, name = body[0] >> 4, body[0] & 15
                n = 128 if wide else 64
                if len(body) < 1 + n:
                    raise DecodeError("a quantization table is cut off")
                table = np.zeros(64)
                table[ZIGZAG] = np.frombuffer(body[1 : 1 + n], ">u2" if wide else np.uint8)
                out["quant"][name], body = table, body[1 + n :]
        elif marker == 0xC4:
            while body:
                if len(body) < 17 or len(body) < 17 + sum(body[1:17]):
                    raise DecodeError("a code table is cut off")
                n = sum(body[1:17])
                out["ac" if body[0] >> 4 else "dc"][body[0] & 15] = Huffman(body[1:17], body[17 : 17 + n])
                body = body[17 + n :]
        elif marker in (0xC0, 0xC1):
            if len(body) < 6 or body[0] != 8 or body[5] not in (1, 3) or len(body) < 6 + 3 * body[5]:
                raise DecodeError("the frame can not be read")
            h, w = struct.unpack(">HH", body[1:5])
            parts = [(body[k], body[k + 1] >> 4, body[k + 1] & 15, body[k + 2]) for k in range(6, 6 + 3 * body[5], 3)]
            if not (h and w and h * w <= MAX_PIXELS and all(1 <= x <= 4 for p in parts for x in p[1:3])):
                raise DecodeError("the frame is out of range")
            out["frame"] = (w, h, parts)
        elif 0xC2 <= marker <= 0xCF and marker not in (0xC8, 0xCC):
            raise DecodeError("only baseline coding is read")
        elif marker == 0xDD:
            out["restart"] = int.from_bytes(body[:2], "big")
        elif marker == 0xEE and body[:5] == b"Adobe" and len(body) >= 12:
            out["adobe"] = body[11]
        elif marker == 0xDA:
            if not out["frame"] or body[0] != len(out["frame"][2]):
                raise DecodeError("only files with one scan are read")
            out["scan"] = {body[1 + 2 * k]: (body[2 + 2 * k] >> 4, body[2 + 2 * k] & 15) for k in range(body[0])}
            out["data"] = data[at:]
            return out
        elif marker == 0xD9:
            break
    raise DecodeError("there is no scan")


def jpeg_size(data: bytes) -> tuple[int, int]:
    """(width, height) from the header alone."""
    return jpeg_header(data)["frame"][:2]


def _stretches(data: bytes) -> list[bytes]:
    """The entropy-coded data between restart markers, up to the next other marker."""
    out, start, at = [], 0, 0
    while True:
        at = data.find(b"\xff", at)
        if at < 0 or at + 1 >= len(data):
            return [*out, data[start:]]
        if data[at + 1] == 0:
            at += 2
        elif 0xD0 <= data[at + 1] <= 0xD7:
            out.append(data[start:at])
            start = at = at + 2
        elif data[at + 1] == 0xFF:
            at += 1
        else:
            return [*out, data[start:at]]


def decode_jpeg(data: bytes, eighth: bool = False, gray: bool = False) -> np.ndarray:
    """(height, width, 1 or 3); ``eighth``: one pixel for each block, from its mean; ``gray``: luma only."""
    head = jpeg_header(data)
    width, height, parts = head["frame"]
    most_h, most_v = max(p[1] for p in parts), max(p[2] for p in parts)
    cols, rows = -(-width // (8 * most_h)), -(-height // (8 * most_v))
    if len(parts) == 1:  # a lone component is not interleaved
        parts = [(parts[0][0], 1, 1, parts[0][3])]
        most_h = most_v = 1
        cols, rows = -(-width // 8), -(-height // 8)
    try:
        codes = [(head["dc"][head["scan"][c][0]], head["ac"][head["scan"][c][1]], head["quant"][q]) for c, _, _, q in parts]
    except KeyError:
        raise DecodeError("a table is missing") from None
    kept = 1 if gray else len(parts)
    order = [k for k, (_, h, v, _) in enumerate(parts) for _ in range(h * v)]
    # Blocks of a component in the order of the scan: unit, then row and column in the unit.
    scanned = [np.zeros((rows * cols * h * v, 1 if eighth else 64)) for _, h, v, _ in parts[:kept]]
    stretches, units, unit = iter(_stretches(head["data"])), rows * cols, 0
    while unit < units:
        n = min(head["restart"] or units, units - unit)
        found = _read_blocks(next(stretches, b""), n * len(order), order, [c[:2] for c in codes], kept, not eighth)
        for k, (mean, to, value) in enumerate(found):
            each = parts[k][1] * parts[k][2]
            part = scanned[k][unit * each : (unit + n) * each]
            part[:, 0] = np.cumsum(mean)
            if not eighth:
                part[to // 64, ZIGZAG[to % 64]] = value
        unit += n
    blocks = [x.reshape(rows, cols, v, h, -1).transpose(0, 2, 1, 3, 4).reshape(rows * v, cols * h, -1) for x, (_, h, v, _) in zip(scanned, parts)]
    planes = []
    ow, oh = (-(-width // 8), -(-height // 8)) if eighth else (width, height)
    for k, (_, h, v, _) in enumerate(parts[:1] if gray else parts):
        c = blocks[k] * (codes[k][2][:1] if eighth else codes[k][2])
        if eighth:
            plane = c[..., 0] / 8 + 128
        else:
            plane = (inverse_dct(c.reshape(-1, 8, 8)).reshape(*c.shape[:2], 8, 8) + 128).transpose(0, 2, 1, 3).reshape(c.shape[0] * 8, -1)
        plane = np.clip(half_away(plane), 0, 255)
        yy, xx = np.arange(oh) * v // most_v, np.arange(ow) * h // most_h
        planes.append(plane[np.ix_(yy, xx)])
    if len(planes) == 1:
        return planes[0][..., None].astype(np.uint8)
    y, cb, cr = planes
    if head["adobe"] == 0:
        rgb = planes
    else:
        rgb = [y + 1.402 * (cr - 128), y - 0.344136 * (cb - 128) - 0.714136 * (cr - 128), y + 1.772 * (cb - 128)]
    return np.stack([np.clip(half_away(p), 0, 255) for p in rgb], -1).astype(np.uint8)


#: Decoders by format; a format without one gives no pixels.  A JPEG file is decoded only for its thumbnail check.
DECODERS = {"bmp": decode_bmp, "ppm": decode_pnm, "pgm": decode_pnm}


def optional_codec(fmt: str):
    """A decoder for heif or webp where an imaging library is installed, else the reason why there is none."""
    try:
        from PIL import Image  # optional
    except ImportError:
        return None, f"{fmt} needs an imaging library that is not installed"

    def run(data: bytes) -> np.ndarray:
        import io

        return np.asarray(Image.open(io.BytesIO(data)).convert("RGB"))

    return run, "available"


def encode_optional(pixels: np.ndarray, fmt: str, quality: int | None = None, exif: bytes | None = None) -> bytes:
    """webp or heif bytes, where an imaging library is installed."""
    try:
        from PIL import Image  # optional
    except ImportError:
        raise DecodeError(f"{fmt} needs an imaging library that is not installed") from None
    import io

    out = io.BytesIO()
    options = {k: v for k, v in (("quality", quality), ("exif", exif)) if v is not None}
    Image.fromarray(pixels[..., :3] if pixels.shape[2] >= 3 else pixels[..., 0]).save(out, fmt, **options)
    return out.getvalue()
