"""Tile codecs of the convention: Rice, gzip, byte-shuffled gzip, PLIO, H-compress and none.

``encode(values, name)`` and ``decode(data, name, count, size)`` work on one tile of integers; arithmetic is 64-bit.
"""

from __future__ import annotations

import gzip
import zlib

import numpy as np

#: Rice parameters by bytes of a pixel: bits of a block's parameter, and its largest value.
RICE = {1: (3, 6), 2: (4, 14), 4: (5, 25), 8: (6, 57)}
DTYPES = {1: ">u1", 2: ">i2", 4: ">i4", 8: ">i8"}


class _BitReader:
    def __init__(self, data: bytes):
        self.bits = np.unpackbits(np.frombuffer(data, np.uint8))
        self.ones = np.flatnonzero(self.bits)
        self.at = 0

    def take(self, n: int) -> int:
        if self.at + n > len(self.bits):
            raise ValueError("the tile ends early")
        out = 0
        for b in self.bits[self.at : self.at + n].tolist():
            out = out << 1 | b
        self.at += n
        return out

    def rows(self, count: int, n: int) -> np.ndarray:
        """count numbers of n bits."""
        if self.at + count * n > len(self.bits):
            raise ValueError("the tile ends early")
        part = self.bits[self.at : self.at + count * n].reshape(count, n)
        self.at += count * n
        out = np.zeros(count, np.uint64)
        for k in range(n):
            out = out << np.uint64(1) | part[:, k].astype(np.uint64)
        return out

    def align(self) -> None:
        self.at = -(-self.at // 8) * 8


class _BitWriter:
    def __init__(self):
        self.parts: list[str] = []

    def put(self, value: int, n: int) -> None:
        if n:
            self.parts.append(format(value & ((1 << n) - 1), f"0{n}b"))

    def raw(self, text: str) -> None:
        self.parts.append(text)

    def bytes(self) -> bytes:
        text = "".join(self.parts)
        text += "0" * (-len(text) % 8)
        return int(text, 2).to_bytes(len(text) // 8, "big") if text else b""


# -- Rice ------------------------------------------------------------------------------------------------------------
def _wrap(values, size: int):
    """Signed numbers of so many bytes, as the coder's differences wrap."""
    half = 1 << (8 * size - 1)
    return [(v + half) % (2 * half) - half for v in values]


def rice_encode(values: np.ndarray, size: int, block: int = 32) -> bytes:
    """The first value as it is, then blocks of differences folded to non-negative numbers."""
    pbits, most = RICE[size]
    bits = 8 * size
    v = [int(x) for x in values]
    out = _BitWriter()
    out.put(v[0] if v else 0, bits)
    diffs = _wrap([b - a for a, b in zip([v[0], *v[:-1]], v)], size) if v else []
    for at in range(0, len(diffs), block):
        folded = [2 * d if d >= 0 else -2 * d - 1 for d in diffs[at : at + block]]
        total = sum(folded)
        mean = max(0, total - len(folded) // 2 - 1) // len(folded)
        k = max(mean >> 1, 0).bit_length()
        if k >= most:
            out.put(most + 1, pbits)
            for f in folded:
                out.put(f, bits)
        elif k == 0 and total == 0:
            out.put(0, pbits)
        else:
            out.put(k + 1, pbits)
            for f in folded:
                out.raw("0" * (f >> k) + "1")
                out.put(f, k)
    return out.bytes()


def _fields(raw: np.ndarray, at: np.ndarray, width: np.ndarray) -> np.ndarray:
    """The numbers of ``width`` bits (0 to 64 each) that begin at the bits ``at``; raw is padded by 16 bytes."""
    words = np.lib.stride_tricks.sliding_window_view(raw, 8)

    def short(start: np.ndarray, bits: np.ndarray) -> np.ndarray:  # up to 32 bits lie in the 8 bytes from the first one's
        window = np.ascontiguousarray(words[start >> 3]).view(">u8").ravel().astype(np.uint64)
        out = (window << (start & 7).astype(np.uint64)) >> (np.uint64(64) - np.maximum(bits, 1).astype(np.uint64))
        return np.where(bits > 0, out, np.uint64(0))

    upper = np.maximum(width - 32, 0)
    return short(at, upper) << np.uint64(32) | short(at + upper, width - upper)


def rice_decode(data: bytes, count: int, size: int, block: int = 32) -> np.ndarray:
    """One step a pixel finds where its code ends; everything else is done for all pixels at once."""
    pbits, most = RICE[size]
    bits = 8 * size
    raw = np.frombuffer(data + b"\0" * 16, np.uint8)
    end = 8 * len(data)
    ones = np.append(np.flatnonzero(np.unpackbits(raw[: len(data)])), end + 8 * 15)
    following = ones[np.searchsorted(ones, np.arange(end + 1))].tolist()  # the next one bit at or after each place
    first, at, have = int.from_bytes(data[:size].ljust(size, b"\0"), "big"), bits, 0
    coded, stops = [], []  # of each block: pixels, split (-1: all differences are zero), where its codes begin
    padded, mask = data + b"\0\0", (1 << pbits) - 1
    try:
        while have < count:
            n = min(block, count - have)
            have += n
            if at + pbits > end:
                raise ValueError("the tile ends early")
            byte = at >> 3
            k = ((padded[byte] << 8 | padded[byte + 1]) >> (16 - (at & 7) - pbits) & mask) - 1
            at += pbits
            coded.append((n, k, at))
            if k == most:
                at += bits * n
            elif k >= 0:
                step = k + 1
                for _ in range(n):
                    one = following[at]
                    stops.append(one)
                    at = one + step
    except IndexError:
        at = end + 1
    if at > end:
        raise ValueError("the tile ends early")
    if not coded:
        return np.zeros(0, np.int64)
    sizes, splits, starts = (np.array(c) for c in zip(*coded))
    split, begin = np.repeat(splits, sizes), np.repeat(starts, sizes)
    nth = np.arange(len(split)) - np.repeat(np.cumsum(sizes) - sizes, sizes)  # place in the block
    plain, zero = split == most, split < 0
    place, high = np.where(plain, begin + bits * nth, 0), np.zeros(len(split), np.int64)
    own, found = np.flatnonzero(~plain & ~zero), np.array(stops, np.int64)
    place[own] = found + 1
    before = np.concatenate([[0], found[:-1]]) + 1 + split[own]
    high[own] = found - np.where(nth[own] == 0, begin[own], before)
    width = np.where(plain, bits, np.where(zero, 0, split))
    folded = high.astype(np.uint64) << (width % 64).astype(np.uint64) | _fields(raw, place, width)
    steps = (folded >> np.uint64(1)) ^ (np.uint64(0) - (folded & np.uint64(1)))
    total = np.cumsum(steps) + np.uint64(first)  # all sums wrap
    left = np.uint64(64 - bits)
    return (total << left).view(np.int64) >> left.astype(np.int64)


# -- gzip ------------------------------------------------------------------------------------------------------------
def shuffle(data: bytes, size: int) -> bytes:
    """All first bytes of the elements, then all second ones, and so on."""
    return np.frombuffer(data, np.uint8).reshape(-1, size).T.tobytes()


def unshuffle(data: bytes, size: int) -> bytes:
    return np.frombuffer(data, np.uint8).reshape(size, -1).T.tobytes()


def inflate(data: bytes) -> bytes:
    """zlib or gzip, whichever the header says."""
    return zlib.decompressobj(wbits=47).decompress(data)


# -- PLIO ------------------------------------------------------------------------------------------------------------
def plio_encode(values: np.ndarray) -> bytes:
    """Run lengths of a mask as 16-bit words; the current value starts at 1 and moves by differences below 4096."""
    v = np.maximum(np.asarray(values, np.int64), 0)
    cuts = np.flatnonzero(np.diff(v)) + 1
    starts, ends = np.concatenate([[0], cuts]), np.concatenate([cuts, [len(v)]])
    words, current = [], 1
    for a, b in zip(starts.tolist(), ends.tolist()):
        value, left = int(v[a]) if len(v) else 0, b - a
        code = 4 if value else 0
        if value and value != current:
            d = value - current
            if abs(d) < 4096:
                words.append((2 if d > 0 else 3) << 12 | abs(d))
            else:
                words += [1 << 12 | value & 0xFFF, value >> 12]
            current = value
        while left > 0:
            words.append(code << 12 | min(left, 4095))
            left -= 4095
    size = 7 + len(words)
    head = [0, 7, -100, size & 0x7FFF, size >> 15, 0, 0]
    return np.array([*head, *[w - 65536 if w > 32767 else w for w in words]], ">i2").tobytes()


def plio_decode(data: bytes, count: int) -> np.ndarray:
    words = np.frombuffer(data, ">i2").astype(np.int64)
    if len(words) < 4:
        raise ValueError("the list has no header")
    if words[2] > 0:
        size, at = int(words[2]), 3
    else:
        size, at = int(words[4]) << 15 | int(words[3]) & 0x7FFF, int(words[1])
    out, x, current = np.zeros(count, np.int64), 0, 1
    stream = iter((words[at : min(size, len(words))] & 0xFFFF).tolist())
    for word in stream:
        if x >= count:
            break
        code, n = word >> 12, word & 0xFFF
        if code == 1:
            current = next(stream) << 12 | n
        elif code in (2, 3):
            current += n if code == 2 else -n
        elif code == 0:
            x += n
        elif code == 4:
            out[x : x + n] = current
            x += n
        elif code == 5:
            x += n
            if 0 < x <= count:
                out[x - 1] = current
        elif code in (6, 7):
            current += n if code == 6 else -n
            out[x] = current
            x += 1
        else:
            raise ValueError(f"unknown code {code}")
    return out


# -- H-compress ------------------------------------------------------------------------------------------------------
def _levels(nx: int, ny: int) -> int:
    return max(nx, ny, 1).__sub__(1).bit_length()


def _toward(x: np.ndarray, positive: int, negative: int, mask: int) -> np.ndarray:
    """Round to a multiple of the mask's step, with one offset for each sign."""
    return (x + np.where(x >= 0, positive, negative)) & mask


def h_transform(a: np.ndarray) -> np.ndarray:
    """Sums and differences of 2 x 2 blocks, again and again on the sums; odd borders pair up by doubling."""
    a = np.array(a, np.int64)
    nx, ny = a.shape
    shift, step = 0, 2
    for _ in range(_levels(*a.shape)):
        ex, ey = nx + nx % 2, ny + ny % 2
        b = np.zeros((ex, ey), np.int64)
        b[:nx, :ny] = a[:nx, :ny]
        p, q, r, s = b[::2, ::2], b[1::2, ::2], b[::2, 1::2], b[1::2, 1::2]  # next in x: q, next in y: r
        total, dx, dy, dc = p + q + r + s, q + s - p - r, r + s - p - q, s + p - q - r
        # a block at the border lacks a side: what is there counts double
        if ny % 2:
            total[:, -1], dx[:, -1] = 2 * (p + q)[:, -1], 2 * (q - p)[:, -1]
        if nx % 2:
            total[-1], dy[-1] = 2 * (p + r)[-1], 2 * (r - p)[-1]
            if ny % 2:
                total[-1, -1] = 4 * p[-1, -1]
        total, dx, dy, dc = total >> shift, dx >> shift, dy >> shift, dc >> shift
        half = step // 2
        total, dx, dy = _toward(total, step, step - 1, -2 * step), _toward(dx, half, 0, -step), _toward(dy, half, 0, -step)
        out = np.empty_like(a[:nx, :ny])
        mx, my = ex // 2, ey // 2
        out[:mx, :my] = total
        out[mx:, :my] = dx[: nx - mx]
        out[:mx, my:] = dy[:, : ny - my]
        out[mx:, my:] = dc[: nx - mx, : ny - my]
        a[:nx, :ny] = out
        nx, ny, shift, step = mx, my, 1, 2 * step
    return a


def h_inverse(a: np.ndarray) -> np.ndarray:
    a = np.array(a, np.int64)
    nx, ny = a.shape
    levels = _levels(nx, ny)
    if not levels:
        return a >> 0 if a.size == 0 else _toward(a, 0, 0, -1)
    sizes = [(nx, ny)]
    for _ in range(levels):
        x, y = sizes[-1]
        sizes.append(((x + 1) // 2, (y + 1) // 2))
    bit0 = 1 << (levels - 1)
    top = bit0 << 2
    a[0, 0] = _toward(a[0, 0], top >> 1, (top >> 1) - 1, -top)
    for k in range(levels - 1, -1, -1):
        nx, ny = sizes[k]
        mx, my = sizes[k + 1]
        bit1 = bit0 << 1
        p1, n1 = bit1 >> 1, (bit1 >> 1) - 1
        p0, n0 = bit0 >> 1, max((bit0 >> 1) - 1, 0)
        shift = 2 if k == 0 else 1
        wide = np.zeros((2 * mx, 2 * my), np.int64)
        total = a[:mx, :my].copy()
        dx, dy, dc = np.zeros_like(total), np.zeros_like(total), np.zeros_like(total)
        dx[: nx - mx], dy[:, : ny - my] = a[mx:nx, :my], a[:mx, my:ny]
        dc[: nx - mx, : ny - my] = a[mx:nx, my:ny]
        dx, dy, dc = _toward(dx, p1, n1, -bit1), _toward(dy, p1, n1, -bit1), _toward(dc, p0, n0, -bit0)
        both = np.ones_like(total, bool)
        only_x, only_y = np.zeros_like(both), np.zeros_like(both)
        if ny % 2:
            both[:, -1], only_x[:, -1] = False, True
        if nx % 2:
            only_y[-1] = ~only_x[-1]
            both[-1], only_x[-1] = False, False
        low0 = np.where(both, dc & bit0, 0)
        toward = lambda x: np.where(x >= 0, x - low0, x + low0)
        dx, dy = np.where(both, toward(dx), dx), np.where(both, toward(dy), dy)
        low1 = np.where(both, (dc ^ dx ^ dy) & bit1, np.where(only_x, dx & bit1, np.where(only_y, dy & bit1, 0)))
        fixed = np.where(total >= 0, total + low0 - low1, np.where(both, total + np.where(low0 == 0, low1, low0 - low1), total + low1))
        dx, dy, dc = np.where(both | only_x, dx, 0), np.where(both | only_y, dy, 0), np.where(both, dc, 0)
        # a block without a side keeps its sum doubled once less
        wide[1::2, 1::2], wide[1::2, ::2] = (fixed + dx + dy + dc) >> shift, (fixed + dx - dy - dc) >> shift
        wide[::2, 1::2], wide[::2, ::2] = (fixed - dx + dy - dc) >> shift, (fixed - dx - dy + dc) >> shift
        a[:nx, :ny] = wide[:nx, :ny]
        bit0 >>= 1
    return a


# The prefix code of the sixteen nibbles.
HUFFMAN = {0: "111110", 1: "000", 2: "001", 3: "1000", 4: "010", 5: "1001", 6: "11010", 7: "11011", 8: "011", 9: "11100", 10: "1010", 11: "11101", 12: "1011", 13: "11110", 14: "111111", 15: "1100"}
#: Six bits -> the nibble whose code they begin with, and the code's length.
_PREFIX = [next((v, len(c)) for v, c in HUFFMAN.items() if format(i, "06b").startswith(c)) for i in range(64)]


def _nibbles(plane: np.ndarray) -> np.ndarray:
    """2 x 2 blocks of bits as numbers: 8 4 over 2 1."""
    x, y = plane.shape
    p = np.zeros((x + x % 2, y + y % 2), np.int64)
    p[:x, :y] = plane
    return p[::2, ::2] << 3 | p[::2, 1::2] << 2 | p[1::2, ::2] << 1 | p[1::2, 1::2]


def _spread(codes: np.ndarray, shape: tuple[int, int]) -> np.ndarray:
    out = np.zeros((2 * codes.shape[0], 2 * codes.shape[1]), np.int64)
    out[::2, ::2], out[::2, 1::2], out[1::2, ::2], out[1::2, 1::2] = codes >> 3 & 1, codes >> 2 & 1, codes >> 1 & 1, codes & 1
    return out[: shape[0], : shape[1]]


def _tree_shapes(shape: tuple[int, int]) -> list[tuple[int, int]]:
    """Sizes of the nibble arrays, from the leaves to the root."""
    out = [((shape[0] + 1) // 2, (shape[1] + 1) // 2)]
    for _ in range(_levels(*shape) - 1):
        x, y = out[-1]
        out.append(((x + 1) // 2, (y + 1) // 2))
    return out


def _quadrants(shape: tuple[int, int]) -> list[tuple[slice, slice, int]]:
    mx, my = (shape[0] + 1) // 2, (shape[1] + 1) // 2
    return [(slice(0, mx), slice(0, my), 0), (slice(0, mx), slice(my, None), 1), (slice(mx, None), slice(0, my), 1), (slice(mx, None), slice(my, None), 2)]


def hcompress_encode(image: np.ndarray, scale: int = 0) -> bytes:
    """Header, bit planes of the four quadrants as quadtrees (or plain nibbles where those are shorter), signs."""
    a = h_transform(image)
    if scale > 1:
        a = np.where(a > 0, (a + scale // 2) // scale, -((-a + scale // 2) // scale))
    first = int(a.flat[0]) if a.size else 0
    a.flat[0] = 0
    head = b"\xdd\x99" + np.array([a.shape[0], a.shape[1], scale], ">i4").tobytes() + np.array([first], ">i8").tobytes()
    size = np.abs(a)
    planes = [0, 0, 0]
    for xs, ys, which in _quadrants(a.shape):
        if size[xs, ys].size:
            planes[which] = max(planes[which], int(size[xs, ys].max()).bit_length())
    bits = _BitWriter()
    for xs, ys, which in _quadrants(a.shape):
        part = size[xs, ys]
        for k in range(planes[which] - 1, -1, -1):
            if not part.size:
                bits.raw("0000")
                continue
            tree = [_nibbles(part >> k & 1)]
            for _ in range(_levels(*part.shape) - 1):
                tree.append(_nibbles((tree[-1] > 0).astype(np.int64)))
            code = [HUFFMAN[int(tree[-1][0, 0])]] if len(tree) else []
            for upper, lower in zip(tree[:0:-1], tree[-2::-1]):
                code += [HUFFMAN[v] for v in lower.ravel()[::-1].tolist() if v]
                del upper
            plain = 4 * tree[0].size
            text = "".join(code)
            if len(text) < plain:
                bits.raw("1111" + text)
            else:
                bits.raw("0000" + "".join(format(v, "04b") for v in tree[0].ravel().tolist()))
    bits.raw("0000")
    body = bits.bytes()
    signs = a[a != 0] < 0
    return head + bytes(planes) + body + np.packbits(signs).tobytes()


def hcompress_decode(data: bytes) -> np.ndarray:
    if data[:2] != b"\xdd\x99":
        raise ValueError("not an H-compressed tile")
    nx, ny, scale = (int(v) for v in np.frombuffer(data, ">i4", 3, 2))
    first = int(np.frombuffer(data, ">i8", 1, 14)[0])
    planes = data[22:25]
    a = np.zeros((nx, ny), np.int64)
    r = _BitReader(data[25:])

    padded = np.append(r.bits, np.zeros(6, np.uint8)).astype(np.int64)
    ahead = sum(padded[i : len(r.bits) + i] << (5 - i) for i in range(6)).tolist()  # the six bits from each place on

    def nibble() -> int:
        if r.at >= len(ahead):
            raise ValueError("the tile ends early")
        value, length = _PREFIX[ahead[r.at]]
        r.at += length
        return value

    for xs, ys, which in _quadrants(a.shape):
        part = a[xs, ys]
        for k in range(planes[which] - 1, -1, -1):
            mode = r.take(4)
            if not part.size:
                continue
            shapes = _tree_shapes(part.shape)
            if mode == 0:
                codes = r.rows(shapes[0][0] * shapes[0][1], 4).astype(np.int64).reshape(shapes[0])
            elif mode == 15:
                codes = np.array([[nibble()]])
                for shape in shapes[-2::-1]:
                    marks = _spread(codes, shape)
                    flat = marks.ravel()
                    for i in np.flatnonzero(flat)[::-1].tolist():
                        flat[i] = nibble()
                    codes = flat.reshape(shape)
            else:
                raise ValueError("bad bit plane")
            part |= _spread(codes, part.shape) << k
    if r.take(4):
        raise ValueError("the bit planes have no end")
    r.align()
    some = a != 0
    signs = r.bits[r.at : r.at + int(some.sum())].astype(bool)
    a[some] = np.where(signs, -a[some], a[some])
    a.flat[0] = first
    if scale > 1:
        a *= scale
    return h_inverse(a)


def encode_raw(values: np.ndarray, kind: str) -> bytes:
    """Any numbers losslessly by gzip."""
    return gzip.compress(np.ascontiguousarray(values).astype(kind).tobytes(), mtime=0)


# -- by name ---------------------------------------------------------------------------------------------------------
def encode(values: np.ndarray, name: str, size: int, shape: tuple[int, int] | None = None, block: int = 32) -> bytes:
    """One tile of integers (row-major)."""
    flat = np.ascontiguousarray(values).ravel()
    if name in ("RICE_1", "RICE_ONE"):
        return rice_encode(flat, size, block)
    if name == "PLIO_1":
        return plio_encode(flat)
    if name == "HCOMPRESS_1":
        return hcompress_encode(flat.reshape(shape or (1, -1)))
    raw = flat.astype(DTYPES[size]).tobytes()
    if name == "GZIP_1":
        return gzip.compress(raw, mtime=0)
    if name == "GZIP_2":
        return gzip.compress(shuffle(raw, size), mtime=0)
    if name == "NOCOMPRESS":
        return raw
    raise ValueError(f"unknown codec {name}")


def decode(data: bytes, name: str, count: int, size: int, block: int = 32) -> np.ndarray:
    if name in ("RICE_1", "RICE_ONE"):
        out = rice_decode(data, count, size, block)
        return out & 0xFF if size == 1 else out
    if name == "PLIO_1":
        return plio_decode(data, count)
    if name == "HCOMPRESS_1":
        return hcompress_decode(data).ravel()
    if name == "GZIP_1":
        data = inflate(data)
    elif name == "GZIP_2":
        data = unshuffle(inflate(data), size)
    elif name != "NOCOMPRESS":
        raise ValueError(f"unknown codec {name}")
    return np.frombuffer(data, DTYPES[size], count).astype(np.int64)
