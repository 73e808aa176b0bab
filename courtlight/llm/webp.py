"""Lossless WebP (VP8L): a decoder of the whole format and a vectorised writer of sample images.

The decoder reads prefix codes, back-references, colour cache and entropy images, and inverts the predictor,
cross-colour, subtract-green and palette transforms. Images of one group of codes and without a colour cache are
decoded many at a time: numpy takes one symbol of every stream in a step, and a stream is an image, or a row of one
where a chunk ROWS (which other readers skip) says where rows begin.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np

LENGTHS, DISTANCES, LONGEST = 24, 40, 15
#: Fixed value of the format: the order in which code length codes are stored.
LENGTH_ORDER = (17, 18, 0, 1, 2, 3, 4, 5, 16, 6, 7, 8, 9, 10, 11, 12, 13, 14, 15)
#: Fixed values of the format: the (x, y) neighbours that distance codes 1 to 120 name.
NEAR = (
    (0, 1), (1, 0), (1, 1), (-1, 1), (0, 2), (2, 0), (1, 2), (-1, 2), (2, 1), (-2, 1), (2, 2), (-2, 2), (0, 3), (3, 0), (1, 3), (-1, 3), (3, 1), (-3, 1), (2, 3), (-2, 3),
    (3, 2), (-3, 2), (0, 4), (4, 0), (1, 4), (-1, 4), (4, 1), (-4, 1), (3, 3), (-3, 3), (2, 4), (-2, 4), (4, 2), (-4, 2), (0, 5), (3, 4), (-3, 4), (4, 3), (-4, 3), (5, 0),
    (1, 5), (-1, 5), (5, 1), (-5, 1), (2, 5), (-2, 5), (5, 2), (-5, 2), (4, 4), (-4, 4), (3, 5), (-3, 5), (5, 3), (-5, 3), (0, 6), (6, 0), (1, 6), (-1, 6), (6, 1), (-6, 1),
    (2, 6), (-2, 6), (6, 2), (-6, 2), (4, 5), (-4, 5), (5, 4), (-5, 4), (3, 6), (-3, 6), (6, 3), (-6, 3), (0, 7), (7, 0), (1, 7), (-1, 7), (5, 5), (-5, 5), (7, 1), (-7, 1),
    (4, 6), (-4, 6), (6, 4), (-6, 4), (2, 7), (-2, 7), (7, 2), (-7, 2), (3, 7), (-3, 7), (7, 3), (-7, 3), (5, 6), (-5, 6), (6, 5), (-6, 5), (8, 0), (4, 7), (-4, 7), (7, 4),
    (-7, 4), (8, 1), (8, 2), (6, 6), (-6, 6), (8, 3), (5, 7), (-5, 7), (7, 5), (-7, 5), (8, 4), (6, 7), (-6, 7), (7, 6), (-7, 6), (8, 5), (7, 7), (-7, 7), (8, 6), (8, 7),
)
PREDICTOR, CROSS_COLOUR, SUBTRACT_GREEN, PALETTE = range(4)


class Bits:
    """Bits of bytes, the least significant first."""

    def __init__(self, data: bytes):
        self.data, self.at = data, 0

    def peek(self) -> int:
        """At least 24 bits from here on; zeros behind the end."""
        return int.from_bytes(self.data[self.at >> 3 : (self.at >> 3) + 4], "little") >> (self.at & 7)

    def read(self, n: int) -> int:
        value = self.peek() & ((1 << n) - 1)
        self.at += n
        return value


def _reversal(bits: int) -> np.ndarray:
    """Each number below 2 ** bits with its bits in reverse."""
    out = np.zeros(1, np.int64)
    for b in range(bits):
        out = np.concatenate([out * 2, out * 2 + 1]) if b else np.array([0, 1], np.int64)
    return out


_REVERSED = [np.zeros(1, np.int64)] + [_reversal(b) for b in range(1, LONGEST + 1)]


@dataclass
class Code:
    """A prefix code as a table: the next `bits` bits lead to symbol << 4 | length."""

    bits: int
    table: np.ndarray

    @classmethod
    def of(cls, lengths: np.ndarray) -> Code:
        used = np.nonzero(lengths)[0]
        if len(used) <= 1:
            return cls(0, np.array([(int(used[0]) if len(used) else 0) << 4], np.uint16))
        used = used[np.argsort(lengths[used], kind="stable")]
        own = lengths[used]
        bits = int(own[-1])
        table = np.repeat((used << 4 | own).astype(np.uint16), 1 << (bits - own))
        if len(table) != 1 << bits:
            raise ValueError("a prefix code is not complete")
        return cls(bits, table[_REVERSED[bits]])

    def read(self, b: Bits) -> int:
        entry = int(self.table[b.peek() & ((1 << self.bits) - 1)])
        b.at += entry & 15
        return entry >> 4


def _read_code(b: Bits, size: int) -> Code:
    lengths = np.zeros(max(size, 256), np.int64)
    if b.read(1):
        n, wide = b.read(1) + 1, b.read(1)
        symbol = b.read(8 if wide else 1)
        if n == 1:
            return Code(0, np.array([symbol << 4], np.uint16))
        lengths[[symbol, b.read(8)]] = 1
        return Code.of(lengths)
    of_lengths = np.zeros(19, np.int64)
    for i in range(b.read(4) + 4):
        of_lengths[LENGTH_ORDER[i]] = b.read(3)
    code = Code.of(of_lengths)
    left = b.read(2 * b.read(3) + 2) + 2 if b.read(1) else size
    if code.bits and left >= size and ((code.table & 15) == code.bits).all() and not (code.table >> 4 > 15).any():
        # lengths whose own codes are equally long, without repeats, are read at once
        raw = np.frombuffer(b.data[b.at >> 3 : (b.at + size * code.bits + 7) >> 3], np.uint8)
        each = np.unpackbits(raw, bitorder="little")[b.at & 7 :][: size * code.bits].reshape(size, code.bits)
        b.at += size * code.bits
        lengths[:size] = code.table[each @ (1 << np.arange(code.bits))] >> 4
        return Code.of(lengths)
    table, mask, data, pos = code.table.tolist(), (1 << code.bits) - 1, b.data, b.at
    found: list[int] = []
    last = 8
    while len(found) < size and left:
        left -= 1
        entry = table[int.from_bytes(data[pos >> 3 : (pos >> 3) + 4], "little") >> (pos & 7) & mask]
        pos += entry & 15
        symbol = entry >> 4
        if symbol < 16:
            found.append(symbol)
            last = symbol or last
            continue
        extra, least = ((2, 3), (3, 3), (7, 11))[symbol - 16]
        more = least + (int.from_bytes(data[pos >> 3 : (pos >> 3) + 4], "little") >> (pos & 7) & ((1 << extra) - 1))
        pos += extra
        found += [last if symbol == 16 else 0] * more
    b.at = pos
    if len(found) > size:
        raise ValueError("code lengths beyond the alphabet")
    lengths[: len(found)] = found
    return Code.of(lengths)


@dataclass
class Plan:
    """An entropy-coded image before its pixels: everything up to the first symbol."""

    width: int
    height: int
    cache_bits: int
    groups: list[list[Code]]
    group_bits: int = 0
    group_of: np.ndarray | None = None
    start: int = 0


def _read_plan(b: Bits, width: int, height: int, outer: bool) -> Plan:
    cache_bits = b.read(4) if b.read(1) else 0
    if cache_bits > 11:
        raise ValueError("the colour cache is too large")
    group_bits, group_of = 0, None
    if outer and b.read(1):
        group_bits = b.read(3) + 2
        inner = _read_image(b, (width + (1 << group_bits) - 1) >> group_bits, (height + (1 << group_bits) - 1) >> group_bits)
        group_of = (inner >> 8 & 0xFFFF).astype(np.int64)
    sizes = [256 + LENGTHS + (1 << cache_bits if cache_bits else 0), 256, 256, 256, DISTANCES]
    groups = [[_read_code(b, s) for s in sizes] for _ in range(int(group_of.max()) + 1 if group_of is not None else 1)]
    return Plan(width, height, cache_bits, groups, group_bits, group_of, b.at)


def _value(prefix: int, b: Bits) -> int:
    """A length or distance from its prefix symbol and extra bits."""
    if prefix < 4:
        return prefix + 1
    extra = (prefix - 2) >> 1
    return ((2 + (prefix & 1)) << extra) + b.read(extra) + 1


def _distance(code: int, width: int) -> int:
    if code > len(NEAR):
        return code - len(NEAR)
    x, y = NEAR[code - 1]
    return max(1, x + y * width)


def _read_pixels(b: Bits, plan: Plan) -> np.ndarray:
    """Pixels one by one, for whatever the plan has."""
    n, width = plan.width * plan.height, plan.width
    out: list[int] = []
    cache, shift, cached = [0] * (1 << plan.cache_bits), 32 - plan.cache_bits, 0
    while len(out) < n:
        at = len(out)
        group = plan.groups[int(plan.group_of[at // width >> plan.group_bits, at % width >> plan.group_bits]) if plan.group_of is not None else 0]
        symbol = group[0].read(b)
        if symbol < 256:
            red, blue, alpha = group[1].read(b), group[2].read(b), group[3].read(b)
            out.append(alpha << 24 | red << 16 | symbol << 8 | blue)
        elif symbol < 256 + LENGTHS:
            length = _value(symbol - 256, b)
            far = _distance(_value(group[4].read(b), b), width)
            if far > at or at + length > n:
                raise ValueError("a back-reference leaves the image")
            for i in range(at - far, at - far + length):
                out.append(out[i])
        else:
            while cached < at:
                cache[(0x1E35A7BD * out[cached] & 0xFFFFFFFF) >> shift] = out[cached]
                cached += 1
            out.append(cache[symbol - 256 - LENGTHS])
        if b.at > 8 * len(b.data):
            raise ValueError("the image is cut off")
    return np.array(out, np.uint32).reshape(plan.height, width)


def _read_image(b: Bits, width: int, height: int) -> np.ndarray:
    """An inner image: of transforms, palettes or groups."""
    return _read_pixels(b, _read_plan(b, width, height, False))


@dataclass
class Header:
    width: int
    height: int
    transforms: list[tuple] = field(default_factory=list)
    plan: Plan | None = None


def _read_header(b: Bits) -> Header:
    if b.read(8) != 0x2F:
        raise ValueError("not a lossless image")
    header = Header(b.read(14) + 1, b.read(14) + 1)
    b.read(1)
    if b.read(3):
        raise ValueError("unknown version")
    width = header.width
    while b.read(1):
        kind = b.read(2)
        if kind in (PREDICTOR, CROSS_COLOUR):
            bits = b.read(3) + 2
            blocks = lambda x: (x + (1 << bits) - 1) >> bits  # noqa: B023, E731
            header.transforms.append((kind, width, bits, _read_image(b, blocks(width), blocks(header.height))))
        elif kind == SUBTRACT_GREEN:
            header.transforms.append((kind, width))
        else:
            size = b.read(8) + 1
            channels = _channels(_read_image(b, size, 1)[0]).astype(np.int64)
            palette = _joined(np.cumsum(channels, axis=0) & 255)
            bits = 0 if size > 16 else 1 if size > 4 else 2 if size > 2 else 3
            header.transforms.append((kind, width, bits, palette))
            width = (width + (1 << bits) - 1) >> bits
    header.plan = _read_plan(b, width, header.height, True)
    return header


def _channels(argb: np.ndarray) -> np.ndarray:
    """... x (blue, green, red, alpha)."""
    return np.ascontiguousarray(argb, "<u4").view(np.uint8).reshape(*argb.shape, 4)


def _joined(channels: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(channels, np.uint8).view("<u4")[..., 0]


def _half(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return (a + b) >> 1


def _select(left: np.ndarray, top: np.ndarray, corner: np.ndarray) -> np.ndarray:
    """The neighbour nearer to left + top - corner, the top one in a tie."""
    to_left, to_top = np.abs(top - corner).sum(axis=-1, keepdims=True), np.abs(left - corner).sum(axis=-1, keepdims=True)
    return np.where(to_left < to_top, left, top)


_PREDICTIONS = {
    0: lambda l, t, tl, tr: np.broadcast_to(np.array([0, 0, 0, 255]), t.shape),
    1: lambda l, t, tl, tr: l,
    2: lambda l, t, tl, tr: t,
    3: lambda l, t, tl, tr: tr,
    4: lambda l, t, tl, tr: tl,
    5: lambda l, t, tl, tr: _half(_half(l, tr), t),
    6: lambda l, t, tl, tr: _half(l, tl),
    7: lambda l, t, tl, tr: _half(l, t),
    8: lambda l, t, tl, tr: _half(tl, t),
    9: lambda l, t, tl, tr: _half(t, tr),
    10: lambda l, t, tl, tr: _half(_half(l, tl), _half(t, tr)),
    11: lambda l, t, tl, tr: _select(l, t, tl),
    12: lambda l, t, tl, tr: np.clip(l + t - tl, 0, 255),
    13: lambda l, t, tl, tr: np.clip(_half(l, t) + np.fix((_half(l, t) - tl) / 2).astype(np.int64), 0, 255),
}
#: Predictions that look at the pixel to the left, which must be ready first.
_SERIAL = {1, 5, 6, 7, 10, 11, 12, 13}


def _unpredict(argb: np.ndarray, bits: int, blocks: np.ndarray) -> np.ndarray:
    out = _channels(argb).astype(np.int64)
    height, width = argb.shape
    modes = (blocks >> 8 & 15).astype(np.int64)
    out[0, 0] = (out[0, 0] + [0, 0, 0, 255]) & 255
    out[0] = np.cumsum(out[0], axis=0) & 255
    for y in range(1, height):
        row, above = out[y], out[y - 1]
        row[0] = (row[0] + above[0]) & 255
        for block in range(modes.shape[1]):
            a, b = max(1, block << bits), min(width, (block + 1) << bits)
            mode = int(modes[y >> bits, block])
            mode = 0 if mode > 13 else mode
            predict = _PREDICTIONS[mode]
            if a >= b:
                continue
            # right of the last pixel above stands this row's first one
            right = np.concatenate([above[a + 1 : b + 1], row[:1]]) if b == width else above[a + 1 : b + 1]
            if mode not in _SERIAL:
                row[a:b] = (row[a:b] + predict(None, above[a:b], above[a - 1 : b - 1], right)) & 255
            elif mode == 1:
                row[a:b] = (np.cumsum(row[a:b], axis=0) + row[a - 1]) & 255
            else:
                for x in range(a, b):
                    row[x] = (row[x] + predict(row[x - 1], above[x], above[x - 1], right[x - a])) & 255
    return _joined(out)


def _signed(x: np.ndarray) -> np.ndarray:
    return x.astype(np.int64) - ((x.astype(np.int64) & 128) << 1)


def _uncross(argb: np.ndarray, bits: int, blocks: np.ndarray) -> np.ndarray:
    out = _channels(argb).astype(np.int64)
    height, width = argb.shape
    own = _channels(blocks)[np.arange(height)[:, None] >> bits, np.arange(width)[None] >> bits]
    green = _signed(out[..., 1])
    red = (out[..., 2] + (_signed(own[..., 0]) * green >> 5)) & 255
    blue = (out[..., 0] + (_signed(own[..., 1]) * green >> 5) + (_signed(own[..., 2]) * _signed(red) >> 5)) & 255
    out[..., 2], out[..., 0] = red, blue
    return _joined(out)


def _unindex(argb: np.ndarray, width: int, bits: int, palette: np.ndarray) -> np.ndarray:
    index = (argb >> 8 & 255).astype(np.int64)
    each = 8 >> bits
    spread = (index[..., None] >> (each * np.arange(1 << bits))) & ((1 << each) - 1)
    spread = spread.reshape(len(index), -1)[:, :width]
    return np.append(palette, np.zeros(256, np.uint32)).astype(np.uint32)[spread]


def _invert(header: Header, argb: np.ndarray) -> np.ndarray:
    for kind, width, *rest in reversed(header.transforms):
        if kind == PREDICTOR:
            argb = _unpredict(argb, *rest)
        elif kind == CROSS_COLOUR:
            argb = _uncross(argb, *rest)
        elif kind == SUBTRACT_GREEN:
            green = argb >> 8 & 0xFF
            argb = argb & 0xFF00FF00 | (((argb & 0xFF00FF) + (green << 16 | green)) & 0xFF00FF)
        else:
            argb = _unindex(argb, width, *rest)
    return argb


def _chunks(media: bytes):
    """(VP8L data, row lengths or none) of each file in media; files may stand one behind another."""
    at = 0
    while at < len(media):
        if media[at : at + 4] != b"RIFF" or media[at + 8 : at + 12] != b"WEBP":
            raise ValueError("not a WebP file")
        end = at + 8 + int.from_bytes(media[at + 4 : at + 8], "little")
        at += 12
        image, rows = None, None
        while at + 8 <= end:
            size = int.from_bytes(media[at + 4 : at + 8], "little")
            body = media[at + 8 : at + 8 + size]
            if media[at : at + 4] == b"VP8L":
                image = body
            elif media[at : at + 4] == b"ROWS":
                rows = np.frombuffer(body, "<u2").astype(np.int64)
            at += 8 + size + (size & 1)
        if image is None:
            raise ValueError("a file without a lossless image")
        at = end + (end & 1)
        yield image, rows


def decode_many(medias: list[bytes]) -> list[list[np.ndarray]]:
    """The images (rows x columns of alpha-red-green-blue numbers) of each media."""
    out: list[list[np.ndarray | None]] = [[] for _ in medias]
    stepped = []
    for m, media in enumerate(medias):
        for data, rows in _chunks(media):
            b = Bits(data)
            header = _read_header(b)
            if header.plan.cache_bits or header.plan.group_of is not None:
                out[m].append(_invert(header, _read_pixels(b, header.plan)))
            else:
                stepped.append((m, len(out[m]), data, rows, header))
                out[m].append(None)
    for (m, i, _, _, header), argb in zip(stepped, _step(stepped), strict=True):
        out[m][i] = _invert(header, argb)
    return out


def _step(images: list[tuple]) -> list[np.ndarray]:
    """Pixels of many images: in every step each stream reads one symbol."""
    if not images:
        return []
    joined = np.frombuffer(b"".join([x[2] for x in images]) + bytes(8), np.uint8).astype(np.uint32)
    ahead = joined[:-3] | joined[1:-2] << 8 | joined[2:-1] << 16 | joined[3:] << 24
    pixels = np.array([x[4].plan.width * x[4].plan.height for x in images])
    first = np.concatenate([[0], np.cumsum(pixels)])
    begins = np.concatenate([[0], np.cumsum([len(x[2]) for x in images])]) * 8
    ends = begins[1:]
    codes = [x[4].plan.groups[0] for x in images]
    tables, places = [], []
    for c in range(5):
        offsets = np.concatenate([[0], np.cumsum([len(g[c].table) for g in codes])])
        tables.append(np.concatenate([g[c].table for g in codes]))
        places.append((offsets[:-1], np.array([(1 << g[c].bits) - 1 for g in codes])))
    constant = [all(g[c].bits == 0 for g in codes) for c in range(5)]
    image, pos, at, end = [], [], [], []
    for k, (_, _, _, rows, header) in enumerate(images):
        plan = header.plan
        if rows is not None and len(rows) == plan.height:
            starts = begins[k] + plan.start + np.concatenate([[0], np.cumsum(rows[:-1])])
            own = first[k] + plan.width * np.arange(plan.height + 1)
        else:
            starts, own = np.array([begins[k] + plan.start]), first[k : k + 2]
        image.append(np.full(len(starts), k))
        pos.append(starts)
        at.append(own[:-1])
        end.append(own[1:])
    image, pos, at, end = map(np.concatenate, (image, pos, at, end))
    planes = [np.zeros(first[-1], np.uint8) for _ in range(4)]
    copies = []

    def symbol(c: int, who: np.ndarray, where: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        entry = tables[c][places[c][0][who] + (ahead[where >> 3] >> (where & 7).astype(np.uint32) & places[c][1][who])]
        return entry >> 4, entry & 15

    def extra(prefix: np.ndarray, where: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        n = np.maximum(0, (prefix - 2) >> 1)
        # up to 18 extra bits: with the 7 of the place still within 32
        value = (ahead[where >> 3] >> (where & 7).astype(np.uint32)).astype(np.int64) & ((1 << n) - 1)
        return np.where(prefix < 4, prefix + 1, ((2 + (prefix & 1)) << n) + value + 1), where + n

    while len(at):
        green, n = symbol(0, image, pos)
        pos = pos + n
        plain = green < 256
        if plain.all():
            planes[1][at] = green
            for plane, c in ((2, 1), (0, 2), (3, 3)):
                if not constant[c]:
                    value, n = symbol(c, image, pos)
                    pos = pos + n
                    planes[plane][at] = value
            at = at + 1
        else:
            planes[1][at[plain]] = green[plain]
            for plane, c in ((2, 1), (0, 2), (3, 3)):
                if not constant[c]:
                    value, n = symbol(c, image[plain], pos[plain])
                    pos[plain] += n
                    planes[plane][at[plain]] = value
            far = ~plain
            length, where = extra(green[far].astype(np.int64) - 256, pos[far])
            prefix, n = symbol(4, image[far], where)
            code, where = extra(prefix.astype(np.int64), where + n)
            copies.append((at[far], length, code, image[far]))
            pos[far] = where
            at = at + 1
            at[far] += length - 1
        open_ = at < end
        if (at > end).any() or (pos > ends[image]).any():
            raise ValueError("the image is cut off or a row is too long")
        if not open_.all():
            image, pos, at, end = image[open_], pos[open_], at[open_], end[open_]
    for plane, c in ((2, 1), (0, 2), (3, 3)):
        if constant[c]:
            planes[plane] = np.repeat(np.array([g[c].table[0] >> 4 for g in codes], np.uint8), pixels)
    argb = planes[3].astype(np.uint32) << 24 | planes[2].astype(np.uint32) << 16 | planes[1].astype(np.uint32) << 8 | planes[0]
    if copies:
        to, length, code, who = (np.concatenate(x) for x in zip(*copies, strict=True))
        for i in np.argsort(to, kind="stable"):
            a, n, k = int(to[i]), int(length[i]), int(who[i])
            far = _distance(int(code[i]), images[k][4].plan.width)
            if a - far < first[k]:
                raise ValueError("a back-reference leaves the image")
            source = argb[a - far : a - far + min(n, far)]
            argb[a : a + n] = np.resize(source, n) if n > far else source
    return [argb[first[k] : first[k + 1]].reshape(x[4].plan.height, x[4].plan.width) for k, x in enumerate(images)]


def complete_lengths(counts: np.ndarray) -> np.ndarray:
    """Code lengths of complete prefix codes (rows of counts): Shannon's, shortened until nothing is left over.

    Counts are lifted to 1/8192 of their row's sum, so that no length is above 14. A row of one symbol gets a second.
    """
    counts = counts.astype(np.int64)
    few = (counts > 0).sum(axis=1) < 2
    spare = np.where(counts[:, 0] > 0, 1, 0)
    counts[few, spare[few]] += 1
    counts[few & (counts[:, 0] == 0), 0] += 1
    used = counts > 0
    lifted = np.where(used, counts + -(-counts.sum(axis=1, keepdims=True) // 8192), 0)
    share = lifted / lifted.sum(axis=1, keepdims=True)
    lengths = np.where(used, np.maximum(1, np.ceil(-np.log2(np.where(used, share, 1.0)) - 1e-12)), 0).astype(np.int64)
    left = (1 << 15) - np.where(used, 1 << (15 - lengths), 0).sum(axis=1)
    while (left > 0).any():
        for n in range(2, 16):
            here = lengths == n
            take = np.minimum(here.sum(axis=1), left >> (15 - n))
            if take.any():
                lengths -= here & (np.cumsum(here, axis=1) <= take[:, None])
                left -= take << (15 - n)
    return lengths


def canonical(lengths: np.ndarray) -> np.ndarray:
    """The codes of rows of lengths, as written: first bit lowest."""
    codes, base = np.zeros_like(lengths), np.zeros(len(lengths), np.int64)
    for n in range(1, LONGEST + 1):
        here = lengths == n
        rank = np.cumsum(here, axis=1) - 1
        codes = np.where(here, _REVERSED[n][np.where(here, base[:, None] + rank, 0)], codes)
        base = (base + here.sum(axis=1)) << 1
    return codes


#: Samples a row of the writer's images, rows an image at most, and the shortest run it writes as a back-reference.
WIDTH, ROWS, SHORTEST = 192, 4096, 4


def _fixed(value: int, n: int) -> list[int]:
    return [value >> i & 1 for i in range(n)]


def _length_symbol(n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Prefix symbol, extra bits and their number of lengths."""
    v = np.maximum(n - 1, 1)
    high = np.floor(np.log2(v)).astype(np.int64)
    second = v >> np.maximum(high - 1, 0) & 1
    small = n <= 4
    bits = np.where(small, 0, high - 1)
    return np.where(small, n - 1, 2 * high + second), v & ((1 << bits) - 1), bits


def encode_many(payloads: list[bytes]) -> list[bytes]:
    """A media of each payload, a multiple of WIDTH bytes: grey samples, one a byte, row by row.

    Grey takes a subtract-green transform and one real prefix code a file. A last run of spaces is a back-reference to
    the sample on the left. Payloads of more than ROWS rows make several files, one behind another.
    """
    strips, owner = [], []
    for k, p in enumerate(payloads):
        for a in range(0, len(p), WIDTH * ROWS):
            strips.append(p[a : a + WIDTH * ROWS])
            owner.append(k)
    files = _encode_strips(strips)
    out: list[list[bytes]] = [[] for _ in payloads]
    for k, f in zip(owner, files, strict=True):
        out[k].append(f)
    return [b"".join(x) for x in out]


def _encode_strips(strips: list[bytes]) -> list[bytes]:
    if not strips:
        return []
    sizes = np.array([len(s) for s in strips])
    heights = sizes // WIDTH
    run = np.array([min(WIDTH, len(s) - len(s[-WIDTH:].rstrip(b" ")) - (len(s) - len(s[-WIDTH:]))) for s in strips]) - 1
    run = np.where(run >= SHORTEST, run, 0)
    samples = np.frombuffer(b"".join(strips), np.uint8).astype(np.int64)
    last = np.cumsum(sizes)
    keep = np.ones(len(samples) + 1, np.int8)
    # where a run begins a token stays for it; the others of the run go
    cut = np.nonzero(run)[0]
    edges = np.zeros(len(samples) + 1, np.int64)
    np.add.at(edges, last[cut] - run[cut] + 1, 1)
    np.add.at(edges, last[cut], -1)
    keep = np.cumsum(edges)[:-1] == 0
    symbol = samples.copy()
    extra, extra_bits = np.zeros(len(samples), np.int64), np.zeros(len(samples), np.int64)
    prefix, value, bits = _length_symbol(run[cut])
    symbol[last[cut] - run[cut]], extra[last[cut] - run[cut]], extra_bits[last[cut] - run[cut]] = 256 + prefix, value, bits
    image = np.repeat(np.arange(len(strips)), sizes)[keep]
    row = (np.arange(len(samples)) // WIDTH)[keep]
    symbol, extra, extra_bits = symbol[keep], extra[keep], extra_bits[keep]
    alphabet = 256 + LENGTHS
    lengths = complete_lengths(np.bincount(image * alphabet + symbol, minlength=len(strips) * alphabet).reshape(-1, alphabet))
    codes = canonical(lengths)
    own = image * alphabet + symbol
    n = lengths.ravel()[own]
    value = codes.ravel()[own] | extra << n
    n = n + extra_bits

    fixed = [_fixed(0x2F, 8), _fixed(WIDTH - 1, 14), None, _fixed(0, 4), [1], _fixed(SUBTRACT_GREEN, 2), [0], [0], [0]]
    # code lengths 0 to 15 have codes of four bits each
    fixed += [[0], _fixed(15, 4), *[_fixed(4 if x < 16 else 0, 3) for x in LENGTH_ORDER], [0], None]
    # red, blue: 0; alpha: 255; distance symbol 1: the pixel on the left
    fixed += [_fixed(1, 4), _fixed(1, 4), [1, 0, 1], _fixed(255, 8), [1, 0, 0, 1]]
    tall = (heights[:, None] - 1) >> np.arange(14) & 1
    listed = (_REVERSED[4][lengths][:, :, None] >> np.arange(4) & 1).reshape(len(strips), -1)
    varying = iter((tall, listed))
    head = np.concatenate([np.broadcast_to(np.array(x), (len(strips), len(x))) if x is not None else next(varying) for x in fixed], axis=1).astype(np.uint8)
    head_bits = head.shape[1]

    in_image = np.bincount(image, n, len(strips)).astype(np.int64)
    room = -(-(head_bits + in_image) // 32)
    word_start = np.concatenate([[0], np.cumsum(room)])
    ends = np.cumsum(n)
    first = np.concatenate([[0], np.cumsum(in_image)[:-1]])
    pos = ends - n - np.repeat(first, np.bincount(image, minlength=len(strips))) + head_bits + 32 * word_start[image]
    # bits of a word don't overlap, so sums of doubles (below 2 ** 53) join them
    words = np.bincount(pos >> 5, (value << (pos & 31)).astype(np.float64), int(word_start[-1]) + 1).astype(np.uint64)
    low = (words & np.uint64(0xFFFFFFFF)).astype(np.uint32)
    low[1:] |= (words[:-1] >> np.uint64(32)).astype(np.uint32)
    body = low.view(np.uint8)
    heads = np.packbits(head, axis=1, bitorder="little")
    where = 4 * word_start[:-1, None] + np.arange(heads.shape[1])
    body[where] |= heads
    raw = body.tobytes()
    by_row = np.bincount(row, n, int(heights.sum())).astype("<u2")
    row_start = np.concatenate([[0], np.cumsum(heights)])
    files = []
    for k in range(len(strips)):
        data = raw[4 * word_start[k] : 4 * word_start[k] + -(-(head_bits + int(in_image[k])) // 8)]
        rows = by_row[row_start[k] : row_start[k + 1]].tobytes()
        chunks = b"".join([b"VP8L", len(data).to_bytes(4, "little"), data, bytes(len(data) & 1), b"ROWS", len(rows).to_bytes(4, "little"), rows])
        files.append(b"".join([b"RIFF", (4 + len(chunks)).to_bytes(4, "little"), b"WEBP", chunks]))
    return files
