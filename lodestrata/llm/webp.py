"""Operator 10: lossless WebP images in and out of media columns, in numpy.

``decode`` reads the whole lossless format: prefix codes in groups, back-references, the colour
cache, and the predictor, cross-colour, subtract-green and palette transforms. Streams that spend
bits on the green code only (palette and grey images, with or without back-references) are read by
a table look-up at every bit place at once: the look-ups give each place's successor, doubling the
successors gives every eighth symbol, and eight gathers give the rest. Other streams are read pixel
by pixel. ``encode_grey`` writes 8-bit samples as palette images, repeated lines as back-references;
``encode_argb`` writes any image with chosen transforms.

As a media column a text is its UTF-8 bytes, padded with spaces to rows of ``ROW`` samples; longer
ones than an image can hold become several images one after another.

Defined results: a null or empty text is one row of spaces; a null id stays null; repeated rows
give repeated rows.
"""

from __future__ import annotations

import math
import struct
import zlib
from collections.abc import Iterator, Sequence
from functools import cached_property, lru_cache
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestrata.llm.common import prepare

ROW = 192
MOST_ROWS = 16384
PREDICTOR, CROSS_COLOUR, SUBTRACT_GREEN, PALETTE = range(4)
MAX_CODE, LENGTH_CODES, DISTANCE_CODES = 15, 24, 40
LEAST_LINE, MOST_COPY = 16, 4096
#: Bytes of a stream whose bit places are looked up at once.
BYTES_AT_ONCE = 1 << 17
#: The order in which lengths of the code-length code are stored. Fixed by the format.
LENGTH_ORDER = (17, 18, 0, 1, 2, 3, 4, 5, 16, 6, 7, 8, 9, 10, 11, 12, 13, 14, 15)
#: Short distance codes as (x, y) steps: nearest first, then the steeper, then the one to the right.
NEAR = sorted(((x, y) for y in range(8) for x in range(-7, 9) if y or x > 0), key=lambda p: (p[0] ** 2 + p[1] ** 2, abs(p[0]), p[0] < 0))


# --- bits and codes ---------------------------------------------------------------------------


class BitWriter:
    """Single fields gather in one number, long runs of fields as arrays; both become bytes as soon as they are full."""

    def __init__(self) -> None:
        self.parts: list[bytes] = []
        self.held, self.size = 0, 0

    def put(self, value: int, width: int) -> None:
        self.held |= value << self.size
        self.size += width

    def many(self, values: np.ndarray, widths: np.ndarray) -> None:
        if not len(values):
            return
        full = self.size >> 3
        raw = self.held.to_bytes(full + 1, "little")
        self.parts.append(raw[:full])
        stops = np.cumsum(widths) + (self.size & 7)
        start, size = stops - widths, int(stops[-1])
        first, moved = start >> 3, values << (start & 7)
        length = (size >> 3) + 1
        out = np.zeros(length, np.int64)
        out[0] = raw[full]
        for k in range((int(widths.max()) + 14) >> 3):  # fields share no bit, so a byte is the sum of its parts
            part = np.bincount(first, moved >> 8 * k & 255)[: length - k]
            out[k : k + len(part)] += part.astype(np.int64)
        whole = out.astype(np.uint8).tobytes()
        self.parts.append(whole[:-1])
        self.held, self.size = whole[-1], size & 7

    def finish(self) -> bytes:
        return b"".join(self.parts) + self.held.to_bytes(-(-self.size // 8), "little")


class BitReader:
    def __init__(self, data: bytes) -> None:
        self.data, self.place = data, 0

    def peek(self) -> int:
        at = self.place >> 3
        return int.from_bytes(self.data[at : at + 8], "little") >> (self.place & 7)

    def read(self, width: int) -> int:
        value = self.peek() & ((1 << width) - 1)
        self.place += width
        return value

    def bits(self, place: int, size: int) -> int:
        return int.from_bytes(self.data[place >> 3 : (place + size + 7) >> 3], "little") >> (place & 7) & ((1 << size) - 1)


def code_lengths(counts: Sequence[int], most: int = MAX_CODE) -> list[int]:
    """Lengths of a prefix code; rare symbols are counted up until the longest one fits."""
    used = list(compress(range(len(counts)), counts))
    lengths = [0] * len(counts)
    if len(used) < 2:
        for s in used:
            lengths[s] = 1
        return lengths
    least = 1
    while True:
        # the two rarest nodes are merged; merged ones come in the order of their counts, so two queues do for a heap
        leaves = sorted((max(counts[s], least), n) for n, s in enumerate(used))
        sizes, order = [c for c, _ in leaves], [n for _, n in leaves]
        sizes.append(sum(sizes) + 1)
        merged: list[int] = []
        parent = [0] * (2 * len(used) - 1)
        leaf = inner = 0
        for node in range(len(used), len(parent)):
            both = 0
            for _ in range(2):
                if inner == len(merged) or sizes[leaf] <= merged[inner]:
                    both += sizes[leaf]
                    parent[order[leaf]] = node
                    leaf += 1
                else:
                    both += merged[inner]
                    parent[len(used) + inner] = node
                    inner += 1
            merged.append(both)
        depth = [0] * len(parent)
        for node in range(len(parent) - 2, -1, -1):
            depth[node] = depth[parent[node]] + 1
        for s, d in zip(used, depth, strict=False):
            lengths[s] = d
        if max(depth) <= most:
            return lengths
        least *= 2


@lru_cache(MAX_CODE + 1)
def _reversed(bits: int) -> np.ndarray:
    """All numbers of some bits, each read from its last bit."""
    numbers = np.arange(1 << bits)
    return sum(((numbers >> k & 1) << (bits - 1 - k) for k in range(bits)), np.zeros(1 << bits, np.int64))


#: The numbers of ``MAX_CODE`` bits; shorter ones are found by a shift.
_TURNED = _reversed(MAX_CODE).tolist()


def writing_codes(lengths: Sequence[int]) -> tuple[list[int], list[int]]:
    """(codes with their first bit lowest, widths); a code of one symbol takes no bits."""
    codes, widths = [0] * len(lengths), [0] * len(lengths)
    code, before = 0, 0
    rows = sorted((lengths[s], s) for s in compress(range(len(lengths)), lengths))
    for width, symbol in rows if len(rows) > 1 else ():
        code <<= width - before
        before = width
        codes[symbol], widths[symbol] = _TURNED[code] >> (MAX_CODE - width), width
        code += 1
    return codes, widths


class Code:
    """A reading table: symbol and width by the next ``bits`` bits, from the (width, symbol) of all used symbols."""

    def __init__(self, used: Sequence[tuple[int, int]]) -> None:
        rows = sorted(used)
        self.bits = 0 if len(rows) < 2 else rows[-1][0]
        self.copies = any(symbol >= 256 for _, symbol in rows)
        if len(rows) < 2:
            self.symbols = np.array([rows[0][1] if rows else 0])
            self.widths = np.zeros(1, np.int64)
            return
        widths, symbols = np.array(rows).T
        spans = 1 << (self.bits - widths)  # in the order of the codes each takes the next part of the table
        if int(spans.sum()) != 1 << self.bits:
            raise ValueError("incomplete prefix code")
        turned = _reversed(self.bits)
        self.symbols, self.widths = np.repeat(symbols, spans).take(turned), np.repeat(widths, spans).take(turned)

    @cached_property
    def lists(self) -> tuple[list[int], list[int], int]:
        """(symbols, widths, mask) for reading one by one."""
        return self.symbols.tolist(), self.widths.tolist(), (1 << self.bits) - 1

    def read(self, reader: BitReader) -> int:
        symbols, widths, mask = self.lists
        at = reader.peek() & mask
        reader.place += widths[at]
        return symbols[at]


@lru_cache(64)
def _code_of(used: tuple[tuple[int, int], ...]) -> Code:
    return Code(used)


def write_code(out: BitWriter, lengths: Sequence[int]) -> None:
    out.put(*_code_bits(tuple(lengths)))


def _runs(lengths: Sequence[int]) -> list[tuple[int, int]]:
    """(value, number) of equal neighbours; most are zero."""
    out, at, n = [], 0, len(lengths)
    used = list(compress(range(n), lengths))
    used.append(n)
    last = 0
    for s in used:
        if s > at:
            if last:
                out.append((last, at - since))
            out.append((0, s - at))
            last = 0
        if s < n and lengths[s] != last:
            if last:
                out.append((last, s - since))
            last, since = lengths[s], s
        at = s + 1
    if last:
        out.append((last, n - since))
    return out


@lru_cache(64)
def _code_bits(lengths: tuple[int, ...]) -> tuple[int, int]:
    """How a code is stored, as (bits, their number)."""
    out = BitWriter()
    used = list(compress(range(len(lengths)), lengths)) or [0]
    if len(used) <= 2 and used[-1] < 256:
        for value, width in ((1, 1), (len(used) - 1, 1), (1, 1), *((s, 8) for s in used)):
            out.put(value, width)
        return out.held, out.size
    tokens: list[tuple[int, int, int]] = []
    for length, run in _runs(lengths):
        if length == 0:
            while run >= 11:
                step = min(run, 138)
                tokens.append((18, step - 11, 7))
                run -= step
            if run >= 3:
                tokens.append((17, run - 3, 3))
                run = 0
        else:
            tokens.append((length, 0, 0))
            run -= 1
            while run >= 3:
                step = min(run, 6)
                tokens.append((16, step - 3, 2))
                run -= step
        tokens += [(length, 0, 0)] * run
    counts = [0] * 19
    for symbol, *_ in tokens:
        counts[symbol] += 1
    widths = code_lengths(counts, 7)
    stored = max(4, 1 + max(n for n, s in enumerate(LENGTH_ORDER) if widths[s]))
    out.put(0, 1)
    out.put(stored - 4, 4)
    for s in LENGTH_ORDER[:stored]:
        out.put(widths[s], 3)
    out.put(0, 1)
    codes, sizes = writing_codes(widths)
    for s, extra, bits in tokens:
        out.put(codes[s] | extra << sizes[s], sizes[s] + bits)
    return out.held, out.size


def read_code(reader: BitReader, alphabet: int) -> Code:
    window = reader.peek()
    if window & 1:
        size = 8 if window & 4 else 1
        first = window >> 3 & ((1 << size) - 1)
        if not window & 2:
            reader.place += 3 + size
            return _code_of(((1, first),))
        reader.place += 11 + size
        return _code_of(tuple((1, s) for s in {first, window >> 3 + size & 255}))
    reader.place += 5
    held = reader.bits(reader.place, 57)
    stored = LENGTH_ORDER[: 4 + (window >> 1 & 15)]
    reader.place += 3 * len(stored)
    widths = ((held >> 3 * n & 7, s) for n, s in enumerate(stored))
    code = _code_of(tuple(row for row in widths if row[0]))
    left = alphabet
    if reader.read(1):
        left = 2 + reader.read(2 + 2 * reader.read(3))
    symbols, sizes, mask = code.lists
    used, at, last = [], 0, 8
    data, place, have = reader.data, reader.place, 0
    while at < alphabet and left:
        left -= 1
        if have < 16:
            held, have = int.from_bytes(data[place >> 3 : (place >> 3) + 32], "little") >> (place & 7), 256 - (place & 7)
        symbol = symbols[held & mask]
        size = sizes[held & mask]
        if symbol < 16:
            if symbol:
                used.append((symbol, at))
                last = symbol
            at += 1
        else:
            extra, least = ((2, 3), (3, 3), (7, 11))[symbol - 16]
            run = least + (held >> size & ((1 << extra) - 1))
            size += extra
            if at + run > alphabet:
                raise ValueError("too many code lengths")
            if symbol == 16:
                used += [(last, s) for s in range(at, at + run)]
            at += run
        held >>= size
        have -= size
        place += size
    reader.place = place
    return _code_of(tuple(used))


def prefix_of(value: int) -> tuple[int, int, int]:
    """(prefix, extra bits, their value) of a length or distance code of 1 or more."""
    if value <= 4:
        return value - 1, 0, 0
    top = (value - 1).bit_length() - 1
    extra = top - 1
    return 2 * top + ((value - 1) >> extra & 1), extra, (value - 1) & ((1 << extra) - 1)


def value_of(prefix: int, reader: BitReader) -> int:
    if prefix < 4:
        return prefix + 1
    extra = (prefix - 2) >> 1
    return ((2 + (prefix & 1)) << extra) + reader.read(extra) + 1


def distance_of(code: int, width: int) -> int:
    if code > len(NEAR):
        return code - len(NEAR)
    x, y = NEAR[code - 1]
    return max(1, x + y * width)


# --- decoding ---------------------------------------------------------------------------------


def _read_group(reader: BitReader, cache_bits: int) -> list[Code]:
    cache = 1 << cache_bits if cache_bits else 0
    codes, before, last = [], reader.place, 0
    for alphabet in (256 + LENGTH_CODES + cache, 256, 256, 256, DISTANCE_CODES):
        start, size = reader.place, reader.place - before
        if alphabet == last and reader.bits(start, size) == reader.bits(before, size):  # the same bits are the same code
            reader.place += size
            codes.append(codes[-1])
        else:
            codes.append(read_code(reader, alphabet))
        before, last = start, alphabet
    return codes


def _read_pixels(reader: BitReader, width: int, height: int, main: bool) -> np.ndarray:
    """ARGB values of an entropy-coded image, in one row; ``main``: it may have several code groups."""
    cache_bits = reader.read(4) if reader.read(1) else 0
    group_bits, group_of, groups = 0, None, 1
    if main and reader.read(1):
        group_bits = reader.read(3) + 2
        across = -(-width // (1 << group_bits))
        group_of = (_read_pixels(reader, across, -(-height // (1 << group_bits)), False) >> 8 & 0xFFFF).tolist()
        groups = max(group_of) + 1
    codes = [_read_group(reader, cache_bits) for _ in range(groups)]
    green, red, blue, alpha, distance = codes[0]
    if groups == 1 and not cache_bits and not (red.bits or blue.bits or alpha.bits):
        still = int(alpha.symbols[0]) << 24 | int(red.symbols[0]) << 16 | int(blue.symbols[0])
        return _read_green(reader, green, distance, width, width * height).astype(np.uint32) << 8 | np.uint32(still)
    out, at, size = np.zeros(width * height, np.uint32), 0, width * height
    cache, cached = [0] * (1 << cache_bits if cache_bits else 0), 0

    def remember(until: int) -> None:
        nonlocal cached
        for argb in out[cached:until].tolist():
            cache[(0x1E35A7BD * argb & 0xFFFFFFFF) >> (32 - cache_bits)] = argb
        cached = until

    def tables(group: list[Code]) -> tuple:
        return tuple(x for code in group[:4] for x in code.lists)

    held = [tables(group) for group in codes]
    greens, green_widths, green_mask, reds, red_widths, red_mask, blues, blue_widths, blue_mask, alphas, alpha_widths, alpha_mask = held[0]
    data = reader.data
    while at < size:
        if group_of is not None:
            group = group_of[(at // width >> group_bits) * across + (at % width >> group_bits)]
            distance = codes[group][4]
            greens, green_widths, green_mask, reds, red_widths, red_mask, blues, blue_widths, blue_mask, alphas, alpha_widths, alpha_mask = held[group]
        place = reader.place
        window = int.from_bytes(data[place >> 3 : (place >> 3) + 9], "little") >> (place & 7)  # four codes of at most 15 bits
        n = window & green_mask
        symbol, used = greens[n], green_widths[n]
        if symbol < 256:
            n = window >> used & red_mask
            r, used = reds[n], used + red_widths[n]
            n = window >> used & blue_mask
            b, used = blues[n], used + blue_widths[n]
            n = window >> used & alpha_mask
            out[at] = alphas[n] << 24 | r << 16 | symbol << 8 | b
            reader.place = place + used + alpha_widths[n]
            at += 1
            continue
        reader.place = place + used
        if symbol < 256 + LENGTH_CODES:
            length = value_of(symbol - 256, reader)
            back = distance_of(value_of(distance.read(reader), reader), width)
            if back > at or at + length > size:
                raise ValueError("back-reference outside the image")
            _copy(out, at, back, length)
            at += length
        else:
            remember(at)
            out[at] = cache[symbol - 256 - LENGTH_CODES]
            at += 1
    return out


def _copy(out: np.ndarray, at: int, back: int, length: int) -> None:
    while length:  # an overlapping copy repeats what it has just written
        step = min(length, back)
        out[at : at + step] = out[at - back : at - back + step]
        at, length, back = at + step, length - step, back + step


def _read_green(reader: BitReader, green: Code, distance: Code, width: int, size: int) -> np.ndarray:
    """Green values of a stream in which only green codes and copies take bits."""
    if not green.bits:
        if green.symbols[0] >= 256:
            raise ValueError("an image of copies only")
        return np.full(size, green.symbols[0], np.uint8)
    data = reader.data + bytes(16)
    symbols, lengths, backs, made, place = [], [], [], 0, reader.place
    mask = (1 << green.bits) - 1
    while made < size:
        first = place >> 3
        count = min(BYTES_AT_ONCE, len(reader.data) - first)
        if count <= 0:
            raise ValueError("the image's data end early")
        words = np.ndarray(count, "<u4", data, first, (1,))
        window = np.empty((count, 8), np.int64)
        for bit in range(8):
            np.right_shift(words, bit, out=window[:, bit])
        window = window.ravel()
        window &= mask
        reach = green.widths.take(window)
        reach += np.arange(count * 8)
        length = back = None
        if green.copies and len(copies := np.flatnonzero((symbol := green.symbols[window]) >= 256)):
            length, back, ends = _copy_fields(data, first * 8, copies, reach[copies], symbol[copies] - 256, distance, width)
            reach[copies] = ends
        limit = count * 8
        after = np.empty(limit + 1, np.int64)
        np.minimum(reach, limit, out=after[:limit])
        after[limit] = limit
        eighth = after.take(after)
        eighth = eighth.take(eighth)
        eighth = memoryview(eighth.take(eighth))
        at, stops = place - first * 8, []
        while at < limit:
            stops.append(at)
            at = eighth[at]
        columns = [np.array(stops)]
        for _ in range(7):
            columns.append(after[columns[-1]])
        places = np.stack(columns, axis=1).ravel()
        places = places[places < limit]
        found = green.symbols[window[places]]
        size_of = np.ones(len(found), np.int64)
        if length is not None and len(are := np.flatnonzero(found >= 256)):
            which = np.searchsorted(copies, places[are])
            size_of[are] = length[which]
            backs.append(np.stack([are + sum(map(len, symbols)), back[which]], axis=1))
        produced = np.cumsum(size_of)
        if made + produced[-1] >= size:
            last = int(np.searchsorted(produced, size - made))
            found, size_of, places = found[: last + 1], size_of[: last + 1], places[: last + 1]
            produced = produced[: last + 1]
        symbols.append(found)
        lengths.append(size_of)
        made += int(produced[-1])
        place = first * 8 + int(reach[places[-1]])
    if made != size:
        raise ValueError("back-reference outside the image")
    reader.place = place
    symbol, length = np.concatenate(symbols), np.concatenate(lengths)
    if not (symbol >= 256).any():
        return symbol.astype(np.uint8)
    start = np.cumsum(length) - length
    out = np.zeros(size, np.uint8)
    plain = symbol < 256
    out[start[plain]] = symbol[plain]
    for n, back in np.concatenate(backs).tolist():
        if n < len(symbol):
            if back > start[n]:
                raise ValueError("back-reference outside the image")
            _copy(out, int(start[n]), back, int(length[n]))
    return out


def _copy_fields(data: bytes, base: int, places: np.ndarray, at: np.ndarray, prefix: np.ndarray, distance: Code, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(lengths, distances, ends) of the copies that would begin at some bit places, read side by side."""
    at = at.astype(np.int64)
    whole = np.frombuffer(data, np.uint8)

    def take(at: np.ndarray, bits: np.ndarray) -> np.ndarray:
        byte = np.minimum((base + at) >> 3, len(whole) - 5)
        value = sum(whole[byte + k].astype(np.int64) << (8 * k) for k in range(5)) >> ((base + at) & 7)
        return value & ((1 << bits) - 1)

    def value(prefix: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        extra = np.maximum(prefix.astype(np.int64) - 2, 0) >> 1
        extra[prefix < 4] = 0
        return np.where(prefix < 4, prefix + 1, ((2 + (prefix.astype(np.int64) & 1)) << extra) + take(at, extra) + 1), at + extra

    length, at = value(prefix, at)
    window = take(at, np.full(len(at), distance.bits))
    code, at = value(distance.symbols[window], at + distance.widths[window])
    near = np.array([distance_of(c + 1, width) for c in range(len(NEAR))])
    return length, np.where(code > len(NEAR), code - len(NEAR), near[np.minimum(code, len(NEAR)) - 1]), np.minimum(at, 1 << 30)


def decode(data: bytes) -> np.ndarray:
    """The (height, width) ARGB pixels of one lossless WebP file."""
    if data[:4] != b"RIFF" or data[8:16] != b"WEBPVP8L" or data[20] != 0x2F:
        raise ValueError("not a lossless WebP file")
    reader = BitReader(data[21 : 20 + int.from_bytes(data[16:20], "little")])
    width, height = reader.read(14) + 1, reader.read(14) + 1
    reader.read(1)
    if reader.read(3):
        raise ValueError("unknown version")
    transforms: list[tuple] = []
    full = width
    while reader.read(1):
        kind = reader.read(2)
        if kind in (t[0] for t in transforms):
            raise ValueError("a transform occurs twice")
        if kind in (PREDICTOR, CROSS_COLOUR):
            bits = reader.read(3) + 2
            across = -(-width // (1 << bits))
            transforms.append((kind, bits, _read_pixels(reader, across, -(-height // (1 << bits)), False).reshape(-1, across), width))
        elif kind == PALETTE:
            size = reader.read(8) + 1
            table = np.cumsum(_channels(_read_pixels(reader, size, 1, False)), axis=0, dtype=np.uint8)
            bits = 3 if size <= 2 else 2 if size <= 4 else 1 if size <= 16 else 0
            transforms.append((kind, bits, _argb(table), width))
            width = -(-width // (1 << bits))
        else:
            transforms.append((kind, 0, None, width))
    pixels = _read_pixels(reader, width, height, True).reshape(height, width)
    for kind, bits, image, wide in reversed(transforms):
        pixels = _INVERSE[kind](pixels, bits, image, wide)
    return pixels.reshape(height, full)


def _channels(argb: np.ndarray) -> np.ndarray:
    """(..., 4) bytes in the order alpha, red, green, blue."""
    return np.stack([(argb >> np.uint32(s)).astype(np.uint8) for s in (24, 16, 8, 0)], axis=-1)


def _argb(channels: np.ndarray) -> np.ndarray:
    a, r, g, b = (channels[..., n].astype(np.uint32) for n in range(4))
    return a << np.uint32(24) | r << np.uint32(16) | g << np.uint32(8) | b


def _from_palette(pixels: np.ndarray, bits: int, table: np.ndarray, width: int) -> np.ndarray:
    index = (pixels >> np.uint32(8)) & np.uint32(255)
    if bits:
        per, each = 1 << bits, 8 >> bits
        index = (index[:, :, None] >> (np.arange(per, dtype=np.uint32) * np.uint32(each))) & np.uint32((1 << each) - 1)
        index = index.reshape(len(pixels), -1)[:, :width]
    return np.concatenate([table, np.zeros(256 - len(table), np.uint32)])[index]


def _add_green(pixels: np.ndarray, *_: object) -> np.ndarray:
    c = _channels(pixels)
    c[..., 1] += c[..., 2]
    c[..., 3] += c[..., 2]
    return _argb(c)


def _delta(t: np.ndarray, c: np.ndarray) -> np.ndarray:
    return (t.astype(np.int8).astype(np.int32) * c.astype(np.int8)) >> 5


def _spread(image: np.ndarray, bits: int, shape: tuple[int, int]) -> np.ndarray:
    return np.repeat(np.repeat(image, 1 << bits, 0), 1 << bits, 1)[: shape[0], : shape[1]]


def _cross(pixels: np.ndarray, bits: int, image: np.ndarray, sign: int) -> np.ndarray:
    """sign 1 takes the colour prediction away again, -1 applies it."""
    c, e = _channels(pixels), _channels(_spread(image, bits, pixels.shape))
    red = c[..., 1] + (sign * _delta(e[..., 3], c[..., 2])).astype(np.uint8)
    base = red if sign == 1 else c[..., 1]
    c[..., 3] += (sign * (_delta(e[..., 2], c[..., 2]) + _delta(e[..., 1], base))).astype(np.uint8)
    c[..., 1] = red
    return _argb(c)


def _half(a: int, b: int) -> int:
    return (a + b) >> 1


def _clamp(x: int) -> int:
    return 0 if x < 0 else 255 if x > 255 else x


def _predicted(mode: int, left: tuple, top: tuple, corner: tuple, right: tuple) -> tuple:
    """The prediction of mode 0 to 13 from the left, top, top-left and top-right pixels."""
    if mode == 11:
        near_left = sum(abs(t - c) for t, c in zip(top, corner, strict=True))
        near_top = sum(abs(s - c) for s, c in zip(left, corner, strict=True))
        return left if near_left < near_top else top
    rule = {
        1: lambda s, t, c, r: s, 2: lambda s, t, c, r: t, 3: lambda s, t, c, r: r, 4: lambda s, t, c, r: c,
        5: lambda s, t, c, r: _half(_half(s, r), t), 6: lambda s, t, c, r: _half(s, c), 7: lambda s, t, c, r: _half(s, t),
        8: lambda s, t, c, r: _half(c, t), 9: lambda s, t, c, r: _half(t, r), 10: lambda s, t, c, r: _half(_half(s, c), _half(t, r)),
        12: lambda s, t, c, r: _clamp(s + t - c), 13: lambda s, t, c, r: _clamp((a := _half(s, t)) + int((a - c) / 2)),
    }.get(mode)
    return tuple(map(rule, left, top, corner, right)) if rule else (255, 0, 0, 0)


def _predict(pixels: np.ndarray, bits: int, image: np.ndarray, back: bool) -> np.ndarray:
    """Adds predictions to residuals (back), or takes them away; each pixel needs those before it."""
    height, width = pixels.shape
    given = [tuple(p) for p in _channels(pixels).reshape(-1, 4).tolist()]
    whole = [(0, 0, 0, 0)] * len(given) if back else given
    out: list[tuple] = []
    modes = ((image >> np.uint32(8)) & np.uint32(15)).tolist()
    for n, own in enumerate(given):
        y, x = divmod(n, width)
        if n == 0:
            guess = (255, 0, 0, 0)
        elif y == 0:
            guess = whole[n - 1]
        elif x == 0:
            guess = whole[n - width]
        else:
            guess = _predicted(modes[y >> bits][x >> bits], whole[n - 1], whole[n - width], whole[n - width - 1], whole[n - width + 1])
        made = tuple((o + g if back else o - g) & 255 for o, g in zip(own, guess, strict=True))
        out.append(made)
        if back:
            whole[n] = made
    return _argb(np.array(out, np.uint8)).reshape(height, width)


_INVERSE = {
    PREDICTOR: lambda pixels, bits, image, _: _predict(pixels, bits, image, True),
    CROSS_COLOUR: lambda pixels, bits, image, _: _cross(pixels, bits, image, 1),
    SUBTRACT_GREEN: _add_green,
    PALETTE: _from_palette,
}


# --- encoding ---------------------------------------------------------------------------------


def _container(stream: bytes) -> bytes:
    body = b"\x2f" + stream
    padded = body + b"\0" * (len(body) & 1)
    return b"RIFF" + struct.pack("<I", 12 + len(padded)) + b"WEBPVP8L" + struct.pack("<I", len(body)) + padded


def _header(out: BitWriter, width: int, height: int, alpha: bool) -> None:
    for value, bits in ((width - 1, 14), (height - 1, 14), (int(alpha), 1), (0, 3)):
        out.put(value, bits)


def _write_pixels(out: BitWriter, pixels: np.ndarray, width: int, main: bool, cache_bits: int = 0, copies: bool = False) -> None:
    """Any image, pixel by pixel: literals, copies of runs and of the row above, and cache hits."""
    values = pixels.ravel().tolist()
    tokens: list[tuple] = []
    cache = [None] * (1 << cache_bits)
    at = 0
    while at < len(values):
        length, code = 0, 0
        for near, (x, y) in enumerate(((0, 1), (1, 0)), 1) if copies else ():
            back = max(1, x + y * width)
            run = 0
            while at >= back and at + run < len(values) and run < MOST_COPY and values[at + run] == values[at + run - back]:
                run += 1
            if run > length:
                length, code = run, near
        key = (0x1E35A7BD * values[at] & 0xFFFFFFFF) >> (32 - cache_bits) if cache_bits else 0
        if length >= 4:
            tokens.append(("copy", prefix_of(length), prefix_of(code)))
        elif cache_bits and cache[key] == values[at]:
            length = 1
            tokens.append(("cache", key))
        else:
            length = 1
            tokens.append(("plain", values[at]))
        for argb in values[at : at + length] if cache_bits else ():
            cache[(0x1E35A7BD * argb & 0xFFFFFFFF) >> (32 - cache_bits)] = argb
        at += length
    counts = [[0] * n for n in (256 + LENGTH_CODES + (len(cache) if cache_bits else 0), 256, 256, 256, DISTANCE_CODES)]
    fields: list[list[tuple[int, int]]] = []  # (alphabet, symbol), or (-extra bits - 1, value)
    for kind, *rest in tokens:
        if kind == "plain":
            v = rest[0]
            fields.append([(0, v >> 8 & 255), (1, v >> 16 & 255), (2, v & 255), (3, v >> 24)])
        elif kind == "cache":
            fields.append([(0, 256 + LENGTH_CODES + rest[0])])
        else:
            (p, bits, extra), (q, more, other) = rest
            fields.append([(0, 256 + p), (-bits - 1, extra), (4, q), (-more - 1, other)])
    for row in fields:
        for alphabet, symbol in row:
            if alphabet >= 0:
                counts[alphabet][symbol] += 1
    out.put(1 if cache_bits else 0, 1)
    if cache_bits:
        out.put(cache_bits, 4)
    if main:
        out.put(0, 1)
    codes = []
    for n, own in enumerate(counts):
        lengths = lengths if n and own == counts[n - 1] else code_lengths(own)
        write_code(out, lengths)
        codes.append(writing_codes(lengths))
    for row in fields:
        for alphabet, symbol in row:
            if alphabet < 0:
                out.put(symbol, -alphabet - 1)
            else:
                out.put(codes[alphabet][0][symbol], codes[alphabet][1][symbol])


def encode_argb(pixels: np.ndarray, predictor: np.ndarray | None = None, cross: np.ndarray | None = None, subtract_green: bool = False, palette: bool = False, bits: int = 2, cache_bits: int = 0, copies: bool = False) -> bytes:
    """One WebP file of (height, width) ARGB pixels. ``predictor`` and ``cross`` are images of their blocks of 2**bits pixels."""
    pixels = np.ascontiguousarray(pixels, np.uint32)
    height, width = pixels.shape
    out = BitWriter()
    _header(out, width, height, bool((pixels >> np.uint32(24) != 255).any()))
    if palette:
        table, index = np.unique(pixels, return_inverse=True)
        pixels = _write_palette(out, table, index.reshape(height, width))
        width = pixels.shape[1]
    for kind, image in ((PREDICTOR, predictor), (CROSS_COLOUR, cross)):
        if image is not None:
            for value, size in ((1, 1), (kind, 2), (bits - 2, 3)):
                out.put(value, size)
            _write_pixels(out, image, image.shape[1], False)
            pixels = _predict(pixels, bits, image, False) if kind == PREDICTOR else _cross(pixels, bits, image, -1)
    if subtract_green:
        out.put(1, 1)
        out.put(SUBTRACT_GREEN, 2)
        c = _channels(pixels)
        c[..., 1] -= c[..., 2]
        c[..., 3] -= c[..., 2]
        pixels = _argb(c)
    out.put(0, 1)
    _write_pixels(out, pixels, width, True, cache_bits, copies)
    return _container(out.finish())


def _write_palette(out: BitWriter, table: np.ndarray, index: np.ndarray) -> np.ndarray:
    """Writes the transform and returns the image of indexes, bundled if the table is small."""
    for value, size in ((1, 1), (PALETTE, 2), (len(table) - 1, 8)):
        out.put(value, size)
    channels = _channels(table.astype(np.uint32))
    _write_pixels(out, _argb(np.diff(channels, axis=0, prepend=np.zeros((1, 4), np.uint8))), len(table), False)
    return _bundled(index, len(table))


def _write_greys(out: BitWriter, greys: np.ndarray) -> None:
    """Writes a palette of greys, in rising order, as ``_write_pixels`` would: its three colours have the same steps and codes."""
    steps = np.diff(greys.astype(np.int64), prepend=0)
    lengths = code_lengths(np.bincount(steps, minlength=256).tolist())
    alpha = [0] * 256
    alpha[255] = 1
    if len(steps) > 1:
        alpha[0] = 1
    out.put(0, 1)
    for own in (lengths + [0] * LENGTH_CODES, lengths, lengths, alpha, [0] * DISTANCE_CODES):
        write_code(out, own)
    codes, widths = writing_codes(lengths)
    opaque = int(len(steps) > 1)
    for n, step in enumerate(steps.tolist()):
        code, width = codes[step], widths[step]
        out.put(code | code << width | code << 2 * width | (opaque << 3 * width if n == 0 else 0), 3 * width + opaque)


def _bundled(index: np.ndarray, greys: int) -> np.ndarray:
    """The image of palette indexes, several in a pixel if the palette is small."""
    bits = 3 if greys <= 2 else 2 if greys <= 4 else 1 if greys <= 16 else 0
    index = index.astype(np.uint32)
    if bits:
        per, each = 1 << bits, 8 >> bits
        index = np.pad(index, ((0, 0), (0, -index.shape[1] % per))).reshape(len(index), -1, per)
        index = (index << (np.arange(per, dtype=np.uint32) * np.uint32(each))).sum(axis=2, dtype=np.uint32)
    return index << np.uint32(8) | np.uint32(0xFF000000)


@lru_cache(4096)
def _line_copy(length: int, back: int) -> tuple[int, int, int, int, int, int]:
    return prefix_of(length) + prefix_of(back + len(NEAR))


def _line_copies(payload: bytes) -> list[tuple[int, int, int]]:
    """(start, length, distance) of whole lines that stood before, in parts of at most MOST_COPY."""
    seen: dict[bytes, int] = {}
    out, at = [], 0
    for line in payload.split(b"\n"):
        if len(line) >= LEAST_LINE:
            before = seen.get(line)
            if before is not None and at - before < 1 << 19:
                out += [(at + k, min(MOST_COPY, len(line) - k), at - before) for k in range(0, len(line), MOST_COPY)]
            seen[line] = at
        at += len(line) + 1
    return out


def encode_grey(samples: bytes, width: int = ROW) -> bytes:
    """One WebP file of 8-bit samples, whole rows of them: a palette of their greys, one green code per sample."""
    values = np.frombuffer(samples, np.uint8)
    height = len(values) // width
    if height * width != len(values) or not 0 < height <= MOST_ROWS:
        raise ValueError("samples are 1 to 16384 whole rows")
    out = BitWriter()
    _header(out, width, height, False)
    present = np.bincount(values, minlength=256) > 0
    table = np.flatnonzero(present).astype(np.uint32)
    place = (np.cumsum(present) - 1).astype(np.uint8)
    for value, size in ((1, 1), (PALETTE, 2), (len(table) - 1, 8)):
        out.put(value, size)
    _write_greys(out, table)
    image = _bundled(place[values].reshape(height, width), len(table))
    out.put(0, 1)
    green = (image.ravel() >> np.uint32(8) & np.uint32(255)).astype(np.int64)
    copies = _line_copies(samples) if image.shape[1] == width else []
    counts = np.zeros(256 + LENGTH_CODES, np.int64)
    far = [0] * DISTANCE_CODES
    keep = np.ones(len(green), bool)
    for start, length, back in copies:
        keep[start : start + length] = False
        p = _line_copy(length, back)
        counts[256 + p[0]] += 1
        far[p[3]] += 1
    plain = np.flatnonzero(keep)
    counts[:256] = np.bincount(green[plain], minlength=256)
    lengths, far_lengths = code_lengths(counts.tolist()), code_lengths(far)
    out.put(0, 1)
    out.put(0, 1)
    write_code(out, lengths)
    for symbol in (0, 0, 255):  # red, blue and alpha stand still
        out.put(1 | 4 | symbol << 3, 11)
    write_code(out, far_lengths)
    codes, widths = (np.array(x, np.int64) for x in writing_codes(lengths))
    values_out, widths_out = codes[green[plain]], widths[green[plain]]
    if copies:
        far_codes, far_widths = writing_codes(far_lengths)
        rows = []
        for length, back in ((length, back) for _, length, back in copies):
            p, bits, extra, q, more, other = _line_copy(length, back)
            rows.append(((codes[256 + p], widths[256 + p]), (extra, bits), (far_codes[q], far_widths[q]), (other, more)))
        fields = np.array(rows, np.int64).reshape(-1, 2)
        spots = np.repeat(np.searchsorted(plain, [start for start, *_ in copies]), 4)
        values_out, widths_out = np.insert(values_out, spots, fields[:, 0]), np.insert(widths_out, spots, fields[:, 1])
    out.many(values_out, widths_out)
    return _container(out.finish())


def encode_payload(payload: bytes) -> bytes:
    """A payload of whole rows as one WebP file, or several one after another if it has too many rows."""
    step = ROW * MOST_ROWS
    return b"".join(encode_grey(payload[at : at + step]) for at in range(0, len(payload), step))


def decode_payload(data: bytes) -> np.ndarray:
    """The samples of ``encode_payload``: (rows, ROW) bytes."""
    parts, at = [], 0
    while at < len(data):
        end = at + 8 + int.from_bytes(data[at + 4 : at + 8], "little")
        parts.append((decode(data[at:end]) >> np.uint32(8)).astype(np.uint8))
        at = end
    return np.concatenate(parts)


# --- media columns ----------------------------------------------------------------------------


def feature_of(samples: np.ndarray) -> str:
    """Mean, entropy in bits, and a 64-bit hash of brightness steps between the 8 by 9 cells of an image."""
    flat = samples.ravel()
    counts = np.bincount(flat, minlength=256)
    share = counts[counts > 0] / len(flat)
    cuts = (np.arange(73) * len(flat)) // 72
    sums = np.add.reduceat(flat.astype(np.int64), np.minimum(cuts[:-1], len(flat) - 1)) / np.maximum(np.diff(cuts), 1)
    steps = (np.diff(sums.reshape(8, 9), axis=1) > 0).ravel()
    print_ = int(np.packbits(steps, bitorder="little").view("<u8")[0])
    return f"{flat.mean():.4f}|{max(0.0, -float((share * np.log2(share)).sum())):.4f}|{print_:016x}"


def to_media(df: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(id, n_bytes, media): each text as a lossless WebP image."""
    prepare(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, media = [], []
            for text in batch.column(1).to_pylist():
                raw = text or b""
                sizes.append(len(raw))
                media.append(encode_payload(raw.ljust(max(ROW, math.ceil(len(raw) / ROW) * ROW))))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), pa.array(media, pa.binary())], names=[id_column, "n_bytes", "media"])

    rows = df.select(id_column, F.col(text_column).cast("binary").alias("__text"))
    return rows.mapInArrow(run, f"`{id_column}` {rows.schema[0].dataType.simpleString()}, n_bytes long, media binary")


def from_media(stored: DataFrame, id_column: str = "doc_id", with_samples: bool = False) -> DataFrame:
    """(id, n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, feature), all of what the images hold."""
    prepare(stored.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from hashlib import sha256

        for batch in batches:
            rows, pixels = [], []
            for data in batch.column(2).to_pylist():
                samples = decode_payload(data)
                payload = samples.tobytes()
                rows.append((len(payload), sha256(payload).hexdigest(), zlib.crc32(payload[-16:]), len(data), sha256(data).hexdigest(), feature_of(samples)))
                if with_samples:
                    pixels.append(payload)
            columns = list(zip(*rows, strict=True)) if rows else [[]] * 6
            kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())
            made = [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)]
            names = [id_column, "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
            if with_samples:
                made.append(pa.array(pixels, pa.binary()))
                names.append("samples")
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *made], names=names)

    rows = stored.select(id_column, "n_bytes", "media")
    schema = f"`{id_column}` {rows.schema[0].dataType.simpleString()}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
    return rows.mapInArrow(run, schema + ", samples binary" * with_samples)
