"""Two-dimensional and linear codes: symbols made from text, read from frames, verified and graded."""

from __future__ import annotations

import functools
import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from ..frames import SCHEMA
from ..shipping import ship
from ..spec import Operator, register
from .images import gray, otsu
from .measures import measure_op

# --- arithmetic over GF(256) and Reed-Solomon codes


class Field:
    def __init__(self, polynomial: int):
        self.exp, self.log = [0] * 512, [0] * 256
        x = 1
        for k in range(255):
            self.exp[k], self.log[x] = x, k
            x = x << 1 ^ (polynomial if x & 128 else 0)
        self.exp[255:510] = self.exp[:255]

    def mul(self, a: int, b: int) -> int:
        return self.exp[self.log[a] + self.log[b]] if a and b else 0

    def inverse(self, a: int) -> int:
        return self.exp[255 - self.log[a]]

    def value(self, poly: list[int], x: int) -> int:
        """A polynomial, highest power first, at x."""
        out = 0
        for c in poly:
            out = self.mul(out, x) ^ c
        return out

    def checks(self, data: list[int], n: int, first: int) -> list[int]:
        """n check words; the generator's roots start at power `first`."""
        generator = [1]
        for k in range(n):
            root = self.exp[first + k]
            generator = [a ^ self.mul(b, root) for a, b in zip([*generator, 0], [0, *generator], strict=True)]
        rest = [*data, *[0] * n]
        for i in range(len(data)):
            for j, g in enumerate(generator[1:], 1):
                rest[i + j] ^= self.mul(g, rest[i])
        return rest[len(data) :]

    def corrected(self, words: list[int], n: int, first: int) -> list[int] | None:
        """The words with up to n / 2 errors mended; None if there are more."""
        syndromes = [self.value(words, self.exp[first + k]) for k in range(n)]
        if not any(syndromes):
            return words
        # Berlekamp and Massey: the shortest recurrence (lowest power first) of the syndromes.
        locator, before, length, gap, last = [1], [1], 0, 1, 1
        for k in range(n):
            d = syndromes[k]
            for j in range(1, length + 1):
                d ^= self.mul(locator[j] if j < len(locator) else 0, syndromes[k - j])
            if not d:
                gap += 1
                continue
            scale = self.mul(d, self.inverse(last))
            shifted = [0] * gap + [self.mul(scale, c) for c in before]
            new = [a ^ b for a, b in itertools.zip_longest(locator, shifted, fillvalue=0)]
            if 2 * length <= k:
                before, length, last, gap = locator, k + 1 - length, d, 1
            else:
                gap += 1
            locator = new
        size = len(words)
        wrong = [i for i in range(size) if not self.value(locator[::-1], self.exp[(255 - (size - 1 - i)) % 255])]
        if len(wrong) != length or 2 * length > n:
            return None
        evaluator = [0] * n
        for i, a in enumerate(syndromes):
            for j, b in enumerate(locator):
                if i + j < n:
                    evaluator[i + j] ^= self.mul(a, b)
        out = list(words)
        for i in wrong:
            power = (size - 1 - i) % 255
            x = self.exp[(255 - power) % 255]
            slope = 0
            for j in range(1, len(locator), 2):
                slope ^= self.mul(locator[j], self.exp[self.log[x] * (j - 1) % 255])
            if not slope:
                return None
            out[i] ^= self.mul(self.mul(self.value(evaluator[::-1], x), self.inverse(slope)), self.exp[power * (1 - first) % 255])
        return out if not any(self.value(out, self.exp[first + k]) for k in range(n)) else None


QR_FIELD, MATRIX_FIELD = Field(0x11D), Field(0x12D)
_PRODUCTS = np.array([[QR_FIELD.mul(a, b) for b in range(256)] for a in range(256)], np.uint8)

# --- QR symbols

#: Fixed values, versions 1 to 10: check words of a block, then (blocks, data words of each), by level.
BLOCKS = {
    "L": [(7, (1, 19)), (10, (1, 34)), (15, (1, 55)), (20, (1, 80)), (26, (1, 108)), (18, (2, 68)), (20, (2, 78)), (24, (2, 97)), (30, (2, 116)), (18, (2, 68), (2, 69))],
    "M": [(10, (1, 16)), (16, (1, 28)), (26, (1, 44)), (18, (2, 32)), (24, (2, 43)), (16, (4, 27)), (18, (4, 31)), (22, (2, 38), (2, 39)), (22, (3, 36), (2, 37)), (26, (4, 43), (1, 44))],
    "Q": [(13, (1, 13)), (22, (1, 22)), (18, (2, 17)), (26, (2, 24)), (18, (2, 15), (2, 16)), (24, (4, 19)), (18, (2, 14), (4, 15)), (22, (4, 18), (2, 19)), (20, (4, 16), (4, 17)), (24, (6, 19), (2, 20))],
    "H": [(17, (1, 9)), (28, (1, 16)), (22, (2, 13)), (16, (4, 9)), (22, (2, 11), (2, 12)), (28, (4, 15)), (26, (4, 13), (1, 14)), (26, (4, 14), (2, 15)), (24, (4, 12), (4, 13)), (28, (6, 15), (2, 16))],
}
#: Middles of alignment patterns, by version.
ALIGNMENT = [[], [6, 18], [6, 22], [6, 26], [6, 30], [6, 34], [6, 22, 38], [6, 24, 42], [6, 26, 46], [6, 28, 50]]
#: The two bits of a level, the masks, the characters of the alphanumeric mode.
LEVELS = {"L": 1, "M": 0, "Q": 3, "H": 2}
MASKS = [
    lambda i, j: (i + j) % 2, lambda i, j: i % 2, lambda i, j: j % 3, lambda i, j: (i + j) % 3,
    lambda i, j: (i // 2 + j // 3) % 2, lambda i, j: i * j % 2 + i * j % 3, lambda i, j: (i * j % 2 + i * j % 3) % 2, lambda i, j: ((i + j) % 2 + i * j % 3) % 2,
]
ALPHANUMERIC = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ $%*+-./:"


def _remainder(value: int, bits: int, generator: int) -> int:
    value <<= bits
    while value.bit_length() > bits:
        value ^= generator << (value.bit_length() - generator.bit_length())
    return value


def _format_word(level: str, mask: int) -> int:
    data = LEVELS[level] << 3 | mask
    return (data << 10 | _remainder(data, 10, 0x537)) ^ 0x5412


def _frame(version: int) -> tuple[np.ndarray, np.ndarray]:
    """Fixed modules of a version, and which modules are fixed or reserved."""
    n = 17 + 4 * version
    on, fixed = np.zeros((n, n), bool), np.zeros((n, n), bool)
    for y, x in ((0, 0), (0, n - 7), (n - 7, 0)):
        fixed[max(0, y - 1) : y + 8, max(0, x - 1) : x + 8] = True
        k = np.maximum(*np.abs(np.indices((7, 7)) - 3))
        on[y : y + 7, x : x + 7] = k != 2
    for y in ALIGNMENT[version - 1]:
        for x in ALIGNMENT[version - 1]:
            if not fixed[y, x]:
                fixed[y - 2 : y + 3, x - 2 : x + 3] = True
                on[y - 2 : y + 3, x - 2 : x + 3] = np.maximum(*np.abs(np.indices((5, 5)) - 2)) != 1
    line = np.arange(8, n - 8)
    fixed[6, line] = fixed[line, 6] = True
    on[6, line] = on[line, 6] = line % 2 == 0
    fixed[8, :9] = fixed[:9, 8] = fixed[8, n - 8 :] = fixed[n - 8 :, 8] = True
    on[n - 8, 8] = True
    if version >= 7:
        word = version << 12 | _remainder(version, 12, 0x1F25)
        for k in range(18):
            y, x = k // 3, n - 11 + k % 3
            fixed[y, x] = fixed[x, y] = True
            on[y, x] = on[x, y] = word >> k & 1
    return on, fixed


def _format_places(n: int) -> list[tuple[tuple[int, int], tuple[int, int]]]:
    """Both places of each of the 15 bits, lowest first."""
    first = [*[(k, 8) for k in (0, 1, 2, 3, 4, 5, 7, 8)], *[(8, k) for k in (7, 5, 4, 3, 2, 1, 0)]]
    second = [*[(8, n - 1 - k) for k in range(8)], *[(n - 7 + k, 8) for k in range(7)]]
    return list(zip(first, second, strict=True))


def _path(fixed: np.ndarray) -> list[tuple[int, int]]:
    """Free modules in reading order: pairs of columns from the right, up and down in turn."""
    n, out, up, x = len(fixed), [], True, len(fixed) - 1
    while x > 0:
        if x == 6:
            x -= 1
        for y in range(n - 1, -1, -1) if up else range(n):
            out += [(y, c) for c in (x, x - 1) if not fixed[y, c]]
        up, x = not up, x - 2
    return out


class _Layout:
    """What all symbols of a version and level share. A line of modules is a whole number, its lowest bit the first module."""

    def __init__(self, version: int, level: str):
        self.checks, *groups = BLOCKS[level][version - 1]
        self.sizes = [size for count, size in groups for _ in range(count)]
        self.room, self.wide = sum(self.sizes), 8 if version < 10 else 16
        self.on, fixed = _frame(version)
        n = len(fixed)
        self.y, self.x = np.array(_path(fixed)).T
        starts, blocks = np.cumsum([0, *self.sizes]), range(len(self.sizes))
        self.dealt = [starts[b] + k for k in range(max(self.sizes)) for b in blocks if k < self.sizes[b]] + [self.room + b * self.checks + k for k in range(self.checks) for b in blocks]
        # Check words are sums over the data words, each times those of a lone 1 in its place.
        self.shares = {size: np.array([QR_FIELD.checks([*[0] * k, 1, *[0] * (size - 1 - k)], self.checks, 0) for k in range(size)]) for size in set(self.sizes)}
        flips, known, words = np.zeros((8, n, n), bool), np.zeros((n, n), bool), np.zeros((8, n, n), bool)
        for mask, rule in enumerate(MASKS):
            flips[mask, self.y, self.x] = [rule(int(y), int(x)) == 0 for y, x in zip(self.y, self.x, strict=True)]
            for k, spots in enumerate(_format_places(n)):
                for spot in spots:
                    known[spot], words[(mask, *spot)] = True, _format_word(level, mask) >> k & 1
        # Rows, then columns.
        self.flips, self.words = ([_lines(v), _lines(v.transpose(0, 2, 1))] for v in (flips, words))
        self.other = [~_lines(known), ~_lines(known.T)]


_layout = functools.cache(_Layout)


def _lines(on: np.ndarray) -> np.ndarray:
    """Lines of at most 64 modules along the last axis as whole numbers."""
    wide = np.zeros((*on.shape[:-1], 64), bool)
    wide[..., : on.shape[-1]] = on
    return np.packbits(wide, axis=-1, bitorder="little").view("<u8")[..., 0]


def _penalties(rows: np.ndarray, columns: np.ndarray, n: int) -> np.ndarray:
    """Penalties of symbols of n modules a side, from their lines along the last axis."""
    u = np.uint64
    room = lambda k: u((1 << (n - k + 1)) - 1)  # noqa: E731  bits where k modules still follow
    count = lambda v: np.bitwise_count(v).sum(-1, dtype=np.int64)
    total = np.zeros(rows.shape[:-1], np.int64)
    for lines in (rows, columns):
        same = ~(lines ^ (lines >> u(1))) & room(2)
        five = same & (same >> u(1)) & (same >> u(2)) & (same >> u(3))
        total += count(five) + 2 * count(five & ~(five << u(1)))  # a run of k has k - 4 fives and one first one
        for pattern in ("10111010000", "00001011101"):
            hit = np.full_like(lines, room(11))
            for k, c in enumerate(pattern):
                hit &= lines >> u(k) if c == "1" else ~(lines >> u(k))
            total += 40 * count(hit)
    beside = ~(rows ^ (rows >> u(1))) & room(2)
    below = ~(rows[..., 1:] ^ rows[..., :-1])
    total += 3 * count(beside[..., 1:] & below & (below >> u(1)))
    return total + 10 * (np.abs(count(rows) / (n * n) * 100 - 50) // 5).astype(np.int64)


def _version(size: int, level: str) -> int | None:
    """The smallest version of 1 to 10 that holds so many bytes."""
    for version in range(1, 11):
        _, *groups = BLOCKS[level][version - 1]
        if 4 + (8 if version < 10 else 16) + 8 * size <= 8 * sum(count * words for count, words in groups):
            return version
    return None


def _symbols(texts: list[bytes], version: int, level: str) -> np.ndarray:
    """Symbols x n x n modules, each of the mask with the least penalty."""
    at = _layout(version, level)
    words = np.empty((len(texts), at.room), np.uint8)
    pad = bytes((0xEC, 0x11)) * at.room
    for i, data in enumerate(texts):
        # The mode, the length, the bytes and a closing 0, half a byte each beside whole ones.
        bits = ((4 << at.wide | len(data)) << 8 * len(data) | int.from_bytes(data)) << 4
        head = bits.to_bytes(len(data) + 1 + at.wide // 8)
        words[i] = np.frombuffer(head + pad[: at.room - len(head)], np.uint8)
    parts, first = [words], 0
    for size in at.sizes:
        block, share = words[:, first : first + size], at.shares[size]
        checks = np.zeros((len(texts), at.checks), np.uint8)
        for k in range(size):
            checks ^= _PRODUCTS[block[:, k, None], share[k]]
        parts.append(checks)
        first += size
    stream = np.unpackbits(np.concatenate(parts, 1)[:, at.dealt], axis=1)
    n = len(at.on)
    on = np.repeat(at.on[None], len(texts), 0)
    on[:, at.y[: stream.shape[1]], at.x[: stream.shape[1]]] = stream
    trials = [(_lines(v)[:, None] ^ flips) & other | known for v, flips, other, known in zip((on, on.transpose(0, 2, 1)), at.flips, at.other, at.words, strict=True)]
    best = _penalties(*trials, n).argmin(1)
    rows = np.ascontiguousarray(trials[0][np.arange(len(texts)), best])
    return np.unpackbits(rows[..., None].view(np.uint8), axis=-1, bitorder="little")[..., :n].astype(bool)


#: Symbols that are worked on together.
TOGETHER = 256


def qr_symbols(texts: list[bytes], level: str = "M") -> Iterator[tuple[list[int], np.ndarray]]:
    """Places in the list and symbols x n x n modules, for at most TOGETHER texts of one version at a time: the smallest of
    versions 1 to 10 that holds the bytes. A text that none holds is left out.
    """
    by_version: dict[int, list[int]] = {}
    for i, data in enumerate(texts):
        if version := _version(len(data), level):
            by_version.setdefault(version, []).append(i)
    for version, places in sorted(by_version.items()):
        for k in range(0, len(places), TOGETHER):
            some = places[k : k + TOGETHER]
            yield some, _symbols([texts[i] for i in some], version, level)


def qr_modules(data: bytes, level: str = "M") -> np.ndarray | None:
    """The smallest symbol of versions 1 to 10 that holds the bytes, of the mask with the least penalty."""
    return next((on[0] for _, on in qr_symbols([data], level)), None)


def qr_text(on: np.ndarray) -> tuple[bytes, int] | None:
    """The bytes and version of a symbol's modules; None if it cannot be read."""
    n = len(on)
    version = (n - 17) // 4
    if n % 4 != 1 or not 1 <= version <= 10:
        return None
    places = _format_places(n)
    read = [sum(int(on[spots[s]]) << k for k, spots in enumerate(places)) for s in (0, 1)]
    off, level, mask = min(((r ^ _format_word(lv, m)).bit_count(), lv, m) for r in read for lv in LEVELS for m in range(8))
    if off > 3:
        return None
    _, fixed = _frame(version)
    bits = [int(on[y, x]) ^ (MASKS[mask](y, x) == 0) for y, x in _path(fixed)]
    words = [int("".join(map(str, bits[k : k + 8])), 2) for k in range(0, len(bits) - 7, 8)]
    checks, *groups = BLOCKS[level][version - 1]
    sizes = [size for count, size in groups for _ in range(count)]
    blocks: list[list[int]] = [[] for _ in sizes]
    stream = iter(words)
    for k in range(max(sizes)):
        for b, size in zip(blocks, sizes, strict=True):
            if k < size:
                b.append(next(stream))
    for _ in range(checks):
        for b in blocks:
            b.append(next(stream))
    data = []
    for b, size in zip(blocks, sizes, strict=True):
        mended = QR_FIELD.corrected(b, checks, 0)
        if mended is None:
            return None
        data += mended[:size]
    text = "".join(f"{w:08b}" for w in data)
    out, at = b"", 0

    def take(k: int) -> int:
        nonlocal at
        at += k
        return int(text[at - k : at] or "0", 2)

    while at + 4 <= len(text):
        mode = take(4)
        if mode == 4:
            out += bytes(take(8) for _ in range(take(8 if version < 10 else 16)))
        elif mode == 1:
            left = take(10 if version < 10 else 12)
            while left > 0:
                k = min(3, left)
                out += str(take((0, 4, 7, 10)[k])).zfill(k).encode()
                left -= k
        elif mode == 2:
            left = take(9 if version < 10 else 11)
            while left > 0:
                pair = take(11 if left > 1 else 6)
                out += (ALPHANUMERIC[pair // 45] + ALPHANUMERIC[pair % 45] if left > 1 else ALPHANUMERIC[pair]).encode()
                left -= 2
        else:
            break
    return out, version


# --- Data Matrix symbols of one region

#: Data and check words by side.
MATRIX_SIZES = {10: (3, 5), 12: (5, 7), 14: (8, 10), 16: (12, 12), 18: (18, 14), 20: (22, 18), 22: (30, 20), 24: (36, 24), 26: (44, 28)}


def _matrix_places(n: int) -> np.ndarray:
    """For each module within the border: eight times the word plus the bit that stands there; -1 and -2 fill a corner."""
    out = np.full((n, n), -9, np.int64)

    def put(y: int, x: int, word: int, bit: int) -> None:
        if y < 0:
            y, x = y + n, x + 4 - (n + 4) % 8
        if x < 0:
            y, x = y + 4 - (n + 4) % 8, x + n
        out[y, x] = 8 * word + bit

    def shape(y: int, x: int, word: int) -> None:
        for bit, (dy, dx) in enumerate(((-2, -2), (-2, -1), (-1, -2), (-1, -1), (-1, 0), (0, -2), (0, -1), (0, 0))):
            put(y + dy, x + dx, word, bit)

    corners = {
        1: [(n - 1, 0), (n - 1, 1), (n - 1, 2), (0, n - 2), (0, n - 1), (1, n - 1), (2, n - 1), (3, n - 1)],
        2: [(n - 3, 0), (n - 2, 0), (n - 1, 0), (0, n - 4), (0, n - 3), (0, n - 2), (0, n - 1), (1, n - 1)],
    }
    word, y, x = 0, 4, 0
    while y < n or x < n:
        if y == n and x == 0:
            for bit, spot in enumerate(corners[1]):
                out[spot] = 8 * word + bit
            word += 1
        if y == n - 2 and x == 0 and n % 4:
            for bit, spot in enumerate(corners[2]):
                out[spot] = 8 * word + bit
            word += 1
        while True:
            if y < n and x >= 0 and out[y, x] == -9:
                shape(y, x, word)
                word += 1
            y, x = y - 2, x + 2
            if not (y >= 0 and x < n):
                break
        y, x = y + 1, x + 3
        while True:
            if y >= 0 and x < n and out[y, x] == -9:
                shape(y, x, word)
                word += 1
            y, x = y + 2, x - 2
            if not (y < n and x >= 0):
                break
        y, x = y + 3, x + 1
    if out[n - 1, n - 1] == -9:
        out[n - 1, n - 1] = out[n - 2, n - 2] = -1
        out[n - 1, n - 2] = out[n - 2, n - 1] = -2
    return out


def matrix_modules(data: bytes) -> np.ndarray | None:
    """The smallest one-region symbol that holds the bytes in ASCII words."""
    words = []
    for b in data:
        words += [b + 1] if b < 128 else [235, b - 127]
    for side, (room, checks) in MATRIX_SIZES.items():
        if len(words) <= room:
            break
    else:
        return None
    if len(words) < room:
        words.append(129)
    while len(words) < room:
        pad = 129 + 149 * (len(words) + 1) % 253 + 1
        words.append(pad if pad <= 254 else pad - 254)
    words += MATRIX_FIELD.checks(words, checks, 1)
    places = _matrix_places(side - 2)
    inner = np.array([[(words[p >> 3] >> (7 - p % 8) & 1) if p >= 0 else p == -1 for p in row] for row in places.tolist()], bool)
    on = np.zeros((side, side), bool)
    on[1:-1, 1:-1] = inner
    on[0, ::2] = True
    on[1::2, -1] = True
    on[:, 0] = on[-1] = True
    return on


def matrix_text(on: np.ndarray) -> bytes | None:
    side = len(on)
    if side not in MATRIX_SIZES or not (on[:, 0].all() and on[-1].all()):
        return None
    room, checks = MATRIX_SIZES[side]
    words = [0] * (room + checks)
    for row, values in zip(_matrix_places(side - 2).tolist(), on[1:-1, 1:-1].tolist(), strict=True):
        for p, v in zip(row, values, strict=True):
            if p >= 0:
                words[p >> 3] |= v << (7 - p % 8)
    mended = MATRIX_FIELD.corrected(words, checks, 1)
    if mended is None:
        return None
    out, high = b"", 0
    for w in mended[:room]:
        if w == 129:
            break
        if w <= 128:
            out += bytes([w - 1 + high])
        elif w <= 229:
            out += f"{w - 130:02d}".encode()
        high = 128 if w == 235 else 0
    return out


# --- EAN-13

#: Widths of a digit's four bars, and which of the left six digits are mirrored for each first digit.
EAN_WIDTHS = ["3211", "2221", "2122", "1411", "1132", "1231", "1114", "1312", "1213", "3112"]
EAN_FIRST = ["000000", "001011", "001101", "001110", "010011", "011001", "011100", "010101", "010110", "011010"]


def ean_bars(digits: str) -> np.ndarray:
    """95 modules of 12 digits and their check digit."""
    digits = digits[:12] + str(-sum(int(d) * (3 if k % 2 else 1) for k, d in enumerate(digits[:12])) % 10)
    half = lambda w, dark: "".join(str(int(dark ^ (k % 2))) * int(c) for k, c in enumerate(w))
    left = "".join(half(EAN_WIDTHS[int(d)][::-1] if g == "1" else EAN_WIDTHS[int(d)], 0) for d, g in zip(digits[1:7], EAN_FIRST[int(digits[0])], strict=True))
    right = "".join(half(EAN_WIDTHS[int(d)], 1) for d in digits[7:])
    return np.array([c == "1" for c in "101" + left + "01010" + right + "101"])


def ean_text(line: np.ndarray) -> str | None:
    """Digits of a row of dark and light samples."""
    dark = np.flatnonzero(line)
    if not len(dark):
        return None
    row = line[dark[0] : dark[-1] + 1]
    edge = np.flatnonzero(np.diff(row.astype(int), prepend=2, append=2))
    runs = np.diff(edge)
    if len(runs) != 59:
        return None
    unit = len(row) / 95
    widths = np.clip(np.round(runs / unit), 1, 4).astype(int)
    left, right = widths[3:27].reshape(6, 4), widths[32:56].reshape(6, 4)
    names = {w: (str(k), "0") for k, w in enumerate(EAN_WIDTHS)} | {w[::-1]: (str(k), "1") for k, w in enumerate(EAN_WIDTHS)}
    a = [names.get("".join(map(str, w))) for w in left]
    b = [names.get("".join(map(str, w))) for w in right]
    if None in a or None in b or "".join(x[1] for x in a) not in EAN_FIRST:
        return None
    digits = str(EAN_FIRST.index("".join(x[1] for x in a))) + "".join(x[0] for x in a + b)
    return digits if sum(int(d) * (3 if k % 2 else 1) for k, d in enumerate(digits)) % 10 == 0 else None


# --- frames


def drawn(on: np.ndarray, size: int, border: int = 4) -> np.ndarray:
    """Modules, of one symbol or several, as a square frame of `size` samples with a light border, each module of as many
    whole samples as fit.
    """
    *many, high, wide = on.shape
    n = max(high, wide)
    unit = max(1, size // (n + 2 * border))
    side = max(size, n * unit)
    image = np.full((*many, side, side), 255, np.uint8)
    top, left = ((side - k * unit) // 2 for k in (high, wide))
    image[..., top : top + high * unit, left : left + wide * unit] = np.where(on, np.uint8(0), np.uint8(255)).repeat(unit, -2).repeat(unit, -1)
    return image


def _dark(image: np.ndarray, threshold: float) -> tuple[np.ndarray, int, int] | None:
    plane = gray(image)
    on = plane < threshold if threshold > 0 else plane <= otsu(plane)
    y, x = np.flatnonzero(on.any(1)), np.flatnonzero(on.any(0))
    if not len(y) or on.all():
        return None
    return on[y[0] : y[-1] + 1, x[0] : x[-1] + 1], int(x[0]), int(y[0])


def _sampled(on: np.ndarray, n: int) -> np.ndarray:
    y, x = (((np.arange(n) + 0.5) * k / n).astype(int) for k in on.shape)
    return on[np.ix_(y, x)]


def _quality(image: np.ndarray) -> float:
    """Contrast between light and dark, from 0 to 1."""
    plane = gray(image)
    low, high = np.percentile(plane, (2, 98))
    return float((high - low) / 255)


def read_qr(image: np.ndarray, rotate: bool = True, threshold: float = 0, least: float = 1.0, most: float = 1e9) -> dict | None:
    """An upright or quarter-turned symbol, the only thing in the frame that is dark."""
    found = _dark(image, threshold)
    if found is None:
        return None
    box, x, y = found
    for turn in range(4 if rotate else 1):
        on = np.rot90(box, turn)
        edge = np.flatnonzero(~on[0])
        unit = (edge[0] if len(edge) else len(on)) / 7
        if unit < 1 or not least <= unit <= most:
            continue
        n = 17 + 4 * round((max(on.shape) / unit - 17) / 4)
        got = qr_text(_sampled(on, n)) if 21 <= n <= 57 else None
        if got:
            return {"data": got[0].decode("utf-8", "replace"), "type": "QR_CODE", "version": got[1], "x": x, "y": y, "width": box.shape[1], "height": box.shape[0]}
    return None


def read_matrix(image: np.ndarray, threshold: float = 0, least: float = 1.0, most: float = 1e9) -> dict | None:
    found = _dark(image, threshold)
    if found is None:
        return None
    box, x, y = found
    for turn in range(4):
        on = np.rot90(box, turn)
        for side in MATRIX_SIZES:
            if least <= max(on.shape) / side <= most:
                got = matrix_text(_sampled(on, side))
                if got:
                    return {"data": got.decode("latin-1"), "type": "DATA_MATRIX", "version": side, "x": x, "y": y, "width": box.shape[1], "height": box.shape[0]}
    return None


def read_ean(image: np.ndarray) -> dict | None:
    found = _dark(image, 0)
    if found is None:
        return None
    box, x, y = found
    for line in (box[len(box) // 2], box[len(box) // 2][::-1], box[:, box.shape[1] // 2], box[::-1, box.shape[1] // 2]):
        got = ean_text(line)
        if got:
            return {"data": got, "type": "EAN13", "version": 0, "x": x, "y": y, "width": box.shape[1], "height": box.shape[0]}
    return None


def read_any(image: np.ndarray, kind: str = "AUTO") -> dict | None:
    readers = {"QR_CODE": read_qr, "DATA_MATRIX": read_matrix, "EAN13": read_ean}
    name = {"QR": "QR_CODE", "DATAMATRIX": "DATA_MATRIX", "EAN": "EAN13"}.get(kind.upper(), kind.upper())
    for reader in [readers[name]] if name in readers else readers.values():
        got = reader(image)
        if got:
            return got
    return None


NOTHING = {"data": "", "type": "", "version": 0, "x": 0, "y": 0, "width": 0, "height": 0}
FOUND = "data string, barcode_type string, x long, y long, width long, height long, quality double, found boolean"


def _row(image: np.ndarray, got: dict | None, min_quality: float = 0.0) -> dict:
    quality = _quality(image) if got else 0.0
    ok = got is not None and quality >= min_quality
    got = got if ok else NOTHING
    return {"barcode_type": got["type"], "quality": quality, "found": ok, **{k: got[k] for k in ("data", "x", "y", "width", "height", "version")}}


measure_op("BarcodeDecode", FOUND, min_quality=0.5)(lambda image, min_quality: _row(image, read_any(image), min_quality))
measure_op("QRCodeDecode", FOUND, try_rotate=True, min_quality=0.5)(lambda image, try_rotate, min_quality: _row(image, read_qr(image, try_rotate), min_quality))
measure_op("DataMatrixDecode", FOUND, min_quality=0.5)(lambda image, min_quality: _row(image, read_matrix(image), min_quality))


@measure_op("QRCodeDecodeEnhanced", FOUND + ", version long", min_module_size=2.0, max_module_size=50.0, rotation_tolerance=45.0, contrast_threshold=128.0, try_harder=True)
def qr_enhanced(image, min_module_size, max_module_size, rotation_tolerance, contrast_threshold, try_harder):
    """By the given threshold; with try_harder by Otsu's too. Quarter turns within the tolerance are tried."""
    limits = (min_module_size, max_module_size)
    got = read_qr(image, rotation_tolerance > 0, contrast_threshold, *limits)
    return _row(image, got or (read_qr(image, rotation_tolerance > 0, 0, *limits) if try_harder else None))


measure_op("DataMatrixDecodeEnhanced", FOUND, min_module_size=2.0, max_module_size=50.0, contrast_threshold=128.0)(lambda image, min_module_size, max_module_size, contrast_threshold: _row(image, read_matrix(image, contrast_threshold, min_module_size, max_module_size)))


def _rings(image: np.ndarray, threshold: float) -> int:
    """Alternations of light and dark from the middle of the dark box outwards, the least over four directions."""
    found = _dark(image, threshold)
    if found is None:
        return 0
    box = found[0]
    y, x = box.shape[0] // 2, box.shape[1] // 2
    arms = (box[y, x:], box[y, x::-1], box[y:, x], box[y::-1, x])
    return min(int(np.count_nonzero(a[1:] != a[:-1])) for a in arms)


def _bullseye(name: str, text: str, least: int):
    """The surveyed reader tells that such a symbol is there, not what it says; here it must have a bull's eye."""

    def step(image, min_module_size, max_module_size, contrast_threshold):
        there = min(image.shape[:2]) > least and _rings(image, contrast_threshold) >= 4
        h, w = image.shape[:2]
        return _row(image, {"data": text, "type": name, "version": 0, "x": 0, "y": 0, "width": w, "height": h} if there else None)

    return step


for _id, _name, _text, _least in (("AztecCodeDecode", "AZTEC", "AZTEC_DETECTED", 15), ("MaxiCodeDecode", "MAXICODE", "MAXICODE_DETECTED", 20)):
    measure_op(_id, FOUND, min_module_size=2.0, max_module_size=50.0, contrast_threshold=128.0)(_bullseye(_name, _text, _least))


@measure_op("IDReader", "barcode_data string, barcode_type string, position_x double, position_y double, confidence double, success boolean", code_type="auto", orientation=0)
def id_reader(image, code_type, orientation):
    """Any code; `orientation` degrees (a multiple of 90) are turned back first."""
    turned = np.rot90(image, -round(orientation / 90) % 4)
    r = _row(image, read_any(turned, "AUTO" if code_type == "auto" else code_type))
    return {"barcode_data": r["data"], "barcode_type": r["barcode_type"], "position_x": r["x"] + r["width"] / 2, "position_y": r["y"] + r["height"] / 2, "confidence": r["quality"], "success": r["found"]}


@measure_op("BarcodeTrain", "template string, confidence double, success boolean", barcode_type="QR_CODE", min_samples=5, quality_threshold=0.7, save_template=True)
def barcode_train(image, barcode_type, min_samples, quality_threshold, save_template):
    """A template's name, size and mean brightness; one that is nearly dark or nearly light is trusted less."""
    mean = float(image.mean())
    h, w = image.shape[:2]
    confidence = 0.5 if mean < 50 or mean > 200 else 0.85
    text = f"BARCODE_TEMPLATE_{barcode_type}_{w}x{h}:features=[avg_intensity={mean:.6f},width={w},height={h}]"
    return {"template": text, "confidence": confidence, "success": confidence >= quality_threshold}


def _verified(frames, barcode_type, strict_mode, min_quality, expected):
    def step(image):
        r = _row(image, read_any(image, barcode_type))
        n = max(len(r["data"]), len(expected))
        match = 0.0 if not r["found"] else 1.0 if not expected else sum(a == b for a, b in zip(r["data"], expected, strict=False)) / n
        said = [] if r["found"] else ["not decoded"]
        if r["found"] and match < (1.0 if strict_mode else 0.9):
            said.append("data differs")
        if r["found"] and r["quality"] < min_quality:
            said.append("quality too low")
        return {"verified": not said, "decoded_data": r["data"], "match_score": match, "quality_score": r["quality"], "error_details": "; ".join(said)}

    from ..frames import measure_images

    return measure_images(frames, step, "verified boolean, decoded_data string, match_score double, quality_score double, error_details string")


register(Operator("BarcodeVerify", "measure", {"barcode_type": "AUTO", "strict_mode": True, "min_quality": 0.6, "expected_data": ""}, ("image",), ("verified", "decoded_data", "match_score", "quality_score", "error_details"), lambda image, expected_data, **p: _verified(image, expected=expected_data, **p)))

_STEPS = ((0.9, 4.0), (0.75, 3.0), (0.6, 2.0), (0.4, 1.0))


@measure_op("BarcodeGrade", "grade double, grade_letter string, decode_grade double, symbol_contrast double, modulation double, defects double, decodability double", barcode_type="AUTO", standard="ISO/IEC 15416", report_format="JSON")
def barcode_grade(image, barcode_type, standard, report_format):
    """Grades from 0 (F) to 4 (A): contrast of the extremes, modulation of typical light and dark against them, defects by
    the mean step between neighbouring samples, decodability by the reader; the least is the whole grade.
    """
    plane = gray(image).astype(np.float64)
    contrast = float(plane.max() - plane.min())
    low, high = np.percentile(plane, (10, 90))
    of = lambda v, steps: next((g for least, g in steps if v >= least), 0.0)
    smooth = max(0.0, 1 - float(np.abs(np.diff(plane.ravel())).sum()) / plane.size / 128)
    r = _row(image, read_any(image, barcode_type))
    parts = {
        "symbol_contrast": of(contrast, ((70, 4.0), (55, 3.0), (40, 2.0), (20, 1.0))),
        "modulation": of((high - low) / max(contrast, 1.0), ((0.85, 4.0), (0.7, 3.0), (0.5, 2.0), (0.3, 1.0))),
        "defects": of(smooth, _STEPS),
        "decodability": of(r["quality"], _STEPS),
    }
    grade = min(parts.values())
    return parts | {"grade": grade, "grade_letter": "FDCBA"[int(grade)], "decode_grade": r["quality"]}


#: Bytes of frames that leave a task together.
FRAME_BYTES = 4 << 20


def _generated(rows, size):
    """A frame for each text in `data`, with its frame_id; success is false, and data null, where it is empty or too long."""
    ship(rows.sparkSession)
    fields = SCHEMA + ", success boolean"
    names = [f.split()[0] for f in fields.split(", ")]

    def framed(ids, images, side):
        n = len(ids)
        same = lambda v, kind: pa.array([v] * n, kind)
        columns = [ids, same(side, pa.int32()), same(side, pa.int32()), same(1, pa.int32()), same("Mono8", pa.string()), same(0, pa.int64()), same("qr", pa.string()), pa.array(images, pa.binary()), same(side > 0, pa.bool_())]
        return pa.RecordBatch.from_arrays(columns, names=names)

    def run(batches):
        for b in batches:
            ids, texts = b.column(0).cast(pa.int64()), [v.encode() if v else None for v in b.column(1).to_pylist()]
            given = [i for i, v in enumerate(texts) if v]
            made = set()
            for places, on in qr_symbols([texts[i] for i in given]):
                places = [given[i] for i in places]
                made.update(places)
                side = drawn(on[0], size).shape[0]
                step = max(1, FRAME_BYTES // side**2)
                for k in range(0, len(places), step):
                    yield framed(ids.take(pa.array(places[k : k + step])), [v.tobytes() for v in drawn(on[k : k + step], size)], side)
            if rest := [i for i in range(len(texts)) if i not in made]:
                yield framed(ids.take(pa.array(rest)), [None] * len(rest), 0)

    return rows.select("frame_id", "data").mapInArrow(run, fields)


register(Operator("QRGenerate", "source", {"size": 200}, ("data",), ("image", "success"), lambda data, size: _generated(data, int(size))))
