"""Heads of SHA-256 for many messages that differ in their last digits, with numpy: a round is done for all of them at once."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np

_MASK = 0xFFFFFFFF
#: Digits that vary, messages of a piece (as many as a core's cache has room for), and of how few each is hashed by itself.
DIGITS, PIECE, FEW = 5, 20_000, 2000


def _root(x: int, k: int) -> int:
    low, high = 0, 1 << (x.bit_length() // k + 1)
    while low < high:
        mid = (low + high + 1) // 2
        low, high = (mid, high) if mid**k <= x else (low, mid - 1)
    return low


_PRIMES = [p for p in range(2, 312) if all(p % q for q in range(2, math.isqrt(p) + 1))]
#: The constants of SHA-256: fractions of the cube roots of 64 primes and of the square roots of eight.
_K = [_root(p << 96, 3) & _MASK for p in _PRIMES]
_H = [_root(p << 64, 2) & _MASK for p in _PRIMES[:8]]
#: Two rotations and a third, or a shift.
_E, _A, _NEAR, _FAR = (6, 11, 25, True), (2, 13, 22, True), (17, 19, 10, False), (7, 18, 3, False)
#: The same as arrays, which numpy takes without converting them.
_KS = [np.array(k, np.uint32) for k in _K]
#: What all pieces of a worker are worked out in.
_ROOM = np.empty((28, PIECE), np.uint32)
_BITS = [np.array(i, np.uint32) for i in range(33)]


def _mixed(x: int, a: int, b: int, c: int, turns: bool) -> int:
    turned = lambda k: (x >> k | x << (32 - k)) & _MASK
    return turned(a) ^ turned(b) ^ (turned(c) if turns else x >> c)


def _mix(x: np.ndarray, a: int, b: int, c: int, turns: bool, out: np.ndarray, side: np.ndarray) -> np.ndarray:
    right, left, xor = np.right_shift, np.left_shift, np.bitwise_xor
    right(x, _BITS[a], out)
    xor(out, left(x, _BITS[32 - a], side), out)
    xor(out, right(x, _BITS[b], side), out)
    xor(out, left(x, _BITS[32 - b], side), out)
    xor(out, right(x, _BITS[c], side), out)
    return xor(out, left(x, _BITS[32 - c], side), out) if turns else out


def _next_word(w: list, t: int, own: np.ndarray, out: np.ndarray, side: np.ndarray) -> None:
    """The word of round t in the place of that of round t - 16. Words that are the same for all messages are ints."""
    first = w[t % 16]
    known, begun = (first, False) if isinstance(first, int) else (0, True)
    for at, how in ((t + 1, _FAR), (t + 9, None), (t + 14, _NEAR)):
        x = w[at % 16]
        if isinstance(x, int):
            known += _mixed(x, *how) if how else x
            continue
        x = _mix(x, *how, out, side) if how else x
        if begun:
            np.add(own, x, own)
        else:
            np.copyto(own, x)
            begun = True
    if begun and known & _MASK:
        np.add(own, np.uint32(known & _MASK), own)
    w[t % 16] = own if begun else known & _MASK


def heads(prefix: bytes, tails: np.ndarray, width: int) -> np.ndarray:
    """The first 60 bits of the hash of the prefix and each tail, of `width` bytes (5 at most), as tails() gives them. A message is one block: 55 bytes at most."""
    if len(prefix) + width > 55 or not 0 < width <= DIGITS:
        raise ValueError("no messages of one block with such tails")
    n, (i, off) = len(tails), divmod(len(prefix), 4)
    raw = prefix.ljust(64, b"\0")
    w: list = [int.from_bytes(raw[j : j + 4], "big") for j in range(0, 64, 4)]
    w[15] = 8 * (len(prefix) + width)
    room = _ROOM[:, :n] if n <= PIECE else np.empty((28, n), np.uint32)
    words, state, (ab, bc, out, side) = room[:16], room[16:24], room[24:]
    moved = tails >> np.uint64(8 * off)
    np.copyto(words[i], (moved >> np.uint64(32)).astype(np.uint32) | np.uint32(w[i]))
    np.copyto(words[i + 1], moved.astype(np.uint32))
    w[i], w[i + 1] = words[i], words[i + 1]
    if off + width == 8:  # what ends the messages is in the next word
        w[i + 2] = 0x80000000
    a, b, c, d, e, f, g, h = _H
    for t in range(i):  # the same for all messages
        one = h + _mixed(e, *_E) + (g ^ (e & (f ^ g))) + _K[t] + w[t]
        two = _mixed(a, *_A) + ((a & b) | (c & (a | b)))
        a, b, c, d, e, f, g, h = (one + two) & _MASK, a, b, c, (d + one) & _MASK, e, f, g
    for x, v in zip(state, (a, b, c, d, e, f, g, h), strict=True):
        x.fill(v)
    a, b, c, d, e, f, g, h = state
    add, xor = np.add, np.bitwise_xor
    xor(b, c, bc)
    for t in range(i, 64):
        if t > 15:
            _next_word(w, t, words[t % 16], out, side)
        if isinstance(w[t % 16], int):
            add(h, np.uint32((w[t % 16] + _K[t]) & _MASK), h)
        else:
            add(h, w[t % 16], h)
            add(h, _KS[t], h)
        add(h, _mix(e, *_E, out, side), h)
        xor(f, g, out)
        np.bitwise_and(out, e, out)
        xor(out, g, out)
        add(h, out, h)
        add(d, h, d)
        xor(a, b, ab)
        np.bitwise_and(bc, ab, bc)
        xor(bc, b, bc)
        add(h, bc, h)
        add(h, _mix(a, *_A, out, side), h)
        ab, bc = bc, ab
        a, b, c, d, e, f, g, h = h, a, b, c, d, e, f, g
    add(a, np.uint32(_H[0]), a)
    add(b, np.uint32(_H[1]), b)
    return (a.astype(np.uint64) << np.uint64(28)) | (b >> _BITS[4])


def tails(low: int, high: int, width: int) -> np.ndarray:
    """Numbers as digits with leading zeros and the bit that ends a message, from the left of 8 bytes."""
    v, out = np.arange(low, high, dtype=np.uint64), np.full(high - low, 0x80 << (56 - 8 * width), np.uint64)
    for k in range(width):
        out |= (v // np.uint64(10 ** (width - 1 - k)) % np.uint64(10) + np.uint64(48)) << np.uint64(56 - 8 * k)
    return out


_TAILS: dict[int, np.ndarray] = {}


def drawn(seed: int, repetition: int, low: int, high: int, n: int) -> Iterator[np.ndarray]:
    """Of slots low to high - 1 the numbers from 0 to n - 1 that bootstrap.draw() gives, a piece after the other."""
    head = f"{seed}:{repetition}:".encode()
    while low < high:
        if low < 10**DIGITS:  # as many digits as they have
            width = len(str(low))
            prefix, base, end = head, 0, min(high, 10**width, low - low % PIECE + PIECE)
        else:
            width, base = DIGITS, low - low % 10**DIGITS
            prefix, end = head + str(low // 10**DIGITS).encode(), min(high, low - low % PIECE + PIECE)
        if end - low < FEW:
            got = np.array([int(hashlib.sha256(head + b"%d" % s).hexdigest()[:15], 16) for s in range(low, end)], np.uint64)
        else:
            if width not in _TAILS:
                _TAILS[width] = tails(0, 10**width, width)
            got = heads(prefix, _TAILS[width][low - base : end - base], width)
        yield (got - got // np.uint64(n) * np.uint64(n)).astype(np.int64)
        low = end
