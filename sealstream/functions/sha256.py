"""SHA-256 that stops after whole blocks and goes on elsewhere.

The state after the first blocks of a message is eight words. So all of a message but its end can be hashed in one
task, and the end, when it is known, in another, which needs the state, the bytes after the last whole block, and the length.
"""

from __future__ import annotations

import ctypes
import struct
from math import isqrt

BLOCK = 64


def _primes(n: int) -> list[int]:
    found: list[int] = []
    k = 2
    while len(found) < n:
        if all(k % p for p in found):
            found.append(k)
        k += 1
    return found


def _cube_root(n: int) -> int:
    low, high = 0, 1 << (n.bit_length() // 3 + 1)
    while low < high:
        mid = (low + high + 1) // 2
        low, high = (mid, high) if mid ** 3 <= n else (low, mid - 1)
    return low


WORD = 0xFFFFFFFF
START = [isqrt(p << 64) & WORD for p in _primes(8)]  # fractions of square roots
ROUND = [_cube_root(p << 96) & WORD for p in _primes(64)]  # fractions of cube roots


def _turn(x: int, n: int) -> int:
    return x >> n | x << 32 - n & WORD


def _compress(state: list[int], block: bytes) -> list[int]:
    w = list(struct.unpack(">16I", block))
    for k in range(16, 64):
        a, b = w[k - 15], w[k - 2]
        w.append((w[k - 16] + (_turn(a, 7) ^ _turn(a, 18) ^ a >> 3) + w[k - 7] + (_turn(b, 17) ^ _turn(b, 19) ^ b >> 10)) & WORD)
    a, b, c, d, e, f, g, h = state
    for k in range(64):
        one = (h + (_turn(e, 6) ^ _turn(e, 11) ^ _turn(e, 25)) + (e & f ^ ~e & WORD & g) + ROUND[k] + w[k]) & WORD
        two = (_turn(a, 2) ^ _turn(a, 13) ^ _turn(a, 22)) + (a & b ^ a & c ^ b & c)
        a, b, c, d, e, f, g, h = one + two & WORD, a, b, c, d + one & WORD, e, f, g
    return [x + y & WORD for x, y in zip(state, (a, b, c, d, e, f, g, h))]


class _Context(ctypes.Structure):
    """The documented layout of the library's hash context."""

    _fields_ = [("h", ctypes.c_uint32 * 8), ("low", ctypes.c_uint32), ("high", ctypes.c_uint32),
                ("data", ctypes.c_uint32 * 16), ("num", ctypes.c_uint), ("size", ctypes.c_uint)]


def _library():
    """The update function of the library that hashlib itself uses, where it gives right states; else None."""
    try:
        import _hashlib

        lib = ctypes.CDLL(_hashlib.__file__)
        update = lib.SHA256_Update
        update.argtypes = [ctypes.c_void_p, ctypes.c_char_p, ctypes.c_size_t]
        lib.SHA256_Init.argtypes = [ctypes.c_void_p]
        context = _Context()
        lib.SHA256_Init(ctypes.byref(context))
        if list(context.h) != START or update(ctypes.byref(context), bytes(range(BLOCK)), BLOCK) != 1:
            return None
        return update if list(context.h) == _compress(START, bytes(range(BLOCK))) else None
    except (ImportError, OSError, AttributeError):
        return None


_update = _library()


def _advance(state: list[int], blocks: bytes) -> list[int]:
    """The state after whole blocks."""
    if _update is None:
        for at in range(0, len(blocks), BLOCK):
            state = _compress(state, blocks[at:at + BLOCK])
        return state
    context = _Context((ctypes.c_uint32 * 8)(*state), size=32)
    _update(ctypes.byref(context), blocks, len(blocks))
    return list(context.h)


class Sha256:
    """A running hash: ``update`` it, save it with ``saved``, resume it with ``Sha256.resumed``."""

    def __init__(self):
        self.state, self.rest, self.length = START, b"", 0

    def update(self, data: bytes) -> None:
        self.length += len(data)
        if len(self.rest) + len(data) < BLOCK:
            self.rest += data
            return
        data = self.rest + data if self.rest else data
        whole = len(data) - len(data) % BLOCK
        self.state, self.rest = _advance(self.state, data[:whole]), data[whole:]

    def saved(self) -> tuple[bytes, bytes, int]:
        """The state, the bytes since the last whole block, and the length."""
        return struct.pack(">8I", *self.state), bytes(self.rest), self.length

    @classmethod
    def resumed(cls, state: bytes, rest: bytes, length: int) -> Sha256:
        own = cls()
        own.state, own.rest, own.length = list(struct.unpack(">8I", state)), rest, length
        return own

    def digest(self) -> bytes:
        end = self.rest + b"\x80"
        end += bytes((BLOCK - 8 - len(end)) % BLOCK) + struct.pack(">Q", 8 * self.length)
        return struct.pack(">8I", *_advance(self.state, end))


def finished(state: bytes, rest: bytes, length: int, end: bytes) -> bytes:
    """Digest of a message whose beginning was saved and that ends with ``end``."""
    own = Sha256.resumed(state, rest, length)
    own.update(end)
    return own.digest()
