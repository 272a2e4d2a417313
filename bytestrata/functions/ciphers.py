"""AES in cipher block chaining, the key derivation of the openssl tool, and what goes with them."""

from __future__ import annotations

import hashlib
import hmac
from functools import cache

import numpy as np


def _times(a: int, b: int) -> int:
    """The product in the field of 256 elements."""
    out = 0
    while b:
        out ^= a * (b & 1)
        a, b = (a << 1) ^ (0x11B if a & 0x80 else 0), b >> 1
    return out


@cache
def _boxes() -> tuple[np.ndarray, np.ndarray]:
    """The substitution of bytes and its inverse, from the field's inverses and the affine map."""
    box = np.zeros(256, np.uint8)
    for x in range(256):
        inverse = next((y for y in range(256) if _times(x, y) == 1), 0)
        turned = inverse
        for k in range(1, 5):
            turned ^= (inverse << k | inverse >> 8 - k) & 0xFF
        box[x] = turned ^ 0x63
    back = np.zeros(256, np.uint8)
    back[box] = np.arange(256, dtype=np.uint8)
    return box, back


@cache
def _multiples(by: int) -> np.ndarray:
    return np.array([_times(x, by) for x in range(256)], np.uint8)


def _round_keys(key: bytes) -> np.ndarray:
    box, words = _boxes()[0], [list(key[k : k + 4]) for k in range(0, len(key), 4)]
    n, carry = len(words), 1
    while len(words) < 4 * (n + 7):
        w = list(words[-1])
        if len(words) % n == 0:
            w = [int(box[x]) for x in w[1:] + w[:1]]
            w[0] ^= carry
            carry = _times(carry, 2)
        elif n > 6 and len(words) % n == 4:
            w = [int(box[x]) for x in w]
        words.append([a ^ b for a, b in zip(words[-n], w, strict=True)])
    return np.array(words, np.uint8).reshape(-1, 16)


#: Where each byte of a column-wise state goes when rows are shifted back.
_BACK = np.array([(4 * ((k // 4 - k % 4) % 4) + k % 4) for k in range(16)])


def decrypt(data: bytes, key: bytes, iv: bytes, padded: bool = False) -> bytes:
    """FN-6: all blocks at once; padding is checked and taken off if there is to be some. Raises ValueError."""
    if len(key) not in (16, 24, 32) or len(iv) != 16 or not data or len(data) % 16:
        raise ValueError("not a whole number of blocks")
    keys, back = _round_keys(key), _boxes()[1]
    blocks = np.frombuffer(data, np.uint8).reshape(-1, 16)
    state = blocks ^ keys[-1]
    for k in range(len(keys) - 2, -1, -1):
        state = back[state[:, _BACK]] ^ keys[k]
        if k:
            columns = state.reshape(-1, 4, 4)
            mixed = np.zeros_like(columns)
            for turn, by in enumerate((14, 11, 13, 9)):
                mixed ^= _multiples(by)[np.roll(columns, -turn, 2)]
            state = mixed.reshape(-1, 16)
    before = np.concatenate([np.frombuffer(iv, np.uint8)[None, :], blocks[:-1]])
    out = (state ^ before).tobytes()
    if padded:
        n = out[-1]
        if not 1 <= n <= 16 or out[-n:] != bytes([n]) * n:
            raise ValueError("no padding")
        out = out[:-n]
    return out


#: Where each byte goes when rows are shifted.
_ON = np.argsort(_BACK)


def encrypt(data: bytes, key: bytes, iv: bytes, padded: bool = False) -> bytes:
    """The inverse of decrypt, a block after the other."""
    if padded:
        n = 16 - len(data) % 16
        data += bytes([n]) * n
    keys, box, last, out = _round_keys(key), _boxes()[0], np.frombuffer(iv, np.uint8), bytearray()
    for at in range(0, len(data), 16):
        state = np.frombuffer(data[at : at + 16], np.uint8) ^ last ^ keys[0]
        for k in range(1, len(keys)):
            state = box[state][_ON]
            if k < len(keys) - 1:
                columns = state.reshape(4, 4)
                mixed = np.zeros_like(columns)
                for turn, by in enumerate((2, 3, 1, 1)):
                    mixed ^= _multiples(by)[np.roll(columns, -turn, 1)]
                state = mixed.reshape(16)
            state = state ^ keys[k]
        last = state
        out += state.tobytes()
    return bytes(out)


def bytes_to_key(password: bytes, salt: bytes, digest: str, key: int, iv: int) -> tuple[bytes, bytes]:
    """FN-7: one round of the digest over what came before, the password and the salt, until key and iv are full."""
    out, last = b"", b""
    while len(out) < key + iv:
        last = hashlib.new(digest, last + password + salt).digest()
        out += last
    return out[:key], out[key : key + iv]


def hmac_sha1(key: bytes, message: bytes) -> bytes:
    """FN-5."""
    return hmac.new(key, message, hashlib.sha1).digest()
