"""Random draws as pure functions of a key, so that they do not depend on partitioning."""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import Column, functions as F

SIGNS = 128  # bits of a digest


def _digest(*key: Column) -> Column:
    return F.md5(F.concat_ws("|", *[k.cast("string") for k in key]))


def uniform(*key: Column) -> Column:
    """Uniform on 0, 1/2^32, ..., 1 - 1/2^32: the first 32 bits of the key's MD5."""
    return F.conv(F.substring(_digest(*key), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def normal(*key: Column) -> Column:
    """Standard normal (Box-Muller) from two uniforms of the key."""
    first = uniform(*key, F.lit(1)) + F.lit(1 / 4294967296.0)
    second = uniform(*key, F.lit(2))
    return F.sqrt(F.lit(-2.0) * F.ln(first)) * F.cos(F.lit(2.0) * F.pi() * second)


def sign(*key: Column) -> Column:
    """+1 or -1 with equal chance: the top bit of the key's MD5."""
    return F.when(F.substring(_digest(*key), 1, 1) < "8", F.lit(1.0)).otherwise(F.lit(-1.0))


def permutation_sign(seed: Column, signal: Column, perm: Column, subject: Column) -> Column:
    """+1 or -1 with equal chance: a bit of the MD5 of (seed, signal, block of `SIGNS` permutations, subject)."""
    digest = _digest(seed, signal, F.floor(perm / SIGNS), subject)
    digit = F.conv(F.substring(digest, F.floor(perm % SIGNS / 4).cast("int") + 1, F.lit(1)), 16, 10).cast("int")
    bit = F.floor(digit / F.pow(F.lit(2), 3 - perm % 4)) % 2
    return F.when(bit == 0, F.lit(1.0)).otherwise(F.lit(-1.0))


def signs(seed: int, signal: str, permutations: int, subject: int) -> np.ndarray:
    """`permutation_sign(seed, signal, perm, subject)` of perm 0, 1, ... inside a task, with a digest for `SIGNS` of them."""
    digests = b"".join(hashlib.md5(f"{seed}|{signal}|{block}|{subject}".encode(), usedforsecurity=False).digest()
                       for block in range(-(-permutations // SIGNS)))
    return 1.0 - 2.0 * np.unpackbits(np.frombuffer(digests, np.uint8))[:permutations]


def shuffled_cells(seed: int, signal: str, perm: int, subjects: np.ndarray) -> np.ndarray:
    """A random order of 2 cells for each subject (cells 2i and 2i + 1 of subject i): that of the two halves of the
    MD5 of (seed, signal, permutation, subject), read as numbers."""
    digests = b"".join(hashlib.md5(f"{seed}|{signal}|{perm}|{s}".encode(), usedforsecurity=False).digest() for s in subjects)
    return np.argsort(np.frombuffer(digests, ">u8"), kind="stable")
