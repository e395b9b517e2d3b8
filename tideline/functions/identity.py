"""Replica identities: unsigned 64-bit numbers, kept as decimal(20,0) so that they order as unsigned."""

from __future__ import annotations

import os
import uuid

_OFFSET, _PRIME = 0xCBF29CE484222325, 0x100000001B3


def fnv1a_64(text: str) -> int:
    out = _OFFSET
    for b in text.encode():
        out = (out ^ b) * _PRIME & 0xFFFFFFFFFFFFFFFF
    return out


def default_replica() -> int:
    """Host bits above, process bits below."""
    return (fnv1a_64(f"{uuid.getnode():x}") & 0x7FFFFFFF) << 32 | os.getpid() & 0xFFFFFFFF
