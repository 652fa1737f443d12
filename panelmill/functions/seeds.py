"""Deterministic seeds by label, for use inside grouped functions."""

from __future__ import annotations

import hashlib
import json

import numpy as np


def derive_seed(base: int, label: str) -> int:
    """First four bytes, big endian, of the sha256 of "base:label"."""
    return int.from_bytes(hashlib.sha256(f"{base}:{label}".encode()).digest()[:4], "big")


def rng(base: int, label: str) -> np.random.Generator:
    return np.random.default_rng(derive_seed(base, label))


def cell_key(parts: dict) -> str:
    """16 hex digits that name one cell of the evaluation grid."""
    return hashlib.sha256(json.dumps(parts, sort_keys=True).encode()).hexdigest()[:16]
