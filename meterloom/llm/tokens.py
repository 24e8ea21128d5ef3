"""Small helpers of the operators on token ids."""

from __future__ import annotations

import numpy as np
import pyarrow as pa


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def as_bytes(values: pa.Array) -> list[bytes]:
    """The values of a binary array without nulls; slicing one buffer is several times faster than ``to_pylist``."""
    if not len(values):
        return []
    at = np.frombuffer(values.buffers()[1], np.int32)[values.offset : values.offset + len(values) + 1].tolist()
    raw = values.buffers()[2].to_pybytes() if values.buffers()[2] is not None else b""
    return [raw[a:b] for a, b in zip(at, at[1:])]


def grown(a: np.ndarray, n: int) -> np.ndarray:
    """``a``, or a longer copy with room for ``n`` values."""
    if n <= len(a):
        return a
    out = np.zeros(max(n, 2 * len(a)), a.dtype)
    out[: len(a)] = a
    return out
