"""Byte-pair encoder job (B1 'bpe', B4, B6).

The codec itself is a per-row library (tiktoken); this module applies it
to a text column in Arrow batches. The encoder is described by a small,
picklable spec with caller-supplied ranks and is built once per Python
worker. With only the 256 single-byte ranks the ids are the UTF-8 bytes.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, functions as F, types as T

# The GPT-2 pre-tokenisation pattern and end-of-text marker
# (public tiktoken definitions).
GPT2_PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
END_OF_TEXT = "<|endoftext|>"


@dataclass(frozen=True)
class BpeSpec:
    name: str
    ranks: dict = field(hash=False, compare=False)
    special: dict = field(hash=False, compare=False)
    pattern: str = GPT2_PATTERN


def byte_level_spec() -> BpeSpec:
    """256 single-byte ranks plus the end-of-text marker as id 256."""
    return BpeSpec("bytes256", {bytes([i]): i for i in range(256)}, {END_OF_TEXT: 256})


SLICE_CHARS = 1 << 20       # characters of the texts encoded at once

_CACHE: dict = {}


def _encoding(spec: BpeSpec):
    enc = _CACHE.get(spec.name)
    if enc is None:
        import tiktoken
        enc = tiktoken.Encoding(spec.name, pat_str=spec.pattern,
                                mergeable_ranks=spec.ranks, special_tokens=spec.special)
        _CACHE[spec.name] = enc
    return enc


def eos_id(spec: BpeSpec, newline_id: int | None = None) -> int:
    """End id (B4): the codec's end-of-text token if it has one, else the
    first id of '\\n'."""
    if END_OF_TEXT in spec.special:
        return int(spec.special[END_OF_TEXT])
    return int(_encoding(spec).encode_ordinary("\n")[0]) if newline_id is None else newline_id


def slices(texts: pd.Series, size: int = SLICE_CHARS) -> Iterator[pd.Series]:
    """Neighbouring rows of a batch of texts without nulls, a new slice at
    each multiple of ``size`` characters; at least one slice."""
    at = np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts))) // size
    for part in np.split(np.arange(len(texts)), np.flatnonzero(at[1:] != at[:-1]) + 1):
        yield texts.iloc[part]


def encode_slices(texts: pd.Series, spec: BpeSpec, end: int | None) -> Iterator[pd.Series]:
    """4-byte ids of a batch's texts, slice by slice; ``end`` is appended."""
    enc, last = _encoding(spec), np.array([] if end is None else [end], np.int32)
    for rows in slices(texts.fillna("")):
        ids = (enc.encode_to_numpy(t, disallowed_special="all", allowed_special=set()) for t in rows)
        yield pd.Series([np.append(i.astype(np.int32), last) for i in ids], dtype=object)


def bpe_encode(text: Column, spec: BpeSpec | None = None, add_eos: bool = True) -> Column:
    """ARRAY<INT> of ids for each text (whole text), end id appended.
    Texts holding the end-of-text marker make the task fail, as the codec
    refuses them; guard first with ``check_special``. Ids are 4-byte arrays
    and leave the worker in slices of ``SLICE_CHARS`` characters, so it holds
    a batch of texts and the ids of one slice or one text."""
    spec = spec or byte_level_spec()
    end = eos_id(spec)

    @F.pandas_udf(T.ArrayType(T.IntegerType()))
    def _enc(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            yield from encode_slices(s, spec, end if add_eos else None)

    return _enc(text)
