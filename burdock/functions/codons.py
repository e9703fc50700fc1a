"""Translation over the buffer of an Arrow column. Tasks import this module alone."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from ..schema import CODONS
from .sixmers import steps

_BASES = np.full(256, 4, np.uint8)
_BASES[list(b"TCAG")] = range(4)
#: Residue of three letters as digits to base 5; 4 is any other letter.
_RESIDUES = np.full(125, ord("X"), np.uint8)
for _codon, _residue in CODONS.items():
    _RESIDUES[int(sum(int(_BASES[ord(c)]) * 5 ** (2 - k) for k, c in enumerate(_codon)))] = ord(_residue)


def _step(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The residues before each text's first stop, laid end to end, and how many a text has."""
    texts = texts.cast(pa.large_string())
    edges = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[edges[0] : edges[-1]]
    if len(data) and data.max() > 127:  # a letter is one place, whatever its bytes
        return _step(pc.replace_substring_regex(texts, "[^\\x00-\\x7F]", "?"))
    starts = edges[:-1] - edges[0]
    n = np.diff(edges) // 3
    ends = np.cumsum(n)
    first = ends - n
    at = np.repeat(starts - 3 * first, n) + 3 * np.arange(ends[-1])
    digits = _BASES[data]
    residues = _RESIDUES[digits[at] * 25 + digits[at + 1] * 5 + digits[at + 2]]
    stops = np.append(np.flatnonzero(residues == ord("*")), len(residues))
    lens = np.minimum(stops[np.searchsorted(stops, first)], ends) - first
    kept = np.repeat(first - np.cumsum(lens) + lens, lens) + np.arange(lens.sum())
    return residues[kept], lens


def proteins(texts: pa.Array) -> pa.Array:
    """Frame 0 of upper-case texts up to the first stop; a codon with another letter than TCAG is X, null is empty."""
    texts = texts.fill_null("")
    done = [_step(texts.slice(i, j - i)) for i, j in steps(texts)]
    residues = np.concatenate([np.zeros(0, np.uint8), *(r for r, _ in done)])
    edges = np.concatenate([[0], np.cumsum(np.concatenate([np.zeros(0, np.int64), *(n for _, n in done)]))]).astype(np.int32)
    return pa.StringArray.from_buffers(len(texts), pa.py_buffer(edges), pa.py_buffer(residues))
