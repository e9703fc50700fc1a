"""The six-mer kernel over the buffer of an Arrow column. Tasks import this module alone: no pandas, no tables made at import."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from ..schema import GROUPS, SIXMERS

_LUT = np.full(256, 255, np.uint8)
for _i, _g in enumerate(GROUPS):
    _LUT[[ord(c) for c in _g + _g.lower()]] = _i
#: Other characters whose upper case holds ASCII letters, and these letters (fixed values).
LETTERS = {
    "\u00df": "SS", "\u0131": "I", "\u0149": "N", "\u017f": "S", "\u01f0": "J", "\u1e96": "H", "\u1e97": "T", "\u1e98": "W", "\u1e99": "Y",
    "\u1e9a": "A", "\ufb00": "FF", "\ufb01": "FI", "\ufb02": "FL", "\ufb03": "FFI", "\ufb04": "FFL", "\ufb05": "ST", "\ufb06": "ST",
}
#: The same as UTF-8, filled up with blanks: no text changes its length, and a blank is no residue.
_SAME = [(k.encode(), v.encode().ljust(len(k.encode()))) for k, v in LETTERS.items()]
_LEAD = np.zeros(256, bool)
_LEAD[[k[0] for k, _ in _SAME]] = True


def residue_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All texts laid end to end as UTF-8, and where each begins; null counts as empty."""
    texts = (texts.fill_null("") if texts.null_count else texts).cast(pa.large_string())
    edges = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int64)
    held = texts.buffers()[2]
    data = np.frombuffer(held, np.uint8)[edges[0] : edges[-1]] if held is not None else np.zeros(0, np.uint8)
    at = np.flatnonzero(_LEAD[data])
    if len(at):
        data = data.copy()
        heads = np.stack([data[np.minimum(at + k, len(data) - 1)] for k in range(3)], 1)
        for letter, plain in _SAME:
            found = at[(heads[:, : len(letter)] == np.frombuffer(letter, np.uint8)).all(1)]
            for k, c in enumerate(plain if len(found) else b""):
                data[found + k] = c
    return data, edges - edges[0]


#: Texts, and bytes beyond the first text, of one numpy step: a task's memory does not hang on the rows of an Arrow batch.
STEP, BYTES = 1024, 1 << 20


def _codes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Where each text's residues begin, how many they are, and the code of the six residues from each on, over all texts."""
    data, edges = residue_bytes(texts)
    codes = _LUT[data]
    keep = codes < 6
    at = np.concatenate([[0], np.cumsum(keep)])[edges]
    c = codes[keep].astype(np.uint16)
    n = max(len(c) - 5, 0)
    code = c[:n].copy()
    for k in range(1, 6 if n else 1):
        code *= 6
        code += c[k : k + n]
    return at, np.diff(at), code


def steps(texts: pa.Array):
    """A column in parts (from, to) of bounded rows and bytes; a text is never cut."""
    size = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False))
    a = 0
    while a < len(texts):
        b = min(a + STEP, max(a + 1, int(np.searchsorted(size, (size[a - 1] if a else 0) + BYTES, "right"))))
        yield a, min(b, len(texts))
        a = b


def counts(texts: pa.Array) -> np.ndarray:
    """How often each six-mer stands in the texts."""
    at, lens, code = _codes(texts)
    inside = np.zeros(len(code) + 1, np.int32)
    full = np.flatnonzero(lens >= 6)
    np.add.at(inside, at[full], 1)
    np.add.at(inside, at[full] + lens[full] - 5, -1)
    return np.bincount(code[np.cumsum(inside)[:-1] > 0], minlength=SIXMERS)


def windows(texts: pa.Array, table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Cleaned length and best probability (NaN without a window) of each text, from the buffer of the column itself."""
    at, lens, code = _codes(texts)
    best = np.full(len(lens), np.nan)
    if len(code):
        p = np.append(table[code], -np.inf)
        full = np.flatnonzero(lens >= 6)
        if len(full):
            first = at[full]
            best[full] = np.maximum.reduceat(p, np.stack([first, first + lens[full] - 5], 1).ravel())[::2]
    return lens, best
