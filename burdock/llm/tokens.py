"""Token counts by section with offset-mapped attribution.

A whole document is encoded once; the ids' byte lengths give every token's byte span, which is joined as an interval
to the sections of the text (lines, each with its line end, or blocks between empty lines). Sections tile the text, so
a token that crosses a boundary lies in several; the rule decides who counts it: ``first`` (the section of its first
byte), ``last`` (of its last byte) or ``most`` (of most of its bytes, the earlier on a tie).

Null and empty texts have one empty section without tokens; very long texts are encoded whole; repeated rows are counted
one by one; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import base64
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common
from .packing import tokenizer_path

SECTIONS = {"line": re.compile(rb"\n"), "block": re.compile(rb"\n[ \t]*\n+")}
_held: dict[str, tuple] = {}


def encoding(path: str) -> tuple:
    """This worker's tokenizer, and the byte length of each id."""
    if path not in _held:
        import public_tokenizers
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(n) for a, n in map(bytes.split, f)}
        size = np.zeros(max(ranks.values()) + 1, np.int64)
        size[list(ranks.values())] = [len(x) for x in ranks]
        _held[path] = tiktoken.Encoding("sections", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}), size
    return _held[path]


def attribute(raw: bytes, sizes: np.ndarray, edges: np.ndarray, rule: str) -> tuple[np.ndarray, np.ndarray]:
    """Tokens counted by each section [edges[k], edges[k + 1]), and how many of them cross a boundary."""
    ends = np.cumsum(sizes)
    starts, n = ends - sizes, len(edges) - 1
    first = np.searchsorted(edges, starts, "right") - 1
    last = np.searchsorted(edges, ends - 1, "right") - 1
    chosen = first if rule == "first" else last
    if rule == "most":
        chosen = first.copy()
        for t in np.flatnonzero(first != last).tolist():
            inside = [min(ends[t], edges[k + 1]) - max(starts[t], edges[k]) for k in range(first[t], last[t] + 1)]
            chosen[t] = first[t] + int(np.argmax(inside))
    return np.bincount(chosen, minlength=n), np.bincount(chosen[first != last], minlength=n)


def count(docs: DataFrame, path: str | None = None, sections: str = "line", rule: str = "first", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per section: id, section, start, end (code points), n_tokens, n_crossing, doc_tokens."""
    if rule not in ("first", "last", "most"):
        raise ValueError(f"unknown rule {rule}")
    common.tune(docs.sparkSession)
    file, cut = path or tokenizer_path("byte_bpe_50k.tiktoken"), SECTIONS[sections]
    rows = docs.select(F.col(id_col), F.col(text_col).alias("__text"))
    names = ("section", "start", "end", "n_tokens", "n_crossing", "doc_tokens")

    def run(batches):
        enc, size = encoding(file)
        for b in batches:
            who, out = [], []
            for i, text in enumerate(b.column(1).to_pylist()):
                raw = (text or "").encode()
                edges = np.array([0, *(m.end() for m in cut.finditer(raw) if m.end() < len(raw)), len(raw)], np.int64)
                sizes = size[enc.encode_ordinary(text)] if text else np.zeros(0, np.int64)
                n, crossing = attribute(raw, sizes, edges, rule)
                chars = edges if len(raw) == len(text or "") else np.concatenate([[0], np.cumsum((np.frombuffer(raw, np.uint8) & 0xC0) != 0x80)])[edges]
                k = len(n)
                who.append(np.full(k, i))
                out.append((np.arange(k), chars[:-1], chars[1:], n, crossing, np.full(k, len(sizes))))
            cols = [np.concatenate(c).astype(np.int64) for c in zip(*out, strict=True)] if out else [np.zeros(0, np.int64)] * 6
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(np.concatenate(who) if who else np.zeros(0, np.int64))), *map(pa.array, cols)], names=[id_col, *names])

    return rows.mapInArrow(run, f"`{id_col}` {rows.schema[0].dataType.simpleString()}, " + ", ".join(f"{n} long" for n in names))


def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count(common.table(spark, sf_dir, "documents"))
