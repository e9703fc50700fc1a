"""Harmonic packing of token ids into sequences of at most C ids.

A document is cut into whole sequences of C ids and a rest r < C. The rest belongs to class k = floor(C / r) (at most
``CLASSES``), whose bins take k documents each: k rests of class k always fit. Each worker fills the bins of its own
partition, one open bin a class, without a shuffle or a word with other workers. The slack of a full bin is filled with
whole rests from the open bins of smaller classes that surely fit, the largest first; what is then left of it, with the
front of one rest that is cut, taken from the open bin with the largest rests, or from the next document where no bin
holds any. So every sequence but the last of a partition is a class's bin with its fixed count of whole documents and
its filling, and about one document a sequence is cut. What is open when the partition ends is laid end to end; the
last, short sequence is cut at powers of two, lengths that need no padding.

Null text is the empty text, which has one id (the end id); a very long text fills whole sequences; repeated rows and
ties are packed one by one, in the order of the partition; an empty table gives no pieces; extra columns are ignored.
Sequence ids are partition number x 2^32 + a counter: distinct, and the same when a lost task runs again. A worker holds
under C ids in the bin of each class, and of a document only its rest, not the ids before it.
"""

from __future__ import annotations

import json
import os
import re
import zlib
from array import array

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

CLASSES = 64
END = 2
#: Words of more characters are not kept, so a cache of words is bounded in bytes, too.
LONG = 64
#: Latin-1 letters, then ASCII signs other than the apostrophe.
_PIECES = re.compile(r"([A-Za-z\xc0-\xd6\xd8-\xf6\xf8-\xff]+)([!-&(-/:-@\[-`{-~]*)")
_COLUMNS = ("start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _byte_letters() -> dict[int, int]:
    """Byte-level alphabet: printable bytes stand for themselves, the others for U+0100 onwards, in order."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    odd = [b for b in range(256) if b not in plain]
    return {b: 256 + i for i, b in enumerate(odd)}


#: What a tokenizer file must say for words to be encoded one by one: the fixed values of the public file's head.
_NORMAL = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]
_SPLIT = {"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}, "behavior": "Removed", "invert": True}


def by_words(spec: dict) -> bool:
    """Whether the tokenizer lower-cases, drops white space and merges within letters, digits or signs, as ``Encoder`` takes for granted."""
    pre, model = spec.get("pre_tokenizer") or {}, spec.get("model") or {}
    steps = pre.get("pretokenizers") or [{}, {}]
    level = steps[-1].get("type") == "ByteLevel" and not steps[-1].get("add_prefix_space") and not steps[-1].get("use_regex")
    plain = model.get("type") == "BPE" and not any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "byte_fallback"))
    return (spec.get("normalizer") or {}).get("normalizers") == _NORMAL and steps[:-1] == [_SPLIT] and level and plain


class Encoder(dict):
    """Ids of whole texts; the dictionary holds the ids (bytes of unsigned 32-bit numbers) of words seen before.

    The tokenizer cuts at white space before it merges, so a text's ids are those of its space-separated chunks in
    order. Chunks are cut at the space and the newline only (white space under any definition); other white space
    stays inside a chunk, where the tokenizer itself deals with it. Of a chunk made of Latin-1 letters, perhaps with
    ASCII signs behind, the lower-cased letters are one piece and the signs another, so the merges alone are asked
    for; any other chunk goes through the whole tokenizer. Holds about ``most`` words of at most LONG characters, in two
    generations: when the young one is full it becomes the old one, from which words that are seen again move over.
    A tokenizer file of another make gets whole texts and no cache.
    """

    def __init__(self, path: str, most: int = 800_000):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        super().__init__({"": b""})
        self.old: dict[str, bytes] = {}
        self.tok, self.most = Tokenizer.from_file(path), most
        self.merge, self.letters = self.tok.model.tokenize, _byte_letters()
        with open(path, encoding="utf-8") as f:
            self.words = by_words(json.load(f))

    def __missing__(self, word: str) -> bytes:
        if (ids := self.old.pop(word, None)) is not None:
            self[word] = ids
            return ids
        if m := _PIECES.fullmatch(word):
            low = m[1].lower()
            if m[2]:
                ids = self[low] + self[m[2]]
            elif low != word:
                ids = self[low]
            else:
                text = low if low.isascii() else low.encode().decode("latin-1").translate(self.letters)
                ids = array("I", [t.id for t in self.merge(text)]).tobytes()
        else:
            ids = array("I", self.tok.encode(word, add_special_tokens=False).ids).tobytes()
        if len(word) <= LONG:
            self[word] = ids
        return ids

    def __call__(self, text: str | None) -> np.ndarray:
        if not self.words:
            return np.array(self.tok.encode(text or "", add_special_tokens=False).ids, np.uint32)
        if len(self) > self.most // 2:
            self.old = dict(self)
            self.clear()
            self[""] = b""
        return np.frombuffer(b"".join(map(self.__getitem__, (text or "").replace("\n", " ").split(" "))), np.uint32)


class Packer:
    """The bins of one worker. Pieces are (document, its length, start, ids); ``out`` gets a tuple for each placed piece."""

    def __init__(self, capacity: int, first_id: int):
        self.capacity, self.sequence = capacity, first_id
        self.open: dict[int, list] = {}
        self.waiting: tuple[list, int] | None = None  # a full bin without anything to fill its slack with, and the slack
        self.out: list[tuple] = []

    def place(self, pieces: list) -> None:
        at = 0
        for doc, total, start, ids in pieces:
            self.out.append((doc, start, len(ids), zlib.crc32(ids.tobytes()), total, self.sequence, at))
            at += len(ids)
        self.sequence += 1

    def take(self, k: int) -> tuple:
        held = self.open[k]
        piece = held.pop()
        if not held:
            del self.open[k]
        return piece

    def settle(self, pieces: list) -> None:
        """Fill a bin's slack and place it; it waits for the next rest where no bin is open."""
        room = self.capacity - sum(len(p[3]) for p in pieces)
        while room:
            sure = -(-self.capacity // room)  # rests of this class and of smaller ones fit
            if (k := min((k for k in self.open if k >= sure), default=0)) or (k := self.fitting(room)):
                pieces.append(piece := self.take(k))
                room -= len(piece[3])
            elif self.open:
                doc, total, start, ids = self.take(min(self.open))
                pieces.append((doc, total, start, ids[:room]))
                self.place(pieces)
                self.add_rest((doc, total, start + room, ids[room:].copy()))
                return
            else:
                self.waiting = pieces, room
                return
        self.place(pieces)

    def fitting(self, room: int) -> int:
        """The smallest class, where its last rest fits: rests beyond the last class have no least length."""
        k = max(self.open, default=0)
        return k if k and len(self.open[k][-1][3]) <= room else 0

    def add_rest(self, piece: tuple) -> None:
        if self.waiting:
            (pieces, room), self.waiting = self.waiting, None
            doc, total, start, ids = piece
            pieces.append((doc, total, start, ids[:room]))
            if len(ids) < room:
                self.waiting = pieces, room - len(ids)
                return
            self.place(pieces)
            if len(ids) == room:
                return
            piece = doc, total, start + room, ids[room:].copy()
        k = min(self.capacity // len(piece[3]), CLASSES)
        held = self.open.setdefault(k, [])
        held.append(piece)
        if len(held) == k:
            del self.open[k]
            self.settle(held)

    def add(self, doc: object, ids: np.ndarray) -> None:
        whole = len(ids) // self.capacity * self.capacity
        for start in range(0, whole, self.capacity):
            self.place([(doc, len(ids), start, ids[start : start + self.capacity])])
        if whole < len(ids):
            self.add_rest((doc, len(ids), whole, ids[whole:].copy()))  # a view would keep the whole document alive

    def close(self) -> None:
        """Lay what is left end to end: whole sequences, then powers of two."""
        rest = [*(self.waiting[0] if self.waiting else ()), *(p for k in sorted(self.open) for p in self.open[k])][::-1]
        self.open, self.waiting = {}, None
        left = sum(len(p[3]) for p in rest)
        while left:
            size = self.capacity if left >= self.capacity else 1 << left.bit_length() - 1
            left -= size
            pieces = []
            while size:
                doc, total, start, ids = rest.pop()
                pieces.append((doc, total, start, ids[:size]))
                if len(ids) > size:
                    rest.append((doc, total, start + size, ids[size:]))
                size -= min(size, len(ids))
            self.place(pieces)


_encoders: dict[tuple[str, int], Encoder] = {}


def encoder(path: str, most: int) -> Encoder:
    """This Python worker's encoder; its cache of words outlives a task."""
    if (path, most) not in _encoders:
        _encoders[path, most] = Encoder(path, most)
    return _encoders[path, most]


def pack(spark: SparkSession, docs: DataFrame, path: str | None = None, capacity: int = 4096, id_col: str = "doc_id", text_col: str = "text", cached_words: int = 800_000) -> DataFrame:
    """One row per piece: id, start, length, ids_crc32, doc_tokens, sequence_id, offset. ``cached_words`` trades a worker's memory for time only."""
    common.tune(spark)
    rows = docs.select(F.col(id_col), F.col(text_col).alias("__text"))
    kind = rows.schema[0].dataType
    file = path or tokenizer_path("word_bpe_49k.json")

    def emit(packer, arrow):
        out, packer.out = packer.out, []
        cols = list(zip(*out, strict=True)) or [()] * 7
        return pa.RecordBatch.from_arrays([pa.array(cols[0], arrow), *(pa.array(c, pa.int64()) for c in cols[1:])], names=[id_col, *_COLUMNS])

    def run(batches):
        encode, end, arrow = encoder(file, cached_words), np.array([END], np.uint32), None
        packer = Packer(capacity, TaskContext.get().partitionId() << 32)
        for b in batches:
            arrow = b.schema.field(0).type
            for doc, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                packer.add(doc, np.concatenate([encode(text), end]))
            yield emit(packer, arrow)
        packer.close()
        if packer.out:
            yield emit(packer, arrow)

    return rows.mapInArrow(common.lean(run), f"`{id_col}` {kind.simpleString()}, " + ", ".join(f"{c} long" for c in _COLUMNS))


def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(spark, common.table(spark, sf_dir, "documents"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: pieces of packed sequences. A smaller cache, as other stages' workers share the executor."""
    return pack(spark, docs, cached_words=150_000)
