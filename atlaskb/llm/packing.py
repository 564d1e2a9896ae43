"""Packing of documents into fixed-length token sequences along a space-filling curve.

A document's vector is its bag of byte grams hashed to PLACES places, projected to DIMS dimensions: each place has
a fixed pseudo-random direction, and the projection is their mean. Each dimension is cut into 2**BITS cells and
the cells' Hilbert index is the document's key, so that documents with near keys have near vectors. Documents
are range-sorted by (key, id), and each range is packed on its own by laying its documents end to end and
cutting every `size` tokens. What is left at a range's end is cut into powers of two, which need no padding.

Copies share a key, so the id is part of the sort key and a large group of copies is spread over ranges.
A task streams its range: it holds one Arrow batch, never a whole range. There are as many ranges as the session
has shuffle partitions, or more if they would be over RANGE_BYTES.

Defined results: a very long text is cut into as many sequences as it needs; equal keys go by id; a null or empty text is a document of the end token alone; a null id sorts first; rows
repeated in full are packed once each, in some order; an empty table gives an empty result; further columns
are ignored, whatever their names.
"""

from __future__ import annotations

import os
import re
import zlib
from array import array
from collections.abc import Iterator
from functools import cache
from itertools import islice

import numpy as np
import pyarrow as pa
import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import map_batches, mix, read

SIZE, END, DIMS, BITS = 4096, 2, 3, 10
#: Places of the hashed document vector, and bytes of a gram.
PLACES, GRAM = 4096, 4
#: Bytes of text of a range, about.
RANGE_BYTES = 128 << 20
#: Entries after which the memo of token ids by word starts anew.
MEMO_WORDS = 800_000
#: Words of them that a worker keeps after a task.
KEPT_WORDS = 50_000
#: Characters that str.split takes for white space beside the ASCII ones that the tokenizer knows; a text with
#: any of them is given to the tokenizer whole.
_ODD_ASCII = ("\x1c", "\x1d", "\x1e", "\x1f")
_ODD_SPACE = re.compile("[\x85\xa0\u1680\u180e\u2000-\u200b\u2028\u2029\u202f\u205f\u3000\ufeff]")


def is_latin_1(text: str) -> bool:
    """Whether all characters are below U+0100, where each is its own normal form and lower case is by character."""
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return False
    return True


def _byte_symbols() -> dict[int, str]:
    """The character that stands for each byte in a byte-level vocabulary."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}


class WordIds:
    """Token ids of texts as little-endian 32-bit bytes, with a bounded memo by word."""

    def __init__(self, path: str):
        # Its own threads would only compete with the other tasks of the executor.
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        self.model = self.tokenizer.model
        symbols = _byte_symbols()
        self.symbols = {c: "".join(symbols[b] for b in chr(c).encode()) for c in range(0x80, 0x100)}
        self.memo: dict[str, bytes] = {}

    def whole(self, text: str) -> bytes:
        return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    def letters(self, word: str) -> bytes:
        """Ids of a lower-case word of Latin letters: one piece, so the model alone decides."""
        return array("I", [t.id for t in self.model.tokenize(word if word.isascii() else word.translate(self.symbols))]).tobytes()

    def latin(self, word: str) -> bytes:
        if word.isalpha():
            return self.letters(word)
        if word[-1] in ",." and word[:-1].isalpha():
            memo, stem = self.memo, word[:-1]
            if (ids := memo.get(stem)) is None:
                ids = memo[stem] = self.letters(stem)
            return ids + self.whole(word[-1])
        return self.whole(word)

    def __call__(self, text: str) -> bytes:
        latin = text.isascii() or is_latin_1(text)
        if any(c in text for c in _ODD_ASCII) or not text.isascii() and ("\x85" in text or "\xa0" in text if latin else _ODD_SPACE.search(text)):
            return self.whole(text)
        if latin:
            text = text.lower()
        new = self.latin if latin else self.whole
        words, memo = text.split(), self.memo
        try:
            return b"".join([memo[w] for w in words])
        except KeyError:
            if len(memo) > MEMO_WORDS:
                memo.clear()
            for w in words:
                if w not in memo:
                    memo[w] = new(w)
            return b"".join([memo[w] for w in words])

    def trim(self) -> None:
        """Forget all but the words that were met first, most frequent ones among them: a worker outlives its task."""
        if len(self.memo) > KEPT_WORDS:
            self.memo = dict(islice(self.memo.items(), KEPT_WORDS))


@cache
def word_ids(path: str) -> WordIds:
    return WordIds(path)


@cache
def _directions() -> np.ndarray:
    """A fixed pseudo-random direction in [-1, 1)**DIMS for each place of the hashed vector."""
    ids = np.arange(1, PLACES * DIMS + 1, dtype=np.uint64).reshape(PLACES, DIMS)
    return (mix(ids * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(11)).astype(np.float64) / 2**52 - 1


def hashed_vector(data: bytes) -> np.ndarray:
    """Counts of the text's GRAM-byte substrings, hashed to PLACES."""
    b = np.frombuffer(data.ljust(GRAM), dtype=np.uint8).astype(np.uint32)
    h = b[: len(b) - GRAM + 1].copy()
    for i in range(1, GRAM):
        h = h * np.uint32(0x01000193) ^ b[i : len(b) - GRAM + 1 + i]
    return np.bincount((h * np.uint32(0x9E3779B1)) >> np.uint32(20), minlength=PLACES)


def hilbert_index(cells: list[int], bits: int) -> int:
    """The index of a cell on the Hilbert curve through a grid of 2**bits cells a side (Skilling's method)."""
    x = list(cells)
    q = 1 << (bits - 1)
    while q > 1:
        for i in range(len(x)):
            if x[i] & q:
                x[0] ^= q - 1
            else:
                swap = (x[0] ^ x[i]) & (q - 1)
                x[0] ^= swap
                x[i] ^= swap
        q >>= 1
    for i in range(1, len(x)):
        x[i] ^= x[i - 1]
    flip, q = 0, 1 << (bits - 1)
    while q > 1:
        if x[-1] & q:
            flip ^= q - 1
        q >>= 1
    index = 0
    for b in range(bits - 1, -1, -1):
        for c in x:
            index = index << 1 | ((c ^ flip) >> b & 1)
    return index


def curve_key(text: str) -> int:
    """The Hilbert key of a document. The mean of many directions is near 0, so cells are steps of the
    hyperbolic tangent, which spreads the means."""
    if not text:
        return 0
    counts = hashed_vector(text.encode())
    mean = counts @ _directions() / counts.sum()
    cells = np.clip((np.tanh(mean * 8) + 1) * 2 ** (BITS - 1), 0, 2**BITS - 1).astype(int)
    return hilbert_index(cells.tolist(), BITS)


def tail_lengths(left: int) -> list[int]:
    """The sequences for the last `left` tokens of a range: powers of two, largest first, so none is padded."""
    return [1 << b for b in range(left.bit_length() - 1, -1, -1) if left >> b & 1]


def pack(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text", size: int = SIZE, end: int = END) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset and tokens
    (the piece's ids as little-endian unsigned 32-bit integers)."""
    last = np.array([end], dtype="<u4").tobytes()

    def key(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = [curve_key(t or "") for t in batch["text"].to_pylist()]
            yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(keys, pa.int64()), batch["text"]], ["doc_id", "key", "text"])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        ids_of = word_ids(vocabulary)
        first, filled, number = TaskContext.get().partitionId() << 40, 0, 0
        names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "tokens"]
        kinds = [None, *[pa.int64()] * 6, pa.binary()]

        def out(pieces: list[tuple], kind: pa.DataType) -> pa.RecordBatch:
            columns = zip(*pieces, strict=True) if pieces else [[]] * len(names)
            return pa.RecordBatch.from_arrays([pa.array(list(c), k or kind) for c, k in zip(columns, kinds, strict=True)], names)

        # The pieces of the sequence that is open are held back: if the range ends there, they are cut anew.
        held: list[tuple] = []
        kind = None
        for batch in batches:
            kind, done = batch["doc_id"].type, []
            for doc_id, text in zip(batch["doc_id"].to_pylist(), batch["text"].to_pylist(), strict=True):
                ids = ids_of(text or "") + last
                n, at = len(ids) // 4, 0
                while at < n:
                    m = min(n - at, size - filled)
                    held.append((doc_id, at, n, filled, ids[4 * at : 4 * (at + m)]))
                    at, filled = at + m, filled + m
                    if filled == size:
                        done += [(d, s, len(b) // 4, zlib.crc32(b), t, first + number, o, b) for d, s, t, o, b in held]
                        held, filled, number = [], 0, number + 1
            if done:
                yield out(done, kind)
        ids_of.trim()
        if held:
            done, lengths = [], tail_lengths(filled)
            room, offset = lengths[0], 0
            for d, s, t, _, b in held:
                at, n = 0, len(b) // 4
                while at < n:
                    m = min(n - at, room)
                    part = b[4 * at : 4 * (at + m)]
                    done.append((d, s + at, m, zlib.crc32(part), t, first + number, offset, part))
                    at, room, offset = at + m, room - m, offset + m
                    if not room:
                        number, lengths = number + 1, lengths[1:]
                        room, offset = lengths[0] if lengths else 0, 0
            yield out(done, kind)

    source = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    kind = source.schema["doc_id"].dataType.simpleString()
    keyed = map_batches(source, key, f"doc_id {kind}, key long, text string")
    total = source.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    ranges = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-total // RANGE_BYTES))
    ranged = keyed.repartitionByRange(ranges, "key", "doc_id").sortWithinPartitions("key", "doc_id", F.xxhash64("text"))
    return map_batches(
        ranged, cut, f"doc_id {kind}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, tokens binary"
    )


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(read(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json")).drop("tokens")
