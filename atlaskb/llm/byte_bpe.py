"""Byte-level BPE encoding and decoding in linear time.

Token bytes are mapped to Latin-1 characters for an Aho-Corasick automaton, which gives the longest token
that starts at each byte of a piece. The encoder walks forward with longest matches and steps back to
shorter ones where two adjacent tokens could not stand side by side in a BPE result; whether they can is
decided by undoing merges from both sides and is memoised by pair. A bit per byte position marks those
from which no valid encoding was found, so that each position is tried a bounded number of times. The result
equals that of applying the merges by rank.

Defined results: a null or empty text has no tokens; a table without rows gives no rows; further columns are
ignored; repeated rows are encoded each.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import ahocorasick
import numpy as np
import pyarrow as pa
import public_tokenizers
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import map_batches, read

#: Entries after which a memo (pieces, token pairs) starts anew.
MEMO = 400_000
#: Pieces longer than this are encoded each time, not kept.
MEMO_PIECE = 64


def load_ranks(path: str) -> dict[bytes, int]:
    import base64

    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


class ByteBPE:
    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.bytes_of = {rank: token for token, rank in ranks.items()}
        self.shorter = {rank: self._prefix(token) for token, rank in ranks.items()}
        self.automaton = ahocorasick.Automaton()
        for token, rank in ranks.items():
            self.automaton.add_word(token.decode("latin-1"), (rank, len(token)))
        self.automaton.make_automaton()
        self.pairs: dict[tuple[int, int], int] = {}
        self.parts: dict[int, tuple[int, int]] = {}
        self.adjacent: dict[tuple[int, int], bool] = {}
        for rank in sorted(self.bytes_of):
            self.parts[rank] = self._split(rank)
        self.adjacent.clear()
        self.memo: dict[str, bytes] = {}

    def _prefix(self, token: bytes) -> int | None:
        """The longest token that is a proper prefix."""
        for n in range(len(token) - 1, 0, -1):
            if (rank := self.ranks.get(token[:n])) is not None:
                return rank
        return None

    def _split(self, rank: int) -> tuple[int, int]:
        """The two tokens whose merge makes this one; itself twice for those that no merge makes."""
        token, left = self.bytes_of[rank], self.shorter[rank]
        while left is not None:
            right = self.ranks.get(token[len(self.bytes_of[left]) :])
            if right is not None and left < rank and right < rank and self._stand(left, right):
                self.pairs[left, right] = rank
                return left, right
            left = self.shorter[left]
        return rank, rank

    def _stand(self, left: int, right: int) -> bool:
        """Whether BPE leaves these tokens side by side: undo their merges, last first, and look for a merge
        across the border that would have come earlier."""
        limit = 1 << 62
        while True:
            if self.pairs.get((left, right), limit) < limit:
                return False
            if left > right:
                limit, inner = left, self.parts[left][1]
                if inner != left:
                    left = inner
                    continue
                limit, inner = right + 1, self.parts[right][0]
                if inner == right:
                    return True
                right = inner
            else:
                limit, inner = right + 1, self.parts[right][0]
                if inner != right:
                    right = inner
                    continue
                limit, inner = left, self.parts[left][1]
                if inner == left:
                    return True
                left = inner

    def _fits(self, left: int, right: int) -> bool:
        found = self.adjacent.get((left, right))
        if found is None:
            if len(self.adjacent) > MEMO:
                self.adjacent.clear()
            found = self.adjacent[left, right] = self._stand(left, right)
        return found

    def piece(self, data: bytes) -> list[int]:
        if (whole := self.ranks.get(data)) is not None:
            return [whole]
        n = len(data)
        longest: list[int | None] = [None] * (n + 1)
        size = [0] * n
        for stop, (rank, length) in self.automaton.iter(data.decode("latin-1")):
            start = stop - length + 1
            if length > size[start]:
                size[start], longest[start] = length, rank
        alive = bytearray(b"\x01") * (n + 1)
        bytes_of, shorter = self.bytes_of, self.shorter
        out: list[int] = []
        at, token = 0, longest[0]
        while at < n:
            last = out[-1] if out else None
            while token is not None:
                stop = at + len(bytes_of[token])
                if alive[stop] and (last is None or self._fits(last, token)):
                    break
                token = shorter[token]
            if token is not None:
                out.append(token)
                at = stop
                token = longest[at]
            else:
                alive[at] = 0
                if last is None:
                    raise ValueError("a byte of the text is in no token")
                out.pop()
                at -= len(bytes_of[last])
                token = last
        return out

    def encode(self, text: str, pattern: regex.Pattern) -> bytes:
        """Ids of a text as little-endian unsigned 32-bit integers."""
        memo, out = self.memo, []
        for piece in pattern.findall(text):
            ids = memo.get(piece)
            if ids is None:
                ids = np.array(self.piece(piece.encode()), dtype="<u4").tobytes()
                if len(piece) <= MEMO_PIECE:
                    if len(memo) > MEMO:
                        memo.clear()
                    memo[piece] = ids
            out.append(ids)
        return b"".join(out)

    def decode(self, ids: bytes) -> bytes:
        bytes_of = self.bytes_of
        return b"".join([bytes_of[i] for i in np.frombuffer(ids, dtype="<u4").tolist()])


@cache
def bpe(path: str) -> ByteBPE:
    return ByteBPE(load_ranks(path))


def encode(docs: DataFrame, vocabulary: str, pattern: str = public_tokenizers.PATTERN, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id, ids (little-endian unsigned 32-bit integers) and the bytes that they decode to."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, split = bpe(vocabulary), regex.compile(pattern)
        for batch in batches:
            ids = [coder.encode(t or "", split) for t in batch["text"].to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch["doc_id"], pa.array(ids, pa.binary()), pa.array(map(coder.decode, ids), pa.binary())], ["doc_id", "ids", "decoded"]
            )

    source = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return map_batches(source, rows, f"doc_id {source.schema['doc_id'].dataType.simpleString()}, ids binary, decoded binary")


def op4_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = encode(read(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"))
    return coded.select(
        "doc_id",
        F.floor(F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
