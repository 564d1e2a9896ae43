"""Byte-level BPE and packing against the tokenizer libraries."""

import hashlib
import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers as P
import pyarrow as pa
import pytest
import regex
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from atlaskb.llm import byte_bpe, common, packing, registry

from ..oracle import DATA

RANKS = byte_bpe.load_ranks(P.path("byte_bpe_50k.tiktoken"))
CODER, SPLIT = byte_bpe.ByteBPE(RANKS), regex.compile(P.PATTERN)
THEIRS = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=RANKS, special_tokens={})
WORDS = Tokenizer.from_file(P.path("word_bpe_49k.json"))
WORDS.encode_special_tokens = True


def ids(data: bytes) -> list[int]:
    return np.frombuffer(data, dtype="<u4").tolist()


@given(st.text(max_size=200))
@settings(max_examples=300, deadline=None)
def test_bpe_equals_merges_by_rank(text):
    coded = CODER.encode(text, SPLIT)
    assert ids(coded) == THEIRS.encode_ordinary(text)
    assert CODER.decode(coded) == text.encode()


@pytest.mark.parametrize("seed", range(3))
def test_bpe_of_long_pieces(seed):
    rnd = random.Random(seed)
    for alphabet in ("ab", "the", "0123456789", "=-", "éàü"):
        text = "".join(rnd.choice(alphabet) for _ in range(2000))
        assert ids(CODER.encode(text, SPLIT)) == THEIRS.encode_ordinary(text)


def test_bpe_is_linear_in_one_long_piece():
    import time

    took = []
    for n in (20_000, 200_000):
        began = time.perf_counter()
        CODER.encode("ab" * n, SPLIT)
        took.append(time.perf_counter() - began)
    assert took[1] < 40 * took[0]


def test_bpe_query(spark):
    docs = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()}
    rows = registry.QUERIES["op4_byte_bpe"](spark, DATA).collect()
    assert len(rows) == len(docs)
    for r in rows:
        want = THEIRS.encode_ordinary(docs[r.doc_id])
        assert r.n_tokens == len(want) and r.ids_sha256 == hashlib.sha256(np.array(want, dtype="<u4").tobytes()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(docs[r.doc_id].encode()).hexdigest()


def test_bpe_nulls(spark):
    docs = spark.createDataFrame([(1, None, 5), (None, "", 6), (2, "hi", 7), (2, "hi", 7)], "doc_id long, text string, ids int")
    rows = byte_bpe.encode(docs, P.path("byte_bpe_50k.tiktoken")).collect()
    assert sorted((str(r.doc_id), bytes(r.decoded)) for r in rows) == [("1", b""), ("2", b"hi"), ("2", b"hi"), ("None", b"")]
    assert byte_bpe.encode(docs.limit(0), P.path("byte_bpe_50k.tiktoken")).count() == 0


@given(st.lists(st.sampled_from(["a", "B", "the", "Été", "ß.", "ÿ", "Ÿ", "é", "ŉ", "İ", "Σ", "K", " ", "\n", "\t", "\xa0", "\x85", "\x1c", "​", "'s", "!", "1", "23", "x,", "中", "<|endoftext|>", "œ"]), max_size=30))
@settings(max_examples=500, deadline=None)
def test_word_ids_equal_the_tokenizer(parts):
    text = "".join(parts)
    assert ids(packing.word_ids(P.path("word_bpe_49k.json"))(text)) == WORDS.encode(text, add_special_tokens=False).ids


def check_packing(docs: dict, rows: list, size: int = packing.SIZE) -> None:
    """Every id in one piece, sequences gapless, no padding but in sequences of a power of two."""
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in rows:
        pieces[r.doc_id].append(r)
        sequences[r.sequence_id].append(r)
    assert pieces.keys() == docs.keys()
    for i, text in docs.items():
        want, at = [*WORDS.encode(text or "", add_special_tokens=False).ids, packing.END], 0
        for r in sorted(pieces[i], key=lambda r: r.start):
            assert r.start == at and r.doc_tokens == len(want) and r.length > 0
            assert r.ids_crc32 == zlib.crc32(np.array(want[at : at + r.length], dtype="<u4").tobytes())
            at += r.length
        assert at == len(want)
    for found in sequences.values():
        at = 0
        for r in sorted(found, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at == size or at < size and at & (at - 1) == 0


def test_packing_query(spark):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()}
    check_packing(docs, registry.QUERIES["op3_packing"](spark, DATA).collect())


def test_packing_edge_cases(spark):
    texts = {1: None, 2: "", 3: "word " * 9000, 4: "x", None: "y", 5: "word " * 9000}
    docs = spark.createDataFrame([(i, t, "k") for i, t in texts.items()], "doc_id long, text string, key string")
    rows = packing.pack(docs, P.path("word_bpe_49k.json")).collect()
    check_packing(texts, rows)
    assert all(len(r.tokens) == 4 * r.length for r in rows)
    assert packing.pack(docs.limit(0), P.path("word_bpe_49k.json")).count() == 0


def test_hilbert_curve_visits_neighbours():
    for dims in (2, 3):
        cells = [[(i >> (4 * d)) & 15 for d in range(dims)] for i in range(16**dims)]
        order = sorted(cells, key=lambda c: packing.hilbert_index(c, 4))
        assert len({packing.hilbert_index(c, 4) for c in cells}) == len(cells)
        assert all(sum(abs(x - y) for x, y in zip(a, b, strict=True)) == 1 for a, b in zip(order, order[1:], strict=False))


def test_tail_lengths():
    assert packing.tail_lengths(2500) == [2048, 256, 128, 64, 4] and packing.tail_lengths(0) == []


def test_workers_do_not_keep_what_a_task_needed(spark, monkeypatch):
    monkeypatch.setattr(packing, "KEPT_WORDS", 5, raising=False)
    path = P.path("word_bpe_49k.json")
    ids_of = packing.WordIds(path)
    want = ids_of("one two three four five six seven eight")
    ids_of.trim()
    assert list(ids_of.memo) == ["one", "two", "three", "four", "five"]
    assert ids_of("one two three four five six seven eight") == want

    texts = [" ".join(f"word{j}" for j in range(i, i + 60_000)) for i in range(4)]
    packing.pack(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), path).count()

    def kept(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([len(packing.word_ids(path).memo)], pa.int64())], ["kept"])

    found = spark.range(8).repartition(4).mapInArrow(kept, "kept long").collect()
    assert max(r.kept for r in found) <= 50_000


def test_a_task_gives_memory_back(spark, monkeypatch):
    def rows(batches):
        for batch in batches:
            yield batch

    given = spark.sparkContext.accumulator(0)
    monkeypatch.setattr(common, "give_back", lambda: given.add(1), raising=False)
    assert common.map_batches(spark.range(10, numPartitions=2), rows, "id long").count() == 10
    assert given.value == 2
