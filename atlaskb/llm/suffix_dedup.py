"""Removal of byte strings of a given length that repeat, by longest-previous-factor arrays.

A suffix array of the corpus can't be in one place, so it is built in pieces that are sure to hold all equal
windows (strings of `length` bytes) together:

1. Every window has a minimizer: the smallest hash of its GRAM-byte substrings (`key`). Neighbouring windows
   with the same key make a run, however long, so a periodic text is one run and not one for each byte. Equal windows have
   equal keys, so only runs with the same key can hold equal windows. A key met once is dropped, unless its run has
   several minimizers (`multi`) and may repeat itself. A run's periodic stretch repeats its first period, so that only the first
   period goes on.
2. Runs with identical bytes are one string from here on; each further occurrence has a longest previous factor that
   reaches `length` everywhere, by being a copy.
3. The distinct runs of a key are fetched and laid end to end, in order of (doc_id, start). On that text the
   suffix order is built by prefix doubling to exactly `length` bytes, with the longest common prefixes of
   neighbours. The longest previous factor of a window is the longer of its common prefixes with the previous and the
   next smaller position in suffix order; the longest next factor is its mirror image, with larger positions. A window
   whose factor reaches `length` is a repeat.
4. A key with more than GROUP_BYTES of distinct runs is not gathered: its runs are cut into some FAN shorter ones, by the
   minimizer's place in the window, whose key is the hash of the bytes that all windows of such a cell share,
   and go through 2 to 4 again. In cells of one place the key is the window's own hash, so that equal windows are
   equal strings and need no sorting; this ends after a few rounds, whatever the group's size.

Tables are deleted as soon as the next is written, and shuffle files with the query that made them.

keep="first" removes what has an earlier occurrence (by doc_id, then position) and keeps the first;
keep="none" removes every occurrence.

Defined results: a null text counts as empty; texts shorter than `length` keep all; very long texts are read whole, in
segments; a null id sorts first; rows
repeated in full are copies of each other, and as they can't be told apart, keep="first" keeps all of them;
an empty table gives an empty result; further columns are ignored by `spans` and carried by `clean`.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, fresh, map_batches, mix, read

LENGTH = 400
#: Bytes of a key's distinct runs up to which one task gathers them; beyond, they are cut into some FAN shorter runs.
GROUP_BYTES, FAN = 1 << 19, 4
#: Bytes of runs that are sorted together, and windows of a text that are hashed together.
BIN_BYTES, SEGMENT = 1 << 20, 1 << 20

_RUN = "key long, body_hash long, start int, windows int, multi boolean"


def gram_bytes(length: int) -> int:
    """The minimizer's width: the power of two from a tenth to a fifth of the window."""
    return 1 << max(1, (length // 5).bit_length() - 1)


def gram_hashes(data: np.ndarray, gram: int) -> np.ndarray:
    """A 64-bit hash of each substring of `gram` bytes (a power of two)."""
    h, width, factor = data.astype(np.uint64) + np.uint64(1), 1, 0x9E3779B97F4A7C15
    while width < gram:
        h = h[:-width] * np.uint64(factor) + h[width:]
        width, factor = width * 2, factor * factor % 2**64
    return mix(h)


def sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    size = 1
    while size * 2 <= width:
        values = np.minimum(values[:-size], values[size:])
        size *= 2
    return np.minimum(values[: len(values) - (width - size)], values[width - size :]) if width > size else values


def minimizers(data: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """For each window of at most SEGMENT windows: the hash and the place of its minimizer, the leftmost of equals."""
    gram, low = gram_bytes(length), np.uint64((1 << 21) - 1)
    hashes = gram_hashes(data, gram)
    placed = (hashes & ~low) | np.arange(len(hashes), dtype=np.uint64)
    at = (sliding_min(placed, length - gram + 1) & low).astype(np.int64)
    return hashes[at], at


def minimizer_runs(data: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Keys, first window and number of windows of the runs of a text, and whether they have several minimizers."""
    keys, starts, counts, multi = [], [], [], []
    for base in range(0, len(data) - length + 1, SEGMENT):
        key, at = minimizers(data[base : base + SEGMENT + length - 1], length)
        first = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
        keys.append(key[first])
        starts.append(first + base)
        counts.append(np.diff(np.append(first, len(key))))
        multi.append(at[first] != at[np.append(first[1:], len(at)) - 1])
    return np.concatenate(keys), np.concatenate(starts), np.concatenate(counts), np.concatenate(multi)


def _signed(values: np.ndarray) -> np.ndarray:
    return values.astype(np.uint64).view(np.int64)


def suffix_order(text: np.ndarray, starts: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """The order of the suffixes at `starts` by their first `length` bytes, then by position, and for each
    place in that order the bytes, `length` at most, that it shares with the place before it."""
    padded = np.concatenate((text, np.zeros(8, dtype=np.uint8))).astype(np.uint64)
    n, depth = len(text), 8
    if length >= depth:
        packed = padded[:n].copy()
        for i in range(1, depth):
            packed = (packed << np.uint64(8)) | padded[i : n + i]
    else:
        packed, depth = padded[:n], 1
    rank = np.unique(packed, return_inverse=True)[1].astype(np.uint64)
    ranks = [(depth, rank.astype(np.uint32))]
    while depth * 2 <= length:
        behind = np.zeros_like(rank)
        behind[: n - depth] = rank[depth:]
        rank = np.unique(rank << np.uint64(32) | behind, return_inverse=True)[1].astype(np.uint64)
        depth *= 2
        ranks.append((depth, rank.astype(np.uint32)))
    pair = rank[starts] << np.uint64(32) | rank[starts + (length - depth)]
    order = np.argsort(pair, kind="stable")
    placed = pair[order]
    # Common prefixes of unequal neighbours: in strides of each depth, largest first, then byte by byte.
    differ = np.flatnonzero(placed[1:] != placed[:-1])
    one, two = starts[order[differ]], starts[order[differ + 1]]
    shared = np.zeros(len(differ), dtype=np.int64)
    for stride, by in [*reversed(ranks), *([(1, text)] * (ranks[0][0] - 1))]:
        go = np.flatnonzero(shared + stride <= length)
        same = go[by[one[go] + shared[go]] == by[two[go] + shared[go]]]
        shared[same] += stride
    common = np.full(len(order), length, dtype=np.int64)
    common[:1] = 0
    common[differ + 1] = shared
    return order, common


def previous_smaller(position: np.ndarray, common: np.ndarray) -> np.ndarray:
    """For each place of a suffix order: the bytes it shares with the nearest place before it that has a smaller position,
    0 if there is none. All places follow their links back at once; those met have larger positions, so their
    links are shortcuts."""
    n = len(position)
    link, shared = np.arange(-1, n - 1), common.copy()
    shared[:1] = 0
    open_ = np.flatnonzero((link >= 0) & (shared > 0))
    open_ = open_[position[link[open_]] > position[open_]]
    while len(open_):
        met = link[open_]
        shared[open_] = np.minimum(shared[open_], shared[met])
        link[open_] = link[met]
        open_ = open_[(link[open_] >= 0) & (shared[open_] > 0)]
        open_ = open_[position[link[open_]] > position[open_]]
    return shared


def longest_factors(order: np.ndarray, common: np.ndarray, length: int, later: bool = False) -> np.ndarray:
    """For each window (by position): the longest string, `length` at most, that starts there and at a smaller position
    too, or, if `later`, at a larger one.

    Windows that share all `length` bytes stand together in ascending order, so each has a smaller position beside it
    but the first. For the firsts, the previous and next smaller positions among all firsts decide."""
    group = np.cumsum(np.concatenate(([False], common[1:] < length)))
    first = np.flatnonzero(np.concatenate(([True], group[1:] != group[:-1])))
    ends = np.append(first[1:], len(order)) - 1
    one = ends if later else first
    position, between = order[one], common[first]
    if later:
        position = len(order) - position
    back = previous_smaller(position, between)
    ahead = previous_smaller(position[::-1], np.concatenate(([0], between[:0:-1])))[::-1]
    out = np.full(len(order), length, dtype=np.int64)
    out[order[one]] = np.maximum(back, ahead)
    return out


def _flat_runs(flags: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and one past the last of each stretch of true flags."""
    edges = np.flatnonzero(np.diff(np.concatenate(([0], flags.astype(np.int8), [0]))))
    return edges[::2], edges[1::2]


def without_periods(data: bytes, at: np.ndarray, windows: int, length: int, first: bool) -> list[tuple[int, int, bool, bool]]:
    """The parts (first window, number of windows, repeated, certain) of a run with several minimizers, whose places are `at`. If
    its longest stretch of the period that they suggest holds two periods of windows or more, the windows after the first
    period are certain repeats, and if `first` is not wanted those of the first period are repeated too."""
    steps, times = np.unique(np.diff(np.unique(at)), return_counts=True)
    period = int(steps[times.argmax()])
    body = np.frombuffer(data, dtype=np.uint8)
    low, high = _flat_runs(body[period:] == body[:-period])
    if not len(low):
        return [(0, windows, False, False)]
    best = int((high - low).argmax())
    # Windows a to b, b not included, equal the one a period later; those a period later equal an earlier one.
    a, b = int(low[best]), int(high[best]) - length + 1
    end = min(b + period, windows)
    if end - a < 2 * period:
        return [(0, windows, False, False)]
    parts = [(0, a, False, False), (a, period, not first, False), (end, windows - end, False, False)]
    parts.append((a + period, end - a - period, False, True) if first else (a, end - a, False, True))
    return [part for part in parts if part[1] > 0]


def _find_runs(length: int, first: bool):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            take, fields = [], []
            for i, text in enumerate(batch["text"].to_pylist()):
                data = (text or "").encode()
                if len(data) < length:
                    continue
                found = (x.tolist() for x in minimizer_runs(np.frombuffer(data, dtype=np.uint8), length))
                for key, start, n, several in zip(*found, strict=True):
                    key -= key >> 63 << 64
                    body, parts = data[start : start + n - 1 + length], [(0, n, False, False)]
                    if several:
                        parts = without_periods(body, minimizers(np.frombuffer(body, dtype=np.uint8), length)[1], n, length, first)
                    for at, m, repeated, certain in parts:
                        fields.append((key, 0 if certain else xxhash.xxh3_64_intdigest(body[at : at + m - 1 + length]) - (1 << 63), start + at, m, several, repeated, certain))
                        take.append(i)
            at = pa.array(take, pa.int64())
            kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.bool_(), pa.bool_(), pa.bool_()]
            columns = zip(*fields, strict=True) if fields else [[]] * len(kinds)
            yield pa.RecordBatch.from_arrays(
                [batch["doc_id"].take(at), batch["text_hash"].take(at), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))],
                ["doc_id", "text_hash", "key", "body_hash", "start", "windows", "multi", "repeated", "certain"],
            )

    return rows


def cells(body: bytes, windows: int, length: int, width: int) -> list[tuple[int, int, int, bool]]:
    """The parts (first window, number of windows, key, whether they have several minimizers) of a run, cut wherever the minimizer's place in the window falls into
    another cell of `width` places, so that equal windows have parts of the same key. The key is the hash of the bytes
    that all windows of the cell share, whether or not the run has them all; neighbouring parts of one key are one."""
    last = length - gram_bytes(length)
    _, at = minimizers(np.frombuffer(body, dtype=np.uint8), length)
    shift = last - (at[:windows] - np.arange(windows))  # of a window, counted from the one that ends with its minimizer
    cell = shift // width
    first = np.flatnonzero(np.concatenate(([True], (at[1:windows] != at[: windows - 1]) | (cell[1:] != cell[:-1]))))
    parts: list[tuple[int, int, int, bool]] = []
    for a, b in zip(first.tolist(), np.append(first[1:], windows).tolist(), strict=True):
        zero, c = a - int(shift[a]), int(cell[a])
        low, high = zero + min((c + 1) * width - 1, last), zero + c * width + length
        key = xxhash.xxh3_64_intdigest(body[max(low, 0) : high], seed=c)
        if parts and parts[-1][2] == key:
            parts[-1] = (parts[-1][0], b - parts[-1][0], key, True)
        else:
            parts.append((a, b - a, key, False))
    return parts


def _cut_runs(length: int, width: int, first: bool):
    """Cut runs into cells. In cells of one place a part is one window that repeats itself: it goes on as that window, and
    what it repeats is `certain`."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            take, fields = [], []
            for i, (start, n, body, repeated) in enumerate(zip(*(batch[c].to_pylist() for c in ("start", "windows", "body", "repeated")), strict=True)):
                for a, m, key, multi in cells(body, n, length, width):
                    key -= key >> 63 << 64
                    if width == 1 and m > 1:
                        if not repeated:
                            take.append(i)
                            fields.append((key, 0, start + a + first, m - first, False, None, False, True))
                        m, again, multi = 1, repeated or not first, False
                    else:
                        again = repeated
                    part = body[a : a + m - 1 + length]
                    take.append(i)
                    fields.append((key, xxhash.xxh3_64_intdigest(part) - (1 << 63), start + a, m, multi, part, again, False))
            at = pa.array(take, pa.int64())
            kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.bool_(), pa.binary(), pa.bool_(), pa.bool_()]
            columns = zip(*fields, strict=True) if fields else [[]] * len(kinds)
            yield pa.RecordBatch.from_arrays(
                [batch["doc_id"].take(at), batch["text_hash"].take(at), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))],
                ["doc_id", "text_hash", "key", "body_hash", "start", "windows", "multi", "body", "repeated", "certain"],
            )

    return rows


def _fetch_bodies(length: int):
    """The bytes of a document's runs; one row in for each document, one out for each run."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            take, fields = [], []
            for i, (text, runs) in enumerate(zip(batch["text"].to_pylist(), batch["runs"].to_pylist(), strict=True)):
                data = text.encode()
                take += [i] * len(runs)
                fields += [(r["key"], r["start"], r["windows"], data[r["start"] : r["start"] + r["windows"] - 1 + length], r["repeated"]) for r in runs]
            at = pa.array(take, pa.int64())
            columns = zip(*fields, strict=True) if fields else [[]] * 5
            kinds = [pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.bool_()]
            yield pa.RecordBatch.from_arrays(
                [batch["doc_id"].take(at), batch["text_hash"].take(at), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))],
                ["doc_id", "text_hash", "key", "start", "windows", "body", "repeated"],
            )

    return rows


def _sort_runs(length: int, first: bool):
    """Spans to remove among the runs of whole keys, which arrive together and in order."""

    def spans(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        table = pa.Table.from_batches(held).combine_chunks()
        place = list(zip(*(table[c].to_pylist() for c in ("key", "start", "text_hash", "doc_id")), strict=True))
        if len(set(place)) < len(place):  # rows repeated in full have the same runs
            table = table.take(pa.array([i for i, x in enumerate(place) if not i or x != place[i - 1]]))
        bodies = table["body"].to_pylist()
        counts = table["windows"].to_numpy().astype(np.int64)
        sizes = counts + length - 1
        text = np.frombuffer(b"".join(bodies), dtype=np.uint8)
        at = np.concatenate(([0], np.cumsum(sizes)[:-1]))
        row = np.repeat(np.arange(len(counts)), counts)
        ahead = np.concatenate(([0], np.cumsum(counts)[:-1]))
        within = np.arange(len(row)) - ahead[row]
        order, common = suffix_order(text, at[row] + within, length)
        hit = longest_factors(order, common, length) >= length
        if not first:
            hit = (hit | (longest_factors(order, common, length, later=True) >= length)) & ~table["repeated"].to_numpy()[row]
        # A stretch must not go on into the next run: give each run a place of its own.
        spaced = np.zeros(len(row) + len(counts), dtype=bool)
        spaced[np.arange(len(row)) + row] = hit
        a, b = _flat_runs(spaced)
        owner = np.searchsorted(ahead + np.arange(len(counts)), a, side="right") - 1
        offset = table["start"].to_numpy()[owner] - (ahead + np.arange(len(counts)))[owner]
        take = pa.array(owner)
        return pa.RecordBatch.from_arrays(
            [table["doc_id"].combine_chunks().take(take), table["text_hash"].combine_chunks().take(take), pa.array(a + offset, pa.int32()), pa.array(b + offset + length - 1, pa.int32())],
            ["doc_id", "text_hash", "low", "high"],
        )

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        size = 0
        for batch in batches:
            if not batch.num_rows:
                continue
            key = batch["key"].to_numpy()
            for part in np.split(np.arange(len(key)), np.flatnonzero(key[1:] != key[:-1]) + 1):
                piece = batch.slice(int(part[0]), len(part))
                if size >= BIN_BYTES and held[-1]["key"][0] != piece["key"][0]:
                    yield spans(held)
                    held, size = [], 0
                held.append(piece)
                size += piece["body"].nbytes
        if held:
            yield spans(held)

    return rows


def _weighed(runs: DataFrame, scratch: Scratch) -> DataFrame:
    """Distinct runs of keys: the occurrences and the first of them, and the distinct runs of the key. Each side of a
    join is a table of its own, so that adaptive execution can split a key with many runs."""
    entries = runs.groupBy("key", "body_hash").agg(
        F.count(F.lit(1)).alias("occurrences"), F.max("repeated").alias("repeated_"), F.max("multi").alias("multi_"), F.min(F.struct("doc_id", "text_hash", "start")).alias("first_")
    )
    entries = scratch.put(entries, "entries")
    keys = scratch.put(entries.groupBy("key").agg(F.count(F.lit(1)).alias("distinct_")).where("distinct_ > 1"), "keys")
    weighed = entries.join(keys, "key", "left").where("occurrences > 1 OR distinct_ IS NOT NULL OR multi_")
    weighed = scratch.put(weighed.withColumn("distinct_", F.coalesce("distinct_", F.lit(1))), "weighed")
    scratch.drop(entries, keys)
    return weighed


def _is_first() -> Column:
    return F.col("first_").eqNullSafe(F.struct("doc_id", "text_hash", "start"))


def spans(docs: DataFrame, length: int = LENGTH, keep: str = "none", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, text_hash and the byte spans [low, high) to remove, which may overlap."""
    if keep not in ("none", "first"):
        raise ValueError("keep is none or first")
    first, scratch = keep == "first", Scratch(docs.sparkSession, "suffix")
    source = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(text_col).alias("text_hash"), F.col(text_col).alias("text")).where("text IS NOT NULL")
    owner = f"doc_id {source.schema['doc_id'].dataType.simpleString()}, text_hash long"
    reach = (F.col("start") + F.col("windows") + F.lit(length - 1)).alias("high")
    every = scratch.put(map_batches(source, _find_runs(length, first), f"{owner}, {_RUN}, repeated boolean, certain boolean"), "runs")
    found = [scratch.put(every.where("certain").select("doc_id", "text_hash", F.col("start").alias("low"), reach), "periods")]
    met = every.where("NOT certain").groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.max("multi").alias("multi"))
    shared = scratch.put(met.where("n > 1 OR multi").select("key"), "repeated")
    runs = scratch.put(every.where("NOT certain").drop("certain").join(shared, "key", "left_semi"), "shared")
    scratch.drop(every, shared)

    def level(runs: DataFrame, columns: list[str]) -> DataFrame:
        """The distinct runs that must be compared; notes the spans that are repeated whole."""
        entries = _weighed(runs, scratch)
        weighed = runs.join(entries, ["key", "body_hash"])
        whole = F.col("occurrences") > 1
        covered = whole & ~_is_first() if first else (whole | F.col("repeated_")) & ~F.col("repeated")
        found.append(scratch.put(weighed.where(covered).select("doc_id", "text_hash", F.col("start").alias("low"), reach), "covered"))
        again = weighed.where(((F.col("distinct_") > 1) | F.col("multi_")) & _is_first())
        again = scratch.put(again.select(*columns, (F.lit(False) if first else whole | F.col("repeated_")).alias("repeated")), "again")
        scratch.drop(runs, entries)
        return again

    place = ["doc_id", "text_hash", "key", "start", "windows"]
    again = level(runs, place)
    wanted = again.groupBy("doc_id", "text_hash").agg(F.collect_set(F.struct("key", "start", "windows", "repeated")).alias("runs"))
    wanted = wanted.withColumnsRenamed({"doc_id": "doc_id_", "text_hash": "text_hash_"})
    once = source.join(wanted, F.col("doc_id").eqNullSafe(F.col("doc_id_")) & (F.col("text_hash") == F.col("text_hash_"))).drop("doc_id_", "text_hash_")
    bodies = map_batches(once, _fetch_bodies(length), f"{owner}, key long, start int, windows int, body binary, repeated boolean")
    bodies = scratch.put(bodies, "bodies")
    scratch.drop(again)
    width = length - gram_bytes(length) + 1
    while True:
        sizes = scratch.put(bodies.groupBy("key").agg(F.sum(F.col("windows").cast("long") + F.lit(length - 1)).alias("n_")), "sizes")
        small = bodies.join(sizes.where(F.col("n_") <= GROUP_BYTES), "key").drop("n_")
        gathered = small.repartition("key").sortWithinPartitions("key", "doc_id", "text_hash", "start")
        found.append(scratch.put(map_batches(gathered, _sort_runs(length, first), f"{owner}, low int, high int"), "spans"))
        large = sizes.where(F.col("n_") > GROUP_BYTES)
        if large.isEmpty():
            break
        width = -(-width // FAN)
        cut = map_batches(bodies.join(large.select("key"), "key", "left_semi"), _cut_runs(length, width, first), f"{owner}, {_RUN}, body binary, repeated boolean, certain boolean")
        cut = scratch.put(cut, "cut")
        scratch.drop(bodies, sizes)
        if width == 1:
            found.append(scratch.put(cut.where("certain").select("doc_id", "text_hash", F.col("start").alias("low"), reach), "certain"))
        parts = scratch.put(cut.where("NOT certain").drop("certain"), "parts")
        scratch.drop(cut)
        bodies = level(parts, [*place, "body"])
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return scratch.end(out, "spans")


def merged(low: list[int], high: list[int]) -> list[tuple[int, int]]:
    """Maximal spans: overlapping and touching ones become one."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(zip(low, high, strict=True)):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def cut_text(data: bytes, cuts: list[tuple[int, int]]) -> bytes:
    out, at = [], 0
    for a, b in cuts:
        out.append(data[at:a])
        at = b
    return b"".join([*out, data[at:]])


def whole_characters(data: bytes, cuts: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The spans without characters that they hold only in part."""
    out = []
    for a, b in cuts:
        while a < b and data[a] & 0xC0 == 0x80:
            a += 1
        while b > a and b < len(data) and data[b] & 0xC0 == 0x80:
            b -= 1
        if a < b:
            out.append((a, b))
    return out


def _with_spans(docs: DataFrame, found: DataFrame, id_col: str, text_col: str, name: str) -> DataFrame:
    """docs with a column of their spans as an array of structs, null if there are none."""
    per_doc = found.groupBy("doc_id", "text_hash").agg(F.collect_set(F.struct("low", "high")).alias(name))
    per_doc = per_doc.withColumnsRenamed({"doc_id": f"{name}_id", "text_hash": f"{name}_hash"})
    same = F.col(id_col).eqNullSafe(F.col(f"{name}_id")) & (F.xxhash64(text_col) == F.col(f"{name}_hash"))
    return docs.join(per_doc, same, "left").drop(f"{name}_id", f"{name}_hash")


def clean(docs: DataFrame, length: int = LENGTH, keep: str = "first", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs, with the repeated strings cut from the text in whole characters; other columns as they are."""
    name = fresh(docs, "cuts_")
    joined = _with_spans(docs, spans(docs, length, keep, id_col, text_col), id_col, text_col, name)
    columns_out = docs.columns

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = []
            for text, cuts in zip(batch[text_col].to_pylist(), batch[name].to_pylist(), strict=True):
                if cuts:
                    data = text.encode()
                    text = cut_text(data, whole_characters(data, merged([c["low"] for c in cuts], [c["high"] for c in cuts]))).decode()
                texts.append(text)
            columns = [pa.array(texts, pa.string()) if f.name == text_col else c for f, c in zip(batch.schema, batch.columns, strict=True) if f.name != name]
            yield pa.RecordBatch.from_arrays(columns, columns_out)

    return map_batches(joined, rows, docs.schema)


def digest(docs: DataFrame, length: int = LENGTH, keep: str = "none") -> DataFrame:
    """Per document: doc_id, n_bytes, n_removed, n_spans, kept (the remaining bytes)."""
    source = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    joined = _with_spans(source, spans(source, length, keep), "doc_id", "text", "cuts")

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for text, cuts in zip(batch["text"].to_pylist(), batch["cuts"].to_pylist(), strict=True):
                data = text.encode()
                cuts = merged([c["low"] for c in cuts], [c["high"] for c in cuts]) if cuts else []
                out.append((len(data), sum(b - a for a, b in cuts), len(cuts), cut_text(data, cuts)))
            columns = zip(*out, strict=True) if out else [[]] * 4
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.binary()]
            yield pa.RecordBatch.from_arrays(
                [batch["doc_id"], *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept"]
            )

    kind = source.schema["doc_id"].dataType.simpleString()
    return map_batches(joined, rows, f"doc_id {kind}, n_bytes long, n_removed long, n_spans long, kept binary")


def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = digest(read(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
