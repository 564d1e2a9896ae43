"""Near-duplicate detection with SuperMinHash signatures.

1. Each document becomes the set of its distinct word shingles (64-bit hashes). Documents with equal sets are one
   node, named by a 128-bit digest of the set, so that copies are never compared.
2. A node's SuperMinHash signature: every element takes part in each level j with a pseudo-random value
   in [j, j+1) for the slot that its own pseudo-random permutation assigns to j, and the slot keeps its
   minimum. The ranks of one element are correlated (a permutation, not independent draws), which lowers the
   variance. A document is done at the first level at which all slots hold a value of a lower one (early
   stopping).
3. Bands of ROWS slots are hashed to buckets. At the least similarity that links (0.85 or 0.8) the chance that
   a pair shares none of BANDS buckets is below 1e-9 and 1e-7.
4. Narrowing, before any comparison: a shingle that no other candidate has can't be shared, so a document's `common`
   shingles bound its overlap with all others. A document with too few of them links with nothing and leaves; a
   pair whose commons bound its similarity below the limit is never compared.
5. Verification on the full sets, the same for groups of all sizes and never all pairs of a bucket. First each bucket's
   members are compared with its pivot (the member in the largest buckets), and links join components: a group of near
   copies is mostly one component now, at a cost in proportion to its members. A pivot's set is sent once for each PART
   members that it meets, and a member's once for each of its pivots. Buckets that still hold several components are
   narrowed: their members meet again only if they share one of their rarest shingles, as any two that link must. What
   these narrow buckets connect is compared in blocks of BLOCK to WIDEST elements, in the blocks' inverted indexes; two blocks
   of one component are not compared. Pairs of blocks are sent in rounds, so that the disk follows the input. So every pair across components that could link has been compared.
6. Union-find: each task contracts its links to a forest, then labels spread over the forests' edges by
   hooking to the smallest neighbour and jumping chains to their ends, in rounds that each end. Links stay in tables of the shared folder.

Tables of a round are deleted as soon as the next is written, and shuffle files with the query that made them.

Defined results: a null or empty text (or one of white space only) has no shingles, links with nothing and is its
own component; a text with fewer words than a shingle is one shingle; a very long text is one set, which must fit a task's
memory (8 bytes a distinct shingle); of equal weights the smallest node is the pivot; rows repeated in full are in
one component and `kept` is true for each; a null id is never the smallest unless all are null; empty tables
give empty results; further columns are ignored by `components` and carried by `dedup`.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, fresh, map_batches, mix, read

BANDS, ROWS = 32, 4
SLOTS = BANDS * ROWS
#: Members that a pivot meets in one task.
PART = 512
#: Set elements of a block of documents that are compared with another block: a family has up to FEW blocks of the first
#: size, then FEW larger ones, then more of the second size, as a block is sent once for each block that it meets.
BLOCK, WIDEST, FEW = 1 << 16, 1 << 20, 16
#: Set elements that are sent to meet at once; at least twice those of all families are, so the rounds don't grow with them.
ROUND = 1 << 26
#: Links that one task contracts.
LINKS = 300_000
#: Set elements for which signatures are computed together.
ELEMENTS = 1 << 16
#: Leaves of the two-step counts and joins that spread a large group of equal sets.
SALTS = 64
MEMO = 400_000
_GOLD = np.uint64(0x9E3779B97F4A7C15)


class Shingler:
    """Sorted distinct shingle hashes of a text, with a bounded memo of word hashes."""

    def __init__(self, words: int):
        self.words = words
        self.memo: dict[bytes, bytes] = {}
        self.factors = [np.uint64(mix(np.array([i + 1], dtype=np.uint64))[0] | np.uint64(1)) for i in range(words)]

    def __call__(self, text: str | None) -> np.ndarray:
        words, memo = (text or "").encode().lower().split(), self.memo
        if not words:
            return np.empty(0, dtype=np.uint64)
        try:
            joined = b"".join([memo[w] for w in words])
        except KeyError:
            if len(memo) > MEMO:
                memo.clear()
            for w in words:
                if w not in memo:
                    memo[w] = xxhash.xxh3_64_digest(w)
            joined = b"".join([memo[w] for w in words])
        hashes = np.frombuffer(joined, dtype="<u8")
        if len(hashes) < self.words:
            return np.array([xxhash.xxh3_64_intdigest(b" ".join(words), seed=len(words))], dtype=np.uint64)
        n = len(hashes) - self.words + 1
        total = hashes[:n] * self.factors[0]
        for i in range(1, self.words):
            total = total + hashes[i : n + i] * self.factors[i]
        return np.unique(mix(total))


def signatures(sets: list[np.ndarray]) -> np.ndarray:
    """SuperMinHash signatures of several non-empty sets at once, as unsigned 64-bit integers: the level in
    the top byte, the value's fraction below."""
    sizes = np.array([len(s) for s in sets])
    elements, owner = np.concatenate(sets), np.repeat(np.arange(len(sets)), sizes)
    full = np.uint64(2**64 - 1)
    slots = np.full((len(sets), SLOTS), full, dtype=np.uint64)
    flat = slots.reshape(-1)
    swaps: list[np.ndarray] = []
    for level in range(SLOTS):
        draw = mix(elements + np.uint64((2 * level + 1) * int(_GOLD) % 2**64))
        swap = level + ((mix(draw ^ _GOLD) >> np.uint64(32)) * np.uint64(SLOTS - level) >> np.uint64(32)).astype(np.int16)
        # The place that the element's permutation gives to this level: follow the earlier swaps back.
        place = swap
        for earlier in range(level - 1, -1, -1):
            place = np.where(place == swaps[earlier], np.int16(earlier), place)
        swaps.append(swap)
        value = (draw >> np.uint64(8)) | np.uint64(level << 56)
        np.minimum.at(flat, owner * SLOTS + place, value)
        go_on = (slots.max(axis=1) >= np.uint64(level + 1 << 56))[owner]
        if not go_on.any():
            break
        if not go_on.all():
            elements, owner = elements[go_on], owner[go_on]
            swaps = [s[go_on] for s in swaps]
    return slots


def band_hashes(slots: np.ndarray) -> np.ndarray:
    """A hash of each band's slots, different for equal slots of different bands."""
    bands = slots.reshape(len(slots), BANDS, ROWS)
    total = np.broadcast_to(mix(np.arange(1, BANDS + 1, dtype=np.uint64)), bands.shape[:2])
    for r in range(ROWS):
        total = mix((total ^ bands[:, :, r]) * _GOLD)
    return total.view(np.int64)


def similar(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    if 100 * min(len(a), len(b)) < percent * max(len(a), len(b)):
        return False
    shared = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * shared >= percent * (len(a) + len(b) - shared)


def _sketch(words: int):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = Shingler(words)
        for batch in batches:
            sets = [shingler(t) for t in batch["text"].to_pylist()]
            bands: list[np.ndarray | None] = [None] * len(sets)
            filled = [i for i, s in enumerate(sets) if len(s)]
            while filled:
                part, size = [], 0
                while filled and (not part or size + len(sets[filled[-1]]) <= ELEMENTS):
                    part.append(filled.pop())
                    size += len(sets[part[-1]])
                for i, row in zip(part, band_hashes(signatures([sets[i] for i in part])), strict=True):
                    bands[i] = row
            digests = np.array([divmod(xxhash.xxh3_128_intdigest(s.tobytes()), 2**64) for s in sets], dtype=np.uint64).reshape(-1, 2).view(np.int64)
            yield pa.RecordBatch.from_arrays(
                [batch["doc_id"], batch["text_hash"], pa.array([len(s) for s in sets], pa.int64()), pa.array(digests[:, 0]), pa.array(digests[:, 1]), pa.array(bands, pa.list_(pa.int64()))],
                ["doc_id", "text_hash", "n_shingles", "set_high", "set_low", "bands"],
            )

    return rows


def _sets(words: int):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = Shingler(words)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch["node"], pa.array([shingler(t).view(np.int64) for t in batch["text"].to_pylist()], pa.list_(pa.int64()))], ["node", "elements"])

    return rows


def _meet(percent: int):
    """The links among rows (pivot, part, node, elements), which arrive by pivot and part, the pivot's own set first with
    a null node. Only that set is held."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            good, lists = [], batch["elements"]
            for i, node in enumerate(batch["node"].to_pylist()):
                elements = lists[i].values.to_numpy()
                if node is None:
                    held = elements
                good.append(node is not None and similar(held, elements, percent))
            yield batch.select(["pivot", "node"]).filter(pa.array(good, pa.bool_()))

    return rows


def block_links(one: list[np.ndarray], labels_one: list[int], two: list[np.ndarray], labels_two: list[int], percent: int) -> set[tuple[int, int]]:
    """The labels (larger, smaller) of all similar sets of two blocks, by an inverted index of the first."""
    sizes = np.array([len(s) for s in one])
    elements, owner = np.concatenate(one), np.repeat(np.arange(len(one)), sizes)
    order = np.argsort(elements, kind="stable")
    elements, owner = elements[order], owner[order]
    known = np.array(labels_one)
    found: set[tuple[int, int]] = set()
    for mine, label in zip(two, labels_two, strict=True):
        low, high = np.searchsorted(elements, mine, side="left"), np.searchsorted(elements, mine, side="right")
        n = high - low
        low, n = low[n > 0], n[n > 0]
        if not len(n):
            continue
        at = np.arange(n.sum()) + np.repeat(low - np.concatenate(([0], np.cumsum(n)[:-1])), n)
        shared = np.bincount(owner[at], minlength=len(one))
        hits = known[(100 * shared >= percent * (sizes + len(mine) - shared)) & (known != label)]
        found.update((max(x, label), min(x, label)) for x in set(hits.tolist()))
    return found


def _meet_blocks(percent: int):
    """The links (a, b) among labels of rows (one, two, side, label, elements), which arrive by pair of blocks, the first block before
    the second. A block that meets itself comes as both sides."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair, held, labels = None, [], []
        for batch in batches:
            links: set[tuple[int, int]] = set()
            asked: list[np.ndarray] = []
            askers: list[int] = []
            lists = batch["elements"]
            for i, (*this, side, label) in enumerate(zip(*(batch[c].to_pylist() for c in ("one", "two", "side", "label")), strict=True)):
                if this != pair:
                    if held and asked:
                        links |= block_links(held, labels, asked, askers, percent)
                    pair, held, labels, asked, askers = this, [], [], [], []
                # A copy, as the batch goes.
                (asked if side else held).append(lists[i].values.to_numpy() if side else lists[i].values.to_numpy().copy())
                (askers if side else labels).append(label)
            if held and asked:
                links |= block_links(held, labels, asked, askers, percent)
            found = sorted(links)
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in found], pa.int64()), pa.array([x[1] for x in found], pa.int64())], ["a", "b"])

    return rows


def _in_blocks(open_: DataFrame, sets: DataFrame, percent: int, scratch: Scratch) -> DataFrame:
    """The links (a, b) between labels of open_ (node, label, family, size), within families. Pairs of blocks meet in
    rounds, as what they are sent grows with the square of a family's size."""
    sums = open_.groupBy("family", "label").agg(F.sum("size").alias("elements"))
    room = open_.groupBy("family").agg(F.least(F.greatest(F.ceil(F.sum("size") / FEW), F.lit(BLOCK)), F.lit(max(BLOCK, WIDEST))).alias("room"))
    sums = scratch.put(sums.join(room, "family"), "sums")
    # A component that fills blocks has its own; the others of a family share some. The number is a matter of layout only.
    whose = F.when(F.col("elements") >= F.col("room"), F.col("label"))
    kinds = sums.withColumn("whose", whose).groupBy("family", "whose").agg(F.ceil(F.sum("elements") / F.first("room")).cast("int").alias("blocks"), F.sum("elements").alias("elements"))
    blocks = kinds.select("family", "whose", "blocks", F.ceil(F.col("elements") / F.col("blocks")).alias("filled"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("number"))
    blocks = scratch.put(blocks.withColumn("block", F.monotonically_increasing_id()), "blocks")
    # The sums are joined on what is never null.
    members = open_.join(sums.withColumn("whose", F.coalesce(whose, F.lit(-1))).drop("elements", "room"), ["family", "label"])
    spread = blocks.withColumn("whose", F.coalesce("whose", F.lit(-1)))
    counts = spread.where("number = 0").select("family", "whose", "blocks")
    members = members.join(counts, ["family", "whose"]).withColumn("number", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    members = scratch.put(members.join(spread.drop("blocks", "filled"), ["family", "whose", "number"]).select("node", "label", "block"), "members")
    theirs = scratch.put(sets.join(members.select("node"), "node", "left_semi"), "open-sets")
    one = blocks.select("family", F.col("block").alias("one"), F.col("whose").alias("whose_one"), F.col("filled").alias("filled_one"))
    two = blocks.select("family", F.col("block").alias("two"), F.col("whose").alias("whose_two"), F.col("filled").alias("filled_two"))
    pairs = one.join(two, "family").where("one <= two AND coalesce(whose_one <> whose_two, true)")
    pairs = scratch.put(pairs.select("one", "two", (F.col("filled_one") + F.col("filled_two")).alias("sent")), "block-pairs")
    held, sent = sums.agg(F.sum("elements")).first()[0] or 0, pairs.agg(F.sum("sent")).first()[0] or 0
    rounds, found = max(1, -(-sent // max(ROUND, 2 * held))), []
    for i in range(rounds):
        now = pairs.where(F.pmod(F.xxhash64("one", "two"), F.lit(rounds)) == i)
        sides = now.select("one", "two", F.lit(0).alias("side"), F.col("one").alias("block")).union(now.select("one", "two", F.lit(1).alias("side"), F.col("two").alias("block")))
        met = sides.join(members, "block").select("one", "two", "side", "label", "node").join(theirs, "node")
        met = met.repartition("one", "two").sortWithinPartitions("one", "two", "side", "node")
        found.append(scratch.put(map_batches(met.select("one", "two", "side", "label", "elements"), _meet_blocks(percent), "a long, b long"), "met"))
    scratch.drop(sums, blocks, members, theirs, pairs)
    links = found[0]
    for more in found[1:]:
        links = links.unionByName(more)
    return links


def _compared(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The links (pivot, node) among pairs (pivot, node)."""
    parts = pairs.groupBy("pivot").agg(F.ceil(F.count(F.lit(1)) / PART).cast("int").alias("parts"))
    heads = parts.select("pivot", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.lit(None).cast("long").alias("node"), F.col("pivot").alias("whose"))
    members = pairs.join(parts, "pivot").select("pivot", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int").alias("part"), "node", F.col("node").alias("whose"))
    met = heads.union(members).join(sets.withColumnRenamed("node", "whose"), "whose").repartition("pivot", "part").sortWithinPartitions("pivot", "part", F.col("node").asc_nulls_first())
    return map_batches(met.select("pivot", "part", "node", "elements"), _meet(percent), "pivot long, node long")


def _distinct_buckets(members: DataFrame, scratch: Scratch) -> DataFrame:
    """Members of buckets, of several buckets with the same members only those of one."""
    h = F.xxhash64("node")
    kinds = members.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"), F.bit_xor(h).alias("x"), F.sum(h % 2**31).alias("s"))
    one = scratch.put(kinds.groupBy("n", "x", "s").agg(F.min("bucket").alias("bucket")).select("bucket"), "buckets")
    return members.join(one, "bucket", "left_semi")


def _common(ranked: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """ranked with `common`, the number of a node's elements that another node has too; without nodes that have too few."""
    elements = sets.select("node", F.explode("elements").alias("element"))
    alone = elements.groupBy("element").agg(F.min("node").alias("node"), F.max("node").alias("other")).where("node = other")
    alone = alone.groupBy("node").agg(F.count(F.lit(1)).alias("alone"))
    known = ranked.join(alone, "node", "left").withColumn("common", F.col("size") - F.coalesce("alone", F.lit(0)))
    return known.drop("alone").where(100 * F.col("common") >= percent * F.col("size"))


def _prefix_buckets(nodes: DataFrame, sets: DataFrame, percent: int, scratch: Scratch) -> DataFrame:
    """(bucket, node): the rarest elements of each node's set, as many as must hold one that a similar set also has
    among its rarest. Passages that many documents share are frequent here, so they bring nobody together."""
    elements = sets.join(nodes, "node", "left_semi").select("node", F.explode("elements").alias("element"))
    several = scratch.put(elements.groupBy("element").agg(F.count(F.lit(1)).alias("df")).where("df > 1"), "frequencies")
    known = elements.join(several, "element", "left").select("node", F.struct(F.coalesce("df", F.lit(1)).alias("df"), "element").alias("e"))
    ordered = known.groupBy("node").agg(F.array_sort(F.collect_set("e")).alias("e"))
    n = F.size("e")
    length = n - F.ceil(n * percent / 100).cast("int") + 1
    kept = ordered.select("node", F.explode(F.slice("e", F.lit(1), length)).alias("e")).where("e.df > 1")
    return kept.select(F.col("e.element").alias("bucket"), "node")


def _contract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Union-find over the links of a task: each node with the smallest node that it reaches there."""
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        top = x
        while (up := parent.get(top, top)) != top:
            top = up
        while (up := parent.get(x, x)) != top:
            parent[x], x = top, up
        return top

    for batch in batches:
        for a, b in zip(batch["a"].to_pylist(), batch["b"].to_pylist(), strict=True):
            x, y = root(a), root(b)
            parent.setdefault(x, x)
            parent.setdefault(y, y)
            if x != y:
                parent[max(x, y)] = min(x, y)
    nodes = [x for x in parent if root(x) != x]
    yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array([root(x) for x in nodes], pa.int64())], ["node", "root"])


def _jumped(best: DataFrame, scratch: Scratch) -> DataFrame:
    """best (node, label) with every label replaced by the label's own, until none has one: each pass halves the chains."""
    while True:
        ahead = best.select("node", "label").join(best.select(F.col("node").alias("label"), F.col("label").alias("next")), "label", "left")
        moved = scratch.put(ahead.select("node", F.coalesce("next", "label").alias("label"), F.col("next").isNotNull().alias("moved")), "stars")
        scratch.drop(best)
        best = moved
        if best.where("moved").isEmpty():
            return best


def connected(links: DataFrame, scratch: Scratch) -> DataFrame:
    """(node, label) for every node of links (a, b) that isn't the smallest of its component; label is that.

    Links that one task can hold are contracted there. More go by rounds: tasks shorten their shares, each node that has
    a smaller neighbour hooks to the smallest, chains are jumped to their ends, and the ends go on with the links between
    them. A node that stays for two rounds has taken in a neighbour of its own, so two rounds at least halve the
    nodes that still have links, however the links are dealt."""
    edges, levels = links.select("a", "b"), []
    while True:
        # As many tasks as the links need: the more links meet in a task, the fewer rounds are left.
        tasks = max(1, -(-edges.count() // LINKS))
        forest = scratch.put(edges.coalesce(tasks).mapInArrow(_contract, "node long, root long"), "forest")
        scratch.drop(edges)
        if tasks == 1:
            labels = forest.withColumnRenamed("root", "label")
            break
        hooks = scratch.put(forest.groupBy("node").agg(F.min("root").alias("label")), "hooks")
        levels.append(_jumped(hooks, scratch))
        best = levels[-1].select("node", "label")
        ends = forest.join(best.toDF("node", "a"), "node").join(best.toDF("root", "end"), "root", "left").select("a", F.coalesce("end", "root").alias("b"))
        edges = scratch.put(ends.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
        scratch.drop(forest)
    while levels:
        best = levels.pop()
        lower = best.join(labels.toDF("label", "end"), "label", "left").select("node", F.coalesce("end", "label").alias("label"))
        ends = scratch.put(lower.union(labels), "ends")
        scratch.drop(best, labels)
        labels = ends
    return labels


def _components(docs: DataFrame, words: int, percent: int, id_col: str, text_col: str) -> DataFrame:
    scratch = Scratch(docs.sparkSession, "minhash")
    source = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(text_col).alias("text_hash"), F.col(text_col).alias("text"))
    kind = source.schema["doc_id"].dataType.simpleString()
    sketch = map_batches(source, _sketch(words), f"doc_id {kind}, text_hash long, n_shingles long, set_high long, set_low long, bands array<long>")
    sketch = scratch.put(sketch.withColumn("row", F.monotonically_increasing_id()), "sketch")
    digest = ["set_high", "set_low"]
    rows = sketch.drop("bands").withColumn("salt", (F.col("row") % SALTS).cast("int"))
    salted = rows.where("n_shingles > 0").groupBy(*digest, "salt").agg(F.min("row").alias("row"), F.min("doc_id").alias("smallest"))
    grouped = scratch.put(salted.groupBy(*digest).agg(F.min("row").alias("node"), F.min("smallest").alias("smallest")), "nodes")
    nodes = sketch.drop(*digest).join(grouped.select(F.col("node").alias("row")), "row", "left_semi").withColumnRenamed("row", "node")

    buckets = nodes.select("node", "n_shingles", F.posexplode("bands").alias("band", "hash")).select("node", "n_shingles", F.xxhash64("band", "hash").alias("bucket"))
    shared = scratch.put(buckets.groupBy("bucket").agg(F.count(F.lit(1)).alias("members")).where("members > 1"), "shared")
    members = scratch.put(buckets.join(shared, "bucket"), "members")
    scratch.drop(shared)
    ranked = scratch.put(members.groupBy("node").agg(F.sum("members").alias("weight"), F.first("n_shingles").alias("size")), "ranked")
    wanted = nodes.join(ranked.select("node"), "node", "left_semi").select("node", F.col("doc_id").alias("wanted_id"), F.col("text_hash").alias("wanted_hash"))
    texts = source.join(wanted, F.col("doc_id").eqNullSafe(F.col("wanted_id")) & (F.col("text_hash") == F.col("wanted_hash")))
    sets = scratch.put(map_batches(texts.select("node", "text"), _sets(words), "node long, elements array<long>"), "sets")

    labels = scratch.put(ranked.select("node", F.col("node").alias("label")), "labels")
    worth = scratch.put(_common(ranked, sets, percent), "worth")
    scratch.drop(ranked)

    def unsettled(live: DataFrame) -> DataFrame:
        """The rows of buckets with several components."""
        ends = live.groupBy("bucket").agg(F.min("label").alias("low"), F.max("label").alias("high"))
        several = scratch.put(ends.where("low <> high").select("bucket"), "several")
        rest = scratch.put(live.join(several, "bucket", "left_semi"), "live")
        scratch.drop(several)
        return rest

    def joined(labels: DataFrame, links: DataFrame) -> DataFrame:
        """labels after links (a, b) between them."""
        across = scratch.put(links.where("a <> b").distinct(), "links")
        to = connected(across, scratch)
        moved = labels.join(to.toDF("label", "to"), "label", "left").select("node", F.coalesce("to", "label").alias("label"))
        moved = scratch.put(moved, "labels")
        scratch.drop(labels, across)
        return moved

    open_ = members.select("bucket", "node").join(worth.select("node"), "node", "left_semi")
    live = unsettled(_distinct_buckets(open_, scratch).join(worth, "node").withColumn("label", F.col("node")))
    scratch.drop(members)
    pivots = live.groupBy("bucket").agg(F.max(F.struct("weight", -F.col("node"), "size", "common")).alias("p"))
    pivots = scratch.put(pivots.select("bucket", (-F.col("p.col2")).alias("pivot"), F.col("p.size").alias("pivot_size"), F.col("p.common").alias("pivot_common")), "pivots")
    most = (100 + percent) * F.least("common", "pivot_common") >= percent * (F.col("size") + F.col("pivot_size"))
    pairs = live.join(pivots, "bucket").where((F.col("node") != F.col("pivot")) & most).select("pivot", "node").distinct()
    pairs = scratch.put(pairs, "pairs")
    links = _compared(pairs, sets, percent)
    labels = joined(labels, links.select(F.greatest("pivot", "node").alias("a"), F.least("pivot", "node").alias("b")))
    scratch.drop(pairs, pivots)
    before, live = live, unsettled(live.select("bucket", "node").join(labels, "node"))
    scratch.drop(before)

    if not live.isEmpty():
        nodes_open = scratch.put(live.select("node").distinct(), "open")
        scratch.drop(live)
        narrow = scratch.put(_prefix_buckets(nodes_open, sets, percent, scratch), "prefixes")
        live = unsettled(narrow.join(labels, "node"))
        scratch.drop(narrow, nodes_open)
        heads = live.groupBy("bucket").agg(F.min("label").alias("b"))
        ties = scratch.put(live.select("bucket", "label").distinct().join(heads, "bucket").where("label <> b").select(F.col("label").alias("a"), "b").distinct(), "ties")
        families = live.select("node", "label").distinct().join(connected(ties, scratch).toDF("label", "head"), "label", "left")
        families = families.join(worth.select("node", "size"), "node").select("node", "label", F.coalesce("head", "label").alias("family"), "size")
        families = scratch.put(families, "families")
        scratch.drop(live, ties)
        labels = joined(labels, _in_blocks(families, sets, percent, scratch))

    named = labels.join(grouped.select("node", "smallest"), "node")
    named = named.join(named.groupBy("label").agg(F.min("smallest").alias("component")), "label").select("node", "component")
    whole = grouped.join(named, "node", "left").select(*digest, F.coalesce("component", "smallest").alias("component"))
    down = salted.select(*digest, "salt").join(whole, digest)
    found = rows.drop("row").join(down, [*digest, "salt"], "left")
    component = F.when(F.col("n_shingles") > 0, F.col("component")).otherwise(F.col("doc_id"))
    return scratch.end(found.select("doc_id", "text_hash", "n_shingles", component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept")))


def components(docs: DataFrame, words: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, n_shingles, component_id (the smallest id that links reach), kept."""
    return _components(docs, words, percent, id_col, text_col).drop("text_hash")


def dedup(docs: DataFrame, words: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs that are the first of their component, with all their columns."""
    theirs, hash_ = fresh(docs, "near_id_"), fresh(docs, "near_hash_")
    dropped = _components(docs, words, percent, id_col, text_col).where(~F.col("kept")).select(F.col("doc_id").alias(theirs), F.col("text_hash").alias(hash_))
    same = F.col(id_col).eqNullSafe(F.col(theirs)) & (F.xxhash64(text_col) == F.col(hash_))
    return docs.join(dropped, same, "left_anti")


def op5_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return components(read(spark, sf_dir, "documents"), words=3, percent=85)
