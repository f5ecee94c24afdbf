"""N-gram Jaccard join with signature trees (operator 1).

Texts link when the sets of their five-word shingles have a Jaccard similarity
of 0.8 or more; the result is one row per document with its component. The join
is exact (up to 64-bit hashes) and goes in four steps.

1. All shingles of all documents are counted. They travel as the sorted
   upper 48 bits of their hashes, four bytes each, dealt by ranges; what occurs twice or more comes back
   as bitmaps, one for each of a few bounds on the count, sized by how many there
   are up to a stated bound (``MOST_BITS``; a fuller bitmap only filters less).
   A set with too many shingles that occur once can't link and is left aside.
2. All others give a prefix of their shingles, rarest first in one global order;
   two linked sets share a prefix shingle. Each joins the smallest set of that
   shingle, and the components of these joins are families: a link never leaves
   its family. Passages that many texts share are common, so they come last and
   don't tie unrelated texts to one family.
3. A family is joined by signature trees: nodes hold the OR of their members'
   bitmaps and their range of sizes, and two trees are walked together, leaving
   out node pairs whose largest possible overlap is too small, or whose members
   are known to be connected. What is left is checked on the sets. Families too
   large for one task are dealt into chunks: each meets the first chunk, then the
   members outside the largest component meet those of all chunks whose size may
   link, band of sizes by band.
4. Components of the links, joined back to all documents.

Only links that connect something new are kept, so a group of near copies costs
a spanning forest, not all its pairs. Equal sets are one node throughout.

Defined results: a null text, or one without words, has no shingles, links with
nothing and is its own component; with fewer words than five the whole sequence
is the one shingle; documents with equal sets are linked; rows that repeat a
``doc_id`` are treated each for itself; a null ``doc_id`` stays null, and names a
component only if no other id is in it; texts of any length are hashed in blocks;
an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm._components import components
from tidemark.llm._shared import bounded_batches, expected_bytes, partitions_for, shingle_hashes, stage, text_of, unstage, word_hashes

SHINGLE = 5
#: Similarity as a fraction: links need OF * intersection >= PART * union.
PART, OF = 4, 5
#: Shingles are ordered by which of these bounds their count exceeds.
BOUNDS = np.array([1, 4, 16, 64, 256, 1024, 4096, 16384])
#: Counting goes by the upper bits of a hash: the number of its cell (CELL_BITS or more) and 32 bits within. Cells travel
#: in 2 ** n rows, n between these bounds, so that a row gets the shingles of about ROW_BYTES of input.
CELL_BITS, ROW_BITS, ROW_BYTES = 16, (8, 20), 2 << 20
#: Shingles that a task sorts at once.
SORTED = 1 << 22
#: Bits of the first bitmap for each shingle that occurs twice, and the bound on all its bits; every further bitmap has half as many.
SPACE, LEAST_BITS, MOST_BITS = 6, 1 << 22, 1 << 29
#: Members and shingles that one task joins at once: memory goes with the shingles, what large families move with one over the members.
BLOCK_SETS, BLOCK_SHINGLES = 16_384, 4_000_000
LEAF, FANOUT = 32, 8


def shingle_set(text: str | None) -> np.ndarray:
    """Sorted distinct shingle hashes of a text."""
    if not text:
        return np.empty(0, np.uint64)
    found = shingle_hashes(word_hashes(text), SHINGLE)
    found.sort()
    return found[np.concatenate(([True], found[1:] != found[:-1]))] if len(found) else found


def least_overlap(n: int) -> int:
    """The smallest intersection with which a set of ``n`` can link."""
    return -(-n * PART // OF)


def linked(a: np.ndarray, b: np.ndarray) -> bool:
    both = np.concatenate((a, b))
    both.sort()
    shared = int((both[1:] == both[:-1]).sum())
    return OF * shared >= PART * (len(a) + len(b) - shared)


# ---- signature trees


class Tree:
    """Levels of nodes over rows of bitmaps: OR of the bitmaps, range of sizes, most bit collisions."""

    def __init__(self, bitmaps: np.ndarray, sizes: np.ndarray):
        self.bitmaps = bitmaps
        level = (bitmaps, sizes, sizes, sizes - np.bitwise_count(bitmaps).sum(1, dtype=np.int64))
        self.levels = []
        while not self.levels or len(level[0]) > 1:
            bits, low, high, slack = level
            at = np.arange(0, len(bits), FANOUT if self.levels else LEAF)
            level = (np.bitwise_or.reduceat(bits, at, axis=0), np.minimum.reduceat(low, at), np.maximum.reduceat(high, at), np.maximum.reduceat(slack, at))
            self.levels.append(level)

    def possible(self, level: int, i: int, j: np.ndarray) -> np.ndarray:
        """Which nodes ``j`` of a level may hold a partner of a member of node ``i``."""
        bits, low, high, slack = self.levels[level]
        shared = np.bitwise_count(bits[j] & bits[i]).sum(1, dtype=np.int64) + np.minimum(slack[i], slack[j])
        overlap = np.minimum(shared, np.minimum(high[i], high[j]))
        near = (OF * high[j] >= PART * low[i]) & (OF * high[i] >= PART * low[j])
        return near & ((OF + PART) * overlap >= PART * (low[i] + low[j]))


class _Union:
    def __init__(self, n: int):
        self.of = np.arange(n)

    def root(self, i: int) -> int:
        while self.of[i] != i:
            self.of[i] = self.of[self.of[i]]
            i = int(self.of[i])
        return i

    def join(self, i: int, j: int) -> None:
        i, j = self.root(i), self.root(j)
        self.of[max(i, j)] = min(i, j)

    def roots(self, rows: np.ndarray) -> np.ndarray:
        return np.array([self.root(int(i)) for i in rows])


def bitmap_rows(sets: list[np.ndarray]) -> np.ndarray:
    """One bitmap per set, two bits a shingle of the largest set and 256 at least."""
    width = 1 << max(8, min(16, (2 * max(map(len, sets)) - 1).bit_length()))
    out = np.zeros((len(sets), width // 64), np.uint64)
    for row, s in zip(out, sets, strict=True):
        bit = s & np.uint64(width - 1)
        np.bitwise_or.at(row, (bit >> np.uint64(6)).astype(np.int64), np.uint64(1) << (bit & np.uint64(63)))
    return out


def _folded(bitmaps: np.ndarray, words: int) -> np.ndarray:
    """Bitmaps brought down to so many words: bits that are equal modulo the new width are ORed."""
    if bitmaps.shape[1] <= words:
        return bitmaps
    return np.bitwise_or.reduce(bitmaps.reshape(len(bitmaps), -1, words), axis=1)


def join_sets(sets: list[np.ndarray], known: list | None = None, every: bool = False) -> list[tuple[int, int]]:
    """Links between sets, as far as they connect what was not connected before, or ``every`` one.

    ``known`` gives each set a label; sets with equal labels count as connected.
    """
    if len(sets) < 2:
        return []
    # by size, so that size ranges leave out most node pairs; near copies of a size often share their least shingle
    order = sorted(range(len(sets)), key=lambda i: (len(sets[i]), int(sets[i][0])))
    rows = [sets[i] for i in order]
    union = _Union(len(rows))
    if known is not None:
        first: dict = {}
        for k, i in enumerate(order):
            union.join(k, first.setdefault(known[i], k))
    sizes = np.array([len(s) for s in rows], np.int64)
    tree = Tree(bitmap_rows(rows), sizes)
    found: list[tuple[int, int]] = []
    top = len(tree.levels) - 1
    stack = [(top, i, j) for i in range(len(tree.levels[top][0])) for j in range(i, len(tree.levels[top][0]))]
    while stack:
        level, i, j = stack.pop()
        if level:
            below = len(tree.levels[level - 1][0])
            left = range(i * FANOUT, min((i + 1) * FANOUT, below))
            right = np.arange(j * FANOUT, min((j + 1) * FANOUT, below))
            for a in left:
                some = right[right >= a] if i == j else right
                if len(some):
                    stack += [(level - 1, a, int(b)) for b in some[tree.possible(level - 1, a, some)]]
            continue
        a, b = np.arange(i * LEAF, min((i + 1) * LEAF, len(rows))), np.arange(j * LEAF, min((j + 1) * LEAF, len(rows)))
        ra, rb = union.roots(a), union.roots(b)
        apart = ra[:, None] != rb[None, :]
        if i == j:
            apart &= a[:, None] < b[None, :]
        if not apart.any():
            continue
        bits = (2 * int(max(sizes[a[-1]], sizes[b[-1]])) - 1).bit_length()
        width = 1 << max(2, bits - 6)
        x, y = _folded(tree.bitmaps[a], width), _folded(tree.bitmaps[b], width)
        shared = np.zeros(apart.shape, np.int64)
        for w in range(0, x.shape[1], 64):
            shared += np.bitwise_count(x[:, None, w : w + 64] & y[None, :, w : w + 64]).sum(2, dtype=np.int64)
        na, nb = sizes[a][:, None], sizes[b][None, :]
        lone_a, lone_b = np.bitwise_count(x).sum(1, dtype=np.int64)[:, None], np.bitwise_count(y).sum(1, dtype=np.int64)[None, :]
        # every bit of one set only is at least one shingle of that set only
        overlap = np.minimum(na - (lone_a - shared), nb - (lone_b - shared))
        for p, q in np.argwhere(apart & ((OF + PART) * overlap >= PART * (na + nb))):
            u, v = int(a[p]), int(b[q])
            if (every or union.root(u) != union.root(v)) and linked(rows[u], rows[v]):
                if not every:
                    union.join(u, v)
                found.append((order[u], order[v]))
    return found


# ---- distributed steps


class Cells:
    """How upper bits of hashes are dealt to cells, and cells to rows."""

    def __init__(self, row_bits: int):
        self.cell_bits = max(CELL_BITS, row_bits)
        self.rows, self.row_cells = 1 << row_bits, 1 << (self.cell_bits - row_bits)

    def upper(self, hashes: np.ndarray) -> np.ndarray:
        return hashes >> np.uint64(32 - self.cell_bits)

    def place(self, values: np.ndarray, bits: int) -> np.ndarray:
        """The bit of each value in a bitmap of ``bits`` bits: its upper bits, so that a row's bits lie together."""
        return values >> np.uint64(self.cell_bits + 32 - (bits.bit_length() - 1))

    def pack(self, values: np.ndarray) -> Iterator[tuple[int, bytes, slice]]:
        """Sorted values -> (row, payload, where its values stand): the sizes of the row's cells, then the lower 32 bits."""
        low, cell = values.astype("<u4"), values >> np.uint64(32)
        row = (cell // np.uint64(self.row_cells)).astype(np.int64)
        begin = np.flatnonzero(np.concatenate(([True], row[1:] != row[:-1])))
        for a, b in zip(begin.tolist(), np.append(begin[1:], len(row)).tolist(), strict=True):
            own = (cell[a:b] - np.uint64(int(row[a]) * self.row_cells)).astype(np.int64)
            yield int(row[a]), np.bincount(own, minlength=self.row_cells).astype("<u4").tobytes() + low[a:b].tobytes(), slice(a, b)

    def unpack(self, row: int, payload: bytes) -> np.ndarray:
        data = np.frombuffer(payload, "<u4")
        cells = np.arange(row * self.row_cells, (row + 1) * self.row_cells, dtype=np.uint64) << np.uint64(32)
        return np.repeat(cells, data[: self.row_cells]) | data[self.row_cells :].astype(np.uint64)


def _runs(values: np.ndarray, counts: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct values of a sorted array and how often (or with which sum of counts) each occurs."""
    at = np.flatnonzero(np.concatenate(([True], values[1:] != values[:-1])))
    return values[at], np.diff(np.append(at, len(values))) if counts is None else np.add.reduceat(counts, at)


COUNTS = "row int, payload binary, more binary"


def _sorted_batches(batches: Iterator[pa.RecordBatch], cells: Cells) -> Iterator[pa.RecordBatch]:
    """Texts -> rows of sorted shingles; ``more`` has the counts where any is over one."""
    held: list[np.ndarray] = []
    size = 0

    def flushed() -> Iterator[pa.RecordBatch]:
        values = np.concatenate(held)
        values.sort()
        values, counts = _runs(values)
        counts = counts.astype("<u4")
        out, total = [], 0
        for row, payload, at in cells.pack(values):
            out.append((row, payload, counts[at].tobytes() if int(counts[at].max()) > 1 else None))
            total += len(payload)
            if total >= 1 << 20:
                yield rows(out)
                out, total = [], 0
        if out:
            yield rows(out)

    def rows(out: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), (pa.int32(), pa.binary(), pa.binary()), strict=True)], ["row", "payload", "more"])

    for batch in batches:
        for x in text_of(batch.column(0)):
            found = cells.upper(shingle_set(x))
            for at in range(0, len(found), SORTED):
                held.append(found[at : at + SORTED])
                size += len(held[-1])
                if size >= SORTED:
                    yield from flushed()
                    held, size = [], 0
    if held:
        yield from flushed()


REPEATED = "row int, payload binary, levels binary, n long"


def _repeated_batches(batches: Iterator[pa.RecordBatch], cells: Cells) -> Iterator[pa.RecordBatch]:
    """Rows sorted by ``row`` -> the shingles that occur twice or more, with the number of bounds each count exceeds."""
    held: list[tuple[np.ndarray, np.ndarray]] = []
    size, now = 0, None

    def merged() -> tuple[np.ndarray, np.ndarray]:
        values, counts = (np.concatenate(c) for c in zip(*held, strict=True))
        order = np.argsort(values, kind="stable")
        return _runs(values[order], counts[order])

    def done() -> Iterator[pa.RecordBatch]:
        values, counts = merged()
        often = counts > BOUNDS[0]
        if often.any():
            level = np.searchsorted(BOUNDS, counts[often], "left").astype(np.uint8)
            payload = next(cells.pack(values[often]))[1]
            yield pa.RecordBatch.from_arrays([pa.array([now], pa.int32()), pa.array([payload], pa.binary()), pa.array([level.tobytes()], pa.binary()), pa.array([int(often.sum())], pa.int64())], ["row", "payload", "levels", "n"])

    for batch in batches:
        for row, payload, more in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if row != now:
                if held:
                    yield from done()
                held, size, now = [], 0, row
            values = cells.unpack(row, payload)
            held.append((values, np.ones(len(values), np.int64) if more is None else np.frombuffer(more, "<u4").astype(np.int64)))
            size += len(values)
            if size > SORTED and len(held) > 1:  # what repeats is added up before all is there
                held = [merged()]
                size = len(held[0][0]) // 2
    if held:
        yield from done()


def bitmap_sizes(repeated: int, cells: Cells) -> list[int]:
    """Bits of each bitmap for so many repeated shingles."""
    first = min(MOST_BITS, max(LEAST_BITS, 1 << max(0, SPACE * repeated - 1).bit_length()))
    return [max(first >> k, LEAST_BITS >> 4, 8 * cells.rows) for k in range(len(BOUNDS))]


def _bitmaps(repeated: DataFrame, cells: Cells) -> list[np.ndarray]:
    """For each bound a bitmap of the shingles that occur more often."""
    sizes = bitmap_sizes(repeated.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0], cells)
    out = [np.zeros(bits // 8, np.uint8) for bits in sizes]

    def segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, payload, levels, _ in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                values, level = cells.unpack(row, payload), np.frombuffer(levels, np.uint8)
                found = []
                for k, bits in enumerate(sizes):
                    own = np.zeros(bits // cells.rows, np.uint8)
                    own[(cells.place(values[level > k], bits) - np.uint64(row * len(own))).astype(np.int64)] = 1
                    found.append(np.packbits(own, bitorder="little").tobytes())
                yield pa.RecordBatch.from_arrays([pa.array([row], pa.int32()), pa.array([found], pa.list_(pa.binary()))], ["row", "bits"])

    for r in repeated.mapInArrow(segments, "row int, bits array<binary>").toLocalIterator():  # all together as large as the bitmaps
        for whole, raw in zip(out, r["bits"], strict=True):
            part = len(whole) // cells.rows
            whole[r["row"] * part : (r["row"] + 1) * part] = np.frombuffer(raw, np.uint8)
    return out


class Levels:
    """How many bounds a shingle's count exceeds, as far as the bitmaps tell: 0 is certain."""

    def __init__(self, cells: Cells, bitmaps: list[np.ndarray]):
        self.cells, self.bitmaps = cells, bitmaps

    def of(self, found: np.ndarray) -> np.ndarray:
        values = self.cells.upper(found)
        out = np.zeros(len(values), np.int8)
        rest = np.arange(len(values))
        for bitmap in self.bitmaps:
            bit = self.cells.place(values[rest], 8 * len(bitmap))
            rest = rest[bitmap[(bit >> np.uint64(3)).astype(np.int64)] >> (bit & np.uint64(7)).astype(np.uint8) & 1 > 0]
            if not len(rest):
                break
            out[rest] += 1
        return out


def prefix_of(found: np.ndarray, levels: Levels) -> np.ndarray | None:
    """The part of a set's prefix that may be shared, rarest first; None if the set can't link."""
    n = len(found)
    spare = n - least_overlap(n)
    level = levels.of(found)
    again = np.flatnonzero(level)
    once = n - len(again)
    if once > spare:
        return None
    return found[again[np.argsort(level[again], kind="stable")[: spare + 1 - once]]]


SETS = "doc_id long, text_hash long, n_shingles long, node long, prefix array<long>, shingles binary"


def _set_batches(batches: Iterator[pa.RecordBatch], levels) -> Iterator[pa.RecordBatch]:
    """A row for each document; what a set links by is given with the first of its copies that a task meets."""
    given: set[int] = set()
    for batch in batches:
        sizes, nodes, prefixes, kept = [], [], [], []
        for x in text_of(batch.column(1)):
            found = shingle_set(x)
            sizes.append(len(found))
            node = prefix = raw = None
            if len(found):
                raw = found.tobytes()
                node = int.from_bytes(hashlib.blake2b(raw, digest_size=8).digest(), "little", signed=True)
                if node not in given:
                    prefix = prefix_of(found, levels.value)
                    if len(given) >= 1 << 17:
                        given.clear()
                    given.add(node)
            nodes.append(node)
            prefixes.append(None if prefix is None else prefix.view(np.int64))
            kept.append(None if prefix is None else raw)
        kinds = (pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.binary())
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), *(pa.array(c, k) for c, k in zip((sizes, nodes, prefixes, kept), kinds, strict=True))], ["doc_id", "text_hash", "n_shingles", "node", "prefix", "shingles"])


def _join_batches(batches: Iterator[pa.RecordBatch], labelled: bool, every: bool) -> Iterator[pa.RecordBatch]:
    """Rows sorted by block -> links; a block's sets are held one block at a time."""
    block, nodes, sets, known = None, [], [], []

    def links() -> Iterator[pa.RecordBatch]:
        found = join_sets(sets, known if labelled else None, every)
        if found:
            yield pa.RecordBatch.from_arrays([pa.array([nodes[i] for i, _ in found], pa.int64()), pa.array([nodes[j] for _, j in found], pa.int64())], ["a", "b"])

    for batch in batches:
        for key, node, raw, label in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
            if key != block:
                yield from links()
                block, nodes, sets, known = key, [], [], []
            if nodes and nodes[-1] == node:  # rows are sorted by node: a set that stands in both halves of a block
                continue
            nodes.append(node)
            sets.append(np.frombuffer(raw, np.uint64))
            known.append(label)
    yield from links()


def _join_blocks(rows: DataFrame, partitions: int, labelled: bool = False, every: bool = False) -> DataFrame:
    """(block, node, shingles, label) -> links (a, b) found within blocks."""
    placed = rows.repartition(partitions, "block").sortWithinPartitions("block", "node")
    return placed.mapInArrow(lambda b: _join_batches(b, labelled, every), "a long, b long")


def families(documents: DataFrame, block_sets: int, block_shingles: int) -> tuple[DataFrame, DataFrame]:
    """A row for each document with its set, and one for each set that shares a prefix shingle: its family and its chunk there."""
    spark = documents.sparkSession
    bounded_batches(spark)
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.xxhash64("text").alias("text_hash"))
    cells = Cells(min(max((expected_bytes(rows) // ROW_BYTES).bit_length(), ROW_BITS[0]), ROW_BITS[1]))
    counted = rows.select("text").mapInArrow(lambda b: _sorted_batches(b, cells), COUNTS).repartition(partitions_for(rows), "row").sortWithinPartitions("row")
    repeated = stage(counted.mapInArrow(lambda b: _repeated_batches(b, cells), REPEATED), "repeated-shingles")
    levels = spark.sparkContext.broadcast(Levels(cells, _bitmaps(repeated, cells)))  # of bounded size, see MOST_BITS
    unstage(repeated)

    sets = stage(rows.mapInArrow(lambda b: _set_batches(b, levels), SETS), "sets")
    candidates = sets.filter("prefix IS NOT NULL")
    # written, so that both sides of the join are dealt anew and a very common shingle can be split
    tokens = stage(candidates.select("node", F.explode("prefix").alias("shingle")).distinct(), "prefixes")
    least = stage(tokens.groupBy("shingle").agg(F.min("node").alias("b"), F.max("node").alias("_top")).filter("b <> _top").select("shingle", "b"), "least-of-shingles")
    edges = stage(tokens.join(least, "shingle").select(F.col("node").alias("a"), "b").filter("a <> b").distinct(), "prefix-links")
    unstage(tokens), unstage(least)
    family = stage(components(edges), "families")
    unstage(edges)

    # which block a set goes to is settled on narrow rows; the sets themselves are dealt out once by node, once by block
    sizes = candidates.groupBy("node").agg(F.max("n_shingles").alias("n_shingles"))
    members = family.join(sizes, "node").select("node", F.col("root").alias("family"), "n_shingles")
    size = members.groupBy("family").agg(F.count("*").alias("members"), F.sum("n_shingles").alias("total"))
    # chunks of half a block, so that two of them make one
    chunks = F.greatest(F.ceil(2 * F.col("members") / F.lit(block_sets)), F.ceil(2 * F.col("total") / F.lit(block_shingles))).cast("int")
    size = size.select("family", F.when((F.col("members") <= block_sets) & (F.col("total") <= block_shingles), 1).otherwise(chunks).alias("chunks"))
    sized = stage(members.join(size, "family").withColumn("chunk", F.pmod(F.xxhash64("node"), F.col("chunks")).cast("int")), "members")
    unstage(family)
    return sets, sized


def linked_sets(documents: DataFrame, block_sets: int = BLOCK_SETS, block_shingles: int = BLOCK_SHINGLES) -> tuple[DataFrame, DataFrame]:
    """A row for each document with its set's size and node, and the root of every node that has a link."""
    sets, sized = families(documents, block_sets, block_shingles)
    meets = F.when(F.col("chunks") == 1, F.array(F.lit(0))).when(F.col("chunk") == 0, F.sequence(F.lit(1), F.col("chunks") - 1)).otherwise(F.array("chunk"))
    first = _with_sets(sets, sized).select(F.explode(meets).alias("part"), "family", "node", "shingles").select(F.xxhash64("family", "part").alias("block"), "node", "shingles", F.lit(0).cast("long").alias("label"))
    links = stage(_join_blocks(first, partitions_for(sets)), "found-links")

    if sized.filter("chunks > 1").limit(1).count():
        links = _join_rest(sets, sized.filter("chunks > 1"), links, block_sets, block_shingles)
    return sets.select("doc_id", "text_hash", "n_shingles", "node"), components(links)


def _with_sets(sets: DataFrame, rows: DataFrame) -> DataFrame:
    """Add to rows (node, ...) the node's shingles; of equal sets one is taken, before the shuffle where they meet."""
    held = sets.filter("prefix IS NOT NULL").select("node", "shingles").dropDuplicates(["node"])
    return rows.join(held, "node")


def _join_rest(sets: DataFrame, sized: DataFrame, links: DataFrame, block_sets: int, block_shingles: int) -> DataFrame:
    """Let the members of large families outside their family's largest component meet all others they may link with.

    Sizes go in bands, each reaching to OF / PART of its least size, so that links
    lie within a band or between two neighbours.
    """
    labels = components(links)
    band = F.floor(F.log("n_shingles") / F.log(F.lit(OF / PART)) + F.lit(1e-9)).cast("int")
    known = stage(sized.join(labels, "node", "left").withColumn("label", F.coalesce("root", "node")).withColumn("band", band).drop("root"), "large-families")
    parts = known.groupBy("family", "label").agg(F.count("*").alias("n"))
    largest = parts.groupBy("family").agg(F.max_by("label", F.struct("n", "label")).alias("largest"))
    rest = known.join(largest, "family").filter("label <> largest").drop("largest")

    def chunks(rows: DataFrame, name: str) -> DataFrame:
        return rows.groupBy("family", "band").agg(F.greatest(F.ceil(2 * F.count("*") / F.lit(block_sets)), F.ceil(2 * F.sum("n_shingles") / F.lit(block_shingles))).cast("int").alias(name))

    # a member of the rest visits its own band and both neighbours: rows of (family, band it visits, band it has)
    near = rest.withColumn("own", F.col("band")).withColumn("band", F.explode(F.array(F.col("own") - 1, "own", F.col("own") + 1)))
    rest_chunks = near.groupBy("family", "band").agg(F.greatest(F.ceil(2 * F.count("*") / F.lit(block_sets)), F.ceil(2 * F.sum("n_shingles") / F.lit(block_shingles))).cast("int").alias("rest_chunks"))
    size = stage(rest_chunks.join(chunks(known, "band_chunks"), ["family", "band"]), "bands")
    columns = ["family", "band", "i", "j", "node", "label"]
    some = near.join(size, ["family", "band"]).withColumn("i", F.pmod(F.xxhash64("node", F.lit(7)), F.col("rest_chunks")).cast("int")).withColumn("j", F.explode(F.sequence(F.lit(0), F.col("band_chunks") - 1))).select(columns)
    every = known.join(size, ["family", "band"]).withColumn("i", F.explode(F.sequence(F.lit(0), F.col("rest_chunks") - 1))).withColumn("j", F.pmod(F.xxhash64("node", F.lit(11)), F.col("band_chunks")).cast("int")).select(columns)
    blocks = some.unionByName(every).select(F.xxhash64("family", "band", "i", "j").alias("block"), "node", "label").distinct()
    more = stage(_join_blocks(_with_sets(sets, blocks).select("block", "node", "shingles", "label"), partitions_for(sets), labelled=True), "more-links")
    return links.unionByName(more)


def similarity_components(documents: DataFrame, block_sets: int = BLOCK_SETS, block_shingles: int = BLOCK_SHINGLES) -> DataFrame:
    """doc_id, n_shingles and component_id (the smallest doc_id reachable by links) of every row."""
    sets, roots = linked_sets(documents, block_sets, block_shingles)
    first = sets.filter("node IS NOT NULL").groupBy("node").agg(F.min("doc_id").alias("first"))
    rooted = first.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    least = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    named = rooted.join(least, "root").select("node", "component_id")
    out = sets.join(named, "node", "left")
    return out.select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))


def linked_pairs(documents: DataFrame, block_sets: int = BLOCK_SETS, block_shingles: int = BLOCK_SHINGLES) -> tuple[DataFrame, DataFrame]:
    """All links between different sets as (a, b) with a < b, and the (doc_id, node) of every document that has a set.

    Copies are one node. The pairs of a group of near copies are as many as they
    are: what the other results leave out is here the result. Of a family larger
    than one task all chunks meet.
    """
    sets, sized = families(documents, block_sets, block_shingles)
    other = F.explode(F.sequence(F.lit(0), F.col("chunks") - 1))
    placed = _with_sets(sets, sized).select("family", "node", "shingles", "chunk", other.alias("other"))
    block = F.xxhash64("family", F.least("chunk", "other"), F.greatest("chunk", "other"))
    found = _join_blocks(placed.select(block.alias("block"), "node", "shingles", F.lit(0).cast("long").alias("label")), partitions_for(sets), every=True)
    pairs = stage(found.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "linked-pairs")
    return pairs, sets.filter("node IS NOT NULL").select("doc_id", "node")


def link_counts(documents: DataFrame, block_sets: int = BLOCK_SETS, block_shingles: int = BLOCK_SHINGLES) -> DataFrame:
    """doc_id and n_links, the number of other documents that each is linked to, of all documents that have a set."""
    pairs, members = linked_pairs(documents, block_sets, block_shingles)
    copies = members.groupBy("node").agg(F.count("*").alias("copies"))
    both = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
    near = both.join(copies.withColumnRenamed("node", "b"), "b").groupBy("a").agg(F.sum("copies").alias("near"))
    counted = copies.join(near, copies["node"] == near["a"], "left").select("node", (F.col("copies") - 1 + F.coalesce("near", F.lit(0))).alias("n_links"))
    return members.join(counted, "node").select("doc_id", "n_links")


def keep_one_of_each(documents: DataFrame) -> DataFrame:
    """The documents without those that are linked to one that stays: of each component one row, with all its columns.

    It is the row with the smallest doc_id (null last), of equal ids that with the
    smallest hash of its text, of rows equal in both any one. Rows without a word
    are in no component and all stay.
    """
    sets, roots = linked_sets(documents)
    least = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_hash")
    first = sets.filter("node IS NOT NULL").groupBy("node").agg(F.min(least).alias("first"))
    rooted = stage(first.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node")), "rooted")
    heads = stage(rooted.groupBy("root").agg(F.min("first").alias("head")), "heads")
    of = stage(rooted.join(heads, "root").select("node", "head.doc_id", "head.text_hash"), "heads-of-sets").select("node", F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash"))
    other = sets.join(of, "node").filter(~(F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("text_hash") == F.col("_hash"))))
    gone = other.select(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash")).distinct()
    names = documents.columns
    rows = documents.select(F.struct(*names).alias("_row"), F.col("doc_id").cast("long").alias("_doc"), F.xxhash64(F.col("text").cast("string")).alias("_text"))
    kept = rows.join(gone, rows["_doc"].eqNullSafe(gone["_id"]) & (rows["_text"] == gone["_hash"]), "left_anti")
    # rows that are equal in id and text are few: most keys have one row
    order = Window.partitionBy("_doc", "_text").orderBy(F.xxhash64("_row"))
    wordless = ~F.coalesce(F.col("_row.text").cast("string").rlike(r"[^ \t-\r]"), F.lit(False))
    return kept.withColumn("_rank", F.row_number().over(order)).filter((F.col("_rank") == 1) | wordless).select("_row.*")


#: The same rows in DuckDB, over a table ``documents``: all pairs of sets that share a shingle. For small tables.
SQL = r"""
WITH RECURSIVE word AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS words FROM documents
), place AS (SELECT doc_id, words, unnest(range(1, greatest(len(words) - 4, 1) + 1)) AS i FROM word WHERE len(words) > 0
), gram AS (SELECT DISTINCT doc_id, array_to_string(list_slice(words, i, i + 4), ' ') AS gram FROM place
), doc AS (SELECT doc_id, count(*) AS n, md5(string_agg(gram, chr(10) ORDER BY gram)) AS node FROM gram GROUP BY doc_id
), node AS (SELECT node, any_value(n) AS n, min(doc_id) AS first FROM doc GROUP BY node
), own AS (SELECT node, n, gram FROM node JOIN gram ON gram.doc_id = node.first
), pair AS (
  SELECT a.node AS a, b.node AS b FROM own a JOIN own b ON a.gram = b.gram AND a.node < b.node AND 5 * least(a.n, b.n) >= 4 * greatest(a.n, b.n)
  GROUP BY a.node, b.node, a.n, b.n HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))
), link AS (SELECT a, b FROM pair UNION ALL SELECT b, a FROM pair
), reach AS (SELECT node AS a, node AS b FROM node UNION SELECT reach.a, link.b FROM reach JOIN link ON reach.b = link.a
), least_of AS (SELECT reach.a AS node, min(node.first) AS component_id FROM reach JOIN node ON reach.b = node.node GROUP BY reach.a
)
SELECT d.doc_id, coalesce(doc.n, 0) AS n_shingles, coalesce(l.component_id, d.doc_id) AS component_id
FROM documents d LEFT JOIN doc ON d.doc_id = doc.doc_id LEFT JOIN least_of l ON doc.node = l.node
"""
