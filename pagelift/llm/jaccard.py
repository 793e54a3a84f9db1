"""Near-duplicate join: documents whose sets of 5-word shingles have a Jaccard similarity of 0.8 or more.

The join is exact. Equal sets are one class, a node. Two sets that are similar enough share one of the first shingles
(prefix) in any fixed order of shingles, here those of rare words first: then a prefix is shared by few but copies.

1. Posting lists: prefix shingles are dealt out with the node, its size and the largest size that a partner may have by
   the shingle's place; nodes without a possible partner in a list go before anything is written.
2. Signature trees: lists with one first node make one tree, so that near copies, which share many lists, are sent to
   few trees. Trees are grown of bitmaps first; sets without a possible partner go before any text is sent. Its leaves have bitmaps of whole sets, its nodes the OR of those below, their range of sizes and their
   component if they have one. A dual traversal of the tree with itself drops pairs of nodes whose largest possible
   overlap is too small for any sizes in their ranges, or that are linked already; pairs of leaves that remain are
   verified on the whole sets. So a tree gives the links that span its components, and no list of all pairs.
3. A tree of very many leaves is grown in parts of bounded size, each with the first node. What these leave in
   different components meets in pairs of parts, by size range; parts of one component don't meet.

Links between nodes of one component say nothing new, so no link between different texts is lost for components.

Defined cases: null and empty texts, and texts of white space, have no shingles and link with nothing. A text of fewer
than five words is one shingle, the whole sequence. Each row is a document, also where rows share a doc_id;
component_id is the smallest doc_id of the rows that can be reached, null if all of these are null. Empty tables give
empty results. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import ngrams
from .components import components
from .runtime import BROADCAST_ROWS, attach, materialize, null_safe, partitions_for, semi_join, slices, small_batches, text_or_empty, without

#: Similarity in hundredths, words of a shingle.
LEAST, WORDS = 80, 5
#: Words are counted by hash in so many cells, dealt by slabs. The counts only make the order of shingles. Words that a
#: task counts at a time.
CELLS, SLAB, COUNTED = 1 << 22, 1 << 16, 1 << 22
#: Prefix shingles of a task, and entries of one list that are held at a time.
ENTRY_ROWS, PIECE = 1 << 19, 1 << 20
#: Leaves of a tree, and shingles of all its leaves, beyond which it is grown in parts.
TREE_LEAVES, TREE_SHINGLES = 4096, 1 << 22
#: Children of a node, least bits of a bitmap (it has 4 to 8 for each shingle), bytes compared at a time.
FAN, LEAST_BITS, COMPARE_BYTES = 8, 512, 4 << 20


def _rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """doc_id, h (a hash of the text, which finds it again) and text."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_or_empty(text_col).alias("text"))
    return rows.select("doc_id", F.xxhash64("text").alias("h"), "text")


def word_levels(rows: DataFrame) -> np.ndarray:
    """For each cell of hashed words about six times the logarithm of how often these words stand in all texts.

    Each task sums its texts' words, and sends the cells that it has by slabs, so what is sent and held is bounded.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, held, n = np.zeros(CELLS, np.int64), [], 0
        for batch in batches:
            for part in slices(batch, 0):
                hashes, _, _ = ngrams.words(*ngrams.buffers(part.column(0)))
                held.append((hashes & np.uint64(CELLS - 1)).astype(np.int32))
                n += len(hashes)
                if n > COUNTED:
                    total += np.bincount(np.concatenate(held), minlength=CELLS)
                    held, n = [], 0
        if held:
            total += np.bincount(np.concatenate(held), minlength=CELLS)
        for slab, own in enumerate(total.reshape(-1, SLAB)):
            at = np.flatnonzero(own)
            if len(at):
                yield pa.record_batch([pa.array([slab]), pa.array([at.astype(np.uint16).tobytes()]), pa.array([own[at].tobytes()])], names=["slab", "cells", "counts"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[int, np.ndarray] = {}
        for batch in batches:
            for row in batch.to_pylist():
                totals.setdefault(row["slab"], np.zeros(SLAB, np.int64))[np.frombuffer(row["cells"], np.uint16)] += np.frombuffer(row["counts"], np.int64)
        for slab, own in totals.items():
            yield pa.record_batch([pa.array([slab]), pa.array([np.minimum(255, 6 * np.log2(1 + own)).astype(np.uint8).tobytes()])], names=["slab", "levels"])

    dealt = rows.select("text").mapInArrow(count, "slab long, cells binary, counts binary").repartition("slab")
    out = np.zeros((CELLS // SLAB, SLAB), np.uint8)
    for row in dealt.mapInArrow(add, "slab long, levels binary").collect():  # a byte for each cell
        out[row["slab"]] = np.frombuffer(row["levels"], np.uint8)
    return out.ravel()


def sketches(rows: DataFrame, levels: np.ndarray) -> DataFrame:
    """doc_id, h, n (size of the set), digest of the set, its prefix and its bitmap, of each row."""
    sent = rows.sparkSession.sparkContext.broadcast(levels)  # CELLS bytes

    def one(part: pa.RecordBatch) -> pa.RecordBatch:
        body, offsets = ngrams.buffers(part.column(2))
        hashes, _, of = ngrams.words(body, offsets)
        own = sent.value[(hashes & np.uint64(CELLS - 1)).astype(np.int64)].astype(np.int32)
        found, text, sums = ngrams.shingles_of(hashes, of, part.num_rows, WORDS, own)
        order = np.lexsort((found, text))
        found, text, sums = found[order], text[order], sums[order]
        new = np.ones(len(found), bool)
        new[1:] = (found[1:] != found[:-1]) | (text[1:] != text[:-1])
        found, text, sums = found[new], text[new], sums[new]
        sizes = np.bincount(text, minlength=part.num_rows) if len(text) else np.zeros(part.num_rows, np.int64)
        at = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
        sets = [found[a:b] for a, b in zip(at[:-1], at[1:], strict=True)]
        digests = [xxhash.xxh3_128_digest(x.tobytes()) for x in sets]
        taken = np.where(sizes > 0, prefix_length(sizes), 0)
        first = np.lexsort((found, sums, text))
        first = first[np.arange(len(text)) - at[text] < taken[text]] if len(text) else first
        prefix = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(taken)]), pa.int32()), pa.array(found[first].view(np.int64)))
        return pa.record_batch([part.column(0), part.column(1), pa.array(sizes, pa.int64()), pa.array(digests, pa.binary()), prefix, pa.array([bitmap(x).tobytes() for x in sets], pa.binary())], names=["doc_id", "h", "n", "digest", "prefix", "bits"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 2):
                if part.num_rows:
                    yield one(part)

    return rows.mapInArrow(run, "doc_id long, h long, n long, digest binary, prefix array<long>, bits binary")


def bitmap(shingles: np.ndarray) -> np.ndarray:
    """Bits of a set, as 64-bit numbers; half of a longer bitmap laid upon the other is the bitmap of half the length."""
    width = max(LEAST_BITS, 1 << (4 * len(shingles)).bit_length())
    flags = np.zeros(width, bool)
    flags[((shingles >> np.uint64(16)) & np.uint64(width - 1)).astype(np.int64)] = True
    return np.packbits(flags).view(np.uint64)


def prefix_length(n: np.ndarray) -> np.ndarray:
    return n - (LEAST * n + 99) // 100 + 1


def largest_partner(n: np.ndarray, place: np.ndarray) -> np.ndarray:
    """The largest set that one of n shingles can be linked with if the first that they share is at this place: no
    more are shared than follow it."""
    return np.minimum(100 * n // LEAST, (100 + LEAST) * (n - place) // LEAST - n)


def entries(reps: DataFrame) -> DataFrame:
    """shingle, n, most (the largest possible partner) and node for each prefix shingle; reps: node, n and prefix."""

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prefix = batch.column(2)
            values = prefix.flatten().to_numpy(zero_copy_only=False)
            if not len(values):
                continue
            length = pa.compute.list_value_length(prefix).to_numpy(zero_copy_only=False).astype(np.int64)
            place = np.arange(len(values)) - np.repeat(np.cumsum(length) - length, length)
            n = np.repeat(batch.column(1).to_numpy(zero_copy_only=False), length)
            node = np.repeat(batch.column(0).to_numpy(zero_copy_only=False), length)
            yield pa.record_batch([pa.array(values), pa.array(n), pa.array(largest_partner(n, place)), pa.array(node)], names=["shingle", "n", "most", "node"])

    return reps.select("node", "n", "prefix").mapInArrow(deal, "shingle long, n long, most long, node long")


def has_partner(run: np.ndarray, n: np.ndarray, most: np.ndarray) -> np.ndarray:
    """Entries of lists (run: the number of the list) in which some other entry has a size that allows a link."""
    step = np.int64(100 * n.max(initial=0) // LEAST + 2)
    key = np.sort(run * step + n)
    low, base = (LEAST * n + 99) // 100, run * step
    count = np.searchsorted(key, base + most, "right") - np.searchsorted(key, base + low, "left")
    return (count - (most >= n) > 0) & (most >= low)


def members(dealt: DataFrame) -> DataFrame:
    """key (the first node of the list) and node of each entry that has a possible partner; dealt: entries, those of a
    list after one another by size. A list longer than PIECE is looked at in pieces, in which those at the ends stay."""

    def alive(table: np.ndarray, known: int | None, whole: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """table: rows of shingle, n, most, node; known: the key of a list that is seen in pieces."""
        begin, end = (0, 0) if whole or not table.shape[1] else (table[1][0], table[1][-1])
        for _ in range(4):  # what goes makes others lonely
            if not table.shape[1]:
                break
            run = np.cumsum(np.concatenate([[0], table[0][1:] != table[0][:-1]])).astype(np.int64)
            ok = has_partner(run, table[1], table[2])
            if not whole:
                ok |= (table[2] >= end) | (LEAST * table[1] <= 100 * begin)
            if ok.all():
                break
            table = table[:, ok]
        if not table.shape[1]:
            return table[3], table[3], table[1]
        first = np.flatnonzero(np.concatenate([[True], table[0][1:] != table[0][:-1]]))
        key = np.repeat(table[3][first], np.diff(np.append(first, table.shape[1]))) if known is None else np.full(table.shape[1], known)
        return key, table[3], table[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, known = np.zeros((4, 0), np.int64), None

        def out(found: tuple[np.ndarray, ...]) -> Iterator[pa.RecordBatch]:
            if len(found[0]):
                yield pa.record_batch([pa.array(x) for x in found], names=["key", "node", "n"])

        for batch in batches:
            held = np.concatenate([held, np.stack([batch.column(k).to_numpy(zero_copy_only=False) for k in range(4)])], axis=1)
            change = np.flatnonzero(held[0][1:] != held[0][:-1]) + 1
            if len(change):
                whole, held = held[:, : change[-1]], held[:, change[-1] :]
                if known is not None:  # the last piece of a long list
                    yield from out(alive(whole[:, : change[0]], known, False))
                    whole, known = whole[:, change[0] :], None
                yield from out(alive(whole, None, True))
            if held.shape[1] > PIECE:
                known = int(held[3][0]) if known is None else known
                yield from out(alive(held, known, False))
                held = held[:, -1:]
        yield from out(alive(held, known, known is None))

    return dealt.mapInArrow(run, "key long, node long, n long").groupBy("key", "node", "n").agg(F.count(F.lit(1)).alias("lists"))


class SignatureTree:
    """Nodes over sets: OR of their bitmaps, range of sizes, most shingles that share a bit, common component if there
    is one, and whether all below are marked. sizes, bits: of the sets; component: pairs in one are passed over."""

    def __init__(self, sizes: np.ndarray, bits: list[np.ndarray], component: np.ndarray | None = None):
        label = np.arange(len(bits)) if component is None else component
        self.order = np.lexsort((label, sizes))
        self.component, self.marked = label[self.order], np.zeros(len(bits), bool)
        words = max(LEAST_BITS, 1 << (4 * int(sizes.mean())).bit_length()) // 64
        laid = np.zeros((len(bits), words), np.uint64)
        excess = np.zeros(len(bits), np.int64)
        for row, k in enumerate(self.order):
            own = bits[k]
            excess[row] = sizes[k] - int(np.bitwise_count(own).sum(dtype=np.int64))
            if len(own) > words:
                own = np.bitwise_or.reduce(own.reshape(-1, words), axis=0)
                excess[row] = sizes[k] - int(np.bitwise_count(own).sum(dtype=np.int64))
            # A shorter one is repeated: its shingles are at one of these places each.
            laid[row] = np.tile(own, words // len(own))
        n = sizes[self.order]
        level = (laid, n, n, excess)
        self.levels, self.starts = [level], []
        while len(level[1]) > FAN:
            at = np.arange(0, len(level[1]), FAN)
            level = (np.bitwise_or.reduceat(level[0], at, axis=0), np.minimum.reduceat(level[1], at), np.maximum.reduceat(level[2], at), np.maximum.reduceat(level[3], at))
            self.levels.append(level)
            self.starts.append(at)
        self._label()

    def _label(self) -> None:
        """For each level the component of nodes whose leaves have one, else -1, and whether all are marked."""
        low, done = self.component, self.marked
        self.common, self.all_marked = [low], [done]
        for at in self.starts:
            a, b = np.minimum.reduceat(low, at), np.maximum.reduceat(low, at)
            low, done = np.where(a == b, a, -1), np.logical_and.reduceat(done, at)
            self.common.append(low)
            self.all_marked.append(done)

    def possible(self, depth: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Pairs of nodes that may hold a similar pair, of different components and not both marked."""
        bits, low, high, excess = self.levels[depth]
        component, done = self.common[depth], self.all_marked[depth]
        ok = ~(done[i] & done[j]) & (100 * np.minimum(high[i], high[j]) >= LEAST * np.maximum(low[i], low[j])) & ((component[i] != component[j]) | (component[i] < 0))
        some = np.flatnonzero(ok)
        a, b = i[some], j[some]
        overlap = np.bitwise_count(bits[a] & bits[b]).sum(axis=1, dtype=np.int64) + np.minimum(excess[a], excess[b])
        overlap = np.minimum(overlap, np.minimum(high[a], high[b]))
        ok[some] = (100 + LEAST) * overlap >= LEAST * (low[a] + low[b])
        return ok

    def candidates(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Pairs of leaves that remain, by traversal of the tree with itself; components may be joined, and leaves marked,
        meanwhile."""
        top = len(self.levels) - 1
        step = max(FAN * FAN, COMPARE_BYTES // (8 * self.levels[0][0].shape[1]))
        todo = [(top, *np.triu_indices(len(self.levels[top][1])))]
        x, y = (k.ravel() for k in np.meshgrid(np.arange(FAN), np.arange(FAN), indexing="ij"))
        while todo:
            depth, i, j = todo.pop()
            if len(i) > step:
                todo += [(depth, i[k : k + step], j[k : k + step]) for k in range(0, len(i), step)]
                continue
            if depth == 0:
                i, j = i[i != j], j[i != j]
            ok = self.possible(depth, i, j)
            i, j = i[ok], j[ok]
            if not len(i):
                continue
            if depth == 0:
                yield i, j
                continue
            n = len(self.levels[depth - 1][1])
            for k in range(0, len(i), max(1, step // FAN**2)):
                own = slice(k, k + max(1, step // FAN**2))
                a, b = (i[own, None] * FAN + x).ravel(), (j[own, None] * FAN + y).ravel()
                keep = (a < n) & (b < n) & (a <= b)
                todo.append((depth - 1, a[keep], b[keep]))

    def with_partner(self) -> np.ndarray:
        """The sets (places among those given) that may be similar to some other."""
        for i, j in self.candidates():
            self.marked[i] = self.marked[j] = True
            self._label()
        return np.sort(self.order[self.marked])

    def links(self, sets: list[np.ndarray]) -> list[tuple[int, int]]:
        """Pairs of similar sets (places among those given) that span the components."""
        out = []
        for i, j in self.candidates():
            before = len(out)
            for a, b, x, y in zip(i.tolist(), j.tolist(), self.order[i].tolist(), self.order[j].tolist(), strict=True):
                if self.component[a] != self.component[b] and similar(sets[x], sets[y]):
                    out.append((x, y))
                    self.component[self.component == self.component[b]] = self.component[a]
            if len(out) > before:
                self._label()
        return out


def similar(a: np.ndarray, b: np.ndarray) -> bool:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both > 0 and 100 * both >= LEAST * (len(a) + len(b) - both)


def _screen(leaves: DataFrame) -> DataFrame:
    """Leaves that may be similar to another of their tree, by its bitmaps; leaves: tree, node, component, n and bits,
    those of a tree after one another."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held, out = None, [], []

        def search() -> None:
            if len(held) > 1:
                nodes, component, sizes, bits = zip(*held, strict=True)
                tree = SignatureTree(np.array(sizes, np.int64), [np.frombuffer(x, np.uint64) for x in bits], np.unique(component, return_inverse=True)[1])
                out.extend((at, nodes[k], component[k]) for k in tree.with_partner())

        for batch in batches:
            for tree, *leaf in zip(*(batch.column(k).to_pylist() for k in range(5)), strict=True):
                if tree != at:
                    search()
                    at, held = tree, []
                held.append(leaf)
            if out:
                yield pa.record_batch([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], names=["tree", "node", "component"])
                out = []
        search()
        if out:
            yield pa.record_batch([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], names=["tree", "node", "component"])

    return leaves.mapInArrow(run, "tree long, node long, component long")


def tree_links(dealt: DataFrame, classes: DataFrame, found: DataFrame, rows: DataFrame) -> DataFrame:
    """a and b of the links that trees find; dealt: tree, node and component of their leaves, classes: node, and the id,
    text hash and digest by which its text is found, found: sketches by node, rows: as of _rows().

    First the trees are grown of bitmaps, then, of leaves with a possible partner, again with the whole sets.
    """
    n = dealt.count()
    bits = found.select("node", "n", "bits")
    leaves = bits.join(F.broadcast(dealt), "node") if n <= BROADCAST_ROWS else bits.join(dealt, "node")
    leaves = leaves.select("tree", "node", "component", "n", "bits").repartition("tree").sortWithinPartitions("tree", "node")
    near = materialize(_screen(leaves).join(classes.select("node", "did", "h", "digest"), "node"), "jaccard-leaves")
    n = near.count()
    texts = rows.select(null_safe(F.col("doc_id")).alias("did"), "h", "text")
    if n <= BROADCAST_ROWS:
        leaves = texts.join(F.broadcast(near), ["did", "h"])
    else:  # repeated rows are one before they are sent
        ids = near.select("did", "h").distinct()
        leaves = texts.join(ids, ["did", "h"], "left_semi").groupBy("did", "h").agg(F.first("text").alias("text")).join(near, ["did", "h"])
    leaves = leaves.select("tree", "node", "component", "digest", "text").repartition("tree").sortWithinPartitions("tree", "node")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, nodes, component, sets, out = None, [], [], [], []

        def search() -> None:
            if len(nodes) > 1:
                tree = SignatureTree(np.array([len(x) for x in sets], np.int64), [bitmap(x) for x in sets], np.unique(component, return_inverse=True)[1])
                out.extend((nodes[i], nodes[j]) for i, j in tree.links(sets))

        for batch in batches:
            for part in slices(batch, 4):
                shingles = ngrams.shingle_sets(part.column(4), WORDS)
                for tree, node, root, digest, own in zip(*(part.column(k).to_pylist() for k in range(4)), shingles, strict=True):
                    if tree != at:
                        search()
                        at, nodes, component, sets = tree, [], [], []
                    # Another text of one id and hash, or the same row again, is passed over.
                    if (not nodes or nodes[-1] != node) and xxhash.xxh3_128_digest(own.tobytes()) == digest:
                        nodes.append(node)
                        component.append(root)
                        sets.append(own)
                if out:
                    yield pa.record_batch([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], names=["a", "b"])
                    out = []
        search()
        if out:
            yield pa.record_batch([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], names=["a", "b"])

    return materialize(leaves.mapInArrow(run, "a long, b long").distinct(), "jaccard-links")


def _parts(count: str, shingles: str):
    return F.ceil(F.greatest(F.col(count) / TREE_LEAVES, F.col(shingles) / TREE_SHINGLES)).cast("int")


def _part(of: str):
    return F.pmod(F.xxhash64("node"), F.col(of)).cast("int")


def search_trees(alive: DataFrame, classes: DataFrame, found: DataFrame, rows: DataFrame) -> DataFrame:
    """Links of all trees; alive: as of members(), the others as of tree_links()."""
    counts = alive.groupBy("key").agg(F.count(F.lit(1)).alias("leaves"), F.sum("n").alias("shingles")).withColumn("parts", _parts("leaves", "shingles"))
    large = materialize(counts.filter("parts > 1").select("key", "parts"), "jaccard-large")
    n_large = large.count()
    sized = alive.join(F.broadcast(large) if n_large <= BROADCAST_ROWS else large, "key", "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
    # The first node of a large tree stands in each of its parts.
    part = F.when(F.col("node") == F.col("key"), F.sequence(F.lit(0), F.col("parts") - 1)).otherwise(F.array(_part("parts")))
    own = sized.select("key", F.explode(part).alias("part"), "node")
    # Trees are told apart by a hash; two that had the same would only be one larger tree.
    links = tree_links(own.select(F.xxhash64("key", "part").alias("tree"), "node", F.col("node").alias("component")), classes, found, rows)
    if not n_large:
        return links
    leaves = sized.filter("parts > 1").select("key", "node", "n")
    leaves = leaves.join(components(links).withColumnRenamed("id", "node"), "node", "left").withColumn("root", F.coalesce("root", "node"))
    # Sets of different ranges of sizes, but for neighbours, can't be linked.
    leaves = materialize(leaves.withColumn("range", F.floor(F.log(F.col("n").cast("double")) / F.log(F.lit(100 / LEAST)) + 1e-9).cast("int")), "jaccard-large-leaves")
    by_root = leaves.groupBy("key", "range", "root").agg(F.count(F.lit(1)).alias("count"), F.sum("n").alias("shingles"))
    big = by_root.filter((F.col("count") > TREE_LEAVES // 2) | (F.col("shingles") > TREE_SHINGLES // 2)).select("key", "range", "root", F.col("root").alias("own"))
    big = materialize(big, "jaccard-big")
    n_big = big.count()
    leaves = leaves.join(F.broadcast(big) if n_big <= BROADCAST_ROWS else big, ["key", "range", "root"], "left")
    by_own = leaves.groupBy("key", "range", "own").agg(F.count(F.lit(1)).alias("count"), F.sum("n").alias("shingles"))
    by_own = materialize(by_own.select("key", "range", null_safe(F.col("own")).alias("own"), _parts("count", "shingles").alias("parts")), "jaccard-shares")
    n_own = by_own.count()
    share = by_own.select("key", "range", "own", "parts", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
    name = F.struct("range", "own", "part")
    share = share.select("key", "range", "own", name.alias("share"))
    other = share.select("key", F.col("range").alias("range_"), F.col("own").alias("own_"), F.col("share").alias("other"))
    none = null_safe(F.lit(None))
    meet = share.join(other, "key").filter("range_ in (range, range + 1) and share <= other").filter((F.col("own") != F.col("own_")) | (F.col("own") == none))
    meet = meet.select("key", "share", "other")
    dealt = leaves.withColumn("own", null_safe(F.col("own"))).join(F.broadcast(by_own) if n_own <= BROADCAST_ROWS else by_own, ["key", "range", "own"])
    dealt = dealt.select("key", "node", "root", F.struct("range", "own", _part("parts").alias("part")).alias("at"))
    in_two = meet.select("key", "share", "other", F.explode(F.array_distinct(F.array("share", "other"))).alias("at"))
    more = dealt.join(in_two, ["key", "at"]).select(F.xxhash64("key", "share", "other").alias("tree"), "node", F.col("root").alias("component"))
    return links.unionByName(tree_links(more, classes, found, rows))


def _decided(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """doc_id, h, n, copies (rows with the same set), component_id, and keep: the row, and its repetitions, is the one
    that stays of its component."""
    spark = docs.sparkSession
    small_batches(spark, 1000)
    rows = _rows(docs, id_col, text_col)
    found = sketches(rows, word_levels(rows)).withColumn("row", F.monotonically_increasing_id())
    found = materialize(found, "jaccard-sketches")
    total = found.agg(F.count(F.lit(1)).alias("n"), F.sum(F.size("prefix")).alias("p")).first()
    n_rows, n_prefix = total["n"], total["p"] or 0
    best = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "h")
    classes = found.filter("n > 0").groupBy("digest", "n").agg(F.min(F.struct("row", null_safe(F.col("doc_id")).alias("did"), "h")).alias("first"), F.min(best).alias("best"), F.count(F.lit(1)).alias("copies"))
    classes = materialize(classes.select("digest", "n", F.col("first.row").alias("node"), "first.did", "first.h", "best", "copies"), "jaccard-classes")
    found = found.withColumnRenamed("row", "node")
    reps = semi_join(found, classes.select("node"), "node", classes.count())
    small_batches(spark, 2000)
    dealt = entries(reps).repartition(partitions_for(n_prefix, ENTRY_ROWS), "shingle").sortWithinPartitions("shingle", "n", "node")
    small_batches(spark, 50_000)
    alive = materialize(members(dealt), "jaccard-members")
    small_batches(spark, 1000)
    links = search_trees(alive, classes, found, rows)
    roots = components(links)
    linked = materialize(classes.join(roots.withColumnRenamed("id", "node"), "node").select("digest", "n", "copies", "best", "root"), "jaccard-linked")
    n_linked = linked.count()
    of_root = linked.groupBy("root").agg(F.min("best").alias("first"), F.count(F.lit(1)).alias("sets"))
    several = attach(linked, of_root, ["root"], "sets", n_linked).select("digest", "n", "copies", "first")
    alone = classes.filter("copies > 1").join(linked.select("digest", "n"), ["digest", "n"], "left_anti").select("digest", "n", "copies", F.col("best").alias("first"))
    groups = materialize(several.unionByName(alone), "jaccard-groups")
    out = attach(found.select("doc_id", "h", "n", "digest"), groups, ["digest", "n"], "copies", n_rows)
    stays = F.col("doc_id").eqNullSafe(F.col("first.doc_id")) & (F.col("h") == F.col("first.h"))
    return out.select("doc_id", "h", "n", F.coalesce("copies", F.lit(1)).alias("copies"), F.when(F.col("first").isNull(), F.col("doc_id")).otherwise(F.col("first.doc_id")).alias("component_id"), (F.col("first").isNull() | stays).alias("keep"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles and component_id of every row."""
    return _decided(docs, id_col, text_col).select("doc_id", F.col("n").alias("n_shingles"), "component_id")


def keep_one(docs: DataFrame) -> DataFrame:
    """One document of each group of near duplicates, that with the smallest doc_id (null is the largest; of texts with
    one doc_id, the first by hash); of rows that are the same in id and text one stays. All columns are kept."""
    found = materialize(_decided(docs, "doc_id", "text").select(null_safe(F.col("doc_id")).alias("_did"), F.col("h").alias("_h"), "copies", "keep"), "jaccard-decided")
    again = found.filter("keep and copies > 1").groupBy("_did", "_h").agg(F.count(F.lit(1)).alias("rows")).filter("rows > 1")
    keys = {"_did": null_safe(F.col("doc_id")), "_h": F.xxhash64(text_or_empty("text"))}
    return without(docs, keys, found.filter("not keep"), again)
