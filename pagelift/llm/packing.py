"""Packing of documents into sequences by cutting-stock column generation.

Documents are tokenized once, where they are. Each is cut at the sequence length; what remains is an item. Items are
counted by length class (a histogram of at most CLASSES rows, whatever the corpus). A linear program over patterns
(how many items of each class share a sequence) is solved by column generation: a knapsack dynamic program prices new
patterns by the dual values. Rounded patterns take documents by their rank within a class. The few tokens that the
classes leave over in a sequence are filled with pieces of filler documents, chosen by a hash of their id as often as
items of their length leave gaps; these alone are cut at other places. No ids are shuffled but those of fillers.

Defined cases: null text is empty, so such a document is the end id alone. Rows of one doc_id are packed each for
itself. Documents longer than a sequence are cut into full sequences and an item. An empty table gives no rows. Other
columns are not read.
"""

from __future__ import annotations

import json
import re
import zlib
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .runtime import give_back, materialize, partitions_for, slices, small_batches, text_or_empty

#: Classes of lengths; a class is SEQUENCE / CLASSES tokens wide.
CLASSES = 256
#: Tokens of fillers for each item besides what its class leaves over: rounding leaves more in small tables. Items of
#: fewer than FULL tokens, of which more share a sequence, have the less.
FILL, FULL = 56, 256
#: A pattern must be worth so much more than a sequence to be a better one; below that the difference is rounding.
TOLERANCE = 1e-7
#: The basis is inverted anew after so many of its patterns were replaced, so that errors do not add up.
REPLACED = 50
#: Items of one rank group, and sequences and fillers' tokens of one filling task.
RANK_ROWS, FILL_ROWS, FILL_TOKENS = 200_000, 20_000, 1 << 19

PIECE = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, ids binary"

# The plain path covers ASCII and these letters and signs, for which lower-casing and NFC change no more than the case.
_LETTERS = "a-zªµºß-öø-ÿĀ-įı-ňŊ-ſ"
_DIGITS = "0-9²³¹¼½¾"
_PLAIN = re.compile("[\t-\r -~¡-¬®-įı-ňŊ-ſ]*")
_PIECES = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{_LETTERS}]+|[{_DIGITS}]|[^\\s{_LETTERS}{_DIGITS}]+")


# The normalizer and the splitting rule that the plain path follows.
_NORMALIZER = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]}
_SPLIT = {"type": "Sequence", "pretokenizers": [
    {"type": "Split", "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"}, "behavior": "Removed", "invert": True},
    {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
]}


class WordTokenizer:
    """Ids of a text as little-endian 32-bit integers, equal to those of the tokenizers library.

    The vocabulary's pre-tokenizer never joins what white space separates, so chunks between white space are
    tokenized once and remembered, in two generations of at most KEPT entries of at most LONGEST characters. Texts with
    characters beyond the plain ones, or with a special token's string, go to the library as they are; so do all texts
    if the file has other rules than those followed here.
    """

    KEPT, LONGEST = 200_000, 64

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        rules = json.loads(Path(path).read_text())
        self.followed = rules.get("normalizer") == _NORMALIZER and rules.get("pre_tokenizer") == _SPLIT and not rules.get("truncation") and all(t["content"].startswith("<|") for t in rules.get("added_tokens", []))
        self.model, self.new, self.old = self.whole.model, {}, {}
        printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
        rest = [b for b in range(256) if b not in set(printable)]
        self.table = {b: chr(b) for b in printable} | {b: chr(256 + i) for i, b in enumerate(rest)}

    def _chunk(self, chunk: str) -> bytes:
        found = self.old.get(chunk)
        if found is None:
            ids = []
            for piece in _PIECES.findall(chunk.lower()):
                ids += [t.id for t in self.model.tokenize(piece if piece.isascii() else piece.encode().decode("latin-1").translate(self.table))]
            found = np.array(ids, "<u4").tobytes()
        if len(chunk) <= self.LONGEST:
            if len(self.new) >= self.KEPT:
                self.new, self.old = {}, self.new
            self.new[chunk] = found
        return found

    def ids(self, text: str) -> bytes:
        if not self.followed or "<|" in text or not _PLAIN.fullmatch(text):
            return np.array(self.whole.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        get, chunk = self.new.get, self._chunk
        return b"".join([get(w) or chunk(w) for w in text.split()])


_tokenizers: dict[str, WordTokenizer] = {}


def tokenizer(path: str) -> WordTokenizer:
    """One for each worker process, which keeps its memory from task to task."""
    if path not in _tokenizers:
        _tokenizers[path] = WordTokenizer(path)
    return _tokenizers[path]


def filler_share(length: int, width: int) -> float:
    """How many of the items of a length are fillers: their tokens are what the others of that length leave over."""
    left = -length % width + FILL * min(1.0, length / FULL)
    return left / (left + length)


def tokenize(docs: DataFrame, path: str, end_id: int, sequence: int) -> DataFrame:
    """Pieces of each document: full sequences and an item; ids only of the items that are fillers."""
    names = [x.split()[0] for x in PIECE.split(", ")]
    end, width = np.array([end_id], "<u4").tobytes(), sequence // CLASSES

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok = tokenizer(path)
        for batch in batches:
            for part in slices(batch, 1):
                out: list[tuple] = []
                for doc_id, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                    ids = tok.ids(text) + end
                    n = len(ids) // 4
                    for start in range(0, n, sequence):
                        own = ids[4 * start : 4 * (start + sequence)]
                        k = len(own) // 4
                        filler = k < sequence and xxhash.xxh64_intdigest(f"{doc_id} {start} {zlib.crc32(own)}", seed=8) / 2**64 < filler_share(k, width)
                        out.append((doc_id, start, k, zlib.crc32(own), n, own if filler else None))
                yield pa.record_batch([pa.array(c, pa.binary() if i == 5 else pa.int64()) for i, c in enumerate(zip(*out, strict=True))], names=names)
        give_back()

    small_batches(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long"), text_or_empty("text").alias("text")).mapInArrow(run, PIECE)


def price(values: np.ndarray, sizes: np.ndarray, capacity: int) -> tuple[float, np.ndarray]:
    """Unbounded knapsack by dynamic programming: the best value, and how often each size is taken."""
    best, taken = np.zeros(capacity + 1), np.full(capacity + 1, -1)
    for room in range(1, capacity + 1):
        fit = sizes <= room
        gains = np.where(fit, values + best[np.maximum(room - sizes, 0)], -1.0)
        k = int(gains.argmax()) if len(gains) else 0
        if len(gains) and gains[k] > best[room - 1]:
            best[room], taken[room] = gains[k], k
        else:
            best[room] = best[room - 1]
    counts, room = np.zeros(len(sizes), int), capacity
    while room > 0:
        if taken[room] < 0:
            room -= 1
        else:
            counts[taken[room]] += 1
            room -= sizes[taken[room]]
    return float(best[capacity]), counts


def _inverted(basis: np.ndarray) -> np.ndarray:
    """Gauss-Jordan elimination with row exchanges, row operations only: the driver's linear algebra library is threaded."""
    n = len(basis)
    work = np.hstack([basis, np.eye(n)])
    for i in range(n):
        k = i + int(np.abs(work[i:, i]).argmax())
        if k != i:
            work[[i, k]] = work[[k, i]]
        work[i] /= work[i, i]
        factors = work[:, i].copy()
        factors[i] = 0.0
        hit = np.flatnonzero(factors)
        work[hit] -= factors[hit, None] * work[i]
    return work[:, n:]


def column_generation(sizes: np.ndarray, demand: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Patterns (rows) and how often each is used in an optimum of the linear program (revised simplex): the fewest
    sequences that hold the demand, if parts of them were allowed.

    The demand is stretched by a hair, differently for each size, so that no two patterns would leave at once: each step
    then uses fewer sequences than the one before, no basis comes twice, and the steps end.
    """
    m = len(sizes)
    if not m:
        return np.zeros((0, 0), int), np.zeros(0)
    basis = np.diag((capacity // sizes).astype(float))  # a column is a pattern
    inverse = np.diag(1 / np.diag(basis))
    stretched = demand * (1 + 1e-9 * np.arange(1, m + 1))
    replaced = 0
    while True:
        value, pattern = price(np.maximum(inverse.sum(axis=0), 0), sizes, capacity)
        if value <= 1 + TOLERANCE or (basis == pattern[:, None]).all(axis=0).any():
            if not replaced:
                break
            inverse, replaced = _inverted(basis), 0  # whether that is so without rounding errors
            continue
        use, step = inverse @ stretched, inverse @ pattern
        ratio = np.where(step > 1e-9, use / np.where(step > 1e-9, step, 1), np.inf)
        out = int(ratio.argmin())
        basis[:, out] = pattern
        replaced += 1
        if replaced >= REPLACED:
            inverse, replaced = _inverted(basis), 0
            continue
        # The column that leaves is replaced in the inverse.
        pivot = inverse[out] / step[out]
        inverse = inverse - np.outer(step, pivot)
        inverse[out] = pivot
    return basis.T.astype(int), np.maximum(inverse @ demand, 0)


def patterns(histogram: dict[int, int], capacity: int = CLASSES) -> list[tuple[dict[int, int], int]]:
    """(items of each class, times) that use up a histogram {class: items}; a class is as wide as its number."""
    if not histogram:
        return []
    sizes = np.array(sorted(histogram, reverse=True))
    left = np.array([histogram[s] for s in sizes], dtype=np.int64)
    out = []

    def take(counts: np.ndarray, times: int) -> None:
        nonlocal left
        if times > 0:
            left = left - counts * times
            out.append(({int(s): int(c) for s, c in zip(sizes, counts, strict=True) if c}, int(times)))

    for pattern, use in zip(*column_generation(sizes, left.astype(float), capacity), strict=True):
        hit = pattern > 0
        take(pattern, min(int(use + 1e-6), int((left[hit] // pattern[hit]).min())))
    while left.any():  # what rounding down left: largest first, as often as the counts allow
        counts, room = np.zeros(len(sizes), np.int64), capacity
        for i, s in enumerate(sizes):
            counts[i] = min(left[i], room // s)
            room -= counts[i] * s
        hit = counts > 0
        take(counts, int((left[hit] // counts[hit]).min()))
    return out


def _assignment(found: list[tuple[dict[int, int], int]]) -> list[tuple[int, int, int, int, int, int]]:
    """class, first and last rank, first sequence, items of the class in a sequence, first slot."""
    next_rank: dict[int, int] = {}
    rows, sequence = [], 0
    for counts, times in found:
        slot = 0
        for size, per in counts.items():
            low = next_rank.get(size, 0)
            rows.append((size, low, low + per * times, sequence, per, slot))
            next_rank[size] = low + per * times
            slot += per
        sequence += times
    return rows


def _ranked(items: DataFrame, n_items: int) -> DataFrame:
    """items with their rank in a class. A class is cut into groups by a hash, whose counts are summed up first."""
    groups = partitions_for(n_items, RANK_ROWS)
    items = items.withColumn("part", F.pmod(F.xxhash64("doc_id", "start"), F.lit(groups)))
    before = items.groupBy("class", "part").agg(F.count(F.lit(1)).alias("n"))
    before = before.select("class", "part", (F.sum("n").over(Window.partitionBy("class").orderBy("part")) - F.col("n")).alias("before"))
    within = F.row_number().over(Window.partitionBy("class", "part").orderBy("doc_id", "start", "ids_crc32"))
    return items.withColumn("within", within).join(before, ["class", "part"]).withColumn("rank", F.col("before") + F.col("within") - 1)


def _power_parts(n: int) -> list[int]:
    """n as falling powers of two."""
    return [1 << b for b in range(n.bit_length() - 1, -1, -1) if n >> b & 1]


def _filler(sequence: int, first: int, shards: int):
    """Fill the gaps of a shard's sequences with its fillers' tokens, in order; the rest makes sequences of its own."""
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]

    def fill(key: tuple, gaps: pa.Table, fillers: pa.Table) -> pa.Table:
        docs = sorted(zip(*(fillers.column(c).to_pylist() for c in ("doc_id", "start", "doc_tokens", "ids")), strict=True), key=lambda r: (r[0] is None, r[0] or 0, r[1], r[3]))
        total = sum(len(r[3]) // 4 for r in docs)
        places = sorted(zip(gaps.column("sequence_id").to_pylist(), gaps.column("used").to_pylist(), strict=True)) if gaps.num_rows else []
        rooms, held, extra = [], 0, 0
        for sequence_id, used in places:
            if held < total:
                rooms.append((sequence_id, used, min(sequence - used, total - held)))
                held += rooms[-1][2]
        while held < total:
            for part in [sequence] if total - held >= sequence else _power_parts(total - held):
                rooms.append((first + extra * shards + key[0].as_py(), 0, part))
                extra, held = extra + 1, held + part
        out, at = [], 0
        rooms = iter(rooms)
        sequence_id, offset, room = next(rooms, (0, 0, 0))
        for doc_id, start, n, ids in docs:
            at = 0
            while at < len(ids):
                if not room:
                    sequence_id, offset, room = next(rooms)
                own = ids[at : at + 4 * room]
                k = len(own) // 4
                out.append((doc_id, start + at // 4, k, zlib.crc32(own), n, sequence_id, offset))
                at, offset, room = at + len(own), offset + k, room - k
        return pa.table([pa.array(c, pa.int64()) for c in zip(*out, strict=True)] if out else [pa.array([], pa.int64())] * 7, names=names)

    return fill


def pack(docs: DataFrame, path: str, sequence: int = 4096, end_id: int = 2) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens, sequence_id and offset of each piece."""
    width = sequence // CLASSES
    pieces = materialize(tokenize(docs, path, end_id, sequence), "packing-pieces")
    items = pieces.filter("ids is null").drop("ids").withColumn("class", F.ceil(F.col("length") / width).cast("int"))
    histogram = {r["class"]: r["n"] for r in items.groupBy("class").agg(F.count(F.lit(1)).alias("n")).collect()}  # CLASSES rows
    found = patterns(histogram)
    sequences, n_items = sum(times for _, times in found), sum(histogram.values())
    spark = docs.sparkSession
    plan = F.broadcast(spark.createDataFrame(_assignment(found), "class int, low long, high long, base long, per long, slot long"))  # by classes, not documents
    at = _ranked(items, n_items).join(plan, "class").filter("rank >= low and rank < high")
    at = at.withColumns({"sequence_id": F.expr("base + (rank - low) div per"), "place": F.expr("slot + (rank - low) % per")})
    before = Window.partitionBy("sequence_id").orderBy("place").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = at.withColumn("offset", F.sum("length").over(before) - F.col("length"))
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    placed = materialize(placed.select(*names), "packing-placed")
    tokens = pieces.filter("ids is not null").agg(F.sum("length")).first()[0] or 0
    shards = max(partitions_for(sequences, FILL_ROWS), partitions_for(tokens, FILL_TOKENS))
    gaps = placed.groupBy("sequence_id").agg(F.sum("length").alias("used")).filter(F.col("used") < sequence).withColumn("shard", F.pmod("sequence_id", F.lit(shards)))
    fillers = pieces.filter("ids is not null").select("doc_id", "start", "doc_tokens", "ids", F.pmod(F.xxhash64("doc_id", "ids"), F.lit(shards)).alias("shard"))
    filled = gaps.groupBy("shard").cogroup(fillers.groupBy("shard")).applyInArrow(_filler(sequence, sequences, shards), ", ".join(f"{c} long" for c in names))
    return placed.unionByName(filled)
