"""Benchmark decontamination: which documents contain test items.

Items are dealt into partitions by size. For each partition documents are read through windows twice as long as its
largest item, each beginning half a window after the last, so that an item's passage lies in one window whole. Windows
and items have MinHash signatures; a window whose signature shares a component with an item's is a candidate (one-row
bands: with containment at the limit, the Jaccard similarity of item and window is about 0.2 or more, and 64
components all differ with a chance of under one in a million). The signature of an item of up to TINY shingles is
the shingles themselves. Candidates are verified by exact shingle containment of the item in the document.

Words are runs of letters and digits, lower-cased, so that case, punctuation and white space don't hide a passage;
shingles have five words. An item of fewer words is looked for as the run of its words. The items' index is sent to
all tasks in blocks of at most BLOCK_ITEMS, each block a pass over the documents, which are not shuffled.

Defined cases: null and empty texts contain nothing, items without words are contained in nothing. Rows of equal
items or equal documents give a row each. Empty tables give an empty result. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import ngrams
from .runtime import null_safe, partitions_for, slices, small_batches, text_or_empty, without

#: Share of an item's shingles that a document must hold, and words of a shingle.
CONTAINMENT, WORDS = 0.8, 5
#: Components of a signature.
COMPONENTS = 64
#: Items of a block: with some 100 words each, under 100 MB of index.
BLOCK_ITEMS = 50_000
#: Items of up to so many shingles are too small for minima.
TINY = 4
#: The smallest block of shingles over which minima are taken.
LEAST = 8

_random = np.random.Generator(np.random.PCG64(9))
_FACTOR = _random.integers(0, 2**32, COMPONENTS, np.uint32) | np.uint32(1)
_ADD = _random.integers(0, 2**32, COMPONENTS, np.uint32)

PAIR = "doc_id long, item_id long, item_shingles long, shared long, containment double"


def _narrow(shingles: np.ndarray) -> np.ndarray:
    return (shingles >> np.uint64(32)).astype(np.uint32) ^ shingles.astype(np.uint32)


def _permuted(narrow: np.ndarray, k: int) -> np.ndarray:
    x = narrow * _FACTOR[k] + _ADD[k]
    return (x ^ (x >> np.uint32(15))) * np.uint32(0x2C1B3C6D)


@dataclass
class ItemIndex:
    """Shingle sets of a block of items, and for each size partition the items by signature component."""

    ids: list[int]
    sets: list[np.ndarray]
    spans: list[int]  # largest number of shingles of each partition, a power of two
    tables: list[list[tuple[np.ndarray, np.ndarray, np.ndarray]]]  # partition, component: filter bits, sorted values, items
    tiny: dict[int, list[int]]  # shingle of a tiny item, items
    short: dict[int, dict[int, list[int]]]  # words of a short item, hash of the run, items

    @classmethod
    def build(cls, ids: list[int], texts: list[str]) -> ItemIndex:
        sets, short, sized, tiny = [], {}, {}, {}
        body, offsets = ngrams.buffers(pa.array([t.lower() for t in texts], pa.large_string()))
        hashes, _, of = ngrams.words(body, offsets, ngrams.NOT_WORD)
        ends = np.concatenate([[0], np.cumsum(np.bincount(of, minlength=len(ids)))])
        for i in range(len(ids)):
            own = hashes[ends[i] : ends[i + 1]]
            size = min(WORDS, len(own))
            found = np.unique(ngrams.windows(own, np.zeros(len(own), int), size)[0]) if size else np.zeros(0, np.uint64)
            sets.append(found)
            if size == WORDS and len(found) <= TINY:
                for x in found.tolist():
                    tiny.setdefault(x, []).append(i)
            elif size == WORDS:
                sized.setdefault(max(LEAST, 1 << (len(found) - 1).bit_length()), []).append(i)
            elif size:
                short.setdefault(size, {}).setdefault(int(found[0]), []).append(i)
        spans = sorted(sized)
        tables = []
        for span in spans:
            rows = []
            for k in range(COMPONENTS):
                values = np.array([_permuted(_narrow(sets[i]), k).min() for i in sized[span]], np.uint32)
                order = np.argsort(values, kind="stable")
                bits = np.zeros(1 << 16, bool)
                bits[values >> np.uint32(16)] = True
                rows.append((bits, values[order], np.array(sized[span])[order]))
            tables.append(rows)
        return cls(ids, sets, spans, tables, tiny, short)

    def candidates(self, shingles: np.ndarray, offsets: np.ndarray) -> set[tuple[int, int]]:
        """(text, item) of windows and items that share a signature component."""
        # Texts begin at a multiple of LEAST, so that no block of shingles has those of two; the gaps count as none.
        counts = np.diff(offsets)
        room = -(-counts // LEAST) * LEAST
        begins = np.concatenate([[0], np.cumsum(room)])
        total = int(begins[-1])
        if not total or not self.spans:
            return set()
        at = np.arange(len(shingles)) + np.repeat(begins[:-1] - offsets[:-1], counts)
        text = np.repeat(np.arange(len(counts)), room // LEAST)
        narrow, out = _narrow(shingles), []
        padded = np.full(total, 2**32 - 1, np.uint32)
        for k in range(COMPONENTS):
            padded[at] = _permuted(narrow, k)
            blocks = padded.reshape(-1, LEAST).min(axis=1)
            size = LEAST
            for span, rows in zip(self.spans, self.tables, strict=True):
                while size < span:  # a block of twice the size, over neighbours of one text; others keep to themselves
                    step = size // LEAST
                    doubled = blocks.copy()
                    if len(blocks) > step:
                        same = text[step:] == text[:-step]
                        doubled[:-step] = np.where(same, np.minimum(blocks[:-step], blocks[step:]), blocks[:-step])
                    # beyond a text's end its last blocks stand for themselves
                    blocks, size = doubled, size * 2
                step = span // LEAST
                # Windows begin at every block: a window of twice the span is the block and the next of that size.
                window = blocks.copy()
                if len(blocks) > step:
                    same = text[step:] == text[:-step]
                    window[:-step] = np.where(same, np.minimum(blocks[:-step], blocks[step:]), blocks[:-step])
                bits, values, items = rows[k]
                some = np.flatnonzero(bits[window >> np.uint32(16)])
                if len(some):
                    low, high = np.searchsorted(values, window[some], "left"), np.searchsorted(values, window[some], "right")
                    for n in range(int((high - low).max(initial=0))):
                        hit = low + n < high
                        out.append(np.stack([text[some[hit]], items[low[hit] + n]]))
        if not out:
            return set()
        pairs = np.unique(np.concatenate(out, axis=1), axis=1)
        return set(zip(pairs[0].tolist(), pairs[1].tolist(), strict=True))

    def search(self, texts: pa.Array) -> list[tuple[int, int, int]]:
        """(text, item, shared shingles) of the items that texts contain."""
        body, offsets = ngrams.buffers(texts)
        hashes, _, of = ngrams.words(body, offsets, ngrams.NOT_WORD)
        found, own = ngrams.windows(hashes, of, WORDS)
        at = np.concatenate([[0], np.cumsum(np.bincount(own, minlength=len(texts)))]).astype(np.int64)
        out, sets = [], {}
        near = self.candidates(found, at)
        if self.tiny:
            for i in np.flatnonzero(np.isin(found, np.array(list(self.tiny), np.uint64))):
                near.update((int(own[i]), item) for item in self.tiny[int(found[i])])
        for text, item in sorted(near):
            if text not in sets:
                sets[text] = np.unique(found[at[text] : at[text + 1]])
            shared = len(np.intersect1d(self.sets[item], sets[text], assume_unique=True))
            if shared >= CONTAINMENT * len(self.sets[item]) - 1e-9:
                out.append((text, item, shared))
        for size, runs in self.short.items():
            found, own = ngrams.windows(hashes, of, size)
            for i in np.flatnonzero(np.isin(found, np.array(list(runs), np.uint64))):
                out += [(int(own[i]), item, 1) for item in runs[int(found[i])]]
        return sorted(set(out))


def _search(docs: DataFrame, items: DataFrame, id_col: str, text_col: str, item_col: str, item_text: str, block_items: int) -> DataFrame:
    """PAIR for each document and item that it contains, and h, a hash of the document's text."""
    spark = docs.sparkSession
    small_batches(spark, 1000)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_or_empty(text_col).alias("text"))
    rows = rows.select("doc_id", F.xxhash64("text").alias("h"), F.lower("text").alias("text"))
    items = items.select(F.col(item_col).cast("long").alias("item_id"), text_or_empty(item_text).alias("text"))
    n_items = items.count()
    blocks = partitions_for(n_items, block_items // 2)
    schema = f"{PAIR}, h long"
    names = [x.split()[0] for x in schema.split(", ")]
    out = None
    for block in range(blocks):  # a hash deals half of block_items to each on average
        own = items.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == block) if blocks > 1 else items
        own = own.orderBy("item_id", "text").toPandas()  # at most about block_items rows
        sent = spark.sparkContext.broadcast(ItemIndex.build(own["item_id"].tolist(), own["text"].tolist()))  # the driver keeps a file of it

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            index = sent.value
            for batch in batches:
                for part in slices(batch, 2, 2 << 20):
                    ids, hashes = part.column(0).to_pylist(), part.column(1).to_pylist()
                    found = [(ids[t], index.ids[i], len(index.sets[i]), n, n / len(index.sets[i]), hashes[t]) for t, i, n in index.search(part.column(2))]
                    if found:
                        yield pa.record_batch([pa.array(c, pa.float64() if k == 4 else pa.int64()) for k, c in enumerate(zip(*found, strict=True))], names=names)

        part = rows.mapInArrow(run, schema)
        out = part if out is None else out.unionByName(part)
    return out


def contaminated(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", block_items: int = BLOCK_ITEMS) -> DataFrame:
    """PAIR for each document and item that it contains."""
    return _search(docs, items, id_col, text_col, item_col, item_text, block_items).drop("h")


def drop_contaminated(docs: DataFrame, items: DataFrame) -> DataFrame:
    """Rows whose text contains no item, whatever their doc_id; all columns are kept."""
    found = _search(docs, items, "doc_id", "text", "item_id", "text", BLOCK_ITEMS).select(null_safe(F.col("doc_id")).alias("_did"), F.col("h").alias("_h"))
    return without(docs, {"_did": null_safe(F.col("doc_id")), "_h": F.xxhash64(text_or_empty("text"))}, found)
