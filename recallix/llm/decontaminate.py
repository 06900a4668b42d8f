"""Benchmark decontamination by SimHash over item-sized windows (operator 1).

Each benchmark item and each window of a document of the item's length has a 64-bit SimHash of its five-word shingles,
every occurrence with weight one. A multi-index of eight 8-bit blocks, probed with each block as it is and with one bit
turned, finds every item whose fingerprint is within 15 bits of a window's (16 differences over 8 blocks would be
needed to leave two in each). Candidates are verified by the exact weighted similarity of the two shingle multisets,
sum of minima over sum of maxima. Windows that hold no shingle of any item have similarity 0 and aren't fingerprinted.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import col, free_name, importable, sole_memory
from .lexicon import Lexicon, Members, runs

SHINGLE, RADIUS, BLOCKS = 5, 15, 8
_ROWS = 2048


def _bits(codes: np.ndarray) -> np.ndarray:
    """One row of +1 and -1 for each code."""
    with np.errstate(over="ignore"):
        h = codes * np.uint64(0xD6E8FEB86659FD93)
        h ^= h >> np.uint64(32)
        h = h * np.uint64(0xD6E8FEB86659FD93)
        h ^= h >> np.uint64(32)
    return np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1).astype(np.int32) * 2 - 1


def _blocks(hits: np.ndarray, m: int, last: int) -> Iterator[np.ndarray]:
    """The starts of all windows of m shingles that hold one of the hits (ascending), once each and in order, in blocks
    that stretch over _ROWS shingles at most, so that memory doesn't grow with the text."""
    done, step = -1, max(1, _ROWS // m)
    for i in range(0, len(hits), step):
        starts = np.unique(np.clip((hits[i : i + step, None] - np.arange(m)[None, :]).ravel(), 0, last))
        starts = starts[starts > done]
        at = 0
        while at < len(starts):
            end = int(np.searchsorted(starts, starts[at] + _ROWS))
            yield starts[at:end]
            at = end
        done = max(done, int(starts[-1])) if len(starts) else done


class Benchmark:
    """Items by length, with fingerprints, the multi-index, and the shingles that occur in any item."""

    def __init__(self, items: list[tuple[int | None, str]]):
        self.lexicon = Lexicon(t for _, t in items)
        self.items = [(i, n) for i, n in ((i, self.lexicon.read(t)[0]) for i, t in items) if len(n)]
        self.by_shingle: dict[int, list[int]] = {}
        self.shingles: list[Counter] = []
        self.prints = np.zeros((len(self.items), BLOCKS), np.uint8)
        self.tables: dict[int, list[list[list[int]]]] = {}
        for at, (_, words) in enumerate(self.items):
            codes = runs(words, min(SHINGLE, len(words)))
            self.shingles.append(Counter(codes.tolist()))
            for c in set(codes.tolist()):
                self.by_shingle.setdefault(c, []).append(at)
            self.prints[at] = np.packbits(_bits(codes).sum(axis=0) > 0)
            table = self.tables.setdefault(len(words), [[[] for _ in range(256)] for _ in range(BLOCKS)])
            for b in range(BLOCKS):
                for near in (0, *(1 << i for i in range(8))):
                    table[b][self.prints[at, b] ^ near].append(at)
        self.known = {k: Members({c for s, (_, w) in zip(self.shingles, self.items, strict=True) if min(SHINGLE, len(w)) == k for c in s}) for k in {min(SHINGLE, len(w)) for _, w in self.items}}

    def candidates(self, length: int, prints: np.ndarray) -> list[tuple[int, int]]:
        """(window, item) pairs within the radius, by the blocks that agree but for a bit."""
        out: set[tuple[int, int]] = set()
        table = self.tables[length]
        values, inverse = np.unique(prints, axis=0, return_inverse=True)
        for v, value in enumerate(values):
            met = {at for b in range(BLOCKS) for at in table[b][value[b]]}
            near = [at for at in met if int(np.bitwise_count(self.prints[at] ^ value).sum()) <= RADIUS]
            if near:
                out.update((int(w), at) for w in np.flatnonzero(inverse.ravel() == v) for at in near)
        return sorted(out)

    def find(self, text: str, threshold: float) -> list[tuple[int | None, float, int, int]]:
        """(item id, similarity, first word, word after the last) of the best window of each item found in a text."""
        numbers, places = self.lexicon.read(text)
        best: dict[int, tuple[float, int, int]] = {}
        for k, known in self.known.items():
            codes = runs(numbers, k, unknown=True)
            hits = known.where(codes)
            if not len(hits):
                continue
            near: dict[int, list[int]] = {}  # length of the items met: where
            for h in hits.tolist():
                for length in {len(self.items[at][1]) for at in self.by_shingle[int(codes[h])]}:
                    near.setdefault(length, []).append(h)
            for length, where in near.items():
                self._windows(codes, k, length, np.array(where), threshold, best)
        return [(self.items[at][0], round(s, 6), int(places[a]), int(places[b - 1]) + 1) for at, (s, a, b) in sorted(best.items())]

    def _windows(self, codes: np.ndarray, k: int, length: int, hits: np.ndarray, threshold: float, best: dict) -> None:
        """All windows of one length that hold one of the hits; the only window is the text if that is shorter."""
        m = min(length - k + 1, len(codes))  # shingles in a window
        last = len(codes) - m
        for part in _blocks(hits, m, last):
            lo = int(part[0])
            sums = np.zeros((int(part[-1]) + m - lo + 1, 64), np.int32)
            np.cumsum(_bits(codes[lo : int(part[-1]) + m]), axis=0, out=sums[1:])
            prints = np.packbits(sums[part - lo + m] - sums[part - lo] > 0, axis=1)
            for w, at in self.candidates(length, prints):
                a = int(part[w])
                mine, item = Counter(codes[a : a + m].tolist()), self.shingles[at]
                low = sum((mine & item).values())
                s = low / (m + item.total() - low)
                if s >= threshold and (at not in best or s > best[at][0]):
                    best[at] = (s, a, a + m + k - 1)


def find_leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id_col: str = "item_id", item_text_col: str = "text", threshold: float = 0.8, slice_bytes: int = 16 << 20) -> DataFrame:
    """(id, item_id, similarity, word_start, word_end): each item with a window of a document at least so similar.

    Words are compared in lower case without marks at their ends. One row for each pair, of the first best window.
    Texts shorter than an item are one window. Items with fewer than five words are one shingle. Null and empty texts
    and items match nothing; repeated rows of documents repeat; equal items all match; an empty table on either side
    gives no rows; other columns play no part. The benchmark is sent to the executors in slices of ``slice_bytes``,
    with a pass over the documents for each, so its size is bounded whatever the benchmark's.
    """
    spark = docs.sparkSession
    importable(spark)
    items = benchmark.select(col(item_id_col).cast("long").alias("item_id"), col(item_text_col).cast("string").alias("text")).where("text is not null")
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    slices = max(1, -(-total // slice_bytes))
    out = None
    for i in range(slices):
        own = items.where(F.pmod(F.xxhash64("text"), F.lit(slices)) == i) if slices > 1 else items
        found = _find(docs, [(r["item_id"], r["text"]) for r in own.collect()], id_col, text_col, threshold)
        out = found if out is None else out.unionByName(found)
    return out


def _find(docs: DataFrame, items: list[tuple[int | None, str]], id_col: str, text_col: str, threshold: float) -> DataFrame:
    sent = docs.sparkSession.sparkContext.broadcast(Benchmark(items))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bench = sent.value
        sole_memory("decontaminate", bench.lexicon.clear)
        for b in batches:
            rows = [(i, *hit) for i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True) if t for hit in bench.find(t, threshold)]
            kinds = (pa.int64(), pa.int64(), pa.float64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array([r[j] for r in rows], k) for j, k in enumerate(kinds)], ["id", "item_id", "similarity", "word_start", "word_end"])

    source = docs.select(col(id_col).cast("long").alias("id"), col(text_col).cast("string").alias("text"))
    return source.mapInArrow(run, "id long, item_id long, similarity double, word_start long, word_end long")


def decontaminate(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.8) -> DataFrame:
    """The documents in which no item is found, with all columns. Rows without an id are judged by their own text."""
    keyed = find_leaks(docs, benchmark, id_col, text_col, threshold=threshold).where("id is not null").select(F.col("id").alias("_rx_id")).distinct()
    named = docs.where(col(id_col).isNotNull()).join(keyed, col(id_col).cast("long") == F.col("_rx_id"), "left_anti").select(*(col(c) for c in docs.columns))
    nameless = docs.where(col(id_col).isNull())
    if nameless.isEmpty():
        return named
    mark = free_name(docs.columns, "_rx_row")
    marked = nameless.withColumn(mark, F.monotonically_increasing_id())
    hit = find_leaks(marked, benchmark, mark, text_col, threshold=threshold).select(F.col("id").alias("_rx_id")).distinct()
    return named.unionByName(marked.join(hit, F.col(mark) == F.col("_rx_id"), "left_anti").select(*(col(c) for c in docs.columns)))
