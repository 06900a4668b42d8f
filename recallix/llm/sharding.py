"""Sharding by histogram sort (operator 4): exact counts below probed key boundaries, then one exchange.

Documents are ordered by (hash of the text, id): a shuffle in which equal texts stay side by side. The driver keeps
for each wanted boundary an interval of keys; every round the executors count the exact bytes and rows below a bounded
number of probes inside the intervals, until each boundary is within tolerance or between two neighbouring rows. Only
then are the rows exchanged, once, to the partition that their key falls in. A hot text is no obstacle, as the id
splits its rows.
"""

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Table, col, free_name, importable

_HALF = 1 << 63
_TOP = (1 << 128) - 1

#: Bytes a document counts besides its text.
OVERHEAD = 16


@dataclass(frozen=True)
class Splitters:
    """Key boundaries, with the exact bytes and rows below each; the last entries are the totals."""

    keys: list[int]
    bytes_below: list[int]
    rows_below: list[int]
    rounds: int


def _halves(key: int) -> tuple[int, int]:
    return (key >> 64) - _HALF, (key & ((1 << 64) - 1)) - _HALF


def _count_below(table: DataFrame, probes: list[int]) -> dict[int, tuple[int, int]]:
    """Exact (bytes, rows) of the rows whose key is below each probe. Each partition sends one row for each probe
    interval that it has rows in; there are as many intervals as probes, whatever the number of rows."""
    high = np.array([_halves(k)[0] for k in probes], np.int64)
    low = np.array([_halves(k)[1] for k in probes], np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        size, rows = np.zeros(len(high) + 1, np.int64), np.zeros(len(high) + 1, np.int64)
        for b in batches:
            h, d, n = (b.column(i).to_numpy(zero_copy_only=False) for i in range(3))
            tag = np.concatenate([np.zeros(len(high), np.int8), np.ones(len(h), np.int8)])
            order = np.lexsort((tag, np.concatenate([low, d]), np.concatenate([high, h])))
            is_row = tag[order] == 1
            slot = np.cumsum(~is_row)[is_row]
            np.add.at(size, slot, n[order[is_row] - len(high)])
            rows += np.bincount(slot, minlength=len(high) + 1)
        used = np.flatnonzero(rows)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(size[used]), pa.array(rows[used])], ["slot", "size", "n"])

    counted = table.select("h", "d", "size").mapInArrow(run, "slot long, size long, n long")
    sums = counted.groupBy("slot").agg(F.sum("size").alias("size"), F.sum("n").alias("n")).toArrow()
    got = dict(zip(sums["slot"].to_pylist(), zip(sums["size"].to_pylist(), sums["n"].to_pylist(), strict=True), strict=True))
    out, size, n = {}, 0, 0
    for i, k in enumerate(probes):
        s, m = got.get(i, (0, 0))
        size, n = size + s, n + m
        out[k] = (size, n)
    s, m = got.get(len(probes), (0, 0))
    out[_TOP] = (size + s, n + m)
    return out


def find_splitters(table: DataFrame, parts: int, tolerance: float = 0.001, probes: int = 4096, max_rounds: int = 140) -> Splitters:
    """Boundaries that cut the table (h long, d long, size long) into ``parts`` ranges of nearly equal bytes.

    A boundary is settled once the bytes below it are within ``tolerance`` parts of a range of the wanted number, or
    no key is left between its two sides; then the nearer side is taken. Keys have 128 bits, so bisection ends."""
    ends = table.agg(F.min("h"), F.max("h"), F.min("d"), F.max("d")).first()
    if ends[0] is None:
        return Splitters([0] * (parts - 1), [0] * parts, [0] * parts, 0)
    first = (ends[0] + _HALF << 64) + ends[2] + _HALF
    last = (ends[1] + _HALF << 64) + ends[3] + _HALF + 1
    known = {first: (0, 0)}
    step = max(1, (last - first) // probes)
    known |= _count_below(table, sorted({first + step * i for i in range(1, probes) if first + step * i < last} | {last}))
    total = known[_TOP][0]
    wanted = [total * j / parts for j in range(1, parts)]
    slack = tolerance * total / parts
    rounds, chosen = 1, {}
    while True:
        keys = sorted(k for k in known if k != _TOP)
        below = np.array([known[k][0] for k in keys])
        ask: set[int] = set()
        open_ends = []
        for j, t in enumerate(wanted):
            i = int(np.searchsorted(below, t, side="right")) - 1
            lo, hi = keys[i], keys[min(i + 1, len(keys) - 1)]
            best = min((lo, hi), key=lambda k: (abs(known[k][0] - t), k))
            chosen[j] = best
            if abs(known[best][0] - t) > slack and hi - lo > 1 and known[hi][1] - known[lo][1] > 1:
                open_ends.append((lo, hi))
        if not open_ends or rounds >= max_rounds:
            break
        for lo, hi in set(open_ends):
            each = max(2, probes // len(set(open_ends)))
            # Many rows under one hash differ in the id only: probe the ids that occur, not the whole second half.
            a, b = lo, hi
            if lo >> 64 == hi - 1 >> 64:
                base = lo >> 64 << 64
                a, b = max(lo, base + ends[2] + _HALF), min(hi, base + ends[3] + _HALF + 1)
            elif hi - lo < 2 << 64:
                ask.add((hi >> 64) << 64)
            width = max(1, (b - a) // each)
            ask.update(k for k in (a + width * i for i in range(0, each + 1)) if lo < k < hi)
        ask -= known.keys()
        if not ask:
            break
        known |= {k: v for k, v in _count_below(table, sorted(ask)).items() if k != _TOP}
        rounds += 1
    cuts = sorted(chosen[j] for j in range(parts - 1))
    return Splitters(cuts, [*(known[k][0] for k in cuts), total], [*(known[k][1] for k in cuts), known[_TOP][1]], rounds)


def shard(docs: DataFrame, shards: int = 40, id_col: str = "doc_id", text_col: str = "text", tolerance: float = 0.001, part_bytes: int = 256 << 20) -> DataFrame:
    """All rows with size, shard and slot: sizes near equal over shards, slots gapless from 0 in each.

    Rows keep their columns; ``_size``, ``_shard``, ``_slot`` and ``_part`` are added (with an underscore appended where
    such a name exists). Each partition of the result is one range of keys, in order, of about ``part_bytes`` at most,
    so a shard may be several partitions. Null and empty texts weigh only the overhead; rows without an id sort as id
    0; rows that repeat an id and a text stay together. A single row is never split, so one larger than a shard makes
    that shard larger. An empty table gives no rows.
    """
    importable(docs.sparkSession)
    text = col(text_col).cast("string")
    key = docs.select(F.coalesce(F.xxhash64(text), F.lit(0)).alias("h"), F.coalesce(col(id_col).cast("long"), F.lit(0)).alias("d"), (F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + OVERHEAD).alias("size"))
    table = Table(key, "keys").df
    total = table.agg(F.sum("size")).first()[0] or 0
    per_shard = max(1, -(-total // (shards * part_bytes)))
    cut = find_splitters(table, shards * per_shard, tolerance, probes=max(4096, 8 * shards * per_shard))
    return exchange(docs, cut, shards, per_shard, id_col, text_col)


def exchange(docs: DataFrame, cut: Splitters, shards: int, per_shard: int, id_col: str, text_col: str) -> DataFrame:
    """Send each row to the range of its key, sort there, and number the rows on from the exact counts."""
    text = col(text_col).cast("string")
    names = list(docs.columns)
    made = {}
    for stem in ("_h", "_d", "_size", "_part", "_shard", "_slot", "_base"):
        made[stem] = free_name((*names, *made.values()), stem)
    h, d, size, part, shard_col, slot, base = made.values()
    keyed = docs.withColumns({h: F.coalesce(F.xxhash64(text), F.lit(0)), d: F.coalesce(col(id_col).cast("long"), F.lit(0)), size: F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + OVERHEAD})
    parts, rows = shards * per_shard, [0, *cut.rows_below]
    where = range_of(docs.sparkSession, cut.keys, [rows[p] - rows[p - p % per_shard] for p in range(parts)])
    keyed = keyed.withColumn(base, where(F.col(h), F.col(d))).withColumns({part: F.col(f"`{base}`.part"), base: F.col(f"`{base}`.base")})
    sorted_rows = keyed.repartitionById(parts, F.col(part)).sortWithinPartitions(h, d)
    row = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    out = sorted_rows.withColumn(shard_col, (F.col(part) / per_shard).cast("int") if per_shard > 1 else F.col(part))
    return out.withColumn(slot, row + F.col(base)).drop(h, d, base)


def number_of_range(high: np.ndarray, low: np.ndarray, h: np.ndarray, d: np.ndarray) -> np.ndarray:
    """How many of the sorted boundaries (high, low) are at or below each key (h, d)."""
    out, ends = np.searchsorted(high, h, "left"), np.searchsorted(high, h, "right")
    tied = np.flatnonzero(ends > out)  # boundaries with the key's first half: the second half decides
    if len(tied):
        groups = np.split(tied[np.argsort(out[tied], kind="stable")], np.flatnonzero(np.diff(np.sort(out[tied]))) + 1)
        for rows in groups:
            a, b = int(out[rows[0]]), int(ends[rows[0]])
            out[rows] = a + np.searchsorted(low[a:b], d[rows], "right")
    return out


def halves(keys: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """The first and second halves of boundaries."""
    both = np.array([_halves(k) for k in keys], np.int64).reshape(-1, 2)
    return both[:, 0].copy(), both[:, 1].copy()


def range_of(spark: SparkSession, keys: list[int], bases: list[int] | None = None):
    """A column function of (h, d): the number of boundaries at or below the key, as ``part``, and that range's entry of
    ``bases`` as ``base``. The boundaries go to the executors as one sorted array, 16 bytes each, and are bisected."""
    sent = spark.sparkContext.broadcast((*halves(keys), np.array(bases or [0] * (len(keys) + 1), np.int64)))

    import pandas as pd  # only where it is used: workers that have no need of it stay smaller

    @F.pandas_udf("part int, base long")
    def locate(h: pd.Series, d: pd.Series) -> pd.DataFrame:
        high, low, base = sent.value
        part = number_of_range(high, low, h.to_numpy(), d.to_numpy())
        return pd.DataFrame({"part": part.astype(np.int32), "base": base[part]})

    return locate
