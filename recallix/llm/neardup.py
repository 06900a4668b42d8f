"""SimHash near-duplicates through a segment-popcount embedding (operator 6).

A fingerprint's 64 bits fall into 32 segments of two bits; its embedding is the number of set bits of each segment.
The Manhattan distance of two embeddings never exceeds the Hamming distance of their fingerprints, so a range join on
the embeddings loses no link. The join runs on a grid: the segments are dealt into groups so that at least one group of
any linked pair is at most one apart, and each group's counts, as they are and with one count raised by one, are the
cells in which pairs meet. Pairs that meet pass the Manhattan bound first and the exact Hamming distance last.

The pipeline's stage (``near_dedup``) is defined by similarity: it links by this method first, each link checked on the
whole texts. No radius that such a grid can carry finds nearly all texts that are similar enough, so candidates of bands
of min-hashes, of the shingles that the similarity is defined on, follow and add the links beyond the radius.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Table, col, components, free_name, importable, one_of_equal

SEGMENTS = 32
SEED = 42
_SLICE = 1 << 15
_BROADCAST_IDS = 1_000_000
#: Near copies by similarity: bands of minima, minima in a band, and the orders the minima are taken in.
BANDS, ROWS = 24, 6
_LONGS = -(-BANDS * ROWS // 64)
_BITS = [f"b{i}" for i in range(_LONGS)]
_OTHERS = [f"o{i}" for i in range(6)]
_FACTS = ["shared", "extra", *_OTHERS]
RADIUS = 3  # bits; the grid carries 3 with the cells of 2
_DEVIATIONS = 4.0  # of an estimate by minima, 0.00003 on one side
_BLOCK = 1 << 12
_RANDOM = np.random.default_rng(SEED)
_FLIPS = _RANDOM.integers(0, 1 << 64, BANDS * ROWS, np.uint64)
_FACTORS = _RANDOM.integers(0, 1 << 64, BANDS * ROWS, np.uint64) | np.uint64(1)


def shingle_hashes(text: str | None, words: int) -> np.ndarray:
    """XXH64 of each run of ``words`` words, A-Z lower-cased, repeats included; all words if there are fewer."""
    tokens = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not tokens:
        return np.empty(0, np.uint64)
    digest = xxhash.xxh64_intdigest
    if len(tokens) <= words:
        return np.array([digest(b" ".join(tokens), SEED)], np.uint64)
    runs = zip(*(tokens[i:] for i in range(words)), strict=False)
    return np.fromiter((digest(b" ".join(r), SEED) for r in runs), np.uint64, len(tokens) - words + 1)


def majority(hashes: np.ndarray) -> int:
    """The bits set in over half of the hashes, as a signed 64-bit number; zero for none."""
    if not len(hashes):
        return 0
    counts = np.zeros(64, np.int64)
    for i in range(0, len(hashes), _SLICE):
        part = np.ascontiguousarray(hashes[i : i + _SLICE]).view(np.uint8).reshape(-1, 8)
        counts += np.unpackbits(part, axis=1).sum(axis=0, dtype=np.int64)
    return int(np.packbits(counts * 2 > len(hashes)).view(np.int64)[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3) -> DataFrame:
    """(id, fp, n_shingles) of every row. Null and empty texts have fingerprint zero and no shingles."""
    importable(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            hashes = [shingle_hashes(t, words) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([majority(h) for h in hashes], pa.int64()), pa.array([len(h) for h in hashes], pa.int64())], ["id", "fp", "n_shingles"])

    source = docs.select(col(id_col).cast("long").alias("id"), col(text_col).cast("string").alias("text"))
    return source.mapInArrow(run, "id long, fp long, n_shingles long")


def embed(fp: Column) -> Column:
    """The embedding in thermometer code: each segment's set bits pushed to its low end.

    Two codes differ in as many bits as the Manhattan distance of the two embeddings."""
    low, high = F.lit(0x5555555555555555), F.lit(-0x5555555555555556)
    any_set = fp.bitwiseOR(F.shiftrightunsigned(fp, 1)).bitwiseAND(low)
    both_set = fp.bitwiseAND(F.shiftleft(fp, 1)).bitwiseAND(high)
    return any_set.bitwiseOR(both_set)


def hamming(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def cell_groups(radius: int) -> list[list[int]]:
    """Segments dealt into so many groups that one group of any pair within the radius is at most one apart."""
    groups = radius // 2 + 1
    return [[int(s) for s in part] for part in np.array_split(np.arange(SEGMENTS), groups)]


def _mask(segments: list[int]) -> int:
    bits = sum(3 << (2 * s) for s in segments)
    return bits - (1 << 64) if bits >= 1 << 63 else bits


def _signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def own_cells(code: Column, radius: int) -> Column:
    """One (group, cell) for each group: the group's counts as they are."""
    return F.array(*(F.struct(F.lit(g).alias("g"), code.bitwiseAND(F.lit(_mask(s))).alias("cell")) for g, s in enumerate(cell_groups(radius))))


def probe_cells(code: Column, radius: int) -> Column:
    """The own cells, and those with one segment's count raised by one. For any two codes one apart, one's raised
    cell is the other's own cell, so probing upwards finds each such pair once from one side."""
    out = []
    for g, segments in enumerate(cell_groups(radius)):
        own = code.bitwiseAND(F.lit(_mask(segments)))
        out.append(F.struct(F.lit(g).alias("g"), own.alias("cell")))
        for s in segments:
            lo, hi = F.lit(_signed(1 << (2 * s))), F.lit(_signed(2 << (2 * s)))
            raised = F.when(own.bitwiseAND(hi) != 0, F.lit(None)).when(own.bitwiseAND(lo) != 0, own.bitwiseOR(hi)).otherwise(own.bitwiseOR(lo))
            out.append(F.struct(F.lit(g).alias("g"), raised.alias("cell")))
    return F.filter(F.array(*out), lambda x: x["cell"].isNotNull())


def similarity(a: str | None, b: str | None, words: int = 5) -> float:
    """Weighted similarity of the multisets of shingles: sum of minima over sum of maxima; 1 for two empty texts."""
    x, y = Counter(shingle_hashes(a, words).tolist()), Counter(shingle_hashes(b, words).tolist())
    most = sum((x | y).values())
    return sum((x & y).values()) / most if most else 1.0


def link_groups(nodes: DataFrame, radius: int) -> DataFrame:
    """(node, component) of the rows (node, fp, distinct nodes and fingerprints), by links of exact Hamming distance.

    A first pass links each fingerprint to the smallest node of each of its cells where the distance allows it:
    linear work that closes large groups of near copies. A second pass joins probes with cells and emits only links
    between different groups so far, so a group of n near copies doesn't emit its n*n pairs; every link not emitted
    joins two nodes of one group already.
    """
    coded = nodes.select("node", "fp", embed(F.col("fp")).alias("code"))
    index = coded.select("node", "fp", "code", F.explode(own_cells(F.col("code"), radius)).alias("c")).select("node", "fp", "code", "c.g", "c.cell")
    heads = index.groupBy("g", "cell").agg(F.min(F.struct("node", "fp")).alias("head"))
    stars = index.join(heads, ["g", "cell"]).where((F.col("node") != F.col("head.node")) & (hamming(F.col("fp"), F.col("head.fp")) <= radius))
    first = Table(stars.select(F.col("node").alias("src"), F.col("head.node").alias("dst")).distinct(), "stars")
    grouped = Table(coded.join(components(first.df), "node", "left").select("node", "fp", "code", F.coalesce("component", "node").alias("grp")), "grouped")
    first.drop()
    left = grouped.df.select("node", "fp", "code", "grp", F.explode(probe_cells(F.col("code"), radius)).alias("c")).select("node", "fp", "code", "grp", "c.g", "c.cell")
    right = grouped.df.select(F.col("node").alias("node2"), F.col("fp").alias("fp2"), F.col("code").alias("code2"), F.col("grp").alias("grp2"), F.explode(own_cells(F.col("code"), radius)).alias("c")).select("node2", "fp2", "code2", "grp2", F.col("c.g").alias("g2"), F.col("c.cell").alias("cell2"))
    met = left.join(right, (F.col("g") == F.col("g2")) & (F.col("cell") == F.col("cell2")) & (F.col("grp") != F.col("grp2")) & (hamming(F.col("code"), F.col("code2")) <= radius) & (hamming(F.col("fp"), F.col("fp2")) <= radius))
    merged = components(met.select(F.greatest("grp", "grp2").alias("src"), F.least("grp", "grp2").alias("dst")).distinct()).withColumnRenamed("node", "grp")
    return grouped.df.join(merged, "grp", "left").select("node", F.coalesce("component", "grp").alias("component"))


def classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3, radius: int = 2) -> DataFrame:
    """Near-duplicate class of every row: (id, fp, component).

    component is the smallest id reachable over fingerprints at most ``radius`` bits apart, the row's own included.
    Fingerprints are the nodes, however many rows hold one; ids are only names, so rows that repeat an id with
    different texts are in the classes of their own texts. Null and empty texts share fingerprint zero and link like
    any other. A row without an id gets its class's smallest id, null if no row of the class has one. An empty table
    gives an empty result; repeated rows repeat; other columns play no part.
    """
    marks = Table(fingerprints(docs, id_col, text_col, words).select("id", "fp"), "fingerprints").df
    named = Table(marks.groupBy("fp").agg(F.min("id").alias("least")), "nodes").df
    groups = named.join(link_groups(named.select(F.col("fp").alias("node"), "fp"), radius), F.col("fp") == F.col("node")).select("fp", "least", F.col("component").alias("grp"))
    groups = Table(groups, "classes").df
    names = groups.groupBy("grp").agg(F.min("least").alias("component"))
    return marks.join(groups.join(names, "grp").select("fp", "component"), "fp").select("id", "fp", "component")


def _elements(hashes: np.ndarray) -> np.ndarray:
    """A multiset of shingles as a set: the n-th repeat of a shingle is an element of its own."""
    if not len(hashes):
        return hashes
    own = np.sort(hashes)
    at = np.arange(len(own))
    first = np.maximum.accumulate(np.where(np.r_[True, own[1:] != own[:-1]], at, 0))
    return own + (at - first).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)


def minima(hashes: np.ndarray) -> np.ndarray:
    """The least element under each of BANDS * ROWS orders; two texts agree in one with the chance of their similarity."""
    elements, out = _elements(hashes), np.full(BANDS * ROWS, np.iinfo(np.uint64).max, np.uint64)
    for i in range(0, len(elements), _BLOCK):
        out = np.minimum(out, ((elements[i : i + _BLOCK, None] ^ _FLIPS) * _FACTORS).min(axis=0))
    return out


def signatures(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5) -> DataFrame:
    """(id, h, key, n, fp, bits, cells, sketch) of every row: the text's hash, the hash of its words, its number of
    shingles, their SimHash, a bit of each minimum, one cell for each band of minima, and a byte of each minimum. A text without words has no
    cells."""
    importable(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keys, sizes, prints, bits, cells, sketches = [], [], [], [], [], []
            for t in b.column(2).to_pylist():
                tokens = (t or "").encode("utf-8", "surrogatepass").lower().split()
                hashes = shingle_hashes(t, words)
                least = minima(hashes)
                keys.append(_signed(xxhash.xxh64_intdigest(b" ".join(tokens), SEED)))
                sizes.append(len(hashes))
                prints.append(majority(hashes))
                bits.append(np.packbits((least & np.uint64(1)).astype(bool), bitorder="little").tobytes().ljust(8 * _LONGS, b"\0"))
                cells.append([_signed(xxhash.xxh64_intdigest(row.tobytes(), i)) for i, row in enumerate(least.reshape(BANDS, ROWS))] if len(hashes) else [])
                sketches.append(least.astype(np.uint8).tobytes())
            longs = np.frombuffer(b"".join(bits), np.int64).reshape(-1, _LONGS)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(keys, pa.int64()), pa.array(sizes, pa.int64()), pa.array(prints, pa.int64()), *(pa.array(longs[:, i]) for i in range(_LONGS)), pa.array(cells, pa.list_(pa.int64())), pa.array(sketches, pa.binary())], ["id", "h", "key", "n", "fp", *_BITS, "cells", "sketch"])

    return _texts(docs, id_col, text_col).mapInArrow(run, f"id long, h long, key long, n long, fp long, {', '.join(f'{c} long' for c in _BITS)}, cells array<long>, sketch binary")


def _text_hash(text: Column) -> Column:
    return F.xxhash64(text)


def _texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = col(text_col).cast("string")
    return docs.select(col(id_col).cast("long").alias("id"), _text_hash(text).alias("h"), text.alias("text"))


def _may_be_near(a: str, b: str, least: float) -> Column:
    """Whether two nodes can be similar enough, by their numbers of shingles (exactly) and by the bits of their minima,
    which differ in half of the minima that do; ``_DEVIATIONS`` are allowed for."""
    x, y = (lambda c: F.col(f"{a}{c}")), (lambda c: F.col(f"{b}{c}"))
    odds = (1 - least) / 2
    most = BANDS * ROWS * odds + _DEVIATIONS * (BANDS * ROWS * odds * (1 - odds)) ** 0.5
    unlike = sum((F.bit_count(x(c).bitwiseXOR(y(c))) for c in _BITS), F.lit(0))
    return (F.least(x("n"), y("n")) >= F.lit(least) * F.greatest(x("n"), y("n")) - F.lit(1e-9)) & (unlike <= most)


def _may_share(a: str, b: str, least: float) -> Column:
    """Whether two nodes that were both compared with one head can be similar enough. They share no more shingles than
    the lesser of both shares with the head, and of the others no more than their bitmaps have bits in common and the
    lesser has shingles beyond its bits. Exact: never false for similar texts, true where a comparison is missing."""
    x, y = (lambda c: F.col(f"{a}{c}")), (lambda c: F.col(f"{b}{c}"))
    both = sum((F.bit_count(x(c).bitwiseAND(y(c))) for c in _OTHERS), F.lit(0))
    most = F.least(x("shared"), y("shared")) + both + F.least(x("extra"), y("extra"))
    return F.coalesce(most >= F.lit(least / (1 + least)) * (x("n") + y("n")) - F.lit(1e-6), F.lit(True))


def _measure(text: str | None, head: str | None, words: int) -> tuple[float, list[int]]:
    """Similarity of two texts, and of the first one's shingles how many the second has, a bitmap of the others, and
    how many those are beyond the bitmap's bits."""
    own, its = _elements(shingle_hashes(text, words)), _elements(shingle_hashes(head, words))
    known = np.isin(own, its)
    shared = int(known.sum())
    most = len(own) + len(its) - shared
    at = (own[~known] * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(40)) % np.uint64(64 * len(_OTHERS))
    bits = np.zeros(64 * len(_OTHERS), bool)
    bits[at.astype(np.intp)] = True
    return shared / most if most else 1.0, [shared, len(own) - shared - int(bits.sum()), *np.packbits(bits).view(np.int64).tolist()]


def _compared(pairs: DataFrame, nodes: DataFrame, docs: DataFrame, guess: float, least: float, words: int) -> Table:
    """The pairs (src, dst, and what else they have) with ``alike``, whether the whole texts are similar enough, and what
    ``_measure`` says of them. Pairs whose sketches agree far less than those of texts of similarity ``guess`` do are left
    out; then only texts that occur in a pair are fetched, one for each node."""
    rest = pairs.columns
    enough = BANDS * ROWS * guess - _DEVIATIONS * (BANDS * ROWS * guess * (1 - guess)) ** 0.5
    side = lambda end, name: nodes.select(F.col("node").alias(end), F.col("sketch").alias(name))

    def close(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            t = pa.Table.from_batches([batch])
            a, b = (np.frombuffer(b"".join(t[c].to_pylist()), np.uint8).reshape(-1, BANDS * ROWS) for c in "ab")
            yield from t.select(rest).filter(pa.array((a == b).sum(axis=1) >= enough, pa.bool_())).to_batches()

    table = Table(pairs.join(side("src", "a"), "src").join(side("dst", "b"), "dst").select(*rest, "a", "b").mapInArrow(close, ", ".join(f"{c} long" for c in rest)), "pairs")
    ends = table.df.select(F.col("src").alias("node")).unionByName(table.df.select(F.col("dst").alias("node"))).distinct()
    wanted = Table(nodes.select("node", F.col("id").alias("_id"), F.col("h").alias("_h")).join(ends, "node", "left_semi"), "wanted")
    few = wanted.df.count() <= _BROADCAST_IDS
    same = F.col("id").eqNullSafe(F.col("_id")) & (F.col("h") == F.col("_h"))
    texts = Table(docs.join(F.broadcast(wanted.df) if few else wanted.df, same).groupBy("node").agg(F.min("text").alias("text")), "texts")
    both = table.df.join(texts.df.withColumnsRenamed({"node": "src", "text": "a"}), "src").join(texts.df.withColumnsRenamed({"node": "dst", "text": "b"}), "dst").select(*rest, "a", "b")

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            t = pa.Table.from_batches([batch])
            got = [_measure(a, b, words) for a, b in zip(t["a"].to_pylist(), t["b"].to_pylist(), strict=True)]
            out = t.select(rest).append_column("alike", pa.array([g[0] >= least for g in got], pa.bool_()))
            for i, c in enumerate(_FACTS):
                out = out.append_column(c, pa.array([g[1][i] for g in got], pa.int64()))
            yield from out.to_batches()

    out = Table(both.mapInArrow(check, ", ".join([*(f"{c} long" for c in rest), "alike boolean", *(f"{c} long" for c in _FACTS)])), "compared")
    for x in (table, wanted, texts):
        x.drop()
    return out


def _joined(groups: Table, found: DataFrame) -> Table:
    """The groups with those of the links (g1, g2) made one."""
    merged = components(found.select(F.col("g1").alias("src"), F.col("g2").alias("dst"))).withColumnRenamed("node", "grp")
    out = Table(groups.df.join(merged, "grp", "left").select("node", F.coalesce("component", "grp").alias("grp")), "groups")
    groups.drop()
    return out


def _simhash_groups(nodes: DataFrame, texts: DataFrame, least: float, words: int, radius: int = RADIUS) -> Table:
    """(node, grp) of the nodes by links of similar texts whose fingerprints are within ``radius`` bits, by the grid of
    ``link_groups``: every node meets the smallest one of each of its cells first, then probes meet the cells, and pairs
    of different groups so far pass the Manhattan bound, the exact Hamming distance and the similarity of whole texts."""
    coded = nodes.select("node", "n", "fp", *_BITS, embed(F.col("fp")).alias("code"))
    index = coded.select("node", "fp", F.explode(own_cells(F.col("code"), radius)).alias("c")).select("node", "fp", "c.g", "c.cell")
    heads = index.groupBy("g", "cell").agg(F.min(F.struct("node", "fp")).alias("head"))
    near = (F.col("node") != F.col("head.node")) & (hamming(F.col("fp"), F.col("head.fp")) <= radius)
    stars = _compared(index.join(heads, ["g", "cell"]).where(near).select(F.col("node").alias("src"), F.col("head.node").alias("dst")).distinct(), nodes, texts, least, least, words)
    groups = _joined(Table(nodes.select("node", F.col("node").alias("grp")), "groups"), stars.df.where("alike").select(F.col("src").alias("g1"), F.col("dst").alias("g2")))

    row = F.struct("node", "grp", "n", "fp", "code", *_BITS)
    known = coded.join(groups.df, "node")
    left = known.select(row.alias("x"), F.explode(probe_cells(F.col("code"), radius)).alias("c")).select("x", "c.g", "c.cell")
    right = known.select(row.alias("y"), F.explode(own_cells(F.col("code"), radius)).alias("c")).select("y", "c.g", "c.cell")
    close = (hamming(F.col("x.code"), F.col("y.code")) <= radius) & (hamming(F.col("x.fp"), F.col("y.fp")) <= radius)
    met = left.join(right, ["g", "cell"]).where((F.col("x.grp") != F.col("y.grp")) & close & _may_be_near("x.", "y.", least))
    pairs = met.select(F.greatest("x.node", "y.node").alias("src"), F.least("x.node", "y.node").alias("dst"), F.greatest("x.grp", "y.grp").alias("g1"), F.least("x.grp", "y.grp").alias("g2")).distinct()
    last = _compared(pairs, nodes, texts, least, least, words)
    groups = _joined(groups, last.df.where("alike").select("g1", "g2"))
    for x in (stars, last):
        x.drop()
    return groups


def _node_groups(nodes: DataFrame, texts: DataFrame, least: float, words: int) -> Table:
    """(node, grp) of the nodes by links of similar texts that are within the radius or share a band of minima.

    The links of ``_simhash_groups`` come first. Then every text is compared with one text of each of its cells, the one that shares most places in cells with
    others: an original comes first that way, its copies meet it, and a large group closes with linear work. Then the
    cells that still hold more than one group are joined. Only pairs that sizes, bits and what both texts share with
    the cell's head allow are emitted, so copies of one original that are too far from each other stay apart without
    being compared pair by pair."""
    groups = _simhash_groups(nodes, texts, least, words)
    cells = nodes.select("node", "n", *_BITS, F.explode("cells").alias("cell"))
    shared = Table(cells.join(cells.groupBy("cell").agg(F.count(F.lit(1)).alias("c")).where("c > 1"), "cell"), "cells")
    links = Table(shared.df.select("cell", "node", "n", *_BITS).join(shared.df.groupBy("node").agg(F.sum("c").alias("rank")), "node"), "cell-nodes")
    shared.drop()
    heads = Table(links.df.groupBy("cell").agg(F.max(F.struct("rank", "node")).alias("y")).select("cell", F.col("y.node").alias("head")), "heads")
    stars = _compared(links.df.join(heads.df, "cell").where("node != head").select(F.col("node").alias("src"), F.col("head").alias("dst")).distinct(), nodes, texts, 0.0, least, words)
    named = lambda end, name: groups.df.select(F.col("node").alias(end), F.col("grp").alias(name))
    groups = _joined(groups, stars.df.where("alike").select("src", "dst").join(named("src", "g1"), "src").join(named("dst", "g2"), "dst").select("g1", "g2"))

    index = links.df.join(groups.df, "node").join(heads.df.select("cell", "head"), "cell")
    mixed = index.groupBy("cell").agg(F.min("grp").alias("low"), F.max("grp").alias("high")).where("low != high").select("cell")
    facts = stars.df.select(F.col("src").alias("node"), F.col("dst").alias("head"), *_FACTS)
    known = index.join(mixed, "cell").join(facts, ["node", "head"], "left")
    row = Table(known.select("cell", F.struct("node", "grp", "n", *_BITS, *_FACTS).alias("x")), "cell-rows")
    pair = row.df.join(row.df.withColumnRenamed("x", "y"), "cell").where((F.col("x.grp") < F.col("y.grp")) & _may_be_near("x.", "y.", least) & _may_share("x.", "y.", least))
    pairs = pair.select(F.greatest("x.node", "y.node").alias("src"), F.least("x.node", "y.node").alias("dst"), F.greatest("x.grp", "y.grp").alias("g1"), F.least("x.grp", "y.grp").alias("g2")).distinct()
    last = _compared(pairs, nodes, texts, least, least, words)
    groups = _joined(groups, last.df.where("alike").select("g1", "g2"))
    for x in (links, heads, stars, row, last):
        x.drop()
    return groups


def copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, least: float = 0.8) -> DataFrame:
    """(id, h, first) of every distinct (id, text): the hash of the text, and the row of its group of near copies that
    stands first, as a struct (nameless, id, h): the smallest id, rows without one last, then the smallest hash.

    Groups are connected by a similarity of whole texts of at least ``least``. Texts with the same words are one node,
    whatever rows hold them. Candidates have fingerprints within RADIUS bits, all of which meet, or share a band of minima: two texts of similarity s do but for a chance of
    (1 - s ** ROWS) ** BANDS, 0.0007 at 0.8."""
    marks = Table(signatures(docs, id_col, text_col, words), "signatures")
    order = F.struct(F.col("id").isNull().alias("nameless"), "id", "h")
    one = marks.df.groupBy("key").agg(F.min(order).alias("r"))
    nodes = Table(marks.df.join(one, "key").where(F.col("id").eqNullSafe(F.col("r.id")) & (F.col("h") == F.col("r.h"))).drop("r").dropDuplicates(["key"]).withColumnRenamed("key", "node"), "nodes")
    groups = _node_groups(nodes.df, _texts(docs, id_col, text_col), least, words)
    named = Table(marks.df.select("id", "h", F.col("key").alias("node")).distinct().join(groups.df, "node").select("id", "h", "grp"), "named")
    for x in (marks, nodes, groups):
        x.drop()
    return named.df.join(named.df.groupBy("grp").agg(F.min(order).alias("first")), "grp").select("id", "h", "first")


def near_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, least: float = 0.8) -> DataFrame:
    """One document of each group of near copies stays, the one with the smallest id, with all columns as they were.

    Documents are told apart by id and text: different texts under one id are documents of their own, rows that repeat
    both are copies, of which one stays (that with the smallest hash of its other columns). Rows without an id take
    part and stay only where no row of their group has an id. Null and empty texts, and texts of the same words, are
    copies of each other. An empty table gives no rows; other columns play no part."""
    h = free_name(docs.columns, "_rx_h")
    found = copies(docs, id_col, text_col, words, least)
    gone = Table(found.where(~F.col("id").eqNullSafe(F.col("first.id")) | (F.col("h") != F.col("first.h"))).select(F.col("id").alias("_rx_gone"), F.col("h").alias("_rx_hash")).distinct(), "gone").df
    hashed = docs.withColumn(h, _text_hash(col(text_col).cast("string")))
    kept = hashed.join(gone, (F.col("_rx_hash") == col(h)) & F.col("_rx_gone").eqNullSafe(col(id_col).cast("long")), "left_anti").select(*(col(c) for c in hashed.columns))
    return one_of_equal(kept, [id_col, h]).select(*(col(c) for c in docs.columns))


__all__ = ["classes", "copies", "fingerprints", "link_groups", "majority", "near_dedup", "shingle_hashes"]
