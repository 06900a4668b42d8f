"""Token ids in sorted-string-table shards (operator 7).

One shard file is a run of sections, each closed by a line feed (byte 10):

* data blocks: records in key order. A record is: varint length of the prefix shared with the key before, varint length
  of the rest, the rest, varint number of ids, the ids (little-endian, ``width`` bytes each). The first key of a block
  is whole. A block ends with the CRC-32 of what stands before it (4 bytes, little-endian).
* the sparse index: for each block its offset, length, number of records, number of ids before it in the shard (four
  little-endian 8-byte numbers), the length of its first key (one byte) and that key padded to 8 bytes.
* the Bloom filter over the keys.
* the footer of fixed length: see ``_FOOTER``.

A key is the id as 8 big-endian bytes with the sign bit turned, so byte order is number order; a row without an id has
the empty key, before all others. Lookups read the footer, ask the filter, bisect the index and read one block.

Sections go to the files through Spark's text writer as rows of raw bytes, whose line end is the section's last byte:
any file system that Spark writes to will do, and the commit protocol drops what a lost executor left half written.
"""

from __future__ import annotations

import bisect
import json
import struct
import zlib
from collections.abc import Iterator, Sequence
from contextlib import contextmanager
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import Table, col, importable, new_path, sole_memory
from .sharding import find_splitters, halves, number_of_range

_MAGIC = b"RXSST001"
#: records, ids, index offset, index length, filter offset, filter length, hash functions, width of an id, magic.
_FOOTER = struct.Struct("<QQQQQQII8s")
_ENTRY = struct.Struct("<QQQQB8s")
_BLOCK_BYTES = 256 << 10
_BLOOM_BITS, _BLOOM_HASHES = 10, 7


def key_of(doc_id: int | None) -> bytes:
    return b"" if doc_id is None else struct.pack(">Q", (doc_id + (1 << 63)) & ((1 << 64) - 1))


def id_of(key: bytes) -> int | None:
    return struct.unpack(">Q", key)[0] - (1 << 63) if key else None


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    out.append(n)
    return bytes(out)


def _read_varint(data: bytes, at: int) -> tuple[int, int]:
    n = shift = 0
    while True:
        b = data[at]
        at += 1
        n |= (b & 127) << shift
        if b < 128:
            return n, at
        shift += 7


def _positions(key: bytes, bits: int, hashes: int) -> list[int]:
    h = xxhash.xxh64_intdigest(key)
    step = h >> 32 | 1
    return [(h + i * step) % bits for i in range(hashes)]


class ShardWriter:
    """Sections of one shard from (key, id bytes) in key order; holds one block, the index and the keys' hashes."""

    def __init__(self, width: int):
        self.width, self.block, self.first, self.last, self.n = width, bytearray(), b"", b"", 0
        self.index: list[bytes] = []
        self.keys: list[bytes] = []
        self.at = self.ids = self.block_ids = 0

    def add(self, key: bytes, ids: bytes) -> bytes | None:
        if not self.n:
            self.first, shared = key, 0
        else:
            shared = next((i for i, (a, b) in enumerate(zip(key, self.last, strict=False)) if a != b), min(len(key), len(self.last)))
        count = len(ids) // self.width
        self.block += _varint(shared) + _varint(len(key) - shared) + key[shared:] + _varint(count) + ids
        self.last, self.n, self.block_ids = key, self.n + 1, self.block_ids + count
        self.keys.append(key)
        return self.flush() if len(self.block) >= _BLOCK_BYTES else None

    def flush(self) -> bytes | None:
        if not self.n:
            return None
        data = bytes(self.block) + struct.pack("<I", zlib.crc32(self.block))
        self.index.append(_ENTRY.pack(self.at, len(data), self.n, self.ids, len(self.first), self.first.ljust(8, b"\0")))
        self.at += len(data) + 1
        self.ids += self.block_ids
        self.block, self.n, self.block_ids = bytearray(), 0, 0
        return data

    def close(self) -> list[bytes]:
        out = [x for x in [self.flush()] if x]
        if not self.keys:
            return out
        index = b"".join(self.index)
        bits = max(64, len(self.keys) * _BLOOM_BITS)
        bloom = np.zeros(bits, np.uint8)
        for k in self.keys:
            bloom[_positions(k, bits, _BLOOM_HASHES)] = 1
        packed = struct.pack("<Q", bits) + np.packbits(bloom).tobytes()
        footer = _FOOTER.pack(len(self.keys), self.ids, self.at, len(index), self.at + len(index) + 1, len(packed), _BLOOM_HASHES, self.width, _MAGIC)
        return [*out, index, packed, footer]


class Shard:
    """Reads one shard file's bytes (any object with slices will do, a memory map for instance)."""

    def __init__(self, data: bytes):
        self.data = data
        self.records, self.ids, i_at, i_len, b_at, b_len, self.hashes, self.width, magic = _FOOTER.unpack(data[-_FOOTER.size - 1 : -1])
        if magic != _MAGIC:
            raise ValueError("not a shard of this format")
        self.index = [_ENTRY.unpack(data[i : i + _ENTRY.size]) for i in range(i_at, i_at + i_len, _ENTRY.size)]
        self.first_keys = [e[5][: e[4]] for e in self.index]
        self.bits = struct.unpack("<Q", data[b_at : b_at + 8])[0]
        self.bloom = data[b_at + 8 : b_at + b_len]

    def block(self, n: int) -> Iterator[tuple[bytes, int, np.ndarray]]:
        """(key, ids before it in the shard, ids) of a block's records; raises if the block is damaged."""
        at, length, records, before, *_ = self.index[n]
        body = bytes(self.data[at : at + length])
        if zlib.crc32(body[:-4]) != struct.unpack("<I", body[-4:])[0]:
            raise ValueError("damaged block")
        key, at = b"", 0
        for _ in range(records):
            shared, at = _read_varint(body, at)
            rest, at = _read_varint(body, at)
            key, at = key[:shared] + body[at : at + rest], at + rest
            count, at = _read_varint(body, at)
            yield key, before, np.frombuffer(body, f"<u{self.width}", count, at)
            at, before = at + count * self.width, before + count

    def scan(self) -> Iterator[tuple[bytes, int, np.ndarray]]:
        for n in range(len(self.index)):
            yield from self.block(n)

    def may_hold(self, key: bytes) -> bool:
        return all(self.bloom[p >> 3] >> (7 - (p & 7)) & 1 for p in _positions(key, self.bits, self.hashes))

    def get(self, doc_id: int | None) -> list[np.ndarray]:
        """The ids of every record under an id, by the filter, a bisection of the index and as few blocks as can be."""
        key, out = key_of(doc_id), []
        if not self.may_hold(key):
            return out
        n = max(0, bisect.bisect_left(self.first_keys, key) - 1)
        while n < len(self.index) and self.first_keys[n] <= key:
            out += [ids for k, _, ids in self.block(n) if k == key]
            n += 1
        return out


# Encoding ----------------------------------------------------------------------------------------------------------

_LETTERS = "A-Za-zÀ-ÖØ-öø-ÿ"
_MARKS = "".join(c for c in map(chr, range(33, 127)) if not c.isalnum())
_MARKED = f"^[{_LETTERS}]+[!-/:-@\\[-`{{-~]*$"
_KNOWN_PIECES = 250_000
_TEXT_BYTES, _WORDS = 4 << 20, 1 << 18
_ROWS_SENT = "spark.sql.execution.arrow.maxRecordsPerBatch"
_encoders: dict[str, Encoder] = {}


@dataclass(frozen=True)
class Rules:
    """What the driver reads from a tokenizer's file for all workers: bytes of an id, whether texts may be encoded word
    by word, and which ids end a word."""

    width: int
    by_word: bool
    ends: np.ndarray

    @classmethod
    def of(cls, spec: str) -> Rules:
        rules = json.loads(spec)
        vocab = rules["model"]["vocab"]
        pairs = list(vocab.items()) if isinstance(vocab, dict) else [(v[0], i) for i, v in enumerate(vocab)]
        pairs += [(t["content"], t["id"]) for t in rules.get("added_tokens", [])]
        top = max(i for _, i in pairs)
        ends = np.zeros(top + 1, bool)
        ends[[i for t, i in pairs if t.endswith("</w>")]] = True
        return cls(2 if top < 1 << 16 else 4, _drops_space(rules), ends)


class Encoder:
    """Ids of whole texts as bytes; pieces of words met before come from a bounded memory of this process.

    White space never meets other characters inside a token of a tokenizer that drops it, so a text's ids are those of
    its words one after another, and those of letters with marks after them are the letters' and the marks'. The words
    of a batch are split, told apart and put together again as Arrow and numpy arrays; only pieces that are new to the
    memory go to the tokenizer. Where the file's rules are not of that kind, whole texts are encoded.
    """

    def __init__(self, spec: str, rules: Rules | None = None):
        from tokenizers import Tokenizer

        rules = rules or Rules.of(spec)
        self.tokenizer = Tokenizer.from_str(spec)
        self.width, self.by_word, self.ends = rules.width, rules.by_word, rules.ends
        self.kind = np.dtype(f"<u{self.width}")
        self.forget()

    def forget(self) -> None:
        self.pieces: dict[str, int] = {"": 0}  # piece: its number
        self.ids = np.zeros(1 << 16, self.kind)  # the pieces' ids, one after another
        self.stops = np.zeros(1 << 14, np.int64)  # piece n has the ids from stops[n - 1] to stops[n]

    def whole(self, texts: list[str]) -> list[np.ndarray]:
        return [np.asarray(e.ids, self.kind) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def encode(self, texts: list[str]) -> list[bytes]:
        return self.encode_array(pa.array(texts, pa.string())).to_pylist()

    def encode_array(self, texts: pa.Array, tail: bytes = b"") -> pa.Array:
        """The ids of each text (null: none), each with ``tail`` after them, as a binary array."""
        parts = [x for _, _, x in self.encode_parts(texts, tail)]
        return pa.concat_arrays(parts) if parts else pa.array([], pa.binary())

    def encode_parts(self, texts: pa.Array, tail: bytes = b"") -> Iterator[tuple[int, int, pa.Array]]:
        """(first text, number of texts, ids) of parts of the texts, of some megabytes each."""
        texts = pc.fill_null(texts.cast(pa.string()), "")
        sizes, at = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(np.int64)), 0
        while at < len(texts):
            end = max(at + 1, int(np.searchsorted(sizes, (sizes[at - 1] if at else 0) + _TEXT_BYTES, side="right")))
            yield at, end - at, self._batch(texts.slice(at, end - at), tail)
            at = end

    def _batch(self, texts: pa.Array, tail: bytes) -> pa.Array:
        # Arrow takes the characters 28 to 31 for white space, the tokenizer does not.
        if not self.by_word or pc.any(pc.match_substring_regex(texts, "[\x1c-\x1f]")).as_py():
            return pa.array([x.tobytes() + tail for x in self.whole(texts.to_pylist())], pa.binary())
        lists = pc.utf8_split_whitespace(texts)
        coded = lists.flatten().dictionary_encode()
        first, second = self._numbers(coded.dictionary)
        index, ends = coded.indices.to_numpy(), np.cumsum(pc.list_value_length(lists).to_numpy(zero_copy_only=False))
        lengths = np.diff(self.stops[: len(self.pieces)], prepend=0)
        of_word = lengths[first] + lengths[second]
        before = np.concatenate([[0], np.cumsum(of_word[index])])
        out = [self._gather(first, second, index[i : i + _WORDS], lengths) for i in range(0, len(index), _WORDS)]
        data = np.concatenate(out) if out else np.zeros(0, self.kind)
        stops = before[ends] * self.width
        if not tail:
            return _binary(np.concatenate([[0], stops]), data.tobytes())
        raw, cuts = data.tobytes(), [0, *stops.tolist()]
        return _binary(np.concatenate([[0], stops + len(tail) * np.arange(1, len(stops) + 1)]), b"".join(x for a, b in zip(cuts, cuts[1:], strict=False) for x in (raw[a:b], tail)))

    def _gather(self, first: np.ndarray, second: np.ndarray, index: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """The ids of words one after another, by the numbers of their two pieces."""
        piece = np.empty(2 * len(index), np.int64)
        piece[::2], piece[1::2] = first[index], second[index]
        piece = piece[lengths[piece] > 0]
        size = lengths[piece]
        start = self.stops[piece] - size
        return self.ids[np.repeat(start - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))]

    def _numbers(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The numbers of the two pieces of each of the words, which are distinct."""
        if len(self.pieces) > _KNOWN_PIECES:
            self.forget()
        first, second = np.zeros(len(words), np.int64), np.zeros(len(words), np.int64)
        marked = pc.match_substring_regex(words, _MARKED)
        plain = np.flatnonzero(marked.to_numpy(zero_copy_only=False))
        other = np.flatnonzero(~marked.to_numpy(zero_copy_only=False))
        own = words.take(pa.array(plain))
        stems = pc.utf8_lower(pc.utf8_rtrim(own, _MARKS))
        coded = stems.dictionary_encode()
        first[plain] = self._learnt(coded.dictionary.to_pylist(), self._words)[coded.indices.to_numpy()]
        tailed = np.flatnonzero(pc.not_equal(pc.utf8_length(own), pc.utf8_length(stems)).to_numpy(zero_copy_only=False))
        tails = pc.replace_substring_regex(own.take(pa.array(tailed)), f"^[{_LETTERS}]+", "").dictionary_encode()
        second[plain[tailed]] = self._learnt(tails.dictionary.to_pylist(), self.whole)[tails.indices.to_numpy()]
        first[other] = self._learnt(words.take(pa.array(other)).to_pylist(), self.whole)
        return first, second

    def _learnt(self, pieces: list[str], encode) -> np.ndarray:
        new = [p for p in pieces if p not in self.pieces]
        if new:
            at, got = len(self.pieces), encode(new)
            stops = self.stops[at - 1] + np.cumsum([len(x) for x in got])
            if at + len(new) > len(self.stops):
                self.stops = np.resize(self.stops, 2 * (at + len(new)))
            if stops[-1] > len(self.ids):
                self.ids = np.resize(self.ids, 2 * int(stops[-1]))
            self.ids[self.stops[at - 1] : stops[-1]] = np.concatenate(got)
            self.stops[at : at + len(new)] = stops
            self.pieces.update(zip(new, range(at, at + len(new)), strict=True))
        return np.fromiter(map(self.pieces.__getitem__, pieces), np.int64, len(pieces))

    def _words(self, words: list[str]) -> list[np.ndarray]:
        """Words of letters only, many to a call; a token that ends a word ends a word's ids."""
        out: list[np.ndarray] = []
        for i in range(0, len(words), 512):
            part = words[i : i + 512]
            ids = np.asarray(self.tokenizer.encode_batch_fast([" ".join(part)], add_special_tokens=False)[0].ids, np.int64)
            ends = (np.flatnonzero(self.ends[ids]) + 1).tolist()
            if len(ends) == len(part):
                packed = ids.astype(self.kind)
                out += [packed[a:b] for a, b in zip([0, *ends], ends, strict=False)]
            else:
                out += self.whole(part)
        return out


def _binary(offsets: np.ndarray, data: bytes) -> pa.Array:
    return pa.Array.from_buffers(pa.large_binary(), len(offsets) - 1, [None, pa.py_buffer(np.ascontiguousarray(offsets, np.int64)), pa.py_buffer(data)]).cast(pa.binary())


def _drops_space(rules: dict) -> bool:
    steps = (rules.get("normalizer") or {}).get("normalizers") or []
    cuts = (rules.get("pre_tokenizer") or {}).get("pretokenizers") or []
    word = "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"
    return [s.get("type") for s in steps] == ["NFC", "Replace", "Lowercase"] and steps[1].get("pattern") == {"Regex": "\\s+"} and steps[1].get("content") == " " and len(cuts) == 2 and cuts[0].get("pattern") == {"Regex": word} and cuts[0].get("behavior") == "Removed" and cuts[0].get("invert") is True and cuts[1].get("add_prefix_space") is False and cuts[1].get("use_regex") is False and rules["model"].get("end_of_word_suffix") == "</w>" and not any(t.get("single_word") or t.get("normalized") or t["content"] != "".join(t["content"].split()) for t in rules.get("added_tokens", []))


def _nothing() -> None:
    """Writing and reading files remember no words."""


def encoder(spec: str, rules: Rules) -> Encoder:
    """This process's encoder for a tokenizer file's text; it lives as long as the worker."""
    sole_memory("tokens", _encoders.clear)
    key = xxhash.xxh64_hexdigest(spec)
    if key not in _encoders:
        _encoders[key] = Encoder(spec, rules)
    return _encoders[key]


# Operators ---------------------------------------------------------------------------------------------------------


def write(docs: DataFrame, path: str, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", end_id: int | None = 2, shard_bytes: int = 16 << 20) -> None:
    """Encode every whole text, add ``end_id``, and write shards in ascending id order to ``path``.

    Shards are ranges of ids of about ``shard_bytes`` text bytes, cut by the histogram sort of operator 4. Null and
    empty texts have the end id alone. Rows without an id come first. Rows that repeat an id follow one another, by the
    hash of their texts, and are all written; many of them, or many without an id, are split over shards like others.
    Other columns play no part. An empty table gives no shard.
    """
    spark = docs.sparkSession
    importable(spark)
    with open(tokenizer_path, encoding="utf-8") as f:
        spec = f.read()
    rules = Rules.of(spec)
    width, sent = rules.width, spark.sparkContext.broadcast((spec, rules))
    text = col(text_col).cast("string")
    source = docs.select(col(id_col).cast("long").alias("id"), F.coalesce(F.xxhash64(text), F.lit(0)).alias("d"), text.alias("text"))
    lowest = F.lit(-(1 << 63)).cast("long")
    sizes = Table(source.select(F.coalesce("id", lowest).alias("h"), "d", (F.coalesce(F.octet_length("text"), F.lit(0)).cast("long") + 16).alias("size")), "sizes").df
    total = sizes.agg(F.sum("size")).first()[0] or 0
    parts = max(1, -(-total // shard_bytes))
    cut = find_splitters(sizes, parts, tolerance=0.05, probes=max(1024, 8 * parts))
    tail = b"" if end_id is None else int(end_id).to_bytes(width, "little")

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = encoder(*sent.value)
        high, low = bounds.value
        for b in batches:
            for at, n, ids in e.encode_parts(b.column(2), tail):
                own, d = b.column(0).slice(at, n), b.column(1).slice(at, n)
                part = number_of_range(high, low, pc.fill_null(own, -(1 << 63)).to_numpy(), d.to_numpy())
                yield pa.RecordBatch.from_arrays([own, d, ids, pa.array(part.astype(np.int32))], ["id", "d", "ids", "part"])

    def sections(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sole_memory("token files", _nothing)
        w = ShardWriter(width)
        for b in batches:
            for doc_id, ids in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                if (block := w.add(key_of(doc_id), ids)) is not None:
                    yield pa.RecordBatch.from_arrays([pa.array([block], pa.binary())], ["section"])
        for x in w.close():
            yield pa.RecordBatch.from_arrays([pa.array([x], pa.binary())], ["section"])

    bounds = spark.sparkContext.broadcast(halves(cut.keys))
    encoded = source.mapInArrow(encode, "id long, d long, ids binary, part int")
    ordered = encoded.repartitionById(parts, F.col("part")).sortWithinPartitions(F.col("id").asc_nulls_first(), "d", "ids")
    with _small_batches(spark):
        ordered.select("id", "ids").mapInArrow(sections, "section binary").select(F.col("section").cast("string").alias("value")).write.option("compression", "none").option("lineSep", "\n").text(path)


@contextmanager
def _small_batches(spark: SparkSession) -> Iterator[None]:
    """Rows go to the workers by the thousand, as a worker keeps its words beside them."""
    before = spark.conf.get(_ROWS_SENT, None)
    spark.conf.set(_ROWS_SENT, "2000")
    try:
        yield
    finally:
        spark.conf.unset(_ROWS_SENT) if before is None else spark.conf.set(_ROWS_SENT, before)


def read(spark: SparkSession, path: str) -> DataFrame:
    """Every record of the shards under ``path``: (id, start, n_tokens, ids_crc32, shard).

    start is the number of ids of all records before it, ids_crc32 the CRC-32 of the ids as little-endian 32-bit
    numbers. Shards are read whole by Spark's binary reader; they are small by design."""
    importable(spark)
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).where("length > 0")

    def footer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sole_memory("token files", _nothing)
        for b in batches:
            for name, data in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                s = Shard(memoryview(data.as_buffer()))
                yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([id_of(s.first_keys[0])], pa.int64()), pa.array([s.ids], pa.int64())], ["shard", "first_id", "n_ids"])

    def records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for name, data in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                s = Shard(memoryview(data.as_buffer()))
                rows = [(id_of(k), at, len(ids), zlib.crc32(ids.astype("<u4").tobytes())) for k, at, ids in s.scan()]
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(rows)), *(pa.array([r[i] for r in rows], pa.int64()) for i in range(4))], ["shard", "id", "at", "n_tokens", "ids_crc32"])

    content = files.select("path", "content")
    totals = Table(content.mapInArrow(footer, "shard string, first_id long, n_ids long"), "footers").df
    # Shards were written by ascending ranges: the number in a file's name is the range's.
    before = W.orderBy(_number("shard")).rowsBetween(W.unboundedPreceding, -1)
    starts = totals.select("shard", F.coalesce(F.sum("n_ids").over(before), F.lit(0)).alias("base"))
    rows = content.mapInArrow(records, "shard string, id long, at long, n_tokens long, ids_crc32 long")
    return rows.join(starts, "shard").select("id", (F.col("at") + F.col("base")).alias("start"), "n_tokens", "ids_crc32", "shard")


def _number(shard: str) -> Column:
    return F.regexp_extract(shard, r"part-([0-9]+)[^/]*$", 1).cast("long")


def lookup(spark: SparkSession, path: str, ids: Sequence[int | None]) -> DataFrame:
    """(id, ids, shard) of every record under one of the wanted ids, a million at most: each shard's filter says which it
    may hold, its index is bisected, and only blocks that may hold one are decoded. Ids that no shard holds give no row,
    repeated records a row each."""
    if len(ids) > 1_000_000:
        raise ValueError("more than a million ids: read the shards and join")
    importable(spark)
    sent = spark.sparkContext.broadcast(sorted(set(ids), key=key_of))
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).where("length > 0")

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sole_memory("token files", _nothing)
        for b in batches:
            for name, data in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                s = Shard(memoryview(data.as_buffer()))
                rows = [(i, got) for i in sent.value for got in s.get(i)]
                yield pa.RecordBatch.from_arrays([pa.array([i for i, _ in rows], pa.int64()), pa.array([g.tolist() for _, g in rows], pa.list_(pa.int64())), pa.array([name] * len(rows), pa.string())], ["id", "ids", "shard"])

    return files.select("path", "content").mapInArrow(find, "id long, ids array<long>, shard string")


def encode_corpus(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", end_id: int | None = 2, path: str | None = None) -> DataFrame:
    """Write the shards (to the shared folder unless ``path`` says where) and return what ``read`` finds in them."""
    path = path or new_path(docs.sparkSession, "tokens")
    write(docs, path, tokenizer_path, id_col, text_col, end_id)
    return read(docs.sparkSession, path)


__all__ = ["Shard", "ShardWriter", "encode_corpus", "lookup", "read", "write"]
