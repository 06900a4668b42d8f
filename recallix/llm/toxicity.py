"""Toxicity by a support vector machine with a subsequence string kernel and Nystroem landmarks (operator 9).

A sentence is a run of units: its words in lower case, letters only, with runs of single letters joined, so that
"i d i o t", "i.d.i.o.t" and "idiot" are one unit. The kernel of two units counts the subsequences of three and of four
letters (word ends count as letters) that they share, each weighted down by the gaps it spans: a few inserted or
missing characters leave most of it. The machine is trained on labelled sentences, each by the unit that speaks for it,
in the space of landmarks; a text's decision value is the largest of its units', as one insult makes a text toxic, and a
logistic curve fitted to labelled texts turns it into a score.

Scoring needs no landmark at run time. A decision value is linear in the counted subsequences, so landmarks and
machine fold into one weight for each subsequence: two tables of fixed size, sent to the executors once. Latin letters
lose their accents; subsequences with letters of other scripts share the tables by hash.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Callable, Iterator, Mapping
from dataclasses import dataclass
from functools import lru_cache
from heapq import nlargest
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Table, col, importable, sole_memory

ALPHABET = 32
SPANS = {3: 6, 4: 7}  # letters of a subsequence: most characters it may span
DECAY = 0.5
MAX_UNIT, STEP = 24, 12
_PRIME = 1_000_003
_CACHE_UNITS = 250_000
_LETTERS = re.compile(r"[^\W\d_]+")
_SPACED = re.compile(r"(?<![^\W\d_])(?:[^\W\d_][\W_]+){2,}[^\W\d_](?![^\W\d_])")


def units(text: str) -> list[str]:
    """The units of a text in order."""
    low = text.lower()
    if _SPACED.search(low):
        low = _SPACED.sub(lambda m: " " + "".join(_LETTERS.findall(m[0])) + " ", low)
    return [u for w in low.split() if (u := w if w.isalpha() else "".join(_LETTERS.findall(w)))]


def _pieces(unit: str) -> list[str]:
    """A long unit as overlapping windows that together hold all of it."""
    if len(unit) <= MAX_UNIT:
        return [unit]
    starts = [*range(0, len(unit) - MAX_UNIT, STEP), len(unit) - MAX_UNIT]
    return [unit[i : i + MAX_UNIT] for i in starts]


@lru_cache(maxsize=None)
def _picks(length: int, letters: int) -> tuple[np.ndarray, np.ndarray]:
    """Index sets of the subsequences of a padded unit, and their weights, scaled to unit length in total."""
    span = SPANS[letters]
    sets = [(i, *(i + j for j in rest)) for i in range(length) for rest in combinations(range(1, span), letters - 1) if i + rest[-1] < length]
    if not sets:
        return np.empty((0, letters), np.intp), np.empty(0, np.float32)
    index = np.array(sets, np.intp)
    weight = DECAY ** (index[:, -1] - index[:, 0] + 1 - letters).astype(np.float64)
    return index, (weight / np.sqrt((weight**2).sum()) / np.sqrt(len(SPANS))).astype(np.float32)


def _folded() -> np.ndarray:
    """Numbers 1 to 26 of the letters that Latin letters with accents are made of; 0 for other characters."""
    out = np.zeros(0x250, np.int64)
    joined = {"ß": "s", "ø": "o", "æ": "a", "œ": "o", "ł": "l", "đ": "d", "ı": "i"}
    for c in range(len(out)):
        base = unicodedata.normalize("NFD", joined.get(chr(c).lower(), chr(c).lower()))[0]
        out[c] = ord(base) - 96 if "a" <= base <= "z" else 0
    return out


_FOLD = _folded()


def _codes(pieces: list[str]) -> np.ndarray:
    """Letters of equally long pieces as numbers, with 0 at both ends: 1 to 26 for Latin letters without their accents,
    a number of ALPHABET or more for any other letter."""
    raw = np.frombuffer("".join(pieces).encode("utf-32-le", "surrogatepass"), np.uint32).reshape(len(pieces), -1).astype(np.int64)
    out = np.zeros((raw.shape[0], raw.shape[1] + 2), np.int64)
    latin = np.where(raw < len(_FOLD), _FOLD[np.minimum(raw, len(_FOLD) - 1)], 0)
    out[:, 1:-1] = np.where(latin > 0, latin, ALPHABET + raw)
    return out


def _features(pieces: list[str]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For pieces of one length: (letters, subsequence numbers of each piece, weights). Subsequences of Latin letters
    have numbers of their own; one with a letter of another script has a number by the hash of its letters."""
    codes = _codes(pieces)
    plain = codes.max(initial=0) < ALPHABET
    small = codes.astype(np.int32) if plain else codes
    for letters in SPANS:
        index, weight = _picks(codes.shape[1], letters)
        number = np.zeros((len(pieces), len(index)), small.dtype)
        for j in range(letters):
            number *= ALPHABET if plain else _PRIME
            number += small[:, index[:, j]]
        if not plain:
            direct = np.zeros_like(number)
            for j in range(letters):
                direct = direct * ALPHABET + np.minimum(codes[:, index[:, j]], ALPHABET - 1)
            foreign = (codes[:, index] >= ALPHABET).any(axis=2)
            mixed = number.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(40)
            number = np.where(foreign, (mixed % np.uint64(ALPHABET**letters)).astype(np.int64), direct)
        yield letters, number, weight


def _by_kind(pieces: list[str]) -> Iterator[list[int]]:
    """Places of pieces of equal length, those of Latin letters apart from the others, some thousands at a time."""
    kinds: dict[tuple[int, bool], list[int]] = {}
    for i, p in enumerate(pieces):
        kinds.setdefault((len(p), p.isascii()), []).append(i)
    for places in kinds.values():
        for i in range(0, len(places), 4096):
            yield places[i : i + 4096]


def decide_pieces(pieces: list[str], tables: dict[int, np.ndarray], bias: float) -> np.ndarray:
    """Decision values of units of at most MAX_UNIT letters."""
    out = np.full(len(pieces), bias)
    for places in _by_kind(pieces):
        value = np.full(len(places), bias)
        for letters, number, weight in _features([pieces[i] for i in places]):
            value += tables[letters][number] @ weight
        out[places] = value
    return out


def decide(strings: list[str], tables: dict[int, np.ndarray], bias: float) -> np.ndarray:
    """Decision values of units: a long unit has the largest of its windows'."""
    parts = [(i, p) for i, u in enumerate(strings) for p in _pieces(u)]
    out = np.full(len(strings), -np.inf)
    np.maximum.at(out, [i for i, _ in parts], decide_pieces([p for _, p in parts], tables, bias))
    return out


@dataclass
class Model:
    """Weights of the subsequences, bias, and the logistic curve. Its size doesn't depend on the data."""

    tables: dict[int, np.ndarray]
    bias: float
    slope: float = 1.0
    offset: float = 0.0
    landmarks: tuple[str, ...] = ()

    #: The decision value of a text without units.
    EMPTY = -4.0


class _Landmarks:
    """Kernel values against a list of landmarks, through the subsequences that occur in any of them."""

    def __init__(self, marks: list[str]):
        self.marks = marks
        self.place, used = {}, 0
        for letters in SPANS:
            table = np.full(ALPHABET**letters, -1, np.int32)
            found = np.unique(np.concatenate([number.ravel() for m in marks for k, number, _ in _features([m]) if k == letters]))
            table[found] = np.arange(used, used + len(found), dtype=np.int32)
            self.place[letters], used = table, used + len(found)
        self.used = used
        self.matrix = np.empty((used, len(marks)), np.float32)
        for i in range(0, len(marks), 64):
            self.matrix[:, i : i + 64] = self.counts(marks[i : i + 64]).T

    def counts(self, strings: list[str]) -> np.ndarray:
        out = np.zeros((len(strings), self.used + 1), np.float32)  # the last column takes what no landmark has
        for rows in _by_kind(strings):
            for letters, number, weight in _features([strings[i] for i in rows]):
                np.add.at(out, (np.array(rows)[:, None], self.place[letters][number]), weight[None, :])
        return out[:, :-1]

    def kernel(self, strings: list[str]) -> np.ndarray:
        parts = [self.counts(strings[i : i + 64]) @ self.matrix for i in range(0, len(strings), 64)]
        return np.vstack(parts).astype(np.float64) if parts else np.zeros((0, len(self.marks)))


def _svm(x: np.ndarray, y: np.ndarray, weight: np.ndarray, c: float = 100.0, steps: int = 40) -> tuple[np.ndarray, float]:
    """Primal squared-hinge SVM by Newton steps; the bias is a constant feature that is hardly penalised. Examples are
    32-bit numbers, of which some thousands at a time are used in 64 bits."""
    blocks = [slice(i, i + 4096) for i in range(0, len(x), 4096)]
    reg = np.ones(x.shape[1] + 1)
    reg[-1] = 1e-3
    w = np.zeros(x.shape[1] + 1)

    def margins(w):
        return y * (np.concatenate([x[b].astype(np.float64) @ w[:-1] for b in blocks]) + w[-1])

    def cost(w, m):
        return 0.5 * (reg * w * w).sum() + c * (weight * np.maximum(0, 1 - m) ** 2).sum()

    m = margins(w)
    for _ in range(steps):
        grad, hess = reg * w, np.diag(reg)
        for b in blocks:
            use = m[b] < 1
            z = np.hstack([x[b][use].astype(np.float64), np.ones((int(use.sum()), 1))])
            wb = weight[b][use]
            grad -= 2 * c * z.T @ (wb * y[b][use] * (1 - m[b][use]))
            hess += 2 * c * (z.T * wb) @ z
        if np.abs(grad).max() < 1e-6:
            break
        step = np.linalg.solve(hess, grad)
        rate, old = 1.0, cost(w, m)
        while rate > 1e-4 and cost(w - rate * step, margins(w - rate * step)) > old:
            rate /= 2
        w = w - rate * step
        m = margins(w)
    return w[:-1], w[-1]


class _Machine:
    """The machine in the space of landmarks, and the folding of its weights into tables of subsequences."""

    def __init__(self, marks: list[str]):
        self.marks, self.space = marks, _Landmarks(marks)
        kmm = self.space.kernel(marks)
        value, vector = np.linalg.eigh((kmm + kmm.T) / 2)
        good = value > 1e-4
        self.root = vector[:, good] / np.sqrt(value[good])
        self.places: dict[str, int] = {}
        self.rows: list[np.ndarray] = []

    def phi(self, strings: list[str]) -> np.ndarray:
        new = [x for x in strings if x not in self.places]
        self.places.update(zip(new, range(len(self.places), len(self.places) + len(new)), strict=True))
        self.rows += [(self.space.kernel(new[i : i + 2048]) @ self.root).astype(np.float32) for i in range(0, len(new), 2048)]
        self.rows = [np.vstack(self.rows)]
        return self.rows[0][[self.places[x] for x in strings]]

    def fit(self, toxic: Mapping[str, float], clean: Mapping[str, float]) -> Model:
        """Examples are sentences by the unit that speaks for them, with weights; toxic ones count a quarter of the
        clean ones in all at least."""
        names = [*toxic, *clean]
        y = np.concatenate([np.ones(len(toxic)), -np.ones(len(clean))])
        w = np.array([*toxic.values(), *clean.values()], float)
        w[: len(toxic)] = np.clip(w[: len(toxic)] / w[: len(toxic)].mean(), 0.2, 3) * max(1.0, len(clean) / len(toxic) / 4)
        w[len(toxic) :] = 1
        coef, bias = _svm(self.phi(names), y, w)
        beta = self.root @ coef
        tables = {k: np.zeros(ALPHABET**k, np.float64) for k in SPANS}
        for m, b in zip(self.marks, beta, strict=True):
            for k, number, weight in _features([m]):
                np.add.at(tables[k], number[0], b * weight)
        return Model({k: t.astype(np.float32) for k, t in tables.items()}, float(bias), landmarks=tuple(self.marks))


def _logistic(f: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and offset of the logistic curve, with targets pulled in as there are few labels (Platt, 1999)."""
    pos, neg = y.sum(), (1 - y).sum()
    t = np.where(y > 0, (pos + 1) / (pos + 2), 1 / (neg + 2))
    a, b = 1.0, 0.0
    for _ in range(200):
        p = 1 / (1 + np.exp(-np.clip(a * f + b, -30, 30)))
        g = np.array([((p - t) * f).sum() + 1e-3 * a, (p - t).sum()])
        s = p * (1 - p) + 1e-9
        h = np.array([[(s * f * f).sum() + 1e-3, (s * f).sum()], [(s * f).sum(), s.sum() + 1e-6]])
        d = np.linalg.solve(h, g)
        a, b = a - np.clip(d[0], -1, 1), b - np.clip(d[1], -1, 1)
        if np.abs(d).max() < 1e-7:
            break
    return float(max(a, 0.05)), float(b)


def held_out(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2


def learns_from(doc_id: Column) -> Column:
    return ~held_out(doc_id)


def _nothing_learnt() -> Model:
    return Model({k: np.zeros(ALPHABET**k, np.float32) for k in SPANS}, Model.EMPTY, 1.0, -30.0)


def train(docs: DataFrame, labels: DataFrame, where: Callable[[Column], Column] | None = None, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", max_toxic: int = 4000, max_clean: int = 8000, landmarks: int = 320, rounds: int = 2, speakers: int = 2) -> Model:
    """Fit a model to a sample of labelled texts, of fixed size: at most ``max_toxic`` and ``max_clean`` rows, those
    with the smallest hashes of their ids.

    ``where`` says from which ids to learn. Labels for unknown documents, null labels and null ids teach nothing; an
    id with several labels counts as toxic if one says so. The machine is trained on the sample's texts, each by units
    that speak for it, ``speakers`` at most at a time. For a toxic text those are its units with the most contexts
    (units around) in toxic texts, of the units that have eight times the share of contexts there that they have in
    clean ones; contexts rather than texts, so that copies of a text count once. For a clean text all units are clean:
    some by their hash at first, and in each round those that the machine takes for the most toxic. So only some units
    of each text and round come to the driver, whose memory is bounded by the sample's rows, however long the texts
    are. Landmarks come from both sides' units.
    Without labels of both kinds the model scores everything 0.
    """
    importable(docs.sparkSession)
    marked = labels.select(col(id_col).cast("long").alias("id"), col(label_col).cast("int").alias("toxic")).where("id is not null and toxic is not null").groupBy("id").agg(F.max("toxic").alias("toxic"))
    if where is not None:
        marked = marked.where(where(F.col("id")))
    ranked = marked.withColumn("h", F.xxhash64("id"))
    sample = ranked.where("toxic = 1").orderBy("h", "id").limit(max_toxic).unionByName(ranked.where("toxic = 0").orderBy("h", "id").limit(max_clean)).select("id", "toxic")
    texts = Table(docs.select(col(id_col).cast("long").alias("id"), col(text_col).cast("string").alias("text")).join(F.broadcast(sample), "id"), "labelled")

    def contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, text, toxic in zip(*(b.column(k).to_pylist() for k in range(3)), strict=True):
                seq = [p for u in units(text or "") for p in _pieces(u)]
                around = list({(u, hash_pair(p, n)) for p, u, n in zip(["", *seq[:-1]], seq, [*seq[1:], ""], strict=True)})
                yield pa.RecordBatch.from_arrays([pa.array([i] * len(around), pa.int64()), pa.array([u for u, _ in around], pa.string()), pa.array([h for _, h in around], pa.int64()), pa.array([toxic] * len(around), pa.int32())], ["id", "unit", "ctx", "toxic"])

    seen = Table(texts.df.select("id", "text", "toxic").mapInArrow(contexts, "id long, unit string, ctx long, toxic int"), "contexts")
    counts = Table(seen.df.groupBy("unit", "ctx", "toxic").agg(F.lit(1).alias("one")).groupBy("unit").agg(F.sum("toxic").alias("t"), F.sum(1 - F.col("toxic")).alias("c")), "units")
    sizes = {r["toxic"]: r["n"] for r in sample.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    total = counts.df.agg(F.sum("t").alias("t"), F.sum("c").alias("c")).first()
    if not sizes.get(1) or not sizes.get(0) or not total["t"] or not total["c"]:
        return _nothing_learnt()
    few = max(2, min(4, sizes[1] // 100))
    rate = (F.col("t") / total["t"]) / ((F.col("c") + 0.5) / total["c"])
    rated = counts.df.select("unit", F.when((F.col("t") >= few) & (rate >= 8), F.col("t")).otherwise(F.lit(0)).alias("told"))
    spoken = seen.df.select("id", "toxic", "unit").distinct().join(rated, "unit").groupBy("id", "toxic").agg(F.sort_array(F.collect_list(F.when(F.col("told") > 0, F.struct("told", "unit"))), asc=False).alias("told"), *(F.min(F.struct(F.xxhash64("id", "unit", F.lit(i)), "unit")).alias(f"any{i}") for i in range(speakers)))
    first = spoken.select("toxic", F.slice("told.unit", 1, speakers).alias("told"), F.array(*(F.col(f"any{i}.unit") for i in range(speakers))).alias("others")).toPandas()
    toxic = Counter(u for x in first["told"][first["toxic"] == 1] for u in x)
    if not toxic:
        return _nothing_learnt()
    # A clean text's unit is an example whatever speaks for toxic texts, unless it is one of their units itself.
    calm = first[first["toxic"] == 0]
    clean = {u: 1.0 for u in sorted({u for c in ("told", "others") for x in calm[c] for u in x}) if u not in toxic}
    ordered = [u for u, _ in sorted(toxic.items(), key=lambda x: (-x[1], x[0]))][: landmarks // 2]
    others = sorted(clean, key=lambda u: hash_pair(u, ""))[: landmarks - len(ordered)]
    machine = _Machine([*ordered, *others])
    for turn in range(rounds + 1):
        model = machine.fit({u: n**0.5 for u, n in sorted(toxic.items())}, clean)
        values = _spoken(texts.df, model, speakers).toPandas()
        if turn == rounds:
            break
        calm = values[values["toxic"] == 0]
        clean |= {u: 1.0 for u in sorted({u for x, f in zip(calm["units"], calm["values"], strict=True) for u, v in zip(x, f, strict=True) if v > -0.8}) if u not in toxic}
    for x in (texts, seen, counts):
        x.drop()
    model.slope, model.offset = _logistic(np.array([f[0] if len(f) else Model.EMPTY for f in values["values"]], float), values["toxic"].to_numpy(float))
    return model


def _spoken(texts: DataFrame, model: Model, most: int) -> DataFrame:
    """(toxic, units, values) of each text (id, text, toxic): the ``most`` units with the largest decision values, the
    largest first, and those values."""
    sent = texts.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = sent.value
        for b in batches:
            for i in range(0, b.num_rows, 500):
                part = b.slice(i, 500)
                lists = [list(dict.fromkeys(p for u in units(t or "") for p in _pieces(u))) for t in part.column(1).to_pylist()]
                new = list(set().union(*lists))
                value = dict(zip(new, decide_pieces(new, model.tables, model.bias).tolist(), strict=True))
                best = [nlargest(most, ((value[p], p) for p in x)) for x in lists]
                yield pa.RecordBatch.from_arrays([part.column(2), pa.array([[u for _, u in x] for x in best], pa.list_(pa.string())), pa.array([[f for f, _ in x] for x in best], pa.list_(pa.float64()))], ["toxic", "units", "values"])

    return texts.select("id", "text", "toxic").mapInArrow(run, "toxic int, units array<string>, values array<double>")


def hash_pair(a: str, b: str) -> int:
    import xxhash

    return xxhash.xxh64_intdigest(f"{a}\0{b}") - (1 << 63)


class _Memory(dict):
    """Decision values of the units of one model met by this process, up to a bound."""


_memories: dict[str, _Memory] = {}


def _values(texts: list[str | None], model: Model) -> list[float]:
    """Decision values of texts, some hundreds at a time; values of units met before come from this process's memory."""
    sole_memory("toxicity", _memories.clear)
    key = f"{model.bias!r}:{[float(t.sum(dtype=np.float64)) for t in model.tables.values()]!r}"
    for old in [k for k in _memories if k != key]:
        del _memories[old]
    memory, out = _memories.setdefault(key, _Memory()), []
    for i in range(0, len(texts), 500):
        lists = [units(t or "") for t in texts[i : i + 500]]
        new = list(set().union(*lists) - memory.keys())
        memory.update(zip(new, decide(new, model.tables, model.bias).tolist(), strict=True))
        out += [max(map(memory.__getitem__, u)) if u else Model.EMPTY for u in lists]
        if len(memory) > _CACHE_UNITS:
            memory.clear()
    return out


def decisions(rows: DataFrame, model: Model) -> DataFrame:
    """Rows (id, text, ...) without the text, with the decision value ``f`` of each whole text."""
    importable(rows.sparkSession)
    sent = rows.sparkSession.sparkContext.broadcast(model)
    rest = [c for c in rows.columns if c != "text"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = _values(b.column(b.schema.get_field_index("text")).to_pylist(), sent.value)
            yield pa.RecordBatch.from_arrays([*(b.column(b.schema.get_field_index(c)) for c in rest), pa.array(out, pa.float64())], [*rest, "f"])

    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema.fields if f.name != "text")
    return rows.mapInArrow(run, f"{kinds}, f double")


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, score) of every row by its text alone, from 0 to 1. Null and empty texts and texts without letters score as
    texts without units. Repeated rows repeat; an empty table gives no rows; other columns play no part."""
    rows = docs.select(col(id_col).cast("long").alias("id"), col(text_col).cast("string").alias("text"))
    value = F.lit(model.slope) * F.col("f") + F.lit(model.offset)
    return decisions(rows, model).select("id", (F.lit(1.0) / (F.lit(1.0) + F.exp(-F.greatest(F.lit(-30.0), F.least(F.lit(30.0), value))))).alias("score"))


def reject_toxic(docs: DataFrame, model: Model, threshold: float = 0.3, text_col: str = "text") -> DataFrame:
    """The rows whose text scores below the threshold, with all their columns. Each row is judged by its own text."""
    importable(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def value(texts):
        import pandas as pd

        return pd.Series(_values(texts.tolist(), sent.value), dtype="float64")

    cut = (np.log(threshold / (1 - threshold)) - model.offset) / model.slope
    return docs.where(value(col(text_col).cast("string")) < F.lit(float(cut)))
