"""Fuzzy line deduplication with DataFrame operations only (operator 8).

Lines are normalised (lower case, ASCII marks become spaces, runs of spaces one space) and told apart by a hash. A line
of n words that is at least 0.8 similar to one as long or shorter differs from it by e = n / 5 edits at most. Cut into
e + 1 segments, it has one that no edit touches, so the other line holds the segment's words as they are, at most e
places off. A join on the first words of segments (four, fewer in short lines) with all such runs of words therefore
finds every pair; the edit similarity of the word sequences then decides. Of each connected group one occurrence stays,
the first by document id and position.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Table, col, components, free_name

SIMILARITY = 0.8
_RUN, _LONG = 4, 16  # lines of _LONG words or more have segments of _RUN words at least
_LEAST = 4  # shorter lines can't be near to another one: an edit of a line of four words is more than is allowed
_SLICES, _CLEANUP = 4, "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_BROADCAST_IDS = 1_000_000


def normalise(line: Column) -> Column:
    marks = F.regexp_replace(F.lower(line), r"[\x00-\x1f!-/:-@\[-`{-\x7f]+", " ")
    return F.trim(F.regexp_replace(marks, "  +", " "))


def _normalised_lines(text: Column) -> Column:
    """The lines of a whole text, normalised but for a space at their ends. Runs are replaced before the text is cut, and
    single spaces between words, most of all runs, don't match."""
    marks = r"\x00-\x09\x0b-\x1f!-/:-@\[-`{-\x7f"
    return F.split(F.regexp_replace(F.lower(text), rf"[{marks}][ {marks}]*+| [ {marks}]++", " "), "\n", -1)


def occurrences(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, h, pos, lid, norm, n_words) of every line that has a word, whole texts; h is the hash of the text."""
    text = col(text_col).cast("string")
    lines = docs.select(col(id_col).cast("long").alias("id"), F.xxhash64(text).alias("h"), F.posexplode(_normalised_lines(text)).alias("pos", "line"))
    words = F.octet_length("norm") - F.octet_length(F.replace("norm", F.lit(" "), F.lit(""))) + 1
    return lines.select("id", "h", "pos", F.trim("line").alias("norm")).where("norm != ''").select("id", "h", "pos", F.xxhash64("norm").alias("lid"), "norm", words.alias("n_words"))


def _edits(n: Column) -> Column:
    """The most word edits that a line of n words, the longer of two, is allowed."""
    return F.floor((1 - F.lit(SIMILARITY)) * n + F.lit(1e-9)).cast("int")


def _segment(n: Column) -> Column:
    """The length of each of a line's segments, one more than its edits: any line it may be near to has one unchanged."""
    return F.floor(n / (_edits(n) + 1)).cast("int")


def distinct_lines(occ: DataFrame) -> DataFrame:
    """(lid, norm, n_words, parity) of the distinct lines; parity has a bit for each of 64 classes of words, set if the
    line holds an odd number of them. A word edit changes two bits at most."""
    bits = F.transform(F.split("norm", " "), lambda w: F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(F.xxhash64(w), F.lit(64)).cast("int")))
    parity = F.aggregate(bits, F.lit(0).cast("long"), lambda acc, x: acc.bitwiseXOR(x))
    return occ.select("lid", "norm", "n_words").dropDuplicates(["lid"]).withColumn("parity", parity)


def _runs(lines: DataFrame, piece: int = 0, pieces: int = 1) -> DataFrame:
    """(run, lid, place) of the runs of words by which near lines meet: the longer line of a pair shows the start of an
    unchanged segment, the other one holds the same run. place has the line's number of words, the run's position and
    whether a segment starts there in its bits from 32, from 1 and at 0. Runs have _RUN words, shorter ones
    are for lines whose segments are shorter. Of several pieces one has the runs of some first words: only these are
    hashed whole."""
    n = F.col("n_words").cast("int")
    own = F.least(_segment(n), F.lit(_RUN))
    words = lines.select("lid", n.alias("n"), own.alias("own"), _segment(n).alias("step"), F.split("norm", " ").alias("w")).where(F.col("n") >= _LEAST)
    longest = F.floor(F.col("n") / F.lit(SIMILARITY) + F.lit(1e-9)).cast("int")
    out = None
    for k in range(1, _RUN + 1):
        # Lines of this or a longer length, up to what may be near, whose segments give runs of k words.
        used = F.array_contains(F.transform(F.sequence("n", longest), lambda m: F.least(_segment(m), F.lit(_RUN))), F.lit(k))
        some = words.where((F.col("n") >= k) & (F.when(F.col("n") < _LONG, used).otherwise(F.lit(k == _RUN))))
        at = some.select("lid", "n", "own", "step", "w", F.explode(F.sequence(F.lit(0), F.col("n") - k)).alias("pos"))
        at = at.where(F.pmod(F.xxhash64(F.get("w", F.col("pos"))), F.lit(pieces)) == piece) if pieces > 1 else at
        starts = (F.col("own") == k) & (F.col("pos") % F.col("step") == 0) & (F.floor(F.col("pos") / F.col("step")) <= _edits(F.col("n")))
        packed = F.shiftleft(F.col("n").cast("long"), 32).bitwiseOR(F.shiftleft(F.col("pos").cast("long"), 1)).bitwiseOR(starts.cast("long"))
        part = at.select(F.xxhash64(*(F.get("w", F.col("pos") + i) for i in range(k))).alias("run"), "lid", packed.alias("place"))
        out = part if out is None else out.unionByName(part)
    return out


@contextmanager
def _shuffle_files_go(spark: SparkSession) -> Iterator[None]:
    """Each query's shuffle files go when it ends; what later steps need are tables."""
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.unset(_CLEANUP) if before is None else spark.conf.set(_CLEANUP, before)


def _shared_runs(lines: DataFrame) -> DataFrame:
    """(run, lid, n, pos, starts) of the runs that two lines have and one of them shows, in slices by the run's first word:
    most runs of words occur once, and a slice's shuffle files go before the next one is dealt out."""
    of_run, out = Window.partitionBy("run"), None
    for i in range(_SLICES):
        dealt = _runs(lines, i, _SLICES)
        shared = dealt.withColumn("low", F.min("lid").over(of_run)).withColumn("high", F.max("lid").over(of_run)).withColumn("shown", F.max(F.col("place").bitwiseAND(F.lit(1))).over(of_run))
        part = Table(shared.where("low != high and shown = 1").select("run", "lid", "place"), "runs").df
        out = part if out is None else out.unionByName(part)
    n, pos = F.shiftrightunsigned("place", 32).cast("int"), F.shiftrightunsigned("place", 1).bitwiseAND(F.lit((1 << 31) - 1)).cast("int")
    return out.select("run", "lid", n.alias("n"), pos.alias("pos"), (F.col("place").bitwiseAND(F.lit(1)) == 1).alias("starts"))


def _meet(a: str, b: str) -> Column:
    """Whether a line that shows a segment and one that holds it can be near: by length, by the words before and after
    the run, whose differences all take edits, and by the parity of their words. Never false for near lines."""
    x, y = (lambda c: F.col(f"{a}{c}")), (lambda c: F.col(f"{b}{c}"))
    before = x("pos") - y("pos")
    after = (x("n") - y("n")) - before
    return x("starts") & (x("lid") != y("lid")) & (x("n") >= y("n")) & (F.abs(before) + F.abs(after) <= _edits(x("n"))) & (F.bit_count(x("parity").bitwiseXOR(y("parity"))) <= 2 * _edits(x("n")))


def _as_characters(norm: Column) -> Column:
    """A line with one character for each word, of 983,040 by the word's hash: edits of words become edits of
    characters. Two unlike words share a character once in a million."""
    codes = F.transform(F.split(norm, " "), lambda w: F.lpad(F.hex(F.pmod(F.xxhash64(w), F.lit(0xF0000)) + 0x10000), 8, "0"))
    return F.decode(F.unhex(F.array_join(codes, "")), "UTF-32")


def _verified(pairs: DataFrame, lines: DataFrame, name: str) -> Table:
    """Pairs (src, dst, and what else they have) whose lines' edit similarity is high enough. Only lines that occur in a
    pair are fetched."""
    table = Table(pairs, f"{name}-pairs")
    ids = table.df.select(F.col("src").alias("lid")).unionByName(table.df.select(F.col("dst").alias("lid"))).distinct()
    few = ids.count() <= _BROADCAST_IDS
    wanted = lines.select("lid", "norm").join(F.broadcast(ids) if few else ids, "lid", "left_semi")
    coded = Table(wanted.select("lid", _as_characters(F.col("norm")).alias("seq")), f"{name}-lines")
    a = coded.df.select(F.col("lid").alias("src"), F.col("seq").alias("a"))
    b = coded.df.select(F.col("lid").alias("dst"), F.col("seq").alias("b"))
    met = table.df.join(a, "src").join(b, "dst").withColumn("most", _edits(F.greatest(F.length("a"), F.length("b"))))
    out = Table(met.where(F.expr("levenshtein(a, b, most) >= 0")).select(*table.df.columns), name)
    table.drop()
    coded.drop()
    return out


def line_groups(occ: DataFrame) -> DataFrame:
    """(lid, grp) of the distinct lines; grp is the same for the lines of a connected group.

    Lines go by their place in the table of distinct lines, not by hash: neighbours in a shuffle file are alike then, and
    it takes less of the disk.

    Runs that only one line has go at once. Then each line is compared with one line of each of its runs, which closes
    large groups of near copies with linear work. Then the runs that still have lines of more
    than one group are joined, and only pairs of different groups so far are compared: a pair left out joins two lines
    of one group already, so no group is lost and no group's pairs are all emitted."""
    with _shuffle_files_go(occ.sparkSession):
        named = Table(distinct_lines(occ).withColumn("no", F.monotonically_increasing_id()), "distinct-lines").df
        lines = named.drop("lid").withColumnRenamed("no", "lid")
        runs = _shared_runs(lines)
        groups = lines.select("lid", "parity", F.col("lid").alias("grp"))
        for stars in (True, False):
            known = runs.join(groups, "lid")
            row = F.struct("lid", "grp", "n", "pos", "starts", "parity")
            # A head shows a segment itself, and is the longer or the shorter line of the pair.
            mixed = known.groupBy("run").agg(F.min("grp").alias("low"), F.max("grp").alias("high"), F.min(F.when(F.col("starts"), row)).alias("head")).where("low != high and head is not null").select("run", "head")
            if stars:
                both = known.select("run", row.alias("x")).join(mixed, "run").select("x", F.col("head").alias("y"))
                met = both.where((F.col("x.grp") != F.col("y.grp")) & (_meet("x.", "y.") | _meet("y.", "x.")))
            else:
                left = known.select("run", row.alias("x")).join(mixed.select("run"), "run")
                met = left.where("x.starts").join(left.withColumnRenamed("x", "y"), "run").where((F.col("x.grp") != F.col("y.grp")) & _meet("x.", "y."))
            pairs = met.select(F.greatest("x.lid", "y.lid").alias("src"), F.least("x.lid", "y.lid").alias("dst"), F.greatest("x.grp", "y.grp").alias("g1"), F.least("x.grp", "y.grp").alias("g2")).distinct()
            near = _verified(pairs, lines, "line-links")
            merged = components(near.df.select(F.col("g1").alias("src"), F.col("g2").alias("dst"))).withColumnRenamed("node", "grp")
            groups = Table(groups.join(merged, "grp", "left").select("lid", "parity", F.coalesce("component", "grp").alias("grp")), "line-groups").df
        return groups.select(F.col("lid").alias("no"), "grp").join(named.select("no", "lid"), "no").select("lid", "grp")


def dropped_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, h, pos) of the lines that go: all but the first occurrence of each group of equal or near lines, by id (rows
    without one last), hash of the text and position. Rows equal in id and text count once here."""
    occ = Table(occurrences(docs, id_col, text_col), "lines")
    groups = line_groups(occ.df)
    keyed = Table(occ.df.select("id", "h", "pos", "lid").distinct().join(groups, "lid").select(F.struct(F.col("id").isNull().alias("nameless"), "id", "h", "pos").alias("at"), "grp"), "grouped-lines")
    occ.drop()
    first = keyed.df.groupBy("grp").agg(F.min("at").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1")
    gone = Table(keyed.df.join(first, "grp").where(~F.col("at").eqNullSafe(F.col("first"))).select("at.id", "at.h", "at.pos"), "gone-lines")
    keyed.drop()
    return gone.df


def _with_gone(docs: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, str, str]:
    """The documents with two columns more: the places of the lines that go (null if none), and whether the row repeats an
    equal one, of which all lines with a word go. Only rows that repeat are written to tell the first of them."""
    again, gone, h, mark = (free_name(docs.columns, x) for x in ("_rx_again", "_rx_gone", "_rx_text", "_rx_mark"))
    rows = docs.withColumn(h, F.xxhash64(col(text_col).cast("string")))
    own, names = col(id_col).cast("long"), [col(c) for c in (*docs.columns, h)]
    repeated = rows.groupBy(own.alias("_i"), col(h).alias("_t")).count().where("count > 1").select("_i", "_t")
    same = own.eqNullSafe(F.col("_i")) & (col(h) == F.col("_t"))
    if repeated.isEmpty():
        told = rows.withColumn(again, F.lit(False))
    else:
        here = Table(rows.join(repeated, same, "left_semi").select(*names).withColumn(mark, F.monotonically_increasing_id()), "equal-rows").df
        firsts = here.groupBy(own.alias("_i"), col(h).alias("_t")).agg(F.min(mark).alias("_m"))
        later = here.join(firsts, same).select(*names, (col(mark) != F.col("_m")).alias(again))
        told = rows.join(repeated, same, "left_anti").select(*names, F.lit(False).alias(again)).unionByName(later)
    places = dropped_lines(docs, id_col, text_col).groupBy(F.col("id").alias("_i"), F.col("h").alias("_t")).agg(F.array_sort(F.collect_list("pos")).alias("_p"))
    return told.join(places, same, "left").select(*(col(c) for c in docs.columns), F.col("_p").alias(gone), col(again)), gone, again


def _lines_that_go(text: Column, gone: str, again: str) -> Column:
    worded = F.filter(F.transform(_normalised_lines(text), lambda x, i: F.when(F.trim(x) != "", i)), lambda i: i.isNotNull())
    return F.coalesce(F.when(col(again), worded).otherwise(col(gone)), F.array().cast("array<int>"))


def line_report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_lines, n_kept, dropped) of every document; ``dropped`` lists the places from 0 of the lines that go.

    Lines of marks and spaces only always stay and are like no line. A null text has no lines, an empty one has one.
    Rows are told apart by id and text: different texts under one id are documents of their own, of equal rows all
    lines with a word go but in one. Rows without an id come last. An empty table gives no rows; other columns play no
    part."""
    text = col(text_col).cast("string")
    narrow = docs.select(col(id_col).cast("long").alias("id"), text.alias("text"))
    rows, gone, again = _with_gone(narrow, "id", "text")
    told = rows.select("id", F.greatest(F.size(F.split("text", "\n", -1)), F.lit(0)).cast("long").alias("n_lines"), _lines_that_go(F.col("text"), gone, again).alias("gone"))
    return told.select("id", "n_lines", (F.col("n_lines") - F.size("gone")).alias("n_kept"), F.array_join(F.col("gone").cast("array<string>"), ",").alias("dropped"))


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents with the lines that go (see ``line_report``) taken out of their texts; null texts stay null, a text
    of which all lines go becomes empty, other columns stay as they were."""
    rows, gone, again = _with_gone(docs, id_col, text_col)
    text = col(text_col).cast("string")
    lines = F.split(text, "\n", -1)
    some = col(again) | col(gone).isNotNull()
    # Places in the order of the text; a map gives each line's in one step.
    out = F.map_from_entries(F.transform(_lines_that_go(text, gone, again), lambda i: F.struct(i.alias("k"), F.lit(True).alias("v"))))
    kept = F.array_join(F.filter(lines, lambda x, i: ~F.map_contains_key(out, i)), "\n")
    return rows.select(*(F.when(some & text.isNotNull(), kept).otherwise(col(c)).alias(c) if c == text_col else col(c) for c in docs.columns))
