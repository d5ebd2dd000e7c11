"""Removal of repeated passages by hashing normalised units.

A passage counts as repeated if ``RUN_WORDS`` words of it, in a row, stand in an earlier document too. Words are runs
of other than ASCII white space, with A-Z lower-cased. A unit is the paragraph of half as many words (``RUN_WORDS`` / 2)
that follows a cut. Texts are cut after sentences: of all words in every stretch of half of ``RUN_WORDS`` words, the
last one of least rank ends a paragraph, where words that end a sentence rank before others, and else their hash
decides. So equal passages are cut alike wherever they were pasted and however their lines are wrapped, and any
``RUN_WORDS`` words hold a unit that is the same in every document.

1. Units are digested and grouped globally; those of two documents or more keep their places. The occurrence of the
   lowest rank (document id, then row, then place) is the first.
2. Units that repeat the same first document at the same distance and overlap are joined; what reaches ``RUN_WORDS``
   words is a repeated passage of that document.
3. Shorter ones may be part of a longer passage of any other earlier document, and longer ones may go on for some words
   beyond their first and last unit: the windows of ``RUN_WORDS`` words around all occurrences of such units are
   grouped in the same way, so every occurrence takes part, without pairs. This finds all repeated passages in full.

A unit or window that stands in one document again and again, overlapping or touching itself (one word all along), is
one row with its whole range.

All digests of a run of texts come from two polynomial prefix sums over its words' hashes. Groups are aggregated
map-side, so a passage in a third of all documents is one row for each task, and its occurrences are joined with their
first place by a shuffle that adaptive execution splits. Removed spans keep their offsets in the original text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from rollgrid.llm.common import broadcast_if_small, read, row_keys, small, stored

RUN_WORDS = 50
#: Digests of eight bytes that are broadcast at most.
DIGESTS = 1_500_000
#: Bytes of text that are digested at once; a longer text is taken alone.
RUN = 1 << 21
#: Bytes whose powers are held at once.
CHUNK = 1 << 20

BLANK = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])
FOLD = np.arange(256, dtype=np.uint64) + np.uint64(1)
FOLD[65:91] += np.uint64(32)
FOLD[BLANK] = 0
ENDS = np.isin(np.arange(256), [ord(c) for c in ".!?"])
#: Odd bases of the polynomials over bytes and over words.
BYTES, WORDS = 0x9E3779B97F4A7C15, (0xD6E8FEB86659FD93, 0xA0761D6478BD642F)
UNITS = "doc_id {kind}, k1 long, k2 long, at int, last int, start int, stop int, h1 long, h2 long"
NAMES = ["doc_id", "k1", "k2", "at", "last", "start", "stop", "h1", "h2"]

_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first ``n`` powers of an odd base and of its inverse, modulo 2**64."""
    if base not in _powers or len(_powers[base][0]) < n:
        size = max(n, 1 << 12)
        both = []
        for b in (base, pow(base, -1, 1 << 64)):
            row = np.full(size, b, np.uint64)
            row[0] = 1
            both.append(np.cumprod(row, dtype=np.uint64))
        if size > CHUNK + 1:
            return both[0], both[1]
        _powers[base] = both[0], both[1]
    return _powers[base]


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


class Words:
    """The words of some texts: their places, hashes, and the digests of any of their sequences."""

    def __init__(self, texts: list[bytes]):
        self.data = np.frombuffer(b"\n".join([*texts, b""]), np.uint8)
        sizes = np.array([len(t) + 1 for t in texts], np.int64)
        self.begins = np.cumsum(sizes) - sizes
        blank = BLANK[self.data]
        edge = blank[1:] != blank[:-1]
        first = np.flatnonzero(edge & blank[:-1]) + 1
        if len(blank) and not blank[0]:
            first = np.concatenate([[0], first])
        self.starts, self.stops = first, np.flatnonzero(edge & blank[1:]) + 1
        #: Number of the first word of each text, and of all words.
        self.bounds = np.append(np.searchsorted(self.starts, self.begins), len(first))
        self.hashes = self._hashes()
        self.sums = []
        for base in WORDS:
            power, inverse = powers(base, len(first) + 1)
            total = np.zeros(len(first) + 1, np.uint64)
            np.cumsum(self.hashes * power[: len(first)], out=total[1:])
            self.sums.append((total, inverse))
        self.characters = np.concatenate([[0], np.cumsum((self.data & 0xC0) != 0x80, dtype=np.int64)])

    def _hashes(self) -> np.ndarray:
        out = np.empty(len(self.starts), np.uint64)
        at = 0
        while at < len(self.starts):
            low = self.starts[at]
            end = max(at + 1, int(np.searchsorted(self.stops, low + CHUNK, side="right")))
            high = self.stops[end - 1]
            power, inverse = powers(BYTES, int(high - low))
            local = self.starts[at:end] - low
            out[at:end] = np.add.reduceat(FOLD[self.data[low:high]] * power[: high - low], local) * inverse[local]
            at = end
        return mixed(out)

    def digests(self, at: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
        """Two 64-bit digests of the ``size`` words from each word of ``at`` on."""
        return tuple(mixed((total[at + size] - total[at]) * inverse[at]).view(np.int64) for total, inverse in self.sums)

    def cuts(self, stretch: int) -> np.ndarray:
        """Numbers of the words that follow a cut: of every ``stretch`` words, the last one of least rank is cut off."""
        n = len(self.starts)
        if n < stretch:
            return np.zeros(0, np.int64)
        rank = self.hashes >> np.uint64(1)
        rank[~ENDS[self.data[self.stops - 1]]] |= np.uint64(1 << 63)
        least = np.lib.stride_tricks.sliding_window_view(rank[::-1], stretch).argmin(axis=1)
        cut = np.zeros(n, bool)
        cut[n - 1 - np.arange(len(least)) - least] = True
        return np.flatnonzero(cut) + 1


def runs_of(texts: list[bytes], size: int = RUN) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about ``size`` bytes."""
    low, held = 0, 0
    for i, text in enumerate(texts):
        if held and held + len(text) > size:
            yield low, i
            low, held = i, 0
        held += len(text)
    if low < len(texts):
        yield low, len(texts)


def units(words: Words, run_words: int = RUN_WORDS) -> tuple[np.ndarray, np.ndarray]:
    """(text, first word) of every unit: the paragraphs of half the words that follow a cut.

    The first run_words - size words of any ``run_words`` words are cut somewhere, and a unit fits in behind. The
    paragraphs at both ends of a text are units too, so that copies agree from end to end.
    """
    size = -(-run_words // 2)
    cut = words.cuts(run_words - size)
    whole = np.flatnonzero(np.diff(words.bounds) >= run_words)
    text = np.concatenate([np.searchsorted(words.bounds, cut - 1, side="right") - 1, whole, whole])
    at = np.concatenate([cut, words.bounds[whole], words.bounds[whole + 1] - size])
    fit = (at + size <= words.bounds[text + 1]) & (np.diff(words.bounds)[text] >= run_words)
    both = np.unique(np.stack([at[fit], text[fit]], axis=1), axis=0)  # a word has one text
    return both[:, 1], both[:, 0]


def ranges(words: Words, text: np.ndarray, at: np.ndarray, size: int) -> tuple[np.ndarray, ...]:
    """(text, first, last, digests) of sequences of ``size`` words: those that are equal and overlap or touch in one."""
    h1, h2 = words.digests(at, size)
    order = np.lexsort((at, h2, h1, text))
    text, at, h1, h2 = text[order], at[order], h1[order], h2[order]
    new = np.ones(len(at), bool)
    new[1:] = (text[1:] != text[:-1]) | (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1]) | (at[1:] > at[:-1] + size)
    begin = np.flatnonzero(new)
    end = np.append(begin[1:], len(at)) - 1
    order = np.argsort(at[begin], kind="stable")
    begin, end = begin[order], end[order[: len(begin)]]
    return text[begin], at[begin], at[end], h1[begin], h2[begin]


def table_of(words: Words, text: np.ndarray, at: np.ndarray, size: int, ids: list[pa.Array]) -> pa.RecordBatch:
    """A row for each range of sequences of ``size`` words: the columns ``ids`` of its text, its places, code points
    and digests."""
    text, first, last, h1, h2 = ranges(words, text, at, size)
    zero, owners = words.characters[words.begins[text]], pa.array(text)
    start, stop = words.characters[words.starts[first]] - zero, words.characters[words.stops[last + size - 1]] - zero
    numbers = [first - words.bounds[text], last - words.bounds[text], start, stop]
    return pa.RecordBatch.from_arrays([*(c.take(owners) for c in ids), *(pa.array(x.astype(np.int32)) for x in numbers), pa.array(h1), pa.array(h2)], NAMES)


def encoded(column: pa.Array) -> list[bytes]:
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def unit_table(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", run_words: int = RUN_WORDS) -> DataFrame:
    """One row for each unit of each document: doc_id, row keys, first word, code points, digests; not its text."""
    k1, k2 = row_keys(F.col(id_col), F.col(text_col))
    kind = docs.schema[id_col].dataType.simpleString()
    size = -(-run_words // 2)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = encoded(batch.column(3))
            for low, high in runs_of(texts):
                words = Words(texts[low:high])
                yield table_of(words, *units(words, run_words), size, [batch.column(n).slice(low, high - low) for n in range(3)])

    source = docs.select(F.col(id_col).alias("doc_id"), k1, k2, F.col(text_col).alias("text")).where(F.length("text") >= 2 * run_words - 1)
    return source.mapInArrow(cut, UNITS.format(kind=kind))


def marked(words: Words, ranges: pa.ListArray, before: int, after: int) -> np.ndarray:
    """The words from ``before`` words before the first field of each range of each text on to ``after`` its last."""
    text = np.repeat(np.arange(len(ranges)), pc.list_value_length(ranges).to_numpy(zero_copy_only=False))
    flat = ranges.flatten()
    first, last = (flat.field(n).to_numpy(zero_copy_only=False).astype(np.int64) for n in range(2))
    first = np.maximum(first - before, 0) + words.bounds[text]
    last = np.minimum(last + after + words.bounds[text], words.bounds[text + 1] - 1)
    change = np.zeros(len(words.starts) + 1, np.int32)
    some = first <= last
    np.add.at(change, first[some], 1)
    np.add.at(change, last[some] + 1, -1)
    return np.cumsum(change[:-1]) > 0


def windows(docs: DataFrame, places: DataFrame, known: DataFrame, run_words: int, id_col: str, text_col: str) -> DataFrame:
    """A row for each window of ``run_words`` words that holds one of the units ``places`` (k1, k2, at, last).

    Windows inside the passages ``known`` (k1, k2, known) are left out: an earlier document holds them, so this one is
    never their first.
    """
    k1, k2 = row_keys(F.col(id_col), F.col(text_col))
    each = places.groupBy("k1", "k2").agg(F.collect_set(F.struct("at", "last")).alias("places")).join(known, ["k1", "k2"], "left")
    each = stored(each.withColumn("known", F.coalesce("known", F.array().cast("array<struct<at:int,end:int>>"))), "unit-places")
    source = docs.select(F.col(id_col).alias("doc_id"), k1, k2, F.col(text_col).alias("text"))
    kind = docs.schema[id_col].dataType.simpleString()
    size = -(-run_words // 2)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = encoded(batch.column(3))
            for low, high in runs_of(texts):
                words = Words(texts[low:high])
                ids, sought, found = batch.columns[:3], batch.column(4).slice(low, high - low), batch.column(5).slice(low, high - low)
                at = np.flatnonzero(marked(words, sought, run_words - size, 0) & ~marked(words, found, 0, -run_words))
                text = np.searchsorted(words.bounds, at, side="right") - 1
                fit = at + run_words <= words.bounds[text + 1]
                yield table_of(words, text[fit], at[fit], run_words, [c.slice(low, high - low) for c in ids])

    joined = source.join(each.hint("merge"), ["k1", "k2"])
    return joined.select("doc_id", "k1", "k2", "text", "places", "known").mapInArrow(cut, UNITS.format(kind=kind))


def repeats(table: DataFrame) -> DataFrame:
    """The rows of ``table`` whose digest stands in two documents, with its first place: a column first, null for the
    first document's own rows."""
    shared = table.groupBy("h1").agg(F.min("k1").alias("low"), F.max("k1").alias("high")).where("low <> high").select("h1")
    shared = stored(shared, "digests-shared")
    again = table.join(F.broadcast(shared), "h1", "left_semi") if small(shared, DIGESTS) else stored(table.join(shared, "h1", "left_semi"), "digests-again")
    place = F.struct("doc_id", "k1", "k2", "at")
    firsts = again.groupBy("h1", "h2").agg(F.min(place).alias("first"))
    own = (F.col("k1") == F.col("first.k1")) & (F.col("k2") == F.col("first.k2"))
    met = again.join(stored(firsts, "digests-first").hint("merge"), ["h1", "h2"])
    return stored(met.withColumn("first", F.when(~own, F.col("first"))), "digests-met")


def islands(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Rows (at, end, ...) with a number ``island`` for those of equal keys that overlap or touch."""
    order = W.partitionBy(*keys).orderBy("at", "end")
    reach = F.max("end").over(order.rowsBetween(W.unboundedPreceding, -1))
    return rows.withColumn("new", (reach.isNull() | (F.col("at") > reach)).cast("int")).withColumn("island", F.sum("new").over(order.rowsBetween(W.unboundedPreceding, 0))).drop("new")


def repeated_spans(docs: DataFrame, run_words: int = RUN_WORDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The spans to remove: doc_id, start, stop (code points), n_words, first_doc_id, k1, k2.

    A span is made of all overlapping or touching windows of ``run_words`` words that earlier documents hold as well;
    first_doc_id is the earliest of these. Null, empty and short texts have no units. Equal rows count as one document, so they do not repeat each other; what stands
    twice inside one document alone stays. A null id ranks first. An empty table gives none; other columns take no part.
    """
    size = -(-run_words // 2)
    found = repeats(stored(unit_table(docs, id_col, text_col, run_words), "units"))
    met = found.where("first is not null").withColumns({"end": F.col("last") + size, "e1": F.col("first.k1"), "e2": F.col("first.k2"), "shift": F.col("at") - F.col("first.at"), "first_doc_id": F.col("first.doc_id")})
    keys = ["k1", "k2", "e1", "e2", "shift"]
    columns = [F.first("doc_id").alias("doc_id"), F.min("at").alias("at"), F.max("end").alias("end"), F.min("start").alias("start"), F.max("stop").alias("stop"), F.min("first_doc_id").alias("first_doc_id")]
    edges = [F.min_by("h1", "at").alias("head"), F.max_by("h1", "at").alias("tail")]
    # what stands in a document again and again has no one distance from its first place
    single = islands(met.where("at = last"), keys).groupBy(*keys, "island").agg(*columns, *edges, F.collect_set("h1").alias("digests"))
    single = stored(single.withColumn("digests", F.when(F.col("end") - F.col("at") < run_words, F.col("digests"))), "unit-islands")
    whole = single.where("digests is null")
    # of parts that lie in no whole passage, and of the ends of these, all places are looked at again
    known = whole.groupBy("k1", "k2").agg(F.collect_list(F.struct("at", "end")).alias("known"))
    part = single.where("digests is not null").join(known, ["k1", "k2"], "left")
    inside = F.exists("known", lambda x: (x["at"] <= F.col("at")) & (F.col("end") <= x["end"]))
    part = part.where(~F.coalesce(inside, F.lit(False))).select(F.explode("digests").alias("h1"))
    open_ = part.unionByName(whole.select(F.explode(F.array("head", "tail")).alias("h1"))).unionByName(met.where("at < last").select("h1")).distinct()
    places = found.select("k1", "k2", "at", "last", "h1").join(broadcast_if_small(stored(open_, "digests-open"), DIGESTS), "h1", "left_semi")
    others = repeats(stored(windows(docs, places, known, run_words, id_col, text_col), "unit-windows")).where("first is not null")
    others = others.select("k1", "k2", "doc_id", "at", (F.col("last") + run_words).alias("end"), "start", "stop", F.col("first.doc_id").alias("first_doc_id"))

    both = islands(whole.select(*others.columns).unionByName(others), ["k1", "k2"]).groupBy("k1", "k2", "island").agg(*columns)
    return both.select("doc_id", "start", "stop", (F.col("end") - F.col("at")).alias("n_words"), "first_doc_id", "k1", "k2")


def dedup_passages(docs: DataFrame, run_words: int = RUN_WORDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` without the repeated spans, and a column removed_spans: array of (start, stop) in the original text."""
    spans = repeated_spans(docs, run_words, id_col, text_col)
    k1, k2 = row_keys(F.col(id_col), F.col(text_col))
    each = spans.groupBy("k1", "k2").agg(F.array_sort(F.collect_list(F.struct("start", "stop"))).alias("spans"))
    columns = [c for c in docs.columns if c != "removed_spans"]
    rows = docs.select(F.struct(*columns).alias("row"), k1, k2).join(each, ["k1", "k2"], "left")
    text, cuts = F.col("row")[text_col], F.col("spans")
    n = F.size(cuts)
    # what stands between the end of one span and the start of the next
    begin = lambda i: F.when(i == 0, F.lit(0)).otherwise(F.get(cuts, i - 1)["stop"])
    end = lambda i: F.when(i == n, F.length(text)).otherwise(F.get(cuts, i)["start"])
    pieces = F.transform(F.sequence(F.lit(0), n), lambda i: F.substring(text, begin(i) + 1, end(i) - begin(i)))
    new = F.when(cuts.isNull(), text).otherwise(F.array_join(pieces, ""))
    removed = F.coalesce(cuts, F.array().cast("array<struct<start:int,stop:int>>")).alias("removed_spans")
    return rows.select(*[(new if c == text_col else F.col("row")[c]).alias(c) for c in columns], removed)


def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_spans(read(spark, sf_dir, "documents").select("doc_id", "text")).drop("k1", "k2")


def repeated_spans_sql(docs: str, run_words: int = RUN_WORDS) -> str:
    """DuckDB SQL over all windows of all texts, for small tables with distinct ids."""
    return rf"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w,
         string_split_regex(text, '[^\x20\x09-\x0D]+') AS blanks FROM {docs} WHERE text IS NOT NULL),
words AS (SELECT doc_id, unnest(range(1, len(w) + 1)) AS i, unnest(w) AS word, unnest(blanks[:len(w)]) AS b FROM d),
places AS (SELECT doc_id, i, sum(length(b) + length(word)) OVER (PARTITION BY doc_id ORDER BY i) AS stop, length(word) AS n FROM words),
same AS (
  SELECT doc_id, i, md5(p) AS p FROM (SELECT doc_id, i, string_agg(word, ' ') OVER ahead AS p, count(*) OVER ahead AS n FROM words
    WINDOW ahead AS (PARTITION BY doc_id ORDER BY i ROWS BETWEEN CURRENT ROW AND {run_words - 1} FOLLOWING)) WHERE n = {run_words}),
firsts AS (SELECT p, min(doc_id) AS first_doc_id FROM same GROUP BY p HAVING min(doc_id) <> max(doc_id)),
again AS (SELECT doc_id, i, first_doc_id FROM same JOIN firsts USING (p) WHERE doc_id <> first_doc_id),
marked AS (SELECT *, CASE WHEN i - lag(i) OVER (PARTITION BY doc_id ORDER BY i) <= {run_words} THEN 0 ELSE 1 END AS new FROM again),
numbered AS (SELECT *, sum(new) OVER (PARTITION BY doc_id ORDER BY i) AS island FROM marked),
spans AS (SELECT doc_id, min(i) AS low, max(i) + {run_words - 1} AS high, min(first_doc_id) AS first_doc_id FROM numbered GROUP BY doc_id, island)
SELECT s.doc_id, (a.stop - a.n)::INT AS start, b.stop::INT AS stop, (high - low + 1)::INT AS n_words, first_doc_id
FROM spans s JOIN places a ON a.doc_id = s.doc_id AND a.i = low JOIN places b ON b.doc_id = s.doc_id AND b.i = high
"""


OP10_SQL = repeated_spans_sql("documents")
