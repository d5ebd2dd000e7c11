"""Best-fit packing by patterns of lengths that non-negative least squares fits to the histogram.

Texts become token ids and an end token; those longer than a sequence are cut, the remainder first. What is packed is
the histogram of piece lengths, which has ``capacity`` entries whatever the corpus: patterns of one to three lengths that
fill a sequence to a ``WASTE``-th are enumerated, their repeat counts are fitted to the histogram by
non-negative least squares (projected gradient with momentum over the sparse columns), rounded as far as the histogram
holds them, and what is left is packed by best fit, longest first, again by length and count: sequences of like
contents stay together with the number of times they are repeated.

The plan is a table of slots: so many pieces of a length, from such a rank on, go to such sequences at such an offset. It
has fewer than 64 slots for each pattern (distinct lengths that add up to a sequence), and is sent to the tasks. Pieces are
ranked within their length by counted buckets, so that no task sees a whole length, and each finds its slot by bisection.
"""

from __future__ import annotations

import itertools
import json
import os
import re
import unicodedata
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from rollgrid.llm.common import broadcast_if_small, read, stored
from rollgrid.llm.token_counts import vocabulary_path

VOCABULARY = "byte_bpe_50k.json"
CAPACITY = 2048
END = 0
#: A fitted pattern may leave one token of so many empty.
WASTE = 256
#: Rounds of the fit, and the weight that the shortest lengths have in it: short pieces are wanted for the gaps later.
ROUNDS, LIGHTEST = 200, 0.1
#: Fractions from which on fitted counts are rounded up: of these the one that gives the fewest sequences is used, of equal
#: ones the one that leaves the least to best fit.
UP_FROM = (0.5, 0.25, 0.1)
#: Pieces in a bucket, about.
BUCKET = 100_000
#: Characters of texts that go to the tokenizer at once.
CHARACTERS = 1 << 20

#: Code points that the word splitter below decides; texts with others are left to the library whole.
KNOWN = [chr(c) for c in range(0x250) if not 0x1C <= c <= 0x1F]
BLANK = " \t\n\x0b\x0c\r\x85\xa0"
#: Characters of the words that a worker remembers; beyond them it starts anew.
REMEMBERED = 6_000_000
#: Words that the library gets at once.
TOGETHER = 512


def word_pattern() -> re.Pattern:
    """The splitter of byte-level vocabularies over ``KNOWN`` characters: contractions, letters, digits, other marks (each
    with a space before them) and white space, of which the last blank goes with the next word."""
    kind = lambda first: "".join(re.escape(c) for c in KNOWN if unicodedata.category(c)[0] == first)
    letter, digit, blank = kind("L"), kind("N"), re.escape(BLANK)
    return re.compile(f"'(?:[stmd]|re|ve|ll)| ?[{letter}]+| ?[{digit}]+| ?[^{blank}{letter}{digit}]+|[{blank}]+(?![^{blank}])|[{blank}]+")


class Ids:
    """Token ids of whole texts as the library gives them, as little-endian unsigned 32-bit bytes.

    Byte-level vocabularies encode each word of their splitter by itself. So texts of known characters are split here,
    words are encoded by the library once, and remembered. Texts with special strings or other characters, and
    vocabularies that are prepared in another way, go through the library as they are.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # Spark runs the tasks in parallel
        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        made = json.loads(self.library.to_str())
        split = made["pre_tokenizer"] or {}
        self.by_word = made["normalizer"] is None and made["model"]["type"] == "BPE" and not made["model"].get("dropout") and (split.get("type"), split.get("add_prefix_space"), split.get("use_regex")) == ("ByteLevel", False, True)
        special = [re.escape(x["content"]) for x in made["added_tokens"]]
        known = "".join(re.escape(c) for c in KNOWN)
        self.other, self.pattern = re.compile("|".join([f"[^{known}]", *special])), word_pattern()
        self.words: dict[str, bytes] = {}
        self.held = 0  # characters of these words

    def _learn(self, words: list[str]) -> None:
        for low in range(0, len(words), TOGETHER):
            some = words[low : low + TOGETHER]
            made = self.library.encode(some, is_pretokenized=True, add_special_tokens=False)
            raw = np.array(made.ids, "<u4").tobytes()
            ends = (4 * np.searchsorted(made.word_ids, np.arange(len(some) + 1))).tolist()
            self.words.update(zip(some, [raw[start:stop] for start, stop in zip(ends, ends[1:])]))
        self.held += sum(map(len, words))

    def of(self, texts: list[str]) -> Iterator[bytes]:
        if self.held > REMEMBERED:
            self.words, self.held = {}, 0
        split = [self.pattern.findall(text) if self.by_word and not self.other.search(text) else None for text in texts]
        self._learn(list(set(itertools.chain.from_iterable(x for x in split if x)).difference(self.words)))
        whole = iter(self.library.encode_batch([t for t, x in zip(texts, split) if x is None], add_special_tokens=False))
        of_word = self.words.__getitem__
        for words in split:
            yield np.array(next(whole).ids, "<u4").tobytes() if words is None else b"".join(map(of_word, words))


_ids: dict[str, Ids] = {}


def token_ids(path: str, texts: Iterable[str], end: int) -> Iterator[bytes]:
    """The ids of each text and the end token; few texts are held at a time, the vocabulary is read once in each worker."""
    if path not in _ids:
        _ids[path] = Ids(path)
    last, held, size = np.array([end], "<u4").tobytes(), [], 0
    for text in itertools.chain(texts, [None]):
        if held and (text is None or size + len(text) > CHARACTERS):
            yield from (found + last for found in _ids[path].of(held))
            held, size = [], 0
        if text is not None:
            held.append(text)
            size += len(text)


def cuts(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of ``n`` ids: the remainder first, then whole sequences."""
    first = n % capacity or min(n, capacity)
    return [(0, first), *((at, capacity) for at in range(first, n, capacity))]


def pieces(docs: DataFrame, capacity: int = CAPACITY, vocabulary: str = VOCABULARY, end: int = END, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 and, if asked for, ids (array<int>): at least one piece for each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        path = vocabulary_path(vocabulary)
        for batch in batches:
            rows: list[list] = [[], [], [], [], [], []]
            for row, ids in enumerate(token_ids(path, (x.as_py() for x in batch.column(1)), end)):
                for piece, (start, length) in enumerate(cuts(len(ids) // 4, capacity)):
                    own = ids[4 * start : 4 * (start + length)]
                    for column, value in zip(rows, (row, piece, start, length, zlib.crc32(own), np.frombuffer(own, "<u4").astype(np.int32) if with_ids else None)):
                        column.append(value)
            at = pa.array(rows[0], pa.int64())
            kinds = [pa.int32(), pa.int64(), pa.int64(), pa.int64()]
            columns = [batch.column(0).take(at), *(pa.array(v, t) for v, t in zip(rows[1:5], kinds)), *([pa.array(rows[5], pa.list_(pa.int32()))] if with_ids else [])]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "piece", "start", "length", "ids_crc32", *["ids"] * with_ids])

    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return rows.mapInArrow(run, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * with_ids)


def patterns(histogram: np.ndarray, capacity: int = CAPACITY, waste: int | None = None) -> np.ndarray:
    """Rows of three lengths, longest first and 0 for none, that the histogram has and that fill all but ``waste`` tokens
    (by default one of ``WASTE``):
    single lengths, and for each pair the longest third that fits and is no longer than its shorter one."""
    waste = capacity // WASTE if waste is None else waste
    present = np.flatnonzero(histogram)
    present = present[present > 0]
    if not len(present):
        return np.zeros((0, 3), np.int64)
    at_most = np.zeros(capacity + 1, np.int64)  # the longest length present up to each length
    at_most[present] = present
    at_most = np.maximum.accumulate(at_most)
    singles = present[present >= capacity - waste]
    out = [np.stack([singles, 0 * singles, 0 * singles], axis=1)]
    for a in present[3 * present >= capacity - waste].tolist():
        b = present[(present <= a) & (present <= capacity - a) & (2 * present >= capacity - waste - a)]
        third = at_most[np.minimum(b, capacity - a - b)]
        good = a + b + third >= capacity - waste
        out.append(np.stack([np.full(good.sum(), a), b[good], third[good]], axis=1))
    return np.concatenate(out)


def fitted(found: np.ndarray, histogram: np.ndarray, rounds: int = ROUNDS) -> np.ndarray:
    """Repeat counts x >= 0 of patterns that make the weighted squared difference from the histogram small.

    Lengths weigh in proportion to their size, from ``LIGHTEST`` on: a missing long piece costs a sequence of its own.
    """
    if not len(found):
        return np.zeros(0)
    size = len(histogram)
    weight = np.maximum(LIGHTEST, np.arange(size) / (size - 1))
    weight[0] = 0  # where a pattern has no second or third length
    scale = float(histogram.max()) or 1.0
    wanted = histogram / scale
    flat = found.ravel()
    uses = lambda x: np.bincount(flat, np.repeat(x, 3), size)
    back = lambda r: (weight * r)[found].sum(1)
    probe = np.ones(len(found))
    for _ in range(20):  # the largest eigenvalue bounds the step
        probe = back(uses(probe))
        probe /= np.linalg.norm(probe)
    step = 1 / (1.05 * np.linalg.norm(back(uses(probe))))
    x = y = np.zeros(len(found))
    momentum = 1.0
    for _ in range(rounds):
        following = np.maximum(0, y - step * back(uses(y) - wanted))
        after = (1 + np.sqrt(1 + 4 * momentum * momentum)) / 2
        y, x, momentum = following + (momentum - 1) / after * (following - x), following, after
    return x * scale


def rounded(found: np.ndarray, counts: np.ndarray, histogram: np.ndarray, up_from: float = 0.5) -> tuple[list[tuple[int, list[tuple[int, int]]]], np.ndarray]:
    """Whole repeats (times, [(length, pieces)]) of the fitted counts, largest first and as far as the histogram lasts; and
    the rest of it."""
    left, out = histogram.tolist(), []
    whole = np.floor(counts + 1 - up_from).astype(np.int64)
    for p in np.argsort(-counts, kind="stable")[: int((whole > 0).sum())].tolist():
        lengths = [x for x in found[p].tolist() if x]
        contents = [(x, lengths.count(x)) for x in dict.fromkeys(lengths)]
        n = min(int(whole[p]), *(left[x] // m for x, m in contents))
        if n > 0:
            for x, m in contents:
                left[x] -= n * m
            out.append((n, contents))
    return out, np.array(left)


def best_fit(left: np.ndarray, capacity: int = CAPACITY) -> list[tuple[int, list[tuple[int, int]]]]:
    """Groups of like sequences, (repeats, [(length, pieces in each)]), of a histogram: longest pieces first, each into
    the fullest sequences that still take it. A step uses up a length or all sequences of a group."""
    open_: dict[int, list[list]] = {}  # by free tokens: groups
    frees = np.zeros(capacity + 1, bool)
    for length in np.flatnonzero(left)[::-1].tolist():
        n = int(left[length])
        while n:
            above = frees[length:].argmax()
            free = length + int(above) if frees[length:].any() else 0
            if not free:
                each = min(capacity // length, n)
                group, free = [n // each, []], capacity
            else:
                group = open_[free].pop()
                if not open_[free]:
                    frees[free] = False
                each = min(free // length, n)
            bins = min(group[0], n // each)
            if bins < group[0] and free < capacity:  # the others stay as they are
                open_.setdefault(free, []).append([group[0] - bins, group[1]])
                frees[free] = True
            rest = free - each * length
            open_.setdefault(rest, []).append([bins, [*group[1], (length, each)]])
            frees[rest] = True
            n -= bins * each
    return [(times, contents) for _, groups in sorted(open_.items()) for times, contents in groups]


def plan(histogram: np.ndarray, capacity: int = CAPACITY) -> list[tuple[int, list[tuple[int, int]]]]:
    """(repeats, [(length, pieces in each)]) of sequences that hold the whole histogram (entry n: pieces of length n)."""
    found = patterns(histogram, capacity)
    counts = fitted(found, histogram)
    tried = []
    for up_from in UP_FROM:
        whole, left = rounded(found, counts, histogram, up_from)
        rest = best_fit(left, capacity)
        tried.append((sum(n for n, _ in whole + rest), sum(n for n, _ in rest), up_from, whole + rest))
    return min(tried)[3]


def slots(groups: list[tuple[int, list[tuple[int, int]]]]) -> dict[str, np.ndarray]:
    """The plan as columns in the order of (length, rank): the pieces of ``length`` from ``rank`` on go, ``each`` to a
    sequence, to the sequences from ``sequence`` on, from ``offset`` on."""
    rows, used, sequence = [], {}, 0
    for times, contents in groups:
        offset = 0
        for length, each in contents:
            rank = used.get(length, 0)
            rows.append((length, rank, each, sequence, offset))
            used[length] = rank + times * each
            offset += length * each
        sequence += times
    table = np.array(sorted(rows), np.int64).reshape(-1, 5)
    return dict(zip(("length", "rank", "each", "sequence", "offset"), table.T))


def ranked(found: DataFrame) -> DataFrame:
    """``found`` with rank, from 0, within each length: buckets by a hash are counted, their counts are prefix-summed in
    each length, and rows are numbered inside their bucket, by the hash."""
    n = found.count()
    place = F.xxhash64("doc_id", "piece", "ids_crc32")
    each = found.withColumn("_place", place).withColumn("_bucket", F.pmod("_place", F.lit(max(1, n // BUCKET))))
    counted = each.groupBy("length", "_bucket").agg(F.count(F.lit(1)).alias("_n"))
    base = F.sum("_n").over(W.partitionBy("length").orderBy("_bucket")) - F.col("_n")
    inside = F.row_number().over(W.partitionBy("length", "_bucket").orderBy("_place", "doc_id", "piece"))
    bases = stored(counted.select("length", "_bucket", base.alias("_base")), "length-buckets")
    each = each.withColumn("_inside", inside).join(broadcast_if_small(bases), ["length", "_bucket"])
    return each.withColumn("rank", F.col("_base") + F.col("_inside") - 1).drop("_place", "_bucket", "_inside", "_base")


def packed(docs: DataFrame, capacity: int = CAPACITY, vocabulary: str = VOCABULARY, end: int = END, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """Per piece doc_id, piece, start, length, ids_crc32, sequence_id, offset (and ids if asked for).

    A null text is an empty one: its only token is the end token. Texts of any length are tokenized whole. Rows that
    repeat, and rows of one or of a null id, each have their pieces; equal rows may change places among themselves. An
    empty table gives an empty table; other columns take no part. Lengths and sequences that are equal are told apart by
    hashes, so reruns agree. Rows that are equal in all (id, piece and tokens) stand in one bucket, whose size they bound
    from below.
    """
    spark = docs.sparkSession
    found = stored(pieces(docs, capacity, vocabulary, end, id_col, text_col, with_ids), "pieces")
    histogram = np.zeros(capacity + 1, np.int64)
    for length, n in found.groupBy("length").count().collect():  # ``capacity`` rows at most
        histogram[length] = n
    table = spark.sparkContext.broadcast(slots(plan(histogram, capacity)))
    order = [f.name for f in found.schema]

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = table.value
        span = int(histogram.max()) + 1  # lengths and ranks as one number, in their order
        keys = t["length"] * span + t["rank"]
        for batch in batches:
            length, rank = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("length", "rank"))
            at = np.searchsorted(keys, length * span + rank, side="right") - 1
            inside = rank - t["rank"][at]
            sequence, offset = t["sequence"][at] + inside // t["each"][at], t["offset"][at] + inside % t["each"][at] * length
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in order), pa.array(sequence), pa.array(offset)], [*order, "sequence_id", "offset"])

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in found.schema)
    return ranked(found).select(*order, "rank").mapInArrow(place, f"{schema}, sequence_id long, offset long")


def sequences(found: DataFrame) -> DataFrame:
    """sequence_id, n_tokens, ids and the doc_ids in their order, of packed pieces with ids: ``capacity`` tokens at most."""
    rows = F.sort_array(F.collect_list(F.struct("offset", "doc_id", "ids")))
    each = found.groupBy("sequence_id").agg(rows.alias("rows"))
    return each.select("sequence_id", F.flatten("rows.ids").alias("ids"), F.col("rows.doc_id").alias("doc_ids")).withColumn("n_tokens", F.size("ids"))


def op12_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed(read(spark, sf_dir, "documents").select("doc_id", "text"))
