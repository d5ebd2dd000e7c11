"""Token counts by a compiled finite-state tokenizer.

A byte-pair vocabulary with word ends is compiled into a deterministic transducer whose transitions carry the number
of tokens they emit (net: a byte that merges tokens emits a negative number).

* The last token of the encoding of any prefix is the one suffix token that forms a stable pair with the last token
  of what stands before it. A state therefore holds, for the longest suffix that is still the beginning of some
  token, the last token at each of its positions; what stands further back cannot matter any more.
* The last byte of a word takes another symbol than the same byte inside it, so each state also holds the correction
  that is due if the word ends there; a word start (or white space) pays it out and leads back to the initial state.
* States are determinised lazily, as they are met, and the table is flushed when it holds ``MAX_STATES`` of them.

Texts are joined by line feeds and cut into chunks of equal length, whatever the lengths of documents. The map of a
chunk takes the state before it to the state after it and the counts inside it. From its first word start on, this
map is constant, so all chunks run in lockstep from there. The maps of heads, and of chunks without any word start, are
tabulated for the states that can be live at their beginning: the image of the map before them, or a guess, closed under
the maps. A parallel prefix scan composes these tables by doubling and yields the state in which each chunk begins.
"""

from __future__ import annotations

import json
import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rollgrid.llm.common import read

VOCABULARY = "word_bpe_49k.json"
LIMIT = 2048
CHUNK = 256
MAX_STATES = 300_000
#: The input that stands for white space; others are bytes.
STAY = 256
#: Code points of texts that are joined to one run; a longer text is cut into slices.
RUN = 1 << 21

SPACE, LETTER, NUMBER, OTHER = range(4)
#: Characters that Unicode calls white space; the pre-tokenizer's \s.
WHITE = "\t\n\x0b\x0c\r \x85\xa0                　"


BLANK = re.compile(f"[{WHITE}]")

#: The normaliser and the pre-tokenizer that this module knows, as vocabulary files write them.
NORMALISERS = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]
WORDS = "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"


def byte_symbols() -> list[str]:
    """The printable character by which byte-level vocabularies write each byte."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in shown]
    table = {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}
    return [table[b] for b in range(256)]


def refuse_unknown(spec: dict) -> None:
    """Raise an error for a vocabulary whose texts are not prepared in the way this module knows."""
    steps = (spec.get("pre_tokenizer") or {}).get("pretokenizers") or [{}]
    split, last, model = steps[0], steps[-1], spec["model"]
    known = (
        (spec.get("normalizer") or {}).get("normalizers") == NORMALISERS
        and len(steps) == 2
        and (split.get("type"), split.get("pattern"), split.get("behavior"), split.get("invert")) == ("Split", {"Regex": WORDS}, "Removed", True)
        and (last.get("type"), last.get("add_prefix_space"), last.get("use_regex")) == ("ByteLevel", False, False)
        and model.get("type") == "BPE"
        and model.get("end_of_word_suffix")
        and not any(model.get(name) for name in ("dropout", "continuing_subword_prefix", "byte_fallback", "ignore_merges"))
        and not any(t.get(name) for t in spec["added_tokens"] for name in ("normalized", "single_word", "lstrip", "rstrip"))
    )
    if not known:
        raise ValueError("the normaliser, pre-tokenizer or model of this vocabulary is not supported")


class Merges:
    """The merge rules of a vocabulary, over symbols 0-255 (byte inside a word) and 256-511 (last byte of a word)."""

    def __init__(self, path: str):
        spec = json.load(open(path, encoding="utf-8"))
        refuse_unknown(spec)
        model = spec["model"]
        end = model["end_of_word_suffix"]
        names = byte_symbols()
        ids: dict[str, int] = {s: i for i, s in enumerate(names)} | {s + end: 256 + i for i, s in enumerate(names)}
        self.pairs: dict[tuple[int, int], tuple[int, int]] = {}
        self.symbols: list[str] = [chr(i) for i in range(512)]  # of each token, one character for a symbol
        for rank, pair in enumerate(model["merges"]):
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            name = a + b
            if name not in ids:
                ids[name] = len(ids)
                self.symbols.append(self.symbols[ids[a]] + self.symbols[ids[b]])
            self.pairs.setdefault((ids[a], ids[b]), (rank, ids[name]))
        self.special = [t["content"] for t in spec["added_tokens"]]
        self.stable: dict[tuple[int, int], bool] = {}
        self.token_of: dict[str, int] = {}
        for token, symbols in enumerate(self.symbols):
            if self.encode(symbols) == [token]:  # a token that merges cannot reach takes no part
                self.token_of[symbols] = token
        self.beginnings = {symbols[:n] for symbols in self.token_of for n in range(1, len(symbols) + 1)}

    def encode(self, symbols: str) -> list[int]:
        """Plain merging: the pair of the lowest rank first, the leftmost of equals."""
        word = [ord(c) for c in symbols]
        while len(word) > 1:
            best = min(((self.pairs[p][0], i) for i, p in enumerate(zip(word, word[1:])) if p in self.pairs), default=None)
            if best is None:
                return word
            i = best[1]
            pair = (word[i], word[i + 1])
            target, out, i = self.pairs[pair][1], [], 0
            while i < len(word):
                if i + 1 < len(word) and (word[i], word[i + 1]) == pair:
                    out.append(target)
                    i += 2
                else:
                    out.append(word[i])
                    i += 1
            word = out
        return word

    def is_stable(self, a: int, b: int) -> bool:
        """Whether tokens a and b stay as they are when they stand together."""
        known = self.stable.get((a, b))
        if known is None:
            known = self.stable[a, b] = self.encode(self.symbols[a] + self.symbols[b]) == [a, b]
        return known


class Transducer:
    """The lazily determinised transducer over bytes. State 0 is outside a word; ``step`` runs many states at once.

    A state is (suffix, tokens, depths, due): the longest suffix of the word so far that begins a token, the last
    token at each of its positions (and before it), the token counts there relative to the last, and the correction
    that the end of the word makes. Most states have few transitions, so these lie in one open-addressed table.
    """

    def __init__(self, merges: Merges, max_states: int = MAX_STATES):
        self.merges, self.max_states = merges, max_states
        self.flush()

    def flush(self) -> None:
        self.states: list[tuple] = [("", (-1,), (0,), 0)]
        self.numbers = {self.states[0]: 0}
        self.merges.stable.clear()
        self.due = np.zeros(1024, np.int16)
        self.bits, self.filled = 16, 0
        self.keys, self.values = np.full(1 << self.bits, -1, np.int64), np.zeros(1 << self.bits, np.int64)
        self.put(np.array([STAY]), np.array([128]))  # white space keeps state 0 and emits nothing

    def slots(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def put(self, keys: np.ndarray, values: np.ndarray) -> None:
        """Add transitions; a value is the next state * 256 + 128 + the tokens emitted."""
        if (self.filled + len(keys)) * 3 > 1 << self.bits:
            full = self.keys >= 0
            keys, values = np.concatenate([self.keys[full], keys]), np.concatenate([self.values[full], values])
            while len(keys) * 4 > 1 << self.bits:
                self.bits += 1
            self.filled = 0
            self.keys, self.values = np.full(1 << self.bits, -1, np.int64), np.zeros(1 << self.bits, np.int64)
        self.filled += len(keys)
        at, mask = self.slots(keys), (1 << self.bits) - 1
        while keys.size:
            free = self.keys[at] < 0
            self.keys[at[free]] = keys[free]  # of several keys for one slot the last one stays
            placed = self.keys[at] == keys
            self.values[at[placed]] = values[placed]
            at, keys, values = (at[~placed] + 1) & mask, keys[~placed], values[~placed]

    def get(self, keys: np.ndarray) -> np.ndarray:
        """The values of transitions, -1 for those that are not made yet."""
        at = self.slots(keys)
        out = self.values.take(at)
        there = self.keys.take(at)
        off = np.flatnonzero(there != keys)
        mask = (1 << self.bits) - 1
        while off.size:
            out[off] = -1
            off = off[there[off] >= 0]
            at[off] = (at[off] + 1) & mask
            there[off] = self.keys[at[off]]
            hit = there[off] == keys[off]
            out[off[hit]] = self.values[at[off[hit]]]
            off = off[~hit]
        return out

    def advance(self, state: tuple, symbol: int) -> tuple[str, list[int], list[int]]:
        """The suffix, its tokens and depths after a symbol, before they are trimmed."""
        suffix, tokens, depths, _ = state
        grown = suffix + chr(symbol)
        m = self.merges
        for start in range(len(grown)):  # longest suffix token first
            token = m.token_of.get(grown[start:])
            if token is not None and (tokens[start] < 0 or m.is_stable(tokens[start], token)):
                return grown, [*tokens, token], [*depths, depths[start] + 1]
        raise ValueError("a single symbol is always a token")

    def make(self, state: int, byte: int) -> tuple[int, int]:
        """Number of the state after a byte inside a word, and the net count of tokens emitted."""
        now = self.states[state]
        suffix, tokens, depths = self.advance(now, byte)
        last = depths[-1]
        ended = self.advance(now, 256 + byte)[2][-1]
        cut = 0
        while suffix[cut:] and suffix[cut:] not in self.merges.beginnings:
            cut += 1
        suffix, tokens, depths = suffix[cut:], tokens[cut:], depths[cut:]
        # a position from which no token can reach beyond the end any more does not tell states apart
        for i in range(len(suffix)):
            if suffix[i:] not in self.merges.beginnings:
                tokens[i], depths[i] = -2, last
        new = (suffix, tuple(tokens), tuple(d - last for d in depths), ended - last)
        number = self.numbers.get(new)
        if number is None:
            number = self.numbers[new] = len(self.states)
            self.states.append(new)
            if number >= len(self.due):
                self.due = np.concatenate([self.due, np.zeros_like(self.due)])
            self.due[number] = new[3]
        return number, last

    def step(self, states: np.ndarray, inputs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The states after one more byte each, and the tokens emitted. Makes the transitions that are missing."""
        keys = states * 512 + inputs
        values = self.get(keys)
        missing = values < 0
        if missing.any():
            new = np.unique(keys[missing])
            made = [self.make(*divmod(int(key), 512)) for key in new]
            self.put(new, np.array([number * 256 + 128 + count for number, count in made]))
            values[missing] = self.get(keys[missing])
        return values >> 8, (values & 255) - 128


class Classes:
    """Character classes of the pre-tokenizer, looked up by code point."""

    def __init__(self) -> None:
        self.table = np.full(0x110000, -1, np.int8)
        for c in WHITE:
            self.table[ord(c)] = SPACE

    def __call__(self, points: np.ndarray) -> np.ndarray:
        out = self.table.take(points)
        if out.size and out.min() < 0:
            for point in np.unique(points[out < 0]):
                kind = unicodedata.category(chr(point))[0]
                self.table[point] = LETTER if kind == "L" else NUMBER if kind == "N" else OTHER
            out = self.table.take(points)
        return out


def word_starts(points: np.ndarray, kinds: np.ndarray) -> np.ndarray:
    """Where words begin: runs of letters, single numbers, runs of others, and contractions after an apostrophe."""
    n = len(points)
    starts = np.empty(n, bool)
    if not n:
        return starts
    starts[0] = True
    np.not_equal(kinds[1:], kinds[:-1], out=starts[1:])
    starts |= kinds == NUMBER
    quotes = np.flatnonzero(starts & (points == 0x27))
    if quotes.size:
        padded = np.concatenate([points, np.zeros(2, points.dtype)])
        one, two = padded[quotes + 1], padded[quotes + 2]
        short = np.isin(one, [ord(c) for c in "stmd"])
        long = np.zeros(len(quotes), bool)
        for a, b in ("re", "ve", "ll"):
            long |= (one == ord(a)) & (two == ord(b))
        starts[quotes[short | long] + 1] = False
        for at in (quotes[short] + 2, quotes[long] + 3):
            starts[at[at < n]] = True
    return starts


def utf8(points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of code points, and where each point begins."""
    sizes = 1 + (points >= 0x80) + (points >= 0x800) + (points >= 0x10000)
    begins = np.zeros(len(points) + 1, np.int64)
    np.cumsum(sizes, out=begins[1:])
    out = np.empty(begins[-1], np.uint8)
    for size in range(1, 5):
        which = np.flatnonzero(sizes == size)
        if not which.size:
            continue
        at, p = begins[which], points[which]
        if size == 1:
            out[at] = p
            continue
        out[at] = (p >> (6 * (size - 1))) | (0xF00 >> size & 0xFF)
        for k in range(1, size):
            out[at + k] = (p >> (6 * (size - 1 - k))) & 0x3F | 0x80
    return out, begins


def slices(text: str) -> Iterator[str]:
    """The text in pieces of about RUN characters, cut at white space, where no word can go on."""
    at = 0
    while len(text) - at > RUN and (cut := BLANK.search(text, at + RUN)):
        yield text[at : cut.end()]
        at = cut.end()
    yield text[at:]


class Counter:
    """Counts the tokens of texts with a transducer."""

    def __init__(self, path: str, chunk: int = CHUNK, max_states: int = MAX_STATES):
        self.merges = Merges(path)
        self.transducer = Transducer(self.merges, max_states)
        self.classes = Classes()
        self.chunk = chunk
        self.special = re.compile("|".join(map(re.escape, self.merges.special)) or "(?!)")

    def normal(self, text: str) -> str:
        """The normaliser of the vocabulary, but for white space, which ends words in any form: NFC and lower case."""
        if not text.isascii():
            if not unicodedata.is_normalized("NFC", text):
                text = unicodedata.normalize("NFC", text)
            if "Σ" in text:  # lower-cased alone, whatever stands around it
                text = text.replace("Σ", "σ")
        return text.lower()

    def count(self, texts: list[str | None]) -> np.ndarray:
        """Token counts of texts; null counts as empty."""
        out = np.zeros(len(texts), np.int64)
        run: list[str] = []
        owners: list[int] = []
        held = 0
        for i, text in enumerate(texts):
            if not text:
                continue
            parts = [text]
            if any(special in text for special in self.merges.special):
                parts = self.special.split(text)
                out[i] += len(parts) - 1
            for part in parts:
                for piece in slices(self.normal(part)):
                    run.append(piece)
                    owners.append(i)
                    held += len(piece)
                    if held >= RUN:
                        self._count_run(run, owners, out)
                        run, owners, held = [], [], 0
        self._count_run(run, owners, out)
        return out

    def _count_run(self, run: list[str], owners: list[int], out: np.ndarray) -> None:
        if not run:
            return
        points = np.frombuffer("\n".join([*run, ""]).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int32)
        ends = np.cumsum([len(x) + 1 for x in run])
        kinds = self.classes(points)
        starts = word_starts(points, kinds)
        data, begins = utf8(points)
        # per byte: 0 goes on inside a word, 1 begins a word, 2 is white space
        marks = np.zeros(len(data), np.uint8)
        marks[begins[:-1][starts]] = 1
        white = kinds == SPACE
        if (wide := white & (points >= 0x80)).any():
            for k in range(3):
                at = begins[:-1][wide] + k
                marks[at[at < begins[1:][wide]]] = 2
        marks[begins[:-1][white]] = 2
        emitted = self.emissions(data, marks)
        cuts = np.concatenate([[0], begins[ends[:-1]]])
        np.add.at(out, owners, np.add.reduceat(emitted, cuts, dtype=np.int64))

    def emissions(self, data: np.ndarray, marks: np.ndarray) -> np.ndarray:
        """Tokens emitted at each byte; marks: 0 goes on inside a word, 1 begins a word, 2 is white space.

        The first byte begins a word or is white space, and the last is white space.
        """
        machine, size, n = self.transducer, self.chunk, len(data)
        if len(machine.states) > machine.max_states:
            machine.flush()
        rows = -(-n // size)
        grid, mark = np.full(rows * size, STAY, np.int64), np.full(rows * size, 2, np.uint8)
        grid[:n], mark[:n] = data, marks
        grid[mark == 2] = STAY
        # one row for each step, one column for each chunk
        grid, mark = np.ascontiguousarray(grid.reshape(rows, size).T), np.ascontiguousarray(mark.reshape(rows, size).T) > 0
        first = np.where(mark.any(axis=0), mark.argmax(axis=0), size)
        emitted = np.zeros((size, rows), np.int16)
        ends = np.zeros(rows, np.int64)
        seen = np.zeros(rows, bool)
        for j in range(size):  # all chunks from their first boundary on, where any state leads to the same
            boundary = mark[j]
            seen |= boundary
            emitted[j] = machine.due.take(ends) * boundary
            ends[boundary] = 0
            ends, count = machine.step(ends, np.where(seen, grid[j], STAY))
            emitted[j] += count
        self._heads(grid, emitted, first, ends)
        return emitted.T.ravel()[:n]

    def _heads(self, grid: np.ndarray, emitted: np.ndarray, first: np.ndarray, ends: np.ndarray) -> None:
        """Add what the chunks emit before their first boundary, by a prefix scan over the maps of these heads.

        A row of the tables is a pair of a chunk and a state at its beginning, with the state at the end of its head
        and the tokens emitted. A head that is a whole chunk leads to a pair of the next chunk; pairs are added until
        all that are led to are there.
        """
        machine, (size, rows) = self.transducer, grid.shape
        passing = first == size
        keys, after, total = np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.int64)
        new = (np.arange(1, rows) << 32) | ends[:-1]  # the state before is a guess where that chunk passes
        while new.size:
            chunk, state = new >> 32, new & 0xFFFFFFFF
            order = np.argsort(-first[chunk], kind="stable")
            new, chunk, state = new[order], chunk[order], state[order]
            lengths, count = first[chunk], np.zeros(len(new), np.int64)
            for j in range(int(lengths[0])):
                live = int(np.searchsorted(-lengths, -j, side="left"))
                state[:live], tokens = machine.step(state[:live], grid[j, chunk[:live]])
                count[:live] += tokens
            keys, after, total = np.concatenate([keys, new]), np.concatenate([after, state]), np.concatenate([total, count])
            order = np.argsort(keys)
            keys, after, total = keys[order], after[order], total[order]
            led = passing[chunk] & (chunk + 1 < rows)
            new = np.setdiff1d(((chunk[led] + 1) << 32) | state[led], keys)
        # compose: the pair of each chunk is as many leads away from the last chunk after a known state
        place = np.arange(1, rows)
        steps = place - np.maximum.accumulate(np.where(passing[:-1], 0, place))
        begin = place - steps
        pair = np.searchsorted(keys, (begin << 32) | ends[begin - 1])
        owner = keys >> 32
        lead = np.arange(len(keys))
        through = passing[owner] & (owner + 1 < rows)
        lead[through] = np.searchsorted(keys, ((owner[through] + 1) << 32) | after[through])
        while steps.any():
            odd = (steps & 1).astype(bool)
            pair[odd] = lead[pair[odd]]
            lead, steps = lead[lead], steps >> 1
        emitted[0, 1:] += total[pair].astype(emitted.dtype)
        closed = np.flatnonzero(~passing[1:])
        emitted[first[closed + 1], closed + 1] += machine.due[after[pair[closed]]]


_counters: dict[str, Counter] = {}


def counter(path: str) -> Counter:
    """The counter of a vocabulary file, compiled once in each Python worker."""
    if path not in _counters:
        _counters[path] = Counter(path)
    return _counters[path]


def vocabulary_path(name: str) -> str:
    """Where an installed public vocabulary lies; an absolute path stands for itself."""
    if name.startswith("/"):
        return name
    import public_tokenizers

    return public_tokenizers.path(name)


def count_tokens(docs: DataFrame, vocabulary: str = VOCABULARY, limit: int = LIMIT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id, n_bytes (UTF-8), n_tokens, over_limit (n_tokens > limit). No shuffle.

    Special tokens are not added; where their strings stand in a text, each counts as one token. Null and empty
    texts have 0 bytes and tokens. Rows that repeat, and null ids, each give a row; an empty table gives an empty
    table; other columns take no part. The vocabulary is read from the installed package on each executor.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = counter(vocabulary_path(vocabulary)).count
        for batch in batches:
            tokens = count(batch.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(tokens, pa.int64()), pa.array(tokens > limit)], ["doc_id", "n_bytes", "n_tokens", "over_limit"])

    kind = docs.schema[id_col].dataType.simpleString()
    text = F.col(text_col)
    rows = docs.select(F.col(id_col).alias("doc_id"), text.alias("text"), F.coalesce(F.octet_length(text), F.lit(0)).cast("long").alias("n_bytes"))
    return rows.mapInArrow(run, f"doc_id {kind}, n_bytes long, n_tokens long, over_limit boolean")


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(read(spark, sf_dir, "documents").select("doc_id", "text"))
