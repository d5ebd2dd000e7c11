"""Language identification by a bidirectional gated recurrent network over bytes.

Two recurrent layers of gated units read each segment of a text forwards and backwards; a softmax over both states
labels every byte, and the probabilities of all bytes that belong to letters are pooled into those of the document.
The network is trained here, in numpy, by backpropagation through time, on a bounded sample of labelled rows: every
stretch of every sampled text may be drawn, each as likely as any other of its language.

Texts are read whole, as segments of ``SEGMENT`` bytes, each from a zero state; segments of many documents go through
the network in lockstep. The input projections of the 256 bytes are tabulated, so a step is one lookup, one small
matrix product and the gates.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rollgrid.llm.common import broadcast_if_small, read, row_keys

#: Labelled rows that are used for training: so many of each language at most, and so many in all.
SAMPLE_EACH, SAMPLE_ALL = 400, 12_000
#: Steps of training in each pass; a step draws a batch of stretches from all the sampled texts.
STEPS = 24
SEGMENT, HIDDEN, EMBEDDING = 128, 8, 8
LOCKSTEP = 4096
UNKNOWN = "und"
#: Below this pooled probability a filter on languages rejects a document.
LEAST_SCORE = 0.3
LATIN = re.compile("[A-Za-z]")

#: Bytes that count in pooling: ASCII letters, and all bytes of other characters.
POOLED = np.array([chr(b).isalpha() if b < 128 else True for b in range(256)])


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * np.tanh(0.5 * x) + 0.5


class Network:
    """Parameters: embedding, two recurrent layers (w, u, b), output. Gate columns are update, reset, candidate."""

    def __init__(self, languages: list[str], hidden: int = HIDDEN, embedding: int = EMBEDDING, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.languages, self.hidden = list(languages), hidden
        n = len(self.languages)
        make = lambda *shape: (rng.standard_normal(shape) / np.sqrt(shape[0])).astype(np.float32)
        self.p = {"e": make(256, embedding) * 4, "o": make(2 * hidden, n), "c": np.zeros(n, np.float32)}
        for side in "fb":
            self.p |= {f"w{side}": make(embedding, 3 * hidden), f"u{side}": make(hidden, 3 * hidden), f"b{side}": np.zeros(3 * hidden, np.float32)}

    def states(self, data: np.ndarray, side: str, keep: bool = False):
        """States of one layer at every step for bytes of shape (steps, segments); with ``keep``, what training needs."""
        p, h = self.p, self.hidden
        table = p["e"] @ p[f"w{side}"] + p[f"b{side}"]
        u = p[f"u{side}"]
        state = np.zeros((data.shape[1], h), np.float32)
        out = np.empty((*data.shape, h), np.float32)
        kept = []
        for t in range(len(data)) if side == "f" else range(len(data) - 1, -1, -1):
            x = table.take(data[t], axis=0)
            y = state @ u
            gates = sigmoid(x[:, : 2 * h] + y[:, : 2 * h])
            z, r = gates[:, :h], gates[:, h:]
            candidate = np.tanh(x[:, 2 * h :] + r * y[:, 2 * h :])
            new = candidate + z * (state - candidate)
            if keep:
                kept.append((t, state, z, r, candidate, y[:, 2 * h :]))
            state = out[t] = new
        return (out, kept) if keep else out

    def labels(self, data: np.ndarray) -> np.ndarray:
        """Probabilities of every language at every byte."""
        scores = self.states(data, "f") @ self.p["o"][: self.hidden]
        scores += self.states(data, "b") @ self.p["o"][self.hidden :]
        scores += self.p["c"]
        np.exp(scores - scores.max(axis=-1, keepdims=True), out=scores)
        scores /= scores.sum(axis=-1, keepdims=True)
        return scores

    def gradients(self, data: np.ndarray, target: np.ndarray, mask: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Mean cross entropy over the masked bytes, and its gradients by backpropagation through time."""
        p, h = self.p, self.hidden
        runs = {side: self.states(data, side, keep=True) for side in "fb"}
        both = np.concatenate([runs["f"][0], runs["b"][0]], axis=-1)
        scores = both @ p["o"] + p["c"]
        scores -= scores.max(axis=-1, keepdims=True)
        probabilities = np.exp(scores)
        probabilities /= probabilities.sum(axis=-1, keepdims=True)
        total = max(1.0, float(mask.sum()))
        steps, columns = np.indices(data.shape)
        loss = -float((np.log(probabilities[steps, columns, target[None, :]] + 1e-12) * mask).sum()) / total
        d = probabilities
        d[steps, columns, target[None, :]] -= 1
        d *= (mask / total)[..., None].astype(np.float32)
        g = {"o": np.tensordot(both, d, axes=([0, 1], [0, 1])), "c": d.sum(axis=(0, 1)), "e": np.zeros_like(p["e"])}
        back = d @ p["o"].T
        for n, side in enumerate("fb"):
            w, u = p[f"w{side}"], p[f"u{side}"]
            gw, gu, gb = np.zeros_like(w), np.zeros_like(u), np.zeros(3 * h, np.float32)
            rows = np.zeros((256, 3 * h), np.float32)
            flow = np.zeros((data.shape[1], h), np.float32)
            for t, before, z, r, candidate, y in reversed(runs[side][1]):
                flow = flow + back[t][:, n * h : (n + 1) * h]
                da = flow * (1 - z) * (1 - candidate * candidate)
                dr = da * y * r * (1 - r)
                dz = flow * (before - candidate) * z * (1 - z)
                dx = np.concatenate([dz, dr, da], axis=1)
                dy = np.concatenate([dz, dr, da * r], axis=1)
                gu += before.T @ dy
                np.add.at(rows, data[t], dx)
                flow = flow * z + dy @ u.T
            gw += p["e"].T @ rows
            gb += rows.sum(axis=0)
            g["e"] += rows @ w.T
            g |= {f"w{side}": gw, f"u{side}": gu, f"b{side}": gb}
        return loss, g


def segments(text: bytes, size: int = SEGMENT) -> np.ndarray:
    """The bytes of a text as rows of ``size``, the last filled up with spaces."""
    rows = -(-len(text) // size)
    return np.frombuffer(text.ljust(rows * size, b" "), np.uint8).reshape(rows, size)


def train(texts: list[str], targets: list[str], epochs: int = 10, batch: int = 256, rate: float = 0.02, length: int = 64, seed: int = 7, hidden: int = HIDDEN, steps: int = STEPS) -> Network:
    """Fit a network on texts and their languages. Each language weighs alike; the result depends on the input only."""
    languages = sorted(set(targets))
    net = Network(languages, hidden=hidden, seed=seed)
    if len(languages) < 2:
        return net
    rng = np.random.default_rng(seed)
    pieces, marks = [], []
    for text, target in sorted(zip(texts, targets), key=lambda x: (x[1], x[0])):
        data = text.encode("utf-8", "replace")
        if data:
            pieces.append(segments(data, length))
            marks.append(np.full(len(pieces[-1]), languages.index(target)))
    data, marks = np.concatenate(pieces), np.concatenate(marks)
    order_of = [np.flatnonzero(marks == n) for n in range(len(languages))]
    each = -(-batch * steps // len(languages))
    first = {k: np.zeros_like(v) for k, v in net.p.items()}
    second = {k: np.zeros_like(v) for k, v in net.p.items()}
    step = 0
    for epoch in range(epochs):
        chosen = np.concatenate([rng.choice(x, each, replace=len(x) < each) for x in order_of if len(x)])
        rng.shuffle(chosen)
        for at in range(0, len(chosen), batch):
            rows = chosen[at : at + batch]
            block = np.ascontiguousarray(data[rows].T)
            _, g = net.gradients(block, marks[rows], POOLED[block])
            norm = np.sqrt(sum(float((x * x).sum()) for x in g.values()))
            step += 1
            pace = rate * (1 - epoch / epochs) + rate * 0.05
            for k, x in g.items():
                x = x * min(1.0, 1.0 / (norm + 1e-12))
                first[k] = 0.9 * first[k] + 0.1 * x
                second[k] = 0.99 * second[k] + 0.01 * x * x
                net.p[k] = (net.p[k] - pace * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.99**step)) + 1e-8)).astype(np.float32)
    return net


def has_letter(text: str) -> bool:
    """Whether a character of the text is a letter to Unicode; numbers such as ² and Ⅷ are none."""
    return bool(LATIN.search(text)) or any(map(str.isalpha, text))


def pooled(net: Network, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
    """Language and score of each text. Null, and texts without a letter, are unknown with score 0."""
    if not net.languages:
        return [UNKNOWN] * len(texts), np.zeros(len(texts))
    sums = np.zeros((len(texts), len(net.languages)))
    counts = np.zeros(len(texts))
    rows: list[np.ndarray] = []
    owners: list[np.ndarray] = []
    held = 0

    def run() -> None:
        nonlocal rows, owners, held
        if not rows:
            return
        block, owner = np.concatenate(rows), np.concatenate(owners)
        for at in range(0, len(block), LOCKSTEP):
            part = np.ascontiguousarray(block[at : at + LOCKSTEP].T)
            mask = POOLED[part]
            labels = net.labels(part)
            labels *= mask[..., None]
            np.add.at(sums, owner[at : at + LOCKSTEP], labels.sum(axis=0))
            np.add.at(counts, owner[at : at + LOCKSTEP], mask.sum(axis=0))
        rows, owners, held = [], [], 0

    for i, text in enumerate(texts):
        if not text or not has_letter(text):
            continue
        data = text.encode("utf-8", "replace")
        for at in range(0, len(data), SEGMENT * LOCKSTEP):
            cut = segments(data[at : at + SEGMENT * LOCKSTEP])
            rows.append(cut)
            owners.append(np.full(len(cut), i))
            held += len(cut)
            if held >= LOCKSTEP * 4:
                run()
    run()
    names = [UNKNOWN] * len(texts)
    scores = np.zeros(len(texts))
    known = np.flatnonzero(counts > 0)
    best = sums[known].argmax(axis=1)
    scores[known] = np.clip(sums[known, best] / counts[known], 0, 1)
    for i, n in zip(known, best):
        names[i] = net.languages[n]
    return names, scores


def remainder(id_col: str, n: int) -> Column:
    return F.pmod(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(n))


def sample(rows: DataFrame, each: int = SAMPLE_EACH, most: int = SAMPLE_ALL) -> list[tuple[str, str]]:
    """A bounded sample of (text, label), whole texts: the rows of the lowest hashes, about ``each`` of every label and
    at most ``most`` in all. It depends on the rows alone."""
    rows = rows.where("label is not null and text is not null and text <> ''")
    counts = rows.groupBy("label").agg(F.count(F.lit(1)).alias("n"))
    labels = counts.count()
    if not labels:
        return []
    share = F.lit(float(max(1, min(each, most // labels)))) / F.col("n")
    chance = F.xxhash64("doc_id", "text").bitwiseAND(F.lit((1 << 40) - 1)) / F.lit(float(1 << 40))
    chosen = rows.join(broadcast_if_small(counts), "label").withColumn("chance", chance / share).where("chance < 1")
    got = chosen.select("text", "label", "chance").orderBy("chance", "label", "text").limit(most).collect()
    return sorted((r["text"], r["label"]) for r in got)


def fitted(docs: DataFrame, teaching: Column, id_col: str, text_col: str, lang_col: str, epochs: int) -> Network:
    """The network, trained on the driver on a bounded sample of the rows that may teach."""
    rows = docs.where(teaching).select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.col(lang_col).alias("label"))
    got = sample(rows)
    return train([text for text, _ in got], [label for _, label in got], epochs=epochs)


def identify(docs: DataFrame, learn: Column | None = None, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", epochs: int = 10) -> DataFrame:
    """Per row: doc_id, held_out, lang_pred, score, k1, k2 (row keys are for joins and may be dropped).

    ``learn`` tells from which rows the network may learn; by default those whose crc32(id) mod 3 is not 1. Rows with
    a null language, id or text teach nothing. If no row teaches, every text is unknown. Null texts and texts without
    a letter are ``und`` with score 0. Equal rows get equal results; an empty table gives an empty table; other columns
    take no part, and neither language nor id is an input of a prediction.
    """
    teaching = remainder(id_col, 3) != 1 if learn is None else learn
    shared = docs.sparkSession.sparkContext.broadcast(fitted(docs, teaching, id_col, text_col, lang_col, epochs))

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, scores = pooled(shared.value, batch.column(4).to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(names, pa.string()), pa.array(scores, pa.float64()), batch.column(2), batch.column(3)], ["doc_id", "held_out", "lang_pred", "score", "k1", "k2"])

    kind = docs.schema[id_col].dataType.simpleString()
    keys = row_keys(F.col(id_col), F.col(text_col))
    source = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(remainder(id_col, 3) == 1, F.lit(True)).alias("held_out"), *keys, F.col(text_col).alias("text"))
    return source.mapInArrow(predict, f"doc_id {kind}, held_out boolean, lang_pred string, score double, k1 long, k2 long")


def known_language(docs: DataFrame, least: float = LEAST_SCORE, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", epochs: int = 10) -> DataFrame:
    """The rows whose language is known with at least the score ``least``, with all their columns, in one pass."""
    shared = docs.sparkSession.sparkContext.broadcast(fitted(docs, remainder(id_col, 3) != 1, id_col, text_col, lang_col, epochs))
    at = docs.columns.index(text_col)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, scores = pooled(shared.value, batch.column(at).to_pylist())
            yield batch.filter(pa.array([n != UNKNOWN and s >= least for n, s in zip(names, scores)]))

    return docs.mapInArrow(keep, docs.schema)


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify(read(spark, sf_dir, "documents").select("doc_id", "text", "lang")).drop("k1", "k2")
