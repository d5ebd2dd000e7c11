"""Document quality by attention-based multiple-instance learning.

A document is a bag of passages of ``PASSAGE`` words. Each passage is encoded (byte classes, word lengths, repetition
and hashed letter pairs go through a dense layer); gated attention, tanh(V h) * sigmoid(U h), weighs the passages, and
the weighted sum of their encodings is scored. Labels stand on documents only: the attention learns from them which
passages tell, so a document that turns to junk somewhere is found by that passage.

All passages of many documents are encoded at once from their joined bytes. The model is trained here, in numpy, on a
bounded sample of labelled rows; scoring reads whole texts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rollgrid.llm.common import read
from rollgrid.llm.language_id import remainder, sigmoid

PASSAGE = 48
#: Labelled documents used for training, with their whole texts.
SAMPLE = 6000
ENCODED, ATTENTION, PAIRS = 24, 12, 32
THRESHOLD = 0.3
#: Bytes that are encoded at once.
RUN = 1 << 22

GROUPS = ["abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", "\n", ".", ",;:", "!?", "|", "#$%&*", "@/\\=+<>[]{}_~^", "\"'()-`"]
CLASS = np.zeros(256, np.int64)
for _n, _group in enumerate(GROUPS, 1):
    for _c in _group:
        CLASS[ord(_c)] = _n
CLASS[128:] = len(GROUPS) + 1
CLASSES = len(GROUPS) + 2
BLANK = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])
#: Multipliers of bytes by their place in a word, for word hashes.
PLACES = (np.random.default_rng(11).integers(1, 1 << 62, 64, dtype=np.int64) * 2 + 1).astype(np.uint64)
FEATURES = CLASSES + 8 + PAIRS


def passages(texts: list[str | None], size: int = PASSAGE) -> tuple[np.ndarray, np.ndarray]:
    """(features, document of each passage). A text without words is one passage of zeros."""
    bags: list[np.ndarray] = []
    owners: list[np.ndarray] = []
    run: list[bytes] = []
    ids: list[int] = []
    held = 0
    for i, text in enumerate(texts):
        data = (text or "").encode("utf-8", "replace")
        for cut in cuts(data):
            run.append(cut)
            ids.append(i)
            held += len(cut)
            if held >= RUN:
                f, o = encode(run, ids, size)
                bags.append(f)
                owners.append(o)
                run, ids, held = [], [], 0
    f, o = encode(run, ids, size)
    bags.append(f)
    owners.append(o)
    return np.concatenate(bags), np.concatenate(owners)


def cuts(data: bytes) -> Iterator[bytes]:
    """A very long text in pieces that end at a space, if there is one."""
    at = 0
    while len(data) - at > RUN:
        end = data.find(b" ", at + RUN)
        if end < 0:
            break
        yield data[at:end]
        at = end
    yield data[at:]


def encode(run: list[bytes], ids: list[int], size: int) -> tuple[np.ndarray, np.ndarray]:
    if not run:
        return np.zeros((0, FEATURES), np.float32), np.zeros(0, np.int64)
    data = np.frombuffer(b"\n".join([*run, b""]), np.uint8)
    ends = np.cumsum([len(x) + 1 for x in run])
    inside = ~BLANK[data]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    starts = np.flatnonzero(first)
    text_of = np.searchsorted(ends, starts, side="right")
    words = np.bincount(text_of, minlength=len(run))
    count = np.maximum(1, -(-words // size))  # passages of each text
    base = np.concatenate([[0], np.cumsum(count)[:-1]])
    total = int(count.sum())
    rank = np.arange(len(starts)) - np.concatenate([[0], np.cumsum(words)[:-1]])[text_of]
    passage_of = base[text_of] + rank // size
    owner = np.repeat(np.asarray(ids, np.int64), count)
    out = np.zeros((total, FEATURES), np.float32)
    if not len(starts):
        return out, owner
    # every byte belongs to the word that begins at or before it
    word_of = np.cumsum(first) - 1
    body = word_of >= 0
    place = np.arange(len(data)) - starts[np.maximum(word_of, 0)]
    byte_passage = passage_of[np.maximum(word_of, 0)]
    kinds = np.bincount(byte_passage[body] * CLASSES + CLASS[data[body]], minlength=total * CLASSES).reshape(total, CLASSES)
    used = inside
    spread = np.where(used, data.astype(np.uint64) + np.uint64(1), np.uint64(0)) * PLACES[np.minimum(place, 63)]
    hashes = np.add.reduceat(spread, starts)
    lengths = np.bincount(word_of[used], minlength=len(starts))
    n = np.bincount(passage_of, minlength=total).astype(np.float32)
    some = np.maximum(n, 1)
    same = [np.zeros(len(starts), bool) for _ in range(3)]
    for k in range(3):
        back = k + 1
        same[k][back:] = (hashes[back:] == hashes[:-back]) & (passage_of[back:] == passage_of[:-back])
    order = np.lexsort((hashes, passage_of))
    sorted_hash, sorted_passage = hashes[order], passage_of[order]
    new = np.ones(len(order), bool)
    new[1:] = (sorted_hash[1:] != sorted_hash[:-1]) | (sorted_passage[1:] != sorted_passage[:-1])
    distinct = np.bincount(sorted_passage[new], minlength=total)
    characters = np.maximum(kinds.sum(axis=1), 1)
    out[:, :CLASSES] = np.sqrt(kinds / characters[:, None])
    extra = [np.log1p(n) / 4, distinct / some, np.bincount(passage_of, lengths, minlength=total) / some / 10]
    extra += [np.bincount(passage_of, s, minlength=total) / some for s in same]
    extra += [np.bincount(passage_of, (lengths > 20), minlength=total) / some, np.bincount(passage_of, (lengths == 1), minlength=total) / some]
    out[:, CLASSES : CLASSES + 8] = np.stack(extra, axis=1)
    pair = inside[:-1] & inside[1:]
    code = (data[:-1].astype(np.int64) * 31 + data[1:]) % PAIRS
    pairs = np.bincount(byte_passage[:-1][pair] * PAIRS + code[pair], minlength=total * PAIRS).reshape(total, PAIRS)
    out[:, CLASSES + 8 :] = np.sqrt(pairs / np.maximum(pairs.sum(axis=1, keepdims=True), 1))
    return out, owner


class Model:
    """Encoder, gated attention and scorer."""

    def __init__(self, seed: int = 5):
        rng = np.random.default_rng(seed)
        make = lambda *shape: (rng.standard_normal(shape) / np.sqrt(shape[0])).astype(np.float32)
        self.center, self.scale = np.zeros(FEATURES, np.float32), np.ones(FEATURES, np.float32)
        self.p = {"w": make(FEATURES, ENCODED), "b": np.zeros(ENCODED, np.float32), "v": make(ENCODED, ATTENTION), "u": make(ENCODED, ATTENTION), "a": make(ATTENTION, 1), "s": make(ENCODED, 1), "c": np.zeros(1, np.float32)}

    def forward(self, x: np.ndarray, bag: np.ndarray, n: int) -> dict[str, np.ndarray]:
        """Scores of n bags; ``bag`` numbers the bag of each passage, in ascending order, and none is empty."""
        p = self.p
        h = np.tanh(x @ p["w"] + p["b"])
        t, g = np.tanh(h @ p["v"]), sigmoid(h @ p["u"])
        e = ((t * g) @ p["a"])[:, 0]
        begins = np.searchsorted(bag, np.arange(n))
        e = np.exp(e - np.maximum.reduceat(e, begins)[bag])
        weight = e / np.add.reduceat(e, begins)[bag]
        z = np.add.reduceat(h * weight[:, None], begins, axis=0)
        return {"h": h, "t": t, "g": g, "weight": weight, "z": z, "begins": begins, "y": sigmoid((z @ p["s"])[:, 0] + p["c"][0])}

    def gradients(self, x: np.ndarray, bag: np.ndarray, target: np.ndarray, weight: np.ndarray) -> dict[str, np.ndarray]:
        p, f = self.p, self.forward(x, bag, len(target))
        dy = ((f["y"] - target) * weight / weight.sum()).astype(np.float32)[:, None]
        dz = dy @ p["s"].T
        dw = (f["h"] * dz[bag]).sum(axis=1)
        de = f["weight"] * (dw - np.add.reduceat(f["weight"] * dw, f["begins"])[bag])
        dtg = de[:, None] * p["a"][:, 0]
        dt, dg = dtg * f["g"] * (1 - f["t"] ** 2), dtg * f["t"] * f["g"] * (1 - f["g"])
        dh = f["weight"][:, None] * dz[bag] + dt @ p["v"].T + dg @ p["u"].T
        dh *= 1 - f["h"] ** 2
        return {"s": f["z"].T @ dy, "c": dy.sum(axis=0), "a": (f["t"] * f["g"]).T @ de[:, None], "v": f["h"].T @ dt, "u": f["h"].T @ dg, "w": x.T @ dh, "b": dh.sum(axis=0)}

    def scores(self, texts: list[str | None]) -> np.ndarray:
        if not texts:
            return np.zeros(0)
        x, owner = passages(texts)
        order = np.argsort(owner, kind="stable")
        return np.clip(self.forward((x[order] - self.center) / self.scale, owner[order], len(texts))["y"].astype(np.float64), 0, 1)


def train(texts: list[str], labels: list[int], epochs: int = 25, batch: int = 128, rate: float = 0.01, seed: int = 5) -> Model:
    """Fit a model on labelled documents. The result depends on the input only; without both labels it stays flat."""
    model = Model(seed)
    if len(set(labels)) < 2:
        model.p["s"][:] = 0
        model.p["c"][:] = 2.0 if not labels or labels[0] == 1 else -2.0
        return model
    x, owner = passages(texts)
    order = np.argsort(owner, kind="stable")
    x, owner = x[order], owner[order]
    model.center, model.scale = x.mean(axis=0), x.std(axis=0) + 0.05
    x = (x - model.center) / model.scale
    begins = np.searchsorted(owner, np.arange(len(texts) + 1))
    y = np.asarray(labels, np.float32)
    rng = np.random.default_rng(seed)
    first = {k: np.zeros_like(v) for k, v in model.p.items()}
    second = {k: np.zeros_like(v) for k, v in model.p.items()}
    step = 0
    for epoch in range(epochs):
        chosen = rng.permutation(len(texts))
        pace = rate * (1 - epoch / epochs) + rate * 0.02
        for at in range(0, len(chosen), batch):
            docs = chosen[at : at + batch]
            rows = np.concatenate([np.arange(begins[d], begins[d + 1]) for d in docs])
            bag = np.repeat(np.arange(len(docs)), begins[docs + 1] - begins[docs])
            step += 1
            for k, g in model.gradients(x[rows], bag, y[docs], np.ones(len(docs), np.float32)).items():
                g = g + 1e-4 * model.p[k]
                first[k] = 0.9 * first[k] + 0.1 * g
                second[k] = 0.999 * second[k] + 0.001 * g * g
                model.p[k] = (model.p[k] - pace * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
    return model


def fitted(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str, teaching: Column, sample: int = SAMPLE) -> Model:
    """A model trained on the driver on about ``sample`` labelled rows, those of the lowest hashes, whole texts."""
    known = labels.select(F.col(id_col).alias("doc_id"), F.col(label_col).cast("int").alias("label")).where("doc_id is not null and label in (0, 1)").where(teaching)
    count = known.count()
    chance = F.xxhash64("doc_id").bitwiseAND(F.lit((1 << 40) - 1)) / F.lit(float(1 << 40))
    # the lowest hashes of a number that is expected to suffice, so that few rows are sorted
    known = known.withColumn("chance", chance).where(F.col("chance") < F.lit(min(1.0, sample / max(count, 1))))
    known = known.groupBy("doc_id").agg(F.min("label").alias("label"), F.min("chance").alias("chance")).orderBy("chance", "doc_id").limit(sample)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).join(F.broadcast(known), "doc_id")
    got = rows.select("doc_id", "text", "label", "chance").orderBy("chance", "doc_id", "text").limit(sample).collect()
    got = sorted((r["doc_id"], r["text"], r["label"]) for r in got)
    return train([t for _, t, _ in got], [y for _, _, y in got])


def score_quality(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> DataFrame:
    """Per row of ``docs``: doc_id, held_out, score (0 to 1, higher: label 1 likelier), predicted.

    Labels teach only where crc32(id) mod 5 is not 0; contradicting labels of one document count as 0. Null labels,
    labels of unknown documents and null ids teach nothing; without labels of both kinds every score is the same.
    Null and empty texts are scored as a bag of one empty passage. Equal rows get equal scores; an empty table gives
    an empty table; other columns take no part.
    """
    model = docs.sparkSession.sparkContext.broadcast(fitted(docs, labels, id_col, text_col, label_col, remainder("doc_id", 5) != 0))

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = model.value.scores(batch.column(2).to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(scores, pa.float64()), pa.array((scores >= threshold).astype("int32"))], ["doc_id", "held_out", "score", "predicted"])

    kind = docs.schema[id_col].dataType.simpleString()
    source = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(remainder(id_col, 5) == 0, F.lit(True)).alias("held_out"), F.col(text_col).alias("text"))
    return source.mapInArrow(predict, f"doc_id {kind}, held_out boolean, score double, predicted int")


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_quality(read(spark, sf_dir, "documents").select("doc_id", "text"), read(spark, sf_dir, "labels"))
