"""Quality classifier: gated-attention multiple-instance learning over passages.

A document is a bag of passages of PASSAGE words. Tasks describe each passage by
shares of byte classes, of repeated neighbouring words and of word lengths; a
small network encodes it, gated attention weighs the passages of a document, and
the weighted sum is scored. Only documents have labels; the attention learns
which passages decide. Labels are used for fitting alone: scores depend on the
text only.

The fit takes a bounded, documented sample of the labelled rows on the driver (about
TRAIN_DOCS, chosen by a hash of doc_id, with their whole texts); scoring is one pass
over whole texts without a shuffle.

Defined results: null and empty texts are one passage without words and get its
score; repeated rows are scored one by one; of several labels of one doc_id the
largest counts; null labels are ignored; with no labelled rows at all every
score is 0.5. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from quarry.llm.bytes_np import Words, buffers, fold_table, slices
from quarry.llm.scratch import small_batches

PASSAGE, HIDDEN, GATES = 48, 24, 12
TRAIN_DOCS, EPOCHS = 5_000, 40
THRESHOLD = 0.7

#: Byte classes: letters, upper case, digits, non-ASCII, line ends, blanks, and each other ASCII byte by itself.
_CLASS = np.zeros(256, np.int64)
_CLASS[0x61:0x7B], _CLASS[0x41:0x5B], _CLASS[0x30:0x3A], _CLASS[0x80:], _CLASS[[9, 0x20]], _CLASS[[10, 13]] = 0, 1, 2, 3, 4, 5
_OTHER = [b for b in range(0x80) if not (0x61 <= b < 0x7B or 0x41 <= b < 0x5B or 0x30 <= b < 0x3A or b in (9, 10, 13, 0x20))]
_CLASS[_OTHER] = 6 + np.array([b % 24 if b < 0x20 else b - 0x20 if b < 0x40 else b - 0x3A if b < 0x61 else b - 0x5A for b in _OTHER]) % 34
_CLASSES = 40
_LENGTHS = np.minimum(np.arange(256), 24)
FEATURES = _CLASSES + 10


def passages(part_text: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Feature rows of all passages of a slice, and the passage bounds of each row (every row has one at least)."""
    data, ends = buffers(part_text)
    words = Words(data, ends, fold_table("plain"))
    per_row = np.diff(words.bounds)
    counts = np.maximum(1, -(-per_row // PASSAGE))
    bounds = np.concatenate([[0], np.cumsum(counts)])
    n = int(bounds[-1])
    out = np.zeros((n, FEATURES), np.float32)
    if not len(words.start):
        return out, bounds
    within = np.arange(len(words.row)) - words.bounds[words.row]
    owner = bounds[words.row] + within // PASSAGE
    size = words.end - words.start
    firsts = np.flatnonzero(np.diff(owner, prepend=-1))
    which = owner[firsts]
    # Bytes from a passage's first word up to the next passage's, or to the end of its own text.
    begins = words.start[firsts]
    n_bytes = np.minimum(np.append(begins[1:], len(data)), ends[words.row[firsts] + 1]) - begins
    spans = np.repeat(which, n_bytes)
    body = data[np.arange(len(spans)) + np.repeat(begins - (np.cumsum(n_bytes) - n_bytes), n_bytes)]
    classes = np.bincount(spans * _CLASSES + _CLASS[body], minlength=n * _CLASSES).reshape(n, _CLASSES)
    out[:, :_CLASSES] = np.sqrt(classes / np.maximum(1, classes.sum(1, keepdims=True)))
    total = np.maximum(1, np.bincount(owner, minlength=n))
    share = lambda flags: np.bincount(owner, flags, n) / total
    h, row = words.hash, words.row
    for k in range(1, 5):
        same = np.zeros(len(h))
        if len(h) > k:
            same[k:] = (h[k:] == h[:-k]) & (row[k:] == row[:-k])
        out[:, _CLASSES + k - 1] = share(same)
    lead, tail = data[words.start], data[words.end - 1]
    symbol = lambda b: (_CLASS[b] > 5) & ~np.isin(b, np.frombuffer(b".,;:!?'\"()-", np.uint8))
    for k, flags in enumerate((symbol(lead) & (size == 1), symbol(tail) & (size > 1), (_CLASS[lead] == 1), np.isin(tail, np.frombuffer(b".,;:!?", np.uint8)), size > 14)):
        out[:, _CLASSES + 4 + k] = share(flags.astype(np.float64))
    out[:, _CLASSES + 9] = share(np.minimum(size, 24).astype(np.float64)) / 24
    return out, bounds


class Bags:
    """Passages of several documents, one after another."""

    def __init__(self, x: np.ndarray, bounds: np.ndarray):
        self.x, self.starts, self.of = x, bounds[:-1], np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def forward(model: dict, bags: Bags) -> dict:
    h = np.tanh(bags.x @ model["E"] + model["e"])
    v, u = np.tanh(h @ model["V"]), _sigmoid(h @ model["U"])
    a = (v * u) @ model["w"]
    a = np.exp(a - np.maximum.reduceat(a, bags.starts)[bags.of])
    a = a / np.add.reduceat(a, bags.starts)[bags.of]
    z = np.add.reduceat(h * a[:, None], bags.starts)
    return {"h": h, "v": v, "u": u, "a": a, "z": z, "p": _sigmoid(z @ model["c"] + model["b"])}


def gradients(model: dict, bags: Bags, y: np.ndarray) -> dict:
    """Of the mean log loss, with decay."""
    f = forward(model, bags)
    g = (f["p"] - y) / len(y)
    dz = np.outer(g, model["c"])[bags.of]
    da = (dz * f["h"]).sum(1)
    da = f["a"] * (da - np.add.reduceat(f["a"] * da, bags.starts)[bags.of])
    gate = np.outer(da, model["w"])
    dv, du = gate * f["u"] * (1 - f["v"] ** 2), gate * f["v"] * f["u"] * (1 - f["u"])
    dh = (dz * f["a"][:, None] + dv @ model["V"].T + du @ model["U"].T) * (1 - f["h"] ** 2)
    out = {"E": bags.x.T @ dh, "e": dh.sum(0), "V": f["h"].T @ dv, "U": f["h"].T @ du, "w": (f["v"] * f["u"]).T @ da, "c": f["z"].T @ g, "b": g.sum()}
    return {k: v + 1e-4 * model[k] for k, v in out.items()}


def fit(rows: list[tuple[np.ndarray, int]], epochs: int = EPOCHS, batch: int = 64, seed: int = 5) -> dict:
    """Adam over shuffled batches of (passage features, label)."""
    rng = np.random.default_rng(seed)
    x = np.concatenate([r[0] for r in rows])
    mean, scale = x.mean(0), x.std(0) + np.float32(0.02)
    del x
    model = {"E": rng.normal(0, FEATURES**-0.5, (FEATURES, HIDDEN)), "e": np.zeros(HIDDEN), "V": rng.normal(0, HIDDEN**-0.5, (HIDDEN, GATES)), "U": rng.normal(0, HIDDEN**-0.5, (HIDDEN, GATES)), "w": rng.normal(0, 0.3, GATES), "c": rng.normal(0, 0.3, HIDDEN), "b": np.zeros(())}
    first, second = ({k: np.zeros_like(v) for k, v in model.items()} for _ in range(2))
    step = 0
    bags = [((r[0] - mean) / scale, r[1]) for r in rows]
    for epoch in range(epochs):
        order = rng.permutation(len(bags))
        rate = 0.01 * (1 - epoch / epochs)
        for at in range(0, len(order), batch):
            some = [bags[i] for i in order[at : at + batch]]
            together = Bags(np.concatenate([b[0] for b in some]), np.concatenate([[0], np.cumsum([len(b[0]) for b in some])]))
            step += 1
            for k, g in gradients(model, together, np.array([b[1] for b in some], float)).items():
                first[k] = 0.9 * first[k] + 0.1 * g
                second[k] = 0.999 * second[k] + 0.001 * g * g
                model[k] = model[k] - rate * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8)
    return model | {"mean": mean, "scale": scale}


def held_out(doc_id: Column) -> Column:
    """True for the rows that labels are never learnt from."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 4 == 2


def _described(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part in slices(batches):
        x, bounds = passages(part.column(1))
        rows = [x[a:b].tobytes() for a, b in zip(bounds[:-1], bounds[1:])]
        yield pa.RecordBatch.from_arrays([part.column(0), pa.array(rows, pa.binary())], names=["label", "x"])


def train(docs: DataFrame, labels: DataFrame, label: str = "quality") -> dict | None:
    """Fit on at most about TRAIN_DOCS labelled documents outside the held-out quarter; None without any."""
    known = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(label).cast("int").alias("label"))
    share = TRAIN_DOCS / max(1, known.count())
    if share < 1:
        known = known.where(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < int(share * 1_000_000))
    sample = docs.select(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(known), "doc_id").select("label", "text")
    found = sample.mapInArrow(_described, "label int, x binary").toArrow()
    rows = [(np.frombuffer(x.as_buffer(), np.float32).reshape(-1, FEATURES), y.as_py()) for x, y in zip(found.column("x"), found.column("label"))]
    model = fit(rows) if rows else None
    del found, rows
    pa.default_memory_pool().release_unused()
    return model


def _scored(model: dict | None, column: int, name: str):
    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ps = []
            text = pa.RecordBatch.from_arrays([batch.column(column)], names=["text"])
            for part in slices([text]):
                x, bounds = passages(part.column(0))
                ps.append(forward(model, Bags((x - model["mean"]) / model["scale"], bounds))["p"] if model else np.full(part.num_rows, 0.5))
            if ps:
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.concatenate(ps))], names=[*batch.schema.names, name])

    return score


def scored(docs: DataFrame, model: dict | None, name: str = "quality_score") -> DataFrame:
    """docs with a column of that name, in one pass; docs must not have it yet."""
    small_batches(docs.sparkSession)
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema) + f", `{name}` double"
    return docs.mapInArrow(_scored(model, docs.columns.index("text"), name), fields)


def quality_scores(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per row of docs: doc_id, held_out, score, predicted."""
    slim = docs.select("doc_id", "text")
    return scored(slim, train(docs, labels)).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), F.col("quality_score").alias("score"), (F.col("quality_score") >= THRESHOLD).cast("int").alias("predicted"))
