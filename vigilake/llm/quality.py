"""Quality classifier by attention-based multiple-instance learning.

A document is a bag of passages (windows of ``PASSAGE`` bytes of its whole text). Each passage is
encoded from its bytes: shares of character classes, doubled symbols, case, word lengths and
repeated words, through a learned layer. Gated attention, learned from document labels alone,
weighs the passages; the score is a logistic function of the weighted representation.

Training fits on at most ``TRAIN_DOCS`` labelled rows (those of lowest id hash), the bound being a
parameter; scoring covers every row and whole text. Labels, languages, sources and ids are never
inputs of a score, so equal texts get equal scores.

Nulls: a null text is empty; an empty text is a bag of one blank passage. Null ids are carried
(and count as the empty text for the fold); null labels are left out. Without both labels among
the training rows the score is their share of ones (0.5 without rows). Repeated rows are scored
one by one. Extra columns are ignored by ``score`` and kept by ``keep_good``. An empty table gives
no rows.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from vigilake.llm.bpe import in_small_lots
from vigilake.llm.common import crc_mod, map_rows, small_batches, table

PASSAGE = 512
TRAIN_DOCS = 6_000
FOLDS, HELD_OUT = 4, 2
BAR = 0.7
HIDDEN, GATES, EPOCHS, RATE, DECAY = 16, 8, 150, 0.02, 1e-4

_KINDS = ["aeiouy", "bcdfghjklmnpqrstvwxz", "AEIOUY", "BCDFGHJKLMNPQRSTVWXZ", "0123456789", " ", "\n\r\t\x0b\x0c", ".,", "!?", "#$%&*@^~", "|", ":;-_/\\+=", "\"'`()[]{}<>"]
_CLASS = np.full(256, len(_KINDS), np.uint8)  # what is left: control characters
for _k, _chars in enumerate(_KINDS):
    _CLASS[list(_chars.encode())] = _k
_CLASS[128:] = len(_KINDS) + 1
CLASSES = len(_KINDS) + 2
_BLANK = np.isin(np.arange(256), list(b" \n\r\t\x0b\x0c"))
_UPPER = np.isin(np.arange(256), np.arange(65, 91))
_SYMBOL = (_CLASS >= 8) & (_CLASS <= 12)
_MIX = np.random.default_rng(11).integers(1, 2**63, 256, dtype=np.uint64)
LAGS = (1, 2, 3, 4, 5, 6, 8)
FEATURES = CLASSES + 7 + len(LAGS)


def passages(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Features of every passage, and the number of passages of each text (1 for an empty one)."""
    encoded = [(t or "").encode() or b" " for t in texts]
    size = np.array([len(e) for e in encoded])
    raw = np.frombuffer(b"".join(encoded), np.uint8)
    count = -(-size // PASSAGE)
    begin = np.cumsum(size) - size
    n = int(count.sum())
    starts = np.repeat(begin, count) + (np.arange(n) - np.repeat(np.cumsum(count) - count, count)) * PASSAGE
    width = np.diff(np.append(starts, len(raw))).astype(np.float64)
    where = np.repeat(np.arange(n, dtype=np.int64), width.astype(np.int64))
    out = np.zeros((n, FEATURES))
    out[:, :CLASSES] = np.bincount(where * CLASSES + _CLASS[raw], minlength=n * CLASSES).reshape(n, CLASSES) / width[:, None]

    blank = _BLANK[raw]
    doubled = np.zeros(len(raw), bool)
    doubled[1:] = (raw[1:] == raw[:-1]) & _SYMBOL[raw[1:]]
    out[:, CLASSES] = np.add.reduceat(doubled, starts, dtype=np.int64) / width
    head = ~blank
    head[1:] &= blank[:-1]
    head[begin] = ~blank[begin]
    at = np.flatnonzero(head)
    if len(at):
        mine = where[at]
        words = np.bincount(mine, minlength=n)
        some = np.maximum(words, 1)
        mean = lambda v: np.bincount(mine, v, minlength=n) / some
        length = np.add.reduceat(~blank, at, dtype=np.int64)
        caps = np.add.reduceat(_UPPER[raw], at, dtype=np.int64)
        doc = np.searchsorted(begin, at, side="right")
        value = np.add.reduceat(np.where(blank, 0, _MIX[raw]).astype(np.uint64), at) * np.uint64(31) + length.astype(np.uint64)
        out[:, CLASSES + 1] = np.log1p(words) / 5
        out[:, CLASSES + 2] = mean(length) / 10
        out[:, CLASSES + 3] = np.sqrt(np.maximum(0, mean(length.astype(float) ** 2) - mean(length) ** 2)) / 10
        out[:, CLASSES + 4] = mean(_UPPER[raw[at]])
        out[:, CLASSES + 5] = mean((caps == length) & (length > 1))
        out[:, CLASSES + 6] = mean(_SYMBOL[raw[np.minimum(at + length - 1, len(raw) - 1)]])
        for k, lag in enumerate(LAGS):
            same = np.zeros(len(at), bool)
            same[lag:] = (value[lag:] == value[:-lag]) & (doc[lag:] == doc[:-lag])
            out[:, CLASSES + 7 + k] = mean(same)
    return out, count


@dataclass
class Model:
    """Encoder W, gates V and U, attention w, head c; inputs are centred and scaled first."""

    centre: np.ndarray
    scale: np.ndarray
    weights: dict[str, np.ndarray]

    def forward(self, x: np.ndarray, count: np.ndarray) -> dict[str, np.ndarray]:
        """Everything up to the score; softmax runs inside each bag."""
        w = self.weights
        h = np.tanh(x @ w["W"] + w["Wb"])
        t, s = np.tanh(h @ w["V"]), 1 / (1 + np.exp(-np.clip(h @ w["U"], -40, 40)))
        e = (t * s) @ w["w"]
        starts = np.cumsum(count) - count
        e = np.exp(e - np.repeat(np.maximum.reduceat(e, starts), count))
        a = e / np.repeat(np.add.reduceat(e, starts), count)
        z = np.add.reduceat(a[:, None] * h, starts, axis=0)
        y = 1 / (1 + np.exp(-np.clip(z @ w["c"] + w["cb"], -40, 40)))
        return {"x": x, "h": h, "t": t, "s": s, "a": a, "z": z, "y": y}

    def score(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Score of each text, its passage of most weight, and that weight."""
        x, count = passages(texts)
        f = self.forward((x - self.centre) / self.scale, count)
        starts = np.cumsum(count) - count
        most = np.maximum.reduceat(f["a"], starts)
        top = np.flatnonzero(f["a"] == np.repeat(most, count))
        first = top[np.searchsorted(top, starts)] - starts
        return f["y"], first, most


def fit(x: np.ndarray, count: np.ndarray, label: np.ndarray, seed: int = 5) -> Model:
    """Adam on the mean log loss of the bags."""
    centre, scale = x.mean(axis=0), x.std(axis=0) + 1e-3
    rng = np.random.default_rng(seed)
    init = lambda *s: rng.normal(0, 1 / np.sqrt(s[0]), s)
    w = {"W": init(FEATURES, HIDDEN), "Wb": np.zeros(HIDDEN), "V": init(HIDDEN, GATES), "U": init(HIDDEN, GATES), "w": init(GATES), "c": init(HIDDEN), "cb": np.zeros(())}
    share = float(label.mean()) if len(label) else 0.5
    model = Model(centre, scale, w)
    if not len(label) or not 0 < share < 1:
        w["c"] = np.zeros(HIDDEN)
        w["cb"] = np.array(np.log((share + 1e-9) / (1 - share + 1e-9)) if len(label) else 0.0)
        return model
    x = (x - centre) / scale
    starts, n = np.cumsum(count) - count, len(label)
    m1, m2 = ({k: np.zeros_like(v) for k, v in w.items()} for _ in range(2))
    for step in range(1, EPOCHS + 1):
        f = model.forward(x, count)
        dy = (f["y"] - label) / n
        g = {"c": f["z"].T @ dy, "cb": dy.sum()}
        dz = np.repeat(dy[:, None] * w["c"], count, axis=0)
        da = (dz * f["h"]).sum(axis=1)
        de = f["a"] * (da - np.repeat(np.add.reduceat(f["a"] * da, starts), count))
        dg = de[:, None] * w["w"]
        dt, ds = dg * f["s"] * (1 - f["t"] ** 2), dg * f["t"] * f["s"] * (1 - f["s"])
        g["w"], g["V"], g["U"] = (f["t"] * f["s"]).T @ de, f["h"].T @ dt, f["h"].T @ ds
        dh = (f["a"][:, None] * dz + dt @ w["V"].T + ds @ w["U"].T) * (1 - f["h"] ** 2)
        g["W"], g["Wb"] = x.T @ dh, dh.sum(axis=0)
        for k in w:
            d = g[k] + DECAY * w[k]
            m1[k] = 0.9 * m1[k] + 0.1 * d
            m2[k] = 0.999 * m2[k] + 0.001 * d * d
            w[k] = w[k] - RATE * (m1[k] / (1 - 0.9**step)) / (np.sqrt(m2[k] / (1 - 0.999**step)) + 1e-8)
    return model


def is_held_out(doc_id: Column) -> Column:
    return crc_mod(doc_id, FOLDS) == HELD_OUT


def train(docs: DataFrame, labels: DataFrame, most: int = TRAIN_DOCS) -> Model:
    """Fit on at most ``most`` labelled rows outside the held-out fold."""
    known = labels.select("doc_id", F.col("quality").cast("int").alias("quality")).filter("quality IN (0, 1) AND doc_id IS NOT NULL")
    known = known.filter(~is_held_out(F.col("doc_id"))).orderBy(F.xxhash64("doc_id"), "doc_id", "quality").limit(most)
    # at most ``most`` rows of 12 bytes are broadcast
    rows = docs.select("doc_id", "text").join(F.broadcast(known), "doc_id")

    def make():
        def work(batch):
            x, count = passages(batch["text"]) if batch["text"] else (np.zeros((0, FEATURES)), np.zeros(0, int))
            parts = np.split(x, np.cumsum(count)[:-1]) if len(count) else []
            return {"doc_id": batch["doc_id"], "quality": batch["quality"], "x": [p.astype("<f4").tobytes() for p in parts]}

        return work

    got = map_rows(rows.select("doc_id", "quality", "text"), "doc_id long, quality int, x binary", make).collect()
    got = sorted(got, key=lambda r: (r["doc_id"], r["quality"], bytes(r["x"])))
    x = [np.frombuffer(r["x"], "<f4").reshape(-1, FEATURES).astype(np.float64) for r in got]
    if not x:
        return fit(np.zeros((1, FEATURES)), np.ones(1, int), np.zeros(0))
    return fit(np.concatenate(x), np.array([len(p) for p in x]), np.array([r["quality"] for r in got], float))


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, score, predicted, top_passage and top_weight (of the attention) of every row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # a few thousand numbers

    def make():
        def work(batch):
            got = [shared.value.score(lot) for lot in in_small_lots(batch["text"], 500_000)]
            y, top, weight = (np.concatenate(c).tolist() if got else [] for c in zip(*got)) if got else ([], [], [])
            return {"doc_id": batch["doc_id"], "score": y, "predicted": [int(v >= BAR) for v in y], "top_passage": top, "top_weight": weight}

        return work

    schema = "doc_id long, score double, predicted int, top_passage int, top_weight double"
    return map_rows(docs.select("doc_id", "text"), schema, make)


def keep_good(docs: DataFrame, model: Model) -> DataFrame:
    """``docs`` without the rows that the model rejects."""
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for b in batches:
            texts = b.column(b.schema.names.index("text")).to_pylist()
            got = [shared.value.score(lot)[0] for lot in in_small_lots(texts, 500_000)]
            if got:
                yield b.filter(pa.array(np.concatenate(got) >= BAR))

    return docs.mapInArrow(run, docs.schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op1 over all documents."""
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    model = train(docs, table(spark, sf_dir, "labels", "doc_id", "quality"))
    out = score(docs, model)
    return out.select("doc_id", is_held_out(F.col("doc_id")).alias("held_out"), "score", "predicted", "top_passage", "top_weight")
