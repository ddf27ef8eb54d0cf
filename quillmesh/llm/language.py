"""Language identification: averaged hashed subword embeddings under a linear softmax.

A text's subwords are the byte 3-grams and 4-grams of its lower-cased letters with a space at each end of a
word; each is hashed to a row of an embedding matrix, the rows are averaged and a linear layer with softmax
gives the languages' probabilities. Both matrices are trained together by stochastic gradient descent in
numpy. A temperature, and per language the probability below which a prediction is rejected, are calibrated
on a part of the sample that training does not see.

The average times the linear layer equals the average of (embedding times layer), so with few languages scoring
adds up one row of that product for every subword of the whole text; with more of them than the embedding has
dimensions, it averages the embedding's rows and applies the layer once. Either is linear in the text.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

UNKNOWN = "und"
BUCKETS = 1 << 15
DIM = 16
SIZES = (3, 4)
#: Bounds of the training sample: texts per language, and in all; every language has one at least, however many
#: there are. Texts of at most ``LONGEST`` characters go first, longer ones where a language has too few of these.
PER_LANG, IN_ALL, LONGEST = 1000, 40_000, 20_000
#: Passes over the sample, but at least ``STEPS`` batches.
EPOCHS, STEPS, RATE, BATCH = 6, 600, 8.0, 64
#: The share of a language's own texts in the calibration part that its threshold may reject.
REJECTED = 0.01
CHUNK = 1 << 20

#: ASCII letters and bytes of other characters stay; anything else is a space.
TABLE = bytes(i if i >= 128 or chr(i).isalpha() else 32 for i in range(256))


def has_letter(text: str) -> bool:
    return any(c.isalpha() for c in text)


def letters(text: str) -> bytes:
    """Lower case as UTF-8, with one space for what is no letter, and one at each end."""
    return b" " + b" ".join(text.lower().encode("utf-8", "surrogatepass").translate(TABLE).split()) + b" "


def subwords(data: bytes) -> Iterator[np.ndarray]:
    """Buckets of the subwords, in chunks. Grams that span a space inside are left out."""
    whole = np.frombuffer(data, np.uint8)
    for lo in range(0, len(whole), CHUNK):
        part = whole[lo : lo + CHUNK + max(SIZES) - 1]
        space = part == 32
        wide = part.astype(np.uint32)
        for size in SIZES:
            n = min(CHUNK, len(part) - size + 1)
            if n <= 0:
                continue
            key = np.zeros(n, np.uint32)
            crossed = np.zeros(n, bool)
            for k in range(size):
                key = key * np.uint32(257) + wide[k : k + n]
                if 0 < k < size - 1:
                    crossed |= space[k : k + n]
            key = (key ^ np.uint32(size)) * np.uint32(2654435761) >> np.uint32(32 - 15)
            yield key[~crossed]


def bag(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of a text and their shares."""
    counts = np.zeros(BUCKETS, np.int64)
    for part in subwords(letters(text)):
        counts += np.bincount(part, minlength=BUCKETS)
    at = np.flatnonzero(counts)
    return at, counts[at] / max(1, counts.sum())


@dataclass
class Model:
    """Languages in order, embedding and layer (or their product and none), temperature and rejection thresholds."""

    langs: list[str] = field(default_factory=list)
    table: np.ndarray = field(default_factory=lambda: np.zeros((BUCKETS, 0), np.float32))
    layer: np.ndarray | None = None
    bias: np.ndarray = field(default_factory=lambda: np.zeros(0))
    scale: float = 1.0
    least: np.ndarray = field(default_factory=lambda: np.zeros(0))

    def logits(self, text: str) -> np.ndarray:
        total, n = np.zeros(self.table.shape[1]), 0
        for part in subwords(letters(text)):
            total += np.take(self.table, part, axis=0).sum(axis=0, dtype=np.float64)
            n += len(part)
        mean = total / max(1, n)
        return (mean if self.layer is None else mean @ self.layer) + self.bias

    def probabilities(self, logits: np.ndarray) -> np.ndarray:
        z = logits * self.scale
        e = np.exp(z - z.max(axis=-1, keepdims=True))
        return e / e.sum(axis=-1, keepdims=True)

    def predict(self, text: str | None) -> tuple[str, float, bool]:
        """(language, probability, whether the prediction is rejected)."""
        if not text or not self.langs or not has_letter(text):
            return UNKNOWN, 0.0, True
        p = self.probabilities(self.logits(text))
        k = int(p.argmax())
        return self.langs[k], float(p[k]), bool(p[k] < self.least[k])


Bag = tuple[np.ndarray, np.ndarray]


def fit(sample: list[tuple[str, str]], seed: int = 1) -> Model:
    """A model of (text, language) rows; texts without a letter are left out."""
    return fit_bags([(bag(t), y) for t, y in sample if t and has_letter(t)], seed)


def fit_bags(rows: list[tuple[Bag, str]], seed: int = 1) -> Model:
    """A model of (bag, language) rows. Without rows: a model that knows no language."""
    model = Model(langs=sorted({y for _, y in rows}))
    if not rows:
        return model
    rng, k = np.random.default_rng(seed), len(model.langs)
    model.least = np.zeros(k)
    number = {y: i for i, y in enumerate(model.langs)}
    bags = [b for b, _ in rows]
    y = np.array([number[l] for _, l in rows])
    held = rng.random(len(rows)) < 0.15 if len(rows) > 50 * k else np.zeros(len(rows), bool)
    own = np.flatnonzero(~held)
    weight = 1.0 / np.bincount(y[own], minlength=k).clip(1)
    weight *= len(own) / (weight[y[own]].sum() or 1)
    emb = (rng.random((BUCKETS, DIM)) - 0.5) / DIM
    layer, bias = np.zeros((DIM, k)), np.zeros(k)
    epochs = max(EPOCHS, -(-STEPS // -(-len(own) // BATCH)))
    for epoch in range(epochs):
        rate = RATE * (1 - epoch / epochs)
        order = rng.permutation(own)
        for lo in range(0, len(order), BATCH):
            some = order[lo : lo + BATCH]
            mean = np.stack([bags[i][1] @ emb[bags[i][0]] for i in some])
            z = mean @ layer + bias
            p = np.exp(z - z.max(1, keepdims=True))
            p /= p.sum(1, keepdims=True)
            p[np.arange(len(some)), y[some]] -= 1
            p *= weight[y[some]][:, None] / len(some)
            back = p @ layer.T
            layer -= rate * 0.1 * mean.T @ p
            bias -= rate * 0.005 * p.sum(0)
            for j, i in enumerate(some):
                emb[bags[i][0]] -= (rate * bags[i][1])[:, None] * back[j]
    model.bias = bias
    if k <= DIM:
        model.table = (emb @ layer).astype(np.float32)
    else:
        model.table, model.layer = emb.astype(np.float32), layer
    check = np.flatnonzero(held) if held.any() else own
    mean = np.stack([bags[i][1] @ model.table[bags[i][0]] for i in check])
    z = (mean if model.layer is None else mean @ model.layer) + bias
    scales = np.geomspace(0.2, 5, 60)
    losses = []
    for s in scales:
        model.scale = s
        losses.append(-np.log(model.probabilities(z)[np.arange(len(check)), y[check]] + 1e-12).mean())
    model.scale = float(scales[int(np.argmin(losses))])
    p = model.probabilities(z)
    for i in range(k):
        right = p[(y[check] == i) & (p.argmax(1) == i), i]
        model.least[i] = np.quantile(right, REJECTED) if len(right) else 0.0
    return model


def learn(docs: DataFrame, allowed: Column, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", per_lang: int = PER_LANG, in_all: int = IN_ALL, longest: int = LONGEST) -> Model:
    """A model from rows that ``allowed`` lets through and whose language and text are not null, with every
    language that such rows have.

    Of each language come the first ``per_lang`` texts by a hash of the row, those of at most ``longest``
    characters before longer ones; of ``in_all`` texts every language has an equal part, and one at least. The
    driver gets bags of subwords, at most ``BUCKETS`` numbers for a text however long it is.

    Two passes over the rows, whatever the number of languages. The second keeps a hash range that holds about
    twice as many rows as are wanted, and the planner limits each language before the shuffle."""
    text, lang = F.col(text_col).cast("string"), F.col(lang_col).cast("string")
    rows = docs.where(allowed & lang.isNotNull() & text.isNotNull())
    short = F.length(text) <= longest
    counts = rows.groupBy(lang.alias("y")).agg(F.count("*").alias("n"), F.count_if(short).alias("short")).collect()
    if not counts:
        return fit([])
    per_lang = max(1, min(per_lang, in_all // len(counts)))
    # where a language has too few short texts its long ones join, all in the same hash order
    ranges = [(r.y, r.short >= per_lang, min(1 << 20, max(1, -(-(2 * per_lang + 50) * (1 << 20) // (r.short if r.short >= per_lang else r.n))))) for r in counts]
    most = docs.sparkSession.createDataFrame(ranges, "_y string, _only boolean, _most long")
    hashed = F.xxhash64(id_col, text)
    some = rows.select(lang.alias("_y"), text.alias("_t"), hashed.alias("_h"), short.alias("_short"))
    some = some.join(F.broadcast(most), "_y").where((F.pmod("_h", F.lit(1 << 20)) < F.col("_most")) & (F.col("_short") | ~F.col("_only")))
    w = Window.partitionBy("_y").orderBy(F.desc("_short"), "_h", "_t")
    picks = some.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= per_lang)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bags = [bag(t.as_py()) if has_letter(t.as_py()) else None for t in batch.column(2)]
            columns = [pa.array([None if b is None else b[k].astype(kind).tobytes() for b in bags], pa.binary()) for k, kind in enumerate(("<u2", "<f4"))]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *columns], names=["y", "n", "at", "share"])

    bags = picks.select("_y", F.col("_n").cast("long"), "_t").mapInArrow(run, "y string, n long, at binary, share binary").where("at IS NOT NULL")
    found = sorted(bags.collect(), key=lambda r: (r.y, r.n))
    return fit_bags([((np.frombuffer(r["at"], "<u2").astype(np.int64), np.frombuffer(r.share, "<f4").astype(np.float64)), r.y) for r in found])


def predict(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col``, ``lang_pred``, ``score`` and ``rejected`` for every row's whole text.

    Null texts and texts without a letter are ``und`` with score 0, as all are where the model knows no
    language. Rows stay one to one; other columns are not looked at."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [shared.value.predict(t.as_py()) for t in batch.column(1)]
            columns = [pa.array([r[k] for r in rows], kind) for k, kind in enumerate((pa.string(), pa.float64(), pa.bool_()))]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], names=[id_col, "lang_pred", "score", "rejected"])

    slim = docs.select(id_col, F.col(text_col).cast("string"))
    return slim.mapInArrow(run, f"`{id_col}` {docs.schema[id_col].dataType.simpleString()}, lang_pred string, score double, rejected boolean")
