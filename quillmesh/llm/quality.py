"""Quality classifier: a factorisation machine over hashed words, structure and metadata.

The features of a text are the shares of its words, hashed to buckets; binned statistics of its structure; and
its binned length column, where there is one. The machine scores w0 + sum w_i x_i + sum over pairs of
<v_i, v_j> x_i x_j; the pairs take linear time by half the sum over factors of (sum v x)^2 - sum v^2 x^2.
It is trained by AdaGrad in numpy on a bounded sample of labelled texts and calibrated to the label shares.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import labelled_sample

BUCKETS = 1 << 14
BINS = 10
FACTORS = 8
#: Bounds of the training sample: labelled texts per class, and characters of the longest.
PER_CLASS, LONGEST = 3000, 50_000
#: Passes over the sample, but at least ``STEPS`` batches.
EPOCHS, STEPS, RATE, BATCH, RIDGE = 5, 500, 0.1, 64, 1e-4
#: Bytes looked at in one go; a longer word counts as several.
CHUNK = 1 << 20

STATS = ("log_words", "word_length", "upper", "digit", "other", "marks", "bars", "bangs", "distinct", "repeats", "lines", "wide")
ODD = 0x9E3779B97F4A7C15 | 1
with np.errstate(over="ignore"):
    POWERS = np.concatenate(([np.uint64(1)], np.full(CHUNK, ODD, np.uint64))).cumprod(dtype=np.uint64)
    BACK = np.concatenate(([np.uint64(1)], np.full(CHUNK, pow(ODD, -1, 1 << 64), np.uint64))).cumprod(dtype=np.uint64)
LOWER = bytes(i + 32 if 65 <= i <= 90 else i for i in range(256))
#: Classes of bytes: upper case, digit, other ASCII sign, runs of spam marks, bar, exclamation mark, line end, not ASCII.
CLASSES = np.zeros((256, 8), np.int64)
for _i in range(256):
    _c = chr(_i)
    CLASSES[_i] = [_i < 128 and _c.isupper(), _i < 128 and _c.isdigit(), 32 < _i < 128 and not _c.isalnum(), _c in "%#&*$", _c == "|", _c == "!", _c == "\n", _i >= 128]


def chunks(data: bytes) -> Iterator[bytes]:
    """Parts of at most ``CHUNK`` bytes, cut at a space where there is one."""
    lo = 0
    while lo < len(data):
        hi = lo + CHUNK
        if hi < len(data):
            hi = max(data.rfind(b" ", lo + 1, hi), data.rfind(b"\n", lo + 1, hi))
            hi = hi if hi > lo else lo + CHUNK
        yield data[lo:hi]
        lo = hi


def word_hashes(part: bytes) -> np.ndarray:
    """A hash of each word (run of bytes above the space) of at most ``CHUNK`` bytes: the polynomial of its
    bytes, from prefix sums modulo 2^64."""
    data = np.frombuffer(part, np.uint8)
    inside = np.concatenate(([False], data > 32, [False]))
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    starts, ends = edges[::2], edges[1::2]
    sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(data * POWERS[: len(data)], dtype=np.uint64)))
    return (sums[ends] - sums[starts]) * BACK[starts] * np.uint64(0xD6E8FEB86659FD93)


def features(text: str | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(buckets of the words, their shares, statistics) of the whole text."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    totals, words = np.zeros(8, np.int64), []
    for part in chunks(raw):
        totals += np.bincount(np.frombuffer(part, np.uint8), minlength=256) @ CLASSES
        words.append(word_hashes(part.translate(LOWER)))
    hashes = np.concatenate(words) if words else np.empty(0, np.uint64)
    n, size = max(1, len(hashes)), max(1, len(raw))
    upper, digit, other, marks, bars, bangs, lines, wide = (totals / size).tolist()
    buckets, counts = np.unique((hashes >> np.uint64(50)).astype(np.int64), return_counts=True)
    repeats = float((hashes[1:] == hashes[:-1]).sum()) / n
    stats = np.array([np.log1p(len(hashes)), len(raw) / n, upper, digit, other, marks, bars, bangs, len(np.unique(hashes)) / n, repeats, lines, wide])
    return buckets, counts / n, stats


@dataclass
class Model:
    """Bin edges of the statistics and the length column, and the machine's weights."""

    edges: np.ndarray = field(default_factory=lambda: np.zeros((len(STATS) + 1, BINS - 1)))
    base: float = 0.0
    w: np.ndarray = field(default_factory=lambda: np.zeros(BUCKETS + (len(STATS) + 1) * (BINS + 1)))
    v: np.ndarray = field(default_factory=lambda: np.zeros((BUCKETS + (len(STATS) + 1) * (BINS + 1), FACTORS)))

    def row(self, text: str | None, length: int | None) -> tuple[np.ndarray, np.ndarray]:
        """Indices and values of the features that are not 0; a null length has a bin of its own."""
        buckets, shares, stats = features(text)
        k = len(STATS) + 1
        values = np.append(stats, np.log1p(max(0, length or 0)))
        bins = (self.edges < values[:, None]).sum(1)
        if length is None:
            bins[-1] = BINS
        at = BUCKETS + np.arange(k) * (BINS + 1) + bins
        return np.concatenate((buckets, at)), np.concatenate((shares, np.full(k, 1 / np.sqrt(k))))

    def score(self, text: str | None, length: int | None = None) -> float:
        at, x = self.row(text, length)
        vx = self.v[at] * x[:, None]
        z = self.base + self.w[at] @ x + 0.5 * ((vx.sum(0) ** 2).sum() - (vx**2).sum())
        return float(1 / (1 + np.exp(-np.clip(z, -30, 30))))


def train(sample: list[tuple], counts: dict[int, int], seed: int = 3) -> Model:
    """A model of labelled texts, as (text, label) or (text, label, length column); without texts of both classes it
    gives every text the share of good labels."""
    sample = [(t, y, more[0] if more else len(t)) for t, y, *more in sample]
    model = Model()
    good, bad = counts.get(1, 0), counts.get(0, 0)
    model.base = float(np.log((good + 1) / (bad + 1)))
    if len({y for _, y, _ in sample}) < 2:
        return model
    y = np.array([k for _, k, _ in sample], float)
    cuts = np.linspace(0, 1, BINS + 1)[1:-1]
    model.edges[:-1] = np.quantile([features(t)[2] for t, _, _ in sample], cuts, axis=0).T
    known = [np.log1p(max(0, n)) for _, _, n in sample if n is not None]
    if known:
        model.edges[-1] = np.quantile(known, cuts)
    rows = [model.row(t, n) for t, _, n in sample]
    rng = np.random.default_rng(seed)
    weight = np.where(y == 1, good / max(1, y.sum()), bad / max(1, (1 - y).sum()))
    weight *= len(y) / weight.sum()
    model.v = rng.normal(0, 0.05, model.v.shape)
    gw, gv, gb = np.full(len(model.w), 1e-6), np.full(model.v.shape, 1e-6), 1e-6
    for _ in range(max(EPOCHS, -(-STEPS * BATCH // len(rows)))):
        order = rng.permutation(len(rows))
        for lo in range(0, len(order), BATCH):
            some = order[lo : lo + BATCH]
            at, x = np.concatenate([rows[i][0] for i in some]), np.concatenate([rows[i][1] for i in some])
            sizes = np.array([len(rows[i][0]) for i in some])
            first, row = np.cumsum(sizes) - sizes, np.repeat(np.arange(len(some)), sizes)
            vx = model.v[at] * x[:, None]
            s = np.add.reduceat(vx, first)
            z = model.base + np.add.reduceat(model.w[at] * x, first) + 0.5 * ((s**2).sum(1) - np.add.reduceat((vx**2).sum(1), first))
            error = weight[some] * (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y[some]) / len(some)
            ex = error[row] * x
            used, inverse = np.unique(at, return_inverse=True)
            dw = np.bincount(inverse, ex) + RIDGE * model.w[used]
            push = ex[:, None] * (s[row] - vx)
            dv = np.stack([np.bincount(inverse, push[:, f]) for f in range(FACTORS)], 1) + RIDGE * model.v[used]
            gw[used] += dw**2
            gv[used] += dv**2
            model.w[used] -= RATE * dw / np.sqrt(gw[used])
            model.v[used] -= RATE * 0.3 * dv / np.sqrt(gv[used])
            db = error.sum()
            gb += db**2
            model.base -= RATE * db / np.sqrt(gb)
    # factors of features that the sample never had say nothing
    model.v[gv[:, 0] <= 1e-6] = 0
    return model


def learn(docs: DataFrame, labels: DataFrame, allowed: Column, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", per_class: int = PER_CLASS, longest: int = LONGEST, length_col: str | None = "n_chars") -> Model:
    """A model of the labelled rows that ``allowed`` (a condition on the label table) lets through, from a
    sample bounded by ``per_class`` and ``longest``. ``length_col`` as in :func:`score`."""
    return train(*labelled_sample(docs, labels, label_col, allowed, per_class, longest, id_col, text_col, length_of(length_col)))


def length_of(length_col: str | None) -> Column:
    return F.lit(None).cast("long") if length_col is None else F.col(length_col).cast("long")


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", length_col: str | None = "n_chars") -> DataFrame:
    """``id_col`` and ``score`` (0 to 1) of every row's whole text.

    ``length_col`` is the metadata column with the text's length; a null there, or None, has a bin of its
    own. A null text counts as empty. Rows stay one to one; other columns are not looked at."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [shared.value.score(t.as_py(), n.as_py()) for t, n in zip(batch.column(1), batch.column(2))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.float64())], names=[id_col, "score"])

    slim = docs.select(F.col(id_col), F.col(text_col).cast("string"), length_of(length_col).alias("_length"))
    return slim.mapInArrow(run, f"`{id_col}` {docs.schema[id_col].dataType.simpleString()}, score double")
