"""Quality classifier: a generalised additive model with pairwise interactions.

Features are measured from the whole text. Fitting is cyclic boosting: in each round every
feature in turn gets a shallow tree (three leaves over its bins) on the current gradient,
whose leaf values are added to the feature's look-up table; then the pairs of features
with the largest gain do the same with two-by-two trees. A score is the sigmoid of an
intercept and one table entry for each feature and pair: array look-ups and additions.

The model is fitted on at most ``FIT_ROWS`` labelled rows, those of smallest hash of the
document's id, and scores every row.

Defined results: a null or empty text is scored from zero features; labels that are null
are ignored; with labels of one class, or none, every score is the smoothed base rate;
equal texts have equal scores; an empty table gives an empty table; other columns are
ignored.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass, field
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import trimmed

#: Most labelled rows that a model is fitted on.
FIT_ROWS = 20_000
FEATURES = (
    "log_words", "word_length", "distinct_words", "upper_words", "repeated_next", "short_words", "digits", "upper_ascii", "sentence_marks", "commas", "exclamations", "pipes",
    "symbols", "lines_per_word", "distinct_lines", "top_word",
)
_SYMBOLS = np.frombuffer(b"*#%&$@^~=_<>\\{}[]/+", np.uint8)


def measure(text: str) -> list[float]:
    """The features of one text, in the order of FEATURES."""
    data = np.bincount(np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8), minlength=256)
    words = text.split()
    n = max(len(words), 1)
    total = max(int(data.sum()), 1)
    seen = Counter(words)
    lines = [x for x in text.split("\n") if x.strip()]
    length = sum(map(len, words))
    short = sum(map((4).__gt__, map(len, words)))
    return [
        float(np.log1p(len(words))),
        length / n,
        len(seen) / n,
        sum(map(str.isupper, words)) / n,
        sum(map(eq, words, words[1:])) / n,
        short / n,
        float(data[48:58].sum()) / total,
        float(data[65:91].sum()) / total,
        float(data[46] + data[63]) / n,
        float(data[44] + data[59] + data[58]) / n,
        float(data[33]) / n,
        float(data[124]) / n,
        float(data[_SYMBOLS].sum()) / n,
        len(lines) / n,
        len(set(lines)) / max(len(lines), 1),
        max(seen.values(), default=0) / n,
    ]


def measure_all(texts: list[str | None]) -> np.ndarray:
    return np.array([measure(t or "") for t in texts], np.float64).reshape(len(texts), len(FEATURES))


@dataclass
class Model:
    intercept: float = 0.0
    cuts: list[np.ndarray] = field(default_factory=list)  # bin edges of each feature
    tables: list[np.ndarray] = field(default_factory=list)
    pairs: list[tuple[int, int]] = field(default_factory=list)
    pair_tables: list[np.ndarray] = field(default_factory=list)
    coarse: list[np.ndarray] = field(default_factory=list)  # bin -> coarse bin, for pairs

    def scores(self, x: np.ndarray) -> np.ndarray:
        z = np.full(len(x), self.intercept)
        bins = [np.searchsorted(c, x[:, i], "right") for i, c in enumerate(self.cuts)]
        for b, t in zip(bins, self.tables, strict=True):
            z += t[b]
        for (i, j), t in zip(self.pairs, self.pair_tables, strict=True):
            z += t[self.coarse[i][bins[i]], self.coarse[j][bins[j]]]
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def _three_leaves(g: np.ndarray, h: np.ndarray, ridge: float) -> np.ndarray:
    """Leaf value of each bin of the best tree with two cuts over ordered bins."""
    gc, hc = np.cumsum(g), np.cumsum(h)

    def cut(a: int, z: int):
        """(gain, place) of the best cut of bins a..z-1."""
        if z - a < 2:
            return 0.0, a
        g0, h0 = (gc[a - 1], hc[a - 1]) if a else (0.0, 0.0)
        gl, hl = gc[a : z - 1] - g0, hc[a : z - 1] - h0
        gt, ht = gc[z - 1] - g0, hc[z - 1] - h0
        gain = gl**2 / (hl + ridge) + (gt - gl) ** 2 / (ht - hl + ridge) - gt**2 / (ht + ridge)
        k = int(np.argmax(gain))
        return float(gain[k]), a + k + 1

    n = len(g)
    _, first = cut(0, n)
    (left, a), (right, b) = cut(0, first), cut(first, n)
    ends = sorted({0, first, a if left >= right else b, n})
    out = np.zeros(n)
    for s, e in zip(ends, ends[1:], strict=False):
        out[s:e] = g[s:e].sum() / (h[s:e].sum() + ridge)
    return out


def _quadrants(g: np.ndarray, h: np.ndarray, ridge: float) -> tuple[float, np.ndarray]:
    """(gain, values) of the best two-by-two tree over a grid of bins."""
    gc, hc = g.cumsum(0).cumsum(1), h.cumsum(0).cumsum(1)
    best, at = -1.0, (1, 1)
    gt, ht = gc[-1, -1], hc[-1, -1]
    a, ah = gc[:-1, :-1], hc[:-1, :-1]
    b, bh = gc[:-1, -1:] - a, hc[:-1, -1:] - ah
    c, ch = gc[-1:, :-1] - a, hc[-1:, :-1] - ah
    d, dh = gt - a - b - c, ht - ah - bh - ch
    if a.size:
        gain = sum(x**2 / (y + ridge) for x, y in ((a, ah), (b, bh), (c, ch), (d, dh))) - gt**2 / (ht + ridge)
        k = np.unravel_index(int(np.argmax(gain)), gain.shape)
        best, at = float(gain[k]), (int(k[0]) + 1, int(k[1]) + 1)
    out = np.zeros_like(g)
    for rows in (slice(0, at[0]), slice(at[0], None)):
        for cols in (slice(0, at[1]), slice(at[1], None)):
            out[rows, cols] = g[rows, cols].sum() / (h[rows, cols].sum() + ridge)
    return best, out


def fit(x: np.ndarray, y: np.ndarray, rounds: int = 200, rate: float = 0.1, bins: int = 64, grid: int = 8, pairs: int = 8, ridge: float = 4.0) -> Model:
    """Fit the tables by cyclic boosting; first the features, then the pairs on what they leave."""
    rate0 = (y.sum() + 1) / (len(y) + 2)
    m = Model(float(np.log(rate0 / (1 - rate0))))
    if len(y) < 20 or y.min() == y.max():
        return m
    m.cuts = [np.unique(np.quantile(f, np.linspace(0, 1, bins + 1)[1:-1])) for f in x.T]
    at = [np.searchsorted(c, f, "right") for c, f in zip(m.cuts, x.T, strict=True)]
    m.tables = [np.zeros(len(c) + 1) for c in m.cuts]
    m.coarse = [np.minimum(np.arange(len(c) + 1) * grid // (len(c) + 1), grid - 1) for c in m.cuts]
    z = np.full(len(y), m.intercept)

    def slope():
        p = 1 / (1 + np.exp(-z))
        return y - p, p * (1 - p)

    for _ in range(rounds):
        for t, b in zip(m.tables, at, strict=True):
            if len(t) > 1:
                g, h = slope()
                step = rate * _three_leaves(np.bincount(b, g, len(t)), np.bincount(b, h, len(t)), ridge)
                t += step
                z += step[b]
    cell = lambda i, j: m.coarse[i][at[i]] * grid + m.coarse[j][at[j]]
    square = lambda c, w: np.bincount(c, w, grid * grid).reshape(grid, grid)
    g, h = slope()
    gains = [(_quadrants(square(c := cell(i, j), g), square(c, h), ridge)[0], i, j) for i in range(x.shape[1]) for j in range(i)]
    m.pairs = [(i, j) for _, i, j in sorted(gains, reverse=True)[:pairs]]
    m.pair_tables = [np.zeros((grid, grid)) for _ in m.pairs]
    cells = [cell(i, j) for i, j in m.pairs]
    for _ in range(rounds // 4):
        for t, c in zip(m.pair_tables, cells, strict=True):
            g, h = slope()
            step = rate * _quadrants(square(c, g), square(c, h), ridge)[1]
            t += step
            z += step.ravel()[c]
    return m


def held_out(id_col: str = "doc_id"):
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % 5 == 0


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", rows: int = FIT_ROWS) -> Model:
    """Fit on at most ``rows`` labelled documents that aren't held out."""
    chosen = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull() & ~held_out()).select("doc_id", F.col(label).cast("double").alias("y"))
    chosen = chosen.orderBy(F.xxhash64("doc_id"), "doc_id", "y").limit(rows)

    def step(batches):
        for batch in batches:
            x = measure_all(batch.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), len(FEATURES)).cast(pa.list_(pa.float64()))], ["y", "x"])

    # at most ``rows`` pairs of numbers are broadcast, and as many feature rows are collected
    found = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select("y", "text").mapInArrow(trimmed(step), "y double, x array<double>").toPandas()
    if not len(found):
        return Model()
    x = np.array(found["x"].tolist())
    order = np.lexsort([*x.T, found["y"].to_numpy()])  # the same model whatever the order in which rows come
    return fit(x[order], found["y"].to_numpy()[order])


def score(docs: DataFrame, model: Model, threshold: float = 0.3) -> DataFrame:
    """Add score and predicted to every row of ``docs`` (which needs text); its other columns stay."""
    names = docs.columns
    text = names.index("text")

    def step(batches):
        for batch in batches:
            s = model.scores(measure_all(batch.column(text).to_pylist()))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(s), pa.array((s >= threshold).astype(np.int32))], [*batch.schema.names, "score", "predicted"])

    from pyspark.sql.types import DoubleType, IntegerType, StructType

    kept = [f for f in docs.schema.fields if f.name not in ("score", "predicted")]
    docs = docs.select(*[F.col(f"`{f.name}`") for f in kept])
    names = docs.columns
    text = names.index("text")
    return docs.mapInArrow(trimmed(step), StructType([*kept]).add("score", DoubleType()).add("predicted", IntegerType()))


def digests(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every document."""
    model = train(docs, labels)

    def step(batches):
        for batch in batches:
            s = model.scores(measure_all(batch.column(1).to_pylist()))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(s), pa.array((s >= 0.3).astype(np.int32))], ["doc_id", "score", "predicted"])

    out = docs.select("doc_id", "text").mapInArrow(trimmed(step), "doc_id long, score double, predicted int")
    return out.select("doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), "score", "predicted")
