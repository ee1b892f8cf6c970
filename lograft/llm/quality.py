"""Operator 7: quality scores by a generalised additive model with pairwise interactions."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from lograft.llm.common import buffers, cut_slices, document_remainder, unit_hash

BATCH_BYTES = 4 << 20
# Bounds and settings of the fit.
TRAIN_ROWS = 20_000
BINS = 24
ROUNDS = 120
RATE = 0.15
PAIRS = 4
PAIR_BINS = 8
LEAST_IN_LEAF = 8.0

FEATURES = (
    "log_words",
    "word_bytes",
    "upper",
    "digits",
    "symbols",
    "pipes",
    "exclamations",
    "punctuation",
    "high_bytes",
    "line_words",
    "repeated_neighbours",
    "distinct_words",
    "distinct_lines",
)


def _byte_classes() -> np.ndarray:
    table = np.zeros(256, np.uint8)
    for code, chars in ((1, b" \t\n\x0b\x0c\r"), (3, b"0123456789"), (4, b"#*$%&<>"), (5, b"|"), (6, b"!"), (7, b".,;:?")):
        table[list(chars)] = code
    table[ord("A") : ord("Z") + 1] = 2
    table[0x80:] = 8
    return table


CLASSES = _byte_classes()


def features(texts: pa.Array) -> np.ndarray:
    """One row of numbers for each whole text, shares for the most part; NULL counts as empty."""
    body, offsets = buffers(texts)
    rows = len(offsets) - 1
    size = np.diff(offsets)
    row_of = np.repeat(np.arange(rows), size)
    kinds = np.bincount(row_of * 9 + CLASSES[body], minlength=rows * 9).reshape(rows, 9).astype(float)
    newlines = np.bincount(row_of[body == 10], minlength=rows)
    texts = pc.fill_null(texts, "")
    pieces = pc.ascii_split_whitespace(texts)
    coded = pieces.flatten().dictionary_encode()
    index = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    ends = pieces.offsets.to_numpy().astype(np.int64)
    ends = ends - ends[0]
    filled = np.array([len(w) > 0 for w in coded.dictionary.to_pylist()], bool)
    row_of_word = np.repeat(np.arange(rows), np.diff(ends))
    real = filled[index] if len(index) else np.zeros(0, bool)
    index, row_of_word = index[real], row_of_word[real]
    words = np.bincount(row_of_word, minlength=rows).astype(float)
    same = (index[1:] == index[:-1]) & (row_of_word[1:] == row_of_word[:-1])
    repeated = np.bincount(row_of_word[1:][same], minlength=rows)
    many = max(len(filled), 1)
    distinct = np.bincount(np.unique(row_of_word * many + index) // many, minlength=rows)
    lines = pc.split_pattern(texts, "\n")
    line_of = np.repeat(np.arange(rows), np.diff(lines.offsets.to_numpy()))
    line_code = lines.flatten().dictionary_encode().indices.to_numpy(zero_copy_only=False).astype(np.int64)
    span = int(line_code.max()) + 1 if len(line_code) else 1
    different = np.bincount(np.unique(line_of * span + line_code) // span, minlength=rows)
    letters = np.maximum(size - kinds[:, 1], 1)
    per_word = np.maximum(words, 1)
    return np.column_stack(
        [
            np.log1p(words),
            letters / per_word,
            kinds[:, 2] / letters,
            kinds[:, 3] / letters,
            kinds[:, 4] / per_word,
            kinds[:, 5] / per_word,
            kinds[:, 6] / per_word,
            kinds[:, 7] / per_word,
            kinds[:, 8] / letters,
            words / (newlines + 1),
            repeated / per_word,
            # A text repeats more words the longer it is; the root takes most of that out.
            distinct / np.sqrt(per_word),
            different / (newlines + 1),
        ]
    )


@dataclass
class AdditiveModel:
    """Lookup tables: a text's score is the sigmoid of the entries of its bins, summed."""

    base: float = 0.0
    edges: list[np.ndarray] = field(default_factory=list)
    tables: list[np.ndarray] = field(default_factory=list)
    pair_edges: list[np.ndarray] = field(default_factory=list)
    pairs: list[tuple[int, int, np.ndarray]] = field(default_factory=list)

    def score(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.base)
        for f, (edges, entries) in enumerate(zip(self.edges, self.tables, strict=True)):
            total += entries[np.searchsorted(edges, x[:, f], side="right")]
        for a, b, entries in self.pairs:
            i = np.searchsorted(self.pair_edges[a], x[:, a], side="right")
            j = np.searchsorted(self.pair_edges[b], x[:, b], side="right")
            total += entries[i, j]
        return 1.0 / (1.0 + np.exp(-np.clip(total, -30, 30)))


def _edges(values: np.ndarray, bins: int) -> np.ndarray:
    return np.unique(np.quantile(values, np.linspace(0, 1, bins + 1)[1:-1]))


def _gain(g: np.ndarray, h: np.ndarray) -> np.ndarray:
    return np.where(h >= LEAST_IN_LEAF * 0.05, g * g / (h + 1.0), 0.0)


def _best_cut(g: np.ndarray, h: np.ndarray, n: np.ndarray) -> tuple[float, int]:
    """Where a histogram is best cut in two, and what that gains; 0 if nowhere."""
    if len(g) < 2:
        return 0.0, 0
    left_g, left_h, left_n = np.cumsum(g)[:-1], np.cumsum(h)[:-1], np.cumsum(n)[:-1]
    gains = _gain(left_g, left_h) + _gain(g.sum() - left_g, h.sum() - left_h) - _gain(g.sum(), h.sum())
    gains[(left_n < LEAST_IN_LEAF) | (n.sum() - left_n < LEAST_IN_LEAF)] = 0.0
    best = int(np.argmax(gains))
    return float(gains[best]), best + 1


def _shallow_tree(g: np.ndarray, h: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Leaf values of a tree of depth two over a feature's bins, spread out to the bins."""
    out = np.zeros(len(g))
    spans = [(0, len(g))]
    for _ in range(2):
        cut = []
        for lo, hi in spans:
            gain, at = _best_cut(g[lo:hi], h[lo:hi], n[lo:hi])
            cut += [(lo, lo + at), (lo + at, hi)] if gain > 0 else [(lo, hi)]
        spans = cut
    for lo, hi in spans:
        out[lo:hi] = -g[lo:hi].sum() / (h[lo:hi].sum() + 1.0)
    return out


def _four_leaves(g: np.ndarray, h: np.ndarray, n: np.ndarray) -> tuple[float, np.ndarray]:
    """The best cross of one cut in each of two features: its gain and leaf values."""
    best, values = 0.0, np.zeros(g.shape)
    sums = [np.pad(x.cumsum(0).cumsum(1), ((1, 0), (1, 0))) for x in (g, h, n)]
    whole = _gain(g.sum(), h.sum())
    for i in range(1, g.shape[0]):
        for j in range(1, g.shape[1]):
            parts = [
                (s[i, j], s[i, -1] - s[i, j], s[-1, j] - s[i, j], s[-1, -1] - s[i, -1] - s[-1, j] + s[i, j]) for s in sums
            ]
            gain = sum(float(_gain(np.float64(a), np.float64(b))) for a, b in zip(parts[0], parts[1], strict=True)) - whole
            if gain > best:
                leaf = [-a / (b + 1.0) if m >= LEAST_IN_LEAF else 0.0 for a, b, m in zip(*parts, strict=True)]
                values = np.zeros(g.shape)
                values[:i, :j], values[:i, j:], values[i:, :j], values[i:, j:] = leaf
                best = gain
    return best, values


def fit(x: np.ndarray, y: np.ndarray) -> AdditiveModel:
    """Cyclic boosting: each round gives every feature in turn a shallow tree on the current residuals.

    The trees of a feature add up to its table. Then the pairs of features with the
    largest gain on what is left get tables of their own. One label alone, or no
    rows, give the constant model of that share (a half without rows).
    """
    rows = len(y)
    positive = (y.sum() + 1.0) / (rows + 2.0)
    model = AdditiveModel(base=float(np.log(positive / (1 - positive))))
    if not rows or y.min() == y.max():
        return model
    columns = range(x.shape[1])
    model.edges = [_edges(x[:, f], BINS) for f in columns]
    bins = [np.searchsorted(model.edges[f], x[:, f], side="right") for f in columns]
    model.tables = [np.zeros(len(e) + 1) for e in model.edges]
    counts = [np.bincount(b, minlength=len(t)).astype(float) for b, t in zip(bins, model.tables, strict=True)]
    total = np.full(rows, model.base)
    for _ in range(ROUNDS):
        for f in columns:
            p = 1.0 / (1.0 + np.exp(-total))
            width = len(model.tables[f])
            g = np.bincount(bins[f], p - y, minlength=width)
            h = np.bincount(bins[f], p * (1 - p), minlength=width)
            step = RATE * _shallow_tree(g, h, counts[f])
            model.tables[f] += step
            total += step[bins[f]]
    _fit_pairs(model, x, y, total)
    return model


def _fit_pairs(model: AdditiveModel, x: np.ndarray, y: np.ndarray, total: np.ndarray) -> None:
    model.pair_edges = [_edges(x[:, f], PAIR_BINS) for f in range(x.shape[1])]
    coarse = [np.searchsorted(e, x[:, f], side="right") for f, e in enumerate(model.pair_edges)]
    shape = [len(e) + 1 for e in model.pair_edges]

    def tree(a: int, b: int) -> tuple[float, np.ndarray]:
        p = 1.0 / (1.0 + np.exp(-total))
        cell, many = coarse[a] * shape[b] + coarse[b], shape[a] * shape[b]
        sums = [np.bincount(cell, w, minlength=many).reshape(shape[a], shape[b]) for w in (p - y, p * (1 - p), None)]
        return _four_leaves(*sums)

    ranked = sorted(((tree(a, b)[0], a, b) for a in range(len(shape)) for b in range(a)), reverse=True)
    for _, a, b in [r for r in ranked if r[0] > 0][:PAIRS]:
        entries = np.zeros((shape[a], shape[b]))
        for _ in range(ROUNDS // 4):
            step = RATE * tree(a, b)[1]
            entries += step
            total += step[coarse[a], coarse[b]]
        model.pairs.append((a, b, entries))


def train(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> AdditiveModel:
    """Fit on at most ``rows`` labelled documents, chosen by the hash of their id.

    ``labels``: doc_id and quality (0 or 1); rows with a NULL in either are left out.
    The chosen ids, bounded by ``rows``, are broadcast to the documents; only the
    features of the matches come to the driver: equal ones once, and where ids repeat twice ``rows`` at most, chosen by hash.
    """
    known = labels.select("doc_id", F.col("quality").alias("__label")).dropna()
    chosen = known.orderBy(unit_hash(F.lit("quality"), F.col("doc_id")), "doc_id", "__label").limit(rows)
    matches = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select("doc_id", "text", "__label")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in cut_slices(batch, "text", BATCH_BYTES):
                x = pa.array(list(features(part.column("text"))), pa.list_(pa.float64()))
                columns = [part.column("doc_id"), x, part.column("__label").cast(pa.int32())]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "x", "label"])

    schema = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, x array<double>, label int"
    found = matches.mapInArrow(run, schema).distinct()
    found = found.orderBy(F.xxhash64("doc_id", "label", "x"), "doc_id", "label", "x").limit(2 * rows).toPandas()
    found = found.iloc[sorted(range(len(found)), key=lambda n: (found.doc_id[n], found.label[n], list(found.x[n])))]
    if not len(found):
        return fit(np.zeros((0, len(FEATURES))), np.zeros(0))
    return fit(np.stack(found["x"].to_list()), found["label"].to_numpy(float))


def score_quality(docs: DataFrame, model: AdditiveModel) -> DataFrame:
    """Adds ``score`` (0 to 1) and ``predicted`` (1 from a half on) to every row.

    Only ``text`` is an input; a NULL or empty text is scored as one without
    words. Other columns are kept, columns of the two names are replaced. One pass
    over the scan's partitions, no shuffle; batches are bounded in bytes.
    """
    plain = docs.drop("score", "predicted")
    schema = plain.withColumns({"score": F.lit(0.0), "predicted": F.lit(0)}).schema

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in cut_slices(batch, "text", BATCH_BYTES):
                scores = model.score(features(part.column("text")))
                columns = [*part.columns, pa.array(scores), pa.array((scores >= 0.5).astype(np.int32))]
                yield pa.RecordBatch.from_arrays(columns, names=[*part.schema.names, "score", "predicted"])

    return plain.mapInArrow(run, schema)


def training_labels(labels: DataFrame) -> DataFrame:
    """Labels of documents that are not held out: ``crc32(doc_id as text) mod 3`` is not 1."""
    return labels.where(document_remainder(F.col("doc_id"), 3) != 1)
