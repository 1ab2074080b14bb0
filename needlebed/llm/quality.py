"""Quality classifier: a generalised additive model with pairwise interactions.

Features are put into bins. Boosting goes round the features in a cycle; each step fits a tree of three leaves to one
feature's bins and adds it to that feature's lookup table. Then the pairs of features that explain most of what is
left get two-dimensional tables in the same way. A score is the sum of the table entries of a document's bins.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass, field
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from needlebed.llm.common import fresh, need

#: Labelled documents that training uses at most, those with the smallest seeded hash of their id.
TRAIN_ROWS = 20_000
BINS, COARSE, ROUNDS, PAIR_ROUNDS, PAIRS, RATE, SEED, ACCEPT = 32, 8, 150, 40, 8, 0.1, 11, 0.5

FEATURES = ["log_chars", "letters", "upper", "digits", "symbols", "stops", "bangs", "pipes", "blanks", "word_length", "distinct_words", "function_words", "compression", "line_length", "repeated_lines"]
FUNCTION_WORDS = frozenset("the of and to in a is that it for on was with be as by this are from at de la et les des le que en un une du dans est pour qui der die das und in den von zu mit sich auf für ist im dem nicht ein eine el los del las por con para se una su al lo como".split())
_CLASS = np.zeros((256, 7), np.float64)
for _c in range(256):
    _s = chr(_c)
    _CLASS[_c] = [(_s.isascii() and _s.isalpha()) or _c >= 128, "A" <= _s <= "Z", "0" <= _s <= "9", _s in "#$%&*+/<=>@[\\]^_`{}~", _s in ".,;:?", _s == "!", _s == "|"]


def features(raw: bytes | None) -> list[float]:
    """The features of a whole text, in the order of FEATURES. A null text counts as the empty one, and what isn't UTF-8
    as U+FFFD."""
    raw = raw or b""
    text = raw.decode(errors="replace")
    n = max(1, len(raw))
    counts = np.bincount(np.frombuffer(raw, np.uint8), minlength=256) @ _CLASS
    words, lines = text.split(), [x for x in text.split("\n") if x]
    k = max(1, len(words))
    return [
        np.log1p(len(text)), counts[0] / n, counts[1] / max(1.0, counts[0]), *(counts[2:7] / n), 1 - sum(map(len, words)) / max(1, len(text)), sum(map(len, words)) / k,
        len(set(words)) / k, sum(map(FUNCTION_WORDS.__contains__, words)) / k, len(zlib.compress(raw, 1)) / n, np.log1p(len(text) / max(1, len(lines))), 1 - len(set(lines)) / max(1, len(lines)),
    ]


@dataclass
class Model:
    """Cut points of each feature, a table for each, and the tables of pairs over coarser bins."""

    cuts: list[np.ndarray]
    base: float
    tables: list[np.ndarray]
    pairs: list[tuple[int, int]] = field(default_factory=list)
    pair_tables: list[np.ndarray] = field(default_factory=list)

    def bins(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(c, x[:, j], side="right") for j, c in enumerate(self.cuts)], 1)

    def logit(self, x: np.ndarray) -> np.ndarray:
        b = self.bins(x)
        out = np.full(len(x), self.base)
        for j, table in enumerate(self.tables):
            out += table[b[:, j]]
        for (i, j), table in zip(self.pairs, self.pair_tables):
            out += table[_coarse(b[:, i]), _coarse(b[:, j])]
        return out

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logit(x), -30, 30)))


def _coarse(b: np.ndarray) -> np.ndarray:
    return np.minimum(b * COARSE // BINS, COARSE - 1)


def _leaf(g, h):
    return g / (h + 1.0)


def _tree(g: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Values by bin of the best tree with two splits, three leaves, on ordered bins."""
    cg, ch = np.r_[0.0, np.cumsum(g)], np.r_[0.0, np.cumsum(h)]
    a, b = np.triu_indices(len(g) + 1)
    gain = sum(dg * _leaf(dg, dh) for dg, dh in ((cg[a], ch[a]), (cg[b] - cg[a], ch[b] - ch[a]), (cg[-1] - cg[b], ch[-1] - ch[b])))
    k = int(np.argmax(gain))
    a, b = a[k], b[k]
    out = np.empty(len(g))
    for s, e in ((0, a), (a, b), (b, len(g))):
        if e > s:
            out[s:e] = _leaf(cg[e] - cg[s], ch[e] - ch[s])
    return out


def _square(g: np.ndarray, h: np.ndarray) -> tuple[float, np.ndarray]:
    """Gain and values of the best tree with one cut on each of two features."""
    cg, ch = (np.pad(m, ((1, 0), (1, 0))).cumsum(0).cumsum(1) for m in (g, h))
    quads = lambda c: (c, c[:, -1:] - c, c[-1:, :] - c, c[-1, -1] - c[:, -1:] - c[-1:, :] + c)
    gain = sum(x * _leaf(x, y) for x, y in zip(quads(cg), quads(ch)))
    i, j = np.unravel_index(int(np.argmax(gain)), gain.shape)
    out = np.zeros(g.shape)
    for rows, cols in ((slice(0, i), slice(0, j)), (slice(0, i), slice(j, None)), (slice(i, None), slice(0, j)), (slice(i, None), slice(j, None))):
        out[rows, cols] = _leaf(g[rows, cols].sum(), h[rows, cols].sum())
    return float(gain[i, j]), out


def train(x: np.ndarray, y: np.ndarray) -> Model:
    """Fit by cyclic boosting on the logistic loss. With labels of one kind only, every score is near that label."""
    cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, BINS + 1)[1:-1])) if len(x) else np.empty(0) for j in range(x.shape[1])]
    rate = (y.sum() + 0.5) / (len(y) + 1.0)
    model = Model(cuts, float(np.log(rate / (1 - rate))), [np.zeros(BINS) for _ in cuts])
    if not len(x) or y.min() == y.max():
        return model
    b, f = model.bins(x), np.full(len(x), model.base)

    def slopes():
        p = 1 / (1 + np.exp(-np.clip(f, -30, 30)))
        return y - p, p * (1 - p)

    for _ in range(ROUNDS):
        for j in range(len(cuts)):
            g, h = slopes()
            step = RATE * _tree(np.bincount(b[:, j], g, BINS), np.bincount(b[:, j], h, BINS))
            model.tables[j] += step
            f += step[b[:, j]]
    flat = {p: _coarse(b[:, p[0]]) * COARSE + _coarse(b[:, p[1]]) for p in combinations(range(len(cuts)), 2)}

    def square(p):
        return _square(*(np.bincount(flat[p], s, COARSE * COARSE).reshape(COARSE, COARSE) for s in slopes()))

    model.pairs = sorted(flat, key=lambda p: -square(p)[0])[:PAIRS]
    model.pair_tables = [np.zeros((COARSE, COARSE)) for _ in model.pairs]
    for _ in range(PAIR_ROUNDS):
        for k, p in enumerate(model.pairs):
            step = RATE * square(p)[1]
            model.pair_tables[k] += step
            f += step.ravel()[flat[p]]
    return model


def _featured(texts: pd.Series) -> np.ndarray:
    return np.array([features(t) for t in texts], np.float64).reshape(len(texts), len(FEATURES))


def fit_quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", train_rows: int = TRAIN_ROWS, seed: int = SEED) -> Model:
    """A model of ``label_col`` (0 or 1), trained on at most ``train_rows`` labelled documents, those with the smallest
    seeded hash of the id and then of the text.

    Labels with a null id or value are left out; an id with several labels has the smallest. Documents whose id repeats
    are each a case. With no labelled document the model gives every text the same score, one half.
    """
    need(docs, id_col, text_col)
    need(labels, id_col, label_col)
    known = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull()).groupBy(F.col(id_col).alias("id")).agg(F.min(label_col).cast("double").alias("y"))
    some = known.orderBy(F.xxhash64(F.lit(seed), "id"), "id").limit(train_rows)

    @F.pandas_udf("array<double>")
    def of(texts: pd.Series) -> pd.Series:
        return pd.Series(list(_featured(texts)))

    # At most train_rows pairs of numbers are broadcast, and at most as many cases come back, however often ids repeat.
    pairs = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(F.broadcast(some), "id")
    cases = pairs.select("y", F.xxhash64(F.lit(seed), "id").alias("h"), F.xxhash64("text").alias("t"), of.asNondeterministic()(F.col("text").cast("binary")).alias("x"))
    got = cases.orderBy("h", "t", "y").limit(train_rows).select("y", "x").toPandas()
    x = np.array(got["x"].tolist(), np.float64).reshape(len(got), len(FEATURES))
    return train(x, got["y"].to_numpy(np.float64))


def score_quality(docs: DataFrame, model: Model, text_col: str = "text", out_col: str | None = None) -> DataFrame:
    """``docs`` with the probability of good quality in ``out_col`` (``quality_score``, with underscores in front where
    ``docs`` has it). Null and empty texts are scored as the empty text, bytes that aren't UTF-8 as U+FFFD. Whole texts are
    read, once each: the function is marked as not deterministic, so that a filter on the score isn't a second call."""
    need(docs, text_col)

    @F.pandas_udf("double")
    def of(texts: pd.Series) -> pd.Series:
        return pd.Series(model.score(_featured(texts)))

    return docs.withColumn(out_col or fresh(docs, "quality_score")[0], of.asNondeterministic()(F.col(text_col).cast("binary")))


def quality_filter(docs: DataFrame, labels: DataFrame, accept: float = ACCEPT, out_col: str | None = None, **kw) -> DataFrame:
    """The rows of ``docs`` whose score is at least ``accept``, with its columns and, if it is named, ``out_col``. Each
    row is judged by its text alone, so repeated rows and equal texts stay or go together, and a score of just ``accept``
    stays. Null, empty and very long texts are judged as ``score_quality`` says. An empty table gives an empty table."""
    name = out_col or fresh(docs, "quality_score")[0]
    kept = score_quality(docs, fit_quality(docs, labels, **kw), kw.get("text_col", "text"), name).where(F.col(name) >= accept)
    return kept if out_col else kept.select(*docs.columns)
