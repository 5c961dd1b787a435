"""Quality rules: isolation forests over rule statistics, with thresholds calibrated from labelled rows.

Each document gets rule statistics (words, symbols, repeated lines and words, upper case, marks). For each family of
rules one isolation forest holds random splits of a sample of labelled documents; a document's anomaly is 2^(-mean
path length / expected path length). A family's threshold is the one that best separates the labelled good from the
labelled bad rows that earlier families leave, among those which lose at most `lost` of the good rows; a family without
such a threshold rejects nothing. A document is kept if no base rule fails and no family's anomaly exceeds its threshold.

The trees are grown on at most `fit_rows` labelled documents, those with the least hash of their id, which is the one
bounded sample here; thresholds are calibrated on all labelled documents, and statistics, scores and verdicts cover every
document and the whole of its text. Anomalies are rounded to four places, so that counts by value, of which there are
10,001 at most, are all that calibration needs.

Defined results: null and empty texts have no words and fail the base rules; texts of any length are read whole, one at a
time; repeated rows are judged each; a document with several labels counts as bad if one of them says so; documents that
share an id share its label; of equally good thresholds the least is taken, and an anomaly equal to the threshold is
kept; with no labelled rows of both kinds the forests reject nothing; an empty table gives no rows; other columns,
whatever their names, are passed through by filter_documents() and ignored by score().
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from purselight.llm.common import binaries, blocks, cut, map_batches
from purselight.llm.url_bloom import maybe

#: Symbols of the base rule, bytes of white space, and marks that shouting texts use.
SYMBOLS, SPACE, MARKS = b"#*$%&|<>", b" \t\n\x0b\x0c\r", b"!?"
#: Families of rules: a forest each, over these features.
FAMILIES = {"symbols": ("symbols_per_word",), "shouting": ("upper_share", "marks_per_word"), "repetition": ("dup_line_share", "repeat_share")}
STATS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
FEATURES = ("symbols_per_word", "upper_share", "marks_per_word", "dup_line_share", "repeat_share")
EULER = 0.5772156649015329


def repeated_words(words: list[bytes]) -> int:
    """Words in 3-word windows that occur twice or more, the first occurrence included."""
    n = len(words)
    if n < 4:
        return 0
    number: dict[bytes, int] = {}
    ids = np.fromiter((number.setdefault(w, len(number)) for w in words), np.int64, n)
    v = len(number)
    pair = ids[:-1] * v + ids[1:]
    if v >= 2_000_000:  # keeps the codes of three words within 63 bits
        pair = np.unique(pair, return_inverse=True)[1]
    code = pair[:-1] * v + ids[2:]
    order = np.argsort(code, kind="stable")
    same = np.diff(code[order]) == 0
    often = np.zeros(n - 2, bool)
    often[order[1:][same]] = True
    often[order[:-1][same]] = True
    inside = np.zeros(n, bool)
    for k in range(3):
        inside[k : n - 2 + k] |= often
    return int(inside.sum())


def statistics(text: bytes) -> tuple[list[int], list[float]]:
    """(STATS, FEATURES) of a text in UTF-8."""
    count = np.bincount(np.frombuffer(text, np.uint8), minlength=256)
    words = text.split()
    n = len(words)
    chars = len(text) - int(count[0x80:0xC0].sum()) - int(count[list(SPACE)].sum())
    symbols, lines = int(count[list(SYMBOLS)].sum()), [x for x in text.split(b"\n") if x.strip()]
    dup, repeated = len(lines) - len(set(lines)), repeated_words(words)
    upper, lower = int(count[65:91].sum()), int(count[97:123].sum())
    per = max(n, 1)
    features = [symbols / per, upper / max(upper + lower, 1), int(count[list(MARKS)].sum()) / per, dup / max(len(lines), 1), repeated / per]
    return [n, chars, symbols, dup, repeated], features


def base_failed(n_words: np.ndarray, n_repeat_words: np.ndarray) -> np.ndarray:
    return (n_words < 50) | (100 * n_repeat_words > 50 * n_words)


def expected_path(n: int) -> float:
    """Mean path length of an unsuccessful search among n points."""
    return 2 * (np.log(n - 1) + EULER) - 2 * (n - 1) / n if n > 2 else float(n == 2)


@dataclass
class Tree:
    """Nodes as arrays; a leaf has feature -1 and its path length in `cut`."""

    feature: list[int] = field(default_factory=list)
    cut: list[float] = field(default_factory=list)
    low: list[int] = field(default_factory=list)
    high: list[int] = field(default_factory=list)

    def grow(self, x: np.ndarray, depth: int, limit: int, rng: np.random.Generator) -> int:
        at = len(self.feature)
        for column in (self.feature, self.cut, self.low, self.high):
            column.append(-1)
        a, b = x.min(0), x.max(0)
        varied = np.nonzero(b > a)[0]
        if depth >= limit or not len(varied):
            self.cut[at] = depth + expected_path(len(x))
            return at
        f = int(rng.choice(varied))
        cut = rng.uniform(a[f], b[f])
        below = x[:, f] <= cut
        if below.all():
            cut, below = a[f], x[:, f] <= a[f]
        self.feature[at], self.cut[at] = f, cut
        self.low[at] = self.grow(x[below], depth + 1, limit, rng)
        self.high[at] = self.grow(x[~below], depth + 1, limit, rng)
        return at

    def arrays(self) -> tuple[np.ndarray, ...]:
        return tuple(np.array(x) for x in (self.feature, self.cut, self.low, self.high))


@dataclass
class Forest:
    columns: list[int]
    trees: list[tuple[np.ndarray, ...]]
    expected: float
    threshold: float = float("inf")

    @classmethod
    def fit(cls, x: np.ndarray, columns: list[int], trees: int, sample: int, seed: int) -> Forest:
        rng = np.random.default_rng(seed)
        x = x[:, columns]
        size = min(sample, len(x))
        limit = max(1, int(np.ceil(np.log2(max(size, 2)))) + 2)
        grown = []
        for _ in range(trees):
            tree = Tree()
            tree.grow(x[rng.choice(len(x), size, replace=False)], 0, limit, rng)
            grown.append(tree.arrays())
        return cls(columns, grown, max(expected_path(size), 1e-9))

    def anomaly(self, x: np.ndarray) -> np.ndarray:
        total = np.zeros(len(x))
        x = np.ascontiguousarray(x[:, self.columns])
        for feature, cut, low, high in self.trees:
            at = np.zeros(len(x), np.int64)
            while True:
                inner = np.nonzero(feature[at] >= 0)[0]
                if not len(inner):
                    break
                node = at[inner]
                at[inner] = np.where(x[inner, feature[node]] <= cut[node], low[node], high[node])
            total += cut[at]
        return np.round(2 ** (-total / len(self.trees) / self.expected), 4)


def calibrate(good: dict[float, int], bad: dict[float, int], lost: float) -> float:
    """The anomaly above which rows are rejected: best share of bad rows caught less good rows lost. Rows as counts by anomaly."""
    best, at = 0.0, float("inf")
    n_good, n_bad = (max(1, sum(x.values())) for x in (good, bad))
    above, caught = 0, 0
    gains = []
    for t in sorted({*good, *bad}, reverse=True):
        if t in good:
            gains.append((t, above / n_good, caught / n_bad))
        above, caught = above + good.get(t, 0), caught + bad.get(t, 0)
    for t, share, hit in reversed(gains):
        if share <= lost and hit - share > best:
            best, at = hit - share, t
    return at


@dataclass
class Model:
    forests: dict[str, Forest]

    def anomalies(self, x: np.ndarray) -> np.ndarray:
        """A column per family; 0 columns for a model without forests."""
        return np.array([f.anomaly(x) for f in self.forests.values()]).T.reshape(len(x), len(self.forests))

    def rejected(self, anomalies: np.ndarray) -> np.ndarray:
        limits = np.array([f.threshold for f in self.forests.values()])
        return (anomalies > limits).any(1) if len(limits) else np.zeros(len(anomalies), bool)


def labelled_features(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, good (whether no label says 0), x (FEATURES) of the labelled documents that pass the base rules.

    Documents that a Bloom filter shows to have no label are dropped where they are read; only statistics move.
    """
    rows = labels.where("quality is not null and doc_id is not null").groupBy("doc_id").agg((F.min("quality") != 0).alias("good"))
    key = docs.select("doc_id", F.col("text").cast("binary").alias("text"), F.col("doc_id").cast("string").alias("id"))
    near = maybe(key, "id", rows.select(F.col("doc_id").cast("string").alias("url"))).where("maybe").select("doc_id", "text")

    def f(batch: pa.RecordBatch):
        for a, b in blocks(batch.num_rows, 2000):
            part = batch.slice(a, b - a)
            stats, features = zip(*map(statistics, binaries(part, "text")), strict=True)
            stats = np.array(stats)
            fine = pa.array(~base_failed(stats[:, 0], stats[:, 4]))
            yield pa.RecordBatch.from_arrays([part.column("doc_id").filter(fine), pa.array(features, pa.list_(pa.float64())).filter(fine)], names=["doc_id", "x"])

    return map_batches(near, f, "doc_id long, x array<double>").join(rows, "doc_id")


def fit(docs: DataFrame, labels: DataFrame, fit_rows: int = 4096, trees: int = 64, sample: int = 256, lost: float = 0.002, seed: int = 7) -> Model:
    """Forests grown on fit_rows labelled documents at most that pass the base rules, thresholds from all of those."""
    rows = cut(labelled_features(docs, labels), "labelled")
    got = rows.orderBy(F.xxhash64("doc_id"), "doc_id", "x").limit(fit_rows).collect()
    kinds = {r.good for r in rows.groupBy("good").count().collect()}
    if kinds != {True, False}:
        return Model({})
    x = np.array([r.x for r in sorted(got)])
    model = Model({name: Forest.fit(x, [FEATURES.index(c) for c in columns], trees, sample, seed) for name, columns in FAMILIES.items()})
    names = list(FAMILIES)

    def f(batch: pa.RecordBatch) -> pa.RecordBatch:
        anomalies = model.anomalies(np.array(batch.column("x").to_pylist()))
        return pa.RecordBatch.from_arrays([batch.column("good"), *(pa.array(c) for c in anomalies.T)], names=["good", *names])

    scored = cut(map_batches(rows.select("good", "x"), f, "good boolean, " + ", ".join(f"{c} double" for c in names)), "scored")
    for name, forest in model.forests.items():
        # Only rows that no earlier family rejects count for a family: it should lose good rows for nothing less.
        counts = scored.groupBy("good", name).count().collect()
        good, bad = ({r[name]: r["count"] for r in counts if r.good is kind} for kind in (True, False))
        forest.threshold = calibrate(good, bad, lost)
        scored = scored.where(F.col(name) <= forest.threshold)
    return model


def judge(model: Model, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(stats, base_failed, anomalies, kept) of texts."""
    both = [statistics(t) for t in texts]
    stats = np.array([s for s, _ in both], np.int64).reshape(len(both), len(STATS))
    anomalies = model.anomalies(np.array([x for _, x in both]).reshape(len(both), len(FEATURES)))
    failed = base_failed(stats[:, 0], stats[:, 4])
    return stats, failed, anomalies, ~failed & ~model.rejected(anomalies)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, the statistics, base_failed, kept, anomaly (the largest of the families', null without forests)."""

    def f(batch: pa.RecordBatch):
        for a, b in blocks(batch.num_rows, 2000):
            part = batch.slice(a, b - a)
            stats, failed, anomalies, kept = judge(model, binaries(part, "text"))
            most = pa.array(anomalies.max(1)) if anomalies.shape[1] else pa.nulls(len(kept), pa.float64())
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), *(pa.array(c) for c in stats.T), pa.array(failed), pa.array(kept), most], names=["doc_id", *STATS, "base_failed", "kept", "anomaly"])

    schema = "doc_id long, " + ", ".join(f"{c} long" for c in STATS) + ", base_failed boolean, kept boolean, anomaly double"
    return map_batches(docs.select("doc_id", F.col("text").cast("binary").alias("text")), f, schema)


def filter_documents(docs: DataFrame, model: Model) -> DataFrame:
    """The rows of docs whose documents are kept, with all their columns."""

    def f(batch: pa.RecordBatch):
        for a, b in blocks(batch.num_rows, 2000):
            part = batch.slice(a, b - a)
            yield part.filter(pa.array(judge(model, binaries(part, "text"))[3]))

    return map_batches(docs, f, docs.schema)
