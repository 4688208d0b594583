"""Quality rules: statistics of whole texts, judged by an isolation forest."""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from caregauge.llm.common import hash_sample, slices, texts

SYMBOLS = "#*$%&|<>"
WINDOW_WORDS = 5
#: Labelled rows, about, that the forest and its threshold are fitted on.
LABELLED_ROWS = 20_000
TREES, TREE_ROWS, SEED = 128, 256, 7
#: Share of the labelled good rows that the threshold must keep.
KEPT_SHARE = 0.998

STATISTICS = (
    "n_words",
    "word_chars",
    "n_symbols",
    "n_dup_lines",
    "n_repeat_words",
    "n_lines",
    "n_upper_words",
)


def statistics(text: str) -> tuple[int, ...]:
    """The counts named in STATISTICS. Words are parted by ASCII white space."""
    words = text.encode().split()
    spaces = sum(map(text.count, " \t\n\v\f\r"))
    seen: set[str] = set()
    lines = again = 0
    for line in text.split("\n"):
        if line.strip(" \t\n\v\f\r"):
            lines += 1
            again += line in seen
            seen.add(line)
    repeated = 0
    windows = list(zip(*(words[k:] for k in range(WINDOW_WORDS))))
    if len(windows) > len(set(windows)):
        many = Counter(windows)
        upto = 0  # words before this place are counted or in no repeated window
        for at, window in enumerate(windows):
            if many[window] > 1:
                repeated += at + WINDOW_WORDS - max(at, upto)
                upto = at + WINDOW_WORDS
    return (
        len(words),
        len(text) - spaces,
        sum(map(text.count, SYMBOLS)),
        again,
        repeated,
        lines,
        sum(map(bytes.isupper, words)),
    )


def features(stats: np.ndarray) -> np.ndarray:
    """What the forest sees: rates of the statistics (columns as in STATISTICS)."""
    words, chars, symbols, again, repeated, lines, upper = stats.astype(float).T
    some = np.maximum(words, 1)
    return np.column_stack(
        [
            chars / some,
            symbols / some,
            again / np.maximum(lines, 1),
            repeated / some,
            upper / some,
        ]
    )


def base_failed(stats: np.ndarray) -> np.ndarray:
    return (stats[:, 0] < 10) | (100 * stats[:, 4] > 20 * stats[:, 0])


def usual_path(n: float) -> float:
    """Mean path length of an unsuccessful search among n rows."""
    return 0.0 if n <= 1 else 1.0 if n == 2 else 2 * (math.log(n - 1) + 0.5772156649) - 2 * (n - 1) / n


@dataclass
class IsolationForest:
    """Trees as arrays by node: feature (-1: leaf), split value, left child (right: the next one),
    and a leaf's path length. ``scale``: the sorted values of each feature in the sample, by which
    a value becomes its share of lower ones. ``threshold``: higher scores are anomalous."""

    feature: np.ndarray
    split: np.ndarray
    left: np.ndarray
    path: np.ndarray
    scale: np.ndarray
    rows: int
    threshold: float = math.inf

    @classmethod
    def grown(
        cls, rows: np.ndarray, good: np.ndarray, trees: int = TREES, each: int = TREE_ROWS, seed: int = SEED
    ) -> IsolationForest:
        """Splits are random in feature and in place within the node's box, which begins as that
        of all rows; the rows that a tree isolates are good ones (all, if none is known as good),
        so that places without good rows end in short paths."""
        random = np.random.default_rng(seed)
        scale = np.sort(rows, axis=0).T.copy()
        usual = cls.scaled(scale, rows[good] if good.any() else rows)
        each = min(each, len(usual))
        depth = max(1, math.ceil(math.log2(max(2, each))))
        size = 2 ** (depth + 1)
        feature, split = np.full((trees, size), -1), np.zeros((trees, size))
        left, path = np.zeros((trees, size), dtype=np.int64), np.zeros((trees, size))
        wide = np.flatnonzero(scale[:, 0] < scale[:, -1])
        for t in range(trees):
            sample = usual[random.choice(len(usual), each, replace=False)]
            todo, free = [(0, sample, np.zeros(len(scale)), np.ones(len(scale)), 0)], 1
            while todo:
                at, own, low, high, level = todo.pop()
                if level == depth or len(own) <= 1 or not len(wide):
                    path[t, at] = level + usual_path(len(own))
                    continue
                f = int(random.choice(wide))
                value = random.uniform(low[f], high[f])
                side = own[:, f] < value
                feature[t, at], split[t, at], left[t, at] = f, value, free
                under, over = high.copy(), low.copy()
                under[f] = over[f] = value
                todo += [(free, own[side], low, under, level + 1), (free + 1, own[~side], over, high, level + 1)]
                free += 2
        return cls(feature, split, left, path, scale, each)

    @staticmethod
    def scaled(scale: np.ndarray, rows: np.ndarray) -> np.ndarray:
        return np.column_stack([np.searchsorted(s, rows[:, k]) / len(s) for k, s in enumerate(scale)])

    def score(self, rows: np.ndarray) -> np.ndarray:
        """From 0 to 1: two to the minus of the mean path length over the usual one."""
        rows = self.scaled(self.scale, rows)
        total = np.zeros(len(rows))
        every = np.arange(len(rows))
        for feature, split, left, path in zip(self.feature, self.split, self.left, self.path):
            at = np.zeros(len(rows), dtype=np.int64)
            while True:
                f = feature[at]
                inner = f >= 0
                if not inner.any():
                    break
                right = rows[every, np.maximum(f, 0)] >= split[at]
                at = np.where(inner, left[at] + right, at)
            total += path[at]
        return np.exp2(-total / len(self.feature) / max(usual_path(self.rows), 1e-9))

    def calibrate(self, scores: np.ndarray, good: np.ndarray) -> None:
        """The threshold that tells most bad rows from good ones, among those that keep
        KEPT_SHARE of the good ones. Without rows of both kinds nothing is anomalous."""
        if not good.any() or good.all():
            return
        least = np.quantile(scores[good], KEPT_SHARE, method="higher")
        values = np.unique(np.concatenate(([least], scores[scores >= least])))
        caught = [(scores[~good] > v).mean() - (scores[good] > v).mean() for v in values]
        best = int(np.argmax(caught))
        if caught[best] <= 0:
            return
        above = scores[scores > values[best]]
        self.threshold = float((values[best] + above.min()) / 2) if len(above) else float(values[best])

    def verdicts(self, stats: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """base_failed, score and kept of rows of statistics."""
        failed = base_failed(stats)
        scores = self.score(features(stats)) if len(stats) else np.zeros(0)
        return failed, scores, ~failed & (scores <= self.threshold)


def of_texts(values: Iterable[str]) -> np.ndarray:
    return np.array([statistics(t) for t in values], dtype=np.int64).reshape(-1, len(STATISTICS))


def with_statistics(docs: DataFrame, *others: str) -> DataFrame:
    """doc_id, the named columns, and the statistics of each text; a null text has no words."""
    frame = texts(docs) if not others else docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), *others)
    kept = [f for f in frame.schema.fields if f.name != "text"]

    def rows(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            stats = of_texts(batch.column("text").to_pylist())
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(f.name) for f in kept), *(pa.array(c) for c in stats.T)],
                names=[*(f.name for f in kept), *STATISTICS],
            )

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in kept)
    return frame.mapInArrow(rows, f"{schema}, " + ", ".join(f"{c} long" for c in STATISTICS))


def fit(docs: DataFrame, labels: DataFrame, rows: int = LABELLED_ROWS) -> IsolationForest | None:
    """Forest and threshold from about ``rows`` labelled documents, chosen by a hash of the
    doc_id; None without any. Rows that the base rules reject are not shown to the forest, as
    it does not decide on them. Null labels and doc_ids are left out; of several labels of a
    document the worst counts, of several texts of a doc_id the one whose statistics have the
    least hash."""
    named = labels.filter("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.min("quality").alias("good"))
    # The sample is bounded by ``rows``, so that it may be sent to every task.
    some = hash_sample(named, rows, named.count(), "doc_id")
    labelled = docs.select("doc_id", "text").join(F.broadcast(some), "doc_id")
    one = F.min(F.struct(F.xxhash64(*STATISTICS).alias("hash"), "good", *STATISTICS)).alias("one")
    found = with_statistics(labelled, "good").groupBy("doc_id").agg(one).select("doc_id", "one.*").toPandas()
    found = found.sort_values("doc_id")
    stats = found[list(STATISTICS)].to_numpy(dtype=np.int64)
    judged = ~base_failed(stats)
    stats, good = stats[judged], found["good"].to_numpy()[judged] > 0
    if not len(stats):
        return None
    forest = IsolationForest.grown(features(stats), good)
    forest.calibrate(forest.score(features(stats)), good)
    return forest


def judge(docs: DataFrame, forest: IsolationForest | None) -> DataFrame:
    """doc_id, statistics, base_failed, score and kept of every document.

    An empty or null text has no words and fails the base rules. Without a forest the base rules
    decide alone. Repeated rows give repeated results; extra columns are left out.
    """

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            stats = batch[list(STATISTICS)].to_numpy(dtype=np.int64)
            failed, scores, kept = verdicts(forest, stats)
            yield batch.assign(base_failed=failed, score=scores, kept=kept)

    stats = with_statistics(docs)
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in stats.schema.fields)
    return stats.mapInPandas(rows, f"{schema}, base_failed boolean, score double, kept boolean")


def verdicts(forest: IsolationForest | None, stats: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    if forest is not None:
        return forest.verdicts(stats)
    failed = base_failed(stats)
    return failed, np.zeros(len(stats)), ~failed


def passes(text: Column, forest: IsolationForest | None) -> Column:
    """Whether a text is kept, as a column."""

    @F.pandas_udf("boolean")
    def kept(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for values in batches:
            yield pd.Series(verdicts(forest, of_texts(t or "" for t in values))[2])

    return kept(text)
