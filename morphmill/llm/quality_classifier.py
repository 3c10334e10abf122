"""Quality classification by hierarchical empirical Bayes.

A logistic classifier, trained here in numpy on a bounded sample of labelled
rows, gives each document's evidence: from rates of its characters, words and
lines, and from the hashed frequencies of its words and pairs of words. Its
probabilities are aggregated by path and host; a host's posterior is shrunk to
the global prior and a path's to its host's, by strengths fitted to the spread
among hosts and paths. A document's odds are its own evidence with the global
prior odds replaced by its path's. Documents have no URL here, so that by default
their source is the host and their language the path.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from morphmill.llm._shared import Scratch
from morphmill.llm._text import _SPACE, line_bounds, line_hashes, slices, text_bytes, windows, word_bounds, word_hashes

#: Labelled rows that the classifier is fitted on, at most: those first in the order of a hash of their id.
TRAIN_ROWS = 20_000
_CLASSES = [np.isin(np.arange(256), list(x)) for x in (b"#*$%&<>", b"|", b"!", b"0123456789", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b".,;:")]
#: Buckets of hashed words and pairs of words.
GRAMS = 1024
RATES = ["log_words", "word_length", "marks", "bars", "bangs", "digits", "capitals", "stops", "distinct", "repeats", "same_lines", "line_words"]


def _rates(part: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """Per text a row of RATES, and the roots of its GRAMS buckets' frequencies."""
    n = len(offs) - 1
    starts, ends, doc = word_bounds(part, offs)
    hashes = word_hashes(part, starts, ends)
    first = np.searchsorted(doc, np.arange(n + 1))
    words = np.diff(first).astype(float)
    some = np.maximum(words, 1)

    def count(flags: np.ndarray) -> np.ndarray:
        return np.diff(np.concatenate(([0], np.cumsum(flags, dtype=np.int64)))[offs]).astype(float)

    chars = np.maximum(count(~_SPACE[part]), 1)
    kinds = [count(c[part]) for c in _CLASSES]
    distinct, repeats, same = np.zeros(n), np.zeros(n), np.zeros(n)
    grams = windows(hashes, 2)
    l_starts, l_ends, l_doc = line_bounds(part, offs)
    lines, l_first = line_hashes(part, l_starts, l_ends), np.searchsorted(l_doc, np.arange(n + 1))
    for d in range(n):
        a, b = int(first[d]), int(first[d + 1])
        if b > a:
            distinct[d] = len(np.unique(hashes[a:b])) / (b - a)
        if b - a > 1:
            repeats[d] = 1 - len(np.unique(grams[a : b - 1])) / (b - a - 1)
        own = lines[l_first[d] : l_first[d + 1]]
        same[d] = 1 - len(np.unique(own)) / len(own)
    columns = [np.log1p(words), chars / some, kinds[0] / some, kinds[1] / some, kinds[2] / some, kinds[3] / chars, kinds[4] / chars, kinds[5] / some, distinct, repeats, same, np.log1p(words / np.diff(l_first))]
    held = (doc * GRAMS + (hashes % np.uint64(GRAMS)).astype(np.int64), doc[:-1][doc[1:] == doc[:-1]] * GRAMS + (grams[doc[1:] == doc[:-1]] % np.uint64(GRAMS)).astype(np.int64) if len(doc) > 1 else doc[:0])
    counts = np.bincount(np.concatenate(held), minlength=n * GRAMS).reshape(n, GRAMS)
    shares = np.sqrt(counts / np.maximum(counts.sum(axis=1, keepdims=True), 1)).astype(np.float32)
    return np.stack(columns, axis=1), shares


def _per_slice(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    data, offsets = text_bytes(column)
    for i, j in slices(offsets):
        yield i, j, *_rates(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])


def feature_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, y, text) to (y, rates, shares), as bytes of single floats."""
    for batch in batches:
        for i, j, rates, shares in _per_slice(batch.column("text")):
            columns = [pa.array([r.astype(np.float32).tobytes() for r in x], pa.binary()) for x in (rates, shares)]
            yield pa.RecordBatch.from_arrays([batch.column("id").slice(i, j - i), batch.column("y").slice(i, j - i), *columns], ["id", "y", "rates", "shares"])


class Evidence:
    """Log odds of quality: a ridge logistic regression over scaled rates, their squares, and shares of hashed words."""

    def __init__(self) -> None:
        self.centre, self.scale = np.zeros(len(RATES)), np.ones(len(RATES))
        self.w, self.b = np.zeros(2 * len(RATES) + GRAMS), 0.0

    def _inputs(self, rates: np.ndarray, shares: np.ndarray) -> np.ndarray:
        z = np.clip((rates - self.centre) / self.scale, -4, 4)
        return np.concatenate([z, z * z, shares * 4], axis=1).astype(np.float32)

    def fit(self, rates: np.ndarray, shares: np.ndarray, y: np.ndarray, ridge: float = 2.0, steps: int = 300) -> None:
        """Gradient steps with momentum, at the step size that the curvature's bound allows.

        The inputs are held once, in single floats; products with them are too, so that no step copies them.
        """
        self.centre, self.scale = rates.mean(axis=0), rates.std(axis=0) + 1e-9
        x = np.ones((len(y), len(self.w) + 1), np.float32)
        for i in range(0, len(y), 1024):
            x[i : i + 1024, :-1] = self._inputs(rates[i : i + 1024], shares[i : i + 1024])
        ridges = np.full(x.shape[1], ridge)
        ridges[-1] = 1e-6
        # the largest curvature, by the power method
        v = np.ones(x.shape[1], np.float32)
        for _ in range(20):
            v = x.T @ (x @ v)
            v /= np.linalg.norm(v) + 1e-12
        rate = 1 / (0.25 * float(np.linalg.norm(x.T @ (x @ v))) + ridge)
        w = ahead = np.zeros(x.shape[1])
        for k in range(steps):
            p = 1 / (1 + np.exp(-np.clip((x @ ahead.astype(np.float32)).astype(float), -30, 30)))
            new = ahead - rate * ((p - y).astype(np.float32) @ x + ridges * ahead)
            ahead = new + k / (k + 3) * (new - w)
            w = new
        self.w, self.b = w[:-1], float(w[-1])

    def score(self, rates: np.ndarray, shares: np.ndarray) -> np.ndarray:
        return self._inputs(rates, shares) @ self.w + self.b


def posteriors(scored: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(paths, total): ``path_rate`` per host and path, and the one row of the global prior, from rows of host, path, p.

    With the mean m, within-group noise m (1 - m) and a group's size n, groups'
    rates have the variance spread + noise / n; the strength noise / spread - 1
    is the number of documents that the prior is worth.
    """
    paths = scored.groupBy("host", "path").agg(F.count("*").alias("n"), F.sum("p").alias("s"))
    hosts = paths.groupBy("host").agg(F.sum("n").alias("host_n"), F.sum("s").alias("host_s"))

    def prior(groups: DataFrame, n: str, s: str, mean: Column, name: str) -> list[Column]:
        noise = mean * (1 - mean)
        spread = (F.sum(F.col(s) * F.col(s) / F.col(n)) - F.sum(n) * mean * mean - (F.count("*") - 1) * noise) / F.greatest(F.sum(n) - F.sum(F.col(n) * F.col(n)) / F.sum(n), F.lit(1.0))
        return [F.when((noise <= 0) | (spread <= noise / 1e4), F.lit(1e4)).otherwise(F.greatest(noise / spread - 1, F.lit(1.0))).alias(name)]

    mean = F.sum("host_s") / F.sum("host_n")
    total = hosts.agg(mean.alias("mean"), *prior(hosts, "host_n", "host_s", mean, "host_strength"))
    path_mean = F.sum("s") / F.sum("n")
    total = total.crossJoin(paths.agg(*prior(paths, "n", "s", path_mean, "path_strength")))  # one row each
    joined = paths.alias("p").join(hosts.alias("h"), F.expr("p.host <=> h.host")).drop(F.col("h.host")).crossJoin(F.broadcast(total))
    host_rate = (F.col("host_s") + F.col("host_strength") * F.col("mean")) / (F.col("host_n") + F.col("host_strength"))
    path_rate = (F.col("s") + F.col("path_strength") * F.col("host_rate")) / (F.col("n") + F.col("path_strength"))
    paths = joined.withColumn("host_rate", host_rate).withColumn("path_rate", path_rate)
    return paths.select("host", "path", "n", "host_rate", "path_rate", "mean"), total


def classify(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", path_col: str = "lang", label_col: str = "quality", least: float = 0.5, train_rows: int = TRAIN_ROWS) -> DataFrame:
    """Per row of docs: its id, ``evidence`` (log odds of the classifier), ``host_rate``, ``path_rate``, ``score`` and ``kept`` (score >= least).

    labels: (id, 0 or 1); other labels and null ids count as none; the classifier
    is fitted on ``train_rows`` of them at most, and for each on one of the rows
    that have its id. Without rows of both labels the evidence is 0. Null or empty texts are classified as what
    they are; null hosts and paths are groups of their own. Repeated rows count
    each. Other columns are not returned. An empty table gives an empty result.
    """
    spark = docs.sparkSession
    rows = docs.select(
        F.col(id_col).cast("long").alias("id"), F.col(host_col).cast("string").alias("host"), F.col(path_col).cast("string").alias("path"), F.coalesce(F.col(text_col), F.lit("")).alias("text"),
    )
    known = labels.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("int").alias("y")).where("y in (0, 1) and id is not null")
    # train_rows numbers at most; a document's features are some KB
    drawn = F.broadcast(known.orderBy(F.xxhash64("id"), "id", "y").limit(train_rows))
    # of rows that repeat an id one is taken, so that there are no more rows than labels
    own = rows.select("id", "text").join(drawn, "id").groupBy("id", "y").agg(F.min("text").alias("text"))
    sample = sorted(own.mapInArrow(feature_batches, "id long, y int, rates binary, shares binary").collect())
    y = np.array([r["y"] for r in sample], float)
    model = Evidence()
    if len(set(y)) == 2:
        rates, shares = np.empty((len(y), len(RATES)), np.float32), np.empty((len(y), GRAMS), np.float32)
        for i, r in enumerate(sample):
            rates[i], shares[i] = np.frombuffer(r["rates"], np.float32), np.frombuffer(r["shares"], np.float32)
        del sample
        model.fit(rates, shares, y)
        del rates, shares
    held = spark.sparkContext.broadcast(model)  # some thousand numbers

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, rates, shares in _per_slice(batch.column("text")):
                own = pa.array(held.value.score(rates, shares), pa.float64())
                yield pa.RecordBatch.from_arrays([*(batch.column(c).slice(i, j - i) for c in ("id", "host", "path")), own], ["id", "host", "path", "evidence"])

    with Scratch(spark) as scratch:
        scored = scratch.save(rows.mapInArrow(score, "id long, host string, path string, evidence double").withColumn("p", 1 / (1 + F.exp(-F.col("evidence")))), "scores", keep=True)
        # a row per host and path; saved, so that Spark knows its size and broadcasts or splits by it
        paths = scratch.save(posteriors(scored)[0], "paths", keep=True)
    joined = scored.alias("d").join(paths.alias("p"), F.expr("d.host <=> p.host and d.path <=> p.path"), "left")
    edge = lambda c: F.least(F.greatest(c, F.lit(1e-6)), F.lit(1 - 1e-6))
    logit = lambda c: F.log(edge(c) / (1 - edge(c)))
    odds = F.col("evidence") + logit(F.col("path_rate")) - logit(F.col("mean"))
    out = joined.select(F.col("id").alias(id_col), "evidence", "host_rate", "path_rate", (1 / (1 + F.exp(-odds))).alias("score"))
    return out.withColumn("kept", F.col("score") >= least)
