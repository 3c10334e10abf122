"""Quality rules with host verdicts.

Each text is counted once, in numpy over Arrow batches. Rule failures are then
aggregated by host, each host's failure rates are shrunk by a beta prior fitted
to all hosts, and the hosts' verdicts are joined back to the documents.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from morphmill.llm._shared import Scratch, spare_name
from morphmill.llm._text import _SPACE, slices, text_bytes, windows, word_bounds, word_hashes

_SYMBOL = np.isin(np.arange(256), list(b"#*$%&|<>"))
_START = (np.arange(256) & 0xC0) != 0x80
_UPPER = (np.arange(256) >= 65) & (np.arange(256) <= 90)
COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper"]

#: Rules beyond the base, as SQL over the counts: a document that fails one isn't kept.
RULES = {
    "symbols": "3 * n_symbols > n_words",
    "capitals": "2 * n_upper > word_chars",
    "repeated_lines": "2 * n_dup_lines > n_lines",
    "word_length": "word_chars > 20 * n_words or word_chars < 2 * n_words",
}
BASE_FAILED = "n_words < 50 or 100 * n_repeat_words > 50 * n_words"


def _repeat_words(grams: np.ndarray, n: int) -> int:
    """Words, of n, in windows of three whose hash occurs twice or more."""
    order = np.argsort(grams, kind="stable")
    s = grams[order]
    same = s[1:] == s[:-1]
    if not same.any():
        return 0
    twice = np.zeros(len(s), bool)
    twice[1:] |= same
    twice[:-1] |= same
    covered = np.zeros(n, bool)
    at = order[twice]
    covered[at] = covered[at + 1] = covered[at + 2] = True
    return int(covered.sum())


def _per_text(flags: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    running = np.concatenate(([0], np.cumsum(flags, dtype=np.int64)))
    return running[offsets[1:]] - running[offsets[:-1]]


def count_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, host, text) to (id, host, COUNTS)."""
    for batch in batches:
        data, offsets = text_bytes(batch.column("text"))
        out: list[list[np.ndarray]] = []
        for i, j in slices(offsets):
            part, offs = data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
            starts, ends, doc = word_bounds(part, offs)
            first = np.searchsorted(doc, np.arange(j - i + 1))
            hashes = word_hashes(part, starts, ends)
            grams = windows(hashes, 3)
            word = ~_SPACE[part]
            repeats, dups, lines = [], [], []
            raw = part.tobytes()
            for d in range(j - i):
                a, b = int(first[d]), int(first[d + 1])
                repeats.append(_repeat_words(grams[a : b - 2], b - a) if b - a > 3 else 0)
                own = [x for x in raw[offs[d] : offs[d + 1]].split(b"\n") if x.strip()]
                lines.append(len(own))
                dups.append(len(own) - len(set(own)))
            out.append([np.diff(first), _per_text(word & _START[part], offs), _per_text(_SYMBOL[part], offs), np.array(dups), np.array(repeats), np.array(lines), _per_text(_UPPER[part], offs)])
        columns = [pa.array(np.concatenate(x), pa.int64()) for x in zip(*out, strict=True)] if out else [pa.array([], pa.int64())] * len(COUNTS)
        yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("host"), *columns], ["id", "host", *COUNTS])


def host_verdicts(checked: DataFrame, rules: list[str], factor: float = 2.0, sure: float = 2.0, least_rate: float = 0.2) -> DataFrame:
    """(host, n_docs, <rule>_rate ..., host_bad) from rows with host and a boolean per rule.

    A host's rate of a rule has a beta posterior, (fails + a, passes + b), with
    the prior (a, b) of the rule fitted to all hosts by moments: the spread of
    the hosts' rates beyond what their sizes explain. Its mean is the shrunk rate.
    A host is bad if, for some rule, that mean less ``sure`` of the posterior's
    deviations is above ``factor`` times the rule's rate in the corpus, and above
    ``least_rate``. So a sparse host is bad only if the prior's spread makes it
    likely. The priors are one row, made by an aggregate of the hosts.
    """
    n = F.col("n_docs")
    hosts = checked.groupBy("host").agg(F.count("*").alias("n_docs"), *[F.sum(F.col(r).cast("long")).alias(f"{r}_fails") for r in rules])
    priors = []
    for r in rules:
        fails = F.col(f"{r}_fails")
        mean = F.sum(fails) / F.sum("n_docs")
        priors += [mean.alias(f"{r}_m"), F.sum(fails * fails / n).alias(f"{r}_q")]
    total = hosts.agg(F.count("*").alias("hosts"), F.sum("n_docs").alias("docs"), F.sum(n * n).alias("squares"), *priors)
    joined = hosts.crossJoin(F.broadcast(total))  # one row
    rates, bad = [], []
    for r in rules:
        m = F.col(f"{r}_m")
        noise = m * (1 - m)
        # sum of n * (rate - m)^2 has the mean (hosts - 1) * noise + spread * (docs - squares / docs)
        between = (F.col(f"{r}_q") - F.col("docs") * m * m - (F.col("hosts") - 1) * noise) / F.greatest(F.col("docs") - F.col("squares") / F.col("docs"), F.lit(1.0))
        strength = F.when((noise <= 0) | (between <= noise / 1e6), F.lit(1e6)).otherwise(F.greatest(noise / between - 1, F.lit(1.0)))
        rate = (F.col(f"{r}_fails") + strength * m) / (n + strength)
        low = rate - sure * F.sqrt(rate * (1 - rate) / (n + strength + 1))
        rates.append(rate.alias(f"{r}_rate"))
        bad.append(low > F.greatest(factor * m, F.lit(least_rate)))
    return joined.select("host", "n_docs", *rates, reduce(Column.__or__, bad).alias("host_bad"))


def quality_rules(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", **how) -> DataFrame:
    """Per row of docs: its id, host, counts, ``base_failed``, each rule's verdict, the host's rates and ``kept``.

    Kept is a row that passes the base rules and all of ``RULES`` and whose host
    isn't bad (``how``: the limits of ``host_verdicts``). A null text is empty and
    fails the base; a null host is a host of its own. Repeated rows count each.
    Other columns are not returned. An empty table gives an empty result.
    """
    with Scratch(docs.sparkSession) as scratch:
        rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(host_col).cast("string").alias("host"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
        schema = "id long, host string, " + ", ".join(f"{c} long" for c in COUNTS)
        counted = scratch.save(rows.mapInArrow(count_batches, schema), "counts", keep=True)
        checked = counted.withColumn("base_failed", F.expr(BASE_FAILED))
        for rule, failed in RULES.items():
            checked = checked.withColumn(rule, F.expr(failed) & (F.col("n_words") > 0))
        # a row per host; saved, so that Spark knows its size and broadcasts or splits by it
        hosts = scratch.save(host_verdicts(checked, ["base_failed", *RULES], **how), "hosts", keep=True)
    joined = checked.alias("d").join(hosts.alias("h"), F.expr("d.host <=> h.host"), "left").drop(F.col("h.host"))
    failed = F.col("base_failed") | F.col("host_bad")
    for rule in RULES:
        failed = failed | F.col(rule)
    return joined.withColumn("kept", ~failed).withColumnRenamed("id", id_col)


def kept_documents(docs: DataFrame, id_col: str = "doc_id", **how) -> DataFrame:
    """The rows of docs that the rules keep, columns as they are. Ids are unique."""
    judged = quality_rules(docs, id_col=id_col, **how)
    own = spare_name(docs, "_kept")
    kept = judged.where("kept").select(F.col(id_col).alias(own)).distinct()
    return docs.join(kept, docs[id_col].eqNullSafe(F.col(own)), "left_semi")
