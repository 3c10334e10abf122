"""Records of very many segments, copies that most rows are, ids that labels and rows repeat, and blocks of two threads."""

from __future__ import annotations

import hashlib
import threading
import time

from pyspark.sql import functions as F

from morphmill.llm import ngram_join, quality_classifier, warc
from morphmill.llm._shared import Scratch, written


def test_a_page_of_very_many_segments(spark):
    """Ten times the segments take about ten times as long, not a hundred times."""
    took = {}
    for mb in (3, 30):
        payload = "0123456789abcde\n" * (mb << 16)
        pages = spark.createDataFrame([(1, "http://a/", payload)], "page_id long, url string, html string")
        began = time.perf_counter()
        got = warc.archive_round_trip(pages, segment_bytes=2048).collect()
        took[mb] = time.perf_counter() - began
        assert [(r["payload_bytes"], r["payload_digest"], r["fault"]) for r in got] == [(mb << 20, hashlib.sha1(payload.encode()).hexdigest(), False)]
    assert took[30] < 30 * took[3] + 5


def test_copies_of_most_rows_stay_in_place(spark):
    """A third of the rows are one text: its rows are joined by a broadcast, and have one component."""
    same = " ".join(f"word{k}" for k in range(60))
    rows = [(i, same if i % 3 == 0 else f"text {i} " + " ".join(f"own{i}x{k}" for k in range(30))) for i in range(3000)] + [(None, same), (5000, None), (5001, "  ")]
    found = ngram_join.ngram_join(spark.createDataFrame(rows, "doc_id long, text string").repartition(5), 3, 90)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in found.collect()}
    assert got[None] == (58, None) and got[5000] == (0, 5000) and got[5001] == (0, 5001)
    assert {got[i][1] for i in range(0, 3000, 3)} == {0} and all(got[i][1] == i for i in range(3000) if i % 3)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = ngram_join.ngram_join(spark.createDataFrame(rows, "doc_id long, text string"), 3, 90)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "BroadcastHashJoin [n" in plan and "LeftAnti" in plan


def test_repeated_ids_are_one_row_of_the_sample(spark, monkeypatch):
    """However many rows have a labelled id, the driver gets one for each label."""
    sizes = []
    fit = quality_classifier.Evidence.fit
    monkeypatch.setattr(quality_classifier.Evidence, "fit", lambda self, rates, shares, y, *a, **k: (sizes.append(len(y)), fit(self, rates, shares, y, *a, **k))[1])
    docs = [(i % 4, f"some text {i} of a page", "h", "en") for i in range(400)]
    labels = spark.createDataFrame([(0, 1), (1, 0), (2, 1), (2, 1), (3, 0), (3, 1)], "doc_id long, quality int")
    got = quality_classifier.classify(spark.createDataFrame(docs, "doc_id long, text string, source string, lang string"), labels).collect()
    assert len(got) == 400 and sizes == [5]


def test_blocks_of_two_threads(spark):
    """What one thread keeps outlives the block of another; what is kept inside of a block goes with it."""
    results, opened, done = {}, threading.Event(), threading.Event()

    def other():
        opened.wait(60)
        with Scratch(spark) as scratch:
            results["other"] = scratch.save(spark.range(5), "theirs", keep=True)
        done.set()

    thread = threading.Thread(target=other)
    thread.start()
    with written(spark):
        opened.set()
        done.wait(60)
        with Scratch(spark) as scratch:
            results["own"] = scratch.save(spark.range(7), "own", keep=True)
            path = results["own"].inputFiles()[0]
    thread.join()
    assert results["other"].count() == 5
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    assert not p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def test_shuffle_files_go_with_a_saved_table(spark):
    """Shuffle files of a saved table go when it is written; the setting is as before."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key)
    with Scratch(spark) as scratch:
        saved = scratch.save(spark.range(1000).groupBy((F.col("id") % 7).alias("k")).count(), "sums")
        assert sorted(r["count"] for r in saved.collect())[-1] == 143
    assert spark.conf.get(key) == before
