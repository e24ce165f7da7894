"""The corpus pipeline, stage by stage, on the smallest tables."""

import inspect
import re
from pathlib import Path

import corpus_pipeline
import numpy as np
from pyspark.sql import functions as F

from sparkloom.llm import minhash, passages, toxicity
from sparkloom.llm.common import saved, trimmed

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, kept = docs.columns, docs.count()
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "minhash_near_dedup", "substring_dedup", "secret_scan", "packing"]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before, docs = docs, saved(stage(spark, docs, SF), name)
        assert docs.columns == columns and docs.count() <= kept
        assert docs.join(before, "doc_id", "left_anti").count() == 0
        kept = docs.count()
    assert not [r for r in docs.collect() if re.search(r'token = "[0-9a-f]{40}"', r.text)]
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, SF)
    assert packed.count() == kept and packed.select("doc_id").distinct().count() == kept
    assert kept > 150


def test_rows_without_text_pass(spark):
    docs = spark.createDataFrame([(1, None, "en", "s", 0), (2, "", "en", "s", 0), (3, "some clean words", None, None, 16)], "doc_id long, text string, lang string, source string, n_chars long")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = saved(stage(spark, docs, SF), name)
    assert {r.doc_id for r in docs.collect()} == {1, 2, 3}


def through(spark, docs):
    for name, stage in corpus_pipeline.STAGES:
        docs = saved(stage(spark, docs, SF), name)
    return docs


COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


def test_empty_table(spark):
    assert through(spark, spark.createDataFrame([], COLUMNS)).count() == 0


def test_repeated_rows_ties_long_texts_and_clashing_columns(spark):
    long = " ".join(f"w{k * k % 9973}x{k}" for k in range(30_000))
    rows = [(1, "the same few words here", "en", "s", 23)] * 2 + [(5, long, "en", "s", len(long)), (6, long, None, "s", len(long)), (9, "", "en", "s", 0), (None, None, None, None, None), (None, "without an id", "en", "s", 13)]
    docs = spark.createDataFrame(rows, COLUMNS).withColumns({c: F.lit(c) for c in ("score", "component", "key", "id", "_id", "spans", "secrets", "place", "batch_id", "c0", "kept")})
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = saved(stage(spark, docs, SF), name)
        assert after.columns == docs.columns
        docs = after
    kept = docs.collect()
    assert sorted((r.doc_id for r in kept), key=str) == sorted([1, 1, 5, 9, None, None], key=str)
    assert all(r.key == "key" and r.score == "score" for r in kept) and {r.text for r in kept} == {"the same few words here", long, "", None, "without an id"}
    assert corpus_pipeline.STAGES[-1][1](spark, docs, SF).count() == 6


def held_mb() -> int:
    return sum(map(int, re.findall(r"\nPss_Anon:\s+(\d+)", Path("/proc/self/smaps_rollup").read_text()))) // 1024


def test_a_worker_hands_back_what_a_task_freed():
    # Blocks below the allocator's bound for maps of their own, one in a hundred of which outlives the task.
    alive = []

    def run(batches):
        blocks = [np.ones(12_000) for _ in range(1_000)]
        alive.extend(blocks[::100])
        yield from batches

    before = held_mb()
    assert list(trimmed(run)(iter([1, 2]))) == [1, 2]
    assert held_mb() - before < 40


def test_stages_leave_workers_trimmed():
    # Every stage in Python of a whole pipeline leaves its worker so.
    for module in (toxicity, minhash, passages):
        calls = re.findall(r"\.mapInArrow\((\w+)", inspect.getsource(module))
        assert calls and set(calls) == {"trimmed"}
