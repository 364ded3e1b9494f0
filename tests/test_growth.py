"""Round 3's findings on growth: what a query computes for a text, it computes once."""

import unicodedata

import pytest
from pyspark.sql import functions as F

from lexmill.functions import cleaning as L
from lexmill.functions import evidence as V
from lexmill.functions import routing as R
from lexmill.functions import text as T
from lexmill.functions import triage as G
from lexmill.operators import dedup, qa


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


@pytest.fixture(scope="module")
def texts(spark):
    return spark.createDataFrame([(i, t) for i, t in enumerate(["Abc đ 12 %", "", None, "x" * 9, "Abc đ 12 %"])], "doc_id long, body string")


def test_fingerprints_are_taken_once_a_body(spark, texts):
    """each of four aggregates and joins took all fingerprints anew."""
    rows = texts.union(spark.createDataFrame([(7, "abc đ 12  %"), (8, "xxxxxxxxx ")], texts.schema))
    groups = dedup.duplicate_groups(rows)
    assert plan(groups).count("sort_array(") <= 2  # the second one is the first one's exchange
    got = {r.doc_id: (r.is_duplicate_suspect, r.duplicate_group_id, r.duplicate_reason) for r in groups.collect()}
    assert got == {
        0: (True, "exact_0", "exact_body_match"), 4: (True, "exact_0", "exact_body_match"), 7: (True, "near_7", "fingerprint_match"), 1: (True, "exact_1", "exact_body_match"),
        2: (True, "exact_1", "exact_body_match"), 3: (True, "near_3", "fingerprint_match"), 8: (True, "near_3", "fingerprint_match")}


def test_composition_reads_few_keys(spark):
    """each look into a table read up to all of its keys."""
    tables = [L._packed(which) for which in range(3)]
    assert not any(isinstance(t, str) for t in tables) and max(len(x.split("\x01")) for t in tables for x in t) <= 64
    words = ["ậ", "éü", "x́y", "ờ", "plain", "ậ́"]
    got = [r.x for r in spark.createDataFrame([(w,) for w in words], "w string").select(L.nfc(F.col("w")).alias("x")).collect()]
    assert got == [unicodedata.normalize("NFC", w) for w in words]


@pytest.mark.parametrize("find", [
    lambda c: G._has(c, ["a", "b"]), lambda c: G._starts(c, ["a", "b"]),  # F24
    lambda c: R.count_matches(c, c, ["a", "b"]), lambda c: R._any([c], ["a", "b"]),  # F25
    lambda c: V._has(c, ["a", "b"]),  # F14
])
def test_marks_are_sought_in_a_text_computed_once(texts, find):
    """a text was put in lower case, folded or joined again for each mark."""
    told = plan(texts.select(find(F.reverse("body")).alias("x")))
    assert told.index("reverse(") < told.index("lambdafunction(") and "reverse(" not in told[told.index("lambdafunction("):]


def test_rules_look_at_one_lower_case_text(texts):
    """marks of tables put the text in lower case fourteen times."""
    assert plan(texts.select(T.table_heavy(F.col("body")).alias("x"))).count("lower(") == 1
    ratios = texts.select(T.digit_ratio(F.col("body")).alias("d"), T.special_ratio(F.col("body")).alias("s"), T.table_heavy(F.concat("body", F.lit("Table %% n=n="))).alias("t"))
    assert [(r.d, r.s, r.t) for r in ratios.where("d < 1").limit(1).collect()] == [(0.2, 0.0, 6)]


def test_chunks_are_cut_once_for_their_owners(spark):
    """the aggregate and the join each cut all chunks."""
    chunks = spark.range(40).select((F.col("id") % 4).alias("doc_id"), F.floor(F.col("id") / 4).cast("int").alias("chunk_index"), (F.col("id") % 7).cast("string").alias("chunk"))
    first = qa.first_owner(chunks).select("doc_id", "chunk_index", "owner")
    rows = first.collect()
    assert "ReusedExchange" in first._jdf.queryExecution().executedPlan().toString()
    least = {}
    for i in sorted(range(40), key=lambda i: (i % 4, i // 4)):
        least.setdefault(i % 7, i % 4)
    assert sorted(tuple(r) for r in rows) == sorted((i % 4, i // 4, least[i % 7]) for i in range(40))


def test_previous_rows_come_by_ranges(spark):
    """one task sorted all articles with their texts."""
    from lexmill.operators import articles

    df = spark.range(200).select(F.format_string("k%03d", (F.col("id") * 37) % 200).alias("key"), F.when(F.col("id") % 5 > 0, F.col("id")).alias("v")).repartition(5)
    out = articles.with_previous(df, "key", {"before": "v", "last": "key"})
    assert " windowspecdefinition(key" not in plan(out) and "[__p" in plan(out)
    rows = sorted(tuple(r) for r in df.collect())
    assert sorted(tuple(r) for r in out.collect()) == [(k, v, *((rows[i - 1][1], rows[i - 1][0]) if i else (None, None))) for i, (k, v) in enumerate(rows)]


def test_a_task_holds_little_beside_its_texts():
    """F1 and the check of the pipeline: a task's temporaries grew with a megabyte of text."""
    import tracemalloc

    import numpy as np
    import pyarrow as pa

    from lexmill.llm import common, substring_dedup

    texts = [" ".join(f"w{(i * 7919 + j * 31) % 9973}" for j in range(400)) for i in range(1500)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(1500), pa.int64()), pa.array(range(1500), pa.int64()), pa.array(texts)], ["d", "m", "t"])
    common._powers = None
    tracemalloc.start()
    for _ in substring_dedup._keep(0)(iter([pa.RecordBatch.from_arrays([pa.StructArray.from_arrays([batch.column(2)], ["t"]), pa.nulls(1500, pa.list_(pa.int32()))], ["r", "s"])])):
        pass
    buf = np.frombuffer(" ".join(texts[:400]).encode(), np.uint8)
    common.word_hashes(buf, *common.word_bounds(buf))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 24 << 20
