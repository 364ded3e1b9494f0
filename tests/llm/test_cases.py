"""Defined results of the training-data operators for odd rows, names and layouts; the driver's queries."""

import hashlib
import json
import random
import re
import zlib

import numpy as np
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from lexmill.llm import chat, common, embed_dedup, html_extract, media, mixing, near_dedup, quality, queries, sentencepiece, sharding, simhash, substring_dedup

WORD = re.compile(r"[^\x20\x09-\x0D]+")
TEXTS = ["one two three four five six seven", "quite another text about something else", "a third one that shares no words"]
CLASH = "r d m k s z o t i h g e f n c v __d __m __k __t __n __r __kept __fp __s __c size passes start source_size target score shard slot grown_shard ids exact decoded media_type carved layout turns error key unit".split()


def clashing(spark, rows=None):
    """Rows (doc_id, text, source) and a column for each name that the operators use."""
    rows = rows or [(i, t, "s") for i, t in enumerate(TEXTS)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    return df.select("*", *[F.concat(F.lit(n), F.lit(" of the user")).alias(n) for n in CLASH])


def own_columns(rows, outputs=()):
    """Each row still has the user's values, under the name or ``<name>_input``."""
    for r in rows:
        for n in CLASH:
            assert r[f"{n}_input" if n in outputs else n] == f"{n} of the user", n


@pytest.mark.parametrize("module", [simhash, near_dedup])
def test_keep_one_loses_no_text(spark, module):
    rows = [(None, TEXTS[0], "s"), (None, TEXTS[1], "s"), (7, TEXTS[2], "s"), (7, TEXTS[1] + " 7", "s"), (8, TEXTS[2], "s"), (7, TEXTS[2], "s"), (9, None, "s"), (10, "", "s")]
    kept = module.keep_one(clashing(spark, rows)).collect()
    own_columns(kept)
    assert sorted((r.doc_id is not None, r.doc_id or 0, r.text or "") for r in kept) == sorted(
        [(False, 0, TEXTS[0]), (False, 0, TEXTS[1]), (True, 7, TEXTS[2]), (True, 7, TEXTS[1] + " 7"), (True, 9, "")])
    assert module.keep_one(clashing(spark).limit(0)).count() == 0


def test_simhash_splits_large_shards(spark, monkeypatch):
    rng = random.Random(9)
    base = rng.getrandbits(64)
    fps = {base ^ sum(1 << b for b in rng.sample(range(26), rng.randrange(0, 6))) for _ in range(400)} | {rng.getrandbits(64) for _ in range(200)}
    signed = sorted(x - (1 << 64) if x >> 63 else x for x in fps)
    reps = spark.createDataFrame([(x,) for x in signed], "__fp long")
    def groups(edges):
        up = {x: x for x in signed}

        def find(x):
            while up[x] != x:
                x = up[x]
            return x

        for a, b in edges:
            a, b = find(a), find(b)
            up[max(a, b)] = min(a, b)
        return {x: find(x) for x in signed}

    whole = groups((a, b) for a in signed for b in signed if a < b and ((a ^ b) & (1 << 64) - 1).bit_count() <= 2)
    for most in (2048, 5):
        monkeypatch.setattr(simhash, "SHARD", most)
        got = [(r.a, r.b) for r in simhash._sharded(reps, 2).mapInArrow(simhash._links(2), "a long, b long").collect()]
        assert groups(got) == whole and len(set(whole.values())) < len(whole)


def test_clashing_names(spark):
    df = clashing(spark)
    w = np.zeros((1 << quality.BITS) + 1)
    out = quality.score(df, w).collect()
    own_columns(out, {"score"})
    assert [r.score for r in out] == [0.5] * 3
    out = substring_dedup.remove_repeats(df).collect()
    own_columns(out, {"__n", "__r", "__kept"})
    assert sorted(r["__n"] for r in out) == [6, 7, 7]
    out = sharding.place(df, "doc_id", 4).collect()
    own_columns(out, {"shard", "slot", "grown_shard"})
    out = mixing.mix(df, carry=df.columns).collect()
    own_columns(out, {"size", "source_size", "target", "passes", "start"})
    assert sorted(r["size"] for r in out) == [6, 7, 7]
    out = mixing.mixed(df)
    assert out.columns == df.columns
    own_columns(out.collect())
    for frequent in (10, None):
        out = sentencepiece.encode(df, frequent=frequent)
        own_columns(out.collect(), {"ids", "exact"})
        back = sentencepiece.decode(out).collect()
        own_columns(back, {"ids", "exact", "decoded"})
        assert sorted(r.decoded for r in back) == sorted(TEXTS)
    out = media.correct_types(df.withColumns({"content": F.col("text").cast("binary"), "declared": F.lit("text/plain")})).collect()
    own_columns(out, {"media_type", "carved"})
    out = chat.format_chats(df.withColumn("record", F.lit('{"prompt":"p","response":"r"}'))).collect()
    own_columns(out, {"layout", "turns", "error"})
    assert {r.layout for r in out} == {"prompt_response"}
    assert len(simhash.simhash_groups(df).collect()) == len(near_dedup.jaccard_groups(df).collect()) == 3


def test_empty_tables(spark):
    none = clashing(spark).limit(0)
    assert mixing.mixed(none).count() == 0 and near_dedup.keep_one(none).count() == 0
    assert media.correct_types(none.withColumns({"content": F.col("text").cast("binary"), "declared": F.col("text")})).count() == 0
    assert sentencepiece.decode(sentencepiece.encode(none)).count() == sentencepiece.encode(none, frequent=None).count() == 0


def test_pipeline_stages_take_any_rows(spark):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    rows = [(None, TEXTS[0], None), (None, TEXTS[1], "a"), (3, None, "a"), (3, "", "b"), (4, TEXTS[2] * 40, "b"), (4, TEXTS[2] * 40, "b")]
    df = clashing(spark, rows).withColumn("n_chars", F.char_length("text").cast("long"))
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, df, "/root/testdata/sf0.001")
        rows = out.collect()
        if name != "sentencepiece":
            assert out.columns == df.columns, name
            own_columns(rows)
        if name == "substring_dedup":
            assert len(rows) == 6 and {r.doc_id for r in rows} == {None, 3, 4}
        assert stage(spark, df.limit(0), "/root/testdata/sf0.001").count() == 0, name


# -------------------------------------------------------------------- embeddings
def test_each_row_is_a_vector(spark):
    rows = [(1, [1.0, 0.0]), (1, [1.0, 0.0]), (1, [0.0, 1.0]), (2, [1.0, 0.1]), (None, [0.0, 1.0]), (None, None), (3, [0.0, 0.0])]
    out = embed_dedup.link_groups(spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("name", F.lit("x"))).collect()
    least = -(1 << 63)
    key = lambda r: (r[0] is not None, r[0] or 0, r[1], r[2], r[3])
    assert sorted(map(tuple, out), key=key) == sorted(
        [(1, 2, 1, True), (1, 2, 1, True), (1, 1, least, False), (2, 2, 1, False), (None, 1, least, True), (None, 0, least, True), (3, 0, 3, True)], key=key)


# ------------------------------------------------------------------------ pieces
@pytest.mark.parametrize("frequent", [5, 131_072, None])
def test_ids_equal_the_library(spark, frequent):
    m = sentencepiece.model_of(sentencepiece.read_model())
    rng = random.Random(4)
    texts = ["", None, "the  quick brown fox, 1234 times!", "Ünïcödé — naïve", "日本語テキスト" * 20, "x" * 200, "a\tb\n\nc  d", "\x00 %%%", " lead and trail "]
    texts += ["".join(rng.choice("abcdefghijklm ,.nopqrstuvwxyzéß1") for _ in range(400)) for _ in range(20)] + ["    " * 9 + "spaces"]
    out = sentencepiece.encode(clashing(spark, [(i, t, "s") for i, t in enumerate(texts)]), carry=["doc_id"], frequent=frequent).collect()
    assert out and len(out) == len(texts)
    for r in out:
        assert r.exact and list(r.ids) == m.sp.encode(texts[r.doc_id] or ""), texts[r.doc_id]


def test_inverting_pieces():
    assert sentencepiece.inverting({"ab": -1.0, "abc": -2.0, "bc": -3.0}) == set()
    assert sentencepiece.inverting({"bc": -5.0, "abc": -2.0}) == {"abc"}


def test_inverting_units_fold_step_by_step(spark):
    class Small:
        pieces = [("a", 0, 0.0), ("b", 1, 0.0), ("c", 2, 0.0), ("bc", 3, -5.0), ("abc", 4, -2.0), ("ca", 5, -3.0)]
        longest, bytes_ids = 3, {i: 100 + i for i in range(256)}

    got = {r.unit: r.ids for r in sentencepiece.encode_units(spark.createDataFrame([("abc",), ("abca",), ("bcz",)], "unit string"), Small).collect()}
    assert got == {"abc": [4], "abca": [0, 1, 5], "bcz": [3, 100 + ord("z")]}


# -------------------------------------------------------------------------- chat
def test_layouts_ignore_other_fields_and_name_errors(spark):
    recs = [
        {"id": 1, "messages": [{"role": "user", "content": "q"}, {"role": "assistant", "content": "a", "name": "x"}]},
        {"messages": [{"role": "user", "content": [{"type": "text", "text": "q"}, "r"]}, {"role": "assistant", "content": None}]},
        {"messages": []}, {"messages": [{"role": "user", "content": [{"type": "image", "url": "u"}]}]}, {"messages": "no list"}, {"what": 1}, [1],
        {"prompt": "p", "response": "r", "meta": {"a": [1]}}, {"prompt": "p", "response": "r", "messages": []},
    ]
    df = spark.createDataFrame([(i, json.dumps(r)) for i, r in enumerate(recs)] + [(20, None), (21, "{")], "i int, record string")
    got = {r.i: (r.layout, [(t.role, t.text) for t in r.turns], r.error) for r in chat.format_chats(df).collect()}
    assert got[0] == ("messages", [("user", "q"), ("assistant", "a")], None)
    assert got[1] == ("messages", [("user", "qr"), ("assistant", "")], None)
    assert got[2] == ("messages", [], None)
    assert got[3] == (None, [], "a part without text")
    assert got[4] == got[5] == (None, [], "unknown layout: ")
    assert got[6] == (None, [], "not an object") and got[20] == (None, [], "null record") and got[21] == (None, [], "not JSON")
    assert got[7] == ("prompt_response", [("user", "p"), ("assistant", "r")], None)
    assert got[8] == (None, [], "unknown layout: messages,prompt,response")


# ------------------------------------------------------------------------ mixing
def test_mix_with_ties_is_the_same_in_any_layout(spark):
    rows = [(5, f"word{i} two three", "a") for i in range(40)] + [(i, "x " * 30, "b") for i in range(6, 30)]
    df = clashing(spark, rows)
    sets = {tuple(sorted(r.text for r in mixing.mixed(df.repartition(n)).collect())) for n in (1, 3, 7)}
    assert len(sets) == 1


# -------------------------------------------------------------------------- html
def test_names_inside_an_article(spark):
    page = "<article><p>a</p><div class='related-work'><p>b</p></div><div id='share-prices'>c</div><div class='related-posts'>d</div><div class='ad'>e</div><p class='adSlot'>f</p></article>"
    assert html_extract.parse(page)[0] == ["a", "b", "c"]


def test_quotes_on_unmarked_pages_stay(spark):
    quote = "this is a long passage that three of the pages of the site quote word by word"
    rows = [(i, "http://h/", f"<p>page {i} says its own thing {'x' * i}</p>" + (f"<p>{quote}</p>" if i < 3 else "")) for i in range(20)]
    got = {r.page_id: r.text for r in html_extract.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert all(quote in got[i] for i in range(3))


def test_very_long_pages(spark):
    rows = [(1, "http://h/", "<article>" + "<p>" + "word " * 200_000 + "</p></article>"), (2, "http://g/", "<p>" + " ".join(map(str, range(60_000))) + "</p>")]
    got = {r.page_id: r.n_chars for r in html_extract.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got[1] == 200_000 * 5 - 1 and got[2] == len(" ".join(map(str, range(60_000))))


# ----------------------------------------------------------------------- quality
def test_ftrl_against_a_plain_loop():
    rng = random.Random(3)
    rows = [(np.array(sorted(rng.sample(range(50), 6)), np.int32), rng.randrange(2)) for _ in range(60)]
    model = quality.Ftrl(6)
    z, n = {}, {}
    for grams, label in rows:
        model.learn(grams, label)
        x = {int(g): 1 / len(grams) ** 0.5 for g in grams} | {64: 1.0}
        w = {}
        for i in x:
            zi, ni = z.get(i, 0.0), n.get(i, 0.0)
            w[i] = 0.0 if abs(zi) <= quality.L1 else ((1 if zi > 0 else -1) * quality.L1 - zi) / ((quality.BETA + ni**0.5) / quality.ALPHA + quality.L2)
        p = 1 / (1 + np.exp(-sum(w[i] * x[i] for i in x)))
        for i in x:
            g = (p - label) * x[i]
            z[i] = z.get(i, 0.0) + g - ((n.get(i, 0.0) + g * g) ** 0.5 - n.get(i, 0.0) ** 0.5) / quality.ALPHA * w[i]
            n[i] = n.get(i, 0.0) + g * g
    for i, v in z.items():
        assert abs(model.z[i] - v) < 1e-9 and abs(model.n[i] - n[i]) < 1e-9


def test_word_features_are_the_distinct_grams():
    a, b = (next(quality.features([t])) for t in (b"one two three one two", b"one  two\tthree one two one two three one two"))
    words, pairs = {"one", "two", "three"}, {("one", "two"), ("two", "three"), ("three", "one")}
    assert set(a.tolist()) <= set(b.tolist()) and len(words) + len(pairs) <= len(a)
    assert len(next(quality.features([b""]))) == 0


# ----------------------------------------------------------------------- queries
SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def documents():
    return pq.read_table(f"{SF}/documents.parquet").to_pandas()


def test_query_op2(spark, documents):
    out = {r.doc_id: r for r in queries.op2_quality_classifier(spark, SF).collect()}
    assert set(out) == set(documents.doc_id)
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 5 == 0) and 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for i, r in out.items())


def test_query_op3(spark, documents):
    out = {r.doc_id: r for r in queries.op3_media_columns(spark, SF).collect()}
    for i, t in zip(documents.doc_id, documents.text, strict=True):
        b = t.encode()
        pay = b + bytes(-len(b) % 64 if b else 64)
        assert (out[i].n_bytes, out[i].payload_sha256, out[i].tail_crc32) == (len(b), hashlib.sha256(pay).hexdigest(), zlib.crc32(pay[-64:]))
        x = np.frombuffer(pay, np.uint8).astype(int)
        p = np.unique(x, return_counts=True)[1] / len(x)
        want = (f"n={len(x)};mean={x.mean():.6f};rms={((x - 128) ** 2).mean() ** 0.5:.6f};entropy={abs(-(p * np.log2(p)).sum()):.6f};"
                f"crossings={sum((a >= 128) != (b >= 128) for a, b in zip(x[:-1], x[1:], strict=True))};peak={x.max()}")
        assert out[i].feature == want


def test_query_op7(spark, documents):
    m = sentencepiece.model_of(sentencepiece.read_model())
    out = {r.doc_id: r for r in queries.op7_sentencepiece(spark, SF).collect()}
    for i, t in zip(documents.doc_id, documents.text, strict=True):
        if "▁" not in t:
            ids = m.sp.encode(t)
            assert (out[i].n_ids, out[i].ids_sha256, out[i].exact) == (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), True)


def test_query_op8(spark, documents):
    out = {r.doc_id: r for r in queries.op8_sharding(spark, SF).collect()}
    for i, t in zip(documents.doc_id, documents.text, strict=True):
        assert (out[i]["size"], out[i].text_crc32, out[i].law) == (len(t.encode()) + 1, zlib.crc32(t.encode()), "key")
    for s in range(16):
        slots = sorted(r.slot for r in out.values() if r.shard == s)
        assert slots == list(range(len(slots)))


def test_shared_folder_is_asked_for_on_a_cluster():
    class Conf:
        def get(self, name, default=None):
            return default

    class Cluster:
        conf = Conf()
        sparkContext = type("C", (), {"master": "spark://x:7077"})()  # noqa: N815

    with pytest.raises(RuntimeError, match="checkpoint"):
        common.shared_folder(Cluster())
