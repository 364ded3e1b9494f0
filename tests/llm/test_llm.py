"""Training-data operators against brute force, round trips and held-out labels."""

import hashlib
import math
import random
import re
import struct
import zlib

import numpy as np
import pandas as pd
import pyarrow.parquet as pq
import pytest
import xxhash
from pyspark.sql import functions as F

from lexmill.llm import chat, components, embed_dedup, html_extract, media, mixing, near_dedup, quality, sentencepiece, sharding, simhash, substring_dedup

DATA = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, source string, __x string, score double, shard int"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def docs(spark, rows):
    """Rows (id, text, source) with columns whose names could clash."""
    return spark.createDataFrame([(i, t, s, "x", 0.5, 3) for i, t, s in rows], DOCS)


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, empty and long texts, repeated rows, copies."""
    rng = random.Random(3)
    words = [f"w{i}" for i in range(40)]
    text = " ".join(rng.choice(words) for _ in range(90))
    rows = [
        (1, text, "a"), (2, text, "a"), (2, text, "a"), (3, None, None), (4, "", "b"), (5, " \t\n", "b"), (None, "null id " + text[:200], "a"),
        (6, "one", "c"), (7, " ".join(f"long{i}" for i in range(30_000)), "b"), (8, text[40:300] + " tail of its own", "c"), (9, "a a a a " * 40, "a"), (10, "É ß ▁ x\x00y", "c"),
    ]
    return docs(spark, rows)


# ------------------------------------------------------------------ substrings
def brute_windows(rows, window=20):
    first, out = {}, []
    order = sorted(((-math.inf if i is None else i), t) for i, t in rows)
    for i, t in order:
        w = WORD.findall(t or "")
        for p in range(len(w) - window + 1):
            k = tuple(w[p : p + window])
            first[k] = min(first.get(k, (math.inf, 0)), (i, p))
    for i, t in order:
        w = WORD.findall(t or "")
        gone = set()
        for p in range(len(w) - window + 1):
            if first[tuple(w[p : p + window])] != (i, p):
                gone.update(range(p, p + window))
        out.append((i, len(w), len(gone), " ".join(x for j, x in enumerate(w) if j not in gone)))
    return sorted(out)


def test_substring_dedup(spark, odd):
    rows = [(r.doc_id, r.text) for r in odd.collect()]
    got = substring_dedup.remove_repeats(odd).collect()
    assert sorted(((-math.inf if r.doc_id is None else r.doc_id), r["__n"], r["__r"], r["__kept"]) for r in got) == brute_windows(rows)
    assert {r["__x"] for r in got} == {"x"}
    assert substring_dedup.remove_repeats(odd.limit(0)).count() == 0


def test_substring_dedup_random(spark):
    rng = random.Random(1)
    passages = [" ".join(f"p{k}_{rng.randrange(6)}" for k in range(35)) for _ in range(4)]
    rows = [(i, " ".join([f"u{i}_{rng.randrange(9)}" for _ in range(rng.randrange(30))] + [rng.choice(passages)] + ["z"] * rng.randrange(45) + [rng.choice(passages)[rng.randrange(20) :]]), "s") for i in range(60)]
    got = sorted((r.doc_id, r["__n"], r["__r"], r["__kept"]) for r in substring_dedup.remove_repeats(docs(spark, rows)).collect())
    assert got == brute_windows([(i, t) for i, t, _ in rows])


# --------------------------------------------------------------------- simhash
def brute_simhash(text):
    w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not w:
        return 0
    sh = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] or [" ".join(w)]
    hs = [xxhash.xxh64(s.encode(), seed=42).intdigest() for s in sh]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def brute_components(ids, linked):
    up = {i: i for i in ids}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a in ids:
        for b in ids:
            if a < b and linked(a, b):
                x, y = find(a), find(b)
                up[max(x, y)] = min(x, y)
    return {i: find(i) for i in ids}


def test_simhash_groups(spark, odd):
    least = -(1 << 63)
    fp = {}
    for r in odd.collect():
        fp[least if r.doc_id is None else r.doc_id] = brute_simhash(r.text)
    want = brute_components(list(fp), lambda a, b: (fp[a] ^ fp[b]).bit_count() <= 2)
    got = simhash.simhash_groups(odd).collect()
    assert len(got) == odd.count()
    for r in got:
        i = least if r["__id"] is None else r["__id"]
        assert (int(r.fingerprint, 16), r.component_id) == (fp[i], want[i])
    assert simhash.simhash_groups(odd.limit(0)).count() == 0


def test_simhash_near_copies(spark):
    rng = random.Random(5)
    base = [f"word{rng.randrange(500)}" for _ in range(400)]
    rows = []
    for i in range(40):
        w = list(base)
        for _ in range(i % 4):
            w[rng.randrange(400)] = f"new{i}"
        rows.append((i, " ".join(w), "s"))
    fp = {i: brute_simhash(t) for i, t, _ in rows}
    want = brute_components(list(fp), lambda a, b: (fp[a] ^ fp[b]).bit_count() <= 2)
    got = {r["__id"]: r.component_id for r in simhash.simhash_groups(docs(spark, rows)).collect()}
    assert got == want
    kept = simhash.keep_one(docs(spark, rows))
    assert kept.columns == docs(spark, rows).columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted(set(want.values()))


def test_keep_one_keeps_a_repeated_row_once(spark, odd):
    kept = [r.doc_id for r in simhash.keep_one(odd).collect()]
    assert len(kept) == len(set(kept)) and 1 in kept and 2 not in kept


def brute_shingles(text):
    w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} or ({tuple(w)} if w else set())


def brute_jaccard(rows):
    s = {i: brute_shingles(t) for i, t in rows}
    return brute_components(list(s), lambda a, b: s[a] == s[b] or 5 * len(s[a] & s[b]) >= 4 * len(s[a] | s[b]))


def test_pipeline_near_dedup_against_brute_jaccard(spark, odd):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    rng = random.Random(8)
    rows = []
    for b in range(12):
        base = [f"w{rng.randrange(3000)}" for _ in range(rng.choice([30, 200, 900]))] + ["all rights reserved by the owner of this text"] * 2
        for c in range(8):
            w = list(base)
            for _ in range(rng.randrange(0, 1 + len(w) // 25)):
                w[rng.randrange(len(w))] = f"new{rng.random()}"
            rows.append((100 * b + c, " ".join(w), "s"))
    want = brute_jaccard([(i, t) for i, t, _ in rows])
    s = {i: brute_shingles(t) for i, t, _ in rows}
    assert any(want[a] == want[b] and 5 * len(s[a] & s[b]) < 4 * len(s[a] | s[b]) for a in s for b in s)  # some hang together by a chain only
    kept = corpus_pipeline.near_dedup(spark, docs(spark, rows), DATA)
    assert kept.columns == docs(spark, rows).columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted(set(want.values()))
    d = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text", "source")
    want = brute_jaccard([(r.doc_id, r.text) for r in d.collect()])
    assert sorted(r.doc_id for r in corpus_pipeline.near_dedup(spark, d, DATA).collect()) == sorted(set(want.values()))
    assert len(np.union1d(*near_dedup.shingle_sets([b"a b c d e", b"b a c d e"]))) == 2
    least = -(1 << 63)
    want = brute_jaccard({least if r.doc_id is None else r.doc_id: r.text for r in odd.collect()}.items())
    got = sorted(least if r.doc_id is None else r.doc_id for r in corpus_pipeline.near_dedup(spark, odd, DATA).collect())
    assert got == sorted(set(want.values()))
    assert corpus_pipeline.near_dedup(spark, odd.limit(0), DATA).count() == 0


@pytest.mark.parametrize("edges", [[], [(5, 5)], [(i, i + 1) for i in range(200)], [(0, i) for i in range(1, 100)] + [(500, 501)]])
def test_components(spark, edges):
    df = spark.createDataFrame(edges, "a long, b long")
    ids = {x for e in edges if e[0] != e[1] for x in e}
    pairs = set(edges)
    want = brute_components(sorted(ids), lambda a, b: (a, b) in pairs)
    assert {r.node: r.component for r in components.components(df).collect()} == want


# ------------------------------------------------------------------ embeddings
def brute_links(rows, threshold=0.9):
    good = {}
    for i, v in rows:
        if v and all(x is not None and math.isfinite(x) for x in v) and any(v):
            x = np.array(v, float)
            good[i] = x / np.linalg.norm(x)
    link = lambda a, b: a in good and b in good and len(good[a]) == len(good[b]) and good[a] @ good[b] >= threshold
    ids = [i for i, _ in rows]
    comp = brute_components(ids, link)
    return {i: (sum(link(i, j) for j in ids if j != i), comp[i], comp[i] == i) for i in ids}


def test_embedding_links(spark):
    rng = np.random.default_rng(2)
    centre = rng.standard_normal((5, 32))
    rows = [(i, [float(x) for x in centre[i % 5] + 0.12 * rng.standard_normal(32)]) for i in range(150)]
    rows += [(200 + i, [float(x) for x in rng.standard_normal(32)]) for i in range(150)]
    rows += [(400, None), (401, [0.0] * 32), (402, [float("nan")] * 32), (403, [None] * 32), (404, []), (405, rows[0][1]), (406, rows[0][1]), (407, [1.0, 2.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("n_links", F.lit("clash"))
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in embed_dedup.link_groups(df).collect()}
    want = brute_links(rows)
    assert got.keys() == want.keys()
    assert all(got[i][0] <= want[i][0] for i in want)
    links = sum(w[0] for w in want.values())
    assert sum(g[0] for g in got.values()) >= 0.9 * links
    assert got == want  # at this size all windows meet
    assert embed_dedup.link_groups(df.limit(0)).count() == 0


def test_embedding_recall_with_narrow_windows(spark):
    rng = np.random.default_rng(4)
    x = rng.standard_normal((1500, 64))
    y = x[:700] + 0.3 * rng.standard_normal((700, 64))
    rows = [(i, [float(a) for a in v]) for i, v in enumerate(np.vstack([x, y]))]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = sum(r.n_links for r in embed_dedup.link_groups(df, window=8).collect())
    m = np.array([v for _, v in rows])
    m /= np.linalg.norm(m, axis=1, keepdims=True)
    want = int((m @ m.T >= 0.9).sum()) - len(m)
    assert 0.9 * want <= got <= want


def cone(n, planted, cosine, seed):
    """n isotropic and n // 2 cone vectors; in the cone, ``planted`` pairs of cosine 0.905."""
    rng = np.random.default_rng(seed)
    unit = lambda v: v / np.linalg.norm(v, axis=-1, keepdims=True)
    axis = unit(rng.standard_normal(64))
    near = unit(math.sqrt(cosine) * axis + math.sqrt(1 - cosine) * unit(rng.standard_normal((n // 2, 64))))
    off = rng.standard_normal((planted, 64))
    off = unit(off - (off * near[:planted]).sum(1, keepdims=True) * near[:planted])
    return np.vstack([unit(rng.standard_normal((n, 64))), near, 0.905 * near[:planted] + math.sqrt(1 - 0.905**2) * off]), n


def test_embedding_recall_in_a_cone(spark):
    x, n = cone(4000, 300, 0.8, 6)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = {r.vec_id: r.component_id for r in embed_dedup.link_groups(df, window=16).collect()}
    found = sum(got[n + i] == got[n + n // 2 + i] for i in range(300))
    assert found >= 0.97 * 300, found


def test_passes_grow_with_the_table():
    assert embed_dedup.passes_for(500) <= embed_dedup.passes_for(50_000) <= embed_dedup.passes_for(10**9) < 2000


# ------------------------------------------------------------------------ html
def test_html_structure():
    page = (
        "<!DOCTYPE html><head><title>t</title><style>p{}</style></head><body><header>Site</header><nav><ul><li>Home</ul></nav><div class='cookie-notice'>We use</div>"
        "<article><h1>Head &amp; more</h1><p><b>First<br><p>Two&nbsp; words\n here &#x41;<script>var t='</p>';</script><aside>side</aside><div class=ad>buy</div>"
        "<ul><li>one<li>two</ul><form>name<input></form><section id='comments'><article>reader</article></section></article><footer>&copy; x"
    )
    assert html_extract.parse(page)[0] == ["Head & more", "First", "Two words here A", "one", "two"]
    assert html_extract.parse("") == ([], []) and html_extract.parse("<p>a &lt b")[1] == ["a < b"]
    assert html_extract.parse("<main><p>x</main><p>y") == (["x"], ["y"])
    assert html_extract.parse("plain 1 < 2 text <p>cut <a href='x")[1] == ["plain 1 < 2 text", "cut"]


def test_html_host_suffixes(spark):
    rng = random.Random(8)
    boiler = "please read our terms before you go on with this very site"
    rows = []
    for i in range(12):
        own = " ".join(f"t{i}_{rng.randrange(1000)}" for _ in range(30))
        rows.append((i, f"http://h.example/{i}", f"<body><div>{boiler}</div><div>{own}</div><p>tail {own[:20]} {boiler}</p></body>"))
    rows += [(50, "http://other.example/", f"<p>{boiler}"), (51, None, None), (52, "x", ""), (53, "http://h.example/c", rows[0][2]), (53, "http://h.example/c", rows[0][2])]
    rows += [(60, "http://h.example/a", f"<article><p>{boiler}</p></article>")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("text", F.lit("clash"))
    out = html_extract.extract(df).collect()
    got = {r.page_id: r.text for r in out}
    assert len(out) == len(rows) and all(r.n_chars == len(r.text) for r in out)
    for i in range(12):
        own = rows[i][2].split("<div>")[2].split("</div>")[0]
        assert got[i] == f"{own}\ntail {own[:20].strip()}", i
    assert got[50] == boiler and got[51] == got[52] == "" and got[53] == got[0] and got[60] == boiler
    assert html_extract.extract(df.limit(0)).count() == 0


# --------------------------------------------------------------------- quality
def test_quality_held_out_accuracy(spark):
    d = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    lab = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    w = quality.train(d, lab)
    rows = quality.score(d.withColumn("__h", quality.held_out("doc_id")), w, name="s").join(lab, "doc_id").where("__h").select("s", "quality").toPandas()
    assert ((rows.s >= 0.3) == (rows.quality == 1)).mean() >= 0.93


def test_quality_never_learns_from_held_out_rows(spark):
    rows = [(i, ("good " if i % 2 else "bad ") * 20) for i in range(200)]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    ho = {i for i, _ in rows if zlib.crc32(str(i).encode()) % 5 == 0}
    lab = lambda flip: spark.createDataFrame([(i, (i % 2) ^ (flip and i in ho)) for i, _ in rows] + [(None, 1), (3, None)], "doc_id long, quality int")
    assert np.array_equal(quality.train(d, lab(False)), quality.train(d, lab(True)))
    assert quality.train(d, lab(False).limit(0)).any() == np.False_


def test_quality_scores_any_text(spark, odd):
    out = quality.score(odd, np.zeros((1 << quality.BITS) + 1), name="__s")
    assert [r["__s"] for r in out.collect()] == [0.5] * odd.count()
    assert quality.score(odd.limit(0), np.zeros((1 << quality.BITS) + 1), name="__s").count() == 0


# ----------------------------------------------------------------------- media
def png():
    chunk = lambda k, d: struct.pack(">I", len(d)) + k + d + struct.pack(">I", zlib.crc32(k + d))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", 1, 1, 8, 0, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(b"\0\0")) + chunk(b"IEND", b"")


def test_sniffing_and_carving(spark):
    p = png()
    wav, _ = media.store(p + b"RIFF" + b"BM not a bitmap")
    assert media.sniff(p) == ("image/png", [])
    assert media.sniff(p[:-3]) == (media.UNKNOWN, []) and media.sniff(None) == (media.UNKNOWN, []) and media.sniff(b"") == (media.UNKNOWN, [])
    assert media.sniff(wav) == ("audio/wav", [(44, len(p), "image/png")])
    import gzip
    import io
    import zipfile

    z = io.BytesIO()
    with zipfile.ZipFile(z, "w") as f:
        f.writestr("a", "b")
    assert media.sniff(gzip.compress(b"x" * 100) + b"tail")[0] == "application/gzip" and media.sniff(z.getvalue())[0] == "application/zip"
    gif = b"GIF89a" + struct.pack("<HHBBB", 1, 1, 0x80, 0, 0) + bytes(6) + b"," + struct.pack("<HHHHB", 0, 0, 1, 1, 0) + b"\x02\x02\x4c\x01\x00;"
    assert media.sniff(gif) == ("image/gif", []) and media.sniff(b"%PDF-1.4 x startxref 0 %%EOF")[0] == "application/pdf"
    df = spark.createDataFrame([(1, bytearray(p), "image/jpeg"), (2, bytearray(wav), "audio/wav"), (3, None, "text/plain")], "id int, content binary, declared string")
    rows = {r.id: r for r in media.correct_types(df).collect()}
    assert (rows[1].media_type, rows[1].mislabelled) == ("image/png", True) and bytes(rows[2].carved[0]["bytes"]) == p and not rows[2].mislabelled
    assert (rows[3].media_type, rows[3].mislabelled, rows[3].carved) == ("text/plain", False, [])


def test_media_round_trip(spark, odd):
    got = media.store_texts(odd, keep_media=True).collect()
    want = sorted(((r.doc_id is None, r.doc_id or 0, (r.text or "").encode()) for r in odd.collect()))
    assert len(got) == len(want)
    for r, (_, _, t) in zip(sorted(got, key=lambda r: (r["__id"] is None, r["__id"] or 0)), want, strict=True):
        pay = t + bytes(-len(t) % 64 if t else 64)
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256) == (len(t), len(pay), hashlib.sha256(pay).hexdigest())
        assert r.tail_crc32 == zlib.crc32(pay[-64:]) and r.media_sha256 == hashlib.sha256(bytes(r.media)).hexdigest() and r.media_bytes == len(r.media)
        assert media.samples(bytes(r.media)) == pay
    assert media.store_texts(odd.limit(0)).count() == 0


# -------------------------------------------------------------- sentence pieces
def test_pieces_equal_the_library(spark):
    m = sentencepiece.Model(sentencepiece.read_model())
    texts = ["the quick  brown", "Ünïcödé   naïve", "a\nb\n\nc", "%%% ***", "日本語 テスト", "\x00", "x" * 40, "éçè!!", " lead", "hello hello world"]
    units = sorted({u for t in texts for p in m.units(t) for u in p})
    df = spark.createDataFrame([(u,) for u in units], "unit string")
    got = {r.unit: r.ids for r in sentencepiece.encode_units(df, m).collect()}
    assert got == dict(zip(units, m.encode_units(units), strict=True))


def test_viterbi_fold(spark):
    pieces = {"a": -1.0, "b": -1.0, "ab": -1.5, "abc": -9.0, "bc": -1.0, "c": -3.0}
    rows = [("abc", [(s, i, i + len(p), k) for k, (p, s) in enumerate(pieces.items()) for i in range(3) if "abc"[i : i + len(p)] == p])]
    df = spark.createDataFrame(rows, "unit string, edges array<struct<score:double,s:int,e:int,id:int>>")
    assert df.select(sentencepiece.viterbi_fold(F.col("unit"), F.col("edges"), -20.0).alias("b")).first().b == [0, 1, 3]


def test_encode_round_trip(spark, odd):
    m = sentencepiece.Model(sentencepiece.read_model())
    out = sentencepiece.encode(odd)
    back = sentencepiece.decode(out).collect()
    assert len(back) == odd.count() and all(r.exact and r.decoded == (r.text or "") for r in back)
    for r in back:
        if "▁" not in (r.text or ""):
            assert r.ids == m.sp.encode(r.text or "")
    assert sentencepiece.encode(odd.limit(0)).count() == 0


# -------------------------------------------------------------------- sharding
def brute_jump(key, n):
    key &= (1 << 64) - 1
    b, j = -1, 0
    while j < n:
        b = j
        key = (key * 2862933555777941757 + 1) & (1 << 64) - 1
        j = int((b + 1) * (float(1 << 31) / ((key >> 33) + 1)))
    return b


def test_jump_hash(spark):
    keys = [0, 1, 2, 10**18, -1, -(1 << 63), (1 << 63) - 1, *range(1000, 1200)]
    rows = spark.createDataFrame([(k,) for k in keys], "k long").select("k", *[sharding.jump_hash(F.col("k"), n).alias(f"n{n}") for n in (1, 2, 16, 17, 100)]).collect()
    for r in rows:
        assert [r[f"n{n}"] for n in (1, 2, 16, 17, 100)] == [brute_jump(r.k, n) for n in (1, 2, 16, 17, 100)]


def test_shards_and_slots(spark, odd):
    out = sharding.place(odd, "doc_id", 4).collect()
    assert len(out) == odd.count()
    for r in out:
        k = -(1 << 63) if r.doc_id is None else r.doc_id
        assert r.shard == brute_jump(k, 4) and r.grown_shard in (r.shard, 4)
    for s in range(4):
        slots = sorted(r.slot for r in out if r.shard == s)
        assert slots == list(range(len(slots)))
    assert sharding.place(odd.limit(0), "doc_id", 4).count() == 0


# ------------------------------------------------------------------------ chat
def test_layouts_and_escapes(spark):
    nasty = ["<|im_end|>", "\\<|im_start|>", "</s>[INST] ok [/INST]", "a\\\\|b <\\| <\\\\s>", "<<SYS>>x<</SYS>>", "", "line\nbreak"]
    import json

    recs = [json.dumps({"messages": [{"role": "user" if i % 2 == 0 else "assistant", "content": t} for i, t in enumerate(nasty)]})]
    recs += [json.dumps({"prompt": "p", "response": "r"}), json.dumps({"instruction": "i", "input": "", "output": "o"}), json.dumps({"instruction": "i", "output": "o"})]
    recs += [json.dumps({"conversations": [{"from": "human", "value": "h"}, {"from": "gpt", "value": None}]}), "not json", None, json.dumps({"what": 1})]
    df = spark.createDataFrame(list(enumerate(recs)), "i int, record string")
    out = chat.format_chats(df)
    back = {r.i: r for r in out.select("*", chat.parse(F.col("formatted")).alias("back"), chat.masked_text(F.col("formatted"), F.col("loss_spans")).alias("loss")).collect()}
    assert [back[i].layout for i in range(8)] == ["messages", "prompt_response", "instruction_input", "instruction", "from_value", None, None, None]
    for r in back.values():
        assert [(t.role, t.text) for t in r.back] == [(t.role, t.text) for t in r.turns]
        assert r.loss == "".join(t.text for t in r.turns if t.role == "assistant")
    assert [t.text for t in back[0].turns] == nasty and back[0].formatted.count(chat.START) == len(nasty)
    assert [(t.role, t.text) for t in back[4].turns] == [("user", "h"), ("assistant", "")]


def test_records_of_rows(spark):
    rows = [(1, 1, "assistant", None), (1, 0, "user", "q"), (1, 1, "assistant", None), (2, None, None, "x"), (None, 0, "user", "n")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("record", F.lit("clash"))
    got = {r.conv_id: [(t.role, t.text) for t in r.turns] for r in chat.format_chats(chat.records_of(df)).collect()}
    assert got == {1: [("user", "q"), ("assistant", ""), ("assistant", "")], 2: [("", "x")], None: [("user", "n")]}
    assert chat.format_chats(chat.records_of(df.limit(0))).count() == 0


def test_long_texts_are_formatted(spark, tmp_path):
    from lexmill.llm import queries

    long = 21_000_000
    rows = spark.createDataFrame([(1, 0, "user", "q"), (1, 1, "assistant", "a"), (2, 0, "assistant", "b")], "conv_id long, turn long, role string, text string")
    rows = rows.withColumn("text", F.when(F.col("text") == "a", F.repeat(F.lit("a"), long)).otherwise(F.col("text")))
    rows.write.parquet(f"{tmp_path}/conversations.parquet")
    got = {r.conv_id: (r.n_turns, r.loss_chars, r.loss_sha256) for r in queries.op9_chat_formatting(spark, str(tmp_path)).collect()}
    assert got[1] == (2, long, hashlib.sha256(b"a" * long).hexdigest()) and got[2][:2] == (1, 1) and set(got) == {-1, 1, 2}
    # beyond the JSON parser a record is told, and the others are formatted
    told = {r.conv_id: (r.error, r.n) for r in chat.format_chats(chat.records_of(rows)).select("conv_id", "error", F.size("turns").alias("n")).collect()}
    assert told == {1: ("not JSON", 0), 2: (None, 1)}


# ---------------------------------------------------------------------- mixing
def brute_targets(sizes, weights=(1, 2, 3)):
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: weights[i % 3] for i, s in enumerate(names)}
    total, capped = sum(sizes.values()), {}
    while True:
        free = [s for s in names if s not in capped]
        if not free:
            return capped
        level = (total - sum(capped.values())) / sum(w[s] for s in free)
        over = [s for s in free if level * w[s] > 3 * sizes[s]]
        if not over:
            return capped | {s: level * w[s] for s in free}
        capped |= {s: 3 * sizes[s] for s in over}


def test_targets_and_taken(spark):
    rng = random.Random(6)
    rows = [(i, " ".join(["w"] * rng.randrange(1, 60)), rng.choice(["a"] * 30 + ["b", "c", "d", "é", None])) for i in range(600)] + [(900, None, "empty"), (901, "", "empty"), (5, "twice", "a"), (5, "twice", "a"), (None, "x", "a")]
    df = docs(spark, rows)
    sizes = {}
    for _, t, s in rows:
        sizes[s] = sizes.get(s, 0) + len(WORD.findall(t or ""))
    want = brute_targets(sizes)
    out = mixing.mix(df, carry=["doc_id", "source"]).collect()
    assert len(out) == len(rows)
    taken = {}
    for r in out:
        assert r.source_size == sizes[r.source] and r.target == pytest.approx(want[r.source]) and 0 <= r.passes <= 3
        taken[r.source] = taken.get(r.source, 0) + r.passes * r["size"]
    for s, t in want.items():
        assert abs(taken[s] - t) <= 60
    again = mixing.mix(df.repartition(3), carry=["doc_id", "source"]).collect()
    key = lambda r: (r.doc_id is None, r.doc_id or 0, r.passes)
    assert sorted(map(key, out)) == sorted(map(key, again))
    mixed = mixing.mixed(df)
    assert mixed.columns == df.columns and mixed.count() == sum(r.passes for r in out)
    assert mixing.mix(df.limit(0)).count() == 0


# -------------------------------------------------------------------- pipeline
def test_pipeline_against_brute_force(spark):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    d = spark.read.parquet(f"{DATA}/documents.parquet")
    w = quality.train(d, spark.read.parquet(f"{DATA}/labels.parquet"))
    t = pq.read_table(f"{DATA}/documents.parquet").to_pandas()
    scores = [quality.score_grams(g, w) for g in quality.features([x.encode() for x in t.text])]
    t = t[np.array(scores) >= 0.3]
    comp = brute_jaccard(list(zip(t.doc_id, t.text, strict=True)))
    t = t[[comp[i] == i for i in t.doc_id]]
    kept = {i: (r, k) for i, _, r, k in brute_windows(list(zip(t.doc_id, t.text, strict=True)))}
    t = t.assign(text=[kept[i][1] if kept[i][0] else x for i, x in zip(t.doc_id, t.text, strict=True)])
    docs_ = d
    for name, stage in corpus_pipeline.STAGES[:3]:
        docs_ = stage(spark, docs_, DATA)
        assert docs_.columns == d.columns, name
    got = docs_.toPandas()
    assert dict(zip(got.doc_id, got.text, strict=True)) == dict(zip(t.doc_id, t.text, strict=True))
    out = corpus_pipeline.run(spark, DATA).toPandas()
    mix = mixing.mix(spark.createDataFrame(pd.DataFrame(t))).toPandas()
    assert out.exact.all() and sorted(out.doc_id) == sorted(i for i, p in zip(mix.doc_id, mix.passes, strict=True) for _ in range(p))
