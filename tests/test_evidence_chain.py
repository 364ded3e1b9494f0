"""Claims, coverage, article chunks, embedding jobs and the chunk export stream against plain loops."""

import hashlib
import json
import math
import random
import re
import unicodedata

import pytest
from pyspark.sql import functions as F

from lexmill.functions import answering as A
from lexmill.functions import claims as C
from lexmill.functions import coverage as V
from lexmill.functions import ranking as K
from lexmill.operators import articles as R
from lexmill.operators import embedding as E
from lexmill.streaming import export


def fold(t):
    return " ".join("".join(c for c in unicodedata.normalize("NFKD", t) if not unicodedata.combining(c)).lower().split())


# ------------------------------------------------------------------ claims
SENTENCES = [
    "Theo dõi sau mổ và kiểm soát huyết áp là yếu tố quan trọng.", "Tacrolimus tương tác với rifampicin trong ghép thận rất mạnh.", "Mức độ triệu chứng và nguy cơ quanh thủ thuật quyết định điều trị.", "RCT 1234567890123 95% CI or (2) là bảng số liệu dày đặc.",
    "Title: something else entirely here", "Tỷ lệ thành công là 45 % ở nhóm can thiệp sớm.", "short one.", "Chỉ số BNP và huyết áp của bệnh nhân được đo.", "Tình trạng lâm sàng được đánh giá khi nhập viện.", "Keywords: a, b", "Nguy cơ đột quỵ tăng khi tái hẹp xảy ra ở người già.",
]
QUESTIONS = ["vì sao ghép thận dùng tacrolimus", "chỉ số và tiêu chí đánh giá lâm sàng", "điều trị dựa trên nhóm yếu tố nào", "tỷ lệ thành công bao nhiêu phần trăm", "huyết áp", "", "12"]


def test_candidate_sentences(spark):
    texts = ["Title: abc Source: def Body: Câu thứ nhất đủ dài để được giữ lại.\nNối dòng tiếp theo.  Ngắn.\n\nĐoạn khác cũng đủ dài để được giữ lại • Điểm mới bắt đầu ở đây nhé", "x Audience: all Body: y Keywords: some words that go away\nnext line that stays because it is long", None]
    got = [r.x for r in spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("i", C.candidate_sentences(F.col("t")).alias("x")).orderBy("i").collect()]
    assert got == [["Câu thứ nhất đủ dài để được giữ lại.", "Đoạn khác cũng đủ dài để được giữ lại."], [], []]


def test_claims_equal_loops(spark):
    rng = random.Random(11)
    rows = []
    for i in range(200):
        chunks = [(f"c{k}", rng.choice(["Kết quả", "Bàn luận", None]), " ".join(rng.choice(SENTENCES) for _ in range(rng.randrange(2, 12)))) for k in range(rng.randrange(1, 4))]
        rows.append((i, chunks, rng.choice(QUESTIONS), rng.choice(["exact", "summary", "bounded_partial", "open"]), rng.choice(["teaching_explainer", "other"])))
    df = spark.createDataFrame(rows, "i int, c array<struct<chunk_id:string,section_title:string,text:string>>, q string, s string, k string").repartition(3)
    # candidates and scores by the tested parts; order, choice and distinctness by loops
    one = F.transform("c", lambda c: F.struct(c["chunk_id"].alias("id"), F.transform(C.candidate_sentences(c["text"]), lambda s: F.struct(
        s.alias("s"), A.sentence_score(s, F.col("q"), F.coalesce(c["section_title"], F.lit("")), F.lit(True)).alias("yes"), A.sentence_score(s, F.col("q"), F.coalesce(c["section_title"], F.lit("")), F.lit(False)).alias("no"))).alias("x")))
    out = df.select("i", "q", "s", "k", one.alias("x"), F.size(K.keywords(F.col("q"))).alias("kw"), C.direct_answers(F.col("c"), F.col("q"), F.col("s")).alias("direct"), C.focus_claims(F.col("c"), F.col("q"), F.col("s"), F.col("k")).alias("focus")).collect()
    has = lambda t, marks: any(m in t for m in marks)
    some = [0, 0]
    for r in out:
        q = fold(r.q)
        numeric = has(q, ["bao nhieu", "ty le", "phan tram", "karnofsky", "diem"])
        found = [(x.yes if numeric else x.no, x.s, c.id) for c in r.x for x in c.x]
        best, seen = [], set()
        for _, s, c in sorted((x for x in found if x[0] >= 2), key=lambda x: -x[0]):
            if fold(s) not in seen and len(best) < 3:
                seen.add(fold(s))
                best.append((s, c))
        asked = r.s == "exact" and (r.kw or re.search(r"\d", r.q))
        assert [(x.claim, x.chunk_id) for x in r.direct] == (best if asked else [])
        some[0] += len(r.direct) > 1
        # focus
        why, crit, group, kidney = has(q, ["vi sao", "tai sao"]), has(q, ["chi so", "tieu chi"]), has(q, ["nhom yeu to", "dua tren"]), "ghep than" in q
        criteria = ["lam sang", "can lam sang", "nhap vien", "tinh trang", "danh gia", "theo doi"]
        metrics, drugs = ["phan so tong mau", "ef", "bnp", "huyet ap", "thuoc"], ["rifampicin", "tacrolimus", "cyclosporine", "thai ghep"]
        chosen = ["muc do", "trieu chung", "nguy co quanh thu thuat", "song con"]
        after = ["noi khoa toi uu", "noi khoa ho tro", "nguy co tim mach", "theo doi hinh anh", "duplex", "kiem soat huyet ap", "dai thao duong", "roi loan lipid mau", "tai hep", "dot quy"]
        pool = []
        for score, s, c in [(x.no, x.s, c.id) for c in r.x for x in c.x]:
            n = fold(s)
            if crit:
                score += 1.6 * has(n, criteria) - 1.2 * (has(n, metrics) and not has(n, criteria))
            if why and has(n, ["tuong tac", "nguy co", "thai ghep", "do nhay", "keo dai"]):
                score += 1.2
            if group:
                if has(n, chosen + after):
                    score += 1.8
                else:
                    score += 1.0 * has(n, ["muc do", "trieu chung", "nguy co", "song con", "noi khoa", "hinh anh"])
                    score -= 2.4 * (sum(ch.isdigit() for ch in s) >= 12 or has(n, ["rct", "95% ci", "or (", "tv/dq", "nmct"]))
            if kidney and has(n, drugs):
                score += 4
            if score >= 2 - 1e-9:
                pool.append((round(score, 6), s, c, n))
        pool.sort(key=lambda x: -x[0])
        for on, rule in [(crit, lambda n: has(n, criteria) and not has(n, metrics)), (why and kidney, lambda n: has(n, drugs)), (group, lambda n: has(n, chosen + after))]:
            if on:
                pool = [x for x in pool if rule(x[3])] + [x for x in pool if not rule(x[3])]
        taken = []
        for x in pool:
            if x[3] not in [y[3] for y in taken] and len(taken) < 4:
                taken.append(x)
        for on, marks in [(why and kidney, drugs), (group, chosen), (group, after)]:
            if on and not any(has(x[3], marks) for x in taken):
                taken += [x for x in pool if has(x[3], marks) and x[3] not in [y[3] for y in taken]][:1]
        asked = (r.s in ("summary", "bounded_partial") or r.k == "teaching_explainer") and r.kw
        assert [(x.claim, x.chunk_id) for x in r.focus] == ([(x[1], x[2]) for x in taken] if asked else []), (r.q, r.s, r.k)
        some[1] += len(r.focus) > 1
    assert min(some) > 3


# ------------------------------------------------------------------ coverage
EVIDENCE = "title string, source_type string, raw string, findings array<string>, numbers int, design string, population string, sample_size string, setting string, limitations int, extracted boolean, secondary array<string>, n_secondary int"
ROUTER = "answer_style string, query_type string, retrieval_mode string, answer_policy string, requires_numbers boolean, requires_limitations boolean"


def plain_coverage(q, e, r, words):
    kw = words(q)
    share = lambda t: len(kw & words(t)) / len(kw)
    asks = any(m in q.lower() for m in ("bao nhiêu", "tỷ lệ", "auc", " hr "))
    raw = e["raw"] or ""
    direct = (share(" ".join(e["findings"])) if kw else 0.7) if e["findings"] else (max(0.45, share(raw[:4000])) if kw else 0.6) if raw else 0.0
    style, kind, abstain = r["answer_style"], r["query_type"], []
    numeric = 1.0
    if r["requires_numbers"] and not (style in ("exact", "bounded_partial") and not asks):
        numeric = 1.0 if e["numbers"] >= 2 else 0.5 if e["numbers"] else 0.3 if re.search(r"\d+[.,]?\d*\s*%|p\s*[<>=]|OR|HR|AUC|n\s*=", raw, re.I) else 0.0
        abstain += ["numeric_data"] * (numeric == 0)
    methods = sum(e[k] is not None for k in ("design", "population", "sample_size", "setting")) / 4
    limits = 1.0
    if r["requires_limitations"] and not e["limitations"]:
        limits = 0.5 if any(k in raw.lower() for k in ("hạn chế", "limitation", "bias", "thiếu", "chưa", "cỡ mẫu nhỏ")) else 0.0
        abstain += ["limitations"] * (limits == 0)
    parts = [direct, numeric] if style == "exact" else [direct, numeric, 1.0] if style in ("summary", "bounded_partial") else [direct, numeric, methods if e["extracted"] else 0.5, limits]
    average = sum(parts) / len(parts)
    level = "high" if average >= 0.7 and direct >= 0.5 else "medium" if average >= 0.4 else "low"
    missing, ceiling = [], "high"
    steps = lambda *at: next((c for n, c in at if len(missing) >= n), "high")
    if kind == "guideline_comparison" and e["source_type"] and e["source_type"] not in ("guideline", "meta_analysis"):
        missing, ceiling = ["guideline_source_preferred"], "moderate" if level == "high" else "high"
    if kind == "study_result_extraction" and style == "exact":
        missing += ["numeric_findings"] * bool(asks and not e["numbers"] and not re.search(r"\d+[.,]?\d*\s*%", raw)) + ["direct_answer_span"] * (direct < 0.35)
        ceiling = steps((2, "low"), (1, "moderate"))
    elif kind == "study_result_extraction":
        missing += ["study_design"] * (e["design"] is None) + ["study_population"] * (e["population"] is None) + ["numeric_findings"] * (e["numbers"] < 1)
        ceiling = steps((3, "low"), (2, "moderate"))
    if kind == "research_appraisal":
        missing += ["study_design"] * (e["design"] is None) + ["limitations"] * (not e["limitations"]) + ["methods_detail"] * (methods < 0.5)
        ceiling = steps((2, "moderate"))
    if kind == "teaching_explainer" and direct < 0.3:
        missing, ceiling = ["topic_content"], "low"
    if kind == "comparative_synthesis" and r["retrieval_mode"] != "article_centric" and not e["n_secondary"]:
        missing, ceiling = ["comparison_sources"], "moderate"
    if len(missing) >= 3 and level == "high":
        level = "medium"
    known = [c for c in ("đái tháo", "tháo đường", "huyết áp", "can thiệp", "nguy cơ", "tỷ lệ", "đái tháo đường", "sepsis") if c in q.lower()]
    said = " ".join([x for x in [raw, *e["findings"], *e["secondary"]] if x]).lower()
    held, open_ = [c for c in known if c in said and c != "can thiệp"], [c for c in known if c not in said and c != "can thiệp"]
    gap = bool(open_) and len(open_) / max(1, len(known)) > (0.35 if style == "bounded_partial" else 0.6)
    if gap and ceiling == "high":
        ceiling = "moderate"
    title = bool(e["title"])
    mode = ("retrieval_failed" if not title and not raw else "evidence_strong" if level == "high" and not gap else "title_anchored" if title and raw and direct >= 0.25
            else "open_knowledge" if r["answer_policy"] == "open_enriched" or level != "high" else "retrieval_failed")
    return level, ceiling, mode, abstain, missing, open_, gap, ", ".join(held), {"high": 0, "medium": 1, "low": 2}[level]


def test_coverage_equals_plain_rules(spark):
    rng = random.Random(12)
    texts = ["huyết áp cao 45% ở nhóm", "sepsis và nguy cơ", "hạn chế của nghiên cứu", "đái tháo đường type hai", "plain words only", ""]
    queries = ["đái tháo đường và huyết áp", "tỷ lệ sepsis bao nhiêu", "can thiệp nguy cơ", "plain question words", "", "auc của sepsis"]
    rows = []
    for i in range(600):
        maybe = lambda: rng.choice([None, "x"])
        n = rng.choice((0, 0, 1))
        e = (rng.choice(["t", ""]), rng.choice(["", "guideline", "review"]), rng.choice([*texts, None]), rng.sample(texts[:5], rng.choice((0, 1, 2))), rng.randrange(4), maybe(), maybe(), maybe(), maybe(), rng.randrange(2), rng.random() < 0.5, rng.sample(texts, n), n)
        r = (rng.choice(["exact", "summary", "bounded_partial", "open", ""]), rng.choice(["guideline_comparison", "study_result_extraction", "research_appraisal", "teaching_explainer", "comparative_synthesis", "x"]), rng.choice(["article_centric", "topic"]), rng.choice(["strict_rag", "open_enriched"]), rng.random() < 0.6, rng.random() < 0.6)
        rows.append((i, rng.choice(queries), e, r))
    df = spark.createDataFrame(rows, f"i int, q string, e struct<{EVIDENCE.replace(' ', ':').replace(',:', ',')}>, r struct<{ROUTER.replace(' ', ':').replace(',:', ',')}>").repartition(3)
    got = {x.i: x.x for x in df.select("i", V.coverage(F.col("q"), F.col("e"), F.col("r")).alias("x")).collect()}
    words = lambda t: {w for w in re.sub(r"[\[\]]", "", t.lower()).split() if len(w) > 1}
    names = [x.split()[0] for x in EVIDENCE.split(", ")], [x.split()[0] for x in ROUTER.split(", ")]
    modes = set()
    for i, q, e, r in rows:
        x = got[i]
        want = plain_coverage(q, dict(zip(names[0], e, strict=True)), dict(zip(names[1], r, strict=True)), words)
        assert (x.level, x.ceiling, x.mode, x.abstain, x.missing, x.unsupported, x.gap, x.scope, x.max_external) == want, (q, e, r)
        modes.add(x.mode)
    assert modes == {"retrieval_failed", "evidence_strong", "title_anchored", "open_knowledge"}


# ------------------------------------------------------------------ article chunks
def test_article_chunks_are_ordered_by_bonus_alone(spark):
    chunks = spark.createDataFrame([("a", "c1", "x", 1.0), ("a", "c2", " ", 9.0), ("a", "c3", "y", 2.0), ("a", "c4", None, 9.0), ("b", "c5", "z", 0.1)], "article_key string, chunk_id string, text string, p double")
    found = spark.createDataFrame([("q", "a", 0.2), ("q", "b", 0.3)], "query_id string, article_key string, score double")
    got = [(r.article_key, r.chunk_id, r.chunk_rank_score, r["rank"]) for r in R.article_chunks(found, chunks, F.col("p"), 2).orderBy("article_key", "rank").collect()]
    assert got == [("a", "c3", 0.82, 1), ("a", "c1", 0.82, 2), ("b", "c5", 0.92, 1)]


def plain_expand(chunks, most, budget):
    own = [c for c in chunks if c[3] is not None]
    seen, rest = {c[2] for c in own}, []
    for c in sorted((c for c in chunks if c[3] is None and (c[2] or "").strip()), key=lambda c: (c[4], c[1])):
        if c[2] not in seen:
            seen.add(c[2])
            rest.append(c)
    size = lambda t: max(1, len(t) // 4) if t else 0
    kept, used = [], 0
    for c in sorted(own + rest, key=lambda c: (-c[5], -(c[3] or 0), c[4], c[1])):
        if len(kept) < most and (not budget or used + size(c[2]) <= budget):
            kept.append(c[1])
            used += size(c[2])
    return (kept, used) if kept else ([c[1] for c in sorted(own, key=lambda c: (c[4], c[1]))], sum(size(c[2]) for c in own))


def test_expansion_equals_a_loop(spark):
    rng = random.Random(13)
    rows = []
    for a in range(40):
        rows += [(f"a{a}", f"c{i}", rng.choice([None, "", " ", "w" * rng.choice((40, 400, 4000)), f"t{i} " * rng.randrange(300)]), rng.choice([None, None, 0.5, 0.9]), i, float(rng.randrange(4))) for i in range(rng.randrange(1, 25))]
    rows += [("long", f"c{i:03}", "x" * 4000 + str(i), None, i, 9.0) for i in range(60)] + [("long", "z", "fits", None, 99, 0.0), ("none", "own", "y" * 9000, 0.1, 1, 0.0)]
    df = spark.createDataFrame(rows, "article_key string, chunk_id string, text string, score double, chunk_index int, p double").repartition(3)
    primary = df.select("article_key").distinct().withColumn("query_id", F.col("article_key"))
    for most, budget in ((4, 290), (8, 900), (3, 0)):
        got = {r.query_id: (r.kept, r.used) for r in R.expand_primary(primary, df, F.col("p"), most, budget).collect()}
        assert got == {a: plain_expand([r for r in rows if r[0] == a], most, budget) for a in {r[0] for r in rows}}
    assert got["none"] == (["own"], 2250)


def test_axes_take_the_best_of_equal_texts(spark):
    hits = spark.createDataFrame([(1, 0, "b", "same", 0.1), (1, 0, "c", "same", 0.9), (1, 1, "a", "same", 1.0), (1, 1, "d", "other", 0.5)], "question int, axis int, chunk_id string, text string, score double")
    assert [(r.chunk_id, r.score) for r in R.multi_axis(hits, 100).orderBy(F.desc("score")).collect()] == [("c", 0.9), ("d", 0.5)]


def test_concepts_in_parts(spark):
    t = unicodedata.normalize("NFD", "Đái tháo đường và huyết áp")
    got = spark.createDataFrame([(t,)], "t string").select(A.concepts(F.col("t")).alias("x")).first().x
    assert got == ["đái tháo", "tháo đường", "huyết áp", "đái tháo đường"]


# ------------------------------------------------------------------ embedding
def plain_vector(text, dim):
    v = [0.0] * dim
    for w in re.findall(r"\w+", (text or "").lower()):
        h = hashlib.md5(w.encode()).hexdigest()
        v[int(h[:8], 16) % dim] += 1 if h[8] < "8" else -1
    n = math.sqrt(sum(x * x for x in v))
    return [x / n if n else 0.0 for x in v]


def test_vectors(spark):
    texts = ["Một hai ba một", "a b c d e f " * 30, "", None, "x", "!!! ...", "Ünïcödé naïve 12"]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    for dim in (4, 64):
        for r in E.embed(df, "i", "t", dim).collect():
            assert r.vector == pytest.approx(plain_vector(texts[r.i], dim), abs=1e-6)


def test_embedding_job(spark, tmp_path):
    df = spark.createDataFrame([(f"id{i}", f"text number {i}" if i else "") for i in range(50)], "id string, t string")
    vectors = E.embed(df, "id", "t", 32)
    E.write_batches(vectors, str(tmp_path / "a"), "id", files=3)
    assert E.finalise(spark, str(tmp_path / "a"), "id", 32)["chunk_count"] == 50
    with pytest.raises(ValueError, match="expected 64"):
        E.finalise(spark, str(tmp_path / "a"), "id", 64)
    vectors.limit(40).write.mode("overwrite").parquet(str(tmp_path / "a" / "vectors"))
    with pytest.raises(ValueError, match="manifest differs"):
        E.finalise(spark, str(tmp_path / "a"), "id")
    E.write_batches(vectors.unionAll(vectors.limit(1)), str(tmp_path / "b"), "id")
    with pytest.raises(ValueError, match="51 vectors, 50 ids"):
        E.finalise(spark, str(tmp_path / "b"), "id")


def test_alignment(spark):
    ids = lambda *x: spark.createDataFrame([(i,) for i in x], "id int")
    r = E.alignment(ids(1, 2, 2, 3, None), ids(1, 2, 4, None), ids(1, 3, 5, 6), "id").first()
    assert tuple(r) == (3, 3, 4, 1, 1, 1, 2)
    v = spark.createDataFrame([(1, [0.0, 1.0])], "id int, vector array<float>")
    points = E.load_points(v, ids(1, 2).withColumn("text", F.lit("t")), ids(1).withColumn("m", F.lit("m")), "id", 2).collect()
    assert [(p.id, p.text, p.m) for p in points] == [(1, "t", "m")]
    with pytest.raises(ValueError, match="without a text: 0, without metadata: 1"):
        E.load_points(v, ids(1), ids(2), "id", 2)
    with pytest.raises(ValueError, match="don't have 3"):
        E.load_points(v, ids(1), ids(1), "id", 3)


# ------------------------------------------------------------------ stream
def record(i, **more):
    base = {"doc_id": f"d{i}", "title": f"A record with number {i}", "body": f"# One\nFirst body of {i}. " + "word " * 80 + "\n# References\n[1] Smith J et al. (2020)\n# Two\nsecond part " + "more " * 60, "source_name": "src", "doc_type": "guideline", "audience": "clinician", "trust_tier": 1, "language": "en", "source_url": "http://x"}
    return base | more


@pytest.mark.parametrize("repeats", ["number", "drop"])
def test_chunks_are_exported_once_each(spark, tmp_path, repeats):
    from lexmill.functions import predicates as P

    kinds = {"doc_type": sorted(P.DOC_TYPES)[0], "audience": sorted(P.AUDIENCES)[0]}
    files = [[record(1, **kinds), record(2, **kinds), record(1, **kinds)], [record(3, **kinds), record(2, **kinds), record(9, **kinds, title="")], [record(1, **kinds), record(4, **kinds)]]
    (tmp_path / "in").mkdir()
    for n, rows in enumerate(files):
        (tmp_path / "in" / f"{n}.jsonl").write_text("\n".join(map(json.dumps, rows)))
    stream = export.export_chunks(export.record_stream(spark, str(tmp_path / "in")), repeats=repeats)
    for _ in range(2):  # a second run finds nothing new
        stream.writeStream.outputMode("append").option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).format("parquet").start(str(tmp_path / "out")).awaitTermination()
    got = [(r.id, r.text) for r in spark.read.parquet(str(tmp_path / "out")).collect()]
    static = spark.createDataFrame([{k: str(v) if k != "trust_tier" else v for k, v in r.items()} for rows in files for r in rows], ", ".join(x for x in export.RECORD.split(", ") if x.split()[0] in record(0)))
    for c in (x.split() for x in export.RECORD.split(", ")):
        static = static if c[0] in static.columns else static.withColumn(c[0], F.lit(None).cast(c[1]))
    batch = [(r.id, r.text) for r in export.chunk_records(static.withColumns({"seen_at": F.current_timestamp(), "source_file": F.lit("f")})).collect()]
    assert len(batch) > len({i for i, _ in batch}) > 4 and not any("Smith" in t for _, t in batch)
    if repeats == "drop":
        assert sorted(got) == sorted(set(batch))
    else:
        want, n = [], {}
        for i, t in sorted(batch):
            want.append((i if not n.get(i) else f"{i}_{n[i]}", t))
            n[i] = n.get(i, 0) + 1
        assert sorted(got) == sorted(want) and len({i for i, _ in got}) == len(got)
