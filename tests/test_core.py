"""Sources, sinks, functions and operators on small fixtures."""

import json

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from lexmill.functions import html as H
from lexmill.functions import predicates as P
from lexmill.functions import scores as S
from lexmill.functions import text as T
from lexmill.operators import dedup, evaluation, manifest, qa, retrieval, sessions, structure
from lexmill.sources import readers, sinks

SF = "/root/testdata/sf0.001"


def one(spark, column):
    return spark.range(1).select(column.alias("v")).first().v


def lit(x):
    return F.lit(x).cast("string") if x is None else F.lit(x)


# -------------------------------------------------------------------- functions
@pytest.mark.parametrize(("text", "want"), [(None, ""), (" a\r\nb\t\t c\n\n\n\nd ", "a\nb c\n\nd"), ("", "")])
def test_normalize_whitespace(spark, text, want):
    assert one(spark, T.normalize_whitespace(lit(text))) == want


@pytest.mark.parametrize(("text", "keeps", "folds", "slug"), [
    ("Đường ệ ệ", "đuong e e", "duong e e", "uong_e_e"), ("Straße", "straße", "straße", "strae"), ("", "", "", "untitled"), ("  ", "", "", "untitled"),
    (None, "", "", "untitled"), ("a" * 80, "a" * 80, "a" * 80, "a" * 60),
])
def test_folds_and_slug(spark, text, keeps, folds, slug):
    assert one(spark, T.fold(lit(text))) == keeps and one(spark, T.fold_d(lit(text))) == folds and one(spark, T.slug(lit(text))) == slug


def test_uuid5(spark):
    import uuid

    for x in ("", "chunk1", "é"):
        assert one(spark, T.uuid5_url(F.lit(x))) == str(uuid.uuid5(uuid.NAMESPACE_URL, x))


def test_sequence_ratio_and_concepts(spark):
    df = spark.createDataFrame([("abcd", "bcde"), ("", "x"), (None, "x")], "a string, b string")
    assert [r.r for r in df.select(S.sequence_ratio("a", "b").alias("r")).collect()] == [0.75, 0.0, 0.0]
    rows = spark.createDataFrame([("The dose is 5 mg daily.", "5 mg"), ("No figure.", "12 mg"), ("alpha beta gamma", "beta delta"), ("x", None)], "a string, c string")
    got = [r.v for r in rows.select(S.concept_overlap(F.col("a"), F.col("c")).alias("v")).collect()]
    assert got[0] == 1.0 and got[1] < 0.3 and got[2] >= 0.5 and got[3] == 0.0


def test_record_errors_null_matrix(spark):
    rows = [("d", "t", "b", "s", "review", "patient", 1), (None, " ", "", None, None, None, 0), ("d", "t", "b", "s", "poster", "robot", 9)]
    df = spark.createDataFrame(rows, "i string, t string, b string, s string, k string, a string, n int")
    got = [len(r.e) for r in df.select(P.record_errors(*[F.col(c) for c in "itbskan"]).alias("e")).collect()]
    assert got == [0, 7, 3]


def test_gates(spark):
    rows = [("go", True), ("REVIEW", True), ("hold", False), (None, False), ("odd", False)]
    df = spark.createDataFrame(rows, "s string, w boolean")
    assert all(r.v == r.w for r in df.select("w", P.passes_gate(F.col("s"), "review").alias("v")).collect())


# -------------------------------------------------------------------- structure
def test_markdown_stack_pops_by_depth(spark):
    got = one(spark, structure.markdown_sections(F.lit("pre\n# A\na\n### C\nc\n## B\nb\n# D")))
    assert [(s.level, s.title, s.body, s.heading_path) for s in got] == [(1, "A", "a", "A"), (3, "C", "c", "A > C"), (2, "B", "b", "A > B"), (1, "D", "", "D")]


def test_plain_and_inline_sections(spark):
    text = "x\nTÓM TẮT\nmột\n\n2. Kết quả:\nhai\nReferences\n"
    assert [(s.title, s.body) for s in one(spark, structure.sections(F.lit(text)))] == [("TÓM TẮT", "một"), ("KẾT QUẢ", "hai")]
    assert [(s.title, s.body) for s in one(spark, structure.sections(F.lit("KẾT LUẬN: xong\nthêm")))] == [("KẾT LUẬN", "xong\nthêm")]
    assert one(spark, structure.sections(F.lit("nothing here"))) == [] and one(spark, structure.sections(lit(None))) == []


@pytest.mark.parametrize(("n", "size", "overlap"), [(0, 900, 150), (900, 900, 150), (901, 900, 150), (5000, 900, 150), (50, 10, 10), (1650, 900, 150), (1651, 900, 150)])
def test_windows_cover_the_text(spark, n, size, overlap):
    text = "".join(chr(97 + i % 26) for i in range(n))
    got = one(spark, structure.windows(F.lit(text), size, overlap))
    over = max(0, size // 4) if overlap >= size else overlap
    want, start = [], 0
    while start < n:
        end = min(n, start + size)
        want.append(text[start:end])
        if end >= n:
            break
        start = end - over
    assert got == want


def test_folds_over_arrays(spark):
    assert one(spark, structure.pack(F.array(*[F.lit(x) for x in ("aa", "bb", "cccc", "d")]), 6, " ")) == ["aa bb", "cccc d"]
    blocks = F.array(*[F.lit(x) for x in ("One two three four five six seven", "one two three  four five six seven", "two three four five six seven eight no", "three four five six seven yes ok", "b")])
    assert len(one(spark, structure.dedupe_blocks(blocks))) == 4
    secs = [(1, "a", "x" * 10, "a"), (1, "b", "y" * 400, "b"), (1, "c", "z", "c")]
    df = spark.createDataFrame([(secs,)], "s array<struct<level:int,title:string,body:string,heading_path:string>>")
    assert [len(s.body) for s in df.select(structure.merge_short(F.col("s")).alias("v")).first().v] == [412, 1]


def test_chunks_have_headers(spark):
    df = spark.createDataFrame([(1, "T", "# H\nbody", "src"), (2, "", "plain " * 300, "src"), (3, "T", None, "src")], "doc_id long, title string, body string, source_name string")
    got = structure.chunks(df).collect()
    assert [(r.doc_id, r.chunk_index) for r in got] == [(1, 0), (2, 0), (2, 1), (2, 2)]
    assert got[0].chunk == "Title: T\nSection: H\nSource: src\nBody:\nbody" and got[0].heading_path == "H"


# ------------------------------------------------------------------------ dedup
def test_duplicate_precedence(spark):
    body = "lorem ipsum dolor " * 40
    rows = [(1, body), (2, body), (3, body.replace(" ", "  ")), (4, "alone"), (5, None), (6, "")]
    got = {r.doc_id: (r.duplicate_group_id, r.duplicate_reason) for r in dedup.duplicate_groups(spark.createDataFrame(rows, "doc_id long, body string")).collect()}
    assert got[1] == got[2] == ("exact_1", "exact_body_match") and got[3] == ("near_3", "fingerprint_match") and got[4] == (None, None) and got[5] == got[6] == ("exact_5", "exact_body_match")
    report = dedup.duplicate_report(dedup.duplicate_groups(spark.createDataFrame(rows, "doc_id long, body string"))).first()
    assert (report.total_records, report.duplicate_suspects, report.gate_passed) == (6, 5, False)


def test_keep_best_is_stable_under_permutation(spark):
    rows = [(1, "k", 1), (2, "k", 3), (3, "k", 3), (4, "l", 0)]
    for order in (rows, rows[::-1], rows[2:] + rows[:2]):
        df = spark.createDataFrame(order, "pos long, k string, r int")
        assert sorted(r.pos for r in dedup.keep_best(df, F.col("k"), F.col("r"), "pos").collect()) == [2, 4]


def test_title_pairs_equal_brute_force(spark):
    import random

    rng = random.Random(2)
    base = ["".join(rng.choice("abcde ") for _ in range(rng.randrange(4, 30))).strip() or "x" for _ in range(60)]
    names = base + [b[:k] + rng.choice("xyz") + b[k + rng.randrange(2) :] for b in base for k in [rng.randrange(len(b))]]
    df = spark.createDataFrame(list(enumerate(names)), "i long, t string")
    got = {(r.a, r.b) for r in dedup.title_pairs(df, "i", "t").collect() if r.a != r.b}

    def dist(a, b):
        p = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            q = [i]
            for j, y in enumerate(b, 1):
                q.append(min(p[j] + 1, q[-1] + 1, p[j - 1] + (x != y)))
            p = q
        return p[-1]

    u = sorted({n.lower().strip() for n in names})
    want = {(a, b) for a in u for b in u if a < b and 1 - dist(a, b) / max(len(a), len(b)) > 0.85}
    assert got == want


# -------------------------------------------------------------------- retrieval
def test_dense_threshold_is_inclusive(spark):
    v = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.5, 0.8660254037844386]), (3, [0.0, 1.0]), (4, None), (5, [0.0, 0.0])], "vec_id long, embedding array<double>")
    q = spark.createDataFrame([(9, [1.0, 0.0]), (8, None)], "query_id long, embedding array<double>")
    got = [(r.vec_id, round(r.score, 6), r["rank"]) for r in retrieval.dense_top_k(q, v, 10, 0.49999).orderBy("rank").collect()]
    assert got == [(1, 1.0, 1), (2, 0.5, 2)]
    assert retrieval.dense_top_k(q.limit(0), v, 3).count() == 0


def test_budgets_differ(spark):
    hits = spark.createDataFrame([(1, 1, 0.9, 60), (1, 2, 0.8, 50), (1, 3, 0.7, 30)], "q int, d long, s double, tokens long").withColumn("neg", -F.col("s"))
    assert [r.d for r in retrieval.budget_prefix(hits, ["q"], [F.desc("s")], F.col("tokens"), 100).collect()] == [1]
    assert [r.d for r in retrieval.budget_greedy(hits, ["q"], ["neg"], "d", "tokens", 100).orderBy("pos").collect()] == [1, 3]


def test_widen_only_poor_queries(spark):
    u = spark.createDataFrame([(1, 1), (1, 2), (1, 3), (2, 1), (2, 2)], "q int, d int")
    f = spark.createDataFrame([(1, 1), (1, 2), (2, 1)], "q int, d int")
    assert sorted((r.q, r.d, r.widened) for r in retrieval.widen(f, u, "q", "d").collect()) == [(1, 1, False), (1, 2, False), (2, 1, False), (2, 2, True)]


def test_hit_metrics(spark):
    r = spark.createDataFrame([("a", 1, False), ("a", 2, True), ("b", 1, False), ("c", 1, True)], "q string, rank int, hit boolean")
    m = evaluation.hit_metrics(evaluation.first_hit(r, ["q"]), [[]]).first()
    assert (m.queries, m.hit1, m.hit3, m.mrr) == (3, 33.3333, 66.6667, 0.5)


@pytest.mark.parametrize(("base", "hit", "mrr", "generic", "want"), [(80, 79, 1, 0, "ROLLBACK"), (90, 90, 0.9, 1, "ROLLBACK"), (90, 88, 0.9, 0, "PROMOTE"), (90, 86, 0.9, 0, "MANUAL_REVIEW"), (95, 85, 0.9, 0, "ROLLBACK")])
def test_verdict(spark, base, hit, mrr, generic, want):
    assert one(spark, S.verdict(F.lit(base), F.lit(hit), F.lit(0.9), F.lit(mrr), F.lit(generic))) == want


# --------------------------------------------------------------------- manifest
def test_changes(spark):
    rows = [(1, "a", "s1"), (2, "b", "s1"), (3, "a", "s2"), (4, "a", "s2"), (5, "b", "s1")]
    got = {r.i: (r.duplicate_status, r.duplicate_of) for r in manifest.changes(spark.createDataFrame(rows, "i long, k string, sha string"), "k", "sha", ["i"], "i").collect()}
    assert got == {1: ("", None), 2: ("alias_same_source", 1), 3: ("updated_asset", 1), 4: ("", None), 5: ("alias_same_source", 1)}


def test_alignment(spark):
    ids = spark.createDataFrame([("a", 0), ("b", 1), ("c", 2)], "id string, pos int")
    texts = spark.createDataFrame([("a", 0), ("c", 1), ("x", 2)], "id string, pos int")
    r = manifest.aligned(ids, {"texts": texts}, "id", "pos").first()
    assert (r.artefact, r.missing, r.extra, r.misplaced) == ("texts", 1, 1, 1)
    assert manifest.parity(ids, texts, "id").first().status == "mismatch" and manifest.parity(ids, ids, "id").first().status == "match"


def test_sessions(spark):
    t = spark.createDataFrame([(1, 0, "user", "one two"), (1, 1, "assistant", "hm"), (1, 2, "user", "more"), (2, 0, "assistant", "x")], "conv_id long, turn long, role string, text string")
    assert [r.rewritten for r in sessions.rewrite(t).orderBy("turn").collect()] == ["one two", "Regarding one two: more"]
    assert {r.conv_id: (r.title, r.messages) for r in sessions.listing(t).collect()} == {1: ("one two", 3), 2: (None, 1)}


# ---------------------------------------------------------------- sources, sinks
def test_jsonl_strict_and_tolerant(spark, tmp_path):
    p = tmp_path / "r.jsonl"
    good = {"doc_id": "1", "title": "T", "body": "B", "source_name": "S", "tags": ["x", "y"], "quality_flags": "a, b,", "trust_tier": "2", "is_mixed_language": "Yes", "unknown": 3, "language_confidence": "odd"}
    p.write_text(json.dumps(good) + "\n\n" + json.dumps({"title": "no id", "body": "b"}) + "\n{bad\n")
    rows = readers.jsonl(spark, str(p), strict=False, source_name="given").orderBy("title").collect()
    assert len(rows) == 2 and rows[0].tags == ["x", "y"] and rows[0].quality_flags == ["a", "b"] and rows[0].trust_tier == 2 and rows[0].is_mixed_language
    assert rows[1].source_name == "given" and len(rows[1].doc_id) == 16 and rows[1].doc_type == "reference" and rows[1].quality_score is None
    with pytest.raises(Exception):  # noqa: B017
        readers.jsonl(spark, str(p)).collect()
    assert readers.load(spark, str(p), "given").count() == 2


def test_csv_txt_markdown(spark, tmp_path):
    (tmp_path / "a.csv").write_text('TITLE,Content,Doc_Type,tags\n,"multi\nline",poster,"x, y"\nb,,faq,\nc,d,faq,\n')
    rows = readers.load(spark, str(tmp_path / "a.csv")).orderBy("title").collect()
    assert [(r.title, r.body, r.doc_type, r.tags) for r in rows] == [("c", "d", "faq", []), ("multi line", "multi\nline", "reference", ["x", "y"])]
    (tmp_path / "t").mkdir()
    (tmp_path / "t" / "my_first-file.txt").write_text(" hello \n")
    (tmp_path / "t" / "empty.txt").write_text(" ")
    rows = readers.load(spark, str(tmp_path / "t")).collect()
    assert [(r.title, r.body, r.source_name) for r in rows] == [("My First File", "hello", "TXT Import")]
    (tmp_path / "doc.md").write_text("lost\n# One\na\n#### deep\nb\n## Two\n\n# Three\nc")
    rows = readers.load(spark, str(tmp_path / "doc.md")).orderBy("heading_path").collect()
    assert [(r.heading_path, r.body) for r in rows] == [("Doc > One", "a\n#### deep\nb"), ("Doc > Three", "c")]
    with pytest.raises(ValueError):
        readers.detect_format(spark, str(tmp_path / "t" / "my_first-file.txt").replace(".txt", ".zip")) if (tmp_path / "t" / "my_first-file.zip").write_text("") == 0 else None


def test_frontmatter(spark, tmp_path):
    raw = "---\ntitle: \"A: b\"\n# note\nk: 1\nk: '2'\nbroken\n---\nbody\n---\nx"
    got = one(spark, readers.frontmatter(F.lit(raw)))
    assert got.meta == {"title": "A: b", "k": "2"} and got.body == "body\n---\nx"
    got = one(spark, readers.frontmatter(F.lit("no block")))
    assert got.meta == {} and got.body == "no block"


def test_manifest_and_xml(spark, tmp_path):
    assert readers.manifest(spark, str(tmp_path / "none.csv")).count() == 0
    rows = readers.manifest(spark, str(tmp_path / "none.csv")).union(spark.createDataFrame([tuple("a" if i == 0 else "" for i in range(24))], ", ".join(f"{c} string" for c in readers.MANIFEST)))
    sinks.manifest(rows, str(tmp_path / "m"))
    back = readers.manifest(spark, str(tmp_path / "m")).collect()
    assert len(back) == 1 and back[0].source_id == "a" and back[0].notes == ""
    (tmp_path / "x.xml").write_text('<r><health-topic title="Flu" url="u" id="1" language="English"><full-summary>&lt;p&gt;' + "word " * 20 + "&lt;/p&gt;</full-summary></health-topic><health-topic title='Tos' language='Spanish'><also-called>una tos que no se quita nunca</also-called><full-summary>x</full-summary></health-topic></r>")
    got = readers.xml_topics(spark, str(tmp_path / "x.xml")).orderBy("title").collect()
    assert [(r.doc_id, r.language) for r in got] == [("topic_en_flu", "en"), ("topic_es_tos", "es")] and got[1].body.startswith("Also known as: ")


def test_binary_pages(spark, tmp_path):
    (tmp_path / "a.bin").write_bytes(b"page one " * 10 + b"\f two")
    (tmp_path / "b.bin").write_bytes(b"\xff")
    out = readers.binary_pages(spark, str(tmp_path), lambda b: b.decode().split("\f")).withColumn("k", readers.classify_pages(F.col("pages")))
    assert sorted(r.k for r in out.collect()) == ["corrupted", "digital"]


def test_html(spark):
    page = "<title>t</title><nav>n</nav><main><h1>Head</h1><p>" + "long text " * 8 + "</p><ul><li>one item here<ul><li>nested item here</li></ul></li></ul><table><tr><td>a cell<td>b cell</tr></table></main><footer>f</footer>"
    df = spark.createDataFrame([(page,), (None,), ("",)], "h string")
    rows = df.select(H.to_text_with_lists("h").alias("t"), H.to_sections("h").alias("s")).collect()
    assert rows[0].t.split("\n")[2:] == ["- one item here", "  - nested item here", "a cell | b cell"] and rows[0].s[0].title == "Head"
    assert rows[1].t == rows[2].t == "" and rows[1].s == []
    assert one(spark, H.meta(F.lit('<meta property="og:title" content="X">'), "og:title")) == "X"


def test_release_and_upsert(spark):
    rows = [(0, "a", "t", "b", "s", "review", "patient", 1, ""), (1, "a", "t2", "b", "s", "review", "patient", 1, ""), (2, "", "t", "b", "s", "review", "patient", 1, ""), (3, "", "", "b", "s", "review", "patient", 1, "")]
    df = spark.createDataFrame(rows, "pos long, doc_id string, title string, body string, source_name string, doc_type string, audience string, trust_tier int, source_id string")
    assert sinks.build_release({"x": df, "y": df}).count() == 6
    assert sinks.build_release({"x": df, "y": df}, "doc_id").count() == 5 and sinks.build_release({"x": df}, "none").count() == 4
    assert sinks.build_release({"x": df}).where("not is_valid").count() == 2
    assert qa.unique_ids(df.withColumn("id", F.lit("c")), "id", ["pos"]).select("unique_id").distinct().count() == 4


# ---------------------------------------------------------------------- registry
def test_every_query_is_whole_and_equals_its_sql(spark):
    """A sample of the registry here; the driver holds all of it against SQL."""
    con = duckdb.connect()
    for t in ("documents", "events", "customer", "part", "embeddings", "benchmark", "labels", "conversations", "orders", "pages", "lineitem"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    queries, sql = entry.queries(), entry.oracle_sql()
    assert set(sql) <= set(queries)
    for name in ("t02_slug", "c02_ingest_quality", "a01_duplicate_groups", "x04_chunk_by_structure", "z03_change_detection", "l08_stratified_split", "j18_title_similarity"):
        got = queries[name](spark, SF)
        cols = sorted(got.columns)
        want = con.execute(f"SELECT {', '.join(cols)} FROM ({sql[name]})").fetchall()
        norm = lambda r: tuple(f"{x:.9g}" if isinstance(x, float) else str(x) for x in r)
        assert sorted(map(norm, got.select(*cols).collect())) == sorted(map(norm, want)), name


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def _bodies():
    import pyarrow.parquet as pq

    t = pq.read_table(f"{SF}/documents.parquet").to_pydict()
    return {i: x or "" for i, x in zip(t["doc_id"], t["text"], strict=True)}


def _md5(x):
    import hashlib

    return hashlib.md5(x.encode()).hexdigest()


def test_sections_of_whole_bodies(spark):
    import re

    bodies, ws = _bodies(), " \t\n\x0b\x0c\r"
    got = {}
    for name in ("x01_markdown_sections_whole", "x02_inline_sections_whole", "h01_plain_sections_whole"):
        for r in entry.queries()[name](spark, SF).orderBy("doc_id", "pos").collect():
            got.setdefault((name[:3], r.doc_id), []).append((r.level, r.title, r.heading_path, r.body_md5))
    plain = 0
    for i, b in bodies.items():
        lines = f"# One\n{b[:50]}\n### Deep\nx\n## Two\n{b[50:]}".split("\n")
        want, stack = [], []
        for x in lines:
            m = re.fullmatch(r"(#{1,6})[ \t\x0b\f\r]+([^\r\u0085\u2028\u2029]+)\r?", x)
            if m:
                stack = [*stack[: len(m[1]) - 1], m[2].strip(" ")]
                want.append([len(m[1]), m[2].strip(" "), " > ".join(stack), []])
            else:
                want[-1][3].append(x)
        assert got["x01", i] == [(a, t, p, _md5("\n".join(z).strip(ws))) for a, t, p, z in want], i
        if re.search(T.HEADING_WORDS, b, re.I):
            continue
        plain += 1
        own = lambda s: "\n".join(re.split(r"\r\n|\r|\n", s))
        want = [("ABSTRACT", own(b).strip(ws)), ("REFERENCES", "1. x")]
        assert got["h01", i] == [(1, t, t, _md5(z)) for t, z in want if z], i
        first, *others = own(b[:40]).split("\n")
        rest = "\n".join([" ".join(first.split()), *others, own(b[40:])]).strip(ws)
        want = [("KẾT QUẢ", rest)] * bool(first.strip()) + [("KẾT LUẬN", "xong")]
        assert got["x02", i] == [(1, t, t, _md5(z)) for t, z in want], i
    assert plain > 100


def test_evidence_of_whole_bodies(spark):
    import re

    from lexmill.functions import evidence as V
    from lexmill.plans.evidence_queries import STATS

    bodies = _bodies()
    rows = entry.queries()["t36_t39_h27_evidence_whole"](spark, SF).collect()
    assert len(rows) == len(bodies) and max(r.sentences for r in rows) > 20
    for r in rows:
        t = bodies[r.doc_id] + "\n" + STATS[r.doc_id % len(STATS)]
        assert r.numbers == "|".join(f"{m}={v}" for m, p in V.METRICS for v in re.findall("(?i)" + p, t, re.A)), r.doc_id
        flat = re.sub(r"(?<!\n)\n(?!\n)", " ", t)
        parts = [re.sub(r"^[ \-]+|[ \-]+$", "", " ".join(x.split())) for x in re.split(r"(?<=[.?!])\s+|\n+", flat)]
        assert r.sentences == sum(len(x) >= 30 and not any(f in x.lower() for f in V.FRAGMENTS) for x in parts), r.doc_id
    low = {r.doc_id: r for r in entry.queries()["c15_t68_t70_coverage_whole"](spark, SF).collect()}
    for i, b in bodies.items():
        words = b.split("\n")[0][:80].split()
        if words and all(re.fullmatch("[a-z]{2,}", w) for w in words) and set(words) <= set(re.findall("[a-z]+", b[49:])):
            assert low[i].present and low[i].lexical == 1.0, i


def test_slices_are_gone(spark, tmp_path):
    body = "alpha beta gamma delta\n" + "filler words stand here. " * 60 + "Then alpha beta gamma delta"
    spark.createDataFrame([(1, body, "en", "s", len(body))], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    q = lambda n: entry.queries()[n](spark, str(tmp_path)).collect()
    assert q("c15_concept_overlap")[0].overlap == 1.0 and q("c16_best_sentence")[0].best > 0.8
    assert q("c15_t68_t70_coverage_whole")[0][1:] == (1.0, True, 1.0)
    body = "short one here, " * 40 + "and a wholly different question far behind the start"
    spark.createDataFrame([(1, body, "en", "s", len(body))], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/far/documents.parquet")
    got = [r.subquery for r in entry.queries()["c25_decompose"](spark, f"{tmp_path}/far").collect()]
    assert got[-1].endswith("far behind the start")
