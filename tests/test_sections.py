"""Cleaning, sections, issues and rewriting against plain loops with their own words."""

import random
import re
import unicodedata

import pytest
from pyspark.sql import functions as F

from lexmill.functions import cleaning as L
from lexmill.functions import quarantine as Q
from lexmill.functions import rewriting as W
from lexmill.operators import sectionizers as S

HEADS = re.compile(
    r"^((I{1,3}V?|VI{0,3}|IX|X)\.\s+.+|\d+\.\s+[A-ZÀ-Ỹ].{5,}|[A-ZÀ-Ỹ][A-ZÀ-Ỹ\s,()]{15,}|TÓM TẮT|ABSTRACT|SUMMARY|ĐẶT VẤN ĐỀ|GIỚI THIỆU|MỞ ĐẦU|ĐỐI TƯỢNG VÀ PHƯƠNG PHÁP.*|KẾT QUẢ.*|BÀN LUẬN|KẾT LUẬN|KIẾN NGHỊ"
    r"|TÀI LIỆU THAM KHẢO|LỜI NÓI ĐẦU|MỤC LỤC|DANH MỤC.*|ĐẠI CƯƠNG|CHỈ ĐỊNH|CHỐNG CHỈ ĐỊNH|CHUẨN BỊ|CÁC BƯỚC TIẾN HÀNH|THEO DÕI|TAI BIẾN|Chương\s+\d+)$", re.I)
PIECES = [
    "TÓM TẮT", "KẾT", "QUẢ NGHIÊN CỨU", "KẾT QUẢ 2", "abc def ghi jkl", "mno pqr", "một dòng bị ngắt", "giữa câu và", "kết thúc.", "12", " 7 ", "", "", "x.kcb_Nguyen Van A_29/10/2025 17:15:41", "TẠP CHÍ Y HỌC SỐ 12", "1. Abc", "dài hơn nữa", "II. Phần hai",
    "DANH", "MỤC các bảng", "Chương", "3 của", "short", "VIETNAM MEDICAL JOURNAL N1", "(trong ngoặc)", "a, b (c) d", "Tiế\u0302\u0301ng", "to\u0323\u0302 gì", "e\u0302\u0323 và e\u0323\u0302", "đứng：", "số 5;", "Độc lập - Tự do - Hạnh phúc", "\u00a0\u2003đầu dòng", "BÀI NGHIÊN CỨU ",
]


def over(spark, values, make):
    """Results of a column over texts, in their order."""
    df = spark.createDataFrame(list(enumerate(values)), "i int, t string").repartition(3)
    return [r.x for r in sorted(df.select("i", make(F.col("t")).alias("x")).collect(), key=lambda r: r.i)]


def plain_clean(text):
    noise = [r"[a-zA-Z0-9_.]+_[A-Za-zÀ-ỹ\s]+_\d\d/\d\d/\d{4}\s+\d\d:\d\d:\d\d$", r"\d{1,5}$", r"(?i)TẠP CHÍ Y\s*.{0,60}(SỐ|TẬP|THÁNG)", "(?i)VIETNAM MEDICAL JOURNAL", "(?i)BÀI NGHIÊN CỨU$", r"Độc lập\s*-\s*Tự do\s*-\s*Hạnh phúc$"]
    rows = [x.strip() for x in unicodedata.normalize("NFC", text).splitlines()]
    out = []
    for x in rows:
        if any(re.match(p, x) for p in noise):
            continue
        joins = x and out and out[-1] and not HEADS.match(x) and not HEADS.match(out[-1]) and out[-1][-1] not in ".?!;:。）)" and len(x) > 5
        if joins:
            out[-1] += " " + x
        else:
            out.append(x)
    return re.sub("\n{3,}", "\n\n", "\n".join(out)).strip()


def test_clean_text_equals_a_loop(spark):
    rng = random.Random(4)
    texts = ["\n".join(rng.choice(PIECES) for _ in range(rng.randrange(40))) for _ in range(400)] + ["", "\r\na\x0bb\u2028c\r", "x " * 50_000 + "\n" + "y" * 10, None]
    texts += ["\n".join(["một từ nữa"] * 3000)]  # one island that grows
    assert over(spark, texts, L.clean_text) == [plain_clean(t or "") for t in texts]


def test_composition(spark):
    rng = random.Random(5)
    marks = "\u0300\u0301\u0302\u0303\u0306\u0308\u0309\u031b\u0323\u0328"
    texts = ["".join(rng.choice("aeiouydAEO đêơ文.") + "".join(rng.choice(marks) for _ in range(rng.choice((0, 0, 1, 2, 3)))) for _ in range(30)) for _ in range(300)] + ["\u0301x", "", None]
    assert over(spark, texts, L.nfc) == [unicodedata.normalize("NFC", t or "") for t in texts]


def test_titles(spark):
    texts = ["pdf", "xem chi tiết", "A good plain title", "short", "some-slug-of-words", "File_name.v2", "0" * 24, "", None, "- A dashed title —"]
    assert over(spark, texts, L.needs_cleanup) == [True, True, False, True, True, True, True, True, True, False]
    assert over(spark, ["12/03/2020\nMỤC LỤC ....... 3\n1 Phần một 5\nFilename_without_blanks\n  A real heading of it\nAnother one here", "x"], L.body_heading) == ["A real heading of it", ""]
    assert over(spark, ["a/b-" + "0aF" * 9, "x", None], L.hex_tail) == [("0af" * 9), "", ""]


# ------------------------------------------------------------------ procedures
ANCHORS = ["ĐẠI CƯƠNG", "CHỈ ĐỊNH", "CHUẨN BỊ", "AN TOÀN", "1. MỤC ĐÍCH", "2. CHUẨN BỊ", "Thận trọng khi dùng"]
LINES = [*ANCHORS, "1. Quy trình kỹ thuật đo", "2. Đặt nội khí quản khó", "3. CHUẨN BỊ dụng cụ và người", "4. Ngắn", "một dòng dài hơn ba mươi ký tự để đủ " * 6, "Căn cứ luật số 5", "..... 7", "12", "Ký bởi: x", "TÀI LIỆU THAM KHẢO", "", "references"]
KNOWN = ["ĐẠI CƯƠNG", "CHỈ ĐỊNH", "CHỐNG CHỈ ĐỊNH", "THẬN TRỌNG", "CHUẨN BỊ", "CÁC BƯỚC TIẾN HÀNH", "TIẾN HÀNH QTKT", "THEO DÕI VÀ XỬ TRÍ TAI BIẾN", "AN TOÀN", "NHỮNG SAI SÓT VÀ XỬ TRÍ", "TIÊU CHUẨN ĐÁNH GIÁ VÀ ĐẢM BẢO CHẤT LƯỢNG"]
MORE = ["TIẾN HÀNH", "THEO DÕI", "TAI BIẾN", "TÀI LIỆU THAM KHẢO", "REFERENCES", "NHỮNG SAI SÓT", "TIÊU CHUẨN ĐÁNH GIÁ", "MỤC ĐÍCH", "NGUYÊN LÝ"]


def cut_references(t):
    for name in ("TÀI LIỆU THAM KHẢO", "REFERENCES"):
        found = list(re.finditer(rf"\n\s*{name}\s*\n", t, re.I))
        if found:
            return t[: found[-1].start()]
    return t


def plain_procedures(title, body):
    rows = [x for x in body.splitlines() if not re.search(r"\.{3,}", x) and not re.match(r"\d{1,4}$", x.strip()) and "Ký bởi" not in x]
    weight = [bool(re.match(rf"\d+\.\s*({'|'.join([*KNOWN, 'MỤC ĐÍCH'])})\s*$", x.strip(), re.I)) + x.strip().upper().startswith(tuple(KNOWN)) for x in rows]
    starts = []
    for i, x in enumerate(rows):
        m = re.match(r"(\d{1,3})\.\s+(.+)$", x.strip())
        if m and len(m[2].strip()) >= 15 and not m[2].strip().upper().startswith(tuple(KNOWN + MORE)) and sum(weight[i + 1 : i + 12]) >= 2:
            starts.append((i, f"{m[1]}. {m[2].strip()}"))
    out = []
    for (a, name), (b, _) in zip(starts, [*starts[1:], (len(rows), "")], strict=False):
        text = cut_references("\n".join(rows[a:b]).strip())
        text = "\n".join(x for x in text.splitlines() if not re.match("(Căn cứ|BỘ Y TẾ)", x.strip(), re.I)).strip()
        if len(text) >= 200:
            out.append((name, f"{title} > {name}", text))
    whole = cut_references("\n".join(rows).strip())
    return out or ([(title, title, whole)] if len(whole) >= 200 else [])


def as_rows(x):
    return [tuple(s) for s in x]


def test_procedures_equal_a_loop(spark):
    rng = random.Random(6)
    bodies = ["\n".join(rng.choice(LINES) for _ in range(rng.randrange(60))) for _ in range(300)] + ["", "x" * 300]
    got = over(spark, bodies, lambda t: S.procedure_sections(F.lit("T"), t))
    want = [plain_procedures("T", b) for b in bodies]
    assert [as_rows(g) for g in got] == want and sum(len(w) > 1 for w in want) > 20


# ------------------------------------------------------------------ tables
def plain_table(title, body):
    rows, now = [], None
    for x in (y.strip() for y in body.splitlines()):
        if not x or x in ("TT", "STT") or x.startswith(("Tên hoạt chất", "Đường dùng", "Chỉ định phòng")):
            continue
        m = re.match(r"(\d+)\s+(.+)$", x)
        if m and len(m[2]) >= 3 and abs(int(m[1]) - len(rows) - 1) <= 2:
            if now and now[1]:
                rows.append(now)
            now = (m[2].strip(), [])
        elif now:
            now[1].append(x)
    if now and now[1]:
        rows.append(now)
    out = []
    for name, lines in rows:
        x, parts = " ".join(lines), [f"Hoạt chất: {name}"]
        if m := re.search(r"(Tiêm|Uống|Dùng ngoài|Nhỏ mắt|Hít):?\s*(.*?)(?:Điều trị|Chỉ định|$)", x):
            parts.append(f"Đường dùng: {m[1]} {m[2].strip()}")
        if m := re.search(r"(Điều trị|Chỉ định)\s+(.+?)(?:\.\s*(?:Điều trị|Chỉ định)|$)", x, re.S):
            parts.append(f"Chỉ định: {m[1]} {m[2].strip()}")
        elif x:
            parts.append(f"Thông tin: {x[:500]}")
        if len("\n".join(parts)) >= 30:
            out.append((f"{title} - {name}", f"{title} > {name}", "\n".join(parts)))
    return out or [(title, title, body.strip())]


def test_tables_equal_a_loop(spark):
    rng = random.Random(7)

    def line(i):
        return rng.choice([f"{max(1, i // 2 + rng.randrange(-3, 4))} Thuốc số {i}", "Tiêm: tĩnh mạch Điều trị sốt. Chỉ định khác", "Uống", "thông tin khác về thuốc " * 30, "STT", "", f"{i * 99999999999999999999} lớn", "7", "Chỉ định  nhiễm trùng", "3 ab"])

    bodies = ["\n".join(line(i) for i in range(rng.randrange(30))) for _ in range(300)] + ["", "không có bảng"]
    got = over(spark, bodies, lambda t: S.table_sections(F.lit("T"), t))
    want = [plain_table("T", b) for b in bodies]
    assert [as_rows(g) for g in got] == want and sum(len(w) > 2 for w in want) > 5


# ------------------------------------------------------------------ articles, publications
def plain_publication(title, body, most=6000):
    body = cut_references(body)
    if len(body) <= most:
        return [(title, title, body.strip())]
    parts, now, n = [], [], 0
    for p in body.split("\n\n"):
        if now and n + len(p) > 5000:
            parts.append(now)
            now, n = [], 0
        now.append(p)
        n += len(p)
    parts.append(now)
    texts = ["\n\n".join(p).strip() for p in parts]
    return [(title, title, texts[0])] if len(texts) == 1 else [(f"{title} (phần {i})", f"{title} > phần {i}", t) for i, t in enumerate(texts, 1)]


def plain_article(title, body):
    heads = "TÓM TẮT|ABSTRACT|SUMMARY|ĐẶT VẤN ĐỀ|GIỚI THIỆU|MỞ ĐẦU|ĐỐI TƯỢNG VÀ PHƯƠNG PHÁP.*|VẬT LIỆU VÀ PHƯƠNG PHÁP.*|KẾT QUẢ.*|BÀN LUẬN|KẾT LUẬN|KIẾN NGHỊ|TÀI LIỆU THAM KHẢO|REFERENCES"
    body = cut_references(body)
    parts = [("", [])]
    for x in body.splitlines():
        m = re.match(rf"({heads})\s*\d*$", x.strip(), re.I)
        if m:
            parts.append((m[1].strip(), []))
        else:
            parts[-1][1].append(x)
    out = []
    for name, rows in parts:
        text = "\n".join(rows).strip()
        if len(text) < 100 or (name or title).upper() in ("TÀI LIỆU THAM KHẢO", "REFERENCES"):
            continue
        if out and len(out[-1][2]) < 300:
            out[-1] = (*out[-1][:2], out[-1][2] + "\n\n" + text)
        else:
            out.append((name or title, f"{title} > {name}" if name else title, text))
    return out or [(title, title, body.strip())]


def test_articles_and_publications_equal_loops(spark):
    rng = random.Random(8)
    rows = ["TÓM TẮT", "kết quả nghiên cứu 2", "BÀN LUẬN 3", "Tài liệu tham khảo", "một dòng dài " * 9, "ngắn", "", "KẾT LUẬN", "SUMMARY x"]
    bodies = ["\n".join(rng.choice(rows) for _ in range(rng.randrange(30))) for _ in range(200)] + ["", "TÀI LIỆU THAM KHẢO"]
    assert [as_rows(g) for g in over(spark, bodies, lambda t: S.article_sections(F.lit("T"), t))] == [plain_article("T", b) for b in bodies]
    bodies = ["\n\n".join("p" * rng.randrange(2600) for _ in range(rng.randrange(9))) + rng.choice(["", "\nREFERENCES\nx"]) for _ in range(60)] + ["", "z" * 9000, "\n\n" * 4000]
    assert [as_rows(g) for g in over(spark, bodies, lambda t: S.publication_sections(F.lit("T"), t))] == [plain_publication("T", b) for b in bodies]
    generic = [as_rows(g) for g in over(spark, bodies, lambda t: S.generic_sections(F.lit("T"), t))]
    assert generic == [plain_publication("T", b) if len(cut_references(b)) > 8000 else [("T", "T", cut_references(b).strip())] for b in bodies]
    got = spark.createDataFrame([(s,) for s in ["who_vietnam", "kcb_moh", "dav_gov", "vmj_ojs", "?", None]], "s string").select("s", S.mode_of(F.col("s")).alias("m"), S.sectionize(F.lit(None).cast("string"), F.lit(None).cast("string"), F.col("s")).alias("x")).collect()
    assert {r.s: (r.m, as_rows(r.x)) for r in got} == {
        s: (m, [] if m == "procedure" else [("", "", "")]) for s, m in [("who_vietnam", "publication"), ("kcb_moh", "procedure"), ("dav_gov", "table_entry"), ("vmj_ojs", "article"), ("?", "generic"), (None, "generic")]}


# ------------------------------------------------------------------ issues
def shouts(x):
    letters = [c for c in x if c.isalpha()]
    return len(letters) >= 15 and sum(c.isupper() for c in letters) / len(letters) >= 0.65


AUTHOR = re.compile(r"([A-Za-zÀ-ỹ]+\s+){2,}.*?\d+")
HEADER = re.compile("TẠP CHÍ Y|vietnam medical journal", re.I)


def plain_issue(body):
    rows, found = body.splitlines(), []
    for i, x in enumerate(rows):
        m = re.match(r"\s*(TÓM TẮT|ABSTRACT|I\.\s*ĐẶT VẤN ĐỀ)", x, re.I)
        if not m:
            continue
        titles, top, author = [], None, ""
        for j in range(i - 1, max(0, i - 15) - 1, -1):
            y = rows[j].strip()
            if not y or HEADER.search(y):
                if titles:
                    break
            elif "ABSTRACT" in y.upper() or re.match("KẾT QUẢ|BÀN LUẬN|KẾT LUẬN|TÀI LIỆU THAM KHẢO|REFERENCES", y, re.I):
                break
            elif not author and len(y) > 10 and not shouts(y) and AUTHOR.search(y):
                author = y
            elif shouts(y):
                titles, top = [y, *titles], j
            elif titles:
                break
        score = (3 if "TÓM TẮT" in m[1].upper() else 1) + 2 * bool(author) + 2 * bool(titles)
        if titles and score >= 5 and all(abs(top - f[0]) >= 10 for f in found):
            found.append((top, score, " ".join(titles), author))
    starts = [f[0] for f in found]
    if not found:
        found, starts = [(0, -1, "", "")], [0]
    elif len(found) == 1 or starts[0] < 50:
        starts[0] = 0
    ends = [*starts[1:], len(rows)]
    return [(k + 1, a, f[1], f[2], f[3], len(part := [y for y in rows[a:b] if not HEADER.search(y)]), "\n".join(part)) for k, (f, a, b) in enumerate(zip(found, starts, ends, strict=True))]


def test_issues_equal_a_loop(spark):
    rng = random.Random(9)
    rows = ["NGHIÊN CỨU KẾT CỤC ĐIỀU TRỊ BỆNH", "VÀ CÁC YẾU TỐ LIÊN QUAN ĐẾN TỬ VONG", "Nguyễn Văn An1, Trần Thị Bé2", "TÓM TẮT", "I. ĐẶT VẤN ĐỀ", "ABSTRACT", "TẠP CHÍ Y HỌC", "", "KẾT QUẢ", "một dòng thường của bài báo này", "dòng khác không có số", "x"]
    bodies = ["\n".join(rng.choices(rows, weights=[3, 2, 3, 3, 1, 1, 1, 2, 1, 9, 9, 4], k=rng.randrange(120))) for _ in range(250)] + ["", "một dòng"]
    df = spark.createDataFrame(list(enumerate(bodies)), "i int, body string")
    got = {}
    for r in S.split_issues(df).collect():
        got.setdefault(r.i, []).append(tuple(r)[1:])
    want = {i: plain_issue(b) for i, b in enumerate(bodies)}
    assert {i: sorted(x) for i, x in got.items()} == want and sum(len(w) > 1 for w in want.values()) > 50
    for i, w in want.items():  # each line in one article, header lines in none
        assert sum(x[5] for x in w) == sum(not HEADER.search(y) for y in bodies[i].splitlines()[w[0][1] :])


# ------------------------------------------------------------------ rewriting
def key(t):
    return re.sub(r"\s+", " ", re.sub(r"[^\w\s]", " ", t.lower())).strip()


def says(p, t):
    p, t = key(p), key(t)
    words = [w for w in p.split() if len(w) > 1]
    return p in t or not words or sum(w in t.split() for w in words) / len(words) >= 0.8


def plain_cover(truth, concepts):
    sentences = [s.strip() for s in re.split(r"(?<=[.!?])\s+", truth.strip()) if s.strip()]
    left, taken = list(range(len(concepts))), []
    while left:
        gains = [sum(says(concepts[c], s) for c in left) for s in sentences]
        best = max(range(len(sentences)), key=lambda i: (gains[i], -i), default=None)
        if best is None or not gains[best]:
            break
        taken.append(best)
        left = [c for c in left if not says(concepts[c], sentences[best])]
    return " ".join(sentences[i] for i in sorted(taken)) if taken else truth.strip()


def test_covers_equal_a_loop(spark):
    rng = random.Random(10)
    words = "an bo co du em fa go hi if jo".split()
    rows = [(i, " ".join(" ".join(rng.choice(words) for _ in range(rng.randrange(1, 8))) + rng.choice(".!? ") for _ in range(rng.randrange(12))),
             [" ".join(rng.choice(words) for _ in range(rng.randrange(1, 4))) for _ in range(rng.choice((0, 1, 3, 9, 80)))]) for i in range(150)]
    rows += [(900, "", ["x"]), (901, "  one. ", ["zz"]), (902, "a. b.", []), (903, "one. two.", [""])]
    df = spark.createDataFrame(rows, "i int, t string, c array<string>").repartition(3)
    got = {r.i: r for r in df.select("i", W.greedy_cover(F.col("t"), F.col("c")).alias("x"), F.round(W.phrase_coverage(F.col("c"), F.col("t")), 6).alias("share")).collect()}
    for i, t, c in rows:
        assert got[i].x == plain_cover(t, c), (t, c)
        assert got[i].share == (round(sum(says(x, t) for x in c) / len(c), 6) if c else 1.0)


def test_short_answers(spark):
    rows = [("a b.", "long one here. cc dd", ["cc dd"], True), ("short", "truth says alpha. beta too.", ["alpha", "beta"], True), ("kept ", "x", ["y"], False), ("", "no concept", ["zz"], True)]
    df = spark.createDataFrame(rows, "s string, t string, c array<string>, few boolean")
    got = [r.x for r in df.select(W.choose_short_answer(F.col("s"), F.col("t"), F.col("c"), F.col("few")).alias("x")).collect()]
    assert [(r.answer, r.strategy.split("_")[0]) for r in got] == [("cc dd", "ground"), ("short; alpha; beta.", "append"), ("kept", "kept"), ("zz.", "append")]
    x = spark.createDataFrame([(["A b", "a  B", "c", "d"], ["c"])], "c array<string>, m array<string>").select(W.supported_concepts(F.col("c"), F.col("m"), F.lit(True)).alias("x")).first().x
    assert (x.kept, x.removed) == (["A b", "d"], ["c"])


def test_fixed_values_are_whole():
    assert [len(x) for x in (L.NOISE_LINES, L.HEADING_LINES, S.PROCEDURE_ANCHORS, S.SUBSECTION_NAMES, S.ADMIN_LINES, S.ARTICLE_HEADINGS)] == [7, 11, 11, 20, 31, 14]
    assert pytest.approx(len(L.SPACES)) == len([c for c in map(chr, range(0x3001)) if c.isspace()])


def test_resolved_titles(spark):
    rows = [("A good plain title", "", "", "", "http://m", "", ("A good plain title", "http://m")), ("pdf", "http://u", "12/03/2020\nA heading of the body\nx", "A manifest title", "http://m", "", ("A heading of the body", "http://u")),
            ("pdf", "", "short", "A manifest title", "http://m/a", "own", ("A manifest title", "http://m/a")), ("pdf", "http://u/some_long-slug.html", "", "pdf", None, "own", ("some long slug", "http://u/some_long-slug.html")),
            ("pdf", "", "", None, None, " Own title ", ("Own title", "")), ("pdf", None, None, None, None, None, ("pdf", "")), (None, None, None, None, None, None, ("", ""))]
    df = spark.createDataFrame([(i, *r[:6]) for i, r in enumerate(rows)], "i int, t string, u string, b string, mt string, mu string, o string")
    got = {r.i: tuple(r.x) for r in df.select("i", Q.resolved(*[F.col(c) for c in ("t", "u", "b", "mt", "mu", "o")]).alias("x")).collect()}
    assert got == {i: r[6] for i, r in enumerate(rows)}
    assert [len(x) for x in (Q.STUB_MARKERS, Q.OFFICE_PARTS, Q.WRAPPER_TITLES)] == [5, 8, 3]
