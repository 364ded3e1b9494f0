"""The answer chain and article groups over the records; the SQL holds its own lists."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import answering as A
from ..operators import articles as R
from .registry import REC, records, register
from .text_queries import first_distinct, fold, grams, joined, quoted, sq, terms, title_norm

ASKED = [
    "CEA và CAS ở người già?", "thoái hóa khớp gối", "tỷ lệ bao nhiêu phần trăm", "vì sao theo dõi sau mổ", "thiết kế nghiên cứu, cỡ mẫu, methods", "what about this", "guideline dose 5 %",
    "Karnofsky duy trì phổ biến nhất", "sepsis và đái tháo đường, xơ vữa động mạch. yếu tố nguy cơ", "benh vien da khoa trung uong de ", "ghép thận MRI", "",
]
SECTIONS = ["Kết quả", "Đối tượng và phương pháp", "Methods", "Bàn luận", "Tóm tắt", ""]
SAID = ["Title: x", "Karnofsky 70% duy trì, phổ biến nhất", "tacrolimus và theo dõi tái hẹp", "RCT, 95% CI or (1) 123456789012", "cohort mô tả cắt ngang", "sepsis; can thiệp sớm, đái tháo đường", ""]
STYLES, QTYPES = ["exact", "summary", "bounded_partial", "open"], ["teaching_explainer", "comparative_synthesis", "fact_extraction"]
POLICIES, COVERS, LEVELS = ["strict_rag", "open_enriched", "strict_rag"], ["evidence_strong", "title_anchored", "open_knowledge", "evidence_strong"], ["high", "medium", "low"]
URLS = ["https://www.who.int/x", "https://example.org/nih", "http://kcb.vn/a", "HTTPS://NICE.ORG.UK", ""]
CEILINGS, PARTS = ["high", "moderate", "low"], ["", "sample_size", "sample_size|limitations"]


def _at(values: list[str], n: int):
    return F.element_at(F.array(*[F.lit(v) for v in values]), (F.floor(F.col("doc_id") / n) % len(values) + 1).cast("int"))


def _sql(values: list[str], n: int) -> str:
    return f"{quoted(values)}[(doc_id // {n} % {len(values)} + 1)::INT]"


def _has(x: str, marks: list[str]) -> str:
    return "(" + " OR ".join("contains({}, '{}')".format(x, m.replace("'", "''")) for m in marks) + ")"


def _case(*rules: tuple[str, float]) -> str:
    return " + ".join(f"CASE WHEN {r} THEN {p} ELSE 0 END" for r, p in rules)


_COLUMNS = {"asked": (ASKED, 1), "section": (SECTIONS, 2), "said": (SAID, 3), "style": (STYLES, 1), "query_type": (QTYPES, 2), "policy": (POLICIES, 1), "cover": (COVERS, 3), "level": (LEVELS, 1), "url": (URLS, 1), "ceiling": (CEILINGS, 2), "parts": (PARTS, 3)}
_Q = f"""{REC}, q0 AS (SELECT doc_id, title, body, source_name, trust_tier, {', '.join(f'{_sql(v, n)} AS {k}' for k, (v, n) in _COLUMNS.items())} FROM rec),
q AS (SELECT *, asked || ' ' || substring(body, 20, 60) AS query, body || chr(10) || said AS text, CASE WHEN parts = '' THEN []::VARCHAR[] ELSE string_split(parts, '|') END AS missing FROM q0)"""


def _asked(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = records(spark, sf_dir).select("doc_id", "title", "body", "source_name", "trust_tier", *[_at(v, n).alias(k) for k, (v, n) in _COLUMNS.items()])
    return at.withColumns({"query": F.concat(F.col("asked"), F.lit(" "), F.substring("body", 20, 60)), "text": F.concat_ws("\n", "body", "said"),
                           "missing": F.when(F.col("parts") == "", F.array().cast("array<string>")).otherwise(F.split("parts", r"\|"))})


def _words(x: str) -> str:
    return f"(' ' || regexp_replace({x}, '[^\\p{{L}}\\p{{M}}\\p{{N}}_]+', ' ', 'g') || ' ')"


_W = lambda t: f"contains({_words(fold('query'))}, ' {t} ')"


@register("c27_h05_expand_query", f"""WITH {_Q}, e AS (SELECT doc_id, trim(regexp_replace(query, '^\\s+|\\s+$', '', 'g')) AS t, list_filter([
  CASE WHEN {_W('cea')} AND {_W('cas')} THEN 'hep dong mach canh ngoai so carotid endarterectomy carotid artery stenting' END,
  CASE WHEN {_W('pieb')} AND {_W('cei')} THEN 'gay te ngoai mang cung chuyen da epidural labor analgesia' END,
  CASE WHEN contains({fold('query')}, 'thoai hoa khop') THEN 'osteoarthritis elderly early intervention symptom relief disease progression' END], lambda x: x IS NOT NULL) AS h FROM q)
SELECT doc_id, CASE WHEN t = '' OR len(h) = 0 THEN t ELSE t || ' ' || array_to_string(h, ' ') END AS value FROM e""")
def c27(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _asked(spark, sf_dir).select("doc_id", A.expand_query(F.col("query")).alias("value"))


_NUM = ["bao nhiêu", "bao nhieu", "tỷ lệ", "ty le", "phần trăm", "phan tram", "karnofsky", "auc", " hr ", " or ", " rr ", " ci ", " điểm ", " diem "]
_WHY = ["vì sao", "vi sao", "tại sao", "tai sao", "dựa trên", "dua tren", "nhóm yếu tố", "nhom yeu to", "quyết định", "quyet dinh"]
_FOC = ["chỉ số", "chi so", "tiêu chí", "tieu chi"]
_MET = ["thiết kế", "thiet ke", "đối tượng", "doi tuong", "phương pháp", "phuong phap", "cỡ mẫu", "co mau", "chọn mẫu", "chon mau"]
_EXT = ["guideline", "hướng dẫn", "huong dan", "khuyến cáo", "khuyen cao", "liều", "lieu", "phác đồ", "phac do", "protocol", "regimen", "tỷ lệ", "ty le", "%", "auc", "or", "hr", "rr", "ci", "tiêu chuẩn", "tieu chuan", "chẩn đoán", "chan doan"]
_REFD = ["it", "this", "that", "those", "they", "them", "its", "their", "what about", "how about", "and", "also", "too", "else", "more", "the same", "similar"]
_DOM = ["who.int", "ncbi.nlm.nih.gov", "nih.gov", "cdc.gov", "msdmanuals.com", "mayoclinic.org", "nice.org.uk", "escardio.org", "heart.org", "moh.gov.vn", "kcb.vn"]
_OPEN = "(policy = 'open_enriched' OR cover IN ('open_knowledge', 'title_anchored'))"
_NW = r"len(list_filter(regexp_split_to_array({}, '\s+'), lambda w: w <> ''))"


@register("f41_f46_h22_h29_h36_h37_decisions", f"""WITH {_Q} SELECT doc_id, {_has('lower(query)', _NUM)} AS asks_number, {_OPEN} AND ({_has('lower(asked)', _EXT)} OR (trust_tier = 1 AND doc_id % 2 = 1)) AS needs_external, {_has('lower(url)', _DOM)} AS trusted,
  {_OPEN} AS needs_plan, doc_id % 3 > 0 AND ({_NW.format('lower(asked)')} <= 5 OR {_has('lower(asked)', _REFD)}) AS needs_rewriting,
  style = 'exact' OR query_type = 'teaching_explainer' OR (style IN ('summary', 'bounded_partial') AND {_has('lower(query)', _WHY)}) AS expands,
  CASE WHEN style = 'exact' THEN CASE WHEN {_has('lower(query)', _MET)} THEN 10 ELSE 8 END WHEN {_has('lower(query)', _WHY + _FOC)} THEN 8 ELSE 6 END AS chunks,
  level = 'low' OR (len(missing) > 0 AND level <> 'high') OR (doc_id % 5 = 0 AND section = '') AS disclaimer,
  style <> 'open' AND query_type IN ('comparative_synthesis', 'guideline_comparison', 'teaching_explainer', 'professional_explainer') AS secondary FROM q""")
def decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col
    gap = F.when(c("doc_id") % 5 == 0, F.array(F.lit("x"))).otherwise(F.array().cast("array<string>"))
    return _asked(spark, sf_dir).select(
        "doc_id", A.asks_number(c("query")).alias("asks_number"), A.needs_external(c("asked"), c("policy"), c("cover"), c("trust_tier") == 1, c("doc_id") % 2, True).alias("needs_external"),
        A.trusted_domain(c("url")).alias("trusted"), A.needs_plan(c("policy"), c("cover")).alias("needs_plan"), A.needs_rewriting(c("asked"), c("doc_id") % 3).alias("needs_rewriting"),
        A.expands_primary(c("style"), c("query_type"), c("query")).alias("expands"), A.expansion_chunks(c("style"), c("query")).alias("chunks"),
        A.opening_disclaimer(c("level"), c("missing"), gap, c("section")).alias("disclaimer"),
        A.includes_secondary(F.when(c("style") == "open", "article_centric").otherwise("hybrid"), c("query_type")).alias("secondary"))


_RISK = (r"(?i)([0-9]+[.,]?[0-9]*\s*%|p\s*[<>=]|(?:^|[^\p{L}\p{N}_])(?:OR|HR|RR|AUC)(?:[^\p{L}\p{N}_]|$)|dose|liều\s+(?:thuốc|dùng|dung|khuyến\s+cáo|khuyen cao|điều\s+trị|dieu tri)|"
         r"lieu\s+(?:thuoc|dung|khuyen cao|dieu tri)|phác\s+đồ|phac do|guideline|hướng\s+dẫn|huong dan|khuyến\s+cáo|khuyen cao)")


@register("f43_needs_check", f"""WITH {_Q} SELECT doc_id, cover <> 'evidence_strong' OR policy = 'open_enriched' OR doc_id % 7 = 0 OR {_NW.format('text')} > 800 OR regexp_matches(text, '{_RISK}') AS value FROM q""")
def f43(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _asked(spark, sf_dir).select("doc_id", A.needs_check(F.col("text"), F.col("cover"), F.col("policy"), F.col("doc_id") % 7 == 0).alias("value"))


_STOP = ["the", "and", "for", "with", "that", "this", "from", "trong", "theo", "cua", "của", "mot", "một", "sau", "bao", "nhieu", "nhiêu", "la", "là", "nao", "nào", "duoc", "được", "nhu", "như", "thế", "co", "có", "gi", "gì"]
_EV = f"list_filter(regexp_extract_all({fold('query')}, '[\\p{{L}}\\p{{M}}\\p{{N}}_]+'), lambda w: len(w) >= 3 AND NOT list_contains({quoted(_STOP)}, w))"
_EP = f"({first_distinct('list_concat(' + grams('ev', 3) + ', ' + grams('ev', 2) + ')')})[:12]"


@register("h24_h25_evidence_terms", f"WITH {_Q}, v AS (SELECT doc_id, {_EV} AS ev FROM q) SELECT doc_id, array_to_string(ev, '|') AS tokens, array_to_string({_EP}, '|') AS phrases FROM v")
def h24(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _asked(spark, sf_dir).select("doc_id", F.array_join(A.evidence_tokens(F.col("query")), "|").alias("tokens"), F.array_join(A.evidence_phrases(F.col("query")), "|").alias("phrases"))


_DESIGN = ["thiet ke", "doi tuong", "phuong phap", "co mau", "chon mau", "study design", "sample size", "materials and methods", "methods"]
_DSENT = ["mo ta cat ngang", "nghien cuu mo ta", "tien cuu", "hoi cuu", "chon mau", "co mau", "phuong phap chon mau", "cross-sectional", "cohort", "case control", "thu nghiem", "ngau nhien"]
_DSEC = ["doi tuong", "phuong phap", "materials and methods", "methods", "subjects and methods"]
_KW = lambda x: f"list_filter(list_distinct(string_split({title_norm(x)}, ' ')), lambda w: len(w) > 1)"


def _both(a: str) -> tuple[str]:
    return f"contains(qf, '{a}') AND contains(tf, '{a}')"


@register("c12_sentence_score", f"""WITH {_Q}, v AS (SELECT doc_id, {_EV} AS ev, {fold('query')} AS qf, {fold('text')} AS tf, {fold('section')} AS sf, text, len(list_intersect({_KW('query')}, {_KW('text')})) AS overlap FROM q)
SELECT doc_id, CASE WHEN {_has('tf', ['title:', 'source:', 'audience:', 'body:', 'keywords:'])} THEN -1.0 ELSE round((overlap * 1.5 + coalesce(list_sum(list_transform({_EP}, lambda p: CASE WHEN contains(tf, p) THEN CASE WHEN len(string_split(p, ' ')) >= 3 THEN 2.0 ELSE 1.2 END ELSE 0 END)), 0) + {_case(
    ("doc_id % 2 = 0 AND regexp_matches(text, '[0-9]')", 2.0), (_both('karnofsky'), 3.0), (_both('duy tri'), 1.5), (_both('pho bien nhat'), 2.0), (f"{_has('qf', _DESIGN)} AND {_has('tf', _DSENT)}", 3.0),
    (_has('sf', ['ket qua', 'ket luan', 'tom tat']), 0.8), (f"{_has('qf', _DESIGN)} AND {_has('sf', _DSEC)}", 2.2))})::DOUBLE, 6) END::DOUBLE AS score FROM v""")
def c12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _asked(spark, sf_dir).select("doc_id", A.sentence_score(F.col("text"), F.col("query"), F.col("section"), F.col("doc_id") % 2 == 0).cast("double").alias("score"))


_GROUP = ["dua tren", "nhom yeu to", "quyet dinh", "theo doi"]
_DTEXT = ["mo ta cat ngang", "nghien cuu mo ta", "tien cuu", "hoi cuu", "chon mau", "co mau", "phuong phap chon mau", "doi tuong va phuong phap", "materials and methods", "study design", "cross-sectional", "cohort", "case control"]
_DIG = r"len(regexp_replace(text, '[^\p{Nd}]', '', 'g'))"
_PH = f"({first_distinct('list_concat(' + grams('qt', 3) + ', ' + grams('qt', 2) + ')')})[:12]"


@register("c07_same_article_bonus", f"""WITH {_Q}, v AS (SELECT doc_id, {terms('query')} AS qt, list_distinct(list_transform(list_filter(regexp_extract_all(query, '[\\p{{L}}\\p{{M}}\\p{{N}}_]+'), lambda w: regexp_full_match(w, '[A-Z][A-Z0-9]{{1,6}}')), lambda w: lower(w))) AS ac,
  {fold('query')} AS qf, {fold('text')} AS tf, {fold('section')} AS sf, {_words(fold('text'))} AS tw, {_words(fold("title || ' ' || source_name"))} AS mw, text FROM q)
SELECT doc_id, round((least(len(list_filter(qt, lambda t: contains(tw, ' ' || t || ' '))) * 0.18, 1.1) + least(len(list_filter(qt, lambda t: contains(mw, ' ' || t || ' '))) * 0.06, 0.24)
  + CASE WHEN len(ac) > 0 THEN 0.45 * len(list_filter(ac, lambda t: contains(tw, ' ' || t || ' '))) / len(ac) ELSE 0 END
  + coalesce(list_sum(list_transform({_PH}, lambda p: CASE WHEN contains(tf, p) THEN CASE WHEN len(string_split(p, ' ')) >= 3 THEN 0.3 ELSE 0.18 END ELSE 0 END)), 0) + {_case(
    (f"{_has('qf', ['bao nhieu', 'ty le', 'phan tram', 'diem'])} AND {_DIG} > 0", 0.35), (_both('karnofsky'), 0.9), (f"contains(qf, 'ghep than') AND {_has('tf', ['rifampicin', 'tacrolimus', 'cyclosporine', 'thai ghep'])}", 2.0),
    (f"{_has('qf', ['cea', 'cas'])} AND {_has('tf', ['cea', 'cas'])}", 0.9), (_both('chat luong song'), 0.6), (_both('hoi phuc'), 0.5), (_both('van dong'), 0.45),
    (f"{_has('qf', ['theo doi', 'noi khoa toi uu', 'nguy co tim mach'])} AND {_has('tf', ['theo doi', 'noi khoa', 'nguy co tim mach', 'tai hep', 'dot quy'])}", 1.8),
    (f"{_has('qf', _GROUP)} AND {_has('tf', ['theo doi sau mo', 'theo doi', 'noi khoa ho tro', 'kiem soat huyet ap', 'roi loan lipid mau', 'tai hep', 'dot quy'])}", 1.2),
    (_has('sf', ['ket qua', 'tom tat', 'summary']), 0.15), (f"{_has('qf', _DESIGN)} AND {_has('sf', _DSEC)}", 1.8), (f"{_has('qf', _DESIGN)} AND {_has('tf', _DTEXT)}", 1.4),
    (f"{_has('qf', _DESIGN)} AND {_has('sf', ['ket qua', 'ban luan', 'discussion'])}", -0.25), (_has('tf', ['title:', 'source:', 'audience:', 'keywords:']), -0.35),
    (f"{_has('qf', _GROUP)} AND {_DIG} >= 12 AND {_has('tf', ['rct', '95% ci', 'or (', 'tv/dq', 'nmct'])}", -1.8))})::DOUBLE, 4) + 0.0 AS bonus FROM v""")
def c07(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col
    return _asked(spark, sf_dir).select("doc_id", A.same_article_bonus(c("query"), c("text"), c("section"), F.concat_ws(" ", "title", "source_name")).alias("bonus"))


_TXT = rf"""regexp_split_to_array({sq(r"regexp_replace(lower(regexp_replace(text, '^\s+|\s+$', '', 'g')), '[\"''\[\](){}?!,;:…]', ' ', 'g')")}, ' ')"""


def _known(n: int, values: list[str]) -> str:
    return f"list_filter({grams('w', n)}, lambda g: list_contains({quoted(values)}, g))"


@register("c14_h23_concepts", f"""WITH {_Q}, v AS (SELECT doc_id, {_TXT} AS w FROM q), c AS (SELECT doc_id, {first_distinct(f"list_concat({_known(2, A.COMPOUNDS)}, {_known(3, A.TRIPLES)}, list_filter(w, lambda x: list_contains({quoted(['sepsis', 'overdiagnosis', 'overtreatment', 'checkpoint', 'frailty', 'burnout', 'vaccine', 'apoptosis', 'cytokine', 'biomarker', 'pathway'])}, x)))")} AS f FROM v)
SELECT doc_id, array_to_string(f, '|') AS concepts, array_to_string(list_filter(f, lambda x: NOT list_contains({quoted(['can thiệp', 'yếu tố', 'quyết định', 'theo dõi', 'điều trị', 'chẩn đoán', 'kết quả', 'thời gian', 'kiểm soát', 'chất lượng'])}, x)), '|') AS specific FROM c""")
def c14(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = _asked(spark, sf_dir).select("doc_id", A.concepts(F.col("text")).alias("f"))
    return at.select("doc_id", F.array_join("f", "|").alias("concepts"), F.array_join(A.specific_concepts(F.col("f")), "|").alias("specific"))


_FSTOP = ["the", "and", "for", "with", "that", "this", "from", "into", "trong", "nhung", "những", "theo", "giua", "giữa", "cua", "của", "mot", "một", "khong", "không", "dua", "dựa", "tren", "trên", "nghien", "nghiên", "cuu", "cứu", "benh", "bệnh", "nhan", "nhân"]


@register("h31_extractive_terms", f"""WITH {_Q}, v AS (SELECT doc_id, list_filter(list_distinct(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{M}}\\p{{N}}_]+')), lambda w: len(w) >= 4 AND NOT list_contains({quoted(_FSTOP)}, w)) AS t FROM q)
SELECT doc_id, len(t)::BIGINT AS n, coalesce(list_min(t), '') AS least, coalesce(list_max(t), '') AS most FROM v""")
def h31(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = _asked(spark, sf_dir).select("doc_id", A.extractive_terms(F.col("text")).alias("t"))
    return at.select("doc_id", F.size("t").cast("long").alias("n"), F.coalesce(F.array_min("t"), F.lit("")).alias("least"), F.coalesce(F.array_max("t"), F.lit("")).alias("most"))


@register("h35_o07_wording", f"""WITH {_Q}, m AS (SELECT *, array_to_string(missing, ', ') AS p FROM q) SELECT doc_id, CASE level WHEN 'high' THEN 'Dữ liệu ĐẦY ĐỦ. Trả lời chi tiết dựa hoàn toàn trên evidence.'
  WHEN 'medium' THEN 'Dữ liệu CÓ nhưng THIẾU một số phần.' || CASE WHEN p <> '' THEN ' Nói rõ: ''' || p || ''' không có trong tài liệu.' ELSE '' END
  ELSE 'Dữ liệu KHÔNG ĐỦ. Phải nói rõ giới hạn.' || CASE WHEN p <> '' THEN ' Đặc biệt thiếu: ' || p || '.' ELSE '' END END
  || CASE ceiling WHEN 'moderate' THEN ' MỨC CHẮC CHẮN: TRUNG BÌNH. Dùng ngôn ngữ thận trọng ("có thể", "gợi ý", "cần thêm nghiên cứu").' WHEN 'low' THEN ' MỨC CHẮC CHẮN: THẤP. Dùng ngôn ngữ rất dè dặt. Nêu rõ bằng chứng yếu.' ELSE '' END
  || CASE WHEN p <> '' THEN ' Thiếu: ' || p || '. Nói rõ phần nào chưa có trong tài liệu.' ELSE '' END AS instruction,
  CASE WHEN {_OPEN} THEN 'Kết luận trực tiếp|Giải thích nền tảng|Phân tích chuyên sâu|Bằng chứng từ tài liệu truy hồi|Ý nghĩa thực hành và lưu ý an toàn#' || query || '#' || array_to_string(missing, '|') ELSE '##' END AS plan FROM m""")
def h35(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col
    at = _asked(spark, sf_dir).withColumn("p", A.answer_plan(c("query"), c("policy"), c("cover"), c("missing")))
    plan = F.concat_ws("#", F.array_join("p.sections", "|"), F.array_join("p.must_cover", "|"), F.array_join("p.open_knowledge_topics", "|"))
    return at.select("doc_id", A.coverage_instruction(c("level"), c("ceiling"), c("missing"), c("missing")).alias("instruction"), plan.alias("plan"))


_CUT = "p"
for _m in [" tap trung", " nghien cuu", " danh gia", " su dung", " de ", " nhung ", " ket qua", " hieu qua"]:
    _CUT = f"trim(split_part({_CUT}, '{_m}', 1))"
_INST = ["benh vien [a-z0-9 ]{4,80}", "truong dai hoc [a-z0-9 ]{4,80}", "dai hoc y(?: khoa| duoc)? [a-z0-9 ]{2,80}"]


@register("t33_institutions", f"""WITH {_Q}, v AS (SELECT doc_id, list_filter(list_transform(list_concat({', '.join(f"regexp_extract_all({title_norm('query')}, '{p}')" for p in _INST)}),
  lambda p: regexp_replace({sq(_CUT.replace('split_part(p,', 'split_part(trim(p),', 1))}, '^[ ,.;:\\-]+|[ ,.;:\\-]+$', '', 'g')), lambda p: len(string_split(p, ' ')) >= 3) AS f FROM q) SELECT doc_id, array_to_string(({first_distinct('f')})[:4], '|') AS value FROM v""")
def t33(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _asked(spark, sf_dir).select("doc_id", F.array_join(A.institutions(F.col("query")), "|").alias("value"))


@register("w07_o09_fallback_answer")
def fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    """W07 and O09 over whole bodies; held against brute force in tests."""
    c = F.col
    at = _asked(spark, sf_dir).withColumn("w", A.answer_windows(c("text")))
    return at.select("doc_id", F.size("w").alias("windows"), A.fallback_answer(c("query"), c("section"), c("title"), F.array(c("said")), F.lit(""), c("text"), c("w")).alias("answer"))


@register("h32_h33_evidence", f"""WITH {_Q} SELECT doc_id, title || chr(10) || body || CASE WHEN said = '' THEN '' ELSE chr(10) || said END || chr(10) || 'second' || CASE WHEN doc_id % 2 = 0 THEN chr(10) || 'outside' || chr(10) || 'http://x' ELSE '' END AS text,
  CASE WHEN title <> '' OR body <> '' THEN 1 ELSE 0 END + 1 AS n FROM q WHERE title <> '' AND body <> ''""")
def h32(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, e = F.col, F.lit("")
    at = _asked(spark, sf_dir).where("title <> '' AND body <> ''")
    found, second = F.array(F.struct(c("said").alias("claim"), e.alias("span"))), F.array(F.struct(F.lit("second").alias("title"), e.alias("raw")))
    out = F.filter(F.array(F.struct(F.lit("outside").alias("title"), e.alias("snippet"), F.lit("http://x").alias("url"))), lambda _: c("doc_id") % 2 == 0)
    return at.select("doc_id", A.evidence_text(c("title"), c("body"), found, second, out).alias("text"), A.source_count(c("title"), c("body"), second).alias("n"))


@register("f18_payload", f"WITH {_Q} SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'nested' ELSE title END AS title, CASE WHEN doc_id % 3 = 0 THEN 1 ELSE 2 END AS n FROM q")
def f18(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = F.create_map(F.lit("title"), "title", F.lit("doc_id"), F.col("doc_id").cast("string"), F.lit("secret"), F.lit("x"))
    at = _asked(spark, sf_dir).withColumn("m", A.payload_metadata(F.when(F.col("doc_id") % 3 == 0, F.create_map(F.lit("other"), F.lit("x"))).otherwise(own), F.create_map(F.lit("title"), F.lit("nested"))))
    return at.select("doc_id", F.col("m")["title"].alias("title"), F.size("m").alias("n"))


# ------------------------------------------------------------------ article groups
def _chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as chunks: seven to an article id at most, some without, some with the address of an old issue."""
    c = F.col
    return records(spark, sf_dir).select(
        c("doc_id").cast("string").alias("chunk_id"), c("doc_id").alias("pos"), "title", "source_name", c("body").alias("text"), "trust_tier",
        F.when(c("doc_id") % 3 == 0, F.floor(c("doc_id") / 7).cast("string")).otherwise("").alias("article_id"), F.when(c("doc_id") % 3 == 1, F.floor(c("doc_id") / 5).cast("string")).otherwise("").alias("doc_id"),
        F.when(c("doc_id") % 4 == 0, "http://j/issue/view/3").otherwise("").alias("source_url"))


_C = f"""{REC}, ch AS (SELECT doc_id::VARCHAR AS chunk_id, doc_id AS pos, title, source_name, body AS text, trust_tier, CASE WHEN doc_id % 3 = 0 THEN (doc_id // 7)::VARCHAR ELSE '' END AS article_id,
  CASE WHEN doc_id % 3 = 1 THEN (doc_id // 5)::VARCHAR ELSE '' END AS doc_id, CASE WHEN doc_id % 4 = 0 THEN 'http://j/issue/view/3' ELSE '' END AS source_url FROM rec)"""
_KEY = f"""CASE WHEN article_id <> '' THEN 'article:' || article_id WHEN {title_norm('title')} <> '' AND NOT (len(trim(title)) < 15 OR regexp_matches(trim(title), '^\\p{{Ll}}')) AND contains(source_url, '/issue/view/')
  THEN 'legacy-title:' || CASE WHEN {title_norm("coalesce(source_name, '')")} <> '' THEN {title_norm('source_name')} || ':' ELSE '' END || {title_norm('title')} WHEN doc_id <> '' THEN 'doc:' || doc_id WHEN {title_norm('title')} <> '' THEN 'title:' || {title_norm('title')} ELSE '_unknown_' || left(chunk_id, 8) END"""


def _keyed(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col
    return _chunks(spark, sf_dir).withColumn("article_key", R.group_key(c("chunk_id"), c("title"), c("source_name"), c("source_url"), c("article_id"), c("doc_id")))


@register("a21_group_key", f"WITH {_C} SELECT chunk_id, {_KEY} AS article_key FROM ch")
def a21(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _keyed(spark, sf_dir).select("chunk_id", "article_key")


@register("f17_candidate_chunks", f"""WITH {_C}, w AS (SELECT * FROM ch WHERE pos % 50 = 0) SELECT DISTINCT w.chunk_id AS candidate, ch.chunk_id FROM w JOIN ch ON (w.article_id <> '' AND ch.article_id = w.article_id)
  OR (w.doc_id <> '' AND ch.doc_id = w.doc_id) OR (w.title <> '' AND ch.title = w.title AND (coalesce(w.source_name, '') = '' OR ch.source_name = w.source_name))""")
def f17(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = _chunks(spark, sf_dir)
    return R.candidate_chunks(at.where("pos % 50 = 0").withColumn("candidate", F.col("chunk_id")), at)


@register("j13_identity_chunks", f"""WITH {_C}, w AS (SELECT * FROM ch WHERE pos % 50 = 0), h AS (SELECT w.chunk_id AS candidate, ch.chunk_id, CASE WHEN w.article_id <> '' AND ch.article_id = w.article_id THEN 0 WHEN w.doc_id <> '' AND ch.doc_id = w.doc_id THEN 1
  WHEN w.title <> '' AND coalesce(w.source_name, '') <> '' AND ch.title = w.title AND ch.source_name = w.source_name THEN 2 WHEN w.title <> '' AND ch.title = w.title THEN 3 END AS rung FROM w JOIN ch ON ch.article_id = w.article_id OR ch.doc_id = w.doc_id OR ch.title = w.title)
SELECT candidate, chunk_id, rung FROM h WHERE rung IS NOT NULL QUALIFY rung = min(rung) OVER (PARTITION BY candidate)""")
def j13(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = _chunks(spark, sf_dir)
    return R.identity_chunks(at.where("pos % 50 = 0").withColumn("candidate", F.col("chunk_id")), at)


@register("j14_article_chunks", f"""WITH {_C}, k AS (SELECT *, {_KEY} AS article_key FROM ch), a AS (SELECT article_key, round(count(*) / 10.0, 4)::DOUBLE AS score FROM k GROUP BY 1)
SELECT article_key, chunk_id, round((0.62 + score)::DOUBLE, 6) AS chunk_rank_score, row_number() OVER (PARTITION BY article_key ORDER BY pos % 9, chunk_id)::INT AS rank FROM k JOIN a USING (article_key) WHERE trim(text) <> '' QUALIFY rank <= 3""")
def j14(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = _keyed(spark, sf_dir)
    found = at.groupBy("article_key").agg(F.round(F.count(F.lit(1)) / 10.0, 4).alias("score")).withColumn("query_id", F.lit(0))
    return R.article_chunks(found, at, 1.0 / (2 + F.col("pos") % 9)).select("article_key", "chunk_id", "chunk_rank_score", "rank")


def _article_rows(keyed: DataFrame, text) -> DataFrame:
    c = F.col
    one = F.struct("pos", "title", F.lit("").alias("section_title"), F.lit("").alias("heading_path"), F.lit("").alias("canonical_title"), F.coalesce("source_name", F.lit("")).alias("source_id"), F.lit("").alias("institution"),
                   text.alias("text"), F.when(c("pos") % 2 == 0, c("trust_tier")).alias("trust_tier"), F.lit("").alias("doc_type"), "doc_id", "article_id")
    return keyed.groupBy("article_key").agg(F.sort_array(F.collect_list(one)).alias("chunks")).withColumn("title", F.col("chunks")[0]["title"])


def _article_sql(where: str) -> str:
    return f"""{_C}, k AS (SELECT *, {_KEY} AS article_key, title || CASE WHEN title <> '' AND coalesce(source_name, '') <> '' THEN ' ' ELSE '' END || coalesce(source_name, '') AS m FROM ch{where}),
ar AS (SELECT article_key, list(m ORDER BY pos) AS ms, list(text ORDER BY pos) AS ts, list(title ORDER BY pos)[1] AS title, list(CASE WHEN pos % 2 = 0 THEN trust_tier END ORDER BY pos) AS tiers FROM k GROUP BY article_key),
sup AS (SELECT *, array_to_string(list_filter(list_concat([title], ms), lambda x: x <> ''), ' ') AS meta FROM ar),
su AS (SELECT *, array_to_string(list_filter(list_concat([meta], list_transform(ts[:2], lambda t: left(t, 500))), lambda x: x <> ''), ' ') AS support, title || ' MRI' AS query FROM sup)"""


_AR = _article_sql(" WHERE article_id <> ''")


@register("h07_h12_u04_articles", f"""WITH {_AR}, s AS (SELECT *, len(list_intersect({_KW('query')}, {_KW('support')})) AS n, list_filter(tiers, lambda t: t IS NOT NULL) AS ok FROM su)
SELECT article_key, sha256(meta) AS meta_sha, sha256(support) AS support_sha, n AS support_terms, CASE WHEN contains({_words(title_norm('support'))}, ' mri ') THEN 1 ELSE 0 END AS acronyms,
  CASE WHEN len(ok) > 0 THEN ok[1] END AS tier, 'highest composite score' || CASE WHEN len(ok) > 0 AND ok[1] = 1 THEN '; authoritative source (Tier 1)' ELSE '' END || '; relevance=0.5; query_fit=+0.25' || CASE WHEN n > 0 THEN '; support_terms=' || n ELSE '' END AS reason FROM s""")
def h07(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col
    few = _keyed(spark, sf_dir).where("article_id <> ''")
    at = _article_rows(few, c("text")).withColumns({"meta": R.metadata_of(c("title"), c("chunks")), "support": R.support_text(c("title"), c("chunks")), "query": F.concat("title", F.lit(" MRI"))})
    at = at.withColumns({"n": F.size(R.support_terms(c("query"), c("support"))), "one": R.representative(c("chunks"))})
    reason = R.selected_reason(c("one"), F.lit(True), F.lit("composite"), F.lit(0.5), F.lit(0.0), F.lit(0.25), c("n"))
    return at.select("article_key", F.sha2("meta", 256).alias("meta_sha"), F.sha2("support", 256).alias("support_sha"), c("n").cast("long").alias("support_terms"),
                     R.acronym_matches(c("support"), F.array(F.lit("mri"))).alias("acronyms"), c("one.trust_tier").alias("tier"), reason.alias("reason"))


@register("f39_f40_secondary", f"""WITH {_article_sql('')}, ids AS (SELECT article_key, list_sort(list(DISTINCT doc_id)) AS ds FROM k WHERE doc_id <> '' GROUP BY article_key),
p AS (SELECT *, lag(support) OVER (ORDER BY article_key) AS before, lag(title) OVER (ORDER BY article_key) AS bt, coalesce(ds = lag(ds) OVER (ORDER BY article_key), false) AS same_ids FROM su LEFT JOIN ids USING (article_key)), x AS (SELECT *, {_KW('query')} AS kq, {_KW('support')} AS ks, {_KW('before')} AS kb FROM p WHERE before IS NOT NULL)
SELECT article_key, len(article_key) % 2 = 0 OR (len(list_intersect(kq, ks)) > 0 AND (len(list_filter(list_intersect(kq, ks), lambda t: NOT list_contains(kb, t))) > 0 OR CASE WHEN contains({_words(title_norm('support'))}, ' mri ') THEN 1 ELSE 0 END > CASE WHEN contains({_words(title_norm('before'))}, ' mri ') THEN 1 ELSE 0 END)) AS adds, (title <> '' AND title = bt) OR same_ids AS same FROM x""")
def f39(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col
    at = _article_rows(_keyed(spark, sf_dir), F.substring("text", 1, 500)).withColumns({"support": R.support_text(c("title"), c("chunks")), "query": F.concat("title", F.lit(" MRI"))})
    ids = F.transform("chunks", lambda x: F.struct(x["doc_id"].alias("doc_id"), x["article_id"].alias("article_id")))  # no texts travel
    at = R.with_previous(at.select("article_key", "title", "support", "query", ids.alias("chunks")), "article_key", {"before": "support", "bt": "title", "bc": "chunks"}).where("before IS NOT NULL")
    mode = F.when(F.char_length("article_key") % 2 == 0, "article_centric").otherwise("topic_summary")
    return at.select("article_key", R.adds_support(c("query"), mode, F.lit("x"), c("support"), c("before")).alias("adds"), R.same_article(c("title"), c("chunks"), c("bt"), c("bc")).alias("same"))


@register("j15_expand_primary")
def j15(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J15 over all articles as primary ones, every fourth chunk retrieved; held against brute force in tests."""
    at = _keyed(spark, sf_dir).withColumns({"score": F.when(F.col("pos") % 4 == 0, (F.col("pos") % 7) / 7.0), "chunk_index": F.col("pos").cast("int")})
    primary = at.where("article_id <> ''").select("article_key").distinct().withColumn("query_id", F.col("article_key"))
    return R.expand_primary(primary, at.select("article_key", "chunk_id", "text", "score", "chunk_index", "pos"), 1.0 / (2 + F.col("pos") % 9)).select("query_id", F.array_join("kept", ",").alias("kept"), "used")


@register("j17_multi_axis", f"""WITH {_C}, h AS (SELECT pos // 20 AS question, (pos % 3)::INT AS axis, chunk_id, text, round((1.0 / (2 + pos % 9))::DOUBLE, 6) AS score, sha256({sq('lower(text)')}) AS t FROM ch),
f AS (SELECT * FROM h QUALIFY row_number() OVER (PARTITION BY question, t ORDER BY axis, score DESC, chunk_id) = 1), s AS (SELECT *, sum(CASE WHEN text = '' THEN 0 ELSE greatest(1, len(text) // 4) END) OVER (PARTITION BY question ORDER BY score DESC, axis, chunk_id ROWS UNBOUNDED PRECEDING)::BIGINT AS spent FROM f)
SELECT question, axis, chunk_id, score, spent FROM s WHERE spent <= 4000""")
def j17(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = _chunks(spark, sf_dir)
    hits = at.select(F.floor(F.col("pos") / 20).alias("question"), (F.col("pos") % 3).cast("int").alias("axis"), "chunk_id", "text", F.round(1.0 / (2 + F.col("pos") % 9), 6).alias("score"))
    return R.multi_axis(hits, 4000)
