"""WARC, spelling variants and conversation structure against brute force, odd rows and the registered queries."""

import gzip
import hashlib
import heapq
import random
import re
import struct
import time
import zlib
from collections import Counter, defaultdict
from pathlib import Path

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from lexmill.llm import chat, html_extract, media, queries, spelling, structure_repair, warc

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
CLASH = "k t p n sha md5 owner least again url record key band tail longer size m0 word form root signature audit at edit role text r h e f".split()


def clashing(df):
    """A further column for each name that the operators use, where the table has none of it."""
    return df.select("*", *[F.concat(F.lit(n), F.lit(" of the user")).alias(n) for n in CLASH if n not in df.columns])


# ------------------------------------------------------------------------- WARC
def archive(spark, df, folder, **names):
    warc.write_monolithic(warc.records(df, **names), f"{folder}/whole")
    done = warc.normalise(spark, f"{folder}/whole", f"{folder}/members")
    return done, warc.read_index(spark, f"{folder}/members")


PAGES = [
    (1, "http://a/", "x" * 1000), (2, "http://b/\r\nWARC-Type: none", "x" * 1000), (9, None, "x" * 1000), (3, "u", "x" * 999), (4, "u", "x" * 999), (5, "u", None), (6, "u", ""),
    (7, "u", "a\r\n\r\nb\r\n\r\n"), (8, "u", "\r\n\r\nWARC/1.1\r\nContent-Length: 5\r\n\r\n\r\n"), (10, "u", "é\x00ß" * 400), (None, "u", "é\x00ß" * 400),
    (11, "u", "long " * 500_000), (12, "u", "same id, one text " * 90), (12, "v", "same id, one text " * 90), (12, "v", "same id, other text " * 90), (13, "u", "\r\n" * 700),
]


def test_archives_give_back_every_record(spark, tmp_path):
    df = clashing(spark.createDataFrame(PAGES, "page_id long, url string, html string"))
    done, index = archive(spark, df.repartition(3), str(tmp_path))
    assert (done.records, done.errors) == (len(PAGES), 0)
    got = warc.read_records(index).collect()
    assert len(got) == len(PAGES)
    number = lambda s: s and re.fullmatch(r"<urn:page:(-?\d*):([0-9a-f]{40})>", s)[1]
    found = Counter((number(r.record_id), r.record_type, number(r.refers_to), r.payload_bytes, r.payload_digest, None if r.payload is None else bytes(r.payload)) for r in got)
    want = Counter()
    for i, _, h in PAGES:
        b = (h or "").encode()
        owner = max(((-1 if j is None else j) for j, _, g in PAGES if (g or "").encode() == b))
        again = len(b) >= 1000 and owner > (-1 if i is None else i)
        want["" if i is None else str(i), "revisit" if again else "response", str(owner) if again else None, len(b), f"sha1:{hashlib.sha1(b).hexdigest()}", None if again else b] += 1
    assert found == want
    assert {r.url for r in got} == {"http://a/", "http://b/%0D%0AWARC-Type: none", None, "u", "v"}


def test_monolithic_files_become_members(spark, tmp_path):
    df = spark.createDataFrame([(i, "u", f"page {i} " * (i + 1)) for i in range(50)], "page_id long, url string, html string")
    _, index = archive(spark, df.coalesce(1), str(tmp_path))
    whole = next(Path(tmp_path, "whole").glob("*.gz")).read_bytes()
    first = zlib.decompressobj(31)
    first.decompress(whole)
    assert first.unused_data == b""  # one member
    rows = sorted(index.collect(), key=lambda r: r.offset)
    held = Path(re.sub("^file:/*", "/", rows[0].archive)).read_bytes()
    assert gzip.decompress(held) == gzip.decompress(whole) and len(rows) == 50
    end = 0
    for r in rows:
        assert r.offset == end
        end += r.length
        z = zlib.decompressobj(31)
        assert z.decompress(held[r.offset : end]).startswith(b"WARC/1.1\r\n") and z.eof and not z.unused_data
    assert end == len(held)
    again = warc.normalise(spark, f"{tmp_path}/members", f"{tmp_path}/again")  # members instead of one stream
    assert (again.records, again.bytes, again.errors) == (50, len(held), 0)
    assert warc.normalise(spark, f"{tmp_path}/whole", f"{tmp_path}/members").bytes == len(held) and warc.read_index(spark, f"{tmp_path}/members").count() == 50


def test_broken_archives_are_told(spark, tmp_path):
    def record(i, body, size=None):
        return f"WARC/1.0\r\nWARC-Type: resource\r\nWARC-Record-ID: <{i}>\r\nContent-Length: {len(body) if size is None else size}\r\n\r\n".encode() + body + b"\r\n\r\n"

    good = record("a", b"one") + b"\r\n" + record("b", b"t\r\n\r\nwo") + record("empty", b"")
    (tmp_path / "x").mkdir()
    (tmp_path / "x" / "1.warc.gz").write_bytes(gzip.compress(b"noise\r\n\r\nmore\r\n" + good + record("c", b"x", "many") + record("d", b"three")))
    (tmp_path / "x" / "2.warc.gz").write_bytes(gzip.compress(good + record("e", b"cut", 500)))
    (tmp_path / "x" / "3.warc.gz").write_bytes(gzip.compress(b""))
    (tmp_path / "x" / "4.warc").write_bytes(good[:-4])
    warc.normalise(spark, f"{tmp_path}/x", f"{tmp_path}/y")
    index = warc.read_index(spark, f"{tmp_path}/y")
    assert Counter(r.error for r in index.collect() if r.error) == {"bytes that belong to no record": 2, "no Content-Length": 1, "record cut off": 1}
    got = Counter((r.record_id, bytes(r.payload)) for r in warc.read_records(index).collect())
    assert got == Counter({("<a>", b"one"): 3, ("<b>", b"t\r\n\r\nwo"): 3, ("<empty>", b""): 3, ("<d>", b"three"): 1})


def test_no_pages(spark, tmp_path):
    done, index = archive(spark, spark.createDataFrame([], "page_id long, url string, html string"), str(tmp_path))
    assert not done.records and index.count() == 0 and warc.read_records(index).count() == 0


def test_query_op11(spark):
    pages = pq.read_table(f"{SF}/pages.parquet").to_pandas()
    out = {r.page_id: r for r in queries.op11_warc(spark, SF).collect()}
    bodies = {i: (h or "").encode() for i, h in zip(pages.page_id, pages.html, strict=True)}
    largest = defaultdict(int)
    for i, b in bodies.items():
        largest[b] = max(largest[b], i)
    assert set(out) == set(bodies)
    for i, b in bodies.items():
        again = len(b) >= 1000 and largest[b] != i
        assert tuple(out[i]) == (i, len(b), hashlib.sha1(b).hexdigest(), "revisit" if again else "response", largest[b] if again else None)


# --------------------------------------------------------------------- spelling
def one_edit(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1 or a == b:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    return any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute_counts(rows, drop_every=199):
    n = Counter()
    for i, t in rows:
        for w in re.findall(r"[A-Za-zÀ-ÿ]+", t or ""):
            w = re.sub("[A-Z]", lambda m: m[0].lower(), w)
            h = zlib.crc32(f"{'' if i is None else i}:{w}".encode())
            if drop_every and h % drop_every == 0:
                w = w[: h % len(w)] + w[h % len(w) + 1 :]
            n[w] += 1
    return {w: k for w, k in n.items() if len(w) >= 6 and k >= 5}


def brute_variants(n):
    near, by = defaultdict(list), defaultdict(list)
    for w in n:  # words meet under what is left without one letter, an independent way
        for x in {w, *(w[:i] + w[i + 1 :] for i in range(len(w)))}:
            by[x].append(w)
    for group in by.values():
        for a in group:
            for b in group:
                if a != b and one_edit(a, b) and b not in near[a]:
                    near[a].append(b)
    form = {}
    for w in n:
        best = min(near[w], key=lambda x: (-n[x], x), default=None)
        form[w] = best if best and n[best] >= 5 * n[w] else None
    out = {}
    for w in n:
        root = w
        while form[root]:
            root = form[root]
        out[w] = (form[w], root, n[w], len(near[w]), n[form[w]] if form[w] else None)
    return out


def rows_of(df):
    return {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in df.collect()}


def test_near_words_of_a_dense_vocabulary(spark):
    rng = random.Random(5)
    words = set()
    while len(words) < 900:
        w = "".join(rng.choice("abcéÿß"[: rng.choice((2, 3, 6))]) for _ in range(rng.randrange(6, 10)))
        words.add(w)
        for _ in range(2):
            i = rng.randrange(len(w))
            words.add(rng.choice([w[:i] + w[i + 1 :], w[:i] + "a" + w[i:], w[:i] + "é" + w[i + 1 :]]))
    words = sorted(w for w in words if len(w) >= 6)
    got = [tuple(r) for r in spelling.near_pairs(spark.createDataFrame([(w,) for w in words], "word string")).collect()]
    want = {(a, b) if (len(a), a) < (len(b), b) else (b, a) for i, a in enumerate(words) for b in words[:i] if one_edit(a, b)}
    assert len(got) == len(set(got)) and set(got) == want and len(want) > 500


def test_variants_follow_forms_to_the_root(spark):
    n = {"colour": 5000, "color": 9, "colours": 400, "coloürs": 50, "coloüra": 8, "colourx": 999, "zzzzzz": 10, "zzzzzy": 50, "zzzzzx": 50, "lonely": 5}
    got = rows_of(spelling.group_variants(spark.createDataFrame(list(n.items()), "word string, n long")))
    assert got == brute_variants(n)
    assert got["coloüra"][:2] == ("coloürs", "colour") and got["zzzzzz"][0] == "zzzzzx"


def test_counts_of_odd_texts(spark, monkeypatch):
    monkeypatch.setattr(spelling, "PIECE", 64)
    monkeypatch.setattr(spelling, "HOLD_WORDS", 50)
    rng = random.Random(8)
    words = ["".join(rng.choice("abÀé") for _ in range(rng.randrange(5, 8))) for _ in range(60)]
    texts = [" ".join(rng.choice(words).upper() if rng.random() < 0.3 else rng.choice(words) for _ in range(rng.randrange(80))) for _ in range(60)]
    rows = [*enumerate(texts), (None, texts[3]), (None, None), (5, texts[5]), (5, texts[5]), (70, ""), (71, "word’s naïve×ﬁ ≤letters≥ " * 9), (72, "ab" * 30_000), *[(80 + i, "longest" * 5000 + "é" * (i % 2)) for i in range(12)]]
    df = clashing(spark.createDataFrame(rows, "doc_id long, text string"))
    for every in (199, 3, 0):
        got = {r.word: r.n for r in spelling.word_counts(df.repartition(3), drop_every=every).collect()}
        assert got == brute_counts(rows, every)
    counts = spelling.word_counts(df)
    assert rows_of(spelling.group_variants(clashing(counts))) == brute_variants({r.word: r.n for r in counts.collect()})
    assert spelling.group_variants(spelling.word_counts(df.limit(0))).count() == 0


def test_query_op12(spark):
    docs = pq.read_table(f"{SF}/documents.parquet").to_pandas()
    want = brute_variants(brute_counts(list(zip(docs.doc_id, docs.text, strict=True))))
    assert rows_of(queries.op12_spelling_variants(spark, SF)) == want and len(want) > 100


# -------------------------------------------------------------------- structure
def brute_repair(rows):
    """rows: (role, text) in order. Cheapest by (cost, audit): all edits as a best-first search over whole audits."""
    seen, faults = set(), []
    for r in rows:
        last = r[1].strip(" \t\n\x0b\x0c\r")
        faults.append("blank" if not last else "duplicate" if r in seen else "truncated" if last[-1] not in ".!?" else "")
        seen.add(r)
    heap, done = [(0, "", 0, "", ())], set()
    while heap:
        cost, audit, i, said, out = heapq.heappop(heap)
        if i == len(rows) and re.fullmatch("(s?(ua)+)?", said):
            return faults, cost, audit, "\n".join(f"{r}:{t}" for r, t in out)
        state = (i, said[-1:])
        if state in done and len(rows) > 3:  # short ones are searched whole
            continue
        done.add(state)
        steps = [("I", 2, 0, (r, "")) for r in ("user", "assistant")]
        if i < len(rows):
            steps.append(("D", 3, 1, None))
            if faults[i] not in ("blank", "duplicate"):
                left = int(faults[i] == "truncated")
                steps += [("K", left, 1, rows[i]), *[("R", 2 + left, 1, (r, rows[i][1])) for r in ("user", "assistant")]]
        for letter, paid, taken, row in steps:
            new = said if row is None else said + (row[0][:1] or "_")
            if row is None or re.fullmatch("s?(ua)*u?", new):
                heapq.heappush(heap, (cost + paid, audit + letter, i + taken, new, out if row is None else (*out, row)))


def brute_report(rows):
    by = defaultdict(list)
    for c, t, r, x in rows:
        by[c].append((t is not None, t or 0, " " if r is None else r, " " if x is None else x))
    out = {}
    for c, rs in by.items():
        rs.sort()
        turns = [t for known, t, _, _ in rs if known]
        faults, cost, audit, whole = brute_repair([(r, x) for _, _, r, x in rs])
        illegal = sum(a[2][:1] + b[2][:1] not in ("su", "ua", "au") for a, b in zip(rs, rs[1:], strict=False))
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        out[c] = (gaps, *[faults.count(f) for f in ("blank", "duplicate", "truncated")], illegal, cost, audit, hashlib.sha256(whole.encode()).hexdigest())
    return out


def random_rows(n, seed, most=7):
    rng = random.Random(seed)
    texts = ["Yes.", "No!", "why", "Why?", "", " \t", None, "a.\n", "end"]
    roles = ["user", "assistant", "user", "assistant", "system", "tool", None, "", "admin", "sub"]
    return [(None if c == 0 else c, rng.choice([None, rng.randrange(9), rng.randrange(9)]) if rng.random() < 0.3 else i, rng.choice(roles), rng.choice(texts) if rng.random() < 0.7 else f"t{rng.random()}.")
            for c in range(n) for i in range(rng.randrange(1, most))]


TURNS = "conv_id long, turn long, role string, text string"


def test_reports_equal_a_search(spark):
    rows = random_rows(400, 1)
    got = {r[0]: tuple(r[1:]) for r in structure_repair.report(clashing(spark.createDataFrame(rows, TURNS)).repartition(3)).collect()}
    assert got == brute_report(rows)


def test_signatures_that_share_prefixes(spark):
    signs = [x + y + z for x in "adgjk" for y in "adegcf" for z in ("", "a", "dg", "gdgdgd")] + ["", "dg" * 3000]
    got = {r.signature: (r.cost, r.audit) for r in structure_repair.cheapest_edits(spark.createDataFrame([(s,) for s in signs * 3], "signature string")).collect()}
    assert set(got) == set(signs) and got[""] == (0, "") and got["dg" * 3000] == (0, "K" * 6000)
    for s in signs[:-1]:  # each alone, from the root
        layers = [{0: (0, 0, 0, "")}]
        for x in s:
            layers.append(structure_repair._layer(layers[-1], x))
        assert got[s] == structure_repair._answer(layers)


def test_mended_rows(spark):
    rows = [(1, 0, "assistant", "a."), (1, 1, "user", "b?"), (1, 1, "user", "b?"), (1, 2, "user", "c"), (2, 0, "user", ""), (3, 0, "user", "q?"), (3, 1, "assistant", "r."), (4, 5, "system", "s."), (4, 7, "user", "x" * 300_000 + ".")]
    out = [tuple(r) for r in structure_repair.repair(spark.createDataFrame(rows, TURNS)).orderBy("conv_id", "position").collect()]
    for c in (1, 2, 3, 4):
        mine = [r for r in out if r[0] == c]
        assert re.fullmatch("(s?(ua)+)?", "".join(r[4][0] for r in mine)) and [r[1] for r in mine] == list(range(len(mine)))
        want = brute_report([r for r in rows if r[0] == c])[c]
        assert hashlib.sha256("\n".join(f"{r[4]}:{r[5]}" for r in mine).encode()).hexdigest() == want[-1]
        assert "".join(r[2] for r in mine) == want[-2].replace("D", "")
    assert not [r for r in out if r[0] == 2] and [r[3] for r in out if r[0] == 3] == [0, 1]


def test_one_long_conversation(spark):
    rows = [(1, i, ("user", "assistant")[i % 2], f"turn {i}.") for i in range(20_000)] + [(1, 30_000, "user", "turn 8.")]
    r = structure_repair.report(spark.createDataFrame(rows, TURNS)).first()
    assert (r.gaps, r.duplicate, r.illegal, r.cost, r.audit) == (10_000, 1, 0, 3, "K" * 20_000 + "D")


def test_no_conversations(spark):
    none = clashing(spark.createDataFrame([], TURNS))
    assert structure_repair.report(none).count() == structure_repair.repair(none).count() == structure_repair.damage(none).count() == 0


def brute_damage(rows):
    out = []
    for c, t, r, x in rows:
        h = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        r, x = " " if r is None else r, " " if x is None else x
        if h:
            out += [(c, t, "user" if h == 4 else r, "" if h == 1 else re.sub("[.!?]", "", x) if h == 2 else x)] * (2 if h == 3 else 1)
    return out


def test_damage(spark):
    rows = random_rows(200, 2)
    got = Counter(tuple(r) for r in structure_repair.damage(spark.createDataFrame(rows, TURNS)).collect())
    assert got == Counter(brute_damage(rows))


@pytest.mark.parametrize("source", ["tables", "odd"])
def test_query_op13(spark, source, tmp_path):
    at = SF
    if source == "odd":
        at = str(tmp_path)
        spark.createDataFrame(random_rows(300, 3), TURNS).write.parquet(f"{at}/conversations.parquet")
    rows = [tuple(r) for r in spark.read.parquet(f"{at}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    want = {r[0]: (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest()) for r in rows} | brute_report(brute_damage(rows))
    out = queries.op13_structure_repair(spark, at).collect()
    assert {r[0]: tuple(r[1:]) for r in out} == want and len(out) == len(want)


# ------------------------------------------------------------------------- HTML
@pytest.mark.parametrize(("page", "want"), [
    ("<article class=card>teaser</article><main><h1>Real</h1><p>long main text</p></main>", ["Real", "long main text"]),
    ("<main><article>one</article><p>between</p><article>two</article></main>", ["one", "between", "two"]),
    ("<main><h1>T</h1></main><article>the longer article</article>", ["T", "the longer article"]),
    ("<main><section id='notices'><p>court notices of 1900</p></section></main>", ["court notices of 1900"]),
    ("<article>x<div class='social'><p>Social history: smoker</p></div><p class='ad'>A.D. 70</p></article>", ["x", "Social history: smoker", "A.D. 70"]),
    ("<article>x<div class='social'><a href=a>one</a> <a href=b>two</a></div><div class='share-links'>y</div><div class=ad>z</div><section class=comments>c</section></article>", ["x"]),
    ("<article class=card>teaser</article><div><p>the page itself, which marks nothing</p></div>", []),
    ("<article><x-box class=notice>a <i>b</i></x-box>c</article>", ["a b", "c"]),
])
def test_main_text_is_weighed(page, want):
    assert html_extract.parse(page)[0] == want


@pytest.mark.parametrize("part", ["<i>", "</b>", "<i></b>", "<li>", "<p><i>", "<i><li></li>", "<p><div><i><p></p>", "<a '>", "<!--", "<a x='", "<table><tr><td>", "&amp", "<div class=notice>"])
def test_long_odd_pages_take_linear_time(part):
    began = time.process_time()
    html_extract.parse("<i>" * 20_000 + part * (1_000_000 // len(part)))
    assert time.process_time() - began < 8  # quadratic scans took minutes


def brute_extract(rows):
    """A plain suffix array for each host over the tokens of unmarked pages."""
    hosts = defaultdict(dict)
    for host, blocks in rows:
        stream = tuple((i, w) for i, b in enumerate(blocks) for w in b.split())
        hosts[host][tuple(w for _, w in stream)] = stream
    out = {}
    for host, streams in hosts.items():
        suffixes = sorted((words[p:], k, p) for k, words in enumerate(streams) for p in range(len(words)))
        gone, lo = defaultdict(set), 0
        common = lambda a, b: next((i for i, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b)))
        for hi in range(1, len(suffixes) + 1):
            if hi == len(suffixes) or common(suffixes[hi - 1][0], suffixes[hi][0]) < html_extract.RUN:
                group = [x for x in suffixes[lo:hi] if len(x[0]) >= html_extract.RUN]
                pages = {k for _, k, _ in group}
                if len(pages) >= html_extract.LEAST_PAGES and len(pages) >= html_extract.LEAST_SHARE * len(streams):
                    for _, k, p in group:
                        gone[k].update(range(p, p + html_extract.RUN))
                lo = hi
        for k, (words, stream) in enumerate(streams.items()):
            by = defaultdict(list)
            for p, (b, w) in enumerate(stream):
                if p not in gone[k]:
                    by[b].append(w)
            out[host, words] = "\n".join(" ".join(by[b]) for b in sorted(by))
    return out


def test_unmarked_pages_equal_a_suffix_array(spark):
    rng = random.Random(12)
    boiler = [" ".join(f"b{k}_{rng.randrange(3)}" for _ in range(rng.randrange(6, 20))) for k in range(3)]
    rows = []
    for i in range(120):
        blocks = [rng.choice(boiler) if rng.random() < 0.7 else " ".join(f"u{rng.randrange(4)}" for _ in range(rng.randrange(1, 16))) for _ in range(rng.randrange(1, 7))]
        rows.append((f"h{i % 5}", blocks))
    rows += rows[:9]
    want = brute_extract(rows)
    df = spark.createDataFrame([(i, f"http://{h}/", "".join(f"<p>{b}</p>" for b in bs)) for i, (h, bs) in enumerate(rows)], "page_id long, url string, html string")
    got = {r.page_id: r.text for r in html_extract.extract(df).collect()}
    assert got == {i: want[h, tuple(w for b in bs for w in b.split())] for i, (h, bs) in enumerate(rows)}
    assert sum(len(t) for t in got.values()) < sum(len("\n".join(bs)) for _, bs in rows)


def test_open_boxes_are_settled_by_the_host(spark):
    page = lambda i, box: f"<article><h1>Title {i}</h1><div class='notice'>{box}</div><p>own text of page {i}</p></article>"
    rows = [(i, "http://a/", page(i, "short notice")) for i in range(4)] + [(9, "http://a/", page(9, "its own remark"))] + [(20 + i, "http://b/", page(i, f"remark {i}")) for i in range(4)]
    got = {r.page_id: r.text for r in html_extract.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == {i: f"Title {i}\nown text of page {i}" for i in range(4)} | {9: "Title 9\nits own remark\nown text of page 9"} | {20 + i: f"Title {i}\nremark {i}\nown text of page {i}" for i in range(4)}


@pytest.mark.parametrize("most", [html_extract.BROADCAST, 0])
def test_every_page_goes_through_its_hosts_suffixes(spark, monkeypatch, most):
    monkeypatch.setattr(html_extract, "BROADCAST", most)
    foot = "this site is run by volunteers who write in their spare time"
    head = "a heading of more than eight words that every page of the site quotes"
    own = lambda i: " ".join(f"w{i}_{k}" for k in range(30))
    page = lambda i, more="", tail=foot: f"<nav>{head}</nav><article><h1>{own(i)}</h1>{more}</article><div>{tail}</div>"
    rows = [(i, "http://h/", page(i)) for i in range(6)]
    rows += [(10, "http://h/", f"<p>{own(10)}</p><p>{foot}</p>")]  # unmarked, alone on its host
    rows += [(20 + i, "http://h/", page(20 + i, f"<p>{foot}</p>")) for i in range(3)]  # the site's words inside three articles
    rows += [(30, "http://h/", page(30, f"<h2>{head}</h2>"))]  # what others quote is its own
    rows += [(40 + i, "http://g/", f"<nav>n{i}</nav><article>{own(1)} v{i}</article>") for i in range(4)]  # copies of one article
    rows += [(50, "http://g/", f"<p>{own(1)}</p>"), (51, "http://g/", None)]
    got = {r.page_id: r.text for r in html_extract.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    want = {i: own(i) for i in [*range(6), 10, 20, 21, 22]} | {30: f"{own(30)}\n{head}"} | {40 + i: f"{own(1)} v{i}" for i in range(4)} | {50: own(1), 51: ""}
    assert got == want


# ------------------------------------------------------------------------ media
@pytest.mark.parametrize("part", [b"PK\x03\x04", b"%PDF-", b"%PDF-startxref", b"\xff\xd8\xff", b"\xff\xd8\xff\xe0\x00\x05\xff\xd8\xff", b"GIF89a" + bytes(8) + b",", b"GIF87a\x21\x01\x01", b"RIFF\x10\x00\x00\x00WAVE",
                                  b"\x89PNG\r\n\x1a\n\x00\x00\x00\rIHDR" + bytes(17), b"BM", b"\x1f\x8b\x08", b"PK\x05\x06PK\x03\x04", b"%%EOF%PDF-"])
def test_repeated_magics_take_linear_time(part):
    began = time.process_time()
    media.sniff(b"x" + part * (1_000_000 // len(part)))
    assert time.process_time() - began < 4


def test_carving_takes_outermost_objects():
    def chunk(kind, data):
        return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))

    png = b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", bytes(13)) + chunk(b"IDAT", b"GIF89a") + chunk(b"IEND", b"")
    wav = media.store(b"x" * 10 + png)[0]
    pdf = b"%PDF-1 " + png + b" startxref 0 %%EOF"
    assert media.sniff(b"ab" + png + png) == (media.UNKNOWN, [(2, len(png), "image/png"), (2 + len(png), len(png), "image/png")])
    assert media.sniff(b"ab" + pdf) == (media.UNKNOWN, [(2, len(pdf), "application/pdf")])
    assert media.sniff(pdf) == ("application/pdf", [(7, len(png), "image/png")]) and media.sniff(wav)[1] == [(54, len(png), "image/png")]
    jpeg = b"\xff\xd8\xff\xe0\x00\x04ab\xff\xda\x00\x03xdata\xff\xd9"
    assert media.sniff(b"-" + jpeg + b"-" + jpeg)[1] == [(1, len(jpeg), "image/jpeg"), (2 + len(jpeg), len(jpeg), "image/jpeg")]
    assert media.sniff(b"-" + jpeg[:-2])[1] == [] and media.sniff(b"-" + png[:-5] + b"x" + png[-4:])[1] == []


# ------------------------------------------------------------------------- chat
def test_rows_are_formatted_by_the_declared_mapping(spark, monkeypatch):
    rows = spark.createDataFrame([(1, 0, "user", "q"), (1, 1, "assistant", "a")], TURNS)
    turns = lambda: [(t.role, t.text) for t in chat.format_rows(rows).first().turns]
    assert turns() == [("user", "q"), ("assistant", "a")]
    paths, _ = chat.LAYOUTS["messages"]
    monkeypatch.setitem(chat.LAYOUTS, "messages", (paths, chat.Listed("messages", "content", "role")))
    assert turns() == [("q", "user"), ("a", "assistant")]
    monkeypatch.setitem(chat.LAYOUTS, "messages", (("messages",), chat.Listed("messages", "role", "content")))
    with pytest.raises(Exception, match="unknown layout: messages"):
        turns()


def test_typed_columns_of_every_layout(spark):
    s = "string"
    cases = {
        "from_value": (f"conversations array<struct<from:{s},value:{s}>>", ([("human", "h"), ("gpt", None), ("x", "y")],), [("user", "h"), ("assistant", ""), ("x", "y")]),
        "prompt_response": (f"prompt {s}, response {s}", ("p", None), [("user", "p"), ("assistant", "")]),
        "instruction_input": (f"instruction {s}, input {s}, output {s}", ("i", "n", "o"), [("user", "i\n\nn"), ("assistant", "o")]),
        "turns": (f"turns array<struct<text:{s},role:{s}>>", ([("t", "user")],), [("user", "t")]),
    }
    for layout, (kind, row, want) in cases.items():
        df = spark.createDataFrame([row], kind)
        r = chat.typed_turns(df, df.columns).first()
        assert (r.layout, [(t.role, t.text) for t in r.turns]) == (layout, want)


def test_no_rows_to_format(spark):
    assert chat.format_rows(spark.createDataFrame([], TURNS)).count() == 0


def test_a_long_text_that_is_no_json_is_told(spark):
    df = spark.createDataFrame([(1, "x"), (2, '{"prompt":"p","response":"r"}')], "i int, record string").withColumn("record", F.when(F.col("i") == 1, F.repeat(F.lit("x"), 21_000_000)).otherwise(F.col("record")))
    assert {r.i: (r.layout, r.error) for r in chat.canonical_turns(df).select("i", "layout", "error").collect()} == {1: (None, "not JSON"), 2: ("prompt_response", None)}
