"""Discovery, extraction states, page rules, versions, migration and manifest rows against plain loops."""

import random
import re

import pytest
from pyspark.sql import functions as F

from lexmill.operators import assets as V
from lexmill.operators import extraction as X
from lexmill.operators import frontier as B
from lexmill.operators import lineage
from lexmill.operators import matching as M


def plain_queue(links, seeds, depth, pages, items):
    queue, seen, found = [(p, 0) for p in seeds], [], {}
    while queue and len(seen) < pages:
        page, d = queue.pop(0)
        if page in seen:
            continue
        seen.append(page)
        for target, title in links.get(page, []):
            if target % 3 == 0 and target not in found:
                found[target] = title
                if items and len(found) == items:
                    return seen, found
            if d < depth and target % 4:
                queue.append((target, d + 1))
    return seen, found


@pytest.mark.parametrize(("depth", "pages", "items"), [(0, 100, 0), (1, 100, 0), (3, 1000, 0), (3, 25, 0), (5, 60, 40), (2, 0, 0), (9, 1000, 7)])
def test_discovery_equals_a_queue(spark, depth, pages, items):
    rng = random.Random(depth * 100 + pages)
    links = {p: [(rng.randrange(150), f"t{rng.randrange(9)}") for _ in range(rng.choice((0, 1, 3, 8)))] for p in range(120)}
    seeds = [5, 200, 17, 5, 80]
    rows = [(p, i, t, s) for p, x in links.items() for i, (t, s) in enumerate(x)] + [(None, 0, 9, "x"), (5, 90, None, "x")]
    df = spark.createDataFrame(rows, "page long, position int, target long, title string").repartition(3)
    got = B.discover(df, spark.createDataFrame([(p, i) for i, p in enumerate(seeds)], "page long, position int"), F.col("target") % 3 == 0, F.col("target") % 4 > 0, depth, pages, items)
    visited, found = plain_queue(links, seeds, depth, pages, items)
    order = [r.page for r in got[0].orderBy("depth", "path").collect()]
    assert order[: len(visited)] == visited and (items or order == visited)  # a queue stops at the last item
    assert [(r.url, r.title) for r in got[1].orderBy("depth", "path").collect()] == list(found.items())


def test_discovery_of_nothing(spark):
    none = spark.createDataFrame([], "page long, position int, target long, title string")
    pages, items = B.discover(none, none.select("page", "position"), F.lit(True), F.lit(True))
    assert pages.count() == items.count() == 0


def test_a_shared_folder_is_asked_for_on_a_cluster():
    class Conf:
        def get(self, name, default=None):
            return default

    class Cluster:
        conf = Conf()
        sparkContext = type("C", (), {"master": "spark://x:7077"})()  # noqa: N815

    with pytest.raises(RuntimeError, match="checkpoint"):
        lineage.shared_folder(Cluster())


# ------------------------------------------------------------------ states
MAN = "position int, relative_path string, content_class string, extract_strategy string, extract_status string, item_url string, file_url string, notes string"


def stem_of(path):
    return re.sub(r"\.(html|pdf)$", "", path.rsplit("/", 1)[-1])


def plain_reconcile(rows, assets, outputs, prior):
    """One row after the other, as a loop over a changing manifest and folder would."""
    status = {}
    for r in rows:
        status[r[1]] = [r[3], r[4], r]
    have, legacy, stale = set(outputs), {s for s, l in prior if l}, {s for s, _ in prior}
    by = {}
    for p in status:
        by.setdefault(stem_of(p), []).append(p)
    state = {s: "kept" for s in have}
    for s, paths in by.items():
        if any(status[p][1] == "done" for p in paths) and s not in have and s in stale:
            have.add(s)
            state[s] = "restored"
    for p, x in status.items():
        s, r = stem_of(p), x[2]
        sibling = any(status[q][1] == "done" for q in by[s])
        if p not in assets:
            if sibling:
                x[:2] = "stale_sibling_backlog", "deferred"
            elif "bootstrapped_from_existing_raw" in r[7] and not r[5]:
                x[:2] = "legacy_missing_backlog", "deferred"
                have.discard(s)
            else:
                x[1] = "missing_asset"
                if s not in legacy:
                    have.discard(s)
            continue
        if x[1] == "missing_asset":
            x[1] = "pending" if r[2] != "image" else "deferred"
        if x[1] == "done" and s not in have:
            x[1] = "pending"
        elif x[1] in ("failed", "deferred") and not sibling:
            have.discard(s)
    done = {stem_of(p) for p, x in status.items() if x[1] == "done"}
    return {p: tuple(x[:2]) for p, x in status.items()}, {s: "deleted" if s not in have else v if s in done else "quarantined" for s, v in state.items()}


def test_reconciliation_equals_a_loop(spark):
    rng = random.Random(3)
    rows = []
    for i in range(500):
        path = f"d/n{rng.randrange(150)}.{rng.choice(('html', 'pdf'))}"
        rows.append((i, path, rng.choice(("html", "image")), "backlog", rng.choice(("done", "done", "pending", "failed", "deferred", "missing_asset")), rng.choice(("", "u")), "", rng.choice(("", "bootstrapped_from_existing_raw"))))
    assets = {p for p in {r[1] for r in rows} if rng.random() < 0.6}
    stems = sorted({stem_of(r[1]) for r in rows}) + ["gone1", "gone2"]
    outputs, prior = [s for s in stems if rng.random() < 0.5], [(s, rng.random() < 0.5) for s in stems if rng.random() < 0.4]
    frame = lambda r, schema: spark.createDataFrame(r, schema).repartition(3)
    given = frame([(a,) for a in assets], "relative_path string"), frame([(s,) for s in outputs], "stem string"), frame(prior, "stem string, legacy boolean")
    man = frame([*rows, (900, " ", "html", "x", "done", "", "", "")], MAN)
    new, out = X.reconcile(man, *given)
    want, states = plain_reconcile(rows, assets, outputs, prior)
    got = {r.position: (r.relative_path, r.extract_strategy, r.extract_status) for r in new.collect()}
    assert {p: (s, t) for p, s, t in got.values() if p != " "} == want and len(got) == 501 and got[900][1:] == ("x", "done")
    assert {r.stem: r.state for r in out.collect()} == states and set(states.values()) == {"kept", "restored", "deleted", "quarantined"}
    again, _ = X.reconcile(man, *given)  # equal inputs, equal results
    assert {r.position: (r.relative_path, r.extract_strategy, r.extract_status) for r in again.collect()} == got


def test_extraction_steps(spark):
    schema = "content_class string, extension string, extract_strategy string, extract_status string, exists boolean, has_output boolean, filtered boolean, text_chars int, pdf_action string, pdf_strategy string"
    cases = [
        (("html", ".html", "x", "done", True, True, False, 500, None, None), ("skip", "x", "done")), (("html", ".html", "x", "done", True, False, False, 500, None, None), ("write", "html_text", "done")),
        (("html", "", "x", "pending", True, False, True, 500, None, None), ("drop", "html_filtered", "deferred")), (("html_book", "", None, "", True, False, None, 119, None, None), ("drop", "html_text", "failed")),
        (("pdf", ".pdf", None, "deferred", False, False, False, None, "process", "p"), ("skip", None, "deferred")), (("pdf", ".pdf", None, "done", False, True, False, None, "process", "p"), ("skip", None, "done")),
        (("pdf", ".pdf", None, "failed", False, False, False, None, "process", "p"), ("drop", "backlog", "missing_asset")), (("pdf", ".pdf", None, None, True, False, False, 9, "process", "p"), ("write", "p", "done")),
        (("pdf", ".pdf", None, None, True, False, False, None, "process", "p"), ("drop", "digital_pdf_text", "failed")), (("pdf", ".pdf", None, None, True, False, False, None, "defer", "ocr"), ("drop", "ocr", "deferred")),
        (("pdf", ".pdf", None, None, True, False, False, None, "fail", "ocr"), ("drop", "classify_pdf", "failed")), (("xml", " .XML ", "x", "", True, False, False, None, None, None), ("write", "xml_text", "done")),
        (("xml", ".pdf", "x", "", True, False, False, None, None, None), ("drop", "misclassified_non_xml", "deferred")), (("txt", ".docx", "x", "", True, False, False, None, None, None), ("drop", "office_backlog", "deferred")),
        (("image", ".png", "x", "", True, False, False, None, None, None), ("drop", "x", "deferred")), (("jsonl", ".jsonl", "x", "", True, False, False, None, None, None), ("write", "universal_loader", "done")), ((None, None, None, None, True, False, None, None, None, None), ("drop", "backlog", "deferred")),
    ]
    got = X.extraction_step(spark.createDataFrame([(i, *a) for i, (a, _) in enumerate(cases)], f"i int, {schema}")).collect()
    assert {r.i: (r.action, r.new_strategy, r.new_status) for r in got} == {i: w for i, (_, w) in enumerate(cases)}
    forced = X.extraction_step(spark.createDataFrame([cases[0][0]], schema), force=True).first()
    assert (forced.action, forced.new_status) == ("write", "done")


def test_page_rules(spark):
    rows = [("msd_manual_consumer", "http://x/Resource/y", "", True), ("cdc_health_topics", "http://x/a", "FAQ", True), ("cdc_health_topics", "http://x/resource/", "", False), ("mayo_diseases_conditions", "http://x/symptoms-causes/", "x", False),
            ("mayo_diseases_conditions", None, None, True), ("vien_dinh_duong", "http://x/vi/professional-activities/abc-0123456789ab", "", False), ("vien_dinh_duong", "http://x/vi/professional-activities/abc", "", True),
            ("vien_dinh_duong", "http://x/vi/search/?q=1", "", True), ("vien_dinh_duong", "http://x/p", "So-do-to-chuc", True), ("other", "http://x/about/", "search", False), (None, "http://x/about/", "search", False)]
    got = X.filtered_pages(spark.createDataFrame([(i, *r[:3]) for i, r in enumerate(rows)], "i int, source_id string, item_url string, title_hint string")).collect()
    assert {r.i: r.filtered for r in got} == {i: r[3] for i, r in enumerate(rows)} and got[0].asDict().keys() == {"i", "source_id", "item_url", "title_hint", "filtered"}
    assert sum(len(t) for *_, t in X.PAGE_RULES) == 94


# ------------------------------------------------------------------ versions, copies
def test_versions(spark):
    get = "source_id string, filename_hint string, extension string, sha256 string, downloaded_at string"
    none = spark.createDataFrame([], "source_id string, asset string, name string, sha256 string, downloaded_at string")
    one = spark.createDataFrame([("s", "a", ".pdf", "1", "2024-01-01T00:00:00Z"), ("s", "a", ".pdf", "1", "2024-01-01T00:00:00Z"), ("s", "b.html", "", "2", "2024-01-01T00:00:00Z")], get)
    two = spark.createDataFrame([("s", "a", ".pdf", "3", "2024-02-01T00:00:00Z"), ("s", "a.pdf", ".pdf", "4", "2024-03-01T00:00:00Z"), ("t", "a", "pdf", "5", "2024-02-01T00:00:00Z")], get)
    first = V.append_versions(none, one)
    both = V.append_versions(first, two)
    for x in (both, V.append_versions(both, two), V.append_versions(both, one)):
        assert sorted((r.source_id, r.name, r.sha256) for r in x.collect()) == [("s", "a.pdf", "1"), ("s", "a__20240201T000000Z.pdf", "3"), ("s", "a__20240301T000000Z.pdf", "4"), ("s", "b.html", "2"), ("t", "a.pdf", "5")]
    at = lambda t: sorted((r.source_id, r.asset, r.sha256) for r in V.as_of(both, F.lit(t)).collect())
    assert at("2024-02-15T00:00:00Z") == [("s", "a.pdf", "3"), ("s", "b.html", "2"), ("t", "a.pdf", "5")] and at("2023-01-01") == []


def test_migration(spark, tmp_path):
    for name, text in {"old/a": "1", "old/b": "2", "old/c": "3", "new/b": "2", "new/c": "other"}.items():
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_text(text)
    files = V.file_hashes(spark, str(tmp_path)).withColumn("path", F.regexp_extract("path", "((?:old|new)/.*)$", 1))
    tasks = spark.createDataFrame([(f"old/{x}", f"new/{x}") for x in "abcd"], "source string, destination string")
    run = lambda f, **how: {r.source[-1]: r.action for r in V.migration(tasks, f, **how).collect()}
    assert run(files) == {"a": "would_copy", "b": "skip_same_hash", "c": "conflict", "d": "missing_source"}
    assert run(files, overwrite=True)["c"] == "would_overwrite"
    done = V.migration(tasks, files, execute=True, overwrite=True)
    assert {r.source[-1]: (r.action, r.destination_exists, r.bytes) for r in done.collect()} == {"a": ("copy", True, 1), "b": ("skip_same_hash", True, 1), "c": ("overwrite", True, 1), "d": ("missing_source", False, 0)}
    after = V.migrated(files, done)
    assert after.count() == 6 and run(after, execute=True) == {"a": "skip_same_hash", "b": "skip_same_hash", "c": "skip_same_hash", "d": "missing_source"}
    assert {r.action: r.tasks for r in V.migration_summary(done).collect()} == {"copy": 1, "skip_same_hash": 1, "overwrite": 1, "missing_source": 1}


# ------------------------------------------------------------------ manifest rows
def test_manifest_rows(spark):
    h = "0123456789abcdef0123456789"
    rows = [(0, "sources/x.html", "Skip to main content", "http://a", ""), (1, "x.html", "A title that is plain", "http://b", ""), (2, "x.html", "A title that is plain", "http://c", ""), (3, f"y-{h}.html", "", "", ""),
            (4, "z.html", f"Long title with number {h}", f"http://d/{h.upper()}", "bootstrapped_from_existing_raw"), (5, "", "A title that is plain", "http://e", "")]
    man = spark.createDataFrame([("s", p, path, "html", t, u, None, "http://parent" if p == 3 else None, "done", n) for p, path, t, u, n in rows],
                                "source_id string, position long, relative_path string, content_class string, title_hint string, item_url string, file_url string, parent_item_url string, extract_status string, notes string")
    files = spark.createDataFrame([("s", "p/x.txt"), ("s", f"y-{h}.txt"), ("s", f"w{h}.txt"), ("s", "none.txt"), ("t", "x.txt")], "source_id string, file string")
    got = {(r.source_id, r.file): (r.match and (r.match.position, r.match.score, r.match.url), r.n_candidates) for r in M.best_manifest_rows(files, M.manifest_index(man)).collect()}
    assert got == {("s", "p/x.txt"): ((1, 150, "http://b"), 3), ("s", f"y-{h}.txt"): ((4, 125, f"http://d/{h.upper()}"), 2), ("s", f"w{h}.txt"): ((4, 125, f"http://d/{h.upper()}"), 2), ("s", "none.txt"): (None, 0), ("t", "x.txt"): (None, 0)}
    assert M.manifest_index(man).where("kind = 'number'").count() == 2
