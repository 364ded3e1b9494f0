"""Files that are no documents (listings, stubs, wrapper pages), and the title and address that a document goes by."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .cleaning import CONTENTS_DOTS, CONTENTS_NUMBERED, DATE_LINE, body_heading, marker_text, needs_cleanup, split_lines, title_candidate, trimmed
from .text import blank, let, title_from_url

# ---------------------------------------------------------------- fixed values
DOWNLOAD_LINES = ["tải xuống", "tai xuong", "download"]
STUB_SOURCES = ["dav_gov", "kcb_moh"]
STUB_MARKERS = ["ký bởi:", "cơ quan:", "ngày ký:", "sonht.kcb_", "độc lập - tự do - hạnh phúc"]
WRAPPER_TITLES = ["skip to main content", "xem chi tiết", "xem chi tiet"]
ADDRESS_NEEDED = ["who_vietnam", "vien_dinh_duong", "vmj_ojs"]
OFFICE_PARTS = ["/about/", "/gioi-thieu", "/don-vi-trong-vien", "/chuc-nang-nhiem-vu", "/hop-tac-quoc-te", "/co-cau-to-chuc", "/site-map", "/tim-kiem"]
# ----------------------------------------------------------------------------


def _any(c: Column, marks: list[str]) -> Column:
    return F.exists(F.array(*[F.lit(m) for m in marks]), lambda m: F.contains(c, m))


def download_listing(body: Column) -> Column:
    """three lines or more that offer a download and three dates among a body's 80 first lines, and none of a table of contents."""

    def judge(lines: Column) -> Column:
        count = lambda rule: F.size(F.filter(lines, rule))
        contents = count(lambda x: x.rlike(CONTENTS_DOTS) | x.rlike(CONTENTS_NUMBERED))
        offers = count(lambda x: trimmed(F.regexp_replace(F.lower(x), r"(?U)\s+", " ")).isin(DOWNLOAD_LINES))
        return (offers >= 3) & (count(lambda x: x.rlike(DATE_LINE)) >= 3) & (contents == 0)

    return let(F.filter(F.transform(F.slice(split_lines(body), 1, 80), trimmed), lambda x: x != ""), judge)


def admin_stub(source: Column, body: Column) -> Column:
    """a short text of an office's source with two of a signature's marks or more, on 18 lines at most."""
    low = F.lower(blank(body))
    hits = sum((F.when(F.contains(low, F.lit(m)), 1).otherwise(0) for m in STUB_MARKERS), F.lit(0))
    lines = F.size(F.filter(split_lines(body), lambda x: trimmed(x) != ""))
    return F.coalesce(source.isin(STUB_SOURCES), F.lit(False)) & (F.char_length(blank(body)) <= 450) & (hits >= 2) & (lines <= 18)


def wrapper_page(source: Column, title: Column, url: Column, body: Column) -> Column:
    """a page around documents: by its title, or in some sources by a missing address, an office's address, or as a listing."""
    s = blank(source)
    office = (s == "vien_dinh_duong") & (_any(F.lower(blank(url)), OFFICE_PARTS) | download_listing(body))
    return marker_text(title).isin(WRAPPER_TITLES) | (s.isin(ADDRESS_NEEDED) & (blank(url) == "")) | office


def resolved(title: Column, url: Column, body: Column, manifest_title: Column, manifest_url: Column, own_title: Column) -> Column:
    """H105: struct(title, url): the extracted title if it is a good one, else the body's heading, a good title of the manifest, the address's last part,
    the file's own title, or what was extracted; the address, or the manifest's. ``body`` is cleaned."""
    at = F.when(blank(url) != "", url).otherwise(blank(manifest_url))

    def pick(t: Column) -> Column:
        hint = let(title_candidate(manifest_title), lambda h: F.when(needs_cleanup(h), "").otherwise(h))
        options = F.array(body_heading(body), hint, title_candidate(title_from_url(at)), title_candidate(own_title), t)
        return F.when(~needs_cleanup(t), t).otherwise(F.coalesce(F.get(F.filter(options, lambda x: x != ""), F.lit(0)), F.lit("")))

    return F.struct(let(title_candidate(title), pick).alias("title"), at.alias("url"))
