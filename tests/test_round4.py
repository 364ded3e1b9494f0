"""Findings of round 4, each by the input that showed it."""

import random
from difflib import SequenceMatcher

from test_findings import by_sql, documents

from lexmill.functions import claims
from lexmill.functions import scores as C
from lexmill.functions import sequences
from lexmill.plans import load, registry

load()


def rows(spark, at, name):
    return sorted(tuple(r) for r in registry.QUERIES[name](spark, at).collect())


def test_language_of_texts_without_letters(spark, tmp_path):
    """the share of letters was divided by their number, also where there are none."""
    at = documents(spark, tmp_path / "t", [None, "", " ", "12 345\n%", "\u0300", "abc", "đẹp", "a" * 99 + "đ", "1" * 3000 + "abc"])
    got = rows(spark, at, "t50_detect_language")
    assert got == by_sql(at, "t50_detect_language") and got[0] == (0, "vi", 0.0, False) and got[7][1] == "mixed"


ODD = [
    None, "", " \n ", "\x0babc\x0b", "abc \x85", "abc\r\ndef\r\n", "abc\rdef", "KẾT QUẢ\nmore", "abc\nABSTRACT\ndef\nReferences:\nghi", "REFERENCES", "x4142", "a" * 299 + "\n\nb",
    "first line of more than thirty signs here\n\nsecond line of more than thirty signs here", "Title: a sentence of over thirty signs. Source: and here is another of them, also long.",
    "a.\x0bb is a sentence of over thirty signs.\x0b\x0b c is another of over thirty signs", "- first sentence of more than thirty signs -. \r\n- second one of more than 30 signs-\x85", "\n\n" + "word\n" * 50,
    "\xa0- a sentence of 30 signs here.\u3000 \xa0a sentence of 30 signs here..\xa0 \xa0", "\u2003\n-\u2003\n",
]


def test_abstract_is_all_of_the_start(spark, tmp_path):
    """a blank start gave no section, own lines became headings, line ends changed."""
    at = documents(spark, tmp_path / "t", ODD)
    assert rows(spark, at, "h01_plain_sections") == by_sql(at, "h01_plain_sections")


def test_sentences_of_paragraphs_with_empty_lines(spark, tmp_path):
    """an empty line parted sentences, labelled ones weren't counted, vertical tabs were white space."""
    at = documents(spark, tmp_path / "t", [t for t in ODD for _ in range(7)])
    assert rows(spark, at, "t37_sentences") == by_sql(at, "t37_sentences")


def test_secondary_articles_of_all_kinds(spark, tmp_path):
    """only chunks with an article id were read, a third of the table."""
    texts = ["" if i % 5 else f"Body {i}" for i in range(30)]
    texts[28] = "A title of an old issue\nand its text"  # the last document id, and the first title of an issue
    texts[2], texts[5], texts[8] = None, "one title\nx", "one title\ny"
    at = documents(spark, tmp_path / "t", texts)
    got = rows(spark, at, "f39_f40_secondary")
    assert got == by_sql(at, "f39_f40_secondary") and {k.split(":")[0][:9] for k, *_ in got} == {"article", "doc", "legacy-ti", "title", "_unknown_"}
    assert [same for k, _, same in got if k.startswith("legacy-title:")] == [True]


def test_pieces_are_aligned_together(monkeypatch):
    """each sentence was aligned by itself, sign by sign in Python."""
    rng = random.Random(1)
    say = lambda n, signs: "".join(rng.choices(signs, k=n))
    kinds = ["ab", "abc de", "abcdefgh ijkl", "đẹ😀ab \n", "aaaab"]
    pieces = [[say(rng.randrange(1, 90), kinds[i % 5]) for _ in range(rng.randrange(9))] for i in range(300)] + [None, ["a"], ["ab" * 99], ["abcab"]]
    refs = [say(rng.choice([5, 64, 65, 128, 129, 199]), kinds[i % 5]) for i in range(300)] + ["a", None, "ab" * 100, "xabcabcab"]
    floors = [rng.choice([0.0, rng.random()]) for _ in refs]
    want = [max([z, *(SequenceMatcher(None, p, r).ratio() for p in (ps if r and ps else []))]) for ps, r, z in zip(pieces, refs, floors)]
    for rows in (40, 1 << 15):
        monkeypatch.setattr(sequences, "ROWS", rows)
        assert C._best_each(pieces, refs, floors) == want
    monkeypatch.setattr(sequences, "LONGEST", 50)
    assert C._best_each(pieces, refs, floors) == want
    monkeypatch.setattr(sequences, "LONGEST", 1 << 18)
    calls = []
    monkeypatch.setattr(C, "SequenceMatcher", lambda *a: calls.append(a))
    assert C._best_each(pieces[:9], refs[:9], floors[:9]) and not calls


def test_sentences_are_folded_once(spark, monkeypatch):
    """a candidate sentence was folded three times, its section for each sentence."""
    from lexmill.functions import answering

    done = []
    before = answering.fold
    counted = lambda c: done.append(1) or before(c)
    monkeypatch.setattr(answering, "fold", counted)
    monkeypatch.setattr(claims, "fold", counted)
    c = C.F.col
    claims._candidates(c("chunks"), c("query"), C.F.lit(False), lambda n, s: C.F.lit(0.0))
    assert len(done) - 2 <= 2  # the question's two, a sentence and a section
