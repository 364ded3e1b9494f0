"""Every unit of a corpus takes the lattice, frequent or rare."""

import itertools
import random

import pyarrow as pa

from lexmill.llm import sentencepiece


def test_rare_units_take_the_lattice(spark, monkeypatch):
    seen, plain = [], sentencepiece.merge_edges
    monkeypatch.setattr(sentencepiece, "merge_edges", lambda units, *rest: seen.append(units) or plain(units, *rest))
    words = ["".join(w) for w in itertools.product("etaoinshrd", repeat=5)][:70_000]
    m = sentencepiece.model_of(sentencepiece.read_model())
    text = " ".join(words)
    want = {v for part in m.units(text) for u in part for v in m.apart(u)}
    out = sentencepiece.encode(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    assert out.exact and list(out.ids) == m.sp.encode(text)
    assert len(want) > 65_536 and {r.unit for r in seen[0].select("unit").collect()} == want


def test_blocks_and_answers_in_parts(spark):
    # answers of several tasks and parts, out of order, for two blocks; number 0 is never asked for
    rows = [((b << 24) + i, [i % 7] * (i % 3)) for b in (3, 1 << 20) for i in range(1, 400)]
    random.Random(1).shuffle(rows)
    batches = [pa.RecordBatch.from_arrays([pa.array([p for p, _ in x]), pa.array([i for _, i in x], pa.list_(pa.int32()))], ["place", "ids"]) for x in (rows[:100], rows[100:100], rows[100:])]
    out = pa.Table.from_batches(list(sentencepiece._answers(iter(batches)))).to_pylist()
    assert [r["block"] for r in out] == [3, 1 << 20]
    for r in out:
        at, size, flat = sentencepiece._answered([r["pack"]])
        assert at.tolist() == list(range(1, 400)) and size.tolist() == [i % 3 for i in at.tolist()] and flat.tolist() == [i % 7 for i in at.tolist() for _ in range(i % 3)]


def test_units_cut_at_once(monkeypatch):
    """The units of many texts, found by steps of any length, against those of one text after another."""
    monkeypatch.setattr(sentencepiece, "STEP", 37)
    m = sentencepiece.model_of(sentencepiece.read_model())
    r = random.Random(3)
    signs = [" ", "  ", "▁", "▁▁", "\t", "\n", "\x0b", "\x0c", "\r", "\xa0", "\x00", "a", "é", "日", "𝄞", "ing", "the", ".", "===", "0"]
    texts = ["", "▁", " ", "a▁", "", *("".join(r.choices(signs, k=r.randrange(60))) for _ in range(500)), "", ""]
    unit, own, ends = m.cut([t.encode() for t in texts])
    unit = unit.to_pylist()
    for t, lo, hi in zip(texts, ends[:-1].tolist(), ends[1:].tolist(), strict=True):
        want = []
        for k, part in enumerate(m.units(t) if t else []):
            want += [None] * (k > 0) + [v for u in part for v in m.apart(u)]
        assert [None if o else u for u, o in zip(unit[lo:hi], own[lo:hi].tolist(), strict=True)] == want
    assert [len(x) for x in m.cut([])] == [0, 0, 1] and m.cut([b"", b""])[2].tolist() == [0, 0, 0]
