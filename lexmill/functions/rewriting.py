"""Rewriting of gold answers: concepts that the ground truth holds, and the fewest sentences that say them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .cleaning import trimmed
from .text import blank, let, squeeze, title_key

_WORD = 62


def split_sentences(c: Column) -> Column:
    """Sentences of a text, without the blanks around them."""
    return F.filter(F.transform(F.split(trimmed(c), r"(?U)(?<=[.!?])\s+"), trimmed), lambda s: s != "")


def _keyed(c: Column) -> Column:
    """A text as it is matched: its key and its words of two signs or more."""
    return let(title_key(c), lambda k: F.struct(k.alias("key"), F.filter(F.split(k, " "), lambda w: F.char_length(w) > 1).alias("words")))


def _says(phrase: Column, text: Column) -> Column:
    """Whether a keyed text holds a keyed phrase, or four fifths of its words."""
    n = F.size(phrase["words"])
    found = F.size(F.filter(phrase["words"], lambda w: F.array_contains(text["words"], w)))
    return F.contains(text["key"], phrase["key"]) | (n == 0) | (found / n >= 0.8)


def _bitmaps(sentences: Column, concepts: Column) -> Column:
    """For each keyed sentence the keyed concepts it says, as words of 62 bits."""
    words = F.sequence(F.lit(0), F.floor((F.size(concepts) - 1) / _WORD).cast("int"))

    def word(s: Column, w: Column) -> Column:
        some = F.slice(concepts, w * _WORD + 1, F.lit(_WORD))
        bits = F.transform(some, lambda c, i: F.when(_says(c, s), F.call_function("shiftleft", F.lit(1).cast("bigint"), i)).otherwise(F.lit(0).cast("bigint")))
        return F.aggregate(bits, F.lit(0).cast("bigint"), lambda a, b: a.bitwiseOR(b))

    return F.transform(sentences, lambda s: F.transform(words, lambda w: word(s, w)))


def greedy_cover(truth: Column, concepts: Column) -> Column:
    """Sentences of a ground truth, in its order, that say the concepts: each time the one that says most of those still unsaid, of equal ones the first.

    A fold over bitmaps: its state is the concepts not yet said and the
    sentences taken, and it runs as often as there are concepts, as each step
    that finds a sentence says one more. The trimmed text if no sentence says any.
    """

    def cover(x: Column) -> Column:
        maps = x["maps"]
        gain = lambda m, left: F.aggregate(F.zip_with(m, left, lambda a, b: F.bit_count(a.bitwiseAND(b))), F.lit(0), lambda a, n: a + n)
        start = F.struct(F.transform(F.get(maps, F.lit(0)), lambda w: F.lit((1 << _WORD) - 1).cast("bigint")).alias("left"), F.array().cast("array<int>").alias("taken"), F.lit(True).alias("more"))

        def step(a: Column, _: Column) -> Column:
            best = F.array_max(F.transform(maps, lambda m, i: F.struct(gain(m, a["left"]).alias("gain"), (-i).alias("at"))))
            new = lambda b: F.struct(F.zip_with(a["left"], F.get(maps, -b["at"]), lambda u, m: u.bitwiseAND(F.bitwise_not(m))).alias("left"), F.concat(a["taken"], F.array(-b["at"])).alias("taken"), F.lit(True).alias("more"))
            none = F.struct(a["left"].alias("left"), a["taken"].alias("taken"), F.lit(False).alias("more"))
            # after a step that finds none no other one does
            return F.when(a["more"], let(best, lambda b: F.when(b["gain"] > 0, new(b)).otherwise(none))).otherwise(a)

        taken = F.aggregate(concepts, start, step, lambda a: F.array_sort(a["taken"]))
        return F.array_join(F.transform(taken, lambda i: F.get(x["s"], i)), " ")

    empty = F.size(concepts) == 0
    said = let(split_sentences(truth), lambda s: F.when(empty | (F.size(s) == 0), "").otherwise(let(
        F.struct(s.alias("s"), let(F.transform(concepts, _keyed), lambda k: _bitmaps(F.transform(s, _keyed), k)).alias("maps")), cover)))
    return let(said, lambda t: F.when(t == "", trimmed(truth)).otherwise(t))


def phrase_coverage(phrases: Column, text: Column) -> Column:
    """The share of phrases that a text says; 1 without phrases."""
    return F.when(F.size(phrases) == 0, 1.0).otherwise(let(_keyed(text), lambda t: F.size(F.filter(phrases, lambda p: let(_keyed(p), lambda k: _says(k, t)))) / F.size(phrases)))


def supported_concepts(concepts: Column, missing: Column, weak: Column) -> Column:
    """(kept, removed): concepts without those ``missing`` in the ground truth, if the record is ``weak``, and without repeats up to case and blanks."""
    out = lambda c: weak & F.array_contains(missing, c)
    left = F.filter(concepts, lambda c: ~out(c))
    key = lambda c: F.lower(squeeze(c))
    first = F.filter(left, lambda c, i: F.array_position(F.transform(left, key), key(c)) == i + 1)
    return F.struct(first.alias("kept"), F.filter(concepts, out).alias("removed"))


def with_concepts(short: Column, concepts: Column) -> Column:
    """A short answer with concepts that it lacks behind it."""
    base = F.rtrim(trimmed(short), F.lit(" .;:"))
    said = F.concat(trimmed(F.array_join(concepts, "; ")), F.lit("."))
    return F.when(F.size(concepts) == 0, trimmed(blank(short))).when(base == "", said).otherwise(F.concat(base, F.lit("; "), said))


def choose_short_answer(short: Column, truth: Column, concepts: Column, too_few: Column, cover: Column | None = None) -> Column:
    """struct(answer, strategy, before, after, added): the short answer as it is, unless it covers ``too_few`` concepts; then
    itself with the missing ones or the covering sentences of the ground truth, whichever covers more; of equal ones the shorter, the sentences on a tie.
    ``cover``: the ground truth's greedy cover, if known.
    """
    own = trimmed(short)
    lacking = let(_keyed(own), lambda t: F.filter(concepts, lambda c: ~let(_keyed(c), lambda k: _says(k, t))))
    tokens = lambda t: F.size(F.filter(F.split(title_key(t), r"[^\p{L}\p{M}\p{N}_]+"), lambda w: F.char_length(w) > 1))
    out = lambda answer, how, after, added: F.struct(answer.alias("answer"), F.lit(how).alias("strategy"), F.round(phrase_coverage(concepts, own), 3).alias("before"), F.round(after, 3).alias("after"), added.alias("added"))

    def pick(x: Column) -> Column:
        more, less = x["said"] > x["put"], x["put"] > x["said"]
        sentences = more | (~less & (tokens(x["cover"]) > 0) & (tokens(x["cover"]) <= tokens(x["long"])))
        return F.when(sentences, out(x["cover"], "ground_truth_sentence_extraction", x["said"], lacking)).otherwise(out(x["long"], "append_missing_concepts_to_original_short_answer", x["put"], lacking))

    both = F.struct(with_concepts(own, lacking).alias("long"), (greedy_cover(truth, concepts) if cover is None else cover).alias("cover"))
    judged = let(both, lambda b: let(F.struct(b["long"].alias("long"), b["cover"].alias("cover"), phrase_coverage(concepts, b["long"]).alias("put"), phrase_coverage(concepts, b["cover"]).alias("said")), pick))
    return F.when(too_few, judged).otherwise(out(own, "kept_original_short_answer", phrase_coverage(concepts, own), F.array().cast("array<string>")))
