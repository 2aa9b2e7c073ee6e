"""Person names: tokens, the relation of two names, the best match (T-9 to T-11, J-16)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quillwork.functions.text import clean, left_of_dash, let

# Suffixes and honorifics that are no part of a name.
SUFFIXES = "jr sr ii iii iv phd md esq".split()
HONORIFICS = "dr mr mrs ms".split()

# Short and full given names that count as one.
NICKNAMES = [
    "ron ronald", "bob robert", "rob robert", "pete peter", "matt matthew", "jim james", "steve steven", "fred frederick", "joe joseph",
    "monty montgomery", "mike michael", "jack john", "al allan", "al alvin", "doug douglas", "don donald", "ed edward", "ray raymond",
    "hank william", "bill william", "dick richard", "jerry gerald", "jeff jeffery", "jeff jeffrey", "jeffery jeffrey", "rick richard",
    "steve stephen", "steven stephen",
]

# Surnames and their known misspellings in transcripts.
SURNAME_VARIANTS = ["macmillan macmilllan", "taiclet taicle"]

# Relations, the best first; the first six are accepted.
RELATIONS = [
    "exact_full_name", "same_first_last_middle_difference", "initial_prefix_plus_given_name", "initial_prefix_plus_recognized_nickname", "recognized_nickname_last_name",
    "recognized_transcription_variant", "same_initial_last_name_review", "same_last_name_different_first_name", "no_match",
]
ACCEPTED = RELATIONS[:6]


def name_tokens(c: Column) -> Column:
    """T-9: letters-only tokens of the part left of ' - ' and of the first comma, without suffixes and leading honorifics."""
    bare = F.regexp_replace(F.split(left_of_dash(clean(c)), ",", 2)[0], "['’]", "")
    found = F.filter(F.regexp_extract_all(F.lower(bare), F.lit("[a-z]+"), F.lit(0)), lambda t: ~t.isin(*SUFFIXES))
    lead = F.aggregate(found, F.struct(F.lit(0).alias("n"), F.lit(True).alias("on")), lambda s, t: F.struct((s["n"] + F.when(s["on"] & t.isin(*HONORIFICS), 1).otherwise(0)).alias("n"), (s["on"] & t.isin(*HONORIFICS)).alias("on")))["n"]
    return F.slice(found, lead + 1, F.greatest(F.size(found) - lead, F.lit(0)))


def _paired(a: Column, b: Column, pairs: list[str]) -> Column:
    listed = F.array(*[F.lit(" ".join(sorted(p.split()))) for p in pairs])
    return F.array_contains(listed, F.concat_ws(" ", F.least(a, b), F.greatest(a, b)))


def relation(expected: Column, labelled: Column) -> Column:
    """T-10: how two names relate; the order of the cases matters."""
    return let(F.struct(name_tokens(expected).alias("a"), name_tokens(labelled).alias("b")), lambda t: _relation(t["a"], t["b"]))


def _relation(a: Column, b: Column) -> Column:
    first_a, first_b, second_a = F.get(a, F.lit(0)), F.get(b, F.lit(0)), F.get(a, F.lit(1))
    last_a, last_b = F.try_element_at(a, F.lit(-1)), F.try_element_at(b, F.lit(-1))
    variant, nickname = _paired(last_a, last_b, SURNAME_VARIANTS), _paired(first_a, first_b, NICKNAMES)
    initial = (F.length(first_a) == 1) & (F.size(a) >= 3)
    return (
        F.when((F.size(a) < 2) | (F.size(b) < 2), "no_match")
        .when((last_a != last_b) & ~variant, "no_match")
        .when(variant & ((first_a == first_b) | nickname), "recognized_transcription_variant")
        .when(a == b, "exact_full_name")
        .when(first_a == first_b, "same_first_last_middle_difference")
        .when(initial & (second_a == first_b), "initial_prefix_plus_given_name")
        .when(initial & _paired(second_a, first_b, NICKNAMES), "initial_prefix_plus_recognized_nickname")
        .when(nickname, "recognized_nickname_last_name")
        .when(F.substring(first_a, 1, 1) == F.substring(first_b, 1, 1), "same_initial_last_name_review")
        .otherwise("same_last_name_different_first_name")
    )


def best_match(expected: Column, labels: Column) -> Column:
    """T-11: struct (quality, labels) of the best relation and all labels that have it; no_match and none for no labels."""
    order = F.array(*[F.lit(r) for r in RELATIONS])
    ranked = F.transform(labels, lambda x: F.struct(F.array_position(order, relation(expected, x)).alias("rank"), x.alias("label")))

    def best(ranks: Column) -> Column:
        top = F.array_min(F.transform(ranks, lambda r: r["rank"]))
        of_top = F.transform(F.filter(ranks, lambda r: r["rank"] == top), lambda r: r["label"])
        return F.struct(F.coalesce(F.get(order, top.cast("int") - 1), F.lit("no_match")).alias("quality"), of_top.alias("labels"))

    return let(ranked, best)
