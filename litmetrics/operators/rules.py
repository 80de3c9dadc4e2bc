"""Decision rules and rule-based baselines over the normal form (Title, Abstract, Venue, Type)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import vocabulary as V
from ..functions.text import clean_text, has, has_part, has_words, keyword_is_survey

def is_non_paper(title: Column, kind: Column) -> Column:
    return has(clean_text(title), V.NON_PAPER_TITLES) | has(kind, V.NON_PAPER_TYPES)


def has_no_metadata(abstract: Column, venue: Column, kind: Column) -> Column:
    blank = lambda c: F.trim(F.coalesce(c, F.lit(""))) == ""
    return blank(venue) & blank(kind) & ~has_words(abstract, V.MIN_WORDS_MISSING)  # abstracts are long: few have to be read


def categorize(title: Column, abstract: Column, venue: Column, kind: Column, is_survey: Column) -> Column:
    """survey, research or non-paper; title-only records are decided by their title keywords."""
    bare = has_no_metadata(abstract, venue, kind)
    survey = F.when(bare, keyword_is_survey(title)).otherwise(is_survey)
    return F.when(is_non_paper(title, kind), "non-paper").when(survey, "survey").otherwise("research")


def indexer_is_review(kind: Column) -> Column:
    return has(kind, "review")


def title_phrase_tool(title: Column) -> Column:
    return has_part(title, V.TITLE_TOOL_PHRASES)


def strict_phrase_rule(title: Column, abstract: Column, venue: Column, kind: Column) -> Column:
    phrase = has(F.concat_ws(" ", clean_text(title), clean_text(abstract)), V.STRICT_PHRASES)
    return has(kind, V.REVIEW_TYPES) & (phrase | has_part(venue, V.REVIEW_VENUES))


def usable_record(title: Column, abstract: Column) -> Column:
    return (title != "") & has_words(abstract, V.MIN_WORDS_TRAIN) & ~has(title, V.JUNK_TITLES)


def is_hard_case(title: Column, kind: Column) -> Column:
    """Research-venue rows to set aside: not an article, or a title like a survey's."""
    return ~kind.isin("article") | has(title, V.TITLE_TERMS)


def stratum(title: Column, abstract: Column) -> Column:
    return F.when(has(title, V.TITLE_TERMS), "title_kw").when(has(abstract, V.SAMPLER_CUE), "abstract_cue").otherwise("random")


def same_person(name_a: Column, name_b: Column) -> Column:
    """Equal last names and first initials, hyphens read as blanks, case ignored."""
    fold = lambda c: F.split(F.lower(F.trim(F.translate(c, "-‐", "  "))), r"\s+")
    a, b = fold(name_a), fold(name_b)
    return (F.element_at(a, -1) == F.element_at(b, -1)) & (F.substring(F.element_at(a, 1), 1, 1) == F.substring(F.element_at(b, 1), 1, 1))
