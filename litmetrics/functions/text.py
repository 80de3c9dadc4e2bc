"""Text functions as Column -> Column expressions; nulls count as empty text."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import vocabulary as V

FLAGS = "(?iU)"  # case-insensitive, Unicode classes
FOLDED = "\u017f\u212a\u0130\u0131"  # all letters beyond ASCII that these flags take for one of a to z: s, k, i and i


def text_of(c: Column) -> Column:
    return F.coalesce(c.cast("string"), F.lit(""))


def collapse(c: Column) -> Column:
    """White space runs as one blank, none at the ends."""
    return F.trim(F.regexp_replace(c, r"(?U) \s+|[\s&&[^ ]]\s*", " "))  # single blanks stay, and need no copy


def clean_text(c: Column) -> Column:
    """Text without formulas, markup, LaTeX commands and brackets, and without a leading "abstract"."""
    text = cut = text_of(c)
    for pattern in V.CUT_MARKUP:
        cut = F.regexp_replace(cut, pattern, " ")
    cut = F.when(text.rlike(V.MARKUP), cut).otherwise(text)  # one look at the texts that have nothing to cut
    return collapse(F.regexp_replace(cut, FLAGS + V.CUT_HEADING, ""))


def clean_record_text(c: Column) -> Column:
    """The builder's own cleaner: tags, a leading "abstract", a copyright notice up to the end of the text's last line."""
    c = F.regexp_replace(text_of(c), V.CUT_TAGS, " ")
    c = F.regexp_replace(c, FLAGS + V.CUT_HEADING, "")
    return collapse(F.regexp_replace(c, "(?id)" + V.CUT_NOTICE, ""))


def paper_text(title: Column, abstract: Column) -> Column:
    t, a = clean_text(title), clean_text(abstract)
    return F.when(a != "", F.concat(t, F.lit(". "), a)).otherwise(t)


def norm_title(c: Column) -> Column:
    """Join key: ASCII letters and digits of the lowered title."""
    return F.regexp_replace(F.lower(text_of(c)), "[^a-z0-9]", "")


def unicode_title(c: Column) -> Column:
    """Join key that keeps letters and digits of every script."""
    return F.regexp_replace(F.lower(text_of(c)), r"[^\p{L}\p{N}]", "")


def spaced_title(c: Column) -> Column:
    """Join key that keeps punctuation."""
    return collapse(F.lower(text_of(c)))


def word_count(c: Column) -> Column:
    return F.regexp_count(text_of(c), F.lit(r"(?U)\S+")).cast("long")


def has_words(c: Column, n: int) -> Column:
    """Whether there are n words (one at least), without counting the rest."""
    return text_of(c).rlike(rf"(?U)^\s*+(?:\S++\s++){{{n - 1}}}\S")


def item_count(c: Column) -> Column:
    """Non-blank items between semicolons."""
    return F.size(F.filter(F.split(text_of(c), ";"), lambda x: F.trim(x) != "")).cast("long")


def may_have(c: Column, stems: tuple[str, ...]) -> Column:
    """False only where none of the stems (in lower case) is in the text in any case; plain search costs less than an
    expression that is tried at every letter. Texts with one of FOLDED may have anything."""
    low = F.lower(text_of(c))
    return reduce(or_, [F.contains(low, F.lit(s)) for s in stems] + [F.contains(text_of(c), F.lit(x)) for x in FOLDED])


def has(c: Column, alternatives: str, stems: tuple[str, ...] = ()) -> Column:
    """stems: one of them at least is in all that the alternatives match, and texts without any are not searched further."""
    found = text_of(c).rlike(FLAGS + V.word_bound(alternatives))
    return F.when(may_have(c, stems), found).otherwise(False) if stems else found


def has_part(c: Column, alternatives: str) -> Column:
    return text_of(c).rlike(FLAGS + f"(?:{alternatives})")


def capped_count(c: Column, alternatives: str, most: int = 3, stems: tuple[str, ...] = ()) -> Column:
    """stems: as in `has`."""
    found = F.least(F.regexp_count(text_of(c), F.lit(FLAGS + V.word_bound(alternatives))), F.lit(most)).cast("long")
    return F.when(may_have(c, stems), found).otherwise(F.lit(0).cast("long")) if stems else found


def keyword_is_survey(title: Column) -> Column:
    return has(clean_text(title), V.TITLE_KEYWORDS)


def rebuild_abstract(index: Column) -> Column:
    """Text of an inverted index {word: [places]}: words in the order of their places, then alphabetically."""
    pairs = F.flatten(F.transform(F.map_entries(index), lambda e: F.transform(e["value"], lambda p: F.struct(p.alias("p"), e["key"].alias("w")))))
    return F.array_join(F.transform(F.sort_array(pairs), lambda x: x["w"]), " ")


def inverted_index(texts: Column) -> Column:
    """{word: [places]} of the words between blanks of an array of texts, from one sort of them; null without words."""
    words = F.transform(texts, lambda t: F.transform(F.filter(F.split(t, " "), lambda x: x != ""), lambda w, i: F.struct(w.alias("w"), i.alias("p"))))
    return F.transform(F.array(F.sort_array(F.flatten(words))), _index_of)[0]


def _index_of(ordered: Column) -> Column:
    n = F.size(ordered)
    starts = F.filter(F.sequence(F.lit(0), n - 1), lambda i: (i == 0) | (F.get(ordered, i)["w"] != F.get(ordered, i - 1)["w"]))
    places = lambda a, b: F.transform(F.slice(ordered, a + 1, b - a), lambda x: x["p"])
    entries = lambda own: F.map_from_entries(F.transform(own, lambda i, k: F.struct(F.get(ordered, i)["w"], places(i, F.coalesce(F.get(own, k + 1), n)))))
    return F.when(n > 0, F.transform(F.array(starts), entries)[0])


def logit(p: Column, edge: float = 1e-4) -> Column:
    p = F.least(F.greatest(p, F.lit(edge)), F.lit(1 - edge))
    return F.log(p / (1 - p))


def last_segment(url: Column) -> Column:
    return F.element_at(F.split(text_of(url), "/"), -1)


def doi_key(c: Column) -> Column:
    """A DOI without the resolver before it, lowered; null for blanks."""
    return F.nullif(F.regexp_replace(F.lower(F.trim(text_of(c))), r"^https?://(dx\.)?doi\.org/", ""), F.lit(""))


def seeded(*parts: Column | str) -> Column:
    """A reproducible pseudo-random order key that every SQL engine can compute."""
    return F.md5(F.concat_ws("-", *[F.col(p).cast("string") if isinstance(p, str) else p.cast("string") for p in parts]))
