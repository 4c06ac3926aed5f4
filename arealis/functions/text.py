"""Text metrics as expressions of built-in functions: tokens, sentences, syllables, style shares, term scans."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Hedging words, and endings of nouns made from verbs.
HEDGES = ("may", "might", "could", "suggest", "suggests", "appear", "appears", "possibly", "likely")
NOMINAL = "(tion|ment|ness|ity)$"
#: A form of to be before a participle in -ed, the mark of the passive.
PASSIVE = r"(?i)\b(?:is|are|was|were|be|been|being)\s+[a-z]+ed\b"


def cleaned(text: Column, boilerplate: str) -> Column:
    """Without lines that match boilerplate; runs of blank lines become one."""
    lines = F.filter(F.split(text, "\n"), lambda x: ~F.trim(x).rlike(boilerplate))
    return F.trim(F.regexp_replace(F.array_join(lines, "\n"), "\n{3,}", "\n\n"))


def words(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit("([A-Za-z][A-Za-z'-]*)"), F.lit(1))


def _at_least(n: int) -> str:
    """So many words: a possessive match takes each word to its end."""
    return rf"(?s)(?:[A-Za-z][A-Za-z'-]*+.*?){{{n}}}"


# Counts over a text's words, joined by one blank: one pass of a pattern over the text, no function for each word.


def word_count(joined: str | Column) -> Column:
    return F.regexp_count(joined, F.lit("[^ ]+"))


def nominal_count(joined: str | Column) -> Column:
    return F.regexp_count(joined, F.lit("(?i)(?:tion|ment|ness|ity)(?= |$)"))


def syllable_count(joined: str | Column) -> Column:
    """As the sum of syllables(): groups of vowels, plus words without any, less final silent e's."""
    groups = F.regexp_count(joined, F.lit("(?i)[aeiouy]+"))
    bare = F.regexp_count(joined, F.lit("(?i)(?<![^ ])[^aeiouy ]+(?= |$)"))
    silent = F.regexp_count(joined, F.lit("(?i)[aeiouy][^aeiouy ]+[^ ]*(?<!l)e(?= |$)"))
    return groups + bare - silent


def sentences(text: Column, least: int = 4) -> Column:
    """Parts that end in ., ! or ? before white space, of at least so many words."""
    parts = F.split(F.regexp_replace(text, r"([.!?])\s+", "$1\u0001"), "\u0001")
    return F.filter(parts, lambda x: x.rlike(_at_least(least)))


def paragraphs(text: Column, least: int = 8) -> Column:
    return F.filter(F.split(text, r"\n\s*\n"), lambda x: x.rlike(_at_least(least)))


def syllables(word: Column) -> Column:
    """Groups of vowels, less a silent final e, at least one."""
    w = F.lower(word)
    groups = F.size(F.regexp_extract_all(w, F.lit("([aeiouy]+)"), F.lit(1)))
    silent = (w.rlike("e$") & ~w.rlike("le$") & (groups > 1)).cast("int")
    return F.greatest(groups - silent, F.lit(1))


def total(array: Column, f) -> Column:
    return F.aggregate(F.transform(array, f), F.lit(0), lambda a, x: a + x)


def section_metrics(text: Column) -> dict[str, Column]:
    """Counts and shares of a text, as named columns."""
    w, s = words(text), sentences(text)
    n = F.size(w)
    n_syllables = total(w, syllables)
    per = lambda x: F.try_divide(x.cast("double"), n.cast("double"))
    lower = F.transform(w, lambda x: F.lower(x))
    return {
        "n_words": n,
        "n_sentences": F.size(s),
        "n_syllables": n_syllables,
        "grade": F.try_divide(n.cast("double") * 0.39, F.size(s).cast("double")) + F.try_divide(n_syllables.cast("double") * 11.8, n.cast("double")) - 15.59,
        "nominal_share": per(F.size(F.filter(lower, lambda x: x.rlike(NOMINAL)))),
        "hedge_share": per(F.size(F.filter(lower, lambda x: x.isin(*HEDGES)))),
        "passive_share": F.try_divide(F.regexp_count(text, F.lit(PASSIVE)).cast("double"), F.size(s).cast("double")),
        "numeric_share": per(F.size(F.regexp_extract_all(text, F.lit(r"(\d+)"), F.lit(1)))),
    }


def term_hits(text: Column, terms: Sequence[str]) -> Column:
    """Those of the terms that the text holds as whole words, whatever their case."""
    found = [F.when(text.rlike(rf"(?i)\b{t}\b"), F.lit(t)) for t in terms]
    return F.array_compact(F.array(*found))


# ---- counts of a manuscript's style ----

#: Terms that hedge and terms that lead over, counted wherever they stand in the lower-case text.
HEDGE_TERMS = ("associated", "association", "suggest", "suggests", "may", "might", "could", "potential", "plausibly", "consistent", "unclear", "limited")
TRANSITION_TERMS = ("however", "although", "while", "despite", "therefore", "consequently", "in contrast", "in addition")
#: Words and numbers; forms of to be before a participle; nouns made from verbs and adjectives; numbers. Letters are ASCII.
BLANK = r"[ \t\n\f\r]"
TOKEN = r"[A-Za-z]+(?:[-'][A-Za-z]+)?|\d+(?:\.\d+)?%?"
PASSIVES = rf"(?:is|are|was|were|be|been|being){BLANK}+(?:\w+ly{BLANK}+)?\w+(?:ed|en)"
NOUNS = r"\w+(?:tion|sion|ment|ance|ence|ity|ness|ability|ization|isation)"
NUMBERS = r"\d+(?:\.\d+)?"
#: Fixed value: numbers of citations behind a full stop.
CITED = r"\d+(?:[-–]\d+)?(?:,\d+(?:[-–]\d+)?)*"


def whole(pattern: str) -> str:
    """pattern between what is no ASCII letter, digit or underscore."""
    return rf"(?<!\w)(?:{pattern})(?!\w)"


def cited_sentences(text: Column, least: int = 4) -> Column:
    """Parts that end in ., ! or ? before white space and a capital or bracket, with numbers of citations between or behind left out, of so many words at least."""
    flat = F.regexp_replace(text, f"{BLANK}+", " ")
    cut = F.regexp_replace(F.regexp_replace(flat, rf"([.!?])({CITED}) +([A-Z(])", "$1$2\u0001$3"), r"([.!?]) +([A-Z(])", "$1\u0001$2")
    parts = F.transform(F.split(cut, "\u0001"), lambda x: F.regexp_replace(F.trim(x), rf"([.!?]){CITED}$", "$1"))
    return F.filter(parts, lambda x: F.regexp_count(x, F.lit(TOKEN)) >= least)


def linear_quantile(ordered: Column, share: float) -> Column:
    """Of an array in ascending order, between its two nearest members; null if it is empty."""
    at = (F.size(ordered) - 1) * F.lit(share)
    low = F.floor(at)
    value = lambda k: F.element_at(ordered, (k + 1).cast("int")).cast("double")
    return F.when(F.size(ordered) > 0, value(low) * (1 - (at - low)) + value(F.least(low + 1, F.size(ordered) - 1)) * (at - low))


def sentence_lengths(text: str | Column) -> Column:
    """Words of each of a text's sentences (citations aside), in ascending order."""
    t = F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))
    return F.array_sort(F.transform(cited_sentences(t), lambda x: F.regexp_count(x, F.lit(TOKEN))))


def style_counts(text: str | Column, lengths: Column | None = None) -> list[Column]:
    """Named columns of a text's style: words, sentences (citations aside) with their lengths, and flags counted over the whole text.

    lengths may be a column that holds sentence_lengths(): many of the results hang on it, and Spark would work it out for each.
    """
    t = F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))
    low = F.lower(t)
    lengths = sentence_lengths(t) if lengths is None else lengths
    mean = F.try_divide(F.aggregate(lengths, F.lit(0), lambda a, x: a + x).cast("double"), F.size(lengths).cast("double"))
    terms = lambda some: sum((F.regexp_count(low, F.lit(x)) for x in some), F.lit(0))
    return [
        F.regexp_count(t, F.lit(TOKEN)).alias("n_words"), F.size(lengths).alias("n_sentences"), mean.alias("mean_sentence"), *[linear_quantile(lengths, q).alias(f"p{int(100 * q)}_sentence") for q in (0.25, 0.5, 0.75)],
        F.regexp_count(low, F.lit(whole(PASSIVES))).alias("passives"), F.regexp_count(low, F.lit(whole(NOUNS))).alias("nominalisations"), F.regexp_count(t, F.lit(rf"(?<!\w){NUMBERS}(?:%(?=\w)|(?!\w))")).alias("numbers"),
        terms(HEDGE_TERMS).alias("hedges"), terms(TRANSITION_TERMS).alias("transitions"),
    ]


def sections(df: DataFrame, key: str, text: str, heading: str) -> DataFrame:
    """(key, section, name, first_line, last_line, n_words): from each line that heading matches as a whole to the line before the next such line.

    What stands before a text's first heading is section 0, without a name, if there is any. Texts without lines have no rows. Lines are numbered from 1;
    a heading that comes again begins a section of its own.
    """
    lines = df.select(key, F.posexplode(F.split(F.col(text), "\r\n|\n|\r")).alias("at", "line"))
    head = F.trim("line").rlike(f"^(?:{heading})$")
    upto = Window.partitionBy(key).orderBy("at")  # of one text's lines
    lines = lines.withColumn("_head", head).withColumn("section", F.sum(F.col("_head").cast("int")).over(upto))
    names = F.max(F.when(F.col("_head"), F.trim("line")))
    body = F.sum(F.when(~F.col("_head"), F.regexp_count("line", F.lit(TOKEN))).otherwise(0))
    return lines.groupBy(key, "section").agg(names.alias("name"), (F.min("at") + 1).alias("first_line"), (F.max("at") + 1).alias("last_line"), body.alias("n_words"))
