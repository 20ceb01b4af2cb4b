"""Readability, keywords and search intent as native expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Words that carry no topic, for readability and for keyword lists.
STOP_WORDS = (
    "a an and are as at be but by for from had has have he her here his i in into is it its me my of on or our ours "
    "she so that the their them there these they this those to was we were what when where which who will with would "
    "you your yours can could do does did not now than then very http https www"
).split()
KEYWORD_STOP_WORDS = (
    "a an and are as at be by for from has he in is it its of on or that the to was will with this but not you all "
    "can her what which who am have if me my these those your about could does"
).split()
#: Words that tell what a searcher wants; the first list that hits decides.
KEYWORD_INTENTS = {
    "Informational": (
        "what how why when where guide tutorial tips best top learn understand explain definition vs comparison review "
        "article blog news"
    ).split(),
    "Transactional": "buy price coupon discount order shop sale deal offer purchase checkout cart cost fee".split(),
    "Navigational": [*"login signin register facebook twitter instagram youtube app download official".split(), "sign up"],
}
TERM_INTENTS = {
    "transactional": "buy price coupon discount order shop compare sale".split(),
    "navigational": "login signin signup facebook twitter instagram youtube".split(),
    "informational": [*"how what why guide tutorial best tips".split(), "how to", "?"],
}


def squeezed(text: Column) -> Column:
    """Runs of (Unicode) white space as one blank, outer ones gone; null becomes ''."""
    return F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"(?U)\s+", " "))


def words(text: Column) -> Column:
    """ASCII words of two characters or more, in order."""
    return F.regexp_extract_all(text, F.lit(r"[A-Za-z][A-Za-z'\-]+"), F.lit(0))


def topic_words(text: Column, stop_words: list[str] = STOP_WORDS) -> Column:
    lower = F.transform(words(text), lambda w: F.lower(w))
    return F.filter(lower, lambda w: (F.length(w) > 2) & ~w.isin(stop_words))


def syllables(word: Column) -> Column:
    """Groups of vowels; a final es or ed is silent; short words have one."""
    low = F.lower(word)
    groups = F.size(F.regexp_extract_all(low, F.lit("[aeiouy]+"), F.lit(0)))
    silent = low.rlike("(es|ed)$") & (groups > 1)
    return F.when(F.length(low) <= 3, F.lit(1)).otherwise(F.greatest(F.lit(1), groups - silent.cast("int")))


def analyse(text: Column, target_keyword: str = "") -> dict[str, Column]:
    """The measures of one text, by name. ``text`` should be squeezed page text."""
    found, topics = words(text), topic_words(text)
    n = F.size(found)
    pieces = F.filter(F.split(text, r"(?<=[.!?])\s+"), lambda s: F.trim(s) != "")
    sentences = F.greatest(F.lit(1), F.size(pieces))
    total = F.aggregate(F.transform(found, syllables), F.lit(0), lambda a, x: a + x)
    per_sentence = n / sentences
    ease = F.lit(206.835) - F.lit(1.015) * per_sentence - F.lit(84.6) * (total / F.nullif(n, F.lit(0)))
    target = target_keyword.strip().lower()
    return {
        "word_count": n,
        "unique_word_count": F.size(F.array_distinct(topics)),
        "sentence_count": sentences,
        "paragraph_count": F.when(text == "", 0).otherwise(1),
        "avg_sentence_length": F.when(n > 0, F.round(per_sentence, 1)).otherwise(F.lit(0.0)),
        "syllable_count": total,
        "flesch_reading_ease": F.coalesce(F.round(ease, 1), F.lit(0.0)),
        "reading_time_minutes": F.greatest(F.lit(1), F.bround(n / 200).cast("int")),
        "target_keyword_count": F.size(F.filter(found, lambda w: F.lower(w) == target)) if target else F.lit(0),
    }


def paragraphs(raw: Column) -> Column:
    """Non-blank paragraphs of a text as it was written."""
    return F.size(F.filter(F.split(F.coalesce(raw, F.lit("")), r"\n\s*\n"), lambda p: F.trim(p) != ""))


def with_counts(frame: DataFrame, words: str, name: str) -> DataFrame:
    """``frame`` with ``name``: the distinct words of an array as (word, n, seen), by word; seen is the first place, from 0.

    A row's words are sorted and counted within the row, so nothing is shuffled. Explode the
    result with ``explode_outer``: the filter that a plain explode implies is pushed below
    the steps that make it, and makes them anew for every element.
    """
    placed = F.sort_array(F.transform(words, lambda w, i: F.struct(w.alias("word"), i.alias("seen"))))
    at = lambda i: F.get("_sorted", i - 1)
    begins = F.filter(F.sequence(F.lit(1), F.size("_sorted")), lambda i: (i == 1) | (at(i)["word"] != at(i - 1)["word"]))
    ends = F.concat(F.slice("_begins", 2, F.size("_begins")), F.array(F.size("_sorted") + 1))
    run = lambda a, b: F.struct(at(a)["word"].alias("word"), (b - a).cast("long").alias("n"), at(a)["seen"].alias("seen"))
    none = F.array().cast("array<struct<word:string,n:bigint,seen:int>>")
    # Steps of their own: an array that later steps look into often is made once.
    some = frame.withColumn("_sorted", placed).withColumn("_begins", F.when(F.size("_sorted") > 0, begins))
    return some.withColumn(name, F.when(F.size("_sorted") > 0, F.zip_with("_begins", ends, run)).otherwise(none)).drop("_sorted", "_begins")


def keywords(text: Column, least_length: int = 2, stop_words: list[str] = KEYWORD_STOP_WORDS) -> Column:
    """Lower-cased (Unicode) words without stop words, in order."""
    found = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(r"(?U)\b\w+\b"), F.lit(0))
    return F.filter(found, lambda w: (F.length(w) >= least_length) & ~w.isin(stop_words))


def _intent(text: Column, lists: dict[str, list[str]], otherwise: str) -> Column:
    low, out = F.lower(text), None
    for name, terms in lists.items():
        hit = low.rlike("|".join(t.replace("?", r"\?") for t in terms))
        out = F.when(hit, name) if out is None else out.when(hit, name)
    return out.otherwise(otherwise)


def keyword_intent(keyword: Column) -> Column:
    return _intent(keyword, KEYWORD_INTENTS, "Mixed")


def term_intent(term: Column) -> Column:
    return _intent(term, TERM_INTENTS, "unknown")


def variations(keyword: Column) -> Column:
    """The keyword, its plural unless it ends in s, and seven phrases with it."""
    before = [F.concat(F.lit(p), keyword) for p in ("what is ", "how to ", "best ")]
    after = [F.concat(keyword, F.lit(p)) for p in (" tips", " guide", " tutorial", " tools")]
    plural = F.when(~keyword.endswith("s"), F.concat(keyword, F.lit("s")))
    return F.filter(F.array(keyword, plural, *before, *after), lambda v: v.isNotNull())


def phrase_words(keyword: Column) -> Column:
    return F.size(F.filter(F.split(keyword, r"\s+"), lambda w: w != ""))


def difficulty(keyword: Column, frequency: Column, total: Column) -> dict[str, Column]:
    """Rarer is harder, longer is easier: score from 0 to 100 and its level."""
    ratio = F.when(total > 0, frequency / total).otherwise(F.lit(0.0))
    n = phrase_words(keyword)
    score = F.greatest(F.lit(0.0), F.least(F.lit(100.0), (1 - ratio) * 100 - n * F.lit(0.1) * 10))
    return {
        "difficulty_score": F.round(score, 1),
        "level": F.when(score < 30, "Easy").when(score < 60, "Medium").otherwise("Hard"),
        "word_count": n,
        "frequency_ratio": F.round(ratio, 4),
    }


def opportunity(keyword: Column, frequency: Column, total: Column, rankings: int = 0) -> dict[str, Column]:
    """Frequent and long keywords that don't rank yet promise most: score from 0 to 100 and its priority."""
    often = F.when(total > 0, F.least(F.lit(100.0), frequency / total * 100 * 2)).otherwise(F.lit(0.0))
    long = F.least(F.lit(100.0), phrase_words(keyword) * F.lit(15.0))
    penalty = rankings * 20
    score = F.greatest(F.lit(0.0), F.least(F.lit(100.0), often * 0.4 + long * 0.4 - penalty * 0.2))
    return {
        "opportunity_score": F.round(score, 1),
        "frequency_component": F.round(often, 1),
        "length_component": F.round(long, 1),
        "rank_penalty": F.lit(penalty),
        "priority": F.when(score >= 70, "High").when(score >= 40, "Medium").otherwise("Low"),
    }
