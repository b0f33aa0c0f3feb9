"""Lemma variants from a dictionary table, for words that are not their own lemma."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T

MAX_VARIANTS = 3


def variants(tokens: DataFrame, dictionary: DataFrame, max_variants: int = MAX_VARIANTS) -> DataFrame:
    """``(token, lemma, variants)`` for the distinct ``tokens(token)``.

    ``dictionary(token, forms array<string>, known boolean)`` has each word's normal forms, likeliest first. Words without Cyrillic
    letters are their own form. Others have up to ``max_variants`` distinct forms, and the word itself where the dictionary only guessed
    (``known`` is false) or does not have it.
    """
    own = F.array(F.col("token"))
    joined = tokens.select("token").distinct().join(dictionary, "token", "left")
    forms = F.slice(F.array_distinct(F.transform("forms", lambda f: F.translate(f, "ё", "е"))), 1, max_variants)
    found = F.when(~F.col("token").rlike("[а-я]") | F.col("forms").isNull() | (F.size("forms") == 0), own).when(F.col("known"), forms).otherwise(F.array_union(forms, own))
    return joined.select("token", F.get(found, 0).alias("lemma"), found.alias("variants"))


def text_variants(texts: DataFrame, key: str, column: Column, dictionary: DataFrame, by_lemma: bool) -> DataFrame:
    """``(key, pos, variants)`` of each word. ``by_lemma``: a word whose lemma is a stopword goes (queries); else stopword forms go (documents).

    Each distinct word meets the dictionary once; texts get their words' forms back by a join.
    """
    words = texts.select(key, F.posexplode(T.tokenize(column)).alias("pos", "token"))
    known = variants(words.select("token"), dictionary)
    joined = words.join(known, "token")
    if by_lemma:
        return joined.where(~T.is_stopword(F.col("lemma"))).select(key, "pos", "variants")
    return joined.select(key, "pos", F.filter("variants", lambda v: ~T.is_stopword(v)).alias("variants")).where(F.size("variants") > 0)
