"""Text functions as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Letters that look alike, in the same order; letters that only one alphabet has; words that carry no meaning.
LATIN_TWINS = "aeopcxykmthb"
CYRILLIC_TWINS = "аеорсхукмтнв"
LATIN_ONLY = "[dfgijlnqrsuvwz]"
CYRILLIC_ONLY = "[бгдежзийлпфцчшщъыьэюя]"
STOPWORDS = "и в во на с со по для к ко о об от из у за а но же ли бы то это как что или при".split()
# Emoji ranges (those that are counted, those that cleaning drops), the keys of query filters, the headings that an item's parameters use, and prefixes of filter values.
COUNTED_EMOJI = r"[\x{1F300}-\x{1FAFF}\x{2600}-\x{27BF}]"
EMOJI = r"[\x{1F000}-\x{1FAFF}☀-➿⬀-⯿️‍⃣]"
FILTER_KEYS = [
    "Вид услуги", "Тип услуги автосервиса", "Тип услуги", "Онлайн-запись", "Кто оказывает услуги", "Рейтинг пользователя",
    "Срочная услуга", "Где вы оказываете", "Ваши клиенты", "Опыт работы", "Гарантия", "Выезд за город", "Работа по договору",
    "Работа в праздники", "Специальность", "Предмет или", "Цена с НДС", "Доставка",
]
ITEM_PREFIX = {"vid": "Вид услуги ", "tip": "Тип услуги ", "tip_auto": "Тип услуги автосервиса "}
FOUR_STARS = "Рейтинг пользователя 4 звезды"
KIND_ENDS = ["Место оказания услуг", "Тип услуги", "Тип стоимости", "Вид услуги"]
NAME_ENDS = ["Начальная цена", "Тип стоимости", "Стоимость", "Продолжительность"]


def _text(c: Column | str) -> Column:
    return F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit(""))


def fix_homoglyphs(c: Column | str) -> Column:
    """Words that mix the two alphabets in one of them: that of a letter without a twin, else that of most letters, else Cyrillic."""
    c = _text(c)

    def one(word: Column) -> Column:
        cyr, lat = F.regexp_count(word, F.lit("[а-я]")), F.regexp_count(word, F.lit("[a-z]"))
        only_cyr, only_lat = word.rlike(CYRILLIC_ONLY), word.rlike(LATIN_ONLY)
        to_lat = F.translate(word, CYRILLIC_TWINS, LATIN_TWINS)
        to_cyr = F.translate(word, LATIN_TWINS, CYRILLIC_TWINS)
        mixed = (cyr > 0) & (lat > 0)
        latin_wins = (only_lat & ~only_cyr) | ((only_lat == only_cyr) & (lat > cyr))
        return F.when(mixed & latin_wins, to_lat).when(mixed, to_cyr).otherwise(word)

    repaired = F.array_join(F.transform(F.regexp_extract_all(c, F.lit(r"(?U)\w+|\W+"), F.lit(0)), one), "")
    return F.when(c.rlike("[а-я]") & c.rlike("[a-z]"), repaired).otherwise(c)


def _lowered(c: Column | str) -> Column:
    return F.translate(F.lower(_text(c)), "ё", "е")


def normalize(c: Column | str) -> Column:
    """Lower case, one alphabet a word, letter/letter abbreviations glued, everything but letters and digits one space."""
    glued = F.regexp_replace(fix_homoglyphs(_lowered(c)), r"(?U)\b(\w)/(\w)\b", "$1$2")
    return F.trim(F.regexp_replace(glued, "[^0-9a-zа-я]+", " "))


def tokenize(c: Column | str) -> Column:
    return F.filter(F.split(normalize(c), " "), lambda w: w != "")


def is_stopword(w: Column) -> Column:
    return w.isin(STOPWORDS)


def lemma_tokens(c: Column | str, max_words: int | None = None) -> Column:
    """The first words of a text without stopwords, for texts whose words are their own lemmas.

    Words in Cyrillic need a dictionary: see ``operators.lemmas``.
    """
    words = tokenize(c)
    words = F.slice(words, 1, max_words) if max_words else words
    return F.filter(words, lambda w: ~is_stopword(w))


def clean(c: Column | str) -> Column:
    """Lower case, one alphabet a word, no emoji, no repeated marks, single spaces."""
    s = F.regexp_replace(fix_homoglyphs(_lowered(c)), f"{EMOJI}+", " ")
    s = F.regexp_replace(s, r"(?U)([^\w\s])\1+", "$1")
    return strip(F.regexp_replace(s, r"(?U)\s+", " "))


def strip(c: Column | str) -> Column:
    return F.regexp_replace(_text(c), r"(?U)^\s+|\s+$", "")


def words(c: Column | str) -> Column:
    return F.filter(F.split(_text(c), r"(?U)\s+"), lambda w: w != "")


def word_count(c: Column | str) -> Column:
    return F.size(words(c))


def emoji_share(c: Column | str) -> Column:
    return F.regexp_count(_text(c), F.lit(COUNTED_EMOJI)) / (word_count(c) + 1)


def up_to_capital(c: Column, max_words: int = 8) -> Column:
    """The first word and those after it up to the first capitalised one."""
    w = F.slice(words(c), 1, max_words)
    capital = F.transform(w, lambda x, i: (i > 0) & F.substring(x, 1, 1).rlike(r"^\p{Lu}"))
    stop = F.array_position(capital, True).cast("int")
    return F.array_join(F.when(stop > 0, F.slice(w, F.lit(1), F.greatest(stop - 1, F.lit(0)))).otherwise(w), " ")


def _between(c: Column, head: str, ends: list[str]) -> Column:
    return F.regexp_extract_all(c, F.lit(f"{head} (.+?)(?={'|'.join(' ' + e for e in ends)}|$)"), F.lit(1))


def params_short(c: Column | str, max_names: int = 8) -> Column:
    """Kinds, types and names of services from an item's parameters."""
    c = _text(c)
    cut = lambda xs: F.array_distinct(F.transform(xs, lambda v: up_to_capital(v)))
    kinds = cut(F.filter(_between(c, "Вид услуги", KIND_ENDS), lambda v: ~v.startswith("Место") & ~v.startswith("Тип")))
    types = cut(F.filter(_between(c, "Тип услуги(?: автосервиса)?", KIND_ENDS), lambda v: ~v.startswith("Место") & ~v.startswith("Вид")))
    names = F.slice(F.filter(cut(_between(c, "(?:Название услуги|Услуги)", NAME_ENDS)), lambda n: (n != "") & (F.length(n) < 80)), 1, max_names)
    part = lambda label, xs, sep: F.when(F.size(xs) > 0, F.concat(F.lit(label), F.array_join(xs, sep)))
    return clean(F.concat_ws(". ", part("вид услуги: ", kinds, ", "), part("тип услуги: ", types, ", "), part("услуги: ", names, "; ")))


def item_text(title: Column | str, params: Column | str, desc: Column | str, rep: str = "tpd", desc_words: int = 120) -> Column:
    """An item's text for an encoder or n-grams: title, parameters, start of the description."""
    nonempty = lambda x: F.when(x != "", x)
    parts = [clean(title)]
    if "p" in rep:
        parts.append(nonempty(params_short(params)))
    if "d" in rep:
        parts.append(nonempty(F.array_join(F.slice(words(clean(desc)), 1, desc_words), " ")))
    return F.concat_ws(". ", *parts)


def query_text(query: Column | str, filters: Column | str, with_filters: bool = False) -> Column:
    q = clean(query)
    return F.when(_text(filters) != "", F.concat(q, F.lit(". "), clean(filters))).otherwise(q) if with_filters else q


def parse_query_filters(c: Column | str) -> Column:
    """``struct<vid, tip, tip_auto: array<string>, rating4: boolean>``: a value ends before the next known key."""
    c = _text(c)
    ends = f"(?={'|'.join(' ' + k for k in FILTER_KEYS)}|$)"
    heads = {"vid": "Вид услуги", "tip": "Тип услуги(?! автосервиса)", "tip_auto": "Тип услуги автосервиса"}

    def values(head: str) -> Column:
        found = F.regexp_extract_all(c, F.lit(f"{head} (.+?){ends}"), F.lit(1))
        kept = F.filter(found, lambda v: ~v.startswith("Вид услуги") & ~v.startswith("Тип услуги"))
        return F.filter(F.transform(kept, lambda v: F.trim(v)), lambda v: v != "")

    return F.struct(*[values(h).alias(k) for k, h in heads.items()], c.contains(FOUR_STARS).alias("rating4"))


def item_matches(values: Column, params: Column | str, key: str) -> Column:
    """NULL without such a filter, else 1.0 or 0.0: whether an item's parameters have one of its values."""
    any_of = F.exists(values, lambda v: _text(params).contains(F.concat(F.lit(ITEM_PREFIX[key]), v)))
    return F.when(F.size(values) > 0, F.when(any_of, 1.0).otherwise(0.0))


def classifier_words(query: Column | str, filters: Column | str) -> Column:
    """Words of a query and, marked, of its filters."""
    return F.concat(lemma_tokens(query), F.transform(lemma_tokens(filters), lambda w: F.concat(F.lit("F_"), w)))


def char_ngrams(c: Column, low: int, high: int) -> Column:
    """Character n-grams inside words, each word between two spaces."""

    def grams(word: Column) -> Column:
        padded = F.concat(F.lit(" "), word, F.lit(" "))
        size = F.length(padded)
        def of(n: int) -> Column:
            starts = F.sequence(F.lit(1), F.greatest(size - n + 1, F.lit(1)))
            return F.when(size >= n, F.transform(starts, lambda i: F.substring(padded, i, F.lit(n)))).otherwise(F.array().cast("array<string>"))

        return F.concat(*[of(n) for n in range(low, high + 1)])

    return F.flatten(F.transform(F.filter(F.split(c, r"\s+"), lambda w: w != ""), grams))


def valid_item_id(c: Column) -> Column:
    return c.rlike("^[0-9a-f]{16}$")
