"""Text normalisation as Column expressions; only the number words need a UDF."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import numerals
from .numerals import LETTER_NAMES, digits_udf, is_house_trigger, is_number_word

# Limits, look-alike letters, abbreviations (an empty one drops the word), stop words.
MAX_CHARS = 512
LATIN, CYRILLIC = "aeopcxykmthb", "аеорсхукмтнв"
ABBREVIATIONS = {"ул": "улица", "пр-т": "проспект", "просп": "проспект", "пр": "проспект", "пер": "переулок", "б-р": "бульвар", "бул": "бульвар", "ш": "шоссе", "наб": "набережная", "пл": "площадь", "пр-д": "проезд", "мкр": "микрорайон", "кв-л": "квартал", "д": "", "дом": "", "лит": "", "к": "к", "корп": "к", "корпус": "к", "стр": "с"}
STOP_WORDS = [
    "живу", "я", "на", "мне", "удобно", "ну", "вот", "это", "самое", "если", "знаете", "как", "бы", "давайте", "мой", "адрес", "рядом", "с", "домом",
    "так", "короче", "а", "э", "там", "тут", "вроде", "кажется", "значит",
]


def rules_version() -> str:
    """Short hash of the rule tables."""
    rules = repr((MAX_CHARS, LATIN, CYRILLIC, sorted(ABBREVIATIONS.items()), STOP_WORDS, sorted(numerals.NUMBERS.items()), sorted(LETTER_NAMES.items())))
    return hashlib.sha1(rules.encode()).hexdigest()[:12]


def words(text: Column) -> Column:
    """Non-empty words between runs of white space."""
    return F.filter(F.split(text, r"(?U)\s+"), lambda w: w != "")


def lower_but_house_letters(text: Column) -> Column:
    """Lower case, except a capital that ends a house number."""
    kept = r"\d+к?[А-ЯЁ](?![а-яА-ЯёЁ0-9])"
    pieces = F.regexp_extract_all(text, F.lit(rf"({kept}|(?s:.))"), F.lit(1))
    return F.array_join(F.transform(pieces, lambda x: F.when(F.length(x) > 1, x).otherwise(F.lower(x))), "")


def latin_to_cyrillic(text: Column) -> Column:
    """Look-alike Latin letters of words that have a Cyrillic letter."""
    swap = lambda w: F.when(w.rlike("[а-яё]"), F.translate(w, LATIN, CYRILLIC)).otherwise(w)
    return F.array_join(F.transform(F.split(text, " ", -1), swap), " ")


def expand_abbreviations(tokens: Column) -> Column:
    """Whole-word abbreviations spelled out or dropped."""
    table = F.create_map(*[F.lit(x) for pair in ABBREVIATIONS.items() for x in pair])
    return F.filter(F.transform(tokens, lambda w: F.coalesce(F.try_element_at(table, w), w)), lambda w: w != "")


def drop_stop_words(tokens: Column) -> Column:
    """Stop words go, but for three that matter beside numbers; a fold, as one rule looks at what was kept."""
    following = lambda i: F.get(tokens, i + 1)

    def step(kept: Column, i: Column) -> Column:
        word, last = F.get(tokens, i), F.try_element_at(kept, F.lit(-1))
        keep = (
            F.when(word == "короче", F.coalesce(F.lower(following(i)).isin(sorted(LETTER_NAMES)), F.lit(False)))
            .when(word == "а", F.coalesce(is_number_word(last) | is_house_trigger(last), F.lit(False)))
            .when(word == "с", F.coalesce(is_number_word(following(i)), F.lit(False)))
            .otherwise(~word.isin(STOP_WORDS))
        )
        return F.when(keep, F.concat(kept, F.array(word))).otherwise(kept)

    spots = F.when(F.size(tokens) > 0, F.sequence(F.lit(0), F.size(tokens) - 1)).otherwise(F.array().cast("array<int>"))
    return F.aggregate(spots, F.array().cast("array<string>"), step)


def collapse_spaces(text: Column) -> Column:
    """One space for each run of white space, none at the ends."""
    return F.trim(F.regexp_replace(text, r"(?U)\s+", " "))


def clean(text: Column, channel: Column) -> Column:
    """Everything before number words and stop words: case, look-alikes, punctuation, glued digits."""
    t = lower_but_house_letters(F.substring(F.coalesce(text, F.lit("")), 1, MAX_CHARS))
    t = F.translate(t, "ё", "е")
    t = F.when(channel == "webchat", latin_to_cyrillic(t)).otherwise(t)
    t = F.regexp_replace(t, r"(?U)[^\w\s/\-]|_", " ")
    t = F.regexp_replace(t, r"(?<![0-9а-яё])[/\-]|[/\-](?![0-9а-яё])", " ")
    t = F.regexp_replace(t, r"([а-яё]{3,})(\d+)|(\d+)([а-яё]{3,})", "$1$3 $2$4")
    return F.regexp_replace(t, r"(?<![а-яёА-ЯЁ])д(\d+)", "д $1")


def normalised(df: DataFrame, source: str, channel: str | Column = "voice", into: str = "norm") -> DataFrame:
    """``df`` with a struct (text, truncated, ambiguous) from column ``source``.

    Each step is a column of its own, so no step is evaluated twice.
    """
    by = F.lit(channel) if isinstance(channel, str) else channel
    steps = df.withColumn("__clean", clean(F.col(source), by))
    steps = steps.withColumn("__words", expand_abbreviations(words(F.col("__clean"))))
    steps = steps.withColumn("__kept", F.array_join(drop_stop_words(F.col("__words")), " "))
    steps = steps.withColumn("__digits", digits_udf("__kept"))
    glued = F.regexp_replace(F.col("__digits.text"), r"(?<![а-яёА-ЯЁ0-9])(\d+)\s+([а-яё])(?![а-яёА-ЯЁ0-9])", "$1$2")
    result = F.struct(
        collapse_spaces(glued).alias("text"),
        (F.coalesce(F.char_length(source), F.lit(0)) > MAX_CHARS).alias("truncated"),
        F.col("__digits.ambiguous").alias("ambiguous"),
    )
    return steps.withColumn(into, result).drop("__clean", "__words", "__kept", "__digits")
