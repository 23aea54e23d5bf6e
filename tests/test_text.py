"""Literal goldens of normalisation, numbers, slots and phonetic keys."""

from pyspark.sql import functions as F

from plumbline.functions import numerals, parsing, similarity, text

NUMBERS = [
    ("сто шестьдесят три", "163", False), ("сто одиннадцать", "111", False), ("дватцать васемь", "28", False),
    ("улица правды читыре", "улица правды 4", False), ("два к два", "2к2", False), ("шестьдесяд один корпус один", "61к1", False),
    ("восемнадцать к а", "18кА", False), ("18 к а", "18кА", False), ("сорок восемь короче бэ", "48Б", False),
    ("сто пятьдесятдва к два", "152к2", False), ("дом сто", "дом 100", False), ("горькогосто шестьдесят три", "горького 163", False),
    ("три сто", "3 100", True), ("улица ленина без цифр вообще", "улица ленина без цифр вообще", False), ("", "", False),
    ("индустри 57", "индустри 57", False), ("восемнадцать а", "18 а", False), ("семь дробь два", "7к2", False),
    ("сорок шесть тробь один", "46к1", False), ("семь карпус один", "7к1", False), ("сто девяносто пять пэ", "195П", False),
    ("два гэ", "2Г", False), ("три ка", "3К", False), ("26кА", "26кА", False), ("три кдва", "3к2", False),
    ("семьдесят восемь кб", "78кБ", False), ("двадтсать пять", "25", False), ("шестнадцать корпус п1", "16кП1", False),
    ("пятнадцать два", "17", False), ("5 г 2", "5к2", False),
]
TEXTS = [
    ("webchat", "ул. красной армии, д. 10", "улица красной армии 10"), ("voice", "прописан шоссе рублёвское дом 70 к 6", "прописан шоссе рублевское 70к6"),
    ("webchat", "улица мoсковская 5", "улица московская 5"), ("voice", "улица мoсковская 5", "улица мoсковская 5"),
    ("voice", "живу я на улица мира дом пять", "улица мира 5"), ("webchat", "проспект ленина стр. 5", "проспект ленина с 5"),
    ("voice", "рядом с домом улица мира 5", "улица мира 5"), ("voice", "живу металлургов23", "металлургов 23"),
    ("voice", "смоленской 1 а", "смоленской 1а"), ("voice", "живу улица рабочи-крестьянская дом 30", "улица рабочи-крестьянская 30"),
    ("voice", "дом 26 дробь а", "26кА"), ("voice", "Академика Киреснкого д67", "академика киреснкого 67"),
    ("voice", None, ""), ("voice", "", ""),
]
SLOTS = [
    ("улица ленина 16", {"house": "16", "street": "ленина", "street_type": "улица"}), ("улица ленина 16а", {"house": "16а"}),
    ("улица ленина 16к2", {"house": "16к2"}), ("улица ленина 16/2", {"house": "16к2"}), ("улица ленина 16-18", {"house": "16", "house_range": True}),
    ("улица ленина 16 кв 5", {"house": "16", "street": "ленина", "tail_tokens": []}),
    ("шахтеров 111", {"street_type": None, "street": "шахтеров", "house": "111", "city_hint": None}),
    ("красноярск улица космонавтов 17а", {"city_hint": "красноярск", "street": "космонавтов", "house": "17а"}),
    ("шоссемосковское 5", {"street_type": "шоссе", "street": "московское", "house": "5"}), ("60", {"house": "60", "street": None, "has_cues": True}),
    ("красноярск", {"street": "красноярск", "house": None, "city_hint": None}), ("улица ленина", {"has_cues": True}),
    ("хочу заказать пиццу", {"has_cues": False}), ("проспект ленинградский 3 1", {"house": "3", "tail_tokens": ["1"], "ambiguous": True}),
    ("", {"street": None, "house": None, "street_type": None, "city_hint": None, "has_cues": False}),
    ("2-я портовая 5", {"house": "5", "street": "2-я портовая"}), ("улица 60 лет октября 7", {"house": "7", "street": "60 лет октября"}),
    ("улица 95 гвардейской 10", {"house": "95", "street": None}), ("улица мира 5 с 3", {"house": "5с3"}),
    ("московская улица 5", {"city_hint": "московская", "street": None, "house": "5"}), ("улица ленина 52/а", {"house": "52ка"}),
]


def test_numbers():
    assert [numerals.words_to_digits(raw) for raw, *_ in NUMBERS] == [(to, broken) for _, to, broken in NUMBERS]


def test_normalised_texts_and_idempotence(spark):
    rows = spark.createDataFrame([(k, c, t) for k, (c, t, _) in enumerate(TEXTS)], "k int, channel string, raw string")
    once = text.normalised(rows, "raw", F.col("channel")).select("k", "channel", F.col("norm.text").alias("raw"))
    got = {r.k: r.raw for r in once.collect()}
    assert [got[k] for k in range(len(TEXTS))] == [to for *_, to in TEXTS]
    again = text.normalised(once, "raw", F.col("channel")).select("k", F.col("norm.text").alias("t"))
    assert {r.k: r.t for r in again.collect()} == got


def test_truncation_and_version(spark):
    row = text.normalised(spark.createDataFrame([("улица ленина " * 60,)], "raw string"), "raw").first()
    assert row.norm.truncated and len(row.norm.text) <= text.MAX_CHARS
    assert len(text.rules_version()) == 12 and text.rules_version() == text.rules_version()


def test_slots(spark):
    rows = spark.createDataFrame([(k, t) for k, (t, _) in enumerate(SLOTS)], "k int, t string")
    got = {r.k: r.parse.asDict() for r in parsing.parsed(rows, "t").collect()}
    for k, (raw, want) in enumerate(SLOTS):
        assert {f: got[k][f] for f in want} == want, raw


def test_phonetic_keys(spark):
    pairs = [("киравсгой", "кировская", "кирафск"), ("пирвомайсгий", "первомайский", "пирфамайск"), ("симверопольский", "симферопольский", "симфирапалск")]
    rows = spark.createDataFrame(pairs, "a string, b string, key string")
    for r in rows.select(similarity.phonetic_key(F.col("a")).alias("a"), similarity.phonetic_key(F.col("b")).alias("b"), "key").collect():
        assert r.a == r.b == r.key


def test_similarities(spark):
    assert similarity.weighted("масква", "москва") >= 80 > similarity.weighted("кемерово", "москва")
    assert similarity.token_set("улица мира", "мира улица новая") == 100.0
    assert similarity.token_set("", "x") == 0.0
    row = spark.createDataFrame([("киравсгой", "кировская", "ab c")], "a string, b string, t string").select(
        similarity.edit_similarity(F.col("a"), F.col("b")).alias("e"), similarity.word_grams(F.col("t")).alias("g")
    ).first()
    assert abs(row.e - (1 - 4 / 9)) < 1e-12
    assert row.g == [" a", "ab", "b ", " ab", "ab ", " ab ", " c", "c ", " c "]
