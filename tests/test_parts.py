"""Evaluation, training, dialogue, files and streams."""

import json
import random
import zipfile

import pytest
from pyspark.sql import functions as F

from plumbline.operators import decide, dialog, dims, evaluate, score, search, train
from plumbline.operators.dims import build
from plumbline.plans import batch
from plumbline.plans.lookup import Lookup
from plumbline.sources import files
from plumbline.streaming.lookups import answer_stream

ROWS = [("e1", "Москва", "улица", "Ленина", "5", 0), ("e2", "Москва", "улица", "Ленина", "5", 1), ("e3", "Самара", "улица", "Мира", "", 2), ("e4", "москва", "проспект", "Мира", "10А", 3)]
DICT = "etalon_id string, city string, street_type string, street string, house string, seq long"


def test_dims(spark):
    d = build(spark.createDataFrame(ROWS, DICT))
    assert [(r.name_id, r.name) for r in d.names.orderBy("name_id").collect()] == [(0, "ленина"), (1, "мира")]
    assert {(r.street_id, r.house): r.etalon_id for r in d.houses.collect()} == {("москва||улица||0", "5"): "e2", ("москва||проспект||1", "10а"): "e4"}
    assert {r.street_id: len(r.top_houses) for r in d.objects.collect()} == {"москва||улица||0": 1, "самара||улица||1": 0, "москва||проспект||1": 1}
    assert {r.city_id: r.display for r in d.cities.collect()} == {"москва": "Москва", "самара": "Самара"}
    assert d.street_types == ["проспект", "улица"]
    length = d.grams.groupBy("name_id").agg(F.sum(F.col("weight") * F.col("weight")).alias("l")).collect()
    assert all(abs(r.l - 1) < 1e-9 for r in length)


def test_search_paths_agree_on_near_names(spark):
    d = build(spark.createDataFrame(ROWS, DICT))
    asked = spark.createDataFrame([("ленена",), ("миро",), ("",), (None,)], "q string")
    best = lambda full: {r.q: r.name for r in search.nearest_names(asked, d, 1, full).collect()}
    assert best(True) == best(False) == {"ленена": "ленина", "миро": "мира"}


def test_nearest_names_without_a_common_gram(spark):
    rng = random.Random(3)
    words = ["нитап", "мир", *("".join(rng.choice("аимнпрст") for _ in range(rng.randint(2, 9))) for _ in range(60))]
    d = build(spark.createDataFrame([(f"e{k}", "Москва", "улица", w, "5", k) for k, w in enumerate(dict.fromkeys(words))], DICT))
    asked = spark.createDataFrame([(w,) for w in ("мирас", "пуск", "щёголь", "аа", "стрим", "q")], "q string")
    for k in (1, 20):
        found = lambda full: sorted((r.q, r.name_rank, r.name, round(r.lev, 9), round(r.phon, 9), round(r.ngram, 9)) for r in search.nearest_names(asked, d, k, full).collect())  # noqa: B023, E731
        assert found(False) == found(True) and len(found(False)) == 6 * k


def test_cities(spark):
    d = build(spark.createDataFrame(ROWS, DICT))
    asked = spark.createDataFrame([("Москва", None), ("масква", None), ("", None), ("кемерово", None), ("москва", ["самара"]), ("москва", ["нет"])], "q string, scope array<string>")
    got = {(r.q, tuple(r.scope or ())): (r.status, r.city_id) for r in search.resolve_cities(asked, d).collect()}
    assert got["Москва", ()] == got["масква", ()] == got["москва", ("нет",)] == ("resolved", "москва")
    assert got["", ()][0] == "none" and got["кемерово", ()][0] == "unresolved" and got["москва", ("самара",)][0] == "unresolved"


def test_metrics_of_nothing_and_predictions(spark):
    empty = spark.createDataFrame([], "candidates array<string>, label string, ms double")
    assert set(evaluate.metrics(empty).first()) == {0, 0.0}
    twice = spark.createDataFrame([("a", ["x"], [0.1], 0), ("a", ["y"], [0.2], 1)], "id string, candidates array<string>, scores array<double>, seq long")
    assert evaluate.last_predictions(twice).first().candidates == ["y"]


def test_half_coverage(spark):
    counts = spark.createDataFrame([("a", 5), ("b", 3), ("c", 3), ("d", 1)], "name string, c long")
    assert tuple(evaluate.half_coverage(counts).first()) == (2, 12)


def test_calibrators(spark):
    ps = [0.0, 0.1, 0.3, 0.5, 0.65, 0.8, 1.0]
    rows = spark.createDataFrame([(p,) for p in ps], "p double")
    iso = {"type": "isotonic", "x": [0.1, 0.3, 0.5, 0.8], "y": [0.05, 0.2, 0.55, 0.9]}
    got = [r[0] for r in rows.select(score.calibrated(iso, F.col("p"), F.col("p"))).collect()]
    assert got == pytest.approx([0.05, 0.05, 0.2, 0.55, 0.725, 0.9, 0.9])
    platt = [r[0] for r in rows.select(score.calibrated({"type": "platt", "a": 2.0, "b": -0.5}, F.col("p"), F.col("p"))).collect()]
    assert platt == sorted(platt)


def test_model_files(spark, tmp_path):
    model = {"version": 1, "feature_names": ["street_sim", "phon"], "coef": [1.0, 2.0], "intercept": -1.0, "freq_median": 0.5, "global_calibrator": {"type": "identity", "n": 3}, "strata_calibrators": {"voice|freq_low|resolved": {"type": "platt", "a": 1.0, "b": 0.0, "n": 20}}, "seed": 1}
    files.save_model(spark, model, str(tmp_path / "model"))
    ranker, warning = files.load_ranker(spark, str(tmp_path / "model"))
    assert warning is None and ranker.coef == [1.0, 2.0] and ranker.strata["voice|freq_low|resolved"]["a"] == 1.0
    ranker, warning = files.load_ranker(spark, str(tmp_path / "none"))
    assert isinstance(ranker, score.ManualRanker) and warning
    with pytest.raises(ValueError):
        score.TrainedRanker({"feature_names": ["other"], "coef": [1.0], "intercept": 0.0})


def test_training(spark):
    rng = random.Random(0)
    rows = []
    for k in range(300):
        y = float(k % 3 == 0)
        rows.append((y, min(1.0, max(0.0, 0.3 + 0.5 * y + rng.gauss(0, 0.15))), rng.random(), float(k % 2), 1.0))
    frame = spark.createDataFrame(rows, "y double, street_sim double, name_freq double, channel_voice double, city_match double")
    model = train.fit(frame, frame, features=["street_sim", "name_freq"])
    assert model["coef"][0] > abs(model["coef"][1]) and model["global_calibrator"]["type"] == "isotonic"
    scored = frame.withColumn("p", score.TrainedRanker(model).score())
    good = scored.filter((F.col("p") >= 0.5) == (F.col("y") > 0)).count()
    assert good >= 260
    labels = spark.createDataFrame([(str(k), "voice" if k % 4 else "webchat", "x" if k % 5 else None) for k in range(200)], "id string, channel string, label string")
    halves = train.split(labels).groupBy("is_val").count().collect()
    counts = {r.is_val: r["count"] for r in halves}
    assert 50 <= counts[True] <= 54 and sum(counts.values()) == 200  # a quarter of each group, rounded up


def test_predictions_files(spark, tmp_path):
    good = spark.createDataFrame([("a", ["x"], [0.5]), ("b", [], [])], "id string, candidates array<string>, scores array<double>")
    files.write_predictions(good, str(tmp_path / "p"))
    assert files.check_predictions(spark, str(tmp_path / "p"), 2) == "OK 2"
    with pytest.raises(ValueError):
        files.check_predictions(spark, str(tmp_path / "p"), 3)
    (tmp_path / "bad.json").write_text('{"id": "a", "candidates": ["x", "y"], "scores": [1]}\n{broken\n')
    with pytest.raises(ValueError, match="length_differs"):
        files.check_predictions(spark, str(tmp_path / "bad.json"), 2)


def test_request_files(spark, tmp_path):
    lines = [{"id": "1", "channel": "voice", "city": "Москва", "raw_adress": "улица мира", "etalon_id": "e"}, {"id": "2", "channel": "webchat", "raw_adress": "мира"}]
    (tmp_path / "r.jsonl").write_text("\n\n".join(json.dumps(x, ensure_ascii=False) for x in lines) + "\n", encoding="utf-8")
    got = files.read_requests(spark, str(tmp_path / "r.jsonl")).orderBy("id").collect()
    assert [(r.id, r.slot_city_text, r.label) for r in got] == [("1", "Москва", "e"), ("2", "", None)]
    assert files.read_requests(spark, str(tmp_path / "r.jsonl"), "webchat").count() == 1


def test_register(spark, tmp_path):
    body = "<A>" + "".join(f'<OBJECT NAME="Мира {k % 3}" TYPENAME="ул" LEVEL="{8 if k % 2 else 5}" ISACTUAL="1" ISACTIVE="{k % 5 and 1}"/>' for k in range(20)) + "</A>"
    with zipfile.ZipFile(tmp_path / "g.zip", "w") as z:
        z.writestr("77/AS_ADDR_OBJ_20240101_x.XML", body)
        z.writestr("77/AS_ADDR_OBJ_PARAMS_20240101.XML", body)
    objects = files.read_register(spark, str(tmp_path / "g.zip"))
    assert objects.count() == 20 and objects.first().region == "77"
    totals = files.register_statistics(objects)["totals"].first()
    assert (totals.streets, totals.settlements, totals.regions) == (8, 8, 1)


def test_register_members_are_rows_of_their_own(spark, tmp_path):
    for archive in ("a b.zip", "c.zip"):
        with zipfile.ZipFile(tmp_path / archive, "w") as z:
            for region in ("01", "02"):
                z.writestr(f"{region}/AS_ADDR_OBJ_20240101_x.XML", "<A>" + f'<OBJECT NAME="{archive}"/>' * 5001 + "</A>")
    found = files.read_register(spark, str(tmp_path / "*.zip")).groupBy("region", "name").count().collect()
    assert sorted(map(tuple, found)) == [(r, a, 5001) for r in ("01", "02") for a in ("a b.zip", "c.zip")]


def test_number_rows_and_rank_in_parts(spark):
    rows = spark.createDataFrame([(f"{(k * 7919) % 1000:03}",) for k in range(1000)], "name string").repartition(7)
    assert [(r.n, r.name) for r in dims.number_rows(rows, "name", "n").orderBy("n").collect()] == [(k, f"{k:03}") for k in range(1000)]
    assert dims.number_rows(rows.filter("false"), "name", "n").count() == 0


def test_evaluate_files(spark, tmp_path):
    entries = [{"etalon_id": f"e{k}", "city": "Алматы", "street_type": "улица", "street": s, "house": "1"} for k, s in enumerate(["Мира", "Абая", "Сатпаева"])]
    entries.append(entries[0] | {"etalon_id": "e9"})
    asked = [{"id": "1", "channel": "webchat", "city": "Алматы", "raw_adress": "улица Мира 1", "etalon_id": "e9"}, {"id": "2", "channel": "webchat", "raw_adress": "", "etalon_id": None}, {"id": "3", "channel": "voice", "raw_adress": "спасибо"}]
    for name, lines in (("d", entries), ("r", asked)):
        (tmp_path / name).write_text("\n".join(json.dumps(x, ensure_ascii=False) for x in lines), encoding="utf-8")
    got = json.loads(batch.evaluate_files(spark, str(tmp_path / "r"), str(tmp_path / "d"), str(tmp_path / "p")))
    assert len(got) == 9 and (got["n"], got["top1"], got["reject_recall"]) == (3, 1.0, 1.0) and got["ms_per_request_p50"] > 0
    assert files.check_predictions(spark, str(tmp_path / "p"), 3) == "OK 3"
    assert json.loads(batch.evaluate_files(spark, str(tmp_path / "r"), str(tmp_path / "d"), channel="voice"))["n"] == 1


def test_dialogue_and_stream(spark, tmp_path):
    look = Lookup(spark.createDataFrame([("s60", "Москва", "улица", "Мира", "60", 0)], DICT))
    asked = spark.createDataFrame([("1", "voice", "мира", "Москва", "s60")], "id string, channel string, raw string, slot_city_text string, label string")
    first = look.match(asked).select("id", "decision", "leader_street_id", "leader_city_id").join(asked, "id")
    truth = spark.createDataFrame([("1", "60", "москва")], "id string, true_house string, true_city_id string")
    turn = dialog.second_turn(first, truth)
    second = look.match(turn).select("id", "decision", "candidates").join(turn.select("id", "first_decision"), "id").join(asked.select("id", "label"), "id")
    rates = dialog.dialogue_rates(second).first()
    assert (rates.n_ask_house, rates.ask_house_resolved) == (1, 1.0)
    assert dialog.gate(3, 0.1) == "low data" and dialog.gate(30, 0.96) == "pass" and dialog.gate(30, 0.5) == "fail"
    houses = dialog.house_parses(spark.createDataFrame([("101к5",), ("10комната 513",)], "h string"), "h").collect()
    assert [r.house_parses for r in houses] == [True, False]
    asked.drop("label").write.parquet(str(tmp_path / "in"))
    source = spark.readStream.schema(asked.drop("label").schema).parquet(str(tmp_path / "in"))
    answer_stream(source, look, str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination(120)
    assert spark.read.parquet(str(tmp_path / "out")).first().decision == "ask_house"


def test_rankers_are_chosen_by_name(spark, tmp_path):
    own = score.ManualRanker()
    assert files.choose_ranker(spark, own) == (own, None)
    for name in (None, "manual"):
        ranker, warning = files.choose_ranker(spark, name)
        assert isinstance(ranker, score.ManualRanker) and warning is None
    ranker, warning = files.choose_ranker(spark, "logreg", str(tmp_path / "none.json"))
    assert isinstance(ranker, score.ManualRanker) and "not loaded" in warning
    with pytest.raises(ValueError, match="unknown ranker 'best'"):
        files.choose_ranker(spark, "best")


def test_reports_and_register_document(spark, tmp_path):
    rows = spark.createDataFrame([("s", k / 40, float(k % 2)) for k in range(40)] + [("t", 0.95, 0.0)] * 12, "stratum string, p double, y double")
    lines = files.reliability_lines(*evaluate.reliability(rows)).splitlines()
    assert lines[-1] == "GLOBAL_MAX_DEV\t0.9500"
    objects = spark.createDataFrame([("01", f" {n} ", "ул", "8", "1", "1") for n in "aaab"] + [("02", "c", "г", "5", "1", "1"), ("02", "d", "ул", "8", "0", "1")], "region string, name string, typename string, level string, isactual string, isactive string")
    made = files.write_register_statistics(objects, str(tmp_path / "out"))
    assert made["streets"] == 4 and made["unique_names"] == 2 and made["settlements"] == 1 and made["names_for_half"] == 1 and made["names"][0] == ["a", 3]
    [part] = list((tmp_path / "out").glob("part-*"))
    assert json.loads(part.read_text()) == json.loads(json.dumps(made))
    classes = spark.createDataFrame([("wrong_object", 1, ["7"])], "class string, n long, examples array<string>")
    counts = spark.createDataFrame([("answer", 1, 0)], "decision string, positive long, negative long")
    shown = spark.createDataFrame([("wrong_object", "7", "raw", "A, t s, 1", "A, t s, 1", "answer", 0.5, True)], "class string, id string, raw string, etalon string, got string, decision string, p double, duplicate boolean")
    report = files.report_markdown(counts, classes, shown)
    assert "| 7 | raw | A, t s, 1 | A, t s, 1 | answer | 0.500 | duplicate entry |" in report


def test_top1_gap_and_verdict(spark):
    rows = spark.createDataFrame([("train", ["a"], "a"), ("train", ["b"], "a"), ("val", ["a"], "a"), ("val", [], None)], "part string, candidates array<string>, label string")
    assert evaluate.top1_gap(rows).first().top1_gap_pp == 50.0
    good = {"answer_errors": 3, "coverage": 0.75, "type2_reject_rate": 0.85}
    assert evaluate.meets_gates(good, 0.1, 5.0) and not evaluate.meets_gates(good, 0.11, 5.0) and not evaluate.meets_gates(good | {"answer_errors": 4}, 0.1, 5.0)


def test_ranked_cuts_objects_before_the_shuffle(spark):
    rng = random.Random(5)
    rows = [(str(k % 3), f"s{n}", rng.choice([0, 1, 2, None]), rng.choice("abcdef"), rng.randint(0, 9) / 10, rng.choice([0.1, 0.2, 0.7, 0.9]), 0.5, 1, n) for n, k in enumerate(range(600))]
    d = spark.createDataFrame(rows, "id string, street_id string, name_id int, city_id string, p double, name_freq double, city_match double, name_rank int, obj_seq int")
    d = d.withColumns({c: F.lit("") for c in ("name", "city_name", "street_type", "matched_id")} | {"street_sim": F.lit(0.5), "top_houses": F.array()})
    out = decide.ranked(d)
    for got in out.collect():
        mine = sorted((r for r in rows if r[0] == got.id), key=lambda r: (-r[4], r[8]))
        lead, opened = mine[0][2], {}
        for r in mine:
            if r[2] is not None and r[2] == lead:
                opened.setdefault(r[3], r)
        read = {r[8]: r for r in mine[:2] + list(opened.values())[:3]}.values()
        assert [x.street_id for x in got.r] == [r[1] for r in sorted(read, key=lambda r: (-r[4], r[8]))]
        freq = sorted(r[5] for r in mine)
        assert got.freq_median == pytest.approx((freq[99] + freq[100]) / 2)
    assert "WindowGroupLimit" in out._jdf.queryExecution().executedPlan().toString()
