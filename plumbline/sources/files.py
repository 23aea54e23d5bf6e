"""Readers and writers: request and dictionary lines, models, predictions, metrics, reports, XML registers."""

from __future__ import annotations

import json
import re
import xml.etree.ElementTree as ET
import zipfile
from collections.abc import Iterator
from urllib.parse import unquote

import pyarrow as pa
from pyarrow.fs import FileSystem, LocalFileSystem
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.evaluate import half_coverage, violations
from ..operators.score import ManualRanker, TrainedRanker
from ..schema import DICTIONARY, MODEL, PREDICTION, REQUEST

MEMBER = re.compile(r"^(\d+)/AS_ADDR_OBJ_\d{8}")
OBJECT_FIELDS = ("NAME", "TYPENAME", "LEVEL", "ISACTUAL", "ISACTIVE")
XML_ROWS = 5000


def read_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON lines with an explicit schema; blank lines are skipped, broken ones fail the read."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def read_dictionary(spark: SparkSession, path: str) -> DataFrame:
    """Dictionary lines with ``seq``, their order: by file name, place in the file, and line there, in however many splits they are read."""
    place = F.struct("_metadata.file_path", "_metadata.file_block_start", F.monotonically_increasing_id().alias("line"))
    return read_lines(spark, path, DICTIONARY).withColumn("seq", place)


def read_requests(spark: SparkSession, path: str, channel: str | None = None) -> DataFrame:
    """Request lines as (id, channel, raw, slot_city_text, label), of one channel if given."""
    rows = read_lines(spark, path, REQUEST)
    rows = rows if channel is None else rows.filter(F.col("channel") == channel)
    return rows.select("id", F.coalesce("channel", F.lit("voice")).alias("channel"), F.coalesce("raw_adress", F.lit("")).alias("raw"), F.coalesce("city", F.lit("")).alias("slot_city_text"), F.col("etalon_id").alias("label"))


def load_ranker(spark: SparkSession, path: str | None) -> tuple[ManualRanker | TrainedRanker, str | None]:
    """Ranker of a model file and no warning, or the manual ranker and why the file could not be used."""
    if path is None:
        return ManualRanker(), None
    try:
        row = spark.read.schema(MODEL).option("multiLine", True).option("mode", "FAILFAST").json(path).first()
        return TrainedRanker({k: v for k, v in row.asDict(recursive=True).items() if v is not None}), None
    except Exception as problem:  # whatever is wrong with the file, requests are still answered
        return ManualRanker(), f"trained ranker not loaded: {str(problem).splitlines()[0][:200]}"


def choose_ranker(spark: SparkSession, ranker=None, path: str | None = None) -> tuple[ManualRanker | TrainedRanker, str | None]:
    """Ranker by name, and a warning: None or "manual", "logreg" (of the model file, the manual one if it can't be used), or a ranker as it is.

    Another name raises, so that no request is answered by a ranker that nobody asked for.
    """
    if ranker is None or ranker == "manual":
        return ManualRanker(), None
    if ranker == "logreg":
        return load_ranker(spark, path) if path else (ManualRanker(), "trained ranker not loaded: no model file is named")
    if isinstance(ranker, str):
        raise ValueError(f"unknown ranker {ranker!r}: expected manual, logreg or a ranker")
    return ranker, None


def save_model(spark: SparkSession, model: dict, path: str) -> None:
    """Model document as one JSON file in a folder."""
    text = json.dumps(model, ensure_ascii=False, indent=2)
    spark.createDataFrame([(text,)], "value string").coalesce(1).write.mode("overwrite").text(path)


def write_predictions(results: DataFrame, path: str) -> None:
    """Predictions as JSON lines (id, candidates, scores)."""
    results.select("id", "candidates", "scores").write.mode("overwrite").json(path)


def check_predictions(spark: SparkSession, path: str, expected: int) -> str:
    """"OK n" for a valid predictions file; raises with the counts of what is wrong."""
    raw = spark.read.schema(PREDICTION + ", _broken string").option("columnNameOfCorruptRecord", "_broken").json(path).cache()
    broken = raw.filter("_broken IS NOT NULL").count()
    found = violations(raw.drop("_broken"), expected).first().asDict()
    raw.unpersist()
    if broken or any(found.values()):
        raise ValueError(f"predictions are not valid: {found | {'broken_json': broken}}")
    return f"OK {expected}"


def metrics_line(metrics: DataFrame) -> str:
    """The single row of metrics as one JSON object."""
    return metrics.toJSON().first()


def reliability_lines(table: DataFrame, worst: DataFrame) -> str:
    """Tab-separated reliability table, each stratum's largest deviation and the largest of all; at most ten bins for each of a handful of strata."""
    most = worst.agg(F.coalesce(F.max("max_dev"), F.lit(0.0))).first()[0]
    rows = [f"{r.stratum}\t{r.bin}\t{r.n}\t{r.mean_pred:.4f}\t{r.frac_pos:.4f}\t{r.abs_dev:.4f}" for r in table.orderBy("stratum", "bin").collect()]
    return "\n".join(["stratum\tbin\tn\tmean_pred\tfrac_pos\tabs_dev", *rows, *(f"MAX\t{r.stratum}\t{r.max_dev:.4f}" for r in worst.orderBy("stratum").collect()), f"GLOBAL_MAX_DEV\t{most:.4f}"])


def report_markdown(counts: DataFrame, classes: DataFrame, examples: DataFrame | None = None) -> str:
    """Error report from small aggregates: decision counts, then classes with examples.

    ``examples`` (class, id, raw, etalon, got, decision, p, duplicate), a few rows a
    class, are shown as a table under their class, duplicates of the dictionary marked.
    """
    shown: dict[str, list] = {}
    for r in examples.orderBy("class", "id").collect() if examples is not None else ():
        note = "duplicate entry" if r.duplicate else ""
        shown.setdefault(r["class"], []).append(f"| {r.id} | {r.raw} | {r.etalon or ''} | {r.got or ''} | {r.decision} | {'' if r.p is None else f'{r.p:.3f}'} | {note} |")
    lines = ["# Errors", "", "| decision | positive | negative |", "|---|---|---|"]
    lines += [f"| {r.decision} | {r.positive} | {r.negative} |" for r in counts.orderBy("decision").collect()]
    for r in classes.orderBy(F.desc("n"), "class").collect():
        lines += ["", f"## {r['class']} ({r.n})", "", *(f"- {x}" for x in r.examples)]
        if r["class"] in shown:
            lines += ["", "| id | text | entry | found | decision | p | note |", "|---|---|---|---|---|---|---|", *shown[r["class"]]]
    return "\n".join(lines) + "\n"


def _opened(uri: str) -> zipfile.ZipFile:
    """Archive at a path as Spark names it, read by ranges from its file system."""
    scheme, _, rest = uri.partition(":")
    if scheme == "file":
        system, path = LocalFileSystem(), unquote("/" + rest.lstrip("/"))
    else:
        system, path = FileSystem.from_uri(uri)
    return zipfile.ZipFile(system.open_input_file(path))


def _members(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(path, member) of the register files that each archive lists."""
    for batch in batches:
        for path in batch.column("path").to_pylist():
            with _opened(path) as archive:
                names = [n for n in archive.namelist() if MEMBER.match(n)]
            yield pa.RecordBatch.from_arrays([pa.array([path] * len(names), pa.string()), pa.array(names, pa.string())], ["path", "member"])


def _objects(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Objects of each member, parsed as a stream."""
    for batch in batches:
        for path, name in zip(batch.column("path").to_pylist(), batch.column("member").to_pylist(), strict=True):
            region, rows = MEMBER.match(name)[1], []
            with _opened(path) as archive, archive.open(name) as member:
                steps = ET.iterparse(member, events=("start", "end"))
                _, root = next(steps)
                for event, element in steps:
                    if event == "start":
                        continue
                    if element.tag == "OBJECT":
                        rows.append((region, *(element.attrib.get(f) for f in OBJECT_FIELDS)))
                    root.clear()  # the parsed part, which would grow with the member
                    if len(rows) == XML_ROWS:
                        yield _batch(rows)
                        rows = []
            if rows:
                yield _batch(rows)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in zip(*rows, strict=True)], ["region", *(f.lower() for f in OBJECT_FIELDS)])


def read_register(spark: SparkSession, path: str) -> DataFrame:
    """(region, name, typename, level, isactual, isactive) of XML registers inside zip archives of any size.

    Archives are listed first; each member is then a row of its own, dealt to
    tasks by hash and read as a stream, so neither an archive nor a member is
    held whole.
    """
    archives = spark.read.format("binaryFile").load(path).select("path")  # the contents are not read
    listed = archives.mapInArrow(_members, "path string, member string")
    return listed.repartition("path", "member").mapInArrow(_objects, "region string, " + ", ".join(f"{f.lower()} string" for f in OBJECT_FIELDS))


def register_document(statistics: dict[str, DataFrame], half: DataFrame) -> dict:
    """Statistics of a register as one document; ``half`` is :func:`half_coverage` of the name counts.  Collects totals, the
    most frequent names, types, levels and regions: small tables all."""
    totals = statistics["totals"].first().asDict()
    pairs = {k: [list(r) for r in statistics[k].orderBy(F.desc("c"), statistics[k].columns[0]).collect()] for k in ("names", "types", "levels", "regions")}
    return totals | pairs | {"names_for_half": half.first()["names_for_half"]}


def write_register_statistics(objects: DataFrame, path: str, most: int = 30) -> dict:
    """:func:`register_document` of a register, written as one JSON file in a folder."""
    found = register_statistics(objects, most)
    document = register_document(found, half_coverage(found["name_counts"]))
    save_model(objects.sparkSession, document, path)
    return document


def register_statistics(objects: DataFrame, most: int = 30) -> dict[str, DataFrame]:
    """Counts of current streets (level 8) and settlements (levels 5 and 6), by name, type and region."""
    current = objects.filter("isactual = '1' AND isactive = '1'").withColumn("name", F.lower(F.trim("name")))
    streets, places = current.filter("level = '8'"), current.filter("level IN ('5', '6')")
    by_name = streets.groupBy("name").agg(F.count(F.lit(1)).alias("c"))
    return {
        "totals": current.agg(
            F.count_if(F.col("level") == "8").alias("streets"), F.count_distinct(F.when(F.col("level") == "8", F.col("name"))).alias("unique_names"),
            F.count_if(F.col("level").isin("5", "6")).alias("settlements"), F.count_distinct(F.when(F.col("level").isin("5", "6"), F.col("name"))).alias("unique_settlements"),
            F.count_distinct("region").alias("regions"),
        ),
        "names": by_name.orderBy(F.desc("c"), "name").limit(most),
        "name_counts": by_name,
        "types": streets.groupBy("typename").agg(F.count(F.lit(1)).alias("c")),
        "levels": current.groupBy("level").agg(F.count(F.lit(1)).alias("c")),
        "regions": places.unionByName(streets).groupBy("region").agg(F.count(F.lit(1)).alias("c")),
    }
