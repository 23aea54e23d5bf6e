"""Benchmark decontamination by containment search, in DataFrame operations only.

A document leaks a test item when it holds at least ``threshold`` of the
item's distinct word shingles, however long the document is.

Search: items are partitioned by their number of shingles (powers of two).
An item's probes are its ``k`` smallest shingle hashes - a MinHash of the item
under one permutation - and a document is a candidate for the item when it
holds any of them.  If a fraction t of the shingles is contained, at least one
of k of them is with probability 1 - C(q - tq, k) / C(q, k); each size
partition takes the least k that meets the target recall.  A signature of the
whole document would not do: its Jaccard similarity to a short item is near 0
in a long document, while this bound depends on the item alone.

Verification: candidate documents are shingled again and the shingles, as
strings, are counted exactly.

The probes are a written table; the planner broadcasts it where its size on
disk is under the session's limit and shuffles on the shingle hash beyond.

Words are runs of letters, marks and digits of the lower-cased text.  An item
with fewer words than a shingle is searched as one shingle of all its words.
Null and empty texts or items match nothing, nor do null ids; rows that share
a doc_id are searched as one document; more columns are ignored; empty tables
give no rows.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .storage import materialise

#: Fixed value: what separates words.
NO_WORD = r"[^\p{L}\p{M}\p{N}]+"


@dataclass(frozen=True)
class ContainParams:
    """shingle: words of a shingle; threshold: least contained fraction; recall:
    chance to find an item that is contained to exactly the threshold."""

    shingle: int = 5
    threshold: float = 0.8
    recall: float = 1 - 1e-9

    def probes(self, q: int) -> int:
        """Least number of probes of an item of q shingles that meets the recall."""
        held = math.ceil(self.threshold * q - 1e-9)
        for k in range(1, q - held + 1):
            if math.comb(q - held, k) <= (1 - self.recall) * math.comb(q, k):
                return k
        return q - held + 1

    def size_classes(self, top: int = 16) -> list[tuple[int, int]]:
        """(upper size, probes) of each partition (upper/2, upper]; larger items share the last."""
        found = []
        for c in range(top + 1):
            upper = 1 << c
            sizes = range(upper // 2 + 1, upper + 1) if upper <= 256 else (upper // 2 + 1, upper)
            found.append((upper, max(self.probes(q) for q in sizes)))
        return found


def words(text: Column) -> Column:
    """The words of a text; null gives an empty array."""
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), NO_WORD), lambda w: w != "")


def shingles(text: Column, n: int, as_text: bool = False) -> Column:
    """Distinct n-word shingles, hashed or as strings; shorter texts have none.

    The word array is bound by a one-element ``transform``, so it is made once
    per row and not once per shingle.
    """

    def cut(w: Column) -> Column:
        starts = F.when(F.size(w) >= n, F.sequence(F.lit(1), F.size(w) - (n - 1))).otherwise(F.array().cast("array<int>"))
        gram = (lambda i: F.array_join(F.slice(w, i, F.lit(n)), " ")) if as_text else (lambda i: F.xxhash64(F.slice(w, i, F.lit(n))))
        return F.transform(starts, gram)

    return F.array_distinct(F.element_at(F.transform(F.array(words(text)), cut), 1))


def find_leaks(docs: DataFrame, items: DataFrame, params: ContainParams | None = None) -> DataFrame:
    """(doc_id, item_id, item_shingles, hits, containment) of every leak of
    ``items`` (item_id, text) into ``docs`` (doc_id, text)."""
    p = params or ContainParams()
    lengths = F.least(F.size(words(F.col("text"))), F.lit(p.shingle))
    sized = materialise(items.filter("item_id IS NOT NULL").select("item_id", "text", lengths.alias("gram")).filter("gram > 0"), "leak-items")
    found = None
    for (gram,) in sorted(sized.select("gram").distinct().collect()):  # 1 to ``shingle``: a handful of values
        part = _leaks_of(docs.select("doc_id", "text"), sized.filter(F.col("gram") == gram), gram, p)
        found = part if found is None else found.unionByName(part)
    if found is None:
        return docs.sparkSession.createDataFrame([], f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, item_id {items.schema['item_id'].dataType.simpleString()}, item_shingles long, hits long, containment double")
    return found


def _leaks_of(docs: DataFrame, items: DataFrame, n: int, p: ContainParams) -> DataFrame:
    """Leaks of items that are all shingled by n words."""
    parts = items.select("item_id", F.explode(shingles(F.col("text"), n, as_text=True)).alias("s")).distinct()
    parts = parts.withColumn("h", F.xxhash64(F.split("s", " ")))
    by_item, by_hash = Window.partitionBy("item_id"), Window.partitionBy("item_id").orderBy("h", "s")
    classes = p.size_classes()
    k = F.lit(classes[-1][1])
    for upper, probes in reversed(classes[:-1]):
        k = F.when(F.col("item_shingles") <= upper, F.lit(probes)).otherwise(k)
    parts = parts.withColumn("item_shingles", F.count(F.lit(1)).over(by_item)).withColumn("is_probe", F.row_number().over(by_hash) <= k)
    parts = materialise(parts, "leak-shingles")
    probes = materialise(parts.filter("is_probe").select("h", "item_id"), "leak-probes")
    held = docs.select("doc_id", F.explode(shingles(F.col("text"), n)).alias("h"))
    candidates = materialise(held.join(probes, "h").select("doc_id", "item_id").distinct(), "leak-candidates")
    again = docs.join(candidates.select("doc_id").distinct(), "doc_id", "left_semi")
    hits = (
        again.select("doc_id", F.explode(shingles(F.col("text"), n, as_text=True)).alias("s"))
        .join(parts.select("s", "item_id", "item_shingles"), "s")
        .groupBy("doc_id", "item_id", "item_shingles")
        .agg(F.count_distinct("s").alias("hits"))
    )
    share = F.col("hits") / F.col("item_shingles")
    return (
        hits.filter(share >= p.threshold - 1e-12)
        .join(candidates, ["doc_id", "item_id"], "left_semi")
        .select("doc_id", "item_id", "item_shingles", "hits", share.alias("containment"))
    )


def op2_decontaminate(spark, sf_dir: str) -> DataFrame:
    """Leaks of all of ``benchmark`` into all of ``documents``."""
    return find_leaks(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


ORACLE = r"""
WITH w AS (
  SELECT 'd' AS kind, doc_id AS id, list_filter(regexp_split_to_array(lower(text), '[^\p{L}\p{M}\p{N}]+'), lambda x: x <> '') AS w FROM documents
  UNION ALL
  SELECT 'i', item_id, list_filter(regexp_split_to_array(lower(text), '[^\p{L}\p{M}\p{N}]+'), lambda x: x <> '') FROM benchmark),
s AS (
  SELECT DISTINCT kind, id, array_to_string(w[i:i + 4], ' ') AS s
  FROM (SELECT kind, id, w, unnest(range(1, len(w) - 3)) AS i FROM w)),
q AS (SELECT id, count(*) AS item_shingles FROM s WHERE kind = 'i' GROUP BY id)
SELECT d.id AS doc_id, i.id AS item_id, item_shingles, count(*) AS hits, count(*) / item_shingles AS containment
FROM s d JOIN s i ON d.kind = 'd' AND i.kind = 'i' AND d.s = i.s JOIN q ON q.id = i.id
GROUP BY d.id, i.id, item_shingles HAVING count(*) >= 0.8 * item_shingles
"""
