"""N-gram Jaccard self-join by MinHash banding, verified on full n-gram sets.

1. Every document is sketched: a 128-bit hash of its word sequence (its copy
   class) and band hashes of a MinHash signature.  Band and row counts follow
   from the threshold and the target recall.
2. One document stands for each copy class.  Representatives shuffle on their
   band hashes; a bucket links its members to its smallest one where the two
   signatures agree as those of a document and a neighbour's neighbour would, and
   connected components of these links are the candidate clusters.  Members that
   agree less than near documents do form a bucket of their own, so two similar
   documents of a bucket end in one cluster, while documents that met by chance
   alone don't chain.
3. Clusters are cut into blocks of bounded size.  A task holds two blocks,
   takes the full n-gram sets of their texts and computes every Jaccard
   similarity between them.  It returns, per document, the number of its links
   and the root of a spanning forest; pairs are never rows.
4. Connected components of the forests are the near-duplicate classes.

A cluster of any size is only more blocks; no bucket or partner is capped.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import Roots, components, spread_join
from .storage import frugal, materialise
from .wordgrams import NGRAM, byte_chunks, mix64, ngrams, word_hashes


@dataclass(frozen=True)
class JoinParams:
    """threshold: least similarity of a link; recall: chance that a pair at the
    threshold shares a band; most_hashes bounds the signature; block: documents
    of a block."""

    threshold: float = 0.8
    recall: float = 0.9999
    most_hashes: int = 80
    ngram: int = NGRAM
    block: int = 256

    def bands(self) -> tuple[int, int]:
        """(bands, rows): the most rows per band whose bands reach the recall."""
        best = (math.ceil(math.log(1 - self.recall) / math.log(1 - self.threshold)), 1) if self.threshold < 1 else (1, self.most_hashes)
        for rows in range(2, self.most_hashes + 1):
            if self.threshold >= 1:
                break
            bands = math.ceil(math.log(1 - self.recall) / math.log(1 - self.threshold**rows))
            if bands * rows > self.most_hashes:
                break
            best = (bands, rows)
        return best


    def agreement(self) -> tuple[int, int]:
        """Least agreeing hashes of a link to a bucket's smallest member, and of one that settles the matter.

        Jaccard distance is a metric.  Let x be within 0.4 of the smallest member
        p by its signature and y similar to x: then y is within 0.4 + 1 -
        threshold of p.  Both bounds give way by five standard deviations.
        """
        bands, rows = self.bands()
        n = bands * rows

        def bound(similarity: float) -> int:
            return math.floor(n * similarity - 5 * math.sqrt(n * similarity * (1 - similarity)))

        return max(rows, bound(max(0.0, 0.6 - (1 - self.threshold)))), math.ceil(0.6 * n)


SKETCH = "doc_id long, c1 long, c2 long, n_grams long, bands array<long>, signature array<short>"


def sequence_hashes(grams: np.ndarray, ends: np.ndarray, heads: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two hashes of the gram sequence of each row that has one; ``heads`` are those rows' first grams."""
    place = (np.arange(len(grams)) - np.repeat(ends[:-1], np.diff(ends))).astype(np.uint64)
    return (
        np.add.reduceat(mix64(grams + place * np.uint64(0x9E3779B97F4A7C15)), heads),
        np.add.reduceat(mix64((grams ^ np.uint64(0xA0761D6478BD642F)) + place * np.uint64(0xE7037ED1A0B428DB)), heads),
    )


def _sketcher(p: JoinParams):
    bands, rows = p.bands()
    rng = np.random.default_rng(77)
    mult = rng.integers(0, 1 << 32, bands * rows, dtype=np.uint64).astype(np.uint32) | np.uint32(1)
    plus = rng.integers(0, 1 << 32, bands * rows, dtype=np.uint64).astype(np.uint32)
    row_key = rng.integers(0, 1 << 63, rows, dtype=np.uint64) | np.uint64(1)

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text")
            for a, b in byte_chunks(texts):
                words, at = word_hashes(texts.slice(a, b - a))
                grams, ends = ngrams(words, at, p.ngram)
                n = b - a
                counts = np.diff(ends)
                full = np.flatnonzero(counts)
                c1, c2 = np.zeros(n, np.uint64), np.zeros(n, np.uint64)
                sig, low_bits = np.zeros((bands, n), np.uint64), np.zeros((bands * rows, n), np.int16)
                if len(full):
                    heads = ends[:-1][full]
                    c1[full], c2[full] = sequence_hashes(grams, ends, heads)
                    small = (grams >> np.uint64(32)).astype(np.uint32)
                    for k in range(bands * rows):
                        low = np.minimum.reduceat(small * mult[k] + plus[k], heads).astype(np.uint64)
                        band, row = divmod(k, rows)
                        mixed = mix64(low + np.uint64(k << 32))
                        sig[band, full] += mixed * row_key[row]
                        low_bits[k, full] = mixed.astype(np.uint16).view(np.int16)
                flat = pa.array(mix64(sig).T.reshape(-1).view(np.int64))
                bits = pa.array(low_bits.T.reshape(-1))
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("doc_id").slice(a, n),
                        pa.array(c1.view(np.int64)),
                        pa.array(c2.view(np.int64)),
                        pa.array(counts),
                        pa.ListArray.from_arrays(pa.array(np.arange(0, bands * n + 1, bands), pa.int32()), flat),
                        pa.ListArray.from_arrays(pa.array(np.arange(0, len(bits) + 1, bands * rows), pa.int32()), bits),
                    ],
                    [c.split()[0] for c in SKETCH.split(", ")],
                )

    return sketch


def similarities(sets: list[np.ndarray], split: int | None, width: int = 4096) -> np.ndarray:
    """Sizes of the intersections of sorted sets: all with all, or the first ``split`` with the rest."""
    sizes = np.array([len(s) for s in sets])
    owner = np.repeat(np.arange(len(sets)), sizes)
    _, code, many = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = many[code] > 1
    rank = np.cumsum(many > 1) - 1
    owner, code = owner[shared], rank[code[shared]]
    left = len(sets) if split is None else split
    total = np.zeros((left, len(sets) - (split or 0)), np.float32)
    order = np.argsort(code, kind="stable")
    owner, code = owner[order], code[order]
    for at in range(0, int(code[-1]) + 1 if len(code) else 0, width):
        a, b = np.searchsorted(code, (at, at + width))
        x = np.zeros((len(sets), width), np.float32)
        x[owner[a:b], code[a:b] - at] = 1
        total += x[:left] @ x[split or 0 :].T
    return total


def verify_group(nodes: np.ndarray, classes: np.ndarray, copies: np.ndarray, side: np.ndarray, column: pa.Array, p: JoinParams) -> tuple[list[int], list[int], list[int]]:
    """(node, root, links) of the representatives of one task that have a link.

    ``side`` is 0 or 1 for the two blocks, all 0 where a block meets itself.
    ``classes`` are the two hashes of the word sequence that a node stands for;
    a text with others, of another row with the same id, is left out.
    """
    order = np.lexsort((nodes, side))
    nodes, classes, copies, side = nodes[order], classes[order], copies[order], side[order]
    words, at = word_hashes(column.take(pa.array(order)))
    grams, ends = ngrams(words, at, p.ngram)
    found = np.zeros(classes.shape, np.uint64)
    full = np.flatnonzero(np.diff(ends))
    if len(full):
        found[full] = np.stack(sequence_hashes(grams, ends, ends[:-1][full]), axis=1)
    keep = np.flatnonzero((found.view(np.int64) == classes).all(axis=1))
    again = (nodes[keep[1:]] == nodes[keep[:-1]]) & (side[keep[1:]] == side[keep[:-1]])  # repeated rows
    keep = keep[np.concatenate(([True], ~again))] if len(keep) else keep
    sets = [np.unique(grams[ends[k] : ends[k + 1]]) for k in keep]
    nodes, copies, side = nodes[keep], copies[keep], side[keep]
    if len(nodes) < 2:
        return [], [], []
    sizes = np.array([len(s) for s in sets], np.float64)
    split = int((side == 0).sum()) if side.any() else None
    if split == 0 or split == len(nodes):
        return [], [], []
    both = similarities(sets, split).astype(np.float64)
    left, right = (slice(None), slice(None)) if split is None else (slice(0, split), slice(split, None))
    linked = both >= p.threshold * (sizes[left, None] + sizes[None, right] - both) - 1e-9
    linked &= nodes[left, None] != nodes[None, right]
    i, j = np.nonzero(linked)
    links = np.zeros(len(nodes), np.int64)
    j = j + (split or 0)
    np.add.at(links, i, copies[j])
    if split is not None:
        np.add.at(links, j, copies[i])
    by_node = np.argsort(nodes, kind="stable")
    back = np.argsort(by_node)
    roots = Roots(len(nodes))
    roots.join(back[i], back[j])
    hit = np.flatnonzero(links)
    return nodes[hit].tolist(), nodes[by_node[roots.root[back[hit]]]].tolist(), links[hit].tolist()


def _verifier(p: JoinParams):
    def flush(key, parts):
        table = pa.Table.from_batches(parts).combine_chunks()
        column = table.column("text").chunk(0)
        side = (table.column("part").to_numpy() != key[1]).astype(np.int8)
        classes = np.column_stack([table.column(c).to_numpy() for c in ("c1", "c2")])
        return verify_group(table.column("node").to_numpy(), classes, table.column("copies").to_numpy(), side, column, p)

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, parts = None, []
        out: tuple[list, list, list] = ([], [], [])

        def close():
            if sum(x.num_rows for x in parts) > 1:
                for to, got in zip(out, flush(key, parts), strict=True):
                    to.extend(got)

        def batch_of():
            done = pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in out], ["node", "root", "links"])
            for x in out:
                x.clear()
            return done

        for batch in batches:
            if not batch.num_rows:
                continue
            keys = np.column_stack([batch.column(c).to_numpy() for c in ("cluster", "i", "j")])
            cuts = [0, *(np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1).tolist(), len(keys)]
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                here = tuple(keys[a].tolist())
                if here != key:
                    if key is not None:
                        close()
                    key, parts = here, []
                parts.append(batch.slice(a, b - a))
            if len(out[0]) > 20_000:
                yield batch_of()
        if key is not None:
            close()
        if out[0]:
            yield batch_of()

    return verify


def _candidates(classes: DataFrame, p: JoinParams) -> DataFrame:
    """Links (u, v) between representatives of ``classes`` (node, bands, signature) whose components hold all similar pairs."""
    least, settled = p.agreement()
    signed = classes.select(F.col("node").alias("m"), F.col("signature").alias("signature_m"))
    members = classes.select("node", F.posexplode("bands").alias("band", "hash"))
    # buckets of one member are most; the others' members meet the smallest one
    smallest = members.groupBy("band", "hash").agg(F.min("node").alias("m"), F.count(F.lit(1)).alias("n")).filter("n > 1").drop("n")
    met = materialise(members.join(smallest, ["band", "hash"]).filter("node <> m"), "near-met")
    # a pair may meet in several bands
    pairs = met.select("node", "m").distinct().join(classes.select("node", "signature"), "node")
    often = pairs.groupBy("m").agg(F.count(F.lit(1)).alias("n"))
    same = F.size(F.filter(F.zip_with("signature", "signature_m", lambda a, b: a == b), lambda x: x)).alias("same")
    judged = materialise(spread_join(pairs, often.join(signed, "m"), "m").select("node", "m", same), "near-judged")
    links = judged.filter(F.col("same") >= least).select(F.col("node").alias("u"), F.col("m").alias("v"))
    # members apart from the smallest one, in a bucket of their own
    left = met.join(judged.filter(F.col("same") < settled).select("node", "m"), ["node", "m"], "left_semi").select("band", "hash", "node")
    again = left.groupBy("band", "hash").agg(F.min("node").alias("v"), F.count(F.lit(1)).alias("n")).filter("n > 1").drop("n")
    return links.unionByName(left.join(again, ["band", "hash"]).select(F.col("node").alias("u"), "v").filter("u <> v"))


def near_duplicates(docs: DataFrame, params: JoinParams | None = None) -> DataFrame:
    """(doc_id, class_id, copy_of, n_links) for each distinct (doc_id, word sequence) of ``docs`` (doc_id, text).

    class_id: smallest doc_id of the near-duplicate class; copy_of: smallest
    doc_id with the same word sequence; n_links: other documents with Jaccard
    similarity of at least the threshold, copies counted one by one.  Null and
    empty texts link with nothing, texts shorter than an n-gram only with equal
    ones; a null doc_id links with nothing and has null classes; repeated rows
    count once; different texts of one doc_id are documents of their own; more
    columns are ignored; an empty table gives no rows.
    """
    p = params or JoinParams()
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    sketch = materialise(slim.mapInArrow(frugal(_sketcher(p)), SKETCH), "near-sketch")
    usable = sketch.filter("n_grams > 0 AND doc_id IS NOT NULL")
    rows = sketch.select("doc_id", "c1", "c2", "n_grams").distinct()
    classes = (
        usable.groupBy("c1", "c2")
        .agg(F.min("doc_id").alias("rep"), F.count_distinct("doc_id").alias("copies"), F.first("bands").alias("bands"), F.first("signature").alias("signature"))
    )
    # a representative's id names its class, but where one id has several texts: there a hash below all usual ids
    several = materialise(rows.filter("n_grams > 0").groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select(F.col("doc_id").alias("rep")), "near-repeated")
    if several.isEmpty():
        classes = classes.withColumn("node", F.col("rep"))
    else:
        own = F.xxhash64("rep", "c1", "c2").bitwiseOR(F.lit(-(1 << 63)))
        classes = classes.join(several.withColumn("many", F.lit(True)), "rep", "left").withColumn("node", F.when(F.col("many"), own).otherwise(F.col("rep"))).drop("many")
    classes = materialise(classes, "near-classes")
    clusters = materialise(components(_candidates(classes, p)), "near-clusters")
    blocks = clusters.groupBy("component").agg(F.ceil(F.count(F.lit(1)) / p.block).cast("int").alias("n_blocks"))
    members = (
        clusters.join(blocks, "component")
        .join(classes.select("node", "rep", "c1", "c2", "copies"), "node")
        .withColumn("part", F.pmod(F.xxhash64("node"), F.col("n_blocks")).cast("int"))
        .select("node", F.col("rep").alias("doc_id"), "c1", "c2", F.col("component").alias("cluster"), "n_blocks", "part", "copies")
    )
    members = materialise(members, "near-members")
    # rows of a repeated doc_id with other words than the representative's are left out where texts are read
    texts = slim.filter("doc_id IS NOT NULL")
    other = F.explode(F.sequence(F.lit(0), F.col("n_blocks") - 1)).alias("other")
    columns = ["node", "c1", "c2", "cluster", "part", "copies", "text"]
    tasks = (
        members.hint("merge").join(texts, "doc_id")  # its size is not bounded: never a broadcast, at any scale
        .select(*columns, other)
        .select(*columns, F.least("part", "other").alias("i"), F.greatest("part", "other").alias("j"))
    )
    keys = ["cluster", "i", "j"]
    found = materialise(
        tasks.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(frugal(_verifier(p)), "node long, root long, links long"),
        "near-links",
    )
    links = found.groupBy("node").agg(F.sum("links").alias("links"))
    near = components(found.select(F.col("node").alias("u"), F.col("root").alias("v")))
    by_class = classes.join(links, "node", "left").join(near, "node", "left").withColumn("root", F.coalesce("component", "node"))
    if not several.isEmpty():  # names of classes are not all ids
        ids = by_class.groupBy("root").agg(F.min("rep").alias("root_id"))
        by_class = by_class.join(ids, "root").withColumn("root", F.col("root_id"))
    by_class = by_class.select("c1", "c2", "rep", "root", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
    alone = F.col("n_grams") == 0
    return rows.join(by_class, ["c1", "c2"], "left").select(
        "doc_id",
        F.when(alone, F.col("doc_id")).when(F.col("doc_id").isNotNull(), F.col("root")).alias("class_id"),
        F.when(alone, F.col("doc_id")).when(F.col("doc_id").isNotNull(), F.col("rep")).alias("copy_of"),
        F.when(alone | F.col("doc_id").isNull(), F.lit(0)).otherwise(F.col("n_links")).cast("long").alias("n_links"),
    )


def op7_ngram_join(spark, sf_dir: str) -> DataFrame:
    """Near-duplicate classes and link counts of all of ``documents``."""
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))
