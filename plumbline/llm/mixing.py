"""Mixing sources to target weights, in DataFrame operations only.

Each source's documents lie end to end in a pseudorandom order and are cut
into blocks of a fixed number of tokens (words here).  A source's target
becomes a whole number of slots; every slot draws its output shard uniformly,
so a source's counts over the shards are multinomial while their total meets
the target.  Slot ``j`` of a source reads block ``perm_epoch(j mod blocks)`` of
``epoch = j div blocks``, where ``perm`` is a keyed swap-or-not permutation of
the block indices; slots and blocks meet in an equi-join on (source, block).

Long documents span blocks, short ones share them.  The running offsets are a
two-level prefix sum over about sqrt(rows) buckets, so a source with a third
of all rows never lands in one task.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .storage import materialise

#: Fixed value: a word is a run of characters other than ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
ROUNDS = 24


@dataclass(frozen=True)
class MixParams:
    """block_tokens: upper bound of a block's length; min_blocks: a source is cut
    into at least so many blocks if it has that many words, so small sources meet
    their targets too; weights repeat over the sources in code point order; cap:
    the largest multiple of a source's size; shard_blocks: mean slots of a shard."""

    block_tokens: int = 256
    min_blocks: int = 256
    shard_blocks: int = 4096
    weights: tuple[float, ...] = (1.0, 2.0, 3.0)
    share: float = 1.0
    cap: float = 3.0
    seed: int = 20240229


def word_count(text: Column) -> Column:
    """Number of words; null counts 0."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, p: MixParams) -> DataFrame:
    """Targets by water filling.  ``sizes``: one row per source with ``source_size``.

    Sources stop at ``cap`` times their size.  In order of room per weight the
    capped ones come first, so the shared level is found with prefix sums.
    """
    by_code = Window.orderBy(F.col("source").asc_nulls_last())
    weights = F.array(*[F.lit(float(w)) for w in p.weights])
    ranked = (
        sizes.withColumn("source_id", F.row_number().over(by_code) - 1)
        .withColumn("weight", F.element_at(weights, F.pmod("source_id", F.lit(len(p.weights))) + 1))
        .withColumn("room", F.col("source_size") * F.lit(float(p.cap)))
    )
    order = Window.orderBy(F.col("room") / F.col("weight"), "source_id")
    everything = Window.partitionBy(F.lit(0))
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    level = (F.lit(p.share) * F.sum("source_size").over(everything) - F.coalesce(F.sum("room").over(before), F.lit(0.0))) / (
        F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))
    )
    capped = ranked.withColumn("level", level).withColumn("capped", F.col("room") < F.col("level") * F.col("weight"))
    shared = F.min(F.when(~F.col("capped"), F.struct(F.col("room") / F.col("weight"), F.col("source_id"), F.col("level")))).over(everything)
    return capped.withColumn("shared", shared).select(
        "source_id",
        "source",
        "source_size",
        "weight",
        F.when(F.col("capped"), F.col("room")).otherwise(F.col("shared.level") * F.col("weight")).alias("target"),
    )


def _permuted(index: Column, n: Column, key: Column, p: MixParams) -> Column:
    """Swap-or-not permutation of [0, n): exact for every n, no cycle walking."""

    def step(x: Column, r: Column) -> Column:
        mirror = F.pmod(F.pmod(F.xxhash64(F.lit(p.seed), key, r), n) - x + n, n)
        swap = F.pmod(F.xxhash64(F.lit(p.seed + 1), key, r, F.greatest(x, mirror)), F.lit(2)) == 1
        return F.when(swap, mirror).otherwise(x)

    return F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), index, step)


@dataclass(frozen=True)
class Mix:
    """sources: targets and blocks per source; docs: one row per input row with
    its key (source_id, bucket, rn), its offset and what was passed through;
    pieces: the stretch of a document in one block; slots: the drawn blocks."""

    sources: DataFrame
    docs: DataFrame
    pieces: DataFrame
    slots: DataFrame

    def spans(self) -> DataFrame:
        """The mix: (shard, slot, source_id, block, source_id/bucket/rn, start, n_words)."""
        return self.slots.join(self.pieces, ["source_id", "block"])

    def taken(self) -> DataFrame:
        """Words the mix takes of each document, by its key."""
        drawn = self.slots.groupBy("source_id", "block").agg(F.count(F.lit(1)).alias("times"))
        return (
            self.pieces.join(drawn, ["source_id", "block"])
            .groupBy("source_id", "bucket", "rn")
            .agg(F.sum(F.col("n_words") * F.col("times")).alias("taken"))
        )


def mix(docs: DataFrame, params: MixParams | None = None, keep: tuple[str, ...] = ()) -> Mix:
    """Mix ``docs`` (doc_id, text, source; more columns allowed) to target weights.

    Null texts and texts of white space have size 0 and are never taken; a null
    source is a source of its own, the last; rows are placed by their id and text,
    so rows with a null or repeated doc_id spread like others; repeated rows stay
    separate rows.  An empty table gives an empty mix.
    ``keep`` names columns of ``docs`` to pass through on ``Mix.docs``.
    """
    p = params or MixParams()
    slim = docs.select(
        F.col("doc_id"), F.col("source"), word_count(F.col("text")).alias("size"), F.xxhash64(F.lit(p.seed), "doc_id", "text").alias("place"), *[F.col(c).alias(f"keep_{c}") for c in keep]
    )
    counted = materialise(slim, "mix-sizes") if not keep else slim
    sizes = counted.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("source_rows"))
    sizes = materialise(sizes, "mix-source-sizes")
    rows = sizes.agg(F.sum("source_rows")).first()[0] or 0
    buckets = max(1, int(rows**0.5))
    targets = source_targets(sizes.select("source", "source_size"), p)
    length = F.greatest(F.lit(1), F.least(F.lit(p.block_tokens), F.floor(F.col("source_size") / F.lit(p.min_blocks)))).cast("long")
    blocks = targets.withColumn("block_len", length).withColumn("blocks", F.ceil(F.col("source_size") / F.col("block_len")).cast("long"))
    # as many slots as meet the target by the mean length of a block; never over cap x blocks
    slots_wanted = F.least(
        F.when(F.col("source_size") > 0, F.round(F.col("target") * F.col("blocks") / F.col("source_size"))).otherwise(0.0),
        F.floor(F.col("blocks") * F.lit(float(p.cap))),
    ).cast("long")
    sources = materialise(blocks.withColumn("slots", slots_wanted), "mix-sources")

    keyed = counted.join(sources.select("source_id", F.col("source").alias("s"), "block_len"), F.col("source").eqNullSafe(F.col("s")), "inner").drop("s")
    keyed = keyed.withColumn("bucket", F.pmod("place", F.lit(buckets)).cast("int"))
    sums = keyed.groupBy("source_id", "bucket").agg(F.sum("size").alias("bucket_size"))
    ahead = Window.partitionBy("source_id").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    base = materialise(sums.select("source_id", "bucket", F.coalesce(F.sum("bucket_size").over(ahead), F.lit(0)).alias("base")), "mix-bases")
    inside = Window.partitionBy("source_id", "bucket").orderBy("place", "doc_id", "size")
    placed = (
        keyed.withColumn("rn", F.row_number().over(inside))
        .withColumn("within", F.sum("size").over(inside.rowsBetween(Window.unboundedPreceding, 0)) - F.col("size"))
        .join(base, ["source_id", "bucket"])
        .withColumn("offset", F.col("base") + F.col("within"))
        .drop("base", "within")
    )
    first, last = F.floor(F.col("offset") / F.col("block_len")), F.floor((F.col("offset") + F.col("size") - 1) / F.col("block_len"))
    pieces = (
        placed.filter("size > 0")
        .select("source_id", "bucket", "rn", "offset", "size", "block_len", F.explode(F.sequence(first, last)).alias("block"))
        .withColumn("start", F.greatest(F.lit(0), F.col("block") * F.col("block_len") - F.col("offset")))
        .withColumn(
            "n_words",
            F.least(F.col("size"), (F.col("block") + 1) * F.col("block_len") - F.col("offset")) - F.col("start"),
        )
        .select("source_id", "block", "bucket", "rn", "start", "n_words")
    )
    total = sources.agg(F.sum("slots")).first()[0] or 0
    shards = max(1, -(-total // p.shard_blocks))
    # slots in runs of 1024, so that no row carries a long array; the runs are few bytes but much
    # work, so they are dealt to a number of tasks that grows with the slots and is not coalesced
    tasks = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), total // 100_000)
    runs = sources.filter("slots > 0").select("source_id", "blocks", "slots", F.explode(F.sequence(F.lit(0), F.floor((F.col("slots") - 1) / 1024))).alias("run"))
    drawn = (
        runs.repartition(tasks, "source_id", "run")
        .select("source_id", "blocks", F.explode(F.sequence(F.col("run") * 1024, F.least(F.col("run") * 1024 + 1023, F.col("slots") - 1))).alias("j"))
        .withColumn("epoch", F.floor(F.col("j") / F.col("blocks")))
        .withColumn("shard", F.pmod(F.xxhash64(F.lit(p.seed + 2), "source_id", "j"), F.lit(shards)))
        .withColumn("slot_key", F.xxhash64(F.lit(p.seed + 3), "source_id", "j"))
        .withColumn("block", _permuted(F.pmod("j", "blocks"), F.col("blocks"), F.hash("source_id", "epoch"), p))
        .select("source_id", "block", "shard", "slot_key", "j")
    )
    return Mix(sources, placed, pieces, drawn)


def mixed_documents(docs: DataFrame, params: MixParams | None = None) -> DataFrame:
    """The mix as rows of ``docs``: one per document the mix takes from.

    The text is the whole text as often as every stretch of it is drawn, then
    each stretch as often as it is drawn beyond, in order, separated by line
    ends; ``n_chars`` is made anew where ``docs`` has it.  Words keep their order,
    white space inside a stretch becomes one space.
    """
    names = docs.columns
    mixed = mix(docs, params, keep=tuple(names))
    drawn = mixed.slots.groupBy("source_id", "block").agg(F.count(F.lit(1)).alias("times"))
    stretch = F.struct("start", "n_words", F.coalesce("times", F.lit(0)).alias("times"))
    # the stretches of one document: at most its words by the block length
    taken = (
        mixed.pieces.join(drawn, ["source_id", "block"], "left")
        .groupBy("source_id", "bucket", "rn")
        .agg(F.sort_array(F.collect_list(stretch)).alias("stretches"), F.sum("times").alias("drawn"))
        .filter("drawn > 0")
    )
    whole = F.array_min(F.transform("stretches", lambda x: x.times)).cast("int")
    text = F.col("keep_text")

    def beyond(words: Column) -> Column:
        repeats = F.transform("stretches", lambda x: F.array_repeat(F.array_join(F.slice(words, (x.start + 1).cast("int"), x.n_words.cast("int")), " "), (x.times - whole).cast("int")))
        return F.flatten(repeats)

    # the word array is bound once per row
    rest = F.element_at(F.transform(F.array(F.regexp_extract_all(text, F.lit(f"({WORD})"), F.lit(1))), beyond), 1)
    even = F.array_max(F.transform("stretches", lambda x: x.times)) == F.array_min(F.transform("stretches", lambda x: x.times))
    parts = F.concat(F.array_repeat(text, whole), F.when(even, F.array().cast("array<string>")).otherwise(rest))
    joined = mixed.docs.join(taken.hint("merge"), ["source_id", "bucket", "rn"]).withColumn("mixed_text", F.array_join(parts, "\n"))
    made = {"text": F.col("mixed_text"), "n_chars": F.char_length("mixed_text").cast(dict(docs.dtypes).get("n_chars", "long"))}
    return joined.select(*[made.get(c, F.col(f"keep_{c}")).alias(c) for c in names])


def op10_mixing(spark, sf_dir: str) -> DataFrame:
    """Mix all of ``documents``; per document its size, its source's size and target, and the words taken."""
    mixed = mix(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return (
        mixed.docs.join(mixed.taken(), ["source_id", "bucket", "rn"], "left")
        .join(mixed.sources.select("source_id", "source_size", "target"), "source_id")
        .select("doc_id", "source", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"))
    )
