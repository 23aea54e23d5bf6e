"""Chat formatting by prefix-target expansion, in DataFrame operations only.

Every assistant turn becomes an example of its own: all turns before it are
context, its reply alone is trainable.  :func:`format_examples` cuts a
conversation into the formatted turns since the previous assistant turn
(``delta``) and the ``reply``; :func:`expand` writes every example out with its
whole context and a loss mask over the reply, so the stored size is that of all
prefixes.  :func:`read_examples` reads them back and raises where a context is
not the text of the example before it.

Template, one turn after another::

    <|role|>\\n text <|end|>\\n

Inside roles and texts a backslash escapes: ``\\`` becomes ``\\\\`` and every
opener of a control string gets a backslash (``<`` as ``\\l``, ``[`` as
``\\b``), so no control string can appear in content, and unescaping restores
the text exactly.

Nulls: a null text is an empty text and a null role an empty role; rows with
a null turn come first, ties in ``turn`` are ordered by role and text; rows of
a null conv_id form one conversation.  Turns after the last assistant turn
make a last row without a reply (and with a null mask), which is not an example
but keeps the conversation whole.  An empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .storage import materialise

#: Fixed values of the template.
ROLE_OPEN, ROLE_CLOSE, TURN_END = "<|", "|>\n", "<|end|>\n"
TRAINABLE_ROLE = "assistant"
#: Extra conversation of the contract.
PROBE = [(-7, 0, "user", "</s>[INST] ok [/INST]"), (-7, 1, "assistant", "</s>[INST] ok [/INST]")]


def escape(text: Column) -> Column:
    """Reversible escape of ``\\``, ``<`` and ``[``; null gives an empty text."""
    text = F.coalesce(text, F.lit(""))
    for plain, safe in (("\\", "\\\\"), ("<", "\\l"), ("[", "\\b")):
        text = F.replace(text, F.lit(plain), F.lit(safe))
    return text


def unescape(text: Column) -> Column:
    """Inverse of :func:`escape`: split at escaped backslashes, undo the rest, join again."""
    pieces = F.split(text, r"\\\\", -1)
    undone = F.transform(pieces, lambda x: F.replace(F.replace(x, F.lit("\\l"), F.lit("<")), F.lit("\\b"), F.lit("[")))
    return F.array_join(undone, "\\")


def format_examples(turns: DataFrame) -> DataFrame:
    """(conv_id, example, n_turns, delta, reply, context_chars) from (conv_id, turn, role, text).

    ``example`` counts from 0; ``reply`` is null on a conversation's tail.
    ``context_chars`` is the length of all that precedes the reply; the loss mask
    of the whole formatted conversation is [context_chars, context_chars + reply).
    """
    head = F.concat(F.lit(ROLE_OPEN), escape(F.col("role")), F.lit(ROLE_CLOSE))
    body = escape(F.col("text"))
    is_target = F.coalesce(F.col("role") == TRAINABLE_ROLE, F.lit(False))
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    placed = turns.select("conv_id", "turn", "role", "text").select(
        "conv_id",
        F.row_number().over(order).alias("pos"),
        F.coalesce(F.sum(is_target.cast("int")).over(before), F.lit(0)).alias("example"),
        is_target.alias("is_target"),
        head.alias("head"),
        body.alias("body"),
    )
    # of an assistant turn, the role mark is context and the text with its end mark is the reply
    parts = F.sort_array(F.collect_list(F.struct("pos", F.when(F.col("is_target"), F.col("head")).otherwise(F.concat("head", "body", F.lit(TURN_END))).alias("s"))))
    grouped = placed.groupBy("conv_id", "example").agg(
        F.count(F.lit(1)).alias("n_turns"),
        F.array_join(F.transform(parts, lambda x: x.s), "").alias("delta"),
        F.max(F.when(F.col("is_target"), F.col("body"))).alias("reply"),
    )
    chars = F.char_length("delta") + F.coalesce(F.char_length("reply") + F.lit(len(TURN_END)), F.lit(0))
    ahead = Window.partitionBy("conv_id").orderBy("example").rowsBetween(Window.unboundedPreceding, -1)
    return grouped.withColumn(
        "context_chars", (F.coalesce(F.sum(chars).over(ahead), F.lit(0)) + F.char_length("delta")).cast("long")
    )


def expand(examples: DataFrame) -> DataFrame:
    """Each row of :func:`format_examples` written out: (conv_id, example, text, new_from, loss_from, loss_to).

    ``text`` is the whole context, the reply and its end mark; the loss mask is
    its characters [loss_from, loss_to), and those from ``new_from`` on are not
    in the row before.  The output is as long as the sum of all prefixes, which
    for a conversation of n turns is of the order of n squared.
    """
    whole = F.concat("delta", F.coalesce(F.concat("reply", F.lit(TURN_END)), F.lit("")))
    upto = Window.partitionBy("conv_id").orderBy("example").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    start = F.when(F.col("reply").isNotNull(), F.col("context_chars"))
    return examples.select(
        "conv_id",
        "example",
        F.array_join(F.collect_list(whole).over(upto), "").alias("text"),
        (F.col("context_chars") - F.char_length("delta")).alias("new_from"),
        start.alias("loss_from"),
        (start + F.char_length("reply")).alias("loss_to"),
    )


def _cut(start: Column, end: Column) -> Column:
    """Characters [start, end) of ``text``."""
    return F.substring(F.col("text"), start + F.lit(1), end - start)


def prompts(examples: DataFrame) -> DataFrame:
    """The expanded examples as (conv_id, example, prompt, target)."""
    return expand(examples).filter("loss_from IS NOT NULL").select(
        "conv_id",
        "example",
        _cut(F.lit(0), F.col("loss_from")).alias("prompt"),
        _cut(F.col("loss_from"), F.char_length("text")).alias("target"),
    )


def read_examples(expanded: DataFrame) -> DataFrame:
    """(conv_id, example, delta, reply) of the rows of :func:`expand`, by their masks."""
    return expanded.select(
        "conv_id",
        "example",
        _cut(F.col("new_from"), F.coalesce("loss_from", F.char_length("text"))).alias("delta"),
        _cut(F.col("loss_from"), F.col("loss_to")).alias("reply"),
    )


def whole_lengths(expanded: DataFrame) -> DataFrame:
    """(conv_id, formatted_chars): length of the last row's text; an error where a row's context isn't the text of the row before."""
    sha = lambda c: F.sha2(c.cast("binary"), 256)
    link = F.struct("example", sha(_cut(F.lit(0), F.col("new_from"))).alias("context"), sha(F.col("text")).alias("whole"), F.char_length("text").alias("chars"))
    links = F.sort_array(F.collect_list(link))
    ahead = F.concat(F.array(sha(F.lit(""))), F.transform("links", lambda x: x.whole))
    good = F.forall("links", lambda x: x.context == F.get(ahead, x.example.cast("int")))
    chars = F.element_at("links", -1).chars.cast("long")
    return expanded.groupBy("conv_id").agg(links.alias("links")).select(
        "conv_id", F.when(good, chars).otherwise(F.raise_error(F.lit("an example lacks the turns before it")).cast("long")).alias("formatted_chars")
    )


def read_turns(examples: DataFrame) -> DataFrame:
    """Turns read back from the formatted text: (conv_id, example, k, role, text, trainable)."""
    formatted = F.concat("delta", F.coalesce(F.concat("reply", F.lit(TURN_END)), F.lit("")))
    marked = F.filter(F.split(formatted, r"<\|end\|>\n", -1), lambda x: x != "")
    parts = F.transform(marked, lambda x: F.split(F.substring(x, len(ROLE_OPEN) + 1, 2**31 - 1), r"\|>\n", 2))
    return examples.select("conv_id", "example", F.col("reply").isNotNull().alias("has_reply"), F.size(marked).alias("n"), F.posexplode(parts).alias("k", "part")).select(
        "conv_id",
        "example",
        "k",
        unescape(F.col("part")[0]).alias("role"),
        unescape(F.col("part")[1]).alias("text"),
        (F.col("has_reply") & (F.col("k") == F.col("n") - 1)).alias("trainable"),
    )


def op8_chat_format(spark, sf_dir: str) -> DataFrame:
    """Expand all conversations and the probe, write every example, read back and digest per conversation."""
    schema = "conv_id long, turn long, role string, text string"
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet").select(*[F.col(c.split()[0]).cast(c.split()[1]) for c in schema.split(", ")])
    # zstd finds what examples share beyond the reach of the default codec
    written = materialise(expand(format_examples(rows.unionByName(spark.createDataFrame(PROBE, schema)))), "chat", compression="zstd")
    lengths = whole_lengths(written)
    turns = read_turns(read_examples(written))
    row = F.struct("example", "k", F.concat("role", F.lit("\n"), "text", F.lit("\n")).alias("line"), F.when(F.col("trainable"), F.col("text")).alias("loss"))
    joined = turns.groupBy("conv_id").agg(F.sort_array(F.collect_list(row)).alias("rows"))
    said = F.array_join(F.transform("rows", lambda x: x.line), "")
    loss = F.array_join(F.transform("rows", lambda x: F.coalesce(x.loss, F.lit(""))), "")
    return joined.join(lengths, joined.conv_id.eqNullSafe(lengths.conv_id)).select(
        joined.conv_id,
        F.size("rows").cast("long").alias("n_turns"),
        F.sha2(said.cast("binary"), 256).alias("turns_sha256"),
        F.char_length(loss).cast("long").alias("loss_chars"),
        F.sha2(loss.cast("binary"), 256).alias("loss_sha256"),
        "formatted_chars",
    )


ORACLE = r"""
WITH t AS (
  SELECT conv_id, turn, role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-7, 0, 'user', '</s>[INST] ok [/INST]'), (-7, 1, 'assistant', '</s>[INST] ok [/INST]')),
e AS (
  SELECT *, length(role) + length(text)
       + len(regexp_extract_all(role || text, '[\\<\[]')) + 2 + 3 + 8 AS formatted
  FROM t)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       CAST(sum(formatted) AS BIGINT) AS formatted_chars
FROM e GROUP BY conv_id
"""
