r"""Operator 9: relational chat formatting, with Spark expressions only.

The turns of a conversation are collected as structs and sorted by turn, role and text; turns of
one role in a row are merged into a block under one header, by arrays. The template is

    ### role:\n            before each block
    text</turn>\n          for each turn

and texts are escaped so that no control string stands in them: \ becomes \b, then ### becomes
\h and </turn> becomes \t (roles also : to \c). Every \ of an escaped text begins a pair, so
taking the pairs back, \b last, restores the text. parsed() reads turns back from the formatted
text alone. The loss mask covers the escaped texts of assistant turns, as code point ranges.

A formatted conversation is one value, so all its turns meet in one row: a conversation must
fit Spark's limit for one cell, however many others there are.

Defined results: null role or text is empty, a null turn sorts first, equal rows stay as often
as they come, an empty text is a turn of no characters. Rows whose conversation is null form
one conversation.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.arrays import let, running_ends
from .common import read_table, text_or_empty

#: Fixed values of the template.
HEAD, COLON, END = "### ", ":\n", "</turn>\n"
PAIRS = (("\\", "\\b"), ("###", "\\h"), ("</turn>", "\\t"))
ROLE_PAIRS = (*PAIRS, (":", "\\c"))
TRAINED_ROLE = "assistant"


def escaped(c: Column, pairs=PAIRS) -> Column:
    for raw, pair in pairs:
        c = F.replace(c, F.lit(raw), F.lit(pair))
    return c


def unescaped(c: Column, pairs=PAIRS) -> Column:
    for raw, pair in reversed(pairs):
        c = F.replace(c, F.lit(pair), F.lit(raw))
    return c


def formatted(turns: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """A row per conversation: conv_id, formatted, and loss_mask (start and end of each trained range)."""
    own = turns.select(F.col(conv_id).alias("conv_id"), F.struct(F.col(turn).alias("turn"), text_or_empty(role).alias("role"), text_or_empty(text).alias("text")).alias("t"))
    sorted_turns = own.groupBy("conv_id").agg(F.array_sort(F.collect_list("t")).alias("turns"))
    n = F.size("turns")
    role_at = lambda i: F.element_at("turns", i)["role"]
    starts = F.filter(F.sequence(F.lit(1), n), lambda i: (i == 1) | (role_at(i) != role_at(F.greatest(i - 1, F.lit(1)))))
    blocks = sorted_turns.withColumn("starts", starts).withColumn(
        "blocks",
        F.transform(
            "starts",
            lambda at, k: F.struct(
                role_at(at).alias("role"),
                F.transform(F.slice("turns", at, F.coalesce(F.get("starts", k + 1), n + 1) - at), lambda t: escaped(t["text"])).alias("texts"),
            ),
        ),
    )
    # Pieces of the output in order; a piece is trained or not.
    piece = lambda s, trained: F.struct(s.alias("s"), trained.alias("trained"))
    pieces = F.flatten(
        F.transform(
            "blocks",
            lambda b: F.concat(
                F.array(piece(F.concat(F.lit(HEAD), escaped(b["role"], ROLE_PAIRS), F.lit(COLON)), F.lit(False))),
                F.flatten(F.transform(b["texts"], lambda s: F.array(piece(s, b["role"] == TRAINED_ROLE), piece(F.lit(END), F.lit(False))))),
            ),
        )
    )
    cut = blocks.select("conv_id", pieces.alias("pieces"))
    ends = running_ends(F.transform("pieces", lambda p: F.length(p["s"])))
    range_of = lambda p, end: F.when(p["trained"], F.struct((end - F.length(p["s"])).alias("start"), end.alias("end")))
    mask = F.filter(F.zip_with("pieces", ends, range_of), lambda m: m.isNotNull())
    return cut.select("conv_id", F.array_join(F.transform("pieces", lambda p: p["s"]), "").alias("formatted"), mask.alias("loss_mask"))


def parsed(text: Column) -> Column:
    """The turns (role, text) of a formatted text, as an array. Each block begins with the one HEAD in it, and each turn ends with an END."""
    turn_texts = lambda block: F.split(F.substr(block, F.locate(COLON, block) + len(COLON)), END, -1)
    turns = lambda role, texts: F.transform(F.slice(texts, 1, F.size(texts) - 1), lambda s: F.struct(role.alias("role"), unescaped(s).alias("text")))
    block = lambda b: let(unescaped(F.substring_index(b, COLON, 1), ROLE_PAIRS), lambda role: let(turn_texts(b), lambda texts: turns(role, texts)))
    return let(F.split(text, HEAD, -1), lambda blocks: F.flatten(F.transform(F.slice(blocks, 2, F.size(blocks)), block)))


def op9_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = read_table(spark, sf_dir, "conversations").select("conv_id", F.col("turn").cast("long").alias("turn"), "role", "text")
    extra = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit("\\### Assistant: </turn> ok").alias("text"))
    made = formatted(turns.unionByName(extra))
    back = made.withColumn("turns", parsed(F.col("formatted")))
    under_mask = F.array_join(F.transform("loss_mask", lambda m: unescaped(F.substr("formatted", m["start"] + 1, m["end"] - m["start"]))), "")
    return back.withColumn("loss", under_mask).select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), ""), 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


OP9_SQL = r"""
WITH c AS (SELECT conv_id, CAST(turn AS BIGINT) AS turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
e AS (SELECT *, length(replace(replace(replace(text, '\', '\b'), '###', '\h'), '</turn>', '\t')) + 8 AS n,
  CASE WHEN lag(role) OVER w IS DISTINCT FROM role THEN 6 + length(replace(replace(replace(replace(role, '\', '\b'), '###', '\h'), '</turn>', '\t'), ':', '\c')) ELSE 0 END AS head
  FROM c WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text)),
g AS (SELECT conv_id, count(*) AS n_turns, string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text) AS turns,
  coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (WHERE role = 'assistant'), '') AS loss, CAST(sum(n + head) AS BIGINT) AS formatted_chars FROM e GROUP BY conv_id)
SELECT conv_id, CAST(n_turns AS BIGINT) AS n_turns, sha256(turns) AS turns_sha256, CAST(length(loss) AS BIGINT) AS loss_chars, sha256(loss) AS loss_sha256, formatted_chars FROM g
"""
