"""Chat formatting by prefix-target expansion, in DataFrame functions only.

A turn is written as ``### role: text</turn>`` and a line feed. Control strings
inside roles and texts are escaped so that they never appear literally, which
makes the formatted text readable again by plain splitting.

Every assistant turn becomes an example of its own: all preceding turns are its
context and only the reply lies under the loss mask. Examples are kept as end
and loss offsets into the conversation's formatted text (which is stored once),
so a conversation of n turns costs n, not n squared. ``expand_examples`` makes
them rows; ``materialize_examples`` writes the texts out where a trainer wants
them.

Edge cases: null texts and roles count as empty; turns with equal numbers are
ordered by role, then text; repeated rows stay; a conversation without an
assistant turn has no examples; a null conversation id is a conversation of its
own; an empty table gives no rows; other columns may have any name. Offsets
count code points.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

HEAD, COLON, END = "### ", ": ", "</turn>\n"


def _replace(c: Column, a: str, b: str) -> Column:
    return F.replace(c, F.lit(a), F.lit(b))


def escape(c: Column) -> Column:
    c = _replace(c, "\\", "\\\\")
    c = _replace(c, "###", "\\#\\#\\#")
    return _replace(c, "</turn>", "<\\/turn>")


def escape_role(c: Column) -> Column:
    return _replace(escape(c), ":", "\\:")


def unescape(c: Column) -> Column:
    return F.regexp_replace(c, r"(?s)\\(.)", "$1")


def format_conversations(
    turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", trained: str = "assistant"
) -> DataFrame:
    """One row per conversation: ``formatted`` and ``examples``.

    ``examples`` holds, per assistant turn in order, the turn's position, the
    length of the prefix that is the example, and the loss span within it.
    Offsets are running sums over a conversation's rows, so that its length may
    be any; window and grouping share one shuffle.
    """
    slim = turns.select(
        F.col(conv).alias("conv"),
        F.col(turn).alias("n"),
        F.coalesce(F.col(role).cast("string"), F.lit("")).alias("role"),
        F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"),
    )
    by = Window.partitionBy("conv").orderBy("n", "role", "text")
    rows = slim.withColumn("turn", F.row_number().over(by) - 1).select(
        "conv",
        "turn",
        (F.col("role") == trained).alias("trained"),
        F.concat(F.lit(HEAD), escape_role(F.col("role")), F.lit(COLON)).alias("head"),
        escape(F.col("text")).alias("body"),
    )
    rows = rows.withColumn("size", F.length("head") + F.length("body") + len(END))
    end = F.sum("size").over(Window.partitionBy("conv").orderBy("turn")).cast("int")
    rows = rows.select("conv", "turn", "trained", end.alias("end"), (end - F.length("body") - len(END)).alias("loss_start"), F.concat("head", "body", F.lit(END)).alias("piece"))
    grouped = rows.groupBy("conv").agg(F.array_sort(F.collect_list(F.struct("turn", "trained", "end", "loss_start", "piece"))).alias("rows"))
    spans = F.transform(
        F.filter("rows", lambda r: r["trained"]),
        lambda r: F.struct(r["turn"].alias("turn"), r["end"].alias("end"), r["loss_start"].alias("loss_start"), (r["end"] - len(END)).alias("loss_end")),
    )
    return grouped.select(F.col("conv").alias(conv), F.array_join(F.transform("rows", lambda r: r["piece"]), "").alias("formatted"), spans.alias("examples"))


def expand_examples(formatted: DataFrame, keep: list[str], outer: bool = False) -> DataFrame:
    """One row per example: ``keep``, ``formatted`` and the example ``e`` (turn, end, loss span).

    The example's text is the first ``e.end`` characters of ``formatted``. With
    ``outer`` a conversation without an example keeps one row with a null ``e``.
    """
    explode = F.explode_outer if outer else F.explode
    return formatted.select(*keep, "formatted", explode("examples").alias("e"))


def target(example: Column, e: Column) -> Column:
    """The reply that an example is trained on: its text under the loss mask, unescaped."""
    return unescape(F.substring(example, e["loss_start"] + 1, e["loss_end"] - e["loss_start"]))


def materialize_examples(formatted: DataFrame, conv: str = "conv_id") -> DataFrame:
    """One row per example: its text, and the loss span within it."""
    return expand_examples(formatted, [conv]).select(
        conv,
        F.col("e.turn").alias("target_turn"),
        F.substring("formatted", F.lit(1), F.col("e.end")).alias("example"),
        F.col("e.loss_start").alias("loss_start"),
        F.col("e.loss_end").alias("loss_end"),
    )


def parse_turns(formatted: Column) -> Column:
    """The (role, text) structs of a formatted text."""
    cut = F.split(formatted, "</turn>\\n", -1)
    turns = F.slice(cut, F.lit(1), F.greatest(F.size(cut) - 1, F.lit(0)))
    head = r"(?s)^### ((?:[^\\:]++|\\.)*+): "
    return F.transform(
        turns,
        lambda t: F.struct(
            unescape(F.regexp_extract(t, head, 1)).alias("role"),
            unescape(F.substr(t, F.length(F.regexp_extract(t, head, 0)) + 1)).alias("text"),
        ),
    )


def op7_chat_prefix(spark, sf_dir: str) -> DataFrame:
    from ._common import table

    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    hard = r"'\\### Assistant: </turn> ok'"
    extra = spark.sql(
        f"SELECT cast(-7 AS bigint) conv_id, cast(turn AS bigint) turn, role, text FROM VALUES (0, 'user', {hard}), (1, 'assistant', {hard}) t(turn, role, text)"
    )
    out = format_conversations(turns.unionByName(extra))
    parsed = out.select("conv_id", "formatted", "examples", parse_turns(F.col("formatted")).alias("turns")).select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), ""), 256).alias("turns_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
        "formatted",
        "examples",
    )
    whole = ["conv_id", "n_turns", "turns_sha256", "formatted_chars"]
    # each reply is read through its own example; the rows of a conversation stay in one partition
    replies = expand_examples(parsed, whole, outer=True).select(*whole, F.col("e.turn").alias("turn"), target(F.col("formatted"), F.col("e")).alias("reply"))
    gathered = replies.groupBy(*whole).agg(F.array_sort(F.collect_list(F.struct("turn", "reply"))).alias("replies"))
    loss = F.array_join(F.transform("replies", lambda r: r["reply"]), "")
    return gathered.withColumn("loss", loss).select(
        "conv_id",
        "n_turns",
        "turns_sha256",
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        "formatted_chars",
    )


OP7_SQL = r"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'
), e AS (
  SELECT *, length(replace(replace(replace(text, '\', '\\'), '###', '\#\#\#'), '</turn>', '<\/turn>'))
    + length(replace(replace(replace(replace(role, '\', '\\'), '###', '\#\#\#'), '</turn>', '<\/turn>'), ':', '\:')) + 14 AS chars
  FROM t
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  cast(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS bigint) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  cast(sum(chars) AS bigint) AS formatted_chars
FROM e GROUP BY conv_id
"""
