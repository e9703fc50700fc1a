"""Chat formatting with DataFrame expressions only.

The turns of a conversation are collected as structs and sorted by (turn, role, text), nulls first; adjacent turns of
one role become one block:

    assistant block   <s>text[SEP]text...</s>
    any other role    [INST]role\\ntext[SEP]text...[/INST]

Control strings inside texts and roles are escaped with ~ (~0 is ~, ~1 is <, ~2 is [, ~3 a newline in a role), only
where they would else be read as control strings, so the output has none but its own and can be read back exactly.
``loss_spans`` covers each assistant text (without markers) by code points of the output.

Null texts and roles count as empty; a null conversation id is a group of its own; repeated rows and ties are all
kept; an empty table gives no rows; extra columns are ignored. One conversation becomes one string, so a conversation
must fit a Spark string (2 GB); its turns are gathered by a partial aggregation on the map side first.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

_STEP = 512


def escape(text: Column) -> Column:
    out = F.regexp_replace(text, r"~(?=[0-3])", "~0")
    out = F.regexp_replace(out, r"<(?=/?s>)", "~1")
    return F.regexp_replace(out, r"\[(?=/?INST\]|SEP\])", "~2")


def unescape(text: Column) -> Column:
    for code, char in (("~3", "\n"), ("~2", "["), ("~1", "<"), ("~0", "~")):
        text = F.replace(text, F.lit(code), F.lit(char))
    return text


def _total(lengths: Column) -> Column:
    return F.aggregate(lengths, F.lit(0), lambda a, x: a + x)


def _indexes(count: Column) -> Column:
    return F.when(count > 0, F.sequence(F.lit(0), count - 1)).otherwise(F.array().cast("array<int>"))


def _starts(lengths: str) -> Column:
    """Sum of what stands before each element: whole runs of _STEP elements first, then the rest of the own run."""
    n, runs = F.size(lengths), F.col(f"{lengths}_runs")
    return F.transform(_indexes(n), lambda i: _total(F.slice(runs, F.lit(1), (i / _STEP).cast("int"))) + _total(F.slice(F.col(lengths), (i / _STEP).cast("int") * _STEP + 1, i % _STEP)))


def format_chats(rows: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """One row per conversation: id, formatted string, loss_spans (start and length in code points), n_blocks."""
    one = F.struct(F.col(turn_col).alias("turn"), F.coalesce(F.col(role_col), F.lit("")).alias("role"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    turns = rows.select(F.col(id_col).alias("_id"), one.alias("t")).groupBy("_id").agg(F.sort_array(F.collect_list("t")).alias("turns"))
    role = lambda i: F.element_at("turns", i + 1)["role"]
    turns = turns.withColumn("n", F.size("turns"))
    turns = turns.withColumn("first", F.filter(_indexes(F.col("n")), lambda i: F.when(i == 0, True).otherwise(role(i) != F.element_at("turns", F.greatest(i, F.lit(1)))["role"])))
    turns = turns.withColumn("last", F.concat(F.transform(F.slice("first", 2, F.greatest(F.size("first") - 1, F.lit(0))), lambda i: i - 1), F.array(F.col("n") - 1)))

    def block(b: Column) -> Column:
        """Segments of a block; loss marks the texts of the assistant."""
        who = role(b["first"])
        mine = who == "assistant"
        seg = lambda text, loss: F.struct(text.alias("text"), loss.alias("loss"))
        texts = F.transform(F.slice("turns", b["first"] + 1, b["last"] - b["first"] + 1), lambda t: F.array(seg(F.lit("[SEP]"), F.lit(False)), seg(escape(t["text"]), mine)))
        flat = F.flatten(texts)
        head = F.when(mine, F.lit("<s>")).otherwise(F.concat(F.lit("[INST]"), F.replace(escape(who), F.lit("\n"), F.lit("~3")), F.lit("\n")))
        tail = F.when(mine, F.lit("</s>")).otherwise(F.lit("[/INST]"))
        return F.concat(F.array(seg(head, F.lit(False))), F.slice(flat, F.lit(2), F.size(flat) - 1), F.array(seg(tail, F.lit(False))))

    out = turns.withColumn("blocks", F.arrays_zip("first", "last")).withColumn("segments", F.flatten(F.transform("blocks", block)))
    out = out.withColumn("lens", F.transform("segments", lambda s: F.length(s["text"])))
    out = out.withColumn("lens_runs", F.transform(_indexes(F.ceil(F.size("lens") / _STEP).cast("int")), lambda i: _total(F.slice("lens", i * _STEP + 1, F.lit(_STEP)))))
    out = out.withColumn("starts", _starts("lens"))
    spans = F.transform(F.filter(F.arrays_zip("segments", "starts", "lens"), lambda z: z["segments"]["loss"]), lambda z: F.struct(z["starts"].alias("start"), z["lens"].alias("length")))
    return out.select(F.col("_id").alias(id_col), F.array_join(F.transform("segments", lambda s: s["text"]), "").alias("formatted"), spans.alias("loss_spans"), F.size("first").alias("n_blocks"))


def read_back(formatted: DataFrame) -> DataFrame:
    """Adds ``turns`` (role, text, in order) and ``loss_text``, both taken from the formatted string alone."""

    def parse(b: Column) -> Column:
        mine = F.startswith(b, F.lit("<s>"))
        body = F.when(mine, F.substring(b, F.lit(4), F.length(b) - 7)).otherwise(F.substring(b, F.lit(7), F.length(b) - 13))
        head = F.when(mine, F.lit("assistant")).otherwise(F.substring_index(body, "\n", 1))
        texts = F.when(mine, body).otherwise(F.substring(body, F.length(head) + 2, F.length(body)))
        return F.transform(F.split(texts, r"\[SEP\]", -1), lambda t: F.struct(unescape(head).alias("role"), unescape(t).alias("text")))

    blocks = F.regexp_extract_all("formatted", F.lit(r"(?s)(\[INST\].*?\[/INST\]|<s>.*?</s>)"), F.lit(1))
    loss = F.transform("loss_spans", lambda s: unescape(F.substring(F.col("formatted"), s["start"] + 1, s["length"])))
    return formatted.withColumn("turns", F.flatten(F.transform(blocks, parse))).withColumn("loss_text", F.array_join(loss, ""))


def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.lit("</s>[INST] ok [/INST]")
    probe = spark.range(1).select(F.explode(F.array(*(F.struct(F.lit(-1).cast("long").alias("conv_id"), F.lit(i).cast("long").alias("turn"), F.lit(r).alias("role"), text.alias("text")) for i, r in enumerate(("user", "assistant"))))).alias("r")).select("r.*")
    rows = common.table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(probe)
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return read_back(format_chats(rows)).select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(said.cast("binary"), 256).alias("turns_sha256"),
        F.length("loss_text").cast("long").alias("loss_chars"), F.sha2(F.col("loss_text").cast("binary"), 256).alias("loss_sha256"), F.length("formatted").cast("long").alias("formatted_chars"),
    )


ORACLE = r"""
WITH r AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
w AS (
  SELECT *, lag(role) OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS before,
    regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '~([0-3])', '~0\1', 'g'), '<(/?s>)', '~1\1', 'g'), '\[(/?INST\])', '~2\1', 'g'), '\[(SEP\])', '~2\1', 'g') AS safe,
    replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(role, '~([0-3])', '~0\1', 'g'), '<(/?s>)', '~1\1', 'g'), '\[(/?INST\])', '~2\1', 'g'), '\[(SEP\])', '~2\1', 'g'), chr(10), '~3') AS safe_role
  FROM r)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  coalesce(sum(CASE WHEN role = 'assistant' THEN length(text) END), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(CASE WHEN role = 'assistant' THEN text END, '' ORDER BY turn NULLS FIRST, role, text), '')) AS loss_sha256,
  sum(length(safe) + CASE WHEN before = role THEN 5 WHEN role = 'assistant' THEN 7 ELSE 14 + length(safe_role) END)::BIGINT AS formatted_chars
FROM w GROUP BY conv_id
"""
