"""Operator 2: chat formatting with Spark expressions only.

Turns are sorted, neighbours of one role share a block, and blocks are strung
together. A block is <|role|>, the role, <|text|>, its turns' texts with
<|next|> between them, <|end|>. Inside texts and roles every "<" is written
"<<>", so none of them can hold a marker and each can be read back.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from codeloom.llm import common

ROLE, TEXT, NEXT, END = "<|role|>", "<|text|>", "<|next|>", "<|end|>"
#: "<" is written so inside texts and roles. It begins no marker.
LESS = "<<>"
#: Turn numbers, a power of two, whose turns are put together in one step; conversations are put together from such runs.
RUN = 512


def escaped(text: Column) -> Column:
    return F.replace(text, F.lit("<"), F.lit(LESS))


def unescaped(text: Column) -> Column:
    return F.replace(text, F.lit(LESS), F.lit("<"))


def format_conversations(turns: DataFrame) -> DataFrame:
    """conv_id, formatted of turns(conv_id, turn, role, text).

    Turns sort by turn (null first, then the least, negative ones included), then role and text, so ties and repeated
    rows have one order; repeated rows stay. Null roles and texts are empty;
    a null conv_id is a conversation of its own. Further columns are left out,
    an empty table gives none. Runs of turns are put together first and then
    the runs, so what is collected for one conversation at once is bounded by
    its formatted text alone.
    """
    rows = turns.select(
        F.col("conv_id").cast("bigint").alias("conv_id"),
        F.struct(F.col("turn").cast("bigint").alias("turn"), escaped(F.coalesce(F.col("role"), F.lit(""))).alias("role"), escaped(F.coalesce(F.col("text"), F.lit(""))).alias("text")).alias("t"),
        F.shiftright(F.col("turn").cast("bigint"), RUN.bit_length() - 1).alias("_run"),
    )
    runs = rows.groupBy("conv_id", "_run").agg(F.array_sort(F.collect_list("t")).alias("ts"))
    # blocks of the run: a turn with another role than the one before it begins one
    blocks = F.aggregate(
        F.col("ts"),
        F.array().cast("array<struct<role:string,texts:array<string>>>"),
        lambda done, t: F.when(
            (F.size(done) > 0) & (F.element_at(done, -1)["role"] == t["role"]),
            F.concat(
                F.slice(done, F.lit(1), F.size(done) - 1),
                F.array(F.struct(t["role"].alias("role"), F.array_append(F.element_at(done, -1)["texts"], t["text"]).alias("texts"))),
            ),
        ).otherwise(F.array_append(done, F.struct(t["role"].alias("role"), F.array(t["text"]).alias("texts")))),
    )
    runs = runs.select("conv_id", "_run", blocks.alias("bs"))
    head, last = F.element_at("bs", 1)["role"], F.element_at("bs", -1)["role"]
    strung = F.array_join(F.transform("bs", lambda b: F.concat(F.lit(ROLE), b["role"], F.lit(TEXT), F.array_join(b["texts"], NEXT))), END)
    runs = runs.select("conv_id", F.struct("_run", head.alias("head"), last.alias("last"), strung.alias("body")).alias("r"))
    whole = runs.groupBy("conv_id").agg(F.array_sort(F.collect_list("r")).alias("rs"))
    # runs that meet in one role share that block
    joined = F.zip_with(
        F.col("rs"),
        F.slice(F.concat(F.array(F.lit(None).cast("struct<_run:bigint,head:string,last:string,body:string>")), F.col("rs")), F.lit(1), F.size("rs")),
        lambda r, before: F.when(before.isNull(), r["body"])
        .when(before["last"] == r["head"], F.concat(F.lit(NEXT), F.substr(r["body"], F.length(r["head"]) + F.lit(1 + len(ROLE) + len(TEXT)))))
        .otherwise(F.concat(F.lit(END), r["body"])),
    )
    return whole.select("conv_id", F.concat(F.array_join(joined, ""), F.lit(END)).alias("formatted"))


def blocks_of(formatted: Column) -> Column:
    """array<struct<role, texts>> read back from formatted text."""
    parts = F.filter(F.split(formatted, r"<\|end\|>"), lambda b: F.length(b) > 0)
    return F.transform(
        parts,
        lambda b: F.struct(
            unescaped(F.substring_index(F.substring_index(b, TEXT, 1), ROLE, -1)).alias("role"),
            F.transform(F.split(F.substring_index(b, TEXT, -1), r"<\|next\|>"), unescaped).alias("texts"),
        ),
    )


def read_back(formatted: DataFrame) -> DataFrame:
    """formatted with turns (array<struct<role, text>>) and loss_text: what is under the loss mask, the assistant's texts in order."""
    read = formatted.withColumn("_blocks", blocks_of(F.col("formatted")))
    turns = F.flatten(F.transform("_blocks", lambda b: F.transform(b["texts"], lambda t: F.struct(b["role"].alias("role"), t.alias("text")))))
    loss = F.array_join(F.flatten(F.transform(F.filter("_blocks", lambda b: b["role"] == "assistant"), lambda b: b["texts"])), "")
    return read.withColumns({"turns": turns, "loss_text": loss}).drop("_blocks")


PROBE = "</s>[INST] ok [/INST]"


def op2_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = common.only(common.table(spark, sf_dir, "conversations"), "conv_id", "turn", "role", "text")
    probe = spark.range(2).select(
        F.lit(-7).cast("bigint").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(PROBE).alias("text")
    )
    read = read_back(format_conversations(turns.unionByName(probe)))
    return read.select(
        "conv_id",
        F.size("turns").cast("bigint").alias("n_turns"),
        F.sha2(F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "").cast("binary"), 256).alias("turns_sha256"),
        F.length("loss_text").cast("bigint").alias("loss_chars"),
        F.sha2(F.col("loss_text").cast("binary"), 256).alias("loss_sha256"),
        F.length("formatted").cast("bigint").alias("formatted_chars"),
    )


ORACLE = f"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '{PROBE}' UNION ALL SELECT -7, 1, 'assistant', '{PROBE}'
), marked AS (
  SELECT *, CASE WHEN lag(role) OVER w = role THEN 0 ELSE 1 END AS opens FROM turns
  WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text)
)
SELECT conv_id, count(*) AS n_turns,
  sha256(coalesce(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text), '')) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(length(replace(text, '<', '<<>')) + CASE opens WHEN 1 THEN length(replace(role, '<', '<<>')) + 8 + 8 + 7 ELSE 8 END) AS BIGINT) AS formatted_chars
FROM marked GROUP BY conv_id
"""
