"""Query op1: all conversations formatted, and read back from the formatted text."""

from pyspark.sql import functions as F

from questline.llm import chat
from questline.llm.common import read

HARD = "</s>[INST] ok [/INST]"  # control strings as text, for a conversation of its own


def op1_chat_format(spark, d):
    rows = read(spark, d, "conversations").select("conv_id", "turn", "role", "text")
    own = spark.range(2).select(
        F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(HARD).alias("text"),
    )
    records = rows.unionByName(own).select(
        "conv_id", "turn", F.to_json(F.struct("role", "text"), {"ignoreNullFields": "false"}).alias("record")
    )
    turns = chat.canonical_turns(records, "record", ["conv_id", "turn"])
    return chat.digests(chat.formatted_turns(turns), "conv_id", ["turn", "position"])


QUERIES = {"op1_chat_format": op1_chat_format}
ORACLE = {"op1_chat_format": r"""
with turns as (
  select conv_id, turn, role, coalesce(text, '') as text from conversations
  union all select -1, 0, 'user', '</s>[INST] ok [/INST]'
  union all select -1, 1, 'assistant', '</s>[INST] ok [/INST]'
), plain as (
  select conv_id, turn, coalesce(role, '') as role, text,
         regexp_replace(replace(text, '\', '\\'), '(<)(\|im_start\|>|\|im_sep\|>|\|im_end\|>|\|endoftext\|>|\|system\|>|\|user\|>|\|assistant\|>|\|eot_id\|>|\|start_header_id\|>|\|end_header_id\|>|\|begin_of_text\|>|\|end_of_text\|>|s>|/s>|<SYS>>|</SYS>>|start_of_turn>|end_of_turn>)', '\1\\\2', 'g') as once
  from turns
)
select conv_id, cast(count(*) as bigint) as n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn, role, text)) as turns_sha256,
       cast(coalesce(sum(length(text)) filter (role = 'assistant'), 0) as bigint) as loss_chars,
       sha256(coalesce(string_agg(text, '' order by turn, role, text) filter (role = 'assistant'), '')) as loss_sha256,
       cast(sum(length(role) + length(regexp_replace(once, '(\[)(INST\]|/INST\])', '\1\\\2', 'g')) + 32) as bigint) as formatted_chars
from plain group by conv_id
"""}
