"""Chat formatting of reply trees, in DataFrame operations only.

A message names its parent. Iterative self-joins double the reach of each message's ancestor link, so a tree of depth
d takes log2(d) joins; every leaf's path gets a score, the best paths of a root are chosen, and each becomes one
conversation under a template that marks turns and escapes control strings inside texts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from verdancy.llm.storage import dropped, stored

# The template's control strings and the escapes of the two characters that begin one.
BEGIN, MIDDLE, END = "<|turn|>", "<|says|>", "<|done|>\n"
ESCAPES = (("&", "&amp;"), ("<", "&lt;"), ("[", "&lsqb;"))
TRAINED_ROLE = "assistant"


def escaped(text: Column) -> Column:
    """Text without `<` and `[`, so that no control string of this or a bracket template can occur in it."""
    for plain, code in ESCAPES:
        text = F.replace(text, F.lit(plain), F.lit(code))
    return text


def unescaped(text: Column) -> Column:
    for plain, code in reversed(ESCAPES):
        text = F.replace(text, F.lit(code), F.lit(plain))
    return text


def reply_paths(messages: DataFrame, keep: int = 1) -> DataFrame:
    """The best root-to-leaf paths of reply trees: root, rank, depth, id for each message of a chosen path.

    messages: id, parent (null at a root), score. A path scores the sum of its messages' scores (null: 0); ties go to
    the smaller leaf id. Links double in reach with each self-join; then the chosen leaves' paths are read off by
    jumps of falling length. A message whose parent isn't in the table hangs below no root and is left out, as is a
    ring of replies; a repeated id counts once.
    """
    nodes = stored(messages.where("id is not null").groupBy("id").agg(F.min("parent").alias("parent"), F.max(F.coalesce("score", F.lit(0.0))).cast("double").alias("score")))
    hop = stored(nodes.select("id", F.col("parent").alias("to"), F.coalesce("parent", "id").alias("top"), "score", F.lit(1).cast("long").alias("len")))
    jumps, reach, left = [], 1, None
    while (now := hop.where("to is not null").count()) and now != left:  # rings alone never get fewer
        jumps.append((reach, hop))
        left = now
        up = hop.select(F.col("id").alias("to"), F.col("to").alias("to2"), F.col("top").alias("top2"), F.col("score").alias("score2"), F.col("len").alias("len2"))
        ahead = hop.where("to is not null").join(up, "to")  # a parent that isn't there ends a path below no root
        ahead = ahead.select("id", F.col("to2").alias("to"), F.col("top2").alias("top"), (F.col("score") + F.col("score2")).alias("score"), (F.col("len") + F.col("len2")).alias("len"))
        hop = stored(hop.where("to is null").union(ahead))
        reach *= 2
    # hop now holds, for all that hang below a root, the whole path's root, score and length
    leaves = hop.where("to is null").join(nodes.select(F.col("parent").alias("id")).where("id is not null").distinct(), "id", "left_anti")
    scored = leaves.select(F.col("id").alias("leaf"), "score", "len", F.col("top").alias("root"))
    rank = F.row_number().over(Window.partitionBy("root").orderBy(F.desc("score"), "leaf"))
    chosen = stored(scored.withColumn("rank", rank).where(F.col("rank") <= keep))
    path = stored(chosen.select("leaf", F.col("leaf").alias("id"), F.lit(0).cast("long").alias("up")))
    for reach, jump in reversed(jumps):
        ahead, before = jump.where("to is not null").select("id", F.col("to").alias("above")), path
        path = stored(before.union(before.join(ahead, "id").select("leaf", F.col("above").alias("id"), (F.col("up") + reach).alias("up"))))
        dropped(before)
    out = stored(path.join(chosen, "leaf").select("root", "rank", (F.col("len") - 1 - F.col("up")).alias("depth"), "id"))
    dropped(nodes, hop, chosen, path, *(j for _, j in jumps))
    return out


def formatted(turns: DataFrame, trained_role: str = TRAINED_ROLE) -> DataFrame:
    """One row per path: the formatted text and its loss mask as spans of code points.

    turns: path, at (order), role, text. Null roles and texts are empty. The mask covers the escaped text of each turn
    of the trained role, nothing else. An empty table gives an empty result; extra columns are ignored.
    """
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    head = F.concat(F.lit(BEGIN), escaped(role), F.lit(MIDDLE))
    part = F.struct("at", F.concat(head, escaped(text), F.lit(END)).alias("full"), F.length(head).alias("head"), F.length(escaped(text)).alias("body"), (role == trained_role).alias("trained"))
    rows = turns.groupBy("path").agg(F.sort_array(F.collect_list(part)).alias("parts"))
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,length:int>>").alias("spans"))

    def grow(acc: Column, p: Column) -> Column:
        span = F.array(F.struct((acc["at"] + p["head"]).alias("start"), p["body"].alias("length")))
        return F.struct((acc["at"] + F.length(p["full"])).alias("at"), F.when(p["trained"], F.concat(acc["spans"], span)).otherwise(acc["spans"]).alias("spans"))

    return rows.select("path", F.concat_ws("", F.transform("parts", lambda p: p["full"])).alias("formatted"), F.aggregate("parts", start, grow)["spans"].alias("loss_spans"))


def read_back(formatted: Column) -> Column:
    """Turns of a formatted conversation: array of (role, text)."""
    marked = F.filter(F.split(formatted, r"<\|turn\|>"), lambda x: x != "")

    def turn(x: Column) -> Column:
        body = F.substring_index(x, MIDDLE, -1)
        return F.struct(unescaped(F.substring_index(x, MIDDLE, 1)).alias("role"), unescaped(F.substring(body, F.lit(1), F.length(body) - len(END))).alias("text"))

    return F.transform(marked, turn)


def linear_trees(conversations: DataFrame) -> DataFrame:
    """Rows of (conv_id, turn, role, text) as messages of a tree in which each turn answers the one before it.

    Ties and repeated turns are told apart by role and text and kept. Null conv_ids form one conversation of their own.
    """
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    numbered = conversations.select("conv_id", "turn", "role", "text").withColumn("nth", F.row_number().over(order))
    key = lambda n: F.struct(F.coalesce(F.col("conv_id").cast("string"), F.lit("")).alias("conv"), n.alias("nth"))
    return numbered.select("conv_id", key(F.col("nth")).alias("id"), F.when(F.col("nth") > 1, key(F.col("nth") - 1)).alias("parent"), F.length("text").cast("double").alias("score"), "role", "text")


def format_trees(messages: DataFrame, keep: int = 1) -> DataFrame:
    """The `keep` best paths of each reply tree, formatted: root, rank, formatted, loss_spans. A repeated id counts once; an empty table gives an empty result; extra columns are ignored."""
    messages = stored(messages)
    paths = reply_paths(messages, keep)
    turns = paths.join(messages.select("id", "role", "text").dropDuplicates(["id"]), "id").select(F.struct("root", "rank").alias("path"), F.col("depth").alias("at"), "role", "text")
    return formatted(turns).select("path.root", "path.rank", "formatted", "loss_spans")


def op4_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations and one that holds control strings, formatted and read back."""
    given = spark.read.parquet(f"{sf_dir}/conversations.parquet").select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", "text")
    said = "</s>[INST] ok [/INST]"
    own = spark.range(2).select(F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(said).alias("text"))
    out = format_trees(linear_trees(given.union(own)))
    turns, f = read_back(F.col("formatted")), F.col("formatted")
    loss = F.concat_ws("", F.transform("loss_spans", lambda s: unescaped(F.substring(f, s["start"] + 1, s["length"]))))
    plain = F.concat_ws("", F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))))
    back = out.select(F.when(F.col("root.conv") != "", F.col("root.conv")).cast("long").alias("conv_id"), turns.alias("turns"), loss.alias("loss"), "formatted")
    return back.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(plain, 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


OP4_SQL = """
WITH given AS (
  SELECT conv_id::BIGINT AS conv_id, turn::BIGINT AS turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'
), sized AS (
  SELECT *, length(replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '[', '&lsqb;'))
          + length(replace(replace(replace(role, '&', '&amp;'), '<', '&lt;'), '[', '&lsqb;')) + 25 AS chars FROM given
)
SELECT conv_id, count(*)::BIGINT AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum(chars)::BIGINT AS formatted_chars
FROM sized GROUP BY conv_id
"""
