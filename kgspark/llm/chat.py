"""Chat formatting by replaying an event log. DataFrame functions only.

An event has conv_id, turn, seq, kind, role, text.  Kinds: message (a whole
message of its own), delta (appended to the turn's streamed message), edit
(replaces everything the turn had before it) and regenerate (discards this and
all later turns as they were before it; deltas that follow rebuild them).
Events are dealt by conversation and block of BLOCK turns, sorted by turn and
sequence, folded to final messages and rendered; a conversation's blocks are
joined last, so a long conversation is rendered by many tasks.

Template: <|start|>role<|text|>text<|end|>.  In roles and texts a backslash is
doubled and control strings (the template's own, </s>, <s>, [INST], [/INST],
<<SYS>>, <</SYS>>) get a backslash after their first character, so none is
left and unescape() restores every text.

Defined cases: null role or text is empty; a null turn sorts first, in a block
of its own, and only its own resets reach it; a null conv_id is one
conversation; rows equal in turn keep (seq, role, text) order; repeated message rows are repeated
turns; other kinds are ignored; extra columns are left out; an empty log gives
no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from kgspark.llm.common import load

#: Turns rendered by one task.
BLOCK = 64
CONTROL = r"(<)(?=\|(?:start|text|end)\|>|/?s>|</?SYS>>)|(\[)(?=/?INST\])"


def block_of(turn: str) -> Column:
    """Block of BLOCK turns; null turns have one of their own, before all others."""
    return F.when(F.col(turn).isNull(), F.lit(-(1 << 60))).otherwise(F.floor(F.col(turn) / BLOCK))


def escape(text: Column) -> Column:
    return F.regexp_replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), CONTROL, r"$1$2\\")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def fold(events: DataFrame) -> DataFrame:
    """Final messages: conv_id, turn, seq, role, text.

    An event is dead if a later edit of its turn, or a later regeneration of its turn or an earlier one, exists.  The latest
    regeneration up to a turn is a running maximum within the turn's block; that of all earlier blocks is a running
    maximum over one row a block.
    """
    e = events.select("conv_id", "turn", "seq", "kind", "role", F.coalesce("text", F.lit("")).alias("text"), block_of("turn").alias("block"))
    regenerated = lambda s: F.max(F.when(F.col("kind") == "regenerate", F.col(s)))
    in_block = W.partitionBy("conv_id", "block").orderBy(F.col("turn").asc_nulls_first()).rangeBetween(W.unboundedPreceding, W.currentRow)
    by_turn = W.partitionBy("conv_id", "block", "turn")
    marked = e.withColumn("within", regenerated("seq").over(in_block)).withColumn("edited", F.max(F.when(F.col("kind") == "edit", F.col("seq"))).over(by_turn))
    tops = e.groupBy("conv_id", "block").agg(regenerated("seq").alias("top"))
    tops = tops.withColumn("before", F.max("top").over(W.partitionBy("conv_id").orderBy("block").rowsBetween(W.unboundedPreceding, -1)))
    tops = tops.where("before is not null").select(F.col("conv_id").alias("c"), F.col("block").alias("b"), "before")
    known = marked.join(tops, marked["conv_id"].eqNullSafe(tops["c"]) & (marked["block"] == tops["b"]), "left")
    # A null turn is under the resets of null turns alone: it sorts first and its block holds nothing but null turns.
    reset = F.greatest("within", "edited", F.when(F.col("turn").isNotNull(), F.col("before")))
    live = known.where(reset.isNull() | (F.col("seq") >= reset)).select("conv_id", "block", "turn", "seq", "kind", "role", "text")
    item = F.struct("seq", "role", "text")
    of = lambda *kinds: F.collect_list(F.when(F.col("kind").isin(*kinds), item))
    turns = live.groupBy("conv_id", "block", "turn").agg(of("message").alias("whole"), F.sort_array(of("delta", "edit")).alias("p"))
    streamed = F.struct(F.col("p")[0]["seq"].alias("seq"), F.expr("filter(p.role, r -> r is not null)[0]").alias("role"), F.array_join("p.text", "").alias("text"))
    each = F.concat("whole", F.when(F.size("p") > 0, F.array(streamed)).otherwise(F.array().cast("array<struct<seq:bigint,role:string,text:string>>")))
    return turns.select("conv_id", "turn", F.explode(each).alias("x")).select("conv_id", "turn", "x.seq", "x.role", "x.text")


def render(messages: DataFrame) -> DataFrame:
    """Blocks: conv_id, block, n_turns, formatted, loss_spans (start and length of assistant texts in formatted, in characters)."""
    piece = F.struct("turn", "seq", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    sorted_ = messages.groupBy("conv_id", block_of("turn").alias("block")).agg(F.sort_array(F.collect_list(piece)).alias("m"))
    head = lambda x: F.concat(F.lit("<|start|>"), escape(x["role"]), F.lit("<|text|>"))
    parts = F.transform("m", lambda x: F.struct(head(x).alias("head"), escape(x["text"]).alias("body"), (x["role"] == "assistant").alias("loss")))
    zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,length:int>>").alias("spans"))

    def step(s: Column, x: Column) -> Column:
        start, length = s["at"] + F.length(x["head"]), F.length(x["body"])
        span = F.when(x["loss"], F.array(F.struct(start.alias("start"), length.alias("length")))).otherwise(F.array().cast("array<struct<start:int,length:int>>"))
        return F.struct((start + length + F.length(F.lit("<|end|>"))).alias("at"), F.concat(s["spans"], span).alias("spans"))

    out = sorted_.select("conv_id", "block", parts.alias("p"))
    return out.select(
        "conv_id", "block", F.size("p").cast("long").alias("n_turns"),
        F.array_join(F.transform("p", lambda x: F.concat(x["head"], x["body"], F.lit("<|end|>"))), "").alias("formatted"),
        F.aggregate("p", zero, step)["spans"].alias("loss_spans"),
    )


def join_blocks(blocks: DataFrame, *texts: str) -> DataFrame:
    """One row a conversation: n_turns and the named text columns, each joined over its blocks."""
    got = blocks.groupBy("conv_id").agg(F.sum("n_turns").alias("n_turns"), F.sort_array(F.collect_list(F.struct("block", *texts))).alias("b"))
    return got.select("conv_id", "n_turns", *[F.array_join(f"b.{t}", "").alias(t) for t in texts])


def format_conversations(events: DataFrame) -> DataFrame:
    """conv_id, n_turns, formatted."""
    return join_blocks(render(fold(events)), "formatted")


def read_back(blocks: DataFrame) -> DataFrame:
    """From formatted blocks alone: conv_id, block, n_turns, plain (role, newline, text, newline each) and loss_text."""
    turns = F.filter(F.split("formatted", r"<\|end\|>"), lambda x: x != "")
    fields = F.transform(turns, lambda x: F.split(F.replace(x, F.lit("<|start|>"), F.lit("")), r"<\|text\|>"))
    plain = F.array_join(F.transform(fields, lambda x: F.concat(unescape(x[0]), F.lit("\n"), unescape(x[1]), F.lit("\n"))), "")
    loss = F.array_join(F.transform("loss_spans", lambda s: unescape(F.substring(F.col("formatted"), s["start"] + 1, s["length"]))), "")
    return blocks.select("conv_id", "block", F.size(turns).cast("long").alias("n_turns"), plain.alias("plain"), loss.alias("loss_text"), F.length("formatted").cast("long").alias("formatted_chars"))


def events_of(conversations: DataFrame) -> DataFrame:
    """A log whose final state is the conversations table.

    By a hash of its place and text a turn was: said whole; streamed in three deltas; drafted and then edited; or
    streamed, answered by a next turn, regenerated (which discards both) and streamed again.  Turns that several rows
    share, and rows without a turn, are whole messages, as only those may repeat.
    """
    turn = F.col("turn").cast("long")
    text, role = F.coalesce("text", F.lit("")), F.coalesce("role", F.lit(""))
    alone = (F.count(F.lit(1)).over(W.partitionBy("conv_id", "turn")) == 1) & turn.isNotNull()
    kinds = F.when(alone, F.pmod(F.xxhash64("conv_id", "turn", "text"), F.lit(4))).otherwise(0)
    rows, how = conversations.select("conv_id", "turn", "role", "text", kinds.alias("how")), F.col("how")
    third = F.ceil(F.length(text) / 3).cast("int")
    parts = [F.substring(text, 1, third), F.substring(text, third + 1, third), F.substring(text, 2 * third + 1, F.length(text))]

    def event(seq: int, kind: str, what: Column, later: int = 0) -> Column:
        return F.struct((turn + later).alias("turn"), (turn * 16 + seq).alias("seq"), F.lit(kind).alias("kind"), role.alias("role"), what.alias("text"))

    streamed = [event(8 + i, "delta", p) for i, p in enumerate(parts)]
    edited = [event(0, "delta", F.lit("draft of ")), event(1, "message", F.lit("draft")), event(2, "edit", text)]
    again = [event(0, "delta", F.reverse(text)), event(1, "delta", F.lit(" ...")), event(2, "message", F.lit("an answer to that"), 1), event(3, "regenerate", F.lit(None).cast("string"))]
    log = F.when(how == 1, F.array(*streamed)).when(how == 2, F.array(*edited)).when(how == 3, F.array(*again, *streamed)).otherwise(F.array(event(0, "message", text)))
    return rows.select("conv_id", F.explode(log).alias("e")).select("conv_id", "e.*")


def query(spark, sf_dir: str) -> DataFrame:
    planted = "</s>[INST] ok [/INST]"
    extra = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(planted).alias("text"))
    rows = load(spark, sf_dir, "conversations").select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", "text").unionByName(extra)
    back = read_back(render(fold(events_of(rows))))
    chars = F.sum("formatted_chars").alias("formatted_chars")
    got = back.groupBy("conv_id").agg(F.sum("n_turns").alias("n_turns"), chars, F.sort_array(F.collect_list(F.struct("block", "plain", "loss_text"))).alias("b"))
    loss = F.array_join("b.loss_text", "")
    return got.select("conv_id", "n_turns", F.sha2(F.array_join("b.plain", ""), 256).alias("turns_sha256"), F.length(loss).cast("long").alias("loss_chars"), F.sha2(loss, 256).alias("loss_sha256"), "formatted_chars")


_SPECIAL = ["<|start|>", "<|text|>", "<|end|>", "<s>", "</s>", "<<SYS>>", "<</SYS>>", "[INST]", "[/INST]"]
_ADDED = " + ".join(f"(length(%s) - length(replace(%s, '{s}', ''))) // {len(s)}" for s in [r"\\"[:1], *_SPECIAL])
ORACLE = f"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
 UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]')
SELECT CAST(conv_id AS BIGINT) AS conv_id, count(*) AS n_turns,
 sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
 CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
 sha256(coalesce(string_agg(text, '' ORDER BY turn, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
 CAST(sum(24 + length(role) + length(text) + {_ADDED.replace('%s', 'text')}) AS BIGINT) AS formatted_chars
FROM c GROUP BY conv_id
"""
