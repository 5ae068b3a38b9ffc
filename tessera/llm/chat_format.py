"""Chat formatting by perspective rotation. DataFrame operations only.

Every participant of a conversation sees it once as the assistant: that speaker's turns are the assistant's and
the only ones to be learnt, the others are users under their own names, system turns stay what they are. A
message is <|im_start|>role, the name of a user, a line break, the text, <|im_end|> and a line break; a mask
span covers the text and the end mark of an assistant's message, in code points of the rendered dialogue.

A dialogue is one text, however long, and is kept as consecutive pieces of it, so that none needs to fit in one
task: a piece holds the messages of PIECE turn numbers, is named by its turn number divided by PIECE, and says
how many code points lie before it. Mask spans count from the dialogue's start, so the pieces of a speaker in
their order are the whole rendering with the whole mask; whole() puts them together. The text is shuffled once;
who takes part and what lies before is worked out beside it, without text, in windows over at most BLOCK pieces.

Cases: rows that are equal in conv_id, turn, role and text are one message. Turns with the same number are
ordered by role, then text. A null role is the speaker "unknown", a null text is empty. A message with a null
conv_id belongs to no known conversation and one with a null turn has no place in it: each is a dialogue of its
own, its piece null. A conversation of system turns only has no participant and gives no row. Extra columns are
ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Turn numbers in a piece; pieces in a window.
PIECE, BLOCK = 64, 1024
SYSTEM, UNKNOWN = "system", "unknown"
OWN, OTHER, END = "<|im_start|>assistant\n", "<|im_start|>user name=", "<|im_end|>\n"
_SYSTEM = "<|im_start|>system\n"


def _head(role: Column) -> Column:
    """The start of a message as others see it."""
    return F.when(role == SYSTEM, F.lit(_SYSTEM)).otherwise(F.concat(F.lit(OTHER), role, F.lit("\n")))


def _message(turn: Column, speaker: Column) -> Column:
    own = turn["role"] == speaker
    head = F.when(own, F.lit(OWN)).otherwise(_head(turn["role"]))
    return F.struct(own.alias("own"), F.length(head).alias("skip"), F.concat(head, turn["text"], F.lit(END)).alias("text"))


def _spans(messages: Column, start: Column) -> Column:
    """The spans of the own messages: their texts with the end mark."""
    first = F.struct(start.alias("at"), F.array().cast("array<struct<start:bigint,end:bigint>>").alias("spans"))

    def add(state: Column, m: Column) -> Column:
        end = state["at"] + F.length(m["text"])
        span = F.struct((state["at"] + m["skip"]).alias("start"), (end - 1).alias("end"))
        return F.struct(end.alias("at"), F.when(m["own"], F.concat(state["spans"], F.array(span))).otherwise(state["spans"]).alias("spans"))

    return F.aggregate(messages, first, add, lambda s: s["spans"])


def _seats(rows: DataFrame) -> DataFrame:
    """(c, p, seats): of each piece, the conversation's speakers with the code points before it as each sees them."""
    said = rows.select("conv_id", "piece", "turn", "role", F.xxhash64("text").alias("h"), F.length("text").alias("n")).distinct()
    said = said.groupBy("conv_id", "piece", "role").agg(F.count(F.lit(1)).alias("k"), F.sum("n").alias("n"))
    said = said.withColumn("n", F.col("n") + F.col("k") * (F.length(_head(F.col("role"))) + len(END)))
    speakers = said.where(F.col("role") != SYSTEM).select("conv_id", F.col("role").alias("speaker")).distinct()
    pieces = said.groupBy("conv_id", "piece").agg(F.sum("n").alias("n"))
    own = said.select(F.col("conv_id").alias("c"), F.col("piece").alias("p"), F.col("role").alias("r"), "k")
    seats = pieces.join(speakers, "conv_id")
    seats = seats.join(own, (F.col("conv_id") == F.col("c")) & (F.col("piece") == F.col("p")) & (F.col("speaker") == F.col("r")), "left")
    less = len(OWN) - F.length(_head(F.col("speaker")))  # what an own message is shorter or longer by
    seats = seats.select("conv_id", "piece", "speaker", F.floor(F.col("piece") / BLOCK).alias("block"), (F.col("n") + F.coalesce("k", F.lit(0)) * less).alias("n"))
    before = lambda order, *keys: F.coalesce(F.sum("n").over(Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    blocks = seats.groupBy("conv_id", "speaker", "block").agg(F.sum("n").alias("n"))
    blocks = blocks.select("conv_id", "speaker", "block", before("block", "conv_id", "speaker").alias("skipped"))
    inner = seats.withColumn("inner", before("piece", "conv_id", "speaker", "block")).join(blocks, ["conv_id", "speaker", "block"])
    seat = F.struct("speaker", (F.col("inner") + F.col("skipped")).cast("long").alias("start"))
    return inner.groupBy(F.col("conv_id").alias("c"), F.col("piece").alias("p")).agg(F.collect_list(seat).alias("seats"))


def rotate(conversations: DataFrame) -> DataFrame:
    """conv_id, speaker, piece, n_turns, n_own, start, text and mask (spans) of every participant and piece."""
    role, text = F.coalesce("role", F.lit(UNKNOWN)), F.coalesce("text", F.lit(""))
    rows = conversations.select("conv_id", F.floor(F.col("turn") / PIECE).alias("piece"), F.col("turn").cast("long").alias("turn"), role.alias("role"), text.alias("text"))
    known = F.col("conv_id").isNotNull() & F.col("turn").isNotNull()
    placed, alone = rows.where(known), rows.where(~known).distinct().where(F.col("role") != SYSTEM)
    # by piece, so that the texts, grouped by piece, meet their speakers without another shuffle
    turns = placed.groupBy("conv_id", "piece").agg(F.array_sort(F.collect_set(F.struct("turn", "role", "text"))).alias("turns"))
    both = turns.join(_seats(placed), (F.col("conv_id") == F.col("c")) & (F.col("piece") == F.col("p")))
    each = both.select("conv_id", "piece", "turns", F.explode("seats").alias("seat")).select("conv_id", "piece", "turns", "seat.speaker", "seat.start")
    alone = alone.select("conv_id", F.lit(None).cast("long").alias("piece"), F.array(F.struct("turn", "role", "text")).alias("turns"), F.col("role").alias("speaker"), F.lit(0).cast("long").alias("start"))
    each = each.unionByName(alone).withColumn("messages", F.transform("turns", lambda t: _message(t, F.col("speaker"))))
    own = F.size(F.filter("messages", lambda m: m["own"])).cast("long")
    text = F.array_join(F.transform("messages", lambda m: m["text"]), "")
    return each.select("conv_id", "speaker", "piece", F.size("turns").cast("long").alias("n_turns"), own.alias("n_own"), "start", text.alias("text"), _spans(F.col("messages"), F.col("start")).alias("mask"))


def whole(rotated: DataFrame) -> DataFrame:
    """conv_id, speaker, n_turns, n_own, text and mask of whole dialogues: for those that fit in a row."""
    pieces = F.array_sort(F.collect_list(F.struct("piece", "text", "mask")))
    placed = rotated.where(F.col("piece").isNotNull()).groupBy("conv_id", "speaker").agg(F.sum("n_turns").alias("n_turns"), F.sum("n_own").alias("n_own"), pieces.alias("pieces"))
    text, mask = F.array_join(F.transform("pieces", lambda p: p["text"]), ""), F.flatten(F.transform("pieces", lambda p: p["mask"]))
    out = placed.select("conv_id", "speaker", "n_turns", "n_own", text.alias("text"), mask.alias("mask"))
    return out.unionByName(rotated.where(F.col("piece").isNull()).select(*out.columns))


def mask_text(mask: Column) -> Column:
    """Spans written as start-end, with commas between them."""
    return F.array_join(F.transform(mask, lambda s: F.concat_ws("-", s["start"], s["end"])), ",")


#: The same in DuckDB's SQL, for conversations; the mask as mask_text writes it.
SQL = r"""
WITH turns AS (
  SELECT DISTINCT conv_id, turn, coalesce(role, 'unknown') AS role, coalesce(text, '') AS text,
         CASE WHEN conv_id IS NULL OR turn IS NULL THEN concat_ws('|', conv_id, turn, coalesce(role, 'unknown'), coalesce(text, '')) END AS alone,
         CASE WHEN conv_id IS NOT NULL THEN CAST(floor(turn / 64.0) AS BIGINT) END AS piece
  FROM conversations
), speakers AS (
  SELECT DISTINCT conv_id, alone, role AS speaker FROM turns WHERE role <> 'system'
), heads AS (
  SELECT t.*, speaker, role = speaker AS own,
         CASE WHEN role = speaker THEN '<|im_start|>assistant' WHEN role = 'system' THEN '<|im_start|>system'
              ELSE '<|im_start|>user name=' || role END || chr(10) AS head
  FROM turns t JOIN speakers s ON t.conv_id IS NOT DISTINCT FROM s.conv_id AND t.alone IS NOT DISTINCT FROM s.alone
), messages AS (
  SELECT *, head || text || '<|im_end|>' || chr(10) AS message FROM heads
), placed AS (
  SELECT *, sum(length(message)) OVER (PARTITION BY conv_id, alone, speaker ORDER BY turn, role, text
                                       ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS stop FROM messages
)
SELECT conv_id, speaker, piece, CAST(count(*) AS BIGINT) AS n_turns,
       CAST(sum(CASE WHEN own THEN 1 ELSE 0 END) AS BIGINT) AS n_own, CAST(min(stop - length(message)) AS BIGINT) AS start,
       string_agg(message, '' ORDER BY turn, role, text) AS text,
       coalesce(string_agg(CAST(stop - length(message) + length(head) AS VARCHAR) || '-' || CAST(stop - 1 AS VARCHAR), ','
                           ORDER BY turn, role, text) FILTER (WHERE own), '') AS mask
FROM placed GROUP BY conv_id, alone, speaker, piece
"""
