"""Quotation linking: replies found by what messages quote, and conversations without quotes."""

from __future__ import annotations

import re

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from mortise.llm.common import map_rows, settled, texts_of

MARK = re.compile(r"^(?:[ \t]?>)+")
#: A line that introduces a quotation, such as "On Monday X wrote:".
INTRODUCTION = re.compile(r"^\s*\S.*(?:wrote|writes|said|schrieb|a écrit|escribió)\s*:\s*$", re.IGNORECASE)

#: Words of a quoted passage that is sought outside its own conversation.
ELSEWHERE_WORDS = 6


def level(line: str) -> tuple[int, str]:
    """Quote level of a line and what stands behind its marks."""
    m = MARK.match(line)
    return (0, line) if not m else (m.group().count(">"), line[m.end() :])


def parse(text: str) -> tuple[str, list[tuple[int, str]]]:
    """(text without quotes, passages): a passage is (level, its lines joined), cut where the level changes or a line is blank.

    Lines that introduce a quotation go with it; blank lines around the cut close up. One pass over
    the lines in each direction.
    """
    lines = [level(x) for x in text.split("\n")]
    if not any(n for n, _ in lines):
        return text, _passages(lines)
    following, after = 0, []
    for n, body in reversed(lines):
        after.append(following)
        if n or body.strip():
            following = n
    kept = [body for (n, body), later in zip(lines, reversed(after), strict=True) if n == 0 and not (later and INTRODUCTION.match(body))]
    own = re.sub(r"\n{3,}", "\n\n", "\n".join(kept)).strip("\n")
    return own, _passages([(n, "" if n == 0 and INTRODUCTION.match(x) else x) for n, x in lines])


def _passages(lines: list[tuple[int, str]]) -> list[tuple[int, str]]:
    out, held, at = [], [], 0
    for n, body in [*lines, (-1, "")]:
        if held and (n != at or not body.strip()):
            out.append((at, " ".join(held)))
            held = []
        if body.strip():
            held.append(body.strip())
        at = n
    return out


def normal(passage: str) -> str:
    """Letters and digits in lower case, with single spaces: what wrapping and punctuation don't change."""
    return " ".join(re.findall(r"\w+", passage.lower()))


def sentences(passage: str) -> list[str]:
    """Sentences of a passage, however its lines are wrapped."""
    return re.split(r"(?<=[.!?…])\s+", passage)


def units(text: str) -> tuple[str, list[tuple[int, int, int]]]:
    """(text without quotes, (level, hash, words) of each passage, each of its sentences and each line that has a word)."""
    own, passages = parse(text)
    found = dict.fromkeys((n, normal(x)) for n, p in passages for x in (p, *sentences(p)))
    found |= dict.fromkeys((n, normal(x)) for n, x in map(level, text.split("\n")))
    return own, [(n, xxhash.xxh64_intdigest(x) - (1 << 63), x.count(" ") + 1) for n, x in found if x]


def link_quotations(messages: DataFrame, elsewhere_words: int = ELSEWHERE_WORDS) -> DataFrame:
    """Per row of `messages` (conv_id, turn, role, text): the message it answers and its text without quotes.

    Rows: conv_id, turn, role, text (own words), reply_to (turn of the original message, null if it
    quotes none), thread (turn of the first message of its chain of replies), quoted (number of
    quoted passages, sentences and lines), reply_conv and thread_conv (their conversations). A
    quoted passage, a sentence out of one, or a line is linked to the latest earlier message of its
    conversation that has it as own words, else, from `elsewhere_words` words on, to the first
    message of the table that has it, if that stands in a conversation of a lesser conv_id (so
    chains end). A message answers the original of its least quote level; of several, one in its own
    conversation and the latest. Ordered by (thread_conv, thread, conv_id, turn), each thread stands
    together and answers follow what they answer. Null texts are empty; rows with a null conv_id or
    turn stay unlinked; repeated rows share their link; an empty table gives no rows. Originals
    elsewhere are one partial minimum a passage, and inside a conversation the latest one runs along
    the sorted passage table, so a common passage is never paired with itself.
    """

    def rows(batch: pa.RecordBatch) -> dict:
        made = [units(t) for t in texts_of(batch.column("text"))]
        return {k: batch.column(k) for k in ("conv_id", "turn", "role")} | {
            "text": [m[0] for m in made],
            "units": [[{"level": n, "hash": h, "words": w} for n, h, w in m[1]] for m in made],
        }

    source = messages.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("text"))
    parsed = settled(map_rows(source, "conv_id long, turn long, role string, text string, units array<struct<level:int,hash:long,words:int>>", rows))
    each = parsed.where("conv_id is not null and turn is not null").select("conv_id", "turn", F.explode("units").alias("u")).select("conv_id", "turn", "u.level", "u.hash", "u.words")
    quoted = settled(each.where("level > 0").distinct())
    own = settled(each.where("level = 0").select("conv_id", "turn", "hash").distinct().join(quoted.select("hash").distinct(), "hash", "left_semi"))
    # The latest own use before each quotation, along the turns of one passage of a conversation.
    both = own.select("conv_id", "hash", "turn", F.col("turn").alias("at"), F.lit(None).cast("int").alias("level")).union(quoted.select("conv_id", "hash", "turn", F.lit(None).cast("long"), "level"))
    before = Window.partitionBy("conv_id", "hash").orderBy("turn").rangeBetween(Window.unboundedPreceding, -1)
    near = both.withColumn("original", F.max("at").over(before)).where("level is not null and original is not null").select("conv_id", "turn", "level", F.col("conv_id").alias("oc"), "original")
    firsts = own.groupBy("hash").agg(F.min(F.struct("conv_id", "turn")).alias("first"))
    far = quoted.where(F.col("words") >= elsewhere_words).join(firsts, "hash").where("first.conv_id < conv_id").select("conv_id", "turn", "level", F.col("first.conv_id").alias("oc"), F.col("first.turn").alias("original"))
    best = F.min_by(F.struct(F.col("oc").alias("reply_conv"), F.col("original").alias("reply_to")), F.struct("level", (F.col("oc") != F.col("conv_id")).alias("away"), -F.col("original"), "oc"))
    replies = settled(near.union(far).groupBy("conv_id", "turn").agg(best.alias("best")).select("conv_id", "turn", "best.*"))
    out = parsed.join(replies, ["conv_id", "turn"], "left").join(roots(replies), ["conv_id", "turn"], "left")
    marks = F.size(F.filter("units", lambda u: u["level"] > 0))
    return out.select("conv_id", "turn", "role", "text", "reply_to", F.coalesce("thread", "turn").alias("thread"), marks.alias("quoted"), "reply_conv", F.coalesce("thread_conv", "conv_id").alias("thread_conv"))


def roots(replies: DataFrame) -> DataFrame:
    """(conv_id, turn, thread_conv, thread): the end of each chain of replies (conv_id, turn, reply_conv, reply_to), by doubling its steps."""
    now = settled(replies.select("conv_id", "turn", F.col("reply_conv").alias("thread_conv"), F.col("reply_to").alias("thread")))
    while True:
        on = now.select(F.col("conv_id").alias("thread_conv"), F.col("turn").alias("thread"), F.col("thread_conv").alias("c"), F.col("thread").alias("t"))
        joined = now.join(on, ["thread_conv", "thread"], "left")
        step = settled(joined.select("conv_id", "turn", F.coalesce("c", "thread_conv").alias("thread_conv"), F.coalesce("t", "thread").alias("thread"), F.col("t").isNotNull().alias("moved")))
        now = step.drop("moved")
        if not step.where("moved").limit(1).count():
            return now


def conversations(linked: DataFrame) -> DataFrame:
    """link_quotations() rows in reply order: sorted by thread and place over all partitions."""
    order = ["thread_conv", "thread", "conv_id", "turn"]
    return linked.repartitionByRange(*order).sortWithinPartitions(*order)
