"""Chat formatting by quotation linking.

Every line has a quote level, the number of leading ``>``. Lines of one level
without a blank between them form a passage; passages are normalised (lower
case, one space for anything but letters and digits) and hashed. A quoted
passage is joined to the message of its conversation that said it first, at
level 0; the message answers the latest such message of its lowest quote
level, or the turn before it if nothing links. Quotes and attribution lines
are then left out, and a conversation's messages follow each other in reply
order: by turn, where an answer always comes after what it answers.

The joins are keyed by (conversation, passage) and (conversation, turn), with
the first holder of a passage found by a partial aggregation, so a very long
conversation or a very common passage is spread over tasks and makes no pairs.

Cases: null text counts as empty; a message without text of its own keeps its
row with an empty body. Null conversation or turn: the row stays, linked to
nothing. Rows that repeat (conversation, turn) are formatted each and share
links; such a message follows the latest turn that one of them answers. An
empty table gives an empty result; extra columns are not read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, written

_PREFIX = r"^(?:[ \t]?>)+"
#: Lines that announce a quote, in the languages served.
_ATTRIBUTION = r"^(?:On .{1,200} wrote|Am .{1,200} schrieb .{1,100}|Le .{1,200} a écrit ?|El .{1,200} escribió)\s*:\s*$"


def parse(messages: DataFrame) -> DataFrame:
    """(uid, conv_id, turn, role, body, passages): passages is an array of (level, key) of the message's whole text."""
    text = F.replace(F.coalesce("text", F.lit("")), F.lit("\r\n"), F.lit("\n"))
    lines = messages.select(F.monotonically_increasing_id().alias("uid"), "conv_id", "turn", "role", F.split(text, "\n").alias("raw"))
    level = lambda x: F.length(F.regexp_replace(F.regexp_extract(x, f"({_PREFIX})", 1), "[^>]", ""))
    line = lambda x: F.struct(level(x).alias("level"), F.trim(F.regexp_replace(x, _PREFIX, "")).alias("body"))
    read = lines.select("uid", "conv_id", "turn", "role", F.transform("raw", line).alias("r"))
    after = lambda i, k: F.get("r", i + k)
    quotes = lambda i: F.coalesce((after(i, 1)["level"] > 0) | ((after(i, 1)["body"] == "") & (after(i, 2)["level"] > 0)), F.lit(False))
    parsed = read.select("uid", "conv_id", "turn", "role", F.filter("r", lambda s, i: ~((s["level"] == 0) & s["body"].rlike(_ATTRIBUTION) & quotes(i))).alias("l"))
    # A passage starts where the level changes or after a blank line.
    heads = F.expr("filter(transform(l, (s, i) -> if(i = 0 or get(l, i - 1).level <> s.level or get(l, i - 1).body = '', i, null)), i -> i is not null)")
    own = F.concat_ws("\n", F.transform(F.filter("l", lambda s: s["level"] == 0), lambda s: s["body"]))
    body = F.regexp_replace(F.regexp_replace(own, "\n{3,}", "\n\n"), "^[ \t\n]+|[ \t\n]+$", "")
    headed = parsed.select("uid", "conv_id", "turn", "role", body.alias("body"), "l", heads.alias("heads"))
    passage = "array_join(transform(slice(l, h + 1, coalesce(get(heads, k + 1), size(l)) - h), s -> s.body), ' ')"
    passages = F.expr(f"transform(heads, (h, k) -> struct(l[h].level as level, {passage} as p))")
    norm = lambda p: F.trim(F.regexp_replace(F.lower(p), r"[^\p{L}\p{N}]+", " "))
    normed = F.filter(F.transform(passages, lambda s: F.struct(s["level"].alias("level"), norm(s["p"]).alias("norm"))), lambda s: s["norm"] != "")
    keys = F.transform(normed, lambda s: F.struct(s["level"].alias("level"), F.sha2(s["norm"], 256).alias("key")))
    return headed.select("uid", "conv_id", "turn", "role", "body", keys.alias("passages"))


def link(messages: DataFrame) -> DataFrame:
    """(conv_id, turn, role, reply_to, n_quotes, n_linked, body): one row for each message."""
    held = written(parse(messages))
    said = held.select("conv_id", "turn", F.inline(F.array_distinct("passages")))
    first = said.where("level = 0").groupBy("conv_id", "key").agg(F.min("turn").alias("said_turn"))
    quoted = held.select("uid", "conv_id", "turn", F.inline("passages")).where("level > 0")
    met = quoted.join(first, ["conv_id", "key"], "left")
    good = F.col("said_turn") < F.col("turn")
    near = F.max(F.when(good, F.struct((-F.col("level")).alias("near"), "said_turn")))["said_turn"]
    per = met.groupBy("uid").agg(F.count("*").alias("n_quotes"), F.count_if(good).alias("n_linked"), near.alias("linked"))
    turns = held.select("conv_id", (F.col("turn") + 1).alias("turn")).distinct()
    before = held.select("uid", "conv_id", "turn").join(turns, ["conv_id", "turn"], "left_semi").select("uid", F.lit(True).alias("has_before"))
    # The bodies are joined once, by row; with both sides cut off AQE may broadcast what is small.
    about = cut(per.join(before, "uid", "full_outer"))
    out = held.drop("passages").join(about, "uid", "left")
    reply = F.coalesce("linked", F.when(F.col("has_before"), F.col("turn") - 1))
    return out.select("conv_id", "turn", "role", reply.alias("reply_to"), F.coalesce("n_quotes", F.lit(0)).cast("long").alias("n_quotes"), F.coalesce("n_linked", F.lit(0)).cast("long").alias("n_linked"), "body")


def threads(linked: DataFrame) -> DataFrame:
    """(conv_id, turn, thread, depth): one row for each turn, its thread's first turn and the answers between."""
    up = F.max("reply_to")
    now = linked.where("conv_id is not null and turn is not null").groupBy("conv_id", "turn").agg(up.alias("up"))
    # A row ends with its thread; before that it has come ``depth`` answers back, to the turn ``up``.
    now = cut(now.select("conv_id", "turn", "up", F.when(F.col("up").isNull(), F.col("turn")).alias("thread"), F.when(F.col("up").isNull(), 0).otherwise(1).cast("long").alias("depth")))
    ended = now.where("thread is not null")
    open_ = now.where("thread is null")
    while not open_.isEmpty():
        at = now.select("conv_id", F.col("turn").alias("up"), F.col("up").alias("up2"), F.col("thread").alias("thread2"), F.col("depth").alias("depth2"))
        moved = cut(open_.join(at, ["conv_id", "up"]).select("conv_id", "turn", F.col("up2").alias("up"), F.col("thread2").alias("thread"), (F.col("depth") + F.col("depth2")).alias("depth")))
        ended = cut(ended.unionByName(moved.where("thread is not null")))
        open_ = moved.where("thread is null")
        now = ended.unionByName(open_)
    return ended.select("conv_id", "turn", "thread", "depth")


def order(linked: DataFrame) -> DataFrame:
    """The linked messages with thread and depth."""
    held = written(linked)
    t = threads(held)
    out = held.join(t, ["conv_id", "turn"], "left")
    return out.select(*linked.columns, F.coalesce("thread", "turn").alias("thread"), F.coalesce("depth", F.lit(0)).cast("long").alias("depth"))


def conversations(messages: DataFrame) -> DataFrame:
    """One line of chat markup for each message, without its quotes, in reply order: range partitions sorted by (conversation, thread, turn)."""
    line = F.concat(F.lit("<|"), F.coalesce("role", F.lit("unknown")), F.lit("|>\n"), "body", F.lit("\n"))
    return order(link(messages)).withColumn("line", line).repartitionByRange("conv_id", "thread", "turn").sortWithinPartitions("conv_id", "thread", "turn")


def _digested(messages: DataFrame) -> DataFrame:
    rows = order(link(messages))
    body = [F.length("body").cast("long").alias("body_chars"), F.md5(F.col("body").cast("binary")).alias("body_md5")]
    return rows.select("conv_id", "turn", "role", "reply_to", "thread", "depth", "n_quotes", "n_linked", *body)


def quoting(messages: DataFrame) -> DataFrame:
    """The messages as mail: an answer quotes the turn before it, and every third user turn the one three before, with an announcing line."""
    said = lambda k: messages.select(F.col("conv_id").alias(f"c{k}"), (F.col("turn") + k).alias(f"t{k}"), F.concat(F.lit("> "), F.replace(F.col("text"), F.lit("\n"), F.lit("\n> "))).alias(f"q{k}"))
    met = messages
    for k, wanted in ((1, F.col("role") == "assistant"), (3, (F.col("role") == "user") & (F.col("turn") % 3 == 0))):
        s = said(k)
        met = met.join(s, (F.col("conv_id") == s[f"c{k}"]) & (F.col("turn") == s[f"t{k}"]) & wanted, "left")
    announced = F.concat(F.lit("On Monday someone wrote:\n"), "q1", F.lit("\n\n"))
    return met.select("conv_id", "turn", "role", F.concat(F.coalesce(announced, F.lit("")), F.coalesce(F.concat("q3", F.lit("\n\n")), F.lit("")), F.coalesce("text", F.lit(""))).alias("text"))


def op9_chat_quotes(spark, sf_dir):
    """conv_id, turn, role, reply_to, thread, depth, n_quotes, n_linked, body_chars, body_md5: one row for each message; by (conv_id, thread, turn) they are in reply order."""
    return _digested(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


def chat_quotes_linked(spark, sf_dir):
    """The same of the conversations as mail, whose quotes are there to be linked."""
    return _digested(quoting(spark.read.parquet(f"{sf_dir}/conversations.parquet")))
