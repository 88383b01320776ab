"""Chat formatting by quotation linking, in DataFrame functions alone.

A line's quote level is the number of '>' in its leading run of '>', spaces and tabs. A message's
own text is its lines of level 0. A quoted passage is a run of consecutive non-blank lines of one
level above 0, so a quote of several paragraphs is as many passages. An original passage is a run
of consecutive non-blank lines of level 0, each line of one, or a message's whole own text: a
quote may thus be of all paragraphs, some of them, or one line. Passages are normalised (A-Z
lower-cased, white space to single spaces, none at the ends) and hashed; empty ones don't count.

A quoted passage links to the latest earlier turn of its conversation that has an original
passage with its hash, or else to the least (conv_id, turn) of any other conversation that has
one. A message replies to what the linked passage of its lowest level links to within the
conversation (of several, the first), else to nothing. Messages that reply to nothing begin
threads. Reply order within a conversation is (thread, depth, reply_to, turn, text): every message
comes after the one it replies to. position tells how many messages of the conversation come
before; equal messages share it. It is a prefix sum over ranges of all messages in order, so a
conversation that holds a third of all rows isn't one task. `conversations` builds the
conversations themselves, without quotes, in parts of PART messages.

Within a conversation the latest earlier original is found as a running value in stretches of
turns (STRETCH), carried over stretches by one row each, so a passage that a whole conversation
repeats isn't one task. Across conversations the originals are pre-aggregated to one row a hash,
and quotes are salted.

Nulls: a null text is an empty one; a null conv_id is one conversation; a null turn comes before
turn 0 and never links within its conversation. Repeated rows stay, each for itself.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from parchmint.llm.common import LOWER, UPPER, keeping, saved, scratch, summed_before

STRETCH, SALTS = 4096, 16
ROUNDS = 64
#: The most messages in one row of an assembled conversation.
PART = 1000


def parsed(messages: DataFrame) -> DataFrame:
    """messages with own_text and _runs: [(place, level, body)], level -1 for blank lines."""
    steps = [
        ("_lines", F.expr(r"transform(split(coalesce(text, ''), '\n', -1), x -> struct(x as raw, regexp_extract(x, '^[ \\t>]*', 0) as lead))")),
        ("_lines", F.expr(r"transform(_lines, x -> struct(x.raw as raw, length(x.lead) - length(replace(x.lead, '>', '')) as level, if(contains(x.lead, '>'), regexp_replace(x.raw, '^[ \\t>]*>', ''), x.raw) as body))")),
        ("_lines", F.expr(r"transform(_lines, x -> struct(x.raw as raw, x.level as level, x.body as body, if(x.body rlike '^[ \\t\\r\\f\\x0B]*$', -1, x.level) as kind))")),
        ("_begin", F.expr("filter(transform(_lines, (x, i) -> if(i = 0 or x.kind <> get(_lines, i - 1).kind, i, -1)), i -> i >= 0)")),
        ("_runs", F.expr("transform(_begin, (b, j) -> struct(j as place, get(_lines, b).kind as level, array_join(transform(slice(_lines, b + 1, coalesce(get(_begin, j + 1), size(_lines)) - b), x -> x.body), ' ') as body))")),
        ("own_text", F.expr(r"regexp_replace(regexp_replace(array_join(transform(filter(_lines, x -> x.level = 0), x -> x.raw), '\n'), '^[ \\t\\r\\f\\x0B\\n]+', ''), '[ \\t\\r\\f\\x0B\\n]+$', '')")),
    ]
    for name, value in steps:
        messages = messages.withColumn(name, value)
    return messages.drop("_lines", "_begin")


def normalised(column: str) -> Column:
    one = F.regexp_replace(F.col(column), r"[\x20\x09-\x0D]+", " ")
    return F.trim(F.translate(one, UPPER, LOWER))


def passages(messages: DataFrame) -> DataFrame:
    """(m, conv_id, turn, place, level, h1, h2): originals have level 0."""
    runs = messages.select("m", "conv_id", "turn", F.explode("_runs").alias("r")).select("m", "conv_id", "turn", "r.place", "r.level", "r.body").where("level >= 0")
    whole = messages.select("m", "conv_id", "turn", F.lit(-1).alias("place"), F.lit(0).alias("level"), F.col("own_text").alias("body"))
    lines = messages.select("m", "conv_id", "turn", F.lit(-2).alias("place"), F.lit(0).alias("level"), F.explode(F.split("own_text", "\n")).alias("body"))
    every = runs.unionByName(whole).unionByName(lines).withColumn("body", normalised("body")).where("body <> ''")
    return every.select("m", "conv_id", "turn", "place", "level", F.xxhash64("body").alias("h1"), F.xxhash64(F.lit(1), "body").alias("h2"))


def linked(found: DataFrame) -> DataFrame:
    """Quoted passages with to_conv, to_turn and near (whether the original is of the same conversation)."""
    key = ("conv_id", "h1", "h2")
    at = found.withColumn("stretch", F.floor(F.col("turn") / STRETCH))
    original = F.when(F.col("level") == 0, F.col("turn"))
    earlier = Window.partitionBy(*key, "stretch").orderBy("turn").rangeBetween(Window.unboundedPreceding, -1)
    over = Window.partitionBy(*key).orderBy("stretch").rowsBetween(Window.unboundedPreceding, -1)
    # Only keys that are quoted somewhere in their conversation need the search.
    carried = at.groupBy(*key, "stretch").agg(F.max(original).alias("here"), F.max("level").alias("top")).withColumn("before", F.max("here").over(over)).withColumn("quoted", F.max("top").over(Window.partitionBy(*key)) > 0)
    carried = carried.where("quoted").select(*key, "stretch", "before")
    same = at.withColumn("inside", F.max(original).over(earlier)).where("level > 0")
    same = same.alias("s").join(carried.alias("c"), F.expr("s.conv_id <=> c.conv_id and s.h1 = c.h1 and s.h2 = c.h2 and s.stretch <=> c.stretch"), "left").select("s.*", F.coalesce("s.inside", "c.before").alias("to_turn"))
    near = same.where("to_turn is not null").withColumn("to_conv", F.col("conv_id")).withColumn("near", F.lit(True))
    open_ = same.where("to_turn is null").drop("to_turn").withColumn("salt", F.pmod(F.xxhash64("m", "place"), F.lit(SALTS)))
    asked = open_.select("h1", "h2").distinct()
    # The two least conversations of each hash: a quote's own one doesn't count.
    by_conv = found.where("level = 0 and conv_id is not null and turn is not null").join(asked, ["h1", "h2"], "left_semi").groupBy("h1", "h2", "conv_id").agg(F.min("turn").alias("turn"))
    first = by_conv.groupBy("h1", "h2").agg(F.min(F.struct("conv_id", "turn")).alias("first"))
    second = by_conv.join(first, ["h1", "h2"]).where("conv_id <> first.conv_id").groupBy("h1", "h2").agg(F.min(F.struct("conv_id", "turn")).alias("second"))
    named = first.join(second, ["h1", "h2"], "left").withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    far = open_.join(named, ["h1", "h2", "salt"], "left").withColumn("to", F.when(F.col("first.conv_id").eqNullSafe(F.col("conv_id")), F.col("second")).otherwise(F.col("first")))
    columns = ("m", "conv_id", "turn", "place", "level", "to_conv", "to_turn", "near")
    far = far.withColumn("to_conv", F.col("to.conv_id")).withColumn("to_turn", F.col("to.turn")).withColumn("near", F.lit(False))
    return near.select(*columns).unionByName(far.select(*columns))


def threads(replies: DataFrame, path: str) -> DataFrame:
    """(conv_id, turn, thread, depth) of every turn that replies; replies: (conv_id, turn, reply_to), turns once.

    Pointers are doubled: each round takes the pointer's pointer, until all end at a turn that
    replies to nothing. Turns fall along replies, so this ends.
    """
    at = saved(replies.select("conv_id", "turn", F.col("reply_to").alias("up"), F.lit(1).cast("long").alias("depth")), f"{path}/0")
    for k in range(1, ROUNDS + 1):
        jump = at.select(F.col("conv_id").alias("_c"), F.col("turn").alias("_t"), F.col("up").alias("_up"), F.col("depth").alias("_depth"))
        new = at.join(jump, at["conv_id"].eqNullSafe(F.col("_c")) & (at["up"] == F.col("_t")), "left")
        at = saved(new.select("conv_id", "turn", F.coalesce("_up", "up").alias("up"), (F.col("depth") + F.coalesce("_depth", F.lit(0))).alias("depth"), F.col("_up").isNotNull().alias("moved")), f"{path}/{k}")
        if at.where("moved").isEmpty():
            return at.select("conv_id", "turn", F.col("up").alias("thread"), "depth")
    raise RuntimeError("replies did not settle")


RESULTS = ("own_text", "n_quotes", "n_linked", "reply_to", "thread", "depth", "position", "far_conv", "far_turn")


@keeping("conv_id", "turn", "text", results=RESULTS)
def formatted(conversations: DataFrame) -> DataFrame:
    """conversations (conv_id, turn, text and any others), one row for each message.

    Adds own_text (without quotes), n_quotes, n_linked, reply_to, thread, depth, position, and the
    outside original of the first passage that links elsewhere: far_conv, far_turn.
    """
    path = scratch(conversations.sparkSession, "quotes")
    kept = [c for c in conversations.columns if c not in RESULTS]
    named = conversations.select(*[conversations[c] for c in kept]).withColumn("conv_id", F.col("conv_id").cast("long")).withColumn("turn", F.col("turn").cast("long")).withColumn("text", F.col("text").cast("string"))
    # Equal rows may share a number: they parse and link alike.
    messages = saved(parsed(named.withColumn("m", F.xxhash64("conv_id", "turn", "text", F.lit(1)))), f"{path}/messages")
    found = saved(passages(messages).distinct(), f"{path}/passages")
    links = saved(linked(found), f"{path}/links")
    first = lambda x: F.min(F.when(x, F.struct("level", "place", "to_conv", "to_turn")))
    of = links.groupBy("m").agg(F.count("*").alias("n_quotes"), F.count("to_turn").alias("n_linked"), first(F.col("near"))["to_turn"].alias("reply_to"), first(~F.col("near") & F.col("to_turn").isNotNull()).alias("far"))
    rows = messages.drop("_runs").join(of, "m", "left")
    replies = rows.where("reply_to is not null").groupBy("conv_id", "turn").agg(F.min("reply_to").alias("reply_to"))
    ends = threads(replies, f"{path}/threads").withColumnRenamed("conv_id", "_c").withColumnRenamed("turn", "_t")
    out = rows.join(ends, rows["conv_id"].eqNullSafe(F.col("_c")) & (rows["turn"] == F.col("_t")), "left")
    out = saved(out.drop("_c", "_t").withColumns({"thread": F.coalesce("thread", "turn"), "depth": F.coalesce("depth", F.lit(0)).cast("long")}), f"{path}/threaded")
    at = positions(out, path)
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c)
    return out.join(at, "m").select(*kept, "own_text", zero("n_quotes"), zero("n_linked"), "reply_to", "thread", "depth", "position", F.col("far.to_conv").alias("far_conv"), F.col("far.to_turn").alias("far_turn"))


def positions(rows: DataFrame, path: str) -> DataFrame:
    """(m, position) of each message of rows (m, conv_id, turn, text, thread, depth, reply_to)."""
    order = ["conv_id", "thread", "depth", "reply_to", "turn", "text_hash", "m"]
    keys = rows.groupBy("m").agg(*[F.first(c).alias(c) for c in order[:5]], F.first(F.sha2("text", 256)).alias("text_hash"), F.count("*").alias("k"))
    ahead = saved(summed_before(keys, [F.col(c).asc_nulls_first() for c in order], {"ahead": F.col("k")}, f"{path}/ordered"), f"{path}/ahead")
    begins = ahead.groupBy("conv_id").agg(F.min("ahead").alias("begin")).withColumnRenamed("conv_id", "_c")
    return ahead.join(begins, ahead["conv_id"].eqNullSafe(begins["_c"])).select("m", (F.col("ahead") - F.col("begin")).alias("position"))


def conversations(found: DataFrame) -> DataFrame:
    """(conv_id, part, messages) of what `formatted` gives: turns, depths and own texts in reply order, PART messages in a row at most.

    Messages that share a position come in no particular order; a part of more than PART equal
    messages is as long as they are many.
    """
    message = F.struct("position", "turn", "depth", "reply_to", "own_text")
    return found.groupBy("conv_id", F.floor(F.col("position") / PART).alias("part")).agg(F.array_sort(F.collect_list(message)).alias("messages"))
