"""Quotation linking: conversations in reply order, without quotes, by Spark's own functions.

Lines that begin with ``>`` are quoted, as deep as they have such marks. Runs of lines of one depth without
a blank one form passages; a passage is normalised (marks and case removed, white space collapsed) and hashed.
Originals are what a message says itself: each line, each paragraph, the whole, and each run of as many lines as
some passage has, so a reply that quotes a line, a paragraph, several lines of one or all of a message finds
it. Runs are found by names: a word's name is its digest, and that of 2, 4, 8 ... words the digest of both halves' names. Only
messages with a line that begins like a passage are named; a passage of m words is met at the start of a line by the name
of its first 2^k, the most that it has, and confirmed by that of its last 2^k and by a line's end. So the work grows with the words
times the logarithm of the longest passage, and no run is ever written out. Each quote joins to the latest original before it in its conversation, or else to the first one of another
conversation. Linked quotes leave the text, and with them the line that announces one ("Ann wrote:"); a passage
without an original (a prompt sign, a shell line) stays where it is, and a text without linked quotes
stays as it is. A reply belongs to the thread of the message that its first linked quote cites; threads stand
in the order of their first messages and messages in a thread by turn, which puts every reply after what it
answers.

Defined results: a null conversation or turn drops the row, as it has no place; of repeated
(conversation, turn) rows the one with the smallest role and text stays; a null or empty text
gives an empty one; quotes without an original stay and are counted as unlinked; quoted lines without words
go where a quote of the message is linked; an empty table gives an empty result; other columns are neither read
nor returned. Long conversations are not gathered: each message stays a row, and places come from a
distributed sort; lines of one message meet in one task. A passage that many messages say, and a conversation that says it
often, are split by ranges of turns.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quern.llm.common import Scratch

#: Quote marks at the start of a line; spaces may stand between them.
MARKS = r"^[ \t]*((?:>[ \t]?)+)"
#: A text with a quoted line.
QUOTING = r"(?m)^[ \t]*>"
#: Own lines that announce the quote behind them, blank lines between; no other line of such words does.
ATTRIBUTION = r"(?i)^[^\S\n]*(?:on\s.{1,200}\s(?:wrote|said|writes)|.{1,120}\s(?:wrote|writes))\s*:?\s*$"
#: Own lines that announce the next quote behind them, whatever stands between.
ORIGINAL = r"(?i)^\s*-{2,}\s*original message\s*-{2,}\s*:?\s*$"
#: Blank lines at the ends of a text that has lost quotes.
BLANK_ENDS = r"^(?:[^\S\n]*\n)+|(?:\n[^\S\n]*)+$"
#: Shorter originals, such as a lone "yes", are no evidence of a reply.
MIN_CHARS = 8
MESSAGE = ("conv_id", "turn")


def _normal(text: Column) -> Column:
    """Lower case, white space collapsed."""
    return F.trim(F.regexp_replace(F.lower(text), r"[\s\u00A0]+", " "))


def messages_of(rows: DataFrame, conversation: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """conv_id, turn, role and text, one row for each message."""
    rows = rows.select(
        F.col(conversation).cast("long").alias("conv_id"), F.col(turn).cast("long").alias("turn"),
        F.col(role).cast("string").alias("role"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"),
    ).where("conv_id is not null and turn is not null")
    one = rows.groupBy(*MESSAGE).agg(F.min_by(F.struct("role", "text"), F.struct("role", "text")).alias("m"))
    return one.select(*MESSAGE, "m.role", "m.text")


def quoted_lines(messages: DataFrame) -> DataFrame:
    """A row per line of the texts with quoted lines: pos, raw, its depth and words, and place.

    place is the number of the passage that the line belongs to or announces; null for other own lines, -1 for
    quoted lines without words. quotes is the number of passages of the message.
    """
    rows = messages.where(F.col("text").rlike(QUOTING)).select(*MESSAGE, F.posexplode(F.split("text", "\n", -1)).alias("pos", "raw"))
    rows = rows.withColumn("depth", F.length(F.regexp_replace(F.regexp_extract("raw", MARKS, 1), r"[ \t]", "")))
    rows = rows.withColumn("words", _normal(F.regexp_replace("raw", MARKS, "")))
    down = Window.partitionBy(*MESSAGE).orderBy("pos")
    up = Window.partitionBy(*MESSAGE).orderBy(F.desc("pos")).rowsBetween(Window.unboundedPreceding, -1)
    said = F.col("words") != ""
    # The quoted line that comes next, blank lines between.
    rows = rows.withColumn("next", F.last(F.when(said, F.col("depth")), ignorenulls=True).over(up))
    starts = (F.col("depth") > 0) & said & ((F.coalesce(F.lag("depth").over(down), F.lit(0)) != F.col("depth")) | (F.lag("words").over(down) == ""))
    rows = rows.withColumn("starts", F.when(starts, 1).otherwise(0))
    rows = rows.withColumn("before", F.sum("starts").over(down.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    rows = rows.withColumn("quotes", F.sum("starts").over(Window.partitionBy(*MESSAGE)))
    announces = ((F.col("next") > 0) & F.col("raw").rlike(ATTRIBUTION)) | ((F.col("before") < F.col("quotes")) & F.col("raw").rlike(ORIGINAL))
    place = F.when(F.col("depth") > 0, F.when(said, F.col("before") - 1).otherwise(-1)).when(announces, F.col("before"))
    return rows.select(*MESSAGE, "pos", "raw", "depth", "words", place.alias("place"), "quotes")


def quotes_of(lines: DataFrame) -> DataFrame:
    """conv_id, turn, place, depth, n_lines, passage and its hash (null for one too short to be evidence)."""
    quoted = lines.where("depth > 0 and place >= 0")
    found = quoted.groupBy(*MESSAGE, "place").agg(F.first("depth").alias("depth"), F.array_sort(F.collect_list(F.struct("pos", "words"))).alias("own"))  # lines of one passage
    passage = F.array_join("own.words", " ")
    return found.select(*MESSAGE, "place", "depth", F.size("own").alias("n_lines"), passage.alias("passage"), F.when(F.length(passage) >= MIN_CHARS, F.sha2(passage, 256)).alias("hash"))


def own_texts(messages: DataFrame, lines: DataFrame) -> DataFrame:
    """conv_id, turn and text: what each message says itself."""
    own = lines.where("depth = 0 and place is null").groupBy(*MESSAGE).agg(F.array_sort(F.collect_list(F.struct("pos", "raw"))).alias("own"))  # lines of one message
    own = own.select(*MESSAGE, F.array_join("own.raw", "\n").alias("text"))
    return messages.where(~F.col("text").rlike(QUOTING)).select(*MESSAGE, "text").unionByName(own)


def _spoken() -> Column:
    """The lines of the text that are not blank, normalised."""
    return F.filter(F.transform(F.split("text", "\n", -1), _normal), lambda w: w != "")


def said_by(texts: DataFrame) -> DataFrame:
    """conv_id, turn and the hash of each line, each paragraph and the whole of a text."""
    rows = texts.select(*MESSAGE, "text", _spoken().alias("spoken"))
    paragraphs = F.transform(F.split("text", r"\n\s*\n", -1), _normal)
    every = F.array_distinct(F.concat("spoken", paragraphs, F.array(F.array_join("spoken", " "))))
    return rows.select(*MESSAGE, F.explode(F.filter(every, lambda w: F.length(w) >= MIN_CHARS)).alias("passage")).select(*MESSAGE, F.sha2("passage", 256).alias("hash"))


def _named(words: DataFrame, levels: int, *keys: str) -> DataFrame:
    """words (place i in each group of keys, word, others) with ``names``: at k the digest of the 2^k words from there, null where there are fewer."""
    order = Window.partitionBy(*keys).orderBy("i")
    rows = words.withColumn("name0", F.md5("word")).drop("word")
    for k in range(levels):
        rows = rows.withColumn(f"name{k + 1}", F.md5(F.concat(f"name{k}", F.lead(f"name{k}", 1 << k).over(order))))
    names = [f"name{k}" for k in range(levels + 1)]
    return rows.withColumn("names", F.array(*names)).drop(*names)


def runs_said(scratch: Scratch, texts: DataFrame, quotes: DataFrame) -> DataFrame:
    """conv_id, turn and the hash of each passage that a text says in a run of whole lines, of as many lines as some passage has."""
    words = F.split("passage", " ")
    passages = quotes.where("hash is not null").select("hash", "passage").distinct()
    longest = passages.agg(F.coalesce(F.max(F.size(words)), F.lit(1))).first()[0]
    levels = longest.bit_length() - 1
    sized = passages.select("hash", "passage", F.size(words).alias("m")).where("m > 1").select("hash", "passage", "m", (F.length(F.bin("m")) - 1).alias("k"))
    sized = sized.withColumn("tail", F.expr("m - shiftleft(1, k)"))
    named = _named(sized.select("hash", "m", "k", "tail", F.posexplode(words).alias("i", "word")), levels, "hash")
    at = lambda place: F.min(F.when(F.col("i") == place, F.get("names", F.col("k"))))
    wanted = scratch.keep(named.where("i = 0 or i = tail").groupBy("hash", "m", "k", "tail").agg(at(F.lit(0)).alias("head"), at(F.col("tail")).alias("last")))
    # Texts with a line whose first two words begin a passage, in lines and words.
    spoken = texts.select(*MESSAGE, _spoken().alias("spoken"))
    pairs = F.transform("spoken", lambda x, j: F.md5(F.substring_index(F.concat_ws(" ", x, F.get("spoken", j + 1)), " ", 2)))
    begun = sized.select(F.md5(F.substring_index("passage", " ", 2)).alias("pair")).distinct()
    holders = spoken.select(*MESSAGE, F.explode(F.array_distinct(pairs)).alias("pair")).join(begun, "pair", "left_semi").select(*MESSAGE).distinct()
    lines = spoken.join(holders, [*MESSAGE], "left_semi").select(*MESSAGE, F.posexplode("spoken").alias("line", "said"))
    each = lines.select(*MESSAGE, "line", F.split("said", " ").alias("own")).select(*MESSAGE, "line", F.size("own").alias("size"), F.posexplode("own").alias("j", "word"))
    order = Window.partitionBy(*MESSAGE).orderBy("line", "j")
    placed = each.select(*MESSAGE, "line", (F.col("j") == 0).alias("starts"), (F.col("j") + 1 == F.col("size")).alias("ends"), "word", F.row_number().over(order).alias("i"))
    rows = scratch.keep(_named(placed, levels, *MESSAGE))
    names = rows.select(*MESSAGE, "i", "line", "starts", F.posexplode("names").alias("k", "name")).where("name is not null")
    met = names.where("starts").join(wanted.withColumnRenamed("head", "name"), ["k", "name"])
    met = met.select(*MESSAGE, "line", "hash", (F.col("i") + F.col("m") - 1).alias("end"), (F.col("i") + F.col("tail")).alias("i"), "k", F.col("last").alias("name"))
    same = met.join(names.select(*MESSAGE, "i", "k", "name"), [*MESSAGE, "i", "k", "name"], "left_semi").select(*MESSAGE, "line", "hash", F.col("end").alias("i"))
    whole = same.join(rows.where("ends").select(*MESSAGE, "i", F.col("line").alias("until")), [*MESSAGE, "i"])
    counted = whole.select(*MESSAGE, "hash", (F.col("until") - F.col("line") + 1).alias("n_lines"))
    return counted.join(quotes.where("n_lines > 1").select("n_lines").distinct(), "n_lines", "left_semi").select(*MESSAGE, "hash")


def _latest_before(scratch: Scratch, asks: DataFrame, tells: DataFrame) -> DataFrame:
    """asks with ``source``, the largest turn of tells (hash, conv_id, turn) before the own one.

    One sort over ranges, so that a hash of a conversation may span parts: a running maximum in each part, and the maximum of the
    parts before. No pair of rows is made.
    """
    asks = asks.select("hash", "conv_id", "turn", F.lit(1).alias("asks"), "place", "depth", F.lit(None).cast("long").alias("told"))
    tells = tells.select("hash", "conv_id", "turn", F.lit(0).alias("asks"), F.lit(-1).alias("place"), F.lit(0).alias("depth"), F.col("turn").alias("told"))
    order = F.col("hash"), F.col("conv_id"), F.col("turn"), F.desc("asks"), F.col("place")
    placed = scratch.keep(asks.unionByName(tells).repartitionByRange(*order).withColumn("part", F.spark_partition_id()))
    inside = Window.partitionBy("part", "hash", "conv_id").orderBy(*order[2:]).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    # A row per part, hash and conversation.
    parts = placed.groupBy("hash", "conv_id", "part").agg(F.max("told").alias("most"))
    earlier = Window.partitionBy("hash", "conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    carried = parts.select("hash", "conv_id", "part", F.max("most").over(earlier).alias("carried"))
    running = placed.withColumn("own", F.max("told").over(inside)).where("asks = 1")
    joined = running.join(carried, ["part", "hash", "conv_id"])
    return joined.select("hash", "conv_id", "turn", "place", "depth", F.coalesce("own", "carried").alias("source"))


def link_quotes(scratch: Scratch, quotes: DataFrame, said: DataFrame) -> DataFrame:
    """conv_id, turn, place, depth, and the conversation and turn that the quote cites (null if none does)."""
    able = quotes.where("hash is not null").select("hash").distinct()
    said = scratch.keep(said.join(able, "hash", "left_semi").select("hash", *MESSAGE).distinct())
    near = _latest_before(scratch, quotes.where("hash is not null"), said)
    # The first original and the first one of another conversation: one of the two is not the quoting conversation's own.
    by_talk = said.groupBy("hash", "conv_id").agg(F.min("turn").alias("turn"))
    order = Window.partitionBy("hash").orderBy("conv_id")
    two = by_talk.withColumn("k", F.row_number().over(order)).where("k <= 2")
    source = F.struct("conv_id", "turn")
    firsts = two.groupBy("hash").agg(F.min(F.when(F.col("k") == 1, source)).alias("first"), F.min(F.when(F.col("k") == 2, source)).alias("second"))
    found = near.join(firsts, "hash", "left")
    inside = F.col("source").isNotNull()
    elsewhere = F.when(F.col("first.conv_id") != F.col("conv_id"), F.col("first")).otherwise(F.col("second"))
    linked = found.select(
        "conv_id", "turn", "place", "depth",
        F.when(inside, F.col("conv_id")).otherwise(elsewhere["conv_id"]).alias("cites_conv"),
        F.when(inside, F.col("source")).otherwise(elsewhere["turn"]).alias("cites_turn"),
    )
    none = F.lit(None).cast("long")
    return linked.unionByName(quotes.where("hash is null").select("conv_id", "turn", "place", "depth", none.alias("cites_conv"), none.alias("cites_turn")))


def _threads(parents: DataFrame, scratch: Scratch) -> DataFrame:
    """conv_id, turn, root: pointers doubled until all reach a message without a parent (logarithmic in the longest chain)."""
    now = scratch.keep(parents.select("conv_id", "turn", F.col("parent").alias("root")))
    while True:
        up = now.select("conv_id", F.col("turn").alias("root"), F.col("root").alias("next"))
        after = now.join(up, ["conv_id", "root"], "left")
        step = scratch.keep(after.select("conv_id", "turn", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")))
        scratch.drop(now)
        now = step.drop("moved")
        now._quern_path = step._quern_path
        if step.where("moved").isEmpty():
            return now


def format_chats(rows: DataFrame, conversation: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """One row per message: its thread, its place in reply order, the message it answers, and its text without linked quotes."""
    spark: SparkSession = rows.sparkSession
    scratch = Scratch(spark, "chat")
    messages = scratch.keep(messages_of(rows, conversation, turn, role, text))
    lines = scratch.keep(quoted_lines(messages))
    quotes = scratch.keep(quotes_of(lines))
    texts = own_texts(messages, lines)  # read from kept tables each time rather than kept once more
    links = scratch.keep(link_quotes(scratch, quotes, said_by(texts).unionByName(runs_said(scratch, texts, quotes))))
    cited = F.when(F.col("cites_turn").isNotNull(), F.struct("depth", "place", "cites_conv", "cites_turn"))
    inner = F.when(F.col("cites_conv") == F.col("conv_id"), F.struct("depth", "place", "cites_turn"))
    replies = links.groupBy(*MESSAGE).agg(
        F.count("*").alias("n_quotes"), F.count("cites_turn").alias("n_linked"), F.min(cited).alias("cites"), F.min(inner)["cites_turn"].alias("parent")
    )
    # Texts that lose quotes: without the lines of linked passages, those that announce them, and quoted lines without words.
    gone = links.where("cites_turn is not null").select(*MESSAGE, "place").withColumn("linked", F.lit(True))
    cut = lines.join(gone.select(*MESSAGE).distinct(), [*MESSAGE], "left_semi").join(gone, [*MESSAGE, "place"], "left")
    cut = cut.groupBy(*MESSAGE).agg(F.array_sort(F.collect_list(F.when(F.col("linked").isNull() & (F.coalesce("place", F.lit(0)) >= 0), F.struct("pos", "raw")))).alias("left"))  # lines of one message
    bodies = cut.select(*MESSAGE, F.regexp_replace(F.array_join("left.raw", "\n"), BLANK_ENDS, "").alias("body"))
    replies = scratch.keep(replies.join(bodies, [*MESSAGE], "left"))
    roots = _threads(replies.where("parent is not null"), scratch)
    joined = messages.join(replies, [*MESSAGE], "left").join(roots, [*MESSAGE], "left").select(
        *MESSAGE, F.coalesce("root", "turn").alias("thread"), "role", F.coalesce("body", "text").alias("text"),
        F.col("parent").alias("reply_to"), F.col("cites.cites_conv").alias("cites_conv"), F.col("cites.cites_turn").alias("cites_turn"),
        F.coalesce("n_quotes", F.lit(0)).cast("long").alias("n_quotes"), F.coalesce("n_linked", F.lit(0)).cast("long").alias("n_linked"),
    )
    placed = _placed(joined, scratch)
    scratch.only(placed)
    return _numbered(placed)


def _placed(rows: DataFrame, scratch: Scratch) -> DataFrame:
    """rows by (conv_id, thread, turn) from one sort over ranges, so that a long conversation may span tasks: their part, and offset in it."""
    ordered = rows.repartitionByRange("conv_id", "thread", "turn").sortWithinPartitions("conv_id", "thread", "turn")
    low = F.monotonically_increasing_id()
    return scratch.keep(ordered.select("*", F.shiftright(low, 33).alias("part"), low.bitwiseAND((1 << 33) - 1).alias("offset")))


def _numbered(placed: DataFrame) -> DataFrame:
    """Places from 0 in each conversation."""
    # A row per conversation and task; conversations that span tasks add up the counts before.
    sizes = placed.groupBy("conv_id", "part").agg(F.count("*").alias("n"), F.min("offset").alias("first"))
    earlier = Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("conv_id", "part", "first", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))
    return placed.join(starts, ["conv_id", "part"]).select(
        "conv_id", (F.col("before") + F.col("offset") - F.col("first")).cast("long").alias("place"), "turn", "thread", "role", "text",
        "reply_to", "cites_conv", "cites_turn", "n_quotes", "n_linked",
    )
