"""Problem 2: conversations out of message rows.

Method. Message rows are cleaned (one row per id, speaker and conversation id in one spelling), sorted by time, and
messages repeated directly after themselves fold into the earliest. A reply must come after its question and before the
next one: for each sender of questions these constraints, over the conversations with as many answers as questions, give
the offset of the sender's clock by least squares on what is violated (the answering service's clock is the reference, as
only the difference of two clocks shows). An offset is a sender's and not a conversation's if at least LEAST_SHARE of the
sender's conversations, and at least LEAST_CONVERSATIONS, cannot be met without it; it is then applied, as far as
``max_offset_s`` allows. The conversations it touches are merged again by corrected time, and conversations whose
constraints still cannot be met are rejected, together with those that are broken, empty or lack a reply.

A conversation that holds a third of all rows is no group of its own anywhere: rows are range-partitioned by conversation,
time and id, windows run inside a range, and one row for each range and conversation carries on what crosses its border.
Texts are left out of all this: a turn carries a 64-bit hash of its words.

Nulls: a row without id, conversation id or user is still a turn (without a conversation id it belongs to none and is
dropped); a turn without time, with an unknown speaker or without real content rejects its conversation. Ties in time go
by id. Empty tables give no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import written

# How the two speakers are written.
USER_NAMES = ("user", "human", "engineer", "customer", "prompter", "me")
ASSISTANT_NAMES = ("assistant", "ai", "bot", "gpt", "model", "chatbot")
SYSTEM_NAMES = ("system", "developer", "tool")
# What stands for a text that is not there, how failures are announced, and a text of few sentences.
PLACEHOLDER = r"(?i)^[\[\(<{*\s]*(?:null|none|nil|undefined|nan|n/?a|empty|blank|no (?:response|reply|answer|content|message|text)|(?:message )?(?:deleted|removed)|placeholder|tbd|todo)[\]\)>}*\s.!]*$"
FAILURE = r"(?i)^\W*(?:(?:error|exception|failure)\b[:\s]*(?:\d{3}\b|.*\b(?:timed? ?out|overloaded|unavailable|failed|refused|exceeded)\b)|(?:the )?(?:assistant|service|server|model|system) is (?:currently |temporarily )?(?:unavailable|overloaded|down)\b|(?:the )?request (?:failed|timed out|was aborted)|(?:http )?5\d\d (?:internal|bad|service|gateway)|rate limit exceeded|something went wrong)"
NOTICE = r"^[^.!?\n]*(?:[.!?\n]+[^.!?\n]*){0,3}$"
USER, ASSISTANT, SYSTEM = 1, 2, 0
#: Seconds a clock may be off, what share and how many of a sender's conversations must speak for an offset.
MAX_OFFSET_S, LEAST_SHARE, LEAST_CONVERSATIONS = 3600.0, 0.5, 3
#: Turns in one range, as long as there are no more ranges than shuffle partitions, and beyond that.
FEW_TURNS, MANY_TURNS = 25_000, 2_000_000


def speaker(role: Column) -> Column:
    r = F.lower(F.regexp_replace(role, r"(?U)[\s:]+", ""))
    return F.when(r.isin(*USER_NAMES), USER).when(r.isin(*ASSISTANT_NAMES), ASSISTANT).when(r.isin(*SYSTEM_NAMES), SYSTEM)


def real_content(content: Column) -> Column:
    """Has a letter or digit, and is neither a placeholder nor a failure notice."""
    return F.coalesce(content.rlike(r"[\p{L}\p{N}]") & ~content.rlike(PLACEHOLDER) & ~(content.rlike(FAILURE) & content.rlike(NOTICE)), F.lit(False))


def words(content: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(content), r"[^\p{L}\p{N}]+", " "))


def _rows(messages: DataFrame) -> DataFrame:
    """Message rows with what is compared; key is the id, or a hash of the row where there is none."""
    cid = F.lower(F.regexp_replace(F.col("conversation_id"), r"(?Ui)^urn:uuid:|[\s{}()]", ""))
    t = messages.select(
        cid.alias("conversation_id"),
        F.col("id").cast("bigint").alias("id"),
        F.coalesce(F.col("id").cast("bigint"), F.xxhash64("content", "created_at")).alias("key"),
        F.col("user_name").alias("sender"),
        speaker(F.col("role")).cast("tinyint").alias("speaker"),
        F.col("created_at").cast("timestamp").alias("created_at"),
        F.xxhash64(words(F.col("content"))).alias("said"),
        real_content(F.col("content")).alias("real"),
        "content",
    )
    return t.where("conversation_id is not null and conversation_id <> ''")


def clean_messages(messages: DataFrame) -> DataFrame:
    """(conversation_id, id, key, sender, speaker, created_at, said, fit): one row per id, its earliest; system rows are
    left out. said is a hash of the words."""
    t = _rows(messages).drop("content").withColumn("fit", F.col("real") & F.col("created_at").isNotNull() & F.col("speaker").isNotNull()).drop("real")
    rest = [c for c in t.columns if c not in ("conversation_id", "key")]
    # rows of one id share a conversation, and ids spread a hot one
    first = F.min_by(F.struct(*rest), F.struct(F.col("created_at").isNull(), "created_at", F.col("speaker").isNull(), "speaker", ~F.col("fit"), "said", "sender"))
    once = t.groupBy("conversation_id", "key").agg(first.alias("m")).select("conversation_id", "key", "m.*")
    return once.where(~F.col("speaker").eqNullSafe(F.lit(SYSTEM)))


def sequence(turns: DataFrame) -> DataFrame:
    """turns (as clean_messages gives them, with the time ``at``) and repeat, turn_no, nth (how many kept turns of the same
    speaker there are so far), verdict (kept, broken, unanswered or empty), open (all turns fit and as many answers as
    questions), in order of ``at`` (nulls first), then id."""
    spark = turns.sparkSession
    t = written(turns, "turns")
    n = t.count()
    few = int(spark.conf.get("spark.sql.shuffle.partitions"))
    parts = max(1, min(-(-n // FEW_TURNS), max(few, -(-n // MANY_TURNS))))
    order = [F.col("at").asc_nulls_first(), F.col("id").asc_nulls_first(), F.col("key")]
    t = written(t.repartitionByRange(parts, "conversation_id", *order).withColumn("part", F.spark_partition_id()), "turn-ranges")

    group = Window.partitionBy("part", "conversation_id")
    inside, said = group.orderBy(*order), F.struct("speaker", "said")
    running = inside.rowsBetween(Window.unboundedPreceding, 0)
    t = t.withColumn("i", F.row_number().over(inside)).withColumn("_p", F.lag(said).over(inside))
    same = F.col("_p").isNotNull() & F.col("_p.speaker").eqNullSafe(F.col("speaker"))
    t = t.withColumn("repeat", same & F.col("_p.said").eqNullSafe(F.col("said"))).withColumn("broken", same & ~F.col("repeat")).drop("_p")
    one = F.when(F.col("repeat"), 0).otherwise(1)
    asks, answers = (F.when(F.col("speaker").eqNullSafe(F.lit(k)), one).otherwise(0) for k in (USER, ASSISTANT))
    t = t.withColumns({"k": F.sum(one).over(running), "u": F.sum(asks).over(running), "a": F.sum(answers).over(running)})

    # one row for each range and conversation; what comes before it in the conversation
    e = t.groupBy("part", "conversation_id").agg(
        F.min(F.struct("i", "speaker", "said")).alias("head"), F.max(F.struct("i", "speaker", "said", "k", "u", "a")).alias("tail"), F.max(~F.col("fit")).alias("unfit"), F.max("broken").alias("broken")
    )
    over = Window.partitionBy("conversation_id")
    before = over.orderBy("part")
    e = e.withColumn("_c", F.lag("tail").over(before))
    again = F.col("_c").isNotNull() & F.col("_c.speaker").eqNullSafe(F.col("head.speaker")) & F.col("_c.said").eqNullSafe(F.col("head.said"))
    meets = F.col("_c").isNotNull() & F.col("_c.speaker").eqNullSafe(F.col("head.speaker"))
    e = e.withColumn("again", again).withColumn("meets", meets & ~again)
    less = F.when(F.col("again"), 1).otherwise(0)
    own = {"k": F.col("tail.k") - less, "u": F.col("tail.u") - F.when(F.col("head.speaker").eqNullSafe(F.lit(USER)), less).otherwise(0), "a": F.col("tail.a") - F.when(F.col("head.speaker").eqNullSafe(F.lit(ASSISTANT)), less).otherwise(0)}
    e = e.withColumns({f"own_{c}": v for c, v in own.items()})
    e = e.withColumns({f"from_{c}": F.coalesce(F.sum(f"own_{c}").over(before.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) for c in own})
    e = e.withColumns({f"all_{c}": F.sum(f"own_{c}").over(over) for c in own})
    e = e.withColumn("bad", F.max("unfit").over(over)).withColumn("clash", F.max(F.col("broken") | F.col("meets")).over(over))
    whole = over.orderBy("part").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    first, last = F.first("head.speaker").over(whole), F.last("tail.speaker").over(whole)
    verdict = F.when(F.col("bad") | first.eqNullSafe(F.lit(ASSISTANT)) | F.col("clash"), "broken").when(last.eqNullSafe(F.lit(USER)), "unanswered").when(F.col("all_k") < 2, "empty").otherwise("kept")
    e = e.select("part", "conversation_id", "again", "from_k", "from_u", "from_a", "all_k", verdict.alias("verdict"), (~F.col("bad") & (F.col("all_u") == F.col("all_a"))).alias("open"))

    t = t.join(e, ["part", "conversation_id"])
    head = F.col("again") & (F.col("i") == 1)
    less = F.when(F.col("again"), 1).otherwise(0)
    kept_head = F.col("again") & (F.first("speaker").over(inside).eqNullSafe(F.col("speaker")))
    nth = F.when(F.col("speaker").eqNullSafe(F.lit(USER)), F.col("u") + F.col("from_u")).when(F.col("speaker").eqNullSafe(F.lit(ASSISTANT)), F.col("a") + F.col("from_a")) - F.when(kept_head, 1).otherwise(0)
    t = t.withColumns({"nth": nth, "repeat": F.col("repeat") | head, "turn_no": (F.col("k") + F.col("from_k") - less).cast("int")})
    return t.select(*turns.columns, "repeat", "turn_no", "nth", "verdict", "open", F.col("all_k").cast("int").alias("turns"))


def clock_offsets(seq: DataFrame, max_offset_s: float = MAX_OFFSET_S, least_share: float = LEAST_SHARE, least_conversations: int = LEAST_CONVERSATIONS) -> DataFrame:
    """(sender, offset_s, conversations, violated, applied): seconds to add to the times of a sender's questions, for each
    sender with a violated conversation; conversations are those that could speak for or against an offset.

    With the k-th question, the k-th answer and the next question an offset o has to keep asked + o <= answered <= asked
    next + o. Bounds are clipped to max_offset_s and summed by whole seconds, so what is kept of a sender, however busy, is
    at most one row for each second; the least-squares loss of the violated bounds has its derivative exact at each of
    these. Where no bound is violated over a span, the offset is the middle of it."""
    per = seq.where("open and not repeat and turn_no = 1").groupBy("sender").agg(F.count("*").alias("conversations"), F.count_if(F.col("verdict") != "kept").alias("violated")).where("violated > 0")
    x = seq.where("open and not repeat").withColumn("s", F.unix_micros("at") / 1e6)
    q = x.where(F.col("speaker") == USER).join(per.select("sender"), "sender").select("conversation_id", F.col("nth").alias("k"), "sender", F.col("s").alias("asked"))
    ends = F.explode(F.array(F.struct(F.col("nth").alias("k"), F.lit(True).alias("above")), F.struct((F.col("nth") + 1).alias("k"), F.lit(False).alias("above"))))
    a = x.where(F.col("speaker") == ASSISTANT).select("conversation_id", F.col("s").alias("answered"), ends.alias("e")).select("conversation_id", "answered", "e.*")
    far = max_offset_s + 1
    bounds = q.join(a, ["conversation_id", "k"]).select("sender", "above", F.greatest(F.lit(-far), F.least(F.lit(far), F.col("answered") - F.col("asked"))).alias("v"))
    bins = bounds.groupBy("sender", "above", F.floor("v").alias("b")).agg(F.count("*").alias("n"), F.sum("v").alias("v"))
    # a lower bound counts at every point up to its second, an upper one at every point after it
    zero = F.lit(0)
    low, high = ~F.col("above"), F.col("above")
    at = F.array(
        F.struct(F.col("b").alias("x"), F.when(low, F.col("n")).otherwise(zero).alias("nl"), F.when(low, F.col("v")).otherwise(zero).alias("vl"), F.lit(0).cast("bigint").alias("nu"), F.lit(0.0).alias("vu")),
        F.struct((F.col("b") + 1).alias("x"), F.lit(0).cast("bigint").alias("nl"), F.lit(0.0).alias("vl"), F.when(high, F.col("n")).otherwise(zero).alias("nu"), F.when(high, F.col("v")).otherwise(zero).alias("vu")),
    )
    p = bins.select("sender", F.explode(at).alias("p")).select("sender", "p.*").groupBy("sender", "x").agg(*[F.sum(c).alias(c) for c in ("nl", "vl", "nu", "vu")])
    up = Window.partitionBy("sender").orderBy("x")  # at most two points for each second
    to, on = up.rowsBetween(Window.unboundedPreceding, 0), up.rowsBetween(0, Window.unboundedFollowing)
    pull = F.sum("vl").over(on) - F.sum("nl").over(on) * F.col("x") - F.sum("nu").over(to) * F.col("x") + F.sum("vu").over(to)
    p = p.withColumn("g", F.round(pull, 6))
    got = p.groupBy("sender").agg(
        F.max(F.when(F.col("g") > 0, F.struct("x", "g"))).alias("l"), F.min(F.when(F.col("g") < 0, F.struct("x", "g"))).alias("r"), F.min(F.when(F.col("g") == 0, F.col("x"))).alias("z0"), F.max(F.when(F.col("g") == 0, F.col("x"))).alias("z1")
    )
    slope = F.col("l.x") + (F.col("r.x") - F.col("l.x")) * F.col("l.g") / (F.col("l.g") - F.col("r.g"))
    best = F.coalesce((F.col("z0") + F.col("z1")) / 2, slope, F.col("l.x"), F.col("r.x")).cast("double")
    best = F.greatest(F.lit(-max_offset_s), F.least(F.lit(max_offset_s), best))
    applied = (F.col("violated") >= least_conversations) & (F.col("violated") >= F.lit(least_share) * F.col("conversations"))
    return per.join(got, "sender").select("sender", best.alias("offset_s"), "conversations", "violated", applied.alias("applied"))


def rebuild(messages: DataFrame, max_offset_s: float = MAX_OFFSET_S) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(turns of kept conversations, verdict of every conversation, clock offsets). Turns have conversation_id, turn_no,
    id, role, created_at as stored, key and said; see with_content."""
    seq = written(sequence(clean_messages(messages).withColumn("at", F.col("created_at"))), "turn-sequence")
    offsets = written(clock_offsets(seq, max_offset_s), "clock-offsets")
    shift = offsets.where("applied").select("sender", "offset_s")
    # the conversations that an offset touches are put in order again, all others stand
    touched = seq.where(F.col("speaker") == USER).join(shift.select("sender"), "sender", "left_semi").select("conversation_id").distinct()
    moved = seq.join(touched, "conversation_id", "left_semi").join(shift, "sender", "left")
    asked = (F.col("speaker") == USER) & F.col("offset_s").isNotNull() & F.col("at").isNotNull()
    moved = moved.withColumn("at", F.when(asked, F.timestamp_micros(F.unix_micros("at") + (F.col("offset_s") * 1e6).cast("bigint"))).otherwise(F.col("at")))
    if not shift.isEmpty():
        again = sequence(moved.select("conversation_id", "id", "key", "sender", "speaker", "created_at", "said", "fit", "at"))
        seq = seq.join(touched, "conversation_id", "left_anti").unionByName(again)
    role = F.when(F.col("speaker") == USER, "user").otherwise("assistant")
    turns = seq.where("verdict = 'kept' and not repeat").select("conversation_id", "turn_no", "id", role.alias("role"), "created_at", "key", "said")
    return turns, seq.where("turn_no = 1 and not repeat").select("conversation_id", "turns", "verdict"), offsets


def with_content(turns: DataFrame, messages: DataFrame) -> DataFrame:
    """(conversation_id, turn_no, id, role, created_at, content): the texts put back."""
    same = ["conversation_id", "key", "created_at", "said"]
    texts = _rows(messages).groupBy(*same).agg(F.min("content").alias("content"))
    return turns.join(texts, same).select("conversation_id", "turn_no", "id", "role", "created_at", "content")
