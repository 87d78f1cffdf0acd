"""Interview logs: phases, context, transcripts, summaries, question plans.

Turns are ``conv_id, turn, role, text``; ``turn`` rises inside a conversation.  A single
conversation may be huge: numbering and frames are cut into blocks of turns.
"""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vitaespark import fixed
from vitaespark.functions import dialog as D
from vitaespark.operators import ordered

TURNS_PER_BLOCK = 4096


def numbered(turns: DataFrame, out: str = "question_no") -> DataFrame:
    """0-based number of each row inside its conversation, by turn."""
    block = F.floor(F.col("turn") / TURNS_PER_BLOCK)
    counted = ordered.running(turns, ["conv_id"], ["turn"], F.lit(1), out, inclusive=False, block=block)
    return counted.withColumn(out, F.col(out).cast("int"))


def phases(turns: DataFrame, skip: Column) -> DataFrame:
    """Phase of every user turn, with question and round number.

    Only the first few turns of a conversation decide where its phases start, so one small
    row per conversation joins back to the turns.
    """
    spoken = turns.filter(F.col("role") == "user")
    users = ordered.heavy_keys(spoken, "conv_id")
    asked = numbered(spoken.withColumn("_skip", F.coalesce(skip, F.lit(False))))
    flags = F.transform(F.array_sort(F.collect_list(F.struct("question_no", "_skip"))), lambda x: x["_skip"])
    starts = (
        asked.filter(F.col("question_no") < D.DECIDING_TURNS).groupBy("conv_id")
        .agg(flags.alias("_flags")).select("conv_id", D.phase_starts(F.col("_flags")).alias("_starts"))
    )
    phase = D.phase_at(F.col("question_no"), F.col("_starts"))
    begun = F.when(F.col("phase") == 0, F.lit(0)).otherwise(F.get(F.col("_starts"), F.col("phase") - 1))
    return (
        ordered.salted_join(asked, starts, "conv_id", heavy=users)
        .withColumn("phase", phase)
        .withColumns({"phase_key": D.phase_key(F.col("phase")), "round_no": F.col("question_no") - begun})
        .drop("_skip", "_starts")
    )


def phase_rounds(phased: DataFrame) -> DataFrame:
    """I3."""
    return phased.groupBy("conv_id", "phase").agg(F.count(F.lit(1)).alias("rounds"))


def question_plan(phased: DataFrame, paired: DataFrame, lang: str = "zh", heavy: DataFrame | None = None) -> DataFrame:
    """I4: the question of every user turn; ``paired`` holds both records per conv_id.

    A conversation without records gets the lines for when topics have run out.  ``heavy`` may name the
    long conversations (``ordered.heavy_keys``), so that phases need not be worked out to find them.
    """
    topics = paired.select(
        "conv_id",
        D.background_questions(F.col("education"), F.col("projects"), F.col("work_experience"), lang)
        .alias("_background"),
        D.competency_questions(
            F.col("hard_words"), F.col("name_hits"), F.col("work_experience"), lang).alias("_competency"),
        F.coalesce(F.nullif(F.col("basic_info.target_job"), F.lit("")), F.col("position")).alias("_target"),
    )
    question = D.question_for(*[F.col(c) for c in (
        "phase", "question_no", "round_no", "_background", "_competency", "_target")], lang)
    return ordered.salted_join(phased, topics, "conv_id", "left", heavy=heavy).withColumn("question", question).drop(
        "_background", "_competency", "_target")


def opening_lines(sessions: DataFrame, openings: DataFrame) -> DataFrame:
    """Opening by persona and language; unknown persona or language falls back to the defaults.

    The fall-back text is one row and rides along on the table of openings, so two equi-joins suffice.
    """
    is_default = (F.col("persona") == fixed.DEFAULT_PERSONA) & (F.col("lang") == fixed.DEFAULT_LANG)
    default = openings.agg(F.max(F.when(is_default, F.col("text"))).alias("_default"))  # one row
    known = (
        openings.groupBy(F.col("persona").alias("_persona"))
        .agg(F.map_from_entries(F.collect_list(F.struct("lang", "text"))).alias("_texts"))
        .crossJoin(F.broadcast(default))
    )
    named = known.select("_persona", F.lit(True).alias("_known"))
    used = F.when(F.col("_known"), F.col("persona")).otherwise(fixed.DEFAULT_PERSONA)
    joined = (
        sessions.join(named, sessions["persona"] == named["_persona"], "left").drop("_persona")
        .withColumn("_used", used).join(known, F.col("_used") == F.col("_persona"), "left")
    )
    line = F.coalesce(F.element_at("_texts", F.col("lang")), F.col("_default"))
    return joined.withColumn("opening", line).drop("_texts", "_default", "_known", "_used", "_persona")


def rolling_context(turns: DataFrame, size: int = fixed.CONTEXT_TURNS) -> DataFrame:
    """For each turn the last messages up to and including it, oldest first.

    Each block also gets the last few rows of the block before it.
    """
    rows = max(TURNS_PER_BLOCK, size)
    own = F.floor(F.col("_no") / rows)
    near_end = F.col("_no") >= (own + 1) * rows - (size - 1)
    copies = (
        numbered(turns, "_no").withColumn("_own", own)
        .withColumn("_block", F.explode(F.when(near_end, F.array(own, own + 1)).otherwise(F.array(own))))
    )
    frame = Window.partitionBy("conv_id", "_block").orderBy("_no").rowsBetween(1 - size, Window.currentRow)
    context = F.collect_list(F.struct("role", F.col("text").alias("content"))).over(frame)
    return (
        copies.withColumn("context", context).filter(F.col("_block") == F.col("_own"))
        .drop("_no", "_own", "_block")
    )


def transcript_lines(turns: DataFrame, chars: int | None = None) -> DataFrame:
    """I7 by turn: the line of each turn, of at most ``chars`` characters of text if that is given.

    No shuffle; the form for conversations of any length.
    """
    speaker = F.when(F.col("role") == "assistant", fixed.TRANSCRIPT_NAMES["assistant"]).otherwise(
        fixed.TRANSCRIPT_NAMES["other"])
    text = F.col("text") if chars is None else F.substring("text", 1, chars)
    return turns.select("conv_id", "turn", F.concat(speaker, F.lit(": "), text).alias("line"))


def transcripts(turns: DataFrame, chars: int | None = None) -> DataFrame:
    """One transcript per conversation, which is one value and so has to fit in a task."""
    lines = F.array_sort(F.collect_list(F.struct("turn", "line")))
    return transcript_lines(turns, chars).groupBy("conv_id").agg(
        F.array_join(F.transform(lines, lambda x: x["line"]), "\n").alias("transcript"))


def session_summary(phased: DataFrame, turns: DataFrame) -> DataFrame:
    """I8: questions asked, messages, phase list and current phase per conversation."""
    order = F.array(*[F.lit(key) for key, _ in fixed.PHASES])
    sizes = turns.groupBy("conv_id").agg(F.count(F.lit(1)).alias("messages"))
    state = phased.groupBy("conv_id").agg(
        F.count(F.lit(1)).alias("question_count"), F.max("phase").alias("_phase"))
    joined = sizes.join(state, "conv_id", "left")
    return joined.select(
        "conv_id", "messages", F.coalesce("question_count", F.lit(0)).alias("question_count"),
        order.alias("phases"), D.phase_key(F.coalesce("_phase", F.lit(0))).alias("current_phase"),
    )
