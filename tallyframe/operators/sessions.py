"""Conversations: summaries, titles, recency groups."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, functions as F

from tallyframe.functions.text import session_title


def session_summary(messages: DataFrame) -> DataFrame:
    """``messages(conv_id, turn, role, text)``: first user message, count, last turn.

    Only extremes and counts are kept, so a long conversation combines on the map side."""
    user_turn = F.when(F.col("role") == "user", F.col("turn"))
    return messages.groupBy("conv_id").agg(
        F.coalesce(F.min_by(F.when(F.col("role") == "user", F.col("text")), user_turn), F.lit("")).alias("first_message"),
        F.count("*").alias("messages"),
        F.max("turn").alias("last_turn"),
    )


def session_titles(messages: DataFrame) -> DataFrame:
    return session_summary(messages).select("conv_id", session_title(F.col("first_message")).alias("title"))


def session_groups(sessions: DataFrame, today: dt.date, *ties: str) -> DataFrame:
    """``sessions(.., modified)`` by recency with a Today / Yesterday / Earlier label.

    A session without a time counts as new; equal times follow the columns ``ties``."""
    start = F.lit(today.isoformat()).cast("timestamp_ntz")
    modified = F.col("modified")
    label = (
        F.when(modified.isNull() | (modified >= start), F.lit("Today"))
        .when(modified >= start - F.expr("interval 1 day"), F.lit("Yesterday"))
        .otherwise(F.lit("Earlier"))
    )
    return sessions.withColumn("label", label).orderBy(modified.desc_nulls_first(), *ties)
