"""Usage events and extracted documents."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import DataFrame, functions as F

from tallyframe.functions.text import trim_all

# Fixed value: below this average a document needs optical recognition.
LEAST_CHARS_PER_PAGE = 50


def first_events(events: DataFrame) -> DataFrame:
    """The first event ever per (install, name); later ones are repeats."""
    # Time and id as one number keep the aggregate in hash form.
    micros = F.expr("timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01', ts)").cast("decimal(18,0)")
    rank = micros * F.lit(Decimal(10**19)) + F.col("event_id").cast("decimal(19,0)")
    return events.groupBy("user_id", "event_type").agg(
        F.min_by("event_id", rank).alias("event_id"), F.min("ts").alias("ts")
    )


def gated_events(events: DataFrame, opted_out: DataFrame) -> DataFrame:
    """Events of installs that did not opt out."""
    return events.join(opted_out.select("user_id").distinct(), "user_id", "left_anti")


def milestones(events: DataFrame, opted_out: DataFrame) -> DataFrame:
    """Milestones to report.  One reached while opted out is consumed, not postponed, so
    the gate comes after the first event is chosen."""
    return gated_events(first_events(events), opted_out)


def page_profile(documents: DataFrame) -> DataFrame:
    """``documents(doc_id, text)``: page count, average trimmed length, route and the
    labelled text.  All inside the row: no page leaves its document."""
    pages = F.split("text", "\f")
    last_blank = (F.size(pages) > 0) & (trim_all(F.element_at(pages, -1)) == "")
    kept = F.when(last_blank, F.slice(pages, 1, F.size(pages) - 1)).otherwise(pages)
    trimmed = F.transform(kept, trim_all)
    chars = F.aggregate(trimmed, F.lit(0), lambda n, p: n + F.length(p))
    count = F.greatest(F.size(kept), F.lit(1))
    labelled = F.array_join(
        F.transform(trimmed, lambda p, i: F.concat(F.lit("--- Page "), (i + 1).cast("string"), F.lit(" ---\n"), p)),
        "\n\n",
    )
    average = chars / count
    return documents.select(
        "doc_id",
        count.alias("pages"),
        average.cast("double").alias("chars_per_page"),
        (average < LEAST_CHARS_PER_PAGE).alias("needs_ocr"),
        F.when(average >= LEAST_CHARS_PER_PAGE, labelled).alias("page_text"),
    )
