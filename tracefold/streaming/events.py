"""Analysis events: state, history, subscriptions and gates.

The aggregates below run unchanged on a table and on a stream in update mode:
they keep the value with the highest sequence number, so late rows need no
special order.  Only the history cap and the once-only gate need own state.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tracefold import rules
from tracefold.functions.literals import first_match
from tracefold.operators.ordering import number_rows

EVENT_SCHEMA = ("analysis_id string, seq bigint, ts timestamp, event_type string, step string, "
                "agent string, progress double, message string, file_type string, "
                "category string, route string, label string, output string")


def latest(value: Column) -> Column:
    """Non-null value with the highest sequence number."""
    return F.max_by(value, F.when(value.isNotNull(), F.col("seq")))


def analysis_state(events: DataFrame) -> DataFrame:
    """Status, progress, file info, prediction and error of each analysis."""
    kind, step = F.col("event_type"), F.col("step")
    done = kind == "step_completed"
    status = first_match([
        (kind.isin("analysis_started", "file_identified"), F.lit("identifying")),
        (kind == "step_started", step),
        (done & (step == "pe_analysis"), F.lit("ml_prediction")),
        (done & (step == "agents_analysis"), F.lit("generating_report")),
        (kind == "analysis_completed", F.lit("completed")),
        (kind == "analysis_failed", F.lit("failed"))])
    progress = first_match([
        (kind == "analysis_started", F.lit(0.0)), (kind == "file_identified", F.lit(0.1)),
        (kind.isin("step_started", "step_progress"), F.col("progress")),
        (kind.isin("analysis_completed", "analysis_failed"), F.lit(1.0))])
    identified = lambda c: F.when(kind == "file_identified", F.col(c))
    error = F.when(kind == "analysis_failed",
                   F.coalesce(F.nullif("message", F.lit("")), F.lit("Analysis failed.")))
    return events.groupBy("analysis_id").agg(
        latest(status).alias("status"), latest(progress).alias("progress"),
        latest(identified("file_type")).alias("file_type"),
        latest(identified("category")).alias("category"),
        latest(identified("route")).alias("route"),
        latest(F.when(done & (step == "ml_prediction"), F.col("label"))).alias("prediction"),
        latest(error).alias("error"))


def agent_activity(events: DataFrame) -> DataFrame:
    """Latest status of every agent of an analysis."""
    kind = F.col("event_type")
    status = first_match([(kind.isin("agent_started", "agent_thinking"), F.lit("thinking")),
                          (kind == "agent_completed", F.lit("completed")),
                          (kind == "agent_failed", F.lit("failed"))])
    return (events.withColumn("_s", status)
            .where(F.col("_s").isNotNull() & F.col("agent").isNotNull())
            .groupBy("analysis_id", "agent").agg(F.max_by("_s", "seq").alias("status")))


def event_history(events: DataFrame) -> DataFrame:
    """Every event with its place in its analysis."""
    return number_rows(events, ["seq", "event_type"], ["analysis_id"], "place")


def subscribe(events: DataFrame, analysis_id: str | None = None) -> DataFrame:
    """Events of one analysis, or of all."""
    return events if analysis_id is None else events.where(F.col("analysis_id") == analysis_id)


def finished_roles(events: DataFrame) -> DataFrame:
    return events.where((F.col("event_type") == "agent_completed")
                        & F.col("agent").isin(rules.PARALLEL_ROLES))


def stage_gate(events: DataFrame) -> DataFrame:
    """Sequence number at which the last parallel role of an analysis is done."""
    firsts = finished_roles(events).groupBy("analysis_id").agg(*[
        F.min(F.when(F.col("agent") == role, F.col("seq"))).alias(f"_{i}")
        for i, role in enumerate(rules.PARALLEL_ROLES)])
    marks = [F.col(f"_{i}") for i in range(len(rules.PARALLEL_ROLES))]
    ready = marks[0].isNotNull()
    for mark in marks[1:]:
        ready = ready & mark.isNotNull()
    return firsts.where(ready).select("analysis_id", F.greatest(*marks).alias("gate_seq"))


def stream_stage_gate(events: DataFrame) -> DataFrame:
    """The gate on a stream: one row per analysis, emitted once.

    The state is a bit mask of the finished roles and an emitted flag.
    """
    bit = first_match([(F.col("agent") == role, F.lit(1 << i))
                       for i, role in enumerate(rules.PARALLEL_ROLES)])
    full = (1 << len(rules.PARALLEL_ROLES)) - 1

    def gate(key: tuple, batches: Iterator[pd.DataFrame],
             state: GroupState) -> Iterator[pd.DataFrame]:
        mask, emitted, last = state.get if state.exists else (0, False, -1)
        rows = pd.concat(list(batches)).sort_values("seq")
        for seq, role in zip(rows["seq"], rows["bit"]):
            if not mask & int(role):
                mask, last = mask | int(role), int(seq)
        if mask == full and not emitted:
            emitted = True
            yield pd.DataFrame({"analysis_id": [key[0]], "gate_seq": [last]})
        state.update((mask, emitted, last))

    marked = finished_roles(events).select("analysis_id", "seq", bit.cast("long").alias("bit"))
    return marked.groupBy("analysis_id").applyInPandasWithState(
        gate, "analysis_id string, gate_seq long", "mask long, emitted boolean, last long",
        "append", GroupStateTimeout.NoTimeout)


def job_status(in_flight: DataFrame, analyses: DataFrame) -> DataFrame:
    """In-flight state first, else the stored record as completed."""
    live = in_flight.select("analysis_id", F.col("status").alias("_s"),
                            F.col("progress").alias("_p"))
    stored = analyses.select(F.col("id").alias("analysis_id"), "file_name",
                             F.lit("completed").alias("_done"))
    return live.join(stored, "analysis_id", "full").select(
        "analysis_id", F.coalesce("_s", "_done").alias("status"),
        F.coalesce("_p", F.lit(1.0)).alias("progress"),
        F.coalesce("file_name", F.lit("")).alias("file_name"))
