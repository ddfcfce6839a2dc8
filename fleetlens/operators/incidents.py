"""One incident shape for cards, misses, onsets and job failures."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetlens.functions.codes import integral_code, sensed_code
from fleetlens.functions.timeutil import iso

_DETECTION = (
    "struct<missed: boolean, budget: double, horizon_s: double, model_version: int, n_alerts_in_window: bigint>"
)
# Raw fields that have a place of their own in the shape.
RESERVED = ("observed_xid", "xid", "gpu", "fail_time", "ts", "onset_t", "id", "job_id")


def _shape(df: DataFrame, **parts: Column) -> DataFrame:
    return df.select(
        parts["incident_id"].alias("incident_id"),
        parts["source"].alias("source"),
        parts["gpu"].alias("gpu"),
        parts["fail_time"].alias("fail_time"),
        F.struct(
            parts["code"].alias("xid"), parts["gpu"].alias("gpu"), parts["onset_t"].alias("onset_t")
        ).alias("observed"),
        parts["detection"].alias("detection"),
        parts["details"].alias("details"),
    )


def from_onsets(onset_rows: DataFrame) -> DataFrame:
    """Raw onsets: the code is an observed fact."""
    t = iso("ts")
    return _shape(
        onset_rows,
        incident_id=F.concat_ws("@", "gpu", t),
        source=F.lit("xid_onset"),
        gpu=F.col("gpu"),
        fail_time=t,
        code=F.col("code").cast("double"),
        onset_t=t,
        detection=F.lit(None).cast(_DETECTION),
        details=F.lit(None).cast("map<string,string>"),
    )


def from_misses(miss_rows: DataFrame) -> DataFrame:
    """Missed onsets: place and time are observed, the code is not; ``detection`` says why."""
    t = iso("onset_ts")
    detection = F.struct(
        (~F.col("caught")).alias("missed"),
        F.col("budget"),
        F.col("horizon_s"),
        F.col("model_version"),
        F.col("n_alerts_in_window"),
    ).cast(_DETECTION)
    return _shape(
        miss_rows,
        incident_id=F.concat_ws("@", "gpu", t),
        source=F.lit("missed_onset"),
        gpu=F.col("gpu"),
        fail_time=t,
        code=F.lit(None).cast("double"),
        onset_t=t,
        detection=detection,
        details=F.transform_values("pre_event_features", lambda k, v: v.cast("string")),
    )


def canonical(raw: DataFrame) -> DataFrame:
    """Normalise raw text records of any origin; a frame already in the shape passes through.

    Uses whichever of ``incident_id, id, job_id`` / ``fail_time, ts, onset_t`` /
    ``observed_xid, xid`` / ``gpu`` or ``node``+``idx`` exist. A code is lifted only when
    one was really sensed; all other columns go to ``details``.
    """
    if {"observed", "source"} <= set(raw.columns):
        return raw

    def have(*names: str) -> list[Column]:
        return [F.nullif(F.trim(F.col(n).cast("string")), F.lit("")) for n in names if n in raw.columns]

    def first(*names: str, default: str | None = None) -> Column:
        options = have(*names) + [F.lit(default).cast("string")]
        return F.coalesce(*options)

    code = sensed_code(first("observed_xid", "xid"))
    if {"node", "idx"} <= set(raw.columns):
        place = F.when(F.col("idx").isNotNull(), F.concat_ws("-", "node", F.col("idx").cast("string"))).otherwise(F.col("node"))
        gpu = F.coalesce(*have("gpu"), place)
        used = (*RESERVED, "node", "idx")
    else:
        gpu = first("gpu")
        used = RESERVED
    when = first("fail_time", "ts", "onset_t")
    extra = [c for c in raw.columns if c not in (*used, "incident_id", "source")]
    details = (
        F.create_map(*[x for c in extra for x in (F.lit(c), F.col(c).cast("string"))])
        if extra
        else F.lit(None).cast("map<string,string>")
    )
    return _shape(
        raw,
        incident_id=first("incident_id", "id", "job_id", default="unknown"),
        source=F.coalesce(*have("source"), F.when(code.isNotNull(), "xid_onset").otherwise("job_trace")),
        gpu=gpu,
        fail_time=when,
        code=code,
        onset_t=F.coalesce(*have("onset_t"), when),
        detection=F.lit(None).cast(_DETECTION),
        details=details,
    )


def shown_code(code: str | Column) -> Column:
    return integral_code(code)


def disposition(final_text: str | Column, all_text: str | Column | None = None) -> Column:
    """Triage outcome from the transcript: escalate, else page (ticket or wording), else restart and watch."""
    final = F.lower(F.col(final_text) if isinstance(final_text, str) else final_text)
    seen = final_text if all_text is None else all_text
    ticket = ticket_number(seen)
    return (
        F.when(F.contains(final, F.lit("escalate")), "ESCALATE_TO_OPS")
        .when(ticket.isNotNull() | final.rlike(r"\bpage\b.*technician"), "PAGE_TECHNICIAN")
        .otherwise("RESTART_AND_WATCH")
    )


def ticket_number(text: str | Column) -> Column:
    t = F.col(text) if isinstance(text, str) else text
    return F.nullif(F.regexp_extract(t, r"TKT-\d+", 0), F.lit(""))
