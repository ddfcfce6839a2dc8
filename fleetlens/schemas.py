"""Explicit table schemas; nothing is inferred from files."""

from __future__ import annotations

TELEMETRY = "ts timestamp, node string, gpu_idx int, gpu string, metric string, value double"
GAUGE = "ts timestamp, node string, gpu_idx int, gpu string, code double"
ONSETS = "ts timestamp, gpu string, node string, gpu_idx int, code int"
JOBS = (
    "job_id string, user string, node_num string, gpu_num string, cpu_num string, "
    "mem_per_pod_GB string, shared_mem_per_pod string, type string, state string, submit_time string, "
    "start_time string, end_time string, fail_time string, stop_time string, duration string, queue string, gpu_time string"
)
POINT_META = ("gpu", "node", "gpu_idx", "t_ref", "event_source", "horizon_s", "lookback_s", "label")
WINDOW_STATS = ("count", "coverage", "present", "mean", "std", "min", "max", "last", "delta", "slope")
SOP = (
    "entry_id bigint, type string, summary string, disposition string, resolution string, incident_id string, "
    "metrics struct<power_spike_ratio: double, temp_rise_C: double, correlated_count: int>, embedding array<float>"
)
REGISTRY = (
    "version int, model_type string, features array<string>, metric string, value double, roc_auc double, avg_precision double, "
    "permuted_auc double, permutations int, base_rate double, strongest_alone double, window_start timestamp, window_end timestamp, "
    "n_train bigint, n_test bigint, dataset_path string, dataset_sha256 string, holdout_id string, model_path string"
)


def feature_columns(columns) -> list[str]:
    """Every column that is not point metadata."""
    return [c for c in columns if c not in POINT_META]
