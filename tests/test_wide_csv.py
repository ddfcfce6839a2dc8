from __future__ import annotations

import pytest

from fleetlens.operators.onsets import onsets
from fleetlens.operators.telemetry import downsample_timestamps, snapshot
from fleetlens.sources import tables, wide_csv

def grid(columns: dict[str, list], start: str = "2024-02-29 22:00:{:02d}-05:00", step: int = 20) -> str:
    """A wide file from columns of cells; None is an empty cell."""
    lines = [",".join(["Time", *columns])]
    for i, cells in enumerate(zip(*columns.values(), strict=True)):
        lines.append(",".join([start.format(i * step), *("" if c is None else str(c) for c in cells)]))
    return "\n".join(lines) + "\n"


HEAT = grid({"10.9.8.7-0": [None, 61.5, 63.0], "10.9.8.7-6": [40.25, None, 41.0]})
DRAW = grid({"10.9.8.7-6": [None, None, 480.0], "10.9.8.8-2": [77.0, 78.0, 79.0]})
RAGGED = ["0,,0", "43,31,0", "43,31", "0,31,45", "0", "0,31,45"]


def write(tmp_path, name, text):
    path = tmp_path / name
    path.write_text(text)
    return str(path)


def test_an_empty_cell_is_no_reading(spark, tmp_path):
    path = write(tmp_path, "heat.csv", HEAT)
    read = {(r.gpu, r.ts.second): r.value for r in wide_csv.read_wide(spark, path, "GPU_TEMP").collect()}
    assert read == {("10.9.8.7#0", 20): 61.5, ("10.9.8.7#0", 40): 63.0, ("10.9.8.7#6", 0): 40.25, ("10.9.8.7#6", 40): 41.0}
    with_idle = wide_csv.read_wide(spark, path, "GPU_TEMP", keep_empty=True)
    assert with_idle.where("value IS NULL").count() == 2 and with_idle.count() == 6
    assert wide_csv.fleet_size(spark, path) == 2


def test_both_ends_of_a_range_count_and_devices_can_be_chosen(spark, tmp_path):
    path = write(tmp_path, "draw.csv", DRAW)
    late = wide_csv.read_wide(spark, path, "POWER_USAGE", time_range=("2024-02-29 22:00:20-05:00", "2024-02-29 22:00:40-05:00"))
    assert sorted(r.value for r in late.collect()) == [78.0, 79.0, 480.0]
    for chosen, n in ((["10.9.8.8#2"], 3), (["10.9.8.7#6"], 1), ([], 0)):
        assert wide_csv.read_wide(spark, path, "POWER_USAGE", gpus=chosen).count() == n


def test_other_host_names_join_by_alias(spark, tmp_path):
    files = {"GPU_TEMP": HEAT, "POWER_USAGE": DRAW, "SM_ACTIVE": grid({"east/row2/host7-6": [0.125]}, step=0).replace("\n", "\r\n")}
    paths = {metric: write(tmp_path, f"{metric}.csv", text) for metric, text in files.items()}
    long = wide_csv.load_metrics(spark, paths, alias={"east/row2/host7": "10.9.8.7"})
    start = snapshot(long, "10.9.8.7#6", "2024-03-01 03:00:00").first()["readings"]
    end = snapshot(long, "10.9.8.7#6", "2024-03-01 03:00:40").first()["readings"]
    assert (start, end) == ({"GPU_TEMP": 40.25, "SM_ACTIVE": 0.125}, {"GPU_TEMP": 41.0, "POWER_USAGE": 480.0})
    assert downsample_timestamps(long, 2).where("metric = 'POWER_USAGE'").count() == 3


def test_ragged_line_has_no_cell_and_makes_no_onset(spark, tmp_path):
    text = "Time,n-0,n-1,n-2\n" + "".join(f"2023-08-15 00:{i // 4:02d}:{i % 4 * 15:02d}+08:00,{r}\n" for i, r in enumerate(RAGGED))
    gauge = wide_csv.read_gauge(spark, write(tmp_path, "x.csv", text))
    assert gauge.count() == 3 + 3 + 2 + 3 + 1 + 3
    for chunk in (15, 60, 3600):
        found = sorted((r.gpu, r.code) for r in onsets(gauge, chunk_seconds=chunk).collect())
        assert found == [("n#0", 43), ("n#1", 31), ("n#2", 45)]


def test_bad_sources_fail(spark, tmp_path):
    with pytest.raises(ValueError, match="not a wide"):
        wide_csv.read_wide(spark, write(tmp_path, "a.csv", "when,n-0\n1,2\n"), "X")
    with pytest.raises(ValueError, match="not a wide"):
        wide_csv.read_wide(spark, write(tmp_path, "b.csv", "Time\n1\n"), "X")
    with pytest.raises(ValueError, match="device id"):
        wide_csv.read_wide(spark, write(tmp_path, "c.csv", "Time,nodash\n1,2\n"), "X")
    with pytest.raises(Exception, match="unparseable timestamp"):
        wide_csv.read_wide(spark, write(tmp_path, "d.csv", "Time,n-0\nnot_a_timestamp,5\n"), "X").collect()
    folder = tmp_path / "two"
    folder.mkdir()
    write(folder, "1.csv", "Time,n-0\n2023-08-15 00:00:00+08:00,1\n")
    write(folder, "2.csv", "Time,n-1\n2023-08-15 00:00:00+08:00,1\n")
    # every file has a header of its own
    assert sorted(r.gpu for r in wide_csv.read_wide(spark, str(folder), "X").collect()) == ["n#0", "n#1"]
    twice = write(tmp_path, "e.csv", "Time,n-0\n2023-08-15 00:00:00+08:00,1\nTime,n-1\n2023-08-15 00:00:15+08:00,1\n")
    with pytest.raises(Exception, match="header line differs"):
        wide_csv.read_wide(spark, twice, "X").collect()


def test_relative_seconds_and_headless_files(spark, tmp_path):
    rel = write(tmp_path, "rel.csv", "Time,a-0\n0,0\n12.5,43\n")
    with pytest.raises(Exception, match="relative seconds"):
        wide_csv.read_wide(spark, rel, "X").collect()
    placed = wide_csv.read_wide(spark, rel, "X", origin="2024-03-01 00:00:00").orderBy("ts").collect()
    assert [(r.ts.second, r.ts.microsecond, r.value) for r in placed] == [(0, 0, 0.0), (12, 500000, 43.0)]
    folder = tmp_path / "mixed"
    folder.mkdir()
    write(folder, "1.csv", HEAT)
    write(folder, "2.csv", "2024-02-29 23:00:00-05:00,1,2\n")
    with pytest.raises(ValueError, match="no header line"):
        wide_csv.read_wide(spark, str(folder), "X")


def test_long_table_round_trip_is_partitioned(spark, tmp_path):
    long = wide_csv.read_wide(spark, write(tmp_path, "heat.csv", HEAT), "GPU_TEMP")
    out = str(tmp_path / "long")
    wide_csv.write_telemetry(long, out)
    assert spark.read.parquet(out).where("metric = 'GPU_TEMP' AND date = DATE '2024-03-01'").count() == 4


def test_sidecar_points_and_fingerprint(spark, tmp_path):
    data = write(tmp_path, "pai.csv", "a,1\nb,2\n")
    header = write(tmp_path, "pai.header", "job_name,status\n")
    assert tables.read_sidecar_csv(spark, data, header, {"status": "int"}).agg({"status": "sum"}).first()[0] == 3
    points = spark.createDataFrame([("n#0", "n", 0, 1.0, 60.0, 1)], "gpu string, node string, gpu_idx int, z_mean double, horizon_s double, label int")
    path = tables.write_points(points.select("z_mean", "label", "gpu", "node", "gpu_idx", "horizon_s"), str(tmp_path / "pts"))
    assert tables.read_points(spark, path).columns == ["gpu", "node", "gpu_idx", "horizon_s", "label", "z_mean"]
    import hashlib

    assert tables.file_fingerprint(spark, data).first()["dataset_sha256"] == hashlib.sha256(b"a,1\nb,2\n").hexdigest()
    states = {r.metric: r.state for r in tables.input_provenance(spark, {"here": data, "gone": str(tmp_path / "nope")}).collect()}
    assert states == {"here": "present", "gone": "absent"}
    badged = tables.first_available(spark, [(str(tmp_path / "nope"), "real"), (path, "fixture")])
    assert badged.first()["data_source"] == "fixture"
    assert tables.first_available(spark, [(str(tmp_path / "nope"), "real")]) is None


def test_window_stats_of_text_in_both_time_kinds(spark, tmp_path):
    rel = write(tmp_path, "rel.csv", "Time,a\n7,4\n8.5,6\n11,20\n30,1\n")
    got = wide_csv.text_window_stats(spark, rel, 9, 5).first()
    assert (got.samples, got["min"], got["mean"], got["max"]) == (3, 4.0, 10.0, 20.0)
    iso = write(tmp_path, "iso.csv", DRAW)
    got = wide_csv.text_window_stats(spark, iso, "2024-02-29 22:00:20-05:00", 40).first()
    assert (got.samples, got["max"]) == (3, 480.0)
    assert tuple(wide_csv.text_window_stats(spark, iso, "2031-01-01 00:00:00+00:00", 40).first()) == (0, 0.0, 0.0, 0.0)
    idle = write(tmp_path, "idle.csv", grid({"a-0": [None]}, step=0))
    assert wide_csv.text_window_stats(spark, idle, "2024-02-29 22:00:00-05:00", 40).first()["samples"] == 0
    wrong = write(tmp_path, "wrong.csv", "Time,a\nyesterday,5\n")
    for center in ("2024-02-29 22:00:00-05:00", 5):
        with pytest.raises(Exception, match="unparseable"):
            wide_csv.text_window_stats(spark, wrong, center, 40).collect()


def test_job_trace_header_is_fixed(spark, tmp_path):
    # fixed value: the trace's header line
    head = "job_id,user,node_num,gpu_num,cpu_num,mem_per_pod_GB,shared_mem_per_pod,type,state,submit_time,start_time,end_time,fail_time,stop_time,duration,queue,gpu_time"
    path = write(tmp_path, "jobs.csv", head + "\nj1,u,1,8,1,1,1,train,FAILED,a,b,c,2023-08-29 05:57:10+00:00,d,1,q,2\n")
    row = tables.read_jobs(spark, path).first()
    assert (row.job_id, row.state, row.fail_time, row.gpu_time) == ("j1", "FAILED", "2023-08-29 05:57:10+00:00", "2")


def test_byte_ranges_take_every_line_once_and_filters_reach_the_scan(spark, tmp_path):
    from fleetlens.sources.wide_source import register

    register(spark)
    folder = tmp_path / "src"
    folder.mkdir()
    lines = [f"2024-03-01T00:{i // 60:02d}:{i % 60:02d}Z,{i},{'' if i % 3 else i * 2}" for i in range(500)]
    write(folder, "a.csv", "Time,n-0,n-1\n" + "\n".join(lines) + "\n")
    write(folder, "b.csv", "Time,m-4\r\n" + "".join(f"{i}.5,{i}\r\n" for i in range(100)) + "\r\n100.5,7")  # no line end at last
    write(folder, "_hidden", "x")
    load = spark.read.format("widecsv").option("origin", "2024-03-01 00:00:00+00:00")
    whole = load.load(str(folder))
    want = sorted(map(str, whole.collect()))
    assert len(want) == 1101
    for size in (7, 100, 4096):
        cut = load.option("partitionBytes", size).load(str(folder))
        assert sorted(map(str, cut.collect())) == want
    some = whole.where("ts >= '2024-03-01 00:01:00' AND ts < '2024-03-01 00:01:10' AND gpu IN ('n#1', 'm#4') AND value IS NOT NULL")
    plain = [r for r in whole.collect() if 60 <= r.ts.minute * 60 + r.ts.second < 70 and r.gpu in ("n#1", "m#4") and r.value is not None]
    assert sorted(map(str, some.collect())) == sorted(map(str, plain)) and plain
    plan = some._jdf.queryExecution().executedPlan().toString()
    assert "Filter" not in plan.split("BatchScan")[0], plan
    assert whole.where("gpu = 'nobody'").count() == 0 and whole.where("value > 480").count() > 0
