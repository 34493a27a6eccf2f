"""Files as other tools write them, in one split and in many."""

import json
import math
import random

import pytest
from pyspark.errors import PySparkException

from sitescore.sources import pieces, records

SPLITS = (1 << 27, 700, 90)


@pytest.fixture(params=SPLITS)
def split(spark, request):
    names = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes", "spark.sql.files.minPartitionNum")
    before = {n: spark.conf.get(n, None) for n in names}
    for n, v in zip(names, (request.param, 1, 1), strict=True):
        spark.conf.set(n, v)
    yield request.param
    for n, v in before.items():
        spark.conf.unset(n) if v is None else spark.conf.set(n, v)


TEXTS = ['plain', 'a "quoted" one', "braces } ] { [", "back\\slash", 'ends with \\', '\\"', "ä漢\U0001f600", "colon: , comma", '"}', ""]


def events(n, seed=0):
    rng = random.Random(seed)
    return [{"lane": rng.choice(["io", "gpu"]), "name": rng.choice(TEXTS), "start_ms": rng.random() * 100, "dur_ms": 1.5, "candidate": i, "buffer": None if i % 3 else 1, "note": {"deep": [{"x": rng.choice(TEXTS)}, [1, {"y": {}}]]}} for i in range(n)]


def written(folder, name, text):
    folder.mkdir(exist_ok=True)
    (folder / name).write_text(text, encoding="utf-8")


def timelines(folder):
    docs = [{"format": "pipelined_timeline_v1", "events": events(9, 1), "start_candidate": 3}, {"format": "pipelined_timeline_v2", "meta": {"events": [{"lane": "no"}]}, "list": [{"lane": "no"}, [{"lane": "no"}]], "events": events(5, 2)}, {"events": events(3, 3), "format": "pipelined_timeline_v1"}, {"format": "pipelined_timeline_v1", "events": []}]
    written(folder, "a.json", json.dumps(docs[0], indent=2))
    written(folder, "b.json", json.dumps(docs[1]) + "\n")
    written(folder, "c.json", "\n".join(json.dumps(d, ensure_ascii=False) for d in docs[2:]) + "\n\n" + json.dumps(docs[0], indent=4))
    other = {"deviceProperties": [{"name": "no", "ph": "X", "ts": 0, "dur": 0}], "traceEvents": [{"name": t, "ph": "X", "ts": float(i), "dur": 2, "args": {"a": {"b": t}}} for i, t in enumerate(TEXTS)], "tail": [{"name": "no"}]}
    written(folder, "d.json", json.dumps(other, indent=1))
    written(folder, "e.json", json.dumps(other))
    want = [e for d in (docs[0], docs[1], docs[2], docs[0]) for e in d["events"]]
    return want, other["traceEvents"] * 2


def test_timelines_and_traces(spark, tmp_path, split):
    want, traces = timelines(tmp_path / "t")
    got = records.read_timeline(spark, str(tmp_path / "t")).drop("trace_file").collect()
    plain = lambda rows: sorted(map(repr, rows))
    assert plain(tuple(r) for r in got) == plain((e["lane"], e["name"], e["start_ms"], e["dur_ms"], e["candidate"], e["buffer"]) for e in want)
    got = records.read_profiler_trace(spark, str(tmp_path / "t")).collect()
    assert plain(tuple(r) for r in got) == plain((e["name"], e["ph"], e["ts"], float(e["dur"])) for e in traces)
    files = pieces.JsonFiles(spark, str(tmp_path / "t"), 1)
    assert files.objects().count() == 7


def test_breakdowns(spark, tmp_path, split):
    docs = [{"format": "candidate_breakdown_v1", "candidate": i, "io_ms": {"read }": 1.0 + i}, "gpu_ms": {"trsm": 2.0, 'q"': 3.0}} for i in range(6)]
    for i in range(3):
        written(tmp_path / "b", f"{i}.json", json.dumps(docs[i], indent=2))
    written(tmp_path / "b", "9.json", "".join(json.dumps(d) + "\n" for d in docs[3:]))
    got = records.read_breakdown(spark, str(tmp_path / "b")).collect()
    assert sorted(map(tuple, got)) == sorted((i, *x) for i in range(6) for x in (("io", "read }", 1.0 + i), ("gpu", "trsm", 2.0), ("gpu", 'q"', 3.0)))


@pytest.mark.parametrize("text", ['{"format": "other", "events": [{"lane": "io"}]}', "[1, 2]", "no json", '[{"traceEvents": [{"name": "x"}]}]'])
def test_other_formats_are_errors(spark, tmp_path, text):
    written(tmp_path / "x", "a.json", text)
    with pytest.raises(PySparkException):
        records.read_timeline(spark, str(tmp_path / "x")).collect()


def test_cut_off_files_are_errors(spark, tmp_path, split):
    written(tmp_path / "x", "a.json", json.dumps({"format": "pipelined_timeline_v1", "events": events(20)}, indent=2)[:-300])
    with pytest.raises(ValueError):
        records.read_timeline(spark, str(tmp_path / "x"))


def test_coordinates_without_ids(spark, tmp_path, split):
    rows = [(-128 + 0.25 * i, 40 + i / 7) for i in range(150)]
    for name, own in (("a.csv", rows[:100]), ("b.csv", rows[100:])):
        written(tmp_path / "c", name, "lon,lat\n" + "".join(f"{x!r}, {y!r}\r\n" if i % 2 else f"{x!r},{y!r}\n" for i, (x, y) in enumerate(own)) + "\n")
    got = sorted(map(tuple, records.read_coords(spark, str(tmp_path / "c")).collect()))
    assert got == [(i, x, y) for i, (x, y) in enumerate(rows)]


def test_coordinates_with_ids_and_wrong_headers(spark, tmp_path):
    written(tmp_path / "c", "a.csv", "lat, lon,sensor_id\n40.0,-128.0,7\n")
    assert [tuple(r) for r in records.read_coords(spark, str(tmp_path / "c")).collect()] == [(7, -128.0, 40.0)]
    written(tmp_path / "d", "a.csv", "a,b,c\n1,2,3\n")
    with pytest.raises(ValueError):
        records.read_coords(spark, str(tmp_path / "d"))


def test_line_numbers(spark, tmp_path, split):
    written(tmp_path / "n", "a.txt", "\n\nh1\nh2\n" + "\n".join(f"line {i}" for i in range(60)))
    written(tmp_path / "n", "b.txt", "h1\n")
    written(tmp_path / "n", "c.txt", "h1\nh2\n\nlast")
    got = sorted(map(tuple, pieces.numbered_lines(spark, str(tmp_path / "n"), 2).collect()))
    assert got == [*((i, f"line {i}") for i in range(60)), (60, "last")]


def test_ablation_files(spark, tmp_path):
    written(tmp_path / "m", "a.csv", "k,mem_N_OOP,time_N_OOP\n10,1.5e+02,nan\n20.0,NaN,\n")
    a, b = records.read_ablation(spark, str(tmp_path / "m")).collect()
    assert a["k"] == 10 and a["mem_N_OOP"] == 150.0 and math.isnan(a["time_N_OOP"]) and b["k"] == 20 and math.isnan(b["mem_N_OOP"]) and math.isnan(b["time_N_OOP"])
