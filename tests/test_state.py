"""Growing files in ranges, and what selections leave behind."""

import os
import random

import pytest

from sitescore.operators import greedy, state
from sitescore.sources import fixtures
from sitescore.streaming import merge


@pytest.mark.parametrize("size", [1, 7, 64, 10_000])
def test_ranges_give_each_line_once(tmp_path, size):
    rng = random.Random(size)
    lines = [("x" * rng.randrange(40)).replace("xxx", "é") for _ in range(60)]
    text = "\n".join(lines).encode() + b"\n"
    (tmp_path / "a").write_bytes(text + b"no end yet")
    reader = merge.LinesReader({"path": str(tmp_path), "range": str(size)})
    end = reader.latestOffset()
    assert end == {"a": len(text)}
    begin = len("\n".join(lines[:5]).encode()) + 1
    pieces = reader.partitions({"a": begin}, end)
    assert len(pieces) == -(-(len(text) - begin) // size)
    assert [x for p in pieces for b in reader.read(p) for x in b.column(0).to_pylist()] == lines[5:]


def test_merge_by_ranges(spark, tmp_path):
    source = tmp_path / "in"
    source.mkdir()
    (source / "r0").write_text("".join(f"{i}.5\n" for i in range(300)))
    args = (spark, str(source), str(tmp_path / "out"), str(tmp_path / "checkpoint"), 50)
    merge.merge_rank_files_stream(*args)
    with (source / "r0").open("a") as f:
        f.write("1000.5\n1001.5\n")
    found = sorted(r[0] for r in merge.merge_rank_files_stream(*args).collect())
    assert found == [i + 0.5 for i in [*range(300), 1000, 1001]]


def folders(spark):
    root = state.shared_root(spark).removeprefix("file:")
    return {x for x in os.listdir(root) if x.startswith("rdd-")}


def test_selection_leaves_no_state(spark, sf):
    k = fixtures.k_matrix(spark, sf, 1)
    before, seen = folders(spark), []
    picks = greedy.greedy_select(k, 12, fixtures.R_SQ, k.ids.where("sensor_id < 40"), on_pick=lambda *_: seen.append(len(folders(spark) - before)))
    assert picks.count() == 12
    assert max(seen) <= 3
    assert folders(spark) == before
