"""Following growing log files: between triggers, over renames and cuts, and in ranges."""

import json
import os

import pytest

from recordloom.streaming import flows, tail


def put(path, text, mode="ab"):
    with open(path, mode) as f:
        f.write(text.encode())


def lines_between(folder, start, end):
    return [(os.path.basename(s.path), at, line.decode()) for s in tail.new_spans(str(folder), start, end) for at, line in tail.read_span(s)]


def test_offsets_over_growth_renames_and_cuts(tmp_path, monkeypatch):
    monkeypatch.setattr(tail, "CHUNK", 4)
    a = tmp_path / "a.log"
    put(a, "one\ntwo\r\npart")
    put(tmp_path / ".hidden", "no\n")
    zero = {"files": {}}
    first = {"files": tail.scan(str(tmp_path))}
    assert lines_between(tmp_path, zero, first) == [("a.log", 0, "one"), ("a.log", 4, "two")]
    put(a, "ial\n\nsix\n")
    second = {"files": tail.scan(str(tmp_path))}
    assert lines_between(tmp_path, first, second) == [("a.log", 9, "partial"), ("a.log", 17, ""), ("a.log", 18, "six")]
    assert lines_between(tmp_path, second, second) == []
    # Renamed, and another file under the old name.
    os.rename(a, tmp_path / "a.1")
    put(tmp_path / "a.1", "late\n")
    put(a, "new\n")
    third = {"files": tail.scan(str(tmp_path))}
    assert sorted(lines_between(tmp_path, second, third)) == [("a.1", 22, "late"), ("a.log", 0, "new")]
    # Cut and written anew: shorter first, then longer but with another beginning.
    put(a, "x\n", "wb")
    fourth = {"files": tail.scan(str(tmp_path))}
    assert lines_between(tmp_path, third, fourth) == [("a.log", 0, "x")]
    put(a, "yy\nzz\n", "wb")
    fifth = {"files": tail.scan(str(tmp_path))}
    assert lines_between(tmp_path, fourth, fifth) == [("a.log", 0, "yy"), ("a.log", 3, "zz")]
    # An offset is a JSON object, as the checkpoint keeps it.
    assert json.loads(json.dumps(fifth)) == fifth


@pytest.mark.parametrize("size", [1, 3, 7, 64])
def test_ranges_hold_every_line_once(tmp_path, monkeypatch, size):
    monkeypatch.setattr(tail, "RANGE", size)
    text = "".join("x" * (i % 9) + f"{i}\n" for i in range(60))
    put(tmp_path / "a", text + "open")
    got = lines_between(tmp_path, {"files": {}}, {"files": tail.scan(str(tmp_path))})
    assert [x for _, _, x in got] == text.split("\n")[:-1]


def entry(i):
    return json.dumps({"timestamp": "t", "level": "info", "service": "s", "message": str(i), "n": i})


def test_growing_log_stream_loses_and_repeats_nothing(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    put(folder / "a.log", entry(-1) + "\n")
    got, fail = [], []

    def deliver(batch, batch_id):
        rows = [int(r.message) for r in batch.collect()]
        if fail:
            raise RuntimeError("sink is down")
        got.extend(rows)

    def drain():
        flows.stream_log_growing(spark, str(folder), str(tmp_path / "ckpt"), deliver, interval=None).awaitTermination()

    drain()  # begins at the current end
    assert got == []
    for step in range(3):
        put(folder / "a.log", f"{entry(10 * step)}\n \n{entry(10 * step + 1)}"[: None if step else -4])
        if step == 0:
            put(folder / "b.log", f"{entry(100)}\n")
        drain()
        if step == 0:
            assert sorted(got) == [0, 100]
            put(folder / "a.log", entry(1)[-4:])
        put(folder / "a.log", "\n")
    fail.append(1)
    with pytest.raises(Exception, match="sink is down"):
        drain()
    fail.clear()
    drain()
    assert sorted(got) == [0, 1, 10, 11, 20, 21, 100]
    os.rename(folder / "a.log", folder / "a.log.1")
    put(folder / "a.log", f"{entry(30)}\n")
    drain()
    assert sorted(got) == [0, 1, 10, 11, 20, 21, 30, 100]
