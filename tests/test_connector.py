"""The data source of lines: splits, offsets, and micro-batches recorded once."""

import glob
import os

import pytest
from pyarrow import fs

from bookloom.sources import connector

LINES = ["", "a", "é" * 40, "", "x" * 300, "{}", "last"]


def put(path, text, mode="w"):
    path.parent.mkdir(exist_ok=True)
    with open(path, mode, encoding="utf-8", newline="") as f:
        f.write(text)


@pytest.mark.parametrize("split", [7, 100, 1 << 20])
def test_every_split_gives_every_line_once(spark, tmp_path, split):
    connector.register(spark)
    put(tmp_path / "in" / "a.jsonl", "\n".join(LINES))
    put(tmp_path / "in" / "b.jsonl", "\n".join(LINES) + "\n")
    put(tmp_path / "in" / "_c", "hidden\n")
    put(tmp_path / "in" / "d.jsonl", "")
    rows = spark.read.format(connector.NAME).option("path", str(tmp_path / "in")).option("split", split).load().coalesce(4).orderBy("file", "offset").collect()
    assert [(r.file, r.value) for r in rows] == [(f, x) for f in ("a.jsonl", "b.jsonl") for x in LINES]
    raw = "\n".join(LINES).encode()
    assert all(raw[r.offset : r.offset + len(r.value.encode())] == r.value.encode() for r in rows)


def test_a_folder_of_no_files(spark, tmp_path):
    connector.register(spark)
    assert spark.read.format(connector.NAME).option("path", str(tmp_path / "none")).load().count() == 0


def test_a_stream_that_dies_records_each_row_once(spark, tmp_path):
    connector.register(spark)
    source, sink, log = tmp_path / "in", tmp_path / "out", tmp_path / "log"

    def run():
        rows = spark.readStream.format(connector.NAME).option("path", str(source)).option("split", 20).load().select("value")
        q = rows.writeStream.format(connector.NAME).option("path", str(sink)).option("checkpointLocation", str(log)).start()
        try:
            q.processAllAvailable()
        finally:
            q.stop()

    def recorded():
        return sorted(r.value for r in spark.read.format(connector.NAME).option("path", str(sink)).load().collect())

    expected = [f"row {i}" for i in range(30)]
    put(source / "1.jsonl", "".join(f"{x}\n" for x in expected) + "row 3")
    run()
    assert recorded() == sorted(expected)  # the line without an end waits
    put(source / "1.jsonl", "0\n", "a")
    put(source / "2.jsonl", "row 31\nrow 32\n")
    run()
    expected += ["row 30", "row 31", "row 32"]
    assert recorded() == sorted(expected)
    # As if the query had died after the sink's manifest and before Spark's log of the batch: it runs again.
    last = max(glob.glob(str(log / "commits" / "[0-9]*")), key=lambda p: int(os.path.basename(p)))
    os.remove(last)
    for crc in glob.glob(str(log / "commits" / ".*.crc")):
        os.remove(crc)
    files = len(glob.glob(str(sink / "part-*")))
    put(source / "3.jsonl", "row 33\n")
    run()
    assert recorded() == sorted([*expected, "row 33"])
    assert len(glob.glob(str(sink / "part-*"))) == files + 1  # what the batch wrote again is gone


def test_ranges_of_a_byte(tmp_path):
    """Each place of a text as a range of its own: the line that begins there, or none."""
    raw = "\n".join([*LINES, ""]).encode()
    (tmp_path / "a").write_bytes(raw)
    with fs.LocalFileSystem().open_input_file(str(tmp_path / "a")) as f:
        found = [x for i in range(len(raw)) for x in connector.lines(f, i, i + 1)]
    assert [v.decode() for _, v in found] == LINES and len({a for a, _ in found}) == len(LINES)


def test_files_without_a_manifest_are_no_rows(tmp_path):
    w = connector.StreamWriter({"path": str(tmp_path)})
    kept, lost = w.write(iter([("a",)])), w.write(iter([("b",)]))
    w.commit([kept, connector.Written(None), None], 0)
    assert connector.manifests(str(tmp_path)) == [kept.file] and lost.file in connector.sizes(str(tmp_path))
    again = w.write(iter([("a",)]))
    w.commit([again], 0)
    assert connector.manifests(str(tmp_path)) == [kept.file] and again.file not in connector.sizes(str(tmp_path))
    with pytest.raises(ValueError):
        w.write(iter([("a\nb",)]))
    with pytest.raises(ValueError):
        connector.StreamReader({"path": str(tmp_path)}).latestOffset()
