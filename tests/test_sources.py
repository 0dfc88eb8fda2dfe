"""Tables, elementary streams and streaming audits on small files."""

from __future__ import annotations

import json
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from twinpath.sources import artifacts, elementary, recordings, synthetic, tables
from twinpath.streaming import audit


class Writer:
    def __init__(self):
        self.bits = ""

    def u(self, value, count):
        self.bits += format(value, f"0{count}b") if count else ""
        return self

    def ue(self, value):
        code = format(value + 1, "b")
        self.bits += "0" * (len(code) - 1) + code
        return self

    def payload(self, kind):
        bits = self.bits + "1"
        bits += "0" * (-len(bits) % 8)
        raw = int(bits, 2).to_bytes(len(bits) // 8, "big")
        escaped, zeros = bytearray(), 0
        for b in raw:
            if zeros >= 2 and b <= 3:
                escaped.append(3)
                zeros = 0
            escaped.append(b)
            zeros = zeros + 1 if b == 0 else 0
        return b"\x00\x00\x00\x01" + bytes([kind << 1, 1]) + bytes(escaped)


def stream(orders):
    sps = Writer().u(0, 4).u(0, 3).u(1, 1).u(0, 96).ue(0).ue(1).ue(1440).ue(1088).u(1, 1).ue(0).ue(0).ue(0).ue(4).ue(0).ue(0).ue(4)
    data = sps.payload(33) + Writer().ue(0).ue(0).u(0, 1).u(0, 1).u(0, 3).payload(34)
    for kind, slice_type, lsb in orders:
        header = Writer().u(1, 1)
        if kind in range(16, 24):
            header.u(0, 1)
        header.ue(0).ue(slice_type)
        if kind not in (19, 20):
            header.u(lsb, 8)
        data += header.u(0x55, 8).payload(kind)
    return data


def test_bits():
    b = elementary.Bits(bytes([0b10100110, 0b01000010]))
    assert [b.u(1), b.ue(), b.ue(), b.se()] == [1, 1, 2, 2]
    with pytest.raises(ValueError):
        elementary.Bits(b"").u(1)
    assert elementary.unescaped(b"\x00\x00\x03\x01") == b"\x00\x00\x01"


def test_pictures_in_display_order(spark, tmp_path):
    orders = [(19, 2, 0), (1, 0, 4), (1, 0, 2), (1, 0, 1), (1, 0, 3), (19, 2, 0), (1, 1, 250), (1, 1, 2)]
    (tmp_path / "a.h265").write_bytes(stream(orders))
    rows = elementary.pictures(spark, str(tmp_path)).orderBy("decode_index").collect()
    assert [r["poc"] for r in rows] == [0, 4, 2, 1, 3, 0, -6, 2]
    assert [r["slice_type"] for r in rows] == list("IBBBBIPP")
    assert (rows[0]["width"], rows[0]["height"], rows[0]["is_idr"]) == (1440, 1080, True)
    assert sum(r["units"] for r in elementary.unit_counts(spark, str(tmp_path)).collect()) == len(orders) + 2


@pytest.mark.parametrize("size", [1, 7, 64, 1 << 20])
def test_ranges_of_any_size_give_the_same_units(spark, tmp_path, size):
    """Start codes, escapes and runs of zeros lie across ranges; a parameter set is longer than a slice's head."""
    data = synthetic.stream(70) + b"\0" * 5 + synthetic.message_unit(700) + b"\0\0\0\1" + bytes([33 << 1, 1]) + bytes(range(1, 255)) * 3
    (tmp_path / "a b%20.h265").write_bytes(data)
    rows = [tuple(r) for r in elementary.unit_rows(spark, str(tmp_path), size).select("byte_offset", "byte_size", "head").orderBy("byte_offset").collect()]
    starts = [m.start() for m in re.finditer(rb"\x00\x00\x01", data)]
    whole = [data[a:b].rstrip(b"\0") if b < len(data) else data[a:b] for a, b in zip(starts, [*starts[1:], len(data)], strict=True)]
    assert [r[:2] for r in rows] == [(a, len(u)) for a, u in zip(starts, whole, strict=True)]
    assert all(bytes(r[2]) == u[3 : 3 + (elementary.SLICE_HEAD if u[3] >> 1 & 63 < 32 else len(u))] for r, u in zip(rows, whole, strict=True))
    assert elementary.sei_name(bytes(rows[-2][2])) == "type_700"


def test_layouts_and_versions(spark, tmp_path):
    root = str(tmp_path)
    (tmp_path / "runA").mkdir()
    (tmp_path / "runA" / "cam0_20_yuv420p_output.hevc").write_bytes(b"x")
    (tmp_path / "cam0_20_yuv420p_output (1).hevc").write_bytes(b"y")
    (tmp_path / "cam0_20_yuv420p_output.hevc.timestamps (1).txt").write_text("1\n2\n")
    assert recordings.source_path(spark, root, "runA", "cam0").endswith("/runA/cam0_20_yuv420p_output.hevc")
    assert recordings.source_path(spark, root, "runB", "cam0").endswith("/cam0_20_yuv420p_output (1).hevc")
    assert recordings.sidecar_path(spark, root, "runB", "cam0").endswith("timestamps (1).txt")
    assert not recordings.source_available(spark, root, "runA", "cam5")
    with pytest.raises(FileNotFoundError):
        recordings.source_path(spark, root, "runA", "cam5")
    with pytest.raises(ValueError):
        recordings.candidates(root, "runC", "cam0")
    with pytest.raises(FileNotFoundError):
        artifacts.load(spark, root, "masks", "v1")
    artifacts.stored(spark.range(3), root, "masks", "v1")
    assert artifacts.stored(spark.range(9), root, "masks", "v1").count() == 3
    assert artifacts.stored(spark.range(9), root, "masks", "v1", force=True).count() == 9
    assert artifacts.load(spark, root, "masks", "v1", {"speed": "double"}).columns == ["id", "speed"]


def test_refusals(spark, tmp_path):
    (tmp_path / "one.txt").write_text("5\n")
    with pytest.raises(Exception, match="too few timestamps"):
        tables.timestamps(spark, str(tmp_path / "one.txt")).collect()
    rows = spark.createDataFrame([(1, "a")], "k int, v string")
    assert tables.keyed(rows, rows, ["k"]).count() == 1
    with pytest.raises(Exception, match="wanted keys are not there"):
        tables.keyed(rows, spark.createDataFrame([(2,)], "k int"), ["k"]).collect()
    (tmp_path / "s.csv").write_text("run,camera,canonical_decoded_images\nrunA,cam0,5\n")
    assert tables.stream_counts(spark, str(tmp_path / "s.csv"), [("runA", "cam0")]).count() == 1
    with pytest.raises(Exception, match="unexpected or missing stream"):
        tables.stream_counts(spark, str(tmp_path / "s.csv"), [("runA", "cam0"), ("runA", "cam5")]).collect()
    (tmp_path / "a.rgb").write_bytes(bytes(60 * 3))
    with pytest.raises(Exception, match="more than 2 frames"):
        elementary.grey_frames(spark, str(tmp_path / "a.rgb"), 5, 4, capacity=2).collect()


def test_raw_frames(spark, tmp_path):
    frames = np.zeros((3, 4, 5, 3), np.uint8)
    frames[1] = 100
    (tmp_path / "a.rgb").write_bytes(frames.tobytes())
    rows = elementary.raw_frames(spark, str(tmp_path), 5, 4, stop_after=2).orderBy("ordinal").collect()
    assert [round(r["mean_luma"], 6) for r in rows] == [0.0, 100.0]


def test_mappings_of_three_kinds(spark, tmp_path):
    (tmp_path / "a.csv").write_text("camera,runA_frame,runB_frame,confidence,tier,status\ncam0,0,5,1.00,strong,accepted\ncam0,1,,0.00,,idle\n")
    (tmp_path / "b.csv").write_text("camera_id,runA_frame,predicted_runB_frame,status\ncam5,0,7,accepted\n")
    found = tables.mappings(spark, {"x": str(tmp_path / "a.csv"), "y": str(tmp_path / "b.csv")})
    rows = {(r["mapping"], r["runA_frame"]): (r["camera"], r["runB_frame"], r["status"], r["confidence"]) for r in found.collect()}
    assert rows == {("x", 0): ("cam0", 5, "accepted", 1.0), ("x", 1): ("cam0", None, "idle", 0.0), ("y", 0): ("cam5", 7, "accepted", None)}
    assert tables.complete_families(found).count() == 0


def test_small_sources(spark, tmp_path):
    (tmp_path / "t.txt").write_text("100\n\n300\n")
    assert [tuple(r) for r in tables.timestamps(spark, str(tmp_path / "t.txt")).collect()] == [(0, 100), (1, 300)]
    (tmp_path / "sums").write_text("ABCD  a/b c.csv\n")
    assert [tuple(r) for r in tables.checksums(spark, str(tmp_path / "sums")).collect()] == [("a/b c.csv", "abcd")]
    (tmp_path / "w.json").write_text(json.dumps({"waivers": [{"gate": "g", "reason": "r"}]}, indent=1))
    assert [tuple(r) for r in tables.waivers(spark, str(tmp_path / "w.json")).collect()] == [("g", "r")]
    (tmp_path / "m.json").write_text(json.dumps({"cameras": {"cam0": {"queries": [{"queryId": "q", "stratum": "dark"}]}}}))
    assert [tuple(r) for r in tables.strata(spark, str(tmp_path / "m.json")).collect()] == [("cam0", "q", "dark")]
    tables.write_json(spark, str(tmp_path / "o.json"), {"a": 1})
    assert json.loads((tmp_path / "o.json").read_text()) == {"a": 1}
    tables.write_csv(spark.createDataFrame([(1, None)], "b int, a string"), str(tmp_path / "out"), single=True)
    assert next((tmp_path / "out").glob("*.csv")).read_text() == "a,b\n,1\n"
    assert tables.file_digests(spark, str(tmp_path / "t.txt")).first()["bytes"] == 9


def streamed(spark, tmp_path, df):
    df.write.parquet(str(tmp_path / "in"))
    return spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))


def run(df, name):
    q = df.writeStream.format("memory").queryName(name).outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    return df.sparkSession.table(name).collect()


def test_streaming_windows_and_sessions(spark, tmp_path):
    rows = spark.range(0, 600).select(F.lit("s").alias("k"), F.timestamp_seconds(F.col("id")).alias("ts"))
    batch = audit.cadence(rows, ["k"], "ts").count()
    found = run(audit.cadence(streamed(spark, tmp_path, rows), ["k"], "ts", late="0 seconds"), "cadence")
    assert batch == 10 and len(found) >= 9 and all(r["frames"] == 60 for r in found)
    spikes = rows.filter(F.second("ts").isin(1, 3, 30))
    assert {r["members"] for r in audit.merged_events(spikes, ["k"], "ts", "4 seconds").collect()} == {1, 2}


def test_streaming_onset_equals_the_batch(spark, tmp_path):
    rows = spark.range(0, 40).select(F.lit("s").alias("k"), F.col("id").alias("o"), (F.col("id") >= 17).alias("a"))
    found = run(audit.sustained_onsets(streamed(spark, tmp_path, rows.coalesce(1)), "k", "o", "a"), "onsets")
    assert [(r["k"], r["onset"]) for r in found] == [("s", 13)]
