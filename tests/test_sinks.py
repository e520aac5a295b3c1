import http.server
import json
import pickle
import struct
import threading

import pytest
from pyspark.sql import functions as F

from meterloom.config import EngineConfig
from meterloom.functions import protocol
from meterloom.operators import emit
from meterloom.sinks import command, marshal, measurements, payloads, state_table


def recs(spark, *rows):
    return payloads.records(spark.createDataFrame([(x,) for x in rows], "line string"))


def test_records_need_two_bars(spark):
    got = recs(spark, "a|1|2", "b|1", "c|1|2|3", "", "d|1|2")
    assert [r.key for r in got.collect()] == ["a", "d"]


def test_graphite(spark):
    x = payloads.graphite_lines(recs(spark, "a b//c$d.e|1.0|9", "é|2|9"), "app.")
    assert [r.line for r in x.collect()] == ["app.a_b-cd.e 1.0 9", "app. 2 9"]
    raw = payloads.graphite_lines(recs(spark, "a b|1|9"), normalize=False).first()
    assert raw.line == "a b 1 9"


def test_graphite_chunks(spark):
    x = payloads.graphite_lines(recs(spark, *[f"k{i}|{i}|7" for i in range(12)])).coalesce(1)
    a = payloads.graphite_line_chunks(x, 5).collect()
    assert [r.n for r in a] == [5, 5, 2] and a[2].payload == "k10 10 7\nk11 11 7\n"
    b = payloads.graphite_pickle_chunks(x, 5).collect()
    data = bytes(b[2].payload)
    assert struct.unpack("!L", data[:4])[0] == len(data) - 4
    assert pickle.loads(data[4:]) == [("k10", ("7", "10")), ("k11", ("7", "11"))]


def test_influx(spark):
    assert payloads.influx_lines(recs(spark, "a b=c,d#e|1.5|9"), "p").first().line == "p.a.b=c,d.e value=1.5 9"
    one = json.loads(payloads.influx_series(recs(spark, "a,b=c|1.5|9")).first().json)
    assert one == {"name": "a.b.c", "columns": ["value", "time"], "points": [[1.5, 9.0]]}
    assert [payloads.influx_uses_lines(v) for v in ("0.8", "0.9", "0.9.0", "0.10", "1.0", "0.8.9")] == [False, True, True, True, True, False]


def test_opentsdb(spark):
    x = payloads.opentsdb_puts(recs(spark, "web._t_host.a1._t_dc.x.hits|3|9", "plain|1|2", "a._t_x|1|2"), "_t_")
    assert [r.line for r in x.collect()] == ["put web.hits 9 3 host=a1 dc=x source=statsd", "put plain 2 1 source=statsd", "put a 2 1 source=statsd"]


def test_cloudwatch(spark):
    x = payloads.cloudwatch_metrics(recs(spark, "ns:lat:host=a:az=b|1.5|9", "ns:lat|2|9", "nocolon|1|9", ":x|1|9")).collect()
    assert json.loads(x[0].json) == [{"MetricName": "lat", "Value": 1.5, "Timestamp": 9, "Dimensions": [{"Name": "host", "Value": "a"}, {"Name": "az", "Value": "b"}]}]
    assert [(r.namespace, r.name, len(r.dimensions)) for r in x] == [("ns", "lat", 2), ("ns", "lat", 0)]


def test_http(spark):
    got = json.loads(payloads.http_json(recs(spark, "kiln.load|31|1650000000", "kiln.heat|640|1650000007").coalesce(1)).first().payload)
    assert got == {"metrics": [{"key": "kiln.load", "value": "31", "timestamp": "1650000000"}, {"key": "kiln.heat", "value": "640", "timestamp": "1650000007"}]}


def test_ganglia(spark):
    kinds = {"1": "uint16", "65536": "uint32", "-1": "int16", "-40000": "int32", "1.000000": "string", "": None, "4294967296": None, "-2147483649": None}
    df = spark.createDataFrame(list(kinds.items()), "v string, want string")
    assert all(r.want == r.got for r in df.select("want", payloads.metric_type(F.col("v")).alias("got")).collect())
    meta, data = payloads.ganglia_packets("abc", "1", "uint16", group="g")
    assert meta[:4] == struct.pack(">i", 128) and data[:4] == struct.pack(">i", 133) and len(meta) % 4 == len(data) % 4 == 0
    assert b"GROUP" in meta and data.endswith(struct.pack(">I", 1) + b"1\0\0\0")
    with pytest.raises(ValueError):
        payloads.ganglia_packets("", "1", "uint16")
    assert payloads.ganglia(recs(spark, "a|5|1", "b||1")).count() == 1


def test_deliver_over_http(spark):
    got = []

    class H(http.server.BaseHTTPRequestHandler):
        def do_POST(self):
            got.append(json.loads(self.rfile.read(int(self.headers["Content-Length"]))))
            self.send_response(200)
            self.end_headers()

        def log_message(self, *a):
            pass

    server = http.server.HTTPServer(("127.0.0.1", 0), H)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    payloads.deliver(payloads.http_json(recs(spark, "a|1|2")), "payload", payloads.http_sender(f"http://127.0.0.1:{server.server_port}/"))
    server.shutdown()
    assert got == [{"metrics": [{"key": "a", "value": "1", "timestamp": "2"}]}]


def folded(spark, *rows, **options):
    x = measurements.measurements(measurements.parse_names(recs(spark, *rows), **options))
    out = []
    for r in x.collect():
        d = {k: v for k, v in r.asDict().items() if v is not None and k not in ("tags", "source")}
        out.append(d | {"tags": {t.key: t.value for t in r.tags}} | ({"source": r.source} if r.source else {}))
    return sorted(out, key=str)


def test_pivot(spark):
    stats = {"sum": 90.5, "mean": 30.2, "lower": 11, "upper": 48.25, "count": 3, "sum_sq": 7}
    got = folded(spark, *[f"timers.oven.bake.{s}|{v}|1650000600" for s, v in stats.items()])
    assert got == [{"name": "oven.bake", "time": 1650000600, "min": 11.0, "max": 48.25, "sum": 90.5, "count": 3.0, "tags": {}}]
    assert folded(spark, "timers.oven.stdev|0.75|3")[0]["stddev_m2"] == 0.75


def test_tags(spark):
    assert folded(spark, "counts.belt.stops#line=7,shift=night|4|12") == [{"name": "belt.stops", "time": 12, "value": 4.0, "tags": {"line": "7", "shift": "night"}}]
    assert folded(spark, "timers.belt#hall=east,rig=b2.p75|6.5|12") == [{"name": "belt.p75", "time": 12, "value": 6.5, "tags": {"hall": "east", "rig": "b2"}}]
    assert folded(spark, "timers.belt#hall=east,rig=b2.left.p75|6.5|12")[0]["tags"] == {"hall": "east", "rig": "b2.left"}
    assert len(folded(spark, "counts.r#a=1|1|9", "counts.r#a=2|1|9", "counts.r#a=3|1|9")) == 3


def test_source_and_floor(spark):
    got = folded(spark, "counts.mill.hall.east.jams|2|100", source_regex=r"\.hall\.(\w+)", floor_seconds=40)
    assert got == [{"name": "mill.jams", "source": "east", "time": 80, "value": 2.0, "tags": {"source": "east"}}]
    got = folded(spark, "gauges.rig_4.torque|7|12", source_regex=r"^(rig_\d)\.", source_prefix="plant", prefix="all")
    assert (got[0]["name"], got[0]["source"]) == ("all.torque", "plant.rig_4")


def test_extended_counters_fold(spark):
    got = folded(spark, "counts.x.count|3|9", "counts.x.rate|0.5|9", extended_counters=True)
    assert got == [{"name": "x", "time": 9, "count": 3.0, "tags": {}}, {"name": "x.rate", "time": 9, "value": 0.5, "tags": {}}]


def test_legacy_names_are_cut(spark):
    p = measurements.parse_names(recs(spark, f"counts.{'n' * 300}|1|9"), source="s" * 300)
    r = measurements.legacy_gauges(p).first()
    assert len(r.name) == len(r.source) == 255


def test_measurement_payload(spark):
    m = measurements.measurements(measurements.parse_names(recs(spark, "counts.a#x=1|2|9")))
    got = json.loads(measurements.payloads(m, host="h1", tags={"k": "v"}).first().payload)
    assert got == {"measurements": [{"name": "a", "tags": {"x": "1"}, "time": 9, "value": 2.0}], "tags": {"k": "v", "host": "h1"}}


def test_state_merge(spark):
    schema = "ts bigint, type int, value_type int, key string, value double"
    old = state_table.collect_state(spark.createDataFrame([(1, 2, 1, "c", 5.0), (1, 2, 4, "c", 2.0), (1, 3, 6, "t", 1.0), (1, 1, 0, "only", 9.0), (1, 2, 6, "c", 1.0)], schema))
    new = state_table.collect_state(spark.createDataFrame([(2, 2, 1, "c", 7.0), (2, 3, 6, "t", 4.0), (2, 3, 178, "t", 3.0), (2, 2, 6, "c", 3.0)], schema))
    got = {r.key: r for r in state_table.merge_state(old, new).collect()}
    assert (got["c"]["sum"], got["c"]["count"], got["c"]["min"], got["c"]["max"], got["c"].ts) == (12.0, 2.0, 1.0, None, 2)
    again = state_table.collect_state(spark.createDataFrame([(2, 3, 178, "t", 3.0), (3, 3, 178, "t", 8.0), (3, 3, 223, "t", 9.0), (1, 3, 178, "t", 1.0)], schema)).first()
    assert again.percentiles == {"50": 8.0, "95": 9.0} and again.ts == 3 and again.type == "timer"
    assert got["t"]["min"] == 4.0 and got["t"].percentiles == {"50": 3.0} and got["only"].kv == 9.0


def test_command_sink(spark, tmp_path):
    s = protocol.parse_lines(spark.createDataFrame([(1, "a:1|c"), (2, "b:2|g")], "seq bigint, line string"))
    flushed = emit.flush(s, EngineConfig(), F.lit(7))
    out = tmp_path / "out"
    assert command.command_sink(EngineConfig(stream_cmd=f"cat > {out}"))(flushed, 0) == 0
    assert out.read_text() == "counts.a|1.000000|7\ngauges.b|2.000000|7\n"
    assert command.command_sink(EngineConfig(stream_cmd="exit 3"))(flushed, 1) == 3
    assert command.command_sink(EngineConfig(stream_cmd="head -c 1 > /dev/null"))(flushed, 2) == 0
    assert command.command_sink(EngineConfig(stream_cmd="/no/such/program"))(flushed, 3) != 0
    binary_cfg = EngineConfig(stream_cmd=f"cat > {out}", binary_stream=True)
    assert command.command_sink(binary_cfg)(emit.flush(s, binary_cfg, F.lit(7), binary=True), 4) == 0
    assert len(out.read_bytes()) == 3 * 20 + 6


def test_marshal_round_trip():
    value = {"a": 1, "é": {"x": 1.5, "y": None, "z": True}, "n": [0, 1, 122, 123, 255, 256, -1, -123, -124, -256, -257, 65536, 2**30 - 1, -(2**30)], "big": 2**40, "neg": -(2**70), "inf": float("inf")}
    value["n"] = {str(i): n for i, n in enumerate(value["n"])}
    assert marshal.loads(marshal.dumps(value)) == value
    # as the other side writes it: {"a" => 1}, {:s => 1.5, "t" => the same float again}
    assert marshal.dumps({"a": 1}) == b'\x04\x08{\x06I"\x06a\x06:\x06ETi\x06'
    assert marshal.dumps(300) == b"\x04\x08i\x02,\x01" and marshal.dumps(-129) == b"\x04\x08i\xff\x7f"
    assert marshal.loads(b'\x04\x08{\x07:\x06sf\x081.5I"\x06t\x06:\x06ET@\x06') == {"s": 1.5, "t": 1.5}
    with pytest.raises(ValueError):
        marshal.loads(b"\x04\x08[\0")
    with pytest.raises(ValueError):
        marshal.loads(b"\x04\x08{\x06")


def test_state_as_yaml_and_marshal(spark):
    schema = "ts bigint, type int, value_type int, key string, value double"
    rows = [(5, 3, 178, "t \"q\": {", 3.0), (5, 3, 133, "t \"q\": {", 0.25), (5, 3, 6, "t \"q\": {", 1.0), (6, 2, 1, "zähler", 7.5), (6, 1, 0, "k", -1e300)]
    state = state_table.collect_state(spark.createDataFrame(rows, schema))
    want = sorted(map(str, state.collect()))
    lines = state_table.yaml_lines(state)
    assert [r.value for r in lines.where("value like '%ähler%'").collect()] == ['"zähler": {"ts": 6, "type": "counter", "sum": 7.5}']
    assert sorted(map(str, state_table.read_yaml_lines(lines).collect())) == want
    packed = state_table.marshal_payloads(state.coalesce(1), 2)
    assert sorted(r.n for r in packed.collect()) == [1, 2]
    assert sorted(map(str, state_table.read_marshal(packed).collect())) == want
    assert marshal.loads(bytes(state_table.marshal_payloads(state.where("key = 't \"q\": {'")).first().payload)) == {"t \"q\": {": {"ts": 5, "type": "timer", "min": 1.0, "P05": 0.25, "P50": 3.0}}
    assert state_table.read_marshal(state_table.marshal_payloads(state.limit(0))).count() == 0


def test_state_versions(spark, tmp_path):
    schema = "ts bigint, type int, value_type int, key string, value double"
    path = str(tmp_path / "state")
    assert state_table.load_state(spark, path) is None
    for kind in ("json", "parquet", "yaml"):
        where = f"{path}-{kind}"
        for ts, v in ((1, 5.0), (2, 7.0)):
            new = state_table.collect_state(spark.createDataFrame([(ts, 2, 1, "c", v), (ts, 3, 178, "t", v)], schema))
            assert state_table.update_state(new, where, kind) == ts
        got = {r.key: r for r in state_table.load_state(spark, where, kind).collect()}
        assert got["c"]["sum"] == 12.0 and got["t"].percentiles == {"50": 7.0}
        assert {r.key: r["sum"] for r in state_table.load_state(spark, where, kind, 1).collect()}["c"] == 5.0
