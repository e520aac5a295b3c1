import os
import socket
import threading
import time

from pyspark.sql import functions as F

from meterloom.config import EngineConfig
from meterloom.functions.protocol import parse_lines
from meterloom.operators import emit
from meterloom.sources import binary, listener, text
from meterloom.streaming import flush


def collecting(store):
    def sink(flushed, batch_id):
        store.append((batch_id, sorted(r.line.rsplit("|", 1)[0] for r in emit.text_records(flushed).select("line").collect())))

    return sink


def test_files_flushed_per_batch(spark, tmp_path):
    src, store = tmp_path / "in", []
    src.mkdir()
    (src / "1.txt").write_text("foo:1|c\nfoo:2|c\ng:5|g\n")
    run = lambda: flush.start_lines(text.stream_lines(spark, str(src)), EngineConfig(), collecting(store), str(tmp_path / "ck"), once=True).awaitTermination(60)
    assert run()
    (src / "2.txt").write_text("foo:10|c\ng:+1|g\njunk\n")
    assert run()
    assert [x for _, x in store] == [["counts.foo|3.000000", "gauges.g|5.000000"], ["counts.foo|10.000000", "gauges.g|1.000000"]]
    # nothing new: the final flush of an empty interval sends nothing
    assert run() and len(store) == 2


def test_replay_is_aligned(spark):
    rows = [(1, "2024-01-01 00:00:05", "a:1|c"), (2, "2024-01-01 00:00:09", "a:2|c"), (3, "2024-01-01 00:00:10", "a:4|c"), (4, "2024-01-01 00:00:11", "g:5|g"), (5, "2024-01-01 00:00:21", "g:+2|g")]
    df = spark.createDataFrame(rows, "seq bigint, t string, line string").withColumn("ts", F.to_timestamp("t")).drop("t")
    got = {(r.ts % 86400, r.key, r.value) for r in flush.replay(parse_lines(df), EngineConfig()).collect()}
    assert got == {(10, "counts.a", 3.0), (20, "counts.a", 4.0), (20, "gauges.g", 5.0), (30, "gauges.g", 2.0)}


def test_watermarked_windows(spark, tmp_path):
    path = str(tmp_path / "samples")
    rows = [("c", "a", 2.0, 0.5, "2024-01-01 00:00:01"), ("c", "a", 1.0, 1.0, "2024-01-01 00:00:02"), ("ms", "t", 5.0, 0.5, "2024-01-01 00:00:03"), ("c", "a", 1.0, 1.0, "2024-01-01 00:10:00")]
    df = spark.createDataFrame(rows, "type string, name string, value double, sample_rate double, t string").select("type", "name", "value", "sample_rate", F.to_timestamp("t").alias("ts"))
    df.write.parquet(path)
    s = spark.readStream.schema(df.schema).parquet(path)
    q = flush.windowed_counts(s, 10, "1 minute").writeStream.format("memory").queryName("windowed").outputMode("complete").start()
    q.processAllAvailable()
    q.stop()
    got = {(r.type, r.name, r.n, r["sum"]) for r in spark.table("windowed").collect()}
    assert got == {("c", "a", 2, 5.0), ("ms", "t", 1, 5.0), ("c", "a", 1, 1.0)}


def free_port(kind):
    with socket.socket(socket.AF_INET, kind) as s:
        s.bind(("127.0.0.1", 0))
        return s.getsockname()[1]


def test_listener_reads_both_protocols():
    udp, tcp = free_port(socket.SOCK_DGRAM), free_port(socket.SOCK_STREAM)
    reader = listener.ListenerReader({"udp_port": str(udp), "tcp_port": str(tcp), "bind_address": "127.0.0.1"})
    rows, end = reader.read(reader.initialOffset())
    assert list(rows) == [] and end == {"next": 0}
    with socket.socket(socket.AF_INET, socket.SOCK_DGRAM) as s:
        s.sendto(b"zip:100|c", ("127.0.0.1", udp))
    with socket.create_connection(("127.0.0.1", tcp)) as s:
        s.sendall(b"a:1|c\nb:2|")
        time.sleep(0.2)
        s.sendall(b"g\nunfinished")
        time.sleep(0.3)
        rows, end = reader.read({"next": 0})
    got = list(rows)
    assert {(d, o) for _, d, o in got} == {(b"zip:100|c", "udp"), (b"a:1|c", "tcp"), (b"b:2|g", "tcp")}
    assert list(reader.readBetweenOffsets({"next": 1}, end)) == got[1:]
    reader.commit(end)
    assert list(reader.readBetweenOffsets({"next": 0}, end)) == []


def test_listener_as_a_stream(spark, tmp_path):
    udp, store = free_port(socket.SOCK_DGRAM), []
    spark.dataSource.register(listener.ListenerSource)
    s = spark.readStream.format("meterloom_listener").option("udp_port", udp).option("bind_address", "127.0.0.1").load()
    lines = s.select(F.col("seq"), F.explode(F.split(F.decode("data", "UTF-8"), "\n")).alias("line"))
    q = flush.start(parse_lines(lines), EngineConfig(flush_interval=1), collecting(store), str(tmp_path / "ck"))
    try:
        deadline = time.time() + 40
        with socket.socket(socket.AF_INET, socket.SOCK_DGRAM) as out:
            while time.time() < deadline and not any(x for _, x in store):
                out.sendto(b"foo:1|c\nfoo:1|c", ("127.0.0.1", udp))
                time.sleep(0.5)
    finally:
        q.stop()
    assert any(x and x[0].startswith("counts.foo|") for _, x in store)


def test_chunks_of_both_protocols(spark, tmp_path):
    path, store = str(tmp_path / "chunks"), []
    rows = [(0, bytearray(b"a:1|c\ng:5|g")), (1, bytearray(binary.write_number(2, "a", 2.0) + binary.write_number(6, "g", -1.0))), (2, bytearray(b"\xaa\x09bad"))]
    df = spark.createDataFrame(rows, "seq bigint, data binary")
    df.write.parquet(path)
    q = flush.start_raw(spark.readStream.schema(df.schema).parquet(path), EngineConfig(), collecting(store), str(tmp_path / "ck"), once=True)
    assert q.awaitTermination(60)
    assert [x for _, x in store] == [["counts.a|3.000000", "gauges.g|4.000000"]]


def chunks_of(reader, wanted, seconds=20.0):
    """What a listener has got, once it is as many chunks as wanted."""
    rows, deadline = [], time.time() + seconds
    while len(rows) < wanted and time.time() < deadline:
        rows = list(reader.read({"next": 0})[0])
    return [bytes(d) for _, d, _ in rows]


def test_binary_messages_split_over_reads(spark):
    port = free_port(socket.SOCK_STREAM)
    reader = listener.ListenerReader({"tcp_port": str(port), "bind_address": "127.0.0.1"})
    reader.read(reader.initialOffset())
    messages = [binary.write_number(2, f"m{i}", float(i)) if i % 2 else binary.write_set("s", f"member{i}") for i in range(5)]
    data = b"".join(messages)
    for cut in range(1, len(data), 7):
        with socket.create_connection(("127.0.0.1", port)) as s:
            s.setsockopt(socket.IPPROTO_TCP, socket.TCP_NODELAY, 1)
            before = reader.read({"next": 0})[1]["next"]
            s.sendall(data[:cut])
            time.sleep(0.02)
            s.sendall(data[cut:])
            got, deadline = b"", time.time() + 10
            while got != data and time.time() < deadline:
                got = b"".join(bytes(d) for _, d, _ in reader.read({"next": before})[0])
        assert got == data, cut
    df = spark.createDataFrame([(0, bytearray(data))], "chunk_no bigint, data binary")
    assert binary.parse_mixed(df).count() == 5


def test_damaged_binary_messages_close_the_connection():
    port = free_port(socket.SOCK_STREAM)
    reader = listener.ListenerReader({"tcp_port": str(port), "bind_address": "127.0.0.1"})
    reader.read(reader.initialOffset())
    good = binary.write_number(2, "a", 1.0)
    with socket.create_connection(("127.0.0.1", port), 10) as s:
        s.sendall(good + b"\n" + good + b"\xaa\x09" + good)
        assert chunks_of(reader, 1) == [good + b"\n" + good]
        assert s.recv(1) == b""


def test_standard_input_is_one_more_connection():
    port = listener.free_port()
    reader = listener.ListenerReader({"pipe_port": str(port)})
    read, write = os.pipe()
    thread = threading.Thread(target=listener.feed, args=(os.fdopen(read, "rb"), port))
    thread.start()
    reader.read(reader.initialOffset())
    os.write(write, b"a:1|c\nb:2|")
    assert chunks_of(reader, 1) == [b"a:1|c"]
    os.write(write, b"g\n")
    assert chunks_of(reader, 2) == [b"a:1|c", b"b:2|g"]
    os.close(write)
    thread.join(10)
    assert not thread.is_alive()


def test_invalid_bytes_do_not_stop_a_batch(spark, tmp_path):
    path, store = str(tmp_path / "chunks"), []
    df = spark.createDataFrame([(0, bytearray(b"caf\xe9:1|c\n\xff\xfe\nok:2|c")), (1, bytearray(b"\xc3:x\xc3|s"))], "seq bigint, data binary")
    df.write.parquet(path)
    q = flush.start_raw(spark.readStream.schema(df.schema).parquet(path), EngineConfig(), collecting(store), str(tmp_path / "ck"), once=True)
    assert q.awaitTermination(60)
    assert [x for _, x in store] == [["counts.caf\ufffd|1.000000", "counts.ok|2.000000", "sets.\ufffd|1"]]
    assert text.split_datagrams(df.withColumnRenamed("seq", "chunk_no")).count() == 4


def test_inputs_are_counted_before_their_numbers_are_read(spark, tmp_path):
    src, store = tmp_path / "in", []
    src.mkdir()
    (src / "1.txt").write_text("a:1|c\na:x|c\nb:1e400|g\nc:1|ms|@zz\ns:m|s\njunk\nd:|c\n")
    cfg = EngineConfig(input_counter="inputs", quantiles=())
    assert flush.start_lines(text.stream_lines(spark, str(src)), cfg, collecting(store), str(tmp_path / "ck"), once=True).awaitTermination(60)
    assert [x for _, x in store] == [["counts.a|1.000000", "counts.inputs|5.000000", "sets.s|1"]]
    packed = binary.write_number(3, "t", float("nan")) + binary.write_number(2, "a", 1.0)
    df = spark.createDataFrame([(0, bytearray(packed))], "chunk_no bigint, data binary")
    assert [r.type for r in binary.parse_mixed(df, counted=True).orderBy("seq").collect()] == ["unusable", "c"] and binary.parse_mixed(df).count() == 1


def test_order_over_very_long_chunks(spark):
    n = (1 << 20) + 5
    df = spark.createDataFrame([(0, bytearray(b"\n" * n + b"g:5|g")), (1, bytearray(b"g:+1|g"))], "chunk_no bigint, data binary")
    got = {(r.key, r.value) for r in emit.flush(binary.parse_mixed(df), EngineConfig(), F.lit(1)).collect()}
    assert got == {("gauges.g", 6.0)}
