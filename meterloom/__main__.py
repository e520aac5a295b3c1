"""Run the engine as a service: python -m meterloom -f CONFIG [-c CHECKPOINT_DIR]

Listens on the configured ports, and to standard input if parse_stdin is set, flushes every interval into the flush
command, and flushes what is left when it is told to stop. The end of standard input does not stop it.
"""

from __future__ import annotations

import argparse
import signal
import sys
import threading
import uuid

from pyspark.sql import SparkSession

from meterloom.config import EngineConfig, load_ini
from meterloom.sinks.command import command_sink
from meterloom.sources.listener import ListenerSource, feed, free_port
from meterloom.session import checkpoint_dir
from meterloom.streaming import flush


def main(argv: list[str]) -> int:
    p = argparse.ArgumentParser(prog="meterloom", description=__doc__.splitlines()[0])
    p.add_argument("-f", dest="config", help="INI file; defaults hold without one")
    p.add_argument("-c", dest="checkpoint", help="folder for the stream's progress")
    p.add_argument("-v", dest="version", action="store_true", help="print the version")
    a = p.parse_args(argv)
    if a.version:
        print("meterloom 0.1")
        return 0
    cfg = load_ini(a.config) if a.config else EngineConfig()
    spark = SparkSession.builder.appName("meterloom").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    sink = command_sink(cfg)
    spark.dataSource.register(ListenerSource)
    options = {"bind_address": cfg.bind_address, "udp_port": cfg.udp_port, "tcp_port": cfg.tcp_port, "udp_rcvbuf": cfg.udp_rcvbuf}
    if cfg.parse_stdin:
        options["pipe_port"] = free_port()
        threading.Thread(target=feed, args=(sys.stdin.buffer, options["pipe_port"]), daemon=True).start()
    chunks = spark.readStream.format(ListenerSource.name()).options(**options).load()
    checkpoint = a.checkpoint or f"{checkpoint_dir(spark)}/service-{uuid.uuid4().hex}"
    query = flush.start_raw(chunks, cfg, sink, checkpoint)
    stop = threading.Event()
    for s in (signal.SIGINT, signal.SIGTERM):
        signal.signal(s, lambda *_: stop.set())
    while query.isActive and not stop.wait(1.0):
        pass
    query.processAllAvailable()
    query.stop()
    return 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
