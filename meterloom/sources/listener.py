"""Network listeners as a streaming source: UDP datagrams and TCP lines become rows in arrival order.

    spark.dataSource.register(ListenerSource)
    spark.readStream.format("meterloom_listener").option("udp_port", 8125).option("tcp_port", 8125).load()

Rows: seq, data (one UDP datagram, one TCP line or the whole binary messages of one read, as bytes), origin. A message that
comes in several reads waits for its rest; a connection that sends damaged binary messages is closed. A port of 0 turns a
listener off; pipe_port is one more TCP port, of this machine only, into which `feed` copies a handle such as standard
input. Sockets are bound by the
process that reads, on its first read, as Spark makes a source's objects several times. What is buffered there when the
process ends is lost: delivery is at most once until a batch is planned.
"""

from __future__ import annotations

import os
import selectors
import socket
import threading
import time
from collections.abc import Iterator
from typing import BinaryIO

from pyspark.sql.datasource import DataSource, SimpleDataSourceStreamReader

from meterloom.sources.binary import MAGIC, frame

DATAGRAM = 65_535


class _Listener:
    """Owns the sockets of one process and a thread that fills the buffer."""

    def __init__(self, address: str, udp_port: int, tcp_port: int, rcvbuf: int, pipe_port: int = 0):
        self.rows: list[tuple[int, bytes, str]] = []
        self.next = 0
        self.lock = threading.Lock()
        self.sel = selectors.DefaultSelector()
        self.tails: dict[int, bytes] = {}
        for host, port, kind in ((address, udp_port, socket.SOCK_DGRAM), (address, tcp_port, socket.SOCK_STREAM), ("127.0.0.1", pipe_port, socket.SOCK_STREAM)):
            if not port:
                continue
            family, kind_, proto, _, where = socket.getaddrinfo(host, port, type=kind, flags=socket.AI_PASSIVE)[0]
            s = socket.socket(family, kind_, proto)
            s.setsockopt(socket.SOL_SOCKET, socket.SO_REUSEADDR, 1)
            if family == socket.AF_INET6:
                s.setsockopt(socket.IPPROTO_IPV6, socket.IPV6_V6ONLY, 0)
            if kind == socket.SOCK_DGRAM and rcvbuf:
                s.setsockopt(socket.SOL_SOCKET, socket.SO_RCVBUF, rcvbuf)
            s.bind(where)
            if kind == socket.SOCK_STREAM:
                s.listen(64)
            s.setblocking(False)
            self.sel.register(s, selectors.EVENT_READ, "udp" if kind == socket.SOCK_DGRAM else "accept")
        threading.Thread(target=self._run, daemon=True).start()

    def _put(self, data: bytes, origin: str) -> None:
        with self.lock:
            self.rows.append((self.next, data, origin))
            self.next += 1

    def _run(self) -> None:
        while True:
            for key, _ in self.sel.select(1.0):
                s = key.fileobj
                try:
                    if key.data == "udp":
                        self._put(s.recv(DATAGRAM), "udp")
                    elif key.data == "accept":
                        c, _ = s.accept()
                        c.setblocking(False)
                        self.sel.register(c, selectors.EVENT_READ, "tcp")
                        self.tails[c.fileno()] = b""
                    else:
                        self._tcp(s)
                except OSError:
                    continue

    def _tcp(self, s: socket.socket) -> None:
        no = s.fileno()
        data = s.recv(1 << 16)
        if not data:
            return self._close(s)
        held = self.tails[no] + data
        if held[0] == MAGIC:
            _, taken, damaged = frame(held)
            if taken:
                self._put(held[:taken], "tcp")
            if damaged:
                return self._close(s)
            self.tails[no] = held[taken:]
            return
        *lines, tail = held.split(b"\n")
        for line in lines:
            self._put(line, "tcp")
        self.tails[no] = tail

    def _close(self, s: socket.socket) -> None:
        self.tails.pop(s.fileno(), None)
        self.sel.unregister(s)
        s.close()


def free_port() -> int:
    with socket.socket(socket.AF_INET, socket.SOCK_STREAM) as s:
        s.bind(("127.0.0.1", 0))
        return s.getsockname()[1]


def feed(handle: BinaryIO, port: int, patience: float = 120.0) -> None:
    """Copy a handle, as it is written to, into the listener on pipe_port; ends with the handle."""
    deadline = time.monotonic() + patience
    while True:
        try:
            s = socket.create_connection(("127.0.0.1", port), 5.0)
            break
        except OSError:
            # the listener binds on its first read
            if time.monotonic() > deadline:
                raise
            time.sleep(0.1)
    with s:
        s.settimeout(None)
        while data := os.read(handle.fileno(), 1 << 16):
            s.sendall(data)


_LISTENERS: dict[tuple, _Listener] = {}
_GUARD = threading.Lock()


class ListenerReader(SimpleDataSourceStreamReader):
    def __init__(self, options: dict):
        o = {k.lower(): v for k, v in options.items()}
        self.args = (o.get("bind_address", "::"), int(o.get("udp_port", 0)), int(o.get("tcp_port", 0)), int(o.get("udp_rcvbuf", 0)), int(o.get("pipe_port", 0)))
        self.wait = float(o.get("wait_seconds", 0.2))

    def _listener(self) -> _Listener:
        with _GUARD:
            if self.args not in _LISTENERS:
                _LISTENERS[self.args] = _Listener(*self.args)
            return _LISTENERS[self.args]

    def initialOffset(self) -> dict:
        return {"next": 0}

    def read(self, start: dict) -> tuple[Iterator[tuple], dict]:
        ls = self._listener()
        if ls.next <= start["next"]:
            time.sleep(self.wait)
        with ls.lock:
            rows = [r for r in ls.rows if r[0] >= start["next"]]
        return iter(rows), {"next": rows[-1][0] + 1 if rows else start["next"]}

    def readBetweenOffsets(self, start: dict, end: dict) -> Iterator[tuple]:
        # asked of a process without sockets, such as a task, for an empty range or one that was lost in a restart
        ls = _LISTENERS.get(self.args)
        if ls is None:
            return iter([])
        with ls.lock:
            return iter([r for r in ls.rows if start["next"] <= r[0] < end["next"]])

    def commit(self, end: dict) -> None:
        ls = self._listener()
        with ls.lock:
            ls.rows = [r for r in ls.rows if r[0] >= end["next"]]


class ListenerSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "meterloom_listener"

    def schema(self) -> str:
        return "seq bigint, data binary, origin string"

    def simpleStreamReader(self, schema) -> ListenerReader:
        return ListenerReader(self.options)
