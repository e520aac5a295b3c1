"""The flush command: a program that gets all records of a flush on its standard input."""

from __future__ import annotations

import logging
import subprocess
from collections.abc import Callable

from pyspark.sql import DataFrame

from meterloom.config import EngineConfig
from meterloom.operators import emit

log = logging.getLogger(__name__)


def command_sink(cfg: EngineConfig) -> Callable[[DataFrame, int], int]:
    """A sink (flushed rows, batch id) -> exit status. Rows are streamed to the program, never held together.

    A program that fails, or does not read to the end, is logged; its data is not sent again.
    """

    def sink(flushed: DataFrame, batch_id: int) -> int:
        if cfg.binary_stream:
            rows = (bytes(r.record) for r in emit.binary_records(flushed, cfg).select("record").toLocalIterator())
        else:
            rows = ((r.line + "\n").encode() for r in emit.text_records(emit.in_stream_order(flushed)).select("line").toLocalIterator())
        with subprocess.Popen(["/bin/sh", "-c", cfg.stream_cmd], stdin=subprocess.PIPE) as p:
            try:
                for r in rows:
                    p.stdin.write(r)
                p.stdin.close()
            except BrokenPipeError:
                log.warning("the flush command stopped reading in batch %s", batch_id)
            status = p.wait()
        if status:
            log.warning("the flush command ended with status %s in batch %s", status, batch_id)
        return status

    return sink
