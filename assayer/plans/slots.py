"""Slots of one rate for all tasks, handed out by the driver."""

from __future__ import annotations

import secrets
import socket
import socketserver
import threading
import time
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import SparkSession

#: Servers live as long as the application: plans that use them may run at any time.
_SERVERS: list[socketserver.ThreadingTCPServer] = []


class Pace:
    """Spaces requests evenly: ``partitions`` of these together keep to a rate a minute."""

    def __init__(self, rpm: float, partitions: int = 1, clock=time.monotonic, sleep=time.sleep):
        self.gap = 60.0 * partitions / rpm if rpm > 0 else 0.0
        self.next, self.clock, self.sleep, self.lock = 0.0, clock, sleep, threading.Lock()

    def take(self) -> float:
        """Takes the next slot; how long it is until then."""
        with self.lock:
            now = self.clock()
            at = max(now, self.next)
            self.next = at + self.gap
        return at - now

    def wait(self) -> None:
        if self.gap and (pause := self.take()) > 0:
            self.sleep(pause)


class _Handler(socketserver.StreamRequestHandler):
    """A connection that knows the secret gets, for each line it sends, the seconds until its next slot."""

    def handle(self) -> None:
        if not secrets.compare_digest(self.rfile.readline(200).strip(), self.server.secret):
            return
        while self.rfile.readline(200):
            self.wfile.write(f"{self.server.pace.take():.6f}\n".encode())


class _Server(socketserver.ThreadingTCPServer):
    daemon_threads, allow_reuse_address = True, True

    def __init__(self, pace: Pace, secret: bytes):
        super().__init__(("", 0), _Handler)
        self.pace, self.secret = pace, secret


@dataclass
class Slots:
    """Where tasks get their slots. Each process has one connection, opened at its first request."""

    host: str
    port: int
    secret: str = field(repr=False)

    def __post_init__(self) -> None:
        self._lock, self._file = threading.Lock(), None

    def __getstate__(self) -> dict[str, Any]:
        return {"host": self.host, "port": self.port, "secret": self.secret}

    def __setstate__(self, state: dict[str, Any]) -> None:
        self.__dict__.update(state)
        self.__post_init__()

    def wait(self) -> None:
        """Returns when it is this request's turn. No two requests of the application get the same slot."""
        with self._lock:
            if self._file is None:
                self._file = socket.create_connection((self.host, self.port), timeout=60).makefile("rwb")
                self._file.write(self.secret.encode() + b"\n")
            self._file.write(b"1\n")
            self._file.flush()
            pause = float(self._file.readline())
        if pause > 0:
            time.sleep(pause)


def serve(spark: SparkSession, rpm: float) -> Slots:
    """A server in the driver that hands out slots of a rate a minute, to whichever tasks ask for them.

    A task that is alone gets the whole rate; many share it. A slot that a
    lost task had taken passes unused.
    """
    secret = secrets.token_hex(16)
    server = _Server(Pace(rpm), secret.encode())
    threading.Thread(target=server.serve_forever, daemon=True).start()
    _SERVERS.append(server)
    host = spark.sparkContext.getConf().get("spark.driver.host") or "127.0.0.1"
    return Slots(host, server.server_address[1], secret)
