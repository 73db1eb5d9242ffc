"""A NATS client of a few lines over a socket, and Spark's streaming source and a publisher on top of it.

NATS keeps nothing: what was published before a subscription, or while a query was down, is not seen.
"""

from __future__ import annotations

import json
import socket
import time
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql.datasource import DataSource, SimpleDataSourceStreamReader
from pyspark.sql.types import StructType

#: Seconds that one poll of a subject takes at most.
POLL = 0.5
DEFAULT_SERVERS = "nats://127.0.0.1:4222"


class Connection:
    def __init__(self, servers: str | list[str] | None):
        given = (servers or DEFAULT_SERVERS) if not isinstance(servers, list) else ",".join(servers)
        failed: Exception | None = None
        for server in str(given).split(","):
            host, _, port = server.strip().removeprefix("nats://").rpartition("@")[2].partition(":")
            try:
                self.socket = socket.create_connection((host, int(port or 4222)), timeout=5)
                break
            except OSError as e:
                failed = e
        else:
            raise ConnectionError(f"no NATS server of {given} answers: {failed}")
        self.held = b""
        self._line()  # INFO
        self._send(b'CONNECT {"verbose":false,"pedantic":false,"lang":"python","version":"1"}\r\nPING\r\n')
        while (answer := self._line()) != b"PONG":
            if answer.startswith(b"-ERR"):
                raise ConnectionError(answer.decode())

    def _send(self, data: bytes) -> None:
        self.socket.sendall(data)

    def _line(self) -> bytes:
        while b"\r\n" not in self.held:
            if not (more := self.socket.recv(1 << 16)):
                raise ConnectionError("the NATS server closed the connection")
            self.held += more
        line, self.held = self.held.split(b"\r\n", 1)
        return line

    def _body(self, n: int) -> bytes:
        while len(self.held) < n + 2:
            if not (more := self.socket.recv(1 << 16)):
                raise ConnectionError("the NATS server closed the connection")
            self.held += more
        body, self.held = self.held[:n], self.held[n + 2 :]
        return body

    def subscribe(self, subject: str) -> None:
        self._send(f"SUB {subject} 1\r\nPING\r\n".encode())

    def poll(self, seconds: float = POLL) -> Iterator[bytes]:
        """What arrives within so many seconds; messages without a body are left out."""
        until = time.monotonic() + seconds
        while (left := until - time.monotonic()) > 0:
            self.socket.settimeout(left)
            try:
                line = self._line()
                self.socket.settimeout(5)
                if line == b"PING":
                    self._send(b"PONG\r\n")
                elif line.startswith(b"MSG ") and (body := self._body(int(line.split()[-1]))).strip():
                    yield body
            except TimeoutError:
                return

    def publish(self, subject: str, bodies: Iterable[bytes]) -> None:
        for body in bodies:
            self._send(f"PUB {subject} {len(body)}\r\n".encode() + body + b"\r\n")
        self._send(b"PING\r\n")
        while self._line() != b"PONG":
            pass

    def close(self) -> None:
        self.socket.close()


def publisher(subject: str, servers: str | list[str] | None) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def publish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        connection = None
        try:
            for b in batches:
                connection = connection or Connection(servers)
                connection.publish(subject, (x.as_py().encode() for x in b.column(0)))
                yield pa.RecordBatch.from_arrays([pa.array([b.num_rows], pa.int64())], ["n"])
        finally:
            if connection:
                connection.close()

    return publish


class Reader(SimpleDataSourceStreamReader):
    def __init__(self, options: dict[str, str]):
        self.options, self.connection = options, None

    def initialOffset(self) -> dict[str, int]:
        return {"n": 0}

    def read(self, start: dict[str, int]) -> tuple[Iterator[tuple[str]], dict[str, int]]:
        if self.connection is None:
            self.connection = Connection(self.options.get("servers"))
            self.connection.subscribe(self.options["subject"])
        rows = [(b.decode("utf-8", "replace"),) for b in self.connection.poll()]
        return iter(rows), {"n": start["n"] + len(rows)}

    def readBetweenOffsets(self, start: dict[str, int], end: dict[str, int]) -> Iterator[tuple[str]]:
        return iter(())  # nothing can be had again

    def commit(self, end: dict[str, int]) -> None:
        return None


class Nats(DataSource):
    @classmethod
    def name(cls) -> str:
        return "spillway-nats"

    def schema(self) -> str:
        return "value string"

    def simpleStreamReader(self, schema: StructType) -> Reader:
        return Reader(dict(self.options))


def wrapped(text: str) -> str:
    """A message that is no JSON is kept as ``_raw``."""
    try:
        json.loads(text)
        return text
    except ValueError:
        return json.dumps({"_raw": text})
