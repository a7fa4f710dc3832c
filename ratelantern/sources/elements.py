"""Re-sharding of very large JSON documents.

A multi-line JSON file is one row and one task for ``spark.read.json``. This data source
walks through such a file once, keeping one array element in memory at a time, and yields
each element of the named top-level arrays as a row. Written as Parquet the elements can be
parsed by any number of tasks.
"""

import json
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ratelantern.session import write_stage
from ratelantern.sources.files import list_files, open_stream

ELEMENT_SCHEMA = "source_file string, array_name string, ordinal bigint, element string"
HEADER = "header"
_READ_BYTES = 8 << 20


class _Text:
    """Text of a byte stream, read as needed; what has been consumed is let go."""

    def __init__(self, stream):
        import codecs

        self._stream = stream
        self._decode = codecs.getincrementaldecoder("utf-8-sig")(errors="replace").decode
        self._buffer = ""
        self._at = 0
        self._ended = False
        self._decoder = json.JSONDecoder()

    def _more(self, size: int = _READ_BYTES) -> bool:
        if self._ended:
            return False
        chunk = self._stream.read(size)
        self._ended = not chunk
        self._buffer = self._buffer[self._at :] + self._decode(chunk, final=self._ended)
        self._at = 0
        return True

    def peek(self) -> str:
        """The next character that is not white space."""
        while True:
            rest = len(self._buffer)
            while self._at < rest and self._buffer[self._at] in " \t\r\n":
                self._at += 1
            if self._at < rest:
                return self._buffer[self._at]
            if not self._more():
                raise ValueError("JSON text ends early")

    def take(self, expected: str) -> None:
        if self.peek() != expected:
            raise ValueError(f"expected {expected!r}, found {self.peek()!r}")
        self._at += 1

    def value(self) -> str:
        """The source text of the next JSON value."""
        self.peek()
        size = _READ_BYTES
        while True:
            try:
                _, end = self._decoder.raw_decode(self._buffer, self._at)
                # A number at the end of the buffer may go on in the next chunk.
                if end < len(self._buffer) or not self._more(size):
                    text = self._buffer[self._at : end]
                    self._at = end
                    return text
            except json.JSONDecodeError:
                if not self._more(size):
                    raise
            size *= 2


def elements(stream, arrays: list[str]) -> Iterator[tuple[str, int, str]]:
    """(array name, ordinal from 1, element text), then the other short fields as one object."""
    text = _Text(stream)
    header: dict[str, str] = {}
    text.take("{")
    while text.peek() != "}":
        name = json.loads(text.value())
        text.take(":")
        if name in arrays and text.peek() == "[":
            text.take("[")
            ordinal = 0
            while text.peek() != "]":
                ordinal += 1
                yield name, ordinal, text.value()
                if text.peek() == ",":
                    text.take(",")
            text.take("]")
        else:
            header[name] = text.value()
        if text.peek() == ",":
            text.take(",")
    fields = ",".join(f"{json.dumps(k)}:{v}" for k, v in header.items())
    yield HEADER, 0, "{" + fields + "}"


class _File(InputPartition):
    def __init__(self, path: str):
        self.path = path


class _Reader(DataSourceReader):
    def __init__(self, paths: list[str], arrays: list[str]):
        self._paths = paths
        self._arrays = arrays

    def partitions(self):
        return [_File(path) for path in self._paths]

    def read(self, partition):
        with open_stream(partition.path) as stream:
            for name, ordinal, element in elements(stream, self._arrays):
                yield partition.path, name, ordinal, element


class JsonElements(DataSource):
    """Format ``json_elements``: options ``paths`` and ``arrays``, each a JSON list."""

    @classmethod
    def name(cls):
        return "json_elements"

    def schema(self):
        return ELEMENT_SCHEMA

    def reader(self, schema):
        return _Reader(json.loads(self.options["paths"]), json.loads(self.options["arrays"]))


def reshard(spark: SparkSession, path: str | list[str], arrays: list[str]) -> DataFrame:
    """Elements of all files below ``path``, one task per file, stored for parallel parsing."""
    paths = [row.source_file for row in list_files(spark, path).toLocalIterator()]
    spark.dataSource.register(JsonElements)
    rows = (
        spark.read.format("json_elements")
        .option("paths", json.dumps(paths))
        .option("arrays", json.dumps(arrays))
        .load()
    )
    return write_stage(rows, "json-elements")
