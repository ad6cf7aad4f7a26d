"""One text file written by many tasks: each task writes its range of lines as a piece, and the commit joins the pieces.

Pieces of a compressed file are zstd frames; frames one after the other are a valid file. A task that is tried again
writes another piece, and only pieces of attempts that succeeded are joined, so the file appears once and whole. The
joining copies finished bytes in order with a buffer of fixed size. The target must be reachable by all executors (a
path, or any address that Arrow's file systems know).
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

from cladeframe.session import materialise

NAME = "cladeframe_one_file"
#: Bytes held while pieces are joined.
COPY_BYTES = 8 << 20


def _place(target: str):
    """The file system of an address, and the path in it."""
    from pyarrow import fs

    if "://" in target or target.startswith("file:"):
        return fs.FileSystem.from_uri(target)
    return fs.LocalFileSystem(), target


@dataclass
class Piece(WriterCommitMessage):
    path: str
    first: int | None  # None: the task had no lines
    lines: int


class _Writer(DataSourceWriter):
    def __init__(self, target: str, compression: str, level: int) -> None:
        self.target, self.compression, self.level = target, compression, level
        self.parts = f"{target}.pieces-{uuid.uuid4().hex[:12]}"

    def write(self, rows: Iterator) -> Piece:
        """The lines of a task, which come in order of ``i``."""
        first, lines = None, 0
        place, folder = _place(self.parts)
        path = f"{folder}/{uuid.uuid4().hex}"
        place.create_dir(folder, recursive=True)
        with place.open_output_stream(path, compression=None) as raw, self._frames(raw) as out:
            for row in rows:
                first = row["i"] if first is None else first
                out.write(row["line"].encode() + b"\n")
                lines += 1
        return Piece(path, first, lines)

    def _frames(self, raw):
        if self.compression == "none":
            return raw
        import zstandard

        return zstandard.ZstdCompressor(level=self.level).stream_writer(raw, closefd=False)

    def commit(self, messages: list[Piece | None]) -> None:
        place, target = _place(self.target)
        pieces = sorted((m for m in messages if m is not None and m.first is not None), key=lambda m: m.first)
        whole = f"{_place(self.parts)[1]}/whole"
        place.create_dir(_place(self.parts)[1], recursive=True)
        with place.open_output_stream(whole, compression=None) as out:
            for piece in pieces:
                with place.open_input_stream(piece.path, compression=None) as part:
                    while data := part.read(COPY_BYTES):
                        out.write(data)
        place.move(whole, target)
        place.delete_dir(_place(self.parts)[1])

    def abort(self, messages: list[Piece | None]) -> None:
        from pyarrow import fs

        place, folder = _place(self.parts)
        if place.get_file_info(folder).type == fs.FileType.Directory:
            place.delete_dir(folder)


class OneFile(DataSource):
    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> str:
        return "i long, line string"

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        return _Writer(self.options["path"], self.options.get("compression", "zstd"), int(self.options.get("level", "3")))


def write_lines(lines: DataFrame, target: str, compression: str = "zstd", level: int = 3) -> str:
    """``i, line`` as one file in order of ``i`` (numbers of their own); ``compression`` is zstd or none.

    An empty table gives an empty file; null lines are left out; an existing file is replaced. Other columns are not read.
    """
    if compression not in ("zstd", "none"):
        raise ValueError(f"unknown compression {compression!r}")
    spark = lines.sparkSession
    spark.dataSource.register(OneFile)
    kept = materialise(lines.select(F.col("i").cast("long").alias("i"), "line").filter("line is not null"), "lines")
    ranges = kept.repartitionByRange("i").sortWithinPartitions("i")  # pieces are ranges, so their first lines order them
    ranges.write.format(NAME).mode("append").options(path=target, compression=compression, level=level).save()
    return target
