"""Files of the binary formats by path or URI, through pyarrow's file systems (local, hdfs, s3, gs)."""

from __future__ import annotations

import re

from pyarrow import fs

from tidemark.errors import TsdbError


def opened(uri: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(uri) if re.match(r"\w+:", uri) else (fs.LocalFileSystem(), uri)


def read_bytes(uri: str) -> bytes:
    system, path = opened(uri)
    try:
        with system.open_input_file(path) as f:
            return f.read()
    except FileNotFoundError as e:
        raise TsdbError("no_such_file", uri) from e


def read_range(uri: str, at: int, n: int) -> bytes:
    system, path = opened(uri)
    with system.open_input_file(path) as f:
        return f.read_at(n, at)


class Output:
    """A file written piece by piece; it appears under its name when it is closed, whole."""

    def __init__(self, uri: str) -> None:
        self.system, self.path = opened(uri)
        self.stream = self.system.open_output_stream(self.path + ".tmp", compression=None, buffer_size=1 << 20)

    def write(self, data: bytes) -> None:
        self.stream.write(data)

    def close(self) -> None:
        self.stream.close()
        self.system.move(self.path + ".tmp", self.path)


def write_bytes(uri: str, data: bytes) -> None:
    """The file appears under its name when it is whole."""
    out = Output(uri)
    out.write(data)
    out.close()


def make_dir(uri: str) -> None:
    system, path = opened(uri)
    system.create_dir(path, recursive=True)


def exists(uri: str) -> bool:
    system, path = opened(uri)
    return system.get_file_info(path).type != fs.FileType.NotFound


def numbered(uri: str, digits: int) -> list[str]:
    """The files of a folder whose names are exactly so many digits, in numeric order; others are left alone."""
    system, path = opened(uri)
    if system.get_file_info(path).type != fs.FileType.Directory:
        raise TsdbError("no_such_file", uri)
    names = [i.base_name for i in system.get_file_info(fs.FileSelector(path)) if i.type == fs.FileType.File]
    return sorted((n for n in names if re.fullmatch(rf"\d{{{digits}}}", n)), key=int)
