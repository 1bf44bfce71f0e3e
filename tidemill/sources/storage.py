"""Files opened inside tasks, on any storage Arrow knows."""

from __future__ import annotations

from pyarrow import fs


def open_input(uri: str):
    """A readable stream; compressed files are decoded by their suffix."""
    filesystem, path = _resolve(uri)
    return filesystem.open_input_stream(path)


def write_file(uri: str, content: bytes) -> None:
    """Create a file and the folders above it."""
    filesystem, path = _resolve(uri)
    filesystem.create_dir(path.rsplit("/", 1)[0], recursive=True)
    with filesystem.open_output_stream(path, compression=None) as stream:
        stream.write(content)


def is_local(uri: str) -> bool:
    return "://" not in uri or uri.startswith("file:")


def local_path(uri: str) -> str:
    return uri.removeprefix("file://").removeprefix("file:")


def _resolve(uri):
    if is_local(uri):
        return fs.LocalFileSystem(), local_path(uri)
    return fs.FileSystem.from_uri(uri.replace("s3a://", "s3://", 1))
