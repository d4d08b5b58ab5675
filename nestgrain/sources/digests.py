"""SHA-256 of files in ranges: a task reads one range of a file and hands the hash's state on."""

from __future__ import annotations

import ctypes
from collections.abc import Iterator
from urllib.parse import quote, urlsplit

import pyarrow as pa
from pyarrow import fs

from ..operators.contracts import GateError

RANGE_BYTES = 256 << 20  # of a file, read by one task
CHUNK_BYTES = 1 << 20
CONTEXT_BYTES = 112  # OpenSSL's SHA256_CTX: plain words, the same in every process
SCHEMA = "path string, name string, bytes bigint, state binary, sha256 string"


def _library() -> ctypes.CDLL:
    """The OpenSSL that hashlib uses; hashlib itself does not give its state away."""
    import _hashlib

    found = ctypes.CDLL(_hashlib.__file__)
    found.SHA256_Init.argtypes = [ctypes.c_char_p]
    found.SHA256_Update.argtypes = [ctypes.c_char_p, ctypes.c_char_p, ctypes.c_size_t]
    found.SHA256_Final.argtypes = [ctypes.c_char_p, ctypes.c_char_p]
    return found


def open_file(path: str):
    """Seekable handle on a local or object-store path, as Spark reports it: nothing in it is escaped."""
    scheme, _, name = path.partition(":") if path.split("/")[0].endswith(":") else ("file", "", path)
    if scheme == "file":
        return open("/" + name.lstrip("/"), "rb")
    system, name = fs.FileSystem.from_uri(quote(path, safe=":/@"))
    return system.open_input_file(name)


def can_hash_ranges(root: str) -> bool:
    """Whether tasks can open files below ``root`` at an offset, and the hash's state can be had."""
    try:
        _library()
        if urlsplit(root).scheme not in ("", "file"):
            fs.FileSystem.from_uri(quote(root, safe=":/@"))
    except (ImportError, AttributeError, OSError, ValueError, NotImplementedError):
        return False
    return True


def hash_ranges(start: int, length: int):
    """For rows of ``SCHEMA``: the range from ``start`` of each file that reaches it; its last range gives the hash."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        library = _library()
        for batch in batches:
            rows = batch.to_pylist()
            for row in rows:
                if row["bytes"] <= start:
                    continue
                context = ctypes.create_string_buffer(row["state"] or b"", CONTEXT_BYTES)
                if start == 0:
                    library.SHA256_Init(context)
                left = min(length, row["bytes"] - start)
                with open_file(row["path"]) as handle:
                    handle.seek(start)
                    while left:
                        chunk = handle.read(min(left, CHUNK_BYTES))
                        if not chunk:
                            raise GateError(f"{row['path']} is shorter than its listing says")
                        library.SHA256_Update(context, chunk, len(chunk))
                        left -= len(chunk)
                row["state"] = context.raw
                if start + length >= row["bytes"]:
                    digest = ctypes.create_string_buffer(32)
                    library.SHA256_Final(digest, context)
                    row["state"], row["sha256"] = None, digest.raw.hex()
            yield pa.RecordBatch.from_pylist(rows, schema=batch.schema)

    return run
