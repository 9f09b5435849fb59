"""Answers of paid calls, kept as they come: a file for each, named by the hash of what was asked.

A task looks an answer up before it makes the call and keeps it right after, so that neither a run that was killed nor a
task that Spark starts again makes a call twice. Files are written under another name and then renamed: a half-written
answer is never read. The folder has to be seen by all executors.
"""

from __future__ import annotations

import hashlib
import json
import uuid
from dataclasses import dataclass


def filesystem(uri: str):
    """Arrow's file system for a path, with the names that Spark has for schemes, and the path in it."""
    from pyarrow import fs

    scheme, _, rest = uri.partition("://")
    if not rest:
        return fs.FileSystem.from_uri(f"file://{uri}")
    return fs.FileSystem.from_uri(f"s3://{rest}" if scheme in ("s3a", "s3n") else uri)


@dataclass(frozen=True)
class Ledger:
    folder: str

    def _place(self, *asked: str) -> str:
        name = hashlib.sha256("\x1f".join(asked).encode()).hexdigest()
        return f"{self.folder.rstrip('/')}/{name[:2]}/{name}.json"

    def get(self, *asked: str) -> dict | None:
        from pyarrow.fs import FileType

        fs, path = filesystem(self._place(*asked))
        if fs.get_file_info(path).type != FileType.File:
            return None
        with fs.open_input_file(path) as f:
            return json.loads(f.read())

    def put(self, answer: dict, *asked: str) -> None:
        fs, path = filesystem(self._place(*asked))
        fs.create_dir(path.rsplit("/", 1)[0], recursive=True)
        half = f"{path}.{uuid.uuid4().hex}"
        with fs.open_output_stream(half, compression=None) as f:
            f.write(json.dumps(answer, ensure_ascii=False).encode())
        fs.move(half, path)
