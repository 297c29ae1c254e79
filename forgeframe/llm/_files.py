"""Binary files of named arrays in the shared folder, memory-mapped where it is a mounted path."""

from __future__ import annotations

import json
import os
import posixpath
import uuid
from urllib.parse import unquote, urlparse


def mounted(uri: str) -> str | None:
    """The path of a ``file:`` URI or plain path; None for other stores."""
    at = urlparse(uri)
    return unquote(at.path) if at.scheme in ("", "file") else None


def save(uri: str, arrays: dict) -> None:
    """Writes arrays under a name of its own, then renames: a task that runs twice leaves one whole file."""
    head, at, parts = {}, 0, []
    for name, a in arrays.items():
        b = a.tobytes()
        head[name] = (a.dtype.str, len(a), at)
        b += bytes(-len(b) % 64)
        parts.append(b)
        at += len(b)
    text = json.dumps(head).encode()
    text += b" " * (-(len(text) + 8) % 64)
    blob = len(text).to_bytes(8, "little") + text
    aside = f"{uri}.{uuid.uuid4().hex}"
    if (path := mounted(uri)) is not None:
        os.makedirs(os.path.dirname(path), exist_ok=True)
        with open(mounted(aside), "wb") as f:
            f.write(blob)
            f.writelines(parts)
        os.replace(mounted(aside), path)
        return
    from pyarrow import fs

    store, path = fs.FileSystem.from_uri(uri)
    store.create_dir(posixpath.dirname(path))
    aside = f"{path}.{uuid.uuid4().hex}"
    with store.open_output_stream(aside) as f:
        f.write(blob)
        for p in parts:
            f.write(p)
    store.move(aside, path)


def load(uri: str) -> dict:
    """The arrays of a file, mapped if its folder is mounted here, else read."""
    import numpy as np

    if (path := mounted(uri)) is not None:
        raw = np.asarray(np.memmap(path, np.uint8, "r"))
    else:
        from pyarrow import fs

        store, path = fs.FileSystem.from_uri(uri)
        with store.open_input_stream(path) as f:
            raw = np.frombuffer(f.read(), np.uint8)
    n = int.from_bytes(raw[:8].tobytes(), "little")
    head = json.loads(raw[8 : 8 + n].tobytes())
    out = {}
    for name, (kind, size, at) in head.items():
        kind = np.dtype(kind)
        out[name] = raw[8 + n + at : 8 + n + at + size * kind.itemsize].view(kind)
    return out
