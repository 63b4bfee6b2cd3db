"""Arrays in files below the shared folder, mapped into memory by the tasks that read them."""

from __future__ import annotations

import json
import mmap
import os
import tempfile
import uuid
from collections import OrderedDict
from urllib.parse import unquote, urlparse

import numpy as np

#: Files that a worker keeps mapped (mapped pages belong to the system's cache, not to the worker).
MAPPED = 256
_maps: OrderedDict[str, dict[str, np.ndarray]] = OrderedDict()


def _local(uri: str) -> str | None:
    parts = urlparse(uri)
    return unquote(parts.path) if parts.scheme in ("", "file") else None


def write_arrays(folder: str, name: str, arrays: dict[str, np.ndarray]) -> str:
    """One file of the arrays, complete or not there: a task that is run again replaces it with the same content."""
    head = json.dumps({k: [str(v.dtype), len(v)] for k, v in arrays.items()}).encode()
    head += b" " * (-(len(head) + 8) % 64)
    data = [len(head).to_bytes(8, "little"), head]
    for v in arrays.values():
        raw = np.ascontiguousarray(v).tobytes()
        data.append(raw + b"\0" * (-len(raw) % 64))
    uri = f"{folder.rstrip('/')}/{name}"
    path = _local(uri)
    if path is not None:
        os.makedirs(os.path.dirname(path), exist_ok=True)
        part = f"{path}.{uuid.uuid4().hex}"
        with open(part, "wb") as f:
            f.writelines(data)
        os.replace(part, path)
    else:
        from pyarrow import fs

        store, path = fs.FileSystem.from_uri(uri)
        store.create_dir(os.path.dirname(path), recursive=True)
        part = f"{path}.{uuid.uuid4().hex}"
        with store.open_output_stream(part) as f:
            for d in data:
                f.write(d)
        store.move(part, path)
    return uri


def map_arrays(uri: str) -> dict[str, np.ndarray]:
    """The arrays of a file, memory-mapped. A file of a store without local paths is fetched into a nameless one."""
    if uri in _maps:
        _maps.move_to_end(uri)
        return _maps[uri]
    path = _local(uri)
    if path is not None:
        with open(path, "rb") as f:
            m = mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ)
    else:
        from pyarrow import fs

        store, path = fs.FileSystem.from_uri(uri)
        with tempfile.TemporaryFile() as f, store.open_input_stream(path) as source:
            while chunk := source.read(1 << 22):
                f.write(chunk)
            f.flush()
            m = mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ)
    size = int.from_bytes(m[:8], "little")
    out, at = {}, 8 + size
    for k, (kind, n) in json.loads(m[8:8 + size]).items():
        out[k] = np.frombuffer(m, kind, n, at)
        at += out[k].nbytes + -out[k].nbytes % 64
    _maps[uri] = out
    if len(_maps) > MAPPED:
        _maps.popitem(last=False)
    return out
