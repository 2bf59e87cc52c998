"""Raw array files in the shared folder: written once by tasks, memory-mapped by others."""

from __future__ import annotations

import tempfile
import uuid

import numpy as np
from pyarrow import fs


def _place(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path if "://" in path or path.startswith("file:") else f"file://{path}")


def write_array(path: str, array: np.ndarray) -> None:
    """Write under a name of the attempt's own and move it into place, so that a repeated task does no harm."""
    system, name = _place(path)
    system.create_dir(name.rpartition("/")[0], recursive=True)
    draft = f"{name}.{uuid.uuid4().hex}"
    with system.open_output_stream(draft, compression=None) as out:
        out.write(np.ascontiguousarray(array).data)
    system.move(draft, name)


def map_array(path: str, dtype: str) -> np.ndarray:
    """The array, mapped from the shared file system, or from an unlinked copy where that is not mounted."""
    system, name = _place(path)
    if system.get_file_info(name).size == 0:
        return np.zeros(0, dtype=dtype)
    if isinstance(system, fs.LocalFileSystem):
        return np.memmap(name, dtype=dtype, mode="r")
    with tempfile.NamedTemporaryFile() as copy, system.open_input_stream(name) as source:
        while block := source.read(1 << 22):
            copy.write(block)
        copy.flush()
        return np.memmap(copy.name, dtype=dtype, mode="r")
