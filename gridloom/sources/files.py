"""One file for each row, written by the tasks themselves."""

from __future__ import annotations

import posixpath
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.staging import staged


def filesystem(uri: str) -> tuple[fs.FileSystem, str]:
    """The file system of a folder and the path in it; plain paths are local ones, which executors must share."""
    if "://" in uri:
        return fs.FileSystem.from_uri(uri)
    return fs.LocalFileSystem(), uri.removeprefix("file:")


def write_files(df: DataFrame, folder: str, name: str = "name", content: str = "content") -> DataFrame:
    """Writes each row's content to the file of its name below a folder; gives (name, bytes, error) for every row.

    Names may hold sub-folders, but may not leave the folder. A file appears under its name when it is whole, so a task that
    is run again does no harm; rows of one name overwrite one another. What can't be written has its error,
    as has a null name or content. The files are written once, when this is called.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = filesystem(folder)
        for batch in batches:
            out = []
            for n, data in zip(batch.column(0).to_pylist(), batch.column(1)):
                try:
                    if n is None or not data.is_valid:
                        raise ValueError("no name or no content")
                    if posixpath.normpath(n).startswith(("../", "/")) or posixpath.normpath(n) in ("..", "."):
                        raise ValueError("the name leaves the folder")
                    at = posixpath.join(root, n)
                    store.create_dir(posixpath.dirname(at), recursive=True)
                    draft = f"{at}.{uuid.uuid4().hex[:8]}.part"
                    with store.open_output_stream(draft, compression=None) as f:
                        f.write(data.as_buffer())
                    store.move(draft, at)
                    out.append((n, data.as_buffer().size, None))
                except (OSError, ValueError) as e:
                    out.append((n, None, f"{type(e).__name__}: {e}"))
            if out:
                names, sizes, errors = zip(*out)
                yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(sizes, pa.int64()), pa.array(errors, pa.string())], ["name", "bytes", "error"])

    rows = df.select(F.col(name).cast("string").alias("name"), F.col(content).cast("binary").alias("content"))
    return staged(rows.mapInArrow(run, "name string, bytes long, error string"), "files")
