"""Files that tasks write and read in the shared folder, by any scheme that Arrow's file systems know."""

from __future__ import annotations

import uuid

from pyarrow import fs


def opened(uri: str):
    """A random-access reader for one file."""
    store, path = fs.FileSystem.from_uri(uri)
    return store.open_input_file(path)


def created(folder: str, suffix: str):
    """A new file under a name that no other attempt of the task has: (uri, stream).

    Files of failed or speculative attempts stay unnamed in the manifest and are never read.
    """
    uri = f"{folder}/{uuid.uuid4().hex}{suffix}"
    store, path = fs.FileSystem.from_uri(uri)
    store.create_dir(path.rsplit("/", 1)[0], recursive=True)
    return uri, store.open_output_stream(path, compression=None)
