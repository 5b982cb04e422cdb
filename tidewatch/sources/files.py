"""Files opened by the tasks that read them."""

from __future__ import annotations


def open_input(path: str):
    """A file of any file system that Arrow knows, for reading at any place."""
    from pyarrow import fs

    if path.startswith("file:") or "://" not in path:
        return fs.LocalFileSystem().open_input_file("/" + path.removeprefix("file:").lstrip("/"))
    system, inner = fs.FileSystem.from_uri(path)
    return system.open_input_file(inner)


def open_output(folder: str, name: str):
    """A new file in a folder, which is made if it is not there; and its path."""
    from pyarrow import fs

    system, inner = fs.LocalFileSystem(), "/" + folder.removeprefix("file:").lstrip("/")
    if "://" in folder:
        system, inner = fs.FileSystem.from_uri(folder)
    system.create_dir(inner)
    return system.open_output_stream(f"{inner}/{name}")
