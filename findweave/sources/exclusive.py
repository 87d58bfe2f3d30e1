"""Files on the shared folder: reading, listing, and creating one that must not exist yet.

The creation is what concurrent writers agree by. It is atomic on a POSIX folder (a hard link) and
where a rename fails on an existing target (HDFS); a store that has neither needs a table format
with its own commits instead.
"""

from __future__ import annotations

import os
import uuid

from pyarrow import fs as arrow_fs


def opened(path: str) -> tuple[arrow_fs.FileSystem, str]:
    """The file system of a path or URI, and the path in it."""
    if path.startswith("file:"):
        return arrow_fs.LocalFileSystem(), "/" + path.removeprefix("file:").lstrip("/")
    return arrow_fs.FileSystem.from_uri(path) if "://" in path else (arrow_fs.LocalFileSystem(), path)


def listed(path: str) -> list[arrow_fs.FileInfo]:
    """What a folder holds, by name; nothing if it isn't there. Hidden files are left out."""
    fs, inner = opened(path)
    found = fs.get_file_info(arrow_fs.FileSelector(inner, allow_not_found=True))
    return sorted((f for f in found if f.base_name[:1] not in "._"), key=lambda f: f.base_name)


def content(path: str) -> bytes:
    fs, inner = opened(path)
    with fs.open_input_stream(inner) as stream:
        return stream.read()


def put(path: str, data: bytes) -> None:
    fs, inner = opened(path)
    fs.create_dir(os.path.dirname(inner), recursive=True)
    with fs.open_output_stream(inner) as stream:
        stream.write(data)


def create(path: str, data: bytes) -> bool:
    """Create ``path`` with all of ``data``; false, and nothing done, if it is there already."""
    fs, inner = opened(path)
    draft = f"{os.path.dirname(inner)}/.{uuid.uuid4().hex}"
    fs.create_dir(os.path.dirname(inner), recursive=True)
    with fs.open_output_stream(draft) as stream:
        stream.write(data)
    try:
        if isinstance(fs, arrow_fs.LocalFileSystem):
            os.link(draft, inner)
        elif fs.get_file_info(inner).type != arrow_fs.FileType.NotFound:
            return False
        else:
            fs.move(draft, inner)
    except FileExistsError:
        return False
    except OSError:
        if fs.get_file_info(inner).type == arrow_fs.FileType.NotFound:
            raise
        return False
    finally:
        if fs.get_file_info(draft).type != arrow_fs.FileType.NotFound:
            fs.delete_file(draft)
    return True
