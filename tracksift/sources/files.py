"""Small file operations that work in any store (by address): tasks and the driver use the same ones."""

from __future__ import annotations

from pyarrow import fs


def at(path: str) -> tuple[fs.FileSystem, str]:
    """The store of an address and the path in it; an address without a scheme is a local path."""
    return fs.FileSystem.from_uri(path if ":/" in path else f"file://{path}")


def names(path: str) -> list[str]:
    """Data files of a folder, by name; none if there is no folder."""
    store, own = at(path)
    found = store.get_file_info(fs.FileSelector(own, allow_not_found=True))
    return sorted(f.base_name for f in found if f.is_file and not f.base_name.startswith(("_", ".")))


def exists(path: str) -> bool:
    store, own = at(path)
    return store.get_file_info(own).type != fs.FileType.NotFound


def delete(path: str) -> None:
    """A folder and all in it; nothing if it isn't there."""
    store, own = at(path)
    if store.get_file_info(own).type == fs.FileType.Directory:
        store.delete_dir(own)
