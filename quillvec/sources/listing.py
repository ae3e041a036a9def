"""Published contents of a vector folder: a numbered list of files, written in one small step.

A folder may hold the files of several writes side by side; the entry with the
highest number in ``_list`` says which of them count. An entry is a JSON document
under a name of its own, so publishing neither moves nor overwrites anything. A
torn entry does not parse and counts for nothing: readers then see the one before.
"""

from __future__ import annotations

import json
import posixpath
import re

import pyarrow.fs as pafs

LIST_DIR = "_list"
_ENTRY = re.compile(r"(\d{8,})\.json")


def _entries(fs: pafs.FileSystem, where: str) -> list[tuple[int, str]]:
    found = fs.get_file_info(pafs.FileSelector(posixpath.join(where, LIST_DIR), allow_not_found=True))
    named = ((_ENTRY.fullmatch(posixpath.basename(e.path)), e.path) for e in found)
    return sorted((int(m[1]), path) for m, path in named if m)


def _read(fs: pafs.FileSystem, path: str) -> dict | None:
    with fs.open_input_stream(path) as source:
        raw = source.read()
    try:
        entry = json.loads(raw)
    except ValueError:
        return None
    return entry if isinstance(entry, dict) and entry.get("whole") else None


def listed(fs: pafs.FileSystem, where: str) -> dict | None:
    """The newest whole entry of a folder; none if nothing was published there."""
    for _, path in reversed(_entries(fs, where)):
        if (entry := _read(fs, path)) is not None:
            return entry
    return None


def entry_at(fs: pafs.FileSystem, where: str, number: int) -> dict | None:
    path = next((p for n, p in _entries(fs, where) if n == number), None)
    return None if path is None else _read(fs, path)


def publish(fs: pafs.FileSystem, where: str, entry: dict, number: int | None = None) -> None:
    """Add an entry, by default after all others."""
    if number is None:
        number = max((n for n, _ in _entries(fs, where)), default=-1) + 1
    folder = posixpath.join(where, LIST_DIR)
    fs.create_dir(folder, recursive=True)
    # The mark comes last in the text, so a cut-off document never has it.
    text = json.dumps({**entry, "whole": True})
    with fs.open_output_stream(posixpath.join(folder, f"{number:08d}.json")) as sink:
        sink.write(text.encode("utf-8"))


def remove_unlisted(fs: pafs.FileSystem, where: str) -> int:
    """Delete data files that the newest entry does not name; returns how many."""
    entry = listed(fs, where)
    if entry is None:
        return 0
    kept = {posixpath.join(where, name) for name, *_ in entry["files"]}
    found = fs.get_file_info(pafs.FileSelector(where, recursive=True))
    prefix = posixpath.join(where, "v-")
    gone = [e.path for e in found if e.is_file and e.path.startswith(prefix) and e.path not in kept]
    for path in gone:
        fs.delete_file(path)
    return len(gone)
