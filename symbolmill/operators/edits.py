"""Splicing lines into, over and out of contents, as columns and on disk."""

from dataclasses import dataclass
from pathlib import Path

from pyspark.sql import Column
from pyspark.sql import functions as F


def splice(content: Column, line: Column, end_line: Column, code: Column | None = None, mode: str = "replace") -> Column:
    """``content`` with ``code`` after ``end_line`` (insert), in place of lines ``line``..``end_line`` (replace), or without them (delete)."""
    lines = F.split(content, "\n", -1)
    head = F.slice(lines, F.lit(1), (end_line if mode == "insert" else line - 1))
    tail = F.slice(lines, end_line + 1, F.greatest(F.size(lines) - end_line, F.lit(0)))
    middle = [F.split(code, "\n", -1)] if mode != "delete" else []
    return F.array_join(F.concat(head, *middle, tail), "\n")


@dataclass
class EditResult:
    success: bool
    message: str
    file_path: str | None = None


def edit_file(root: str, symbol: dict, mode: str, code: str | None = None) -> EditResult:
    """Splice on disk; refuses if the file no longer holds the symbol's code at its lines."""
    path = Path(root, symbol["file_path"])
    try:
        lines = path.read_text(encoding="utf-8").split("\n")
    except OSError as e:
        return EditResult(False, f"cannot read {symbol['file_path']}: {e.strerror}", symbol["file_path"])
    a, b = symbol["line"], symbol["end_line"]
    if "\n".join(lines[a - 1 : b]) != symbol["code"]:
        return EditResult(False, f"{symbol['file_path']} has changed since it was indexed; index it again", symbol["file_path"])
    new = code.split("\n") if code is not None else []
    lines[(b if mode == "insert" else a - 1) : b] = new
    path.write_text("\n".join(lines), encoding="utf-8")
    return EditResult(True, f"{mode} of {symbol['name']} done; index the file again", symbol["file_path"])
