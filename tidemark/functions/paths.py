"""Path columns: extensions, stems, target paths and path order.

A path is a ``/``-separated relative string without a leading slash. Everything here is built from
string built-ins, so it stays inside whole-stage code generation.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

ColumnOrName = Column | str


def as_column(value: ColumnOrName) -> Column:
    return F.col(value) if isinstance(value, str) else value


def rel_path(path: ColumnOrName, root: str) -> Column:
    """``path`` with ``root`` stripped; evaluation fails for a path that is not below ``root``."""
    path = as_column(path)
    base = root if root.endswith("/") else root + "/"
    outside = F.concat(F.lit("path is not below "), F.lit(base), F.lit(": "), path)
    return F.when(path.startswith(base), F.substr(path, F.lit(len(base) + 1))).otherwise(F.raise_error(outside))


def join_base(base: ColumnOrName, rel: ColumnOrName) -> Column:
    return F.concat_ws("/", as_column(base), as_column(rel))


def file_name(path: ColumnOrName) -> Column:
    return F.substring_index(as_column(path), "/", -1)


def raw_ext(path: ColumnOrName) -> Column:
    """Last dot of the file name and what follows, in original case; empty when there is none.

    A dot that opens the file name (``.bashrc``) does not start an extension.
    """
    name = file_name(path)
    return F.when(
        F.contains(F.substr(name, F.lit(2)), F.lit(".")),
        F.concat(F.lit("."), F.substring_index(name, ".", -1)),
    ).otherwise(F.lit(""))


def file_ext(path: ColumnOrName) -> Column:
    return F.lower(raw_ext(path))


def _drop_ext(path: Column) -> Column:
    return F.substr(path, F.lit(1), F.char_length(path) - F.char_length(raw_ext(path)))


def file_stem(path: ColumnOrName) -> Column:
    return _drop_ext(file_name(path))


def normalize_ext(ext: ColumnOrName) -> Column:
    lowered = F.lower(as_column(ext))
    return F.when(lowered.startswith("."), lowered).otherwise(F.concat(F.lit("."), lowered))


def with_extension(path: ColumnOrName, ext: ColumnOrName) -> Column:
    """``path`` with its last extension replaced by the normalized ``ext``; ``.`` strips it."""
    path, ext = as_column(path), as_column(ext)
    return F.concat(_drop_ext(path), F.when(ext == ".", F.lit("")).otherwise(ext))


def target_path(path: ColumnOrName, ext: ColumnOrName, output_ext: ColumnOrName) -> Column:
    """Path in the target: untouched unless a mapping changes the (lower-cased) extension."""
    path, ext, output_ext = as_column(path), as_column(ext), as_column(output_ext)
    unchanged = output_ext.isNull() | (output_ext == ext)
    return F.when(unchanged, path).otherwise(with_extension(path, output_ext))


def parent_dir(path: ColumnOrName) -> Column:
    """Directory part, or NULL for a path at the root."""
    path = as_column(path)
    return F.when(
        F.contains(path, F.lit("/")),
        F.substr(path, F.lit(1), F.char_length(path) - F.char_length(file_name(path)) - F.lit(1)),
    )


def path_order(path: ColumnOrName) -> Column:
    """Sort key that compares paths component by component (``a``, ``a/b``, ``a-b``).

    NUL cannot occur in a path and sorts below every other byte, so the plain string order of this
    key equals the order of ``split(path, '/')`` without comparing arrays.
    """
    return F.replace(as_column(path), F.lit("/"), F.lit("\0"))
