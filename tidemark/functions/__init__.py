"""Column functions: paths, versions, globs and command templates."""

from tidemark.functions.globs import GlobError, glob_to_regex, matches_glob
from tidemark.functions.paths import (
    file_ext,
    file_name,
    file_stem,
    join_base,
    normalize_ext,
    parent_dir,
    path_order,
    raw_ext,
    rel_path,
    target_path,
    with_extension,
)
from tidemark.functions.templates import (
    TEMPLATE_VARIABLES,
    render_template,
    render_tokens,
    template_error,
    template_tokens,
)
from tidemark.functions.versions import is_fresh, version_gap

__all__ = [
    "TEMPLATE_VARIABLES",
    "GlobError",
    "file_ext",
    "file_name",
    "file_stem",
    "glob_to_regex",
    "is_fresh",
    "join_base",
    "matches_glob",
    "normalize_ext",
    "parent_dir",
    "path_order",
    "raw_ext",
    "rel_path",
    "render_template",
    "render_tokens",
    "target_path",
    "template_error",
    "template_tokens",
    "version_gap",
    "with_extension",
]
