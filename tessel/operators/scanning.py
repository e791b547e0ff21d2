"""Which files of a tree are worth reading: predicates on paths relative to the root, and on sizes.

The predicates use columns only, so they stand before any Python and are pushed to the scan where the
source can take them.
"""

from __future__ import annotations

import os

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessel.functions.paths import base_name, extension

# Names of directories that are never entered, endings of generated files, endings of files
# without text, and the largest size read.
IGNORED_DIRS = (
    ".git", ".svn", ".hg", "node_modules", "dist", "build", ".next", ".nuxt", ".turbo", "__pycache__", ".venv", "venv", "env",
    ".env", ".tox", "vendor", "target", ".idea", ".vscode", ".DS_Store", "out", "bin", "obj", ".cache", ".tmp", "tmp", "coverage",
    ".coverage", "htmlcov", "migrations",
)
GENERATED_ENDINGS = (".min.js", ".min.css", ".pb.go", ".pb.gw.go", "_gen.go", ".g.dart")
BINARY_EXTENSIONS = (
    ".png", ".jpg", ".jpeg", ".gif", ".bmp", ".svg", ".ico", ".webp", ".pdf", ".zip", ".tar", ".gz", ".bz2", ".xz", ".rar", ".7z",
    ".mp4", ".mp3", ".wav", ".avi", ".mov", ".woff", ".woff2", ".ttf", ".eot", ".otf", ".pyc", ".pyo", ".so", ".dll", ".exe",
    ".dylib", ".o", ".a", ".lock", ".pkl", ".bin", ".dat",
)
MAX_BYTES = 512 * 1024


def enters(folder: str, include_dotfiles: bool = False) -> bool:
    """Is a directory of this name entered? The rule of ``skip_reason`` for code that lists directories itself."""
    return folder not in IGNORED_DIRS and (include_dotfiles or not folder.startswith("."))


def reads(name: str, size: int, include_dotfiles: bool = False, max_bytes: int = MAX_BYTES) -> bool:
    """Is a file of this name and size read?"""
    ending = os.path.splitext(name)[1].lower()
    shown = include_dotfiles or not name.startswith(".")
    return shown and ending not in BINARY_EXTENSIONS and not name.endswith(GENERATED_ENDINGS) and size <= max_bytes


def _folders(rel: Column) -> Column:
    parts = F.split(rel, "/")
    return F.slice(parts, F.lit(1), F.size(parts) - 1)


def skip_reason(rel: Column, length: Column, include_dotfiles: bool = False, max_bytes: int = MAX_BYTES) -> Column:
    """Why a file is skipped: ``directory``, ``hidden``, ``binary``, ``generated``, ``size``; null if it is kept.

    A null path or length is skipped as ``size``, like a file that cannot be read.
    """
    name, folders = base_name(rel), _folders(rel)
    pruned = F.exists(folders, lambda d: d.isin(*IGNORED_DIRS))
    hidden = F.lit(False) if include_dotfiles else F.exists(folders, lambda d: d.startswith(".")) | name.startswith(".")
    generated = F.lit(False)
    for ending in GENERATED_ENDINGS:
        generated = generated | name.endswith(ending)
    return (
        F.when(rel.isNull() | length.isNull(), "size")
        .when(pruned, "directory")
        .when(hidden, "hidden")
        .when(F.lower(extension(rel)).isin(*BINARY_EXTENSIONS), "binary")
        .when(generated, "generated")
        .when(length > max_bytes, "size")
    )


def scannable(files: DataFrame, include_dotfiles: bool = False, max_bytes: int = MAX_BYTES) -> DataFrame:
    """Rows of ``files(rel_path, length, ...)`` that the scanner keeps."""
    return files.where(skip_reason(F.col("rel_path"), F.col("length"), include_dotfiles, max_bytes).isNull())
