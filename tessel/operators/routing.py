"""From file names and first lines to languages."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessel.functions.paths import base_name, extension

# Languages by extension, by exact name and by interpreter.
BY_EXTENSION = {
    "python": (".py",), "go": (".go",),
    "javascript": (".js", ".ts", ".jsx", ".tsx", ".mjs", ".cjs"),
    "rust": (".rs",), "java": (".java",), "ruby": (".rb", ".rake"), "c": (".c", ".h"),
    "cpp": (".cpp", ".cc", ".cxx", ".hh", ".hpp", ".hxx"), "lua": (".lua",),
    "shell": (".sh", ".bash", ".zsh", ".fish"),
    "config": (
        ".yaml", ".yml", ".toml", ".json", ".jsonc", ".ini", ".cfg", ".conf", ".env", ".properties", ".editorconfig",
        ".prettierrc", ".eslintrc", ".babelrc", ".stylelintrc",
    ),
}
BY_NAME = {
    "shell": (
        ".zshrc", ".zshenv", ".zprofile", ".zlogin", ".zlogout", ".bashrc", ".bash_profile", ".bash_aliases", ".bash_functions",
        ".bash_logout", ".profile", ".kshrc", ".mkshrc", ".fishrc", ".xinitrc",
    ),
    "config": (
        ".gitconfig", ".gitattributes", ".gitignore", ".gitignore_global", ".gitmodules", ".gitmessage", ".hgignore",
        ".editorconfig", ".curlrc", ".wgetrc", ".npmrc", ".yarnrc", ".pip.conf", ".pydistutils.cfg", ".pylintrc", ".flake8",
        ".isort.cfg", ".coveragerc", ".tmux.conf", ".inputrc", ".dircolors", ".Xresources", ".vimrc", ".gvimrc", ".ideavimrc",
        "Makefile", "GNUmakefile", "Dockerfile", "Brewfile", "config",
    ),
    "ruby": ("Rakefile", "Gemfile", "Podfile", "Fastfile", "Guardfile", "Vagrantfile", "Capfile"),
}
BY_INTERPRETER = {
    "shell": ("bash", "sh", "zsh", "fish", "ksh", "mksh", "dash", "ash"),
    "python": ("python", "python3"), "ruby": ("ruby", "rbenv"), "lua": ("lua",), "javascript": ("node", "nodejs"),
}
INI_NAMES = (
    ".gitconfig", ".gitattributes", ".editorconfig", ".npmrc", ".yarnrc", ".pip.conf", ".curlrc", ".wgetrc", ".inputrc",
    ".tmux.conf", "Makefile", "Dockerfile", "Brewfile",
)


def _lookup(table: dict[str, tuple], key: Column) -> Column:
    flat = chain.from_iterable((F.lit(k), F.lit(lang)) for lang, keys in table.items() for k in keys)
    return F.try_element_at(F.create_map(*flat), key)


def from_shebang(first_line: Column) -> Column:
    """Language of a ``#!`` line by its last word's base name; null for other lines."""
    line = F.regexp_replace(F.substring(first_line, 1, 200), r"^\s+|\s+$", "")
    words = F.split(F.regexp_replace(F.substring(line, 3, 200), r"^\s+|\s+$", ""), r"\s+")
    tool = base_name(F.lower(F.element_at(words, -1)))
    known = F.coalesce(_lookup(BY_INTERPRETER, tool), F.when(tool.startswith("lua5"), "lua"))
    return F.when(line.startswith("#!"), known)


def language(path: Column, first_line: Column | None = None) -> Column:
    """Language of a file: exact name, then extension, then, without an extension, the first line."""
    ext = F.lower(extension(path))
    found = [_lookup(BY_NAME, base_name(path)), _lookup(BY_EXTENSION, ext)]
    if first_line is not None:
        found.append(F.when(ext == "", from_shebang(first_line)))
    return F.coalesce(*found)


def config_dialect(path: Column) -> Column:
    """Which reader a configuration file goes to; others are named after their extension, or ``config``."""
    ext, name = F.lower(extension(path)), base_name(path)
    return (
        F.when(ext.isin(".yaml", ".yml"), "yaml")
        .when(ext == ".toml", "toml")
        .when(ext == ".json", "json")
        .when(ext.isin(".ini", ".cfg") | name.isin(*INI_NAMES), "ini")
        .when(F.length(ext) > 1, F.substring(ext, 2, 100))
        .otherwise("config")
    )


def routed(files: DataFrame) -> DataFrame:
    """``files(path, content)`` with ``language``; files of no known language vanish.

    The first line is read from the first 200 bytes only, so routing doesn't decode whole files.
    """
    head = F.regexp_extract(F.substring(F.col("content"), 1, 200).cast("string"), r"^([^\r\n]*)", 1)
    return files.withColumn("language", language(F.col("path"), head)).where("language IS NOT NULL")
