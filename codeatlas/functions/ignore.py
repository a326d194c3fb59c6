"""Ignore-path predicate (F1)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from codeatlas.functions.text import col_of

# The default ignore list a new project starts with (the tool's own
# state folder is named after this library).
DEFAULT_IGNORE = [
    ".git", ".codeatlas", ".omc", ".idea", ".vscode",
    "node_modules", "dist", "build", "out", "coverage",
    ".next", ".nuxt", ".output", ".svelte-kit", ".turbo",
    ".cache", ".parcel-cache", ".nyc_output", ".angular", ".docusaurus",
    ".vercel", ".netlify", "storybook-static",
    ".venv", "venv", "__pycache__", ".tox", ".mypy_cache", ".pytest_cache",
    ".ruff_cache", ".ipynb_checkpoints", ".eggs", "*.egg-info",
    "target", "vendor", "bin", "obj", ".gradle", "Pods",
]


def matches_pattern(path: str, segments: list[str], pattern: str) -> bool:
    """Plain-Python form of one pattern test, used by the directory walk."""
    if "/" in pattern:
        return pattern in path
    if pattern.startswith("*."):
        return any(s.endswith(pattern[1:]) for s in segments)
    return pattern in segments


def is_ignored_py(path: str, patterns) -> bool:
    segs = path.split("/")
    return any(matches_pattern(path, segs, p) for p in patterns)


def _ends_with(suffix: str):
    return lambda s: s.endswith(suffix)


def is_ignored(path, patterns=None) -> Column:
    """True when any pattern hits the relative path.

    * pattern containing ``/``: substring of the whole path;
    * ``*.x``: some path segment ends with ``.x``;
    * otherwise: some segment equals the pattern (``dist`` spares ``distance.ts``).

    Because the walk prunes ignored directories, testing every segment of the
    full path also covers every ancestor.
    """
    patterns = DEFAULT_IGNORE if patterns is None else list(patterns)
    p = col_of(path)
    segs = F.split(p, "/")
    names = [x for x in patterns if "/" not in x and not x.startswith("*.")]
    suffixes = [x[1:] for x in patterns if "/" not in x and x.startswith("*.")]
    subs = [x for x in patterns if "/" in x]
    cond = F.lit(False)
    if names:
        cond = cond | F.arrays_overlap(segs, F.array(*[F.lit(n) for n in names]))
    for suf in suffixes:
        cond = cond | F.exists(segs, _ends_with(suf))
    for sub in subs:
        cond = cond | p.contains(sub)
    return cond
