"""Column -> Column helpers (all built-in Spark expressions, code-generated)."""

from codeatlas.functions.text import *  # noqa: F401,F403
from codeatlas.functions.ignore import DEFAULT_IGNORE, is_ignored  # noqa: F401
