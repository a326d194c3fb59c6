"""Relevance scoring (C1-C3) as native Spark expressions.

The query is a driver-side parameter (a few words), so its tokens are literals;
the target is a column. Tokenising and edit distance run in the JVM.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codeatlas.functions.text import col_of

# Token rule and score levels.
CAMEL_BOUNDARY = r"([a-z0-9])([A-Z])"
NON_WORD = r"[^\p{L}\p{N}]+"
SCORE_EQUAL = 1.0
SCORE_CONTAINS = 0.9
SCORE_EXACT_TOKENS = 0.8
SCORE_FUZZY_TOKENS = 0.6
MIN_SCORE = 0.3

PY_NON_WORD = re.compile(r"[\W_]+", re.UNICODE)
#: Query positions per bit set.
_BITS = 62
_ASTRAL = r"[\x{10000}-\x{10FFFF}]"


def tokenize(text) -> Column:
    """Split camelCase boundaries, lower-case, split on runs of non letter/digit, drop empties."""
    spaced = F.regexp_replace(col_of(text), CAMEL_BOUNDARY, "$1 $2")
    return F.filter(F.split(F.lower(spaced), NON_WORD), lambda x: x != "")


def tokenize_py(text: str) -> list[str]:
    """Driver-side twin of :func:`tokenize` for the (small) query string."""
    if not text:
        return []
    spaced = re.sub(CAMEL_BOUNDARY, r"\1 \2", text).lower()
    return [t for t in PY_NON_WORD.split(spaced) if t]


def utf16_length(text: str) -> int:
    return len(text.encode("utf-16-le", "surrogatepass")) // 2


def fuzzy_threshold(token: str) -> int:
    return 1 if utf16_length(token) <= 4 else 2


def utf16_units_py(text: str) -> str:
    """One letter per UTF-16 unit: halves of letters beyond U+FFFF become private-use ones, which no token holds."""
    units = text.encode("utf-16-be", "surrogatepass")
    codes = (units[i] << 8 | units[i + 1] for i in range(0, len(units), 2))
    return "".join(chr(u + 0x800) if 0xD800 <= u < 0xE000 else chr(u) for u in codes)


def utf16_units(text: Column) -> Column:
    """``utf16_units_py`` as an expression."""
    units = F.regexp_extract_all(F.hex(F.encode(text, "UTF-16BE")), F.lit("(.{4})"), F.lit(1))
    moved = F.transform(units, lambda u: F.when(u.rlike("^D[89A-F]"), F.concat(F.lit("E"), F.translate(F.substring(u, 2, 1), "89ABCDEF", "01234567"), F.substring(u, 3, 2))).otherwise(u))
    return F.decode(F.unhex(F.array_join(moved, "")), "UTF-16BE")


def near(token: Column, q: str) -> Column:
    """Whether ``token`` is within the threshold of ``q``, by the edit distance in UTF-16 units.

    It is never below the distance in code points, so only tokens that pass this one and hold letters beyond U+FFFF
    are taken apart."""
    most = fuzzy_threshold(q)
    apart = F.levenshtein(utf16_units(token), F.lit(utf16_units_py(q)), most) >= 0
    plain = F.lit(True) if utf16_length(q) == len(q) else F.lit(False)
    return F.when(F.levenshtein(token, F.lit(q), most) < 0, F.lit(False)).when(plain & ~token.rlike(_ASTRAL), F.lit(True)).otherwise(apart)


def _near(q: str):
    return lambda t: near(t, q)


def hits_score(hits: DataFrame, keys: list[str], n: int) -> DataFrame:
    """``tok_score`` per key from (keys, q_pos, exact) rows of near tokens: ``max(0.8 * exact / n, 0.6 * fuzzy / n)``.

    One aggregate: the query positions that a document has are sets of bits."""
    sets = range(max(1, -(-n // _BITS)))
    bit = F.expr(f"shiftleft(1L, cast(q_pos % {_BITS} as int))")
    own = lambda k: F.floor(F.col("q_pos") / _BITS) == k
    per = hits.groupBy(*keys).agg(*[F.coalesce(F.bit_or(F.when(own(k) & F.col("exact"), bit)), F.lit(0)).alias(f"e{k}") for k in sets],
                                  *[F.coalesce(F.bit_or(F.when(own(k), bit)), F.lit(0)).alias(f"f{k}") for k in sets])
    exact = sum((F.bit_count(F.col(f"e{k}")) for k in sets), F.lit(0))
    fuzzy = sum((F.bit_count(F.col(f"f{k}").bitwiseAND(F.bitwise_not(F.col(f"e{k}")))) for k in sets), F.lit(0))
    return per.select(*keys, F.greatest(exact / F.lit(float(n or 1)) * SCORE_EXACT_TOKENS, fuzzy / F.lit(float(n or 1)) * SCORE_FUZZY_TOKENS).alias("tok_score"))


def _literal_parts(query: str):
    return query.lower().strip(), tokenize_py(query)


def token_score(query: str, target_tokens) -> Column:
    """``max(0.8*exact/n, 0.6*fuzzy/n)`` for a token array column; n counts repeats."""
    _, qt = _literal_parts(query)
    toks = col_of(target_tokens)
    if not qt:
        return F.lit(0.0)
    exact = [F.array_contains(toks, F.lit(q)) for q in qt]
    fuzzy = [(~e) & F.exists(toks, _near(q)) for q, e in zip(qt, exact)]
    n = float(len(qt))
    n_exact = sum((e.cast("int") for e in exact[1:]), exact[0].cast("int"))
    n_fuzzy = sum((f.cast("int") for f in fuzzy[1:]), fuzzy[0].cast("int"))
    return F.when(F.size(toks) == 0, F.lit(0.0)).otherwise(
        F.greatest(n_exact / F.lit(n) * SCORE_EXACT_TOKENS, n_fuzzy / F.lit(n) * SCORE_FUZZY_TOKENS))


def score_match(query: str, target) -> Column:
    """Relevance of ``target`` to the literal ``query`` in [0, 1].

    equal (case-insensitive, query trimmed) -> 1; substring -> 0.9; else the token
    score. Empty query or empty / null target -> 0.
    """
    t = col_of(target)
    if not query:
        return F.lit(0.0)
    q, _ = _literal_parts(query)
    lt = F.lower(t)
    return (F.when(t.isNull() | (t == ""), F.lit(0.0))
            .when(lt == F.lit(q), F.lit(SCORE_EQUAL))
            .when(lt.contains(F.lit(q)), F.lit(SCORE_CONTAINS))
            .otherwise(token_score(query, tokenize(t))))
