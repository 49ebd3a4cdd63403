"""Array helpers built from Spark higher-order functions, as SQL text.

Expressions are produced as SQL strings and parsed once by ``F.expr``: a
plan with hundreds of nested lambdas built call by call through the Python
API costs a gateway round trip per node (tens of seconds per plan).
"""

from __future__ import annotations

# Block size of ``exclusive_prefix_sums``.
BLOCK = 64


def sql_str(s: str) -> str:
    """A Spark SQL string literal holding exactly ``s``."""
    return "'" + s.replace("\\", "\\\\").replace("'", "\\'") + "'"


def let(value: str, var: str, body: str) -> str:
    """Evaluate ``value`` once and bind it to ``var`` inside ``body``.

    Spark inlines a projected column into every use, including uses inside a
    lambda, where it would be evaluated once per element; binding through a
    one-element ``transform`` evaluates it exactly once.
    """
    return f"element_at(transform(array({value}), {var} -> {body}), 1)"


def exclusive_prefix_sums(d: str, v: str, levels: int = 3) -> str:
    """``[0, d0, d0+d1, ...]`` (same length as ``d``) for a non-empty int array.

    Spark has no scan function, and a fold that carries an array copies it at
    every step. Here the array is cut into blocks of BLOCK; the sums before
    the blocks are the same problem on an array BLOCK times shorter, and
    within a block each sum is a fold with a number. ``levels`` blocks of
    blocks make the cost linear for up to BLOCK ** levels elements.
    ``v`` prefixes the lambda variable names.
    """
    if levels == 0:
        return f"transform({d}, ({v}x, {v}i) -> aggregate(slice({d}, 1, {v}i), 0, ({v}a, {v}y) -> {v}a + {v}y))"
    blocks = f"transform(sequence(0, (size({v}d) - 1) div {BLOCK}), {v}k -> slice({v}d, CAST({v}k * {BLOCK} + 1 AS INT), {BLOCK}))"
    sums = f"transform({v}b, {v}l -> aggregate({v}l, 0, ({v}a, {v}y) -> {v}a + {v}y))"
    inside = (f"flatten(transform({v}b, ({v}l, {v}k) -> transform({v}l, ({v}x, {v}i) -> "
              f"aggregate(slice({v}l, 1, {v}i), get({v}p, {v}k), ({v}a, {v}y) -> {v}a + {v}y))))")
    before = exclusive_prefix_sums(f"{v}s", f"{v}{levels}", levels - 1)
    return let(d, f"{v}d", let(blocks, f"{v}b", let(sums, f"{v}s", let(before, f"{v}p", inside))))


#: characters of a piece of ``pieces``
PIECE = 128


def pieces(text: str) -> str:
    """``text`` as an array of pieces of PIECE characters, in one walk. UTF-8
    strings are indexed by walking from their start; pieces make any cut cost
    as much as it takes and no more."""
    return f"regexp_extract_all({text}, '(?s).{{1,{PIECE}}}', 0)"


def cut(array: str, start: str, n: str) -> str:
    """``n`` characters from the 0-based ``start`` of a text held as ``pieces``."""
    first = f"(({start}) div {PIECE})"
    count = f"((({start}) + ({n}) - 1) div {PIECE} - {first} + 1)"
    return (f"CASE WHEN ({n}) <= 0 THEN '' ELSE substring(array_join(slice({array}, CAST({first} + 1 AS INT), CAST({count} AS INT)), ''), "
            f"CAST(({start}) % {PIECE} + 1 AS INT), CAST({n} AS INT)) END")
