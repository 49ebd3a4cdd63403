"""All gate literals of a rule set found in one pass.

``contains`` reads the text once per literal. Here one pattern looks, from every
place, for the longest literal that begins there: any other that begins at the
same place is its prefix, so a literal stands in the text exactly if it stands
in one of those found.
"""

from __future__ import annotations

from tidemark.functions.arrays import sql_str

#: a literal shorter than this stands in most texts near their start, where a plain search ends at once
MIN_POOLED = 3
#: fewer literals are looked for one by one
MIN_LITERALS = 12


def _char(c: str) -> str:
    return c if c.isalnum() else f"\\x{ord(c):02x}"


def _one_of(chars) -> str:
    return "[" + "".join(map(_char, sorted(set(chars)))) + "]"


def _trie(words: list[str]) -> str:
    """A pattern that takes the longest of the words standing at its place."""
    by: dict[str, list[str]] = {}
    for w in words:
        if w:
            by.setdefault(w[0], []).append(w[1:])
    if not by:
        return ""
    body = "|".join(_char(c) + _trie(by[c]) for c in sorted(by))
    return f"(?:{body})?" if "" in words else f"(?:{body})"


def pooled(literals) -> list[str]:
    """Those to be found together; none if they are few."""
    out = sorted({g for g in literals if len(g) >= MIN_POOLED and g.isascii() and g.isprintable()})
    return out if len(out) >= MIN_LITERALS else []


def finder(literals: list[str]) -> str:
    lead = "".join(_one_of(g[k] for g in literals) for k in range(MIN_POOLED))
    return f"(?={lead})(?=({_trie(literals)}))"


def found_sql(text: str, literals: list[str]) -> str:
    """The literals that stand in the text, a line each: ``contains`` on it
    answers for every one of ``literals`` as it does on the text."""
    return f"array_join(array_distinct(regexp_extract_all({text}, {sql_str(finder(literals))}, 1)), '\\n')"
