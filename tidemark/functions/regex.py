"""Regex dialect handling.

Rules are published in Python syntax. Spark evaluates ``java.util.regex``;
the DuckDB oracle evaluates RE2. The contract of this package is the ASCII
reading of every class (``\\b``, ``\\d``, ``\\s``, case folding), which both
engines share once two constructs are rewritten for Java:

* ``\\b``: JDK 17 decides word characters by Unicode letter tests, RE2 by
  ASCII, so it becomes an explicit ASCII look-around.
* line ends: Java treats ``\\r`` and U+0085/U+2028/U+2029 as line ends for
  ``.``, ``^`` and ``$``; the ``d`` (UNIX_LINES) flag keeps only ``\\n``.

The strict profile runs rules as written, where ``$`` (no multi-line flag)
means the end of the text, so it becomes ``\\z`` in Java.
"""

from __future__ import annotations

import re

_W = r"\w"   # ASCII in Java, and one look at a table
JAVA_WORD_BOUNDARY = f"(?:(?<={_W})(?!{_W})|(?<!{_W})(?={_W}))"


_WORD_CHARS = set("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789_")


_GROUP = re.compile(r"\(\?(?:<[=!]|P?<\w+>|[=!>:]|[a-zA-Z-]*[:)])")


def _tokens(rx: str):
    """Flat tokens (kind, text): class, esc, open, close, alt, quant, lit."""
    out, i, n = [], 0, len(rx)
    while i < n:
        c = rx[i]
        if c == "\\" and i + 1 < n:
            out.append(("esc", rx[i:i + 2]))
            i += 2
        elif c == "[":
            j = i + 1
            if j < n and rx[j] == "^":
                j += 1
            if j < n and rx[j] == "]":
                j += 1
            while j < n and rx[j] != "]":
                j += 2 if rx[j] == "\\" else 1
            out.append(("class", rx[i:j + 1]))
            i = j + 1
        elif c == "(":
            special = _GROUP.match(rx, i)
            text = special.group() if special else "("
            out.append(("flags" if text.endswith(")") else "open", text))   # inline flags such as (?i)
            i += len(text)
        elif c == ")":
            out.append(("close", c))
            i += 1
        elif c == "|":
            out.append(("alt", c))
            i += 1
        elif c in "*+?{":
            j = i + 1
            if c == "{":
                j = rx.index("}", i) + 1
            if j < n and rx[j] in "?+":
                j += 1
            out.append(("quant", rx[i:j]))
            i = j
        else:
            out.append(("lit", c))
            i += 1
    return out


def _class_is_word(cls: str) -> bool:
    body = cls[1:-1]
    if body.startswith("^"):
        return False
    i = 0
    while i < len(body):
        c = body[i]
        if c == "\\":
            if body[i + 1:i + 2] not in ("d", "w"):
                return False
            i += 2
        elif i + 2 < len(body) and body[i + 1] == "-":
            lo, hi = c, body[i + 2]
            if not any(a <= lo <= hi <= b for a, b in (("0", "9"), ("A", "Z"), ("a", "z"))):
                return False
            i += 3
        else:
            if c not in _WORD_CHARS:
                return False
            i += 1
    return True


def _atom_is_word(tok) -> bool:
    kind, text = tok
    if kind == "class":
        return _class_is_word(text)
    if kind == "esc":
        return text in ("\\d", "\\w")
    return kind == "lit" and text in _WORD_CHARS


def _min_zero(q: str) -> bool:
    return q[0] in "*?" or q.startswith("{0")


def _starts_with_word(toks, k) -> bool:
    """Token k begins every possible match with a word character."""
    if k >= len(toks):
        return False
    kind = toks[k][0]
    if kind in ("class", "esc", "lit"):
        ok = _atom_is_word(toks[k])
        return ok and not (k + 1 < len(toks) and toks[k + 1][0] == "quant" and _min_zero(toks[k + 1][1]))
    if kind != "open":
        return False
    depth, starts, j = 0, [k + 1], k + 1
    while j < len(toks):
        t = toks[j][0]
        if t == "open":
            depth += 1
        elif t == "close":
            if depth == 0:
                break
            depth -= 1
        elif t == "alt" and depth == 0:
            starts.append(j + 1)
        j += 1
    if j + 1 < len(toks) and toks[j + 1][0] == "quant" and _min_zero(toks[j + 1][1]):
        return False
    return all(toks[s][0] in ("class", "esc", "lit") and _atom_is_word(toks[s]) and not (
        s + 1 < len(toks) and toks[s + 1][0] == "quant" and _min_zero(toks[s + 1][1])) for s in starts)


def _ends_with_word(toks, k) -> bool:
    """Token k-1 (the one before a boundary) ends every match with a word
    character."""
    j = k - 1
    if j < 0:
        return False
    if toks[j][0] == "quant":
        if _min_zero(toks[j][1]):
            return False
        j -= 1
    return j >= 0 and toks[j][0] in ("class", "esc", "lit") and _atom_is_word(toks[j])


_SETS = {"d": range(0x30, 0x3a), "s": (9, 10, 11, 12, 13, 32), "w": [ord(c) for c in sorted(_WORD_CHARS)]}


def _class_members(body: str) -> set[int] | None:
    """The members of a class of ASCII characters, ranges and sets; None for any other."""
    out, i, low, joined = set(), 0, None, False
    while i < len(body):
        c, n = body[i], 1
        if c == "\\":
            c, n = body[i + 1:i + 2], 2
            if not joined and c in _SETS:
                out.update(_SETS[c])
                low, i = None, i + 2
                continue
            if not c or c.isalnum():
                return None
        elif c in "[&^":
            return None
        if ord(c) > 127:
            return None
        if joined:
            out.update(range(low, ord(c) + 1))
            low, joined = None, False
        elif n == 1 and c == "-" and low is not None and i + 1 < len(body):
            joined = True
        else:
            out.add(ord(c))
            low = ord(c)
        i += n
    return out


def java_classes(rx: str) -> str:
    """Write the classes of ``rx`` out, member by member: Java keeps such a class
    as one table of 256, and one of ranges and sets as a chain of tests."""
    out = []
    for kind, text in _tokens(rx):
        neg = text.startswith("[^")
        members = _class_members(text[2 if neg else 1:-1]) if kind == "class" else None
        if members:
            text = ("[^" if neg else "[") + "".join(chr(m) if chr(m).isalnum() else f"\\x{m:02x}" for m in sorted(members)) + "]"
        out.append(text)
    return "".join(out)


def java_boundaries(rx: str) -> str:
    """Rewrite every ``\\b`` for Java: one-sided look-around where the
    neighbouring token can only be a word character (half the cost), the
    two-sided ASCII form otherwise."""
    toks = _tokens(rx)
    out = []
    for k, (kind, text) in enumerate(toks):
        if kind == "esc" and text == "\\b":
            if _starts_with_word(toks, k + 1):
                out.append(f"(?<!{_W})")
            elif _ends_with_word(toks, k):
                out.append(f"(?!{_W})")
            else:
                out.append(JAVA_WORD_BOUNDARY)
        else:
            out.append(text)
    return "".join(out)


def _rewrite(rx: str, boundary: str | None, dollar: str | None) -> str:
    """Replace unescaped ``\\b`` / ``$`` outside character classes."""
    out = []
    i, n, in_class = 0, len(rx), False
    while i < n:
        c = rx[i]
        if c == "\\" and i + 1 < n:
            nxt = rx[i + 1]
            if nxt == "b" and not in_class and boundary is not None:
                out.append(boundary)
            else:
                out.append(c + nxt)
            i += 2
            continue
        if in_class:
            if c == "]":
                in_class = False
        elif c == "[":
            in_class = True
            # a ']' right after '[' or '[^' is a literal member
            out.append(c)
            i += 1
            if i < n and rx[i] == "^":
                out.append("^")
                i += 1
            if i < n and rx[i] == "]":
                out.append("]")
                i += 1
            continue
        elif c == "$" and dollar is not None:
            out.append(dollar)
            i += 1
            continue
        out.append(c)
        i += 1
    return "".join(out)


def java_regex(rx: str, profile: str = "broad") -> str:
    """Rule text → pattern for Spark's ``regexp_*`` functions."""
    rx = re.sub(r"\(\?P=(\w+)\)", r"\\k<\1>", rx).replace("(?P<", "(?<")  # named groups
    if profile == "broad":
        # the broad tool forces IGNORECASE | MULTILINE on every rule
        return "(?dim)" + java_classes(java_boundaries(rx))
    return "(?d)" + java_classes(java_boundaries(_rewrite(rx, None, r"\z")))


def re2_regex(rx: str, profile: str = "broad") -> str:
    """Rule text → pattern for DuckDB (RE2); ASCII ``\\b`` already."""
    if profile == "broad":
        return "(?im)" + rx
    return rx


def java_class(chars: str) -> str:
    """A Java character class holding exactly ``chars``."""
    return "[" + "".join(f"\\u{ord(c):04x}" for c in chars) + "]"


def re2_class(chars: str) -> str:
    """An RE2 character class holding exactly ``chars``."""
    return "[" + "".join(f"\\x{{{ord(c):x}}}" for c in chars) + "]"


#: texts on which a rule that can match nothing at all shows it
_PROBES = ("", "a", "0", " a_0.\n-A")


def validate_java(spark, rx: str) -> str | None:
    """Compile ``rx`` with the JVM's regex engine; the error text or None.

    A bad pattern otherwise fails the task that first meets it, so rules are
    checked on the driver before any plan is built. A pattern that matches
    the empty string is refused too: its findings would hold no text.
    """
    jvm = spark.sparkContext._jvm
    try:
        pattern = jvm.java.util.regex.Pattern.compile(rx)
    except Exception as exc:  # py4j wraps PatternSyntaxException
        msg = str(exc)
        for line in msg.splitlines():
            if "PatternSyntaxException" in line or "IllegalArgument" in line:
                return line.strip()
        return msg.strip().splitlines()[0] if msg.strip() else "invalid regex"
    for probe in _PROBES:
        found = pattern.matcher(probe)
        while found.find():
            if found.start() == found.end():
                return "the rule matches the empty string"
    return None
