"""What the text of an entry must hold for a query to match it: literals joined by *all* and *any*.

A requirement is ``bytes`` (the text holds them), ``("all", [...])``, ``("any", [...])``, or None where nothing is known.
It may ask for less than the query does, never for more.
"""

from __future__ import annotations

from re import IGNORECASE, _parser

from tidemark.operators.compiler import conjuncts
from tidemark.operators.grammar import Kind, Term

type Need = bytes | tuple[str, list[Need]] | None

#: Literals shorter than this have no trigram.
SHORTEST = 3


def both(a: Need, b: Need) -> Need:
    return a if b is None else b if a is None else ("all", [a, b])


def either(a: Need, b: Need) -> Need:
    return None if a is None or b is None else ("any", [a, b])


def of_literal(text: str) -> Need:
    raw = text.encode("utf-8", "surrogatepass")
    return raw if len(raw) >= SHORTEST else None


def _of_parsed(parsed) -> Need:
    need, run = None, ""

    def flush() -> None:
        nonlocal need, run
        need, run = both(need, of_literal(run)), ""

    for op, arg in parsed:
        name = str(op)
        if name == "LITERAL" and not 0xD800 <= arg <= 0xDFFF:
            run += chr(arg)
            continue
        if name == "AT":
            continue  # a place between characters
        flush()
        if name == "SUBPATTERN":
            _, added, _, inner = arg
            if not added & IGNORECASE:
                need = both(need, _of_parsed(inner))
        elif name in ("MAX_REPEAT", "MIN_REPEAT") and arg[0] >= 1:
            need = both(need, _of_parsed(arg[2]))
        elif name == "BRANCH":
            parts = [_of_parsed(p) for p in arg[1]]
            if all(p is not None for p in parts):
                need = both(need, ("any", parts))
    flush()
    return need


def of_pattern(pattern: str) -> Need:
    """What every match of a pattern holds.  Patterns that Python reads in another way than RE2 does, or not at all, ask for nothing."""
    if "[:" in pattern:
        return None
    try:
        parsed = _parser.parse(pattern)
    except Exception:  # whatever Python's parser has against it
        return None
    return None if parsed.state.flags & IGNORECASE else _of_parsed(parsed)


def of_term(term: Term) -> Need:
    """What message or raw must hold; a negated term, and one on another column, ask for nothing."""
    if term.negated:
        return None
    if term.kind is Kind.TEXT:
        return of_literal(term.value)
    if term.field in ("message", "raw"):
        return of_pattern(term.value) if term.regex else of_literal(term.value)
    return None


def of_query(terms: list[Term]) -> Need:
    """As the query folds: the terms up to the last OR from left to right, and each of the others."""
    group, each = conjuncts(terms)
    need = None
    for k, t in enumerate(group):
        need = of_term(t) if k == 0 else either(need, of_term(t)) if t.is_or else both(need, of_term(t))
    for t in each:
        need = both(need, of_term(t))
    return need


def trigrams(literal: bytes) -> list[int]:
    """The distinct trigrams of a literal, ascending; each is its three bytes as one number."""
    return sorted({literal[k] << 16 | literal[k + 1] << 8 | literal[k + 2] for k in range(len(literal) - 2)})


def literals(need: Need) -> list[bytes]:
    """The distinct literals of a requirement."""
    if need is None:
        return []
    return [need] if isinstance(need, bytes) else list(dict.fromkeys(x for part in need[1] for x in literals(part)))
