"""Terms to one boolean column.

Columns expected: event_id_source, level, message, raw, fields, timestamp_utc, sourcetype and path; where the virtual
columns are stored (``stored``), they are read as they are, so that comparisons with them reach the scan.  Terms on tags
are conditions on rows of tags (:func:`tag_condition`); the timeline joins them.  Three-valued logic is kept: a negated
comparison with a null is null, so the row is left out.
"""

from __future__ import annotations

from functools import reduce

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.extract import PATHS, virtual
from tidemark.functions.regex import BadPattern, to_java
from tidemark.operators.grammar import Kind, Term, parse_time

#: Stored columns behind keywords, and keywords that search within their column.
_STORED = {"level": "level", "sourcetype": "sourcetype", "source_id": "event_id_source", "source": "path", "message": "message", "raw": "raw"}
_WITHIN = ("source", "message", "raw")
_VIRTUAL = {"event_id": "event_code"} | {k: k for k in PATHS if k != "event_code"}


def java_pattern(pattern: str) -> str:
    """The translated pattern; one that only Java's compiler rejects (an unknown property, say) is bad, too."""
    java, spark = to_java(pattern), SparkSession.getActiveSession()
    if spark is not None and hasattr(spark, "_jvm"):
        try:
            spark._jvm.java.util.regex.Pattern.compile(java)
        except Py4JJavaError as e:
            raise BadPattern(str(e.java_exception.getMessage())) from None
    return java


def needs_sources(terms: list[Term], stored: bool = False) -> bool:
    """Whether a term reads a column of the sources table; stored entries have their sourcetype."""
    return any(t.field == "source" or not stored and (t.field == "sourcetype" or t.field in _VIRTUAL) for t in terms)


def _column(field: str, stored: bool) -> Column:
    if field in _STORED:
        return F.col(_STORED[field])
    return F.col(_VIRTUAL[field]) if stored else virtual(_VIRTUAL[field])


def tag_condition(term: Term) -> Column:
    """Which rows of tags a term asks for, its negation aside."""
    if term.regex:
        return F.col("tag_value").rlike(java_pattern(term.value))
    return F.lit(True) if term.value == "*" else F.col("tag_value") == term.value


def _bound(term: Term) -> Column:
    at = parse_time(term.value)
    if at is None:
        return F.lit(False)
    limit = F.expr(f"TIMESTAMP_NTZ '{at.isoformat(sep=' ', timespec='microseconds')}'")
    return F.col("timestamp_utc") >= limit if term.field == "after" else F.col("timestamp_utc") <= limit


def compile_term(term: Term, stored: bool = False, tagged: Column | None = None) -> Column:
    """``tagged``: for a term on tags, a column that says whether the row has such a tag (never null)."""
    if term.kind is Kind.TEXT:
        found = F.col("message").contains(term.value) | F.col("raw").contains(term.value)
    elif term.field == "tag":
        found = tagged
    elif term.field in ("after", "before"):
        found = _bound(term)
    elif term.regex:
        found = _column(term.field, stored).rlike(java_pattern(term.value))
    elif term.field in _WITHIN:
        found = _column(term.field, stored).contains(term.value)
    else:
        found = _column(term.field, stored) == term.value
    return ~found if term.negated else found


def check_patterns(terms: list[Term]) -> None:
    """An error for a pattern that is no regular expression, wherever it stands."""
    for t in terms:
        if t.regex and t.field not in ("after", "before"):
            java_pattern(t.value)


def fold(terms: list[Term], conditions: list[Column]) -> Column:
    """Terms fold from left to right, without precedence."""
    pairs = list(zip(terms, conditions))
    return reduce(lambda acc, p: acc | p[1] if p[0].is_or else acc & p[1], pairs[1:], pairs[0][1])


def conjuncts(terms: list[Term]) -> tuple[list[Term], list[Term]]:
    """The terms up to the last OR, which are one condition, and those after it, each of which must hold by itself."""
    last = max((k for k, t in enumerate(terms) if t.is_or and k), default=-1)
    return terms[: last + 1], terms[last + 1 :]
