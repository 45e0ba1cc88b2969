"""Number parsing, ratios and scores."""

from __future__ import annotations

from opsmeter.functions.text import quote, stripped

# Fixed value: the spellings of infinity that read as a number.
INFINITY_SHAPE = r"(?i)^[+-]?inf(inity)?$"


def parse_number(value: str) -> str:
    """Double of a text; null when the text is neither a number nor a spelled infinity.

    A number too large for a double is null, as is ``nan``. Spark also reads Java's
    suffixed and hexadecimal literals (``1d``, ``0x1p3``), which are no numbers here.
    """
    number = f"try_cast({value} AS DOUBLE)"
    java_only = " OR ".join(f"contains({value}, '{letter}')" for letter in "dDfFxX")
    return f"""CASE
        WHEN {number} IS NULL OR isnan({number}) THEN NULL
        WHEN abs({number}) = CAST('Infinity' AS DOUBLE) OR {java_only}
             THEN IF({stripped(value)} RLIKE {quote(INFINITY_SHAPE)}, {number}, NULL)
        ELSE {number} END"""


def known_number(value: str) -> str:
    """A number as a double, with NaN turned into null."""
    return f"nullif(CAST({value} AS DOUBLE), CAST('NaN' AS DOUBLE))"


def share(part: str, whole: str) -> str:
    """``part / whole`` as a double, null for an empty whole."""
    return f"try_divide(CAST({part} AS DOUBLE), CAST({whole} AS DOUBLE))"


def at_least_one(count: str) -> str:
    return f"greatest({count}, 1)"


def rounded_ratio(part: str, whole: str, digits: int) -> str:
    """``part / whole`` rounded half up, null for a zero whole.

    Both sides are whole numbers, so the quotient is the double closest to the
    true one and a tie such as 3/96 still rounds up.
    """
    return f"round({share(part, whole)}, {digits})"


def rounded_rate(part: str, whole: str, digits: int) -> str:
    """``rounded_ratio``, but 0 for a zero whole."""
    return f"IF({whole} = 0, 0D, {rounded_ratio(part, whole, digits)})"


def clamp(value: str, low: float, high: float) -> str:
    """Keep within [low, high]; null comes out as ``high``."""
    return f"greatest({low}D, least({high}D, {value}))"


def mean(values: list[str]) -> str:
    """Mean of some columns of a row; null when one of them is null."""
    return f"(({' + '.join(values)}) / {len(values)}D)"


def first_largest(named: dict[str, str]) -> str:
    """Name of the largest value; the earliest name wins a tie."""
    ranked = [
        f"struct({value} AS size, {-place} AS place, {quote(name)} AS name)"
        for place, (name, value) in enumerate(named.items())
    ]
    return f"greatest({', '.join(ranked)}).name"
