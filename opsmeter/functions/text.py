"""Text tests and text renderings."""

from __future__ import annotations

# The characters that count as blank space.
WHITESPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0"
    "\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
)

# Fixed value: the shape of an e-mail address; \s stands for WHITESPACE, and $
# also matches before one closing newline.
EMAIL_SHAPE = r"^[^@\s]+@[^@\s]+\.[^@\s]+$"


def quote(text: str) -> str:
    """A SQL string literal."""
    escaped = text.replace("\\", "\\\\").replace("'", "\\'")
    return "'" + "".join(c if " " <= c <= "~" else f"\\u{ord(c):04x}" for c in escaped) + "'"


def stripped(value: str) -> str:
    return f"btrim(CAST({value} AS STRING), {quote(WHITESPACE)})"


def is_blank(value: str) -> str:
    """Null, or nothing left after stripping white space.

    A printable ASCII character in front settles it without the costly stripping.
    """
    return (
        f"({value} IS NULL OR (ascii(CAST({value} AS STRING)) NOT BETWEEN 33 AND 126"
        f" AND {stripped(value)} = ''))"
    )


def has_email_shape(value: str) -> str:
    # Java's \s is ASCII only and its $ knows more line ends than "\n":
    # spell the class out and switch to unix lines (?d).
    shape = "(?d)" + EMAIL_SHAPE.replace(r"\s", WHITESPACE)
    return f"({value} RLIKE {quote(shape)})"


def outside(value: str, allowed: list[str]) -> str:
    """Not one of ``allowed``; a null is outside too."""
    members = ", ".join(quote(item) for item in allowed)
    return f"coalesce({value} NOT IN ({members}), true)"


def text_or_nan(value: str) -> str:
    """Text of a value, with the literal ``nan`` for a null."""
    return f"coalesce(CAST({value} AS STRING), 'nan')"


def float_text(value: str) -> str:
    """Shortest decimal text of a double: plain digits from 1e-4 up to 1e16,
    ``1.5e+16`` / ``1e-05`` beyond, ``inf`` and ``nan`` in lower case."""
    raw = f"CAST({value} AS STRING)"
    power = f"try_cast(substring_index({raw}, 'E', -1) AS INT)"
    mantissa = f"regexp_replace(substring_index({raw}, 'E', 1), '[.]0$', '')"
    digits = f"CAST(try_cast({value} AS DECIMAL(38,20)) AS STRING)"
    plain = f"regexp_replace(regexp_replace({digits}, '0+$', ''), '[.]$', '.0')"
    return f"""CASE
        WHEN {value} IS NULL OR isnan({value}) THEN 'nan'
        WHEN {raw} = 'Infinity' THEN 'inf'
        WHEN {raw} = '-Infinity' THEN '-inf'
        WHEN NOT contains({raw}, 'E') THEN {raw}
        WHEN {power} BETWEEN -4 AND 15 THEN {plain}
        ELSE concat({mantissa}, IF({power} < 0, 'e-', 'e+'),
                    IF(abs({power}) < 10, '0', ''), abs({power}))
        END"""
