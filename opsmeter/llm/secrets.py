"""Secrets in texts, and weak candidates next to parts that complete them; SQL only."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from opsmeter.llm.common import fresh, stored, utf8


@dataclass(frozen=True)
class Kind:
    """A pattern; ``keep`` (SQL with ``{m}`` for the match) says which matches stay."""

    name: str
    pattern: str
    hint: str  # a simpler pattern that is found in every text with a match that stays
    keep: str = "true"


# The base kinds, in their order. Where a pattern has no other choice than to
# take a whole run of characters, its least length stands in the pattern instead of ``keep``.
ASSIGN = (
    "(?i:password|passwd|secret|token|api_?key)[\"']?\\x20*[:=]\\x20*[\"']?([A-Za-z0-9+/_.=-]+)"
)
BASE = (
    Kind("assign", ASSIGN, "(?i:passw|secret|token|api_?key)", "length(regexp_extract({m}, {pattern}, 1)) >= 6"),
    Kind("access", "AKIA[A-Z0-9]{16,}", "AKIA[A-Z0-9]{16}"),
    Kind("hex", "[0-9a-f]{24,}", "[0-9a-f]{24}"),
)
# Weak by themselves: an opaque word of a secret key's length, and a service's address.
WEAK = (
    Kind(
        "key",
        "(?<![A-Za-z0-9/+])[A-Za-z0-9/+]{40}(?![A-Za-z0-9/+])",
        "[A-Za-z0-9/+]{40}",
        "{m} RLIKE '[A-Z]' AND {m} RLIKE '[a-z]' AND {m} RLIKE '[0-9]'",
    ),
    Kind("endpoint", "https?://[A-Za-z0-9][A-Za-z0-9.-]*", "https?://[A-Za-z0-9]"),
)
# which strong parts complete a weak one: a key needs an identifier, an address any secret
COMPLEMENTS = {"key": ("access",), "endpoint": ("access", "assign")}
# code points between two parts that belong together
SCOPE = 256

# ``first`` and ``last`` are the span's bytes in UTF-8, from 0, ``last`` exclusive
SPANS = "ARRAY<STRUCT<start: BIGINT, rank: INT, end: BIGINT, kind: STRING, first: BIGINT, last: BIGINT>>"
_NONE = f"cast(array() AS {SPANS})"


def _text(value: str) -> str:
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _spans(kind: Kind, rank: int, text: str) -> str:
    """SQL: the kind's spans in ``text`` by start, in code points, end exclusive.

    ``regexp_extract_all`` returns the matches from left to right without overlap but not
    their places. ``split`` by the same pattern returns what lies between them, so a match
    starts after all earlier parts and matches. These are summed within runs of matches,
    whose length is the cube root of their number, then over the runs: appending to one array
    would copy all earlier ones for each match. Texts without the hint skip all that.
    """
    pattern = _text(kind.pattern)
    keep = kind.keep.format(m="x.m", pattern=pattern)
    inside = f"""aggregate(run, struct(0L AS at, 0L AS byte, {_NONE} AS found),
        (acc, x) -> struct(
            acc.at + length(x.g) + coalesce(length(x.m), 0) AS at,
            acc.byte + octet_length(x.g) + coalesce(octet_length(x.m), 0) AS byte,
            IF(x.m IS NOT NULL AND {keep},
               concat(acc.found, array(named_struct(
                   'start', acc.at + length(x.g), 'rank', {rank},
                   'end', acc.at + length(x.g) + length(x.m), 'kind', '{kind.name}',
                   'first', acc.byte + octet_length(x.g),
                   'last', acc.byte + octet_length(x.g) + octet_length(x.m)))),
               acc.found) AS found))"""
    # of each run: what lies before it
    before = """aggregate(runs, struct(0L AS at, 0L AS byte, cast(array() AS ARRAY<STRUCT<at: BIGINT, byte: BIGINT>>) AS all),
        (acc, r) -> struct(acc.at + r.at AS at, acc.byte + r.byte AS byte,
                           concat(acc.all, array(struct(acc.at AS at, acc.byte AS byte))) AS all),
        acc -> acc.all)"""
    shifted = f"""flatten(zip_with(runs, {before}, (r, b) -> transform(r.found, s -> named_struct(
        'start', b.at + s.start, 'rank', s.rank, 'end', b.at + s.end, 'kind', s.kind,
        'first', b.byte + s.first, 'last', b.byte + s.last))))"""
    parts = f"""zip_with(regexp_extract_all({text}, {pattern}, 0), split({text}, {pattern}, -1),
        (m, g) -> named_struct('m', m, 'g', g))"""
    size = "cast(greatest(32, cbrt(size(parts))) AS INT)"
    runs = f"""transform(sequence(0, (size(parts) - 1) div {size}),
        i -> transform(array(slice(parts, i * {size} + 1, {size})), run -> {inside})[0])"""
    found = f"transform(array({parts}), parts -> transform(array({runs}), runs -> {shifted})[0])[0]"
    return f"CASE WHEN {text} RLIKE {_text(kind.hint)} THEN {found} ELSE {_NONE} END"


def _all(kinds: tuple[Kind, ...], first: int, text: str) -> str:
    parts = ", ".join(_spans(kind, first + i, text) for i, kind in enumerate(kinds))
    return f"sort_array(concat({parts}))"


def scanned(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, digest, base, weak, key``: each row's own matches, and its text's digest.

    The key is the digest where both kinds of spans are found, else null. Stored, since
    several steps read it: spans only, no texts.
    """
    rows = docs.selectExpr(f"cast(`{doc_id}` AS BIGINT) AS doc_id", f"{utf8(text)} AS text")
    found = rows.selectExpr(
        "doc_id",
        "sha2(cast(text AS BINARY), 256) AS digest",
        f"{_all(BASE, 0, 'text')} AS base",
        f"{_all(WEAK, len(BASE), 'text')} AS weak",
    )
    return stored(found.selectExpr("*", "IF(size(base) > 0 AND size(weak) > 0, digest, NULL) AS key"), "spans")


def linked(found: DataFrame, scope: int = SCOPE) -> DataFrame:
    """``key, extra``: the weak spans of each text that lie within ``scope`` of a complement.

    An interval join: strong parts go to the cells of ``scope`` code points that their
    surroundings touch, weak parts to all cells from their start's to their end's, and
    parts meet by text and cell, then by distance. Equal texts are joined once; a cell
    holds at most ``scope`` starts of a kind, whatever the text's length.
    """
    texts = found.where("key IS NOT NULL").groupBy("key").agg(
        F.first("base").alias("base"), F.first("weak").alias("weak")
    )
    texts = stored(texts, "texts")
    rules = " OR ".join(
        f"(w.kind = '{weak}' AND s.kind IN ({', '.join(map(_text, strong))}))"
        for weak, strong in COMPLEMENTS.items()
    )
    strong = (
        texts.selectExpr("key", "explode(base) AS s")
        .where("s.kind <> 'hex'")
        .selectExpr(
            "key", "s",
            f"explode(sequence((s.start - {scope}) div {scope}, (s.end + {scope}) div {scope})) AS cell",
        )
    )
    weak = texts.selectExpr("key", "explode(weak) AS w").selectExpr(
        "key", "w", f"explode(sequence(w.start div {scope}, w.end div {scope})) AS cell"
    )
    near = f"w.start <= s.end + {scope} AND s.start <= w.end + {scope} AND ({rules})"
    # a semi join: each weak part once a cell, however many strong parts are near; the set once in all
    return (
        weak.alias("a")
        .join(strong.alias("b"), F.expr(f"a.key = b.key AND a.cell = b.cell AND {near}"), "left_semi")
        .groupBy("key")
        .agg(F.sort_array(F.collect_set("w")).alias("extra"))
    )


def secret_spans(
    docs: DataFrame, scope: int = SCOPE, doc_id: str = "doc_id", text: str = "text"
) -> DataFrame:
    """``doc_id, base, extra`` of every row: base spans, and weak ones with their complement.

    Spans are ``(start, rank, end, kind)`` in code points, end exclusive, sorted; ``rank``
    is the kind's place among the kinds. Whole texts are scanned whatever their length.
    Null texts count as empty and have no spans. Null ids and repeated rows get a row each;
    equal texts get equal spans. Further columns are ignored; an empty table gives no rows.
    """
    return _with_links(scanned(docs, doc_id, text), scope).select("doc_id", "base", "extra")


def _with_links(found: DataFrame, scope: int) -> DataFrame:
    """``found`` with ``extra``; rows without a key, nearly all, stay out of the join."""
    links = stored(linked(found, scope), "links")
    keyed = found.where("key IS NOT NULL").join(links, "key", "left")
    columns = ["doc_id", "digest", "base", "weak"]
    return found.where("key IS NULL").selectExpr(*columns, f"{_NONE} AS extra").union(
        keyed.selectExpr(*columns, f"coalesce(extra, {_NONE}) AS extra")
    )


def _joined(spans: str) -> str:
    return f"array_join(transform({spans}, s -> concat_ws(':', s.kind, s.start, s.end)), ',')"


def digests(spans: DataFrame) -> DataFrame:
    """Counts of the base kinds, the digest of the base spans, and all spans as text."""
    counts = [
        f"cast(size(filter(base, s -> s.kind = '{kind.name}')) AS BIGINT) AS n_{kind.name}" for kind in BASE
    ]
    return spans.selectExpr(
        "doc_id",
        *counts,
        f"sha2(cast({_joined('base')} AS BINARY), 256) AS base_sha256",
        f"{_joined('sort_array(concat(base, extra))')} AS spans",
    )


def redacted(docs: DataFrame, scope: int = SCOPE, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with every span in the text replaced by its kind in brackets.

    Of overlapping spans the first names the whole. Rows without spans, and null texts, stay
    as they are. Spans are looked up by the text's digest, so ids may repeat or be null.
    All columns stay, whatever their names.

    Overlaps are found by windows over each text's spans, and the text is cut by bytes, so
    the work grows with the spans and the text.
    """
    cut_digest, cuts_of = fresh(docs, "cut_digest", "cut_spans")
    spans = (
        _with_links(scanned(docs, doc_id, text), scope)
        .where("size(base) > 0")
        .groupBy("digest")
        .agg(F.first(F.expr("concat(base, extra)")).alias("spans"))
        .selectExpr("digest", "inline(spans)")
    )
    order = "OVER (PARTITION BY digest ORDER BY start, rank, end ROWS UNBOUNDED PRECEDING)"
    reach = order.replace("ROWS UNBOUNDED PRECEDING", "ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING")
    cuts = (
        spans.selectExpr("*", f"start >= coalesce(max(end) {reach}, 0L) AS heads")
        .selectExpr("*", f"count_if(heads) {order} AS place")
        .groupBy("digest", "place")
        .agg(F.expr("min(first) AS first"), F.expr("max(last) AS last"), F.expr("max_by(kind, heads) AS kind"))
        .groupBy(F.col("digest").alias(cut_digest))
        .agg(F.sort_array(F.collect_list(F.struct("first", "last", "kind"))).alias(cuts_of))
    )
    body = f"cast({utf8(text)} AS BINARY)"

    def piece(start: str, stop: str) -> str:
        return f"cast(substring(b, cast({start} + 1 AS INT), cast({stop} - {start} AS INT)) AS STRING)"

    kept_before = piece(f"IF(i = 0, 0L, {cuts_of}[greatest(i - 1, 0)].last)", "s.first")
    # the text's bytes are named once: each mention would copy them
    cut = f"""transform(array({body}), b -> concat(
        array_join(transform({cuts_of}, (s, i) -> concat({kept_before}, '[', s.kind, ']')), ''),
        {piece(f"element_at({cuts_of}, -1).last", "octet_length(b)")}))[0]"""
    columns = [
        f"IF({cuts_of} IS NULL, `{c}`, {cut}) AS `{c}`" if c == text else f"`{c}`" for c in docs.columns
    ]
    same = F.expr(f"sha2({body}, 256)") == F.col(cut_digest)
    # texts with secrets grow with the input: no broadcast, whatever this input's size
    return docs.join(stored(cuts, "cuts").hint("merge"), same, "left").selectExpr(*columns)
