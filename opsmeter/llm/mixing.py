"""Sources mixed to target weights: a splitting tree deals blocks of words out to shards; SQL only."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from opsmeter.llm.common import scratch, stored, utf8

WORD = "[^\\x20\\x09-\\x0D]+"
# rows of one source that one task sorts
BUCKET_ROWS = 2_000
# buckets of a source summed together
BUCKET_RUN = 1_024
# copies of one row that one task lists
COPY_RUN = 10_000
# rounds of the permutation of a source's blocks
ROUNDS = 24


@dataclass(frozen=True)
class Recipe:
    """What the mix is made of. Sources weigh ``weights`` in turn, by code point, null last.

    All targets together are ``share`` times the words there are; no word is taken more
    than ``limit`` times. Blocks hold ``block`` words and go to ``shards`` shards.
    """

    weights: tuple[float, ...] = (5, 2, 1)
    share: float = 1.5
    limit: int = 2
    block: int = 1024
    shards: int = 24
    seed: int = 11


def word_count(text: str = "text") -> str:
    """SQL: how many words the text has."""
    pattern = WORD.replace("\\", "\\\\")
    return f"cast(regexp_count({utf8(text)}, '{pattern}') AS BIGINT)"


def _let(name: str, value: str, body: str) -> str:
    """SQL: ``body`` with ``name`` standing for ``value``, which is computed once."""
    return f"element_at(transform(array({value}), {name} -> {body}), 1)"


def hypergeometric(total: str, marked: str, drawn: str, chance: str) -> str:
    """SQL: how many of ``drawn`` items out of ``total`` are among the ``marked`` ones.

    Inverse transform from the mode outwards: the probabilities of the numbers next to the
    mode follow from its own by ratios, first summed, then subtracted from ``chance`` (a
    number in [0, 1)) times that sum, one above and one below in turn, until nothing is
    left. What lies more than 14 standard deviations and 30 items off weighs less than a
    double can tell.
    """
    n, q, k = "t.n", "t.q", "t.k"
    other = f"({n} - {q} - {k})"
    up = f"(cast({q} - t.m - i + 1 AS DOUBLE) * ({k} - t.m - i + 1) / (cast(t.m + i AS DOUBLE) * ({other} + t.m + i)))"
    down = f"(cast(t.m - i + 1 AS DOUBLE) * ({other} + t.m - i + 1) / (cast({q} - t.m + i AS DOUBLE) * ({k} - t.m + i)))"
    steps = "IF(t.steps < 1, cast(array() AS ARRAY<BIGINT>), sequence(1L, t.steps))"
    summed = f"""aggregate({steps}, struct(1D AS up, 1D AS down, 1D AS total), (a, i) ->
        struct(a.up * {up} AS up, a.down * {down} AS down, a.total + a.up * {up} + a.down * {down} AS total),
        a -> a.total)"""
    searched = f"""aggregate({steps},
        struct(1D AS up, 1D AS down, {chance} * w - 1D AS rest, IF({chance} * w < 1D, t.m, NULL) AS found),
        (a, i) -> struct(a.up * {up} AS up, a.down * {down} AS down,
            a.rest - a.up * {up} - a.down * {down} AS rest,
            CASE WHEN a.found IS NOT NULL THEN a.found
                 WHEN a.rest - a.up * {up} < 0 THEN t.m + i
                 WHEN a.rest - a.up * {up} - a.down * {down} < 0 THEN t.m - i END AS found),
        a -> coalesce(a.found, t.m))"""
    least = f"greatest(0L, {drawn} - ({total} - {marked}))"
    most = f"least({drawn}, {marked})"
    mode = f"cast(floor(({drawn} + 1D) * ({marked} + 1D) / ({total} + 2D)) AS BIGINT)"
    share = f"({marked} / greatest({total}, 1D))"
    spread = f"""sqrt(greatest({drawn} * {share} * (1 - {share}) * ({total} - {drawn})
        / greatest({total} - 1D, 1D), 0D))"""
    state = f"""struct({total} AS n, {marked} AS q, {drawn} AS k,
        least(greatest({mode}, {least}), {most}) AS m,
        least({most} - {least}, cast(ceil(14 * {spread}) AS BIGINT) + 30L) AS steps)"""
    return _let("t", state, _let("w", summed, searched))


def sized(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """``doc_id, source, digest, size, copies`` of every row, equal rows counted; stored."""
    rows = docs.selectExpr(
        f"cast(`{doc_id}` AS BIGINT) AS doc_id",
        f"cast(`{source}` AS STRING) AS source",
        f"xxhash64({utf8(text)}) AS digest",
        f"{word_count(text)} AS size",
    )
    return stored(
        rows.groupBy("doc_id", "source", "digest", "size").agg(F.count(F.lit(1)).alias("copies")), "sizes"
    )


def targets(sizes: DataFrame, recipe: Recipe) -> DataFrame:
    """One row per source: its number, size, weight, ``target``, and its blocks and quota.

    Weighted shares level off like water: sources are filled in the order of limit over
    weight, each one up to its limit as long as the level that is left for the others lies
    above; the rest share by weight. The windows go over sources, one row each, not over rows.

    ``words`` is the target in whole words. A source of ``size`` words has ``full`` blocks
    and maybe a shorter one; ``quota`` blocks, counted with repeats, hold ``words``.
    """
    weights = ", ".join(f"{float(w)}D" for w in recipe.weights)
    found = sizes.groupBy("source").agg(
        F.expr("sum(size * copies)").alias("source_size"), F.count(F.lit(1)).alias("rows")
    )
    numbered = found.selectExpr(
        "*", "cast(row_number() OVER (ORDER BY source ASC NULLS LAST) - 1 AS INT) AS src"
    ).selectExpr(
        "*",
        f"element_at(array({weights}), src % {len(recipe.weights)} + 1) AS weight",
        f"cast({recipe.limit} * source_size AS DOUBLE) AS most",
        f"{recipe.share} * sum(source_size) OVER () AS all_words",
    )
    order = "OVER (ORDER BY most / weight, src ROWS BETWEEN"
    levels = numbered.selectExpr(
        "*",
        f"""(all_words - coalesce(sum(most) {order} UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
            / sum(weight) {order} CURRENT ROW AND UNBOUNDED FOLLOWING) AS level""",
    )
    level = "min_by(level, IF(level < most / weight, struct(most / weight, src), NULL)) OVER ()"
    block = recipe.block
    return levels.selectExpr(
        "src", "source", "rows", "source_size",
        f"least(most, coalesce({level} * weight, most)) AS target",
    ).selectExpr(
        "*",
        "cast(round(target) AS BIGINT) AS words",
        f"source_size div {block} AS full",
        f"(source_size + {block - 1}) div {block} AS blocks",
    ).selectExpr(
        "*",
        f"""IF(source_size = 0, 0L, (words div source_size) * blocks
            + (words % source_size + {block - 1}) div {block}) AS quota""",
    )


def splitting_tree(quotas: DataFrame, shards: int, seed: int) -> DataFrame:
    """``shard, quotas`` for every shard: how many blocks of each source it gets.

    ``quotas`` is one row ``(quotas array<bigint>)``. Every node splits its shards in halves;
    how many of each source's blocks go to the left one is a multivariate hypergeometric
    draw, source after source out of what is left, so all quotas are kept exactly, and
    the halves hold as many blocks as their shards need, which differ by one at most.
    Each level is one row per node; the numbers per level are the sources times the nodes.
    """
    total = "aggregate(quotas, 0L, (a, x) -> a + x)"
    nodes = quotas.selectExpr("0 AS lo", f"{shards} AS hi", "quotas", f"{total} AS every")
    chance = f"(shiftrightunsigned(xxhash64({seed}, lo, hi, x.place), 11) * power(2D, -53))"
    held = "((b.mid - lo) * (every div {s}) + least(b.mid, every % {s}) - least(lo, every % {s}))"
    draw = f"""aggregate(transform(quotas, (q, place) -> struct(q, place)),
        struct({total} AS rest, {held.format(s=shards)} AS room, cast(array() AS ARRAY<BIGINT>) AS drawn),
        (a, x) -> {_let("d", hypergeometric("a.rest", "x.q", "a.room", chance),
            "struct(a.rest - x.q AS rest, a.room - d AS room, concat(a.drawn, array(d)) AS drawn)")},
        a -> a.drawn)"""
    for _ in range((shards - 1).bit_length()):
        # leaves that are reached early pass on unchanged
        nodes = nodes.selectExpr(
            "*", f"IF(hi - lo < 2, quotas, {_let('b', 'struct(cast((lo + hi) div 2 AS INT) AS mid)', draw)}) AS left"
        ).selectExpr(
            "every",
            """explode(IF(hi - lo < 2, array(struct(lo, hi, quotas)), array(
                struct(lo, cast((lo + hi) div 2 AS INT) AS hi, left AS quotas),
                struct(cast((lo + hi) div 2 AS INT) AS lo, hi,
                       zip_with(quotas, left, (q, d) -> q - d) AS quotas)))) AS node""",
        ).selectExpr("node.lo AS lo", "node.hi AS hi", "node.quotas AS quotas", "every")
    return nodes.selectExpr("lo AS shard", "quotas")


def plan(sizes: DataFrame, recipe: Recipe) -> DataFrame:
    """``targets`` with ``ends``: of each source's positions, where each shard's range ends; stored."""
    with scratch(sizes.sparkSession) as keep:
        sources = _planned(sizes, recipe)
        keep(sources)
    return sources


def _planned(sizes: DataFrame, recipe: Recipe) -> DataFrame:
    sources = stored(targets(sizes, recipe), "targets")
    quotas = sources.selectExpr(
        "transform(array_sort(collect_list(struct(src, quota))), x -> x.quota) AS quotas"
    )
    tree = stored(splitting_tree(quotas, recipe.shards, recipe.seed), "tree")
    ends = (
        tree.selectExpr("shard", "posexplode(quotas) AS (of_src, quota)")
        .selectExpr("of_src", "shard", "sum(quota) OVER (PARTITION BY of_src ORDER BY shard) AS end")
        .groupBy("of_src")
        .agg(F.expr("transform(array_sort(collect_list(struct(shard, end))), x -> x.end) AS ends"))
    )
    return stored(sources.join(ends, F.expr("src = of_src")).drop("of_src"), "sources")


def _placed(sizes: DataFrame, sources: DataFrame, seed: int) -> DataFrame:
    """Every row with ``start``, the words of its source before it, in a seeded order.

    A hash puts the rows of a source into ordered buckets of about ``BUCKET_ROWS``; words
    are summed inside each bucket, over the buckets of a run, and over the runs.
    """
    dealt = stored(
        sizes.withColumnRenamed("source", "of_source")
        .join(sources.select("src", "source", "rows"), F.expr("of_source <=> source"))
        .selectExpr(
            "src", "doc_id", "digest", "size", "copies", "rows",
            f"pmod(xxhash64({seed}, doc_id, digest), 2147483648L) AS turn",
        )
        .selectExpr("*", f"turn * ((rows + {BUCKET_ROWS - 1}) div {BUCKET_ROWS}) div 2147483648L AS bucket")
        .drop("rows"),
        "dealt",
    )
    earlier = "ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING"
    buckets = stored(
        dealt.groupBy("src", "bucket").agg(F.expr("sum(size * copies) AS words")).selectExpr(
            "*", f"bucket div {BUCKET_RUN} AS run"
        ),
        "buckets",
    )
    runs = buckets.groupBy("src", "run").agg(F.expr("sum(words) AS words")).selectExpr(
        "src", "run", f"coalesce(sum(words) OVER (PARTITION BY src ORDER BY run {earlier}), 0L) AS before_run"
    )
    before = stored(
        buckets.selectExpr(
            "src", "run", "bucket",
            f"coalesce(sum(words) OVER (PARTITION BY src, run ORDER BY bucket {earlier}), 0L) AS inside_run",
        )
        .join(runs, ["src", "run"])
        .selectExpr("src AS of_src", "bucket AS of_bucket", "before_run + inside_run AS before"),
        "before",
    )
    inside = dealt.selectExpr(
        "*",
        f"""coalesce(sum(size * copies) OVER
            (PARTITION BY src, bucket ORDER BY turn, doc_id, digest, size {earlier}), 0L) AS inside""",
    )
    placed = inside.join(before, F.expr("src = of_src AND bucket = of_bucket")).selectExpr(
        "src", "doc_id", "digest", "size", "copies", "before + inside AS start"
    )
    few = placed.where(f"copies <= {COPY_RUN}").selectExpr(
        "src", "doc_id", "digest", "size", "start", "explode(sequence(0L, copies - 1)) AS copy"
    )
    # a row repeated without end is listed by many tasks
    many = (
        placed.where(f"copies > {COPY_RUN}")
        .selectExpr("*", f"explode(sequence(0L, (copies - 1) div {COPY_RUN})) AS part")
        .repartition("src", "doc_id", "digest", "part")
        .selectExpr(
            "src", "doc_id", "digest", "size", "start",
            f"explode(sequence(part * {COPY_RUN}, least(copies, (part + 1) * {COPY_RUN}) - 1)) AS copy",
        )
    )
    return few.union(many).selectExpr("src", "doc_id", "digest", "size", "copy", "start + copy * size AS start")


def permuted(value: str, size: str, seed: int) -> str:
    """SQL: ``value`` of [0, ``size``) under a seeded permutation of that range.

    Swap or not: each round pairs every number with its mirror image at a random point, and
    the hash of the larger of both decides for the two whether they change places.
    """
    mirror = f"pmod(pmod(xxhash64({seed}, i, {size}), {size}) - v, {size})"
    return f"""aggregate(sequence(1, {ROUNDS}), {value}, (v, i) -> IF(
        pmod(xxhash64({seed} + 1, i, greatest(v, {mirror})), 2) = 1, {mirror}, v))"""


def _cut(sizes: DataFrame, sources: DataFrame, recipe: Recipe) -> DataFrame:
    """Every row of the table with each block that it has words in and each time it may be taken."""
    block, seed = recipe.block, recipe.seed
    rows = _placed(sizes, sources, seed).withColumnRenamed("src", "of_src")
    known = sources.select("src", "source", "source_size", "target", "words", "full", "blocks", "ends")
    return (
        rows.join(known, F.expr("of_src = src"))
        .selectExpr(
            "*",
            f"explode_outer(IF(size = 0, NULL, sequence(start div {block}, (start + size - 1) div {block}))) AS block",
        )
        .selectExpr("*", f"IF(block < full, {permuted('block', 'full', seed)}, block) AS rank")
        .selectExpr("*", f"explode(sequence(0, {recipe.limit - 1})) AS epoch")
        .selectExpr(
            "*",
            f"""greatest(0L, least({block}L, source_size - block * {block},
                words - epoch * source_size - rank * {block})) AS taken_of_block""",
            f"greatest(start, block * {block}) - start AS first",
        )
        .selectExpr(
            "*", f"coalesce(greatest(least(size, block * {block} + taken_of_block - start) - first, 0L), 0L) AS length"
        )
    )


def mixed(
    docs: DataFrame,
    recipe: Recipe | None = None,
    doc_id: str = "doc_id",
    text: str = "text",
    source: str = "source",
) -> DataFrame:
    """The mix: ``shard, order, doc_id, source, digest, first, length, epoch``, one row a piece.

    A source's documents, one after another in a seeded order, form a stream of words that is
    cut into blocks of ``recipe.block``. The splitting tree says how many blocks of each source
    a shard gets. The blocks are permuted, and the shards take disjoint ranges of that
    order, which goes round again for what is taken twice; the last block is
    trimmed to the target. So each source gives its target to the word, and no word is taken
    more than ``recipe.limit`` times. Within a shard, blocks stand by ``order``, a seeded hash.

    A piece is what a block takes of one document: ``length`` words from word ``first`` on;
    ``epoch`` counts how often the source went round before. Results depend on the rows and
    the recipe alone, not on partitions.

    Null texts and texts without words have size 0 and no pieces. A null source is a source
    of its own, the last. Null ids and repeated rows have pieces each. Sources without words have target
    0. Further columns are ignored, whatever their names; an empty table gives no rows.
    """
    recipe = recipe or Recipe()
    sizes = sized(docs, doc_id, text, source)
    pieces = _cut(sizes, plan(sizes, recipe), recipe).where("length > 0")
    return pieces.selectExpr(
        "cast(size(filter(ends, e -> e <= epoch * blocks + rank)) AS INT) AS shard",
        f"xxhash64({recipe.seed}, src, block, epoch) AS order",
        "doc_id", "source", "digest", "first", "length", "epoch",
    )


def shares(
    docs: DataFrame,
    recipe: Recipe | None = None,
    doc_id: str = "doc_id",
    text: str = "text",
    source: str = "source",
) -> DataFrame:
    """``doc_id, size, source_size, target, taken`` of every row, by the pieces of ``mixed``.

    A row lies at one place of its source's stream, by which its pieces are summed; rows
    without words take none. Nulls, repeats and empty tables as in ``mixed``.
    """
    recipe = recipe or Recipe()
    sizes = sized(docs, doc_id, text, source)
    pieces = _cut(sizes, plan(sizes, recipe), recipe)
    # a row's place in its source's stream, and which of equal rows it is
    row = ["src", "start", "copy", "doc_id", "digest", "size", "source_size", "target"]
    summed = pieces.groupBy(*row).agg(F.sum("length").alias("taken"))
    return summed.select("doc_id", "size", "source_size", "target", "taken")


def write_mix(
    docs: DataFrame,
    pieces: DataFrame,
    path: str,
    doc_id: str = "doc_id",
    text: str = "text",
    source: str = "source",
) -> None:
    """Write the pieces' texts, words joined by one space: ``shard=<n>``, each in its own order.

    A range of a shard's order is one task and one file, so a shard larger than a task
    becomes several files, in order by name. Each document's text moves once.
    """
    texts = docs.selectExpr(
        f"cast(`{doc_id}` AS BIGINT) AS of_id",
        f"cast(`{source}` AS STRING) AS of_source",
        f"xxhash64({utf8(text)}) AS of_digest",
        f"{utf8(text)} AS body",
    ).dropDuplicates(["of_id", "of_source", "of_digest"])
    pattern = WORD.replace("\\", "\\\\")
    same = F.expr("doc_id <=> of_id AND source <=> of_source AND digest = of_digest")
    found = pieces.join(texts, same).selectExpr(
        "shard", "order", "doc_id", "source", "first", "epoch",
        f"""array_join(slice(regexp_extract_all(body, '{pattern}', 0),
            cast(first + 1 AS INT), cast(length AS INT)), ' ') AS text""",
    )
    place = ["shard", "order", "doc_id", "first"]
    found.repartitionByRange(*place).sortWithinPartitions(*place).write.partitionBy("shard").parquet(path)
