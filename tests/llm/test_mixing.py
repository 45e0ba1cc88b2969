"""Source mixing: targets, the splitting tree and the pieces against plain versions and laws."""

import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from opsmeter.llm import mixing, queries
from opsmeter.llm.mixing import Recipe

SF = "/root/testdata/sf0.01"
WORD = re.compile("[^\x20\x09-\x0d]+")
CHANCE = "(shiftrightunsigned(xxhash64(id), 11) * power(2D, -53))"


def plain_targets(sizes, weights=(5, 2, 1), share=1.5, limit=2):
    """Share by weight, cap, share the excess by weight, until nothing is above its cap."""
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    left, free, out = share * sum(sizes.values()), set(names), {}
    while free:
        level = left / sum(weight[s] for s in free)
        over = {s for s in free if level * weight[s] >= limit * sizes[s]}
        if not over:
            return out | {s: level * weight[s] for s in free}
        out |= {s: float(limit * sizes[s]) for s in over}
        left -= sum(out[s] for s in over)
        free -= over
    return out


@pytest.mark.parametrize("seed", range(4))
def test_targets(spark, seed):
    rng = np.random.default_rng(seed)
    sizes = {f"s{i}": int(x) for i, x in enumerate(rng.integers(0, 5000, 11) ** rng.integers(0, 2, 11))}
    sizes |= {"Z": 10, "é": 300, "\U0001f600": 70, None: 2000, "empty": 0}
    frame = spark.createDataFrame([(s, n, 1) for s, n in sizes.items()], "source string, size bigint, copies bigint")
    rows = mixing.targets(frame, Recipe(block=64)).collect()
    expected = plain_targets(sizes)
    assert {r.source: r.source_size for r in rows} == sizes
    for r in rows:
        assert r.target == pytest.approx(expected[r.source], rel=1e-12, abs=1e-9)
        assert r.words == int(r.target + 0.5) <= 2 * r.source_size
    assert sum(r.target for r in rows) == pytest.approx(1.5 * sum(sizes.values()))


@pytest.mark.parametrize("total, marked, drawn", [(50, 20, 17), (5000, 1700, 2300), (40, 39, 3), (10**9, 3 * 10**8, 1000)])
def test_hypergeometric_draws(spark, total, marked, drawn):
    draw = mixing.hypergeometric(f"{total}L", f"{marked}L", f"{drawn}L", CHANCE)
    n = 20_000
    row = spark.range(n).selectExpr(f"{draw} AS d").selectExpr("avg(d) m", "var_samp(d) v", "min(d) a", "max(d) b").first()
    p = marked / total
    variance = drawn * p * (1 - p) * (total - drawn) / (total - 1)
    assert abs(row.m - drawn * p) < 5 * (variance / n) ** 0.5
    assert abs(row.v / variance - 1) < (0.06 if variance > 1 else 0.2)
    assert max(0, drawn - (total - marked)) <= row.a and row.b <= min(drawn, marked)


def test_small_draws_have_their_probabilities(spark):
    from math import comb

    draw = mixing.hypergeometric("9L", "4L", "5L", CHANCE)
    n = 40_000
    counts = {r.d: r["count"] for r in spark.range(n).selectExpr(f"{draw} AS d").groupBy("d").count().collect()}
    expected = {k: comb(4, k) * comb(5, 5 - k) / comb(9, 5) for k in range(5)}
    assert set(counts) == set(expected)
    assert sum((counts[k] - n * p) ** 2 / (n * p) for k, p in expected.items()) < 20


def test_certain_draws(spark):
    cases = [(1, 1, 0, 0), (1, 1, 1, 1), (5, 0, 3, 0), (5, 5, 3, 3), (0, 0, 0, 0), (7, 3, 7, 3)]
    for total, marked, drawn, expected in cases:
        for chance in ("0D", "0.5D", "0.9999999999999999D"):
            draw = mixing.hypergeometric(f"{total}L", f"{marked}L", f"{drawn}L", chance)
            assert spark.range(1).selectExpr(f"{draw} AS d").first().d == expected


@pytest.mark.parametrize("shards", [1, 2, 7, 24])
def test_tree_keeps_quotas_and_room(spark, shards):
    quotas = [100, 0, 37, 5, 1]
    frame = spark.createDataFrame([(quotas,)], "quotas array<bigint>")
    rows = {r.shard: r.quotas for r in mixing.splitting_tree(frame, shards, 3).collect()}
    assert sorted(rows) == list(range(shards))
    assert [sum(column) for column in zip(*rows.values())] == quotas
    room = [sum(rows[k]) for k in range(shards)]
    assert max(room) - min(room) <= 1


def test_tree_shares_are_chance(spark):
    """A source's part of one shard over many seeds has the mean and spread of drawing without return."""
    quotas, shards = [60, 40], 4
    frame = spark.createDataFrame([(quotas,)], "quotas array<bigint>")
    seen = []
    for seed in range(60):
        seen += [r.quotas[0] for r in mixing.splitting_tree(frame, shards, seed).collect()]
    # 25 of 100 blocks, 60 of them marked
    assert abs(np.mean(seen) - 15) < 1e-9 and abs(np.var(seen) / (25 * 0.6 * 0.4 * 75 / 99) - 1) < 0.3


@pytest.mark.parametrize("size", [1, 2, 3, 17, 1000])
def test_permutation(spark, size):
    found = [r.p for r in spark.range(size).selectExpr(f"{mixing.permuted('id', f'{size}L', 5)} AS p").collect()]
    assert sorted(found) == list(range(size))
    if size > 100:
        assert sum(a == b for a, b in enumerate(found)) < 10


def check_shares(rows, documents, recipe=Recipe()):
    """``documents``: (id, text, source) of every row."""
    sizes = Counter((i, len(WORD.findall(t or "")), s) for i, t, s in documents)
    by_source = defaultdict(int)
    for (_, size, s), n in sizes.items():
        by_source[s] += size * n
    targets = plain_targets(by_source, recipe.weights, recipe.share, recipe.limit)
    expected = Counter()
    for (i, size, s), n in sizes.items():
        expected[i, size, by_source[s], round(targets[s], 6)] += n
    assert Counter((r.doc_id, r.size, r.source_size, round(r.target, 6)) for r in rows) == expected
    for r in rows:
        assert 0 <= r.taken <= recipe.limit * r.size
    # sources with equal sizes and targets cannot be told apart here
    taken, wanted = Counter(), Counter()
    for r in rows:
        taken[r.source_size, round(r.target, 6)] += r.taken
    for s, target in targets.items():
        wanted[by_source[s], round(target, 6)] += int(target + 0.5)
    assert taken == wanted


def test_all_documents(spark):
    table = spark.read.parquet(f"{SF}/documents.parquet").collect()
    rows = queries.op12_source_mixing(spark, SF).collect()
    check_shares(rows, [(r.doc_id, r.text, r.source) for r in table])
    again = spark.read.parquet(f"{SF}/documents.parquet").repartition(5)
    assert Counter(mixing.shares(again).collect()) == Counter(rows)


ODD = [
    (1, "a b c d e f g", "x"), (1, "a b c d e f g", "x"), (1, "other words of one id", "x"),
    (None, "no id", "x"), (None, "no id", "x"), (None, None, None), (2, None, "x"), (3, "", "y"),
    (4, " \t\n", "y"), (5, "one\x0btwo\x0cthree", None), (6, "long " * 5000, "z"), (7, "w", "z"), (8, "w", ""),
    (9, "é 😀 word", "é"),
]
CLASHES = """size source_size target taken copies digest src start copy block rank epoch first length rows
    turn bucket run before inside shard order quota of_src of_source""".split()


@pytest.mark.parametrize("block", [1, 3, 1024])
def test_odd_documents(spark, block):
    recipe = Recipe(block=block, shards=3)
    schema = "doc_id bigint, text string, source string, " + ", ".join(f"`{c}` string" for c in CLASHES)
    frame = spark.createDataFrame([(*row, *["?"] * len(CLASHES)) for row in ODD], schema)
    check_shares(mixing.shares(frame, recipe).collect(), ODD, recipe)


def test_many_copies(spark, monkeypatch):
    monkeypatch.setattr(mixing, "COPY_RUN", 10)
    monkeypatch.setattr(mixing, "BUCKET_ROWS", 7)
    monkeypatch.setattr(mixing, "BUCKET_RUN", 2)
    rows = [(None, "same text in a third of all rows", "hot")] * 95 + [(i, f"text {i} " * (i % 9), f"s{i % 3}") for i in range(180)]
    frame = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    check_shares(mixing.shares(frame, Recipe(block=16)).collect(), rows, Recipe(block=16))


def test_empty_table(spark):
    frame = spark.createDataFrame([], "doc_id bigint, text string, source string")
    assert mixing.shares(frame).collect() == [] and mixing.mixed(frame).collect() == []
    blank = spark.createDataFrame([(1, "", "a"), (2, None, None)], "doc_id bigint, text string, source string")
    assert sorted((r.doc_id, r.target, r.taken) for r in mixing.shares(blank).collect()) == [(1, 0.0, 0), (2, 0.0, 0)]
    assert mixing.mixed(blank).collect() == []


def test_pieces_and_their_files(spark, tmp_path):
    """Pieces never overlap within one round, fill whole blocks, and the files hold their words."""
    recipe = Recipe(block=50, shards=4)
    docs = spark.createDataFrame(
        [(i, " ".join(f"w{i}_{j}" for j in range(i * 13 % 170)), f"s{i % 4}") for i in range(60)],
        "doc_id bigint, text string, source string",
    )
    pieces = mixing.mixed(docs, recipe)
    words = Counter()
    for r in pieces.collect():
        for j in range(r["first"], r["first"] + r.length):
            words[r.doc_id, j, r.epoch] += 1
    assert set(words.values()) == {1}
    blocks = Counter()
    for r in pieces.collect():
        blocks[r.source, r.order, r.epoch] += r.length
    assert max(blocks.values()) == 50 and sum(n < 50 for n in blocks.values()) <= 3 * 4
    # a block, as often as it is taken, goes to one shard each time
    assert len({(r.order, r.shard) for r in pieces.collect()}) == len({r.order for r in pieces.collect()})
    mixing.write_mix(docs, pieces, str(tmp_path / "mix"))
    found = spark.read.parquet(str(tmp_path / "mix")).collect()
    written = Counter(w for r in found for w in r.text.split(" "))
    expected = Counter()
    for (i, j, _), n in words.items():
        expected[f"w{i}_{j}"] += n
    assert written == expected
    assert {r.shard for r in found} == set(range(4))
