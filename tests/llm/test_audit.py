"""The filter audit and its matrix against plain counting."""

import itertools
import re
from collections import Counter

import numpy as np
import pytest

from opsmeter.llm import audit, queries

SF = "/root/testdata/sf0.01"
WORD = re.compile("[^\x20\x09-\x0d]+")


def plain_audit(documents, labels):
    """``documents``: (id, text, part) of every row; ``labels``: (id, quality, toxic)."""
    smallest = {}
    for i, text, _ in documents:
        if i is not None:
            smallest[text or ""] = min(i, smallest.get(text or "", i))
    good = {i for i, quality, _ in labels if quality == 1 and i is not None}
    toxic = {i for i, _, t in labels if t == 1 and i is not None}
    rows = []
    for i, text, part in documents:
        text = text or ""
        words = WORD.findall(text)
        fails = (
            len(words) < 50,
            100 * len(set(words)) < 65 * len(words),
            100 * len(re.findall("[A-Z]", text)) > 5 * len(text),
            bool(re.search("[#$%&*|]", text)),
            i is not None and smallest[text] < i,
        )
        rows.append((part or "", {f for f, x in zip("ABCDE", fails) if x}, i in good, i in toxic))
    out, shapley = {}, Counter()
    for part in {r[0] for r in rows}:
        own = [r for r in rows if r[0] == part]
        for order in itertools.permutations("ABCDE"):
            alive = own
            for step, f in enumerate(order, 1):
                removed = [r for r in alive if f in r[1]]
                alive = [r for r in alive if f not in r[1]]
                failing = sum(f in r[1] for r in own)
                only = sum(r[1] == {f} for r in own)
                out[part, "".join(order), step] = [
                    len(alive), len(removed), failing - len(removed), only,
                    sum(r[2] for r in removed), sum(r[3] for r in removed),
                ]
                shapley[part, f] += len(removed)
    return {key: [*value, shapley[key[0], key[1][key[2] - 1]]] for key, value in out.items()}


def told(frame):
    rows = frame.collect()
    got = {
        (r.part, r.filter_order, r.step): [
            r.kept, r.removed, r.redundant, r.unique_fails, r.good_lost, r.toxic_lost, r.shapley
        ]
        for r in rows
    }
    assert len(got) == len(rows)
    return got


def test_all_documents(spark):
    documents = [(r.doc_id, r.text, r.source) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    labels = [(r.doc_id, r.quality, r.toxic) for r in spark.read.parquet(f"{SF}/labels.parquet").collect()]
    assert told(queries.op13_filter_audit(spark, SF)) == plain_audit(documents, labels)


LONG = " ".join(f"w{i}" for i in range(60))
ODD = [
    (1, LONG, "a"), (2, LONG, "b"), (2, LONG, "a"), (1, LONG, None), (None, LONG, "a"), (None, LONG, "a"),
    (3, None, "a"), (4, "", "b"), (None, None, ""), (5, " \t\x0b\r\n", None), (6, LONG.upper(), "c"),
    (7, "same word " * 40, "c"), (8, LONG + " #", "c"), (9, "é😀 " * 70, "c"), (9, "é😀 " * 70, "c"),
    (10, "Word word WORD " * 20000 + LONG, "c"), (11, "x" * 300_000, "d"), (12, "one\x0ctwo\x85three four", "d"),
]
LABELS = [(1, 1, 0), (1, 0, 1), (2, None, None), (3, 1, 1), (None, 1, 1), (99, 1, 1), (9, 1, 0), (9, 1, 0), (7, 5, 2)]
CLASHES = "part mask rows good toxic shard word place term kept removed step filter_order digest cells least".split()


def odd_frames(spark):
    schema = "doc_id bigint, text string, source string, " + ", ".join(f"`{c}` string" for c in CLASHES)
    docs = spark.createDataFrame([(*row, *["?"] * len(CLASHES)) for row in ODD], schema)
    labels = spark.createDataFrame([(*x, "?", "?") for x in LABELS], "doc_id int, quality int, toxic int, text string, rows string")
    return docs, labels


def test_odd_documents(spark):
    assert told(audit.filter_audit(*odd_frames(spark))) == plain_audit(ODD, LABELS)


@pytest.mark.parametrize("size", [1, 300, 1 << 20])
def test_matrix(spark, monkeypatch, size):
    """Whatever the shards: cells are the texts' word counts, and a word has one number everywhere."""
    monkeypatch.setattr(audit, "PIECE_BYTES", size)  # a function's workers do not see other changes
    docs, _ = odd_frames(spark)
    shards = audit.local_shards(docs.repartition(1 if size > 1000 else 5))
    numbered = audit.terms(shards)
    matrix = audit.encoded(shards, numbered).collect()
    words = {}
    for r in audit.dictionary(shards, numbered).collect():
        assert words.setdefault(r.term, r.word) == r.word
    everything = {w for _, t, _ in ODD for w in WORD.findall(t or "")}
    assert sorted(words) == list(range(len(everything))) and set(words.values()) == everything
    found = []
    for r in matrix:
        assert r.starts[0] == 0 and r.starts[-1] == len(r.columns) == len(r.counts)
        for i, doc_id in enumerate(r.ids):
            cells = slice(r.starts[i], r.starts[i + 1])
            assert r.columns[cells] == sorted(r.columns[cells])
            found.append((str(doc_id), sorted((words[c], n) for c, n in zip(r.columns[cells], r.counts[cells]))))
    expected = [(str(i), sorted(Counter(WORD.findall(t or "")).items())) for i, t, _ in ODD]
    assert sorted(found) == sorted(expected)


def test_no_rows(spark):
    docs, labels = odd_frames(spark)
    assert audit.filter_audit(docs.limit(0), labels).collect() == []
    none = told(audit.filter_audit(docs, labels.limit(0)))
    assert none == plain_audit(ODD, [])


@pytest.mark.parametrize("seed", range(2))
def test_random_masks(spark, seed):
    """Many equal texts over parts, ids that repeat, labels of all kinds."""
    rng = np.random.default_rng(seed)
    texts = [LONG, LONG.upper(), "a b c", "#", "", None, "word " * 80]
    documents = [
        (int(i) if (i := rng.integers(0, 60)) % 7 else None, texts[rng.integers(0, len(texts))], "pqr"[rng.integers(0, 3)])
        for _ in range(150)
    ]
    labels = [(int(i), int(rng.integers(0, 2)), int(rng.integers(0, 2))) for i in rng.integers(0, 60, 40)]
    frame = spark.createDataFrame(documents, "doc_id bigint, text string, source string")
    known = spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int")
    assert told(audit.filter_audit(frame, known)) == plain_audit(documents, labels)
