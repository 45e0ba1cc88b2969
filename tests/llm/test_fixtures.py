"""Queries against brute force over whole small tables, and edge cases of every operator."""

import hashlib
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from opsmeter.llm import common, counts, dedup, jaccard, packing, pieces, quality, queries, secrets, sharding

TEXTS = [
    None, "", " ", " lead", "a  b", "tail ", "x▁y", "\n\n tab\t", "a\x1cb \x85c", "\x00a",
    "<|endoftext|>a<|startoftext|> b", "it's  we'll 123 4567.", "é ́x ΣΣ.", "\U0001f600 hi <s> </s> <unk>",
    "the the THE the.", "long " * 5000, "x" * 30_000,
]


@pytest.fixture(scope="module")
def odd(spark):
    """Null ids, repeated rows, odd texts, and columns named like the operators' own."""
    rows = [(i, t, 1, "s") for i, t in enumerate(TEXTS)] + [(None, "no id", 2, "s"), (3, TEXTS[3], 1, "s")]
    return spark.createDataFrame(rows, "doc_id bigint, text string, digest int, kept string")


@pytest.fixture(scope="module")
def none(odd):
    return odd.limit(0)


@pytest.fixture(scope="module")
def texts(spark, folder):
    return {r.doc_id: r.text for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}


def by_id(df):
    return {r.doc_id: r for r in df.collect()}


# --- token counts ---

WORD = public_tokenizers.path("word_bpe_49k.json")


def test_counts_equal_the_library(spark, folder, texts, odd):
    library = Tokenizer.from_file(WORD)

    def expected(text):
        return len(text.encode()), len(library.encode(text, add_special_tokens=False).ids)

    for doc, r in by_id(queries.op10_token_counts(spark, folder)).items():
        assert (r.n_bytes, r.n_tokens) == expected(texts[doc])
        assert r.over_limit == (r.n_tokens > 2048)
    found = counts.token_counts(odd, WORD).collect()
    assert len(found) == odd.count()
    for r in found:
        text = "no id" if r.doc_id is None else TEXTS[r.doc_id] or ""
        assert (r.n_bytes, r.n_tokens) == expected(text), repr(text[:40])


def test_counts_of_an_empty_table(none):
    assert counts.token_counts(none, WORD).collect() == []


def test_counter_forgets_and_learns_again(monkeypatch):
    monkeypatch.setattr(counts, "MEMORY_WORDS", 4)
    counter = counts.WordCounter(WORD)
    assert counter.count(["one two three", "four five. SIX", "one, two"]).tolist() == [3, 4, 3]
    assert counter.count(["seven eight nine one"]).tolist() == [4]


# --- pieces ---

MODEL = public_tokenizers.path("piece_bpe_32k.model")


def test_pieces_equal_the_library(spark, folder, texts):
    library = pieces.encoder(MODEL).library
    for doc, r in by_id(queries.op8_sentencepiece(spark, folder)).items():
        ids = library.encode(texts[doc])
        assert r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(library.decode(ids).encode()).hexdigest()
        assert r.n_bytes_spanned == len(texts[doc].encode())


def test_piece_spans_cover_the_source(odd):
    library = pieces.encoder(MODEL).library
    rows = pieces.piece_tokens(odd, MODEL).collect()
    assert len(rows) == odd.count()
    for r in rows:
        text = "no id" if r.doc_id is None else TEXTS[r.doc_id] or ""
        source = text.encode()
        assert r.ids == library.encode(text) and r.decoded == library.decode(r.ids)
        if r.ids:
            assert r.starts[0] == 0 and r.ends[-1] == len(source)
        for i, (id_, start, end) in enumerate(zip(r.ids, r.starts, r.ends, strict=True)):
            name = library.id_to_piece(id_)
            if library.is_byte(id_):
                assert f"<0x{source[start]:02X}>" == name and end == start + 1
            elif i:
                assert source[start:end].decode().replace(" ", "▁") == name


def test_pieces_of_an_empty_table(none):
    assert pieces.piece_tokens(none, MODEL).collect() == []
    assert pieces.piece_digests(none, MODEL).collect() == []


def test_character_map_takes_the_longest_prefix():
    """A double-array trie written by hand: "a" -> "X", "ab" -> "YZ"."""
    pool = b"X\0YZ\0"

    def node(label, jump, leaf):
        return label | (jump << 10) | (leaf << 8)

    units = [0] * 600
    base = 1 << 8  # children of the root stand at base ^ letter
    units[0] = node(0, base, 0)
    a = base ^ ord("a")
    units[a] = node(ord("a"), a ^ 1 ^ 0, 1)  # its value stands at 1
    first = 1
    units[first] = (1 << 31) | 0
    b = first ^ ord("b")
    units[b] = node(ord("b"), b ^ 2, 1)
    units[2] = (1 << 31) | 2
    blob = (4 * len(units)).to_bytes(4, "little") + np.array(units, "<u4").tobytes() + pool
    table = pieces.CharacterMap(blob)
    assert table.longest(b"abc", 0) == (2, b"YZ")
    assert table.longest(b"acb", 0) == (1, b"X")
    assert table.longest(b"cab", 0) is None
    work = pieces.Normalizer(b"")
    work.map, work.squeeze = table, True
    body, origin = work.run(" ab  ac ")
    assert body.decode() == "▁YZ▁Xc"
    assert origin.tolist() == [1, 1, 1, 1, 1, 3, 3, 3, 5, 6, 7]


# --- packing ---


def check_packing(rows, lengths, limit):
    assert sum(r.length for r in rows) == sum(lengths)
    sequences = {}
    for r in rows:
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= limit
    return len(sequences)


def test_packing_of_all_documents(spark, folder, texts):
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    ids = {d: [*library.encode(t, add_special_tokens=False).ids, 0] for d, t in texts.items()}
    rows = queries.op4_best_fit_packing(spark, folder).collect()
    made = check_packing(rows, map(len, ids.values()), 2048)
    assert made <= 1.02 * -(-sum(map(len, ids.values())) // 2048)
    whole = {}
    for r in sorted(rows, key=lambda r: (r.doc_id, r.piece)):
        part = ids[r.doc_id][r.start : r.start + r.length]
        assert r.ids_crc32 == zlib.crc32(np.array(part, "<u4").tobytes())
        assert r.start == whole.get(r.doc_id, 0) and (r.length == 2048 or r.piece == 0)
        whole[r.doc_id] = r.start + r.length
    assert whole == {d: len(i) for d, i in ids.items()}


def test_packing_of_odd_texts(odd, none):
    options = queries.packing_options()
    library = Tokenizer.from_file(options["tokenizer"])
    rows = packing.packed_documents(odd, limit=64, with_ids=True, **options).collect()
    check_packing(rows, [r.length for r in rows], 64)
    for i, text in enumerate(TEXTS):
        parts = sorted((r for r in rows if r.doc_id == i), key=lambda r: r.piece)
        ids = [*library.encode(text or "", add_special_tokens=False).ids, 0]
        if i == 3:  # listed twice
            assert [r.ids for r in parts] == [ids, ids]
        else:
            assert sum((r.ids for r in parts), []) == ids
    assert packing.packed_documents(none, limit=64, **options).collect() == []


def test_blocks_of_null_and_repeated_ids(spark):
    rows = [(None, 0, 0, 1, 5)] * 1000 + [(7, 0, 0, 1 + i % 50, i) for i in range(1000)]
    rows += [(i, 0, 0, 1 + i % 64, i) for i in range(100, 1100)]
    table = packing.stored(spark.createDataFrame(rows, packing.PIECES).repartition(5), "pieces")
    found = packing.packed(table, 64, 100).collect()
    assert Counter(tuple(r)[:5] for r in found) == Counter(rows)
    check_packing(found, [r[3] for r in rows], 64)
    assert max(Counter(r.sequence_id >> 32 for r in found).values()) <= 200
    again = packing.stored(spark.createDataFrame(rows[::-1], packing.PIECES).repartition(3), "pieces")
    assert Counter(packing.packed(again, 64, 100).collect()) == Counter(found)


def slow_sum_of_squares(lengths, limit):
    gaps = []
    for n in sorted(lengths, reverse=True):
        best = None
        for gap in sorted({g for g in gaps if g >= n}) + [limit]:
            trial = sorted(gaps)
            if gap != limit:
                trial.remove(gap)
            trial.append(gap - n)
            open_ = [g for g in trial if g]
            score = sum(open_.count(g) ** 2 for g in set(open_))
            if best is None or score < best[0]:
                best = score, trial
        gaps = best[1]
    return sorted(gaps)


@pytest.mark.parametrize("seed", range(5))
def test_sum_of_squares_rule(seed):
    lengths = np.random.default_rng(seed).integers(1, 17, 40)
    bins, offsets = packing.sum_of_squares(lengths, 16)
    fill = np.bincount(bins, lengths).astype(int)
    assert sorted((16 - fill).tolist()) == slow_sum_of_squares(lengths.tolist(), 16)


@pytest.mark.parametrize("seed", range(6))
def test_open_bins_are_packed_once_more(seed):
    rng = np.random.default_rng(seed)
    limit = int(rng.integers(5, 60))
    lengths = rng.integers(1, limit + 1, int(rng.integers(1, 400)))
    before, at = packing.sum_of_squares(lengths, limit)
    bins, offsets = packing.reseated(lengths, before, at, limit)
    assert sorted(set(bins)) == list(range(bins.max() + 1)) and bins.max() <= before.max()
    for b in range(bins.max() + 1):
        own = np.flatnonzero(bins == b)
        own = own[np.argsort(offsets[own])]
        assert offsets[own].tolist() == [0, *np.cumsum(lengths[own])[:-1]] and lengths[own].sum() <= limit
    # what the rule filled stays as it is
    full = [frozenset(np.flatnonzero(before == b)) for b in np.flatnonzero(np.bincount(before, lengths) == limit)]
    assert set(full) <= {frozenset(np.flatnonzero(bins == b)) for b in range(bins.max() + 1)}


def test_packing_is_near_the_bound(spark):
    rows = queries.op4_best_fit_packing(spark, "/root/testdata/sf0.01").collect()
    bound = -(-sum(r.length for r in rows) // 2048)
    assert len({r.sequence_id for r in rows}) <= bound + 1


# --- sharding ---


def check_shards(rows, shards):
    seen = {}
    for r in rows:
        seen.setdefault(r.shard, []).append(r.slot)
    sizes = [len(seen.get(s, [])) for s in range(shards)]
    assert max(sizes) - min(sizes) <= 1
    assert all(sorted(slots) == list(range(len(slots))) for slots in seen.values())


def test_shards_are_even_and_whole(spark, folder, texts):
    rows = queries.op5_sharding(spark, folder).collect()
    check_shards(rows, 24)
    assert {r.doc_id: (r.size, r.text_crc32) for r in rows} == {
        d: (len(t.encode()) + 8, zlib.crc32(t.encode())) for d, t in texts.items()
    }
    assert {(r.law, r.grown_shard) for r in rows} == {("rows", None)}
    place = [s for _, s in sorted((r.slot * 24 + r.shard, r.doc_id) for r in rows)]
    assert place != sorted(place) and abs(np.corrcoef(range(len(place)), place)[0, 1]) < 0.3


def test_shards_of_several_buckets_and_odd_rows(odd, none, tmp_path, spark):
    placed = sharding.shuffled(odd, 3, bucket_bytes=500)
    rows = placed.collect()
    assert len(rows) == odd.count() and placed.columns == [*odd.columns, "shard", "slot"]
    check_shards(rows, 3)
    assert sharding.shuffled(none).collect() == []
    assert placed.drop("shard", "slot").exceptAll(odd).isEmpty()
    sharding.write_shards(placed, str(tmp_path / "out"))
    assert spark.read.parquet(str(tmp_path / "out")).count() == odd.count()


# --- secrets ---

ASSIGN = re.compile(
    r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII
)


def plain_spans(text):
    found = [(m.start(), 0, m.end(), "assign") for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    found += [(m.start(), 1, m.end(), "access") for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    found += [(m.start(), 2, m.end(), "hex") for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
    weak = []
    for m in re.finditer("[A-Za-z0-9/+]+", text):
        if len(m[0]) == 40 and all(re.search(c, m[0]) for c in ("[A-Z]", "[a-z]", "[0-9]")):
            weak.append((m.start(), 3, m.end(), "key"))
    weak += [
        (m.start(), 4, m.end(), "endpoint") for m in re.finditer("https?://[A-Za-z0-9][A-Za-z0-9.-]*", text)
    ]
    linked = [
        w for w in weak
        if any(
            s[3] in secrets.COMPLEMENTS[w[3]] and w[0] <= s[2] + 256 and s[0] <= w[2] + 256 for s in found
        )
    ]
    return sorted(found), sorted(linked)


def joined(spans):
    return ",".join(f"{k}:{a}:{b}" for a, _, b, k in spans)


def test_spans_of_all_documents(spark):
    folder, some = "/root/testdata/sf0.01", 0  # the smallest tables hold no secret
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    for doc, r in by_id(queries.op7_secret_scans(spark, folder)).items():
        base, extra = plain_spans(texts[doc])
        some += len(base)
        assert r.base_sha256 == hashlib.sha256(joined(base).encode()).hexdigest()
        assert r.spans == joined(sorted(base + extra))
        assert (r.n_assign, r.n_access, r.n_hex) == tuple(
            sum(s[3] == k for s in base) for k in ("assign", "access", "hex")
        )
    assert some


KEY = "wJalrXUtnFEMI/K7MDENG/bPxRfiCYEXAMPLE123"
SECRET_TEXTS = [
    None, "", "secret=token:abcdefgh password = 'short' Token: longer_value.x",
    f"é AKIA{'A1' * 8} 漢字 {KEY} then {KEY} https://api.example.com/x",
    f"{KEY} alone https://api.example.com", f"AKIA{'B' * 16} {'w ' * 200}{KEY}",
    "passwd=abcdef http://host " * 300, f"AKIASHORT AKIA{'C' * 40}", "0123456789abcdef01234567 " * 50,
    f"AKIA{'D' * 16}{'.' * 255}{KEY}", f"{KEY}{'.' * 256}AKIA{'D' * 16}", f"{KEY}{'.' * 257}AKIA{'D' * 16}",
    "API_KEY=\"abcdef123456\" apikey : 'zzzzzz' 'api-key'='no'", "PASSWORD==secret=abc",
]


@pytest.fixture(scope="module")
def leaks(spark):
    rows = [(i, t, 1, "x") for i, t in enumerate(SECRET_TEXTS)] + [(None, SECRET_TEXTS[3], 1, "x")] * 2
    return spark.createDataFrame(rows, "doc_id bigint, text string, key int, base string")


def test_spans_of_odd_texts(leaks):
    rows = secrets.digests(secrets.secret_spans(leaks)).collect()
    assert len(rows) == leaks.count()
    for r in rows:
        base, extra = plain_spans((SECRET_TEXTS[3] if r.doc_id is None else SECRET_TEXTS[r.doc_id]) or "")
        assert r.spans == joined(sorted(base + extra)), r.doc_id
    assert secrets.secret_spans(leaks.limit(0)).collect() == []


def test_weak_spans_at_every_place_in_a_cell(spark):
    access = f"AKIA{'D' * 16}"
    texts = [
        f"{'.' * place}{a}{'.' * gap}{b}"
        for place in range(256) for gap in (1, 216, 255, 256, 257) for a, b in ((KEY, access), (access, KEY))
    ]
    texts += [f"{'.' * place}https://{'x.' * 600}{access}{'.x' * 600}" for place in range(0, 256, 15)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    lost = []
    for r in secrets.digests(secrets.secret_spans(docs)).collect():
        base, extra = plain_spans(texts[r.doc_id])
        if r.spans != joined(sorted(base + extra)):
            lost.append(r.doc_id)
    assert not lost, f"{len(lost)} of {len(texts)}"


def test_redaction(leaks):
    done = secrets.redacted(leaks)
    assert done.columns == leaks.columns
    rows = done.collect()
    assert len(rows) == leaks.count()
    for r in rows:
        text = SECRET_TEXTS[3] if r.doc_id is None else SECRET_TEXTS[r.doc_id]
        if text is None:
            assert r.text is None
            continue
        base, extra = plain_spans(text)
        out, at = "", 0
        for start, _, end, kind in sorted(base + extra):
            if start >= at:
                out += text[at:start] + f"[{kind}]"
            at = max(at, end)
        assert r.text == out + text[at:]


# --- exact dedup ---


def brute_groups(rows, digest=lambda t: t):
    groups = {}
    for doc, text in rows:
        groups.setdefault(text or "", []).append(doc)
    return groups


def weak_digest(text):
    from pyspark.sql import functions as F

    return F.substring(dedup.sha256(text), 1, 1)


@pytest.mark.parametrize("digest", [dedup.sha256, weak_digest])
def test_groups_of_all_documents(spark, folder, texts, digest):
    groups = brute_groups(texts.items())
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    found = by_id(dedup.exact_groups(docs, digest=digest))
    assert found.keys() == texts.keys()
    for members in groups.values():
        for doc in members:
            r = found[doc]
            assert (r.keep_id, r.group_size, r.kept) == (max(members), len(members), doc == max(members))


def test_groups_of_odd_rows(odd, none, spark):
    found = dedup.exact_groups(odd).collect()
    assert len(found) == odd.count()
    empty = [r for r in found if r.doc_id in (0, 1)]
    assert {(r.keep_id, r.group_size) for r in empty} == {(1, 2)}
    twice = [r for r in found if r.doc_id == 3]
    assert [(r.keep_id, r.group_size, r.kept) for r in twice] == [(3, 2, True)] * 2
    nameless = next(r for r in found if r.doc_id is None)
    assert nameless.kept and nameless.keep_id is None
    kept = dedup.without_copies(odd)
    assert kept.columns == odd.columns
    assert sorted(r.doc_id for r in kept.collect() if r.doc_id is not None) == [
        i for i in range(len(TEXTS)) if i != 0
    ]
    assert dedup.exact_groups(none).collect() == []
    assert dedup.without_copies(none).collect() == []


def test_state_takes_in_later_batches(spark, tmp_path):
    state = dedup.DedupState(spark, str(tmp_path / "state"))
    state.add(spark.createDataFrame([(5, "a"), (2, "b")], "id bigint, body string"))
    state.add(spark.createDataFrame([(7, "a"), (9, "c")], "id bigint, body string"))
    places = {(r.id, r.body): r.locator for r in state.contents.collect()}
    found = {r.keep_id: (r.locator, r.group_size) for r in state.groups().collect()}
    assert found == {7: (places[7, "a"], 2), 2: (places[2, "b"], 1), 9: (places[9, "c"], 1)}
    # a hit leads back to the bytes of all its texts, those of earlier batches too
    hits = state.groups().where("group_size > 1")
    texts = {(r.id, r.body, r.locator) for r in state.hit_texts(hits).collect()}
    assert texts >= {(5, "a", places[5, "a"]), (7, "a", places[7, "a"])}


def test_only_hit_texts_move(spark):
    docs = spark.createDataFrame([(i, f"text {i % 900} " * 5) for i in range(1000)], "doc_id bigint, text string")
    state = dedup.DedupState(spark, common.new_folder(spark, "state"))
    state.add(docs.selectExpr("doc_id AS id", "text AS body"))
    hits = state.groups().where("group_size > 1")
    found = state.hit_texts(hits)
    assert sorted(r.id for r in found.collect()) == sorted([*range(100), *range(900, 1000)])
    plan = found.groupBy("body").count()._jdf.queryExecution().optimizedPlan().toString()
    assert "strategy=broadcast" in plan


def test_copies_without_ids_in_a_third_of_the_rows(spark):
    rows = [(None, "hot text")] * 400 + [(7, "hot text")] + [(i, f"text {i}") for i in range(100, 900)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(6)
    found = dedup.exact_groups(docs).collect()
    hot = [r for r in found if r.group_size > 1]
    assert len(found) == len(rows) and len(hot) == 401
    assert {(r.keep_id, r.group_size) for r in hot} == {(7, 401)} and sum(r.kept for r in hot) == 1


# --- names and ties ---

# every column that the steps add to documents on their way
INTERNAL = """kept_id kept_digest kept_rows own_digest first_row gone_id cut_digest cut_spans doc_id_ body key
    spans base weak extra digest size place tie order_ earlier of_bucket bucket bucket_rows shard slot row_key
    own_row row_copies row_turn row_share row_json repeated_key text_sha256 keep_id group_size kept id locator
    component_id n_shingles name quality_text label score part p GONE_ID_""".split()


@pytest.fixture(scope="module")
def clashing(spark):
    rows = [(1, LONG_TEXT), (2, LONG_TEXT), (3, LONG_TEXT + " more"), (4, "token=abcdefgh rest"), (None, None),
            (None, None), (5, "")]
    data = [(*row, *[f"{c}-{i}" for c in INTERNAL]) for i, row in enumerate(rows)]
    return spark.createDataFrame(data, "doc_id bigint, text string, " + ", ".join(f"`{c}` string" for c in INTERNAL))


LONG_TEXT = " ".join(f"word{i}" for i in range(80))


@pytest.mark.parametrize("step", ["dedup", "jaccard", "secrets", "quality", "sharding"])
def test_steps_keep_columns_of_any_name(spark, clashing, step):
    labels = spark.createDataFrame([(1, 1), (3, 1)], "doc_id bigint, quality int")
    done = {
        "dedup": dedup.without_copies,
        "jaccard": jaccard.without_near_copies,
        "secrets": secrets.redacted,
        "quality": lambda docs: quality.accepted(docs, labels, threshold=0.0),
        "sharding": lambda docs: sharding.shuffled(docs, 2, bucket_bytes=300),
    }[step](clashing)
    before = {r["name"]: r.asDict() for r in clashing.collect()}
    added = ["shard_", "slot_"] if step == "sharding" else []
    assert done.columns == [*clashing.columns, *added]
    rows = done.collect()
    for r in rows:
        old = before[r["name"]]
        assert {c: r[c] for c in clashing.columns if c != "text"} == {c: old[c] for c in old if c != "text"}
        assert r.text == (old["text"].replace("token=abcdefgh", "[assign]") if step == "secrets" and old["text"] else old["text"])
    left = {"dedup": 4, "jaccard": 5}.get(step, 7)
    assert len(rows) == left


def test_repeated_rows_leave_a_defined_one(spark):
    rows = [(1, "same", z) for z in ("c", "b", "a", None)] + [(None, "none", "y"), (None, "none", "x")]
    for _ in range(3):
        docs = spark.createDataFrame(rows, "doc_id bigint, text string, other string").repartition(4)
        assert sorted(map(str, dedup.without_copies(docs).collect())) == sorted(
            ["Row(doc_id=1, text='same', other='a')", "Row(doc_id=None, text='none', other='x')"]
        )


def test_equal_rows_are_dealt_over_the_buckets(spark):
    rows = [(None, "hot", None)] * 300 + [(None, "hot", "x")] * 3 + [(i, f"t{i}", None) for i in range(600)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, more string").repartition(5)
    scattered = sharding._scattered(docs, 20, 7, "doc_id", "text", "bucket", "tie")
    sizes = {r.bucket: r["count"] for r in scattered.groupBy("bucket").count().collect()}
    assert sum(sizes.values()) == len(rows) and max(sizes.values()) < 80
    hot = scattered.where("text = 'hot' AND more IS NULL").groupBy("bucket").count().collect()
    assert sorted(r["count"] for r in hot) == [15] * 20
    placed = sharding.shuffled(docs, 7, bucket_bytes=400)
    check_shards(placed.collect(), 7)
    found = placed.drop("shard", "slot").collect()
    assert sorted(map(str, found)) == sorted(map(str, docs.collect()))


def test_shards_do_not_depend_on_partitions(spark):
    rows = [(i % 50 if i % 9 else None, f"text {i % 60}") for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    name, seen = "spark.sql.shuffle.partitions", []
    before = spark.conf.get(name)
    try:
        for n in (3, 8, 17):
            spark.conf.set(name, n)
            seen.append(sorted(map(str, sharding.shuffled(docs.repartition(n), 5, bucket_bytes=900).collect())))
    finally:
        spark.conf.set(name, before)
    assert seen[0] == seen[1] == seen[2]


def test_many_matches_in_one_text(spark):
    """Work grows with the matches: a quadratic scan took half a minute for a tenth of these."""
    import time

    n = 200_000
    text = "é https://a.b/x " + "token=abcdef1 😀 " * n + f"AKIA{'D' * 16}"
    docs = spark.createDataFrame([(1, text)], "doc_id bigint, text string")
    started = time.time()
    row = secrets.digests(secrets.secret_spans(docs)).first()
    assert (row.n_assign, row.n_access) == (n, 1) and time.time() - started < 60
    last = 16 + 16 * n
    assert row.spans.startswith("endpoint:2:13,assign:16:29,") and row.spans.endswith(f"access:{last}:{last + 20}")
    done = secrets.redacted(docs).first().text
    assert done == "é [endpoint]/x " + "[assign] 😀 " * n + "[access]"
