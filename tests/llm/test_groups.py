"""Near-duplicates: exact components, by brute force, for ordinary and for hot groups."""

import math
import re

import numpy as np
import pytest

import corpus_pipeline
from tilerank.llm import embeddings, minhash
from tilerank.llm.components import components

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = {c: c + 32 for c in range(65, 91)}


def union_find(nodes, links):
    parent = {n: n for n in nodes}

    def find(n):
        while parent[n] != n:
            n = parent[n]
        return n

    for a, b in links:
        a, b = find(a), find(b)
        if a != b:
            parent[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def shingle_set(text):
    words = WORD.findall((text or "").translate(LOWER))
    if not words:
        return frozenset()
    return frozenset(tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4)))


def expected(rows):
    sets = {i: shingle_set(t) for i, t in rows}
    ids = sorted(sets)
    links = []
    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            x, y = sets[a], sets[b]
            if x and y and 100 * len(x & y) >= 85 * len(x | y):
                links.append((a, b))
    roots = union_find(ids, links)
    return {i: (len(sets[i]), roots[i]) for i in ids}


def got(df):
    return {r.doc_id: (r.n_shingles, r.component_id) for r in df.collect()}


def test_copies_chains_and_odd_texts(spark):
    rng = np.random.default_rng(1)
    base = [f"w{n}" for n in rng.integers(0, 10**6, 120)]
    rows = [(0, None), (1, ""), (2, "  \n"), (3, "Few Words"), (4, "few words"), (5, "few words here")]
    for n in range(40):  # exact copies
        rows.append((100 + n, " ".join(base)))
    words = list(base)
    for n in range(30):  # a chain: neighbours are alike, ends are not
        words[(4 * n) % 120] = f"x{n}"
        rows.append((200 + n, " ".join(words)))
    df = spark.createDataFrame([(i, t, i) for i, t in rows], "doc_id bigint, text string, component_id bigint")
    result = minhash.near_duplicates(df)
    assert result.columns == ["doc_id", "n_shingles", "component_id", "kept"]
    assert got(result) == expected(rows)
    assert result.where("kept <> (component_id = doc_id)").count() == 0


@pytest.mark.parametrize("part_shingles", [2_000, 1_000_000])
def test_a_hot_group_of_half_copies_loses_no_link(spark, part_shingles):
    """Copies of one text, each changed on its own: most pairs share bands, few are links."""
    rng = np.random.default_rng(7)
    base = [f"w{n}" for n in range(100)]
    rows = []
    for n in range(120):
        words = list(base)
        # Changes at the end of the text touch fewer runs.
        for place in rng.choice(100, rng.integers(1, 4), replace=False):
            words[place] = f"x{n % 60}_{place}"
        rows.append((n, " ".join(words)))
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    assert got(minhash.near_duplicates(df, part_shingles=part_shingles)) == expected(rows)


def test_rows_without_an_id_and_repeated_rows(spark):
    text = " ".join(f"w{n}" for n in range(50))
    rows = [(None, text), (7, text), (7, text), (9, text)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    found = [(r.doc_id, r.component_id, r.kept) for r in minhash.near_duplicates(df).collect()]
    assert sorted(found, key=str) == sorted(
        [(None, None, True), (7, 7, True), (7, 7, True), (9, 7, False)], key=str
    )
    left = minhash.drop_near_duplicates(df)
    assert left.schema == df.schema
    assert sorted(r.doc_id or 0 for r in left.collect()) == [0, 7, 7]


def test_no_rows(spark):
    assert minhash.near_duplicates(spark.createDataFrame([], "doc_id bigint, text string")).count() == 0
    none = spark.createDataFrame([], "vec_id bigint, embedding array<float>")
    assert embeddings.near_duplicates(none).count() == 0
    assert components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


def test_signatures_estimate_the_overlap():
    rng = np.random.default_rng(4)
    errors = []
    for _ in range(200):
        both = rng.integers(0, 2**63, 80, dtype=np.uint64)
        one, other = (rng.integers(0, 2**63, 20, dtype=np.uint64) for _ in range(2))
        rows = minhash.signatures([np.unique(np.r_[both, one]), np.unique(np.r_[both, other])])
        errors.append((rows[0] == rows[1]).mean() - 80 / 120)
    # Unbiased, and no noisier than independent hashes.
    assert abs(np.mean(errors)) < 0.01
    assert np.std(errors) < 1.1 * np.sqrt(80 / 120 * 40 / 120 / minhash.SLOTS)


def test_components_of_a_long_chain_and_a_star(spark):
    links = [(n, n + 1) for n in range(100, 400)] + [(5, n) for n in range(1000, 1300)] + [(3, 3), (None, 4)]
    df = spark.createDataFrame(links, "a bigint, b bigint").repartition(7)
    found = {r.node: r.component for r in components(df).collect()}
    assert all(found[n] == 100 for n in range(100, 401))
    assert all(found[n] == 5 for n in [5, *range(1000, 1300)])


def test_embeddings_equal_brute_force(spark):
    rng = np.random.default_rng(9)
    centers = rng.standard_normal((12, 32))
    rows = [centers[n % 12] + 0.12 * rng.standard_normal(32) * (n % 3) for n in range(300)]
    vectors = np.array(rows, dtype=np.float32)
    data = [(n, v.tolist()) for n, v in enumerate(vectors)]
    odd = [(300, None), (301, []), (302, [0.0] * 32), (303, [float("nan")] * 32), (None, data[0][1])]
    odd += [(304, [None] * 32), (305, [1.0, 2.0]), (306, [2.0, 4.0]), (307, data[5][1]), (307, data[5][1])]
    df = spark.createDataFrame(data + odd, "vec_id bigint, embedding array<float>")
    unit = vectors.astype(float) / np.linalg.norm(vectors.astype(float), axis=1, keepdims=True)
    near = unit @ unit.T >= 0.9
    links = [(a, b) for a, b in zip(*np.nonzero(near), strict=True) if a < b]
    roots = union_find(range(300), links)
    for block in (16, 2048):
        result = embeddings.near_duplicates(df, block=block)
        rows = result.collect()
        found = {r.vec_id: r for r in rows if r.vec_id is not None}
        assert len(rows) == len(data) + len(odd)
        for n in range(300):
            more = 2 if near[n, 5] else 0
            assert found[n].n_links == near[n].sum() - 1 + more
            assert found[n].component_id == roots[n]
        assert found[305].n_links == 1 and found[306].component_id == 305
        for n in (300, 301, 302, 303, 304):
            assert (found[n].n_links, found[n].component_id, found[n].kept) == (0, n, True)
        assert [r.kept for r in rows if r.vec_id is None] == [True]


@pytest.mark.parametrize("n", [10_000, 1_000_000, 33_000_000])
def test_bands_miss_no_more_for_more_rows(n):
    rng = np.random.default_rng(12)
    one, other = rng.standard_normal((2, 20_000, 64))
    one /= np.linalg.norm(one, axis=1, keepdims=True)
    other -= (one * other).sum(axis=1, keepdims=True) * one
    other /= np.linalg.norm(other, axis=1, keepdims=True)
    other = 0.9 * one + math.sqrt(1 - 0.81) * other
    plan = embeddings.band_plan(n, 0.9, embeddings.MISS)
    assert len(np.unique(plan)) == plan.size
    turn = embeddings.band_rotation(64, plan)
    same = embeddings.band_keys(one, plan, turn) == embeddings.band_keys(other, plan, turn)
    # Three standard deviations above the stated chance.
    missed = (~same.any(axis=1)).mean()
    assert missed < embeddings.MISS + 3 * math.sqrt(embeddings.MISS / len(one)), missed


def test_pipeline_stage_drops_near_duplicates_at_80_percent(spark):
    rng = np.random.default_rng(5)
    rows, n = [], 0
    for group in range(40):
        base = [f"g{group}w{k}" for k in range(100)]
        for _ in range(3):
            words = list(base)
            for place in rng.choice([10, 25, 40, 55, 70, 85], rng.integers(0, 4), replace=False):
                words[place] = f"x{n}_{place}"
            rows.append((n, " ".join(words), f"s{n % 3}"))
            n += 1
    sets = {i: shingle_set(text) for i, text, _ in rows}
    alike = {
        (a, b): 100 * len(sets[a] & sets[b]) / len(sets[a] | sets[b])
        for a in sets
        for b in sets
        if a < b
    }
    assert sum(80 <= share < 85 for share in alike.values()) > 5
    assert sum(70 <= share < 80 for share in alike.values()) > 5
    roots = union_find(sorted(sets), [pair for pair, share in alike.items() if share >= 80])
    df = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    left = corpus_pipeline.near_dedup(spark, df, "").collect()
    assert sorted(tuple(r) for r in left) == [row for row in rows if roots[row[0]] == row[0]]


@pytest.mark.parametrize("rows", [[(1, None), (2, "")], [(1, None)] * 7, [(3, " \n"), (4, None), (5, "one")]])
def test_texts_without_words(spark, rows):
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    assert got(minhash.near_duplicates(df)) == expected(rows)


@pytest.mark.parametrize("extra", [-4, 0, 1000])
def test_a_text_that_ends_the_slice(spark, extra):
    """The last text of a batch takes the slice to its bound, below it and above it."""
    n = minhash._SLICE_SHINGLES + 4 + extra
    long = " ".join(f"w{k}" for k in range(n))
    rows = [(1, None), (2, long), (3, long + " end"), (4, "")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").coalesce(1)
    assert got(minhash.near_duplicates(df)) == expected(rows)


def sub_groups(rng, n_groups, size):
    """Near copies of texts that are themselves half alike: they share bands, across groups too."""
    shared = [f"w{n}" for n in range(140)]
    rows = []
    for group in range(n_groups):
        base = shared + [f"g{group}_{n}" for n in range(20)]
        for _ in range(size):
            words = list(base)
            words[int(rng.integers(0, 3))] = f"x{len(rows)}"
            rows.append((len(rows), " ".join(words)))
    return rows


@pytest.mark.parametrize("part_shingles", [1_000, 8_000])
def test_pivots_settle_sub_groups(spark, part_shingles, monkeypatch):
    rows = sub_groups(np.random.default_rng(3), 6, 15)
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    met = []
    settle = minhash.settle_by_pivots

    def seen(members, *args):
        left, links = settle(members, *args)
        met.append((members.count(), left.count()))
        return left, links

    monkeypatch.setattr(minhash, "settle_by_pivots", seen)
    assert got(minhash.near_duplicates(df, part_shingles=part_shingles)) == expected(rows)
    (all_members, left), = met
    # Whole sub-groups go with their pivot, so next to nothing meets in parts.
    assert all_members > 60 and left < 0.2 * all_members


def test_rows_of_one_id_with_different_texts(spark):
    def text(name, changed=0):
        return " ".join(f"{name}{n}" if n >= changed else f"x{n}" for n in range(80))

    rows = [(0, text("a")), (1, text("a")), (1, text("b")), (2, text("b")), (3, text("c")), (1, text("a", 2))]
    rows += [(5, text("d")), (6, text("d", 2)), (6, text("e")), (6, None), (6, "")]
    df = spark.createDataFrame([(i, t, t) for i, t in rows], "doc_id bigint, text string, text_key string")
    left = minhash.drop_near_duplicates(df)
    assert left.schema == df.schema
    want = [rows[k][:2] for k in (0, 2, 4, 6, 8, 9, 10)]
    assert sorted(((r.doc_id, r.text) for r in left.collect()), key=str) == sorted(want, key=str)
    judged = sorted((r.doc_id, r.component_id, r.kept) for r in minhash.near_duplicates(df).collect())
    # The first text of row 1 belongs to row 0, its second one to itself, with row 2.
    assert judged[:5] == [(0, 0, True), (1, 0, False), (1, 0, False), (1, 1, True), (2, 1, False)]


def test_batches_of_three_rows(spark):
    rng = np.random.default_rng(2)
    rows = [(n, " ".join(f"w{k}" for k in rng.integers(0, 9, int(rng.integers(0, 40))))) for n in range(20)]
    rows += [(100 + n, t) for n, t in rows[:10]] + [(50, None), (51, None), (52, None), (53, " \n"), (54, "")]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    try:
        df = spark.createDataFrame(rows, "doc_id bigint, text string").coalesce(1)
        assert got(minhash.near_duplicates(df)) == expected(rows)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_embeddings_of_any_size_and_clashing_columns(spark):
    """Doubles whose squares leave the range, signed zeros, and columns named like results."""
    rows = [(1, [1e-170, 2e-170]), (2, [2e-170, 4e-170]), (3, [1e160, 2e160]), (4, [1.0, -2.0]), (5, [5e-324, 0.0])]
    rows += [(6, [1.0, 0.0]), (7, [1.0, -0.0]), (8, [float("inf"), 1.0]), (9, [1.0, 2.0, 0.0]), (9, [0.0, 0.0, 7.0])]
    df = spark.createDataFrame(
        [(i, v, 5, b"", 1) for i, v in rows],
        "vec_id bigint, embedding array<double>, n_links int, code binary, node bigint",
    )
    found = [tuple(r) for r in embeddings.near_duplicates(df).collect()]
    want = [(1, 2, 1), (2, 2, 1), (3, 2, 1), (4, 0, 4), (5, 2, 5), (6, 2, 5), (7, 2, 5), (8, 0, 8), (9, 0, 9), (9, 0, 9)]
    assert sorted(found) == [(i, n, c, i == c) for i, n, c in want]


def test_vectors_of_classes_without_partners_stay_where_they_are(spark, monkeypatch):
    rng = np.random.default_rng(6)
    vectors = rng.standard_normal((600, 48))
    vectors[:60:2] = vectors[1:60:2] + 0.05 * rng.standard_normal((30, 48))
    df = spark.createDataFrame([(n, v.tolist()) for n, v in enumerate(vectors)], "vec_id bigint, embedding array<double>")
    placed, seen = embeddings._placed, []
    monkeypatch.setattr(embeddings, "_placed", lambda rows, *args: seen.append(rows) or placed(rows, *args))
    result = embeddings.near_duplicates(df)
    assert result.where("n_links = 1").count() == 60
    codes, fetched = seen
    assert "vector" not in codes.columns and "vector" in fetched.columns
    # Chance agreement of short codes adds a few.
    assert fetched.select("node").distinct().count() < 100
