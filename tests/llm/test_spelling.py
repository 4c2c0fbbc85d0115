"""Spelling variants against brute force: searches, hot halves, forms and roots."""

import re
import zlib
from collections import Counter

import numpy as np
import pytest

from tilerank.llm import spelling

LOWER = {c: c + 32 for c in range(65, 91)}


def one_change(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    if len(a) > len(b):
        a, b = b, a
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def pairs_of(words):
    ordered = sorted(words)
    return {(a, b) for a in ordered for b in ordered if abs(len(a) - len(b)) < 2 and one_change(a, b)}


def brute(rows, least_length=6, least_count=5, ratio=5):
    counts = Counter()
    for key, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(LOWER)
            h = zlib.crc32(f"{'' if key is None else key}:{run}".encode())
            if h % 199 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            counts[run] += 1
    words = {w: n for w, n in counts.items() if len(w) >= least_length and n >= least_count}
    near = {}
    for a, b in pairs_of(words):
        near.setdefault(a, []).append((-words[b], b))
    form = {w: min(of)[1] for w, of in near.items() if -min(of)[0] >= ratio * words[w]}
    result = []
    for w, n in words.items():
        root = w
        while root in form:
            root = form[root]
        result.append((w, form.get(w), root, n, len(near.get(w, [])), words.get(form.get(w))))
    return sorted(result)


def random_words(rng, n, letters="abcé", low=5, high=10):
    return ["".join(rng.choice(list(letters), rng.integers(low, high))) for _ in range(n)]


def test_suffixes_are_sorted():
    rng = np.random.default_rng(2)
    for codes in (rng.integers(1, 3, 300), np.ones(64, dtype=np.int64), np.array([1, 2] * 50)):
        codes = np.append(codes, 0)
        want = sorted(range(len(codes)), key=lambda i: codes[i:].tolist())
        assert spelling._sorted_suffixes(codes).tolist() == want


def test_searches_find_all_near_words_of_a_half():
    rng = np.random.default_rng(1)
    words = sorted({w for w in random_words(rng, 600, "abé", high=11) if len(w) >= 6})
    index = spelling.Index(words, "z")
    found = set()
    for left in (True, False):
        for less in (0, 1):
            asked = [w for w in [*words, "zzzzzz"] if len(w) - less >= 6]
            query, near = index.near(asked, np.array([len(w) - less for w in asked]), left)
            some = {(asked[q], words[k]) for q, k in zip(query.tolist(), near.tolist(), strict=True)}
            for a, b in some:
                m = len(a) - less
                assert m == min(len(a), len(b))
                assert a[: m // 2] == b[: m // 2] if left else a[m // 2 - m :] == b[m // 2 - m :]
            found |= some
    assert found == pairs_of(words) and len(found) > 100


@pytest.mark.parametrize("part_words", [7, 4096])
def test_a_hot_half_loses_no_pair(spark, part_words):
    rng = np.random.default_rng(5)
    words = {"common" + w for w in random_words(rng, 150)} | {w + "common" for w in random_words(rng, 80)}
    words |= set(random_words(rng, 200, low=6)) | {"x" * 3000, "x" * 3001, "commonz"}
    df = spark.createDataFrame([(w, 1) for w in sorted(words)], "word string, n bigint")
    found = spelling.near_words(df.repartition(4), part_words=part_words).collect()
    assert sorted((r.word, r.near) for r in found) == sorted(pairs_of(words))


def test_texts_equal_brute_force(spark):
    rng = np.random.default_rng(8)
    words = random_words(rng, 120, "abÉ", 6, 9)
    rows = []
    for n in range(300):
        # Some words are much more frequent than their neighbours.
        chosen = [words[min(int(rng.zipf(1.4)) - 1, 119)] for _ in range(60)]
        rows.append((int(rng.integers(0, 10**6)), str(rng.choice([" ", ", ", "1", "\n"])).join(chosen).title()))
    rows += [(None, " ".join(words)), (3, None), (4, ""), (5, "1 2 3"), (6, "y" * 100_000), *rows[:5]]
    rows.append((7, "Kettle " * 200 + "kettla " * 30 + "kettlab " * 6))
    df = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id bigint, text string, word string")
    found = spelling.spelling_variants(df)
    assert found.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    want = brute(rows)
    assert sum(w[1] is not None for w in want) > 10 and any(w[2] != w[1] for w in want if w[1])
    assert sorted(tuple(r) for r in found.collect()) == want


def test_ties_go_to_the_first_in_code_point_order(spark):
    text = " ".join(["treeroots"] * 50 + ["treerootz"] * 50 + ["treerooté"] * 50 + ["treerootx"] * 10)
    rows = [(None, text)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    found = {r.word: r for r in spelling.spelling_variants(df).collect()}
    assert [tuple(r) for r in sorted(found.values())] == brute(rows)
    assert found["treerootx"].form == "treeroots" and found["treerootx"].n_near == 3


def test_no_rows(spark):
    df = spark.createDataFrame([], "doc_id bigint, text string")
    assert spelling.spelling_variants(df).collect() == []
