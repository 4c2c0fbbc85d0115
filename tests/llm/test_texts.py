"""Operators on texts, against brute force and on odd rows."""

import hashlib
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tilerank.llm import bpe, quality, samples, secret_scan, toxicity
from tilerank.llm import queries as registered
from tilerank.llm.automaton import match_automaton, search_automaton

WORD = re.compile(r"[^\x20\x09-\x0D]+")
ODD = [
    (1, None),
    (2, ""),
    (3, " \n\t "),
    (4, "one two three"),
    (5, "a b c d e a b c d e a b c d e"),
    (5, "a b c d e a b c d e a b c d e"),
    (None, "Ünïcode “text” 日本 😀 password: hunter2-long"),
    (6, "x" * 300_000),
    (7, "line\nline\n\nLine\r\nline"),
    (8, "a\u00a0b\x1cc\u3000d e"),
]


@pytest.fixture(scope="module")
def odd(spark):
    # Extra columns, one of them named like a result.
    rows = [(i, t, "fr", 1.0) for i, t in ODD]
    return spark.createDataFrame(rows, "doc_id bigint, text string, lang string, score double")


@pytest.fixture(scope="module")
def documents(spark, sf_dir):
    return registered.read(spark, sf_dir, "documents")


def texts_of(df):
    return [(row.doc_id, row.text or "") for row in df.select("doc_id", "text").collect()]


def base_quality(text):
    words = WORD.findall(text)
    runs = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    seen = {}
    for run in runs:
        seen[run] = seen.get(run, 0) + 1
    covered = {p for i, run in enumerate(runs) if seen[run] > 1 for p in range(i, i + 5)}
    lines = [line for line in text.split("\n") if WORD.search(line)]
    return (
        len(words),
        sum(map(len, words)),
        sum(c in "#*$%&|<>" for c in text),
        len(lines) - len(set(lines)),
        len(covered),
        len(words) < 10 or 100 * len(covered) > 20 * len(words),
    )


@pytest.mark.parametrize("which", ["odd", "documents"])
def test_quality_statistics_equal_brute_force(request, which):
    docs = request.getfixturevalue(which)
    got = quality.judge(docs, quality.DecisionList(), keep=["doc_id"]).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"
    )
    want = sorted((i if i is not None else -1, *base_quality(t)) for i, t in texts_of(docs))
    assert sorted((r[0] if r[0] is not None else -1, *r[1:]) for r in got.collect()) == want


def test_rules_are_learned_and_become_one_expression(spark):
    rng = np.random.default_rng(3)
    rows = []
    for i in range(600):
        words = ["w%d" % n for n in rng.integers(0, 900, 60)]
        bad = i % 4 == 0
        rows.append((i, " ".join(f"{w}%%%" if bad else w for w in words), 0 if bad else 1))
    df = spark.createDataFrame(rows, "doc_id bigint, text string, quality int")
    rules = quality.fit_rules(df.select("doc_id", "text"), df.select("doc_id", "quality"))
    assert rules.rules
    judged = quality.judge(df, rules)
    assert judged.where("kept <> (quality = 1)").count() == 0
    assert judged.where("rule IS NULL AND NOT kept AND NOT base_failed").count() == 0


def test_learned_verdicts_equal_row_by_row(spark, sf_dir, documents):
    labels = registered.read(spark, sf_dir, "labels")
    rules = quality.fit_rules(documents, labels)
    rules.rules.append([quality.Condition("upper_per_char", True, 0.05), quality.Condition("n_words", False, 300.0)])
    rows = quality.judge(documents, rules).collect()

    def measure(row, name):
        top, bottom = quality.MEASURES[name]
        return row[top] / (max(row[bottom], 1) if bottom else 1)

    fired = 0
    for row in rows:
        hit = None
        for number, rule in enumerate(rules.rules):
            if all((measure(row, c.measure) >= c.threshold) == c.above for c in rule):
                hit = number
                break
        assert row.kept == (not base_quality(row.text or "")[5] and hit is None)
        assert (row.rule is None) == (hit is None)
        if hit is not None:
            fired += 1
            assert row.rule == hit + 1
    assert 0 < fired < len(rows)


def test_scores_equal_noisy_or_by_hand(spark, sf_dir, documents, odd):
    """Weights of each word's buckets, a logistic per sentence, one minus the product."""
    model = toxicity.fit_toxicity(documents, registered.read(spark, sf_dir, "labels"))
    assert np.count_nonzero(model.weights) > 0
    marks = re.compile(r"""[,;:"'()\[\]{}%*$&#|<>=+~^\\/_\-\t\x0b\x0c]""")
    for df in (documents, odd.select("doc_id", "text")):
        for row in toxicity.score_documents(df, model).collect():
            harmless = 1.0
            for sentence in re.split(r"[.!?\n\r]", (row.text or "").lower()):
                words = [w.encode() for w in marks.sub(" ", sentence).encode().decode().split(" ") if w]
                if not words:
                    continue
                logit = model.bias
                for word in words:
                    keys = (b" " + word, word[:3], word[:4], word[:5], word[:6])
                    logit += sum(model.weights[zlib.crc32(key) % toxicity.BUCKETS] for key in keys)
                harmless *= 1 - 1 / (1 + np.exp(-logit))
            assert abs(row.score - (1 - harmless)) < 1e-9


def test_repeated_rows_and_long_texts_do_not_reach_the_driver(spark):
    words = [f"w{n}" for n in range(60)]
    docs = [(n, " ".join(words[n % 7 :])) for n in range(40)] + [(1, f"copy {n}") for n in range(300)] + [(2, "long " * 5000)]
    df = spark.createDataFrame([(*d, "x") for d in docs], "doc_id bigint, text string, label string")
    labels = spark.createDataFrame([(n, n % 2) for n in range(40)] * 3 + [(5, 0), (None, 1), (7, None)], "doc_id bigint, toxic int")
    sample = samples.sampled_labels(labels, "toxic", 30)
    assert sample.count() == 30 and sample.select("doc_id").distinct().count() == 30
    found = samples.sampled_texts(df, samples.sampled_labels(labels, "toxic", 40), "text", 64 * 400)
    rows = found.collect()
    assert len(rows) == len({r.doc_id for r in rows}) == 40
    assert {r.text for r in rows if r.doc_id == 2} == {docs[2][1]}
    few = samples.sampled_texts(df, samples.sampled_labels(labels, "toxic", 40), "text", 64 * 230).collect()
    assert sum(len(r.text) for r in few) <= 64 * 230


def test_without_labels_nothing_is_learned(spark, odd):
    none = spark.createDataFrame([], "doc_id bigint, quality int, toxic int")
    assert quality.fit_rules(odd, none).rules == []
    model = toxicity.fit_toxicity(odd, none)
    assert toxicity.score_documents(odd, model).where("score >= 0.5").count() == 0


def test_filters_keep_columns_and_rows(spark, odd):
    kept = quality.filter_documents(odd, quality.DecisionList())
    assert kept.schema == odd.schema
    # Too short, or repeating itself; rows that are the same count each.
    assert kept.count() == 0
    model = toxicity.ToxicityModel(np.zeros(toxicity.BUCKETS), -6.0)
    same = toxicity.filter_documents(odd, model)
    assert same.schema == odd.schema and same.count() == len(ODD)


@pytest.mark.parametrize("operator", ["quality", "toxicity", "secrets", "bpe"])
def test_empty_tables(spark, operator):
    none = spark.createDataFrame([], "doc_id bigint, text string")
    import public_tokenizers

    made = {
        "quality": lambda: quality.judge(none, quality.DecisionList()),
        "toxicity": lambda: toxicity.score_documents(
            none, toxicity.ToxicityModel(np.zeros(toxicity.BUCKETS), -6.0)
        ),
        "secrets": lambda: secret_scan.scan(none),
        "bpe": lambda: bpe.encode_documents(none, public_tokenizers.path("byte_bpe_multi_50k.tiktoken")),
    }[operator]()
    assert made.count() == 0


def test_toxicity_is_learned_from_document_labels(spark):
    rng = np.random.default_rng(5)
    rows = []
    for i in range(800):
        lines = [" ".join(f"w{n}" for n in rng.integers(0, 200, 8)) for _ in range(6)]
        if i % 5 == 0:
            lines[rng.integers(0, 6)] += " zog" + "abc"[rng.integers(0, 3)] * 2
        rows.append((i, ". ".join(lines), int(i % 5 == 0)))
    df = spark.createDataFrame(rows, "doc_id bigint, text string, toxic int")
    model = toxicity.fit_toxicity(df, df)
    scored = toxicity.score_documents(df, model)
    apart = scored.where(toxicity.held_out())
    assert apart.count() > 100
    assert apart.where((F.col("score") >= 0.5) != (F.col("toxic") == 1)).count() == 0
    spans = toxicity.offending_sentences(df, model).join(df, "doc_id").collect()
    assert spans and all("zog" in r.text[r.span_start : r.span_end] for r in spans)


def test_labels_of_held_out_rows_teach_nothing(spark):
    rows = [(i, f"word{i % 7} here", i % 2) for i in range(400)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, toxic int")
    flipped = df.withColumn(
        "toxic", F.when(toxicity.held_out(), 1 - F.col("toxic")).otherwise(F.col("toxic"))
    )
    one, other = toxicity.fit_toxicity(df, df), toxicity.fit_toxicity(df, flipped)
    assert (one.weights == other.weights).all() and one.bias == other.bias


ASSIGN = re.compile(
    r"(?:password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.I | re.A
)


def base_secrets(text):
    found = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[1]) >= 6]
    found += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    found += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
    return [f"{('assign', 'access', 'hex')[k]}:{a}:{b}" for a, k, b in sorted(found)]


@pytest.mark.parametrize("which", ["odd", "documents"])
def test_base_secrets_equal_regular_expressions(request, which):
    docs = request.getfixturevalue(which)
    for row in secret_scan.scan(docs, keep=["doc_id", "text"]).collect():
        spans = [s for s in row.spans.split(",") if s.split(":")[0] in ("assign", "access", "hex")]
        assert spans == base_secrets(row.text or "")


def test_overlapping_and_failing_matches():
    scanner = secret_scan.Scanner()
    pieces = ["token", "TOKEN", "api_key", "passwd", "=", ":", " ", "'", "AKIA", "ABCD1234", "9f", "é"]
    pieces += ["0123456789abcdef", "\n", "-", "x"]
    rng = np.random.default_rng(11)
    for _ in range(4000):
        text = "".join(pieces[n] for n in rng.integers(0, len(pieces), rng.integers(0, 20)))
        got = [f"{k}:{a}:{b}" for k, a, b in scanner.spans(text.encode())]
        assert [s for s in got if s.split(":")[0] in ("assign", "access", "hex")] == base_secrets(text)


def test_redaction_leaves_nothing_behind(spark, odd):
    clean = secret_scan.redact(odd)
    assert clean.schema == odd.schema and clean.count() == len(ODD)
    assert clean.where("text IS NULL").count() == 1
    assert secret_scan.scan(clean).where("spans <> ''").count() == 0


def test_automata_read_the_regular_language():
    cases = ["ab*c", "(?:a|bc)+d?", "a{2,3}b", "[^a-c]x", r"\d+\.\w", "x?y{2,}"]
    rng = np.random.default_rng(2)
    whole = search_automaton([(p, False) for p in cases])
    assert whole.n_states > 1
    for pattern in cases:
        machine = match_automaton((pattern, False))
        expression = re.compile(pattern)
        for _ in range(400):
            text = "".join("abcdxy1.2"[n] for n in rng.integers(0, 9, 6)).encode()
            state = machine.start
            for byte in text:
                state = machine.moves[state + machine.classes[byte]]
            assert (state >= machine.telling) == bool(expression.fullmatch(text.decode()))


def test_bpe_equals_the_public_library(spark, odd, documents):
    import public_tokenizers
    import tiktoken

    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    ranks = bpe.Vocabulary(path).ranks
    other = tiktoken.Encoding(
        "own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}
    )
    tricky = spark.createDataFrame(
        [(i, t, "", 0.0) for i, t in enumerate(["it's 'tis ''s 'll'd", "a  b \n\n c  ", "<|endoftext|>", " 's"])],
        odd.schema,
    )
    for docs in (odd, tricky, documents):
        for row in bpe.encode_documents(docs, path, keep=["doc_id", "text"]).collect():
            text = row.text or ""
            ids = other.encode_ordinary(text)
            assert row.ids == ids and row.n_tokens == len(ids)
            assert row.ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
            assert row.decoded_sha256 == hashlib.sha256(text.encode()).hexdigest()


def test_perfect_hash_is_minimal():
    entries = [(b"%d" % n, n) for n in range(5000)]
    table = bpe.PerfectHash(entries)
    assert sorted(table.rank.tolist()) == list(range(5000))
