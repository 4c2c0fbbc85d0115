"""URL filters, packing, chat formatting, archives and the pipeline."""

import glob
import gzip
import os
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tilerank.llm import chat, digests, minhash, packing, quality, secret_scan, toxicity, url_filter, warc
from tilerank.llm import queries as registered


def test_url_parts_and_rules(spark):
    cases = [
        ("HTTP://Sub.Example.NET/en/x?y#z", "sub.example.net", "/en/x", "example.net/en/"),
        ("http://example.net/EN/", "example.net", "/EN/", "net/"),
        ("http://net", "net", "", None),
        ("http://notexample.com/de/", "notexample.com", "/de/", None),
        ("http://example.com/de/a://b", "example.com", "/de/a://b", "example.com/de/"),
        ("x://É.org/fr/#q", "É.org", "/fr/", "org/fr/"),
        ("no scheme", "", "", None),
        ("", "", "", None),
        (None, "", "", None),
    ]
    df = spark.createDataFrame([(n, c[0], "t") for n, c in enumerate(cases)], "page_id bigint, url string, template string")
    rows = {r.page_id: r for r in url_filter.judge_urls(df).collect()}
    assert len(rows) == len(cases)
    for n, (_, host, path, rule) in enumerate(cases):
        assert (rows[n].host, rows[n].path, rows[n].rule) == (host, path, rule)
        assert rows[n].verdict in ("allow", "block")
    assert rows[8].verdict == "allow"


def test_templates_of_bad_urls_are_blocked(spark):
    rows, n = [], 0
    for i in range(200):
        for part, share in (("shop", 0.95), ("news", 0.02), ("blog", 0.03)):
            bad = None if i % 4 == 0 else (i % 100) < 100 * share
            rows.append((n, f"http://h.test/{part}/{i}.html", bad))
            n += 1
    df = spark.createDataFrame(rows, "page_id bigint, url string, bad boolean")
    judged = url_filter.judge_urls(df, bad="bad", rules=())
    verdicts = {(r.template, r.verdict) for r in judged.select("template", "verdict").distinct().collect()}
    # news and blog are alike and become one branch.
    assert verdicts == {("/shop/<n>", "block"), ("/<~blog>/<n>", "allow")}


def test_many_even_sections_and_rare_ones_keep_their_own_verdicts(spark):
    # 40 sections of equal size, two of them wholly bad.
    rows = [(f"http://even.test/part{p}/{i}", p in (7, 31)) for p in range(40) for i in range(20)]
    # Sections from good to wholly bad in small steps: neighbours are alike, the ends are not.
    rows += [(f"http://steps.test/part{p}/{i}", i < p) for p in range(31) for i in range(30)]
    # Rare sections of a hot host, one of them wholly bad and the other without labels.
    rows += [(f"http://hot.test/en/{i}", False if i < 400 else None) for i in range(1000)]
    rows += [(f"http://hot.test/de/{i}", True) for i in range(12)]
    rows += [(f"http://hot.test/it/{i}", None) for i in range(12)]
    # Numbers stay numbers.
    rows += [(f"http://hot.test/en/{i}", False) for i in range(100) for _ in range(3)]
    df = spark.createDataFrame([(n, *r) for n, r in enumerate(rows)], "page_id bigint, url string, bad boolean")
    judged = url_filter.judge_urls(df, bad="bad", rules=()).collect()
    assert len(judged) == len(rows)
    found = {}
    for r in judged:
        found.setdefault((r.host, r.path.split("/")[1]), set()).add(r.verdict)
    assert all(len(v) == 1 for v in found.values())
    blocked = {key for key, v in found.items() if v == {"block"}}
    assert {k for k in blocked if k[0] == "even.test"} == {("even.test", "part7"), ("even.test", "part31")}
    assert {("steps.test", "part30"), ("steps.test", "part29")} <= blocked
    assert not {("steps.test", f"part{p}") for p in range(20)} & blocked
    assert {k for k in blocked if k[0] == "hot.test"} == {("hot.test", "de")}
    assert {r.template for r in judged if r.path.startswith("/en/")} == {"/en/<n>"}


def test_deep_branches_have_templates_of_their_own(spark):
    rows = [(f"http://h.test/a/b/c/d/e/{part}/{i}", part == "shop") for part in ("shop", "news") for i in range(30)]
    rows += [("http://one.test/a/b/c/d/e/f/1", None)] * 3 + [("http://two.test/a/2/c/d/e/6.html", None)]
    df = spark.createDataFrame([(n, *r) for n, r in enumerate(rows)], "page_id bigint, url string, bad boolean")
    judged = url_filter.judge_urls(df, bad="bad", rules=())
    assert {(r.template, r.verdict) for r in judged.collect()} == {
        ("/a/b/c/d/e/shop/<n>", "block"),
        ("/a/b/c/d/e/news/<n>", "allow"),
        ("/a/b/c/d/e/f/1", "allow"),
        ("/<*>/<n>/<*>/<*>/<*>/<n>", "allow"),
    }
    cut = url_filter.judge_urls(df, bad="bad", rules=(), levels=2).select("template").distinct().collect()
    assert {r.template for r in cut} == {"/a/b/<..>", "/<*>/<n>/<..>"}


def test_no_pages(spark):
    none = spark.createDataFrame([], "page_id bigint, url string, html string")
    assert url_filter.judge_urls(none).count() == 0
    assert warc.archive_and_index(none).count() == 0


def brute_best_fit(lengths, sources, clusters, capacity):
    bins = []
    for row in sorted(range(len(lengths)), key=lambda r: -lengths[r]):
        fits = [
            b
            for b in bins
            if b["left"] >= lengths[row] and sources[row] not in b["s"] and clusters[row] not in b["c"]
        ]
        if fits:
            target = min(fits, key=lambda b: b["left"])
        else:
            target = {"left": capacity, "s": set(), "c": set(), "rows": []}
            bins.append(target)
        target["left"] -= lengths[row]
        target["s"].add(sources[row])
        target["c"].add(clusters[row])
        target["rows"].append(row)
    return bins


def test_packing_is_the_tightest_compatible_fit():
    rng = np.random.default_rng(3)
    for _ in range(30):
        n = 150
        lengths = rng.integers(1, 100, n).tolist()
        sources = [f"s{x}" for x in np.minimum(rng.geometric(0.3, n), 12)]
        clusters = [f"c{x}" for x in rng.integers(0, 90, n)]
        last, full, total = packing.pack_rows(lengths, sources, clusters, 100)
        bins = brute_best_fit(lengths, sources, clusters, 100)
        assert total == len(bins) and set(full) == {-1}
        held = {}
        for row, number in enumerate(last):
            held.setdefault(number, []).append(row)
        # Ties between equally tight bins may fall differently; what bins hold may not clash.
        for rows in held.values():
            assert sum(lengths[r] for r in rows) <= 100
            assert len({sources[r] for r in rows}) == len({clusters[r] for r in rows}) == len(rows)


@pytest.mark.parametrize("per_task", [7, 20_000])
def test_packing_keeps_every_character_once(spark, per_task):
    rows = [(n, "abcdefghij" * (n % 23), f"s{n % 4}") for n in range(120)]
    rows += [(500, None, None), (501, "", "s1"), (502, "é" * 1000, None), (502, "é" * 1000, None), (None, "zz", "s1")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    pieces = packing.pack(df, capacity=64, with_text=True, rows_per_task=per_task).collect()
    texts, bins = {}, {}
    for p in pieces:
        texts.setdefault((p.doc_id, p.piece, p.piece_start), []).append(p.piece_text)
        assert len(p.piece_text) == p.piece_length <= 64
        assert (p.bin_id is None) == (p.piece_length == 0)
        if p.bin_id is not None:
            bins.setdefault(p.bin_id, []).append(p)
    for doc_id, text, _ in rows[:120]:
        whole = "".join(texts[k][0] for k in sorted(k for k in texts if k[0] == doc_id))
        assert whole == text
    assert sum(p.piece_length for p in pieces) == sum(len(t or "") for _, t, _ in rows)
    source = {r[0]: r[2] for r in rows}
    for held in bins.values():
        end = 0
        for p in sorted(held, key=lambda p: p.bin_offset):
            assert p.bin_offset == end
            end += p.piece_length
        assert end <= 64
        named = [source[p.doc_id] for p in held if source[p.doc_id] is not None]
        assert len(named) == len(set(named))


def naive_bins(lengths, sources, clusters, capacity):
    """Best fit by looking at all bins: [residual, when it got that residual, keys]."""
    bins, last = [], [-1] * len(lengths)
    for time, row in enumerate(sorted(range(len(lengths)), key=lambda r: -(lengths[r] % capacity))):
        size = lengths[row] % capacity
        if not size:
            continue
        keys = {("s", sources[row]), ("c", clusters[row])} - {("s", None), ("c", None)}
        fits = [(b[0], b[1], k) for k, b in enumerate(bins) if b[0] >= size and not b[2] & keys]
        if fits:
            number = min(fits)[2]
        else:
            number = len(bins)
            bins.append([capacity, time, set()])
        bins[number] = [bins[number][0] - size, time, bins[number][2] | keys]
        last[row] = number
    return last


@pytest.mark.parametrize("seed", range(4))
def test_each_piece_goes_to_the_tightest_bin_and_ties_to_the_first_that_got_there(seed):
    rng = np.random.default_rng(seed)
    n, capacity = 400, int(rng.choice([20, 64]))
    lengths = rng.integers(0, 2 * capacity, n).tolist()
    sources = [None if x == 0 else f"s{x}" for x in rng.integers(0, 6, n)]
    clusters = [None if x < 20 else int(x) for x in rng.integers(0, 80, n)]
    assert packing.pack_rows(lengths, sources, clusters, capacity)[0] == naive_bins(lengths, sources, clusters, capacity)


def test_no_bin_holds_two_near_copies(spark):
    def text(group, n):
        return " ".join(f"g{group}w{k}" if k != 3 * n else f"x{n}" for k in range(90))

    rows = [(10 * g + n, text(g, n), f"s{g}{n}") for g in range(12) for n in range(5)]
    rows += [(1000 + k, "short text", None) for k in range(4)] + [(None, "no id", "s"), (1, None, "s"), (2, "", "s")]
    df = spark.createDataFrame([(*r, 7) for r in rows], "doc_id bigint, text string, source string, cluster int")
    pieces = packing.pack(df, clusters=minhash.labelled(df)).collect()
    assert sorted(p.doc_id or -1 for p in pieces) == sorted(r[0] or -1 for r in rows)
    held = [(p.bin_id, p.doc_id // 10 if p.doc_id < 1000 else 100) for p in pieces if p.doc_id is not None and p.bin_id is not None]
    assert len(set(held)) == len(held)
    # Without the clusters, near copies of different sources share bins.
    plain = packing.pack(df).collect()
    held = [(p.bin_id, p.doc_id // 10) for p in plain if p.doc_id is not None and p.doc_id < 1000 and p.bin_id is not None]
    assert len(set(held)) < len(held)
    none = df.where("doc_id = -5")
    assert packing.pack(none, clusters=minhash.labelled(none)).collect() == []


def test_chat_round_trip_and_order(spark):
    said = "</s>[INST] ok [/INST]"
    rows = [(1, 2, "assistant", "b\\<s>"), (1, 1, "user", said), (1, None, None, None), (1, 2, "assistant", "a")]
    rows += [(2, 0, "tool\nx\\", "text with <\\s> and [\\INST]"), (2, 0, "tool\nx\\", "text with <\\s> and [\\INST]")]
    rows += [(None, 0, "user", "lost")]
    df = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string")
    parts = chat.format_conversations(df).collect()
    whole = {}
    for p in sorted(parts, key=lambda p: (str(p.conv_id), p.turn_no)):
        assert p.span_start == len(whole.get(p.conv_id, ""))
        whole[p.conv_id] = whole.get(p.conv_id, "") + p.output
    assert chat.read_back(whole[1]) == [("", ""), ("user", said), ("assistant", "a"), ("assistant", "b\\<s>")]
    assert chat.read_back(whole[2]) == [("tool\nx\\", "text with <\\s> and [\\INST]")] * 2
    assert chat.read_back(whole[None]) == [("user", "lost")]
    for p in parts:
        text = chat.unescape(whole[p.conv_id][p.text_start : p.text_end])
        assert (p.role, text) in chat.read_back(p.output)


def test_templates_that_rewrite_history_are_found():
    turns = [("user", f"t{n}") for n in range(50)]

    def counts(held):
        return f"[{len(held)}]" + "".join(text for _, text in held)

    def drops_thoughts(held):
        return "".join(t if r != "assistant" or n + 1 == len(held) else "" for n, (r, t) in enumerate(held))

    with pytest.raises(chat.RewritesHistory):
        list(chat.incremental_spans(turns, counts))
    with pytest.raises(chat.RewritesHistory):
        list(chat.incremental_spans([("user", "q"), ("assistant", "a"), ("user", "r")], drops_thoughts))

    def remembers(held):
        return "".join(f"{t}({n})" for n, (_, t) in enumerate(held))

    with pytest.raises(chat.RewritesHistory):
        list(chat.incremental_spans(turns, remembers, window=4))
    spans = list(chat.incremental_spans(turns, chat.instruction_template, window=4))
    assert "".join(s.output for s in spans) == chat.instruction_template(turns)


def test_long_conversations_are_rendered_whole(spark):
    turns = [("user" if n else "system", f"t{n}") for n in range(150)]

    def numbers(held):
        return "".join(f"{t}({n})" for n, (_, t) in enumerate(held))

    def needs_start(held):
        if held and held[0][0] != "system":
            raise ValueError("no start")
        return "".join(f"<{t}>" for _, t in held)

    def forgets(held):
        return "".join(f"<{t}>" for _, t in held[-40:])

    def marks_late_turns(held):
        return "".join(f"<{t}>" + "!" * (n > 100) for n, (_, t) in enumerate(held))

    for template in (numbers, needs_start, marks_late_turns, chat.instruction_template):
        for n in (31, 32, 33, 64, 100, 150):
            spans = list(chat.incremental_spans(turns[:n], template))
            whole = [template(turns[: k + 1])[len(template(turns[:k])) :] for k in range(n)]
            assert [s.output for s in spans] == whole
            assert [s.output[s.begin : s.end] for s in spans] == [t for _, t in turns[:n]]
    assert len(list(chat.incremental_spans(turns[:40], forgets))) == 40
    with pytest.raises(chat.RewritesHistory, match="turn 40 "):
        list(chat.incremental_spans(turns, forgets))

    def wavers(held):
        # Takes back at 46 turns what it said, and says it again at 49.
        return "".join(f"<{t}>" for _, t in held[3 * (46 <= len(held) < 49) :])

    assert len(list(chat.incremental_spans(turns[:45], wavers))) == 45
    with pytest.raises(chat.RewritesHistory, match="turn 45 "):
        list(chat.incremental_spans(turns, wavers))

    rows = [(c, n, f"r{n}", f"t{n}") for c in (1, 2) for n in range(70)]
    df = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string")
    parts = chat.format_conversations(df, template=numbers).collect()
    assert sorted((p.conv_id, p.turn_no, p.role, p.output) for p in parts) == [
        (c, n, f"r{n}", f"t{n}({n})") for c in (1, 2) for n in range(70)
    ]


def test_no_turns_and_clashing_columns(spark):
    schema = "conv_id bigint, turn bigint, role string, text string, output string, turn_no int, loss string"
    none = spark.createDataFrame([], schema)
    assert chat.format_conversations(none).collect() == []
    assert digests.conversation_digests(chat.format_conversations(none)).collect() == []
    df = spark.createDataFrame([(1, 2, "assistant", "b", "x", 9, "y"), (1, 1, "user", "a", "x", 9, "y")], schema)
    parts = chat.format_conversations(df).collect()
    assert [(p.turn_no, p.output, p.loss) for p in parts] == [(0, "<s>[INST] user\na [/INST]", False), (1, " b </s>", True)]


def test_loser_tree_merges_runs():
    rng = np.random.default_rng(8)
    for k in range(0, 12):
        runs = [sorted((int(x),) for x in rng.integers(0, 50, rng.integers(0, 20))) for _ in range(k)]
        assert list(warc.merge_runs(runs)) == sorted(x for run in runs for x in run)


def test_archives_round_trip(spark):
    big, other = "é" * 600, "x" * 999
    tricky = "WARC/1.1\r\nContent-Length: 5\r\n\r\nhello\r\n\r\n" * 40
    rows = [(1, "http://a.test/x", big), (5, "http://a.test/y", big), (3, None, big), (2, "u", None), (4, "u", "")]
    rows += [(6, "http://b.test/", other), (7, "http://b.test/", other), (8, "bad\r\nurl", tricky), (9, "c", tricky)]
    rows += [(5, "http://a.test/y", big), (None, "http://n.test", big)]
    df = spark.createDataFrame(rows, "page_id bigint, url string, html string")
    found = {}
    for r in warc.archive_and_index(df).collect():
        found.setdefault(r.page_id, []).append(r)
    assert sum(map(len, found.values())) == len(rows)
    assert [(r.record_type, r.refers_to) for r in found[1]] == [("revisit", 5)]
    assert [(r.record_type, r.refers_to) for r in found[5]] == [("response", None)] * 2
    assert [(r.record_type, r.refers_to) for r in found[None]] == [("revisit", 5)]
    assert {r.record_type for n in (2, 4, 6, 7) for r in found[n]} == {"response"}
    assert found[8][0].refers_to == 9 and found[8][0].payload_bytes == len(tricky)
    assert found[1][0].payload_bytes == 1200 and found[2][0].payload_bytes == 0


def test_archives_are_plain_warc_and_the_index_is_ordered(spark, sf_dir, folder):
    pages = registered.read(spark, sf_dir, "pages")
    warc.write_archives(warc.decide(pages).repartition(5), folder + "/a", file_bytes=20_000)
    files = glob.glob(folder + "/a/*/part-*")
    assert len(files) > 5
    # Bounded by bytes, whatever the records' sizes, and readable as one gzip stream.
    sizes = [os.path.getsize(path) for path in files]
    kinds = []
    for path in files:
        found = [f[b"warc-type"] for f, _, _ in warc.parse(gzip.open(path).read())]
        assert os.path.getsize(path) <= 20_000 or len(found) == 1
        kinds += found
    assert len(kinds) == pages.count() and sum(sizes) > 0
    captures = warc.read_archives(spark, folder + "/a")
    merged = warc.merged_index(captures, range_rows=40, fan_in=3)
    rows = merged.withColumn("part", F.spark_partition_id()).collect()
    order = [(r.urlkey, r.captured, r.page_id) for r in rows]
    assert order == sorted(order) and len(order) == len(kinds)
    assert max(Counter(r.part for r in rows).values()) < 120
    assert sorted(tuple(r) for r in merged.collect()) == sorted(
        tuple(r) for r in captures.select(merged.columns).collect()
    )
    # A row of the index finds its record.
    by_id = {r.page_id: r.html for r in pages.collect()}
    for row in rows[:: max(1, len(rows) // 5)]:
        fields, block = warc.fetch_record(spark, folder + "/a", row.run, row.run_offset, row.run_length)
        assert fields[b"warc-target-uri"].decode() == row.url and fields[b"warc-type"].decode() == row.record_type
        assert block == (b"" if row.record_type == "revisit" else (by_id[row.page_id] or "").encode())


def test_members_of_records_above_16_mb():
    large = random.Random(1).randbytes(1 << 24)
    made = [warc.member(data) for data in (b"one", large, b"two")]
    assert all(data[-1] == 0 for data in made)
    joined = b"".join(made)
    assert gzip.decompress(joined) == b"one" + large + b"two"
    found = list(warc.members(joined))
    assert [content for _, _, content in found] == [b"one", large, b"two"]
    assert [joined[a : a + n] for a, n, _ in found] == made


def test_no_pages_and_clashing_columns(spark):
    none = spark.createDataFrame([], "page_id bigint, url string, html string")
    assert warc.archive_and_index(none).count() == 0
    df = spark.createDataFrame(
        [(1, "http://a/", "x" * 1200, "r", 1), (2, "http://b/", "x" * 1200, "r", 2)],
        "page_id bigint, url string, html string, run string, payload_digest int",
    )
    rows = warc.archive_and_index(df).collect()
    assert [(r.page_id, r.record_type, r.refers_to) for r in rows] == [(1, "revisit", 2), (2, "response", None)]


def test_pipeline_stages_take_effect(spark, sf_dir):
    docs = registered.read(spark, sf_dir, "documents")
    columns, seen = docs.schema, [docs.count()]
    kept = [docs]
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, sf_dir).cache()
        seen.append(docs.count())
        kept.append(docs)
    for df in kept[1:-1]:
        assert [f.name for f in df.schema] == [f.name for f in columns]
    assert seen[0] > seen[1] > seen[2] >= seen[3] == seen[4]
    failed = quality.with_statistics(kept[1]).where(quality.base_failed())
    assert failed.count() == 0
    assert secret_scan.scan(kept[4]).where("spans <> ''").count() == 0
    assert kept[4].where(F.col("n_chars") != F.length("text")).count() == 0
    total = kept[5].agg(F.sum("piece_length")).first()[0]
    assert total == kept[4].agg(F.sum(F.length("text"))).first()[0]
    for df in kept[1:]:
        df.unpersist()


def test_pipeline_run_equals_its_stages_by_hand(spark, sf_dir):
    docs = registered.read(spark, sf_dir, "documents")
    n = docs.count()
    steps = [
        lambda d: quality.filter_documents(d, quality.fit_rules(d, registered.read(spark, sf_dir, "labels"))),
        lambda d: toxicity.filter_documents(d, toxicity.fit_toxicity(d, registered.read(spark, sf_dir, "labels"))),
        lambda d: minhash.drop_near_duplicates(d, percent=80),
        lambda d: secret_scan.with_length(secret_scan.redact(d)),
        lambda d: packing.pack(d, with_text=True),
    ]
    assert len(steps) == len(corpus_pipeline.STAGES)
    for step in steps:
        docs = step(docs).cache()
        docs.count()
    # Some bins number differently if rows are dealt to several tasks.
    names = [name for name in docs.columns if n < packing.ROWS_PER_TASK or not name.startswith("bin_")]
    made = [sorted(map(tuple, df.select(names).collect())) for df in (corpus_pipeline.run(spark, sf_dir), docs)]
    assert made[0] and made[0] == made[1]
