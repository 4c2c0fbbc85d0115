"""Windows over token streams: ids of the tokenizer, whole streams, and the cheapest cuts."""

import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from tilerank.llm import queries as registered, windows

PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def tokenizer():
    made = Tokenizer.from_file(PATH)
    made.encode_special_tokens = True
    return made


def padding(length, capacity):
    return 0 if length & (length - 1) == 0 else capacity - length


def cheapest(places, penalties, capacity):
    """The least cost of windows that end at the last place, by trying all starts."""
    at, cost = [0, *places], [0]
    for j in range(1, len(at)):
        cost.append(
            min(
                cost[i] + padding(at[j] - at[i], capacity) + penalties[j - 1] + windows.WINDOW_PENALTY
                for i in range(j)
                if at[j] - at[i] <= capacity
            )
        )
    return cost[-1]


@pytest.mark.parametrize("seed", range(6))
def test_cuts_cost_least(seed):
    rng = np.random.default_rng(seed)
    capacity = int(rng.choice([16, 64, 100]))
    steps = rng.integers(1, rng.integers(2, capacity), 400)
    places, penalties = np.cumsum(steps), rng.choice([0, 3, 20], 400)
    penalties[-1] = 0
    made = windows.Windows(capacity)
    cuts, at = [0], 0
    while at < 400:
        size = int(rng.integers(1, 60))
        made.extend(places[at : at + size], penalties[at : at + size])
        at += size
        found = made.settled(last=at >= 400)
        assert found[0] == cuts[-1]
        cuts += found[1:]
    assert cuts[-1] == places[-1]
    price = dict(zip(places.tolist(), penalties.tolist(), strict=True))
    total = sum(
        padding(b - a, capacity) + price[b] + windows.WINDOW_PENALTY for a, b in zip(cuts, cuts[1:], strict=False)
    )
    assert all(0 < b - a <= capacity for a, b in zip(cuts, cuts[1:], strict=False))
    assert total == cheapest(places.tolist(), penalties.tolist(), capacity)


def check(rows, pieces, tokenizer, capacity):
    """Every id of every row once, in order; windows without gaps. Returns the padding."""
    by_doc, by_window = {}, {}
    for p in pieces:
        by_doc.setdefault(p.doc_id, []).append(p)
        by_window.setdefault(p.sequence_id, []).append(p)
    assert set(by_doc) == {i for i, _ in rows}
    for i, text in rows:
        ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, windows.END_ID]
        at = 0
        for p in sorted(by_doc[i], key=lambda p: p.start):
            assert p.start == at and p.length > 0 and p.doc_tokens == len(ids)
            raw = np.array(ids[at : at + p.length], dtype="<u4").tobytes()
            assert p.ids_crc32 == zlib.crc32(raw)
            at += p.length
        assert at == len(ids)
    lost = 0
    for held in by_window.values():
        at = 0
        for p in sorted(held, key=lambda p: p.offset):
            assert p.offset == at
            at += p.length
        assert at <= capacity
        lost += padding(at, capacity)
    return lost


ODD = [
    (1, None),
    (2, ""),
    (3, "\n \t\n"),
    (4, "Ünïcode “text” 日本 😀 é ΑΣ. a b\x1cc　d\x85e don't <|endoftext|> İ"),
    (5, "x" * 100_000),
    (6, "word " * 50_000),
    (7, "Ends here. And here!\nNo end"),
    (8, "é" * 3000 + " ́\ń"),
]


@pytest.mark.parametrize("batch", [2, 10_000])
def test_odd_texts(spark, tokenizer, batch):
    df = spark.createDataFrame([(i, t, "x") for i, t in ODD], "doc_id bigint, text string, length string")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(batch))
    try:
        pieces = windows.pack_windows(df.coalesce(1), PATH, with_ids=True).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    check(ODD, pieces, tokenizer, windows.CAPACITY)
    for p in pieces:
        assert zlib.crc32(np.array(p.ids, dtype="<u4").tobytes()) == p.ids_crc32
    # In order: a document goes on where the next window starts.
    ordered = sorted(pieces, key=lambda p: (p.sequence_id, p.offset))
    assert [(p.doc_id, p.start) for p in ordered] == sorted((p.doc_id, p.start) for p in pieces)


def test_ids_are_the_tokenizers(tokenizer):
    rng = np.random.default_rng(3)
    signs = [*map(chr, range(256)), "'s", "'LL", "ABC", "Ünder", "…", "ŀ", "日", "e\u0301", "<|endoftext|>", " "]
    texts = ["".join(rng.choice(signs, rng.integers(0, 40))) for _ in range(4000)]
    texts += [chr(c) + "a" + chr(c) for c in range(0x250)]
    ids, ends, sentences = windows.WordIds(tokenizer, 2).stream([t.encode() for t in texts])
    start = 0
    for text, end in zip(texts, ends.tolist(), strict=True):
        assert ids[start:end].tolist() == [*tokenizer.encode(text, add_special_tokens=False).ids, 2], text
        start = end
    assert set(ends.tolist()) <= set(sentences.tolist())


def test_repeated_rows_missing_ids_and_no_rows(spark):
    rows = [(None, "one two"), (3, "same"), (3, "same"), (None, None)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    pieces = windows.pack_windows(df, PATH).collect()
    assert sorted((p.doc_id or 0, p.doc_tokens) for p in pieces) == [(0, 1), (0, 3), (3, 2), (3, 2)]
    none = windows.pack_windows(df.where("doc_id = 9"), PATH)
    assert none.collect() == [] and none.columns[:3] == ["doc_id", "start", "length"]


def test_query_packs_all_documents(spark, sf_dir, tokenizer):
    docs = registered.read(spark, sf_dir, "documents")
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    pieces = registered.queries()["op11_window_packing"](spark, sf_dir).collect()
    lost = check(rows, pieces, tokenizer, windows.CAPACITY)
    assert lost < 0.02 * sum(p.length for p in pieces)
    # Cuts inside of documents are few: about one per window.
    assert len(pieces) < len(rows) + 2 * len({p.sequence_id for p in pieces})
