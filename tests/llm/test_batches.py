"""Every operator over odd rows: what comes out does not depend on how rows are cut into batches.

And the whole pipeline over odd tables.
"""

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tilerank.llm import bpe, chat, digests, embeddings, minhash, packing, phrases, quality
from tilerank.llm import secret_scan, spelling, toxicity, warc, windows
from tilerank.llm.arrow import map_texts

SETTING = "spark.sql.execution.arrow.maxRecordsPerBatch"
LONG = "long text of many words, again. " * 9_000


def odd_documents(spark):
    texts = [None, "", " \n\t", "one", "a b c d e f g", LONG, "password = hunter2-hunter2", "Ünï cödé. 日本!\nx", "y" * 50_000]
    rows = [(n, text, "en" if n % 2 else None, f"s{n % 3}") for n, text in enumerate(texts * 2)]
    rows += [(None, "no id here", "fr", None), rows[5], rows[4], (3, "another text under one id", "fr", "s1")]
    # Columns named like results and statistics.
    return spark.createDataFrame(
        [(*row, 1, 2.0, "z") for row in rows],
        "doc_id bigint, text string, lang string, source string, n_words int, score double, component_id string",
    ).coalesce(1)


def odd_pages(spark):
    html = [None, "", "x", "<p>" + "word " * 400, "é" * 700]
    rows = [(n, f"http://h{n % 3}.test/a/{n}", html[n % 5]) for n in range(17)] + [(None, None, html[3]), (2, "u", html[2])]
    return spark.createDataFrame(rows, "page_id bigint, url string, html string").coalesce(1)


def odd_turns(spark):
    rows = [(n // 4, n % 4, ["user", "assistant"][n % 2], ["hi", None, "", "</s>[INST]\\"][n % 4]) for n in range(22)]
    rows += [(None, 1, None, "lost"), rows[3], (9, 0, "user", LONG)]
    return spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string").coalesce(1)


def odd_vectors(spark):
    rng = np.random.default_rng(4)
    rows = [(n, (np.eye(8)[n % 3] + 0.1 * rng.standard_normal(8)).tolist()) for n in range(20)]
    rows += [(30, None), (31, []), (32, [0.0] * 8), (33, [None] * 8), (None, rows[0][1]), rows[1], (34, [1.0, 2.0])]
    return spark.createDataFrame(rows, "vec_id bigint, embedding array<double>").coalesce(1)


OPERATORS = {
    "packing": lambda s: packing.pack(odd_documents(s), with_text=True),
    "bpe": lambda s: bpe.encode_documents(
        odd_documents(s), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), with_ids=False
    ),
    "chat": lambda s: digests.conversation_digests(chat.format_conversations(odd_turns(s))),
    "secrets": lambda s: secret_scan.scan(odd_documents(s)),
    "quality": lambda s: quality.judge(odd_documents(s), quality.DecisionList(), keep=["doc_id"]),
    "toxicity": lambda s: toxicity.score_documents(
        odd_documents(s), toxicity.ToxicityModel(np.full(toxicity.BUCKETS, 0.01), -3.0), keep=["doc_id"]
    ),
    "minhash": lambda s: minhash.near_duplicates(odd_documents(s)),
    "embeddings": lambda s: embeddings.near_duplicates(odd_vectors(s)),
    "warc": lambda s: warc.archive_and_index(odd_pages(s)).drop("run", "run_offset", "run_length"),
    "windows": lambda s: windows.pack_windows(odd_documents(s), public_tokenizers.path("word_bpe_49k.json")),
    "phrases": lambda s: phrases.collocations(odd_documents(s), least=2),
    "spelling": lambda s: spelling.spelling_variants(odd_documents(s), least_count=1),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_batches_of_three_rows_change_nothing(spark, name):
    made = []
    for size in ("10000", "3"):
        spark.conf.set(SETTING, size)
        try:
            made.append(sorted(str(tuple(row)) for row in OPERATORS[name](spark).collect()))
        finally:
            spark.conf.unset(SETTING)
    assert made[0] and made[0] == made[1]


def write_tables(docs, labels, folder):
    docs.write.parquet(f"{folder}/documents.parquet")
    labels.write.parquet(f"{folder}/labels.parquet")


def test_pipeline_over_odd_rows(spark, folder):
    docs = odd_documents(spark)
    labels = spark.createDataFrame([(4, 0, 1), (5, 1, 0), (None, 1, 1), (5, None, None)] * 2, "doc_id bigint, quality int, toxic int")
    write_tables(docs, labels, folder)
    pieces = corpus_pipeline.run(spark, folder).collect()
    assert {p.doc_id for p in pieces} <= {r.doc_id for r in docs.collect()}
    text = "".join(p.piece_text for p in pieces)
    assert "hunter2-hunter2" not in text
    # What repeats itself goes by the fixed rules, and so do texts of fewer than ten words.
    assert all(p.doc_id not in (0, 1, 2, 3, 5, 8) for p in pieces)


def test_pipeline_over_no_rows(spark, folder):
    docs = odd_documents(spark).where("doc_id = -1")
    write_tables(docs, spark.createDataFrame([], "doc_id bigint, quality int, toxic int"), folder)
    assert corpus_pipeline.run(spark, folder).collect() == []


def test_pipeline_keeps_different_texts_of_one_id(spark, folder):
    def text(name):
        return " ".join(f"{name}{n}" for n in range(40))

    rows = [(1, text("a")), (1, text("b")), (2, text("a")), (3, text("c")), (3, text("c"))]
    docs = spark.createDataFrame([(*r, "en", f"s{n}", n) for n, r in enumerate(rows)], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    write_tables(docs, spark.createDataFrame([], "doc_id bigint, quality int, toxic int"), folder)
    kept = sorted((p.doc_id, p.piece_text[0]) for p in corpus_pipeline.run(spark, folder).collect())
    assert kept == [(1, "a"), (1, "b"), (3, "c"), (3, "c")]


def test_a_function_gets_a_bounded_part_of_a_batch(spark):
    """Whatever the number of rows that Arrow batches have."""
    rows = spark.range(2000).coalesce(1)
    long = rows.select("id", F.expr("if(id % 100 = 7, null, repeat(char(97 + id % 26), 10000))").alias("text"))
    seen = map_texts(
        long, "text", [("held", "bigint")], lambda texts: [[sum(map(len, texts))] * len(texts)], ["id", "text"]
    ).withColumn("right", F.col("text").eqNullSafe(F.expr("if(id % 100 = 7, null, repeat(char(97 + id % 26), 10000))")))
    got = seen.agg(F.count("id"), F.max("held"), F.bool_and("right")).first()
    assert got[0] == 2000 and got[1] <= (4 << 20) + 10_000 and got[2]


def test_packing_holds_the_texts_of_a_task_once():
    texts = [chr(97 + n % 26) * (1000 + n % 2000) for n in range(10_000)]
    whole = pa.RecordBatch.from_pydict(
        {
            "doc_id": list(range(10_000)),
            "length": [len(text) for text in texts],
            "source": [None] * 10_000,
            "cluster": [None] * 10_000,
            "text": texts,
            "task": [0] * 10_000,
        },
        schema=pa.schema(
            [("doc_id", "int64"), ("length", "int64"), ("source", "string"), ("cluster", "string"), ("text", "string"), ("task", "int64")]
        ),
    )
    names = ["bin_id", "bin_offset", "doc_id", "piece", "piece_start", "piece_length", "piece_text"]
    own, pool = pa.default_memory_pool(), pa.proxy_memory_pool(pa.default_memory_pool())
    pa.set_memory_pool(pool)
    try:
        found = {}
        for batch in packing.pack_task(iter([whole]), names, 8192):
            for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("piece_text").to_pylist()):
                found[doc] = text
            del batch
    finally:
        pa.set_memory_pool(own)
    assert [found[n] for n in range(10_000)] == texts
    # 20 MB of text, of which no second copy is made.
    assert pool.max_memory() < 8e6
