"""WARC archives: records written and read back by Spark, and their index merged.

Each record is a gzip member of its own, so that a reader can seek to it. A member is a row of
Spark's own text writer, which makes the files wherever they are kept; archives are closed by
their bytes and read as whole files. Each archive's captures are sorted on their own, as a run.
Runs are merged in passes of bounded fan-in: what a task merges, by a loser tree, is a range of
the URL key with a bounded number of rows.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from ..operators.numbering import number_rows
from ..sources.workspace import scratch_path, stored
from .arrow import quoted, runs_by_key

VERSION = "WARC/1.1"
LINE = "\r\n"
LEAST_SHARED = 1000
FILE_BYTES = 16 << 20
RANGE_ROWS = 100_000
FAN_IN = 64

SCHEMA = (
    "page_id bigint, url string, urlkey string, captured string, record_type string,"
    " payload_bytes bigint, payload_digest string, refers_to bigint, run string, run_offset bigint,"
    " run_length bigint"
)
ORDER = ["urlkey", "captured", "page_id"]


def url_key(url: Column) -> Column:
    """The url with its host's labels in reverse order and lower case, so that hosts of one
    domain sort together: ``http://www.example.org/a`` gives ``org,example,www)/a``."""
    rest = F.regexp_replace(F.coalesce(url, F.lit("")), r"^[^:/?#]*://", "")
    host = F.lower(F.regexp_extract(rest, r"^[^/?#]*", 0))
    path = F.regexp_replace(F.regexp_replace(rest, r"^[^/?#]*", ""), r"#.*$", "")
    return F.concat(F.array_join(F.reverse(F.split(host, r"\.")), ","), F.lit(")"), path)


def decide(
    pages: DataFrame,
    id_col: str = "page_id",
    url: str = "url",
    html: str = "html",
    least_shared: int = LEAST_SHARED,
) -> DataFrame:
    """``page_id``, ``url``, ``html`` (null: empty), ``payload_digest``, ``payload_bytes``,
    ``record_type`` and ``refers_to`` of each row.

    Of rows with equal payloads of at least ``least_shared`` bytes that with the largest
    page_id is the response, and the others revisit it; repeated rows of that page_id are
    responses too. Smaller payloads are always responses. A row without a page_id revisits if
    its payload has a response elsewhere. The largest page_id per digest is pre-aggregated on
    narrow rows; the payloads are shuffled once.
    """
    rows = pages.select(
        F.col(quoted(id_col)).cast("bigint").alias("page_id"),
        F.col(quoted(url)).cast("string").alias("url"),
        F.coalesce(F.col(quoted(html)).cast("string"), F.lit("")).alias("html"),
    ).withColumns(
        {
            "payload_digest": F.sha1(F.col("html").cast("binary")),
            "payload_bytes": F.octet_length("html").cast("bigint"),
        }
    )
    shared = (
        rows.where(F.col("payload_bytes") >= least_shared)
        .groupBy("payload_digest")
        .agg(F.max("page_id").alias("first_id"), F.count(F.lit(1)).alias("copies"))
        .where("copies > 1 AND first_id IS NOT NULL")
        .drop("copies")
    )
    revisits = F.col("first_id").isNotNull() & ~F.col("first_id").eqNullSafe(F.col("page_id"))
    return rows.join(shared, "payload_digest", "left").select(
        "page_id",
        "url",
        "html",
        "payload_digest",
        "payload_bytes",
        F.when(revisits, "revisit").otherwise("response").alias("record_type"),
        F.when(revisits, F.col("first_id")).alias("refers_to"),
    )


def _urn(page_id: Column) -> Column:
    return F.concat(F.lit("<urn:x-page:"), F.coalesce(page_id.cast("string"), F.lit("none")), F.lit(">"))


def _field(name: str, value: Column) -> Column:
    """A header line; nothing where the value is null. Line breaks in a value become spaces."""
    clean = F.regexp_replace(value, r"[\r\n]+", " ")
    return F.coalesce(F.concat(F.lit(f"{name}: "), clean, F.lit(LINE)), F.lit(""))


def records(decided: DataFrame) -> Column:
    """The text of a row's record up to the two line ends that close it.

    Capture times are a fixed date and the page_id in seconds. Revisits carry no payload;
    they name the payload's digest and length, and the response that holds it.
    """
    revisit = F.col("record_type") == "revisit"
    body = F.when(revisit, "").otherwise(F.col("html"))
    seconds = F.lit(1_704_067_200) + F.pmod(F.coalesce("page_id", F.lit(0)), F.lit(1 << 31))
    captured = F.date_format(
        F.to_utc_timestamp(F.timestamp_seconds(seconds), F.current_timezone()),
        "yyyy-MM-dd'T'HH:mm:ss'Z'",
    )
    return F.concat(
        F.lit(VERSION + LINE),
        _field("WARC-Type", F.col("record_type")),
        _field("WARC-Record-ID", _urn(F.col("page_id"))),
        _field("WARC-Target-URI", F.col("url")),
        _field("WARC-Date", captured),
        _field("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("payload_digest"))),
        _field("X-Payload-Length", F.when(revisit, F.col("payload_bytes").cast("string"))),
        _field("WARC-Profile", F.when(revisit, "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")),
        _field("WARC-Refers-To", F.when(revisit, _urn(F.col("refers_to")))),
        _field("Content-Type", F.lit("text/html")),
        _field("Content-Length", F.octet_length(body).cast("string")),
        F.lit(LINE),
        body,
    )


def member(record: bytes) -> bytes:
    """A record as a gzip member whose last byte is zero. That is the top byte of the record's
    length, which takes 16 MB to be anything else; then an empty member follows."""
    made = _gzip(record)
    return made if not made[-1] else made + _gzip(b"")


def _gzip(data: bytes) -> bytes:
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packer.compress(data) + packer.flush()


def _members(file_bytes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        archive, used = 0, 0
        for batch in batches:
            made = [member(record + b"\r\n\r\n") for record in batch.column(1).to_pylist()]
            numbers = []
            for data in made:
                if used and used + len(data) > file_bytes:
                    archive, used = archive + 1, 0
                used += len(data)
                numbers.append(archive)
            task = batch.column(0).to_numpy()
            yield pa.RecordBatch.from_arrays(
                # The zero at the end of a member is what the writer puts after each row.
                [pa.array((task << 32) + np.array(numbers)), pa.array([data[:-1] for data in made], type=pa.binary())],
                names=["archive", "value"],
            )

    return run


def write_archives(decided: DataFrame, path: str, file_bytes: int = FILE_BYTES) -> None:
    """Write one record per row into archives under ``path``, one gzip member per record.

    An archive is closed before it would pass ``file_bytes``, whatever the records' sizes; a
    single larger record is an archive of its own.
    """
    rows = decided.select(
        F.spark_partition_id().cast("bigint").alias("task"), F.encode(records(decided), "UTF-8").alias("record")
    )
    (
        rows.mapInArrow(_members(file_bytes), "archive bigint, value binary")
        .select("archive", F.col("value").cast("string"))
        .write.partitionBy("archive")
        .option("lineSep", "\0")
        .text(path)
    )


def members(raw: bytes) -> Iterator[tuple[int, int, bytes]]:
    """Offset, length and content of the gzip members of an archive; empty ones belong to
    those before them. A file that is not gzipped is one member."""
    if raw[:2] != b"\x1f\x8b":
        yield 0, len(raw), raw
        return
    at, held = 0, None
    while at < len(raw):
        unpack, parts, start = zlib.decompressobj(31), [], at
        while not unpack.eof:
            piece = raw[at : at + 4096]
            if not piece:
                raise ValueError(f"the member at offset {start} has no end")
            parts.append(unpack.decompress(piece))
            at += len(piece)
        at -= len(unpack.unused_data)
        content = b"".join(parts)
        if held is not None and not content:
            held = (held[0], at - held[0], held[2])
            continue
        if held is not None:
            yield held
        held = (start, at - start, content)
    if held is not None:
        yield held


def parse(data: bytes) -> Iterator[tuple[dict[bytes, bytes], bytes, int]]:
    """Header fields (names in lower case), block and offset of each record in an archive."""
    at = 0
    while at < len(data):
        stop = data.index(b"\r\n\r\n", at)
        lines = data[at:stop].split(b"\r\n")
        if not lines[0].startswith(b"WARC/"):
            raise ValueError(f"no record at offset {at}")
        fields = {}
        for line in lines[1:]:
            name, _, value = line.partition(b":")
            fields[name.strip().lower()] = value.strip()
        begin = stop + 4
        end = begin + int(fields[b"content-length"])
        if data[end : end + 4] != b"\r\n\r\n":
            raise ValueError(f"the record at offset {at} does not end where it should")
        yield fields, data[begin:end], at
        at = end + 4


def _page(urn: bytes | None) -> int | None:
    if urn is None:
        return None
    name = urn.strip(b"<>").rpartition(b":")[2]
    return None if name == b"none" else int(name)


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["page_id", "url", "captured", "record_type", "payload_bytes", "payload_digest"]
    names += ["refers_to", "run", "run_offset", "run_length"]
    for batch in batches:
        for path, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            run = "/".join(path.split("/")[-2:])
            out: list[list] = [[] for _ in names]
            for start, length, data in members(content.as_py()):
                for fields, block, offset in parse(data):
                    kind = fields[b"warc-type"].decode()
                    told = fields[b"warc-payload-digest"].removeprefix(b"sha1:").decode()
                    if kind == "revisit":
                        size, digest = int(fields[b"x-payload-length"]), told
                    else:
                        size, digest = len(block), hashlib.sha1(block).hexdigest()
                        if digest != told:
                            raise ValueError(f"the payload at {start + offset} of {path} is not what was written")
                    url = fields.get(b"warc-target-uri")
                    row = (
                        _page(fields[b"warc-record-id"]),
                        None if url is None else url.decode(),
                        fields[b"warc-date"].decode(),
                        kind,
                        size,
                        digest,
                        _page(fields.get(b"warc-refers-to")),
                        run,
                        start,
                        length,
                    )
                    for held, value in zip(out, row, strict=True):
                        held.append(value)
            kinds = [pa.int64(), *[pa.string()] * 3, pa.int64(), pa.string(), pa.int64(), pa.string()]
            kinds += [pa.int64()] * 2
            yield pa.RecordBatch.from_arrays(
                [pa.array(values, type=kind) for values, kind in zip(out, kinds, strict=True)], names=names
            )


def read_archives(spark, path: str) -> DataFrame:
    """The captures in the archives under ``path``, with payload length and digest: of the
    payload itself for responses, as told for revisits. ``run`` is the archive; the record is
    the gzip member of ``run_length`` bytes at ``run_offset``. One archive is read at a time,
    and its captures come sorted."""
    files = spark.read.format("binaryFile").load(path).select("path", "content")
    found = files.mapInArrow(
        _read,
        "page_id bigint, url string, captured string, record_type string, payload_bytes bigint,"
        " payload_digest string, refers_to bigint, run string, run_offset bigint, run_length bigint",
    )
    return found.withColumn("urlkey", url_key(F.col("url"))).sortWithinPartitions("run", *ORDER)


def fetch_record(spark, path: str, run: str, offset: int, length: int) -> tuple[dict[bytes, bytes], bytes]:
    """Header fields and block of one record, by what the index says of it: only its bytes are
    read, from any file system that Spark knows."""
    file = spark._jvm.org.apache.hadoop.fs.Path(f"{path.rstrip('/')}/{run}")
    stream = file.getFileSystem(spark._jsc.hadoopConfiguration()).open(file)
    try:
        stream.seek(offset)
        raw = bytes(spark._jvm.org.apache.commons.io.IOUtils.toByteArray(stream, length))
    finally:
        stream.close()
    ((_, _, data),) = members(raw)
    fields, block, _ = next(parse(data))
    return fields, block


def merge_runs(runs: list[Iterable[tuple]]) -> Iterator[tuple]:
    """k-way merge of sorted runs by a loser tree: each inner node keeps the run that lost
    there, so that the next item costs one comparison per level. Equal items come in the
    order of the runs."""
    sources = [iter(run) for run in runs]
    k = len(sources)
    if not k:
        return
    # (at end, item, run): a run at its end loses against all others.
    heads: list[tuple] = []
    for number, source in enumerate(sources):
        item = next(source, None)
        heads.append((item is None, () if item is None else item, number))
    losers = [-1] * k

    def climb(run: int) -> int:
        """Play ``run`` from its leaf to the root; the winner, or -1 while rivals are missing."""
        node = (run + k) // 2
        while node:
            rival = losers[node]
            if rival < 0:
                losers[node] = run
                return -1
            if heads[rival] < heads[run]:
                losers[node], run = run, rival
            node //= 2
        return run

    winner = 0
    for number in range(k):
        winner = climb(number)
    while not heads[winner][0]:
        yield heads[winner][1]
        item = next(sources[winner], None)
        heads[winner] = (item is None, () if item is None else item, winner)
        winner = climb(winner)


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A range of one or more groups: rows come group after group, in each run after run."""
    for table in runs_by_key(batches, ("_group",)):
        number = table.column("_no").to_numpy()
        # Nulls first, as Spark sorts; the row number stands for the rest of the row.
        keys = [
            (key, captured, page is not None, page or 0, row)
            for row, (key, captured, page) in enumerate(
                zip(*[table.column(c).to_pylist() for c in ORDER], strict=True)
            )
        ]
        starts = [0, *(np.flatnonzero(number[1:] != number[:-1]) + 1).tolist(), len(number)]
        order = [key[-1] for key in merge_runs([keys[a:b] for a, b in zip(starts, starts[1:], strict=False)])]
        yield from table.take(pa.array(order, type=pa.int64())).combine_chunks().to_batches()


def merged_index(captures: DataFrame, range_rows: int = RANGE_ROWS, fan_in: int = FAN_IN) -> DataFrame:
    """All captures in the order of ``urlkey``, ``captured``, ``page_id``: the partitions of
    the result follow each other, and each is ordered.

    Each archive is a sorted run. A pass merges ``fan_in`` runs at a time to one, until one is
    left; it deals a group of runs to tasks by sampled splitters, as many as ``range_rows``
    rows a task ask for. What a task holds is one such range, however large the table. A range
    is bounded by rows, not by urls: the captures of one url, and rows that are equal but for
    their place, spread over several if they are many. Only index rows are moved.
    """
    columns = [part.split()[0] for part in SCHEMA.split(", ")]
    runs = stored(number_rows(captures.select("run").distinct(), ["run"], "_no"), "runs")
    left, n = runs.count(), captures.count()
    rows = captures.select(*columns).join(runs, "run").withColumn("_no", F.col("_no") - 1)
    n_ranges = max(1, -(-n // range_rows))
    while True:
        grouped = rows.withColumn("_group", F.floor(F.col("_no") / fan_in)).select(*columns, "_no", "_group")
        ranged = grouped.repartitionByRange(n_ranges, "_group", *ORDER, "run", "run_offset")
        merged = ranged.sortWithinPartitions("_group", "_no", *ORDER).mapInArrow(
            _merge, f"{SCHEMA}, _no bigint, _group bigint"
        )
        if left <= fan_in:
            return merged.select(*columns)
        left = -(-left // fan_in)
        rows = stored(merged.drop("_no").withColumnRenamed("_group", "_no"), "merged")


def archive_and_index(pages: DataFrame, **columns) -> DataFrame:
    """Write ``pages`` as archives into the shared folder, read them back and merge their
    index. One row per page: the fields of SCHEMA, in the order of the history."""
    spark = pages.sparkSession
    path = scratch_path(spark, "archives")
    write_archives(decide(pages, **columns), path)
    return merged_index(stored(read_archives(spark, path), "captures"))
