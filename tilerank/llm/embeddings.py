"""Embedding near-duplicates: randomly rotated binary codes propose and bound, and only what
their bounds leave open is computed exactly.

Equal vectors are one class. A class gets the signs of its randomly rotated direction as a
code, and a correction factor that makes the inner product estimated from the code unbiased;
both are stored once. Bits, in bands, bring classes together. Only codes travel to the bands:
how many of two codes' bits agree bounds their angle, and classes that this leaves a partner
fetch their vectors. Of the pairs among these, the estimate's confidence bound rejects most
others; for the rest the cosine is computed in double precision. Pairs are counted where they
meet and not written out.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame, functions as F

from ..sources.workspace import stored
from .arrow import part_pairs, quoted, runs_by_key
from .components import UnionFind, components

CODE_BITS = 256
THRESHOLD = 0.9
MISS = 0.002  # chance that a pair exactly at the threshold meets in no band
DEVIATIONS = 5.0
BLOCK = 2048
SEED = 20_240_601


def rotation(dims: int, bits: int = CODE_BITS, seed: int = SEED) -> np.ndarray:
    """``bits`` x ``dims``: the first columns of a random rotation of ``bits`` dimensions, so
    that vectors are padded with zeros and rotated. Codes are never shorter than vectors."""
    bits = max(bits, -(-dims // 64) * 64)
    gauss = np.random.default_rng(seed + dims).standard_normal((bits, dims))
    basis, upper = np.linalg.qr(gauss)
    return basis * np.sign(np.diag(upper))


def encode(vectors: np.ndarray, turn: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Packed sign codes of unit vectors and their correction factors.

    The code stands for the corner ``x = signs / sqrt(bits)`` of a cube; the factor is the
    inner product of ``x`` and the rotated vector.
    """
    turned = vectors @ turn.T
    signs = turned >= 0
    factor = np.abs(turned).sum(axis=1) / math.sqrt(turn.shape[0])
    return np.packbits(signs, axis=1), factor


def band_plan(n: int, threshold: float, miss: float) -> np.ndarray:
    """Which bits make up each band: about ``log2(n / 128)`` bits a band, so that buckets of
    unrelated vectors stay small, and as many bands as ``miss`` asks for. No two bands share a
    bit, so a pair whose bits agree less often than most does not miss them all at once; the
    code that bands are cut from is as long as that takes."""
    width = min(max(6, round(math.log2(max(n, 2) / 128))), 30)
    agree = 1 - math.acos(threshold) / math.pi
    n_bands = max(1, math.ceil(math.log(miss) / math.log(1 - agree**width)))
    return np.arange(n_bands * width).reshape(n_bands, width)


def band_rotation(dims: int, plan: np.ndarray) -> np.ndarray:
    """The rotation whose signs the bands are cut from."""
    return rotation(dims, max(CODE_BITS, plan.size))


def band_keys(unit: np.ndarray, plan: np.ndarray, turn: np.ndarray) -> np.ndarray:
    """One number per unit vector and band; equal ones are equal bits."""
    weights = 1 << np.arange(plan.shape[1], dtype=np.int64)
    keys = np.empty((len(unit), len(plan)), dtype=np.int64)
    for low in range(0, len(unit), 256):
        signs = unit[low : low + 256] @ turn[: plan.size].T >= 0
        for number, band in enumerate(plan):
            keys[low : low + 256, number] = signs[:, band] @ weights
    return keys


def _pairs_in_block(
    a, b, same: bool, band: int, threshold: float, deviations: float, plan: np.ndarray, turn: np.ndarray
):
    """Links between two blocks of a bucket that meet here for the first time.

    Blocks are (ids, weights, unit vectors, rotated, codes, factors). For a code ``x``
    of ``v``, ``<x, q> / <x, v>`` estimates ``<v, q>`` without bias; its error exceeds
    ``deviations * sqrt((1 - f * f) / f / f / (bits - 1))``, f being ``<x, v>``, as rarely as
    a normal exceeds so many deviations. Pairs whose bound stays below the threshold are
    rejected, the others computed. Yields index arrays of linked pairs, some rows of ``a`` at
    a time.
    """
    ids_a, _, unit_a, turned_a, _, _ = a
    _, _, unit_b, _, codes_b, factors_b = b
    bits = turned_a.shape[1]
    signs = np.unpackbits(codes_b, axis=1, count=bits).astype(np.float32) * 2 - 1
    spread = np.sqrt(np.maximum(1 - factors_b**2, 0)) / factors_b / math.sqrt(bits - 1)
    keys_b, known = np.empty((len(unit_b), band), dtype=np.int64), np.zeros(len(unit_b), dtype=bool)
    for low in range(0, len(ids_a), 256):
        rows = slice(low, low + 256)
        estimate = turned_a[rows].astype(np.float32) @ signs.T / math.sqrt(bits)
        possible = estimate / factors_b + deviations * spread >= threshold
        i, j = np.nonzero(possible)
        i += low
        if same:
            i, j = i[j > i], j[j > i]
        cosine = np.einsum("ij,ij->i", unit_a[i], unit_b[j])
        near = cosine >= threshold
        i, j = i[near], j[near]
        if band and len(i):
            # A pair counts in the first band whose bits agree. Only rows with links need keys.
            rows_a, i_key = np.unique(i, return_inverse=True)
            rows_b = np.unique(j)
            keys_a = band_keys(unit_a[rows_a], plan[:band], turn)
            new_b = rows_b[~known[rows_b]]
            keys_b[new_b] = band_keys(unit_b[new_b], plan[:band], turn)
            known[new_b] = True
            first = np.ones(len(i), dtype=bool)
            for number in range(band):
                first &= keys_a[i_key, number] != keys_b[j, number]
            i, j = i[first], j[first]
        yield i, j


def least_agreement(threshold: float, deviations: float, bits: int) -> float:
    """How many of its bits the codes of a pair at the threshold have in common at least: all
    but ``acos(threshold) / pi`` of them are expected, less ``deviations`` standard ones."""
    agree = 1 - math.acos(threshold) / math.pi
    return bits * agree - deviations * math.sqrt(bits * agree * (1 - agree))


BUCKET = ("band", "bits", "dims")
MEETING = (*BUCKET, "one", "two")


def _placed(rows: DataFrame, block: int, name: str) -> DataFrame:
    """Rows of buckets with the pairs of parts in which they meet. Buckets of more than
    ``block`` rows are split; a row goes to each pair that its own part belongs to."""
    large = stored(
        rows.groupBy(*BUCKET)
        .agg(F.count(F.lit(1)).alias("_n"))
        .where(F.col("_n") > block)
        .select(*BUCKET, F.ceil(F.col("_n") / block).cast("bigint").alias("parts")),
        name,
    )
    return (
        rows.join(large, list(BUCKET), "left")
        .withColumn("parts", F.coalesce("parts", F.lit(1).cast("bigint")))
        .withColumn("pair", F.explode(part_pairs("parts", "node")))
        .select(*BUCKET, "pair.one", "pair.two", "pair.part", *[c for c in rows.columns if c not in BUCKET])
    )


def _met(placed: DataFrame, run, schema: str) -> DataFrame:
    return placed.repartition(*MEETING).sortWithinPartitions(*MEETING).mapInArrow(run, schema)


def _sides(table: pa.Table) -> tuple[pa.Table, pa.Table]:
    """The two parts that meet; the same table twice if it is one."""
    one, two = table.column("one")[0].as_py(), table.column("two")[0].as_py()
    if one == two:
        return table, table
    is_one = pa.compute.equal(table.column("part"), one)
    return table.filter(is_one), table.filter(pa.compute.invert(is_one))


def _signs(table: pa.Table) -> np.ndarray:
    packed = np.frombuffer(b"".join(table.column("code").to_pylist()), dtype=np.uint8)
    return np.unpackbits(packed.reshape(table.num_rows, -1), axis=1).astype(np.float32) * 2 - 1


def _with_partners(threshold: float, deviations: float):
    """The classes of each bucket whose codes agree enough with another one's."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in runs_by_key(batches, MEETING):
            left, right = _sides(table)
            if table.num_rows < 2 or not left.num_rows or not right.num_rows:
                continue
            a = _signs(left)
            b = a if left is right else _signs(right)
            bits = a.shape[1]
            # The sum of products is the bits that agree less those that do not.
            least = 2 * least_agreement(threshold, deviations, bits) - bits
            has_a, has_b = np.zeros(len(a), dtype=bool), np.zeros(len(b), dtype=bool)
            for low in range(0, len(a), 256):
                possible = a[low : low + 256] @ b.T >= least
                if left is right:
                    rows = np.arange(len(possible))
                    possible[rows, low + rows] = False
                has_a[low : low + 256] |= possible.any(axis=1)
                has_b |= possible.any(axis=0)
            sides = [(left, has_a | has_b)] if left is right else [(left, has_a), (right, has_b)]
            for side, has in sides:
                if has.any():
                    found = side.select([*BUCKET, "node"]).filter(pa.array(has)).combine_chunks()
                    yield from found.to_batches()

    return run


def _unit(vectors: np.ndarray) -> np.ndarray:
    """Directions. Scaled first, so that no square leaves the range of doubles."""
    scaled = vectors / np.abs(vectors).max(axis=1, keepdims=True)
    return scaled / np.linalg.norm(scaled, axis=1, keepdims=True)


def _group_links(
    threshold: float,
    deviations: float,
    plan: np.ndarray,
    turns: dict[int, np.ndarray],
    band_turns: dict[int, np.ndarray],
):
    schema = ["node", "links", "below"]

    def block_of(table: pa.Table):
        dims = table.column("dims")[0].as_py()
        unit = _unit(np.frombuffer(b"".join(table.column("vector").to_pylist()), dtype="<f8").reshape(-1, dims))
        codes = np.frombuffer(b"".join(table.column("code").to_pylist()), dtype=np.uint8)
        return (
            table.column("node").to_numpy(),
            table.column("weight").to_numpy(),
            unit,
            unit @ turns[dims].T,
            codes.reshape(len(unit), -1),
            table.column("factor").to_numpy(),
        )

    def bucket(table: pa.Table) -> pa.RecordBatch | None:
        band = table.column("band")[0].as_py()
        left, right = _sides(table)
        if not left.num_rows or not right.num_rows:
            return None
        alone = left is right
        a = block_of(left)
        b = a if alone else block_of(right)
        links_a, links_b = np.zeros(len(a[0]), np.int64), np.zeros(len(b[0]), np.int64)
        sets = UnionFind()
        turn = band_turns[table.column("dims")[0].as_py()]
        for i, j in _pairs_in_block(a, b, alone, band, threshold, deviations, plan, turn):
            np.add.at(links_a, i, b[1][j])
            np.add.at(links_b, j, a[1][i])
            for x, y in zip(a[0][i].tolist(), b[0][j].tolist(), strict=True):
                sets.union(x, y)
        ids = a[0] if alone else np.concatenate([a[0], b[0]])
        links = links_a + links_b if alone else np.concatenate([links_a, links_b])
        linked = links > 0
        if not linked.any():
            return None
        ids, links = ids[linked], links[linked]
        return pa.RecordBatch.from_arrays(
            [
                pa.array(ids, type=pa.int64()),
                pa.array(links, type=pa.int64()),
                pa.array([sets.find(node) for node in ids.tolist()], type=pa.int64()),
            ],
            names=schema,
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted by bucket; one bucket, or pair of its parts, is held at a time."""
        for table in runs_by_key(batches, MEETING):
            if table.num_rows > 1 and (made := bucket(table)) is not None:
                yield made

    return run


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Vectors as bytes with a digest; none where a row cannot be linked with any."""
    for batch in batches:
        lists = batch.column(1)
        dims = np.where(np.asarray(lists.is_null()), 0, np.diff(lists.offsets.to_numpy()))
        starts = lists.offsets.to_numpy()[:-1]
        flat = lists.values.to_numpy(zero_copy_only=False)
        raw: list = [None] * len(dims)
        known = np.asarray(batch.column(0).is_valid())
        for size in np.unique(dims[known & (dims > 0)]).tolist():
            rows = np.flatnonzero(known & (dims == size))
            vectors = flat[starts[rows][:, None] + np.arange(size)].astype("<f8")
            fine = np.isfinite(vectors).all(axis=1) & (vectors != 0).any(axis=1)
            for row, vector in zip(rows[fine].tolist(), vectors[fine], strict=True):
                raw[row] = vector.tobytes()
        digests = [None if v is None else hashlib.blake2b(v, digest_size=16).digest() for v in raw]
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(dims, type=pa.int64()), pa.array(raw, pa.binary()), pa.array(digests, pa.binary())],
            names=["vec_id", "dims", "vector", "digest"],
        )


def _coded(plan: np.ndarray, turns: dict[int, np.ndarray], band_turns: dict[int, np.ndarray]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims, raw = batch.column("dims").to_numpy(), batch.column("vector").to_pylist()
            keys, codes, factors = [None] * len(raw), [None] * len(raw), np.zeros(len(raw))
            for size in np.unique(dims).tolist():
                rows = np.flatnonzero(dims == size)
                unit = _unit(np.frombuffer(b"".join([raw[r] for r in rows.tolist()]), dtype="<f8").reshape(-1, size))
                packed, factors[rows] = encode(unit, turns[size])
                found = band_keys(unit, plan, band_turns[size])
                for at, row in enumerate(rows.tolist()):
                    keys[row], codes[row] = found[at], packed[at].tobytes()
            yield pa.RecordBatch.from_arrays(
                [
                    *[batch.column(name) for name in ("node", "weight", "dims")],
                    pa.array(codes, type=pa.binary()),
                    pa.array(factors),
                    pa.array(keys, type=pa.list_(pa.int64())),
                ],
                names=["node", "weight", "dims", "code", "factor", "keys"],
            )

    return run


def near_duplicates(
    vectors: DataFrame,
    id_col: str = "vec_id",
    vector: str = "embedding",
    threshold: float = THRESHOLD,
    miss: float = MISS,
    block: int = BLOCK,
) -> DataFrame:
    """``vec_id``, ``n_links``, ``component_id`` and ``kept`` for each row of ``vectors``.

    Two rows are linked if the cosine of their vectors, in double precision, is at least
    ``threshold``. ``component_id`` is the smallest vec_id reachable by links, itself
    included; ``kept`` is whether that is the row's own. A vector that is null, empty or
    zero, or that holds a null or non-finite component, links with nothing, and so do vectors
    of different lengths. A row without a vec_id links with nothing either; its component is
    null and it is kept. Repeated rows count as often as they come. Other columns of
    ``vectors`` are ignored.

    No pair below the threshold is ever linked. A pair at the threshold meets in no band with
    the chance ``miss``, a closer one more rarely, whatever the number of rows. A bucket of
    more than ``block`` classes is split, and its blocks meet in pairs, in tasks of their own.
    """
    rows = vectors.select(
        F.col(quoted(id_col)).cast("bigint").alias("vec_id"),
        F.col(quoted(vector)).cast("array<double>").alias("embedding"),
    )
    known = stored(
        rows.mapInArrow(_read, "vec_id bigint, dims bigint, vector binary, digest binary"), "vectors"
    )
    # Nodes number the classes, as two may have the same smallest vec_id if its rows differ.
    classes = stored(
        known.where("digest IS NOT NULL")
        .groupBy("digest")
        .agg(
            F.min("vec_id").alias("class_id"),
            F.count(F.lit(1)).alias("weight"),
            F.first("dims").alias("dims"),
            F.first("vector").alias("vector"),
        )
        .withColumn("node", F.monotonically_increasing_id()),
        "classes",
    )
    # One number and a short list: how many classes there are and which lengths they have.
    n = classes.count()
    lengths = [row[0] for row in classes.select("dims").distinct().collect()]
    turns = {size: rotation(size) for size in lengths}
    plan = band_plan(n, threshold, miss)
    band_turns = {size: band_rotation(size, plan) for size in lengths}

    codes = stored(
        classes.select("node", "weight", "dims", "vector").mapInArrow(
            _coded(plan, turns, band_turns),
            "node bigint, weight bigint, dims bigint, code binary, factor double, keys array<bigint>",
        ),
        "codes",
    )
    in_bands = codes.select(F.posexplode("keys").alias("band", "bits"), "dims", "node", "code")
    partners = stored(
        _met(
            _placed(in_bands, block, "large-buckets"),
            _with_partners(threshold, DEVIATIONS),
            "band int, bits bigint, dims bigint, node bigint",
        ).distinct(),
        "partners",
    )
    fetched = partners.join(codes.select("node", "weight", "code", "factor"), "node").join(
        classes.select("node", "vector"), "node"
    )
    found = stored(
        _met(
            _placed(fetched, block, "large-buckets"),
            _group_links(threshold, DEVIATIONS, plan, turns, band_turns),
            "node bigint, links bigint, below bigint",
        ),
        "links",
    )
    counts = found.groupBy("node").agg(F.sum("links").alias("links"))
    groups = components(found.select(F.col("node").alias("a"), F.col("below").alias("b")), "groups")
    of_node = groups.join(classes.select("node", "class_id"), "node")
    smallest = of_node.groupBy("component").agg(F.min("class_id").alias("component_id"))
    of_class = (
        classes.select("node", "digest", "class_id", "weight")
        .join(counts, "node", "left")
        .join(of_node.join(smallest, "component").select("node", "component_id"), "node", "left")
        .select(
            "digest",
            (F.col("weight") - 1 + F.coalesce("links", F.lit(0).cast("bigint"))).alias("n_links"),
            F.coalesce("component_id", "class_id").alias("component_id"),
        )
    )
    return (
        known.select("vec_id", "digest")
        .join(of_class, "digest", "left")
        .select(
            "vec_id",
            F.coalesce("n_links", F.lit(0).cast("bigint")).alias("n_links"),
            F.coalesce("component_id", "vec_id").alias("component_id"),
        )
        .withColumn("kept", F.coalesce(F.col("component_id") == F.col("vec_id"), F.lit(True)))
    )
