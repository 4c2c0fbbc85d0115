"""MinHash near-duplicates: SuperMinHash signatures, banding, exact verification, groups.

Texts with the same set of shingles are one class, known by its smallest doc_id. Classes that
share a band of their signatures are candidates. A bucket of a band is not expanded into its
pairs: each member is compared with the bucket's first class, and only members that are not
found in that class's component meet the bucket's other members, within a task. Groups too
large for a task choose further pivots first, which settle whole sub-groups at once.
"""

from __future__ import annotations

import hashlib
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..sources.workspace import stored
from .arrow import filtered, map_texts, part_pairs, quoted, runs_by_key
from .components import UnionFind, components
from .words import mix, shingles

SLOTS = 256
PERCENT = 85
MISS = 1e-5
PART_SHINGLES = 1_000_000
PIVOTS = 8

_GOLDEN = 0x9E3779B97F4A7C15
_STEP_BITS = 24
_UNSET = np.uint32(0xFFFFFFFF)
_SLICE_SHINGLES = 1 << 18


def signatures(sets: list[np.ndarray]) -> np.ndarray:
    """SuperMinHash: one row of SLOTS values per non-empty set.

    Each element visits all slots in an order of its own (an affine permutation of the slots)
    and leaves, at its j-th visit, a value between j and j + 1; a slot keeps the smallest.
    All values of an element differ in rank, which is what lowers the variance against
    independent hashes. Once each slot of a set holds a value of rank j, visits after the
    j-th cannot change it any more, and the set is done: large sets need one or two visits.
    """
    sizes = np.array([len(s) for s in sets], dtype=np.int64)
    rows = np.full((len(sets), SLOTS), _UNSET, dtype=np.uint32)
    flat = rows.reshape(-1)
    element = np.concatenate(sets) if len(sets) else np.empty(0, dtype=np.uint64)
    owner = np.repeat(np.arange(len(sets)), sizes)
    first = (element & np.uint64(SLOTS - 1)).astype(np.int64)
    stride = ((element >> np.uint64(8)) & np.uint64(SLOTS - 1)).astype(np.int64) | 1
    open_sets = np.arange(len(sets))
    for step in range(SLOTS):
        if not len(element):
            break
        draw = mix(element + np.uint64((step + 1) * _GOLDEN % 2**64)) >> np.uint64(64 - _STEP_BITS)
        value = draw.astype(np.uint32) | np.uint32(step << _STEP_BITS)
        slot = (first + stride * step) & (SLOTS - 1)
        np.minimum.at(flat, owner * SLOTS + slot, value)
        filled = (rows[open_sets] >> np.uint32(_STEP_BITS)).max(axis=1) <= step
        filled &= rows[open_sets].max(axis=1) != _UNSET
        if filled.any():
            still = np.ones(len(sets), dtype=bool)
            still[open_sets[filled]] = False
            open_sets = open_sets[~filled]
            stay = still[owner]
            element, owner, first, stride = element[stay], owner[stay], first[stay], stride[stay]
    return rows


def band_width(percent: int, miss: float = MISS) -> int:
    """The most slots a band may have for a pair just similar enough to meet in none of the
    bands with a chance of ``miss`` at most: 7 at 85 percent, 6 at 80."""
    alike = percent / 100
    return max(r for r in range(1, 33) if r == 1 or (1 - alike**r) ** (SLOTS // r) <= miss)


def band_keys(rows: np.ndarray, width: int) -> np.ndarray:
    """One 64-bit key per set and band; equal slots of a band give equal keys."""
    keys = np.empty((len(rows), SLOTS // width), dtype=np.uint64)
    for band in range(keys.shape[1]):
        key = np.full(len(rows), band + 1, dtype=np.uint64)
        for slot in range(band * width, (band + 1) * width):
            key = mix(key * np.uint64(_GOLDEN) + rows[:, slot].astype(np.uint64))
        keys[:, band] = key
    return keys.view(np.int64)


def _sketch(texts: list[bytes], width: int):
    sizes, digests, keys = [], [], []
    part: list[np.ndarray] = []
    empty = np.empty(0, dtype=np.int64)
    places: list[int] = []
    held = 0

    def flush() -> None:
        if not part:
            return
        for place, row in zip(places, band_keys(signatures(part), width), strict=True):
            keys[place] = row
        part.clear()
        places.clear()

    for data in texts:
        found = shingles(data)
        sizes.append(len(found))
        digests.append(hashlib.blake2b(found.tobytes(), digest_size=16).digest() if len(found) else None)
        keys.append(empty)
        if len(found):
            part.append(found)
            places.append(len(keys) - 1)
            held += len(found)
            if held >= _SLICE_SHINGLES:
                flush()
                held = 0
    flush()
    return [sizes, digests, keys]


def sketch(
    docs: DataFrame, id_col: str = "doc_id", text: str = "text", percent: int = PERCENT
) -> DataFrame:
    """``doc_id``, ``text_key``, ``n_shingles``, ``digest`` of the shingle set and the ``bands``
    keys. The text_key tells rows of one doc_id apart that have different texts."""
    width = band_width(percent)
    return map_texts(
        _keyed(docs, id_col, text),
        "_text",
        [("n_shingles", "bigint"), ("digest", "binary"), ("bands", "array<bigint>")],
        lambda texts: _sketch(texts, width),
        ["doc_id", "text_key"],
    )


def _keyed(docs: DataFrame, id_col: str, text: str) -> DataFrame:
    body = F.col(quoted(text)).cast("string")
    return docs.select(
        F.col(quoted(id_col)).cast("bigint").alias("doc_id"),
        F.xxhash64(body).alias("text_key"),
        body.alias("_text"),
    )


def _sets(texts: list[bytes]):
    return [[shingles(data).tobytes() for data in texts]]


def _overlaps(batches):
    for batch in batches:
        both = [
            len(
                np.intersect1d(
                    np.frombuffer(one, dtype=np.uint64), np.frombuffer(other, dtype=np.uint64), assume_unique=True
                )
            )
            for one, other in zip(batch.column(4).to_pylist(), batch.column(5).to_pylist(), strict=True)
        ]
        yield pa.RecordBatch.from_arrays(
            [*[batch.column(i) for i in range(4)], pa.array(both, type=pa.int64())],
            names=["a", "b", "na", "nb", "both"],
        )


def _met_in_groups(percent: int):
    """Links between members of a group in different components, at least one of them apart.

    The group's shingles are indexed once. A set can only overlap enough with one that holds
    any of its rarest shingles, as many as it may lack and one more; sets for which these lead
    nowhere are passed over, the others' overlaps are counted from the whole index. Of the
    links found, as many are put out as connect what is linked.
    """

    def links(table: pa.Table) -> tuple[list[int], list[int]]:
        ids, component = table.column("node").to_numpy(), table.column("component").to_numpy()
        apart = table.column("apart").to_numpy(zero_copy_only=False)
        part = table.column("part").to_numpy()
        across = table.column("one")[0].as_py() != table.column("two")[0].as_py()
        sets = [np.frombuffer(raw, dtype=np.uint64) for raw in table.column("shingles").to_pylist()]
        sizes = np.array([len(s) for s in sets])
        if not apart.any():
            return [], []
        joined = np.concatenate(sets)
        order = np.argsort(joined, kind="stable")
        owner = np.repeat(np.arange(len(sets)), sizes)[order]
        _, first, count = np.unique(joined[order], return_index=True, return_counts=True)
        number = np.empty(len(joined), dtype=np.int64)
        number[order] = np.repeat(np.arange(len(first)), count)
        ends = np.cumsum(sizes)

        def holders(shingles: np.ndarray) -> np.ndarray:
            n = count[shingles]
            step = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
            return owner[np.repeat(first[shingles], n) + step]

        found = UnionFind()
        for row in np.flatnonzero(apart).tolist():
            own = number[ends[row] - sizes[row] : ends[row]]
            may_lack = len(own) - -(-percent * len(own) // 100)
            other = component != component[row]
            if across:
                other &= part != part[row]
            rare = own[np.argsort(count[own], kind="stable")[: may_lack + 1]]
            reached = np.zeros(len(sets), dtype=bool)
            reached[holders(rare)] = True
            if not (reached & other).any():
                continue
            both = np.bincount(holders(own), minlength=len(sets))
            near = other & (100 * both >= percent * (sizes + sizes[row] - both))
            for met in np.flatnonzero(near).tolist():
                found.union(int(ids[row]), int(ids[met]))
        nodes = [node for node, up in found.parent.items() if node != up]
        return nodes, [found.find(node) for node in nodes]

    def run(batches):
        for table in runs_by_key(batches, ("first_id", "one", "two")):
            a, b = links(table)
            if a:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(a, type=pa.int64()), pa.array(b, type=pa.int64())], names=["a", "b"]
                )

    return run


def overlaps(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """``a``, ``b``, the sizes ``na`` and ``nb`` of their full shingle sets and how many
    shingles ``both`` have, for the pairs (a, b)."""
    of_a = sets.select(F.col("node").alias("a"), F.col("shingles").alias("sa"))
    of_b = sets.select(F.col("node").alias("b"), F.col("shingles").alias("sb"))
    size = lambda name: (F.length(name) / 8).cast("bigint")
    rows = pairs.join(of_a, "a").join(of_b, "b")
    return rows.select("a", "b", size("sa").alias("na"), size("sb").alias("nb"), "sa", "sb").mapInArrow(
        _overlaps, "a bigint, b bigint, na bigint, nb bigint, both bigint"
    )


def _near(percent: int):
    """Whether an overlap is enough."""
    union = F.col("na") + F.col("nb") - F.col("both")
    return F.col("both") * 100 >= union * percent


def _opened(members: DataFrame) -> DataFrame:
    """The members of groups in which more than one component is left."""
    groups = members.groupBy("first_id").agg(
        F.min("component").alias("_low"), F.max("component").alias("_high"), F.sum("n_shingles").alias("held")
    )
    return members.join(groups.where("_low < _high").select("first_id", "held"), "first_id")


def settle_by_pivots(
    members: DataFrame, sets: DataFrame, percent: int, part_shingles: int
) -> tuple[DataFrame, list[DataFrame]]:
    """What is left of ``members`` (first_id, node, n_shingles, component) when pivots have
    settled what they can of the groups above ``part_shingles``; and links found on the way.

    In each round a group takes up to ``PIVOTS`` members of different components as pivots,
    and compares all of its members with them. One minus the similarity is a distance, so a
    member x of a pivot's component cannot be near any y of another one if y is further from
    the pivot than x by more than near ones may be apart: then all of x's pairs are known and x
    goes. A sub-group of near copies goes at once, so a group costs its size times the number
    of its sub-groups. Rounds go on while a group is too large for a task and at least a tenth
    of it goes; where less does, its members are no sub-groups, but apart from each other.
    """
    links: list[DataFrame] = []
    done: list[DataFrame] = []
    state = stored(_opened(members), "members")
    while True:
        small = state.where(F.col("held") <= part_shingles)
        done.append(small.drop("held"))
        state = state.where(F.col("held") > part_shingles)
        if state.isEmpty():
            return reduce(DataFrame.unionByName, done), links
        pivots = stored(
            state.groupBy("first_id", F.pmod(F.xxhash64("component"), F.lit(PIVOTS)).alias("_salt"))
            .agg(F.min("node").alias("a"))
            .drop("_salt"),
            "pivots",
        )
        met = state.join(pivots, "first_id").select("first_id", "a", F.col("node").alias("b"))
        measured = stored(overlaps(met.where("a <> b").select("a", "b").distinct(), sets), "overlaps")
        of_node = state.select("node", "component").distinct()
        found = stored(
            measured.where(_near(percent))
            .join(of_node.toDF("a", "ca"), "a")
            .join(of_node.toDF("b", "cb"), "b")
            .where("ca <> cb")
            .select("a", "b", "ca", "cb"),
            "links",
        )
        links.append(found.select("a", "b"))
        merged = components(found.select(F.col("ca").alias("a"), F.col("cb").alias("b")), "merged")
        state = stored(
            state.join(merged.toDF("component", "_into"), "component", "left")
            .withColumn("component", F.coalesce("_into", "component"))
            .drop("_into"),
            "members",
        )
        label = state.select("first_id", "node", "component")
        seen = (
            met.join(measured, ["a", "b"], "left")
            .withColumn(
                "far", F.when(F.col("a") == F.col("b"), 0.0).otherwise(1 - F.col("both") / (F.col("na") + F.col("nb") - F.col("both")))
            )
            .join(label.toDF("first_id", "a", "ca"), ["first_id", "a"])
            .join(label.toDF("first_id", "b", "cb"), ["first_id", "b"])
            .select("first_id", "a", "b", "far", (F.col("ca") == F.col("cb")).alias("same"))
        )
        seen = stored(seen, "distances")
        reach = seen.where("NOT same").groupBy("first_id", "a").agg(F.min("far").alias("reach"))
        apart = 1 - percent / 100 + 1e-9
        gone = (
            seen.where("same")
            .join(reach, ["first_id", "a"], "left")
            .where(F.col("reach").isNull() | (F.col("far") + apart < F.col("reach")))
            .select("first_id", F.col("b").alias("node"))
            .distinct()
        )
        before = state.select("first_id", "held").distinct().withColumnRenamed("held", "_before")
        left = state.drop("held").join(gone, ["first_id", "node"], "left_anti")
        state = stored(_opened(left).join(before, "first_id"), "members")
        stuck = F.col("held") > F.col("_before") * 0.9
        done.append(state.where(stuck).drop("held", "_before"))
        state = state.where(~stuck).drop("_before")


def near_duplicates(
    docs: DataFrame,
    id_col: str = "doc_id",
    text: str = "text",
    percent: int = PERCENT,
    part_shingles: int = PART_SHINGLES,
) -> DataFrame:
    """``doc_id``, ``n_shingles``, ``component_id`` and ``kept`` for each row of ``docs``.

    Documents are linked if ``100 * intersection >= percent * union`` of their sets of 5-word
    shingles (A-Z lower-cased; fewer words: one shingle). ``component_id`` is the smallest
    doc_id reachable by links, itself included; ``kept`` is whether that is the row's own. A
    null or empty text, or one without words, has no shingle and is its own component. Rows
    without a doc_id are linked with nothing: null component, kept. Repeated rows of one
    doc_id and text stay together; under one doc_id there should be one text, and rows that
    differ are judged by their own. Other columns of ``docs`` are ignored.

    A pair just similar enough shares no band with a chance of at most 1e-5, more similar
    ones more rarely (see ``band_width``). What bands propose is confirmed on full sets. A
    group of more than ``part_shingles`` shingles is thinned by pivots first; what is left of
    it is split if it is still as large, and its parts meet in pairs.
    """
    return _judged(docs, id_col, text, percent, part_shingles).drop("text_key")


def _judged(docs: DataFrame, id_col: str, text: str, percent: int, part_shingles: int) -> DataFrame:
    """near_duplicates with the text_key of each row."""
    known = stored(sketch(docs, id_col, text, percent), "sketches")
    named = known.where("n_shingles > 0 AND doc_id IS NOT NULL")
    # The smallest member stands for its class. Nodes number the classes, as two may have the
    # same smallest doc_id if its rows differ.
    classes = stored(
        named.groupBy("digest")
        .agg(F.min(F.struct("doc_id", "text_key")).alias("_first"))
        .select(
            "digest",
            F.col("_first.doc_id").alias("class_id"),
            F.col("_first.text_key").alias("text_key"),
            F.monotonically_increasing_id().alias("node"),
        ),
        "classes",
    )
    leaders = named.join(
        classes.withColumnRenamed("class_id", "doc_id"), ["digest", "doc_id", "text_key"]
    ).select("node", "n_shingles", F.explode("bands").alias("band"))
    firsts = leaders.groupBy("band").agg(F.min("node").alias("first_id"), F.max("node").alias("last_id"))
    shared = stored(
        leaders.join(firsts.where("first_id < last_id").drop("last_id"), "band").distinct(), "buckets"
    )

    def alike(low: str, high: str):
        """Sets can only overlap enough if their sizes are close."""
        return F.least(low, high) * 100 >= F.greatest(low, high) * percent

    sizes = shared.select("node", "n_shingles").distinct()
    star = (
        shared.where("node > first_id")
        .select(F.col("first_id").alias("a"), F.col("node").alias("b"), "n_shingles")
        .distinct()
        .join(sizes.select(F.col("node").alias("a"), F.col("n_shingles").alias("na")), "a")
        .where(alike("na", "n_shingles"))
        .select("a", "b")
    )
    # Full sets only of classes that share a bucket with another one.
    candidates = (
        shared.select("node")
        .distinct()
        .join(classes, "node")
        .select(F.col("class_id").alias("doc_id"), "text_key", "node")
    )
    sets = stored(
        map_texts(
            _keyed(docs, id_col, text).join(candidates, ["doc_id", "text_key"]),
            "_text",
            [("shingles", "binary")],
            _sets,
            ["node"],
        ).distinct(),
        "sets",
    )
    links = stored(overlaps(star, sets).where(_near(percent)).select("a", "b"), "links")
    joined = components(links, "stars")

    # Members of a bucket outside its first class's component still have to meet the others.
    # Buckets with the same first class are one group.
    label = joined.select("node", "component")
    labelled = stored(
        shared.where("node > first_id")
        .select("first_id", "node", "n_shingles")
        .distinct()
        .join(label, "node", "left")
        .withColumn("component", F.coalesce("component", "node")),
        "labelled",
    )
    left, found = settle_by_pivots(labelled, sets, percent, part_shingles)
    left = stored(left, "left")
    groups = left.groupBy("first_id").agg(
        F.ceil(F.sum("n_shingles") / part_shingles).cast("bigint").alias("parts")
    )
    of_first = label.toDF("first_id", "_fc")
    members = (
        left.join(groups, "first_id")
        .join(of_first, "first_id", "left")
        .withColumn("apart", F.col("component") != F.coalesce("_fc", "first_id"))
        .withColumn("pair", F.explode(part_pairs("parts", "node")))
        .select("first_id", "pair.one", "pair.two", "pair.part", "node", "component", "apart")
        .join(sets, "node")
    )
    key = ["first_id", "one", "two"]
    more = stored(
        members.repartition(*key)
        .sortWithinPartitions(*key)
        .mapInArrow(_met_in_groups(percent), "a bigint, b bigint"),
        "links",
    )
    new = reduce(DataFrame.unionByName, [more, *found])
    whole = joined if new.isEmpty() else components(links.unionByName(new), "groups")

    # A component is known by the smallest doc_id of its classes.
    of_node = whole.join(classes.select("node", "class_id"), "node")
    smallest = of_node.groupBy("component").agg(F.min("class_id").alias("component_id"))
    of_class = of_node.join(smallest, "component").select("node", "component_id")
    component = F.coalesce("component_id", "class_id", "doc_id")
    return (
        known.select("doc_id", "text_key", "n_shingles", "digest")
        .join(classes.select("digest", "class_id", "node"), "digest", "left")
        .join(of_class, "node", "left")
        .select(
            "doc_id",
            "text_key",
            "n_shingles",
            F.when(F.col("doc_id").isNotNull(), component).alias("component_id"),
        )
        .withColumn("kept", F.coalesce(F.col("component_id") == F.col("doc_id"), F.lit(True)))
    )


def labelled(
    docs: DataFrame, id_col: str = "doc_id", text: str = "text", percent: int = PERCENT
) -> DataFrame:
    """``doc_id``, ``text_key`` (xxhash64 of the text) and ``component_id``, once for each text
    of a doc_id: to give rows their group without reading the texts again."""
    judged = _judged(docs, id_col, text, percent, PART_SHINGLES)
    return judged.where("doc_id IS NOT NULL").select("doc_id", "text_key", "component_id").distinct()


def drop_near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text: str = "text", percent: int = PERCENT
) -> DataFrame:
    """The rows of ``docs`` that ``near_duplicates`` keeps, with the columns of ``docs``.

    Only doc_ids that go and the keys of their texts are joined to the rows; rows without a
    doc_id stay, and so does a row whose own text is kept, whatever else its doc_id names.
    """
    gone = (
        _judged(docs, id_col, text, percent, PART_SHINGLES)
        .where(~F.col("kept"))
        .select(F.col("doc_id").alias("_gone"), F.col("text_key").alias("_gone_key"))
        .distinct()
    )

    def judge(rows: DataFrame, body: str, names: list[str]) -> DataFrame:
        own = rows[names[docs.columns.index(id_col)]].cast("bigint")
        same = (own == gone["_gone"]) & (F.xxhash64(rows[body].cast("string")) == gone["_gone_key"])
        return rows.join(gone, same, "left_anti")

    return filtered(docs, text, judge)
