"""URL filters: fixed rules, and a tree of path templates per host for what no rule decides.

Everything here is DataFrame expressions, aggregates and joins.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..sources.workspace import stored
from .arrow import quoted

# Host and path, in the order block or allow.
RULES = (
    ("net/", "block"),
    ("example.net/en/", "allow"),
    ("example.com/de/", "block"),
    ("org/fr/", "allow"),
)
LEAST_SUPPORT = 3
LEAST_SHARE = 0.05
LEAST_LABELLED = 5
DEVIATIONS = 1.96
BANDS = 200
SPLIT_BANDS = 20
PRIOR_WEIGHT = 4.0
PURITY = 0.8

# Published bounds for text worth keeping, in words and in percent of them that
# have a letter.
LEAST_WORDS = 50
LEAST_LETTERED = 80

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
# Digits, with or without an extension.
_NUMBER = r"^[0-9]+(\.[A-Za-z0-9]+)?$"
_HIDDEN = "(?s)<(script|style)[^>]*>.*?</(script|style)>"
_TAG = "<[^>]*>"
_SPACES = r"[\x20\x09-\x0D]+"
_LETTER = "[A-Za-z\u00c0-\u00ff]"
# Host up to the first of / ? #, path up to the first of ? #, after the first "://".
_URL = r"(?s)^.*?://([^/?#]*)([^?#]*)"


def host_of(url: Column) -> Column:
    found = F.coalesce(F.regexp_extract(url, _URL, 1), F.lit(""))
    return F.translate(found, _UPPER, _LOWER)


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, _URL, 2), F.lit(""))


def suspicious(url: Column, html: Column) -> Column:
    """Whether a page speaks against its url, from its own row; null if that says nothing.

    It does if the host has a hyphen, as few hosts that are not made for search engines have,
    or if what the html shows (no tags, scripts or styles) has fewer than ``LEAST_WORDS`` words,
    or letters in fewer than ``LEAST_LETTERED`` percent of them.
    """
    shown = F.regexp_replace(F.regexp_replace(html, _HIDDEN, " "), _TAG, " ")
    words = F.filter(F.split(shown, _SPACES), lambda word: word != "")
    lettered = F.filter(words, lambda word: word.rlike(_LETTER))
    poor = (F.size(words) < LEAST_WORDS) | (F.size(lettered) * 100 < F.size(words) * LEAST_LETTERED)
    return F.when(host_of(url).contains("-"), True).when(html.isNotNull(), poor)


def matching_rule(host: Column, path: Column, rules: Sequence[tuple[str, str]]) -> tuple[Column, Column]:
    """The longest rule that fits, and its verdict; nulls where none does. A rule's host fits
    itself and its subdomains; its path fits what begins with it. Ties go to the first."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    # What comes later decides, so of equally long ones the first comes last.
    for text, decision in sorted(reversed(rules), key=lambda pair: len(pair[0])):
        name, slash, rest = text.partition("/")
        fits = ((host == name) | host.endswith("." + name)) & path.startswith(slash + rest)
        rule = F.when(fits, text).otherwise(rule)
        verdict = F.when(fits, decision).otherwise(verdict)
    return rule, verdict


def _apart(bad: Column, labelled: Column, bad_0: Column, labelled_0: Column, deviations: float) -> Column:
    """Whether the first bad share exceeds the second by more than chance explains."""
    together = (bad + bad_0 + 1) / (labelled + labelled_0 + 2)
    return (bad / labelled - bad_0 / labelled_0) > deviations * F.sqrt(
        together * (1 - together) * (1 / labelled + 1 / labelled_0)
    )


def _merged(literal: DataFrame, deviations: float) -> DataFrame:
    """``_merged``, the common name, for each literal segment that is like another one."""
    node = ["host", "template"]
    in_band = literal.withColumn("_band", F.floor(F.col("_bad") * BANDS / F.col("_labelled")))
    # At most BANDS + 1 rows a node, however many siblings it has.
    bands = in_band.groupBy(*node, "_band").agg(
        F.avg("_bad").alias("_bad"),
        F.avg("_labelled").alias("_labelled"),
        F.sum("_bad").alias("_all_bad"),
        F.sum("_labelled").alias("_all_labelled"),
    )
    by_share = Window.partitionBy(*node).orderBy("_band")
    apart = _apart(
        F.col("_bad"),
        F.col("_labelled"),
        F.lag("_bad").over(by_share),
        F.lag("_labelled").over(by_share),
        deviations,
    )
    in_group = Window.partitionBy(*node, "_group")
    counts = F.struct("_bad", "_labelled")
    grouped = (
        bands.withColumn("_new", F.coalesce(apart, F.lit(True)).cast("int"))
        .withColumn("_group", F.sum("_new").over(by_share))
        .withColumn("_low", F.min_by(counts, "_band").over(in_group))
        .withColumn("_high", F.max_by(counts, "_band").over(in_group))
        .withColumn("_mean", F.sum("_all_bad").over(in_group) / F.sum("_all_labelled").over(in_group))
        .withColumn(
            "_split",
            _apart(
                F.col("_high._bad"),
                F.col("_high._labelled"),
                F.col("_low._bad"),
                F.col("_low._labelled"),
                2 * deviations,
            ),
        )
        .select(*node, "_band", "_group", "_mean", "_split")
    )
    smoothed = (F.col("_bad") + PRIOR_WEIGHT * F.col("_mean")) / (F.col("_labelled") + PRIOR_WEIGHT)
    part = F.when(F.col("_split"), F.floor(smoothed * SPLIT_BANDS)).otherwise(F.lit(-1))
    placed = in_band.join(grouped, [*node, "_band"]).withColumn("_part", part)
    names = (
        placed.groupBy(*node, "_group", "_part")
        .agg(F.count(F.lit(1)).alias("_many"), F.min("_segment").alias("_name"))
        .where(F.col("_many") > 1)
    )
    return placed.join(names, [*node, "_group", "_part"]).select(
        *node, "_segment", F.concat(F.lit("<~"), "_name", F.lit(">")).alias("_merged")
    )


def _variable(segment: Column) -> Column:
    return F.when(segment.rlike(_NUMBER), "<n>").otherwise("<*>")


def _lone(rest: Column, n: Column, least_support: int) -> Column:
    """The template of segments that no other path shares, or that have too few urls."""
    return _joined(F.when(n >= least_support, rest).otherwise(F.transform(rest, _variable)))


def _joined(names: Column) -> Column:
    return F.array_join(F.transform(names, lambda name: F.concat(F.lit("/"), name)), "")


def path_templates(
    paths: DataFrame,
    levels: int | None = None,
    least_support: int = LEAST_SUPPORT,
    least_share: float = LEAST_SHARE,
    least_labelled: int = LEAST_LABELLED,
    deviations: float = DEVIATIONS,
) -> DataFrame:
    """Add ``template`` to distinct (host, path) with ``n``, ``n_labelled`` and ``n_bad``.

    Per host a tree of segments is built, level by level. A segment stays itself if its node
    has at least ``least_support`` urls and either ``least_labelled`` labelled ones, however
    many siblings it has, or a share of ``least_share`` of its parent's; otherwise it is
    variable and becomes ``<n>`` (digits, with or without an extension) or ``<*>``. Of the
    literal branches below a node, those with ``least_labelled`` labelled urls are counted in
    ``BANDS`` bands of bad share; neighbouring bands whose shares differ by at most
    ``deviations`` standard deviations of their mean branches are alike, and the branches of
    alike ones become one, ``<~x>``, x being the first of their names. Where a row of alike
    bands has ends that differ by twice as much, its branches are instead put together by
    ``SPLIT_BANDS`` bands of smoothed share. The
    tree grows while any node has ``least_support`` urls on two paths or more; what lies
    below other nodes needs no counts. Segments that all paths below a node share, which would
    all stay themselves, are passed in one step, so that rounds grow with how often paths
    part and not with their length. Only if ``levels`` are given, what lies below so many
    segments becomes ``<..>``. Counts are pre-aggregated per node, and no host is gathered
    anywhere.
    """
    segments = F.split(F.regexp_replace("path", "^/", ""), "/")
    below = F.lit("")
    if levels is not None:
        below = F.when(F.size(segments) > levels, "/<..>").otherwise("")
        segments = F.slice(segments, 1, levels)
    # What is left of each path below its node.
    rows = paths.withColumns({"_below": below, "_rest": segments, "template": F.lit("")})
    node = ["host", "template"]
    done = []
    while True:
        # The first and the last path below a node share what all of them do.
        pairs = F.zip_with("_first", "_last", lambda one, other: one.eqNullSafe(other))
        differ = F.array_position(pairs, F.lit(False)).cast("int")
        common = F.when(differ > 0, differ - 1).otherwise(F.size("_first"))
        parents = stored(
            rows.groupBy(*node)
            .agg(
                F.sum("n").alias("_parent_n"),
                F.count(F.lit(1)).alias("_paths"),
                F.min("_rest").alias("_first"),
                F.max("_rest").alias("_last"),
            )
            .where((F.col("_parent_n") >= least_support) & (F.col("_paths") > 1))
            .select(*node, "_parent_n", F.slice("_first", F.lit(1), common).alias("_chain")),
            "nodes",
        )
        if parents.isEmpty():
            break
        rows = rows.withColumn("_segment", F.get("_rest", F.lit(0)))
        nodes = rows.groupBy(*node, "_segment").agg(
            F.sum("n").alias("_n"),
            F.sum("n_labelled").alias("_labelled"),
            F.sum("n_bad").alias("_bad"),
        )
        literal = (
            nodes.join(parents.where(F.size("_chain") == 0), node)
            .where(
                (F.col("_n") >= least_support)
                & ((F.col("_labelled") >= least_labelled) | (F.col("_n") >= F.col("_parent_n") * least_share))
            )
            .drop("_parent_n", "_n", "_chain")
        )
        merged = _merged(literal.where(F.col("_labelled") >= least_labelled), deviations)
        branches = literal.join(merged, [*node, "_segment"], "left").select(
            *node, "_segment", F.coalesce("_merged", "_segment").alias("_branch")
        )
        # A node that is no parent has one path, or too few urls for any literal segment.
        found = rows.join(parents, node, "left").join(branches, [*node, "_segment"], "left")
        passed = F.greatest(F.size("_chain"), F.lit(1))
        step = F.when(F.size("_chain") > 0, _joined(F.col("_chain"))).otherwise(
            F.concat(F.lit("/"), F.coalesce("_branch", _variable(F.col("_segment"))))
        )
        # Written, as the next round reads it twice.
        moved = stored(
            found.withColumn("_open", F.col("_parent_n").isNotNull() & (F.size("_rest") > passed))
            .withColumn(
                "template",
                F.when(F.col("_parent_n").isNotNull(), F.concat("template", step)).otherwise(
                    F.concat("template", _lone(F.col("_rest"), F.col("n"), least_support))
                ),
            )
            .withColumn(
                "_rest", F.when(F.col("_open"), F.slice("_rest", passed + 1, F.size("_rest"))).otherwise(F.array())
            )
            .drop("_segment", "_branch", "_parent_n", "_chain"),
            "templates",
        )
        done.append(moved.where(~F.col("_open")).drop("_open"))
        rows = moved.where("_open").drop("_open")
    done.append(rows.withColumn("template", F.concat("template", _lone(F.col("_rest"), F.col("n"), least_support))))
    placed = reduce(DataFrame.unionByName, done)
    return placed.withColumn("template", F.concat("template", "_below")).drop("_rest", "_below")


def judge_urls(
    pages: DataFrame,
    id_col: str = "page_id",
    url: str = "url",
    bad: str | Column | None = None,
    rules: Sequence[tuple[str, str]] = RULES,
    purity: float = PURITY,
    prior_weight: float = PRIOR_WEIGHT,
    **tree,
) -> DataFrame:
    """``page_id``, ``host``, ``path``, ``rule``, ``verdict``, ``template`` and ``bad_share``
    of each row's url.

    A rule decides where one fits. Elsewhere the path's template does: it is blocked if its
    share of bad urls among its labelled ones, smoothed by ``prior_weight`` urls of the mean
    share, reaches ``purity``. Labels are the boolean column ``bad`` (null: none), as
    ``suspicious`` gives, or, without one, the verdicts of the rules. A null url, or one without ``://``, has empty host and
    path, and is allowed unless a rule or template says otherwise. Repeated rows count as
    often as they come; other columns are ignored.
    """
    label = F.lit(None).cast("boolean") if bad is None else F.col(quoted(bad)) if isinstance(bad, str) else bad
    host, path = host_of(F.col(quoted(url))), path_of(F.col(quoted(url)))
    rule, decision = matching_rule(F.col("host"), F.col("path"), rules)
    rows = pages.select(
        F.col(quoted(id_col)).cast("bigint").alias("page_id"),
        host.alias("host"),
        path.alias("path"),
        label.alias("_bad"),
    ).withColumns({"rule": rule, "_rule_verdict": decision})
    label = F.col("_bad") if bad is not None else F.col("_rule_verdict") == "block"
    paths = stored(
        rows.groupBy("host", "path").agg(
            F.count(F.lit(1)).alias("n"),
            F.count(label).alias("n_labelled"),
            F.count(F.when(label, 1)).alias("n_bad"),
        ),
        "paths",
    )
    # One number for the whole table.
    mean = paths.agg((F.sum("n_bad") + 1) / (F.sum("n_labelled") + 2)).first()[0]
    placed = path_templates(paths, **tree)
    templates = placed.groupBy("host", "template").agg(
        F.sum("n_labelled").alias("_labelled"), F.sum("n_bad").alias("_bad")
    )
    prior = prior_weight * (0.5 if mean is None else mean)
    judged = templates.select(
        "host",
        "template",
        ((F.col("_bad") + prior) / (F.col("_labelled") + prior_weight)).alias("bad_share"),
    )
    of_path = placed.select("host", "path", "template").join(judged, ["host", "template"])
    return (
        rows.join(of_path, ["host", "path"])
        .select(
            "page_id",
            "host",
            "path",
            "rule",
            F.coalesce("_rule_verdict", F.when(F.col("bad_share") >= purity, "block").otherwise("allow")).alias(
                "verdict"
            ),
            "template",
            "bad_share",
        )
    )
