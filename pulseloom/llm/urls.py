"""URL filter: prefix rules matched by a sort-merge range join.

A host is keyed by its labels in reverse order, each followed by a dot
(``www.example.com`` -> ``com.example.www.``), so a rule's host and all its subdomains are
the keys in one interval, ``[key, key with its last dot raised by one)``. Intervals of
different rules nest or are disjoint. The rules become breakpoints: at each interval's
start and end, the stack of rules that are active from there on. Urls and breakpoints are
sorted together, and a sweep carries the last breakpoint's stack to each url; the rule's
path is then tested against the url's path within that stack, deepest rule first.

Only DataFrame functions run. Urls are dealt to sort groups by a hash of the row, never by
host, so a host with a third of all rows is spread evenly; each group gets a copy of the
breakpoints. That copy is the only thing that is repeated (groups x breakpoints rows),
and no list of rules is collected or broadcast.

Defined results: a null url, or one without ``://``, has an empty host and path, fits no
rule and gets the default verdict. Rules with a null or empty host fit nothing; a null
path counts as empty (the rule fits every path). Repeated rules count once; of rules with
the same host and path, block wins. Extra columns pass through.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pulseloom.llm.common import shuffle_partitions

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    """What follows the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased."""
    rest = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(rest, UPPER, LOWER)


def path_of(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def host_key(host: Column) -> Column:
    return F.concat(F.array_join(F.reverse(F.split(host, r"\.")), "."), F.lit("."))


def breakpoints(rules: DataFrame) -> DataFrame:
    """(key, stack): from ``key`` on and up to the next key, the rules in ``stack`` are active.

    Starts and ends are points; each point is paired with the hosts that contain it by a join of
    its key's prefixes with the hosts' keys, so the work is rules x host depth."""
    clean = (
        rules.where(F.length("host") > 0)
        .select(F.translate("host", UPPER, LOWER).alias("host"), F.coalesce("path", F.lit("")).alias("path"), "verdict")
        .groupBy("host", "path")
        .agg(F.max(F.struct((F.col("verdict") == "block").alias("strict"), "verdict"))["verdict"].alias("verdict"))
    )
    # Longest first: the deeper host, then the longer path.
    entry = F.struct(
        (-F.length("host")).alias("depth"), (-F.length("path")).alias("reach"), F.col("path"), F.concat("host", "path").alias("rule"), F.col("verdict")
    )
    own = clean.groupBy(host_key(F.col("host")).alias("owner")).agg(F.collect_set(entry).alias("own"))
    start = own.select(F.col("owner").alias("key"), F.col("owner").alias("inside"))
    # At an interval's end, what contains the interval is active again: the parents of its key.
    end = own.select(
        F.concat(F.expr("left(owner, length(owner) - 1)"), F.lit("/")).alias("key"),
        F.regexp_replace("owner", r"[^.]*\.$", "").alias("inside"),
    )
    labels = F.split("inside", r"\.")
    points = start.unionByName(end)
    prefixes = F.transform(F.sequence(F.lit(1), F.size(labels) - 1), lambda i: F.concat(F.array_join(F.slice(labels, 1, i), "."), F.lit(".")))
    within = points.select("key", F.explode_outer(F.when(F.size(labels) > 1, prefixes)).alias("owner"))
    return (
        within.join(own, "owner", "left")
        .groupBy("key")
        .agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list(F.coalesce("own", F.array().cast(own.schema["own"].dataType)))))).alias("stack"))
    )


def filter_urls(df: DataFrame, rules: DataFrame, url: str = "url", default: str = "allow", groups: int | None = None) -> DataFrame:
    """``df`` with ``host``, ``path``, ``rule`` (``host`` + ``path`` of the longest rule that fits, else
    null) and ``verdict`` (the rule's, else ``default``). ``rules``: columns host, path, verdict.

    The longest rule is the one with the longest host and, among those, the longest path."""
    if clash := {"host", "path", "rule", "verdict"} & set(df.columns):
        raise ValueError(f"columns {sorted(clash)} exist")
    groups = groups or 4 * shuffle_partitions(df.sparkSession)
    own = F.struct(*[F.col(f"`{c}`") for c in df.columns])
    salt = F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(groups)).cast("int")
    left = df.select(own.alias("row"), host_of(F.col(f"`{url}`")).alias("host"), path_of(F.col(f"`{url}`")).alias("path"), salt.alias("salt"))
    points = breakpoints(rules)
    stack_type = points.schema["stack"].dataType
    left = left.select("salt", host_key(F.col("host")).alias("key"), F.lit(1).alias("kind"), "row", "host", "path", F.lit(None).cast(stack_type).alias("stack"))
    right = points.select(
        F.explode(F.sequence(F.lit(0), F.lit(groups - 1))).alias("salt"), "key", F.lit(0).alias("kind"),
        F.lit(None).cast(left.schema["row"].dataType).alias("row"), F.lit(None).cast("string").alias("host"), F.lit(None).cast("string").alias("path"), "stack",
    )
    sweep = Window.partitionBy("salt").orderBy("key", "kind").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    swept = left.unionByName(right).select("kind", "row", "host", "path", F.last("stack", ignorenulls=True).over(sweep).alias("active")).where("kind = 1")
    fits = F.filter("active", lambda r: F.startswith(F.col("path"), r["path"]))
    swept = swept.withColumn("hit", F.try_element_at(fits, F.lit(1)))
    return swept.select(*[F.col(f"row.`{c}`").alias(c) for c in df.columns], "host", "path", F.col("hit.rule").alias("rule"), F.coalesce("hit.verdict", F.lit(default)).alias("verdict"))
