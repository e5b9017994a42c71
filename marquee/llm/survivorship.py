"""Best representative of each duplicate group, by skyline selection.

Every record has a completeness flag per field, a recency and a trust value. Per field (or over the whole record) the
Pareto-undominated records across (completeness, recency, trust) form layer 1, those undominated once it is removed
layer 2, and so on. A lexicographic policy resolves inside a layer; a field that the first layers leave null is
filled from successive layers.

Nothing ever gathers a group: records with the same flags and trust differ in recency only, so the latest of each
such *cell* dominates the rest of the cell. ``max_by`` per (group, flags, trust) is a partial aggregate that runs
before the shuffle; what is collected per group is at most 2^fields x trust levels structs, whatever the group's
size. Trust must therefore be a small discrete rank.

Defined cases: null keys form no group; null recency sorts as oldest; ties in recency go to the smaller id; repeated
rows of one id count once towards ``n_ids``; a field that no member has good is null; an empty table gives none.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Mapping

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from marquee.functions.temporal import let
from marquee.session import checkpointed

EARLIEST = "0001-01-01 00:00:00"


def cells(df: DataFrame, key: str, id_col: str, good: Mapping[str, Column], recency: Column, trust: Column | None = None, carry: Mapping[str, Column] | None = None) -> DataFrame:
    """One row per (key, flags, trust): the latest record of the cell, with the columns of carry."""
    flags = [F.coalesce(c, F.lit(False)).alias(f"good_{n}") for n, c in good.items()]
    carried = [c.alias(n) for n, c in (carry or {}).items()]
    rank = F.coalesce(trust.cast("int"), F.lit(0)) if trust is not None else F.lit(0)
    when = F.coalesce(recency.cast("timestamp"), F.lit(EARLIEST).cast("timestamp"))
    slim = df.where(F.col(key).isNotNull()).select(F.col(key), F.col(id_col).alias("rid"), *flags, rank.alias("trust"), when.alias("recency"), *carried)
    names = [f"good_{n}" for n in good]
    best = F.min_by(F.struct("rid", "recency", *(carry or {})), F.struct((-F.unix_micros("recency")).alias("a"), F.col("rid").alias("b")))
    return (
        slim.groupBy(key, *names, "trust")
        .agg(best.alias("best"), F.min("rid").alias("low"), F.max("rid").alias("high"))
        .select(key, *names, "trust", "best.*", (F.col("low") != F.col("high")).alias("several"))
    )


def _dominates(a: Column, b: Column, flags: list[str]) -> Column:
    """a is at least as good as b everywhere and better somewhere."""
    at_least = (a["recency"] >= b["recency"]) & (a["trust"] >= b["trust"])
    better = (a["recency"] > b["recency"]) | (a["trust"] > b["trust"])
    for f in flags:
        at_least = at_least & (a[f] | ~b[f])
        better = better | (a[f] & ~b[f])
    return at_least & better


def layered(group: Column, flags: list[str]):
    """group (array of structs) in lexicographic order, and the fold that gives each element its dominance layer (more good fields first,
    then recency, then trust, then id): every dominator of an element stands before it."""
    n_good = lambda x: sum((x[f].cast("int") for f in flags), F.lit(0))
    sort_keys = F.transform(
        group,
        lambda x, i: F.struct((-n_good(x)).alias("a"), (-F.unix_micros(x["recency"])).alias("b"), (-x["trust"]).alias("c"), x["rid"].alias("d"), i.alias("i")),
    )
    ordered = F.transform(F.array_sort(sort_keys), lambda k: F.get(group, k["i"]))

    def step(acc: Column, x: Column) -> Column:
        above = F.filter(acc, lambda y: _dominates(y["e"], x, flags))
        layer = F.coalesce(F.array_max(F.transform(above, lambda y: y["layer"])), F.lit(0)) + 1
        return F.concat(acc, F.array(F.struct(x.alias("e"), layer.cast("int").alias("layer"))))

    return ordered, step


def field_winners(cells_df: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """(key, <field>_id, <field>_layer ...) of every key with two ids or more: per field the skyline over (that
    field's completeness, recency, trust) and its further layers. The lexicographic policy (completeness, recency,
    trust, id) resolves inside a layer; a field that layer 1 leaves null is filled from the next layer that has it."""
    flags = [f"good_{f}" for f in fields]
    payload = F.struct("rid", "recency", "trust", *flags)
    several = F.max("several") | (F.min("rid") != F.max("rid"))
    grouped = cells_df.groupBy(key).agg(F.collect_list(payload).alias("g"), several.alias("several")).where("several")
    element = F.struct(F.col("g")[0].alias("e"), F.lit(1).alias("layer"))
    for f, flag in zip(fields, flags, strict=True):
        ordered, step = layered(F.col("g"), [flag])
        found = F.aggregate(ordered, F.slice(F.array(element), 1, 0), step)
        # the fold keeps the policy's order, so the first of the lowest layer with a value is the policy's choice
        usable = _with_flag(found, flag)
        lowest = F.array_min(F.transform(usable, lambda x: x["layer"]))
        grouped = grouped.withColumn(f"{f}_won", let(F.struct(usable.alias("u"), lowest.alias("n")), lambda x: F.get(F.filter(x["u"], lambda y: y["layer"] == x["n"]), F.lit(0))))
    cols = [c for f in fields for c in (F.col(f"{f}_won")["e"]["rid"].alias(f"{f}_id"), F.col(f"{f}_won")["layer"].alias(f"{f}_layer"))]
    return grouped.select(key, *cols)


def _with_flag(found: Column, flag: str) -> Column:
    return F.filter(found, lambda x: x["e"][flag])


def survivors(cells_df: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """One surviving record per key: (key, base_id, layers, and per field its value, the id it came from and that
    record's layer). A cell column named like the field holds its value."""
    flags = [f"good_{f}" for f in fields]
    payload = F.struct("rid", "recency", "trust", *flags, *fields)
    grouped = cells_df.groupBy(key).agg(F.collect_list(payload).alias("g"))
    ordered, step = layered(F.col("g"), flags)
    element = F.struct(F.col("g")[0].alias("e"), F.lit(1).alias("layer"))
    empty = F.slice(F.array(element), 1, 0)
    out = grouped.select(key, F.aggregate(ordered, empty, step).alias("l"))
    by_layer = F.array_sort(F.transform("l", lambda x, i: F.struct(x["layer"].alias("layer"), i.alias("i"))))
    out = out.select(key, F.transform(by_layer, lambda k: F.get(F.col("l"), k["i"])).alias("l"))
    cols = [F.col(key), F.col("l")[0]["e"]["rid"].alias("base_id"), F.array_max(F.transform("l", lambda x: x["layer"])).alias("layers")]
    def has(field: str):
        return lambda x: x["e"][f"good_{field}"]

    for f in fields:
        first = F.get(F.filter("l", has(f)), F.lit(0))
        cols += [first["e"][f].alias(f), first["e"]["rid"].alias(f"{f}_id"), first["layer"].alias(f"{f}_layer")]
    return out.select(*cols)


def mark_prefix_cuts(df: DataFrame, key: str, text: str, good: str) -> DataFrame:
    """df with ``good`` cleared where text is a proper prefix of another good text of the same group: a cut that fell
    on a sentence's end. In the order of (key, text) the extensions of a text follow it without a gap, so a text is a
    cut exactly if the next distinct text of its group starts with it. The distinct pairs are range partitioned by
    (key, text), whatever a group's size; a partition's last pair meets the first pair of the next one."""
    pairs = df.where(F.col(good) & F.col(key).isNotNull()).select(F.col(key).alias("k"), F.col(text).alias("t")).distinct()
    ranged = pairs.repartitionByRange("k", "t").sortWithinPartitions("k", "t").withColumn("p", F.spark_partition_id())
    schema = T.StructType([T.StructField("kind", T.StringType()), T.StructField("p", T.IntegerType()), T.StructField("k", df.schema[key].dataType), T.StructField("t", T.StringType()), T.StructField("m", T.StringType())])

    def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """The cuts inside a partition as digests, and its first and last pair."""
        before = None
        for pdf in batches:
            rows = []
            for p, k, t in zip(pdf["p"].tolist(), pdf["k"].tolist(), pdf["t"].tolist(), strict=True):
                if before is None:
                    rows.append(("first", p, k, t, None))
                elif before[1] == k and t.startswith(before[2]):
                    rows.append(("cut", p, k, None, hashlib.md5(before[2].encode()).hexdigest()))
                before = (p, k, t)
            yield pd.DataFrame(rows, columns=["kind", "p", "k", "t", "m"])
        if before:
            yield pd.DataFrame([("last", *before, None)], columns=["kind", "p", "k", "t", "m"])

    walked = checkpointed(ranged.mapInPandas(walk, schema))
    in_order = Window.orderBy("p", "kind")  # two rows per partition
    seam = walked.where("kind != 'cut'").withColumns({"nk": F.lead("k").over(in_order), "nt": F.lead("t").over(in_order)})
    seam = seam.where((F.col("kind") == "last") & (F.col("k") == F.col("nk")) & F.startswith("nt", "t")).select("k", F.md5("t").alias("m"))
    cuts = walked.where("kind = 'cut'").select("k", "m").unionByName(seam).select(F.col("k").alias("__k"), F.col("m").alias("__m"))
    joined = df.withColumn("__h", F.when(F.col(good), F.md5(text))).join(cuts, (F.col(key) == F.col("__k")) & (F.col("__h") == F.col("__m")), "left")
    return joined.withColumn(good, F.col(good) & F.col("__m").isNull()).drop("__h", "__k", "__m")
