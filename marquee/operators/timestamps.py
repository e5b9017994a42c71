"""Mixed timestamp formats and zones, normalised to one UTC instant.

Each value gets the array of all its valid readings (functions.moments). Along each source's record order a Viterbi
pass picks one reading per value: the emission cost is the policy's rank, transitions cost ``SWITCH`` when the format
changes and ``BACKWARD`` when time runs backward. Where a value has one reading the chain is anchored and flushed, so
memory is bounded by the longest run of ambiguous values.

The order is made by range partitioning on (source, order, key): a source that holds a third of all rows is spread
over many partitions and no group is ever gathered. A chain starts anew at a partition's edge. RANK outweighs any two
transitions, so policy decides between centuries and passings and neither the edges nor the size of the table change
a result; with Policy("either", "either") ranks are even for day-first and month-first and the transitions decide.

Defined cases: null, blank, pure dates and unusable values give a null instant; equal rows give equal results; an
empty table gives an empty table; input columns survive unless named like the operator's own (label, start_us).
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from marquee.functions.moments import Policy, readings

RANK, SWITCH, BACKWARD = 10.0, 1.0, 2.0


class Chain:
    """Viterbi over one source's values. Only values with two readings or more are kept waiting."""

    def __init__(self, rank: float = RANK, switch: float = SWITCH, backward: float = BACKWARD):
        self.rank, self.switch, self.backward = rank, switch, backward
        self.states: list[tuple[str, int]] = []
        self.costs: list[float] = []
        self.pending: list[tuple[object, list[tuple[str, int, int]], list[int]]] = []

    def push(self, tag: object, options: list[tuple[str, int, int]]) -> Iterator[tuple[object, tuple[str, int]]]:
        """Takes the next value; yields the values decided by it."""
        if not options:
            return
        costs, back = [], []
        for label, at, rank in options:
            if self.states:
                steps = [c + self.switch * (lab != label) + self.backward * (was > at) for (lab, was), c in zip(self.states, self.costs, strict=True)]
                k = min(range(len(steps)), key=steps.__getitem__)
                costs.append(steps[k] + self.rank * rank)
                back.append(k)
            else:
                costs.append(self.rank * rank)
                back.append(0)
        self.pending.append((tag, options, back))
        low = min(costs)
        self.costs = [c - low for c in costs]
        self.states = [(o[0], o[1]) for o in options]
        if len(options) == 1:
            yield from self.flush(keep=True)

    def flush(self, keep: bool = False) -> Iterator[tuple[object, tuple[str, int]]]:
        if not self.pending:
            return
        k = min(range(len(self.costs)), key=self.costs.__getitem__)
        out = []
        for tag, options, back in reversed(self.pending):
            out.append((tag, options[k][:2]))
            k = back[k]
        self.pending = []
        if not keep:
            self.states, self.costs = [], []
        yield from reversed(out)


def normalise(
    df: DataFrame,
    source_col: str,
    order_cols: list[str],
    key_col: str,
    text_col: str,
    zone_col: str | None = None,
    policy: Policy = Policy(),
) -> DataFrame:
    """(key_col, label, start_us) for every distinct (source, order, key, text, zone); start_us is null where the
    value gives no instant. The key may be null."""
    cols = [F.col(source_col).cast("string").alias("s"), *[F.col(c).alias(f"o{i}") for i, c in enumerate(order_cols)], F.col(key_col).alias("k"), F.col(text_col).alias("t")]
    slim = df.select(*cols, (F.col(zone_col) if zone_col else F.lit(None).cast("string")).alias("z"))
    keys = ["s", *[f"o{i}" for i in range(len(order_cols))], "k"]
    ordered = slim.repartitionByRange(*keys).sortWithinPartitions(*keys)
    key_type = df.schema[key_col].dataType
    schema = T.StructType([T.StructField(key_col, key_type), T.StructField("label", T.StringType()), T.StructField("start_us", T.LongType())])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        chain, source = Chain(), object()
        cache: dict[tuple, list] = {}
        for pdf in batches:
            out = []
            for s, k, t, z in zip(pdf["s"], pdf["k"], pdf["t"], pdf["z"], strict=True):
                if s != source:
                    out += [(tag, *got) for tag, got in chain.flush()]
                    source = s
                at = (t if isinstance(t, str) else None, z if isinstance(z, str) else None)
                if at not in cache:
                    if len(cache) > 20_000:
                        cache.clear()
                    cache[at] = readings(*at, policy)
                options = cache[at]
                if not options:
                    out.append((k, None, None))
                out += [(tag, *got) for tag, got in chain.push(k, options)]
            yield frame(out)
        yield frame([(tag, *got) for tag, got in chain.flush()])

    def frame(rows: list[tuple]) -> pd.DataFrame:
        pdf = pd.DataFrame(rows, columns=[key_col, "label", "start_us"])
        pdf["start_us"] = pdf["start_us"].astype("Int64")
        return pdf

    return ordered.mapInPandas(run, schema)
