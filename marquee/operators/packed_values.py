"""Several values packed in one field: one row per value, position kept.

Every text is parsed under dialects (a set of delimiters, quotes honoured). A parse costs the code lengths of its
values plus the dialect's own description; the shortest total wins. Value codes come from the whole column, from the
texts that hold no delimiter at all (they need no dialect): exact counts of whole values and a character-bigram table of
at most 97 x 97 pairs. A vocabulary (category ids and names) may be given too. Counts and vocabulary stay a distributed
table of any size: the pieces of each distinct text are looked up in it by a join, and the parser gets what was found.
A bitmap of ``SIEVE`` bits spares the join most pieces that the table lacks; a full one only lets more of them through.

Inside a dialect the delimiters' occurrences that separate values are chosen by dynamic programming, so a delimiter
inside a URL or a known name splits nothing.

Defined cases: null or blank text gives no row; a text of one value gives one row at position 0; empty pieces give no
row and take no position; repeated values stay; repeated input rows give repeated output rows (drop them first if
ids may repeat); extra columns are kept by name unless they clash with ``pos`` and ``item``, which the operator owns;
texts and values of any length are parsed whole.
"""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field, replace

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from marquee.session import checkpointed, large

SIEVE = 1 << 22
ESCAPE_BITS, CHAR_BITS, KNOWN_BITS, NUMBER_BITS, URL_BITS = 40.0, 8.0, 1.0, 14.0, 6.0
QUOTE_BITS, USE_BITS, TYPE_BITS, EMPTY_BITS = 2.0, 1.0, 5.0, 3.0

#: Delimiters by name; blanks around them belong to them.
DELIMITERS = {
    "semicolon": r";",
    "pipe": r"\|",
    "comma": r",",
    "newline": r"\r\n|\n|\r",
    "tab": r"\t",
    "and": r"(?<=\s)and(?=\s|$)|^and(?=\s)",
    "ampersand": r"&",
    "plus": r"\+",
    "slash": r"/",
    "space": r" +",
}
URL = re.compile(
    r"(?:https?://)?(?:[a-z0-9](?:[a-z0-9-]*[a-z0-9])?\.)+[a-z][a-z0-9-]*(?::\d+)?(?:[/?#](?!\S*(?:://|[,;|&+]www\.))[^\s\"'|]*)?",
    re.I,
)
_NUMBER = re.compile(r"\d{1,3}")


def char_class(c: str) -> str:
    return c if " " <= c <= "~" else "?"


@dataclass
class ValueCodes:
    """Code lengths in bits of single values. ``learn_codes`` leaves counts and vocabulary in ``table``; ``holding``
    takes over what was looked up there."""

    kind: str
    vocabulary: frozenset[str] = frozenset()
    counts: dict[str, int] = field(default_factory=dict)
    total: int = 0
    bigrams: dict[str, float] = field(default_factory=dict)
    unseen_bits: float = 7.0
    #: The number of words in the whole vocabulary.
    words: int = 0
    #: The longest value that has a code of its own.
    longest: int = 0
    #: (v, n): every value with a code of its own and its count, 0 for words of the vocabulary.
    table: DataFrame | None = field(default=None, repr=False, compare=False)
    sieve: bytes = field(default=b"", repr=False, compare=False)
    _memo: dict[str, float] = field(default_factory=dict, repr=False, compare=False)

    def __post_init__(self) -> None:
        self.words = self.words or len(self.vocabulary)
        self.longest = max([self.longest, *map(len, self.vocabulary)])

    def holding(self, found: dict[str, int]) -> ValueCodes:
        """These codes with the rows of the table that one text needs."""
        return replace(self, vocabulary=frozenset(v for v, n in found.items() if not n), counts={v: n for v, n in found.items() if n}, table=None)

    def may_hold(self, value: str) -> bool:
        """False only for values that the table lacks."""
        h = zlib.crc32(value.encode()) % SIEVE
        return bool(self.sieve and self.sieve[h >> 3] >> (h & 7) & 1)

    def bits(self, value: str) -> float:
        if self.table is not None:
            return self.holding({r["v"]: r["n"] for r in self.table.where(F.col("v") == value).collect()}).bits(value)
        if value not in self._memo:
            if len(self._memo) > 200_000:
                self._memo.clear()
            self._memo[value] = self._spelled(value)
        best, seen = self._memo[value], self.counts.get(value, 0)
        if value in self.vocabulary:
            return min(best, KNOWN_BITS + math.log2(self.words))
        return min(best, 2 + math.log2(self.total / seen)) if seen >= 2 else best

    def coded_beyond(self, text: str, start: int, at: int, between: str) -> bool:
        """A value that starts at start may have a code though it runs on from at over the delimiter between."""
        if text[start : start + 1] in ("\"", "'") and text.find(text[start], start + 1, at) < 0:
            return True
        if self.kind == "url" and not re.search(r"[\s|\"']", between):
            return True
        return at - start < self.longest + 2

    def _spelled(self, value: str) -> float:
        """The bits of a value by its characters alone."""
        best = ESCAPE_BITS + CHAR_BITS * len(value)
        if self.kind == "category" and _NUMBER.fullmatch(value):
            best = min(best, NUMBER_BITS)
        if self.kind == "url" and URL.fullmatch(value):
            text = "^" + value + "$"
            best = min(best, URL_BITS + sum(self.bigrams.get(a + b, self.unseen_bits) for a, b in zip(map(char_class, text), map(char_class, text[1:]), strict=False)))
        return best


def delimiters_of(kind: str) -> dict[str, str]:
    """A URL may hold any number of slashes and pluses; they never part URLs."""
    return {k: v for k, v in DELIMITERS.items() if kind != "url" or k not in ("slash", "plus")}


def _boundaries(text: str, names: tuple[str, ...]) -> list[tuple[int, int, str]]:
    found = [(m.start(), m.end(), n) for n in names for m in re.finditer(DELIMITERS[n], text)]
    out, end = [], -1
    for b in sorted(found, key=lambda b: (b[0], -b[1])):
        if b[0] >= end:
            out.append(b)
            end = b[1]
    return out


def _unquoted(piece: str) -> tuple[str, float]:
    piece = piece.strip()
    if len(piece) >= 2 and piece[0] == piece[-1] and piece[0] in "\"'":
        return piece[1:-1].strip(), QUOTE_BITS
    return piece, 0.0


def parse_under(text: str, names: tuple[str, ...], codes: ValueCodes) -> tuple[float, list[str], set[str]]:
    """The cheapest parse of text whose separators are among names: (bits without the dialect's, values, names
    used). Two states: at a value's start, or inside free text that runs over further delimiters."""
    cuts = _boundaries(text, names)
    starts = [0] + [b[1] for b in cuts]
    ends = [b[0] for b in cuts] + [len(text)]
    n = len(starts)
    inf = math.inf
    # best[i]: cheapest parse of everything before segment i; free[i]: the same, with an open free-text value
    best, free = [inf] * (n + 1), [inf] * (n + 1)
    back: list = [None] * (n + 1)
    opened: list = [0] * (n + 1)
    best[0] = 0.0
    memo: dict[tuple[int, int], float] = {}

    def piece_bits(i: int, j: int) -> float:
        if (i, j) not in memo:
            value, extra = _unquoted(text[starts[i] : ends[j]])
            if not value:
                memo[i, j] = EMPTY_BITS if i == j else inf
            elif value[0] in "\"'" and value[0] not in value[1:]:
                memo[i, j] = 2 * ESCAPE_BITS + CHAR_BITS * len(value)
            else:
                memo[i, j] = extra + codes.bits(value)
        return memo[i, j]

    for i in range(n):
        use = USE_BITS if i else 0.0
        here = best[i] + use
        j = i
        while j < n and (j == i or codes.coded_beyond(text, starts[i], ends[j - 1], text[ends[j - 1] : starts[j]])):
            cost = here + piece_bits(i, j)
            if cost < best[j + 1]:
                best[j + 1], back[j + 1] = cost, i
            j += 1
        if here < inf:
            cost = here + ESCAPE_BITS + CHAR_BITS * (ends[i] - starts[i])
            if cost < free[i + 1]:
                free[i + 1], opened[i + 1] = cost, i
        if free[i] < inf:
            cost = free[i] + CHAR_BITS * (ends[i] - ends[i - 1])
            if cost < free[i + 1]:
                free[i + 1], opened[i + 1] = cost, opened[i]
        if free[i + 1] < best[i + 1]:
            best[i + 1], back[i + 1] = free[i + 1], opened[i + 1]
    spans, at = [], n
    while at > 0:
        spans.append((back[at], at - 1))
        at = back[at]
    spans.reverse()
    used = {cuts[i - 1][2] for i, _ in spans if i}
    values = [v for i, j in spans if (v := _unquoted(text[starts[i] : ends[j]])[0])]
    return best[n], values, used


def parse_packed(text: str, codes: ValueCodes) -> list[str]:
    """The values of text under its cheapest dialect."""
    text = text.strip()
    if not text:
        return []
    present = tuple(n for n, p in delimiters_of(codes.kind).items() if re.search(p, text))
    tried: dict[tuple[str, ...], tuple[float, list[str], set[str]]] = {}

    def total(names: tuple[str, ...]) -> float:
        if names not in tried:
            bits, values, used = parse_under(text, names, codes)
            tried[names] = (bits + TYPE_BITS * len(names), values, used)
            if len(used) < len(names):  # the same parse, described by the delimiters it uses
                tried[tuple(x for x in names if x in used)] = (bits + TYPE_BITS * len(used), values, used)
        return tried[names][0]

    total(())
    for n in present:
        total((n,))
    total(present)
    while True:  # drop delimiters from the best dialect as long as that pays
        names = min(tried, key=lambda k: (tried[k][0], len(k), k))
        before = len(tried)
        for n in names:
            total(tuple(x for x in names if x != n))
        if len(tried) == before:
            return tried[min(tried, key=lambda k: (tried[k][0], len(k), k))][1]


def pieces(text: str, codes: ValueCodes) -> list[str]:
    """The values that a parse of text may ask for and the table may hold. No two delimiters overlap, so the pieces of
    every dialect lie between boundaries of all delimiters."""
    text = text.strip()
    cuts = _boundaries(text, tuple(delimiters_of(codes.kind)))
    starts = [0] + [b[1] for b in cuts]
    ends = [b[0] for b in cuts] + [len(text)]
    out: dict[str, None] = {}
    for i, start in enumerate(starts if cuts else []):
        for end in ends[i:]:
            raw = text[start:end].strip()
            value = _unquoted(raw)[0]
            if value and len(value) <= codes.longest and value not in out and codes.may_hold(value):
                out[value] = None
            if len(raw) > codes.longest + 2 and (text[start] not in "\"'" or text.find(text[start], start + 1, end) >= 0):
                break
    return list(out)


def learn_codes(texts: DataFrame, text: Column, kind: str, vocabulary: DataFrame | None = None) -> ValueCodes:
    """Counts whole values and bigrams of the delimiter-free texts. The values stay a table; a few totals, the bitmap's
    words and 97 x 97 pairs at most reach the driver."""
    pattern = "|".join(f"(?:{p})" for n, p in delimiters_of(kind).items() if kind != "url" or n not in ("ampersand", "comma", "semicolon"))
    atomic = texts.select(F.trim(text).alias("v")).where((F.col("v") != "") & ~F.col("v").rlike(pattern))
    counted = atomic.groupBy("v").agg(F.count("*").alias("n"))
    if vocabulary is not None:
        named = vocabulary.select(F.explode(F.array(*[F.col(c).cast("string") for c in vocabulary.columns])).alias("v")).where("v != ''")
        counted = counted.unionByName(named.select("v", F.lit(0).cast("long").alias("n")))
    # a word of the vocabulary has n = 0, whatever its uses
    values = checkpointed(counted.groupBy("v").agg(F.min("n").alias("n"), F.sum("n").alias("uses")))
    size = values.agg(F.sum("uses").alias("total"), F.max(F.length("v")).alias("longest"), F.count_if(F.col("n") == 0).alias("words")).first()
    table = values.where("n != 1").select("v", "n")
    h = F.crc32(F.col("v").cast("binary")) % SIEVE
    marks = table.select(h.alias("h")).groupBy(F.expr("cast(h div 64 as int)").alias("w")).agg(F.expr("bit_or(shiftleft(1L, cast(h % 64 as int)))").alias("m")).collect()
    sieve = np.zeros(SIEVE // 64, dtype="<i8")
    for r in marks:
        sieve[r["w"]] = r["m"]
    codes = ValueCodes(kind, total=size["total"] or 0, words=size["words"], longest=size["longest"] or 0, table=table, sieve=sieve.tobytes())
    if kind == "url":
        # [^ -~] is the one class of all other characters
        framed = F.concat(F.lit("^"), F.regexp_replace("v", "[^ -~]", "?"), F.lit("$"))
        pairs = (
            atomic.where(F.col("v").rlike(r"^\S+\.\S+$"))
            .select(framed.alias("v"))
            .select(F.explode(F.transform(F.sequence(F.lit(1), F.length("v") - 1), lambda i: F.col("v").substr(i, F.lit(2)))).alias("p"))
            .groupBy("p")
            .count()
            .collect()
        )
        lead: dict[str, int] = {}
        for r in pairs:
            lead[r["p"][0]] = lead.get(r["p"][0], 0) + r["count"]
        codes.bigrams = {r["p"]: -math.log2((r["count"] + 0.1) / (lead[r["p"][0]] + 9.7)) for r in pairs}
        codes.unseen_bits = 12.0
    return codes


def split_packed(df: DataFrame, text_col: str, codes: ValueCodes) -> DataFrame:
    """df with pos and item instead of one row per text. Every distinct text is looked up and parsed once."""
    slim = replace(codes, table=None)

    @F.pandas_udf(T.ArrayType(T.StringType()))
    def asked(s: pd.Series) -> pd.Series:
        return pd.Series([pieces(v, slim) for v in s], index=s.index)

    @F.pandas_udf(T.ArrayType(T.StringType()))
    def values(it: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for text, known, uses in it:
            found = [slim if v is None else slim.holding(dict(zip(v, map(int, n), strict=True))) for v, n in zip(known, uses, strict=True)]
            yield pd.Series([parse_packed(t, c) for t, c in zip(text, found, strict=True)], index=text.index)

    kept = [c for c in df.columns if c not in ("pos", "item")]
    rows = df.select(*kept, F.col(text_col).alias("__text"))
    # parsing is all work and few bytes: partitions by size would leave it to a task or two
    tasks = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    texts = rows.where("__text is not null").select("__text").distinct()
    if codes.table is None:
        held = texts.withColumn("__known", F.lit(None).cast("array<struct<v:string,n:bigint>>"))
    else:
        hits = texts.repartition(tasks).select("__text", F.explode(asked("__text")).alias("v")).join(large(codes.table), "v")
        held = texts.join(large(hits.groupBy("__text").agg(F.collect_list(F.struct("v", "n")).alias("__known"))), "__text", "left")
    parsed = held.repartition(tasks).select("__text", values("__text", "__known.v", "__known.n").alias("__values"))
    parsed = rows.join(large(parsed.where(F.size("__values") > 0)), "__text")
    if "n_values" in kept:
        return parsed.select(*kept, F.posexplode("__values").alias("pos", "item"))
    return parsed.select(*kept, F.size("__values").alias("n_values"), F.posexplode("__values").alias("pos", "item"))
