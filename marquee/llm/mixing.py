"""Mixing sources to target weights, by Sainte-Lague apportionment of equal token blocks.

1. Sizes are tokens of a public tokenizer (its file is a parameter). Equal texts count as one text, owned by the source
   whose name is smallest, since no text may be used more than ``max_repeats`` times whatever ids it goes by.
2. The mix's size is given, or the largest for which every source can reach its target with its repeats. It is cut into
   ``blocks`` equal blocks; they go to sources by highest quotients share / (2 s + 1), never beyond a source's capacity.
3. A source is hashed into shards of about ``shard_tokens`` tokens, but of SHARD_BLOCKS blocks at least; its blocks go
   to shards by the same rule with the shards' tokens as weights. Quotas are integer; what a shard cannot hold of its
   last block goes to shards with room, so no part of a source's quota is lost. One row per shard reaches the driver, at
   most blocks / SHARD_BLOCKS plus one per source, whatever the corpus.
4. A shard's texts in seeded order are cut into blocks; whole passes over the shard and the first blocks of the rest
   fill its quota (the seeded order makes this a seeded choice of blocks). A window runs over one shard only, so a
   source that holds a third of all rows is worked on by as many tasks as it has shards.

Defined cases: null or empty texts have no tokens and are never chosen; sources without a target get nothing, the
shares of targets without texts fall to the others in proportion (the shares reached say so); ties in quotients go to the smaller name; repeated rows of one id are
one text; an empty table gives an empty mix; extra columns are ignored.
"""

from __future__ import annotations

import heapq
import os
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from marquee.session import checkpointed

TOKENIZER = "/opt/tokenizers/byte_bpe_50k.json"
BLOCKS, SHARD_TOKENS, SEED = 100_000, 50_000_000, 17
#: A shard gets SHARD_BLOCKS blocks or more on average, so shards are at most BLOCKS / SHARD_BLOCKS and their table is bounded.
SHARD_BLOCKS = 8


def sainte_lague(weights: dict, seats: int, caps: dict | None = None) -> dict:
    """seats per key by highest quotients weight / (2 s + 1), at most caps[key] each; seats that no key can take stay
    empty. Ties go to the smaller key."""
    got = dict.fromkeys(weights, 0)
    heap = [(-w, k) for k, w in weights.items() if w > 0 and (caps is None or caps.get(k, 0) > 0)]
    heapq.heapify(heap)
    for _ in range(seats):
        if not heap:
            break
        _, k = heapq.heappop(heap)
        got[k] += 1
        if caps is None or got[k] < caps[k]:
            heapq.heappush(heap, (-weights[k] / (2 * got[k] + 1), k))
    return got


def shard_quotas(shards: dict, seats: int, size: float, repeats: int) -> dict:
    """Tokens per shard: its blocks, at most what it holds with its repeats; the excess goes to shards with room."""
    room = {k: n * repeats for k, n in shards.items()}
    blocks = sainte_lague(shards, seats, {k: int(r / size) + 1 for k, r in room.items()})
    quota = {k: min(b * size, room[k]) for k, b in blocks.items()}
    missing = min(seats * size, sum(room.values())) - sum(quota.values())
    free = sum(room[k] - q for k, q in quota.items())
    if missing > 0 and free > 0:
        quota = {k: q + missing * (room[k] - q) / free for k, q in quota.items()}
    # integers by largest remainder
    whole = {k: int(q + 1e-6) for k, q in quota.items()}
    left = round(sum(quota.values())) - sum(whole.values())
    for k in sorted(quota, key=lambda k: (whole[k] - quota[k], k))[: max(0, left)]:
        whole[k] += whole[k] < room[k]
    return whole


def token_counts(docs: DataFrame, text_col: str, tokenizer: str = TOKENIZER) -> DataFrame:
    """docs with tokens (long): Arrow batches through the tokenizer's own batch encoder. The driver's file is handed to
    the executors by Spark, so it need not exist on them."""
    docs.sparkSession.sparkContext.addFile(tokenizer)
    name = os.path.basename(tokenizer)

    @F.pandas_udf(T.LongType())
    def count(it: Iterator[pd.Series]) -> Iterator[pd.Series]:
        from pyspark import SparkFiles
        from tokenizers import Tokenizer

        tok = Tokenizer.from_file(SparkFiles.get(name))
        tok.encode_special_tokens = True
        for s in it:
            texts = [t if isinstance(t, str) else "" for t in s]
            yield pd.Series([len(e.ids) for e in tok.encode_batch(texts, add_special_tokens=False)], index=s.index, dtype="int64")

    return docs.withColumn("tokens", count(F.col(text_col)))


def mix(
    docs: DataFrame,
    targets: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    total_tokens: int | None = None,
    tokenizer: str = TOKENIZER,
    blocks: int = BLOCKS,
    shard_tokens: int = SHARD_TOKENS,
    seed: int = SEED,
) -> tuple[DataFrame, DataFrame]:
    """(chosen, shares): chosen has (id, source, tokens, repeats), shares has target and reached share per source.
    targets has (source_name, target_share, max_repeats), one row per source: a bounded table."""
    goal = {r["source_name"]: (float(r["target_share"]), int(r["max_repeats"])) for r in targets.collect()}
    spark = docs.sparkSession
    named = docs.where(F.col(source_col).isNotNull() & (F.length(text_col) > 0)).select(F.col(id_col).alias("id"), F.col(source_col).alias("source"), F.col(text_col).alias("t"))
    # one row per text: the text itself doesn't travel, only its digest and size
    sized = token_counts(named, "t", tokenizer).select("id", "source", "tokens", F.sha2("t", 256).alias("h"))
    owner = F.min(F.struct("source", "id"))
    texts = checkpointed(sized.groupBy("h").agg(owner.alias("o"), F.first("tokens").alias("tokens")).select("o.id", "o.source", "tokens", "h").where("tokens > 0"))
    sums = {r["source"]: r["n"] for r in texts.groupBy("source").agg(F.sum("tokens").alias("n")).collect() if r["source"] in goal}
    capacity = {s: n * goal[s][1] for s, n in sums.items()}
    # the shares of targets without texts fall to the others in proportion
    there = sum(goal[s][0] for s in sums) or 1.0
    share = {s: goal[s][0] / there for s in sums}
    if total_tokens is None:
        total_tokens = int(min((capacity[s] / share[s] for s in sums if share[s] > 0), default=0))
    size = max(1.0, total_tokens / blocks)
    seats = sainte_lague(share, blocks, {s: int(capacity[s] / size + 1e-9) for s in sums})
    n_shards = {s: max(1, min(-(-n // shard_tokens), seats[s] // SHARD_BLOCKS)) for s, n in sums.items()}
    shard_table = [(s, n_shards[s]) for s in sums]
    shards_of = F.broadcast(spark.createDataFrame(shard_table, "source string, n_shards long"))
    order = F.xxhash64(F.lit(seed), F.col("h"))
    placed = texts.join(shards_of, "source").withColumn("shard", F.pmod(F.xxhash64(F.lit(seed + 1), F.col("h")), F.col("n_shards")))
    shard_sums = {(r["source"], r["shard"]): r["n"] for r in placed.groupBy("source", "shard").agg(F.sum("tokens").alias("n")).collect()}
    quotas = []
    for s in sums:
        mine = {k: n for k, n in shard_sums.items() if k[0] == s}
        quotas += [(*k, q, mine[k], goal[s][1]) for k, q in shard_quotas(mine, seats[s], size, goal[s][1]).items()]
    quota = F.broadcast(spark.createDataFrame(quotas, "source string, shard long, quota long, shard_tokens long, max_repeats int"))
    running = Window.partitionBy("source", "shard").orderBy(order, "id").rowsBetween(Window.unboundedPreceding, 0)
    run = placed.join(quota, ["source", "shard"]).withColumn("passes", F.floor(F.col("quota") / F.col("shard_tokens")))
    run = run.withColumn("upto", F.sum("tokens").over(running)).withColumn("rest", F.col("quota") - F.col("passes") * F.col("shard_tokens"))
    extra = (F.col("upto") - F.col("tokens") / 2 <= F.col("rest")).cast("int")
    repeats = F.least(F.col("passes") + extra, F.col("max_repeats").cast("long")).cast("int")
    chosen = run.withColumn("repeats", repeats).where("repeats > 0").select(F.col("id").alias(id_col), F.col("source").alias(source_col), "tokens", "repeats")
    used = chosen.groupBy(F.col(source_col).alias("source_name")).agg(F.sum(F.col("tokens") * F.col("repeats")).alias("tokens"), F.count("*").alias("texts"), F.max("repeats").alias("most_repeats"))
    reached = targets.join(used, "source_name", "left").withColumn("tokens", F.coalesce("tokens", F.lit(0)))
    whole = F.sum("tokens").over(Window.partitionBy())  # one row per target
    shares = reached.select("source_name", "target_share", "max_repeats", "tokens", F.coalesce("texts", F.lit(0)).alias("texts"), F.coalesce("most_repeats", F.lit(0)).alias("most_repeats"), F.round(F.col("tokens") / F.greatest(whole, F.lit(1)), 6).alias("actual_share"))
    return chosen, shares
