"""Evaluation passages leaking into a corpus: which documents carry which items, wholly or in part.

1. SimHash of windows. The window is item-sized for the smallest passage that counts: half the shortest item (between
   MIN_WINDOW and MAX_WINDOW words). Items give a fingerprint at every position, documents at every STRIDE words, so
   every unchanged passage of window + STRIDE words meets an equal fingerprint.
2. Multi-index Hamming: the 64 bits are cut into RADIUS + 1 blocks; two fingerprints within RADIUS bits agree on one
   block at least (pigeonhole), so looking up every block finds all pairs within RADIUS.
3. Candidates are verified exactly: containment of the item's SHINGLE-word shingles in the document, each weighted by
   ln((1 + N) / (1 + number of texts that hold it)) over the N distinct texts, so shared turns of phrase count little.
   A hot leak makes its own shingles common, so a pair is kept too if the shingles held cover COVERAGE of the item's
   running words, whatever they weigh. Where no shingle of an item weighs anything all weigh alike.

The items are a stated query set. They are taken in blocks of at most BLOCK items, each small enough to travel with the
tasks (its size is checked); the documents are read in one narrow pass per block, and nothing of them is shuffled but
the matches and a hash of each text. Text is compared without case, markup, punctuation, hyphens and character references.

Defined cases: null or blank texts match nothing; texts shorter than the window are one window; repeated documents give
their pairs under each id; repeated rows of one id give one pair; no items give an empty table; extra columns are
ignored.
"""

from __future__ import annotations

import html
import math
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from marquee.session import checkpointed

RADIUS, STRIDE, SHINGLE, CONTAINMENT, COVERAGE = 6, 4, 5, 0.4, 0.5
MIN_WINDOW, MAX_WINDOW, BLOCK = 8, 32, 2000
_TAG = re.compile(r"<[^<>]{1,200}>")
_JOIN = re.compile(r"(?<=\w)[-'’‐‑](?=\w)")
_WORD = re.compile(r"[^\W_]+")
_ESCAPED = re.compile(r"\\[nrt\"]")
_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)


def words(text: str) -> list[str]:
    if "<" in text:
        text = _TAG.sub(" ", text)
    if "&" in text:
        text = html.unescape(text)
    if "\\" in text:
        text = _ESCAPED.sub(" ", text)
    return _WORD.findall(_JOIN.sub("", text.lower()))


class WordHashes(dict):
    def __missing__(self, word: str) -> int:
        if len(self) > 500_000:
            self.clear()
        h = self[word] = xxhash.xxh64_intdigest(word)
        return h


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * _MULTIPLIER
    return h ^ (h >> np.uint64(29))


def shingles(h: np.ndarray, size: int) -> np.ndarray:
    """A hash per run of size words."""
    n = len(h) - size + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    out = np.zeros(n, np.uint64)
    with np.errstate(over="ignore"):
        for k in range(size):
            out = _mix(out + h[k : k + n] + np.uint64(k + 1))
    return out


def fingerprints(h: np.ndarray, at: np.ndarray, size: int) -> np.ndarray:
    """SimHash of the words h[i : i + size] for every i in at; features are words and pairs of words."""
    with np.errstate(over="ignore"):
        pair = _mix(h[:-1] * np.uint64(3) + h[1:]) if len(h) > 1 else h[:0]
    total = np.zeros((len(at), 64), np.int32)
    for feature, width in ((h, size), (pair, size - 1)):
        if not len(feature) or width < 1:
            continue
        bits = np.unpackbits(feature.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(np.int8) * 2 - 1
        cum = np.zeros((len(feature) + 1, 64), np.int32)
        np.cumsum(bits, axis=0, dtype=np.int32, out=cum[1:])
        total += cum[np.minimum(at + width, len(feature))] - cum[at]
    packed = np.packbits(total > 0, axis=1, bitorder="little")
    return packed.view("<u8").reshape(-1)


class HammingIndex:
    """All pairs within radius, by RADIUS + 1 lookup tables over blocks of bits."""

    def __init__(self, prints: np.ndarray, radius: int = RADIUS):
        self.prints, self.radius, self.tables = prints, radius, []
        edges = np.linspace(0, 64, radius + 2).astype(int)
        for lo, hi in zip(edges[:-1], edges[1:], strict=True):
            mask = np.uint64((1 << int(hi - lo)) - 1)
            key = (prints >> np.uint64(lo)) & mask
            order = np.argsort(key, kind="stable")
            start = np.searchsorted(key[order], np.arange((1 << int(hi - lo)) + 1, dtype=np.uint64))
            self.tables.append((np.uint64(lo), mask, order, start))

    def pairs(self, queries: np.ndarray, chunk: int = 20_000) -> tuple[np.ndarray, np.ndarray]:
        """(query index, print index) of every pair within radius, possibly repeated."""
        qs, ps = [], []
        for a in range(0, len(queries), chunk):
            q = queries[a : a + chunk]
            for lo, mask, order, start in self.tables:
                key = ((q >> lo) & mask).astype(np.int64)
                n = start[key + 1] - start[key]
                qi = np.repeat(np.arange(len(q)), n)
                if not len(qi):
                    continue
                offset = np.arange(len(qi)) - np.repeat(np.cumsum(n) - n, n)
                pi = order[np.repeat(start[key], n) + offset]
                near = np.bitwise_count(q[qi] ^ self.prints[pi]) <= self.radius
                qs.append(qi[near] + a)
                ps.append(pi[near])
        if not qs:
            return np.empty(0, int), np.empty(0, int)
        return np.concatenate(qs), np.concatenate(ps)


class ItemIndex:
    """Fingerprints and shingles of one block of items."""

    def __init__(self, items: list[tuple[int, str]], size: int | None = None):
        hashes = WordHashes()
        self.ids = np.array([i for i, _ in items], dtype=np.int64)
        streams = [np.array([hashes[w] for w in words(t or "")], dtype=np.uint64) for _, t in items]
        lengths = [len(s) for s in streams if len(s)]
        self.size = size or max(MIN_WINDOW, min(MAX_WINDOW, min(lengths, default=MIN_WINDOW) // 2))
        prints, owner = [], []
        for k, h in enumerate(streams):
            if not len(h):
                continue
            at = np.arange(max(1, len(h) - self.size + 1))
            prints.append(fingerprints(h, at, min(self.size, len(h))))
            owner.append(np.full(len(at), k))
        cat = lambda x, t: np.concatenate(x) if x else np.empty(0, t)
        self.index, self.owner = HammingIndex(cat(prints, np.uint64)), cat(owner, int)
        shs = [shingles(h, min(SHINGLE, len(h))) if len(h) else h for h in streams]
        self.shingles = np.unique(cat(shs, np.uint64))
        self.lengths = [len(h) for h in streams]
        #: Per item the places of its shingles in the order of its words.
        self.places = [np.searchsorted(self.shingles, x) for x in shs]

    def coverage(self, k: int, held: np.ndarray) -> float:
        """The share of item k's words that lie in a shingle of held."""
        covered = np.zeros(self.lengths[k], bool)
        at = np.flatnonzero(np.isin(self.places[k], held))
        for i in range(min(SHINGLE, self.lengths[k])):
            covered[at + i] = True
        return float(covered.mean())


def _scan(index: ItemIndex, texts: list[str], hashes: WordHashes) -> list[tuple[list[int], list[int]]]:
    """Per text: (candidate item positions, item shingles it holds)."""
    streams = [words(t) if t else [] for t in texts]
    n = np.array([len(s) for s in streams])
    h = np.array([hashes[w] for s in streams for w in s], dtype=np.uint64)
    ends = np.cumsum(n)
    starts = ends - n
    out: list[tuple[list[int], list[int]]] = []
    ats, docs, short = [], [], []
    for k, (a, m) in enumerate(zip(starts.tolist(), n.tolist(), strict=True)):
        if m >= index.size:
            w = np.arange(a, a + m - index.size + 1, STRIDE)
            if w[-1] != a + m - index.size:
                w = np.append(w, a + m - index.size)
            ats.append(w)
            docs.append(np.full(len(w), k))
        elif m:
            short.append(k)
    found: list[set[int]] = [set() for _ in texts]
    if ats:
        at, doc = np.concatenate(ats), np.concatenate(docs)
        q, p = index.index.pairs(fingerprints(h, at, index.size))
        for d, i in np.unique(np.stack([doc[q], index.owner[p]]), axis=1).T.tolist() if len(q) else []:
            found[d].add(i)
    for k in short:
        a, m = int(starts[k]), int(n[k])
        q, p = index.index.pairs(fingerprints(h[a : a + m], np.array([0]), m))
        found[k].update(index.owner[p].tolist())
    sh = shingles(h, SHINGLE)
    held: list[list[int]] = [[] for _ in texts]
    if len(sh) and len(index.shingles):
        pos = np.minimum(np.searchsorted(index.shingles, sh), len(index.shingles) - 1)
        hit = np.flatnonzero(index.shingles[pos] == sh)
        owner = np.searchsorted(ends, hit, side="right")
        inside = hit + SHINGLE <= ends[owner]
        for d, s in np.unique(np.stack([owner[inside], pos[hit[inside]]]), axis=1).T.tolist() if inside.any() else []:
            held[d].append(s)
    for k in range(len(texts)):
        out.append((sorted(found[k]), held[k]))
    return out


def find_leaks(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", doc_text: str = "text", item_id: str = "item_id", item_text: str = "text", containment: float = CONTAINMENT) -> DataFrame:
    """(doc_id, item_id, containment, coverage) of every document that carries an item, by weight or by running words."""
    n_blocks = max(1, math.ceil(items.count() / BLOCK))
    part = F.pmod(F.xxhash64(F.col(item_id)), F.lit(n_blocks))
    found = None
    for b in range(n_blocks):
        rows = items.where(part == b).select(item_id, item_text).distinct().collect()
        one = _leaks_of_block(docs, [(r[0], r[1]) for r in rows], doc_id, doc_text, items.schema[item_id].dataType, item_id, containment)
        found = one if found is None else found.unionByName(one)
    return found


def _leaks_of_block(docs: DataFrame, items: list[tuple[int, str]], doc_id: str, doc_text: str, item_type: T.DataType, item_id: str, containment: float) -> DataFrame:
    spark = docs.sparkSession
    index = ItemIndex(items)
    sent = spark.sparkContext.broadcast(index)
    doc_type = docs.schema[doc_id].dataType
    schema = T.StructType([T.StructField("doc", doc_type), T.StructField("h", T.LongType()), T.StructField("items", T.ArrayType(T.IntegerType())), T.StructField("held", T.ArrayType(T.IntegerType()))])

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hashes, mine = WordHashes(), sent.value
        for pdf in batches:
            for a in range(0, len(pdf), 500):
                part = pdf.iloc[a : a + 500]
                texts = [t if isinstance(t, str) else "" for t in part["t"]]
                rows = [(d, h, c, s) for d, h, (c, s) in zip(part["d"].tolist(), part["h"].tolist(), _scan(mine, texts, hashes), strict=True) if s]
                yield pd.DataFrame(rows, columns=["doc", "h", "items", "held"])

    slim = docs.select(F.col(doc_id).alias("d"), F.col(doc_text).alias("t"), F.xxhash64(doc_text).alias("h"))
    seen = checkpointed(slim.mapInPandas(scan, schema))
    n_texts = slim.select("h").distinct().count()
    df_of = {r["s"]: r["n"] for r in seen.select("h", F.explode("held").alias("s")).distinct().groupBy("s").agg(F.count("*").alias("n")).collect()}
    weight = np.array([math.log((1 + n_texts) / (1 + df_of.get(s, 0))) for s in range(len(index.shingles))])
    sent_weight = spark.sparkContext.broadcast(weight)
    pair_schema = T.StructType([T.StructField("doc", doc_type), T.StructField("k", T.IntegerType()), T.StructField("containment", T.DoubleType()), T.StructField("coverage", T.DoubleType())])

    def verify(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        mine, by_weight = sent.value, sent_weight.value
        own = [np.unique(p) for p in mine.places]
        for pdf in batches:
            rows = []
            for d, ks, held in zip(pdf["doc"].tolist(), pdf["items"], pdf["held"], strict=True):
                for k in ks:
                    w, has = by_weight[own[k]], np.isin(own[k], held)
                    share = float(w[has].sum() / w.sum()) if w.sum() > 0 else float(has.mean())
                    covered = mine.coverage(k, held)
                    if share >= containment or covered >= COVERAGE:
                        rows.append((d, k, share, covered))
            yield pd.DataFrame(rows, columns=["doc", "k", "containment", "coverage"])

    names = F.broadcast(spark.createDataFrame([(k, int(i) if isinstance(i, (int, np.integer)) else i) for k, (i, _) in enumerate(items)], T.StructType([T.StructField("k", T.IntegerType()), T.StructField(item_id, item_type)])))
    verified = seen.where(F.size("items") > 0).mapInPandas(verify, pair_schema)
    kept = verified.groupBy("doc", "k").agg(F.max("containment").alias("containment"), F.max("coverage").alias("coverage"))
    return kept.join(names, "k").select(F.col("doc").alias(doc_id), item_id, F.round("containment", 6).alias("containment"), F.round("coverage", 6).alias("coverage"))
