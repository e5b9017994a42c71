"""Variant spellings of organisations' and persons' names.

Nothing is known about the words beforehand but function words and, optionally, a table of nicknames. From the distinct
spellings themselves a *lexicon* is learned:

* common words: words that recur and are mostly not the rarest of their spelling (kinds, legal forms, first names);
  the rarest word of a name is what tells it from others. Words of fewer spellings than COMMON_SHARE are never common, so
  the lexicon has at most mean words per name / COMMON_SHARE entries and may travel with the tasks;
* optional words: common words whose removal often leaves a spelling that exists too (the, inc, a person's "studio").

1. Spellings become words; names written without blanks are parted at common words. The padded q-grams of a name's
   telling words (all its words where none is rare) are its set.
2. MinHash banding over the distinct sets; ``tune_bands`` picks rows and bands from the collision curve
   1 - (1 - s^r)^b for a wanted recall at a wanted similarity. Sets that collide are compared exactly.
3. Spellings with linked sets that share the initial of another word are candidates, verified by soft Monge-Elkan
   similarity: words are matched to their best partner (equal, nickname, typing error, prefix, contraction, initial) and
   weighted by rarity; what is left unmatched on the fuller side counts against, optional words little.
4. Star clustering: spellings are ranked by completeness and use; a spelling that outranks all its free neighbours
   becomes a star's centre, the others join their most similar centre. Rounds repeat until no edge is open; edges are a
   checkpointed table, nothing but counts and the lexicon reaches the driver.

Only distinct spellings take part, whatever the number of rows behind them.

Defined cases: null and blank names are left out; a spelling without a word is a star of its own; exact repeats are
one spelling with a count; ties go to the smaller spelling by bytes; an empty table gives none; other columns are ignored.
"""

from __future__ import annotations

import math
import re
import unicodedata
from dataclasses import dataclass, field
from functools import cached_property, lru_cache

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from marquee.session import checkpointed, large

#: Similarity that links two spellings, q-gram length, and the Jaccard similarity from which two sets are looked at.
LINK, Q, SETS_ALIKE = 0.8, 3, 0.3
#: A common word stands in at least COMMON_LEAST spellings and COMMON_SHARE of them, and is not the rarest of its spelling
#: in NOT_RAREST of them. An optional word was left out OPTIONAL_LEAST times and in OPTIONAL_SHARE of its spellings.
COMMON_LEAST, COMMON_SHARE, NOT_RAREST, OPTIONAL_LEAST, OPTIONAL_SHARE = 4, 0.001, 0.6, 5, 0.05
#: Weight of optional words and stray initials, and of telling words; a common word weighs ln(spellings / its spellings).
LIGHT, TELLING, LONG = 0.3, 6.0, 6

#: Function words.
STOP = frozenset("the of and for a an in y de la".split())
#: First names and their short forms; an optional table (pass {} to do without).
NICKNAMES = {
    "richard": "dick rick rich", "elizabeth": "beth liz betsy lizzie eliza", "leonard": "len lenny leo", "theodore": "ted theo teddy", "katherine": "kate kit kathy katie",
    "antonio": "tony tono toni", "margaret": "maggie peggy meg", "patricia": "pat trish patty tricia", "henry": "hank harry hal", "william": "bill will billy liam", "robert": "bob rob bobby robbie",
    "dorothy": "dot dottie dolly dora", "gabriela": "gaby gabi", "francisca": "fran paca paquita francis", "josephine": "jo josie", "james": "jim jamie jimmy", "edward": "ed eddie ned ted",
    "zachary": "zack zach", "alexander": "alex sandy al xander", "susannah": "sue suzy susie sukey", "charles": "charlie chuck", "john": "jack johnny", "thomas": "tom tommy", "michael": "mike mick",
}


@lru_cache(maxsize=200_000)
def edits(a: str, b: str, most: int = 3) -> int:
    """Damerau-Levenshtein distance (adjacent swaps), cut off above most."""
    if abs(len(a) - len(b)) > most:
        return most + 1
    prev2: list[int] = []
    prev = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row = [i]
        for j, y in enumerate(b, 1):
            d = min(prev[j] + 1, row[j - 1] + 1, prev[j - 1] + (x != y))
            if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                d = min(d, prev2[j - 2] + 1)
            row.append(d)
        if min(row) > most:
            return most + 1
        prev2, prev = prev, row
    return prev[-1]


def _slip(a: str, b: str) -> int | None:
    """Edits between two words if they may be one mistyped: one in a short word, two in a longer one."""
    n = min(len(a), len(b))
    most = 0 if n < 4 else 1 if n < 7 else 2
    d = edits(a, b)
    if d <= most:
        return d
    d = edits(a.rstrip("s"), b.rstrip("s"))
    return d + 1 if n >= 7 and d <= most else None


def plain_words(raw: str, unglue=None) -> list[str]:
    """The words of a spelling in lower case without marks; capitals that stand for words become single letters."""
    s = "".join(c for c in unicodedata.normalize("NFKD", raw.replace("\xa0", " ").replace("_", " ")) if not unicodedata.combining(c)).strip()
    s = re.sub(r"[\"“”][^\"“”]*[\"“”]", " ", s)
    if lead := re.match(r"^([A-Z]{2,5})\s+-\s+(.+)$", s, re.S):
        s = ". ".join(lead[1]) + ". " + lead[2]
    if not re.search(r"\s", s):
        s = re.sub(r"(?<=[a-z])(?=[A-Z])|(?<=[A-Z])(?=[A-Z][a-z])", " ", s)
    if unglue and re.fullmatch(r"[A-Za-z']{12,}", s):
        s = unglue(s.lower())
    letters = [c for c in s if c.isalpha()]
    loud = sum(c.isupper() for c in letters) > 0.8 * len(letters)
    out = []
    for t in re.findall(r"[^\W_]+(?:'[^\W_]+)?\.?", re.sub(r"(?<=[A-Za-z])\.(?=[A-Za-z]\b)", ". ", s)):
        w = re.sub(r"'s$", "", t.rstrip(".").lower()).replace("'", "")
        if not loud and 2 <= len(w) <= 4 and t.rstrip(".").isupper() and w.isalpha():
            out += list(w)
        elif w:
            out.append(w)
    return out


@dataclass
class Lexicon:
    """What the distinct spellings say about words; small enough to travel with the tasks."""

    common: dict[str, int] = field(default_factory=dict)
    optional: frozenset[str] = STOP
    spellings: int = 1
    nicknames: dict[str, str] = field(default_factory=lambda: NICKNAMES)
    _words: dict[tuple[str, str], float] = field(default_factory=dict, repr=False, compare=False)
    _slips: dict[str, bool] = field(default_factory=dict, repr=False, compare=False)

    @cached_property
    def given(self) -> dict[str, set[str]]:
        out: dict[str, set[str]] = {}
        for name, short in self.nicknames.items():
            for w in (name, *short.split()):
                out.setdefault(w, set()).add(name)
        return out

    @cached_property
    def _glue(self) -> list[str]:
        return sorted((w for w in self.common if len(w) > 2 or w in STOP), key=lambda w: (-len(w), w))

    @cached_property
    def _long_common(self) -> list[str]:
        return [w for w in self.common if len(w) >= 4]

    def _part(self, s: str) -> str:
        """A name written without blanks, parted at common words on either side and at a middle "and"."""
        left, right = [], []
        while len(s) > 5 and (w := next((g for g in self._glue if s.startswith(g) and len(s) - len(g) >= 5), None)):
            left.append(w)
            s = s[len(w) :]
        while len(s) > 5 and (w := next((g for g in self._glue if len(g) > 3 and s.endswith(g) and len(s) - len(g) >= 5), None)):
            right.insert(0, w)
            s = s[: -len(w)]
        return " ".join([*left, re.sub(r"^([a-z]{6,}?)and([a-z]{6,})$", r"\1 and \2", s), *right])

    def words(self, raw: str) -> list[str]:
        return plain_words(raw, self._part)

    def telling(self, words: list[str]) -> list[str]:
        """The words that tell a name from others, in order of spelling."""
        rare = [w for w in words if w not in self.common]
        return sorted([w for w in rare if len(w) >= LONG and not self._mistyped(w)] or [w for w in rare if len(w) > 1] or words)

    def _mistyped(self, w: str) -> bool:
        """w may be a common word mistyped."""
        if w not in self._slips:
            if len(self._slips) > 500_000:
                self._slips.clear()
            self._slips[w] = any(abs(len(w) - len(c)) <= 2 and _slip(w, c) is not None for c in self._long_common)
        return self._slips[w]

    def weight(self, w: str) -> float:
        if len(w) == 1 or w in self.optional:
            return LIGHT
        return min(TELLING, math.log(max(self.spellings, 2) / self.common[w])) if w in self.common else TELLING

    def initials(self, words: list[str], telling: list[str]) -> list[str]:
        """Initials of the other words, those of nicknames' full names too."""
        other = [w for w in words if w not in telling and w not in self.optional]
        return sorted({w[0] for w in other} | {g[0] for w in other for g in self.given.get(w, ())}) or [""]

    def quality(self, words: list[str]) -> int:
        """Less for every initial and short uncommon word."""
        return -sum(len(w) == 1 or (w not in self.common and len(w) < LONG) for w in words)

    def word_similarity(self, a: str, b: str) -> float:
        if (a, b) not in self._words:
            if len(self._words) > 500_000:
                self._words.clear()
            self._words[a, b] = self._compare(*sorted((a, b), key=lambda w: (len(w), w)))
        return self._words[a, b]

    def _compare(self, a: str, b: str) -> float:
        if a == b:
            return 1.0
        if len(a) == 1:
            stray = len(b) == 1 or (b in self.optional and len(b) <= 3)
            return 0.75 if not stray and (a == b[0] or any(g[0] == a for g in self.given.get(b, ()))) else 0.0
        if self.given.get(a, set()) & self.given.get(b, set()):
            return 0.95
        if (d := _slip(a, b)) is not None:
            return 1 - 0.04 * d
        if b in self.common and a[0] == b[0] and len(a) < len(b):
            if b.startswith(a):
                return 0.9
            rest = iter(b)
            if len(a) <= 0.75 * len(b) and all(c in rest for c in a):
                return 0.85
            if len(a) >= 3 and len(a) <= 0.7 * len(b) and edits(a, b[: len(a)]) <= 1:
                return 0.8
        return 0.0

    def similarity(self, a: list[str], b: list[str]) -> float:
        """Soft Monge-Elkan of two names' words: best partners first, weights of the lighter partner (a slip is no
        rare word), of the full word where one is an initial; what both leave over contradicts."""
        pairs = sorted(((s, -abs(i - j), i, j) for i, x in enumerate(a) for j, y in enumerate(b) if (s := self.word_similarity(x, y)) > 0), reverse=True)
        mine, theirs, got, base = set(), set(), 0.0, 0.0
        for s, _, i, j in pairs:
            if i in mine or j in theirs:
                continue
            mine.add(i)
            theirs.add(j)
            w = (max if 1 in (len(a[i]), len(b[j])) else min)(self.weight(a[i]), self.weight(b[j]))
            got, base = got + w * s, base + w
        if not base:
            return 0.0
        over = [[w for i, w in enumerate(words) if i not in used] for words, used in ((a, mine), (b, theirs))]
        s = got / (base + max(sum(map(self.weight, o)) for o in over))
        if all(any(len(w) > 1 and w not in self.optional for w in o) for o in over):
            s *= 0.9
        return s * 0.9 if all(any(len(w) == 1 for w in o) for o in over) else s


def learn(names: DataFrame, nicknames: dict[str, str] | None = None) -> Lexicon:
    """The lexicon of the distinct spellings in names (name)."""
    split = F.pandas_udf(lambda s: pd.Series([plain_words(v) for v in s]), T.ArrayType(T.StringType()))
    words = checkpointed(names.select("name", split("name").alias("w")))
    n = words.count()
    each = words.select("name", F.explode(F.array_distinct("w")).alias("w"))
    df = each.groupBy("w").agg(F.count("*").alias("df"))
    counted = each.join(df, "w")
    low = counted.where(F.length("w") >= 4).groupBy("name").agg(F.min("df").alias("low"))
    least = max(COMMON_LEAST, COMMON_SHARE * n)
    judged = counted.where(F.col("df") >= least).join(low, "name").groupBy("w").agg(F.first("df").alias("df"), F.count_if(F.col("df") > F.col("low")).alias("other"))
    common = {r["w"]: r["df"] for r in judged.where(F.col("other") >= NOT_RAREST * F.col("df")).select("w", "df").collect()}
    lexicon = Lexicon(common, STOP, n, NICKNAMES if nicknames is None else nicknames)
    parted = checkpointed(names.select("name", F.pandas_udf(lambda s: pd.Series([lexicon.words(v) for v in s]), T.ArrayType(T.StringType()))("name").alias("w")))
    optional = set(STOP)
    for turn in range(2):
        # a word is left out where the other words of its spelling, without what is optional so far, are a spelling too
        dropped = [w for w in optional]
        kept = F.array_sort(F.filter("w", lambda x: ~x.isin(dropped) & ((F.length(x) > 1) if turn else F.lit(True))))
        bags = parted.select(kept.alias("s")).where(F.size("s") > 0)
        known = bags.select(F.xxhash64("s").alias("h")).distinct()
        at = bags.select("s", F.posexplode("s").alias("i", "w")).where((F.array_position("s", F.col("w")) == F.col("i") + 1) & F.col("w").isin(list(common)) & (F.length("w") > 1))
        rest = F.concat(F.slice("s", F.lit(1), F.col("i")), F.slice("s", F.col("i") + 2, F.size("s")))
        out = at.select("w", F.when(F.size("s") > 2, F.xxhash64(rest)).alias("h")).join(known.withColumn("there", F.lit(1)), "h", "left")
        share = out.groupBy("w").agg(F.count("*").alias("has"), F.count("there").alias("gone")).where((F.col("gone") >= OPTIONAL_LEAST) & (F.col("gone") >= OPTIONAL_SHARE * F.col("has")))
        optional |= {r["w"] for r in share.collect()}
    return Lexicon(common, frozenset(optional), n, lexicon.nicknames)


def tune_bands(similarity_at: float, recall: float, rows: tuple[int, ...] = (2, 3, 4, 5), most: int = 64) -> tuple[int, int]:
    """(rows, bands) with 1 - (1 - s^r)^b >= recall at s, the most selective that needs at most ``most`` hashes."""
    fits = [(r, b) for r in rows for b in range(1, most // r + 1) if 1 - (1 - similarity_at**r) ** b >= recall]
    if not fits:
        return 1, most
    best_rows = max(r for r, _ in fits)
    return best_rows, min(b for r, b in fits if r == best_rows)


def qgrams(token: str, q: int = Q) -> list[str]:
    padded = "#" * (q - 1) + token + "$" * (q - 1)
    return [padded[i : i + q] for i in range(len(padded) - q + 1)]


def band_keys(words: str, rows: int, bands: int) -> list[int]:
    h = np.array([xxhash.xxh64_intdigest(g) for g in gram_set(words)], dtype=np.uint64)
    seeds = np.array([xxhash.xxh64_intdigest(str(i), seed=7) | 1 for i in range(rows * bands)], dtype=np.uint64)
    with np.errstate(over="ignore"):
        mixed = h[:, None] * seeds[None, :]
        mixed ^= mixed >> np.uint64(32)
        low = (mixed * np.uint64(0x9E3779B97F4A7C15)).min(axis=0)
    return [xxhash.xxh64_intdigest(low[b * rows : (b + 1) * rows].tobytes(), seed=b) - (1 << 63) for b in range(bands)]


def gram_set(words: str) -> set[str]:
    """The padded q-grams of words separated by blanks."""
    return {g for w in words.split(" ") for g in qgrams(w)}


def parsed_names(names: DataFrame, lexicon: Lexicon) -> DataFrame:
    """names with words, telling (one string), initials and quality (fewer abbreviations first)."""
    schema = T.StructType([T.StructField("words", T.ArrayType(T.StringType())), T.StructField("telling", T.StringType()), T.StructField("initials", T.ArrayType(T.StringType())), T.StructField("quality", T.IntegerType())])

    @F.pandas_udf(schema)
    def run(s: pd.Series) -> pd.DataFrame:
        rows = []
        for v in s:
            w = lexicon.words(v)
            t = lexicon.telling(w)
            rows.append((w, " ".join(t), lexicon.initials(w, t), lexicon.quality(w)))
        return pd.DataFrame(rows, columns=["words", "telling", "initials", "quality"])

    return names.withColumn("p", run("name")).select("*", "p.*").drop("p")


def set_links(sets: DataFrame, rows: int, bands: int) -> DataFrame:
    """(t, u), both ways and with itself: distinct telling words whose q-gram sets are alike, found through shared bands."""

    @F.pandas_udf(T.ArrayType(T.LongType()))
    def keys(s: pd.Series) -> pd.Series:
        return pd.Series([band_keys(t, rows, bands) for t in s])

    @F.pandas_udf(T.BooleanType())
    def alike(a: pd.Series, b: pd.Series) -> pd.Series:
        grams = {t: gram_set(t) for t in {*a, *b}}
        return pd.Series([len(grams[x] & grams[y]) >= SETS_ALIKE * len(grams[x] | grams[y]) for x, y in zip(a, b, strict=True)])

    banded = checkpointed(sets.select("t", F.explode(keys("t")).alias("k")))
    pairs = banded.alias("a").join(banded.alias("b"), "k").where("a.t < b.t").select(F.col("a.t").alias("t"), F.col("b.t").alias("u")).distinct()
    close = pairs.where(alike("t", "u"))
    both = close.select(F.explode(F.array(F.struct("t", "u"), F.struct(F.col("u").alias("t"), F.col("t").alias("u")))).alias("p")).select("p.t", "p.u")
    return both.unionByName(sets.select("t", F.col("t").alias("u")))


def verified_edges(names: DataFrame, lexicon: Lexicon, recall: float = 0.97) -> DataFrame:
    """(a, b, sim), a < b: spellings that name the same; names as parsed_names gives them."""
    rows, bands = tune_bands(0.36, recall)
    there = names.where("telling != ''")
    links = set_links(there.select(F.col("telling").alias("t")).distinct(), rows, bands)
    keyed = there.select("name", F.col("telling").alias("t"), F.explode("initials").alias("i"))
    mine = keyed.join(links, "t").select("u", "i", F.col("name").alias("a"))
    pairs = mine.join(keyed.select(F.col("t").alias("u"), "i", F.col("name").alias("b")), ["u", "i"]).where("a < b").select("a", "b").distinct()

    @F.pandas_udf(T.DoubleType())
    def sim(a: pd.Series, b: pd.Series) -> pd.Series:
        words = {v: lexicon.words(v) for v in {*a, *b}}
        return pd.Series([lexicon.similarity(words[x], words[y]) for x, y in zip(a, b, strict=True)])

    return pairs.withColumn("sim", sim("a", "b")).where(F.col("sim") >= LINK)


def stars(names: DataFrame, edges: DataFrame) -> DataFrame:
    """(name, centre) by rounds of star clustering over checkpointed edges. The best of what is free becomes a centre in
    every round, so the rounds end."""
    rank = F.struct("quality", "n", F.hex(F.encode("name", "UTF-8")).alias("x"))
    ranked = checkpointed(names.select("name", rank.alias("rank")))
    ends = F.array(F.struct("a", "b", "sim"), F.struct(F.col("b").alias("a"), F.col("a").alias("b"), "sim"))
    both = edges.select(F.explode(ends).alias("e")).select("e.*")
    both = both.join(large(ranked.select(F.col("name").alias("a"), F.col("rank").alias("ra"))), "a").join(large(ranked.select(F.col("name").alias("b"), F.col("rank").alias("rb"))), "b")
    open_edges = checkpointed(both)
    out = ranked.select("name", F.col("name").alias("centre")).where("false")
    while not open_edges.isEmpty():
        # a free spelling that no free neighbour outranks is a centre; its neighbours join the most similar centre
        top = open_edges.groupBy("a").agg(F.max("rb").alias("top"), F.first("ra").alias("ra")).where(F.col("ra") > F.col("top")).select(F.col("a").alias("c"))
        joins = open_edges.join(large(top), F.col("b") == F.col("c"), "left_semi").groupBy("a").agg(F.max_by("b", F.struct("sim", "rb")).alias("centre")).withColumnRenamed("a", "name")
        done = checkpointed(joins.unionByName(top.select(F.col("c").alias("name"), F.col("c").alias("centre"))))
        out = out.unionByName(done)
        gone = done.select(F.col("name").alias("g"))
        open_edges = checkpointed(open_edges.join(large(gone), F.col("a") == F.col("g"), "left_anti").join(large(gone), F.col("b") == F.col("g"), "left_anti"))
    return ranked.select("name").join(large(out), "name", "left").withColumn("centre", F.coalesce("centre", "name"))


def classes(spellings: DataFrame, col: str, nicknames: dict[str, str] | None = None) -> DataFrame:
    """(name, n, centre): every distinct spelling of col, its uses and its star."""
    counted = spellings.where(F.col(col).isNotNull() & (F.trim(F.regexp_replace(col, "\\x{A0}", " ")) != "")).groupBy(F.col(col).alias("name")).agg(F.count("*").alias("n"))
    counted = checkpointed(counted)
    lexicon = learn(counted, nicknames)
    names = checkpointed(parsed_names(counted, lexicon))
    return stars(names, verified_edges(names, lexicon)).join(names.select("name", "n"), "name")


def pairs_of(classes_df: DataFrame) -> DataFrame:
    """(name_a, name_b) of every two spellings of one star, smaller by bytes first."""
    key = F.hex(F.encode("name", "UTF-8"))
    a = classes_df.select("centre", F.col("name").alias("name_a"), key.alias("ka"))
    b = classes_df.select("centre", F.col("name").alias("name_b"), key.alias("kb"))
    return a.join(b, "centre").where("ka < kb").select("name_a", "name_b")
