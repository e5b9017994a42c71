"""Postal addresses of one place written differently.

1. Addresses (maps of any shape), venues and towns are parsed into number, street, kind, direction, town, postcode and
   venue; units and floors are dropped. A missing town is filled from the postcode's usual town (at most 100 000 five
   digit codes, so that table may be broadcast).
2. Equal parses become one *form*; only forms are compared, however many records stand behind one.
3. Blocking: forms meet on (number, street sound, town sound), (number, town) or (number, venue); forms without a town
   ask for (number, street sound), forms without an address for (venue, town). Pairs are formed over forms, not records,
   and a form that has all its parts never asks for more than its own building's surroundings.
4. Comparison vectors have agreement levels per component, a missing value being a level of its own. Their counts (at
   most 972 patterns) give m and u probabilities, those of the missing levels too, by expectation-maximisation (Fellegi
   and Sunter; Winkler), apart for pairs with an address on both sides and pairs without.
5. Pairs whose posterior exceeds ``POSTERIOR`` are links. A form that lacks the address or the place takes over the
   links of its most probable whole form; record pairs are links expanded by the forms' members.

An absent direction is a value, not a gap: "12 Main St" and "12 N Main St" are two buildings.

Defined cases: null maps, blank and placeholder values count as missing; a record with neither (number, street) nor
(venue, town) is linked to nothing; repeated rows are one record; an empty table gives none; other columns are ignored.
"""

from __future__ import annotations

import math
import re
import unicodedata
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from marquee.llm.names import edits, stars
from marquee.session import checkpointed, large

#: Words of street kinds, directions, ordinals and place prefixes with their short forms.
STREET_KINDS = {
    "street": "street st str", "road": "road rd", "avenue": "avenue ave av", "boulevard": "boulevard blvd boul bvd", "lane": "lane ln la", "court": "court ct crt",
    "drive": "drive dr drv", "square": "square sq", "highway": "highway hwy hgwy", "place": "place pl", "terrace": "terrace ter terr", "circle": "circle cir", "parkway": "parkway pkwy", "way": "way", "trail": "trail trl", "alley": "alley aly",
}
KIND_OF = {w: k for k, ws in STREET_KINDS.items() for w in ws.split()}
DIRECTION_OF = {"n": "n", "no": "n", "north": "n", "s": "s", "so": "s", "south": "s", "e": "e", "east": "e", "w": "w", "west": "w"}
ORDINALS = {"1st": "first", "2nd": "second", "3rd": "third", "4th": "fourth", "5th": "fifth", "6th": "sixth", "7th": "seventh", "8th": "eighth", "9th": "ninth"}
PREFIXES = {"mt": "mount", "ft": "fort", "st": "saint", "pt": "port", "n": "new", "bch": "beach", "hbr": "harbor", "spgs": "springs"}
STATES = {"de", "del", "delaware"}
VENUE_NOUNS = set("hall chapel cinema pavilion pavillion gallery conservatory consv armory playhouse amphitheater amphitheatre barn schoolhouse house box library lib center ctr auditorium aud park pk lodge firehouse school hl theatre theater hse".split())
STREET_KEYS = ("street", "streetAddress", "address1", "full", "text")
CITY_KEYS = ("city", "locality", "addressLocality")
ZIP_KEYS = ("postalCode", "zip")
_UNIT = re.compile(r"(?:^|[,;\n ])\s*(?:(?:suite|ste|unit|apt|apartment|room|rm|floor|fl)\b\.?\s*#?\s*\w+|#\s*\w+|\d+(?:st|nd|rd|th)\s+(?:floor|fl)\b\.?)", re.I)
_ZIP = re.compile(r"\b(\d{5})(?:-(\d{4}))?\b")
_NOTHING = re.compile(r"^[\s\-?.*]*$|^(?:n/?a|none|tb[acd]|unknown|see website|various locations|venue to be confirmed)$", re.I)


@dataclass(frozen=True)
class Place:
    number: str | None = None
    street: str | None = None
    kind: str | None = None
    direction: str | None = None
    town: str | None = None
    zip5: str | None = None
    venue: str | None = None


def _fold(s: str) -> str:
    return "".join(c for c in unicodedata.normalize("NFKD", s) if not unicodedata.combining(c)).lower()


@lru_cache(maxsize=50_000)
def town_of(raw: str | None) -> str | None:
    if not raw or _NOTHING.match(raw.strip()):
        return None
    words = re.findall(r"[a-z]+", re.sub(r"\([^)]*\)", " ", _fold(raw)))
    while len(words) > 1 and words[-1] in STATES:
        words = words[:-1]
    words = [PREFIXES.get(w, w) if (i < len(words) - 1 or w == "bch") else w for i, w in enumerate(words)]
    return " ".join(words) or None


@lru_cache(maxsize=50_000)
def venue_of(raw: str | None) -> str | None:
    if not raw or _NOTHING.match(raw.strip()):
        return None
    words = re.findall(r"[a-z]+", _fold(raw))
    words = [w for w in words if w != "the"]
    return " ".join(words) or None


def _street(tokens: list[str]) -> tuple[str | None, str | None, str | None, str | None]:
    """(number, name, kind, direction) of tokens that hold one street."""
    number = None
    kinds = [i for i, t in enumerate(tokens) if t in KIND_OF and i and not (t == "st" and i + 1 < len(tokens) and tokens[i + 1] not in DIRECTION_OF and not tokens[i + 1].isdigit() and any(x in KIND_OF for x in tokens[i + 1 :]))]
    k = kinds[-1] if kinds else None
    kind = KIND_OF[tokens[k]] if k is not None else None
    after = tokens[k + 1 :] if k is not None else []
    before = tokens[:k] if k is not None else list(tokens)
    if k is None and before and re.fullmatch(r"\d{1,5}[a-z]?", before[-1]) and len(before) > 1:
        before = [before[-1], *before[:-1]]  # "Walnut East 61": the number stands last
    direction = next((DIRECTION_OF[t] for t in after if t in DIRECTION_OF), None)
    digits_before = [i for i, t in enumerate(before) if re.fullmatch(r"\d{1,5}[a-z]?", t)]
    digits_after = [t for t in after if re.fullmatch(r"\d{1,5}[a-z]?", t)]
    if digits_before:
        number = before[digits_before[-1]]
        before = before[digits_before[-1] + 1 :]
    elif digits_after:
        number = digits_after[0]
    elif k is None:
        return None, None, None, None
    if digits_before is not None and before and before[0] in DIRECTION_OF and len(before) > 1:
        direction = direction or DIRECTION_OF[before[0]]
        before = before[1:]
    if k is None and before and before[-1] in DIRECTION_OF and len(before) > 1:
        direction = direction or DIRECTION_OF[before[-1]]
        before = before[:-1]
    nouns = [i for i, t in enumerate(before[:-1]) if t in VENUE_NOUNS]
    if nouns:
        before = before[nouns[-1] + 1 :]
        if before and before[0] in DIRECTION_OF and len(before) > 1:
            direction = direction or DIRECTION_OF[before[0]]
            before = before[1:]
    name = " ".join(ORDINALS.get(t, PREFIXES.get(t, t) if t in ("mt", "ft", "st") else t) for t in before)
    return number, name or None, kind, direction


def parse_place(address: dict | None, venue: str | None, city: str | None) -> Place:
    address = {k: v for k, v in (address or {}).items() if isinstance(v, str) and not _NOTHING.match(v.strip())}
    town = town_of(next((address[k] for k in CITY_KEYS if k in address), None)) or town_of(city)
    zip_text = next((address[k] for k in ZIP_KEYS if k in address), "")
    z = _ZIP.search(zip_text)
    zip5 = z[1] if z else None
    v = venue_of(venue)
    text = next((address[k] for k in STREET_KEYS if k in address), None)
    number = street = kind = direction = None
    if text:
        s = _fold(text)
        for m in _ZIP.finditer(s):
            tail = s[m.end() :].strip(" .,;\n")
            if not tail or m.start() > len(s) // 2:
                zip5 = zip5 or m[1]
                s = s[: m.start()] + " " + s[m.end() :]
                break
        s = _UNIT.sub(" , ", s)
        # "No. 75, Fort Pell Boulevard" has a number sign, "Fort Pell Boulevard No. 75" lies north
        s = re.sub(r"(^|[,;\n]\s*)no\.?\s*(\d+)\s*,?", r"\1 \2 ", s)
        s = re.sub(r"\([^)]*\)", " ", s)
        segments = []
        for seg in re.split(r"[,;\n]", s):
            words = [w for w in re.findall(r"[a-z0-9']+", seg) if w not in STATES or seg.strip(" .") not in STATES]
            words = [w for i, w in enumerate(words) if not (w in STATES and i == len(words) - 1)]
            if words:
                segments.append(words)
        # a number alone before a comma belongs to the next segment, one behind to the previous
        merged: list[list[str]] = []
        for seg in segments:
            if merged and len(merged[-1]) == 1 and merged[-1][0].isdigit():
                merged[-1] = merged[-1] + seg
            elif merged and len(seg) == 1 and seg[0].isdigit() and not any(w.isdigit() for w in merged[-1]):
                merged[-1] = merged[-1] + seg
            else:
                merged.append(seg)
        scored = [(any(w in KIND_OF for w in seg[1:]) + 2 * any(w.isdigit() for w in seg), -i) for i, seg in enumerate(merged)]
        if merged and max(scored)[0] > 0:
            k = -max(scored)[1]
            known = (town or "").split()
            seg = merged[k]
            if known and len(seg) > len(known) + 1 and (town_of(" ".join(seg[-len(known) :])) == town):
                seg = seg[: -len(known)]
            elif known and len(seg) > len(known) + 1 and town_of(" ".join(seg[: len(known)])) == town:
                seg = seg[len(known) :]
            number, street, kind, direction = _street(seg)
            rest = merged[k + 1 :] + merged[:k]
        else:
            rest = merged
        for seg in rest:
            name = " ".join(seg)
            if any(w in VENUE_NOUNS for w in seg):
                v = v or venue_of(name)
            elif town is None and not any(w.isdigit() for w in seg):
                town = town_of(name)
    return Place(number, street, kind, direction, town, zip5, v)


FIELDS = ("number", "street", "kind", "direction", "town", "zip5", "venue")
#: Components and their levels; "missing" is a level.
LEVELS = {
    "number": ("agree", "missing", "differ"),
    "street": ("agree", "typo", "missing", "differ"),
    "kind": ("agree", "missing", "differ"),
    "direction": ("agree", "missing", "differ"),
    "area": ("agree", "missing", "differ"),
    "venue": ("agree", "missing", "differ"),
}
POSTERIOR, EM_ROUNDS = 0.5, 80
#: The starting values count as this many pairs, so that a handful of pairs cannot bend the estimates.
PRIOR_PAIRS = 20.0
#: What makes a building: pairs that agree in all of these are one whatever their venues are called.
DEFINING = ("number", "street", "kind", "direction", "area")
#: Where the starting values put agreement: of present values, among matches (in what defines a building, in the rest)
#: and among non-matches (in what most blocks share, in the rest).
START_DEFINING, START_M, START_BLOCKED, START_U = 0.999, 0.95, 0.9, 0.25
BLOCKED = ("number", "area")


def _near(a: str, b: str) -> bool:
    n = min(len(a), len(b))
    return a == b or (n >= 4 and edits(a, b) <= (1 if n < 6 else 2))


_VENUE_WORDS = {"gal": "gallery", "pav": "pavilion", "cin": "cinema", "amph": "amphitheater", "chap": "chapel", "arm": "armory", "plhse": "playhouse", "lib": "library", "ctr": "center", "consv": "conservatory", "aud": "auditorium", "pk": "park", "hl": "hall", "hse": "house", "comm": "community", "amphitheatre": "amphitheater", "pavillion": "pavilion", "theatre": "theater"}


@lru_cache(maxsize=100_000)
def venue_key(venue: str | None, town: str | None) -> str | None:
    """A venue without its article, short forms and a trailing "of <town>"."""
    if not venue:
        return None
    words = [_VENUE_WORDS.get(w, w) for w in venue.split()]
    if "of" in words[1:]:
        k = len(words) - 1 - words[::-1].index("of")
        if town and _near(" ".join(words[k + 1 :]), town):
            words = words[:k]
    return "".join(words).replace("schoolhouse", "schoolhse")


@lru_cache(maxsize=100_000)
def venue_name(venue: str, town: str | None) -> str:
    """A venue's own name; one without is named by its kind."""
    words = [_VENUE_WORDS.get(w, w) for w in venue.split()]
    if "of" in words[1:]:
        words = words[: len(words) - 1 - words[::-1].index("of")]
    own = [w for w in words if w not in VENUE_NOUNS and w not in ("arts", "black", "community", "opera", "town", "civic", "old", "riverside", "grange", "masonic")]
    return own[0] if own else venue_key(venue, town) or ""


@lru_cache(maxsize=100_000)
def sound(word: str | None) -> str | None:
    """Street sound: the first letter and the sorted set of consonant classes, so that swaps, doublings and most
    substitutions of vowels keep it."""
    if not word:
        return None
    classes = {c: d for d, cs in {"1": "bpfv", "2": "cgjkqsxz", "3": "dt", "4": "l", "5": "mn", "6": "r"}.items() for c in cs}
    return word[0] + "".join(sorted({classes[c] for c in word if c in classes}))


def compare(a: tuple, b: tuple) -> str:
    """The comparison vector of two forms (tuples in the order of FIELDS) as level numbers."""
    an, ast, ak, ad, at, az, av = a
    bn, bst, bk, bd, bt, bz, bv = b
    number = 1 if not an or not bn else 0 if an == bn else 2
    if not ast or not bst:
        street, direction, kind = 2, 1, 1
    else:
        street = 0 if ast == bst else 1 if _near(ast, bst) else 3
        direction = 0 if ad == bd else 2
        kind = 1 if not ak or not bk else 0 if ak == bk else 2
    same_town = bool(at and bt) and _near(at, bt)
    if at and bt:
        area = 0 if same_town or (az and az == bz) else 2
    elif az and bz:
        area = 0 if az == bz else 2
    else:
        area = 1
    va, vb = venue_key(av, at or bt), venue_key(bv, bt or at)
    venue = 1 if not va or not vb else 0 if _near(va, vb) else 2
    return "".join(map(str, (number, street, kind, direction, area, venue)))


@dataclass
class Weights:
    """m and u probabilities per component and level, and the share of matches among candidates."""

    m: list[np.ndarray]
    u: list[np.ndarray]
    share: float

    def posterior(self, pattern: str) -> float:
        odds = math.log(self.share / (1 - self.share))
        for k, level in enumerate(map(int, pattern)):
            odds += math.log(self.m[k][level] / self.u[k][level])
        return 1 / (1 + math.exp(-max(-50.0, min(50.0, odds))))


def expectation_maximisation(counts: dict[str, int], rounds: int = EM_ROUNDS) -> Weights:
    """Latent-class EM over pattern counts. Every level's m and u are estimated, the missing level's too."""
    patterns = sorted(counts)
    n = np.array([counts[p] for p in patterns], dtype=float)
    x = np.array([[int(c) for c in p] for p in patterns]).reshape(len(patterns), len(LEVELS))
    m, u = [], []
    for k, (name, levels) in enumerate(LEVELS.items()):
        gap = min(max(float(n[x[:, k] == levels.index("missing")].sum() / max(n.sum(), 1)), 0.01), 0.98)
        good = [i for i, lv in enumerate(levels) if lv in ("agree", "typo")]
        for target, lean in ((m, START_DEFINING if name in DEFINING else START_M), (u, START_BLOCKED if name in BLOCKED else START_U)):
            p = np.full(len(levels), (1 - gap) * (1 - lean))
            p[good], p[levels.index("missing")] = (1 - gap) * lean / len(good), gap
            target.append(p)
    w = Weights(m, u, 0.5)
    start = [[p.copy() for p in m], [p.copy() for p in u]]
    for _ in range(rounds if patterns else 0):
        post = np.array([w.posterior(p) for p in patterns])
        for target, weight, prior in ((w.m, n * post, start[0]), (w.u, n * (1 - post), start[1])):
            for k in range(len(LEVELS)):
                p = np.array([weight[x[:, k] == lv].sum() for lv in range(len(prior[k]))]) + PRIOR_PAIRS * prior[k]
                target[k] = p / p.sum()
        w.share = float(min(max(((n * post).sum() + PRIOR_PAIRS / 2) / (n.sum() + PRIOR_PAIRS), 0.001), 0.999))
    return w


def has_address(pattern: str) -> bool:
    """Both sides of the pair have a number and a street."""
    return pattern[0] != "1" and pattern[1] != "2"


def posteriors(counts: dict[str, int]) -> dict[str, float]:
    """The posterior of every pattern. Pairs with an address on both sides and pairs without are estimated apart: in one
    mixture the two classes that EM finds would be those with and without an address."""
    out = {}
    for whole in (True, False):
        mine = {p: c for p, c in counts.items() if has_address(p) == whole}
        w = expectation_maximisation(mine)
        out |= {p: w.posterior(p) for p in mine}
    return {p: 1.0 if p[: len(DEFINING)] == "0" * len(DEFINING) else q for p, q in out.items()}


def parsed(df: DataFrame, id_col: str, address_col: str, venue_col: str, city_col: str) -> DataFrame:
    """(rid, number ... venue) of every record."""
    schema = T.StructType([T.StructField(f, T.StringType()) for f in FIELDS])

    @F.pandas_udf(schema)
    def run(address: pd.Series, venue: pd.Series, city: pd.Series) -> pd.DataFrame:
        text = lambda v: v if isinstance(v, str) else None
        rows = [parse_place(dict(a) if a is not None and not isinstance(a, float) else None, text(v), text(c)) for a, v, c in zip(address, venue, city, strict=True)]
        return pd.DataFrame([[getattr(p, f) for f in FIELDS] for p in rows], columns=list(FIELDS))

    # a map of repeated keys or null values is no trouble: entries with null values are dropped first
    address = F.map_filter(F.col(address_col), lambda k, v: v.isNotNull())
    slim = df.where(F.col(id_col).isNotNull()).select(F.col(id_col).alias("rid"), run(address, F.col(venue_col), F.col(city_col)).alias("p"))
    rows = slim.select("rid", "p.*").dropDuplicates(["rid"])
    usual = rows.where("zip5 is not null and town is not null").groupBy("zip5", "town").count().groupBy("zip5").agg(F.max_by("town", F.struct("count", "town")).alias("usual"))
    rows = rows.join(F.broadcast(usual), "zip5", "left")
    typo = F.levenshtein("town", "usual") <= 2
    town = F.when(F.col("town").isNull() | typo, F.coalesce("usual", "town")).otherwise(F.col("town"))
    rows = rows.withColumn("town", town)
    run_on = F.col("street").contains(" ") & F.endswith(F.col("street"), F.concat(F.lit(" "), F.col("town")))
    street = F.when(run_on, F.expr("substring(street, 1, length(street) - length(town) - 1)")).otherwise(F.col("street"))
    return rows.select("rid", *[street.alias("street") if f == "street" else F.col(f) for f in FIELDS])


def forms(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(forms with their number fid, members (rid, fid)). fid is a 64-bit hash of the parse, stable under lost executors."""
    parts = [F.coalesce(F.col(f), F.lit("")) for f in FIELDS]
    usable = (F.col("number").isNotNull() & F.col("street").isNotNull()) | (F.col("venue").isNotNull() & F.col("town").isNotNull())
    keyed = rows.where(usable).withColumn("fid", F.xxhash64(F.concat_ws("|", *parts)))
    return keyed.dropDuplicates(["fid"]).select("fid", *FIELDS), keyed.select("rid", "fid")


def block_keys(number: str | None, street: str | None, town: str | None, venue: str | None) -> tuple[list[str], list[str], list[str]]:
    """(shared, needed, offered) keys of a form. Forms meet on an equal shared key, or where one needs what another
    offers: only forms without a town ask for all towns, only forms without an address ask by venue and town. A typing
    error leaves the sound, the start or the end of a word as it is."""
    shared, needed, offered = [], [], []
    vk = venue_key(venue, town)
    name = venue_name(venue, town) if venue else None
    if number and street:
        at = f"{number}|{sound(street)}"
        if town:
            shared += [f"a|{at}|{sound(town)}", f"b|{number}|{street[:4]}|{town[:4]}", f"c|{number}|{street[-4:]}|{town[-4:]}"]
        else:
            needed += [f"z|{at}", f"y|{at}|{name[:4]}" if name else f"x|{at}"]
        offered += [f"x|{at}", f"y|{at}|{name[:4]}" if name else f"z|{at}"]
    if number and town:
        shared.append(f"t|{number}|{town}")
    if number and vk:
        shared.append(f"v|{number}|{vk[:6]}")
    if vk and town:
        core = max(town.split(), key=len)
        by_venue = [f"w0|{sound(name)}|{core[:5]}", f"w1|{name[:4]}|{sound(core)}", f"w2|{sound(name)}|{core[-5:]}", f"w3|{name[:5]}|{core[:5]}", f"w4|{name[-5:]}|{sound(core)}"]
        offered += by_venue
        if not (number and street):
            needed += by_venue
    unique = lambda x: list(dict.fromkeys(x))
    return unique(shared), unique(needed), unique(offered)


def candidates(form_rows: DataFrame) -> DataFrame:
    """(a, b) with a < b: distinct forms that share a block."""
    keys_type = T.StructType([T.StructField(n, T.ArrayType(T.StringType())) for n in ("shared", "needed", "offered")])

    @F.pandas_udf(keys_type)
    def keys(number: pd.Series, street: pd.Series, town: pd.Series, venue: pd.Series) -> pd.DataFrame:
        text = lambda v: v if isinstance(v, str) else None
        return pd.DataFrame([block_keys(*map(text, r)) for r in zip(number, street, town, venue, strict=True)], columns=["shared", "needed", "offered"])

    keyed = checkpointed(form_rows.select("fid", keys("number", "street", "town", "venue").alias("k")))
    # keys travel as 64-bit hashes: two keys of one hash only add a candidate
    side = lambda kind, name: keyed.select(F.col("fid").alias(name), F.explode(F.transform(f"k.{kind}", lambda x: F.xxhash64(x))).alias("h"))
    same = side("shared", "a").join(large(side("shared", "b")), "h").where("a < b").select("a", "b")
    asked = side("needed", "a").join(large(side("offered", "b")), "h").where("a != b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    return same.unionByName(asked).distinct()


def links(form_rows: DataFrame) -> DataFrame:
    """(a, b, posterior) of every two forms that stand for one place."""
    side = lambda x: form_rows.select(F.col("fid").alias(x), F.struct(*FIELDS).alias(f"f{x}"))

    @F.pandas_udf(T.StringType())
    def vector(fa: pd.DataFrame, fb: pd.DataFrame) -> pd.Series:
        clean = lambda f: [tuple(v if isinstance(v, str) else None for v in r) for r in f[list(FIELDS)].itertuples(index=False)]
        return pd.Series([compare(x, y) for x, y in zip(clean(fa), clean(fb), strict=True)])

    pairs = candidates(form_rows).join(large(side("a")), "a").join(large(side("b")), "b").select("a", "b", vector("fa", "fb").alias("pattern"))
    pairs = checkpointed(pairs)
    counts = {r["pattern"]: r["count"] for r in pairs.groupBy("pattern").count().collect()}
    table = [(p, float(q)) for p, q in posteriors(counts).items()]
    scored = F.broadcast(pairs.sparkSession.createDataFrame(table, "pattern string, posterior double"))  # 972 patterns at most
    return pairs.join(scored, "pattern").where(F.col("posterior") > POSTERIOR).select("a", "b", "pattern", "posterior")


def _weak(c: str) -> Column:
    """A form without an address or without a place."""
    return F.col(f"{c}.number").isNull() | F.col(f"{c}.street").isNull() | (F.col(f"{c}.town").isNull() & F.col(f"{c}.zip5").isNull())


def inherited(form_rows: DataFrame, linked: DataFrame) -> DataFrame:
    """(a, b) that follow from a weak form's most probable whole form: the whole form's other links hold for the weak
    one, unless a component of theirs differs (venues may: a building can have several)."""
    both = linked.select("a", "b", "posterior").unionByName(linked.select(F.col("b").alias("a"), F.col("a").alias("b"), "posterior"))
    side = lambda x: form_rows.select(F.col("fid").alias(x), F.struct(*FIELDS).alias(f"f{x}"))
    known = both.join(large(side("a")), "a").join(large(side("b")), "b")
    anchor = known.where(_weak("fa") & ~_weak("fb")).groupBy("a").agg(F.max_by("b", F.struct("posterior", "b")).alias("anchor"), F.first("fa").alias("fa"))
    more = both.select(F.col("a").alias("anchor"), F.col("b").alias("c")).join(large(anchor), "anchor").where("c != a").join(large(side("c")), "c")

    @F.pandas_udf(T.BooleanType())
    def agrees(fa: pd.DataFrame, fc: pd.DataFrame) -> pd.Series:
        clean = lambda f: [tuple(v if isinstance(v, str) else None for v in r) for r in f[list(FIELDS)].itertuples(index=False)]
        contradiction = {"number": 2, "street": 3, "kind": 2, "direction": 2, "area": 2}
        names = list(LEVELS)
        return pd.Series([all(int(v[names.index(k)]) != d for k, d in contradiction.items()) for v in map(compare, clean(fa), clean(fc))])

    return more.where(agrees("fa", "fc")).select(F.least("a", "c").alias("a"), F.greatest("a", "c").alias("b"))


def _form_links(df: DataFrame, id_col: str, address_col: str, venue_col: str, city_col: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(forms, members, links between different forms)."""
    form_rows, members = forms(checkpointed(parsed(df, id_col, address_col, venue_col, city_col)))
    form_rows = checkpointed(form_rows)
    found = checkpointed(links(form_rows).select("a", "b", "posterior"))
    more = inherited(form_rows, found).withColumn("posterior", F.lit(POSTERIOR))
    return form_rows, members, found.unionByName(more).groupBy("a", "b").agg(F.max("posterior").alias("posterior"))


def place_classes(df: DataFrame, id_col: str, address_col: str = "address", venue_col: str = "venue", city_col: str = "city") -> DataFrame:
    """(id_col, place): every record with the class of its building, one row a record whatever the classes' sizes. Classes
    are stars of forms: the fullest form of a place is its centre, the others join their most probable centre. Records
    that name no place are left out."""
    form_rows, members, linked = _form_links(df, id_col, address_col, venue_col, city_col)
    filled = sum((F.col(f).isNotNull().cast("int") for f in FIELDS), F.lit(0))
    size = members.groupBy("fid").agg(F.count("*").alias("n"))
    named = form_rows.join(large(size), "fid").select(F.lpad(F.hex("fid"), 16, "0").alias("name"), "n", filled.alias("quality"))
    edges = linked.select(F.lpad(F.hex("a"), 16, "0").alias("a"), F.lpad(F.hex("b"), 16, "0").alias("b"), F.col("posterior").alias("sim"))
    return members.select(F.col("rid").alias(id_col), F.lpad(F.hex("fid"), 16, "0").alias("name")).join(large(stars(named, edges)), "name").select(id_col, F.col("centre").alias("place"))


def same_place(df: DataFrame, id_col: str, address_col: str = "address", venue_col: str = "venue", city_col: str = "city") -> DataFrame:
    """(id_a, id_b): every two records of one place, smaller id first. Its size grows with the square of a building's
    records; place_classes has the same knowledge in one row a record."""
    form_rows, members, linked = _form_links(df, id_col, address_col, venue_col, city_col)
    within = form_rows.select(F.col("fid").alias("a"), F.col("fid").alias("b"))
    ma, mb = members.select(F.col("fid").alias("a"), F.col("rid").alias("x")), members.select(F.col("fid").alias("b"), F.col("rid").alias("y"))
    pairs = within.unionByName(linked.select("a", "b")).join(large(ma), "a").join(large(mb), "b").where((F.col("a") != F.col("b")) | (F.col("x") < F.col("y")))
    # a record has one form, so no pair comes twice
    return pairs.select(F.least("x", "y").alias("id_a"), F.greatest("x", "y").alias("id_b"))
