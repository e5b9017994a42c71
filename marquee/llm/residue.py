"""Template residue, filler and error-page text: positive-unlabelled naive Bayes, learned by expectation-maximisation.

Passages are a record's text fields and, apart from them, every wrapped span (``{{x}}``, ``[x]``, ``%x%`` ...), since
one unfilled field inside an ordinary sentence is residue too. Equal fields (case, digits, markup and blanks do not
count) are one *form*; the model is learned over distinct forms, so a text that comes a million times is one example.

Trusted are a dozen generic texts (TRUSTED_TEXTS) and spans in wrappers that only templates use; all else is
unlabelled and counts as negative at first. Each turn of EM learns from the current posteriors, per form:

* its words and word pairs, as the mean log odds of its features (so long texts do not decide by length);
* where the form stands (which fields, how often it recurs): error texts stand in any field, titles do not;
* its company: how often the other fields of the same records are residue, one Bernoulli event per record.

Seeds stay positive. Spans are judged by their name (trusted where a template-only wrapper holds it anywhere) and the
name's style. A record is residue if one of its forms or spans is.

Words and pairs are hashed into 2 x REGION counters, which is all the driver holds and the tasks are sent, whatever the
corpus; what shares a counter by chance is rarer than 1 in REGION, and all features that rare weigh alike. Positive
forms travel to the others by a broadcast where they are few (POSITIVE_LIMIT, counted first), else by a shuffle join.

Defined cases: null and blank fields have no passages; a record without passages is clean; repeated rows are judged
alike and reported once; texts of any length are read whole; with no trusted passage nothing is residue; an empty
table gives none; other columns are ignored; null ids are left out.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marquee.functions.temporal import let
from marquee.session import checkpointed

#: EM ends after ITERATIONS turns or once the positive mass moves by a share of SETTLED at most.
REGION, ITERATIONS, SETTLED = 1 << 20, 8, 0.003
#: Smoothing of word counts, weight and bound of a form's mean log odds. A feature that positives hold less than SEEN
#: times, or less than the share SHARE of the forms with it, is no evidence for them, however rare it is: the positives
#: are few, so a word of any language would else look like theirs once one of them holds it.
ALPHA, TEXT_WEIGHT, TEXT_BOUND, SEEN, SHARE = 0.05, 3.0, 8.0, 0.3, 0.07
#: Posteriors below FAINT count as none; at most POSITIVE_LIMIT forms (16 bytes each) are broadcast.
FAINT, POSITIVE_LIMIT = 1e-3, 200_000

#: Generic texts trusted to be residue as a whole field (lower case, # for digits).
TRUSTED_TEXTS = (
    r"# (?:- )?(?:not found|forbidden|internal server error)", r"page not found", r"please enable javascript.*", r"javascript is required.*", r"lorem ipsum(?: \p{L}+)?",
    r"null", r"undefined", r"nan", r"\[object object\]", r"sample text.*", r"placeholder text.*", r"your (?:text|headline|title|description) here", r"insert (?:text|title|description) here",
)
#: wrapper name -> pattern with the inner text as its group; the first TEMPLATE_ONLY are used by templates only.
WRAPPERS = {
    "mustache3": r"\{\{\{([^{}]+)\}\}\}", "mustache": r"\{\{([^{}]+)\}\}", "tag": r"\{%([^{}%]+)%\}", "erb": r"<%=?([^<>%]+)%>", "shell": r"\$\{([^{}]+)\}",
    "merge": r"\*\|([^*|]+)\|\*", "hash": r"##([^#\s][^#]*)##", "at": r"@@([^@]+)@@", "wiki": r"\[\[([^\[\]]+)\]\]",
    "brace": r"(?<![{$])\{([^{}%]+)\}(?!\})", "bracket": r"(?<!\[)\[([^\[\]]+)\](?!\])", "angle": r"<([\p{L}_][^<>%/=]*)>", "entity": r"&lt;([^<>&]+)&gt;",
    "percent": r"(?<![\d%])%(\p{L}[^%\s]*(?: [^%\s]+){0,3})%", "dollar": r"\$(\p{L}[^$\s]*(?: [^$\s]+){0,3})\$", "under": r"__(\p{L}[^_]*(?:_[^_]+)*)__", "guillemet": r"«([^«»]+)»", "paren2": r"\(\(([^()]+)\)\)",
}
TEMPLATE_ONLY = 9
#: Every wrapper opens with one of these; most texts hold none and are spared the patterns.
_OPENERS = r"[\[{«]|<[\p{L}_%]|&lt;|%\p{L}|\$\p{L}|__|\(\(|\*\||##|@@"
_HTML = r"(?i)</?(?:p|div|span|h[1-6]|noscript|b|i|u|em|strong|a|br|ul|ol|li|table|tr|td|th|body|html|head|section|article)(?:\s[^<>]*)?/?>"


def _style(name: Column) -> Column:
    return (
        F.when(name.rlike(r"^\p{L}+\.\p{L}"), "dotted").when(name.contains("_"), "snake").when(name.rlike(r"^\p{Lu}{2,}$"), "upper")
        .when(name.rlike(r"^\p{L}*\p{Ll}\p{Lu}"), "camel").when(name.rlike(r"\s"), "words").when(name.rlike(r"^\p{Lu}"), "capital").otherwise("lower")
    )


def _clean(c: Column) -> Column:
    return F.when(c.contains("<"), F.regexp_replace(c, _HTML, " ")).otherwise(c)


def _form(c: Column) -> Column:
    """A field without template-only wrappers, case, digits and markup; null where no word is left."""

    def bare(t: Column) -> Column:
        out = t
        for pattern in list(WRAPPERS.values())[:TEMPLATE_ONLY]:
            out = F.regexp_replace(out, pattern, " ")
        return F.lower(F.when(t.rlike(_OPENERS), out).otherwise(t))

    t = let(_clean(c), bare)
    t = F.trim(F.regexp_replace(F.regexp_replace(t, r"\d+", "#"), r"[\s\x{A0}]+", " "))
    return let(t, lambda x: F.when(x.rlike(r"[\p{L}#]"), x))


def _features(form: Column) -> Column:
    """Counters of a form's distinct words and pairs of words."""
    w = F.regexp_extract_all(form, F.lit(r"(\p{L}[\p{L}\p{M}]*|#)"), F.lit(1))
    slot = lambda *c: F.pmod(F.hash(*c), F.lit(REGION))
    pairs = F.zip_with(w, F.slice(F.concat(w, F.array(F.lit(""))), F.lit(2), F.size(w)), lambda a, b: F.when(b != "", slot(a, b) + REGION))
    return F.concat(F.array_distinct(F.transform(w, lambda x: slot(x))), F.array_distinct(F.filter(pairs, lambda x: x.isNotNull())))


def _odds(pos: np.ndarray, both: np.ndarray) -> np.ndarray:
    """Log odds per counter; words and pairs are distributions of their own."""
    out = np.zeros(2 * REGION, dtype=np.float32)
    for part in (slice(0, REGION), slice(REGION, 2 * REGION)):
        p, n = pos[part], np.maximum(both[part] - pos[part], 0.0)
        seen = both[part] > 0
        room = ALPHA * max(1, int(seen.sum()))
        odds = np.log((p + ALPHA) / (p.sum() + room)) - np.log((n + ALPHA) / (n.sum() + room))
        out[part] = np.where(seen, np.where((p < SEEN) | (p < SHARE * both[part]), np.minimum(odds, 0.0), odds), 0.0)
    return out


def _counters(rows: DataFrame) -> np.ndarray:
    """(b, n) as an array of 2 x REGION."""
    got = rows.toPandas()
    out = np.zeros(2 * REGION)
    out[got["b"].to_numpy(dtype=np.int64)] = got["n"].to_numpy(dtype=float)
    return out


def _text_scores(forms: DataFrame, odds: np.ndarray) -> DataFrame:
    """forms without features, with s: the bounded mean log odds of the features."""
    sent = forms.sparkSession.sparkContext.broadcast(odds)
    kept = [f for f in forms.schema.fields if f.name != "features"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lists = b.column(b.schema.get_field_index("features"))
            at = lists.offsets.to_numpy()
            sums = np.concatenate([[0.0], np.cumsum(sent.value[lists.values.to_numpy(zero_copy_only=False)], dtype=np.float64)])
            n = np.diff(at)
            s = np.clip(TEXT_WEIGHT * (sums[at[1:]] - sums[at[:-1]]) / np.maximum(n, 1), -TEXT_BOUND, TEXT_BOUND)
            yield pa.RecordBatch.from_arrays([*[b.column(b.schema.get_field_index(f.name)) for f in kept], pa.array(s)], names=[*[f.name for f in kept], "s"])

    schema = ", ".join([f"{f.name} {f.dataType.simpleString()}" for f in kept] + ["s double"])
    return forms.mapInArrow(run, schema)


def form_posteriors(df: DataFrame, id_col: str, text_cols: list[str]) -> tuple[DataFrame, DataFrame]:
    """(rows, posteriors): rows has rid and its forms' hashes hs, posteriors h, p (above one half only)."""
    named = df.where(F.col(id_col).isNotNull())
    hs = F.transform(F.array(*[_form(F.col(c)) for c in text_cols]), lambda t: F.when(t.isNotNull(), F.xxhash64(t)))
    rows = checkpointed(named.select(F.col(id_col).alias("rid"), hs.alias("hs")).distinct())
    # where a form stands: its number of records, one field or several
    placed = rows.select("rid", F.posexplode("hs").alias("f", "h")).where("h is not null")
    several = F.when(F.min("f") == F.max("f"), F.min("f")).otherwise(F.lit(len(text_cols)))
    stats = placed.groupBy("h").agg(F.count("*").alias("m"), several.alias("place"))
    stats = stats.select("h", "m", (F.col("place") * 3 + F.least(F.floor(F.log2("m")), F.lit(2))).cast("int").alias("cat"))
    sides = [(i, j) for i in range(len(text_cols)) for j in range(len(text_cols)) if i != j]
    pair = F.array(*[F.struct(F.col("hs")[i].alias("h"), F.col("hs")[j].alias("g")) for i, j in sides] or [F.struct(F.lit(None).cast("long").alias("h"), F.lit(None).cast("long").alias("g"))])
    links = checkpointed(rows.select(F.inline(pair)).where("h is not null and g is not null").groupBy("h", "g").agg(F.count("*").alias("n")))
    seed_re = rf"^(?:{'|'.join(TRUSTED_TEXTS)})[.!]?$"
    texts = named.select(F.explode(F.array(*[_form(F.col(c)) for c in text_cols])).alias("t")).where("t is not null")
    distinct = texts.select(F.xxhash64("t").alias("h"), F.col("t").rlike(seed_re).alias("seed"), _features(F.col("t")).alias("features")).groupBy("h").agg(F.first("seed").alias("seed"), F.first("features").alias("features"))
    forms = checkpointed(distinct.join(stats, "h"))
    both = _counters(forms.select(F.explode("features").alias("b")).groupBy("b").agg(F.count("*").alias("n")))
    totals = {r["cat"]: (r["n"], r["m"]) for r in forms.groupBy("cat").agg(F.count("*").alias("n"), F.sum("m").alias("m")).collect()}
    n_forms, n_records = sum(n for n, _ in totals.values()), sum(m for _, m in totals.values())
    posts, before = forms.where("seed").select("h", F.lit(1.0).alias("p")), 0.0
    for _ in range(ITERATIONS):
        pos = checkpointed(posts.where(F.col("p") > FAINT).select("h", "p"))
        few = pos.count() <= POSITIVE_LIMIT
        side = F.broadcast(pos) if few else pos
        company = links.join(side.withColumnRenamed("h", "g"), "g").groupBy("h").agg(F.sum(F.col("n") * F.col("p")).alias("c"))
        learned = checkpointed(forms.join(side, "h"))
        odds = _odds(_counters(learned.select(F.explode("features").alias("b"), "p").groupBy("b").agg(F.sum("p").alias("n"))), both)
        mine = learned.drop("features").join(company, "h", "left").groupBy("cat").agg(F.sum("p").alias("p"), F.sum(F.col("m") * F.col("p")).alias("mp"), F.sum(F.coalesce("c", F.lit(0.0)) * F.col("p")).alias("cp")).collect()
        all_company = company.agg(F.sum("c")).first()[0] or 0.0
        mass = sum(r["p"] for r in mine)
        if before and abs(mass - before) <= SETTLED * mass:
            break
        before = mass
        m_pos, c_pos = sum(r["mp"] for r in mine), sum(r["cp"] for r in mine)
        p1 = (c_pos + 1) / (m_pos + 2)
        p0 = min((all_company - c_pos + 1) / (n_records - m_pos + 2), 0.999)
        by_cat = {r["cat"]: r["p"] for r in mine}
        k = len(totals)
        shape = {c: math.log((by_cat.get(c, 0.0) + 0.5) / (mass + 0.5 * k)) - math.log((n - by_cat.get(c, 0.0) + 0.5) / (n_forms - mass + 0.5 * k)) for c, (n, _) in totals.items()}
        prior = math.log((mass + 1) / (n_forms - mass + 1))
        if not mass:  # nothing trusted
            return rows, pos.where("false").withColumn("seed", F.lit(True))
        scored = _text_scores(forms, odds).join(company, "h", "left").withColumn("c", F.least(F.coalesce("c", F.lit(0.0)), F.col("m").cast("double")))
        shape_of = F.element_at(F.create_map(*[F.lit(x) for kv in shape.items() for x in kv]), F.col("cat"))
        total = F.lit(prior) + F.col("s") + shape_of + F.col("c") * math.log(p1 / p0) + (F.col("m") - F.col("c")) * math.log((1 - p1) / (1 - p0))
        bounded = F.greatest(F.least(total, F.lit(40.0)), F.lit(-40.0))
        posts = scored.select("h", "seed", F.when(F.col("seed"), F.lit(1.0)).otherwise(1 / (1 + F.exp(-bounded))).alias("p"))
    found = checkpointed(posts.where("p > 0.5"))
    return rows, found


def spans(df: DataFrame, id_col: str, text_cols: list[str]) -> DataFrame:
    """(rid, ident, style, trusted) of every wrapped span; texts without an opener are passed by."""
    t = F.col("t")
    within = lambda pattern, trusted: F.transform(F.regexp_extract_all(t, F.lit(pattern), F.lit(1)), lambda x: F.struct(x.alias("inner"), F.lit(trusted).alias("trusted")))
    found = [within(pattern, n < TEMPLATE_ONLY) for n, pattern in enumerate(WRAPPERS.values())]
    texts = df.where(F.col(id_col).isNotNull()).select(F.col(id_col).alias("rid"), F.explode(F.array(*[F.col(c) for c in text_cols])).alias("t")).where(t.rlike(_OPENERS))
    inner = F.trim(F.regexp_replace("inner", r"\|\s*default", ""))
    each = texts.withColumn("t", _clean(t)).select("rid", F.inline(F.concat(*found)))
    return each.select("rid", F.lower(inner).alias("ident"), _style(inner).alias("style"), "trusted").where("ident != ''")


def residue_spans(df: DataFrame, id_col: str, text_cols: list[str], turns: int = 4) -> DataFrame:
    """(rid, log_odds, trusted) of the spans taken for unfilled fields. EM over names and styles: a name seen in a
    template-only wrapper is positive, the others are judged by their style and by how common the name is."""
    each = checkpointed(spans(df, id_col, text_cols))
    names = each.groupBy("ident", "style").agg(F.count("*").alias("n"), F.max("trusted").alias("t")).groupBy("ident").agg(F.max("t").alias("known"), F.sum("n").alias("n"), F.max_by("style", "n").alias("style"))
    names = checkpointed(names)
    odds = F.when(F.col("known"), 40.0).otherwise(-40.0)
    for _ in range(turns):
        p = 1 / (1 + F.exp(-odds))
        by_style = names.groupBy("style").agg(F.sum(F.col("n") * p).alias("p"), F.sum(F.col("n") * (1 - p)).alias("q"), F.count("*").alias("k")).collect()
        if not by_style:
            break
        pos, neg, k = sum(r["p"] for r in by_style), sum(r["q"] for r in by_style), sum(r["k"] for r in by_style)
        s = 0.1 * len(by_style)
        style = {r["style"]: math.log((r["p"] + 0.1) / (pos + s)) - math.log((r["q"] + 0.1) / (neg + s)) for r in by_style}
        name = F.lit(-math.log(pos + k)) - F.log((F.col("n") + 1) / F.lit(neg + k))
        judged = F.lit(math.log((pos + 1) / (neg + 1))) + F.element_at(F.create_map(*[F.lit(x) for kv in style.items() for x in kv]), F.col("style")) + name
        odds = F.when(F.col("known"), 40.0).otherwise(F.greatest(F.least(judged, F.lit(40.0)), F.lit(-40.0)))
    kept = names.select("ident", "known", odds.alias("log_odds")).where("log_odds > 0")
    return each.join(kept, "ident").select("rid", "log_odds", F.col("known").alias("trusted"))


def records(df: DataFrame, id_col: str, text_cols: list[str]) -> DataFrame:
    """(id_col, seeded): every record that is residue; seeded where a trusted text or span says so by itself."""
    rows, found = form_posteriors(df, id_col, text_cols)
    by_form = rows.select("rid", F.explode("hs").alias("h")).join(found, "h").select("rid", F.col("seed").alias("s"))
    by_span = residue_spans(df, id_col, text_cols).select("rid", F.col("trusted").alias("s"))
    return by_form.unionByName(by_span).groupBy("rid").agg(F.max("s").alias("seeded")).withColumnRenamed("rid", id_col)
