"""Text cut off by field limits or in transfer.

Three kinds of evidence, all gathered over the distinct texts of the whole corpus (lengths: of each source), so copies
of one text are no evidence about each other:

* a vocabulary trie: words seen inside texts (never at their ends); a final token that is no known word but a proper
  prefix of one was cut inside a word. The trie is kept as its node set (every proper prefix of every known word), so
  looking up all final tokens is one semi join and no task or driver holds the vocabulary;
* sentence openings: how often segments that open with the same words are closed by a sentence end. An open last
  segment whose opening is usually closed was cut inside a sentence; openings that mostly stay open are contact lines,
  lists, tags and the like, and are whole. Among them the trie is overruled only where the very same segment ends
  several distinct texts (a stock line whose last word stands nowhere else);
* length: lengths (characters or bytes) that a source reaches far more often than the lengths around them are its
  field limits; a text of exactly such a length was cut whatever its end.

Defined cases: null or blank text is no case; a null source is a source of its own; repeated rows and texts are judged
alike; an empty table gives none; extra columns pass through, the text itself does not (the texts are read twice, once
for the vocabulary and once for all else, and never shuffled); names ``cut_*`` and ``__*`` belong to the operator.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marquee.functions.temporal import let
from marquee.session import checkpointed

WORD = r"\p{L}[\p{L}\p{M}]*"
END = r"(?:[.!?。][\"”’'»)\]]*)$"
#: A limit's length holds at least LIMIT_LEAST texts, LIMIT_TIMES as many as any length within LIMIT_NEAR and as the
#: lengths within LIMIT_SPAN on average, and at least the share LIMIT_OPEN of them has no sentence end.
LIMIT_LEAST, LIMIT_TIMES, LIMIT_SPAN, LIMIT_NEAR, LIMIT_OPEN = 5, 4.0, 25, 3, 0.5
#: An opening is stock (a tag, a contact line) if it stays open at least STOCK_LEAST times and mostly; a stock line ends
#: STOCK_LEAST distinct texts.
STOCK_LEAST, CLOSED_SHARE = 3, 0.5


def _segments(text: Column) -> Column:
    return F.filter(F.split(text, r"\s*\n\s*|(?<!\b\p{Lu}\.)(?<=[.!?。][\"”’'»)\]]{0,2})\s+(?=[\p{Lu}\p{N}\"“‘'«(\[#—])"), lambda s: s != "")


def _opening(segment: Column) -> Column:
    """struct(w1, w2, two): hashes of a segment's first word and first two words, digits alike, and whether it has two."""
    plain = lambda c: F.regexp_replace(F.lower(c), r"\d+", "9")
    return let(F.split(segment, r"\s+", 3), lambda w: F.struct(F.xxhash64(plain(w[0])).alias("w1"), F.xxhash64(plain(w[0]), plain(F.coalesce(F.get(w, F.lit(1)), F.lit("")))).alias("w2"), (F.coalesce(F.get(w, F.lit(1)), F.lit("")) != "").alias("two")))


def known_words(docs: DataFrame, text: str) -> DataFrame:
    """(w) words that stand inside at least one text: every token but a text's last."""
    tokens = F.regexp_extract_all(F.lower(F.col(text)), F.lit(f"({WORD})"))
    inner = F.slice(tokens, F.lit(1), F.greatest(F.size(tokens) - 1, F.lit(0)))
    return docs.select(F.explode(F.array_distinct(inner)).alias("w")).distinct()


def cut_words(tokens: DataFrame, words: DataFrame) -> DataFrame:
    """(w) those of the distinct tokens that are no known word but a proper prefix of one."""
    unknown = tokens.join(words, "w", "left_anti")
    nodes = words.where(F.length("w") > 1).select(F.explode(F.transform(F.sequence(F.lit(1), F.length("w") - 1), lambda n: F.left(F.col("w"), n))).alias("w")).distinct()
    return unknown.join(nodes, "w", "left_semi")


def limits(texts: DataFrame) -> DataFrame:
    """(source, unit, length, n): the lengths at which a source's field ends; texts has source, h, o (ends open), chars, bytes."""
    units = F.array(F.struct(F.lit("chars").alias("unit"), F.col("chars").alias("length")), F.struct(F.lit("bytes").alias("unit"), F.col("bytes").alias("length")))
    texts = texts.select("source", "h", F.col("o").cast("int").alias("o"), units.alias("u")).distinct()
    lengths = texts.select("source", "o", F.inline("u"))
    counts = lengths.groupBy("source", "unit", "length").agg(F.count("*").alias("n"), F.avg("o").alias("open"))
    at = F.sequence(F.col("length") - LIMIT_SPAN, F.col("length") + LIMIT_SPAN)
    spread = counts.select("source", "unit", F.explode(at).alias("at"), "length", "n", "open")
    near = F.abs(F.col("at") - F.col("length")) <= LIMIT_NEAR
    own = F.col("at") == F.col("length")
    around = spread.groupBy("source", "unit", "at").agg(
        F.max(F.when(own, F.col("n"))).alias("n"), F.max(F.when(own, F.col("open"))).alias("open"),
        F.max(F.when(~own & near, F.col("n"))).alias("peak"), (F.sum(F.when(~own, F.col("n"))) / F.lit(2.0 * LIMIT_SPAN)).alias("usual"),
    )
    least = LIMIT_TIMES * F.greatest(F.coalesce("peak", F.lit(0)), F.coalesce("usual", F.lit(0.0)))
    found = around.where((F.col("n") >= LIMIT_LEAST) & (F.col("n") >= least) & (F.col("open") >= LIMIT_OPEN))
    # where texts are mostly ASCII a limit shows in both units; the one that binds holds more texts
    binding = F.max_by(F.struct("unit", "n"), F.struct("n", (F.col("unit") == "chars").alias("first"))).alias("b")
    return found.groupBy("source", F.col("at").alias("length")).agg(binding).select("source", "b.unit", "length", "b.n")


def marked(docs: DataFrame, text_col: str, source_col: str) -> DataFrame:
    """docs without the text, with all that judging needs of it: one pass over the texts, written once."""
    text = F.rtrim(F.regexp_replace(F.coalesce(F.col(text_col), F.lit("")), r"\r\n?", "\n"))

    def read(t: Column) -> Column:
        return let(F.struct(t.alias("t"), _segments(t).alias("s")), flags)

    def flags(x: Column) -> Column:
        t, last = x["t"], F.try_element_at(x["s"], F.lit(-1))
        dots = t.rlike(r"(?:\.\.+|…)$")
        is_open = (t != "") & (~t.rlike(END) | dots)
        return F.struct(
            (t == "").alias("blank"), F.xxhash64(t).alias("h"), is_open.alias("open"), dots.alias("dots"), _opening(last).alias("last"), F.when(is_open, F.endswith(F.concat(F.lit("\n"), t), F.concat(F.lit("\n"), last))).alias("own"),
            F.when(is_open, F.xxhash64(F.regexp_replace(F.lower(last), r"\d+", "9"))).alias("line"), F.when(is_open, F.regexp_extract(F.lower(F.right(t, F.lit(4096))), rf"({WORD})(?:\.\.+|…)?$", 1)).alias("w"),
            # a character, entity or tag that was cut
            t.rlike(r"\x{FFFD}$|&[a-z]{1,6}$|&#x?[0-9a-f]{0,5}$|<[a-z/][^<>]*$").alias("code"),
            F.transform(x["s"], lambda s: F.struct(_opening(s).alias("o"), s.rlike(END).alias("c"))).alias("segments"),
        )

    kept = [c for c in docs.columns if not c.startswith(("cut_", "__")) and c not in ("cut", text_col)]
    return checkpointed(docs.select(*kept, F.col(source_col).alias("__source"), F.length(text_col).alias("__chars"), F.octet_length(text_col).alias("__bytes"), let(text, read).alias("__m")))


def judge(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """docs without the text, with cut (boolean) and cut_reason: inside_word, inside_sentence, at_limit or null."""
    read = marked(docs, text_col, source_col)
    kept = [c for c in read.columns if not c.startswith("__")]
    marks = read.select(*kept, "__source", "__chars", "__bytes", *[F.col("__m")[c].alias(f"__{c}") for c in ("blank", "h", "open", "dots", "own", "line", "w", "code")], F.col("__m.last.w1").alias("__w1"), F.col("__m.last.w2").alias("__w2"), F.col("__m.last.two").alias("__two"))
    # openings over all segments of all distinct texts
    segments = read.where("not __m.blank").select("__m.h", "__m.segments").dropDuplicates(["h"]).select(F.inline("segments")).select("o.w1", "o.w2", F.col("c").cast("int").alias("c"))
    openings = checkpointed(segments.groupBy("w1", "w2").agg(F.sum("c").alias("closed"), (F.count("*") - F.sum("c")).alias("open")))
    firsts = openings.groupBy("w1").agg(F.sum("closed").alias("closed1"), F.sum("open").alias("open1"))
    tokens = marks.where("__open and __w != ''").select(F.col("__w").alias("w")).distinct()
    plain = docs.select(F.rtrim(F.coalesce(F.col(text_col), F.lit(""))).alias("t"))
    broken = cut_words(tokens, known_words(plain, "t")).select(F.col("w").alias("__bw"))
    opened, whole = marks.where("__open"), marks.where("not __open")
    lines = opened.select("__h", "__line").distinct().groupBy(F.col("__line").alias("__stock")).agg(F.count("*").alias("__line_n")).where(F.col("__line_n") >= STOCK_LEAST)
    # only open texts meet the opening, line and trie tables
    pairs = openings.select(F.col("w2").alias("__w2"), "closed", "open")
    opened = (
        opened.join(pairs, "__w2", "left")
        .join(firsts.select(F.col("w1").alias("__w1"), "closed1", "open1"), "__w1", "left")
        .join(lines, F.col("__line") == F.col("__stock"), "left")
        .join(broken, F.col("__w") == F.col("__bw"), "left")
    )
    whole = whole.withColumns({c: F.lit(None).cast("long") for c in ("__stock", "__line_n", "closed", "open", "closed1", "open1")}).withColumn("__bw", F.lit(None).cast("string"))
    lim = limits(marks.where("not __blank").select(F.col("__source").alias("source"), F.col("__h").alias("h"), F.col("__open").alias("o"), F.col("__chars").alias("chars"), F.col("__bytes").alias("bytes")))
    both = opened.unionByName(whole)
    for unit in ("chars", "bytes"):
        u = lim.where(F.col("unit") == unit).select(F.col("source").alias(f"__{unit}_s"), F.col("length").alias(f"__{unit}_l"), F.col("n").alias(f"__{unit}_n"))
        both = both.join(u, F.col("__source").eqNullSafe(F.col(f"__{unit}_s")) & (F.col(f"__{unit}") == F.col(f"__{unit}_l")), "left")
    share = lambda c, o: F.coalesce(F.col(c) / (F.col(c) + F.col(o)), F.lit(None))
    pair_seen = (F.coalesce(F.col("closed") + F.col("open"), F.lit(0)) > 1) & F.col("__two")
    stock = (F.col("open") >= STOCK_LEAST) & (share("closed", "open") < CLOSED_SHARE)
    usually_closed = F.when(pair_seen, share("closed", "open")).otherwise(share("closed1", "open1")) >= CLOSED_SHARE
    at_limit = F.col("__chars_n").isNotNull() | F.col("__bytes_n").isNotNull()
    plain_open = F.col("__open") & ~F.col("__dots")
    reason = (
        F.when(at_limit, "at_limit")
        .when(plain_open & F.col("__code"), "inside_word")
        .when(F.col("__open") & F.col("__bw").isNotNull() & ~(F.coalesce(stock, F.lit(False)) & F.col("__stock").isNotNull()), "inside_word")
        .when(plain_open & ~F.col("__own") & ~F.coalesce(stock, F.lit(False)), "inside_sentence")
        .when(plain_open & F.coalesce(usually_closed, F.lit(False)), "inside_sentence")
    )
    return both.select(*kept, reason.alias("cut_reason"), reason.isNotNull().alias("cut"))


def rates(judged: DataFrame, source_col: str = "source") -> DataFrame:
    """Per source: texts, cut texts by kind, and the share that was cut."""
    kinds = [F.count_if(F.col("cut_reason") == k).alias(k) for k in ("at_limit", "inside_word", "inside_sentence")]
    return judged.groupBy(source_col).agg(F.count("*").alias("n_docs"), F.count_if("cut").alias("n_cut"), *kinds, F.round(F.count_if("cut") / F.count("*"), 6).alias("cut_rate"))
