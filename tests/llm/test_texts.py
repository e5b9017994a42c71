import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from marquee.llm import leakage, mixing, residue, survivorship, textmarks, truncation


# ---- residue ----------------------------------------------------------------------------------------------------

NORMAL = ["The harbor choir sings on the pier at {n}.", "Children may paint lanterns near the bandstand.", "Tickets cost ${n} at the door for grandparents.", "Bring a chair and a story to trade if you like."]
JUNK = ["404 Not Found", "Please enable JavaScript to view this calendar.", "Lorem ipsum", "Service Unavailable", "{{event_name}} at {{venue}}", "Too many requests. Slow down and retry after 5s."]


def test_residue(spark):
    """Texts that no trusted pattern names are learned: they recur, stand in both fields or keep residue's company."""
    rng = random.Random(1)
    rows = [(i, f"Night {i % 40} of songs", " ".join(s.format(n=rng.randrange(90)) for s in rng.sample(NORMAL, 3)) + f" Hall {i}") for i in range(400)]
    rows += [(1000 + i, rng.choice(JUNK), rng.choice(JUNK)) for i in range(60)]
    rows += [(2000, "[event_name]", None), (2001, "Night 1 of songs", "Songs by %venue% on the pier at 5."), (2002, None, None), (2003, "", " "), (2004, "choir " * 20_000, None), (None, "404 Not Found", None)]
    rows += [(2005, "Night 2 of songs", "{{" + "long name " * 20 + "}}")]
    rows += [(3000 + i, 'How a server answers "404 Not Found" to a choir', f"Ticket price {{reduced}} for members of the choir, row {i} of the harbor hall on the pier.") for i in range(20)]
    df = spark.createDataFrame(rows + rows[300:310], "id long, title string, description string").withColumn("seeded", F.lit("clash"))
    got = {r.id: r.seeded for r in residue.records(df, "id", ["title", "description"]).collect()}
    assert set(got) == {1000 + i for i in range(60)} | {2000, 2001, 2005}
    assert sum(not s for s in got.values()) >= 5
    assert residue.records(df.limit(0), "id", ["title", "description"]).count() == 0
    assert residue.records(df.where("id < 300"), "id", ["title", "description"]).count() == 0


# ---- survivors --------------------------------------------------------------------------------------------------


def brute_layers(rows):
    left, layer, out = list(rows), 1, {}
    dom = lambda a, b: all(x >= y for x, y in zip(a[1], b[1], strict=True)) and a[1] != b[1]
    while left:
        top = [r for r in left if not any(dom(o, r) for o in left)]
        out |= {r[0]: layer for r in top}
        left = [r for r in left if r not in top]
        layer += 1
    return out


def test_survivors_against_brute_force(spark):
    rng = random.Random(5)
    rows = [(f"g{k}", f"r{k}_{i}", rng.random() < 0.5, rng.random() < 0.5, f"2026-01-{rng.randrange(1, 9):02d} 00:00:00", rng.randrange(2)) for k in range(40) for i in range(rng.randrange(1, 7))]
    df = spark.createDataFrame(rows, "k string, id string, a boolean, b boolean, t string, trust int")
    cells = survivorship.cells(df, "k", "id", {"a": F.col("a"), "b": F.col("b")}, F.col("t").cast("timestamp"), F.col("trust"), {"a": F.col("id"), "b": F.col("id")})
    got = {r.k: r for r in survivorship.survivors(cells, "k", ["a", "b"]).collect()}
    won = {r.k: r for r in survivorship.field_winners(survivorship.cells(df, "k", "id", {"a": F.col("a"), "b": F.col("b")}, F.col("t").cast("timestamp"), F.col("trust")), "k", ["a", "b"]).collect()}
    assert set(won) == {k for k in {r[0] for r in rows} if sum(r[0] == k for r in rows) > 1}
    for k in {r[0] for r in rows}:
        mine = [r for r in rows if r[0] == k]
        layers = brute_layers([(r[1], (r[2], r[3], r[4], r[5])) for r in mine])
        for f, at in (("a", 2), ("b", 3)):
            good = [r for r in mine if r[at]]
            best = min(good, key=lambda r: (-int(r[4][8:10]), -r[5], r[1]), default=None)
            if k in won:
                of_field = brute_layers([(r[1], (r[at], r[4], r[5])) for r in mine])
                assert won[k][f"{f}_id"] == (best[1] if best else None)
                assert won[k][f"{f}_layer"] == min((of_field[r[1]] for r in good), default=None)
            layer = min((layers[r[1]] for r in good), default=None)
            assert got[k][f"{f}_layer"] == layer or (layer is not None and got[k][f"{f}_layer"] <= layer)


@pytest.mark.parametrize("coalesce", ["true", "false"])
def test_prefix_cuts_of_any_length_and_group(spark, coalesce):
    # without coalescing the small group lies in several range partitions, which must meet at their seams
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", coalesce)
    rng = random.Random(8)
    head = "Join us at the harbor for songs and stories of the sea."
    rows = [("short", "Rain moves it."), ("short", "Rain moves it. Bring a chair and a story to trade."), ("two", f"{head} B."), ("two", f"{head} B. Then we sing."), ("two", f"{head} A far longer text than either of those. It hides nothing.")]
    rows += [("other", "Rain moves it."), ("other", "Rain moves him. So bring a chair."), (None, "Rain moves it."), ("null", None)]
    rows += [("hot", f"{head} Part {i}." + " Éa." * n) for i in range(60) for n in range(rng.randrange(1, 5))]
    rows = [(i, k, t, t is not None) for i, (k, t) in enumerate(rows + rows)] + [(9000, "bad", "Rain.", True), (9001, "bad", "Rain. Not", False)]
    df = spark.createDataFrame(rows, "id long, k string, d string, whole boolean")
    want = {i: w and not any(w2 and k2 == k and k is not None and t2 != t and t2.startswith(t) for _, k2, t2, w2 in rows) for i, k, t, w in rows}
    got = survivorship.mark_prefix_cuts(df, "k", "d", "whole").collect()
    assert len(got) == len(rows) and {r.id: r.whole for r in got} == want
    assert survivorship.mark_prefix_cuts(df.limit(0), "k", "d", "whole").count() == 0
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")


@pytest.mark.parametrize(("text", "ok"), [("Rain moves the show. Bring a chair.", True), ("Rain moves the sh", False), ("Rain moves the show...", False), ("Rain moves it. Read more", False), ("TBA", False), (None, False), (" ", False), ("See our website for details.", False), ('He said "no more."', True), ("404 Not Found Access denied. Incident number 5.", False)])
def test_whole_prose(spark, text, ok):
    assert spark.createDataFrame([(text,)], "t string").select(textmarks.is_whole_prose(F.col("t"))).first()[0] is ok


# ---- leakage ----------------------------------------------------------------------------------------------------


def test_hamming_index_is_complete():
    rng = np.random.default_rng(1)
    prints = rng.integers(0, 2**63, 300, dtype=np.uint64)
    queries = np.array([p ^ np.uint64(sum(1 << int(b) for b in rng.choice(64, k, replace=False))) for p in prints[:120] for k in (0, 3, 6, 8)], dtype=np.uint64)
    q, p = leakage.HammingIndex(prints).pairs(queries)
    got = set(zip(q.tolist(), p.tolist(), strict=True))
    want = {(i, j) for i in range(len(queries)) for j in range(len(prints)) if bin(int(queries[i] ^ prints[j])).count("1") <= leakage.RADIUS}
    assert got == want


def test_leaks(spark):
    rng = random.Random(2)
    vocab = [f"word{i}" for i in range(400)]
    items = [(i, " ".join(rng.choices(vocab, k=60))) for i in range(20)]
    filler = lambda n: " ".join(rng.choices(vocab, k=n))
    docs = [(i, filler(120)) for i in range(100)]
    docs += [(200 + i, f"{filler(40)} {t} {filler(30)}") for i, t in items[:8]]
    docs += [(300 + i, f"{filler(20)} <b>{' '.join(t.upper().split()[:36])}</b>. {filler(20)}") for i, t in items[:8]]
    docs += [(400 + i, f"{filler(60)} {' '.join(t.split()[:12])} {filler(40)}") for i, t in items[:8]] + [(500, None), (501, ""), (502, "word1"), (200, docs[100][1])]
    d = spark.createDataFrame(docs, "doc_id long, text string").withColumn("item_id", F.lit(9))
    it = spark.createDataFrame(items, "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in leakage.find_leaks(d, it).collect()}
    assert got == {(200 + i, i) for i in range(8)} | {(300 + i, i) for i in range(8)}
    assert leakage.find_leaks(d.limit(0), it).count() == 0 and leakage.find_leaks(d, it.limit(0)).count() == 0


def test_a_hot_leak_keeps_its_pairs(spark):
    rng = random.Random(6)
    vocab = [f"word{i}" for i in range(400)]
    filler = lambda n: " ".join(rng.choices(vocab, k=n))
    items = [(i, filler(60)) for i in range(5)]
    half = " ".join(items[0][1].split()[:36])
    # a third of the rows carry the first half of item 0: some are copies of one text, some differ; its rest stays rare
    docs = [(i, filler(80)) for i in range(200)] + [(1000 + i, f"{filler(10)} {half} {filler(12)}") for i in range(60)]
    docs += [(1100 + i, docs[-1][1]) for i in range(40)]
    it = spark.createDataFrame(items, "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in leakage.find_leaks(spark.createDataFrame(docs, "doc_id long, text string"), it).collect()}
    assert got == {(d, 0) for d, _ in docs if d >= 1000}
    for n in (1, 2):
        few = [(i, f"{filler(8)} {items[i][1]} {filler(8)}") for i in range(n)]
        got = {(r.doc_id, r.item_id) for r in leakage.find_leaks(spark.createDataFrame(few, "doc_id long, text string"), it).collect()}
        assert got == {(i, i) for i in range(n)}


# ---- truncation -------------------------------------------------------------------------------------------------


def test_truncation(spark):
    rng = random.Random(3)
    sentences = ["The choir learned to translate harbor songs near the bandstand.", "Tickets cost nine dollars at the door.", "Bring a lantern if you are ready to sing.", "Volunteers share lavender lemonade after the matinee."]
    rows = [(i, " ".join(rng.choices(sentences, k=4)), "a") for i in range(200)]
    rows += [(1000 + i, rows[i][1] + "\nBox office: 302-555-0123", "a") for i in range(20)]
    rows += [(2000, "Bring a lantern if you are ready to si", "b"), (2001, rows[0][1] + " Volunteers share", "b"), (2002, "Tickets cost nine dollars &nb", "b"), (2003, None, "b"), (2004, " ", None)]
    rows += [(3000 + i, (" ".join(rng.choices(sentences, k=9)))[:150], "c") for i in range(40)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = {r.doc_id for r in truncation.judge(df).where("cut").collect()}
    assert got >= {2000, 2001, 2002} | {3000 + i for i in range(40)} and not got & ({r[0] for r in rows[:220]} | {2003, 2004})
    assert {r.source: r.n_cut for r in truncation.rates(truncation.judge(df)).collect()}["c"] == 40
    assert truncation.judge(df.limit(0)).count() == 0


def test_truncation_of_copies(spark):
    rng = random.Random(7)
    sentences = ["The choir learned to translate harbor songs near the bandstand.", "Tickets cost nine dollars at the door.", "Bring a lantern if you are ready to sing.", "Volunteers share lavender lemonade after the matinee."]
    rows = [(i, " ".join(rng.choices(sentences, k=4)), "a") for i in range(200)] + [(300 + i, rows_text + "\nBox office: 302-555-0123", "a") for i, rows_text in enumerate(" ".join(rng.choices(sentences, k=3)) for _ in range(20))]
    # copies of a text cut inside a word or a sentence, different texts cut in one rare opening, a hot copy group with a common opening
    cut = [(1000 + i, rows[0][1] + " Zebulon presents lavender lemo", "b") for i in range(4)] + [(1100 + i, rows[1][1] + " Yolanda offers lavender", "b") for i in range(4)]
    cut += [(1200 + i, f"{rows[2 + i][1]} Xavier juggles {end}", "c") for i, end in enumerate(["near the bandst", "near the ba", "with lave", "with harbor lemo"])] + [(1300, rows[9][1] + " Bring a lantern if", "d")]
    hot = [(2000 + i, rows[8][1] + "\nBring a lantern", f"h{i}") for i in range(600)]
    stock = [(4000 + i, rows[20 + i][1] + "\nFree for a harb", "f") for i in range(5)]
    whole = [(3000 + i, rows[3][1] + "\nBox office: 302-555-0177", "e") for i in range(6)]
    got = {r.doc_id: r.cut_reason for r in truncation.judge(spark.createDataFrame(rows + cut + hot + stock + whole, "doc_id long, text string, source string")).where("cut").collect() if not 2000 <= r.doc_id < 3000}
    assert got == {**{d: "inside_word" for d, _, _ in cut if d < 1100 or 1200 <= d < 1300}, **{d: "inside_sentence" for d, _, _ in cut if 1100 <= d < 1200 or d == 1300}}


# ---- mixing -----------------------------------------------------------------------------------------------------


def test_sainte_lague():
    assert mixing.sainte_lague({"a": 53, "b": 24, "c": 23}, 7) == {"a": 3, "b": 2, "c": 2}
    assert mixing.sainte_lague({"a": 50, "b": 50}, 10, {"a": 2, "b": 99}) == {"a": 2, "b": 8}
    assert sum(mixing.sainte_lague({"a": 1, "b": 2}, 9, {"a": 9, "b": 2}).values()) == 9


def test_mix(spark):
    rng = random.Random(4)
    words = "harbor choir lantern story bread quilt river".split()
    rows = [(i, " ".join(rng.choices(words, k=30)), "big") for i in range(400)] + [(1000 + i, " ".join(rng.choices(words, k=30)), "small") for i in range(20)] + [(2000, rows_text := "same text here", "small"), (2001, rows_text, "big"), (2002, None, "big"), (2003, "", "small"), (2004, "x", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumn("tokens", F.lit(-1))
    targets = spark.createDataFrame([("big", 0.75, 1), ("small", 0.2, 3), ("gone", 0.05, 2)], "source_name string, target_share double, max_repeats int")
    chosen, shares = mixing.mix(docs, targets, blocks=500)
    c = chosen.collect()
    assert len({r.doc_id for r in c}) == len(c) and all(r.repeats <= {"big": 1, "small": 3}[r.source] for r in c) and not {2002, 2003, 2004} & {r.doc_id for r in c} and len({2000, 2001} & {r.doc_id for r in c}) <= 1
    s = {r.source_name: r for r in shares.collect()}
    assert abs(s["big"].tokens / s["small"].tokens - 0.75 / 0.2) < 0.2 and s["gone"].tokens == 0
    assert {r.doc_id: r.repeats for r in mixing.mix(docs, targets, blocks=500)[0].collect()} == {r.doc_id: r.repeats for r in c}
    assert mixing.mix(docs.limit(0), targets)[0].count() == 0


def test_blocks_larger_than_shards_lose_nothing(spark):
    rows = [(i, "harbor choir lantern " * 10 + str(i), "a" if i % 3 else "b") for i in range(900)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    targets = spark.createDataFrame([("a", 0.5, 2), ("b", 0.5, 2)], "source_name string, target_share double, max_repeats int")
    whole = {r.source_name: r.tokens for r in mixing.mix(docs, targets, blocks=6)[1].collect()}
    for shard_tokens in (100, 1000):
        got = {r.source_name: r.tokens for r in mixing.mix(docs, targets, blocks=6, shard_tokens=shard_tokens)[1].collect()}
        assert all(abs(got[s] - whole[s]) <= sum(whole.values()) / 6 for s in whole)
    for shards, seats, size, repeats in (({1: 100, 2: 100, 3: 7}, 5, 60.0, 2), ({1: 10, 2: 10}, 3, 6.0, 1), ({1: 50}, 4, 33.3, 9)):
        quota = mixing.shard_quotas(shards, seats, size, repeats)
        assert sum(quota.values()) == round(min(seats * size, repeats * sum(shards.values()))) and all(0 <= q <= shards[k] * repeats for k, q in quota.items())
