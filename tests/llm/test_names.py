import random

import pytest

from marquee.llm import names

COMMON = dict.fromkeys("community orchestra printmaking society film alliance saint ceramics festival quilting workshop workshops studio trio historical theatre company opera chamber guild friends puppet center art league club".split(), 60) | dict.fromkeys("theodore josephine alexander elizabeth zachary william richard inc official of the and".split(), 25)
LEXICON = names.Lexicon(COMMON, names.STOP | {"studio", "trio", "workshops", "inc", "official", "company"}, 5000)

SAME = [
    ("Morvodkocross Community Orchestra", "Morvodkocross Cmty Orch"), ("Theodore T. Morvodkocross", "T.T. MORVODKOCRJSS"), ("Printmaking Society of Morvodpogate", "PS - MORVODPOGATE"), ("Printmaking Society of Morvodpogate", "PrintmaingSocietyOfMorvodpogate"),
    ("Saint Wenibrifield's Film Alliance", "The St Wenibrifield's Film All."), ("Josephine N. Holennostow Trio", "Holennostow (Jo)"), ("Calagpenock Ceramics Festival", "Calagpenock C.F."), ("Alexander Kestelgagarth", "Kestelgagarth, A. H."),
    ("Quilting Workshop of Renunluden", "Workshop of Renunluuden (Quilting)"), ("Elizabeth Saletmahill", "Saletmahill, Betsy"), ("Historical Theatre Company of Calonveley", "Hist. Thtr. Co of Calonveley - official"),
    ("The Dover Art League", "Dover Art League, Inc."), ("Dover Art League", "Dovr Art League"), ("Arden Club", "The Ardan Club"), ("Richard Smith", "Smith, Dick"),
]
OTHER = [
    ("Saletmahill Puppet Center", "Saletmahill (Beth)"), ("Theodore T. Morvodkocross", "W.P. MORVODKOCROSS"), ("Renunluden Opera Festival", "Renunluden Chamber Festival"), ("Garigdaden Quilting Guild", "Friends of the Garigdaden Quilting Guild"),
    ("Zachary Holennostow Studio", "William T. Holennostow Workshops"), ("Dover Art League", "Lewes Art League"), ("Arden Club", "Arden Guild"), ("Richard Smith", "William Smith"),
]


def alike(a, b):
    return LEXICON.similarity(LEXICON.words(a), LEXICON.words(b))


@pytest.mark.parametrize(("a", "b"), SAME)
def test_same(a, b):
    assert alike(a, b) >= names.LINK and alike(b, a) == pytest.approx(alike(a, b), abs=0.05)


@pytest.mark.parametrize(("a", "b"), OTHER)
def test_other(a, b):
    assert alike(a, b) < names.LINK


def test_glued_names_are_parted_at_common_words():
    assert LEXICON.words("PRINTMAKINGSOCIETYOFMORVODPOGATE") == ["printmaking", "society", "of", "morvodpogate"]
    assert LEXICON.telling(LEXICON.words("The Morvodpogate Printmaikng Society")) == ["morvodpogate"] and LEXICON.telling(["art", "league"]) == ["art", "league"] and LEXICON.words("") == []


def test_bands_follow_the_collision_curve():
    r, b = names.tune_bands(0.42, 0.97)
    assert 1 - (1 - 0.42**r) ** b >= 0.97 and r * b <= 64
    rng, hits, n = random.Random(2), 0, 0
    for _ in range(400):
        t = "".join(rng.choices("abcdefghijklmnop", k=12))
        i = rng.randrange(12)
        u = t[:i] + rng.choice("qrstuv") + t[i + 1 :]
        x, y = names.gram_set(t), names.gram_set(u)
        if len(x & y) / len(x | y) >= 0.42:
            n += 1
            hits += bool(set(names.band_keys(t, r, b)) & set(names.band_keys(u, r, b)))
    assert n > 200 and hits / n >= 0.94


def corpus(seed):
    """Organisations of places and kinds in several spellings; nothing of it is known to the operator."""
    rng = random.Random(seed)
    places = ["".join(rng.choice("bdfgklmnprstvz") + rng.choice("aeiou") for _ in range(5)).title() + rng.choice(["ton", "wick", "field"]) for _ in range(90)]
    out = {}
    for k, (place, kind, body) in enumerate({(rng.choice(places), rng.choice("Jazz Puppet Ballet Opera Poetry Folk".split()), rng.choice("Society Council Festival Players Museum".split())) for _ in range(220)}):
        full = f"{place} {kind} {body}"
        i = rng.randrange(1, len(place) - 1)
        for v in (full, f"The {full}", full.upper(), f"{full}, Inc.", f"{place[:i]}{place[i + 1]}{place[i]}{place[i + 2 :]} {kind} {body}", f"{place} {kind[0]}.{body[0]}.", full.replace(" ", "")):
            out.setdefault(v, k)
    return out


def test_classes_learn_their_words(spark):
    truth = corpus(7)
    rows = [(v,) for v in truth] + [(next(iter(truth)),), (None,), ("  ",), ("???",)]
    df = spark.createDataFrame(rows, "name string")
    c = names.classes(df, "name")
    got = {r.name: (r.centre, r.n) for r in c.collect()}
    assert got.pop("???") == ("???", 1) and set(got) == set(truth) and got[next(iter(truth))][1] == 2
    pairs = {tuple(r) for r in names.pairs_of(c).collect()}
    want = {(a, b) for a in truth for b in truth if a.encode() < b.encode() and truth[a] == truth[b]}
    assert len(pairs & want) / len(want) >= 0.9 and len(pairs & want) / len(pairs) >= 0.9 and all(a.encode() < b.encode() for a, b in pairs)
    lexicon = names.learn(spark.createDataFrame([(v,) for v in truth], "name string"))
    assert {"jazz", "society", "the", "inc"} <= set(lexicon.common) and {"the", "inc"} <= lexicon.optional and not lexicon.optional & {"jazz", "society"}
    assert names.classes(df.limit(0), "name").count() == 0
