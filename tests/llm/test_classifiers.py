"""Classifiers: accuracy on rows held out, sums against brute force, and odd inputs."""

import math
import random
import re
import zlib
from collections import Counter

import numpy as np

from graincode.llm import quality_fm, toxicity

DOCS = "doc_id long, text string, n_chars long, score double, y int"


def good(rng):
    return " ".join(rng.choice("the of and to in is it that for as with was on are be this".split()) + rng.choice(["", "tion", "ing"]) for _ in range(rng.randrange(30, 120))) + "."


def junk(rng):
    return rng.choice([" | ".join(f"c{rng.randrange(99)}" for _ in range(40)), "BUY!! " * 30, " ".join(["spam"] * 60), "$$$ %%% " * 25])


def labelled(spark, make_one, make_zero, label, n=400):
    rng = random.Random(1)
    y = [int(rng.random() < 0.7) for _ in range(n)]
    rows = [(i, (make_one if v else make_zero)(rng), None, 0.0, 0) for i, v in enumerate(y)]
    docs = spark.createDataFrame([*rows, (9000, None, None, 0.0, 0), (9001, "", 3, 0.0, 0), (None, "x", 1, 0.0, 0), rows[0]], DOCS)
    return docs, spark.createDataFrame([(i, v) for i, v in enumerate(y)], f"doc_id long, {label} int"), y


def test_quality(spark):
    docs, labels, y = labelled(spark, good, junk, "quality")
    got = quality_fm.classify(docs, labels).collect()
    assert len(got) == docs.count() and all(0 <= r["score"] <= 1 for r in got)
    held = [r for r in got if r["held_out"] and r["doc_id"] is not None and r["doc_id"] < 9000]
    assert held and all((zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in held)
    assert np.mean([r["predicted"] == y[r["doc_id"]] for r in held]) > 0.95


def test_quality_without_labels(spark):
    docs, labels, _ = labelled(spark, good, junk, "quality", 20)
    assert {round(r["score"], 3) for r in quality_fm.classify(docs, labels.limit(0)).collect()} == {0.5}
    assert quality_fm.classify(docs.limit(0), labels).count() == 0


def test_linear_time_score_equals_pairs():
    rng = np.random.default_rng(0)
    m = quality_fm.Machine(0.3, rng.normal(size=quality_fm.SIZE), rng.normal(size=(quality_fm.SIZE, quality_fm.RANK)) / 5)
    doc, index, value = quality_fm.features([b"a b c a", b"", b"d e"], [7, None, 3])
    got = m.margins(doc, index, value, 3)
    for t in range(3):
        i, x = index[doc == t], value[doc == t].astype(float)
        pairs = sum(m.factors[i[a]] @ m.factors[i[b]] * x[a] * x[b] for a in range(len(i)) for b in range(a))
        assert abs(got[t] - (0.3 + m.weights[i] @ x + pairs)) < 1e-4


def plain_features(text, stated):
    """Index to value, from the definitions, a word and a character at a time."""
    m, out = quality_fm, {}
    raw = (text or "").encode()
    split = lambda b: [w for w in re.split(rb"[\x20\x09-\x0D]+", b) if w]
    counts = Counter(int(m.Words([w]).hash[0]) >> (64 - m.WORD_BITS) for w in split(raw.lower()))
    norm = math.sqrt(sum(math.log1p(n) ** 2 for n in counts.values()))
    out = {i: math.log1p(n) / norm for i, n in counts.items()}
    words, size = split(raw), len(raw) + 1
    count = lambda chars: sum(b in chars for b in raw)
    n, one = len(words), max(len(words), 1)
    upper, lower, wide = count(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"), count(b"abcdefghijklmnopqrstuvwxyz"), sum(b >= 0x80 for b in raw)
    letters, lines = max(upper + lower + wide, 1), raw.count(b"\n") + 1
    stats = [
        math.log2(n + 1) / 20, sum(map(len, words)) / one / 20, upper / letters, letters / size, count(b"0123456789") / size, count(b"!?") / one, count(b"|<>{}[]=") / one, count(b"#*$%&@^~_+") / one,
        len(set(words)) / one, sum(x == y for x, y in zip(words, words[1:])) / one, lines / one, wide / size, math.log2(size + 1) / 30,
    ]
    for k, x in enumerate(stats):
        for b in range(round(math.sqrt(min(max(x, 0), 1)) * (m.BINS - 1)) + 1):
            out[(1 << m.WORD_BITS) + k * (m.BINS + 1) + b] = 0.5
    at = (1 << m.WORD_BITS) + len(stats) * (m.BINS + 1)
    for b in [m.BINS] if stated is None else range(round(min(1.0, math.log2(max(stated, 0) + 1) / 30) * (m.BINS - 1)) + 1):
        out[at + b] = 0.5
    return out


def test_features_equal_brute_force():
    rng = random.Random(9)
    texts = ["", "a", "A b a  A\n\nß É!! 12|", "x x x y", *(good(rng) for _ in range(5)), *(junk(rng) for _ in range(5))]
    stated = [None, 0, 5, -3, *(rng.randrange(10**6) for _ in range(10))]
    doc, index, value = quality_fm.features([t.encode() for t in texts], stated)
    for t, (text, n) in enumerate(zip(texts, stated)):
        got, want = dict(zip(index[doc == t].tolist(), value[doc == t].tolist())), plain_features(text, n)
        assert got.keys() == want.keys() and all(abs(got[i] - want[i]) < 1e-5 for i in want), text


def toxic(rng):
    return good(rng) + " " + rng.choice(["you are an idiot", "a moron indeed", "such scumbags there", "lowei" + rng.choice(["chen", "ent", "ß"]) + " here"]) + ". " + good(rng)


def test_toxicity(spark):
    docs, labels, y = labelled(spark, toxic, good, "toxic")
    got = toxicity.classify(docs, labels).collect()
    held = [r for r in got if r["held_out"] and r["doc_id"] is not None and r["doc_id"] < 9000]
    assert len(got) == docs.count() and held
    assert np.mean([r["predicted"] == y[r["doc_id"]] for r in held]) > 0.97
    assert {r["predicted"] for r in got if r["doc_id"] in (9000, 9001)} == {0}


def test_toxic_terms_need_different_places(spark):
    """Words of copies, exact or near, are no insults, however many copies there are."""
    rng = random.Random(3)
    name = lambda: "".join(rng.choice("bcdfghjklmnpqrstvwxz") for _ in range(9))
    copied = [name() for _ in range(200)]
    near = lambda: " ".join(w if rng.random() > 0.01 else name() for w in copied)
    texts = [(" ".join(copied), 1)] * 40 + [(near(), 1) for _ in range(40)] + [(good(rng) + " " + name() + " zounderkite " + name(), 1) for _ in range(30)] + [(good(rng), 0) for _ in range(300)]
    docs = spark.createDataFrame([(i, t, None, 0.0, 0) for i, (t, _) in enumerate(texts)], DOCS)
    labels = spark.createDataFrame([(i, y) for i, (_, y) in enumerate(texts)], "doc_id long, toxic int")
    model = toxicity.learn(docs, labels)
    assert model.lexicon.insults.keys() - set(copied) == {"zounderkite"}
    assert len(model.lexicon.insults) < 20


def test_long_text_and_odd_columns(spark):
    """The last clause of a very long text counts; columns named like results are not read."""
    docs, labels, _ = labelled(spark, toxic, good, "toxic")
    long = "the of and. " * 100_000 + "you idiot"
    extra = spark.createDataFrame([(9100, long, None, 7.0, 3), (9101, "the of and. " * 100_000, None, 7.0, 3), (None, "you idiot", None, 7.0, 3)], DOCS)
    model = toxicity.learn(docs, labels)
    got = {r["doc_id"]: r["score"] for r in toxicity.score(extra, model).collect()}
    assert got[9100] >= 0.3 > got[9101] and got[None] == got[9100]
    machine = quality_fm.learn(docs.withColumn("quality", docs["y"]), labels.withColumnRenamed("toxic", "quality"))
    rows = quality_fm.score(extra, machine).collect()
    assert len(rows) == 3 and all(0 <= r["score"] <= 1 and r["y"] == 3 for r in rows)


def test_toxicity_without_labels(spark):
    docs, labels, _ = labelled(spark, toxic, good, "toxic", 20)
    assert {round(r["score"], 3) for r in toxicity.classify(docs, labels.limit(0)).collect()} == {0.5}
    assert toxicity.classify(docs.limit(0), labels).count() == 0


def test_patterns():
    g = toxicity.Grammar({"idiot": 1.0, "loweichen": 0.5})
    assert dict(g.patterns("What an IDIOT. Fine")) == {"insult_framed": 1}
    assert dict(g.patterns("he is not an idiot")) == {"insult_negated_framed": 1}
    assert dict(g.patterns("not at all in the end an idiot")) == {"insult_framed": 1}
    assert dict(g.patterns("she said idiot; idiot")) == {"insult_reported_framed": 1, "insult_framed_again": 1}
    assert dict(g.patterns("you loweichen, you never idiot")) == {"insult_aimed": 0.5, "insult_negated_aimed_listed": 1}  # three words follow the first
    assert dict(g.patterns("idiot, you")) == {"insult_aimed_framed": 1}
    assert dict(g.patterns("they were all so very idiot that day")) == {}  # the copula is too far off
    assert dict(g.patterns("they went on very idiot and loweichen that long day")) == {"insult_listed": 0.5}
    assert dict(g.patterns("and so on idiot went the day")) == {}  # a word by itself
    assert dict(g.patterns("and so on idiot went the day. Then. and so on loweichen went the day")) == {"insult_again": 0.5}
    assert dict(g.patterns("idiotic halowei")) == {} and dict(g.patterns("kill it")) == {}
    assert dict(g.patterns("I will kill it. kill you")) == {"threat_intended": 1, "threat_aimed": 1}
    assert dict(g.patterns("he said you must not kill")) == {"threat_negated_reported_aimed_intended": 1}
    assert set(g.patterns("you are an idiot. idiot, idiot! kill you, idiot")) <= set(toxicity.PATTERNS)


def test_lone_words_score_as_none(spark):
    """A learned insult that no clause pattern holds leaves a text at the base score; the same word in a frame does not."""
    docs, labels, _ = labelled(spark, toxic, good, "toxic")
    model = toxicity.learn(docs, labels)
    assert "idiot" in model.lexicon.insults
    assert model.score("and so on idiot went the day") == model.score("") < 0.3 <= model.score("and so on what an idiot went the day")


def test_composition_equals_brute_force():
    """The composed tables against the marks written out by their definitions, for random clauses."""
    rng, machine = random.Random(4), toxicity.machine()
    for _ in range(600):
        kinds, earlier = [rng.choice([*toxicity._KINDS, "INSULT", "OTHER", "OTHER"]) for _ in range(rng.randrange(1, 12))], rng.random() < 0.3
        for i, ((kind, marks), weight) in enumerate(machine.run([(k, ()) for k in kinds], earlier)):
            want = set()
            if kind in ("INSULT", "THREAT"):
                want |= {"aimed"} if "TARGET" in kinds else set()
                want |= {"negated"} if "NEGATION" in kinds[max(0, i - toxicity.SCOPE) : i] else set()
                want |= {"reported"} if "REPORT" in kinds[:i] else set()
                want |= {"intended"} if kind == "THREAT" and "INTENT" in kinds[:i] else set()
            if kind == "INSULT":
                framed = "DETERMINER" in kinds[max(0, i - 2) : i] or "COPULA" in kinds[max(0, i - toxicity.SCOPE) : i] or (i <= 2 and len(kinds) - 1 - i <= 2)
                want |= {"framed"} if framed else set()
                want |= {"listed"} if "INSULT" in kinds[:i] else set()
                want |= {"again"} if earlier else set()
            assert kind == kinds[i] and set(marks) == want and len(marks) == len(want)
            assert abs(weight - np.prod([toxicity.ARCS[m] for m in want])) < 1e-12


def test_lexicon_reads_letter_by_letter():
    lex = toxicity.Lexicon({"ab": 0.4, "abc": 0.6, "b": 1.0})
    assert [lex.read(w) for w in ("a", "ab", "abc", "abcd", "b", "", "you")] == [
        (("DETERMINER", ()), 1.0), (("INSULT", ()), 0.4), (("INSULT", ()), 0.6), (("OTHER", ()), 1.0), (("INSULT", ()), 1.0), (("OTHER", ()), 1.0), (("TARGET", ()), 1.0),
    ]
