"""Hard negatives, packing and the filter audit against plain Python on odd rows, and the queries against their SQL."""

import math
import os
import random
import re
import zlib
from collections import Counter, defaultdict
from itertools import permutations

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from graincode.llm import filter_audit, hard_negatives, packing
from graincode.llm.runtime import table

from ..test_oracles import canonical

SF = "/root/testdata/sf0.001"
VOCABULARY = pytest.importorskip("public_tokenizers").path("byte_bpe_50k.json")
WORD = re.compile(r"[^\x20\x09-\x0D]+")


# -- filter audit


def plain_audit(docs, labels):
    least = {}
    for i, text, _ in docs:
        if i is not None:
            least[text or ""] = min(i, least.get(text or "", i))
    good, toxic = ({d for d, *marks in labels if d is not None and marks[k] == 1} for k in (0, 1))
    by_part = defaultdict(list)
    for i, text, source in docs:
        t, w = text or "", WORD.findall(text or "")
        fails = {"A": len(w) < 200, "B": 100 * len(set(w)) < 50 * len(w), "C": 100 * len(re.findall("[A-Z]", t)) > 2 * len(t), "D": bool(re.search("[#$%&*|]", t)), "E": i is not None and least[t] < i}
        by_part[source or ""].append(({k for k, v in fails.items() if v}, i in good, i in toxic))
    out = []
    for part, rows in by_part.items():
        shapley, own = Counter(), []
        for order in map("".join, permutations("ABCDE")):
            left = rows
            for step, f in enumerate(order, 1):
                gone = [r for r in left if f in r[0]]
                redundant = sum(f in r[0] and bool(r[0] & set(order[: step - 1])) for r in rows)
                left = [r for r in left if f not in r[0]]
                shapley[f] += len(gone)
                own.append([part, order, step, len(left), len(gone), redundant, sum(r[0] == {f} for r in rows), sum(r[1] for r in gone), sum(r[2] for r in gone)])
        out += [(*x, shapley[x[1][x[2] - 1]]) for x in own]
    return sorted(out)


def audit_rows():
    rng = random.Random(4)
    many = " ".join(f"w{k}" for k in range(300))
    texts = [None, "", " \n", "A few Words", many, many, many + " #", "SHOUT " * 250, " ".join(rng.choice("ab") for _ in range(400)), "É" * 900, many.upper(), "x " * 20_000, "50% of a|b"]
    docs = [(k, t, rng.choice(["s0", "s1", None, ""])) for k, t in enumerate(texts * 3)]
    docs += [(None, many, "s0"), (None, "own", "s9"), (4, many, "s0"), (4, many, "s1"), (7, "another text of id 7", "s1")]
    docs += [(1000 + k, "copy of a third of all", "hot") for k in range(40)]
    labels = [(k, k % 2, int(k % 3 == 0)) for k in range(0, 60, 2)] + [(4, 1, 0), (None, 1, 1), (9999, 1, 1), (1003, None, 1)]
    return docs, labels


def test_audit_equals_plain_python(spark):
    docs, labels = audit_rows()
    d = spark.createDataFrame(docs, "doc_id long, text string, source string").withColumns({"part": F.lit(1), "mask": F.lit("m"), "copy": F.lit(2), "n": F.lit(3), "good": F.lit("g")}).repartition(5)
    lab = spark.createDataFrame(labels, "doc_id long, quality int, toxic int").withColumn("id", F.lit("x"))
    got = filter_audit.audit(d, lab, F.col("source"))
    assert sorted(tuple(r) for r in got.collect()) == plain_audit(docs, labels)
    assert [f.dataType.simpleString() for f in got.schema] == ["string", "string", "int"] + ["bigint"] * 7


def test_audit_of_nothing(spark):
    docs, labels = audit_rows()
    d, lab = spark.createDataFrame(docs, "doc_id long, text string, source string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    assert filter_audit.audit(d.limit(0), lab, F.col("source")).count() == 0
    unlabelled = sorted(tuple(r) for r in filter_audit.audit(d, lab.limit(0), F.col("source")).collect())
    assert unlabelled == plain_audit(docs, []) and not any(r[7] or r[8] for r in unlabelled)


def test_outcome_matrices():
    made = filter_audit.outcome_matrices()
    assert all(m.shape == (32, 600) and set(np.unique(m)) <= {0, 1} for m in made.values())
    shown = made["removed"].reshape(32, 120, 5)
    assert (shown.sum(axis=2) == (np.arange(32) > 0)[:, None]).all()  # each failing document leaves once in each order
    assert (made["kept"].reshape(32, 120, 5)[:, :, 4] == (np.arange(32) == 0)[:, None]).all()


# -- packing


def lower_bound(lengths, capacity):
    """Tokens, and documents above half the capacity, no two of which share a sequence."""
    return max(-(-sum(lengths) // capacity), sum(2 * n > capacity for n in lengths))


def placed(lengths, capacity):
    """Sequences of lengths as the runs of a matching place them."""
    runs, made = packing.matching(Counter(lengths), capacity)
    bins, seen = defaultdict(list), Counter()
    for n in lengths:
        run = max((r for r in runs.tolist() if r[0] == n and r[1] <= seen[n]), key=lambda r: r[1])
        row, col = divmod(seen[n] - run[1], run[2])
        bins[run[3] + row].append((run[4] + col * n, n))
        seen[n] += 1
    assert sorted(bins) == list(range(made))
    for rows in bins.values():
        at = 0
        for offset, n in sorted(rows):
            assert offset == at
            at += n
        assert at <= capacity
    return bins


def best_fit(lengths, capacity):
    """The method one piece at a time: pairs of large ones, largest first, then best fit of the small ones."""
    large = sorted((n for n in lengths if 3 * n > capacity), reverse=True)
    rooms = []
    while large:
        a = large.pop(0)
        mate = next((b for b in large if a + b <= capacity), None)
        if mate is not None:
            large.remove(mate)
        rooms.append(capacity - a - (mate or 0))
    for n in sorted((n for n in lengths if 3 * n <= capacity), reverse=True):
        fit = min((r for r in rooms if r >= n), default=None)
        if fit is None:
            rooms.append(capacity - n)
        else:
            rooms[rooms.index(fit)] -= n
    return len(rooms)


@pytest.mark.parametrize("seed", range(12))
def test_matching_is_the_method(seed):
    rng = random.Random(seed)
    capacity = rng.choice([7, 24, 100, 1024])
    top = rng.choice([capacity, max(1, capacity // 3), max(1, capacity // 2 + 1)])
    lengths = [min(capacity, max(1, int(rng.lognormvariate(math.log(max(top / 4, 1)), 1)))) if seed % 2 else rng.randint(1, top) for _ in range(rng.choice([1, 30, 700]))]
    bins = placed(lengths, capacity)
    assert len(bins) == best_fit(lengths, capacity)
    assert len(bins) <= 1.03 * lower_bound(lengths, capacity) + 2 or min(3 * n for n in lengths) > capacity


def test_matching_of_large_pieces_is_exact():
    """No two-a-sequence packing needs fewer sequences: against the largest number of pairs by exhaustive matching."""
    rng = random.Random(5)
    for _ in range(60):
        lengths = [rng.randint(35, 100) for _ in range(rng.randint(1, 9))]

        def pairs(rest):
            if len(rest) < 2:
                return 0
            return max([pairs(rest[1:]), *(1 + pairs(rest[1:k] + rest[k + 1 :]) for k in range(1, len(rest)) if rest[0] + rest[k] <= 100)])

        assert len(placed(lengths, 100)) == len(lengths) - pairs(lengths)


def test_matching_rejects_what_does_not_fit():
    assert packing.matching({}, 10)[1] == 0 and packing.matching({3: 0}, 10)[1] == 0
    for n in (0, 11):
        with pytest.raises(ValueError):
            packing.matching({n: 1}, 10)


def test_edges():
    assert packing.edges(1, 4) == [0, 1] and packing.edges(4, 4) == [0, 4]
    assert packing.edges(9, 4) == [0, 1, 5, 9] and packing.edges(8, 4) == [0, 4, 8]


def packing_docs():
    rng = random.Random(9)
    texts = [None, "", " ", "one two", "é" * 700, "a b " * 3000, "x" * 9000, "<|endoftext|> in <|endoftext|>", "\n \n" * 500, "word " * 1023, "word " * 1024, "日本語 " * 400]
    texts += [" ".join(f"w{rng.randrange(999)}" for _ in range(int(rng.lognormvariate(4, 1.2)))) for _ in range(150)]
    return [*enumerate(texts), (None, "no id"), (None, None), *[(5, "same text")] * 60]


def test_packing_equals_the_library(spark):
    from tokenizers import Tokenizer

    lib, rows = Tokenizer.from_file(VOCABULARY), packing_docs()
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit(7) for c in ("piece", "length", "nth", "sequence_id", "offset", "_part")}).repartition(4)
    got = packing.pack(packing.cut_documents(docs, VOCABULARY, 2, 1024), 1024).collect()
    want, lengths = Counter(), []
    for i, text in rows:
        ids = [*lib.encode(text or "", add_special_tokens=False).ids, 2]
        places = packing.edges(len(ids), 1024)
        for k, (a, b) in enumerate(zip(places, places[1:])):
            want[i, k, a, b - a, zlib.crc32(np.array(ids[a:b], dtype="<u4").tobytes())] += 1
            lengths.append(b - a)
    assert Counter(tuple(r)[:5] for r in got) == want
    bins = defaultdict(list)
    for r in got:
        bins[r["sequence_id"]].append((r["offset"], r["length"]))
    for own in bins.values():
        at = 0
        for offset, n in sorted(own):
            assert offset == at
            at += n
        assert at <= 1024
    assert len(bins) == best_fit(lengths, 1024) <= lower_bound(lengths, 1024) + 2
    assert packing.pack(packing.cut_documents(docs.limit(0), VOCABULARY, 2, 1024), 1024).count() == 0


def test_packing_beyond_the_broadcast(spark, monkeypatch):
    monkeypatch.setattr(packing, "broadcast_if", lambda df, rows: df)
    items = spark.range(5000).select(F.col("id"), (F.col("id") % 17 + 1).alias("length")).repartition(7)
    got = packing.pack(items, 20).groupBy("sequence_id").agg(F.sum("length").alias("n"), F.max(F.col("offset") + F.col("length")).alias("end")).collect()
    assert all(r["n"] == r["end"] <= 20 for r in got) and sum(r["n"] for r in got) == sum(k % 17 + 1 for k in range(5000))


def test_packed_sequences_hold_the_ids(spark):
    docs = spark.createDataFrame(packing_docs(), "doc_id long, text string")
    whole = packing.packed_sequences(docs, VOCABULARY, 2, 512).collect()
    pieces = packing.cut_documents(docs, VOCABULARY, 2, 512, with_ids=True).collect()
    cut = Counter(tuple(r["ids"][a:b]) for r in whole for a, b in zip(r["offsets"], [*r["offsets"][1:], len(r["ids"])]))
    assert cut == Counter(tuple(p["ids"]) for p in pieces) and all(len(r["ids"]) <= 512 for r in whole)


def test_other_vocabulary_files_go_to_the_library():
    other = packing.Encoder(__import__("public_tokenizers").path("word_bpe_49k.json"))
    assert other.fast is None and len(other("some words")) == 2
    assert packing.Encoder(VOCABULARY).fast is not None


# -- hard negatives


def plain_mine(rows, k=5, floor=80):
    own = {}
    for i, label, v in rows:
        if i is not None and label is not None and v is not None and all(x is not None and math.isfinite(x) for x in v):
            own[i, label, tuple(math.floor(256 * x) for x in v)] = None
    out = []
    dot = lambda a, b: sum(x * y for x, y in zip(a, b))
    for a in own:
        if a[0] % 10:
            continue
        scored = sorted(((-dot(a[2], b[2]), b[0], b[1]) for b in own if b[0] != a[0]))
        for s, p, _ in [x for x in scored if x[2] == a[1]][:k]:
            fit = [(n, i) for n, i, label in scored if label != a[1] and 80 * -s <= 100 * -n <= 100 * -s][:k]
            out += [(a[0], p, r, i, -s, -n) for r, (n, i) in enumerate(fit, 1)]
    return Counter(out)


def vectors(seed, n, dim=6, spread=1.0, odd=True):
    rng = random.Random(seed)
    centres = [[rng.gauss(0, 1) for _ in range(dim)] for _ in range(5)]
    rows = [(i, rng.randrange(3), [c + rng.gauss(0, 0.2) * spread for c in rng.choice(centres)]) for i in range(n)]
    if odd:
        rows += [(n, None, [1.0] * dim), (n + 1, 1, None), (n + 2, 1, [None] * dim), (n + 3, 1, [float("nan")] * dim), (n + 4, 1, [float("inf")] * dim), (None, 1, [1.0] * dim)]
        rows += [(10, 2, [0.5] * dim), (10, 1, [0.5] * (dim - 2)), (20, 0, []), (30, 1, [0.0] * dim), (31, 1, [])]
        rows += [(500 + i, i % 2, list(rows[0][2])) for i in range(40)] + rows[:5]
    return rows


def mined(spark, rows, **options):
    df = spark.createDataFrame(rows, "vec_id long, label int, embedding array<float>").withColumns({"id": F.lit("i"), "v": F.lit(1), "anchor": F.lit(2), "key": F.lit(3), "cell": F.lit(4)}).repartition(3)
    own = hard_negatives.integer_vectors(df, F.col("label"), F.col("vec_id") % 10 == 0, 256, "vec_id", "embedding")
    return Counter(tuple(r) for r in hard_negatives.mine(own, **options).collect())


def single(rows):
    return [(i, label, None if v is None else [None if x is None else float(np.float32(x)) for x in v]) for i, label, v in rows]


@pytest.mark.parametrize(("seed", "slab", "block_bytes"), [(1, 4096, 1 << 26), (2, 16, 1 << 26), (3, 7, 900)])
def test_mining_equals_plain_python(spark, monkeypatch, seed, slab, block_bytes):
    """Also with slabs of a few rows, rounds of a few anchors, and lists handed on early."""
    monkeypatch.setattr(hard_negatives, "SLAB", slab)
    monkeypatch.setattr(hard_negatives, "BLOCK", 4)
    monkeypatch.setattr(hard_negatives, "BLOCK_BYTES", block_bytes)
    monkeypatch.setattr(hard_negatives, "HELD", 1 << 20 if seed == 1 else 3)
    rows = single(vectors(seed, 160))
    want = plain_mine(rows)
    assert mined(spark, rows) == want and len(want) > 50


def test_mining_of_little(spark):
    schema = single([(3, 1, [1.0, 2.0])])
    assert not mined(spark, []) and not mined(spark, schema)  # no rows; no anchor
    assert not mined(spark, single([(0, 1, [1.0]), (1, 1, [1.0])])) and not mined(spark, single([(0, 1, [1.0]), (1, 2, [1.0])]))
    assert mined(spark, single([(0, 1, [1.0]), (1, 1, [1.0]), (2, 2, [0.9]), (3, 2, [1.1])])) == Counter({(0, 1, 1, 2, 65536, 58880): 1})


def test_mining_of_large_components(spark):
    rows = single([(i, i % 2, [3e12 + i * 1e9, -1e3 * i]) for i in range(20)])
    with pytest.raises(Exception, match="too large|too big|overflow|Overflow|int"):
        mined(spark, rows)
    rows = single([(i, i % 2, [2e6 + i, 1e5 * i]) for i in range(20)])  # products beyond 2^53, sums within a long
    assert mined(spark, rows) == plain_mine(rows)


def test_brackets_hold_and_leave_out(spark):
    """Every row outside the brackets really scores outside the range, and in clustered vectors most rows are outside."""
    rng = np.random.default_rng(3)
    x = np.floor(256 * (np.repeat(rng.normal(size=(8, 16)) * 3, 250, axis=0) + rng.normal(size=(2000, 16)) * 0.1)).astype(np.int64)
    own = hard_negatives.Pivots(x[::7], 16, float((x.astype(float) ** 2).sum(axis=1).max()), 16)
    t = own.rows(x)
    order = np.lexsort((t.min(axis=1), t.argmin(axis=1)))
    x, t = x[order], t[order]
    row = {"n": len(x), "dim": 16, "low": t.min(axis=0), "high": t.max(axis=0), "ids": np.arange(len(x)).tobytes(), "labels": np.zeros(len(x), np.int64).tobytes(), "marks": bytes(len(x)), "vectors": x.astype(np.int32).tobytes(), "dists": np.ascontiguousarray(t.T).tobytes()}
    slab, left = hard_negatives.Slab(row), []
    for a in range(0, 2000, 97):
        scores = x @ x[a]
        low, high = int(np.partition(scores, -100)[-100]), int(scores.max())
        dq = own.anchors(x[a : a + 1])[0]
        alive = slab.survivors(dq, float((x[a] ** 2).sum() + own.most), low, high, hard_negatives.SLACK * (1 + own.most**0.5))
        assert alive[(scores >= low) & (scores <= high)].all()
        left.append(alive.mean())
    assert np.median(left) < 0.6


# -- queries


@pytest.mark.parametrize("name", ["op11_hard_negatives", "op13_filter_audit"])
def test_same_rows_as_sql(spark, name):
    if not os.path.isdir(SF):
        pytest.skip("no test tables")
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{SF}/{f}'")
    assert canonical(entry.queries()[name](spark, SF).toPandas()).equals(canonical(con.execute(entry.oracle_sql()[name]).df()))


def test_packing_query(spark):
    """The registered query: the pieces of every document, by the library, packed near the lower bound."""
    from tokenizers import Tokenizer

    lib = Tokenizer.from_file(VOCABULARY)
    docs = table(spark, SF, "documents").select("doc_id", "text").collect()
    got = entry.queries()["op12_best_fit_packing"](spark, SF)
    assert dict(got.dtypes) == {"doc_id": "bigint", "piece": "int", "start": "bigint", "length": "bigint", "ids_crc32": "bigint", "sequence_id": "bigint", "offset": "bigint"}
    rows = got.collect()
    want = Counter()
    for r in docs:
        ids = [*lib.encode(r["text"] or "", add_special_tokens=False).ids, 2]
        places = packing.edges(len(ids), 1024)
        want.update((r["doc_id"], k, a, b - a, zlib.crc32(np.array(ids[a:b], dtype="<u4").tobytes())) for k, (a, b) in enumerate(zip(places, places[1:])))
    assert Counter(tuple(r)[:5] for r in rows) == want
    lengths = [r["length"] for r in rows]
    assert len({r["sequence_id"] for r in rows}) == best_fit(lengths, 1024)
