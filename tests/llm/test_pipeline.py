"""The pipeline: each stage's effect, and the whole of it on odd rows."""

import random
from collections import Counter

import numpy as np
import pytest

import corpus_pipeline
from graincode.llm import quality_fm
from graincode.llm.runtime import table

from . import test_text_ops as plain

SF = "/root/testdata/sf0.001"


def test_stages_take_effect(spark, tmp_path):
    docs, columns = table(spark, SF, "documents"), None
    before = {r["doc_id"]: r for r in docs.collect()}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = str(tmp_path / name)
        stage(spark, docs, SF).write.parquet(out)
        docs = spark.read.parquet(out)
        now = {r["doc_id"]: r for r in docs.collect()}
        assert now.keys() <= before.keys() and len(now) == docs.count()
        if k < len(corpus_pipeline.STAGES) - 1:
            columns = columns or table(spark, SF, "documents").columns
            assert docs.columns == columns
        before = now
    assert all(r["round_trip"] for r in before.values()) and len(before) > 50


def test_run_is_the_stages(spark):
    assert corpus_pipeline.run(spark, SF).count() > 50
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "lines", "near_dedup", "decontaminate", "tokens"]


def test_near_dedup_links_from_080(spark):
    base = [f"w{i}" for i in range(200)]
    near, far = list(base), list(base)
    for n, at in enumerate((20, 60, 100, 140)):
        near[at] = far[at] = f"x{n}"
    far[180], far[190] = "y", "z"
    shingles = lambda w: {tuple(w[k : k + 5]) for k in range(len(w) - 4)}
    a, b, c = shingles(base), shingles(near), shingles(far)
    assert 0.8 < len(a & b) / len(a | b) < 0.85 and len(a & c) / len(a | c) < 0.8
    schema = table(spark, SF, "documents").schema
    rows = lambda texts: spark.createDataFrame([(i, " ".join(t), "en", "s", 9) for i, t in enumerate(texts)], schema)
    stage = dict(corpus_pipeline.STAGES)["near_dedup"]
    assert {r["doc_id"] for r in stage(spark, rows([base, near]), SF).collect()} == {0}
    assert {r["doc_id"] for r in stage(spark, rows([base, far]), SF).collect()} == {0, 1}


def fixture_rows():
    """Documents with copies near and exact, a line of twelve documents and one of nine, passages of the benchmark, and no text."""
    rng, items = random.Random(8), [(1, plain.prose(500, 40)), (2, "Only four words here"), (3, None)]
    passage = items[0][1].split()
    texts = plain.near_corpus() + [None, "", plain.prose(77, 60) + " " + " ".join(passage[5:15]), plain.prose(78, 60) + " " + " ".join(passage[5:14])]
    texts += ["so only FOUR, words here: " + plain.prose(79, 30), " ".join(passage)]
    texts += [f"{plain.prose(600 + k, 40, 9000)}\n  Common LINE {'here' if k % 2 else 'HERE'}\n{plain.prose(700 + k, 20, 9000)}" for k in range(12)]
    texts += [f"{plain.prose(800 + k, 40, 9000)}\nrarer line" for k in range(9)]
    rng.shuffle(texts)
    return [(i, t, rng.choice(["en", "fr"]), f"s{i % 3}", None if i % 9 == 0 else len(t or "")) for i, t in enumerate(texts)], items


def plain_pipeline(rows, items, machine):
    """What each stage keeps, and the last stage's rows, one document at a time."""
    from tokenizers import Tokenizer

    left, stages = [], []
    for r in rows:
        _, index, value = quality_fm.features([(r[1] or "").encode()], [r[4]])
        x, f = value.astype(float), machine.factors[index].astype(float)
        pairs = sum(f[a] @ f[b] * x[a] * x[b] for a in range(len(x)) for b in range(a))
        if 1 / (1 + np.exp(-(machine.bias + machine.weights[index] @ x + pairs))) >= 0.3:
            left.append(r)
    stages.append([r[0] for r in left])
    key = lambda line: line.translate(plain.LOWER).strip(" \t\n\x0b\f\r")
    docs = Counter(k for r in left for k in {key(x) for x in (r[1] or "").split("\n")} if k)
    common = {k for k, n in docs.items() if n >= 10}
    texts = [(r[0], None if r[1] is None else "\n".join(x for x in r[1].split("\n") if key(x) not in common)) for r in left]
    stages.append(texts)
    one = {i for i, _, _, kept in plain.plain_components(texts, 5, 80) if kept}
    texts = [t for t in texts if t[0] in one]
    stages.append([i for i, _ in texts])
    bad = {r[0] for r in plain.plain_decontaminate(texts, items, 10) if r[-1]}
    texts = [t for t in texts if t[0] not in bad]
    stages.append([i for i, _ in texts])
    lib, own = Tokenizer.from_file(plain.VOCABULARY), {r[0]: r for r in rows}
    out = {}
    for i, t in texts:
        ids = lib.encode(t or "", add_special_tokens=False).ids
        out[i] = (own[i][2], own[i][3], len(ids), ids, True, own[i][4] if own[i][1] == t else len(t))
    return stages, common, out


def test_run_equals_plain_python(spark, tmp_path, monkeypatch):
    rows, items = fixture_rows()
    rng = np.random.default_rng(6)
    machine = quality_fm.Machine(-0.6, rng.normal(0, 0.3, quality_fm.SIZE), rng.normal(0, 0.02, (quality_fm.SIZE, quality_fm.RANK)))
    monkeypatch.setattr(corpus_pipeline, "learn", lambda docs, labels: machine)
    spark.createDataFrame(rows, table(spark, SF, "documents").schema).write.parquet(str(tmp_path / "documents.parquet"))
    bench = table(spark, SF, "benchmark").select("item_id", "text")
    spark.createDataFrame(items, "item_id long, text string").select(*[spark_column(bench, c) for c in bench.columns]).write.parquet(str(tmp_path / "benchmark.parquet"))
    table(spark, SF, "labels").limit(0).write.parquet(str(tmp_path / "labels.parquet"))
    stages, common, want = plain_pipeline(rows, items, machine)
    sizes = [len(rows), *(len(s) for s in stages)]
    assert sizes[0] > sizes[1] == sizes[2] > sizes[3] > sizes[4] > 20 and common == {"common line here"}, (sizes, common)
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert len(got) == len(want)
    assert {r["doc_id"]: (r["lang"], r["source"], r["n_tokens"], list(r["ids"]), r["round_trip"], r["n_chars"]) for r in got} == want


def spark_column(frame, name):
    from pyspark.sql import functions as F

    return F.col(name).cast(frame.schema[name].dataType)


ODD = [(1, None, "en", None, None), (2, "", None, "s", 0), (None, "a b c", "en", "s", 5), (3, "x y z " * 40, "en", "s", 9), (3, "x y z " * 40, "en", "s", 9)]
CLASH = [("score", 7.0), ("kept_text", "k"), ("n_lines", 1), ("n_dropped", 2), ("_tag", 3), ("_line_doc", 4), ("tag", 5), ("rep", 6), ("ids", 8), ("N_TOKENS", 9), ("round_trip", 10), ("h", 11)]


@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES])
def test_odd_rows(spark, monkeypatch, name):
    """Exactly the rows that stay of nulls, empty texts, repeated rows and columns of clashing names; no rows of no rows."""
    from pyspark.sql import functions as F

    monkeypatch.setattr(corpus_pipeline, "learn", lambda docs, labels: quality_fm.Machine(5.0))
    docs = spark.createDataFrame(ODD, table(spark, SF, "documents").schema).withColumns({c: F.lit(v) for c, v in CLASH})
    stage = dict(corpus_pipeline.STAGES)[name]
    got = stage(spark, docs, SF)
    if name == "tokens":
        from tokenizers import Tokenizer

        lib = Tokenizer.from_file(plain.VOCABULARY)
        ids = [tuple(lib.encode(r[1] or "", add_special_tokens=False).ids) for r in ODD]
        made = ["n_tokens", "ids", "round_trip"]
        others = [(c, v) for c, v in CLASH if c.lower() not in made]
        want = [(r[0], *r[2:], *(v for _, v in others), len(x), x, True) for r, x in zip(ODD, ids)]
        rows = [tuple(tuple(v) if isinstance(v, list) else v for v in r) for r in got.collect()]
        assert Counter(rows) == Counter(want)
        assert got.columns == [c for c in docs.columns if c.lower() not in ("text", *made)] + made
        assert {r["n_tokens"] for r in stage(spark, docs.select("doc_id", "text"), SF).collect()} == {len(x) for x in ids}
    else:
        extra = tuple(v for _, v in CLASH)
        want = Counter((*r, *extra) for r in (ODD[:4] if name == "near_dedup" else ODD))
        assert got.columns == docs.columns and Counter(tuple(r) for r in got.collect()) == want
    assert stage(spark, docs.limit(0), SF).count() == 0


def test_rejected_documents_leave(spark, monkeypatch):
    monkeypatch.setattr(corpus_pipeline, "learn", lambda docs, labels: quality_fm.Machine(-5.0))
    docs = spark.createDataFrame(ODD, table(spark, SF, "documents").schema)
    assert corpus_pipeline.quality(spark, docs, SF).count() == 0
