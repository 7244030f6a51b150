"""Toxicity: a weighted finite-state grammar over clauses.

Method: weighted transducers. A letter transducer reads a word and writes INSULT or THREAT with the term's weight, or TARGET, INTENT, NEGATION,
REPORT, DETERMINER, COPULA or OTHER. Over a clause, negation marks what follows within ``SCOPE`` words, reported speech the rest of the clause, intent
the threats after it, and a target, which reads the clause in both directions, every insult and threat of it. An insult is framed if a
determiner stands at most two words before it, a copula at most ``SCOPE``, or if at most two words stand on either side of it in its clause (an
exclamation, a form of address); it is listed after another insult of its clause, and comes again after an earlier clause with one: this state alone is
carried from clause to clause. Each arc that marks has a weight. The clause transducers are composed, weights multiplied, to one machine for each
direction. A clause is matched by a pattern, not by a word: an insult that is aimed, framed, listed or comes again, or a threat that is aimed or
intended. A word by itself, insult or threat, matches nothing. A matched clause counts, for its pattern, the weight of its best path. A text's score
is the logistic function of the weighted patterns.

Insults are learned: a word's weight is the probability that it is one, from the number of different places (the words before and
after) in which toxic texts hold it, or of distinct toxic texts if there are fewer, and the number of distinct clean texts that do. Copies of a
text, exact or near, show a word in one place, however many there are. Pattern weights are fitted by logistic regression on top of the arcs' product. Both use at most
``TRAIN_ROWS`` labelled rows, which bounds the model. The closed word classes are fixed values, below.

Defined cases: a null or empty text has no clause and gets the base score; a text of any length is read whole, clause by clause; without labels
of both classes the lexicon is empty and the score is the share of label 1 (0.5 without any); every input row gives one output row, repeated
rows and null ids too; an empty table gives no rows; other columns, whatever their names, are not read.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .labelled import fold, training_rows
from .runtime import cut, releasing, text_batches

#: Labelled rows to learn from, and words after a negation that it covers.
TRAIN_ROWS, SCOPE = 10_000, 3
#: How rare insults are among words, the share of places of an insult that are toxic, places that it needs, and the least weight of a term.
PRIOR, TOXIC_PLACES, MIN_PLACES, MIN_WEIGHT = 2e-4, 0.97, 3, 0.3
#: What the marks count, until labels say otherwise.
ARCS = {"negated": 0.5, "reported": 0.6, "aimed": 1.2, "intended": 1.2, "framed": 1.0, "listed": 1.2, "again": 1.0}
#: Closed word classes in English, German, French and Spanish.
NEGATIONS = "not never no isn aren don cannot nicht kein keine nie niemals pas jamais non nunca jamás tampoco".split()
REPORTS = "said says wrote writes quoted quotes reported claimed sagte schrieb zitierte dit écrit cité dijo escribió citó".split()
TARGETS = "you your yours u du dich dein ihr euch sie tu toi ton vous votre tú tus usted ustedes".split()
INTENTS = "will gonna going shall ll should must werde werden soll muss vais allons doit voy vamos debe".split()
DETERMINERS = "a an such what this these those ein eine einen solch solche un une quel quelle una unos qué".split()
COPULAS = "is are am was were be been bist sind seid war waren ist est êtes sont était eres soy son era".split()
THREATS = "kill murder hurt destroy attack shoot stab töten umbringen schlagen tuer frapper détruire matar golpear destruir".split()

WORD = re.compile(r"[^\W\d_]+")
CLAUSE = re.compile(r"[^.!?;:\n]+")
_KINDS = ("INSULT", "THREAT", "TARGET", "INTENT", "NEGATION", "REPORT", "DETERMINER", "COPULA", "OTHER")
_HEADS = ("INSULT", "THREAT")
#: Marks of which a clause's insult, or threat, needs one.
NEEDS = {"INSULT": {"aimed", "framed", "listed", "again"}, "THREAT": {"aimed", "intended"}}
#: Marks that an insult, or a threat, can have.
_CAN = {"INSULT": [m for m in ARCS if m != "intended"], "THREAT": ["negated", "reported", "aimed", "intended"]}


def _name(kind: str, marks) -> str:
    return "_".join([kind.lower(), *[m for m in ARCS if m in marks]])


PATTERNS = tuple(
    _name(kind, marks) for kind in _HEADS for bits in range(1 << len(_CAN[kind])) for marks in [{m for i, m in enumerate(_CAN[kind]) if bits >> i & 1}] if marks & NEEDS[kind]
)


class Transducer:
    """Deterministic and weighted: step(state, symbol) gives (state, symbol, weight)."""

    def __init__(self, start, step):
        self.start, self.step = start, step

    def then(self, other: "Transducer") -> "Transducer":
        """Composition: what this one writes the other reads; weights are multiplied."""

        def step(state, symbol):
            a, out, x = self.step(state[0], symbol)
            b, out, y = other.step(state[1], out)
            return (a, b), out, x * y

        return Transducer((self.start, other.start), step)

    def table(self, symbols, *starts) -> dict:
        """All transitions that are reachable from its start or the given ones, so that running it is one look-up a word."""
        starts = starts or (self.start,)
        moves, todo, seen = {}, [*starts], {*starts}
        while todo:
            state = todo.pop()
            for symbol in symbols:
                to, out, weight = moves[state, symbol] = self.step(state, symbol)
                if to not in seen:
                    seen.add(to)
                    todo.append(to)
        return moves


def _marked(symbol, mark: str):
    kind, marks = symbol
    return (kind, (*marks, mark)), ARCS[mark]


def _negation(state: int, symbol):
    if symbol[0] == "NEGATION":
        return SCOPE, symbol, 1.0
    out, weight = _marked(symbol, "negated") if state and symbol[0] in _HEADS else (symbol, 1.0)
    return max(0, state - 1), out, weight


def _latch(trigger: str, mark: str, heads: tuple[str, ...] = _HEADS):
    """Marks the heads after a trigger."""

    def step(state: bool, symbol):
        out, weight = _marked(symbol, mark) if state and symbol[0] in heads and mark not in symbol[1] else (symbol, 1.0)
        return state or symbol[0] == trigger, out, weight

    return step


def _late(after: int, symbol):
    """Read backwards: tells the forward machine which insults have at most two words after them."""
    out = (symbol[0], (*symbol[1], "late")) if symbol[0] == "INSULT" and after <= 2 else symbol
    return min(after + 1, 3), out, 1.0


def _frame(state: tuple[int, int], symbol):
    """State: words before (three stand for more), and words that a determiner or copula still covers."""
    before, open_ = state
    kind, weight, out = symbol[0], 1.0, symbol
    if kind == "INSULT":
        out = kind, tuple(m for m in symbol[1] if m != "late")
        if open_ or (before <= 2 and "late" in symbol[1]):
            out, weight = _marked(out, "framed")
    return (min(before + 1, 3), {"DETERMINER": max(2, open_ - 1), "COPULA": SCOPE}.get(kind, max(0, open_ - 1))), out, weight


def _again(earlier: bool, symbol):
    """Marks insults where an earlier clause held one; the state changes between clauses only."""
    out, weight = _marked(symbol, "again") if earlier and symbol[0] == "INSULT" else (symbol, 1.0)
    return earlier, out, weight


class Machine:
    """The composed grammar: one machine reads a clause backwards (targets and words that follow), one forwards (the rest)."""

    def __init__(self):
        aim = _latch("TARGET", "aimed")
        self.back = Transducer(False, aim).then(Transducer(0, _late))
        forth = Transducer(False, aim)
        for start, step in (
            (0, _negation), (False, _latch("REPORT", "reported")), (False, _latch("INTENT", "intended", ("THREAT",))),
            ((0, 0), _frame), (False, _latch("INSULT", "listed", ("INSULT",))),
        ):
            forth = forth.then(Transducer(start, step))
        self.starts = [(forth.start, earlier) for earlier in (False, True)]
        self.forth = forth.then(Transducer(False, _again))
        self.back_moves = self.back.table([(k, ()) for k in _KINDS])
        self.forth_moves = self.forth.table(sorted({out for _, out, _ in self.back_moves.values()}), *self.starts)

    def run(self, symbols: list, earlier: bool = False) -> list:
        """(kind, marks) and the weight of the arcs, of each symbol of a clause; earlier: whether a clause before it held an insult."""
        state, out = self.back.start, []
        for s in reversed(symbols):
            state, symbol, weight = self.back_moves[state, s]
            out.append((symbol, weight))
        state, both = self.starts[earlier], []
        for s, before in reversed(out):
            state, symbol, weight = self.forth_moves[state, s]
            both.append((symbol, before * weight))
        return both


@cache
def machine() -> Machine:
    """The composed tables, made once a process: they hold no learned value."""
    return Machine()


class Lexicon:
    """The letter transducer: reads a word, and writes a symbol and a weight."""

    def __init__(self, insults: dict[str, float]):
        self.insults, self.moves, self.final = insults, {}, {}
        for kind, words in (("TARGET", TARGETS), ("INTENT", INTENTS), ("NEGATION", NEGATIONS), ("REPORT", REPORTS), ("DETERMINER", DETERMINERS), ("COPULA", COPULAS), ("THREAT", THREATS)):
            for w in words:
                self._add(w, kind, 1.0)
        for w, weight in sorted(insults.items()):
            self._add(w, "INSULT", weight)
        self.heads = frozenset([*insults, *THREATS])

    def _add(self, word: str, kind: str, weight: float) -> None:
        state = 0
        for letter in word:
            state = self.moves.setdefault((state, letter), len(self.moves) + 1)
        self.final[state] = (kind, ()), weight

    def read(self, word: str):
        state = 0
        for letter in word:
            state = self.moves.get((state, letter))
            if state is None:
                return _OTHER
        return self.final.get(state, _OTHER)


_OTHER = ("OTHER", ()), 1.0


class Grammar:
    def __init__(self, insults: dict[str, float], weights: np.ndarray | None = None, bias: float = 0.0):
        self.lexicon, self.machine, self.weights, self.bias = Lexicon(insults), machine(), weights, bias

    def patterns(self, text: str) -> Counter:
        """Matched patterns of all clauses of a text, each with the weight of its terms' best path."""
        out: Counter = Counter()
        text, heads, earlier = text.lower(), self.lexicon.heads, False
        if heads.isdisjoint(WORD.findall(text)):
            return out
        for clause in CLAUSE.findall(text):
            words = WORD.findall(clause)
            if heads.isdisjoint(words):
                continue
            read, best = [self.lexicon.read(w) for w in words], {}
            for ((kind, marks), _), (_, weight) in zip(self.machine.run([s for s, _ in read], earlier), read):
                if kind in NEEDS and not NEEDS[kind].isdisjoint(marks):
                    name = _name(kind, marks)
                    best[name] = max(best.get(name, 0.0), weight)
            earlier = earlier or any(s[0] == "INSULT" for s, _ in read)
            out.update(best)
        return out

    def vector(self, text: str) -> np.ndarray:
        got = self.patterns(text)
        return np.array([math.log1p(got[p]) for p in PATTERNS]) if got else _NONE

    def score(self, text: str) -> float:
        margin = self.bias + (float(self.vector(text) @ self.weights) if self.weights is not None else 0.0)
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, margin))))


_NONE = np.zeros(len(PATTERNS))


def arc_weight(pattern: str) -> float:
    """The product of the arcs that mark a pattern, as the composed machine has it."""
    return math.prod(ARCS[m] for m in pattern.split("_")[1:])


def _places(batches):
    """Of toxic texts: each word with the words before and after it; new marks one row of each word in a text."""
    for batch in batches:
        terms, places, new = [], [], []
        for text in batch.column(0).to_pylist():
            words, seen = ["", *WORD.findall((text or "").lower()), ""], set()
            for before, word, after in set(zip(words, words[1:], words[2:])):
                terms.append(word)
                places.append(f"{before} {after}")
                new.append(int(word not in seen))
                seen.add(word)
        yield pa.RecordBatch.from_arrays([pa.array(terms, pa.string()), pa.array(places, pa.string()), pa.array(new, pa.int32())], ["term", "place", "new"])


def insult_weight(toxic: int, clean: int, share: float) -> float:
    """The probability that a word of so many toxic and clean texts is an insult, where ``share`` of all texts are toxic."""
    share = min(share, TOXIC_PLACES - 0.01)
    logit = math.log(PRIOR) + toxic * math.log(TOXIC_PLACES / share) + clean * math.log((1 - TOXIC_PLACES) / (1 - share))
    return 1 / (1 + math.exp(-max(-50.0, min(50.0, logit))))


def fit_weights(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, float]:
    """Logistic regression by Newton steps: a common weight times each pattern's arcs, and a ridged deviation of each pattern."""
    arcs, n = np.array([arc_weight(p) for p in PATTERNS]), len(y)
    full = np.concatenate((x, (x @ arcs)[:, None], np.ones((n, 1))), axis=1)
    w = np.zeros(full.shape[1])
    ridge = np.diag([*np.full(x.shape[1], 1.0), 0.02, 1e-6])
    for _ in range(40):
        p = 1 / (1 + np.exp(-np.clip(full @ w, -30, 30)))
        step = np.linalg.solve((full * (p * (1 - p))[:, None]).T @ full + ridge, full.T @ (p - y) + ridge @ w)
        w = w - np.clip(step, -2, 2)
    return np.maximum(w[:-2] + w[-2] * arcs, 0), float(w[-1])


def learn(docs: DataFrame, labels: DataFrame, label: str = "toxic", folds: int = 4, held: int = 2, rows: int = TRAIN_ROWS, id_col: str = "doc_id", text_col: str = "text") -> Grammar:
    text_batches(docs.sparkSession)
    slim = docs.select(F.col(id_col).cast("string").alias("id"), F.col(text_col).cast("string").alias("text"))
    sample = training_rows(slim, labels.select(F.col(id_col).cast("string").alias("id"), label), label, folds, held, rows, "id").select("text", "y", "id")
    distinct = cut(sample.groupBy(F.coalesce("text", F.lit("")).alias("text"), "y").agg(F.min("id").alias("id")))  # copies of a text are no evidence; at most ``rows`` rows
    sizes = {r["y"]: r["n"] for r in distinct.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    toxic, clean = sizes.get(1, 0), sizes.get(0, 0)
    if not toxic or not clean:
        rate = (toxic + 0.5) / (toxic + clean + 1)
        return Grammar({}, None, math.log(rate / (1 - rate)))
    places = distinct.where("y = 1").select("text").mapInArrow(_places, "term string, place string, new int")
    places = places.groupBy("term", "place").agg(F.sum("new").alias("new")).groupBy("term").agg(F.least(F.count(F.lit(1)), F.sum("new")).alias("n"))
    terms = {r["term"]: r["n"] for r in places.where(F.col("n") >= MIN_PLACES).toLocalIterator()}

    def seen(batches):
        """How many clean texts hold each term."""
        held_by: Counter = Counter()
        for batch in batches:
            for text in batch.column(0).to_pylist():
                held_by.update(terms.keys() & WORD.findall((text or "").lower()))
        yield pa.RecordBatch.from_arrays([pa.array(held_by.keys(), pa.string()), pa.array(held_by.values(), pa.int64())], ["term", "n"])

    in_clean = {r["term"]: r["n"] for r in distinct.where("y = 0").select("text").mapInArrow(seen, "term string, n long").groupBy("term").agg(F.sum("n").alias("n")).toLocalIterator()}
    share = toxic / (toxic + clean)
    closed = {*TARGETS, *INTENTS, *NEGATIONS, *REPORTS, *DETERMINERS, *COPULAS, *THREATS}
    insults = {t: w for t, n in terms.items() if t not in closed and (w := insult_weight(n, in_clean.get(t, 0), share)) >= MIN_WEIGHT}
    model = Grammar(insults)

    def vectors(batches):
        for batch in batches:
            x = [model.vector(t or "").tolist() for t in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(1), pa.array(x, pa.list_(pa.float64())), batch.column(2)], ["y", "x", "id"])

    got = distinct.select("text", "y", "id").mapInArrow(vectors, "y int, x array<double>, id string").toArrow().sort_by([("id", "ascending"), ("y", "ascending")])
    weights, bias = fit_weights(np.array(got["x"].to_pylist()), np.asarray(got["y"]).astype(float))
    return Grammar(insults, weights, bias)


def score(docs: DataFrame, model: Grammar, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id and score in [0, 1]."""
    text_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast((model.lexicon.insults, model.weights, model.bias))

    def run(batches):
        own = Grammar(*shared.value)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([own.score(t.as_py() or "") for t in batch.column(1)], pa.float64())], ["id", "score"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(releasing(run), f"id {kind}, score double").withColumnRenamed("id", id_col)


def classify(docs: DataFrame, labels: DataFrame, cut: float = 0.3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, held_out, score, predicted (1 if score >= cut)."""
    out = score(docs, learn(docs, labels, id_col=id_col, text_col=text_col), id_col, text_col)
    return out.select(id_col, (fold(F.col(id_col), 4) == 2).alias("held_out"), "score", (F.col("score") >= cut).cast("int").alias("predicted"))
