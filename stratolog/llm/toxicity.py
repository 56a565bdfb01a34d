"""Toxicity: a weighted finite-state pattern grammar over clauses.

Words are mapped to symbols (insult, threat, target, negation, report, other) by a lexicon; four
transducers, composed to one automaton, then rewrite the insults and threats of a clause by what stands
around them: directed at a target, negated, or reported. A text's score is a logistic function of the
weights of its matched clauses by kind, so an isolated word counts only as what its clause makes of it.

Insults are learned as words and stems: those which labelled toxic texts hold in many different contexts
and clean ones hardly do; contexts, and not texts, are counted so that copies of one text teach no more
than the text. Learning reads a sample of labelled rows, the SAMPLE ones smallest by a hash of doc_id;
the other words of the grammar are fixed.

Null and empty texts match nothing and get the lowest score. Equal texts get equal scores. An empty table
or one without labels leaves the fixed lexicon. Null labels teach nothing; if a document is labelled twice,
the larger label holds. A text of any length is read whole. Only id and text are looked at; other columns pass
through score_texts, but for one that has the result's name, and all through toxicity_filter.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stratolog.llm.shared import Workspace, held_out, made_apart, prepare, set_aside, trimmed, with_fields

#: Labelled rows that are learned from, at most.
SAMPLE = 20_000
#: Terms that a task counts before it passes them on.
HELD = 150_000
THRESHOLD = 0.3
#: A term is learned if seen in so many contexts of toxic texts, and this many times likelier there.
CONTEXTS, LIFT = 4, 20.0
STEMS = (4, 5, 6, 7, 8)
#: More weight of one kind than this doesn't count.
MOST = 12.0

#: Words of the grammar in English, German, French and Spanish.
TARGETS = "you your yours he she they him her them this these those du dich dir ihr euch er sie tu toi te vous il elle eux tú usted ustedes él ella ellos".split()
NEGATIONS = "not no never none nobody neither nor isn't aren't wasn't don't nicht kein keine nie niemals ne pas jamais aucun nunca jamás ningún".split()
REPORTS = "said says say called calls call wrote told quoted sagte sagt nannte schrieb dit disait appelle écrit dijo dice llamó escribió".split()
THREATS = "kill hurt destroy shoot stab burn attack töten verletzen vernichten tuer blesser détruire matar herir destruir".split()
INSULTS = "idiot moron stupid scum loser worthless pathetic disgusting trash clown imbecile bastard jerk".split()

_TOKEN = re.compile(r"\w[\w']*|[.!?;:\n]")
_EDGE = " \t.,;:!?\"'()[]{}*#$%&|<>~-_/\\"
KINDS = ("plain", "directed", "negated", "reported", "threat")


@dataclass(frozen=True)
class Symbol:
    """A token's class, and how a match is marked so far."""

    name: str
    marks: frozenset = frozenset()


def _negation(state, s):
    """A negation holds for the next four words of its clause."""
    if s.name == "end":
        return 0, s
    if s.name == "negation":
        return 4, s
    if state and s.name in ("insult", "threat"):
        s = Symbol(s.name, s.marks | {"negated"})
    return max(state - 1, 0), s


def _report(state, s):
    """A verb of saying holds to the end of its clause."""
    if s.name == "end":
        return 0, s
    if state and s.name in ("insult", "threat"):
        s = Symbol(s.name, s.marks | {"reported"})
    return int(state or s.name == "report"), s


def _target(state, s):
    """A target holds for the next six words of its clause."""
    if s.name == "end":
        return 0, s
    if s.name == "target":
        return 6, s
    if state and s.name in ("insult", "threat"):
        s = Symbol(s.name, s.marks | {"directed"})
    return max(state - 1, 0), s


def _threat(state, s):
    """A threat without a target in its clause is none; one that waits for its target comes out there."""
    if s.name == "end":
        return 0, s
    if s.name == "threat" and "directed" not in s.marks:
        return 1, Symbol("other")
    if state and s.name == "target":
        return 0, Symbol("threat", frozenset({"directed"}))
    return state, s


class Composition:
    """Transducers run one on the output of another, as one automaton whose arcs are found once."""

    def __init__(self, *parts):
        self.parts, self.start, self.arcs = parts, (0,) * len(parts), {}

    def step(self, state, symbol):
        found = self.arcs.get((state, symbol))
        if found is None:
            after, out = [], symbol
            for f, s in zip(self.parts, state):
                s, out = f(s, out)
                after.append(s)
            found = self.arcs[state, symbol] = (tuple(after), out)
        return found


def kind_of(s: Symbol) -> str:
    if s.name == "threat":
        return "threat"
    return next((k for k in ("reported", "negated", "directed") if k in s.marks), "plain")


class Grammar:
    """insults: weight by word, or by stem with '*' behind it."""

    def __init__(self, insults: dict[str, float]):
        self.words = {k: v for k, v in insults.items() if not k.endswith("*")}
        self.stems = {k[:-1]: v for k, v in insults.items() if k.endswith("*")}
        self.lengths = sorted({len(k) for k in self.stems})
        self.fixed = {w: Symbol(n) for n, ws in (("report", REPORTS), ("negation", NEGATIONS), ("target", TARGETS), ("threat", THREATS)) for w in ws}
        self.end, self.other, self.insult = Symbol("end"), Symbol("other"), Symbol("insult")
        self.automaton = Composition(_negation, _report, _target, _threat)
        self.may = frozenset([*self.words, *THREATS])

    def weight(self, word: str) -> float:
        w = self.words.get(word)
        if w is None:
            for n in self.lengths:
                w = self.stems.get(word[:n])
                if w is not None:
                    break
        return w or 0.0

    def features(self, text: str) -> list[float]:
        """Per kind the weights of matched clauses: of each clause its heaviest match counts."""
        low = text.lower()
        own = {w.strip(_EDGE) for w in set(low.split())}
        if own.isdisjoint(self.may) and not any(w[:n] in self.stems for n in self.lengths for w in own):
            found = [w for w in own if "'" in w or not w.isalnum()]
            if not any(self.weight(x) or x in self.may for w in found for x in _TOKEN.findall(w)):
                return [0.0] * len(KINDS)
        sums, best, state = dict.fromkeys(KINDS, 0.0), {}, self.automaton.start
        for t in _TOKEN.findall(low) + ["."]:
            w = 0.0
            if t in ".!?;:\n":
                symbol = self.end
            elif (symbol := self.fixed.get(t)) is None:
                w = self.weight(t)
                symbol = self.insult if w else self.other
            state, out = self.automaton.step(state, symbol)
            # a target directs what stands before it in the clause too
            if symbol.name == "target" and "plain" in best:
                best["directed"] = max(best.get("directed", 0.0), best.pop("plain"))
            if out.name in ("insult", "threat"):
                k = kind_of(out)
                best[k] = max(best.get(k, 0.0), w or 1.0)
            elif out.name == "end" and best:
                for k, v in best.items():
                    sums[k] += v
                best = {}
        return [sums[k] for k in KINDS]


@dataclass
class ToxicityModel:
    insults: dict[str, float]
    bias: float
    weights: list[float]

    def score(self, features: list[float]) -> float:
        z = self.bias + sum(w * min(x, MOST) for w, x in zip(self.weights, features))
        return 1 / (1 + math.exp(-max(-40.0, min(40.0, z))))


#: What holds without labels: a matched clause is likely toxic.
UNTAUGHT = ToxicityModel({w: 3.0 for w in INSULTS}, -4.0, [1.4, 1.5, 1.2, 1.0, 4.0])


def _terms(text: str) -> set[str]:
    own = {w.strip(_EDGE) for w in set(text.lower().split())} - {""}
    return own | {w[:n] + "*" for w in own for n in STEMS if len(w) > n}


def _fit(x: np.ndarray, y: np.ndarray) -> tuple[float, list[float]]:
    """Logistic regression by Newton steps: one effect shared by all kinds, and small deviations from it."""
    x = np.minimum(x, MOST)
    z = np.column_stack([np.ones(len(x)), x.sum(axis=1), x])
    ridge = np.array([0.01, 0.01, *[2.0] * x.shape[1]])
    b = np.zeros(z.shape[1])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(z @ b, -30, 30)))
        h = (z * (p * (1 - p))[:, None]).T @ z + np.diag(ridge)
        b = b + np.clip(np.linalg.solve(h, z.T @ (y - p) - ridge * b), -2, 2)
    return float(b[0]), [float(v) for v in b[1] + b[2:]]


def learn(docs: DataFrame, labels: DataFrame, may_learn, sample: int = SAMPLE) -> ToxicityModel:
    """Learn from at most `sample` labelled rows that fulfil may_learn, a condition on doc_id."""
    spark = docs.sparkSession
    pick = labels.filter(may_learn & F.col("toxic").isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    pick = pick.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    space = Workspace(spark)
    # the sample's size is bounded, so it may be broadcast
    taught = space.table(docs.select("doc_id", "text").join(F.broadcast(pick), "doc_id"), "taught")
    n = taught.agg(F.coalesce(F.sum("toxic"), F.lit(0)), F.count(F.lit(1))).first()
    toxic, clean = n[0], n[1] - n[0]
    if not toxic or not clean:
        return UNTAUGHT

    def count(batches):
        both = (Counter(), Counter())

        def out():
            terms = [*(both[0].keys() | both[1].keys())]
            yield pa.RecordBatch.from_arrays([pa.array(terms, pa.string()), *[pa.array([c[k] for k in terms], pa.int64()) for c in (both[1], both[0])]], ["term", "t", "c"])
            for c in both:
                c.clear()

        for b in batches:
            for t, y in zip(b["text"].to_pylist(), b["toxic"].to_pylist()):
                both[y > 0].update(_terms(t or ""))
                if sum(map(len, both)) > HELD:
                    yield from out()
        yield from out()

    counts = taught.mapInArrow(trimmed(count), "term string, t long, c long").groupBy("term").agg(F.sum("t").alias("t"), F.sum("c").alias("c"))
    counts = space.table(counts, "counts")
    odds = F.col("t") / toxic / ((F.col("c") + 0.5) / (clean + 1))
    likely = {r["term"]: (r["t"], r["c"]) for r in counts.filter((F.col("t") >= CONTEXTS) & (odds >= LIFT)).collect()}
    words = frozenset(likely)

    def contexts(batches):
        seen = set()
        for b in batches:
            for t, y in zip(b["text"].to_pylist(), b["toxic"].to_pylist()):
                if y:
                    own = [w.strip(_EDGE) for w in (t or "").lower().split()]
                    for k, w in enumerate(own):
                        for x in (w, *[w[:n] + "*" for n in STEMS if len(w) > n]):
                            if x in words:
                                seen.add((x, own[k - 1] if k else "", own[k + 1] if k + 1 < len(own) else ""))
        rows = list(seen)
        yield pa.RecordBatch.from_arrays([pa.array([r[j] for r in rows], pa.string()) for j in range(3)], ["term", "before", "after"])

    ctx = taught.select("text", "toxic").mapInArrow(trimmed(contexts), "term string, before string, after string").groupBy("term").agg(F.countDistinct("before", "after").alias("n"))
    varied = {r["term"]: r["n"] for r in ctx.collect()}
    # terms that occur in so many texts, of which chance makes some look toxic
    levels = sorted(((r["n"], r["count"]) for r in counts.groupBy((F.col("t") + F.col("c")).alias("n")).count().collect()), reverse=True)
    rivals, so_far = {}, 0
    for n_texts, k in levels:
        so_far += k
        rivals[n_texts] = so_far
    rate, found = toxic / (toxic + clean), {}
    for term, (t, c) in likely.items():
        v = varied.get(term, 0)
        surprise = t * math.log(t / (t + c) / rate) + (c * math.log(c / (t + c) / (1 - rate)) if c else 0.0)
        if surprise < math.log(rivals[t + c]):
            continue
        # in few contexts for its texts: a copied passage, not a word
        if v >= max(CONTEXTS, 0.5 * t):
            found[term] = math.log((min(v, t) + 0.5) / (toxic + 1)) - math.log((c + 0.5) / (clean + 1))
    # a stem must earn its place by what it finds beyond the best word or longer stem that it covers
    for k in sorted((k for k in found if k.endswith("*")), key=len, reverse=True):
        under = [likely[x] for x in found if x != k and x.startswith(k[:-1])]
        if under:
            t, c = max(under)
            if (likely[k][0] - t + 0.5) / toxic < LIFT * (likely[k][1] - c + 0.5) / clean:
                del found[k]
    # the fixed insults hold unless clean texts speak against them
    odd = {r["term"] for r in counts.filter(F.col("term").isin(INSULTS) & (odds < 1)).collect()}
    for w in INSULTS:
        if w not in odd:
            found.setdefault(w, 1.0)
    # a word or stem that a shorter found stem covers adds nothing
    stems = {k[:-1] for k in found if k.endswith("*")}
    insults = {k: v for k, v in found.items() if not any(k[:n] in stems for n in STEMS if n < len(k.rstrip("*")) + (k[-1] != "*"))}
    insults = {k: v for k, v in insults.items() if v > 0}
    if not insults:
        return UNTAUGHT
    grammar = Grammar(insults)

    def features(batches):
        for b in batches:
            rows = [grammar.features(t or "") for t in b["text"].to_pylist()]
            yield pa.RecordBatch.from_arrays([b["toxic"], *[pa.array([r[j] for r in rows], pa.float64()) for j in range(len(KINDS))]], ["toxic", *KINDS])

    got = taught.select("text", "toxic").mapInArrow(trimmed(features), "toxic int, " + ", ".join(f"{k} double" for k in KINDS)).toPandas()
    bias, weights = _fit(got[list(KINDS)].to_numpy(float), (got["toxic"] > 0).to_numpy(float))
    if not got["threat"].any():
        # a sample without threats teaches nothing of them: one is as likely toxic as not, as without labels
        weights[KINDS.index("threat")] = max(weights[KINDS.index("threat")], -bias)
    return ToxicityModel(insults, bias, weights)


def score_texts(docs: DataFrame, model: ToxicityModel, text: str = "text", out: str = "score") -> DataFrame:
    """docs with the toxicity score of each text."""
    prepare(docs.sparkSession)

    def run(batches):
        grammar = Grammar(model.insults)
        for b in batches:
            scores = [model.score(grammar.features(t or "")) for t in b[text].to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(scores, pa.float64())], [*b.schema.names, out])

    return made_apart(docs, (text,), (out,), lambda inner: inner.mapInArrow(trimmed(run), with_fields(inner, **{out: T.DoubleType()})))


def toxicity_filter(docs: DataFrame, model: ToxicityModel, text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs that score below the threshold, with their own columns."""
    inner, names = set_aside(docs, text)
    scored = score_texts(inner, model, text, "score")
    return scored.filter(F.col("score") < threshold).select(*names).toDF(*docs.columns)


def model_for(spark: SparkSession, sf: str, docs: DataFrame | None = None) -> ToxicityModel:
    """The model taught by the labels beside the documents, without the held-out quarter."""
    docs = spark.read.schema("doc_id long, text string").parquet(f"{sf}/documents.parquet") if docs is None else docs
    labels = spark.read.schema("doc_id long, toxic int").parquet(f"{sf}/labels.parquet")
    return learn(docs, labels, ~held_out(modulus=4, remainder=2))


def query(spark: SparkSession, sf: str) -> DataFrame:
    docs = spark.read.schema("doc_id long, text string").parquet(f"{sf}/documents.parquet")
    scored = score_texts(docs, model_for(spark, sf, docs))
    return scored.select("doc_id", held_out(modulus=4, remainder=2).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
