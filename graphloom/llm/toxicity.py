"""Toxicity by a weighted grammar of finite-state transducers over clauses.

A clause is what stands between marks . ! ? ; or line ends. Its words become tags: insult, threat, target, negation, reported
speech, other. Five small transducers read the tags side by side (their composition), each with its own state and a factor for
the weight that an insult or a threat puts out: a negation shortly before lowers it, speech that is reported lowers it, a target
in the clause raises it, a threat counts when a target follows. A text's features are sums over matched clauses, so a word
counts by where it stands; a logistic layer fitted on labelled rows turns them into a score.

Insults are stems: word beginnings (any inflection matches). A few are given; the rest are learned from labelled rows as
beginnings much more frequent in one half of the toxic rows than in the clean ones, and confirmed on the other half; they come
before the given ones, which stay. Learned stems have SHORTEST to LONGEST letters and occur in LEAST_TEXTS texts of each half. Only a bounded sample of labelled rows is used: at most `per_class` rows of each class, those with the smallest hashes of doc_id.

Null and empty texts match no clause and get the score of the bias alone; texts of any length are read whole. Repeated rows and rows
with a null doc_id are scored each on its own (labels without a doc_id teach nothing; of equal labelled texts the smallest doc_id
counts). Other columns stay, but score and predicted are replaced. An empty table gives an empty result. Without labels the given
stems and weights hold. An Aho-Corasick automaton finds the clauses that can match in one pass of a text.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_right

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize, prepare

PER_CLASS = 3000
SHORTEST, LONGEST = 3, 10
#: Texts of each half in which a learned stem occurs at least.
LEAST_TEXTS = 3
GIVEN = ("asshole", "bastard", "bitch", "clown", "coward", "disgusting", "dumb", "fool", "idiot", "imbecile", "jerk", "loser", "moron", "pathetic", "pig", "scum", "stupid", "trash", "vermin", "worthless")
THREATS = frozenset("kill hurt destroy beat shoot stab burn punish crush smash hang strangle töten schlagen vernichten tuer frapper détruire matar golpear destruir".split())
TARGETS = frozenset("you your yours yourself they them their he she him her people du dich dir ihr euch dein deine tu toi te vous votre ils tú ti usted ustedes ellos".split())
NEGATIONS = frozenset("not no never n't isn't aren't wasn't don't doesn't without nicht kein keine nie niemals ne pas jamais sans nunca jamás sin ni".split())
REPORTS = frozenset("said says say claimed claims called quoted quotes wrote reported according alleged sagte sagt schrieb behauptet laut dit disait écrit selon dijo dice escribió según".split())
CLAUSE = re.compile(r"[.!?;\n]+")
WORD = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)*")
#: The features' default weights, bias first, for a table without labels.
DEFAULT = (-3.0, 1.5, 0.5, 0.5)
INSULT, THREAT, TARGET, NEGATION, REPORT, OTHER = range(6)


class Transducer:
    """Deterministic: (state, tag) -> (state, factor); arcs that are not given keep the state, with factor 1."""

    def __init__(self, arcs: dict[tuple[int, int], tuple[int, float]], ends: dict[int, float] | None = None):
        self.arcs, self.ends = arcs, ends or {}

    def step(self, state: int, tag: int) -> tuple[int, float]:
        return self.arcs.get((state, tag), (state, 1.0))


def negation(reach: int = 3, factor: float = 0.35) -> Transducer:
    """After a negation the next `reach` words are under it."""
    arcs = {}
    for s in range(reach + 1):
        for tag in range(6):
            under = factor if s and tag in (INSULT, THREAT) else 1.0
            arcs[s, tag] = (reach if tag == NEGATION else max(0, s - 1), under)
    return Transducer(arcs)


def reported(factor: float = 0.5) -> Transducer:
    """From a verb of saying to the clause's end."""
    return Transducer({(0, REPORT): (1, 1.0), (1, INSULT): (1, factor), (1, THREAT): (1, factor)})


def insult(again: float = 0.8) -> Transducer:
    """Threats pass unchanged; each further insult of a clause counts a little less."""
    return Transducer({(0, INSULT): (1, 1.0), (1, INSULT): (2, again), (2, INSULT): (2, again * again)})


def target(before: float = 1.3, after: float = 1.2) -> Transducer:
    """A target before raises what follows; one after raises the clause at its end (states 2 and 3)."""
    return Transducer({(0, TARGET): (1, 1.0), (1, INSULT): (1, before), (0, INSULT): (2, 1.0), (0, THREAT): (2, 1.0), (2, TARGET): (3, 1.0)}, {3: after})


def threat(idle: float = 0.2, aimed: float = 1.5) -> Transducer:
    """A threat counts fully if a target follows in the clause."""
    return Transducer({(0, THREAT): (1, idle), (1, TARGET): (2, 1.0), (2, THREAT): (2, aimed)}, {2: aimed / idle})


class Grammar:
    """The composition of the five transducers; arcs of the product are made when first met."""

    def __init__(self, parts: tuple[Transducer, ...] | None = None):
        self.parts = parts or (insult(), threat(), target(), negation(), reported())
        self.arcs: dict[tuple, tuple[tuple, float]] = {}

    def score(self, tagged: list[tuple[int, float]]) -> float:
        """tagged: (tag, weight) of each word. The weights that come out, summed, times the factors of the end states."""
        state, insults, threats = (0,) * len(self.parts), 0.0, 0.0
        for tag, weight in tagged:
            if (state, tag) not in self.arcs:
                moves = [p.step(s, tag) for p, s in zip(self.parts, state, strict=True)]
                self.arcs[state, tag] = tuple(m[0] for m in moves), math.prod(m[1] for m in moves)
            state, factor = self.arcs[state, tag]
            if tag == INSULT:
                insults += weight * factor
            elif tag == THREAT:
                threats += weight * factor
        ends = [p.ends.get(s, 1.0) for p, s in zip(self.parts, state, strict=True)]
        return insults * ends[2] + threats * ends[1] * ends[2]


class Model:
    """Stems with weights, the grammar, and the logistic layer. Picklable; the automaton is built where it is first used."""

    def __init__(self, stems: dict[str, float], weights=DEFAULT):
        self.stems, self.weights = stems, tuple(weights)
        self._machine = None

    def __getstate__(self):
        return {"stems": self.stems, "weights": self.weights, "_machine": None}

    def machine(self):
        if self._machine is None:
            import ahocorasick

            a = ahocorasick.Automaton()
            for s in (*self.stems, *THREATS):
                a.add_word(s, len(s))
            a.make_automaton()
            self._machine = a, Grammar()
        return self._machine

    def stem(self, word: str) -> float:
        """The weight of the word's longest known beginning, else 0."""
        for n in range(min(len(word), 16), 0, -1):
            if (w := self.stems.get(word[:n])) is not None:
                return w
        return 0.0

    def tag(self, word: str) -> tuple[int, float]:
        if w := self.stem(word):
            return INSULT, w
        for tag, words, weight in ((THREAT, THREATS, 2.0), (TARGET, TARGETS, 0.0), (NEGATION, NEGATIONS, 0.0), (REPORT, REPORTS, 0.0)):
            if word in words or (tag == NEGATION and word.endswith("n't")):
                return tag, weight
        return OTHER, 0.0

    def clauses(self, text: str | None) -> list[float]:
        """Scores of the clauses that match."""
        text = (text or "").lower()
        machine, grammar = self.machine()
        hits = [e - n + 1 for e, n in machine.iter(text)] if text else []
        hits = [h for h in hits if h == 0 or not text[h - 1].isalpha()]
        if not hits:
            return []
        ends = [m.start() for m in CLAUSE.finditer(text)]
        found, done = [], -1
        for h in sorted(hits):
            k = bisect_right(ends, h)
            if k == done:
                continue
            done = k
            clause = text[ends[k - 1] if k else 0 : ends[k] if k < len(ends) else len(text)]
            if (s := grammar.score([self.tag(w) for w in WORD.findall(clause)])) > 0:
                found.append(s)
        return found

    def features(self, text: str | None) -> tuple[float, float, float]:
        """log(1 + sum of clause scores), the highest one, matched clauses for each thousand characters (at most 5)."""
        found = self.clauses(text)
        if not found:
            return 0.0, 0.0, 0.0
        return math.log1p(sum(found)), max(found), min(5.0, 1000.0 * len(found) / max(len(text), 200))

    def score(self, text: str | None) -> float:
        z = self.weights[0] + sum(w * x for w, x in zip(self.weights[1:], self.features(text), strict=True))
        return 1.0 / (1.0 + math.exp(-max(-30.0, min(30.0, z))))


def sample(docs: DataFrame, labels: DataFrame, column: str, per_class: int) -> DataFrame:
    """text, label, half of at most per_class labelled documents of each class; rows with a null label are left out."""
    ids = None
    for value in (0, 1):
        part = labels.where(F.col(column) == value).select(F.col("doc_id").alias("label_id"), F.lit(value).alias("label")).orderBy(F.xxhash64("label_id"), "label_id").limit(per_class)
        ids = part if ids is None else ids.unionByName(part)
    # 2 x per_class rows at most.
    return docs.select("doc_id", "text").join(F.broadcast(ids), F.col("doc_id") == F.col("label_id")).select("doc_id", "text", "label", F.pmod(F.xxhash64(F.col("doc_id"), F.lit(1)), F.lit(2)).cast("int").alias("half"))


def _stem_counts(batches):
    """Of each word beginning, in how many texts of each class and half it occurs."""
    for b in batches:
        count: dict[str, list[int]] = {}
        for text, label, half in zip(*(b.column(n).to_pylist() for n in ("text", "label", "half")), strict=True):
            words = set(WORD.findall((text or "").lower()))
            for stem in {w[:n] for w in words for n in range(SHORTEST, min(LONGEST, len(w)) + 1)}:
                count.setdefault(stem, [0, 0, 0, 0])[2 * half + label] += 1
        yield pa.RecordBatch.from_arrays([pa.array(list(count), pa.string()), *(pa.array([c[i] for c in count.values()], pa.int64()) for i in range(4))], names=["stem", "c0", "t0", "c1", "t1"])


def chosen_stems(found: list[tuple[str, float, int]], same: float = 0.9) -> dict[str, float]:
    """Of (beginning, log odds, texts): each as long as it can be while it keeps the share `same` of its texts, and none that begins with another."""
    known = {stem: (o, n) for stem, o, n in found}
    longest: dict[str, str] = {}
    for stem, (_, n) in known.items():
        for k in range(SHORTEST, len(stem)):
            short = stem[:k]
            if short in known and n >= same * known[short][1] and len(stem) > len(longest.get(short, short)):
                longest[short] = stem
    stems: dict[str, float] = {}
    for stem in sorted(known, key=lambda x: (len(x), x)):
        stem = longest.get(stem, stem)
        if not any(stem[:k] in stems for k in range(SHORTEST, len(stem) + 1)):
            stems[stem] = known[stem][0]
    return stems


def with_given(given: dict[str, float], learned: dict[str, float]) -> dict[str, float]:
    """Learned stems, and the given ones that do not begin with one of them."""
    return {s: w for s, w in given.items() if not any(s[:k] in learned for k in range(1, len(s) + 1))} | learned


def fit(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS) -> Model:
    """Learns from the rows of labels(doc_id, toxic) whose documents are in docs."""
    prepare(docs.sparkSession)
    # Of equal texts that with the smallest doc_id counts; the bounded sample is written once, so that all passes read the same rows.
    rows = sample(docs, labels, "toxic", per_class).groupBy("text").agg(F.min(F.struct("doc_id", "label", "half")).alias("r"))
    rows = materialize(rows.select("text", "r.label", "r.half"))
    size = {(r["half"], r["label"]): r["n"] for r in rows.groupBy("half", "label").agg(F.count("*").alias("n")).collect()}
    n = {k: size.get(k, 0) for k in ((0, 0), (0, 1), (1, 0), (1, 1))}
    given = dict.fromkeys(GIVEN, 3.0)
    if not min(n.values()):
        return Model(given)
    counts = rows.select("text", "label", "half").mapInArrow(_stem_counts, "stem string, c0 long, t0 long, c1 long, t1 long").groupBy("stem").agg(*[F.sum(c).alias(c) for c in ("c0", "t0", "c1", "t1")])
    odds = lambda h: F.log((F.col(f"t{h}") + 0.5) / (n[h, 1] + 1)) - F.log((F.col(f"c{h}") + 0.5) / (n[h, 0] + 1))
    good = counts.where((F.col("t0") >= LEAST_TEXTS) & (F.col("t1") >= LEAST_TEXTS)).withColumn("o", F.least(odds(0), odds(1))).where("o > 2.2").withColumn("seen", F.col("t0") + F.col("t1"))
    # Bounded by the sample.
    learned = chosen_stems([(r["stem"], r["o"], r["seen"]) for r in good.select("stem", "o", "seen").collect()])
    model = Model(with_given(given, learned))

    def features(batches):
        for b in batches:
            x = [model.features(t) for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("label"), *(pa.array([v[i] for v in x], pa.float64()) for i in range(3))], names=["label", "a", "b", "c"])

    table = rows.select("label", "text").mapInArrow(features, "label int, a double, b double, c double").toPandas().to_numpy(np.float64)
    labelled = labels.groupBy("toxic").count().where("toxic IS NOT NULL").collect()
    share = {r["toxic"]: r["count"] for r in labelled}
    model.weights = logistic(table[:, 1:], table[:, 0], {k: share.get(k, 1) / max(1, n[0, k] + n[1, k]) for k in (0, 1)})
    return model


def logistic(x: np.ndarray, y: np.ndarray, weight: dict[int, float], ridge: float = 1e-3, rounds: int = 50) -> tuple[float, ...]:
    """Newton's method with a small ridge; weight: of the rows of each class."""
    x = np.column_stack([np.ones(len(x)), x])
    w = np.where(y > 0, weight[1], weight[0])
    w /= w.mean()
    beta = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        grad = x.T @ (w * (y - p)) - ridge * len(x) * beta
        step = np.linalg.solve(x.T @ (x * (w * p * (1 - p))[:, None]) + ridge * len(x) * np.eye(len(beta)), grad)
        beta += step
        if np.abs(step).max() < 1e-8:
            break
    return tuple(beta.tolist())


def score_of(text: Column, model: Model) -> Column:
    """The score of a text column, 0 to 1."""

    @F.pandas_udf("double")
    def scored(texts: pd.Series) -> pd.Series:
        return texts.map(model.score, na_action=None).astype(float)

    return scored(F.coalesce(text, F.lit("")))


def score(docs: DataFrame, model: Model) -> DataFrame:
    """docs with score and predicted (1 if score >= 0.5); columns of these names in docs are replaced."""
    prepare(docs.sparkSession)
    return docs.withColumn("score", score_of(F.col("text"), model)).withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
