"""Toxicity by a weighted finite-state pattern grammar.

Words are mapped to symbols: insults and threats by a learned lexicon, targets, negations and reporting verbs by the
closed word classes of a language (a parameter). Five transducers read a clause's symbols: insult, threat, target, negation
and reported speech. Each has arcs (state, symbol) -> (state, output) and final outputs; their composition is built
lazily, state by state, and its arcs carry the kind that a word's lexical weight counts for: an insult in the scope of
a negation or of reported speech counts for that, an insult in a clause with a target is aimed, which is known at the
clause's end only (a final output), and a threat needs a target soon after it. A clause counts only as matched by
the grammar; a document's evidence is the sum over its clauses for each kind, and a logistic fit of its logarithms
turns the kinds into a score, so that one clear insult suffices.

Learned from labelled documents, a sample of at most `max_labelled` (below 32,768) by hash order:

* the lexicon (words, and stems that inflect): features whose likelihood-ratio test against the label leaves `false`
  expected false entries among all features tested. Near copies would count one passage many times, so texts with the
  same least shingle hash and label count once. `false` is chosen from FALSE_ENTRIES by two-fold cross-validation;
* which entries are threats: those that a target follows within THREAT_REACH words nearly always;
* the weights of the kinds.

Scoring looks at whole texts, in time proportional to their length.

Null or empty text: no evidence, so the score is the base rate among texts without evidence. No labelled rows:
score 0. Repeated rows get the same score. Labels that are null are ignored; contradicting ones count as toxic.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import ahocorasick
import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assay.llm.common import aliased, tidy
from assay.session import cut, ship

MAX_LABELLED, STEMS = 20_000, (3, 4, 5, 6, 7, 8)
#: Share of toxic texts among those with an entry, for words and for stems.
MIN_PURITY, STEM_PURITY = 0.85, 0.93
#: Choices for the expected number of false lexicon entries.
FALSE_ENTRIES = (0.1, 1.0, 10.0)
#: Words in the scope of a negation, words in which a target completes a threat, share of a threat's uses with one.
NEGATION_SCOPE, THREAT_REACH, THREAT_SHARE = 3, 4, 0.8
SHINGLE = 5

#: Closed word classes of English, German, French and Spanish, and words that are threats whatever the labels say.
CLASSES = {
    "T": "you your yours u he she they him her them his their these those people someone everyone du dich dir dein deine ihr euch sie ihn ihm tu toi te ton ta vous votre il elle ils elles lui usted ustedes tú ti vosotros él ella ellos ellas",
    "N": "not never no nobody none nothing neither nor without cannot nicht nie niemals kein keine keinen keiner keinem niemand nichts weder ohne ne pas jamais aucun aucune personne rien sans nunca jamás tampoco ni nadie nada ningún ninguna sin",
    "R": "said says say saying claimed claims wrote writes reported reports quoted quotes told called sagte sagt sagten schrieb schreibt berichtete zitierte nannte dit disait a-dit écrit écrivait cita raconte dijo dice decía escribió según citó llamó",
    "V": "kill hurt destroy murder burn shoot stab beat töten umbringen schlagen erschießen tuer frapper brûler matar quemar golpear",
}

WORD = re.compile(r"[^\W_]+(?:'[^\W_]+)?")
CLAUSE_END = re.compile(r"[.!?;:\n]")
KINDS = ("plain", "aimed", "negated", "reported", "threat")


# The transducers: (state, symbol) -> (state, output). State 0 is the start; "" is no output.
def _insult(state: int, c: str) -> tuple[int, str]:
    """Puts out the weight of each insult; the state tells that there was one."""
    return (1, "weight") if c == "I" else (state, "")


def _threat(state: int, c: str) -> tuple[int, str]:
    """The state holds the words left in which a target completes the threat."""
    if c == "V":
        return THREAT_REACH, ""
    return (0, "threat") if c == "T" and state else (max(0, state - 1), "")


def _target(state: int, c: str) -> tuple[int, str]:
    return (1 if state or c == "T" else 0), ""


def _negation(state: int, c: str) -> tuple[int, str]:
    """The state holds the words left in the scope."""
    return (NEGATION_SCOPE, "") if c == "N" else (max(0, state - 1), "negated" if state else "")


def _reported(state: int, c: str) -> tuple[int, str]:
    return (1 if state or c == "R" else 0), "reported" if state else ""


class Grammar:
    """The lazily composed transducer: a state is a tuple of the parts' states.

    An arc has the next state and the kinds that take the word's lexical weight and a unit weight (None: no kind).
    A weight of kind "open" is aimed or plain by the final output of the state where the clause ends.
    """

    PARTS: tuple[Callable[[int, str], tuple[int, str]], ...] = (_insult, _threat, _target, _negation, _reported)
    START = (0,) * 5

    def __init__(self) -> None:
        self.arcs: dict[tuple, tuple] = {}

    def arc(self, state: tuple, c: str) -> tuple[tuple, str | None, str | None]:
        got = self.arcs.get((state, c))
        if got is None:
            steps = [f(s, c) for f, s in zip(self.PARTS, state, strict=True)]
            outputs = {o for _, o in steps}
            kind = None
            if "weight" in outputs:
                kind = "negated" if "negated" in outputs else "reported" if "reported" in outputs else "open"
            got = self.arcs[(state, c)] = (tuple(s for s, _ in steps), kind, "threat" if "threat" in outputs else None)
        return got

    @staticmethod
    def final(state: tuple) -> str:
        """What open weights are at the end of a clause: the target transducer's final output."""
        return "aimed" if state[2] else "plain"

    def clause(self, symbols: list[tuple[str, float]]) -> np.ndarray:
        """Weights by kind of one clause given as (symbol, lexical weight) words."""
        state, total = self.START, dict.fromkeys((*KINDS, "open"), 0.0)
        for c, w in symbols:
            state, kind, unit = self.arc(state, c)
            if kind:
                total[kind] += w
            if unit:
                total[unit] += 1.0
        total[self.final(state)] += total.pop("open")
        return np.array([total[k] for k in KINDS])


@dataclass
class ToxicityModel:
    lexicon: dict[str, float] = field(default_factory=dict)  # words, and stems with a trailing *
    threats: frozenset[str] = frozenset()  # those entries that need a target
    classes: dict[str, str] = field(default_factory=lambda: CLASSES)
    weights: tuple[float, ...] = (0.0,) * len(KINDS)
    bias: float = -50.0

    def scanner(self) -> Scanner:
        return Scanner(self)


class Scanner:
    """A model made ready in a task: an automaton finds candidate clauses, the grammar scores them."""

    def __init__(self, model: ToxicityModel):
        self.model, self.grammar = model, Grammar()
        self.words = {k: v for k, v in model.lexicon.items() if k[-1] != "*"}
        self.stems = {k[:-1]: v for k, v in model.lexicon.items() if k[-1] == "*"}
        self.classes = {w: c for c in "VRTN" for w in model.classes.get(c, "").split()}
        self.finder = ahocorasick.Automaton()
        for x in {*self.words, *self.stems, *(w for w, c in self.classes.items() if c == "V")}:
            self.finder.add_word(x, len(x))
        self.finder.make_automaton()

    def entry(self, word: str) -> tuple[str, float]:
        """The lexicon entry of most weight that the word matches, and its weight."""
        found = [(self.words[word], word)] if word in self.words else []
        found += [(self.stems[word[:n]], word[:n] + "*") for n in STEMS if word[:n] in self.stems]
        w, name = max(found, default=(0.0, ""))
        return name, w

    def classify(self, word: str) -> tuple[str, float]:
        name, weight = self.entry(word)
        if weight:
            return ("V" if name in self.model.threats else "I"), weight
        return self.classes.get(word, "N" if word.endswith("n't") else "O"), 0.0

    def clauses(self, text: str | None) -> Iterator[list[str]]:
        """The words of the clauses that hold a candidate, each clause once."""
        if not text or not len(self.finder):
            return
        low, done = text.lower(), -1
        for end, n in self.finder.iter(low):
            start = end - n + 1
            if start <= done or (start and low[start - 1].isalnum()):
                continue
            a = max(low.rfind(ch, done + 1, start) for ch in ".!?;:\n")  # never behind the last clause
            stop = CLAUSE_END.search(low, end)
            a, done = max(a, done) + 1, stop.start() if stop else len(low)
            yield WORD.findall(low, a, done)

    def evidence(self, text: str | None) -> np.ndarray:
        total = np.zeros(len(KINDS))
        for words in self.clauses(text):
            total += self.grammar.clause([self.classify(w) for w in words])
        return total

    def score(self, text: str | None) -> float:
        z = float(np.log1p(self.evidence(text)) @ np.asarray(self.model.weights)) + self.model.bias
        return 1.0 / (1.0 + math.exp(-max(-700.0, min(700.0, z))))


def doc_features(text: str | None) -> set[str]:
    words = {w for w in WORD.findall((text or "").lower()) if len(w) >= 3}
    return words | {w[:n] + "*" for w in words for n in STEMS if len(w) > n}


def least_shingle(text: str | None) -> int:
    """The smallest hash of a text's word shingles: near copies nearly always share it."""
    words = (text or "").lower().split()
    return min(xxhash.xxh64_intdigest(" ".join(words[i : i + SHINGLE])) for i in range(max(1, len(words) - SHINGLE + 1))) >> 1


def _sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        signs = pa.array([least_shingle(t.as_py()) for t in b.column("text")], pa.int64())
        yield pa.RecordBatch.from_arrays([b.column("text"), b.column("toxic"), signs], ["text", "toxic", "sign"])


#: Place of each count in one long: clean and toxic texts of the two folds, 16 bits each.
PLACES = {(0, 0): 0, (0, 1): 16, (1, 0): 32, (1, 1): 48}


def _count_features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    seen: Counter = Counter()
    for b in batches:
        for text, toxic, sign in zip(b.column("text").to_pylist(), b.column("toxic").to_pylist(), b.column("sign").to_pylist(), strict=True):
            one = 1 << PLACES[(sign & 1, 1 if toxic else 0)]
            for f in doc_features(text):
                seen[f] += one
    names = list(seen)
    for at in range(0, len(names), 100_000):
        part = names[at : at + 100_000]
        yield pa.RecordBatch.from_arrays([pa.array(part), pa.array([seen[x] for x in part], pa.int64())], ["feature", "n"])


def labelled_sample(docs: DataFrame, labels: DataFrame, most: int, key: str, label: str, text: str = "text") -> DataFrame:
    """At most `most` labelled documents by hash order of their ids, near copies once: text, toxic, sign."""
    ids = (
        labels.filter(F.col(label).isNotNull() & F.col(key).isNotNull())
        .groupBy(key)
        .agg(F.max(label).cast("int").alias("toxic"))
        .orderBy(F.xxhash64(key), key)
        .limit(most)
    )
    rows = docs.select(key, F.col(text).alias("text")).join(F.broadcast(ids), key).select("text", "toxic")
    signed = rows.mapInArrow(_sign, "text string, toxic int, sign long")
    return signed.groupBy("sign", "toxic").agg(F.min_by("text", F.xxhash64("text")).alias("text")).select("text", "toxic", "sign")


def least_g2(false: float, tests: int) -> float:
    """The statistic that `false` of this many null features are expected to pass."""
    lo, hi = 0.0, 200.0
    for _ in range(60):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if math.erfc(math.sqrt(mid / 2)) * max(tests, 1) > false else (lo, mid)
    return hi


def without_weaker_stems(rows: list) -> list:
    """Leave out a stem if a longer stem or word explains nearly all of its toxic texts: keep the most specific."""
    best: dict[str, int] = {}
    for r in rows:
        name = r["feature"].rstrip("*")
        for n in STEMS:
            if n < len(name) or (n == len(name) and r["feature"][-1] != "*"):
                best[name[:n]] = max(best.get(name[:n], 0), r["bad"])
    return [r for r in rows if r["feature"][-1] != "*" or best.get(r["feature"][:-1], 0) < 0.95 * r["bad"]]


def lexicon_of(counts: DataFrame, folds: tuple[int, ...], texts: dict, tests: int, false: float) -> dict[str, float]:
    """Entries by the counts of these folds, with their log odds. What is collected passed the test."""
    bad, good = (sum(texts.get((f, x), 0) for f in folds) for x in (1, 0))
    if not bad:
        return {}
    field = lambda x: sum((F.shiftrightunsigned("n", PLACES[(f, x)]).bitwiseAND(F.lit(0xFFFF)) for f in folds), F.lit(0))
    rate, seen = bad / (bad + good), F.col("bad") + F.col("good")
    xlogy = lambda k, p: F.when(k > 0, k * F.log(k / (seen * p))).otherwise(F.lit(0.0))
    purity = F.when(F.endswith("feature", F.lit("*")), STEM_PURITY).otherwise(MIN_PURITY)
    passed = (
        counts.select("feature", field(1).alias("bad"), field(0).alias("good")).filter("bad > 1")
        .filter((F.col("bad") / seen >= F.greatest(purity, F.lit(rate))) & (2 * (xlogy(F.col("bad"), rate) + xlogy(F.col("good"), 1 - rate)) >= least_g2(false, tests)))
        .collect()
    )
    odds = lambda r: math.log((r["bad"] + 0.5) / (bad + 1)) - math.log((r["good"] + 0.5) / (good + 1))
    return {r["feature"]: max(odds(r), 0.1) for r in without_weaker_stems(passed)}


def logistic(x: np.ndarray, y: np.ndarray, n: np.ndarray, ridge: float = 0.001, rounds: int = 100) -> tuple[np.ndarray, float]:
    """Ridge logistic regression by Newton steps; weights below zero are set to zero (evidence never excuses)."""
    scale = np.maximum(np.abs(x).max(axis=0), 1e-9)
    z = np.c_[x / scale, np.ones(len(x))]
    w = np.zeros(z.shape[1])
    penalty = np.diag([ridge] * x.shape[1] + [1e-6])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        grad = z.T @ (n * (p - y)) + penalty @ w
        hess = (z * (n * p * (1 - p))[:, None]).T @ z + penalty + 1e-9 * np.eye(len(w))
        step = np.linalg.solve(hess, grad)
        w = w - step * min(1.0, 5.0 / (np.abs(step).max() + 1e-12))
        w[:-1] = np.maximum(w[:-1], 0.0)
        if np.abs(step).max() < 1e-6:
            break
    return w[:-1] / scale, float(w[-1])


def fit(docs: DataFrame, labels: DataFrame, key: str = "doc_id", label: str = "toxic", max_labelled: int = MAX_LABELLED, text: str = "text",
        classes: dict[str, str] | None = None) -> ToxicityModel:
    """Learn lexicon, threats and weights. What reaches the driver is the lexicon and one row of kinds a sampled text."""
    classes = CLASSES if classes is None else classes
    ship(docs.sparkSession)
    sample = cut(labelled_sample(docs, labels, min(max_labelled, 32_767), key, label, text))
    texts = {(r["fold"], r["toxic"]): r["count"] for r in sample.groupBy((F.col("sign") % 2).alias("fold"), "toxic").count().collect()}
    if not any(n for (_, toxic), n in texts.items() if toxic):
        return ToxicityModel()
    counts = cut(sample.mapInArrow(tidy(_count_features), "feature string, n long").groupBy("feature").agg(F.sum("n").alias("n")).filter("bit_count(n) > 1"))
    tests = counts.count()
    trials = {(false, f): ToxicityModel(lexicon_of(counts, (1 - f,), texts, tests, false), classes=classes) for false in FALSE_ENTRIES for f in (0, 1)}

    def judge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """For each choice: how many texts the lexicon of the other fold gets right."""
        scans = {k: m.scanner() for k, m in trials.items()}
        for b in batches:
            for false in FALSE_ENTRIES:
                right = [bool(scans[(false, int(s) & 1)].evidence(t).any()) == bool(x) for t, x, s in zip(b["text"], b["toxic"], b["sign"], strict=True)]
                yield pd.DataFrame({"choice": [false], "right": [sum(right)]})

    right = {r["choice"]: r["right"] for r in sample.mapInPandas(judge, "choice double, right long").groupBy("choice").agg(F.sum("right").alias("right")).collect()}
    false = max(FALSE_ENTRIES, key=lambda x: (right.get(x, 0), -x))
    lexicon = lexicon_of(counts, (0, 1), texts, tests, false)
    plain = ToxicityModel(lexicon, classes=classes)

    def uses(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """How often each entry is used, and how often with a target soon after it."""
        scan, seen = plain.scanner(), {}
        for b in batches:
            for t in b["text"]:
                for words in scan.clauses(t):
                    for i, w in enumerate(words):
                        name, weight = scan.entry(w)
                        if weight:
                            n = seen.setdefault(name, [0, 0])
                            n[0] += 1
                            n[1] += any(scan.classes.get(x) == "T" for x in words[i + 1 : i + 1 + THREAT_REACH])
        yield pd.DataFrame([(k, *v) for k, v in seen.items()], columns=["entry", "uses", "aimed"])

    used = sample.filter("toxic = 1").mapInPandas(uses, "entry string, uses long, aimed long").groupBy("entry").agg(F.sum("uses").alias("uses"), F.sum("aimed").alias("aimed"))
    threats = frozenset(r["entry"] for r in used.filter((F.col("uses") > 4) & (F.col("aimed") >= THREAT_SHARE * F.col("uses"))).collect())
    model = ToxicityModel(lexicon, threats, classes)

    def measure(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        scan = model.scanner()
        for b in batches:
            rows = np.log1p(np.array([scan.evidence(t) for t in b["text"]]).reshape(-1, len(KINDS)))
            yield pd.DataFrame({k: rows[:, i] for i, k in enumerate(KINDS)} | {"toxic": b["toxic"].to_numpy()})

    # equal rows are one with a count, so the driver gets few; the fit weighs them
    seen_rows = sample.mapInPandas(measure, ", ".join(f"{k} double" for k in KINDS) + ", toxic int").groupBy(*KINDS, "toxic").count().toPandas()
    weights, bias = logistic(seen_rows[list(KINDS)].to_numpy(), seen_rows["toxic"].to_numpy(float), seen_rows["count"].to_numpy(float))
    return ToxicityModel(lexicon, threats, classes, tuple(weights), bias)


def score(docs: DataFrame, model: ToxicityModel, text: str = "text") -> DataFrame:
    """docs with a column score in place of the text."""
    others = [c for c in docs.columns if c not in (text, "score")]
    taken, own = aliased(others)
    shape = "".join(f"{n} {docs.schema[c].dataType.simpleString()}, " for n, c in zip(own, others, strict=True)) + "score double"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scan = model.scanner()
        for b in batches:
            values = pa.array([scan.score(t.as_py()) for t in b.column("__text")], pa.float64())
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in own), values], [*own, "score"])

    ship(docs.sparkSession)
    return docs.select(*taken, F.col(text).alias("__text")).mapInArrow(tidy(run), shape).toDF(*others, "score")


def drop_toxic(docs: DataFrame, model: ToxicityModel, threshold: float = 0.5, text: str = "text") -> DataFrame:
    """The rows whose score is below the threshold, all columns kept."""
    names = docs.columns
    taken, own = aliased(names)
    at, rows = names.index(text), docs.select(*taken)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scan = model.scanner()
        for b in batches:
            yield b.filter(pa.array([scan.score(t.as_py()) < threshold for t in b.column(own[at])], pa.bool_()))

    ship(docs.sparkSession)
    return rows.mapInArrow(tidy(run), rows.schema).toDF(*names)
