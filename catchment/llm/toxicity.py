"""Toxicity by a weighted finite-state grammar over clauses, with a lexicon and weights learnt from labels."""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, staged, text_slices
from .quality import fold_of

#: At most so many labelled documents of each class, those with the smallest hash of their id, are learnt from.
SAMPLE = 4000
#: A word or stem enters the lexicon if its log-likelihood ratio is at least so much.
LEAST_RATIO = 30.0
#: Shortest and longest stem.
STEM = (3, 8)
ACCEPT = 0.5

# Words of each class before anything is learnt, and the grammar's factors.
TARGETS = "you your yours yourself he she they him her them u du dich dir ihr euch sie tu te toi vous ton ta tes usted ustedes ti vosotros"
NEGATIONS = "not no never nobody isn't aren't wasn't don't nicht kein keine nie ne pas jamais aucun nunca ningún ni"
REPORTS = "said says say claimed wrote quoted reported told according sagte sagt schrieb dit disait selon dijo dice según"
THREATS = "kill hurt destroy murder stab shoot beat töten umbringen schlagen tuer frapper détruire matar golpear destruir"
INSULTS = "idiot moron scum loser trash stupid pathetic worthless disgusting clown"
SEED_WEIGHT, THREAT_WEIGHT = 2.0, 1.0
AT_TARGET, NEGATED, REPORTED = 1.25, 0.5, 0.6
#: How a matched word stands in its clause; the first that holds counts.
STANDINGS = ("reported", "negated", "directed", "plain")
NEGATION_REACH = 3

_CLAUSE = re.compile(r"[.!?;:\n]")
_WORD = re.compile(r"[^\W_]+(?:['’][^\W_]+)*")


class Transducer:
    """A deterministic weighted transducer over word classes: step(state, class) gives the next state, the class written, and a factor."""

    def __init__(self, start, step):
        self.start, self.step = start, step

    def then(self, other: Transducer) -> Transducer:
        """The composition: what this one writes, the other reads; factors multiply."""

        def step(state, symbol):
            a, middle, x = self.step(state[0], symbol)
            b, out, y = other.step(state[1], middle)
            return (a, b), out, x * y

        return Transducer((self.start, other.start), step)


def _insult(state, symbol):
    return state, "harm" if symbol == "insult" else symbol, 1.0


def _threat(state, symbol):
    return state, "harm" if symbol == "threat" else symbol, 1.0


def _target(seen, symbol):
    return seen or symbol == "target", "directed" if symbol == "harm" and seen else "plain" if symbol == "harm" else symbol, AT_TARGET if symbol == "harm" and seen else 1.0


def _negation(left, symbol):
    if symbol == "negation":
        return NEGATION_REACH, symbol, 1.0
    harm = left and symbol in STANDINGS
    return max(0, left - 1), "negated" if harm else symbol, NEGATED if harm else 1.0


def _reported(seen, symbol):
    harm = seen and symbol in STANDINGS
    return seen or symbol == "report", "reported" if harm else symbol, REPORTED if harm else 1.0


def grammar() -> Transducer:
    """Insults and threats become harm, and harm is written as it stands: directed at a target of the clause, near a negation, in reported speech, or plain."""
    return Transducer(0, _insult).then(Transducer(0, _threat)).then(Transducer(False, _target)).then(Transducer(0, _negation)).then(Transducer(False, _reported))


class Grammar:
    """The grammar with a lexicon: word or stem (ending in *) to weight."""

    def __init__(self, lexicon: dict[str, float]):
        self.classes = {w: c for c, words in (("target", TARGETS), ("negation", NEGATIONS), ("report", REPORTS), ("threat", THREATS)) for w in words.split()}
        weights = {w: SEED_WEIGHT for w in INSULTS.split()} | {w: THREAT_WEIGHT for w in THREATS.split()} | lexicon
        self.words = {w: x for w, x in weights.items() if not w.endswith("*")}
        self.stems = {w[:-1]: x for w, x in weights.items() if w.endswith("*")}
        self.finder = ahocorasick.Automaton()
        for w in {*self.words, *self.stems}:
            self.finder.add_word(w, len(w))
        self.finder.make_automaton()
        self.machine = grammar()
        # The start state in which the target has been seen.
        (((insult, threat), _), negation), report = self.machine.start
        self.aimed = ((((insult, threat), True), negation), report)
        self.table: dict = {}

    def read(self, word: str) -> tuple[str, float]:
        """A word's class and weight; of the word itself and its stems the heaviest counts."""
        weight = self.words.get(word, 0.0)
        for k in range(STEM[0], len(word)):
            weight = max(weight, self.stems.get(word[:k], 0.0))
        known = self.classes.get(word)
        return (known or ("insult" if weight else "other")), weight

    def clause(self, words: list[str]) -> float:
        """The weight of a clause: its harm weights times their factors."""
        return self.standings(words)[-1]

    def standings(self, words: list[str]) -> list[float]:
        """The harm weights of the clause's only path, summed by STANDINGS, and last their sum times the factors.

        A target may stand before or behind the harm: a first pass tells whether there is one, and is the start of the second.
        """
        read = [self.read(w) for w in words]
        state = self.aimed if any(c == "target" for c, _ in read) else self.machine.start
        out = [0.0] * (len(STANDINGS) + 1)
        for symbol, weight in read:
            if (found := self.table.get((state, symbol))) is None:
                found = self.table[state, symbol] = self.machine.step(state, symbol)
            state, written, factor = found
            if written in STANDINGS:
                out[STANDINGS.index(written)] += weight
                out[-1] += weight * factor
        return out

    def features(self, text: str) -> list[float]:
        """Of the clauses that match: logarithms of the summed weight, of that per 100 words of text, of the number of clauses; the largest weight; and the logarithm of the weight by STANDINGS."""
        low = text.lower()
        spans: list[tuple[int, int]] = []
        for end, size in self.finder.iter(low):
            start = end + 1 - size
            if start and (low[start - 1].isalnum() or low[start - 1] == "_"):
                continue
            if spans and start < spans[-1][1]:
                continue
            begin = max(low.rfind(c, spans[-1][1] if spans else 0, start) for c in ".!?;:\n") + 1
            stop = _CLAUSE.search(low, start)
            spans.append((max(begin, spans[-1][1] if spans else 0), stop.start() if stop else len(low)))
        found = [x for a, b in spans if (x := self.standings(_WORD.findall(low, a, b)))[-1]]
        sums = np.sum(found, axis=0) if found else np.zeros(len(STANDINGS) + 1)
        words = low.count(" ") + low.count("\n") + 1
        return [*np.log1p([sums[-1], 100 * sums[-1] / words, len(found)]).tolist(), max((x[-1] for x in found), default=0.0), *np.log1p(sums[:-1]).tolist()]


#: Numbers that Grammar.features gives.
FEATURES = 4 + len(STANDINGS)


@dataclass
class Model:
    lexicon: dict[str, float]
    weights: np.ndarray

    def score(self, features: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(features @ self.weights[:-1] + self.weights[-1], -30, 30)))


def _ratio(t: float, n: float, all_t: int, all_n: int) -> float:
    """The log-likelihood ratio of a term in t of all_t toxic and n of all_n other documents."""
    total, seen = all_t + all_n, t + n
    cells = ((t, seen * all_t), (n, seen * all_n), (all_t - t, (total - seen) * all_t), (all_n - n, (total - seen) * all_n))
    return 2 * sum(o * np.log(o * total / e) for o, e in cells if o > 0)


def _sample(labels: DataFrame, most: int) -> DataFrame:
    """(doc_id, y) of at most `most` labelled ids of each class outside fold 0, those with the smallest hash."""
    known = labels.filter("toxic IN (0, 1)").groupBy("doc_id").agg(F.max("toxic").alias("y")).filter(fold_of() > 0)
    key = F.xxhash64("doc_id")
    parts = [known.filter(F.col("y") == y).orderBy(key, "doc_id").limit(most) for y in (0, 1)]
    return staged(parts[0].unionByName(parts[1]), "sample")


def learn_lexicon(rows: DataFrame, all_t: int, all_n: int) -> dict[str, float]:
    """Words and stems that mark toxic documents, with their log odds, from rows(doc_id, y, text).

    Spark counts in how many documents of each class every word and stem stands, and gives the log-likelihood ratio. Those above
    LEAST_RATIO are candidates: with all_t toxic documents, each holding so many different terms, that is a number the sample bounds. Taken
    in order of their ratio, a candidate is held only if it still passes over the documents without any
    held term that is its beginning or continuation. So the stem of a listed word adds nothing, but a stem
    with many endings stands for them all. The terms are split off once and staged.
    """
    low, high = STEM
    words = F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit(r"(\p{L}+)"), F.lit(1)))
    one = rows.select("doc_id", "y", F.explode(words).alias("w"))
    stems = F.expr(f"transform(sequence(0, least({high}, length(w) - 1) - {low} + 1), i -> IF(i = 0, w, concat(left(w, i + {low} - 1), '*')))")
    terms = one.select("doc_id", "y", F.explode(F.when(F.length("w") > low, stems).otherwise(F.array("w"))).alias("term"))
    counts = terms.distinct().groupBy("term").agg(F.sum("y").alias("t"), F.sum(1 - F.col("y")).alias("n"))
    x = {"t": "t", "n": "n", "o": f"({all_t} - t)", "p": f"({all_n} - n)"}
    total, seen = all_t + all_n, "(t + n)"
    expected = {"t": f"({seen} * {all_t})", "n": f"({seen} * {all_n})", "o": f"(({total} - {seen}) * {all_t})", "p": f"(({total} - {seen}) * {all_n})"}
    ratio = " + ".join(f"IF({v} > 0, {v} * ln({v} * {total}D / {expected[k]}), 0D)" for k, v in x.items())
    marked = counts.filter(F.expr(f"t * {all_n}D > 2 * n * {all_t}D")).withColumn("ratio", F.expr(f"2 * ({ratio})")).filter(F.col("ratio") >= LEAST_RATIO)
    marked = staged(marked, "terms")
    chosen = sorted(((r.term, r.ratio) for r in marked.toLocalIterator()), key=lambda r: (-r[1], r[0]))
    if not chosen:
        return {}
    where: dict[str, set] = defaultdict(set)
    toxic = set()
    for r in terms.join(F.broadcast(marked.select("term")), "term").groupBy("doc_id", "y").agg(F.collect_set("term").alias("terms")).toLocalIterator():
        for term in r.terms:
            where[term].add(r.doc_id)
        if r.y:
            toxic.add(r.doc_id)
    held: dict[str, float] = {}
    for term, _ in chosen:
        bare = term.rstrip("*")
        kin = [h for h in held if h.rstrip("*").startswith(bare) or bare.startswith(h.rstrip("*"))]
        rest = where[term].difference(*[where[h] for h in kin])
        t = len(rest & toxic)
        if _ratio(t, len(rest) - t, all_t, all_n) >= LEAST_RATIO:
            t = len(where[term] & toxic)
            held[term] = float(np.log((t + 0.5) / (all_t + 1)) - np.log((len(where[term]) - t + 0.5) / (all_n + 1)))
    return held


def fit(docs: DataFrame, labels: DataFrame, most: int = SAMPLE) -> Model | None:
    """A model from at most `most` labelled documents of each class; None unless both occur.

    The sample's bound makes everything that the driver gets bounded: candidate terms, where they
    stand, and the features of each document for a logistic regression with equal weight to rows.
    """
    chosen = _sample(labels, most)
    rows = staged(docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(chosen), "doc_id"), "learnt")
    sizes = {r.y: r["count"] for r in rows.groupBy("y").count().collect()}
    if len(sizes) < 2:
        return None
    lexicon = learn_lexicon(rows, sizes[1], sizes[0])
    found = with_features(rows, lexicon).join(F.broadcast(chosen), "doc_id").select("x", "y").toPandas()
    x = np.hstack([np.stack(found["x"]), np.ones((len(found), 1))])
    y = found["y"].to_numpy(dtype=float)
    w = np.zeros(x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p) + 1e-6)[:, None]).T @ x + np.eye(len(w)) * 0.1, x.T @ (y - p) - 0.1 * w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return Model(lexicon, w)


def with_features(docs: DataFrame, lexicon: dict[str, float]) -> DataFrame:
    """(doc_id, x): Grammar.features of each row of docs(doc_id, text, ...). No shuffle."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Grammar(lexicon)
        for ids, texts in text_slices(batches):
            x = [own.features(t.decode()) for t in texts.to_pylist()]
            yield pa.RecordBatch.from_arrays([ids, pa.array(x, pa.list_(pa.float64()))], ["doc_id", "x"])

    return docs.select("doc_id", "text").mapInArrow(rows, "doc_id long, x array<double>")


def score(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, held_out, score, predicted) for each row of docs(doc_id, text, ...).

    Learns from labels(doc_id, toxic) outside fold 0 only. Null texts count as empty and get the
    score of a text without a matching clause. Without labels of both classes the score is that of the seed
    words: 1 - exp(-x) of the summed weight. Null ids are held out; repeated rows are scored alike; no rows give no rows. A long text is searched
    whole, clause by clause.
    """
    model = fit(docs, labels)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Grammar(model.lexicon if model else {})
        for ids, texts in text_slices(batches):
            x = np.array([own.features(t.decode()) for t in texts.to_pylist()]).reshape(-1, FEATURES)
            yield pa.RecordBatch.from_arrays([ids, pa.array(model.score(x) if model else 1 - np.exp(-np.expm1(x[:, 0])))], ["doc_id", "score"])

    scored = docs.select("doc_id", "text").mapInArrow(rows, "doc_id long, score double")
    return scored.select("doc_id", F.coalesce(fold_of() == 0, F.lit(True)).alias("held_out"), "score", (F.col("score") >= ACCEPT).cast("int").alias("predicted"))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))
