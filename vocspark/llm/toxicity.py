"""Toxicity by a weighted finite-state pattern grammar over clauses.

Words become classes: insult, threat, target, negation, report, other, and the end of a clause.  Small letter-to-letter
transducers mark insults and threats that stand in the scope of a negation, after a word of reporting in the clause, or with
a target before them in the clause; they are composed into one table, which reads a text once.  Matches without a target
before them wait for one in the rest of the clause, which directs them.  Threats count only when directed, and directed
insults and threats have weights of their own.  Each matched clause contributes the weight of
its word times the weight of its marks, and a text's score is the chance that at least one clause is toxic
(noisy-or); a text without a match has the share of toxic texts among such.

The insult lexicon is learned: word beginnings of 3 to 12 letters, and whole words, whose share of toxic texts is
high and beyond chance for the number of beginnings tried.  The weights of the marks are learned as well, from
the same rows, starting from prior weights.  Only labelled rows outside the held-out fold are used, at most
``sample_rows`` of them in hash order (a fit on a bounded sample); scoring reads every text whole.
Labels, language, source and id are never inputs of a score.

Null and empty texts have no match and get the score of such texts.  Null labels and ids are not learned from.  Of rows
repeated in ``labels`` the largest label counts.  Without any labelled row the built-in words and prior weights are used.
Extra columns are carried; ``score`` and ``predicted`` are replaced.  Empty tables give empty results.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vocspark.llm.common import carrying, add_columns, crc_mod_5, materialise, table, with_column_batches
from vocspark.llm.registry import query

# Words of the grammar's classes.
INSULTS = ("idiot", "moron", "loser", "scum", "trash", "worthless", "pathetic", "disgusting", "stupid", "imbecile", "dumbass")
THREATS = ("kill", "hurt", "destroy", "strangle", "stab", "shoot")
TARGETS = ("you", "your", "he", "she", "him", "her", "they", "them", "du", "ihr", "tu", "vous", "usted", "ustedes")
NEGATIONS = ("not", "no", "never", "nicht", "kein", "ne", "pas", "jamais", "nunca", "jamás")
REPORTS = ("said", "says", "called", "wrote", "quoted", "sagte", "schrieb", "dit", "dijo", "escribió")

CLASSES = ("other", "end", "insult", "threat", "target", "negation", "report")
MATCHED = ("insult", "threat")
NEGATION_SCOPE = 3
TOKEN = re.compile(r"[^\W\d_]+|[.!?;:\n]")
WORDS = re.compile(r"[^\W\d_]+")
PREFIXES = range(3, 13)
# Prior weight of a match by its marks, and the number of rows a prior counts as.
PRIOR = {"plain": 0.9, "negated": 0.6, "reported": 0.6, "negated+reported": 0.5}
# Directed matches start from the same weights and learn their own, insults and threats apart.
PRIOR |= {f"{kind}+{mark}": weight for kind in ("directed", "threat") for mark, weight in list(PRIOR.items())}
PRIOR_ROWS = 4.0
SEED_WEIGHT = 0.8
# Stems that a task counts before it passes its counts on.
HELD_STEMS = 300_000
NEW_TEXTS = 2


@dataclass(frozen=True)
class Transducer:
    """Letter to letter, deterministic: arcs[state, symbol] = (next state, output)."""
    arcs: dict

    def step(self, state, symbol):
        return self.arcs[state, symbol]


def marker(symbols, trigger: str, mark: str, scope: int | None) -> Transducer:
    """Adds ``mark`` to matches within ``scope`` words after the trigger, or in the rest of its clause."""
    full, arcs = scope or 1, {}
    for state in range(full + 1):
        for s in symbols:
            if s == trigger:
                arcs[state, s] = (full, s)
            elif s == "end":
                arcs[state, s] = (0, s)
            else:
                after = state if scope is None else max(0, state - 1)
                hit = state > 0 and s.split("+")[0] in MATCHED
                arcs[state, s] = (after, f"{s}+{mark}" if hit else s)
    return Transducer(arcs)


def aimed(symbols) -> Transducer:
    """A match with a target before it in the clause is directed; ``directed_matches`` directs the others by a later target."""
    arcs = {}
    for state in (0, 1):
        for s in symbols:
            hit = s.split("+")[0] in MATCHED
            arcs[state, s] = (0 if s == "end" else 1 if s == "target" else state, f"{s}+directed" if hit and state else s)
    return Transducer(arcs)


def compose(first: Transducer, second: Transducer, start, symbols) -> Transducer:
    """The second reads what the first writes; only states that can be reached."""
    arcs, todo, seen = {}, [start], {start}
    while todo:
        a, b = todo.pop()
        for s in symbols:
            na, out = first.step(a, s)
            nb, final = second.step(b, out)
            arcs[(a, b), s] = ((na, nb), final)
            if (na, nb) not in seen:
                seen.add((na, nb))
                todo.append((na, nb))
    return Transducer(arcs)


def _outputs(t: Transducer) -> list[str]:
    return sorted({out for _, out in t.arcs.values()})


def grammar() -> tuple[list[list[int]], list[list[str]]]:
    """The composed transducer as tables: next state and output by state and class."""
    negation = marker(CLASSES, "negation", "negated", NEGATION_SCOPE)
    report = marker(_outputs(negation), "report", "reported", None)
    both = compose(negation, report, (0, 0), CLASSES)
    whole = compose(both, aimed(_outputs(both)), ((0, 0), 0), CLASSES)
    states = sorted({s for s, _ in whole.arcs}, key=str)
    states.remove(((0, 0), 0))
    states.insert(0, ((0, 0), 0))
    number = {s: i for i, s in enumerate(states)}
    moves = [[number[whole.arcs[s, c][0]] for c in CLASSES] for s in states]
    outs = [[whole.arcs[s, c][1] for c in CLASSES] for s in states]
    return moves, outs


MOVES, OUTS = grammar()


def marks_of(output: str) -> str:
    """Which weight a match takes: by its marks; a threat counts only when directed."""
    kind, *marks = output.split("+")
    if kind not in MATCHED or kind == "threat" and "directed" not in marks:
        return ""
    return "+".join(m for m in ("negated", "reported") if m in marks) or "plain"


_MARKS = [[marks_of(o) for o in row] for row in OUTS]


def parts_of(output: str) -> tuple[str, str, bool] | None:
    """(kind, marks without the direction, directed by a target before) of a match."""
    kind, *marks = output.split("+")
    if kind not in MATCHED:
        return None
    return kind, "+".join(m for m in ("negated", "reported") if m in marks) or "plain", "directed" in marks


_PARTS = [[parts_of(o) for o in row] for row in OUTS]
_END, _TARGET = CLASSES.index("end"), CLASSES.index("target")


@dataclass(frozen=True)
class Model:
    stems: dict[str, float]
    weights: dict[str, float]
    unmatched: float

    def lexicon(self) -> "Lexicon":
        return Lexicon(self)


class Lexicon(dict):
    """Class number and weight of a word, found on first use; only a cache, emptied when full."""

    def __init__(self, model: Model):
        super().__init__()
        self.stems = model.stems
        self.fixed = {w: (CLASSES.index(c), 1.0) for c, ws in (
            ("target", TARGETS), ("negation", NEGATIONS), ("report", REPORTS), ("threat", THREATS)) for w in ws}

    def __missing__(self, word: str):
        weight = max((self.stems.get(k, 0.0) for k in features(word)), default=0.0)
        out = (2, weight) if weight > 0 else self.fixed.get(word, (0, 0.0))
        if len(word) == 1 and not word.isalpha():
            out = (1, 0.0)
        if len(self) > 500_000:
            self.clear()
        self[word] = out
        return out


def features(word: str) -> list[str]:
    """Beginnings of a word, and the word with an end mark."""
    return [word[:n] for n in PREFIXES if n <= len(word)] + ([word + "$"] if len(word) > 1 else [])


def matches(text: str, lexicon: Lexicon) -> list[tuple[str, float]]:
    """(marks, word weight) of the matches by what stands before them alone; scores use ``directed_matches``."""
    low = text.lower()
    if not any(lexicon[w][0] in (2, 3) for w in set(WORDS.findall(low))):
        return []
    out, state = [], 0
    for token in TOKEN.finditer(low):
        kind, weight = lexicon[token[0]]
        mark = _MARKS[state][kind]
        if mark:
            out.append((mark, weight))
        state = MOVES[state][kind]
    return out


def directed_matches(text: str, lexicon: Lexicon) -> list[tuple[str, float]]:
    """(name of the weight, word weight) of every insult, and of every threat with a target before or after it in its clause."""
    low = text.lower()
    if not any(lexicon[w][0] in (2, 3) for w in set(WORDS.findall(low))):
        return []
    out, pending, state = [], [], 0

    def settle(directed: bool) -> None:
        for kind, marks, weight in pending:
            if directed:
                out.append((f"{'threat' if kind == 'threat' else 'directed'}+{marks}", weight))
            elif kind == "insult":
                out.append((marks, weight))
        pending.clear()

    for token in TOKEN.finditer(low):
        kind, weight = lexicon[token[0]]
        if kind == _TARGET or kind == _END:
            settle(kind == _TARGET)
        match = _PARTS[state][kind]
        if match:
            pending.append((match[0], match[1], weight))
            if match[2]:
                settle(True)
        state = MOVES[state][kind]
    settle(False)
    return out


def score_text(text: str, model: Model, lexicon: Lexicon) -> float:
    found = directed_matches(text, lexicon) if text else []
    if not found:
        return model.unmatched
    clean = 1.0
    for mark, weight in found:
        clean *= 1.0 - model.weights[mark] * weight
        if clean < 1e-6:
            break
    return max(model.unmatched, 1.0 - clean)


def seed_model() -> Model:
    return Model({w + "$": SEED_WEIGHT for w in INSULTS}, dict(PRIOR), 0.02)


def training_rows(docs: DataFrame, labels: DataFrame, sample_rows: int) -> DataFrame:
    """At most ``sample_rows`` distinct labelled texts outside the held-out fold, in hash order of their ids."""
    usable = labels.where("doc_id IS NOT NULL AND toxic IS NOT NULL").where(crc_mod_5() != 0)
    usable = usable.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    ids = usable.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_rows)
    ids = materialise(ids, "toxic-sample")
    rows = docs.where("text IS NOT NULL").select("doc_id", "text").join(F.broadcast(ids), "doc_id")  # bounded by sample_rows
    return materialise(rows.groupBy(F.md5("text").alias("h")).agg(F.first("text").alias("text"), F.max("toxic").alias("toxic")), "toxic-texts")


def _stems_of_bad(rows: DataFrame, stems: list[str]) -> list[set[str]]:
    """Which stems each toxic training text has: at most ``sample_rows`` short lists of numbers."""
    names, number = stems, {k: i for i, k in enumerate(stems)}

    def find(batches):
        for batch in batches:
            out = [sorted({number[k] for w in set(WORDS.findall(t.lower())) for k in features(w) if k in number})
                   for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.list_(pa.int32()))], names=["stems"])

    found = with_column_batches(rows.where("toxic > 0"), ["text"], "stems array<int>", find)
    return [{names[i] for i in r["stems"]} for r in found.collect()]


def _explaining(texts: list[set[str]]) -> list[str]:
    """Stems one after another that explain most toxic texts not explained yet, while they explain NEW_TEXTS or more.

    A word that only comes along with others, as in a group of near copies, explains nothing and stays out.
    Of stems with the same texts the longest is taken.
    """
    where: dict[str, set[int]] = {}
    for i, stems in enumerate(texts):
        for k in stems:
            where.setdefault(k, set()).add(i)
    open_ = {k: set(v) for k, v in where.items()}
    out = []
    while open_:
        best = max(open_, key=lambda k: (len(open_[k]), len(where[k]), len(k), k))
        done = open_.pop(best)
        if len(done) < NEW_TEXTS:
            break
        out.append(best)
        open_ = {k: v - done for k, v in open_.items() if len(v) >= NEW_TEXTS}
    return out


def fit(docs: DataFrame, labels: DataFrame, sample_rows: int = 20_000, stems: int = 4_000) -> Model:
    """Learn stems and weights; what reaches the driver is at most ``stems`` rows, a few counts, and for each toxic text
    of the sample a short list of stem numbers."""
    rows = training_rows(docs, labels, sample_rows)
    total = {int(r["toxic"] > 0): r["n"] for r in rows.groupBy((F.col("toxic") > 0).cast("int").alias("toxic")).agg(
        F.count("*").alias("n")).collect()}
    bad, good = total.get(1, 0), total.get(0, 0)
    if not bad or not good:
        return seed_model()

    def counts(seen):
        keys = list(seen[0] | seen[1])
        for at in range(0, len(keys), 20_000):
            some = keys[at:at + 20_000]
            yield pa.RecordBatch.from_arrays(
                [pa.array(some, pa.string()), pa.array([seen[1][k] for k in some], pa.int64()),
                 pa.array([seen[0][k] for k in some], pa.int64())], names=["k", "bad", "good"])

    def count(batches):
        seen = (Counter(), Counter())
        for batch in batches:
            for row in range(batch.num_rows):
                text, toxic = batch.column("text")[row].as_py(), batch.column("toxic")[row].as_py()
                seen[toxic > 0].update({k for w in set(WORDS.findall(text.lower())) for k in features(w)})
                if len(seen[0]) + len(seen[1]) > HELD_STEMS:
                    yield from counts(seen)
                    seen = (Counter(), Counter())
        yield from counts(seen)

    counted = with_column_batches(rows, ["text", "toxic"], "k string, bad bigint, good bigint", count)
    counted = materialise(counted.groupBy("k").agg(F.sum("bad").alias("bad"), F.sum("good").alias("good")), "toxic-counts")
    tried = max(2, counted.count())
    least = 2 * math.log(tried) + 4
    rate, n = bad / (bad + good), F.col("bad") + F.col("good")
    gain = 2 * (F.col("bad") * F.log(F.col("bad") / (n * rate))
                + F.when(F.col("good") > 0, F.col("good") * F.log(F.col("good") / (n * (1 - rate)))).otherwise(0))
    found = counted.where((F.col("bad") * 10 >= n * 9) & (F.col("bad") > 0)).withColumn("gain", gain).where(
        F.col("gain") >= least).orderBy(F.desc("gain"), "k").limit(stems).collect()
    learned = {r["k"]: (r["bad"], r["good"]) for r in found}
    chosen = dict(seed_model().stems)
    against = {r["k"]: r for r in counted.where(F.col("k").isin(list(chosen))).collect()}
    for k in list(chosen):  # a built-in word that the labels speak against goes
        if k in against and against[k]["bad"] < against[k]["good"]:
            del chosen[k]
    for k in _explaining(_stems_of_bad(rows, list(learned))):
        chosen[k] = (learned[k][0] + 0.5) / (sum(learned[k]) + 1.0)
    draft = Model(chosen, dict(PRIOR), 0.0)

    def tally(batches):
        lexicon, seen = draft.lexicon(), Counter()
        for batch in batches:
            for text, toxic in zip(batch.column("text").to_pylist(), batch.column("toxic").to_pylist()):
                marks = {m for m, _ in directed_matches(text, lexicon)} or {"none"}
                first = next((m for m in ("directed+plain", "threat+plain", "plain") if m in marks), None) or min(marks)
                seen[(first, int(toxic > 0))] += 1
        yield pa.RecordBatch.from_arrays(
            [pa.array([m for m, _ in seen], pa.string()), pa.array([t for _, t in seen], pa.int64()),
             pa.array(list(seen.values()), pa.int64())], names=["mark", "toxic", "n"])

    tallied = with_column_batches(rows, ["text", "toxic"], "mark string, toxic bigint, n bigint", tally)
    n = {(r["mark"], r["toxic"]): r["n"] for r in tallied.groupBy("mark", "toxic").agg(F.sum("n").alias("n")).collect()}
    weights = {m: min(0.999, (n.get((m, 1), 0) + PRIOR_ROWS * p) / (n.get((m, 1), 0) + n.get((m, 0), 0) + PRIOR_ROWS))
               for m, p in PRIOR.items()}
    none, all_none = n.get(("none", 1), 0), n.get(("none", 1), 0) + n.get(("none", 0), 0)
    return Model(chosen, weights, min(0.4, (none + 0.02) / (all_none + 1.0)))


def score(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """``docs`` with ``score`` (0 to 1) and ``predicted`` (1 from 0.5 on)."""
    def work(column):
        lexicon = model.lexicon()
        scores = [score_text(t, model, lexicon) for t in column.to_pylist()]
        return [pa.array(scores, pa.float64()), pa.array([int(s >= 0.5) for s in scores], pa.int32())]

    return add_columns(docs, [text], "score double, predicted int", work)


@carrying
def stage(spark, docs: DataFrame, folder: str) -> DataFrame:
    """Pipeline stage: documents that the grammar does not find toxic; learned from the labelled rows among ``docs``."""
    model = fit(docs, table(spark, folder, "labels"))
    return score(docs, model).where("predicted = 0").select(*docs.columns)


@query("op10_toxicity_grammar")
def toxicity_grammar(spark, folder):
    docs = table(spark, folder, "documents").select("doc_id", "text")
    scored = score(docs.withColumn("held_out", crc_mod_5() == 0), fit(docs, table(spark, folder, "labels")))
    return scored.select("doc_id", "held_out", "score", "predicted")
