"""Toxicity by a weighted finite-state grammar over clauses.

Words become symbols: an insult stem (in one of BINS strengths), a threat verb, a target (pronouns and
groups of people), a negation, a reporting verb, a word of intent, an intensifier, or any other word.
Weighted sequential transducers read the symbols of a clause: an insult weighs more right after an
intensifier, a threat within three words of a word of intent; negation softens what follows within three
words, reported speech marks what follows as quoted, and a target in the clause turns an insult or threat
into an aimed one. They are composed into one machine, whose arcs carry the product of their weights; a
clause weighs the sum of its arcs. A document's features are sums over its matched clauses (no word
counts alone), and a logistic model turns them into a score. Insults and threats that are negated or
reported count in no feature that raises a score, and no weight of the model may go against the meaning of
its feature (SIGNS), so a clause never scores higher for being negated or reported.

The grammar's fixed word lists know English. Further insult stems, of any language, are learned from
labels: word beginnings of 3 to 8 characters whose documents are toxic far more often than others
(log-likelihood ratio). Stems and model are fitted on at most LABELLED_ROWS labelled rows, those with
the smallest hash of doc_id, never on rows whose crc32(doc_id) mod 5 is 0; the model is fitted on
features made with stems of the other half of the rows. Everything else reads whole texts.

Only the text makes a score. Defined cases: a null or empty text has no clause; with labels of fewer
than MIN_POSITIVE toxic rows the model's weights are the fixed PRIOR; null labels are left out, and of
repeated labels of a document the largest counts; an empty table gives no rows; further columns pass
through.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from evenkeel.llm.common import fresh_name, small_batches
from evenkeel.llm.wordscan import ALNUM, Words, blocks, scan_column

LABELLED_ROWS = 20_000
MIN_POSITIVE = 8
LEAST_RATIO = 22.0
MOST_STEMS = 3000
STEM_CHARS = range(3, 9)
BINS = 4

# English words of the grammar.
INSULTS = "idiot moron imbecile stupid dumb fool loser scum trash garbage worthless pathetic disgusting clown bastard bitch asshole retard vermin filth pig rat scumbag jerk creep freak coward".split()
THREATS = "kill hurt destroy burn hang shoot beat stab strangle smash crush murder".split()
TARGETS = "you your yours yourself u he him his she her they them their people everyone everybody women men immigrants".split()
NEGATIONS = "not no never cannot without neither nor hardly don’t doesn’t didn’t isn’t aren’t wasn’t weren’t won’t can’t ain’t".split()
#: What stands before the apostrophe of a contraction, as the scanner cuts it; a "t" follows.
CONTRACTED = "don doesn didn isn aren wasn weren won can ain".split()
REPORTS = "said says say told claimed claims wrote writes reported reports quoted called according alleged".split()
INTENTS = "will ll gonna shall should must gotta wanna would".split()
INTENSIFIERS = "such so total complete absolute utter fucking damn bloody really very".split()

_BREAK = re.compile(rb"[.,;:!?\n()\"]")


@dataclass(frozen=True)
class Transducer:
    """A weighted sequential transducer: step(state, symbol) gives the next state, the symbol written and the arc's weight."""

    start: object
    step: object

    def then(self, other: Transducer) -> Transducer:
        """What other makes of this one's output; weights multiply."""

        def step(state, symbol):
            mine, written, one = self.step(state[0], symbol)
            theirs, out, two = other.step(state[1], written)
            return (mine, theirs), out, one * two

        return Transducer((self.start, other.start), step)

    def compiled(self, alphabet: Iterable) -> tuple[list[dict], list[dict]]:
        """The reachable states as tables: symbol to (next state, output), and symbol to the arc's weight."""
        alphabet, names, tables, weights, todo = list(alphabet), {self.start: 0}, [], [], [self.start]
        while todo:
            state, row, weight = todo.pop(0), {}, {}
            for symbol in alphabet:
                to, out, weight[symbol] = self.step(state, symbol)
                if to not in names:
                    names[to] = len(names)
                    todo.append(to)
                row[symbol] = (names[to], out)
            tables.append(row)
            weights.append(weight)
        return tables, weights


# A symbol is (kind, strength, how): kinds I insult, T threat, Y target, N negation (1: a contraction), R report, M intent,
# Q intensifier, W other; how: "", soft, quoted, aimed.
ALPHABET = [(k, b, "") for k in "I" for b in range(BINS)] + [(k, 0, "") for k in "TYNRMQW"] + [("N", 1, "")]
STRENGTH = [0.5, 1.0, 1.5, 2.0]


def _insult(pressed, s):
    return s[0] == "Q", s, STRENGTH[s[1]] * (1.25 if pressed else 1.0) if s[0] == "I" else 1.0


def _threat(left, s):
    if s[0] == "M":
        return 3, s, 1.0
    return max(0, left - 1), s, (0.4 if left else 0.2) if s[0] == "T" else 1.0


def _negation(left, s):
    if s[0] == "N":
        return 3 + s[1], s, 1.0
    if left and s[0] in "IT":
        return left - 1, (s[0], s[1], "soft"), 0.4
    return max(0, left - 1), s, 1.0


def _reported(inside, s):
    if s[0] == "R":
        return True, s, 1.0
    return (inside, (s[0], s[1], "quoted"), 0.5) if inside and s[0] in "IT" and not s[2] else (inside, s, 1.0)


def _target(state, s):
    seen, waiting = state
    if s[0] == "Y":  # what waits for a target is aimed at this one
        return (True, None), ("Y", waiting or 0, "aimed" if waiting is not None else ""), 0.5 if waiting is not None else 0.0
    if s[0] in "IT" and not s[2]:
        return (seen, None if seen else s[1]), (s[0], s[1], "aimed" if seen else ""), (1.5 if s[0] == "I" else 4.0) if seen else 1.0
    return (seen, waiting), s, 1.0 if s[0] in "IT" else 0.0


MACHINE = Transducer(False, _insult).then(Transducer(0, _threat)).then(Transducer(0, _negation)).then(Transducer(False, _reported)).then(Transducer((False, None), _target))
GRAMMAR, ARC_WEIGHTS = MACHINE.compiled(ALPHABET)

FEATURES = [f"bin{b}" for b in range(BINS)] + ["aimed", "soft", "quoted", "threats", "clauses", "heaviest", "total", "density"]
#: The sign that the weight of each feature may have; 0: any.
SIGNS = [1, 1, 1, 1, 1, -1, -1, 1, 0, 1, 1, 1]
#: Weights of the features, and the constant, where there are too few labels.
PRIOR = [0.3, 0.6, 1.0, 1.5, 0.5, -0.5, -0.3, 0.3, 0.3, 0.3, 0.3, 1.0, -3.0]


class Lexicon:
    """Fixed words, and stems with a strength each; the longest stem that begins a word counts."""

    def __init__(self, stems: dict[str, int]):
        self.symbols = {w.encode(): (k, 0, "") for k, ws in (("Q", INTENSIFIERS), ("M", INTENTS), ("Y", TARGETS), ("N", NEGATIONS), ("R", REPORTS)) for w in ws} | {w.encode(): ("N", 1, "") for w in CONTRACTED}
        self.exact = {w.encode(): ("T", 0, "") for w in THREATS} | {w.encode(): ("I", BINS - 1, "") for w in INSULTS}
        self.stems = {s.encode(): ("I", b, "") for s, b in stems.items()}
        self.lengths = sorted({len(s) for s in self.stems}, reverse=True)
        self.opening = np.zeros(1 << 24, bool)
        for w in [*self.exact, *self.stems]:
            self.opening[int.from_bytes(w[:3], "big")] = True

    def core(self, word: bytes):
        """The symbol of an insult or threat, else None."""
        if found := self.exact.get(word):
            return found
        for n in self.lengths:
            if n <= len(word) and (found := self.stems.get(word[:n])):
                return found
        return None

    def symbol(self, word: bytes):
        return self.core(word) or self.symbols.get(word, ("W", 0, ""))


def clauses(words: Words, data: bytes, lexicon: Lexicon, a: int, b: int, near: np.ndarray) -> Iterator[list]:
    """The symbols of each clause, among words a to b, that holds a core word; near are words that may be one."""
    upto = a
    for k in near.tolist():
        if k < upto or lexicon.core(words.bytes_of(k)) is None:
            continue
        first = k
        while first > a and not _BREAK.search(data, words.ends[first - 1], words.starts[first]):
            first -= 1
        last = k + 1
        while last < b and not _BREAK.search(data, words.ends[last - 1], words.starts[last]):
            last += 1
        upto = last
        yield [lexicon.symbol(words.bytes_of(i)) for i in range(max(first, a), last)]


def features(words: Words, lexicon: Lexicon) -> np.ndarray:
    """A row of FEATURES for each text."""
    out = np.zeros((len(words.doc_ptr) - 1, len(FEATURES)))
    if not len(words.hashes):
        return out
    data = words.data.tobytes()
    long = np.flatnonzero(words.ends - words.starts >= 3)
    s = words.starts[long]
    opening = (words.data[s].astype(np.int32) << 16) | (words.data[s + 1].astype(np.int32) << 8) | words.data[s + 2]
    near = long[lexicon.opening[opening]]
    bounds = np.searchsorted(near, words.doc_ptr)
    for d in np.flatnonzero(np.diff(bounds)).tolist():
        a, b = int(words.doc_ptr[d]), int(words.doc_ptr[d + 1])
        row = out[d]
        for symbols in clauses(words, data, lexicon, a, b, near[bounds[d] : bounds[d + 1]]):
            state, weight = 0, 0.0
            for symbol in symbols:
                weight += ARC_WEIGHTS[state][symbol]
                state, (kind, strength, how) = GRAMMAR[state][symbol]
                if how:
                    row[{"aimed": 4, "soft": 5, "quoted": 6}[how]] += 1
                if kind in "IT" and how in ("", "aimed"):
                    row[strength if kind == "I" else 7] += 1
            row[8] += 1
            row[9] = max(row[9], weight)
            row[10] += weight
        row[11] = row[10] / (b - a) * 100
    return np.log1p(out)


def training_rows(docs: DataFrame, labels: DataFrame, most: int) -> DataFrame:
    """doc_id, text, toxic: at most so many labelled rows, none of the held-out ones; their number bounds the broadcast."""
    usable = labels.where("doc_id is not null and toxic is not null and crc32(cast(doc_id as string)) % 5 <> 0")
    chosen = usable.groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    return docs.select("doc_id", F.col("text").cast("string").alias("text")).join(F.broadcast(chosen), "doc_id")


def stem_counts(rows: DataFrame) -> DataFrame:
    """stem, fold, pos, neg: in how many toxic and other texts a word begins with the stem."""

    def run(batches):
        held: Counter = Counter()
        for batch in batches:
            for text, toxic, fold in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                found = {w[:n] for w in set(re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").lower())) for n in STEM_CHARS if len(w) >= n}
                found.add("")  # counts the texts
                held.update((s, fold, toxic) for s in found)
        items = list(held.items())
        columns = [pa.array([k[0] for k, _ in items], pa.string()), pa.array([k[1] for k, _ in items], pa.int32()), pa.array([n * (k[2] > 0) for k, n in items], pa.int64()), pa.array([n * (k[2] <= 0) for k, n in items], pa.int64())]
        yield pa.RecordBatch.from_arrays(columns, ["stem", "fold", "pos", "neg"])

    fold = F.expr("cast(crc32(cast(doc_id as string)) % 2 as int)").alias("fold")
    each = rows.select("text", "toxic", fold).mapInArrow(run, "stem string, fold int, pos long, neg long")
    return each.groupBy("stem", "fold").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))


def ratio(pos: float, neg: float, all_pos: float, all_neg: float) -> float:
    """Signed log-likelihood ratio: how much more often the stem's texts are toxic than others."""
    cells = [(pos, pos + neg, all_pos), (neg, pos + neg, all_neg), (all_pos - pos, all_pos + all_neg - pos - neg, all_pos), (all_neg - neg, all_pos + all_neg - pos - neg, all_neg)]
    total = all_pos + all_neg
    g = 2 * sum(n * math.log(n * total / (row * column)) for n, row, column in cells if n > 0)
    return g if pos * all_neg > neg * all_pos else -g


def choose_stems(counts: dict[str, tuple[int, int]], all_pos: int, all_neg: int) -> dict[str, int]:
    """Stems with their strength. Of nested stems a longer one stays only if it tells clearly more."""
    strength = {}
    for stem, (pos, neg) in counts.items():
        if pos >= 3 and ratio(pos, neg, all_pos, all_neg) >= LEAST_RATIO:
            strength[stem] = math.log((pos + 0.5) / (all_pos + 1)) - math.log((neg + 0.5) / (all_neg + 1))
    kept: dict[str, float] = {}
    for stem in sorted(strength, key=lambda s: (len(s), s)):
        shorter = [kept[stem[:n]] for n in range(1, len(stem)) if stem[:n] in kept]
        if not shorter or strength[stem] > max(shorter) + 0.5:
            kept[stem] = strength[stem]
    best = sorted(kept, key=lambda s: (-kept[s], s))[:MOST_STEMS]
    return {s: int(np.digitize(kept[s], [2.0, 3.0, 4.5])) for s in best}


def collect_counts(rows: DataFrame) -> list[tuple[str, int, int, int]]:
    """Counts of the stems that can pass in some fold, a list bounded by MOST_STEMS times a few dozen, most telling first."""
    counts = stem_counts(rows)
    total = counts.groupBy("stem").agg(F.sum("pos").alias("p"), F.sum("neg").alias("q"))
    texts = total.where("stem = ''").first()
    if texts is None:
        return []
    share = texts["p"] / max(texts["p"] + texts["q"], 1)
    telling = total.where((F.col("stem") == "") | ((F.col("p") >= 3) & (F.col("p") > 2 * share * (F.col("p") + F.col("q")))))
    best = telling.orderBy((F.col("stem") == "").desc(), (F.col("p") * F.col("p") / (F.col("p") + F.col("q"))).desc(), "stem").limit(30 * MOST_STEMS).select("stem")
    return [tuple(r) for r in counts.join(F.broadcast(best), "stem").select("stem", "fold", "pos", "neg").collect()]


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0) -> np.ndarray:
    """Weights, the constant last, by Newton's method; features whose weight would go against SIGNS are left out (weight 0)."""
    used = list(range(x.shape[1]))
    while True:
        own = np.column_stack([x[:, used], np.ones(len(x))])
        w = np.zeros(own.shape[1])
        penalty = np.full(len(w), ridge)
        penalty[-1] = 1e-6
        for _ in range(40):
            p = 1 / (1 + np.exp(-np.clip(own @ w, -30, 30)))
            step = np.linalg.solve((own * (p * (1 - p))[:, None]).T @ own + np.diag(penalty), own.T @ (y - p) - penalty * w)
            w += step
            if np.abs(step).max() < 1e-8:
                break
        against = [k for k, weight in zip(used, w[:-1], strict=True) if weight * SIGNS[k] < 0]
        if not against:
            out = np.zeros(x.shape[1] + 1)
            out[[*used, -1]] = w
            return out
        used = [k for k in used if k not in against]


@dataclass
class Model:
    stems: dict[str, int]
    weights: list[float]

    def scores(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(x @ np.array(self.weights[:-1]) + self.weights[-1], -30, 30)))


def train(docs: DataFrame, labels: DataFrame, most: int = LABELLED_ROWS) -> Model:
    small_batches(docs.sparkSession)
    rows = training_rows(docs, labels, most)
    counts = collect_counts(rows)
    texts = {f: (p, q) for s, f, p, q in counts if s == ""}
    if sum(p for p, _ in texts.values()) < MIN_POSITIVE or not sum(q for _, q in texts.values()):
        return Model({}, PRIOR)

    def stems(folds: set[int]) -> dict[str, int]:
        total: dict[str, tuple[int, int]] = {}
        for s, f, p, q in counts:
            if f in folds and s:
                a, b = total.get(s, (0, 0))
                total[s] = (a + p, b + q)
        return choose_stems(total, sum(texts.get(f, (0, 0))[0] for f in folds), sum(texts.get(f, (0, 0))[1] for f in folds))

    other = {0: stems({1}), 1: stems({0})}

    def run(batches):
        lexicons = {f: Lexicon(s) for f, s in other.items()}
        for batch in batches:
            for part in blocks(batch, 0):
                words = scan_column(part.column(0), ALNUM)
                both = {f: features(words, lexicon) for f, lexicon in lexicons.items()}
                fold = part.column(2).to_pylist()
                x = [both[f][i].tolist() for i, f in enumerate(fold)]
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.list_(pa.float64())), part.column(1), part.column(3)], ["x", "toxic", "doc_id"])

    fold = F.expr("cast(crc32(cast(doc_id as string)) % 2 as int)").alias("fold")
    got = rows.select("text", "toxic", fold, "doc_id").mapInArrow(run, "x array<double>, toxic int, doc_id long").toArrow()  # at most `most` short rows
    order = np.lexsort((got.column("toxic").to_numpy(), got.column("doc_id").to_numpy()))
    x, y = np.array(got.column("x").to_pylist())[order], (got.column("toxic").to_numpy() > 0).astype(float)[order]
    return Model(stems({0, 1}), fit_logistic(x, y).tolist())


def score(docs: DataFrame, model: Model, text_col: str = "text", name: str = "toxicity") -> DataFrame:
    """docs with one more column: the score, 0 to 1."""
    small_batches(docs.sparkSession)
    name = fresh_name(docs.columns, name)
    text_at = docs.columns.index(text_col)
    shared = docs.sparkSession.sparkContext.broadcast(model)  # MOST_STEMS stems at most

    def run(batches):
        m = shared.value
        lexicon = Lexicon(m.stems)
        for batch in batches:
            for part in blocks(batch, text_at):
                scores = m.scores(features(scan_column(part.column(text_at), ALNUM), lexicon))
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(scores)], [*part.schema.names, name])

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField(name, T.DoubleType())]))


def reject(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents with a score under 0.5."""
    scored = score(docs, train(docs, labels))
    column = scored.columns[-1]
    return scored.where(F.col(f"`{column}`") < 0.5).drop(column)


def report(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted."""
    scored = score(docs.select("doc_id", "text"), train(docs, labels))
    held = F.expr("coalesce(crc32(cast(doc_id as string)) % 5 = 0, false)")
    s = F.col(scored.columns[-1])
    return scored.select("doc_id", held.alias("held_out"), s.alias("score"), (s >= 0.5).cast("int").alias("predicted"))
