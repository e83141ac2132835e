"""Toxicity by a weighted finite-state pattern grammar.

Words become symbols: insult (with a weight), threat, target, negation, speech
cue, quote, clause end, other. Five small transducers read the symbols of a
text and mark them: negation and target reach over the next words of a clause,
a speech cue to its end, a quote to the closing quote; a threat stays open to the
end of its clause and is answered by a target there. Composed, they are one
table, run once over a text. What is scored are clauses that match: an insult
with the marks it carries, or a threat aimed at someone, who is named
before it ("they kill") or after it ("kill you"). Insults are single words; those
of several words are not matched as such.

The insult lexicon (words and word beginnings) and the weights of the matched
patterns are learned from labelled rows, so what negation or quoting is worth
comes from the labels. Fitting takes at most `fit_rows` labelled rows, chosen
by a hash of the id; everything else covers all rows. Pattern weights are fitted
on rows whose words the lexicon used for them has not seen.

Defined results: a null or empty text has no match and gets the score of such
texts; a null doc_id is held out; label rows without toxic or doc_id are left
out, and of repeated ones the highest label counts; without labels every score
is 0. Rows are scored in place, so repeated rows score alike and other columns
stay as they are.
"""

import re
from itertools import product

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shotcurve.scratch import stored

FIT_ROWS = 20_000
FOLDS = 5
MIN_EVIDENCE = 12.0
# for a word none of whose beginnings is in the lexicon: rare words of a toxic
# text and its near copies must not pass for insults
STRONG_EVIDENCE = 40.0
MIN_WEIGHT = 2.5
REACH = 4

INSULT, THREAT, TARGET, NEGATION, SPEECH, QUOTE, END, OTHER = range(8)
NEGATED, REPORTED, AIMED, ANSWERED = 1, 2, 4, 8

# Closed word classes in four languages
NEGATIONS = "not no never nor isn aren don doesn nicht kein keine nie pas jamais non nunca ni sin".split()
TARGETS = ("you your yours he she they him her them du dich dir dein deine ihr euch sie "
           "tu toi ton ta vous votre ils elles te usted ustedes vosotros ellos ellas").split()
SPEECH_CUES = ("said says told called wrote quoted sagte sagt nannte schrieb "
               "dit disait appelle dijo dice llamó escribió").split()
THREATS = ("kill hurt destroy beat burn shoot töte töten schlage verletze "
           "tuer tuerai frapper matar mataré golpear").split()
QUOTES = '"«»„“”'
ENDS = ".!?;:\n"
CLASSES = {**{w: NEGATION for w in NEGATIONS}, **{w: TARGET for w in TARGETS},
           **{w: SPEECH for w in SPEECH_CUES}, **{w: THREAT for w in THREATS},
           **{q: QUOTE for q in QUOTES}, **{e: END for e in ENDS}}
PREFIXES = (4, 5)
FEATURES = 10


# A transducer: (start, {(state, class): (next state, mark)}).

def reaching(trigger: int, mark: int, reach: int):
    """Marks the next `reach` symbols of the clause after a trigger."""
    table = {}
    for state, symbol in product(range(reach + 1), range(8)):
        nxt = reach if symbol == trigger else 0 if symbol == END else max(state - 1, 0)
        table[state, symbol] = nxt, mark if state and symbol != END else 0
    return 0, table


def to_clause_end(trigger: int, mark: int):
    """Marks what follows a trigger up to the end of the clause."""
    table = {}
    for state, symbol in product((0, 1), range(8)):
        table[state, symbol] = (0 if symbol == END else 1 if symbol == trigger else state), mark * state
    return 0, table


def between(trigger: int, mark: int):
    """Marks what lies between two triggers of one line of symbols."""
    return 0, {(state, symbol): (1 - state if symbol == trigger else state, mark * state)
               for state, symbol in product((0, 1), range(8))}


def answered(trigger: int, answer: int, negation: int, mark: int, reach: int):
    """Marks the answer that follows a trigger in its clause, if the trigger is neither
    negated nor within twice `reach` symbols after an answer."""
    table = {}
    for (no, yes, held), symbol in product(product(range(reach + 1), range(2 * reach + 1), (0, 1)), range(8)):
        hit = held and symbol == answer
        opens = symbol == trigger and not no and not yes
        table[(no, yes, held), symbol] = (
            (0, 0, 0) if symbol == END else (reach if symbol == negation else max(no - 1, 0),
                                             2 * reach if symbol == answer else max(yes - 1, 0),
                                             1 if opens else 0 if hit else held)), mark if hit else 0
    return (0, 0, 0), table


def compose(*transducers):
    """One transducer that carries the marks of all of them."""
    start, table = tuple(t[0] for t in transducers), {}
    todo, number = [start], {start: 0}
    while todo:
        state = todo.pop()
        for symbol in range(8):
            steps = [t[1][s, symbol] for t, s in zip(transducers, state)]
            nxt, mark = tuple(s for s, _ in steps), 0
            for _, m in steps:
                mark |= m
            if nxt not in number:
                number[nxt] = len(number)
                todo.append(nxt)
            table[number[state], symbol] = number[nxt], mark
    return 0, table


def grammar():
    return compose(reaching(NEGATION, NEGATED, REACH), reaching(TARGET, AIMED, 2 * REACH),
                   to_clause_end(SPEECH, REPORTED), between(QUOTE, REPORTED),
                   answered(THREAT, TARGET, NEGATION, ANSWERED, REACH))


WORD = re.compile(r"[^\W\d_]+")
SYMBOL = re.compile(rf"[^\W\d_]+|[{QUOTES}{ENDS}]")


class Lexicon(dict):
    """Weight of a word: the largest among those of the word and its beginnings."""

    def __init__(self, weights: dict[str, float]):
        self.weights = weights

    def __missing__(self, word):
        if len(self) > 200_000:
            self.clear()
        found = max(self.weights.get(k, 0.0) for k in keys_of(word))
        self[word] = found
        return found


def keys_of(word: str) -> list[str]:
    return [f"={word}", *(f"{word[:n]}*" for n in PREFIXES if len(word) >= n)]


def match(text: str, lexicon: Lexicon, table) -> list[float] | None:
    """patterns() without the last one: threats are those after their target."""
    found = patterns(text, lexicon, table)
    return found and found[:-1]


def patterns(text: str, lexicon: Lexicon, table) -> list[float] | None:
    """Features of the matched clauses of a text; None if nothing matches."""
    low = text.lower()
    words = WORD.findall(low)
    if not any(map(lexicon.__getitem__, words)) and not any(w in CLASSES and CLASSES[w] == THREAT for w in words):
        return None
    state, in_clause = 0, False
    total = aimed = negated = reported = plain = 0.0
    insults, said, clauses, threats, ahead = set(), set(), 0, 0, 0
    for token in SYMBOL.findall(low):
        weight = lexicon[token]
        symbol = INSULT if weight else CLASSES.get(token, OTHER)
        state, mark = table[state, symbol]
        if symbol == INSULT:
            if token in said:  # once per clause, however often it is repeated there
                continue
            said.add(token)
            insults.add(token)
            total += weight
            aimed += weight * bool(mark & AIMED)
            negated += weight * bool(mark & NEGATED)
            reported += weight * bool(mark & REPORTED)
            plain += weight * (mark & (NEGATED | REPORTED) == 0)
            in_clause = True
        elif symbol == THREAT and mark & AIMED and not mark & NEGATED:
            threats += 1
            in_clause = True
        elif mark & ANSWERED:
            ahead += 1
            in_clause = True
        elif symbol == END:
            clauses += in_clause
            in_clause = False
            said.clear()
    return [total, plain, aimed, negated, reported, len(insults), clauses + in_clause, threats, len(words), ahead]


def _evidence(n1, n0, t1, t0):
    """Log-likelihood ratio and smoothed log-odds of a key seen in n1 toxic and
    n0 clean rows of t1 and t0."""
    n, t = n1 + n0, t1 + t0

    def part(k, size, share):
        return F.when(k > 0, k * F.log(k / (size * share))).otherwise(F.lit(0.0))
    p = t1 / t
    ratio = 2 * (part(n1, n, p) + part(n0, n, 1 - p))
    return ratio, F.log((n1 + 0.5) / (t1 + 1)) - F.log((n0 + 0.5) / (t0 + 1))


def held_out(doc_id="doc_id") -> Column:
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % FOLDS == 0, F.lit(True))


class Model:
    def __init__(self, weights: dict[str, float], coefficients):
        self.weights, self.coefficients = weights, coefficients


def training_rows(docs: DataFrame, labels: DataFrame, fit_rows: int) -> DataFrame:
    """(doc_id, text, toxic, fold) of at most fit_rows labelled rows not held out."""
    labelled = (
        labels.select(F.col("doc_id").cast("bigint").alias("doc_id"), "toxic")
        .filter(F.col("toxic").isNotNull() & ~held_out())
        .groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic")))
    # ids first: only the texts of the rows chosen move
    order = F.xxhash64(F.lit(5), "doc_id")
    chosen = labelled.orderBy(order, "doc_id").limit(fit_rows)
    texts = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    # one row per text: copies are no further evidence
    first = F.row_number().over(Window.partitionBy(F.sha2("text", 256)).orderBy("doc_id"))
    rows = texts.join(chosen, "doc_id").dropDuplicates(["doc_id"]).withColumn("copy", first).filter("copy = 1")
    return stored(rows.select("doc_id", "text", "toxic", F.pmod(order, F.lit(2)).cast("int").alias("fold")),
                  "toxicity-rows")


def learn_lexicons(rows: DataFrame) -> tuple[dict, dict, dict]:
    """Lexicons from the rows of fold 0, of fold 1, and of both."""
    def keys(texts):
        import pyarrow as pa
        return pa.array([list({k for w in set(WORD.findall(t.lower())) for k in keys_of(w)})
                         for t in texts.to_pylist()], pa.list_(pa.string()))
    sizes = {(r["fold"], r["toxic"]): r["n"] for r in rows.groupBy("fold", "toxic").agg(
        F.count(F.lit(1)).alias("n")).collect()}
    seen = rows.select("fold", "toxic", F.explode(F.arrow_udf(keys, "array<string>")("text")).alias("key"))
    n = {(f, y): F.sum(F.when((F.col("fold") == f) & (F.col("toxic") == y), 1).otherwise(0)) for f in (0, 1) for y in (0, 1)}
    counts = seen.groupBy("key").agg(*[c.alias(f"n_{f}_{y}") for (f, y), c in n.items()])
    scored, good = counts, F.lit(False)
    for name, folds in (("0", (0,)), ("1", (1,)), ("both", (0, 1))):
        n1, n0 = (sum(F.col(f"n_{f}_{y}") for f in folds) for y in (1, 0))
        t1, t0 = (sum(sizes.get((f, y), 0) for f in folds) for y in (1, 0))
        if not t1 or not t0:
            scored = scored.withColumns({f"w_{name}": F.lit(0.0), f"e_{name}": F.lit(0.0)})
            continue
        ratio, odds = _evidence(n1, n0, float(t1), float(t0))
        weight = F.when((ratio >= MIN_EVIDENCE) & (odds >= MIN_WEIGHT), odds).otherwise(0.0)
        scored = scored.withColumns({f"w_{name}": weight, f"e_{name}": ratio})
        good = good | (F.col(f"w_{name}") > 0)
    # at most a few per cent of the keys of a bounded number of rows
    found = scored.filter(good).collect()

    def lexicon(name):
        weights = {r["key"]: r[f"w_{name}"] for r in found if r[f"w_{name}"] > 0}
        weak = [r["key"] for r in found if r["key"][0] == "=" and r[f"e_{name}"] < STRONG_EVIDENCE
                and not any(k in weights for k in keys_of(r["key"][1:])[1:])]
        for key in weak:
            weights.pop(key, None)
        return weights
    return lexicon("0"), lexicon("1"), lexicon("both")


def _design(features):
    return np.column_stack([np.ones(len(features)), np.log1p(np.asarray(features, float).reshape(-1, FEATURES))])


def logistic(x, y, ridge: float = 0.05, steps: int = 40):
    """Coefficients of a ridge-penalized logistic regression, by damped Newton."""
    beta = np.zeros(x.shape[1])
    penalty = np.full(x.shape[1], ridge * len(y) ** 0.5)
    penalty[0] = 1e-6

    def loss(b):
        return np.logaddexp(0, x @ b).sum() - y @ (x @ b) + 0.5 * (penalty * b * b).sum()
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        gradient = x.T @ (p - y) + penalty * beta
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.diag(penalty + 1e-9), gradient)
        size = 1.0
        while loss(beta - size * step) > loss(beta) and size > 1e-4:
            size /= 2
        beta = beta - size * step
        if np.abs(step).max() < 1e-6:
            break
    return beta


def fit(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS) -> Model | None:
    """Learn lexicon and pattern weights; None without labels of both kinds.

    Driver memory: the features of at most fit_rows rows."""
    rows = training_rows(docs, labels, fit_rows)
    first, second, both = learn_lexicons(rows)

    def features(batches):
        import pyarrow as pa
        # each fold is matched with the lexicon of the other
        lexicons, table = [Lexicon(second), Lexicon(first)], grammar()[1]
        for batch in batches:
            fold, text, toxic = (batch.column(i).to_pylist() for i in range(3))
            found = [patterns(t, lexicons[f], table) or [0.0] * FEATURES for f, t in zip(fold, text)]
            yield pa.RecordBatch.from_arrays([pa.array(toxic, pa.int32()), pa.array(
                [list(map(float, f)) for f in found], pa.list_(pa.float64()))], names=["toxic", "f"])
    got = rows.select("fold", "text", "toxic").mapInArrow(features, "toxic int, f array<double>").toPandas()
    y = got["toxic"].to_numpy(float)
    if not 0 < y.sum() < len(y):
        return None
    return Model(both, logistic(_design(np.stack(got["f"])), y))


def score(docs: DataFrame, model: Model | None, name: str = "score") -> DataFrame:
    """docs with the score (0 to 1) of each row's whole text, in place."""
    schema = T.StructType([*docs.schema.fields, T.StructField(name, T.DoubleType())])
    if model is None:
        return docs.withColumn(name, F.lit(0.0))
    position = [c.lower() for c in docs.columns].index("text")
    weights, beta = model.weights, np.asarray(model.coefficients)

    def run(batches):
        import pyarrow as pa
        lexicon, table = Lexicon(weights), grammar()[1]
        for batch in batches:
            found = [patterns(t.as_py() or "", lexicon, table) or [0.0] * FEATURES for t in batch.column(position)]
            z = _design(found) @ beta
            scores = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(scores, pa.float64())],
                                             names=[*batch.schema.names, name])
    return docs.mapInArrow(run, schema)


def annotate(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS) -> DataFrame:
    """doc_id, held_out, score and predicted of all docs."""
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    scored = score(rows, fit(docs, labels, fit_rows))
    return scored.select("doc_id", held_out().alias("held_out"), "score",
                         (F.col("score") >= 0.5).cast("int").alias("predicted"))


def reject(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS) -> DataFrame:
    """The rows of docs that score below 0.5, with their columns."""
    taken = {c.lower() for c in docs.columns}
    name = next(n for n in ("score", *(f"score_{i}" for i in range(len(taken) + 1))) if n not in taken)
    return score(docs, fit(docs, labels, fit_rows), name).filter(F.col(name) < 0.5).drop(name)
