import math
import random
from collections import Counter

import pytest

from shotcurve.operators import selection, similarity


def grams(t):
    c = Counter()
    for w in t.lower().split():
        w = f" {w} "
        for n in (2, 3, 4):
            for i in range(len(w) - n + 1):
                c[w[i:i + n]] += 1
    return c


def brute_force(test_input, examples):
    """One corpus per test input: idf, vectors and cosines from the definition."""
    docs = [grams(t) for t in [test_input, *examples]]
    n = len(docs)
    df = Counter(g for d in docs for g in d)
    vectors = [{g: tf * (math.log((1 + n) / (1 + df[g])) + 1) for g, tf in d.items()} for d in docs]

    def cosine(a, b):
        la, lb = (math.sqrt(sum(v * v for v in x.values())) for x in (a, b))
        return sum(v * b.get(g, 0) for g, v in a.items()) / (la * lb) if la and lb else 0.0
    return [cosine(vectors[0], v) for v in vectors[1:]]


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(5)
    syllables = ["ka", "to", "ri", "é", "sch", "ng", "猫", "犬", "x"]

    def text():
        return " ".join("".join(rng.choice(syllables) for _ in range(rng.randrange(1, 4))) for _ in range(rng.randrange(1, 8)))
    examples = [("t1", i, text()) for i in range(25)] + [("t2", i, text()) for i in range(4)]
    examples += [("t1", 25, examples[3][2]), ("t3", 0, "zzz"), ("t3", 1, "qqq"), ("t3", 2, "𠮷𠮷")]
    cases = [(t, f"{t}-{i}", text()) for t in ("t1", "t2") for i in range(6)]
    cases += [("t3", "none", "www"), ("t3", "blank", "  "), ("t3", "wide", "𠮷𠮷"), ("t1", "same", examples[3][2])]
    return cases, examples


@pytest.mark.parametrize("options", [{}, {"block_rows": 3}, {"block_rows": 4, "chunk_rows": 2}])
def test_ranking_against_brute_force(spark, texts, options):
    cases, examples = texts
    c = spark.createDataFrame(cases, "task_id string, case_key string, input string")
    e = spark.createDataFrame(examples, "task_id string, pos int, input string")
    got = {}
    for r in similarity.rank_by_similarity(c, e, 6, **options).collect():
        got.setdefault(r["case_key"], {})[r["rank"]] = (r["pos"], r["similarity"])
    for task, key, text in cases:
        pool = [t for k, _, t in examples if k == task]
        sims = [round(s, 10) for s in brute_force(text, pool)]
        best = sorted(range(len(pool)), key=lambda i: (-sims[i], -i))[:6]
        mine = [got[key][k + 1] for k in range(len(best))]
        assert [p for p, _ in mine] == best, key
        assert [s for _, s in mine] == pytest.approx([sims[i] for i in best], abs=2e-10)
        assert len(got[key]) == len(best)


def test_selection_rules(spark):
    examples = spark.createDataFrame(
        [("t", i, f"in{i}", f"out{i}", False) for i in range(3)] + [("t", 0, "d0", "x", True), ("only", 0, "d", "x", True)],
        "task_id string, pos int, input string, output string, is_distractor boolean")
    grid = spark.createDataFrame(
        [(t, i, s, m) for t, i in (("t", "in1"), ("t", ""), ("only", "q"), ("new", "q")) for s in (0, 2, 8) for m in ("fixed", "tfidf")],
        "task_id string, input string, shot_count int, example_selection string")
    got = {(r["task_id"], r["input"], r["shot_count"], r["example_selection"]): [e["input"] for e in r["selected"]]
           for r in selection.select_examples(grid, examples).collect()}
    assert len(got) == 24
    assert got["t", "in1", 0, "tfidf"] == [] == got["t", "in1", 0, "fixed"]
    assert got["t", "in1", 2, "fixed"] == ["in0", "d0"]
    assert got["t", "in1", 2, "tfidf"] == ["in1", "d0"]
    assert got["t", "in1", 8, "fixed"] == ["in0", "in1", "in2", "d0"]
    assert got["t", "", 2, "tfidf"] == ["in0", "d0"]  # empty input falls back to fixed
    assert got["only", "q", 2, "fixed"] == ["d"]
    assert got["only", "q", 2, "tfidf"] == []  # no exemplars, nothing shown
    assert got["new", "q", 8, "fixed"] == got["new", "q", 8, "tfidf"] == []


def test_shuffle_is_reproducible(spark):
    rows = [(f"t{i}", [("a", "1", False), ("b", "2", False), ("c", "3", True), ("d", "4", False)]) for i in range(40)]
    df = spark.createDataFrame(rows, f"task_id string, selected {selection.SELECTED}")

    def order(seed):
        return {r["task_id"]: "".join(e["input"] for e in r["selected"])
                for r in selection.shuffle_examples(df, seed).repartition(3).collect()}
    assert order(1) == order(1)
    assert order(1) != order(2)
    assert all(sorted(v) == list("abcd") for v in order(1).values())
    assert len(set(order(1).values())) > 5


def test_bounds_spare_most_pairs_their_score(spark, sf_dir):
    """Searches of a block count what they score; the best are those of brute force."""
    import numpy as np

    from shotcurve.operators.postings import Block
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").filter("lang = 'en'").orderBy("doc_id").limit(400)
    pool = [r.text[:1500] for r in docs.collect()]
    asked = [r.text for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").orderBy("item_id").limit(12).collect()]
    pool += [f"{p} {a}" for p, a in zip(pool, asked)] * 3
    codes = {g: i for i, g in enumerate(sorted({g for t in pool + asked for g in grams(t)}))}
    rows = [grams(t) for t in pool]
    bounds = np.concatenate(([0], np.cumsum([len(r) for r in rows])))
    df = np.bincount([codes[g] for r in rows for g in r], minlength=len(codes))
    block = Block(bounds, np.array([codes[g] for r in rows for g in r]), np.array([n for r in rows for n in r.values()]),
                  np.arange(len(pool)), np.arange(len(codes)), df, len(pool))
    for text in asked:
        want = brute_force(text, pool)
        case = grams(text)
        tf, own = np.array(list(case.values())), np.array([codes[g] for g in case])
        length = float(np.sum((tf * (np.log((2 + len(pool)) / (2 + df[own])) + 1)) ** 2))
        at, values = block.best(own, tf, length, 6)
        best = sorted(zip(np.round(values, 10), at), reverse=True)[:6]
        brute = sorted(((round(s, 10), i) for i, s in enumerate(want)), reverse=True)[:6]
        assert [i for _, i in best] == [i for _, i in brute]
        assert [s for s, _ in best] == pytest.approx([s for s, _ in brute], abs=1e-9)
    assert block.scored < 0.3 * len(asked) * len(pool)


def test_similarities_of_every_case_against_brute_force(spark, texts):
    """All cases, not every fiftieth; pairs without a shared gram are left out."""
    cases, examples = texts
    c = spark.createDataFrame(cases, "task_id string, case_key string, input string")
    e = spark.createDataFrame(examples, "task_id string, pos int, input string")
    got = {(r.case_key, r.pos): r.similarity for r in similarity.Weights(c, e, block_rows=7, chunk_rows=3).similarities().collect()}
    want = {}
    for task, key, text in cases:
        pool = [(p, t) for k, p, t in examples if k == task]
        want |= {(key, p): s for (p, _), s in zip(pool, brute_force(text, [t for _, t in pool])) if s > 0}
    assert got.keys() == want.keys()
    assert [got[k] for k in want] == pytest.approx(list(want.values()), abs=2e-10)


def test_products_merge_repeated_rows(spark):
    """Rows of one position, and cases of one key, count as the sum of their grams, in blocks as in joins."""
    e = spark.createDataFrame([("t", 1, "ab cd"), ("t", 1, "cd ef"), ("t", 2, "ab ab"), ("t", None, "ab")], "task_id string, pos int, input string")
    c = spark.createDataFrame([("t", "k", "ab cd"), ("t", None, "ab")], "task_id string, case_key string, input string")
    weights = similarity.Weights(c, e)
    assert sorted((r.case_key, r.pos) for r in weights.similarities().collect()) == [("k", 1), ("k", 2)]
    lengths = {r.pos: r for r in weights.example_lengths().collect()}
    assert {p: r.num_grams for p, r in lengths.items()} == {1: 24, 2: 6, None: 6}


def test_grams_are_counted_a_few_texts_at_a_time():
    """A task holds the grams of a slice of a batch, however many texts the batch has."""
    import pyarrow as pa

    from shotcurve.operators import grams as counting
    odd = ["", None, "  ", "a", "a𠮷 a b", "x\0y x", "￿ a", "İ ab ab", "猫犬 猫", "y " * 10, "x" * 300_000, "Ab aB"] * 30
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(odd))), pa.array(odd, pa.string())], names=["k", "t"])
    out = list(counting.named_counts([batch]))
    assert max(b.num_rows for b in out) <= counting.TEXTS and len(out) > len(odd) // counting.TEXTS
    got = {r["k"]: {g["gram"]: g["tf"] for g in r["grams"]} for b in out for r in b.to_pylist()}
    assert got == {i: dict(grams(t or "")) for i, t in enumerate(odd)}
    kinds = batch.set_column(0, "k", pa.array([i % 2 for i in range(len(odd))]))
    rows = [r for b in counting.block_counts([kinds]) for r in b.to_pylist()]
    assert len(rows) == len({(r["k"], r["gram"]) for r in rows})  # one row for each gram and block, not for each text


def test_texts_of_a_large_pool_stay_where_they_are(spark):
    """The few chosen examples are sent to the texts; texts are not shuffled and sorted to meet them."""
    pool = spark.createDataFrame([("t", i, f"text {i}", "x", False) for i in range(30)], "task_id string, pos int, input string, output string, is_distractor boolean")
    for df in (selection.first_examples(pool), selection.ranked_examples(pool.select("task_id", "input"), pool)):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan


def test_tasks_of_one_block_need_no_table(spark, monkeypatch):
    """Only sizes are stored, and the best are those of the weight table, also where case keys repeat."""
    rows = [("a", i, w) for i, w in enumerate(["red ring", "blue ring", "blue bolt", "", "𠮷𠮷 x"])] + [("b", 0, "hot bolt")]
    e = spark.createDataFrame(rows, "task_id string, pos int, input string")
    c = spark.createDataFrame([("a", "k", "red bolt"), ("a", "k", "a ring"), ("a", None, "𠮷𠮷"), ("a", "l", ""), ("b", "m", "bolt"), ("c", "n", "x")],
                              "task_id string, case_key string, input string")
    names, real = [], similarity.stored
    monkeypatch.setattr(similarity, "stored", lambda df, name: names.append(name) or real(df, name))
    got = similarity.best_of_blocks(c, e, 3)
    assert names == ["task-sizes"]
    assert got.columns == ["task_id", "case_key", "pos", "similarity"] and got.count() == 13
    order = ["task_id", "case_key", "pos", "similarity"]
    assert got.orderBy(order).collect() == similarity.Weights(c, e).best(3).orderBy(order).collect()
    assert similarity.best_of_blocks(c.limit(0), e, 3).count() == 0
