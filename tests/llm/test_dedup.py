import hashlib
import itertools
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import Window, functions as F

from shotcurve.llm import components, exact_dedup, line_dedup, simhash_dedup, substring_dedup

DOCS = "doc_id bigint, text string, lang string, digest string, fp string"


def prose(seed, n):
    rng = random.Random(seed)
    return " ".join("".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 6))) for _ in range(n))


def test_exact_dedup_folds_batches_into_the_index(spark):
    index = exact_dedup.DigestIndex(spark, buckets=4)
    first = spark.createDataFrame([(1, "a"), (2, "a"), (3, None), (4, ""), (None, "b"), (5, "c"), (5, "c")],
                                  "doc_id bigint, text string")
    got = {(r.doc_id, r.text_sha256): r for r in exact_dedup.annotate(first, index).collect()}
    sha = {t: hashlib.sha256(t.encode()).hexdigest() for t in ("a", "", "b", "c")}
    assert (got[1, sha["a"]].keep_id, got[1, sha["a"]].kept, got[2, sha["a"]].kept) == (2, False, True)
    assert got[3, sha[""]].keep_id == 4 and got[3, sha[""]].group_size == 2
    assert got[None, sha["b"]].kept and got[None, sha["b"]].keep_id is None
    again = exact_dedup.annotate(first, exact_dedup.DigestIndex(spark, buckets=4))
    assert again.filter("doc_id = 5").agg(F.sum(F.col("kept").cast("int"))).first()[0] == 1
    # a second batch meets the first one's digests, also from a new handle on the files
    second = spark.createDataFrame([(9, "a"), (10, "new")], "doc_id bigint, text string")
    reopened = exact_dedup.DigestIndex(spark, index.path, buckets=4)
    got = {r.doc_id: r for r in exact_dedup.annotate(second, reopened).collect()}
    assert (got[9].kept, got[9].keep_id, got[10].kept) == (False, 2, True)
    assert exact_dedup.DigestIndex(spark, index.path, buckets=4).read().count() == 5


def test_exact_dedup_keeps_columns_and_one_of_repeated_rows(spark):
    rows = [(1, "a", "x", "d1", "f"), (2, "a", "y", "d2", "f"), (2, "a", "y", "d2", "f"), (None, None, None, None, None)]
    docs = spark.createDataFrame(rows, DOCS)
    got = exact_dedup.deduplicate(docs, exact_dedup.DigestIndex(spark, buckets=4))
    assert got.columns == docs.columns
    assert sorted(map(tuple, got.collect()), key=str) == [(2, "a", "y", "d2", "f"), (None,) * 5]
    assert exact_dedup.deduplicate(docs.limit(0), exact_dedup.DigestIndex(spark, buckets=4)).count() == 0


def fingerprint(text, k=4):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    hashes = [xxhash.xxh64_intdigest(" ".join(words[i:i + k]).encode(), 42) for i in range(max(1, len(words) - k + 1))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def linked_groups(values, bits):
    parent = list(range(len(values)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i
    for i, j in itertools.combinations(range(len(values)), 2):
        if bin(values[i] ^ values[j]).count("1") <= bits:
            a, b = find(i), find(j)
            parent[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(values))]


def test_simhash_query_equals_brute_force(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    texts = sorted((r.doc_id, r.text) for r in docs.select("doc_id", "text").collect())
    values = [fingerprint(t) for _, t in texts]
    roots = linked_groups(values, 4)
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in simhash_dedup.annotate(docs).collect()}
    assert got == {d: (f"{v:016x}", texts[r][0]) for (d, _), v, r in zip(texts, values, roots)}


def test_simhash_links_through_split_groups_and_other_block_choices(spark):
    rng = random.Random(3)
    centres = [rng.getrandbits(64) for _ in range(12)]
    values = sorted({c ^ sum(1 << b for b in rng.sample(range(64), rng.randint(0, 4))) for c in centres for _ in range(30)})
    roots = linked_groups(values, 4)
    signed = [v - (1 << 64) if v >> 63 else v for v in values]
    fps = spark.createDataFrame(list(zip(signed, range(len(values)))), "fp bigint, doc_id bigint")
    for agree, split in ((1, 100_000), (1, 3), (2, 100_000)):
        groups = simhash_dedup.fingerprint_groups(fps, 4, agree, split).collect()
        assert {r.doc_id: r.component_id for r in groups} == dict(enumerate(roots))


def test_gray_index_prunes_and_links_exactly():
    rng = np.random.default_rng(5)
    for n, width in ((1, 64), (2, 64), (257, 30), (400, 12), (700, 24)):
        values = np.unique(np.array([sum(1 << int(b) for b in rng.choice(width, rng.integers(0, 7), replace=False))
                                     for _ in range(n)], np.uint64))
        rank = values.copy()
        for s in (1, 2, 4, 8, 16, 32):
            rank ^= rank >> np.uint64(s)
        values = values[np.argsort(rank)]
        for bits in (0, 1, 4):
            assert simhash_dedup.join_group(values, bits).tolist() == linked_groups(values.tolist(), bits)


def test_simhash_deduplicate_edge_cases(spark):
    long = prose(1, 3000)
    rows = [(5, long, "x", "d", "f"), (3, long + " tail", "y", "d", "f"), (3, long + " tail", "y", "d", "f"),
            (7, "", "", "", ""), (8, None, None, None, None), (None, prose(2, 40), "z", None, None)]
    docs = spark.createDataFrame(rows, DOCS)
    got = simhash_dedup.deduplicate(docs)
    assert got.columns == docs.columns
    assert sorted((r.doc_id or 0, r.lang) for r in got.collect()) == [(0, "z"), (3, "y"), (7, "")]
    assert simhash_dedup.deduplicate(docs.limit(0)).count() == 0
    assert simhash_dedup.annotate(docs.limit(0)).count() == 0


def test_components_of_long_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 130)] + [(200, 201), (201, 200), (300, 300)]
    got = {r.node: r.component for r in components.components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert got == {**{i: 0 for i in range(41)}, **{i: 100 for i in range(100, 130)}, 200: 200, 201: 200}


def test_substring_dedup_finds_planted_passages(spark):
    passage, other = prose(10, 60), prose(11, 80)
    words = passage.split()
    edited = " ".join(w if i % 15 else "changed" for i, w in enumerate(words))
    dropped = " ".join(words[:30] + words[32:] + ["more"] * 2)
    rows = [(i, prose(100 + i, 300)) for i in range(8)]
    rows += [(20, f"{prose(20, 100)} {passage} {prose(21, 50)}"), (21, f"{prose(22, 10)} {passage.upper()}"),
             (22, f"{edited} {prose(23, 90)}"), (23, f"{prose(24, 5)} {dropped} {prose(25, 9)}"),
             (30, other), (31, other), (31, other), (32, prose(26, 30) + " " + " ".join(other.split()[:20])),
             (40, None), (41, ""), (42, "one two"), (None, passage), (50, "the " * 70 + prose(27, 30)),
             (51, prose(28, 30) + " the" * 70)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = substring_dedup.repeated_passages(docs).collect()
    links = {(r.doc_id, r.partner_id): r for r in got}
    assert set(links) == {(21, 20), (22, 20), (23, 20), (31, 30), (51, 50), (None, 20)}  # a null id is a document, too
    whole = links[21, 20]
    assert (whole.start_word, whole.end_word, whole.partner_start, whole.identity) == (10, 70, 100, 1.0)
    assert links[31, 30].words == 80
    assert links[22, 20].words >= 55 and links[23, 20].words >= 55
    assert substring_dedup.repeated_passages(docs.limit(0)).count() == 0


def test_exact_passage_is_found_where_its_short_seeds_were_seen_before(spark):
    # all 5-grams of the passage occur in earlier documents, in another one each
    for words in (50, 60):
        passage = prose(60, words).split()
        rows = [(i, f"{prose(1000 + i, 30)} {' '.join(passage[i:i + 5])} {prose(2000 + i, 30)}") for i in range(words - 4)]
        rows += [(200, f"{prose(61, 40)} {' '.join(passage)} {prose(62, 40)}"),
                 (300, f"{prose(63, 25)} {' '.join(passage)} {prose(64, 40)}"),
                 (400, f"{prose(65, 25)} {' '.join(passage[:49])} {prose(66, 40)}")]
        docs = spark.createDataFrame(rows, "doc_id bigint, text string")
        got = substring_dedup.repeated_passages(docs).collect()
        assert [(r.doc_id, r.start_word, r.end_word, r.partner_id, r.partner_start) for r in got] == [
            (300, 25, 25 + words, 200, 40)]


def quoted_twice(rng, n, words, identity):
    """Pairs of fuzzy copies, each with two earlier documents that quote a half of the first."""
    rows, pairs = [], []
    for i in range(n):
        base = [f"w{i}x{j}" for j in range(words)]
        at = rng.sample(range(words), round(words * (1 - identity)))
        other = [f"v{i}x{j}" if j in at else w for j, w in enumerate(base)]
        half = words // 2
        parts = [base[:half], base[half:], base, other]
        own = [[f"u{i}x{q}x{j}" for j in range(30)] for q in range(len(parts))]
        rows += [(100 * i + q, " ".join(o[:15] + p + o[15:])) for q, (p, o) in enumerate(zip(parts, own))]
        pairs.append((100 * i + 3, 100 * i + 2))
    return rows, pairs


def test_fuzzy_copies_meet_beside_earlier_quotes(spark):
    rows, pairs = quoted_twice(random.Random(7), 20, 80, 0.9)
    found = substring_dedup.repeated_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert set(pairs) <= {(r.doc_id, r.partner_id) for r in found if r.words >= 60}
    # the halves are too short to be passages
    assert {(r.doc_id, r.partner_id) for r in found} == set(pairs)


@pytest.mark.parametrize("few", [64, 1])
def test_fuzzy_copies_meet_whatever_stands_between(spark, few):
    """Two documents that quote halves come before a text, and two after it, before its fuzzy copy."""
    rng, rows, pairs = random.Random(8), [], []
    for i in range(10):
        base = [f"w{i}x{j}" for j in range(80)]
        at = rng.sample(range(80), 8)
        other = [f"v{i}x{j}" if j in at else w for j, w in enumerate(base)]
        parts = [base[:40], base[40:], base, base[:40], base[40:], other]
        rows += [(100 * i + q, " ".join([f"u{i}x{q}x{j}" for j in range(15)] + p + [f"t{i}x{q}x{j}" for j in range(15)]))
                 for q, p in enumerate(parts)]
        pairs.append((100 * i + 5, 100 * i + 2))
    found = substring_dedup.repeated_passages(spark.createDataFrame(rows, "doc_id long, text string"), few=few).collect()
    assert {(r.doc_id, r.partner_id) for r in found if r.words >= 60} == set(pairs)


def test_other_links_move_matches_only(spark):
    """Matches met twice are told apart by their four columns; those of their seeds are not moved with them."""
    held = spark.createDataFrame([(s, d, 10 * s) for s in range(3) for d in range(9)], "seed long, doc long, pos int")
    docs = spark.createDataFrame([(d, " ".join(["w"] * 80)) for d in range(9)], "doc_id long, text string")
    long = spark.createDataFrame([], "doc long, pos int, words int")
    found = substring_dedup.other_links(docs, substring_dedup.links(held), held.limit(0), long, few=2)
    assert found.columns == ["doc", "pos", "partner", "partner_pos"] and found.count() > 0
    plan = found._jdf.queryExecution().executedPlan().toString().splitlines()
    assert not [x for x in plan if "Aggregate(keys=" in x and "partner_pos" in x and "before_pos" in x]


@pytest.mark.parametrize("few, part_rows", [(1000, 1000), (1000, 3), (2, 4)])
def test_other_links_are_all_matches_outside_copies(spark, few, part_rows):
    rng = random.Random(4)
    rows = list({(rng.randrange(12), rng.randrange(40), rng.randrange(60)) for _ in range(500)})
    rows = list({(d, p): (s, d, p) for s, d, p in rows}.values())
    spans = [(d, rng.randrange(40), 10) for d in range(0, 40, 2)]
    held = spark.createDataFrame(rows, "seed long, doc long, pos int")
    short = substring_dedup.links(held)
    many = F.count(F.lit(1)).over(Window.partitionBy("seed", "doc")) > 1
    long = spark.createDataFrame(spans, "doc long, pos int, words int")
    docs = spark.createDataFrame([(d, " ".join(["w"] * 200)) for d in range(40)], "doc_id long, text string")
    got = [tuple(r) for r in substring_dedup.other_links(
        docs, short, held.withColumn("m", many).filter("m").drop("m"), long, few=few, part_rows=part_rows).collect()]
    known = {x for r in short.collect() for x in ((r.doc, r.pos, r.partner, r.partner_pos), (r.doc, r.pos, r.before, r.before_pos))}
    copied = {(d, p) for _, d, p in rows for e, at, n in spans if d == e and at <= p and p + 5 <= at + n}
    want = {(d, p, e, q) for s, d, p in rows for t, e, q in rows
            if s == t and e < d and (d, p) not in copied and (e, q) not in copied} - known
    assert len(got) == len(set(got))
    if few > 2:
        assert set(got) == want
        return
    # those with a second match nearby, before or after on both sides; on one diagonal, of 40 equal words around
    at, alone = {}, [x for x in rows if x[1:] not in copied]
    for s, d, p in rows:
        at.setdefault(d, []).append((s, p))
    beside = {(d, p): {(t, o > p) for t, o in at[d] if o != p} for _, d, p in rows}
    common = {s for s, n in Counter(s for s, _, _ in alone).items() if n > few}
    seed = {x[1:]: x[0] for x in rows}
    kept = {x for x in want if seed[x[:2]] not in common or beside[x[:2]] & beside[x[2:]]}
    assert set(got) == kept and len(got) > 100


def test_a_chain_is_told_by_a_third_document_that_has_both_sides(spark):
    chains = spark.createDataFrame([(9, 5, [10, 30], [20, 60], [0, 0])],
                                   "doc long, partner long, starts array<long>, ends array<long>, diagonals array<long>")
    for found, left in (([(9, 1, 0, 80)], 1), ([(9, 1, 0, 80), (5, 1, 10, 65)], 0), ([(9, 1, 0, 80), (5, 2, 0, 90)], 1),
                        ([(9, 1, 0, 80), (5, 1, 11, 90)], 1), ([(9, 1, 0, 64), (5, 1, 0, 90)], 1)):
        rows = spark.createDataFrame(found, "doc_id long, partner_id long, start_word long, end_word long")
        assert substring_dedup.unexplained(chains, rows, 5).count() == left


@pytest.mark.parametrize("partitions", [1, 3, 16])
def test_links_go_to_the_first_and_the_next_document_before(spark, partitions):
    rng = random.Random(partitions)
    rows = list({(rng.choice([1, 1, 1, rng.randrange(2, 60)]), rng.randrange(-5, 300), rng.randrange(40)) for _ in range(3000)})
    want = set()
    held = {}
    for seed, doc, pos in sorted(rows):
        held.setdefault(seed, {}).setdefault(doc, []).append(pos)
    for docs in held.values():
        order = sorted(docs)
        for i, doc in enumerate(order[1:], 1):
            for pos in docs[doc]:
                want.add((doc, pos, order[0], docs[order[0]][0], order[i - 1], docs[order[i - 1]][0]))
    before = spark.conf.get("spark.sql.shuffle.partitions")
    adaptive = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    try:
        spark.conf.set("spark.sql.shuffle.partitions", partitions)
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        got = substring_dedup.links(spark.createDataFrame(rows, "seed long, doc long, pos int")).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", adaptive)
    assert {tuple(r) for r in got} == want
    assert len(got) == sum(len(p) for docs in held.values() for d, p in docs.items() if d != min(docs))


def test_links_of_no_seeds(spark):
    assert substring_dedup.links(spark.createDataFrame([], "seed long, doc long, pos int")).count() == 0


def test_long_matches_are_all_repeated_runs(spark):
    rng = random.Random(12)
    texts = [[rng.choice("abc") for _ in range(rng.randint(0, 90))] for _ in range(40)]
    texts += [t[rng.randint(0, 9):] + ["d"] * rng.randint(0, 9) for t in texts[:20]] + texts[10:15]
    texts += [["a"] * 30, ["a", "b"] * 20, ["b"] + ["a"] * 25, *([prose(7, 60).split()] * 3)]
    docs = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id bigint, text string")
    holders = {}
    for i, t in enumerate(texts):
        for p in range(len(t) - 11):
            holders.setdefault(tuple(t[p:p + 12]), []).append((i, p))
    want = {x for at in holders.values() for x in at if x[0] > at[0][0]}
    found = substring_dedup.seeds(docs, 3, 4, 12).filter("block is not null")
    rows = substring_dedup.long_matches(docs, found, 12).collect()
    assert {(r.doc, p) for r in rows for p in range(r.pos, r.pos + r.words - 11)} == want
    for r in rows:
        assert r.partner < r.doc
        assert texts[r.doc][r.pos:r.pos + r.words] == texts[r.partner][r.partner_pos:r.partner_pos + r.words]
    assert any(r.words > 12 for r in rows) and any(r.words == 12 for r in rows)
    beyond = spark.createDataFrame([(41, 0, 90), (41, 95, 3)], "doc bigint, pos int, count int")
    assert substring_dedup.long_seeds(docs, beyond, 12).count() <= 90


def test_chain_takes_the_best_collinear_runs():
    # rows: start, end, diagonal, seeds; the third crosses the others
    runs = np.array([[0, 20, 0, 5], [30, 60, 2, 6], [25, 28, -500, 2], [62, 90, 1, 6]])
    chains = substring_dedup.chain(runs, 5)
    assert chains[0] == [0, 1, 3] and sorted(sum(chains, [])) == [0, 1, 2, 3]


def test_seeds_of_equal_runs_agree_whatever_the_context():
    hashes = substring_dedup.Hashes()
    shared = prose(5, 30)
    a, b, short = hashes.words(pa.array([f"{prose(s, 40)} {shared} {prose(s + 1, 40)}" for s in (1, 3)] + ["a b"]))
    one, two = (set(substring_dedup.seed_positions(hashes, x, 5, 12)[1].tolist()) for x in (a, b))
    assert len(one & two) >= 2
    assert len(substring_dedup.seed_positions(hashes, short, 5, 12)[0]) == 0


def test_hashes_stand_for_words_and_runs_of_words():
    rng = random.Random(9)
    texts = ["", " ", "  a\tB \x0bc", "x", " x", "ÄÖ a Ab\x85c d\n", "a " * 100, "\n\n", "end"]
    texts += ["".join(rng.choice("abAB é\t\n") for _ in range(rng.randrange(60))) for _ in range(400)]
    hashes, names, runs = substring_dedup.Hashes(), {}, {}
    for array in (pa.array(texts), pa.array(texts).slice(3)):
        for text, got in zip(array.to_pylist(), hashes.words(array)):
            words = [w.decode() for w in text.encode().lower().split()]
            assert [names.setdefault(w, h) for w, h in zip(words, got.tolist())] == got.tolist() and len(words) == len(got)
            for k in (2, 5):
                found = hashes.mers(got, k).tolist()
                assert [runs.setdefault(tuple(words[i:i + k]), h) for i, h in enumerate(found)] == found
    assert len(set(names.values())) == len(names) and len(set(runs.values())) == len(runs)


def test_smallest_of_each_window():
    rng = np.random.default_rng(5)
    for n, window in ((0, 3), (2, 3), (3, 3), (700, 12), (50, 35), (600_000, 7)):
        h = rng.integers(0, 1 << 63, n).astype(np.uint64) << np.uint64(1)
        h[n // 2:n // 2 + 20] = 7 << 20
        want = [int(np.argmin(h[i:i + window])) + i for i in range(0, max(n - window + 1, 0), max(1, n // 700))]
        assert substring_dedup.smallest(h, window)[::max(1, n // 700)].tolist() == want


def test_rows_without_an_id_of_their_own_are_documents(spark):
    a, b, c = prose(51, 90), prose(52, 90), prose(53, 90)
    rows = [(1, a), (1, b), (3, b), (None, a), (None, c), (5, c), (None, c), (7, prose(54, 90)), (7, prose(54, 90))]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").withColumn("own", F.lit(1))
    got = {(r.doc_id, r.partner_id) for r in substring_dedup.repeated_passages(docs).collect()}
    pairs = {frozenset(p) for p in got}
    assert pairs == {frozenset((1, 3)), frozenset((None, 1)), frozenset((None, 5))}
    assert substring_dedup.repeated_passages(docs.limit(0)).count() == 0


def test_alignment_takes_the_longest_segment_of_the_identity():
    def segments(*runs, identity=0.8):
        # runs of equal and different words by turns, the first ones different
        hit = np.repeat(np.arange(len(runs)) % 2 == 1, runs)
        x = np.arange(len(hit))
        got = substring_dedup.align(x, np.where(hit, x, -1), [0], [0], [0], 5, 50, identity)
        return [(s, e) for s, e, *_ in got]
    for a, b, c in ((30, 6, 20), (30, 5, 20), (45, 7, 25), (49, 13, 49)):
        assert segments(70, a, b, c, 70) == [(70, 70 + a + b + c)]
    assert segments(0, 60, 40) == [(0, 60)] and segments(40, 60, 0) == [(40, 100)]
    assert segments(10, 60, 9, 1, 50) == [(10, 70)]  # a chance hit does not stretch a passage
    assert segments(10, 48, 1, 3, 60) == [(10, 62)]
    assert segments(10, 60, 200, 55, 3) == [(10, 70), (270, 325)]
    assert segments(5, 49, 90, 49, 5) == [] and segments(200) == [] and segments(0, 80) == [(0, 80)]
    rng = np.random.default_rng(3)
    for n in range(1, 60):
        hit = rng.random(n) < rng.choice([0.5, 0.8, 0.9])
        want = max([j - i for i in range(n) for j in range(i + 1, n + 1)
                    if hit[i] and hit[j - 1] and 5 * hit[i:j].sum() >= 4 * (j - i)], default=0)
        start, end = substring_dedup.longest(hit, 0.8)
        assert end - start == want and 5 * hit[start:end].sum() >= 4 * (end - start)


def test_line_dedup_drops_boilerplate_of_the_site_only(spark):
    page = "<html><nav><a>Menu</a></nav><p>{}</p><script>x('</p>')</script><!-- c --><footer>Foot</footer></html>"
    rows = [(i, f"http://a.org/{i}", page.format(f"text {i}")) for i in range(5)]
    rows += [(10, "http://b.org/", page.format("alone")), (11, None, page.format("no host")), (12, "http://a.org/n", None),
             (0, "http://a.org/0", page.format("text 0"))]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string").withColumn("text", F.lit("own"))
    got = line_dedup.drop_boilerplate(pages).select("row.page_id", "row.text", "host", "n_lines", "n_dropped",
                                                    F.col("text").alias("kept")).collect()
    by = {r.page_id: r for r in got}
    assert len(got) == 9 and all(r.text == "own" for r in got)
    assert (by[1].kept, by[1].n_lines, by[1].n_dropped) == ("text 1", 3, 2)
    assert by[10].kept == "Menu\nalone\nFoot" and by[11].n_dropped == 0
    assert (by[12].n_lines, by[12].kept) == (0, "")
    assert line_dedup.drop_boilerplate(pages.limit(0)).count() == 0


def test_passages_leave_no_shuffle_files_behind(spark):
    """Shuffle files of the stored steps are gone when they are stored, whether or not the driver collects garbage."""
    import pathlib
    import time

    def shuffles():
        folders = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirs()
        return {f.name for d in folders for f in pathlib.Path(d.getPath()).rglob("shuffle_*.data")}

    text = " ".join(f"w{i}" for i in range(80))
    docs = spark.createDataFrame([(i, f"a{i} b{i} {text} c{i}") for i in range(4)], "doc_id bigint, text string")
    setting = spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled")
    before = shuffles()
    found = substring_dedup.repeated_passages(docs)
    deadline = time.time() + 10
    while (left := shuffles() - before) and time.time() < deadline:
        time.sleep(0.2)
    assert not left
    assert spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled") == setting
    assert {(r.doc_id, r.partner_id) for r in found.collect()} >= {(1, 0), (2, 0), (3, 0)}
