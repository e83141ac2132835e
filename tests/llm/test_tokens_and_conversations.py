import hashlib
import itertools
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from shotcurve.llm import chunks, conversation_repair, fill_middle, pieces, queries


def digest(text):
    return hashlib.sha256(text.encode()).hexdigest()


# SentencePiece

@pytest.fixture(scope="module")
def library():
    import sentencepiece
    return sentencepiece.SentencePieceProcessor(model_file=queries.piece_model_path())


@pytest.fixture(scope="module")
def vocabulary():
    return pieces.Pieces(queries.piece_model_path())


ODD_TEXTS = ["", " ", "  ", "▁", "▁▁a b́ \U0001f600\x00x\n\n\tfoo  bar", "日本語テキスト 漢字", "<0x0A><s></s><unk>",
             " a" * 50, "x" * 3000, "ááá é​", "a▁ b ", "﻿  ", "word " * 3000]


def test_ids_equal_the_librarys(vocabulary, library):
    rng = random.Random(1)
    letters = [chr(rng.choice([rng.randrange(32, 127), 32, rng.randrange(0xa0, 0x600), rng.randrange(0x3040, 0x3100),
                               0x1f600 + rng.randrange(50), 10])) for _ in range(2000)]
    texts = ODD_TEXTS + ["".join(rng.choice(letters) for _ in range(rng.randrange(150))) for _ in range(800)]
    texts += ["".join(rng.choice("abcerst  .,()_") for _ in range(rng.randrange(150))) for _ in range(800)]
    texts += ["".join(rng.choice(vocabulary.pieces) for _ in range(rng.randrange(40))).replace("▁", " ") for _ in range(800)]
    table = chunks.ChunkIds(vocabulary.seams(), vocabulary.encoder(), prefix=" ")
    for start, part in chunks.slices(pa.array([t.replace("▁", " ") for t in texts])):
        bounds, ids = table.ids(part)
        for i, want in enumerate(library.encode(texts[start:start + len(part)])):
            assert ids[bounds[i]:bounds[i + 1]].to_pylist() == want


def test_compatible_pairs_are_those_the_merges_keep(vocabulary):
    rng = random.Random(2)
    tokens = [p for p in rng.sample(vocabulary.pieces[259:], 300) if p and vocabulary.build(p)[1] == [p]] + ["\x00", "☃"]
    for a, b in itertools.islice(itertools.product(tokens, tokens), 0, None, 7):
        assert vocabulary.compatible(a, b) == (vocabulary.build(a + b)[1] == [a, b])


def test_small_slices_and_forgetting_change_nothing(vocabulary, library, monkeypatch):
    monkeypatch.setattr(chunks, "SLICE_BYTES", 50)
    monkeypatch.setattr(chunks, "REMEMBERED_BYTES", 100)
    monkeypatch.setattr(pieces, "REMEMBERED_PAIRS", 5)
    table = chunks.ChunkIds(vocabulary.seams(), vocabulary.encoder(), prefix=" ")
    texts = ["some words here, and there", "", "x" * 200, "some words", "and there"] * 3
    got = []
    for _, part in chunks.slices(pa.array(texts).slice(1)):
        bounds, ids = table.ids(part)
        got += [ids[a:b].to_pylist() for a, b in itertools.pairwise(bounds)]
    assert got == library.encode(texts[1:])


def test_pieces_query_equals_the_library(spark, sf_dir, library):
    docs = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    rows = queries.pieces_query(spark, sf_dir).collect()
    assert len(rows) == len(docs)
    for r in rows:
        ids = library.encode(docs[r.doc_id])
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (
            len(ids), digest(",".join(map(str, ids))), digest(library.decode(ids)))


def test_pieces_edge_cases(spark, library):
    rows = [(i, t, 0, "x") for i, t in enumerate(ODD_TEXTS)] + [(None, "a b", 0, "x"), (3, None, 0, "x"), (3, None, 0, "x")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, ids int, bounds string")
    got = pieces.decode(pieces.encode(docs, queries.piece_model_path()), queries.piece_model_path()).collect()
    want = [(d, library.encode(t or "")) for d, t, *_ in rows]
    key = lambda r: (r[0] is None, r[0] or 0, r[1])
    assert sorted(((r.doc_id, r.ids) for r in got), key=key) == sorted(want, key=key)
    assert all(r.text == library.decode(r.ids) for r in got)
    assert pieces.encode(docs.limit(0), queries.piece_model_path()).count() == 0


def test_decode_of_any_ids_equals_the_librarys(spark, library):
    rng = random.Random(3)
    low = [i for i in range(1, 300)]
    rows = [(i, [rng.choice(low) if rng.random() < .5 else rng.randrange(1, 32000) for _ in range(rng.randrange(12))])
            for i in range(600)]
    rows += [(1000, None), (1001, []), (1002, [29871, 29871, 13]), (1003, [1, 29871, 2]), (1004, [3 + 0xc3, 29871]), (None, [5])]
    coded = spark.createDataFrame(rows, "doc_id bigint, ids array<int>")
    for r in pieces.decode(coded, queries.piece_model_path()).collect():
        assert r.text == library.decode(r.ids or []), r.ids


# fill in middle

def test_boundary_sets_of_all_containers():
    rng = np.random.default_rng(4)
    sets = [np.array([], np.int64), np.array([5]), np.arange(1, 200_000), np.sort(rng.choice(300_000, 90_000, False)) + 1,
            np.sort(rng.choice(5_000_000, 3000, False)), np.concatenate([np.arange(70_000), 200_000 + 3 * np.arange(30_000)])]
    kinds = set()
    for offsets in sets:
        made = fill_middle.Boundaries(offsets)
        kinds |= {c[0] for c in made.containers}
        assert len(made) == len(offsets)
        ranks = range(len(offsets)) if len(offsets) < 5000 else rng.integers(0, len(offsets), 4000).tolist() + [0, len(offsets) - 1]
        assert all(made.select(r) == offsets[r] for r in ranks)
        with pytest.raises(IndexError):
            made.select(len(offsets))
    assert kinds == {"array", "run", "bitmap"}


def brute_fill(doc_id, text, rate=100, spm=50):
    text = text or ""
    h = hashlib.sha256(f"7:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(h[8 * i:8 * i + 8], 16) for i in range(4)]
    lines = re.findall(r"[^\n]*\n|[^\n]+", text)
    n = len(lines)
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    p, m, s = "".join(lines[:a]), "".join(lines[a:b]), "".join(lines[b:])
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")) or h[2] % 100 >= rate:
        return n, "plain", None, None, text
    if h[3] % 100 < spm:
        return n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


@pytest.mark.parametrize("rate, spm", [(100, 50), (40, 20), (0, 50), (100, 100)])
def test_fill_middle_equals_brute_force(spark, rate, spm):
    texts = [None, "", "\n", "a", "a\n", "\n\na\n\nb", "é\U0001f600\nxç\n<\nP>\n", "x\n<S>\n", "<M", "<P\n>\nS>\n" * 5,
             "\r\n \x85a\r\nb", "line\n" * 50_000, "\n" * 100_000, "y" * 200_000 + "\nz"]
    rows = [(i, t, 1, "k") for i, t in enumerate(texts * 4)] + [(None, "a\nb\nc", 1, "k"), (3, "a\nb", 1, "k"), (3, "a\nb", 1, "k")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, n int, digest string")
    out = fill_middle.transform(docs, rate=rate, spm_rate=spm)
    got = out.withColumn("back", fill_middle.restored(F.col("output"), F.col("form"))).collect()
    key = lambda r: repr(r)
    assert sorted(((r.doc_id, r.n, r.form, r.prefix_chars, r.middle_chars, r.output) for r in got), key=key) == sorted(
        ((d, *brute_fill(d, t, rate, spm)) for d, t, *_ in rows), key=key)
    assert sorted((repr(r.doc_id), r.back) for r in got) == sorted((repr(d), t or "") for d, t, *_ in rows)
    assert fill_middle.transform(docs.limit(0)).count() == 0


# conversations

FOLLOWS = {"s": "u", "u": "a", "a": "u"}


def damaged(rows):
    out = []
    for conv, turn, role, text in rows:
        spaced = [" " if v is None else v for v in (conv, turn, role, text)]
        draw = zlib.crc32(f"{spaced[0]}:{spaced[1]}".encode()) % 20
        role, text = spaced[2:]
        if draw == 0:
            continue
        text = "" if draw == 1 else re.sub("[.!?]", "", text) if draw == 2 else text
        out += [(conv, turn, "user" if draw == 4 else role, text)] * (2 if draw == 3 else 1)
    return out


def faults(rows):
    """('blank' | 'duplicate' | 'truncated' | None) of rows in order."""
    seen, out = set(), []
    for _, _, role, text in rows:
        solid = re.findall(r"[^\x20\x09-\x0D]", text)
        out.append("blank" if not solid else "duplicate" if (role, text) in seen
                   else "truncated" if solid[-1] not in ".!?" else None)
        seen.add((role, text))
    return out


def search(rows, found):
    """Cheapest (cost, edits, output) from left to right."""
    def grown(states):
        todo = list(states.items())
        while todo:
            state, (cost, edits, lines) = todo.pop()
            role = FOLLOWS.get(state, "u")
            best = (cost + 2, edits + "I", lines + [("user:", "assistant:")[role == "a"]])
            if role not in states or best < states[role]:
                states[role] = best
                todo.append((role, best))
        return states
    states = grown({"": (0, "", [])})
    for (_, _, role, text), fault in zip(rows, found):
        made = {}

        def put(state, *entry):
            if state not in made or entry < made[state]:
                made[state] = entry
        for state, (cost, edits, lines) in states.items():
            put(state, cost + 3, edits + "D", lines)
            if fault in ("blank", "duplicate"):
                continue
            more = fault == "truncated"
            new = FOLLOWS.get(state, "u")
            put(new, cost + 2 + more, edits + "R", lines + [("user:", "assistant:")[new == "a"] + text])
            if role[:1] and role[:1] == new or role[:1] == "s" and state == "":
                put(role[0], cost + more, edits + "K", lines + [f"{role}:{text}"])
        states = grown(made)
    return min(states[s] for s in ("", "a") if s in states)


def exhaustive(rows, found):
    """All edits with at most two rows inserted at each place."""
    best = None
    for ops in itertools.product("KRD", repeat=len(rows)):
        if any(o != "D" and f in ("blank", "duplicate") for o, f in zip(ops, found)):
            continue
        for inserted in itertools.product(range(3), repeat=len(rows) + 1):
            cost, edits, roles = 0, "", ""
            for i in range(len(rows) + 1):
                edits, cost, roles = edits + "I" * inserted[i], cost + 2 * inserted[i], roles + "i" * inserted[i]
                if i < len(rows):
                    edits, cost = edits + ops[i], cost + {"K": 0, "R": 2, "D": 3}[ops[i]]
                    cost += found[i] == "truncated" and ops[i] != "D"
                    roles += {"K": rows[i][2][:1] or "x", "R": "i", "D": ""}[ops[i]]
            body = roles[1:] if roles[:1] == "s" else roles
            if roles and (not body or len(body) % 2 or any(r not in ("i", "ua"[k % 2]) for k, r in enumerate(body))):
                continue
            if best is None or (cost, edits) < best:
                best = cost, edits
    return best


def brute_repair(rows):
    by_conv = {r[0]: [] for r in rows}
    for r in damaged(rows):
        by_conv[r[0]].append(r)
    out = {}
    for conv, found in by_conv.items():
        # rows of one turn by role and digest of the text
        found.sort(key=lambda r: (r[1] is not None, r[1] or 0, r[2], digest(r[3])))
        kinds = faults(found)
        turns = [r[1] for r in found if r[1] is not None]
        cost, edits, lines = search(found, kinds)
        out[conv] = (max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0,
                     *(kinds.count(k) for k in ("blank", "duplicate", "truncated")),
                     sum(FOLLOWS.get(a[2][:1]) != b[2][:1] for a, b in zip(found, found[1:])),
                     cost, edits, digest("\n".join(lines)))
    return out


def repaired(spark, rows):
    table = spark.createDataFrame([(*r, 1, "x", 0) for r in rows],
                                  "conv_id bigint, turn bigint, role string, text string, copies int, digest string, span int")
    result = conversation_repair.repair(conversation_repair.damage(table)).collect()
    assert len({r.conv_id for r in result}) == len(result)
    return {r[0]: tuple(r[1:]) for r in result}


def random_rows(rng, conversations, longest):
    words = ["Yes.", "no", "Why?", "", " \t", "word.", "the end !", "x", None, "Go. on"]
    roles = ["user", "assistant", "user", "assistant", "system", "tool", "", None, "usher"]
    rows = []
    for c in range(conversations):
        for t in range(rng.randrange(1, longest)):
            rows.append((c, t if rng.random() < .9 else rng.choice([None, 0, 3]), rng.choice(roles),
                         rng.choice(words) if rng.random() < .5 else f"text {rng.random()}" + rng.choice(["", ".", "!"])))
            if rng.random() < .1:
                rows.append(rows[-1])
    return rows


def test_search_from_left_to_right_equals_all_edits():
    rng = random.Random(5)
    for _ in range(60):
        rows = [(0, i, rng.choice(["user", "assistant", "system", "tool"]), "") for i in range(rng.randrange(1, 5))]
        found = [rng.choice([None, None, "truncated", "blank", "duplicate"]) for _ in rows]
        assert search(rows, found)[:2] == exhaustive(rows, found)


def test_every_cut_of_a_span_gives_the_same_cell():
    rng = random.Random(6)
    for _ in range(200):
        symbols = "".join(rng.choice("suaSUAxXd") for _ in range(rng.randrange(2, 9)))
        chart, other = conversation_repair.Charts(), conversation_repair.Charts()
        whole = chart.parse(symbols)
        for cut in range(1, len(symbols)):
            joined = conversation_repair.closed(conversation_repair.join(other.parse(symbols[:cut]), other.parse(symbols[cut:])))
            assert joined == whole


def test_repair_equals_brute_force(spark):
    rng = random.Random(7)
    rows = random_rows(rng, 120, 12) + [(None, 1, "user", "Hi."), (None, None, "assistant", "Ho."), (None, 2, None, None)]
    rows += [(1000, t, "user" if t % 2 else "assistant", f"{t}.") for t in range(700)]  # over several tasks
    rows += [(1001, t % 3, "user", "same.") for t in range(300)] + [(1002, 5, "assistant", "")] * 40
    rng.shuffle(rows)
    assert repaired(spark, rows) == brute_repair(rows)


def test_repair_of_lost_conversations_and_empty_tables(spark):
    lost = [(c, 0, "user", "Hi.") for c in range(400) if zlib.crc32(f"{c}:0".encode()) % 20 == 0]
    got = repaired(spark, lost)
    assert len(got) == len(lost) > 5 and set(got.values()) == {(0, 0, 0, 0, 0, 0, "", digest(""))}
    assert repaired(spark, []) == {}


def test_repair_of_one_long_conversation_with_long_texts(spark):
    rows = [(1, t, ("user", "assistant")[t % 2], f"{t} " + "long " * 20_000 + ".") for t in range(40)]
    assert repaired(spark, rows) == brute_repair(rows)
