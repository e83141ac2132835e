import base64
import datetime
import hashlib
import random
import struct
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
import corpus_pipeline
from shotcurve.llm import chunks, fingerprints, mixing, packing, queries, toxicity, url_filter, warc
from shotcurve.scratch import shared_folder
from tests.oracle_check import connect, differences


@pytest.mark.parametrize("name", sorted(queries.LLM_ORACLES))
def test_query_matches_sql(spark, sf_dir, name):
    problems, rows = differences(queries.LLM_QUERIES[name](spark, sf_dir), connect(sf_dir), queries.LLM_ORACLES[name])
    assert not problems and rows > 0


def test_every_operator_is_registered():
    names = set(entry.queries())
    assert all(any(n.startswith(f"op{i}_") for n in names) for i in range(1, 11)) and "pipeline" in names
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "exact dedup", "near dedup", "mixing", "packing"]


# packing

def tokenizer():
    from tokenizers import Tokenizer
    return Tokenizer.from_file(queries.tokenizer_path())


def test_word_ids_equal_the_tokenizers():
    texts = ["", "  It's  a\ttest\r\nHELLO,world!! 123 don't", "ΑΣ ΣΣ. é ́x İstanbul ß 日本語", "a\x1cb\x85c d\xa0e",
             "<|endoftext|>x <|startoftext|>", "‘quoted’—dash… 'S'T 'll", "Ünïcode ñandú œuvre " * 5]
    texts += ["a.b,c (d) e-f x.'s Σ. aΣ.b ´.é x…. y.\u0301z <|endoftext|>a.<|startoftext|>,b <|endof text|>\x0b\x0c."]
    rng = random.Random(8)
    texts += ["".join(rng.choice("abcsΣéX'.,-(<|>1 \n\u0301…") for _ in range(60)) for _ in range(500)]
    ids, library = packing.WordIds(queries.tokenizer_path()), tokenizer()
    for t in texts:
        got = ids.encode(t)
        assert list(struct.unpack(f"<{len(got) // 4}I", got)) == library.encode(t, add_special_tokens=False).ids
    table = chunks.ChunkIds(ids.seams(), ids.encode_all)
    for start, part in chunks.slices(pa.array(texts)):
        bounds, got = table.ids(part)
        for i, t in enumerate(texts[start:start + len(part)]):
            assert got[bounds[i]:bounds[i + 1]].to_pylist() == library.encode(t, add_special_tokens=False).ids


def check_pieces(rows, lengths, size):
    by_doc, by_sequence = {}, {}
    for doc, start, n, seq, offset in rows:
        by_doc.setdefault(doc, []).append((start, n))
        by_sequence.setdefault(seq, []).append((offset, n))
    for pieces, total in ((by_doc, lengths), (by_sequence, None)):
        for key, spans in pieces.items():
            end = 0
            for start, n in sorted(spans):
                assert start == end and n > 0
                end += n
            assert end == lengths[key] if total else end <= size and (end == size or end & (end - 1) == 0)
    assert set(by_doc) == {i for i, n in enumerate(lengths) if n}


def test_plan_covers_every_token_once_without_padding():
    rng = random.Random(1)
    for size in (8, 64, 4096):
        lengths = [rng.choice([1, 2, rng.randint(1, size), rng.randint(1, 4 * size)]) for _ in range(rng.randint(1, 300))]
        check_pieces(packing.plan_window(lengths, size), lengths, size)


def test_plan_balances_cost():
    lengths = [1000] * 8 + [100] * 83
    costs = {}
    for _, _, n, seq, _ in packing.plan_window(lengths):
        costs[seq] = costs.get(seq, 0) + packing.LINEAR * n + packing.QUADRATIC * n * n
    full = sorted(costs[s] for s in range(sum(lengths) // 4096))
    assert full[-1] < 1.3 * full[0]


def test_packing_query_round_trip(spark, sf_dir):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    rows = queries.packing_query(spark, sf_dir).collect()
    encode = tokenizer()
    ids = {d: encode.encode(t or "", add_special_tokens=False).ids + [2] for d, t in docs.items()}
    order = {d: i for i, d in enumerate(ids)}
    check_pieces([(order[r.doc_id], r.start, r.length, r.sequence_id, r.offset) for r in rows],
                 [len(x) for x in ids.values()], 4096)
    for r in rows:
        part = ids[r.doc_id][r.start:r.start + r.length]
        assert r.ids_crc32 == zlib.crc32(struct.pack(f"<{len(part)}I", *part)) and r.doc_tokens == len(ids[r.doc_id])


def test_packing_edge_cases(spark):
    rows = [(1, None, 0, "x"), (1, None, 0, "x"), (2, "", 0, "x"), (None, "a b", 0, "x"), (3, "word " * 9000, 0, "x")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, length int, ids string")
    pieces = packing.pack(docs, queries.tokenizer_path())
    got = pieces.groupBy("doc_id").agg(F.sum("length").alias("n")).collect()
    assert {r.doc_id: r.n for r in got} == {1: 2, 2: 1, None: 3, 3: 9001}
    assert packing.padding(pieces).first()["padding"] == 0
    assert packing.pack(docs.limit(0), queries.tokenizer_path()).count() == 0


# WARC

def test_warc_round_trip_with_revisits(spark):
    rows = [(1, "http://a/1", "same"), (2, "http://a/2", "same"), (3, "http://a/3\r\nX: y", "ä\r\n\r\nWARC/1.1\r\n"), (4, None, None),
            (5, "http://a/5", ""), (None, "http://a/6", "same"), (2, "http://a/2", "same"), (7, "u", "x" * 300_000)]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string").withColumn("payload", F.lit(1))
    path = shared_folder(spark, "test-warc")
    warc.write_archive(pages, path)
    records = warc.read_archive(spark, path).withColumn("bytes", warc.record_bytes()).collect()
    assert len(records) == 8
    by = {r.page_id: r for r in records}
    assert (by[1].record_type, by[1].refers_to, by[2].record_type, by[None].refers_to) == ("revisit", 2, "response", 2)
    assert (by[4].record_type, by[4].refers_to, by[5].record_type) == ("revisit", 5, "response")
    for r in records:
        html = next(x[2] for x in rows if x[0] == r.page_id) or ""
        body = html.encode()
        assert bytes(r.payload) == body and r.payload_bytes == len(body)
        assert r.payload_digest == base64.b32encode(hashlib.sha1(body).digest()).decode()
        head, _, rest = bytes(r.bytes).partition(b"\r\n\r\n")
        length = int(head.decode().split("Content-Length: ")[1].split("\r\n")[0])
        assert rest == (body if r.record_type == "response" else b"") + b"\r\n\r\n"
        assert length == len(rest) - 4 and head.count(b"WARC-Target-URI") == 1
    assert spark.read.parquet(f"{path}/payloads").count() == 4
    for gzip in (True, False):
        files = shared_folder(spark, "test-warc-files")
        warc.export_warc(spark, path, files, file_bytes=1000, gzip=gzip)
        back = sorted((bytes(r.header), bytes(r.payload)) for r in warc.import_warc(spark, f"{files}/file=*/part-*").collect())
        assert back == sorted((bytes(r.header), bytes(r.payload) if r.record_type == "response" else b"") for r in records)
    big = shared_folder(spark, "test-warc")
    warc.write_archive(pages, big, min_bytes=5)
    got = {r.page_id: r.record_type for r in warc.archive_index(spark, big).collect()}
    assert set(got.values()) == {"response"}
    empty = shared_folder(spark, "test-warc")
    warc.write_archive(pages.limit(0), empty)
    assert warc.archive_index(spark, empty).count() == 0


def test_warc_urls_come_back_as_they_were(spark):
    urls = ["http://a/\u2028WARC-Payload-Digest: sha1:X", "http://a/\u0085WARC-Refers-To: <urn:page:7>", "a\u2029b", "a\r\n\r\nb",
            "http://a/%20+%zz", "\x01%2B+ %\x7fé", "x\nWARC-Type: revisit\r", "y\r", "", "é\u2028"]
    rows = [(i, u, f"body {i}") for i, u in enumerate(urls)]
    path = shared_folder(spark, "test-warc")
    date = datetime.datetime(2024, 5, 6, 7, 8, 9, tzinfo=datetime.UTC)
    warc.write_archive(spark.createDataFrame(rows, "page_id bigint, url string, html string"), path, date=date)
    got = warc.read_archive(spark, path).collect()
    assert {r.page_id: r.url for r in got} == dict(enumerate(urls))
    for r in got:
        assert (r.record_type, r.refers_to) == ("response", None)
        head = bytes(r.header)
        assert head.count(b"\r\nWARC-Date: 2024-05-06T07:08:09Z\r\n") == 1
        assert len(head.decode().rstrip("\r\n").splitlines()) == 8 + (b"X-Target" in head)
    files = shared_folder(spark, "test-warc-files")
    warc.export_warc(spark, path, files, file_bytes=700, gzip=False)
    assert all(r.length <= 700 for r in spark.read.format("binaryFile").load(f"{files}/file=*/part-*").collect())
    assert sorted(r.url for r in warc.import_warc(spark, f"{files}/file=*/part-*").collect()) == sorted(urls)


def test_warc_notices_damage(spark):
    path = shared_folder(spark, "test-warc")
    warc.write_archive(spark.createDataFrame([(1, "u", "text")], "page_id bigint, url string, html string"), path)
    damaged = spark.read.parquet(f"{path}/payloads").withColumn("payload", F.lit(b"tixt")).collect()
    schema = spark.read.parquet(f"{path}/payloads").schema
    spark.createDataFrame(damaged, schema).write.mode("overwrite").parquet(f"{path}/payloads")
    with pytest.raises(Exception, match="missing or damaged"):
        warc.archive_index(spark, path).collect()


# URL filters

def test_url_rules(spark):
    urls = ["http://x.example.org/es/1", "http://example.org/en/1234", "http://example.org/en/2", "HTTP://A.ORG/", "http://a.org",
            "http://notorg/", "http://b.COM/fr/x?q=/de/", "http://b.com/de/", "http://b.com/DE/", "http://c.net/ads/1",
            "http://c.net/search", "http://c.net/search/help/a", "http://c.net/research", "no scheme", "", None,
            "http://com/fr/", "http://evilcom/fr/", "http://a.org:80/", "://org/x#y", "http://c.net/cart/1/checkout"]
    pages = spark.createDataFrame([(i, u, "own") for i, u in enumerate(urls)], "page_id bigint, url string, rule string")
    got = {r.page_id: r for r in url_filter.judge(pages).collect()}
    rule = [got[i].rule for i in range(len(urls))]
    assert rule == ["example.org/es/", "example.org/en/1", "org/", "org/", None, None, "com/fr/", "com/de/", None, None, None,
                    None, None, None, None, None, "com/fr/", None, None, "org/", None]
    assert [i for i in got if got[i].verdict == "block"] == [0, 1, 7, 9, 10, 20]
    assert (got[3].host, got[3].path, got[13].host, got[6].path) == ("a.org", "/", "", "/fr/x")
    assert url_filter.judge(pages.limit(0)).count() == 0


def test_url_index_finds_what_all_rules_find(spark, sf_dir):
    rules = [url_filter.PatternRule("block", p) for p in ("/en/*page", "example", "/fr/^", "*net/e*", "blog.")]
    index = url_filter.build_index(rules, {"en": 5, "fr": 2})
    assert set(index) == {"en", "fr", None}
    import re
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")
    got = {r.page_id: r.verdict for r in url_filter.judge(pages, (), rules).collect()}
    for r in pages.collect():
        text = "".join(url_filter.split_url(r.url))
        assert (got[r.page_id] == "block") == any(re.match(x.regex(), text) for x in rules)


# toxicity

def test_composed_transducer_carries_all_marks():
    t = toxicity
    start, table = t.grammar()

    def marks(*symbols):
        state, out = start, []
        for s in symbols:
            state, m = table[state, s]
            out.append(m)
        return out
    assert marks(t.INSULT) == [0]
    assert marks(t.NEGATION, t.OTHER, t.INSULT)[-1] == t.NEGATED
    assert marks(t.NEGATION, t.END, t.INSULT)[-1] == 0
    assert marks(t.TARGET, t.NEGATION, t.INSULT)[-1] == t.NEGATED | t.AIMED
    assert marks(t.SPEECH, t.OTHER, t.INSULT, t.END, t.INSULT)[2::2] == [t.REPORTED, 0]
    assert marks(t.QUOTE, t.INSULT, t.QUOTE, t.INSULT)[1::2] == [t.REPORTED, 0]
    assert marks(t.NEGATION, *[t.OTHER] * t.REACH, t.INSULT)[-1] == 0


def test_clauses_are_matched_with_their_weights():
    lexicon = toxicity.Lexicon({"=fool": 3.0, "idio*": 2.0})
    table = toxicity.grammar()[1]
    assert toxicity.match("nothing here", lexicon, table) is None
    total, plain, aimed, negated, reported, kinds, clauses, threats, words = toxicity.match(
        'You fool! She is not an idiotic one. He said: fool', lexicon, table)
    assert (total, aimed, negated, kinds, clauses, threats) == (8.0, 5.0, 2.0, 2, 3, 0)
    assert toxicity.match("I will kill you. They kill you", lexicon, table)[7] == 1


def test_threats_before_and_after_their_target():
    table = toxicity.grammar()[1]

    def threats(text):  # (target before, target only after)
        found = toxicity.patterns(text, toxicity.Lexicon({}), table)
        return found[7], found[9]
    assert [threats(t) for t in ("I will kill you.", "hurt them", "shoot him and burn them!", "I kill all of those and you")] == [
        (0, 1), (0, 1), (1, 1), (0, 1)]
    assert threats("They kill you") == (1, 0) and threats("I will kill you. They kill you") == (1, 1)
    assert threats("I will not kill you") == (0, 0) and threats("kill. You") == (0, 0) and threats("kill time") == (0, 0)


def test_score_tells_threats_in_normal_word_order():
    table, lexicon = toxicity.grammar()[1], toxicity.Lexicon({})
    texts = [f"{'one two ' * (i % 7)}i will {('kill you', 'kill time')[i % 2]} now." for i in range(200)]
    x = toxicity._design([toxicity.patterns(t, lexicon, table) for t in texts])
    scores = x @ toxicity.logistic(x, np.array([i % 2 == 0 for i in range(200)], float))
    assert all((z > 0) == (i % 2 == 0) for i, z in enumerate(scores))


def test_toxicity_learns_from_rows_not_held_out(spark):
    rng = random.Random(4)
    words = ["".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(300)]
    docs, labels = [], []
    for i in range(1500):
        text = [rng.choice(words) for _ in range(40)]
        toxic = i % 6 == 0
        if toxic:
            for _ in range(3):
                text.insert(rng.randrange(40), rng.choice(["zonkwort", "zonkling", "grubble"]))
        docs.append((i, " ".join(text), "en", 0.5))
        labels.append((i, int(toxic)))
    docs += [(None, None, None, None), (5000, "", "en", 1.0), (5001, "a zonkling and a grubble, zonkwort " + "word " * 50_000, "en", 0.0)]
    labels += [(None, 1), (1, None), (0, 0)]
    docs = spark.createDataFrame(docs, "doc_id bigint, text string, lang string, score double")
    labels = spark.createDataFrame(labels, "doc_id bigint, toxic int")
    got = {r.doc_id: r for r in toxicity.annotate(docs, labels).collect()}
    assert len(got) == 1503
    held = [i for i in range(1500) if got[i].held_out]
    assert held == [i for i in range(1500) if zlib.crc32(str(i).encode()) % 5 == 0]
    assert sum(got[i].predicted == (i % 6 == 0) for i in held) >= 0.97 * len(held)
    assert got[None].held_out and got[None].predicted == 0 and got[5000].predicted == 0 and got[5001].predicted == 1
    kept = toxicity.reject(docs, labels)
    assert kept.columns == docs.columns and 1200 < kept.count() < 1300
    assert toxicity.annotate(docs, labels.limit(0)).agg(F.max("score")).first()[0] == 0.0
    assert toxicity.annotate(docs.limit(0), labels).count() == 0


# fingerprints

def test_fingerprints_against_brute_force(spark):
    rng = random.Random(2)
    texts = [" ".join(rng.choice(["alpha", "béta", "gamma", "delta"]) + str(rng.randint(0, 30)) for _ in range(rng.randint(0, 60)))
             for _ in range(60)] + ["", None, "one", "dup dup", "dup dup", "x" * 5000 + " y", "漢字 テスト 😀"]
    rows = [(7 * i if i % 5 else -i, t) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").withColumn("fp", F.lit("own"))
    hashes = {}

    def terms(t):
        w = t.lower().split()
        return list(zip(w, w[1:])) if len(w) > 1 else [(x, "") for x in w]

    ordered = sorted(((d, t or "") for d, t in rows), reverse=True)
    edited = {}
    for i, (d, t) in enumerate(ordered):
        nxt = ordered[(i + 1) % len(ordered)][1]
        edited[d] = t[:len(t) - len(t) // 2] + nxt[:len(t) // 2]
    pairs = sorted({p for t in [*(t for _, t in ordered), *edited.values()] for p in terms(t)})
    for r in spark.createDataFrame(pairs, "a string, b string").select("a", "b", F.xxhash64("a", "b").alias("h")).collect():
        hashes[r.a, r.b] = r.h & (1 << 64) - 1

    def fp(t):
        found = [(hashes[p], len(p[0]) + len(p[1])) for p in terms(t)]
        total = sum(w for _, w in found)
        return sum(1 << b for b in range(64) if 2 * sum(w for h, w in found if h >> b & 1) > total)
    for size in (5, 1000):
        got = {r.doc_id: r for r in fingerprints.compare_with_edits(docs, size).collect()}
        assert len(got) == len(rows)
        for i, (d, t) in enumerate(ordered):
            r, nxt = got[d], ordered[(i + 1) % len(ordered)][1]
            assert r.n_chars == len(t) and r.edited_sha256 == hashlib.sha256(edited[d].encode()).hexdigest()
            assert (int(r.fingerprint, 16), int(r.edited_fingerprint, 16)) == (fp(t), fp(edited[d]))
            assert r.near_edited == 1 - bin(fp(t) ^ fp(edited[d])).count("1") / 64
            assert r.near_next == 1 - bin(fp(t) ^ fp(nxt)).count("1") / 64


def test_fingerprint_edge_cases(spark):
    one = spark.createDataFrame([(1, "abcd")], "doc_id bigint, text string")
    assert fingerprints.compare_with_edits(one).first()["edited_sha256"] == hashlib.sha256(b"abab").hexdigest()
    odd = spark.createDataFrame([(None, "n"), (None, "n"), (4, "ab"), (4, "ab"), (4, "cd")], "doc_id bigint, text string")
    assert fingerprints.compare_with_edits(odd, 1).count() == 5
    assert fingerprints.compare_with_edits(one.limit(0)).count() == 0


def test_block_tables_find_all_within_the_radius(spark):
    rng = random.Random(8)
    base = [rng.getrandbits(64) for _ in range(40)]
    values = sorted({b ^ sum(1 << i for i in rng.sample(range(64), rng.randint(0, 5))) for b in base for _ in range(4)})
    signed = {v - (1 << 64) if v >> 63 else v: v for v in values}
    fps = spark.createDataFrame([(s,) for s in signed], "fp bigint")
    for radius in (0, 3, 5):
        got = {(r.query_fp, r.fp): r.distance for r in fingerprints.within_radius(
            fps, fps.withColumnRenamed("fp", "query_fp"), radius).collect()}
        want = {(a, b): bin(signed[a] ^ signed[b]).count("1") for a in signed for b in signed}
        assert got == {k: d for k, d in want.items() if d <= radius}


# mixing

def water_levels(sizes, weights, cap):
    want, open_ = {}, dict(zip(sizes, weights))
    rest = float(sum(sizes.values()))
    while open_:
        level = rest / sum(open_.values())
        over = [s for s in open_ if open_[s] * level > cap * sizes[s]]
        if not over:
            return {**want, **{s: w * level for s, w in open_.items()}}
        for s in over:
            want[s] = float(cap * sizes[s])
            rest -= want[s]
            del open_[s]
    return want


def test_mix_reaches_its_targets(spark):
    rng = random.Random(6)
    rows = [(i, rng.choice(["a", "B", "c", "é", None] + ["big"] * 6), "w " * int(rng.paretovariate(1.1))) for i in range(3000)]
    rows += [(9000, "empty", ""), (9001, "empty", None), (9002, "tiny", "w"), (9002, "tiny", "w")]
    docs = spark.createDataFrame(rows, "doc_id bigint, source string, text string").withColumn("rate", F.lit("own"))
    got = mixing.mix(docs).collect()
    assert len(got) == len(rows)
    sizes, taken, target = {}, {}, {}
    for r in got:
        sizes[r.source] = sizes.get(r.source, 0) + r.size
        taken[r.source] = taken.get(r.source, 0) + r.taken
        target[r.source] = r.target
        assert 0 <= r.taken <= 3 * r.size
    order = sorted((s for s in sizes if s is not None), key=lambda s: [ord(c) for c in s]) + [None]
    want = water_levels({s: sizes[s] for s in order}, [(5, 2, 1)[i % 3] for i in range(len(order))], 3)
    for s in order:
        assert abs(target[s] - want[s]) < 1e-6 * max(1, want[s])
        assert abs(taken[s] - want[s]) <= max(0.01 * want[s], 1)
    assert {(r.doc_id, r.taken) for r in mixing.mix(docs.repartition(3)).collect()} == {(r.doc_id, r.taken) for r in got}
    copies = mixing.resample(docs)
    assert copies.columns == docs.columns
    assert copies.count() == sum(r.copies for r in got)
    assert mixing.mix(docs.limit(0)).count() == 0 and mixing.resample(docs.limit(0)).count() == 0


# pipeline

def test_pipeline_equals_its_parts(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    toxic = {r.doc_id for r in toxicity.annotate(docs, labels).filter("predicted = 1").collect()}
    step = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before, step = step, stage(spark, step, sf_dir)
        assert step.columns == docs.columns
        ids = [r.doc_id for r in step.select("doc_id").collect()]
        if name == "toxicity":
            assert set(ids) == {r.doc_id for r in docs.select("doc_id").collect()} - toxic
        if name == "exact dedup":
            best = {}
            for r in before.collect():
                best[r.text] = max(best.get(r.text, r.doc_id), r.doc_id)
            assert sorted(ids) == sorted(best.values())
    packed = corpus_pipeline.run(spark, sf_dir)
    lengths = packed.groupBy("sequence_id").agg(F.sum("length").alias("n"))
    assert lengths.filter("n > 4096").count() == 0 and packed.count() > 0


def test_mixing_rounds_equal_rows_one_by_one(spark):
    rows = [(None if i % 2 else 7, "some equal words here", "a") for i in range(3000)]
    rows += [(i, "w " * (1 + i % 7), "b") for i in range(2000)] + [(i, "x", None) for i in range(500)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string").withColumn("row", F.lit(1))
    got = mixing.mix(docs).collect()
    assert len(got) == len(rows) and all(r.taken <= 3 * r.size for r in got)
    for source in ("a", "b", None):
        own = [r for r in got if r.source == source]
        assert abs(sum(r.taken for r in own) / own[0].target - 1) < 0.02
    again = mixing.mix(docs).collect()
    key = lambda r: (r.doc_id or -1, r.source or "", r.size, r.taken)
    assert sorted(map(key, got)) == sorted(map(key, again))
    copies = mixing.resample(docs)
    assert copies.columns == docs.columns
    assert abs(copies.filter("source = 'a'").count() * 4 / next(r.target for r in got if r.source == "a") - 1) < 0.02


def test_mixing_says_when_it_does_not_settle(spark):
    with pytest.raises(RuntimeError, match="settle"):
        mixing.tilt(spark.sql("SELECT 'k' AS key, 1L AS size, 5L AS n UNION ALL SELECT 'k', 9L, 5L"),
                    spark.sql("SELECT 'k' AS key, 60D AS target, 50L AS source_size, 5D AS mean"), max_steps=1)


def test_url_filter_replaces_columns_of_its_names(spark):
    pages = spark.createDataFrame([(1, "http://a.org/", "x", "y"), (2, "http://a.org/" + "z/" * 200_000, "x", "y")],
                                  "page_id bigint, url string, Rule string, HOST string")
    got = url_filter.judge(pages)
    assert sorted(got.columns) == ["host", "page_id", "path", "rule", "url", "verdict"]
    assert [r.rule for r in got.collect()] == ["org/", "org/"]
