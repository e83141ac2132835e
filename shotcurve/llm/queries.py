"""One query per operator over the whole of its table, and the SQL where there is one."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shotcurve.llm import (
    conversation_repair, exact_dedup, fill_middle, fingerprints, line_dedup, mixing, packing, pieces,
    simhash_dedup, substring_dedup, toxicity, url_filter, warc)
from shotcurve.scratch import shared_folder


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_path() -> str:
    import public_tokenizers
    return public_tokenizers.path("word_bpe_49k.json")


def packing_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document tokenized and packed; ids are reported by their checksum."""
    pieces = packing.pack(table(spark, sf_dir, "documents"), tokenizer_path())
    return pieces.withColumn("ids_crc32", F.crc32("ids")).drop("ids")


def exact_dedup_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document folded into an empty digest index."""
    return exact_dedup.annotate(table(spark, sf_dir, "documents"), exact_dedup.DigestIndex(spark))


def url_filter_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page judged by its url."""
    return url_filter.judge(table(spark, sf_dir, "pages").select("page_id", "url")).drop("url")


def substring_dedup_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every passage of a document that an earlier one has."""
    return substring_dedup.repeated_passages(table(spark, sf_dir, "documents"))


def fingerprints_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of every text and of its edited text."""
    return fingerprints.compare_with_edits(table(spark, sf_dir, "documents"))


def line_dedup_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page without its site's boilerplate lines."""
    kept = line_dedup.drop_boilerplate(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return kept.select("row.page_id", "host", "n_lines", "n_dropped", "text")


def toxicity_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document scored by a model fitted to the labels that are not held out."""
    return toxicity.annotate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def simhash_dedup_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its near-duplicate group."""
    return simhash_dedup.annotate(table(spark, sf_dir, "documents"))


def warc_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page archived and read back."""
    path = shared_folder(spark, "warc")
    warc.write_archive(table(spark, sf_dir, "pages"), path)
    return warc.archive_index(spark, path)


def mixing_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The words every document gives to the mix."""
    return mixing.mix(table(spark, sf_dir, "documents")).drop("source")


def piece_model_path() -> str:
    import public_tokenizers
    return public_tokenizers.path("piece_bpe_32k.model")


def pieces_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document encoded and decoded again; ids and texts are reported by their digests."""
    encoded = pieces.encode(table(spark, sf_dir, "documents"), piece_model_path())
    return pieces.decode(encoded, piece_model_path()).select(
        "doc_id", F.size("ids").cast("bigint").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2("text", 256).alias("decoded_sha256"))


def fill_middle_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document transformed and restored; both are reported by their digests."""
    rows = fill_middle.transform(table(spark, sf_dir, "documents"))
    text = fill_middle.restored(F.col("output"), F.col("form"))
    return rows.select("doc_id", "n", "form", "prefix_chars", "middle_chars",
                       F.sha2("output", 256).alias("output_sha256"), F.sha2(text, 256).alias("restored_sha256"))


def conversation_repair_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation damaged and repaired."""
    return conversation_repair.repair(conversation_repair.damage(table(spark, sf_dir, "conversations")))


LLM_QUERIES = {
    "op1_packing": packing_query,
    "op2_exact_dedup": exact_dedup_query,
    "op3_url_filter": url_filter_query,
    "op4_toxicity": toxicity_query,
    "op5_simhash_dedup": simhash_dedup_query,
    "op6_substring_dedup": substring_dedup_query,
    "op7_fingerprints": fingerprints_query,
    "op8_warc": warc_query,
    "op9_line_dedup": line_dedup_query,
    "op10_mixing": mixing_query,
    "op11_pieces": pieces_query,
    "op12_fill_middle": fill_middle_query,
    "op13_conversation_repair": conversation_repair_query,
}

LLM_ORACLES = {
    "op2_exact_dedup": """
        SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
               doc_id = max(doc_id) OVER same AS kept, sha256(coalesce(text, '')) AS text_sha256
        FROM documents WINDOW same AS (PARTITION BY coalesce(text, ''))""",
    "op3_url_filter": """
        WITH r AS (SELECT page_id, CASE WHEN position('://' IN url) > 0
                          THEN substr(url, position('://' IN url) + 3) ELSE '' END AS rest FROM pages),
        h AS (SELECT page_id, rest, regexp_extract(rest, '^[^/?#]*') AS h FROM r),
        u AS (SELECT page_id, translate(h, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
                     regexp_extract(substr(rest, length(h) + 1), '^[^?#]*') AS path FROM h),
        s AS (SELECT *, '.' || host AS dotted FROM u),
        j AS (SELECT page_id, host, path,
                CASE WHEN dotted LIKE '%.example.org' AND starts_with(path, '/en/1') THEN 'example.org/en/1'
                     WHEN dotted LIKE '%.example.org' AND starts_with(path, '/es/') THEN 'example.org/es/'
                     WHEN dotted LIKE '%.com' AND starts_with(path, '/fr/') THEN 'com/fr/'
                     WHEN dotted LIKE '%.com' AND starts_with(path, '/de/') THEN 'com/de/'
                     WHEN dotted LIKE '%.org' AND starts_with(path, '/') THEN 'org/' END AS rule FROM s)
        SELECT page_id, host, path, rule,
               CASE WHEN rule IN ('org/', 'com/fr/') THEN 'allow'
                    WHEN rule IS NOT NULL THEN 'block'
                    WHEN contains(host || path, '/search/help/') THEN 'allow'
                    WHEN regexp_matches(host || path, '/ads/|/login(\\W|$)|/cart/.*/checkout|/search(\\W|$)')
                    THEN 'block' ELSE 'allow' END AS verdict FROM j""",
    "op9_line_dedup": f"""
        WITH t AS (SELECT page_id,
                nullif(lower(regexp_extract(coalesce(url, ''), '^.*?://([^/?#]*)', 1)), '') AS host,
                list_filter(list_transform(string_split(regexp_replace(regexp_replace(regexp_replace(
                    coalesce(html, ''), '{line_dedup.REMOVED}', '', 'g'), '{line_dedup.BLOCK_TAG}', chr(10), 'g'),
                    '{line_dedup.OTHER_TAG}', '', 'g'), chr(10)), lambda x: trim(x, ' ' || chr(9) || chr(13))), lambda x: x <> '') AS lines FROM pages),
        c AS (SELECT host, line, count(*) AS n FROM
              (SELECT host, unnest(list_distinct(lines)) AS line FROM t WHERE host IS NOT NULL) GROUP BY ALL),
        d AS (SELECT host, list(line) AS dropped FROM c
              JOIN (SELECT host, count(*) AS pages FROM t GROUP BY host) USING (host)
              WHERE n >= {line_dedup.MIN_PAGES} AND n / pages > {line_dedup.RATIO} GROUP BY host),
        k AS (SELECT t.*, list_filter(lines, lambda x: NOT list_contains(coalesce(dropped, []), x)) AS kept
              FROM t LEFT JOIN d USING (host))
        SELECT page_id, host, len(lines) AS n_lines, len(lines) - len(kept) AS n_dropped,
               coalesce(array_to_string(kept, chr(10)), '') AS text FROM k""",
    "op8_warc": """
        WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
        d AS (SELECT page_id, strlen(html) AS payload_bytes, sha1(html) AS hex,
                     max(page_id) OVER (PARTITION BY html) AS response_id FROM p)
        SELECT page_id, payload_bytes, translate(concat({digits}),
                   '0123456789ABCDEFGHIJKLMNOPQRSTUV', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567') AS payload_digest,
               CASE WHEN page_id = response_id THEN 'response' ELSE 'revisit' END AS record_type,
               CASE WHEN page_id <> response_id THEN response_id END AS refers_to
        FROM d""".format(digits=", ".join(
            f"to_base(('0x' || substr(hex, {5 * i + 1}, 5))::BIGINT, 32, 4)" for i in range(8))),
    "op12_fill_middle": r"""
        WITH d AS (SELECT doc_id, coalesce(text, '') AS text,
                          sha256('7:' || coalesce(doc_id::VARCHAR, '')) AS h FROM documents),
        l AS (SELECT *, regexp_extract_all(text, '[^\n]*\n|[^\n]+') AS lines,
                     list_transform([1, 9, 17, 25], lambda i: ('0x' || substr(h, i, 8))::BIGINT) AS draws FROM d),
        c AS (SELECT *, len(lines) AS n,
                     least(draws[1] % (len(lines) + 1), draws[2] % (len(lines) + 1)) AS low,
                     greatest(draws[1] % (len(lines) + 1), draws[2] % (len(lines) + 1)) AS high,
                     CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>')
                               OR draws[3] % 100 >= 100 THEN 'plain'
                          WHEN draws[4] % 100 < 50 THEN 'spm' ELSE 'psm' END AS form FROM l),
        p AS (SELECT doc_id, text, n, form, array_to_string(lines[1:low], '') AS prefix,
                     array_to_string(lines[low + 1:high], '') AS middle,
                     array_to_string(lines[high + 1:], '') AS suffix FROM c)
        SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(prefix) END AS prefix_chars,
               CASE WHEN form <> 'plain' THEN length(middle) END AS middle_chars,
               sha256(CASE form WHEN 'plain' THEN text
                      WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle
                      ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
               sha256(text) AS restored_sha256 FROM p""",
    "op13_conversation_repair": r"""
        WITH RECURSIVE src AS (
            SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
                   string_split(coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' '), '') AS k
            FROM conversations),
        drawn AS (SELECT *, xor(4294967295, list_reduce(
                     [4294967295] || flatten(list_transform(k, lambda c: [ascii(c)::BIGINT, 0, 0, 0, 0, 0, 0, 0])),
                     lambda a, b: xor(xor(a, b) >> 1, (xor(a, b) & 1) * 3988292384))) % 20 AS draw FROM src),
        damaged AS (
            SELECT conv_id, turn, CASE WHEN draw = 4 THEN 'user' ELSE role END AS role,
                   CASE WHEN draw = 1 THEN '' WHEN draw = 2 THEN translate(text, '.!?', '') ELSE text END AS text
            FROM drawn, (VALUES (1), (2)) AS c(copy) WHERE draw <> 0 AND (copy = 1 OR draw = 3)),
        placed AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS pos,
                          regexp_extract(text, '([^\x20\x09-\x0D])[\x20\x09-\x0D]*\z', 1) AS last FROM damaged),
        marked AS (SELECT *, last = '' AS blank,
                          last <> '' AND row_number() OVER (PARTITION BY conv_id, role, text ORDER BY pos) > 1 AS repeated,
                          left(role, 1) AS initial,
                          lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY pos) AS before FROM placed),
        judged AS (SELECT *, NOT blank AND NOT repeated AND last NOT IN ('.', '!', '?') AS cut FROM marked),
        counted AS (
            SELECT conv_id, count(*) AS n, count(*) FILTER (blank) AS blank, count(*) FILTER (repeated) AS duplicate,
                   count(*) FILTER (cut) AS truncated,
                   count(*) FILTER (before IS NOT NULL AND before || initial NOT IN ('su', 'ua', 'au')) AS illegal,
                   coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps FROM judged GROUP BY conv_id),
        edits(edit, p, q, price) AS (VALUES
            ('D', '', '', 3), ('D', 's', 's', 3), ('D', 'u', 'u', 3), ('D', 'a', 'a', 3),
            ('K', '', 's', 0), ('K', '', 'u', 0), ('K', 's', 'u', 0), ('K', 'u', 'a', 0), ('K', 'a', 'u', 0),
            ('R', '', 'u', 2), ('R', 's', 'u', 2), ('R', 'u', 'a', 2), ('R', 'a', 'u', 2)),
        inserts(edit, p, q, price, line) AS (VALUES
            ('', '', '', 0, ''), ('', 's', 's', 0, ''), ('', 'u', 'u', 0, ''), ('', 'a', 'a', 0, ''),
            ('I', '', 'u', 2, 'user:' || chr(10)), ('I', 's', 'u', 2, 'user:' || chr(10)),
            ('I', 'u', 'a', 2, 'assistant:' || chr(10)), ('I', 'a', 'u', 2, 'user:' || chr(10))),
        moves AS (
            SELECT j.conv_id, j.pos, e.p, i.q, e.price + i.price + CASE WHEN cut AND e.edit <> 'D' THEN 1 ELSE 0 END AS price,
                   e.edit || i.edit AS edit,
                   CASE e.edit WHEN 'D' THEN '' WHEN 'K' THEN role || ':' || text || chr(10)
                        ELSE CASE e.q WHEN 'u' THEN 'user' ELSE 'assistant' END || ':' || text || chr(10) END || i.line AS lines
            FROM judged j JOIN edits e ON (e.edit = 'D' OR NOT blank AND NOT repeated) AND (e.edit <> 'K' OR e.q = initial)
            JOIN inserts i ON i.p = e.q),
        walk AS (
            SELECT conv_id, 0::BIGINT AS pos, q AS state, {'c': price::BIGINT, 'e': edit, 'o': line} AS best
            FROM counted, inserts WHERE p = ''
            UNION ALL
            SELECT w.conv_id, m.pos, m.q AS state,
                   min({'c': w.best.c + m.price, 'e': w.best.e || m.edit, 'o': w.best.o || m.lines}) AS best
            FROM walk w JOIN moves m ON m.conv_id IS NOT DISTINCT FROM w.conv_id AND m.pos = w.pos + 1 AND m.p = w.state
            GROUP BY w.conv_id, m.pos, m.q),
        won AS (SELECT c.conv_id, min(w.best) AS best FROM counted c
                JOIN walk w ON w.conv_id IS NOT DISTINCT FROM c.conv_id AND w.pos = c.n AND w.state IN ('', 'a')
                GROUP BY c.conv_id)
        SELECT a.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate,
               coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, coalesce(best.c, 0) AS cost,
               coalesce(best.e, '') AS audit,
               sha256(coalesce(left(best.o, greatest(length(best.o) - 1, 0)), '')) AS repaired_sha256
        FROM (SELECT DISTINCT conv_id FROM conversations) a
        LEFT JOIN counted c ON c.conv_id IS NOT DISTINCT FROM a.conv_id
        LEFT JOIN won w ON w.conv_id IS NOT DISTINCT FROM a.conv_id""",
}
