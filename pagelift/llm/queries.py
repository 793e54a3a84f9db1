"""The queries of this subpackage, and SQL for those that SQL can express."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import audit, chat, decontam, exact_dedup, importance, jaccard, langid, licenses, mixing, packing, quality, toxicity, warc
from .runtime import spread


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(table(spark, sf_dir, "documents"))


def _remainder(n: int) -> Column:
    return F.crc32(F.col("doc_id").cast("string")) % n


def op1_decontam(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.contaminated(documents(spark, sf_dir), table(spark, sf_dir, "benchmark"))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    model = toxicity.train(docs, table(spark, sf_dir, "labels").filter(_remainder(3) != 1), "toxic")
    out = toxicity.score(docs, model)
    return out.select("doc_id", (_remainder(3) == 1).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(documents(spark, sf_dir))


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = table(spark, sf_dir, "labels").filter(_remainder(5) != 0)
    out = quality.score(documents(spark, sf_dir), labels, "quality")
    return out.select("doc_id", (_remainder(5) == 0).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op5_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    model = langid.train(docs.filter(_remainder(4) != 2))
    out = langid.identify(docs, model)
    return out.select("doc_id", (_remainder(4) == 2).alias("held_out"), "lang_pred", "score")


def op6_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.format_conversations(table(spark, sf_dir, "conversations"))


def op7_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan_known(documents(spark, sf_dir))


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(documents(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json"))


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.page_records(table(spark, sf_dir, "pages"))


def op10_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.near_duplicates(documents(spark, sf_dir))


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.audit(audit.failures(documents(spark, sf_dir), table(spark, sf_dir, "labels")))


def op12_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return importance.resample(documents(spark, sf_dir), table(spark, sf_dir, "benchmark"))


def op13_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(documents(spark, sf_dir)).select("doc_id", "size", "source_size", "target", "taken")


QUERIES = {f.__name__: f for f in (op1_decontam, op2_toxicity, op3_exact_dedup, op4_quality, op5_langid, op6_chat, op7_licenses, op8_packing, op9_warc, op10_jaccard, op11_filter_audit, op12_importance, op13_mixing)}

_LOW = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"



def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _canonical(text: str) -> str:
    out = f"lower({text})"
    out = f"regexp_replace(replace({out}, chr(10), chr(10) || chr(10)), {_quoted(licenses.COPYRIGHT)}, chr(10), 'g')"
    # Two spaces stand between words here, so that each of two neighbours has its own.
    out = f"' ' || replace(trim(regexp_replace({out}, {_quoted(licenses.BETWEEN)}, ' ', 'g')), ' ', '  ') || ' '"
    for given, kept in sorted(licenses.SPELLINGS, key=lambda pair: " " in pair[0]):
        out = f"replace({out}, ' {given.replace(' ', '  ')} ', ' {kept.replace(' ', '  ')} ')"
    return f"sha256(trim(replace({out}, '  ', ' ')))"


_LICENSES = f"""
    WITH known AS (SELECT digest, min(id) AS id FROM (SELECT id, {_canonical("t")} AS digest
                   FROM (VALUES {", ".join(f"({_quoted(a)}, {_quoted(b)})" for a, b in licenses.KNOWN)}) AS v(id, t)) GROUP BY digest),
    lines AS (SELECT doc_id, {_canonical("line")} AS digest FROM
              (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line FROM documents)
              WHERE regexp_matches(line, {_quoted(licenses.MENTIONS)})),
    notices AS (SELECT doc_id, string_agg(DISTINCT id, ',' ORDER BY id) AS ids FROM lines JOIN known USING (digest) GROUP BY doc_id),
    texts AS (SELECT doc_id, {_canonical("coalesce(text, '')")} AS digest FROM documents)
    SELECT doc_id, digest AS text_digest, known.id AS license_id, coalesce(notices.ids, '') AS notice_ids
    FROM texts LEFT JOIN known USING (digest) LEFT JOIN notices USING (doc_id)"""


_CONTAINED = """
    WITH docs AS (SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9\\x{80}-\\x{10FFFF}]+') AS w FROM documents),
    items AS (SELECT item_id, least(5, len(w)) AS size, w FROM (SELECT item_id, regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9\\x{80}-\\x{10FFFF}]+') AS w FROM benchmark)),
    wanted AS (SELECT DISTINCT item_id, size, unnest(list_transform(range(1, len(w) - size + 2), lambda i: array_to_string(w[i : i + size - 1], ' '))) AS g FROM items WHERE len(w) > 0),
    sizes AS (SELECT item_id, count(*) AS n FROM wanted GROUP BY item_id),
    had AS (SELECT DISTINCT doc_id, size, unnest(list_transform(range(1, len(w) - size + 2), lambda i: array_to_string(w[i : i + size - 1], ' '))) AS g
            FROM docs, (SELECT DISTINCT size FROM wanted) WHERE len(w) >= size)
    SELECT doc_id, item_id, n AS item_shingles, count(*) AS shared, count(*) / n AS containment
    FROM had JOIN wanted USING (size, g) JOIN sizes USING (item_id) GROUP BY doc_id, item_id, n HAVING count(*) >= 0.8 * n"""

_NEAR = f"""
    WITH RECURSIVE docs AS (SELECT doc_id, list_filter(regexp_split_to_array({_LOW}, '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w FROM documents),
    sets AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
             ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i : i + 4], ' ')) END) AS g FROM docs),
    sizes AS (SELECT doc_id, count(*) AS n FROM sets GROUP BY doc_id),
    shared AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM sets a JOIN sets b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
    links AS (SELECT a, b FROM shared JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b WHERE 100 * k >= 80 * (x.n + y.n - k)),
    ways AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
    reached(doc_id, id) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.doc_id, w.b FROM reached r JOIN ways w ON w.a = r.id)
    SELECT d.doc_id, coalesce(s.n, 0) AS n_shingles, c.id AS component_id
    FROM docs d LEFT JOIN sizes s USING (doc_id) JOIN (SELECT doc_id, min(id) AS id FROM reached GROUP BY doc_id) c USING (doc_id)"""

_WORD = r"[^\x20\x09-\x0D]+"

_AUDIT = f"""
    WITH d AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '{_WORD}') AS w FROM documents),
    flags AS (SELECT doc_id, part, [len(w) < 200, 100 * len(list_distinct(w)) < 50 * len(w), 100 * length(regexp_replace(t, '[^A-Z]+', '', 'g')) > 3 * length(t),
                     regexp_matches(t, '[#$%&*|]'), coalesce(doc_id > min(doc_id) OVER (PARTITION BY t), false)] AS fails FROM d),
    own AS (SELECT doc_id, max(CAST(quality = 1 AS INTEGER)) AS good, max(CAST(toxic = 1 AS INTEGER)) AS toxic FROM labels GROUP BY doc_id),
    patterns AS (SELECT part, fails, count(*) AS n, coalesce(sum(good), 0) AS good, coalesce(sum(toxic), 0) AS toxic FROM flags LEFT JOIN own USING (doc_id) GROUP BY part, fails),
    letters AS (SELECT unnest(range(1, 6)) AS f),
    orders AS (SELECT [a.f, b.f, c.f, d.f, e.f] AS o FROM letters a JOIN letters b ON b.f <> a.f JOIN letters c ON c.f NOT IN (a.f, b.f)
               JOIN letters d ON d.f NOT IN (a.f, b.f, c.f) JOIN letters e ON e.f NOT IN (a.f, b.f, c.f, d.f)),
    steps AS (SELECT o, array_to_string(list_transform(o, lambda x: chr(CAST(64 + x AS INTEGER))), '') AS filter_order, k AS step, o[k] AS f FROM orders, (SELECT unnest(range(1, 6)) AS k)),
    counted AS (SELECT part, filter_order, step, f, sum(CASE WHEN list_bool_or(list_transform(o[:step], lambda x: fails[x])) THEN 0 ELSE n END) AS kept,
                sum(CASE WHEN fails[f] AND NOT coalesce(list_bool_or(list_transform(o[:step - 1], lambda x: fails[x])), false) THEN n ELSE 0 END) AS removed,
                sum(CASE WHEN fails[f] THEN n ELSE 0 END) AS failing, sum(CASE WHEN fails[f] AND len(list_filter(fails, lambda x: x)) = 1 THEN n ELSE 0 END) AS unique_fails,
                sum(CASE WHEN fails[f] AND NOT coalesce(list_bool_or(list_transform(o[:step - 1], lambda x: fails[x])), false) THEN good ELSE 0 END) AS good_lost,
                sum(CASE WHEN fails[f] AND NOT coalesce(list_bool_or(list_transform(o[:step - 1], lambda x: fails[x])), false) THEN toxic ELSE 0 END) AS toxic_lost
                FROM patterns, steps GROUP BY part, filter_order, step, f)
    SELECT part, filter_order, CAST(step AS INTEGER) AS step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed, CAST(failing - removed AS BIGINT) AS redundant,
           CAST(unique_fails AS BIGINT) AS unique_fails, CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost,
           CAST(sum(removed) OVER (PARTITION BY part, f) AS BIGINT) AS shapley FROM counted"""

#: crc32 by a table of a byte's values, over the bytes of each different word.
_CRC = "[" + ", ".join(str(int(x)) for x in importance._CRC) + "]"
_GRAM = "[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"
_IMPORTANCE = f"""
    WITH crc AS (SELECT {_CRC} AS c),
    words AS (SELECT doc_id, true AS ours, unnest(regexp_extract_all({_LOW}, '{_GRAM}')) AS w FROM documents
              UNION ALL SELECT item_id, false, unnest(regexp_extract_all({_LOW}, '{_GRAM}')) FROM benchmark),
    bytes AS (SELECT w, list_transform(regexp_extract_all(hex(encode(w)), '..'), lambda x: CAST('0x' || x AS BIGINT)) AS b FROM (SELECT DISTINCT w FROM words)),
    hashed AS (SELECT w, xor(list_reduce(b, lambda s, x: xor(c[(xor(s, x) & 255) + 1], s >> 8), CAST(4294967295 AS BIGINT)), 4294967295) % 10000 AS bucket FROM bytes, crc),
    counts AS (SELECT bucket, count(*) FILTER (WHERE ours) AS s, count(*) FILTER (WHERE NOT ours) AS t FROM words JOIN hashed USING (w) GROUP BY bucket),
    sums AS (SELECT sum(s) AS all_s, sum(t) AS all_t FROM counts),
    gains AS (SELECT bucket, floor(1000 * ln(CAST(t + 1 AS DOUBLE) * (all_s + 10000) / (CAST(s + 1 AS DOUBLE) * (all_t + 10000)))) AS gain FROM counts, sums),
    weights AS (SELECT doc_id, count(*) AS n, sum(gain) AS weight FROM words JOIN hashed USING (w) JOIN gains USING (bucket) WHERE ours GROUP BY doc_id),
    scored AS (SELECT doc_id, coalesce(n, 0) AS n_features, CAST(coalesce(weight, 0) AS BIGINT) AS weight,
               CAST(coalesce(weight, 0) + floor(-1000 * ln(-ln((CAST('0x' || substr(sha256('2024:' || doc_id), 1, 8) AS BIGINT) + 0.5) / 4294967296::DOUBLE))) AS BIGINT) AS score
               FROM documents LEFT JOIN weights USING (doc_id)),
    ranks AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS r, count(*) OVER () AS n FROM scored WHERE n_features >= 20)
    SELECT doc_id, n_features, weight, score, CASE WHEN r <= 10 * n // 100 THEN r END AS rank FROM scored LEFT JOIN ranks USING (doc_id)"""

#: A source is full if the water that fills it needs no more words than there are; the last document of a source is taken if that
#: brings it nearer to its target.
_MIX = f"""
    WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '{_WORD}')) AS size,
               CAST('0x' || substr(md5('2024:' || coalesce(CAST(doc_id AS VARCHAR), '') || ':' || md5(coalesce(text, ''))), 1, 15) AS BIGINT) AS place FROM documents),
    sizes AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
    weighed AS (SELECT *, [5, 2, 1][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] AS w, sum(source_size) OVER () AS total FROM sizes),
    poured AS (SELECT *, sum(3 * source_size) OVER upto AS fulls, sum(w) OVER upto AS ws, sum(w) OVER () AS all_w FROM weighed
               WINDOW upto AS (ORDER BY 3 * source_size / w, source NULLS LAST ROWS UNBOUNDED PRECEDING)),
    levels AS (SELECT *, fulls * w + 3 * source_size * (all_w - ws) <= total * w AS is_full FROM poured),
    aims AS (SELECT source, source_size, CASE WHEN is_full THEN CAST(3 * source_size AS DOUBLE)
                    ELSE CAST(w * (total - coalesce(sum(3 * source_size) FILTER (WHERE is_full) OVER (), 0)) AS DOUBLE) / CAST(sum(w) FILTER (WHERE NOT is_full) OVER () AS DOUBLE) END AS target FROM levels),
    lefts AS (SELECT *, CASE WHEN source_size > 0 THEN CAST(floor(target / source_size) AS BIGINT) ELSE 0 END AS whole FROM aims),
    units AS (SELECT source, place, sum(size) AS u FROM d GROUP BY source, place),
    upto AS (SELECT source, place, u, sum(u) OVER (PARTITION BY source ORDER BY place ROWS UNBOUNDED PRECEDING) AS run FROM units),
    more AS (SELECT x.source, x.place, CAST(run - u AS DOUBLE) < target - whole * source_size AND run - (target - whole * source_size) < (target - whole * source_size) - (run - u)
             OR run <= target - whole * source_size AS again FROM upto x JOIN lefts l ON x.source IS NOT DISTINCT FROM l.source)
    SELECT d.doc_id, d.size, l.source_size, l.target, CAST(d.size * (l.whole + CASE WHEN m.again THEN 1 ELSE 0 END) AS BIGINT) AS taken
    FROM d JOIN lefts l ON d.source IS NOT DISTINCT FROM l.source JOIN more m ON d.source IS NOT DISTINCT FROM m.source AND d.place = m.place"""

ORACLE_SQL = {
    "op11_filter_audit": _AUDIT,
    "op12_importance": _IMPORTANCE,
    "op13_mixing": _MIX,
    "op1_decontam": _CONTAINED,
    "op10_jaccard": _NEAR,
    "op7_licenses": _LICENSES,
    "op3_exact_dedup": f"""
        SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
               doc_id = max(doc_id) OVER same AS kept, sha256(low) AS text_sha256
        FROM (SELECT doc_id, {_LOW} AS low FROM documents)
        WINDOW same AS (PARTITION BY low)""",
    "op9_warc": """
        SELECT page_id, payload_bytes, payload_digest,
               CASE WHEN payload_bytes >= 100 AND page_id > first THEN 'revisit' ELSE 'response' END AS record_type,
               CASE WHEN payload_bytes >= 100 AND page_id > first THEN first END AS refers_to
        FROM (SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest,
                     min(page_id) OVER (PARTITION BY coalesce(html, '')) AS first FROM pages)""",
}
