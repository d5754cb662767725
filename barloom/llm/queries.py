"""One query per operator over its whole table, and the pipeline; oracle texts where SQL says the same."""

from __future__ import annotations

import logging

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barloom.llm import (
    conversations, decontaminate, licenses, line_dedup, mixing, periodic, pii, quality_rules, secrets, simhash, substrings, token_files, url_reputation,
)
from barloom.llm.common import stage

log = logging.getLogger(__name__)

# The rules that the url query applies.
RULES = {"net/": "block", "example.net/en/": "allow", "example.com/de/": "block", "org/fr/": "allow"}
MIN_DOCS = 10
BATCHES = 4


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op1_pii(spark: SparkSession, folder: str) -> DataFrame:
    return pii.digest(pii.find(table(spark, folder, "documents")))


def op2_simhash(spark: SparkSession, folder: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, folder, "documents"))


def op3_decontaminate(spark: SparkSession, folder: str) -> DataFrame:
    return decontaminate.digest(decontaminate.find(table(spark, folder, "documents"), table(spark, folder, "benchmark")))


def op4_quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    """Statistics once for every document; the list is learned from those of the labelled ones."""
    docs, labels = table(spark, folder, "documents"), table(spark, folder, "labels")
    stats = stage(quality_rules.statistics(docs.select("doc_id", "text")).drop("text"), "statistics")
    rules = quality_rules.learn(stats.join(labels.select("doc_id", "quality"), "doc_id").withColumn("bad", 1 - F.col("quality")), "bad", F.col("doc_id"))
    failed = quality_rules.base_failed()
    return stats.select("doc_id", *quality_rules.BASE, failed.alias("base_failed"), (~failed & rules.good()).alias("kept"))


def op5_secrets(spark: SparkSession, folder: str) -> DataFrame:
    return secrets.digest(secrets.scan(table(spark, folder, "documents")))


def op6_token_files(spark: SparkSession, folder: str) -> DataFrame:
    return token_files.round_trip(table(spark, folder, "documents"), tokenizer_path())


def op7_mixing(spark: SparkSession, folder: str) -> DataFrame:
    out = mixing.mix(table(spark, folder, "documents"))
    return out.select("doc_id", "size", "source_size", F.round("target", 3).alias("target"), "taken")


def op8_licenses(spark: SparkSession, folder: str) -> DataFrame:
    """Documents as files of trees: a repository per source and language, with up to two levels of directories below, a file per document at one of three depths."""
    docs = table(spark, folder, "documents")
    deep = F.pmod(F.xxhash64(F.lit("depth"), "doc_id"), F.lit(3))
    levels = [F.coalesce("source", F.lit("none")), F.coalesce("lang", F.lit("none")), F.when(deep >= 1, F.expr("doc_id div 256").cast("string")), F.when(deep >= 2, F.expr("doc_id div 32").cast("string"))]
    path = F.concat_ws("/", *levels, F.col("doc_id").cast("string"))
    found = stage(licenses.own_licenses(docs.withColumn("path", path), ["doc_id", "path"]), "licenses")
    out = licenses.inherit(found)
    return out.select(F.col("doc_id").cast("long").alias("doc_id"), "path", "license", F.round("cosine", 6).alias("cosine"), "is_license_file", "inherited_license", "inherited_from")


def op9_line_dedup(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    runs = line_dedup.LineRuns(spark)
    for batch in line_dedup.batches(docs, BATCHES):
        runs.add(batch)
    out = runs.drop_frequent(docs, MIN_DOCS)
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("kept"), 256).alias("kept_sha256"))


def op10_url_reputation(spark: SparkSession, folder: str) -> DataFrame:
    """A page's outcome is the mean label of the labelled documents whose whole text is that of its article. Pages without a document are counted."""
    pages, labels = table(spark, folder, "pages"), table(spark, folder, "labels")
    bad = labels.select("doc_id", F.when((F.col("quality") == 0) | (F.col("toxic") == 1), 1.0).otherwise(0.0).alias("bad"))
    linked = stage(url_reputation.linked_pages(pages, table(spark, folder, "documents"), bad), "linked")
    log.info("op10_url_reputation: %d of %d pages have no document", linked.filter("not linked").count(), linked.count())
    outcomes = linked.filter("bad is not null").select("host", "bad")
    return url_reputation.judge(pages, RULES, outcomes)


def op11_substring_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return substrings.digest(substrings.remove_repeats(table(spark, folder, "documents")))


def op12_conversation_repair(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "conversations")
    return conversations.repair(conversations.damaged(rows), rows)


def op13_periodic_runs(spark: SparkSession, folder: str) -> DataFrame:
    return periodic.digest(periodic.find_runs(periodic.planted(table(spark, folder, "documents"))))


def pipeline(spark: SparkSession, folder: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, folder)


QUERIES = {f.__name__: f for f in (
    op1_pii, op2_simhash, op3_decontaminate, op4_quality_rules, op5_secrets, op6_token_files, op7_mixing, op8_licenses, op9_line_dedup,
    op10_url_reputation, op11_substring_dedup, op12_conversation_repair, op13_periodic_runs, pipeline,
)}

_AZ = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"
_WS = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"

ORACLES = {
    "op7_mixing": r"""
        WITH d AS (
            SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
                md5('7:' || coalesce(doc_id::VARCHAR, 'null') || ':' || md5(coalesce(text, ''))) AS k FROM documents),
        s AS (
            SELECT source, sum(size)::BIGINT AS source_size, [5.0, 2.0, 1.0][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT]::DOUBLE AS w
            FROM d GROUP BY source),
        c AS (  -- sources that stop at their cap come first: those with the smallest cap for their weight
            SELECT *, 2.0 * source_size / w AS r, coalesce(sum(2.0 * source_size) OVER o, 0) AS held, sum(w) OVER () - coalesce(sum(w) OVER o, 0) AS free
            FROM s WINDOW o AS (ORDER BY 2.0 * source_size / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
        -- the first source, in that order, which the level does not reach; none: every source stops at its cap
        l AS (SELECT arg_min(x, (r, source IS NULL, source)) AS level FROM (SELECT ((SELECT sum(size) * 1.5 FROM d) - held) / free AS x, r, source FROM c) WHERE x <= r),
        t AS (SELECT source, source_size, least(2.0 * source_size, coalesce(level * w, 2.0 * source_size)) AS target FROM s, l),
        x AS (
            SELECT doc_id, size, source_size, target, floor(target)::BIGINT AS budget,
                sum(size) OVER (PARTITION BY d.source ORDER BY k ROWS UNBOUNDED PRECEDING)::BIGINT - size AS before
            FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
        y AS (SELECT *, CASE WHEN source_size > 0 THEN budget // source_size ELSE 0 END AS epochs FROM x)
        SELECT doc_id, size, source_size, round(target, 3) AS target,
            (epochs * size + greatest(0, least(size, budget - epochs * source_size - before)))::BIGINT AS taken FROM y
    """,
    "op9_line_dedup": f"""
        WITH l AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, unnest(range(len(string_split(coalesce(text, ''), chr(10))))) AS pos FROM documents),
        k AS (SELECT *, trim(translate(line, {_AZ}), {_WS}) AS key FROM l),
        f AS (SELECT key FROM k WHERE key <> '' GROUP BY key HAVING count(DISTINCT doc_id) >= {MIN_DOCS}),
        m AS (SELECT k.*, f.key IS NOT NULL AS gone FROM k LEFT JOIN f ON k.key = f.key)
        SELECT doc_id, count(*)::BIGINT AS n_lines, (count(*) FILTER (gone))::BIGINT AS n_dropped,
            sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256 FROM m GROUP BY doc_id
    """,
    "op11_substring_dedup": r"""
        WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
        s AS (SELECT doc_id, w, unnest(range(len(w) - 49)) AS i FROM d WHERE len(w) >= 50),
        p AS (SELECT doc_id, i, md5(array_to_string(w[i + 1:i + 50], ' ')) AS k FROM s),
        m AS (SELECT k, min(doc_id) AS least FROM p GROUP BY k),
        g AS (SELECT DISTINCT doc_id, i + j AS pos FROM p JOIN m USING (k), (SELECT unnest(range(50)) AS j) WHERE least < doc_id),
        x AS (SELECT doc_id, unnest(w) AS word, unnest(range(len(w))) AS pos FROM d),
        k AS (
            SELECT x.doc_id, count(g.pos)::BIGINT AS n_removed, sha256(coalesce(string_agg(word, ' ' ORDER BY x.pos) FILTER (g.pos IS NULL), '')) AS sha
            FROM x LEFT JOIN g ON g.doc_id = x.doc_id AND g.pos = x.pos GROUP BY x.doc_id)
        SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(sha, sha256('')) AS kept_sha256 FROM d LEFT JOIN k ON k.doc_id = d.doc_id
    """,
    "op12_conversation_repair": r"""
        WITH RECURSIVE bits AS (SELECT range::UBIGINT AS b, 0 AS k, range::UBIGINT AS c FROM range(256) UNION ALL SELECT b, k + 1, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384::UBIGINT) ELSE c >> 1 END FROM bits WHERE k < 8),
        crc AS (SELECT list(c ORDER BY b) AS t FROM bits WHERE k = 8),
        raw AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS name FROM conversations),
        coded AS (SELECT raw.* EXCLUDE (name), xor(list_reduce(list_prepend(4294967295::UBIGINT, list_transform(string_split(name, ''), lambda x: ord(x)::UBIGINT)), lambda c, b: xor(t[(xor(c, b) & 255)::BIGINT + 1], c >> 8)), 4294967295::UBIGINT) % 20 AS code FROM raw, crc),
        hurt AS (
            SELECT conv_id, turn, CASE WHEN code = 4 THEN 'user' ELSE role END AS role, CASE code WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text
            FROM coded, (SELECT unnest([0, 1]) AS copy) WHERE code <> 0 AND (copy = 0 OR code = 3)),
        placed AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS i FROM hurt),
        known AS (SELECT *, trim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS body, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 AS again, lag(role[1]) OVER (PARTITION BY conv_id ORDER BY i) AS before FROM placed),
        faults AS (
            SELECT conv_id, turn, role, text, i, role[1] AS own, CASE WHEN body = '' THEN 'b' WHEN again THEN 'd' WHEN body[-1] NOT IN ('.', '!', '?') THEN 't' ELSE '' END AS fault,
                before IS NOT NULL AND before || role[1] NOT IN ('su', 'ua', 'au') AS illegal FROM known),
        marks AS MATERIALIZED (SELECT * FROM faults),
        moves(s, k, z) AS (VALUES ('', 0, ''), ('', 1, 'u'), ('', 2, 'a'), ('', 3, 'u'), ('s', 0, 's'), ('s', 1, 'u'), ('s', 2, 'a'), ('s', 3, 'u'), ('u', 0, 'u'), ('u', 1, 'a'), ('u', 2, 'u'), ('u', 3, 'a'), ('a', 0, 'a'), ('a', 1, 'u'), ('a', 2, 'a'), ('a', 3, 'u')),
        edits(z, next) AS (VALUES ('', 'u'), ('s', 'u'), ('u', 'a'), ('a', 'u')),
        best AS (
            SELECT DISTINCT conv_id, 0::BIGINT AS i, '' AS s, 0 AS cost, '' AS audit FROM marks
            UNION ALL
            SELECT conv_id, i, s, cost, audit FROM (
                SELECT m.conv_id, m.i, e.s, b.cost + 5 * v.k + e.cost AS cost, b.audit || repeat('I', v.k) || e.letter AS audit
                FROM best b JOIN moves v ON v.s = b.s JOIN marks m ON m.conv_id IS NOT DISTINCT FROM b.conv_id AND m.i = b.i + 1 JOIN edits n ON n.z = v.z,
                    LATERAL (
                        SELECT v.z AS s, 2 AS cost, 'D' AS letter
                        UNION ALL SELECT n.next, 1 + 5 * (m.fault = 't')::INT, 'R' WHERE m.fault NOT IN ('b', 'd')
                        UNION ALL SELECT m.own, 5 * (m.fault = 't')::INT, 'K' WHERE m.fault NOT IN ('b', 'd') AND (m.own = n.next OR (m.own = 's' AND v.z = ''))) e)
            QUALIFY row_number() OVER (PARTITION BY conv_id, i, s ORDER BY cost, audit) = 1),
        ends AS (
            SELECT b.conv_id, b.cost + 5 * v.k AS cost, b.audit || repeat('I', v.k) AS audit FROM best b JOIN moves v ON v.s = b.s JOIN (SELECT conv_id, max(i) AS n FROM marks GROUP BY 1) l ON l.conv_id IS NOT DISTINCT FROM b.conv_id AND l.n = b.i
            WHERE v.z IN ('', 'a') QUALIFY row_number() OVER (PARTITION BY b.conv_id ORDER BY b.cost + 5 * v.k, b.audit || repeat('I', v.k)) = 1),
        letters AS (SELECT conv_id, unnest(string_split(audit, '')) AS letter, unnest(range(1, len(audit) + 1)) AS p FROM ends WHERE audit <> ''),
        steps AS (SELECT *, count(*) FILTER (letter <> 'I') OVER w AS i, count(*) FILTER (letter <> 'D') OVER w AS j FROM letters WINDOW w AS (PARTITION BY conv_id ORDER BY p)),
        lines AS (
            SELECT t.conv_id, t.p, t.letter, t.j, m.role, m.text, bool_or(t.letter = 'K' AND t.j = 1 AND m.own = 's') OVER (PARTITION BY t.conv_id) AS led
            FROM steps t LEFT JOIN marks m ON m.conv_id IS NOT DISTINCT FROM t.conv_id AND m.i = t.i AND t.letter <> 'I'),
        repaired AS (
            SELECT conv_id, string_agg(CASE WHEN letter = 'K' THEN role ELSE CASE WHEN (j - led::INT) % 2 = 1 THEN 'user' ELSE 'assistant' END END || ':' || CASE WHEN letter = 'I' THEN '' ELSE text END, chr(10) ORDER BY p) AS text
            FROM lines WHERE letter <> 'D' GROUP BY conv_id),
        counts AS (
            SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0)::BIGINT AS gaps, count(*) FILTER (fault = 'b') AS blank, count(*) FILTER (fault = 'd') AS duplicate,
                count(*) FILTER (fault = 't') AS truncated, count(*) FILTER (illegal) AS illegal FROM marks GROUP BY 1)
        SELECT o.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate, coalesce(truncated, 0)::BIGINT AS truncated, coalesce(illegal, 0)::BIGINT AS illegal,
            coalesce(cost, 0)::BIGINT AS cost, coalesce(audit, '') AS audit, sha256(coalesce(r.text, '')) AS repaired_sha256
        FROM (SELECT DISTINCT conv_id FROM conversations) o LEFT JOIN counts c ON c.conv_id IS NOT DISTINCT FROM o.conv_id LEFT JOIN ends e ON e.conv_id IS NOT DISTINCT FROM o.conv_id LEFT JOIN repaired r ON r.conv_id IS NOT DISTINCT FROM o.conv_id
    """,
}
