"""One query per operator over its whole table, and the SQL of those that SQL can express."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from echolens.llm import (bpe, chat, decontaminate, fill_middle, license_scan, line_dedup, ngram_join, quality_rules,
                          sharding, suffix_dedup, token_counts, warc, whitening)
from echolens.llm.tables import read

N_SHARDS = 24


def tokenizer_file(name: str) -> str:
    import public_tokenizers
    return public_tokenizers.path(name)


def op1_chat_format(spark: SparkSession, folder: str) -> DataFrame:
    return chat.link_calls(*chat.calls_of(read(spark, folder, "conversations")), chat.ANSWER)


def op2_bpe_round_trip(spark: SparkSession, folder: str) -> DataFrame:
    return bpe.round_trip(read(spark, folder, "documents"), tokenizer_file("byte_bpe_50k.json"))


def op3_sharding(spark: SparkSession, folder: str) -> DataFrame:
    return (sharding.shards(read(spark, folder, "documents"), N_SHARDS)
            .withColumns({"law": F.lit("bytes"), "grown_shard": F.lit(None).cast("int")})
            .select("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard"))


def op4_warc(spark: SparkSession, folder: str) -> DataFrame:
    return warc.archive_and_read(read(spark, folder, "pages")).drop("payload")


def op5_ngram_jaccard_join(spark: SparkSession, folder: str) -> DataFrame:
    return ngram_join.classes(read(spark, folder, "documents"), n=3, num=90, den=100)


def op6_decontaminate(spark: SparkSession, folder: str) -> DataFrame:
    return decontaminate.contaminated(read(spark, folder, "documents"), read(spark, folder, "benchmark"))


def op7_line_dedup(spark: SparkSession, folder: str) -> DataFrame:
    docs = read(spark, folder, "documents").select("doc_id", "text")
    return line_dedup.dedup_passages(docs).select(
        "doc_id", F.col("_removed_chunks").alias("n_removed_chunks"), F.col("_removed_lines").alias("n_removed_lines"),
        F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


def op8_quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    return (quality_rules.apply_rules(read(spark, folder, "documents"), read(spark, folder, "labels"))
            .select("doc_id", *quality_rules.BASE, "base_failed", "kept", "score", "word_score"))


def op9_suffix_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return suffix_dedup.remove_repeats(read(spark, folder, "documents"))


def op10_token_counts(spark: SparkSession, folder: str) -> DataFrame:
    return token_counts.count_tokens(read(spark, folder, "documents"), tokenizer_file("piece_bpe_32k.model"))


def op11_embedding_whitening(spark: SparkSession, folder: str) -> DataFrame:
    return whitening.whiten(read(spark, folder, "embeddings"))


def op12_fill_middle(spark: SparkSession, folder: str) -> DataFrame:
    sha = lambda c: F.sha2(F.col(c).cast("binary"), 256).alias(f"{c}_sha256")
    return (fill_middle.transform(read(spark, folder, "documents"))
            .withColumn("restored", fill_middle.restored(F.col("form"), F.col("output")))
            .select("doc_id", "n", "form", "prefix_chars", "middle_chars", sha("output"), sha("restored")))


def op13_license_scan(spark: SparkSession, folder: str) -> DataFrame:
    return license_scan.scan(read(spark, folder, "documents"))


QUERIES = {f.__name__: f for f in (
    op1_chat_format, op2_bpe_round_trip, op3_sharding, op4_warc, op5_ngram_jaccard_join, op6_decontaminate,
    op7_line_dedup, op8_quality_rules, op9_suffix_dedup, op10_token_counts, op11_embedding_whitening,
    op12_fill_middle, op13_license_scan)}

_WORDS = (r"regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), "
          r"'[^\x20\x09-\x0D]+')")
_TEMPLATES = ", ".join(
    f"({k}, '{label}', {gram}, {least}, string_split('{text}', ' '))" for k, (label, gram, least, text) in enumerate(
        [(label, 2, 100, text) for label, text in license_scan.PHRASES]
        + [(label, 3, least, text) for label, least, text in license_scan.NOTICES]))

SQL = {
    "op4_warc": r"""
        WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
        d AS (SELECT page_id, octet_length(encode(html)) AS payload_bytes, sha1(html) AS hex,
                     max(page_id) OVER (PARTITION BY html) AS response_id FROM p)
        SELECT page_id, payload_bytes,
               list_aggregate(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
                   ((('0x' || substr(hex, (i // 4 * 5 + 1)::INT, 5))::INT >> (15 - 5 * (i % 4))::INT) & 31) + 1, 1)),
                   'string_agg', '') AS payload_digest,
               CASE WHEN page_id = response_id THEN 'response' ELSE 'revisit' END AS record_type,
               CASE WHEN page_id <> response_id THEN response_id END AS refers_to
        FROM d""",
    "op5_ngram_jaccard_join": f"""
        WITH RECURSIVE w AS MATERIALIZED (SELECT doc_id, {_WORDS} AS w FROM documents),
        s AS MATERIALIZED (
            SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= 3
                THEN list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])
                WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS g FROM w),
        n AS MATERIALIZED (SELECT d.doc_id, count(g) AS n FROM documents d LEFT JOIN s USING (doc_id) GROUP BY 1),
        x AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM s a JOIN s b USING (g)
              WHERE a.doc_id < b.doc_id GROUP BY 1, 2),
        l AS MATERIALIZED (SELECT a, b FROM x JOIN n na ON a = na.doc_id JOIN n nb ON b = nb.doc_id
              WHERE 100 * k >= 90 * (na.n + nb.n - k)),
        e AS MATERIALIZED (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
        r AS (SELECT doc_id AS a, doc_id AS b FROM documents
              UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a)
        SELECT n.doc_id, n.n AS n_shingles, c.component_id FROM n
        JOIN (SELECT a, min(b) AS component_id FROM r GROUP BY a) c ON n.doc_id = c.a""",
    "op6_decontaminate": f"""
        WITH d AS (SELECT doc_id AS id, {_WORDS} AS w FROM documents),
        i AS (SELECT item_id AS id, {_WORDS} AS w FROM benchmark),
        m AS (SELECT DISTINCT least(len(w), 5) AS k FROM i WHERE len(w) > 0),
        si AS (SELECT DISTINCT id, k, unnest(list_transform(range(1, len(w) - k + 2),
                   lambda j: array_to_string(w[j:j + k - 1], ' '))) AS g FROM i JOIN m ON least(len(w), 5) = k),
        sd AS (SELECT DISTINCT id, k, unnest(list_transform(range(1, len(w) - k + 2),
                   lambda j: array_to_string(w[j:j + k - 1], ' '))) AS g FROM d JOIN m ON len(w) >= k),
        q AS (SELECT id, count(*) AS n FROM si GROUP BY id)
        SELECT sd.id AS doc_id, si.id AS item_id, any_value(q.n) AS n_shingles, count(*) AS n_shared
        FROM sd JOIN si USING (k, g) JOIN q ON q.id = si.id GROUP BY 1, 2
        HAVING 10 * count(*) >= 8 * any_value(q.n)""",
    "op12_fill_middle": r"""
        WITH d AS (SELECT doc_id, coalesce(text, '') AS text, sha256('1:' || coalesce(doc_id::VARCHAR, '')) AS h
                   FROM documents),
        t AS (SELECT *, regexp_extract_all(text, '[A-Za-z]+|[^A-Za-z]') AS u,
                     list_transform([1, 9, 17, 25], lambda i: ('0x' || substr(h, i, 8))::BIGINT) AS r FROM d),
        c AS (SELECT *, len(u) AS n, least(r[1] % (len(u) + 1), r[2] % (len(u) + 1)) AS a,
                     greatest(r[1] % (len(u) + 1), r[2] % (len(u) + 1)) AS b,
                     CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>')
                          OR r[3] % 100 >= 90 THEN 'plain' WHEN r[4] % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM t),
        p AS (SELECT *, array_to_string(u[1:a], '') AS p, array_to_string(u[a + 1:b], '') AS m,
                     array_to_string(u[b + 1:], '') AS s FROM c)
        SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(p) END AS prefix_chars,
               CASE WHEN form <> 'plain' THEN length(m) END AS middle_chars,
               sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m
                      ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256, sha256(text) AS restored_sha256
        FROM p""",
    "op13_license_scan": rf"""
        WITH t(k, label, gram, least, tw) AS (VALUES {_TEMPLATES}),
        tg AS (SELECT *, unnest(range(1, len(tw) - gram + 2)) AS p FROM t),
        tq AS (SELECT k, label, gram, least, len(tw) AS n, p, array_to_string(tw[p:p + gram - 1], ' ') AS g FROM tg),
        d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''),
                  'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
              FROM documents),
        dg AS (SELECT r, unnest(w) AS a, unnest(w[2:]) AS b, unnest(w[3:]) AS c, unnest(range(1, len(w) + 1)) AS i FROM d),
        v AS (SELECT r, k, label, gram, least, n, i - p AS diagonal, p FROM tq JOIN (
                  SELECT r, i, 2 AS gram, a || ' ' || b AS g FROM dg UNION ALL
                  SELECT r, i, 3, a || ' ' || b || ' ' || c FROM dg) USING (gram, g)),
        diagonals AS (SELECT DISTINCT r, k, gram, diagonal FROM v),
        starts AS (SELECT *, CASE WHEN gram = 3 AND diagonal - lag(diagonal) OVER (PARTITION BY r, k ORDER BY diagonal) <= 4
                         THEN 0 ELSE 1 END AS start FROM diagonals),
        s AS (SELECT r, k, diagonal, sum(start) OVER (PARTITION BY r, k ORDER BY diagonal
                         ROWS UNBOUNDED PRECEDING) AS span FROM starts),
        c AS (SELECT r, k, any_value(label) AS label, any_value(gram) AS gram, any_value(least) AS least,
                     any_value(n) AS n, min(diagonal + p) - 1 AS a, max(diagonal + p + gram - 1) - 1 AS b,
                     list(DISTINCT p) AS ps FROM v JOIN s USING (r, k, diagonal) GROUP BY r, k, span),
        x AS (SELECT r, label, gram, least, a, len(list_distinct(flatten(list_transform(ps,
                     lambda p: range(p, p + gram))))) / n AS score FROM c WHERE b - a < 2 * n),
        y AS (SELECT r, count(*) FILTER (gram = 2) AS n_base, min(a) FILTER (gram = 2) AS first_word,
                     max(a) FILTER (gram = 2) AS last_word,
                     string_agg(DISTINCT label, ',' ORDER BY label) FILTER (gram = 2) AS base_labels,
                     string_agg(DISTINCT label, ',' ORDER BY label) FILTER (100 * score >= least) AS labels,
                     max(score) AS score FROM x WHERE gram = 3 OR score = 1 GROUP BY r)
        SELECT doc_id, len(w) AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word,
               coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, coalesce(score, 0.0) AS score
        FROM d LEFT JOIN y USING (r)""",
}
