"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shellgauge.llm import alignment, bpe, class_lm, collocations, decontamination, mixing, near_dup, quality_model, quality_rules, secrets, sharding, urls, warc
from shellgauge.llm.common import table
from shellgauge.session import scratch

#: The vocabulary of the encoding query.
TOKENIZER = public_tokenizers.path("word_bpe_49k.json")
#: The two vocabularies that are aligned.
BYTE_TOKENIZER, PIECE_TOKENIZER = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of every document's ids and of the text decoded from them."""
    return bpe.round_trip(table(spark, sf_dir, "documents"), TOKENIZER)


def op2_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in 40 shards of near equal bytes."""
    dealt = sharding.shard(table(spark, sf_dir, "documents"), shards=40)
    return dealt.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )


#: The rules of the URL query.
URL_RULES = [
    ("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block"),
]


def op3_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Host, path, rule and verdict of every page's URL."""
    rules = spark.createDataFrame(URL_RULES, "host string, path string, action string")
    return urls.judge(table(spark, sf_dir, "pages"), rules)


def op4_quality_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A calibrated quality score of every document."""
    scored = quality_model.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return scored.withColumn("predicted", (F.col("score") >= quality_model.ACCEPT).cast("int"))


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document that holds a benchmark item, and the item."""
    found = decontamination.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "item_id", "matched", "windows")


def op6_near_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The near-duplicate class of every document."""
    return near_dup.near_duplicates(table(spark, sf_dir, "documents"))


def op7_class_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The class model's score of every document, beside the plain one."""
    return class_lm.score(table(spark, sf_dir, "documents"))


def op8_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets in every document."""
    return secrets.digest(secrets.find(table(spark, sf_dir, "documents")))


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page's record, written to an archive and read back."""
    at = scratch(spark, "warc")
    warc.write_archive(table(spark, sf_dir, "pages"), at)
    back = warc.read_headers(spark, at)
    return back.select(F.col("key").alias("page_id"), "payload_bytes", "payload_digest", "record_type", "refers_to")


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and verdict of every document by the learned list."""
    docs = table(spark, sf_dir, "documents")
    return quality_rules.judge(docs, quality_rules.learn(docs, table(spark, sf_dir, "labels")))


def op11_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The words of every document that the mix of the sources takes."""
    return mixing.taken(table(spark, sf_dir, "documents"))


def op12_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of tokens of two vocabularies that cover the same bytes, and how often their ends are linked."""
    return alignment.measure(table(spark, sf_dir, "documents"), BYTE_TOKENIZER, PIECE_TOKENIZER)


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best phrases of each language."""
    return collocations.collocations(table(spark, sf_dir, "documents"))


Q = {
    "op1_bpe": op1_bpe,
    "op2_sharding": op2_sharding,
    "op3_urls": op3_urls,
    "op4_quality_model": op4_quality_model,
    "op5_decontamination": op5_decontamination,
    "op6_near_dup": op6_near_dup,
    "op7_class_lm": op7_class_lm,
    "op8_secrets": op8_secrets,
    "op9_warc": op9_warc,
    "op10_quality_rules": op10_quality_rules,
    "op11_mixing": op11_mixing,
    "op12_alignment": op12_alignment,
    "op13_collocations": op13_collocations,
}
SQL: dict[str, str] = {
    "op3_urls": """
        WITH parsed AS (
            SELECT page_id,
                   CASE WHEN contains(url, '://') THEN regexp_extract(substr(url, strpos(url, '://') + 3), '^[^/?#]*') ELSE '' END AS raw,
                   CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest
            FROM pages),
        parts AS (
            SELECT page_id, translate(raw, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
                   regexp_extract(substr(rest, length(raw) + 1), '^[^?#]*') AS path
            FROM parsed),
        fitting AS (
            SELECT *, '.' || host AS dotted FROM parts),
        ruled AS (
            SELECT page_id, host, path,
                   CASE WHEN ends_with(dotted, '.example.org') AND starts_with(path, '/en/1') THEN 'example.org/en/1'
                        WHEN ends_with(dotted, '.example.org') AND starts_with(path, '/es/') THEN 'example.org/es/'
                        WHEN ends_with(dotted, '.com') AND starts_with(path, '/fr/') THEN 'com/fr/'
                        WHEN ends_with(dotted, '.com') AND starts_with(path, '/de/') THEN 'com/de/'
                        WHEN ends_with(dotted, '.org') AND starts_with(path, '/') THEN 'org/' END AS rule
            FROM fitting)
        SELECT page_id, coalesce(host, '') AS host, coalesce(path, '') AS path, rule,
               CASE WHEN rule IN ('example.org/en/1', 'example.org/es/', 'com/de/') THEN 'block' ELSE 'allow' END AS verdict
        FROM ruled""",
    "op9_warc": """
        WITH hashed AS (
            SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, coalesce(html, '') AS body, sha1(coalesce(html, '')) AS hex
            FROM pages),
        largest AS (
            SELECT body, max(page_id) AS top FROM hashed GROUP BY body)
        SELECT page_id, payload_bytes,
               array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
                   (((('0x' || substr(hex, (5 * (i // 4) + 1)::INT, 5))::BIGINT) >> (15 - 5 * (i % 4))::INT) & 31)::INT + 1, 1)), '') AS payload_digest,
               CASE WHEN top IS NULL OR page_id = top THEN 'response' ELSE 'revisit' END AS record_type,
               CASE WHEN top IS NOT NULL AND page_id IS DISTINCT FROM top THEN top END AS refers_to
        FROM hashed JOIN largest USING (body)""",
    "op11_mixing": r"""
        WITH counted AS (
            SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size FROM documents),
        sized AS (
            SELECT source, sum(size)::HUGEINT AS s FROM counted GROUP BY source),
        weighed AS (
            SELECT source, s, [5, 2, 1][1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3] AS w, sum(s) OVER () AS total FROM sized),
        filling AS (
            SELECT *, coalesce(sum(3 * s) OVER (ORDER BY 3 * s / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS filled,
                   sum(w) OVER (ORDER BY 3 * s / w, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS rest
            FROM weighed),
        marked AS (
            SELECT *, 3 * s * rest <= (total - filled) * w AS capped FROM filling),
        targets AS (
            SELECT source, s, CASE WHEN capped THEN (3 * s)::DOUBLE
                       ELSE ((total - coalesce(sum(CASE WHEN capped THEN 3 * s END) OVER (), 0)) * w)::DOUBLE
                            / (sum(CASE WHEN NOT capped THEN w END) OVER ())::DOUBLE END AS target
            FROM marked),
        placed AS (
            SELECT c.*, t.s, t.target, round(t.target)::BIGINT AS quota,
                   sum(size) OVER (PARTITION BY c.source ORDER BY md5('mix:' || c.doc_id::VARCHAR), c.doc_id ROWS UNBOUNDED PRECEDING) - size AS start
            FROM counted c JOIN targets t ON c.source IS NOT DISTINCT FROM t.source)
        SELECT doc_id, size::BIGINT AS size, s::BIGINT AS source_size, target,
               (greatest(0, least(size, quota - start)) + greatest(0, least(size, quota - start - s)) + greatest(0, least(size, quota - start - 2 * s)))::BIGINT AS taken
        FROM placed""",
    "op13_collocations": r"""
        WITH pieces AS (
            SELECT coalesce(lang, 'und') AS lang, regexp_extract_all(p, '[^\x20\x09]+') AS w
            FROM (SELECT lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                                      '[.,;:!?\x0A-\x0D]')) AS p FROM documents)),
        totals AS (
            SELECT lang, sum(len(w))::BIGINT AS n FROM pieces GROUP BY lang),
        grams AS (
            SELECT lang, k, unnest(list_transform(range(1, len(w) - k + 2), lambda i: array_to_string(w[i:i + k - 1], ' '))) AS phrase
            FROM pieces CROSS JOIN (VALUES (1), (2), (3)) AS sizes(k)),
        counts AS (
            SELECT lang, k, phrase, count(*) AS f FROM grams GROUP BY ALL HAVING count(*) >= 10),
        cuts AS (
            SELECT lang, phrase, f AS a, c,
                   array_to_string(string_split(phrase, ' ')[1:c], ' ') AS lhs, array_to_string(string_split(phrase, ' ')[c + 1:], ' ') AS rhs
            FROM counts JOIN (VALUES (1), (2)) AS cutting(c) ON c < k),
        sided AS (
            SELECT cuts.*, x.f AS l, y.f AS r, (1000000::HUGEINT * a * a) // (x.f::HUGEINT * y.f) AS score
            FROM cuts JOIN counts x ON x.lang = cuts.lang AND x.phrase = lhs JOIN counts y ON y.lang = cuts.lang AND y.phrase = rhs),
        lowest AS (
            SELECT * FROM sided QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, c) = 1),
        inside AS (
            SELECT lang, array_to_string(string_split(phrase, ' ')[i:i + 1], ' ') AS phrase, max(f) AS longer
            FROM counts JOIN (VALUES (1), (2)) AS spots(i) ON k = 3 GROUP BY ALL),
        ranked AS (
            SELECT lowest.lang, phrase, a, l, r, score, row_number() OVER (PARTITION BY lowest.lang ORDER BY score DESC, a DESC, encode(phrase)) AS rank
            FROM lowest LEFT JOIN inside USING (lang, phrase) WHERE longer IS NULL OR 100 * longer < 50 * a)
        SELECT lang, rank::BIGINT AS rank, phrase, a::BIGINT AS a, l::BIGINT AS l, r::BIGINT AS r, n, score::BIGINT AS score
        FROM ranked JOIN totals USING (lang) WHERE rank <= 2000""",
}
