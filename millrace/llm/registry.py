"""The queries opN_<name> and their SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm import crosstoken, descriptors, langid, mixing, packing, phrases, secrets, simhash, topk, toxicity, urls, warc, wordpiece

Query = Callable[[SparkSession, str], DataFrame]


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(_table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken", "position")


def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    scanned = secrets.scan(docs, secrets.fit(secrets.labelled_samples(docs)), keep=["doc_id"])
    found = F.col(scanned.columns[-1])
    return scanned.select(
        "doc_id",
        *[F.size(found[k]).cast("long").alias(f"n_{k}") for k in ("assign", "access", "hex")],
        F.sha2(secrets.listed(found, ("assign", "access", "hex")).cast("binary"), 256).alias("base_sha256"),
        secrets.listed(found, ("assign", "access", "hex", "markov")).alias("spans"),
    )


def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    grouped = simhash.near_duplicates(_table(spark, sf_dir, "documents"))
    return grouped.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    out = langid.held_out(F.col("doc_id"), 4, 2)
    found = langid.identify(docs, langid.fit(docs.where(~out)))
    return found.select("doc_id", out.alias("held_out"), "lang_pred", "score")


def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wordpiece.token_counts(_table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels")
    out = langid.held_out(F.col("doc_id"), 5, 0)
    found = toxicity.score(docs, toxicity.fit(toxicity.training_rows(docs, labels, trained=~out)))
    return found.select("doc_id", out.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.search(_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, k=5)


def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pictures that Spark draws from the embeddings, a tenth of them with an edited copy, as the media column."""
    return descriptors.copies(descriptors.pictures(_table(spark, sf_dir, "embeddings")))


def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archive(_table(spark, sf_dir, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.collocations(_table(spark, sf_dir, "documents"))


def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    found = crosstoken.align(docs, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"), digest=True)
    return found.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", F.col("groups").alias("groups_sha256"))


def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Listed are the pages filled with symbols; whatever page has the same canonical URL is blocked too."""
    pages = _table(spark, sf_dir, "pages")
    return urls.judge(pages, urls.junk(pages)).select("page_id", "host", "path", "rule", "verdict")


def queries() -> dict[str, Query]:
    return {
        "op1_sum_of_squares_packing": op1,
        "op2_source_mixing": op2,
        "op3_secret_scan": op3,
        "op4_simhash_near_dedup": op4,
        "op5_language_bitmasks": op5,
        "op6_linear_word_pieces": op6,
        "op7_toxicity_automata": op7,
        "op8_pivot_distance_topk": op8,
        "op9_image_descriptors": op9,
        "op10_seekable_warc": op10,
        "op11_phrase_collocations": op11,
        "op12_tokenizer_alignment": op12,
        "op13_url_filter": op13,
    }


OP2_SQL = r"""
WITH sized AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size, md5(coalesce(doc_id::VARCHAR, '')) AS h
  FROM documents),
by_source AS (SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source ASC NULLS LAST) - 1 AS source_no FROM sized GROUP BY source),
caps AS (SELECT *, CASE source_no % 3 WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS weight, source_size * 3 AS cap FROM by_source),
levels AS (
  SELECT *, (sum(source_size) OVER () - coalesce(sum(cap) OVER (ORDER BY cap / weight, source_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::DOUBLE
    / sum(weight) OVER (ORDER BY cap / weight, source_no ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM caps),
plan AS (SELECT source, source_no, source_size, least(cap::DOUBLE, max(level) OVER () * weight) AS target FROM levels),
demand AS (
  SELECT sum(floor(goal * CASE source_no % 3 WHEN 0 THEN {3/6} WHEN 1 THEN {1/3} ELSE {1/6} END))::BIGINT AS d1,
    sum(floor(goal * CASE source_no % 3 WHEN 0 THEN {5/6} WHEN 1 THEN {2/3} ELSE {3/6} END))::BIGINT AS d2, sum(goal)::BIGINT AS d3
  FROM (SELECT source_no, floor(target)::BIGINT AS goal FROM plan)),
placed AS (
  SELECT d.doc_id, d.size, p.source_size, p.source_no, p.target, floor(p.target)::BIGINT AS goal,
    coalesce(sum(d.size) OVER (PARTITION BY p.source_no ORDER BY d.h, d.doc_id, d.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start
  FROM sized d JOIN plan p ON d.source IS NOT DISTINCT FROM p.source),
took AS (
  SELECT *, (greatest(0, least(size, goal - start)) + greatest(0, least(size, goal - (start + source_size)))
    + greatest(0, least(size, goal - (start + source_size * 2))))::BIGINT AS taken, start::DOUBLE / goal::DOUBLE AS c FROM placed)
SELECT doc_id, size, source_size, target, taken, CASE WHEN taken > 0 THEN
  CASE source_no % 3
    WHEN 0 THEN CASE WHEN c < {3/6} THEN 0 + (c - 0.0) / {3/6} * d1 WHEN c < {5/6} THEN d1 + (c - {3/6}) / {5/6-3/6} * (d2 - d1) ELSE d2 + (c - {5/6}) / {1-5/6} * (d3 - d2) END
    WHEN 1 THEN CASE WHEN c < {1/3} THEN 0 + (c - 0.0) / {1/3} * d1 WHEN c < {2/3} THEN d1 + (c - {1/3}) / {2/3-1/3} * (d2 - d1) ELSE d2 + (c - {2/3}) / {1-2/3} * (d3 - d2) END
    ELSE CASE WHEN c < {1/6} THEN 0 + (c - 0.0) / {1/6} * d1 WHEN c < {3/6} THEN d1 + (c - {1/6}) / {3/6-1/6} * (d2 - d1) ELSE d2 + (c - {3/6}) / {1-3/6} * (d3 - d2) END
  END END AS position
FROM took, demand
"""
for _name, _value in {"3/6": 3 / 6, "5/6": 5 / 6, "1/3": 1 / 3, "2/3": 2 / 3, "1/6": 1 / 6, "5/6-3/6": 5 / 6 - 3 / 6, "1-5/6": 1 - 5 / 6, "2/3-1/3": 2 / 3 - 1 / 3, "1-2/3": 1 - 2 / 3, "3/6-1/6": 3 / 6 - 1 / 6, "1-3/6": 1 - 3 / 6}.items():
    OP2_SQL = OP2_SQL.replace("{" + _name + "}", f"{_value!r}::DOUBLE")


OP8_SQL = """
WITH ints AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2]))::BIGINT AS score
  FROM ints q JOIN ints c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id)
SELECT query_id, rank::INTEGER AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM scored) WHERE rank <= 5
"""

OP10_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
d AS (SELECT page_id, octet_length(encode(html)) AS n, sha1(html) AS h, min(page_id) OVER (PARTITION BY html) AS first FROM p)
SELECT page_id, n::BIGINT AS payload_bytes,
  array_to_string(list_transform(range(0, 32), lambda j: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((('0x' || substr(h, (1 + 5 * (j // 4))::INTEGER, 5))::BIGINT >> (5 * (3 - j % 4))) & 31)::INTEGER + 1, 1)), '') AS payload_digest,
  CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id = first THEN NULL ELSE first END AS refers_to
FROM d
"""

OP11_SQL = r"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece
  FROM documents),
cut AS (SELECT lang, list_filter(string_split_regex(piece, '[\x20\x09]+'), lambda x: x <> '') AS w FROM pieces),
grams AS (SELECT lang, k, unnest(list_transform(range(1, len(w) - k + 2), lambda i: array_to_string(w[i:i + k - 1], ' '))) AS phrase FROM cut, range(1, 5) t(k) WHERE len(w) >= k),
f AS (SELECT lang, k, phrase, count(*) AS a FROM grams GROUP BY lang, k, phrase HAVING count(*) >= 30),
totals AS (SELECT lang, sum(len(w))::BIGINT AS n FROM cut GROUP BY lang),
asked AS (
  SELECT lang, k, phrase, a, j, array_to_string(string_split(phrase, ' ')[1:j], ' ') AS p, array_to_string(string_split(phrase, ' ')[j + 1:], ' ') AS q
  FROM f, range(1, 4) t(j) WHERE j < k),
cuts AS (
  SELECT c.*, x.a AS l, y.a AS r, (2000000::HUGEINT * c.a // (x.a + y.a))::BIGINT AS score
  FROM asked c JOIN f x ON x.lang = c.lang AND x.phrase = c.p JOIN f y ON y.lang = c.lang AND y.phrase = c.q),
lowest AS (SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, j) = 1),
inside AS (
  SELECT lang, array_to_string(string_split(phrase, ' ')[i:i + m - 1], ' ') AS phrase, max(a) AS longer
  FROM f, range(2, 4) t(m), range(1, 4) u(i) WHERE m < k AND i + m - 1 <= k GROUP BY ALL),
kept AS (SELECT b.* FROM lowest b LEFT JOIN inside i ON i.lang = b.lang AND i.phrase = b.phrase WHERE NOT coalesce(100::HUGEINT * i.longer >= 80::HUGEINT * b.a, false)),
placed AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, encode(phrase)) AS rank FROM kept)
SELECT p.lang, p.rank, p.phrase, p.a, p.l, p.r, t.n, p.score FROM placed p JOIN totals t ON t.lang = p.lang WHERE p.rank <= 2000
"""

OP13_SQL = r"""
WITH rules(verdict, host, path) AS (VALUES ('block', 'net', '/'), ('allow', 'example.net', '/en/'), ('block', 'example.com', '/de/'), ('allow', 'org', '/fr/')),
read AS (
  SELECT page_id, url, html, translate(coalesce(regexp_extract(url, '://([^/?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    coalesce(regexp_extract(url, '://[^/?#]*([^?#]*)', 1), '') AS path,
    list_sort(list_filter(string_split(coalesce(regexp_extract(url, '://[^?#]*\?([^#]*)', 1), ''), '&'), lambda x: x <> '' AND NOT regexp_matches(x, '^(utm_[a-z]+|ref|fbclid|gclid)(=|$)'))) AS asked
  FROM pages),
named AS (
  SELECT *, CASE WHEN contains(url, '://') THEN
    regexp_replace(regexp_replace(host, '^.*@|\.*(:(80|443)?)?$', '', 'g'), '^(www|m)\.', '')
    || regexp_replace(regexp_replace(path, '/+', '/', 'g'), '(/index)?(\.html)?/?$', '')
    || CASE WHEN len(asked) > 0 THEN '?' || array_to_string(asked, '&') ELSE '' END END AS canonical
  FROM read),
listed AS (SELECT DISTINCT canonical FROM named WHERE canonical IS NOT NULL AND len(regexp_extract_all(html, '%%%|###|\*\*\*|\$\$\$')) >= 10),
fit AS (
  SELECT page_id, max_by(rules.host || rules.path, length(rules.host) + length(rules.path)) AS rule, max_by(verdict, length(rules.host) + length(rules.path)) AS verdict
  FROM named JOIN rules ON (named.host = rules.host OR ends_with(named.host, '.' || rules.host)) AND starts_with(named.path, rules.path) GROUP BY page_id)
SELECT n.page_id, n.host, n.path, f.rule, coalesce(f.verdict, CASE WHEN l.canonical IS NOT NULL THEN 'block' ELSE 'allow' END) AS verdict
FROM named n LEFT JOIN fit f USING (page_id) LEFT JOIN listed l ON n.canonical = l.canonical
"""


def oracle_sql() -> dict[str, str]:
    return {"op2_source_mixing": OP2_SQL, "op8_pivot_distance_topk": OP8_SQL, "op10_seekable_warc": OP10_SQL, "op11_phrase_collocations": OP11_SQL, "op13_url_filter": OP13_SQL}
