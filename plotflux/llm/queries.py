"""The operators as queries on the test tables, and their SQL where it can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plotflux.llm import collocations, decontaminate, jaccard, neighbours, pieces, pii, quality, repeats, toxicity, url_filter, warc
from plotflux.llm.mixing import mix_sources
from plotflux.llm.secrets import secret_spans, span_text
from plotflux.llm.shared import WORD, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(function):
    QUERIES[function.__name__] = function
    return function


@query
def op4_mixing(spark: SparkSession, folder: str) -> DataFrame:
    mixed = mix_sources(table(spark, folder, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken")


@query
def op6_secrets(spark: SparkSession, folder: str) -> DataFrame:
    found = secret_spans(table(spark, folder, "documents"))
    return found.select(
        "doc_id", "n_assign", "n_access", "n_hex", F.sha2(span_text(F.col("base")), 256).alias("base_sha256"), span_text(F.col("spans")).alias("spans")
    )


@query
def op2_pii(spark: SparkSession, folder: str) -> DataFrame:
    found = pii.personal_data(table(spark, folder, "documents"))
    return found.select(
        "doc_id",
        *[
            F.size(F.filter("base", _of_rank(k))).cast("long").alias(f"n_{name}")
            for k, name in enumerate(pii.KINDS)
        ],
        F.sha2(pii.span_text(F.col("base")), 256).alias("base_sha256"),
        pii.span_text(F.col("spans")).alias("spans"),
    )


def _of_rank(rank: int):
    return lambda span: span["rank"] == rank


@query
def op7_warc(spark: SparkSession, folder: str) -> DataFrame:
    return warc.archive_pages(spark, table(spark, folder, "pages"))


@query
def op10_url_filter(spark: SparkSession, folder: str) -> DataFrame:
    return url_filter.judge_urls(table(spark, folder, "pages"))


@query
def op3_jaccard(spark: SparkSession, folder: str) -> DataFrame:
    return jaccard.jaccard_groups(table(spark, folder, "documents"))


@query
def op5_quality(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    model = quality.fit_quality(docs, table(spark, folder, "labels"))
    judged = quality.judge_quality(docs, model)
    return judged.select("_row.doc_id", *[F.col(f"_quality.{c}").alias(c) for c in ("document", "host", "path", "score", "keep")])


@query
def op8_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    return toxicity.score_toxicity(table(spark, folder, "documents"), table(spark, folder, "labels"))


@query
def op9_decontaminate(spark: SparkSession, folder: str) -> DataFrame:
    return decontaminate.find_leaks(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


@query
def op1_neighbours(spark: SparkSession, folder: str) -> DataFrame:
    return neighbours.nearest(table(spark, folder, "embeddings"), F.col("vec_id") % 20 == 0)


#: The vocabulary of op11; a file of the environment, never part of the library.
PIECE_MODEL = "piece_bpe_32k.model"


@query
def op11_sentencepiece(spark: SparkSession, folder: str) -> DataFrame:
    import public_tokenizers

    encoded = pieces.encode_pieces(table(spark, folder, "documents"), public_tokenizers.path(PIECE_MODEL))
    return encoded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.concat_ws(",", F.col("ids").cast("array<string>")), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
        "agrees",
    )


def _planted(docs: DataFrame) -> DataFrame:
    """The documents of op12: in a tenth of them the words from some place on repeat."""
    h = F.crc32(F.col("doc_id").cast("string"))
    g = F.floor(h / 10)

    def repeat(words):
        n = F.size(words).cast("long")
        a = g % n
        p = 1 + F.floor((n - a) / (3 + g % 8))
        source = lambda i: F.when(i >= a, a + (i - a) % p).otherwise(i)
        return F.concat_ws(" ", F.transform(F.sequence(F.lit(0).cast("long"), n - 1), lambda i: F.get(words, source(i).cast("int"))))

    # The array of words is bound once, by a transform, not split anew for every word.
    words = F.array(F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(WORD), F.lit(0)))
    some = F.filter(words, lambda w: F.size(w) > 0)
    planted = F.coalesce(F.try_element_at(F.transform(some, repeat), F.lit(1)), F.lit(""))
    return docs.select("doc_id", F.when(h % 10 == 0, planted).otherwise(F.col("text")).alias("text"))


@query
def op12_periodic_runs(spark: SparkSession, folder: str) -> DataFrame:
    found = repeats.word_runs(_planted(table(spark, folder, "documents")))
    first = F.lit(None).cast("struct<start:bigint,length:bigint,period:bigint>")
    better = lambda best, r: best.isNull() | (r["length"] * best["period"] > best["length"] * r["period"])
    best = F.aggregate("runs", first, lambda held, r: F.when(better(held, r), r).otherwise(held))
    line = lambda r: F.concat(r["start"], F.lit(","), r["length"], F.lit(","), r["period"], F.lit("\n"))
    return found.withColumn("best", best).select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        *[F.col(f"best.{c}").alias(c) for c in ("start", "length", "period")],
        F.expr("best.length * 1000 div best.period").alias("exponent_milli"),
        F.sha2(F.concat_ws("", F.transform("runs", line)), 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


@query
def op13_collocations(spark: SparkSession, folder: str) -> DataFrame:
    return collocations.collocations(table(spark, folder, "documents"))


#: Exact search in SQL, for comparison only: the operator is approximate.
EXACT_NEIGHBOURS = """SELECT q.vec_id AS query_id, r.vec_id AS vec_id,
  list_inner_product(CAST(q.embedding AS DOUBLE[]), CAST(r.embedding AS DOUBLE[])) AS score
FROM embeddings q JOIN embeddings r ON q.vec_id % 20 = 0 AND r.vec_id <> q.vec_id"""


ORACLE["op3_jaccard"] = r"""WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x20\x09-\x0D]+') AS w FROM documents),
sets AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= 5
    THEN [array_to_string(w[i:i + 4], ' ') FOR i IN range(1, len(w) - 3)]
    WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS shingle FROM words),
sizes AS (
  SELECT d.doc_id, count(s.shingle) AS n FROM documents d LEFT JOIN sets s USING (doc_id) GROUP BY d.doc_id),
shared AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS same
  FROM sets a JOIN sets b ON a.shingle = b.shingle AND a.doc_id <> b.doc_id GROUP BY 1, 2),
links AS (
  SELECT a, b FROM shared JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b
  WHERE 100 * same >= 75 * (x.n + y.n - same)),
reach AS (
  SELECT doc_id AS a, doc_id AS b FROM documents
  UNION SELECT reach.a, links.b FROM reach JOIN links ON links.a = reach.b)
SELECT doc_id, n AS n_shingles, (SELECT min(b) FROM reach WHERE reach.a = sizes.doc_id) AS component_id FROM sizes"""

# Base32 of the 160 bits of a SHA-1, five at a time.
ORACLE["op7_warc"] = """WITH payloads AS (
  SELECT page_id, encode(coalesce(html, '')) AS body FROM pages),
hashed AS (
  SELECT page_id, octet_length(body) AS n, sha1(body) AS h, CAST(CAST(unhex(sha1(body)) AS BIT) AS VARCHAR) AS bits FROM payloads),
digests AS (
  SELECT page_id, n, h, array_to_string([substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + CAST(list_sum(
    [CAST(substr(bits, CAST(i + k + 1 AS BIGINT), 1) AS INTEGER) * (16 >> CAST(k AS INTEGER)) FOR k IN range(0, 5)]) AS INTEGER), 1)
    FOR i IN range(0, 160, 5)], '') AS d
  FROM hashed),
firsts AS (SELECT h, min(page_id) AS first FROM hashed GROUP BY h)
SELECT page_id, n AS payload_bytes, d AS payload_digest,
  CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> first THEN first END AS refers_to
FROM digests JOIN firsts USING (h)"""


ORACLE["op13_collocations"] = r"""WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
words AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM pieces),
sizes AS (SELECT lang, CAST(sum(len(w)) AS BIGINT) AS n FROM words GROUP BY lang),
grams AS (
  SELECT lang, 1 AS k, unnest(w) AS phrase FROM words
  UNION ALL SELECT lang, 2, unnest([w[i] || ' ' || w[i + 1] FOR i IN range(1, len(w))]) FROM words
  UNION ALL SELECT lang, 3, unnest([array_to_string(w[i:i + 2], ' ') FOR i IN range(1, len(w) - 1)]) FROM words
  UNION ALL SELECT lang, 4, unnest([array_to_string(w[i:i + 3], ' ') FOR i IN range(1, len(w) - 2)]) FROM words),
f AS MATERIALIZED (SELECT lang, k, phrase, count(*) AS a FROM grams GROUP BY ALL HAVING count(*) >= 30),
candidates AS (SELECT lang, k, phrase, a, string_split(phrase, ' ') AS w FROM f WHERE k > 1),
cuts AS MATERIALIZED (
  SELECT *, array_to_string(w[1:cut], ' ') AS first, array_to_string(w[cut + 1:], ' ') AS rest
  FROM (SELECT *, unnest(range(1, k)) AS cut FROM candidates)),
scored AS (
  SELECT c.*, x.a AS l, y.a AS r, CAST(2000000 AS HUGEINT) * c.a // (x.a + y.a) AS score
  FROM cuts c JOIN f x ON x.lang = c.lang AND x.phrase = c.first JOIN f y ON y.lang = c.lang AND y.phrase = c.rest),
weakest AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1),
inside AS (
  SELECT lang, array_to_string(w[i:i + size - 1], ' ') AS phrase, max(a) AS most
  FROM (SELECT *, unnest(range(1, k - size + 2)) AS i FROM (SELECT *, unnest(range(2, k)) AS size FROM candidates))
  GROUP BY ALL),
kept AS (
  SELECT w.* FROM weakest w LEFT JOIN inside i ON i.lang = w.lang AND i.phrase = w.phrase
  WHERE i.most IS NULL OR CAST(100 AS HUGEINT) * i.most < CAST(80 AS HUGEINT) * w.a),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM kept)
SELECT k.lang, rank, phrase, a, l, r, n, CAST(score AS BIGINT) AS score FROM ranked k JOIN sizes s ON s.lang = k.lang WHERE rank <= 2000"""
