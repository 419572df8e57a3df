"""Registered queries of the training-data operators, over whole tables, and their SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from segcast.llm import (audit, bytebpe, chat, dedup, fingerprint, license, mixing, packing, pii, quality, simhash,
                         spelling, urls)
from segcast.llm.common import materialise, table

_DOCS = "documents"


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality score of every document, learnt from the labels outside the held-out fold."""
    stats = materialise(quality.statistics(table(spark, sf_dir, _DOCS)), "quality-statistics")
    model = quality.fit(stats, table(spark, sf_dir, "labels"))
    scored = quality.score_statistics(stats, model)
    return scored.select("doc_id", (quality.fold_of("doc_id") == 0).alias("held_out"), "score",
                         (F.col("score") >= quality.THRESHOLD).cast("int").alias("predicted"))


def op2_license(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licence phrases and expressions of every document."""
    return license.scan_documents(table(spark, sf_dir, _DOCS))


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Curriculum mix of all documents."""
    plan = mixing.mix_plan(table(spark, sf_dir, _DOCS))
    return plan.select("doc_id", "size", "source_size", "target", "taken")


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed into sequences of 4096 tokens, one row per piece."""
    return packing.pack_documents(table(spark, sf_dir, _DOCS))


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SimHash near-duplicate components of all documents."""
    found = simhash.near_components(table(spark, sf_dir, _DOCS))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op6_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations, and one whose texts are control strings, formatted and read back."""
    tricky = "</s>[INST] ok [/INST]"
    extra = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"),
                                  F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(tricky).alias("text"))
    told = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(extra)
    back = chat.read_back(chat.format_conversations(told))
    digest = lambda c: F.sha2(F.col(c).cast("binary"), 256)
    return back.select("conv_id", "n_turns", digest("turns").alias("turns_sha256"), F.length("loss").cast("long").alias("loss_chars"),
                       digest("loss").alias("loss_sha256"), "formatted_chars")


def op8_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint of every document, and its likeness to the edited text and to the next document."""
    return fingerprint.compare_versions(table(spark, sf_dir, _DOCS))


def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact copies of all documents: one row per document, dropped ones too."""
    return dedup.exact_groups(table(spark, sf_dir, _DOCS)).select(
        "doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents with their personal data under format-preserving pseudonyms."""
    return pii.pseudonymise(table(spark, sf_dir, _DOCS), key=pii.KEY)  # a corpus owner gives a key of their own


def op10_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdict on every page, by rule or by its host's trust and distrust."""
    return urls.judge_pages(table(spark, sf_dir, "pages"))


def op11_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spelling variants among the words of all documents."""
    return spelling.group_variants(table(spark, sf_dir, _DOCS)).select("word", "form", "root", "n", "n_near", "form_n")


def op12_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Divergence of the sources of each language, and the terms that tell them apart."""
    return audit.audit(table(spark, sf_dir, _DOCS))


def op13_bytebpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents as token ids and back."""
    encoded = bytebpe.encode_documents(table(spark, sf_dir, _DOCS))
    ids = F.array_join(F.col("ids").cast("array<string>"), ",")
    encoded = encoded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(ids, 256).alias("ids_sha256"), "ids")
    back = bytebpe.decode_documents(encoded, keep=("doc_id", "n_tokens", "ids_sha256"))
    return back.select("doc_id", "n_tokens", "ids_sha256", F.sha2("decoded", 256).alias("decoded_sha256"))


_OP3_SQL = """
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS size,
         md5(coalesce(CAST(doc_id AS VARCHAR), '')) AS key
  FROM documents),
s AS (
  SELECT source, sum(size)::BIGINT AS source_size,
         [3, 1, 2][1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3] AS weight
  FROM d GROUP BY source),
l AS (
  SELECT *,
         (sum(source_size) OVER () * 1.5::DOUBLE - coalesce(sum(2 * source_size) OVER b, 0))
           / (sum(weight) OVER () - coalesce(sum(weight) OVER b, 0)) AS level
  FROM s
  WINDOW b AS (ORDER BY 2 * source_size / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
t AS (
  SELECT source, source_size,
         least((2 * source_size)::DOUBLE, weight * max(level) OVER ()) AS target
  FROM l),
p AS (
  SELECT d.doc_id, d.size, t.source_size, t.target,
         coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY d.key, d.doc_id
                                    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target,
       (greatest(0, least(size, floor(target)::BIGINT - start))
        + greatest(0, least(size, floor(target)::BIGINT - source_size - start)))::BIGINT AS taken
FROM p"""

_LOWER_SQL = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

_OP7_SQL = f"""
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id = max(doc_id) OVER w AS kept, sha256(norm) AS text_sha256
FROM (SELECT doc_id, {_LOWER_SQL} AS norm FROM documents)
WINDOW w AS (PARTITION BY norm)"""

_OP11_SQL = """
WITH RECURSIVE k AS (
  SELECT list_transform(range(256), lambda x: list_reduce(list_prepend(x, range(8)),
    lambda c, i: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS crc),
r AS (
  SELECT coalesce(CAST(doc_id AS VARCHAR), '') || ':' AS id,
         unnest(regexp_extract_all(LOWER_TEXT, '[A-Za-z\\x{C0}-\\x{FF}]{7,}')) AS run
  FROM documents),
h AS (
  SELECT run, xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, flatten(list_transform(string_split(id || run, ''),
           lambda c: CASE WHEN ord(c) < 128 THEN [ord(c)] ELSE [195, ord(c) - 64] END))),
         lambda a, b: xor(a >> 8, k.crc[1 + (xor(a, b) & 255)]))) AS h
  FROM r, k),
w AS (
  SELECT word, count(*) AS n
  FROM (SELECT CASE WHEN h % 31 = 0 THEN substr(run, 1, (h % length(run))::INT) || substr(run, (h % length(run))::INT + 2)
               ELSE run END AS word FROM h)
  WHERE length(word) >= 7 GROUP BY word HAVING count(*) >= 2),
g AS (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM w),
cut AS (SELECT DISTINCT word, n, substr(word, 1, i - 1) || substr(word, i + 1) AS c FROM g),
gap AS (SELECT word, n, substr(word, 1, i - 1) || '_' || substr(word, i + 1) AS c FROM g),
near AS (
  SELECT a.word, b.word AS near, b.n AS near_n FROM gap a JOIN gap b ON a.c = b.c AND a.word <> b.word
  UNION ALL SELECT a.word, b.word, b.n FROM w a JOIN cut b ON a.word = b.c
  UNION ALL SELECT b.word, a.word, a.n FROM w a JOIN cut b ON a.word = b.c),
best AS (
  SELECT word, count(*) AS n_near, max(near_n) AS top FROM near GROUP BY word),
f AS (
  SELECT w.word, w.n, coalesce(n_near, 0) AS n_near,
         CASE WHEN top >= 10 * w.n THEN (SELECT min(near) FROM near WHERE near.word = w.word AND near_n = top) END AS form,
         CASE WHEN top >= 10 * w.n THEN top END AS form_n
  FROM w LEFT JOIN best USING (word)),
chain AS (
  SELECT word, word AS root, 0 AS steps FROM f
  UNION ALL SELECT chain.word, f.form, steps + 1 FROM chain JOIN f ON f.word = chain.root WHERE f.form IS NOT NULL),
root AS (SELECT word, arg_max(root, steps) AS root FROM chain GROUP BY word)
SELECT word, form, root, n, n_near, form_n FROM f JOIN root USING (word)""".replace("LOWER_TEXT", _LOWER_SQL)

_OP12_SQL = f"""
WITH d AS (
  SELECT doc_id, row_number() OVER () AS no, coalesce(lang, '') AS lang, coalesce(source, '') AS source, {_LOWER_SQL} AS text
  FROM documents),
t AS (
  SELECT no, lang, source, unnest(regexp_extract_all(text, '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) AS term FROM d),
kept AS (SELECT lang, term FROM t GROUP BY lang, term HAVING count(DISTINCT no) >= 10),
g AS (SELECT DISTINCT lang, source FROM d),
c AS (
  SELECT g.lang, g.source, kept.term, count(t.term) AS n
  FROM g JOIN kept USING (lang) LEFT JOIN t ON t.lang = g.lang AND t.source = g.source AND t.term = kept.term
  GROUP BY ALL),
p AS (
  SELECT lang, source, term, n,
         (1 + (1000000000::HUGEINT * (n + 2)) // (sum(n) OVER s + 2 * count(*) OVER s))::HUGEINT AS p,
         (1 + (1000000000::HUGEINT * (sum(n) OVER l + 2)) // (sum(n) OVER (PARTITION BY lang) + 2 * count(*) OVER s))::HUGEINT AS q
  FROM c WINDOW s AS (PARTITION BY lang, source), l AS (PARTITION BY lang, term)),
pair AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item,
         coalesce((SELECT sum(((x.p - y.p) * (x.p - y.p)) // (x.p + y.p)) FROM p x JOIN p y USING (lang, term)
                   WHERE x.lang = a.lang AND x.source = a.source AND y.source = b.source), 0)::BIGINT AS value
  FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source),
term AS (
  SELECT lang, source, 'term' AS part, term AS item, (((p - q) * (p - q)) // (p + q))::BIGINT AS value
  FROM p WHERE n > 0 AND p > q),
r AS (
  SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INTEGER AS rank
  FROM (SELECT * FROM pair UNION ALL SELECT * FROM term))
SELECT lang, source, part, item, value, rank FROM r WHERE part = 'pair' OR rank <= 10"""

QUERIES = {
    "op1_quality": op1_quality,
    "op2_license": op2_license,
    "op3_mixing": op3_mixing,
    "op4_packing": op4_packing,
    "op5_simhash": op5_simhash,
    "op6_chat": op6_chat,
    "op7_exact_dedup": op7_exact_dedup,
    "op8_fingerprint": op8_fingerprint,
    "op9_pii": op9_pii,
    "op10_urls": op10_urls,
    "op11_spelling": op11_spelling,
    "op12_audit": op12_audit,
    "op13_bytebpe": op13_bytebpe,
}

ORACLE = {"op3_mixing": _OP3_SQL, "op7_exact_dedup": _OP7_SQL, "op11_spelling": _OP11_SQL, "op12_audit": _OP12_SQL}
