"""The queries of this subpackage, with production parameters, each over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, decontamination, lines, media, quality, sharding, simhash, substring, toxicity, url_rules
from .common import table, tune

#: (verdict, host, path)
URL_RULES = [
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
]
SHARDS = 40
TOXIC_FROM = 0.3


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op1_avi_shots(spark: SparkSession, sf_dir: str) -> DataFrame:
    tune(spark)
    seen = media.look(media.store(table(spark, sf_dir, "documents")))
    clip = F.transform("clips", lambda c: F.concat_ws("+", c["first"].cast("string"), c["frames"].cast("string"), c["level"].cast("string")))
    return seen.select(
        "doc_id",
        "n_bytes",
        F.length("samples").cast("long").alias("payload_bytes"),
        F.sha2("samples", 256).alias("payload_sha256"),
        F.crc32(F.expr("substring(samples, length(samples) - 31, 32)")).alias("tail_crc32"),
        F.length("media").cast("long").alias("media_bytes"),
        F.sha2("media", 256).alias("media_sha256"),
        F.concat_ws(" ", F.size("clips").cast("string"), clip).alias("feature"),
    )


def op2_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = table(spark, sf_dir, "labels")
    bad = (F.coalesce("toxic", F.lit(0)) == 1) | (F.coalesce("quality", F.lit(1)) == 0)
    return url_rules.judge(table(spark, sf_dir, "pages"), labels.select(F.col("doc_id").alias("page_id"), bad.alias("blocked")), URL_RULES)


def op3_repeated_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    tune(spark)
    out = substring.deduplicate(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def op4_fuzzy_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    tune(spark)
    return lines.deduplicate(table(spark, sf_dir, "documents").select("doc_id", "text", "n_chars")).select("doc_id", "n_chars", F.sha2("text", 256).alias("text_sha256"))


def op5_simhash_ball(spark: SparkSession, sf_dir: str) -> DataFrame:
    tune(spark)
    near = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return near.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    tune(spark)
    docs = table(spark, sf_dir, "documents")
    held_out = F.crc32(F.col("doc_id").cast("string")) % 4 == 2
    labels = table(spark, sf_dir, "labels").select("doc_id", "toxic").filter(~held_out)
    scored = toxicity.score(docs, *toxicity.fit(docs, labels))
    return scored.select("doc_id", F.coalesce(held_out, F.lit(False)).alias("held_out"), "score", (F.col("score") >= TOXIC_FROM).cast("int").alias("predicted"))


def op7_bpe_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    tune(spark)
    coded = bpe.encode(table(spark, sf_dir, "documents"), tokenizer_path())
    return coded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op8_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    tune(spark)
    judged = decontamination.judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return judged.select("doc_id", (F.col("n_items") > 0).cast("int").alias("contaminated"), "n_items", "item_id", "found", "changed")


def op9_lpt_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.assign(table(spark, sf_dir, "documents"), SHARDS)


def op10_kneser_ney(spark: SparkSession, sf_dir: str) -> DataFrame:
    tune(spark)
    trusted = table(spark, sf_dir, "labels").filter("quality = 1").select("doc_id").distinct()
    judged = quality.classify(table(spark, sf_dir, "documents"), trusted)
    return judged.select("doc_id", "lang", F.exp("log_perplexity").alias("perplexity"), F.exp("limit").alias("threshold"), F.col("keep").cast("int").alias("keep"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_avi_shots": op1_avi_shots,
        "op2_url_rules": op2_url_rules,
        "op3_repeated_windows": op3_repeated_windows,
        "op4_fuzzy_lines": op4_fuzzy_lines,
        "op5_simhash_ball": op5_simhash_ball,
        "op6_toxicity": op6_toxicity,
        "op7_bpe_roundtrip": op7_bpe_roundtrip,
        "op8_templates": op8_templates,
        "op9_lpt_shards": op9_lpt_shards,
        "op10_kneser_ney": op10_kneser_ney,
    }


#: All item combinations of labelled pages counted by brute force, for the rules that FP-growth finds.
_URL_SQL = r"""WITH p AS (SELECT page_id, url AS u, CASE WHEN contains(url, '://') THEN substr(url, instr(url, '://') + 3) END AS rest FROM pages),
  h AS (SELECT page_id, u, coalesce(translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
    coalesce(regexp_extract(rest, '^[^/?#]*([^?#]*)', 1), '') AS path FROM p),
  rules(rule, verdict, rhost, rpath) AS (VALUES ('org/', 'allow', 'org', '/'), ('example.org/es/', 'block', 'example.org', '/es/'), ('example.org/en/1', 'block', 'example.org', '/en/1'),
    ('com/fr/', 'allow', 'com', '/fr/'), ('com/de/', 'block', 'com', '/de/')),
  hit AS (SELECT page_id, arg_max(rule, length(rule)) AS rule, arg_max(verdict, length(rule)) AS listed FROM h JOIN rules ON (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath) GROUP BY page_id),
  raw AS (SELECT page_id, unnest(list_transform(string_split(host, '.'), lambda x: 'h:' || x) || list_transform(string_split(path, '/'), lambda x: 'p:' || regexp_replace(x, '[0-9]+', '#', 'g'))
    || list_transform(string_split(coalesce(regexp_extract(u, '\?([^#]*)', 1), ''), '&'), lambda x: 'q:' || string_split(x, '=')[1])) AS item FROM h),
  items AS (SELECT DISTINCT page_id, item FROM raw WHERE length(item) > 2),
  marks AS (SELECT doc_id AS page_id, max(coalesce(toxic, 0) = 1 OR coalesce(quality, 1) = 0) AS bad FROM labels GROUP BY doc_id),
  labelled AS (SELECT h.page_id, bad FROM h JOIN marks USING (page_id)),
  least AS (SELECT greatest(5, ceil(count(*) * 0.0005 - 1e-9)) AS n, count(*) AS every FROM labelled),
  often AS (SELECT item, list(page_id ORDER BY page_id) AS pages FROM items JOIN labelled USING (page_id) GROUP BY item HAVING sum(bad::INT) >= (SELECT n FROM least)),
  twins AS (SELECT item, min(item) OVER (PARTITION BY pages) AS head FROM often),
  basket AS (SELECT page_id, any_value(bad) AS bad, list(item ORDER BY item) AS l FROM items JOIN labelled USING (page_id) JOIN twins USING (item) WHERE item = head GROUP BY page_id),
  subsets AS (SELECT page_id, bad, l, unnest(range(1, 1 << len(l))) AS m FROM basket),
  sets AS (SELECT page_id, bad, list_filter(l, lambda x, i: (m >> (i - 1)) & 1 = 1) AS s FROM subsets),
  mined AS (SELECT s, sum(bad::INT) / count(*) AS confidence, sum(bad::INT) / (SELECT every FROM least) AS support FROM sets GROUP BY s
    HAVING sum(bad::INT) >= (SELECT n FROM least) AND sum(bad::INT) >= 0.5 * count(*)),
  have AS (SELECT page_id, list(DISTINCT head) AS l FROM items JOIN twins USING (item) GROUP BY page_id),
  best AS (SELECT page_id, arg_max(array_to_string(s, ' '), {'c': confidence, 's': support, 't': array_to_string(s, ' ')}) AS mined, max(confidence) AS confidence FROM have JOIN mined ON list_has_all(l, s) GROUP BY page_id)
  SELECT h.page_id, host, path, rule, coalesce(listed, CASE WHEN mined IS NOT NULL THEN 'block' END, 'allow') AS verdict, CASE WHEN rule IS NULL THEN mined END AS mined, CASE WHEN rule IS NULL THEN confidence END AS confidence
  FROM h LEFT JOIN hit USING (page_id) LEFT JOIN best USING (page_id)"""

_WINDOW_SQL = r"""WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
  win AS (SELECT doc_id, i, array_to_string(ws[i:i + 12], ' ') AS k FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 11)) AS i FROM w)),
  first AS (SELECT k, min(doc_id) AS doc FROM win GROUP BY k),
  gone AS (SELECT DISTINCT doc_id, i + j AS i FROM win JOIN first USING (k), range(0, 13) t(j) WHERE doc < doc_id),
  word AS (SELECT doc_id, unnest(ws) AS word, unnest(range(1, len(ws) + 1)) AS i FROM w),
  kept AS (SELECT doc_id, string_agg(word, ' ' ORDER BY i) AS text, count(*) AS n FROM word ANTI JOIN gone USING (doc_id, i) GROUP BY doc_id)
  SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(len(ws) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept.text, '')) AS kept_sha256 FROM w LEFT JOIN kept USING (doc_id)"""


def oracle_sql() -> dict[str, str]:
    """The others train models, hash with XXH64, fold a heap or merge byte pairs; tests/llm has brute force for them."""
    return {"op2_url_rules": _URL_SQL, "op3_repeated_windows": _WINDOW_SQL}
