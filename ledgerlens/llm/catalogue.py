"""Queries of this subpackage, one for each operator, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ledgerlens.llm.divergence import source_divergence
from ledgerlens.llm.exact_dedup import exact_dedup
from ledgerlens.llm.html_text import main_text
from ledgerlens.llm.line_dedup import line_report
from ledgerlens.llm.media import media_report
from ledgerlens.llm.mixing import mix_report
from ledgerlens.llm.packing import pack
from ledgerlens.llm.pattern_packing import pattern_pack
from ledgerlens.llm.secrets import secrets_report
from ledgerlens.llm.simhash import near_duplicates
from ledgerlens.llm.spelling import spelling_variants
from ledgerlens.llm.toxicity import fit_toxicity, score_toxicity
from ledgerlens.llm.url_filter import url_filter


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    return score_toxicity(documents, fit_toxicity(documents, table(spark, sf_dir, "labels")))


def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(table(spark, sf_dir, "documents"), keep="largest")


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), words=4, radius=4, width=1, blocks="auto")


def op5_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets_report(table(spark, sf_dir, "documents"))


def op6_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return main_text(table(spark, sf_dir, "pages"))


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))


def op8_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter(table(spark, sf_dir, "pages")).select("page_id", "host", "path", "rule", "verdict")


def op9_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media_report(table(spark, sf_dir, "documents"))


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_report(table(spark, sf_dir, "documents"))


def op11_pattern_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pattern_pack(table(spark, sf_dir, "documents"))


def op12_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling_variants(table(spark, sf_dir, "documents"))


def op13_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source_divergence(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (op1_mixing, op2_toxicity, op3_exact_dedup, op4_simhash, op5_secrets, op6_html_text, op7_packing, op8_url_filter, op9_media, op10_line_dedup, op11_pattern_packing, op12_spelling, op13_divergence)
}

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

ORACLE_SQL: dict[str, str] = {
    "op3_exact_dedup": f"""
        WITH d AS (SELECT doc_id, {_LOWER} AS t FROM documents),
             g AS (SELECT t, max(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY t)
        SELECT d.doc_id, g.keep_id, g.group_size, d.doc_id = g.keep_id AS kept, sha256(d.t) AS text_sha256
        FROM d JOIN g ON d.t = g.t""",
    "op12_spelling": """
        WITH RECURSIVE bits AS (SELECT i, i AS c, 0 AS step FROM range(256) r(i)
                UNION ALL SELECT i, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, step + 1 FROM bits WHERE step < 8),
             crc AS MATERIALIZED (SELECT list(c ORDER BY i) AS t FROM bits WHERE step = 8),
             runs AS (SELECT doc_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z\u00C0-\u00FF]+')) AS run FROM documents),
             found AS MATERIALIZED (SELECT run, count(*) AS n, length(run) AS size,
                    list_transform(string_split(concat(doc_id, ':', run), ''), lambda x: unicode(x)) AS codes FROM runs GROUP BY doc_id, run),
             hashed AS (SELECT run, n, size, xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, flatten(list_transform(codes, lambda x: CASE WHEN x < 128 THEN [x::BIGINT] ELSE [195::BIGINT, x - 64] END))),
                    lambda a, b: xor(a >> 8, t[(xor(a, b) & 255) + 1]))) AS h FROM found, crc),
             words AS (SELECT CASE WHEN h % 199 = 0 THEN concat(run[:h % size], run[h % size + 2:]) ELSE run END AS word, n FROM hashed),
             v AS MATERIALIZED (SELECT word, sum(n)::BIGINT AS n FROM words WHERE length(word) >= 6 GROUP BY word HAVING sum(n) >= 5),
             holes AS MATERIALIZED (SELECT word, n, concat(word[:i - 1], '*', word[i + 1:]) AS hole, concat(word[:i - 1], word[i + 1:]) AS cut FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM v)),
             cuts AS (SELECT DISTINCT word, n, cut FROM holes),
             near AS (SELECT a.word, b.word AS other, b.n AS m FROM holes a JOIN holes b USING (hole) WHERE a.word <> b.word
                UNION ALL SELECT c.word, v.word, v.n FROM cuts c JOIN v ON v.word = c.cut
                UNION ALL SELECT v.word, c.word, c.n FROM cuts c JOIN v ON v.word = c.cut),
             best AS (SELECT word, count(*) AS n_near, arg_min(other, (-m, other)) AS other, max(m) AS m FROM near GROUP BY word),
             f AS MATERIALIZED (SELECT v.word, v.n, coalesce(n_near, 0)::BIGINT AS n_near, CASE WHEN m >= 5 * v.n THEN other END AS form, CASE WHEN m >= 5 * v.n THEN m END AS form_n FROM v LEFT JOIN best USING (word)),
             chain AS (SELECT word, word AS root, 0 AS depth FROM f UNION ALL SELECT c.word, f.form, depth + 1 FROM chain c JOIN f ON f.word = c.root WHERE f.form IS NOT NULL)
        SELECT f.word, form, r.root, n, n_near, form_n FROM f JOIN (SELECT word, arg_max(root, depth) AS root FROM chain GROUP BY word) r ON r.word = f.word""",
    "op13_divergence": """
        WITH d AS (SELECT row_number() OVER () AS row, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
                    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
             terms AS (SELECT row, lang, source, unnest(regexp_extract_all(t, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
             docs AS MATERIALIZED (SELECT row, lang, source, term, count(*) AS n FROM terms GROUP BY ALL),
             kept AS MATERIALIZED (SELECT lang, term, sum(n) AS lang_n FROM docs GROUP BY lang, term HAVING count(*) >= 10),
             groups AS (SELECT DISTINCT lang, source FROM d),
             v AS (SELECT lang, count(*) AS v, sum(lang_n) AS lang_total FROM kept GROUP BY lang),
             c AS MATERIALIZED (SELECT g.lang, g.source, k.term, lang_n, coalesce(n, 0) AS n FROM groups g JOIN kept k USING (lang)
                    LEFT JOIN (SELECT lang, source, term, sum(n) AS n FROM docs GROUP BY ALL) s USING (lang, source, term)),
             totals AS (SELECT lang, source, sum(n) AS total FROM c GROUP BY lang, source),
             p AS MATERIALIZED (SELECT c.lang, c.source, c.term, c.n, (1 + 1000000000 * (n + 2)::HUGEINT // (total + 2 * v)::HUGEINT)::BIGINT AS p,
                    (1 + 1000000000 * (lang_n + 2)::HUGEINT // (lang_total + 2 * v)::HUGEINT)::BIGINT AS q FROM c JOIN totals USING (lang, source) JOIN v USING (lang)),
             pairs AS (SELECT a.lang, a.source, b.source AS item FROM groups a JOIN groups b USING (lang) WHERE a.source <> b.source),
             sums AS (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // (a.p + b.p)) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term WHERE a.source <> b.source GROUP BY ALL),
             parts AS (SELECT lang, source, 'pair' AS part, item, coalesce(value, 0)::BIGINT AS value FROM pairs LEFT JOIN sums USING (lang, source, item)
                UNION ALL SELECT lang, source, 'term', term, ((p - q) * (p - q) // (p + q))::BIGINT FROM p WHERE n > 0 AND p > q),
             ranked AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INT AS rank FROM parts)
        SELECT lang, source, part, item, value, rank FROM ranked WHERE part = 'pair' OR rank <= 10""",
}
