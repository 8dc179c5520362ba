"""The numbered operators as queries over the given tables, with SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fluxlens.llm import (
    decontamination,
    html_text,
    license_scan,
    mixing,
    near_dup,
    packing,
    periodic_runs,
    prefix_trie,
    quality_rules,
    quality_zstd,
    secrets,
    token_counts,
    toxicity,
)
from fluxlens.llm.tasks import read_table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def op10_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate components of all documents at 0.85."""
    return near_dup.near_duplicates(read_table(spark, sf_dir, "documents"))


def vocabulary() -> str:
    """The public tokenizer file that the token operators use."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark items found in any document."""
    return decontamination.contaminations(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))


def op2_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of all pages."""
    return html_text.extract(read_table(spark, sf_dir, "pages"))


def op3_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates and secrets in all documents."""
    forest = secrets.train(spark, secrets.labelled_findings(), vocabulary())
    return secrets.scan(read_table(spark, sf_dir, "documents"), forest, vocabulary())


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Votes of the quality rules on all documents."""
    return quality_rules.judge(read_table(spark, sf_dir, "documents"))


def op5_quality_compression(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality scores of all documents."""
    documents = read_table(spark, sf_dir, "documents")
    model = quality_zstd.train(documents, read_table(spark, sf_dir, "labels"))
    return quality_zstd.score_quality(documents, model)


#: Documents as files: source/language/hundred/identifier, every fortieth as a licence file, some of them one or two levels up.
_LICENSE_PATH = """CASE WHEN doc_id % 400 = 40 THEN concat(source, '/LICENSE') WHEN doc_id % 200 = 80 THEN concat(source, '/', lang, '/LICENSE.txt')
    WHEN doc_id % 40 = 0 THEN concat(source, '/', lang, '/', {hundred}, '/COPYING')
    ELSE concat(source, '/', lang, '/', {hundred}, '/', CAST(doc_id AS {text}), '.txt') END"""


def op7_license_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Own and inherited licences of all documents, laid out as files."""
    path = F.expr(_LICENSE_PATH.format(hundred="CAST(doc_id DIV 100 AS string)", text="string"))
    return license_scan.scan(read_table(spark, sf_dir, "documents").withColumn("path", path))


def _license_sql() -> str:
    """The same by grouping and joining in SQL."""
    path = _LICENSE_PATH.format(hundred="CAST(doc_id // 100 AS varchar)", text="varchar")
    statements = ", ".join(f"({i}, '{name}', '{text}')" for i, (name, text) in enumerate(license_scan.TEMPLATES))
    cue, legal, file = license_scan.CUE, license_scan.LEGAL, license_scan.LICENSE_FILE
    terms = r"'[a-z0-9]+(\.[a-z0-9]+)*'"
    return f"""
WITH files AS (SELECT doc_id, {path} AS path, text FROM documents),
lines AS (SELECT path, line, regexp_matches(line, '{cue}') AS cue FROM
    (SELECT path, unnest(string_split(text, chr(10))) AS line FROM files WHERE regexp_matches(text, '{cue}')) WHERE regexp_matches(line, '{legal}')),
line_terms AS (SELECT path, cue, md5(line) AS unit, unnest(regexp_extract_all(lower(line), {terms})) AS term FROM lines),
counts AS (SELECT path, unit, term, count(*) AS tf FROM (SELECT path, unit, term FROM line_terms WHERE cue
    UNION ALL SELECT path, 'cues', term FROM line_terms WHERE cue UNION ALL SELECT path, 'legal', term FROM line_terms) GROUP BY ALL),
template AS (SELECT number, license, term, count(*) AS tf FROM
    (SELECT number, license, unnest(regexp_extract_all(lower(text), {terms})) AS term FROM (VALUES {statements}) AS t(number, license, text)) GROUP BY ALL),
units AS (SELECT count(*) AS n FROM (SELECT DISTINCT path, unit FROM counts)),
idf AS (SELECT term, 1 + ln(CAST(n AS DOUBLE) / df) AS idf FROM (SELECT term, count(*) AS df FROM counts GROUP BY term), units),
weighted AS (SELECT number, license, t.term, tf * coalesce(idf, (SELECT max(idf) FROM idf), 1.0) AS w FROM template t LEFT JOIN idf ON t.term = idf.term),
norms AS (SELECT number, sqrt(sum(w * w)) AS norm FROM weighted GROUP BY number),
own_terms AS (SELECT path, unit, term, tf * idf AS w FROM counts JOIN idf USING (term)),
lengths AS (SELECT path, unit, sqrt(sum(w * w)) AS norm FROM own_terms GROUP BY ALL),
scores AS (SELECT o.path, o.unit, t.number, t.license, round(sum(o.w * t.w / k.norm) / any_value(l.norm), 6) AS score
    FROM own_terms o JOIN weighted t USING (term) JOIN norms k USING (number) JOIN lengths l ON l.path = o.path AND l.unit = o.unit GROUP BY ALL),
own AS (SELECT path, license, score FROM scores WHERE score >= {license_scan.THRESHOLD}
    QUALIFY row_number() OVER (PARTITION BY path ORDER BY score DESC, license) = 1),
holders AS (SELECT regexp_replace(path, '/?[^/]*$', '') AS above, license, score FROM own WHERE regexp_matches(regexp_extract(path, '[^/]*$'), '{file}')),
offered AS (SELECT above, license FROM holders QUALIFY row_number() OVER (PARTITION BY above ORDER BY score DESC, license) = 1),
placed AS (SELECT doc_id, path, regexp_replace(path, '/?[^/]*$', '') AS directory FROM files),
nearest AS (SELECT d.directory, o.license AS inherited_license, o.above AS inherited_from
    FROM (SELECT DISTINCT directory FROM placed) d JOIN offered o ON d.directory = o.above OR o.above = '' OR starts_with(d.directory, o.above || '/')
    QUALIFY row_number() OVER (PARTITION BY d.directory ORDER BY length(o.above) DESC) = 1)
SELECT doc_id, p.path, o.license AS own_license, o.score AS own_score, inherited_license, inherited_from, coalesce(o.license, inherited_license) AS license
FROM placed p LEFT JOIN own o ON o.path = p.path LEFT JOIN nearest n ON n.directory = p.directory""".strip()


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Severity of all documents."""
    documents = read_table(spark, sf_dir, "documents")
    return toxicity.rate(documents, toxicity.train(documents, read_table(spark, sf_dir, "labels")))


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token counts of all documents."""
    return token_counts.count_tokens(read_table(spark, sf_dir, "documents"), vocabulary())


def op9_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in sequences of at most 2048 tokens."""
    return packing.pack(read_table(spark, sf_dir, "documents"), vocabulary())


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Periodic runs of all documents, each tenth document made periodic first."""
    return periodic_runs.periodic_runs(read_table(spark, sf_dir, "documents"), rewrite=True)


def op12_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often a mix of all sources takes each document."""
    return mixing.planned_copies(read_table(spark, sf_dir, "documents"))


#: The same by window functions over whole tables.
_MIXING_SQL = r"""
WITH sized AS (SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^ 	-
]+')), 0) AS BIGINT) AS size FROM documents),
totals AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM sized GROUP BY source),
weighed AS (SELECT *, CAST([3, 1, 2][(place - 1) % 3 + 1] AS BIGINT) AS weight, 2 * source_size AS most
    FROM (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) AS place FROM totals)),
levels AS (SELECT *, CAST(most AS DOUBLE) / weight AS full_at FROM weighed),
filled AS (SELECT full_at, place,
        CAST(150 * (sum(source_size) OVER ()) - 100 * (sum(most) OVER upto - most) AS DOUBLE)
            / CAST(100 * (sum(weight) OVER () - sum(weight) OVER upto + weight) AS DOUBLE) AS level
    FROM levels WINDOW upto AS (ORDER BY full_at, place ROWS UNBOUNDED PRECEDING)),
found AS (SELECT level FROM filled WHERE full_at >= level ORDER BY full_at, place LIMIT 1),
targets AS (SELECT source, source_size, CASE WHEN full_at <= level THEN CAST(most AS DOUBLE) ELSE level * weight END AS target FROM levels, found),
steps AS (SELECT *,
        CASE WHEN source_size > 0 THEN CAST(floor(target / source_size * 1099511627776.0) AS HUGEINT) ELSE 0 END AS step,
        CAST('0x' || substr(md5('1:' || CASE WHEN source IS NULL THEN 'true' ELSE 'false' END || ':' || coalesce(source, '')), 1, 10) AS HUGEINT) AS shift
    FROM targets),
walked AS (SELECT s.doc_id, s.size, t.source_size, t.target, t.step,
        sum(t.step) OVER (PARTITION BY s.source ORDER BY s.size, s.doc_id NULLS FIRST ROWS UNBOUNDED PRECEDING) + t.shift AS reached
    FROM sized s JOIN steps t ON s.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target, CAST(reached // 1099511627776 - (reached - step) // 1099511627776 AS BIGINT) AS copies,
    CAST(reached // 1099511627776 - (reached - step) // 1099511627776 AS BIGINT) * size AS taken
FROM walked""".strip()


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The prefix trie of all conversations, rebuilt to share openings."""
    return prefix_trie.conversation_trie(read_table(spark, sf_dir, "conversations"), rebuild=True)


#: The same with a prefix's text as its name: subtrees are the nodes whose name starts with it. CRC-32 is spelled out bit by bit.
_TRIE_SQL = r"""
WITH turns AS (SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
        row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS place
    FROM conversations WHERE conv_id IS NOT NULL),
hashed AS (SELECT conv_id, conv_id - conv_id % 20 AS base, xor(4294967295, list_reduce(
        list_prepend(CAST(4294967295 AS BIGINT), list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda c: CAST(ascii(c) AS BIGINT))),
        lambda sum, byte: list_reduce(list_prepend(xor(sum, byte), range(8)), lambda x, k: xor(x >> 1, 3988292384 * (x & 1))))) % 4 AS borrowed
    FROM (SELECT DISTINCT conv_id FROM turns)),
rebuilt AS (
    SELECT h.conv_id, place, role, text FROM hashed h JOIN turns t ON t.conv_id = h.base AND place <= borrowed
    UNION ALL SELECT conv_id, place + 1000000, role, text FROM hashed JOIN turns USING (conv_id) WHERE place > borrowed),
prefixes AS (
    SELECT conv_id, row_number() OVER w AS depth, string_agg(md5(length(role) || ':' || role || text), '') OVER w AS path,
        len(regexp_extract_all(text, '[^ 	-
]+')) AS n_words
    FROM rebuilt WINDOW w AS (PARTITION BY conv_id ORDER BY place ROWS UNBOUNDED PRECEDING)
    UNION ALL SELECT conv_id, 0, '', 0 FROM hashed),
nodes AS (SELECT path, depth, min(conv_id) AS conv_id, count(*) AS n_convs, min(n_words) AS n_words FROM prefixes GROUP BY path, depth),
families AS (SELECT p.path, count(*) AS n_children FROM nodes p JOIN nodes c ON c.depth = p.depth + 1 AND starts_with(c.path, p.path) GROUP BY p.path),
sums AS (SELECT p.path, sum(CASE WHEN f.path IS NULL THEN 1 ELSE 0 END) AS n_leaves, sum((c.n_convs - 1) * c.n_words) AS saved_tokens
    FROM nodes p JOIN nodes c ON starts_with(c.path, p.path) LEFT JOIN families f ON f.path = c.path GROUP BY p.path),
ends AS (SELECT path, string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) AS ids
    FROM (SELECT conv_id, arg_max(path, depth) AS path FROM prefixes GROUP BY conv_id) GROUP BY path)
SELECT n.conv_id, CAST(n.depth AS BIGINT) AS depth, p.conv_id AS parent_conv_id, n.n_convs, coalesce(f.n_children, 0) AS n_children,
    CAST(s.n_leaves AS BIGINT) AS n_leaves, CAST(s.saved_tokens AS BIGINT) AS saved_tokens, sha256(coalesce(e.ids, '')) AS ends_sha256
FROM nodes n JOIN sums s ON s.path = n.path LEFT JOIN families f ON f.path = n.path LEFT JOIN ends e ON e.path = n.path
    LEFT JOIN nodes p ON n.depth > 0 AND p.path = left(n.path, length(n.path) - 32)""".strip()

QUERIES["op1_decontamination"] = op1_decontamination
QUERIES["op2_html_extraction"] = op2_html_extraction
QUERIES["op3_secret_scans"] = op3_secret_scans
QUERIES["op4_quality_rules"] = op4_quality_rules
QUERIES["op5_quality_compression"] = op5_quality_compression
QUERIES["op7_license_scans"] = op7_license_scans
ORACLE["op7_license_scans"] = _license_sql()
QUERIES["op8_toxicity"] = op8_toxicity
QUERIES["op6_token_counts"] = op6_token_counts
QUERIES["op9_best_fit_packing"] = op9_best_fit_packing
QUERIES["op10_minhash_near_dedup"] = op10_minhash_near_dedup
QUERIES["op11_periodic_runs"] = op11_periodic_runs
QUERIES["op12_source_mixing"] = op12_source_mixing
ORACLE["op12_source_mixing"] = _MIXING_SQL
QUERIES["op13_prefix_trie"] = op13_prefix_trie
ORACLE["op13_prefix_trie"] = _TRIE_SQL
