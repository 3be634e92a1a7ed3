"""The queries of the text operators over whole tables, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from . import bpe, cotraining, decontaminate, html_text, jaccard_join, language_id, license_scan, pii, quality_rules, sharding

VOCABULARY = "byte_bpe_50k.tiktoken"


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def vocabulary(path: str | None = None) -> bytes:
    """The content of a vocabulary file: by default the public 50k byte-level one, where it is installed."""
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path(VOCABULARY)
    with open(path, "rb") as f:
        return f.read()


def pattern() -> str:
    import public_tokenizers

    return public_tokenizers.PATTERN


def op1_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.jaccard_components(read(spark, sf_dir, "documents"))


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    out = language_id.held_out(F.col("doc_id"))
    return language_id.predict(docs.withColumn("held_out", out), language_id.fit(docs, ~out), "held_out")


def op3_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(read(spark, sf_dir, "documents"), 24)


def op4_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    return cotraining.score(docs, cotraining.fit(docs, read(spark, sf_dir, "labels")))


def op5_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = license_scan.scan(read(spark, sf_dir, "documents"))
    return found.withColumn("line_licences", F.array_join("line_licences", ","))


def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find(read(spark, sf_dir, "documents"))


def op7_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def op8_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(read(spark, sf_dir, "pages"))


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    cols = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "fail_bits"]
    return quality_rules.apply_policy(quality_rules.ledger(read(spark, sf_dir, "documents"))).select(*cols)


def op10_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = bpe.token_rows(read(spark, sf_dir, "documents"), vocabulary(), pattern(), digests_only=True)
    return rows.select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    named = (op1_ngram_jaccard_join, op2_language_id, op3_sharding, op4_quality_classifier, op5_license_scan, op6_pii, op7_benchmark_decontamination, op8_html_extraction, op9_quality_rules, op10_byte_bpe, pipeline)
    return {f.__name__: f for f in named}


_SPACE = r"[\x20\x09-\x0D]"
_RULES_SQL = rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, row_number() OVER () AS rid FROM documents),
w AS (SELECT rid, t, list_filter(regexp_split_to_array(t, '{_SPACE}+'), lambda x: x <> '') AS w,
  list_filter(string_split(t, chr(10)), lambda x: length(regexp_replace(x, '{_SPACE}', '', 'g')) > 0) AS l FROM d),
g AS (SELECT rid, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] || ' ' || w[i + 3] || ' ' || w[i + 4] AS s
  FROM (SELECT rid, w, unnest(range(1, len(w) - 3)) AS i FROM w)),
r AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, s) AS c FROM g) WHERE c >= 2),
c AS (SELECT rid, count(DISTINCT i + k) AS n FROM r, (SELECT unnest(range(0, 5)) AS k) GROUP BY rid),
m AS (SELECT doc_id, len(w)::BIGINT AS n_words, length(regexp_replace(d.t, '{_SPACE}', '', 'g'))::BIGINT AS word_chars,
  length(regexp_replace(d.t, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
  (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines, coalesce(n, 0)::BIGINT AS n_repeat_words,
  len(l)::BIGINT AS n_lines, length(regexp_replace(d.t, '[^A-Z]', '', 'g'))::BIGINT AS n_upper
  FROM d JOIN w USING (rid) LEFT JOIN c USING (rid)),
b AS (SELECT *, (n_words < 10)::BIGINT AS f0, (100 * n_repeat_words > 20 * n_words)::BIGINT AS f1,
  (100 * n_symbols > 20 * n_words)::BIGINT AS f2, (100 * n_dup_lines > 40 * n_lines)::BIGINT AS f3,
  (100 * n_upper > 40 * word_chars)::BIGINT AS f4,
  (word_chars < 2 * n_words OR word_chars > 20 * n_words)::BIGINT AS f5 FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, f0 + f1 > 0 AS base_failed,
  f0 + f1 + f2 + f3 + f4 = 0 AS kept, f0 + 2 * f1 + 4 * f2 + 8 * f3 + 16 * f4 + 32 * f5 AS fail_bits FROM b
"""


_JOIN_SQL = rf"""
WITH RECURSIVE
w AS (SELECT row_number() OVER () AS rid, doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{_SPACE}+'), lambda x: x <> '') AS w FROM documents),
e AS (SELECT DISTINCT rid, CASE WHEN len(w) < 5 THEN array_to_string(w, ' ') ELSE w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] || ' ' || w[i + 3] || ' ' || w[i + 4] END AS x
  FROM (SELECT rid, w, unnest(range(1, greatest(len(w) - 3, 2))) AS i FROM w WHERE len(w) > 0)),
h AS (SELECT rid, list(x ORDER BY x) AS s FROM e GROUP BY rid),
g AS (SELECT doc_id, coalesce(s, []) AS s FROM w LEFT JOIN h USING (rid)),
c AS (SELECT s, min(doc_id) AS rep, len(s) AS n FROM g WHERE doc_id IS NOT NULL AND len(s) > 0 GROUP BY s),
u AS (SELECT rep, n, unnest(s) AS x FROM c),
l AS (SELECT a.rep AS a, b.rep AS b FROM u a JOIN u b ON a.x = b.x AND a.rep <> b.rep
  GROUP BY a.rep, a.n, b.rep, b.n HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))),
r AS (SELECT rep AS node, rep AS root FROM c UNION SELECT l.b, r.root FROM r JOIN l ON l.a = r.node),
k AS (SELECT node, min(root) AS root FROM r GROUP BY node)
SELECT g.doc_id, len(g.s)::BIGINT AS n_shingles, CASE WHEN g.doc_id IS NOT NULL THEN coalesce(k.root, g.doc_id) END AS component_id
FROM g LEFT JOIN c USING (s) LEFT JOIN k ON k.node = c.rep
"""


def _canonical_sql(text: str) -> str:
    """license_scan.canonical in SQL. Its lookahead is a captured digit here, as the other engine has none."""
    t = f"lower(regexp_replace({text}, '{license_scan.COPYRIGHT}', '', 'g'))"
    for pattern, one in license_scan.SPELLINGS:
        pattern, one = pattern.replace("(?=[0-9])", "([0-9])"), one + ("\\3" if "(?=" in pattern else "")
        t = f"regexp_replace({t}, '{pattern}', '{one}', 'g')"
    return f"trim(regexp_replace({t}, '[^\\p{{L}}\\p{{N}}]+', ' ', 'g'))"


def _license_sql() -> str:
    quoted = lambda s: "'" + s.replace("'", "''") + "'"
    known = ", ".join(f"({quoted(n)}, {quoted(t)})" for n, t in license_scan.KNOWN)
    return f"""
WITH k AS (SELECT DISTINCT sha256({_canonical_sql("body")}) AS digest, licence FROM (VALUES {known}) AS v(licence, body)),
d AS (SELECT doc_id, text, row_number() OVER () AS rid FROM documents),
n AS (SELECT rid, unnest(list_filter(string_split(text, chr(10)), lambda x: trim(x) <> '')) AS line FROM d),
h AS (SELECT rid, string_agg(DISTINCT licence, ',' ORDER BY licence) AS found
  FROM (SELECT rid, sha256({_canonical_sql("line")}) AS digest FROM n) JOIN k USING (digest) GROUP BY rid),
e AS (SELECT rid, doc_id, sha256({_canonical_sql("text")}) AS digest FROM d)
SELECT e.doc_id, e.digest, k.licence, coalesce(h.found, '') AS line_licences FROM e LEFT JOIN k USING (digest) LEFT JOIN h USING (rid)
"""


def _spans_sql(kind: str, text: str, pattern: str, good: str = "TRUE", cut: str = "") -> str:
    """rid and the list of spans (a, m) of a pattern's leftmost matches, in the other engine's own words: each match is marked by
    two private characters, and the pieces between the marks are measured. pattern: (what goes before)(the span)."""
    own = cut or "split_part(q[k + 1], y, 1)"
    return rf"""SELECT rid, list_filter(list_transform(range(1, len(q)), lambda k: {{'a': length(q[1]) + CAST(coalesce(list_sum(list_transform(q[2:k], lambda z: length(z) - 1)), 0) AS BIGINT), 'm': {own}}}),
  lambda v: {good}) AS f, '{kind}' AS kind FROM (SELECT rid, y, string_split(regexp_replace({text}, '{pattern}', '\1' || x || '\2' || y, 'g'), x) AS q FROM d)"""


def _pii_sql() -> str:
    digits = "regexp_replace(v.m, '[^0-9]', '', 'g')"
    n = f"length({digits})"
    digit = f"CAST({digits}[i] AS INTEGER)"
    luhn = f"list_sum(list_transform(range(1, {n} + 1), lambda i: CASE WHEN ({n} - i) % 2 = 0 THEN {digit} WHEN {digit} > 4 THEN {digit} * 2 - 9 ELSE {digit} * 2 END)) % 10 = 0"
    kinds = [
        _spans_sql("email", "t", r"()([A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+)"),
        _spans_sql("ip", "t", r"()([0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+))", "len(list_filter(string_split(v.m, '.'), lambda p: length(ltrim(p, '0')) > 3 OR CAST(right(p, 9) AS INTEGER) > 255)) = 0"),
        _spans_sql("card", "t", r"()([0-9](?:[\x20-]?[0-9])+)", f"{n} BETWEEN 13 AND 19 AND {luhn}"),
        _spans_sql("phone", "t", r"()(\+[0-9][\x20().0-9-]+[0-9])", f"{n} BETWEEN 9 AND 15"),
        _spans_sql("url", "w", r"""()((?:https?://|ftp://|www\.)[^\x09-\x0D\x20\x{00a0}\x{3000}<>"''|]+)""", cut=r"regexp_replace(split_part(q[k + 1], y, 1), '[.,;:!?)\]}]+$', '')"),
        _spans_sql("account", "w", r"((?:iban|account|acct|passport|ssn)\b[ \t]*(?:no\.?|number|id|nr\.?)?[ \t]*[:=#]?[ \t]*)([a-z]{0,2}[0-9][a-z0-9-]{4,33})\b"),
        _spans_sql("secret", "w", r"""((?:token|api[_-]?key|secret|password|passwd)["'']?[ \t]*[:=][ \t]*["'']?)([a-z0-9_\-+/=.]{12,})"""),
    ]
    counts = ", ".join(f"CAST(coalesce(sum(len(f)) FILTER (WHERE kind = '{k}'), 0) AS BIGINT) AS n_{k}" for k in pii.KINDS)
    order = "CASE kind " + " ".join(f"WHEN '{k}' THEN {i}" for i, k in enumerate(pii.KINDS)) + " END"
    each = "array_to_string(list_transform(f, lambda v: kind || ':' || CAST(v.a AS VARCHAR) || ':' || CAST(v.a + length(v.m) AS VARCHAR)), ',')"
    joined = lambda most: f"coalesce(string_agg({each}, ',' ORDER BY {order}) FILTER (WHERE len(f) > 0 AND {order} < {most}), '')"
    return f"""
WITH s AS (SELECT row_number() OVER () AS rid, doc_id, chr(57344) AS x, chr(57345) AS y, coalesce(text, '') AS t0 FROM documents),
d AS (SELECT rid, doc_id, x, y, translate(t0, x || y, '??') AS t, translate(t0, x || y || 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', '??abcdefghijklmnopqrstuvwxyz') AS w FROM s),
k AS ({" UNION ALL ".join(kinds)}),
g AS (SELECT rid, {counts}, sha256({joined(len(pii.BASE))}) AS base_sha256, {joined(len(pii.KINDS))} AS spans FROM k GROUP BY rid)
SELECT doc_id, {", ".join(f"n_{k}" for k in pii.KINDS)}, base_sha256, spans FROM d JOIN g USING (rid)
"""


def oracle_sql() -> dict[str, str]:
    return {"op6_pii": _pii_sql(), "op1_ngram_jaccard_join": _JOIN_SQL, "op5_license_scan": _license_sql(), "op9_quality_rules": _RULES_SQL}
