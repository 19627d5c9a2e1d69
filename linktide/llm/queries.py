"""The registered queries of the text operators, and their SQL where there is one."""

from __future__ import annotations

import string
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from linktide.llm import (
    exact,
    html_text,
    merkle,
    mixing,
    ordinal,
    packing,
    quality_rules,
    quantised,
    ranked,
    sharding,
    simhash,
    suffix,
    url_filter,
)
from linktide.llm.common import table, text_of, word_count
from linktide.session import settle

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return add


@query("op1_simhash")
def op1_simhash(spark: SparkSession, folder: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, folder, "documents"))
    digits = F.lpad(F.lower(F.hex("fp")), 16, "0")
    return found.select("doc_id", digits.alias("fingerprint"), "component_id")


MIX_SQL = r"""
WITH RECURSIVE docs AS (
  SELECT doc_id, source, source IS NULL AS none, coalesce(source, '') AS name,
         len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
         ('0x' || substr(md5('mix/' || doc_id), 1, 8))::BIGINT / 4294967296.0::DOUBLE AS draw
  FROM documents),
ranked AS (
  SELECT none, name, sum(size)::BIGINT AS source_size,
         [1, 2, 3][(row_number() OVER (ORDER BY none, name) - 1) % 3 + 1] AS weight
  FROM docs GROUP BY none, name),
level AS (
  SELECT 0 AS step, 0::HUGEINT AS share, 0::HUGEINT AS weight, -1::BIGINT AS capped
  UNION ALL
  SELECT s.step + 1,
         (SELECT sum(source_size) FROM ranked)
           - coalesce(sum(3 * r.source_size) FILTER (s.capped >= 0 AND r.weight * s.share >= 3 * r.source_size * s.weight), 0),
         coalesce(sum(r.weight) FILTER (NOT (s.capped >= 0 AND r.weight * s.share >= 3 * r.source_size * s.weight)), 0),
         count(*) FILTER (s.capped >= 0 AND r.weight * s.share >= 3 * r.source_size * s.weight)
  FROM level s CROSS JOIN ranked r GROUP BY s.step, s.share, s.weight, s.capped
  HAVING count(*) FILTER (s.capped >= 0 AND r.weight * s.share >= 3 * r.source_size * s.weight) <> s.capped
     AND coalesce(sum(r.weight) FILTER (NOT (s.capped >= 0 AND r.weight * s.share >= 3 * r.source_size * s.weight)), 0) > 0),
last AS (SELECT share::DOUBLE / greatest(weight, 1)::DOUBLE AS level FROM level ORDER BY step DESC LIMIT 1),
rates AS (
  SELECT none, name, source_size,
         CASE WHEN source_size > 0 THEN least(weight::DOUBLE * level, (3 * source_size)::DOUBLE) ELSE 0.0::DOUBLE END AS target
  FROM ranked, last),
taken AS (
  SELECT doc_id, size, source_size, target, draw,
         CASE WHEN source_size > 0 THEN target / source_size::DOUBLE ELSE 0.0::DOUBLE END AS rate,
         sum(size) OVER (PARTITION BY none, name ORDER BY draw RANGE UNBOUNDED PRECEDING) AS upto,
         sum(size) OVER (PARTITION BY none, name, draw) AS tied
  FROM docs JOIN rates USING (none, name))
SELECT doc_id, size, source_size, target,
       (size * least(floor(rate) + CASE WHEN rate > floor(rate) AND (2 * upto - tied)::DOUBLE
          <= 2 * (target - floor(rate) * source_size) THEN 1 ELSE 0 END, 3))::BIGINT AS taken
FROM taken
"""


@query("op2_mixing", MIX_SQL)
def op2_mixing(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    planned = mixing.planned_copies(docs)
    taken = (F.col("size") * F.col("copies")).alias("taken")
    return planned.select("doc_id", "size", "source_size", "target", taken)


@query("op3_ordinal_quality")
def op3_ordinal_quality(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    model = ordinal.train(docs, ordinal.graded(table(spark, folder, "labels")))
    rated = ordinal.rate(docs, model)
    kept = F.coalesce(F.col("tail") >= ordinal.TAIL, F.lit(True))
    return rated.select("doc_id", "expected_grade", "tail", kept.alias("kept"))


@query("op4_uniform_shards")
def op4_uniform_shards(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select(
        "doc_id",
        (F.octet_length(text_of()) + 16).cast("bigint").alias("size"),
        F.crc32(text_of()).alias("text_crc32"),
    )
    return sharding.uniform_shards(docs, 40).select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("rows").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


@query("op5_page_text")
def op5_page_text(spark: SparkSession, folder: str) -> DataFrame:
    return html_text.extract(table(spark, folder, "pages")).select("page_id", "url", "text", "n_chars")


@query("op6_suffix_repeats")
def op6_suffix_repeats(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    size = F.octet_length(text_of()).cast("bigint")
    done = suffix.remove_repeats(docs)
    return done.select(
        "doc_id",
        size.alias("n_bytes"),
        (size - F.octet_length("kept")).alias("n_removed"),
        F.size("spans").cast("bigint").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
    )


@query("op7_packing")
def op7_packing(spark: SparkSession, folder: str) -> DataFrame:
    docs = settle(table(spark, folder, "documents").select("doc_id", word_count().alias("n_words")))
    return packing.pack(docs, length=F.col("n_words")).drop("n_words")


#: The rules of the registered query.
RULES = """VALUES ('net', '/', 'block'), ('example.net', '/en/', 'allow'),
 ('example.com', '/de/', 'block'), ('org', '/fr/', 'allow')"""

URL_SQL = rf"""
WITH rules(rule_host, rule_path, said) AS ({RULES}),
rest AS (
  SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest
  FROM pages),
parsed AS (
  SELECT page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path
  FROM rest),
found AS (
  SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY length(rule_host) + length(rule_path) DESC NULLS LAST,
                               length(rule_host) DESC NULLS LAST) AS place
  FROM parsed LEFT JOIN rules
    ON (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path))
SELECT page_id, host, path, rule_host || rule_path AS rule, coalesce(said, 'allow') AS verdict
FROM found WHERE place = 1
"""


@query("op8_url_rules", URL_SQL)
def op8_url_rules(spark: SparkSession, folder: str) -> DataFrame:
    rules = spark.sql(f"SELECT * FROM {RULES} AS rules(host, path, verdict)")
    pages = table(spark, folder, "pages").select("page_id", "url")
    return url_filter.judge_urls(pages, rules).select("page_id", "host", "path", "rule", "verdict")


def _quality_sql() -> str:
    """The counts, the holdout test and the verdict, with the library's own gamma function."""
    risk = quality_rules.RISK / len(quality_rules.CUTOFFS)
    scores = {
        "symbol_share": "n_symbols / n_words",
        "repeated_line_share": "CASE WHEN n_lines > 0 THEN n_dup_lines / n_lines ELSE 0 END",
        "repeated_word_share": "n_repeat_words / n_words",
        "long_words": "word_chars / n_words",
        "short_words": "-(word_chars / n_words)",
    }
    value = ", ".join(f"CASE WHEN n_words > 0 THEN {s} ELSE 0 END AS {r}" for r, s in scores.items())
    tries = " UNION ALL ".join(
        f"SELECT stratum, '{rule}' AS rule, {cut}::DOUBLE AS cut, count(*) AS n, count(*) FILTER ({rule} > {cut}) AS k"
        " FROM good GROUP BY stratum"
        for rule, cuts in quality_rules.CUTOFFS.items()
        for cut in cuts
    )
    limits = ", ".join(f"min(cut) FILTER (rule = '{r}') AS limit_{r}" for r in scores)
    above = " OR ".join(f"coalesce({r} > limit_{r}, false)" for r in scores)
    return rf"""
WITH texts AS (
  SELECT doc_id, coalesce(lang, '') AS stratum, coalesce(text, '') AS text,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words
  FROM documents),
starts AS (
  SELECT doc_id, i, array_to_string(words[i:i + 4], ' ') AS gram
  FROM (SELECT doc_id, words, unnest(range(1, len(words) - 3)) AS i FROM texts)),
twice AS (SELECT doc_id, i FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, gram) AS c FROM starts) WHERE c > 1),
covered AS (
  SELECT doc_id, count(DISTINCT place) AS n FROM (SELECT doc_id, unnest(range(i, i + 5)) AS place FROM twice) GROUP BY doc_id),
lines AS (
  SELECT doc_id, count(*) AS n_lines, count(*) - count(DISTINCT line) AS n_dup_lines
  FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM texts)
  WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY doc_id),
counted AS (
  SELECT doc_id, stratum, len(words)::BIGINT AS n_words,
         length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g'))::BIGINT AS word_chars,
         (length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
         coalesce(n_lines, 0)::BIGINT AS n_lines, coalesce(n_dup_lines, 0)::BIGINT AS n_dup_lines,
         coalesce(n, 0)::BIGINT AS n_repeat_words
  FROM texts LEFT JOIN covered USING (doc_id) LEFT JOIN lines USING (doc_id)),
scored AS (
  SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed, {value} FROM counted),
good AS (
  SELECT * FROM scored JOIN (SELECT doc_id, max(quality) AS quality FROM labels GROUP BY doc_id) USING (doc_id)
  WHERE quality = 1 AND NOT base_failed),
tries AS ({tries}),
tails AS (
  SELECT stratum, rule, cut, any_value(n) AS n, any_value(k) AS k,
         sum(exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) + i * ln({risk}) + (n - i) * ln(1 - {risk}))) AS tail
  FROM (SELECT *, unnest(range(0, k + 1)) AS i FROM tries WHERE k < n * {risk}) GROUP BY stratum, rule, cut),
limits AS (
  SELECT stratum, {limits} FROM tails
  WHERE tail <= {quality_rules.FAILURE} / ({len(scores)} * (SELECT count(DISTINCT stratum) FROM texts))
  GROUP BY stratum)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND NOT ({above}) AS kept
FROM scored LEFT JOIN limits USING (stratum)
"""


@query("op9_quality_rules", _quality_sql())
def op9_quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    counts = quality_rules.measures()
    measured = settle(docs.select("doc_id", F.coalesce("lang", F.lit("")).alias("stratum"), *counts.values()))
    judged = quality_rules.judge(measured, table(spark, folder, "labels"), "stratum")
    return judged.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"
    )


@query(
    "op10_exact_copies",
    r"""
WITH t AS (
  SELECT doc_id, length(coalesce(text, '')) AS n,
         sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS text_sha256
  FROM documents)
SELECT doc_id, first_value(doc_id) OVER w AS keep_id, count(*) OVER (PARTITION BY text_sha256) AS group_size,
       row_number() OVER w = 1 AS kept, text_sha256
FROM t WINDOW w AS (PARTITION BY text_sha256 ORDER BY n DESC, doc_id NULLS LAST)
""",
)
def op10_exact_copies(spark: SparkSession, folder: str) -> DataFrame:
    marked = exact.mark_copies(table(spark, folder, "documents"))
    return marked.select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


#: The columns of a leaf, in order.
LEAF = ("doc_id", "source", "lang", "n_chars", "text")


def _merkle_sql() -> str:
    """Levels by recursion, siblings by windows, proofs folded level by level."""
    field = lambda v: f"coalesce(strlen({v}) || ':' || {v}, '-')"
    low = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    values = [f"({c})::VARCHAR" for c in LEAF]
    leaf = " || ".join(map(field, values))
    crc = (
        "xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(doc_id::VARCHAR, ''),"
        " lambda ch: ascii(ch)::BIGINT)), lambda c, b: list_reduce(list_prepend(xor(c, b), range(8)),"
        " lambda x, i: xor(x >> 1, 3988292384 * (x & 1)))))"
    )
    changed = f"CASE WHEN ({crc}) % 3 = 0 THEN {low} ELSE text END"
    tampered = " || ".join(map(field, [*values[:-1], f"({changed})"]))
    window = "PARTITION BY lvl, tree, pos // 8 ORDER BY pos ROWS BETWEEN"
    return f"""
WITH RECURSIVE leaves AS (
  SELECT doc_id, lang, sha256({leaf}) AS leaf, sha256({tampered}) AS changed FROM documents),
trees AS (SELECT lang, count(*) AS n, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS tree FROM leaves GROUP BY lang),
placed AS (
  SELECT doc_id, leaf, changed, tree, n,
         row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos
  FROM leaves JOIN trees ON leaves.lang IS NOT DISTINCT FROM trees.lang),
low AS (
  SELECT 0 AS lvl, tree, pos, n, leaf AS h FROM placed
  UNION ALL
  SELECT lvl + 1, tree, pos // 8, (n + 7) // 8, sha256(string_agg(h, '' ORDER BY pos))
  FROM low WHERE n > 1 GROUP BY lvl, tree, pos // 8, n),
high AS (
  SELECT 0 AS lvl, -1 AS tree, tree AS pos, (SELECT count(*) FROM trees) AS n, h FROM low WHERE n = 1
  UNION ALL
  SELECT lvl + 1, tree, pos // 8, (n + 7) // 8, sha256(string_agg(h, '' ORDER BY pos))
  FROM high WHERE n > 1 GROUP BY lvl, tree, pos // 8, n),
sides AS (
  SELECT lvl, tree, pos, coalesce(string_agg(h, '') OVER ({window} UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS l,
         coalesce(string_agg(h, '') OVER ({window} 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS r
  FROM (SELECT * FROM low WHERE n > 1 UNION ALL SELECT * FROM high WHERE n > 1)),
steps AS (
  SELECT p.tree, p.pos, s.lvl AS step, l, r FROM placed p JOIN sides s ON s.tree = p.tree AND s.pos = p.pos // (8 ** s.lvl)::BIGINT
  UNION ALL
  SELECT p.tree, p.pos, 1000 + s.lvl, l, r FROM placed p JOIN sides s ON s.tree = -1 AND s.pos = p.tree // (8 ** s.lvl)::BIGINT),
listed AS (
  SELECT tree, pos, list(struct_pack(l := l, r := r) ORDER BY step) AS path,
         string_agg(l || r, '' ORDER BY step) AS proof
  FROM steps GROUP BY tree, pos),
fold AS (
  SELECT p.tree, p.pos, 1 AS i, CASE WHEN doc_id IS NULL THEN leaf ELSE changed END AS h, path
  FROM placed p LEFT JOIN listed USING (tree, pos)
  UNION ALL
  SELECT tree, pos, i + 1, sha256(path[i].l || h || path[i].r), path FROM fold WHERE i <= len(path))
SELECT doc_id, leaf, (SELECT h FROM low WHERE n = 1 AND low.tree = p.tree) AS subroot, root,
       sha256(coalesce(proof, '')) AS proof_sha256, f.h AS folded_root, f.h = root AS verified
FROM placed p LEFT JOIN listed USING (tree, pos) JOIN fold f ON f.tree = p.tree AND f.pos = p.pos AND f.i = coalesce(len(f.path), 0) + 1,
     (SELECT h AS root FROM high WHERE n = 1)
"""


@query("op13_merkle_manifest", _merkle_sql())
def op13_merkle_manifest(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    tampered = F.crc32(F.col("doc_id").cast("string")) % 3 == 0
    low = F.translate("text", string.ascii_uppercase, string.ascii_lowercase)
    changed = merkle.leaf_of(LEAF, {"text": low})
    leaves = docs.select(
        "doc_id", "lang", merkle.leaf_of(LEAF).alias("leaf"), F.when(tampered, changed).alias("changed")
    )
    found = merkle.manifest(leaves)
    root = merkle.folded(F.coalesce("changed", "leaf"))
    return found.select(
        "doc_id", "leaf", "subroot", "root", merkle.proof_digest().alias("proof_sha256"), root.alias("folded_root")
    ).withColumn("verified", F.col("folded_root") == F.col("root"))


RANKED_SQL = r"""
WITH texts AS (
  SELECT doc_id, row_number() OVER () AS r,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS terms
  FROM documents),
lens AS (SELECT r, doc_id, len(terms)::BIGINT AS n FROM texts WHERE len(terms) > 0),
size AS (SELECT count(*)::BIGINT AS big_n, sum(n)::BIGINT AS big_l FROM lens),
asked AS (
  SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
  FROM benchmark),
tf AS (
  SELECT r, term, count(*)::BIGINT AS tf FROM (SELECT r, unnest(terms) AS term FROM texts)
  WHERE term IN (SELECT term FROM asked) GROUP BY r, term),
weights AS (
  SELECT term, floor(1000 * ln((2 * any_value(big_n) + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::BIGINT AS w
  FROM tf, size GROUP BY term),
impacts AS (
  SELECT r, doc_id, term, w * ((1000000000 * tf) // (1000 * tf + 20 * (100 - 50 + ((50 * n * big_n) // big_l)))) AS impact
  FROM tf JOIN weights USING (term) JOIN lens USING (r), size),
scored AS (SELECT item_id, r, any_value(doc_id) AS doc_id, sum(impact)::BIGINT AS score FROM asked JOIN impacts USING (term) GROUP BY item_id, r),
placed AS (
  SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS LAST)::INTEGER AS rank FROM scored WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM placed WHERE rank <= 50
"""


@query("op12_ranked_search", RANKED_SQL)
def op12_ranked_search(spark: SparkSession, folder: str) -> DataFrame:
    return ranked.search(table(spark, folder, "documents"), table(spark, folder, "benchmark"), 50)


@query(
    "op11_near_vectors",
    """
WITH RECURSIVE good AS (
  SELECT row_number() OVER () AS r, vec_id, label, embedding::DOUBLE[] AS v FROM embeddings
  WHERE label IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
unit AS (SELECT *, sqrt(list_dot_product(v, v)) AS norm FROM good),
links AS (
  SELECT a.r AS a, b.r AS b FROM unit a JOIN unit b ON a.label = b.label AND a.r <> b.r AND len(a.v) = len(b.v)
  WHERE CASE WHEN len(a.v) = len(b.v) THEN list_dot_product(a.v, b.v) / (a.norm * b.norm) >= 0.98 END),
reach AS (SELECT a AS r, b AS s FROM links UNION SELECT reach.r, links.b FROM reach JOIN links ON links.a = reach.s),
low AS (SELECT reach.r, min(vec_id) AS low FROM reach JOIN good ON good.r = reach.s GROUP BY reach.r),
degree AS (SELECT a AS r, count(*) AS n FROM links GROUP BY a),
numbered AS (SELECT good.r, low, n FROM good LEFT JOIN low USING (r) LEFT JOIN degree USING (r)),
done AS (
  SELECT good.vec_id, coalesce(n, 0)::BIGINT AS n_links, least(good.vec_id, low) AS component_id FROM good JOIN numbered USING (r)
  UNION ALL
  SELECT vec_id, 0, vec_id FROM embeddings WHERE NOT coalesce(label IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0, false))
SELECT vec_id, n_links, component_id, vec_id IS NOT DISTINCT FROM component_id AS kept FROM done
""",
)
def op11_near_vectors(spark: SparkSession, folder: str) -> DataFrame:
    found = quantised.linked_vectors(table(spark, folder, "embeddings"))
    return found.select("vec_id", "n_links", "component_id", "kept")
