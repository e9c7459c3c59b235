"""The operators' registered queries over the given tables, and their DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terrane.llm import bpe, fm, hosts, mixing, quality_rules, search, secrets, simhash, spelling, suffix_repeats, superkmer, toxicity, vector_codes
from terrane.llm.text import table
from terrane.session import Workspace

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}


def query(build: Query) -> Query:
    _QUERIES[build.__name__] = build
    return build


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


def word_vocabulary() -> str:
    """Where the public tokenizer file is; a parameter of the operator."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


@query
def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.scan(table(spark, sf_dir, "documents").select("doc_id", "text"))
    kind = lambda n: F.size(F.filter("base", lambda s: s["kind"] == n)).cast("long")
    return found.select(
        "doc_id",
        kind(0).alias("n_assign"),
        kind(1).alias("n_access"),
        kind(2).alias("n_hex"),
        F.sha2(secrets.written(F.col("base")), 256).alias("base_sha256"),
        secrets.written(F.col("found")).alias("spans"),
    )


@query
def op2_host_reputation(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    outcomes = hosts.labelled_outcomes(pages, table(spark, sf_dir, "labels"))
    return hosts.judged(pages, outcomes, Workspace(spark, "op2")).select("page_id", "host", "path", "rule", "verdict")


# The same judgement written as relations: levels from counts, strengths by moments.
_SQL["op2_host_reputation"] = r"""
WITH cut AS (
  SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages
), parts AS (
  SELECT page_id,
         translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path
  FROM cut
), marked AS (
  SELECT doc_id, 1 - max(quality) AS bad FROM labels WHERE doc_id IS NOT NULL AND quality IS NOT NULL GROUP BY doc_id
), shown AS (
  SELECT host, nullif(regexp_extract(path, '/([0-9]{1,18})([./]|$)', 1), '') AS doc FROM parts
), hosts AS (
  SELECT host, count(bad) AS n, coalesce(sum(bad), 0) AS bad,
         array_to_string(list_slice(string_split(host, '.'), -2, -1), '.') AS domain, list_extract(string_split(host, '.'), -1) AS suffix
  FROM shown LEFT JOIN marked ON CAST(doc AS BIGINT) = doc_id GROUP BY host
), domains AS (SELECT domain, suffix, sum(n) AS n, sum(bad) AS bad FROM hosts GROUP BY ALL),
suffixes AS (SELECT suffix, sum(n) AS n, sum(bad) AS bad FROM domains GROUP BY ALL),
s0 AS (SELECT *, (SELECT coalesce(sum(bad), 0) / (coalesce(sum(n), 0) + 1) FROM suffixes) AS prior FROM suffixes),
s1 AS (SELECT least(greatest(coalesce(CASE WHEN sum(n) > count(*) THEN (sum(n * pow(bad / n - prior, 2) / (prior * (1 - prior))) - count(*)) / (sum(n) - count(*)) ELSE 0 END, 0), 0.001), 0.999) AS rho
       FROM s0 WHERE n > 0 AND prior > 0 AND prior < 1),
s2 AS (SELECT suffix, (bad + (1 - rho) / rho * prior) / (n + (1 - rho) / rho) AS prior FROM s0, s1),
d0 AS (SELECT d.*, prior FROM domains d JOIN s2 USING (suffix)),
d1 AS (SELECT least(greatest(coalesce(CASE WHEN sum(n) > count(*) THEN (sum(n * pow(bad / n - prior, 2) / (prior * (1 - prior))) - count(*)) / (sum(n) - count(*)) ELSE 0 END, 0), 0.001), 0.999) AS rho
       FROM d0 WHERE n > 0 AND prior > 0 AND prior < 1),
d2 AS (SELECT domain, suffix, (bad + (1 - rho) / rho * prior) / (n + (1 - rho) / rho) AS prior FROM d0, d1),
h0 AS (SELECT h.*, prior FROM hosts h JOIN d2 USING (domain, suffix)),
h1 AS (SELECT least(greatest(coalesce(CASE WHEN sum(n) > count(*) THEN (sum(n * pow(bad / n - prior, 2) / (prior * (1 - prior))) - count(*)) / (sum(n) - count(*)) ELSE 0 END, 0), 0.001), 0.999) AS rho
       FROM h0 WHERE n > 0 AND prior > 0 AND prior < 1),
h2 AS (SELECT host, (bad + (1 - rho) / rho * prior) / (n + (1 - rho) / rho) AS mean, n + (1 - rho) / rho AS weight FROM h0, h1),
rules(host, path, verdict) AS (VALUES ('net', '/', 'block'), ('example.net', '/en/', 'allow'), ('example.com', '/de/', 'block'), ('org', '/fr/', 'allow')),
fitting AS (
  SELECT p.page_id, p.host, p.path, max_by(r.host || r.path, length(r.host || r.path)) AS rule, max_by(r.verdict, length(r.host || r.path)) AS verdict
  FROM parts p LEFT JOIN rules r ON (p.host = r.host OR ends_with(p.host, '.' || r.host)) AND starts_with(p.path, r.path)
  GROUP BY p.page_id, p.host, p.path
)
SELECT page_id, f.host, path, rule,
       coalesce(verdict, CASE WHEN mean - 1.645 * sqrt(mean * (1 - mean) / (weight + 1)) > 0.25 THEN 'block' ELSE 'allow' END) AS verdict
FROM fitting f JOIN h2 USING (host)
"""


@query
def op3_bm25_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every fiftieth document asks; all documents answer."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    asked = docs.where("doc_id % 50 = 0").select(F.col("doc_id").alias("query_id"), "text")
    found = search.top_k(docs, asked, Workspace(spark, "op3"))
    return found.select("query_id", "rank", "doc_id", F.round("score", 6).alias("score"))


_SQL["op3_bm25_top_k"] = r"""
WITH words AS (
  SELECT doc_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^ 	-
]+')) AS term FROM documents
), tf AS (SELECT doc_id, term, count(*) AS tf FROM words GROUP BY ALL),
size AS (SELECT doc_id, sum(tf) AS length FROM tf GROUP BY ALL),
corpus AS (SELECT count(*) AS n, (SELECT count(*) FROM words) / count(*) AS mean FROM documents),
idf AS (SELECT term, ln(1 + (n - count(*) + 0.5) / (count(*) + 0.5)) AS idf FROM tf, corpus GROUP BY term, n),
scored AS (
  SELECT q.doc_id AS query_id, d.doc_id, sum(idf * d.tf * 2.2 / (d.tf + 1.2 * (0.25 + 0.75 * length / mean))) AS score
  FROM tf q JOIN tf d USING (term) JOIN idf USING (term) JOIN size ON size.doc_id = d.doc_id, corpus
  WHERE q.doc_id % 50 = 0 GROUP BY ALL
), ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, doc_id) AS rank FROM scored)
SELECT query_id, CAST(rank AS INTEGER) AS rank, doc_id, round(score, 6) AS score FROM ranked WHERE rank <= 10
"""


@query
def op4_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    taken = mixing.mix(table(spark, sf_dir, "documents").select("doc_id", "source", "text"))
    return taken.select("doc_id", "size", "source_size", "target", "taken")


@query
def op5_adaptive_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = quality_rules.judged(table(spark, sf_dir, "documents"), Workspace(spark, "op5"))
    return found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


@query
def op6_superkmer_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = superkmer.without_repeats(table(spark, sf_dir, "documents"), Workspace(spark, "op6"), keep_text=False)
    return found.select("doc_id", "n_words", "n_removed", "kept_sha256")


_SQL["op6_superkmer_dedup"] = r"""
WITH words AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
windows AS (SELECT doc_id, i, md5(array_to_string(list_slice(w, i, i + 49), ' ')) AS run FROM words, unnest(range(1, len(w) - 48)) AS r(i) WHERE len(w) >= 50),
late AS (SELECT doc_id, i FROM (SELECT doc_id, i, min(doc_id) OVER (PARTITION BY run) AS first FROM windows) WHERE first < doc_id),
gone AS (SELECT DISTINCT doc_id, p FROM late, unnest(range(i, i + 50)) AS r(p)),
places AS (SELECT doc_id, unnest(range(1, len(w) + 1)) AS p, unnest(w) AS word FROM words),
kept AS (
  SELECT places.doc_id, count(gone.p) AS n_removed, string_agg(word, ' ' ORDER BY places.p) FILTER (gone.p IS NULL) AS kept
  FROM places LEFT JOIN gone ON places.doc_id = gone.doc_id AND places.p = gone.p GROUP BY places.doc_id
)
SELECT doc_id, len(w) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM words LEFT JOIN kept USING (doc_id)
"""


@query
def op7_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = suffix_repeats.without_repeats(table(spark, sf_dir, "documents"), Workspace(spark, "op7"), keep_text=False)
    return found.select("doc_id", "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"), "kept_sha256")


@query
def op8_simhash_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.groups(table(spark, sf_dir, "documents"), Workspace(spark, "op8"))
    return found.select("doc_id", simhash.hexadecimal().alias("fingerprint"), "component_id")


@query
def op9_bpe_encode(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode(table(spark, sf_dir, "documents"), word_vocabulary())


@query
def op10_quality_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, settings = table(spark, sf_dir, "documents"), fm.Settings()
    machine = fm.train(docs, table(spark, sf_dir, "labels"), settings)
    scored = fm.score(docs, machine, ["doc_id"])
    return scored.select("doc_id", fm.held_out().alias("held_out"), "score", (F.col("score") >= settings.threshold).cast("int").alias("predicted"))


@query
def op11_toxicity_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, settings = table(spark, sf_dir, "documents"), toxicity.Settings()
    classifier = toxicity.train(docs, table(spark, sf_dir, "labels"), Workspace(spark, "op11"), settings)
    scored = toxicity.score(docs, classifier, ["doc_id"])
    return scored.select("doc_id", fm.held_out().alias("held_out"), "score", (F.col("score") >= settings.threshold).cast("int").alias("predicted"))


@query
def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = vector_codes.compressed(table(spark, sf_dir, "embeddings"), Workspace(spark, "op12"))
    return found.select("vec_id", "code", "error", "label_error", "codebooks_sha256")


def _codes_sql(rounds: int = 2) -> str:
    """Plain k-means: every part against every entry."""
    steps = []
    for r in range(rounds + 1):
        steps.append(f"""near{r} AS (
  SELECT vec_id, p, any_value(part) AS part, min(d) AS d, arg_min(e, d * 64 + e) AS e FROM (
    SELECT vec_id, p, part, e, CAST(list_sum(list_transform(list_zip(part, entry), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS BIGINT) AS d
    FROM parts JOIN book{r} USING (p)
  ) GROUP BY vec_id, p
)""")
        if r < rounds:
            steps.append(f"""mean{r} AS (
  SELECT p, e, list(CAST(m AS BIGINT) ORDER BY i) AS entry FROM (
    SELECT p, e, i, floor(sum(part[i]) / count(*)) AS m FROM near{r}, (SELECT unnest(range(1, w + 1)) AS i FROM dims) GROUP BY p, e, i
  ) GROUP BY p, e
), book{r + 1} AS (SELECT p, e, coalesce(m.entry, b.entry) AS entry FROM book{r} b LEFT JOIN mean{r} m USING (p, e))""")
    return f"""
WITH kept AS (
  SELECT vec_id, label, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), dims AS (SELECT max(len(v)) // 16 AS w FROM kept),
parts AS (SELECT vec_id, p, list_slice(v, p * w + 1, p * w + w) AS part FROM kept, dims, (SELECT unnest(range(16)) AS p)),
book0 AS (SELECT p, e, part AS entry FROM (SELECT p, part, row_number() OVER (PARTITION BY p ORDER BY vec_id) - 1 AS e FROM parts) WHERE e < 64),
{", ".join(steps)},
coded AS (
  SELECT vec_id, string_agg(printf('%02x', e), '' ORDER BY p) AS code, CAST(sum(d) AS BIGINT) AS error FROM near{rounds} GROUP BY vec_id
), digest AS (
  SELECT sha256(string_agg(array_to_string(entry, ','), ',' ORDER BY p, e)) AS codebooks_sha256 FROM book{rounds}
)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256
FROM coded JOIN kept USING (vec_id), digest
"""


_SQL["op12_vector_codes"] = _codes_sql()


@query
def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = spelling.counted_words(table(spark, sf_dir, "documents"))
    return spelling.variants(words, Workspace(spark, "op13")).select("word", "form", "root", "n", "n_near", "form_n")


# Checksums byte by byte from the table of the polynomial; near words by what is left without one character.
_SQL["op13_spelling_variants"] = r"""
WITH RECURSIVE crc AS (
  SELECT list(c ORDER BY b) AS t FROM (
    SELECT b, list_reduce(list_prepend(b, range(8)), lambda c, i: CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS c FROM (SELECT unnest(range(256)) AS b)
  )
), runs AS (
  SELECT doc_id, translate(run, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run, count(*) AS n
  FROM (SELECT doc_id, unnest(regexp_extract_all(coalesce(text, ''), '[A-Za-z\x{C0}-\x{FF}]+')) AS run FROM documents)
  WHERE length(run) >= 6 GROUP BY ALL
), hexed AS (SELECT run, doc_id, n, hex(encode(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || run)) AS h FROM runs),
sums AS (
  SELECT run, n, xor(4294967295, list_reduce(
    list_prepend(4294967295, list_transform(range(1, length(h), 2), lambda i: (instr('0123456789ABCDEF', h[i]) - 1) * 16 + instr('0123456789ABCDEF', h[i + 1]) - 1)),
    lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1]))) AS h
  FROM hexed, crc
), written AS (
  SELECT CASE WHEN h % 199 = 0 THEN substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word, n FROM sums
), words AS (SELECT word, CAST(sum(n) AS BIGINT) AS n FROM written WHERE length(word) >= 6 GROUP BY word HAVING sum(n) >= 5),
skips AS (SELECT word, n, i, substr(word, 1, i) || substr(word, i + 2) AS rest FROM words, unnest(range(length(word))) AS r(i)),
near AS (
  SELECT a.word, b.word AS other, b.n AS other_n FROM skips a JOIN skips b ON a.rest = b.rest AND a.i = b.i AND a.word <> b.word
  UNION SELECT s.word, w.word, w.n FROM skips s JOIN words w ON s.rest = w.word
  UNION SELECT w.word, s.word, s.n FROM skips s JOIN words w ON s.rest = w.word
), ranked AS (
  SELECT word, other, other_n, count(*) OVER (PARTITION BY word) AS n_near, row_number() OVER (PARTITION BY word ORDER BY other_n DESC, encode(other)) AS r FROM near
), known AS (
  SELECT words.word, n, coalesce(n_near, 0) AS n_near, CASE WHEN other_n >= 5 * n THEN other END AS form, CASE WHEN other_n >= 5 * n THEN other_n END AS form_n
  FROM words LEFT JOIN ranked ON words.word = ranked.word AND r = 1
), walk(word, here, next) AS (
  SELECT word, word, form FROM known
  UNION ALL SELECT walk.word, k.word, k.form FROM walk JOIN known k ON walk.next = k.word
)
SELECT known.word, form, here AS root, n, n_near, form_n FROM known JOIN walk ON known.word = walk.word AND walk.next IS NULL
"""
