"""The operators applied to the whole tables, with their DuckDB counterparts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import collocations, decontamination, divergence, licences, minhash, mixing, packing, quality, secrets, sharding, token_counts, toxicity, url_rules

#: The rules of op1.
URL_RULES = [
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
]


#: Where the vocabulary of op5 is, unless the session names another path in spark.proofline.vocabulary.
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Where the tokenizer of op11 is, unless the session names another path in spark.proofline.tokenizer.
TOKENIZER = "/opt/tokenizers/byte_bpe_50k.json"


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _table(spark, sf_dir, "pages").select("page_id", "url")
    rules = spark.createDataFrame(URL_RULES, "host string, path string, verdict string")
    return url_rules.filter_urls(pages, rules).select("page_id", "host", "path", "rule", "verdict")


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontamination.decontaminate(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("item_ids").cast("long").alias("n_items"), F.sha2(F.array_join("item_ids", ",").cast("binary"), 256).alias("items_sha256"), "contaminated"
    )


def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = sharding.shard_rows(_table(spark, sf_dir, "documents").select("doc_id", "source", "text"))
    return docs.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op10_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(_table(spark, sf_dir, "documents").select("doc_id", "text"))


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge_quality(_table(spark, sf_dir, "documents"))


def op6_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(_table(spark, sf_dir, "documents").select("doc_id", "source", "text"))
    return mixed.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.fit(docs, toxicity.training_labels(_table(spark, sf_dir, "labels")))
    scored = toxicity.score_toxicity(docs, model)
    return scored.select("doc_id", toxicity.held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"), "evidence")


def op3_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text", F.lit(None).cast("string").alias("path"))
    found = secrets.scan_secrets(docs, secrets.train(secrets.made_findings(spark)))
    return found.select("doc_id", "place", F.length("value").alias("n_chars"), F.sha2(F.col("value").cast("binary"), 256).alias("value_sha256"), "score", "is_secret")


def op4_licence_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = licences.scan_licences(_table(spark, sf_dir, "documents").select("doc_id", "text"), licences.known_digests(spark))
    return found.select("doc_id", "text_licence", "n_notices", F.array_join("licences", ",").alias("licences"))


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    automaton = token_counts.Automaton(token_counts.read_vocabulary(spark.conf.get("spark.proofline.vocabulary", VOCABULARY)))
    return token_counts.count_tokens(_table(spark, sf_dir, "documents").select("doc_id", "text"), automaton).drop("text")


def op11_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.pack(_table(spark, sf_dir, "documents"), spark.conf.get("spark.proofline.tokenizer", TOKENIZER))
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op12_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.source_divergence(_table(spark, sf_dir, "documents"))


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(_table(spark, sf_dir, "documents"))


QUERIES = {
    "op1_url_filter": op1_url_filter,
    "op2_quality_rules": op2_quality_rules,
    "op3_secret_scan": op3_secret_scan,
    "op4_licence_scan": op4_licence_scan,
    "op5_token_counts": op5_token_counts,
    "op6_source_mixing": op6_source_mixing,
    "op7_toxicity": op7_toxicity,
    "op8_decontamination": op8_decontamination,
    "op9_sharding": op9_sharding,
    "op10_minhash_dedup": op10_minhash_dedup,
    "op11_packing": op11_packing,
    "op12_source_divergence": op12_source_divergence,
    "op13_collocations": op13_collocations,
}

_RULE_ROWS = ", ".join(f"('{host}', '{path}', '{verdict}')" for host, path, verdict in URL_RULES)



def _plain_form(text: str) -> str:
    """The rule of the canonical form for the tables' notices: no line of a holder and years, one space between lower-case words, "licence" as "license"."""
    held = rf"regexp_replace({text}, '(?i)(copyright +([(]c[)]|©|[0-9]|<)|[(]c[)] *[0-9<]|©)[^\n]*', ' ', 'g')"
    return f"trim(replace(regexp_replace(lower({held}), '[^[:alnum:]\u00aa-\uffff]+', ' ', 'g'), 'licenc', 'licens'))"


_LICENCE_ROWS = ", ".join("('{}', '{}', '{}')".format(*(x.replace("'", "''") for x in row)) for row in licences.KNOWN_LICENCES)

#: By measure: quantile of the spread, multiple, side, what a rate counts in; as op2's SQL has them.
_LIMITS = ", ".join(f"('{name}', {percent}, {times}, {1 if side == 'high' else -1}, {repr(of) if of else 'NULL'})" for name, (side, percent, times, of) in quality.MEASURES.items())

ORACLES = {
    "op12_source_divergence": r"""
WITH t AS (SELECT row_number() OVER () AS row, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
  regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS terms FROM documents),
occurring AS (SELECT row, lang, source, unnest(terms) AS term FROM t),
kept AS (SELECT lang, term FROM occurring GROUP BY 1, 2 HAVING count(DISTINCT row) >= 3),
counts AS (SELECT lang, source, term, count(*) AS n FROM occurring SEMI JOIN kept USING (lang, term) GROUP BY 1, 2, 3),
sizes AS (SELECT lang, count(*) AS v FROM kept GROUP BY 1),
every AS (SELECT lang, source, false AS whole FROM t UNION SELECT lang, '', true FROM t),
filled AS (SELECT g.lang, g.source, g.whole, k.term, CAST(coalesce(CASE WHEN whole THEN w.n ELSE c.n END, 0) AS HUGEINT) AS n FROM every g JOIN kept k USING (lang)
  LEFT JOIN counts c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term
  LEFT JOIN (SELECT lang, term, sum(n) AS n FROM counts GROUP BY 1, 2) w ON w.lang = g.lang AND w.term = k.term),
parts AS (SELECT *, 1 + 1000000000 * (n + 1) // (sum(n) OVER (PARTITION BY lang, source, whole) + v) AS p FROM filled JOIN sizes USING (lang)),
rows AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, CAST(coalesce(d.value, 0) AS BIGINT) AS value
  FROM (SELECT * FROM every WHERE NOT whole) a JOIN (SELECT * FROM every WHERE NOT whole) b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN (SELECT x.lang, x.source, y.source AS item, sum((x.p - y.p) * (x.p - y.p) // y.p) AS value FROM parts x JOIN parts y ON x.lang = y.lang AND x.term = y.term AND NOT x.whole AND NOT y.whole GROUP BY 1, 2, 3) d
    ON d.lang = a.lang AND d.source = a.source AND d.item = b.source
  UNION ALL
  SELECT x.lang, x.source, 'term', x.term, CAST((x.p - y.p) * (x.p - y.p) // y.p AS BIGINT) FROM parts x JOIN parts y ON x.lang = y.lang AND x.term = y.term AND NOT x.whole AND y.whole WHERE x.n > 0 AND x.p > y.p)
SELECT lang, source, part, item, value, CAST(rank AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM rows) WHERE part = 'pair' OR rank <= 200""",
    "op13_collocations": r"""
WITH pieces AS (SELECT row_number() OVER () AS piece, lang, text FROM (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS text FROM documents)),
words AS (SELECT piece, lang, unnest(w) AS a, unnest(range(len(w))) AS i FROM (SELECT piece, lang, regexp_extract_all(text, '[^\x20\x09]+') AS w FROM pieces)),
three AS (SELECT lang, a, lead(a) OVER own AS b, lead(a, 2) OVER own AS c FROM words WINDOW own AS (PARTITION BY piece ORDER BY i)),
grams AS (SELECT lang, 1 AS size, a AS phrase FROM three UNION ALL SELECT lang, 2, a || ' ' || b FROM three WHERE b IS NOT NULL UNION ALL SELECT lang, 3, a || ' ' || b || ' ' || c FROM three WHERE c IS NOT NULL),
f AS (SELECT lang, size, phrase, CAST(count(*) AS HUGEINT) AS n FROM grams GROUP BY 1, 2, 3),
totals AS (SELECT lang, CAST(sum(n) AS BIGINT) AS n FROM f WHERE size = 1 GROUP BY 1),
candidates AS (SELECT lang, size, phrase, n AS a, string_split(phrase, ' ') AS w FROM f WHERE size > 1 AND n >= 10),
cuts AS (SELECT *, array_to_string(w[1 : k], ' ') AS lp, array_to_string(w[k + 1 : size], ' ') AS rp FROM candidates, (VALUES (1), (2)) c(k) WHERE k < size),
scored AS (SELECT c.lang, c.phrase, c.a, k, x.n AS l, y.n AS r, 1000000 * a * a // (x.n * y.n) AS score FROM cuts c JOIN f x ON x.lang = c.lang AND x.phrase = c.lp JOIN f y ON y.lang = c.lang AND y.phrase = c.rp),
lowest AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) AS o FROM scored) WHERE o = 1),
longer AS (SELECT lang, part, max(a) AS a FROM (SELECT lang, a, unnest([array_to_string(w[1:2], ' '), array_to_string(w[2:3], ' ')]) AS part FROM candidates WHERE size = 3) GROUP BY 1, 2),
ranked AS (SELECT w.*, row_number() OVER (PARTITION BY w.lang ORDER BY score DESC, w.a DESC, phrase) AS rank FROM lowest w LEFT JOIN longer o ON o.lang = w.lang AND o.part = w.phrase WHERE o.a IS NULL OR 100 * o.a < 50 * w.a)
SELECT lang, rank, phrase, CAST(a AS BIGINT) AS a, CAST(l AS BIGINT) AS l, CAST(r AS BIGINT) AS r, t.n, CAST(score AS BIGINT) AS score FROM ranked JOIN totals t USING (lang) WHERE rank <= 2000""",
    "op2_quality_rules": rf"""
WITH t AS (SELECT row_number() OVER () AS row, doc_id, lang, source, text, coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []) AS w FROM documents),
lines AS (SELECT row, count(*) AS n_lines, count(*) - count(DISTINCT line) AS n_dup_lines FROM (SELECT row, unnest(string_split(text, chr(10))) AS line FROM t) WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY 1),
windows AS (SELECT row, i, count(*) OVER (PARTITION BY row, a, b, c) AS n FROM (SELECT row, i, w[i] AS a, w[i + 1] AS b, w[i + 2] AS c FROM (SELECT row, w, unnest(range(1, len(w) - 1)) AS i FROM t))),
repeats AS (SELECT row, count(DISTINCT i + k) AS n_repeat_words FROM windows, (SELECT unnest([0, 1, 2]) AS k) WHERE n > 1 GROUP BY 1),
counted AS (SELECT row, doc_id, coalesce(lang, chr(0)) AS lang, coalesce(source, chr(0)) AS source, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(list_sum(list_transform(w, lambda x: length(x))), 0) AS BIGINT) AS word_chars,
  CAST(coalesce(length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')), 0) AS BIGINT) AS n_symbols, coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words, coalesce(n_lines, 0) AS n_lines
  FROM t LEFT JOIN lines USING (row) LEFT JOIN repeats USING (row)),
measured AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed, 1000 * n_symbols // greatest(n_words, 1) AS symbol_rate, 1000 * n_dup_lines // greatest(n_lines, 1) AS dup_line_rate,
  1000 * n_repeat_words // greatest(n_words, 1) AS repeat_rate, 100 * word_chars // greatest(n_words, 1) AS word_length FROM counted),
long AS (UNPIVOT (SELECT row, lang, source, base_failed, symbol_rate, dup_line_rate, repeat_rate, word_length, word_length AS word_length_low, n_words, n_lines FROM measured)
  ON symbol_rate, dup_line_rate, repeat_rate, word_length, word_length_low, n_words, n_lines INTO NAME measure VALUE v),
bins AS (SELECT lang, source, measure, v - v % CAST(2 ** greatest(0, length(bin(v)) - 7) AS BIGINT) AS b FROM long WHERE NOT base_failed),
levels AS (SELECT lang, source, measure, b FROM bins UNION ALL SELECT lang, NULL, measure, b FROM bins UNION ALL SELECT NULL, NULL, measure, b FROM bins),
summed AS (SELECT lang, source, measure, b, sum(count(*)) OVER (PARTITION BY lang, source, measure ORDER BY b) AS upto, sum(count(*)) OVER (PARTITION BY lang, source, measure) AS n FROM levels GROUP BY 1, 2, 3, 4),
q AS (SELECT lang, source, measure, any_value(n) AS n, min(b) FILTER (100 * upto >= 50 * n) AS mid, min(b) FILTER (100 * upto >= 10 * n) AS p10, min(b) FILTER (100 * upto >= 90 * n) AS p90,
  min(b) FILTER (100 * upto >= 95 * n) AS p95, min(b) FILTER (100 * upto >= 99 * n) AS p99 FROM summed GROUP BY 1, 2, 3),
used AS (SELECT g.lang, g.source, m.measure, coalesce(o.mid, l.mid, a.mid) AS mid, coalesce(o.p10, l.p10, a.p10) AS p10, coalesce(o.p90, l.p90, a.p90) AS p90, coalesce(o.p95, l.p95, a.p95) AS p95, coalesce(o.p99, l.p99, a.p99) AS p99
  FROM (SELECT DISTINCT lang, source FROM measured) g CROSS JOIN (SELECT DISTINCT measure FROM long) m
  LEFT JOIN q o ON o.lang = g.lang AND o.source = g.source AND o.measure = m.measure AND o.n >= {quality.LEAST_GROUP}
  LEFT JOIN q l ON l.lang = g.lang AND l.source IS NULL AND l.measure = m.measure AND l.n >= {quality.LEAST_GROUP}
  LEFT JOIN q a ON a.lang IS NULL AND a.source IS NULL AND a.measure = m.measure),
rules(measure, percent, times, side, counted_in) AS (VALUES {_LIMITS}),
limits AS (SELECT u.lang, u.source, u.measure, side, trunc(u.mid + side * times * greatest(2 ** greatest(0, length(bin(u.mid)) - 7), CASE WHEN counted_in IS NULL THEN 0 ELSE ceil(1000 / greatest(1, s.mid)) END,
    abs(CASE percent WHEN 10 THEN u.p10 WHEN 90 THEN u.p90 WHEN 95 THEN u.p95 ELSE u.p99 END - u.mid))) AS stop
  FROM used u JOIN rules r USING (measure) LEFT JOIN used s ON s.lang = u.lang AND s.source = u.source AND s.measure = r.counted_in),
beyond AS (SELECT DISTINCT row FROM long JOIN limits USING (lang, source, measure) WHERE side * v > side * stop)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND b.row IS NULL AS kept FROM measured LEFT JOIN beyond b USING (row)""",
    "op10_minhash_dedup": r"""
WITH RECURSIVE t AS (SELECT doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+'), []) AS w FROM documents),
sh AS (SELECT DISTINCT doc_id, array_to_string(w[i : i + 4], ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, greatest(2, len(w) - 3))) AS i FROM t WHERE len(w) > 0)),
sized AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY 1),
links AS (SELECT a.doc_id AS x, b.doc_id AS y FROM sh a JOIN sh b ON a.s = b.s AND a.doc_id < b.doc_id JOIN sized m ON m.doc_id = a.doc_id JOIN sized o ON o.doc_id = b.doc_id GROUP BY 1, 2, m.n, o.n HAVING 100 * count(*) >= 75 * (m.n + o.n - count(*))),
edges AS (SELECT x, y FROM links UNION SELECT y, x FROM links),
reach(x, y) AS (SELECT x, y FROM edges UNION SELECT r.x, b.y FROM reach r JOIN edges b ON b.x = r.y),
low AS (SELECT x, min(y) AS y FROM reach GROUP BY 1)
SELECT doc_id, coalesce(n, 0) AS n_shingles, least(doc_id, coalesce(y, doc_id)) AS component_id, doc_id <= coalesce(y, doc_id) AS kept FROM t LEFT JOIN sized USING (doc_id) LEFT JOIN low ON x = doc_id""",
    "op4_licence_scan": f"""
WITH known AS (
  SELECT form, min(licence) AS licence FROM (
    SELECT licence, {_plain_form("text")} AS form FROM (VALUES {_LICENCE_ROWS}) AS k(licence, title, text)
    UNION ALL SELECT licence, {_plain_form("concat(title, chr(10), text)")} FROM (VALUES {_LICENCE_ROWS}) AS k(licence, title, text)) GROUP BY 1),
docs AS (SELECT row_number() OVER () AS row, doc_id, text FROM documents),
units AS (
  SELECT row, 0 AS place, {_plain_form("text")} AS form FROM docs
  UNION ALL
  SELECT row, 1 AS place, {_plain_form("line")} AS form FROM (SELECT row, unnest(string_split(text, chr(10))) AS line FROM docs)),
found AS (
  SELECT row, max(CASE WHEN place = 0 THEN licence END) AS text_licence, count(CASE WHEN place = 1 THEN 1 END) AS n_notices,
         array_to_string(list_sort(list_distinct(list(licence))), ',') AS licences
  FROM units JOIN known USING (form) GROUP BY row)
SELECT doc_id, text_licence, coalesce(n_notices, 0) AS n_notices, coalesce(licences, '') AS licences
FROM docs LEFT JOIN found USING (row)""",
    "op1_url_filter": rf"""
WITH parts AS (
  SELECT row_number() OVER () AS row, page_id,
         coalesce(translate(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
         coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 2), '') AS path
  FROM pages),
rules(rule_host, rule_path, verdict) AS (VALUES {_RULE_ROWS}),
ranked AS (
  SELECT p.*, r.rule_host || r.rule_path AS rule, r.verdict,
         row_number() OVER (PARTITION BY row ORDER BY length(r.rule_host || r.rule_path) DESC NULLS LAST, length(r.rule_host) DESC) AS n
  FROM parts p LEFT JOIN rules r
    ON (p.host = r.rule_host OR ends_with(p.host, '.' || r.rule_host)) AND starts_with(p.path, r.rule_path))
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM ranked WHERE n = 1""",
    "op8_decontamination": r"""
WITH lowered AS (
  SELECT row_number() OVER () AS row, doc_id,
         coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS words
  FROM documents),
items AS (
  SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words
  FROM benchmark),
sized AS (SELECT item_id, words, least(len(words), 10) AS size FROM items WHERE len(words) > 0),
windows AS (
  SELECT DISTINCT item_id, size, array_to_string(words[i : i + size - 1], ' ') AS win
  FROM (SELECT item_id, words, size, unnest(range(1, len(words) - size + 2)) AS i FROM sized)),
sizes AS (SELECT DISTINCT size FROM windows),
scanned AS (
  SELECT row, size, i, array_to_string(words[i : i + size - 1], ' ') AS win
  FROM (SELECT row, words, size, unnest(range(1, len(words) - size + 2)) AS i FROM lowered, sizes WHERE len(words) >= size)),
hits AS (SELECT s.row, s.i, s.size, w.item_id FROM scanned s JOIN windows w ON s.size = w.size AND s.win = w.win),
counted AS (
  SELECT row, count(DISTINCT word) AS n_hit
  FROM (SELECT row, unnest(range(i, i + size)) AS word FROM hits) GROUP BY row),
listed AS (
  SELECT row, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
  FROM (SELECT DISTINCT row, CAST(item_id AS VARCHAR) AS item FROM hits) GROUP BY row)
SELECT l.doc_id, CAST(len(l.words) AS BIGINT) AS n_words, coalesce(c.n_hit, 0) AS n_hit, coalesce(i.n_items, 0) AS n_items,
       sha256(coalesce(i.items, '')) AS items_sha256, c.n_hit IS NOT NULL AS contaminated
FROM lowered l LEFT JOIN counted c USING (row) LEFT JOIN listed i USING (row)""",
    "op9_sharding": r"""
WITH crc AS (
  SELECT list_transform(range(256), lambda b: list_reduce([CAST(b AS BIGINT), 0, 0, 0, 0, 0, 0, 0, 0],
         lambda c, k: CASE WHEN c % 2 = 1 THEN xor(3988292384, c // 2) ELSE c // 2 END)) AS tab),
texts AS (SELECT row_number() OVER () AS row, doc_id, source, coalesce(text, '') AS text FROM documents),
bytes AS (
  SELECT row, doc_id, source, text, hex(encode(text)) AS h FROM texts),
sized AS (
  SELECT row, doc_id, source, CAST(octet_length(encode(text)) + 16 AS BIGINT) AS size,
         CASE WHEN text = '' THEN 0 ELSE xor(4294967295, list_reduce(
           list_prepend(4294967295, list_transform(range(1, CAST(length(h) AS BIGINT), 2), lambda i: CAST('0x' || h[i : i + 1] AS BIGINT))),
           lambda c, b: xor(c // 256, tab[xor(c % 256, b) + 1]))) END AS text_crc32
  FROM bytes, crc),
ranked AS (
  SELECT *, md5('17:' || coalesce(CAST(doc_id AS VARCHAR), 'null') || ':' || CAST(text_crc32 AS VARCHAR)) AS digest FROM sized),
fractions AS (
  SELECT *, (2 * row_number() OVER (PARTITION BY source ORDER BY digest, doc_id, size) - 1)
            / CAST(2 * count(*) OVER (PARTITION BY source) AS DOUBLE) AS fraction FROM ranked),
placed AS (
  SELECT *, row_number() OVER (ORDER BY fraction, source NULLS FIRST, digest, doc_id, size) - 1 AS pos, count(*) OVER () AS n FROM fractions)
SELECT doc_id, size, text_crc32, 'rows' AS law, CAST(pos * 40 // n AS INTEGER) AS shard,
       CAST(pos - ((pos * 40 // n) * n + 39) // 40 AS BIGINT) AS slot, CAST(NULL AS INTEGER) AS grown_shard
FROM placed""",
}
