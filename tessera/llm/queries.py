"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann, chat, decontaminate, hard_negatives, langid, licenses, mixing, ngram_join, prefix_trie, secrets, substring_dedup, toxicity, url_filters
from .common import in_train, table


#: Score from which a document is predicted toxic.
TOXIC = 0.7


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.fit(docs, table(spark, sf_dir, "labels").select("doc_id", "toxic"))
    found = toxicity.score(docs, model)
    return found.select("doc_id", (~in_train(F.col("doc_id"))).alias("held_out"), "score", (F.col("score") >= TOXIC).cast("int").alias("predicted"), F.size("spans").alias("n_spans"))


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.with_digest(substring_dedup.remove_repeats(table(spark, sf_dir, "documents")))


def op3_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    more = spark.createDataFrame([(-7, 0, "user", chat.PLANTED), (-7, 1, "assistant", chat.PLANTED)], rows.schema)
    chats = chat.with_loss_spans(chat.format_chats(rows.unionByName(more)))
    body = F.transform("loss_spans", lambda s: F.substring(F.col("formatted"), s["start"] + 1, s["end"] - s["start"]))
    text = F.array_join(F.transform(body, lambda t: F.when(F.col("escaped"), chat.unescaped(t)).otherwise(t)), "")
    turns = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    chats = chats.withColumn("_loss", text)
    return chats.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(turns, 256).alias("turns_sha256"),
        F.length("_loss").cast("long").alias("loss_chars"),
        F.sha2("_loss", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
        "escaped",
        "exact",
    )


def op4_license_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents as files of a tree: /source/4096 ids/64 ids/, the first of each range as its licence file."""
    i = F.col("doc_id")
    top = F.concat_ws("/", F.coalesce("source", F.lit("")), F.floor(i / 4096).cast("string"))
    sub = F.concat_ws("/", top, F.floor(i / 64).cast("string"))
    path = F.when(i % 4096 == 0, F.concat(top, F.lit("/LICENSE"))).when(i % 64 == 0, F.concat(sub, F.lit("/LICENSE"))).otherwise(F.concat(sub, F.lit("/"), i.cast("string"), F.lit(".txt")))
    files = table(spark, sf_dir, "documents").select(path.alias("path"), "text")
    return licenses.scan(files)


def op5_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = secrets.find_secrets(docs)
    n_base = len(secrets.BASE)
    count = lambda k: F.size(F.filter("spans", lambda s: s["rank"] == k)).cast("long")
    return found.select(
        "doc_id",
        *[count(i).alias(f"n_{r.kind}") for i, r in enumerate(secrets.BASE)],
        F.sha2(secrets.as_text(F.filter("spans", lambda s: s["rank"] < n_base)), 256).alias("base_sha256"),
        secrets.as_text("spans").alias("spans"),
    )


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    return langid.train_and_identify(docs).select("doc_id", "held_out", "lang_pred", "score")


def op7_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return ann.nearest(vectors, vectors.where(F.col("vec_id") % 20 == 0))  # the queries; candidates are all rows


def op8_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    plan = mixing.mix_plan(table(spark, sf_dir, "documents"))
    return plan.select("doc_id", "size", "source_size", "target", (F.col("n_copies") * F.col("size")).alias("taken"), "n_copies")


def op9_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.near_duplicates(table(spark, sf_dir, "documents"))


def op10_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = decontaminate.contamination(docs, table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    rows = table(spark, sf_dir, "embeddings").select("vec_id", "embedding", moved.alias("label"))
    return hard_negatives.mine(rows, F.col("vec_id") % 100 == 0)


RULES = [
    url_filters.Rule("com", "/", "allow"),
    url_filters.Rule("example.com", "/en/", "block"),
    url_filters.Rule("www.example.com", "/en/", "allow"),
    url_filters.Rule("net", "/es/", "block"),
    url_filters.Rule("net", "/fr/", "block"),
]


def op12_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filters.judge(table(spark, sf_dir, "pages"), RULES)


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.prefix_trie(table(spark, sf_dir, "conversations"))


QUERIES = {f.__name__: f for f in (op1_toxicity, op2_substring_dedup, op3_chat_formatting, op4_license_scans, op5_secret_scans, op6_language_id, op7_nearest_neighbours, op8_source_mixing, op9_ngram_jaccard_join, op10_benchmark_decontamination, op11_hard_negatives, op12_url_filters, op13_prefix_trie)}

_CONTROL = r"</?s>|\[/?INST\]|<</?SYS>>|<<ROLE:[0-9A-F]*>>|<</ROLE>>|<<ESC>>"

_L = licenses.oracle_values()

#: The SQL engine's patterns have no lookahead, so line ends are marked there.
_KEY = "'" + secrets.pem_key(ahead=False).replace("'", "''") + "'"


def _url_filters_sql(rules: list[url_filters.Rule]) -> str:
    """Rounds of whole numbers, as the operator takes them."""
    low = lambda x: f"translate({x}, '{url_filters.UPPER}', '{url_filters.LOWER}')"
    quoted = lambda x: "'" + x.replace("'", "''") + "'"
    rounds = "".join(
        f""", r{k + 1} AS (
  SELECT bad, host, sum(rank)::BIGINT AS rank FROM (
    SELECT bad, host, rank * {100 - url_filters.DAMPING} // 100 AS rank FROM r0
    UNION ALL SELECT f.bad, f.dst, (r.rank * {url_filters.DAMPING} // 100) // f.degree FROM r{k} r JOIN f ON f.bad = r.bad AND f.src = r.host
  ) GROUP BY bad, host
)"""
        for k in range(url_filters.ROUNDS)
    )
    return f"""
WITH u AS (
  SELECT row_number() OVER () AS i, page_id, html, {low(f"coalesce(regexp_extract(url, {quoted(url_filters.URL)}, 1), '')")} AS host, coalesce(regexp_extract(url, {quoted(url_filters.URL)}, 2), '') AS path FROM pages
), l(rhost, rpath, verdict) AS (VALUES {", ".join(f"('{r.host}', '{r.path}', '{r.verdict}')" for r in rules)}),
j AS (
  SELECT i, page_id, host, path, rhost || rpath AS rule, verdict AS ruled FROM u LEFT JOIN l ON (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath)
  QUALIFY row_number() OVER (PARTITION BY i ORDER BY length(rhost || rpath) DESC NULLS LAST, rhost || rpath DESC) = 1
), h AS (SELECT DISTINCT host FROM u WHERE host <> ''),
k AS (SELECT host AS src, regexp_replace(host, '^[^.]*[.]', '') AS dst FROM h),
k2 AS (SELECT src, dst FROM k WHERE src <> dst AND dst IN (SELECT host FROM h)),
e AS (
  SELECT src, dst FROM (SELECT host AS src, {low(f"unnest(regexp_extract_all(html, {quoted(url_filters.LINK)}, 1))")} AS dst FROM u) WHERE src <> '' AND dst <> '' AND src <> dst
  UNION SELECT src, dst FROM k2 UNION SELECT dst, src FROM k2
), b AS (SELECT false AS bad, src, dst FROM e UNION ALL SELECT true, dst, src FROM e),
f AS (SELECT *, count(*) OVER (PARTITION BY bad, src) AS degree FROM b),
s AS (SELECT ruled = 'block' AS bad, host, count(*) AS n FROM j WHERE ruled IS NOT NULL GROUP BY ALL),
r0 AS (SELECT bad, host, (n::HUGEINT * {url_filters.MASS} // sum(n) OVER (PARTITION BY bad))::BIGINT AS rank FROM s){rounds},
v AS (SELECT host, sum(CASE WHEN bad THEN 0 ELSE rank END)::BIGINT AS trust, sum(CASE WHEN bad THEN rank ELSE 0 END)::BIGINT AS distrust FROM r{url_filters.ROUNDS} GROUP BY host)
SELECT page_id, j.host, path, rule, coalesce(ruled, CASE WHEN distrust::HUGEINT * 100 > trust::HUGEINT * {url_filters.THRESHOLD} THEN 'block' ELSE 'allow' END) AS verdict,
  coalesce(trust, 0)::BIGINT AS trust, coalesce(distrust, 0)::BIGINT AS distrust
FROM j LEFT JOIN v ON v.host = j.host"""



ORACLES = {
    "op4_license_scans": f"""
WITH f AS (
  SELECT text, CASE WHEN doc_id % 4096 = 0 THEN top || '/LICENSE' WHEN doc_id % 64 = 0 THEN top || '/' || (doc_id // 64) || '/LICENSE' ELSE top || '/' || (doc_id // 64) || '/' || doc_id || '.txt' END AS path
  FROM (SELECT *, coalesce(source, '') || '/' || (doc_id // 4096) AS top FROM documents)
), t(template, licence, term, weight) AS (VALUES {_L["templates"]}), m(template, n) AS (VALUES {_L["lengths"]}), i(term, idf) AS (VALUES {_L["idf"]}),
o AS (SELECT template, n, any_value(licence) AS licence, list(term) AS own FROM t JOIN m USING (template) GROUP BY template, n),
g AS (
  SELECT path, list_transform(string_split(lower(text), chr(10)), lambda x: list_filter(list_transform(regexp_split_to_array(x, '[^a-z0-9.-]+'), lambda y: regexp_replace(y, '^[.-]+|[.-]+$', '', 'g')), lambda y: y <> '' AND y NOT IN ({_L["stop"]}))) AS lines
  FROM f WHERE text IS NOT NULL
), w AS (SELECT path, lines, flatten(lines) AS terms FROM g),
p AS (SELECT path, terms, unnest(terms) AS term, unnest(range(1, len(terms) + 1)) AS i FROM w),
r0 AS (
  SELECT path, template, n, own, licence, run FROM (SELECT path, unnest(lines) AS run FROM w) CROSS JOIN o
  UNION ALL SELECT path, o.template, n, own, o.licence, terms[greatest(1, least(i, len(terms) - n + 1)) : greatest(1, least(i, len(terms) - n + 1)) + n - 1] FROM p JOIN t ON t.term = p.term JOIN o ON o.template = t.template
  UNION ALL SELECT path, template, n, own, licence, terms FROM w CROSS JOIN o WHERE path LIKE '%/LICENSE'
), r1 AS (SELECT DISTINCT path, template, n, licence, run FROM r0 WHERE len(list_intersect(own, run)) >= least({licenses.LEAST_TERMS}, len(own))),
tf AS (SELECT path, template, n, licence, run, term, count(*) AS tf FROM (SELECT *, unnest(run) AS term FROM r1) GROUP BY ALL),
v AS (SELECT tf.*, tf * coalesce(idf, {_L["unknown"]}) AS w, coalesce(weight, 0) AS weight FROM tf LEFT JOIN i ON i.term = tf.term LEFT JOIN t ON t.term = tf.term AND t.template = tf.template),
s AS (SELECT path, n, licence, round(sum(w * weight) / sqrt(sum(w * w)), 6) AS score FROM v GROUP BY path, template, n, licence, run),
own AS (SELECT path, licence, score FROM s WHERE score >= {licenses.LEAST} QUALIFY row_number() OVER (PARTITION BY path ORDER BY round(score * score * n, 6) DESC, score DESC, licence) = 1),
up AS (SELECT regexp_replace(path, '/[^/]*$', '') AS above, licence, score FROM own WHERE path LIKE '%/LICENSE'),
r AS (
  SELECT f.path, own.licence, own.score, up.above, up.licence AS up_licence, up.score AS up_score,
    row_number() OVER (PARTITION BY f.path ORDER BY length(up.above) DESC NULLS LAST) AS k
  FROM f LEFT JOIN own ON own.path = f.path LEFT JOIN up ON starts_with(f.path, up.above || '/')
)
SELECT path, coalesce(licence, up_licence) AS licence, coalesce(score, up_score) AS score,
  CASE WHEN licence IS NOT NULL THEN 'own' WHEN up_licence IS NOT NULL THEN 'inherited' END AS basis, CASE WHEN licence IS NULL THEN above END AS source
FROM r WHERE k = 1""",
    "op2_substring_dedup": r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
g AS (SELECT r, i, array_to_string(w[i : i + 34], ' ') AS g FROM (SELECT r, w, unnest(range(1, len(w) - 33)) AS i FROM d WHERE len(w) >= 35)),
rep AS (SELECT g FROM g GROUP BY g HAVING count(*) > 1),
gone AS (SELECT DISTINCT r, unnest(range(i, i + 35)) AS p FROM g SEMI JOIN rep ON g.g = rep.g),
gl AS (SELECT r, list(p) AS ps, count(*) AS n FROM gone GROUP BY r),
words AS (SELECT r, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS p FROM d),
kept AS (SELECT words.r, string_agg(word, ' ' ORDER BY words.p) AS k FROM words ANTI JOIN gone ON words.r = gone.r AND words.p = gone.p GROUP BY words.r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(gl.n, 0)::BIGINT AS n_removed, sha256(coalesce(k, '')) AS kept_sha256
FROM d LEFT JOIN gl ON gl.r = d.r LEFT JOIN kept ON kept.r = d.r""",
    "op3_chat_formatting": f"""
WITH r AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'
), m AS (
  SELECT *, regexp_matches(text, '{_CONTROL}') AS bad,
    CASE role WHEN 'user' THEN 13 WHEN 'assistant' THEN 7 WHEN 'system' THEN 15 ELSE 18 + 2 * strlen(role) END AS marks,
    length(text) AS n, length(text) - length(replace(text, '\\', '')) AS slashes, len(regexp_extract_all(text, '{_CONTROL}')) AS controls
  FROM r
), g AS (
  SELECT conv_id, count(*) AS n_turns, string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text) AS t,
    coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (WHERE role = 'assistant'), '') AS l,
    sum(marks + n) AS plain, sum(slashes + controls) AS more, bool_or(bad) AS bad
  FROM m GROUP BY conv_id
)
SELECT conv_id, n_turns::BIGINT AS n_turns, sha256(t) AS turns_sha256, length(l)::BIGINT AS loss_chars, sha256(l) AS loss_sha256,
  (plain + CASE WHEN bad THEN 7 + more ELSE 0 END)::BIGINT AS formatted_chars, bad AS escaped, true AS exact
FROM g""",
    "op5_secret_scans": rf"""
WITH k(rank, kind, least) AS (VALUES
  (0, 'assign', 12), (1, 'access', 18), (2, 'hex', 16), (3, 'github', 1), (4, 'slack', 1), (5, 'jwt', 1), (6, 'private_key', 1)
), m AS (
  SELECT doc_id, rank, kind, least,
    CASE rank WHEN 0 THEN regexp_extract_all(text, '(?i:(password|passwd|secret|token|api_?key))["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)', 0)
      WHEN 1 THEN regexp_extract_all(text, 'AKIA[A-Z0-9]+', 0) WHEN 2 THEN regexp_extract_all(text, '[0-9a-f]{{16,}}', 0)
      WHEN 3 THEN regexp_extract_all(text, 'gh[pousr]_[A-Za-z0-9]{{36}}', 0) WHEN 4 THEN regexp_extract_all(text, 'xox[abprs]-[A-Za-z0-9-]{{10,}}', 0)
      WHEN 5 THEN regexp_extract_all(text, 'eyJ[A-Za-z0-9_-]{{8,}}\.eyJ[A-Za-z0-9_-]{{8,}}\.[A-Za-z0-9_-]+', 0)
      ELSE regexp_extract_all(text, {_KEY}, 0) END AS hits,
    CASE WHEN rank = 0 THEN regexp_extract_all(text, '(?i:(password|passwd|secret|token|api_?key))["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)', 2) END AS held,
    text
  FROM (SELECT doc_id, rank, kind, least, CASE WHEN rank = 6 THEN regexp_replace(text, '\r?\n|\\r\\n|\\n|\r', chr(1) || '\0', 'g') || chr(1) ELSE text END AS text FROM documents CROSS JOIN k)
), w AS (
  SELECT doc_id, rank, kind, least, hits, coalesce(held, hits) AS held, unnest(range(1, len(hits) + 1)) AS i, text FROM m WHERE len(hits) > 0
), pieces AS (
  SELECT doc_id, rank, kind, i, least, held, hits,
    CASE rank WHEN 0 THEN regexp_split_to_array(text, '(?i:(?:password|passwd|secret|token|api_?key))["'']?\x20*[:=]\x20*["'']?(?:[A-Za-z0-9+/_.=-]+)')
      WHEN 1 THEN regexp_split_to_array(text, 'AKIA[A-Z0-9]+') WHEN 2 THEN regexp_split_to_array(text, '[0-9a-f]{{16,}}')
      WHEN 3 THEN regexp_split_to_array(text, 'gh[pousr]_[A-Za-z0-9]{{36}}') WHEN 4 THEN regexp_split_to_array(text, 'xox[abprs]-[A-Za-z0-9-]{{10,}}')
      WHEN 5 THEN regexp_split_to_array(text, 'eyJ[A-Za-z0-9_-]{{8,}}\.eyJ[A-Za-z0-9_-]{{8,}}\.[A-Za-z0-9_-]+')
      ELSE regexp_split_to_array(text, {_KEY}) END AS p
  FROM w
), s AS (
  SELECT doc_id, rank, kind, list_sum(list_transform(p[1:i], lambda x: length(x)))::BIGINT + coalesce(list_sum(list_transform(hits[1:i-1], lambda x: length(x))), 0)::BIGINT AS start_at,
    length(hits[i]) AS n
  FROM (SELECT * REPLACE (CASE WHEN rank = 6 THEN list_transform(p, lambda x: replace(x, chr(1), '')) ELSE p END AS p, CASE WHEN rank = 6 THEN list_transform(hits, lambda x: replace(x, chr(1), '')) ELSE hits END AS hits) FROM pieces) WHERE length(held[i]) >= least
), a AS (
  SELECT doc_id, count(*) FILTER (WHERE rank = 0) AS n_assign, count(*) FILTER (WHERE rank = 1) AS n_access, count(*) FILTER (WHERE rank = 2) AS n_hex,
    coalesce(string_agg(kind || ':' || start_at || ':' || (start_at + n), ',' ORDER BY start_at, rank) FILTER (WHERE rank < 3), '') AS base,
    string_agg(kind || ':' || start_at || ':' || (start_at + n), ',' ORDER BY start_at, rank) AS spans
  FROM s GROUP BY doc_id
)
SELECT d.doc_id, coalesce(n_assign, 0)::BIGINT AS n_assign, coalesce(n_access, 0)::BIGINT AS n_access, coalesce(n_hex, 0)::BIGINT AS n_hex,
  sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM documents d LEFT JOIN a ON a.doc_id = d.doc_id""",
    # exact search over all pairs; the query's neighbours are found by the index, which may miss one on other tables
    "op7_nearest_neighbours": """
WITH e AS (
  SELECT vec_id, min(x) AS x FROM (SELECT vec_id, embedding::DOUBLE[] AS x FROM embeddings WHERE vec_id IS NOT NULL AND embedding IS NOT NULL)
  WHERE len(list_filter(x, lambda v: v IS NULL OR NOT isfinite(v))) = 0 AND len(list_filter(x, lambda v: v <> 0)) > 0 GROUP BY vec_id
), p AS (SELECT q.vec_id AS query_id, e.vec_id, list_inner_product(q.x, e.x) AS score FROM e q JOIN e ON q.vec_id % 20 = 0 AND q.vec_id <> e.vec_id)
SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM p) WHERE rank <= 20""",
    "op8_source_mixing": r"""
WITH RECURSIVE z AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size FROM documents
), s AS (
  SELECT source, sum(size)::BIGINT AS source_size, ([3, 1, 2])[1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3]::BIGINT AS weight FROM z GROUP BY source
), f(round, source, weight, cap, filled, target) AS (
  SELECT 0, source, weight, 2 * source_size, false, 0.0::DOUBLE FROM s
  UNION ALL
  SELECT round + 1, source, weight, cap, filled OR share > cap, CASE WHEN filled OR share > cap THEN cap::DOUBLE ELSE share END
  FROM (
    SELECT *, (1.5::DOUBLE * (SELECT sum(source_size)::BIGINT FROM s) - sum(CASE WHEN filled THEN cap ELSE 0 END) OVER ()::DOUBLE) * weight / sum(CASE WHEN filled THEN 0 ELSE weight END) OVER ()::DOUBLE AS share FROM f
  ) WHERE round < (SELECT count(*) FROM s)
), t AS (
  SELECT s.source, source_size, target FROM s JOIN f ON s.source IS NOT DISTINCT FROM f.source WHERE round = (SELECT count(*) FROM s)
), c AS (
  SELECT doc_id, size, source_size, target, CASE WHEN source_size > 0 THEN target / source_size ELSE 0 END AS rate,
    ('0x' || substr(md5('mix-1:' || coalesce(doc_id::VARCHAR, 'null')), 1, 8))::BIGINT::DOUBLE / 4294967296.0 AS u
  FROM z JOIN t ON z.source IS NOT DISTINCT FROM t.source
), n AS (SELECT *, (floor(rate) + CASE WHEN u < rate - floor(rate) THEN 1 ELSE 0 END)::BIGINT AS n_copies FROM c)
SELECT doc_id, size, source_size, target, n_copies * size AS taken, n_copies FROM n""",
    "op9_ngram_jaccard_join": r"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i : i + 4], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, greatest(1, len(w) - 4) + 1)) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS u, b.doc_id AS v, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2),
e AS (SELECT u, v FROM p JOIN n x ON x.doc_id = u JOIN n y ON y.doc_id = v WHERE 100 * c >= 80 * (x.n + y.n - c)),
r AS (SELECT doc_id, doc_id AS m FROM d UNION SELECT e.v, r.m FROM r JOIN e ON e.u = r.doc_id)
SELECT doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, m AS component_id
FROM d LEFT JOIN n USING (doc_id) JOIN (SELECT doc_id, min(m) AS m FROM r GROUP BY doc_id) USING (doc_id)""",
    "op10_benchmark_decontamination": r"""
WITH iw AS (
  SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark WHERE text IS NOT NULL
), win AS (
  SELECT DISTINCT item_id, least(10, len(w)) AS k, array_to_string(w[i : i + least(10, len(w)) - 1], ' ') AS g
  FROM (SELECT item_id, w, unnest(range(1, greatest(1, len(w) - 9) + 1)) AS i FROM iw WHERE len(w) > 0)
), dw AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), ks AS (SELECT DISTINCT k FROM win), dg AS (
  SELECT doc_id, k, i, array_to_string(w[i : i + k - 1], ' ') AS g
  FROM (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM dw CROSS JOIN ks WHERE len(w) >= k)
), hit AS (SELECT doc_id, i, dg.k, item_id FROM dg JOIN win ON dg.g = win.g AND dg.k = win.k),
covered AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + k)) AS p FROM (SELECT DISTINCT doc_id, i, k FROM hit)) GROUP BY doc_id),
its AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item FROM hit) GROUP BY doc_id)
SELECT dw.doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM dw LEFT JOIN covered ON covered.doc_id = dw.doc_id LEFT JOIN its ON its.doc_id = dw.doc_id""",
    "op11_hard_negatives": """
WITH e AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS x, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label
  FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND len(list_filter(embedding, lambda v: v IS NULL OR NOT isfinite(v))) = 0
  QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY embedding, label) = 1
), s AS (
  SELECT a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS same, list_inner_product(a.x, b.x)::BIGINT AS score
  FROM e a JOIN e b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id AND len(a.x) = len(b.x)
), p AS (
  SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5
)
SELECT anchor_id, positive_id, (row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id))::INTEGER AS rank, vec_id AS negative_id, positive_score, score AS negative_score
FROM p JOIN s USING (anchor_id) WHERE NOT same AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score
QUALIFY rank <= 10""",
    "op12_url_filters": _url_filters_sql(RULES),
    "op13_prefix_trie": """
WITH t AS (
  SELECT conv_id, key, size, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, key) AS pos
  FROM (SELECT *, sha256(length(role) || ':' || role || text) AS key, length(text) AS size FROM (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL))
), c AS (
  SELECT conv_id, xor(list_reduce([4294967295] || flatten(list_transform(string_split(conv_id::VARCHAR, ''), lambda x: [ord(x)::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1])),
    lambda a, b: CASE WHEN b >= 0 THEN xor(a, b) ELSE xor(a >> 1, 3988292384 * (a & 1)) END), 4294967295) % 6 AS h
  FROM (SELECT DISTINCT conv_id FROM t)
), r AS (
  SELECT c.conv_id, 0 AS part, pos, key, size FROM c JOIN t ON t.conv_id = c.conv_id - c.conv_id % 100 AND pos <= h
  UNION ALL SELECT c.conv_id, 1, pos, key, size FROM c JOIN t ON t.conv_id = c.conv_id AND pos > h
), p AS (
  SELECT conv_id, row_number() OVER w AS depth, string_agg(key, '') OVER w AS path, size FROM r WINDOW w AS (PARTITION BY conv_id ORDER BY part, pos ROWS UNBOUNDED PRECEDING)
  UNION ALL SELECT conv_id, 0, '', 0 FROM c
), n AS (
  SELECT depth, path, min(conv_id) AS conv_id, count(*) AS n_convs, any_value(size) AS size FROM p GROUP BY depth, path
), k AS (SELECT left(path, 64 * (depth - 1)) AS path, count(*) AS n_children FROM n WHERE depth > 0 GROUP BY 1),
d AS (
  SELECT path, string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) AS ends FROM (SELECT conv_id, path FROM p QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY depth DESC) = 1) GROUP BY path
), a AS (
  SELECT left(n.path, 64 * j) AS path, sum(CASE WHEN k.path IS NULL THEN 1 ELSE 0 END) AS n_leaves, sum((n_convs - 1) * size) AS saved
  FROM (SELECT *, unnest(range(0, depth + 1)) AS j FROM n) n LEFT JOIN k ON k.path = n.path GROUP BY 1
)
SELECT n.conv_id, n.depth, up.conv_id AS parent_conv_id, n.n_convs, coalesce(n_children, 0)::BIGINT AS n_children, n_leaves::BIGINT AS n_leaves, saved::BIGINT AS saved_tokens, sha256(coalesce(ends, '')) AS ends_sha256
FROM n JOIN a ON a.path = n.path LEFT JOIN k ON k.path = n.path LEFT JOIN d ON d.path = n.path LEFT JOIN n up ON n.depth > 0 AND up.path = left(n.path, 64 * (n.depth - 1))""",
}
