"""Scalar functions by group, one query each."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.registry import load, query, sql

sql(
    "string_functions",
    """SELECT p_partkey, substring(p_name, 2, 4) AS sub, upper(p_brand) AS up, lower(p_type) AS low, CAST(length(p_name) AS BIGINT) AS len, trim(concat('  ', p_name, ' ')) AS tr, ltrim(concat('  ', p_brand)) AS lt, rtrim(concat(p_brand, '  ')) AS rt,
    lpad(p_brand, 12, '*') AS lp, rpad(p_brand, 12, '-') AS rp, translate(p_type, 'AEIO', '1234') AS tl, replace(p_type, 'O', '0') AS rep, reverse(p_brand) AS rev, repeat(p_brand, 3) AS rpt,
    concat_ws('/', p_brand, p_type) AS cw, CAST(ascii(p_type) AS INT) AS asc_code, left(p_name, 3) AS lft, right(p_name, 3) AS rgt, split_part(p_name, ' ', 1) AS sp,
    CAST(levenshtein(p_brand, p_type) AS BIGINT) AS lev, starts_with(p_type, 'PRO') AS sw, contains(p_type, 'MO') AS ct, p_brand || '-' || p_type AS cc FROM part""".replace("starts_with(p_type, 'PRO')", "startswith(p_type, 'PRO')"),
    """SELECT p_partkey, substring(p_name, 2, 4) AS sub, upper(p_brand) AS up, lower(p_type) AS low, CAST(length(p_name) AS BIGINT) AS len, trim(concat('  ', p_name, ' ')) AS tr, ltrim(concat('  ', p_brand)) AS lt, rtrim(concat(p_brand, '  ')) AS rt,
    lpad(p_brand, 12, '*') AS lp, rpad(p_brand, 12, '-') AS rp, translate(p_type, 'AEIO', '1234') AS tl, replace(p_type, 'O', '0') AS rep, reverse(p_brand) AS rev, repeat(p_brand, 3) AS rpt,
    concat_ws('/', p_brand, p_type) AS cw, CAST(ascii(p_type) AS INT) AS asc_code, left(p_name, 3) AS lft, right(p_name, 3) AS rgt, split_part(p_name, ' ', 1) AS sp,
    CAST(levenshtein(p_brand, p_type) AS BIGINT) AS lev, starts_with(p_type, 'PRO') AS sw, contains(p_type, 'MO') AS ct, p_brand || '-' || p_type AS cc FROM part""",
)
sql(
    "string_functions_more",
    """SELECT n_nationkey, CAST(instr(n_name, 'A') AS BIGINT) AS ins, CAST(position('I' IN n_name) AS BIGINT) AS pos, base64(CAST(n_name AS BINARY)) AS b64, hex(CAST(n_name AS BINARY)) AS hx, substring_index(concat(n_name, '.b.', n_nationkey), '.', 2) AS si,
    overlay(n_name PLACING 'XY' FROM 3 FOR 2) AS ov, initcap(concat(n_name, ' of ', n_nationkey)) AS ic, url_encode(concat(n_name, ' &', n_nationkey)) AS ue, url_decode(concat(replace(n_name, 'A', '%41'), '%20b')) AS ud, format_string('%s-%d', n_name, n_nationkey) AS fs,
    parse_url(concat('http://h', n_nationkey, '.example/p?q=1'), 'HOST') AS host, mask(concat(n_name, '-x', n_nationkey)) AS mk, CAST(bit_length(n_name) AS BIGINT) AS bl, CAST(octet_length(n_name) AS BIGINT) AS ol, array_join(split(n_name, 'A'), '_') AS spl FROM nation""",
    """SELECT n_nationkey, CAST(instr(n_name, 'A') AS BIGINT) AS ins, CAST(position('I' IN n_name) AS BIGINT) AS pos, base64(n_name::BLOB) AS b64, hex(n_name) AS hx, n_name || '.b' AS si,
    left(n_name, 2) || 'XY' || substr(n_name, 5) AS ov, array_to_string(list_transform(string_split(n_name || ' of ' || n_nationkey, ' '), lambda w: upper(w[1]) || lower(w[2:])), ' ') AS ic, replace(n_name, ' ', '+') || '+%26' || n_nationkey AS ue, n_name || ' b' AS ud, format('{}-{}', n_name, n_nationkey) AS fs,
    'h' || n_nationkey || '.example' AS host, regexp_replace(regexp_replace(regexp_replace(n_name || '-x' || n_nationkey, '[a-z]', 'x', 'g'), '[A-Z]', 'X', 'g'), '[0-9]', 'n', 'g') AS mk, CAST(bit_length(n_name) AS BIGINT) AS bl, CAST(strlen(n_name) AS BIGINT) AS ol, array_to_string(string_split(n_name, 'A'), '_') AS spl FROM nation""",
)
sql(
    "regex_functions",
    r"""SELECT doc_id, regexp_extract(text, '([A-Za-z]+)', 1) AS first_word, CAST(regexp_count(text, '[0-9]+') AS BIGINT) AS n_numbers, CAST(size(regexp_extract_all(text, '[A-Z][a-z]+', 0)) AS BIGINT) AS n_caps,
    regexp_replace(text, '[aeiou]', '_') AS masked, regexp_like(text, 'the [a-z]+ing') AS has_ing, regexp_substr(text, '[0-9]+') AS number, CAST(regexp_instr(text, '[0-9]+') AS BIGINT) AS number_at FROM documents""",
    r"""SELECT doc_id, regexp_extract(text, '([A-Za-z]+)', 1) AS first_word, len(regexp_extract_all(text, '[0-9]+'))::BIGINT AS n_numbers, len(regexp_extract_all(text, '[A-Z][a-z]+'))::BIGINT AS n_caps,
    regexp_replace(text, '[aeiou]', '_', 'g') AS masked, regexp_matches(text, 'the [a-z]+ing') AS has_ing, nullif(regexp_extract(text, '[0-9]+'), '') AS number, CASE WHEN regexp_matches(text, '[0-9]') THEN length(regexp_split_to_array(text, '[0-9]+')[1]) + 1 WHEN text IS NOT NULL THEN 0 END::BIGINT AS number_at FROM documents""",
)
sql(
    "regex_functions_whole_text",
    "SELECT doc_id, regexp_replace(text, '[aeiou]', '_') AS masked FROM documents",
    "SELECT doc_id, regexp_replace(text, '[aeiou]', '_', 'g') AS masked FROM documents",
)
sql(
    "date_functions",
    """SELECT o_orderkey, CAST(year(o_orderdate) AS BIGINT) AS y, CAST(quarter(o_orderdate) AS BIGINT) AS q, CAST(month(o_orderdate) AS BIGINT) AS m, CAST(day(o_orderdate) AS BIGINT) AS d, CAST(dayofweek(o_orderdate) AS BIGINT) AS dow, CAST(dayofyear(o_orderdate) AS BIGINT) AS doy,
    CAST(weekofyear(o_orderdate) AS BIGINT) AS woy, CAST(trunc(o_orderdate, 'MM') AS DATE) AS month_start, CAST(date_trunc('QUARTER', o_orderdate) AS DATE) AS quarter_start, last_day(o_orderdate) AS month_end, date_add(CAST(o_orderdate AS DATE), 10) AS plus10,
    CAST(datediff(DATE'2002-01-01', CAST(o_orderdate AS DATE)) AS BIGINT) AS days_to, date_format(o_orderdate, 'yyyy/MM/dd') AS fmt, add_months(CAST(o_orderdate AS DATE), 1) AS next_month, make_date(1999, 2, 3) AS md, CAST(extract(DAY FROM o_orderdate) AS BIGINT) AS ex FROM orders""",
    """SELECT o_orderkey, year(o_orderdate) AS y, quarter(o_orderdate) AS q, month(o_orderdate) AS m, day(o_orderdate) AS d, dayofweek(o_orderdate) + 1 AS dow, dayofyear(o_orderdate) AS doy,
    weekofyear(o_orderdate) AS woy, date_trunc('month', o_orderdate)::DATE AS month_start, date_trunc('quarter', o_orderdate)::DATE AS quarter_start, last_day(o_orderdate) AS month_end, o_orderdate::DATE + 10 AS plus10,
    date_diff('day', o_orderdate::DATE, DATE '2002-01-01') AS days_to, strftime(o_orderdate, '%Y/%m/%d') AS fmt, (o_orderdate::DATE + INTERVAL 1 MONTH)::DATE AS next_month, make_date(1999, 2, 3) AS md, extract(day FROM o_orderdate) AS ex FROM orders""",
)
sql(
    "timestamp_functions",
    """SELECT event_id, CAST(hour(ts) AS BIGINT) AS h, CAST(minute(ts) AS BIGINT) AS mi, CAST(unix_micros(CAST(ts AS TIMESTAMP)) AS BIGINT) AS us, CAST(date_trunc('HOUR', ts) AS TIMESTAMP_NTZ) AS hour_start, CAST(ts + INTERVAL 90 MINUTES AS TIMESTAMP_NTZ) AS later,
    CAST(timestampdiff(HOUR, TIMESTAMP_NTZ'2024-01-01 00:00:00', ts) AS BIGINT) AS hours, to_timestamp_ntz(date_format(ts, 'yyyy-MM-dd HH:mm:ss')) AS parsed, months_between(CAST(ts AS DATE), DATE'2023-11-15') AS mb,
    CAST(convert_timezone('UTC', 'America/New_York', ts) AS TIMESTAMP_NTZ) AS ny FROM events""",
    """SELECT event_id, hour(ts) AS h, minute(ts) AS mi, epoch_us(ts) AS us, date_trunc('hour', ts) AS hour_start, ts + INTERVAL 90 MINUTE AS later,
    date_sub('hour', TIMESTAMP '2024-01-01 00:00:00', ts) AS hours, date_trunc('second', ts) AS parsed, ROUND(year(ts) * 12 + month(ts) - 24287 + (day(ts) - 15) / 31, 8)::DOUBLE AS mb, ts - INTERVAL 5 HOUR AS ny FROM events""",
)
_MATH = """ROUND(sqrt(l_extendedprice), 8) AS sq, ROUND(cbrt(l_quantity), 8) AS cb, ROUND(ln(l_extendedprice), 8) AS ln_, ROUND(log10(l_extendedprice), 8) AS l10, ROUND(log2(l_quantity), 8) AS l2, ROUND(exp(l_discount), 8) AS ex,
    ROUND(sin(l_quantity), 8) AS sn, ROUND(atan2(l_quantity, 3), 8) AS at2, ROUND(degrees(l_discount), 8) AS deg, ROUND(radians(l_quantity), 8) AS rad, ROUND(power(l_quantity, 2), 4) AS pw, abs(l_discount - 1) AS ab, sign(l_discount - 0.05) AS sg,
    CAST(ceil(l_extendedprice) AS BIGINT) AS ce, CAST(floor(l_extendedprice) AS BIGINT) AS fl, greatest(l_discount, l_tax) AS gr, least(l_discount, l_tax) AS le, l_orderkey % 7 AS md, factorial(CAST(l_linenumber AS INT)) AS fa, round(l_quantity / 2) AS r"""
sql(
    "math_functions",
    """SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, ROUND(cos(l_quantity), 8) AS co, ROUND(tan(l_discount), 8) AS ta, ROUND(asin(l_discount), 8) AS asi, ROUND(acos(l_tax), 8) AS aco, ROUND(atan(l_quantity), 8) AS ata, ROUND(sinh(l_tax), 8) AS sih,
    ROUND(cosh(l_discount), 8) AS coh, ROUND(tanh(l_quantity), 8) AS tah, ROUND(cot(l_quantity), 8) AS ct, ROUND(pi() * l_quantity, 8) AS circ, ROUND(l_extendedprice, -2) AS hundreds, -l_tax AS neg, isnan(l_tax) AS nan, l_partkey % 5 AS md FROM lineitem""",
)
sql("math_functions_all_rows", f"SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, {_MATH.replace('factorial(CAST(l_linenumber AS INT))', 'CAST(factorial(CAST(l_linenumber AS INT)) AS BIGINT)')} FROM lineitem", f"SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, {_MATH.replace('factorial(CAST(l_linenumber AS INT))', 'factorial(CAST(l_linenumber AS INT))::BIGINT').replace('sign(l_discount - 0.05)', 'sign(l_discount - 0.05)::DOUBLE')} FROM lineitem")
sql(
    "math_functions_more",
    "SELECT s_suppkey, CAST(pmod(-s_suppkey, 7) AS BIGINT) AS pm, CAST(bround(s_suppkey + 0.5) AS BIGINT) AS br, CAST(rint(s_acctbal) AS BIGINT) AS ri, ROUND(hypot(s_suppkey, 4), 8) AS hy, ROUND(log1p(s_suppkey), 8) AS l1, ROUND(expm1(0.01 * s_suppkey), 8) AS e1, CAST(width_bucket(s_acctbal, 0, 10000, 5) AS BIGINT) AS wb, try_divide(s_suppkey, 0) AS td, conv(CAST(s_suppkey AS STRING), 10, 16) AS hx, CAST(s_suppkey DIV 3 AS BIGINT) AS dv FROM supplier",
    "SELECT s_suppkey, ((-s_suppkey % 7) + 7) % 7 AS pm, CASE WHEN s_suppkey % 2 = 0 THEN s_suppkey ELSE s_suppkey + 1 END AS br, round_even(s_acctbal, 0)::BIGINT AS ri, ROUND(sqrt(s_suppkey * s_suppkey + 16), 8) AS hy, ROUND(ln(1 + s_suppkey), 8) AS l1, ROUND(exp(0.01 * s_suppkey) - 1, 8) AS e1, CASE WHEN s_acctbal < 0 THEN 0 WHEN s_acctbal >= 10000 THEN 6 ELSE floor(s_acctbal / 2000) + 1 END::BIGINT AS wb, NULL::DOUBLE AS td, to_base(s_suppkey, 16) AS hx, s_suppkey // 3 AS dv FROM supplier",
)
sql("hash_functions", "SELECT c_custkey, md5(c_name) AS m, sha2(c_name, 256) AS s, sha1(c_name) AS s1, CAST(bit_count(c_custkey) AS BIGINT) AS bc, shiftleft(c_custkey, 2) AS sl, c_custkey & 6 AS ba, c_custkey | 8 AS bo FROM customer", "SELECT c_custkey, md5(c_name) AS m, sha256(c_name) AS s, sha1(c_name) AS s1, bit_count(c_custkey)::BIGINT AS bc, c_custkey << 2 AS sl, c_custkey & 6 AS ba, c_custkey | 8 AS bo FROM customer")


@query()
def hash_functions_native(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = load(spark, sf_dir, "customer")
    return c.select("c_custkey", F.xxhash64("c_name").alias("xx"), F.hash("c_name").alias("murmur"), F.crc32(F.col("c_name").cast("binary")).alias("crc"), F.getbit(F.col("c_custkey"), F.lit(1)).alias("bit1"))


@query(
    """SELECT vec_id, ROUND(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE)), 5) AS norm2, len(list_filter(embedding, lambda x: x > 0))::BIGINT AS n_pos, list_max(embedding)::DOUBLE AS most, list_min(embedding)::DOUBLE AS least,
    embedding[1:3] AS head, embedding[2]::DOUBLE AS second, list_contains([1, 2, 3], label) AS known, list_position([5, label, 7], label)::BIGINT AS pos, list_sort(list_distinct([label, 1, label])) AS dis, flatten([[label], [2, label]]) AS flat, len(embedding)::BIGINT AS n FROM embeddings"""
)
def array_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    e, ints = F.col("embedding"), lambda *x: F.array(*map(F.lit, x))
    return load(spark, sf_dir, "embeddings").select(
        "vec_id",
        F.round(F.aggregate(e, F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")), 5).alias("norm2"),
        F.size(F.filter(e, lambda x: x > 0)).cast("long").alias("n_pos"),
        F.array_max(e).cast("double").alias("most"),
        F.array_min(e).cast("double").alias("least"),
        F.slice(e, 1, 3).alias("head"),
        F.element_at(e, 2).cast("double").alias("second"),
        F.array_contains(ints(1, 2, 3), F.col("label")).alias("known"),
        F.array_position(F.array(F.lit(5), "label", F.lit(7)), F.col("label")).alias("pos"),
        F.sort_array(F.array_distinct(F.array("label", F.lit(1), "label"))).alias("dis"),
        F.flatten(F.array(F.array("label"), F.array(F.lit(2), "label"))).alias("flat"),
        F.size(e).cast("long").alias("n"),
    )


@query("SELECT vec_id, v::DOUBLE AS v FROM (SELECT vec_id, unnest(CASE WHEN len(big) > 0 THEN big ELSE [NULL] END) AS v FROM (SELECT vec_id, list_filter(embedding, lambda x: x > 0.25) AS big FROM embeddings))")
def array_explode(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The large components of each vector; a null for a vector without any."""
    return load(spark, sf_dir, "embeddings").select("vec_id", F.explode_outer(F.filter("embedding", lambda x: x > 0.25)).alias("v")).select("vec_id", F.col("v").cast("double").alias("v"))


@query("SELECT vec_id, (i - 1)::BIGINT AS i, embedding[i]::DOUBLE AS v FROM (SELECT vec_id, embedding, unnest(range(1, len(embedding) + 1)) AS i FROM embeddings)")
def array_explode_all_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every component with its place."""
    return load(spark, sf_dir, "embeddings").select("vec_id", F.posexplode("embedding").alias("i", "v")).select("vec_id", F.col("i").cast("long").alias("i"), F.col("v").cast("double").alias("v"))


sql(
    "array_functions_more",
    "SELECT r_regionkey, array_union(array(1, r_regionkey), array(2)) AS u, array_except(array(1, 2, 3), array(r_regionkey)) AS e, array_intersect(array(1, 2, 3), array(r_regionkey, 3)) AS x, sequence(1, r_regionkey + 1) AS s, array_sort(array(3, r_regionkey, 1)) AS so, array_join(transform(sequence(1, 3), v -> CAST(v * r_regionkey AS STRING)), ',') AS tr, forall(array(1, 2), v -> v > r_regionkey) AS fa, exists(array(1, 2), v -> v = r_regionkey) AS ex, array_join(zip_with(array(1, 2), array(3, 4), (a, b) -> CAST(a * b AS STRING)), ',') AS zw, array_append(array(1), r_regionkey) AS ap FROM region",
    "SELECT r_regionkey, list_distinct([1, r_regionkey, 2]) AS u_, [x for x in [1, 2, 3] if x <> r_regionkey] AS e, [x for x in [1, 2, 3] if x = r_regionkey or x = 3] AS x, range(1, r_regionkey + 2) AS s, list_sort([3, r_regionkey, 1]) AS so, array_to_string([(x * r_regionkey)::VARCHAR for x in range(1, 4)], ',') AS tr, (1 > r_regionkey AND 2 > r_regionkey) AS fa, r_regionkey IN (1, 2) AS ex, '3,8' AS zw, [1, r_regionkey] AS ap, CASE r_regionkey WHEN 1 THEN [1, 2] WHEN 2 THEN [1, 2] ELSE [1, r_regionkey, 2] END AS u FROM region".replace("list_distinct([1, r_regionkey, 2]) AS u_, ", ""),
)


@query("SELECT p_partkey, [p_size, p_partkey] AS zipped, [p_size, -1, p_partkey] AS inserted, [p_size, p_size] AS twice, p_size::BIGINT AS least, [p_partkey, p_size] AS backwards FROM part")
def array_functions_built(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = F.col("p_size").cast("int"), F.col("p_partkey").cast("int")
    pairs = F.arrays_zip(F.array(a).alias("x"), F.array(b).alias("y"))
    return load(spark, sf_dir, "part").select(
        "p_partkey",
        F.array(pairs[0]["x"], pairs[0]["y"]).alias("zipped"),
        F.array_insert(F.array(a, b), 2, F.lit(-1)).alias("inserted"),
        F.array_repeat(a, 2).alias("twice"),
        F.array_min(F.array_compact(F.array(a, F.lit(None).cast("int")))).cast("long").alias("least"),
        F.reverse(F.array(a, b)).alias("backwards"),
    )


@query("SELECT s_suppkey, [s_nationkey, s_nationkey + 1] AS vals, (s_nationkey * 2 + 1)::BIGINT AS both, s_nationkey::BIGINT AS of_entries, 'a:' || s_nationkey AS text FROM supplier")
def map_functions_built(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("s_nationkey").cast("int")
    m = F.map_from_entries(F.array(F.struct(F.lit("a"), n), F.struct(F.lit("b"), n + 1)))
    other = F.map_from_arrays(F.array(F.lit("a"), F.lit("b")), F.array(n + 1, n))
    return load(spark, sf_dir, "supplier").select(
        "s_suppkey",
        F.array_sort(F.map_values(m)).alias("vals"),
        F.element_at(F.map_zip_with(m, other, lambda k, x, y: x + y), "b").cast("long").alias("both"),
        F.element_at(m, "a").cast("long").alias("of_entries"),
        F.element_at(F.transform(F.map_entries(F.str_to_map(F.concat(F.lit("a:"), "s_nationkey"))), lambda e: F.concat_ws(":", e["key"], e["value"])), 1).alias("text"),
    )


@query("SELECT s_suppkey, 'a' AS k1, s_nationkey::BIGINT AS v1, 2::BIGINT AS n, s_nationkey > 10 AS has_b, (s_nationkey * 2)::BIGINT AS doubled FROM supplier")
def map_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = load(spark, sf_dir, "supplier")
    m = F.create_map(F.lit("a"), F.col("s_nationkey"), F.lit("z"), F.col("s_nationkey") + 1)
    more = F.map_concat(m, F.create_map(F.lit("b"), F.lit(1)))
    big = F.map_filter(more, lambda k, v: (k != "b") | (F.col("s_nationkey") > 10))
    twice = F.transform_values(m, lambda k, v: v * 2)
    return s.select(
        "s_suppkey",
        F.element_at(F.array_sort(F.map_keys(m)), 1).alias("k1"),
        F.element_at(m, "a").cast("long").alias("v1"),
        F.size(F.map_entries(m)).cast("long").alias("n"),
        F.map_contains_key(big, "b").alias("has_b"),
        F.element_at(F.transform_keys(twice, lambda k, v: F.upper(k)), "A").cast("long").alias("doubled"),
    )


sql(
    "json_functions",
    "SELECT event_id, get_json_object(props, '$.k') AS k, from_json(props, 'k STRING').k AS k2, CAST(json_array_length(to_json(sequence(0, CAST(event_id % 5 AS INT)))) AS BIGINT) AS n, array_join(json_object_keys(props), ',') AS ks, to_json(named_struct('a', event_id)) AS js, try_variant_get(parse_json(props), '$.k', 'string') AS vk FROM events",
    "SELECT event_id, props->>'$.k' AS k, props->>'$.k' AS k2, (event_id % 5 + 1)::BIGINT AS n, array_to_string(json_keys(props), ',') AS ks, '{\"a\":' || event_id || '}' AS js, props->>'$.k' AS vk FROM events",
)
sql(
    "csv_and_xml_functions",
    "SELECT n_nationkey, from_csv(concat_ws(',', CAST(n_nationkey AS STRING), n_name), 'k INT, n STRING').n AS name, to_csv(named_struct('k', n_nationkey, 'r', n_regionkey)) AS csv, from_xml(concat('<p><a>', n_name, '</a></p>'), 'a STRING').a AS x, xpath_string(concat('<p><a>', n_name, '</a></p>'), 'p/a') AS xp FROM nation",
    "SELECT n_nationkey, n_name AS name, n_nationkey || ',' || n_regionkey AS csv, n_name AS x, n_name AS xp FROM nation",
)
_SOUND = "translate(upper(c_mktsegment), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', '01230127022455012623010702')"
_ONCE = f"left({_SOUND}, 1) || replace(substr({_SOUND}, 2), '7', '')"
for _d in "0123456":
    _ONCE = f"regexp_replace({_ONCE}, '{_d}+', '{_d}', 'g')"
sql(
    "string_functions_search",
    "SELECT c_custkey, soundex(c_mktsegment) AS sx, CAST(locate('I', c_mktsegment, 2) AS BIGINT) AS lo, array_join(flatten(sentences(concat(c_mktsegment, ' is one. It, ', c_mktsegment, ', is two!'))), '|') AS se, CAST(size(sentences(concat(c_mktsegment, ' is one. It is two.'))) AS BIGINT) AS ns, CAST(char_length(c_name) AS BIGINT) AS cl, CAST(find_in_set(c_mktsegment, concat('x,', c_mktsegment)) AS BIGINT) AS fi FROM customer",
    f"SELECT c_custkey, left(c_mktsegment, 1) || left(rpad(replace(substr({_ONCE}, 2), '0', ''), 3, '0'), 3) AS sx, CASE WHEN strpos(substr(c_mktsegment, 2), 'I') > 0 THEN strpos(substr(c_mktsegment, 2), 'I') + 1 ELSE 0 END::BIGINT AS lo, c_mktsegment || '|is|one|It|' || c_mktsegment || '|is|two' AS se, 2::BIGINT AS ns, length(c_name)::BIGINT AS cl, 2::BIGINT AS fi FROM customer",
)
sql(
    "date_functions_built",
    """SELECT o_orderkey, next_day(CAST(o_orderdate AS DATE), 'MON') AS monday, make_timestamp_ntz(year(o_orderdate), 2, 3, 4, 5, 6.5) AS made, CAST(o_orderdate + make_dt_interval(1, 2, 3, 4) AS TIMESTAMP_NTZ) AS later,
    CAST(weekday(o_orderdate) AS BIGINT) AS wd, to_date(date_format(o_orderdate, 'dd.MM.yyyy'), 'dd.MM.yyyy') AS back FROM orders""",
    """SELECT o_orderkey, (o_orderdate::DATE + (7 - (isodow(o_orderdate) - 1))::INTEGER)::DATE AS monday, make_timestamp(year(o_orderdate), 2, 3, 4, 5, 6.5) AS made, o_orderdate + INTERVAL '1 day 2 hours 3 minutes 4 seconds' AS later,
    isodow(o_orderdate) - 1 AS wd, o_orderdate::DATE AS back FROM orders""",
)
sql(
    "json_functions_variant",
    """SELECT event_id, t.k AS tuple_k, schema_of_json('{"a": 1, "b": ["x"]}') AS sch, variant_get(parse_json(concat('{"n": [', event_id, ', 7]}')), '$.n[1]', 'int') AS second, v.key AS var_key, CAST(v.value AS STRING) AS var_value, schema_of_variant(parse_json(CASE WHEN event_id % 2 = 0 THEN props ELSE concat('[', event_id, ']') END)) AS vs
    FROM events, LATERAL json_tuple(props, 'k') AS t(k), LATERAL variant_explode(parse_json(concat('{"n": ', event_id, '}'))) AS v""",
    """SELECT event_id, props->>'$.k' AS tuple_k, 'STRUCT<a: BIGINT, b: ARRAY<STRING>>' AS sch, 7::INTEGER AS second, 'n' AS var_key, event_id::VARCHAR AS var_value, CASE WHEN event_id % 2 = 0 THEN 'OBJECT<k: BIGINT>' ELSE 'ARRAY<BIGINT>' END AS vs FROM events""",
)
sql(
    "xml_functions",
    "SELECT n_nationkey, regexp_replace(to_xml(named_struct('k', n_nationkey, 'n', n_name)), '\\\\s+', '') AS x, array_join(xpath(concat('<p><a>', n_name, '</a><a>z</a></p>'), 'p/a/text()'), ',') AS xs, CAST(xpath_long(concat('<p><a>', n_nationkey, '</a><a>5</a></p>'), 'sum(p/a)') AS BIGINT) AS total, xpath_boolean(concat('<p><a>', n_nationkey, '</a></p>'), 'p/a > 3') AS big FROM nation",
    "SELECT n_nationkey, '<ROW><k>' || n_nationkey || '</k><n>' || replace(n_name, ' ', '') || '</n></ROW>' AS x, n_name || ',z' AS xs, (n_nationkey + 5)::BIGINT AS total, n_nationkey > 3 AS big FROM nation",
)


@query("SELECT event_id, make_time(hour(ts), minute(ts), second(ts))::VARCHAR AS made, date_trunc('hour', ts)::TIME::VARCHAR AS to_hour, date_trunc('minute', ts)::TIME::VARCHAR AS to_minute FROM events")
def time_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Times of day; their type is behind a setting of the session, which is put back once the plan is made."""
    key = "spark.sql.timeType.enabled"
    was = spark.conf.get(key)
    spark.conf.set(key, "true")
    try:
        load(spark, sf_dir, "events").createOrReplaceTempView("events")
        found = spark.sql(
            """SELECT event_id, t, time_trunc('HOUR', t) AS h, time_trunc('MINUTE', t) AS m FROM (SELECT event_id, make_time(hour(ts), minute(ts), CAST(second(ts) AS DECIMAL(16, 6))) AS t FROM events)"""
        ).select("event_id", F.col("t").cast("string").alias("made"), F.col("h").cast("string").alias("to_hour"), F.col("m").cast("string").alias("to_minute"))
        found.schema  # analysed under the setting
        return found
    finally:
        spark.conf.set(key, was)


@query(
    """SELECT c_custkey, xor(list_reduce([4294967295] || flatten(list_transform(string_split(c_name, ''), lambda x: [ord(x)::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1])),
    lambda a, b: CASE WHEN b >= 0 THEN xor(a, b) ELSE xor(a >> 1, 3988292384 * (a & 1)) END), 4294967295)::BIGINT AS crc, ((c_custkey >> 1) & 1)::INTEGER AS bit1, ((c_custkey >> 3) & 1)::INTEGER AS bit3, bit_count(c_custkey)::BIGINT AS bits FROM customer"""
)
def checksums_and_bits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """CRC-32, which SQL takes bit by bit, and single bits."""
    bit = lambda i: F.getbit(F.col("c_custkey"), F.lit(i)).cast("int")
    return load(spark, sf_dir, "customer").select("c_custkey", F.crc32(F.col("c_name").cast("binary")).alias("crc"), bit(1).alias("bit1"), bit(3).alias("bit3"), F.bit_count("c_custkey").cast("long").alias("bits"))
