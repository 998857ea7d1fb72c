"""Scalar functions over strings, dates and numbers, with the semantics of both engines made explicit."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from sparkloft.functions.times import micros
from sparkloft.plans.registry import query
from sparkloft.sources.tables import table


@query("""
    SELECT c_custkey, upper(c_name) AS up, lower(c_mktsegment) AS low, substring(c_name, 1, 8) AS head, c_name || '/' || c_mktsegment AS both,
      length(c_name) AS size, replace(c_name, '#', '-') AS dashed, lpad(CAST(c_nationkey AS VARCHAR), 4, '0') AS padded, reverse(c_name) AS back
    FROM customer""")
def strings_basic(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select(
        "c_custkey", F.upper("c_name").alias("up"), F.lower("c_mktsegment").alias("low"), F.substring("c_name", 1, 8).alias("head"),
        F.concat("c_name", F.lit("/"), "c_mktsegment").alias("both"), F.length("c_name").cast("long").alias("size"),
        F.replace("c_name", F.lit("#"), F.lit("-")).alias("dashed"), F.lpad(F.col("c_nationkey").cast("string"), 4, "0").alias("padded"),
        F.reverse("c_name").alias("back"))


@query("SELECT doc_id, length(text) AS chars, strlen(text) AS bytes FROM documents")
def string_lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select(
        "doc_id", F.length("text").cast("long").alias("chars"), F.octet_length("text").cast("long").alias("bytes"))


@query("""
    SELECT page_id, regexp_extract(url, '://([^/?#]+)', 1) AS host, regexp_replace(url, '[0-9]+', 'N', 'g') AS shape,
      len(regexp_extract_all(html, '<p>')) AS paragraphs FROM pages""")
def regular_expressions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select(
        "page_id", F.regexp_extract("url", "://([^/?#]+)", 1).alias("host"), F.regexp_replace("url", "[0-9]+", "N").alias("shape"),
        F.size(F.regexp_extract_all("html", F.lit("<p>"), F.lit(0))).cast("long").alias("paragraphs"))


@query("""
    SELECT word, count(*) AS n FROM (SELECT unnest(string_split(lower(text), ' ')) AS word FROM documents) GROUP BY 1 HAVING count(*) >= 20""")
def word_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = table(spark, sf_dir, "documents").select(F.explode(F.split(F.lower("text"), " ")).alias("word"))
    return words.groupBy("word").agg(F.count("*").alias("n")).where("n >= 20")


@query("SELECT doc_id, md5(text) AS md5, sha256(text) AS sha FROM documents")
def digests(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.md5("text").alias("md5"), F.sha2("text", 256).alias("sha"))


@query("""
    SELECT p_partkey, levenshtein(p_name, p_type) AS distance, split_part(p_name, ' ', 2) AS noun, instr(p_name, 'e') AS at,
      translate(p_name, 'aeiou', '12345') AS coded, ascii(p_brand) AS first,
      array_to_string(list_transform(string_split(p_name, ' '), lambda w: upper(w[1]) || lower(w[2:])), ' ') AS title FROM part""")
def strings_more(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select(
        "p_partkey", F.levenshtein("p_name", "p_type").cast("long").alias("distance"), F.split_part("p_name", F.lit(" "), F.lit(2)).alias("noun"),
        F.instr("p_name", "e").cast("long").alias("at"), F.translate("p_name", "aeiou", "12345").alias("coded"), F.ascii("p_brand").cast("int").alias("first"),
        F.initcap("p_name").alias("title"))


@query("""
    SELECT n_nationkey, n_name || nullif(n_name, 'NATION_1') AS joined, concat_ws('-', n_name, nullif(n_name, 'NATION_1')) AS listed,
      substring(n_name, 1, 3) AS head, substring(n_name, -2, 2) AS tail FROM nation""")
def null_strings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """concat with a null is null; concat_ws leaves it out. A substring from 0 is one from 1."""
    maybe = F.nullif("n_name", F.lit("NATION_1"))
    return table(spark, sf_dir, "nation").select(
        "n_nationkey", F.concat("n_name", maybe).alias("joined"), F.concat_ws("-", "n_name", maybe).alias("listed"),
        F.substring("n_name", 0, 3).alias("head"), F.substring("n_name", -2, 2).alias("tail"))


@query("SELECT date_trunc('day', ts) AS day, date_trunc('hour', ts) AS hour, count(*) AS n FROM events GROUP BY ALL")
def date_truncation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """date_trunc() takes times of the session's zone; these have none, so days are dates and hours are added to them."""
    day = F.col("ts").cast("date").cast("timestamp_ntz")
    rows = table(spark, sf_dir, "events").select(day.alias("day"), (day + F.make_dt_interval(F.lit(0), F.hour("ts"))).alias("hour"))
    return rows.groupBy("day", "hour").agg(F.count("*").alias("n"))


@query("""
    SELECT o_orderkey, year(o_orderdate) AS y, quarter(o_orderdate) AS q, month(o_orderdate) AS m, day(o_orderdate) AS d, dayofyear(o_orderdate) AS doy,
      weekofyear(o_orderdate) AS w, isodow(o_orderdate) - 1 AS weekday, dayofweek(o_orderdate) + 1 AS dow, last_day(o_orderdate) AS month_end FROM orders""")
def date_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """weekday counts from Monday 0, dow from Sunday 1."""
    d = F.col("o_orderdate")
    parts = {"y": F.year(d), "q": F.quarter(d), "m": F.month(d), "d": F.dayofmonth(d), "doy": F.dayofyear(d), "w": F.weekofyear(d), "weekday": F.weekday(d), "dow": F.dayofweek(d)}
    return table(spark, sf_dir, "orders").select("o_orderkey", *[c.cast("long").alias(n) for n, c in parts.items()], F.last_day(d).alias("month_end"))


@query("""
    SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, date_diff('day', o_orderdate, l_shipdate) AS days, CAST(o_orderdate + INTERVAL 1 MONTH AS DATE) AS month_on,
      strftime(o_orderdate, '%Y/%m') AS label, epoch_us(l_shipdate) - epoch_us(o_orderdate) AS micros
    FROM lineitem JOIN orders ON l_orderkey = o_orderkey""")
def date_arithmetic(spark: SparkSession, sf_dir: str) -> DataFrame:
    joined = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    return joined.select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.datediff("l_shipdate", "o_orderdate").cast("long").alias("days"),
        F.add_months("o_orderdate", 1).alias("month_on"), F.date_format("o_orderdate", "yyyy/MM").alias("label"),
        (micros(joined, "l_shipdate") - micros(joined, "o_orderdate")).alias("micros"))


@query("""
    SELECT o_orderkey, round(o_totalprice / 7, 4) AS seventh, o_orderkey % 7 AS rest, -o_orderkey % 7 AS negative_rest, CAST(floor(o_totalprice) AS BIGINT) AS low,
      CAST(ceil(o_totalprice) AS BIGINT) AS high, round(sqrt(o_totalprice), 6) AS root, round(ln(o_totalprice), 6) AS log, CAST(trunc(o_totalprice) AS BIGINT) AS whole
    FROM orders""")
def arithmetic(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A cast to an integer cuts; where rounding is meant, round() says so."""
    p, k = F.col("o_totalprice"), F.col("o_orderkey")
    return table(spark, sf_dir, "orders").select(
        "o_orderkey", F.round(p / 7, 4).alias("seventh"), (k % 7).alias("rest"), (-k % 7).alias("negative_rest"), F.floor(p).alias("low"),
        F.ceil(p).alias("high"), F.round(F.sqrt(p), 6).alias("root"), F.round(F.ln(p), 6).alias("log"), p.cast("long").alias("whole"))


@query("""
    SELECT p_partkey, round(p_size / 2, 0) AS half_up, round(-p_size / 2, 0) AS half_down, round_even(p_size / 2, 0) AS half_even, round_even(-p_size / 2, 0) AS negative_even,
      power(p_size, 2) AS square, round(power(p_size, 0.5), 6) AS root, sign(p_size - 25)::BIGINT AS sign, abs(p_size - 25)::BIGINT AS gap FROM part""")
def rounding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Halves go away from zero with round, to the even neighbour with bround."""
    size, half = F.col("p_size"), F.col("p_size") / 2
    return table(spark, sf_dir, "part").select(
        "p_partkey", F.round(half, 0).alias("half_up"), F.round(-half, 0).alias("half_down"), F.bround(half, 0).alias("half_even"), F.bround(-half, 0).alias("negative_even"),
        F.power(size, F.lit(2)).alias("square"), F.round(F.power(size, F.lit(0.5)), 6).alias("root"),
        F.sign(size - 25).cast("long").alias("sign"), F.abs(size - 25).cast("long").alias("gap"))


@query("""
    SELECT p_partkey, round(p_retailprice / nullif(p_size % 5, 0), 4) AS ratio, try_cast(split_part(p_brand, '#', 2) AS BIGINT) AS number, try_cast(p_name AS BIGINT) AS none,
      try_cast(9223372036854775806::HUGEINT + p_partkey AS BIGINT) AS sum, try_cast(-9223372036854775807::HUGEINT - p_partkey AS BIGINT) AS difference,
      try_cast(922337203685477580::HUGEINT * p_partkey AS BIGINT) AS product FROM part""")
def safe_arithmetic(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Division by zero, bad casts and overflow give null, not an error."""
    most = F.lit(9223372036854775806)
    return table(spark, sf_dir, "part").select(
        "p_partkey", F.round(F.try_divide("p_retailprice", F.col("p_size") % 5), 4).alias("ratio"),
        F.split_part("p_brand", F.lit("#"), F.lit(2)).try_cast("long").alias("number"), F.col("p_name").try_cast("long").alias("none"),
        F.try_add(most, "p_partkey").alias("sum"), F.try_subtract(-most - 1, F.col("p_partkey")).alias("difference"),
        F.try_multiply(F.lit(922337203685477580), "p_partkey").alias("product"))
