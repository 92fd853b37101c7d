"""One query for each operator over the driver's tables, with the same query in SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import approx_equal, data_uri_bytes, file_type, is_blank, is_true, parse_decimal, parse_int, parse_money, parse_percentage, spaced_label
from tessera.meta import dag, dag_frames
from tessera.operators import models, tables
from tessera.plans import Constant, PassThrough, Pipeline, PipelineBuilder
from tessera.registry import ORACLE_SQL, QUERIES, folder, query, table
from tessera.schema import Schema, schema_of
from tessera.sources import CsvDataset, ExcelDataset, JsonDataset, MemoryDataset, NoData, ParquetDataset, TextObject, files
from tessera.sources.workbooks import workbook
from tessera.validation import Level

__all__ = ["ORACLE_SQL", "QUERIES"]


# --- joins and aggregates ---------------------------------------------------------------------------------------------


@query("""
SELECT l_orderkey, l_linenumber, o_orderdate, c_custkey, c_name, l_quantity
FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey
""")
def join_chain_inner(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines, orders, customers = (table(spark, sf_dir, n) for n in ("lineitem", "orders", "customer"))
    joined = tables.chain_join(lines, (orders, "l_orderkey", "o_orderkey"), (customers, "o_custkey", "c_custkey"))
    return joined.select("l_orderkey", "l_linenumber", "o_orderdate", "c_custkey", "c_name", "l_quantity")


@query("""
SELECT n_name, CAST(count(*) AS BIGINT) AS orders,
  round(CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) / count(*), 4) AS avg_price
FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
GROUP BY n_name ORDER BY avg_price DESC, n_name
""")
def group_avg_desc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Partial sums by customer come before the joins, so only one row for each customer meets them."""
    by_customer = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(
        F.sum(F.col("o_totalprice").cast("decimal(18,2)")).alias("total"), F.count(F.lit(1)).alias("n")
    )
    joined = tables.chain_join(
        by_customer, (table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey"), "o_custkey", "c_custkey"),
        (table(spark, sf_dir, "nation").select("n_nationkey", "n_name"), "c_nationkey", "n_nationkey"),
    )
    grouped = joined.groupBy("n_name").agg(F.sum("n").alias("orders"), F.sum("total").alias("total"))
    mean = F.round(F.col("total").cast("double") / F.col("orders"), 4)
    return grouped.select("n_name", "orders", mean.alias("avg_price")).orderBy(F.col("avg_price").desc(), "n_name")


@query("""
SELECT CAST(count(*) AS BIGINT) AS n, min(l_quantity) AS least, max(l_quantity) AS largest, round(avg(l_quantity), 6) AS mean,
  round(stddev_pop(l_quantity), 6) AS deviation, CAST(sum(CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END) AS BIGINT) AS returned
FROM lineitem
""")
def global_aggregates(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = F.col("l_quantity")
    return table(spark, sf_dir, "lineitem").agg(
        F.count(F.lit(1)).alias("n"), F.min(q).alias("least"), F.max(q).alias("largest"), F.round(F.avg(q), 6).alias("mean"),
        F.round(F.stddev_pop(q), 6).alias("deviation"), F.count_if(F.col("l_returnflag") == "R").alias("returned"),
    )


@query("""
SELECT CAST(count(*) AS BIGINT) AS n, min(o_totalprice) AS least, max(o_totalprice) AS largest, round(avg(o_totalprice), 4) AS mean,
  round(stddev_pop(o_totalprice), 4) AS deviation FROM orders
""")
def value_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.summary(table(spark, sf_dir, "orders"), "o_totalprice").withColumns({c: F.round(c, 4) for c in ("mean", "deviation")})


@query("""
SELECT quality AS actual, CAST(count(*) FILTER (WHERE toxic = 0) AS BIGINT) AS predicted_0,
  CAST(count(*) FILTER (WHERE toxic = 1) AS BIGINT) AS predicted_1
FROM labels GROUP BY quality
""")
def confusion_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return models.confusion_matrix(table(spark, sf_dir, "labels"), "quality", "toxic")


# --- parsing ----------------------------------------------------------------------------------------------------------

_DIRTY = """
  SELECT p_partkey AS k, CASE p_partkey % 10
    WHEN 0 THEN CAST(p_size AS VARCHAR) || '%' WHEN 1 THEN ' ' || CAST(p_size AS VARCHAR) || ' %' WHEN 2 THEN '' WHEN 3 THEN 'abc'
    WHEN 4 THEN '$1,' || CAST(100 + p_size AS VARCHAR) || '.5' WHEN 5 THEN CAST(p_size AS VARCHAR) || '-' WHEN 6 THEN '1e3'
    WHEN 7 THEN CAST(p_size AS VARCHAR) || '.25' WHEN 8 THEN '+' || CAST(p_size AS VARCHAR) ELSE '99999999999' END AS s
  FROM part
"""


def _dirty(spark: SparkSession, sf_dir: str) -> DataFrame:
    size, case = F.col("p_size").cast("string"), F.col("p_partkey") % 10
    s = F.when(case == 0, F.concat(size, F.lit("%"))).when(case == 1, F.concat(F.lit(" "), size, F.lit(" %"))).when(case == 2, "")
    s = s.when(case == 3, "abc").when(case == 4, F.concat(F.lit("$1,"), (100 + F.col("p_size")).cast("string"), F.lit(".5")))
    s = s.when(case == 5, F.concat(size, F.lit("-"))).when(case == 6, "1e3").when(case == 7, F.concat(size, F.lit(".25")))
    s = s.when(case == 8, F.concat(F.lit("+"), size)).otherwise("99999999999")
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("k"), s.alias("s"))


_FORM = r"^\s*([+-]?([0-9][0-9,]*(\.[0-9]*)?|\.[0-9]+)|([0-9][0-9,]*(\.[0-9]*)?|\.[0-9]+)[+-])\s*$"


def _decimal_sql(text: str) -> str:
    bare = rf"regexp_replace(regexp_replace({text}, '[\s,]', '', 'g'), '^(.*)([+-])$', '\2\1')"
    return f"CASE WHEN regexp_matches({text}, '{_FORM}') THEN TRY_CAST({bare} AS DECIMAL(38,18)) END"


@query(f"SELECT k, round(CAST({_decimal_sql('s')} AS DOUBLE), 6) AS v FROM ({_DIRTY})")
def parse_decimals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _dirty(spark, sf_dir).select("k", F.round(parse_decimal(F.col("s")).cast("double"), 6).alias("v"))


_PERCENT_SQL = _decimal_sql("replace(s, '%', '')")
_AMOUNT_SQL = _decimal_sql("translate(s, '$,', '')")


@query(f"SELECT k, round(CAST({_PERCENT_SQL} AS DOUBLE) / 100, 6) AS v FROM ({_DIRTY})")
def parse_percentages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _dirty(spark, sf_dir).select("k", F.round(parse_percentage(F.col("s")).cast("double"), 6).alias("v"))


@query(f"SELECT k, round(coalesce(CAST({_AMOUNT_SQL} AS DOUBLE), 0), 6) AS v FROM ({_DIRTY})")
def parse_amounts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _dirty(spark, sf_dir).select("k", F.round(parse_money(F.col("s")).cast("double"), 6).alias("v"))


@query(rf"SELECT k, CASE WHEN regexp_matches(s, '^\s*[+-]?[0-9]+\s*$') THEN CAST(TRY_CAST(trim(s) AS INTEGER) AS DOUBLE) END AS v FROM ({_DIRTY})")
def parse_ints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _dirty(spark, sf_dir).select("k", parse_int(F.col("s")).cast("double").alias("v"))


@query("SELECT o_orderkey, coalesce(lower(nullif(o_orderstatus, 'P')) = 'f', false) AS flag FROM orders")
def is_true_flag(spark: SparkSession, sf_dir: str) -> DataFrame:
    flag = F.when(F.col("o_orderstatus") == "F", "t").when(F.col("o_orderstatus") == "O", "T")
    return table(spark, sf_dir, "orders").select("o_orderkey", is_true(flag).alias("flag"))


@query(r"SELECT k, s FROM (" + _DIRTY + r") WHERE NOT (s IS NULL OR regexp_matches(s, '^\s*$'))")
def blank_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _dirty(spark, sf_dir).where(~is_blank(F.col("s")))


@query(f"SELECT k, s, CAST(v AS DOUBLE) AS v FROM (SELECT k, s, {_decimal_sql('s')} AS v FROM ({_DIRTY})) WHERE v IS NOT NULL AND trim(s) <> ''")
def drop_incomplete(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _dirty(spark, sf_dir).withColumn("v", parse_decimal(F.col("s")).cast("double"))
    return tables.drop_incomplete(rows, ["v"], ["s"])


@query("""
SELECT l_orderkey, l_linenumber, CAST(l_quantity AS DOUBLE) AS quantity, CAST(l_discount AS DOUBLE) AS discount,
  CASE WHEN l_returnflag = 'R' THEN 1.0 ELSE 0.0 END::DOUBLE AS returned
FROM lineitem
""")
def feature_vector(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The vector is an array; its items are read back as columns."""
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "l_discount", (F.col("l_returnflag") == "R").alias("flag"))
    vectors = tables.feature_vector(rows, ["l_quantity", "l_discount", "flag"]).select("l_orderkey", "l_linenumber", "features")
    return tables.vector_columns(vectors, "features", ["quantity", "discount", "returned"])


# --- sources ----------------------------------------------------------------------------------------------------------


def _through(spark: SparkSession, sf_dir: str, make: Callable[[Schema, str], object]) -> DataFrame:
    """The customer table through a pipeline of one node into another format, read back."""
    path = f"{sf_dir}/customer.parquet"
    schema = schema_of(spark.read.parquet(path).schema)
    out = make(schema, f"{folder(spark)}/customer")
    PipelineBuilder("copy").add_node(PassThrough(), ParquetDataset("customer", schema, path), out).build().execute(spark)
    return out.load(spark)


@query("SELECT * FROM customer")
def passthrough_parquet(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _through(spark, sf_dir, lambda s, p: ParquetDataset("copy", s, p))


@query("SELECT * FROM customer")
def passthrough_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _through(spark, sf_dir, lambda s, p: CsvDataset("copy", s, p, one_file=False))


@query("SELECT * FROM customer")
def passthrough_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _through(spark, sf_dir, lambda s, p: JsonDataset("copy", s, p, lines=True))


@query("SELECT * FROM customer")
def passthrough_memory(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _through(spark, sf_dir, lambda s, p: MemoryDataset("copy", s))


@query("SELECT n_nationkey, n_name, n_regionkey FROM nation")
def single_json_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "nation")
    out = JsonDataset("nations", rows.schema, f"{folder(spark)}/nations.json")
    out.save(spark, rows)
    return out.load(spark)


@query("SELECT r_regionkey, r_name FROM region")
def single_csv_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "region")
    out = CsvDataset("regions", rows.schema, f"{folder(spark)}/regions.csv", options={"sep": ";"})
    out.save(spark, rows)
    return out.load(spark)


@query("SELECT n_nationkey, n_name, n_regionkey FROM nation")
def excel_read(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "nation")
    path = f"{folder(spark)}/nations.xlsx"
    files.write_bytes(spark, path, [workbook(rows.columns, [list(r) for r in rows.collect()])])  # 25 rows in any size
    return ExcelDataset("nations", rows.schema, path).load(spark)


@query("""
SELECT * FROM (VALUES ('png', 'Png'), ('gif', 'Gif'), ('webp', 'WebP'), ('mp4', 'Mp4'), ('text', 'Unknown')) t(name, kind)
""")
def file_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    starts = {"png": "89504E470D0A1A0A00", "gif": "474946383961", "webp": "524946460000000057454250", "mp4": "000000186674797069736F6D", "text": "616263"}
    pairs = F.array(*(F.struct(F.lit(k).alias("name"), F.unhex(F.lit(v)).alias("content")) for k, v in starts.items()))
    rows = spark.range(1).select(F.explode(pairs).alias("f")).select("f.*")
    encoded = F.concat(F.lit("data:image/x;base64,"), F.base64("content"))
    return rows.select("name", file_type(data_uri_bytes(encoded)).alias("kind"))


# --- sets, order, comparison ------------------------------------------------------------------------------------------

_KEYS = ("SELECT o_custkey AS k FROM orders", "SELECT c_custkey * 2 AS k FROM customer")


def _keys(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    doubled = table(spark, sf_dir, "customer").select((F.col("c_custkey") * 2).alias("k"))
    return table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("k")), doubled


@query(f"{_KEYS[0]} INTERSECT {_KEYS[1]}")
def keys_intersect(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.keys_in_both(*_keys(spark, sf_dir))


@query(f"{_KEYS[0]} EXCEPT {_KEYS[1]}")
def keys_left_only(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.keys_in_left_only(*_keys(spark, sf_dir))


@query(f"{_KEYS[1]} EXCEPT {_KEYS[0]}")
def keys_right_only(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.keys_in_left_only(*reversed(_keys(spark, sf_dir)))


@query("SELECT DISTINCT l_returnflag, l_linestatus FROM lineitem")
def distinct_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select("l_returnflag", "l_linestatus").distinct()


@query("""
SELECT CAST(p_partkey AS VARCHAR) AS key, p_partkey % 7 <> 0 AS price_ok, p_partkey % 5 <> 0 AS brand_ok,
  p_partkey % 7 <> 0 AND p_partkey % 5 <> 0 AS all_ok FROM part WHERE p_partkey % 11 <> 0
""")
def reconcile_tolerance(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.col("p_retailprice").alias("price"), F.col("p_brand").alias("brand"))
    moved = F.when(F.col("id") % 7 == 0, F.col("price") + 1).otherwise(F.col("price") + 0.001)
    other = parts.where("id % 11 <> 0").withColumns({"price": moved, "brand": F.when(F.col("id") % 5 != 0, F.col("brand"))})
    return tables.reconcile(parts, other, "id", ["price"], ["brand"])


@query("""
SELECT o_orderkey, coalesce(abs(a - b) < 0.01, a IS NULL AND b IS NULL) AS same FROM (
  SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE 1.0 END AS a, CASE WHEN o_orderkey % 2 = 0 THEN NULL ELSE 1.005 END AS b FROM orders)
""")
def approximate_equality(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = F.when(F.col("o_orderkey") % 3 != 0, 1.0), F.when(F.col("o_orderkey") % 2 != 0, 1.005)
    return table(spark, sf_dir, "orders").select("o_orderkey", approx_equal(a, b).alias("same"))


@query("""
SELECT user_id, event_id, event_type FROM (
  SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events) WHERE n = 1
""")
def distinct_by_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.first_by(table(spark, sf_dir, "events"), ["user_id"], ["ts", "event_id"]).select("user_id", "event_id", "event_type")


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 10")
def take_n(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.take(table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice"), 10, [F.col("o_totalprice").desc(), "o_orderkey"])


@query("SELECT c_custkey, c_name FROM customer ORDER BY c_custkey OFFSET 100")
def skip_n(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.skip(table(spark, sf_dir, "customer").select("c_custkey", "c_name"), 100, ["c_custkey"])


@query("""
SELECT o_orderkey, row_number() OVER (ORDER BY md5('42:' || CAST(o_orderkey AS VARCHAR))) > count(*) OVER () - CAST(floor(count(*) OVER () * 0.2) AS BIGINT) AS is_test
FROM orders
""")
def train_test_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.split(table(spark, sf_dir, "orders").select("o_orderkey"), "o_orderkey", 0.2, 42)


@query("""
SELECT l_orderkey, l_linenumber, round((l_quantity - low) / (high - low), 9) AS l_quantity_scaled,
  CASE WHEN l_returnflag = 'A' THEN 1.0 ELSE 0.0 END::DOUBLE AS flag_a, CASE WHEN l_returnflag = 'N' THEN 1.0 ELSE 0.0 END::DOUBLE AS flag_n
FROM lineitem, (SELECT min(l_quantity) AS low, max(l_quantity) AS high FROM lineitem)
""")
def minmax_onehot(spark: SparkSession, sf_dir: str) -> DataFrame:
    scaled = tables.min_max_scaled(table(spark, sf_dir, "lineitem"), ["l_quantity"])
    hot = tables.one_hot("l_returnflag", {"flag_a": "A", "flag_n": "N"})
    return scaled.select("l_orderkey", "l_linenumber", F.round("l_quantity_scaled", 9).alias("l_quantity_scaled"), *hot)


@query("""
SELECT o_orderkey, x FROM (SELECT o_orderkey, unnest(string_split(o_orderpriority, '-')) AS x FROM orders)
""")
def flatten_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.flatten(table(spark, sf_dir, "orders").select("o_orderkey", F.split("o_orderpriority", "-").alias("xs")), "xs", "x")


@query("""
SELECT c_custkey, CAST(count(o_orderkey) AS BIGINT) AS orders, max(o_totalprice) AS largest FROM customer LEFT JOIN orders ON c_custkey = o_custkey GROUP BY c_custkey
""")
def group_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").withColumnRenamed("o_custkey", "c_custkey")
    joined = tables.group_join(table(spark, sf_dir, "customer").select("c_custkey"), orders, "c_custkey", n=F.count(F.lit(1)), largest=F.max("o_totalprice"))
    return joined.select("c_custkey", F.coalesce("n", F.lit(0)).alias("orders"), "largest")


@query("""
SELECT n_regionkey, CAST(CAST(floor((n - 1) / 2) AS BIGINT) AS BIGINT) AS chunk, string_agg(n_name, ',' ORDER BY n_nationkey) AS names
FROM (SELECT *, row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) AS n FROM nation) GROUP BY 1, 2
""")
def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = tables.chunked(table(spark, sf_dir, "nation"), 2, "n_regionkey", ["n_nationkey"])
    names = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("n_nationkey", "n_name"))), lambda s: s["n_name"]), ",")
    return rows.groupBy("n_regionkey", "chunk").agg(names.alias("names"))


@query("SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderkey < (SELECT min(o_orderkey) FROM orders WHERE o_totalprice >= 498000)")
def take_while(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice")
    return tables.take_while(orders, F.col("o_totalprice") < 498000, ["o_orderkey"]).drop("o_totalprice")


@query("SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderkey >= (SELECT min(o_orderkey) FROM orders WHERE o_totalprice >= 498000)")
def skip_while(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice")
    return tables.skip_while(orders, F.col("o_totalprice") < 498000, ["o_orderkey"]).drop("o_totalprice")


@query("SELECT n_regionkey, string_agg(n_name, ',' ORDER BY n_name) AS names FROM nation GROUP BY n_regionkey")
def lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = tables.lookup(table(spark, sf_dir, "nation"), "n_regionkey", "n_name", "names")
    return found.select("n_regionkey", F.array_join("names", ",").alias("names"))


@query("SELECT bool_or(l_quantity > 49) AS any_large, bool_and(l_quantity > 0) AS all_positive FROM lineitem")
def any_and_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem")
    return lines.agg(F.bool_or(F.col("l_quantity") > 49).alias("any_large"), F.bool_and(F.col("l_quantity") > 0).alias("all_positive"))


@query('SELECT bool_or(l_quantity > 49) AS "any", bool_and(l_quantity > 49) AS "all" FROM lineitem')
def any_all_of_predicate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.any_all(table(spark, sf_dir, "lineitem"), F.col("l_quantity") > 49)


@query("""
SELECT o_custkey, arg_min(o_orderkey, (o_totalprice, o_orderkey)) AS least, arg_max(o_orderkey, (o_totalprice, o_orderkey)) AS largest
FROM orders GROUP BY o_custkey
""")
def min_by_max_by(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.extremes_by(table(spark, sf_dir, "orders"), "o_custkey", "o_orderkey", ["o_totalprice", "o_orderkey"])


@query("SELECT c_nationkey AS k FROM customer UNION SELECT s_nationkey FROM supplier")
def union_distinct(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("k")), table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("k"))
    return tables.union_distinct(a, b)


@query("SELECT 'customer' AS kind, c_name AS name FROM customer UNION ALL SELECT 'supplier', s_name FROM supplier")
def concatenation(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = table(spark, sf_dir, "customer").select(F.lit("customer").alias("kind"), F.col("c_name").alias("name"))
    return tables.concatenated(a, table(spark, sf_dir, "supplier").select(F.col("s_name").alias("name"), F.lit("supplier").alias("kind")))


# --- models -----------------------------------------------------------------------------------------------------------


@query("""
SELECT round(regr_intercept(l_extendedprice, l_quantity), 4) AS intercept, round(regr_slope(l_extendedprice, l_quantity), 6) AS slope FROM lineitem
""")
def ols_coefficients(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = models.least_squares(table(spark, sf_dir, "lineitem"), ["l_quantity"], "l_extendedprice")
    return spark.range(1).select(F.lit(round(model.intercept, 4)).alias("intercept"), F.lit(round(model.coefficients[0], 6)).alias("slope"))


_FAR = "SELECT 1700000000 + CAST(l_quantity AS DOUBLE) AS x, CAST(l_extendedprice AS DOUBLE) AS y FROM lineitem"


@query(f"SELECT round(regr_slope(y, x), 3) AS slope FROM ({_FAR})")
def ols_far_from_zero(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A feature like a time in seconds, whose squares would leave no digits for its spread."""
    rows = table(spark, sf_dir, "lineitem").select((F.lit(1700000000) + F.col("l_quantity").cast("double")).alias("x"), F.col("l_extendedprice").cast("double").alias("y"))
    return spark.range(1).select(F.lit(round(models.least_squares(rows, ["x"], "y").coefficients[0], 3)).alias("slope"))


@query("SELECT round(regr_intercept(l_extendedprice, l_quantity), 2) AS intercept, round(regr_slope(l_extendedprice, l_quantity), 4) AS slope FROM lineitem")
def gradient_descent_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = models.gradient_descent(table(spark, sf_dir, "lineitem"), ["l_quantity"], "l_extendedprice", least_change=1e-12)
    return spark.range(1).select(F.lit(round(model.intercept, 2)).alias("intercept"), F.lit(round(model.coefficients[0], 4)).alias("slope"))


@query("""
SELECT l_returnflag, round(avg(l_quantity), 6) AS average FROM lineitem GROUP BY l_returnflag
""")
def average_by_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.average_by(table(spark, sf_dir, "lineitem"), "l_returnflag", "l_quantity").withColumn("average", F.round("average", 6))


@query("""
WITH m AS (SELECT regr_intercept(l_extendedprice, l_quantity) AS a, regr_slope(l_extendedprice, l_quantity) AS b, avg(l_extendedprice) AS mean FROM lineitem),
s AS (SELECT l_extendedprice AS y, a + b * l_quantity AS p, mean FROM lineitem, m)
SELECT round(1 - sum((y - p) * (y - p)) / sum((y - mean) * (y - mean)), 8) AS r2_score, round(pow(corr(y, p), 2), 8) AS squared_correlation,
  round(avg(abs(y - p)), 3) AS mean_absolute_error, round(max(abs(y - p)), 3) AS max_error, round(sqrt(avg((y - p) * (y - p))), 3) AS root_mean_squared_error
FROM s
""")
def ols_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem")
    found = models.evaluate(rows, models.least_squares(rows, ["l_quantity"], "l_extendedprice"), "l_extendedprice")
    return found.select(*(F.round(c, 8 if c in ("r2_score", "squared_correlation") else 3).alias(c) for c in found.columns))


_FOLDS = """
WITH rows AS (SELECT o_orderkey, o_totalprice AS y, CAST(o_custkey AS DOUBLE) AS x,
  CAST(('0x' || substr(md5('42:' || CAST(o_orderkey AS VARCHAR)), 1, 8))::BIGINT % 3 AS INTEGER) AS fold FROM orders),
m AS (SELECT f.fold, regr_intercept(y, x) AS a, regr_slope(y, x) AS b FROM rows JOIN (VALUES (0), (1), (2)) f(fold) ON rows.fold <> f.fold GROUP BY f.fold),
g AS (SELECT fold, avg(y) AS mean FROM rows GROUP BY fold),
s AS (SELECT fold, 1 - sum((y - a - b * x) * (y - a - b * x)) / sum((y - mean) * (y - mean)) AS r2_score,
  avg(abs(y - a - b * x)) AS mae FROM rows JOIN m USING (fold) JOIN g USING (fold) GROUP BY fold)
"""


def _folds(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_totalprice").alias("y"), F.col("o_custkey").cast("double").alias("x"))
    return models.cross_validate(rows, "o_orderkey", ["x"], "y", 3, 42)


@query(_FOLDS + "SELECT fold, round(r2_score, 8) AS r2_score, round(mae, 3) AS mean_absolute_error FROM s")
def kfold_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _folds(spark, sf_dir).select("fold", F.round("r2_score", 8).alias("r2_score"), F.round("mean_absolute_error", 3).alias("mean_absolute_error"))


@query(_FOLDS + """
SELECT round(avg(r2_score), 8) AS mean_r2_score, round(stddev_pop(r2_score), 8) AS std_dev_r2_score, round(min(r2_score), 8) AS min_r2_score,
  round(max(r2_score), 8) AS max_r2_score, CAST(count(*) AS INTEGER) AS num_folds, round(abs(avg(r2_score) - 0.462), 8) AS difference_from_reference
FROM s
""")
def kfold_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = models.summarize_folds(_folds(spark, sf_dir), 0.462)
    names = ("mean_r2_score", "std_dev_r2_score", "min_r2_score", "max_r2_score", "difference_from_reference")
    return found.select("num_folds", *(F.round(c, 8).alias(c) for c in names))


@query("""
SELECT i, round(x, 9) AS x, round(exp(-0.5 * pow((x - 0.4) / 0.05, 2)) / (0.05 * sqrt(2 * pi())), 9) AS density
FROM (SELECT i, 0.2 + i * 0.004 AS x FROM range(101) t(i))
""")
def normal_curve(spark: SparkSession, sf_dir: str) -> DataFrame:
    return models.normal_curve(spark, 0.4, 0.05, 101).select("i", F.round("x", 9).alias("x"), F.round("density", 9).alias("density"))


# --- pipelines --------------------------------------------------------------------------------------------------------


def _sales(spark: SparkSession, sf_dir: str) -> dict[str, Pipeline]:
    """Two pipelines that share an entry."""
    place = folder(spark)
    schemas = {n: spark.read.parquet(f"{sf_dir}/{n}.parquet").schema for n in ("orders", "customer")}
    orders, customers = (ParquetDataset(n.title(), schemas[n], f"{sf_dir}/{n}.parquet") for n in ("orders", "customer"))
    totals = ParquetDataset("CustomerTotals", spark.createDataFrame([], "o_custkey long, n long").schema, f"{place}/totals")
    large = MemoryDataset("LargeCustomers", spark.createDataFrame([], "c_custkey long, c_name string, n long").schema)
    count = lambda data: data.groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n"))

    def pick(totals: DataFrame, customers: DataFrame, least: int) -> DataFrame:
        return customers.join(totals.where(F.col("n") >= least), F.col("c_custkey") == F.col("o_custkey")).select("c_custkey", "c_name", "n")

    first = PipelineBuilder("Totals").add_node(count, orders, totals, "CountOrders").build()
    second = PipelineBuilder("Selection").add_node(pick, {"totals": totals, "customers": customers, "least": Constant(20)}, large, "PickLarge")
    second.add_node(lambda data: NoData.result(), large, NoData.output(), "Announce")
    return {"Totals": first, "Selection": second.build()}


def _merged(spark: SparkSession, sf_dir: str) -> Pipeline:
    return Pipeline.merge(_sales(spark, sf_dir)).build()


@query("""
SELECT * FROM (VALUES ('Totals.CountOrders', 'Count Orders', CAST(0 AS INTEGER), 'Totals'), ('Selection.PickLarge', 'Pick Large', 1, 'Selection'),
  ('Selection.Announce', 'Announce', 2, 'Selection')) t(id, label, layer, pipeline)
""")
def dag_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dag_frames(spark, dag(_merged(spark, sf_dir)))["nodes"].select("id", spaced_label(F.regexp_replace("label", " ", "")).alias("label"), "layer", "pipeline")


@query("""
SELECT * FROM (VALUES ('Orders', 'Totals.CountOrders'), ('Totals.CountOrders', 'CustomerTotals'), ('CustomerTotals', 'Selection.PickLarge'),
  ('Customer', 'Selection.PickLarge'), ('Selection.PickLarge', 'LargeCustomers'), ('LargeCustomers', 'Selection.Announce')) t(source, target)
""")
def dag_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dag_frames(spark, dag(_merged(spark, sf_dir)))["edges"].select("source", "target")


@query("""
WITH t AS (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1),
l AS (SELECT count(*) AS n FROM customer JOIN t ON c_custkey = o_custkey WHERE t.n >= 20)
SELECT 'Totals.CountOrders' AS node, true AS success, (SELECT CAST(count(*) AS BIGINT) FROM orders) AS rows_in, (SELECT CAST(count(*) AS BIGINT) FROM t) AS rows_out
UNION ALL SELECT 'Selection.PickLarge', true, CAST((SELECT count(*) FROM t) + (SELECT count(*) FROM customer) AS BIGINT), CAST((SELECT n FROM l) AS BIGINT)
UNION ALL SELECT 'Selection.Announce', true, CAST((SELECT n FROM l) AS BIGINT), CAST(-1 AS BIGINT)
""")
def run_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _merged(spark, sf_dir).run(spark).to_frame(spark).select(
        "node", "success", "rows_in", F.coalesce("rows_out", F.lit(-1).cast("long")).alias("rows_out")
    )


@query("""
WITH t AS (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1 HAVING count(*) >= 20)
SELECT c_custkey, c_name, CAST(n AS BIGINT) AS n FROM customer JOIN t ON c_custkey = o_custkey
""")
def pipeline_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    merged = _merged(spark, sf_dir)
    merged.execute(spark)
    return next(e for s in merged.steps for e in s.outputs.values() if e.key == "LargeCustomers").load(spark)


@query("""
SELECT * FROM (VALUES ('Missing', 'NotFound'), ('NoTable', 'InvalidFormat'), ('OtherColumns', 'SchemaMismatch'), ('OtherTypes', 'TypeMismatch'),
  ('Empty', 'EmptyDataset')) t(key, type)
""")
def validation_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    place, region = folder(spark), table(spark, sf_dir, "region")
    TextObject("t", f"{place}/text.parquet").save(spark, "no table")
    ParquetDataset("e", region.schema, f"{place}/empty").save(spark, region.limit(0))
    other = spark.createDataFrame([], "r_regionkey int, r_name string, more string").schema
    wrong = spark.createDataFrame([], "r_regionkey string, r_name string").schema
    entries = [
        ParquetDataset("Missing", region.schema, f"{place}/none"), ParquetDataset("NoTable", region.schema, f"{place}/text.parquet"),
        ParquetDataset("OtherColumns", other, f"{sf_dir}/region.parquet"), ParquetDataset("OtherTypes", wrong, f"{sf_dir}/region.parquet"),
        ParquetDataset("Empty", region.schema, f"{place}/empty"), ParquetDataset("Good", region.schema, f"{sf_dir}/region.parquet").with_inspection_level(Level.DEEP),
    ]
    steps = PipelineBuilder("check").add_node(lambda **tables_: None, {e.key: e for e in entries}, NoData.output(), "Use")
    return steps.build().validate(spark).to_frame(spark).select("key", "type")
