"""Queries of the stream operators over the given tables, and their DuckDB SQL."""

from __future__ import annotations

import uuid

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from millrace.functions import ndim, strings, tuples
from millrace.functions.random import bits, draw
from millrace.functions.threads import ThreadPool
from millrace.operators.frame import TextTable
from millrace.operators.groups import generate_groups, generate_many
from millrace.operators.index_mapper import IndexMapper
from millrace.operators.layout import BATCH, POS, kept_path, zip_frames
from millrace.operators.model import element_type, infer, infer_batches, load_graph
from millrace.operators.pyfun import PyFun, Scan
from millrace.operators.schema import ColumnDef, host_stream, row_type
from millrace.operators.stream import Stream, identity
from millrace.plans.registry import ORACLE_SQL, QUERIES, query, table  # noqa: F401
from millrace.sources.csv import csv_line, read_csv, read_csv_fast, read_csv_text, write_csv, write_csv_row
from millrace.sources.sinks import IMAGE, POINT, Batch, Range, decode_image, encode_image, point, to_ndarray, to_python
from millrace.streaming.adapter import micro_batches, stateless

def orders(spark: SparkSession, sf_dir: str, size: int, *columns: str) -> Stream:
    return Stream.create(table(spark, sf_dir, "orders").select("o_orderkey", *columns), "o_orderkey", size)


def shown(s: Stream) -> DataFrame:
    """A stream's rows with batch and position under plain names."""
    return s.df.withColumnsRenamed({BATCH: "b", POS: "pos"})


U = "(('0x' || substr(md5('{seed}:' || {key}), 1, 8))::BIGINT / 4294967296.0::DOUBLE)"
NUMBERED = "(SELECT *, row_number() OVER (ORDER BY o_orderkey) - 1 AS pos FROM orders)"


@query("""
WITH c AS (SELECT c_custkey, c_name, c_nationkey, row_number() OVER (ORDER BY c_custkey) - 1 AS pos FROM customer),
t AS (SELECT pos, pos // 2 AS b, c_name, c_nationkey + 1 AS age FROM c),
u AS (SELECT pos, b, array_to_string(list_transform(string_split(c_name, ''), lambda x: chr(ascii(x) + 1)), '') AS login, age + length(c_name) AS age FROM t)
SELECT b::BIGINT AS b, pos::BIGINT AS pos, login, age::BIGINT AS age FROM u WHERE age > 30
""")
def readme_pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = Stream.create(table(spark, sf_dir, "customer").select("c_custkey", F.col("c_name").alias("login"), F.col("c_nationkey").cast("long").alias("age")), "c_custkey", 2)
    s = s.transform("age", "age", lambda a: a + 1).copy("login", "name")
    s = s.transform("login", "login", lambda c: F.chr(F.ascii(c) + 1), dim=2)
    s = s.transform(["age", "login"], "age", lambda a, n: a + F.char_length(n))
    s = s.transform("name", "name", lambda n: F.concat(n, F.lit("!")), prob=0.5, seed=1).drop("name", "c_custkey")
    return shown(s.filter(["login", "age"], "age", lambda a: a > 30).buffer(2))


@query(f"SELECT (pos // 64)::BIGINT AS b, count(*)::BIGINT AS n, min(o_orderkey)::BIGINT AS lo, max(o_orderkey)::BIGINT AS hi FROM {NUMBERED} GROUP BY 1")
def create_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = orders(spark, sf_dir, 64)
    return s.df.groupBy(F.col(BATCH).alias("b")).agg(F.count("*").alias("n"), F.min("o_orderkey").alias("lo"), F.max("o_orderkey").alias("hi"))


@query(f"SELECT (pos // 7)::BIGINT AS b, count(*)::BIGINT AS n, sum(o_custkey)::BIGINT AS s FROM {NUMBERED} GROUP BY 1")
def rebatch_sum(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = orders(spark, sf_dir, 64, "o_custkey").rebatch(7)
    return s.df.groupBy(F.col(BATCH).alias("b")).agg(F.count("*").alias("n"), F.sum("o_custkey").alias("s"))


@query("SELECT (p // 5)::BIGINT AS b, count(*)::BIGINT AS n, sum(o_orderkey)::BIGINT AS s FROM (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) - 1 AS p FROM orders WHERE o_totalprice > 100000) GROUP BY 1")
def rebatch_after_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = orders(spark, sf_dir, 64, "o_totalprice")
    s = s.filter(s.columns, "o_totalprice", lambda p: p > 100000).rebatch(5)
    return s.df.groupBy(F.col(BATCH).alias("b")).agg(F.count("*").alias("n"), F.sum("o_orderkey").alias("s"))


@query(f"SELECT (pos // 8)::BIGINT AS b, pos::BIGINT AS pos, o_orderkey, o_custkey + 1 AS o_custkey FROM {NUMBERED}")
def transform_add(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shown(orders(spark, sf_dir, 8, "o_custkey").transform("o_custkey", "o_custkey", lambda x: x + 1))


@query(f"SELECT o_orderkey, o_custkey + o_orderkey AS o_custkey FROM {NUMBERED}")
def transform_two_to_one(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = orders(spark, sf_dir, 8, "o_custkey").transform(["o_custkey", "o_orderkey"], "o_custkey", lambda x, y: x + y)
    return s.df.select("o_orderkey", "o_custkey")


@query(f"SELECT o_orderkey, o_custkey + o_custkey AS double_key, o_custkey * o_custkey AS square_key FROM {NUMBERED}")
def transform_one_to_two(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = orders(spark, sf_dir, 8, "o_custkey").transform("o_custkey", ["double_key", "square_key"], lambda x: (x + x, x * x))
    return s.df.select("o_orderkey", "double_key", "square_key")


@query("SELECT c_custkey, array_to_string(list_transform(string_split(c_name, ''), lambda x: chr(ascii(x) + 1)), '') AS c_name FROM customer")
def transform_chars_dim2(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = Stream.create(table(spark, sf_dir, "customer").select("c_custkey", "c_name"), "c_custkey", 16)
    return s.transform("c_name", "c_name", lambda c: F.chr(F.ascii(c) + 1), dim=2).df.select("c_custkey", "c_name")


@query("SELECT vec_id, t.i::INTEGER AS i, embedding[t.i + 1]::DOUBLE * 2 AS v FROM embeddings, LATERAL unnest(range(len(embedding))) t(i)")
def transform_dim2_embedding(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = Stream.create(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"), "vec_id", 16)
    s = s.transform("embedding", "embedding", lambda x: x.cast("double") * 2.0, dim=2)
    return s.df.select("vec_id", F.posexplode("embedding").alias("i", "v"))


@query(f"""
WITH g AS (SELECT pos // 4 AS b, list_append(list(o_orderkey ORDER BY pos), 4) AS a FROM {NUMBERED} GROUP BY 1)
SELECT b::BIGINT AS b, t.i::INTEGER AS i, a[t.i + 1]::BIGINT AS v FROM g, LATERAL unnest(range(len(a))) t(i)
""")
def transform_dim0_append(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = orders(spark, sf_dir, 4).transform("o_orderkey", "o_orderkey", lambda a: F.array_append(a, F.lit(4).cast("long")), dim=0)
    return s.df.select(F.col(BATCH).alias("b"), F.posexplode("o_orderkey").alias("i", "v"))


@query(f"SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN -o_custkey ELSE o_custkey END AS o_custkey FROM {NUMBERED}")
def cond_transform(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = orders(spark, sf_dir, 8, "o_custkey", "o_orderstatus").transform("o_orderstatus", "done", lambda x: x == "F")
    return s.transform("o_custkey", "o_custkey", lambda x: -x, cond="done").df.select("o_orderkey", "o_custkey")


@query(f"SELECT o_orderkey, CASE WHEN {U.format(seed=42, key='pos')} < 0.5 THEN -o_custkey ELSE o_custkey END AS o_custkey FROM {NUMBERED}")
def prob_transform(spark: SparkSession, sf_dir: str) -> DataFrame:
    return orders(spark, sf_dir, 8, "o_custkey").transform("o_custkey", "o_custkey", lambda x: -x, prob=0.5, seed=42).df.select("o_orderkey", "o_custkey")


@query(f"WITH t AS (SELECT *, pos // 8 AS b FROM {NUMBERED}) SELECT b::BIGINT AS b, o_orderkey FROM t WHERE b IN (SELECT b FROM t GROUP BY b HAVING max(o_totalprice) > 400000)")
def filter_dim0(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = orders(spark, sf_dir, 8, "o_totalprice").filter([], "o_totalprice", lambda p: F.array_max(p) > 400000, dim=0)
    return s.df.select(F.col(BATCH).alias("b"), F.explode("o_orderkey").alias("o_orderkey"))


@query(f"SELECT (pos // 8)::BIGINT AS b, pos::BIGINT AS pos, o_orderkey, o_totalprice FROM {NUMBERED} WHERE o_totalprice > 200000")
def filter_dim1(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = orders(spark, sf_dir, 8, "o_totalprice")
    return shown(s.filter(s.columns, "o_totalprice", lambda p: p > 200000))


@query(f"SELECT (pos // 8)::BIGINT AS b, count(*)::BIGINT AS n_keys, count(*) FILTER (o_totalprice > 200000)::BIGINT AS n_prices FROM {NUMBERED} GROUP BY 1")
def filter_partial(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = orders(spark, sf_dir, 8, "o_totalprice").filter("o_totalprice", "o_totalprice", lambda p: p > 200000)
    return s.df.select(F.col(BATCH).alias("b"), F.size("o_orderkey").cast("long").alias("n_keys"), F.size("o_totalprice").cast("long").alias("n_prices"))


@query("WITH t AS (SELECT vec_id, list_filter(embedding, lambda v: v > 0) AS e FROM embeddings) SELECT vec_id, t2.i::INTEGER AS i, e[t2.i + 1] AS v FROM t, LATERAL unnest(range(len(e))) t2(i)")
def filter_dim2(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = Stream.create(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"), "vec_id", 16).filter("embedding", "embedding", lambda v: v > 0, dim=2)
    return s.df.select("vec_id", F.posexplode("embedding").alias("i", "v"))


@query("SELECT o_orderkey, o_custkey::VARCHAR AS cust FROM orders")
def copy_cast(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = orders(spark, sf_dir, 8, "o_custkey").insert_or_assign("cust", F.lit("")).copy("o_custkey", "cust")
    return s.df.select("o_orderkey", "cust")


@query(f"SELECT (pos // 8)::BIGINT AS b, pos::BIGINT AS pos, o_custkey FROM {NUMBERED}")
def drop_cols(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shown(orders(spark, sf_dir, 8, "o_custkey", "o_totalprice").drop("o_orderkey", "o_totalprice"))


@query(f"SELECT (pos // 8)::BIGINT AS b, pos::BIGINT AS pos, o_custkey, o_orderkey FROM {NUMBERED}")
def keep_cols(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shown(orders(spark, sf_dir, 8, "o_custkey", "o_totalprice").keep("o_custkey", "o_orderkey"))


@query(f"SELECT o_orderkey, (pos // 8 * 10)::BIGINT AS g FROM {NUMBERED}")
def generate_per_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return orders(spark, sf_dir, 8).generate("o_orderkey", "g", lambda b: b * 10, per_batch=True).df.select("o_orderkey", "g")


@query(f"SELECT o_orderkey, pos::BIGINT AS g FROM {NUMBERED}")
def generate_per_example(spark: SparkSession, sf_dir: str) -> DataFrame:
    return orders(spark, sf_dir, 8).generate("o_orderkey", "g", lambda p: p).df.select("o_orderkey", "g")


def turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", F.char_length("text").cast("long").alias("n")))).alias("r"))
    return rows.select("conv_id", F.transform("r", lambda x: x["n"]).alias("s"))


TURNS = "(SELECT conv_id, list(length(text) ORDER BY turn)::BIGINT[] AS s FROM conversations GROUP BY conv_id)"


@query(f"""
WITH t AS (SELECT conv_id, s, coalesce(sum(len(s)) OVER (ORDER BY conv_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS off FROM {TURNS})
SELECT conv_id, u.i::INTEGER AS i, (off + u.i)::BIGINT AS v FROM t, LATERAL unnest(range(len(s))) u(i)
""")
def generate_dim2(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = Stream.create(turns(spark, sf_dir), "conv_id", 4).running("s", "g")
    return s.df.select("conv_id", F.posexplode("g").alias("i", "v"))


@query(f"SELECT o_orderkey, {U.format(seed=42, key='pos')} AS u FROM {NUMBERED}")
def random_uniform(spark: SparkSession, sf_dir: str) -> DataFrame:
    return orders(spark, sf_dir, 8).random_fill("o_orderkey", "u", seed=42).df.select("o_orderkey", "u")


@query(f"""
WITH t AS (SELECT conv_id, s, row_number() OVER (ORDER BY conv_id) - 1 AS pos FROM {TURNS})
SELECT conv_id, u.i::INTEGER AS i, {U.format(seed=9, key="pos || ':' || u.i")} AS v FROM t, LATERAL unnest(range(len(s))) u(i)
""")
def random_fill_dim2(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = Stream.create(turns(spark, sf_dir), "conv_id", 4).random_fill("s", "g", depth=1, seed=9)
    return s.df.select("conv_id", F.posexplode("g").alias("i", "v"))


@query(f"""
WITH t AS (SELECT conv_id, s, (row_number() OVER (ORDER BY conv_id) - 1) // 4 AS b FROM {TURNS}), w AS (SELECT *, max(len(s)) OVER (PARTITION BY b) AS m FROM t)
SELECT conv_id, u.i::INTEGER AS i, CASE WHEN u.i < len(s) THEN s[u.i + 1] ELSE -1 END::BIGINT AS v, u.i < len(s) AS kept FROM w, LATERAL unnest(range(m)) u(i)
""")
def pad_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = Stream.create(turns(spark, sf_dir), "conv_id", 4).pad("s", "mask", F.lit(-1))
    return s.df.select("conv_id", F.posexplode(F.arrays_zip("s", "mask")).alias("i", "z")).select("conv_id", "i", F.col("z.s").alias("v"), F.col("z.mask").alias("kept"))


@query(f"SELECT pos::BIGINT AS pos, o_orderkey FROM {NUMBERED}")
def unpack_dim1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return orders(spark, sf_dir, 8).unpacked("o_orderkey", 1).withColumnRenamed(POS, "pos")


@query("""
WITH t AS (SELECT row_number() OVER (ORDER BY doc_id) - 1 AS pos, string_split(text, ' ') AS w FROM documents)
SELECT pos::BIGINT AS pos, u.i::INTEGER AS i, w[u.i + 1] AS words FROM t, LATERAL unnest(range(len(w))) u(i)
""")
def unpack_dim2(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", F.split("text", " ", -1).alias("words"))
    return Stream.create(docs, "doc_id", 16).unpacked("words", 2).withColumnsRenamed({POS: "pos", "_i2": "i"})


@query(f"SELECT (pos // 8)::BIGINT AS b, count(*)::INTEGER AS n FROM {NUMBERED} GROUP BY 1")
def batch_size(spark: SparkSession, sf_dir: str) -> DataFrame:
    return orders(spark, sf_dir, 8, "o_custkey").batch_sizes().withColumnRenamed(BATCH, "b")


@query(f"SELECT (pos // 10)::BIGINT AS b, o_orderkey, pos % 10 < 3 AS taken FROM {NUMBERED}")
def batch_take(spark: SparkSession, sf_dir: str) -> DataFrame:
    first, rest = orders(spark, sf_dir, 10).take(3)
    both = first.df.withColumn("taken", F.lit(True)).unionAll(rest.df.withColumn("taken", F.lit(False)))
    return both.select(F.col(BATCH).alias("b"), F.explode("o_orderkey").alias("o_orderkey"), "taken")


@query(f"SELECT b::BIGINT AS b, (2 * count(*))::BIGINT AS n, (sum(o_orderkey) + sum(-o_orderkey))::BIGINT AS s FROM (SELECT pos // 16 AS b, o_orderkey FROM {NUMBERED}) GROUP BY b")
def batch_push_back(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = orders(spark, sf_dir, 16)
    both = s.push_back(s.transform("o_orderkey", "o_orderkey", lambda x: -x))
    return both.df.select(F.col(BATCH).alias("b"), F.size("o_orderkey").cast("long").alias("n"), F.aggregate("o_orderkey", F.lit(0).cast("long"), lambda a, x: a + x).alias("s"))


@query(f"SELECT conv_id, len(s)::INTEGER AS n FROM {TURNS}")
def ndim_size(spark: SparkSession, sf_dir: str) -> DataFrame:
    return turns(spark, sf_dir).select("conv_id", ndim.sizes("s", 1)[0][0].alias("n"))


@query("WITH t AS (SELECT vec_id, list_resize(embedding, 70, 0.5) AS e FROM embeddings) SELECT vec_id, u.i::INTEGER AS i, e[u.i + 1]::FLOAT AS v FROM t, LATERAL unnest(range(70)) u(i)")
def ndim_resize(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = ndim.resize("embedding", F.array(F.array(F.lit(70))), 1, F.lit(0.5).cast("float"))
    return table(spark, sf_dir, "embeddings").select("vec_id", F.posexplode(e).alias("i", "v"))


@query("SELECT vec_id, 8 AS n, 8 AS m FROM embeddings")
def ndim_shape(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = ndim.shape(ndim.reshape("embedding", (8, 8)), 2)
    return table(spark, sf_dir, "embeddings").select("vec_id", s[0].alias("n"), s[1].alias("m"))


@query("SELECT vec_id, u.r::INTEGER AS r, v.c::INTEGER AS c, embedding[u.r * 8 + v.c + 1] AS v FROM embeddings, LATERAL unnest(range(8)) u(r), LATERAL unnest(range(8)) v(c)")
def ndim_reshape(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").select("vec_id", F.posexplode(ndim.reshape("embedding", (-1, 8))).alias("r", "row"))
    return rows.select("vec_id", "r", F.posexplode("row").alias("c", "v"))


@query("SELECT vec_id, u.i::INTEGER AS i, embedding[u.i + 1] AS v FROM embeddings, LATERAL unnest(range(len(embedding))) u(i)")
def ndim_flat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select("vec_id", F.posexplode(ndim.flat(ndim.reshape("embedding", (4, 4, 4)), 3)).alias("i", "v"))


@query(f"SELECT conv_id, len(s) = 4 AS same FROM {TURNS}")
def same_size(spark: SparkSession, sf_dir: str) -> DataFrame:
    return turns(spark, sf_dir).select("conv_id", ndim.same_size("s", F.array(*map(F.lit, range(4)))).alias("same"))


RANKED = "(SELECT *, row_number() OVER (ORDER BY ('0x' || substr(md5('{seed}:' || o_orderkey), 1, 8))::BIGINT, o_orderkey) - 1 AS r, count(*) OVER () AS n FROM {rows})"


@query(f"SELECT o_orderkey, CASE WHEN r < floor(0.5 * n + 0.5) THEN 0 WHEN r < floor(0.5 * n + 0.5) + floor(0.3 * n + 0.5) THEN 1 ELSE 2 END::INTEGER AS \"group\" FROM {RANKED.format(seed=3, rows='orders')}")
def groups_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    return generate_groups(table(spark, sf_dir, "orders").select("o_orderkey"), [0.5, 0.3, 0.2], "o_orderkey", 3)


@query(f"""
WITH base AS (SELECT o_orderkey, CASE WHEN r < floor(0.25 * n + 0.5) THEN 0 WHEN r < 2 * floor(0.25 * n + 0.5) THEN 1 ELSE 2 END AS g FROM {RANKED.format(seed=3, rows='orders')}),
again AS (SELECT o_orderkey, CASE WHEN r < floor(0.5 * n + 0.5) THEN 0 ELSE 1 END AS a FROM {RANKED.format(seed='3:0', rows='(SELECT o_orderkey FROM base WHERE g < 2)')})
SELECT o_orderkey, coalesce(a, g)::INTEGER AS group_0 FROM base LEFT JOIN again USING (o_orderkey)
""")
def groups_fixed_volatile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return generate_many(table(spark, sf_dir, "orders").select("o_orderkey"), 1, [0.25, 0.25], [0.5], "o_orderkey", 3)


@query("SELECT value, (row_number() OVER (ORDER BY first) - 1)::BIGINT AS idx FROM (SELECT o_orderpriority AS value, min(o_orderkey) AS first FROM orders GROUP BY 1)")
def index_mapper_unique(spark: SparkSession, sf_dir: str) -> DataFrame:
    return IndexMapper.unique(table(spark, sf_dir, "orders"), "o_orderpriority", "o_orderkey").table


@query("""
WITH m AS (SELECT value, row_number() OVER (ORDER BY first) - 1 AS idx FROM (SELECT c_mktsegment AS value, min(c_custkey) AS first FROM customer WHERE c_mktsegment NOT LIKE 'B%' GROUP BY 1))
SELECT c_custkey, coalesce(idx, 10)::BIGINT AS segment FROM customer LEFT JOIN m ON value = c_mktsegment
""")
def index_lookup_default(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer")
    return IndexMapper.unique(c.where(~F.col("c_mktsegment").startswith("B")), "c_mktsegment", "c_custkey").encode(c.select("c_custkey", "c_mktsegment"), "c_mktsegment", "segment", 10).select("c_custkey", "segment")


@query("SELECT c_custkey, c_mktsegment AS segment FROM customer")
def index_reverse(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment")
    m = IndexMapper.unique(c, "c_mktsegment", "c_custkey")
    return m.decode(m.encode(c, "c_mktsegment", "i"), "i", "segment").select("c_custkey", "segment")


@query("SELECT n_nationkey AS key, n_regionkey AS region FROM nation")
def frame_cast(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = TextTable.from_df(table(spark, sf_dir, "nation"), "n_nationkey")
    return t.cols(["n_nationkey", "n_regionkey"], ["int", "int"]).toDF("p", "key", "region").drop("p")


@query("SELECT n_regionkey AS key, arg_min(n_name, n_nationkey) AS value FROM nation GROUP BY 1")
def frame_index_col(spark: SparkSession, sf_dir: str) -> DataFrame:
    return TextTable.from_df(table(spark, sf_dir, "nation"), "n_nationkey").index_cols("n_regionkey", ["n_name"], "int")


@query("SELECT (row_number() OVER (ORDER BY n_nationkey) - 1)::BIGINT AS pos, n_name FROM nation WHERE n_nationkey <> (SELECT n_nationkey FROM nation ORDER BY 1 LIMIT 1 OFFSET 3)")
def frame_drop_row(spark: SparkSession, sf_dir: str) -> DataFrame:
    return TextTable.from_df(table(spark, sf_dir, "nation"), "n_nationkey").drop_row(3).cols(["n_name"]).withColumnRenamed(POS, "pos")


@query("SELECT page_id, to_base64(encode(html)) AS b FROM pages")
def base64_encode(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", strings.base64_encode("html").alias("b"))


@query("SELECT page_id, html FROM pages")
def base64_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", strings.base64_decode(strings.base64_encode("html")).cast("string").alias("html"))


@query("SELECT o_orderkey, o_orderkey % 24 < 12 AS done FROM orders")
def string_to_bool(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All words, some with spaces after them."""
    word = F.element_at(F.array(*map(F.lit, (*strings.TRUE, *strings.FALSE))), (F.col("o_orderkey") % 24 + 1).cast("int"))
    spaced = F.concat(word, F.when(F.col("o_orderkey") % 5 == 0, F.lit(" ")).otherwise(F.lit("")))
    return table(spark, sf_dir, "orders").select("o_orderkey", strings.string_to_bool(spaced).alias("done"))


@query("SELECT sum(o_custkey)::BIGINT AS total, count(*)::BIGINT AS n FROM orders")
def for_each_observe(spark: SparkSession, sf_dir: str) -> DataFrame:
    seen = Observation()
    s = orders(spark, sf_dir, 8, "o_custkey").observe(seen, F.sum("o_custkey").alias("total"), F.count("*").alias("n"))
    s.df.write.format("noop").mode("overwrite").save()
    return spark.createDataFrame([(seen.get["total"], seen.get["n"])], "total long, n long")


@query("""
WITH t AS (SELECT *, row_number() OVER (ORDER BY n_nationkey) - 1 AS pos FROM nation)
SELECT (pos // 4)::BIGINT AS b, count(*)::BIGINT AS n, sum(n_regionkey)::BIGINT AS regions, string_agg(n_name, '|' ORDER BY pos) AS names FROM t GROUP BY 1
""")
def to_python_iter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a host loop sees: a dict for each batch, with arrays of the columns."""
    dicts = Stream.create(table(spark, sf_dir, "nation"), "n_nationkey", 4).buffer(2).to_python()
    seen = [(b, len(d["n_nationkey"]), int(d["n_regionkey"].sum()), "|".join(d["n_name"])) for b, d in enumerate(dicts)]
    return spark.createDataFrame(seen, "b long, n long, regions long, names string")


@query(f"SELECT (pos // 8)::BIGINT AS b, pos::BIGINT AS pos, o_orderkey FROM {NUMBERED}")
def buffer_identity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shown(orders(spark, sf_dir, 8).buffer(2))


@query("SELECT vec_id, round(sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE))), 4) AS norm FROM embeddings")
def model_inference(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return infer_batches(rows, lambda: lambda x: np.sqrt((x.astype(np.float64) ** 2).sum(axis=1)), "embedding", "norm").select("vec_id", F.round("norm", 4).alias("norm"))


@query("SELECT o_orderkey, ('0x' || substr(md5('5:' || o_orderkey), 1, 8))::BIGINT AS h, 1 + floor(('0x' || substr(md5('5:' || o_orderkey), 1, 8))::BIGINT / 4294967296.0::DOUBLE * 6)::BIGINT AS die FROM orders")
def random_integer(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select("o_orderkey", bits(5, F.col("o_orderkey")).alias("h"), draw("integer", (1, 6), 5, F.col("o_orderkey")).alias("die"))


@query("""
WITH a AS (SELECT n_name, row_number() OVER (ORDER BY n_nationkey) AS p FROM nation), b AS (SELECT s_name, row_number() OVER (ORDER BY s_suppkey DESC) AS p FROM supplier)
SELECT (p - 1)::BIGINT AS pos, n_name, s_name FROM a JOIN b USING (p)
""")
def zip_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = table(spark, sf_dir, "nation"), table(spark, sf_dir, "supplier")
    return zip_frames(a.select("n_nationkey", "n_name"), ["n_nationkey"], b.select("s_suppkey", "s_name"), [F.col("s_suppkey").desc()]).select(F.col(POS).alias("pos"), "n_name", "s_name")


@query("SELECT p_partkey, 2 * p_size AS size, p_name FROM part WHERE p_size > 25")
def declared_pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A stream whose columns are declared: the source is read with their types."""
    part = table(spark, sf_dir, "part")
    columns = [ColumnDef(n, part.schema[n].dataType) for n in ("p_partkey", "p_size", "p_name")]
    s = Stream.create(part.select(*(F.col(f.name).cast(f.dataType) for f in row_type(columns).fields)), "p_partkey", 32)
    s = s.filter(s.columns, "p_size", lambda n: n > 25).transform("p_size", "size", lambda n: n * 2).rebatch(10)
    return s.df.select("p_partkey", "size", "p_name")


@query(f"SELECT o_orderkey, sqrt(o_totalprice::DOUBLE) AS root, o_orderstatus || '!' AS status FROM {NUMBERED}")
def transform_python(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = orders(spark, sf_dir, 8, "o_totalprice", "o_orderstatus")
    two = PyFun(lambda p, t: (np.sqrt(p.astype("float64")), t + "!"), ["double", "string"])
    return s.transform(["o_totalprice", "o_orderstatus"], ["root", "status"], two).df.select("o_orderkey", "root", "status")


@query("SELECT vec_id, t.i::INTEGER AS i, greatest(embedding[t.i + 1], 0) AS v FROM embeddings, LATERAL unnest(range(len(embedding))) t(i)")
def transform_python_dim2(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = Stream.create(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"), "vec_id", 16)
    return s.transform("embedding", "embedding", PyFun(lambda x: x.clip(lower=0), "float"), dim=2).df.select("vec_id", F.posexplode("embedding").alias("i", "v"))


def running_total() -> Scan:
    return Scan(0, lambda x: int(x.sum()), lambda a, b: a + b, lambda total, x: total + x.cumsum())


@query("SELECT o_orderkey, sum(o_custkey) OVER (ORDER BY o_orderkey)::BIGINT AS total FROM orders")
def transform_stateful(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A sum that runs on over all batches in order."""
    return orders(spark, sf_dir, 8, "o_custkey").transform("o_custkey", "total", PyFun(running_total(), "long", stateful=True)).df.select("o_orderkey", "total")


@query("SELECT o_orderkey, sum(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderkey)::BIGINT AS total FROM orders")
def transform_stateful_by(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A sum for each customer; a customer's orders may lie in several tasks."""
    s = orders(spark, sf_dir, 8, "o_custkey").transform("o_orderkey", "total", PyFun(running_total(), "long", stateful=True, by="o_custkey"))
    return s.df.select("o_orderkey", "total")


def every_third() -> Scan:
    """Its state is the number of elements so far."""
    return Scan(0, len, lambda a, b: a + b, lambda n, x: pd.Series(np.arange(n, n + len(x)) % 3 == 2))


@query(f"SELECT (pos // 8)::BIGINT AS b, pos::BIGINT AS pos, o_orderkey FROM {NUMBERED} WHERE pos % 3 = 2")
def filter_stateful(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shown(orders(spark, sf_dir, 8).filter("o_orderkey", "o_orderkey", PyFun(every_third(), "boolean", stateful=True)))


def squares() -> Scan:
    return Scan(0, lambda m: m, lambda a, b: a + b, lambda n, m: np.arange(n, n + m, dtype=np.int64) ** 2)


@query(f"SELECT o_orderkey, (pos * pos)::BIGINT AS g FROM {NUMBERED}")
def generate_stateful(spark: SparkSession, sf_dir: str) -> DataFrame:
    return orders(spark, sf_dir, 8).generate("o_orderkey", "g", PyFun(squares(), "long", stateful=True)).df.select("o_orderkey", "g")


@query("""
SELECT c_custkey, array_to_string(list_transform(list_zip(string_split(c_name, ''), string_split(upper(c_name), '')), lambda z: z[1] || z[2]), '') AS c_name FROM customer
""")
def transform_two_strings_dim2(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = Stream.create(table(spark, sf_dir, "customer").select("c_custkey", "c_name", F.upper("c_name").alias("other")), "c_custkey", 16)
    return s.transform(["c_name", "other"], "c_name", lambda a, b: F.concat(a, b), dim=2).df.select("c_custkey", "c_name")


@query("SELECT c_custkey, replace(c_name, '0', '') AS c_name FROM customer")
def filter_chars_dim2(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = Stream.create(table(spark, sf_dir, "customer").select("c_custkey", "c_name"), "c_custkey", 16)
    return s.filter("c_name", "c_name", lambda c: c != "0", dim=2).df.select("c_custkey", "c_name")


@query(f"SELECT o_orderkey FROM {NUMBERED}")
def for_each(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each batch is passed to a Python function, which fails on a wrong one; the values go on unchanged."""

    def look(pdf: pd.DataFrame) -> None:
        if not (pdf["o_orderkey"].map(len) <= 8).all():
            raise ValueError("a batch is too large")

    s = orders(spark, sf_dir, 8).for_each("o_orderkey", look, dim=0)
    return s.df.select(F.explode("o_orderkey").alias("o_orderkey"))


def nation(spark: SparkSession, sf_dir: str) -> TextTable:
    return TextTable.from_df(table(spark, sf_dir, "nation").select("n_nationkey", "n_name", "n_regionkey"), "n_nationkey")


def plain(t: TextTable) -> DataFrame:
    return t.data().withColumnRenamed(POS, "pos")


TEXTS = "(SELECT (row_number() OVER (ORDER BY n_nationkey) - 1)::BIGINT AS pos, n_nationkey::VARCHAR AS n_nationkey, n_name, n_regionkey::VARCHAR AS n_regionkey FROM nation)"


@query(f"SELECT *, length(n_name)::VARCHAR AS size FROM {TEXTS}")
def frame_insert_col(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = nation(spark, sf_dir)
    return plain(t.insert_col(t.cols(["n_name"]).select(POS, F.char_length("n_name").alias("value")), "size"))


@query(f"SELECT * FROM {TEXTS} UNION ALL SELECT count(*), '99', 'ATLANTIS', 'true' FROM nation UNION ALL SELECT count(*) + 1, 'x', '', 'y' FROM nation")
def frame_insert_row(spark: SparkSession, sf_dir: str) -> DataFrame:
    return plain(nation(spark, sf_dir).insert_row([99, "ATLANTIS", True]).insert_row(["x", "", "y"]))


@query("SELECT n_name, n_regionkey * 2 AS twice FROM nation")
def frame_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Typed rows on the host, one column by a conversion of its own."""
    rows = nation(spark, sf_dir).rows(["n_name", "n_regionkey"], ["string", "int"], [None, lambda c: c.cast("int") * 2])
    return spark.createDataFrame(rows, "n_name string, twice int")


@query("SELECT n_regionkey::VARCHAR AS a, n_name AS b, n_regionkey AS c FROM nation")
def frame_raw_cols(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = nation(spark, sf_dir)
    a, b = t.raw_cols(["n_regionkey", "n_name"])
    return spark.createDataFrame(list(zip(a, b, t.col("n_regionkey", "int"), strict=True)), "a string, b string, c int")


@query(f"SELECT pos, n_nationkey AS key, n_regionkey AS region FROM {TEXTS}")
def frame_header(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All columns renamed, one dropped by its name."""
    return plain(nation(spark, sf_dir).with_header(["key", "name", "region"]).drop_col("name"))


@query(f"SELECT pos, n_nationkey, CASE WHEN pos = 3 THEN 'elsewhere' ELSE n_name END AS n_name, n_regionkey FROM {TEXTS}")
def frame_set_value(spark: SparkSession, sf_dir: str) -> DataFrame:
    return plain(nation(spark, sf_dir).set_value(3, "n_name", "elsewhere"))


@query("SELECT n_name AS key, n_nationkey AS n_nationkey, n_regionkey AS n_regionkey FROM nation")
def frame_index_cols(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nation(spark, sf_dir).index_cols("n_name", ["n_nationkey", "n_regionkey"], kinds=["int", "int"])


@query("SELECT 3::BIGINT AS cols, count(*)::BIGINT AS n FROM nation")
def frame_shape(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = nation(spark, sf_dir)
    return spark.createDataFrame([(t.n_cols(), t.n_rows())], "cols long, n long")


@query("SELECT string_agg(lpad(k, m + 2, ' ') || '|' || lpad(n, w + 2, ' '), chr(10) ORDER BY p) || chr(10) AS text FROM (SELECT n_nationkey::VARCHAR AS k, n_name AS n, n_nationkey AS p, max(length(n_nationkey::VARCHAR)) OVER ()::INTEGER AS m, max(length(n_name)) OVER ()::INTEGER AS w FROM nation)")
def frame_print(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = TextTable.from_df(table(spark, sf_dir, "nation").select("n_nationkey", "n_name"), "n_nationkey").with_header([])
    return spark.createDataFrame([(str(t),)], "text string")


@query("SELECT c_custkey, (CASE c_mktsegment WHEN 'BUILDING' THEN 0 WHEN 'MACHINERY' THEN 2 WHEN 'AUTOMOBILE' THEN 1 ELSE -1 END)::BIGINT AS i FROM customer")
def mapper_insert(spark: SparkSession, sf_dir: str) -> DataFrame:
    m, new = IndexMapper.of(spark, ["BUILDING"]).insert("AUTOMOBILE").try_insert("BUILDING", "MACHINERY")
    if new != [False, True] or m.size() != 3 or not m.contains("MACHINERY") or m.values() != ["BUILDING", "AUTOMOBILE", "MACHINERY"] or m.at(1) != "AUTOMOBILE" or m.index_for("x", 7) != 7:
        raise AssertionError("the mapper differs")
    return m.encode(table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment"), "c_mktsegment", "i", -1).select("c_custkey", "i")


@query("""
WITH m AS (SELECT value, row_number() OVER (ORDER BY first) - 1 AS idx FROM (SELECT role AS value, min(conv_id * 1000 + turn) AS first FROM conversations GROUP BY 1))
SELECT c.conv_id, (row_number() OVER (PARTITION BY c.conv_id ORDER BY c.turn) - 1)::INTEGER AS i, idx::BIGINT AS v FROM conversations c JOIN m ON m.value = c.role
""")
def encode_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    talks = table(spark, sf_dir, "conversations").withColumn("place", F.col("conv_id") * 1000 + F.col("turn"))
    m = IndexMapper.unique(talks, "role", "place")
    lists = talks.groupBy("conv_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("turn", "role"))), lambda r: r["role"]).alias("roles"))
    return m.encode_array(lists, "conv_id", "roles", "v").select("conv_id", F.posexplode("v").alias("i", "v"))


HALVES = f"(SELECT conv_id, [s[1:2], s[3:]] AS h FROM {TURNS})"


def halves(spark: SparkSession, sf_dir: str) -> DataFrame:
    return turns(spark, sf_dir).select("conv_id", F.array(F.slice("s", 1, 2), F.slice("s", 3, 1 << 20)).alias("h"))


@query(f"SELECT conv_id, len(h)::INTEGER AS n, len(h[1])::INTEGER AS a, len(h[2])::INTEGER AS b FROM {HALVES}")
def ndim_size_two_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = ndim.sizes("h", 2)
    return halves(spark, sf_dir).select("conv_id", n[0][0].alias("n"), n[1][0].alias("a"), n[1][1].alias("b"))


@query(f"""
SELECT conv_id, u.i::INTEGER AS i, v.j::INTEGER AS j, CASE WHEN u.i < 2 AND v.j < len(h[u.i + 1]) THEN h[u.i + 1][v.j + 1] ELSE -1 END::BIGINT AS v
FROM {HALVES}, LATERAL unnest(range(3)) u(i), LATERAL unnest(range(CASE u.i WHEN 0 THEN 3 WHEN 1 THEN 1 ELSE 2 END)) v(j)
""")
def ndim_resize_two_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    sizes = F.array(F.array(F.lit(3)), F.array(F.lit(3), F.lit(1), F.lit(2)))
    rows = halves(spark, sf_dir).select("conv_id", F.posexplode(ndim.resize("h", sizes, 2, F.lit(-1).cast("long"))).alias("i", "r"))
    return rows.select("conv_id", "i", F.posexplode("r").alias("j", "v"))


@query(f"""
SELECT conv_id, u.i::INTEGER AS i, v.j::INTEGER AS j, CASE WHEN v.j < len(h[u.i + 1]) THEN h[u.i + 1][v.j + 1] ELSE 0 END::BIGINT AS v
FROM {HALVES}, LATERAL unnest(range(2)) u(i), LATERAL unnest(range(greatest(len(h[1]), len(h[2])))) v(j)
""")
def ndim_pad(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = halves(spark, sf_dir).select("conv_id", F.posexplode(ndim.pad("h", 2, F.lit(0).cast("long"))).alias("i", "r"))
    return rows.select("conv_id", "i", F.posexplode("r").alias("j", "v"))


MANY = RANKED.format(seed="{seed}", rows="(SELECT o_orderkey FROM base WHERE g < 2)")


@query(f"""
WITH base AS (SELECT o_orderkey, CASE WHEN r < floor(0.25 * n + 0.5) THEN 0 WHEN r < 2 * floor(0.25 * n + 0.5) THEN 1 ELSE 2 END AS g FROM {RANKED.format(seed=3, rows='orders')}),
a AS (SELECT o_orderkey, CASE WHEN r < floor(0.5 * n + 0.5) THEN 0 ELSE 1 END AS x FROM {MANY.format(seed='3:0')}),
b AS (SELECT o_orderkey, CASE WHEN r < floor(0.5 * n + 0.5) THEN 0 ELSE 1 END AS y FROM {MANY.format(seed='3:1')}),
c AS (SELECT o_orderkey, CASE WHEN r < floor(0.5 * n + 0.5) THEN 0 ELSE 1 END AS z FROM {MANY.format(seed='3:2')})
SELECT o_orderkey, coalesce(x, g)::INTEGER AS group_0, coalesce(y, g)::INTEGER AS group_1, coalesce(z, g)::INTEGER AS group_2 FROM base LEFT JOIN a USING (o_orderkey) LEFT JOIN b USING (o_orderkey) LEFT JOIN c USING (o_orderkey)
""")
def groups_three_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    return generate_many(table(spark, sf_dir, "orders").select("o_orderkey"), 3, [0.25, 0.25], [0.5], "o_orderkey", 3)


@query("SELECT (row_number() OVER (ORDER BY page_id) - 1)::BIGINT AS pos, page_id::VARCHAR AS page_id, url, 'a \"b\", \\ ' || chr(10) || page_id AS odd FROM pages")
def csv_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Written as CSV with quotes, escapes and line ends in fields, and read back."""
    odd = F.concat(F.lit('a "b", \\ \n'), F.col("page_id").cast("string"))
    t = TextTable.from_df(table(spark, sf_dir, "pages").select("page_id", "url", odd.alias("odd")), "page_id")
    path = kept_path(spark, "csv")
    write_csv(t, path)
    return plain(read_csv(spark, path))


@query("SELECT n_nationkey::VARCHAR AS n_nationkey, n_name FROM nation")
def csv_fast_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Many files, read by Spark's own reader."""
    t = TextTable.from_df(table(spark, sf_dir, "nation").select("n_nationkey", "n_name"), "n_nationkey")
    path = kept_path(spark, "csv")
    write_csv(t, path, single=False)
    return read_csv_fast(spark, path)


@query("SELECT 0::BIGINT AS pos, 'x' AS a, 'y, z' AS b UNION ALL SELECT 1, '', 'q\"' UNION ALL SELECT 2, '3', 'n'")
def csv_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A text on the host: a dropped line, blanks, escapes, an empty field, blank lines."""
    text = 'nothing\n a , b \n x ,"y, z" junk\n\n\n , "q\\""\r\n3,"\\n"\n'
    return plain(read_csv_text(spark, text, drop=1))


@query("SELECT event_id, user_id * 2 AS user_id FROM events WHERE user_id % 3 = 0")
def streaming_transform(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stateless operators on a streaming read of the events, drained into a table."""
    source = spark.readStream.schema(table(spark, sf_dir, "events").schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)
    plan = stateless(source, lambda s: s.keep("event_id", "user_id").filter(["event_id", "user_id"], "user_id", lambda u: u % 3 == 0).transform("user_id", "user_id", lambda u: u * 2))
    out = kept_path(spark, "events")
    plan.writeStream.format("parquet").option("path", out).option("checkpointLocation", f"{out}-checkpoint").trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(out)


@query("SELECT (pos // 100)::BIGINT AS b, count(*)::BIGINT AS n, min(event_id)::BIGINT AS lo, sum(pos)::BIGINT AS places FROM (SELECT event_id, row_number() OVER (ORDER BY event_id) - 1 AS pos, count(*) OVER () AS all FROM events) WHERE pos < \"all\" // 100 * 100 GROUP BY 1".replace("AS all", 'AS "all"'))
def streaming_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole batches of 100 from a stream of the events, written as they come."""
    source = spark.readStream.schema(table(spark, sf_dir, "events").schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir).select("event_id")
    out = kept_path(spark, "batches")
    micro_batches(source, "event_id", 100, lambda s, epoch: shown(s).write.mode("overwrite").parquet(f"{out}/rows/epoch={epoch}"), f"{out}/rest", f"{out}/checkpoint").awaitTermination()
    rows = spark.read.parquet(f"{out}/rows")
    return rows.groupBy("b").agg(F.count("*").alias("n"), F.min("event_id").alias("lo"), F.sum("pos").alias("places"))


@query("SELECT vec_id, t.i::INTEGER AS i, embedding[2 * t.i + 1]::DOUBLE + embedding[2 * t.i + 2]::DOUBLE AS v FROM embeddings, LATERAL unnest(range(len(embedding) // 2)) t(i)")
def tensor_inference(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A model on tensors of flat data and a shape: pairs of neighbours are added up."""
    shape = F.array(F.lit(-1).cast("long"), F.lit(2).cast("long"))
    rows = table(spark, sf_dir, "embeddings").select("vec_id", F.struct(F.transform("embedding", lambda x: x.cast("double")).alias("data"), shape.alias("shape")).alias("x"))
    out = infer(rows, lambda: lambda x: x[:, 0] + x[:, 1], ["x"], ["y"])
    return out.select("vec_id", F.posexplode("y.data").alias("i", "v"))


@query("SELECT o_orderkey, pos % 8 = 0 AS first, (pos // 8)::BIGINT AS b FROM (SELECT *, row_number() OVER (ORDER BY o_orderkey) - 1 AS pos FROM orders)")
def host_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Batches as host objects: taken apart, joined and given back as rows."""
    rows = []
    for b, d in enumerate(orders(spark, sf_dir, 8).to_python()):
        batch = Batch({"o_orderkey": d["o_orderkey"].tolist()})
        batch.insert_or_assign("first", [i == 0 for i in range(batch.batch_size())])
        head = batch.take(1)
        head.push_back(batch)
        rows += [(*r, b) for r in zip(head.at("o_orderkey"), head.at("first"), strict=True)]
    return spark.createDataFrame(rows, "o_orderkey long, first boolean, b long")


@query("SELECT vec_id, 8 AS h, 8 AS w, round(sum(embedding[u.i * 9 + 1]::DOUBLE), 4) AS trace FROM embeddings, LATERAL unnest(range(8)) u(i) GROUP BY 1")
def image_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Arrays as image values, read back from the column."""
    rows = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")

    def pack(frames):
        for pdf in frames:
            yield pd.DataFrame({"vec_id": pdf["vec_id"], "image": [encode_image(np.asarray(e, np.float32).reshape(8, 8)) for e in pdf["embedding"]]})

    def read(frames):
        for pdf in frames:
            images = [decode_image(v) for v in pdf["image"]]
            yield pd.DataFrame({"vec_id": pdf["vec_id"], "h": [x.shape[0] for x in images], "w": [x.shape[1] for x in images], "trace": [round(float(np.trace(x.astype(np.float64))), 4) for x in images]})

    kind = rows.schema["vec_id"].dataType.simpleString()
    return rows.mapInPandas(pack, f"vec_id {kind}, image {IMAGE}").mapInPandas(read, f"vec_id {kind}, h int, w int, trace double")


@query("""
SELECT n_nationkey, '"' || n_name || ', x",' || n_regionkey || ',"a \\" b",' AS by_columns, '"' || n_name || ', x",' || n_regionkey || ',"a \\" b",' || chr(10) AS by_host FROM nation
""")
def csv_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows written by column expressions and by the host's writer."""
    t = table(spark, sf_dir, "nation").select("n_nationkey", F.concat("n_name", F.lit(", x")).alias("a"), F.col("n_regionkey").cast("string").alias("b"))
    fields = [F.col("a"), F.col("b"), F.lit('a " b'), F.lit("")]
    lines = t.select("n_nationkey", "a", "b", csv_line(fields).alias("by_columns")).collect()
    rows = [(r["n_nationkey"], r["by_columns"], write_csv_row([r["a"], r["b"], 'a " b', ""])) for r in lines]
    return spark.createDataFrame(rows, f"n_nationkey {t.schema['n_nationkey'].dataType.simpleString()}, by_columns string, by_host string")


@query("SELECT o_orderkey, o_orderkey::VARCHAR AS text, (o_orderkey + 1)::BIGINT AS next, (o_orderstatus = 'F')::VARCHAR AS done FROM orders")
def string_conversions(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    text = strings.to_string("o_orderkey")
    done = strings.to_string(F.col("o_orderstatus") == "F")
    return o.select("o_orderkey", strings.string_to(text, "string").alias("text"), (strings.string_to(text, "bigint") + 1).alias("next"), done.alias("done"))


@query("SELECT n_nationkey, n_name FROM (SELECT *, row_number() OVER (ORDER BY n_nationkey) AS r, count(*) OVER () AS n FROM nation) WHERE r > 3 AND r <= n - 2")
def range_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A slice of a sequence view on the host."""
    t = TextTable.from_df(table(spark, sf_dir, "nation").select("n_nationkey", "n_name"), "n_nationkey")
    view = Range(iter(t.rows(["n_nationkey", "n_name"], ["int", "string"])))
    some = view[3:-2]
    if len(some) != len(view) - 5 or some[0] != view[3] or some[-1] != view[-3]:
        raise AssertionError("the view differs")
    return spark.createDataFrame(list(some), "n_nationkey int, n_name string")


@query("SELECT r_regionkey, count(n_nationkey)::BIGINT AS n FROM region LEFT JOIN nation ON n_regionkey = r_regionkey GROUP BY 1")
def threaded_jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A Spark job for each region, from threads of the driver."""
    nations, kind = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region").schema["r_regionkey"].dataType.simpleString()
    keys = [r["r_regionkey"] for r in table(spark, sf_dir, "region").select("r_regionkey").collect()]
    with ThreadPool(3) as pool:
        counts = pool.map(lambda k: nations.where(F.col("n_regionkey") == k).count(), keys)
    return spark.createDataFrame(list(zip(keys, counts, strict=True)), f"r_regionkey {kind}, n long")


@query("SELECT n_regionkey, t.i::INTEGER AS i, list(n_nationkey ORDER BY n_name)[t.i + 1] AS key, list(n_name ORDER BY n_name)[t.i + 1] AS name FROM nation, LATERAL unnest(range(5)) t(i) GROUP BY n_regionkey, t.i HAVING t.i < count(*)")
def unzip_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Structs of each region as an array for each field."""
    rows = table(spark, sf_dir, "nation").select("n_regionkey", "n_name", F.struct(F.col("n_nationkey").alias("key"), F.col("n_name").alias("name")).alias("s"))
    lists = tuples.unzip_groups(rows, "s", "n_regionkey", "n_name")
    return lists.select("n_regionkey", F.posexplode(F.arrays_zip("key", "name")).alias("i", "z")).select("n_regionkey", "i", "z.key", "z.name")


@query("SELECT n_nationkey, '(' || n_nationkey || ', ' || n_name || ')' AS text, length(n_name)::BIGINT * 10 + 1 AS size FROM nation")
def tuple_helpers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Host rows unzipped, transformed with their places, formatted and zipped again."""
    rows = [tuple(r) for r in table(spark, sf_dir, "nation").select("n_nationkey", "n_name").collect()]
    keys, names = tuples.unzip(rows)
    sizes = tuples.transformed_with_index([names, [1] * len(names)], lambda v, i: [len(x) * 10 for x in v] if i == 0 else v)
    total = tuples.transformed(zip(*sizes, strict=True), sum)
    if tuples.find(keys[2], keys) != 2 or not tuples.contains(names[0], names) or tuples.maybe_untuple(tuples.maybe_tuple(5)) != 5 or tuples.offsets(2, 3) != (2, 3, 4):
        raise AssertionError("the helpers differ")
    kind = table(spark, sf_dir, "nation").schema["n_nationkey"].dataType.simpleString()
    return spark.createDataFrame([(k, tuples.text((k, n)), t) for k, n, t in zip(keys, names, total, strict=True)], f"n_nationkey {kind}, text string, size long")


@query(f"SELECT (pos // 8)::BIGINT AS b, pos::BIGINT AS pos, o_orderkey, o_custkey * 2 AS twice FROM {NUMBERED}")
def stream_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Columns set, looked at and taken out; the stage that does nothing; a view for SQL."""
    s = identity(orders(spark, sf_dir, 8, "o_custkey").insert_or_assign("twice", F.col("o_custkey") * 2))
    if s.size() != 3 or not s.contains("twice") or s.type_of("twice").simpleString() != s.type_of("o_custkey").simpleString():
        raise AssertionError("the columns differ")
    s.drop("o_custkey").view("millrace_orders")
    return spark.sql("SELECT _batch AS b, _pos AS pos, o_orderkey, twice FROM millrace_orders")


@query("SELECT 0::BIGINT AS b, 0::INTEGER AS i, 2::BIGINT AS v UNION ALL SELECT 0, 1, 4 UNION ALL SELECT 2, 0, 6")
def host_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A stream of batches that the host has, one of them empty."""
    v = ColumnDef.of("v", "bigint")
    if v.dimensions() != 1:
        raise AssertionError("a number has one dimension in a batch")
    s = host_stream(spark, [v], [{"v": [1, 2]}, {}, {"v": [3]}]).transform("v", "v", lambda x: x * 2)
    return s.df.select(F.col(BATCH).alias("b"), F.posexplode("v").alias("i", "v"))


@query("SELECT vec_id, embedding[1] AS x, embedding[2] AS y FROM embeddings")
def point_column(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points as values of a column, and as pairs on the host."""
    rows = table(spark, sf_dir, "embeddings").select("vec_id", F.struct(F.col("embedding")[0].alias("x"), F.col("embedding")[1].alias("y")).cast(POINT).alias("p"))
    pairs = [(r["vec_id"], *point(r["p"])) for r in rows.collect()]
    return spark.createDataFrame(pairs, f"vec_id {rows.schema['vec_id'].dataType.simpleString()}, x float, y float")


@query(f"SELECT conv_id, list_sum(s)::BIGINT AS total, len(s)::BIGINT AS n FROM {TURNS}")
def ndarray_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nested columns as NumPy arrays on the host."""
    rows, kind = turns(spark, sf_dir), ndim.nested(element_type("int64"), 1)
    seen = []
    for r in rows.collect():
        values = to_python([r["s"]], ndim.nested(kind, 1))[0]
        if ndim.ndims(kind) != 1 or ndim.element_type(kind).simpleString() != "bigint" or to_ndarray(r["s"], ndim.element_type(kind)).dtype != values.dtype:
            raise AssertionError("the arrays differ")
        seen.append((r["conv_id"], int(values.sum()), len(values)))
    return spark.createDataFrame(seen, f"conv_id {rows.schema['conv_id'].dataType.simpleString()}, total long, n long")


def _field(number: int, value: bytes | int) -> bytes:
    """A field of a protobuf message: a number, or bytes with their length."""

    def varint(n: int) -> bytes:
        out = b""
        while n > 127:
            out, n = out + bytes([n & 127 | 128]), n >> 7
        return out + bytes([n])

    return varint(number << 3) + varint(value) if isinstance(value, int) else varint(number << 3 | 2) + varint(len(value)) + value


def doubling_graph() -> bytes:
    """An ONNX model of one node: y = x + x, of 64-bit floats."""
    shape = _field(2, b"".join(_field(1, _field(2, name)) for name in (b"n", b"m")))
    value = lambda name: _field(1, name) + _field(2, _field(1, _field(1, 11) + shape))
    node = _field(1, b"x") + _field(1, b"x") + _field(2, b"y") + _field(4, b"Add")
    graph = _field(1, node) + _field(2, b"g") + _field(11, value(b"x")) + _field(12, value(b"y"))
    return _field(1, 8) + _field(7, graph) + _field(8, _field(2, 13))


@query("SELECT vec_id, t.i::INTEGER AS i, embedding[t.i + 1]::DOUBLE * 2 AS v FROM embeddings, LATERAL unnest(range(len(embedding))) t(i)")
def graph_inference(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A model graph on tensors, loaded once in each worker."""
    graph = doubling_graph()
    shape = F.array(F.lit(8).cast("long"), F.lit(8).cast("long"))
    rows = table(spark, sf_dir, "embeddings").select("vec_id", F.struct(F.transform("embedding", lambda x: x.cast("double")).alias("data"), shape.alias("shape")).alias("x"))
    out = infer(rows, lambda: load_graph(graph), ["x"], ["y"])
    return out.select("vec_id", F.posexplode("y.data").alias("i", "v"))


@query("SELECT vec_id, t.i::INTEGER AS i, embedding[t.i + 33] AS a, embedding[t.i + 1] AS b FROM embeddings, LATERAL unnest(range(32)) t(i)")
def transform_swap_dim2(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two columns that take each other's elements."""
    rows = table(spark, sf_dir, "embeddings").select("vec_id", F.slice("embedding", 1, 32).alias("a"), F.slice("embedding", 33, 32).alias("b"))
    s = Stream.create(rows, "vec_id", 16).transform(["a", "b"], ["a", "b"], lambda x, y: (y, x), dim=2)
    return s.df.select("vec_id", F.posexplode(F.arrays_zip("a", "b")).alias("i", "z")).select("vec_id", "i", "z.a", "z.b")


@query("""
WITH t AS (SELECT vec_id, list_filter(range(1, 33), lambda i: embedding[i] > 0) AS k, embedding AS e FROM embeddings)
SELECT vec_id, u.i::INTEGER AS i, e[k[u.i + 1]] AS a, e[k[u.i + 1] + 32] AS b FROM t, LATERAL unnest(range(len(k))) u(i)
""")
def filter_two_columns_dim2(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").select("vec_id", F.slice("embedding", 1, 32).alias("a"), F.slice("embedding", 33, 32).alias("b"))
    s = Stream.create(rows, "vec_id", 16).filter(["a", "b"], "a", lambda x: x > 0, dim=2)
    return s.df.select("vec_id", F.posexplode(F.arrays_zip("a", "b")).alias("i", "z")).select("vec_id", "i", "z.a", "z.b")
