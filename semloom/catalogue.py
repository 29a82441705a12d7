"""The queries registered for this library's own operators, each over whole tables, and their SQL."""

from __future__ import annotations

import io
import uuid
import warnings
import zipfile

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .context import Context, ContextManager, LocalAgent, TextFileContext
from .dataset import Dataset
from .functions.chunks import chunk_column, split_column, top_chunks
from .functions.groupby import GroupBySig
from .operators.cells import nearest, pairs_over
from .operators.provider import LocalProvider
from .operators.semantic import embedded, sem_filter, sem_join, sem_map
from .operators.semantic import sem_agg as aggregate_by_calls
from .operators.topk import VectorIndex
from .plans.physical import Implementation
from .plans.policy import MaxQuality, MaxQualityAtFixedCost, MinCost, MinCostAtFixedQuality, MinTime
from .session import QueryProcessorConfig
from .shared import fresh_path
from .sources import AudioFileDataset, FrameDataset, HTMLFileDataset, ImageFileDataset, IterDataset, MemoryDataset, PDFFileDataset, TextFileDataset, XLSFileDataset, get_local_source, resolve_datasource, table
from .types import make_schema

PLAIN = QueryProcessorConfig(optimizer_strategy="none")
_QUERIES: dict = {}
_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a query under its function's name, with its SQL."""

    def keep(f):
        _QUERIES[f.__name__] = f
        if sql is not None:
            _SQL[f.__name__] = sql
        return f

    return keep


def _t(spark: SparkSession, sf: str, name: str, *cols: str) -> Dataset:
    data = table(spark, sf, name)
    return data.project(list(cols)) if cols else data


def _run(data: Dataset, config: QueryProcessorConfig = PLAIN) -> DataFrame:
    return data.run(config).df


def queries() -> dict:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


# -- scans, filters, maps -------------------------------------------------------


@query("""SELECT c_mktsegment, count(*) AS "count(o_orderkey)", CAST(sum(CAST(floor(o_totalprice) AS BIGINT)) AS BIGINT) AS "sum(cents)"
FROM (SELECT * FROM orders WHERE o_totalprice > 1000) o JOIN customer c ON o.o_custkey IS NOT DISTINCT FROM c.c_custkey GROUP BY c_mktsegment""")
def flagship(spark, sf):
    orders = _t(spark, sf, "orders", "o_orderkey", "o_custkey", "o_totalprice").filter(F.col("o_totalprice") > 1000, ["o_totalprice"])
    orders = orders.map({"cents": F.floor("o_totalprice").cast("long"), "c_custkey": F.col("o_custkey")}, [{"name": "cents", "type": int, "desc": ""}, {"name": "c_custkey", "type": int, "desc": ""}])
    joined = orders.join(_t(spark, sf, "customer", "c_custkey", "c_mktsegment"), "c_custkey")
    return _run(joined.groupby(GroupBySig(["c_mktsegment"], ["count", "sum"], ["o_orderkey", "cents"])))


@query("SELECT c_custkey, c_name, c_mktsegment FROM customer")
def scan_project(spark, sf):
    return _run(_t(spark, sf, "customer").project(["c_mktsegment", "c_custkey", "c_name"]))


@query("SELECT o_orderkey, o_orderpriority FROM orders WHERE o_orderkey % 7 = 3")
def filter_udf(spark, sf):
    return _run(_t(spark, sf, "orders", "o_orderkey", "o_orderpriority").filter(lambda r: r["o_orderkey"] % 7 == 3, "o_orderkey"))


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice > 150000 AND o_orderstatus = 'O'")
def filter_column(spark, sf):
    return _run(_t(spark, sf, "orders").filter((F.col("o_totalprice") > 150000) & (F.col("o_orderstatus") == "O"), ["o_totalprice", "o_orderstatus"]).project(["o_orderkey", "o_totalprice"]))


@query("SELECT l_orderkey, l_linenumber, CAST(l_linenumber * 10 AS BIGINT) AS ten, l_returnflag || '-' || l_linestatus AS flags FROM lineitem")
def map_udf(spark, sf):
    cols = [{"name": "ten", "type": int, "desc": "ten times the line"}, {"name": "flags", "type": str, "desc": "both flags"}]
    made = _t(spark, sf, "lineitem", "l_orderkey", "l_linenumber", "l_returnflag", "l_linestatus").map(lambda r: {"ten": r["l_linenumber"] * 10, "flags": f"{r['l_returnflag']}-{r['l_linestatus']}"}, cols)
    return _run(made.project(["l_orderkey", "l_linenumber", "ten", "flags"]))


@query("SELECT l_orderkey, l_linenumber, CAST(l_linenumber * 10 AS BIGINT) AS ten FROM lineitem")
def map_column(spark, sf):
    return _run(_t(spark, sf, "lineitem", "l_orderkey", "l_linenumber").map({"ten": F.col("l_linenumber") * 10}, [{"name": "ten", "type": int, "desc": ""}]))


@query("SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents")
def flat_map_udf(spark, sf):
    return _run(_t(spark, sf, "documents", "doc_id", "text").flat_map(lambda r: [{"line": x} for x in r["text"].split("\n")], [{"name": "line", "type": str, "desc": ""}]).project(["doc_id", "line"]))


@query("SELECT conv_id, turn, CASE WHEN role = 'user' THEN turn * 2 END AS twice FROM conversations")
def flat_map_empty(spark, sf):
    return _run(_t(spark, sf, "conversations", "conv_id", "turn", "role").flat_map(lambda r: [{"twice": r["turn"] * 2}] if r["role"] == "user" else [], [{"name": "twice", "type": int, "desc": ""}]).project(["conv_id", "turn", "twice"]))


# -- joins -----------------------------------------------------------------------

_JOIN = """SELECT {key} AS doc_id, d.lang, d.source, l.quality, l.toxic FROM (SELECT doc_id, lang, source FROM documents) d {how} JOIN (SELECT doc_id, quality, toxic FROM labels) l ON d.doc_id IS NOT DISTINCT FROM l.doc_id"""


def _documents_labels(spark, sf, how):
    return _run(_t(spark, sf, "documents", "doc_id", "lang", "source").join(_t(spark, sf, "labels"), "doc_id", how))


@query(_JOIN.format(key="d.doc_id", how="INNER"))
def join_inner(spark, sf):
    return _documents_labels(spark, sf, "inner")


@query(_JOIN.format(key="d.doc_id", how="LEFT"))
def join_left(spark, sf):
    return _documents_labels(spark, sf, "left")


@query(_JOIN.format(key="l.doc_id", how="RIGHT"))
def join_right(spark, sf):
    return _documents_labels(spark, sf, "right")


@query(_JOIN.format(key="coalesce(d.doc_id, l.doc_id)", how="FULL"))
def join_outer(spark, sf):
    return _documents_labels(spark, sf, "outer")


@query("SELECT a.nk AS nk, a.n AS n, b.n AS n_right FROM (SELECT CASE WHEN o_orderkey % 50 <> 0 THEN o_custkey END AS nk, count(*) AS n FROM orders GROUP BY 1) a JOIN (SELECT CASE WHEN c_custkey % 2 = 0 THEN c_custkey END AS nk, count(*) AS n FROM customer GROUP BY 1) b ON a.nk IS NOT DISTINCT FROM b.nk")
def join_null_keys(spark, sf):
    orders = spark.read.parquet(f"{sf}/orders.parquet").select(F.when(F.col("o_orderkey") % 50 != 0, F.col("o_custkey")).alias("nk")).groupBy("nk").agg(F.count(F.lit(1)).alias("n"))
    customers = spark.read.parquet(f"{sf}/customer.parquet").select(F.when(F.col("c_custkey") % 2 == 0, F.col("c_custkey")).alias("nk")).groupBy("nk").agg(F.count(F.lit(1)).alias("n"))
    return _run(FrameDataset(orders, "o").join(FrameDataset(customers, "c"), "nk"))


@query("SELECT a.o_custkey, a.n, b.n AS n_right FROM (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1) a JOIN (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1) b ON a.o_custkey = b.o_custkey WHERE a.n > 8 AND b.n < 12")
def join_two_lambdas(spark, sf):
    """Two branches of one dataset, told apart by the functions that filter them."""
    counts = FrameDataset(spark.read.parquet(f"{sf}/orders.parquet").groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n")))
    return _run(counts.filter(lambda r: r["n"] > 8, "n").join(counts.filter(lambda r: r["n"] < 12, "n"), "o_custkey"))


@query("SELECT n_nationkey, n_nationkey + 1 AS x, n_nationkey + 2 AS x_right FROM nation")
def join_two_maps(spark, sf):
    nations, x = _t(spark, sf, "nation", "n_nationkey"), [{"name": "x", "type": int, "desc": ""}]
    return _run(nations.map(lambda r: {"x": r["n_nationkey"] + 1}, x).join(nations.map(lambda r: {"x": r["n_nationkey"] + 2}, x), "n_nationkey"))


@query("SELECT a.n_nationkey, a.n_name AS name, b.r_name AS name_right FROM nation a JOIN region b ON a.n_nationkey = b.r_regionkey")
def join_two_frames(spark, sf):
    """Two frames without ids."""
    left = FrameDataset(spark.read.parquet(f"{sf}/nation.parquet").select("n_nationkey", F.col("n_name").alias("name")))
    right = FrameDataset(spark.read.parquet(f"{sf}/region.parquet").select(F.col("r_regionkey").alias("n_nationkey"), F.col("r_name").alias("name")))
    return _run(left.join(right, "n_nationkey"))


# -- aggregates --------------------------------------------------------------------


@query("SELECT count(*) AS count FROM lineitem")
def agg_count(spark, sf):
    return _run(_t(spark, sf, "lineitem").count())


@query("SELECT avg(l_linenumber) AS average FROM lineitem")
def agg_average(spark, sf):
    return _run(_t(spark, sf, "lineitem", "l_linenumber").average())


@query("SELECT CAST(sum(l_partkey) AS BIGINT) AS sum FROM lineitem")
def agg_sum(spark, sf):
    return _run(_t(spark, sf, "lineitem", "l_partkey").sum())


@query("SELECT min(o_totalprice) AS min FROM orders")
def agg_min(spark, sf):
    return _run(_t(spark, sf, "orders", "o_totalprice").min())


@query("SELECT max(o_totalprice) AS max FROM orders")
def agg_max(spark, sf):
    return _run(_t(spark, sf, "orders", "o_totalprice").max())


@query('SELECT l_returnflag, l_linestatus, count(*) AS "count(l_orderkey)" FROM lineitem GROUP BY 1, 2')
def groupby_count(spark, sf):
    return _run(_t(spark, sf, "lineitem").groupby(GroupBySig(["l_returnflag", "l_linestatus"], ["count"], ["l_orderkey"])))


@query('SELECT l_suppkey, CAST(sum(l_linenumber) AS BIGINT) AS "sum(l_linenumber)" FROM lineitem GROUP BY 1')
def groupby_sum(spark, sf):
    return _run(_t(spark, sf, "lineitem").groupby(GroupBySig(["l_suppkey"], ["sum"], ["l_linenumber"])))


@query('SELECT l_suppkey, avg(l_linenumber) AS "average(l_linenumber)" FROM lineitem GROUP BY 1')
def groupby_average(spark, sf):
    return _run(_t(spark, sf, "lineitem").groupby(GroupBySig(["l_suppkey"], ["average"], ["l_linenumber"])))


@query('SELECT event_type, min(value) AS "min(value)", max(user_id) AS "MAX(user_id)" FROM events GROUP BY 1')
def groupby_min_max(spark, sf):
    return _run(_t(spark, sf, "events").groupby(GroupBySig(["event_type"], ["min", "MAX"], ["value", "user_id"])))


@query("SELECT conv_id, array_to_string(list_sort(list(coalesce(turn_or_null::VARCHAR, '-'))), ',') AS turns FROM (SELECT conv_id, CASE WHEN turn % 2 = 0 THEN turn END AS turn_or_null FROM conversations) GROUP BY 1")
def groupby_list(spark, sf):
    data = _t(spark, sf, "conversations", "conv_id", "turn").map({"half": F.when(F.col("turn") % 2 == 0, F.col("turn"))}, [{"name": "half", "type": int, "desc": ""}])
    df = _run(data.groupby(GroupBySig(["conv_id"], ["list"], ["half"])))
    return df.select("conv_id", F.array_join(F.array_sort(F.transform(F.col("`list(half)`"), lambda x: F.coalesce(x.cast("string"), F.lit("-")))), ",").alias("turns"))


@query("SELECT conv_id, array_to_string(list_sort(list(DISTINCT role)), ',') AS roles FROM conversations GROUP BY 1")
def groupby_set(spark, sf):
    df = _run(_t(spark, sf, "conversations").groupby(GroupBySig(["conv_id"], ["set"], ["role"])))
    return df.select("conv_id", F.array_join(F.col("`set(role)`"), ",").alias("roles"))


@query('SELECT count(*) AS "count(o_orderkey)", max(o_custkey) AS "max(o_custkey)" FROM orders')
def groupby_nokey(spark, sf):
    return _run(_t(spark, sf, "orders").groupby(GroupBySig([], ["count", "max"], ["o_orderkey", "o_custkey"])))


@query('SELECT n AS "count(o_orderkey)", count(*) AS "count(o_custkey)" FROM (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1) GROUP BY 1')
def groupby_nested(spark, sf):
    inner = _t(spark, sf, "orders").groupby(GroupBySig(["o_custkey"], ["count"], ["o_orderkey"]))
    return _run(inner.groupby(GroupBySig(["count(o_orderkey)"], ["count"], ["o_custkey"])))


@query('SELECT l_orderkey, CAST(sum(q) AS BIGINT) AS "sum(parts)" FROM (SELECT l_orderkey, list_sum(list_value(l_partkey, l_suppkey)) AS q FROM lineitem) GROUP BY 1')
def groupby_sum_of_lists(spark, sf):
    data = FrameDataset(spark.read.parquet(f"{sf}/lineitem.parquet").select("l_orderkey", F.array("l_partkey", "l_suppkey").alias("parts")), "lists")
    return _run(data.groupby(GroupBySig(["l_orderkey"], ["sum"], ["parts"])))


@query("SELECT l_suppkey FROM (SELECT l_suppkey, count(*) AS n FROM lineitem GROUP BY 1) WHERE n > 5")
def groupby_having(spark, sf):
    return _run(_t(spark, sf, "lineitem").groupby(GroupBySig(["l_suppkey"], ["count"], ["l_orderkey"])).filter(F.col("`count(l_orderkey)`") > 5).project(["l_suppkey"]))


@query("SELECT DISTINCT text, lang FROM documents")
def distinct_all(spark, sf):
    return _run(_t(spark, sf, "documents", "text", "lang").distinct())


@query("SELECT DISTINCT lang, source FROM documents")
def distinct_cols(spark, sf):
    return _run(_t(spark, sf, "documents", "doc_id", "lang", "source").distinct(["lang", "source"]).project(["lang", "source"]))


@query("SELECT least(count(*), 137) AS count FROM orders")
def limit_total(spark, sf):
    return _run(_t(spark, sf, "orders").limit(137).count())


# -- semantic verbs with rules of a local provider -----------------------------------


def _contains(word):
    return lambda r: word in r["text"].lower()


_RULES = LocalProvider({
    "the text speaks of the ing": _contains("thing"),
    "long text": lambda r: len(r["text"]) > 1000,
    "first word": lambda r: r["text"].split(" ")[0],
    "length": lambda r: len(r["text"]),
    "lines": lambda r: [{"line_no": i, "line": x} for i, x in enumerate(r["text"].split("\n"))],
    "same language": lambda r: r["lang"] == r["lang_right"],
    "total": lambda r: sum(x["turn"] for x in r["records"]) if "records" in r else sum(int(x) for x in r["partial"]),
})


def _semantic(**changes):
    return QueryProcessorConfig.of(PLAIN, provider=_RULES, **changes)


@query("SELECT doc_id, lang FROM documents WHERE contains(lower(text), 'thing')")
def sem_filter_contains(spark, sf):
    return _run(_t(spark, sf, "documents").sem_filter("the text speaks of the ing", depends_on="text").project(["doc_id", "lang"]), _semantic())


@query("SELECT doc_id, string_split(text, ' ')[1] AS first, length(text) AS size, string_split(text, ' ')[1] AS first_right, length(text) AS size_right FROM documents")
def sem_self_branch(spark, sf):
    """A branch that a join uses twice is lowered once, so each record is asked for once."""
    made = _t(spark, sf, "documents", "doc_id", "text").sem_map([{"name": "first", "type": str, "desc": "first word"}, {"name": "size", "type": int, "desc": "length"}], depends_on="text").project(["doc_id", "first", "size"])
    return _run(made.join(made, "doc_id"), _semantic())


@query("SELECT page_id FROM pages WHERE contains(lower(html), 'casino')")
def sem_filter_quoted(spark, sf):
    return _run(_t(spark, sf, "pages").sem_filter("the page names 'casino'", depends_on="html").project(["page_id"]), _semantic())


@query("SELECT doc_id, string_split(text, ' ')[1] AS first, length(text) AS size FROM documents")
def sem_map_fields(spark, sf):
    made = _t(spark, sf, "documents").sem_map([{"name": "first", "type": str, "desc": "first word"}, {"name": "size", "type": int, "desc": "length"}], depends_on="text")
    return _run(made.project(["doc_id", "first", "size"]), _semantic())


@query(r"SELECT page_id, nullif(regexp_extract(html, '<html lang=\"(\w+)\"', 1), '') AS lang FROM pages")
def sem_map_regex(spark, sf):
    return _run(_t(spark, sf, "pages").sem_map([{"name": "lang", "type": str, "desc": 'regex: <html lang="(\\w+)"'}], depends_on="html").project(["page_id", "lang"]), _semantic())


@query("SELECT conv_id, turn, unnest(range(len(string_split(text, chr(10))))) AS line_no, unnest(string_split(text, chr(10))) AS line FROM conversations")
def sem_flat_map_lines(spark, sf):
    made = _t(spark, sf, "conversations").sem_flat_map([{"name": "line_no", "type": int, "desc": ""}, {"name": "line", "type": str, "desc": ""}], desc="lines", depends_on="text")
    return _run(made.project(["conv_id", "turn", "line_no", "line"]), _semantic())


@query("SELECT doc_id, lang FROM documents WHERE contains(lower(text), 'thing') AND length(text) > 1000")
def sem_filter_pushed(spark, sf):
    """Two semantic filters and a join: the optimizer moves both filters to the documents' side."""
    data = _t(spark, sf, "documents", "doc_id", "text", "lang").join(_t(spark, sf, "documents", "doc_id", "source"), "doc_id")
    data = data.sem_filter("the text speaks of the ing", depends_on="text").sem_filter("long text", depends_on="text")
    config = QueryProcessorConfig(policy=MinCost(), provider=_RULES, available_models=["local-small"], allow_rag_reduction=False, allow_critic=False, allow_mixtures=False)
    return _run(data.project(["doc_id", "lang"]), config)


@query("SELECT doc_id, len(range(0, greatest(length(text), 1), 1000)) AS n_fixed, list_last(list_transform(range(0, greatest(length(text), 1), 1000), lambda i: substring(text, i + 1, 1000))) AS last_fixed, len(range(0, greatest(length(text), 1), greatest(CAST(ceil(length(text) / 4.0) AS BIGINT), 1))) AS n_even FROM documents")
def split_chunks(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    fixed = chunk_column(F.col("text"), 1000)
    return docs.select("doc_id", F.size(fixed).cast("long").alias("n_fixed"), F.element_at(fixed, -1).alias("last_fixed"), F.size(split_column(F.col("text"), 4)).cast("long").alias("n_even"))


@query("""SELECT doc_id FROM (SELECT doc_id, lower(text) AS t, CASE WHEN length(text) < 100 THEN greatest(length(text), 1) ELSE CAST(ceil(length(text) / 4.0) AS BIGINT) END AS size FROM documents)
WHERE len(list_filter(list_transform(range(0, greatest(length(t), 1), size), lambda i: substring(t, i + 1, size)), lambda c: contains(c, 'thing'))) > 0""")
def sem_filter_split(spark, sf):
    """The split strategy: a quarter of a text at a time is judged, and the answers are merged."""
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    done = sem_filter(docs, "the text has 'thing'", LocalProvider(), Implementation("split", ("local-large",), (("chunks", 4), ("least", 100))), ["text"])
    return done.where("__passed").select("doc_id")


@query("SELECT least(5, count(*)) AS n, true AS all_fit, true AS few_calls FROM documents WHERE contains(lower(text), 'thing')")
def sem_filter_limit(spark, sf):
    """A limit over a semantic filter stops the calls: how many rows came out, whether all fit, and whether few calls were made."""
    docs = _t(spark, sf, "documents", "doc_id", "text")
    done = docs.sem_filter("the text speaks of the ing", depends_on="text").limit(5).run(_semantic())
    calls, total = done.execution_stats.total_calls, docs.count().run(PLAIN).df.first()[0]
    return done.df.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.every(F.contains(F.lower("text"), F.lit("thing"))), F.lit(True)).alias("all_fit")).withColumn("few_calls", F.lit(calls <= max(64, total // 4)))


@query("SELECT l_orderkey, l_linenumber, l_returnflag, (SELECT count(DISTINCT l_returnflag) FROM lineitem) AS calls FROM lineitem WHERE l_returnflag IN ('A', 'R')")
def sem_filter_repeats(spark, sf):
    """Rows with equal inputs share a request, so there are as many calls as flags."""
    rule = LocalProvider({"accepted or returned": lambda r: r["l_returnflag"] in ("A", "R")})
    done = _t(spark, sf, "lineitem", "l_orderkey", "l_linenumber", "l_returnflag").sem_filter("accepted or returned", depends_on="l_returnflag").run(QueryProcessorConfig.of(PLAIN, provider=rule))
    return done.df.withColumn("calls", F.lit(done.execution_stats.total_calls).cast("long"))


@query("SELECT l_linenumber, l_returnflag, l_orderkey, l_quantity FROM (SELECT *, row_number() OVER (PARTITION BY l_linenumber, l_returnflag ORDER BY n) AS k FROM (SELECT *, row_number() OVER () AS n FROM lineitem)) WHERE k = 1")
def distinct_first(spark, sf):
    """The first row of each line number and flag by its place in the file, however the rows are dealt."""
    rows = spark.read.parquet(f"{sf}/lineitem.parquet").repartition(13)
    return _run(FrameDataset(rows).project(["l_linenumber", "l_returnflag", "l_orderkey", "l_quantity"]).distinct(["l_linenumber", "l_returnflag"]))


@query("""WITH e AS (SELECT vec_id, embedding[1:2]::DOUBLE[] AS v FROM embeddings), g AS (SELECT vec_id, [CASE WHEN v[1] > 0 THEN 1.0 ELSE -1.0 END, CASE WHEN v[2] > 0 THEN 1.0 ELSE -1.0 END] AS v FROM e)
SELECT q.vec_id AS vec_id, array_to_string(list(i.vec_id ORDER BY round(list_cosine_similarity(q.v, i.v), 9) DESC, i.vec_id)[1:4], ',') AS nearest FROM g q, g i GROUP BY q.vec_id""")
def sem_topk_ties(spark, sf):
    """Vectors of signs have very many ties, which go by id."""
    sign = F.transform(F.slice("embedding", 1, 2), lambda x: F.when(x > 0, 1.0).otherwise(-1.0))
    vectors = spark.read.parquet(f"{sf}/embeddings.parquet").select("vec_id", sign.alias("v"))
    df = _run(FrameDataset(vectors, "v").sem_topk(VectorIndex(vectors, "vec_id", "vec_id", "v"), "v", [{"name": "near", "type": list[str], "desc": ""}], k=4))
    return df.select("vec_id", F.array_join("near", ",").alias("nearest"))


@query("""SELECT q.vec_id AS vec_id, array_to_string(list(i.vec_id ORDER BY list_cosine_similarity(q.embedding::DOUBLE[], i.embedding::DOUBLE[]) DESC, i.vec_id)[1:5], ',') AS nearest
FROM embeddings q, embeddings i GROUP BY q.vec_id""")
def sem_topk_cells(spark, sf):
    """The search of a large index: its cells are opened as far as an exact bound asks."""
    vectors = spark.read.parquet(f"{sf}/embeddings.parquet").select(F.col("vec_id").alias("id"), F.col("vec_id").alias("value"), F.col("embedding").cast("array<double>").alias("vector"))
    hits = nearest(vectors.select(F.col("id").alias("q"), "vector"), vectors, 5).groupBy("q").agg(F.array_sort(F.collect_list(F.struct((-F.col("sim")).alias("d"), "id"))).alias("hits"))
    return hits.select(F.col("q").alias("vec_id"), F.array_join(F.transform("hits", lambda h: h["id"]), ",").alias("nearest"))


@query("SELECT a.vec_id AS vec_id, b.vec_id AS other FROM embeddings a JOIN embeddings b ON list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) >= 0.85")
def similar_pairs(spark, sf):
    """The embedding join's candidates: pairs over a similarity, without forming all pairs."""
    vectors = spark.read.parquet(f"{sf}/embeddings.parquet").select(F.col("vec_id").cast("string").cast("binary").alias("key"), F.col("embedding").cast("array<double>").alias("vector"))
    found = pairs_over(vectors.withColumnRenamed("key", "__l"), vectors.withColumnRenamed("key", "__r"), 0.85)
    return found.select(F.col("__l").cast("string").cast("long").alias("vec_id"), F.col("__r").cast("string").cast("long").alias("other"))


@query("SELECT CAST(sum(l_orderkey) AS BIGINT) AS total, true AS bounded FROM lineitem")
def sem_agg_tree(spark, sf):
    """All line items in calls of fifty, whose answers merge level by level; a call never takes more."""
    rule = LocalProvider({"total": lambda r: sum(x["l_orderkey"] for x in r["records"]) if "records" in r else sum(int(x) for x in r["partial"])})
    rows = spark.read.parquet(f"{sf}/lineitem.parquet").select("l_orderkey")
    out, spent = aggregate_by_calls(rows, make_schema([{"name": "total", "type": int, "desc": "total"}]).fields[0], "sum of the orders", rule, Implementation("single", ("local-large",)), per_call=50)
    calls, n = spent.agg(F.sum("calls")).first()[0], rows.count()
    return out.withColumn("bounded", F.lit(calls >= n / 50))


@query("SELECT n_name, n_regionkey, r_regionkey, r_name FROM nation JOIN region ON n_regionkey = r_regionkey")
def sem_join_nested(spark, sf):
    rule = LocalProvider({"the nation is in the region": lambda r: r["n_regionkey"] == r["r_regionkey"]})
    return _run(_t(spark, sf, "nation", "n_name", "n_regionkey").sem_join(_t(spark, sf, "region"), "the nation is in the region"), QueryProcessorConfig.of(PLAIN, provider=rule))


@query("SELECT n_name, n_regionkey, r_regionkey, r_name FROM nation FULL JOIN region ON n_regionkey + 1 = r_regionkey")
def sem_join_outer(spark, sf):
    rule = LocalProvider({"the region comes next": lambda r: r["n_regionkey"] + 1 == r["r_regionkey"]})
    return _run(_t(spark, sf, "nation", "n_name", "n_regionkey").sem_join(_t(spark, sf, "region"), "the region comes next", how="outer"), QueryProcessorConfig.of(PLAIN, provider=rule))


@query("SELECT a.doc_id AS doc_id, b.item_id AS item_id FROM documents a JOIN benchmark b ON a.doc_id % 40 = b.item_id % 40 AND (length(a.text) + length(b.text)) % 3 = 0")
def sem_join_blocked(spark, sf):
    """A blocking key makes the semantic join an equi-join; only pairs of a block are judged."""
    docs, items = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text"), spark.read.parquet(f"{sf}/benchmark.parquet")
    rule = LocalProvider({"sizes": lambda r: (len(r["text"]) + len(r["text_right"])) % 3 == 0})
    out, _ = sem_join(docs, items, "sizes", "inner", rule, Implementation("nested", ("local-large",)), ["text"], block=lambda a, b: a["doc_id"] % 40 == b["item_id"] % 40)
    return out.select("doc_id", "item_id")


@query("""WITH kinds AS (SELECT DISTINCT p_type FROM part), words AS (SELECT DISTINCT unnest(string_split(p_type, ' ')) AS word FROM part)
SELECT p_type, word FROM kinds, words WHERE list_contains(string_split(p_type, ' '), word)""")
def sem_join_embedding(spark, sf):
    """Pairs of a kind and a word of it; the embedding cascade judges only pairs that its sample leaves open."""
    rule = LocalProvider({"same word": lambda r: bool(set(r["p_type"].split()) & set(r["word"].split()))})
    kinds = FrameDataset(spark.read.parquet(f"{sf}/part.parquet").select("p_type").distinct(), "kinds")
    words = FrameDataset(spark.read.parquet(f"{sf}/part.parquet").select(F.explode(F.split("p_type", " ")).alias("word")).distinct(), "words")
    config = QueryProcessorConfig(policy=MinCost(), provider=rule, available_models=["local-small", "local-embed"])
    return _run(kinds.sem_join(words, "same word"), config)


@query("""SELECT q.vec_id AS vec_id, array_to_string(list(i.vec_id ORDER BY list_cosine_similarity(q.embedding::DOUBLE[], i.embedding::DOUBLE[]) DESC, i.vec_id)[1:3], ',') AS nearest
FROM embeddings q, embeddings i GROUP BY q.vec_id""")
def sem_topk(spark, sf):
    vectors = spark.read.parquet(f"{sf}/embeddings.parquet")
    index = VectorIndex(vectors, "vec_id", "vec_id", "embedding")
    df = _run(FrameDataset(vectors, "v").sem_topk(index, "embedding", [{"name": "near", "type": list[str], "desc": ""}], k=3))
    return df.select("vec_id", F.array_join("near", ",").alias("nearest"))


@query("SELECT CAST(sum(turn) AS BIGINT) AS total FROM conversations")
def sem_agg(spark, sf):
    return _run(_t(spark, sf, "conversations", "turn").sem_agg({"name": "total", "type": int, "desc": "total"}, "sum of the turns"), _semantic())


@query("SELECT l_returnflag, array_to_string(list_sort(list(DISTINCT l_linestatus)), '') AS statuses FROM lineitem WHERE l_quantity > 10 GROUP BY 1")
def relational_chain(spark, sf):
    data = _t(spark, sf, "lineitem").filter(F.col("l_quantity") > 10, "l_quantity").distinct(["l_returnflag", "l_linestatus"])
    df = _run(data.groupby(GroupBySig(["l_returnflag"], ["set"], ["l_linestatus"])))
    return df.select("l_returnflag", F.array_join(F.col("`set(l_linestatus)`"), "").alias("statuses"))


@query("""WITH m(name, i, o, q) AS (VALUES ('local-large', 5e-6, 2e-5, 85.0 / 100), ('local-medium', 1e-6, 4e-6, 74.0 / 100), ('local-small', 1e-7, 4e-7, 60.0 / 100)),
plans AS (
  SELECT 'sem_filter: ' || f.name || ', sem_map: ' || g.name AS plan, (1000 * f.i + 1.25 * f.o) + 0.5 * (1000 * g.i + 100 * g.o) AS cost, f.q * g.q AS quality FROM m f, m g
  UNION ALL SELECT 'sem_map: ' || g.name || ', sem_filter: ' || f.name, (1000 * g.i + 100 * g.o) + (1000 * f.i + 1.25 * f.o), f.q * g.q FROM m f, m g),
ranked AS (
  SELECT n_nationkey, plan, cost, row_number() OVER (PARTITION BY n_nationkey ORDER BY
    CASE WHEN n_nationkey % 2 = 0 THEN cost < 0.0002 + n_nationkey * 0.0006 ELSE quality > 0.3 + n_nationkey * 0.02 END DESC,
    CASE WHEN n_nationkey % 2 = 0 THEN -quality ELSE cost END, CASE WHEN n_nationkey % 2 = 0 THEN cost ELSE -quality END) AS place
  FROM plans, nation)
SELECT n_nationkey, plan, round(cost, 9) AS cost FROM ranked WHERE place = 1""")
def optimizer_choice(spark, sf):
    """The plan chosen under each nation's budget or least quality; the SQL goes through all orders and models."""
    docs = _t(spark, sf, "documents").sem_map([{"name": "topic", "type": str, "desc": "topic"}], depends_on="text").sem_filter("long text", depends_on="text")
    options = {"available_models": ["local-large", "local-medium", "local-small"], "allow_rag_reduction": False, "allow_critic": False, "allow_mixtures": False}
    rows = []
    for (key,) in spark.read.parquet(f"{sf}/nation.parquet").select("n_nationkey").collect():  # 25 rows; planning is the driver's work
        policy = MaxQualityAtFixedCost(0.0002 + key * 0.0006) if key % 2 == 0 else MinCostAtFixedQuality(0.3 + key * 0.02)
        plan = docs.plan(policy=policy, **options)
        steps = [f"{p.node.kind}: {p.impl.models[0]}" for p in plan.walk() if p.node.is_semantic]
        rows.append((key, ", ".join(steps), round(plan.cost.cost, 9)))
    return spark.createDataFrame(rows, "n_nationkey long, plan string, cost double")


def chosen_plans(spark, sf) -> list:
    """(name, policy, plan) of a fixed workload under each policy."""
    docs = _t(spark, sf, "documents").sem_map([{"name": "topic", "type": str, "desc": "topic"}], depends_on="text").sem_filter("long text", depends_on="text").filter(lambda r: r["lang"] == "en", "lang")
    policies = (("max_quality", MaxQuality()), ("min_cost", MinCost()), ("min_time", MinTime()), ("max_quality_at_cost", MaxQualityAtFixedCost(0.01)), ("min_cost_at_quality", MinCostAtFixedQuality(0.5)))
    return [(name, policy, docs.plan(policy=policy)) for name, policy in policies]


# -- strategies ---------------------------------------------------------------------------

_FIRST = [{"name": "first", "type": str, "desc": "first word"}, {"name": "size", "type": int, "desc": "length"}]
_FIRST_SQL = "SELECT conv_id, turn, string_split(text, ' ')[1] AS first, length(text) AS size FROM conversations"
_THE_SQL = "SELECT conv_id, turn FROM conversations WHERE contains(lower(text), 'the')"
_RAG = Implementation("rag", ("local-large",), (("embedder", "local-embed"), ("keep", 4), ("size", 4000)))
_MIXTURE = Implementation("mixture", ("local-large", "local-small", "local-large"), (("temperature", 0.4),))
_CRITIQUE = Implementation("critique", ("local-small", "local-large", "local-large"))


def _filtered_by(spark, sf, impl):
    talk = spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id", "turn", "text")
    return sem_filter(talk, "the turn has 'the'", LocalProvider(), impl, ["text"]).where("__passed").select("conv_id", "turn")


def _mapped_by(spark, sf, impl):
    talk = spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id", "turn", "text")
    return sem_map(talk, make_schema(_FIRST), _RULES, impl, ["text"]).select("conv_id", "turn", "first", "size")


@query(_THE_SQL)
def sem_filter_rag(spark, sf):
    """Texts of up to a chunk stay whole."""
    return _filtered_by(spark, sf, _RAG)


@query(_FIRST_SQL)
def sem_map_rag(spark, sf):
    return _mapped_by(spark, sf, _RAG)


@query(_THE_SQL)
def sem_filter_mixture(spark, sf):
    """Two models propose, a third puts it to the vote."""
    return _filtered_by(spark, sf, _MIXTURE)


@query(_FIRST_SQL)
def sem_map_mixture(spark, sf):
    return _mapped_by(spark, sf, _MIXTURE)


@query(_THE_SQL)
def sem_filter_critique(spark, sf):
    return _filtered_by(spark, sf, _CRITIQUE)


@query(_FIRST_SQL)
def sem_map_critique(spark, sf):
    return _mapped_by(spark, sf, _CRITIQUE)


@query(_FIRST_SQL)
def sem_map_split(spark, sf):
    return _mapped_by(spark, sf, Implementation("split", ("local-large",), (("chunks", 3), ("least", 50))))


def _has(word):
    """An embedding of one place: whether a text has the word."""

    def embed(some):
        return np.array([[1.0 if word in x else 0.0, 0.01] for x in some])

    return embed


@query("""SELECT doc_id, CASE WHEN length(text) < 1000 THEN text ELSE coalesce(
  (SELECT substring(text, i + 1, 1000) FROM unnest(range(0, length(text), 1000)) AS t(i) WHERE contains(substring(text, i + 1, 1000), 'thing') ORDER BY i LIMIT 1), substring(text, 1, 1000)) END AS kept FROM documents""")
def rag_reduce(spark, sf):
    """The chunk of a long text that is nearest to a query, by an embedding that knows one word; of equals the first."""

    def reduced(texts: pa.Array) -> pa.Array:
        return pa.array([None if t is None else top_chunks(t, "thing", 1000, 1, _has("thing")) for t in texts.to_pylist()], pa.string())

    return spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", F.arrow_udf(reduced, "string")("text").alias("kept"))


@query("SELECT n_name, n_regionkey, r_regionkey, r_name FROM nation LEFT JOIN region ON n_regionkey + 1 = r_regionkey")
def sem_join_left(spark, sf):
    rule = LocalProvider({"the region comes next": lambda r: r["n_regionkey"] + 1 == r["r_regionkey"]})
    return _run(_t(spark, sf, "nation", "n_name", "n_regionkey").sem_join(_t(spark, sf, "region"), "the region comes next", how="left"), QueryProcessorConfig.of(PLAIN, provider=rule))


@query("SELECT n_name, n_regionkey, r_regionkey, r_name FROM nation RIGHT JOIN region ON n_regionkey + 1 = r_regionkey")
def sem_join_right(spark, sf):
    rule = LocalProvider({"the region comes next": lambda r: r["n_regionkey"] + 1 == r["r_regionkey"]})
    return _run(_t(spark, sf, "nation", "n_name", "n_regionkey").sem_join(_t(spark, sf, "region"), "the region comes next", how="right"), QueryProcessorConfig.of(PLAIN, provider=rule))


@query("SELECT n_name, r_name FROM nation JOIN region ON n_regionkey = r_regionkey")
def sem_topk_text(spark, sf):
    """A text query finds the entry with its very words."""
    regions = embedded(spark.read.parquet(f"{sf}/region.parquet"), ["r_name"], LocalProvider(), "local-embed", "vector")
    nations = spark.read.parquet(f"{sf}/nation.parquet").join(spark.read.parquet(f"{sf}/region.parquet"), F.col("n_regionkey") == F.col("r_regionkey")).select("n_name", F.col("r_name").alias("sought"))
    found = _run(FrameDataset(nations).sem_topk(VectorIndex(regions, "r_regionkey", "r_name", "vector"), "sought", [{"name": "near", "type": list[str], "desc": ""}], k=1))
    return found.select("n_name", F.col("near")[0].alias("r_name"))


@query("SELECT n_name, array_to_string([r_name, 'ASIA'], ',') AS r_names FROM nation JOIN region ON n_regionkey = r_regionkey")
def sem_topk_lists(spark, sf):
    """A list of text queries has a list of results for each."""
    regions = embedded(spark.read.parquet(f"{sf}/region.parquet"), ["r_name"], LocalProvider(), "local-embed", "vector")
    nations = spark.read.parquet(f"{sf}/nation.parquet").join(spark.read.parquet(f"{sf}/region.parquet"), F.col("n_regionkey") == F.col("r_regionkey")).select("n_name", F.array("r_name", F.lit("ASIA")).alias("sought"))
    found = _run(FrameDataset(nations).sem_topk(VectorIndex(regions, "r_regionkey", "r_name", "vector"), "sought", [{"name": "near", "type": list[list[str]], "desc": ""}], k=1))
    return found.select("n_name", F.array_join(F.flatten("near"), ",").alias("r_names"))


@query("SELECT r_name, 'K' || r_regionkey AS key FROM region")
def topk_search_func(spark, sf):
    """A search of one's own in place of the nearest vectors."""
    regions = spark.read.parquet(f"{sf}/region.parquet").select("r_name", F.concat(F.lit("K"), "r_regionkey").alias("key"), F.array(F.lit(1.0)).alias("vector"))
    index = VectorIndex(regions, "r_name", "key", "vector")
    pairs = {r["r_name"]: r["key"] for r in regions.collect()}  # five rows
    found = _run(FrameDataset(regions.select("r_name")).sem_topk(index, "r_name", [{"name": "near", "type": list[str], "desc": ""}], search_func=lambda rows, q, k: [pairs[q]], k=1))
    return found.select("r_name", F.col("near")[0].alias("key"))


@query("SELECT doc_id, string_split(text, ' ')[1] AS first, length(text) AS size FROM documents WHERE contains(lower(text), 'thing')")
def optimize_and_run(spark, sf):
    """Implementations are tried on training rows with a fixed seed; whichever plan wins, the rows are the same."""
    docs = _t(spark, sf, "documents", "doc_id", "text")
    train = FrameDataset(spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").orderBy("doc_id").limit(6), "train")
    plan = docs.sem_filter("the text speaks of the ing", depends_on="text").sem_map(_FIRST, depends_on="text")
    config = QueryProcessorConfig(policy=MinCost(), provider=_RULES, available_models=["local-large", "local-small"], allow_rag_reduction=False, k=2, j=2, sample_budget=12, seed=7)
    return plan.optimize_and_run(config, train_dataset=train, spark=spark).df.select("doc_id", "first", "size")


@query("SELECT n_nationkey, n_nationkey * 2 AS twice, unnest([n_regionkey, n_regionkey + 1]) AS near FROM nation")
def deprecated_aliases(spark, sf):
    """``add_columns`` in both cardinalities."""
    with warnings.catch_warnings():
        warnings.simplefilter("ignore", DeprecationWarning)
        made = _t(spark, sf, "nation", "n_nationkey", "n_regionkey").add_columns(lambda r: {"twice": r["n_nationkey"] * 2}, [{"name": "twice", "type": int, "desc": ""}], depends_on=["n_nationkey"])
        made = made.add_columns(lambda r: [{"near": r["n_regionkey"]}, {"near": r["n_regionkey"] + 1}], [{"name": "near", "type": int, "desc": ""}], "one_to_many", ["n_regionkey"])
    return _run(made.project(["n_nationkey", "twice", "near"]))


@query("SELECT conv_id, turn, string_split(text, ' ')[1] AS first, length(text) AS size FROM conversations")
def sem_add_columns(spark, sf):
    with warnings.catch_warnings():
        warnings.simplefilter("ignore", DeprecationWarning)
        made = _t(spark, sf, "conversations", "conv_id", "turn", "text").sem_add_columns(_FIRST, depends_on="text")
    return _run(made.project(["conv_id", "turn", "first", "size"]), _semantic())


# -- sources: files that an executor stage writes from a table --------------------------------


def _folder(files: DataFrame) -> str:
    """A folder of files (name string, data binary) in the shared folder, written where the rows are; it goes with the driver's JVM."""
    folder = fresh_path(files.sparkSession, "files")

    def write(batches):
        from pyarrow import fs as filesystems

        fs, place = filesystems.FileSystem.from_uri(folder if "://" in folder or folder.startswith("file:") else f"file://{folder}")
        fs.create_dir(place, recursive=True)
        for b in batches:
            for name, data in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                with fs.open_output_stream(f"{place}/{name}") as out:
                    out.write(data)
            yield b.select([0])

    files.select("name", F.col("data").cast("binary").alias("data")).mapInArrow(write, "name string").write.format("noop").mode("overwrite").save()
    return folder


def _pages(spark, sf, ending: str, data: str) -> str:
    """A folder with a file for each page, of what the SQL expression ``data`` makes of its row."""
    return _folder(spark.read.parquet(f"{sf}/pages.parquet").select(F.concat("page_id", F.lit(ending)).alias("name"), F.expr(data).alias("data")))


@query("SELECT page_id || '.txt' AS filename, url || ' has' || chr(10) || length(html) AS contents FROM pages")
def source_text_files(spark, sf):
    return _run(TextFileDataset("t", _pages(spark, sf, ".txt", r"concat(url, ' has\n', length(html))")))


@query("SELECT page_id || '.html' AS filename, page_id || ' lies in place (' || url || ')' AS text FROM pages")
def source_html_files(spark, sf):
    folder = _pages(spark, sf, ".html", "concat('<html><head><title>x</title></head><body><p>', page_id, ' lies in <a href=\"', url, '\">place</a></p></body></html>')")
    return _run(HTMLFileDataset("h", folder, max_words=None).project(["filename", "text"]))


@query("SELECT page_id || '.png' AS filename, base64(encode('image ' || url)) AS contents FROM pages")
def source_image_files(spark, sf):
    return _run(ImageFileDataset("i", _pages(spark, sf, ".png", "concat('image ', url)")))


@query("SELECT page_id || '.wav' AS filename, base64(encode('sound ' || url)) AS contents FROM pages")
def source_audio_files(spark, sf):
    return _run(AudioFileDataset("a", _pages(spark, sf, ".wav", "concat('sound ', url)")))


@query("SELECT page_id || '.pdf' AS filename, upper('page of ' || url) AS text_contents FROM pages")
def source_pdf_files(spark, sf):
    """With an extractor of one's own; the files hold plain text."""
    folder = _pages(spark, sf, ".pdf", "concat('page of ', url)")
    return _run(PDFFileDataset("p", folder, extract=lambda b: b.decode().upper()).project(["filename", "text_contents"]))


def _workbook(names: list[str]) -> bytes:
    main, rel = "http://schemas.openxmlformats.org/spreadsheetml/2006/main", "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        sheets = "".join(f'<sheet name="{n}" sheetId="{i}" r:id="rId{i}"/>' for i, n in enumerate(names, 1))
        z.writestr("xl/workbook.xml", f'<workbook xmlns="{main}" xmlns:r="{rel}"><sheets>{sheets}</sheets></workbook>')
        links = "".join(f'<Relationship Id="rId{i}" Target="worksheets/sheet{i}.xml"/>' for i, _ in enumerate(names, 1))
        z.writestr("xl/_rels/workbook.xml.rels", f'<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">{links}</Relationships>')
        for i, _ in enumerate(names, 1):
            z.writestr(f"xl/worksheets/sheet{i}.xml", f'<worksheet xmlns="{main}"><sheetData><row r="1"><c r="A1"><v>{i}</v></c></row></sheetData></worksheet>')
    return out.getvalue()


@query("SELECT (page_id % 20) || '.xlsx' AS filename, count(*) AS number_sheets, array_to_string(list('p' || page_id ORDER BY page_id), ',') AS sheets FROM pages GROUP BY page_id % 20")
def source_workbooks(spark, sf):
    """Twenty workbooks, with a sheet for each of their pages."""

    def book(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([_workbook(x) for x in b.column(1).to_pylist()], pa.binary())], ["name", "data"])

    sheets = spark.read.parquet(f"{sf}/pages.parquet").groupBy((F.col("page_id") % 20).alias("book")).agg(F.transform(F.array_sort(F.collect_list("page_id")), lambda x: F.concat(F.lit("p"), x)).alias("names"))
    folder = _folder(sheets.select(F.concat("book", F.lit(".xlsx")).alias("name"), "names").mapInArrow(book, "name string, data binary"))
    return _run(XLSFileDataset("x", folder)).select("filename", "number_sheets", F.array_join("sheet_names", ",").alias("sheets"))


class _Nations(IterDataset):
    """A user's dataset over rows that it holds."""

    def __init__(self, rows: list[tuple]):
        self.rows = rows
        super().__init__(f"nations{uuid.uuid4().hex[:8]}", [{"name": "nation", "type": str, "desc": ""}, {"name": "region", "type": int, "desc": ""}])

    def __len__(self):
        return len(self.rows)

    def __getitem__(self, idx):
        return {"nation": self.rows[idx][0], "region": self.rows[idx][1]}


def _rows(spark, sf) -> list[tuple]:
    return [(r["n_name"], r["n_regionkey"]) for r in spark.read.parquet(f"{sf}/nation.parquet").orderBy("n_nationkey").collect()]


@query("SELECT n_name AS nation, n_regionkey::BIGINT AS region FROM nation")
def source_user_dataset(spark, sf):
    return _run(_Nations(_rows(spark, sf)))


@query("SELECT n_name AS nation, n_regionkey::BIGINT AS region FROM nation")
def source_memory(spark, sf):
    return _run(MemoryDataset("m", [{"nation": n, "region": r} for n, r in _rows(spark, sf)]))


@query("SELECT n_name AS nation FROM nation WHERE n_nationkey >= 5 AND n_nationkey < 12")
def source_slice(spark, sf):
    """A scan from a place on, of so many rows."""
    data = MemoryDataset("m", [{"nation": n} for n, _ in _rows(spark, sf)])
    return _run(data, QueryProcessorConfig.of(PLAIN, scan_start_idx=5, num_samples=7))


@query("SELECT n_name AS nation, 'memory-' || n_nationkey AS source_id FROM nation")
def source_ids(spark, sf):
    return _run(MemoryDataset("memory", [{"nation": n} for n, _ in _rows(spark, sf)]).with_source_ids())


@query("SELECT page_id || '.png' AS filename FROM pages")
def source_by_path(spark, sf):
    """A folder's kind is found by its files' endings."""
    return _run(get_local_source("g", _pages(spark, sf, ".png", "url").removeprefix("file:")).project(["filename"]))


@query("SELECT n_name AS value FROM nation")
def source_resolved(spark, sf):
    return _run(resolve_datasource("v", [n for n, _ in _rows(spark, sf)]))


# -- contexts ------------------------------------------------------------------------------


@query("SELECT CAST(page_id AS VARCHAR) AS page FROM pages WHERE page_id % 7 = 3")
def context_search(spark, sf):
    """An agent searches all files of a folder; the answer joins the context's description when the plan runs."""
    folder = _pages(spark, sf, ".txt", "concat('shelf', page_id % 7, ' holds ', url)")
    context = TextFileContext(folder, "pages", "a file for each page").search("shelf3", LocalAgent(), ContextManager())
    described = _run(context).select(F.split(F.element_at(F.split("context", "RESULT: "), -1), ", ").alias("paths"))
    return described.select(F.explode("paths").alias("path")).select(F.regexp_extract("path", r"([^/]+)\.txt$", 1).alias("page"))


@query("SELECT CAST(count(*) AS VARCHAR) AS answer FROM pages")
def context_compute(spark, sf):
    """An agent computes with the context's tools; the answer is a column of the new context, and a filter reads it on."""
    folder = _pages(spark, sf, ".txt", "url")
    agent = LocalAgent({"count the files": lambda tools: len(tools["tool_list_filepaths"]())})
    done = TextFileContext(folder, "counted", "a file for each page").compute("count the files", agent, ContextManager())
    return _run(done.sem_filter("speaks of 'each page'", depends_on="context")).select(F.col(f"`{done.column}`").alias("answer"))


@query("SELECT r_name AS nearest FROM region WHERE r_name = 'ASIA'")
def context_registry(spark, sf):
    """Contexts are found by their descriptions."""
    manager = ContextManager()
    for r in spark.read.parquet(f"{sf}/region.parquet").collect():
        manager.add_context(Context(r["r_name"], f"the region {r['r_name']}"))
    (found,) = manager.search_context("region ASIA", k=1)
    return spark.createDataFrame([(found.id,)], "nearest string")
