"""Queries of files and of decision trees made from data: a tree a part, a branch a supplier that sold it."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.spread import spread
from ..operators import trees
from ..sources.files import read_files, write_files
from ..sources.readers import TREE, read_tree_files
from ..sources.scratch import scratch
from .search import QUERIES as _ALL
from .search import SQL as _ALL_SQL
from .tables import table

QUERIES, SQL = {}, {}


def query(name: str, sql: str):
    def add(f):
        if name in _ALL or name in _ALL_SQL:
            raise ValueError(f"{name} is registered already")
        QUERIES[name], SQL[name] = f, sql
        return f

    return add


_TREES = """sold AS (SELECT DISTINCT l_partkey, l_suppkey FROM lineitem WHERE l_suppkey IS NOT NULL),
pt AS (SELECT 'part_' || p_partkey AS tree_id, p_partkey, p_name, p_brand, p_type, list_sort(list(l_suppkey)) AS suppliers FROM part JOIN sold ON l_partkey = p_partkey GROUP BY ALL),
br AS (SELECT tree_id, unnest(suppliers) AS s FROM pt)"""


def _documents(spark, d, law="'parts'"):
    """(p_partkey, tree_id, json): the tree of each part. Those of suppliers divisible by 7 have no node, so their branches dangle."""
    sold = table(spark, d, "lineitem").groupBy("l_partkey").agg(F.array_sort(F.collect_set("l_suppkey")).alias("s")).filter(F.size("s") > 0)

    def node(ident, kind, summary=None, branches=None, next_node=None):
        none = lambda t: F.lit(None).cast(t)
        return F.struct(
            ident.alias("id"), F.lit(kind).alias("type"), (none("string") if summary is None else summary).alias("summary"),
            (none("array<struct<condition:string,next_node:string>>") if branches is None else branches).alias("branches"), F.lit(next_node).cast("string").alias("next_node"),
        )

    entry = lambda key, value: F.struct(key.alias("key"), value.alias("value"))
    name = lambda x: F.concat(F.lit("s"), x.cast("string"))
    branches = F.transform("s", lambda x: F.struct(F.concat(F.lit("supplier "), x.cast("string"), F.lit(".")).alias("condition"), name(x).alias("next_node")))
    ends = F.transform(F.filter("s", lambda x: x % 7 != 0), lambda x: entry(name(x), node(name(x), "result", summary=F.concat(F.lit("from "), x.cast("string")))))
    who = entry(F.lit("who"), node(F.lit("who"), "decision", branches=branches))
    tree = F.struct(
        F.col("tree_id"), F.col("p_name").alias("title"), F.expr(law).alias("law"), F.col("p_partkey").cast("string").alias("article"), F.lit("who sold it").alias("description"),
        F.array(F.lower("p_brand"), F.lower("p_type")).alias("tags"), node(F.lit("start"), "info", next_node="who").alias("root"), F.map_from_entries(F.concat(F.array(who), ends)).alias("nodes"),
    )
    rows = spread(table(spark, d, "part").join(sold, F.col("l_partkey") == F.col("p_partkey")))  # documents cost much more than these rows weigh
    rows = rows.withColumn("tree_id", F.concat(F.lit("part_"), F.col("p_partkey").cast("string")))
    return rows.select("p_partkey", "tree_id", F.to_json(tree).alias("json"))


def _part_trees(spark, d):
    return _documents(spark, d).select(F.from_json("json", TREE).alias("t")).select("t.*")


@query("d1_part_nodes", f"""WITH {_TREES} SELECT tree_id, 'start' AS node_id, true AS is_root, 'info' AS type, 0::BIGINT AS branches FROM pt
UNION ALL SELECT tree_id, 'who', false, 'decision', len(suppliers)::BIGINT FROM pt UNION ALL SELECT tree_id, 's' || s, false, 'result', 0 FROM br WHERE s % 7 <> 0""")
def d1_parts(spark, d):
    return trees.node_table(_part_trees(spark, d)).select("tree_id", "node_id", "is_root", "type", F.size("branches").cast("long").alias("branches"))


@query("d2_part_index", f"""WITH {_TREES}, k AS (SELECT tree_id, unnest([lower(p_brand), lower(p_type)] || list_filter(string_split_regex(lower(p_name), '[^0-9a-z]+'), lambda w: length(w) > 3)) AS key FROM pt)
SELECT key, max(tree_id) AS tree_id FROM k GROUP BY key""")
def d2_parts(spark, d):
    return trees.search_index(_part_trees(spark, d))


@query("d6_part_walk", """SELECT l_orderkey, l_linenumber, CASE WHEN l_suppkey % 7 = 0 THEN 'who' ELSE 's' || l_suppkey END AS node_id, CASE WHEN l_suppkey % 7 = 0 THEN 'decision' ELSE 'result' END AS node_type,
'start>who' || CASE WHEN l_suppkey % 7 = 0 THEN '' ELSE '>s' || l_suppkey END AS path FROM lineitem JOIN part ON p_partkey = l_partkey WHERE l_suppkey IS NOT NULL""")
def d6_parts(spark, d):
    """Every order line goes down its part's tree; lines of one part and supplier go once."""
    fact = F.concat(F.lit("supplier "), F.col("l_suppkey").cast("string"), F.lit("."))
    lines = table(spark, d, "lineitem").filter("l_suppkey is not null")
    cases = lines.select("l_orderkey", "l_linenumber", F.concat(F.lit("part_"), F.col("l_partkey").cast("string")).alias("tree_id"), F.create_map(F.lit("supplier"), fact).alias("facts"))
    walked = trees.walk(cases, trees.node_table(_part_trees(spark, d)))
    return walked.select("l_orderkey", "l_linenumber", "node_id", "node_type", F.array_join("path", ">").alias("path"))


@query("d10_part_edges", f"WITH {_TREES} SELECT tree_id, 'start' AS source, 'who' AS target, '' AS label FROM pt UNION ALL SELECT tree_id, 'who', 's' || s, left('supplier ' || s || '.', 24) FROM br")
def d10_parts(spark, d):
    return trees.tree_edges(trees.node_table(_part_trees(spark, d)))


@query("d11_part_dangling", f"WITH {_TREES} SELECT tree_id, 'who' AS source, 's' || s AS target, left('supplier ' || s || '.', 24) AS label FROM br WHERE s % 7 = 0")
def d11_parts(spark, d):
    return trees.dangling(trees.node_table(_part_trees(spark, d))).select("tree_id", "source", "target", "label")


@query("a10_part_conditions", f"WITH {_TREES} SELECT tree_id, array_to_string(list_sort(list('supplier ' || s || '.'))[1:30], ',') AS conditions FROM br GROUP BY tree_id")
def a10_parts(spark, d):
    return trees.conditions(trees.node_table(_part_trees(spark, d))).select("tree_id", F.array_join("conditions", ",").alias("conditions"))


@query("a14_part_catalogue", f"WITH {_TREES} SELECT tree_id, p_name AS title, p_partkey::VARCHAR AS article, 2 + len(list_filter(suppliers, lambda x: x % 7 <> 0))::BIGINT AS n_nodes FROM pt")
def a14_parts(spark, d):
    return trees.catalogue(_part_trees(spark, d)).withColumn("n_nodes", F.col("n_nodes").cast("long"))


@query("s5_tree_source", f"""WITH {_TREES} SELECT tree_id, CASE WHEN p_partkey % 50 > 2 THEN 1 + len(list_filter(suppliers, lambda x: x % 7 <> 0))::BIGINT END AS n_nodes,
CASE p_partkey % 50 WHEN 0 THEN 'not JSON: Expecting '','' delimiter' WHEN 1 THEN 'missing: law' WHEN 2 THEN 'not an object' END AS reason FROM pt""")
def s5_parts(spark, d):
    """A file a tree; some are cut off, lack a key or are lists, and come back with the reason."""
    path = scratch(spark, "trees")
    place = F.col("p_partkey") % 50
    rows = _documents(spark, d, law="if(p_partkey % 50 <> 1, 'parts', null)")
    cut = F.when(place == 0, F.concat(F.lit('{"tree_id": "'), "tree_id", F.lit('"'))).when(place == 2, F.concat(F.lit('["'), "tree_id", F.lit('"]'))).otherwise(F.col("json"))
    write_files(rows.select(cut.alias("value")).repartition(spark.sparkContext.defaultParallelism), f"{path}/txt")
    files = read_files(spark, path, "part-*.txt", format="json", required="tree_id,title,law,article,description,root")
    tree = F.from_json("content", TREE)
    return files.select(F.regexp_extract("content", "part_[0-9]+", 0).alias("tree_id"), F.when(F.col("reason").isNull(), F.size(tree["nodes"])).cast("long").alias("n_nodes"), "reason")


@query("s1_file_source", "SELECT sha256(coalesce(text, '')) AS content_hash, length(coalesce(text, ''))::BIGINT AS chars FROM documents")
def s1_files(spark, d):
    """Documents in files of 50, read back in groups of files."""
    path = scratch(spark, "rulings")
    texts = spread(table(spark, d, "documents").select("text"))
    texts.write.option("lineSep", "\u0001").option("maxRecordsPerFile", 50).text(path)
    pieces = F.split("content", "\u0001")  # one more than there are texts
    rows = read_files(spark, path, "part-*.txt").select(F.explode(F.slice(pieces, 1, F.size(pieces) - 1)).alias("t"))
    return rows.select(F.sha2("t", 256).alias("content_hash"), F.length("t").cast("long").alias("chars"))
