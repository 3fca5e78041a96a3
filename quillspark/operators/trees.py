"""Decision trees evaluated over tables of cases.

A tree is a document, held by a task as one map; cases are many. Nodes are rows (tree_id, node_id, is_root, type,
question, help, legal_ref, summary, details, warnings, next_steps, branches, next_node, legal_refs); cases are rows (case_id, tree_id, facts map<string,string>).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import ArrayType, StringType, StructField, StructType

from ..functions.text import normalise
from . import retrieval


def node_table(trees: DataFrame) -> DataFrame:
    """Root and nodes as rows, missing texts and lists empty; a node without a type decides, a root without an id is ``root``."""
    fields = ["type", "question", "help", "legal_ref", "summary", "details", "next_node"]
    lists = ["warnings", "next_steps", "legal_refs"]
    parts = [*fields[:6], *lists[:2], "branches", "next_node", "legal_refs"]
    made = lambda n, ident, is_root: F.struct(F.lit(is_root).alias("is_root"), F.struct(ident.alias("id"), *(n[f].alias(f) for f in parts)).alias("n"))

    def of(tree: Column) -> Column:
        root = F.array(made(tree["root"], F.coalesce(tree["root"]["id"], F.lit("root")), True))
        return F.concat(root, F.transform(F.coalesce(F.map_entries(tree["nodes"]), F.array()), lambda e: made(e["value"], e["key"], False)))

    # One list a tree, made of a bound value, so that its document is read once and not once a field.
    rows = trees.select("tree_id", F.explode(F.flatten(F.transform(F.array(F.struct("root", "nodes")), of))).alias("_n")).select("tree_id", "_n.is_root", "_n.n")
    return rows.select(
        "tree_id", F.col("n.id").alias("node_id"), "is_root", *(F.coalesce(F.col(f"n.{f}"), F.lit("decision" if f == "type" else "")).alias(f) for f in fields),
        *(F.coalesce(F.col(f"n.{f}"), F.array().cast("array<string>")).alias(f) for f in lists),
        F.coalesce(F.col("n.branches"), F.array().cast("array<struct<condition:string,next_node:string>>")).alias("branches"),
    )


def search_index(trees: DataFrame) -> DataFrame:
    """(key, tree_id): normalised tags and title words longer than 3; of several trees the last in order has a key."""
    keys = F.concat(F.transform("tags", normalise), F.filter(F.split(normalise(F.col("title")), "[^0-9a-z]+"), lambda w: F.length(w) > 3))
    return trees.select("tree_id", F.explode(keys).alias("key")).groupBy("key").agg(F.max("tree_id").alias("tree_id"))


def tree_scores(queries: DataFrame, index: DataFrame, text: str = "text") -> DataFrame:
    """(query_id, tree_id, score): how many of a tree's keys occur in the normalised query. All keys go through a query once."""
    kind = dict(queries.dtypes)["query_id"]
    told = queries.select(F.col("query_id").cast("string").alias("uid"), normalise(F.col(text)).alias("content"))
    found = retrieval.keyword_counts(told, index.select(F.col("key").alias("keyword"))).select("uid", F.col("keyword").alias("key"))
    hits = found.join(index, "key").select(F.col("uid").cast(kind).alias("query_id"), "tree_id", "key")
    return hits.groupBy("query_id", "tree_id").agg(F.count_distinct("key").alias("score"))


def ranked_trees(scores: DataFrame) -> DataFrame:
    return scores.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "tree_id")))


def pick_tree(scores: DataFrame) -> DataFrame:
    """(query_id, tree_id, ambiguous): the best tree; sure if it is the only one or has 2 or more and a lead of 2."""
    ranked = ranked_trees(scores)
    first = ranked.filter("rank = 1").select("query_id", "tree_id", "score")
    second = ranked.filter("rank = 2").select("query_id", F.col("score").alias("next"))
    sure = F.col("next").isNull() | ((F.col("score") >= 2) & (F.col("score") - F.col("next") >= 2))
    return first.join(second, "query_id", "left").select("query_id", "tree_id", (~sure).alias("ambiguous"))


def next_by_facts(branches: Column, facts: Column) -> Column:
    """The target of the first branch whose condition is a true fact, or holds a fact's value (not an empty one)."""
    def taken(b: Column) -> Column:
        low = F.lower(b["condition"])
        told = F.coalesce(F.lower(facts[b["condition"]]) == "true", F.lit(False))
        return told | F.exists(F.map_values(facts), lambda v: (F.coalesce(v, F.lit("")) != "") & F.contains(low, F.lower(v)))

    return F.get(F.filter(branches, taken), F.lit(0))["next_node"]


def signatures(cases: DataFrame, nodes: DataFrame) -> DataFrame:
    """Cases of known trees with ``_sig``, what of their facts can decide a branch of their tree, and ``_matter``, its map."""
    conditions_ = nodes.groupBy("tree_id").agg(F.array_distinct(F.flatten(F.collect_list("branches.condition"))).alias("_conditions"))
    decides = lambda k, v: (F.coalesce(v, F.lit("")) != "") & ((F.lower(v) == "true") & F.array_contains("_conditions", k) | F.exists("_conditions", lambda c: F.contains(F.lower(c), F.lower(v))))
    known = cases.join(conditions_, "tree_id").withColumn("_matter", F.map_filter("facts", decides)).drop("_conditions")
    return known.withColumn("_sig", F.coalesce(F.to_json(F.array_sort(F.map_entries("_matter"))), F.lit("")))


def walk(cases: DataFrame, nodes: DataFrame, steps: int | None = None) -> DataFrame:
    """(case columns, node_id, node_type, path): each case from the root to a result, an unresolved decision, a dead end
    or a node it has seen, or ``steps`` steps far.

    Trees and cases meet in one shuffle by tree: a task reads a tree, then its cases one after another; cases of equal facts
    go once. Few trees are copied, so that their cases take all cores; the cases of one of many trees are one task's.
    """
    spark = cases.sparkSession
    step = F.struct("node_id", "is_root", "type", "branches", "next_node")
    packed = nodes.groupBy("tree_id").agg(F.collect_list(step).alias("_nodes")).filter("tree_id is not null")
    few = 4 * spark.sparkContext.defaultParallelism
    count = nodes.select("tree_id").distinct().limit(few).count()
    copies = -(-few // max(count, 1))
    case = F.struct(*cases.columns)
    shape = cases.select(case.alias("_case")).schema["_case"].dataType
    told = cases.filter("tree_id is not null").select("tree_id", F.pmod(F.xxhash64(*(c for c, t in cases.dtypes if not t.startswith(("map", "array<map")))), F.lit(copies)).cast("int").alias("_copy"), F.lit(None).cast(packed.schema["_nodes"].dataType).alias("_nodes"), case.alias("_case"))
    trees = packed.select("tree_id", F.explode(F.sequence(F.lit(0), F.lit(copies - 1))).alias("_copy"), "_nodes", F.lit(None).cast(shape).alias("_case"))
    rows = trees.unionByName(told).repartition("tree_id", "_copy").sortWithinPartitions("tree_id", "_copy", F.col("_nodes").isNull())
    schema = StructType([*(StructField(f.name, f.dataType) for f in shape), StructField("path", ArrayType(StringType())), StructField("node_id", StringType()), StructField("node_type", StringType())])
    ways = rows.select("tree_id", "_nodes", F.col("_case").isNull().alias("_tree"), F.col("_case.facts").alias("_facts"), *(F.col(f"_case.{c}").alias(f"_{i}") for i, c in enumerate(cases.columns)))
    walked = ways.mapInArrow(_walk(len(cases.columns), to_arrow_schema(schema), steps), schema)
    return walked.select(*cases.columns, "path", "node_id", "node_type")


class Way:
    """One tree: nodes by id, and the ways of the facts that went through it."""

    def __init__(self, nodes: list[dict], steps: int | None) -> None:
        self.nodes, self.steps, self.ways = {}, steps, {}
        self.root = max((n["node_id"] for n in nodes if n["is_root"] and n["node_id"] is not None), default=None)
        for n in nodes:
            if n["node_id"] in self.nodes:
                raise ValueError(f"a tree has two nodes {n['node_id']}")
            branches = [(b["condition"], b["condition"].lower(), b["next_node"]) for b in n["branches"] if b and b["condition"] is not None] if n["type"] == "decision" else []
            self.nodes[n["node_id"]] = (n["type"], branches, n["next_node"])

    def target(self, node: str | None, facts: dict[str, str | None], values: list[str]) -> str | None:
        kind, branches, onward = self.nodes.get(node, (None, (), None))
        if kind == "info":
            return onward
        for condition, low, after in branches:
            told = facts.get(condition)
            if told is not None and told.lower() == "true":
                return after
            for v in values:
                if v in low:
                    return after
        return None

    def of(self, facts: tuple) -> tuple[list[str | None], str | None, str | None]:
        """(path, its end, the end's type)"""
        way = self.ways.get(facts)
        if way is None:
            known, values, path = dict(facts), [v.lower() for _, v in facts if v], [self.root]
            while self.steps is None or len(path) <= self.steps:
                t = self.target(path[-1], known, values)
                if t is None or t not in self.nodes or t in path:
                    break
                path.append(t)
            way = path, path[-1], self.nodes.get(path[-1], (None,))[0]
            if len(self.ways) < WAYS:
                self.ways[facts] = way
        return way


#: Ways of one tree that a task remembers; rows that it turns into Python values at once.
WAYS, PIECE = 10_000, 1_000


def _walk(columns: int, schema: pa.Schema, steps: int | None) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        way, of = None, None
        for batch in batches:
            for a in range(0, batch.num_rows, PIECE):
                part = batch.slice(a, PIECE)
                at, ways = [], []
                for i, (tree, nodes, is_tree, facts) in enumerate(zip(*(part.column(j).to_pylist() for j in range(4)))):
                    if is_tree:
                        way, of = Way(nodes, steps), tree
                    elif of is not None and tree == of:  # cases of no known tree are left out
                        at.append(i)
                        ways.append(way.of(tuple(facts or ())))
                made = zip(*ways) if ways else [[]] * 3
                rows = pa.array(at, pa.int64())
                yield pa.record_batch([*(part.column(4 + j).take(rows).cast(schema.field(j).type) for j in range(columns)), *(pa.array(c, schema.field(columns + j).type) for j, c in enumerate(made))], schema=schema)

    return run


def resume(walked: DataFrame, more: DataFrame, nodes: DataFrame) -> DataFrame:
    """Walk again with more facts (case_id, more map): ``advanced`` if the old node is on the new path but not its end."""
    both = walked.select("case_id", "tree_id", "facts", F.col("node_id").alias("old_node")).join(more, "case_id")
    both = both.withColumn("facts", F.map_concat(F.map_filter("facts", lambda k, v: ~F.map_contains_key("more", k)), "more"))
    again = walk(both.drop("more"), nodes)
    place = F.array_position("path", F.col("old_node"))
    return again.withColumn("advanced", (place > 0) & (place < F.size("path")))


def answer_text(node: dict[str, Column] | None = None) -> Column:
    """Title, law, summary, details, warnings, steps and references of a result row joined with its tree."""
    def listed(title: str, items: Column) -> Column:
        return F.when(F.size(items) > 0, F.concat(F.lit(f"\n{title}\n"), F.array_join(F.transform(items, lambda x: F.concat(F.lit("  • "), x)), "\n")))

    refs = F.when(F.size("legal_refs") > 0, F.col("legal_refs")).when(F.col("legal_ref") != "", F.array("legal_ref")).otherwise(F.array().cast("array<string>"))
    way = F.concat(F.lit("\nCamino: "), F.array_join("path", " → "))
    return F.concat_ws("\n", "title", F.concat_ws(" | ", "law", "article"), F.col("summary"), F.when(F.col("details") != "", F.col("details")), listed("ADVERTENCIAS:", F.col("warnings")), listed("PRÓXIMOS PASOS:", F.col("next_steps")), listed("FUNDAMENTO LEGAL:", refs), way)


def pending_text() -> Column:
    """Question, help, reference and numbered options of a decision row."""
    options = F.array_join(F.transform("branches", lambda b, i: F.concat((i + 1).cast("string"), F.lit(". "), b["condition"])), "\n")
    return F.concat_ws("\n", "question", F.when(F.col("help") != "", F.col("help")), F.when(F.col("legal_ref") != "", F.col("legal_ref")), options)


def _onward(label: int) -> Column:
    """(target, label) of a node's edges: of its branches with a target, else of the next node."""
    plain = F.array(F.struct(F.col("next_node").alias("target"), F.lit("").alias("label")))
    branches = F.transform("branches", lambda b: F.struct(b["next_node"].alias("target"), F.left(b["condition"], F.lit(label)).alias("label")))
    led = F.filter(branches, lambda e: F.coalesce(e["target"], F.lit("")) != "")
    return F.when(F.size("branches") > 0, led).when(F.col("next_node") != "", plain).otherwise(F.filter(plain, lambda e: F.lit(False)))


def tree_edges(nodes: DataFrame, label: int = 24) -> DataFrame:
    """(tree_id, source, target, label): branches with a target, else the next node."""
    return nodes.select("tree_id", F.col("node_id").alias("source"), F.explode(_onward(label)).alias("_e")).select("tree_id", "source", "_e.target", "_e.label")


def dangling(nodes: DataFrame, label: int = 24) -> DataFrame:
    """Edges to nodes that their tree lacks. Nodes and the ends of edges meet in one shuffle, so the trees are read once."""
    edge = lambda target, source, text: F.struct(target.alias("target"), source.alias("source"), text.alias("label"))
    none = F.lit(None).cast("string")
    ends = F.concat(F.array(edge(F.col("node_id"), none, none)), F.transform(_onward(label), lambda e: edge(e["target"], F.col("node_id"), e["label"])))
    rows = nodes.select("tree_id", F.explode(ends).alias("_e")).select("tree_id", "_e.*")
    met = rows.groupBy("tree_id", "target").agg(F.max(F.col("source").isNull()).alias("_known"), F.collect_list(F.when(F.col("source").isNotNull(), F.struct("source", "label"))).alias("_edges"))
    return met.filter(~F.col("_known")).select("tree_id", "target", F.explode("_edges").alias("_e")).select("tree_id", "target", "_e.source", "_e.label")


def conditions(nodes: DataFrame, first: int = 30) -> DataFrame:
    """(tree_id, conditions): distinct branch conditions, sorted, the first of them."""
    rows = nodes.select("tree_id", F.explode("branches.condition").alias("c"))
    return rows.groupBy("tree_id").agg(F.slice(F.array_sort(F.collect_set("c")), 1, first).alias("conditions"))


def catalogue(trees: DataFrame) -> DataFrame:
    return trees.select("tree_id", "title", "article", (F.size(F.map_keys("nodes")) + 1).alias("n_nodes"))
