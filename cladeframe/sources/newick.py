"""Newick trees as DataFrames.

``tree_nodes(node_id, parent_id, name, length, is_leaf, depth, pre, post, path)``: an edge is its lower node, ``pre``
and ``post`` are the first and last preorder number below a node, and a leaf's ``path`` holds the ids of its edges up
to the root. Lengths pass through FLOAT, as trees are usually kept in single precision.

Comments in brackets (nested too) are skipped. Labels of inner nodes, such as bootstrap values, are dropped; leaf
names may be quoted and keep any UTF-8. A leaf without a name is called ``L`` and its node id.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = (
    "node_id int, parent_id int, name string, length double, is_leaf boolean, depth double, pre int, post int"
)


@dataclass
class Tree:
    """Arrays by node id (preorder); the root's parent is -1."""

    parent: list[int]
    name: list[str]
    length: list[float]
    leaf: list[bool]

    def children(self) -> list[list[int]]:
        below: list[list[int]] = [[] for _ in self.parent]
        for node, up in enumerate(self.parent):
            if up >= 0:
                below[up].append(node)
        return below


def _label(text: str, at: int) -> tuple[str, int]:
    """A quoted or plain label that begins here, and where it ends."""
    if at < len(text) and text[at] in "'\"":
        quote, out, at = text[at], [], at + 1
        while at < len(text):
            c = text[at]
            if c == "\\" and at + 1 < len(text):
                out.append(text[at + 1])
                at += 2
            elif c == quote and text[at + 1 : at + 2] == quote:
                out.append(quote)
                at += 2
            elif c == quote:
                return "".join(out), at + 1
            else:
                out.append(c)
                at += 1
        raise ValueError("a quoted label has no end")
    start = at
    while at < len(text) and text[at] not in "(),:;[" and not text[at].isspace():
        at += 1
    return text[start:at], at


def parse(text: str) -> Tree:
    """The tree of one Newick string. Nodes are numbered in preorder."""
    parent, name, length, leaf = [], [], [], []
    stack: list[int] = []
    at, last, closed, comment = 0, -1, False, 0

    def node() -> int:
        parent.append(stack[-1] if stack else -1)
        name.append("")
        length.append(0.0)
        leaf.append(True)
        return len(parent) - 1

    while at < len(text):
        c = text[at]
        if comment or c == "[":
            comment += (c == "[") - (c == "]")
            at += 1
        elif c.isspace():
            at += 1
        elif c == "(":
            last = node()
            leaf[last] = False
            stack.append(last)
            last, closed, at = -1, False, at + 1
        elif c == ",":
            if last < 0:
                last = node()  # a leaf with neither name nor length
            last, closed, at = -1, False, at + 1
        elif c == ")":
            if not stack:
                raise ValueError(f"a closing parenthesis too many at {at}")
            if last < 0:
                node()
            last, closed, at = stack.pop(), True, at + 1
        elif c == ":":
            if last < 0:
                last = node()
            end = at + 1
            while end < len(text) and text[end] not in "(),;[":
                end += 1
            value = text[at + 1 : end].strip()
            length[last] = float(np.float32(value)) if value else 0.0
            at = end
        elif c == ";":
            break
        else:
            label, at = _label(text, at)
            if closed:
                continue  # the label of an inner node
            last = node()
            name[last] = label
    if stack:
        raise ValueError("a parenthesis is not closed")
    if comment:
        raise ValueError("a comment is not closed")
    if not parent:
        raise ValueError("the tree is empty")
    name = [n or (f"L{i}" if leaf[i] else "") for i, n in enumerate(name)]
    return Tree(parent, name, length, leaf)


def write(tree: Tree, labels: dict[int, str] | None = None) -> str:
    """Newick text with optional labels (such as support) on inner nodes."""
    below, labels = tree.children(), labels or {}
    done: dict[int, str] = {}
    for node in range(len(tree.parent) - 1, -1, -1):
        own = _quote(tree.name[node]) if tree.leaf[node] else labels.get(node, "")
        inner = "(" + ",".join(done.pop(c) for c in below[node]) + ")" if below[node] else ""
        tail = f":{np.float32(tree.length[node])!s}" if tree.parent[node] >= 0 else ""
        done[node] = inner + own + tail
    return done[0] + ";"


def _quote(name: str) -> str:
    return "'" + name.replace("\\", "\\\\").replace("'", "''") + "'" if any(c in "(),:;[]'\" \t\n\\" for c in name) else name


def rows(tree: Tree, include_root_length: bool = True) -> list[tuple]:
    """Every column of ``tree_nodes`` but the paths, whose lengths add up to the leaves times the height."""
    n = len(tree.parent)
    post = list(range(n))
    for node in range(n - 1, 0, -1):
        up = tree.parent[node]
        post[up] = max(post[up], post[node])
    depth, out = [0.0] * n, []
    for node in range(n):
        up = tree.parent[node]
        long = tree.length[node] if up >= 0 or include_root_length else 0.0
        depth[node] = long + (depth[up] if up >= 0 else 0.0)
        out.append((node, up if up >= 0 else None, tree.name[node] or None, long, tree.leaf[node], depth[node], node, post[node]))
    return out


def above(parent: np.ndarray, nodes: np.ndarray) -> list[np.ndarray]:
    """Each node, its parent and so on up to the root; all nodes go up one step at a time, together."""
    who, at = np.arange(len(nodes)), np.asarray(nodes, np.int32)
    steps = []
    while len(at):
        steps.append((who, at))
        at = parent[at]
        who, at = who[at >= 0], at[at >= 0]
    if not steps:
        return []
    who, at = (np.concatenate(c) for c in zip(*steps, strict=True))
    ends = np.cumsum(np.bincount(who, minlength=len(nodes)))
    return np.split(at[np.argsort(who, kind="stable")], ends[:-1])


def tree_nodes(spark: SparkSession, text: str, include_root_length: bool = True) -> DataFrame:
    """The nodes of a tree. Tasks walk up the parents for the paths of their leaves, and only if ``path`` is asked for."""
    tree = parse(text)
    parent = np.array(tree.parent, np.int32)

    @F.pandas_udf("array<int>")
    def path(leaf: pd.Series) -> pd.Series:
        out = pd.Series([None] * len(leaf), dtype=object)
        some = np.flatnonzero(leaf.notna())
        out.iloc[some] = pd.Series(above(parent, leaf.iloc[some].to_numpy(np.int32)), dtype=object)
        return out

    nodes = spark.createDataFrame(rows(tree, include_root_length), SCHEMA)
    return nodes.withColumn("path", path(F.when(F.col("is_leaf"), F.col("node_id"))))


def read_newick(spark: SparkSession, path: str, include_root_length: bool = True) -> DataFrame:
    """The tree in one file, read by Spark, so that it may lie in any store."""
    return tree_nodes(spark, spark.read.text(path, wholetext=True).first()[0], include_root_length)


def tree_paths(nodes: DataFrame) -> DataFrame:
    """``feature_id, edge_id, length`` for every edge of positive length above each leaf. Of equal names the last leaf counts."""
    leaves = nodes.filter("is_leaf").groupBy("name").agg(F.max_by("path", "node_id").alias("path"))
    steps = leaves.select(F.col("name").alias("feature_id"), F.explode("path").alias("edge_id"))
    edges = nodes.filter("length > 0").select(F.col("node_id").alias("edge_id"), "length")
    return steps.join(edges, "edge_id").select("feature_id", "edge_id", "length")


def closure(spark: SparkSession, nodes: DataFrame, most: int = 64) -> DataFrame:
    """``node_id, edge_id`` for each node and all edges above it, from ``node_id, parent_id`` alone.

    For trees that exist as tables: jumps double in length each round, so rounds grow as the logarithm of the height.
    """
    from cladeframe.session import materialise

    jump = materialise(nodes.filter("parent_id is not null").select("node_id", F.col("parent_id").alias("up")), "jump")
    reach = materialise(nodes.select("node_id", F.col("node_id").alias("edge_id")), "reach")
    for _ in range(most):
        if jump.isEmpty():
            return reach
        step = jump.join(reach.withColumnRenamed("node_id", "up"), "up").select("node_id", "edge_id")
        reach = materialise(reach.unionByName(step).distinct(), "reach")
        jump = materialise(jump.join(jump.select(F.col("node_id").alias("up"), F.col("up").alias("upper")), "up").select("node_id", F.col("upper").alias("up")), "jump")
    raise ValueError("the parents do not form a tree")
