"""Pages as rows of elements, and the choice of the main content by sums over subtrees.

An element's number counts starts of elements in document order; `last` is the greatest number in its subtree, so a subtree
is an interval of numbers and what a subtree holds is a difference of two running sums. Pages are windows of their own;
nothing is visited again for each division.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField, StructType

from sourcelens.functions.pieces import by_row
from sourcelens.sources.parsers import DROP, Element, Tree

NODES = ArrayType(StructType([StructField(n, IntegerType()) for n in ("node", "last", "parent", "depth")] + [StructField(n, StringType()) for n in ("tag", "role", "id")] + [StructField("text", IntegerType())]))


def numbered(root: Element) -> list[tuple]:
    """(node, last, parent, depth, tag, role, id, text) of a page's elements; text: length of a paragraph's own text, noise left out."""
    out: list[list] = []
    todo: list[tuple] = [(e, None, 0) for e in reversed(root.items) if isinstance(e, Element)]
    while todo:
        e, parent, depth = todo.pop()
        if depth < 0:  # all of the subtree has been numbered
            out[parent][1] = len(out) - 1
            continue
        node = len(out)
        out.append([node, node, parent, depth, e.tag, e.attrs.get("role"), e.attrs.get("id"), paragraph(e) if e.tag == "p" else 0])
        todo.append((e, node, -1))
        todo += [(x, node, depth + 1) for x in reversed(e.items) if isinstance(x, Element)]
    return [tuple(r) for r in out]


def paragraph(p: Element) -> int:
    pieces: list[str] = []
    todo: list = [p]
    while todo:
        e = todo.pop()
        if isinstance(e, str):
            pieces.append(e)
        elif e.tag not in DROP:
            todo.extend(reversed(e.items))
    return len(" ".join(pieces).strip())


@by_row(NODES)
def parse_nodes(html: str | None) -> list[dict]:
    tree = Tree(html or "")
    found = [dict(zip(NODES.elementType.names, r)) for r in numbered(tree.root)]
    tree.forget()
    return found


def elements(pages: DataFrame, key: str = "page_id") -> DataFrame:
    """pages(key, html) -> (key, node, last, parent, depth, tag, role, id, text, noise): a row per element.

    noise: the element is one that is dropped, or lies in one: of the noise that has begun so far, some reaches to it.
    """
    n = pages.select(key, F.explode(parse_nodes("html")).alias("n")).select(key, "n.*")
    begun = Window.partitionBy(key).orderBy("node").rowsBetween(Window.unboundedPreceding, 0)
    reach = F.max(F.when(F.col("tag").isin(*sorted(DROP)), F.col("last"))).over(begun)
    return n.withColumn("noise", F.coalesce(reach >= F.col("node"), F.lit(False)))


def densities(nodes: DataFrame, key: str = "page_id") -> DataFrame:
    """elements() -> those that are no noise, with score: the length of all paragraphs' text in the subtree."""
    w = Window.partitionBy(key).orderBy("node")
    clean = F.when(F.col("noise"), 0).otherwise(F.col("text"))
    summed = nodes.withColumn("_to", F.sum(clean).over(w.rowsBetween(Window.unboundedPreceding, 0))).withColumn("_before", F.col("_to") - clean)
    ends = summed.select(F.col(key).alias("_key"), F.col("node").alias("_node"), F.col("_to").alias("_end"))
    met = summed.where("not noise").join(ends, F.col(key).eqNullSafe(F.col("_key")) & (F.col("last") == F.col("_node")))
    return met.withColumn("score", F.col("_end") - F.col("_before")).drop("_key", "_node", "_to", "_before", "_end")


def main_content(nodes: DataFrame, key: str = "page_id") -> DataFrame:
    """(key, node, tag, score) of each page's main content: the first main, article, main role, or id content or main; else
    the body, or the division or section with more paragraph text than it and all before. Pages without an element have none."""
    d = densities(nodes, key)
    named = F.when(F.col("tag") == "main", 0).when(F.col("tag") == "article", 1).when(F.col("role") == "main", 2).when(F.col("id") == "content", 3).when(F.col("id") == "main", 4)
    rank = F.coalesce(named, F.when(F.col("tag").isin("body", "div", "section"), 5), F.when(F.col("parent").isNull(), 6))
    # Within the last choice the most text wins, and the first of equals, which is the body or the outer element.
    order = F.struct(rank.alias("rank"), F.when(rank == 5, -F.col("score")).otherwise(0).alias("less"), "node")
    best = d.where(rank.isNotNull()).groupBy(key).agg(F.min_by(F.struct("node", "tag", "score"), order).alias("b"))
    return best.select(key, "b.*")
