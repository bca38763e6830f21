"""Phylogenetic trees: parsing and writing Newick, validation, metrics and placement insertion.

A tree is a relation of nodes (node_index, name, branch_length, edge_id, parent_index, is_tip); one
tree fits a task, forests are many rows. All walks use explicit stacks.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lichenmill.scratch import scratch_table

NO_LENGTH = math.nan
_SPECIAL = set(" ()[]{}':;,\"\t\n\r")


@dataclass
class Node:
    name: str = ""
    length: float = NO_LENGTH
    edge: int | None = None
    parent: "Node | None" = None
    children: list["Node"] = field(default_factory=list)


class NewickError(ValueError):
    pass


class _Scanner:
    """Tokens of the first tree in a text; comments in brackets, nested ones too, are left out."""

    def __init__(self, text: str):
        self.text, self.at = text, 0

    def skip(self) -> None:
        t, depth = self.text, 0
        while self.at < len(t):
            c = t[self.at]
            if c == "[":
                depth += 1
            elif c == "]" and depth:
                depth -= 1
            elif not depth and not c.isspace():
                return
            self.at += 1
        if depth:
            raise NewickError("Unterminated comment")

    def peek(self) -> str:
        self.skip()
        return self.text[self.at] if self.at < len(self.text) else ""

    def label(self) -> str:
        c = self.peek()
        t = self.text
        if c in ("'", '"') and c:
            out, i = [], self.at + 1
            while i < len(t):
                if t[i] == c:
                    if t[i + 1 : i + 2] == c:
                        out.append(c)
                        i += 2
                        continue
                    self.at = i + 1
                    return "".join(out)
                out.append(t[i])
                i += 1
            raise NewickError("Unterminated quoted label")
        start = self.at
        while self.at < len(t) and t[self.at] not in "()[]{}:;,'\"" and not t[self.at].isspace():
            self.at += 1
        return t[start : self.at]

    def number(self) -> float:
        self.peek()
        start = self.at
        while self.at < len(self.text) and self.text[self.at] in "+-.0123456789eEinfaINFA":
            self.at += 1
        try:
            return float(self.text[start : self.at])
        except ValueError:
            raise NewickError(f"Invalid branch length '{self.text[start : self.at]}'") from None

    def edge(self) -> int:
        self.at += 1
        end = self.text.find("}", self.at)
        if end < 0:
            raise NewickError("Unterminated edge identifier")
        digits = self.text[self.at : end].strip()
        if not digits.lstrip("-").isdigit():
            raise NewickError(f"Invalid edge identifier '{digits}'")
        self.at = end + 1
        return int(digits)


def parse_newick(text: str) -> Node:
    """The root of the first tree of ``text``; errors are strict."""
    s = _Scanner(text)
    if not s.peek():
        raise NewickError("Empty Newick input")
    root = node = Node()
    opened = 0

    def finish(n: Node) -> None:
        n.name = s.label()
        while (c := s.peek()) in (":", "{") and c:
            if c == ":":
                s.at += 1
                n.length = s.number()
            else:
                n.edge = s.edge()

    while True:
        c = s.peek()
        if c == "(":
            s.at += 1
            opened += 1
            node.children.append(child := Node(parent=node))
            node = child
            continue
        finish(node)
        # a node is complete: go on to a sibling, up, or to the end
        while True:
            c = s.peek()
            if c == "," and node.parent:
                s.at += 1
                node.parent.children.append(child := Node(parent=node.parent))
                node = child
                break
            if c == ")" and node.parent:
                s.at += 1
                opened -= 1
                node = node.parent
                finish(node)
                continue
            if c == ";":
                if opened or node is not root:
                    raise NewickError("Unbalanced parentheses")
                return root
            raise NewickError(f"Unexpected {'end of input' if not c else repr(c)} at position {s.at}")


def postorder(root: Node) -> list[Node]:
    out, stack = [], [root]
    while stack:
        n = stack.pop()
        out.append(n)
        stack.extend(n.children)
    return out[::-1]


def preorder(root: Node) -> list[Node]:
    out, stack = [], [root]
    while stack:
        n = stack.pop()
        out.append(n)
        stack.extend(reversed(n.children))
    return out


def node_rows(root: Node) -> list[tuple]:
    """Rows of the tree relation, children numbered before their parents, the root last."""
    order = postorder(root)
    number = {id(n): i for i, n in enumerate(order)}
    return [
        (i, n.name, None if math.isnan(n.length) else n.length, n.edge, number[id(n.parent)] if n.parent else None, not n.children)
        for i, n in enumerate(order)
    ]


def quote(name: str) -> str:
    return "'" + name.replace("'", "''") + "'" if any(c in _SPECIAL for c in name) else name


def to_newick(root: Node, edge_ids: bool = False) -> str:
    text: dict[int, str] = {}
    for n in postorder(root):
        kids = ",".join(text.pop(id(c)) for c in n.children)
        out = (f"({kids})" if n.children else "") + quote(n.name)
        if not math.isnan(n.length):
            out += ":" + format(n.length, ".15g")
        if edge_ids and n.edge is not None:
            out += f"{{{n.edge}}}"
        text[id(n)] = out
    return text[id(root)] + ";"


def build_tree(rows: list[dict]) -> Node:
    """A tree from node rows: one root, valid parents, no repeated id, no cycle."""
    if not rows:
        raise ValueError("Cannot write an empty tree: no rows")
    nodes: dict[int, Node] = {}
    for r in rows:
        i = r.get("node_index")
        if i is None:
            raise ValueError("NULL node_index")
        if i in nodes:
            raise ValueError(f"Duplicate node_index {i}")
        length = r.get("branch_length")
        if length is not None and length < 0:
            raise ValueError(f"Negative branch_length {length} at node {i}")
        nodes[i] = Node(r.get("name") or "", NO_LENGTH if length is None else float(length), r.get("edge_id"))
    roots = []
    for r in rows:
        p = r.get("parent_index")
        n = nodes[r["node_index"]]
        if p is None:
            roots.append(n)
        elif p not in nodes:
            raise ValueError(f"parent_index {p} of node {r['node_index']} does not exist")
        else:
            n.parent = nodes[p]
            nodes[p].children.append(n)
    if len(roots) != 1:
        raise ValueError(f"A tree has exactly one root (NULL parent_index), not {len(roots)}")
    if len(preorder(roots[0])) != len(nodes):
        raise ValueError("The nodes do not form one tree below the root: there is a cycle")
    return roots[0]


# --- metrics -------------------------------------------------------------------------------------


def tips(root: Node) -> list[Node]:
    return [n for n in preorder(root) if not n.children]


def tip_names(root: Node) -> list[str]:
    return [n.name for n in tips(root)]


def distance_to_root(node: Node) -> float:
    """Sum of the lengths up to the root; an absent length counts 0."""
    total = 0.0
    while node.parent:
        total += 0.0 if math.isnan(node.length) else node.length
        node = node.parent
    return total


def find_lca(a: Node, b: Node) -> Node:
    above = set()
    n: Node | None = a
    while n:
        above.add(id(n))
        n = n.parent
    n = b
    while id(n) not in above:
        n = n.parent
    return n


def pairwise_distance(a: Node, b: Node) -> float:
    return distance_to_root(a) + distance_to_root(b) - 2 * distance_to_root(find_lca(a, b))


def _kept(df: DataFrame) -> DataFrame:
    """``df`` written and read back, so that a round's plan does not hold those before it."""
    at = scratch_table(df.sparkSession, "tree")
    df.write.parquet(at)
    return df.sparkSession.read.schema(df.schema).parquet(at)


def _jumps(nodes: DataFrame) -> list[DataFrame]:
    """Tables (node_index, up, depth, distance): 1, 2, 4, ... edges up, as far as the root; ``up`` is NULL where that is reached.

    Each is the one before it joined with itself, so a tree of depth d takes log2(d) joins.
    """
    root = F.col("parent_index").isNull()
    length = F.when(root | F.isnan(F.coalesce("branch_length", F.lit(0.0))), 0.0).otherwise(F.coalesce("branch_length", F.lit(0.0)))
    out = [_kept(nodes.select("node_index", F.col("parent_index").alias("up"), F.when(root, 0).otherwise(1).cast("bigint").alias("depth"), length.cast("double").alias("distance")))]
    most = out[0].count().bit_length()
    while not out[-1].where("up is not null").isEmpty():
        if len(out) > most:  # no path is longer than all nodes
            raise ValueError("Tree has a cycle")
        s, t = out[-1].alias("s"), out[-1].alias("t")
        more = lambda c: F.col(f"s.{c}") + F.coalesce(f"t.{c}", F.lit(0))
        out.append(_kept(s.join(t, F.col("s.up") == F.col("t.node_index"), "left").select("s.node_index", "t.up", more("depth").alias("depth"), more("distance").alias("distance"))))
    return out


def depths(nodes: DataFrame) -> DataFrame:
    """node_index, depth, distance_to_root of all nodes of one or more trees."""
    return _jumps(nodes)[-1].select("node_index", F.col("depth").cast("int").alias("depth"), F.col("distance").alias("distance_to_root"))


def tip_rows(nodes: DataFrame) -> DataFrame:
    """The rows of ``nodes`` without children."""
    parents = nodes.where("parent_index is not null").select(F.col("parent_index").alias("__parent")).distinct()
    return nodes.join(parents, F.col("node_index") == F.col("__parent"), "left_anti")


def common_ancestors(nodes: DataFrame, pairs: DataFrame) -> DataFrame:
    """a, b, ancestor, distance of each pair (a, b) of nodes of one tree: their lowest common ancestor and the path between them.

    The deeper node climbs to the other's depth, then both climb while they differ, by halving jumps:
    a join for each, whatever the number of pairs. Nodes of different trees have none.
    """
    jumps = _jumps(nodes)
    whole = jumps[-1].select("node_index", "depth", "distance")
    now = pairs.select("a", "b")
    for c in ("a", "b"):
        now = now.join(whole.toDF(c, f"depth_{c}", f"distance_{c}"), c)
    deeper = F.col("depth_a") >= F.col("depth_b")
    now = now.select("a", "b", "distance_a", "distance_b", F.when(deeper, F.col("a")).otherwise(F.col("b")).alias("x"), F.when(deeper, F.col("b")).otherwise(F.col("a")).alias("y"), F.abs(F.col("depth_a") - F.col("depth_b")).alias("gap"))
    up = lambda k, c: jumps[k].select(F.col("node_index").alias(c), F.col("up").alias(f"{c}_up"))
    for k in reversed(range(len(jumps))):
        lifted = now.join(up(k, "x"), "x", "left").withColumn("x", F.when(F.col("gap") >= 1 << k, F.col("x_up")).otherwise(F.col("x")))
        now = _kept(lifted.withColumn("gap", F.when(F.col("gap") >= 1 << k, F.col("gap") - (1 << k)).otherwise(F.col("gap"))).drop("x_up"))
    for k in reversed(range(len(jumps))):
        both = now.join(up(k, "x"), "x", "left").join(up(k, "y"), "y", "left")
        differ = (F.col("x") != F.col("y")) & F.col("x_up").isNotNull() & F.col("y_up").isNotNull() & (F.col("x_up") != F.col("y_up"))
        now = _kept(both.select("a", "b", "distance_a", "distance_b", "gap", F.when(differ, F.col("x_up")).otherwise(F.col("x")).alias("x"), F.when(differ, F.col("y_up")).otherwise(F.col("y")).alias("y")))
    last = now.join(up(0, "x"), "x", "left").join(up(0, "y"), "y", "left")
    found = last.select("a", "b", "distance_a", "distance_b", F.when(F.col("x") == F.col("y"), F.col("x")).when(F.col("x_up") == F.col("y_up"), F.col("x_up")).alias("ancestor"))
    above = whole.select(F.col("node_index").alias("ancestor"), F.col("distance").alias("above"))
    return found.join(above, "ancestor", "left").select("a", "b", "ancestor", (F.col("distance_a") + F.col("distance_b") - 2 * F.col("above")).alias("distance"))


# --- placements ----------------------------------------------------------------------------------

EPSILON = 1e-9
# Fixed value: the most nodes that a tree may have.
MOST_NODES = 4294967294


@dataclass
class Placement:
    fragment: str
    edge: int
    ratio: float
    distal: float
    pendant: float


def best_placements(placements: list[Placement]) -> list[Placement]:
    """One a fragment: the largest ratio, within EPSILON the smaller pendant length, the first seen first."""
    best: dict[str, Placement] = {}
    for p in placements:
        b = best.get(p.fragment)
        if b is None or p.ratio > b.ratio + EPSILON or (abs(p.ratio - b.ratio) <= EPSILON and p.pendant < b.pendant):
            best[p.fragment] = p
    return list(best.values())


def best_placements_frame(df: DataFrame) -> DataFrame:
    """The same for a relation of any size: of the ratios within EPSILON of the largest, the smallest pendant length, then edge_id.

    Both steps are aggregations, so a fragment with most placements is folded before the shuffle.
    """
    rows = df.where("fragment_id is not null")
    most = rows.groupBy("fragment_id").agg(F.max("like_weight_ratio").alias("__most"))
    near = rows.join(most, "fragment_id").where(F.col("like_weight_ratio") >= F.col("__most") - EPSILON)
    others = [c for c in df.columns if c not in ("fragment_id", "pendant_length", "edge_id")]
    least = near.groupBy("fragment_id").agg(F.min(F.struct("pendant_length", "edge_id", *others)).alias("__best"))
    return least.select("fragment_id", "__best.*").select(*df.columns)


def placement_problem(p: dict[str, Column], length: Column, known: Column) -> Column:
    """What is wrong with a placement on an edge of that ``length`` (NULL: absent, which no distal length exceeds); NULL if nothing is."""
    of = F.concat(F.lit(" for fragment '"), p["fragment_id"], F.lit("'"))
    text = lambda c: c.cast("string")
    out = None
    for c in ("edge_id", "like_weight_ratio", "distal_length", "pendant_length"):
        said = F.concat(F.lit(f"NULL {c}"), of)
        out = F.when(p[c].isNull(), said) if out is None else out.when(p[c].isNull(), said)
    out = out.when(~known, F.concat(F.lit("Unknown edge_id "), text(p["edge_id"]), of))
    for c in ("distal_length", "pendant_length"):
        out = out.when(p[c] < 0, F.concat(F.lit(f"Negative {c}"), of))
    beyond = F.concat(F.lit("distal_length "), text(p["distal_length"]), F.lit(" exceeds edge length "), text(length), of)
    return out.when(length.isNotNull() & ~F.isnan(length) & (p["distal_length"] > length), beyond)


def insert_placements(root: Node, placements: list[Placement]) -> Node:
    """Insert every fragment as a tip of its own on its edge, farthest from the edge's child first; the root, which may be new.

    On an edge without a length any distal length is allowed, and the uppermost new edge has no length either.
    """
    nodes = list(preorder(root))
    edges = {n.edge: n for n in nodes if n.edge is not None}
    for p in placements:
        if p.edge not in edges:
            raise ValueError(f"Unknown edge_id {p.edge} for fragment '{p.fragment}'")
        if p.distal < 0 or p.pendant < 0:
            raise ValueError(f"Negative {'distal_length' if p.distal < 0 else 'pendant_length'} for fragment '{p.fragment}'")
        if p.distal > edges[p.edge].length:  # never of an absent length
            raise ValueError(f"distal_length {p.distal} exceeds edge length {edges[p.edge].length} for fragment '{p.fragment}'")
    best = best_placements(placements)
    check_node_limit(len(nodes), len(best))
    by_edge: dict[int, list[Placement]] = {}
    for p in best:
        by_edge.setdefault(p.edge, []).append(p)
    for edge, items in by_edge.items():
        below = edges[edge]
        left = below.length
        above = below.parent
        place = above.children.index(below) if above else None
        for p in sorted(items, key=lambda p: -p.distal):
            joint = Node(length=left - p.distal, parent=above)
            tip = Node(p.fragment, p.pendant, parent=joint)
            if above is None:
                root = joint
            else:
                above.children[place] = joint
            joint.children = [below, tip]
            below.parent = joint
            above, place, left = joint, 0, p.distal
        below.length = left
    return root


def check_node_limit(nodes: int, fragments: int) -> None:
    if nodes + 2 * fragments > MOST_NODES:
        raise ValueError(f"Too many placements: would create {2 * fragments} new nodes, exceeding maximum of {MOST_NODES} total nodes")
