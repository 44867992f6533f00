"""Property graph over DataFrames: node and edge sets with integrity rules, and a pattern DSL."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .relational import keep_first, upsert
from .storage import PARTITIONS, forget, stored

#: Starts of paths that path_counts() gives a column each.
WIDE = 64


@dataclass
class NodeSet:
    """Nodes of one label: id and properties, no null ids, one row for each id."""

    df: DataFrame
    label: str
    extra_labels: tuple[str, ...] = ()
    id_col: str = "id"
    #: df, and what all ids of were taken into it
    made: tuple = ()

    def holds(self, *source) -> bool:
        """Whether all ids of these records and columns are nodes, as long as df is the one made of them."""
        return self.made == (self.df, *source)

    @classmethod
    def build(cls, df: DataFrame, label: str, id_col: str, properties: list[dict] | None = None, extra_labels: tuple[str, ...] = (), order: list[str] | None = None) -> NodeSet:
        rules = [r for r in properties or [] if r["new"] != "id"]
        df = df.withColumn("__id", F.col(id_col).cast("string"))
        made = df.select(F.col("__id").alias("id"), *_projected(rules), *(F.col(o).alias(f"__o{i}") for i, o in enumerate(order or [])))
        made = made.filter("id is not null")
        ranked = keep_first(made, ["id"], [*(f"__o{i}" for i in range(len(order or []))), *(c for c in made.columns if c != "id" and c[:2] != "__")] or ["id"])
        return cls(ranked.drop(*(f"__o{i}" for i in range(len(order or [])))), label, tuple(extra_labels))

    @property
    def labels(self) -> str:
        return ";".join([self.label, *self.extra_labels])

    def merged(self, batch: NodeSet) -> NodeSet:
        return NodeSet(upsert(self.df, batch.df, ["id"]), self.label, self.extra_labels)

    def export_rows(self, reference: str | None = None) -> DataFrame:
        ref = reference or self.label.lower()
        return export_rows(self.df.withColumnRenamed("id", f"id:ID({ref}-ref)").withColumn(":LABEL", F.lit(self.labels)), "nodes")


def _projected(rules: list[dict]) -> list[Column]:
    from ..functions.columns import spark_type

    return [F.col(r["old"]).cast(spark_type(r["type"])).alias(r["new"]) for r in rules]


@dataclass
class EdgeSet:
    """Edges of one type: src, dst and properties; both ends known, one row for each pair, no loops
    between nodes of one set."""

    df: DataFrame
    type: str
    same_set: bool = False
    #: df, and the nodes that its ends were looked up in
    known: tuple = ()

    def written(self, *columns: str) -> EdgeSet:
        """The same edges with these columns only, as a table in the shared folder."""
        df = stored(self.df.select(*columns))
        return EdgeSet(df, self.type, self.same_set, (df, *self.known[1:]) if self.known and self.known[0] is self.df else ())

    @classmethod
    def build(cls, df: DataFrame, type: str, src: str, dst: str, start: NodeSet | None = None, end: NodeSet | None = None, properties: list[dict] | None = None, allow_unknown: bool = False, order: list[str] | None = None, sure: tuple[str, ...] = ()) -> EdgeSet:
        """`sure` names the sides (src, dst) whose ids are all nodes, so that they aren't looked up."""
        made = df.select(F.col(src).cast("string").alias("src"), F.col(dst).cast("string").alias("dst"), *_projected(properties or []), *(F.col(o).alias(f"__o{i}") for i, o in enumerate(order or [])))
        made = made.filter("src is not null and dst is not null")
        rest = [*(f"__o{i}" for i in range(len(order or []))), *(r["new"] for r in properties or [])]
        made = keep_first(made, ["src", "dst"], rest or ["src"]).drop(*(f"__o{i}" for i in range(len(order or []))))
        if not allow_unknown:
            for side, nodes in (("src", start), ("dst", end)):
                if nodes is not None and side not in sure:
                    made = made.join(nodes.df.select(F.col("id").alias(side)), side, "left_semi")
        same = start is not None and end is not None and start.label == end.label
        if same:
            made = made.filter("src <> dst")
        made = made.select("src", "dst", *(r["new"] for r in properties or []))
        both = start is not None and end is not None and not allow_unknown
        return cls(made, type, same, (made, start.df, end.df) if both else ())

    def merged(self, batch: EdgeSet, start: NodeSet, end: NodeSet) -> EdgeSet:
        """Batch edges whose two ends exist are merged on (src, dst)."""
        known = batch.df.join(start.df.select(F.col("id").alias("src")), "src", "left_semi").join(end.df.select(F.col("id").alias("dst")), "dst", "left_semi")
        return EdgeSet(upsert(self.df, known, ["src", "dst"]), self.type, self.same_set)

    def inverted(self, type: str | None = None) -> EdgeSet:
        rest = [c for c in self.df.columns if c not in ("src", "dst")]
        return EdgeSet(self.df.select(F.col("dst").alias("src"), F.col("src").alias("dst"), *rest), type or self.type, self.same_set)

    def undirected(self) -> DataFrame:
        return self.df.select("src", "dst").union(self.df.select(F.col("dst"), F.col("src")))

    def export_rows(self, start: str, end: str) -> DataFrame:
        df = self.df.withColumnsRenamed({"src": f":START_ID({start}-ref)", "dst": f":END_ID({end}-ref)"}).withColumn(":TYPE", F.lit(self.type))
        return export_rows(df, "relationships")


def export_rows(df: DataFrame, kind: str = "nodes") -> DataFrame:
    """Columns as the graph import format writes them: all strings; lists by `;` under a header with [],
    timestamps ISO, booleans lower case, no line breaks."""
    cols = df.columns
    wanted = (":LABEL", ":ID") if kind == "nodes" else (":TYPE", ":START_ID", ":END_ID")
    missing = [w for w in wanted if not any(w in c for c in cols)]
    if missing:
        raise ValueError(f"export of {kind} lacks {missing}")
    out = []
    for c, t in df.dtypes:
        x = F.col(f"`{c}`")
        if t.startswith("array"):
            out.append(F.array_join(F.transform(x, lambda v: v.cast("string")), ";").alias(c if c.endswith("[]") else f"{c}[]"))
        elif t.startswith("timestamp"):
            out.append(F.date_format(x, "yyyy-MM-dd'T'HH:mm:ss").alias(c))
        elif t == "boolean":
            out.append(F.lower(x.cast("string")).alias(c))
        elif t == "string":
            out.append(F.regexp_replace(x, "[\r\n]+", " ").alias(c))
        else:
            out.append(x.cast("string").alias(c))
    return df.select(*out)


@dataclass
class PropertyGraph:
    """Node sets by label and edge sets by type, with their labels at both ends."""

    nodes: dict[str, NodeSet] = field(default_factory=dict)
    edges: dict[str, tuple[str, EdgeSet, str]] = field(default_factory=dict)

    def add_nodes(self, nodes: NodeSet) -> PropertyGraph:
        self.nodes[nodes.label] = nodes
        return self

    def add_edges(self, start: str, edges: EdgeSet, end: str) -> PropertyGraph:
        self.edges[edges.type] = (start, edges, end)
        return self

    def schema(self) -> dict:
        return {"nodes": {k: v.df.schema.simpleString() for k, v in self.nodes.items()}, "edges": {k: (a, e.df.schema.simpleString(), b) for k, (a, e, b) in self.edges.items()}}

    def match(self, rel: str | list[str], src_where: Column | None = None, dst_where: Column | None = None, direction: str = "out", optional: bool = False) -> DataFrame:
        """One hop (src)-[rel]->(dst) as columns src_*, rel_*, dst_*; `in` turns the hop round, `both` takes
        either way; optional keeps sources without a hop."""
        rels = [rel] if isinstance(rel, str) else rel
        parts = []
        for r in rels:
            start, e, end = self.edges[r]
            for way in ("out", "in") if direction == "both" else (direction,):
                a, b, edges = (start, end, e) if way == "out" else (end, start, e.inverted())
                left = _prefixed(self.nodes[a].df, "src")
                right = _prefixed(self.nodes[b].df, "dst")
                if src_where is not None:
                    left = left.filter(src_where)
                if dst_where is not None:
                    right = right.filter(dst_where)
                hop = edges.df.select(F.col("src").alias("src_id"), F.col("dst").alias("dst_id"), *(F.col(c).alias(f"rel_{c}") for c in edges.df.columns if c not in ("src", "dst")), F.lit(r).alias("rel_type"))
                parts.append(left.join(hop.join(right, "dst_id"), "src_id", "left" if optional else "inner"))
        out = parts[0]
        for p in parts[1:]:
            out = out.unionByName(p, allowMissingColumns=True)
        return out

    def path(self, hops: list[tuple[str, str]], start_where: Column | None = None) -> DataFrame:
        """A chain of hops (type, direction) as columns n0_*, r1_*, n1_*, r2_*, ...; direction is `out`, `in`
        or `both`, and a type may be several, parted by `|`. `A|B*1..3` stands for one to three hops, no edge
        twice among them: then r*_types and r*_edges are lists, and of the last node there are id and label.
        start_where tells of n0_*."""
        out = None
        for k, (rel, way) in enumerate(hops, 1):
            before, at = f"n{k - 1}_", f"n{k - 1}_id"
            several = re.fullmatch(r"(.*)\*(\d+)\.\.(\d+)", rel)
            if several:
                rels, least, most = several[1], int(several[2]), int(several[3])
                if out is None:
                    labels = sorted({a for a, *_ in self._ends(rels.split("|"), way)})
                    for label in labels:
                        own = _prefixed(self.nodes[label].df, "n0").withColumn("n0_label", F.lit(label))
                        own = own if start_where is None else own.filter(start_where)
                        out = own if out is None else out.unionByName(own, allowMissingColumns=True)
                label = [f"{before}label"] if f"{before}label" in out.columns else []
                starts = out.select(*(F.col(c).alias("label") for c in label), F.col(at).alias("id")).distinct()
                found = self.expand(rels, starts, least, most, way)
                names = {"start_id": at, "edges": f"r{k}_edges", "types": f"r{k}_types", "hops": f"r{k}_hops", "end_id": f"n{k}_id", "end_label": f"n{k}_label", "nodes": f"r{k}_nodes"}
                found = found.withColumnsRenamed(names | {"start_label": f"{before}label"} if label else names)
                out = out.join(found if label else found.drop("start_label"), [at, *label])
                continue
            hop = self.match(rel.split("|"), direction=way)
            names = {c: {"src": f"n{k - 1}", "rel": f"r{k}", "dst": f"n{k}"}[c[:3]] + c[3:] for c in hop.columns}
            hop = hop.withColumnsRenamed(names)
            if out is None:
                out = hop if start_where is None else hop.filter(start_where)
            else:
                out = out.join(hop.select(at, *(c for c in hop.columns if not c.startswith(before))), at)
        return out

    def _ends(self, rels: list[str], direction: str) -> list[tuple[str, str, str, str]]:
        """(from label, to label, type, out or in) of every way to go along the types."""
        return [w for w in self._ways(rels) if direction in (w[3], "both")]

    def _ways(self, rels: list[str]) -> list[tuple[str, str, str, str]]:
        """_ends() of both directions: a type's two ways are at 2n and 2n + 1."""
        return [w for r in rels for a, _, b in (self.edges[r],) for w in ((a, b, r, "out"), (b, a, r, "in"))]

    def _hops(self, rels: list[str], direction: str) -> DataFrame:
        """(hop, from_id, to_id) of all single hops; hop is a place in _ways(). An edge that is gone both ways
        is looked up once. Ends that are no nodes of their sets give none."""
        parts = []
        for i, r in enumerate(rels):
            start, edges, end = self.edges[r]
            e = edges.df.select("src", "dst")
            looked_up = edges.known == (edges.df, self.nodes[start].df, self.nodes[end].df)
            for label, side in () if looked_up else ((start, "src"), (end, "dst")):
                e = e.join(self.nodes[label].df.select(F.col("id").alias(side)), side, "left_semi")
            out, back = (F.struct(F.lit(2 * i + k).cast("tinyint").alias("hop"), F.col(x).alias("from_id"), F.col(y).alias("to_id")) for k, x, y in ((0, "src", "dst"), (1, "dst", "src")))
            once = (F.col("src") == F.col("dst")) & F.lit(start == end)  # such a loop goes one way
            both = F.explode(F.when(once, F.array(out)).otherwise(F.array(out, back)))
            parts.append(e.select({"out": out, "in": back, "both": both}[direction].alias("h")).select("h.*"))
        made = parts[0]
        for p in parts[1:]:
            made = made.union(p)
        return made

    def steps(self, rels: list[str], direction: str) -> DataFrame:
        """(from_label, from_id, to_label, to_id, type, edge) of all single hops; edge names a relationship,
        whichever way it is gone. Ends that are no nodes of their sets give none."""
        ways = self._ways(rels)
        a, b, r = (_chosen([w[i] for w in ways], F.col("hop")) for i in range(3))
        edge = _edge_name(ways, F.col("hop"), F.col("from_id"), F.col("to_id"))
        return self._hops(rels, direction).select(a.alias("from_label"), "from_id", b.alias("to_label"), "to_id", r.alias("type"), edge.alias("edge"))

    def expand(self, rels: str, starts: DataFrame, least: int = 1, most: int = 10, direction: str = "both") -> DataFrame:
        """(start_label, start_id, end_label, end_id, hops, types, edges, nodes): every path of `least` to
        `most` hops from starts(id, and label if ids aren't unique over labels) along edges of any of the
        types `A|B`, with no edge twice in a path; nodes may recur. Each hop joins the paths found last, read
        from a table in the shared folder, with the hops there are; the last hop isn't written. What is kept of
        a path is its nodes and a small number for each hop; types and edges are made of them at the end. A path
        of 0 hops is the start itself. Starts that are no nodes have no hops."""
        rels = list(dict.fromkeys(rels.split("|")))
        ways, ends = self._ways(rels), self._ends(rels, direction)
        labels = sorted({x for w in ways for x in w[:2]})
        here, there = ([labels.index(w[i]) for w in ways] for i in range(2))
        ahead = {x: {labels.index(b) for a, b, *_ in ends if a == label} for x, label in enumerate(labels)}
        reached = [set(range(len(labels)))]  # labels that a path of so many hops may end at
        while reached[-1] and len(reached) <= max(most, len(labels)):
            reached.append(set().union(*(ahead[x] for x in reached[-1])))
        again = bool(reached[-1]) and len(reached) > len(labels)  # without a circle of labels no edge can recur
        adjacent = stored(self._hops(rels, direction)).withColumn("from_kind", _chosen(here, F.col("hop")))
        if "label" not in starts.columns:
            first = adjacent.select(F.col("from_id").alias("id"), _chosen(labels, F.col("from_kind")).alias("label")).distinct()
            starts = starts.select("id").join(first, "id", "left")
        kind_of = F.coalesce(*(F.when(F.col("label") == x, i) for i, x in enumerate(labels)))
        at = starts.select(F.col("label").alias("start_label"), F.array().cast("array<string>").alias("before"), F.array().cast("array<tinyint>").alias("gone"), F.col("id").alias("end_id"), kind_of.alias("end_kind"))
        found = [(0, at)] if least == 0 else []
        for k in range(1, most + 1):
            step = at.join(adjacent, (F.col("end_id") == F.col("from_id")) & (F.col("end_kind") == F.col("from_kind")))
            for i in range(k - 1) if again else ():
                past = F.get("gone", F.lit(i))
                x, y = F.get("before", F.lit(i)), F.get("before", F.lit(i + 1)) if i < k - 2 else F.col("end_id")
                same = (past == F.col("hop")) & (x == F.col("from_id")) & (y == F.col("to_id"))
                back = (past == F.col("hop").bitwiseXOR(F.lit(1).cast("tinyint"))) & (x == F.col("to_id")) & (y == F.col("from_id"))
                step = step.filter(~(same | back) if direction == "both" else ~same)
            at = step.select("start_label", F.array_append("before", F.col("end_id")).alias("before"), F.array_append("gone", F.col("hop")).alias("gone"), F.col("to_id").alias("end_id"), _chosen(there, F.col("hop")).alias("end_kind"))
            last = k == most or k + 1 < len(reached) and not reached[k + 1]
            if not last:
                at = stored(at)
                if at.isEmpty():
                    break
            if k >= least:
                found.append((k, at))
            if last:
                break
        out = None
        for k, f in found or [(0, at.limit(0))]:
            nodes = F.array_append("before", F.col("end_id"))
            edges = F.zip_with(F.arrays_zip("gone", "before"), F.slice(nodes, 2, k + 1), lambda g, end: _edge_name(ways, g["gone"], g["before"], end))
            types = F.transform("gone", lambda g: _chosen([w[2] for w in ways], g))
            end = F.col("start_label") if k == 0 else _chosen(labels, F.col("end_kind"))
            f = f.select("start_label", F.get(nodes, F.lit(0)).alias("start_id"), end.alias("end_label"), "end_id", F.lit(k).alias("hops"), types.alias("types"), edges.alias("edges"), nodes.alias("nodes"))
            out = f if out is None else out.union(f)
        return out

    def path_counts(self, hops: list[tuple[str, str]], starts: DataFrame | None = None) -> DataFrame:
        """(start_id, end_id, paths): how many chains of hops path() would give for each two ends. Counts are
        added up at every hop, so a state is a row for each start and node reached, not one for each path. Of
        up to 64 starts it is a row for each node, with a column for each start: it lies by node, where the next hop joins it."""
        at, names = None, []
        for rel, way in hops:
            step = self.steps(rel.split("|"), way).select("from_label", "from_id", "to_label", "to_id")
            ends = sorted({w[1] for w in self._ends(rel.split("|"), way)})
            by = ["end_id"] if len(ends) == 1 else ["label", "end_id"]  # the columns by which the next hop joins
            if at is None:
                first = step if starts is None else step.join(starts.select(F.col("id").alias("from_id")).distinct(), "from_id", "left_semi")
                at = first.select(F.col("from_id").alias("start_id"), F.col("to_label").alias("label"), F.col("to_id").alias("end_id"), F.lit(1).cast("bigint").alias("paths"))
                at = at.groupBy("start_id", "label", "end_id").agg(F.sum("paths").alias("paths"))
                if len(hops) > 1:
                    at = stored(at)
                    names = [x[0] for x in at.select("start_id").distinct().limit(WIDE + 1).collect()]
                    names = names if len(names) <= WIDE else []
                if names:
                    at = at.groupBy(*by).agg(*(F.sum(F.when(F.col("start_id") == x, F.col("paths"))).alias(f"p{i}") for i, x in enumerate(names)))
                    at = at.withColumn("label", F.lit(ends[0])) if len(ends) == 1 else at
                continue
            state = [f"p{i}" for i in range(len(names))] or ["paths"]
            keys = [*([] if names else ["start_id"]), *by]
            on = (F.col("end_id") == F.col("from_id")) & (F.col("label") == F.col("from_label"))
            at = at.join(step, on).select(*(["start_id"] if not names else []), F.col("to_label").alias("label"), F.col("to_id").alias("end_id"), *state)
            at = at.groupBy(*keys).agg(*(F.sum(c).alias(c) for c in state))
            at = at.withColumn("label", F.lit(ends[0])) if len(ends) == 1 else at
        if names:
            each = F.array(*(F.struct(F.lit(x).alias("start_id"), F.col(f"p{i}").alias("paths")) for i, x in enumerate(names)))
            at = at.select("end_id", F.inline(F.filter(each, lambda x: x["paths"].isNotNull())))
        return at.groupBy("start_id", "end_id").agg(F.sum("paths").alias("paths"))

    def describe(self, full: bool = False, sources: int | None = None) -> dict:
        """Graph statistics of all nodes and edges, with nodes by label, edges by type and, if full, nodes
        without edges by label; `stats` is a frame of one row, `flags` says what is out of the usual range."""
        from .graph_algos import describe, flagged

        def union(parts):
            out = parts[0]
            for p in parts[1:]:
                out = out.union(p)
            return out

        nodes = union([n.df.select(F.concat(F.lit(f"{k}:"), "id").alias("id")) for k, n in self.nodes.items()])
        edges = union([e.df.select(F.concat(F.lit(f"{a}:"), "src").alias("src"), F.concat(F.lit(f"{b}:"), "dst").alias("dst")) for a, e, b in self.edges.values()])
        by_label = union([n.df.agg(F.lit(n.labels).alias("label"), F.count("*").alias("n")) for n in self.nodes.values()])
        by_type = union([e.df.agg(F.lit(k).alias("type"), F.count("*").alias("n")) for k, (_, e, _) in self.edges.items()])
        stats = flagged(describe(nodes, edges, full, sources))
        out = {"stats": stats, "labels": by_label, "types": by_type}
        if full:
            ends = edges.select(F.col("src").alias("id")).union(edges.select("dst"))
            lone = nodes.join(ends, "id", "left_anti").groupBy(F.substring_index("id", ":", 1).alias("label")).agg(F.count("*").alias("n"))
            out["isolates"] = lone
        return out

    def query(self, sql: str, **args) -> DataFrame:
        """spark.sql() over the registered node and edge tables, with named parameters."""
        spark = next(iter(self.nodes.values())).df.sparkSession
        self.register(spark)
        return spark.sql(sql, args=args or None)

    def properties_of(self, label: str, split: DataFrame, properties: list[str] | None = None) -> DataFrame:
        """(id, part, properties) of the nodes in a split(id, part)."""
        df = self.nodes[label].df
        return split.join(df.select("id", *(properties or [c for c in df.columns if c != "id"])), "id")

    def without(self, label: str, rel: str) -> DataFrame:
        """Nodes of a label on neither end of any such edge."""
        ends = self.edges[rel][1].undirected().select(F.col("src").alias("id"))
        return self.nodes[label].df.join(ends, "id", "left_anti")

    def register(self, spark: SparkSession) -> None:
        """Node and edge tables as views, for spark.sql()."""
        for k, n in self.nodes.items():
            n.df.createOrReplaceTempView(k)
        for k, (_, e, _) in self.edges.items():
            e.df.createOrReplaceTempView(k)


def is_directed(pattern: str) -> bool:
    """Whether a pattern text such as (a)-[r]->(b) names a direction."""
    return "->" in pattern or "<-" in pattern


def _chosen(values: list, at: Column) -> Column:
    """The value at a place of a list."""
    return F.get(F.array(*(F.lit(v) for v in values)), at)


def _edge_name(ways: list[tuple[str, str, str, str]], hop: Column, start: Column, end: Column) -> Column:
    out = _chosen([w[3] == "out" for w in ways], hop)
    return F.concat(_chosen([w[2] for w in ways], hop), F.lit(":"), F.when(out, start).otherwise(end), F.lit(">"), F.when(out, end).otherwise(start))


def _prefixed(df: DataFrame, side: str) -> DataFrame:
    return df.select(*(F.col(c).alias(f"{side}_{c}") for c in df.columns))


#: Pairs that a task of reachable() may get, and neighbours in one row.
TASK_PAIRS, ROW_NODES = 4_000_000, 100_000


def reachable(edges: DataFrame, starts: DataFrame, hops: int) -> DataFrame:
    """(start, node, hops): shortest hop counts up to a depth. A hop is one shuffle: neighbours go to the starts
    as arrays (of 4 bytes a node, where ids are whole numbers that fit), with the pairs met before, and are
    taken apart behind it, where each pair is kept once. Partitions follow the pairs; where a start could get
    very many, its nodes are dealt to several by a hash. Edges without an end reach nothing."""
    e = stored(edges.select(F.col("src").alias("node"), "dst").filter("node is not null and dst is not null").distinct())
    first = starts.select(F.col("id").alias("start"), F.col("id").alias("node"), F.lit(0).alias("hops")).distinct()
    degree = stored(e.groupBy("node").agg(F.count("*").alias("n")))
    most = degree.agg(F.max("n")).first()[0] or 0
    cuts = max(1, min(64, max(-(-(most**hops) // TASK_PAIRS), -(-most // ROW_NODES))))
    kind = wire = e.schema["dst"].dataType.simpleString()
    if kind == "bigint":
        low, high = e.select("dst").union(first.select("node")).agg(F.min("dst"), F.max("dst")).first()
        wire = "int" if low is not None and -(2**31) <= low and high < 2**31 else kind

    def cut(c):
        return F.pmod(F.xxhash64(c), F.lit(cuts)).cast("int").alias("cut")

    near = stored(e.groupBy("node", cut("dst")).agg(F.collect_list(F.col("dst").cast(wire)).alias("to")))
    forget(e)
    seen = stored(first) if hops else first
    for k in range(1, hops + 1):
        frontier = seen.filter(F.col("hops") == k - 1)
        pairs = frontier.join(degree, "node").agg(F.sum("n")).first()[0]
        if not pairs:
            break
        parts = max(int(e.sparkSession.conf.get(PARTITIONS)), -(-pairs // TASK_PAIRS))
        step = frontier.join(near, "node").select("start", "cut", F.lit(k).alias("hops"), "to")
        both = step.union(seen.select("start", cut("node"), "hops", F.array(F.col("node").cast(wire)))).repartition(parts, "start", "cut")
        met = both.select("start", "cut", "hops", F.explode("to").alias("node"))
        new = met.groupBy("start", "cut", "node").agg(F.min("hops").alias("hops")).select("start", F.col("node").cast(kind).alias("node"), "hops")
        if k < hops:
            new = stored(new)
            forget(seen)
        seen = new
    return seen.filter("hops > 0")


def viz_extract(edges: DataFrame, nodes: DataFrame, limit: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Unique edges and the unique nodes at their ends, with lists and timestamps as strings."""
    e = edges.dropDuplicates(["src", "dst"])
    e = e.orderBy("src", "dst").limit(limit) if limit is not None else e
    ids = e.select(F.col("src").alias("id")).union(e.select("dst")).distinct()
    return e, nodes.join(ids, "id", "left_semi")
