"""A Merkle manifest of a dataset, with proofs: one tree for each group, and one over the groups' roots.

Digests are lowercase hex sha256; a node is the digest of its children's digests, as text, one
after the other.  The leaves of a tree are in order; every ``fanout`` consecutive nodes of a
level have one parent, the last run of a level may be shorter (it is not padded, and a run of
one is hashed too), until one node is left.  A lone leaf is its own root.

1. Leaves are dealt to partitions by ranges of (group, key) and numbered within each, so that a
   partition holds a run of consecutive leaves of a group; counts of the runs tell where each
   begins.
2. A run keeps a stack of unfinished sibling groups, one for each level (a mountain range): a
   leaf goes onto the lowest, and a group that is complete is hashed and carried to the next.
   What is left of a run is the nodes at its edges whose siblings are in other runs.
3. Edges of all runs (at most 2 (fanout - 1) a level and run) are merged level by level by a
   group-by of the parent's place; levels are written to the shared folder.
4. For proofs, every run names the nodes beyond it that its leaves' paths need (again
   2 (fanout - 1) a level at most), which a join brings from the merged levels.

No task holds more than a run of about ``RUN`` leaves, however large a group is.  The leaves of
the tree over the groups' roots are dealt the same way.

Leaves with equal keys are in the order of their digests, and identical ones are dealt freely.  Null
values and groups have their own form and come first; empty texts are no nulls; texts are hashed
whole, in the JVM.  An empty table gives empty tables.  Columns are named by the caller, and
others are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from commlens.llm.common import bounded_batches, forget, written

FANOUT = 8
#: Leaves of a run, about.
RUN = 1 << 16
NODE = "grp string, level int, idx long, digest string, top int, edge boolean"
_NODE = pa.schema([("grp", pa.string()), ("level", pa.int32()), ("idx", pa.int64()), ("digest", pa.string()), ("top", pa.int32()), ("edge", pa.bool_())])


def field(c: Column) -> Column:
    """A value as it is hashed: '-' if null, else its UTF-8 byte count, ':' and the value."""
    text = c.cast("string")
    return F.when(text.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def leaf(*columns: Column) -> Column:
    """The digest of a row's values."""
    return F.sha2(F.concat(*map(field, columns)), 256)


def group_key(c: Column) -> Column:
    """A group's name as a string that sorts bytewise, null first."""
    return F.when(c.isNull(), F.lit("")).otherwise(F.concat(F.lit("="), c.cast("string")))


def parent(digests: Iterable[str]) -> str:
    """The digest of a run of siblings."""
    return hashlib.sha256("".join(digests).encode()).hexdigest()


def widths(n: int, fanout: int) -> list[int]:
    """How many nodes each level of a tree of n leaves has."""
    out = [n]
    while out[-1] > 1:
        out.append(-(-out[-1] // fanout))
    return out


class Range:
    """The mountain range over the leaves from ``start`` on of a tree of ``total`` leaves."""

    def __init__(self, start: int, total: int, fanout: int):
        self.next, self.fanout = start, fanout
        self.wide = widths(total, fanout)
        self.open: list[list[tuple[int, str]]] = [[] for _ in self.wide]

    def add(self, digest: str) -> Iterator[tuple[int, int, str, bool]]:
        """Take the next leaf; nodes (level, idx, digest, edge) whose siblings are settled."""
        level, idx = 0, self.next
        self.next += 1
        while True:
            self.open[level].append((idx, digest))
            if level == len(self.wide) - 1 or (idx + 1) % self.fanout and idx + 1 < self.wide[level]:
                return
            run, self.open[level] = self.open[level], []
            whole = run[0][0] % self.fanout == 0
            for i, x in run:
                yield level, i, x, not whole
            if not whole:  # its first siblings are in an earlier run
                return
            level, idx, digest = level + 1, idx // self.fanout, parent(x for _, x in run)

    def rest(self) -> Iterator[tuple[int, int, str, bool]]:
        """What is left when the run is over."""
        for level, run in enumerate(self.open):
            for i, x in run:
                yield level, i, x, True


def numbered(leaves: DataFrame, keys: list[str], n_runs: int) -> DataFrame:
    """Leaves (grp, keys, digest, ...) in ranges, with part and pos (place among the part's leaves of the group)."""
    columns = leaves.columns
    dealt = leaves.withColumn("salt", F.monotonically_increasing_id())  # identical leaves can be dealt to several parts
    order = ["grp", *[F.col(k).asc_nulls_first() for k in keys], "digest", "salt"]
    dealt = dealt.repartitionByRange(n_runs, *order).sortWithinPartitions(*order).select(columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, last, n = TaskContext.get().partitionId(), None, 0
        for b in batches:
            pos = []
            for g in b.column(0).to_pylist():
                n = n + 1 if g == last else 0
                last = g
                pos.append(n)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array([part] * b.num_rows, pa.int32()), pa.array(pos, pa.int64())], [*columns, "part", "pos"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in leaves.schema.fields)
    return dealt.mapInArrow(run, f"{schema}, part int, pos long")


def runs_of(placed: DataFrame) -> DataFrame:
    """grp, part, start (leaves of the group before the run), n and total (leaves of the group)."""
    counts = placed.groupBy("grp", "part").agg(F.count(F.lit(1)).alias("n"))
    group = Window.partitionBy("grp")
    return counts.select("grp", "part", "n", (F.sum("n").over(group.orderBy("part")) - F.col("n")).alias("start"), F.sum("n").over(group).alias("total"))


def _range(t: pa.Table, run: dict, fanout: int) -> tuple[list[str], list[tuple[int, int, str, bool]]]:
    """Digests of a run's leaves, by place, and the nodes of its mountain range."""
    digests = t.select(["pos", "digest"]).sort_by("pos").column("digest").to_pylist()
    mountains = Range(run["start"], run["total"], fanout)
    nodes = [x for d in digests for x in mountains.add(d)]
    return digests, [*nodes, *mountains.rest()]


def local_nodes(placed: DataFrame, runs: DataFrame, fanout: int) -> DataFrame:
    """The nodes that runs complete themselves, and (edge) those whose siblings others have; leaves only as edges."""

    def stack(t: pa.Table, own: pa.Table) -> pa.Table:
        run = own.to_pylist()[0]
        _, nodes = _range(t, run, fanout)
        top = len(widths(run["total"], fanout)) - 1
        return pa.Table.from_pylist([{"grp": run["grp"], "level": k, "idx": i, "digest": x, "top": top, "edge": e} for k, i, x, e in nodes if e or k], _NODE)

    return placed.select("grp", "part", "pos", "digest").groupBy("grp", "part").cogroup(runs.groupBy("grp", "part")).applyInArrow(stack, NODE)


def merged(edges: DataFrame, height: int, fanout: int) -> DataFrame:
    """All nodes that stand at or above the runs' edges, level by level, written to the shared folder."""
    out = written(edges.where("level = 0").drop("edge"))
    below = out
    for level in range(height):
        children = F.array_sort(F.collect_list(F.struct("idx", "digest")))
        up = below.where(F.col("top") > level).groupBy("grp", F.floor(F.col("idx") / fanout).alias("up"), "top").agg(children.alias("run"))
        digest = F.sha2(F.concat_ws("", F.transform("run", lambda x: x["digest"])), 256)
        up = up.select("grp", F.lit(level + 1).alias("level"), F.col("up").alias("idx"), digest.alias("digest"), "top")
        below = written(up.unionByName(edges.where(F.col("level") == level + 1).drop("edge")))
        out = out.unionByName(below)
    return out


class Forest:
    """The trees over the groups of ``leaves`` (grp, keys, digest, other columns), with all that proofs need."""

    def __init__(self, leaves: DataFrame, keys: list[str], fanout: int = FANOUT, run: int = RUN):
        bounded_batches(leaves.sparkSession)
        self.fanout = fanout
        leaves = written(leaves.select("grp", *[c for c in leaves.columns if c != "grp"]))
        n = leaves.count()
        n_runs = max(min(leaves.sparkSession.sparkContext.defaultParallelism, n // 1000 + 1), -(-n // run))
        self.placed = written(numbered(leaves, keys, n_runs))
        forget(leaves)
        self.runs = written(runs_of(self.placed))
        total = self.runs.agg(F.max("total")).first()[0] or 0
        self.local = written(local_nodes(self.placed, self.runs, fanout))
        self.merged = merged(self.local.where("edge"), len(widths(total, fanout)) - 1 if total else 0, fanout)

    def nodes(self) -> DataFrame:
        """grp, level, idx, digest of every node above the leaves."""
        return self.local.where("NOT edge").select("grp", "level", "idx", "digest").unionByName(self.merged.where("level > 0").select("grp", "level", "idx", "digest"))

    def roots(self) -> DataFrame:
        """grp and the root of its tree."""
        return self.merged.where("level = top").select("grp", F.col("digest").alias("root"))

    def _beyond(self) -> DataFrame:
        """For every run, the nodes (level, idx, digest) beyond it on its leaves' paths."""
        fanout = self.fanout

        def needed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for x in (x for b in batches for x in b.to_pylist()):
                wide, rows = widths(x["total"], fanout), []
                a, z = x["start"], x["start"] + x["n"] - 1  # first and last node on the paths
                own_a, own_z = a, z + 1  # nodes that the run completes itself
                for level in range(len(wide) - 1):
                    begin, end = a // fanout * fanout, min((z // fanout + 1) * fanout, wide[level])
                    rows += [{"grp": x["grp"], "part": x["part"], "level": level, "idx": i} for i in range(begin, end) if not own_a <= i < own_z]
                    a, z = a // fanout, z // fanout
                    own_z = wide[level + 1] if own_z == wide[level] else own_z // fanout
                    own_a = -(-own_a // fanout)
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, pa.schema([("grp", pa.string()), ("part", pa.int32()), ("level", pa.int32()), ("idx", pa.int64())]))

        wanted = self.runs.mapInArrow(needed, "grp string, part int, level int, idx long")
        return wanted.join(self.merged.select("grp", "level", "idx", "digest"), ["grp", "level", "idx"])

    def prove(self, rows: Callable[[dict, Iterator[tuple[dict, list[tuple[list[str], list[str]]]]]], Iterator[dict]], schema: pa.Schema, ddl: str, more: DataFrame | None = None) -> DataFrame:
        """What ``rows(run, leaves)`` makes of every run's leaves and their paths.

        A path has for each level the siblings before and those behind.  ``more`` (grp, other columns) adds to what is known of a run.
        """
        fanout = self.fanout
        beyond = self._beyond().groupBy("grp", "part").agg(F.collect_list(F.struct("level", "idx", "digest")).alias("beyond"))
        known = self.runs.join(beyond, ["grp", "part"], "left")
        if more is not None:
            known = known.join(more, "grp")

        def paths(t: pa.Table, run: dict) -> Iterator[tuple[dict, list[tuple[list[str], list[str]]]]]:
            t = t.sort_by("pos")
            digests, nodes = _range(t, run, fanout)
            at = {(x["level"], x["idx"]): x["digest"] for x in run["beyond"] or ()}
            at.update(((k, i), x) for k, i, x, _ in nodes)
            at.update(((0, run["start"] + i), x) for i, x in enumerate(digests))
            wide = widths(run["total"], fanout)
            above: dict[tuple[int, int], list[tuple[list[str], list[str]]]] = {}

            def path(level: int, idx: int) -> list[tuple[list[str], list[str]]]:
                if level == len(wide) - 1:
                    return []
                first = idx // fanout * fanout
                up = (level + 1, idx // fanout)
                if up not in above:
                    above[up] = path(*up)
                run_ = [at[level, i] for i in range(first, min(first + fanout, wide[level]))]
                return [(run_[: idx - first], run_[idx - first + 1 :]), *above[up]]

            for i, x in enumerate(t.to_pylist()):
                yield x, path(0, run["start"] + i)

        def prove(t: pa.Table, own: pa.Table) -> pa.Table:
            run = own.to_pylist()[0]
            return pa.Table.from_pylist(list(rows(run, paths(t, run))), schema)

        return self.placed.groupBy("grp", "part").cogroup(known.groupBy("grp", "part")).applyInArrow(prove, ddl)


def fold(digest: str, path: Iterable[tuple[list[str], list[str]]]) -> str:
    """The root that a leaf and its path give."""
    for before, behind in path:
        digest = parent([*before, digest, *behind])
    return digest


def _paths_of_groups(run: dict, leaves: Iterator) -> Iterator[dict]:
    for x, path in leaves:
        yield {"grp": x["name"], "subroot": x["digest"], "root": fold(x["digest"], path), "path": [{"before": a, "behind": z} for a, z in path]}


_STEP = pa.struct([("before", pa.list_(pa.string())), ("behind", pa.list_(pa.string()))])
_GROUP = pa.schema([("grp", pa.string()), ("subroot", pa.string()), ("root", pa.string()), ("path", pa.list_(_STEP))])


class Manifest:
    """Trees of all groups and the tree over their roots.

    ``leaves`` has id, grp (see ``group_key``), digest, and claimed: the digest of what somebody holds for the row.
    """

    def __init__(self, leaves: DataFrame, fanout: int = FANOUT, run: int = RUN):
        self.trees = Forest(leaves.select("grp", "id", "digest", "claimed"), ["id"], fanout, run)
        tops = self.trees.roots().select(F.lit("").alias("grp"), F.col("grp").alias("name"), F.col("root").alias("digest"))
        self.over = Forest(tops, ["name"], fanout, run)

    def groups(self) -> DataFrame:
        """grp, subroot, root, path (of the subroot) of every group."""
        return self.over.prove(_paths_of_groups, _GROUP, "grp string, subroot string, root string, path array<struct<before: array<string>, behind: array<string>>>")

    def records(self) -> DataFrame:
        """tree ('group' or 'all'), grp, level, idx, digest of every node above the leaves: the manifest's table."""
        return self.trees.nodes().select(F.lit("group").alias("tree"), "*").unionByName(self.over.nodes().select(F.lit("all").alias("tree"), "*"))

    def proofs(self) -> DataFrame:
        """id, leaf, subroot, root, proof_sha256 (of the siblings on the path), folded_root (of claimed), verified."""

        def rows(run: dict, leaves: Iterator) -> Iterator[dict]:
            last = [(x["before"], x["behind"]) for x in run["path"]]
            for x, path in leaves:
                path = [*path, *last]
                siblings = hashlib.sha256("".join(s for sides in path for side in sides for s in side).encode()).hexdigest()
                folded = fold(x["claimed"], path)
                yield {"id": x["id"], "leaf": x["digest"], "subroot": run["subroot"], "root": run["root"], "proof_sha256": siblings, "folded_root": folded, "verified": folded == run["root"]}

        names = ("leaf", "subroot", "root", "proof_sha256", "folded_root")
        schema = pa.schema([("id", pa.int64()), *[(n, pa.string()) for n in names], ("verified", pa.bool_())])
        return self.trees.prove(rows, schema, "id long, " + ", ".join(f"{n} string" for n in names) + ", verified boolean", written(self.groups()))
