"""Merkle manifest of a dataset with incremental witnesses.

Every row is a leaf; the leaves of a group stand in the order of a key and form a hash tree with a
fixed fan-out, and the groups' roots, in the order of the group, form another.  A witness holds, for each
level from the leaf to the root, the digests left and right of the path in its run.

``Appender`` builds a tree by streaming appends: a node that is appended gets a partial witness (the
digests to its left in its open run), a run that completes extends the witnesses of all leaves under it by the
digests to their right and is itself appended one level up.  Leaves are dealt in aligned blocks of
``fanout ** BLOCK_LEVELS``; every block is one appender, its root is a further append to the group's next
appender (again in blocks), and so on up to the root.  The way up keeps the blocks' roots only; the way down
gives each block the witness of its root.  So a task holds one block, however large the group.

Defined results: a null field is ``-``, a null group is a group of its own and comes first, null keys come
first, rows with equal keys stand in the order of their leaves, equal rows are leaves each, an empty table gives
no rows.  Columns beside the fields are not looked at.
"""

from __future__ import annotations

import hashlib
import math

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import arrow_schema, written
from .ordered import numbered

FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
FANOUT, BLOCK_LEVELS = 16, 3
WITNESS = "array<struct<left: string, right: string>>"


def _sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


class Appender:
    """Hash tree of ``levels`` levels that takes nodes from left to right; ``witness[i]`` belongs to node i."""

    def __init__(self, fanout: int, levels: int):
        self.fanout, self.levels = fanout, levels
        self.runs: list[list] = [[] for _ in range(levels)]     # open run of each level: (digest, first leaf, end)
        self.witness: list[list] = []
        self.root = None

    def append(self, digest: str) -> None:
        self.witness.append([])
        self._add(0, digest, len(self.witness) - 1, len(self.witness))

    def _add(self, level: int, digest: str, first: int, end: int) -> None:
        if level == self.levels:
            self.root = digest
            return
        run = self.runs[level]
        left = "".join(d for d, _, _ in run)
        for leaf in range(first, end):
            self.witness[leaf].append({"left": left, "right": ""})
        run.append((digest, first, end))
        if len(run) == self.fanout:
            self._complete(level)

    def _complete(self, level: int) -> None:
        run, self.runs[level] = self.runs[level], []
        right = ""
        for digest, first, end in reversed(run):
            for leaf in range(first, end):
                self.witness[leaf][level]["right"] = right
            right = digest + right
        self._add(level + 1, _sha(right), run[0][1], run[-1][2])

    def finish(self) -> str:
        """Complete the open runs, shortest level first, and return the root."""
        for level in range(self.levels):
            if self.runs[level]:
                self._complete(level)
        return self.root


def _levels(n: int, fanout: int, block_levels: int) -> int:
    """Levels of a block in a row of ``n`` nodes: all that are left, at most those of a block."""
    levels = 0
    while n > 1 and levels < block_levels:
        n, levels = math.ceil(n / fanout), levels + 1
    return levels


def _appended(table: pa.Table, fanout: int, block_levels: int) -> Appender:
    tree = Appender(fanout, _levels(table["_n"][0].as_py(), fanout, block_levels))
    for digest in table["_digest"].to_pylist():
        tree.append(digest)
    tree.finish()
    return tree


def _blocked(nodes: DataFrame, fanout: int, block_levels: int) -> DataFrame:
    size = fanout ** block_levels
    return nodes.withColumn("_block", F.floor(F.col("_pos") / F.lit(size)))


def _roots(nodes: DataFrame, fanout: int, block_levels: int) -> DataFrame:
    """The nodes one block level up: ``_g``, ``_pos``, ``_n``, ``_digest``."""
    size = fanout ** block_levels
    ddl = "_g string, _pos long, _n long, _digest string"
    schema = arrow_schema(ddl)

    def up(table: pa.Table) -> pa.Table:
        table = table.sort_by("_pos")
        root = _appended(table, fanout, block_levels).root
        return pa.Table.from_pylist([{"_g": table["_g"][0].as_py(), "_pos": table["_block"][0].as_py(),
                                      "_n": math.ceil(table["_n"][0].as_py() / size), "_digest": root}], schema)

    nodes = _blocked(nodes.select("_g", "_pos", "_n", "_digest"), fanout, block_levels)
    return nodes.groupBy("_g", "_block").applyInArrow(up, ddl)


def _witnessed(nodes: DataFrame, above: DataFrame | None, fanout: int, block_levels: int) -> DataFrame:
    """The nodes with ``_witness``: their levels in the block, then the block root's (``above``: _g, _pos, _witness)."""
    fields = [f for f in nodes.schema.fields]
    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields) + f", _witness {WITNESS}"
    schema = arrow_schema(ddl)
    names = [f.name for f in fields]

    def down(table: pa.Table, upper: pa.Table) -> pa.Table:
        if table.num_rows == 0:
            return schema.empty_table()
        table = table.sort_by("_pos")
        tree = _appended(table, fanout, block_levels)
        rest = upper["_witness"][0].as_py() if upper.num_rows else []
        column = pa.array([w + rest for w in tree.witness], schema.field("_witness").type)
        return pa.table([table[n] for n in names] + [column], schema=schema)

    if above is None:
        above = nodes.sparkSession.createDataFrame([], f"_g string, _pos long, _witness {WITNESS}")
    above = above.select("_g", F.col("_pos").alias("_block"), "_witness")
    nodes = _blocked(nodes, fanout, block_levels)
    return nodes.groupBy("_g", "_block").cogroup(above.groupBy("_g", "_block")).applyInArrow(down, ddl)


class _Tree:
    """The block levels of the trees of all groups: nodes of each, written; the last holds one node a group."""

    def __init__(self, nodes: DataFrame, fanout: int, block_levels: int, label: str):
        self.shape = fanout, block_levels
        self.stages = [nodes]
        most = nodes.agg(F.max("_n")).first()[0] or 0
        while True:
            self.stages.append(written(_roots(self.stages[-1], *self.shape), label))
            most = math.ceil(most / fanout ** block_levels)
            if most <= 1:
                break

    @property
    def roots(self) -> DataFrame:
        return self.stages[-1].select("_g", F.col("_digest").alias("_root"))

    def witnesses(self, above: DataFrame | None) -> DataFrame:
        """The leaves with their witnesses; ``above`` holds those of the groups' roots."""
        for nodes in reversed(self.stages[:-1]):
            above = _witnessed(nodes, above, *self.shape)
        return above


def leaf(fields: tuple[str, ...] | list, values: dict[str, Column] | None = None) -> Column:
    """SHA-256 (hex) of the fields, each ``-`` or its UTF-8 length, ``:`` and value; ``values`` replaces columns."""
    parts = []
    for name in fields:
        v = (values or {}).get(name, F.col(f"`{name}`")).cast("string")
        parts.append(F.coalesce(F.concat(F.octet_length(v).cast("string"), F.lit(":"), v), F.lit("-")))
    return F.sha2(F.concat(*parts), 256)


def fold(digest: Column, witness: Column) -> Column:
    """The root that follows from a leaf and its witness."""
    return F.aggregate(witness, digest, lambda acc, run: F.sha2(F.concat(run["left"], acc, run["right"]), 256))


def proof_text(witness: Column) -> Column:
    """The siblings' digests from the leaf's run to the root's, left to right."""
    return F.array_join(F.transform(witness, lambda run: F.concat(run["left"], run["right"])), "")


def manifest(docs: DataFrame, *, fields: tuple[str, ...] = FIELDS, order: str = "doc_id", group: str = "source",
             claims: dict[str, Column] | None = None, fanout: int = FANOUT, block_levels: int = BLOCK_LEVELS) -> DataFrame:
    """One row per row of ``docs``: ``order``, ``leaf``, ``subroot``, ``root``, ``witness`` and the ``claims`` columns.

    ``claims`` are further columns computed from the row, such as the leaf of a copy to verify with ``fold``.
    """
    names = list(claims or {})
    rows = docs.select(F.col(f"`{order}`").alias("_key"), leaf(fields).alias("_digest"),
                       F.coalesce(F.concat(F.lit("g"), F.col(f"`{group}`").cast("string")), F.lit("")).alias("_g"),
                       *[c.alias(f"_claim{i}") for i, c in enumerate((claims or {}).values())])
    leaves = written(numbered(rows, "_g", [F.col("_key").asc_nulls_first(), F.col("_digest")], "merkle-leaves"), "merkle-places")
    groups = _Tree(leaves, fanout, block_levels, "merkle-blocks")
    subroots = numbered(groups.roots.select(F.col("_g").alias("_name"), F.col("_root").alias("_digest"), F.lit("").alias("_g")),
                        "_g", [F.col("_name")], "merkle-subroots")
    top = _Tree(subroots, fanout, block_levels, "merkle-top")
    above = written(top.witnesses(None).join(top.roots, "_g"), "merkle-groups")
    found = groups.witnesses(above.select(F.col("_name").alias("_g"), F.lit(0).cast("long").alias("_pos"), "_witness"))
    found = found.join(above.select(F.col("_name").alias("_g"), F.col("_digest").alias("subroot"), F.col("_root").alias("root")), "_g")
    return found.select(F.col("_key").alias(order), F.col("_digest").alias("leaf"), "subroot", "root",
                        F.col("_witness").alias("witness"), *[F.col(f"_claim{i}").alias(n) for i, n in enumerate(names)])
