"""Change capture by a Merkle tree over key ranges.

A state table (one row per key) is cut into leaves of LEAF consecutive keys.
A leaf's digest combines the hashes of its rows, a node's digest those of the
leaves below it.  Two trees are compared from the root: only nodes whose digests
differ are opened, and only the rows of differing leaves are compared.
"""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.session import materialize, scratch_dir

LEAF_BITS = 6
FAN_BITS = 6
DEPTH = 5  # 2 ** (6 + 5 * 6) keys below one root


def latest_state(log: DataFrame, key: str, fields: Sequence[str], changed_at: str, loaded_at: str, seen: Column) -> DataFrame:
    """One row per key: `now` and `then`, the newest row by changed_at among all rows and among rows that satisfy `seen`.

    Both come from one pass with map-side combining, so a key that holds a
    third of the log costs one partial row per task.  Of rows with equal
    changed_at the one loaded last holds, then the greatest by the fields;
    a null changed_at is older than any time.  Rows with a null key are
    dropped: they name nothing that could be processed.  `then` is null if
    no row satisfies `seen`; a null `seen` counts as false.
    """
    row = F.struct(F.col(changed_at), F.col(loaded_at), *[F.col(f) for f in fields])
    return (
        log.filter(F.col(key).isNotNull())
        .groupBy(F.col(key).alias("key"))
        .agg(F.max(row).alias("now"), F.max(F.when(seen, row)).alias("then"))
        .select("key", *[F.struct(*[F.col(f"{side}.{f}") for f in fields]).alias(f"{side}_fields") for side in ("now", "then")], F.col("now").isNotNull().alias("has_now"), F.col("then").isNotNull().alias("has_then"))
    )


def merkle_tree(state: DataFrame, key: str, fields: Sequence[str | Column]) -> DataFrame:
    """(level, node, d1, d2, rows): level 0 has the leaves, level DEPTH the top.

    A leaf's two 64-bit lanes are the xor of its rows' hashes; a node's are
    the xor of its leaves' hashed digests, which is also the xor over its
    children, so all levels come from the leaves in one aggregation.  An
    empty state gives an empty tree.  Nulls in the fields are hashed as nulls.
    """
    cols = [F.col(f) if isinstance(f, str) else f for f in fields]
    # a null leaves xxhash64 unchanged, so each field goes in with its null flag
    parts = [F.col(key), *[x for c in cols for x in (c.isNull(), c)]]
    lanes = [F.bit_xor(F.xxhash64(F.lit(seed), *parts)).alias(f"h{i}") for i, seed in enumerate((17, 40503))]
    leaf = state.groupBy(F.shiftright(F.col(key).cast("long"), LEAF_BITS).alias("leaf")).agg(*lanes, F.count(F.lit(1)).alias("n"))
    up = F.explode(F.array(*[F.struct(F.lit(n).alias("level"), F.shiftright("leaf", FAN_BITS * n).alias("node")) for n in range(DEPTH + 1)]))
    spread = leaf.select(up.alias("at"), F.xxhash64(F.lit(3), "leaf", "h0", "h1", "n").alias("h0"), F.xxhash64(F.lit(5), "leaf", "h0", "h1", "n").alias("h1"), "n")
    return spread.groupBy("at.level", "at.node").agg(F.bit_xor("h0").alias("d1"), F.bit_xor("h1").alias("d2"), F.sum("n").alias("rows"))


def changed_leaves(current: DataFrame, saved: DataFrame) -> DataFrame:
    """(node): the leaves below nodes whose digests differ at every level above, or that only one tree has."""
    digest = ("d1", "d2", "rows")
    opened = None
    for n in range(DEPTH, -1, -1):
        nodes = current.filter(F.col("level") == n).select("node", *digest).unionAll(saved.filter(F.col("level") == n).select("node", *digest))
        if opened is not None:
            # parents are unique; an inner join, unlike a semi join, is not pushed into both sides of the union
            nodes = nodes.join(opened, F.shiftright(nodes["node"], FAN_BITS) == opened["parent"]).drop("parent")
        # number by number, which hash aggregation can do
        sides = [f(c).alias(f"{n_}_{c}") for c in digest for n_, f in (("low", F.min), ("high", F.max))]
        differ = nodes.groupBy("node").agg(F.count(F.lit(1)).alias("trees"), *sides).filter("trees < 2 OR " + " OR ".join(f"low_{c} != high_{c}" for c in digest))
        opened = differ.select(F.col("node").alias("parent"))
    return opened.select(F.col("parent").alias("node"))


def changed_rows(current: DataFrame, current_tree: DataFrame, saved: DataFrame, saved_tree: DataFrame, key: str, fields: Sequence[str]) -> DataFrame:
    """Rows of `current` that `saved` lacks; of either table only the rows in leaves whose digests differ are read on."""
    leaves = changed_leaves(current_tree, saved_tree)
    inside = lambda df: df.join(leaves, F.shiftright(F.col(key).cast("long"), LEAF_BITS) == leaves["node"], "left_semi")
    old = inside(saved).select(*[F.col(c).alias(f"_o_{c}") for c in (key, *fields)])
    on = F.lit(True)
    for c in (key, *fields):
        on = on & F.col(c).eqNullSafe(F.col(f"_o_{c}"))
    return inside(current).join(old, on, "left_anti")


def read_up_to(runs: DataFrame):
    """The largest read_upto of runs whose newest row by logged_at says succeeded; None if there is none.

    Of rows with equal logged_at one that doesn't say succeeded holds, so
    that an unclear run is read again rather than skipped.  One value reaches
    the driver.
    """
    failed = ~F.coalesce(F.col("outcome") == "succeeded", F.lit(False))
    newest = runs.groupBy("run_id").agg(F.max(F.struct("logged_at", failed.alias("failed"), "read_upto")).alias("r"))
    return newest.filter(~F.col("r.failed")).agg(F.max("r.read_upto")).first()[0]


class MerkleStore:
    """A folder that holds, for each published version, a run's output, the state that it has read, and that state's tree.

    A version counts once the pointer file names it, and the pointer is
    replaced by one atomic rename.  A run that dies earlier leaves the old
    version in force, so its records are taken again, once; of one that dies
    later the output is published, and `output` finds it.  Versions form a
    chain; folders outside of it, of runs that died, are never read.  Without
    a path the store is a temporary one.
    """

    def __init__(self, spark: SparkSession, path: str | None = None):
        self.spark = spark
        self.path = path or scratch_dir(spark)

    def _fs(self):
        jvm = self.spark._jvm
        conf = self.spark._jsc.hadoopConfiguration()
        return jvm, jvm.org.apache.hadoop.fs.Path(self.path).getFileSystem(conf), conf

    def _note(self, name: str) -> dict | None:
        """Content of a small file."""
        jvm, fs, _ = self._fs()
        if not fs.exists(jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")):
            return None
        return json.loads(self.spark.read.text(f"{self.path}/{name}").first()[0])

    def _write_note(self, name: str, content: dict) -> None:
        jvm, fs, _ = self._fs()
        stream = fs.create(jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}"), True)
        stream.write(bytearray(json.dumps(content).encode()))
        stream.close()

    def version(self) -> str | None:
        return (self._note("CURRENT") or {}).get("version")

    def _read(self, part: str, version: str | None) -> DataFrame | None:
        v = version or self.version()
        return self.spark.read.parquet(f"{self.path}/{v}/{part}") if v else None

    def tree(self, version: str | None = None) -> DataFrame | None:
        return self._read("tree", version)

    def state(self, version: str | None = None) -> DataFrame | None:
        return self._read("state", version)

    def output(self, version: str | None = None) -> DataFrame | None:
        """What the run of a version, by default the last one, has made of the records that it took."""
        return self._read("output", version)

    def versions(self, after: str | None = None) -> list[str]:
        """Published versions after a given one, oldest first, so that a reader that has seen `after` misses and repeats none."""
        out, v = [], self.version()
        while v and v != after:
            out.append(v)
            v = self._note(f"{v}/NOTE")["before"]
        return out[::-1]

    def publish(self, output: DataFrame, state: DataFrame, tree: DataFrame, before: str | None) -> str:
        """Make output, state and tree the current version, all or none; raises if another run has published since `before` was read."""
        jvm, fs, conf = self._fs()
        v = f"v{int(time.time() * 1000):015d}-{uuid.uuid4().hex[:8]}"
        for df, part in ((output, "output"), (state, "state"), (tree, "tree")):
            df.write.parquet(f"{self.path}/{v}/{part}")
        self._write_note(f"{v}/NOTE", {"before": before})
        self._write_note(f"{v}/POINTER", {"version": v})
        if self.version() != before:
            raise RuntimeError("another run has published meanwhile")
        Path = jvm.org.apache.hadoop.fs.Path
        over = self.spark._sc._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
        over[0] = jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
        jvm.org.apache.hadoop.fs.FileContext.getFileContext(Path(self.path).toUri(), conf).rename(Path(f"{self.path}/{v}/POINTER"), Path(f"{self.path}/CURRENT"), over)
        return v

    def run(self, state: DataFrame, key: str, fields: Sequence[str], process) -> DataFrame:
        """Take the rows of `state` that the saved state lacks, and publish what `process` makes of them together with state and tree; returns the published output.

        Every added or changed row is taken exactly once.  Rows of leaves whose
        digests agree with the saved tree's are not looked at.  Removed keys are
        not reported.
        """
        before = self.version()
        state = materialize(state.select(key, *fields))
        current = materialize(merkle_tree(state, key, fields))
        changed = state if before is None else changed_rows(state, current, self.state(before), self.tree(before), key, fields)
        return self.output(self.publish(process(changed), state, current, before))
