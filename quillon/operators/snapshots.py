"""What changed between consecutive full snapshots.

Keys fall into hash ranges; each snapshot has a tree of digests over its ranges with sixteen children a node. The trees
of two consecutive snapshots are compared from the root down, following only nodes that differ, and rows are compared
only in the ranges that differ. Depth follows a snapshot's own size, so a leaf keeps about ``rows_per_leaf`` rows at any
size. A digest is the exclusive-or of two hashes of every row below it, so it is made of its children's digests alone, and
trees of different depth can be compared as far down as both go.

``SnapshotHistory`` keeps trees and rows: a delivery is read and digested once, and compared with the stored trees; of
earlier deliveries only the rows of snapshots that a new one follows are read again.
"""

from __future__ import annotations

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillon.operators.dedupe import once
from quillon.session import own_folder, staged

#: Bits by which a level of the tree is finer than the one above, and bits of the finest level.
STEP, FINEST = 4, 24


def repository_key(url: Column) -> Column:
    """One spelling for a repository: no scheme, user, trailing slash or '.git', in lower case; null if nothing is left."""
    plain = F.lower(F.regexp_replace(url, r"^\s+|\s+$", ""))
    plain = F.regexp_replace(F.regexp_replace(plain, r"^[a-z+]+://", ""), r"^[^@/]*@", "")
    plain = F.regexp_replace(plain, r"^([^/:]+):(?!\d+/)", "$1/")
    plain = F.regexp_replace(plain, r"(\.git)?/*$", "")
    return F.when(plain != "", plain)


def commit_key(sha: Column) -> Column:
    """The hexadecimal digits in lower case; null if there are none."""
    digits = F.regexp_replace(F.lower(sha), "[^0-9a-f]", "")
    return F.when(digits != "", digits)


def heads_of(scans: DataFrame) -> DataFrame:
    """scan_id, completed_at, repository, branch, sha of the scans of feed 'full' with a completion and a repository."""
    return once(
        scans.where("feed = 'full' and completed_at is not null").select(
            "scan_id", F.col("completed_at").cast("timestamp").alias("completed_at"), repository_key(F.col("target.repository_url")).alias("repository"), F.trim("target.branch").alias("branch"), commit_key(F.col("target.commit_sha")).alias("sha")
        ),
        "scan_id",
    ).where("repository is not null")


def consecutive(heads: DataFrame) -> DataFrame:
    """The snapshots that count, each with the one before: scan_id, lineage, previous (null for the first).

    ``heads`` are those of ``heads_of``. A lineage is one repository and branch (a missing branch is one of its own). Of
    several for one commit only the last completed counts; a commit written short, with seven digits or more, is the longer
    one of its lineage that starts with it. Without commit a scan stands alone. Ties in time go by scan_id.
    """
    # longest first: a short form comes right behind a longer one that starts with it
    near = Window.partitionBy("repository", "branch", F.when(F.length("sha") >= 7, F.left("sha", F.lit(7))).otherwise(F.col("scan_id")))
    down = near.orderBy(F.desc("sha"), F.desc("scan_id"))
    begins = ~F.coalesce(F.startswith(F.col("longer"), F.col("sha")), F.lit(False))
    last = Window.partitionBy("repository", "branch", "near", "commit").orderBy(F.desc("completed_at"), F.desc("scan_id"))
    along = Window.partitionBy("repository", "branch").orderBy("completed_at", "scan_id")
    return (
        heads.withColumn("longer", F.lag("sha").over(down))
        .withColumn("begins", begins.cast("int"))
        .withColumn("commit", F.sum("begins").over(down.rowsBetween(Window.unboundedPreceding, 0)))
        .withColumn("near", F.when(F.length("sha") >= 7, F.left("sha", F.lit(7))).otherwise(F.col("scan_id")))
        .withColumn("place", F.row_number().over(last))
        .where("place = 1")
        .select("scan_id", F.xxhash64("repository", F.coalesce("branch", F.lit("\0"))).alias("lineage"), F.lag("scan_id").over(along).alias("previous"))
    )


def _row() -> Column:
    """What is compared of a row: missing and not-a-number confidences are null."""
    confidence = F.when(~F.isnan("confidence"), F.round("confidence", 2))
    return F.struct(
        "title", "severity", (confidence + F.lit(0.0)).alias("confidence"), F.col("location.path").alias("path"), F.col("location.start_line").alias("start_line"), "remediation"
    )


def _hash(seed: int) -> Column:
    """A hash over key and row. A null is marked, as hashing alone would skip it."""
    fields = ("title", "severity", "confidence", "path", "start_line", "remediation")
    parts = [c for f in fields for c in (F.col(f"row.{f}"), F.col(f"row.{f}").isNull())]
    return F.xxhash64(F.lit(seed), "key", *parts)


class SnapshotHistory:
    """Snapshots delivered so far, as tables in a folder, to derive what the next deliveries change.

    ``heads`` has the headers, ``rows`` the compared rows by snapshot and hash of their key, ``tree`` the digests, ``pairs``
    the consecutive snapshots compared so far. A delivery counts once its number is in ``commits``, written last; one that
    failed is delivered again as if nothing had happened.
    """

    TABLES = {
        "heads": "scan_id string, completed_at timestamp, repository string, branch string, sha string",
        "rows": "scan_id string, place int, key string, row struct<title:string,severity:string,confidence:double,path:string,start_line:bigint,remediation:string>",
        "tree": "scan_id string, levels int, level int, node int, d1 bigint, d2 bigint",
        "pairs": "scan_id string, previous string",
    }

    def __init__(self, spark: SparkSession, folder: str, rows_per_leaf: int = 64) -> None:
        self.spark, self.folder, self.rows_per_leaf = spark, folder, rows_per_leaf

    def _next(self) -> int:
        try:
            return self.spark.read.schema("delivery int").parquet(f"{self.folder}/commits").agg(F.max("delivery").alias("n")).first().n + 1
        except AnalysisException as error:
            if error.getCondition() != "PATH_NOT_FOUND":
                raise
            return 0

    def _stored(self, name: str, number: int) -> DataFrame:
        """A table with the delivery of each row, without deliveries from ``number`` on."""
        ddl = f"{self.TABLES[name]}, delivery int"
        if not number:
            return self.spark.createDataFrame([], ddl)
        return self.spark.read.schema(ddl).parquet(f"{self.folder}/{name}").where(F.col("delivery") < number)

    def _store(self, df: DataFrame, name: str, number: int) -> None:
        df.select(*(c.split(" ")[0] for c in self.TABLES[name].split(", "))).write.mode("overwrite").parquet(f"{self.folder}/{name}/delivery={number}")

    def _commit(self, number: int) -> None:
        self.spark.createDataFrame([(number,)], "delivery int").coalesce(1).write.mode("append").parquet(f"{self.folder}/commits")

    def deliver(self, scans: DataFrame, rows: DataFrame) -> DataFrame:
        """Store headers and rows and return what they change: scan_id (of the later snapshot), fingerprint, kind.

        Changes come for every two snapshots that are consecutive now and were not before, so a late header, or a rescan
        that takes the place of another, gives the changes of its new neighbours. The rows of a snapshot come in one
        delivery; further ones later are redeliveries and are left out. For the rest see ``changes``.
        """
        number = self._next()
        key = F.lower(F.trim("fingerprint"))
        keyed = rows.select("scan_id", key.alias("key"), _row().alias("row")).where("key <> '' and scan_id is not null")
        if number:
            keyed = keyed.join(self._stored("tree", number).where("level = 0").select("scan_id"), "scan_id", "left_anti")
        unique = keyed.groupBy("scan_id", "key").agg(F.min("row").alias("row"))
        self._store(unique.withColumn("place", F.expr(f"cast(shiftrightunsigned(xxhash64(key), {64 - FINEST}) as int)")), "rows", number)
        self._store(self._tree(self._stored("rows", number + 1).where(F.col("delivery") == number)), "tree", number)
        known = self._stored("heads", number)
        self._store(heads_of(scans).join(known.select("scan_id"), "scan_id", "left_anti") if number else heads_of(scans), "heads", number)
        chain = consecutive(self._stored("heads", number + 1).drop("delivery")).where("previous is not null").select("scan_id", "previous")
        self._store(chain.join(self._stored("pairs", number).select("scan_id", "previous"), ["scan_id", "previous"], "left_anti") if number else chain, "pairs", number)
        pairs = self._stored("pairs", number + 1).where(F.col("delivery") == number).drop("delivery")
        found = self._compared(pairs, number + 1)
        self._commit(number)
        return found

    def _tree(self, rows: DataFrame) -> DataFrame:
        """The digests of all nodes of the trees of snapshots; the leaves are counted first, map-side."""
        levels = F.least(F.lit(FINEST // STEP), F.greatest(F.lit(0), F.ceil(F.log2(F.col("n") / self.rows_per_leaf) / STEP))).cast("int")
        sizes = rows.groupBy("scan_id").agg(F.count("*").alias("n")).select("scan_id", levels.alias("levels"))
        xor = lambda of: [F.bit_xor(c).alias(n) for n, c in of.items()]
        leaf = F.expr(f"shiftright(place, {FINEST} - {STEP} * levels)").alias("leaf")
        leaves = rows.join(sizes, "scan_id").groupBy("scan_id", "levels", leaf).agg(*xor({"d1": _hash(1), "d2": _hash(2)}))
        up = leaves.select("scan_id", "levels", "leaf", "d1", "d2", F.explode(F.sequence(F.lit(0), F.col("levels"))).alias("level"))
        node = F.expr(f"shiftright(leaf, {STEP} * (levels - level))").alias("node")
        return up.groupBy("scan_id", "levels", "level", node).agg(*xor({"d1": F.col("d1"), "d2": F.col("d2")}))

    def _compared(self, pairs: DataFrame, number: int) -> DataFrame:
        """The changed rows of pairs of snapshots: down both trees, then by row where they differ."""
        tree, rows = self._stored("tree", number), self._stored("rows", number)
        both = pairs.select(F.col("scan_id").alias("later"), F.explode(F.array(F.struct(F.col("scan_id"), F.lit(1).alias("side")), F.struct(F.col("previous").alias("scan_id"), F.lit(0).alias("side")))).alias("x")).select("later", "x.*")
        roots = tree.where("level = 0").select("scan_id", "levels", "delivery")
        sides = staged(both.join(roots, "scan_id"))  # an empty snapshot has no root
        wanted = [r.delivery for r in sides.select("delivery").distinct().collect()]
        tree, rows = (df.where(F.col("delivery").isin(wanted)) for df in (tree, rows))
        depth = sides.groupBy("later").agg(F.when(F.count("*") == 2, F.min("levels")).otherwise(0).alias("depth"))
        sides = staged(sides.select("later", "side", "scan_id").join(depth, "later"))
        deepest = sides.agg(F.max("depth").alias("m")).first().m

        frontier: DataFrame | None = None
        differ: DataFrame | None = None
        for level in range((deepest or 0) + 1):
            at = tree.where(F.col("level") == level).join(sides.where(F.col("depth") >= level), "scan_id")
            if frontier is not None:  # only children of nodes that differ
                at = at.withColumn("parent", F.shiftright("node", STEP)).join(frontier, ["later", "parent"], "left_semi")
            of = lambda d, side: F.max(F.when(F.col("side") == side, F.col(d)))
            nodes = at.groupBy("later", "node", "depth").agg(*(of(d, x).alias(f"{d}_{x}") for d in ("d1", "d2") for x in (0, 1)))
            other = staged(nodes.where(~(F.col("d1_0").eqNullSafe(F.col("d1_1")) & F.col("d2_0").eqNullSafe(F.col("d2_1")))).select("later", "node", "depth"))
            ends = other.where(F.col("depth") == level).select("later", F.col("node").alias("leaf"))
            differ = ends if differ is None else differ.unionByName(ends)
            frontier = other.where(F.col("depth") > level).select("later", F.col("node").alias("parent"))

        leaf = F.expr(f"shiftright(place, {FINEST} - {STEP} * depth)").alias("leaf")
        there = rows.join(sides, "scan_id").select("later", "side", "key", "row", leaf).join(differ, ["later", "leaf"], "left_semi")
        side = lambda x: F.min(F.when(F.col("side") == x, F.col("row")))
        here = lambda x: F.max(F.when(F.col("side") == x, F.lit(1)))
        compared = there.groupBy("later", "key").agg(side(0).alias("before"), side(1).alias("after"), here(0).alias("was"), here(1).alias("now"))
        kind = F.when(F.col("was").isNull(), F.lit("added")).when(F.col("now").isNull(), F.lit("removed")).when(~F.col("before").eqNullSafe(F.col("after")), F.lit("changed"))
        return compared.select(F.col("later").alias("scan_id"), F.col("key").alias("fingerprint"), kind.alias("kind")).where("kind is not null")


def changes(scans: DataFrame, rows: DataFrame, rows_per_leaf: int = 64) -> DataFrame:
    """Keys that were added, removed or changed: scan_id (of the later snapshot), fingerprint, kind.

    All snapshots go into a new ``SnapshotHistory`` at once. ``scans`` has the headers, ``rows`` scan_id, fingerprint,
    title, severity, confidence, location, remediation. Fingerprints count trimmed and in lower case; rows without one
    don't count, nor do rows of scans that are no snapshot. Repeated rows of a snapshot count once; should they differ, the
    smallest counts. Confidences are compared to two decimals, null against a value is a change. A snapshot may be empty.
    A first snapshot gives no rows. Empty inputs give no rows; extra columns are ignored.
    """
    spark = scans.sparkSession
    return SnapshotHistory(spark, f"{own_folder(spark)}/snapshots-{uuid.uuid4().hex}", rows_per_leaf).deliver(scans, rows)
