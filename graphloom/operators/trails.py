"""Variable-length paths: trails, in which no edge occurs twice and vertices may recur.

Frontiers are sets of rows (from, to, edges so far); each round joins the frontier with the edges on its last vertex. Bounded
lengths become one plan of joins, which Catalyst optimises as a whole. Unbounded ones are cut every `cut` rounds by writing the
frontier to the session's checkpoint folder, and end when no trail can be extended; trails are finite.
"""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

UNROLLED = 4
EDGE = "struct<id:bigint,label:string,start_id:bigint,end_id:bigint>"


def _step(frontier: DataFrame, edges: DataFrame) -> DataFrame:
    """Trails that are one edge longer."""
    one = F.struct(F.col("edge").alias("id"), "label", "start_id", "end_id")
    out = frontier.join(edges, (F.col("to") == F.col("near")) & ~F.array_contains(F.col("ids"), F.col("edge")))
    return out.select("from", F.col("far").alias("to"), F.concat("ids", F.array("edge")).alias("ids"), F.concat("edges", F.array(one)).alias("edges"), F.concat("nodes", F.array("far")).alias("nodes"))


def keep(df: DataFrame) -> DataFrame:
    """df computed once: on reliable storage if the session names a checkpoint folder, else in the executors' memory and disks, from where it is recomputed if lost."""
    folder = df.sparkSession.conf.get("spark.checkpoint.dir", None) or df.sparkSession.sparkContext.getConf().get("spark.checkpoint.dir")
    if folder:
        df.sparkSession.sparkContext.setCheckpointDir(folder)
        return df.checkpoint()
    return df.persist()


def shared_folder(spark) -> str:
    """A new path on the storage that the session names for checkpoints; a temporary one for a local session that names none."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not folder:
        master = spark.sparkContext.master
        if not (master == "local" or master.startswith("local[")):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = tempfile.mkdtemp(prefix="graphloom-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
    return f"{folder.rstrip('/')}/{uuid.uuid4().hex}"


def expand(starts: DataFrame, edges: DataFrame, low: int, high: int | None, cut: int = 3) -> DataFrame:
    """from, to, trail (edges, and nodes between them) of the trails of low to high edges that start at starts(from). Length 0 is never a trail."""
    low = max(low, 1)
    frontier = starts.select("from", F.col("from").alias("to"), F.array().cast("array<bigint>").alias("ids"), F.array().cast(f"array<{EDGE}>").alias("edges"), F.array().cast("array<bigint>").alias("nodes"))
    found, k = [], 0
    while high is None or k < high:
        k += 1
        frontier = _step(frontier, edges)
        if high is None or high > UNROLLED:
            if k % cut == 0 or high is None:
                frontier = keep(frontier)
                if frontier.isEmpty():
                    break
        if k >= low:
            found.append(frontier)
    if not found:
        found = [frontier.where("false")]
    trail = F.struct("edges", F.expr("slice(nodes, 1, greatest(size(nodes) - 1, 0))").alias("nodes")).alias("trail")
    return reduce(DataFrame.unionByName, found).select("from", "to", trail)
