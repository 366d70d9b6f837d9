"""Connected components by label propagation with shortcuts."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from abacist.plans.session import stored
from abacist.plans.skew import skew_join
from abacist.plans.tiles import linked

#: Edges that one task may hold.
TASK_EDGES = 2_000_000


def connected_components(nodes: DataFrame, edges: DataFrame, max_rounds: int = 200) -> DataFrame:
    """`(node, root)`: the smallest node name of each node's component.

    Each round takes the smallest label among the neighbours and then the
    label of the label, which shortens chains by a factor each time.  Rounds
    are written out, so the plan does not grow.
    """
    both = edges.select("src", "dst").unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
    both = stored(both.distinct())
    labels = stored(nodes.select("node", F.col("node").alias("root")).distinct())
    for _ in range(max_rounds):
        heard = (
            both.join(labels.select(F.col("node").alias("dst"), "root"), "dst")
            .groupBy(F.col("src").alias("node"))
            .agg(F.min("root").alias("heard"))
        )
        lower = labels.join(heard, "node", "left").select(
            "node", F.col("root").alias("old"), F.least("root", F.coalesce("heard", "root")).alias("root")
        )
        lower = stored(lower)
        # Many nodes share one label: the label side is the one that may be hot.
        jump = lower.select(F.col("node").alias("root"), F.col("root").alias("next"))
        short = skew_join(lower, jump, ["root"], "left")
        new = stored(short.select("node", F.least("root", F.coalesce("next", "root")).alias("root"), "old"))
        changed = new.filter(F.col("root") != F.col("old")).limit(1).count()
        labels = new.select("node", "root")
        if not changed:
            return labels
    raise RuntimeError("components did not settle")


def components_of_chains(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """connected_components() of whole numbers for edges that form long chains, such as trees.

    Labels take a round for each few steps of a chain.  Up to TASK_EDGES edges one task joins at once.
    """
    edges = stored(edges.select("src", "dst"))
    if edges.count() > TASK_EDGES:
        return connected_components(nodes, edges)

    def joined(batches):
        tables = [pa.Table.from_batches([b]) for b in batches]
        if tables:
            table = pa.concat_tables(tables)
            names, ends = np.unique(np.concatenate([table["src"].to_numpy(), table["dst"].to_numpy()]), return_inverse=True)
            root = linked(np.arange(len(names)), ends[: table.num_rows], ends[table.num_rows :])
            yield pa.RecordBatch.from_arrays([pa.array(names), pa.array(names[root])], names=["node", "root"])

    roots = edges.coalesce(1).mapInArrow(joined, "node long, root long")
    return stored(nodes.select("node").distinct().join(roots, "node", "left").select("node", F.coalesce("root", "node").alias("root")))
