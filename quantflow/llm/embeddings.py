"""Near-duplicate vectors: sign hashing by random hyperplanes, exact cosine, components.

Equal vectors of a label are one node with a weight. Nodes that share a hash in any of the
tables are compared exactly, in blocks of a bucket, so a bucket of any size is spread over
tasks and no pair leaves them: a block hands on each node's link count and a spanning forest.
A pair is counted in the first table in which its hashes agree.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quantflow.llm.components import components
from quantflow.llm.shared import run_folder, spread, staged

RECALL = 0.9995       # chance that a pair right at the threshold shares a hash in some table
BUCKET_ROWS = 64      # nodes of unlike direction that a bucket holds on average, at most
BLOCK_ROWS = 1024     # nodes of a bucket that one comparison block takes
BUNDLE_ROWS = 20_000  # rows of many small buckets that one task call takes


def tables_for(nodes: int, threshold: float) -> tuple[int, int]:
    """(bits, tables): buckets get finer with the input, and as many tables follow as keep
    the recall of a pair at the threshold."""
    agree = 1 - math.acos(threshold) / math.pi
    bits = max(12, math.ceil(math.log2(max(nodes, 1) / BUCKET_ROWS)))
    return bits, math.ceil(math.log(1 - RECALL) / math.log(1 - agree ** bits))


def link_blocks(table: pd.DataFrame, threshold: float) -> pd.DataFrame:
    """Links of one bundle of blocks: (node, links, other). ``links`` sums the weights of the
    nodes linked in this bundle's blocks; ``other`` ties linked nodes together."""
    group, _ = pd.factorize(pd.MultiIndex.from_frame(table[["t", "label", "dim", "code", "i", "j"]]))
    order = np.argsort(group, kind="stable")
    table, group = table.iloc[order], group[order]
    t, block, node = (table[c].to_numpy() for c in ("t", "block", "node"))
    same_block = (table["i"] == table["j"]).to_numpy()
    weight = table["weight"].to_numpy()
    codes = np.vstack(table["codes"].to_numpy())
    size = np.bincount(group)
    rows = [np.empty((0, 2), np.int64)]
    vectors = table["vec"].to_numpy()
    for dim in np.unique(table["dim"]):
        own = np.flatnonzero(table["dim"].to_numpy() == dim)
        x = np.vstack(vectors[own]).astype(np.float64)
        norm = np.sqrt((x * x).sum(1))
        room = size[group[own]]
        first, width = np.arange(len(own)), 1
        while True:  # rows that have a row of their group ``width`` places on
            first = first[(first + width < len(own)) & (room[first] > width)]
            if not len(first):
                break
            a, b = first, first + width
            a, b = a[group[own[a]] == group[own[b]]], b[group[own[a]] == group[own[b]]]
            ra, rb = own[a], own[b]
            fit = same_block[ra] | (block[ra] != block[rb])
            earlier = (codes[ra] == codes[rb]) & (np.arange(codes.shape[1]) < t[ra][:, None])
            fit &= ~earlier.any(1)
            a, b = a[fit], b[fit]
            near = np.einsum("ij,ij->i", x[a], x[b]) / (norm[a] * norm[b]) >= threshold
            rows.append(np.column_stack([own[a[near]], own[b[near]]]))
            width += 1
    pair = np.concatenate(rows)
    ids, at = np.unique(node, return_inverse=True)
    p, q = at[pair[:, 0]], at[pair[:, 1]]
    links = np.bincount(p, weight[pair[:, 1]], len(ids)) + np.bincount(q, weight[pair[:, 0]], len(ids))
    root = np.arange(len(ids))
    while len(p):  # least index that the pairs reach
        new = root.copy()
        np.minimum.at(new, p, root[q])
        np.minimum.at(new, q, root[p])
        new = new[new]
        if (new == root).all():
            break
        root = new
    keep = links > 0
    return pd.DataFrame({"node": ids[keep], "links": links[keep].astype(np.int64), "other": ids[root[keep]]})


def near_duplicates(vectors: DataFrame, threshold: float = 0.98, id_col: str = "vec_id",
                    vec_col: str = "embedding", label_col: str = "label", seed: int = 7) -> DataFrame:
    """(id, n_links, component_id, kept), one row for each row of ``vectors``.

    Rows link when their labels are equal and not null and their cosine, in double precision,
    is ``threshold`` or more. Vectors that are null, empty or zero, or hold a null or a
    non-finite number, link with nothing, nor do vectors of unlike length. ``n_links`` counts
    other rows, equal ones too; ``component_id`` is the smallest id reachable; a row is kept if
    that is its own. Pairs are found by hashing: one at the threshold is missed with a chance
    of 1 - ``RECALL``, closer ones less often. Other columns are ignored.
    """
    spark = vectors.sparkSession
    folder = run_folder(spark, "embeddings")
    rows = vectors.select(F.col(id_col).alias("id"), F.col(vec_col).alias("vec"), F.col(label_col).alias("label"))
    finite = F.forall("vec", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    good = (F.col("label").isNotNull() & F.col("vec").isNotNull() & F.coalesce(finite, F.lit(False))
            & F.coalesce(F.exists("vec", lambda x: x != 0), F.lit(False)))
    rows = rows.withColumn("node", F.when(good, F.xxhash64("label", "vec")))
    nodes = (rows.where("node IS NOT NULL").groupBy("node", "label", "vec")
             .agg(F.count("*").alias("weight"), F.min("id").alias("least")))
    nodes = staged(nodes, folder, "nodes")
    n = nodes.count()
    bits, tables = tables_for(n, threshold)

    def hashed(batches):
        planes = {}
        for batch in batches:
            vecs = batch.column("vec")
            dims = np.diff(vecs.offsets.to_numpy())
            flat = vecs.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
            first = np.cumsum(dims) - dims
            codes = np.zeros((batch.num_rows, tables), np.int64)
            for dim in np.unique(dims):
                if dim not in planes:
                    planes[dim] = np.random.default_rng([seed, int(dim)]).standard_normal((int(dim), tables * bits))
                own = np.flatnonzero(dims == dim)
                x = flat[first[own][:, None] + np.arange(dim)]
                x /= np.abs(x).max(1, keepdims=True)
                sign = (x @ planes[dim] > 0).reshape(len(own), tables, bits)
                codes[own] = sign @ (1 << np.arange(bits, dtype=np.int64))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(dims, pa.int32()),
                 pa.ListArray.from_arrays(np.arange(0, codes.size + 1, tables, np.int32), codes.ravel())],
                names=["node", "label", "vec", "weight", "dim", "codes"])

    label, vec = (nodes.schema[c].dataType.simpleString() for c in ("label", "vec"))
    coded = staged(nodes.select("node", "label", "vec", "weight").mapInArrow(
        hashed, f"node bigint, label {label}, vec {vec}, weight bigint, dim int, codes array<bigint>"), folder, "codes")
    key = ["t", "label", "dim", "code"]
    spots = coded.select("node", "label", "dim", F.posexplode("codes").alias("t", "code"))
    full = spots.groupBy(*key).agg(F.count("*").alias("m")).where("m > 1")
    full = full.withColumn("blocks", F.ceil(F.col("m") / BLOCK_ROWS).cast("int")).drop("m")
    mine = (coded.select("*", F.posexplode("codes").alias("t", "code")).join(full, key)
            .withColumn("block", F.pmod(F.xxhash64("node", F.lit(1)), F.col("blocks")).cast("int"))
            .withColumn("other_block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
            .withColumn("i", F.least("block", "other_block")).withColumn("j", F.greatest("block", "other_block"))
            .drop("other_block", "blocks"))
    total = spots.join(full, key).agg(F.sum("blocks")).first()[0] or 0
    bundles = spread(total, BUNDLE_ROWS)
    found = (mine.withColumn("bundle", F.pmod(F.xxhash64(*key, "i", "j"), F.lit(bundles)))
             .groupBy("bundle").applyInPandas(lambda t: link_blocks(t, threshold),
                                              "node bigint, links bigint, other bigint"))
    found = staged(found, folder, "links")
    links = found.groupBy("node").agg(F.sum("links").alias("links"))
    roots = components(found.select(F.col("node").alias("a"), F.col("other").alias("b")))
    tied = nodes.select("node", "weight", "least").join(links, "node", "left").join(roots, "node", "left")
    tied = tied.withColumn("root", F.coalesce("root", "node"))
    least = tied.groupBy("root").agg(F.min("least").alias("component_id"))
    tied = tied.join(least, "root").select(
        "node", (F.col("weight") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), "component_id")
    out = rows.drop("vec", "label").join(staged(tied, folder, "tied"), "node", "left")
    component = F.coalesce("component_id", "id")
    return out.select(F.col("id").alias(id_col), F.coalesce("n_links", F.lit(0)).alias("n_links"),
                      component.alias("component_id"), F.col("id").eqNullSafe(component).alias("kept"))
