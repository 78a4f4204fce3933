"""Exact n-gram Jaccard join by prefix trees, and its components.

Documents with equal shingle sets are one node. All sets are ordered alike: rare shingles by
hash, then those that many documents share, the commonest last. Two sets that are similar
enough share a shingle among the first few of each (prefix filter), so nodes meet by those
shingles. Each shingle has a leader, and each node is held against the leader that it meets most
often; the components that this gives spare all further work within them. Where nodes of
different components meet, the sets that may be linked stand in one prefix tree, which a walk
with all of them at once searches for links between components (``blocks``), so no link that
would join two components is lost. The walk counts the overlap of a shared path once, and leaves
a subtree when even its longest set cannot reach the overlap that is needed. Parity sketches of
two sets tell most that cannot be linked before any set is moved.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quantflow.llm.blocks import BLOCK, BLOCK_VALUES, BUNDLE_NODES, block_links, block_parts, bundled, group_blocks, may_link, with_blocks
from quantflow.llm.components import components
from quantflow.llm.shared import chunks, drop_staged, likely_in, run_folder, spread, staged
from quantflow.llm.shingles import mix, set_keys, text_shingles

COMMON_TABLE = 200_000   # shared shingles that the order puts last, at most (broadcast, 3 MB)
COMMON_LEAST = 16        # documents that such a shingle is in, as far as tasks see it
TREE_ROWS = 256          # sets in one prefix tree
BUNDLE_ROWS = 1_000      # sets that one task call takes
SKETCH_BITS = 1 << 16    # of a parity sketch, at most (8 KB)


def needed(size: np.ndarray, percent: int) -> np.ndarray:
    """Overlap with a set of at least this size that a partner must have: ceil(percent %)."""
    return -(-size * percent // 100)


def parity_sketches(run: np.ndarray, value: np.ndarray, size: np.ndarray) -> pa.Array:
    """A parity sketch of each run's set, as a list of 64-bit words: every value flips the bit
    of its hash. The bits are a power of two, as many as the set has values or up to twice
    that (64 at least, ``SKETCH_BITS`` at most)."""
    bits = 1 << np.ceil(np.log2(np.clip(size, 64, SKETCH_BITS))).astype(np.int64)
    begin = np.cumsum(bits) - bits
    at = begin[run] + (mix(value, 77) & (bits[run] - 1).astype(np.uint64)).astype(np.int64)
    flips = np.bincount(at, minlength=int(bits.sum())).astype(np.uint8) & 1
    words = np.packbits(flips, bitorder="little").view(np.int64)
    return pa.ListArray.from_arrays(np.append(0, np.cumsum(bits // 64)).astype(np.int32), pa.array(words))


def sketches_allow(x: str, x_size: str, y: str, y_size: str, percent: int):
    """Whether two sets may be linked by their sketches ``x`` and ``y``. Shared values cancel when
    two sketches are combined, so each bit that is left stands for at least one value that only
    one of the sets has. A longer sketch is folded to the length of the shorter one, which is the
    sketch it would have had at that length."""
    def folded(c, width):
        return F.when(F.size(c) == width, F.col(c)).otherwise(F.transform(
            F.sequence(F.lit(0), width - 1),
            lambda i: F.aggregate(F.sequence(i, F.size(c) - 1, width), F.lit(0).cast("bigint"),
                                  lambda word, k: word.bitwiseXOR(F.col(c)[k]))))

    width = F.least(F.size(x), F.size(y))
    differ = F.aggregate(F.zip_with(folded(x, width), folded(y, width), lambda p, q: F.bit_count(p.bitwiseXOR(q))),
                         F.lit(0), lambda n, k: n + k)
    total = F.col(x_size) + F.col(y_size)
    return (total - differ) * (100 + percent) >= total * (2 * percent)


def plausible(pairs: DataFrame, sketches: DataFrame, percent: int) -> DataFrame:
    """Pairs (hub, member) without those that cannot be links by ``sketches`` (node, size, sketch)."""
    side = lambda name, c: sketches.select(F.col("node").alias(name), F.col("size").alias(f"{c}_size"), F.col("sketch").alias(c))
    both = pairs.join(side("hub", "x"), "hub").join(side("member", "y"), "member")
    return both.where(sketches_allow("x", "x_size", "y", "y_size", percent)).select("hub", "member")


class Common:
    """Order of shingles: those not in the table by hash, then the table's by its ranks."""

    def __init__(self, hashes: np.ndarray, counts: np.ndarray):
        order = np.lexsort((hashes, counts))
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(1, len(order) + 1)
        by = np.argsort(hashes)
        self.hashes, self.rank = hashes[by], rank[by]

    def ranks(self, value: np.ndarray) -> np.ndarray:
        if not len(self.hashes):
            return np.zeros(len(value), np.int64)
        at = np.minimum(np.searchsorted(self.hashes, value), len(self.hashes) - 1)
        return np.where(self.hashes[at] == value, self.rank[at], 0)

    def ordered(self, run: np.ndarray, value: np.ndarray) -> np.ndarray:
        """The values, each run's in the common order (they come sorted by run and hash)."""
        return value[np.lexsort((value, self.ranks(value), run))]


# ---------------------------------------------------------------- prefix tree

class Tree:
    """A path-compressed trie of ordered sets. A node has the shingles of its edge, children by
    their first shingle, the sets that end at it and the size of the longest set below."""

    __slots__ = ("edge", "children", "ends", "longest")

    def __init__(self, edge: np.ndarray):
        self.edge, self.children, self.ends, self.longest = edge, {}, [], 0

    def insert(self, values: np.ndarray, name) -> None:
        node, at, size = self, 0, len(values)
        while True:
            node.longest = max(node.longest, size)
            if at == size:
                node.ends.append(name)
                return
            child = node.children.get(values[at])
            if child is None:
                child = node.children[values[at]] = Tree(values[at:])
                child.longest = size
                child.ends.append(name)
                return
            room = min(len(child.edge), size - at)
            differ = np.flatnonzero(child.edge[:room] != values[at:at + room])
            same = int(differ[0]) if len(differ) else room
            if same < len(child.edge):
                lower = Tree(child.edge[same:])
                lower.children, lower.ends, lower.longest = child.children, child.ends, child.longest
                child.edge, child.children, child.ends = child.edge[:same], {lower.edge[0]: lower}, []
            node, at = child, at + same

    def similar(self, values: np.ndarray, percent: int) -> list:
        """Names of the sets whose Jaccard similarity with ``values`` is percent or more."""
        probe, size, found = np.sort(values), len(values), []
        walk = [(self, 0, 0)]
        while walk:
            node, depth, overlap = walk.pop()
            if len(node.edge):
                at = np.minimum(np.searchsorted(probe, node.edge), size - 1)
                overlap += int((probe[at] == node.edge).sum())
                depth += len(node.edge)
            if node.ends and 100 * overlap >= percent * (size + depth - overlap):
                found += node.ends
            for child in node.children.values():
                # the longest set below, if all that is left of it overlapped
                most = overlap + child.longest - depth
                if 100 * most >= percent * (size + child.longest - most):
                    walk.append((child, depth, overlap))
        return found


def decide(table: pd.DataFrame, percent: int) -> pd.DataFrame:
    """Links (a, b) of one bundle: rows without a member are the hubs, the others the sets
    that are to be compared with theirs."""
    hub = table["member"].isna()
    own = {(h, s): np.asarray(v) for h, s, v in zip(table["hub"][hub], table["salt"][hub], table["values"][hub])}
    out = []
    for key, group in table[~hub].groupby(["hub", "salt"], sort=False):
        tree = Tree(np.zeros(0, np.int64))
        for name, values in zip(group["member"], group["values"]):
            tree.insert(np.asarray(values), int(name))
        out += [(key[0], name) for name in tree.similar(own[key], percent)]
    return pd.DataFrame(out, columns=["a", "b"], dtype="int64")


def ends(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.col("hub").alias("node")).unionByName(pairs.select(F.col("member").alias("node"))).distinct()


def verified(pairs: DataFrame, sets_of, percent: int, folder: str, name: str, sketches: DataFrame | None = None) -> DataFrame:
    """Those pairs (hub, member) that are links, as (a, b). A hub's members are dealt out to
    trees of about ``TREE_ROWS`` sets."""
    if sketches is not None:
        # equal sets have equal sketches; they become one before the shuffle
        known = (likely_in(sketches, ends(pairs), "node").where("_likely").groupBy("node")
                 .agg(F.any_value("size").alias("size"), F.any_value("sketch").alias("sketch")))
        known = staged(known, folder, f"{name}-sketches")
        pairs = staged(plausible(pairs, known, percent), folder, f"{name}-pairs")
        drop_staged(pairs.sparkSession, folder, f"{name}-sketches")
    n = pairs.count()
    both = ends(pairs)
    sets = staged(sets_of(both), folder, f"{name}-sets")
    trees = pairs.groupBy("hub").agg(F.ceil(F.count("*") / TREE_ROWS).cast("int").alias("trees"))
    bundles = spread(n, BUNDLE_ROWS)
    members = (pairs.join(trees, "hub").withColumn("salt", F.pmod(F.xxhash64("member"), F.col("trees")).cast("int"))
               .join(sets.select(F.col("node").alias("member"), "values"), "member")
               .select("hub", "salt", F.col("member").cast("string").alias("member"), "values"))
    hubs = (trees.join(sets.select(F.col("node").alias("hub"), "values"), "hub")
            .select("hub", F.explode(F.sequence(F.lit(0), F.col("trees") - 1)).alias("salt"),
                    F.lit(None).cast("string").alias("member"), "values"))
    found = (hubs.unionByName(members).withColumn("bundle", F.pmod(F.xxhash64("hub", "salt"), F.lit(bundles)))
             .groupBy("bundle").applyInPandas(lambda t: decide(t, percent), "a bigint, b bigint"))
    found = staged(found, folder, name)
    drop_staged(pairs.sparkSession, folder, f"{name}-sets")
    return found


def link_sets(posts: DataFrame, sets_of, percent: int, folder: str, sketches: DataFrame | None = None) -> DataFrame:
    """(node, root) of the nodes that a link ties to others. ``posts`` (token, node, size, place)
    tells which nodes meet: linked nodes share a token, and have as many values left from its
    place on in both as their overlap needs. ``sets_of`` gives the ordered sets (node, values)
    of a frame of nodes; ``sketches`` (node, size, sketch) are their parity sketches, if any. Posts
    of small sets may carry them themselves, in a column ``sketch``. Posts staged as ``posts`` in
    the folder are deleted."""
    carried = [c for c in posts.columns if c == "sketch"]

    def can_link(a, b):
        """Sizes and places of a shared shingle that leave enough overlap. A pair passes at its
        first shared shingle if it is a link."""
        small, large = F.least(f"{a}.size", f"{b}.size"), F.greatest(f"{a}.size", f"{b}.size")
        most = F.least(F.col(f"{a}.size") - F.col(f"{a}.place"), F.col(f"{b}.size") - F.col(f"{b}.place"))
        fit = (small * 100 >= large * percent) & (most * (100 + percent) >= (small + large) * percent)
        return fit & sketches_allow(f"{a}.sketch", f"{a}.size", f"{b}.sketch", f"{b}.size", percent) if carried else fit

    band = F.floor(F.log(F.col("size").cast("double")) / np.log(100 / percent))
    lead = (posts.groupBy("token", band.alias("band"))
            .agg(F.min(F.struct(F.xxhash64("node").alias("h"), "node", "size", "place", *carried)).alias("lead"))
            .select("token", "band", *(f"lead.{c}" for c in ("node", "size", "place", *carried))))
    # of the leaders that a node meets, the one that it shares most tokens with
    stars = (posts.withColumn("band", band).alias("p").join(lead.alias("l"), ["token", "band"])
             .where(F.col("p.node") != F.col("l.node")).where(can_link("p", "l"))
             .groupBy(F.col("p.node").alias("member"), F.col("l.node").alias("hub")).count()
             .groupBy("member").agg(F.max(F.struct("count", F.xxhash64("hub").alias("h"), "hub")).alias("most"))
             .select("most.hub", "member"))
    stars = staged(stars, folder, "stars")
    links = verified(stars, sets_of, percent, folder, "star-links", sketches)
    at = posts.join(components(links), "node", "left").withColumn("root", F.coalesce("root", "node"))
    at = staged(at, folder, "rooted")
    drop_staged(posts.sparkSession, folder, "posts")
    mixed = (at.groupBy("token").agg(F.min("root").alias("x"), F.max("root").alias("y"), F.count("*").alias("count"),
                                     F.sum("size").alias("total")).where("x < y"))
    mixed = staged(mixed.select("token", "count", "total"), folder, "mixed")
    if mixed.isEmpty():
        return components(links)
    return components(links.unionByName(crossing(at, mixed, sets_of, percent, folder, sketches)))


def crossing(at: DataFrame, mixed: DataFrame, sets_of, percent: int, folder: str, sketches: DataFrame | None) -> DataFrame:
    """Links (a, b) between the components ``root`` of ``at`` (token, node, size, place, root and,
    if the posts carry them, sketch) that join them as all links would; ``mixed`` (token, count,
    total) are the tokens where components meet. Steps on hot tokens are jobs of their own, so that
    they can be split. Sets are moved once for their group of ties; a group that outgrows a block
    is searched in the ties of each block instead, so that none is held against the whole of it."""
    spark = at.sparkSession
    met = staged(with_blocks(at, mixed), folder, "met")
    drop_staged(spark, folder, "rooted")
    places = met
    if sketches is not None:
        known = (likely_in(sketches, met.select("node").distinct(), "node").where("_likely").groupBy("node")
                 .agg(F.any_value("sketch").alias("sketch")))
        places = staged(met.join(staged(known, folder, "met-sketches"), "node"), folder, "met-with-sketches")
        drop_staged(spark, folder, "met-sketches")
    ties = staged(bundled(places, met.count(), BUNDLE_NODES)
                  .applyInArrow(lambda t: may_link(t, percent), "a bigint, b bigint, block bigint"), folder, "ties")
    drop_staged(spark, folder, "met-with-sketches")
    groups = components(ties).select("node", F.col("root").alias("token"))
    able = met.groupBy("node").agg(F.any_value("root").alias("root"), F.any_value("size").alias("size")).join(groups, "node")
    able = staged(able, folder, "able")
    drop_staged(spark, folder, "met")
    sets = staged(sets_of(able.select("node")), folder, "able-sets")
    large = able.groupBy("token").agg(F.count("*").alias("count"), F.sum("size").alias("total")).where(block_parts() > 1).select("token")
    blocks = staged(group_blocks(able, ties, staged(large, folder, "large")), folder, "blocks")
    total = blocks.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]
    found = bundled(blocks.join(sets, "node").select(*BLOCK, "node", "root", "values"), total, BLOCK_VALUES).applyInArrow(
        lambda t: block_links(t, percent, lambda: Tree(np.zeros(0, np.int64))), "a bigint, b bigint")
    found = staged(found, folder, "crossing-links")
    drop_staged(spark, folder, "able-sets")
    return found


# ---------------------------------------------------------------- join

def link_documents(docs: DataFrame, n: int = 4, percent: int = 85, id_col: str = "doc_id",
                   text_col: str = "text") -> DataFrame:
    """(id, n_shingles, component_id), one row for each row of ``docs``.

    Words are runs of characters other than ASCII white space, A-Z lower-cased. Two rows link
    when 100 * intersection >= percent * union of their sets of ``n``-word shingles; a text of
    fewer words is one shingle; null texts and texts without words have no shingle and link
    with nothing. ``component_id`` is the smallest id reachable by links, a row's own included.
    Repeated rows link as equal texts do, and rows without an id as others; a component of such
    rows only has no ``component_id``. Other columns are ignored.
    """
    spark = docs.sparkSession
    folder = run_folder(spark, "jaccard")
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    rows = rows.withColumn("row", F.xxhash64("id", "text"))  # rows without an id have one too
    id_type = rows.schema["id"].dataType.simpleString()

    def survey(batches):
        """Each text's set size, key and sketch, and the shingles that several texts of a task share."""
        held: dict[int, int] = {}
        for batch in chunks(batches, 1):
            kind = batch.column(0).type
            run, value = text_shingles(batch.column(1), n)
            size, k1, k2 = set_keys(run, value, batch.num_rows)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(2), pa.array(size), pa.array(k1), pa.array(k2), pa.nulls(len(size), pa.int64()),
                 parity_sketches(run, value, size)], names=["id", "row", "size", "k1", "k2", "seen", "sketch"])
            seen, count = np.unique(value, return_counts=True)
            often = count > 1
            for v, c in zip(seen[often].tolist(), count[often].tolist()):
                held[v] = held.get(v, 0) + c
            if len(held) > 4 * COMMON_TABLE:
                held = dict(sorted(held.items(), key=lambda x: -x[1])[:2 * COMMON_TABLE])
        top = sorted(held.items(), key=lambda x: (-x[1], x[0]))[:COMMON_TABLE]
        if top:
            none = pa.nulls(len(top), pa.int64())
            yield pa.RecordBatch.from_arrays(
                [pa.nulls(len(top), kind), none, none, pa.array(np.array([v for v, _ in top], np.uint64).view(np.int64)), none,
                 pa.array([c for _, c in top], pa.int64()), pa.nulls(len(top), pa.list_(pa.int64()))],
                names=["id", "row", "size", "k1", "k2", "seen", "sketch"])

    seen = staged(rows.mapInArrow(survey, f"id {id_type}, row bigint, size bigint, k1 bigint, k2 bigint, seen bigint, sketch array<bigint>"), folder, "survey")
    own = seen.where("seen IS NULL").select("id", "row", "size", F.when(F.col("size") > 0, F.xxhash64("size", "k1", "k2")).alias("node"), "sketch")
    sketches = own.where("node IS NOT NULL").select("node", "size", "sketch")
    own = own.drop("sketch")
    nodes = own.where("node IS NOT NULL").groupBy("node").agg(F.min("id").alias("least"))
    often = (seen.where("seen IS NOT NULL").groupBy("k1").agg(F.sum("seen").alias("count"))
             .where(F.col("count") >= COMMON_LEAST).orderBy(F.desc("count"), "k1").limit(COMMON_TABLE).toPandas())
    common = spark.sparkContext.broadcast((often["k1"].to_numpy().view(np.uint64), often["count"].to_numpy()))

    def node_of(size, k1, k2):
        return F.xxhash64(size, k1, k2)

    def prefixes(batches):
        """The first shingles of each set, once for each set of a task."""
        order, told = Common(*common.value), set()
        for batch in chunks(batches, 0):
            run, value = text_shingles(batch.column(0), n)
            size, k1, k2 = set_keys(run, value, batch.num_rows)
            value = order.ordered(run, value)
            fresh = np.zeros(batch.num_rows, bool)
            for i, key in enumerate(zip(k1.tolist(), k2.tolist())):
                if key not in told:
                    told.add(key)
                    fresh[i] = True
            place = np.arange(len(run)) - (np.cumsum(size) - size)[run]
            keep = fresh[run] & (place <= (size - needed(size, percent))[run])
            run = run[keep]
            yield pa.RecordBatch.from_arrays(
                [pa.array(value[keep].view(np.int64)), pa.array(size[run]), pa.array(k1[run]), pa.array(k2[run]),
                 pa.array(place[keep].astype(np.int32))], names=["token", "size", "k1", "k2", "place"])

    posts = (rows.select("text").mapInArrow(prefixes, "token bigint, size bigint, k1 bigint, k2 bigint, place int")
             .select("token", "size", node_of("size", "k1", "k2").alias("node"), "place"))
    posts = staged(posts, folder, "every-post")
    shared = posts.groupBy("token").agg(F.min("node").alias("x"), F.max("node").alias("y")).where("x < y").select("token")
    # written first: posts that no other node has are left out before they are moved again, and
    # with the aggregate in one job, the join of a hot token could not be split
    shared = staged(shared, folder, "shared-tokens")
    posts = staged(likely_in(posts, shared, "token").where("_likely").drop("_likely").join(shared, "token"), folder, "met-posts")
    drop_staged(spark, folder, "every-post")
    posts = staged(posts.distinct(), folder, "posts")
    drop_staged(spark, folder, "met-posts")

    roots = link_sets(posts, lambda nodes: ordered_sets(rows, own, nodes, common, n), percent, folder, sketches)
    tied = nodes.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    least = tied.groupBy("root").agg(F.min("least").alias("component_id"))
    tied = staged(tied.join(least, "root").select("node", "component_id"), folder, "tied")
    return own.join(tied, "node", "left").select(
        F.col("id").alias(id_col), F.col("size").alias("n_shingles"), F.coalesce("component_id", "id").alias("component_id"))


def ordered_sets(rows: DataFrame, own: DataFrame, wanted: DataFrame, common, n: int) -> DataFrame:
    """(node, values): the ordered sets of the wanted nodes, from one text each. Texts that have
    no such node are left out before any shuffle, as far as a bitmap tells."""
    one = own.where("node IS NOT NULL").join(wanted, "node").groupBy("node").agg(F.min("row").alias("row")).select("row")

    def ordered(batches):
        order, told = Common(*common.value), set()
        for batch in chunks(batches, 0):
            keys = batch.column(1).to_pylist()
            fresh = [k not in told and not told.add(k) for k in keys]  # repeated rows
            batch = batch.filter(pa.array(fresh, pa.bool_()))
            run, value = text_shingles(batch.column(0), n)
            size, k1, k2 = set_keys(run, value, batch.num_rows)
            value = order.ordered(run, value).view(np.int64)
            at = np.append(0, np.cumsum(size)).astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(size), pa.array(k1), pa.array(k2),
                                              pa.ListArray.from_arrays(at, pa.array(value))], names=["size", "k1", "k2", "values"])

    texts = likely_in(rows, one, "row").where("_likely").join(one, "row", "left_semi").select("text", "row")
    made = texts.mapInArrow(ordered, "size bigint, k1 bigint, k2 bigint, values array<bigint>")
    return made.select(F.xxhash64("size", "k1", "k2").alias("node"), "values")
