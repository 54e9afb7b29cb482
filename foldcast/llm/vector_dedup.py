"""Near-duplicate vectors by a neighbour graph that is refined through neighbours of neighbours."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from foldcast.llm.components import components
from foldcast.session import materialise

#: Neighbours per vector at first, and up to which full lists are doubled.
NEIGHBOURS, MOST_NEIGHBOURS = 12, 48
#: Random orders the first graph is drawn from, vectors looked ahead in each, and the signs of random
#: projections that an order goes by.
PROJECTIONS, AHEAD, SIGNS = 6, 6, 62
#: Rounds of refinement at least and at most.
ROUNDS, MOST_ROUNDS = 3, 8
#: Vectors drawn for the audit at first and at most, those with links it has to meet, and the mean
#: recall of these at which rounds end.
AUDITED, MOST_AUDITED, LINKED, ENOUGH = 256, 16_384, 256, 0.999
#: Rows of the two sides of a tile in the exact comparison.
TILE, WIDE_TILE = 512, 2048


def _matrix(column: pa.Array) -> np.ndarray:
    """A column of equally long lists as rows of a matrix."""
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return flat.flatten().to_numpy(zero_copy_only=False).reshape(len(flat), -1)


def unit_vectors(vectors: DataFrame, key: str, vector: str, label: str) -> tuple[DataFrame, DataFrame]:
    """Stored rows (row, key, label, vec) of all vectors, and classes (node, label, unit, copies) of equal
    ones that can link: a label, components all finite, and not all zero. ``unit`` has length 1."""
    rows = materialise(
        vectors.select(
            F.monotonically_increasing_id().alias("row"), F.col(key).alias("key"), F.col(label).alias("label"),
            F.transform(F.col(vector), lambda x: x.cast("double")).alias("vec"),
        ),
        "vectors",
    )
    fine = rows.where("label IS NOT NULL AND vec IS NOT NULL").where(
        F.forall("vec", lambda x: x.isNotNull() & (F.abs(x) < float("inf")) & ~F.isnan(x))
    )
    # halved by the largest component first, so that no square overflows or vanishes
    top = F.array_max(F.transform("vec", lambda x: F.abs(x)))
    scaled = fine.withColumn("top", top).where("top > 0").withColumn(
        "scaled", F.transform("vec", lambda x: F.try_divide(x, F.col("top")))
    )
    norm = F.sqrt(F.aggregate("scaled", F.lit(0.0), lambda s, x: s + x * x))
    classes = (
        scaled.withColumn("norm", norm)
        .groupBy("label", F.transform("scaled", lambda x: F.try_divide(x, F.col("norm"))).alias("unit"))
        .agg(F.min("row").alias("node"), F.count(F.lit(1)).alias("copies"))
    )
    return rows, materialise(classes.select("node", "label", "unit", "copies"), "units")


def first_graph(units: DataFrame, seed: int) -> DataFrame:
    """Edges (a, b, cos): per random order, vectors of one label that follow one another in it. An order
    goes by the signs of random projections, one after the other, then by the first projection: close
    vectors share the long row of first signs that few others share, however many there are. The
    order is cut into partitions by range, so a label may hold any share of all rows."""
    graph = None
    powers = 1 << np.arange(SIGNS - 1, -1, -1, dtype=np.int64)
    for k in range(PROJECTIONS):

        def projected(batches, k=k):
            for batch in batches:
                units_ = _matrix(batch.column("unit"))
                directions = np.random.default_rng((seed, k, units_.shape[1])).normal(size=(units_.shape[1], SIGNS))
                places = units_ @ directions
                signs = (places >= 0).astype(np.int64) @ powers
                yield batch.append_column("signs", pa.array(signs)).append_column("place", pa.array(places[:, 0].copy()))

        def near(batches):
            names, labels, points = [], [], []

            def flush(keep):
                node, label = np.concatenate(names), np.concatenate(labels)
                unit = np.concatenate(points)
                out = []
                for step in range(1, min(AHEAD, len(node) - 1) + 1):
                    same = np.flatnonzero(label[step:] == label[:-step])
                    cos = np.einsum("ij,ij->i", unit[same], unit[same + step])
                    out.append((node[same], node[same + step], cos))
                names[:], labels[:], points[:] = [node[-keep:]], [label[-keep:]], [unit[-keep:]]
                if out:
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.concatenate(c)) for c in zip(*out)], ["a", "b", "cos"]
                    )

            for batch in batches:
                unit = _matrix(batch.column("unit"))
                if points and points[-1].shape[1] != unit.shape[1]:
                    names[:], labels[:], points[:] = [], [], []
                names.append(batch.column("node").to_numpy())
                labels.append(batch.column("group").to_numpy())
                points.append(unit)
                yield from flush(AHEAD)

        kind = units.select("node", F.xxhash64("label", F.size("unit")).alias("group"), "unit")
        edges = (
            kind.mapInArrow(projected, "node long, group long, unit array<double>, signs long, place double")
            .repartitionByRange("group", "signs", "place")
            .sortWithinPartitions("group", "signs", "place")
            .mapInArrow(near, "a long, b long, cos double")
        )
        graph = edges if graph is None else graph.unionByName(edges)
    return graph


def best_neighbours(edges: DataFrame, sizes: DataFrame | None = None) -> DataFrame:
    """Stored (a, b, cos): for each node its nearest neighbours, as many as its list holds."""
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"), "cos"))
    one = both.groupBy("a", "b").agg(F.max("cos").alias("cos"))
    order = Window.partitionBy("a").orderBy(F.col("cos").desc(), "b")
    ranked = one.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= MOST_NEIGHBOURS)
    if sizes is None:
        return materialise(ranked.where(F.col("rank") <= NEIGHBOURS).drop("rank"), "graph")
    sized = ranked.join(sizes, "a", "left")
    return materialise(
        sized.where(F.col("rank") <= F.coalesce("size", F.lit(NEIGHBOURS))).select("a", "b", "cos"), "graph"
    )


def refined(graph: DataFrame, units: DataFrame, round_: int) -> DataFrame:
    """Edges found by comparing, at every node, its neighbours with each other and with it: the
    neighbours of a node and the nodes it is a neighbour of (as many of these as a list
    holds, chosen by hash anew in every round; the graph's own edges keep them all)."""
    back = graph.select(F.col("b").alias("at"), F.col("a").alias("member"))
    chosen = Window.partitionBy("at").orderBy(F.xxhash64("member", F.lit(round_)))
    some = back.withColumn("rank", F.row_number().over(chosen)).where(F.col("rank") <= NEIGHBOURS).drop("rank")
    around = (
        graph.select(F.col("a").alias("at"), F.col("b").alias("member"))
        .unionByName(some)
        .unionByName(units.select(F.col("node").alias("at"), F.col("node").alias("member")))
        .distinct()
    )
    points = units.select(F.col("node").alias("member"), F.transform("unit", lambda x: x.cast("float")).alias("unit"))
    lists = around.join(points, "member").groupBy("at").agg(F.collect_list(F.struct("member", "unit")).alias("near"))

    def compared(batches):
        for batch in batches:
            found = []
            near = batch.column("near")
            borders = near.offsets.to_numpy() - near.offsets[0].as_py()
            flat = near.flatten()
            members, points_ = flat.field("member").to_numpy(), _matrix(flat.field("unit"))
            for a, b in zip(borders[:-1].tolist(), borders[1:].tolist()):
                cos = points_[a:b] @ points_[a:b].T
                np.fill_diagonal(cos, -2)
                top = min(NEIGHBOURS, b - a - 1)
                if top < 1:
                    continue
                best = np.argpartition(-cos, top - 1, axis=1)[:, :top]
                found.append((
                    np.repeat(members[a:b], top), members[a:b][best].reshape(-1), np.take_along_axis(cos, best, 1).reshape(-1)
                ))
            if found:
                x, y, c = (np.concatenate(col) for col in zip(*found))
                first, second = np.minimum(x, y), np.maximum(x, y)
                pairs, where = np.unique(np.stack([first, second], axis=1), axis=0, return_index=True)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(pairs[:, 0]), pa.array(pairs[:, 1]), pa.array(c[where].astype(np.float64))], ["a", "b", "cos"]
                )

    return lists.select("near").mapInArrow(compared, "a long, b long, cos double")


def exact_cosines(pairs: DataFrame, units: DataFrame) -> DataFrame:
    """(a, b, cos) with the cosine in double precision."""
    x = units.select(F.col("node").alias("a"), F.col("unit").alias("x"))
    y = units.select(F.col("node").alias("b"), F.col("unit").alias("y"))
    dot = F.aggregate(F.zip_with("x", "y", lambda p, q: p * q), F.lit(0.0), lambda s, z: s + z)
    return pairs.select("a", "b").join(x, "a").join(y, "b").select("a", "b", dot.alias("cos"))


def tiled_links(some: DataFrame, units: DataFrame, threshold: float) -> tuple[DataFrame, DataFrame]:
    """The exact comparison of ``some`` nodes with all of their label, tile by tile: per node and tile
    (node, links), counting copies, and forest edges (a, b) that connect what is linked in a
    tile. Links to nodes outside ``some`` are listed by these nodes as well: (node, links) has them too.
    """
    left = some.select("node").join(units, "node")
    tiles = left.groupBy("label").agg(F.ceil(F.count(F.lit(1)) / TILE).cast("int").alias("n_left"))
    wide = units.join(tiles.select("label"), "label", "left_semi").groupBy("label").agg(
        F.ceil(F.count(F.lit(1)) / WIDE_TILE).cast("int").alias("n_right")
    )
    grid = tiles.join(wide, "label")
    marked = units.join(some.select("node").distinct().withColumn("full", F.lit(True)), "node", "left").withColumn(
        "full", F.coalesce("full", F.lit(False))
    )
    rows = marked.join(grid, "label")
    i = F.pmod(F.xxhash64("node"), F.col("n_left")).cast("int")
    j = F.pmod(F.xxhash64("node", F.lit(1)), F.col("n_right")).cast("int")
    as_left = rows.where("full").select(
        "label", i.alias("i"), F.explode(F.sequence(F.lit(0), F.col("n_right") - 1)).alias("j"),
        F.lit(0).alias("side"), "node", "unit", "copies", "full",
    )
    as_right = rows.select(
        "label", F.explode(F.sequence(F.lit(0), F.col("n_left") - 1)).alias("i"), j.alias("j"),
        F.lit(1).alias("side"), "node", "unit", "copies", "full",
    )

    def compared(table: pa.Table) -> pa.Table:
        side = table.column("side").to_numpy()
        lists = table.column("unit").combine_chunks()
        lists = lists if isinstance(lists, pa.Array) else pa.concat_arrays(lists.chunks)
        length = np.diff(lists.offsets.to_numpy())
        node, copies, full = (table.column(c).to_numpy() for c in ("node", "copies", "full"))
        out_node, out_links, out_peer = [], [], []
        for n in np.unique(length).tolist():
            here = length == n
            l, r = np.flatnonzero(here & (side == 0)), np.flatnonzero(here & (side == 1))
            if not len(l) or not len(r):
                continue
            x = _matrix(lists.take(pa.array(l)))
            y = _matrix(lists.take(pa.array(r)))
            hit = (x @ y.T >= threshold) & (node[l][:, None] != node[r][None, :])
            # spread the smallest number over what is connected within the tile
            low_l, low_r = node[l].copy(), node[r].copy()
            big = np.iinfo(np.int64).max
            while True:
                new_r = np.minimum(low_r, np.where(hit, low_l[:, None], big).min(axis=0))
                new_l = np.minimum(low_l, np.where(hit, new_r[None, :], big).min(axis=1))
                if np.array_equal(new_l, low_l) and np.array_equal(new_r, low_r):
                    break
                low_l, low_r = new_l, new_r
            out_node += [node[l], node[r]]
            links_r = np.where(full[r], 0, hit.T.astype(np.int64) @ copies[l])
            out_links += [hit.astype(np.int64) @ copies[r], links_r]
            out_peer += [low_l, low_r]
        empty = np.zeros(0, np.int64)
        return pa.table({
            "node": np.concatenate([empty, *out_node]), "links": np.concatenate([empty, *out_links]),
            "peer": np.concatenate([empty, *out_peer]),
        })

    found = materialise(
        as_left.unionByName(as_right)
        .groupBy("label", "i", "j")
        .applyInArrow(compared, "node long, links long, peer long")
        .where("links > 0 OR node <> peer"),
        "tiled",
    )
    links = found.groupBy("node").agg(F.sum("links").alias("links"))
    return links, found.where("node <> peer").select(F.col("node").alias("a"), F.col("peer").alias("b"))


def audit(graph: DataFrame, units: DataFrame, threshold: float) -> float | None:
    """Mean recall of the graph's links over sampled nodes that have any, against comparing these with
    all nodes. The sample is the nodes of smallest hash, so it can be held in every task; it grows
    until ``LINKED`` nodes with links are met. None if ``MOST_AUDITED`` nodes hold fewer and others are
    left; 1.0 without links only if all nodes were drawn."""
    known = graph.unionByName(graph.select(F.col("b").alias("a"), F.col("a").alias("b"), "cos")).select("a", "b").distinct()
    drawn = AUDITED
    while True:
        rows = units.orderBy(F.xxhash64("node", F.lit("audit"))).limit(drawn).select("node", "label", "unit").collect()
        by_kind: dict[tuple, tuple] = {}
        for r in rows:
            ids, points = by_kind.setdefault((r["label"], len(r["unit"])), ([], []))
            ids.append(r["node"])
            points.append(r["unit"])
        kinds = {kind: (np.array(ids), np.array(points)) for kind, (ids, points) in by_kind.items()}

        def true_links(batches, kinds=kinds):
            for batch in batches:
                node, unit = batch.column("node").to_numpy(), batch.column("unit")
                length = np.diff(unit.offsets.to_numpy()).tolist()
                places: dict[tuple, list[int]] = {}
                for at, kind in enumerate(zip(batch.column("label").to_pylist(), length)):
                    if kind in kinds:
                        places.setdefault(kind, []).append(at)
                for kind, here in places.items():
                    ids, points = kinds[kind]
                    a, b = np.nonzero(points @ _matrix(unit.take(pa.array(here))).T >= threshold)
                    a, b = ids[a], node[here][b]
                    yield pa.RecordBatch.from_arrays([pa.array(a[a != b]), pa.array(b[a != b])], ["a", "b"])

        truth = units.select("node", "label", "unit").mapInArrow(true_links, "a long, b long")
        per_node = truth.join(known.withColumn("found", F.lit(1)), ["a", "b"], "left").groupBy("a").agg(
            (F.count("found") / F.count(F.lit(1))).alias("share")
        )
        met = per_node.agg(F.count(F.lit(1)).alias("n"), F.avg("share").alias("recall")).first()
        if len(rows) < drawn or met["n"] >= LINKED:
            return met["recall"] if met["n"] else 1.0
        if drawn >= MOST_AUDITED:
            return None
        drawn *= 4


def vector_dedup(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", label: str = "label",
                 threshold: float = 0.98, seed: int = 5) -> DataFrame:
    """One row per vector: (key, n_links, component, kept, recall).

    Vectors of equal, non-null labels link when their cosine in double precision reaches
    ``threshold``. ``n_links`` counts the other vectors linked directly, ``component`` is the smallest key
    reachable by links, and ``kept`` marks the vector with that key (of repeated keys one). Vectors
    that are null, zero, or hold null or non-finite components link with nothing, as do
    vectors of different lengths. Equal vectors are one node of the graph. Lists whose
    neighbours all link are doubled; nodes whose list is full of links when the rounds end are
    compared exactly with all nodes of their label, in tiles. ``recall`` is that of an audited sample of the
    others, the same in all rows; rounds of refinement, with further random orders, go on until it
    is high. If it stays short of ``ENOUGH`` or links are too rare to tell, all nodes go to the tiles.
    """
    rows, units = unit_vectors(vectors, key, vector, label)
    # a little room below the threshold, for the rounds run in single precision
    near = threshold - 1e-5
    graph = best_neighbours(first_graph(units, seed))
    recall = None
    for round_ in range(MOST_ROUNDS):
        found = refined(graph, units, round_)
        if round_ >= ROUNDS:
            found = found.unionByName(first_graph(units, seed + round_))
        sizes = materialise(
            graph.groupBy("a").agg(F.count(F.lit(1)).alias("held"), F.min("cos").alias("least")).select(
                "a",
                F.when((F.col("least") >= near) & (F.col("held") >= NEIGHBOURS), F.least(F.col("held") * 2, F.lit(MOST_NEIGHBOURS)))
                .otherwise(F.greatest("held", F.lit(NEIGHBOURS))).alias("size"),
            ),
            "sizes",
        )
        graph = best_neighbours(graph.unionByName(found), sizes)
        if round_ + 1 >= ROUNDS:
            dense = graph.groupBy("a").agg(F.count(F.lit(1)).alias("held"), F.min("cos").alias("least")).join(sizes, "a", "left")
            full_nodes = dense.where(
                (F.col("least") >= near) & (F.col("held") >= F.coalesce("size", F.lit(NEIGHBOURS)))
            ).select(F.col("a").alias("node"))
            recall = audit(graph, units.join(full_nodes, "node", "left_anti"), threshold)
            if recall is None or recall >= ENOUGH:
                break
    if recall is None or recall < ENOUGH:
        full_nodes, recall = units.select("node"), 1.0
    else:
        # nodes beside a full one are compared exactly as well: their lists may hold part of its group only
        beside = graph.where(F.col("cos") >= near).join(full_nodes.withColumnRenamed("node", "b"), "b", "left_semi")
        full_nodes = full_nodes.unionByName(beside.select(F.col("a").alias("node"))).distinct()
    full_nodes = materialise(full_nodes, "full")
    pairs = graph.where(F.col("cos") >= near).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    sure = exact_cosines(pairs, units).where(F.col("cos") >= threshold).select("a", "b")
    links = materialise(sure, "links")
    tiled, forest = tiled_links(full_nodes, units, threshold)
    # links between two nodes outside the full ones are counted from the lists, all others from the tiles
    apart = links.join(full_nodes.withColumnRenamed("node", "a"), "a", "left_anti").join(
        full_nodes.withColumnRenamed("node", "b"), "b", "left_anti"
    )
    ends = apart.select(F.col("a").alias("node"), F.col("b").alias("peer")).unionByName(
        apart.select(F.col("b").alias("node"), F.col("a").alias("peer"))
    )
    counted = (
        ends.join(units.select(F.col("node").alias("peer"), "copies"), "peer")
        .groupBy("node").agg(F.sum("copies").alias("links"))
        .unionByName(tiled)
        .groupBy("node").agg(F.sum("links").alias("links"))
    )
    roots = components(links.unionByName(forest))
    classed = units.join(counted, "node", "left").join(roots, "node", "left").select(
        "node", "label", "unit", (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"),
        F.coalesce("root", "node").alias("root"),
    )
    return _per_row(rows, classed, recall)


def _per_row(rows: DataFrame, classed: DataFrame, recall: float) -> DataFrame:
    top = F.array_max(F.transform("vec", lambda x: F.abs(x)))
    scaled = F.transform("vec", lambda x: F.try_divide(x, F.col("top")))
    norm = F.sqrt(F.aggregate("scaled", F.lit(0.0), lambda s, x: s + x * x))
    unit = F.when(F.col("top") > 0, F.transform("scaled", lambda x: F.try_divide(x, F.col("norm"))))
    keyed = rows.withColumn("top", top).withColumn("scaled", scaled).withColumn("norm", norm).withColumn("unit", unit)
    labelled = materialise(
        keyed.select("row", "key", "label", "unit")
        .join(classed, ["label", "unit"], "left")
        .select("row", "key", F.coalesce("n_links", F.lit(0)).alias("n_links"), F.coalesce("root", -F.col("row") - 1).alias("root")),
        "labelled",
    )
    best = labelled.groupBy("root").agg(
        F.min("key").alias("component"), F.min(F.struct(F.col("key").isNull().alias("no_key"), "key", "row")).alias("least")
    )
    return labelled.join(best, "root").select(
        "key", "n_links", "component", (F.col("row") == F.col("least.row")).alias("kept"), F.lit(recall).alias("recall")
    )
