"""Near-duplicate vectors by a robust-pruned flat graph.

Centroids are fitted on a bounded sample; every vector belongs to the cluster of its nearest centroid and is
a guest of the next few, so clusters overlap.  Each cluster's members are built into a graph: candidates of a
vector are pruned robustly (a neighbour goes if a kept one is much nearer to it), lists are made mutual, and what
several clusters found for a vector is the union of its lists.  A vector then searches the clusters it belongs
to: greedily from the medoid and from its own place, and from every hit the range is expanded over the graph until no new hit turns up.  Hits
are verified by cosines in double precision.

A pair counts once: where its second end is at home, or, seen from a guest whose own home cannot see it, there as well.
A cluster larger than ``shard_rows`` is dealt into parts by hash, each with its own graph, and its members search all
parts, so no task holds a whole large cluster.  Inside a task links are folded into a forest.

``audit`` measures recall against brute force for every row whose id is divisible by 20 over all rows, by links and by the mean
of vectors; ``near_links`` widens the overlap until both reach what is asked.

Edge cases: null, zero and non-finite vectors and those of another than the commonest length link with
nothing; equal vectors link; repeated rows are vectors of their own; a null vec_id is never the
smallest while another id is there; other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from provlake.llm.common import arrow_schema, saved, ship_package
from provlake.llm.components import connected_components, union

SAMPLE_ROWS = 20_000  # vectors that centroids are fitted on, at most
CLUSTER_ROWS = 1000  # vectors to a cluster, on average
MOST_CLUSTERS = 4096
SHARD_ROWS = 12_000
AUDIT_PASS, AUDIT_BLOCK = 16_384, 2048  # audited vectors that meet all rows in one pass; those compared at once
OVERLAP = 2  # clusters a vector belongs to, its home included
CANDIDATES, DEGREE, ALPHA, BEAM = 32, 16, 2.0, 8  # the factor is on cosine distances, so about 1.4 on angles

FOUND = "row long, links long, other long"


def valid_vectors(vectors: DataFrame) -> DataFrame:
    """``(row, vec_id, v)``, from ``(row, vec_id, embedding)``, of the vectors that can link, scaled to length one."""
    v = F.col("embedding").cast("array<double>")
    numbered = vectors.select("row", "vec_id", v.alias("v"))
    sound = F.coalesce(F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))), F.lit(False))
    # scaled by the largest component first, so that squares neither overflow nor vanish
    top = F.array_max(F.transform("v", lambda x: F.abs(x)))
    scaled = numbered.where(sound).withColumn("top", top).where("top > 0").withColumn("v", F.transform("v", lambda x: x / F.col("top")))
    length = F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x))
    return scaled.withColumn("length", length).select("row", "vec_id", F.transform("v", lambda x: x / F.col("length")).alias("v"))


def centroids(valid: DataFrame, seed: int = 4, rounds: int = 8):
    """Spherical k-means on a bounded sample; near centroids are merged, so that a dense group is not torn apart."""
    import numpy as np

    n = valid.count()
    sample = valid.select("v").orderBy(F.xxhash64(F.lit(seed), "row")).limit(SAMPLE_ROWS).collect()
    x = np.array([r.v for r in sample])
    k = min(max(n // CLUSTER_ROWS, 1), MOST_CLUSTERS, len(x))
    c = x[:k].copy()
    for _ in range(rounds):
        home = np.argmax(x @ c.T, axis=1)
        sums = np.zeros_like(c)
        np.add.at(sums, home, x)
        size = np.linalg.norm(sums, axis=1)
        c[size > 0] = sums[size > 0] / size[size > 0, None]
    kept: list[int] = []
    for i in np.argsort(-np.bincount(home, minlength=k), kind="stable"):
        if not kept or (c[kept] @ c[i]).max() < 0.9:
            kept.append(int(i))
    return c[kept]


def graph(x, degree: int = DEGREE, candidates: int = CANDIDATES, alpha: float = ALPHA):
    """Adjacency lists (rows of indices, -1 where short) of the vectors ``x``, pruned robustly and made mutual."""
    import numpy as np

    n = len(x)
    m = min(candidates, n - 1)
    out = np.full((n, degree), -1, dtype=np.int64)
    if m < 1:
        return out
    for at in range(0, n, 512):
        sims = x[at:at + 512] @ x.T
        rows = np.arange(len(sims))
        sims[rows, at + rows] = -2
        near = np.argpartition(-sims, m - 1, axis=1)[:, :m]
        near = np.take_along_axis(near, np.argsort(-np.take_along_axis(sims, near, 1), axis=1, kind="stable"), 1)
        dist = np.maximum(1 - np.take_along_axis(sims, near, 1), 0)
        live, filled = np.ones(near.shape, dtype=bool), np.zeros(len(sims), dtype=np.int64)
        for j in range(m):
            take = live[:, j] & (filled < degree)
            r = np.flatnonzero(take)
            out[at + r, filled[r]] = near[r, j]
            filled[r] += 1
            # what the kept neighbour covers is dropped
            between = 1 - np.einsum("rd,rmd->rm", x[near[r, j]], x[near[r]])
            live[r] &= alpha * between > dist[r]
            live[r, j] = False
    ends = np.argwhere(out >= 0)
    back = np.stack([out[ends[:, 0], ends[:, 1]], ends[:, 0]], axis=1)
    back = back[np.argsort(back[:, 0], kind="stable")]
    starts = np.searchsorted(back[:, 0], np.arange(n))
    rank = np.arange(len(back)) - starts[back[:, 0]]
    mutual = np.full((n, degree), -1, dtype=np.int64)
    fits = rank < degree
    mutual[back[fits, 0], rank[fits]] = back[fits, 1]
    chain = np.arange(n)[:, None]  # a ring, so that every vector can be reached
    return np.concatenate([out, mutual, (chain + 1) % n], axis=1)


def range_search(x, links, queries, starts, least: float, beam: int = BEAM, own=None):
    """Per query, a mask over ``x`` of hits: a greedy beam from ``starts``, then expansion of every hit until none is new.

    ``own`` holds, per query, its own place in the graph, or -1: a member also starts there.
    """
    import numpy as np

    n, q = len(x), len(queries)
    seen = np.zeros((q, n), dtype=bool)
    sims = np.full((q, n), -2.0)
    todo = np.zeros((q, n), dtype=bool)
    rows = np.arange(q)

    def visit(who, nodes):
        fresh = (nodes >= 0) & ~seen[who, nodes]
        who, nodes = who[fresh], nodes[fresh]
        seen[who, nodes] = True
        sims[who, nodes] = np.einsum("ij,ij->i", queries[who], x[nodes])
        todo[who, nodes] = True

    for s in starts:  # places for all queries, or one for each
        visit(rows, np.full(q, s))
    if own is not None:
        visit(rows, own)
    while True:
        # the beam: of the nearest seen vectors, those not expanded yet; and every hit
        k = min(beam, n)
        edge = np.partition(sims, n - k, axis=1)[:, n - k]
        who, nodes = np.nonzero(todo & ((sims >= edge[:, None]) | (sims >= least - 1e-9)))
        if not len(who):
            return sims >= least
        todo[who, nodes] = False
        visit(np.repeat(who, links.shape[1]), links[nodes].reshape(-1))


def members(valid: DataFrame, centers, overlap: int, shard_rows: int) -> DataFrame:
    """Every vector once for each cluster and part it belongs to or searches."""
    ship_package(valid.sparkSession)
    arrow = arrow_schema("row long, v array<double>, routes array<int>")

    def route(batches):
        import numpy as np
        import pyarrow as pa

        for b in batches:
            if not b.num_rows:
                continue
            x = np.array(b.column(1).to_pylist())
            near = np.argsort(-(x @ centers.T), axis=1, kind="stable")[:, :overlap]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(near.tolist(), type=arrow.field("routes").type)], schema=arrow)

    routed = saved(valid.select("row", "v").mapInArrow(route, "row long, v array<double>, routes array<int>"), "routed")
    sizes = routed.select(F.explode("routes").alias("cluster")).groupBy("cluster").count()
    parts = sizes.select("cluster", F.ceil(F.col("count") / F.lit(shard_rows)).cast("int").alias("parts"))  # one row per centroid
    spread = routed.select("row", "v", "routes", F.explode("routes").alias("cluster")).join(F.broadcast(parts), "cluster")
    own = F.pmod(F.xxhash64("row"), F.col("parts")).cast("int")
    return spread.select("row", "v", "routes", "cluster", own.alias("own"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))


def search_clusters(rows: DataFrame, least: float) -> DataFrame:
    """``(row, links, other)``: links counted for a row in one part of a cluster, or a tie (row, other) of the part's forest."""
    arrow = arrow_schema(FOUND)

    def search(table):
        import numpy as np
        import pyarrow as pa

        row = table["row"].to_numpy()
        order = np.argsort(row, kind="stable")
        row = row[order]
        x = table["v"].combine_chunks().flatten().to_numpy().reshape(len(row), -1)[order]
        routes = table["routes"].combine_chunks().flatten().to_numpy().reshape(len(row), -1)[order]
        cluster, part = table["cluster"][0].as_py(), table["part"][0].as_py()
        base = np.flatnonzero(table["own"].to_numpy()[order] == part)
        if not len(base):
            return pa.Table.from_batches([], schema=arrow)
        y, home = x[base], routes[:, 0]
        links = graph(y)
        medoid = int(np.argmax(y @ y.mean(axis=0)))
        counts, parent = np.zeros(len(row), dtype=np.int64), np.arange(len(row))
        at_home = home[base] == cluster
        place = np.full(len(row), -1, dtype=np.int64)
        place[base] = np.arange(len(base))
        pivots = np.unique(np.linspace(0, len(base) - 1, 128).astype(np.int64))
        for at in range(0, len(row), 256):
            asked = x[at:at + 256]
            near = pivots[np.argsort(-(asked @ y[pivots].T), axis=1)[:, :8]]  # further places to start from, for rows of other parts
            hit = range_search(y, links, asked, (medoid, *near.T), least, own=place[at:at + 256])
            q, b = np.nonzero(hit)
            q = q + at
            keep = (base[b] != q) & at_home[b]
            q, b = q[keep], b[keep]
            np.add.at(counts, q, 1)
            # the other end at home here, the query elsewhere: where its home cannot see the other end, the link counts here
            blind = ~(routes[base[b]] == home[q][:, None]).any(axis=1)
            np.add.at(counts, base[b][blind], 1)
            parent = union(parent, q, base[b])
        tied, counted = np.flatnonzero(parent != np.arange(len(row))), np.flatnonzero(counts)
        return pa.table([pa.array(np.concatenate([row[counted], row[tied]])), pa.array(np.concatenate([counts[counted], np.zeros(len(tied), dtype=np.int64)])),
                         pa.array(np.concatenate([np.full(len(counted), -1), row[parent[tied]]]))], schema=arrow)

    return rows.groupBy("cluster", "part").applyInArrow(search, FOUND)


def audit(valid: DataFrame, found: DataFrame, least: float, every: int = 20) -> float:
    """Recall of the links of all vectors whose id is divisible by ``every``, against brute force over all rows.

    The lesser of the share of all links and the mean share of a vector that has links, each at most 1: neither a dense
    group nor the many vectors of few links can hide what the others miss.
    """
    spark = valid.sparkSession
    asked = valid.where(F.col("vec_id") % every == 0)
    passes = -(-asked.count() // AUDIT_PASS)
    arrow, true = arrow_schema("row long, n long"), None
    for k in range(passes):
        block = asked.where(F.pmod(F.xxhash64(F.lit(9), "row"), F.lit(passes)) == k).select("row", "v").collect()
        if not block:
            continue
        shared = spark.sparkContext.broadcast(block)

        def count(batches, shared=shared):
            import numpy as np
            import pyarrow as pa

            q, ids = np.array([r.v for r in shared.value]), np.array([r.row for r in shared.value])
            n = np.zeros(len(ids), dtype=np.int64)
            for b in batches:
                if b.num_rows:
                    x, rows = np.array(b.column(1).to_pylist()), b.column(0).to_numpy()
                    for at in range(0, len(ids), AUDIT_BLOCK):
                        part = slice(at, at + AUDIT_BLOCK)
                        n[part] += ((q[part] @ x.T >= least) & (ids[part, None] != rows[None, :])).sum(axis=1)
            yield pa.RecordBatch.from_arrays([pa.array(ids[n > 0]), pa.array(n[n > 0])], schema=arrow)

        counted = saved(valid.select("row", "v").mapInArrow(count, "row long, n long").groupBy("row").agg(F.sum("n").alias("n")), "audit")
        true = counted if true is None else true.unionByName(counted)
        shared.destroy()
    if true is None:
        return 1.0
    seen = found.where("links > 0").groupBy("row").agg(F.sum("links").alias("links"))
    met = F.least(F.coalesce("links", F.lit(0)), "n")
    sums = true.join(seen, "row", "left").agg(F.sum("n").alias("n"), F.sum(met).alias("met"), F.avg(met / F.col("n")).alias("mean")).first()
    return min(sums.met / sums.n, sums.mean) if sums.n else 1.0


def near_links(vectors: DataFrame, least: float = 0.95, overlap: int = OVERLAP, shard_rows: int = SHARD_ROWS, recall: float = 0.98):
    """``(row, vec_id, n_links, component_id)`` of all rows of ``vectors(vec_id, embedding)``, and the audited recall."""
    numbered = saved(vectors.select(F.monotonically_increasing_id().alias("row"), F.col("vec_id").cast("long").alias("vec_id"), "embedding"), "vectors")
    valid = saved(valid_vectors(numbered), "valid")
    width = valid.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").first()
    if width is None:
        return numbered.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id")), 1.0
    valid = valid.where(F.size("v") == width.n)
    centers = centroids(valid)
    while True:
        found = saved(search_clusters(members(valid, centers, min(overlap, len(centers)), shard_rows), least), "found")
        reached = audit(valid, found, least)
        if reached >= recall or overlap >= len(centers):
            break
        overlap *= 2
    counts = found.groupBy("row").agg(F.sum("links").alias("n_links"))
    labels = connected_components(found.where("other >= 0").select(F.col("row").alias("u"), F.col("other").alias("v")))
    named = (valid.select("row", "vec_id").join(labels.toDF("row", "label"), "row", "left").join(counts, "row", "left")
             .withColumn("root", F.coalesce("label", "row")))
    least_ids = named.groupBy("root").agg(F.min("vec_id").alias("component_id"))
    linked = named.join(least_ids, "root").select("row", "n_links", "component_id")
    out = numbered.select("row", "vec_id").join(linked, "row", "left").select(
        "vec_id", F.coalesce("n_links", F.lit(0)).alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id"))
    return out, reached


def op9_prune_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links and component of every vector."""
    out, _ = near_links(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))
