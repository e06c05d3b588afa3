"""Near-duplicates by SimHash and a binary trie self-join.

Fingerprints of 64 bits are sorted, so that a trie node is a range of them.  Node
pairs are traversed together: the pair starts at a common prefix, each level adds the
bits in which the two sides differ, and a pair is dropped as soon as its differing bits
exceed the budget.  What remains at small nodes is verified by the whole fingerprints.

Two fingerprints within 3 bits agree on one of four 16-bit blocks.  Each block leads one
of four rotated tries, whose subtrees below that block are independent tasks: no pair is
lost and nothing is compared across subtrees.  A subtree with more fingerprints than
``split_above`` is itself dealt out as pairs of its children, six levels further down,
within the budget.  Copies are reduced to distinct fingerprints before; inside a task links are
folded into a forest, so at most one link per fingerprint and trie leaves it.

Edge cases: null and empty texts have fingerprint zero and link like any other; a null doc_id
never names a component while another id is there; repeated rows stay, each with its component;
other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from provlake.llm.common import arrow_batch, arrow_schema, saved, ship_package
from provlake.llm.components import connected_components, union

BLOCK, SUB = 16, 6  # bits that lead a rotated trie; further bits by which a large subtree is dealt out
CHUNK = 1 << 15  # node pairs expanded at once
LEAF = 64  # a node pair with no more fingerprint pairs than this is compared outright


def fingerprint(text: str | None, width: int = 3) -> int:
    """SimHash of the word shingles of a text: unsigned 64 bits, by majority over XXH64 (seed 42) of all shingles."""
    import numpy as np
    from xxhash import xxh64_intdigest

    parts = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not parts:
        return 0
    joined = b" ".join(parts)
    ends = np.cumsum(np.fromiter(map(len, parts), dtype=np.int64, count=len(parts)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    k = min(width, len(parts))
    ones = np.zeros(64, dtype=np.int64)
    n = len(parts) - k + 1
    spans = zip(starts[:n].tolist(), ends[k - 1:].tolist(), strict=True)
    hashes = np.fromiter((xxh64_intdigest(joined[a:b], 42) for a, b in spans), dtype="<u8", count=n)
    for at in range(0, n, 1 << 16):
        ones += np.unpackbits(hashes[at:at + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > n, bitorder="little").tobytes(), "little")


def fingerprints(docs: DataFrame, width: int = 3) -> DataFrame:
    """``(doc_id, fp)``; the 64 bits are held in a signed long."""
    ship_package(docs.sparkSession)
    schema = arrow_schema("doc_id long, fp long")

    def each(batches):
        for b in batches:
            fps = [f - (1 << 64) if (f := fingerprint(t, width)) >> 63 else f for t in b.column(1).to_pylist()]
            yield arrow_batch(list(zip(b.column(0).to_pylist(), fps, strict=True)), schema)

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(each, "doc_id long, fp long")


def close_pairs(bits, stack, budget: int):
    """Index arrays (i, j) of pairs within ``budget`` bits below the node pairs on the stack.

    ``bits`` is sorted inside every node.  A stack entry is (depth, a_from, a_to, b_from, b_to, errors); a
    pair of a node with itself has equal ranges.  The stack is worked depth first in chunks, so memory is bounded.
    """
    import numpy as np

    def middle(lo, hi, depth):
        lo, hi, shift = lo.copy(), hi.copy(), np.uint64(63 - depth)
        while (open_ := lo < hi).any():
            m = (lo + hi) // 2
            one = (bits[np.minimum(m, len(bits) - 1)] >> shift) & np.uint64(1) == 1
            hi = np.where(open_ & one, m, hi)
            lo = np.where(open_ & ~one, m + 1, lo)
        return lo

    while stack:
        depth, *pair = stack.pop()
        if len(pair[0]) > CHUNK:
            half = len(pair[0]) // 2
            stack += [(depth, *(p[:half] for p in pair)), (depth, *(p[half:] for p in pair))]
            continue
        a0, a1, b0, b1, err = pair
        size = (a1 - a0) * (b1 - b0)
        done = (size <= LEAF) | (depth == 64)
        if done.any():
            n, na, x, y = size[done], (a1 - a0)[done], a0[done], b0[done]
            k = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            na = np.repeat(na, n)
            i, j = np.repeat(x, n) + k % na, np.repeat(y, n) + k // na
            near = (i < j) & (np.bitwise_count(bits[i] ^ bits[j]) <= budget)
            yield i[near], j[near]
        if done.all():
            continue
        a0, a1, b0, b1, err = (p[~done] for p in pair)
        am, bm, same = middle(a0, a1, depth), middle(b0, b1, depth), a0 == b0
        children = [(a0, am, b0, bm, err, None), (am, a1, bm, b1, err, None),
                    (a0, am, bm, b1, err + 1, None), (am, a1, b0, bm, err + 1, ~same)]
        keep = [(p0 < p1) & (q0 < q1) & (e <= budget) & (True if only is None else only) for p0, p1, q0, q1, e, only in children]
        stack.append((depth + 1, *(np.concatenate([c[x][k] for c, k in zip(children, keep, strict=True)]) for x in range(5))))


def linked(rows, budget: int):
    """Forest (fp, root) of all fingerprints linked inside the tasks ``rows`` = arrays (turn, block, low, high, fp)."""
    import numpy as np

    turn, block, low, high, fp = rows
    fp = fp.view(np.uint64)
    shift = (48 - 16 * turn).astype(np.uint64)
    turned = np.where(shift == 0, fp, (fp << shift) | (fp >> ((np.uint64(64) - shift) & np.uint64(63))))
    order = np.lexsort((turned, high, low, block, turn))
    turn, block, low, high, fp, turned = (x[order] for x in (turn, block, low, high, fp, turned))
    new = np.ones(len(fp), dtype=bool)
    new[1:] = (turn[1:] != turn[:-1]) | (block[1:] != block[:-1]) | (low[1:] != low[:-1]) | (high[1:] != high[:-1])
    start = np.flatnonzero(new)
    stop = np.append(start[1:], len(fp))
    zero = np.zeros(len(start), dtype=np.int64)
    whole = low[start] < 0
    stack = [(BLOCK, start[whole], stop[whole], start[whole], stop[whole], zero[whole])]
    if not whole.all():
        s, e, lo, hi = start[~whole], stop[~whole], low[start][~whole], high[start][~whole]
        in_low = ((turned >> np.uint64(64 - BLOCK - SUB)) & np.uint64((1 << SUB) - 1)).astype(np.int64) == low
        ones = np.concatenate(([0], np.cumsum(in_low)))
        cut = s + ones[e] - ones[s]
        same = lo == hi
        stack.append((BLOCK + SUB, s, np.where(same, e, cut), np.where(same, s, cut), e, np.bitwise_count((lo ^ hi).astype(np.uint64)).astype(np.int64)))
        stack[-1] = (stack[-1][0], *(x[(stack[-1][1] < stack[-1][2]) & (stack[-1][3] < stack[-1][4])] for x in stack[-1][1:]))
    distinct, inverse = np.unique(fp, return_inverse=True)
    parent = np.arange(len(distinct))
    for i, j in close_pairs(turned, stack, budget):
        parent = union(parent, inverse[i], inverse[j])
    tied = parent != np.arange(len(distinct))
    return distinct[tied].view(np.int64), distinct[parent[tied]].view(np.int64)


def trie_links(fps: DataFrame, budget: int = 3, split_above: int = 20_000) -> DataFrame:
    """Links (u, v) that connect all distinct ``fp`` within ``budget`` <= 3 bits of each other."""
    turns = F.explode(F.array(*[F.lit(k) for k in range(4)]))
    led = (fps.select("fp", turns.alias("turn"))
           .withColumn("block", F.expr("(shiftrightunsigned(fp, 16 * turn) & 65535)").cast("int")))
    large = led.groupBy("turn", "block").count().where(F.col("count") > split_above).select("turn", "block", F.lit(True).alias("large"))
    # the six bits after the block, reading on cyclically
    sub = F.expr(f"((shiftrightunsigned(fp, 16 * ((turn + 3) % 4)) & 65535) >> {16 - SUB})").cast("int")
    masks = [m for m in range(1 << SUB) if m.bit_count() <= budget]
    pairs = F.when(F.col("large"), F.transform(F.array(*[F.lit(m) for m in masks]), lambda m: F.struct(
        F.least(F.col("sub"), F.col("sub").bitwiseXOR(m)).alias("low"), F.greatest(F.col("sub"), F.col("sub").bitwiseXOR(m)).alias("high")))
    ).otherwise(F.array(F.struct(F.lit(-1).alias("low"), F.lit(-1).alias("high"))))
    tasks = (led.join(large, ["turn", "block"], "left").withColumn("sub", sub)
             .select("turn", "block", "fp", F.inline(pairs)))
    ship_package(fps.sparkSession)
    arrow = arrow_schema("u long, v long")

    def join(batches):
        import numpy as np

        held = [[c.to_numpy(zero_copy_only=False) for c in b.columns] for b in batches if b.num_rows]
        if held:
            turn, block, low, high, fp = (np.concatenate(c) for c in zip(*held, strict=True))
            u, v = linked((turn.astype(np.int64), block, low.astype(np.int64), high.astype(np.int64), np.ascontiguousarray(fp)), budget)
            import pyarrow as pa

            yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], schema=arrow)

    return (tasks.repartition("turn", "block", "low", "high").select("turn", "block", "low", "high", "fp")
            .mapInArrow(join, "u long, v long"))


def simhash_components(docs: DataFrame, budget: int = 3, width: int = 3, split_above: int = 20_000) -> DataFrame:
    """``(doc_id, fp, component_id)``: the smallest doc_id reachable over links of at most ``budget`` differing bits."""
    prints = saved(fingerprints(docs, width), "fingerprints")
    least = prints.groupBy("fp").agg(F.min("doc_id").alias("least"))
    labels = connected_components(trie_links(least.select("fp"), budget, split_above))
    rooted = least.join(labels.toDF("fp", "label"), "fp", "left").withColumn("root", F.coalesce("label", "fp"))
    named = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    known = rooted.select("fp", "root").join(named, "root").select("fp", "component_id")
    return prints.join(known, "fp").select("doc_id", "fp", "component_id")


def keep_one(docs: DataFrame, budget: int = 3, width: int = 3) -> DataFrame:
    """One row of each component, unchanged: that of the smallest doc_id (a null id only where there is no other)."""
    numbered = saved(docs.withColumn("_row", F.monotonically_increasing_id()), "numbered")
    groups = simhash_components(numbered.select(F.col("_row").alias("doc_id"), "text"), budget, width)
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"), F.col("_row").alias("row")))
    named = groups.select(F.col("doc_id").alias("_row"), "component_id").join(numbered.select("_row", "doc_id"), "_row")
    stay = named.groupBy("component_id").agg(first.alias("first")).select(F.col("first.row").alias("_row"))
    return numbered.join(stay, "_row", "left_semi").select(*docs.columns)


def op3_simhash_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and component of every document."""
    found = simhash_components(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
