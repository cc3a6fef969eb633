"""Operator 7: near-duplicate vectors by NN-descent, with audited recall.

1. Equal vectors are one node with a count, so copies fill no list.
2. Start: random-projection leaves give each vector a list of its NEIGHBOURS nearest (a crowded
   leaf is dealt into random pieces).
3. Descent: a vector's neighbours, and the vectors that have it as neighbour, meet at the vector;
   pairs of which one is new there are compared, and whatever beats the last entry of a list
   enters it. Rounds go on until less than DELTA of the entries change.
4. Enlarging: a list whose entries all reach the threshold is saturated, as its vector may have
   more links. Such vectors are compared with all that their links reach, in blocks, and their
   links counted, not listed. A group around one centre, so tight that every pair must link,
   is counted without comparing.
5. Audit: AUDIT_ROWS vectors of least hash, and as many among those with a link found, are
   compared with all rows in blocks. While fewer than RECALL of their links are known, new
   projections and descent follow, and after ROUNDS all vectors are compared, block by block.
6. Threshold edges are kept: lists hold every link of a vector that is not saturated.

Every pair at the threshold that is met anywhere ties its two vectors (a spanning forest of each
task), so groups whose lists are full of their own copies are still known to touch. Cosines are
computed in double precision, and no link is below the threshold.

Defined results: null, zero-length, zero, or non-finite vectors (null components included)
and vectors of another length than their partner link with nothing; the rows of a repeated
vec_id are compared each with its own vector and share the number of other vec_ids linked;
a null vec_id links with nothing; an empty table gives no rows.
"""

from __future__ import annotations

import logging
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common as C

LEAF = 256
TREES = 6
NEIGHBOURS = 12
DELTA = 0.05
BLOCK = 1024
AUDIT_ROWS = 400
RECALL = 0.97
ROUNDS = 3
MEET = 512
CELLS = 2_000_000
LOG = logging.getLogger(__name__)


def unit_rows(batches):
    """(vid, dim, unit): normalised doubles of the usable vectors."""
    for b in batches:
        ids, vectors = b.column(0), b.column(1)
        keep, dims, out = [], [], []
        for i in range(b.num_rows):
            v = vectors[i]
            if not v.is_valid:
                continue
            x = np.array(v.values.to_numpy(zero_copy_only=False), dtype=np.float64)  # null components become nan
            if len(x) and np.isfinite(x).all() and (most := np.abs(x).max()) > 0:
                x = x / most  # so squares neither overflow nor vanish
                keep.append(i)
                dims.append(len(x))
                out.append((x / np.sqrt((x * x).sum())).tobytes())
        yield pa.RecordBatch.from_arrays([ids.take(pa.array(keep, pa.int64())), pa.array(dims, pa.int32()), pa.array(out, pa.binary())], ["vid", "dim", "unit"])


def stack(col) -> np.ndarray:
    """The vectors of a binary column, all of one length."""
    data, off = C.text_bytes(col)
    return np.frombuffer(data.tobytes(), np.float64).reshape(len(off) - 1, -1) if len(data) else np.zeros((len(off) - 1, 0))


def codes(depth: int, trees: int, seed: int):
    """(rid, dim, unit, tree, code): sides of `depth` random hyperplanes for each tree."""

    def run(batches):
        planes: dict[int, np.ndarray] = {}
        for b in batches:
            dims = np.asarray(b.column(1))
            for d in np.unique(dims):
                part = b.take(pa.array(np.flatnonzero(dims == d)))
                x = stack(part.column(2))
                if d not in planes:
                    planes[d] = np.random.default_rng([seed, int(d)]).normal(size=(int(d), trees * depth))
                side = (x @ planes[d] > 0).reshape(len(x), trees, depth)
                code = (side * (1 << np.arange(depth))).sum(2) + (int(d) << 32)
                n = len(x)
                pick = pa.array(np.repeat(np.arange(n), trees))
                yield pa.RecordBatch.from_arrays([part.column(0).take(pick), part.column(2).take(pick), pa.array(np.tile(np.arange(trees, dtype=np.int32), n)), pa.array(code.reshape(-1).astype(np.int64))], ["rid", "unit", "tree", "code"])

    return run


FOUND = "a long, b long, cos double, kind int"
LINK, TIE, NEAR = 0, 1, 2  # a pair at the threshold; two rows that links connect; a candidate of a's list


def table_of(a, b, cos, kind: int) -> pa.Table:
    return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64()), "cos": pa.array(cos, pa.float64()), "kind": pa.array(np.full(len(a), kind), pa.int32())})


def trees_of(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the pairs: each row with the smallest of its tree."""
    out = list(C.forest([pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])]))
    return tuple(np.concatenate([np.asarray(x.column(i)) for x in out]) if out else np.zeros(0, np.int64) for i in (0, 1))


def leaf_search(threshold: float, k: int):
    """Rows of a leaf with each other: each row's k nearest, and a forest of the links."""

    def run(rows: pa.Table) -> pa.Table:
        ids, x = np.asarray(rows["rid"]), stack(rows["unit"])
        n = len(ids)
        if n < 2:
            return table_of([], [], [], NEAR)
        sim = x @ x.T
        np.fill_diagonal(sim, -2)
        p, q = np.nonzero(np.triu(sim, 1) >= threshold)
        node, root = trees_of(ids[p], ids[q])
        few = min(k, n - 1)
        top = np.argpartition(-sim, few - 1, axis=1)[:, :few]
        near = table_of(np.repeat(ids, few), ids[top.reshape(-1)], np.take_along_axis(sim, top, 1).reshape(-1), NEAR)
        return pa.concat_tables([near, table_of(node, root, np.ones(len(node)), TIE)])

    return run


def local_join(threshold: float):
    """Rows (at, piece, rid, new, worst, unit) sorted by at and piece: the vectors that meet there,
    each with the others, many meetings in one product."""

    def pairs(ids, new, worst, x, start, size):
        """Pairs of the meetings that begin at `start` with `size` rows each."""
        out = []
        for width in np.unique(-(-size // 8) * 8):
            which = np.flatnonzero(-(-size // 8) * 8 == width)
            step = max(1, CELLS // int(width * width))
            for at in range(0, len(which), step):
                own = which[at : at + step]
                idx = start[own][:, None] + np.arange(width)
                real = np.arange(width) < size[own][:, None]
                idx = np.where(real, idx, 0)
                v = x[idx]
                sim = v @ v.transpose(0, 2, 1)
                fresh = new[idx]
                ok = (real[:, :, None] & real[:, None, :]) & (fresh[:, :, None] | fresh[:, None, :]) & np.triu(np.ones((width, width), bool), 1)
                w = worst[idx]
                ok &= (sim > np.minimum(w[:, :, None], w[:, None, :])) | (sim >= threshold)
                g, i, j = np.nonzero(ok)
                out.append((idx[g, i], idx[g, j], sim[g, i, j]))
        p, q, cos = (np.concatenate(c) for c in zip(*out, strict=True)) if out else (np.zeros(0, np.int64),) * 3
        node, root = trees_of(ids[p[cos >= threshold]], ids[q[cos >= threshold]])
        a, b, c = np.concatenate([p, q]), np.concatenate([q, p]), np.concatenate([cos, cos])
        better = c > worst[a]
        a, b, c = ids[a[better]], ids[b[better]], c[better]
        order = np.lexsort((b, a))
        a, b, c = a[order], b[order], c[order]
        once = np.ones(len(a), bool)
        once[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
        return pa.concat_tables([table_of(a[once], b[once], c[once], NEAR), table_of(node, root, np.ones(len(node)), TIE)])

    def work(rows: pa.Table):
        rows = rows.combine_chunks()
        at, piece = np.asarray(rows["at"]), np.asarray(rows["piece"])
        _, off = C.text_bytes(rows["unit"])
        first = np.flatnonzero(np.append(True, (at[1:] != at[:-1]) | (piece[1:] != piece[:-1])))
        size = np.diff(np.append(first, len(at)))
        width = np.diff(off)[first]
        for d in np.unique(width):  # a meeting holds vectors of one length
            which = np.flatnonzero(width == d)
            mine = np.repeat(width == d, size)
            part = rows.filter(pa.array(mine))
            start = np.cumsum(size[which]) - size[which]
            yield from pairs(np.asarray(part["rid"]), np.asarray(part["new"]), np.asarray(part["worst"]), stack(part["unit"]), start, size[which]).to_batches()

    def run(batches):
        held = None
        for b in batches:
            rows = pa.Table.from_batches([b]) if held is None else pa.concat_tables([held, pa.Table.from_batches([b])])
            at, piece = np.asarray(rows["at"]), np.asarray(rows["piece"])
            ends = np.flatnonzero((at[1:] != at[:-1]) | (piece[1:] != piece[:-1])) + 1
            cut = int(ends[-1]) if len(ends) else 0  # the last meeting may go on
            if cut:
                yield from work(rows.slice(0, cut))
            held = rows.slice(cut)
        if held is not None and held.num_rows:
            yield from work(held)

    return run


def top_lists(entries: DataFrame, k: int) -> DataFrame:
    """The k nearest of each a. Entries (a, b, cos, new) met before keep their flag. The limit by
    rank is applied before the shuffle too, so no task holds all candidates of a vector."""
    once = entries.groupBy("a", "b").agg(F.max("cos").alias("cos"), F.min("new").alias("new"))
    rank = F.row_number().over(Window.partitionBy("a").orderBy(F.desc("cos"), "b"))
    return once.withColumn("rank", rank).filter(F.col("rank") <= k).drop("rank")


def centred(batches):
    """(grp, dim, sum, n): a task's sum of the vectors of each group."""
    held: dict[tuple[int, int], list] = {}
    for b in batches:
        grp, dims = np.asarray(b.column(0)), np.asarray(b.column(1))
        for d in np.unique(dims):
            own = np.flatnonzero(dims == d)
            x = stack(b.column(2).take(pa.array(own)))
            names, of = np.unique(grp[own], return_inverse=True)
            total = np.zeros((len(names), x.shape[1]))
            np.add.at(total, of, x)
            for g, t, n in zip(names.tolist(), total, np.bincount(of).tolist(), strict=True):
                if (g, int(d)) in held:
                    held[g, int(d)][0] += t
                    held[g, int(d)][1] += n
                else:
                    held[g, int(d)] = [t, n]
        if len(held) > BLOCK:
            yield sums_batch(held)
            held = {}
    yield sums_batch(held)


def sums_batch(held) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([k[0] for k in held], pa.int64()), pa.array([k[1] for k in held], pa.int32()), pa.array([v[0].tobytes() for v in held.values()], pa.binary()), pa.array([v[1] for v in held.values()], pa.int64())], ["grp", "dim", "sum", "n"])


def added(rows: pa.Table) -> pa.Table:
    """One group's centre: the direction of the sum of its vectors."""
    total = stack(rows["sum"]).sum(0)
    norm = np.sqrt((total * total).sum())
    return pa.table({"grp": rows["grp"].slice(0, 1), "centre": pa.array([(total / norm if norm > 0 else total).tobytes()], pa.binary())})


def angles(batches):
    """(grp, angle): the largest angle to the centre among a batch's members of each group."""
    for b in batches:
        if not b.num_rows:
            continue
        grp = np.asarray(b.column(0))
        x, y = b.column(1), b.column(2)
        angle = np.array([np.arccos(np.clip(np.frombuffer(u, np.float64) @ np.frombuffer(c, np.float64), -1, 1)) for u, c in zip(x.to_pylist(), y.to_pylist(), strict=True)])
        names, of = np.unique(grp, return_inverse=True)
        most = np.zeros(len(names))
        np.maximum.at(most, of, angle)
        yield pa.RecordBatch.from_arrays([pa.array(names), pa.array(most)], ["grp", "angle"])


def tight_groups(groups: DataFrame, nodes: DataFrame, threshold: float, scratch: C.Scratch) -> DataFrame:
    """(grp) of the groups that fit into a cone in which any two vectors must link."""
    placed = groups.join(nodes, "rid").select("grp", "dim", "unit")
    centre = scratch.keep(placed.mapInArrow(centred, "grp long, dim int, sum binary, n long").groupBy("grp").applyInArrow(added, "grp long, centre binary"))
    wide = groups.join(nodes, "rid").join(centre, "grp").select("grp", "unit", "centre").mapInArrow(angles, "grp long, angle double")
    shared = groups.join(nodes.filter("shared"), "rid").select("grp").distinct()
    return wide.groupBy("grp").agg(F.max("angle").alias("angle")).filter(2 * F.col("angle") < float(np.arccos(threshold)) - 1e-7).select("grp").join(shared, "grp", "left_anti")


def block_pairs(groups: DataFrame) -> DataFrame:
    """groups (rid, grp, full): blocks of full rows (left) with blocks of all rows of their group."""
    size = groups.groupBy("grp").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("nc"), F.ceil(F.count_if("full") / BLOCK).cast("int").alias("ns"))
    own = lambda of: F.pmod(F.xxhash64("rid"), F.col(of)).cast("int")
    dealt = groups.join(size, "grp")
    every = lambda of: F.explode(F.sequence(F.lit(0), F.col(of) - 1))
    left = dealt.filter("full").select("rid", "grp", "full", F.lit(True).alias("left"), own("ns").alias("bi"), every("nc").alias("bj"))
    return left.union(dealt.filter("ns > 0").select("rid", "grp", "full", F.lit(False).alias("left"), every("ns").alias("bi"), own("nc").alias("bj")))


def block_counts(threshold: float):
    """Links of a block of full rows with a block of their group: (a, a, n) with kind NEAR and a
    forest of them; as pairs only those with a row that is not full, or with one whose vec_id has
    other vectors too."""

    def run(rows: pa.Table) -> pa.Table:
        rows = rows.combine_chunks()
        left, full, ids, x = np.asarray(rows["left"]), np.asarray(rows["full"]), np.asarray(rows["rid"]), stack(rows["unit"])
        w, shared = np.asarray(rows["w"]), np.asarray(rows["shared"])
        i, j = np.flatnonzero(left), np.flatnonzero(~left)
        if not len(i) or not len(j):
            return table_of([], [], [], LINK)
        near = x[i] @ x[j].T >= threshold
        near &= ids[i][:, None] != ids[j][None, :]
        some = near & (~full[j] | shared[j] | shared[i][:, None])
        p, q = np.nonzero(some)
        counted = table_of(ids[i], ids[i], (near @ w[j]).astype(float), NEAR)
        node, root = trees_of(*(ids[side[x]] for side, x in zip((i, j), np.nonzero(near), strict=True)))
        return pa.concat_tables([counted, table_of(ids[i[p]], ids[j[q]], np.ones(len(p)), LINK), table_of(node, root, np.ones(len(node)), TIE)])

    return run


def audit(units: DataFrame, queries: list, threshold: float) -> DataFrame:
    """(a, b, known, wanted): the links of the audited vectors with all rows of units (rid, dim, unit,
    comp, full). A link inside a component with a full end is known, one between components is
    not; both are only counted. The others come as pairs, to be looked up."""
    by_dim: dict[int, list] = {}
    for q in queries:
        by_dim.setdefault(q.dim, []).append(q)
    mats = {d: (np.array([q.rid for q in x], np.int64), np.array([q.comp for q in x], np.int64), np.array([q.full for q in x], bool), np.stack([np.frombuffer(q.unit, np.float64) for q in x])) for d, x in by_dim.items()}

    def run(batches):
        for b in batches:
            dims = np.asarray(b.column(1))
            for d in np.unique(dims):
                if d not in mats:
                    continue
                own = pa.array(np.flatnonzero(dims == d))
                ids, comps, fulls, x = mats[d]
                for at in range(0, len(own), BLOCK):
                    part = b.take(own[at : at + BLOCK])
                    rid, comp, full = np.asarray(part.column(0)), np.asarray(part.column(3)), part.column(4).to_numpy(zero_copy_only=False)
                    near = (x @ stack(part.column(2)).T >= threshold) & (ids[:, None] != rid[None, :])
                    inside = comps[:, None] == comp[None, :]
                    sure = near & inside & (fulls[:, None] | full[None, :])
                    p, q = np.nonzero(near & inside & ~sure)
                    n = len(p)
                    row = [pa.array([*ids[p].tolist(), -1]), pa.array([*rid[q].tolist(), None], pa.int64()), pa.array([*[0] * n, int(sure.sum())]), pa.array([*[1] * n, int(sure.sum() + (near & ~inside).sum())])]
                    yield pa.RecordBatch.from_arrays(row, ["a", "b", "known", "wanted"])

    return units.select("rid", "dim", "unit", "comp", "full").mapInArrow(run, "a long, b long, known long, wanted long")


def near_vectors(vectors: DataFrame, threshold: float = 0.9, seed: int = 11) -> DataFrame:
    """vectors (vec_id, embedding, any others) -> vec_id, n_links, component_id, kept."""
    spark = vectors.sparkSession
    scratch = C.Scratch(spark, "nn-descent")
    rows = vectors.select(F.col("vec_id").cast("long"), "embedding")
    units = scratch.keep(rows.filter("vec_id is not null and embedding is not null").mapInArrow(unit_rows, "vid long, dim int, unit binary").distinct())
    # equal vectors are one node, so copies fill no list
    nodes = scratch.keep(units.groupBy("dim", "unit").agg(F.count("*").alias("n")).select(F.monotonically_increasing_id().alias("rid"), "dim", "unit"))
    members = scratch.keep(units.join(nodes, ["dim", "unit"]).select("vid", "rid"))
    several = scratch.keep(members.groupBy("vid").agg(F.count("*").alias("n")).filter("n > 1").select("vid"))
    weights = members.join(several.withColumn("more", F.lit(True)), "vid", "left").groupBy("rid").agg(F.count(F.when(F.col("more").isNull(), 1)).alias("w"), F.coalesce(F.max("more"), F.lit(False)).alias("shared"))
    nodes = scratch.keep(nodes.join(weights, "rid"))
    count = nodes.count()
    depth = max(0, int(np.ceil(np.log2(max(count, 1) / (LEAF / 2)))))
    none = spark.createDataFrame([], "a long, b long, cos double, new int")
    lists, met = none, []  # met: candidates whose ties are kept

    def taken(found: DataFrame) -> int:
        """Lists after new candidates, and how many of their entries are new."""
        nonlocal lists
        old = lists
        entries = found.filter(F.col("kind") == NEAR).select("a", "b", "cos", F.lit(1).alias("new"))
        lists = scratch.keep(top_lists(entries.union(old.withColumn("new", F.lit(0))), NEIGHBOURS))
        met.append(found.filter(F.col("kind") == TIE).select("a", "b"))
        scratch.drop(*(x for x in [old] if hasattr(x, "_scratch_path")))
        scratch.sweep()
        return lists.agg(F.sum("new")).first()[0] or 0

    for turn in range(ROUNDS):
        coded = nodes.select("rid", "dim", "unit").mapInArrow(codes(depth, TREES, seed + turn), "rid long, unit binary, tree int, code long")
        crowded = coded.groupBy("tree", "code").agg(F.ceil(F.count("*") / (2 * LEAF)).cast("int").alias("pieces")).filter("pieces > 1")
        dealt = coded.join(scratch.keep(crowded), ["tree", "code"], "left").withColumn("piece", F.coalesce(F.pmod(F.xxhash64("rid", "tree"), F.col("pieces")), F.lit(0)))
        taken(scratch.keep(dealt.groupBy("tree", "code", "piece").applyInArrow(leaf_search(threshold, NEIGHBOURS), FOUND)))
        updates = None
        while updates is None or updates > DELTA * NEIGHBOURS * count:
            # descent: the vectors of a list and of the lists it stands in meet at the vector
            one = lists.select(F.col("a").alias("at"), F.col("b").alias("rid"), "new").union(lists.select(F.col("b").alias("at"), F.col("a").alias("rid"), "new"))
            at = Window.partitionBy("at")
            meet = one.groupBy("at", "rid").agg(F.max("new").alias("new")).withColumns({"any": F.max("new").over(at), "pieces": F.ceil((F.count("*").over(at) + 1) / MEET).cast("int"), "nth": F.row_number().over(at.orderBy("rid"))}).filter("any > 0")
            # the vector itself meets the others too, once
            own = F.when(F.col("nth") == 1, F.array(F.struct("rid", "new"), F.struct(F.col("at").alias("rid"), F.lit(0).alias("new")))).otherwise(F.array(F.struct("rid", "new")))
            meet = meet.select("at", "pieces", F.explode(own).alias("x")).select("at", "pieces", "x.rid", "x.new")
            worst = lists.groupBy("a").agg(F.when(F.count("*") >= NEIGHBOURS, F.min("cos")).alias("worst"))
            known = nodes.select("rid", "unit").join(worst, F.col("rid") == F.col("a"), "left").select("rid", "unit", F.coalesce("worst", F.lit(-2.0)).alias("worst"))
            meeting = meet.join(known, "rid").select("at", F.pmod(F.xxhash64("rid", "at"), F.col("pieces")).alias("piece"), "rid", (F.col("new") > 0).alias("new"), "worst", "unit")
            updates = taken(scratch.keep(meeting.repartition("at", "piece").sortWithinPartitions("at", "piece").mapInArrow(local_join(threshold), FOUND)))
        ties = reduce(DataFrame.union, met)
        links = scratch.keep(lists.filter(F.col("cos") >= threshold).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
        comp = scratch.keep(C.components(spark, ties.union(links), scratch))
        # saturated lists: their vectors are full, and compared with all that they reach
        full = scratch.keep(lists.filter(F.col("cos") >= threshold).groupBy("a").agg(F.count("*").alias("n")).filter(F.col("n") >= NEIGHBOURS).select(F.col("a").alias("rid"), F.lit(True).alias("full")))
        hot = full.join(comp, F.col("rid") == F.col("node")).select(F.col("component").alias("grp")).distinct()
        groups = comp.select(F.col("node").alias("rid"), F.col("component").alias("grp")).join(hot, "grp").join(full, "rid", "left").select("rid", "grp", F.coalesce("full", F.lit(False)).alias("full"))
        groups = scratch.keep(groups)
        # audited: any vectors, and vectors with a link
        marked = nodes.select("rid", "dim", "unit").join(comp.select(F.col("node").alias("rid"), F.col("component").alias("comp")), "rid", "left").join(full, "rid", "left")
        marked = scratch.keep(marked.select("rid", "dim", "unit", F.coalesce("comp", "rid").alias("comp"), F.coalesce("full", F.lit(False)).alias("full")))
        linked = links.select(F.explode(F.array("a", "b")).alias("rid")).distinct().orderBy(F.xxhash64("rid")).limit(AUDIT_ROWS)
        queries = {q.rid: q for q in [*marked.orderBy(F.xxhash64("rid")).limit(AUDIT_ROWS).collect(), *marked.join(F.broadcast(linked), "rid").collect()]}  # bounded
        truth = audit(marked, [queries[i] for i in sorted(queries)], threshold)
        both = links.union(links.select("b", "a")).withColumn("seen", F.lit(1))
        wanted, got = truth.join(both, ["a", "b"], "left").agg(F.coalesce(F.sum("wanted"), F.lit(0)), F.coalesce(F.sum(F.col("known") + F.coalesce("seen", F.lit(0))), F.lit(0))).first()
        scratch.drop(marked)
        LOG.info("audit: %d of %d links of %d vectors are known", got, wanted, len(queries))
        if got >= RECALL * wanted:
            break
    else:  # the audit never passed: one group of all vectors of a length
        LOG.warning("recall stayed below %g; all vectors are compared", RECALL)
        groups = nodes.select("rid", F.col("dim").cast("long").alias("grp"), F.lit(True).alias("full"))
        links = links.limit(0)
    tight = scratch.keep(tight_groups(groups, nodes, threshold, scratch))
    weighed = groups.join(tight, "grp").join(nodes.select("rid", "w"), "rid")
    cone = weighed.groupBy("grp").agg(F.sum("w").alias("all"))
    cone = scratch.keep(weighed.join(cone, "grp").select("rid", F.col("all") - F.col("w")))
    loose = groups.join(tight, "grp", "left_anti")
    tallied = scratch.keep(block_pairs(loose).join(nodes, "rid").groupBy("grp", "bi", "bj").applyInArrow(block_counts(threshold), FOUND))
    some = tallied.filter(F.col("kind") == LINK).select("a", "b")
    known = links.union(some)
    pairs = known.union(known.select("b", "a")).distinct()
    done = loose.filter("full").select(F.col("rid").alias("a")).union(cone.select("rid"))  # counted, not listed
    both = pairs.join(done, "a", "left_anti")
    # n_links: the vec_ids of a vector's copies and of every linked vector
    sums = both.join(nodes.select(F.col("rid").alias("b"), "w"), "b").select("a", "w").union(tallied.filter(F.col("kind") == NEAR).select("a", F.col("cos").cast("long")))
    sums = sums.union(nodes.select("rid", F.col("w") - 1)).union(cone).groupBy("a").agg(F.sum("w").alias("n"))
    many = members.join(several, "vid")
    all_ = pairs.union(nodes.select("rid", "rid"))
    beside = all_.join(many.select(F.col("rid").alias("b"), "vid"), "b").select("a", "vid").distinct().groupBy("a").agg(F.count("*").alias("more"))
    single = members.join(several, "vid", "left_anti").join(sums, F.col("rid") == sums.a).drop("a").join(beside, F.col("rid") == beside.a, "left").select("vid", (F.col("n") + F.coalesce("more", F.lit(0))).alias("n"))
    partner = members.select(F.col("rid").alias("b"), F.col("vid").alias("other"))
    spread = many.join(all_, F.col("rid") == F.col("a")).join(partner, "b").filter("vid <> other").select("vid", "other").distinct().groupBy("vid").agg(F.count("*").alias("n"))
    degree = single.union(spread)
    # a vec_id with several vectors joins their groups
    bound = many.join(many.groupBy("vid").agg(F.min("rid").alias("b")), "vid").select(F.col("rid").alias("a"), "b")
    tied = tallied.filter(F.col("kind") == TIE).select("a", "b")
    comp = C.components(spark, ties.union(known).union(tied).union(bound), scratch)
    label = scratch.keep(members.join(comp, F.col("rid") == F.col("node"), "left").select("vid", F.coalesce("component", "rid").alias("label")).distinct())
    named = label.join(label.groupBy("label").agg(F.min("vid").alias("component")), "label").select(F.col("vid").alias("node"), "component")
    out = rows.select("vec_id").join(degree, F.col("vec_id") == F.col("vid"), "left").join(named, F.col("vec_id") == F.col("node"), "left")
    return out.select("vec_id", F.coalesce("n", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component", "vec_id").alias("component_id"), (F.coalesce("component", "vec_id") == F.col("vec_id")).alias("kept"))


def query(spark, sf_dir):
    return near_vectors(C.table(spark, sf_dir, "embeddings"))
