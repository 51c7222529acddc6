"""Near-duplicate vectors by range search over a robust-pruned flat graph.

Equal vectors are collapsed first, so a group of copies is one node whatever its size. Nodes are dealt to every
centroid (fitted on a bounded sample) whose cosine is within ``overlap`` of their best: overlapping shards. A shard of more than ``slice_rows`` nodes is divided into
slices. Each slice builds a graph: the nearest and some random nodes of its slice are candidates, robust pruning keeps those that no
kept one makes superfluous, and edges are made mutual. The adjacency lists a node has in its shards are united. A search
begins at the medoid of a slice, walks greedily towards the query with a beam, and then expands every node in range until no
new one is met. Pairs found are verified by cosine in double precision. Slices of one shard search each other pairwise,
so a crowded shard loses no pair and no task holds more than two slices.

Links are not emitted as pairs: a task sums them per node and passes on a spanning forest. A pair met in several shards is
counted in the smallest shard both nodes share. Recall is audited by brute force for a sample of nodes; below ``least_recall``
the search is repeated with twice the overlap and beam, up to all shards.

Defined results: vectors that are null, zero or hold null or non-finite components, and rows with a null id, link with nothing
(component_id is their own id); repeated rows are vectors each on its own; vectors of unequal length are filled with zeros; ties
do not arise; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from parcelwatt.llm.common import components, counted_broadcast, cut
from parcelwatt.llm.vectors import hash_sample, matrix, usable, widened


def unit(m: np.ndarray) -> np.ndarray:
    norm = np.linalg.norm(m, axis=1, keepdims=True)
    return m / np.where(norm > 0, norm, 1)


def centroids(sample: np.ndarray, count: int, rounds: int = 6) -> np.ndarray:
    """Unit centres of ``count`` groups of the sample by cosine."""
    sample = unit(sample)
    centres = sample[np.random.default_rng(5).permutation(len(sample))[:count]]
    for _ in range(rounds):
        near = np.concatenate([(sample[i:i + 4096] @ centres.T).argmax(axis=1) for i in range(0, len(sample), 4096)])
        sums = np.zeros_like(centres)
        np.add.at(sums, near, sample)
        full = np.bincount(near, minlength=len(centres)) > 0
        centres = np.where(full[:, None], unit(sums), centres)
    return centres


def prune(x: np.ndarray, candidates: np.ndarray, degree: int, alpha: float, nodes: np.ndarray | None = None) -> np.ndarray:
    """Robust pruning for all nodes together: (nodes, degree) neighbours, -1 for none. ``candidates`` (nodes, c), -1 for none; ``nodes`` are their rows of ``x`` (all in order)."""
    nodes = np.arange(len(candidates)) if nodes is None else nodes
    out = np.full((len(candidates), degree), -1, np.int32)
    for at in range(0, len(candidates), 256):
        cand = candidates[at:at + 256].copy()
        own = nodes[at:at + 256]
        cand[cand == own[:, None]] = -1
        cand.sort(axis=1)
        cand[:, 1:][cand[:, 1:] == cand[:, :-1]] = -1
        near = x[cand]
        far = 1 - np.einsum("nd,ncd->nc", x[own], near)
        far[cand < 0] = np.inf
        between = 1 - near @ near.transpose(0, 2, 1)
        rows = np.arange(len(cand))
        for k in range(degree):
            best = far.argmin(axis=1)
            open_ = far[rows, best] < np.inf
            if not open_.any():
                break
            out[at + rows[open_], k] = cand[rows[open_], best[open_]]
            # a candidate much nearer to the chosen one than to the node is reached through it
            far[alpha * between[rows, best] <= far] = np.inf
            far[rows, best] = np.inf
    return out


def build(x: np.ndarray, degree: int = 24, near: int = 48, random: int = 16, alpha: float = 1.2) -> list[np.ndarray]:
    """Neighbours of each row of the unit vectors ``x``."""
    n = len(x)
    if n < 2:
        return [np.zeros(0, np.int32)] * n
    x = x.astype(np.float32)
    near = min(near, n - 1)
    cand = np.full((n, near + 1 + random), -1, np.int32)
    for at in range(0, n, 512):
        sims = x[at:at + 512] @ x.T
        cand[at:at + 512, :near + 1] = np.argpartition(-sims, near, axis=1)[:, :near + 1]
    cand[:, near + 1:] = np.random.default_rng(n).integers(0, n, (n, random))
    first = prune(x, cand, degree, alpha)
    source, target = np.repeat(np.arange(n), degree), first.ravel()
    source, target = source[target >= 0], target[target >= 0]
    both = np.unique(np.concatenate([np.stack([source, target], 1), np.stack([target, source], 1)]), axis=0)
    ends = np.searchsorted(both[:, 0], np.arange(n + 1))
    lists = [both[ends[i]:ends[i + 1], 1].astype(np.int32) for i in range(n)]
    # nodes that many point to are pruned again; what they give up hangs on the nearest neighbour they keep, so all stay in reach
    crowded = [i for i in range(n) if len(lists[i]) > 2 * degree]
    width, extra = max(map(len, lists)), []
    for at in range(0, len(crowded), 64):
        part = crowded[at:at + 64]
        wide = np.full((len(part), width), -1, np.int32)
        for row, i in enumerate(part):
            wide[row, :len(lists[i])] = lists[i]
        for i, kept in zip(part, prune(x, wide, 2 * degree, alpha, np.array(part))):
            kept = kept[kept >= 0]
            given = np.setdiff1d(lists[i], kept)
            host = kept[(x[given] @ x[kept].T).argmax(axis=1)]
            extra += [np.stack([host, given], 1), np.stack([given, host], 1)]
            lists[i] = kept
    if extra:
        both = np.unique(np.concatenate(extra), axis=0)
        ends = np.searchsorted(both[:, 0], np.arange(n + 1))
        lists = [np.union1d(lists[i], both[ends[i]:ends[i + 1], 1]) if ends[i] < ends[i + 1] else lists[i] for i in range(n)]
    return lists


def range_search(x: np.ndarray, adjacency: np.ndarray, start: int, queries: np.ndarray, radius: float, beam: int = 32, batch: int = 256, slack: float = 0.03):
    """Yields (query row, node row) arrays of nodes within cosine ``radius`` met by the search. ``adjacency`` (nodes, d), -1 for none; nodes up to ``slack`` outside are ways through."""
    beam = min(beam, len(x))
    for at in range(0, len(queries), batch):
        q = queries[at:at + batch]
        rows = np.arange(len(q))
        met = np.zeros((len(q), len(x) + 1), bool)
        met[:, -1] = True  # where -1 points
        met[:, start] = True
        ids, sims = np.full((len(q), beam), -1, np.int64), np.full((len(q), beam), -np.inf, np.float32)
        ids[:, 0], sims[:, 0] = start, q @ x[start]
        walked = np.zeros((len(q), beam), bool)
        found = [(rows, ids[:, 0].copy(), sims[:, 0].copy())]
        while True:
            waiting = np.where(walked | (ids < 0), -np.inf, sims)
            slot = waiting.argmax(axis=1)
            live = np.flatnonzero(waiting[rows, slot] > -np.inf)
            if not len(live):
                break
            walked[live, slot[live]] = True
            near = adjacency[ids[live, slot[live]]]
            fresh = ~met[live[:, None], near]
            new_sims = np.where(fresh, (x[near] @ q[live][:, :, None])[:, :, 0], -np.inf).astype(np.float32)
            met[np.broadcast_to(live[:, None], near.shape)[fresh], near[fresh]] = True
            r, c = np.nonzero(fresh & (new_sims >= radius - slack))
            found.append((live[r], near[r, c], new_sims[r, c]))
            all_ids, all_sims = np.concatenate([ids[live], np.where(fresh, near, -1)], 1), np.concatenate([sims[live], new_sims], 1)
            all_walked = np.concatenate([walked[live], np.zeros(near.shape, bool)], 1)
            top = np.argpartition(-all_sims, beam - 1, axis=1)[:, :beam]
            ids[live], sims[live], walked[live] = (np.take_along_axis(a, top, 1) for a in (all_ids, all_sims, all_walked))
        row, node, sim = (np.concatenate(v) for v in zip(*found))
        keep = sim >= radius - slack
        row, node, sim = row[keep], node[keep], sim[keep]
        while len(row):
            yield at + row[sim >= radius], node[sim >= radius]
            more_r, more_n, more_s = [], [], []
            for i in range(0, len(row), 2048):
                r, near = row[i:i + 2048], adjacency[node[i:i + 2048]]
                pair_r, pair_n = np.broadcast_to(r[:, None], near.shape).ravel(), near.ravel()
                fresh = ~met[pair_r, pair_n]
                key = np.unique(pair_r[fresh] * np.int64(len(x)) + pair_n[fresh])
                r, n = key // len(x), key % len(x)
                met[r, n] = True
                new_sims = np.einsum("nd,nd->n", q[r], x[n])
                passable = new_sims >= radius - slack
                more_r.append(r[passable])
                more_n.append(n[passable])
                more_s.append(new_sims[passable])
            row, node, sim = np.concatenate(more_r), np.concatenate(more_n), np.concatenate(more_s)


def forest(link: np.ndarray) -> list[tuple[int, int]]:
    """Edges of a spanning forest of a symmetric link matrix."""
    edges, seen = [], ~link.any(axis=1)
    for root in range(len(link)):
        if seen[root]:
            continue
        seen[root] = True
        frontier = np.array([root])
        while len(frontier):
            reached = np.flatnonzero(link[frontier].any(axis=0) & ~seen)
            seen[reached] = True
            edges += [(root, int(v)) for v in reached]
            frontier = reached
    return edges


def cell_links(cell: pd.DataFrame, threshold: float, beam: int) -> pd.DataFrame:
    """Link sums and a spanning forest of one cell: a slice searched by its own nodes or by those of a later slice."""
    index = (cell["part"] == 0).to_numpy()
    own = cell["cell_a"].iat[0] == cell["cell_b"].iat[0]
    every, ids, sizes = matrix(cell["v"]), cell["cid"].to_numpy(np.int64), cell["n"].to_numpy(np.int64)
    shards = np.full((len(cell), max(map(len, cell["shards"]))), -1, np.int64)
    for i, own_shards in enumerate(cell["shards"]):
        shards[i, :len(own_shards)] = own_shards
    inside, asking = np.flatnonzero(index), np.flatnonzero(index if own else ~index)
    if not len(inside) or not len(asking):
        return pd.DataFrame({"a": [], "b": [], "links": []})
    exact = unit(every)
    x = exact[inside].astype(np.float32)
    place = pd.Series(np.arange(len(inside)), index=ids[inside])
    lists = [place.reindex(np.asarray(near, np.int64)).dropna().to_numpy(np.int64) for near in cell["near"].to_numpy()[inside]]
    adjacency = np.full((len(inside), max(1, max(map(len, lists)))), -1, np.int64)
    for i, near in enumerate(lists):
        adjacency[i, :len(near)] = near
    start = int((x @ x.mean(axis=0)).argmax())
    link = np.zeros((len(asking), len(inside)), bool)
    shard = cell["shard"].iat[0]
    for q, n in range_search(x, adjacency, start, exact[asking].astype(np.float32), threshold - 1e-4, beam):
        a, b = asking[q], inside[n]
        for i in range(0, len(a), 16384):
            left, right = a[i:i + 16384], b[i:i + 16384]
            # the smallest shard both share counts the pair; verified in double precision
            common = (shards[left][:, :, None] == shards[right][:, None, :]).any(axis=2) & (shards[left] >= 0)
            owner = np.where(common, shards[left], np.iinfo(np.int64).max).min(axis=1)
            cosine = np.einsum("nd,nd->n", every[left], every[right]) / (np.linalg.norm(every[left], axis=1) * np.linalg.norm(every[right], axis=1))
            good = (left != right) & (owner == shard) & (cosine >= threshold)
            link[q[i:i + 16384][good], n[i:i + 16384][good]] = True
    if own:
        link |= link.T
        sums, edges = link @ sizes[inside], forest(link)
        nodes = ids[inside]
        counted = pd.DataFrame({"a": nodes, "b": nodes, "links": sums})
        joined = pd.DataFrame([(nodes[i], nodes[j], 0) for i, j in edges], columns=["a", "b", "links"])
    else:
        counted = pd.concat([pd.DataFrame({"a": ids[asking], "b": ids[asking], "links": link @ sizes[inside]}), pd.DataFrame({"a": ids[inside], "b": ids[inside], "links": link.T @ sizes[asking]})])
        size = len(asking) + len(inside)
        square = np.zeros((size, size), bool)
        square[:len(asking), len(asking):] = link
        square[len(asking):, :len(asking)] = link.T
        nodes = np.concatenate([ids[asking], ids[inside]])
        joined = pd.DataFrame([(nodes[i], nodes[j], 0) for i, j in forest(square)], columns=["a", "b", "links"])
    return pd.concat([counted[counted["links"] > 0], joined]).astype({"a": "int64", "b": "int64", "links": "int64"})


def _found(classes: DataFrame, centres: np.ndarray, threshold: float, overlap: float, beam: int, slice_rows: int) -> DataFrame:
    """(a, b, links): link sums of class a where a = b, else an edge of the spanning forests."""
    def deal(batches):
        for batch in batches:
            if len(batch):
                m = unit(matrix(batch["v"]))
                width = max(m.shape[1], centres.shape[1])
                sims = widened(m, width) @ widened(centres, width).T
                batch["shards"] = [np.flatnonzero(row) for row in sims >= sims.max(axis=1, keepdims=True) - overlap]
                yield batch

    dealt = cut(classes.mapInPandas(deal, "cid long, v array<double>, n long, shards array<long>"))
    placed = dealt.select("cid", "v", "n", "shards", F.explode("shards").alias("shard"))
    slices = counted_broadcast(cut(placed.groupBy("shard").count().select("shard", F.ceil(F.col("count") / slice_rows).alias("slices"))))
    placed = placed.join(slices, "shard").withColumn("slice", F.pmod(F.xxhash64("cid"), F.col("slices")).cast("int"))

    def grow(part: pd.DataFrame) -> pd.DataFrame:
        ids = part["cid"].to_numpy(np.int64)
        return pd.DataFrame({"cid": ids, "near": [ids[near] for near in build(unit(matrix(part["v"])))]})

    lists = placed.groupBy("shard", "slice").applyInPandas(grow, "cid long, near array<long>")
    united = lists.groupBy("cid").agg(F.array_distinct(F.flatten(F.collect_list("near"))).alias("near"))
    nodes = cut(placed.join(united, "cid"))
    common = ["shard", "cid", "v", "n", "shards", "near"]
    index = nodes.withColumn("other", F.explode(F.expr("sequence(slice, CAST(slices AS INT) - 1)"))).select(*common, F.col("slice").alias("cell_a"), F.col("other").alias("cell_b"), F.lit(0).alias("part"))
    asking = nodes.where("slice > 0").withColumn("other", F.explode(F.expr("sequence(0, slice - 1)"))).select(*common, F.col("other").alias("cell_a"), F.col("slice").alias("cell_b"), F.lit(1).alias("part"))
    return cut(index.unionByName(asking).groupBy("shard", "cell_a", "cell_b").applyInPandas(lambda cell: cell_links(cell, threshold, beam), "a long, b long, links long"))


def _audit(classes: DataFrame, counts: DataFrame, threshold: float, sample_rows: int) -> float:
    """Share of the true links of sampled classes that were found."""
    picked = classes.orderBy(F.xxhash64("cid", F.lit(1)), "cid").limit(sample_rows).select("cid", "v").collect()
    ids, probes = np.array([r[0] for r in picked], np.int64), unit(matrix(r[1] for r in picked))

    def brute(batches):
        for batch in batches:
            if len(batch):
                m = unit(matrix(batch["v"]))
                width = max(m.shape[1], probes.shape[1])
                hit = (widened(probes, width) @ widened(m, width).T >= threshold) & (ids[:, None] != batch["cid"].to_numpy()[None, :])
                yield pd.DataFrame({"cid": ids, "links": hit @ batch["n"].to_numpy(np.int64)})

    true = classes.mapInPandas(brute, "cid long, links long").groupBy("cid").agg(F.sum("links").alias("true"))
    both = true.join(counts.withColumnRenamed("links", "got"), "cid", "left").agg(F.sum("true"), F.sum(F.least("true", F.coalesce("got", F.lit(0))))).first()
    return 1.0 if not both[0] else float(both[1]) / float(both[0])


def near_duplicates(vectors: DataFrame, threshold: float = 0.95, key: str = "vec_id", vector: str = "embedding", shard_rows: int = 1000, slice_rows: int = 4000,
                    centroid_sample: int = 8000, most_centroids: int = 1024, overlap: float = 0.06, beam: int = 32, audit_rows: int = 500, least_recall: float = 0.97) -> DataFrame:
    """vec_id, n_links, component_id, kept, audited_recall for every row of ``vectors``."""
    good = usable(vector) & F.col(key).isNotNull() & F.coalesce(F.exists(vector, lambda x: x != 0), F.lit(False))
    rows = vectors.select(F.col(key).alias("vec_id"), F.when(good, F.col(vector).cast("array<double>")).alias("v"))
    classes = cut(rows.where("v IS NOT NULL").groupBy("v").agg(F.min("vec_id").alias("cid"), F.count(F.lit(1)).alias("n")).select("cid", "v", "n"))
    total = classes.count()
    if total:
        centres = centroids(hash_sample(classes, "cid", "v", centroid_sample), int(np.clip(-(-total // shard_rows), 1, most_centroids)))
        while True:
            found = _found(classes, centres, threshold, overlap, beam, slice_rows)
            counts = found.where("a = b").groupBy(F.col("a").alias("cid")).agg(F.sum("links").alias("links"))
            recall = _audit(classes, counts, threshold, audit_rows)
            if recall >= least_recall or overlap > 2 and beam >= 256:
                break
            overlap, beam = 2 * overlap, min(256, 2 * beam)
        grouped = components(found.where("a <> b")).withColumnRenamed("v", "cid")
        judged = classes.join(counts, "cid", "left").join(grouped, "cid", "left")
    else:
        recall = 1.0
        judged = classes.select("*", F.lit(None).cast("long").alias("links"), F.lit(None).cast("long").alias("root"))
    facts = judged.select(F.xxhash64("v").alias("h"), F.col("v").alias("same"), (F.col("n") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("root", "cid").alias("root"))
    # rows outside the search keep private hashes, so that they do not meet in one task
    hashed = rows.withColumn("own", F.coalesce(F.when(F.col("v").isNotNull(), F.xxhash64("v")), F.xxhash64("vec_id")))
    return hashed.join(facts, (F.col("own") == F.col("h")) & (F.col("v") == F.col("same")), "left").select(
        "vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("root", "vec_id").alias("component_id")).withColumns(
        {"kept": F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)), "audited_recall": F.lit(recall)})
