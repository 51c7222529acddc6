"""Approximate nearest neighbours by cosine: a hierarchical navigable small-world graph for each shard.

Equal vectors are one node with its k + 1 smallest ids, all that k answers besides the query can need, so a group of copies
is one node whatever its size. Nodes go to the centroid of greatest cosine (fitted on a bounded sample), and a cell of more than ``shard_rows``
nodes is divided into slices: a shard is a slice of a cell. Each shard builds one graph, stored as one row of flat arrays: vectors,
member ids, and for each level its nodes and their neighbours. Nodes get their level from a geometric law; they
enter in batches, from the top level down: a beam search on each level gives candidates, together with the rest of the batch; of
these a node links to those that no nearer linked one covers, then fills up with the nearest; links are mutual, and
a full list is chosen anew by the same rule.

A query goes to the shards of its nearest cells, walks down the levels, and takes the best of a beam on the lowest one; cosines are computed
anew in double precision from the original vectors. Answers of shards are merged by a window that keeps k rows a query.
Recall is measured by brute force for a sample of queries against all nodes. While it is below ``target``, twice as many
cells are searched (only the new ones), and when all are, the search is repeated with twice the beam, at last as wide as a shard, which
is exact.

Memory: a task holds one shard and a block of its queries. The driver holds centroids, the number of nodes of cells, and the
sampled queries.

Defined results: vectors that are null, zero or hold null or non-finite components, and rows with a null id, take no part; shorter
vectors count as filled with zeros; equal rows (id and vector) count once; a query id with several vectors is answered
once, for its smallest vector, and none of its rows is an answer; an id with several vectors may be an answer once for each; ties go to the
smaller id; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from parcelwatt.llm.common import cut
from parcelwatt.llm.vectors import matrix, usable, widened

LINKS = 16  # of a node on an upper level; twice as many on the lowest
BUILD_BEAM = 100
UPPER_BEAM = 16
CENTROIDS = 1024
SAMPLE_ROWS = 8000
PROBES = 48  # queries whose answers are audited
INDEX = "cell int, slice int, width int, vectors array<double>, members array<long>, ends array<int>, heads array<int>, nodes array<int>, links array<int>"
FOUND = "query_id long, vec_id long, score double"


def unit(m: np.ndarray) -> np.ndarray:
    norm = np.linalg.norm(m, axis=1, keepdims=True)
    return (m / np.where(norm > 0, norm, 1)).astype(np.float32)


def beam_search(x: np.ndarray, links: np.ndarray, place: np.ndarray, queries: np.ndarray, starts: np.ndarray, beam: int, wide: int = 3) -> tuple[np.ndarray, np.ndarray]:
    """Rows of ``x`` and cosines of the best ``beam`` nodes met for each query, best first; -1 where there are fewer.

    ``links[place[node]]`` are the neighbours of a node on this level, -1 for none. The ``wide`` best open nodes are opened at once.
    """
    count, beam = len(queries), max(1, min(beam, len(x)))
    seen = np.zeros((count, len(x) + 1), bool)
    seen[:, -1] = True  # where -1 points
    ids, sims = np.full((count, beam), -1, np.int64), np.full((count, beam), -np.inf, np.float32)
    opened = np.zeros((count, beam), bool)
    live, near = np.arange(count), starts
    while len(live):
        # a node met twice in one step counts once
        near = np.sort(near, axis=1)
        near[:, 1:][near[:, 1:] == near[:, :-1]] = -1
        fresh = ~seen[live[:, None], near]
        near = np.where(fresh, near, -1)
        seen[live[:, None], near] = True
        new = np.where(fresh, np.matmul(x[near], queries[live][:, :, None])[:, :, 0], -np.inf)
        all_ids, all_sims = np.concatenate([ids[live], near], 1), np.concatenate([sims[live], new], 1)
        all_open = np.concatenate([opened[live], np.zeros(near.shape, bool)], 1)
        best = np.argpartition(-all_sims, beam - 1, axis=1)[:, :beam] if all_sims.shape[1] > beam else np.arange(all_sims.shape[1])[None, :].repeat(len(live), 0)
        at = np.arange(len(live))[:, None]
        ids[live], sims[live], opened[live] = all_ids[at, best], all_sims[at, best], all_open[at, best]
        waiting = np.where(opened[live] | (ids[live] < 0), -np.inf, sims[live])
        pick = min(wide, beam)
        slots = np.argpartition(-waiting, pick - 1, axis=1)[:, :pick]
        use = waiting[at, slots] > -np.inf
        opened[live[:, None], slots] |= use
        nodes = np.where(use, ids[live][at, slots], -1)
        go = use.any(axis=1)
        live, nodes, use = live[go], nodes[go], use[go]
        near = np.where(use[:, :, None], links[place[nodes]], -1).reshape(len(live), use.shape[1] * links.shape[1])
    order = np.argsort(-sims, axis=1, kind="stable")
    return np.take_along_axis(ids, order, 1), np.take_along_axis(sims, order, 1)


def chosen(x: np.ndarray, own: np.ndarray, candidates: np.ndarray, keep: int) -> np.ndarray:
    """(nodes, keep) links of the nodes ``own`` among their candidates (-1 for none): the nearest first, leaving out those nearer to a link
    than to the node, then the nearest of those left out."""
    out = np.full((len(own), keep), -1, np.int64)
    for at in range(0, len(own), 512):
        cand = np.sort(candidates[at:at + 512], axis=1)
        cand[:, 1:][cand[:, 1:] == cand[:, :-1]] = -1
        cand[cand == own[at:at + 512, None]] = -1
        near = x[cand]
        sims = np.matmul(near, x[own[at:at + 512]][:, :, None])[:, :, 0]
        sims[cand < 0] = -np.inf
        between = np.matmul(near, near.transpose(0, 2, 1))
        rows, apart, free = np.arange(len(cand)), sims.copy(), sims.copy()
        for k in range(keep):
            best = apart.argmax(axis=1)
            left = apart[rows, best] == -np.inf
            if left.any():  # only covered candidates are left there
                best = np.where(left, free.argmax(axis=1), best)
            good = free[rows, best] > -np.inf
            if not good.any():
                break
            out[at + rows[good], k] = cand[rows[good], best[good]]
            apart[between[rows, best] > sims] = -np.inf
            apart[rows, best] = -np.inf
            free[rows, best] = -np.inf
    return out


class Graph:
    """Levels of links over the unit rows ``x``; ``nodes[l]`` are the rows on level l, ``links[l]`` their neighbours."""

    def __init__(self, x: np.ndarray, nodes: list[np.ndarray], links: list[np.ndarray]):
        self.x, self.nodes, self.links = x, nodes, links
        self.place = [self._places(n) for n in nodes]

    def _places(self, nodes: np.ndarray) -> np.ndarray:
        place = np.zeros(len(self.x) + 1, np.int64)
        place[nodes] = np.arange(len(nodes))
        return place

    @classmethod
    def build(cls, x: np.ndarray, seed: int = 7, batch: int = 256) -> Graph:
        rng, n = np.random.default_rng(seed), len(x)
        level = np.minimum((-np.log(1 - rng.random(n)) / np.log(LINKS)).astype(int), 12)
        order = rng.permutation(n)
        top = int(level.max(initial=0))
        graph = cls(x, [np.flatnonzero(level >= l) for l in range(top + 1)], [])
        graph.links = [np.full((len(graph.nodes[l]), LINKS if l else 2 * LINKS), -1, np.int64) for l in range(top + 1)]
        begun, at = -1, 0  # highest level that holds a node so far
        entry = -1
        while at < n:
            new = order[at:at + min(batch, max(32, at))]
            at += len(new)
            start = np.full((len(new), 1), entry, np.int64)
            for l in range(top, -1, -1):
                joins = np.flatnonzero(level[new] >= l)
                if l <= begun:
                    met, _ = beam_search(x, graph.links[l], graph.place[l], x[new], start, BUILD_BEAM if l == 0 else UPPER_BEAM * 2)
                    start = met[:, :4]
                else:
                    met = np.full((len(new), 0), -1, np.int64)
                if len(joins):
                    own = new[joins]
                    among = np.where(np.eye(len(own), dtype=bool), -np.inf, x[own] @ x[own].T)
                    closest = np.argsort(-among, axis=1)[:, :BUILD_BEAM // 2]
                    candidates = np.concatenate([met[joins], own[closest]], 1)
                    graph._connect(l, own, chosen(x, own, candidates, LINKS))
            highest = int(level[new].max())
            if highest > begun:
                begun, entry = highest, int(new[level[new].argmax()])
        return graph

    def _connect(self, l: int, own: np.ndarray, picked: np.ndarray) -> None:
        links, place = self.links[l], self.place[l]
        width = links.shape[1]
        links[place[own], :LINKS] = picked
        source, target = np.repeat(own, picked.shape[1]), picked.ravel()
        source, target = source[target >= 0], target[target >= 0]
        by = np.argsort(target, kind="stable")
        source, target = source[by], target[by]
        ends, first, counts = np.unique(target, return_index=True, return_counts=True)
        size = np.argsort(counts, kind="stable")
        for part in np.array_split(size, -(-len(size) // 2048) or 1):
            if not len(part):
                continue
            more = int(counts[part].max())
            spot = first[part][:, None] + np.arange(more)[None, :]
            held = np.arange(more)[None, :] < counts[part][:, None]
            fresh = np.where(held, source[np.minimum(spot, len(source) - 1)], -1)
            cand = np.concatenate([links[place[ends[part]]], fresh], 1)
            # mutual choices may be there already
            cand = np.sort(cand, axis=1)
            cand[:, 1:][cand[:, 1:] == cand[:, :-1]] = -1
            cand = -np.sort(-cand, axis=1)
            full = (cand >= 0).sum(axis=1) > width
            links[place[ends[part[~full]]]] = cand[~full][:, :width] if cand.shape[1] >= width else np.pad(cand[~full], ((0, 0), (0, width - cand.shape[1])), constant_values=-1)
            if full.any():
                links[place[ends[part[full]]]] = chosen(self.x, ends[part[full]], cand[full], width)

    def search(self, queries: np.ndarray, beam: int) -> np.ndarray:
        """Rows met by each query on the lowest level, best first, -1 where there are fewer."""
        start = np.full((len(queries), 1), self.nodes[-1][0] if len(self.x) else -1, np.int64)
        for l in range(len(self.nodes) - 1, 0, -1):
            start = beam_search(self.x, self.links[l], self.place[l], queries, start, UPPER_BEAM)[0][:, :4]
        return beam_search(self.x, self.links[0], self.place[0], queries, start, beam)[0]

    def flat(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        heads = np.array([len(n) for n in self.nodes], np.int32)
        return heads, np.concatenate(self.nodes).astype(np.int32), np.concatenate([k.ravel() for k in self.links]).astype(np.int32)

    @classmethod
    def of(cls, x: np.ndarray, heads: np.ndarray, nodes: np.ndarray, links: np.ndarray) -> Graph:
        widths = [2 * LINKS if l == 0 else LINKS for l in range(len(heads))]
        split = np.split(links.astype(np.int64), np.cumsum([h * w for h, w in zip(heads, widths)])[:-1])
        return cls(x, [n.astype(np.int64) for n in np.split(nodes, np.cumsum(heads)[:-1])], [k.reshape(-1, w) for k, w in zip(split, widths)])


def cosines(queries: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    """Cosine of each query with its own rows of vectors (queries, candidates, width), in double precision."""
    products = (vectors * queries[:, None, :]).sum(axis=2)
    return products / (np.sqrt((vectors ** 2).sum(axis=2)) * np.sqrt((queries ** 2).sum(axis=1))[:, None])


def best_members(query_ids: np.ndarray, queries: np.ndarray, vectors: np.ndarray, rows: np.ndarray, members: list[np.ndarray], k: int) -> pd.DataFrame:
    """The k best members of the nodes ``rows`` (queries, candidates; -1 for none) of each query but its own, by cosine and then id."""
    out = []
    for at in range(0, len(queries), 256):
        part = rows[at:at + 256]
        scores = np.where(part >= 0, cosines(queries[at:at + 256], vectors[part]), -np.inf)
        for own, nodes, score in zip(query_ids[at:at + 256], part, scores):
            order = np.lexsort((nodes, -score))
            order = order[score[order] > -np.inf]
            # nodes as good as the (k + 1)-th may hold smaller ids
            enough = score[order] >= score[order[min(k, len(order) - 1)]] if len(order) else []
            order = order[enough]
            ids = [members[i] for i in nodes[order]]
            score = np.repeat(score[order], [len(m) for m in ids])
            ids = np.concatenate(ids) if len(ids) else np.zeros(0, np.int64)
            score, ids = score[ids != own], ids[ids != own]
            best = np.lexsort((ids, -score))[:k]
            out.append(pd.DataFrame({"query_id": own, "vec_id": ids[best], "score": score[best]}))
    return pd.concat(out) if out else pd.DataFrame({"query_id": [], "vec_id": [], "score": []})


def classes_of(vectors: DataFrame, queries: Column, key: str, vector: str, k: int) -> tuple[DataFrame, DataFrame]:
    """(v, members), a distinct vector with its k + 1 smallest ids; and the distinct rows (id, v, asks)."""
    v = F.col(vector).cast("array<double>")
    rows = vectors.where(usable(vector) & F.col(key).isNotNull() & F.exists(vector, lambda x: x != 0)).select(F.col(key).cast("long").alias("id"), v.alias("v"), F.coalesce(queries, F.lit(False)).alias("asks"))
    width = rows.agg(F.max(F.size("v"))).first()[0] or 0
    rows = rows.withColumn("v", F.concat("v", F.array_repeat(F.lit(0.0), F.lit(width) - F.size("v"))))
    rows = cut(rows.groupBy("id", "v").agg(F.max("asks").alias("asks")))
    smallest = Window.partitionBy("v").orderBy("id")
    ids = rows.select("id", "v").withColumn("at", F.row_number().over(smallest)).where(F.col("at") <= k + 1)
    return cut(ids.groupBy("v").agg(F.sort_array(F.collect_list("id")).alias("members"))), rows


def centroids(classes: DataFrame, nodes: int, count: int, rounds: int = 8) -> np.ndarray:
    """Unit centres of ``count`` cells from about ``SAMPLE_ROWS`` nodes, those below a hash threshold set from their number."""
    share = F.pmod(F.xxhash64("v"), F.lit(1 << 40)) < int((1 << 40) * min(1.0, SAMPLE_ROWS / nodes))
    sample = unit(matrix(r["v"] for r in classes.where(share).select("v").orderBy("v").toLocalIterator()))
    centres = sample[np.random.default_rng(11).permutation(len(sample))[:count]]
    for _ in range(rounds):
        near = (sample @ centres.T).argmax(axis=1)
        sums = np.zeros_like(centres)
        np.add.at(sums, near, sample)
        filled = np.bincount(near, minlength=len(centres)) > 0
        centres = np.where(filled[:, None], unit(sums), centres)
    return centres


def ranked_cells(vectors, centres: np.ndarray, low: int, high: int) -> list[np.ndarray]:
    """Cells of rank ``low`` to ``high`` by nearness, for each vector."""
    vectors = list(vectors)
    if not vectors:
        return []
    return list(np.argsort(-(unit(matrix(vectors)) @ centres.T), axis=1, kind="stable")[:, low:high].astype(np.int32))


def index(classes: DataFrame, centres: np.ndarray, shard_rows: int) -> tuple[DataFrame, DataFrame]:
    """The graphs, a row a shard, and (cell, slices)."""
    def deal(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            batch["cell"] = np.array([c[0] for c in ranked_cells(batch["v"], centres, 0, 1)], np.int32)
            yield batch

    dealt = cut(classes.mapInPandas(deal, "v array<double>, members array<long>, cell int"))
    sizes = cut(dealt.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / shard_rows).cast("int").alias("slices")))
    sliced = dealt.join(F.broadcast(sizes), "cell").withColumn("slice", F.pmod(F.xxhash64("v"), F.col("slices")).cast("int"))

    def build(shard: pd.DataFrame) -> pd.DataFrame:
        shard = shard.sort_values("members", key=lambda s: s.str[0], kind="stable")
        whole = matrix(shard["v"])
        heads, nodes, links = Graph.build(unit(whole)).flat()
        ends = np.cumsum([len(m) for m in shard["members"]]).astype(np.int32)
        return pd.DataFrame({"cell": shard["cell"].iloc[:1], "slice": shard["slice"].iloc[0], "width": whole.shape[1], "vectors": [whole.ravel()],
                             "members": [np.concatenate(list(shard["members"]))], "ends": [ends], "heads": [heads], "nodes": [nodes], "links": [links]})

    return cut(sliced.groupBy("cell", "slice").applyInPandas(build, INDEX)), sizes


def answers(graphs: DataFrame, sizes: DataFrame, asking: DataFrame, centres: np.ndarray, low: int, high: int, beam: int, k: int, block_rows: int = 4096) -> DataFrame:
    """query_id, vec_id, score found in the shards of the cells of rank ``low`` to ``high`` of each query."""
    def route(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            batch["cells"] = ranked_cells(batch["v"], centres, low, high)
            yield batch

    routed = asking.mapInPandas(route, "id long, v array<double>, cells array<int>").select("id", "v", F.explode("cells").alias("cell"))
    sent = routed.join(F.broadcast(sizes), "cell").select("id", "v", "cell", F.explode(F.sequence(F.lit(0), F.col("slices") - 1)).alias("slice"))
    # a cell that many queries ask is searched in blocks of them
    blocks = cut(routed.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / block_rows).cast("int").alias("blocks")))
    sent = sent.join(F.broadcast(blocks), "cell").withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int")).drop("blocks")
    held = graphs.join(F.broadcast(blocks), "cell").withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).drop("blocks")

    def task(queries: pd.DataFrame, shard: pd.DataFrame) -> pd.DataFrame:
        if not len(queries) or not len(shard):
            return pd.DataFrame({"query_id": [], "vec_id": [], "score": []})
        row = shard.iloc[0]
        vectors = np.asarray(row["vectors"], float).reshape(-1, int(row["width"]))
        graph = Graph.of(unit(vectors), *(np.asarray(row[c]) for c in ("heads", "nodes", "links")))
        members = np.split(np.asarray(row["members"], np.int64), np.asarray(row["ends"])[:-1])
        asked = widened(matrix(queries["v"]), vectors.shape[1])
        rows = np.concatenate([graph.search(unit(asked[at:at + 256]), beam) for at in range(0, len(asked), 256)])
        return best_members(queries["id"].to_numpy(np.int64), asked, vectors, rows, members, k)

    by = ["cell", "slice", "block"]
    return sent.groupBy(*by).cogroup(held.groupBy(*by)).applyInPandas(task, FOUND)


def best(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def least_scores(classes: DataFrame, probes: list, k: int) -> dict[int, np.ndarray]:
    """True k best scores of each probe (id, v), by brute force over all nodes."""
    names = np.array([p["id"] for p in probes], np.int64)
    asked = matrix(p["v"] for p in probes)

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                vectors = matrix(batch["v"])
                near = unit(asked) @ unit(vectors).T
                rows = np.argsort(-near, axis=1, kind="stable")[:, :k + 8]
                yield best_members(names, asked, vectors, rows, [np.asarray(m, np.int64) for m in batch["members"]], k)

    true = best(classes.mapInPandas(scan, FOUND), k).select("query_id", "score").collect()  # k rows a probe
    return {n: np.sort([r["score"] for r in true if r["query_id"] == n])[::-1] for n in names.tolist()}


def recall(found: DataFrame, true: dict[int, np.ndarray]) -> float | None:
    """Share of the true answers found, an answer as near as the last true one being as good; None if there are none."""
    rows = found.where(F.col("query_id").isin(list(true))).select("query_id", "score").collect()
    total = sum(len(s) for s in true.values())
    hits = sum(min(len(s), sum(r["query_id"] == q and r["score"] >= s[-1] - 1e-12 for r in rows)) for q, s in true.items() if len(s))
    return hits / total if total else None


def search(vectors: DataFrame, queries: Column, k: int = 5, key: str = "vec_id", vector: str = "embedding", beam: int = 96, cells: int = 8, target: float = 0.95, shard_rows: int = 8192) -> DataFrame:
    """query_id, rank, vec_id, score, audited_recall: the k nearest found for each row where ``queries`` holds."""
    classes, rows = classes_of(vectors, queries, key, vector, k)
    asking = cut(rows.where("asks").groupBy("id").agg(F.min("v").alias("v")))
    nodes = classes.count()
    if not nodes or asking.isEmpty():
        return rows.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double, audited_recall double")
    centres = centroids(classes, nodes, max(1, min(CENTROIDS, nodes // shard_rows)))
    graphs, sizes = index(classes, centres, shard_rows)
    share = PROBES / asking.count()
    probes = asking.where(F.pmod(F.xxhash64("id"), F.lit(1 << 40)) < int((1 << 40) * min(1.0, share))).collect() or asking.limit(1).collect()
    true = least_scores(classes, probes, k)
    most = sizes.count()
    at = min(cells, len(centres))
    found = cut(best(answers(graphs, sizes, asking, centres, 0, at, beam, k), k).drop("rank"))
    measured = recall(found, true)
    while measured is not None and measured < target and (at < most or beam < shard_rows * 2):
        if at < len(centres):
            more = answers(graphs, sizes, asking, centres, at, 2 * at, beam, k)
            at = min(2 * at, len(centres))
            found = cut(best(found.unionByName(more), k).drop("rank"))
        else:
            beam *= 2
            found = cut(best(answers(graphs, sizes, asking, centres, 0, at, beam, k), k).drop("rank"))
        measured = recall(found, true)
    return best(found, k).select("query_id", "rank", "vec_id", "score", F.lit(measured).cast("double").alias("audited_recall"))
