"""Approximate nearest neighbours: hierarchical k-means tree, best-bin-first search, calibrated recall.

The tree is fitted on a bounded sample (``fit_rows`` vectors by a hash of the id); every vector of the table is
then put into its leaf.  A leaf that holds more than ``page`` vectors of the table gets a tree of its own, fitted by
its own task on a bounded sample of that leaf, so that leaves keep their size while the table grows (to about
``fit_rows * page / leaf**2`` pages of vectors).

A query goes down the tree with a priority queue of branches, nearest centre first, and visits leaves in that order;
in a leaf with a tree of its own it does the same again.  How many leaves it visits is calibrated on ``calibration``
vectors outside the sample: their true neighbours among all vectors are found in blocks, and the visits are widened
until the share of those in visited leaves reaches ``recall``.  The visited leaves hold k vectors besides the query's
own at least, if there are as many.

Neighbouring leaves make a block of up to ``page`` vectors, and a leaf that can't be split (copies of one vector) is
spread over several.  Blocks meet the queries that visit one of their leaves; each returns its own nearest k of the
visited leaves, and those are merged.

Definitions for unusual input: vectors that are null, zero, or hold null or non-finite components, and vectors
whose length differs from most (the most frequent, the longer on ties), take no part, neither as queries nor
as candidates; rows with a null vec_id neither; of rows that repeat a vec_id the
lexicographically least vector counts; with fewer candidates than k all are returned; an empty table gives an
empty result; other columns play no part.
"""

from __future__ import annotations

import heapq
import pickle
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from .common import materialize, prepare


class Tree(NamedTuple):
    """Inner nodes hold their children's centres; a child is an inner node (>= 0) or leaf -1-n."""

    centres: list[np.ndarray]
    children: list[list[int]]
    leaves: int


def _kmeans(x: np.ndarray, k: int, rng: np.random.Generator, rounds: int = 12) -> tuple[np.ndarray, np.ndarray]:
    c = x[rng.choice(len(x), k, replace=False)].copy()
    for _ in range(rounds):
        near = ((c**2).sum(axis=1)[None] - 2 * x @ c.T).argmin(axis=1)
        for j in range(k):
            mine = x[near == j]
            if len(mine):
                c[j] = mine.mean(axis=0)
    return c, ((c**2).sum(axis=1)[None] - 2 * x @ c.T).argmin(axis=1)


def build_tree(x: np.ndarray, branch: int = 8, leaf: int = 64, seed: int = 7) -> Tree:
    """Split until nodes have at most ``leaf`` sample vectors or cannot be split."""
    rng = np.random.default_rng(seed)
    centres: list[np.ndarray] = []
    children: list[list[int]] = []
    leaves = 0
    x = np.unique(x, axis=0) if len(x) else x

    def grow(part: np.ndarray) -> int:
        nonlocal leaves
        if len(part) <= max(leaf, branch):
            leaves += 1
            return -leaves
        c, near = _kmeans(part, branch, rng)
        used = [j for j in range(branch) if (near == j).any()]
        if len(used) < 2:
            leaves += 1
            return -leaves
        me = len(centres)
        centres.append(c[used])
        children.append([])
        children[me] = [grow(part[near == j]) for j in used]
        return me

    if grow(x) < 0:  # a single leaf: a root above it
        centres.append(np.zeros((1, x.shape[1] if x.ndim == 2 else 1)))
        children.append([-1])
    return Tree(centres, children, leaves)


def leaf_of(tree: Tree, x: np.ndarray) -> np.ndarray:
    """The leaf that each vector goes to (nearest centre at every level)."""
    out = np.zeros(len(x), np.int64)
    todo = [(0, np.arange(len(x)))]
    while todo:
        node, rows = todo.pop()
        c = tree.centres[node]
        near = ((c**2).sum(axis=1)[None] - 2 * x[rows] @ c.T).argmin(axis=1)
        for j, child in enumerate(tree.children[node]):
            mine = rows[near == j]
            if child < 0:
                out[mine] = -1 - child
            elif len(mine):
                todo.append((child, mine))
    return out


def best_bins(tree: Tree, q: np.ndarray, most: int, sizes: dict[int, int] | None = None, least: int = 0) -> list[int]:
    """The first ``most`` leaves in order of a priority queue over branches (squared distance to the centre).

    With ``sizes`` it goes on until the leaves hold ``least`` vectors together, or there are no more.
    """
    out: list[int] = []
    queue, held = [(0.0, 0)], 0
    while queue and (len(out) < most or (sizes is not None and held < least)):
        _, node = heapq.heappop(queue)
        if node < 0:
            out.append(-1 - node)
            held += sizes.get(-1 - node, 0) if sizes is not None else 0
            continue
        d = ((tree.centres[node] - q) ** 2).sum(axis=1)
        for dist, child in zip(d.tolist(), tree.children[node], strict=True):
            heapq.heappush(queue, (dist, child))
    return out


def _top(
    ids: np.ndarray, x: np.ndarray, query_ids: np.ndarray, q: np.ndarray, k: int, open_: np.ndarray | None = None, step: int = 64
) -> pd.DataFrame:
    """Each query's nearest k of a page, by distance and then id; exact distances in double precision.

    ``open_`` (queries x vectors) says which vectors a query looks at.  Products of matrices find who may be
    among the nearest; only those get exact distances.  Of equal vectors the k+1 least ids are enough.
    """
    order = np.lexsort((ids, *x.T[::-1]))
    same = np.append(False, (x[order[1:]] == x[order[:-1]]).all(axis=1))
    run = np.flatnonzero(~same)
    nth = np.arange(len(order)) - run[np.cumsum(~same) - 1]
    keep = np.sort(order[nth <= k])
    ids, x = ids[keep], x[keep]
    norm = (x**2).sum(axis=1)
    out = []
    for lo in range(0, len(q), step):
        part, mine = q[lo : lo + step], query_ids[lo : lo + step]
        own = (part**2).sum(axis=1)
        near = norm[None] - 2 * part @ x.T + own[:, None]
        near[ids[None] == mine[:, None]] = np.inf
        if open_ is not None:
            near[~open_[lo : lo + step][:, keep]] = np.inf
        last = min(k, len(x)) - 1
        bound = np.partition(near, last, axis=1)[:, last] + 1e-9 * (own + norm.max()) + 1e-300
        row, col = np.nonzero((near <= bound[:, None]) & (near < np.inf))
        score = np.sqrt(((x[col] - part[row]) ** 2).sum(axis=1))
        by = np.lexsort((ids[col], score, row))
        row, col, score = row[by], col[by], score[by]
        first = np.searchsorted(row, np.arange(len(part)))
        ok = np.arange(len(row)) - first[row] < k
        out.append(pd.DataFrame({"query_id": mine[row[ok]], "vec_id": ids[col[ok]], "score": score[ok]}))
    return pd.concat(out) if out else pd.DataFrame({"query_id": [], "vec_id": [], "score": []})


_FOUND = "query_id long, vec_id long, score double"


def clean_vectors(vectors: DataFrame) -> DataFrame:
    """(vec_id, v) of the vectors that take part; v as array<double>."""
    v = F.col("embedding").cast("array<double>")
    ok = (
        F.col("vec_id").isNotNull()
        & v.isNotNull()
        & (F.size(v) > 0)
        & F.coalesce(F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))), F.lit(False))
        & F.coalesce(F.exists(v, lambda x: x != 0), F.lit(False))
    )
    rows = vectors.where(ok).groupBy(F.col("vec_id").cast("long").alias("vec_id")).agg(F.min(v).alias("v"))
    rows = materialize(rows, "vectors")
    width = rows.groupBy(F.size("v").alias("w")).count().orderBy(F.desc("count"), F.desc("w")).limit(1).collect()
    return rows.where(F.size("v") == width[0]["w"]) if width else rows


#: Numbers of leaves: a leaf of the first tree times 2**20, and a leaf of its own tree; of blocks: 2**24.
_SUB, _PART = 1 << 20, 1 << 24


class Index(NamedTuple):
    """What :func:`build_index` makes of a table of vectors."""

    placed: DataFrame  # vec_id, leaf (code), v, block
    tree: Tree
    visits: int  # leaves of the first tree that a query visits
    inner: int  # leaves that it visits of a leaf's own tree
    sizes: dict[int, int]  # vectors of each leaf of the first tree; at most fit_rows of them
    block: dict[int, int]  # their blocks, but for leaves with trees of their own
    trees: DataFrame | None  # leaf, tree, blocks: of the leaves with trees of their own


def _matrix(v) -> np.ndarray:
    return np.frombuffer(b"".join(v), np.float64).reshape(len(v), -1)


def _dealt(df: DataFrame, by: str, page: int, key: str = "top") -> DataFrame:
    """``df`` with ``deal``: rows of one ``key`` are dealt over as many numbers as hold ``page`` rows each."""
    n = df.groupBy(key).agg(F.ceil(F.count("*") / page).cast("int").alias("deals"))
    return df.join(n, key).withColumn("deal", F.pmod(F.xxhash64(by), F.col("deals")).cast("int"))


def _each(trees: DataFrame, dealt: DataFrame, run, schema: str, key: str = "top") -> DataFrame:
    """``run`` on the tree of each ``key`` with each deal of its rows."""
    deals = dealt.select(F.col(key).alias("__of"), F.col("deal").alias("__deal")).distinct()
    left = trees.join(deals, F.col(key) == F.col("__of")).groupBy("__of", "__deal")
    return left.cogroup(dealt.groupBy(key, "deal")).applyInPandas(run, schema)


def build_index(
    vectors: DataFrame,
    k: int = 10,
    fit_rows: int = 20_000,
    calibration: int = 256,
    recall: float = 0.96,
    branch: int = 64,
    leaf: int = 16,
    page: int = 4096,
) -> Index | None:
    """Tree, placed vectors and calibrated visits; None without a vector that takes part."""
    spark = prepare(vectors.sparkSession)
    rows = clean_vectors(vectors)
    sample = rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(fit_rows + calibration).toPandas()
    if not len(sample):
        return None
    x = np.asarray(sample["v"].tolist())
    # those that calibrate are none of those that the tree is fitted on
    fitted = max(len(x) - calibration, len(x) - len(x) // 8)
    tree = build_tree(x[:fitted], branch, leaf)
    shared = spark.sparkContext.broadcast(tree)  # at most fit_rows centres

    def place(batches):
        for b in batches:
            v = np.asarray(b["v"].tolist())
            yield pd.DataFrame({"vec_id": b["vec_id"], "top": leaf_of(shared.value, v), "v": [r.tobytes() for r in v]})

    placed = materialize(rows.mapInPandas(place, "vec_id long, top long, v binary"), "leaves")
    sizes = dict(placed.groupBy("top").agg(F.count("*").alias("n")).collect())  # the tree bounds the number of leaves
    full = sorted(t for t, n in sizes.items() if n > page)
    trees = None
    if full:
        overfull = spark.createDataFrame([(t,) for t in full], "top long")
        inside = placed.join(F.broadcast(overfull), "top")  # at most fit_rows leaves
        by_hash = Window.partitionBy("top").orderBy(F.xxhash64("vec_id"), "vec_id")
        some = inside.withColumn("nth", F.row_number().over(by_hash)).where(F.col("nth") <= page)

        def grow(part):
            part = part.sort_values("vec_id")
            mine = build_tree(_matrix(part["v"]), min(branch, 16), leaf)
            return pd.DataFrame({"top": part["top"].iloc[:1], "tree": [pickle.dumps(mine)]})

        trees = materialize(some.drop("nth").groupBy("top").applyInPandas(grow, "top long, tree binary"), "trees")

        def place_inside(tree, part):
            if not len(tree) or not len(part):
                return pd.DataFrame({"vec_id": [], "top": [], "sub": [], "v": []})
            sub = leaf_of(pickle.loads(tree["tree"].iloc[0]), _matrix(part["v"]))
            return pd.DataFrame({"vec_id": part["vec_id"], "top": part["top"], "sub": sub, "v": part["v"]})

        lower = _each(trees, _dealt(inside, "vec_id", page), place_inside, "vec_id long, top long, sub long, v binary")
        upper = placed.join(F.broadcast(overfull), "top", "left_anti").withColumn("sub", F.lit(0).cast("long"))
        placed = materialize(upper.unionByName(lower), "leaves")
    else:
        placed = placed.withColumn("sub", F.lit(0).cast("long"))
    block = shared_blocks({t: n for t, n in sizes.items() if n <= page}, page)
    # leaves with their blocks; those of a tree of its own fill blocks one after the other
    before = Window.partitionBy("top").orderBy("sub").rowsBetween(Window.unboundedPreceding, -1)
    known = spark.createDataFrame(list(block.items()), "top long, block long")
    if trees is None:
        placed = placed.join(F.broadcast(known), "top")
    else:
        subs = placed.join(F.broadcast(overfull), "top").groupBy("top", "sub").agg(F.count("*").alias("n"))
        subs = subs.select(
            "top", "sub", "n",
            (F.col("top") * _PART + F.floor(F.coalesce(F.sum("n").over(before), F.lit(0)) / page)).alias("block"),
            F.ceil(F.col("n") / page).alias("pages"),
        )
        subs = materialize(subs, "blocks")
        trees = materialize(
            trees.join(subs.groupBy("top").agg(F.collect_list(F.struct("sub", "n", "block", "pages")).alias("blocks")), "top"),
            "trees",
        )
        lower = placed.join(subs.drop("n"), ["top", "sub"]).withColumn(
            "block", F.col("block") + F.pmod(F.xxhash64("vec_id"), F.col("pages"))
        )
        placed = placed.join(F.broadcast(known), "top").unionByName(lower.drop("pages"))
    placed = placed.select("vec_id", (F.col("top") * _SUB + F.col("sub")).alias("leaf"), "v", "block")
    visits, inner = _calibrated(placed, tree, trees, sample["vec_id"].to_numpy()[fitted:], x[fitted:], k, recall)
    return Index(placed, tree, visits, inner, sizes, block, trees)


def _calibrated(
    placed: DataFrame, tree: Tree, trees: DataFrame | None, ids: np.ndarray, q: np.ndarray, k: int, recall: float
) -> tuple[int, int]:
    """Visits of the first tree and of a leaf's own that find ``recall`` of the true neighbours of ``q``."""
    if not len(ids):
        return tree.leaves, _SUB
    probe = placed.sparkSession.sparkContext.broadcast((ids, q))

    def exact(batches):
        ids, q = probe.value
        for b in batches:
            got = _top(b["vec_id"].to_numpy(), _matrix(b["v"]), ids, q, k)
            got["leaf"] = b.set_index("vec_id")["leaf"].loc[got["vec_id"]].to_numpy(np.int64)
            yield got

    nearest = Window.partitionBy("query_id").orderBy("score", "vec_id")
    truth = (
        placed.mapInPandas(exact, _FOUND + ", leaf long")
        .withColumn("rank", F.row_number().over(nearest))
        .where(F.col("rank") <= k)
        .select("query_id", "leaf")
    )
    found = truth.toPandas()
    target = recall if trees is None else recall**0.5
    top = pd.DataFrame({"query_id": found["query_id"], "leaf": found["leaf"] // _SUB})
    visits = calibrate(tree, dict(zip(ids.tolist(), q, strict=True)), top, target)
    if trees is None:
        return visits, 1

    def turns(trees, part):
        if not len(trees) or not len(part):
            return pd.DataFrame({"at": []})
        mine, (ids, q) = pickle.loads(trees["tree"].iloc[0]), probe.value
        where = {i: n for n, i in enumerate(ids.tolist())}
        orders = {i: {b: n for n, b in enumerate(best_bins(mine, q[where[i]], mine.leaves))} for i in set(part["query_id"].tolist())}
        return pd.DataFrame({"at": [orders[i][s] + 1 for i, s in zip(part["query_id"].tolist(), (part["leaf"] % _SUB).tolist(), strict=True)]})

    spark = placed.sparkSession
    if not len(found):
        return visits, _SUB
    pairs = spark.createDataFrame(found).select("query_id", F.col("leaf").cast("long").alias("leaf"))  # calibration * k rows
    pairs = pairs.withColumns({"top": F.floor(F.col("leaf") / _SUB), "deal": F.lit(0)})
    at = np.sort(_each(trees.select("top", "tree"), pairs, turns, "at long").toPandas()["at"].to_numpy())
    return visits, int(at[min(len(at) - 1, int(np.ceil(target * len(at))) - 1)]) if len(at) else _SUB


def route(index: Index, queries: DataFrame, k: int, page: int) -> DataFrame:
    """(query_id, block, leaves, q): the leaves of each block that a query visits, by priority queues."""
    spark = queries.sparkSession
    mine = spark.sparkContext.broadcast((index.tree, index.visits, index.sizes, index.block))

    def top(batches):
        tree, visits, sizes, block = mine.value
        for b in batches:
            out = {"query_id": [], "top": [], "block": [], "leaves": [], "q": []}
            for i, v in zip(b["vec_id"], b["v"], strict=True):
                ways: dict[tuple[int, int], list[int]] = {}
                for leaf in best_bins(tree, np.frombuffer(v, np.float64), visits, sizes, k + 1):
                    if leaf in sizes:
                        to = (-1, block[leaf]) if leaf in block else (leaf, -1)
                        ways.setdefault(to, []).append(leaf * _SUB)
                out["query_id"] += [i] * len(ways)
                out["top"] += [t for t, _ in ways]
                out["block"] += [n for _, n in ways]
                out["leaves"] += list(ways.values())
                out["q"] += [v] * len(ways)
            yield pd.DataFrame(out)

    schema = "query_id long, top long, block long, leaves array<long>, q binary"
    routed = materialize(queries.mapInPandas(top, schema), "routed")
    if index.trees is None:
        return routed.drop("top")
    inner = index.inner

    def inside(trees, part):
        out = {"query_id": [], "top": [], "block": [], "leaves": [], "q": []}
        if len(trees) and len(part):
            tree, t = pickle.loads(trees["tree"].iloc[0]), int(trees["top"].iloc[0])
            plan = {b["sub"]: b for b in trees["blocks"].iloc[0]}
            sizes = {s: b["n"] for s, b in plan.items()}
            for i, v in zip(part["query_id"], part["q"], strict=True):
                ways: dict[int, list[int]] = {}
                for sub in best_bins(tree, np.frombuffer(v, np.float64), inner, sizes, k + 1):
                    for n in range(plan[sub]["pages"] if sub in plan else 0):
                        ways.setdefault(plan[sub]["block"] + n, []).append(t * _SUB + sub)
                out["query_id"] += [i] * len(ways)
                out["top"] += [t] * len(ways)
                out["block"] += list(ways)
                out["leaves"] += list(ways.values())
                out["q"] += [v] * len(ways)
        return pd.DataFrame(out)

    lower = _each(index.trees, _dealt(routed.where("top >= 0"), "query_id", page), inside, schema)
    return materialize(routed.where("top < 0").unionByName(lower).drop("top"), "routed")


def search(vectors: DataFrame, is_query, k: int = 10, page: int = 4096, **how) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest found for every vector for which ``is_query`` holds."""
    index = build_index(vectors, k, page=page, **how)
    if index is None:
        return vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    return search_index(index, index.placed.where(is_query(F.col("vec_id"))), k, page)


def search_index(index: Index, queries: DataFrame, k: int = 10, page: int = 4096) -> DataFrame:
    """query_id, rank, vec_id, score of the k nearest found for each of ``queries`` (vec_id, v as in the index)."""
    routed = route(index, queries, k, page)
    # a block that very many queries visit meets them load by load
    loads = routed.groupBy("block").agg(F.ceil(F.count("*") / page).cast("int").alias("loads"))
    left = (
        index.placed.join(loads, "block")
        .withColumn("load", F.explode(F.sequence(F.lit(0), F.col("loads") - 1)))
        .drop("loads")
    )
    right = (
        routed.join(loads, "block")
        .withColumn("load", F.pmod(F.xxhash64("query_id"), F.col("loads")).cast("int"))
        .drop("loads")
    )

    def visit(vecs, asked):
        if not len(vecs) or not len(asked):
            return pd.DataFrame({"query_id": [], "vec_id": [], "score": []})
        here, leaf = np.unique(vecs["leaf"], return_inverse=True)
        goes = np.zeros((len(asked), len(here)), bool)
        row = np.repeat(np.arange(len(asked)), [len(x) for x in asked["leaves"]])
        to = np.concatenate([np.asarray(x) for x in asked["leaves"]])
        at = np.searchsorted(here, to)
        hit = (at < len(here)) & (here[np.minimum(at, len(here) - 1)] == to)
        goes[row[hit], at[hit]] = True
        return _top(vecs["vec_id"].to_numpy(), _matrix(vecs["v"]), asked["query_id"].to_numpy(), _matrix(asked["q"]), k, goes[:, leaf])

    on = ["block", "load"]
    found = left.groupBy(*on).cogroup(right.groupBy(*on)).applyInPandas(visit, _FOUND)
    nearest = Window.partitionBy("query_id").orderBy("score", "vec_id")
    return (
        found.withColumn("rank", F.row_number().over(nearest))
        .where(F.col("rank") <= k)
        .select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
    )


def scanned_share(index: Index, queries: DataFrame, k: int = 10, page: int = 4096) -> float:
    """Share of all vectors that lie in the leaves that a query visits, on average."""
    n = index.placed.groupBy("leaf").agg(F.count("*").alias("n"))
    asked, total = queries.count(), index.placed.count()
    seen = route(index, queries, k, page).select("query_id", F.explode("leaves").alias("leaf")).distinct().join(n, "leaf")
    return float(seen.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]) / max(1, asked * total)


def recall_of(found: DataFrame, vectors: DataFrame, is_query, k: int = 10) -> float:
    """Share of the true neighbours (all queries against all vectors, block by block) among the found ones."""
    rows = clean_vectors(vectors)
    asked = rows.where(is_query(F.col("vec_id"))).toPandas()
    if not len(asked):
        return 1.0
    probe = vectors.sparkSession.sparkContext.broadcast((asked["vec_id"].to_numpy(), np.asarray(asked["v"].tolist())))

    def exact(batches):
        for b in batches:
            yield _top(b["vec_id"].to_numpy(), np.asarray(b["v"].tolist()), *probe.value, k)

    nearest = Window.partitionBy("query_id").orderBy("score", "vec_id")
    truth = rows.mapInPandas(exact, _FOUND).withColumn("rank", F.row_number().over(nearest)).where(F.col("rank") <= k)
    # of ties at the k-th distance any will do
    worst = truth.groupBy("query_id").agg(F.max("score").alias("worst"), F.count("*").alias("n"))
    hit = found.join(worst, "query_id").where(F.col("score") <= F.col("worst") + 1e-12).count()
    return hit / max(1, worst.agg(F.sum("n")).first()[0])


def shared_blocks(sizes: dict[int, int], page: int) -> dict[int, int]:
    """The block of each leaf: neighbouring leaves share one until it holds ``page`` vectors."""
    out, first, room = {}, 0, -1
    for leaf in sorted(sizes):
        if sizes[leaf] > room:
            first, room = leaf, page
        out[leaf], room = first * _PART, room - sizes[leaf]
    return out


def calibrate(tree: Tree, probes: dict[int, np.ndarray], truth: pd.DataFrame, recall: float) -> int:
    """The least number of leaves whose visit finds ``recall`` of the true neighbours."""
    at = []
    for i, part in truth.groupby("query_id"):
        order = {leaf: n for n, leaf in enumerate(best_bins(tree, probes[i], tree.leaves))}
        at += [order[leaf] + 1 for leaf in part["leaf"].tolist()]
    if not at:
        return tree.leaves
    return int(np.sort(at)[min(len(at) - 1, int(np.ceil(recall * len(at))) - 1)])
