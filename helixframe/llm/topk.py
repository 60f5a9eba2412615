"""Exact top-k inner-product search by a three-phase uniform threshold."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import staged

#: Rows of one side that meet in a task at once, about.
CHUNK, BLOCK = 4096, 1024


#: Parts of scores beyond this are only bounded in the search; scores themselves are exact.
FAR = 1 << 60
#: Equal vectors are first thinned in so many shares.
SHARES = 64


def integer_vector(embedding: Column, scale: int = 1024) -> Column:
    """``floor(scale * x)`` of each component; null where the vector or a component is null or not finite.

    A component beyond a long raises: no score of it could be told.
    """
    fit = F.forall(embedding, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < float("inf")))
    return F.when(F.coalesce(fit, F.lit(False)), F.transform(embedding, lambda x: F.floor(F.lit(float(scale)) * x.cast("double")).cast("long")))


def _matrix(vectors: pd.Series) -> np.ndarray:
    return np.array(vectors.tolist(), dtype=np.int64).reshape(len(vectors), -1)


def _partials(q: np.ndarray, c: np.ndarray, slices: int) -> list[np.ndarray]:
    """Inner products of each slice of dimensions; in doubles where these hold them exactly."""
    bound = int(np.abs(q).max(initial=0)) * int(np.abs(c).max(initial=0)) * max(1, q.shape[1])
    kind = np.float64 if bound < 1 << 53 else object
    cuts = np.linspace(0, q.shape[1], slices + 1).astype(int)
    return [q[:, a:b].astype(kind) @ c[:, a:b].astype(kind).T for a, b in zip(cuts, cuts[1:])]


def _best(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the k highest scores, ties to smaller ids."""
    k = min(k, len(scores))
    if k == len(scores):
        near = np.arange(k)
    else:
        near = np.nonzero(scores >= np.partition(scores, len(scores) - k)[len(scores) - k])[0]
    return near[np.lexsort((ids[near], -scores[near]))][:k]


def exact_top_k(queries: DataFrame, candidates: DataFrame, k: int, slices: int = 2, key: str = "vec_id") -> DataFrame:
    """The k highest integer inner products of each query: ``query_id, rank, vec_id, score``.

    Both tables have ``vec_id`` and ``v array<long>``; other columns are passed over. A row with a null in either, or in ``v``,
    takes no part. ``key`` (a long) tells rows apart: the row of a query's own key is not its candidate, all others are, also
    those that repeat its vec_id. By default that is vec_id itself, and then rows of one id that is asked for are no candidates
    of it. Repeated queries each get their rows. Vectors of unequal length have no score. Ties go to the smaller vec_id; a
    query with fewer candidates gets them all. Empty tables give an empty result. A score in the result that does not fit a
    long raises, with both ids.

    The dimensions are cut into ``slices`` score lists whose sums are the scores. Phase 1: each block of candidates
    sends its k best of each list; the k-th best lower bound of their sums is a safe cutoff. Phase 2: it goes out with the
    queries, and blocks send what passes the uniform share of the cutoff in any list and can still reach the k best.
    Phase 3: these few get their exact scores. Of equal vectors only the k + 1 first rows can be in a result, so
    a vector that many rows share does not multiply the entries. Queries and candidates meet in blocks of bounded
    size, dealt over all tasks by hash. A query with a list entry below -``FAR`` has no cutoff, and all rows get its exact score.
    """
    def clean(df: DataFrame) -> DataFrame:
        whole = F.forall("v", lambda x: x.isNotNull())
        rows = df.where(F.col("vec_id").isNotNull() & F.col("v").isNotNull() & (F.size("v") > 0) & whole)
        return rows.select("vec_id", "v", F.col(key).cast("long").alias("key"), F.monotonically_increasing_id().alias("at"))

    order = ["vec_id", "key", "at"]
    thinned = clean(candidates).withColumn("_share", F.pmod(F.xxhash64("key", "at"), F.lit(SHARES)))
    for keys in (["v", "_share"], ["v"]):
        thinned = thinned.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("_n") <= k + 1)
    # ``at`` numbers rows from here on.
    cand = staged(thinned.select(F.col("vec_id").alias("cand_id"), "key", "v").withColumn("vec_id", F.monotonically_increasing_id()))
    ask = staged(clean(queries).select(F.col("vec_id").alias("asked"), F.col("key").alias("own"), F.col("v").alias("qv")).withColumn("query_id", F.monotonically_increasing_id()))
    groups, blocks = max(1, -(-cand.count() // CHUNK)), max(1, -(-ask.count() // BLOCK))
    dims = F.size("v")
    # A stated query set against all rows: each pair of blocks is one group, and no group holds a whole side.
    c = cand.select("vec_id", "key", "v", dims.alias("d"), F.pmod(F.xxhash64("vec_id"), F.lit(groups)).alias("g"), F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("b"))
    c = c.withColumn("b", F.col("b").cast("long"))

    def sent(q: DataFrame) -> DataFrame:
        return q.withColumns({"d": F.size("qv"), "b": F.pmod(F.xxhash64(F.lit(3), "query_id"), F.lit(blocks)), "g": F.explode(F.sequence(F.lit(0).cast("long"), F.lit(groups - 1).cast("long")))})

    def local_lists(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(left) and len(right):
            ids, keys = right["vec_id"].to_numpy(), right["key"].to_numpy()
            for j, part in enumerate(_partials(_matrix(left["qv"]), _matrix(right["v"]), slices)):
                for row, (query, mine) in enumerate(zip(left["query_id"], left["own"])):
                    own = part[row]
                    others = np.nonzero(keys != mine)[0]
                    if not len(others):
                        continue
                    best = others[_best(own[others], ids[others], k)]
                    # A bound from below may be less than the part, not more.
                    out += [(query, j, int(ids[i]), min(int(own[i]), FAR)) for i in best if own[i] > -FAR]
                    # The least entry bounds what an object that is on no list adds.
                    out.append((query, j, None, max(min(int(own[others].min()), FAR), -FAR)))
        return pd.DataFrame(out, columns=["query_id", "slice", "vec_id", "part"]).astype({"vec_id": "Int64"})

    keys = ["g", "b", "d"]
    lists = staged(sent(ask).groupBy(keys).cogroup(c.groupBy(keys)).applyInPandas(local_lists, "query_id long, slice int, vec_id long, part long"))
    floors = lists.where("vec_id IS NULL").groupBy("query_id", "slice").agg(F.min("part").alias("low"))
    floors = floors.groupBy("query_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("slice", "low"))), lambda x: x["low"]).alias("floors"))
    top = lists.where("vec_id IS NOT NULL").withColumn("_r", F.row_number().over(Window.partitionBy("query_id", "slice").orderBy(F.desc("part"), "vec_id"))).where(F.col("_r") <= k)
    seen = top.groupBy("query_id", "vec_id").agg(F.map_from_entries(F.collect_list(F.struct("slice", "part"))).alias("parts")).join(floors, "query_id")
    low = F.aggregate(F.transform("floors", lambda f, j: F.coalesce(F.try_element_at("parts", j), f)), F.lit(0).cast("long"), lambda s, x: s + x)
    bound = (
        seen.withColumn("low", low).withColumn("_r", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("low"), "vec_id")))
        .where(F.col("_r") <= k).groupBy("query_id").agg(F.min("low").alias("tau"), F.count("*").alias("n"), F.first("floors").alias("f"))
        .select("query_id", F.when((F.col("n") == k) & ~F.exists("f", lambda x: x <= -FAR), F.col("tau")).alias("tau"))
    )
    armed = ask.join(floors.join(bound, "query_id", "left"), "query_id")

    def entries(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        found_q, found_c = [], []
        if len(left) and len(right):
            ids, keys = right["vec_id"].to_numpy(), right["key"].to_numpy()
            parts = _partials(_matrix(left["qv"]), _matrix(right["v"]), slices)
            for row, (query, mine, floor, tau) in enumerate(zip(left["query_id"], left["own"], left["floors"], left["tau"])):
                keep = keys != mine
                if not pd.isna(tau):
                    floor = [int(x) for x in floor]
                    # Scores are integers, so the share may be rounded down.
                    share = (int(tau) - sum(floor)) // slices
                    # Of the kind of the parts: doubles where these are exact, whole numbers beyond.
                    reported, lower, upper = np.zeros(len(ids), bool), np.zeros(len(ids), parts[0].dtype), np.zeros(len(ids), parts[0].dtype)
                    for part, least in zip(parts, floor):
                        passes = part[row] >= least + share
                        reported |= passes
                        lower = lower + np.where(passes, part[row], least)
                        upper = upper + np.where(passes, part[row], least + share)
                    keep &= reported
                    here = lower[keep]
                    reach = max(int(tau), np.partition(here, len(here) - k)[len(here) - k]) if len(here) >= k else int(tau)
                    # A quotient rounded down leaves less than one for each list.
                    keep &= upper + slices >= reach
                hit = ids[keep]
                found_q.append(np.full(len(hit), query))
                found_c.append(hit)
        if not found_q:
            return pd.DataFrame({"query_id": [], "vec_id": []}, dtype="int64")
        return pd.DataFrame({"query_id": np.concatenate(found_q), "vec_id": np.concatenate(found_c)})

    left = sent(armed)
    survivors = left.groupBy(keys).cogroup(c.groupBy(keys)).applyInPandas(entries, "query_id long, vec_id long")
    product = F.aggregate(F.zip_with("qv", "v", lambda x, y: x * y), F.lit(0).cast("long"), lambda s, x: s + x)
    # Beyond a long, in decimals.
    wide = F.aggregate(F.zip_with("qv", "v", lambda x, y: (x.cast("decimal(19,0)") * y.cast("decimal(19,0)")).cast("decimal(38,0)")), F.lit(0).cast("decimal(38,0)"), lambda s, x: (s + x).cast("decimal(38,0)"))
    largest = lambda c: F.array_max(F.transform(c, lambda x: F.abs(x.cast("double"))))
    fits = largest("qv") * largest("v") * F.size("v") < float(1 << 62)
    scored = survivors.join(cand, "vec_id").join(ask, "query_id").select("query_id", "asked", "cand_id", "vec_id", F.when(fits, product.cast("decimal(38,0)")).otherwise(wide).alias("score"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "cand_id", "vec_id"))
    found = scored.withColumn("rank", rank).where(F.col("rank") <= k)
    told = F.when(F.col("score").between(F.expr(f"{-(1 << 63)}BD"), F.expr(f"{(1 << 63) - 1}BD")), F.col("score").cast("long")).otherwise(
        F.raise_error(F.concat(F.lit("no long holds the score of "), F.col("asked").cast("string"), F.lit(" and "), F.col("cand_id").cast("string"))).cast("long")
    )
    return found.select(F.col("asked").alias("query_id"), F.col("rank").cast("int").alias("rank"), F.col("cand_id").alias("vec_id"), told.alias("score"))
