"""Texts packed into containers of fixed capacity with little unused space.

The cost of a text is linear plus quadratic in its tokens, as attention has it. Texts go in descending order to the
container of least cost that still has room, unless it nearly fills another; a new one is opened only where none has. A text larger than a container is
cut into full containers and a rest, nothing else is cut. Texts are dealt by hash into parts of about ``PART`` and each
part is packed by itself, at most one container per part being less than well filled.

Results for odd input: null and empty texts have no tokens and take room in no container, but get one; equal texts are
packed each; texts without id are skipped; specifications without a positive capacity are skipped; no texts, no rows.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomwork.functions.shared import written
from loomwork.llm.tokens import TOKENIZER, with_tokens

PART = 4096
SPECS = 1000  # specifications at once; more are refused
NEARLY_FULL = 8  # a text that leaves less than this part of a container free closes it
_TYPE = "spec_id int, container_id string, doc_id long, piece_no int, start_token long, n_tokens long"


def assign(sizes: np.ndarray, capacity: int, nearly_full: int = NEARLY_FULL) -> np.ndarray:
    """The container of each text, numbered from 0; sizes are at most the capacity."""
    order = np.lexsort((np.arange(len(sizes)), -sizes))
    n = max(1, math.ceil(sizes.sum() / capacity))
    room, cost = np.full(n, capacity, np.int64), np.zeros(n)
    out = np.zeros(len(sizes), np.int64)
    for i in order:
        size = int(sizes[i])
        fit = np.flatnonzero(room >= size)
        if not len(fit):
            room, cost = np.append(room, capacity), np.append(cost, 0.0)
            fit = np.array([len(room) - 1])
        left = room[fit] - size
        to = fit[np.argmin(left)] if nearly_full and left.min() <= capacity // nearly_full else fit[np.argmin(cost[fit])]
        room[to] -= size
        cost[to] += size + size * size / capacity
        out[i] = to
    return out


def _packed(nearly_full: int):
    def pack_part(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["n_tokens", "doc_id"], kind="stable")
        to = assign(group["n_tokens"].to_numpy(np.int64), int(group["capacity"].iloc[0]), nearly_full)
        label = f"{group['part'].iloc[0]}-"
        return group.assign(container_id=[label + str(c) for c in to])[["spec_id", "container_id", "doc_id", "piece_no", "start_token", "n_tokens"]]

    return pack_part


def pack(documents: DataFrame, specs: DataFrame, tokenizer: str = TOKENIZER, nearly_full: int = NEARLY_FULL) -> DataFrame:
    """Where each text goes, for each specification: ``spec_id, container_id, doc_id, piece_no, start_token, n_tokens``.

    With ``nearly_full`` 0 a text always goes to the container of least cost that has room.
    """
    sized = written(with_tokens(documents.select("doc_id", "text").filter(F.col("doc_id").isNotNull()), "text", tokenizer=tokenizer).select("doc_id", "n_tokens"), "sizes")
    wanted = [(r.spec_id, int(r.capacity_tokens)) for r in specs.select("spec_id", "capacity_tokens").dropna().distinct().take(SPECS + 1) if r.capacity_tokens > 0]
    if len(wanted) > SPECS:
        raise ValueError(f"more than {SPECS} specifications")
    if not wanted:
        return documents.sparkSession.createDataFrame([], _TYPE)
    parts = max(1, math.ceil(sized.count() / PART))
    each = F.explode(F.array(*(F.struct(F.lit(s).cast("int").alias("spec_id"), F.lit(c).cast("long").alias("capacity")) for s, c in wanted))).alias("spec")
    items = sized.select("doc_id", "n_tokens", each).select("doc_id", "n_tokens", "spec.*")
    full = F.when(F.col("n_tokens") > F.col("capacity"), F.floor(F.col("n_tokens") / F.col("capacity"))).otherwise(0).cast("int")
    items = items.withColumn("full", full)
    whole = items.filter(F.col("full") > 0).select("*", F.explode(F.sequence(F.lit(0), F.col("full") - 1)).alias("piece_no"))
    whole = whole.select("spec_id", F.concat_ws("-", F.lit("full"), "doc_id", "piece_no").alias("container_id"), "doc_id", "piece_no", (F.col("piece_no") * F.col("capacity")).alias("start_token"), F.col("capacity").alias("n_tokens"))
    rest = items.select("spec_id", "capacity", "doc_id", F.col("full").alias("piece_no"), (F.col("full") * F.col("capacity")).alias("start_token"), (F.col("n_tokens") - F.col("full") * F.col("capacity")).alias("n_tokens"))
    rest = rest.filter((F.col("n_tokens") > 0) | (F.col("piece_no") == 0)).withColumn("part", F.pmod(F.xxhash64("doc_id"), F.lit(parts)))
    return whole.unionByName(rest.groupBy("spec_id", "part").applyInPandas(_packed(nearly_full), _TYPE))


def fill(packed: DataFrame, specs: DataFrame) -> DataFrame:
    """Per specification how full and how even its containers are: ``spec_id, capacity_tokens, n_containers, n_tokens,
    unused_share, mean_cost, cost_spread, most_cost``; costs are linear plus quadratic, the spread is the deviation over the mean."""
    one = packed.groupBy("spec_id", "container_id").agg(F.sum("n_tokens").alias("n"), F.sum(F.col("n_tokens").cast("double") * F.col("n_tokens")).alias("squares"))
    costs = one.join(specs.select("spec_id", "capacity_tokens").dropna().distinct(), "spec_id").withColumn("cost", F.col("n") + F.col("squares") / F.col("capacity_tokens"))
    sums = costs.groupBy("spec_id", "capacity_tokens").agg(
        F.count("*").alias("n_containers"), F.sum("n").alias("n_tokens"), F.avg("cost").alias("mean_cost"), (F.stddev_pop("cost") / F.avg("cost")).alias("cost_spread"), F.max("cost").alias("most_cost")
    )
    return sums.withColumn("unused_share", 1 - F.col("n_tokens") / (F.col("n_containers") * F.col("capacity_tokens")))
