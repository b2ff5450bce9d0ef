"""Filling containers with whole texts: vector bin packing by the dot-product heuristic, in blocks of bounded size."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evalloom.session import cut_lineage, ship_package

#: Items packed together in one task. Each block leaves about one container that is not full.
BLOCK_ITEMS = 4096


def pack(sizes: np.ndarray, limits: tuple[float, ...]) -> np.ndarray:
    """Container number of each item (row of ``sizes``, one column a limit). No item may exceed a limit by itself.

    Containers are filled one at a time: of the items that fit in every dimension the one whose size vector has the largest dot product
    with the room left (both as shares of the limits, each dimension weighted by the share of the containers' room that all items together need) goes in
    next; ties to the earlier item. When none fits, a new container is opened.
    """
    n = len(sizes)
    where = np.full(n, -1, np.int64)
    if n == 0:
        return where
    share = sizes / np.asarray(limits, float)
    weight = share.mean(axis=0)
    order = np.lexsort((np.arange(n), -share[:, 0]))
    live = share[order]
    rows = order
    k = -1
    while len(rows):
        k += 1
        room = np.ones(share.shape[1])
        taken = np.zeros(len(rows), bool)
        # The items are in falling order of the first dimension: those before ``low`` are too large for what is left of it.
        low = 0
        while True:
            low = max(low, int(np.searchsorted(-live[:, 0], -(room[0] + 1e-12))))
            if low >= len(rows):
                break
            rest = live[low:]
            fits = ~taken[low:] & (rest <= room + 1e-12).all(axis=1)
            if not fits.any():
                break
            i = low + int(np.argmax(np.where(fits, rest @ (room * weight), -1.0)))
            taken[i] = True
            room = room - live[i]
        if not taken.any():
            raise ValueError("an item exceeds a limit")
        where[rows[taken]] = k
        live, rows = live[~taken], rows[~taken]
    return where


def pack_texts(items: DataFrame, ident: str, tokens: str, prompt: str, capacity: int, most_segments: int = 64, most_loss: int | None = None, block_items: int = BLOCK_ITEMS) -> DataFrame:
    """(container, ident, piece, start_token, end_token, tokens, loss_tokens) for every piece of every text with tokens.

    Limits of a container: ``capacity`` tokens, ``most_segments`` pieces and ``most_loss`` loss-bearing tokens (those after the first
    ``prompt`` tokens of a text; capacity if not given). A text is cut only if it exceeds the capacity, into full pieces and one rest. A full piece, and
    a text whose own loss-bearing tokens exceed the limit, is a container of its own, as nothing may join it; all else is packed within all three limits. Texts without
    tokens (null, empty) take no room and are left out. A row that repeats an ident is a text of its own. The pieces of a text follow each other without gap or overlap.

    Items go to ceil(items / block_items) blocks by hash, each packed in one task of bounded size, so work is proportional to the items.
    """
    ship_package(items.sparkSession)
    loss_limit = most_loss or capacity
    step = F.least(F.col(tokens), F.lit(capacity))
    base = items.where(F.col(tokens) > 0).select(F.col(ident).alias("_id"), F.col(tokens).cast("bigint").alias("_n"), F.coalesce(F.col(prompt), F.lit(0)).cast("bigint").alias("_p"), step.cast("bigint").alias("_step"))
    pieces = base.select("*", F.explode(F.sequence(F.lit(0).cast("bigint"), F.floor((F.col("_n") - 1) / F.col("_step")))).alias("piece"))
    pieces = pieces.withColumn("start_token", F.col("piece") * F.col("_step")).withColumn("end_token", F.least("_n", F.col("start_token") + F.col("_step")))
    pieces = pieces.select(
        "_id", F.col("piece").cast("int").alias("piece"), "start_token", "end_token", (F.col("end_token") - F.col("start_token")).alias("tokens"),
        F.greatest(F.lit(0), F.col("end_token") - F.greatest("start_token", "_p")).cast("bigint").alias("loss_tokens"),
    )
    pieces = cut_lineage(pieces)
    alone = (F.col("tokens") >= capacity) | (F.col("loss_tokens") > loss_limit)
    full = pieces.where(alone).select(F.concat_ws(".", F.lit("alone"), F.col("_id").cast("string"), "piece").alias("container"), *pieces.columns)
    rest = pieces.where(~alone)
    blocks = max(1, math.ceil(rest.count() / block_items))
    columns = ["container", *pieces.columns]
    limits = (float(capacity), float(most_segments), float(loss_limit))

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["_id", "piece"])
        sizes = np.column_stack([pdf["tokens"], np.ones(len(pdf)), pdf["loss_tokens"]]).astype(float)
        at = pack(sizes, limits)
        names = "b" + pdf["_block"].astype(str) + "." + pd.Series(at, index=pdf.index).astype(str)
        return pdf.drop(columns="_block").assign(container=names)[columns]

    blocked = rest.withColumn("_block", F.pmod(F.xxhash64("_id", "piece", F.lit("block")), F.lit(blocks)))
    # As many partitions as blocks, so that no task gets several because their rows are small; a few blocks a task where there are very many.
    width = min(blocks, 64 * int(items.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    packed = blocked.repartition(width, "_block").groupBy("_block").applyInPandas(one, full.schema)
    return full.unionByName(packed).withColumnRenamed("_id", ident)
