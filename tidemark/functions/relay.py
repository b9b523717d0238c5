"""Sequential state machines over long series, block by block."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.series import BLK, BLOCK, CORE, POS, with_halo
from tidemark.session import stage

Step = Callable[[pd.DataFrame, str | None], tuple[pd.DataFrame | list[tuple], str | None]]


def relay(rows: DataFrame, keys: list[str], step: Step, schema: str, block: int = BLOCK) -> DataFrame:
    """Run ``step(block_rows, state) -> (output, end_state)`` along ``_pos`` of every key.

    All blocks run at once from an unknown (``None``) start; a block whose predecessor ended in another state
    than assumed runs again from that state, until nothing changes. After round r the first r blocks are
    exact, and machines that forget their past settle after very few rounds. No task holds a whole key: a task
    reads its blocks one after the other, so a million short keys cost no call into Spark each. The output is a
    table or a list of tuples in the order of ``schema``.
    """
    names = [f.split()[0] for f in schema.split(", ")]
    key_types = {f.name: f.dataType.simpleString() for f in rows.schema.fields}
    whole = [k for k in keys if key_types[k] in ("tinyint", "smallint", "int", "bigint")]  # pandas makes floats of those with nulls
    keyed = ", ".join(f"`{k}` {'string' if k in whole else key_types[k]}" for k in keys)
    by = [*keys, BLK]
    full = f"{keyed}, {BLK} bigint, {schema}, _end boolean, _state string"
    inner = [c for c in rows.columns if c not in keys]

    def finish(pdf: pd.DataFrame, cuts: list[int]) -> pd.DataFrame:
        """Outputs and end states of the blocks between ``cuts``, as one table."""
        found, counts = [], []
        starts, body = pdf["_start"].tolist(), pdf[inner]
        for a, z in zip(cuts, cuts[1:]):
            out, end = step(body.iloc[a:z], starts[a] if isinstance(starts[a], str) else None)
            out = out if isinstance(out, list) else list(out[names].itertuples(index=False, name=None))
            found += [(*r, False, None) for r in out]
            found.append((*[None] * len(names), True, end))
            counts.append(len(out) + 1)
        head = pdf[by].iloc[cuts[:-1]]
        head = head.loc[head.index.repeat(counts)].reset_index(drop=True)
        return pd.concat([head, pd.DataFrame(found, columns=[*names, "_end", "_state"], dtype=object)], axis=1)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = None
        for pdf in batches:
            pdf = pdf if held is None else pd.concat([held, pdf], ignore_index=True)
            other, before = pdf[by], pdf[by].shift()
            begins = (other.ne(before) & ~(other.isna() & before.isna())).any(axis=1).to_numpy().copy()
            begins[:1] = True
            cuts = begins.nonzero()[0].tolist()
            if len(cuts) > 1:
                yield finish(pdf, cuts)
            held = pdf.iloc[cuts[-1]:].reset_index(drop=True) if cuts else held
        if held is not None:
            yield finish(held, [0, len(held)])

    def played(blocks: DataFrame) -> DataFrame:
        ready = blocks.withColumns({k: F.col(k).cast("string") for k in whole}).repartition(*by).sortWithinPartitions(*by, POS)
        return ready.mapInPandas(run, full).withColumns({k: F.col(k).cast(key_types[k]) for k in whole})

    key = F.struct(*keys)  # null keys are equal inside a struct
    at = ["_key", BLK]
    blocked = stage(with_halo(rows, 0, block=block).drop(CORE).withColumn("_key", key))
    result = stage(played(blocked.drop("_key").withColumn("_start", F.lit(None).cast("string"))))
    known = blocked.where(F.col(BLK) > 0).select(*at).distinct()
    assumed = known.limit(0).withColumn("_state", F.lit(None).cast("string"))
    while True:
        ends = result.where("_end").select(key.alias("_key"), (F.col(BLK) + 1).alias(BLK), F.col("_state").alias("_new"))
        changed = (
            ends.join(known, at, "left_semi").join(assumed, at, "left")
            .where(~F.col("_new").eqNullSafe(F.col("_state")))
            .select(*at, F.col("_new").alias("_state"))
        )
        changed = stage(changed)
        if changed.isEmpty():
            break
        redone = played(blocked.join(changed.withColumnRenamed("_state", "_start"), at).drop("_key"))
        kept = result.withColumn("_key", key).join(changed.select(*at), at, "left_anti").select(*result.columns)
        result = stage(kept.unionByName(redone))
        assumed = stage(assumed.join(changed.select(*at), at, "left_anti").unionByName(changed))
    return result.where("not _end").drop("_end", "_state", BLK)
