"""Saved searches against listings."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from estimark.operators.meeting import meet


#: Listings of a city that one task holds.
MOST_LISTINGS = 500_000
BOUNDS = {"max_rent": "rent_mo", "min_sqm": "sqm", "min_score": "score_total"}


class Ranked:
    """A city's listings, the best first."""

    def __init__(self, rows: pa.Table):
        self.ids, self.scores = (rows.column(c).combine_chunks() for c in ("id", "score_total"))
        numbers = {c: rows.column(c).to_numpy().astype(float) for c in BOUNDS.values()}
        place = np.argsort(pc.sort_indices(self.ids).to_numpy(), kind="stable")
        self.order = np.lexsort((place, -numbers["score_total"]))  # missing scores come last
        self.numbers = {c: x[self.order] for c, x in numbers.items()}

    def first(self, bounds: dict[str, float | None], k: int) -> np.ndarray:
        """Rows of the k best listings within the bounds; pieces of the order are looked at until
        there are enough."""
        found, at, step = [], 0, max(1024, 4 * k)
        while at < len(self.order) and sum(map(len, found)) < k:
            part = slice(at, at + step)
            ok = np.ones(len(self.order[part]), bool)
            for name, limit in bounds.items():
                if limit is not None:
                    x = self.numbers[BOUNDS[name]][part]
                    ok &= x <= limit if name.startswith("max") else x >= limit
            found.append(self.order[part][ok])
            at, step = at + step, 2 * step
        return np.concatenate(found)[:k] if found else np.zeros(0, np.int64)


def matches(rules: DataFrame, listings: DataFrame, most: int = 50, most_listings: int = MOST_LISTINGS) -> DataFrame:
    """(rule_id, id, score_total, rank): for each active rule the best listings that are new or
    cheaper today. rules: rule_id, city, max_rent, min_sqm, min_score, active (null: any);
    listings: id, city, rent_mo, sqm, score_total, is_new, dropped.

    A city's listings stand in order of score, in several parts if they are many; a rule reads a
    part's order until it has ``most``, so no row is made for a rule and a listing that isn't among
    these, and ``most`` rows a rule and part are shuffled."""
    asks = rules.where("coalesce(active, false)").where("city IS NOT NULL").select("city", "rule_id", *[F.col(b).cast("double").alias(b) for b in BOUNDS])
    pool = listings.where("coalesce(is_new, false) OR coalesce(dropped, false)").where("city IS NOT NULL").select("city", "id", "score_total", *[c for c in BOUNDS.values() if c != "score_total"])

    def answer(state: Ranked | None, part: pa.RecordBatch) -> pa.RecordBatch | None:
        if state is None:
            return None
        bounds = [part.column(b).to_pylist() for b in BOUNDS]
        found = [state.first(dict(zip(BOUNDS, limits, strict=True)), most) for limits in zip(*bounds, strict=True)]
        rows = pa.array(np.concatenate(found))
        rule = part.column("rule_id").take(pa.array(np.repeat(np.arange(len(found)), [len(f) for f in found])))
        return pa.RecordBatch.from_arrays([rule, state.ids.take(rows), state.scores.take(rows)], ["rule_id", "id", "score_total"])

    schema = StructType([asks.schema["rule_id"], pool.schema["id"], pool.schema["score_total"]])
    found = meet(pool, asks, ["city"], Ranked, answer, schema, most_pool=most_listings)
    rank = F.row_number().over(Window.partitionBy("rule_id").orderBy(F.desc("score_total"), "id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= most)


def due(users: DataFrame, hour: int) -> DataFrame:
    """Active users whose sending hour it is; a missing or malformed time means seven."""
    at = F.coalesce(F.get(F.split("send_time_utc", ":"), 0).try_cast("int"), F.lit(7))
    return users.where(F.coalesce("active", F.lit(False)) & (at == hour))


def ready(found: DataFrame, least: str = "min_new_listings") -> DataFrame:
    """Rules with at least as many distinct listings as they ask for."""
    return found.groupBy("rule_id", least).agg(F.countDistinct("id").alias("n")).where(F.col("n") >= F.coalesce(F.col(least), F.lit(1)))


def counts(found: DataFrame) -> DataFrame:
    """(rule_id, n_new, n_dropped): distinct listings of each rule that are new, and that are
    cheaper."""
    of = lambda flag: F.countDistinct(F.when(F.col(flag), F.col("id")))
    return found.groupBy("rule_id").agg(of("is_new").alias("n_new"), of("dropped").alias("n_dropped"))
