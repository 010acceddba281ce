"""Rows that look something up in the rows of their key: the key's pool is held once by a task,
in arrays, and the asking rows stream past it. No row is made for a pair."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: Asking rows of a key that one task answers; a key with more is dealt out over several.
MOST_ASKS = 1_000_000


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, ``spark.checkpoint.dir``. Unset, it is a temporary
    folder if all runs on one machine, and an error elsewhere."""
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if path:
        return path
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="estimark-shared-"))
    return spark.sparkContext.getCheckpointDir()


def settled(df: DataFrame) -> DataFrame:
    """``df`` written to the shared folder and read again: computed once for all that use it, and
    still there when executors are lost."""
    path = f"{shared_dir(df.sparkSession)}/settled-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def segments(batch: pa.RecordBatch, columns: list[str]) -> list[tuple[int, int]]:
    """Where the columns' values change: (begin, end) of each run of equal ones."""
    n = batch.num_rows
    if not n:
        return []
    new = None
    for c in columns:
        x = batch.column(c)
        differs = pc.not_equal(x.slice(1), x.slice(0, n - 1))
        new = differs if new is None else pc.or_(new, differs)
    cuts = [0, *[i + 1 for i in pc.indices_nonzero(new).to_pylist()], n]
    return list(zip(cuts[:-1], cuts[1:], strict=True))


def dealt(pool: DataFrame, asks: DataFrame, keys: list[str], most: int, most_pool: int | None) -> tuple[DataFrame, DataFrame]:
    """Both with a ``__salt`` and a ``__part``. The asks of a key that has over ``most`` of them are
    dealt out over several salts, each of which gets the key's pool; the pool of a key with over
    ``most_pool`` rows over several parts, each of which gets the key's asks. Counts come first, a
    row a hot key."""

    def split(many: DataFrame, others: DataFrame, limit: int, name: str) -> tuple[DataFrame, DataFrame]:
        hot = many.groupBy(*keys).agg(F.ceil(F.count("*") / limit).cast("int").alias("__n")).where("__n > 1")
        n = F.coalesce("__n", F.lit(1))
        many = many.join(hot, keys, "left").withColumn(name, F.pmod(F.xxhash64(*many.columns), n).cast("int")).drop("__n")
        return many, others.join(hot, keys, "left").withColumn(name, F.explode(F.sequence(F.lit(0), n - 1))).drop("__n")

    asks, pool = split(asks, pool, most, "__salt")
    if most_pool is None:
        return pool.withColumn("__part", F.lit(0)), asks.withColumn("__part", F.lit(0))
    return split(pool, asks, most_pool, "__part")


def meet(pool: DataFrame, asks: DataFrame, keys: list[str], build: Callable[[pa.Table], object], answer: Callable[[object, pa.RecordBatch], pa.RecordBatch | None], schema: StructType | str, most: int = MOST_ASKS, most_pool: int | None = None) -> DataFrame:
    """What ``answer`` gives for each batch of asks, from what ``build`` makes of the pool rows of
    the same keys (None where there are none). Keys may not be null. With ``most_pool``, a key's
    pool may come in several parts, and what they answer has to be put together by the caller."""
    columns = list(dict.fromkeys([*keys, *pool.columns, *asks.columns]))
    pool, asks = dealt(pool, asks, keys, most, most_pool)
    both = pool.withColumn("__kind", F.lit(0)).unionByName(asks.withColumn("__kind", F.lit(1)), allowMissingColumns=True)
    by = [*keys, "__salt", "__part"]
    both = both.repartition(*by).sortWithinPartitions(*by, "__kind").select(*columns, "__salt", "__part", "__kind")
    asked = [c for c in asks.columns if not c.startswith("__")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held, state, built = None, [], None, False
        for batch in batches:
            for begin, end in segments(batch, [*by, "__kind"]):
                part = batch.slice(begin, end - begin)
                key = tuple(part.column(c)[0].as_py() for c in by)
                if key != now:
                    now, held, state, built = key, [], None, False
                if not part.column("__kind")[0].as_py():
                    held.append(part)
                    continue
                if not built:
                    state, held, built = build(pa.Table.from_batches(held)) if held else None, [], True
                found = answer(state, part.select(asked))
                if found is not None and found.num_rows:
                    yield found

    return both.mapInArrow(run, schema)
