"""What the operators of this subpackage share: tables, durable cuts, Arrow kernels.

Kernels run in Python workers that need not have this package installed: every
module calls :func:`ship`, so its functions travel by value.
"""

from __future__ import annotations

import re
import sys
import types
from collections.abc import Callable, Iterator
from typing import Any

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.sources.shared import bounded, materialize, release  # noqa: F401

#: Text bytes that one kernel call sees at most, unless a single text is longer.
SLICE_BYTES = 1 << 20
#: Bytes of an Arrow batch between the JVM and a Python worker.
ARROW_BYTES = 4 << 20


def ship(module: str) -> None:
    cloudpickle.register_pickle_by_value(sys.modules[module])


ship(__name__)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def unused(columns: list[str], name: str) -> str:
    """A column name like `name` that the columns don't have, whatever its case."""
    have = {c.lower() for c in columns}
    while f"_{name}".lower() in have:
        name = f"_{name}"
    return f"_{name}"


def process_cache() -> dict:
    """A dictionary that lives as long as the Python worker, across tasks."""
    name = "_tidemark_process_cache"
    if name not in sys.modules:
        module = types.ModuleType(name)
        module.store = {}
        sys.modules[name] = module
    return sys.modules[name].store


def kept_model(key: tuple, make: Callable[[], Any]) -> Any:
    """A model that the worker keeps for later tasks; one at a time, so that stages don't add up their memory."""
    store = process_cache()
    if store.get("key") != key:
        store["model"] = None
        store["model"], store["key"] = make(), key
    return store["model"]


def free_model(owner: str) -> None:
    """Lets go of a kept model of another operator, and of memory that is no longer used."""
    store = process_cache()
    if "key" in store and store["key"][0] != owner:
        store["model"] = store["key"] = None
        del store["key"]
        import ctypes

        if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
            trim(0)


def slices(batch: pa.RecordBatch, column: int, limit: int) -> Iterator[pa.RecordBatch]:
    """Cuts a batch so that the texts of one piece hold at most `limit` bytes, or are one row."""
    n = batch.num_rows
    sizes = [v or 0 for v in pa.compute.binary_length(batch.column(column)).to_pylist()]
    begin = total = 0
    for i in range(n):
        if i > begin and total + sizes[i] > limit:
            yield batch.slice(begin, i - begin)
            begin, total = i, 0
        total += sizes[i]
    if begin < n:
        yield batch.slice(begin, n - begin)


def _bytes(text: str) -> int:
    """A size as Spark's settings have it, such as 8388608, 8388608b, 64m or 1g."""
    number, unit = re.fullmatch(r"\s*(-?\d+)\s*([a-z]*)\s*", text.lower()).groups()
    return int(number) << {"": 0, "b": 0, "k": 10, "m": 20, "g": 30, "t": 40, "p": 50}[unit[:1] if unit else ""]


def small_batches(spark: SparkSession) -> None:
    """Bounds the session's Arrow batches by bytes, unless it has a lower bound: for queries, which own their session; operators leave it alone."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    if not 0 < _bytes(spark.conf.get(name)) <= ARROW_BYTES:
        spark.conf.set(name, str(ARROW_BYTES))


def annotate(
    df: DataFrame,
    texts: list[str],
    make: Callable[[Any], Callable[..., list]],
    fields: list[T.StructField],
    payload: Any = None,
    keep: list[str] | None = None,
    where: int | None = None,
) -> DataFrame:
    """Appends columns that a kernel computes from a text column and others, in Arrow batches.

    `make(payload)` runs once a task and returns the kernel: it takes one list
    per column of `texts`, the text first, and returns one list or Arrow array per field. `keep` names
    the columns that stay (all by default); a kept column with the name of a
    field gives way to the field. With `where`, rows whose field of that index
    is false are left out. `payload` is broadcast: callers bound its size.
    """
    import pyarrow.compute  # noqa: F401

    names = {f.name for f in fields}
    stay = [c for c in (df.columns if keep is None else keep) if c not in names]
    ask = list(dict.fromkeys([*stay, *texts]))
    df = df.select(*(F.col(f"`{c}`") for c in ask))
    schema = T.StructType([*(df.schema[c] for c in stay), *fields])
    from pyspark.sql.pandas.types import to_arrow_schema

    types_ = [f.type for f in to_arrow_schema(T.StructType(fields))]
    owner = make.__module__
    sent = df.sparkSession.sparkContext.broadcast(cloudpickle.dumps(payload)) if payload is not None else None  # classes by value too
    at, own, limit, out = [ask.index(c) for c in texts], [ask.index(c) for c in stay], SLICE_BYTES, [*stay, *(f.name for f in fields)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pickle

        import pyarrow.compute  # noqa: F401

        free_model(owner)
        kernel = make(pickle.loads(sent.value) if sent is not None else None)
        for batch in batches:
            for piece in slices(batch, at[0], limit):
                got = kernel(*(piece.column(i).to_pylist() for i in at))
                cols = [x if isinstance(x, pa.Array) else pa.array(x, type=t) for x, t in zip(got, types_)]
                made = pa.RecordBatch.from_arrays([*(piece.column(i) for i in own), *cols], names=out)
                yield made if where is None else made.filter(cols[where])
            pa.default_memory_pool().release_unused()

    return df.mapInArrow(run, schema)
