"""Helpers that several of the operators share."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterable, Iterator

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes that make up words: ASCII letters, digits, the underscore, and all of non-ASCII characters.
_IN_WORD = np.array([chr(b).isalnum() or chr(b) == "_" or b > 127 for b in range(256)])
#: White space and punctuation outside ASCII.
_OTHER_SPACE = re.compile("[\u0080-\u00bf\u2000-\u206f\u3000-\u303f]+")
_BASE = np.uint64(0x5851F42D4C957F2D)
_UNBASE = np.uint64(pow(0x5851F42D4C957F2D, -1, 2**64))
_CHUNK = 400_000


class _Own(dict):
    """What each process makes for itself: functions that are sent to the executors take it along empty."""

    def __reduce__(self):
        return _Own, ()


_powers: dict[str, np.ndarray] = _Own()


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers.get("up", ())) < n:
        for name, base in (("up", _BASE), ("down", _UNBASE)):
            run = np.full(max(n, _CHUNK), base)
            run[0] = 1
            _powers[name] = np.multiply.accumulate(run)
    return _powers["up"], _powers["down"]


def word_hashes(texts: Iterable[str | None]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Chunks of texts as (word hashes, where each text's words start and the last end).

    Words are lower-cased runs of letters, digits and underscores; a hash
    depends on the word alone. Chunks hold about 400 KB of text, to stay in the processor's caches, or one text.
    """
    held: list[bytes] = []
    size = 0
    for text in texts:
        t = (text or "").lower()
        held.append((t if t.isascii() else _OTHER_SPACE.sub(" ", t)).encode("utf-8", "replace"))
        size += len(held[-1]) + 1
        if size >= _CHUNK:
            yield _hashed(held)
            held, size = [], 0
    if held:
        yield _hashed(held)


def _hashed(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    raw = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
    inside = np.zeros(len(raw) + 1, bool)
    inside[1:] = _IN_WORD[raw]
    edge = np.flatnonzero(inside[1:] != inside[:-1])
    first, last = edge[::2], edge[1::2]
    up, down = _power(len(raw))
    total = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * up[: len(raw)], out=total[1:])
    ends = np.cumsum([len(t) + 1 for t in texts])
    return mix((total[last] - total[first]) * down[first]), np.r_[0, np.searchsorted(first, ends)]


def span_hashes(raw: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """Hashes of the bytes between each first and last position; they depend on these bytes alone."""
    up, down = _power(len(raw) + 1)
    total = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * up[: len(raw)], out=total[1:])
    return mix((total[last] - total[first]) * down[first])


def text_words(texts: Iterable[str | None]) -> Iterator[np.ndarray]:
    """The word hashes of each text."""
    for ids, at in word_hashes(texts):
        for i in range(len(at) - 1):
            yield ids[at[i] : at[i + 1]]


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: spreads every input bit over the output."""
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xD1342543DE82EF95)
    return x ^ (x >> np.uint64(32))


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share, from ``spark.checkpoint.dir``.

    Where the setting is missing, a local session gets a temporary folder; on a
    cluster the setting is required, as executors cannot see a local folder.
    """
    sc = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if folder is None:
        if sc.master.startswith("local") and not sc.master.startswith("local-cluster"):
            folder = tempfile.mkdtemp(prefix="spark-")
        else:
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(folder)
    return folder.rstrip("/")


def cut(df: DataFrame) -> DataFrame:
    """Cut a small DataFrame's lineage by a reliable checkpoint."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write a DataFrame to the shared folder and read it back.

    Lost executors then cost a re-read, not a recomputation.
    """
    path = f"{shared_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def release(spark: SparkSession) -> None:
    """Let the driver's JVM collect what earlier jobs left and return the memory.

    Broadcasts and shuffles of finished jobs are cleaned once their handles are
    collected, and the heap shrinks only then.
    """
    spark.sparkContext._jvm.System.gc()


def small_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Bound the Arrow batches of texts: rows of up to a few hundred KB each."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(key)) > rows:
        spark.conf.set(key, str(rows))


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def unit(*cols, salt: str):
    """A number in [0, 1) that follows from the columns and a salt alone; SQL can repeat it."""
    text = F.concat_ws("|", F.lit(salt), *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in cols])
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)
