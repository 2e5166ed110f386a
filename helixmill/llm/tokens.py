"""What tokenizing operators share: bounded tokenizer files, read once by the driver and broadcast."""

from __future__ import annotations

import os
from collections.abc import Callable
from typing import Any

from pyspark.broadcast import Broadcast
from pyspark.sql import SparkSession


MOST_BYTES = 64_000_000
#: Encodings take many times the memory of their texts, so batches of about so many bytes are encoded at once.
ENCODE_BYTES = 250_000
_built: dict[tuple[str, str], Any] = {}


def shared_file(spark: SparkSession, path: str) -> Broadcast[bytes]:
    """The bytes of a file that the driver can open, if it is small enough to broadcast."""
    with open(path, "rb") as f:
        data = f.read(MOST_BYTES + 1)
    if len(data) > MOST_BYTES:
        raise ValueError(f"{path} has more than {MOST_BYTES} bytes")
    return spark.sparkContext.broadcast(data)


def once(kind: str, data: bytes, build: Callable[[bytes], Any]) -> Any:
    """build(data), made once in each Python worker."""
    key = (kind, f"{len(data)}-{hash(data)}")
    if key not in _built:
        _built[key] = build(data)
    return _built[key]


def use_threads(threads: int) -> None:
    """Let the tokenizers library encode batches on so many threads of this worker."""
    os.environ["TOKENIZERS_PARALLELISM"] = "true" if threads > 1 else "false"
    os.environ["RAYON_NUM_THREADS"] = str(threads)
