"""SHA-256 of ordered groups, streamed: a group of any size is hashed piece by piece."""

from __future__ import annotations

import hashlib
from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from annolytics.llm.shared import small_batches

_ROWS = 10_000


def joined_sha256(
    rows: DataFrame, key: str, order: Sequence[str], piece: str, separator: str, first: Sequence[str] = (),
    total: str | None = None,
) -> DataFrame:
    """(key, first columns, total, sha256): per key the lowercase hex digest of its pieces joined in order.

    One shuffle by key, sorted inside the partitions; a task holds one Arrow
    batch and one digest, never a group. The digest of one group is a
    sequential sum by nature, so a hot key is one task's stream: hand over
    pieces that are already joined in blocks where there are many. ``first``
    columns come from the first row of the key, ``total`` is summed. A null
    piece adds nothing, not even a separator. Keys must not be null.
    """
    small_batches(rows.sparkSession)
    carried = [*first, *([total] if total else [])]
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema.fields}
    slim = rows.select(key, *order, F.col(piece).alias("_piece"), *(c for c in carried if c not in (key, *order)))
    dealt = slim.repartition(key).sortWithinPartitions(key, *order).select(key, "_piece", *carried)
    gap, names = separator.encode(), [key, *carried, "sha256"]

    def digest(batches):
        now = sums = kept = None
        some, out = False, []

        def close():
            out.append([now, *kept, *([sums] if total else []), state.hexdigest()])

        def flush(like):
            columns = [pa.array(c, like.field(n).type) for n, c in zip(names[:-1], zip(*out, strict=True), strict=False)]
            batch = pa.record_batch([*columns, pa.array([r[-1] for r in out], pa.string())], names)
            out.clear()
            return batch

        schema = None
        for batch in batches:
            schema = batch.schema
            lines = zip(*(c.to_pylist() for c in batch.columns), strict=True)
            for own, text, *rest in lines:
                if own != now:
                    if now is not None:
                        close()
                    now, state, some, sums, kept = own, hashlib.sha256(), False, 0, rest[:len(first)]
                if text is not None:
                    state.update((gap if some else b"") + text.encode())
                    some = True
                if total:
                    sums += rest[-1]
            if len(out) >= _ROWS:
                yield flush(schema)
        if now is not None:
            close()
        if out:
            yield flush(schema)

    shape = ", ".join(f"`{n}` {kinds[n]}" for n in names[:-1]) + ", sha256 string"
    return dealt.mapInArrow(digest, shape)
