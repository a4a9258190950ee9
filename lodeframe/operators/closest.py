"""The closest vectors of a table to those of a bounded block of queries, as matrix products over Arrow batches."""

from __future__ import annotations

from collections.abc import Iterable

import numpy as np
import pyarrow as pa

#: Rows of vectors and of queries whose products are held at once, and pairs that are scored once more at once.
ROWS, ASKED, PAIRS = 4096, 1024, 1 << 16
#: Products may be off by this much.
MARGIN = 1e-9


def by_dimensions(column: pa.Array | pa.ChunkedArray) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """For each number of dimensions the rows with it and their unit vectors; rows without direction are left out."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    sizes = np.array(column.value_lengths().fill_null(0).to_pylist(), np.int64)
    out = {}
    for d in np.unique(sizes[sizes > 0]).tolist():
        rows = np.flatnonzero(sizes == d)
        matrix = column.take(pa.array(rows)).flatten().cast(pa.float64()).fill_null(float("nan")).to_numpy(zero_copy_only=False).reshape(-1, d)
        norm = np.sqrt((matrix * matrix).sum(1))
        told = np.flatnonzero((norm > 0) & np.isfinite(norm))
        if told.size:
            out[d] = rows[told], matrix[told] / norm[told, None]
    return out


def _kept(rows: pa.Table, k: int) -> pa.Table:
    """The ``k`` best rows of each query: greatest score, then least key."""
    rows = rows.sort_by([("asked", "ascending"), ("score", "descending"), ("key", "ascending")])
    asked = rows.column("asked").to_numpy()
    head = np.flatnonzero(np.concatenate((np.ones(min(1, asked.size), bool), asked[1:] != asked[:-1])))
    place = np.arange(asked.size) - np.repeat(head, np.diff(np.append(head, asked.size)))
    return rows.filter(pa.array(place < k))


def closest(queries: pa.Table, batches: Iterable[pa.RecordBatch | pa.Table], k: int, above: float | None) -> pa.Table:
    """(query, key, score) of the ``k`` vectors of greatest cosine ``above`` a bound for each query.

    ``queries`` (query, vector), batches (key, vector).  Products pick candidates,
    which are scored once more pair by pair, so that equal vectors score alike.
    """
    asked = by_dimensions(queries.column("vector"))
    least = np.full(queries.num_rows, -np.inf if above is None else above)
    held: pa.Table | None = None
    for batch in batches:
        for start in range(0, batch.num_rows, ROWS):
            some = batch.slice(start, ROWS)
            for d, (rows, matrix) in by_dimensions(some.column("vector")).items():
                if d not in asked:
                    continue
                own, vectors = asked[d]
                for first in range(0, own.size, ASKED):
                    part = own[first : first + ASKED]
                    scores = vectors[first : first + ASKED] @ matrix.T
                    bound = least[part]
                    if rows.size > k:
                        bound = np.maximum(bound, np.partition(scores, rows.size - k, axis=1)[:, rows.size - k])
                    q, v = np.nonzero(scores >= bound[:, None] - MARGIN)
                    exact = np.concatenate([np.empty(0), *((vectors[first + q[a : a + PAIRS]] * matrix[v[a : a + PAIRS]]).sum(1) for a in range(0, q.size, PAIRS))])
                    q, v, exact = (x[exact > above] for x in (q, v, exact)) if above is not None else (q, v, exact)
                    found = pa.table({"asked": pa.array(part[q], pa.int64()), "key": some.column("key").take(pa.array(rows[v])), "score": exact})
                    held = _kept(found if held is None else pa.concat_tables([held, found]), k)
                    of, n = np.unique(held.column("asked").to_numpy(), return_counts=True)
                    last = np.cumsum(n) - 1
                    full = n == k
                    least[of[full]] = np.maximum(least[of[full]], held.column("score").to_numpy()[last[full]])
    if held is None:
        return pa.table({"query": queries.column("query").slice(0, 0), "key": pa.nulls(0), "score": pa.array([], pa.float64())})
    return pa.table({"query": queries.column("query").take(held.column("asked")), "key": held.column("key"), "score": held.column("score")})
