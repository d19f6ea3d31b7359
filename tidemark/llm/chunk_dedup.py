"""Operator 2: substring deduplication by content-defined chunking with a gear rolling hash.

A chunk ends where the top bits of the gear hash of the last 32 bytes are zero,
so chunk borders depend on content alone and fall into step again soon after an
insertion. Chunks are compared by a 128-bit digest; the first one in (id,
position) order stays. Later ones are removed where they stand in a run that is
long enough, or that is the whole text: short phrases that happen to agree stay.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tidemark.llm import common as C

LEAST, MOST, MASK_BITS = 16, 1024, 5
MIN_RUN = 100


def gear_table(seed: int = 41) -> np.ndarray:
    return np.random.default_rng(seed).integers(0, 1 << 32, 256, dtype=np.uint32)


def gear_hashes(data: np.ndarray, table: np.ndarray) -> np.ndarray:
    """h[i] = (h[i-1] << 1) + table[data[i]] modulo 2^32, for all i at once: 32 terms by five doublings."""
    h = table[data]
    for s in (1, 2, 4, 8, 16):
        if len(h) > s:
            h[s:] = h[s:] + (h[:-s] << np.uint32(s))
    return h


def chunk_ends(data: np.ndarray, table: np.ndarray, bits: int = MASK_BITS, least: int = LEAST, most: int = MOST) -> Iterator[int]:
    """Ends of the chunks of one text, each ``least`` to ``most`` bytes but the last."""
    start = 0
    for p in (np.flatnonzero(gear_hashes(data, table) >> np.uint32(32 - bits) == 0) + 1).tolist():
        while p - start > most:
            start += most
            yield start
        if p - start >= least:
            start = p
            yield start
    while len(data) - start > most:
        start += most
        yield start
    if start < len(data):
        yield len(data)


def chunks(docs: DataFrame) -> DataFrame:
    """(id, at, d1, d2) of every chunk of every text (columns id, text); ``at`` holds start and length."""

    def run(batches):
        import xxhash

        table, digest = gear_table(), xxhash.xxh3_128_digest
        for b in batches:
            data, off = C.utf8(b.column("text"))
            ids = b.column("id").to_numpy()
            for lo, hi in C.slabs(off):
                owner, at, names = [], [], []
                for k in range(lo, hi):
                    part = data[off[k]:off[k + 1]]
                    raw, start = part.tobytes(), 0
                    for end in chunk_ends(part, table):
                        owner.append(k)
                        at.append(start << 32 | end - start)
                        names.append(digest(raw[start:end]))
                        start = end
                d = np.frombuffer(b"".join(names), np.int64).reshape(-1, 2)
                yield pa.RecordBatch.from_arrays([pa.array(ids[owner]), pa.array(at, pa.int64()), pa.array(d[:, 0]), pa.array(d[:, 1])],
                                                 names=["id", "at", "d1", "d2"])

    return docs.mapInArrow(run, "id long, at long, d1 long, d2 long")


def repeated_chunks(docs: DataFrame) -> DataFrame:
    """(id, again): the chunks of each text that an earlier chunk equals, in order."""
    every = chunks(docs)
    first = (every.groupBy("d1", "d2").agg(F.min(F.struct("id", "at")).alias("first"), F.count(F.lit(1)).alias("n"))
             .where("n > 1").select("d1", "d2", "first"))
    again = every.join(first, ["d1", "d2"]).where((F.col("id") != F.col("first.id")) | (F.col("at") != F.col("first.at")))
    return again.groupBy("id").agg(F.sort_array(F.collect_list("at")).alias("again"))


def deduplicated(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_run: int = MIN_RUN) -> DataFrame:
    """One row per distinct id: (id, n_bytes, n_repeated_chunks, n_removed, spans, kept).

    ``kept`` is the rest of the text's UTF-8 bytes, ``spans`` the removed ranges
    [start, end). Null texts are empty. Rows with a null id are left out, of
    rows that repeat an id the least text counts: such rows are one document.
    """
    docs = C.unique_texts(df, id_col, text_col)
    again = repeated_chunks(docs)

    def run(batches):
        for b in batches:
            for lo in range(0, b.num_rows, 512):
                part = b.slice(lo, 512)
                data, off = C.utf8(part.column("text"))
                out = {k: [] for k in ("n_bytes", "n_repeated_chunks", "n_removed", "spans", "kept")}
                for k, again in enumerate(part.column("again")):
                    raw = data[off[k]:off[k + 1]]
                    at = np.asarray(again.values) if again.is_valid else np.zeros(0, np.int64)
                    start, end = at >> 32, (at >> 32) + (at & 0xFFFFFFFF)
                    head = np.flatnonzero(np.append(True, start[1:] != end[:-1])[:len(at)])
                    runs = list(zip(start[head], end[np.append(head[1:], len(at)) - 1])) if len(at) else []
                    runs = [(int(s), int(e)) for s, e in runs if e - s >= min_run or e - s == len(raw)]
                    keep = np.ones(len(raw), bool)
                    for s, e in runs:
                        keep[s:e] = False
                    for c, v in (("n_bytes", len(raw)), ("n_repeated_chunks", len(at)), ("n_removed", len(raw) - int(keep.sum())),
                                 ("spans", [{"start": s, "end": e} for s, e in runs]), ("kept", raw[keep].tobytes())):
                        out[c].append(v)
                span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
                kinds = {"spans": span, "kept": pa.binary()}
                yield pa.RecordBatch.from_arrays([part.column("id"), *(pa.array(v, kinds.get(c, pa.int64())) for c, v in out.items())],
                                                 names=["id", *out])

    rows = docs.join(again, "id", "left").select("id", "text", "again").mapInArrow(
        run, "id long, n_bytes long, n_repeated_chunks long, n_removed long, spans array<struct<start:long,end:long>>, kept binary")
    return rows.withColumnRenamed("id", id_col)
