"""Operator 11: alignment of two tokenizers by inverted pair bitmaps.

Both tokenizers cut a text's bytes; tokens of one that overlap tokens of the
other are linked. Neither tokenizer joins across a space that follows a
non-white character, so a text is looked up chunk by chunk, and a chunk's
tokens, groups and links are found once a task and kept.

Documents are numbered within blocks of bounded text. For each (A id, B id)
pair a block has one posting: compressed bitmaps of its documents, one per
binary digit of the multiplicity (plane k holds the documents whose number of
links has bit k). The planes OR-merged and popcounted give the pair's
documents, the planes' popcounts weighted by 2^k its links. Counts over all
blocks go back to the postings, which return every document its scores.
"""

from __future__ import annotations

import hashlib
import os
import re
from array import array
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import StructType

from tidemark.llm.common import Scratch
from tidemark.llm.sentencepieces import BYTE, MARK, NORMAL, Pieces
from tidemark.session import freeze

BLOCK_BYTES, BLOCK_ROWS = 8 << 20, 1 << 13
KEPT_CHUNKS = 400_000
CHUNK = re.compile(r"\s*\S+(?:[^\S ]\s*\S*)*|\s+").findall  # each begins at a space that follows a non-white character, or at the start


def byte_letters() -> dict[str, int]:
    """The byte that each letter of a byte-level vocabulary stands for."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


class Aligner:
    """Token ids, groups and links of chunks under a byte-level tokenizer A (JSON) and a byte-pair piece model B (bytes).

    Texts are those with one space put in front. A must be byte-level without
    normaliser and prefix space, no piece of B may hold white space but leading
    marks (ValueError).
    """

    def __init__(self, a_json: str, b_model: bytes):
        import json

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        made = json.loads(a_json)
        pre = made["pre_tokenizer"] or {}
        if made["normalizer"] or pre.get("type") != "ByteLevel" or pre.get("add_prefix_space") or not pre.get("use_regex", True):
            raise ValueError("not a byte-level tokenizer without normaliser and prefix space")
        self.a, self.b = Tokenizer.from_str(a_json), Pieces(b_model)
        self.a.encode_special_tokens = True
        if self.b.map or self.b.squeeze or not self.b.dummy or not self.b.words_apart:
            raise ValueError("pieces join words, or texts are normalised")
        letters = byte_letters()
        self.a_bytes = {i: bytes(letters[c] for c in s) if all(c in letters for c in s) else s.encode() for s, i in self.a.get_vocab().items()}
        self.b_bytes = [s if k in (NORMAL, BYTE) else b"" for s, k in zip(self.b.surface, self.b.kind)]
        self.reset()

    def reset(self) -> None:
        self.known: dict[str, int] = {}
        self.counts = array("q")  # by chunk: tokens of A, of B, groups, links; -1 where a chunk's bytes differ
        self.text: list[bytes] = []
        self.pairs: list[bytes] = []  # A id << 32 | B id of each link, as int64

    def chunks(self, text: str) -> list[str]:
        return CHUNK(" " + text)

    def learn(self, chunks: set[str]) -> None:
        """Looks up chunks not yet known."""
        new = [c for c in chunks if c not in self.known]
        for c, a, b in zip(new, self.a.encode_batch(new, add_special_tokens=False), self.b.merge([c.replace(" ", MARK) for c in new], num_threads=1)):
            self.known[c] = len(self.text)
            self._add(c.encode(), a.ids, b)

    def _add(self, raw: bytes, a: list[int], b: list[int]) -> None:
        x, y = [self.a_bytes[i] for i in a], [self.b_bytes[i] for i in b]
        if b"".join(x) != raw or b"".join(y) != raw:
            self.counts.extend((-1, 0, 0, 0))
            self.text.append(b"")
            self.pairs.append(b"")
            return
        ends_a, ends_b = list(accumulate(map(len, x))), list(accumulate(map(len, y)))
        text, pairs, i, j, from_i, from_j, groups = [], array("q"), 0, 0, 0, 0, 0
        while True:
            pairs.append(a[i] << 32 | b[j])
            d = ends_a[i] - ends_b[j]
            i, j = i + (d <= 0), j + (d >= 0)
            if d == 0:
                groups += 1
                text.append(f"{a[from_i]}|{b[from_j]}" if i == from_i + 1 and j == from_j + 1 else
                            f"{','.join(map(str, a[from_i:i]))}|{','.join(map(str, b[from_j:j]))}")
                if i == len(a):
                    break
                from_i, from_j = i, j
        self.counts.extend((len(a), len(b), groups, len(pairs)))
        self.text.append(";".join(text).encode())
        self.pairs.append(pairs.tobytes())


def packed_planes(doc: np.ndarray, times: np.ndarray, first: np.ndarray) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """For each pair (rows from ``first[k]`` on, sorted by document) its planes as bytes, its documents and its links.

    A plane is its number of documents in two bytes (0 for 65,536 never occurs:
    a block has fewer), then their numbers in two bytes each, or a bitmap of the
    block where that is shorter.
    """
    ends = np.append(first[1:], len(doc))
    links = np.add.reduceat(times, first) if len(first) else np.zeros(0, np.int64)
    most = np.maximum.reduceat(times, first) if len(first) else np.zeros(0, np.int64)
    low = doc.astype("<u2")
    raw = low.tobytes()
    out = []
    for s, e, top in zip(first.tolist(), ends.tolist(), most.tolist()):
        if top == 1 and e - s <= BLOCK_ROWS // 16:
            out.append(b"\1" + (e - s).to_bytes(2, "little") + raw[2 * s:2 * e])
            continue
        planes = [bytes([top.bit_length()])]
        for k in range(top.bit_length()):
            at = low[s:e][times[s:e] >> k & 1 == 1]
            planes.append(len(at).to_bytes(2, "little"))
            if len(at) <= BLOCK_ROWS // 16:
                planes.append(at.tobytes())
            else:
                bits = np.zeros(BLOCK_ROWS, np.uint8)
                bits[at] = 1
                planes.append(np.packbits(bits).tobytes())
        out.append(b"".join(planes))
    return out, ends - first, links


def unpacked_planes(data: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(pair, document, 2^k) of every bit of the planes that begin at ``start``."""
    pair, doc, weight = [], [], []
    levels, at, rows = data[start].astype(np.int64), start + 1, np.arange(len(start))
    for k in range(int(levels.max(initial=0))):
        live = levels > k
        levels, at, rows = levels[live], at[live], rows[live]
        n = data[at].astype(np.int64) | data[at + 1].astype(np.int64) << 8
        at = at + 2
        few = n <= BLOCK_ROWS // 16
        m, base = n[few], at[few]
        step = np.arange(m.sum()) - np.repeat(np.cumsum(m) - m, m)
        where = np.repeat(base, m) + 2 * step
        pair.append(np.repeat(rows[few], m))
        doc.append(data[where].astype(np.int64) | data[where + 1].astype(np.int64) << 8)
        weight.append(np.full(len(where), 1 << k, np.int64))
        for r, p in zip(rows[~few].tolist(), at[~few].tolist()):
            d = np.flatnonzero(np.unpackbits(data[p:p + BLOCK_ROWS // 8]))
            pair.append(np.full(len(d), r))
            doc.append(d)
            weight.append(np.full(len(d), 1 << k, np.int64))
        at = at + np.where(few, 2 * n, BLOCK_ROWS // 8)
    if not pair:
        return (np.zeros(0, np.int64),) * 3
    return np.concatenate(pair), np.concatenate(doc), np.concatenate(weight)


def _read(path: str) -> bytes:
    with open(path, "rb") as f:
        return f.read()


OWN = "n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, _block long, _low int, _pair long, _docs long, _links long, _planes binary"


def encoded(df: DataFrame, a_path: str, b_path: str, keep: list[Column | str], text_col: str = "text") -> DataFrame:
    """Rows of two kinds: every document's counts and digest (``_pair`` null), and the postings of every block (``_pair`` set)."""
    rows = df.select(*keep, F.col(text_col).cast("string").alias("_text"))
    names = rows.columns[:-1]
    files = df.sparkSession.sparkContext.broadcast((_read(a_path).decode(), _read(b_path)))
    spec = StructType([type(f)(f.name, f.dataType, True) for f in rows.schema.fields[:-1]])
    for f in StructType.fromDDL(OWN):
        spec = spec.add(f)

    def run(batches):
        aligner = Aligner(*files.value)
        part, block = TaskContext.get().partitionId() << 32, 0
        low, size = 0, 0
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []  # document, chunk, times

        def postings():
            if not held:
                return
            doc, chunk, times = (np.concatenate(x) for x in zip(*held))
            held.clear()
            used, chunk = np.unique(chunk, return_inverse=True)
            found = [aligner.pairs[k] for k in used.tolist()]
            long = np.array([len(p) for p in found], np.int64) // 8
            own = long[chunk]
            flat = np.frombuffer(b"".join(found), np.int64)
            begin = (np.cumsum(long) - long)[chunk]
            where = np.repeat(begin, own) + np.arange(own.sum()) - np.repeat(np.cumsum(own) - own, own)
            names_, code = np.unique(flat, return_inverse=True)
            key = code[where] * BLOCK_ROWS + np.repeat(doc, own)
            weight = np.repeat(times, own)
            order = np.argsort(key)
            key, weight = key[order], weight[order]
            first = np.flatnonzero(np.append(True, key[1:] != key[:-1])) if len(key) else np.zeros(0, np.int64)
            weight = np.add.reduceat(weight, first) if len(first) else weight
            key = key[first]
            pair, doc = key // BLOCK_ROWS, key % BLOCK_ROWS
            first = np.flatnonzero(np.append(True, pair[1:] != pair[:-1])) if len(pair) else np.zeros(0, np.int64)
            planes, docs, links = packed_planes(doc, weight, first)
            name = names_[pair[first]]
            for lo in range(0, len(first), 100_000):
                hi = min(lo + 100_000, len(first))
                n = hi - lo
                blank = [pa.nulls(n, t) for t in kept_types]
                yield pa.RecordBatch.from_arrays(
                    [*blank, *(pa.nulls(n, pa.int64()) for _ in range(4)), pa.nulls(n, pa.string()), pa.array(np.full(n, part + block)), pa.nulls(n, pa.int32()),
                     pa.array(name[lo:hi]), pa.array(docs[lo:hi]), pa.array(links[lo:hi]), pa.array(planes[lo:hi], pa.binary())], names=fields)

        kept_types = None
        for batch in batches:
            kept_types = kept_types or [batch.column(k).type for k in range(len(names))]
            for lo in range(0, batch.num_rows, 256):
                piece = batch.slice(lo, 256)
                texts = piece.column(len(names)).to_pylist()
                split = [aligner.chunks(t) if t else [] for t in texts]
                aligner.learn({c for s in split for c in s})
                known, counts = aligner.known, np.array(aligner.counts).reshape(-1, 4)
                got, blocks, lows = [], [], []
                for t, s in zip(texts, split):
                    if low >= BLOCK_ROWS or low and size + len(t or "") > BLOCK_BYTES:
                        yield from postings()
                        block, low, size = block + 1, 0, 0
                    at = np.fromiter(map(known.__getitem__, s), np.int64, len(s))
                    total = counts[at]
                    if len(s) and (total[:, 0] >= 0).all():
                        sha = hashlib.sha256(b";".join([aligner.text[k] for k in at.tolist()])).hexdigest()
                        got.append((*total.sum(0).tolist(), sha))
                        c, n = np.unique(at, return_counts=True)
                        held.append((np.full(len(c), low), c, n))
                    else:
                        got.append((0, 0, 0, 0, ""))
                    blocks.append(part + block)
                    lows.append(low)
                    low, size = low + 1, size + len(t or "")
                columns = [pa.array(c, t) for c, t in zip(zip(*got), [pa.int64()] * 4 + [pa.string()])]
                n = piece.num_rows
                yield pa.RecordBatch.from_arrays(
                    [*(piece.column(k) for k in range(len(names))), *columns, pa.array(blocks, pa.int64()), pa.array(lows, pa.int32()),
                     *(pa.nulls(n, pa.int64()) for _ in range(3)), pa.nulls(n, pa.binary())], names=fields)
                if len(aligner.known) > KEPT_CHUNKS:  # the open block still needs the table, so the block ends here
                    yield from postings()
                    block, low, size = block + 1, 0, 0
                    aligner.reset()
        yield from postings()

    fields = spec.names
    return rows.mapInArrow(run, spec)


def pair_counts(postings: DataFrame) -> DataFrame:
    """(pair, a_id, b_id, documents, links, best): of every linked pair of ids; best where no pair of this B id has more links.

    The highest counts by B id are broadcast: one row per id of B's vocabulary at most.
    """
    total = postings.groupBy(F.col("_pair").alias("pair")).agg(F.sum("_docs").alias("documents"), F.sum("_links").alias("links"))
    b_id = F.col("pair").bitwiseAND(0xFFFFFFFF)
    total = freeze(total.select("pair", F.shiftright("pair", 32).alias("a_id"), b_id.alias("b_id"), "documents", "links"))
    top = total.groupBy("b_id").agg(F.max("links").alias("top"))
    return total.join(F.broadcast(top), "b_id").select("pair", "a_id", "b_id", "documents", "links", (F.col("links") == F.col("top")).alias("best"))


def scores(postings: DataFrame, counts: DataFrame) -> DataFrame:
    """(_block, _low, n_best, count_sum) of every document with links, from its postings and the counts of their pairs."""
    back = postings.select("_pair", "_block", "_planes").join(counts.select(F.col("pair").alias("_pair"), "links", "best"), "_pair").drop("_pair")

    def run(key, table):
        table = table.combine_chunks()
        column = table.column("_planes").combine_chunks()
        if isinstance(column, pa.ChunkedArray):
            column = column.chunk(0)
        kind = np.int64 if str(column.type).startswith("large") else np.int32
        start = np.frombuffer(column.buffers()[1], kind)[column.offset:column.offset + len(column)].astype(np.int64)
        data = np.frombuffer(column.buffers()[2], np.uint8)
        links, best = table.column("links").to_numpy(), table.column("best").to_numpy().astype(np.int64)
        n_best, count_sum, seen = np.zeros(BLOCK_ROWS, np.int64), np.zeros(BLOCK_ROWS, np.int64), np.zeros(BLOCK_ROWS, bool)
        for lo in range(0, len(start), 50_000):
            pair, doc, weight = unpacked_planes(data, start[lo:lo + 50_000])
            np.add.at(count_sum, doc, weight * links[lo + pair])
            np.add.at(n_best, doc, weight * best[lo + pair])
            seen[doc] = True
        at = np.flatnonzero(seen)
        return pa.table({"_block": pa.array(np.full(len(at), key[0].as_py())), "_low": pa.array(at.astype(np.int32)),
                         "n_best": pa.array(n_best[at]), "count_sum": pa.array(count_sum[at])})

    return back.groupBy("_block").applyInArrow(run, "_block long, _low int, n_best long, count_sum long")


def align(df: DataFrame, a_path: str, b_path: str, keep: list[Column | str], text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """``keep`` (columns of ``df``) with each document's alignment and scores, and the table of pairs (``pair_counts``).

    Documents have n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256.
    Null and empty texts, and texts that either tokenizer doesn't give back byte
    for byte (such as those with U+2581), have zeros, '' and no links. Every row
    is a document of its own: rows that repeat an id or a text count each.
    Ties of the highest count all are best. An empty table gives two empty
    tables. ``keep`` may hold any columns but the result's (ValueError).
    """
    own = {f.name for f in StructType.fromDDL(OWN)} | {"n_best", "count_sum"}
    if own & {n.lower() for n in df.select(*keep).columns}:
        raise ValueError("kept columns have names of the result")
    both = Scratch(df.sparkSession).put("postings", encoded(df, a_path, b_path, keep, text_col))
    postings = both.where("_pair IS NOT NULL").select("_pair", "_block", "_docs", "_links", "_planes")
    counts = freeze(pair_counts(postings))
    names = [c for c in both.columns if not c.startswith("_")]
    docs = both.where("_pair IS NULL").select(*names, "_block", "_low")
    zero = [F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in ("n_best", "count_sum")]
    return docs.join(scores(postings, counts), ["_block", "_low"], "left").select(*names, *zero), counts


def aligned_groups(df: DataFrame, a_path: str, b_path: str, keep: list[Column | str], text_col: str = "text") -> DataFrame:
    """``keep`` with groups: the alignment itself, ``a1,a2|b1;a3|b2,b3``; '' for texts without tokens."""
    rows = df.select(*keep, F.col(text_col).cast("string").alias("_text"))
    names = rows.columns[:-1]
    files = df.sparkSession.sparkContext.broadcast((_read(a_path).decode(), _read(b_path)))

    def run(batches):
        aligner = Aligner(*files.value)
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                part = batch.slice(lo, 256)
                split = [aligner.chunks(t) if t else [] for t in part.column(len(names)).to_pylist()]
                if len(aligner.known) > KEPT_CHUNKS:
                    aligner.reset()
                aligner.learn({c for s in split for c in s})
                at = [[aligner.known[c] for c in s] for s in split]
                text = [b";".join([aligner.text[k] for k in x]).decode() if all(aligner.counts[4 * k] >= 0 for k in x) else "" for x in at]
                yield pa.RecordBatch.from_arrays([*(part.column(k) for k in range(len(names))), pa.array(text, pa.string())], names=[*names, "groups"])

    return rows.mapInArrow(run, StructType(rows.schema.fields[:-1]).add("groups", "string"))
