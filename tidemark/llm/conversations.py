"""Operator 12: conversation structure repair by run-length dynamic programming.

Every row becomes a symbol: its role's initial and its first fault. Sorted rows
fall into fragments (the rows of one conversation in one range partition), equal
consecutive symbols into runs. A symbol is a min-plus matrix over the states of
the legal role pattern ``(s?(ua)+)?``, a run a power of it by cached squares, a
fragment the product of its runs. Fragments of a conversation are folded from
its end to the cheapest cost still to come; each fragment then unrolls the
choices of its rows on its own, for every state it may be entered in. So a
conversation of any length is judged in as many tasks as it has partitions;
only the repaired rows themselves stream through one task per conversation, in
order and batch by batch.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import LongType, StringType, StructType

from tidemark.llm.common import Scratch
from tidemark.session import freeze

ROLE = {"s": "system", "u": "user", "a": "assistant"}
WHITE = r"\x20\x09-\x0D"
OK, BLANK, DUPLICATE, TRUNCATED = range(4)
INITIALS = "suao"  # o stands for any other role
KEEP, REROLE, DELETE, INSERT, CUT = 0, 1, 2, 5, 5  # costs; CUT is what an undeleted truncated row adds
START, SYSTEM, USER, ASSISTANT = range(4)  # states: nothing yet, and the role that came last
FOLLOW = {(START, "s"): SYSTEM, (START, "u"): USER, (SYSTEM, "u"): USER, (USER, "a"): ASSISTANT, (ASSISTANT, "u"): USER}
NEXT = {START: "u", SYSTEM: "u", USER: "a", ASSISTANT: "u"}  # the one role that a new or changed row can have in a state
AFTER = [FOLLOW[q, NEXT[q]] for q in range(4)]
END = [0, 2 * INSERT, INSERT, 0]  # cost of ending in a state
INF = 1 << 60
FRAGMENT = 1 << 20  # rows after which a fragment ends
SQUARES = 62


def damaged(df: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text) with the damage that crc32 of ``conv_id:turn`` modulo 20 deals to each row.

    0 drops it, 1 empties the text, 2 removes its sentence ends, 3 repeats the
    row, 4 makes the role user. A null counts as one space, but conv_id and
    turn stay null in the result.
    """
    key = F.concat_ws(":", *(F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn")))
    deal = F.crc32(key.cast("binary")) % 20
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("role", "text"))
    rows = df.select("conv_id", F.col("turn").cast("long").alias("turn"), role.alias("role"), text.alias("text"), deal.alias("deal")).where("deal <> 0")
    times = F.when(F.col("deal") == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))
    return rows.select("conv_id", "turn", F.when(F.col("deal") == 4, "user").otherwise(F.col("role")).alias("role"),
                       F.when(F.col("deal") == 1, "").when(F.col("deal") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text")).alias("text"),
                       F.explode(times).alias("copy")).drop("copy")


def _key() -> list[Column]:
    return [F.col(c).asc_nulls_first() for c in ("conv_id", "turn", "role", "digest")]


def _plain(df: DataFrame) -> DataFrame:
    """The four columns without null role or text, and the text's 128-bit digest."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(" "))
    return df.select("conv_id", F.col("turn").cast("long").alias("turn"), F.coalesce(F.col("role").cast("string"), F.lit(" ")).alias("role"),
                     text.alias("text"), F.unhex(F.md5(text)).alias("digest"))


def marked(rows: DataFrame) -> DataFrame:
    """Stacks of equal rows: (conv_id, turn, role, digest, initial, fault, n).

    ``fault`` is that of the stack's first row; the others are its duplicates
    unless blank. Equal rows are counted before they are shuffled, the earliest
    turn of each (conversation, role, text) is a grouped minimum joined back.
    """
    seen = F.regexp_replace("text", f"[{WHITE}]+$", "")
    initial = F.substring("role", 1, 1)
    one = rows.select("conv_id", "turn", "role", "digest", F.when(initial.isin("s", "u", "a"), initial).otherwise("o").alias("initial"),
                      F.when(~F.col("text").rlike(f"[^{WHITE}]"), BLANK).when(~F.right(seen, F.lit(1)).isin(".", "!", "?"), TRUNCATED).otherwise(OK).alias("own"))
    stacks = one.groupBy("conv_id", "turn", "role", "digest", "initial", "own").agg(F.count(F.lit(1)).alias("n"))
    first = stacks.groupBy(F.col("conv_id").alias("c"), F.col("role").alias("r"), F.col("digest").alias("d")).agg(F.min(F.struct("turn")).alias("first"))
    same = F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("role") == F.col("r")) & (F.col("digest") == F.col("d"))
    fault = F.when(F.col("own") == BLANK, BLANK).when(~F.col("turn").eqNullSafe(F.col("first.turn")), DUPLICATE).otherwise(F.col("own"))
    return stacks.join(first, same).select("conv_id", "turn", "role", "digest", "initial", fault.alias("fault"), "n")


def step(symbol: int) -> np.ndarray:
    """Min-plus matrix of one row with this symbol (4 * initial + fault), insertions before it included."""
    initial, fault = INITIALS[symbol >> 2], symbol & 3
    row = np.full((4, 4), INF, np.int64)
    extra = CUT * (fault == TRUNCATED)
    for q in range(4):
        row[q, q] = DELETE
        if fault not in (BLANK, DUPLICATE):
            row[q, AFTER[q]] = min(row[q, AFTER[q]], REROLE + extra)
            kept = FOLLOW.get((q, initial))
            if kept is not None:
                row[q, kept] = min(row[q, kept], KEEP + extra)
    insert = np.full((4, 4), INF, np.int64)
    for q in range(4):
        at, cost = q, 0
        for _ in range(4):
            insert[q, at] = min(insert[q, at], cost)
            at, cost = AFTER[at], cost + INSERT
    return product(insert, row)


def product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.minimum((a[:, :, None] + b[None, :, :]).min(1), INF)


class Powers:
    """Binary powers of every symbol's matrix, squared when first asked for."""

    def __init__(self):
        self.squares: dict[int, list[np.ndarray]] = {}

    def over(self, symbol: int, length: int) -> Iterator[np.ndarray]:
        known = self.squares.setdefault(symbol, [step(symbol)])
        for k in range(length.bit_length()):
            if k == len(known):
                known.append(product(known[-1], known[-1]))
            if length >> k & 1:
                yield known[k]

    def of(self, symbols: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """The product over runs, in order."""
        out = np.where(np.eye(4, dtype=bool), 0, INF).astype(np.int64)
        for s, n in zip(symbols.tolist(), lengths.tolist()):
            for m in self.over(s, n):
                out = product(out, m)
        return out

    def back(self, symbol: int, length: int, cost: np.ndarray) -> np.ndarray:
        """Cost to come before a run, from that behind it."""
        for m in self.over(symbol, length):
            cost = (m + cost[None, :]).min(1)
        return np.minimum(cost, INF)


def unroll(symbols: np.ndarray, lengths: np.ndarray, cost: np.ndarray, last: bool, entries: tuple[int, ...], powers: Powers) -> list[tuple[str, int] | None]:
    """For each entry state the least cheapest string of edits and the state after it.

    ``cost`` is the cost to come by state behind the last row. The state follows
    from the letters, so the least letter that keeps the cost is taken each time.
    """
    symbols, lengths = symbols.tolist(), lengths.tolist()
    behind = [cost]
    for s, n in zip(reversed(symbols), reversed(lengths)):
        behind.append(powers.back(s, n, behind[-1]))
    behind.reverse()
    out: list[tuple[str, int] | None] = []
    inside: dict[int, list[list[int]]] = {}
    for q in entries:
        letters = []
        if behind[0][q] >= INF:
            out.append(None)
            continue
        for r, (s, n) in enumerate(zip(symbols, lengths)):
            initial, fault = INITIALS[s >> 2], s & 3
            if fault in (BLANK, DUPLICATE):
                letters.append("D" * n)
                continue
            if r not in inside:
                rows, m = [behind[r + 1]], step(s)
                for _ in range(n):
                    rows.append((m + rows[-1][None, :]).min(1))
                inside[r] = [v.tolist() for v in reversed(rows)]
            extra = CUT * (fault == TRUNCATED)
            for k in range(n):
                now, then = inside[r][k], inside[r][k + 1]
                while True:
                    kept = FOLLOW.get((q, initial))
                    if DELETE + then[q] == now[q]:
                        letters.append("D")
                    elif INSERT + now[AFTER[q]] == now[q]:
                        letters.append("I")
                        q = AFTER[q]
                        continue
                    elif kept is not None and KEEP + extra + then[kept] == now[q]:
                        letters.append("K")
                        q = kept
                    else:
                        letters.append("R")
                        q = AFTER[q]
                    break
        while last and END[q]:
            letters.append("I")
            q = AFTER[q]
        out.append(("".join(letters), q))
    return out


FRAGMENTS = ("piece long, turn long, role string, digest binary, symbols binary, lengths binary, matrix array<long>, blank long, duplicate long, "
             "truncated long, illegal long, head string, tail string, low long, high long, turns long, from_turn long, to_turn long")


def fragments(stacks: DataFrame, longest: int = FRAGMENT) -> DataFrame:
    """Runs, counts and min-plus matrix of every conversation's rows in every range partition.

    A fragment ends with its partition, its conversation, or after ``longest``
    stacks; ``piece`` orders the fragments of a conversation.
    """
    rows = stacks.repartitionByRange(*_key()).sortWithinPartitions(*_key())
    conv = rows.schema["conv_id"]
    rows = rows.withColumn("part", F.spark_partition_id())
    spec = StructType([conv])
    for f in StructType.fromDDL(FRAGMENTS):
        spec = spec.add(f)
    names = [f.name for f in spec]

    def run(batches):
        powers, known = Powers(), {}
        held: list[dict] = []  # stacks of the open fragment
        number, part = 0, 0

        def closed() -> dict:
            nonlocal number
            symbols, lengths = [], []

            def add(s, n):
                if symbols and symbols[-1] == s:
                    lengths[-1] += n
                else:
                    symbols.append(s)
                    lengths.append(n)

            count, illegal, chain = [0, 0, 0, 0], 0, ""
            turns = [r["turn"] for r in held if r["turn"] is not None]
            for r in held:
                i = INITIALS.index(r["initial"])
                add(4 * i + r["fault"], 1)
                count[r["fault"]] += 1
                if r["n"] > 1:
                    rest = BLANK if r["fault"] == BLANK else DUPLICATE
                    add(4 * i + rest, r["n"] - 1)
                    count[rest] += r["n"] - 1
                illegal += (chain != "" and chain + r["initial"] not in ("su", "ua", "au")) + (r["n"] - 1)
                chain = r["initial"]
            key = (bytes(symbols), tuple(lengths))
            if key not in known:
                if len(known) > 10_000:
                    known.clear()
                known[key] = powers.of(np.array(symbols), np.array(lengths)).ravel().tolist()
            a, z = held[0], held[-1]
            number += 1
            return {"conv_id": a["conv_id"], "piece": (part << 32) + number, "turn": a["turn"], "role": a["role"], "digest": a["digest"],
                    "symbols": key[0], "lengths": np.array(lengths, np.int64).tobytes(), "matrix": known[key], "blank": count[BLANK],
                    "duplicate": count[DUPLICATE], "truncated": count[TRUNCATED], "illegal": illegal, "head": a["initial"], "tail": z["initial"],
                    "low": turns[0] if turns else None, "high": turns[-1] if turns else None, "turns": len(set(turns)),
                    "from_turn": a["turn"], "to_turn": z["turn"]}

        for batch in batches:
            done = []
            for r in batch.to_pylist():
                if held and (r["conv_id"] != held[0]["conv_id"] or len(held) >= longest):
                    done.append(closed())
                    held.clear()
                part = r["part"]
                held.append(r)
            yield pa.RecordBatch.from_pylist(done, schema=arrow)
        if held:
            yield pa.RecordBatch.from_pylist([closed()], schema=arrow)

    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(spec)
    return rows.mapInArrow(run, spec).select(*names)


def folded(pieces: DataFrame) -> DataFrame:
    """One row per fragment: the cost to come behind it, whether it is first or last, and the conversation's counts and cost.

    Meets the fragments of a conversation, a few numbers each, not its rows.
    """
    conv = pieces.schema["conv_id"]
    few = pieces.select("conv_id", "piece", "matrix", "blank", "duplicate", "truncated", "illegal", "head", "tail", "low", "high", "turns", "from_turn", "to_turn")
    spec = StructType([conv])
    for f in StructType.fromDDL("piece long, cost array<long>, is_first boolean, is_last boolean, gaps long, blank long, duplicate long, truncated long, illegal long, total long"):
        spec = spec.add(f)

    def fold(key, table):
        rows = sorted(table.to_pylist(), key=lambda r: r["piece"])
        cost, out = np.array(END, np.int64), []
        for r in reversed(rows):
            out.append({"conv_id": key[0].as_py(), "piece": r["piece"], "cost": cost.tolist(), "is_first": False, "is_last": not out})
            cost = np.minimum((np.array(r["matrix"]).reshape(4, 4) + cost[None, :]).min(1), INF)
        out[-1]["is_first"] = True
        turns = [r for r in rows if r["low"] is not None]
        whole = {k: sum(r[k] for r in rows) for k in ("blank", "duplicate", "truncated", "illegal")}
        whole["illegal"] += sum(a["tail"] + b["head"] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:]))
        distinct = sum(r["turns"] for r in rows) - sum(a["to_turn"] is not None and a["to_turn"] == b["from_turn"] for a, b in zip(rows, rows[1:]))
        whole["gaps"] = turns[-1]["high"] - turns[0]["low"] + 1 - distinct if turns else 0
        return pa.Table.from_pylist([o | whole | {"total": int(cost[START])} for o in out], schema=arrow)

    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(spec)
    return few.groupBy("conv_id").applyInArrow(fold, spec)


def choices(pieces: DataFrame, costs: DataFrame) -> DataFrame:
    """(conv_id, turn, role, digest, edits, exits): each fragment's edits for every state it may be entered in, at its first row's key."""
    c = costs.select(F.col("piece").alias("p"), "cost", "is_first", "is_last")
    rows = pieces.select("conv_id", "piece", "turn", "role", "digest", "symbols", "lengths").join(c, F.col("piece") == F.col("p"))
    rows = rows.select("conv_id", "turn", "role", "digest", "symbols", "lengths", "cost", "is_first", "is_last")
    spec = StructType(rows.schema.fields[:4] + StructType.fromDDL("edits array<string>, exits array<int>").fields)

    def run(batches):
        powers, known = Powers(), {}
        for batch in batches:
            edits, exits = [], []
            for r in batch.select(range(4, 9)).to_pylist():
                key = tuple(map(str, r.values()))
                if key not in known:
                    if len(known) > 10_000:
                        known.clear()
                    entries = (START,) if r["is_first"] else tuple(range(4))
                    known[key] = unroll(np.frombuffer(r["symbols"], np.uint8), np.frombuffer(r["lengths"], np.int64),
                                        np.array(r["cost"], np.int64), r["is_last"], entries, powers)
                edits.append([g[0] if g else None for g in known[key]])
                exits.append([g[1] if g else None for g in known[key]])
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in range(4)), pa.array(edits, pa.list_(pa.string())), pa.array(exits, pa.list_(pa.int32()))],
                                             names=["conv_id", "turn", "role", "digest", "edits", "exits"])

    return rows.mapInArrow(run, spec)


def edited(rows: DataFrame, chosen: DataFrame) -> DataFrame:
    """(conv_id, position, edit, turn, role, text): every row with its edit (K, R, D) and every inserted one (I).

    Positions count from 0. A conversation's rows lie in one partition in
    order; they stream through their task, which holds one batch and one
    fragment's letters.
    """
    nothing = F.lit(None)
    both = (chosen.select("conv_id", "turn", "role", "digest", F.lit(0).alias("kind"), nothing.cast("string").alias("text"), "edits", "exits")
            .unionAll(rows.select("conv_id", "turn", "role", "digest", F.lit(1).alias("kind"), "text",
                                  nothing.cast("array<string>").alias("edits"), nothing.cast("array<int>").alias("exits"))))
    both = both.repartition("conv_id").sortWithinPartitions(*_key(), "kind")
    spec = StructType([rows.schema["conv_id"]])
    for f in StructType.fromDDL("position long, edit string, turn long, role string, text string"):
        spec = spec.add(f)

    def run(batches):
        conv, letters, at, state, position = None, "", 0, START, 0
        entry = START
        out: list[tuple] = []

        def inserts():
            nonlocal at, state, position
            while at < len(letters) and letters[at] == "I":
                out.append((conv, position, "I", None, ROLE[NEXT[state]], ""))
                state, at, position = AFTER[state], at + 1, position + 1

        for batch in batches:
            for lo in range(0, batch.num_rows, 1024):
                for r in batch.slice(lo, 1024).to_pylist():
                    if r["kind"] == 0:
                        inserts()
                        first = len(r["edits"]) == 1
                        if first:
                            entry = state = START
                            position = 0
                        conv, at = r["conv_id"], 0
                        k = 0 if first else entry
                        letters, entry = r["edits"][k], r["exits"][k]
                        continue
                    inserts()
                    e, role = letters[at], r["role"]
                    if e == "K":
                        state = FOLLOW[state, role[:1]]
                    elif e == "R":
                        role, state = ROLE[NEXT[state]], AFTER[state]
                    out.append((conv, position, e, r["turn"], role, r["text"]))
                    at, position = at + 1, position + 1
                yield _columns(out, arrow)
                out.clear()
        inserts()
        yield _columns(out, arrow)

    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(spec)
    return both.mapInArrow(run, spec)


def _columns(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = list(zip(*rows)) or [()] * len(schema)
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)


def digests(rows: DataFrame) -> DataFrame:
    """(conv_id, audit, repaired_sha256) of ``edited`` rows, as they come: each conversation whole and in order."""
    spec = StructType([rows.schema["conv_id"]]).add("audit", StringType()).add("repaired_sha256", StringType())

    def run(batches):
        conv, letters, sha, some = None, None, None, False
        out: list[tuple] = []
        for batch in batches:
            for c, p, e, _, role, text in zip(*(batch.column(k).to_pylist() for k in range(6))):
                if p == 0:
                    if letters is not None:
                        out.append((conv, "".join(letters), sha.hexdigest()))
                    conv, letters, sha, some = c, [], hashlib.sha256(), False
                letters.append(e)
                if e != "D":
                    sha.update(f"{'\n' * some}{role}:{text}".encode())
                    some = True
            yield _columns(out, arrow)
            out.clear()
        if letters is not None:
            yield _columns([(conv, "".join(letters), sha.hexdigest())], arrow)

    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(spec)
    return rows.mapInArrow(run, spec)


def repair(df: DataFrame, longest: int = FRAGMENT) -> tuple[DataFrame, DataFrame]:
    """The repaired rows (``edited``) and the counts per conversation of (conv_id, turn, role, text).

    Rows go by turn, nulls first; rows of one turn by role, then by the digest
    of the text, so ties and repeated rows have one order. A null role or text
    is one space. A null conv_id is a conversation of its own. Empty and white
    texts are blank; texts of any length stream. Of several cheapest edits the
    least string counts. An empty table gives two empty tables; other columns
    play no part.
    """
    rows, scratch = _plain(df), Scratch(df.sparkSession)
    pieces = scratch.put("fragments", fragments(marked(rows), longest))
    costs = freeze(folded(pieces))
    chosen = freeze(choices(pieces, costs))
    scratch.drop("fragments")
    counts = costs.where("is_last").select("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", F.col("total").alias("cost"))
    return edited(rows, chosen), counts


def repair_report(df: DataFrame, ids: DataFrame, longest: int = FRAGMENT) -> DataFrame:
    """One row per conversation of ``ids`` (conv_id): counts, cost, audit and digest of the repaired rows of ``df``.

    A conversation without rows has zeros, an empty audit and the digest of nothing.
    """
    rows, counts = repair(df, longest)
    report = counts.join(digests(rows).withColumnRenamed("conv_id", "c"), F.col("conv_id").eqNullSafe(F.col("c"))).drop("c")
    whole = ids.select(F.col("conv_id").alias("k")).distinct().join(report, F.col("k").eqNullSafe(F.col("conv_id")), "left").drop("conv_id")
    zeros = [F.coalesce(c, F.lit(0).cast(LongType())).alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return whole.select(F.col("k").alias("conv_id"), *zeros, F.coalesce("audit", F.lit("")).alias("audit"),
                        F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"))
