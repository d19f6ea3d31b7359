"""Operator 1: masked pseudo-likelihood of documents under a bidirectional window network.

Each word is predicted from the two words before and the two after it: their
embeddings feed one hidden layer, whose output gives the probability of the
word's class and of the word within its class. Words below the network's
vocabulary share hash ids there; such a word has its id's probability times its
own share of the id's words, from a table of the counts of all words of the
corpus. The sum of the conditional log probabilities of all words scores a
document. Vocabulary and network come from
the whole corpus: every task trains on its own documents in numpy, Spark
averages the networks by words seen, and rounds over disjoint halves of the
documents together pass every document once.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tidemark.llm import common as C
from tidemark.session import freeze

COMMON, RARE, CLASS = 768, 256, 32  # words with an id of their own, hash ids of all others, ids in a class
VOCABULARY = COMMON + RARE
BORDER = VOCABULARY  # stands before and after each text
EMBED, HIDDEN, SIDE = 16, 32, 2
BATCH, RATE, ROUNDS = 8192, 0.1, 2
BLOCK = 4096


class Encoder:
    """Ids of the words of texts; ``names`` are the sorted names of the common words, ``ids`` theirs."""

    def __init__(self, names: np.ndarray, ids: np.ndarray):
        self.names, self.ids = names, ids
        self.rolling, self.ws = C.Rolling(seed=5, lower=True), C.white()

    def words(self, column, limit: int = 1 << 19):
        """(first row, rows, names, row) of slabs of texts: the name and the row of every word."""
        data, off = C.utf8(column)
        for i, j in C.slabs(off, limit):
            d = data[off[i]:off[j]]
            start, end, row = C.word_spans(d, off[i:j + 1] - off[i], self.ws)
            yield i, j - i, (self.rolling.ranges(self.rolling.prefix(d), start, end) if len(start) else np.zeros(0, np.uint64)), row

    def encode(self, names: np.ndarray) -> np.ndarray:
        out = COMMON + (names % np.uint64(RARE)).astype(np.int64)
        if len(self.names):
            at = np.minimum(np.searchsorted(self.names, names), len(self.names) - 1)
            hit = self.names[at] == names
            out[hit] = self.ids[at[hit]]
        return out


def contexts(ids: np.ndarray, row: np.ndarray, rows: int) -> tuple[np.ndarray, np.ndarray]:
    """(words, 4) ids around each word, with borders where its text ends; and the ids."""
    at = np.arange(len(ids)) + SIDE * (row + 1)
    line = np.full(len(ids) + SIDE * (rows + 1), BORDER, np.int64)
    line[at] = ids
    return np.stack([line[at + d] for d in (-2, -1, 1, 2)], axis=1), ids


class Network:
    SHAPES = (("embed", (VOCABULARY + 1, EMBED)), ("w", (2 * SIDE * EMBED, HIDDEN)), ("b", (HIDDEN,)),
              ("class_w", (HIDDEN, VOCABULARY // CLASS)), ("class_b", (VOCABULARY // CLASS,)),
              ("word_w", (VOCABULARY // CLASS, HIDDEN, CLASS)), ("word_b", (VOCABULARY // CLASS, CLASS)))
    SIZE = sum(int(np.prod(s)) for _, s in SHAPES)

    def __init__(self, flat: np.ndarray):
        """Views into ``flat``, so that changing one changes the other."""
        at = 0
        for name, shape in self.SHAPES:
            n = int(np.prod(shape))
            setattr(self, name, flat[at:at + n].reshape(shape))
            at += n
        self.flat = flat

    @classmethod
    def start(cls, counts: np.ndarray) -> "Network":
        """Small random weights; the output starts at the frequencies ``counts`` of the ids."""
        net = cls(np.zeros(cls.SIZE, np.float32))
        rng = np.random.default_rng(12)
        for name, scale in (("embed", 0.3), ("w", 0.15), ("class_w", 0.05), ("word_w", 0.05)):
            v = getattr(net, name)
            v[...] = scale * rng.standard_normal(v.shape)
        c = (counts + 1.0).reshape(-1, CLASS)
        net.class_b[:] = np.log(c.sum(axis=1) / c.sum())
        net.word_b[:] = np.log(c / c.sum(axis=1, keepdims=True))
        return net

    def forward(self, ctx: np.ndarray):
        x = self.embed[ctx].reshape(len(ctx), -1)
        return x, np.tanh(x @ self.w + self.b)

    def log_probabilities(self, ctx: np.ndarray, y: np.ndarray, grad: "Network | None" = None) -> np.ndarray:
        """log p(word | its sides) of every row; with ``grad`` also its summed gradient, added there."""
        x, h = self.forward(ctx)
        cls, inner = y // CLASS, y % CLASS
        z = h @ self.class_w + self.class_b
        z -= z.max(axis=1, keepdims=True)
        p = np.exp(z)
        total = p.sum(axis=1, keepdims=True)
        line = np.arange(len(y))
        out = z[line, cls] - np.log(total[:, 0])
        order = np.argsort(cls, kind="stable")
        cut = np.searchsorted(cls[order], np.arange(VOCABULARY // CLASS + 1))
        if grad is not None:
            p /= -total
            p[line, cls] += 1
            grad.class_w += h.T @ p
            grad.class_b += p.sum(axis=0)
            dh = p @ self.class_w.T
        for c in np.flatnonzero(np.diff(cut)):
            k = order[cut[c]:cut[c + 1]]
            hk = h[k]
            z = hk @ self.word_w[c] + self.word_b[c]
            z -= z.max(axis=1, keepdims=True)
            q = np.exp(z)
            total = q.sum(axis=1, keepdims=True)
            at = np.arange(len(k))
            out[k] += z[at, inner[k]] - np.log(total[:, 0])
            if grad is not None:
                q /= -total
                q[at, inner[k]] += 1
                grad.word_w[c] += hk.T @ q
                grad.word_b[c] += q.sum(axis=0)
                dh[k] += q @ self.word_w[c].T
        if grad is not None:
            dh *= 1 - h * h
            grad.w += x.T @ dh
            grad.b += dh.sum(axis=0)
            dx = (dh @ self.w.T).reshape(-1, EMBED)
            ids = ctx.reshape(-1)
            for d in range(EMBED):
                grad.embed[:, d] += np.bincount(ids, weights=dx[:, d], minlength=VOCABULARY + 1).astype(np.float32)
        return out

    def train(self, ctx: np.ndarray, y: np.ndarray, squares: np.ndarray) -> None:
        """Adagrad steps over mini-batches in order."""
        for s in range(0, len(y), BATCH):
            grad = Network(np.zeros(self.SIZE, np.float32))
            n = min(BATCH, len(y) - s)
            self.log_probabilities(ctx[s:s + n], y[s:s + n], grad)
            g = grad.flat / n
            squares += g * g
            self.flat += RATE * g / (np.sqrt(squares) + 1e-6)


def word_counts(docs: DataFrame) -> DataFrame:
    """(name, n) of every word of all texts."""

    def run(batches):
        enc = Encoder(np.zeros(0, np.uint64), np.zeros(0, np.int64))
        for b in batches:
            for _, _, names, _ in enc.words(b.column("text"), C.SLAB):
                u, c = np.unique(names, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(u.view(np.int64)), pa.array(c)], names=["name", "n"])

    return docs.select("text").mapInArrow(run, "name long, n long").groupBy("name").agg(F.sum("n").alias("n"))


def vocabulary(docs: DataFrame, counts: DataFrame | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted names and ids of the most frequent words of all texts, and the count of every id."""
    counts = word_counts(docs) if counts is None else counts
    rare = F.lit(COMMON) + F.expr(f"pmod(pmod(name, {RARE}), {RARE})")
    top = counts.orderBy(F.desc("n"), "name").limit(COMMON).collect()
    size = np.zeros(VOCABULARY)
    for k, r in enumerate(top):
        size[k] = r.n
    names = np.array([r.name for r in top], np.int64).view(np.uint64)
    order = np.argsort(names)
    # the least common word with an id of its own bounds the words that share ids by hash
    shares = docs.sparkSession.createDataFrame([(int(r.name),) for r in top], "name long")
    for r in counts.join(F.broadcast(shares), "name", "left_anti").groupBy(rare.alias("id")).agg(F.sum("n").alias("n")).collect():
        size[r.id] = r.n
    return names[order], order.astype(np.int64), size


def fit(docs: DataFrame, rounds: int = ROUNDS, counts: DataFrame | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(names, ids, network weights) from all rows of ``docs`` (id, text); ``counts`` are its word_counts, if they are there already."""
    names, ids, sizes = vocabulary(docs, counts)
    flat = Network.start(sizes).flat
    spark = docs.sparkSession.sparkContext
    for r in range(rounds):
        shared = spark.broadcast((names, ids, flat))

        def run(batches):
            n, i, start = shared.value
            enc, net, squares, seen = Encoder(n, i), Network(start.copy()), np.full(Network.SIZE, 1e-8, np.float32), 0
            for b in batches:
                for _, rows, words, row in enc.words(b.column("text")):
                    net.train(*contexts(enc.encode(words), row, rows), squares)
                    seen += len(words)
            if seen:
                flat_ = np.pad(net.flat, (0, -Network.SIZE % BLOCK)).reshape(-1, BLOCK)
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(flat_))), pa.array([seen] * len(flat_), pa.int64()),
                                                  pa.array([x.tobytes() for x in flat_], pa.binary())], names=["block", "seen", "weights"])

        def average(key, rows):
            seen = rows.column("seen").to_numpy().astype(np.float64)
            mean = np.zeros(BLOCK)
            for n, v in zip(seen / seen.sum(), rows.column("weights")):
                mean += n * np.frombuffer(v.as_buffer(), np.float32)
            return pa.table({"block": pa.array([key[0].as_py()], pa.int64()), "weights": pa.array([mean.astype(np.float32).tobytes()], pa.binary())})

        part = docs.where(F.pmod(F.xxhash64("text"), F.lit(rounds)) == r).select("text")
        got = (part.mapInArrow(run, "block long, seen long, weights binary").groupBy("block")
               .applyInArrow(average, "block long, weights binary").collect())
        if got:
            flat = np.concatenate([np.frombuffer(x.weights, np.float32) for x in sorted(got, key=lambda x: x.block)])[:Network.SIZE]
    return names, ids, flat


def scores(df: DataFrame, model: tuple[np.ndarray, np.ndarray, np.ndarray], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row: (id, n_tokens, log_likelihood, mean_log_likelihood, pseudo_perplexity) over the whole text, by the network's ids.

    A null text, and one without words, has no tokens: sum 0, mean and
    perplexity null. Null ids and repeated rows are scored like any other.
    """
    docs = df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    shared = df.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        names, ids, flat = shared.value
        enc, net = Encoder(names, ids), Network(flat.copy())
        for b in batches:
            total, count = np.zeros(b.num_rows), np.zeros(b.num_rows, np.int64)
            for i, rows, words, row in enc.words(b.column("text")):
                ctx, y = contexts(enc.encode(words), row, rows)
                lp = np.concatenate([net.log_probabilities(ctx[s:s + BATCH], y[s:s + BATCH]) for s in range(0, len(y), BATCH)] or [np.zeros(0)])
                total[i:i + rows] = np.bincount(row, weights=lp, minlength=rows)
                count[i:i + rows] = np.bincount(row, minlength=rows)
            yield pa.RecordBatch.from_arrays([b.column("id"), pa.array(count), pa.array(total)], names=["id", "n_tokens", "log_likelihood"])

    return _means(docs.mapInArrow(run, "id long, n_tokens long, log_likelihood double").withColumnRenamed("id", id_col))


def _means(df: DataFrame) -> DataFrame:
    mean = F.when(F.col("n_tokens") > 0, F.col("log_likelihood") / F.col("n_tokens"))
    return df.withColumn("mean_log_likelihood", mean).withColumn("pseudo_perplexity", F.exp(-mean))


def word_shares(counts: DataFrame, common: np.ndarray) -> tuple[DataFrame, dict[int, float]]:
    """(name, share) of every word outside ``common``: log of its share of its hash id; and the log share of an unseen word, by id.

    Of the words of an id, one more than were counted stands for all that were not.
    """
    shares = counts.sparkSession.createDataFrame([(int(n),) for n in common.view(np.int64)], "name long")
    rare = counts.join(F.broadcast(shares), "name", "left_anti").withColumn("id", F.expr(f"pmod(name, {RARE})"))
    sizes = {r.id: r.n for r in rare.groupBy("id").agg(F.sum("n").alias("n")).collect()}
    unseen = {k: -float(np.log(sizes.get(k, 0) + 1)) for k in range(RARE)}
    total = F.element_at(F.array(*(F.lit(unseen[k]) for k in range(RARE))), (F.col("id") + 1).cast("int"))
    return rare.select("name", (F.log("n") + total).alias("share")), unseen


def word_scores(df: DataFrame, model: tuple[np.ndarray, np.ndarray, np.ndarray], counts: DataFrame, id_col: str = "doc_id",
                text_col: str = "text") -> DataFrame:
    """``scores`` with a probability of its own for every word: that of its id times its share of the id's words in ``counts`` (name, n).

    Each row's distinct words below the network's vocabulary meet the counts by
    name; no such name holds more than one in ``COMMON`` of the words, so no key
    is hot. Columns and null rules are those of ``scores``.
    """
    docs = df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    shared, scratch = df.sparkSession.sparkContext.broadcast(model), C.Scratch(df.sparkSession)

    def run(batches):
        names, ids, flat = shared.value
        enc, net = Encoder(names, ids), Network(flat.copy())
        for b in batches:
            total, count, held = np.zeros(b.num_rows), np.zeros(b.num_rows, np.int64), np.zeros(b.num_rows + 1, np.int64)
            rare, times = [np.zeros(0, np.int64)], [np.zeros(0, np.int32)]
            for i, rows, words, row in enc.words(b.column("text")):
                ctx, y = contexts(enc.encode(words), row, rows)
                lp = np.concatenate([net.log_probabilities(ctx[s:s + BATCH], y[s:s + BATCH]) for s in range(0, len(y), BATCH)] or [np.zeros(0)])
                total[i:i + rows] = np.bincount(row, weights=lp, minlength=rows)
                count[i:i + rows] = np.bincount(row, minlength=rows)
                below = y >= COMMON
                w, r = words[below], row[below]
                order = np.lexsort((w, r))
                w, r = w[order], r[order]
                first = np.flatnonzero(np.r_[True, (w[1:] != w[:-1]) | (r[1:] != r[:-1])][:len(w)])
                rare.append(w[first].view(np.int64))
                times.append(np.diff(np.r_[first, len(w)]).astype(np.int32))
                held[i + 1:i + rows + 1] = np.bincount(r[first], minlength=rows)
            at = pa.array(np.cumsum(held), pa.int32())
            yield pa.RecordBatch.from_arrays(
                [b.column("id"), pa.array(count), pa.array(total), pa.ListArray.from_arrays(at, pa.array(np.concatenate(rare))),
                 pa.ListArray.from_arrays(at, pa.array(np.concatenate(times)))], names=["id", "n_tokens", "log_likelihood", "names", "times"])

    rated = docs.mapInArrow(run, "id long, n_tokens long, log_likelihood double, names array<long>, times array<int>")
    rated = scratch.put("lm_words", rated.withColumn("row", F.monotonically_increasing_id()))
    shares, unseen = word_shares(counts, model[0])
    none = F.element_at(F.array(*(F.lit(unseen[k]) for k in range(RARE))), F.expr(f"CAST(pmod(name, {RARE}) + 1 AS INT)"))
    words = rated.select("row", F.explode(F.arrays_zip("names", "times")).alias("w")).select("row", F.col("w.names").alias("name"), F.col("w.times").alias("times"))
    own = words.join(shares, "name", "left").groupBy("row").agg(F.sum(F.col("times") * F.coalesce("share", none)).alias("own"))
    out = freeze(rated.select("row", "id", "n_tokens", "log_likelihood").join(own, "row", "left").select(
        F.col("id").alias(id_col), "n_tokens", (F.col("log_likelihood") + F.coalesce("own", F.lit(0.0))).alias("log_likelihood")))
    scratch.drop("lm_words")
    return _means(out)
