"""Operator 5: secret scan with a random forest that removes false positives.

Long runs of key-like characters in whole texts are candidates, and so is every
value assigned to a credential name, whatever its length and characters. A forest judges
each by its length, how usual its character transitions are, how much of it
dictionary words cover, the path it comes from and the words around it. The dictionary
holds the words that most texts hold; the transitions are counted over all
words of all texts. The forest is
trained here on labelled findings, given by the caller or marked by two narrow
rules.
"""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import BooleanType, DoubleType, LongType, StructType

from tidemark.session import freeze

DICTIONARY = 20_000
SAMPLE = 4000
TREES, DEPTH, LEAF = 40, 8, 3
#: fixed values: names that a credential is assigned to
CREDENTIAL = "token secret password passwd pwd apikey api_key access_key secret_key private_key auth credential bearer key"
#: fixed values: parts of a path that hold samples
SAMPLE_PATH = "test example sample fixture doc mock demo"
FEATURES = ("length", "transition", "coverage", "digits", "uppercase", "switches", "distinct", "sample_path", "path_depth",
            "credential_before", "assigned", "quoted", "address", "words_before", "words_after", "symbols")
MARK = "[SECRET]"
RUN = "[A-Za-z0-9_+/-]{16,}={0,2}"
#: a credential name, also as the end of a longer name, and the value assigned to it: quoted, or up to white space
ASSIGNED = (r"(?i:" + "|".join(sorted(CREDENTIAL.split(), key=len, reverse=True)) + r")[\"'`]?[ \t]*(?::=|=>|=|:(?!//))[ \t]*"
            r"(?:\"([^\"\r\n]+)\"|'([^'\r\n]+)'|`([^`\r\n]+)`|([^\s\"'`,;]+))")


def spans(text: str) -> list[tuple[int, int]]:
    """Start and end of every candidate, in order: long runs and values of credentials; both where they differ."""
    found = {m.span() for m in re.finditer(RUN, text)}
    return sorted(found | {m.span(m.lastindex) for m in re.finditer(ASSIGNED, text)})


def _merged(hits: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for s, e in sorted(hits):
        if out and s < out[-1][1]:
            out[-1] = (out[-1][0], max(e, out[-1][1]))
        else:
            out.append((s, e))
    return out


def word_table(texts: DataFrame) -> DataFrame:
    """(word, docs) of every word of four letters or more with its number of texts, over all rows."""

    def run(batches):
        find, seen = re.compile(r"[^\W\d_]{4,24}").findall, Counter()

        def flush():
            return pa.RecordBatch.from_arrays([pa.array(list(seen), pa.string()), pa.array(list(seen.values()), pa.int64())], names=["word", "docs"])

        for b in batches:
            for t in b.column("text").to_pylist():
                if t:
                    seen.update(set(find(t.lower())))
                if len(seen) > 300_000:
                    yield flush()
                    seen.clear()
        yield flush()

    return texts.mapInArrow(run, "word string, docs long").groupBy("word").agg(F.sum("docs").alias("docs"))


def dictionary(words: DataFrame, size: int = DICTIONARY) -> list[tuple[str, int]]:
    """The ``size`` words of the table that most texts hold, with their numbers of texts; of equal ones the first in order.

    A histogram of counts (some hundred steps of an eighth of an octave) first says from which count on words can
    be among them; those are sorted over all tasks and the first ``size`` rows read. No task sends its own ``size``.
    """
    step = F.floor(F.log2("docs") * 8).cast("int")
    total, least = 0, 0
    for r in sorted(words.groupBy(step.alias("step")).count().collect(), key=lambda r: -r.step):
        total, least = total + r["count"], r.step
        if total >= size:
            break
    ahead = freeze(words.where(step >= least).sort(F.desc("docs"), "word"))
    return [(r.word, r.docs) for r in ahead.limit(size).collect()]


def transitions(words: DataFrame) -> np.ndarray:
    """(28, 28) counts of the transitions between kinds within all words of the table, each as often as texts hold it."""

    def run(batches):
        count = np.zeros(28 * 28, np.int64)
        for b in batches:
            w, n = b.column("word").to_pylist(), b.column("docs").to_numpy()
            each = [x.lower().encode("latin-1", "replace") for x in w]
            k, word = kinds("".join(x.decode("latin-1") for x in each)), np.repeat(np.arange(len(w)), [len(x) for x in each])
            same = np.flatnonzero(word[1:] == word[:-1])
            np.add.at(count, k[same] * 28 + k[same + 1], n[word[same]])
        at = np.flatnonzero(count)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(count[at])], names=["at", "n"])

    out = np.zeros(28 * 28)
    for r in words.mapInArrow(run, "at long, n long").groupBy("at").agg(F.sum("n").alias("n")).collect():
        out[r.at] = r.n
    return out.reshape(28, 28)


def kinds(s: str) -> np.ndarray:
    """Characters as 28 kinds: letters in lower case, digits, others."""
    c = np.frombuffer(s.lower().encode("latin-1", "replace"), np.uint8).astype(np.int64)
    return np.where((c >= 97) & (c <= 122), c - 97, np.where((c >= 48) & (c <= 57), 26, 27))


class Context:
    """What features need from the corpus: words and the log probability of each character transition."""

    def __init__(self, words: list[tuple[str, int]], moves: np.ndarray):
        self.words, self.names = {w for w, _ in words}, set(CREDENTIAL.split())
        count = moves + 0.5
        self.log = np.log(count / count.sum(axis=1, keepdims=True))

    def coverage(self, s: str) -> float:
        s, at, covered = s.lower(), 0, 0
        while at < len(s):
            for n in range(min(12, len(s) - at), 3, -1):
                if s[at:at + n] in self.words:
                    covered += n
                    at += n
                    break
            else:
                at += 1
        return covered / len(s)

    def features(self, text: str, start: int, end: int, path: str | None) -> list[float]:
        s, path = text[start:end], (path or "").lower()
        before, after = text[max(0, start - 80):start], text[end:end + 80]
        k = kinds(s)
        digit, upper = k == 26, np.array([c.isupper() for c in s])
        words_before = re.findall(r"[^\W\d]+", before.lower())
        words_after = re.findall(r"[^\W\d]+", after.lower())
        known = lambda ws: sum(w in self.words for w in ws) / max(1, len(ws))
        run = re.sub(r"[A-Za-z0-9_+/=-]", "", s)
        moves = self.log[k[:-1], k[1:]]
        return [float(len(s)), float(moves.mean()) if len(moves) else 0.0, self.coverage(s), float(digit.mean()), float(upper.mean()),
                float((digit[1:] != digit[:-1]).mean()) if len(s) > 1 else 0.0, len(set(s)) / len(s), float(any(p in path for p in SAMPLE_PATH.split())),
                float(path.count("/")), float(any(w in self.names or any(w.endswith("_" + x) for x in self.names) for w in words_before[-2:])), float(bool(re.search(r"[=:]\s*[\"']?$", before))),
                float(bool(re.search(r"[\"'`]$", before))), float(bool(re.search(r"(://|www\.|@|[/.])\S*$", before))),
                known(words_before), known(words_after), len(run) / len(s)]


def rule_label(f: list[float]) -> int | None:
    """Narrow rules that label a finding: a mixed value assigned to a credential name is a secret; a run without
    digits, one of digits alone, or part of an address is not; None where neither holds. A credential's value with
    symbols but no digits stays unlabelled."""
    v = dict(zip(FEATURES, f))
    if v["assigned"] and v["credential_before"] and 0.05 < v["digits"] < 0.95 and v["switches"] > 0.1:
        return 1
    if v["assigned"] and v["credential_before"] and v["symbols"]:
        return None
    if v["digits"] in (0.0, 1.0) or v["address"]:
        return 0
    return None


class Forest:
    """Random forest of Gini trees kept as arrays (feature, threshold, left, right, probability)."""

    def __init__(self, x: np.ndarray, y: np.ndarray, trees: int = TREES, depth: int = DEPTH, seed: int = 1):
        rng = np.random.default_rng(seed)
        self.prior = float(y.mean()) if len(y) else 0.0
        self.trees = []
        if len(y) and 0 < self.prior < 1:
            for _ in range(trees):
                rows = rng.integers(len(y), size=len(y))
                nodes: list[list[float]] = []
                self._grow(x[rows], y[rows], depth, rng, nodes)
                self.trees.append(np.array(nodes))

    def _grow(self, x, y, depth, rng, nodes) -> int:
        me = len(nodes)
        nodes.append([-1, 0.0, -1, -1, float(y.mean())])
        if depth == 0 or len(y) < 2 * LEAF or y.min() == y.max():
            return me
        best = (1e-9, -1, 0.0)
        n, total = len(y), y.sum()
        for f in rng.choice(x.shape[1], size=max(1, int(np.sqrt(x.shape[1]))), replace=False):
            order = np.argsort(x[:, f], kind="stable")
            v, left = x[order, f], np.cumsum(y[order])[:-1]
            nl = np.arange(1, n)
            ok = (v[1:] > v[:-1]) & (nl >= LEAF) & (n - nl >= LEAF)
            if not ok.any():
                continue
            p, q = left / nl, (total - left) / (n - nl)
            gain = total / n * (1 - total / n) - (nl * p * (1 - p) + (n - nl) * q * (1 - q)) / n
            k = int(np.argmax(np.where(ok, gain, -1)))
            if gain[k] > best[0]:
                best = (float(gain[k]), int(f), float((v[k] + v[k + 1]) / 2))
        if best[1] >= 0:
            go = x[:, best[1]] <= best[2]
            nodes[me][:2] = best[1], best[2]
            nodes[me][2] = self._grow(x[go], y[go], depth - 1, rng, nodes)
            nodes[me][3] = self._grow(x[~go], y[~go], depth - 1, rng, nodes)
        return me

    def probability(self, x: np.ndarray) -> np.ndarray:
        if not self.trees:
            return np.full(len(x), self.prior)
        out = np.zeros(len(x))
        for t in self.trees:
            at = np.zeros(len(x), np.int64)
            while True:
                f = t[at, 0].astype(np.int64)
                inner = np.flatnonzero(f >= 0)
                if not len(inner):
                    break
                low = x[inner, f[inner]] <= t[at[inner], 1]
                at[inner] = np.where(low, t[at[inner], 2], t[at[inner], 3]).astype(np.int64)
            out += t[at, 4]
        return out / len(self.trees)


def candidates(docs: DataFrame, context) -> DataFrame:
    """(id, start, end, label, features) of every candidate of every whole text (columns id, text, path).

    Offsets count code points; ``label`` is the rule's, null where the rules are silent.
    """

    def run(batches):
        c = context.value
        for b in batches:
            out = []
            for i, t, p in zip(b.column("id").to_pylist(), b.column("text").to_pylist(), b.column("path").to_pylist()):
                for start, end in spans(t or ""):
                    f = c.features(t, start, end, p)
                    out.append((i, start, end, rule_label(f), f))
            cols = list(zip(*out)) or [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.int64()),
                                              pa.array(cols[3], pa.int64()), pa.array(cols[4], pa.list_(pa.float64()))],
                                             names=["id", "start", "end", "label", "features"])

    return docs.mapInArrow(run, "id long, start long, end long, label long, features array<double>")


def train(found: DataFrame, sample: int = SAMPLE) -> Forest:
    """A forest from labelled findings (label, features), about ``sample`` of each label drawn by a hash."""
    found = found.where("label IS NOT NULL")
    sizes = {r.label: r["count"] for r in found.groupBy("label").count().collect()}
    share = F.when(F.col("label") == 1, sample / max(1, sizes.get(1, 0))).otherwise(sample / max(1, sizes.get(0, 0)))
    draw = F.pmod(F.xxhash64("id", "start"), F.lit(1_000_000)) / 1_000_000.0
    rows = sorted((tuple(r.features), r.label) for r in found.where(draw < share).select("features", "label").collect())
    return Forest(np.array([f for f, _ in rows]).reshape(len(rows), len(FEATURES)), np.array([float(y) for _, y in rows]))


def _documents(df: DataFrame, id_col: str, text_col: str, path_col: str | None) -> DataFrame:
    path = F.col(path_col).cast("string") if path_col in df.columns else F.lit(None).cast("string")
    return df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"), path.alias("path"))


def findings(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", path_col: str | None = "source") -> tuple[Context, DataFrame]:
    """Corpus context and the frozen candidates of all texts: two passes over the texts, however often they are used afterwards."""
    docs = _documents(df, id_col, text_col, path_col)
    words = freeze(word_table(docs.select("text")))
    context = Context(dictionary(words), transitions(words))
    return context, freeze(candidates(docs, df.sparkSession.sparkContext.broadcast(context)))


def learn(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", path_col: str | None = "source",
          labelled: DataFrame | None = None) -> tuple[Context, Forest]:
    """Corpus context and forest. ``labelled`` (id, start, label), if given, labels the findings at these places instead of the rules.

    An empty table gives an empty context and a forest that says 0.
    """
    context, found = findings(df, id_col, text_col, path_col)
    if labelled is not None:
        found = found.drop("label").join(labelled.select("id", "start", "label"), ["id", "start"])
    return context, train(found)


def scan(df: DataFrame, model: tuple[Context, Forest], id_col: str = "doc_id", text_col: str = "text",
         path_col: str | None = "source", threshold: float = 0.5) -> DataFrame:
    """One row per candidate: (id, start, end, score, is_secret, and the features by name).

    A null or empty text has no candidates; a null id is carried along; rows
    that repeat give their findings each. Without labelled findings of both
    labels every score is the share of secrets among the labelled ones, else 0.
    """
    docs = _documents(df, id_col, text_col, path_col)
    return judged(candidates(docs, df.sparkSession.sparkContext.broadcast(model[0])), model[1], id_col, threshold)


def judged(found: DataFrame, forest: Forest, id_col: str = "doc_id", threshold: float = 0.5) -> DataFrame:
    """Candidates with the forest's score, as ``scan`` returns them; a score at the threshold counts as a secret."""
    forest = found.sparkSession.sparkContext.broadcast(forest)

    def judge(batches):
        for b in batches:
            x = np.array(b.column("features").to_pylist(), float).reshape(b.num_rows, len(FEATURES))
            p = forest.value.probability(x)
            yield pa.RecordBatch.from_arrays([b.column("id"), b.column("start"), b.column("end"), pa.array(p), pa.array(p >= threshold),
                                              *(pa.array(x[:, k]) for k in range(len(FEATURES)))],
                                             names=["id", "start", "end", "score", "is_secret", *FEATURES])

    schema = StructType().add("id", LongType()).add("start", LongType()).add("end", LongType()).add("score", DoubleType()).add("is_secret", BooleanType())
    for f in FEATURES:
        schema = schema.add(f, DoubleType())
    return found.mapInArrow(judge, schema).withColumnRenamed("id", id_col)


def redact(df: DataFrame, model: tuple[Context, Forest], text_col: str = "text", path_col: str | None = "source",
           threshold: float = 0.5, mark: str = MARK) -> DataFrame:
    """``df`` with every secret of ``text_col`` replaced by ``mark``; rows, order of columns and other values stay."""
    spark = df.sparkSession.sparkContext
    context, forest = spark.broadcast(model[0]), spark.broadcast(model[1])
    names = df.columns
    at, path = names.index(text_col), path_col if path_col in names else None

    def run(batches):
        c, forest_ = context.value, forest.value
        for b in batches:
            texts = b.column(at).to_pylist()
            paths = b.column(names.index(path)).to_pylist() if path else [None] * len(texts)
            for k, (t, p) in enumerate(zip(texts, paths)):
                found = spans(t or "")
                if found:
                    hit = forest_.probability(np.array([c.features(t, s, e, p and str(p)) for s, e in found])) >= threshold
                    for s, e in reversed(_merged([x for x, h in zip(found, hit) if h])):
                        t = t[:s] + mark + t[e:]
                    texts[k] = t
            columns = list(b.columns)
            columns[at] = pa.array(texts, pa.string())
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return df.mapInArrow(run, df.schema)
