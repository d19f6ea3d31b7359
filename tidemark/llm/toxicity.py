"""Operator 6: toxicity by compression distance with zstandard dictionaries.

Two dictionaries are trained on labelled texts: an ordinary one on windows of
ordinary texts, a toxic one on the windows of toxic texts that tell them apart.
The words of toxic texts are ranked by how telling they are; how many of them
the dictionary takes is what predicts held-out labels best, so its size follows
the telling content. The toxic compressor knows both dictionaries, the ordinary
one only the first. A window is a word with its marks, compressed by both with
each byte doubled, since a match has a fixed cost that short words would not
save otherwise. Its two lengths together have a calibrated log-likelihood
ratio; the strongest stretch of windows of the whole text, each different
window once, becomes a probability through a logistic curve fitted on the
labelled sample.
"""

from __future__ import annotations

import re
import sys
import zlib
from collections import Counter
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import DoubleType, IntegerType, StructType

ORDINARY_BYTES, ANCHOR, WINDOW_LOG = 512, 48, 20
SAMPLE = 2000
COPY = 0.25  # a text with a smaller share of new word neighbourhoods is a near copy and counts no word
KEPT_WINDOWS = 400_000
DOUBT = 1.0  # log-likelihood by which a larger dictionary may seem worse on the held-out texts and still be taken
WORD = re.compile(r"[^\W\d_]+").findall


def windows(text: str) -> list[str]:
    """The different windows of a text in order of first appearance: words with their marks, lower-cased."""
    return list(dict.fromkeys(text.lower().split()))


def doubled(b: bytes) -> bytes:
    return np.frombuffer(b, np.uint8).repeat(2).tobytes()


def _compressor(content: bytes):
    """A function from bytes to their compressed length after ``content``."""
    p = zstandard.ZstdCompressionParameters(strategy=zstandard.STRATEGY_LAZY2, min_match=6, window_log=WINDOW_LOG, hash_log=16, chain_log=16, search_log=9,
                                            target_length=8, write_content_size=False, write_dict_id=False, write_checksum=False)
    d = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    d.precompute_compress(compression_params=p)
    one = zstandard.ZstdCompressor(compression_params=p, dict_data=d).compress
    return lambda b: len(one(b))


@dataclass
class Model:
    ordinary: bytes
    toxic: bytes
    prior: float
    ratio: dict[tuple[int, int], float] = field(default_factory=dict)  # of a window's two compressed lengths
    curve: tuple[np.ndarray, np.ndarray] | None = None  # from strongest stretch to probability

    def meter(self):
        """A function from a window to its compressed lengths under the toxic and the ordinary dictionary; made once a task."""
        small, large = _compressor(doubled(self.ordinary)), _compressor(doubled(self.ordinary + self.toxic))
        anchor = doubled(self.ordinary[-ANCHOR:])  # known bytes first, so that the shortest window is compressed and not stored

        def measure(window: str) -> tuple[int, int]:
            b = anchor + doubled(f" {window} ".encode())
            return large(b), small(b)

        return measure

    def stretcher(self):
        """A function from a text to the log-likelihood ratio of its strongest stretch of windows."""
        measure, ratio, known = self.meter(), self.ratio, {}

        def stretch(text: str) -> float:
            own = windows(text)
            if len(known) > KEPT_WINDOWS:
                known.clear()
            for w in own:
                if w not in known:
                    known[w] = ratio.get(measure(w), 0.0)
            if not own:
                return 0.0
            total = np.cumsum([0.0, *map(known.__getitem__, own)])
            return float((total - np.minimum.accumulate(total)).max())

        return stretch

    def scorer(self):
        """A function from a text to its probability; made once a task."""
        if self.curve is None:
            return lambda text: self.prior
        stretch, (at, value) = self.stretcher(), self.curve
        return lambda text: float(np.interp(stretch(text), at, value))


def rising(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Knots (place, value) of the rising curve nearest to weighted 0/1 values.

    Neighbours out of order are pooled; a pool is level from its first to its last place.
    """
    pools: list[list[float]] = []  # weight, weight of ones, first and last place
    for place in np.unique(x):
        at = x == place
        pools.append([weight[at].sum(), (weight[at] * y[at]).sum(), place, place])
        while len(pools) > 1 and pools[-2][1] * pools[-1][0] >= pools[-1][1] * pools[-2][0]:
            w, ones, _, last = pools.pop()
            pools[-1] = [pools[-1][0] + w, pools[-1][1] + ones, pools[-1][2], last]
    w, ones, first, last = np.array(pools).T
    return np.column_stack([first, last]).ravel(), np.repeat(ones / w, 2)


def _trained(samples: list[bytes], size: int) -> bytes:
    """Content of a dictionary trained on the samples; samples too few or too alike train to nothing."""
    try:
        return zstandard.train_dictionary(size, samples).as_bytes()[-size:]
    except zstandard.ZstdError:
        return b""


def _without_copies(texts: list[str]) -> list[set[str]]:
    """The words that each text shows in a neighbourhood no text before it had; near copies of earlier texts are left out whole."""
    out, seen = [], set()
    for t in texts:
        w = [*map(sys.intern, WORD(t))]  # one string a word, not one an occurrence
        near = set(zip([""] + w, w, w[1:] + [""]))
        new = near - seen
        seen |= new
        if near and len(new) >= COPY * len(near):
            out.append({c[1] for c in new})
    return out


def _ranked(toxic: list[set[str]], ordinary: list[set[str]]) -> list[str]:
    """Words that are more frequent in toxic texts, the most telling first: by the difference of shares in standard errors of equal shares."""
    n, m = max(1, len(toxic)), max(1, len(ordinary))
    a, b = Counter(w for t in toxic for w in t), Counter(w for t in ordinary for w in t)
    z = {}
    for w, k in a.items():
        p = (k + b[w]) / (n + m)
        more = k / n - b[w] / m
        if more > 0:
            z[w] = more / np.sqrt(p * (1 - p) * (1 / n + 1 / m) + 1e-12)
    return sorted(z, key=lambda w: (-z[w], w))


def _how_many(toxic: list[set[str]], ordinary: list[set[str]]) -> int:
    """How many ranked words predict held-out labels best, each half ranked by the other."""
    half = lambda texts, k: [t for t in texts if zlib.crc32(" ".join(sorted(t)).encode()) % 2 == k]
    gain = Counter()
    sizes = set()
    curves = []
    for k in (0, 1):
        learn_t, learn_o, test_t, test_o = half(toxic, k), half(ordinary, k), half(toxic, 1 - k), half(ordinary, 1 - k)
        place = {w: i for i, w in enumerate(_ranked(learn_t, learn_o))}
        first = lambda texts: np.sort([min((place.get(w, len(place)) for w in t), default=len(place)) for t in texts])
        curves.append((first(test_t), first(test_o), len(place)))
        sizes.update(x + 1 for x in curves[-1][0].tolist() if x < len(place))
    for size in sizes:
        for t, o, _ in curves:
            a, b = int(np.searchsorted(t, size)), int(np.searchsorted(o, size))
            for x, y in ((a, b), (len(t) - a, len(o) - b)):
                p = (x + 0.5) / (x + y + 1)
                gain[size] += x * np.log(p) + y * np.log(1 - p)
    return max((s for s in sizes if gain[s] >= max(gain.values()) - DOUBT), default=16)


def learn(rows: list[tuple[str, int, float]]) -> Model:
    """A model from (text, label, weight) rows, a bounded labelled sample.

    Equal texts with one label are one text with their weights summed. With
    both labels and any word in a toxic text the model always scores by
    compression; without, every text gets the share of toxic weight.
    """
    merged: Counter = Counter()
    for t, y, w in rows:
        merged[t.lower(), int(y)] += w
    rows = sorted((t, y, w) for (t, y), w in merged.items())
    total = sum(w for _, _, w in rows)
    prior = sum(w for _, y, w in rows if y) / total if total else 0.0
    toxic, ordinary = [t for t, y, _ in rows if y], [t for t, y, _ in rows if not y]
    model = Model(b"", b"", prior)
    if not toxic or not ordinary:
        return model
    shown, plain = _without_copies(toxic), _without_copies(ordinary)
    ranked = _ranked(shown, plain)
    place = {w: k for k, w in enumerate(ranked[:_how_many(shown, plain)])}
    telling = Counter(p for t in toxic for p in t.split() if not place.keys().isdisjoint(WORD(p)))
    if not telling:
        return model
    samples = [f" {p} ".encode() for p, n in sorted(telling.items()) for _ in range(n)]
    eight = [" ".join(w[k:k + 8]).encode() for w in (t.split() for t in ordinary) for k in range(0, len(w), 8)]
    model.ordinary = (_trained(eight, ORDINARY_BYTES) or b" ".join(eight))[-ORDINARY_BYTES:]
    distinct = sorted(telling, key=lambda p: (-min(place.get(w, len(place)) for w in WORD(p)), p))  # the most telling last, where matches are cheapest
    content = _trained(samples, max(256, sum(len(p) + 2 for p in distinct)))
    model.toxic = b"".join(f" {p} ".encode() for p in distinct if f" {p} ".encode() not in content) + content

    measure, known = model.meter(), {}
    for w in {w for t in (*toxic, *ordinary) for w in windows(t)}:
        known[w] = measure(w)
    hits = Counter(known[w] for t in toxic for w in windows(t) if w in telling)
    misses = Counter(known[w] for t in ordinary for w in windows(t) if w not in telling)
    n, m = sum(hits.values()), sum(misses.values())
    dense = [sum(w in telling for w in windows(t)) / len(windows(t)) for t in toxic if not telling.keys().isdisjoint(windows(t))]
    share = float(np.clip(np.mean(dense), 0.005, 0.2))
    kinds = len(set(hits) | set(misses)) + 1
    for k in set(hits) | set(misses):
        odds = ((hits[k] + 0.5) / (n + 0.5 * kinds)) / ((misses[k] + 0.5) / (m + 0.5 * kinds))
        model.ratio[k] = float(np.log(1 + share * (odds - 1)))
    stretch = model.stretcher()
    model.curve = rising(*(np.array(v, float) for v in zip(*((stretch(t), y, w) for t, y, w in rows))))
    return model


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    """A model from documents (doc_id, text) and labels (doc_id, toxic).

    About ``sample`` toxic and as many ordinary labelled documents are drawn by
    a hash of the id; weights restore the true proportion. Null labels, ids and
    texts teach nothing; of an id labelled twice the higher label counts, of an
    id with several texts each teaches. The labels alone choose the ids, so only
    their texts leave the scan. Empty tables give a model that scores 0.
    """
    marks = labels.where("doc_id IS NOT NULL AND toxic IS NOT NULL").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    sizes = {r.y: r["count"] for r in marks.groupBy((F.col("toxic") > 0).cast("int").alias("y")).count().collect()}
    draw = F.pmod(F.xxhash64("doc_id", F.lit(17)), F.lit(1_000_000)) / 1_000_000.0
    y = (F.col("toxic") > 0).cast("int")
    share = F.when(y == 1, sample / max(1, sizes.get(1, 0))).otherwise(sample / max(1, sizes.get(0, 0)))
    chosen = marks.where(draw < share).select("doc_id", y.alias("y"))
    rows = docs.select("doc_id", "text").where("text IS NOT NULL").join(F.broadcast(chosen), "doc_id").select("text", "y").collect()
    weight = {k: max(1.0, n / sample) for k, n in sizes.items()}
    return learn([(r.text, r.y, weight[r.y]) for r in rows])


def score(df: DataFrame, model: Model, keep: list[Column | str]) -> DataFrame:
    """``keep`` (columns of ``df``) with score and predicted (1 from 0.5 on) from the whole ``text``; null is empty.

    Every row is scored on its own, so repeated rows score alike and an empty table gives none. Columns of
    ``df`` called score or predicted clash only if they are kept.
    """
    rows = df.select(*keep, "text")
    names = rows.columns[:-1]
    shared = df.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        one = shared.value.scorer()
        for b in batches:
            for lo in range(0, b.num_rows, 512):
                part = b.slice(lo, 512)
                s = np.array([one(t or "") for t in part.column("text").to_pylist()])
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in names), pa.array(s), pa.array((s >= 0.5).astype(np.int32))],
                                                 names=[*names, "score", "predicted"])

    return rows.mapInArrow(run, StructType(rows.schema.fields[:-1]).add("score", DoubleType()).add("predicted", IntegerType()))


def accepted(df: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """The rows of ``df``, all columns as they are, whose text is not called toxic."""
    shared, at = df.sparkSession.sparkContext.broadcast(model), df.columns.index(text_col)

    def run(batches):
        one = shared.value.scorer()
        for b in batches:
            for lo in range(0, b.num_rows, 512):
                part = b.slice(lo, 512)
                yield part.filter(pa.array([one(t or "") < 0.5 for t in part.column(at).to_pylist()], pa.bool_()))

    return df.mapInArrow(run, df.schema)
