"""Toxicity by compression distance: windows are compressed with a zstandard dictionary of toxic and with one of ordinary text."""

from __future__ import annotations

import json
import math
from collections import Counter

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import map_rows, utf8

LEVEL = 9
SIZE = 2048  #: bytes that training may give the toxic dictionary
BASE = 8192  #: bytes at least that it may give the ordinary one
CLEAR = 3.5  #: signed root of the likelihood ratio from which a word marks toxic texts
NEAR = (0.4, 0.5, 0.6, 0.7, 0.8)  #: distances that are counted
#: Lower-cases A-Z and blanks what is neither a letter, a digit nor beyond ASCII.
LETTERS = bytes(c if c >= 128 or 97 <= c <= 122 or 48 <= c <= 57 else c + 32 if 65 <= c <= 90 else 32 for c in range(256))
#: Follows every window and ends both dictionaries, since the compressor doesn't search the last bytes of its input. No window holds any of it.
TAIL = b"<>{}[]()=+*/%$#@!&|~^`:;?.,-_'\""


def windows(text: bytes) -> list[bytes]:
    """A window for each word of letters and digits, in lower case with a blank on either side; a text without words is one empty window."""
    return [b" " + w + b" " for w in text.translate(LETTERS).split()] or [b" "]


class Distance:
    """Compressed lengths of windows with the ordinary and with the toxic dictionary."""

    def __init__(self, toxic: bytes, ordinary: bytes, memo: int = 100_000):
        plain = {"level": LEVEL, "write_content_size": False, "write_checksum": False, "write_dict_id": False}
        make = lambda d: zstandard.ZstdCompressor(dict_data=zstandard.ZstdCompressionDict(d + TAIL, dict_type=zstandard.DICT_TYPE_RAWCONTENT), **plain).compress
        self.pair = [(f, len(f(TAIL))) for f in map(make, (ordinary, toxic))]
        self.known, self.memo = {}, memo

    def one(self, window: bytes) -> tuple[int, float]:
        """(bytes that the toxic dictionary saves, toxic length over ordinary length), both without what the tail costs."""
        got = self.known.get(window)
        if got is None:
            a, b = (len(f(window + TAIL)) - n for f, n in self.pair)
            if len(self.known) >= self.memo:
                self.known.clear()
            got = self.known[window] = a - b, b / max(a, 1)
        return got

    def __call__(self, text: bytes) -> np.ndarray:
        return np.array([self.one(w) for w in windows(text)], float)


def features(lengths: np.ndarray) -> list[float]:
    saved, ratio = lengths.T
    near = [int((ratio <= t).sum()) for t in NEAR]
    rest = [float(saved.max()), float(saved.mean()), float(np.sort(ratio)[:3].mean()), float(ratio.min()), math.log(len(ratio))]
    return rest + [math.log1p(n) for n in near] + [100 * n / len(ratio) for n in near[1:4]]


FEATURES = 5 + 2 * len(NEAR) - 2


def marking(toxic: list[list[bytes]], ordinary: list[list[bytes]]) -> dict[bytes, float]:
    """Windows that mark toxic texts, with the signed root of their likelihood ratio.

    Given the texts of both kinds that hold a window, their split is binomial if it marks nothing, with the share of toxic
    texts among all (text, window) pairs, so that longer texts don't count as evidence.
    """
    seen = [Counter(w for t in texts for w in set(t)) for texts in (ordinary, toxic)]
    share = seen[1].total() / max(1, seen[0].total() + seen[1].total())
    out = {}
    for w, a in seen[1].items():
        b = seen[0][w]
        n = a + b
        if a >= 3 and a > n * share:
            z = math.sqrt(2 * (a * math.log(a / (n * share)) + (b * math.log(b / (n * (1 - share))) if b else 0)))
            if z > CLEAR:
                out[w] = z
    return out


def _dictionaries(toxic: list[bytes], ordinary: list[bytes]) -> tuple[bytes, bytes]:
    """One dictionary trained on the windows that mark toxic texts, one on all ordinary texts.

    Marking windows that the training left out stand before what it made, the strongest last, so none is lost; with too few samples to
    train on, they are all. The shorter dictionary is filled up in front, so that places cost the same in both.
    """
    split = [[windows(t) for t in texts] for texts in (toxic, ordinary)]
    strong = marking(*split)

    def trained(size, samples):
        try:
            return zstandard.train_dictionary(size, samples, level=LEVEL).as_bytes()
        except zstandard.ZstdError:
            return b""

    first = trained(SIZE, [w for t in split[0] for w in t if w in strong])
    first = b"".join(sorted((w for w in strong if w not in first), key=lambda w: (strong[w], w))) + first
    second = trained(max(BASE, len(first)), [b" ".join([*(w.strip() for w in t), b""]) for t in split[1]])
    size = max(len(first), len(second))
    return first.rjust(size, b"\0"), second.rjust(size, b"\0")


def fit(toxic: list[bytes], ordinary: list[bytes], share: float) -> dict:
    """A model from texts of both labels; ``share`` is the share of toxic rows among all training rows.

    The first three fifths of each label make the dictionaries, the rest the calibration: a ridge-logistic
    fit of the chance of label 1 on summaries of a text's distances. With too few rows to fit, every text scores the share.
    """
    cut = [max(1, 3 * len(x) // 5) for x in (toxic, ordinary)]
    if len(toxic) < 2 or len(ordinary) < 2:
        return {"toxic": b"", "ordinary": b"", "mean": [0.0] * FEATURES, "scale": [1.0] * FEATURES, "weights": [math.log((share + 1e-6) / (1 - share + 1e-6))] + [0.0] * FEATURES}
    d1, d0 = _dictionaries(toxic[: cut[0]], ordinary[: cut[1]])
    distance = Distance(d1, d0)
    y = np.array([1] * (len(toxic) - cut[0]) + [0] * (len(ordinary) - cut[1]), float)
    x = np.array([features(distance(t)) for t in toxic[cut[0] :] + ordinary[cut[1] :]])
    mean, scale = x.mean(0), x.std(0) + 1e-9
    x = np.column_stack([np.ones(len(x)), (x - mean) / scale])
    b = np.zeros(x.shape[1])
    ridge = np.diag([1e-3] + [1.0] * FEATURES)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ b, -30, 30)))
        b += np.linalg.solve(x.T @ (x * (p * (1 - p))[:, None]) + ridge, x.T @ (y - p) - ridge @ b)
    odds = y.mean() / (1 - y.mean())
    b[0] += math.log((share + 1e-6) / (1 - share + 1e-6) / odds)
    return {"toxic": d1, "ordinary": d0, "mean": mean.tolist(), "scale": scale.tolist(), "weights": b.tolist()}


def held_out(id_col: Column | str) -> Column:
    """True for the fifth of ids from which no label is learned."""
    c = F.col(id_col) if isinstance(id_col, str) else id_col
    return F.coalesce(F.crc32(F.encode(c.cast("string"), "UTF-8")) % 5 == 0, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", per_label: int = 5000) -> dict:
    """Fit on at most ``per_label`` labelled documents of each label, those of least id hash that aren't held out.

    The bounded sample is fitted in one executor task; only the model (some 70 kB) comes to the driver.
    """
    known = labels.where(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull() & ~held_out(id_col)).select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("y"))
    known = known.groupBy("id").agg(F.max("y").alias("y"))
    n = {r.y: r.n for r in known.groupBy("y").agg(F.count("*").alias("n")).collect()}
    if not n:
        return fit([], [], 0.0)
    share = n.get(1, 0) / sum(n.values())
    picked = [known.where(F.col("y") == y).orderBy(F.xxhash64("id"), "id").limit(per_label) for y in (0, 1)]
    picked = F.broadcast(picked[0].unionByName(picked[1]))  # at most 2 * per_label ids
    sample = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).join(picked, "id")

    def run(frames):
        rows = pd.concat(list(frames), ignore_index=True)
        rows["order"] = pd.util.hash_pandas_object(rows["id"], index=False)
        rows = rows.sort_values(["order", "text"]).drop_duplicates("id")
        sides = [[t.encode() for t in rows.text[rows.y == y]] for y in (1, 0)]
        m = fit(*sides, share)
        yield pd.DataFrame({"toxic": [m["toxic"]], "ordinary": [m["ordinary"]], "rest": [json.dumps([m["mean"], m["scale"], m["weights"]])]})

    # One row more makes the task run even when no labelled document is there.
    seed = docs.sparkSession.createDataFrame([(None, "", -1)], "id long, text string, y int").withColumn("id", F.col("id").cast(sample.schema["id"].dataType))
    row = sample.unionByName(seed).repartition(1).mapInPandas(run, "toxic binary, ordinary binary, rest string").first()
    mean, scale, weights = json.loads(row.rest)
    return {"toxic": bytes(row.toxic), "ordinary": bytes(row.ordinary), "mean": mean, "scale": scale, "weights": weights}


def score(docs: DataFrame, model: dict, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Every row with ``score`` (chance of label 1) from the distances of all its windows and ``predicted``.

    Null and empty texts are one empty window; long texts are windows like any other; repeated rows score alike; a
    column named like a result is replaced.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def make():
        m = shared.value
        distance = Distance(m["toxic"], m["ordinary"])
        mean, scale, weights = (np.array(m[k]) for k in ("mean", "scale", "weights"))

        def work(texts):
            memo: dict[bytes, float] = {}  # of this batch: equal texts are scored once
            out = []
            for t in utf8(texts):
                if t not in memo:
                    z = float(weights[0] + ((np.array(features(distance(t))) - mean) / scale) @ weights[1:])
                    memo[t] = 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))
                out.append(memo[t])
            return out, [int(s >= 0.5) for s in out]

        return work

    return map_rows(docs, [text_col], "score double, predicted int", make, keep)


def report(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, held_out, score, predicted. A null id is not held out (and teaches nothing)."""
    model = train(docs, labels, id_col, text_col)
    s = score(docs.select(F.col(id_col), F.col(text_col)), model, text_col, [id_col])
    return s.select(id_col, held_out(id_col).alias("held_out"), "score", "predicted")


def remove(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows not predicted toxic, with the columns they came with."""
    names = docs.columns
    model = train(docs, labels, id_col, text_col)
    plain = docs.withColumnsRenamed({n: f"_in_{n}" for n in names})
    s = score(plain, model, f"_in_{text_col}").where("predicted = 0")
    return s.select(*[F.col(f"`_in_{n}`").alias(n) for n in names])
