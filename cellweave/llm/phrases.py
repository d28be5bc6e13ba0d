"""Phrase mining after Toivonen: a sample proposes phrases, full passes count them and their negative border until it is closed."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import stage
from .common import Marks, marks, small_batches
from .words import LOWER, Powers, mix

BREAK = np.zeros(256, bool)
BREAK[list(b".,;:!?\n\x0b\x0c\r")] = True
GAP = BREAK.copy()
GAP[list(b" \t")] = True
_NEXT = np.uint64(0xA0761D6478BD642F)
_AFTER = np.uint64(0xE7037ED1A0B428DB)
_BY = np.uint64(0x94D049BB133111EB)
KEY = ["size", "hash", "second"]  #: a sequence is known by two hashes that have nothing in common, 128 bits together
CHUNK = 1 << 19  #: bytes that are hashed at once


def cuts(data: np.ndarray, size: int = CHUNK):
    """(first, end) ranges of about ``size`` bytes that end at a break, so that no piece is cut."""
    at = 0
    while at < len(data):
        end = min(len(data), at + size)
        if end < len(data):
            inside = np.flatnonzero(BREAK[data[at:end]])
            if inside.size:
                end = at + int(inside[-1]) + 1
            else:
                later = np.flatnonzero(BREAK[data[end:]])
                end = end + int(later[0]) + 1 if later.size else len(data)
        yield at, end
        at = end


class Words:
    """Hashed words of one buffer of one language: ``sizes[k - 1]`` holds (start words, hashes, second hashes) of its contiguous k words within pieces."""

    def __init__(self, data: np.ndarray, seed: int, longest: int, powers: tuple[Powers, Powers]):
        solid = np.concatenate([[False], ~GAP[data], [False]])
        edge = np.flatnonzero(solid[1:] != solid[:-1])
        self.first, self.end = edge[::2], edge[1::2]
        n = len(self.first)
        one, two = (self.hashes(data, s, p) for s, p in zip((seed, seed ^ int(_AFTER)), powers))
        with np.errstate(over="ignore"):
            breaks = np.flatnonzero(BREAK[data])
            joined = np.searchsorted(breaks, self.end[:-1]) == np.searchsorted(breaks, self.first[1:])
            at, h, g = np.arange(n), one, two
            self.sizes = [(at, h, g)]
            for k in range(2, longest + 1):
                go = at + k - 2 < n - 1
                go[go] = joined[at[go] + k - 2]
                at, h, g = at[go], h[go], g[go]
                h, g = mix(h * _NEXT + one[at + k - 1]), mix(g * _AFTER + two[at + k - 1])
                self.sizes.append((at, h, g))

    def hashes(self, data: np.ndarray, seed: int, powers: Powers) -> np.ndarray:
        up, down = powers.get(len(data) + 1)
        with np.errstate(over="ignore"):
            total = np.zeros(len(data) + 1, np.uint64)
            np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[:-1], out=total[1:])
            return mix((total[self.end] - total[self.first]) * down[self.first] + np.uint64(seed))

    def parts(self, k: int):
        """Indexes, among the sequences of k - 1 words, of the first and the last k - 1 words of each sequence of k."""
        shorter, at = self.sizes[k - 2][0], self.sizes[k - 1][0]
        return np.searchsorted(shorter, at), np.searchsorted(shorter, at + 1)


def buffers(batch: pa.RecordBatch, size: int = 4 * CHUNK):
    """(language, lower-cased bytes) per language of each run of rows with about ``size`` bytes of text (or one longer
    text): texts are joined by line feeds, which are breaks."""
    upto = np.cumsum(pc.fill_null(pc.binary_length(batch.column(1)), 0).to_numpy(zero_copy_only=False))
    first = 0
    while first < batch.num_rows:
        end = max(first + 1, int(np.searchsorted(upto, (upto[first - 1] if first else 0) + size, "right")))
        part = batch.slice(first, end - first)
        by: dict[str, list[bytes]] = {}
        for lang, text in zip(part.column(0).to_pylist(), part.column(1).cast(pa.binary()).to_pylist()):
            by.setdefault(lang, []).append(text)
        for lang in list(by):
            yield lang, np.frombuffer(b"\n".join(by.pop(lang)).translate(LOWER), np.uint8)
        first = end


def _seed(lang: str) -> int:
    return int.from_bytes(hashlib.blake2b(lang.encode(), digest_size=8).digest(), "little")


def _powers() -> tuple[Powers, Powers]:
    return Powers(), Powers(_BY)


def _fold(h: np.ndarray, g: np.ndarray, n: np.ndarray | None = None, kind: str | None = None):
    """Hashes, second hashes and counts with equal neighbours, in order of the hash, added up. Whoever adds up the rest does it by both."""
    order = np.argsort(h, kind=kind)
    h, g = h[order], g[order]
    new = np.flatnonzero(np.concatenate([[True], (h[1:] != h[:-1]) | (g[1:] != g[:-1])])) if len(h) else np.zeros(0, np.int64)
    if n is None:
        return h[new], g[new], np.diff(np.append(new, len(h)))
    return h[new], g[new], np.add.reduceat(n[order], new) if len(h) else n


class Tally:
    """Counts of hashes that leave when more than ``room`` have gathered."""

    def __init__(self, size: int, room: int):
        self.size, self.room, self.lots, self.held, self.floor = size, room, [], 0, 0

    def fold(self):
        self.lots = [_fold(*map(np.concatenate, zip(*self.lots)), kind="stable")]
        self.held = len(self.lots[0][0])

    def add(self, h: np.ndarray, g: np.ndarray):
        self.lots.append(_fold(h, g))
        self.held += len(self.lots[-1][0])
        if self.held > self.room + self.floor:
            self.fold()
            self.floor = self.held
            if self.held > self.room:
                yield from self.rows()

    def rows(self, step: int = 1 << 16):
        if self.held:
            self.fold()
            h, g, n = self.lots[0]
            for a in range(0, len(h), step):
                b = min(len(h), a + step)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(b - a, self.size, np.int32)), pa.array(h[a:b].view(np.int64)), pa.array(g[a:b].view(np.int64)), pa.array(n[a:b])], names=[*KEY, "n"])
        self.lots, self.held, self.floor = [], 0, 0


def count(texts: DataFrame, longest: int, now: list[Marks] | None = None, before: list[Marks] | None = None, room: int = 1 << 19) -> DataFrame:
    """(size, hash, second, n) of word sequences in texts (lang, text).

    A sequence counts if both its parts, without the last and without the first word, are in ``now``; without
    ``now`` all count. Those whose parts were in ``before`` already, and single words then, have been counted and are left out.
    """
    shared = texts.sparkSession.sparkContext.broadcast((now, before))

    def run(batches):
        now, before = shared.value
        powers = _powers()
        tallies = [Tally(k, room) for k in range(1, longest + 1)]
        for batch in batches:
            for lang, data in buffers(batch):
                for a, b in cuts(data):
                    w = Words(data[a:b], _seed(lang), longest, powers)
                    for k, (_, h, g) in enumerate(w.sizes, 1):
                        if k == 1:
                            go = slice(None) if before is None else slice(0)
                        elif now is None:
                            go = slice(None)
                        else:
                            x, y = w.parts(k)
                            prior = w.sizes[k - 2][1]
                            known = now[k - 2].has(prior)
                            go = known[x] & known[y]
                            if before is not None:
                                known = before[k - 2].has(prior)
                                go &= ~(known[x] & known[y])
                        if len(take := h[go]):
                            yield from tallies[k - 1].add(take, g[go])
        for t in tallies:
            yield from t.rows()

    return small_batches(texts).mapInArrow(run, "size int, hash long, second long, n long").groupBy(*KEY).agg(F.sum("n").alias("n"))


def spell(texts: DataFrame, wanted: list[Marks], totals: bool = True, room: int = 1 << 20) -> DataFrame:
    """(lang, size, hash, second, phrase, n): the words of every sequence whose hash is marked, once for each lot of a task.

    n is 0 but for rows of size 0, which count the words of a language (with ``totals``). A task remembers up to ``room`` sequences of a size
    that it has spelled, by both hashes, and starts afresh when there are more.
    """
    shared = texts.sparkSession.sparkContext.broadcast(wanted)

    def rows(lang, size, h, g, phrases, n):
        return pa.RecordBatch.from_arrays([
            pa.array([lang] * len(phrases), pa.string()), pa.array(np.full(len(phrases), size, np.int32)), h, g, pa.array(phrases, pa.binary()).cast(pa.string()), pa.array(np.full(len(phrases), n, np.int64)),
        ], names=["lang", *KEY, "phrase", "n"])

    def run(batches):
        powers, words = _powers(), {}
        seen = [(np.zeros(0, np.uint64),) * 2 for _ in shared.value]
        for batch in batches:
            for lang, data in buffers(batch):
                for a, b in cuts(data):
                    part = data[a:b]
                    w = Words(part, _seed(lang), len(shared.value), powers)
                    raw = part.tobytes()
                    words[lang] = words.get(lang, 0) + len(w.first)
                    for k, (at, h, g) in enumerate(w.sizes, 1):
                        go = np.flatnonzero(shared.value[k - 1].has(h))
                        go = go[np.lexsort((g[go], h[go]))]
                        at, h, g = at[go], h[go], g[go]
                        new = np.ones(len(h), bool)
                        new[1:] = (h[1:] != h[:-1]) | (g[1:] != g[:-1])
                        old = seen[k - 1]
                        if len(old[0]):
                            spot = np.minimum(np.searchsorted(old[0], h), len(old[0]) - 1)
                            new &= (old[0][spot] != h) | (old[1][spot] != g)
                        if not new.any():
                            continue
                        at, h, g = at[new], h[new], g[new]
                        phrases = [raw[i:j] for i, j in zip(w.first[at].tolist(), w.end[at + k - 1].tolist())]
                        if k > 1:
                            phrases = [b" ".join(s.split()) if b"  " in s or b"\t" in s else s for s in phrases]
                        yield rows(lang, k, pa.array(h.view(np.int64)), pa.array(g.view(np.int64)), phrases, 0)
                        if len(old[0]) + len(h) > room:
                            seen[k - 1] = h, g
                        else:
                            spot = np.searchsorted(old[0], h)
                            seen[k - 1] = np.insert(old[0], spot, h), np.insert(old[1], spot, g)
        if totals:
            none = pa.array([None], pa.int64())
            for lang, n in words.items():
                yield rows(lang, 0, none, none, [None], n)

    made = small_batches(texts).mapInArrow(run, "lang string, size int, hash long, second long, phrase string, n long")
    return made.groupBy("lang", *KEY, "phrase").agg(F.sum("n").alias("n"))


def frequent(docs: DataFrame, longest: int = 3, min_count: int = 10, share: float = 0.125, bits: int = 25, lang_col: str = "lang", text_col: str = "text", other: str = "und") -> DataFrame:
    """(lang, size, phrase, n) of every sequence of up to ``longest`` words that occurs ``min_count`` times within pieces of a
    language's texts; rows with a null phrase count all words of a language.

    1. A sample (the share of texts with the least hashes) proposes the sequences that it holds at least twice.
    2. A full pass counts these and their negative border: all single words, and each sequence whose two parts were proposed.
    3. Frequent members of the border are failures. While there are any, they join the proposed ones, and a further pass counts
       the sequences that this adds to the border. The last pass without a failure closes the border, so nothing frequent is missed.
    4. The sample's texts spell what they hold of the frequent ones, a last pass spells the others. So a sequence is spelled in few
       tasks, however many hold it; what it counts is known from the passes before, by 128 bits.

    Proposed sequences are known in tasks by bitmaps of 2 ** bits bits, whatever the size of the corpus: a full bitmap only makes
    passes count more. The share changes the number of passes, never the result.
    """
    texts = docs.select(F.coalesce(F.col(lang_col).cast("string"), F.lit(other)).alias("lang"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    sample = texts.where(F.pmod(F.xxhash64("text"), F.lit(1 << 20)) < int(share * (1 << 20)))
    low = max(2, int(share * min_count * 0.75))
    proposed = stage(count(sample, longest - 1).where(F.col("n") >= low), "proposed") if longest > 1 else None
    of = lambda t, k: t.where(F.col("size") == k)
    now, before, found = [marks(of(proposed, k), bits) for k in range(1, longest)], None, []
    while True:
        found.append(stage(count(texts, longest, now, before).where(F.col("n") >= min_count), "counted"))
        more = [marks(of(found[-1], k), bits, old) for k, old in enumerate(now, 1)]
        if all(np.array_equal(a.words, b.words) for a, b in zip(now, more)):
            break
        now, before = more, now
    every = found[0]
    for f in found[1:]:
        every = every.unionByName(f)
    marked = lambda rows: [marks(of(rows, k), bits) for k in range(1, longest + 1)]
    named = stage(spell(sample, marked(every), totals=False).drop("n").join(every, KEY).select("lang", "phrase", *KEY, "n"), "named")
    rest = stage(every.join(named, KEY, "left_anti"), "unnamed")
    late = spell(texts, marked(rest)).join(rest.withColumnRenamed("n", "_n"), KEY, "left").where("size = 0 OR _n IS NOT NULL")
    late = stage(late.select("lang", "size", "phrase", F.coalesce("_n", "n").alias("n")), "spelled")
    return named.select(*late.columns).unionByName(late)


def collocations(docs: DataFrame, top: int = 2000, shortest: int = 2, longest: int = 3, min_count: int = 10, covered: int = 50, lang_col: str = "lang", **how) -> DataFrame:
    """Each language's ``top`` phrases: lang, rank, phrase, a, l, r, n, score.

    a, l, r count the phrase and the two parts of its lowest-scoring cut (the first of equal ones), n the language's words, and
    score is 1000000 * a * a / (l * r) rounded down, in exact decimals (counts below 10 ** 14). A phrase is left out if
    a longer one (itself left out or not) holds its words in a row and has ``covered`` percent of its count.
    Order: score, a, then phrase in byte order.

    A null language is ``und``, together with texts that say so. Null and empty texts have no words; texts of any length are
    read whole, in chunks that end where a piece ends; repeated rows count as often as they stand; other columns aren't read; an
    empty table gives an empty one. No group is gathered: a language's top is cut down before the shuffle.
    """
    counts = frequent(docs, longest, min_count, lang_col=lang_col, **how)
    cand = counts.where(F.col("phrase").isNotNull() & F.col("size").between(shortest, longest)).select("lang", "size", "phrase", F.col("n").alias("a"), F.split("phrase", " ").alias("w"))
    part = lambda name, n: counts.where(F.col("phrase").isNotNull()).select("lang", F.col("phrase").alias(name), F.col("n").alias(n))
    halves = cand.select("lang", "phrase", "a", "w", "size", F.explode(F.sequence(F.lit(1), F.col("size") - 1)).alias("k"))
    halves = halves.select("lang", "phrase", "a", "k", F.array_join(F.slice("w", 1, F.col("k")), " ").alias("head"), F.array_join(F.slice("w", F.col("k") + 1, F.col("size") - F.col("k")), " ").alias("rest"))
    halves = halves.join(part("head", "l"), ["lang", "head"]).join(part("rest", "r"), ["lang", "rest"])
    halves = halves.withColumn("score", F.expr("CAST(a AS DECIMAL(14,0)) * CAST(a AS DECIMAL(14,0)) * CAST(1000000 AS DECIMAL(7,0)) DIV (CAST(l AS DECIMAL(14,0)) * CAST(r AS DECIMAL(14,0)))"))
    scored = halves.groupBy("lang", "phrase").agg(F.min(F.struct("score", "k", "l", "r")).alias("c"), F.first("a").alias("a"))

    inner = cand.where(F.col("size") > shortest).select("lang", "size", "a", "w", F.explode(F.sequence(F.lit(shortest), F.col("size") - 1)).alias("m"))
    inner = inner.select("lang", "a", "w", "m", F.explode(F.sequence(F.lit(1), F.col("size") - F.col("m") + 1)).alias("i"))
    holder = inner.groupBy("lang", F.array_join(F.slice("w", F.col("i"), F.col("m")), " ").alias("phrase")).agg(F.max("a").alias("most"))
    left = scored.join(holder, ["lang", "phrase"], "left").where(F.col("most").isNull() | (100 * F.col("most") < covered * F.col("a")))
    order = Window.partitionBy("lang").orderBy(F.desc("c.score"), F.desc("a"), "phrase")
    best = left.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    total = counts.where(F.col("phrase").isNull()).select("lang", "n")
    return best.join(total, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "c.l", "c.r", "n", F.col("c.score").alias("score"))
