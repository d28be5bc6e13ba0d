"""Best-fit packing in bulk-synchronous rounds over runs of equal lengths and equal gaps."""

from __future__ import annotations

import array
import itertools
import json
import re
import zlib
from bisect import bisect_left, insort

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage
from .common import map_rows, numbered, utf8

PIECES = "pieces array<struct<piece:int,start:bigint,length:bigint,ids_crc32:bigint>>"
STATE = "kind string, size long, first long, n long, seq long"


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


#: Chunks whose words can be found without the tokenizer: ASCII and the letters of Latin-1, which normalization leaves alone but for case.
PLAIN = re.compile("[\x21-\x7eÀ-ÖØ-öø-ÿ]+")
# Fixed value: the words of the vocabulary's pre-tokenizer, over lower-cased plain chunks.
WORDS = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^0-9a-zß-öø-ÿ]+")
#: The two tokenizers of a vocabulary file, which a worker that runs several tasks keeps; what is remembered is a task's own.
_LOADED: dict[str, tuple] = {}


class Encoder:
    """bytes -> little-endian 32-bit ids.

    The vocabulary never joins across ASCII white space, so ids are found by blank-separated chunk and remembered. A new plain chunk is
    cut into words first, which are remembered too and go through the merges alone; any other chunk, and one that may
    hold a special token, goes through the whole tokenizer. A full memory loses its older half, which changes no result.
    """

    def __init__(self, path: str, memo: int = 400_000):
        if path not in _LOADED:
            from tokenizers import Tokenizer

            whole = Tokenizer.from_file(path)
            bare = json.loads(whole.to_str()) | {"normalizer": None, "post_processor": None, "added_tokens": []}
            bare["pre_tokenizer"] = {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}
            _LOADED[path] = whole, Tokenizer.from_str(json.dumps(bare))
        self.whole, self.bare = _LOADED[path]
        self.chunks: dict[bytes, bytes] = {}
        self.words: dict[str, bytes] = {}
        self.memo = memo

    def _room(self, known: dict, new: int) -> bool:
        full = len(known) + new > self.memo
        if full:
            for k in list(itertools.islice(known, len(known) // 2)):
                del known[k]
        return full

    def _learn(self, tokenizer, known: dict, keys: list, texts: list[str]):
        for k, e in zip(keys, tokenizer.encode_batch_fast(texts, add_special_tokens=False)):
            known[k] = array.array("I", e.ids).tobytes()

    def _add(self, new: set[bytes]):
        self._room(self.chunks, len(new))
        single, cut, rest = [], [], []
        for c in new:
            if c.isalpha():  # ASCII letters alone are one word
                single.append((c, c.lower().decode()))
                continue
            t = c.decode()
            if PLAIN.fullmatch(t) and "<|" not in t:
                cut.append((c, WORDS.findall(t.lower())))
            else:
                rest.append((c, t))
        self._learn(self.whole, self.chunks, [c for c, _ in rest], [t for _, t in rest])
        need = {w for _, w in single}.union(*[ws for _, ws in cut])
        fresh = [w for w in need if w not in self.words]
        if self._room(self.words, len(fresh)):
            fresh = [w for w in need if w not in self.words]
        self._learn(self.bare, self.words, fresh, fresh)
        words = self.words
        self.chunks.update([(c, words[w]) for c, w in single])
        self.chunks.update([(c, b"".join([words[w] for w in ws])) for c, ws in cut])

    def __call__(self, text: bytes, step: int = 1 << 18) -> bytes:
        parts, out = text.split(), []
        for at in range(0, len(parts), step):
            run = parts[at : at + step]
            got = list(map(self.chunks.get, run))
            if None in got:
                self._add({c for c, g in zip(run, got) if g is None})
                got = [self.chunks[c] if g is None else g for c, g in zip(run, got)]
            out += got
        return b"".join(out)


def encoder(path: str, memo: int = 400_000) -> Encoder:
    return Encoder(path, memo)


def pieces(docs: DataFrame, capacity: int = 4096, end_id: int = 1, tokenizer: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece: id, piece, start, length, ids_crc32. Only documents longer than capacity are cut.

    A null or empty text is the end id alone.
    """
    path = tokenizer or tokenizer_path()
    tail = end_id.to_bytes(4, "little")

    def make():
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        encode = encoder(path)

        def cut(text: bytes):
            ids = memoryview(encode(text) + tail)
            step = 4 * capacity
            return [{"piece": k, "start": k * capacity, "length": len(p := ids[at : at + step]) // 4, "ids_crc32": zlib.crc32(p)} for k, at in enumerate(range(0, len(ids), step))]

        return lambda texts: [[cut(t) for t in utf8(texts)]]

    out = map_rows(docs, [text_col], PIECES, make, [id_col])
    return out.select(F.col(id_col), F.inline("pieces"))


def _sweep(capacity: int):
    """One round: the pieces of a band, longest first, each take the successor of their length among the gaps.

    Works on runs (a length or gap, and how many), so its input is a few thousand rows at any corpus size. Of equal
    pieces the lower rank goes first, of equal gaps the lower sequence number. A filled gap re-enters the order
    with what is left of it; pieces without a successor open new sequences.
    """

    def run(frames):
        rows = pd.concat(list(frames), ignore_index=True)
        gaps = sorted((int(s), int(q), int(n)) for k, s, n, q in zip(rows.kind, rows["size"], rows.n, rows.seq) if k == "gap")
        opened = max([0, *(int(n) for k, n in zip(rows.kind, rows.n) if k == "opened")])
        todo = sorted(((int(s), int(f), int(n)) for k, s, f, n in zip(rows.kind, rows["size"], rows["first"], rows.n) if k == "piece"), key=lambda x: (-x[0], x[1]))
        out = []
        for length, rank, n in todo:
            while n:
                i = bisect_left(gaps, (length,))
                if i == len(gaps):
                    new = -(-n // (capacity // length))
                    gaps.append((capacity, opened, new))
                    opened += new
                    continue
                gap, seq, have = gaps.pop(i)
                k = min(n, have)
                out.append(("placed", length, rank, k, seq, capacity - gap))
                if have > k:
                    insort(gaps, (gap, seq + k, have - k))
                if gap > length:
                    insort(gaps, (gap - length, seq, k))
                rank, n = rank + k, n - k
        out += [("gap", s, 0, n, q, 0) for s, q, n in gaps] + [("opened", 0, 0, opened, 0, 0)]
        yield pd.DataFrame(out, columns=["kind", "size", "first", "n", "seq", "offset"])

    return run


def plan(runs: DataFrame, capacity: int = 4096) -> DataFrame:
    """(length, first, n, seq, offset): the pieces of a length with ranks first .. first+n-1 go to sequences seq ..
    seq+n-1 at that offset. ``runs`` is (length, n).

    Rounds take the pieces in bands of falling length, each band half as long as the one before: longer pieces
    have all been placed, shorter ones fill what is left. State between rounds is a checkpointed table of runs.
    """
    spark = runs.sparkSession
    todo = cut_lineage(runs.select(F.lit("piece").alias("kind"), F.col("length").alias("size"), F.lit(0).cast("long").alias("first"), F.col("n"), F.lit(0).cast("long").alias("seq")))
    state = spark.createDataFrame([("opened", 0, 0, 0, 0)], STATE)
    placed = None
    high = capacity
    while high >= 1:
        band = todo.where((F.col("size") <= high) & (F.col("size") > high // 2))
        high //= 2
        swept = cut_lineage(state.unionByName(band).coalesce(1).mapInPandas(_sweep(capacity), STATE + ", offset long"))
        done = swept.where("kind = 'placed'").select(F.col("size").alias("length"), "first", "n", "seq", "offset")
        placed = done if placed is None else placed.unionByName(done)
        state = swept.where("kind <> 'placed'").drop("offset")
    return placed


def pack(docs: DataFrame, capacity: int = 4096, end_id: int = 1, tokenizer: str | None = None, id_col: str = "doc_id", text_col: str = "text", plan_rows: int = 200_000) -> DataFrame:
    """Every piece of every document with its sequence and its place there.

    Columns: id, piece, start, length, ids_crc32, sequence_id, offset. Repeated rows and repeated ids are packed
    like others; other columns are not read; an empty table gives an empty one. The plan is broadcast only
    if it counts at most ``plan_rows`` rows.
    """
    p = numbered(pieces(docs, capacity, end_id, tokenizer, id_col, text_col), "length", "_rank")
    p = cut_lineage(p)
    steps = cut_lineage(plan(p.groupBy("length").agg(F.count("*").alias("n")), capacity))
    steps = steps.withColumnsRenamed({"length": "_length", "n": "_n"})
    small = F.broadcast(steps) if steps.count() <= plan_rows else steps
    fits = (F.col("length") == F.col("_length")) & (F.col("_rank") >= F.col("first")) & (F.col("_rank") < F.col("first") + F.col("_n"))
    return p.join(small, fits).select(id_col, "piece", "start", "length", "ids_crc32", (F.col("seq") + F.col("_rank") - F.col("first")).alias("sequence_id"), "offset")
