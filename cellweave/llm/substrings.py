"""Removal of repeated byte strings: minimizer shards, induced suffix sorting in each, first places kept."""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import stage
from .common import map_rows, utf8
from .suffixes import permuted_lcp, suffix_array
from .words import Powers, chunks, mix

SEED = 20  #: bytes of the substring that anchors a window
LAST = (1 << 63) - 1  #: stands for a null id, which comes after all others
HEADER = np.dtype([("doc", "<i8"), ("start", "<i4"), ("size", "<i4"), ("off", "<i4")])
BUNDLE = "bucket int, payload binary"
RANGES = "doc long, start int, n int, d1 long, d2 long"


def seeds(data: np.ndarray, powers: Powers) -> np.ndarray:
    """Hash of the SEED bytes from each position."""
    up, down = powers.get(len(data) + 1)
    with np.errstate(over="ignore"):
        total = np.zeros(len(data) + 1, np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[:-1], out=total[1:])
        return mix((total[SEED:] - total[:-SEED]) * down[: len(data) + 1 - SEED])


def runs(data: np.ndarray, begin: np.ndarray, length: int, powers: Powers):
    """Runs of windows of ``length`` bytes that share their anchor: (first window, last window, anchor).

    The anchor of a window is its leftmost least seed, so equal windows have equal anchors at equal offsets.
    ``begin`` holds the texts' starts and the end; no window crosses two texts.
    """
    width = length - SEED + 1
    bits = max(1, int(len(data)).bit_length())
    v = seeds(data, powers)
    v = (v >> np.uint64(bits) << np.uint64(bits)) | np.arange(len(v), dtype=np.uint64)
    k = 1
    while 2 * k <= width:
        v = np.minimum(v[:-k], v[k:])
        k *= 2
    rest = width - k
    v = np.minimum(v[:-rest], v[rest:]) if rest else v
    anchor = (v & np.uint64((1 << bits) - 1)).astype(np.int64)
    inside = np.zeros(len(anchor) + 1, bool)
    for a, b in zip(begin[:-1], begin[1:]):
        inside[a : max(a, b - length + 1)] = True
    inside = inside[: len(anchor)]
    turn = np.ones(len(anchor), bool)
    turn[1:] = (anchor[1:] != anchor[:-1]) | (inside[1:] != inside[:-1])
    # Neighbouring texts: the last window of one and the first of the next are length - 1 apart, so inside changes.
    first = np.flatnonzero(turn)
    last = np.append(first[1:], len(anchor)) - 1
    ok = inside[first]
    return first[ok], last[ok], anchor[first[ok]]


def _pack(header: np.ndarray, blob: bytes, tool) -> bytes:
    flat = b"".join(np.ascontiguousarray(header[f]).tobytes() for f in HEADER.names)
    return len(header).to_bytes(4, "little") + tool.compress(flat + blob)


def _unpack(payload: bytes, tool) -> tuple[np.ndarray, bytes]:
    n = int.from_bytes(payload[:4], "little")
    raw = tool.decompress(payload[4:])
    header, at = np.zeros(n, HEADER), 0
    for f in HEADER.names:
        kind = HEADER[f]
        header[f] = np.frombuffer(raw, kind, n, at)
        at += n * kind.itemsize
    return header, raw[at:]


def bundles(docs: DataFrame, length: int, buckets: int, flush: int = 12 << 20, memory: int = 150_000) -> DataFrame:
    """Documents (doc, text) to payloads by bucket of the anchor: each run's bytes, once per batch.

    Payloads leave after ``flush`` bytes of runs, and at most ``memory`` runs are remembered. A run that equals one of a smaller (doc, start) in the batch is known to repeat throughout: it travels as a range
    only (size 0 bytes, its window count in ``off``), dealt out evenly. One at the same (doc, start), of a row with the same id, is the same run and doesn't travel.
    """

    def run(batches):
        tool, powers = zstandard.ZstdCompressor(level=3), Powers()
        schema = pa.schema([("bucket", pa.int32()), ("payload", pa.binary())])

        def packed(out, known):
            rows = [(k, _pack(np.concatenate([x for x, _ in v]), b"".join([y for _, y in v]), tool)) for k, v in out.items()]
            if sum(map(len, known)):
                every = merge(np.concatenate(known), length)
                rows.append((int(every["doc"][0]) % buckets, _pack(every, b"", tool)))
            return pa.RecordBatch.from_arrays([pa.array([k for k, _ in rows], pa.int32()), pa.array([p for _, p in rows], pa.binary())], schema=schema)

        for batch in batches:
            ids, texts = batch.column(0).to_numpy(zero_copy_only=False), utf8(batch.column(1))
            order = np.argsort(ids, kind="stable").tolist()
            texts, ids = [texts[i] for i in order], ids[order]
            seen: dict[bytes, int] = {}
            out: dict[int, list] = {}
            known = []
            held = 0
            for a, b in chunks(texts, 2 << 20):
                joined = b"".join(texts[a:b])
                begin = np.concatenate([[0], np.cumsum([len(t) for t in texts[a:b]])]).astype(np.int64)
                if len(joined) < length:
                    continue
                data = np.frombuffer(joined, np.uint8)
                first, last, anchor = runs(data, begin, length, powers)
                if not first.size:
                    continue
                own = np.searchsorted(begin, first, "right") - 1
                start = first - begin[own]
                hashes = seeds(data, powers)[anchor]
                bucket = (hashes % np.uint64(buckets)).astype(np.int64)
                h = np.zeros(len(first), HEADER)
                h["doc"], h["start"], h["size"], h["off"] = ids[a + own], start, last - first + length, anchor - first
                fresh, later = np.ones(len(first), bool), np.zeros(len(first), bool)
                for i, (p, q, doc, at) in enumerate(zip(first.tolist(), (last + length).tolist(), h["doc"].tolist(), h["start"].tolist())):
                    c, place = joined[p:q], (doc << 32) + at
                    least = seen.get(c)
                    if least is None or place < least:
                        seen[c] = place
                    else:
                        fresh[i], later[i] = False, place > least
                again = h[later]
                again["off"], again["size"] = again["size"] - length + 1, 0
                known.append(again)
                pick = np.flatnonzero(fresh)
                pick = pick[np.argsort(bucket[pick], kind="stable")]
                cut = np.flatnonzero(np.diff(bucket[pick])) + 1
                for part in np.split(pick, cut):
                    if part.size:
                        blob = b"".join([joined[p:q] for p, q in zip(first[part].tolist(), (last[part] + length).tolist())])
                        out.setdefault(int(bucket[part[0]]), []).append((h[part], blob))
                        held += len(blob)
                if held > flush:
                    yield packed(out, [])
                    out, held = {}, 0
                if len(seen) > memory:
                    seen.clear()
            yield packed(out, known)

    return docs.select("doc", "text").mapInArrow(run, BUNDLE)


def merge(known: np.ndarray, length: int) -> np.ndarray:
    """Ranges of windows (doc, start, off windows) in one document that touch become one."""
    known = known[np.lexsort((known["start"], known["doc"]))]
    end = known["start"] + known["off"]
    new = np.ones(len(known), bool)
    new[1:] = (known["doc"][1:] != known["doc"][:-1]) | (known["start"][1:] > end[:-1])
    first = np.flatnonzero(new)
    out = known[first]
    out["off"] = np.maximum.reduceat(end, first) - out["start"]
    return out


def repeats(header: np.ndarray, blob: bytes, length: int):
    """Windows of these runs that also start earlier among them: (doc, start, n) arrays.

    Equal runs are one, of which the earliest place stays, also where rows of one id have it twice. The others are joined with a 0 after each, sorted by
    induced sorting, and neighbours that share ``length`` letters are the places of one window.
    """
    at = np.concatenate([[0], np.cumsum(header["size"].astype(np.int64))])
    data = np.frombuffer(blob, np.uint8)
    key = np.zeros(len(header), np.uint64)
    with np.errstate(over="ignore"):
        for k in range(SEED):
            key = mix(key * np.uint64(0xD6E8FEB86659FD93) + data[at[:-1] + header["off"] + k])
    order = np.lexsort((header["start"], header["doc"], key))
    k = key[order]
    shared = np.zeros(len(k), bool)
    shared[1:] = k[1:] == k[:-1]
    shared[:-1] |= k[1:] == k[:-1]
    order = order[shared]
    out = []
    # Runs of one seed follow each other, earliest first; equal ones fold into the first.
    reps, first_of, whole = [], {}, []
    before = None
    places = zip(header["doc"][order].tolist(), header["start"][order].tolist())
    for i, s, place in zip(order.tolist(), k[shared].tolist(), places):
        if s != before:
            first_of, before = {}, s
        c = blob[at[i] : at[i + 1]]
        if c not in first_of:
            first_of[c] = place
            reps.append((i, s))
        elif place > first_of[c]:
            whole.append(i)
    if whole:
        w = header[whole]
        out.append((w["doc"], w["start"], w["size"] - length + 1))
    if len(reps) > 1:
        seed = np.array([s for _, s in reps], np.uint64)
        pick = np.array([i for i, _ in reps])
        many = np.zeros(len(seed), bool)
        many[1:] = seed[1:] == seed[:-1]
        many[:-1] |= seed[1:] == seed[:-1]
        pick = pick[many]
        if pick.size:
            h = header[pick]
            size = h["size"].astype(np.int64) + 1
            text = np.frombuffer(b"\0".join([blob[at[i] : at[i + 1]] for i in pick.tolist()]) + b"\0", np.uint8).astype(np.int16) + 1
            stop = np.cumsum(size) - 1
            text[stop] = 0
            sa = suffix_array(text)
            lcp = permuted_lcp(text, sa)
            own = np.repeat(np.arange(len(h)), size)
            into = np.arange(len(text)) - np.repeat(stop + 1 - size, size)
            fits = into <= (h["size"] - length)[own]
            rank = np.unique(h["doc"], return_inverse=True)[1].astype(np.int64)
            place = (rank[own] << 32) | (h["start"][own] + into)
            # A suffix that is cut off by the end of its run shares fewer letters with both neighbours.
            group = np.flatnonzero(np.append(True, lcp[sa[1:]] < length))
            least = np.minimum.reduceat(place[sa], group)
            least = np.repeat(least, np.diff(np.append(group, len(sa))))
            again = np.zeros(len(text) + 1, bool)
            again[sa] = place[sa] > least
            again[:-1] &= fits
            edge = np.flatnonzero(np.diff(np.concatenate([[False], again]).view(np.int8)))
            a, b = edge[::2], edge[1::2]
            out.append((h["doc"][own[a]], h["start"][own[a]] + into[a], b - a))
    if not out:
        return (np.zeros(0, np.int64),) * 3
    return tuple(np.concatenate(x).astype(np.int64) for x in zip(*out))


def digests(header: np.ndarray, blob: bytes, length: int):
    """Every window of these runs as (doc, start, two halves of its 128-bit digest)."""
    at = np.concatenate([[0], np.cumsum(header["size"].astype(np.int64))]).tolist()
    docs, starts, halves = [], [], []
    for i, h in enumerate(header):
        n = int(h["size"]) - length + 1
        docs += [int(h["doc"])] * n
        starts += range(int(h["start"]), int(h["start"]) + n)
        halves += [hashlib.blake2b(blob[at[i] + k : at[i] + k + length], digest_size=16).digest() for k in range(n)]
    pair = np.frombuffer(b"".join(halves), "<i8").reshape(-1, 2)
    return np.array(docs, np.int64), np.array(starts, np.int64), pair[:, 0], pair[:, 1]


def ranges(packed: DataFrame, length: int, buckets: int, limit: int) -> DataFrame:
    """Repeated windows per document, as (doc, start, n windows); d1 and d2 are null.

    A task holds one bucket, up to ``limit`` bytes of it. Beyond, the anchors with most bytes leave the
    bucket: all their windows, met before or later, come out as single windows with their digest in d1 and d2.
    """

    def run(batches):
        tool = zstandard.ZstdDecompressor()
        schema = pa.schema([("doc", pa.int64()), ("start", pa.int32()), ("n", pa.int32()), ("d1", pa.int64()), ("d2", pa.int64())])

        def rows(doc, start, n, d1=None, d2=None):
            none = pa.nulls(len(doc), pa.int64())
            return pa.RecordBatch.from_arrays([pa.array(doc, pa.int64()), pa.array(start.astype(np.int32)), pa.array(np.asarray(n).astype(np.int32)), none if d1 is None else pa.array(d1, pa.int64()), none if d2 is None else pa.array(d2, pa.int64())], schema=schema)

        def spilled(header, blob):
            step = 2000
            at = np.concatenate([[0], np.cumsum(header["size"].astype(np.int64))])
            for i in range(0, len(header), step):
                part = header[i : i + step]
                doc, start, d1, d2 = digests(part, blob[at[i] : at[min(i + step, len(header))]], length)
                yield rows(doc, start, np.ones(len(doc)), d1, d2)

        def split(header, blob, out):
            """(the rest, its bytes, the runs of the anchors in ``out``, their bytes)"""
            at = np.concatenate([[0], np.cumsum(header["size"].astype(np.int64))]).tolist()
            hot = np.array([blob[at[i] + o : at[i] + o + SEED] in out for i, o in enumerate(header["off"].tolist())], bool)
            pick = lambda m: b"".join([blob[at[i] : at[i + 1]] for i in np.flatnonzero(m).tolist()])
            return header[~hot], pick(~hot), header[hot], pick(hot)

        now, heads, blobs, held, hot = None, [], [], 0, set()

        def close():
            if heads:
                doc, start, n = repeats(np.concatenate(heads), b"".join(blobs), length)
                yield rows(doc, start, n)

        for batch in batches:
            for bucket, payload in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if bucket != now:
                    yield from close()
                    now, heads, blobs, held, hot = bucket, [], [], 0, set()
                header, blob = _unpack(payload, tool)
                ready = header["size"] == 0
                if ready.any():
                    yield rows(header["doc"][ready], header["start"][ready], header["off"][ready])
                    header = header[~ready]
                if hot:
                    header, blob, h, b = split(header, blob, hot)
                    yield from spilled(h, b)
                heads.append(header)
                blobs.append(blob)
                held += len(blob)
                if held > limit:
                    header, blob = np.concatenate(heads), b"".join(blobs)
                    at = np.concatenate([[0], np.cumsum(header["size"].astype(np.int64))]).tolist()
                    weight: dict[bytes, int] = {}
                    for i, (o, s) in enumerate(zip(header["off"].tolist(), header["size"].tolist())):
                        k = blob[at[i] + o : at[i] + o + SEED]
                        weight[k] = weight.get(k, 0) + s
                    for k in sorted(weight, key=weight.get, reverse=True):
                        if held <= limit // 2:
                            break
                        hot.add(k)
                        held -= weight[k]
                    header, blob, h, b = split(header, blob, hot)
                    yield from spilled(h, b)
                    heads, blobs, held = [header], [blob], len(blob)
        yield from close()

    return packed.repartition(buckets, "bucket").sortWithinPartitions("bucket").mapInArrow(run, RANGES)


def remove_repeats(docs: DataFrame, length: int = 100, id_col: str = "doc_id", text_col: str = "text", bucket_bytes: int = 6 << 20, limit: int = 48 << 20) -> DataFrame:
    """Remove each byte that a string of ``length`` bytes covers which also starts earlier (smaller id, or same id and
    earlier start). Per row: id, n_bytes, n_removed, n_spans, kept_sha256 and ``kept`` (the bytes that remain).

    1. Windows are grouped into runs by their least seed; a run's bytes go to the bucket of that seed, so equal windows
       meet. Runs repeated within a batch travel once.
    2. Each bucket is sorted by induced sorting; common prefixes of ``length`` or more group equal windows, all but the
       first of which repeat. Anchors too frequent for a task's memory are grouped by window digests in Spark instead.
    3. Ranges gather by document and meet its text.

    Null and empty texts have no bytes. Rows of one id are one document in the order: equal rows leave each
    other alone; if they differ in text, ranges found in one apply to all, cut at their ends. A null id comes after
    all others. Ids are integers; other columns are not read.
    """
    rows = docs.select(F.col(id_col), F.coalesce(F.col(id_col), F.lit(LAST)).cast("long").alias("doc"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = max(1, math.ceil(total / bucket_bytes))
    found = stage(ranges(bundles(rows, length, buckets), length, buckets, limit), "ranges")
    sure = found.where("d1 IS NULL").select("doc", "start", "n")
    loose = found.where("d1 IS NOT NULL")
    first = loose.groupBy("d1", "d2").agg(F.min(F.struct("doc", "start")).alias("f"))
    later = loose.join(first, ["d1", "d2"]).where(F.struct("doc", "start") > F.col("f")).select("doc", "start", "n")
    cuts = sure.unionByName(later).groupBy("doc").agg(F.sort_array(F.collect_list(F.struct("start", "n"))).alias("_cuts"))

    def make():
        def work(texts, cuts):
            out: list[list] = [[] for _ in range(5)]
            for t, c in zip(utf8(texts), cuts.to_pylist()):
                kept, at, removed, spans, end = [], 0, 0, 0, -1
                for x in c or []:
                    a, b = x["start"], min(x["start"] + x["n"] + length - 1, len(t))
                    if a >= b:
                        continue
                    if a > end:
                        spans += 1
                        kept.append(t[at:a])
                        removed += b - a
                    elif b > end:
                        removed += b - end
                    at = end = max(end, b)
                rest = b"".join(kept) + t[at:]
                for o, v in zip(out, (len(t), removed, spans, hashlib.sha256(rest).hexdigest(), rest)):
                    o.append(v)
            return out

        return work

    return map_rows(rows.join(cuts, "doc", "left"), ["text", "_cuts"], "n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary", make, [id_col])
