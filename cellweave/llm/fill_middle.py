"""Fill-in-the-middle examples by secondary sort: pieces of units keyed by document and place stream into digests."""

from __future__ import annotations

import hashlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .common import utf8
from .words import BLANK

# The marks that stand before prefix, suffix and middle.
MARKS = {"prefix": b"<P>", "suffix": b"<S>", "middle": b"<M>"}
ORDER = {"psm": ("prefix", "suffix", "middle"), "spm": ("suffix", "prefix", "middle")}
SOURCE = {"prefix": 0, "middle": 1, "suffix": 2}
PIECE = "key binary, place long, body binary, n long, form string, prefix_chars long, middle_chars long, output_sha256 string, output string"
HEAD = -1  #: place of a document's first record, which carries its figures


def unit_ends(text: bytes) -> np.ndarray:
    """Ends of the units: white space and the word after it; white space at the end is a unit of its own."""
    solid = ~BLANK[np.frombuffer(text, np.uint8)]
    ends = np.flatnonzero(solid & ~np.append(solid[1:], False)) + 1
    return np.append(ends, len(text)) if len(text) and not solid[-1] else ends


def decide(doc_id, text: bytes, ends: np.ndarray, seed: int, rate: int, spm_rate: int) -> tuple[str, int, int]:
    """(form, byte at which the prefix ends, byte at which the middle ends)."""
    digest = hashlib.sha256(f"{seed}:{'null' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(digest[i : i + 8], 16) for i in (0, 8, 16, 24))
    if not text or h3 % 100 >= rate or any(m in text for m in MARKS.values()):
        return "plain", 0, 0
    a, b = sorted((h1 % (len(ends) + 1), h2 % (len(ends) + 1)))
    return "spm" if h4 % 100 < spm_rate else "psm", *(int(ends[k - 1]) if k else 0 for k in (a, b))


def chunks(text: bytes, ends: np.ndarray, first: int, end: int, size: int):
    """The bytes first .. end in runs of whole units of at most ``size`` bytes; a longer unit is cut."""
    while first < end:
        k = int(np.searchsorted(ends, first + size, "right"))
        stop = int(ends[k - 1]) if k else 0
        stop = min(end, stop if stop > first else first + size)
        yield text[first:stop]
        first = stop


class Rows:
    """Rows gathered into record batches of a few megabytes."""

    def __init__(self, schema: pa.Schema, limit: int = 4 << 20, most: int = 8192):
        self.schema, self.limit, self.most, self.rows, self.held = schema, limit, most, [], 0

    def put(self, weight: int, **row):
        self.rows.append(row)
        self.held += weight
        if self.held >= self.limit or len(self.rows) >= self.most:
            yield self.flush()

    def flush(self):
        out = pa.RecordBatch.from_arrays([pa.array([r.get(f.name) for r in self.rows], f.type) for f in self.schema], schema=self.schema)
        self.rows, self.held = [], 0
        return out


def pieces(docs: DataFrame, seed: int = 42, rate: int = 50, spm_rate: int = 80, chunk: int = 8192, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece of each document's output, with its place there; a head row holds the figures.

    The key names a row: a digest of id and text, the number of the task and, among equal rows of a task, a count. A task that runs
    again on the same rows in another order makes the same pieces, and equal rows have keys that are dealt to different tasks.
    """
    id_field = docs.schema[id_col]
    schema = StructType.fromDDL(PIECE).add("id", id_field.dataType)
    docs = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))

    def run(batches):
        from pyspark.sql.pandas.types import to_arrow_schema

        out, seen = Rows(to_arrow_schema(schema)), Counter()
        task = TaskContext.get().partitionId().to_bytes(4, "big")
        for batch in batches:
            for i, text in zip(batch.column(0).to_pylist(), utf8(batch.column(1))):
                digest = hashlib.blake2b(text, digest_size=12, key=str(i).encode()[:64]).digest() + task
                key = digest + seen[digest].to_bytes(4, "big")
                seen[digest] += 1
                ends = unit_ends(text)
                form, a, b = decide(i, text, ends, seed, rate, spm_rate)
                chars = lambda x, y: len(text[x:y].decode()) if form != "plain" else None
                yield from out.put(64, key=key, place=HEAD, id=i, n=len(ends), form=form, prefix_chars=chars(0, a), middle_chars=chars(a, b))
                spans = {"prefix": (0, a), "middle": (a, b), "suffix": (b, len(text))}
                bodies = [spans[p] for p in ORDER[form]] if form != "plain" else [(0, len(text))]
                place = 0
                for k, (x, y) in enumerate(bodies):
                    if form != "plain":
                        yield from out.put(64, key=key, place=place, body=MARKS[ORDER[form][k]])
                        place += 1
                    for body in chunks(text, ends, x, y, chunk):
                        yield from out.put(64 + len(body), key=key, place=place, body=body)
                        place += 1
        yield out.flush()

    return docs.mapInArrow(run, schema)


class Parts:
    """Reads an output as it streams by and tells which part of the source each stretch belongs to."""

    def __init__(self, form: str):
        self.todo = [(MARKS[p], SOURCE[p]) for p in ORDER.get(form, ())]
        self.part, self.held = 0, b""

    def feed(self, body: bytes):
        data = self.held + body
        while self.todo:
            at = data.find(self.todo[0][0])
            if at < 0:
                self.held = data[-2:]
                yield self.part, data[:-2]
                return
            yield self.part, data[:at]
            mark, self.part = self.todo.pop(0)
            data = data[at + len(mark) :]
        self.held = b""
        yield self.part, data

    def end(self):
        yield self.part, self.held


def _columns(batch: pa.RecordBatch, names: list[str]):
    return zip(*[batch.column(batch.schema.get_field_index(c)).to_pylist() for c in names])


def _sorted(rows: DataFrame) -> DataFrame:
    return rows.sortWithinPartitions("key", "place")


def assemble(parts: DataFrame, with_text: bool = False) -> DataFrame:
    """(id, n, form, prefix_chars, middle_chars, output_sha256, restored_sha256, output) per document.

    The pieces are shuffled once by key and sorted in their partition (a secondary sort, which spills). One pass streams
    them into the digest of the output, reads the marks off that output alone and names each stretch's place in the source;
    sorted again, still in the same partition, they stream into the digest of the restored text. No document is
    gathered, unless ``with_text`` asks for the output as one value.
    """
    figures = ["n", "form", "prefix_chars", "middle_chars", "id"]
    schema = parts.schema
    done = StructType([f for f in schema if f.name not in ("key", "place", "body")]).add("restored_sha256", "string")

    def output(batches):
        from pyspark.sql.pandas.types import to_arrow_schema

        out, open_ = Rows(to_arrow_schema(schema)), None

        def close():
            head, digest, reader, told, kept = open_
            for part, body in reader.end():
                if body:
                    yield from out.put(64 + len(body), key=head["key"], place=(part << 40) + told, body=body)
            text = b"".join(kept).decode() if with_text else None
            yield from out.put(128 + (len(text) if text else 0), **head, place=HEAD, output_sha256=digest.hexdigest(), output=text)

        for batch in batches:
            for key, place, body, *rest in _columns(batch, ["key", "place", "body", *figures]):
                if place == HEAD:
                    if open_:
                        yield from close()
                    head = dict(zip(figures, rest)) | {"key": key}
                    open_ = [head, hashlib.sha256(), Parts(head["form"]), 0, []]
                    continue
                open_[1].update(body)
                if with_text:
                    open_[4].append(body)
                for part, stretch in open_[2].feed(body):
                    if stretch:
                        yield from out.put(64 + len(stretch), key=key, place=(part << 40) + open_[3], body=stretch)
                        open_[3] += 1
        if open_:
            yield from close()
        yield out.flush()

    def source(batches):
        from pyspark.sql.pandas.types import to_arrow_schema

        target = to_arrow_schema(done)
        names = [n for n in target.names if n != "restored_sha256"]
        out, head, digest = Rows(target), None, None
        for batch in batches:
            for place, body, *rest in _columns(batch, ["place", "body", *names]):
                if place == HEAD:
                    if head:
                        yield from out.put(128 + len(head["output"] or ""), **head, restored_sha256=digest.hexdigest())
                    head, digest = dict(zip(names, rest)), hashlib.sha256()
                else:
                    digest.update(body)
        if head:
            yield from out.put(128, **head, restored_sha256=digest.hexdigest())
        yield out.flush()

    return _sorted(_sorted(parts.repartition("key")).mapInArrow(output, schema)).mapInArrow(source, done)


def transform(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", with_text: bool = True, **how) -> DataFrame:
    """Every row's example: id, n (units), form (plain, psm or spm), prefix_chars, middle_chars, both digests and, if asked for, the output.

    Of 100 documents ``rate`` are split, of these ``spm_rate`` suffix first; the digest of ``seed:id`` decides all. A text that is empty
    or holds a mark stays plain, a null text is an empty one, a null id counts as ``null``. Repeated rows each have their own
    result; texts of any length are cut into pieces of ``chunk`` bytes; other columns aren't read.
    """
    out = assemble(pieces(docs, id_col=id_col, text_col=text_col, **how), with_text)
    names = ["n", "form", "prefix_chars", "middle_chars", "output_sha256", "restored_sha256"] + (["output"] if with_text else [])
    return out.select(F.col("id").alias(id_col), *names)
