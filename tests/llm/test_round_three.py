"""Phrases, fill-in-the-middle and mixing against plain versions, and on edge cases."""

import collections
import hashlib
import os
import re
import time
from html.parser import HTMLParser

import numpy as np
import pytest
from pyspark.sql import types as T

from cellweave.llm import common, fill_middle, html_text, mixing, near_dups, packing, phrases
from tests.llm import brute as B

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
LONG = ("alpha beta gamma, delta epsilon " * 4000) + "x" * 50_000
CLASH = ["size", "n", "a", "phrase", "k", "w", "key", "place", "body", "id", "form", "rank", "target", "taken", "pass", "start", "words", "_h", "_upto", "cap", "_file", "hash", "output"]
EDGE = [(1, None, None), (2, "", "s"), (3, " \n\t ", "s"), (4, "one", None), (5, LONG, "s"), (6, LONG, "t"), (6, LONG, "t"), (None, "no id at all, but words", "t"), (9, "tail é́ ñ 漢字 \U0001f600 ", "u"), (10, "<P> and <M>", "u"), (10, "ab " * 12, "")]


def make(spark, rows):
    schema = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()), T.StructField("source", T.StringType())] + [T.StructField(c, T.StringType()) for c in CLASH])
    return spark.createDataFrame([(i, t, None if i == 4 else "en", s, *["x"] * len(CLASH)) for i, t, s in rows], schema)


@pytest.fixture(scope="module")
def edge(spark):
    return make(spark, EDGE)


@pytest.fixture(scope="module")
def none(spark):
    return make(spark, [])


# 11 phrases


def plain_phrases(rows, top=2000, shortest=2, longest=3, least=10, covered=50):
    f, n = collections.Counter(), collections.Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", B.lower(text or "")):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            for k in range(1, longest + 1):
                f.update((lang, tuple(w[i : i + k])) for i in range(len(w) - k + 1))
    f = {k: v for k, v in f.items() if v >= least}
    cand = {k: v for k, v in f.items() if len(k[1]) >= shortest}
    most = collections.defaultdict(int)
    for (lang, p), a in cand.items():
        for m in range(shortest, len(p)):
            for i in range(len(p) - m + 1):
                most[lang, p[i : i + m]] = max(most[lang, p[i : i + m]], a)
    out = collections.defaultdict(list)
    for (lang, p), a in cand.items():
        if 100 * most[lang, p] < covered * a:
            score, k = min((1000000 * a * a // (f[lang, p[:k]] * f[lang, p[k:]]), k) for k in range(1, len(p)))
            out[lang].append((-score, -a, " ".join(p).encode(), f[lang, p[:k]], f[lang, p[k:]]))
    return sorted((lang, r, p.decode(), -a, x, y, n[lang], -s) for lang, found in out.items() for r, (s, a, p, x, y) in enumerate(sorted(found)[:top], 1))


def got_phrases(df, **how):
    return sorted((r.lang, r["rank"], r.phrase, r.a, r.l, r.r, r.n, r.score) for r in phrases.collocations(df, **how).collect())


@pytest.mark.parametrize("how", [{}, {"share": 0.0}, {"share": 1.0, "bits": 8}, {"top": 5, "share": 0.3}])
def test_phrases(spark, how):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    want = plain_phrases([(r.lang, r.text) for r in docs.collect()], how.get("top", 2000))
    assert want and got_phrases(docs, **how) == want


def test_phrases_of_random_words(spark):
    rng = np.random.default_rng(2)
    word = lambda: str(rng.choice(["a", "B", "ü", "x-y", "0"], p=[0.4, 0.3, 0.1, 0.1, 0.1])) + str(rng.choice([" ", "  ", "\t", ", ", ".\n", "\x0b"]))
    data = [(i, "".join(word() for _ in range(rng.integers(0, 60))), ["en", None, "und", ""][i % 4]) for i in range(300)]
    df = spark.createDataFrame(data, "doc_id long, text string, lang string").repartition(5)
    rows = [(x, t) for _, t, x in data]
    assert got_phrases(df) == plain_phrases(rows)
    assert got_phrases(df, longest=5, min_count=4, covered=80) == plain_phrases(rows, longest=5, least=4, covered=80)
    assert got_phrases(df, longest=2) == plain_phrases(rows, longest=2)


def test_border_failures_are_found(spark):
    # The sample (no text) proposes nothing: pairs and triples of frequent words are failures of the border, found pass by pass.
    df = spark.createDataFrame([(i, "p q r s") for i in range(10)], "doc_id long, text string").selectExpr("*", "'en' AS lang")
    counts = phrases.frequent(df, share=0.0)
    assert {r.phrase: r.n for r in counts.where("size > 1").collect()} == {"p q": 10, "q r": 10, "r s": 10, "p q r": 10, "q r s": 10}


def test_pieces_are_never_cut():
    rng = np.random.default_rng(6)
    text = "".join(rng.choice(list("ab ,"), 5000)).encode()
    data = np.frombuffer(text, np.uint8)
    for size in (1, 7, 100, 10_000):
        parts = list(phrases.cuts(data, size))
        assert parts[0][0] == 0 and parts[-1][1] == len(data) and all(a[1] == b[0] for a, b in zip(parts, parts[1:]))
        assert all(text[e - 1 : e] == b"," for _, e in parts[:-1])


def test_phrases_of_edge_cases(edge, none):
    assert got_phrases(edge) == plain_phrases([(None if i == 4 else "en", t) for i, t, _ in EDGE])
    assert phrases.collocations(none).count() == 0


def test_what_the_sample_spells_is_not_spelled_by_every_task(spark, monkeypatch):
    rows = [(f"one two three four five u{i}", "en") for i in range(400)] + [("only here", "fr")] * 12
    df = spark.createDataFrame(rows, "text string, lang string").repartition(40)
    marked, spell = [], phrases.spell

    def watched(texts, wanted, **how):
        marked.append(sum(int(np.bitwise_count(m.words).sum()) for m in wanted))
        return spell(texts, wanted, **how)

    monkeypatch.setattr(phrases, "spell", watched)
    got = {(r.lang, r.phrase): r.n for r in phrases.frequent(df).collect()}
    assert got["en", "one two three"] == 400 and got["fr", "only here"] == 12 and got["en", None] == 2400
    # 12 phrases of the language that the sample holds; those of a text that it may lack are at most 3.
    assert len(marked) == 2 and 12 <= marked[0] <= 15 and marked[1] <= 3


def test_one_hash_of_two_sequences_adds_nothing_up():
    t = phrases.Tally(1, 100)
    h, g = np.array([5, 5, 7, 5], np.uint64), np.array([1, 2, 1, 1], np.uint64)
    assert not [*t.add(h, g), *t.add(h, g)]
    got = {}
    for b in t.rows():
        for r in b.to_pylist():
            got[r["hash"], r["second"]] = got.get((r["hash"], r["second"]), 0) + r["n"]
    assert got == {(5, 1): 4, (5, 2): 2, (7, 1): 2}


def test_batches_are_bounded_by_bytes(spark):
    df = spark.range(300).selectExpr("id", "repeat('abcdefgh', 5000) AS text").coalesce(1)
    got = common.map_rows(df, ["text"], "held long", lambda: lambda texts: [[texts.nbytes] * len(texts)])
    assert 0 < got.agg({"held": "max"}).first()[0] <= common.BATCH + 100_000


# 12 fill in the middle


def plain_example(doc_id, text, seed=42):
    text = text or ""
    u = re.findall(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+", text)
    n = len(u)
    x = hashlib.sha256(f"{seed}:{'null' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(x[i : i + 8], 16) for i in (0, 8, 16, 24)]
    if not text or re.search("<[PSM]>", text) or h[2] % 100 >= 50:
        return n, "plain", None, None, text
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    p, m, s = "".join(u[:a]), "".join(u[a:b]), "".join(u[b:])
    return (n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}") if h[3] % 100 < 80 else (n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}")


def check_examples(got, rows):
    want = sorted((str(i), *map(str, plain_example(i, t)), B.sha(plain_example(i, t)[-1]), B.sha(t or "")) for i, t in rows)
    assert sorted((str(r.doc_id), str(r.n), r.form, str(r.prefix_chars), str(r.middle_chars), r.output, r.output_sha256, r.restored_sha256) for r in got) == want


@pytest.mark.parametrize("chunk", [8192, 37])
def test_examples(spark, chunk):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    got = fill_middle.transform(docs, chunk=chunk).collect()
    check_examples(got, rows)
    assert {r.form for r in got} == {"plain", "psm", "spm"}


def test_examples_of_edge_cases(spark, edge, none):
    check_examples(fill_middle.transform(edge, chunk=1000).collect(), [(i, t) for i, t, _ in EDGE])
    assert fill_middle.transform(none).count() == 0 and "output" not in fill_middle.transform(none, with_text=False).columns
    many = [(i % 40, "é " * (i % 7) + "w" * (i % 5)) for i in range(400)] + [(i, "<" * 50 + "P" + "> \n") for i in range(60)]
    check_examples(fill_middle.transform(spark.createDataFrame(many, "doc_id long, text string").repartition(3), chunk=3).collect(), many)
    assert fill_middle.transform(spark.createDataFrame([("a", "b c")], "doc_id string, text string")).first().restored_sha256 == B.sha("b c")


def test_equal_rows_are_dealt_to_many_tasks(spark):
    same = spark.createDataFrame([(7, "one two three")] * 500, "doc_id long, text string")
    keys = {r.key for r in fill_middle.pieces(same).select("key").collect()}
    assert len(keys) == 500


def test_marks_are_read_across_pieces():
    for text, form in ((b"<P>ab<S>c<<M><S", "psm"), (b"<S><P><<P<M>xyz", "spm")):
        for step in range(1, 8):
            parts, found = fill_middle.Parts(form), collections.defaultdict(bytes)
            for i in range(0, len(text), step):
                for part, body in parts.feed(text[i : i + step]):
                    found[part] += body
            for part, body in parts.end():
                found[part] += body
            assert {k: v for k, v in found.items() if v} == ({0: b"ab", 2: b"c<", 1: b"<S"} if form == "psm" else {0: b"<<P", 1: b"xyz"})


# 13 mixing


def plain_targets(sizes, weights=(5, 2, 1), most=3):
    """By sharing again and again, in exact fractions, as the text of the rule says."""
    from fractions import Fraction

    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    total, fixed = Fraction(sum(sizes.values())), {}
    while True:
        free = [s for s in names if s not in fixed]
        rest, ws = total - sum(fixed.values()), sum(w[s] for s in free)
        share = {s: rest * w[s] / ws for s in free} if ws else {}
        over = [s for s in free if share[s] > most * sizes[s]]
        if not over:
            return {s: float(v) for s, v in (fixed | share).items()}
        fixed |= {s: Fraction(most * sizes[s]) for s in over}


def words(t):
    return len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))


def check_mix(df, rows, packet=512):
    got = mixing.report(df, packet=packet).collect()
    assert sorted((str(r.doc_id), r.size) for r in got) == sorted((str(i), words(t)) for i, t, _ in rows)
    sizes = collections.Counter()
    for _, t, s in rows:
        sizes[s] += words(t)
    want, total = plain_targets(sizes), sum(sizes.values())
    near = {round(t, 6) for t in want.values()}
    assert all(round(r.target, 6) in near and 0 <= r.taken <= 3 * r.size for r in got)
    assert sum(r.taken for r in got) == total
    ids = collections.defaultdict(set)
    for i, _, s in rows:
        ids[i].add(s)
    taken = collections.Counter()
    for r in got:
        if len(ids[r.doc_id]) == 1:
            s = next(iter(ids[r.doc_id]))
            taken[s] += r.taken
            assert r.source_size == sizes[s] and r.target == pytest.approx(want[s])
    return got, want, taken


def test_mix(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = [(r.doc_id, r.text, r.source) for r in docs.collect()]
    got, want, taken = check_mix(docs, rows)
    # A source is off by its packet at the cut, and by its share of what the cut ones leave over.
    assert all(abs(taken[s] - want[s]) <= 512 + 512 * len(want) * want[s] / sum(want.values()) for s in want)
    again = mixing.report(docs.repartition(3)).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, again))


def test_mix_in_order(spark):
    rng = np.random.default_rng(9)
    data = [(i, "w " * int(rng.integers(0, 90)), "abcdef"[min(5, int(rng.exponential(1.2)))]) for i in range(500)]
    df = spark.createDataFrame(data, "doc_id long, text string, source string").repartition(4)
    check_mix(df, data, 10)
    rows, packets = mixing.mix(df, packet=10)
    p = sorted(packets.collect(), key=lambda r: r.place)
    assert p[0].place == 0 and all(a.place + a.words == b.place and a.finish <= b.finish for a, b in zip(p, p[1:]))
    assert p[-1].place + p[-1].words == sum(words(t) for _, t, _ in data)
    # Each source's words come in whole passes, in one shuffled order.
    for s in "abcdef":
        mine = [r for r in p if r.source == s]
        first = [(r.id, r.start) for r in mine if r["pass"] == 0]
        assert [r["pass"] for r in mine] == sorted(r["pass"] for r in mine) and len(set(first)) == len(first)
        for k in (1, 2):
            later = [(r.id, r.start) for r in mine if r["pass"] == k]
            assert later == first[: len(later)]


def test_mix_of_edge_cases(spark, edge, none):
    check_mix(edge, EDGE)
    assert mixing.report(none).count() == 0
    bare = spark.createDataFrame([(1, None, "a"), (2, "", None)], "doc_id long, text string, source string")
    assert [(r.size, r.target, r.taken) for r in mixing.report(bare).collect()] == [(0, 0.0, 0)] * 2
    # All but one source stop at their limit.
    tight = [(i, "w " * 3, "abcdefgh"[i % 8]) for i in range(8)] + [(100 + i, "w " * 500, "i") for i in range(40)]
    check_mix(spark.createDataFrame(tight, "doc_id long, text string, source string"), tight, 50)


# 2 pages


@pytest.mark.parametrize("page", [
    "<a" * 100_000, "<" + "a" * 1_000_000, "<div>" * 100_000 + "x", "<a x=\">y\" " * 50_000, "<a x=\"" * 100_000 + ">", "<blockquote>" * 50_000 + "x", "<ul><li>" * 50_000 + "x",
    "<table><tr><td>" * 20_000 + "x", "<p>" * 100_000, "<b>" * 50_000 + "</i>" * 50_000, "<" * 300_000, "<script>" * 50_000, "<table>" + "<tr><td>x" * 30_000, "<a '\"=>" * 50_000,
], ids=range(14))
def test_odd_pages_take_linear_time(page):
    start = time.process_time()
    html_text.render(html_text.parse(page))
    assert time.process_time() - start < 8


@pytest.mark.parametrize(("page", "text"), [
    ("x <a href=\"u>link y", "x link y"), ("a <b x='1>2'>c</b> <i y=\">z\">d", "a c d"), ("<p class=a'b>t<p>u", "t\n\nu"), ("a <b", "a <b"),
    ("<table><tr><td rowspan=2>a<td>b<tr><td>c<tr><td>d<td>e</table>", "a  b\n   c\nd  e"),
    ("<table><tr><td>a<td rowspan=0>b<td>c<tr><td>d<td>e</table>", "a  b  c\nd     e"),
    ("<table><tr><td rowspan=2 colspan=2>a<td>b<tr><td>c<tr><td>d<td>e<td>f</table>", "a     b\n      c\nd  e  f"),
    ("<div>" * 60 + "<ul><li>" * 60 + "x" + "</ul>" * 60 + "<p>y", "- " * 50 + "x\n\ny"),
])
def test_markup(page, text):
    got = html_text.render(html_text.parse(page))
    assert got.replace(" ", "") == text.replace(" ", "") if page.startswith("<div>") else got == text


class Plain(HTMLParser):
    """Visible words by the standard library's parser: a second, plainer reader."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.off, self.words = [], []

    def handle_starttag(self, tag, attrs):
        a = dict(attrs)
        hide = tag in html_text.HIDDEN or "hidden" in a or html_text.CONCEALED.search(a.get("style") or "")
        if tag not in html_text.VOID and (hide or self.off):
            self.off.append(tag)
        if tag in html_text.BLOCK or tag == "br":
            self.words.append(" ")

    def handle_endtag(self, tag):
        if tag in self.off:
            while self.off.pop() != tag:
                pass
        if tag in html_text.BLOCK:
            self.words.append(" ")

    def handle_data(self, data):
        if not self.off:
            self.words.append(data)


def test_pages_hold_all_visible_words(spark):
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    mark = re.compile(r"^(\s*(-|\d+\.) )+", re.M)
    for r in html_text.extract(pages).collect():
        p = Plain()
        p.feed(r.html)
        assert sorted(mark.sub("", r.text).split()) == sorted(x for x in "".join(p.words).split() if not re.fullmatch(r"-|\d+\.", x)), r.page_id


# 7 tokens of packed pieces


def test_words_are_tokenized_as_by_the_whole_tokenizer():
    enc, small = packing.Encoder(packing.tokenizer_path()), packing.Encoder(packing.tokenizer_path(), memo=40)
    rng = np.random.default_rng(3)
    letters = list("aAbZ019'\u2019s t.<|>éÉßẞİıœŒÿŸ×÷²ªµ漢Σς\n\x1c\x85\U0001f600ñÑ") + ["'S", "'RE", "'ll", "<|endoftext|>", "don't", "e\u0301"]
    for _ in range(3000):
        t = "".join(rng.choice(letters, rng.integers(0, 25)))
        want = np.asarray(enc.whole.encode(t, add_special_tokens=False).ids, "<u4").tobytes()
        assert enc(t.encode()) == small(t.encode()) == want, t


# 9 near duplicates


def test_keep_one_of_repeated_ids(spark):
    rng = np.random.default_rng(5)
    text = lambda n: " ".join(f"w{x}" for x in rng.integers(0, 5000, n))
    a, b, c = text(60), text(60), text(60)
    data = [(1, a, "x"), (2, a, "y"), (3, b, "x"), (3, b, "z"), (4, c, "q"), (4, text(50), "q"), (None, a, "n"), (5, "", "e"), (6, None, "e"), (None, text(40), "n")]
    df = spark.createDataFrame(data, "doc_id long, text string, _id string")
    got = near_dups.keep_one(df)
    assert got.columns == df.columns and sorted(str(r.doc_id) for r in got.collect()) == ["1", "3", "4", "5", "6", "None"]


@pytest.mark.parametrize("small", [1, 2])
def test_pivot_rounds_find_every_link(spark, small):
    """Groups of 20 to 59 edited copies: with small buckets all links beyond the direct pairs come from pivot rounds."""
    rng = np.random.default_rng(12)
    data, i = [], 0
    for size in (20, 35, 59):
        base = [f"w{x}" for x in rng.integers(0, 100_000, 120)]
        for _ in range(size):
            t = list(base)
            for at in rng.integers(0, len(t), int(rng.integers(0, 4))):
                t[at] = f"e{rng.integers(0, 50)}"
            data.append((i, " ".join(t)))
            i += 1
    want = B.components(data)
    got = near_dups.near_duplicates(spark.createDataFrame(data, "doc_id long, text string").repartition(4), small=small, bands=60).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == want
