"""WARC bundles, ranked search and whitening against plain versions."""

import collections
import io
import math
import re
from hashlib import sha1

import numpy as np
import pytest
import zstandard
from pyarrow import fs
from pyspark.sql import functions as F

from tidemark.llm import rank, warc, whiten

PAGES = "page_id long, url string, html string, digest string, size int"
BIG = "<p>" + "same words " * 120 + "</p>"


@pytest.fixture(scope="module")
def pages(spark):
    rows = [(i, f"https://a.example/{i}", f"<h1>{i}</h1>" + "ü" * (i * 7), "x", 1) for i in range(60)]
    rows += [(100 + i, f"https://b.example/ {i}\n", BIG, None, None) for i in range(5)]
    rows += [(200, "https://c.example", "x" * 999, "", 0), (201, "https://c.example", "x" * 999, "", 0), (202, None, None, "", 0), (203, "", "", "", 0)]
    rows += [(None, None, BIG, None, None), (300, "u", "y" * 1000, None, 2), (300, "u", "y" * 1000, None, 2), (301, None, "Z" * 3_000_000, None, None)]
    return spark.createDataFrame(rows, PAGES)


@pytest.fixture(scope="module")
def archive(pages):
    return warc.write_archive(pages)


def test_records_come_back_whole(pages, archive):
    got = warc.read_archive(archive, payloads=True).collect()
    want = collections.Counter((r.page_id, sha1((r.html or "").encode()).hexdigest(), len((r.html or "").encode())) for r in pages.collect())
    assert collections.Counter((r.page_id, r.payload_digest, r.payload_bytes) for r in got) == want
    assert len({r.record_id for r in got}) == len(got)
    named = {r.record_id: r for r in got}
    for r in got:
        if r.record_type == "revisit":
            assert r.payload is None and r.payload_bytes >= 1000
            of = named[r.refers_id]
            assert of.record_type == "response" and of.payload_digest == r.payload_digest and of.page_id == r.refers_to
        else:
            assert sha1(bytes(r.payload)).hexdigest() == r.payload_digest and r.refers_to is None
    kinds = {(r.page_id, r.record_type, r.refers_to) for r in got if r.payload_digest == sha1(BIG.encode()).hexdigest()}
    assert kinds == {(i, "revisit", 104) for i in (None, 100, 101, 102, 103)} | {(104, "response", None)}
    assert sorted(r.record_type for r in got if r.page_id == 300) == ["response", "revisit"]
    assert {r.record_type for r in got if r.page_id in (200, 201, 202, 203)} == {"response"}
    assert next(r.url for r in got if r.page_id == 100) == "https://b.example/%200%0A"


def test_frames_open_alone_and_the_whole_file_is_plain_zstandard(archive):
    for row in archive.bundles().collect():
        files, path = fs.FileSystem.from_uri(row.bundle)
        with files.open_input_file(path) as f:
            data = f.read()
        file = io.BytesIO(data)
        table = warc.read_seek_table(file, len(data))
        frames = [warc.read_frame(file, t) for t in table]
        assert b"".join(frames) == zstandard.ZstdDecompressor().stream_reader(io.BytesIO(data), read_across_frames=True).read()
        broken = data[: table[0][0] + 20] + bytes([data[table[0][0] + 20] ^ 1]) + data[table[0][0] + 21 :]
        with pytest.raises((warc.DamagedArchive, zstandard.ZstdError)):
            warc.read_frame(io.BytesIO(broken), table[0])
        with pytest.raises(warc.DamagedArchive):
            warc.read_seek_table(io.BytesIO(data[:-3]), len(data) - 3)


def test_index_finds_single_records(spark, archive):
    index = archive.index.collect()
    some = [r.record_id for r in index if r.page_id in (3, 59, 301, 102)]
    got = warc.fetch(archive, spark.createDataFrame([(n,) for n in [*some, some[0], "<urn:x-page:999:9>"]], "record_id string")).collect()
    assert sorted(r.record_id for r in got) == sorted(some)
    assert next(len(r.payload) for r in got if r.page_id == 301) == 3_000_000
    assert next(bytes(r.payload).decode() for r in got if r.page_id == 3) == "<h1>3</h1>" + "ü" * 21


def test_bundles_are_cut_and_records_over_a_frame_stand_alone(tmp_path, monkeypatch):
    monkeypatch.setattr(warc, "FRAME", 2000)
    monkeypatch.setattr(warc, "BUNDLE", 1500)
    out, rng = warc.BundleWriter(str(tmp_path)), np.random.default_rng(1)
    rows = []
    for i in range(40):
        payload = rng.bytes(300 if i % 9 else 5000)
        rows += out.add((i,), warc.response(warc.record_id(i, i), f"u{i}", payload, sha1(payload).hexdigest()))
    rows += out.close()
    assert [r[0] for r in rows] == list(range(40)) and len({r[1] for r in rows}) > 3
    for _, uri, frame, offset, length in rows:
        with open(uri, "rb") as file:
            size = file.seek(0, 2)
            data = warc.read_frame(file, warc.read_seek_table(file, size)[frame])
        assert warc.read_record(data, offset)[1] == offset + length and len(data) < 8000


def test_empty_archive(spark):
    empty = warc.write_archive(spark.createDataFrame([], PAGES))
    assert warc.read_archive(empty).collect() == [] and empty.index.collect() == []


# ---- ranked search

WORDS = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")


def words(text):
    return WORDS.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def plain_search(docs, items, k=10):
    bags = [(i, row, collections.Counter(words(t))) for row, (i, t) in enumerate(docs)]
    bags = [b for b in bags if b[2]]
    n, every = len(bags), sum(sum(b[2].values()) for b in bags)
    df = collections.Counter(t for b in bags for t in b[2])
    out = []
    for item, text in items:
        found = []
        for i, row, bag in bags:
            m = 10 + (90 * sum(bag.values()) * n) // every
            s = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * ((10**9 * bag[t]) // (1000 * bag[t] + 8 * m)) for t in set(words(text)) if t in bag)
            if s:
                found.append((-s, i is None, i or 0, row))
        out += [(item, at + 1, None if none else i, -s) for at, (s, none, i, _) in enumerate(sorted(found)[:k])]
    return sorted(out, key=str)


def corpus():
    rng = np.random.default_rng(11)
    vocabulary = [f"w{i}" for i in range(120)] + ["Ünder", "naïve", "x1y2", "日本", "A", "a", "_"]
    chance = 1 / np.arange(1, len(vocabulary) + 1)
    say = lambda n: " ".join(rng.choice(vocabulary, n, p=chance / chance.sum()))
    docs = [(i, say(int(rng.integers(1, 60)))) for i in range(400)]
    docs += [(500, None), (501, ""), (502, " .,-"), (None, docs[3][1]), (None, docs[3][1]), (3, docs[3][1]), (503, "w5 " * 4000), (504, say(30000)), (505, "Q" * 3_000_000)]
    docs += [(600 + i, docs[7][1]) for i in range(30)]
    items = [(i, say(int(rng.integers(1, 25)))) for i in range(25)] + [(90, docs[7][1]), (91, None), (92, "--"), (93, "unseen words"), (None, "w1 w2 A"), (5, "naïve NAïVE")]
    return docs, items


@pytest.mark.parametrize("postings, terms", [(1 << 21, 1 << 16), (300, 40)])
def test_search_equals_plain_scoring(spark, monkeypatch, postings, terms):
    """With one block and with many blocks of documents and queries; k-th scores tie in copies."""
    monkeypatch.setattr(rank, "QUERY_TERMS", terms)
    run = rank._score
    monkeypatch.setattr(rank, "_score", lambda *a: run(*a, postings))
    docs, items = corpus()
    table = spark.createDataFrame([(*d, 1, 2, "t") for d in docs], "doc_id long, text string, n long, row int, term string").repartition(3)
    asked = spark.createDataFrame([(*d, 1, "x") for d in items], "item_id long, text string, query int, score string")
    got = rank.search(table, asked).select("item_id", "rank", "doc_id", "score").collect()
    assert sorted([tuple(r) for r in got], key=str) == plain_search(docs, items)


def test_search_makes_few_accumulators_and_loses_none():
    """A rare term decides; documents of common terms alone get no accumulator once it has filled the first ranks."""
    rng = np.random.default_rng(2)
    n = 5000
    owners = [np.sort(rng.choice(n, size, replace=False)) for size in (40, 300, 3000)]
    terms = np.repeat([1, 2, 3], [len(o) for o in owners])
    weight = [9000, 300, 20]
    rows = [{"query": 0, "term": t, "df": len(o), "w": w, "bound": w * 1000} for t, o, w in zip((1, 2, 3), owners, weight, strict=True)]
    best = rank.Best(10)
    docs = (np.arange(n), np.zeros(n, bool), np.arange(n))
    impact = rng.integers(500, 1000, len(terms))
    made = rank.score_block(rank.Queries(rows), best, terms, np.concatenate(owners), impact, docs)
    score = np.zeros(n, np.int64)
    for t, o, w in zip((1, 2, 3), owners, weight, strict=True):
        score[o] += w * impact[terms == t]
    assert best.held[0][0].tolist() == np.sort(score)[::-1][:10].tolist() and made <= 340


def test_search_of_empty_tables(spark):
    docs, items = spark.createDataFrame([], "doc_id long, text string"), spark.createDataFrame([], "item_id long, text string")
    some = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    asked = spark.createDataFrame([(1, "a b")], "item_id long, text string")
    for d, q in ((docs, items), (some, items), (docs, asked)):
        assert rank.search(d, q).collect() == []
    assert [tuple(r)[1:] for r in rank.search(some, asked).collect()] == plain_search([(1, "a b")], [(1, "a b")])


def test_terms_are_hashed_whole_across_blocks(monkeypatch):
    monkeypatch.setattr(rank, "BLOCK", 16)
    for text in ("one Two three four five six seven eight", "x" * 100 + " y", "é" * 30, "", "  ", "ab" * 40):
        every = [rank.term_hashes(t.encode())[0] for t in words(text)]
        assert rank.term_hashes(text.encode()).tolist() == every


# ---- whitening

def plain_whitening(vectors, k=4):
    xs = {i: [math.floor(256 * float(np.float32(c))) for c in v] for i, v in vectors.items()}
    fit = [list(x) for x in {tuple(x) for x in xs.values()}]
    n, sums = len(fit), [sum(c) for c in zip(*fit, strict=True)]
    apart = np.array([[n * c - s for c, s in zip(x, sums, strict=True)] for x in fit], float) / n
    values, basis = np.linalg.eigh(apart.T @ apart / n)
    values, basis = values[::-1], basis[:, ::-1]
    out = {}
    for i, x in xs.items():
        deviation = sum((n * c - s) ** 2 for c, s in zip(x, sums, strict=True))
        y = (np.array([n * c - s for c, s in zip(x, sums, strict=True)], float) / n) @ basis[:, :k] / np.sqrt(values[:k])
        out[i] = (n, deviation, y, values[:k] / values.sum())
    return out


def test_whitening_equals_dense_eigenvectors(spark):
    rng = np.random.default_rng(5)
    base = rng.normal(size=(300, 3)) @ rng.normal(size=(3, 12)) * [3] + rng.normal(size=(300, 12)) * np.linspace(0.05, 1, 12)
    vectors = {i: v.tolist() for i, v in enumerate(base)}
    vectors |= {400 + i: vectors[0] for i in range(50)} | {500: [-0.0] * 12, 501: [1e-9] * 12}
    bad = [(600, None), (601, [None] + [0.5] * 11), (602, [float("nan")] * 12), (603, [float("inf")] + [0.0] * 11), (604, [])]
    rows = [(*r, 1, "x") for r in [*vectors.items(), *bad]]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>, n int, component string").repartition(5)
    got = whiten.whiten(table).collect()
    want = plain_whitening(vectors)
    assert collections.Counter(r.vec_id for r in got) == collections.Counter({i: 4 for i in vectors})
    sign = {}
    for r in sorted(got, key=lambda r: -abs(r.whitened)):
        n, deviation, y, explained = want[r.vec_id]
        sign.setdefault(r.component, np.sign(r.whitened * y[r.component - 1]))
        assert (r.n, r.deviation) == (n, deviation) and r.identity_error < 1e-9
        assert r.whitened == pytest.approx(sign[r.component] * y[r.component - 1], abs=1e-9) and r.explained == pytest.approx(explained[r.component - 1], rel=1e-10)


def test_rank_one_updates_follow_the_covariance():
    """Full rank, low rank, equal eigenvalues, vanishing entries, and two spectra joined."""
    rng = np.random.default_rng(0)
    cases = [np.floor(rng.normal(size=(200, 9)) * 40), np.floor(rng.normal(size=(200, 2)) @ rng.normal(size=(2, 9)) * 40), np.repeat(np.eye(9) * 256, 3, axis=0),
             np.hstack([np.arange(30.0)[:, None], np.zeros((30, 8))]), np.zeros((4, 9)), rng.normal(size=(50, 1))]
    for x in cases:
        one, other, both = (whiten.Spectrum.empty(x.shape[1]) for _ in range(3))
        for i, row in enumerate(x):
            both.add(row)
            (one if i % 3 else other).add(row)
        one.join(other)
        want = np.cov(x.T, bias=True).reshape(x.shape[1], -1)
        for s in (both, one):
            assert np.abs(s.basis @ np.diag(s.scatter / s.n) @ s.basis.T - want).max() <= 1e-11 * max(1, np.abs(want).max())
            assert np.abs(s.basis.T @ s.basis - np.eye(x.shape[1])).max() < 1e-12


def test_whitening_without_variance_or_rows(spark):
    schema = "vec_id long, embedding array<float>"
    assert whiten.whiten(spark.createDataFrame([], schema)).collect() == []
    same = whiten.whiten(spark.createDataFrame([(1, [0.5, 0.25]), (None, [0.5, 0.25])], schema)).collect()
    assert [(r.component, r.n, r.deviation, r.whitened, r.explained) for r in same] == [(1, 1, 0, None, 0.0), (2, 1, 0, None, 0.0)] * 2
    line = whiten.whiten(spark.createDataFrame([(1, [0.0, 1.0]), (2, [1.0, 1.0])], schema)).orderBy("vec_id", "component").collect()
    assert [abs(r.whitened) if r.component == 1 else r.whitened for r in line] == [pytest.approx(1.0), None] * 2
    with pytest.raises(ValueError, match="entries"):
        whiten.whiten(spark.createDataFrame([(1, [0.0, 1.0]), (2, [1.0])], schema))
