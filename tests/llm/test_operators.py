"""Every operator against a plain version on small tables that hold nulls, empty, long and repeated texts and extra columns."""

import collections
import hashlib
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tidemark.llm import decontaminate, embed, extract, lines, minhash, mix, quality, secrets, tokens, urls
from tidemark.llm.common import shingle_hashes, word_hashes

DOCS = "doc_id long, text string, lang string, source string, n_chars long, size long, mark string, block int, id string"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def prose(seed, n):
    rng = np.random.default_rng(seed)
    return " ".join("".join(rng.choice(list("aeinorstl"), rng.integers(2, 8))) for _ in range(n))


@pytest.fixture(scope="module")
def texts():
    base = prose(1, 200)
    words = base.split()
    near = " ".join(words[:100] + ["changed"] + words[101:])
    far = " ".join(words[:100] + prose(2, 100).split())
    return {
        0: base, 1: near, 2: base, 3: far, 4: None, 5: "", 6: " \t\n", 7: "one two", 8: "ONE two", 9: prose(3, 60) + "\n" + prose(4, 30),
        10: prose(5, 30) + "\n" + prose(4, 30) + " x", 11: "É " + prose(6, 40), 12: prose(7, 60_000), 13: "short\n\nshort\nother",
    }


@pytest.fixture(scope="module")
def docs(spark, texts):
    rows = [(i, t, "en", None if i % 5 == 4 else f"s{i % 3}", None, 1, "m", 2, "x") for i, t in texts.items()]
    rows += [rows[3], (None, texts[0], None, None, None, None, None, None, None)]
    return spark.createDataFrame(rows, DOCS).repartition(3).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


def shingles(text):
    words = WORD.findall((text or "").translate(LOWER))
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def test_word_hashes_follow_words_and_not_blocks():
    long = ("ab cd " * 400_000).encode()
    hashes, counts = word_hashes([b"ab cd", b"", long, b"AB\x0bcd "])
    assert counts.tolist() == [2, 0, 800_000, 2]
    assert (hashes[2:800_002].reshape(-1, 2) == hashes[:2]).all() and (hashes[-2:] == hashes[:2]).all()
    big = b"x" * 3_000_000
    assert word_hashes([big])[1].tolist() == [1]
    _, n = shingle_hashes(hashes, counts)
    assert n.tolist() == [1, 0, 799_996, 1]


def test_minhash_components_equal_brute_force(docs, texts, empty):
    got = {(r.doc_id, r.component_id): r for r in minhash.near_duplicates(docs).collect()}
    sets = {i: shingles(t) for i, t in texts.items()}
    comp = {i: i for i in sets}
    for _ in sets:
        for a in sets:
            for b in sets:
                both = len(sets[a] & sets[b])
                if both and 100 * both >= 85 * len(sets[a] | sets[b]):
                    comp[a] = comp[b] = min(comp[a], comp[b])
    for i in sets:
        row = got[i, comp[i]]
        assert row.n_shingles == len(sets[i]) and row.kept == (comp[i] == i)
    assert got[None, 0].kept is False
    assert comp[1] == comp[2] == 0 and comp[8] == 7 and comp[3] == 3
    assert minhash.near_duplicates(empty).collect() == []


def test_minhash_finds_chains_and_large_groups(spark):
    """A group above one piece whose members differ, and a chain whose ends are unlike, are one component each."""
    rng = np.random.default_rng(5)
    base = prose(11, 300).split()
    rows = []
    for i in range(400):
        words = list(base)
        words[rng.integers(300)] = f"w{i}"
        rows.append((i, " ".join(words)))
    chain = prose(12, 200).split()
    for k in range(8):
        rows.append((1000 + k, " ".join(chain)))
        for j in range(20 * k, 20 * k + 2):
            chain[j] = f"new{k}x{j}"
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in minhash.near_duplicates(frame).collect()}
    assert {got[i] for i in range(400)} == {0}
    assert {got[1000 + k] for k in range(8)} == {1000}


def test_odd_sketches_estimate_high_similarity():
    rng = np.random.default_rng(0)
    a = rng.integers(0, 1 << 63, 1000, dtype=np.uint64)
    b = a.copy()
    b[:50] = rng.integers(0, 1 << 63, 50, dtype=np.uint64)
    sketch = minhash.odd_sketches(minhash.minima([np.unique(a), np.unique(b)], minhash.FOLDED))
    assert abs(minhash.likeness(sketch[:1], sketch[1:])[0, 0] - 950 / 1050) < 0.04


def test_quality_learns_and_defines_blank_texts(spark, docs, empty):
    rows = []
    for i in range(400):
        good = i % 2
        text = prose(i, 40)
        rows.append((i, text if good else " ".join(w.upper() + "!!" for w in text.split()), good))
    frame = spark.createDataFrame(rows, "doc_id long, text string, quality int")
    weights = quality.fit(frame.select("doc_id", "text"), frame.select("doc_id", "quality"))
    got = quality.score(frame.drop("quality"), weights).join(frame.select("doc_id", "quality"), "doc_id").where("held_out").collect()
    assert len(got) > 50 and sum(r.predicted == r.quality for r in got) >= 0.97 * len(got)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in got)
    mixed = {r.doc_id: r for r in quality.score(docs, weights).collect()}
    assert mixed[4].score == mixed[5].score == mixed[6].score and mixed[None].held_out is False
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in mixed.values())
    nothing = quality.fit(empty, spark.createDataFrame([(1, None, 0)], "doc_id long, quality int, toxic int"))
    assert quality.scores([b"x"], nothing).tolist() == [0.5]
    assert quality.keep_good(empty, weights).schema == empty.schema and quality.keep_good(empty, weights).count() == 0


def test_quality_scores_are_sparse_dot_products():
    rng = np.random.default_rng(1)
    weights = rng.normal(size=(1 << quality.BITS) + 1).astype(np.float32)
    texts = [b"Some words, 12 of THEM", b"x", ("long " * 500_000).encode()]
    for text, score in zip(texts, quality.scores(texts, weights), strict=True):
        numbers, counts = quality.features([text])
        logit = float(weights[-1]) + quality.SCALE * float(weights[numbers].astype(float).mean())
        assert counts[0] == len(numbers) and abs(score - 1 / (1 + np.exp(-logit))) < 1e-9


def greedy_tiles(a, b, least=5):
    free_a, free_b, covered = [True] * len(a), [True] * len(b), 0
    while True:
        best = (least - 1, 0, 0)
        for i in range(len(a)):
            for j in range(len(b)):
                k = 0
                while i + k < len(a) and j + k < len(b) and a[i + k] == b[j + k] and free_a[i + k] and free_b[j + k]:
                    k += 1
                if k > best[0]:
                    best = (k, i, j)
        k, i, j = best
        if k < least:
            return covered
        free_a[i : i + k] = [False] * k
        free_b[j : j + k] = [False] * k
        covered += k


def test_tiles_equal_plain_greedy_tiling():
    rng = np.random.default_rng(3)
    for _ in range(40):
        a = rng.integers(0, 4, rng.integers(5, 40)).astype(np.uint64) + 7
        b = rng.integers(0, 4, rng.integers(5, 60)).astype(np.uint64) + 7
        assert abs(decontaminate.tile(a, b) - greedy_tiles(a.tolist(), b.tolist())) <= 0


def test_decontamination_catches_reordered_passages(spark, docs, empty):
    item = prose(20, 40)
    w = item.split()
    swapped = " ".join([prose(21, 30), *w[20:], prose(22, 5), *w[:20]])
    rows = [(100, prose(23, 50) + " " + item + "!"), (101, swapped), (102, prose(24, 80)), (103, " ".join(w[:12])), (104, None), (105, item.upper())]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    bench = spark.createDataFrame([(1, item), (2, item), (3, None), (4, "a b"), (5, prose(30, 20))], "item_id long, text string")
    got = {r.doc_id: r for r in decontaminate.contaminated(frame, bench).collect()}
    assert [i for i, r in got.items() if r.contaminated] == [i for i in got if i in (100, 101, 105)]
    assert got[100].item_id == 1 and got[100].coverage == pytest.approx(39 / 40) and got[101].coverage == 1.0
    assert got[103].coverage == pytest.approx(12 / 40) and got[104].coverage == 0.0
    assert decontaminate.contaminated(docs, bench.limit(0)).where("contaminated").count() == 0
    assert decontaminate.contaminated(docs, bench).count() == docs.count()
    assert decontaminate.contaminated(empty, bench).collect() == []


def test_mix_targets_quotas_and_rows(docs, empty, spark):
    rows = mix.mix_shares(docs).collect()
    assert len(rows) == docs.count()
    total = sum(r["size"] for r in rows)
    sources = {r.source_size: r.target for r in rows}
    assert sum(sources.values()) == pytest.approx(total)
    assert all(r.target <= 3 * r.source_size + 1e-9 and r.taken <= 3 * r["size"] and len(r.shards) == r.copies for r in rows)
    assert sorted(map(str, mix.mix_shares(docs).collect())) == sorted(map(str, rows))
    assert mix.mixed(docs).columns == docs.columns
    copies = collections.Counter(r.doc_id for r in mix.mixed(docs).collect())
    assert all(copies[r.doc_id] % r.copies == 0 for r in rows if r.copies)
    assert mix.mix_shares(empty).collect() == [] and mix.mixed(empty).collect() == []


def test_mix_meets_targets_with_many_documents(spark):
    rng = np.random.default_rng(4)
    rows = [(i, "w " * int(rng.integers(1, 400)), f"s{0 if i % 3 == 0 else i % 7}") for i in range(6000)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = mix.mix_shares(frame).join(frame.select("doc_id", "source"), "doc_id").groupBy("source").agg(
        F.sum("taken").alias("taken"), F.first("target").alias("target")).collect()
    assert all(abs(r.taken - r.target) <= 0.002 * r.target + 5 for r in got)


def test_shard_quotas_keep_both_margins(spark):
    quotas = spark.createDataFrame([(0, 700), (1, 200), (2, 1), (3, 99)], "source_no long, quota long")
    got = mix.shard_quotas(quotas, 1000, 150, seed=1).collect()
    by_source, by_shard = collections.Counter(), collections.Counter()
    for r in got:
        by_source[r.source_no] += r.quota
        by_shard[r.shard] += r.quota
    assert by_source == {0: 700, 1: 200, 2: 1, 3: 99} and set(by_shard.values()) == {6, 7} and len(by_shard) == 150


def test_token_files_round_trip(docs, texts, empty):
    import public_tokenizers
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    files = tokens.write_ids(docs)
    rows = sorted(tokens.read_documents(files).collect(), key=lambda r: r.start)
    assert len(rows) == docs.count() and rows[0].doc_id is None
    start = 0
    for r in rows:
        ids = np.array(whole.encode(texts[r.doc_id or 0] or "", add_special_tokens=False).ids + [2], "<u4")
        assert (r.start, r.n_tokens, r.ids_crc32) == (start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)
    assert files.agg(F.max("n_ids")).first()[0] <= tokens.CHUNK
    assert files.where("goes_on").count() > 0  # a text over several chunks is among them
    assert tokens.read_documents(tokens.write_ids(empty)).collect() == []


def test_planes_give_back_all_ids():
    rng = np.random.default_rng(2)
    for n in (1, 2, 1000):
        ids = rng.integers(0, 1 << 32, n, dtype=np.uint64).astype(np.uint32)
        assert (tokens.from_planes(tokens.to_planes(ids), n) == ids).all()


def test_tokens_forget_words_without_harm(monkeypatch):
    monkeypatch.setattr(tokens, "MEMORY", 3)
    texts = [b"a few words and more", b"words again", b"a" * 100 + b" again"]
    first = [x.tolist() for x in tokens.encode(texts, "word_bpe_49k.json")]
    assert first == [x.tolist() for x in tokens.encode(texts, "word_bpe_49k.json")]


class _Counting:
    """A tokenizer that counts the texts it is given."""

    def __init__(self, tokenizer):
        self.tokenizer, self.model, self.texts = tokenizer, tokenizer.model, 0

    def get_vocab(self):
        return self.tokenizer.get_vocab()

    def encode_batch_fast(self, texts, **more):
        self.texts += len(texts)
        return self.tokenizer.encode_batch_fast(texts, **more)


def _direct(tokenizer, texts: list[bytes]) -> list[list[int]]:
    return [tokenizer.encode(t.decode(), add_special_tokens=False).ids for t in texts]


def test_new_runs_go_to_the_tokenizer_together(monkeypatch):
    plain = tokens._tokenizer("word_bpe_49k.json")[0]
    counting = _Counting(plain)
    monkeypatch.setattr(tokens, "_tokenizer", lambda name: (counting, {}, {}, tokens.RunMemory(counting)))
    texts = ["".join(" w" + "abcdefghij"[i % 10] * (i % 7) + "xyzéÖß"[i % 6] + f"q{i}!" for i in range(k, k + 400)).encode() for k in (0, 200)]
    texts += [b"", b"  ", "Ünder 2024, a-b \u00ff".encode()]
    assert [x.tolist() for x in tokens.encode(texts, "any")] == _direct(plain, texts)
    assert counting.texts < 50  # some 500 runs are new


def test_run_memory_overflows_and_collides_without_harm(monkeypatch):
    monkeypatch.setattr(tokens, "RUNS", 4)
    monkeypatch.setattr(tokens, "RUN_SLOTS", 8)
    plain = tokens._tokenizer("word_bpe_49k.json")[0]
    memory = tokens.RunMemory(plain)
    texts = [b"one two three four", b"two five " + b"a" * 100 + b" 1234 one", b"six seven", b"one " + b"a" * 100, b"a b c d e f g h i j", b"seven j six 12"]
    for some in ([t] for t in texts * 2):
        assert [x.tolist() for x in tokens._encode_plain(some, memory)] == _direct(plain, some)
    assert memory.n_runs <= 4
    memory.last = None  # a tokenizer that does not mark the end of words
    assert [x.tolist() for x in tokens._encode_plain(texts, memory)] == _direct(plain, texts)


def test_secret_rules_and_learned_spans(spark, empty):
    value = "Zk3vQ9xT1mB7cR5wL2pN8sD4"
    rows = [
        (1, f'é API_KEY = "{value}" and password: short token = token: abcdefghijklmnop'), (2, "AKIA" + "Q" * 14 + " AKIAQQ " + "0a" * 9), (3, None), (4, ""),
        (5, f"the bearer is {value} here"), (6, "plain words only, nothing-to-see"), (6, "plain words only, nothing-to-see")]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    network = secrets.fit(frame.where("doc_id != 5"))
    got = {r.doc_id: r for r in secrets.scan(frame, network).collect()}
    text = rows[0][1]
    at = text.index("API_KEY")
    spans = f"assign:{at}:{text.index(value) + len(value)}"
    assert got[1].base_sha256 == hashlib.sha256(spans.encode()).hexdigest() and got[1].n_assign == 1
    assert got[2].spans == "access:0:18,hex:26:44" and got[2].n_access == got[2].n_hex == 1
    assert got[3].spans == got[4].spans == got[6].spans == "" and got[3].base_sha256 == hashlib.sha256(b"").hexdigest()
    assert got[5].n_learned == 1 and got[5].spans == f"learned:14:{14 + len(value)}"
    assert secrets.scan(empty, network).collect() == []


def plain_base(text):
    """Base spans of the contract, without shortcuts."""
    found = []
    for m in re.finditer(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text, re.I | re.A):
        if len(m.group(2)) >= 12:
            found.append((m.start(), 0, f"assign:{m.start()}:{m.end()}"))
    for kind, name, pattern, least in ((1, "access", "AKIA[A-Z0-9]+", 18), (2, "hex", "[0-9a-f]+", 16)):
        found += [(m.start(), kind, f"{name}:{m.start()}:{m.end()}") for m in re.finditer(pattern, text) if m.end() - m.start() >= least]
    return [x for _, _, x in sorted(found)]


def test_secret_base_spans_equal_a_plain_version_and_planted_unknown_forms_are_found(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    texts = {r.doc_id: r.text or "" for r in docs.collect()}
    rng = np.random.default_rng(41)
    full = list("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789")

    def some(n, extra=""):
        return "".join(rng.choice(full + list(extra), n))

    forms = [lambda: "ghp_" + some(36), lambda: "sk-" + some(40), lambda: "eyJ" + some(30, "-_") + "." + some(40, "-_") + "." + some(43, "-_"),
             lambda: "xoxb-" + "".join(rng.choice(list("0123456789"), 12)) + "-" + some(24), lambda: "".join(rng.choice(full[26:], 24))]
    planted = {}
    for i, text in enumerate(list(texts.values())[:150]):
        cut = max(text.find(" ", 20), 0)
        value = forms[i % len(forms)]()
        planted[10_000 + i] = (f"{text[:cut]} {value} {text[cut:]}", cut + 1)
    network = secrets.fit(docs)
    rows = spark.createDataFrame([(k, v[0]) for k, v in planted.items()], "doc_id long, text string")
    got = {r.doc_id: r for r in secrets.scan(docs.unionByName(rows), network).collect()}
    for doc_id, text in {**texts, **{k: v[0] for k, v in planted.items()}}.items():
        spans = [x for x in got[doc_id].spans.split(",") if x and not x.startswith("learned")]
        assert spans == plain_base(text)
        assert got[doc_id].base_sha256 == hashlib.sha256(",".join(spans).encode()).hexdigest()
    found = sum(any(x.split(":")[1] == str(at) for x in got[k].spans.split(",") if x) for k, (_, at) in planted.items())
    assert found >= 0.9 * len(planted)
    free = sum(len(secrets._free(secrets.base_spans(t), secrets.candidates(t))) for t in texts.values())
    assert sum(got[k].n_learned for k in texts) <= 0.01 * free


def test_harmless_runs_and_masked_rule_matches():
    for run in ("internationalisation", "www.some-host.org/a1", "GENERALLICENSE", "2024-01-12T10", "192.168.100.200", "------------", "+49-170-1234567"):
        assert secrets.harmless(run)
    for run in ("Zk3vQ9xT1mB7cR5wL2pN8sD4", "aTTTTTTTTTTTTTTTTTTTTTTTTTTTTTTTTTTTTTTTTTTTTTTTTTT0x", "a-" * 5000 + "0x9", "123456789012345678901234"):
        assert not secrets.harmless(run)
    text = 'my api_key = "abcDEF123456xyz" end'
    (kind, a, b), = secrets.base_spans(text)
    assert secrets.masked(text, kind, a, b) == ('my abcDEF123456xyz" end', 3, 18)
    assert secrets.masked("AKIA" + "Q7" * 8, "access", 0, 20) == ("Q7" * 8, 0, 16)


def test_network_keeps_recall_on_findings_it_has_not_seen():
    x, y = secrets.generated()
    out = np.arange(len(y)) % 5 == 4
    network = secrets.Network()
    network.train(x[~out], y[~out].astype(np.float32))
    network.calibrate(x[out], y[out])
    fresh, label = secrets.generated(1000, seed=77)
    p = network.probability(fresh)
    assert (p[label == 1] >= network.threshold).mean() >= 0.96
    assert (p[label == 0] >= network.threshold).mean() <= 0.1
    assert abs(p.mean() - label.mean()) < 0.1


def test_network_gradient_is_the_slope_of_its_loss():
    x, y = secrets.generated(64, seed=3)
    network = secrets.Network()
    before = np.logaddexp(0, np.where(y == 1, -1, 1) * network.logits(x)).mean()
    network.train(x, y.astype(np.float32), epochs=80, batch=64, rate=1e-3)
    assert np.logaddexp(0, np.where(y == 1, -1, 1) * network.logits(x)).mean() < 0.7 * before


def test_url_rules_and_learned_verdicts(spark):
    rows = [
        (1, "http://a.example.com/en/1"), (2, "https://WWW.example.com/en/x?q"), (3, "http://shop.net/fr/"), (4, "http://x.com"), (5, None), (6, "no url"),
        (7, "http://casinobets.org/play"), (8, "http://gardenclub.org/en/7#t"), (9, "http://notnet/es/"), (10, "http://www.example.com/fr/1"), (10, "http://www.example.com/fr/1"),
    ] + [(100 + i, f"http://gardennews{i}.org/en/flower/{i}") for i in range(30)] + [(200 + i, f"http://casino-pills{i}.org/win") for i in range(10)]
    frame = spark.createDataFrame(rows, "page_id long, url string").withColumn("host", F.lit(1)).withColumn("rule", F.lit("z"))
    got = {r.page_id: r for r in urls.judge(frame).collect()}
    assert [got[i].rule for i in range(1, 11)] == ["example.com/en/", "www.example.com/en/", "net/fr/", None, None, None, None, None, None, "com/"]
    assert [got[i].verdict for i in (1, 2, 3, 10)] == ["block", "allow", "block", "allow"]
    assert got[5].host == got[6].host == got[5].path == "" and got[2].host == "www.example.com" and got[4].path == ""
    assert got[7].verdict == "block" and got[8].verdict == "allow"
    assert urls.judge(frame.limit(0)).collect() == []


def test_segmentation_is_the_best_of_all_cuts():
    known = urls.unigrams(urls.VOCABULARY)

    def best(name):
        if not name:
            return 0.0
        cuts = [best(name[k:]) + (known[name[:k]] if name[:k] in known else urls.UNKNOWN if k == 1 else -np.inf) for k in range(1, len(name) + 1)]
        return max(cuts)

    for name in ("freebets", "cheappills", "xqzcasino", "gardennews"):
        words = urls.segment(name)
        rest = name
        for w in words:  # a mark stands for letters outside any word
            if w != "?":
                rest = rest.replace(w, "", 1)
        assert sum(known[w] for w in words if w != "?") + urls.UNKNOWN * len(rest) == pytest.approx(best(name))
    assert urls.segment("cheappills") == ("cheap", "pills")


def test_line_dedup_equals_brute_force(docs, texts, empty):
    got = {r.doc_id: r for r in lines.dedup_lines(docs).collect()}
    places = collections.defaultdict(list)
    for i, t in [*texts.items(), (10**9, texts[0])]:
        for no, line in enumerate((t or "").split("\n")):
            if line.strip(" \t\r\x0b\x0c"):
                places[line.strip(" \t\r\x0b\x0c")].append((i, no))
    names = list(places)
    group = {n: n for n in names}
    sets = {n: set(lines.shingles([n.encode()])[0].tolist()) for n in names}
    for _ in range(3):
        for a in names:
            for b in names:
                if 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b]):
                    group[a] = group[b] = min(group[a], group[b])
    found = collections.defaultdict(list)
    for n in names:
        found[group[n]] += places[n]
    dropped = collections.defaultdict(list)
    for some in found.values():
        for i, no in sorted(set(some))[1:]:
            dropped[None if i == 10**9 else i].append(no)
    for i in [*texts, None]:
        assert sorted(got[i].dropped) == sorted(dropped[i]) and got[i].n_dropped == len(dropped[i])
    assert got[10].first_docs == [9] and got[13].dropped == [2] and got[4].n_lines == 1
    assert lines.dedup_lines(empty).collect() == []


def test_line_signatures_agree_like_sets():
    a = " ".join(prose(40, 30).split())
    b = a[:150] + "zz" + a[150:]
    hashes, counts = lines.shingles([a.encode(), b.encode(), b"tiny", b"a", prose(41, 40).encode()])
    assert lines.signatures(hashes, counts, lines.BINS).shape == (5, lines.BINS)
    mark = lines.marks(hashes, counts)
    assert mark[2] == mark[3] == 0 and np.bitwise_count(mark[0] ^ mark[1]) <= lines.APART < np.bitwise_count(mark[0] ^ mark[4])


def test_line_marks_are_counted_without_sign():
    """Marks that differ in the first bit and one other are near; those that differ in 20 bits are not."""
    bucket, ids = np.array([5, 5, 6, 6]), np.array([1, 2, 3, 4])
    far = int("1" * 20 + "0" * 43 + "1", 2) - (1 << 64)
    found = lines._met(bucket, ids, np.array([1, -(2**63), 1, far], np.int64))
    assert sorted(found.tolist()) == [1, 2]


def test_line_links_in_pairs_and_in_matrices_agree():
    rows = lines.sketches([prose(k % 7, 12 + k % 3).encode() for k in range(40)])
    whole = lines.likeness(rows, rows)
    for step in range(1, 40):
        assert (lines.alike(rows[:-step], rows[step:]) == np.diagonal(whole, step)).all()


def test_line_candidates_do_not_depend_on_batches_or_tasks():
    rng = np.random.default_rng(3)
    rows = sorted({(int(b), int(i)) for b, i in zip(rng.integers(0, 600, 900), rng.integers(0, 10**6, 900), strict=True)} | {(700, i) for i in range(700)})
    n = collections.Counter(b for b, _ in rows)
    wanted = {i for b, i in rows if n[b] > 1}
    for size, tasks in ((1, 1), (7, 3), (300, 2), (10**4, 4)):
        got, edge = set(), set()
        for part in np.array_split(np.array([*rows, rows[-1]]), tasks):
            cut = [pa.RecordBatch.from_arrays([pa.array(x[:, 0]), pa.array(x[:, 1]), pa.array(np.zeros(len(x), np.int64))], ["bucket", "id", "mark"])
                   for x in (part[k : k + size] for k in range(0, len(part), size))]
            got |= {i for out in lines._candidates(iter(cut)) for i in out.column("id").to_pylist()}
            edge |= {i for b, i in rows if b in (part[0][0], part[-1][0])}
        assert wanted <= got <= wanted | edge


def test_line_sketches_lose_no_link():
    rng = np.random.default_rng(11)
    texts = []
    for n in (6, 9, 14, 30, 60, 150, 900, 4000):
        base = "".join(rng.choice(list("abcdefgh "), n))
        texts += [base, base[:-1], base[: n // 2] + "x" + base[n // 2 :], base + base, "".join(rng.choice(list("abcdefgh "), n)), "a" * n]
    raw = [t.encode() for t in texts]
    rows = lines.sketches(raw)
    near = lines.likeness(rows, rows)
    sets = [set(lines.as_set(t).tolist()) for t in raw]
    strangers = 0
    for i, a in enumerate(sets):
        for j, b in enumerate(sets):
            if 5 * len(a & b) >= 4 * len(a | b):
                assert near[i, j] == 1
            elif min(len(a), len(b)) > 10 and 5 * len(a & b) < len(a | b):
                strangers += near[i, j]
    assert strangers == 0


def test_embedding_links_equal_brute_force(spark, monkeypatch):
    monkeypatch.setattr(embed, "LEAF", 32)
    rng = np.random.default_rng(8)
    base = rng.normal(size=(200, 16))
    rows = [[float(v) for v in base[i]] for i in range(200)]
    rows += [[float(v) for v in base[i] + 0.06 * rng.normal(size=16)] for i in range(100)]
    rows += [rows[0], rows[0], [2 * v for v in rows[1]]]
    odd = [None, [], [0.0] * 16, [float("nan")] * 16, [None] * 16, [float("inf")] + [1.0] * 15, [1.0, 2.0], [1e300] * 16]
    frame = spark.createDataFrame([(i, v, 0) for i, v in enumerate(rows + odd)], "vec_id long, embedding array<double>, leaf int").repartition(3)
    got = {r.vec_id: r for r in embed.near_vectors(frame).collect()}
    x = np.array(rows)
    x /= np.sqrt((x * x).sum(axis=1))[:, None]
    near = x @ x.T >= 0.95
    found = sum(got[i].n_links for i in range(len(rows)))
    assert all(got[i].n_links <= near[i].sum() - 1 for i in range(len(rows)))
    assert found >= 0.9 * (near.sum() - len(rows))
    assert got[300].n_links >= 2 and got[300].component_id == 0 and got[0].kept and not got[300].kept
    for i in range(len(rows), len(rows) + len(odd) - 1):
        assert got[i].n_links == 0 and got[i].kept
    assert embed.near_vectors(frame.limit(0)).collect() == []


PAGE = """<!DOCTYPE html><html><head><title>t</title><script>var a="</p>";</script></head><body><header><a href=x>Home</a></header>
<nav><ul><li><a href=a>one</a><li><a href=b>two</a></ul></nav><div class="cookie-notice">We use cookies</div>
<div id=wrap><article><h1>Head &amp; title</h1><p><b>First&nbsp;paragraph with  some
words.<br>More<p>Second paragraph &#8212; long enough to be text of an article.</p><div class="ad">Buy</div>
<ul><li>point one<li>point two</ul></article><div class="comments"><p>A reader says something here</p></div></div>
<form><input><p>Subscribe</p></form><aside>side</aside><footer>&copy; me</footer></body>"""


def test_main_text_keeps_the_article_alone(spark):
    want = "Head & title\n\nFirst paragraph with some words. More\n\nSecond paragraph — long enough to be text of an article.\n\npoint one\n\npoint two"
    pages = [(1, "u", PAGE), (2, "u", None), (3, None, ""), (4, "u", "plain text"), (5, "u", "<p>cut <b>off"), (1, "u", PAGE), (6, "u", "<nav>only</nav>")]
    pages.append((7, "u", PAGE.replace("article>", "div>").replace("<article", "<div")))
    pages.append((8, "u", "<body>" + "<div>" * 3000 + "deep words" + "</div>" * 3000))
    frame = spark.createDataFrame(pages, "page_id long, url string, html string").withColumn("text", F.lit("x"))
    got = [r for r in extract.extract(frame).collect()]
    by = {r.page_id: r for r in got}
    assert by[1].text == want and sum(r.page_id == 1 for r in got) == 2 and by[1].n_chars == len(want)
    assert by[2].text == by[3].text == by[6].text == "" and by[4].text == "plain text" and by[5].text == "cut off" and by[8].text == "deep words"
    assert by[7].text == want
    assert extract.extract(frame.limit(0)).collect() == []


def test_items_without_an_id_are_found(spark):
    words = prose(51, 40)
    docs = spark.createDataFrame([(1, prose(52, 30) + " " + words), (2, prose(53, 60))], "doc_id long, text string")
    items = spark.createDataFrame([(None, words), (7, prose(54, 40))], "item_id long, text string")
    got = {r.doc_id: (r.coverage, r.item_id, r.contaminated) for r in decontaminate.contaminated(docs, items).collect()}
    assert got == {1: (1.0, None, True), 2: (0.0, None, False)}


def test_main_text_keeps_wrappers_of_the_article():
    text, note = prose(61, 120), prose(62, 12)
    part = f"<p>{text}</p>"
    pages = [
        f"<body><div class='has-sidebar'>{part}<div class='sidebar'>{note}</div></div></body>",
        f"<body><form id='aspnetForm'><div id='content-with-nav'>{part}</div><select><option>x</option></select></form></body>",
        f"<body><div class='social-history'><article>{part}</article></div><p>{note}</p></body>",
        f"<body><main><div class='no-sidebar'><article>{part}</article></div></main><form>{note}</form></body>",
        f"<body><article>{part}<div class='comments'><article><p>{text} {note}</p></article></div></article></body>",
        f"<body><div>{part}</div><div class='comments'><p>{prose(63, 300)}</p></div></body>",
    ]
    assert [extract.main_text(p) for p in pages] == [text] * len(pages)
