"""Secret scan: rule matches, and a character convolutional network over every other candidate in its context.

A candidate is every run of 12 or more characters of the credential alphabet. The network sees the text before it, its
beginning and end, and the text behind it. It is trained on labelled findings: a generated set and a bounded sample of the
corpus. There, rule matches are the positives, with what the rules look for taken out (keyword, operator, prefix), so that
shape and context must carry the label; negatives are only candidates of harmless kinds (words, capitals, numbers, dates,
hosts, rulers). Any other candidate carries no label. Scores are calibrated and the threshold is the highest one that keeps
the wanted recall on findings kept out of training.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import binary_lists, ready, text_bytes

#: Kinds and patterns of the rules, in their order.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{16,}")  # runs are maximal, so the length may stand in the pattern
KINDS = ("assign", "access", "hex", "learned")
KEYWORDS = ("passw", "secret", "token", "api")

CANDIDATE = re.compile(r"[A-Za-z0-9+/_.=-]{12,}")
#: Kinds of runs that are no credentials: words and hosts, words in capitals, numbers with dates and addresses, rulers.
_PART = r"(?:[A-Z]?[a-z]++[0-9]{0,3}+|[A-Z]++|[0-9]{1,16}+(?:T[0-9]{1,2}+)?+)"
HARMLESS = re.compile(rf"{_PART}(?:[-_./=+]++{_PART})*+|([-_./=+])\1*+")
EDGE = "+/_.=-"
LEFT, HEAD, TAIL, RIGHT = 24, 28, 12, 8
WIDTH = LEFT + HEAD + TAIL + RIGHT
#: At most so many corpus findings join the generated ones in training (the lowest hashes of their documents).
TRAIN_FINDINGS, TRAIN_DOCUMENTS = 4096, 4096
RECALL = 0.99
CODES, EMBED, FILTERS, SPAN, HIDDEN = 98, 8, 24, 5, 16


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """Rule matches, leftmost and non-overlapping within a kind, by start and then kind."""
    found = []
    low = text.lower()
    if any(k in low for k in KEYWORDS):
        found += [("assign", m.start(), m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 12]
    if "AKIA" in text:
        found += [("access", m.start(), m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 18]
    found += [("hex", m.start(), m.end()) for m in HEX.finditer(text)]
    return sorted(found, key=lambda s: (s[1], KINDS.index(s[0])))


def candidates(text: str) -> list[tuple[int, int]]:
    return [m.span() for m in CANDIDATE.finditer(text)]


def join_spans(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


_CODE = np.full(0x110000 // 16 + 128, 97, np.uint8)[:128].copy()
_CODE[32:127] = np.arange(1, 96)
_CODE[[9, 10, 11, 12, 13]] = 96


def windows(text: str, spans: list[tuple[int, int]]) -> np.ndarray:
    """Character codes around and in each candidate; 0 pads, 97 is any character beyond ASCII."""
    if not spans:
        return np.zeros((0, WIDTH), np.uint8)
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    codes, n = np.where(points < 128, _CODE[np.minimum(points, 127)], 97).astype(np.uint8), len(points)
    places = np.array(spans, np.int64)
    done = []
    for at in range(0, len(places), 4096):
        a, b = places[at : at + 4096, :1], places[at : at + 4096, 1:]
        parts = ((a - LEFT, LEFT, 0, n), (a, HEAD, 0, b), (np.maximum(a, b - TAIL), TAIL, 0, b), (b, RIGHT, 0, n))
        where = np.concatenate([start + np.arange(size) for start, size, _, _ in parts], axis=1)
        known = np.concatenate([(start + np.arange(size) >= low) & (start + np.arange(size) < high) for start, size, low, high in parts], axis=1)
        done.append(np.where(known, codes[np.clip(where, 0, n - 1)], 0).astype(np.uint8))
    return np.concatenate(done)


class Network:
    """Embedding, convolution, maximum over three regions, one hidden layer; trained by Adam, plain numpy."""

    def __init__(self, seed: int = 5) -> None:
        rng = np.random.default_rng(seed)
        self.w = {
            "embed": rng.normal(0, 0.3, (CODES, EMBED)), "conv": rng.normal(0, 0.15, (SPAN * EMBED, FILTERS)), "conv0": np.zeros(FILTERS),
            "hide": rng.normal(0, 0.15, (3 * FILTERS, HIDDEN)), "hide0": np.zeros(HIDDEN), "out": rng.normal(0, 0.3, HIDDEN), "out0": np.zeros(1),
        }
        self.w = {k: v.astype(np.float32) for k, v in self.w.items()}
        self.slope, self.shift, self.threshold = 1.0, 0.0, 0.5

    @staticmethod
    def _regions() -> list[tuple[int, int]]:
        return [(0, LEFT), (LEFT, LEFT + HEAD + TAIL), (LEFT + HEAD + TAIL - SPAN + 1, WIDTH - SPAN + 1)]

    def forward(self, codes: np.ndarray, keep: bool = False):
        w, n, steps = self.w, len(codes), WIDTH - SPAN + 1
        embedded = w["embed"][codes]
        patches = np.lib.stride_tricks.sliding_window_view(embedded, SPAN, axis=1).transpose(0, 1, 3, 2).reshape(n * steps, SPAN * EMBED)
        conv = (patches @ w["conv"] + w["conv0"]).reshape(n, steps, FILTERS)
        best = [lo + conv[:, lo:hi].argmax(axis=1) for lo, hi in self._regions()] if keep else []
        top = np.concatenate([conv[:, lo:hi].max(axis=1) for lo, hi in self._regions()], axis=1) if not keep else np.concatenate([np.take_along_axis(conv, b[:, None], axis=1)[:, 0] for b in best], axis=1)
        pooled = np.maximum(top, 0)
        hidden = np.maximum(pooled @ w["hide"] + w["hide0"], 0)
        logit = hidden @ w["out"] + w["out0"][0]
        return (logit, patches, best, top, pooled, hidden) if keep else logit

    def logits(self, codes: np.ndarray) -> np.ndarray:
        return np.concatenate([self.forward(codes[i : i + 512]) for i in range(0, len(codes), 512)]) if len(codes) else np.empty(0)

    def probability(self, codes: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * self.logits(codes) + self.shift, -35, 35)))

    def train(self, codes: np.ndarray, labels: np.ndarray, epochs: int = 14, batch: int = 128, rate: float = 4e-3, seed: int = 6) -> None:
        rng, first, second, step = np.random.default_rng(seed), {}, {}, 0
        steps = WIDTH - SPAN + 1
        for _ in range(epochs):
            order = rng.permutation(len(codes))
            for at in range(0, len(order), batch):
                some = order[at : at + batch]
                logit, patches, best, top, pooled, hidden = self.forward(codes[some], keep=True)
                error = ((1 / (1 + np.exp(-np.clip(logit, -35, 35)))) - labels[some]).astype(np.float32) / len(some)
                d_hidden = np.outer(error, self.w["out"]) * (hidden > 0)
                d_top = (d_hidden @ self.w["hide"].T) * (top > 0)
                d_conv = np.zeros((len(some), steps, FILTERS), np.float32)
                for k, b in enumerate(best):
                    np.add.at(d_conv, (np.arange(len(some))[:, None], b, np.arange(FILTERS)[None]), d_top[:, k * FILTERS : (k + 1) * FILTERS])
                flat = d_conv.reshape(-1, FILTERS)
                d_patch = (flat @ self.w["conv"].T).reshape(len(some), steps, SPAN, EMBED)
                d_embedded = np.zeros((len(some), WIDTH, EMBED), np.float32)
                for k in range(SPAN):
                    d_embedded[:, k : k + steps] += d_patch[:, :, k]
                d_embed = np.zeros_like(self.w["embed"])
                np.add.at(d_embed, codes[some].ravel(), d_embedded.reshape(-1, EMBED))
                slopes = {
                    "out": hidden.T @ error, "out0": error.sum(keepdims=True), "hide": pooled.T @ d_hidden, "hide0": d_hidden.sum(axis=0),
                    "conv": patches.T @ flat, "conv0": flat.sum(axis=0), "embed": d_embed,
                }
                step += 1
                for k, g in slopes.items():
                    first[k] = 0.9 * first.get(k, 0) + 0.1 * g
                    second[k] = 0.999 * second.get(k, 0) + 0.001 * g * g
                    move = rate * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8)
                    self.w[k] = (self.w[k] - move).astype(np.float32)

    def calibrate(self, codes: np.ndarray, labels: np.ndarray, recall: float = RECALL) -> None:
        """Platt scaling by Newton steps, then the highest threshold that keeps ``recall`` of these findings."""
        x = self.logits(codes).astype(float)
        y = np.where(labels == 1, (labels.sum() + 1) / (labels.sum() + 2), 1 / ((1 - labels).sum() + 2))

        def loss(v: np.ndarray) -> float:
            logit = v[0] * x + v[1]
            return float((np.logaddexp(0, logit) - y * logit).sum() + 5e-4 * v[0] ** 2)

        line = np.array([1.0, 0.0])
        for _ in range(40):
            p = 1 / (1 + np.exp(-np.clip(line[0] * x + line[1], -35, 35)))
            s = np.maximum(p * (1 - p), 1e-9)
            g = np.array([((p - y) * x).sum() + 1e-3 * line[0], (p - y).sum()])
            h = np.array([[(s * x * x).sum() + 1e-3, (s * x).sum()], [(s * x).sum(), s.sum() + 1e-6]])
            move = np.linalg.solve(h, g)
            while loss(line - move) > loss(line) and np.abs(move).max() > 1e-9:
                move /= 2
            line = line - move
        self.slope, self.shift = float(line[0]), float(line[1])
        hits = np.sort(self.probability(codes[labels == 1]))
        self.threshold = float(hits[int(np.floor((1 - recall) * len(hits)))]) if len(hits) else 0.5


def generated(n: int = 4000, seed: int = 9) -> tuple[np.ndarray, np.ndarray]:
    """Labelled findings made by rule: random credentials in assignments and prose, and look-alikes that are none."""
    rng = np.random.default_rng(seed)
    letters, digits = "abcdefghijklmnopqrstuvwxyz", "0123456789"

    def some(alphabet: str, low: int, high: int) -> str:
        return "".join(rng.choice(list(alphabet), rng.integers(low, high + 1)))

    def prose(k: int) -> str:
        return " ".join(some("etaoinshrdlu", 2, 8) for _ in range(k))

    def word() -> str:
        return "".join(some("bcdfghklmnprstvwz", 1, 2) + some("aeiou", 1, 2) for _ in range(rng.integers(4, 8)))

    full = letters + letters.upper() + digits
    keys = ["key", "credential", "bearer", "auth", "access", "private key", "pwd", "secret", "token", "password"]
    x, y = [], []
    for i in range(n):
        secret = i % 2 == 0
        if secret:
            value = [some(full, 20, 44), some(full + "+/", 24, 64) + "==", some("0123456789abcdef", 32, 40), "AKIA" + some(letters.upper() + digits, 16, 16), some(full + "_-", 16, 32), some(letters.upper() + digits, 16, 40)][rng.integers(6)]
        else:
            value = ["".join(some(letters, 3, 7) + "." for _ in range(3)) + "com" + str(rng.integers(99)), some(digits, 12, 16), f"{rng.integers(1990, 2030)}-{rng.integers(10, 13)}-{rng.integers(10, 29)}T{rng.integers(10, 24)}",
                     some(letters, 6, 9) + "_" + some(letters, 4, 9) + "_v" + str(rng.integers(9)), some(letters, 6, 12).upper() + some(letters, 6, 9).upper(), some(letters, 7, 9).capitalize() + some(letters, 6, 9).capitalize(),
                     f"+{rng.integers(10, 99)}-{rng.integers(100, 999)}-{rng.integers(1000, 9999)}-{rng.integers(100, 999)}", f"{rng.integers(1, 255)}.{rng.integers(1, 255)}.{rng.integers(10, 255)}.{rng.integers(100, 255)}",
                     word(), word().capitalize(), word() + "-" + word(), word().upper(), word() + "/" + word() + "/" + some(letters, 4, 8) + ".html", str(rng.choice(list("=-_./"))) * int(rng.integers(12, 60)),
                     some("etaoinshrdlu", 12, 18), f"{rng.integers(1990, 2030)}-{rng.integers(10, 13)}-{rng.integers(10, 29)}"][rng.integers(16)]
        if len(value) < 12:
            value += "." * (12 - len(value))
        before = prose(4) + " "
        if secret and rng.random() < 0.6:
            before += str(rng.choice(keys)) + str(rng.choice([" = ", ": ", "=", ' = "', " is "]))
        text = before + value + str(rng.choice([" ", '"', ".\n", ",", "###"])) + prose(2)
        x.append(windows(text, [(len(before), len(before) + len(value))])[0])
        y.append(int(secret))
    return np.array(x), np.array(y)


def harmless(run: str) -> bool:
    """Is the run of a kind that holds no credential?"""
    return HARMLESS.fullmatch(run.strip(EDGE) or run) is not None


def masked(text: str, kind: str, a: int, b: int) -> tuple[str, int, int] | None:
    """Text around a rule match without what the rule looks for, and the place of the value in it."""
    value = text[a:b]
    if kind == "assign":
        value = ASSIGN.match(value).group(2)
    elif kind == "access":
        value = value[4:]
    if len(value) < 12:
        return None
    before = text[max(0, a - LEFT) : a]
    return before + value + text[b : b + RIGHT], len(before), len(before) + len(value)


def _findings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        codes, labels, order = [], [], []

        def put(text: str, spans: list[tuple[int, int]], label: int, places: list[str]) -> None:
            codes.extend(row.tobytes() for row in windows(text, spans))
            labels.extend([label] * len(spans))
            order.extend(places)

        for raw, first in zip(binary_lists(batch.column("text")), batch.column("first").to_pylist(), strict=True):
            text = raw.decode("utf-8", "replace")
            base = base_spans(text)
            for kind, a, b in base:
                found = masked(text, kind, a, b)
                if found and not harmless(found[0][found[1] : found[2]]):
                    put(found[0], [found[1:]], 1, [f"{first:020d}:{a:012d}:{kind}"])
            free = [(a, b) for a, b in _free(base, candidates(text)) if harmless(text[a:b])]
            put(text, free, 0, [f"{first:020d}:{a:012d}" for a, _ in free])
        yield pa.RecordBatch.from_arrays([pa.array(order, pa.string()), pa.array(codes, pa.binary()), pa.array(labels, pa.int32())], ["place", "codes", "label"])


def _free(base: list[tuple[str, int, int]], spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Candidates that overlap no rule match."""
    free, k, ends = [], 0, sorted((s, e) for _, s, e in base)
    for a, b in spans:
        while k < len(ends) and ends[k][1] <= a:
            k += 1
        if not any(s < b and a < e for s, e in ends[k : k + 4]):
            free.append((a, b))
    return free


def fit(docs: DataFrame) -> Network:
    """A network from the generated findings and at most ``TRAIN_FINDINGS`` of the corpus; a fifth of each calibrates it.

    The corpus' findings come from at most ``TRAIN_DOCUMENTS`` documents, those with the lowest hashes.
    """
    ready(docs.sparkSession)
    rows = docs.select(text_bytes("text").alias("text")).withColumn("first", F.shiftrightunsigned(F.xxhash64("text"), 1))
    chosen = rows.select("first").distinct().orderBy("first").limit(TRAIN_DOCUMENTS)
    rows = rows.join(F.broadcast(chosen), "first", "left_semi").dropDuplicates(["first"])  # TRAIN_DOCUMENTS numbers
    found = rows.select("text", "first").mapInArrow(_findings, "place string, codes binary, label int")
    places = Window.partitionBy("label").orderBy(F.xxhash64("place"), "place")  # of TRAIN_DOCUMENTS documents
    found = found.withColumn("_n", F.row_number().over(places)).where(F.col("_n") <= TRAIN_FINDINGS // 2).orderBy("label", "_n").select("codes", "label").collect()
    x, y = generated()
    if found:
        x = np.concatenate([x, np.array([np.frombuffer(r["codes"], np.uint8) for r in found])])
        y = np.concatenate([y, np.array([r["label"] for r in found])])
    out = np.arange(len(y)) % 5 == 4
    network = Network()
    network.train(x[~out], y[~out].astype(np.float32))
    network.calibrate(x[out], y[out])
    return network


def scan(docs: DataFrame, network: Network) -> DataFrame:
    """``doc_id, n_assign, n_access, n_hex, n_learned, base_sha256, spans`` for every row; offsets are code points.

    Rule spans stay as they are; a candidate that overlaps none of them and reaches the threshold adds a ``learned`` span.
    Null and empty texts have no span and the digest of the empty string. Every text is read whole.
    """
    ready(docs.sparkSession)
    names = ["doc_id", "n_assign", "n_access", "n_hex", "n_learned", "base_sha256", "spans"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            open_, codes = [], []
            for raw in binary_lists(batch.column("text")):
                text = raw.decode("utf-8", "replace")
                base = base_spans(text)
                free = _free(base, candidates(text))
                rows.append(base)
                open_.append(free)
                codes.append(windows(text, free))
            score = network.probability(np.concatenate(codes)) if codes else np.empty(0)
            at, columns = 0, [[] for _ in names[1:]]
            for base, free in zip(rows, open_, strict=True):
                new = [("learned", a, b) for (a, b), p in zip(free, score[at : at + len(free)], strict=True) if p >= network.threshold]
                at += len(free)
                spans = sorted(base + new, key=lambda s: (s[1], KINDS.index(s[0])))
                for column, value in zip(columns, [*(sum(s[0] == k for s in spans) for k in KINDS), hashlib.sha256(join_spans(base).encode()).hexdigest(), join_spans(spans)], strict=True):
                    column.append(value)
            types = [pa.int64()] * 4 + [pa.string()] * 2
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(c, t) for c, t in zip(columns, types, strict=True))], names)

    rows = docs.select("doc_id", text_bytes("text").alias("text"))
    return rows.mapInArrow(run, "doc_id long, n_assign long, n_access long, n_hex long, n_learned long, base_sha256 string, spans string")
