"""Token ids in bit-plane files: blocks of ids, transposed into byte planes, each compressed on its own, with a chunk index.

A file set is a Parquet table (so that any store that Spark reaches will do) of chunks of up to ``CHUNK`` ids:

``shard, chunk``   which range of documents, and the place in it
``first, n_ids``   position of the chunk's first id in the shard, number of ids
``planes``         one zstandard frame for each byte of an id, lowest byte first: byte k of all ids behind one another
``doc_ids, ends, opens``  the index: documents that have ids here, where each one's ids end in the chunk, and whether the
                   first one goes on from the chunk before
``goes_on``        whether the last document has more ids in the next chunk

Shards follow one another in ascending doc_id order. Columns other than ``planes`` can be read alone.
"""

from __future__ import annotations

import re
import zlib
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import binary_lists, cut_long, ready, run_hashes, slices, store, text_bytes

CHUNK = 1 << 16
END = 2
LEVEL = 3
#: Words whose ids a worker remembers; older ones are forgotten together. Longer words are never kept.
MEMORY, MEMORY_BYTES = 500_000, 48
#: The same for runs of plain texts; places in their table (twice as many at least), and ids that they may have together.
RUNS, RUN_SLOTS, RUN_IDS = 1_000_000, 1 << 21, 1 << 24
#: New runs that go to the tokenizer as one text.
JOINED = 64
#: Latin letters (composed, so normal forms leave them) and then ASCII marks but the apostrophe, which pre-tokens may start with.
_PLAIN = re.compile(r"([A-Za-z\u00C0-\u00D6\u00D8-\u00F6\u00F8-\u00FF]*)([!-&(-/:-@\[-`{-~]*)")
FILE = "shard long, chunk long, first long, n_ids long, planes array<binary>, doc_ids array<long>, ends array<int>, opens boolean, goes_on boolean"


@lru_cache(maxsize=2)
def _tokenizer(name: str):
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    import public_tokenizers
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(public_tokenizers.path(name))
    return tokenizer, {}, {}, RunMemory(tokenizer)


_KIND = np.full(256, 3, np.uint8)  # marks; letters, digits and white space follow
_KIND[[9, 10, 11, 12, 13, 32]] = 0
_KIND[65:91] = _KIND[97:123] = _KIND[128:] = 1
_KIND[48:58] = 2
_SHIFT = np.zeros(256, np.uint8)
_SHIFT[65:91] = 32
#: Bytes of texts on the run path: no apostrophes (contractions are pre-tokens), no controls, nothing beyond U+00FF.
_FINE = bytes(b for b in [9, 10, 11, 12, 13, *range(32, 127), *range(0x80, 0xC0), 0xC3] if b != 39)


def _odd(text: bytes) -> bool:
    """Whether a text holds anything but ASCII and the letters U+00C0 to U+00FF, or apostrophes, controls or special tokens."""
    if text.translate(None, _FINE) or b"<|" in text:
        return True
    if text.isascii():
        return False
    try:
        text.decode()
    except UnicodeDecodeError:
        return True
    return b"\xc3\x97" in text or b"\xc3\xb7" in text


def _encode_words(words: list[bytes], tokenizer, parts: dict[bytes, bytes]) -> list[bytes]:
    """Ids of whole words. A word of plain letters and then marks is two pre-tokens, each remembered in lower case."""
    cut = [_PLAIN.fullmatch(w) for w in map(_text, words)]
    pieces = [tuple(p for p in (m[1].lower(), m[2]) if p) if m else (_text(w),) for m, w in zip(cut, words, strict=True)]
    new = list({p for some in pieces for p in some if p.encode() not in parts})
    if len(parts) + len(new) > MEMORY:
        parts.clear()
        new = list({p for some in pieces for p in some})
    parts.update(zip([p.encode() for p in new], _ids(tokenizer, new), strict=True))
    out = [b"".join([parts[p.encode()] for p in some]) for some in pieces]
    for p in new:
        if len(p) > MEMORY_BYTES:
            del parts[p.encode()]
    return out


def _text(word: bytes) -> str:
    return word.decode("utf-8", "replace")


def _ids(tokenizer, texts: list[str]) -> list[bytes]:
    return [array("I", found.ids).tobytes() for found in tokenizer.encode_batch_fast(texts, add_special_tokens=False)]


class RunMemory:
    """Ids of runs by the runs' 64-bit hashes: an open table of places in one array of ids."""

    def __init__(self, tokenizer):
        self.tokenizer = tokenizer
        suffix = getattr(tokenizer.model, "end_of_word_suffix", None)
        self.last = None  # which ids end a word
        if suffix:
            vocabulary = tokenizer.get_vocab()
            self.last = np.zeros(max(vocabulary.values()) + 1, bool)
            self.last[[i for token, i in vocabulary.items() if token.endswith(suffix)]] = True
        self.clear()

    def clear(self) -> None:
        self.keys, self.at, self.size = np.zeros(RUN_SLOTS, np.uint64), np.zeros(RUN_SLOTS, np.int64), np.zeros(RUN_SLOTS, np.int64)
        self.ids, self.n_ids, self.n_runs = np.empty(1 << 16, np.uint32), 0, 0

    def find(self, hashes: np.ndarray) -> np.ndarray:
        """The slot of each hash, -1 for one that is not remembered."""
        slot = (hashes & np.uint64(RUN_SLOTS - 1)).astype(np.int64)
        held = self.keys[slot]
        left = np.flatnonzero(held != hashes)
        while len(left):
            left, gone = left[held[left] != 0], left[held[left] == 0]
            slot[gone] = -1
            slot[left] = (slot[left] + 1) % RUN_SLOTS
            held[left] = self.keys[slot[left]]
            left = left[held[left] != hashes[left]]
        return slot

    def _keep(self, hashes: np.ndarray, at: np.ndarray, size: np.ndarray) -> None:
        """Enter distinct hashes that are not there."""
        slot = (hashes & np.uint64(RUN_SLOTS - 1)).astype(np.int64)
        left = np.arange(len(hashes))
        while len(left):
            free = left[self.keys[slot[left]] == 0]
            self.keys[slot[free]] = hashes[free]  # of several for one slot the last stays
            own = self.keys[slot[left]] == hashes[left]
            done, left = left[own], left[~own]
            self.at[slot[done]], self.size[slot[done]] = at[done], size[done]
            slot[left] = (slot[left] + 1) % RUN_SLOTS
        self.n_runs += len(hashes)

    def encode(self, data: bytes, starts: np.ndarray, ends: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the runs ``data[starts:ends]`` behind one another, and their number by run."""
        hashes = np.maximum(hashes, np.uint64(1))
        if self.n_ids > RUN_IDS:
            self.clear()
        slot = self.find(hashes)
        new = np.flatnonzero(slot < 0)
        first, which = new[:0], new[:0]
        if len(new):
            _, first, which = np.unique(hashes[new], return_index=True, return_inverse=True)
            if self.n_runs + len(first) > RUNS:
                self.clear()
                slot[:], new = -1, np.arange(len(hashes))
                _, first, which = np.unique(hashes, return_index=True, return_inverse=True)
            first = new[first]
        fresh, count = self._encode([data[s:e] for s, e in zip(starts[first].tolist(), ends[first].tolist(), strict=True)])
        # all new ids go behind the remembered ones for now; those of long runs, which come last, are forgotten at once
        kept = ends[first] - starts[first] <= MEMORY_BYTES
        place = np.cumsum(count) - count
        room = self.n_ids + len(fresh)
        if room > len(self.ids):
            self.ids = np.concatenate([self.ids[: self.n_ids], np.empty(max(room, 2 * self.n_ids) - self.n_ids, np.uint32)])
        order = np.argsort(~kept, kind="stable")
        moved = count[order]
        target = self.n_ids + np.cumsum(moved) - moved
        self.ids[self.n_ids : room] = fresh[np.repeat(place[order] - (target - self.n_ids), moved) + np.arange(len(fresh))]
        at_new = np.empty(len(first), np.int64)
        at_new[order] = target
        at, size = self.at[slot], self.size[slot]
        at[new], size[new] = at_new[which], count[which]
        begin = np.cumsum(size) - size
        out = self.ids[np.repeat(at - begin, size) + np.arange(int(size.sum()))]
        if len(first) <= RUNS:  # more runs than that in one text are not remembered
            self._keep(hashes[first[kept]], at_new[kept], count[kept])
            self.n_ids += int(count[kept].sum())
        return out, size

    def _encode(self, runs: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of distinct runs and their number: many runs are one text, parted again after ids that end a word."""
        words = np.array([len(r) if r[:1].isdigit() else 1 for r in runs], np.int64)  # a digit is a word
        if self.last is not None and runs:
            texts = [b" ".join(runs[i : i + JOINED]).decode() for i in range(0, len(runs), JOINED)]
            flat = np.concatenate([np.array(f.ids, np.uint32) for f in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)])
            ends = np.flatnonzero(self.last[flat]) + 1
            if len(ends) == words.sum() and ends[-1:] == len(flat):
                return flat, np.diff(ends[np.cumsum(words) - 1], prepend=0)
        found = _ids(self.tokenizer, [r.decode() for r in runs])
        return np.frombuffer(b"".join(found), np.uint32), np.array([len(f) // 4 for f in found], np.int64)


def _encode_plain(texts: list[bytes], memory: RunMemory) -> list[np.ndarray]:
    """Ids of texts in which every run of letters, digits or marks is a pre-token (digits: several): distinct runs are encoded once."""
    raw = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
    folded = raw + _SHIFT[raw]
    accent = np.flatnonzero(raw[:-1] == 0xC3) + 1
    folded[accent[raw[accent] < 0x9F]] += 32
    kind = _KIND[raw]
    change = np.flatnonzero(kind[1:] != kind[:-1]) + 1
    starts, ends = np.concatenate(([0], change)), np.concatenate((change, [len(raw)]))
    real = kind[starts] > 0
    starts, ends = starts[real], ends[real]
    flat, size = memory.encode(folded.tobytes(), starts, ends, run_hashes(folded, starts, ends))
    begin = np.cumsum([len(x) + 1 for x in texts])
    cuts = np.concatenate(([0], np.cumsum(size)))[np.searchsorted(starts, begin)]
    return np.split(flat, cuts[:-1])


def _encode_text(text: bytes, tokenizer, known: dict[bytes, bytes], parts: dict[bytes, bytes]) -> np.ndarray:
    """Ids of any text, word by word: the pre-tokenizer cuts at white space."""
    words = text.split()
    new = [w for w in set(words) if w not in known]
    if len(known) + len(new) > MEMORY:
        known.clear()
        new = list(set(words))
    known.update(zip(new, _encode_words(new, tokenizer, parts), strict=True))
    out = np.frombuffer(b"".join([known[w] for w in words]), np.uint32)
    for w in new:
        if len(w) > MEMORY_BYTES:
            del known[w]
    return out


def encode(texts: list[bytes], name: str) -> Iterator[np.ndarray]:
    """Token ids of each text; distinct words and runs are encoded once and remembered, long texts go in blocks of words."""
    tokenizer, known, parts, runs = _tokenizer(name)
    for lo, hi in slices(texts):
        pieces, owner = cut_long(texts[lo:hi])
        plain = [i for i, p in enumerate(pieces) if not _odd(p)]
        out: list = [None] * len(pieces)
        for a, b in slices([pieces[i] for i in plain]):
            for i, ids in zip(plain[a:b], _encode_plain([pieces[i] for i in plain[a:b]], runs), strict=True):
                out[i] = ids
        for i, ids in enumerate(out):
            if ids is None:
                out[i] = _encode_text(pieces[i], tokenizer, known, parts)
        at = 0
        for k in range(hi - lo):
            end = at
            while end < len(owner) and owner[end] == k:
                end += 1
            yield out[at] if end == at + 1 else np.concatenate(out[at:end])
            at = end


def to_planes(ids: np.ndarray, width: int = 4) -> list[bytes]:
    """Byte planes of a block of ids, each compressed."""
    import zstandard

    press = zstandard.ZstdCompressor(level=LEVEL)
    raw = np.ascontiguousarray(ids.astype("<u4")).view(np.uint8).reshape(len(ids), 4)
    return [press.compress(np.ascontiguousarray(raw[:, k]).tobytes()) for k in range(width)]


def from_planes(planes: list[bytes], n: int) -> np.ndarray:
    """The ids of a block."""
    import zstandard

    open_ = zstandard.ZstdDecompressor()
    raw = np.zeros((n, 4), np.uint8)
    for k, plane in enumerate(planes):
        raw[:, k] = np.frombuffer(open_.decompress(plane, max_output_size=max(n, 1)), np.uint8)
    return raw.view("<u4").reshape(n)


def _writer(name: str, end: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, chunk, first = TaskContext.get().partitionId(), 0, 0
        block = np.empty(CHUNK, np.uint32)
        held, docs, ends, opens = 0, [], [], False

        def out(goes_on: bool) -> pa.RecordBatch:
            row = {"shard": shard, "chunk": chunk, "first": first, "n_ids": held, "planes": to_planes(block[:held]), "doc_ids": docs, "ends": ends, "opens": opens, "goes_on": goes_on}
            kinds = [pa.int64()] * 4 + [pa.list_(pa.binary()), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.bool_(), pa.bool_()]
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row.values(), kinds, strict=True)], list(row))

        for batch in batches:
            for doc, ids in zip(batch.column("doc_id").to_pylist(), encode(binary_lists(batch.column("text")), name), strict=True):
                ids, at = np.append(ids, np.uint32(end)), 0
                while at < len(ids):
                    take = min(CHUNK - held, len(ids) - at)
                    block[held : held + take] = ids[at : at + take]
                    held, at = held + take, at + take
                    docs.append(doc)
                    ends.append(held)
                    if held == CHUNK:
                        yield out(at < len(ids))
                        chunk, first, held, docs, ends, opens = chunk + 1, first + held, 0, [], [], at < len(ids)
        if held:
            yield out(False)

    return run


def write_ids(docs: DataFrame, name: str = "word_bpe_49k.json", end: int = END) -> DataFrame:
    """Encode every whole text (null: empty), append ``end`` to each, write the file set and return it as read back.

    Documents are ordered by doc_id (null first), rows that repeat one by their text. Long texts run over several chunks; an
    empty text is its end id alone; an empty table gives no chunk.
    """
    ready(docs.sparkSession)
    rows = docs.select("doc_id", text_bytes("text").alias("text"))
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = rows.repartitionByRange(parts, "doc_id", F.xxhash64("text")).sortWithinPartitions("doc_id", F.xxhash64("text"), "text")
    return store(rows.mapInArrow(_writer(name, end), FILE), "token-ids")


def _reader(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["shard", "doc_id", "first", "n_tokens", "crc", "open_left", "open_right"]
    for batch in batches:
        for row in batch.to_pylist():
            ids = from_planes(row["planes"], row["n_ids"])
            data = memoryview(np.ascontiguousarray(ids.astype("<u4")).view(np.uint8))
            starts = [0, *row["ends"][:-1]]
            crcs = [zlib.crc32(data[4 * a : 4 * b]) for a, b in zip(starts, row["ends"], strict=True)]
            n = len(starts)
            yield pa.RecordBatch.from_arrays(
                [pa.array([row["shard"]] * n, pa.int64()), pa.array(row["doc_ids"], pa.int64()),
                 pa.array([row["first"] + a for a in starts], pa.int64()),
                 pa.array([b - a for a, b in zip(starts, row["ends"], strict=True)], pa.int64()), pa.array(crcs, pa.int64()),
                 pa.array([row["opens"] and k == 0 for k in range(n)], pa.bool_()),
                 pa.array([row["goes_on"] and k == n - 1 for k in range(n)], pa.bool_())], names)


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        crcs = []
        for parts in batch.column("parts").to_pylist():
            crc = 0
            for part in parts:
                zeros = bytes(4 * part["n_tokens"])  # crc(a + b) from crc(a), crc(b) and the length of b
                crc = zlib.crc32(zeros, crc) ^ part["crc"] ^ zlib.crc32(zeros)
            crcs.append(crc)
        yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in ("shard", "doc_id", "first", "n_tokens")), pa.array(crcs, pa.int64())], ["shard", "doc_id", "first", "n_tokens", "ids_crc32"])


def read_documents(files: DataFrame) -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32`` of every document, from the files alone.

    Only documents that run over several chunks are brought together, and of those only lengths and checksums.
    """
    chunks = files.groupBy("shard").agg(F.sum("n_ids").alias("ids")).orderBy("shard").collect()  # one row a shard
    bases, before = [], 0
    for row in chunks:
        bases += [F.lit(row["shard"]), F.lit(before)]
        before += row["ids"]
    base = F.create_map(*bases)[F.col("shard")] if bases else F.lit(0)
    pieces = files.mapInArrow(_reader, "shard long, doc_id long, first long, n_tokens long, crc long, open_left boolean, open_right boolean")
    pieces = store(pieces, "token-pieces")
    single = pieces.where("not open_left and not open_right").select("shard", "doc_id", "first", "n_tokens", F.col("crc").alias("ids_crc32"))
    split = pieces.where("open_left or open_right")
    order = Window.partitionBy("shard").orderBy("first").rowsBetween(Window.unboundedPreceding, 0)
    split = split.withColumn("no", F.sum(F.when(F.col("open_left"), 0).otherwise(1)).over(order))
    split = split.groupBy("shard", "no").agg(
        F.min("doc_id").alias("doc_id"), F.min("first").alias("first"), F.sum("n_tokens").alias("n_tokens"),
        F.sort_array(F.collect_list(F.struct("first", "n_tokens", "crc"))).alias("parts"))
    split = split.select("shard", "doc_id", "first", "n_tokens", "parts").mapInArrow(_joined, "shard long, doc_id long, first long, n_tokens long, ids_crc32 long")
    return single.union(split).select("doc_id", (base + F.col("first")).cast("long").alias("start"), "n_tokens", "ids_crc32")
