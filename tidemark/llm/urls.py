"""URL filter: rules by host and path; otherwise naive Bayes over words that Viterbi finds in concatenated names.

The unigram model is the vocabulary file of a public tokenizer: its whole-word entries stand in order of frequency, so rank
gives their probability by Zipf's law. Naive Bayes counts words of all urls; a url's label is what seed words say about it.
"""

from __future__ import annotations

import json
import math
import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import ready

#: Fixed values: (verdict, host, path); the longest host and path that fit decide.
RULES = [
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
]
#: A url whose segmented names hold one of these words is a labelled example of what to block.
SEEDS = frozenset("ads adult bet bets betting casino gambling hack malware phishing pills poker porn sex slots spam viagra warez xxx".split())
VOCABULARY = "word_bpe_49k.json"
LONGEST, UNKNOWN = 20, -16.0


def split_url(url: str | Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path; both empty for null or without ``://``."""
    url = F.col(url) if isinstance(url, str) else url
    rest = F.when(F.instr(url, "://") > 0, F.expr("substring(url, instr(url, '://') + 3)"))
    host = F.regexp_extract(rest, r"^([^/?#]*)", 1)
    path = F.regexp_extract(rest, r"^[^/?#]*(/[^?#]*)", 1)
    capitals = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.coalesce(F.translate(host, capitals, capitals.lower()), F.lit("")), F.coalesce(path, F.lit(""))


def deciding_rule() -> tuple[Column, Column]:
    """Name and verdict of the longest rule that fits ``host`` and ``path``, or nulls."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for kind, host, path in sorted(RULES, key=lambda r: len(r[1] + r[2])):
        fits = ((F.col("host") == host) | F.col("host").endswith("." + host)) & F.col("path").startswith(path)
        name, verdict = F.when(fits, F.lit(host + path)).otherwise(name), F.when(fits, F.lit(kind)).otherwise(verdict)
    return name, verdict


@lru_cache(maxsize=2)
def unigrams(vocabulary: str) -> dict[str, float]:
    """Log probability of each whole word of the vocabulary file, by rank."""
    import public_tokenizers

    with open(public_tokenizers.path(vocabulary), encoding="utf-8") as file:
        entries = json.load(file)["model"]["vocab"]
    words = sorted((i, w[:-4]) for w, i in entries.items() if w.endswith("</w>") and re.fullmatch("[a-z]{2,20}", w[:-4]))
    total = sum(1 / (rank + 10) for rank in range(len(words)))
    return {w: -math.log((rank + 10) * total) for rank, (_, w) in enumerate(words)}


@lru_cache(maxsize=100_000)
def segment(name: str, vocabulary: str = VOCABULARY) -> tuple[str, ...]:
    """The most probable words of a concatenated lower-case name; letters outside any word become one ``?`` each run."""
    known = unigrams(vocabulary)
    best = [(0.0, 0, "")]
    for end in range(1, len(name) + 1):
        options = [(best[end - 1][0] + UNKNOWN, end - 1, "?")]
        for start in range(max(0, end - LONGEST), end - 1):
            if (p := known.get(name[start:end])) is not None:
                options.append((best[start][0] + p, start, name[start:end]))
        best.append(max(options, key=lambda o: (o[0], -o[1])))
    words, at = [], len(name)
    while at:
        _, start, word = best[at]
        if not (word == "?" and words and words[-1] == "?"):
            words.append(word)
        at = start
    return tuple(reversed(words))


def url_words(host: str, path: str, vocabulary: str = VOCABULARY) -> list[str]:
    """Features of a url: words of the host (``h:``) and of the path (``p:``); digits count as ``0``."""
    out = []
    for mark, part in (("h:", host), ("p:", path.lower())):
        for run in re.findall(r"[a-z]+|[0-9]+", part):
            out += [mark + "0"] if run[0].isdigit() else [mark + w for w in segment(run, vocabulary)]
    return out


def _words(vocabulary: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words = [url_words(h, p, vocabulary) for h, p in zip(batch.column("host").to_pylist(), batch.column("path").to_pylist(), strict=True)]
            bad = [any(w[2:] in SEEDS for w in some) for some in words]
            yield pa.RecordBatch.from_arrays([pa.array(bad, pa.bool_()), pa.array(words, pa.list_(pa.string()))], ["bad", "words"])

    return run


def fit(parts: DataFrame, vocabulary: str = VOCABULARY) -> dict[str, float]:
    """Log odds of ``block`` by word, with ``""`` for the prior: add-one multinomial naive Bayes over all rows with a host.

    Counts are combined in the tasks; at most two entries per vocabulary word reach the driver.
    """
    rows = parts.where("host != ''").select("host", "path").mapInArrow(_words(vocabulary), "bad boolean, words array<string>")
    classes, counts = {True: 0, False: 0}, {}
    words = rows.select("bad", F.explode_outer(F.concat("words", F.array(F.lit("")))).alias("word")).groupBy("bad", "word").count()
    for row in words.collect():
        if row["word"] == "":
            classes[row["bad"]] = row["count"]
        else:
            counts.setdefault(row["word"], {True: 0, False: 0})[row["bad"]] = row["count"]
    total = {k: sum(c[k] for c in counts.values()) + len(counts) + 1 for k in (True, False)}
    odds = {w: math.log((c[True] + 1) / total[True]) - math.log((c[False] + 1) / total[False]) for w, c in counts.items()}
    odds[""] = math.log((classes[True] + 1) / (classes[False] + 1))
    return odds


def judge(pages: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """``page_id, host, path, rule, verdict, score`` for every row of ``pages``.

    ``score`` is the log odds of naive Bayes; where no rule fits, the verdict is block if it is above 0. Null urls and urls
    without ``://`` have an empty host and path, no rule, and are judged by the prior. Repeated rows are judged alike.
    """
    ready(pages.sparkSession)
    host, path = split_url("url")
    parts = pages.select("page_id", host.alias("host"), path.alias("path"), "url")
    odds = fit(parts, vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = []
            for h, p in zip(batch.column("host").to_pylist(), batch.column("path").to_pylist(), strict=True):
                scores.append(odds[""] + sum(odds.get(w, 0.0) for w in url_words(h, p, vocabulary)))
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("host"), batch.column("path"), pa.array(scores, pa.float64())], ["page_id", "host", "path", "score"])

    rows = parts.select("page_id", "host", "path").mapInArrow(run, "page_id long, host string, path string, score double")
    rule, verdict = deciding_rule()
    learned = F.when(F.col("score") > 0, "block").otherwise("allow")
    return rows.select("page_id", "host", "path", rule.alias("rule"), F.coalesce(verdict, learned).alias("verdict"), "score")
