"""Evidence graph: mentions, entities, validation, conflicts, bounded expansion and edge ranking."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark import rules
from tidemark.functions import text as T
from tidemark.operators.skew import salted_join
from tidemark.session import stored

WORD = 60  # questions per bit mask
OPEN_AUDIENCES = ("doctor", "clinician", "audit")


def mentions(chunks: DataFrame, vocabulary: dict[str, tuple]) -> DataFrame:
    """(entity, chunk) where the chunk's text contains a dictionary term; the dictionary is fixed, nothing is shuffled."""

    def named(kind: str, terms) -> Column:
        return F.transform(T.contained(F.col("text"), terms), lambda x: F.concat(F.lit(f"{kind}:"), x))

    hits = F.concat(*[named(kind, terms) for kind, terms in vocabulary.items()])
    return chunks.select("chunk_id", "topic", "source", F.explode(hits).alias("entity"))


def relation_problem(allowed=rules.RELATION_TYPES) -> Column:
    """First reason why an edge is not admitted; NULL when it is."""
    empty = F.lit(False)
    for c in ("source", "target", "type", "evidence", "strength"):
        empty = empty | F.col(c).isNull() | (F.col(c) == "")
    return (
        F.when(empty, "missing_required").when(~F.col("strength").isin(*rules.STRENGTHS), "invalid_strength")
        .when(~F.col("type").isin(*allowed), "unknown_relation_type")
        .when(F.col("evidence_level").isNotNull() & ~F.col("evidence_level").isin(*rules.EVIDENCE_LEVELS), "invalid_evidence_level")
    )


def enrich(edges: DataFrame, sources: DataFrame) -> DataFrame:
    """Defaults for evidence level, causal status, population and review status from the edge's evidence source.

    Values that an edge brings are kept; a causal status that neither edge nor type gives is ``guidance``."""
    joined = edges.withColumn("evidence_source", F.substring_index("evidence", "#", 1)).join(sources, "evidence_source", "left")
    causal = F.when(F.col("type").isin("associated_with", "predictive_factor_in_older_adults"), "association").when(
        F.col("type").isin("managed_by", "prevention_evidence", "supportive_evidence"), "guidance"
    )
    filled = {
        "evidence_level": F.coalesce("source_level", F.lit("public_guidance")), "causal_status": F.coalesce(causal, F.lit("guidance")),
        "population": F.lit("older_adults"), "review_status": F.coalesce("source_review", F.lit("pending_medical_review")),
    }
    given = [c for c in edges.columns if c not in filled]
    return joined.select(*given, *[(F.coalesce(F.col(c), v) if c in edges.columns else v).alias(c) for c, v in filled.items()])


def entities(edges: DataFrame) -> DataFrame:
    """Vertex table from the edge endpoints; evidence is counted from distinct (entity, evidence) pairs."""
    ends = edges.select(F.explode(F.array("source", "target")).alias("entity"), "evidence").distinct()
    return ends.groupBy("entity").agg(F.count("evidence").alias("n_evidence")).select(
        "entity", F.substring_index("entity", ":", 1).alias("kind"), F.regexp_replace("entity", "^[^:]*:", "").alias("name"), "n_evidence"
    )


def conflicts(edges: DataFrame, pairs=rules.CONTRADICTIONS) -> DataFrame:
    """Entity pairs that carry two contradictory types; one flag per type, so no set is collected."""
    wanted = sorted({x for p in pairs for x in p})
    flags = edges.filter(F.col("type").isin(*wanted)).groupBy("source", "target").agg(*[F.bool_or(F.col("type") == w).alias(w) for w in wanted])
    flags = flags.filter(reduce(lambda x, y: x | y, [F.col(a) & F.col(b) for a, b in pairs]))  # few pairs: only theirs are listed
    kinds = F.array_compact(F.array(*[F.when(F.col(a) & F.col(b), F.lit("|".join(sorted((a, b))))) for a, b in pairs]))
    return flags.select("source", "target", F.explode(kinds).alias("types"))


def causal_conflicts(edges: DataFrame) -> DataFrame:
    """Pairs described both as causal and as association or unknown."""
    s = F.col("causal_status")
    flags = edges.groupBy("source", "target").agg(F.bool_or(s == "causal").alias("_c"), F.bool_or(s.isin("association", "unknown")).alias("_o"))
    return flags.filter(F.col("_c") & F.col("_o")).select("source", "target")


def planes(edges: DataFrame, seeds: DataFrame, hops: int = 2, salts: int = 16) -> DataFrame:
    """(word, node, m0 .. m<hops>): which questions reach the node with 0 .. ``hops`` steps, a bit per question; planes may overlap.

    Questions travel as bits of a mask, so an expansion round handles ``WORD`` questions per edge row. Hub nodes are
    salted. A round is stored way by way, so that the disk holds the shuffled edges of one way at a time: give stored edges.
    ``seeds`` has (question, node) with consecutive question numbers from 0.
    """
    front = stored(_ored(seeds.select(word_of("question").alias("word"), "node", bit_of("question").alias("mask"))), "front")
    layers = [front]
    for _ in range(hops):
        ways = []
        for here, there in (("source", "target"), ("target", "source")):
            way = edges.select(F.col(here).alias("node"), F.col(there).alias("next"))
            met = salted_join(way, front, ["node"], ["next"], "inner", salts)
            ways.append(stored(_ored(met.select("word", F.col("next").alias("node"), "mask")), "way"))
        front = stored(_ored(ways[0].unionByName(ways[1])), "front")
        layers.append(front)
    tagged = layers[0].withColumn("hop", F.lit(0))
    for hop, layer in enumerate(layers[1:], 1):
        tagged = tagged.unionByName(layer.withColumn("hop", F.lit(hop)))
    return tagged.groupBy("word", "node").agg(*[
        F.coalesce(F.bit_or(F.when(F.col("hop") == h, F.col("mask"))), no_bits()).alias(f"m{h}") for h in range(hops + 1)
    ])


def _ored(masks: DataFrame) -> DataFrame:
    return masks.groupBy("word", "node").agg(F.bit_or("mask").alias("mask"))


def no_bits() -> Column:
    return F.lit(0).cast("long")


def word_of(question: str) -> Column:
    return F.floor(F.col(question) / WORD).cast("long")


def bit_of(question: str) -> Column:
    return F.expr(f"shiftleft(1L, CAST({question} % {WORD} AS INT))")


def nearest(hops: int) -> list[Column]:
    """The planes m0 .. m<hops> with every question only at its smallest step."""
    seen, out = no_bits(), []
    for h in range(hops + 1):
        out.append(F.col(f"m{h}").bitwiseAND(F.bitwise_not(seen)))
        seen = seen.bitwiseOR(F.col(f"m{h}"))
    return out


def reach(edges: DataFrame, seeds: DataFrame, hops: int = 2, salts: int = 16) -> DataFrame:
    """(word, node, hop, mask): smallest hop (0..hops) at which each question reaches each node, for a whole batch of questions."""
    found = [F.struct(F.lit(h).alias("hop"), new.alias("mask")) for h, new in enumerate(nearest(hops))]
    return planes(edges, seeds, hops, salts).select("word", "node", F.explode(F.array(*found)).alias("_f")).select("word", "node", "_f.*").filter("mask <> 0")


def unpack(masks: DataFrame) -> DataFrame:
    """(question, node, hop) rows of a reach table."""
    bits = F.filter(F.sequence(F.lit(0), F.lit(WORD - 1)), lambda b: F.call_function("shiftright", F.col("mask"), b).bitwiseAND(F.lit(1)) == 1)
    return masks.select("word", "node", "hop", F.explode(bits).alias("_b")).select((F.col("word") * WORD + F.col("_b")).alias("question"), "node", "hop")


def visible(pre_status: Column, kind: Column, legacy: Column, audience: str, source_gate: str) -> Column:
    """Audience gate: professional views see everything; others never see unconfirmed edges, urgent ones excepted."""
    if audience in OPEN_AUDIENCES:
        return F.lit(True)
    unconfirmed = (pre_status == "needs_clinician_confirmation") & ~kind.isin(*rules.URGENT_TYPES)
    return ~unconfirmed & ~(legacy if source_gate == "exclude_legacy_pending" else F.lit(False))


def is_legacy(status: Column, markers=rules.LEGACY_MARKERS) -> Column:
    return T.has_any(F.lower(F.trim(F.coalesce(status, F.lit("")))), [m.lower() for m in markers])


PRE_REVIEW_CHECKS = (
    "required_fields", "source_registered", "source_complete", "level_supported", "older_adult_scope", "evidence_traceable", "freshness_recorded",
)


def pre_review(edges: DataFrame, sources: DataFrame) -> DataFrame:
    """Seven checks per edge, the reasons, and a three-way status. It never approves."""
    joined = edges.withColumn("evidence_source", F.substring_index("evidence", "#", 1)).join(sources, "evidence_source", "left")
    filled = F.lit(True)
    for c in ("source", "target", "type", "strength", "evidence", "evidence_level"):
        filled = filled & F.col(c).isNotNull()
    known = F.col("source_level").isNotNull()
    checks = dict(zip(PRE_REVIEW_CHECKS, (
        filled, known, known & F.col("retrieved").isNotNull() & (F.col("publisher") != ""), F.col("evidence_level").isin(*rules.EVIDENCE_LEVELS),
        F.coalesce(F.col("scope") == "older_adults", F.lit(False)), F.coalesce(F.contains("evidence", F.lit("#")), F.lit(False)), F.col("retrieved").isNotNull(),
    )))
    checked = joined.select("*", *[F.coalesce(v, F.lit(False)).alias(k) for k, v in checks.items()])
    clinician = F.col("type").isin(*rules.CLINICIAN_TYPES)
    reasons = F.array_compact(F.array(
        *[F.when(~F.col(k), f"not {k}") for k in ("required_fields", "source_registered", "source_complete", "level_supported", "evidence_traceable")],
        F.when(clinician, "clinician type"), F.when(F.col("type").isin(*rules.CAUSAL_RISK_TYPES), "risk direction"),
        F.when(F.col("evidence_level").isin(*rules.WEAK_LEVELS), "weak level"), F.when(~F.col("older_adult_scope"), "scope not older adults"),
    ))
    broken = ~F.col("required_fields") | ~F.col("source_registered") | ~F.col("source_complete") | ~F.col("evidence_traceable")
    status = F.when(broken, "reject_until_fixed").when(clinician | ~F.col("older_adult_scope"), "needs_clinician_confirmation").otherwise("eligible_for_demo_education")
    return checked.withColumn("reasons", reasons).withColumn("status", status).withColumn(
        "checks", F.map_from_arrays(F.array(*[F.lit(k) for k in PRE_REVIEW_CHECKS]), F.array(*[F.col(k) for k in PRE_REVIEW_CHECKS]))
    )


def explained(edges: DataFrame) -> DataFrame:
    """Readable path of an edge; the wording follows the causal status."""
    wording = F.when(F.col("causal_status") == "association", "statistical association").when(
        F.col("causal_status").isin("guidance", "causal"), "supported by guidance"
    ).otherwise("direction needs review")
    tail = lambda c: F.regexp_replace(c, "^[^:]*:", "")
    return edges.withColumn(
        "explanation", F.format_string("%s -[%s]-> %s: %s; evidence %s", tail("source"), F.col("type"), tail("target"), wording, F.col("evidence"))
    )
