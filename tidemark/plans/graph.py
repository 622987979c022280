"""Evidence-graph queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark import rules
from tidemark.operators import evidence as E, govern as G, graph as K
from tidemark.plans.registry import query
from tidemark.session import discard


def r(c, n=6):
    return F.round(c, n)


RAW = "(SELECT source, target, type, CASE WHEN strength='low' AND evidence LIKE '%#5' THEN 'weak' ELSE strength END AS strength, CASE WHEN evidence LIKE '%#7' THEN NULL ELSE evidence END AS evidence, CASE WHEN evidence LIKE 'src3#%' THEN 'blog' WHEN evidence LIKE 'src4#%' THEN 'systematic_review' END AS evidence_level FROM {edges} e0)"


def raw_edges(t):
    e = F.col("evidence")
    return t.edges.select(
        "source", "target", "type", F.when((F.col("strength") == "low") & e.like("%#5"), "weak").otherwise(F.col("strength")).alias("strength"),
        F.when(~e.like("%#7"), e).alias("evidence"), F.when(e.like("src3#%"), "blog").when(e.like("src4#%"), "systematic_review").alias("evidence_level"),
    )


PROBLEM = "CASE WHEN evidence IS NULL THEN 'missing_required' WHEN strength NOT IN ('high','moderate','low') THEN 'invalid_strength' WHEN type NOT IN ('increases_risk_of','protective_against') THEN 'unknown_relation_type' WHEN evidence_level='blog' THEN 'invalid_evidence_level' END"


@query("kg5_edge_validation", f"SELECT source, target, type, {PROBLEM} AS problem FROM {RAW} e")
def kg5(t):
    return raw_edges(t).select("source", "target", "type", K.relation_problem().alias("problem"))


@query("kg5_quarantine", f"SELECT problem, count(*) AS n FROM (SELECT {PROBLEM} AS problem FROM {RAW} e) x WHERE problem IS NOT NULL GROUP BY 1")
def kg5_bad(t):
    return raw_edges(t).select(K.relation_problem().alias("problem")).filter("problem is not null").groupBy("problem").agg(F.count(F.lit(1)).alias("n"))


SOURCES = "(SELECT source AS evidence_source, CASE WHEN count(*)%3=0 THEN 'systematic_review' WHEN count(*)%3=1 THEN 'observational_study' ELSE 'clinical_standard' END AS source_level, CASE WHEN source IN ('src0','src1','src2') THEN 'legacy entry' ELSE 'pending_medical_review' END AS source_review, CASE WHEN source<>'src9' THEN max(doc_id) END AS retrieved, CASE WHEN count(*)%2=0 THEN 'older_adults' ELSE 'adults' END AS scope, min(lang) AS publisher FROM documents WHERE source<>'src17' GROUP BY source)"


def sources(t):
    n = F.count(F.lit(1))
    return t.documents.filter("source <> 'src17'").groupBy(F.col("source").alias("evidence_source")).agg(
        F.when(n % 3 == 0, "systematic_review").when(n % 3 == 1, "observational_study").otherwise("clinical_standard").alias("source_level"),
        F.max("doc_id").alias("_last"), F.when(n % 2 == 0, "older_adults").otherwise("adults").alias("scope"), F.min("lang").alias("publisher"),
    ).select(
        "evidence_source", "source_level", F.when(F.col("evidence_source").isin("src0", "src1", "src2"), "legacy entry").otherwise("pending_medical_review").alias("source_review"),
        F.when(F.col("evidence_source") != "src9", F.col("_last")).alias("retrieved"), "scope", "publisher",
    )


ENRICHED = f"(SELECT e1.*, coalesce(source_level,'public_guidance') AS evidence_level, 'guidance' AS causal_status, coalesce(source_review,'pending_medical_review') AS review_status FROM {{edges}} e1 LEFT JOIN {SOURCES} s1 ON s1.evidence_source=split_part(evidence,'#',1))"


@query("kg6_edge_defaults", f"SELECT source, target, type, evidence_level, causal_status, review_status FROM {ENRICHED} x")
def kg6(t):
    return K.enrich(t.edges, sources(t)).select("source", "target", "type", "evidence_level", "causal_status", "review_status")


@query("kg7_entities", "SELECT entity, split_part(entity,':',1) AS kind, split_part(entity,':',2) AS name, count(DISTINCT evidence) AS n_evidence FROM (SELECT source AS entity, evidence FROM {edges} e UNION ALL SELECT target, evidence FROM {edges} e) u GROUP BY 1")
def kg7(t):
    return K.entities(t.edges)


@query("kg8_type_conflicts", "SELECT source, target, 'increases_risk_of|protective_against' AS types FROM {edges} e GROUP BY source, target HAVING bool_or(type='increases_risk_of') AND bool_or(type='protective_against')")
def kg8(t):
    return K.conflicts(t.edges)


@query("kg8_causal_conflicts", "SELECT source, target FROM {edges} e GROUP BY source, target HAVING bool_or(strength='high') AND bool_or(strength<>'high')")
def kg8_causal(t):
    status = F.when(F.col("strength") == "high", "causal").when(F.col("strength") == "moderate", "association").otherwise("unknown")
    return K.causal_conflicts(t.edges.withColumn("causal_status", status))


@query("kg9_review_queue", "SELECT type, strength, count(*) AS waiting, count(DISTINCT target) AS targets FROM {edges} e WHERE strength='high' OR type IN ('increases_risk_of') GROUP BY ALL")
def kg9(t):
    safety = rules.CLINICIAN_TYPES
    queue = t.edges.filter((F.col("strength") == "high") | F.col("type").isin(*safety))
    per_target = queue.groupBy("type", "strength", "target").agg(F.count(F.lit(1)).alias("n"))
    return per_target.groupBy("type", "strength").agg(F.sum("n").alias("waiting"), F.count(F.lit(1)).alias("targets"))


PRE = f"""(SELECT *, CASE WHEN NOT registered OR NOT complete THEN 'reject_until_fixed' WHEN clinician OR NOT scope_ok THEN 'needs_clinician_confirmation' ELSE 'eligible_for_demo_education' END AS status FROM (
   SELECT source, target, type, strength, evidence, s.evidence_source IS NOT NULL AS registered, s.retrieved IS NOT NULL AS complete, type='increases_risk_of' AS clinician, coalesce(scope='older_adults',false) AS scope_ok, coalesce(source_level,'public_guidance') IN ('public_guidance','observational_study') AS weak
   FROM {{edges}} e LEFT JOIN {SOURCES} s ON s.evidence_source=split_part(evidence,'#',1)) y)"""


def reviewed(t, known=None):
    known = sources(t) if known is None else known
    return K.pre_review(K.enrich(t.edges, known), known)


@query("kg10_rule_pre_review", f"SELECT source, target, type, status, (CASE WHEN registered THEN 0 ELSE 1 END)+(CASE WHEN complete THEN 0 ELSE 1 END)+(CASE WHEN clinician THEN 2 ELSE 0 END)+(CASE WHEN weak THEN 1 ELSE 0 END)+(CASE WHEN scope_ok THEN 0 ELSE 1 END) AS n_reasons FROM {PRE} p")
def kg10(t):
    return reviewed(t).select("source", "target", "type", "status", F.size("reasons").alias("n_reasons"))


POLICY = [
    ("increases_risk_of", "risk background, tied to the participant's own records", "certain causation", True),
    ("protective_against", "possible benefit", "guaranteed prevention", False),
    ("mentions", "mentioned together", "any causal wording", False),
]
POLICY_SQL = "(VALUES " + ",".join(f"('{a}','{b}','{c}',{str(d).lower()})" for a, b, c, d in [(x, y.replace("'", "''"), z, w) for x, y, z, w in POLICY]) + ") AS po(type,allowed,forbidden,confirm)"


@query("kg11_wording_policy", f"SELECT source, target, type, allowed, forbidden, confirm FROM {{edges}} e JOIN {POLICY_SQL} USING(type)")
def kg11(t):
    policy = t.spark.createDataFrame(POLICY, "type string, allowed string, forbidden string, confirm boolean")
    return t.edges.join(F.broadcast(policy), "type").select("source", "target", "type", "allowed", "forbidden", "confirm")


def bfs_sql(seeds):
    return f"""WITH e AS (SELECT source, target FROM {{edges}} x), adj AS (SELECT source AS node, target AS nxt FROM e UNION SELECT target, source FROM e), s AS ({seeds}),
      h1 AS (SELECT DISTINCT question, nxt AS node FROM s JOIN adj USING(node)), h2 AS (SELECT DISTINCT question, nxt AS node FROM h1 JOIN adj USING(node)),
      hops AS (SELECT question, node, min(hop) AS hop FROM (SELECT question, node, 0 AS hop FROM s UNION ALL SELECT question, node, 1 FROM h1 UNION ALL SELECT question, node, 2 FROM h2) u GROUP BY ALL)"""


NATION_SEEDS = "SELECT CAST(s_nationkey AS BIGINT) AS question, 'supplier:'||s_suppkey AS node FROM supplier"
REGION_SEEDS = "SELECT CAST(n_regionkey AS BIGINT) AS question, 'supplier:'||s_suppkey AS node FROM supplier JOIN nation ON n_nationkey=s_nationkey"


def nation_seeds(t):
    return t.supplier.select(F.col("s_nationkey").cast("long").alias("question"), F.concat(F.lit("supplier:"), F.col("s_suppkey").cast("string")).alias("node"))


def region_seeds(t):
    nations = t.nation.select(F.col("n_nationkey").alias("s_nationkey"), F.col("n_regionkey").cast("long").alias("question"))
    return t.supplier.join(nations, "s_nationkey").select("question", F.concat(F.lit("supplier:"), F.col("s_suppkey").cast("string")).alias("node"))


@query("kg13_bounded_expansion", bfs_sql(NATION_SEEDS) + " SELECT question, node, hop FROM hops")
def kg13(t):
    edges = t.stored(t.edges, "edges")
    return K.unpack(K.reach(edges, nation_seeds(t))).select("question", "node", "hop")


TOKENS_SQL = "list_distinct(regexp_extract_all(lower(source||' '||target||' '||evidence),'[a-z]{3,}'))"
RANKED = bfs_sql(REGION_SEEDS) + f""", ed AS (SELECT * FROM {{edges}} y), cf AS (SELECT source, target FROM ed GROUP BY ALL HAVING bool_or(type='increases_risk_of') AND bool_or(type='protective_against')),
   ctx AS (SELECT 'part:'||p_partkey AS node FROM part WHERE p_size=1),
   near AS (SELECT question, source, target, type, min(hop) AS hop FROM (SELECT question, source, target, type, hop FROM ed JOIN hops ON node=source UNION ALL SELECT question, source, target, type, hop FROM ed JOIN hops ON node=target) u GROUP BY ALL),
   sc AS (SELECT n.question, n.source, n.target, n.type, n.hop, ed.strength, round(CAST(CASE n.type WHEN 'increases_risk_of' THEN 4 WHEN 'mentions' THEN 0 ELSE 1 END + CASE WHEN n.hop=0 THEN 2 ELSE 0 END + CASE WHEN n.target IN (SELECT node FROM ctx) THEN 3 ELSE 0 END
      - CASE WHEN cf.source IS NOT NULL THEN 5 ELSE 0 END + 0.2*len(list_filter({TOKENS_SQL.replace('source', 'n.source').replace('target', 'n.target').replace('evidence', 'ed.evidence')}, lambda x: list_contains(['part','src'],x))) AS DOUBLE),4) AS score
      FROM near n JOIN ed USING(source,target,type) LEFT JOIN cf ON cf.source=n.source AND cf.target=n.target)
   SELECT question, source, target, type, hop, score, position FROM (SELECT *, row_number() OVER (PARTITION BY question ORDER BY score DESC, strength='high' DESC, type<>'mentions' DESC, source, target, type) AS position FROM sc) z WHERE position<=12"""


def part_context(t):
    return t.part.filter("p_size = 1").select(F.concat(F.lit("part:"), F.col("p_partkey").cast("string")).alias("node"))


@query("kg14_edge_priority", RANKED)
def kg14(t):
    """Plain ranking without gates; mentions compete with explicit edges."""
    edges = t.stored(t.edges, "edges")
    questions = t.region.select(F.col("r_regionkey").cast("long").alias("question"), F.array(F.lit("part"), F.lit("src")).alias("question_tokens"))
    touched = E.touched_edges(edges, K.planes(edges, region_seeds(t)), questions, part_context(t), K.conflicts(edges))
    discard(edges)  # touched edges are read from halves
    return E.best_edges(touched, hide_mentions=False).select("question", "source", "target", "type", "hop", "score", "position")


ASKED = """(SELECT CAST(n_nationkey AS BIGINT) AS question, CASE WHEN n_nationkey%4=1 THEN 'doctor' WHEN n_nationkey%4<>3 THEN 'elderly' END AS audience,
   CASE WHEN n_nationkey%2=0 THEN 'exclude_legacy_pending' END AS source_gate, CASE WHEN n_nationkey%3=0 THEN ['part','src'] WHEN n_nationkey%3=1 THEN ['supplier','src','part'] ELSE [] END AS words FROM nation)"""
GATED = f"""(WITH {bfs_sql(NATION_SEEDS)[5:]}, ed AS (SELECT x.*, status, split_part(evidence,'#',1) IN ('src0','src1','src2') AS legacy FROM {PRE} x), aq AS (SELECT * FROM {ASKED} a0),
   cf AS (SELECT source, target FROM ed GROUP BY ALL HAVING bool_or(type='increases_risk_of') AND bool_or(type='protective_against')),
   ctx AS (SELECT 'part:'||p_partkey AS node FROM part WHERE p_size=1),
   near AS (SELECT question, source, target, type, min(hop) AS hop FROM (SELECT question, source, target, type, hop FROM ed JOIN hops ON node=source UNION ALL SELECT question, source, target, type, hop FROM ed JOIN hops ON node=target) u GROUP BY ALL)
   SELECT n.question, n.source, n.target, n.type, ed.strength, n.hop, legacy, cf.source IS NOT NULL AS conflict, n.target IN (SELECT node FROM ctx) AS context_match,
      coalesce(audience='doctor',false) OR NOT (status='needs_clinician_confirmation' OR (legacy AND coalesce(source_gate='exclude_legacy_pending',false))) AS shown,
      round(CAST(CASE n.type WHEN 'increases_risk_of' THEN 4 WHEN 'mentions' THEN 0 ELSE 1 END + CASE WHEN n.hop=0 THEN 2 ELSE 0 END + CASE WHEN n.target IN (SELECT node FROM ctx) THEN 3 ELSE 0 END - CASE WHEN cf.source IS NOT NULL THEN 5 ELSE 0 END
        + 0.2*len(list_intersect({TOKENS_SQL.replace('source', 'n.source').replace('target', 'n.target').replace('evidence', 'ed.evidence')}, words)) AS DOUBLE),4) AS score
   FROM near n JOIN ed USING(source,target,type) JOIN aq ON aq.question=n.question LEFT JOIN cf ON cf.source=n.source AND cf.target=n.target)"""


def gated(t):
    """Touched edges of one question per nation: readers of four kinds, three word sets."""
    key = F.col("n_nationkey")
    none = F.array().cast("array<string>")
    questions = t.nation.select(
        key.cast("long").alias("question"), F.when(key % 4 == 1, "doctor").when(key % 4 != 3, "elderly").alias("audience"),
        F.when(key % 2 == 0, "exclude_legacy_pending").alias("source_gate"),
        F.when(key % 3 == 0, F.array(F.lit("part"), F.lit("src"))).when(key % 3 == 1, F.array(F.lit("supplier"), F.lit("src"), F.lit("part"))).otherwise(none).alias("question_tokens"),
    )
    edges = t.stored(reviewed(t, t.stored(sources(t), "sources")).select(
        *E.EDGE, (F.col("status") == "needs_clinician_confirmation").alias("unsure"), K.is_legacy(F.col("review_status")).alias("legacy"),
    ).withColumn("unconfirmed", F.col("unsure") & ~F.col("type").isin(*rules.URGENT_TYPES)), "edges")
    touched = E.touched_edges(edges, K.planes(edges, nation_seeds(t)), questions, part_context(t), K.conflicts(edges))
    discard(edges)  # touched edges are read from halves
    return touched, questions


@query(
    "kg14_graph_context",
    f"""SELECT question, source, target, type, hop, score, context_match, conflict, position FROM (SELECT *, row_number() OVER (PARTITION BY question ORDER BY score DESC, strength='high' DESC, source, target, type) AS position
        FROM (SELECT *, bool_or(type<>'mentions') OVER (PARTITION BY question) AS explicit FROM {GATED} g WHERE shown) h WHERE type<>'mentions' OR NOT explicit) z WHERE position<=12""",
)
def kg14_context(t):
    """Per question: gates, mentions hidden where explicit edges are visible, the best twelve."""
    return E.best_edges(gated(t)[0]).select("question", "source", "target", "type", "hop", "score", "context_match", "conflict", "position")


@query(
    "kg15_question_gates",
    f"""SELECT question, count(*) FILTER (shown) AS shown, count(*) FILTER (shown=false) AS blocked, count(*) FILTER (shown AND type<>'mentions') AS explicit, count(*) FILTER (shown AND legacy) AS legacy_shown
        FROM {ASKED} a LEFT JOIN {GATED} g USING(question) GROUP BY question""",
)
def kg15_questions(t):
    """Per question: edges its reader sees, edges its gates block."""
    touched, questions = gated(t)
    return E.edge_counts(touched, questions)


GATE_KEEP = "NOT (status='needs_clinician_confirmation')"


@query(
    "kg15_audience_gates",
    f"""SELECT evidence_source, count(*) FILTER ({GATE_KEEP}) AS shown, count(*) FILTER (NOT ({GATE_KEEP})) AS blocked, count(*) FILTER ({GATE_KEEP} AND NOT legacy) AS shown_strict, count(*) AS shown_audit, count(*) FILTER (legacy) AS legacy_edges
        FROM (SELECT split_part(evidence,'#',1) AS evidence_source, status, split_part(evidence,'#',1) IN ('src0','src1','src2') AS legacy FROM {PRE} p) x GROUP BY 1""",
)
def kg15(t):
    edges = reviewed(t)
    status, kind, legacy = F.col("status"), F.col("type"), K.is_legacy(F.col("review_status"))
    def seen(audience, gate="flag_legacy_pending"):
        return K.visible(status, kind, legacy, audience, gate)

    return edges.groupBy("evidence_source").agg(
        F.count_if(seen("elderly")).alias("shown"), F.count_if(~seen("elderly")).alias("blocked"),
        F.count_if(seen("elderly", "exclude_legacy_pending")).alias("shown_strict"), F.count_if(seen("audit")).alias("shown_audit"), F.count_if(legacy).alias("legacy_edges"),
    )


@query("kg18_path_explanations", f"SELECT source, target, type, split_part(source,':',2)||' -['||type||']-> '||split_part(target,':',2)||': supported by guidance; evidence '||evidence AS explanation FROM {ENRICHED} x")
def kg18(t):
    return K.explained(K.enrich(t.edges, sources(t))).select("source", "target", "type", "explanation")


@query("kg24_provenance_audit", f"SELECT 'edge_without_source' AS violation, count(*) AS n FROM (SELECT DISTINCT split_part(evidence,'#',1) AS s FROM {{edges}} e) x WHERE s NOT IN (SELECT evidence_source FROM {SOURCES} a) UNION ALL SELECT 'source_without_edge', count(*) FROM {SOURCES} b WHERE evidence_source NOT IN (SELECT split_part(evidence,'#',1) FROM {{edges}} e2) UNION ALL SELECT 'source_without_retrieval', count(*) FROM {SOURCES} c WHERE retrieved IS NULL UNION ALL SELECT 'unknown_endpoint', count(*) FROM (SELECT DISTINCT target FROM {{edges}} e3 WHERE CAST(split_part(target,':',2) AS BIGINT) NOT IN (SELECT p_partkey FROM part)) d")
def kg24(t):
    edges = t.edges.select("target", F.substring_index("evidence", "#", 1).alias("evidence_source"))
    known = sources(t)
    nodes = t.part.select(F.concat(F.lit("part:"), F.col("p_partkey").cast("string")).alias("node"))
    checks = {
        "edge_without_source": G.missing_references(edges, "evidence_source", known, "evidence_source"),
        "source_without_edge": G.missing_references(known, "evidence_source", edges, "evidence_source"),
        "source_without_retrieval": known.filter("retrieved is null"),
        "unknown_endpoint": G.missing_references(edges, "target", nodes, "node"),
    }
    out = None
    for name, rows in checks.items():
        one = rows.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("violation"), "n")
        out = one if out is None else out.unionByName(one)
    return out


@query("ag41_community_table", "SELECT source AS topic, count(DISTINCT target) AS members, count(DISTINCT evidence) AS chunks, count(*) AS edges FROM {edges} e GROUP BY 1")
def ag41(t):
    """Members and evidence are made distinct per topic before they are counted, so a hub topic is spread over tasks."""
    pairs = t.edges.groupBy(F.col("source").alias("topic"), "target").agg(F.count(F.lit(1)).alias("n"))
    members = pairs.groupBy("topic").agg(F.count(F.lit(1)).alias("members"), F.sum("n").alias("edges"))
    evidence = t.edges.select(F.col("source").alias("topic"), "evidence").distinct().groupBy("topic").agg(F.count(F.lit(1)).alias("chunks"))
    return members.join(evidence, "topic").select("topic", "members", "chunks", "edges")
