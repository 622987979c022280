"""Panel cohort queries: wave pairs, incident outcomes, splits and set checks."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import govern as G, panel as P, skew
from tidemark.plans.registry import query


def r(c, n=6):
    return F.round(c, n)


@query(
    "jn1_wave_pair",
    "SELECT a.id, a.n_orders AS n_orders_x, a.sum_price AS sum_price_x, a.cond AS cond_x, b.n_orders AS n_orders_y, b.sum_price AS sum_price_y, b.cond AS cond_y FROM {panel} a JOIN {panel} b ON a.id=b.id AND a.wave=1 AND b.wave=2",
)
def jn1(t):
    return P.wave_pair(t.panel.select("id", "wave", "n_orders", "sum_price", "cond"), 1, 2)


@query("jn1_first_row_per_id", "SELECT o_custkey AS id, arg_min(o_orderkey,(o_orderdate,o_orderkey)) AS o_orderkey FROM orders GROUP BY 1")
def jn1_first(t):
    rows = t.orders.select(F.col("o_custkey").alias("id"), "o_orderdate", "o_orderkey")
    return P.one_row_per_id(rows, "id", ["o_orderdate", "o_orderkey"]).select("id", "o_orderkey")


INCIDENT_SQL = "(SELECT a.id, a.wave, b.cond AS y, a.n_orders, a.sum_price, a.max_price, a.share_f, a.acctbal, a.province FROM {panel} a JOIN {panel} b ON a.id=b.id AND b.wave=a.wave+1 WHERE a.cond=0 AND b.cond IN (0,1))"


def incidents(t):
    keep = ["n_orders", "sum_price", "max_price", "share_f", "acctbal", "province"]
    return P.incident(P.adjacent_waves(t.panel, keep))


@query("jn2_incident_outcome", f"SELECT id, wave, y, n_orders, sum_price FROM {INCIDENT_SQL} i")
def jn2(t):
    return incidents(t).select("id", "wave", "y", "n_orders", "sum_price")


@query("jn3_participant_exclusion", f"SELECT id, wave, y FROM {INCIDENT_SQL} i WHERE wave<4 AND id NOT IN (SELECT id FROM {INCIDENT_SQL} k WHERE wave=4)")
def jn3(t):
    rows = incidents(t).select("id", "wave", "y")
    return P.drop_ids(rows.filter("wave < 4"), rows.filter("wave = 4"))


@query("jn4_split_membership", "SELECT id, wave, n_orders FROM {panel} p WHERE {fraction:id} < 0.7")
def jn4(t):
    members = t.customer.select(F.col("c_custkey").alias("id")).filter(P.stable_split(F.col("id")) == "train")
    return t.panel.select("id", "wave", "n_orders").join(members, "id", "left_semi")


@query("set1_transitions", f"SELECT wave AS from_wave, wave+1 AS to_wave, count(*) AS n, sum(y)::BIGINT AS positives FROM {INCIDENT_SQL} i GROUP BY wave")
def set1(t):
    return incidents(t).groupBy(F.col("wave").alias("from_wave")).agg(
        (F.first("wave") + 1).alias("to_wave"), F.count(F.lit(1)).alias("n"), F.sum("y").alias("positives")
    )


OVERLAP_SQL = "(SELECT l_suppkey AS id, CASE WHEN l_linenumber<=4 THEN 'train' WHEN l_linenumber<=6 THEN 'validation' ELSE 'test' END AS part FROM lineitem)"


@query(
    "set2_split_overlap",
    f"SELECT count(*) FILTER (k>1) AS ids_in_several, coalesce(sum(CASE WHEN k>1 THEN k*(k-1)/2 END),0)::BIGINT AS pair_count FROM (SELECT id, count(DISTINCT part) AS k FROM {OVERLAP_SQL} o GROUP BY id) x",
)
def set2(t):
    line = F.col("l_linenumber")
    members = t.lineitem.select(F.col("l_suppkey").alias("id"), F.when(line <= 4, "train").when(line <= 6, "validation").otherwise("test").alias("part"))
    return P.split_overlap(members.distinct())


@query("set2_split_intersection", f"SELECT DISTINCT id FROM {OVERLAP_SQL} a WHERE part='train' INTERSECT SELECT id FROM {OVERLAP_SQL} b WHERE part='test'")
def set2_ids(t):
    ids = t.lineitem.select(F.col("l_suppkey").alias("id"), "l_linenumber")
    return ids.filter("l_linenumber <= 4").select("id").intersect(ids.filter("l_linenumber > 6").select("id"))


@query("set3_set_difference", "SELECT doc_id FROM documents EXCEPT SELECT doc_id FROM labels")
def set3(t):
    return G.missing_references(t.documents, "doc_id", t.labels, "doc_id").withColumnRenamed("reference", "doc_id")


@query("set3_unexpected_values", "SELECT 'o_orderstatus' AS column_name, o_orderstatus AS value, count(*) AS n FROM orders WHERE o_orderstatus NOT IN ('O','F') GROUP BY 2 UNION ALL SELECT 'o_orderpriority', o_orderpriority, count(*) FROM orders WHERE o_orderpriority NOT IN ('1-URGENT','2-HIGH') GROUP BY 2")
def set3_values(t):
    return G.unexpected_values(t.orders, {"o_orderstatus": ("O", "F"), "o_orderpriority": ("1-URGENT", "2-HIGH")})


@query("set3_column_report", None)
def set3_columns(t):
    return G.column_report(t.customer.columns, {"c_custkey", "c_age"}, {"c_name", "phone"}, t.spark)


@query(
    "set5_first_seen_distinct",
    """SELECT doc_id, string_agg(word, ' ' ORDER BY first) AS words FROM (SELECT doc_id, word, min(no) AS first FROM
        (SELECT doc_id, w[no] AS word, no FROM (SELECT doc_id, string_split(replace(text, chr(10), ' '), ' ') AS w, unnest(range(1, len(w) + 1)) AS no FROM documents) x) y
        GROUP BY ALL) z GROUP BY doc_id""",
)
def set5(t):
    words = F.split(F.translate("text", "\n", " "), " ", -1)
    return t.documents.select("doc_id", F.array_join(F.array_distinct(words), " ").alias("words"))


@query("ag12_missing_rate", "SELECT unnest(['price','urgent','late']) AS column_name, unnest([a,b,c]) AS missing_rate FROM (SELECT round(avg(CASE WHEN o_totalprice>100000 THEN 0.0 ELSE 1.0 END),6) AS a, round(avg(CASE WHEN o_orderpriority='1-URGENT' THEN 0.0 ELSE 1.0 END),6) AS b, round(avg(CASE WHEN year(o_orderdate)>1998 THEN 0.0 ELSE 1.0 END),6) AS c FROM orders) x")
def ag12(t):
    wide = t.orders.select(
        F.when(F.col("o_totalprice") > 100000, 1).alias("price"), F.when(F.col("o_orderpriority") == "1-URGENT", 1).alias("urgent"),
        F.when(F.year("o_orderdate") > 1998, 1).alias("late"),
    )
    return P.missing_rates(wide, ["price", "urgent", "late"]).withColumn("missing_rate", r("missing_rate"))


@query("ag13_class_balance", f"SELECT count(*) AS n, sum(y)::BIGINT AS positives, round(avg(y),6) AS rate FROM {INCIDENT_SQL} i")
def ag13(t):
    return incidents(t).agg(F.count(F.lit(1)).alias("n"), F.sum("y").alias("positives"), r(F.avg("y")).alias("rate"))


@query("ml1_stable_hash_split", "SELECT id, round({fraction:id},9) AS fraction, CASE WHEN {fraction:id}<0.7 THEN 'train' WHEN {fraction:id}<0.85 THEN 'validation' ELSE 'test' END AS part FROM {profile} p")
def ml1(t):
    return t.profile.select("id", r(P.stable_fraction(F.col("id")), 9).alias("fraction"), P.stable_split(F.col("id")).alias("part"))


@query("ml2_external_site_holdout", "SELECT site_id, n_ids FROM (SELECT site_id, count(DISTINCT id) AS n_ids, count(*) OVER () AS c FROM {profile} p GROUP BY site_id HAVING count(DISTINCT id)>=50) x WHERE c>=2 ORDER BY n_ids, site_id LIMIT 1")
def ml2(t):
    return P.holdout_group(t.profile, "site_id", "id", 50, smallest=True)


@query("ml3_geographic_holdout", "SELECT region, n_ids FROM (SELECT n_regionkey AS region, count(DISTINCT c_custkey) AS n_ids FROM customer JOIN nation ON n_nationkey=c_nationkey GROUP BY 1) x WHERE n_ids>=greatest(200, 0.02*(SELECT count(*) FROM customer)) ORDER BY n_ids DESC, region LIMIT 1")
def ml3(t):
    nations = t.nation.select(F.col("n_nationkey").alias("c_nationkey"), F.col("n_regionkey").alias("region"))
    return P.holdout_group(t.customer.join(nations, "c_nationkey"), "region", "c_custkey", 200, smallest=False, share=0.02)


@query("ml4_stratified_split", "SELECT id, y, CASE WHEN rn<=round(n*0.8) THEN 'train' ELSE 'test' END AS part FROM (SELECT id, y, count(*) OVER (PARTITION BY y) AS n, row_number() OVER (PARTITION BY y ORDER BY {fraction:id}, id) AS rn FROM {pred_risk} r) x")
def ml4(t):
    return P.stratified_split(t.pred_risk.select("id", "y"), "y", "id").select("id", "y", "part")


@query("ml5_group_folds", "SELECT least(floor({fraction:'fold-'||participant_id}*5),4)::INT AS fold, count(*) AS n, count(DISTINCT participant_id) AS ids, sum(y)::BIGINT AS positives FROM {pred_risk} r GROUP BY 1")
def ml5(t):
    """Ids are counted after one row per (fold, id) is built, so the few folds are never collected."""
    per_id = t.pred_risk.groupBy("participant_id").agg(F.count(F.lit(1)).alias("n"), F.sum("y").alias("pos"))
    return per_id.groupBy(P.fold_of(F.col("participant_id")).alias("fold")).agg(
        F.sum("n").alias("n"), F.count(F.lit(1)).alias("ids"), F.sum("pos").alias("positives")
    )


@query("ml18_range_label", "SELECT o_orderkey, CASE WHEN o_totalprice IS NULL THEN NULL WHEN o_totalprice<100000 OR o_totalprice>300000 THEN 1 ELSE 0 END AS y FROM orders")
def ml18(t):
    outside = (F.col("o_totalprice") < 100000) | (F.col("o_totalprice") > 300000)
    return t.orders.select("o_orderkey", F.when(F.col("o_totalprice").isNotNull(), outside.cast("int")).alias("y"))


@query("ml19_leakage_checks", "SELECT 'duplicate_ids' AS problem, count(*) AS n FROM (SELECT id, wave FROM {panel} p GROUP BY ALL HAVING count(*)>1) x UNION ALL SELECT 'label_outside_domain', count(*) FROM {panel} p WHERE cond NOT IN (0,1) UNION ALL SELECT 'forbidden_feature', 1")
def ml19(t):
    panel = t.panel
    forbidden = {"share_f", "hibpe", "diabe", "hearte", "stroke"} & set(panel.columns)
    counts = G.duplicate_keys(panel, ["id", "wave"]).agg(F.count(F.lit(1)).alias("n")).select(F.lit("duplicate_ids").alias("problem"), "n")
    domain = panel.agg(F.count_if(~F.col("cond").isin(0, 1)).alias("n")).select(F.lit("label_outside_domain").alias("problem"), "n")
    names = panel.sparkSession.createDataFrame([("forbidden_feature", len(forbidden))], "problem string, n long")
    return counts.unionByName(domain).unionByName(names)


@query("jn17_before_after", f"SELECT a.id, a.wave, list_sort(list_filter([CASE WHEN a.n_orders<>b.n_orders THEN 'n_orders' END, CASE WHEN a.cond<>b.cond THEN 'cond' END, CASE WHEN a.share_f<>b.share_f THEN 'share_f' END], lambda x: x IS NOT NULL)).array_to_string(',') AS changed FROM {{panel}} a JOIN {{panel}} b ON a.id=b.id AND b.wave=a.wave+1")
def jn17(t):
    fields = ["n_orders", "cond", "share_f"]
    base = t.panel.select("id", "wave", *fields)
    after = base.select("id", (F.col("wave") - 1).alias("wave"), *[F.col(f).alias(f"b_{f}") for f in fields])
    changed = F.array_sort(F.array_compact(F.array(*[F.when(~F.col(f).eqNullSafe(F.col(f"b_{f}")), f) for f in fields])))
    return base.join(after, ["id", "wave"]).select("id", "wave", F.array_join(changed, ",").alias("changed"))


@query("ag43_segment_variation", "SELECT segment, count(*) AS n, min(p) AS low, max(p) AS high, round(avg(p),6) AS mean, round(max(p)-min(p),6) AS spread FROM {pred_risk} r GROUP BY segment")
def ag43(t):
    return t.pred_risk.groupBy("segment").agg(
        F.count(F.lit(1)).alias("n"), F.min("p").alias("low"), F.max("p").alias("high"), r(F.avg("p")).alias("mean"), r(F.max("p") - F.min("p")).alias("spread")
    )


@query("ag47_distinct_output_ratio", "SELECT segment, round(count(DISTINCT band)/count(*),6) AS ratio, count(DISTINCT participant_id) AS cases FROM (SELECT segment, participant_id, round(p,2) AS band FROM {pred_risk} r) x GROUP BY segment")
def ag47(t):
    rows = t.pred_risk.select("segment", "participant_id", F.round("p", 2).alias("band"))
    cases = rows.groupBy("segment", "participant_id").agg(F.count(F.lit(1)).alias("n")).groupBy("segment").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("cases"))
    bands = rows.select("segment", "band").distinct().groupBy("segment").agg(F.count(F.lit(1)).alias("k"))
    return cases.join(bands, "segment").select("segment", r(F.col("k") / F.col("n")).alias("ratio"), "cases")


@query("top4_best_candidate", "SELECT segment, arg_min(name,(loss,name)) AS best, round(min(loss),6) AS loss FROM (SELECT segment, 'wide' AS name, avg((p-y)*(p-y)) AS loss FROM {pred_risk} r GROUP BY segment UNION ALL SELECT segment, 'steep', avg((p_alt-y)*(p_alt-y)) FROM {pred_risk} r2 GROUP BY segment) c GROUP BY segment")
def top4(t):
    y = F.col("y")
    losses = t.pred_risk.groupBy("segment").agg(F.avg((F.col("p") - y) * (F.col("p") - y)).alias("wide"), F.avg((F.col("p_alt") - y) * (F.col("p_alt") - y)).alias("steep"))
    best = F.array_min(F.array(*[F.struct(F.col(n).alias("loss"), F.lit(n).alias("name")) for n in ("wide", "steep")]))
    return losses.select("segment", best["name"].alias("best"), r(best["loss"]).alias("loss"))
