"""Queries: condition combinations, association rules, scenario scores."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions import evidence as ev
from ..functions.values import alnum_key, condition_key, feature_key
from ..operators import fusion, quality, rules, scenarios, schema, sequences
from ..operators.models import top_features
from ..session import cut, scratch_path
from ..sources import files
from .registry import query, r6, round_doubles, table
from .tables import (
    CONDITION_SCORES,
    CONDITIONS,
    FACTS,
    IMPORTANCES,
    SCENARIOS,
    SCORED,
    facts,
    importance_set,
    scenario_set,
    scored_set,
)

_RULE_COLUMNS = [*CONDITIONS, "severity"]
_KEY = ["l_orderkey", "l_linenumber"]
_ITEMS = ", ".join(f"'{c}_' || {c}" for c in _RULE_COLUMNS)

TRANSACTIONS = f"""{FACTS},
tx AS (SELECT list_sort([{_ITEMS}]) AS items, count(*) AS w FROM facts GROUP BY 1)"""

# all subsets of the seven items by position in the sorted list
_SUBSETS = """
subsets AS (SELECT unnest(range(1, 128)) AS m),
counted AS (
  SELECT s AS items, sum(w) AS n FROM (
    SELECT w, list_filter(items, lambda x, i: (m >> (i - 1)) & 1 = 1) AS s FROM tx, subsets)
  GROUP BY 1),
itemsets AS (
  SELECT items, CAST(n AS BIGINT) AS n, n::DOUBLE / (SELECT sum(w) FROM tx)::DOUBLE AS support FROM counted
  WHERE n::DOUBLE / (SELECT sum(w) FROM tx)::DOUBLE >= {support})"""


def _itemsets(support: float) -> str:
    return f"{TRANSACTIONS}, {_SUBSETS.format(support=support)}"


def _rules(support: float, confidence: float) -> str:
    return f"""{_itemsets(support)},
splits AS (
  SELECT support, list_filter(items, lambda x, i: (m >> (i - 1)) & 1 = 1) AS a, list_filter(items, lambda x, i: (m >> (i - 1)) & 1 = 0) AS c
  FROM itemsets, (SELECT unnest(range(1, 127)) AS m) WHERE len(items) >= 2 AND m <= (1 << len(items)) - 2),
rules AS (
  SELECT array_to_string(a, ' & ') AS antecedent, array_to_string(c, ' & ') AS consequent, a AS alist, c AS clist, s.support,
    x.support AS sa, y.support AS sc, s.support / x.support AS confidence, s.support / x.support / y.support AS lift,
    s.support - x.support * y.support AS leverage,
    CASE WHEN s.support / x.support < 1 THEN (1 - y.support) / (1 - s.support / x.support) END AS conviction
  FROM splits s JOIN itemsets x ON x.items = a JOIN itemsets y ON y.items = c WHERE s.support / x.support >= {confidence})"""


def _joined(df: DataFrame) -> DataFrame:
    """Rule sides as text, an infinite conviction as null.

    Leverages are multiples of 1 / rows**2 and often end in a 5 after six digits; the small shift lets
    both engines round them the same way.
    """
    return round_doubles(
        df.withColumns(
            {
                "leverage": F.col("leverage") + 1e-9,
                "antecedent": F.array_join("antecedent", " & "),
                "consequent": F.array_join("consequent", " & "),
                "conviction": F.when(F.col("confidence") < 1, F.col("conviction")),
            }
        )
    )


@query(f"""
WITH {FACTS}
SELECT l_orderkey, l_linenumber, array_to_string(list_sort(list_filter([{', '.join(f"CASE WHEN l_orderkey % 10 <> {i} AND {c} <> 'MACHINERY' THEN '{c}_' || {c} END" for i, c in enumerate(CONDITIONS))}],
       lambda x: x IS NOT NULL)), ' & ') AS items FROM facts
""")
def transactions(spark, sf) -> DataFrame:
    """Rows as item lists; null and empty conditions are skipped."""
    gaps = facts(spark, sf).select(
        *_KEY,
        *[
            F.when((F.col("l_orderkey") % 10 != i), F.when(F.col(c) == "MACHINERY", "").otherwise(F.col(c))).alias(c)
            for i, c in enumerate(CONDITIONS)
        ],
    )
    tx = rules.transactions(gaps, _KEY, CONDITIONS)
    return tx.select(*_KEY, F.array_join("items", " & ").alias("items"))


def _facts_tx(spark, sf) -> DataFrame:
    return rules.weighted_transactions(facts(spark, sf), _RULE_COLUMNS)


@query(f"WITH {_itemsets(0.05)} SELECT array_to_string(items, ' & ') AS items, round(support, 6) AS support, n FROM itemsets")
def frequent_itemsets(spark, sf) -> DataFrame:
    found = rules.frequent_itemsets(_facts_tx(spark, sf), 0.05)
    return round_doubles(found.withColumn("items", F.array_join("items", " & ")))


@query(f"""
WITH {TRANSACTIONS},
subsets AS (SELECT unnest(range(1, 128)) AS m),
counted AS (SELECT s AS items, sum(w) AS n FROM (
    SELECT w, list_filter(items, lambda x, i: (m >> (i - 1)) & 1 = 1) AS s FROM tx, subsets) GROUP BY 1)
SELECT len(items) AS size, count(*) AS itemsets, CAST(sum(n) AS BIGINT) AS n FROM counted
WHERE n::DOUBLE / (SELECT sum(w) FROM tx)::DOUBLE >= 0.01 GROUP BY 1
""")
def itemsets_of_any_length(spark, sf) -> DataFrame:
    """No length limit: levels grow until no set is frequent."""
    found = rules.frequent_itemsets(_facts_tx(spark, sf), 0.01)
    return found.groupBy(F.size("items").cast("bigint").alias("size")).agg(
        F.count(F.lit(1)).alias("itemsets"), F.sum("n").alias("n")
    )


@query(f"""
WITH {_rules(0.02, 0.5)}
SELECT antecedent, consequent, round(sa, 6) AS antecedent_support, round(sc, 6) AS consequent_support, round(support, 6) AS support,
  round(confidence, 6) AS confidence, round(lift, 6) AS lift, round(leverage + 1e-9, 6) AS leverage, round(conviction, 6) AS conviction FROM rules
""")
def association_rules(spark, sf) -> DataFrame:
    itemsets = rules.frequent_itemsets(_facts_tx(spark, sf), 0.02)
    return _joined(rules.association_rules(itemsets, 0.5))


@query(f"""
WITH {_rules(0.05, 0.6)}
SELECT count(*) AS total_rules, round(avg(confidence), 6) AS avg_confidence, round(avg(support), 6) AS avg_support, round(avg(lift), 6) AS avg_lift,
  count(*) FILTER (confidence > 0.8) AS high_confidence_rules, count(*) FILTER (lift > 2.0) AS high_lift_rules FROM rules
""")
def rule_summary(spark, sf) -> DataFrame:
    mined = rules.mine_patterns(facts(spark, sf), _RULE_COLUMNS)
    return round_doubles(mined.summary)


@query(f"""
WITH {_rules(0.05, 0.6)}
SELECT antecedent, consequent, round(support, 6) AS support, round(confidence, 6) AS confidence, round(lift, 6) AS lift
FROM rules WHERE lift >= 1.0 ORDER BY confidence DESC, alist, clist LIMIT 20
""")
def top_rules(spark, sf) -> DataFrame:
    """The one-call mining with the configured lift floor."""
    mined = rules.mine_patterns(facts(spark, sf), _RULE_COLUMNS, min_lift=1.0)
    return _joined(mined.top).select("antecedent", "consequent", "support", "confidence", "lift")


@query(f"""
WITH {SCENARIOS}
SELECT state, accident_type, evidence, round(support_rate, 6) AS support_rate, round(prob, 6) AS prob, round(lift, 6) AS lift, round(uplift, 6) AS uplift
FROM scenarios
""")
def risk_combinations(spark, sf) -> DataFrame:
    combos = rules.risk_combinations(
        facts(spark, sf).withColumnRenamed("r_name", "state"), CONDITIONS, "severity", by=["state"]
    )
    return round_doubles(combos.withColumn("evidence", ev.evidence_text("evidence")).drop("scenario_id"))


@query(f"""
WITH {SCENARIOS}
SELECT round(avg(support_rate), 6) AS avg_support, round(avg(prob), 6) AS avg_prob, round(avg(uplift), 6) AS avg_uplift,
       round(max(uplift), 6) AS max_uplift, round(max(prob), 6) AS max_prob FROM scenarios
""")
def combination_summary(spark, sf) -> DataFrame:
    return round_doubles(rules.combination_summary(scenario_set(spark, sf)))


@query(f"""
WITH {SCENARIOS}
SELECT state, scenario_id, round(uplift, 6) AS uplift FROM scenarios WHERE uplift > 0 ORDER BY uplift DESC, state, scenario_id LIMIT 10
""")
def riskiest_combinations(spark, sf) -> DataFrame:
    positive = quality.filter_positive(scenario_set(spark, sf), "uplift")
    best = rules.top_k(positive, [F.desc("uplift"), "state", "scenario_id"], 10)
    return best.select("state", "scenario_id", r6("uplift"))


@query(f"""
WITH {SCENARIOS}
SELECT state, scenario_id, CASE WHEN len(ev) % 3 = 0 THEN 0 ELSE len(ev) END AS n_conditions,
       CASE WHEN len(ev) % 3 = 0 THEN '' ELSE array_to_string(list_transform(ev, lambda e: e.k || ': ' || e.v), ' / ') END AS label
FROM scenarios
""")
def parsed_evidence(spark, sf) -> DataFrame:
    """Evidence text back into a map; broken text gives an empty map."""
    size = F.size("evidence")
    written = scenario_set(spark, sf).select(
        "state", "scenario_id",
        F.when(size % 3 == 0, F.concat(F.lit("broken "), ev.evidence_text("evidence")))
        .otherwise(ev.evidence_text("evidence")).alias("raw"),
    )
    parsed = written.withColumn("m", ev.parse_evidence("raw"))
    return parsed.select(
        "state", "scenario_id", F.size("m").cast("bigint").alias("n_conditions"),
        F.replace(ev.evidence_label("m"), F.lit("\n"), F.lit(" / ")).alias("label"),
    )


@query("""
WITH keys AS (SELECT DISTINCT 'cat__' || p_type || ' / ' || p_brand || '.' || p_size AS k FROM part)
SELECT k, replace(translate(replace(replace(lower(k), 'cat__', ''), 'num__', ''), ' /.', ''), '~', '') AS feature, translate(lower(k), ' /.', '') AS condition,
       regexp_replace(lower(k), '[^\\p{L}\\p{N}]', '', 'g') AS alnum FROM keys
""".replace("\\\\", "\\"))
def normalized_keys(spark, sf) -> DataFrame:
    name = F.concat(F.lit("cat__"), "p_type", F.lit(" / "), "p_brand", F.lit("."), "p_size")
    return table(spark, sf, "part").select(name.alias("k")).distinct().select(
        "k", feature_key("k").alias("feature"), condition_key("k").alias("condition"), alnum_key("k").alias("alnum")
    )


@query(f"""
WITH {SCENARIOS}, {IMPORTANCES}, {CONDITION_SCORES}
SELECT state, scenario_id, k, v, CAST(tier AS INTEGER) AS tier, round(score, 6) AS score FROM looked
""")
def condition_importances(spark, sf) -> DataFrame:
    looked = scenarios.lookup_two_tier(
        scenarios.conditions(scenario_set(spark, sf), ["state"]), importance_set(spark, sf)
    )
    return looked.select("state", "scenario_id", "k", "v", "tier", r6("score"))


@query(f"""
WITH {FACTS},
feats AS (
  SELECT 'cat__oorderpriority_' || o_orderpriority AS f, length(o_orderpriority) / 100.0 AS s FROM facts GROUP BY 1, 2
  UNION ALL SELECT 'cat__lreturnflag_' || l_returnflag, (ascii(l_returnflag) - 70) / 100.0 FROM facts GROUP BY 1, 2
  UNION ALL SELECT 'num__qtyband', max(l_quantity) / 1000.0 FROM facts
  UNION ALL SELECT 'c_mktsegment', min(l_tax) + 0.5 FROM facts),
names AS (SELECT unnest(['l_returnflag', 'o_orderpriority', 'c_mktsegment', 'qty_band', 'disc_band']) AS name),
bases AS (SELECT name, regexp_replace(lower(name), '[^a-z0-9]', '', 'g') AS base FROM names)
SELECT name, round(coalesce((SELECT min(s) FROM feats WHERE f = name), (SELECT min(s) FROM feats WHERE f = 'num__' || base),
  greatest((SELECT max(s) FROM feats WHERE starts_with(f, 'cat__' || base || '_')), 0.0), 0.0)::DOUBLE, 6) AS importance FROM bases
""")
def column_importances(spark, sf) -> DataFrame:
    """Three-tier lookup by column name over importances derived from the facts."""
    # everything asked of the facts, read once
    rows = cut(
        facts(spark, sf).groupBy("o_orderpriority", "l_returnflag").agg(F.max("l_quantity").alias("l_quantity"), F.min("l_tax").alias("l_tax"))
    )
    priority = rows.select("o_orderpriority").distinct().select(
        F.concat(F.lit("cat__oorderpriority_"), "o_orderpriority").alias("feature"), (F.length("o_orderpriority") / 100).alias("importance")
    )
    flag = rows.select("l_returnflag").distinct().select(
        F.concat(F.lit("cat__lreturnflag_"), "l_returnflag").alias("feature"), ((F.ascii("l_returnflag") - 70) / 100).alias("importance")
    )
    band = rows.agg((F.max("l_quantity") / 1000).alias("importance")).select(F.lit("num__qtyband").alias("feature"), "importance")
    segment = rows.agg((F.min("l_tax") + 0.5).alias("importance")).select(F.lit("c_mktsegment").alias("feature"), "importance")
    imp = schema.canonical_importances(priority.unionByName(flag).unionByName(band).unionByName(segment))
    names = ["l_returnflag", "o_orderpriority", "c_mktsegment", "qty_band", "disc_band"]
    columns = rows.limit(1).select(F.explode(F.array(*[F.lit(n) for n in names])).alias("name"))
    return scenarios.lookup_three_tier(columns, imp).select("name", r6("importance"))


@query(f"""
WITH {SCENARIOS}, {IMPORTANCES}, {CONDITION_SCORES}
SELECT state, count(*) AS processed, count(*) FILTER (tier > 0) AS matched, round(count(*) FILTER (tier > 0) / count(*), 6) AS match_rate,
       count(*) FILTER (tier > 0) / count(*) < 0.1 AS low FROM looked GROUP BY ALL
""")
def match_rates(spark, sf) -> DataFrame:
    looked = scenarios.lookup_two_tier(
        scenarios.conditions(scenario_set(spark, sf), ["state"]), importance_set(spark, sf)
    )
    return round_doubles(scenarios.match_rate(looked, by=["state"]))


@query(f"""
WITH {SCORED}
SELECT state, scenario_id, round(s2_2_importance, 6) AS s2_2_importance, matched_details, len(regexp_extract_all(matched_details, 'Score')) AS n_scored
FROM positive
""")
def scenario_importances(spark, sf) -> DataFrame:
    return scored_set(spark, sf).select(
        "state", "scenario_id", r6("s2_2_importance"), "matched_details",
        F.size(ev.scored_parts("matched_details")).cast("bigint").alias("n_scored"),
    )


@query("""
SELECT l_returnflag, l_linenumber, count(*) AS n, round(sum((l_quantity - lo) / (hi - lo)), 4) AS total, count(constant_scaled) AS n_constant
FROM (SELECT *, CAST(NULL AS DOUBLE) AS constant_scaled FROM lineitem
      JOIN (SELECT l_returnflag, min(l_quantity) AS lo, max(l_quantity) AS hi FROM lineitem GROUP BY 1) USING (l_returnflag))
GROUP BY ALL
""")
def min_max_normalized(spark, sf) -> DataFrame:
    rows = table(spark, sf, "lineitem").withColumn("constant", F.lit(3.0))
    scaled = scenarios.min_max(rows, "l_quantity", "scaled", ["l_returnflag"])
    scaled = scenarios.min_max(scaled, "constant", "constant_scaled")
    return scaled.groupBy("l_returnflag", "l_linenumber").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.sum("scaled"), 4).alias("total"), F.count("constant_scaled").alias("n_constant")
    )


@query(f"""
WITH {SCORED}
SELECT state, scenario_id, round(norm_uplift, 6) AS norm_uplift, round(norm_importance, 6) AS norm_importance, round(CRI_Score, 6) AS "CRI_Score" FROM indexed
""")
def composite_index(spark, sf) -> DataFrame:
    scored = scenarios.cri(scored_set(spark, sf), by=["state"])
    return round_doubles(scored.select("state", "scenario_id", "norm_uplift", "norm_importance", "CRI_Score"))


@query(f"""
WITH {SCENARIOS}
SELECT accident_type, evidence, round(prob, 6) AS prob, round(uplift, 6) AS lift, round(support_rate, 6) AS support_rate, state FROM scenarios
""")
def canonical_scenario_columns(spark, sf) -> DataFrame:
    """A scenario table under other column names, numbers as text, evidence as text."""
    other = scenario_set(spark, sf).select(
        F.col("accident_type").alias("Accident Type"), ev.evidence_text("evidence").alias("evidence_dict"),
        F.col("prob").cast("string").alias("P"), F.col("uplift").alias("Lift"), F.col("support_rate").alias("support"), "state",
    )
    canonical = schema.canonical_scenarios(other)
    return round_doubles(canonical.withColumn("evidence", ev.evidence_text("evidence")))


_VOCABULARY = f"""{SCENARIOS},
tokens AS (
  SELECT state, scenario_id, prob, lift, support_rate, uplift, list_prepend('AccidentType=' || accident_type, list_transform(ev, lambda e: e.k || '=' || e.v)) AS t
  FROM scenarios),
vocab AS (SELECT token, row_number() OVER (ORDER BY token) + 1 AS token_id FROM (SELECT DISTINCT unnest(t) AS token FROM tokens))"""


@query(f"""
WITH {_VOCABULARY}
SELECT token, CAST(token_id AS INTEGER) AS token_id FROM vocab UNION ALL SELECT '<PAD>', 0 UNION ALL SELECT '<UNK>', 1
""")
def token_vocabulary(spark, sf) -> DataFrame:
    return sequences.vocabulary(sequences.token_rows(scenario_set(spark, sf), ["state"]))


@query(f"""
WITH {_VOCABULARY}, {IMPORTANCES},
placed AS (SELECT state, scenario_id, prob, uplift, unnest(t[1:3]) AS token, generate_subscripts(t[1:3], 1) AS pos FROM tokens),
scored AS (
  SELECT p.*, v.token_id, coalesce(a.importance, b.importance, 0.0) AS importance
  FROM placed p JOIN vocab v USING (token)
    LEFT JOIN lookup a ON pos > 1 AND a.feature = translate(lower(replace(token, '=', '_')), ' /.', '')
    LEFT JOIN lookup b ON pos > 1 AND b.feature = translate(lower(split_part(token, '=', 1)), ' /.', ''))
SELECT state, scenario_id, string_agg(token_id, ',' ORDER BY pos) || repeat(',0', 3 - count(*)) AS token_ids, count(*) AS n_real,
  round(list_sum(list(importance ORDER BY pos)), 6) AS importance, round(count(*) * any_value(prob), 6) AS prob,
  round(ln(1 + greatest(any_value(uplift), -0.999999)), 6) AS label
FROM scored GROUP BY state, scenario_id
""")
def token_sequences(spark, sf) -> DataFrame:
    """Sequences of three positions (longer ones cut), label log1p of the uplift."""
    seq = sequences.sequences(
        scenario_set(spark, sf), importance_set(spark, sf), length=3, by=["state"], match="condition",
        label=sequences.weak_label("uplift", "log1p"),
    )

    def total(i: int):
        return F.aggregate("numeric", F.lit(0.0), lambda acc, x: acc + F.get(x, F.lit(i)))

    return seq.select(
        "state", "scenario_id", F.array_join("token_ids", ",").alias("token_ids"),
        F.size(F.filter("mask", lambda m: m)).cast("bigint").alias("n_real"),
        r6(total(3), "importance"), r6(total(0), "prob"), r6("label"),
    )


@query(f"""
WITH {_VOCABULARY},
placed AS (SELECT state, scenario_id, prob, lift, support_rate, unnest(t) AS token FROM tokens)
SELECT 'prob' AS feature, round(avg(prob), 6) AS mean, round(greatest(stddev_samp(prob), 1e-6), 6) AS std FROM placed
UNION ALL SELECT 'lift', round(avg(lift), 6), round(greatest(stddev_samp(lift), 1e-6), 6) FROM placed
UNION ALL SELECT 'support_rate', round(avg(support_rate), 6), round(greatest(stddev_samp(support_rate), 1e-6), 6) FROM placed
UNION ALL SELECT 'importance', 0.0, 0.000001
""")
def token_statistics(spark, sf) -> DataFrame:
    """No evidence column has an importance of its own here, so that feature is constant."""
    imp = importance_set(spark, sf).where("feature_name like 'cat%'")
    seq = sequences.sequences(scenario_set(spark, sf), imp, length=10, by=["state"])
    return round_doubles(sequences.token_statistics(seq))


@query(f"""
WITH {_VOCABULARY}
SELECT state, scenario_id, round(uplift, 6) AS label,
  row_number() OVER (ORDER BY md5(concat_ws('|', state, scenario_id, '42')), state, scenario_id) <= greatest(1, round_even(count(*) OVER () * 0.2, 0)) AS is_validation,
  true AS informed
FROM tokens
""")
def learned_index(spark, sf) -> DataFrame:
    """Regression of the uplift on the sequence features, early stop, all scenarios predicted; whether the
    predictions of scenarios held out are nearer than the mean label."""
    seq = sequences.sequences(
        scenario_set(spark, sf), importance_set(spark, sf), by=["state"], match="condition",
        label=sequences.weak_label("uplift"),
    )
    found = cut(sequences.learned_cri(seq, ["state"]))
    held, mean = F.col("is_validation"), found.where("not is_validation").agg(F.avg("label")).scalar()
    missed = F.avg(F.when(held, F.pow(F.col("CRI_Learned") - F.col("label"), 2)))
    guessed = F.avg(F.when(held, F.pow(mean - F.col("label"), 2)))
    informed = found.agg((missed < guessed).alias("informed")).scalar()
    return round_doubles(found.select("state", "scenario_id", "label", "is_validation").withColumn("informed", informed))


_PATHS = f"""{SCORED},
scaled AS (
  SELECT state, scenario_id, prob AS confidence, support_rate AS frequency, uplift AS impact,
    (uplift - min(uplift) OVER w) / (max(uplift) OVER w - min(uplift) OVER w) AS a,
    (s2_2_importance - min(s2_2_importance) OVER w) / (max(s2_2_importance) OVER w - min(s2_2_importance) OVER w) AS m,
    (prob - min(prob) OVER w) / (max(prob) OVER w - min(prob) OVER w) AS c
  FROM positive WINDOW w AS (PARTITION BY state)),
averaged AS (SELECT *, (0.4 * a + 0.4 * m + 0.2 * c) / 1.0 AS average, greatest(a, m, c) AS largest, least(a, m, c) AS smallest FROM scaled)"""


def _paths(spark, sf) -> DataFrame:
    return scored_set(spark, sf).select(
        "state", "scenario_id", F.col("uplift").alias("association_score"), F.col("s2_2_importance").alias("model_score"),
        F.col("prob").alias("confidence"), F.col("support_rate").alias("frequency"), F.col("uplift").alias("impact"),
    )


@query(f"""
WITH {_PATHS},
methods AS (
  SELECT state, scenario_id, 'weighted_average' AS method, average AS s FROM averaged UNION ALL SELECT state, scenario_id, 'max', largest FROM averaged
  UNION ALL SELECT state, scenario_id, 'min', smallest FROM averaged UNION ALL SELECT state, scenario_id, 'ensemble', (average + largest + smallest) / 3 FROM averaged)
SELECT state, scenario_id, method, round(s, 6) AS fused_score FROM methods
""")
def fused_scores(spark, sf) -> DataFrame:
    parts = [
        fusion.fuse_scores(_paths(spark, sf), method=m, by=["state"]).withColumn("method", F.lit(m))
        for m in ("weighted_average", "max", "min", "ensemble")
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out.select("state", "scenario_id", "method", r6("fused_score"))


@query(f"""
WITH {_PATHS},
priority AS (SELECT *, 0.4 * average + 0.3 * confidence + 0.2 * frequency + 0.1 * impact AS p FROM averaged)
SELECT state, scenario_id, round(p, 6) AS priority_score,
  CASE WHEN average >= 0.7 THEN 'high' WHEN average >= 0.4 THEN 'medium' ELSE 'low' END AS risk_level
FROM priority
""")
def priority_scores(spark, sf) -> DataFrame:
    ranked = fusion.fuse_and_rank(_paths(spark, sf), by=["state"])
    return ranked.select("state", "scenario_id", r6("priority_score"), "risk_level")


@query(f"""
WITH {_PATHS}, lev AS (SELECT *, CASE WHEN average >= 0.7 THEN 3 WHEN average >= 0.4 THEN 2 ELSE 1 END AS l FROM averaged)
SELECT state, scenario_id, rank() OVER (PARTITION BY state ORDER BY l DESC) AS priority_rank FROM lev
""")
def priority_by_level(spark, sf) -> DataFrame:
    """Scenarios of one level share a rank."""
    ranked = fusion.fuse_and_rank(_paths(spark, sf), ranking="risk_level", by=["state"])
    return ranked.select("state", "scenario_id", "priority_rank")


@query("""
WITH p AS (SELECT *, rank() OVER (PARTITION BY p_type ORDER BY s DESC) AS rank
  FROM (SELECT p_partkey, p_type, (p_size - min(p_size) OVER (PARTITION BY p_type))::DOUBLE / (max(p_size) OVER (PARTITION BY p_type) - min(p_size) OVER (PARTITION BY p_type)) AS s FROM part))
SELECT p_partkey, p_type, round(s, 6) AS fused_score, rank FROM p
""")
def fused_rank_with_ties(spark, sf) -> DataFrame:
    """A single path with many equal scores."""
    part = table(spark, sf, "part").select("p_partkey", "p_type", "p_size")
    fused = fusion.fuse_scores(part, ["p_size"], "max", {"p_size": 1.0}, by=["p_type"])
    return fused.select("p_partkey", "p_type", r6("fused_score"), "rank")


@query(f"""
WITH {FACTS}, {IMPORTANCES}
SELECT feature_name, round(importance_score, 6) AS importance_score FROM importances ORDER BY 2 DESC, 1 LIMIT 10
""")
def saved_importances(spark, sf) -> DataFrame:
    """The importance list through its file, then the best ten."""
    path = scratch_path(spark, "importances")
    files.save_importances(importance_set(spark, sf), path)
    return round_doubles(top_features(files.load_importances(spark, path), 10))
