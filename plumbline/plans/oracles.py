"""The registered queries as DuckDB SQL over the same tables."""

from __future__ import annotations

from itertools import combinations

from plumbline.plans.tables import CANDIDATES, DOCUMENT_FEATURES

LANGUAGES = ["de", "en", "es", "fr"]
FEATURES = [*DOCUMENT_FEATURES, *[f"type_{v}" for v in LANGUAGES]]
FOLDS = 5


def _ap(source: str, keys: list[str], digits: int = 9) -> str:
    """Average precision of ``source``, a query giving the keys, ``score`` and ``y``."""
    by = "".join(f"{k}, " for k in keys)
    over = f"PARTITION BY {', '.join(keys)} " if keys else ""
    group = f"GROUP BY {', '.join(keys)}" if keys else ""
    return f"""
    SELECT {by} round(sum(tp * ctp / cn) / nullif(sum(tp), 0), {digits}) AS ap,
           sum(n)::BIGINT AS n, sum(tp)::BIGINT AS positives
    FROM (SELECT *, sum(tp) OVER w::DOUBLE AS ctp, sum(n) OVER w::DOUBLE AS cn
          FROM (SELECT {by} score, sum(y) AS tp, count(*) AS n FROM ({source})
                GROUP BY {by} score)
          WINDOW w AS ({over}ORDER BY score DESC))
    {group}"""


def _numbered(row_id: str, target: str) -> str:
    """Number of a row in the order of class, digest and id."""
    digest = f"substr(md5(concat_ws(':', '0', {row_id})), 1, 15)"
    return f"(row_number() OVER (ORDER BY {target}, {digest}, {row_id}) - 1)"


def _splits(source: str, row_id: str, target: str) -> str:
    """Rows of ``source`` with ``is_holdout`` and ``fold``."""
    return f"""
    SELECT * EXCLUDE (g), g % 5 < 1 AS is_holdout,
           CASE WHEN g % 5 >= 1 THEN ((g - (g // 5 + 1)) % {FOLDS})::INTEGER END AS fold
    FROM (SELECT *, {_numbered(row_id, target)} AS g FROM ({source}))"""


# lineitem read as sensor rows.
_HEAT = "(l_tax - l_discount < -0.05 AND l_extendedprice < 10000.0)"
_WATTS = "(l_quantity * l_extendedprice * (2.0::DOUBLE * pi() / 60.0))"
_POWER = f"({_WATTS} < 3500.0 OR {_WATTS} > 480000.0)"
_STRAIN = (
    "(l_linenumber * l_quantity > "
    "CASE l_returnflag WHEN 'A' THEN 200 WHEN 'N' THEN 220 WHEN 'R' THEN 240 END)"
)
_FLAGS = f"""
    SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, l_returnflag AS variant,
           (l_linestatus = 'F')::INTEGER AS target, {_HEAT} AS heat, {_POWER} AS power,
           {_STRAIN} AS strain, ({_HEAT} OR {_POWER} OR {_STRAIN})::INTEGER AS failure
    FROM lineitem"""

_EVENTS = """
    SELECT strftime(ts, '%Y-%m-%d %H') AS hour, value AS score,
           (event_type = 'error')::INTEGER AS y
    FROM events"""
_EVENT_TARGETS = "SELECT event_id, (event_type = 'error')::INTEGER AS target FROM events"

_LABELS = "SELECT doc_id, toxic FROM labels"
_ONE_HOT = ", ".join(
    f"coalesce((d.lang = '{v}')::INTEGER, 0)::DOUBLE AS type_{v}" for v in LANGUAGES
)
_DOCUMENTS = f"""
    SELECT d.doc_id, d.lang, d.n_chars,
           length(text) - length(replace(text, ' ', '')) + 1 AS n_words,
           length(text) - length(replace(text, chr(10), '')) + 1 AS n_lines,
           length(text) - length(translate(text, '0123456789', '')) AS n_digits,
           length(text) - length(replace(text, ',', '')) AS n_commas,
           {_ONE_HOT}, l.toxic
    FROM documents d JOIN labels l USING (doc_id)"""
_SPLIT_DOCUMENTS = _splits(_DOCUMENTS, "doc_id", "toxic")
_SEARCH = f"SELECT * FROM ({_SPLIT_DOCUMENTS}) WHERE NOT is_holdout"


def _statistics(features: list[str]) -> str:
    columns = ", ".join(
        f"avg({x}::DOUBLE) AS mu_{x}, stddev_pop({x}::DOUBLE) AS sd_{x}" for x in features
    )
    return f"""
    SELECT k AS scaler_fold, count(*) AS fit_rows, sum(toxic)::BIGINT AS fit_ones, {columns}
    FROM ({_SEARCH}) s, (SELECT unnest([-1, 0, 1, 2, 3, 4])::INTEGER AS k)
    WHERE s.fold <> k GROUP BY k"""


def _scaled(part: str, features: list[str]) -> str:
    """Standardised rows of a part with the fold whose statistics scaled them."""
    condition = {
        "validation": "r.fold = s.scaler_fold",
        "fit": "r.fold <> s.scaler_fold AND s.scaler_fold >= 0",
        "holdout": "r.fold IS NULL AND s.scaler_fold >= 0",
    }[part]
    z = ", ".join(
        f"(r.{x} - s.mu_{x}) / CASE WHEN s.sd_{x} = 0 THEN 1.0 ELSE s.sd_{x} END AS {x}"
        for x in features
    )
    return f"""
    SELECT r.doc_id, r.toxic, r.fold, s.scaler_fold, s.fit_rows, s.fit_ones, {z}
    FROM ({_SPLIT_DOCUMENTS}) r, ({_statistics(features)}) s WHERE {condition}"""


_WEIGHT = "fit_rows / (2.0::DOUBLE * CASE toxic WHEN 1 THEN fit_ones ELSE fit_rows - fit_ones END)"

# The candidate expressions, written for SQL.
_SCORES = {
    "constant": "0.5::DOUBLE",
    "length": "n_chars",
    "bounded": "greatest(n_commas, 0.4::DOUBLE) - n_lines / 7.0::DOUBLE",
    "squeezed": "least(n_chars * n_lines, 3.5::DOUBLE)",
    "additive": "n_words + n_digits * 0.125::DOUBLE - n_commas",
    "ratio": "n_chars / nullif(n_lines + 11.0::DOUBLE, 0)",
    "any_of": "greatest((n_commas < 0.2)::INTEGER, (n_lines > 1.5)::INTEGER)::DOUBLE",
    "spoken": "type_de - type_fr * 1.5::DOUBLE + n_words",
    "tongue": "greatest((type_en > 0)::INTEGER, (type_es > 0)::INTEGER)::DOUBLE * n_commas",
    "all_of": "least((n_chars < 2.0)::INTEGER, (n_words > -1.5)::INTEGER)::DOUBLE + n_digits",
}


def _long_scores(part: str) -> str:
    columns = ", ".join(f"{e} AS {name}" for name, e in _SCORES.items())
    return f"""
    UNPIVOT (SELECT scaler_fold, fold IS NULL AS held, toxic AS y, {columns}
             FROM ({_scaled(part, FEATURES)}))
    ON {", ".join(_SCORES)} INTO NAME candidate VALUE score"""


def _losses(loss: str) -> str:
    columns = ", ".join(
        f"round(sum(weight * {loss.format(p=f'({e})')}) / sum(weight), 6) AS {name}"
        for name, e in _SCORES.items()
    )
    return f"""
    SELECT candidate, scaler_fold AS fold, loss FROM (
      UNPIVOT (SELECT scaler_fold, {columns}
               FROM (SELECT *, {_WEIGHT} AS weight FROM ({_scaled("fit", FEATURES)}))
               GROUP BY scaler_fold)
      ON {", ".join(_SCORES)} INTO NAME candidate VALUE loss)"""


_SQUASHED = "(1.0::DOUBLE / (1.0::DOUBLE + exp(-{p})))"
_LOGISTIC_LOSS = (
    f"-(toxic * ln({_SQUASHED} + 1e-9::DOUBLE) "
    f"+ (1.0 - toxic) * ln(1.0::DOUBLE - {_SQUASHED} + 1e-9::DOUBLE))"
)

# Events as trial records.
_TRIALS = """
    SELECT *, row_number() OVER (PARTITION BY log ORDER BY ts, event_id) - 1 AS trial_index
    FROM (SELECT CASE event_type WHEN 'click' THEN 'optuna_seed0' WHEN 'purchase' THEN 'optuna_seed1'
                   WHEN 'view' THEN 'optuna_seed2' WHEN 'error' THEN 'agent' ELSE 'pysr' END AS log,
                 ts, event_id, user_id, json_extract_string(props, '$.k')::INTEGER AS k,
                 value AS mean_score,
                 CASE WHEN user_id % 3 <> 0 THEN value / 2 END AS holdout_ap,
                 (json_extract_string(props, '$.k')::INTEGER + 1) / 10.0::DOUBLE AS tenth,
                 (epoch_us(ts) - epoch_us(TIMESTAMP '2024-01-01')) / 1e6::DOUBLE AS cumulative_s
          FROM events)"""
_BEST = f"""
    SELECT log, trial_index, mean_score, cumulative_s,
           max(mean_score) OVER (PARTITION BY log ORDER BY trial_index
                                 ROWS UNBOUNDED PRECEDING) AS best_score
    FROM ({_TRIALS})"""
_BAND = f"""
    SELECT trial_index, round(median(best_score), 6) AS median, round(min(best_score), 6) AS low,
           round(max(best_score), 6) AS high
    FROM ({_BEST}) WHERE starts_with(log, 'optuna_seed') GROUP BY trial_index"""
_FIRST_BEST = f"""
    SELECT * FROM ({_TRIALS})
    QUALIFY row_number() OVER (PARTITION BY log ORDER BY mean_score DESC, trial_index) = 1"""
_ARMS = f"SELECT log AS arm, mean_score AS cv_mean, holdout_ap FROM ({_FIRST_BEST})"
_FINALS = f"SELECT log, max(mean_score) AS best_score FROM ({_TRIALS}) GROUP BY log"
_BEST_SEED = f"""
    SELECT log, best_score FROM ({_FINALS}) WHERE starts_with(log, 'optuna_seed')
    ORDER BY best_score DESC, log LIMIT 1"""
_USAGE = f"""
    SELECT log, trial_index, tenth AS latency_s,
           sum(k) OVER w::BIGINT AS input, sum(2 * k) OVER w::BIGINT AS output,
           sum(CASE WHEN k % 3 = 0 THEN k + 1 ELSE 0 END) OVER w::BIGINT AS reasoning
    FROM ({_TRIALS}) WHERE log = 'agent'
    WINDOW w AS (PARTITION BY log ORDER BY trial_index ROWS UNBOUNDED PRECEDING)"""
_PARAMS = """
    CASE WHEN k % 2 = 0
    THEN '"use_interactions":' || (k % 4 = 0)::VARCHAR || ',"C":' || tenth::VARCHAR
         || ',"penalty":"l2","class_weight":"none"}'
    ELSE '"n_estimators":' || (k + 50) || ',"max_depth":' || (k % 18 + 3)
         || ',"min_samples_leaf":1,"max_features":"sqrt","class_weight":"none"}' END"""
_BRANCH = "CASE WHEN k % 2 = 0 THEN 'logistic' ELSE 'random_forest' END"
_TRAIL = f"""
    SELECT log, trial_index AS trial, {_BRANCH} AS estimator, '{{' || {_PARAMS} AS params,
           round_even(mean_score, 4) AS ap, round_even(tenth, 1) AS latency_s,
           'rationale ' || event_id AS rationale
    FROM ({_TRIALS}) WHERE log = 'agent'"""
_CHOSEN = f"""
    SELECT *, CASE WHEN log = 'agent' THEN 'agent' ELSE 'best seed' END AS label
    FROM ({_TRIALS}) WHERE log = 'agent' OR log = (SELECT log FROM ({_BEST_SEED}))"""


def _numeric_params(source: str, extra: str) -> str:
    return f"""
    SELECT {extra}, 'log10 C' AS param, round(log10(tenth), 9) AS value
    FROM ({source}) WHERE k % 2 = 0
    UNION ALL SELECT {extra}, 'n_estimators', (k + 50)::DOUBLE FROM ({source}) WHERE k % 2 = 1
    UNION ALL SELECT {extra}, 'max_depth', (k % 18 + 3)::DOUBLE FROM ({source}) WHERE k % 2 = 1
    UNION ALL SELECT {extra}, 'min_samples_leaf', 1.0::DOUBLE FROM ({source}) WHERE k % 2 = 1"""


_EXPRESSIONS = f"""
    SELECT log, trial_index, mean_score, k AS complexity, 'expr_' || event_id AS expression,
           holdout_ap
    FROM ({_TRIALS}) WHERE log = 'pysr'"""
_GROUPS = f"""
    SELECT complexity, count(*) AS folds_present, avg(mean_score) AS cv_mean,
           avg(holdout_ap) AS holdout_ap, arg_max(expression, trial_index) AS expression,
           min(trial_index) AS first_seen
    FROM ({_EXPRESSIONS}) GROUP BY complexity"""
_FULL = f"""
    SELECT complexity, expression, cv_mean, holdout_ap, folds_present FROM ({_GROUPS})
    WHERE folds_present = (SELECT max(folds_present) FROM ({_GROUPS}))
    ORDER BY cv_mean DESC, first_seen LIMIT 1"""
_ITERATIONS = f"""
    SELECT user_id % 2 + 1 AS iteration, event_id, mean_score, k AS complexity, holdout_ap
    FROM ({_TRIALS})"""


def _draw(name: str) -> str:
    digest = f"md5(concat_ws(':', '0:{name}', p_partkey))"
    return f"(('0x' || substr({digest}, 1, 8))::BIGINT / 4294967296.0::DOUBLE)"


def _pick(name: str, options: list[str]) -> str:
    listed = ", ".join(f"'{o}'" for o in options)
    return f"([{listed}])[floor({_draw(name)} * {len(options)})::INTEGER + 1]"


def _whole(name: str, low: int, high: int) -> str:
    return (
        f"CASE WHEN NOT logistic THEN floor({_draw(name)} * {high - low + 1} + {low})::INTEGER "
        f"END AS {name}"
    )


def _if(test: str, name: str) -> str:
    return f"CASE WHEN {test} THEN '{name}' END"


_CLASS_WEIGHTS = ["none", "balanced", "balanced_subsample"]

_COMPARISON = f"""
    SELECT trial_index, median AS y, 'median of seeds' AS label FROM ({_BAND})
    UNION ALL SELECT trial_index, round(best_score, 6), log FROM ({_BEST})
    WHERE log IN ('agent', 'pysr')"""

_SCORED = f"""
    SELECT candidate, scaler_fold AS fold, max(ap) FILTER (NOT held) AS ap,
           max(ap) FILTER (held) AS holdout_ap
    FROM ({_ap(f"SELECT * FROM ({_long_scores('validation')}) UNION ALL "
               f"SELECT * FROM ({_long_scores('holdout')})",
               ["candidate", "scaler_fold", "held"], 15)})
    GROUP BY 1, 2"""
_TEXTS = ", ".join(f"('{c.name}', {c.complexity}, '{c.expression}')" for c in CANDIDATES)
_CANDIDATE_TRIALS = f"""
    SELECT 'pysr' AS log, row_number() OVER (ORDER BY fold, complexity, candidate) - 1 AS trial_index,
           ap, complexity::INTEGER AS complexity, expression, fold, holdout_ap
    FROM ({_SCORED}) JOIN (VALUES {_TEXTS}) t(candidate, complexity, expression) USING (candidate)"""

# Whole parameters: what the agent's records hold besides their usual fields.
_ODD = """
    CASE WHEN k % 2 = 0
    THEN '"use_interactions":' || (k % 4 = 0)::VARCHAR || ',"C":' || tenth::VARCHAR
         || ',"penalty":"l2","max_depth":"deep","class_weight":"none"'
    ELSE '"n_estimators":' || (k + 50) || ',"max_depth":"deep","min_samples_leaf":1,'
         || '"max_features":"sqrt","class_weight":"none"' END
    || ',"a note":null' || CASE WHEN k % 2 = 1 THEN ',"depth":' || (k % 18 + 3) ELSE '' END
    || ',"warm_start":' || (k % 3 = 0)::VARCHAR || '}'"""

# Lines of logs by what is wrong with them.
_REASON = """
    CASE event_id % 100 WHEN 1 THEN 'not an object' WHEN 2 THEN 'missing: arm'
         WHEN 3 THEN 'unknown: budget, seed' WHEN 4 THEN 'value of another type'
         WHEN 5 THEN 'not an object' ELSE 'none' END"""

_LINE = "(l_orderkey * 10 + l_linenumber)"


def _first_step() -> str:
    """Gradient and Gram sums at zero coefficients over the rows outside each fold."""
    whole = ", ".join(
        f"(r.{x} - s.mu_{x}) / CASE WHEN s.sd_{x} = 0 THEN 1.0 ELSE s.sd_{x} END" for x in FEATURES
    )
    names = ", ".join(f"'{x}'" for x in [*FEATURES, "1"])
    n = len(FEATURES) + 1
    return f"""
    WITH rows AS (SELECT r.fold, r.toxic, [{whole}, 1.0::DOUBLE] AS z
                  FROM ({_SEARCH}) r, ({_statistics(FEATURES)}) s WHERE s.scaler_fold = -1),
    fits AS (SELECT k AS fold, rows.toxic, rows.z FROM rows, (SELECT unnest([0, 1, 2, 3, 4])::INTEGER AS k)
             WHERE rows.fold <> k),
    i AS (SELECT unnest(range(1, {n + 1})) AS i), j AS (SELECT unnest(range(1, {n + 1})) AS j)
    SELECT fold, [{names}][i] AS row, [{names}][j] AS col, round(sum(0.25::DOUBLE * z[i] * z[j]), 6) AS value
    FROM fits, i, j WHERE i <= j GROUP BY fold, i, j
    UNION ALL SELECT fold, [{names}][i], 'gradient', round(sum((0.5::DOUBLE - toxic) * z[i]), 6)
    FROM fits, i GROUP BY fold, i"""


ORACLES: dict[str, str] = {
    "rule_flags": f"""
        SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, variant, target, heat, power,
               strain, failure FROM ({_FLAGS})""",
    "process_power_by_variant": f"""
        SELECT l_returnflag AS variant, round(min({_WATTS}), 3) AS low,
               round(avg({_WATTS}), 3) AS mean, round(max({_WATTS}), 3) AS high
        FROM lineitem GROUP BY 1""",
    "rule_counts_by_variant": f"""
        SELECT variant, count(*) AS n, sum(heat::INTEGER)::BIGINT AS heat,
               sum(power::INTEGER)::BIGINT AS power, sum(strain::INTEGER)::BIGINT AS strain,
               sum(failure)::BIGINT AS failure
        FROM ({_FLAGS}) GROUP BY variant""",
    "rule_average_precision": f"""
        SELECT a.variant, a.ap, a.n, a.positives, c.flagged, c.hits
        FROM ({_ap(f"SELECT variant, failure AS score, target AS y FROM ({_FLAGS}) "
                   f"UNION ALL SELECT 'all', failure, target FROM ({_FLAGS})", ["variant"])}) a
        JOIN (SELECT coalesce(variant, 'all') AS variant, sum(failure)::BIGINT AS flagged,
                     sum(failure * target)::BIGINT AS hits
              FROM ({_FLAGS}) GROUP BY ROLLUP (variant)) c USING (variant)""",
    "price_average_precision": _ap(
        "SELECT l_returnflag AS variant, l_extendedprice AS score, "
        "(l_linestatus = 'F')::INTEGER AS y FROM lineitem",
        ["variant"],
    ),
    "event_average_precision": _ap(_EVENTS, []),
    "ap_by_event_hour": _ap(_EVENTS, ["hour"]),
    "stratified_holdout": f"""
        SELECT doc_id, toxic, {_numbered("doc_id", "toxic")} % 5 < 1 AS is_holdout FROM labels""",
    "stratified_folds": f"""
        SELECT doc_id, toxic, ({_numbered("doc_id", "toxic")} % 5)::INTEGER AS fold
        FROM labels""",
    "split_assignment": _splits(_LABELS, "doc_id", "toxic"),
    "split_sizes": f"""
        SELECT is_holdout, coalesce(fold, -1)::INTEGER AS fold, count(*) AS n,
               sum(target)::BIGINT AS positives, sum(event_id)::BIGINT AS id_sum
        FROM ({_splits(_EVENT_TARGETS, "event_id", "target")}) GROUP BY 1, 2""",
    "two_fold_sizes": f"""
        SELECT (g % 2)::INTEGER AS fold, count(*) AS n, sum(toxic)::BIGINT AS positives
        FROM (SELECT toxic, {_numbered("doc_id", "toxic")} AS g FROM labels)
        GROUP BY 1""",
    "stratified_sample": f"""
        SELECT event_id, target
        FROM (SELECT *, {_numbered("event_id", "target")} AS g,
                     count(*) OVER () AS total, least(600, count(*) OVER ()) AS share
              FROM ({_EVENT_TARGETS}))
        WHERE g * share % total < share""",
    "features_onehot": "SELECT doc_id, "
    + ", ".join(f"{x}::DOUBLE AS {x}" for x in FEATURES)
    + f", toxic FROM ({_DOCUMENTS})",
    "target_prevalence": "SELECT round(avg(toxic::DOUBLE), 9) AS prevalence FROM labels",
    "target_counts": "SELECT toxic, count(*) AS n FROM labels GROUP BY toxic",
    "class_weights": """
        SELECT doc_id, toxic,
               round(count(*) OVER () / (2.0::DOUBLE * count(*) OVER (PARTITION BY toxic)), 9) AS weight
        FROM labels""",
    "ap_per_fold": _ap(f"SELECT fold, n_chars AS score, toxic AS y FROM ({_SEARCH})", ["fold"]),
    "cv_mean_std": f"""
        SELECT round(avg(ap), 9) AS mean_score, round(stddev_pop(ap), 9) AS std_score,
               count(ap) AS folds
        FROM ({_ap(f"SELECT fold, n_chars AS score, toxic AS y FROM ({_SEARCH})", ["fold"], 15)})""",
    "rule_ap_per_fold": f"""
        SELECT a.fold, a.ap, a.n, a.positives, c.flagged, c.hits
        FROM ({_ap(f"SELECT fold, (n_words > 400)::INTEGER AS score, toxic AS y FROM ({_SEARCH})",
                   ["fold"])}) a
        JOIN (SELECT fold, sum((n_words > 400)::INTEGER)::BIGINT AS flagged,
                     sum((n_words > 400)::INTEGER * toxic)::BIGINT AS hits
              FROM ({_SEARCH}) GROUP BY fold) c USING (fold)""",
    "fold_statistics": "SELECT scaler_fold, fit_rows, fit_ones, "
    + ", ".join(
        f"round(mu_{x}, 6) AS mu_{x}, round(sd_{x}, 6) AS sd_{x}" for x in FEATURES
    )
    + f" FROM ({_statistics(FEATURES)})",
    "fold_scaling": "SELECT doc_id, fold, "
    + ", ".join(f"round({x}, 6) AS {x}" for x in FEATURES)
    + f" FROM ({_scaled('validation', FEATURES)})",
    "fold_weights": f"""
        SELECT doc_id, scaler_fold, toxic, round({_WEIGHT}, 9) AS weight
        FROM ({_scaled("fit", ["n_chars"])})""",
    "interactions": "SELECT doc_id, fold, "
    + ", ".join(
        [f"round({x}, 6) AS {x}" for x in FEATURES]
        + [f"round({a} * {b}, 6) AS {a}_x_{b}" for a, b in combinations(FEATURES, 2)]
    )
    + f" FROM ({_scaled('validation', FEATURES)})",
    "expression_scores": f"""
        SELECT candidate, fold, round(ap, 9) AS ap, round(holdout_ap, 9) AS holdout_ap
        FROM ({_SCORED})""",
    "expression_trials": f"""
        SELECT log, trial_index, round(ap, 9) AS ap, complexity, expression, fold,
               round(holdout_ap, 9) AS holdout_ap FROM ({_CANDIDATE_TRIALS})""",
    "expression_selection": f"""
        SELECT complexity, arg_max(expression, trial_index) AS expression,
               round(avg(ap), 9) AS cv_mean, round(avg(holdout_ap), 9) AS holdout_ap,
               count(*) AS folds_present
        FROM ({_CANDIDATE_TRIALS}) GROUP BY complexity
        ORDER BY folds_present DESC, avg(ap) DESC, min(trial_index) LIMIT 1""",
    "expression_losses": _losses("pow({p} - toxic, 2)"),
    "expression_logistic_losses": _losses(_LOGISTIC_LOSS),
    "trial_log_summary": f"""
        SELECT log, count(*) AS n, round(max(mean_score), 9) AS best,
               round(max(cumulative_s) / 60, 9) AS minutes
        FROM ({_TRIALS}) GROUP BY log""",
    "best_so_far": f"SELECT log, trial_index, mean_score, best_score FROM ({_BEST})",
    "best_by_time": f"""
        SELECT log, round(cumulative_s / 60, 9) AS cumulative_min, best_score,
               CASE WHEN starts_with(log, 'optuna_seed') THEN 'optuna seed' ELSE log END AS label
        FROM ({_BEST})""",
    "seed_band": _BAND,
    "score_spread": f"""
        SELECT log, round(median(mean_score), 6) AS median, round(min(mean_score), 6) AS low,
               round(max(mean_score), 6) AS high
        FROM ({_TRIALS}) GROUP BY log""",
    "comparison_lines": _COMPARISON,
    "band_membership": f"""
        SELECT arm, cv_mean, holdout_ap, cv_low, cv_high, holdout_low, holdout_high,
               cv_mean BETWEEN cv_low AND cv_high AS cv_inside,
               holdout_ap BETWEEN holdout_low AND holdout_high AS holdout_inside
        FROM ({_ARMS}), (SELECT min(cv_mean) AS cv_low, max(cv_mean) AS cv_high,
                                min(holdout_ap) AS holdout_low, max(holdout_ap) AS holdout_high
                         FROM ({_ARMS}) WHERE starts_with(arm, 'optuna_seed'))
        WHERE NOT starts_with(arm, 'optuna_seed')""",
    "best_record": f"""
        SELECT log, trial_index, mean_score, k / 1000.0::DOUBLE AS std_score, event_id
        FROM ({_FIRST_BEST})""",
    "best_seed": _BEST_SEED,
    "budget_status": f"""
        SELECT log, max(mean_score) AS best, 1000000 - count(*) AS remaining
        FROM ({_TRIALS}) GROUP BY log""",
    "cumulative_usage": _USAGE,
    "usage_long": f"""
        SELECT log, trial_index, kind, cumulative_tokens
        FROM (UNPIVOT (SELECT log, trial_index, input, output, reasoning FROM ({_USAGE}))
              ON input, output, reasoning INTO NAME kind VALUE cumulative_tokens)""",
    "param_long": _numeric_params(
        f"SELECT * FROM ({_TRIALS}) WHERE log <> 'pysr'", "log, trial_index"
    ),
    "param_trajectories": _numeric_params(_CHOSEN, "label, trial_index"),
    "branch_trajectories": f"SELECT label, trial_index, {_BRANCH} AS estimator FROM ({_CHOSEN})",
    "decision_trail": _TRAIL,
    "decision_trail_head": f"SELECT * FROM ({_TRAIL}) ORDER BY trial LIMIT 12",
    "history_lines": f"""
        SELECT log, trial_index,
               printf('t%02d | %s | AP=%.4f (+-%.4f) | %.1fs', trial_index,
                      '{{"estimator":"' || {_BRANCH} || '",' || {_PARAMS}, mean_score,
                      k / 1000.0::DOUBLE, tenth) AS line
        FROM ({_TRIALS}) WHERE log = 'agent'""",
    "pareto_by_complexity": f"""
        SELECT complexity, round(avg(mean_score), 6) AS cv, round(avg(holdout_ap), 6) AS holdout,
               count(*) AS folds
        FROM ({_EXPRESSIONS}) GROUP BY complexity""",
    "full_coverage_best": f"""
        SELECT complexity, expression, round(cv_mean, 6) AS cv_mean,
               round(holdout_ap, 6) AS holdout_ap, folds_present FROM ({_FULL})""",
    "top_expressions": f"""
        SELECT complexity, round(avg(mean_score), 6) AS cv, count(*) AS folds,
               first(expression ORDER BY mean_score, trial_index DESC) AS expression
        FROM ({_EXPRESSIONS}) GROUP BY complexity ORDER BY avg(mean_score) DESC, complexity LIMIT 8""",
    "latest_expressions": f"""
        SELECT complexity, round(avg(mean_score), 6) AS cv, count(*) AS folds,
               arg_max(expression, trial_index) AS expression
        FROM ({_EXPRESSIONS}) GROUP BY complexity ORDER BY avg(mean_score) DESC, complexity LIMIT 6""",
    "iteration_compare": f"""
        WITH g AS (SELECT iteration, complexity, count(*) AS folds, avg(mean_score) AS cv,
                          avg(holdout_ap) AS holdout, min(event_id) AS first_seen
                   FROM ({_ITERATIONS}) GROUP BY iteration, complexity)
        SELECT iteration, complexity AS best_complexity, folds, round(cv, 6) AS cv,
               round(holdout, 6) AS holdout, peak_cv
        FROM (SELECT * FROM g
              QUALIFY row_number() OVER (PARTITION BY iteration
                                         ORDER BY folds DESC, cv DESC, first_seen) = 1)
        JOIN (SELECT iteration, max(mean_score) AS peak_cv FROM ({_ITERATIONS}) GROUP BY 1)
        USING (iteration)""",
    "reference_rows": f"""
        SELECT log AS arm, round(best_score, 6) AS mean_score FROM ({_FINALS})
        UNION ALL SELECT 'prevalence (no skill)', round(avg(y::DOUBLE), 6) FROM ({_EVENTS})""",
    "leaderboard": f"""
        SELECT arm, round_even(cv_mean, 4) AS cv_mean, round_even(holdout_ap, 4) AS holdout_ap,
               NULL::BIGINT AS folds_present
        FROM ({_ARMS}) WHERE arm <> 'pysr'
        UNION ALL SELECT 'pysr', round_even(cv_mean, 4), round_even(holdout_ap, 4), folds_present
        FROM ({_FULL})""",
    "config_candidates": f"""
        SELECT p_partkey, CASE WHEN logistic THEN 'logistic' ELSE 'random_forest' END AS estimator,
               CASE WHEN logistic THEN {_draw("use_interactions")} < 0.5 END AS use_interactions,
               CASE WHEN logistic THEN
                 round(exp({_draw("C")} * (ln(100::DOUBLE) - ln(0.001::DOUBLE)) + ln(0.001::DOUBLE)), 6)
               END AS C,
               CASE WHEN logistic THEN {_pick("penalty", ["l1", "l2"])} END AS penalty,
               {_whole("n_estimators", 50, 400)}, {_whole("max_depth", 3, 20)},
               {_whole("min_samples_leaf", 1, 20)},
               CASE WHEN NOT logistic THEN {_pick("max_features", ["sqrt", "log2", "all"])} END
                 AS max_features,
               {_pick("class_weight", _CLASS_WEIGHTS)} AS class_weight
        FROM (SELECT p_partkey, {_draw("estimator")} < 0.5 AS logistic FROM part)""",
    "config_validate": f"""
        SELECT p_partkey, reasons = '' AS is_valid, reasons FROM (
          SELECT p_partkey, concat_ws(',', {_if("kind = 4", "estimator")},
            {_if("kind = 1", "use_interactions")},
            {_if("kind < 2 AND NOT (c > 0 AND c <= 100)", "C")},
            {_if("kind < 2 AND p_size % 7 = 0", "penalty")},
            {_if("kind IN (2, 3) AND NOT p_size * 10 BETWEEN 50 AND 400", "n_estimators")},
            {_if("kind IN (2, 3) AND NOT p_size BETWEEN 3 AND 20", "max_depth")},
            {_if("kind IN (2, 3) AND NOT p_size % 23 BETWEEN 1 AND 20", "min_samples_leaf")},
            {_if("kind IN (2, 3) AND p_size % 11 = 0", "max_features")},
            {_if("kind < 4 AND p_size % 13 = 0", "class_weight")}) AS reasons
          FROM (SELECT *, p_partkey % 5 AS kind, (p_retailprice - 900) * (p_size - 1) AS c
                FROM part))""",
    "params_repair": """
        SELECT event_id,
               CASE WHEN event_id % 3 < 2 THEN json_extract_string(props, '$.k')::INTEGER END AS k,
               event_id % 3 = 2 AS rejected
        FROM events""",
    "sensor_rows": f"""
        SELECT variant, n, torques, failures, id_sum, rejected FROM (
          SELECT l_returnflag AS variant, count(*) AS n,
                 count(*) FILTER ({_LINE} % 40 <> 2) AS torques,
                 sum((l_linestatus = 'F')::INTEGER)::BIGINT AS failures, sum({_LINE})::BIGINT AS id_sum
          FROM lineitem WHERE {_LINE} % 40 NOT IN (1, 3) GROUP BY 1)
        FULL JOIN (SELECT l_returnflag AS variant, count(*) AS rejected
                   FROM lineitem WHERE {_LINE} % 40 IN (1, 3) GROUP BY 1) USING (variant)""",
    "log_rejects": f"""
        SELECT log, reason, count(*) AS n,
               CASE WHEN reason = 'none' THEN sum(trial_index)::BIGINT END AS index_sum
        FROM (SELECT log, trial_index, {_REASON} AS reason FROM ({_TRIALS})) GROUP BY log, reason""",
    "committed_logs": f"""
        SELECT log, count(*) AS n, sum(trial_index)::BIGINT AS index_sum,
               round(max(mean_score), 9) AS best, count(*) AS scores,
               count(*) FILTER (log <> 'pysr' AND k % 2 = 0) AS with_c
        FROM ({_TRIALS}) WHERE log <> 'agent' OR trial_index % 2 = 0 GROUP BY log""",
    "log_kinds": f"""
        SELECT CASE WHEN log = 'pysr' THEN 'expression' ELSE 'parametric' END AS kind, count(*) AS n
        FROM ({_TRIALS}) GROUP BY 1""",
    "summary_round_trip": f"""
        SELECT arm, arm AS named, round(cv_mean, 9) AS cv_mean, round(holdout_ap, 9) AS holdout_ap,
               NULL::BIGINT AS folds_present FROM ({_ARMS})""",
    "whole_params": f"""
        SELECT trial_index, {_BRANCH} AS estimator, '{{' || {_ODD} AS params,
               printf('t%02d | %s | AP=%.4f (+-%.4f) | %.1fs', trial_index,
                      '{{"estimator":"' || {_BRANCH} || '",' || {_ODD}, mean_score,
                      k / 1000.0::DOUBLE, tenth) AS line
        FROM ({_TRIALS}) WHERE log = 'agent'""",
    "best_configurations": f"""
        SELECT log, trial_index, mean_score,
               '{{"estimator":"' || {_BRANCH} || '",'
               || CASE WHEN log = 'optuna_seed1' THEN replace({_PARAMS}, '"none"', '"no"') ELSE {_PARAMS} END AS params,
               CASE WHEN log = 'optuna_seed1' THEN 'class_weight' ELSE '' END AS reasons
        FROM ({_FIRST_BEST}) WHERE log <> 'pysr'""",
    "live_leaderboard": f"""
        SELECT log, count(*) AS n, max(mean_score) AS best_score,
               first(trial_index ORDER BY mean_score DESC, trial_index) AS best_index
        FROM ({_TRIALS}) GROUP BY log""",
    "logistic_first_step": _first_step(),
    "rule_record": f"""
        SELECT 'ground_truth_rules' AS arm, fold, round(ap, 9) AS ap,
               round(avg(ap) OVER (), 9) AS mean_score, round(stddev_pop(ap) OVER (), 9) AS std_score
        FROM ({_ap(f"SELECT fold, (n_words > 400)::INTEGER AS score, toxic AS y FROM ({_SEARCH})",
                   ["fold"], 15)})""",
    "rule_holdout_entry": f"""
        SELECT 'ground_truth_rules' AS arm, ap AS holdout_ap, '{{"expression":"hdf | pwf | osf"}}' AS best_params
        FROM ({_ap(f"SELECT (n_words > 400)::INTEGER AS score, toxic AS y "
                   f"FROM ({_SPLIT_DOCUMENTS}) WHERE is_holdout", [])})""",
    "environment_round_trip": " UNION ALL ".join(
        f"SELECT 1::INTEGER AS threads, '2026-01-02 03:04' AS at, '{n}' AS name, "
        f"count(*)::VARCHAR AS rows FROM {n}"
        for n in ("documents", "events", "labels")
    ),
}
