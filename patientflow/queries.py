"""The registry of the core's queries and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import functions as F

from .functions import tokens
from .operators import cdm, cohort, derive, intervals, labstats, metrics, omop, pack, privacy, probe, references, sampling, sequences, splits, tte, vocab
from .sources import tables
from .streaming import visits

#: Columns that depend on the order of floating-point additions, rounded to six places on both sides.
ROUNDED = {
    "lab_numeric_stats": "mean std", "lab_trimmed_stats": "mean std", "lab_stats_merge": "mean std", "vocabulary_expand_stats": "mean std", "unit_distribution": "p", "causal_age_probabilities": "prob adjusted_prob",
    "nn_distance": "dist", "nn_self_distance": "dist", "membership_metrics": "accuracy precision recall f1", "nnaa_privacy_loss": "aa_train aa_test privacy_loss", "attribute_inference_f1": "precision recall f1", "majority_attributes": "prevalence",
    "reid_risk": "a_term b_term", "tte_summary": "average_time median_time standard_deviation event_probability", "tte_time_buckets": "probability", "tte_cumulative": "probability cumulative", "pack_estimate": "mean_length",
    "top_k_next": "p", "top_p_next": "p", "top_mix_next": "p", "beam_next": "p", "attribute_inference_configured": "precision recall f1", "temperature_next": "p", "epsilon_next": "p", "penalty_next": "p", "aligned_metrics": "value_a value_b", "roc_auc": "roc_auc", "prediction_table": "predicted_boolean_probability", "pr_auc": "pr_auc",
    "classification_metrics": "accuracy precision recall f1", "event_windows": "total",
}
#: Sums of integers, which the SQL side would widen.
COUNTS = {"lab_bin_assign": "n", "lab_stats_merge": "n", "lattice_counts": "n_unique", "tte_first_hit": "days", "packing_totals": "n_tokens", "unpad_offsets": "n_kept", "block_mask_counts": "n_pairs"}


def _rounded(f: Callable, columns: list[str]) -> Callable:
    return lambda spark, sf_dir: f(spark, sf_dir).withColumns({c: F.round(c, 6) for c in columns})


QUERIES = {**references.QUERIES, **intervals.QUERIES}
SQL = {**references.SQL, **intervals.SQL}
for _m in (derive, tables, tokens, sequences, omop, cdm, vocab, labstats, splits, cohort, privacy, tte, pack, sampling, metrics, probe, visits):
    QUERIES |= _m.R.queries
    SQL |= _m.R.sql
for _n in {*ROUNDED, *COUNTS}:
    _d, _c = ROUNDED.get(_n, "").split(), COUNTS.get(_n, "").split()
    QUERIES[_n] = _rounded(QUERIES[_n], _d) if _d else QUERIES[_n]
    SQL[_n] = f"SELECT * REPLACE ({', '.join([f'round({c}, 6) AS {c}' for c in _d] + [f'CAST({c} AS BIGINT) AS {c}' for c in _c])}) FROM ({SQL[_n]})"
