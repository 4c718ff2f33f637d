"""Registered queries of this folder and the SQL that checks them."""

from __future__ import annotations

from beatloom.llm import decontaminate, licenses, line_runs, packing, pii, projections, resample, secrets, simhash, token_files, toxicity, warc, whitening

QUERIES = {
    "op1_pii_spans": pii.op1_pii_spans,
    "op2_warc_bundles": warc.op2_warc_bundles,
    "op3_toxicity_scores": toxicity.op3_toxicity_scores,
    "op4_simhash_groups": simhash.op4_simhash_groups,
    "op5_license_rules": licenses.op5_license_rules,
    "op6_simple8b_ids": token_files.op6_simple8b_ids,
    "op7_benchmark_passages": decontaminate.op7_benchmark_passages,
    "op8_mixture_packing": packing.op8_mixture_packing,
    "op9_projection_groups": projections.op9_projection_groups,
    "op10_secret_spans": secrets.op10_secret_spans,
    "op11_line_runs": line_runs.op11_line_runs,
    "op12_importance_draw": resample.op12_importance_draw,
    "op13_whitened_vectors": whitening.op13_whitened_vectors,
}

ORACLES = {"op2_warc_bundles": warc.OP2_SQL, "op9_projection_groups": projections.OP9_SQL, "op11_line_runs": line_runs.OP11_SQL}
