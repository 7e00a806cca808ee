"""Named queries of the operators, each over its whole table, and their SQL where SQL can express them."""

from __future__ import annotations

from newstape.llm import (
    ann,
    bpe,
    decontaminate,
    fill_middle,
    lm_scoring,
    packing,
    periodic,
    quality,
    simhash,
    suffix_dedup,
    toxicity,
    url_filter,
    warc,
)

QUERIES = {
    "op1_lm_score": lm_scoring.op1_lm_score,
    "op2_url_filter": url_filter.op2_url_filter,
    "op3_quality": quality.op3_quality,
    "op4_nearest": ann.op4_nearest,
    "op5_warc": warc.op5_warc,
    "op6_simhash": simhash.op6_simhash,
    "op7_pack": packing.op7_pack,
    "op8_decontaminate": decontaminate.op8_decontaminate,
    "op9_suffix_dedup": suffix_dedup.op9_suffix_dedup,
    "op10_bpe": bpe.op10_bpe,
    "op11_periodic_runs": periodic.op11_periodic_runs,
    "op12_fill_in_middle": fill_middle.op12_fill_in_middle,
    "op13_toxicity": toxicity.op13_toxicity,
}

ORACLES = {
    "op1_lm_score": lm_scoring.OP1_SQL,
    "op2_url_filter": url_filter.OP2_SQL,
    "op5_warc": warc.OP5_SQL,
    "op12_fill_in_middle": fill_middle.OP12_SQL,
}
