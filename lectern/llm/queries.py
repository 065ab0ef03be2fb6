"""Queries of the training-data operators, with SQL where SQL can express them."""

from lectern.llm import bpe, decontaminate, exact_dedup, langid, quality, secrets, simhash, substring, warc, wavelet

QUERIES = {
    "op1_simhash_golay": simhash.query,
    "op10_template_decontamination": decontaminate.query,
    "op2_warc_derivatives": warc.query,
    "op3_substring_automata": substring.query,
    "op4_bpe_codec": bpe.query,
    "op5_secret_scan": secrets.query,
    "op6_wavelet_tokens": wavelet.query,
    "op7_ppm_language": langid.query,
    "op8_quality_trees": quality.query,
    "op9_exact_dedup": exact_dedup.query,
}

ORACLE_SQL = {
    "op3_substring_automata": substring.ORACLE_SQL,
    "op5_secret_scan": secrets.ORACLE_SQL,
    "op10_template_decontamination": decontaminate.ORACLE_SQL,
    "op9_exact_dedup": exact_dedup.ORACLE_SQL,
}
