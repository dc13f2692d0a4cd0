"""The queries of this subpackage, by name, and the SQL that some of them are held against."""

from tidemark.llm import decontam, exact_dedup, jaccard_join, langid, lm_score, mixing, quality, substring_dedup, toxicity, warc

QUERIES = {
    "op1_exact_dedup": exact_dedup.op1_exact_dedup,
    "op2_quality": quality.op2_quality,
    "op3_mixing": mixing.op3_mixing,
    "op4_substring_dedup": substring_dedup.op4_substring_dedup,
    "op5_warc": warc.op5_warc,
    "op6_decontamination": decontam.op6_decontamination,
    "op7_lm_score": lm_score.op7_lm_score,
    "op8_langid": langid.op8_langid,
    "op9_toxicity": toxicity.op9_toxicity,
    "op10_jaccard_join": jaccard_join.op10_jaccard_join,
}
ORACLES = exact_dedup.ORACLE | mixing.ORACLE | substring_dedup.ORACLE | warc.ORACLE | decontam.ORACLE | jaccard_join.ORACLE
