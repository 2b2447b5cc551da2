"""The queries of this subpackage and their SQL."""

from factloom.llm import decontam, katz, language, linechunks, packing, secrets, simhash, substrings, topk, toxicity

QUERIES = {
    f.__name__: f
    for f in (
        secrets.op1_crf_secrets,
        topk.op2_norm_bucket_topk,
        simhash.op3_simhash_bktree,
        language.op4_segmentation_langid,
        substrings.op5_lpf_dedup,
        linechunks.op6_line_chunk_dedup,
        packing.op7_best_fit_packing,
        toxicity.op8_cnn_toxicity,
        katz.op9_katz_scoring,
        decontam.op10_lsa_decontamination,
    )
}
SQL = {"op2_norm_bucket_topk": topk.SQL, "op6_line_chunk_dedup": linechunks.SQL}
