"""The queries of this folder and, where SQL can express them, their DuckDB statements."""

from millrace.llm import counts, exact, langid, leaks, licenses, pieces, pll, shards, superminhash, warc

QUERIES = {
    f.__name__: f
    for f in (
        leaks.op1_decontaminate,
        exact.op2_exact_dedup,
        pll.op3_pseudo_likelihood,
        warc.op4_warc,
        superminhash.op5_near_dedup,
        licenses.op6_license_scan,
        langid.op7_language_id,
        counts.op8_token_counts,
        pieces.op9_sentencepiece,
        shards.op10_shard_lpt,
    )
}
ORACLE = {"op2_exact_dedup": exact.SQL, "op4_warc": warc.SQL}
