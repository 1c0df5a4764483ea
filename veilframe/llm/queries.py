"""Queries of the training-data operators and, where SQL can say it, their SQL."""

from __future__ import annotations

from . import bpe, html_text, imatch, mixing, pii, quality, secret_scan, sharding, simhash, toxicity

QUERIES = {
    f.__name__: f
    for f in (
        sharding.op1_hilbert_sharding,
        quality.op2_quality_divergence,
        mixing.op3_mixing_flow,
        html_text.op4_html_layout,
        bpe.op5_byte_bpe,
        pii.op6_pii_surrogates,
        toxicity.op7_toxicity,
        simhash.op8_simhash_golay,
        imatch.op9_imatch,
        secret_scan.op10_secret_scan,
    )
}

ORACLE_SQL = {
    "op1_hilbert_sharding": sharding.oracle(),
    "op2_quality_divergence": quality.oracle(),
    "op3_mixing_flow": mixing.oracle(),
}
