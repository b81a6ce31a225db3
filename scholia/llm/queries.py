"""The queries of this subpackage, and SQL for those that SQL expresses."""

from __future__ import annotations

from scholia.llm import chroma, html, langid, mixing, packing, pii, resample, search, simhash, toxicity, urls, variants, warc

QUERIES = {
    "op1_simhash": simhash.op1_simhash,
    "op2_html": html.op2_html,
    "op3_toxicity": toxicity.op3_toxicity,
    "op4_packing": packing.op4_packing,
    "op5_chroma": chroma.op5_chroma,
    "op6_search": search.op6_search,
    "op7_pii": pii.op7_pii,
    "op8_mixing": mixing.op8_mixing,
    "op9_warc": warc.op9_warc,
    "op10_langid": langid.op10_langid,
    "op11_resample": resample.op11_resample,
    "op12_variants": variants.op12_variants,
    "op13_urls": urls.op13_urls,
}
ORACLES = {
    "op8_mixing": mixing.ORACLE,
    "op9_warc": warc.ORACLE,
    "op11_resample": resample.ORACLE,
    "op12_variants": variants.ORACLE,
}
