"""Queries of the training-data operators, by name, and their DuckDB SQL where SQL can express them."""

from lumengrid.llm import chat, langid, linededup, media, packing, resampling, secrets, sentencepiece, sharding, simhash, topk, toxicity, whitening

QUERIES = {
    "op1_sentencepiece": sentencepiece.query,
    "op2_sharding": sharding.query,
    "op3_secrets": secrets.query,
    "op4_topk": topk.query,
    "op5_simhash": simhash.query,
    "op6_packing": packing.query,
    "op7_toxicity": toxicity.query,
    "op8_langid": langid.query,
    "op9_chat": chat.query,
    "op10_media": media.query,
    "op11_linededup": linededup.query,
    "op12_whitening": whitening.query,
    "op13_resampling": resampling.query,
}

SQL = {"op4_topk": topk.SQL, "op9_chat": chat.SQL, "op11_linededup": linededup.SQL, "op13_resampling": resampling.SQL}
