"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from millrace.llm import html, imatch, importance, langid, licenses, minhash, mixing, packing, pii, sstable, substrings, treap, vectors

QUERIES = {
    "op1_mixing": mixing.op1_mixing,
    "op2_imatch": imatch.op2_imatch,
    "op3_substrings": substrings.op3_substrings,
    "op4_vectors": vectors.op4_vectors,
    "op5_langid": langid.op5_langid,
    "op6_packing": packing.op6_packing,
    "op7_html": html.op7_html,
    "op8_pii": pii.op8_pii,
    "op9_minhash": minhash.op9_minhash,
    "op10_sstable": sstable.op10_sstable,
    "op11_resampling": importance.op11_resampling,
    "op12_search": treap.op12_search,
    "op13_licenses": licenses.op13_licenses,
}
SQL = {
    "op1_mixing": mixing.OP1_SQL,
    "op2_imatch": imatch.OP2_SQL,
    "op3_substrings": substrings.OP3_SQL,
    "op4_vectors": vectors.OP4_SQL,
    "op9_minhash": minhash.OP9_SQL,
    "op11_resampling": importance.OP11_SQL,
    "op12_search": treap.OP12_SQL,
}
