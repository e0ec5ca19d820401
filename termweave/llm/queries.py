"""The queries of this subpackage and, where SQL can express one, its SQL."""

from . import ann, bpe, chat, jaccard, licences, linededup, minhash, mixing, nra, pii, quality, trie, urls

QUERIES = {
    "op1_bpe": bpe.op1_bpe,
    "op2_url_filter": urls.op2_url_filter,
    "op3_chat": chat.op3_chat,
    "op4_mixing": mixing.op4_mixing,
    "op5_ngram_jaccard": jaccard.op5_ngram_jaccard,
    "op6_line_dedup": linededup.op6_line_dedup,
    "op7_host_quality": quality.op7_host_quality,
    "op8_permutation_index": ann.op8_permutation_index,
    "op9_pii": pii.op9_pii,
    "op10_licences": licences.op10_licences,
    "op10_licence_texts": licences.op10_licence_texts,
    "op11_hyperminhash": minhash.op11_hyperminhash,
    "op12_nra_search": nra.op12_nra_search,
    "op13_prefix_trie": trie.op13_prefix_trie,
}
ORACLE_SQL = {"op3_chat": chat.ORACLE_SQL, "op5_ngram_jaccard": minhash.LINKS_SQL.format(percent=80, more=""), "op11_hyperminhash": minhash.ORACLE_SQL, "op6_line_dedup": linededup.ORACLE_SQL, "op7_host_quality": quality.ORACLE_SQL, "op10_licences": licences.ORACLE_SQL, "op12_nra_search": nra.ORACLE_SQL, "op13_prefix_trie": trie.ORACLE_SQL}
