"""The operators' queries by name, and their SQL where SQL can express them."""

from . import ann, chat, fim, heavy, katz, leaks, mixing, neardup, ogg, packing, repeats, toxicity, warc

QUERIES = {
    "op1_warc": warc.query,
    "op2_mixing": mixing.query,
    "op3_chat": chat.query,
    "op4_ann": ann.query,
    "op5_neardup": neardup.query,
    "op6_repeats": repeats.query,
    "op7_ogg": ogg.query,
    "op8_toxicity": toxicity.query,
    "op9_packing": packing.query,
    "op10_katz": katz.query,
    "op11_fim": fim.query,
    "op12_heavy": heavy.query,
    "op13_leaks": leaks.query,
}

SQL = {
    "op1_warc": warc.SQL,
    "op2_mixing": mixing.SQL,
    "op3_chat": chat.SQL,
    "op5_neardup": neardup.SQL,
    "op6_repeats": repeats.SQL,
    "op11_fim": fim.SQL,
    "op13_leaks": leaks.SQL,
}
