"""The registered queries of the operators and, where SQL can say it, their checks."""

from __future__ import annotations

from touchline.llm.alignment import op12_alignment
from touchline.llm.bag_ranking import OP11_SQL, op11_bag_ranking
from touchline.llm.decontaminate import OP5_SQL, op5_decontaminate
from touchline.llm.language import op4_language
from touchline.llm.licenses import op2_licenses
from touchline.llm.media import op7_media
from touchline.llm.mixing import OP8_SQL, op8_mixing, op8_mixing_shards
from touchline.llm.recompression import OP13_SQL, op13_recompression
from touchline.llm.secrets import op6_secrets
from touchline.llm.sharding import OP1_SQL, op1_sharding
from touchline.llm.simhash import op9_simhash
from touchline.llm.toxicity import op3_toxicity
from touchline.llm.warc import OP10_SQL, op10_warc

QUERIES = {
    "op1_sharding": op1_sharding,
    "op2_licenses": op2_licenses,
    "op3_toxicity": op3_toxicity,
    "op4_language": op4_language,
    "op5_decontaminate": op5_decontaminate,
    "op6_secrets": op6_secrets,
    "op7_media": op7_media,
    "op8_mixing": op8_mixing,
    "op8_mixing_shards": op8_mixing_shards,
    "op9_simhash": op9_simhash,
    "op10_warc": op10_warc,
    "op11_bag_ranking": op11_bag_ranking,
    "op12_alignment": op12_alignment,
    "op13_recompression": op13_recompression,
}
ORACLES: dict[str, str] = {
    "op1_sharding": OP1_SQL,
    "op5_decontaminate": OP5_SQL,
    "op8_mixing": OP8_SQL,
    "op10_warc": OP10_SQL,
    "op11_bag_ranking": OP11_SQL,
    "op13_recompression": OP13_SQL,
}
