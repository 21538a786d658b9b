"""The registered queries of the corpus operators, and SQL for those that have some."""

from halyard.llm.brown import op6_brown_lm
from halyard.llm.decontaminate import OP8_SQL, op8_decontamination
from halyard.llm.html_text import op3_html
from halyard.llm.langid import op2_langid
from halyard.llm.mixing import OP9_SQL, op9_mixing
from halyard.llm.quality import op4_quality
from halyard.llm.repair_ids import op10_token_ids
from halyard.llm.sharding import op7_sharding
from halyard.llm.simhash import op1_simhash
from halyard.llm.warc import OP5_SQL, op5_warc

QUERIES = {
    "op1_simhash": op1_simhash,
    "op2_langid": op2_langid,
    "op3_html": op3_html,
    "op4_quality": op4_quality,
    "op5_warc": op5_warc,
    "op6_brown_lm": op6_brown_lm,
    "op7_sharding": op7_sharding,
    "op8_decontamination": op8_decontamination,
    "op9_mixing": op9_mixing,
    "op10_token_ids": op10_token_ids,
}
ORACLE_SQL: dict[str, str] = {"op5_warc": OP5_SQL, "op8_decontamination": OP8_SQL, "op9_mixing": OP9_SQL}
