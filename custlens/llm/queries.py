"""Registers this subpackage's queries."""

from __future__ import annotations

from custlens.llm.bpe import op3
from custlens.llm.gru_lm import op7
from custlens.llm.licenses import op9
from custlens.llm.packing import op6
from custlens.llm.probminhash import op10
from custlens.llm.quality_cnn import op2
from custlens.llm.quality_rules import op4
from custlens.llm.registry import register
from custlens.llm.rns_mining import op13
from custlens.llm.spelling import op11
from custlens.llm.substring import op8
from custlens.llm.url_cascade import op12
from custlens.llm.warc import op1
from custlens.llm.winnow import op5

register("op1_warc")(op1)
register("op2_quality_cnn")(op2)
register("op3_bpe")(op3)
register("op4_quality_rules")(op4)
register("op5_winnowing")(op5)
register("op6_packing")(op6)
register("op7_gru_lm")(op7)
register("op8_substring_dedup")(op8)
register("op9_licenses")(op9)
register("op10_probminhash")(op10)
register("op11_spelling")(op11)
register("op12_url_cascade")(op12)
register("op13_rns_mining")(op13)
