"""Queries of the training-data operators and their SQL."""

from . import chat_format, clustering, decontamination, line_templates, substrings, url_filter
from .chat_format import op2_role_machine
from .clustering import op11_dual_tree
from .decontamination import op3_prefix_join
from .fingerprints import op8_bottom_k
from .language import op7_hierarchical
from .line_templates import op4_template_tree
from .mixing import op6_soft_mixing
from .near_duplicates import op9_hyperminhash
from .private_data import op1_disclosure
from .substrings import op13_super_kmers
from .token_files import op10_direct_codes
from .url_filter import op5_bloom_cascade
from .whitening import op12_two_pass

QUERIES = {
    "op1_disclosure": op1_disclosure,
    "op2_role_machine": op2_role_machine,
    "op3_prefix_join": op3_prefix_join,
    "op4_template_tree": op4_template_tree,
    "op5_bloom_cascade": op5_bloom_cascade,
    "op6_soft_mixing": op6_soft_mixing,
    "op7_hierarchical": op7_hierarchical,
    "op8_bottom_k": op8_bottom_k,
    "op9_hyperminhash": op9_hyperminhash,
    "op10_direct_codes": op10_direct_codes,
    "op11_dual_tree": op11_dual_tree,
    "op12_two_pass": op12_two_pass,
    "op13_super_kmers": op13_super_kmers,
}
ORACLE_SQL: dict[str, str] = {
    "op2_role_machine": chat_format.SQL,
    "op3_prefix_join": decontamination.SQL,
    "op4_template_tree": line_templates.SQL,
    "op5_bloom_cascade": url_filter.SQL,
    "op11_dual_tree": clustering.SQL,
    "op13_super_kmers": substrings.SQL,
}
