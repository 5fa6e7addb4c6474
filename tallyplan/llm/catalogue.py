"""Queries of the corpus operators."""

from tallyplan.llm import oracle
from tallyplan.llm.decontaminate import op2_decontaminate
from tallyplan.llm.html_text import op8_html_text
from tallyplan.llm.language_id import op9_language_id
from tallyplan.llm.licenses import op12_license_scans
from tallyplan.llm.merkle import op13_merkle_manifest
from tallyplan.llm.packing import op6_packing
from tallyplan.llm.pii import op7_pii
from tallyplan.llm.quality_classifier import op10_quality_classifier
from tallyplan.llm.quality_rules import op3_quality_rules
from tallyplan.llm.simhash import op5_simhash
from tallyplan.llm.suffix_array import op4_suffix_array
from tallyplan.llm.suffix_tree import op1_suffix_tree
from tallyplan.llm.whitening import op11_whitening


def pipeline(spark, sf_dir):
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {
    "op1_suffix_tree": op1_suffix_tree,
    "op2_decontaminate": op2_decontaminate,
    "op3_quality_rules": op3_quality_rules,
    "op4_suffix_array": op4_suffix_array,
    "op5_simhash": op5_simhash,
    "op6_packing": op6_packing,
    "op7_pii": op7_pii,
    "op8_html_text": op8_html_text,
    "op9_language_id": op9_language_id,
    "op10_quality_classifier": op10_quality_classifier,
    "op11_whitening": op11_whitening,
    "op12_license_scans": op12_license_scans,
    "op13_merkle_manifest": op13_merkle_manifest,
    "pipeline": pipeline,
}

ORACLE_SQL: dict[str, str] = {"op1_suffix_tree": oracle.OP1, "op4_suffix_array": oracle.OP4, "op13_merkle_manifest": oracle.OP13}
