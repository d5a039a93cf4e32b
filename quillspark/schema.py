"""Schemas of the tables the engine reads and writes."""

from __future__ import annotations

from quillspark import dims

#: Chunks and dose facts; partition the table by ``layout_type``, which every pool filters on.
ARTIFACT = (
    "urn_id string, parent_urn string, set_id string, rxcui string, layout_type string, verbatim_text string, chunk_confidence double, raglens_risk double, "
    "label_version_date date, published_date date, drug_name_generic string, drug_name_brand array<string>, atc_code string, smpc_section_code string, boxed_warning boolean, "
    "regulatory_source string, dose_values array<double>, dose_units array<string>, dose_route string, patient_population string, "
    "interaction_ids array<string>, table_ref array<string>, raptor_cluster string"
)
INDEX = ARTIFACT + ", content_vector array<float>, token_vecs array<array<float>>, fde array<float>"

_SECTIONS = ", ".join(f"{name}: array<string>" for field, _, _ in dims.SECTIONS for name in (field, f"{field}_table"))
#: One label answer: its result holds an array of text per section, and perhaps one of HTML tables.
LABEL_RESULT = f"struct<set_id: string, effective_time: string, openfda: struct<generic_name: array<string>, brand_name: array<string>, application_number: array<string>, is_original_packager: array<boolean>>, {_SECTIONS}>"
LABEL_RESPONSE = f"results array<{LABEL_RESULT}>"
CONCEPT_RESPONSE = "idGroup struct<rxnormId: array<string>>"
CLASS_RESPONSE = "rxclassDrugInfoList struct<rxclassDrugInfo: array<struct<rxclassMinConceptItem: struct<classId: string>>>>"
INGEST_LOG = "set_id string, drug_generic string, n_docs long, completed_at timestamp"
LOG_LINE = "ts timestamp, level string, logger string, message string, fields map<string,string>"
