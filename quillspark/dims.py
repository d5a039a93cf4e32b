"""Fixed values of the domain: ordered vocabularies, section and layout tables, thresholds.

Order carries meaning wherever the first match wins.
"""

from __future__ import annotations

# Label section, its code, the layout it belongs to.
SECTIONS = [
    ("contraindications", "34070-3", "contraindication"),
    ("warnings_and_cautions", "43685-7", "warning"),
    ("warnings", "34071-1", "warning"),
    ("boxed_warning", "34071-1", "warning"),
    ("adverse_reactions", "34084-4", "warning"),
    ("drug_interactions", "34073-7", "interaction"),
    ("indications_and_usage", "34067-9", "indication"),
    ("use_in_specific_populations", "34082-8", "indication"),
    ("clinical_pharmacology", "34090-1", "pharmacology"),
    ("description", "34089-3", "pharmacology"),
    ("patient_counseling_information", "42229-5", "patient_info"),
    ("dosage_and_administration", "34068-7", "dosing"),
    ("dosage_forms_and_strengths", "34069-5", "dosing"),
    ("overdosage", "34088-4", "warning"),
    ("mechanism_of_action", "34067-9", "pharmacology"),
    ("pharmacodynamics", "43682-4", "pharmacology"),
    ("pharmacokinetics", "43682-4", "pharmacology"),
    ("pregnancy", "34077-8", "indication"),
    ("pediatric_use", "34080-2", "dosing"),
    ("geriatric_use", "34081-0", "indication"),
]

# Risk of paraphrasing each layout, the default, the surcharge of boxed warnings, the verbatim threshold.
LAYOUT_RISK = [
    ("dosing", 0.95),
    ("contraindication", 0.90),
    ("interaction", 0.85),
    ("warning", 0.80),
    ("indication", 0.75),
    ("patient_info", 0.65),
    ("pharmacology", 0.45),
    ("references", 0.20),
    ("label_metadata", 0.10),
    ("cluster_summary", 0.30),
]
DEFAULT_RISK, BOXED_SURCHARGE, VERBATIM_RISK = 0.50, 0.05, 0.70

# The layouts that may hold dose facts, and the chunking limits.
FACT_LAYOUTS = ["dosing", "indication", "warning", "interaction", "pharmacology"]
DOSE_LAYOUTS = ["dosing", "structured_fact"]
MIN_CHUNK, MAX_CHUNK, MIN_FACT = 80, 1000, 30

# Administration routes and patient populations by keyword; the first label with a hit wins.
ROUTES = [
    ("oral", ["orally", "oral", "by mouth", "po ", "tablet", "capsule"]),
    ("intravenous", ["intravenous", "iv ", "i.v.", "infusion", "injection"]),
    ("subcutaneous", ["subcutaneous", "sc ", "s.c.", "subcut"]),
    ("intramuscular", ["intramuscular", "im ", "i.m."]),
    ("inhaled", ["inhaled", "inhalation", "inhaler"]),
    ("topical", ["topical", "apply", "cream", "ointment", "patch"]),
]
POPULATIONS = [
    ("pediatric", ["pediatric", "children", "child", "infant", "neonatal", "age <"]),
    ("elderly", ["elderly", "geriatric", "older adult", "age ≥65", "age >=65"]),
    ("renal_impairment", ["renal impairment", "renal failure", "kidney", "ckd", "creatinine clearance"]),
    ("hepatic_impairment", ["hepatic impairment", "liver", "hepatic failure", "child-pugh"]),
    ("pregnancy", ["pregnan", "lactation", "breastfeed", "nursing"]),
]

# Units of recorded doses, longest alternatives first; units of laboratory values.
DOSE_UNITS = ["mg/kg", "mg/m2", "mcg/kg", "mg", "mcg", "g", "units?/kg", "mEq", "mL"]
LAB_UNITS = ["mg/dl", "mg/l", "mmol/l", "meq/l", "g/dl"]
DOSE_CONTEXT = ["dose", "dosing", "administer", "take", "give", "start", "initiat", "titrat", "receiv", "treat", "recommended", "prescri"]

# Words that set the type of a question, in order of priority.
SIGNALS = [
    ("causal", ["why", "cause", "mechanism", "reason", "because", "interaction", "interact", "combined with", "together with", "due to", "serotonin syndrome", "contraindicated", "avoid"]),
    ("comparative", ["compare", "vs", "versus", "difference", "alternative", "instead", "better", "preferred", "first-line", "second-line", "relative"]),
    ("strategic", ["overall", "general", "profile", "class", "all", "typical", "commonly", "safety", "efficacy", "overview", "summary"]),
]
PAIRING_WORDS = ["with", "together", "combine", "and"]

# Concept words of a question, the layout they ask for, the population they imply.
CONCEPTS = [
    ("dose", "dosing", None),
    ("dosage", "dosing", None),
    ("dosing", "dosing", None),
    ("how much", "dosing", None),
    ("how often", "dosing", None),
    ("contraindication", "contraindication", None),
    ("contraindicated", "contraindication", None),
    ("avoid", "contraindication", None),
    ("interaction", "interaction", None),
    ("interact", "interaction", None),
    ("interacts", "interaction", None),
    ("combine", "interaction", None),
    ("together", "interaction", None),
    ("side effect", "warning", None),
    ("adverse", "warning", None),
    ("warning", "warning", None),
    ("safe", "warning", None),
    ("indication", "indication", None),
    ("approved for", "indication", None),
    ("treats", "indication", None),
    ("mechanism", "pharmacology", None),
    ("how does", "pharmacology", None),
    ("works by", "pharmacology", None),
    ("renal", "dosing", "renal_impairment"),
    ("kidney", "dosing", "renal_impairment"),
    ("hepatic", "dosing", "hepatic_impairment"),
    ("liver", "dosing", "hepatic_impairment"),
    ("pediatric", "dosing", "pediatric"),
    ("children", "dosing", "pediatric"),
    ("elderly", "dosing", "elderly"),
    ("pregnancy", "contraindication", "pregnancy"),
    ("pregnant", "contraindication", "pregnancy"),
    ("lactation", "contraindication", "pregnancy"),
    ("breastfeed", "contraindication", "pregnancy"),
    ("nursing", "contraindication", "pregnancy"),
]
DEFAULT_LAYOUTS = ["dosing", "warning", "indication"]

# Loose population patterns of a question, in order.
POPULATION_PATTERNS = [
    (r"kid(s|do|dos)?|child(ren)?|paed|pedi(atric)?|infant|neonat|baby|babies", "pediatric"),
    (r"elder(ly)?|geriatric|older adult|senior|age\s*[≥>]=?\s*65", "elderly"),
    (r"renal|kidney|ckd|egfr|gfr|creatinine|nephro", "renal_impairment"),
    (r"hepat|liver|child.pugh|cirr|jaundic", "hepatic_impairment"),
    (r"pregnan|lact|breastfeed|nursing|obstetric", "pregnancy"),
    (r"obes|bmi\s*[>≥]\s*3", "obese"),
]

# Abbreviations and what they stand for, applied in order.
ABBREVIATIONS = [
    ("ckd", "chronic kidney disease renal impairment"),
    ("hf", "heart failure"),
    ("mi", "myocardial infarction"),
    ("afib", "atrial fibrillation"),
    ("dm", "diabetes mellitus"),
    ("htn", "hypertension"),
    ("peds", "pediatric children"),
    ("po", "oral by mouth"),
    ("iv", "intravenous"),
    ("sc", "subcutaneous"),
    ("tid", "three times daily"),
    ("bid", "twice daily"),
    ("qd", "once daily"),
    ("prn", "as needed"),
    ("max", "maximum"),
    ("min", "minimum"),
    ("ped", "pediatric"),
    ("egfr", "estimated glomerular filtration rate renal function"),
    ("gfr", "glomerular filtration rate"),
    ("nsaid", "non-steroidal anti-inflammatory drug"),
    ("ssri", "selective serotonin reuptake inhibitor"),
    ("maoi", "monoamine oxidase inhibitor"),
    ("ace", "angiotensin converting enzyme inhibitor"),
    ("arb", "angiotensin receptor blocker"),
]

# Phrases that mean the same.
SYNONYMS = [
    ["mi", "myocardial infarction", "heart attack"],
    ["ckd", "chronic kidney disease", "renal impairment", "renal failure"],
    ["htn", "hypertension", "high blood pressure"],
    ["dm", "diabetes mellitus", "diabetes"],
    ["gi", "gastrointestinal"],
    ["cns", "central nervous system"],
    ["cv", "cardiovascular"],
    ["ae", "adverse event", "side effect", "adverse reaction"],
    ["bb", "beta blocker", "beta-blocker"],
    ["ace", "ace inhibitor", "angiotensin converting enzyme inhibitor"],
    ["arb", "angiotensin receptor blocker"],
    ["ssri", "selective serotonin reuptake inhibitor"],
    ["maoi", "monoamine oxidase inhibitor"],
    ["nsaid", "non-steroidal anti-inflammatory drug"],
    ["po", "oral", "by mouth"],
    ["iv", "intravenous", "intravenously"],
    ["sc", "subcutaneous", "subcutaneously"],
    ["qd", "once daily", "once a day"],
    ["bid", "twice daily", "twice a day"],
    ["tid", "three times daily"],
    ["qid", "four times daily"],
    ["prn", "as needed"],
]

# Layouts to fall back to when a layout yields too little.
FALLBACK_LAYOUTS = {
    "dosing": ["warning", "indication", "pharmacology"],
    "contraindication": ["warning", "interaction"],
    "interaction": ["warning", "pharmacology"],
    "warning": ["indication", "pharmacology"],
    "indication": ["dosing", "warning"],
    "pharmacology": ["indication", "warning"],
    "structured_fact": ["dosing", "warning"],
}
LAST_FALLBACK = ["warning"]

# Thresholds and weights of retrieval and reflection.
MAX_ROUNDS, MIN_HITS, MIN_SCORE, MIN_DOSE_EVIDENCE, RECENT_YEARS, FEW_FOR_POPULATION = 3, 3, 0.38, 2, 3, 1
TITRATED_POPULATIONS = ["renal_impairment", "hepatic_impairment", "pediatric", "elderly"]
TEXT_BOOST, VECTOR_BOOST, RECENCY_BOOST = 1.2, 1.0, 0.8
FIELD_WEIGHTS = {"text": 1.0, "generic": 3.0, "brand": 2.5}
BM25_K1, BM25_B = 1.2, 0.75
CONFLICT_SHARE, MISQUOTE_OVERLAP = 0.15, 0.08
