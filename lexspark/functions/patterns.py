"""Fixed values that must equal the reference for identical results.

Everything below is a fixed value (patterns, keywords, replacement tokens,
template texts, markers), written out in the reference's natural order.
Java regex flags are added where Python's defaults differ:
``(?s)`` = DOTALL, ``(?i)(?u)`` = Unicode-aware IGNORECASE (Python's default
for str patterns). Python's ``\\s`` also covers NBSP, U+2003, ``\\x85`` and
``\\x1c``-``\\x1f``; the class ``WS`` spells that set out so the same text
works in Java and in RE2.
"""

# ---------------------------------------------------------------- fixed values
# Whitespace set of Python's str ``\s`` (spelled out; valid in Java and RE2).
WS = (r"[\s\x0b\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}"
      r"\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+")
NON_ASCII_RUN = r"[^\x00-\x7F]+"
LOW_DOUBLE_QUOTE = "„"  # „ → "

# English sections: name → (pattern, group). Order is the output order.
SECTIONS_EN = [
    ("header", r"(?si)^(.*?)(?=OPINION|DECISION)", 1),
    ("body", r"(?si)(?:OPINION|DECISION)(.*?)(?=CONCLUSION|$)", 1),
    ("conclusion", r"(?si)(?:CONCLUSION|ORDER)(.*?)$", 1),
]
# German sections: keyword included (group 0). Order is the output order.
SECTIONS_DE = [
    ("tatbestand", r"(?siu)(?:Tatbestand|TATBESTAND).*?(?=(?:Entscheidungsgründe|ENTSCHEIDUNGSGRÜNDE|II\.|$))", 0),
    ("gruende", r"(?siu)(?:Entscheidungsgründe|ENTSCHEIDUNGSGRÜNDE|Gründe|GRÜNDE).*?(?=(?:III\.|$))", 0),
    ("tenor", r"(?siu)(?:Tenor|TENOR|Beschluss|BESCHLUSS).*?(?=(?:Tatbestand|TATBESTAND|I\.|$))", 0),
    ("leitsaetze", r"(?siu)(?:Leitsätze|LEITSÄTZE|Leitsatz|LEITSATZ).*?(?=(?:Tenor|TENOR|$))", 0),
]
SECTION_NAMES_EN = [n for n, _, _ in SECTIONS_EN]
SECTION_NAMES_DE = [n for n, _, _ in SECTIONS_DE]

# Citation patterns, in the order their matches are concatenated.
CITATIONS_EN = [
    r"\d+ U\.S\. \d+",
    r"\d+ S\.Ct\. \d+",
    r"\d+ F\.\d[a-z]* \d+",
    r"\d+ F\.Supp\.\d[a-z]* \d+",
]
# The two court patterns use atomic groups: same matches as the plain lazy
# form ``BGH.*?(?:Urteil|Beschluss).*?vom.*?<date>``, without its cubic
# backtracking when no date follows.
CITATIONS_DE = [
    r"BGH(?>.*?(?:Urteil|Beschluss))(?>.*?vom).*?\d{1,2}\.\d{1,2}\.\d{4}",
    r"BVerfG(?>.*?(?:Urteil|Beschluss))(?>.*?vom).*?\d{1,2}\.\d{1,2}\.\d{4}",
    r"§\s*\d+[a-z]?(?:\s*(?:Abs\.|Absatz)\s*\d+)?(?:\s*(?:S\.|Satz)\s*\d+)?",
    r"Art\.\s*\d+[a-z]?(?:\s*(?:Abs\.|Absatz)\s*\d+)?(?:\s*(?:S\.|Satz)\s*\d+)?",
]

# Masking rules (pattern, replacement), applied in this order.
EMAIL = r"[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}"
ANON_EN = [
    ("name_mr", r"Mr\.\s+[A-Z][a-z]+", "Mr. [NAME]"),
    ("name_ms", r"Ms\.\s+[A-Z][a-z]+", "Ms. [NAME]"),
    ("name_mrs", r"Mrs\.\s+[A-Z][a-z]+", "Mrs. [NAME]"),
    ("address", r"\d+ [A-Za-z]+ (?:Street|Avenue|Road|Blvd)", "[ADDRESS]"),
    ("phone_paren", r"\(\d{3}\) \d{3}-\d{4}", "[PHONE]"),
    ("phone_dash", r"\d{3}-\d{3}-\d{4}", "[PHONE]"),
    ("email", EMAIL, "[EMAIL]"),
]
ANON_DE = [
    ("name_herr", r"Herr\s+[A-Z][a-zäöüß]+", "Herr [NAME]"),
    ("name_frau", r"Frau\s+[A-Z][a-zäöüß]+", "Frau [NAME]"),
    ("address", r"\d+\s+[A-Za-zäöüß]+(?:straße|weg|allee|platz)", "[ADRESSE]"),
    ("phone", r"0\d{2,4}[/-]?\d{6,8}", "[TELEFON]"),
    ("email", EMAIL, "[EMAIL]"),
]

# Chat markers.
IM_START = "<|im_start|>"
IM_END = "<|im_end|>"
ASSISTANT_MARKER = "<|im_start|>assistant\n"

# Label phrases for classification scoring (case-sensitive, first word).
LABEL_EN = r"document falls under (\w+)"
LABEL_DE = r"Dokument fällt in die Kategorie (\w+)"
# Word order the German template actually uses.
LABEL_DE_TEMPLATE = r"fällt dieses Dokument in die Kategorie (\w+)"

# System messages.
SYSTEM_EN = "You are a legal reasoning assistant trained to analyze legal documents and provide insights."
SYSTEM_DE = "Du bist ein juristischer Assistent, der auf die Analyse deutscher Rechtsdokumente spezialisiert ist."

# Training templates, English: task → (instruction, response). Fallback: classification.
TEMPLATES_EN = [
    ("classification",
     "Classify the following legal document into one of these categories: Contract Law, Criminal Law, Constitutional Law, Administrative Law, or Tort Law.",
     "Based on my analysis, this document falls under {category} because {reasoning}."),
    ("prediction",
     "Predict the outcome of this case based on the facts and legal precedents.",
     "Based on the facts presented and relevant precedents, I predict the outcome will be {outcome}. This is because {reasoning}."),
    ("summarization",
     "Provide a concise summary of the following legal document, highlighting key points and holdings.",
     "Summary:\n{summary}\n\nKey Holdings:\n1. {holding1}\n2. {holding2}\n3. {holding3}"),
    ("interpretation",
     "Interpret the following statute and explain its application.",
     "Interpretation:\n{interpretation}\n\nApplication:\n{application}\n\nKey Elements:\n1. {element1}\n2. {element2}\n3. {element3}"),
]
TEMPLATE_FALLBACK_EN = "classification"

# Training templates, German: task → (instruction, response). Fallback: case_analysis.
TEMPLATES_DE = [
    ("classification",
     "Klassifiziere das folgende Rechtsdokument in eine der folgenden Kategorien: Zivilrecht, Strafrecht, Verwaltungsrecht, Verfassungsrecht oder Arbeitsrecht.",
     "Basierend auf meiner Analyse fällt dieses Dokument in die Kategorie {category}, weil {reasoning}."),
    ("summarization",
     "Fasse das folgende Rechtsdokument zusammen und hebe die wichtigsten Punkte und Entscheidungen hervor.",
     "Zusammenfassung:\n{summary}\n\nWichtige Entscheidungen:\n1. {point1}\n2. {point2}\n3. {point3}"),
    ("case_analysis",
     "Analysiere den folgenden Rechtsfall und erläutere die rechtlichen Grundlagen der Entscheidung.",
     "Analyse:\n{analysis}\n\nRechtliche Grundlagen:\n{legal_basis}\n\nSchlussfolgerung:\n{conclusion}"),
    ("statute_interpretation",
     "Interpretiere die folgenden Gesetzesbestimmungen und erkläre ihre Anwendung.",
     "Interpretation:\n{interpretation}\n\nAnwendung:\n{application}\n\nWichtige Elemente:\n1. {element1}\n2. {element2}\n3. {element3}"),
]
TEMPLATE_FALLBACK_DE = "case_analysis"
TASKS_DE = ["classification", "summarization", "case_analysis", "statute_interpretation"]
SOURCE_DE = "rechtsprechung-im-internet"
MAX_CHARS_DE = 12000

# Inference instructions: (task, language) → instruction; task NULL = default.
PROMPT_INSTRUCTIONS = [
    ("classification", "en", "Classify the following legal document into one of these categories: Contract Law, Criminal Law, Constitutional Law, Administrative Law, or Tort Law."),
    ("classification", "de", "Klassifiziere das folgende Rechtsdokument in eine der folgenden Kategorien: Zivilrecht, Strafrecht, Verwaltungsrecht, Verfassungsrecht oder Arbeitsrecht."),
    ("summarization", "en", "Provide a concise summary of the following legal document, highlighting key points and holdings."),
    ("summarization", "de", "Fasse das folgende Rechtsdokument zusammen und hebe die wichtigsten Punkte und Entscheidungen hervor."),
    ("case_analysis", "en", "Analyze the following legal case and explain the legal basis for the decision."),
    ("case_analysis", "de", "Analysiere den folgenden Rechtsfall und erläutere die rechtlichen Grundlagen der Entscheidung."),
    (None, "en", "Analyze the following legal text and provide insights."),
    (None, "de", "Analysiere den folgenden Rechtstext und gib Einblicke."),
]

# Request defaults of the inference handler.
REQUEST_DEFAULTS = {"text": "", "task": None, "max_new_tokens": 512,
                    "temperature": 0.7, "top_p": 0.9, "language": "en"}

# Metadata fields and their English names in decision XML (in this order).
DECISION_META_TAGS = [("Gericht", "court"), ("Datum", "date"), ("Aktenzeichen", "case_number"),
                      ("Dokumenttyp", "document_type"), ("Verfahrensart", "procedure_type"),
                      ("ECLI", "ecli")]
DECISION_CONTENT_TAGS = ["dokument", "text", "entscheidung", "doktextdaten", "body"]

# Jurisdictions and year window for case augmentation.
JURISDICTIONS = ["federal", "state", "international"]
YEAR_SHIFTS = [-10, 10]
YEAR_MIN_EXCLUSIVE, YEAR_MAX_EXCLUSIVE = 1900, 2023

# Dataset adequacy thresholds and quality targets.
MIN_EXAMPLES, IDEAL_EXAMPLES = 50000, 200000
TARGETS = [
    ("reasoning_accuracy", ">", 0.80),
    ("citation_accuracy", ">", 0.90),
    ("expert_approval", ">", 0.75),
    ("practice_areas", ">=", 5.0),
    ("latency_seconds", "<=", 5.0),
]
# Mix shares by category.
MIX_SHARES = [0.25, 0.30, 0.20, 0.15, 0.10]
