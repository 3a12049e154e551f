"""Closed word lists and patterns.  Fixed values: results depend on each of them."""

ABBREVIATIONS = ["mr", "mrs", "ms", "dr", "prof", "sr", "jr", "st", "e.g", "i.e", "etc", "vs", "approx", "no", "fig", "ref", "al", "dept", "univ", "inc", "ltd", "co"]

PRONOUNS = [
    "i", "me", "my", "mine", "myself", "you", "your", "yours", "yourself", "yourselves", "he", "him", "his", "himself", "she", "her", "hers", "herself", "it", "its", "itself",
    "we", "us", "our", "ours", "ourselves", "they", "them", "their", "theirs", "themselves",
    "this", "that", "these", "those", "who", "whom", "whose", "which", "what", "one", "ones", "oneself", "someone", "anyone", "everyone", "no one",
]

CONNECTIVES = [
    "however", "therefore", "because", "although", "also", "then", "for example", "in addition", "moreover", "furthermore", "nevertheless",
    "consequently", "accordingly", "meanwhile", "otherwise", "instead", "first", "second", "third", "finally", "next", "thus", "hence", "though",
    "since", "while", "whereas", "despite", "unless", "until", "but", "and", "so", "yet", "or", "nor",
]

MARKS = [".", ",", ";", ":", "!", "?", "(", ")", "-", "—", '"']
CURLY_QUOTES = ["“", "”", "„"]

EVASION_PHRASES = ["undetectable", "bypass", "turnitin", "gptzero", "evade detection", "beat the detector", "fool the detector", "detection-proof", "make this undetectable", "humanize this"]

WORD = r"[\p{L}\p{Nl}\p{No}]+(?:'[\p{L}\p{Nl}\p{No}]+)?|\p{Nd}+(?:\.\p{Nd}+)?"
NUMBER = r"\d{1,3}(?:,\d{3})+(?:\.\d+)?|\d+(?:\.\d+)?%?"
CITATIONS = [
    r"\[\d+(?:\s*[-,]\s*\d+)*\]",
    r"\([A-Z][A-Za-z'’\-]+(?:\s+(?:&|and)\s+[A-Z][A-Za-z'’\-]+)?(?:\s+et al\.)?,?\s+\d{4}[a-z]?\)",
    r"[A-Z][A-Za-z'’\-]+(?:\s+et al\.)?\s*\(\d{4}[a-z]?\)",
]

SHORT_MAX, MEDIUM_MAX = 11, 25
DIMENSION_WEIGHTS = {"sentence_structure": 1.0, "paragraph_structure": 1.0, "vocabulary": 1.0, "punctuation": 0.8, "readability": 0.8, "cohesion": 0.8, "ngrams": 0.7}
