"""Word and domain lists that results depend on.

The values below are data. They are given as plain text in natural order.
"""

# -- fixed values: domain lists of the sphere classification ------------------

ACADEMIC_DOMAINS = [
    ".edu", ".ac.uk", ".edu.au", ".ac.nz", ".ac.za", "arxiv.org", "scholar.google.com", "researchgate.net", "academia.edu",
    "jstor.org", "springer.com", "sciencedirect.com",
]

GOVERNMENT_DOMAINS = [
    ".gov", ".gov.uk", ".gov.au", ".gov.nz", ".gov.ca", ".eu", ".europa.eu", ".gouv.fr", ".gob.es", ".gov.ie", "un.org",
    "who.int", "europa.eu",
]

NEWS_DOMAINS = [
    "bbc.co.uk", "bbc.com", "cnn.com", "theguardian.com", "nytimes.com", "washingtonpost.com", "reuters.com", "apnews.com",
    "bloomberg.com", "ft.com", "wsj.com", "economist.com", "politico.com", "npr.org", "dr.dk", "tv2.dk",
    "jyllands-posten.dk", "politiken.dk", "berlingske.dk",
]

ACTIVIST_DOMAINS = [
    "greenpeace.org", "wwf.org", "oxfam.org", "amnesty.org", "hrw.org", "eff.org", "aclu.org", "350.org", "foe.org",
    "climatecentral.org", "climatenetwork.org",
]

INTERNATIONAL_DOMAINS = [
    "un.org", "who.int", "worldbank.org", "imf.org", "oecd.org", "wto.org", "nato.int", "europa.eu",
]

ACADEMIC_SUFFIXES = [
    ".edu", ".ac.uk", ".ac.nz", ".ac.au",
]
GOVERNMENT_SUFFIXES = [
    ".gov", ".gov.uk", ".gov.au", ".gov.nz",
]

# -- fixed values: words ignored when terms are taken from titles and snippets -

TERM_STOP_WORDS = [
    "the", "a", "an", "and", "or", "but", "in", "on", "at", "to", "for", "of", "with", "by", "from", "as", "is", "was",
    "are", "were", "been", "be", "have", "has", "had", "do", "does", "did", "will", "would", "should", "could", "may",
    "might", "can", "this", "that", "these", "those", "i", "you", "he", "she", "it", "we", "they", "them", "their", "what",
    "which", "who", "when", "where", "why", "how",
]

# -- fixed values: stop word lists per language --------------------------------

ENGLISH_STOP_WORDS = [
    "i", "me", "my", "myself", "we", "our", "ours", "ourselves", "you", "your", "yours", "yourself", "yourselves", "he",
    "him", "his", "himself", "she", "her", "hers", "herself", "it", "its", "itself", "they", "them", "their", "theirs",
    "themselves", "what", "which", "who", "whom", "this", "that", "these", "those", "am", "is", "are", "was", "were", "be",
    "been", "being", "have", "has", "had", "having", "do", "does", "did", "doing", "a", "an", "the", "and", "but", "if",
    "or", "because", "as", "until", "while", "of", "at", "by", "for", "with", "about", "against", "between", "into",
    "through", "during", "before", "after", "above", "below", "to", "from", "up", "down", "in", "out", "on", "off", "over",
    "under", "again", "further", "then", "once", "here", "there", "when", "where", "why", "how", "all", "any", "both",
    "each", "few", "more", "most", "other", "some", "such", "no", "nor", "not", "only", "own", "same", "so", "than", "too",
    "very", "s", "t", "can", "will", "just", "don", "should", "now", "d", "ll", "m", "o", "re", "ve", "y", "ain", "aren",
    "couldn", "didn", "doesn", "hadn", "hasn", "haven", "isn", "ma", "mightn", "mustn", "needn", "shan", "shouldn", "wasn",
    "weren", "won", "wouldn",
]

DANISH_STOP_WORDS = [
    "og", "i", "jeg", "det", "at", "en", "den", "til", "er", "som", "på", "de", "med", "han", "af", "for", "ikke", "der",
    "var", "mig", "sig", "men", "et", "har", "om", "vi", "min", "havde", "ham", "hun", "nu", "over", "da", "fra", "du",
    "ud", "sin", "dem", "os", "op", "man", "hans", "hvor", "eller", "hvad", "skal", "selv", "her", "alle", "vil", "blev",
    "kunne", "ind", "når", "være", "dog", "noget", "ville", "jo", "deres", "efter", "ned", "skulle", "denne", "end",
    "dette", "mit", "også", "under", "have", "dig", "anden", "hende", "mine", "alt", "meget", "sit", "sine", "vor", "mod",
    "disse", "hvis", "din", "nogle", "hos", "blive", "mange", "ad", "bliver", "hendes", "været", "thi", "jer", "sådan",
]

STOP_WORDS = {"en": ENGLISH_STOP_WORDS, "da": DANISH_STOP_WORDS}

# -- fixed values: frequent words that tell languages apart ---------------------

LANGUAGE_MARKERS = {
    "en": ["the", "of", "and", "to", "in", "is", "that", "it", "for", "was", "on", "are", "as", "with", "be", "this", "by", "from"],
    "da": ["og", "det", "at", "en", "den", "til", "er", "som", "på", "de", "med", "af", "for", "ikke", "der", "var", "et", "har"],
    "de": ["der", "die", "und", "in", "den", "von", "zu", "das", "mit", "sich", "des", "auf", "für", "ist", "im", "dem", "nicht", "ein"],
    "fr": ["de", "la", "le", "et", "les", "des", "en", "un", "du", "une", "que", "est", "dans", "qui", "par", "pour", "au", "sur"],
    "es": ["de", "la", "que", "el", "en", "y", "a", "los", "se", "del", "las", "un", "por", "con", "no", "una", "su", "para", "es", "al"],
}

# -- fixed values: phrases of challenge and rate limit pages --------------------

CHALLENGE_PHRASES = (
    "cf-challenge",
    "cf-browser-verification",
    "please verify you are a human",
    "are you a robot",
    "verify you are human",
    "complete the security check",
    "checking your browser",
    "ray id:",
)
RATE_LIMIT_PHRASES = ("too many requests", "rate limit", "slow down")

# -- fixed values: class name parts of page furniture ---------------------------

REMOVED_TAGS = ("script", "style", "noscript", "iframe")
FURNITURE_TAGS = ("nav", "header", "footer", "aside")
FURNITURE_CLASSES = ("nav", "menu", "sidebar", "footer", "header", "cookie", "banner")
NOISE_CLASSES = ("advertisement", "ad-", "social-share", "comment", "cookie-notice", "popup", "modal")
