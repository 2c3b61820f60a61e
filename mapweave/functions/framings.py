"""Query templates per language and framing, and term translations."""

FRAMINGS = {
    "en": {
        "neutral": ["{issue}", "{issue} information", "{issue} overview"],
        "activist": [
            "{issue} crisis", "{issue} emergency", "{issue} action", "solve {issue}", "fight {issue}",
        ],
        "skeptic": [
            "{issue} skepticism", "{issue} debate", "{issue} controversy", "{issue} doubt", "question {issue}",
        ],
        "scientific": [
            "{issue} research", "{issue} science", "{issue} study", "{issue} evidence", "{issue} peer review",
        ],
        "policy": [
            "{issue} policy", "{issue} regulation", "{issue} legislation", "{issue} government", "{issue} law",
        ],
        "industry": [
            "{issue} business", "{issue} market", "{issue} economy", "{issue} investment", "{issue} corporate",
        ],
        "media": ["{issue} news", "{issue} coverage", "{issue} media", "{issue} report"],
        "local": ["{issue} in {location}", "{location} {issue}", "{issue} {location} impact"],
        "temporal": ["{issue} {year}", "{issue} history", "{issue} timeline", "future of {issue}"],
    },
    "da": {
        "neutral": ["{issue}", "{issue} information", "{issue} oversigt"],
        "activist": [
            "{issue}krise", "{issue}nødsituation", "{issue} handling", "bekæmp {issue}", "løs {issue}",
        ],
        "skeptic": ["{issue} skepsis", "{issue} debat", "{issue} kontrovers", "tvivl om {issue}"],
        "scientific": ["{issue} forskning", "{issue} videnskab", "{issue} undersøgelse", "{issue} evidens"],
        "policy": ["{issue} politik", "{issue} regulering", "{issue} lovgivning", "{issue} regering"],
        "industry": ["{issue} erhverv", "{issue} marked", "{issue} økonomi", "{issue} investering"],
        "media": ["{issue} nyheder", "{issue} dækning", "{issue} medie"],
        "local": ["{issue} i {location}", "{location} {issue}", "{issue} {location} påvirkning"],
        "temporal": ["{issue} {year}", "{issue} historie", "{issue} tidslinje", "fremtid for {issue}"],
    },
}

TERM_TRANSLATIONS = {
    ("en", "da"): [
        ("climate change", "klimaændringer"),
        ("global warming", "global opvarmning"),
        ("climate crisis", "klimakrise"),
        ("climate emergency", "klimanødsituation"),
        ("climate policy", "klimapolitik"),
        ("climate science", "klimavidenskab"),
    ],
    ("da", "en"): [
        ("klimaændringer", "climate change"),
        ("global opvarmning", "global warming"),
        ("klimakrise", "climate crisis"),
        ("klimanødsituation", "climate emergency"),
        ("klimapolitik", "climate policy"),
        ("klimavidenskab", "climate science"),
    ],
}
