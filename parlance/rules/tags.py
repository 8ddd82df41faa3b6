"""Tag rules: conflict pairs, per-intent defaults and a starter keyword table.

The keyword table is a parameter of every tagging operator
(``sources.tables.read_tag_rules`` loads one from CSV, JSON or Parquet).  The
starter table below is our own, kept small, and partly built from rules.
"""

# ---- fixed values: opposed tags (kept, dropped) ----------------------------
CONFLICTS = [
    ("priority:high", "priority:low"),
    ("priority:high", "priority:medium"),
    ("priority:medium", "priority:low"),
    ("urgency:high", "urgency:low"),
    ("urgency:high", "urgency:medium"),
    ("urgency:medium", "urgency:low"),
    ("budget:high", "budget:low"),
    ("budget:high", "budget:none"),
    ("budget:medium", "budget:none"),
    ("feedback:negative", "feedback:positive"),
    ("loyalty:high", "loyalty:new"),
    ("loyalty:long-term", "loyalty:new"),
    ("need:urgent", "need:low"),
    ("risk:high", "risk:low"),
    ("risk:high", "risk:medium"),
    ("predict:churn-high", "predict:churn-low"),
]

# ---- fixed values: documented intent -> default tags -----------------------
INTENT_TAGS = [
    ("question_info", ["faq", "account_info"]),
    ("complaint", ["frustrated", "requires_human"]),
    ("transaction", ["action_request", "form_needed"]),
    ("support", ["support", "technical_issue"]),
    ("off_topic", []),
    ("emergency", ["urgent", "security_risk", "requires_human"]),
]

# ---- fixed values: tag strings that mean "no tag" --------------------------
EMPTY_TAGS = ["", "nan", "none", "null", "untagged"]
UNTAGGED = "untagged"
LANGUAGE_PREFIX = "language:"
TAG_DARIJA = "language:darija"
TAG_ARABIC = "language:ar"

AGE_BANDS = [("age:18-24", range(18, 25)), ("age:25-34", range(25, 35)), ("age:35-44", range(35, 45)),
             ("age:45-54", range(45, 55)), ("age:55-64", range(55, 65))]

_STARTER = {
    "gender:male": ["monsieur", "sir "],
    "gender:female": ["madame", "madam"],
    "education:master": ["master", "mba"],
    "education:phd": ["phd", "thesis"],
    "country:fr": ["france", "paris"],
    "country:ma": ["maroc", "morocco", "المغرب"],
    "country:es": ["espagne", "spain"],
    "city:casablanca": ["casablanca"],
    "city:rabat": ["rabat"],
    "Role:Manager": ["manager", "directeur"],
    "industry:banking": ["bank", "banque", "lbank"],
    "industry:retail": ["store", "magasin"],
    "intent:contact": ["call me", "appelez", "contact"],
    "intent:buy": ["buy", "acheter", "purchase"],
    "intent:transfer": ["transfer", "virement", "تحويل"],
    "intent:cancel": ["cancel", "annuler"],
    "need:urgent": ["urgent", "immediately", "daba"],
    "need:low": ["no rush", "sometime"],
    "urgency:high": ["asap", "maintenant", "right now"],
    "urgency:medium": ["this week", "cette semaine"],
    "urgency:low": ["later", "plus tard"],
    "priority:high": ["critical", "refused", "critique"],
    "priority:medium": ["slow", "lent"],
    "priority:low": ["please", "minor"],
    "budget:high": ["premium", "no limit"],
    "budget:medium": ["reasonable"],
    "budget:low": ["cheap", "pas cher"],
    "budget:none": ["free", "gratuit"],
    "feedback:positive": ["great", "merci", "mzyan"],
    "feedback:negative": ["not working", "broken", "mauvais"],
    "loyalty:high": ["always use", "fidèle"],
    "loyalty:long-term": ["for years", "depuis des années"],
    "loyalty:new": ["new here", "nouveau client"],
    "risk:high": ["hack", "fraud", "stolen"],
    "risk:medium": ["suspicious", "again"],
    "risk:low": ["routine", "in town"],
    "predict:churn-high": ["close my account", "leaving"],
    "predict:churn-low": ["renew", "happy"],
    "product:card": ["card", "carte"],
    "product:account": ["account", "compte", "حساب"],
    "product:iban": ["iban", "rib"],
    "channel:email": ["email", "mail"],
    "channel:phone": ["phone", "tel ", "call "],
    "channel:web": ["server", "host", "www."],
    "device:ios": ["iphone", "ios"],
    "device:android": ["android"],
    "usage:login": ["password", "mot de passe", "login"],
    "lifecycle:signup": ["sign up", "signed", "inscription"],
    "topic:art": ["art"],
    "topic:car": ["car"],
    "language:fr": ["bonjour"],
}

# (keyword, tag) rows; age keywords follow from the bands.
DEFAULT_TAG_RULES = [(k, tag) for tag, kws in _STARTER.items() for k in kws] + [
    (f"{n} ans", tag) for tag, band in AGE_BANDS for n in band
]
DEFAULT_OFFICIAL_TAGS = sorted({t for _, t in DEFAULT_TAG_RULES} | {TAG_DARIJA, TAG_ARABIC})
