"""Word lists for language identification."""

# ---- fixed values: language word lists -------------------------------------
DARIJA_WORDS = [
    "bghit", "kifash", "wash", "ndir", "dyali", "dyal", "n7awel", "nkhed", "flous", "daba",
    "machi", "bzzaf", "chhal", "chno", "ndkhol", "ma9darsh", "3br", "khdamach", "blokiha", "l7sab",
]
DARIJA_MARKERS = ["bghit", "kifash", "dyal", "machi", "bzzaf", "n7awel", "ndkhol"]
FRENCH_WORDS = [
    "je", "vous", "mon", "ma", "les", "est", "pas", "une", "des", "du", "et", "en", "pour",
    "que", "qui", "avec", "comment", "voudrais", "veux", "compte", "carte", "pourquoi", "quand",
]
ENGLISH_WORDS = [
    "i", "my", "the", "is", "are", "can", "do", "want", "help", "how", "what", "would", "could",
    "have", "need", "please", "account", "bank", "card", "transfer", "password",
]
FRENCH_ACCENTS = "àâéèêëîïôùûüç"
FRENCH_ACCENT_WEIGHT = 2
ARABIC_BLOCK = "\\u0600-\\u06ff"
DEFAULT_LANGUAGE = "french"

# ---- fixed values: substrings that mark a text as Darija for tagging -------
DARIJA_TAG_SUBSTRINGS = [
    "bghit", "dyal", "wash", "bzzaf", "mzyan", "n7awel", "flous", "l7sab", "choukran", "waqef",
]
ARABIC_TAG_MIN_CHARS = 3
