"""Screening rules as data: (label, pattern) rows in scan order.

Patterns are written without flags.  ``functions.safety`` adds the Java flags
(Unicode classes, and Unicode case folding where a rule ignores case).
"""

# ---- fixed values: injection rules, in report order ------------------------
INJECTION_RULES = [
    ("instruction_override", r"ignore\s+(all\s+)?(previous|prior|above|your)?\s*(instructions?|rules?|constraints?|guidelines?|prompts?)"),
    ("forget_instructions", r"(forget|discard|disregard|override|bypass|circumvent|neutralize)\s+(all\s+)?(your\s+)?(instructions?|training|rules?|system\s+prompt|context)"),
    ("new_instructions", r"(your\s+new\s+instructions?|from\s+now\s+on\s+(you\s+are|act|behave)|you\s+must\s+now\s+ignore)"),
    ("system_prompt_leak", r"(repeat|print|reveal|show|output|tell\s+me|give\s+me|display|write\s+out)\s+(your\s+)?(system\s+prompt|initial\s+prompt|base\s+prompt|hidden\s+instructions?|secret\s+instructions?|original\s+prompt)"),
    ("what_are_instructions", r"what\s+(are\s+)?(your|the)\s+(exact\s+)?(system\s+prompt|instructions?|rules?|constraints?)"),
    ("jailbreak_dan", r"(DAN\s+mode|do\s+anything\s+now|you\s+are\s+now\s+DAN|pretend\s+you\s+have\s+no\s+restrictions?|act\s+as\s+if\s+you\s+have\s+no\s+limits?)"),
    ("roleplay_override", r"(pretend\s+you\s+are|act\s+as\s+(an?\s+)?(evil|unrestricted|unfiltered|uncensored|jailbroken)|you\s+are\s+now\s+(an?\s+)?(AI\s+with\s+no|unrestricted|unfiltered))"),
    ("opposite_mode", r"(developer\s+mode|opposite\s+mode|evil\s+mode|chaos\s+mode|jailbreak\s+mode|god\s+mode|unrestricted\s+mode)"),
    ("delimiter_injection", r"(</?(system|user|assistant|human|ai|instruction|context)>|\[INST\]|\[/INST\]|<<SYS>>|<</SYS>>|\|\s*im_start\s*\||<\|im_start\|>|<\|im_end\|>)"),
    ("special_token_inject", r"(###\s*(Instruction|System|Human|Assistant)|^---\s*(system|prompt|instruction)\s*---)"),
    ("indirect_injection", r"(when\s+you\s+(read|see|process|encounter)\s+this|this\s+message\s+contains?\s+hidden\s+instructions?|payload:|<injection>|SYSTEM\s*:\s*you\s+are)"),
    ("nested_prompt", r"(translate\s+the\s+following.{0,60}ignore|summarize\s+the\s+following.{0,60}instead\s+(do|say|output|print))"),
    ("base64_injection", r"(decode\s+(this|the\s+following)\s+(base64|b64)|base64\s*:\s*[A-Za-z0-9+/=]{20,})"),
    ("leetspeak_jailbreak", r"(1gn0r3\s+4ll|byp4ss|j41lbr34k|syst3m\s+pr0mpt)"),
    ("fr_override", r"(ignore\s+toutes?\s+(les\s+)?(instructions?|règles?)|oublie\s+(tes|vos)\s+instructions?|tu\s+(es|n'es\s+plus)\s+(maintenant\s+)?un\s+assistant)"),
    ("ar_override", r"(تجاهل\s+جميع\s+التعليمات|تجاهل\s+تعليماتك|أنت\s+الآن\s+بدون\s+قيود)"),
]
MULTILINE_RULES = {"special_token_inject"}
INJECTION_SNIPPET_CHARS = 40
INJECTION_BLOCK_THRESHOLD = 1

# ---- fixed values: unsafe-content categories, in report order --------------
NSFW_RULES = [
    ("explicit_sexual", r"\b(porn(ography)?|nude(s)?|naked|explicit\s+(sex|content)|sex\s+tape|onlyfans\s+leak|xxx|hentai|erotic\s+(story|fiction)|sexual\s+content|make\s+(love|sex)\s+to|sleep\s+with\s+me|send\s+(nudes?|pics?))\b"),
    ("graphic_violence", r"\b(how\s+to\s+kill|step[s\-]by[s\-]step\s+(kill|murder|torture)|behead|decapitat|disembowel|gore\s+(video|image|content)|make\s+(a\s+)?(bomb|explosive|weapon)|instructions?\s+(to|for)\s+(kill|murder|attack)|mass\s+(shooting|murder|killing)\s+(plan|how))\b"),
    ("hate_speech", r"\b(white\s+supremacy|racial\s+slur|death\s+to\s+(all\s+)?(jews?|muslims?|christians?|blacks?|whites?)|[nN][-*]{4}[eE]r|f[a*]{2}g(ot)?|k[i*]ke|sp[i*]c|gas\s+the\s+jews?|ethnic\s+cleansing\s+(plan|how)|nazis?\s+(are\s+right|were\s+right))\b"),
    ("self_harm", r"\b(how\s+to\s+(commit\s+suicide|self[- ]harm|cut\s+myself|end\s+my\s+life)|best\s+way\s+to\s+(die|kill\s+myself|overdose)|(suicide|self[- ]harm)\s+(method|guide|instructions?|tutorial)|lethal\s+dose\s+of)\b"),
    ("illegal_activity", r"\b(how\s+to\s+(hack|crack|pirate|steal|launder\s+money|make\s+meth|synthesize\s+drugs?)|buy\s+(drugs?|weapons?|guns?|cocaine|heroin)\s+online|dark\s+web\s+(market|drugs?|weapons?)|credit\s+card\s+(fraud|carding|dump)|how\s+to\s+bypass\s+(security|auth(entication)?|2fa))\b"),
    ("harassment", r"\b(i\s+will\s+(kill|hurt|rape|destroy)\s+you|you\s+(should|deserve\s+to)\s+(die|suffer|rot)|i\s+know\s+where\s+you\s+live|i\s+will\s+find\s+you|send\s+(threats?|hate\s+mail)\s+to|doxx(ing)?|dox\s+(him|her|them|you))\b"),
]

# ---- fixed values: personal-data rules (type, pattern, mask), scan order ---
PII_RULES = [
    ("iban", r"\b[A-Z]{2}\d{2}[\s]?([A-Z0-9]{4}[\s]?){1,7}[A-Z0-9]{1,4}\b", "[IBAN_MASQUÉ]"),
    ("credit_card", r"\b(?:4\d{3}|5[1-5]\d{2}|3[47]\d{2})[\s\-]?\d{4}[\s\-]?\d{4}[\s\-]?\d{4}\b", "[CARTE_MASQUÉE]"),
    ("ssn", r"\b\d{3}[-\s]?\d{2}[-\s]?\d{4}\b", "[SSN_MASQUÉ]"),
    ("passport", r"\b[A-Z]{2}[0-9]{7}\b", "[PASSEPORT_MASQUÉ]"),
    ("id", r"\b[A-Z]{1,2}\d{5,7}\b", "[IDENTIFIANT_MASQUÉ]"),
    ("phone_ma", r"(?<!\d)(0[5-7]\d{8}|\+212[\s\-]?[5-7]\d{8}|00212[5-7]\d{8})(?!\d)", "[TEL_MASQUÉ]"),
    ("phone_intl", r"\+(?!212)[1-9]\d{1,3}[\s\-]?\(?\d{1,4}\)?[\s\-]?\d{2,4}[\s\-]?\d{2,9}", "[TEL_MASQUÉ]"),
    ("email", r"\b[a-zA-Z0-9._%+\-]+@[a-zA-Z0-9.\-]+\.[a-zA-Z]{2,}\b", "[EMAIL_MASQUÉ]"),
    ("date_of_birth", r"\b(0?[1-9]|[12]\d|3[01])[/\-\.](0?[1-9]|1[0-2])[/\-\.](19|20)\d{2}\b", "[DATE_MASQUÉE]"),
    ("ip_address", r"\b(25[0-5]|2[0-4]\d|[01]?\d\d?)\.(25[0-5]|2[0-4]\d|[01]?\d\d?)\.(25[0-5]|2[0-4]\d|[01]?\d\d?)\.(25[0-5]|2[0-4]\d|[01]?\d\d?)\b", "[IP_MASQUÉE]"),
    ("full_name", r"\b(M\.|Mme\.|Mr\.|Mlle\.|Dr\.|Prof\.|Sr\.|Sra\.)\s+[A-ZÀ-Ü][a-zà-ü]+(?:\s+[A-ZÀ-Ü][a-zà-ü]+){1,3}\b", "[NOM_MASQUÉ]"),
]

# ---- fixed values: texts that replace a blocked message, reason prefixes ---
BLOCKED_INJECTION_TEXT = "[MESSAGE BLOQUÉ — TENTATIVE D'INJECTION DÉTECTÉE]"
BLOCKED_NSFW_TEXT = "[MESSAGE BLOQUÉ — CONTENU INAPPROPRIÉ DÉTECTÉ]"
INJECTION_REASON = "Prompt injection detected — rules matched: "
NSFW_REASON = "NSFW content detected — categories: "
FINGERPRINT_CHARS = 16

# Cheap necessary conditions, our own.  A rule whose condition fails cannot
# match, so its pattern is not run; a condition that holds decides nothing.
# Injection and unsafe-content rules: alternatives of words that must all occur
# in the case-folded text.
RULE_NEEDS = {
    "instruction_override": ["ignore"],
    "forget_instructions": ["forget", "discard", "disregard", "override", "bypass", "circumvent", "neutralize"],
    "new_instructions": ["new&instruction", "from&now", "must&now&ignore"],
    "system_prompt_leak": ["prompt", "hidden&instruction", "secret&instruction"],
    "what_are_instructions": ["what&prompt", "what&instruction", "what&rule", "what&constraint"],
    "jailbreak_dan": ["dan&mode", "dan&now&you", "anything&now", "pretend&restriction", "act&limit"],
    "roleplay_override": ["pretend", "act&evil", "unrestricted", "unfiltered", "uncensored", "jailbroken",
                          "now&ai&with&you"],
    "opposite_mode": ["mode&developer", "mode&opposite", "mode&evil", "mode&chaos", "mode&jailbreak", "mode&god",
                      "mode&unrestricted"],
    "delimiter_injection": ["<", "inst]", "|"],
    "special_token_inject": ["###", "---"],
    "indirect_injection": ["when&you&this", "message&hidden", "payload:", "<injection>", "system&:"],
    "nested_prompt": ["translate", "summarize"],
    "base64_injection": ["decode", "base64"],
    "leetspeak_jailbreak": ["1gn0r3", "byp4ss", "j41lbr34k", "syst3m"],
    "fr_override": ["ignore", "oublie", "assistant"],
    "ar_override": ["تجاهل", "أنت"],
    "explicit_sexual": ["porn", "explicit", "nude", "naked", "sex", "onlyfans", "xxx", "hentai", "erotic", "make&love",
                        "sleep", "send&pic"],
    "graphic_violence": ["kill", "murder", "torture", "behead", "decapitat", "disembowel", "gore", "bomb",
                         "explosive", "weapon", "instruction&attack", "mass&shooting"],
    "hate_speech": ["supremacy", "slur", "death&to", "--&er", "**&er", "-*&er", "*-&er", "faag", "fa*g", "f*ag",
                    "f**g", "kike", "k*ke", "spic", "sp*c", "gas&jew", "cleansing", "nazi"],
    "self_harm": ["suicide", "harm", "myself", "how&end&life", "best&way&die", "best&way&overdose", "lethal"],
    "illegal_activity": ["hack&how", "crack&how", "pirate&how", "steal&how", "launder", "meth&how", "synthesize",
                         "buy&online", "dark&web", "credit&card", "bypass"],
    "harassment": ["kill&will", "hurt&will", "rape&will", "destroy&will", "deserve", "should&die", "should&suffer",
                   "should&rot", "know&where", "will&find", "threat", "hate&mail", "dox"],
}
# Letters that case-insensitive matching equates with ASCII ones beyond lower().
FOLD_EXTRA = [("ſ", "s"), ("ı", "i"), ("İ", "i"), ("\u212a", "k")]
# Personal-data rules: a pattern every match contains.
PII_NEEDS = {
    "iban": r"[A-Z]\d",
    "credit_card": r"\d{3}[\s\-]?\d{4}",
    "ssn": r"\d{3}[-\s]?\d{2}[-\s]?\d{4}",
    "passport": r"[A-Z][0-9]{7}",
    "id": r"[A-Z]\d{5}",
    "phone_ma": r"0[5-7]\d{8}|\+212|00212",
    "phone_intl": r"\+[1-9]\d",
    "email": r"@",
    "date_of_birth": r"[/\-.](?:19|20)\d{2}",
    "ip_address": r"\d\.\d{1,3}\.\d",
    "full_name": r"(?:M|Mme|Mr|Mlle|Dr|Prof|Sr|Sra)\.\s",
}
PII_ANY = r"[\d@]|\b(?:M|Mme|Mr|Mlle|Dr|Prof|Sr|Sra)\.\s"
