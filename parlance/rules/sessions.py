"""Limits, thresholds and texts of session state, risk and summaries."""

# ---- fixed values: message contract ----------------------------------------
MESSAGE_CHARS = (1, 4096)
USER_ID_CHARS = (1, 64)
RATING_RANGE = (1, 5)

# ---- fixed values: state limits --------------------------------------------
HISTORY_TURNS = 50
CONTEXT_TURNS = 20
PREVIEW_TURNS = 5
SESSION_TTL_SECONDS = 86_400
SUMMARY_TTL_SECONDS = 7 * 86_400
TRANSCRIPT_CHARS = 300
REPETITION_THRESHOLD = 0.6

# ---- fixed values: summary texts -------------------------------------------
DEFAULT_INTENT = "info_seeking"
SUMMARY_LANGUAGE = "french"
ACTIONS_HARMFUL = ["Escalade immédiate vers équipe sécurité", "Bloquer le compte si nécessaire"]
ACTION_SENSITIVE = "Transmettre pour révision humaine"
ACTION_PII = "Vérifier conformité RGPD / données masquées"
ACTION_DEFAULT = "Continuer le suivi standard"
TEXT_TURNS = ("Conversation de ", " échanges. ")
TEXT_INTENT = ("Intention principale: ", ". ")
TEXT_PII = "⚠️ Données sensibles détectées. "
TEXT_EMERGENCY = "🚨 Situation d urgence signalée. "
TEXT_RISK = ("Niveau de risque: ", ".")
ESCALATION_CRITICAL = "Situation critique détectée"

# ---- fixed values: context hint and refusal --------------------------------
INTENT_HINT = ("Detected user intent: ", ". Tags: ", ".")
REFUSAL_PREFIX = "⛔ "
