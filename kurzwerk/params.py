"""Parameters and fixed texts shared by all operators."""

from __future__ import annotations

import os
from dataclasses import dataclass

# Status texts users see for every upload and result. The wording,
# the leading signs and the placeholders must stay as they are.
MSG_INVALID_PREFIX = "❌ Ungültige Datei: "
MSG_ERROR_PREFIX = "❌ "
MSG_SERVICE_PREFIX = "⚠ "
MSG_UNDECODABLE = "Die Datei konnte nicht dekodiert werden."
MSG_EXTENSION = "Nur PDF-Dateien werden unterstützt (erhalten: '%s')."
MSG_EMPTY = "Die hochgeladene Datei ist leer."
MSG_OVERSIZE = "Die Datei ist größer als das erlaubte Limit von %s MB."
MSG_UNREADABLE = "Die Datei konnte nicht als PDF gelesen werden."
MSG_NO_TEXT = (
    "Aus diesem PDF konnte kein Text extrahiert werden. "
    "Vermutlich handelt es sich um ein gescanntes Dokument ohne OCR-Text."
)
MSG_PAGE_CAP = (
    "⚠ Das Dokument hat %s Seiten und überschreitet die aktuell erlaubte Grenze von %s Seiten.\n"
    "Bitte wende dich an die Administration, wenn größere Dokumente "
    "freigegeben oder zusammengefasst werden sollen."
)
MSG_SUCCESS = "✅ '%s' erfolgreich verarbeitet (%s Seiten, %s Zeichen)."
MSG_SERVICE_DOWN = (
    "Der Zusammenfassungsdienst ist aktuell nicht erreichbar. "
    "Bitte versuche es in Kürze erneut."
)
MSG_EMPTY_REQUEST = "Der Text ist leer."
MSG_MODEL_FAILED = "Die Zusammenfassung konnte nicht erstellt werden."
EVAL_DATASET = "abisee/cnn_dailymail (3.0.0), test split"

MEBIBYTE = 1024 * 1024


@dataclass(frozen=True)
class Params:
    """Limits of one run. The defaults are fixed values of the product."""

    max_file_size: int = 20 * MEBIBYTE
    allowed_extension: str = ".pdf"
    max_pages: int = 20
    max_tokens: int = 900
    overlap_tokens: int = 50
    model_input_tokens: int = 1024
    n_special: int = 2
    max_summary_tokens: int = 150
    min_summary_tokens: int = 30
    eval_max_summary_tokens: int = 180
    eval_min_summary_tokens: int = 30
    #: Cut of an article before a model that needs one; the published run cut at 4000.
    eval_article_chars: int | None = None
    eval_num_samples: int = 50
    #: Time limit of a call of the model; None for no limit.
    model_seconds: float | None = 180
    model_name: str = "facebook/bart-large-cnn"

    @property
    def size_limit_text(self) -> str:
        """The size limit as shown to the user, in MB."""
        return f"{self.max_file_size / MEBIBYTE:g}"

    @classmethod
    def from_env(cls, env: dict[str, str] | None = None) -> "Params":
        """Defaults overridden by the environment variables of a deployment."""
        env = os.environ if env is None else env
        given: dict = {}
        if "MAX_FILE_SIZE_MB" in env:
            given["max_file_size"] = int(env["MAX_FILE_SIZE_MB"]) * MEBIBYTE
        if "MAX_SUMMARY_TOKENS" in env:
            given["max_summary_tokens"] = int(env["MAX_SUMMARY_TOKENS"])
        if "MIN_SUMMARY_TOKENS" in env:
            given["min_summary_tokens"] = int(env["MIN_SUMMARY_TOKENS"])
        if "ML_SERVICE_TIMEOUT" in env:
            given["model_seconds"] = int(env["ML_SERVICE_TIMEOUT"])
        if "SUMMARIZATION_MODEL" in env:
            given["model_name"] = env["SUMMARIZATION_MODEL"]
        return cls(**given)
