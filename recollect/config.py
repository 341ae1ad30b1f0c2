"""Parameters of the memory engine, with the values that results are compared under."""

from __future__ import annotations

import hashlib
import json
import os
import re
from collections.abc import Mapping
from dataclasses import asdict, dataclass, field
from pathlib import Path


@dataclass(frozen=True)
class Settings:
    owner: str = "Tu Nombre"
    context_rows: int = 4
    reply_gap_minutes: int = 30
    require_other: bool = True
    require_question: bool = False
    own_window: int = 2
    topic_gap_minutes: int = 45
    block_sizes: tuple[int, ...] = (3, 5, 8)
    block_strides: tuple[tuple[int, int], ...] = ((200, 2), (2000, 6), (1 << 60, 12))
    block_min_signal: float = 0.15
    blocks_per_topic: int = 120
    blocks_total: int = 250_000
    min_response_chars: int = 2
    min_style_chars: int = 2
    max_style_words: int = 60
    default_signal: float = 0.4
    version: str = "1"

    def key(self, *fingerprints: str) -> str:
        """Names a build: its parameters and what it was built from."""
        payload = {"settings": asdict(self), "inputs": list(fingerprints)}
        return hashlib.sha256(json.dumps(payload, sort_keys=True).encode()).hexdigest()


def env_file(path: str | Path) -> dict[str, str]:
    """``NAME=value`` lines of a file, quotes around values removed; a file that is not there has none."""
    p = Path(path)
    lines = p.read_text(encoding="utf-8").splitlines() if p.is_file() else []
    pairs = (re.fullmatch(r"\s*(?:export\s+)?([A-Za-z_]\w*)\s*=\s*(.*?)\s*", x) for x in lines)
    return {m[1]: m[2][1:-1] if len(m[2]) > 1 and m[2][0] == m[2][-1] and m[2][0] in "'\"" else re.sub(r"\s+#.*$", "", m[2]) for m in pairs if m}


@dataclass(frozen=True)
class Environment:
    """What differs between installations. The key is for the driver's calls only: it is in no plan, build key or printed value."""

    chats_dir: str = "Chats en .zip"
    owner: str = Settings.owner
    embed_model: str = "intfloat/multilingual-e5-small"
    chat_model: str = "gpt-4.1-mini"
    api_key: str = field(default="", repr=False)

    @classmethod
    def read(cls, path: str | Path = ".env", environ: Mapping[str, str] | None = None, override: bool = False) -> Environment:
        """Variables of the process, then of the file; with ``override`` the file's come first."""
        own, given = dict(os.environ if environ is None else environ), env_file(path)
        found = own | given if override else given | own
        return cls(**{name: found[v] for name, v in VARIABLES.items() if v in found})


# The variables that installations set.
VARIABLES = {"chats_dir": "CHATS_ZIP_DIR", "owner": "MY_NAME", "embed_model": "EMBED_MODEL", "chat_model": "GEN_MODEL", "api_key": "OPENAI_API_KEY"}

# Fixed values, compared with as they stand.
SYSTEM_SNIPPETS = ("cifrado de extremo a extremo", "cambió el asunto", "cambió la foto", "cambió la descripción", "creó este grupo", "te añadieron", "mensaje eliminado", "multimedia omitido")
ACK_WORDS = ("ok", "oki", "okey", "vale", "si", "sii", "sip", "aja", "mmm", "mm", "mhm", "jaja", "jajaja", "jeje", "jaj", "xd", "xD")
QUESTION_PREFIXES = ("que", "como", "por que", "por qué", "cuando", "cuanto", "donde", "quien", "cual", "cuales")
SELF_FACT_HINTS = ("me llamo", "mi nombre", "me llaman", "soy de", "vivo en", "trabajo", "curro", "estudio", "tengo ")
OWNER_PLACEHOLDERS = ("", "tu nombre", "your name", "mi nombre")
FUZZY_PUNCTUATION = "¿?¡!.,;:-_\"'()[]"
QA_TEXT = "Ultimo mensaje del contacto:\n%s\n\nContexto reciente:\n%s\n\nMi respuesta real:\n%s"
MESSAGE_TEXT = "Ultimo mensaje del contacto:\n%s\n\nMensaje mio:\n%s\n\nMicro-contexto:\n%s"
BLOCK_TEXT = "Bloque de conversacion:\n%s"
RESPONSE_TEXT = "Mensaje del contacto:\n%s\n\nContexto:\n%s\n\nMi respuesta real:\n%s"
STYLE_TEXT = "Mi mensaje:\n%s\n\nContexto breve:\n%s"
