"""Prompt assembly and answering over retrieved hits, with a pluggable generator."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Sequence
from typing import Protocol

from pyspark.sql import Row

from recollect import config

# The prompt's wording.
REFUSAL = "No tengo evidencia suficiente en mis chats para responder eso con seguridad."
NO_RESPONSE, NO_STYLE = "(sin evidencia de respuesta)", "(sin muestras de estilo)"
PROMPT = (
    "Consulta nueva:\n{prompt}"
    "\n\nEvidencia de como respondo a mensajes parecidos:\n{response}"
    "\n\nMuestras de mi estilo de escritura:\n{style}"
    "\n\nInstrucciones de salida:\n"
    "1) Genera una sola respuesta como la escribiria yo.\n"
    "2) Usa la evidencia de respuesta para el contenido.\n"
    "3) Usa las muestras de estilo para tono/forma, sin copiar literal.\n"
    "4) Si falta evidencia para afirmar algo, dilo con claridad."
)
AGAIN = "\n\nReformula sin repetir la consulta."
STYLE_SAMPLES = 8


class Generator(Protocol):
    def __call__(self, system: str, user: str, temperature: float | None) -> str: ...


class Echo:
    """Offline stand-in: repeats the best evidence."""

    def __call__(self, system: str, user: str, temperature: float | None) -> str:
        m = re.search(r"^Mi respuesta real: (.*)$", user, re.M)
        return m[1] if m else ""


def retrying(call) -> Generator:
    """A chat call that is repeated without a temperature where the model says that it takes none, whatever class its error has."""

    def generate(system: str, user: str, temperature: float | None) -> str:
        try:
            return call(system, user, temperature)
        except Exception as refused:
            if temperature is None or "temperature" not in str(refused).lower():
                raise
            return call(system, user, None)

    return generate


def fuzzy(s: str) -> str:
    s = "".join(c for c in unicodedata.normalize("NFKD", (s or "").lower().strip()) if not unicodedata.combining(c))
    return re.sub(r"\s+", " ", s.translate({ord(c): None for c in config.FUZZY_PUNCTUATION}))


def build_prompt(prompt: str, response_hits: Sequence[Row], style_hits: Sequence[Row]) -> str:
    response = "\n\n".join(f"[response | score {h['score']:.3f} | chat: {h['chat_name']} | fecha: {h['timestamp']}]\nMensaje del contacto: {h['partner_text']}\nMi respuesta real: {h['response']}\nContexto: {h['context']}" for h in response_hits)
    style = "\n".join(f"- ({h['style_cluster']}) {h['style_text']}" for h in style_hits[:STYLE_SAMPLES])
    return PROMPT.format(prompt=prompt, response=response or NO_RESPONSE, style=style or NO_STYLE)


def answer(prompt: str, response_hits: Sequence[Row], style_hits: Sequence[Row], generate: Generator, system: str = "", temperature: float | None = None) -> str:
    """Hits are the few collected rows of one query. An empty reply is a refusal; one that echoes the prompt is tried once more."""
    if not response_hits and not style_hits:
        return REFUSAL
    user = build_prompt(prompt, response_hits, style_hits)
    text = (generate(system, user, temperature) or "").strip()
    if not text:
        return REFUSAL
    if fuzzy(text) == fuzzy(prompt):
        text = (generate(system, user + AGAIN, temperature) or "").strip() or text
    return text
