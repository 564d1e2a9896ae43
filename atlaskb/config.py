"""Settings: thresholds, weights, patterns and word lists, with overrides from the environment or a JSON text."""

from __future__ import annotations

import json
import os
from dataclasses import dataclass, field, fields, replace

# They decide results, so they are stated plainly and must not change.
EXCLUDE_PATTERNS = (
    "/wp-admin/", "/feed/", "/tag/", "?replytocom=",
    ".jpg", ".png", ".gif", ".ico", ".css", ".js",
    "?page=", "/news?", "/login/",
)
PAGE_NOISE = (
    "vai alla pagina", "leggi di più", "leggi di piu", "torna ai contenuti", "torna all'inizio", "condividi", "stampa", "home", "cerca",
    "ricerca", "accedi", "seguici su", "newsletter", "cookie", "privacy policy", "note legali", "tutti i servizi", "tutti i documenti",
    "tutte le news", "le indicazioni erano", "ho avuto problemi", "a volte le indicazioni", "capivo sempre", "non ho avuto problemi",
    "dove hai incontrato", "quali sono stati", "altro", "[0-9]+/[0-9]+",
)
CHUNK_NOISE = (
    "vai alla pagina", "leggi di più", "leggi di piu", "municipium", "accedi al servizio", "con identità digitale", "con spid", "con cie",
    "scarica", "download", "allega", "stampa", "condividi", "le indicazioni erano", "ho avuto problemi", "a volte le indicazioni",
    "capivo sempre", "non ho avuto problemi", "dove hai incontrato", "quali sono stati", "altro", "[0-9]+/[0-9]+",
)
ITALIAN = (
    "ciao", "come", "dove", "quando", "cosa", "chi", "perché", "orario", "ufficio", "comune", "servizio", "documenti", "informazioni",
    "grazie", "buongiorno", "buonasera",
)
ENGLISH = (
    "hello", "how", "where", "when", "what", "who", "why", "office", "service", "documents", "information", "thanks", "opening", "hours",
    "tourist",
)
#: Letters of a search token; any other character ends it.
TOKEN_LETTERS = "a-zàáâäèéêëìíîïòóôöùúûü"
LOG_MARKERS = ("Vector store caricato:", "Crawl incrementale completato", "=== Crawl", "[HTML ", "[PDF ")


@dataclass(frozen=True)
class Settings:
    site_url: str = ""
    allowed_domains: tuple[str, ...] = ()
    exclude_patterns: tuple[str, ...] = EXCLUDE_PATTERNS
    max_path_depth: int = 10
    domain_max_path_depth: dict[str, int] = field(default_factory=dict)
    max_pages: int = 0
    paragraph_chars: int = 1200
    overlap_chars: int = 150
    least_page_chars: int = 100
    least_chunk_chars: int = 80
    embedding_dim: int = 1024
    embed_chars: int = 6000
    embed_batch: int = 16
    top_k: int = 7
    fetch_factor: int = 3
    oversample: int = 20
    vector_weight: float = 0.4
    bm25_weight: float = 0.6
    rrf_k: int = 60
    least_similarity: float = 0.38
    least_fallback: float = 0.005
    k1: float = 1.5
    b: float = 0.75
    epsilon: float = 0.25
    title_boost: float = 0.02
    category_boost: float = 0.01
    boosted_category: str = "servizio"
    repeat_penalty: float = 0.05
    history: int = 6
    chat_per_hour: int = 20
    feedback_per_hour: int = 60
    cache_entries: int = 200
    #: Model name prefix to price for a million tokens in and out, in order of precedence.
    prices: tuple[tuple[str, float, float], ...] = ()

    @classmethod
    def from_env(cls, environ: dict[str, str] | None = None, file: str | None = None) -> Settings:
        """From the environment and, for names that it lacks, a file of NAME=value lines."""
        env = dict(os.environ if environ is None else environ)
        if file and os.path.exists(file):
            with open(file, encoding="utf-8") as lines:
                pairs = (line.strip().partition("=") for line in lines if "=" in line and not line.lstrip().startswith("#"))
                env = {k.strip(): v.strip().strip("'\"") for k, _, v in pairs} | env
        domains = tuple(d.strip() for d in env.get("CRAWL_ALLOWED_DOMAINS", "").split(",") if d.strip())
        return cls(site_url=env.get("SITE_URL", ""), allowed_domains=domains)

    def with_overrides(self, text: str) -> Settings:
        """Further exclude patterns and depths by domain, and any other setting by name; bad JSON changes nothing."""
        try:
            extra = json.loads(text)
        except ValueError:
            return self
        known = {f.name for f in fields(self)} - {"exclude_patterns", "domain_max_path_depth"}
        return replace(
            self,
            exclude_patterns=self.exclude_patterns + tuple(extra.get("exclude_patterns", ())),
            domain_max_path_depth=self.domain_max_path_depth | extra.get("domain_max_path_depth", {}),
            **{k: v for k, v in extra.items() if k in known},
        )
